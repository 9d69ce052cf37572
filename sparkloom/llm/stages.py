"""Operators as stages over the table of documents: each keeps its columns, whatever their names, and changes its rows or texts. An empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup, minhash, packing, quality, suffix_dedup
from .common import table
from .queries import held_out, vocabulary


def _set_aside(docs: DataFrame) -> DataFrame:
    """``docs`` with its extra columns under names that no operator adds."""
    return docs.select(*(F.col(c) if c in ("doc_id", "text") else F.col(c).alias(f"own_{i}") for i, c in enumerate(docs.columns)))


def _own(docs: DataFrame) -> dict[str, Column]:
    """The columns of ``docs``, taken from what an operator made of ``_set_aside(docs)``."""
    return {c: F.col(c if c in ("doc_id", "text") else f"own_{i}").alias(c) for i, c in enumerate(docs.columns)}


def _with_text(docs: DataFrame, changed: DataFrame, text: str = "text") -> DataFrame:
    """The columns of documents from ``changed``, in which ``n_chars`` counts the text again."""
    return changed.select(*(F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(text).alias("text") if c == "text" else own for c, own in _own(docs).items()))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold.

    A null or empty text is judged as one empty line. Repeated rows and rows
    without a doc_id are judged each. Without usable labels all score 0.5 and stay.
    """
    field = quality.learn(docs, table(spark, sf_dir, "labels"), ~held_out())
    return quality.scores(_set_aside(docs), field).filter(F.col("score") >= quality.THRESHOLD).select(*_own(docs).values())


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose templates recur; the first line of each template stays.

    A null text stays null; a text all of whose lines go is empty, and its row
    stays, as do blank lines. Rows alike in doc_id and text are one document and
    all come back; a null doc_id counts as the last.
    """
    return _with_text(docs, line_dedup.drop_recurring(_set_aside(docs)))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group.

    A null or blank text is in no group. Of several rows of a doc_id that stays, one
    stays: one with words if there is one, then that of smallest text hash. Rows
    without a doc_id all stay.
    """
    judged = minhash.near_duplicates(docs.select("doc_id", "text"))
    kept = judged.filter("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi")
    best = F.struct(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"), F.xxhash64("text"))
    one = named.groupBy(F.col("doc_id").alias("key")).agg(F.min_by(F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns))), best).alias("row"))
    return one.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns))).unionByName(docs.filter("doc_id is null"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of strings that start earlier.

    A null text becomes the empty text. Code points of which a byte goes are gone
    as a whole. Rows alike in doc_id and text are one document and all come back; a
    null doc_id counts as the last. A text that becomes empty stays as a row.
    """
    aside = _set_aside(docs)
    carry = tuple(c for c in aside.columns if c not in ("doc_id", "text"))
    return _with_text(docs, suffix_dedup.remove_repeats(aside, carry=carry, as_text=True), "kept")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with the sequences that hold them.

    A null or empty text is its end token. Every row is packed for itself, whatever
    its doc_id.
    """
    pieces = packing.pack(docs, vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
