"""One query for each operator, over its whole table, and SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors, byte_bpe, fim, line_dedup, minhash, packing, quality, sharding, spotsigs, suffix_dedup, topk, trie, url_filter
from .common import table


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Every fifth document by CRC is kept out of learning."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = quality.learn(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = quality.scores(docs, field)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.drop_recurring(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.md5(F.encode("text", "utf-8")).alias("text_md5"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.evaluate(url_filter.captures_of(pages), url_filter.dated_list(pages)).drop("fetched").withColumn("listed_since", F.col("listed_since").cast("string"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), digest=True)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.against_edited(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = anchors.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_sharding": op2_sharding,
    "op3_quality": op3_quality,
    "op4_line_dedup": op4_line_dedup,
    "op5_topk": op5_topk,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_url_filter": op7_url_filter,
    "op8_minhash": op8_minhash,
    "op9_spotsigs": op9_spotsigs,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op4_line_dedup": line_dedup.ORACLE,
    "op5_topk": topk.ORACLE,
    "op7_url_filter": url_filter.ORACLE,
    "op8_minhash": minhash.ORACLE,
    "op10_suffix_dedup": suffix_dedup.ORACLE,
    "op11_fill_in_middle": fim.ORACLE,
    "op12_substring_dedup": anchors.ORACLE,
    "op13_prefix_trie": trie.ORACLE,
}
