"""Document fingerprints by spot signatures.

A spot signature is a common word (an anchor) and the chain of content words that
follows it. The set of a text's signatures, hashed to 32 bits, is its
fingerprint, written as the hexadecimal digits of the sorted hashes; likeness is
the Jaccard similarity of two sets. Words are runs of ASCII letters, digits and
non-ASCII bytes, compared in lower case.

Defined results: a text with words but no signature takes, in place of them, the
pairs of neighbouring words (or its only word). A text without words, or null,
has the empty fingerprint; two empty ones are alike (1.0), an empty and another
one are not (0.0). A text of more than a window of characters is read in windows
that end between words; what a chain still lacks is carried on, so its
fingerprint is that of the whole text.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, column, partitions, stored, text_bytes
from .minhash import BITS, bitmaps, open_pairs, rarest
from .words import WINDOW, U, distinct_each, mix, windows, words

#: Common words of English, German, French and Spanish (fixed values).
ANCHORS = (
    "the of and to in is that for it with as was on be by this from or an are "
    "der die das und von den des mit zu ein eine im auf nicht ist sich dem "
    "le la les de du et un une que qui dans est par pour pas sur au "
    "el los las del y en por con para se es al su no"
)
CHAIN = 2
#: Everything but ASCII letters, digits and non-ASCII bytes parts words.
BREAKS = np.array([not (c >= 128 or chr(c).isalnum()) for c in range(256)])


def _anchor_hashes() -> np.ndarray:
    data = np.frombuffer(ANCHORS.encode(), np.uint8)
    return np.unique(words(data, np.array([0, len(data)]), breaks=BREAKS)[0])


def _chains(hashes: np.ndarray, is_anchor: np.ndarray, text_of: np.ndarray, chain: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and texts of all anchors that ``chain`` content words of the same text follow."""
    content = np.flatnonzero(~is_anchor)
    anchors = np.flatnonzero(is_anchor)
    follow = np.searchsorted(content, anchors)[:, None] + np.arange(chain)
    inside = follow[:, -1] < len(content)
    anchors, follow = anchors[inside], content[follow[inside]] if len(content) else follow[inside]
    same = text_of[follow[:, -1]] == text_of[anchors] if len(anchors) else np.zeros(0, bool)
    anchors, follow = anchors[same], follow[same]
    value = hashes[anchors]
    for k in range(chain):
        value = mix(value * U(0xD6E8FEB86659FD93) + hashes[follow[:, k]])
    return value, text_of[anchors]


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * U(0x9FB21C651E98DF25) + second)


def signatures(data: np.ndarray, offsets: np.ndarray, chain: int = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 32-bit signatures of texts laid end to end, and their offsets."""
    hashes, _, at = words(data, offsets, breaks=BREAKS)
    text_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    value, owner = _chains(hashes, np.isin(hashes, _anchor_hashes()), text_of, chain)
    bare = np.flatnonzero((np.bincount(owner, minlength=len(at) - 1) == 0) & (np.diff(at) > 0))
    if len(bare):
        counts = np.diff(at)[bare]
        first = np.concatenate([np.arange(a, b) for a, b in zip(at[bare], at[bare] + np.maximum(counts - 1, 1))])
        padded = np.append(hashes, U(0))
        second = np.where(np.append(text_of, -1)[first + 1] == text_of[first], padded[first + 1], U(0))
        value = np.append(value, _pair(hashes[first], second))
        owner = np.append(owner, text_of[first])
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    return distinct_each(value >> U(32), np.searchsorted(owner, np.arange(len(at))))


def _open(run: np.ndarray, is_anchor: np.ndarray, chain: int) -> np.ndarray:
    """The words that anchors still short of a chain need: those anchors, once for each place among the content words after them, and these."""
    content = np.flatnonzero(~is_anchor)
    start = content[-chain] + 1 if len(content) >= chain else 0
    tail, parts, a = run[start:], [], 0
    for c in [*np.flatnonzero(~is_anchor[start:]).tolist(), len(tail)]:
        parts += [np.unique(tail[a:c]), tail[c : c + 1]]
        a = c + 1
    return np.concatenate(parts)


def long_signatures(data: np.ndarray, chain: int = CHAIN, most: int = WINDOW) -> np.ndarray:
    """``signatures`` of one text, ``most`` bytes at a time."""
    known = _anchor_hashes()
    none = np.zeros(0, U)
    found, fresh, carry, last, number = none, [], none, none, 0
    pairs = none  # of neighbouring words, while there is no signature
    for a, b in windows(data, BREAKS, most):
        own, _, _ = words(data[a:b], np.array([0, b - a]), breaks=BREAKS)
        run = np.append(carry, own)
        is_anchor = np.isin(run, known)
        value, _ = _chains(run, is_anchor, np.zeros(len(run), int), chain)
        fresh.append(np.unique(value >> U(32)))
        if sum(map(len, fresh)) > max(len(found), most):
            found, fresh = np.unique(np.concatenate([found, *fresh])), []
        carry = _open(run, is_anchor, chain)
        if not len(found) and not any(map(len, fresh)):
            line = np.append(last, own)
            pairs = np.union1d(pairs, _pair(line[:-1], line[1:]) >> U(32))
        number, last = number + len(own), own[-1:] if len(own) else last
    found = np.unique(np.concatenate([found, *fresh]))
    if len(found) or not number:
        return found
    return pairs if number > 1 else _pair(last, U(0)) >> U(32)


def sets_of(texts: list[str], chain: int = CHAIN, most: int = WINDOW) -> list[np.ndarray]:
    """The signatures of each text; a text of more than ``most`` characters is read in windows."""
    short = [t if len(t) <= most else "" for t in texts]
    values, at = signatures(*text_bytes(pa.array(short, pa.large_string())), chain)
    return [values[a:b] if len(t) <= most else long_signatures(np.frombuffer(t.encode(), np.uint8), chain, most) for t, a, b in zip(texts, at[:-1], at[1:])]


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0.0 without a comparison where their sizes rule ``least`` out."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if not small or small < least * large:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (small + large - both)


def _hex(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", chain: int = CHAIN) -> DataFrame:
    """``doc_id``, ``signatures`` (sorted array), their bitmap ``bits`` and ``fingerprint`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            data, offsets = text_bytes(column(block, "text"))
            if block.num_rows == 1 and len(data) > WINDOW:
                values = long_signatures(data, chain)
                at = np.array([0, len(values)])
            else:
                values, at = signatures(data, offsets, chain)
            prints = [_hex(values[a:b]) for a, b in zip(at[:-1], at[1:])]
            bits = pa.FixedSizeListArray.from_arrays(pa.array(bitmaps(values, at).ravel()), BITS // 64).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([column(block, "doc_id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.astype(np.int64))), bits, pa.array(prints, pa.string())], ["doc_id", "signatures", "bits", "fingerprint"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, signatures array<long>, bits array<long>, fingerprint string")


def near_pairs(prints: DataFrame, least: float) -> DataFrame:
    """``a``, ``b``, ``likeness`` of documents at least so alike (0 < least <= 1), of those with different fingerprints.

    Documents are partitioned by the length of their set so that alike ones are in
    the same or the next partition, and meet on a signature among the rarest
    ``n - ceil(least * n) + 1`` of each, without which they cannot be so alike.
    Lengths, bitmaps and places of the shared signatures rule out most of the pairs
    that meet; a common signature's documents are dealt to tasks in parts. Equal
    fingerprints are one class, named by its smallest doc_id.
    """
    percent = int(100 * least)
    classes = stored(prints.filter((F.size("signatures") > 0) & F.col("doc_id").isNotNull()).groupBy("fingerprint").agg(F.min("doc_id").alias("node"), F.first("signatures").alias("shingles"), F.first("bits").alias("bits")).drop("fingerprint"), keep="classes")
    rare = rarest(classes.select("node", "shingles"), percent)
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(1 / least + 1e-9)))
    held = stored(rare.withColumn("token", F.explode(F.array(F.xxhash64("token", band), F.xxhash64("token", band + 1)))), keep="rare")
    common = stored(held.groupBy("token").agg(F.count("*").alias("members")).filter("members > 1"), keep="common")
    rows = held.join(common, "token").join(classes.select("node", "bits"), "node").withColumn("root", F.col("node"))
    met = open_pairs(rows, percent).select(F.col("u").alias("a"), F.col("v").alias("b"))
    one, two = (classes.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    return met.join(two, "b").join(one, "a").select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("likeness")).filter(F.col("likeness") >= least)


def against_edited(docs: DataFrame, *, chain: int = CHAIN) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likeness to that and to the next document.

    In the edited text the last third (whole code points, rounded down) gives way
    to as many from the start of the next document in descending doc_id; the last
    document goes on with the first. A null doc_id comes last; rows of one doc_id
    are in order of a hash of their text. The rows are dealt into ranges of
    doc_id, sorted within, and the first row of each range is also dealt to the
    range before it, so a text is shuffled once.
    """
    spark = docs.sparkSession
    n = 4 * partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("*", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"))
    found = rows.select("doc_id").filter("doc_id is not null").approxQuantile("doc_id", [k / n for k in range(1, n)], 0.25 / n) or []
    many = Counter(int(c) for c in found)  # a doc_id that several quantiles fall on has as many ranges, by the texts' hashes
    longs = lambda values: F.array(*(F.lit(v).cast("long") for v in values)).cast("array<long>")
    above = F.size(F.filter(longs(sorted(many)), lambda c: c > F.col("doc_id")))
    often = {c: m for c, m in many.items() if m > 1}
    part = lambda m: F.floor((F.col("t1") / F.lit(2.0**64) + 0.5) * m)
    held = F.map_from_arrays(longs(often), longs(often.values()))
    own = F.coalesce(1 + part(F.try_element_at(held, F.col("doc_id"))), F.lit(0))  # such a doc_id is the last of its range
    width = max(many.values(), default=1) + 2
    rows = rows.withColumn("range", F.when(F.col("doc_id").isNull(), (len(many) + 1) * width + part(F.lit(n))).otherwise(above * width + own).cast("int"))
    key = F.struct((-F.col("doc_id")).alias("down"), "t1", "t2")
    # one row for each range: at most 4 * n, however large the table
    heads = [tuple(r) for r in rows.groupBy("range").agg(F.min(key).alias("k")).orderBy("range").select("range", "k.t1", "k.t2").collect()]
    if not heads:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    turned = spark.createDataFrame([(r, t1, t2, heads[k - 1][0]) for k, (r, t1, t2) in enumerate(heads)], "range int, t1 long, t2 long, back int")
    dealt = rows.join(F.broadcast(turned), ["range", "t1", "t2"], "left")
    own, copy = F.struct(F.col("range").alias("to"), F.lit(False).alias("copy")), F.struct(F.col("back").alias("to"), F.lit(True).alias("copy"))
    dealt = dealt.select("doc_id", "text", "t1", "t2", F.explode(F.when(F.col("back").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("d")).select("doc_id", "text", "t1", "t2", "d.to", "d.copy")
    dealt = dealt.repartition(n // 4, "to").sortWithinPartitions("to", "copy", F.desc_nulls_last("doc_id"), "t1", "t2")

    def compared(keys: list, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
        edited = [t[: len(t) - len(t) // 3] + x[: len(t) // 3] for t, x in zip(texts, nexts)]
        m = len(texts)
        sets = sets_of([*texts, nexts[-1], *edited], chain)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array([_hex(s) for s in sets[:m]], pa.string()),
                pa.array([_hex(s) for s in sets[m + 1 :]], pa.string()),
                pa.array([likeness(a, b) for a, b in zip(sets[:m], sets[m + 1 :])], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(sets[:m], sets[1 : m + 1])], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # a row that waits for the next one
        for block in blocks(batches, "text", 2 << 20):
            got = list(zip(*(column(block, k).to_pylist() for k in ("doc_id", "text", "to", "copy"))))
            line = got if held is None else [held, *got]
            held = line[-1]
            pairs = [(a, b) for a, b in zip(line, line[1:]) if not a[3] and a[2] == b[2]]
            # rows of one stretch follow each other; a stretch ends where a copy stands
            start = 0
            for k in range(1, len(pairs) + 1):
                if k == len(pairs) or pairs[k - 1][1] is not pairs[k][0]:
                    part = pairs[start:k]
                    yield compared([a[0] for a, _ in part], [a[1] for a, _ in part], [b[1] for _, b in part])
                    start = k

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
