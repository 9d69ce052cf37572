"""Near-duplicates by MinHash with tensored banding.

Two collections of ``halves`` half keys are drawn from 2 * halves * width
minhashes. Table (i, j) is keyed by half i of the first collection with half j of
the second, so halves**2 tables of 2 * width minhashes each come from a square
root of the minhashes that independent tables would need. A pair of similarity s
meets in a table with probability (1 - (1 - s**width)**halves)**2: 0.9995 at 0.75
with the defaults, and within 1e-9 of one from 0.95 on.

Documents with equal sets are one class and enter once. Half keys that no other
class has are dropped before tables are formed, so only documents with something
in common reach them. In a table's bucket each class is compared with the
bucket's smallest class; a bucket whose classes then still fall into several
components compares the others with the smallest class of another component.
Classes of buckets that even then hold untested candidates are joined exactly:
sets that alike share one of their rarest shingles, so all pairs of different
components that share one, and that sizes, bitmaps and the places of the shared ones
allow, are compared. Every link is confirmed on the full sets; no candidate is cut
off.

A set's bitmap has at each of ``BITS`` places whether an odd number of its shingles
hash there. Two bitmaps differ in at most as many places as the sets differ in
shingles, so pairs whose bitmaps differ too much are dropped in the join that
finds them, before sets are moved: what a large group of texts around one passage
emits is in proportion to the pairs that are nearly alike.

Defined results: a null or blank text has an empty set, ``n_shingles`` 0, and is
linked with nothing. A null doc_id takes no part in links (it has no name to link
by) and comes back as its own kept row. Rows of one doc_id are one document, which
is linked by each of its texts; each row comes back with its own ``n_shingles`` and
the document's component, a row without words with its own doc_id. Extra columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, column, discard, stored, text_bytes
from .components import components, with_links
from .words import WINDOW, distinct_each, long_set, minima, mix, shingles, words

WIDTH, HALVES = 2, 10
#: Star rounds over rare shingles before the open pairs are listed, and the part of a shingle's nodes that a row meets at once.
STARS, PART = 2, 2000
BITS = 1024
WORDS = range(BITS // 64)
SKETCH = "doc_id long, n_shingles long, set_high long, set_low long, halves array<int>, bits array<long>"


def sets_of(block: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the block's texts, and their offsets. A long text, which is a block by itself, is read in windows."""
    data, offsets = text_bytes(column(block, "text"))
    if block.num_rows == 1 and len(data) > 4 * WINDOW:
        values = long_set(data, size)
        return values, np.array([0, len(values)])
    hashes, _, at = words(data, offsets)
    return distinct_each(*shingles(hashes, at, size))


def set_digest(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each sorted set, which name it."""
    out = []
    for salt in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        sums = np.append(np.uint64(0), np.cumsum(mix(values ^ np.uint64(salt)), dtype=np.uint64))
        out.append(mix(sums[at[1:]] - sums[at[:-1]] + np.uint64(salt)).view(np.int64))
    return out[0], out[1]


def bitmaps(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each set's bitmap as 64-bit words: sets x words."""
    place = (mix(values ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(BITS)).astype(np.int64)
    odd = np.bincount(np.repeat(np.arange(len(at) - 1), np.diff(at)) * BITS + place, minlength=(len(at) - 1) * BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, BITS), axis=1).view(np.int64)


def _words(name: str) -> list[Column]:
    return [F.get("bits", F.lit(i)).alias(f"{name}{i}") for i in WORDS]


def _may_be_alike(percent: int) -> Column:
    """Whether sizes ``nu``, ``nv`` and the words of two bitmaps allow the similarity."""
    apart = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"u{i}").bitwiseXOR(F.col(f"v{i}"))) for i in WORDS))
    return (100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")) & ((100 + percent) * apart <= (100 - percent) * (F.col("nu") + F.col("nv")))


def sketches(docs: DataFrame, size: int = 5, width: int = WIDTH, halves: int = HALVES) -> DataFrame:
    """Set size, set name and the 2 * halves half keys of every document (none for an empty set)."""
    seeds = np.random.default_rng(77).integers(0, 1 << 63, 2 * halves * width, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            values, at = sets_of(block, size)
            number = np.diff(at)
            high, low = set_digest(values, at)
            full = np.flatnonzero(number)
            lists = [None] * len(number)
            if len(full):
                least = minima(values, np.append(at[full], len(values)), seeds)
                keys = reduce(lambda a, k: mix(a * np.uint64(0x9FB21C651E98DF25) + least[:, k::width]), range(width), np.zeros((len(full), 2 * halves), np.uint64))
                for row, own in zip(full.tolist(), keys.astype(np.uint32).view(np.int32)):
                    lists[row] = own
            bits = pa.FixedSizeListArray.from_arrays(pa.array(bitmaps(values, at).ravel()), len(WORDS)).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([column(block, "doc_id"), pa.array(number), pa.array(high), pa.array(low), pa.array(lists, pa.list_(pa.int32())), bits], ["doc_id", "n_shingles", "set_high", "set_low", "halves", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SKETCH)


def shingle_sets(docs: DataFrame, size: int = 5) -> DataFrame:
    """``doc_id``, the name of the set, and the full set of shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            values, at = sets_of(block, size)
            high, low = set_digest(values, at)
            yield pa.RecordBatch.from_arrays([column(block, "doc_id"), pa.array(high), pa.array(low), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))], ["doc_id", "set_high", "set_low", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, set_high long, set_low long, shingles array<long>")


def tables(classes: DataFrame, halves: int) -> DataFrame:
    """``key``, ``node`` of each table that a class may share with another one."""
    parts = classes.select("node", F.posexplode("halves").alias("place", "half"))
    shared = parts.groupBy("place", "half").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b").select("place", "half")
    own = parts.join(shared, ["place", "half"]).groupBy("node").agg(F.collect_list(F.struct("place", "half")).alias("own"))  # at most 2 * halves
    first, second = F.filter("own", lambda x: x.place < halves), F.filter("own", lambda x: x.place >= halves)
    keys = own.select("node", first.alias("first"), second.alias("second")).filter((F.size("first") > 0) & (F.size("second") > 0))
    return keys.select("node", F.explode(F.flatten(F.transform("first", lambda a: F.transform("second", lambda b: F.xxhash64(a.place, a.half, b.place, b.half))))).alias("key"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``u``, ``v`` whose full sets have that much in common."""
    one, two = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "uv")
    both = F.size(F.array_intersect("su", "sv"))
    # the set of v first: u is often one hub with many partners, whose set would be copied to each
    return pairs.join(two, "v").join(one, "u").filter(100 * both >= percent * (F.size("su") + F.size("sv") - both)).select("u", "v")


def rarest(sets: DataFrame, percent: int) -> DataFrame:
    """``token``, ``node``, ``n``, ``place`` of the rarest shingles of each set.

    Sets that alike have one of these in common, and the count and last place of
    those bound what they can share in all. Shingles of one set only take places
    but make no rows. The order of shingles is that of their number of sets.
    """
    own = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    often = own.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    held = own.join(often, "token").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("held"))  # of one document
    first = F.size("held") + 1 - F.ceil(F.col("n") * percent / 100).cast("int")
    chosen = held.withColumn("first", first).filter("first > 0")
    return chosen.select("node", "n", (F.col("n") - F.size("held")).alias("alone"), F.posexplode(F.slice("held", 1, F.col("first"))).alias("at", "h")).select("h.token", "node", "n", (F.col("alone") + F.col("at")).alias("place"))


def _rooted(rare: DataFrame, roots: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rare`` with the ``root`` and bitmap of each node, without the shingles whose nodes are all in one component."""
    rows = rare.join(roots.withColumnRenamed("node", "m"), F.col("m") == F.col("node"), "left").select(*rare.columns, F.coalesce("root", "node").alias("root"))
    # stored apart from the rows, so that the join can split a common shingle
    groups = stored(rows.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("members")).filter("a <> b").select("token", "members"))
    kept = stored(rows.join(groups, "token").join(sizes.select("node", "bits"), "node"))
    discard(groups)
    return kept


def _stars(rows: DataFrame, percent: int) -> DataFrame:
    """The smallest node of each shingle with those outside its component that may be alike."""
    least = rows.groupBy("token").agg(F.min_by(F.struct(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("root").alias("ru"), *_words("u")), "node").alias("s"))
    least = stored(least.select("token", "s.*"))
    others = rows.select("token", F.col("node").alias("v"), F.col("n").alias("nv"), "root", *_words("v"))
    pairs = others.join(least, "token").filter((F.col("root") != F.col("ru")) & _may_be_alike(percent))
    return pairs.select("u", "v").distinct()


def open_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components that their rarest shingles and bitmaps allow to be alike, dealt by parts of large groups."""
    parts = F.ceil(F.col("members") / PART).cast("int")
    one = rows.select("token", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), F.col("node").alias("u"), F.col("n").alias("nu"), F.col("place").alias("pu"), F.col("root").alias("ru"), *_words("u"))
    two = rows.select("token", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("node").alias("v"), F.col("n").alias("nv"), F.col("place").alias("pv"), F.col("root").alias("rv"), *_words("v"))
    met = one.join(two, ["token", "part"]).filter((F.col("u") < F.col("v")) & (F.col("ru") != F.col("rv")) & _may_be_alike(percent))
    seen = met.groupBy("u", "v", "nu", "nv").agg(F.count("*").alias("c"), F.max("pu").alias("pu"), F.max("pv").alias("pv"))
    most = F.col("c") + F.least(F.col("nu") - F.col("pu"), F.col("nv") - F.col("pv")) - 1
    return seen.filter((100 + percent) * most >= percent * (F.col("nu") + F.col("nv"))).select("u", "v")


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 75, width: int = WIDTH, halves: int = HALVES) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for every row of ``docs(doc_id, text)``."""
    rows = stored(sketches(docs, size, width, halves), keep="sketches")
    named = rows.filter("n_shingles > 0 and doc_id is not null")
    every = named.groupBy("set_high", "set_low").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("halves").alias("halves"), F.first("bits").alias("bits"))
    classes = stored(every.withColumn("node", F.monotonically_increasing_id()), keep="classes")  # written once, so the numbers stay
    keyed = stored(tables(classes, halves), keep="tables")
    sizes = classes.select("node", "n", "bits")

    # what a bucket's members are joined with is stored apart from them, so that the join can split a hot bucket
    least = stored(keyed.groupBy("key").agg(F.min("node").alias("u"), F.count("*").alias("members")).filter("members > 1"), keep="least")
    stars = keyed.join(least.select("key", "u"), "key").filter("u <> node").select("u", F.col("node").alias("v"))
    pairs = stored(_alike_in_size(stars.groupBy("u", "v").agg(F.count("*").alias("tables")), sizes, percent), keep="pairs")
    # later rounds pair classes of buckets of three or more, whatever the first star's sizes were
    more = keyed.join(least.filter("members > 2").select("key"), "key", "left_semi").select("node")
    active = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).union(more).distinct()
    # the active classes have no size bound, so neither plan nor growth may hang on a broadcast of them
    active = classes.select("node", "doc", "set_high", "set_low").join(active.hint("merge"), "node", "left_semi")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(active.select(F.col("doc").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    found = shingle_sets(source, size).join(active.hint("merge"), ["set_high", "set_low"]).filter("doc_id = doc")
    sets = stored(found.dropDuplicates(["set_high", "set_low"]).select("node", "shingles"), keep="sets")

    best = stored(pairs.groupBy("v").agg(F.max_by("u", F.struct("tables", -F.col("u"))).alias("u")), keep="best")
    roots = stored(components(confirmed(best, sets, percent)), keep="roots")
    rest = _apart(pairs.join(best, ["u", "v"], "left_anti"), roots)
    roots = _linked(roots, confirmed(rest, sets, percent))
    # what is left: buckets of several components; the smallest class outside the first one's component against the others
    members = stored(_members(keyed, roots), keep="members")
    first = members.groupBy("key").agg(F.min_by("root", "node").alias("root1"), F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b")
    first = stored(first.select("key", "root1"), keep="first")
    others = stored(members.join(first, "key").filter("root <> root1").select("key", "node", "root"), keep="others")
    second = others.groupBy("key").agg(F.min("node").alias("u"), F.min_by("root", "node").alias("root_u"), F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b")
    second = stored(second.select("key", "u", "root_u"), keep="second")
    again = others.join(second, "key").filter("root <> root_u").select("u", F.col("node").alias("v"))
    again = _alike_in_size(again.distinct().join(pairs, ["u", "v"], "left_anti"), sizes, percent).select("u", "v")
    roots = _linked(roots, confirmed(again, sets, percent))
    discard(members, first, others, second, best)
    # a bucket's smallest class was compared with all of it; buckets whose others are still apart hold untested candidates
    members = stored(_members(keyed.join(least.filter("members > 2").select("key", "u"), "key").filter("u <> node").select("key", "node"), roots), keep="members")
    open_keys = stored(members.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("key"), keep="open")
    left = stored(members.join(open_keys, "key", "left_semi").select("node").distinct(), keep="left")
    discard(members, open_keys, keyed, least, pairs)
    if not left.isEmpty():
        rare = stored(rarest(sets.join(left.hint("merge"), "node", "left_semi"), percent), keep="rare")
        for _ in range(STARS):  # these only save comparisons: what they link need not be paired below
            rows_ = _rooted(rare, roots, sizes)
            before, roots = roots, _linked(roots, confirmed(_stars(rows_, percent), sets, percent))
            discard(rows_)
            if roots is before:
                break
        rows_ = _rooted(rare, roots, sizes)
        roots = _linked(roots, confirmed(stored(open_pairs(rows_, percent), keep="pairs"), sets, percent))
        discard(rows_, rare)
    # texts of one doc_id are one document
    several = stored(named.groupBy("doc_id").agg(F.min("set_high").alias("a"), F.max("set_high").alias("b")).filter("a <> b").select("doc_id"), keep="several")
    twins = named.join(several, "doc_id", "left_semi").select("doc_id", "set_high", "set_low").distinct().join(classes.select("node", "set_high", "set_low"), ["set_high", "set_low"]).select("doc_id", "node")
    twins = stored(twins, keep="twins")
    head = stored(twins.groupBy("doc_id").agg(F.min("node").alias("u")), keep="head")
    roots = _linked(roots, twins.join(head, "doc_id").filter("node <> u").select("u", F.col("node").alias("v")))
    discard(sets, left, several, twins, head)

    rooted = classes.join(roots, "node", "left").select("doc", "set_high", "set_low", F.coalesce("root", "node").alias("root"))
    names = stored(rooted.groupBy("root").agg(F.min("doc").alias("component")), keep="components")
    top = rooted.join(names, "root").select("set_high", "set_low", "component")
    joined = rows.select("doc_id", "n_shingles", "set_high", "set_low").join(top, ["set_high", "set_low"], "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = joined.select("doc_id", "n_shingles", F.when(linked, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _linked(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The same table if the links connect nothing new."""
    fresh = stored(links, keep="links")
    made = with_links(roots, fresh)
    discard(fresh)
    return made


def _members(keyed: DataFrame, roots: DataFrame) -> DataFrame:
    """``key``, ``node`` with the node's component."""
    return keyed.join(roots.withColumnRenamed("node", "m"), F.col("m") == F.col("node"), "left").select("key", "node", F.coalesce("root", "node").alias("root"))


def _alike_in_size(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Only pairs whose set sizes and bitmaps allow the similarity."""
    one, two = (sizes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), *_words(x)) for x in "uv")
    return pairs.join(one, "u").join(two, "v").filter(_may_be_alike(percent)).select(*pairs.columns)


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Only pairs that are not in one component yet."""
    one, two = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "uv")
    top: list[Column] = [F.coalesce(f"r{x}", x) for x in "uv"]
    return pairs.join(one, "u", "left").join(two, "v", "left").filter(top[0] != top[1]).select("u", "v")


#: The result of ``op8`` in DuckDB's SQL: sets that share a shingle are compared in full, and links are followed from every set.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
s AS (SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS sh FROM w),
r AS (SELECT doc_id, len(sh) AS n, md5(array_to_string(sh, chr(10))) AS k, sh FROM s),
member AS (SELECT DISTINCT doc_id, k FROM r WHERE n > 0 AND doc_id IS NOT NULL),
cls AS (SELECT k, any_value(n) AS n, any_value(sh) AS sh FROM r WHERE n > 0 AND doc_id IS NOT NULL GROUP BY k),
g AS (SELECT k, n, unnest(sh) AS g FROM cls),
link AS (SELECT a.k AS a, b.k AS b FROM g a JOIN g b ON a.g = b.g AND a.k < b.k GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link UNION ALL SELECT x.k, y.k FROM member x JOIN member y ON x.doc_id = y.doc_id AND x.k <> y.k),
reach AS (SELECT k AS a, k AS b FROM cls UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
comp AS (SELECT reach.a AS k, min(member.doc_id) AS c FROM reach JOIN member ON member.k = reach.b GROUP BY reach.a)
SELECT r.doc_id, r.n AS n_shingles, CASE WHEN r.n > 0 AND r.doc_id IS NOT NULL THEN comp.c ELSE r.doc_id END AS component_id,
  (CASE WHEN r.n > 0 AND r.doc_id IS NOT NULL THEN comp.c ELSE r.doc_id END) IS NOT DISTINCT FROM r.doc_id AS kept
FROM r LEFT JOIN comp USING (k)
"""
