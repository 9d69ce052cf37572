"""Removal of repeated byte strings with suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts earlier (in a
smaller doc_id, or earlier in the same document) is removed; strings never cross
documents and are judged on the input.

Which parts of which texts must meet is found first. Of every ``length`` bytes
the ``gram`` bytes of smallest hash are chosen, so equal strings choose equal
grams. A gram chosen in one place only rules out every string that chose it;
the others keep, around each of their places, the bytes that strings choosing
them can reach. All places of a gram go to the shard of the segment of text that
has it first (its owner), so neighbouring grams travel together and equal strings
always meet.

In a shard, the parts are laid end to end in document order; a suffix array by
Larsson-Sadakane refinement and Kasai's common prefixes give the classes of equal
strings, and all but the first of each are repeats. An owner whose shard would
be too large has several; each holds the owner's own parts, which are short and
settle nearly all strings, and a share of the others. Of what a shard could not
settle, one place for each string and shard goes to a second round of the same
kind; what is still open there goes out as sorted string names, and binary search
in the merged names finds the first place of each.

Defined results: a null text is the empty text (0 bytes, nothing removed). A null
doc_id counts as 2**63 - 1; documents of one doc_id are ordered by a hash of
their text. Rows that repeat both doc_id and text are one document and all come
back. Texts shorter than ``length`` keep all. Extra columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, column, discard, runs, stored, text_bytes
from .suffix import common_prefixes, repeats, suffix_array
from .words import _VALUE, mix, run_hashes

LENGTH, GRAM = 100, 32
#: Bytes of a text that are one owner of grams, and strings that start in a part.
SEGMENT = CUT = 64 << 10
#: Strings that choose their grams together.
STEP = 1 << 17
#: Bytes of parts that a shard should hold; an owner that draws more gets several.
SHARD_BYTES = 512 << 10
#: Most 64-bit hashes that different texts may share; 10^12 texts share about 30,000.
ALIKE = 1 << 20
#: Names that are searched together at the end.
NAMES = 100_000
LAST = (1 << 63) - 1
_SECOND = np.random.default_rng(99).integers(1, 1 << 63, 256, dtype=np.uint64)


def chosen_grams(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that strings of ``length`` bytes choose; strings within one text only.

    A choice depends on the string's own bytes alone, so ``step`` strings are
    looked at together, however long the text is.
    """
    span = length - gram + 1
    chosen: list[np.ndarray] = [np.zeros(0, np.int64)]
    names: list[np.ndarray] = [np.zeros(0, np.uint64)]
    for a in range(0, len(data) - length + 1, step):
        hashes = run_hashes(data[a : a + step + length - 1], gram)
        key = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
        reach = 1
        while reach * 2 <= span:
            key = np.minimum(key[:-reach], key[reach:])
            reach *= 2
        if span > reach:
            key = np.minimum(key[: len(key) - (span - reach)], key[span - reach :])
        best = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # strings that reach into the next text choose nothing
        cut = offsets[(offsets > a) & (offsets < a + len(best) + length - 1)] - a
        inside = np.ones(len(best) + length, bool)
        for c in cut.tolist():
            inside[max(c - length + 1, 0) : c] = False
        best = best[inside[: len(best)]]
        if len(best):
            best = best[np.append(True, best[1:] != best[:-1])]  # the chosen place never goes back
            chosen.append(best + a)
            names.append(hashes[best])
    places, hashes = np.concatenate(chosen), np.concatenate(names)
    keep = np.append(True, places[1:] != places[:-1])[: len(places)]  # one place chosen on both sides of a step
    return places[keep], hashes[keep]


def _segment(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Name of the segment of a text in which a place lies."""
    return mix(key.view(np.uint64) ^ mix((place // SEGMENT + 1).astype(np.uint64))).view(np.int64)


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals given in order of their begin."""
    if not len(begin):
        return begin, end
    furthest = np.maximum.accumulate(end)
    first = np.append(True, begin[1:] > furthest[:-1])
    heads = np.flatnonzero(first)
    return begin[heads], np.maximum.reduceat(end, heads)


def _identified(docs: DataFrame, text: str, doc_id: str, carry: tuple[str, ...] = ()) -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("o"), F.col(doc_id).cast("long").alias("doc_id"), t.alias("text"), *(F.col(c).alias(f"x_{c}") for c in carry))
    return rows.select("*", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"))


def _grams(rows: DataFrame, length: int, gram: int, places: bool) -> DataFrame:
    """Chosen grams of each part, once for each key of a block: with their places, or with the part's order and whether they come twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "part"):
            key, o = np.asarray(column(block, "key")), np.asarray(column(block, "o"))
            order = np.lexsort((o, key))
            once = np.sort(order[np.append(True, key[order][1:] != key[order][:-1])]) if len(order) else order
            block = block.take(pa.array(once))
            key, o = key[once], o[once]
            data, offsets = text_bytes(column(block, "part"))
            at, hashes = chosen_grams(data, offsets, length, gram)
            owner = np.searchsorted(offsets, at, "right") - 1
            h, place = hashes.view(np.int64), at - offsets[owner]
            segment = _segment(key[owner], place)
            if places:
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(key[owner]), pa.array(place.astype(np.int32)), pa.array(segment)], ["h", "key", "place", "segment"])
                continue
            order = np.lexsort((h, owner))  # stable: the first place of each gram leads
            h, owner, segment = h[order], owner[order], segment[order]
            heads = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))[: len(h)])
            yield pa.RecordBatch.from_arrays([pa.array(h[heads]), pa.array(key[owner[heads]]), pa.array(o[owner[heads]]), pa.array(segment[heads]), pa.array(np.diff(np.append(heads, len(h))) > 1)], ["h", "key", "o", "segment", "twice"])

    return rows.select("o", "key", "part").mapInArrow(run, "h long, key long, place int, segment long" if places else "h long, key long, o long, segment long, twice boolean")


PART = "owner long, own boolean, o long, t1 long, t2 long, start long, part binary"


def _parts(marked: DataFrame, length: int, gram: int) -> DataFrame:
    """Cuts the bytes around its shared grams from each part, for each owner, into at most ``CUT`` strings each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "part"):
            marks, size = column(block, "marks"), np.diff(text_bytes(column(block, "part"))[1])
            row = np.repeat(np.arange(block.num_rows), marks.value_lengths().to_numpy())
            owner, place, own = (np.asarray(marks.flatten().field(k)) for k in ("owner", "place", "own"))
            order = np.lexsort((place, own, owner, row))
            row, owner, place, own = row[order], owner[order], place[order].astype(np.int64), own[order]
            begin, end = np.maximum(place + gram - length, 0), np.minimum(place + length, size[row])
            new = np.append(True, (row[1:] != row[:-1]) | (owner[1:] != owner[:-1]) | (own[1:] != own[:-1]) | (begin[1:] > end[:-1]))[: len(row)]
            row, owner, own, begin = row[new], owner[new], own[new], begin[new]
            end = end[np.append(new[1:], True)[: len(new)]]
            cuts = np.maximum(-(-(end - begin - length + 1) // CUT), 1)
            which, number = runs(cuts)
            row, owner, own, begin, end = row[which], owner[which], own[which], begin[which] + number * CUT, end[which]
            end = np.minimum(end, begin + CUT + length - 1)
            raw = column(block, "part").to_pylist()
            parts = [raw[r][x:y] for r, x, y in zip(row.tolist(), begin.tolist(), end.tolist())]
            o, t1, t2, base = (np.asarray(column(block, k))[row] for k in ("o", "t1", "t2", "start"))
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(own), pa.array(o), pa.array(t1), pa.array(t2), pa.array(base + begin), pa.array(parts, pa.binary())], ["owner", "own", "o", "t1", "t2", "start", "part"])

    return marked.select("o", "t1", "t2", "start", "part", "marks").mapInArrow(run, PART)


def _shard(length: int):
    """Repeats within a shard, and the stretches that it can't settle."""

    def run(shard: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["o", "t1", "t2", "start"], kind="stable")
        o, t1, t2, start = (group[k].to_numpy() for k in ("o", "t1", "t2", "start"))
        new = np.append(True, (o[1:] != o[:-1]) | (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1]))
        document = np.cumsum(new) - 1
        pieces, at, doc_of, own = [], [], [], []
        reach = -1
        for k, (d, s, part, of_owner) in enumerate(zip(document.tolist(), start.tolist(), group.part, group.own.tolist())):  # parts of one document may overlap
            if new[k]:
                reach = -1
            if s + len(part) <= reach:
                continue
            if s <= reach:
                pieces[-1] += part[reach - s :]  # a part has a bounded length
                own[-1] &= of_owner
            else:
                pieces.append(bytes(part))
                own.append(of_owner)
                at.append(s)
                doc_of.append(d)
            reach = s + len(part)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces])
        ends = np.cumsum(sizes)
        piece = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(data))
        usable = place + length <= ends[piece]
        order = suffix_array(data, length)
        first, again = repeats(data, order, common_prefixes(data, order, length), usable, length)
        doc_of, at = np.array(doc_of), np.array(at)
        where = at[piece] + place - (ends - sizes)[piece]
        head = np.flatnonzero(new)

        def stretches(mask: np.ndarray, settled: bool) -> pd.DataFrame:
            p = np.flatnonzero(mask)
            new_one = np.append(True, (p[1:] != p[:-1] + 1) | (piece[p[1:]] != piece[p[:-1]]))[: len(p)]
            a, b = p[new_one], p[np.append(new_one[1:], True)[: len(p)]]
            d = head[doc_of[piece[a]]]
            text = [None if settled else data[x : y + length].tobytes() for x, y in zip(a, b)]
            return pd.DataFrame({"o": o[d], "t1": t1[d], "t2": t2[d], "start": where[a], "until": where[b] + length, "part": text, "settled": settled})

        found = stretches(again, True)
        if shard[1]:  # one of several shards of an owner, whose own parts are in all of them
            found = pd.concat([found, stretches(usable & ~again & ~np.array(own)[piece], False)])
        return found

    return run


STRETCH = "o long, t1 long, t2 long, start long, until long, part binary, settled boolean"


def _judged(parts: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """Deals parts to shards and judges them there.

    An owner is a segment of a text, so its own parts are small, and go to all of
    its shards; the others are dealt among these one by one.
    """
    size = F.octet_length("part")
    total = parts.agg(F.sum(size)).first()[0] or 0
    bins = 2 * max(1, -(-total // shard_bytes))
    # only owners of several shards are listed, and apart from the parts, so that the join can split a hot one
    several = stored(parts.groupBy("owner").agg(F.ceil(F.sum(size) / shard_bytes).cast("int").alias("shards")).filter("shards > 1"), keep="several")
    one = F.array((1 + F.pmod(F.xxhash64("t1", "t2", "start"), F.col("shards"))).cast("int"))
    salt = F.when(F.col("shards").isNull(), F.array(F.lit(0))).when(F.col("own"), F.sequence(F.lit(1), F.col("shards"))).otherwise(one)
    place = F.when(F.col("shards").isNull(), F.pmod(F.xxhash64("owner"), F.lit(bins))).otherwise(F.col("owner"))
    dealt = parts.join(several, "owner", "left").select(place.alias("g"), F.explode(salt).alias("salt"), "own", "o", "t1", "t2", "start", "part")
    judged = stored(dealt.groupBy("g", "salt").applyInPandas(_shard(length), STRETCH), keep="judged")
    discard(parts, several)
    return judged


def _shared(rows: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """``key, marks``: the shared grams of each key, with the owner they meet at (the segment that has them first); and a table to discard later."""
    both = _grams(rows, length, gram, places=False).groupBy("h").agg(F.min_by("segment", "o").alias("owner"), F.min("key").alias("a"), F.max("key").alias("b"), F.max("twice").alias("twice"))
    shared = stored(both.filter("twice or a <> b").select("h", "owner"), keep="shared")
    places = _grams(rows, length, gram, places=True).join(shared, "h")
    mark = F.struct("owner", "place", (F.col("segment") == F.col("owner")).alias("own"))
    return places.groupBy("key").agg(F.collect_set(mark).alias("marks")), shared  # of one text


def _named(stretches: DataFrame, length: int) -> DataFrame:
    """Every string of the stretches by two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "part"):
            data, offsets = text_bytes(column(block, "part"))
            row, place = runs(np.diff(offsets) - length + 1)
            at = offsets[row] + place
            one, two = (run_hashes(data, length, v).view(np.int64)[at] for v in (_VALUE, _SECOND))
            o, t1, t2, start = (np.asarray(column(block, k))[row] for k in ("o", "t1", "t2", "start"))
            yield pa.RecordBatch.from_arrays([*map(pa.array, (o, t1, t2, start + place, start + place + length, one, two))], ["o", "t1", "t2", "start", "until", "w1", "w2"])

    return stretches.select("o", "t1", "t2", "start", "part").mapInArrow(run, "o long, t1 long, t2 long, start long, until long, w1 long, w2 long")


def _settle(bucket: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """A place is a repeat unless binary search for its string in the sorted names leads to itself."""
    group = group.drop_duplicates(["t1", "t2", "start"]).sort_values(["w1", "w2", "o", "t1", "start"], kind="stable").reset_index(drop=True)
    _, one = np.unique(group.w1.to_numpy(), return_inverse=True)
    two_values, two = np.unique(group.w2.to_numpy(), return_inverse=True)
    name = one * len(two_values) + two  # in the order of (w1, w2)
    first = np.searchsorted(name, name, "left")
    return group.loc[first != np.arange(len(group)), ["t1", "t2", "start", "until"]]


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``key``, one number for each different (t1, t2): t1, and another hash for texts of which several share it."""
    alike = stored(rows.groupBy("t1").agg(F.min("t2").alias("a"), F.max("t2").alias("b")).filter("a <> b").select("t1"), keep="alike")
    n = alike.count()
    if n > ALIKE:
        raise ValueError(f"{n} hashes are shared by different texts")
    if not n:
        discard(alike)
        return rows.withColumn("key", F.col("t1"))
    # broadcast: at most ALIKE numbers
    marked = rows.join(F.broadcast(alike.withColumn("_a", F.lit(True))), "t1", "left")
    return marked.withColumn("key", F.when(F.col("_a"), F.xxhash64(F.lit(11), "t1", "t2")).otherwise(F.col("t1"))).drop("_a")


def _repeats(rows: DataFrame, length: int, gram: int, shard_bytes: int) -> DataFrame:
    """``t1, t2, start, until``: stretches of first copies that repeated strings cover (several may overlap)."""
    rows = _keyed(rows)
    marks, shared = _shared(rows.select("o", "key", F.col("text").cast("binary").alias("part")), length, gram)
    # copies of a text become one before they are shuffled
    firsts = rows.groupBy("key").agg(F.min(F.struct("o", "t1", "t2", "text")).alias("first"))
    ready = firsts.join(marks, "key").select("first.o", "first.t1", "first.t2", F.lit(0).cast("long").alias("start"), F.col("first.text").cast("binary").alias("part"), "marks")
    parts = stored(_parts(ready, length, gram), keep="parts")
    discard(shared)
    judged = _judged(parts, length, shard_bytes)
    found = judged.filter("settled")
    rest = judged.filter("not settled").withColumn("key", F.xxhash64("t1", "t2", "start", "until"))
    if not rest.isEmpty():
        marks, shared = _shared(rest, length, gram)
        parts = stored(_parts(rest.join(marks, "key"), length, gram), keep="parts")
        discard(shared)
        judged = _judged(parts, length, shard_bytes)
        late = judged.filter("not settled")
        # at most one place of a string for each shard of the second round is left
        strings = late.agg(F.sum(F.col("until") - F.col("start") - length + 1)).first()[0] or 0
        names = _named(late, length).withColumn("bucket", F.pmod("w1", F.lit(max(1, strings // NAMES))))
        late = names.groupBy("bucket").applyInPandas(_settle, "t1 long, t2 long, start long, until long")
        found = found.select("t1", "t2", "start", "until").union(judged.filter("settled").select("t1", "t2", "start", "until")).union(late)
    return found.select("t1", "t2", "start", "until")


def remove_repeats(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (the remaining bytes), and the columns of ``carry``, for every row.

    With ``as_text``, ``kept`` is a string: code points of which a byte was removed are gone.
    """
    if not 8 <= gram < length:
        raise ValueError("gram must be shorter than length")
    rows = _identified(docs, text, doc_id)
    if {*carry} & {"doc_id", "n_bytes", "n_removed", "n_spans", "kept"}:
        raise ValueError("a carried column has the name of a result")
    spans = _repeats(rows, length, gram, shard_bytes).groupBy("t1", "t2").agg(F.sort_array(F.collect_set(F.struct("start", "until"))).alias("spans"))  # of one text
    firsts = rows.groupBy("t1", "t2").agg(F.min("o").alias("first"))
    facts = stored(firsts.join(spans, ["t1", "t2"], "left"), keep="facts")  # apart from the rows, so that the join can split a text with many copies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, t, begins, untils, copy in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "begins", "untils", "copy"))):
                raw = t.encode()
                if copy:
                    out.append((key, len(raw), len(raw), 1, b"") if len(raw) >= length else (key, len(raw), 0, 0, raw))
                    continue
                begin, end = merged(np.array(begins or [], np.int64), np.array(untils or [], np.int64))
                edges = [0, *np.stack([begin, end], 1).ravel().tolist(), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((key, len(raw), len(raw) - len(kept), len(begin), kept))
            cols = list(zip(*out)) if out else [[]] * 5
            if as_text:
                cols[4] = [k.decode(errors="ignore") for k in cols[4]]
            kinds = (pa.int64(),) * 4 + (pa.string() if as_text else pa.binary(),)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds)), *(batch.column(f"x_{c}") for c in carry)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *carry])

    whole = _identified(docs, text, doc_id, carry)
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    joined = whole.join(facts, ["t1", "t2"]).select(*(f"x_{c}" for c in carry), "doc_id", "text", F.col("spans.start").alias("begins"), F.col("spans.until").alias("untils"), (F.col("o") > F.col("first")).alias("copy"))
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept " + ("string" if as_text else "binary") + kinds)


#: The result of ``op10`` in DuckDB's SQL, on the hexadecimal digits of the bytes.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(doc_id, {LAST}) AS o, hex(coalesce(text, '')) AS h FROM documents),
t AS (SELECT o, md5(h) AS m, any_value(h) AS h FROM d GROUP BY o, md5(h)),
win AS (SELECT o, m, p, md5(substr(h, CAST(2 * p + 1 AS INTEGER), {2 * LENGTH})) AS k FROM (SELECT o, m, h, unnest(range(0, len(h) // 2 - {LENGTH - 1})) AS p FROM t WHERE len(h) >= {2 * LENGTH})),
late AS (SELECT o, m, p FROM (SELECT o, m, p, row_number() OVER (PARTITION BY k ORDER BY o, m, p) AS r FROM win) WHERE r > 1),
step AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY o, m ORDER BY p) <= {LENGTH} THEN 0 ELSE 1 END AS new FROM late),
isle AS (SELECT o, m, min(p) AS a, max(p) + {LENGTH} AS b FROM (SELECT *, sum(new) OVER (PARTITION BY o, m ORDER BY p) AS i FROM step) GROUP BY o, m, i),
gap AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY o, m ORDER BY a), 0) AS before FROM isle),
cut AS (SELECT gap.o, gap.m, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, CAST(2 * before + 1 AS INTEGER), CAST(2 * (a - before) AS INTEGER)), '' ORDER BY a) AS head, max(b) AS last FROM gap JOIN t ON t.o = gap.o AND t.m = gap.m GROUP BY gap.o, gap.m)
SELECT d.doc_id, len(d.h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN cut.m IS NULL THEN d.h ELSE head || substr(d.h, CAST(2 * last + 1 AS INTEGER)) END)) AS kept_sha256
FROM d LEFT JOIN cut ON cut.o = d.o AND cut.m = md5(d.h)
"""
