"""Each text operator against a brute-force version, on rows with nulls, empty and long texts, repeats, and clashing extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("sparkloom.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

from sparkloom.llm import bpe, byte_bpe, components, line_dedup, minhash, packing, quality, sharding, spotsigs, stages, suffix, suffix_dedup, topk, url_filter  # noqa: E402

rng = random.Random(7)
WORDS = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(200)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


BASE = prose(120)


def edited(text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


DOCS = [(i, prose(rng.randint(1, 80))) for i in range(20)] + [(20 + i, edited(BASE, k)) for i, k in enumerate((0, 0, 1, 2, 3, 5, 9, 14))]
DOCS += [(40, None), (41, ""), (42, " \n\t "), (43, "one"), (44, "a b c d"), (45, "A B c D"), (None, prose(50)), (None, DOCS[3][1]), (2, DOCS[2][1]), (46, "x" * 3000), (47, BASE + " " + prose(5) + "\n" + BASE), (48, "it's we'll  end\n\n  "), (49, "漢字😀 　é1٣½")]
SCHEMA = "doc_id long, text string, n_shingles string, size string, score string, ids string, shard int"
EMPTY = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*d, "x", "y", "z", "w", 1) for d in DOCS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], EMPTY)


def keyed(rows):
    return sorted(rows, key=repr)


def test_pre_tokens_match_the_libraries():
    import tiktoken
    from tokenizers import Tokenizer

    letters = "ab'stmdrelv  \n\t\r 　é1٣½,.!?漢😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(2000)] + [d[1] or "" for d in DOCS]
    import pyarrow as pa

    from sparkloom.llm.common import text_bytes

    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    two = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(path), special_tokens={})
    for own, ids_of in ((bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json")), lambda t: one.encode(t, add_special_tokens=False).ids), (bpe.Encoder(path), two.encode_ordinary)):
        ids, at = own.encode_texts(*text_bytes(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [ids_of(t) for t in texts]


def test_packing(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = bpe.Encoder(path)
    rows = packing.pack(docs, path, largest=16).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 16 and 1 << r.bucket == r.length for r in rows)
    got, whole = {}, []
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.start, packing.unpack_ids(r.ids), r.doc_tokens))
    import pyarrow as pa

    from sparkloom.llm.common import text_bytes

    expected = {}
    for d, t in DOCS:
        ids, _ = own.encode_texts(*text_bytes(pa.array([t or ""])))
        expected.setdefault(d, []).append([*ids.tolist(), 1])
    for d, lists in expected.items():
        assert sum(len(p[1]) for p in got[d]) == sum(map(len, lists))
        if len(lists) == 1:
            parts = sorted(got[d])
            whole = [i for p in parts for i in p[1]]
            assert whole == lists[0] and all(p[2] == len(whole) for p in parts) and [p[0] for p in parts] == np.cumsum([0, *(len(p[1]) for p in parts[:-1])]).tolist()
            assert len(parts) == len(whole) // 16 + bin(len(whole) % 16).count("1")
    assert packing.pack(none, path).count() == 0
    with pytest.raises(ValueError):
        packing.pack(none, path, largest=12)


def test_byte_bpe_chunks_give_the_whole_text(docs, none):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    import tiktoken

    two = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(path), special_tokens={})
    expected = []
    for d, t in DOCS:
        ids = two.encode_ordinary(t or "")
        expected.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    for chunk, overlap in ((32_768, 1024), (40, 10)):
        got = byte_bpe.encode(docs, path, chunk=chunk, overlap=overlap, digest=True).collect()
        assert keyed(map(tuple, got)) == keyed(expected)
    plain = byte_bpe.encode(docs.filter("doc_id = 47"), path, chunk=64, overlap=16).first()
    assert plain.decoded.decode() == DOCS[-3][1] and plain.n_tokens * 4 == len(plain.ids)
    assert byte_bpe.encode(none, path, digest=True).count() == 0


def test_sharding(spark, docs, none):
    rows = sharding.assign(docs, nodes=16).collect()
    assert keyed((r.doc_id, r.size, r.text_crc32) for r in rows) == keyed((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in DOCS)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    hot = spark.range(9001).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    n = [r["count"] for r in sharding.assign(hot, nodes=16).groupBy("shard").count().collect()]
    assert sum(n) == 9001 and max(n) - min(n) <= 1
    assert keyed(map(tuple, sharding.assign(docs.repartition(5), nodes=16).collect())) == keyed(map(tuple, rows))
    assert sharding.assign(none, nodes=16).count() == 0


def test_field_gradient_and_marginals():
    g = np.random.default_rng(0)
    x, at, y = g.normal(size=(12, 3)), np.array([0, 5, 6, 12]), np.array([1, 0, 1])
    field = quality.Field(g.normal(size=3), g.normal(size=(2, 2)))
    good, _, logs = field.marginals(x, at)
    import itertools

    total, expect = 0.0, np.zeros(12)
    for a, b in zip(at, at[1:]):
        z, hold = 0.0, np.zeros(b - a)
        for path in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(s * (x[a + i] @ field.weights) for i, s in enumerate(path)) + sum(field.moves[p, q] for p, q in zip(path, path[1:])))
            z += w
            hold += w * np.array(path)
        expect[a:b] = hold / z
        total += np.log(z)
    assert np.allclose(good, expect) and np.isclose(logs, total)
    fitted = quality.fit(np.vstack([np.repeat([[1.0, 1.0]], 20, 0), np.repeat([[-1.0, 1.0]], 20, 0)]), np.arange(0, 41, 4), np.array([1] * 5 + [0] * 5))
    assert fitted.marginals(np.array([[1.0, 1.0], [-1.0, 1.0]]), np.array([0, 1, 2]))[0].round().tolist() == [1.0, 0.0]
    assert y.sum() == 2


def test_quality(spark, none):
    good = [(i, "\n".join(prose(rng.randint(5, 12)).capitalize() + "." for _ in range(6))) for i in range(80)]
    bad = [(100 + i, "\n".join(" ".join(w.upper() + "!!" for w in prose(9).split()) for _ in range(5))) for i in range(40)]
    d = spark.createDataFrame([*good, *bad, (500, None), (501, ""), (None, "x\n\ny")], EMPTY)
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:60]] + [(i, 0) for i, _ in bad[:30]] + [(None, 1), (3, None), (0, 1)], "doc_id long, quality int")
    field = quality.learn(d, labels)
    got = {r.doc_id: r.score for r in quality.scores(d, field).collect()}
    assert len(got) == 123 and min(got[i] for i, _ in good[60:]) > max(got[i] for i, _ in bad[30:]) and all(0 <= s <= 1 for s in got.values()) and got[500] == got[501]
    assert {r.score for r in quality.scores(d, quality.learn(d, labels.limit(0))).collect()} == {0.5}
    assert quality.scores(none, field).count() == 0


def test_quality_sample_has_one_row_a_document_and_skips_long_ones(spark, monkeypatch):
    rows = [(i, "Short lines of prose.\nMore of them." if i % 2 else "!!! ### $$$\n@@@ %%%") for i in range(10)] + [(i, "\n" * 90) for i in range(100, 140)]
    rows += [(1, f"Other text {i}.\nOf one document.") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 2)) for i, _ in rows[:50]], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda f, at, y: seen.append((f.tolist(), at.tolist(), y.tolist())) or quality.Field(np.zeros(f.shape[1]), np.zeros((2, 2))))
    for order in (rows, rows[::-1]):
        quality.learn(spark.createDataFrame(order, EMPTY), labels, sample=10)
    assert seen[0] == seen[1] and seen[0][1] == list(range(0, 21, 2)) and seen[0][2] == [0, 1] * 5


def test_line_dedup(spark, docs, none):
    rows = [(i, f"User {i} logged in from host\n{prose(9)}\nplain line here {rng.choice(WORDS)}") for i in range(30)] + [(50, "User 77 logged in from host"), (50, "User 77 logged in from host"), (51, None), (52, ""), (None, "User 9 logged in from host\nkept"), (53, "a b")]
    d = spark.createDataFrame([(*r, "e", 5) for r in rows], "doc_id long, text string, n_lines string, m int")
    got = {}
    for r in line_dedup.drop_recurring(d, min_docs=5).collect():
        got.setdefault(r.doc_id, []).append((r.text, r.n_lines, r.n_dropped, r.m))
    assert got[0][0][0].startswith("User 0") and got[0][0][2] == 0
    assert all(not got[i][0][0].startswith("User") and got[i][0][2] == 1 and got[i][0][1] == 3 for i in range(1, 30))
    assert got[50] == [("", 1, 1, 5)] * 2 and got[51] == [(None, 0, 0, 5)] and got[52] == [("", 1, 0, 5)] and got[None] == [("kept", 2, 1, 5)] and got[53][0][0] == "a b"
    assert line_dedup.drop_recurring(none).count() == 0 and line_dedup.drop_recurring(docs).count() == len(DOCS)


def brute_components(docs, size=5):
    split = re.compile(rb"[^\x20\x09-\x0D]+")
    sets = {}
    for d, t in docs:
        if d is None:
            continue
        w = split.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    top = {d: d for d in sets}
    find = lambda x: x if top[x] == x else find(top[x])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_minhash(docs, none):
    rows = minhash.near_duplicates(docs).collect()
    want = brute_components(DOCS)
    assert len(rows) == len(DOCS) and sum(v[1] != d for d, v in want.items()) >= 4
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    assert minhash.near_duplicates(none).count() == 0


def one_bucket(seed, *parts):
    """Texts of runs of (vocabulary, words), all in one bucket of a single table of two minhashes."""
    import pyarrow as pa

    seeds = np.random.default_rng(77).integers(0, 1 << 63, 2, dtype=np.uint64)
    for t in range(seed, seed + 5000):
        texts = [" ".join(f"{seed}{v}{t}w{i}" for v, a, b in runs for i in range(a, b)) for runs in parts]
        values, at = minhash.sets_of(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), 5)
        if (np.diff(minhash.minima(values, at, seeds).astype(np.int64), axis=0) == 0).all():
            return texts
    raise AssertionError("no such texts")


def judged_as_brute_force(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(docs, EMPTY), width=1, halves=1).collect()}
    assert got == brute_components(docs)
    return {d: v[1] for d, v in got.items()}


def test_minhash_smaller_document_of_other_size(spark):
    shared = ("p", 0, 100)
    texts = one_bucket(1, (shared, ("e", 0, 60)), (shared, ("c", 0, 8)), (shared, ("d", 0, 8)))
    assert judged_as_brute_force(spark, list(enumerate(texts, 1))) == {1: 1, 2: 2, 3: 2}


def test_minhash_pair_behind_unlike_documents(spark):
    shared = ("p", 0, 100)
    texts = one_bucket(2, (shared, ("e", 0, 45)), (shared, ("f", 0, 45)), (shared, ("c", 0, 8)), (shared, ("d", 0, 8)))
    assert judged_as_brute_force(spark, list(enumerate(texts, 1))) == {1: 1, 2: 2, 3: 3, 4: 3}


def test_minhash_chain_in_one_bucket(spark):
    shared = ("p", 0, 100)
    texts = one_bucket(4, (("x", 0, 20), shared), (shared,), (shared, ("y", 0, 20)))
    assert judged_as_brute_force(spark, list(enumerate(texts, 1))) == {1: 1, 2: 1, 3: 1}


@pytest.mark.parametrize("stars", [0, 2])
def test_minhash_family_behind_a_passage(spark, monkeypatch, stars):
    monkeypatch.setattr(minhash, "STARS", stars)
    monkeypatch.setattr(minhash, "PART", 3)
    shared = ("p", 0, 100)
    runs = [(shared, (f"e{i}", 0, 45)) for i in range(3)] + [(shared, (f"c{i}", 0, 8)) for i in range(6)] + [(shared, ("g", 0, 30), (f"g{i}", 0, 16)) for i in range(3)]
    got = judged_as_brute_force(spark, list(enumerate(one_bucket(5, *runs), 1)))
    assert all(got[d] == 4 for d in range(4, 10))


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (95, 100)], "u long, v long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
    assert components.components(links.limit(0)).count() == 0


def test_spotsigs(spark, docs, none):
    rows = spotsigs.against_edited(docs).collect()
    assert len(rows) == len(DOCS) and spotsigs.against_edited(none).count() == 0
    named = [(d, t or "") for d, t in DOCS if d is not None and d != 2]
    texts = {d: t for d, t in DOCS if d is not None}
    ids = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in rows}
    for d, t in named:
        r = got[d]
        assert r.n_chars == len(t) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        k = ids.index(d)
        if k + 1 < len(ids):
            x, n = texts[ids[k + 1]] or "", len(t) // 3
            assert r.edited_sha256 == hashlib.sha256((t[: len(t) - n] + x[:n]).encode()).hexdigest()
    assert got[20].fingerprint == got[21].fingerprint and got[41].fingerprint == "" and got[43].fingerprint != ""
    small = docs.filter("doc_id between 20 and 27")
    prints = spotsigs.fingerprints(small)
    sets = {r.doc_id: set(r.signatures) for r in prints.collect()}
    pairs = {(r.a, r.b) for r in spotsigs.near_pairs(prints, 0.5).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] != sets[b] and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    assert {p for p in want if 21 not in p} == pairs


def test_suffix_array():
    g = np.random.default_rng(0)
    for t in range(60):
        n = g.integers(1, 300)
        d = (g.integers(0, 3, n) if t % 2 else np.tile(g.integers(0, 3, g.integers(1, 90)), 300)[:n]).astype(np.uint8) + 97
        b = d.tobytes()
        order = suffix.suffix_array(d, 100)
        assert [b[i : i + 100] for i in order] == sorted(b[i : i + 100] for i in range(n))
        shared = suffix.common_prefixes(d, order, 100)
        for k in range(1, n):
            x, y = b[order[k] :], b[order[k - 1] :]
            assert shared[k] == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q or i == 100), min(len(x), len(y), 100))


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for d, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if (w := b[i : i + length]) in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, r in zip(b, gone) if not r)
        out[d] = (len(b), sum(gone), sum(bool(r) and (i == 0 or not gone[i - 1]) for i, r in enumerate(gone)), kept)
    return out


@pytest.mark.parametrize("shard_bytes", [suffix_dedup.SHARD_BYTES, 600])
def test_suffix_dedup(docs, none, shard_bytes):
    got = {}
    for r in suffix_dedup.remove_repeats(docs, shard_bytes=shard_bytes).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)))
    want = brute_repeats(sorted({d: t or "" for d, t in DOCS if d is not None}.items()))
    assert got[2] == [want[2]] * 2 and len(got[None]) == 2 and got[46][0][1] == 2900 + 99 and got[47][0][1] > 200
    assert {d: v[0] for d, v in got.items() if d is not None} == want
    if shard_bytes == 600:
        assert suffix_dedup.remove_repeats(none).count() == 0
        carried = suffix_dedup.remove_repeats(docs, carry=("size",), as_text=True)
        assert {r["size"] for r in carried.collect()} == {"y"} and dict(carried.dtypes)["kept"] == "string"


def test_topk(spark):
    g = np.random.default_rng(1)
    rows = [(i, [float(x) for x in g.normal(0, 0.2, 8)]) for i in range(300)]
    rows[40] = (40, rows[20][1])
    rows += [(7, rows[7][1]), (20, rows[20][1]), (900, None), (901, [0.1, None] + [0.0] * 6), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (None, rows[1][1]), (905, [])]
    d = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    v = [(i, np.floor(64 * np.array(e, np.float32).astype(float)).astype(int)) for i, e in rows[:302]]
    for shard, block in ((8192, 256), (50, 4)):
        got = {}
        for r in topk.search(d, F.col("vec_id") % 20 == 0, k=5, shard=shard, block=block).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert sorted(got) == list(range(0, 300, 20))
        for q, found in got.items():
            own = next(x for i, x in v if i == q)
            best = sorted((-int(own @ x), i) for i, x in v if i != q)[:5]
            assert sorted(found) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert topk.search(d.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_url_filter(spark):
    import datetime as dt

    day = lambda n: dt.date(2024, 1, n)
    log = [("Bad.org", "spam", "add", day(5)), ("bad.org", "spam", "add", day(5)), ("bad.org", "spam", "remove", day(10)), ("bad.org", "spam", "add", day(10)), ("bad.org", "spam", "remove", day(20)), ("x.bad.org", "adult", "add", day(7)), (None, "spam", "add", day(1)), ("bad.org", "spam", "noop", day(1)), ("c.com", None, "add", day(1))]
    entries = spark.createDataFrame(log, "domain string, category string, action string, day date")
    pages = [("http://bad.org/a", 4), ("http://bad.org:80/a", 5), ("https://u@y.bad.org/", 19), ("http://bad.org", 20), ("http://x.bad.org/", 8), ("http://notbad.org", 8), (None, 8), ("nonsense", 8), ("http://c.com", None), ("HTTP://C.COM/q", 2)]
    d = spark.createDataFrame([(u, n and dt.datetime(2024, 1, n, 12), "old") for u, n in pages], "url string, fetched timestamp, category string")
    got = [(r.url, r.blocked, r.blocked_by, r.category) for r in url_filter.evaluate(d, entries).collect()]
    want = [("http://bad.org/a", False, None, None), ("http://bad.org:80/a", True, "bad.org", "spam"), ("https://u@y.bad.org/", True, "bad.org", "spam"), ("http://bad.org", False, None, None), ("http://x.bad.org/", True, "x.bad.org", "adult"), ("http://notbad.org", False, None, None), (None, False, None, None), ("nonsense", False, None, None), ("http://c.com", False, None, None), ("HTTP://C.COM/q", True, "c.com", "")]
    assert keyed(got) == keyed(want)
    assert url_filter.evaluate(d.limit(0), entries).count() == 0 and not any(r.blocked for r in url_filter.evaluate(d, entries.limit(0)).collect())


def test_stages_keep_the_columns(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(d, t, "en", "s", len(t or "")) for d, t in DOCS]
    spark.createDataFrame([(i, 1) for i in range(10)] + [(41, 0), (46, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, kinds)
    assert stages.good_documents(spark, docs, str(tmp_path)).dtypes == docs.dtypes
    near = stages.one_of_near_duplicates(spark, docs, "")
    tops = {r[1] for r in brute_components(DOCS).values()}
    assert near.dtypes == docs.dtypes and keyed(r.doc_id for r in near.collect()) == keyed([*tops, None, None])
    cut = stages.without_repeats(spark, docs, "")
    assert cut.dtypes == docs.dtypes and all(r.n_chars == len(r.text) for r in cut.collect()) and cut.count() == len(DOCS)
    lines = stages.without_recurring_lines(spark, docs, "")
    assert lines.dtypes == docs.dtypes and lines.count() == len(DOCS)
    assert stages.packed(spark, docs.limit(0), "").count() == 0


def test_stages_keep_columns_named_like_the_operators(spark, tmp_path):
    names = ["score", "kept", "n_bytes", "n_removed", "n_spans", "n_lines", "n_dropped"]
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(i, f"text number {i}", *(f"{c}{i}" for c in names)) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    for stage in (stages.good_documents, stages.without_recurring_lines, stages.without_repeats):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and keyed(map(tuple, out.collect())) == keyed(rows)
