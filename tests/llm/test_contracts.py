"""Operators and the pipeline against plain versions, row by row, and the edges of their contracts."""

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("sparkloom.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from sparkloom.llm import bpe, byte_bpe, common, line_dedup, minhash, packing, quality, sharding, spotsigs, stages, suffix_dedup, topk, url_filter, words  # noqa: E402
from test_operators import DOCS, EMPTY, brute_components, brute_repeats, keyed, prose  # noqa: E402

rng = random.Random(11)


def test_hashes_do_not_depend_on_windows(monkeypatch):
    g = np.random.default_rng(1)
    data = g.choice(np.frombuffer(b"abcdefgh \n", np.uint8), 5000)
    data[1000:3500] = 97
    at = np.array([0, 5, 5, 900, 4000, 5000])
    once, run = words.words(data, at), words.run_hashes(data, 32)
    grams = suffix_dedup.chosen_grams(data, at, 100, 32)
    words.powers.cache_clear()
    monkeypatch.setattr(words, "WINDOW", 300)
    for a, b in zip([*once, run, *grams], [*words.words(data, at), words.run_hashes(data, 32), *suffix_dedup.chosen_grams(data, at, 100, 32, step=170)]):
        assert np.array_equal(a, b)
    words.powers.cache_clear()


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)


def test_discarded_tables_are_gone(spark):
    df = common.stored(spark.range(3))
    assert df.count() == 3 and os.path.exists(df.inputFiles()[0][7:])
    path = df.inputFiles()[0][7:]
    common.discard(df)
    assert not os.path.exists(path)


def test_added_tokens_as_the_library_takes_them(spark):
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["hello <|endoftext|> world", "<|endoftext|><|endoftext|>", "a<|endof", "text|>b", "x<|endoftext|>'s", "é<|endoftext|>1<|endoftext", ""]
    texts += ["".join(rng.choice(["<|endoftext|>", "<|endof", "text|>", " ", "a", "'s", "1", "\n", "é", "😀"]) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    own = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids, at = own.encode_texts(*common.text_bytes(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [e.ids for e in one.encode_batch(texts, add_special_tokens=False)]
    got = packing.pack(spark.createDataFrame([(1, texts[0])], EMPTY), public_tokenizers.path("byte_bpe_50k.json")).orderBy("start").collect()
    assert [i for r in got for i in packing.unpack_ids(r.ids)] == [31373, 220, 50256, 995, packing.END_TOKEN]


def test_one_long_pre_token_is_stitched_in_linear_time():
    seen = []

    def count(chunk, last, real=byte_bpe.sure_boundaries):
        seen.append(len(chunk))
        return real(chunk, last)

    for n in (32, 128):
        seen.clear()
        chunks = [b"x" * 1100] * (n - 1) + [b"x" * 1000]
        keep, byte_bpe.sure_boundaries = byte_bpe.sure_boundaries, count
        try:
            parts = byte_bpe.stitch(chunks, [keep(c, k == n - 1) for k, c in enumerate(chunks)], [1000] * n)
        finally:
            byte_bpe.sure_boundaries = keep
        assert b"".join(parts) == b"x" * (1000 * n) and sum(seen) < 3 * 1000 * n


def ring_by_rows(rows, shards, nodes):
    """The bounded ring row by row: each step's offers in ring order, each row in the order of its place."""
    place = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    ring = sorted((place(f"shard {s} node {k}"), s) for s in range(shards) for k in range(nodes))
    arcs = {}
    for r in rows:
        p = place(" ".join("null" if x is None else str(x) for x in r))
        arcs.setdefault(sum(q < p for q, _ in ring), []).append((p, r[0] is not None, r[0] or 0, r[1], r[2], r))
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    used, out = [0] * shards, []
    for a in arcs:
        arcs[a].sort()
    for step in range(shards):
        for a in sorted(arcs):
            order = list(dict.fromkeys(s for _, s in [*ring[a:], *ring[:a]]))
            s = order[step]
            while arcs[a] and used[s] < room[s]:
                out.append((*arcs[a].pop(0)[-1], s, used[s]))
                used[s] += 1
    return out


def test_sharding_replays_the_ring(spark):
    rows = DOCS + [(7, "same")] * 9
    got = sharding.assign(spark.createDataFrame(rows, EMPTY).repartition(3), nodes=16).collect()
    plain = [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows]
    assert keyed(map(tuple, got)) == keyed(ring_by_rows(plain, 8, 16))


def features_of(text):
    kind = lambda b: [65 <= b <= 90, 97 <= b <= 122, 48 <= b <= 57, b < 128 and chr(b).isspace(), b == 33, b == 124, chr(b) in "#$%&*@^~=<>{}[]\\/_+" and b < 128, chr(b) in ".,;:?'\"()-" and b < 128, b >= 128]
    lines = text.encode().split(b"\n")
    lines = [*(x + b"\n" for x in lines[:-1]), lines[-1]]  # a line holds its break
    frequent, seen, own = set(quality.FREQUENT.split()), set(), []
    for line in lines:
        w = re.findall(rb"[^\x20\x09-\x0D]+", line)
        n, size = len(w), len(line)
        share = lambda x: x / max(n, 1)
        again = tuple(w) in seen and size > 8
        seen.add(tuple(w))
        row = [sum(kind(b)[k] for b in line) / max(size, 1) for k in range(9)]
        row += [math.log1p(size) / 8, min(size / max(n, 1) / 10, 3), share(sum(a == b for a, b in zip(w, w[1:]))), share(sum(x.lower().decode() in frequent for x in w)), again, share(len(set(w))), size == 0, min(n, 40) / 40, math.log1p(len(lines)) / 8]
        own.append([float(x) for x in row])
    none = [0.0] * quality.N_OWN
    return [[*own[i], *(own[i - 1] if i else none), *(own[i + 1] if i + 1 < len(own) else none), float(i == 0), float(i + 1 == len(own)), 1.0] for i in range(len(own))], [len(x) for x in lines]


def test_line_features_and_score_by_plain_loops():
    texts = ["", "\n", "The end of it.\nthe the END!!! | 12 é\n\nThe end of it.", "one", "a b a\n" * 3, "long " * 2000, "\n\nx\t y\n", *(t or "" for _, t in DOCS[:12])]
    data, offsets = common.text_bytes(pa.array(texts))
    features, at, size = quality.line_features(data, offsets)
    g = np.random.default_rng(2)
    field = quality.Field(g.normal(size=features.shape[1]), g.normal(size=(2, 2)), 1.7, -0.2)
    scores = field.scores(features, at, size)
    for k, t in enumerate(texts):
        rows, sizes = features_of(t)
        assert np.allclose(features[at[k] : at[k + 1]], rows, atol=1e-5) and size[at[k] : at[k + 1]].tolist() == sizes
        x = np.array(rows) @ field.weights
        forward = np.zeros((len(x), 2))
        for i, s in enumerate(np.clip(x, -30, 30)):
            a = np.array([0.0, 0.0]) if i == 0 else np.logaddexp.reduce(forward[i - 1][:, None] + field.moves, axis=0)
            forward[i] = a + [0, s]
        back = np.zeros((len(x), 2))
        for i in range(len(x) - 2, -1, -1):
            back[i] = np.logaddexp.reduce(field.moves + back[i + 1] + [0, np.clip(x[i + 1], -30, 30)], axis=1)
        both = forward + back
        good = 1 / (1 + np.exp(both[:, 0] - both[:, 1]))
        weight = np.array(sizes) + 1.0
        mean = min(max((good * weight).sum() / weight.sum(), 1e-9), 1 - 1e-9)
        assert abs(scores[k] - 1 / (1 + math.exp(-(1.7 * math.log(mean / (1 - mean)) - 0.2)))) < 1e-4


def signatures_of(text):
    w = re.findall(rb"[A-Za-z0-9\x80-\xff]+", text.encode())
    w = [bytes(b + 32 if 65 <= b <= 90 else b for b in x) for x in w]
    anchors = {a.encode() for a in spotsigs.ANCHORS.split()}
    found = set()
    for i, x in enumerate(w):
        if x in anchors:
            chain = [y for y in w[i + 1 :] if y not in anchors][: spotsigs.CHAIN]
            if len(chain) == spotsigs.CHAIN:
                found.add((x, *chain))
    return found or {tuple(w[i : i + 2]) for i in range(max(len(w) - 1, 1))} if w else set()


def test_spotsigs_by_plain_loops(spark):
    texts = [f"the {prose(30)} of {prose(20)} and {prose(9)} to {prose(3)}" for _ in range(6)]
    rows = DOCS + [(100 + i, t) for i, t in enumerate(texts)] + [(200 + i, texts[0] + " in " + prose(k)) for i, k in enumerate((0, 2, 9))] + [(105, "the other text of one number"), (300, "word the " * 4000)]
    rows += [(150, f"the text {prose(4)}") for _ in range(200)]  # a number that several ranges hold
    docs = spark.createDataFrame(rows, EMPTY).repartition(3)
    order = [(r.doc_id, r.text) for r in docs.withColumn("text", F.coalesce("text", F.lit(""))).orderBy(F.desc_nulls_last("doc_id"), F.xxhash64("text"), F.xxhash64(F.lit(7), "text")).collect()]
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = []
    for (d, t), (_, x) in zip(order, order[1:] + order[:1]):
        n = len(t) // 3
        e = t[: len(t) - n] + x[:n]
        s = signatures_of(t)
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), round(alike(s, signatures_of(e)), 9), round(alike(s, signatures_of(x)), 9)))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in spotsigs.against_edited(docs).collect()]
    assert keyed(got) == keyed(want)


def documents_in_duckdb(rows):
    import duckdb

    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    return con


LINES = [f"User {{}} from host {w} logged in" for w in ("alpha", "beta")] + ["All rights reserved.", "Yes.", "a b c d 1 2 3 4", "Posted by {} today at noon for all", "page {} of 9"]


def line_rows(n=60):
    r = random.Random(5)
    rows = [(i, "\n".join(r.choice([*LINES, "", "  ", prose(8), prose(2)]).format(r.choice("uvwxyz") * 3 if r.random() < 0.7 else r.randint(1, 99)) for _ in range(r.randint(0, 9)))) for i in range(n)]
    return rows + [(3, rows[3][1]), (900, rows[4][1]), (901, None), (902, ""), (None, rows[5][1]), (None, "All rights reserved.\nYes."), (903, "<*> <*> x y\n" * 3), (904, ("Yes.\n" + prose(5) + "\n") * 3000)]


def test_line_dedup_equals_its_sql(spark):
    rows = line_rows()
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text and hashlib.md5(r.text.encode()).hexdigest() or (r.text if r.text is None else hashlib.md5(b"").hexdigest())) for r in line_dedup.drop_recurring(spark.createDataFrame(rows, EMPTY).repartition(4)).collect()]
    want = [tuple(r) for r in documents_in_duckdb(rows).sql(line_dedup.ORACLE).fetchall()]
    assert keyed(got) == keyed(want) and sum(r[2] for r in want) > 100


def test_line_in_a_big_leaf_recurs_at_any_size(spark):
    for n in (40, 400):  # the same line among few and many lines of its leaf
        rows = [(i, f"On {i} May the {prose(3)}") for i in range(n)] + [(10_000 + i, f"own {i}\nOn 5 May the board met here") for i in range(6)]
        cut = {r.doc_id: r.n_dropped for r in line_dedup.drop_recurring(spark.createDataFrame(rows, EMPTY)).collect()}
        assert [cut[10_000 + i] for i in range(6)] == [0, 1, 1, 1, 1, 1] and not any(cut[i] for i in range(n))


def test_topk_of_large_components(spark):
    v = {0: [5e8, 0.0], 20: [1.0, 2.0], 1: [1e15, -3.0], 2: [0.5, 0.25], 3: [-5e8, 1.0], 4: [3.0, 3.0], 5: [1e300, 0.0], 6: [-1e300, 0.0]}
    d = spark.createDataFrame([(i, x) for i, x in v.items()], "vec_id long, embedding array<double>")
    whole = {i: [math.floor(64 * y) if abs(y) < 1e17 else int(64 * y) for y in x] for i, x in v.items()}
    for shard in (8192, 2):
        got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(d, F.col("vec_id") % 20 == 0, shard=shard).collect()]
        want = []
        for q in (0, 20):
            scores = sorted((-min(max(sum(a * b for a, b in zip(whole[q], x)), -(1 << 63)), (1 << 63) - 1), i) for i, x in whole.items() if i != q)
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
        assert sorted(got) == want


def test_topk_ranks_each_vector_of_an_id(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [2.0, 1.0]), *[(2, [1.0, 1.0])] * 50, (3, [1.0])], "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id, r.score) for r in topk.search(d, F.col("vec_id") % 20 == 0, k=3).collect())
    assert got == sorted([(1, 1, 8192), (2, 2, 4096), (3, 2, 4096)] + [(1, 1, 4096), (2, 2, 4096), (3, 2, 4096)])


def test_near_duplicates_of_a_repeated_doc_id(spark):
    a, b, c = (prose(40) for _ in range(3))
    rows = [(5, a), (5, b), (7, b), (3, c), (9, a), (9, ""), (11, None), (5, a)]
    got = {(r.doc_id, r.n_shingles > 0): r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, EMPTY)).collect()}
    assert got == {(5, True): 5, (7, True): 5, (9, True): 5, (3, True): 3, (9, False): 9, (11, False): 11}
    docs = spark.createDataFrame([(d, t, f"x{i}") for i, (d, t) in enumerate(rows)], "doc_id long, text string, _text string")
    kept = stages.one_of_near_duplicates(spark, docs, "").collect()
    assert keyed(r.doc_id for r in kept) == keyed([5, 3, 9, 11]) and all((r.doc_id, r.text) in rows and r._text.startswith("x") for r in kept)


def test_bitmaps_bound_the_difference():
    g = np.random.default_rng(4)
    for n in (3, 100, 3000):
        pool = g.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        a, b = np.sort(pool[:n]), np.sort(pool[n // 5 : n + n // 5])
        bits = minhash.bitmaps(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])).view(np.uint64)
        assert sum(int(x).bit_count() for x in bits[0] ^ bits[1]) <= len(np.setxor1d(a, b))


SMALL = "/root/testdata/sf0.01/documents.parquet"


@pytest.mark.skipif(not os.path.exists(SMALL), reason="needs the test tables")
def test_near_duplicates_of_the_test_table(spark):
    docs = spark.read.parquet(SMALL)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_suffix_dedup_deals_a_repeating_text_to_many_shards(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 400)
    monkeypatch.setattr(suffix_dedup, "CUT", 300)
    unit = prose(60)
    rows = [(1, unit * 9), (2, prose(30) + unit[:150] + prose(30)), (3, unit * 3 + "tail"), (4, prose(100)), *[(10 + i, prose(20) + unit[i : i + 130] + prose(9)) for i in range(8)]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, EMPTY), shard_bytes=900).collect()}
    assert got == brute_repeats(rows)


def test_url_filter_keeps_clashing_columns(spark):
    import datetime as dt

    entries = spark.createDataFrame([("bad.org.", "spam", "add", dt.date(2024, 1, 1))], "domain string, category string, action string, day date")
    d = spark.createDataFrame([("http://a.bad.org./x", dt.datetime(2024, 1, 2), "p", "q", "r"), ("http://[::1]:80/", dt.datetime(2024, 1, 2), "p", "q", "r")], "url string, fetched timestamp, d string, _day string, day string")
    got = {r.url: r for r in url_filter.evaluate(d, entries).collect()}
    assert got["http://a.bad.org./x"].blocked_by == "bad.org" and got["http://[::1]:80/"].host == "[::1]" and all((r.d, r._day, r.day) == ("p", "q", "r") for r in got.values())


def test_pipeline_equals_plain_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    base = prose(80)
    good = [(i, "\n".join(prose(rng.randint(6, 12)).capitalize() + "." for _ in range(5)) + "\nAll rights reserved by us today.") for i in range(40)]
    good += [(60 + i, "\n".join([base + ".", prose(4) + f" end {i}."])) for i in range(4)] + [(70, prose(30) + " " + base[:200] + " " + prose(30)), (71, good[3][1]), (3, good[3][1])]
    bad = [(100 + i, "\n".join(" ".join(w.upper() + "!!" for w in prose(9).split()) for _ in range(5))) for i in range(20)]
    rows = [*good, *bad, (500, ""), (501, None)]
    spark.createDataFrame([(d, t, f"e{d}") for d, t in rows], "doc_id long, text string, kept string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1) for d, _ in good] + [(d, 0) for d, _ in bad], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = [tuple(r)[:5] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]

    docs = spark.createDataFrame(rows, EMPTY)
    stayed = [(r.doc_id, r.text) for r in stages.good_documents(spark, docs, str(tmp_path)).collect()]
    assert {d for d, _ in good[:40]} | {60, 61, 70, 71} <= {d for d, _ in stayed} and not {d for d, _ in bad} & {d for d, _ in stayed}
    sql = line_dedup.ORACLE.replace("md5(CASE WHEN len(drops)", "(CASE WHEN len(drops)")
    lines = [(d, t) for d, _, _, t in documents_in_duckdb(stayed).sql(sql).fetchall()]
    tops = brute_components(lines)
    once = dict(sorted(((d, t) for d, t in lines if tops[d][1] == d), key=lambda x: (x[0], x[1] or "")))
    cut = {d: r[3].decode(errors="ignore") for d, r in brute_repeats(sorted((d, t or "") for d, t in once.items())).items()}
    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d, t in cut.items():
        ids, start = [*one.encode(t, add_special_tokens=False).ids, packing.END_TOKEN], 0
        whole = len(ids)
        while start < whole:
            n = min(2048, 1 << ((whole - start).bit_length() - 1))
            want.append((d, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()), whole))
            start += n
    assert keyed(got) == keyed(want) and len({d for d, *_ in got}) < len(stayed)
