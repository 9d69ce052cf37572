"""Weights, matching, frames, one-pass curation, epochs and batches against plain versions, with their failures."""

import glob
import json
import math
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import arrays as A
from sparkloom.functions import frames as P
from sparkloom.functions import text as X
from sparkloom.operators import curate as C
from sparkloom.operators import dedup as D
from sparkloom.operators import epochs as E
from sparkloom.operators import matching as G
from sparkloom.operators import models as O
from sparkloom.plans import jobs as J
from sparkloom.sources import containers as B
from sparkloom.sources import frames as R
from sparkloom.sources import tables as L
from sparkloom.sources import tensors as T
from sparkloom.streaming import parts as W

COLUMNS = "name string, dtype string, shape array<bigint>, values array<double>"


@pytest.fixture(scope="module")
def weights(spark):
    T.register(spark)
    rng = random.Random(1)
    rows = [(f"layer.{i:02d}.w", "F32", [3, i], [rng.uniform(-1, 1) for _ in range(3 * i)]) for i in range(12)]
    rows += [("scalar", "F64", [], [math.pi]), ("half", "F16", [4], [0.5, -2.0, math.inf, 0.1]), ("brain", "BF16", [5], [1.0, -3.5, 0.1, math.nan, 1e30]), ("flags", "BOOL", [2], [1.0, 0.0]), ("big", "I64", [2], [2.0**53, -5.0]), ("bytes", "U8", [3], [0.0, 7.0, 255.0]), ("none", "I8", [0], [])]
    return rows


def plain_file(path):
    """The layout read without the library."""
    raw = open(path, "rb").read()
    (n,) = struct.unpack("<Q", raw[:8])
    head = json.loads(raw[8 : 8 + n])
    return {k: (v["dtype"], v["shape"], raw[8 + n + v["data_offsets"][0] : 8 + n + v["data_offsets"][1]]) for k, v in head.items() if k != "__metadata__"}


def test_weights_round_trip(spark, weights, tmp_path):
    path = str(tmp_path / "w")
    spark.createDataFrame(weights, COLUMNS).repartition(3).write.format("tensors").mode("overwrite").save(path)
    files = glob.glob(path + "/*.safetensors")
    assert 1 < len(files) <= 3 and not glob.glob(path + "/_temporary*")
    stored = {k: v for f in files for k, v in plain_file(f).items()}
    assert sorted(stored) == sorted(r[0] for r in weights)
    assert stored["layer.02.w"][2] == np.array(weights[2][3], "<f4").tobytes() and stored["scalar"][1] == []
    index = json.load(open(path + "/" + T.INDEX))
    assert sorted(index["weight_map"]) == sorted(stored) and index["metadata"]["total_size"] == sum(len(v[2]) for v in stored.values())
    for split in (8, 20, 1 << 20):
        back = O.whole_tensors(spark.read.format("tensors").option("split_bytes", split).load(path)).collect()
        for r in back:
            dtype, shape, values = next(w[1:] for w in weights if w[0] == r.name)
            assert (r.dtype, r["shape"]) == (dtype, shape)
            expected = T.decoded(T.encoded(np.array(values), dtype), dtype)
            assert np.array_equal(np.array(r["values"] or []), expected, equal_nan=True), r.name
        assert len(back) == len(weights)
    assert T.decoded(T.encoded(np.array([1.0, 0.1]), "BF16"), "BF16")[1] == pytest.approx(0.1, rel=1 / 256)


def test_weights_are_pruned(spark, weights, tmp_path):
    path = str(tmp_path / "w")
    spark.createDataFrame(weights, COLUMNS).repartition(4, "name").write.format("tensors").mode("overwrite").save(path)
    places = json.load(open(path + "/" + T.INDEX))["weight_map"]
    one = T.TensorReader({"path": path, "names": '["half"]'})
    assert [(p.file.rsplit("/", 1)[-1], [x[0] for x in p.pieces]) for p in one.partitions()] == [(places["half"], ["half"])]
    some = T.TensorReader({"path": path, "prefix": "layer.", "split_bytes": "40"})
    parts = some.partitions()
    assert all(x[0].startswith("layer.") for p in parts for x in p.pieces) and len(parts) > 8
    assert max(sum(x[5] - x[4] for x in p.pieces) for p in parts) <= 40
    read = spark.read.format("tensors").load(path)
    assert {r.name for r in read.filter("name = 'flags'").collect()} == {"flags"}
    assert {r.name for r in read.filter("name in ('flags', 'big') and startswith(name, 'f')").collect()} == {"flags"}
    assert read.filter("name = 'flags'").rdd.getNumPartitions() == 1
    heads = spark.read.format("tensors").option("headers", True).load(path).collect()
    assert {(r.name, r.bytes) for r in heads} == {(w[0], len(T.encoded(np.array(w[3]), w[1]))) for w in weights}


def test_failed_writes_leave_the_old_weights(spark, weights, tmp_path):
    path = str(tmp_path / "w")
    rows = spark.createDataFrame(weights, COLUMNS)
    rows.write.format("tensors").mode("overwrite").save(path)
    before = sorted(os.listdir(path))
    bad = rows.filter("name = 'half'").withColumn("shape", F.array(F.lit(9).cast("long")))
    twice = rows.repartition(2, "name").unionByName(rows.filter("name = 'big'"))
    wrong = rows.filter("name = 'bytes'").withColumn("values", F.array(F.lit(0.0), F.lit(300.0), F.lit(1.0)))
    unnamed = rows.filter("name = 'half'").withColumn("name", F.lit(None).cast("string"))
    for failing, why in ((rows.filter("name <> 'half'").unionByName(bad), "values and the shape"), (twice, "one name|name of its own"), (wrong, "do not fit"), (unnamed, "name of its own")):
        with pytest.raises(Exception, match=why):
            failing.write.format("tensors").mode("overwrite").save(path)
        assert sorted(os.listdir(path)) == before
    with pytest.raises(Exception, match="overwrite"):
        rows.write.format("tensors").mode("append").save(path)
    # leftovers of an attempt that never reported go with the commit
    writer = T.TensorWriter({"path": path}, True)
    batch = rows.filter("name = 'big'").toArrow().to_batches()
    lost, kept = writer.write(iter(batch)), writer.write(iter(batch))
    assert lost.file != kept.file
    writer.commit([kept, None])
    assert len([f for f in os.listdir(path) if f.endswith(".safetensors")]) == 1 and not glob.glob(path + "/_temporary*")
    assert spark.read.format("tensors").load(path).first()["values"] == [2.0**53, -5.0]
    rows.limit(0).write.format("tensors").mode("overwrite").save(path)
    assert spark.read.format("tensors").load(path).count() == 0


def test_damaged_files_are_named(spark, tmp_path):
    def file(name, head, data):
        raw = head if isinstance(head, bytes) else json.dumps(head).encode()
        (tmp_path / name).write_bytes(struct.pack("<Q", len(raw)) + raw + data)
        return str(tmp_path / name)

    good = {"a": {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}}
    files, _ = T.opened(str(tmp_path))
    assert T.header(files, file("good", good, b"12345678"))[0].end == 8 + len(json.dumps(good)) + 8
    for name, head, data in (("short", good, b"1234"), ("long", good, b"123456789"), ("json", b"{no", b""), ("kind", {"a": good["a"] | {"dtype": "X"}}, b"12345678"), ("gap", {"a": good["a"] | {"data_offsets": [4, 12]}}, b"123456789012"), ("shape", {"a": good["a"] | {"shape": [3]}}, b"12345678"), ("list", b"[1]", b"")):
        with pytest.raises(ValueError, match=name):
            T.header(files, file(name, head, data))
    (tmp_path / "tiny").write_bytes(b"123")
    with pytest.raises(ValueError, match="tiny"):
        T.header(files, str(tmp_path / "tiny"))


def test_key_states_and_deltas(spark):
    names = lambda rows: spark.createDataFrame(rows, "name string, shape array<bigint>")
    states = O.key_states(names([("a", [1]), ("b", [2]), ("c", [3]), ("p", [1])]), names([("a", [1]), ("b", [3]), ("x", [1])]), optional=("p",))
    assert {tuple(r) for r in states.collect()} == {("a", "ok"), ("b", "shape"), ("c", "missing"), ("x", "unexpected"), ("p", "optional")}
    with pytest.raises(Exception, match="shape: b|missing: c|unexpected: x"):
        O.demand_keys(states).collect()
    assert O.demand_keys(states.filter("name in ('a', 'p')")).count() == 2
    base = spark.createDataFrame([("a", "F32", [1], [1.0]), ("b", "F32", [2], [1.0, 2.0]), ("c", "F32", [1], [math.nan])], COLUMNS)
    trained = spark.createDataFrame([("a", "F32", [1], [1.5]), ("b", "F32", [2], [1.0, 2.0]), ("c", "F32", [1], [math.nan]), ("d", "F32", [0], [])], COLUMNS)
    assert {r.name for r in O.delta(trained, base).collect()} == {"a", "d"}
    assert {r.name for r in O.delta(trained, base, spark.createDataFrame([("b",), ("b",)], "name string")).collect()} == {"a", "b", "d"}
    over = O.with_delta(base, O.delta(trained.filter("name <> 'd'"), base)).orderBy("name").collect()
    assert [(r.name, r["values"][0]) for r in over][:2] == [("a", 1.5), ("b", 1.0)] and len(over) == 3
    with pytest.raises(Exception, match="unexpected: d"):
        O.with_delta(base, O.delta(trained, base)).collect()


# matching


def plain_f1(cand, ref, idf, vec, baseline):
    c, r = [w for w in cand if w in vec], [w for w in ref if w in vec]
    cos = lambda a, b: float(np.dot(vec[a], vec[b]) / (np.linalg.norm(vec[a]) * np.linalg.norm(vec[b]))) if np.linalg.norm(vec[a]) * np.linalg.norm(vec[b]) > 0 else 0.0
    wc, wr = sum(idf.get(w, 9.0) for w in c), sum(idf.get(w, 9.0) for w in r)
    if wc <= 0 or wr <= 0:
        return 0.0
    p = sum(idf.get(w, 9.0) * max(cos(w, x) for x in r) for w in c) / wc
    q = sum(idf.get(w, 9.0) * max(cos(w, x) for x in c) for w in r) / wr
    return ((2 * p * q / (p + q) if p + q else 0.0) - baseline) / (1 - baseline)


def test_greedy_matching_equals_plain_version(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    vec = {w: np.array([rng.gauss(0, 1) for _ in range(6)], np.float32) for w in words[:35]} | {"zero": np.zeros(6, np.float32)}
    text = lambda n: [rng.choice([*words, "zero", "unknown"]) for _ in range(n)]
    items = [(k, text(rng.randint(0, 12))) for k in range(40)] + [(90, []), (91, ["zero", "zero"]), (92, ["unknown"]), (93, ["w1"])]
    refs = [(k, j, text(rng.randint(0, 15))) for k, _ in items[:-1] for j in range(rng.randint(0, 5))]
    i = spark.createDataFrame(items, "id long, w array<string>")
    r = spark.createDataFrame(refs, "id long, place int, w array<string>")
    v = spark.createDataFrame([(w, [float(x) for x in m]) for w, m in vec.items()], "token string, v array<float>")
    idf = G.frequencies(r, "w")
    known = {x.token: x.idf for x in idf.collect()}
    assert known["w1"] == pytest.approx(math.log((len(refs) + 1) / (sum("w1" in x[2] for x in refs) + 1)))
    got = {x.id: x for x in G.best_matches(i, ["id"], G.from_table(i, ["id"], "w", idf, 9.0, v), G.from_table(r, ["id", "place"], "w", idf, 9.0, v), "place", 0.2).collect()}
    assert len(got) == len(items)
    for k, w in items:
        scores = [(plain_f1(w, t, known, vec, 0.2), j) for key, j, t in refs if key == k and any(x in vec for x in t)] if any(x in vec for x in w) else []
        assert got[k].f1 == pytest.approx(max(scores)[0] if scores else 0.0, abs=1e-6)
    assert i.limit(0).select(F.lit(1.0).alias("f1")).agg(G.mean_score("f1")).first()[0] == 0.0
    with pytest.raises(ValueError):
        G.greedy_scores(i, "w", "w", 1.0)


def test_embedders_in_batches(spark):
    def load():
        return lambda texts: [np.array([[len(w), 1.0] for w in t], np.float32).reshape(len(t), 2) for t in texts]

    rows = spark.createDataFrame([(1, ["a", "bb", "a"], [1.0, 2.0, 1.0]), (2, [], []), (3, None, None)], "id long, t array<string>, w array<double>")
    made = G.embedded(rows, "t", "w", load)
    both = G.greedy_scores(made.withColumn("n", F.col("m")), "m", "n").orderBy("id").collect()
    assert [x.f1 for x in both] == pytest.approx([1.0, 0.0, 0.0], abs=1e-9) and both[0].precision == pytest.approx(1.0)
    big = (np.ones(2500), np.random.default_rng(0).normal(size=(2500, 4)))
    big = (big[0], big[1] / np.linalg.norm(big[1], axis=1, keepdims=True))
    small = (np.ones(3), big[1][:3])
    assert G.matched(big, small, block=100) == pytest.approx(G.matched(big, small, block=10_000))
    with pytest.raises(Exception, match="one vector"):
        G.embedded(rows, "t", "w", lambda: lambda texts: [np.zeros((1, 2))] * len(texts)).collect()


# frames


def test_frames_are_written_once(spark, tmp_path):
    root = str(tmp_path / "cache")
    segs = [("v1", "abcdef", "k1", [0, 2, 2]), ("v1", "abcdef", "k2", [2, 5, 9]), ("v2", None, "k3", [0, 1, 2]), ("v3", "é𝄞", "k4", [0, 1, 1])]
    rows = spark.createDataFrame(segs, "source string, text string, key string, indices array<bigint>")
    asked = R.requested(rows, "source", "key", "indices", "text")
    calls = str(tmp_path / "calls")

    def load():
        def decode(text, index):
            with open(calls, "a") as f:
                f.write(f"{text} {index}\n")
            return text[index].encode() if index < len(text) else None

        return decode

    report = R.write_frames(asked.coalesce(1), root, load)
    assert sorted((r.key, r.frame, r.problem is None) for r in report.collect()) == sorted((k, f, t is not None and i < len(t)) for _, t, k, ix in segs for f, i in enumerate(ix))
    states = R.verified(report, R.frame_contents(spark, root))
    assert {(r.key, r.frame): r.state for r in states.collect()} == {(k, f): "ok" if t is not None and i < len(t) else "absent" for _, t, k, ix in segs for f, i in enumerate(ix)}
    assert {r.key for r in R.complete(states, 3).collect()} == {"k1", "k4"}
    seen = {(r.key, r.frame): bytes(r.content).decode() for r in R.frame_contents(spark, root).collect()}
    assert seen["k1", 1] == seen["k1", 2] == seen["k2", 0] == "c" and seen["k4", 1] == "𝄞"
    # another run leaves what is there; lost and damaged files are found
    os.remove(f"{root}/k1/frame_0.jpg")
    open(f"{root}/k2/frame_1.jpg", "w").write("?")
    open(f"{root}/k2/frame_1.jpg.dead.tmp", "w").write("unfinished")
    broken = {(r.key, r.frame): r.state for r in R.verified(report, R.frame_contents(spark, root)).collect()}
    assert broken["k1", 0] == "missing" and broken["k2", 1] == "damaged" and broken["k1", 1] == "ok"
    again = R.write_frames(asked, root, load)
    fixed = {(r.key, r.frame): r.state for r in R.verified(again, R.frame_contents(spark, root)).collect()}
    assert fixed["k1", 0] == "ok" and fixed["k2", 1] == "damaged"
    assert all(r.state in ("ok", "absent") for r in R.verified(R.write_frames(asked, root, load, overwrite=True), R.frame_contents(spark, root)).collect())
    assert R.write_frames(asked.limit(0), root, load).count() == 0


def test_a_task_that_fails_half_way_leaves_whole_frames(spark, tmp_path):
    root = str(tmp_path / "cache")
    asked = spark.createDataFrame([("v", "x" * 50, i, f"k{i}", 0) for i in range(50)], "source string, handle string, idx long, key string, frame int")

    def load():
        def decode(text, index):
            if index == 30:
                raise RuntimeError("no more")
            return text[index].encode() * 1000

        return decode

    with pytest.raises(Exception, match="no more"):
        R.write_frames(asked, root, load)
    left = glob.glob(root + "/*/frame_*.jpg")
    assert left and all(os.path.getsize(f) == 1000 for f in left) and not glob.glob(root + "/*/*.tmp")
    report = R.write_frames(asked, root, lambda: lambda text, index: text[index].encode() * 1000)
    assert R.verified(report, R.frame_contents(spark, root)).filter("state = 'ok'").count() == 50


# curation in one pass


def test_observed_counts_equal_a_second_pass(spark, tmp_path):
    kinds = ["organ", "tool_presence", "task_id", "odd", None]
    rows = [(f"case_{i}_{i}", kinds[i % 5], "q", ["The tissue in the surgical field" if i % 3 else "Colon."], ["valid", "fully_black", "partially_black"][i % 7 % 3]) for i in range(300)]
    qa = spark.createDataFrame(rows, "id string, question_type string, question string, answers array<string>, visual_status string").repartition(5)
    marked = C.curate(qa.withColumn("grounding_status", C.grounding_status(F.col("question_type"), F.get("answers", F.lit(0)))))
    made = J.curated_once(marked, str(tmp_path / "out"), {"question_type": ["organ", "task_id"]})
    counts = {(r.section, r.name): r.n for r in made.manifest.collect()}
    plain = marked.collect()
    kept = [r for r in plain if r.drop_reason is None]
    assert counts["original_examples", ""] == 300 and counts["curated", ""] == len(kept) == made.kept.count() and made.annotated.count() == 300
    assert all(counts["drop_reason", d] == sum(r.drop_reason == d for r in plain) for d in C.DROP_REASONS) and counts["drop_reason", "other"] == 0
    assert counts["question_type", "organ"] == sum(r.question_type == "organ" for r in kept)
    assert counts["question_type", "other"] == sum(r.question_type not in ("organ", "task_id") for r in kept)
    assert made.kept.columns == marked.columns and sorted(map(str, made.kept.collect())) == sorted(map(str, kept))
    none = J.curated_once(marked.limit(0), str(tmp_path / "none"), {})
    assert none.kept.count() == 0 and {r.n for r in none.manifest.collect()} == {0}


# epochs and batches


def test_epochs(spark, tmp_path):
    rows = spark.range(1003).withColumn("answers", F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    made = E.in_epochs(rows.repartition(7), "id", 3, 100)
    got = made.collect()
    orders = {e: [r.id for r in sorted((r for r in got if r.epoch == e), key=lambda r: (r.shard, r.row))] for e in range(3)}
    assert all(sorted(o) == list(range(1003)) for o in orders.values()) and orders[0] != orders[1] != orders[2]
    assert sorted((r.epoch, r.shard, r.row) for r in got) == [(e, p // 100, p % 100) for e in range(3) for p in range(1003)]
    assert {(r.id, r.epoch, r.shard, r.row) for r in E.in_epochs(rows, "id", 3, 100).collect()} == {(r.id, r.epoch, r.shard, r.row) for r in got}
    later = E.in_epochs(rows, "id", 1, 100, first=2).collect()
    assert {(r.id, r.shard, r.row) for r in later} == {(r.id, r.shard, r.row) for r in got if r.epoch == 2}
    answered = made.withColumn("a", E.epoch_answer(F.col("answers"), F.col("id"), F.col("epoch"))).collect()
    share = sum(r.a == "a" for r in answered) / len(answered)
    assert 0.5 < share < 0.6 and {r.a for r in answered} == {"a", "b", "c"}
    manifest = {(r.epoch, r.shard): r.n for r in E.write_shards(made, str(tmp_path / "s")).collect()}
    assert manifest == {(e, s): 100 if s < 10 else 3 for e in range(3) for s in range(11)}
    assert len(glob.glob(str(tmp_path / "s" / "epoch=1" / "shard=4" / "*.parquet"))) == 1
    rest = E.resumed(spark.read.parquet(str(tmp_path / "s")), 1, 4, 37)
    assert rest.count() == 1003 - 437 + 1003
    assert E.in_epochs(rows.limit(0), "id", 2, 10).count() == 0
    one = E.epoch_answer(F.array(F.lit("x")), F.lit(1), F.lit(0))
    assert spark.range(1).select(one.alias("a"), E.epoch_answer(F.array().cast("array<string>"), F.lit(1), F.lit(0)).alias("n")).first().asDict() == {"a": "x", "n": None}


def test_places_within_a_hot_value(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 5).alias("g"), (F.col("id") * 7919 % 2003).alias("o"), "id")
    got = E.placed(rows.repartition(6), ["g", "o"], "p", within="g").collect()
    expected = {}
    for r in sorted(got, key=lambda r: (r.g, r.o)):
        assert r.p == expected.get(r.g, 0)
        expected[r.g] = r.p + 1
    with pytest.raises(ValueError):
        E.placed(rows, ["o"], within="g")


def test_length_batches(spark):
    rng = random.Random(2)
    rows = [(k, [1] * (7 if k % 3 == 0 else rng.randint(1, 256))) for k in range(700)]
    df = spark.createDataFrame(rows, "id long, ids array<int>").withColumn("n", F.size("ids")).withColumn("labels", F.col("ids"))
    made = E.collated(E.length_batches(df.repartition(5), "n", "id", 16, 256), "ids", "labels", 0).collect()
    assert sorted(r.id for r in made) == list(range(700))
    batches = {}
    for r in made:
        batches.setdefault(r.batch, []).append(r)
    assert sorted(batches) == list(range(len(batches)))
    for b in batches.values():
        assert sorted(r.slot for r in b) == list(range(len(b))) and len(b) <= 16
        assert {r.width for r in b} == {max(r.n for r in b)} and all(len(r.ids) == len(r.labels) == len(r.attention_mask) == r.width and sum(r.attention_mask) == r.n == sum(r.ids) for r in b)
        assert sum(r.width - r.n for r in b) / sum(r.width for r in b) <= 1 - 1 / 1.25
        assert all(set(r.labels[r.n :]) <= {-100} for r in b)
    bounds = E.length_bounds(256, 1.25)
    assert sum(len(b) < 16 for b in batches.values()) <= len(bounds) and E.spread_of(bounds, 256) <= 1 - 1 / 1.25
    for bad in (0, 257, None):
        with pytest.raises(Exception, match="tokens"):
            E.length_batches(df.withColumn("n", F.lit(bad).cast("int")), "n", "id", 16, 256).collect()
    assert E.length_batches(df.limit(0), "n", "id", 16, 256).count() == 0
    assert spark.range(1).select(A.padded(F.array(F.lit(1)), F.lit(3), 0).alias("p")).first().p == [1, 0, 0]


# frames as arrays


def plain_area(p, size, to):
    h, w = size
    out = np.zeros(to)
    img = np.array(p, float).reshape(h, w)
    for y in range(to[0]):
        for x in range(to[1]):
            ya, yb, xa, xb = y * h / to[0], (y + 1) * h / to[0], x * w / to[1], (x + 1) * w / to[1]
            total = 0.0
            for i in range(h):
                for j in range(w):
                    total += img[i, j] * max(0, min(yb, i + 1) - max(ya, i)) * max(0, min(xb, j + 1) - max(xa, j))
            out[y, x] = total / ((yb - ya) * (xb - xa))
    return out.ravel()


def test_planes(spark):
    rng = np.random.default_rng(3)
    planes = [rng.integers(0, 256, 63).astype(float).tolist() for _ in range(5)]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(planes)], "id int, p array<double>")
    for to in ((9, 7), (3, 7), (4, 5), (12, 10), (1, 1)):
        got = rows.select("id", P.resampled(F.col("p"), (9, 7), to).alias("r")).collect()
        assert all(np.allclose(r.r, plain_area(planes[r.id], (9, 7), to)) for r in got)
    seen = rows.select("id", P.top(F.col("p"), 9, 7).alias("t"), P.blanked(F.col("p"), 9, 7).alias("b"), P.figures(F.col("p")).alias("f"), P.luma(F.col("p"), F.col("p"), F.col("p")).alias("l")).collect()
    for r in seen:
        p = np.array(planes[r.id])
        assert len(r.t) == 49 and r.b[:49] == planes[r.id][:49] and set(r.b[49:]) == {0.0}
        assert r.f["mean"] == pytest.approx(p.mean()) and r.f.std == pytest.approx(p.std()) and r.f.p99 == pytest.approx(np.percentile(p, 99)) and r.f["max"] == p.max() and r.f.nonzero == pytest.approx((p > 3).mean())
        assert r.l == planes[r.id]
    with pytest.raises(Exception, match="expected 64 values, got 63"):
        rows.select(P.demanded(F.col("p"), 64)).collect()
    with pytest.raises(Exception, match="got none"):
        rows.select(P.demanded(F.lit(None).cast("array<double>"), 64)).collect()
    with pytest.raises(ValueError):
        P.area_weights(0, 3)


def test_clips(spark):
    rng = np.random.default_rng(5)
    dark, bright = [0.0] * 64, lambda: rng.integers(60, 250, 64).astype(float).tolist()
    shown = [[dark] * 3, [bright() for _ in range(3)], [dark] * 3, [dark] * 3, [bright() for _ in range(3)]]
    below = [[0.0] * 48 + [255.0] * 16] * 3  # only the captions are bright
    rows = spark.createDataFrame([(1, [tuple(f) for f in [*shown, below]]), (2, [tuple(f) for f in [[dark] * 3] * 3])], "id int, f array<struct<r:array<double>,g:array<double>,b:array<double>>>")
    got = {r.id: r.c for r in rows.select("id", P.clip(F.col("f"), (8, 8), (4, 4), (0.5, 0.4, 0.3), (0.2, 0.2, 0.1)).alias("c")).collect()}
    assert got[1].mask == [False, True, False, False, True, False] and got[2].mask == [False] * 3
    small = [plain_area(np.r_[np.array(f[0])[:48], np.zeros(16)], (8, 8), (4, 4)) for f in shown]
    expected = np.concatenate([(small[k] / 255 - 0.5) / 0.2 for k in (1, 1, 1, 4, 4, 4)])
    assert np.allclose(got[1].planes.r, expected) and np.allclose(got[2].planes.b, -0.3 / 0.1)


def test_jitter_is_one_draw_a_clip(spark):
    import colorsys

    rng = np.random.default_rng(9)
    rows = [(c, k, [tuple(map(float, rng.integers(0, 256, 3))) for _ in range(30)]) for c in range(6) for k in range(2)]
    df = spark.createDataFrame(rows, "clip int, k int, px array<struct<r:double,g:double,b:double>>").withColumn("d", P.jitter_draw(F.col("clip")))
    got = df.withColumn("out", P.jittered(F.col("px"), F.col("d"))).collect()
    draws = {r.clip: r.d for r in got}
    assert all(draws[r.clip] == r.d for r in got) and len({tuple(d.order) for d in draws.values()}) > 1
    clamp = lambda x: math.floor(min(max(x, 0.0), 255.0))
    gray = lambda p: (int(p[0]) * 19595 + int(p[1]) * 38470 + int(p[2]) * 7471 + 32768) >> 16
    for r in got:
        assert 0.8 <= r.d.brightness <= 1.2 and -0.05 <= r.d.hue <= 0.05 and sorted(r.d.order) == sorted(P.JITTER) and r.d.roll in (-1, 0, 1)
        px = [tuple(p) for p in r.px]
        for name in r.d.order:
            f = r.d[name]
            if name == "hue":
                turned = []
                for p in px:
                    h, s, v = colorsys.rgb_to_hsv(*(x / 255 for x in p))
                    turned.append(tuple(math.floor(x * 255 + 0.5) for x in colorsys.hsv_to_rgb((h + f) % 1, s, v)))
                px = turned
            else:
                m = math.floor(sum(map(gray, px)) / len(px) + 0.5)
                other = {"brightness": lambda p: 0, "contrast": lambda p, m=m: m, "saturation": gray}[name]
                px = [tuple(clamp(x * f + other(p) * (1 - f)) for x in p) for p in px]
        apart = [abs(a - b) for p, q in zip(px, r.out) for a, b in zip(p, q)]
        assert max(apart) <= 2 and np.mean(apart) < 0.05  # a rounding here or there
    roll = spark.range(1).select(*(P.rolled(F.array(*map(F.lit, range(4))), F.lit(k)).alias(f"r{k + 1}") for k in (-1, 0, 1))).first()
    assert (roll.r0, roll.r1, roll.r2) == ([1, 2, 3, 0], [0, 1, 2, 3], [3, 0, 1, 2])


# containers


def test_containers(spark, tmp_path):
    root = tmp_path / "v"
    root.mkdir()
    B.ENTRIES, before = 3, B.ENTRIES
    try:
        whole = B.video_file([(10, 3000), (5, 1500), (1, 1), (2, 2), (7, 3)], 90_000, b"m" * 5000)
        assert B.video_figures(io_file(tmp_path, whole), len(whole))[0] == 25
    finally:
        B.ENTRIES = before
    ticks = 10 * 3000 + 5 * 1500
    files = {
        "good": (B.video_file([(10, 3000), (5, 1500)], 90_000, b"x" * 100), None),
        "first": (B.video_file([(10, 3000), (5, 1500)], 90_000, late=False), None),
        "still": (B.video_file([(3, 0)], 90_000), None),
        "none": (B.video_file([], 90_000), None),
        "bare": (B.box(b"ftyp", b"isom"), "no movie box"),
        "tail": (B.box(b"ftyp", b"isom") + b"\0\0", "cut off"),
        "text": (b"this is no container at all", "beyond its parent"),
        "sound": (B.video_file([(3, 5)], 10).replace(b"vide", b"hint"), "no video track"),
        "zero": (B.box(b"moov", b"\0\0\0\4trak"), "beyond its parent"),
        "short": (B.video_file([(3, 5)], 10).replace(b"\0\0\0\1\0\0\0\3\0\0\0\5", b"\0\0\0\x99\0\0\0\3\0\0\0\5"), "cut off"),
    }
    for name, (data, _) in files.items():
        (root / f"{name}_part_002.mp4").write_bytes(data)
    (root / "notes.txt").write_text("no video")
    (root / "bytes.mp4").write_bytes(b"")
    got = {r.video_path.rsplit("/", 1)[-1].split("_")[0]: r for r in L.video_parts(B.video_metadata(spark, str(root)).withColumn("part", F.lit(None).cast("int"))).collect()}
    assert sorted(got) == sorted(files)
    for name, (_, reason) in files.items():
        r = got[name]
        if reason:
            assert reason in r.reason and r.total_frames is None and r.duration == 0.0, name
        else:
            assert r.reason is None and r.part == 2
    assert got["good"].total_frames == got["first"].total_frames == 15 and got["good"].fps == pytest.approx(15 * 90_000 / ticks) and got["good"].duration == pytest.approx(ticks / 90_000)
    assert (got["still"].total_frames, got["still"].fps, got["none"].total_frames, got["none"].duration) == (3, 0.0, 0, 0.0)
    (tmp_path / "nothing").mkdir()
    assert B.video_metadata(spark, str(tmp_path / "nothing")).count() == 0


def io_file(tmp_path, data):
    (tmp_path / "one").write_bytes(data)
    files, path = T.opened(str(tmp_path / "one"))
    return files.open_input_file(path)


# streams


def test_stream_with_late_rows_and_a_restart(spark, tmp_path):
    size, step = 10_000_000, 4_000_000
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, W.ROCKS)
    arrive = lambda rows: spark.createDataFrame([(k, t * 1_000_000) for k, t in rows], "k string, us long").select("k", F.timestamp_micros("us").alias("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    try:
        run = lambda: W.write_replay_safe(W.full_windows(spark.readStream.schema("k string, at timestamp").parquet(str(tmp_path / "in")), "k", "at", size, step, "5 seconds"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        arrive([("a", 100), ("a", 103), ("b", 102), (None, 101)])
        run()
        out = lambda: sorted((r.key, r.t_start // 1_000_000) for r in W.written(spark, str(tmp_path / "out"), "key string, t_start long, t_end long").collect())
        assert out() == []
        arrive([("a", 99), ("b", 104), ("a", 119)])  # 99 is late, but within the bound: the part starts there
        run()
        first = out()
        arrive([("a", 98), ("c", 60), ("b", 130), ("c", 140)])  # 98 and 60 are too late
        run()
        arrive([("c", 155), ("d", 160)])
        run()
        # parts from 99 to 119, 102 to 130 and 140 to 155
        expected = [("a", 0), ("a", 4), ("a", 8), *(("b", s) for s in (0, 4, 8, 12, 16)), ("c", 0), ("c", 4)]
        assert first == expected[:3] and out() == sorted(expected)
        batches = sorted(os.listdir(tmp_path / "out"))
        # a replayed batch replaces its own folder
        again = spark.read.parquet(str(tmp_path / "out" / batches[1]))
        rows = again.collect()
        spark.createDataFrame(rows, again.schema).write.mode("overwrite").parquet(str(tmp_path / "out" / batches[1]))
        assert out() == sorted(expected)
    finally:
        spark.conf.set(store, before)
    with pytest.raises(ValueError):
        W.PartWindows(0, 1)


# weak spots of before


def test_first_rows_without_ranks(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 5, "n"), (None, 4, "n"), ("b", None, "z"), ("b", 1, None), ("c", 1, "w")], "k string, o int, s string")
    assert sorted(map(tuple, D.first_of(rows, ["k"], "o").collect()), key=str) == sorted([("a", 1, "y"), (None, 4, "n"), ("b", None, "z"), ("c", 1, "w")], key=str)
    got = {(r.k, r.o): (r.first_in_key, r.conflict) for r in D.first_signature(rows, ["k"], "o", F.col("s")).collect()}
    assert got == {("a", 2): (False, True), ("a", 1): (True, False), (None, 5): (False, False), (None, 4): (True, False), ("b", None): (True, False), ("b", 1): (False, None), ("c", 1): (True, False)}
    assert D.dedup_or_fail(rows.filter("k is null or k <> 'a'"), ["k"], "o", F.col("s")).count() == 3
    with pytest.raises(Exception, match="conflicting"):
        D.dedup_or_fail(rows, ["k"], "o", F.col("s")).collect()
    assert rows.columns == D.dedup_or_fail(rows, [F.upper("k")], "o", F.lit(1)).columns
    keys = spark.createDataFrame([(k,) for k in "abcc"], "k string")
    assert {r.k: r.split for r in D.split_by_rank(keys, "k", 2).collect()} == {"a": "train", "b": "train", "c": "val"}
    for n in (0, 3, 9):
        with pytest.raises(ValueError, match="between 1 and 2"):
            D.split_by_rank(keys, "k", n)


def test_numbers_as_python_writes_them(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 1.0, -1.5, 1e15, 123456789.25, 1e7, 0.001, 0.0001, 0.00012345, 1e-5, -1.5e-7, 1e16, 1e22, 1e300, math.inf, -math.inf, 15.0, 0.1 + 0.2, *(rng.uniform(-1, 1) * 10 ** rng.randint(-12, 15) for _ in range(500))]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", X.plain_number(F.col("x")).alias("t")).collect()
    assert [r.t for r in rows if r.t != repr(r.x)] == []
    odd = spark.range(1).select(X.plain_number(F.lit(None).cast("double")).alias("n"), X.plain_number(F.lit(math.nan)).alias("q")).first()
    assert odd.n is None and odd.q == "nan"


def test_training_batches(spark):
    rng = random.Random(6)
    rows = [(f"q{i}", " ".join("abc"[rng.randint(0, 2)] for _ in range(rng.randint(1, 40))), [f"x{i}", "y", "z"][: rng.randint(1, 3)], 0.5) for i in range(150)]
    df = spark.createDataFrame(rows, "id string, question string, answers array<string>, sample_weight double")
    tokens = lambda t: F.transform(F.split(t, " "), lambda w: F.ascii(w))
    made = lambda most=256: J.training_batches(df, tokens, lambda q: F.concat(q, F.lit(" bot")), lambda q, a: F.concat(q, F.lit(" bot "), a, F.lit(" end")), J.Training(epochs=3, size=8, most=most))
    got = made().collect()
    assert sorted((r.epoch, r.id) for r in got) == sorted((e, x[0]) for e in range(3) for x in rows)
    asked = {x[0]: x for x in rows}
    for e in range(3):
        own = {}
        for r in (r for r in got if r.epoch == e):
            own.setdefault(r.batch, []).append(r)
        assert sorted(own) == list(range(len(own)))
        widths = [own[b][0].width for b in sorted(own)]
        assert widths != sorted(widths)  # lengths come mixed
        assert all(len({x.width for x in b}) == 1 and len(b) <= 8 and all(len(x.ids) == len(x.labels) == x.width for x in b) for b in own.values())
    for r in got:
        n, (_, question, answers, weight) = sum(r.attention_mask), asked[r.id]
        prompt = [*map(lambda w: ord(w[0]), question.split(" ")), ord("b")]
        assert r.ids[: len(prompt)] == prompt and r.labels[: len(prompt)] == [-100] * len(prompt) and r.labels[len(prompt) : n] == r.ids[len(prompt) : n] and set(r.labels[n:]) <= {-100}
        assert r.ids[len(prompt)] in {ord(a[0]) for a in answers} and r.ids[n - 1] == ord("e") and r.sample_weight == weight
    with pytest.raises(Exception, match="tokens"):
        made(20).collect()


def test_supervised_labels(spark):
    arr = lambda *v: F.array(*(F.lit(x) for x in v)) if v else F.array().cast("array<int>")
    label = lambda p, w, most=9: spark.range(1).select(A.supervised_labels(arr(*p), arr(*w), most).alias("l")).first().l
    assert label((1, 2), (1, 2, 3)) == [-100, -100, 3] and label((1, 2), (1, 7, 3)) == [-100, 7, 3] and label((), (4,)) == [4]
    for p, w, why in (((1,), (2, 3), "prefix"), ((1, 2), (1, 2), "no tokens"), ((1, 2, 3), (1, 2), "no tokens"), ((1,), (1,) * 10, "more than 9")):
        with pytest.raises(Exception, match=why):
            label(p, w)
    assert spark.range(1).select(A.common_prefix(arr(1, 2, 3), arr(1, 2)).alias("a"), A.common_prefix(arr(), arr(1)).alias("b"), A.common_prefix(arr(1), arr(2)).alias("c")).first() == (2, 0, 0)


def test_entry_needs_no_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert not set(o) - set(q); print(len(q))"], cwd=root, capture_output=True, text=True)
    assert said.returncode == 0 and int(said.stdout) > 90, said.stderr
