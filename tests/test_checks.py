"""Splits, validation, evaluation, model seams and the jobs that use them."""

import json
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom import vocab as V
from sparkloom.functions import text as X
from sparkloom.operators import dedup as D
from sparkloom.operators import measure as M
from sparkloom.operators import models as O
from sparkloom.operators import sampling as S
from sparkloom.operators import splits as P
from sparkloom.plans import checks, jobs, queries
from sparkloom.sources import tables


def test_every_query_has_sql():
    assert not set(queries.QUERIES) - set(queries.ORACLES) and "rule_catalogue" in queries.QUERIES


def test_planted_faults_cover_the_catalogue(spark):
    from sparkloom.operators.curate import answer_rules

    assert {r for _, _, rules in checks._FAULTS for r in rules} == set(answer_rules())


def test_splits(spark):
    rows = spark.createDataFrame([("train", "case_1_a", 1, "x"), ("train", "case_2_b", 2, "y"), ("val", "case_141_a", 1, "x"), ("test", "case_150_c", 1, None), ("val", "case_1_a", 2, "x")], "split string, id string, place long, kind string")
    case = X.case_number(F.col("id"))
    assert [r.id for r in rows.filter(P.outside_cases(F.col("split"), case)).collect()] == ["case_1_a"]
    assert [tuple(r) for r in P.shared_ids(rows, "split", "id").collect()] == [("train", "val", 1)]
    assert tuple(P.id_counts(rows, "id").first()) == (5, 4, False) and tuple(P.id_counts(rows.limit(0), "id").first()) == (0, 0, True)
    s = {r.split: r for r in P.summary(rows.withColumn("c", case), "split", "c", "kind").collect()}
    assert s["train"].cases == [1, 2] and s["test"].types == {"missing": 1} and s["val"].examples == 2
    parts = [rows.filter(F.col("split") == n) for n in P.CASES]
    whole = spark.createDataFrame([(1, "case_1_a"), (2, "case_2_b"), (3, "case_1_a"), (4, "case_141_a"), (5, "case_150_c"), (6, "more")], "place long, id string")
    assert {tuple(r) for r in P.misplaced(P.concatenated(parts, "place"), whole, "place", "id").collect()} == {(3, "case_141_a", "case_1_a"), (4, "case_1_a", "case_141_a"), (6, None, "more")}
    held = spark.createDataFrame([("case_146",), ("case_147",), (None,)], "c string")
    assert {n: d.count() for n, d in P.by_case(held, X.case_number(F.col("c")), 147).items()} == {"val": 1, "test": 1}
    with pytest.raises(ValueError, match="empty"):
        P.by_case(held, X.case_number(F.col("c")), 500)
    segments = spark.createDataFrame([("v", 0.0, 1.0, "old", 1), ("v", 0.0, 1.0, "new", 2)], "video string, t_start double, t_end double, tool string, row_no int")
    asked = spark.createDataFrame([("v", 0.0, 1.0), ("w", 0.0, 1.0)], "video string, t_start double, t_end double")
    assert {r.video: (r.tool, r.found) for r in P.with_segment(asked, segments, ["tool"], "row_no").collect()} == {"v": ("new", True), "w": (None, False)}
    assert P.require_segments(asked.limit(1), segments).count() == 1
    with pytest.raises(Exception, match="no segment for w"):
        P.require_segments(asked, segments).collect()


def test_numbers_are_gapless(spark):
    rng = random.Random(3)
    values = rng.sample(range(-(10**15), 10**15), 500)
    rows = spark.createDataFrame([(v,) for v in values], "k long").repartition(7)
    assert [r.n for r in D.numbered(rows, "k", "n", cells=9).orderBy("k").collect()] == list(range(1, 501))
    assert D.numbered(rows.limit(0), "k", "n").count() == 0
    many = spark.createDataFrame([(i, f"x_{i % 3}") for i in range(200)], "ord long, id string")
    assert D.unique_ids(many, "id", "ord").select("id").distinct().count() == 200


def test_cap_keeps_the_smallest_draws(spark):
    import hashlib

    rows = spark.createDataFrame([("g", "a" if i % 10 else "b", i) for i in range(3000)], "g string, a string, ord long").repartition(4)
    kept = {r.ord for r in D.cap_dominant(rows, "g", "a", "ord", "ord", 0.5, "s").collect()}
    drawn = sorted((i for i in range(3000) if i % 10), key=lambda i: hashlib.sha256(f"s|{i}".encode()).hexdigest())[:300]
    assert kept == set(drawn) | {i for i in range(3000) if not i % 10}


def test_presence_balance(spark):
    rows = [(f"case_{c}", f"v{c}", 1, float(15 * t), float(15 * t + 30), "Suturing", "The surgeon is suturing the cut.", ["needle driver"] + (["stapler"] if t % 4 == 0 else []), ["large needle driver"]) for c in range(4) for t in range(60)]
    segments = spark.createDataFrame(rows, tables.SEGMENTS)
    config = jobs.Questions(most=40)
    made = jobs.questions(segments, config).collect()
    assert len({r.id for r in made}) == len(made) and any("_tp_bal_" in r.id for r in made) and all(len(set(r.answers)) == 5 for r in made)
    known = {(r[1], r[3]): r for r in rows}
    for r in made:
        if r.question_type == "tool_presence":
            seg = known[r.video, r.t_start]
            there = any(t in seg[7] for t in V.FORCEPS) if r.tool == "forceps" else r.tool in seg[7] or r.tool in seg[8]
            assert (r.answers[0] == "Yes") == there
    count = Counter((r.tool, r.answers[0]) for r in made if r.tool == "stapler")
    assert 0.3 <= count["stapler", "Yes"] / sum(count.values()) <= 0.7
    asked = spark.createDataFrame([("k", True)] * 1 + [("k", False)] * 9, "k string, y boolean")
    assert D.answer_needs(asked, "k", F.col("y"), target=0.25, tolerance=0.05).first().need == 2  # floor(9 / 0.75) - 10
    long = jobs.questions(segments, jobs.Questions(most=5, style="long"))
    assert long.count() > 0


def test_validation_job(spark):
    good = ["Yes", "b", "c", "d", "e"]
    rows = [("train", 1, "case_1_x", "v1", "Is stapler listed?", good, "tool_presence", "stapler"), ("val", 1, "case_141_x", "v2", "Is stapler listed?", good, "tool_presence", "stapler"), ("test", 1, "case_2_x", "v3", "Is stapler listed?", good[:4], "tool_presence", "stapler")]
    qa = spark.createDataFrame(rows, "split string, place long, id string, video string, question string, answers array<string>, question_type string, tool string").withColumns({"t_start": F.lit(0.0), "t_end": F.lit(30.0), "grounding_status": F.lit("x")})
    segments = spark.createDataFrame([("v1", 0.0, 30.0, ["stapler"], [], 1), ("v2", 0.0, 30.0, [], [], 2), ("v3", 0.0, 30.0, [], [], 3)], "video string, t_start double, t_end double, tools array<string>, commercial_tools array<string>, row_no int")
    whole = spark.createDataFrame([(1, "case_1_x"), (2, "case_2_x"), (3, "case_2_x")], "place long, id string")
    summary, broken = jobs.validated(qa, whole, segments)
    assert summary.count() == 3
    assert Counter(r.rule for r in broken.collect()) == {"case_range": 1, "not_five": 1, "presence_label": 1, "not_concatenated": 1, "repeated_ids": 1}


def test_evaluation_job(spark):
    items = [(1, "tool_presence", "Is a stapler listed as installed?", ["No", "No."]), (2, "forceps_type", "Which forceps type is listed as installed for this clip?", ["Cadiere Forceps"]), (3, "description", "Describe what is happening.", ["the colon is seen"])]
    outs = [(1, "Yes", 0.1), (2, "it is cadiere forceps", float("nan")), (3, "  ", None)]
    items = spark.createDataFrame(items, "place long, question_type string, question string, answers array<string>")
    outs = spark.createDataFrame(outs, "place long, prediction string, margin double")
    rows = jobs.answered(items, outs, {"tool_presence": 0.2}).select("place", "question_type", "answers", "prediction").collect()
    done = spark.createDataFrame([tuple(r) for r in rows], "place long, question_type string, answers array<string>, prediction string")
    assert {r.place: r.prediction for r in rows} == {1: "No", 2: "The listed forceps type is Cadiere Forceps.", 3: "The surgical field is visible in this clip."}
    scores, presence, forceps = jobs.evaluated(done)
    total = [r for r in scores.collect() if r.is_total][0]
    assert total.n == 3 and 0 < total.bleu4 < 1 and presence.first().accuracy == 1.0 and forceps.first().micro_f1 == 1.0
    with pytest.raises(Exception, match="differ at place 3"):
        M.aligned(items, outs.filter("place < 3"), "place", ["margin"]).collect()
    with pytest.raises(Exception, match="reference answers"):
        jobs.evaluated(done.withColumn("answers", F.array().cast("array<string>")))[0].collect()
    records = spark.createDataFrame([("t", 0.5, True, "yes"), ("t", None, False, "no"), ("t", -1.0, False, "perhaps")], "kind string, margin double, truth boolean, said string")
    r = M.calibration_report(records, "kind", "margin", "truth", "said", M.GRID).first()
    assert (r.n, round(r.yes_rate, 4), round(r.greedy_accuracy, 4), r.accuracy_at_0, r.best_accuracy) == (3, 0.3333, 0.6667, 1.0, 1.0)


def test_model_seam(spark):
    def load():
        seen = []

        def score(rows):
            seen.append(len(rows))
            return pd.DataFrame({"size": rows["text"].str.len(), "loads": 1})

        return score

    rows = spark.createDataFrame([(i, f"v{i % 3}", "x" * i) for i in range(20)], "id int, video string, text string")
    out = O.scored(rows, load, ["text"], "size long, loads int", group=["video"], order=["id"])
    assert {r.id: r.size for r in out.collect()} == {i: i for i in range(20)} and O.scored(rows.limit(0), load, ["text"], "size long, loads int").count() == 0
    with pytest.raises(ValueError, match="there already"):
        O.scored(rows, load, ["text"], "id int")
    ordered = O.in_read_order(rows.select("video", (-F.col("id")).alias("i")), "video", "i").collect()
    assert all(a.i <= b.i for a, b in zip(ordered, ordered[1:]) if a.video == b.video)
    made = spark.createDataFrame([('{"a": 3}',), (None,), ("{}",)], "j string").select(O.config(F.col("j"), {"a": 1, "b": "x", "c": False, "d": 0.5}).alias("c")).collect()
    assert [tuple(r.c) for r in made] == [(3, "x", False, 0.5), (1, "x", False, 0.5), (1, "x", False, 0.5)]
    one = spark.range(1).select(O.key_check(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))).alias("k"), O.positions_after(F.array(F.lit(4).cast("long"), F.lit(7).cast("long")), F.lit(3).cast("long")).alias("p"), O.clean_keys(F.create_map(F.lit("module.backbone.w"), F.lit(1))).alias("m"), O.positions_after(F.array(F.lit(4).cast("long")), F.lit(0).cast("long")).alias("none")).first()
    assert (one.k.missing, one.k.unexpected, one.k.ok) == (["a"], ["c"], False) and one.p == [8, 9, 10] and one.m == {"w": 1} and one.none == []


def test_keys_of_caches(spark):
    import hashlib

    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    rows = spark.createDataFrame([("/mnt/Root/a/b.mp4", 15.0, 45.5), ("/mnt/x.mp4", 1e7, 12345678.0)], "v string, a double, b double")
    got = [r.k for r in rows.select(X.cache_keys(F.col("v"), F.col("a"), F.col("b"), "root", r"d:\old").alias("k")).collect()]
    assert got == [[md5("/mnt/Root/a/b.mp4|15.0|45.5"), md5(r"d:\old\Root\a\b.mp4|15.0|45.5")], [md5(f"/mnt/x.mp4|{1e7}|{12345678.0}")]]


def test_one_case(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps("Is a \"stapler\" listed as installed?"))
    question = tables.json_scalar(spark, str(tmp_path / "q.json"), "question")
    assert question.first().question == 'Is a "stapler" listed as installed?'
    out = spark.createDataFrame([("No",)], "prediction string")
    assert jobs.one_response(question, out).first().response == "No" and jobs.one_response(question, out.limit(0)).first().response == "Yes"
    (tmp_path / "bad.json").write_text("[1")
    none = tables.json_scalar(spark, str(tmp_path / "bad.json"), "question")
    assert jobs.one_response(none).first().response == "The surgical field is visible in this clip."
    tables.write_json_scalar(jobs.one_response(question, spark.createDataFrame([('say "no"',)], "prediction string")), "response", str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r")).first().value) == 'say "no"'


def test_first_rows(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "i int, g string").repartition(3)
    assert sorted(r.i for r in S.first_per_group(rows, ["g"], "i", 2).collect()) == [0, 1, 2, 3]
