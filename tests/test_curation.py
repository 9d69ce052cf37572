"""Rules, operators and jobs of the curation side on small hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom import vocab as V
from sparkloom.functions import arrays as A
from sparkloom.functions import text as X
from sparkloom.operators import curate as C
from sparkloom.operators import dedup as D
from sparkloom.operators import intervals as I
from sparkloom.operators import measure as M
from sparkloom.operators import sampling as S
from sparkloom.operators import templates as T
from sparkloom.plans import jobs


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).select(column.alias("v")).collect()]


ROUTES = [
    ("Are there forceps being used here?", "tool_presence"),
    ("Does this clip involve a grasping retractor?", "tool_presence"),
    ("Is a large suturecut needle driver listed?", "tool_presence"),
    ("Does the tool record mention a stapler?", "tool_presence"),
    ("Is tissue being cut during this clip?", "tissue_cutting"),
    ("Is any cutting happening?", "tissue_cutting"),
    ("Does the clip show tissue dissection?", "tissue_cutting"),
    ("Is suturing required here?", "suture_required"),
    ("What kind of surgical procedure is this?", "procedure_type"),
    ("What is the purpose of a stapler?", "tool_purpose"),
    ("What is the purpose of forceps?", "tool_purpose"),
    ("What is the purpose of the camera?", "tool_purpose_NO_LOOKUP"),
    ("Which forceps type is listed as installed for this clip?", "forceps_type"),
    ("Are any forceps types listed as installed for this clip?", "forceps_type"),
    ("What type of forceps is mentioned?", "forceps_type"),
    ("What organ is involved in this step?", "organ"),
    ("Describe what is happening.", "free_generation"),
    ("What task is the surgeon performing?", "free_generation"),
]


def test_routes(spark):
    assert values(spark, X.route(F.col("x")), [q for q, _ in ROUTES]) == [r for _, r in ROUTES]


def test_text_rules(spark):
    x = F.col("x")
    assert values(spark, X.clock_seconds(x), ["1:02:03", "2:30", "7.5", "", None, "abc", "1:x", "5d", "0:0:0"]) == [3723.0, 150.0, 7.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    assert values(spark, X.join_key(x), ["1", "1.0", " Ab ", "1.2345678", None, "nan", "0.50", "10"]) == ["1", "1", "ab", "1.234568", None, None, "0.5", "10"]
    assert values(spark, X.normalize(x), ["  A\u00a0\tb\n c\u3000", None]) == ["a b c", None]
    assert values(spark, X.polarity(x), ["Yes.", " no", "Not", "maybe", None]) == [True, False, False, None, None]
    assert values(spark, X.case_number(x), ["case147_p1", "CASE_12", "none"]) == [147, 12, None]
    assert values(spark, X.part_number(x), ["a/case_1_video_part_003.mp4", "x.mp4", "part_2"]) == [3, 1, 2]
    assert values(spark, X.question_type(x), ["a_tp_bal_9", "a_organ_1", "zzz"]) == ["tool_presence", "organ", None]
    assert values(spark, X.english_list(F.split(x, " ")), ["a", "a b", "a b c"]) == ["a", "a and b", "a, b and c"]
    assert values(spark, X.canonical_forceps(x), ["prograsp forceps, Cadiere  forceps", "none"]) == ["Cadiere Forceps and Prograsp Forceps", V.NO_FORCEPS]
    assert values(spark, X.relative_path(x, "data24"), ["C:\\d\\Data24\\a\\b.mp4", "/x/y"]) == ["Data24/a/b.mp4", "/x/y"]
    import hashlib

    assert values(spark, X.stable_fraction(x), ["abc", "id-1"]) == [int.from_bytes(hashlib.sha256(s).digest()[:8], "big") / 2.0**64 for s in (b"abc", b"id-1")]


def test_finished_answers(spark):
    rows = [
        ("What procedure is this summary describing?", "x", V.PROCEDURE_ANSWER),
        ("What role is vessel sealer intended to serve?", "x", "To seal and divide blood vessels."),
        ("What type of forceps is mentioned?", "bipolar forceps", "The type of forceps mentioned is Bipolar Forceps."),
        ("What type of forceps is mentioned?", "??", V.NO_FORCEPS),
        ("What organ is being manipulated?", "blob", V.ORGAN_FALLBACK),
        ("What organ is being manipulated?", "The uterus.", "The uterus."),
        ("Anything else?", "as said", "as said"),
    ]
    got = spark.createDataFrame(rows, "q string, a string, e string").select(X.finish_answer(F.col("q"), F.col("a")), "e").collect()
    assert [r[0] for r in got] == [r[1] for r in got]
    frames = [("What organ is being manipulated?", "the colon.", "The organ being manipulated is the colon."), ("What organ is being manipulated?", "It is fine", "It is fine"), ("What?", "colon", "colon"), ("What?", "", "")]
    got = spark.createDataFrame(frames, "q string, a string, e string").select(X.frame_answer(F.col("q"), F.col("a")), "e").collect()
    assert [r[0] for r in got] == [r[1] for r in got]
    limits = {"tool_presence": 0.2}
    rows = [("Is a stapler listed?", 0.2, "Yes"), ("Is a stapler listed?", 0.1, "No"), ("Is a stapler listed?", float("nan"), "p"), ("Is a stapler listed?", None, "p")]
    got = spark.createDataFrame(rows, "q string, m double, e string").select(X.threshold_answer(F.col("q"), F.col("m"), F.lit("p"), limits), "e").collect()
    assert [r[0] for r in got] == [r[1] for r in got]
    assert values(spark, X.fallback_answer(F.col("x")), ["Is it on?", "Describe it."]) == ["Yes", "The surgical field is visible in this clip."]


def test_windows(spark):
    parts = spark.createDataFrame([("a", 100.0), ("b", 20.0), ("c", 30.0), ("d", 45.0), ("e", 0.0), ("f", None)], "k string, duration double")
    got = {}
    for r in I.sliding_windows(parts, 30.0, 15.0).collect():
        got.setdefault(r.k, []).append((r.t_start, r.t_end))
    assert got["a"] == [(0.0, 30.0), (15.0, 45.0), (30.0, 60.0), (45.0, 75.0), (60.0, 90.0)]
    assert (got["b"], got["c"], got["d"]) == ([(0.0, 20.0)], [(0.0, 30.0)], [(0.0, 30.0), (15.0, 45.0)])
    assert "e" not in got and "f" not in got
    with pytest.raises(ValueError):
        I.sliding_windows(parts, 30.0, 0.0)


def test_majority_and_sets(spark):
    w = spark.createDataFrame([("a", 0.0, 30.0), ("a", 30.0, 60.0), ("a", 60.0, 90.0)], "k string, t_start double, t_end double")
    i = spark.createDataFrame([("a", 0.0, 15.0, "x", 1), ("a", 15.0, 30.0, "y", 2), ("a", 30.0, 44.9, "z", 3), ("b", 60.0, 90.0, "q", 4)], "k string, i_start double, i_end double, label string, ord int")
    for bucket in (None, 7.0):
        got = {r.t_start: (r.label, r.best_overlap) for r in I.majority_label(w, i, ["k"], "label", "ord", bucket=bucket).collect()}
        assert got[0.0] == ("x", 15.0) and got[30.0][0] == "Other" and got[60.0] == ("Other", 0.0)
        sets = {r.t_start: r.s for r in I.active_sets(w, i, ["k"], {"s": "label"}, bucket=bucket).collect()}
        assert sets == {0.0: ["x", "y"], 30.0: ["z"], 60.0: []}


def test_bucketed_join_equals_plain(spark):
    rng = random.Random(3)
    w = spark.createDataFrame([(rng.randrange(3), s, s + rng.randint(1, 40)) for s in range(0, 300, 7)], "k int, t_start int, t_end int")
    i = spark.createDataFrame([(rng.randrange(3), s, s + rng.randint(0, 90), n) for n, s in enumerate(rng.randrange(300) for _ in range(80))], "k int, i_start int, i_end int, n int").filter("i_end > i_start")
    plain = sorted(map(tuple, I.overlap_join(w, i, ["k"]).select("k", "t_start", "n", "overlap").collect()))
    assert plain == sorted(map(tuple, I.overlap_join(w, i, ["k"], bucket=10).select("k", "t_start", "n", "overlap").collect())) and plain


def test_first_wins_with_null_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, n string")
    lookup = spark.createDataFrame([(None, "nan", 0), (None, "null row", 1), (1, "first", 2), (1, "second", 3)], "k int, text string, row_no int")
    assert {r.n: r.text for r in I.enrich_first(rows, lookup, ["k"], "text", "row_no").collect()} == {"a": "first", "b": "null row", "c": ""}


def test_unique_ids_and_dedup(spark):
    ids = ["a_1", "a_1", "b_2", "a_1", "b_2", "c"]
    rows = spark.createDataFrame(list(enumerate(ids)), "ord long, id string").repartition(3)
    assert [r.id for r in D.unique_ids(rows, "id", "ord").orderBy("ord").collect()] == ["a_1", "a_1000", "b_2", "a_1001", "b_1002", "c"]
    rows = spark.createDataFrame([(1, "k", "s"), (2, "k", "s"), (3, "m", "t")], "ord int, k string, s string")
    assert [r.ord for r in D.dedup_or_fail(rows, ["k"], "ord", F.col("s")).orderBy("ord").collect()] == [1, 3]
    with pytest.raises(Exception, match="conflicting"):
        D.dedup_or_fail(rows.union(spark.createDataFrame([(4, "m", "other")], rows.schema)), ["k"], "ord", F.col("s")).collect()


def test_balance_and_cap(spark):
    rows = spark.createDataFrame([("x", True)] * 9 + [("x", False)] + [("y", False)] * 8 + [("y", True)] * 8, "k string, yes boolean")
    needs = {r.k: (r["yes"], r.no, r.need, r.wanted) for r in D.answer_needs(rows, "k", F.col("yes")).collect()}
    assert needs == {"x": (9, 1, 8, "no"), "y": (8, 8, 0, None)}
    rows = spark.createDataFrame([("g", "a", i) for i in range(8)] + [("g", "b", 8 + i) for i in range(3)] + [("h", "a", i) for i in range(4)], "g string, a string, ord int")
    kept = D.cap_dominant(rows, "g", "a", "ord", "ord", 0.5, "s").collect()
    assert sorted(r.a for r in kept if r.g == "g") == ["a"] * 3 + ["b"] * 3 and not [r for r in kept if r.g == "h"]


def test_stratified_sample_does_not_depend_on_order(spark):
    rows = spark.createDataFrame([("c", i, i % 3 == 0) for i in range(90)], "case string, n int, good boolean")
    one = {r.n for r in S.stratified(rows, "case", "n", F.col("good"), 20, 0.8, "s").collect()}
    two = {r.n for r in S.stratified(rows.orderBy(F.desc("n")).repartition(5), "case", "n", F.col("good"), 20, 0.8, "s").collect()}
    assert one == two and len(one) == 20 and sum(n % 3 == 0 for n in one) == 16
    drawn = S.slots(rows, "n", V.TYPE_SLOTS, 3, "s").groupBy("n").count().collect()
    assert {r["count"] for r in drawn} == {3}


def test_curation(spark):
    rows = [
        ("1", "organ", "fully_black", "semantic_task_label", "Colon."),
        ("2", "task_id", "fully_black", "metadata_or_language", "x"),
        ("3", "procedure_type", "fully_black", "metadata_or_language", "x"),
        ("4", "task_id", "partially_black", "metadata_or_language", "x"),
        ("5", "organ", "partially_black", "semantic_task_label", "Colon."),
        ("6", "task_id", "valid", "metadata_or_language", "x"),
        ("7", "organ", "valid", "generic_fallback", "The tissue in the surgical field"),
    ]
    df = spark.createDataFrame(rows, "id string, question_type string, visual_status string, grounding_status string, first string").withColumn("question", F.lit("q")).withColumn("answers", F.array("first"))
    got = {r.id: r for r in C.curate(df, 0.5).collect()}
    assert got["1"].drop_reason == "drop_fully_black_visual_question"
    assert [got[i].sample_weight for i in "23456"] == [0.2, 0.1, 0.5, 0.5, 1.0]
    assert got["5"].curation_action == "downweight_partially_black+rewrite_semantic_organ" and got["5"].original_question == "q" and got["5"].question in V.SEMANTIC_QUESTIONS
    assert got["5"].answers == ["Colon"] + [a.replace("{}", "colon") for a in V.SEMANTIC_ANSWERS] and got["6"].curation_action == "keep"
    f = values(spark, X.stable_fraction(F.col("x")), ["7"])[0]
    assert (got["7"].drop_reason is None) == (f < 0.5) and {r.sample_weight for r in got.values()} <= {1.0, 0.5, 0.2, 0.1}
    with pytest.raises(ValueError):
        C.curate(df, 0.0)


def one(spark, column, **kinds):
    names = {k: v for k, v in kinds.items()}
    return spark.createDataFrame([tuple(v[1] for v in names.values())], ", ".join(f"{k} {v[0]}" for k, v in names.items())).select(column.alias("v")).first().v


def test_templates(spark):
    tools, sold = F.col("tools"), F.col("sold")
    seg = {"tools": ("array<string>", ["bipolar forceps"]), "sold": ("array<string>", ["large needle driver"]), "task": ("string", "Suturing"), "text": ("string", "x")}
    say = lambda target: one(spark, T.tool_presence(tools, sold, F.lit(target), F.lit("k")), **seg)
    assert say("forceps").answers[0] == "Yes" and len(set(say("forceps").answers)) == 5 and "forceps" in say("forceps").question
    assert say("cadiere forceps").answers[0] == "No" and say("large needle driver").answers[0] == "Yes" and say("needle driver").answers[0] == "No"
    names = lambda t: one(spark, T.forceps_type(tools), tools=("array<string>", t)).answers[0]
    assert names([]) == V.NO_FORCEPS and names(["prograsp forceps"]) == "Prograsp Forceps"
    assert names(["prograsp forceps", "bipolar forceps", "cadiere forceps"]) == "Cadiere Forceps, Bipolar Forceps and Prograsp Forceps."
    assert one(spark, T.tool_purpose(tools, F.lit("k")), tools=("array<string>", [])) is None
    made = one(spark, T.tool_purpose(tools, F.lit("k")), tools=("array<string>", ["stapler", "clip applier"]))
    assert "stapler" in made.question or "clip applier" in made.question
    told = lambda t: one(spark, T.description(F.col("t"), F.lit("k")), t=("string", t))
    assert told("Activity outside of the structured training was seen") is None and told("short") is None and told(None) is None
    d = told("The surgeon   lifts the colon. Then more.")
    assert d.answers[0] == "The surgeon lifts the colon." and d.answers[1] == "The clip shows that the surgeon lifts the colon." and all(a.endswith(".") for a in d.answers) and len(d.answers) == 5
    assert one(spark, T.organ_of(F.col("a"), F.col("b")), a=("string", "Other"), b=("string", "near the Gallbladder")) == "gallbladder"
    long = "word " * 60
    assert told(long).answers[0] == ("word " * 28).strip() + "."


def test_arrays(spark):
    plan = A.index_plan(F.col("n"), 4)
    assert [one(spark, plan, n=("long", n)) for n in (1, 2, 10, 100)] == [[0, 0, 0, 0], [0, 0, 0, 1], [0, 3, 6, 9], [0, 33, 66, 99]]
    v, m = ("array<int>", [1, 2, 3, 4, 5]), ("array<boolean>", [False, True, False, True, False])
    assert one(spark, A.nearest_valid(F.col("v"), F.col("m")), v=v, m=m) == [2, 2, 2, 4, 4]
    assert one(spark, A.nearest_valid(F.col("v"), F.col("m")), v=v, m=("array<boolean>", [False] * 5)) == [1, 2, 3, 4, 5]
    assert one(spark, A.roll(F.col("v"), 1), v=v) == [5, 1, 2, 3, 4] and one(spark, A.roll(F.col("v"), -1), v=v) == [2, 3, 4, 5, 1]
    assert one(spark, A.masked_pool(F.col("v"), F.col("m"), 2, -1.0), v=v, m=m) == [2.0, 4.0]
    with pytest.raises(Exception, match="fewer tokens"):
        one(spark, A.masked_pool(F.col("v"), F.col("m"), 6), v=v, m=m)
    assert one(spark, A.coarse_mask(F.col("m"), 2, 2), m=m) == [True, True, True, True, False, False]
    assert one(spark, A.masked_labels(F.slice("v", 1, 2), F.col("v")), v=v) == [-100, -100, 3, 4, 5]
    assert one(spark, A.padded(F.col("v"), F.lit(7), 9), v=v) == [1, 2, 3, 4, 5, 9, 9] and one(spark, A.attention(F.col("v"), F.lit(6)), v=v) == [1, 1, 1, 1, 1, 0]


def bleu(ref, cand):
    import math
    from collections import Counter

    logs = 0.0
    for n in range(1, 5):
        c = Counter(tuple(cand[i : i + n]) for i in range(len(cand) - n + 1))
        r = Counter(tuple(ref[i : i + n]) for i in range(len(ref) - n + 1))
        hit = sum(min(k, r[g]) for g, k in c.items())
        if n == 1 and not hit:
            return 0.0
        logs += math.log((hit or 0.1) / max(1, sum(c.values()))) / 4
    return math.exp(logs) * (1 if len(cand) > len(ref) else math.exp(1 - len(ref) / len(cand)))


def test_bleu(spark):
    rng = random.Random(1)
    pairs = [([rng.choice("abcd") for _ in range(rng.randint(1, 9))], [rng.choice("abcd") for _ in range(rng.randint(1, 9))]) for _ in range(40)]
    got = spark.createDataFrame(pairs, "r array<string>, c array<string>").select(A.bleu4(F.col("r"), F.col("c")).alias("v"), "r", "c").collect()
    assert all(abs(g.v - bleu(g.r, g.c)) < 1e-9 for g in got)


def test_metrics_and_calibration(spark):
    rows = spark.createDataFrame([("t", 0.5, True), ("t", -0.5, False), ("t", float("nan"), True), ("u", 1.0, False)], "kind string, margin double, truth boolean")
    got = {r.kind: r for r in M.calibrated(rows, "kind", "margin", "truth", M.GRID).collect()}
    assert (got["t"].n, got["t"].best_threshold, got["t"].best_accuracy) == (2, -0.4, 1.0) and got["u"].best_threshold == 1.1
    m = M.presence_metrics(spark.createDataFrame([("yes", "Yes"), ("yes", "No"), ("x", "y")], "p string, t string"), "p", "t").first()
    assert (m.accuracy, m.false_positive_rate) == (2 / 3, 1.0)
    assert M.set_f1(spark.createDataFrame([([], [])], "p array<string>, e array<string>"), F.col("p"), F.col("e")).first().micro_f1 == 1.0


def test_status_and_rules(spark):
    audit = spark.createDataFrame([("v", 0.0, 1.0, "cache16", True, True), ("v", 1.0, 2.0, "raw", True, True), ("v", 2.0, 3.0, "raw", True, True), ("v", 3.0, 4.0, "raw", False, False)], "video string, t_start double, t_end double, source string, all_near_black boolean, any_near_black boolean")
    sure = spark.createDataFrame([("v", 1.0, 2.0, True), ("v", 2.0, 3.0, False)], "video string, t_start double, t_end double, all_three_near_black boolean")
    assert {r.t_start: r.visual_status for r in C.visual_status(audit, sure).collect()} == {0.0: "fully_black", 1.0: "fully_black", 2.0: "partially_black"}
    base = dict(id="1", video="v", t_start=0.0, t_end=30.0, question="Is stapler listed?", answers=["Yes", "b", "c", "d", "e"], question_type="tool_presence", tool="stapler", tools=["stapler"], commercial_tools=[], found=True, grounding_status="x", ord=1)
    rows = [base, base | dict(ord=2), base | dict(ord=3, answers=["No", "b", "c", "d", "e"]), base | dict(ord=4, video="w", answers=["Yes"]), base | dict(ord=5, video="x", found=False), base | dict(ord=6, video="y", question="Is a forceps present?", tools=[])]
    schema = "id string, video string, t_start double, t_end double, question string, answers array<string>, question_type string, tool string, tools array<string>, commercial_tools array<string>, found boolean, grounding_status string, ord int"
    names = [f.split()[0] for f in schema.split(", ")]
    report = C.violations(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema), C.answer_rules(), C.STOPS)
    got = {}
    for r in report.collect():
        got.setdefault(r.ord, set()).add(r.rule)
    assert got == {2: {"duplicate"}, 3: {"conflict", "presence_label"}, 4: {"not_five"}, 5: {"no_segment"}, 6: {"grammar_1", "presence_wording", "presence_claim", "presence_label"}}
    with pytest.raises(Exception, match="constraint violated"):
        C.fail_on(report).collect()


def test_segment_and_question_jobs(spark):
    parts = spark.createDataFrame([("case_1", "p/case_1_part_001.mp4", 1, 60.0), ("case_1", "p/case_1_part_002.mp4", 2, 40.0), ("case_1", "p/x", 3, 30.0)], "case string, video_path string, part int, duration double")
    tasks = spark.createDataFrame([("case_1", 1.0, "0:30", 3.0, "0:20", "Suturing", "The surgeon is suturing the cut now.", 1)], "case string, start_part double, start_time string, stop_part double, stop_time string, groundtruth_taskname string, matched_description string, row_no long")
    tools = spark.createDataFrame([
        ("case_1", 1.0, "0:00:10", 1.0, "0:00:00", "Stapler", "Unknown Instrument", 1),
        ("case_1", 1.0, "0:50", 1.0, "0:40", "Clip Applier", None, 2),
        ("case_1", 1.0, "0:50", 2.0, "0:05", "needle driver", "Large Needle Driver", 3),
        ("case_1", 1.0, "0:00", 1.0, "0:50", "not a tool", "x", 4),
    ], "case string, install_case_part double, install_case_time string, uninstall_case_part double, uninstall_case_time string, groundtruth_toolname string, commercial_toolname string, row_no long")
    rows = jobs.segments(parts, tasks, tools)
    got = {(r.part, r.t_start): r for r in rows.collect()}
    assert sorted(got) == [(1, 0.0), (1, 15.0), (1, 30.0), (2, 0.0), (3, 0.0)]
    assert [got[k].task for k in sorted(got)] == ["Other", "Suturing", "Suturing", "Suturing", "Suturing"]
    assert got[1, 0.0].tools == ["stapler"] and got[1, 30.0].tools == ["needle driver", "stapler"] and got[2, 0.0].commercial_tools == ["large needle driver"] and got[3, 0.0].tools == []
    assert got[1, 0.0].description.startswith("This segment contains activity outside") and got[3, 0.0].description == "The surgeon is suturing the cut now."
    qa = jobs.questions(rows)
    made = qa.collect()
    assert made and all(len(set(r.answers)) == 5 for r in made) and len({r.id for r in made}) == len(made)
    status = spark.createDataFrame([("p/x", 0.0, 30.0, "fully_black")], "video string, t_start double, t_end double, visual_status string")
    assert jobs.curated(qa, status).count() == len(made)
