"""Queries on splits, validation, evaluation, model seams and keys, registered beside those of ``queries``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from sparkloom import vocab as V
from sparkloom.functions import text as X
from sparkloom.operators import curate as C
from sparkloom.operators import dedup as D
from sparkloom.operators import measure as M
from sparkloom.operators import models as O
from sparkloom.operators import sampling as S
from sparkloom.operators import splits as P
from sparkloom.plans import jobs as J
from sparkloom.plans.queries import ASK_SQL, ROUTES, asked, margins, MARGINS, query, quoted, read, segments, six
from sparkloom.sources.shared import dealt

# ------------------------------------------------------------------ splits

SPLIT_SQL = "r AS (SELECT o_orderkey, o_custkey, o_orderpriority AS kind, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'val' ELSE 'test' END AS split, CAST(o_custkey % 160 AS INTEGER) AS c, 'case_' || (o_custkey % 160) || '_' || CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey ELSE o_orderkey END AS id FROM orders)"


def split_rows(spark, sf_dir):
    """Orders as rows of splits, with ids that several may have."""
    o = read(spark, sf_dir, "orders")
    split = F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "val").otherwise("test")
    last = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey")).otherwise(F.col("o_orderkey"))
    return o.select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("kind"), split.alias("split"), (F.col("o_custkey") % 160).cast("int").alias("c"), F.concat_ws("_", F.lit("case"), (F.col("o_custkey") % 160).cast("string"), last.cast("string")).alias("id"))


@query(f"WITH {SPLIT_SQL}, s AS (SELECT DISTINCT split, id FROM r) SELECT a.split AS \"left\", b.split AS \"right\", count(*) AS ids FROM s a JOIN s b ON a.id = b.id AND a.split < b.split GROUP BY ALL")
def split_overlap(spark, sf_dir):
    return P.shared_ids(split_rows(spark, sf_dir), "split", "id")


@query(f"WITH {SPLIT_SQL} SELECT CAST(count(*) AS BIGINT) AS rows, count(DISTINCT id) AS ids, count(*) = count(DISTINCT id) AS \"unique\" FROM r")
def id_uniqueness(spark, sf_dir):
    return P.id_counts(split_rows(spark, sf_dir), "id")


@query(f"WITH {SPLIT_SQL} SELECT o_orderkey, split, c FROM r WHERE NOT ((split = 'train' AND c BETWEEN 0 AND 139) OR (split = 'val' AND c BETWEEN 140 AND 146) OR (split = 'test' AND c BETWEEN 147 AND 154))")
def case_range_rule(spark, sf_dir):
    return split_rows(spark, sf_dir).filter(P.outside_cases(F.col("split"), X.case_number(F.col("id")))).select("o_orderkey", "split", "c")


@query(f"WITH {SPLIT_SQL} SELECT split, CAST(count(*) AS BIGINT) AS examples, array_to_string(list_sort(list(DISTINCT c)), ',') AS cases, (SELECT string_agg(kind || '=' || n, ',' ORDER BY kind) FROM (SELECT kind, count(*) AS n FROM r x WHERE x.split = r.split GROUP BY kind)) AS types FROM r GROUP BY split")
def split_summary(spark, sf_dir):
    out = P.summary(split_rows(spark, sf_dir), "split", "c", "kind")
    types = F.array_join(F.transform(F.map_entries("types"), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ",")
    return out.select("split", "examples", F.array_join("cases", ",").alias("cases"), types.alias("types"))


@query(f"""WITH {SPLIT_SQL}, n AS (SELECT id, row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, o_orderkey) AS place FROM r),
w AS (SELECT id, row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, CASE WHEN kind = '2-HIGH' THEN o_orderkey + 40 ELSE o_orderkey END, o_orderkey) AS place FROM r)
SELECT CAST(place AS BIGINT) AS place, n.id AS expected, w.id AS found FROM n JOIN w USING (place) WHERE n.id <> w.id""")
def ordered_concat(spark, sf_dir):
    """Splits one after the other against a table in which some rows have moved."""
    r = split_rows(spark, sf_dir)
    there = D.numbered(r.select("split", "id", "o_orderkey"), "o_orderkey", "place", within="split")
    parts = [there.filter(F.col("split") == s) for s in P.CASES]
    moved = F.when(F.col("kind") == "2-HIGH", F.col("o_orderkey") + 40).otherwise(F.col("o_orderkey"))
    late = D.numbered(r.select("split", "id", (moved * 4_000_000_000 + F.col("o_orderkey")).alias("_k")), "_k", "place", within="split")
    whole = P.concatenated([late.filter(F.col("split") == s) for s in P.CASES], "place")
    return P.misplaced(P.concatenated(parts, "place"), whole, "place", "id")


@query("WITH l AS (SELECT l_orderkey, l_linestatus AS mode, l_returnflag AS flag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_linestatus DESC, l_returnflag DESC) = 1) SELECT o_orderkey, mode, flag, l.l_orderkey IS NOT NULL AS found FROM orders LEFT JOIN l ON l_orderkey = o_orderkey + 10")
def segment_last_wins(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linestatus").alias("mode"), F.col("l_returnflag").alias("flag"), F.struct("l_linenumber", "l_partkey", "l_linestatus", "l_returnflag").alias("last"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") + 10).alias("k"))
    return P.with_segment(rows, lines, ["mode", "flag"], "last", ["k"]).select("o_orderkey", "mode", "flag", "found")


# ------------------------------------------------------------------ balance

_KEYS = {t: k for k, t in enumerate([*V.PRESENCE_TARGETS, *(v for vs in V.VARIANTS.values() for v in vs)])}
_ASKED = "a AS (SELECT l_orderkey, l_linenumber, keys[CAST((l_partkey * 7 + l_linenumber) % len(keys) AS INTEGER) + 1] AS tool, l_quantity > CASE WHEN (l_partkey * 7 + l_linenumber) % len(keys) % 3 = 0 THEN 10 WHEN (l_partkey * 7 + l_linenumber) % len(keys) % 3 = 1 THEN 25 ELSE 40 END AS yes FROM lineitem, (SELECT [{}] AS keys))".format(quoted(list(_KEYS)))
_POOL = f"""s AS (SELECT p_partkey, list_filter([{quoted(V.TOOLS)}], lambda t, i: ((p_partkey >> 1) & (1 << (i - 1))) <> 0) AS tools, ['large needle driver'] AS sold FROM part),
k AS (SELECT unnest([{quoted(list(_KEYS))}]) AS tool), p AS (SELECT p_partkey, tool, CASE WHEN tool = 'forceps' THEN list_has_any(tools, [{quoted(V.FORCEPS)}]) WHEN tool IN ({quoted(V.TOOLS)}) THEN list_contains(tools, tool) ELSE list_contains(sold, tool) END AS present FROM s, k)"""


def presence_answers(spark, sf_dir):
    """Line items as answered presence questions; a key's share of yes depends on its place."""
    n = (F.col("l_partkey") * 7 + F.col("l_linenumber")) % len(_KEYS)
    yes = F.col("l_quantity") > F.when(n % 3 == 0, 10).when(n % 3 == 1, 25).otherwise(40)
    return read(spark, sf_dir, "lineitem").select(F.get(F.array(*map(F.lit, _KEYS)), n.cast("int")).alias("tool"), yes.alias("yes"))


@query(f"""WITH {_ASKED}, {_POOL}, c AS (SELECT tool, count(*) FILTER (yes) AS y, count(*) FILTER (NOT yes) AS n FROM a GROUP BY tool),
need AS (SELECT tool, CASE WHEN y / (y + n) > 0.6 THEN floor(y / 0.5) - (y + n) WHEN y / (y + n) < 0.4 THEN floor(n / 0.5) - (y + n) ELSE 0 END AS need, y / (y + n) < 0.4 AS wanted FROM c),
r AS (SELECT p.*, need, row_number() OVER (PARTITION BY tool ORDER BY sha256('b|' || p_partkey), p_partkey) AS r FROM p JOIN need USING (tool) WHERE need > 0 AND present = wanted)
SELECT p_partkey, tool, present FROM r WHERE r <= need""")
def balance_all_keys(spark, sf_dir):
    """The presence balance over all generic and variant keys, topped up from the whole pool of segments by all that each key needs."""
    made = presence_answers(spark, sf_dir)
    needs = D.answer_needs(made, "tool", F.col("yes"), cap=None)
    pool = D.presence_pool(segments(spark, sf_dir), "tool", J.presence_targets(F.col("tools"), F.col("commercial_tools")))
    return D.top_up(needs, pool, "tool", "present", "p_partkey", "b", cap=None, few_keys=True).select("p_partkey", "tool", "present")


@query(f"WITH {_ASKED} SELECT tool, CAST(count(*) FILTER (yes) AS BIGINT) AS yes, CAST(count(*) FILTER (NOT yes) AS BIGINT) AS no, CAST(count(*) AS BIGINT) AS total, round(count(*) FILTER (yes) / count(*), 6) AS share, CAST(row_number() OVER (ORDER BY count(*) DESC, tool) AS INTEGER) AS place FROM a GROUP BY tool")
def presence_stats(spark, sf_dir):
    made = presence_answers(spark, sf_dir)
    ordered = D.answer_stats(made, "tool", F.col("yes"))
    return D.numbered(ordered.withColumn("_k", -F.col("total") * 100 + F.array_position(F.array(*map(F.lit, sorted(_KEYS))), F.col("tool"))), "_k", "place").select("tool", "yes", "no", "total", six(F.col("share")).alias("share"), F.col("place").cast("int").alias("place"))


# ------------------------------------------------------------------ validation

_TOOLS = ["cadiere forceps", "bipolar forceps", "stapler"]
_GOOD = {
    "tool_presence": ("Is stapler among the tools listed as installed for this clip?", ["Yes", "Yes, a.", "Yes, b.", "Yes, c.", "Yes, d."]),
    "forceps_type": ("Which forceps types are listed as installed for this clip?", [f"{k} cadiere forceps and bipolar forceps" for k in "abcde"]),
    "tool_purpose": ("What is the purpose of using stapler in this procedure?", list("abcde")),
    "organ": ("What organ is being manipulated?", list("abcde")),
    "description": ("Describe what is happening.", list("abcde")),
}
#: Planted faults: the type of the row, what is changed (question, answers, target, tools, whether it has a segment), and the rules it must break.
_FAULTS: list[tuple[str, dict, list[str]]] = [
    ("organ", {}, []),
    ("organ", {"question": None}, ["missing_field"]),
    ("organ", {"answers": list("abcd")}, ["not_five"]),
    ("organ", {"answers": ["a", "b", "c", "d", " "]}, ["empty_reference"]),
    ("organ", {"answers": ["a", "b", "c", "d", "A "]}, ["not_unique", "organ_not_unique"]),
    ("organ", {"question": "Is this forcepss?"}, ["grammar_0"]),
    ("organ", {"question": "Is a forceps here?"}, ["grammar_1"]),
    ("organ", {"found": False}, ["no_segment"]),
    ("tool_presence", {}, []),
    ("tool_presence", {"question": "Is stapler there?"}, ["presence_wording"]),
    ("tool_presence", {"question": "Is stapler listed and being used?"}, ["presence_claim"]),
    ("tool_presence", {"target": "clip applier"}, ["presence_label"]),
    ("tool_presence", {"target": "forceps"}, []),
    ("tool_presence", {"target": "stapler 45"}, ["presence_label"]),
    ("forceps_type", {}, []),
    ("forceps_type", {"answers": ["cadiere forceps", *(f"{k} cadiere forceps and bipolar forceps" for k in "bcde")]}, ["forceps_omitted"]),
    ("forceps_type", {"question": "Which forceps type is listed?"}, ["forceps_singular"]),
    ("tool_purpose", {}, []),
    ("tool_purpose", {"tools": []}, ["purpose_no_tool"]),
    ("tool_purpose", {"question": "What is the purpose of using clip applier?"}, ["purpose_other_tool"]),
    ("description", {}, []),
    ("description", {"answers": ["a", "b", "c", "d", "the annotator left"]}, ["description_placeholder"]),
    ("description", {"double": "same"}, []),
    ("description", {"double": "same"}, ["duplicate"]),
    ("description", {"double": "other"}, []),
    ("description", {"double": "other", "answers": list("vwxyz")}, ["conflict"]),
]


def planted(spark, sf_dir):
    """For every part one question row of each planted fault (and of none), with the fault's number."""
    rows = []
    for k, (kind, fault, _) in enumerate(_FAULTS):
        question, answers = _GOOD[kind]
        tools = fault.get("tools", _TOOLS)
        rows.append((k, kind, fault.get("question", question), fault.get("answers", answers), fault.get("target", "stapler" if kind == "tool_presence" else None), tools, fault.get("found", True), fault.get("double", str(k))))
    faults = spark.createDataFrame(rows, "fault int, question_type string, question string, answers array<string>, tool string, tools array<string>, found boolean, place string")
    # broadcast: the list above
    met = dealt(read(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(len(_FAULTS) - 1))).alias("fault")).join(F.broadcast(faults), "fault")
    each = F.concat_ws("_", F.lit("case"), "p_partkey", "fault")
    return met.select("p_partkey", "fault", each.alias("id"), F.concat_ws("/", F.col("p_partkey").cast("string"), "place").alias("video"), F.lit(0.0).alias("t_start"), F.lit(30.0).alias("t_end"), "question", "answers", "tool", "question_type", "tools", F.array(F.lit("large needle driver")).alias("commercial_tools"), "found", F.lit("semantic_task_label").alias("grounding_status"), F.col("fault").alias("ord"))


_EXPECTED = ", ".join(f"({k}, '{r}')" for k, (_, _, rules) in enumerate(_FAULTS) for r in rules)


@query(f"SELECT p_partkey, CAST(fault AS INTEGER) AS fault, rule FROM part, (VALUES {_EXPECTED}) AS f(fault, rule)")
def rule_catalogue(spark, sf_dir):
    """The whole catalogue of row rules over rows with one planted fault each: just the planted ones may be found."""
    return C.violations(C.normalized(planted(spark, sf_dir)), C.answer_rules(ready=True), C.STOPS).select("p_partkey", "fault", "rule")


# ------------------------------------------------------------------ evaluation


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS place, c.c_name AS prediction FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS p FROM orders) o JOIN (SELECT c_name, row_number() OVER (ORDER BY c_custkey) AS p, count(*) OVER () AS n FROM customer) c ON (o.p - 1) % c.n + 1 = c.p")
def positional_join(spark, sf_dir):
    """Predictions joined with items by their place in order; both sides must have the same places."""
    items = D.numbered(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "place")
    names = D.numbered(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", "p")
    n = names.count()
    said = items.select("place", ((F.col("place") - 1) % n + 1).alias("p")).join(names, "p").select("place", F.col("c_name").alias("prediction"))
    return M.aligned(items, said, "place", ["prediction"]).select("o_orderkey", "place", "prediction")


@query("SELECT doc_id, lang, quality = 1 AS truth FROM documents JOIN labels USING (doc_id) WHERE lang IN ('en', 'de') AND n_chars % 5 <> 0")
def binary_filter(spark, sf_dir):
    """Rows of two types whose first reference says yes or no."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    said = F.when(F.col("n_chars") % 5 == 0, "Perhaps.").when(F.col("quality") == 1, "Yes, it is.").otherwise(" No")
    return M.binary_records(d.withColumn("answers", F.array(said, F.lit("no"))), "lang", "answers", ["en", "de"]).select("doc_id", "lang", "truth")


@query(f"""WITH {MARGINS.replace('l.quality = 1 AS truth', "l.quality = 1 AS truth, CASE WHEN d.n_chars % 4 = 0 THEN 'No idea' WHEN d.n_chars % 4 = 1 THEN 'perhaps' ELSE 'Yes.' END AS greedy")}, g AS (SELECT (i - 30) / 10.0::DOUBLE AS threshold FROM range(61) t(i)),
s AS (SELECT kind, threshold, avg(CASE WHEN (margin >= threshold) = truth THEN 1.0::DOUBLE ELSE 0.0 END) AS acc FROM m, g GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY acc DESC, threshold) AS k FROM s),
f AS (SELECT kind, count(*) AS n, avg(CAST(truth AS INTEGER)) AS yes_rate, avg(CASE WHEN (greedy = 'Yes.' AND truth) OR (greedy = 'No idea' AND NOT truth) THEN 1.0::DOUBLE ELSE 0.0 END) AS greedy FROM m GROUP BY kind)
SELECT f.kind, CAST(f.n AS BIGINT) AS n, round(f.yes_rate, 6) AS yes_rate, round(f.greedy, 6) AS greedy_accuracy, round(z.acc, 6) AS accuracy_at_0, r.threshold AS best_threshold, round(r.acc, 6) AS best_accuracy FROM f JOIN r ON r.kind = f.kind AND r.k = 1 JOIN s z ON z.kind = f.kind AND z.threshold = 0""")
def calibration_report(spark, sf_dir):
    said = F.when(F.col("m") % 4 == 0, "No idea").when(F.col("m") % 4 == 1, "perhaps").otherwise("Yes.")
    rows = margins(spark, sf_dir, "n_chars").withColumn("m", F.col("n_chars")).withColumn("greedy", said)
    out = M.calibration_report(rows, "kind", "margin", "truth", "greedy", M.GRID)
    return out.select("kind", "n", *(six(F.col(c)).alias(c) for c in ("yes_rate", "greedy_accuracy", "accuracy_at_0")), "best_threshold", six(F.col("best_accuracy")).alias("best_accuracy"))


@query("""WITH w AS (SELECT conv_id, turn, role, list_distinct(string_split(lower(text), ' ')) AS own FROM conversations), r AS (SELECT conv_id, list(own) AS refs FROM w WHERE role = 'assistant' GROUP BY conv_id),
s AS (SELECT w.role, coalesce(list_max(list_transform(r.refs, lambda x: len(list_intersect(w.own, x)) / len(x))), 0.0) AS best FROM w LEFT JOIN r USING (conv_id))
SELECT role, CAST(grouping(role) AS INTEGER) AS is_total, CAST(count(*) AS BIGINT) AS n, round(avg(best), 6) AS best FROM s GROUP BY ROLLUP (role)""")
def best_reference_mean(spark, sf_dir):
    """The mean over rows of the best score over references; the score is the share of a reference's words."""
    w = read(spark, sf_dir, "conversations").select("conv_id", "role", F.array_distinct(F.split(F.lower("text"), " ")).alias("own"))
    # alike rows are scored once; pairs of a turn and a reference go straight into a partial maximum, so no list of references is made
    turns = w.groupBy("conv_id", "role", "own").agg(F.count("*").cast("int").alias("times"))
    refs = w.filter("role = 'assistant'").select("conv_id", F.col("own").alias("ref")).distinct()
    share = F.size(F.array_intersect("own", "ref")) / F.size("ref")
    best = turns.join(refs, "conv_id", "left").groupBy("conv_id", "role", "own", "times").agg(F.coalesce(F.max(share), F.lit(0.0)).alias("best"))
    rows = best.select("role", "best", F.explode(F.array_repeat(F.lit(1), F.col("times"))))
    return M.score_rollup(rows, "role", ["best"]).select("role", "is_total", "n", six(F.col("best")).alias("best"))


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 300")
def first_per_type(spark, sf_dir):
    return S.first_per_group(read(spark, sf_dir, "events").select("event_id", "event_type"), ["event_type"], "event_id", 300)


@query("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 500")
def head_limit(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", "user_id").orderBy("event_id").limit(500)


BLEU_SQL = """b AS (SELECT item_id, text, string_split(text, ' ') AS w FROM benchmark), t AS (SELECT item_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS cand, unnest([lower(reverse(text)), lower(array_to_string(w[1:greatest(len(w) - 3, 1)], ' '))]) AS ref FROM b),
x AS (SELECT item_id, string_split(cand, ' ') AS c, string_split(trim(regexp_replace(ref, '\\s+', ' ', 'g')), ' ') AS r FROM t),
g AS (SELECT *, list_transform([1, 2, 3, 4], lambda n: list_transform(range(1, len(c) - n + 2), lambda i: array_to_string(c[i:i + n - 1], chr(1)))) AS cg, list_transform([1, 2, 3, 4], lambda n: list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], chr(1)))) AS rg FROM x),
h AS (SELECT *, list_transform([1, 2, 3, 4], lambda n: coalesce(list_sum(list_transform(list_distinct(cg[n]), lambda u: least(len(list_filter(cg[n], lambda y: y = u)), len(list_filter(rg[n], lambda z: z = u))))), 0)) AS hits FROM g),
s AS (SELECT item_id, CASE WHEN hits[1] = 0 THEN 0.0 ELSE exp((CASE WHEN len(c) > len(r) THEN 0.0 ELSE 1 - len(r) / len(c) END) + list_sum(list_transform([1, 2, 3, 4], lambda n: ln((CASE WHEN hits[n] > 0 THEN hits[n] ELSE 0.1::DOUBLE END) / greatest(len(c) - n + 1, 1)))) / 4) END AS bleu FROM h)"""


@query(f"WITH {BLEU_SQL} SELECT item_id, round(max(bleu), 6) AS bleu FROM s GROUP BY item_id")
def bleu4_best(spark, sf_dir):
    """Best BLEU-4 of every benchmark item against its reversed text and the text without its last words."""
    b = read(spark, sf_dir, "benchmark")
    words = F.split("text", " ")
    short = F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 3, F.lit(1))), " ")
    return b.select("item_id", six(M.best_reference(F.array(F.reverse("text"), short), F.col("text"))).alias("bleu"))


@query(f"""WITH {ASK_SQL}, q3 AS (SELECT *, {ROUTES} AS route FROM q2) SELECT p_partkey, CASE WHEN trim(a) <> '' AND route IN ('free_generation', 'tool_presence', 'tissue_cutting', 'suture_required') THEN a WHEN route IN ('tool_presence', 'tissue_cutting', 'suture_required') THEN 'Yes' WHEN route = 'free_generation' THEN CASE WHEN bin THEN 'Yes' ELSE 'The surgical field is visible in this clip.' END ELSE route END AS response FROM q3""")
def response_fallback(spark, sf_dir):
    """A response for every question: free answers as they are, blank ones by the fallback; routes of closed vocabularies by name."""
    rows = asked(spark, sf_dir)
    way = X.route(F.col("q"))
    free = way.isin("free_generation", "tool_presence", "tissue_cutting", "suture_required")
    said = F.coalesce(F.when(F.trim("a") != "", F.col("a")), X.fallback_answer(F.col("q")))
    return rows.select("p_partkey", F.when(free, said).otherwise(way).alias("response"))


# ------------------------------------------------------------------ models and keys


def _length_model():
    """Stands for a model: the margin is the length of the question against its words."""

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        words = rows["q"].str.split(" ").str.len()
        return pd.DataFrame({"margin": rows["q"].str.len() / 10.0 - words, "words": words})

    return score


@query(f"WITH {ASK_SQL} SELECT p_partkey, round(length(q) / 10.0 - len(string_split(q, ' ')), 6) AS margin, CAST(len(string_split(q, ' ')) AS BIGINT) AS words FROM q2")
def model_scores(spark, sf_dir):
    out = O.scored(asked(spark, sf_dir), _length_model, ["q"], "margin double, words bigint")
    return out.select("p_partkey", six(F.col("margin")).alias("margin"), "words")


@query("SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 8) AS k, 112 AS pixels, 'base' AS name, false AS fusion FROM events")
def config_defaults(spark, sf_dir):
    made = O.config(F.col("props"), {"k": 8, "pixels": 112, "name": "base", "fusion": False})
    return read(spark, sf_dir, "events").select("event_id", made.alias("c")).select("event_id", "c.k", F.col("c.pixels").cast("int").alias("pixels"), "c.name", "c.fusion")


@query("""WITH w AS (SELECT o_orderkey, string_split(o_orderpriority || ' ' || o_orderstatus, ' ') AS f FROM orders)
SELECT o_orderkey, array_to_string(list_sort(list_filter(['1-URGENT', 'F', 'O'], lambda x: NOT list_contains(f, x))), ',') AS missing, array_to_string(list_sort(list_filter(f, lambda x: NOT list_contains(['1-URGENT', 'F', 'O'], x))), ',') AS unexpected FROM w""")
def key_check(spark, sf_dir):
    found = F.split(F.concat_ws(" ", "o_orderpriority", "o_orderstatus"), " ")
    checked = O.key_check(F.array(*map(F.lit, ["1-URGENT", "F", "O"])), F.array_distinct(found))
    return read(spark, sf_dir, "orders").select("o_orderkey", checked.alias("k")).select("o_orderkey", F.array_join("k.missing", ",").alias("missing"), F.array_join("k.unexpected", ",").alias("unexpected"))


@query("SELECT p_partkey, replace(replace('module.backbone.' || p_name || '.weight', 'module.', ''), 'backbone.', '') AS name, p_size AS value FROM part")
def clean_keys(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("m", O.clean_keys(F.create_map(F.concat(F.lit("module.backbone."), "p_name", F.lit(".weight")), F.col("p_size"))))
    return p.select("p_partkey", F.explode("m").alias("name", "value"))


@query("SELECT conv_id, turn, array_to_string(list_transform(range(1, len(string_split(text, ' ')) % 4 + 1), lambda i: i + turn * 10), ',') AS places FROM conversations")
def position_offsets(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    base = F.array((F.col("turn") * 10).cast("long"), F.lit(0).cast("long"))
    after = O.positions_after(base, (F.size(F.split("text", " ")) % 4).cast("long"))
    return c.select("conv_id", "turn", F.array_join(after, ",").alias("places"))


@query(r"""WITH e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '/data/Root/' ELSE '/other/' END || 'case_' || user_id || '/v.mp4' AS video, event_id % 100 AS a FROM events)
SELECT event_id, md5(video || '|' || a || '.0|' || (a + 30) || '.0') AS key, CASE WHEN event_id % 2 = 0 THEN md5('d:\old\' || replace(substr(video, 7), '/', '\') || '|' || a || '.0|' || (a + 30) || '.0') END AS legacy FROM e""")
def cache_keys(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    video = F.concat(F.when(F.col("event_id") % 2 == 0, "/data/Root/").otherwise("/other/"), F.lit("case_"), F.col("user_id").cast("string"), F.lit("/v.mp4"))
    start = (F.col("event_id") % 100).cast("double")
    keys = X.cache_keys(video, start, start + 30, "root", r"d:\old")
    return e.select("event_id", keys.alias("k")).select("event_id", F.get("k", F.lit(0)).alias("key"), F.get("k", F.lit(1)).alias("legacy"))
