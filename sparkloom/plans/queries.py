"""The curation queries on the driver's tables, each with the SQL that must give the same rows.

Roles: a user of ``events`` is a case, an event up to the user's next one a
labelled interval, ``documents`` free text, ``labels`` truth, ``embeddings``
token tensors, ``conversations`` chat turns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom import vocab as V
from sparkloom.functions import arrays as A
from sparkloom.functions import text as X
from sparkloom.operators import curate as C
from sparkloom.operators import dedup as D
from sparkloom.operators import intervals as I
from sparkloom.operators import measure as M
from sparkloom.operators import sampling as S
from sparkloom.operators import templates as T
from sparkloom.plans import jobs as J

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def six(c: Column) -> Column:
    return F.round(c, 6)


FRACTION = "(CAST('0x' || substr(sha256({}), 1, 16) AS UBIGINT)::DOUBLE / 18446744073709551616.0)"
HOUR = 3_600_000_000
SIZE, STEP = 12 * HOUR, 6 * HOUR

# ------------------------------------------------------------------ time lines

TIMELINE = "e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS us FROM events), o AS (SELECT user_id, min(us) AS t0, max(us) - min(us) AS duration FROM e GROUP BY user_id), iv AS (SELECT e.user_id, event_type, event_id AS ord, us - t0 AS i_start, lead(us) OVER (PARTITION BY e.user_id ORDER BY us, event_id) - t0 AS i_end FROM e JOIN o USING (user_id)), i AS (SELECT * FROM iv WHERE i_end > i_start)"
WINDOWS = f"w AS (SELECT user_id, k * {STEP} AS t_start, CASE WHEN duration >= {SIZE} THEN k * {STEP} + {SIZE} ELSE duration END AS t_end FROM (SELECT *, unnest(CASE WHEN duration >= {SIZE} THEN range(0, (duration - {SIZE}) // {STEP} + 1) WHEN duration > 0 THEN [0] ELSE [] END) AS k FROM o))"


def lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Time lines of users in microseconds from their first event: durations, and labelled intervals."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    own = e.groupBy("user_id").agg(F.min("us").alias("t0"), (F.max("us") - F.min("us")).alias("duration"))
    moved = e.join(own, "user_id").withColumn("us", F.col("us") - F.col("t0"))
    return own.select("user_id", "duration"), I.timeline(moved, "user_id", "us", "event_id", "event_type")


def windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parts, own = lines(spark, sf_dir)
    return I.sliding_windows(parts, SIZE, STEP).select("user_id", "t_start", "t_end"), own


@query("SELECT event_id, coalesce(try_cast(p[1] AS DOUBLE) * 3600 + try_cast(p[2] AS DOUBLE) * 60 + try_cast(p[3] AS DOUBLE), 0.0) AS seconds, 0.0 AS odd FROM (SELECT event_id, string_split(strftime(ts, '%H:%M:%S'), ':') AS p FROM events)")
def clock_parse(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", X.clock_seconds(F.date_format("ts", "HH:mm:ss")).alias("seconds"), X.clock_seconds(F.col("event_type")).alias("odd"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS size_key, lower(trim(p_brand)) AS brand_key, CAST(p_size AS VARCHAR) AS float_key FROM part")
def join_key_norm(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", X.join_key(F.col("p_size")).alias("size_key"), X.join_key(F.col("p_brand")).alias("brand_key"), X.join_key(F.col("p_size").cast("double")).alias("float_key"))


@query(f"WITH {TIMELINE}, {WINDOWS} SELECT user_id, CAST(t_start AS BIGINT) AS t_start, CAST(t_end AS BIGINT) AS t_end FROM w")
def window_starts(spark, sf_dir):
    return windows(spark, sf_dir)[0]


@query(f"""WITH {TIMELINE}, p AS (SELECT i.*, CAST(unnest(range(i_start // {24 * HOUR}, i_end // {24 * HOUR} + 1)) AS INTEGER) AS part FROM i),
l AS (SELECT user_id, ord, part, CASE WHEN part = i_start // {24 * HOUR} THEN i_start % {24 * HOUR} ELSE 0 END AS l_start, CASE WHEN part = i_end // {24 * HOUR} THEN i_end % {24 * HOUR} ELSE {24 * HOUR} END AS l_end FROM p)
SELECT user_id, ord, part, CAST(l_start AS BIGINT) AS l_start, CAST(l_end AS BIGINT) AS l_end FROM l WHERE l_end > l_start""")
def local_intervals(spark, sf_dir):
    day = 24 * HOUR
    _, own = lines(spark, sf_dir)
    cell = lambda c: F.floor(F.col(c) / day).cast("int")
    rows = own.withColumn("part", F.explode(F.sequence(cell("i_start"), cell("i_end"))))
    a, b = I.local_interval(F.col("part"), F.lit(day), cell("i_start"), F.col("i_start") % day, cell("i_end"), F.col("i_end") % day)
    return rows.select("user_id", "ord", "part", a.alias("l_start"), b.alias("l_end")).filter("l_start IS NOT NULL")


OVERLAP = "SELECT w.user_id, w.t_start, w.t_end, i.ord, i.event_type, least(w.t_end, i_end) - greatest(w.t_start, i_start) AS ov FROM w JOIN i ON w.user_id = i.user_id AND w.t_start < i.i_end AND i.i_start < w.t_end"


@query(f"WITH {TIMELINE}, {WINDOWS} SELECT user_id, CAST(t_start AS BIGINT) AS t_start, ord, CAST(ov AS BIGINT) AS overlap FROM ({OVERLAP})")
def overlap_join(spark, sf_dir):
    w, i = windows(spark, sf_dir)
    return I.overlap_join(w, i, ["user_id"]).select("user_id", "t_start", "ord", "overlap")


@query(f"WITH {TIMELINE}, {WINDOWS} SELECT user_id, CAST(t_start AS BIGINT) AS t_start, ord, CAST(ov AS BIGINT) AS overlap FROM ({OVERLAP})")
def overlap_join_bucketed(spark, sf_dir):
    w, i = windows(spark, sf_dir)
    return I.overlap_join(w, i, ["user_id"], bucket=24 * HOUR).select("user_id", "t_start", "ord", "overlap")


@query(f"""WITH {TIMELINE}, {WINDOWS}, m AS ({OVERLAP}), b AS (SELECT *, row_number() OVER (PARTITION BY user_id, t_start ORDER BY ov DESC, ord) AS r FROM m)
SELECT w.user_id, CAST(w.t_start AS BIGINT) AS t_start, CAST(w.t_end AS BIGINT) AS t_end, CASE WHEN b.ov * 2 >= w.t_end - w.t_start THEN b.event_type ELSE 'Other' END AS event_type, CAST(coalesce(b.ov, 0) AS BIGINT) AS best_overlap
FROM w LEFT JOIN b ON b.user_id = w.user_id AND b.t_start = w.t_start AND b.r = 1""")
def seg_majority_label(spark, sf_dir):
    w, i = windows(spark, sf_dir)
    return I.majority_label(w, i, ["user_id"], "event_type", "ord", bucket=24 * HOUR).select("user_id", "t_start", "t_end", "event_type", "best_overlap")


@query(f"""WITH {TIMELINE}, {WINDOWS}, m AS ({OVERLAP}), s AS (SELECT user_id, t_start, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS active FROM m GROUP BY user_id, t_start)
SELECT w.user_id, CAST(w.t_start AS BIGINT) AS t_start, coalesce(s.active, '') AS active FROM w LEFT JOIN s USING (user_id, t_start)""")
def seg_active_set(spark, sf_dir):
    w, i = windows(spark, sf_dir)
    return I.active_sets(w, i, ["user_id"], {"active": "event_type"}, bucket=24 * HOUR).select("user_id", "t_start", F.array_join("active", ",").alias("active"))


@query("""WITH r AS (SELECT event_id, event_id % 3600 AS a, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN event_id % 3600 - 5 ELSE event_id % 3600 + 60 END AS b FROM events)
SELECT event_id, CAST(a AS BIGINT) AS begin, CAST(CASE WHEN b > a THEN b WHEN b = 0 AND 3000 > a THEN 3000 END AS BIGINT) AS until FROM r WHERE b > a OR (b = 0 AND 3000 > a)""")
def corrupt_interval_filter(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("begin", F.col("event_id") % 3600)
    e = e.withColumn("b", F.when(F.col("event_id") % 5 == 0, 0).when(F.col("event_id") % 5 == 1, F.col("begin") - 5).otherwise(F.col("begin") + 60))
    return e.select("event_id", "begin", I.repaired(F.col("begin"), F.col("b"), F.lit(3000).cast("long")).cast("long").alias("until")).filter("until IS NOT NULL")


@query("SELECT p_partkey, p_name FROM part WHERE lower(trim(p_type)) IN ('economy', 'standard', 'promo') AND p_name <> 'unknown instrument' AND trim(p_name) <> ''")
def vocab_semi_join(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    kinds = spark.createDataFrame([("economy",), ("standard",), ("promo",)], "kind string")  # a fixed vocabulary
    return p.join(F.broadcast(kinds), F.lower(F.trim("p_type")) == F.col("kind"), "left_semi").filter((F.col("p_name") != V.UNKNOWN_COMMERCIAL) & (F.trim("p_name") != "")).select("p_partkey", "p_name")


@query("""WITH l AS (SELECT CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey % 50 END AS k, o_orderpriority AS label, o_orderkey FROM orders),
f AS (SELECT k, arg_min(label, o_orderkey) AS label FROM l GROUP BY k)
SELECT c_custkey, coalesce(f.label, '') AS label FROM (SELECT *, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey % 60 END AS k FROM customer) c LEFT JOIN f ON c.k IS NOT DISTINCT FROM f.k""")
def lookup_first_wins(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey") % 50).alias("k"), F.col("o_orderpriority").alias("label"), "o_orderkey")
    c = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 11 != 0, F.col("c_custkey") % 60).alias("k"))
    return I.enrich_first(c, o, ["k"], "label", "o_orderkey").select("c_custkey", "label")


# ------------------------------------------------------------------ joins and lookups


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def referential_anti(spark, sf_dir):
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


AUDIT = """a AS (SELECT source AS video, CAST(n_chars % 7 AS DOUBLE) AS t_start, CAST(n_chars % 7 + 30 AS DOUBLE) AS t_end, CASE WHEN doc_id % 3 = 0 THEN 'cache16' ELSE 'raw' END AS src, doc_id % 5 = 0 AS all_nb, doc_id % 4 = 0 AS any_nb FROM documents),
c AS (SELECT DISTINCT source AS video, CAST(n_chars % 7 AS DOUBLE) AS t_start, CAST(n_chars % 7 + 30 AS DOUBLE) AS t_end FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND quality = 0),
st AS (SELECT video, t_start, t_end, max(CASE WHEN (starts_with(src, 'cache') AND all_nb) OR c.video IS NOT NULL THEN 2 WHEN any_nb THEN 1 ELSE 0 END) AS r FROM a LEFT JOIN c USING (video, t_start, t_end) GROUP BY ALL)"""


def audits(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    key = [F.col("source").alias("video"), (F.col("n_chars") % 7).cast("double").alias("t_start"), (F.col("n_chars") % 7 + 30).cast("double").alias("t_end")]
    audit = d.select(*key, F.when(F.col("doc_id") % 3 == 0, "cache16").otherwise("raw").alias("source"), (F.col("doc_id") % 5 == 0).alias("all_near_black"), (F.col("doc_id") % 4 == 0).alias("any_near_black"))
    sure = d.join(read(spark, sf_dir, "labels"), "doc_id").select(*key, ((F.col("toxic") == 1) & (F.col("quality") == 0)).alias("all_three_near_black"))
    return audit, sure


@query(f"WITH {AUDIT} SELECT video, t_start, t_end, CASE r WHEN 2 THEN 'fully_black' ELSE 'partially_black' END AS visual_status FROM st WHERE r > 0")
def status_flag_join(spark, sf_dir):
    return C.visual_status(*audits(spark, sf_dir))


@query("""SELECT o_orderkey, CASE WHEN c.c_custkey IS NOT NULL THEN 'customer' WHEN s.s_suppkey IS NOT NULL THEN 'supplier' END AS found_in, coalesce(c.c_nationkey, s.s_nationkey, -1) AS nation
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal < 0) c ON o_custkey = c_custkey LEFT JOIN supplier s ON o_custkey = s_suppkey""")
def fallback_chain_join(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    c = read(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"))
    return M.first_hit(o, [("customer", c), ("supplier", s)], "k", "nation").select("o_orderkey", "found_in", F.coalesce("nation", F.lit(-1)).alias("nation"))


PLAN = "SELECT doc_id, n, list_transform(range(8), lambda i: least(greatest(CAST(floor(CASE WHEN i = 7 THEN greatest(n - 1.0, 0.0) ELSE i * (greatest(n - 1.0, 0.0) / 7) END) AS BIGINT), 0), n - 1)) AS p FROM (SELECT doc_id, n_chars AS n FROM documents)"


@query(f"WITH p AS ({PLAN}), x AS (SELECT doc_id, unnest(p) AS idx FROM p), u AS (SELECT DISTINCT x.doc_id, idx, substr(text, CAST(idx + 1 AS INTEGER), 1) AS ch FROM x JOIN documents USING (doc_id)) SELECT x.doc_id, x.idx, CAST(count(*) AS BIGINT) AS uses, min(ch) AS ch FROM x JOIN u ON u.doc_id = x.doc_id AND u.idx = x.idx GROUP BY ALL")
def fanout_join(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    indices = A.index_plan(F.col("n_chars"), 8)
    plan = d.select("doc_id", F.posexplode(indices).alias("place", "idx"))
    # each character is read once, where the text is; only it is shuffled
    once = d.select("doc_id", F.explode(F.transform(F.array_distinct(indices), lambda i: F.struct(i.alias("idx"), F.substring("text", i.cast("int") + 1, F.lit(1)).alias("ch")))).alias("c")).select("doc_id", "c.*")
    return plan.join(once, ["doc_id", "idx"]).groupBy("doc_id", "idx").agg(F.count("*").alias("uses"), F.min("ch").alias("ch"))


SLOTS = ", ".join(f"('{t}', {i})" for t, n in V.TYPE_SLOTS.items() for i in range(n))


@query(f"SELECT p_partkey, slot_type, CAST(slot AS INTEGER) AS slot FROM (SELECT p_partkey, slot_type, slot, row_number() OVER (PARTITION BY p_partkey ORDER BY sha256('slots|' || p_partkey || '|' || slot_type || '|' || slot)) AS r FROM part, (VALUES {SLOTS}) AS s(slot_type, slot)) WHERE r <= 3")
def slot_cross_join(spark, sf_dir):
    return S.slots(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey", V.TYPE_SLOTS, 3, "slots")


MARGINS = "m AS (SELECT d.lang AS kind, CAST((d.n_chars % 61) - 30 AS DOUBLE) / 10 + CASE WHEN l.quality = 1 THEN 0.7 ELSE -0.4 END AS margin, l.quality = 1 AS truth FROM documents d JOIN labels l USING (doc_id))"


def margins(spark, sf_dir, *more):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return d.select(*more, F.col("lang").alias("kind"), (((F.col("n_chars") % 61) - 30).cast("double") / 10 + F.when(F.col("quality") == 1, 0.7).otherwise(-0.4)).alias("margin"), (F.col("quality") == 1).alias("truth"))


@query(f"""WITH {MARGINS}, g AS (SELECT (i - 30) / 10.0::DOUBLE AS threshold FROM range(61) t(i)), s AS (SELECT kind, threshold, count(*) AS n, avg(CASE WHEN (margin >= threshold) = truth THEN 1.0::DOUBLE ELSE 0.0 END) AS acc FROM m, g GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY acc DESC, threshold) AS k FROM s)
SELECT r.kind, CAST(r.n AS BIGINT) AS n, r.threshold AS best_threshold, round(r.acc, 6) AS best_accuracy, round(z.acc, 6) AS accuracy_at_0 FROM r JOIN s z ON z.kind = r.kind AND z.threshold = 0 WHERE k = 1""")
def grid_sweep(spark, sf_dir):
    out = M.calibrated(margins(spark, sf_dir), "kind", "margin", "truth", M.GRID)
    return out.select("kind", "n", "best_threshold", six(F.col("best_accuracy")).alias("best_accuracy"), six(F.col("accuracy_at_0")).alias("accuracy_at_0"))


# ------------------------------------------------------------------ sampling, balance, dedup


@query("SELECT user_id, CASE WHEN dense_rank() OVER (ORDER BY user_id) <= least(100, (SELECT count(DISTINCT user_id) FROM events) - 1) THEN 'train' ELSE 'val' END AS split FROM (SELECT DISTINCT user_id FROM events)")
def case_split(spark, sf_dir):
    users = read(spark, sf_dir, "events").select("user_id").distinct()
    return D.split_by_rank(users, "user_id", min(100, users.count() - 1)).select("user_id", "split")


@query("""WITH f AS (SELECT event_id, user_id, event_type <> 'view' AS i FROM events), q AS (SELECT user_id, least(count(*) FILTER (i), 24) AS n FROM f GROUP BY user_id),
r AS (SELECT f.*, n, row_number() OVER (PARTITION BY f.user_id, i ORDER BY sha256('s|' || event_id), event_id) AS r FROM f JOIN q USING (user_id))
SELECT event_id, user_id FROM r WHERE r <= CASE WHEN i THEN n ELSE 30 - n END""")
def stratified_quota_sample(spark, sf_dir):
    return S.stratified(read(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") != "view", 30, 0.8, "s").select("event_id", "user_id")


@query(f"SELECT doc_id FROM documents WHERE {FRACTION.format('CAST(doc_id AS VARCHAR)')} < 0.1")
def hash_sample(spark, sf_dir):
    return S.keep_fraction(read(spark, sf_dir, "documents"), "doc_id", 0.1).select("doc_id")


@query(f"""WITH c AS (SELECT conv_id, turn, role, {FRACTION.format("conv_id || ':' || turn")} AS f FROM conversations)
SELECT conv_id, turn, CASE WHEN f < 0.55 THEN role ELSE ['a', 'b', 'c', 'd'][CAST(least(floor((f - 0.55) / (1 - 0.55) * 4), 3) AS INTEGER) + 1] END AS pick FROM c""")
def weighted_choice(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    key = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    return c.select("conv_id", "turn", S.weighted_choice(F.col("role"), F.array(*map(F.lit, "abcd")), key).alias("pick"))


@query(f"SELECT p_partkey, ['one', 'two', 'three'][CAST(least(floor({FRACTION.format('CAST(p_partkey AS VARCHAR)')} * 3), 2) AS INTEGER) + 1] AS template FROM part")
def template_choice(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", S.choose(["one", "two", "three"], F.col("p_partkey")).alias("template"))


NEED = "c AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'N') AS yes, count(*) FILTER (l_returnflag <> 'N') AS no FROM lineitem GROUP BY l_suppkey), n AS (SELECT l_suppkey, yes, no, CASE WHEN yes / (yes + no) > 0.6 THEN least(floor(yes / 0.5) - (yes + no), 600) WHEN yes / (yes + no) < 0.4 THEN least(floor(no / 0.5) - (yes + no), 600) ELSE 0 END AS need, CASE WHEN yes / (yes + no) > 0.6 THEN 'no' WHEN yes / (yes + no) < 0.4 THEN 'yes' END AS wanted FROM c)"


@query(f"WITH {NEED} SELECT l_suppkey, CAST(yes AS BIGINT) AS yes, CAST(no AS BIGINT) AS no, CAST(greatest(need, 0) AS BIGINT) AS need, wanted FROM n")
def balance_need(spark, sf_dir):
    return D.answer_needs(read(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_returnflag") == "N")


@query(f"""WITH {NEED}, p AS (SELECT o_orderkey, o_custkey % 100 AS l_suppkey, o_orderstatus = 'F' AS y FROM orders),
r AS (SELECT p.*, need, row_number() OVER (PARTITION BY l_suppkey ORDER BY sha256('t|' || o_orderkey), o_orderkey) AS r FROM p JOIN n USING (l_suppkey) WHERE need > 0 AND CASE WHEN y THEN 'yes' ELSE 'no' END = wanted)
SELECT o_orderkey, l_suppkey FROM r WHERE r <= need""")
def balance_topup(spark, sf_dir):
    needs = D.answer_needs(read(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_returnflag") == "N")
    pool = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("l_suppkey"), (F.col("o_orderstatus") == "F").alias("y"))
    return D.top_up(needs, pool, "l_suppkey", "y", "o_orderkey", "t").select("o_orderkey", "l_suppkey")


@query("""WITH g AS (SELECT event_id, user_id % 5 AS grp, CASE WHEN event_type IN ('view', 'click', 'error') THEN 'x' ELSE event_type END AS answer FROM events), c AS (SELECT grp, answer, count(*) AS n, min(event_id) AS f FROM g GROUP BY ALL),
t AS (SELECT grp, arg_max(answer, n * 1000000000 - f) AS top, max(n) AS dom, sum(n) AS al FROM c GROUP BY grp), k AS (SELECT grp, top, CASE WHEN dom > 0.5 * al THEN least(greatest(floor(0.5 * (al - dom) / 0.5), 0), dom) ELSE dom END AS keep FROM t),
r AS (SELECT g.*, row_number() OVER (PARTITION BY grp, answer ORDER BY sha256('c|' || event_id), event_id) AS r FROM g)
SELECT event_id, grp, answer FROM r JOIN k USING (grp) WHERE answer <> top OR r <= keep""")
def cap_dominant(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 5).alias("grp"), F.when(F.col("event_type").isin("view", "click", "error"), "x").otherwise(F.col("event_type")).alias("answer"))
    return D.cap_dominant(e, "grp", "answer", "event_id", "event_id", 0.5, "c").select("event_id", "grp", "answer")


NORM = "trim(regexp_replace(lower({}), '[\\s\\x0B\\x1C-\\x1F\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({NORM.format('text')}) AS norm FROM documents")
def norm_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(X.normalize(F.col("text"))).alias("norm"))


@query(f"SELECT min(doc_id) AS doc_id, md5({NORM.format('text')}) AS norm FROM documents GROUP BY 2")
def semantic_dedup(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("norm", F.md5(X.normalize(F.col("text"))))
    return D.dedup_or_fail(d, ["norm"], "doc_id", F.col("norm")).select("doc_id", "norm")


@query("""WITH r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, n_chars % 10 ORDER BY doc_id) AS k, first(lang) OVER (PARTITION BY source, n_chars % 10 ORDER BY doc_id) AS f FROM documents)
SELECT doc_id, k = 1 AS first_in_key, lang <> f AS conflict FROM r""")
def conflict_check(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("k", F.col("n_chars") % 10)
    return D.first_signature(d, ["source", "k"], "doc_id", F.col("lang")).select("doc_id", "first_in_key", "conflict")


@query("""WITH i AS (SELECT doc_id, lang || '_' || source || '_' || (100 + n_chars % 20) AS id FROM documents), m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_id) > 1 AS dup FROM i),
n AS (SELECT *, 999 + sum(CAST(dup AS INTEGER)) OVER (ORDER BY doc_id) AS num FROM m)
SELECT doc_id, CASE WHEN dup THEN regexp_replace(id, '_[0-9]+$', '') || '_' || CAST(num AS BIGINT) ELSE id END AS id FROM n""")
def unique_ids(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat_ws("_", "lang", "source", (100 + F.col("n_chars") % 20).cast("string")).alias("id"))
    return D.unique_ids(d, "id", "doc_id").select("doc_id", "id")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS split_rank, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderkey) AS INTEGER) AS ord FROM orders")
def ordered_union(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    both = o.filter("o_orderstatus = 'F'").withColumn("split_rank", F.lit(0)).unionByName(o.filter("o_orderstatus <> 'F'").withColumn("split_rank", F.lit(1)))
    return both.select("o_orderkey", "split_rank", F.row_number().over(Window.partitionBy("o_custkey").orderBy("split_rank", "o_orderkey")).alias("ord"))


# ------------------------------------------------------------------ text rules


@query("SELECT conv_id, turn, CASE WHEN starts_with(t, 'yes') THEN 'true' WHEN starts_with(t, 'no') THEN 'false' END AS polarity FROM (SELECT *, lower(trim(text)) AS t FROM conversations)")
def polarity(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", X.polarity(F.col("text")).cast("string").alias("polarity"))


@query(r"""SELECT page_id, TRY_CAST(nullif(regexp_extract('case_' || page_id || 'p', '(?i)case_?(\d+)', 1), '') AS INTEGER) AS case_no, coalesce(TRY_CAST(nullif(regexp_extract('v_part_00' || page_id || '.mp4', 'part_0*(\d{1,9})(?:\.mp4)?$', 1), '') AS INTEGER), 1) AS part, coalesce(nullif(regexp_extract(url, '(?i)[\\/](example[\\/].*)$', 1), ''), url) AS path FROM pages""")
def regex_case_number(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", X.case_number(F.lit("none"), F.concat(F.lit("case_"), F.col("page_id").cast("string"), F.lit("p"))).alias("case_no"), X.part_number(F.concat(F.lit("v_part_00"), F.col("page_id").cast("string"), F.lit(".mp4"))).alias("part"), X.relative_path(F.col("url"), "example").alias("path"))


KINDS = [*V.TYPE_SLOTS, "tp_bal"]


@query(f"""WITH i AS (SELECT p_partkey, 'case_000_p1_t15_' || [{quoted(KINDS)}][CAST(p_partkey % {len(KINDS)} AS INTEGER) + 1] || '_' || (100 + p_size) AS id FROM part)
SELECT p_partkey, regexp_extract(id, '_t\\d+_(.+)_\\d+$', 1) AS id_type, CASE WHEN contains(id, '_tp_bal_') THEN 'tool_presence' ELSE regexp_extract(id, '_t\\d+_(.+)_\\d+$', 1) END AS kind FROM i""")
def id_type_rules(spark, sf_dir):
    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("p_partkey") % len(KINDS)).cast("int"))
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("case_000_p1_t15_"), kind, F.lit("_"), (100 + F.col("p_size")).cast("string")).alias("id"))
    return p.select("p_partkey", X.id_type(F.col("id")).alias("id_type"), X.question_type(F.col("id")).alias("kind"))


@query("""SELECT p_partkey, array_to_string(list_transform(w, lambda x: upper(x[1]) || lower(x[2:])), ' ') AS words, upper(p_name[1]) || lower(p_name[2:]) AS first, CASE WHEN len(w) = 1 THEN w[1] ELSE array_to_string(w[:len(w) - 1], ', ') || ' and ' || w[len(w)] END AS listed FROM (SELECT *, string_split(p_name, ' ') AS w FROM part)""")
def capitalize(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", X.capitalize_words(F.col("p_name")).alias("words"), X.capitalize(F.col("p_name")).alias("first"), X.english_list(F.split("p_name", " ")).alias("listed"))


ASKED = [
    "Are there forceps being used here?", "Is a stapler listed as installed?", "Does this clip involve a grasping retractor?", "Is tissue being cut during this clip?", "Is any dissection of tissue visible?", "Is suturing required here?", "What procedure is this summary describing?",
    "What is the purpose of using forceps in this procedure?", "What is the general purpose of the camera?", "What type of forceps is mentioned?", "Which forceps types are listed as installed for this clip?", "What organ is being manipulated?", "Describe what is happening.", "What role is vessel sealer intended to serve?",
]
SAID = ["", "Cadiere forceps", "it shows prograsp forceps and bipolar forceps", "Uterine horn", "The colon is visible.", "something else"]


def asked(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", F.get(F.array(*map(F.lit, ASKED)), (F.col("p_partkey") % len(ASKED)).cast("int")).alias("q"), F.get(F.array(*map(F.lit, SAID)), (F.floor(F.col("p_partkey") / len(ASKED)) % len(SAID)).cast("int")).alias("a"))


def _has(words: list[str], column: str = "n") -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted([w])})" for w in words) + ")"


ASK_SQL = f"q0 AS (SELECT p_partkey, [{quoted(ASKED)}][CAST(p_partkey % {len(ASKED)} AS INTEGER) + 1] AS q, [{quoted(SAID)}][CAST((p_partkey // {len(ASKED)}) % {len(SAID)} AS INTEGER) + 1] AS a FROM part), q1 AS (SELECT *, lower(trim(q)) AS n, lower(trim(a)) AS m FROM q0), q2 AS (SELECT *, NOT ({' OR '.join(f'starts_with(n, {quoted([p])})' for p in V.OPEN_PREFIXES)}) AS bin, {_has(['forceps type', 'type of forceps'])} AND {_has(V.FORCEPS_VERBS)} AS ft FROM q1)"
PURPOSES = "CASE " + " ".join(f"WHEN contains(n, {quoted([t])}) THEN {quoted([V.PURPOSE[t]])}" for t in sorted(V.TOOLS, key=len, reverse=True)) + f" WHEN contains(n, 'forceps') THEN {quoted([V.PURPOSE['cadiere forceps']])} END"
ROUTES = f"""CASE WHEN bin AND NOT ft AND {_has(V.PRESENCE_TARGETS)} AND {_has(V.PRESENCE_STEMS)} THEN 'tool_presence'
 WHEN bin AND (regexp_matches(n, '\\bcut(ting)?\\b') OR (contains(n, 'tissue') AND contains(n, 'dissect'))) THEN 'tissue_cutting' WHEN bin AND contains(n, 'sutur') AND contains(n, 'required') THEN 'suture_required'
 WHEN {_has(V.PROCEDURE_MARKERS)} THEN 'procedure_type' WHEN {_has(['purpose', 'role is'])} THEN CASE WHEN {PURPOSES} IS NOT NULL THEN 'tool_purpose' ELSE 'tool_purpose_NO_LOOKUP' END WHEN ft THEN 'forceps_type' WHEN {_has(V.ORGAN_MARKERS)} THEN 'organ' ELSE 'free_generation' END"""


@query(f"WITH {ASK_SQL} SELECT p_partkey, {ROUTES} AS route FROM q2")
def route_question(spark, sf_dir):
    return asked(spark, sf_dir).select("p_partkey", X.route(F.col("q")).alias("route"))


FOUND = f"list_filter([{quoted(V.FORCEPS)}], lambda f: contains(m, f))"
FRAMED = "CASE " + " ".join(f"WHEN contains(n, {quoted([k])}) THEN {quoted([f.split('{}')[0]])} || regexp_replace(bare, '[ .]+$', '') || {quoted([f.split('{}')[1]])}" for k, f in V.FRAMES[:7]) + " ELSE bare END"


@query(f"""WITH {ASK_SQL}, q3 AS (SELECT *, {ROUTES} AS route, list_transform({FOUND}, lambda f: array_to_string(list_transform(string_split(f, ' '), lambda x: upper(x[1]) || x[2:]), ' ')) AS names FROM q2),
q4 AS (SELECT *, CASE WHEN len(names) = 0 THEN '{V.NO_FORCEPS}' WHEN len(names) = 1 THEN names[1] ELSE array_to_string(names[:len(names) - 1], ', ') || ' and ' || names[len(names)] END AS bare FROM q3)
SELECT p_partkey, CASE WHEN {_has(V.PROCEDURE_MARKERS)} THEN '{V.PROCEDURE_ANSWER}' WHEN {_has(['purpose', 'role is'])} THEN coalesce(upper(({PURPOSES})[1]) || ({PURPOSES})[2:] || '.', a)
 WHEN ft THEN CASE WHEN regexp_matches(' ' || lower(bare) || ' ', ' (is|are|was|were|shows) ') THEN bare ELSE {FRAMED} END WHEN {_has(V.ORGAN_MARKERS)} THEN CASE WHEN {_has(V.KNOWN_ORGANS, 'm')} THEN a ELSE '{V.ORGAN_FALLBACK}' END ELSE a END AS answer FROM q4""")
def frame_answer(spark, sf_dir):
    return asked(spark, sf_dir).select("p_partkey", X.finish_answer(F.col("q"), F.col("a")).alias("answer"))


@query(f"""WITH {ASK_SQL}, q3 AS (SELECT *, {ROUTES} AS route, (p_partkey % 41 - 20) / 10.0::DOUBLE AS margin FROM q2)
SELECT p_partkey, CASE WHEN route IN ('tool_presence', 'tissue_cutting', 'suture_required') THEN CASE WHEN margin >= CASE route WHEN 'tool_presence' THEN 0.2 WHEN 'tissue_cutting' THEN 1.4 ELSE 0.3 END THEN 'Yes' ELSE 'No' END ELSE route END AS decided FROM q3""")
def threshold_dispatch(spark, sf_dir):
    limits = {"tool_presence": 0.2, "tissue_cutting": 1.4, "suture_required": 0.3}
    rows = asked(spark, sf_dir).withColumn("margin", (F.col("p_partkey") % 41 - 20) / F.lit(10.0))
    way = X.route(F.col("q"))
    return rows.select("p_partkey", F.when(way.isin(*limits), X.threshold_answer(F.col("q"), F.col("margin"), F.col("a"), limits)).otherwise(way).alias("decided"))


@query("""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM documents), x AS (SELECT *, regexp_extract(c[:140], '^([^.!?]*[.!?])', 1) AS f FROM d)
SELECT doc_id, CASE WHEN length(c) < 10 OR regexp_matches(lower(c), 'annotator|annotation note|activity outside of the structured training|training activity is other') THEN NULL WHEN length(f) >= 16 THEN f WHEN length(c) > 140 THEN regexp_replace(regexp_replace(c[:140], ' [^ ]*$', ''), '[ ,;:]+$', '') || '.' WHEN regexp_matches(c, '[.!?]$') THEN c ELSE c || '.' END AS sentence FROM x""")
def first_sentence(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.clean_description(F.col("text")).alias("sentence"))


def segments(spark, sf_dir):
    """Parts as segments: tools by the bits of the size, a task, a description."""
    p = read(spark, sf_dir, "part")
    tasks = F.array(*map(F.lit, ["Suturing", "Uterine horn", "Other", "Range of motion", "Skills application"]))
    bits = F.filter(F.array(*map(F.lit, V.TOOLS)), lambda t, i: F.shiftright(F.col("p_partkey").cast("int"), 1).bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0)
    return p.select("p_partkey", bits.alias("tools"), F.array(F.lit("large needle driver")).alias("commercial_tools"), F.get(tasks, (F.col("p_partkey") % 5).cast("int")).alias("task"), F.concat(F.lit("The Colon was shown with "), "p_name").alias("description"))


@query(f"""WITH s AS (SELECT p_partkey, list_filter([{quoted(V.FORCEPS)}], lambda f: list_contains(list_filter([{quoted(V.TOOLS)}], lambda t, i: ((p_partkey >> 1) & (1 << (i - 1))) <> 0), f)) AS f FROM part),
n AS (SELECT p_partkey, list_transform(f, lambda x: array_to_string(list_transform(string_split(x, ' '), lambda y: upper(y[1]) || y[2:]), ' ')) AS n FROM s)
SELECT p_partkey, CASE len(n) WHEN 0 THEN '{V.QUESTIONS['forceps_none'][0]}' WHEN 1 THEN '{V.QUESTIONS['forceps_one'][0]}' ELSE '{V.QUESTIONS['forceps_many'][0]}' END AS question,
 CASE len(n) WHEN 0 THEN 'No forceps types are listed.' WHEN 1 THEN n[1] WHEN 2 THEN n[1] || ' and ' || n[2] || '.' ELSE n[1] || ', ' || n[2] || ' and ' || n[3] || '.' END AS answer FROM n""")
def qa_forceps(spark, sf_dir):
    row = T.forceps_type(F.col("tools"))
    return segments(spark, sf_dir).select("p_partkey", row.question.alias("question"), F.get(row.answers, F.lit(0)).alias("answer"))


@query(f"""WITH s AS (SELECT p_partkey, ['Suturing', 'Uterine horn', 'Other', 'Range of motion', 'Skills application'][CAST(p_partkey % 5 AS INTEGER) + 1] AS task, list_filter([{quoted(V.TOOLS)}], lambda t, i: ((p_partkey >> 1) & (1 << (i - 1))) <> 0) AS tools FROM part)
SELECT p_partkey, k.kind, CASE kind WHEN 'suture_required' THEN CASE WHEN task = 'Suturing' THEN 'Yes' ELSE 'No' END WHEN 'task_id' THEN upper(task[1]) || lower(task[2:]) WHEN 'organ' THEN CASE task WHEN 'Uterine horn' THEN 'Uterine horn' WHEN 'Skills application' THEN 'Gallbladder' ELSE 'Colon' END
 WHEN 'procedure_type' THEN '{V.PROCEDURE_ANSWER}' WHEN 'tissue_cutting' THEN CASE WHEN list_has_any(tools, [{quoted(V.CUTTING_TOOLS)}]) OR lower(task) IN ({quoted(V.CUTTING_TASKS)}) THEN 'Yes' ELSE 'No' END
 WHEN 'tool_presence' THEN CASE WHEN list_contains(tools, 'stapler') THEN 'Yes' ELSE 'No' END END AS answer, 5 AS n_answers
FROM s, (VALUES ('suture_required'), ('task_id'), ('organ'), ('procedure_type'), ('tissue_cutting'), ('tool_presence')) AS k(kind)""")
def qa_templates(spark, sf_dir):
    kinds = ["suture_required", "task_id", "organ", "procedure_type", "tissue_cutting", "tool_presence"]
    rows = segments(spark, sf_dir).withColumn("kind", F.explode(F.array(*map(F.lit, kinds))))
    row = T.for_type(F.col("kind"), tools=F.col("tools"), commercial=F.col("commercial_tools"), target=F.lit("stapler"), task=F.col("task"), text=F.col("description"), key=F.concat_ws("|", F.col("p_partkey").cast("string"), "kind"))
    return rows.withColumn("qa", row).select("p_partkey", "kind", F.get("qa.answers", F.lit(0)).alias("answer"), F.size(F.array_distinct("qa.answers")).alias("n_answers"))


# ------------------------------------------------------------------ curation

QA_KINDS = ["tool_presence", "organ", "task_id", "procedure_type", "description"]
QA_SQL = f"""qa AS (SELECT doc_id, 'case_' || (doc_id % 155) || '_' || doc_id AS id, CASE WHEN doc_id % 10 = 9 THEN 'forceps_type' ELSE [{quoted(QA_KINDS)}][CAST(doc_id % 5 AS INTEGER) + 1] END AS question_type, CASE WHEN doc_id % 15 = 1 THEN 'The tissue in the surgical field' WHEN doc_id % 5 = 1 THEN 'Colon.' ELSE lang END AS first_answer,
 CASE WHEN toxic = 1 THEN 'fully_black' WHEN quality = 0 THEN 'partially_black' ELSE 'valid' END AS visual_status FROM documents LEFT JOIN labels USING (doc_id)),
g AS (SELECT *, CASE WHEN question_type = 'organ' AND lower(trim(first_answer)) = '{V.GENERIC_ORGAN}' THEN 'generic_fallback' WHEN question_type = 'organ' THEN 'semantic_task_label' WHEN question_type IN ({quoted(V.DROP_WHEN_BLACK)}) THEN 'visual_claim' ELSE 'metadata_or_language' END AS grounding_status, {FRACTION.format('id')} AS f FROM qa),
cu AS (SELECT *, CASE WHEN visual_status = 'fully_black' AND question_type IN ({quoted(V.DROP_WHEN_BLACK)}) THEN 'drop_fully_black_visual_question' WHEN grounding_status = 'generic_fallback' AND f >= 0.1 THEN 'drop_generic_organ_fallback' END AS drop_reason,
 CASE WHEN grounding_status IN ('generic_fallback', 'semantic_task_label') THEN least(w, 0.5) ELSE w END AS sample_weight, CASE WHEN grounding_status = 'semantic_task_label' THEN [{quoted(V.SEMANTIC_QUESTIONS)}][CAST(least(floor(f * 3), 2) AS INTEGER) + 1] ELSE 'q' END AS question,
 CASE WHEN s1 IS NULL AND s2 IS NULL THEN 'keep' ELSE concat_ws('+', s1, s2) END AS curation_action FROM (SELECT *, CASE WHEN visual_status = 'fully_black' THEN CASE question_type WHEN 'procedure_type' THEN 0.1 WHEN 'suture_required' THEN 0.1 WHEN 'task_id' THEN 0.2 WHEN 'tool_purpose' THEN 0.2 ELSE 0.1 END WHEN visual_status = 'partially_black' THEN 0.5 ELSE 1.0 END AS w,
 CASE visual_status WHEN 'fully_black' THEN 'downweight_fully_black_metadata' WHEN 'partially_black' THEN 'downweight_partially_black' END AS s1, CASE grounding_status WHEN 'generic_fallback' THEN 'downsample_generic_organ_fallback' WHEN 'semantic_task_label' THEN 'rewrite_semantic_organ' END AS s2 FROM g))"""


def qa_rows(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    kind = F.when(F.col("doc_id") % 10 == 9, "forceps_type").otherwise(F.get(F.array(*map(F.lit, QA_KINDS)), (F.col("doc_id") % 5).cast("int")))
    first = F.when(F.col("doc_id") % 15 == 1, "The tissue in the surgical field").when(F.col("doc_id") % 5 == 1, "Colon.").otherwise(F.col("lang"))
    seen = F.when(F.col("toxic") == 1, "fully_black").when(F.col("quality") == 0, "partially_black").otherwise("valid")
    rows = d.select("doc_id", "source", F.concat(F.lit("case_"), (F.col("doc_id") % 155).cast("string"), F.lit("_"), F.col("doc_id").cast("string")).alias("id"), kind.alias("question_type"), F.lit("q").alias("question"), F.array(first, F.lit("b"), F.lit("c"), F.lit("d"), F.lit("e")).alias("answers"), seen.alias("visual_status"))
    return rows.withColumn("grounding_status", C.grounding_status(F.col("question_type"), F.get("answers", F.lit(0))))


@query(f"WITH {QA_SQL} SELECT id, question_type, visual_status, grounding_status, drop_reason, CAST(sample_weight AS DOUBLE) AS sample_weight, curation_action, question FROM cu")
def curate_state_machine(spark, sf_dir):
    return C.curate(qa_rows(spark, sf_dir)).select("id", "question_type", "visual_status", "grounding_status", "drop_reason", "sample_weight", "curation_action", "question")


_CLEAN = "drop_reason IS NULL AND visual_status = 'valid' AND grounding_status <> 'generic_fallback'"


@query(f"""WITH {QA_SQL}, k AS (SELECT *, CAST(regexp_extract(id, 'case_(\\d+)', 1) AS INTEGER) AS c FROM cu), v AS (SELECT * FROM k WHERE c BETWEEN 140 AND 146), t AS (SELECT * FROM k WHERE c BETWEEN 147 AND 154)
SELECT slice, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'val_clean' AS slice FROM v WHERE {_CLEAN} UNION ALL SELECT 'val_black' FROM v WHERE visual_status = 'fully_black' UNION ALL SELECT 'val_partial_black' FROM v WHERE visual_status = 'partially_black'
 UNION ALL SELECT 'val_simulated_organ' FROM v WHERE drop_reason IS NULL AND grounding_status = 'semantic_task_label' UNION ALL SELECT 'val_forceps' FROM v WHERE drop_reason IS NULL AND question_type = 'forceps_type' UNION ALL SELECT 'test_clean' FROM t WHERE {_CLEAN} UNION ALL SELECT 'test_forceps' FROM t WHERE drop_reason IS NULL AND question_type = 'forceps_type') GROUP BY slice""")
def diagnostic_slices(spark, sf_dir):
    rows = C.curate(qa_rows(spark, sf_dir))
    return J.diagnostic(rows, X.case_number(F.col("id"))).groupBy("slice").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' END AS "column", coalesce(lang, source) AS value, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())""")
def grouping_summary(spark, sf_dir):
    return C.histograms(read(spark, sf_dir, "documents"), ["lang", "source"])


@query("""SELECT flag, CAST(count(*) AS BIGINT) AS segments, CAST(sum(w) AS BIGINT) AS questions, CAST(count(DISTINCT user_id) AS BIGINT) AS cases FROM (SELECT user_id, event_id % 4 AS w, unnest(list_filter([CASE WHEN value <= 5 THEN 'dark' END, CASE WHEN event_type = 'error' THEN 'failed' END, CASE WHEN event_id % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL)) AS flag FROM events) GROUP BY flag""")
def audit_summary(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 4).alias("w"), (F.col("value") <= 5).alias("dark"), (F.col("event_type") == "error").alias("failed"), (F.col("event_id") % 2 == 0).alias("even"))
    return M.flag_summary(e, ["dark", "failed", "even"], "w", "user_id")


@query("SELECT user_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max, round(avg(CASE WHEN value > 3 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS nonzero FROM events GROUP BY user_id")
def frame_stats(spark, sf_dir):
    out = M.frame_stats(read(spark, sf_dir, "events"), ["user_id"], "value")
    return out.select("user_id", *(six(F.col(c)).alias(c) for c in ("mean", "std", "p99")), "max", six(F.col("nonzero")).alias("nonzero"))


@query("""WITH s AS (SELECT user_id, event_type, avg(value) AS mean, quantile_cont(value, 0.99) AS p99, max(value) AS mx FROM events GROUP BY ALL), f AS (SELECT *, mx <= 100 AS eb, mean <= 30 AND p99 <= 10000 AS nb FROM s)
SELECT user_id, CAST(count(*) FILTER (nb) AS INTEGER) AS n_low, bool_and(nb) AS all_low, bool_or(nb) AS any_low, CAST(count(*) FILTER (eb) AS INTEGER) AS n_small FROM (SELECT user_id, mean / 10 <= 3 AND p99 / 1000 <= 10 AS nb, mx / 100 <= 1 AS eb FROM s) GROUP BY user_id""")
def darkness_flags(spark, sf_dir):
    s = M.frame_stats(read(spark, sf_dir, "events"), ["user_id", "event_type"], "value", exact=True)
    frames = s.groupBy("user_id").agg(F.collect_list(F.struct((F.col("mean") / 10).alias("mean"), (F.col("p99") / 1000).alias("p99"), (F.col("max") / 100).alias("max"))).alias("frames"))  # one frame a type
    flags = M.darkness(F.col("frames"))
    return frames.select("user_id", flags["n_near_black"].alias("n_low"), flags["all_near_black"].alias("all_low"), flags["any_near_black"].alias("any_low"), flags["n_exact_black"].alias("n_small"))


@query("SELECT lang, CAST(count(*) FILTER (quality = 1) AS BIGINT) AS good, CAST(count(*) FILTER (quality = 0) AS BIGINT) AS bad FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def pivot_counts(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    wide = d.withColumn("q", F.when(F.col("quality") == 1, "good").otherwise("bad")).groupBy("lang").pivot("q", ["good", "bad"]).count()
    return wide.select("lang", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad"))


@query("SELECT conv_id, CAST(count(*) FILTER (length(text) > 50) AS BIGINT) AS present, count(*) FILTER (length(text) > 50) = 3 AS complete FROM conversations GROUP BY conv_id")
def cache_preflight(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("here", F.length("text") > 50)
    return M.complete_sets(c, "conv_id", "here", 3)


@query("SELECT coalesce(lang, NULL) AS lang, CAST(grouping(lang) AS INTEGER) AS is_total, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(quality AS DOUBLE)), 6) AS quality, round(avg(CAST(toxic AS DOUBLE)), 6) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)")
def eval_rollup(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return M.score_rollup(d, "lang", ["quality", "toxic"]).select("lang", "is_total", "n", six(F.col("quality")).alias("quality"), six(F.col("toxic")).alias("toxic"))


@query("""WITH r AS (SELECT CASE WHEN quality = 1 THEN 'Yes' ELSE 'No' END AS t, CASE WHEN n_chars % 3 = 0 THEN 'no, not' WHEN n_chars % 3 = 1 THEN 'Yes.' ELSE 'maybe' END AS p FROM documents JOIN labels USING (doc_id)),
x AS (SELECT count(*) AS examples, count(*) FILTER ((t = 'Yes' AND p = 'Yes.') OR (t = 'No' AND p = 'no, not')) AS correct, count(*) FILTER (t = 'No') AS negatives, count(*) FILTER (t = 'No' AND p = 'Yes.') AS false_positives FROM r)
SELECT CAST(examples AS BIGINT) AS examples, CAST(correct AS BIGINT) AS correct, CAST(negatives AS BIGINT) AS negatives, CAST(false_positives AS BIGINT) AS false_positives, round(correct / examples, 6) AS accuracy, round(false_positives / negatives, 6) AS false_positive_rate FROM x""")
def semantic_metrics(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    rows = d.select(F.when(F.col("quality") == 1, "Yes").otherwise("No").alias("t"), F.when(F.col("n_chars") % 3 == 0, "no, not").when(F.col("n_chars") % 3 == 1, "Yes.").otherwise("maybe").alias("p"))
    out = M.presence_metrics(rows, "p", "t")
    return out.select("examples", "correct", "negatives", "false_positives", six(F.col("accuracy")).alias("accuracy"), six(F.col("false_positive_rate")).alias("false_positive_rate"))


@query(f"""WITH r AS (SELECT list_filter([{quoted(V.FORCEPS)}], lambda f, i: (p_partkey >> (i - 1)) & 1 = 1) AS p, list_filter([{quoted(V.FORCEPS)}], lambda f, i: (p_size >> (i - 1)) & 1 = 1) AS e FROM part),
t AS (SELECT count(*) AS examples, count(*) FILTER (p = e) AS exact, sum(len(list_intersect(p, e))) AS tp, sum(len(p) - len(list_intersect(p, e))) AS fp, sum(len(e) - len(list_intersect(p, e))) AS fn FROM r)
SELECT CAST(examples AS BIGINT) AS examples, CAST(exact AS BIGINT) AS exact, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(2 * tp / (2 * tp + fp + fn), 6) AS micro_f1 FROM t""")
def set_metrics(spark, sf_dir):
    named = lambda c: F.filter(F.array(*map(F.lit, V.FORCEPS)), lambda f, i: F.call_function("shiftright", F.col(c).cast("int"), i).bitwiseAND(F.lit(1)) == 1)
    p = read(spark, sf_dir, "part").select(F.array_join(named("p_partkey"), ", ").alias("p"), F.array(F.array_join(named("p_size"), " x ")).alias("e"))
    return M.forceps_metrics(p, "p", "e").withColumn("micro_f1", six(F.col("micro_f1")))


@query("SELECT lang, round(sum(quality * n_chars) / greatest(sum(n_chars), 1e-6), 6) AS wmean FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def weighted_mean(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("lang").agg(six(M.weighted_mean(F.col("quality"), F.col("n_chars"))).alias("wmean"))


@query("""WITH a AS (SELECT doc_id, text, lower(trim(text)) AS n FROM documents), r AS (SELECT doc_id, n, row_number() OVER (PARTITION BY n ORDER BY doc_id) AS k, (SELECT count(*) FROM labels l WHERE l.doc_id = a.doc_id) AS m FROM a)
SELECT doc_id, 'no_label' AS rule FROM r WHERE m = 0 UNION ALL SELECT doc_id, 'duplicate' FROM r WHERE m > 0 AND k > 1 UNION ALL SELECT doc_id, 'short' FROM r WHERE m > 0 AND length(n) < 300""")
def constraint_report(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("found")), "doc_id", "left")
    d = d.withColumn("n", F.lower(F.trim("text"))).withColumn("k", F.row_number().over(Window.partitionBy("n").orderBy("doc_id")))
    return C.violations(d, {"no_label": F.col("found").isNull(), "duplicate": F.col("k") > 1, "short": F.length("n") < 300}, ("no_label",)).select("doc_id", "rule")


# ------------------------------------------------------------------ arrays, JSON, keys


@query("""WITH t AS (SELECT vec_id, embedding AS v, list_transform(embedding, lambda x: x > 0) AS m FROM embeddings)
SELECT vec_id, list_transform(range(10), lambda b: round(coalesce(list_avg(list_transform(list_filter(range(b * 6 + least(b, 4), b * 6 + least(b, 4) + 6 + CASE WHEN b < 4 THEN 1 ELSE 0 END), lambda i: m[i + 1]), lambda i: CAST(v[i + 1] AS DOUBLE))), 0.0), 6))[3] AS third, round(list_count(list_filter(m, lambda x: x)) / len(m), 6) AS share FROM t""")
def masked_pool(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").withColumn("m", F.transform("embedding", lambda x: x > 0))
    pooled = A.masked_pool(F.col("embedding"), F.col("m"), 10)
    return e.select("vec_id", six(F.get(pooled, F.lit(2))).alias("third"), six(A.valid_fraction(F.col("m"))).alias("share"))


@query("SELECT vec_id, CAST(list_sum(list_transform(range(32), lambda g: CASE WHEN embedding[2 * g + 1] > 0 OR embedding[2 * g + 2] > 0 THEN 3 ELSE 0 END)) AS BIGINT) AS valid FROM embeddings")
def mask_coarsen(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    mask = A.coarse_mask(F.transform("embedding", lambda x: x > 0), 2, 3)
    return e.select("vec_id", F.size(F.filter(mask, lambda m: m)).cast("long").alias("valid"))


@query("""WITH t AS (SELECT vec_id, i, embedding[i + 1] AS v, embedding[i + 1] > 0 AS ok FROM embeddings, range(64) r(i)), p AS (SELECT *, max(CASE WHEN ok THEN i END) OVER (PARTITION BY vec_id ORDER BY i) AS a, min(CASE WHEN ok THEN i END) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM t),
n AS (SELECT vec_id, i, CASE WHEN a IS NULL THEN b WHEN b IS NULL OR i - a <= b - i THEN a ELSE b END AS j FROM p) SELECT vec_id, CAST(sum(j * (i + 1)) AS BIGINT) AS checksum FROM n GROUP BY vec_id""")
def nearest_fill(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    places = F.sequence(F.lit(0), F.size("embedding") - 1)
    filled = A.nearest_valid(places, F.transform("embedding", lambda x: x > 0))
    return e.select("vec_id", F.aggregate(F.transform(filled, lambda j, i: (j * (i + 1)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum"))


@query("SELECT vec_id, embedding[64] AS rolled, embedding[9] AS second, CAST(len(embedding[1:64:8]) AS INTEGER) AS n FROM embeddings")
def roll_stride(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    kept = A.strided(F.col("embedding"), 8, 16)
    return e.select("vec_id", F.get(A.roll(F.col("embedding"), 1), F.lit(0)).alias("rolled"), F.get(kept, F.lit(1)).alias("second"), F.size(kept).alias("n"))


@query("""WITH t AS (SELECT conv_id, turn, len(string_split(text, ' ')) AS n FROM conversations)
SELECT conv_id, turn, CAST(least(2, n) AS INTEGER) AS ignored, CAST(greatest(n, 50) AS INTEGER) AS padded, CAST(n AS BIGINT) AS attended FROM t""")
def label_mask_pad(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("ids", F.transform(F.split("text", " "), lambda w: F.length(w)))
    labels = A.masked_labels(F.slice("ids", 1, 2), F.col("ids"))
    size = F.lit(50)
    return c.select("conv_id", "turn", F.size(F.filter(labels, lambda x: x == -100)).alias("ignored"), F.size(A.padded(F.col("ids"), size, 0)).alias("padded"), F.aggregate(A.attention(F.col("ids"), size), F.lit(0).cast("long"), lambda a, x: a + x).alias("attended"))


@query("SELECT conv_id, md5(string_agg('<|' || role || '|>' || chr(10) || text, chr(10) ORDER BY turn, role, text)) AS prompt FROM conversations GROUP BY conv_id")
def chat_prompt(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))  # of one conversation
    return c.select("conv_id", F.md5(A.chat_text(F.col("turns"))).alias("prompt"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT event_id, md5(user_id || '|' || (event_id % 100) || '.0|' || (event_id % 100 + 30) || '.0') AS key FROM events")
def md5_key(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    start = (F.col("event_id") % 100).cast("double")
    return e.select("event_id", X.segment_key(F.col("user_id").cast("string"), start, start + 30).alias("key"))
