"""URL filters by a temporal list join.

A list is a log of dated entries: a domain is added under a category, or removed,
on a day. The last change of a day holds (a removal before an addition of that
day), and every addition becomes an interval that ends with the domain's next
change. A capture is evaluated as of its fetch time: it is blocked if its host, or
a domain above it, has an interval that holds then; the longest such domain
decides, then the category that comes first.

Captures of one host and day agree, so they are counted as one before the join;
a host that holds a third of all captures is a few rows. The intervals have no
size bound and are not broadcast by the operator.

Defined results: hosts are lower case, without user, port and final dots (an
address in brackets keeps them); a null url, or one
without a host, or a null fetch time is not blocked, with null columns. List rows
with a null domain, day or action are ignored; repeated ones count once. An empty
list blocks nothing; an empty table gives no rows. Extra columns come back,
unless named like an added column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)"


def host_of(url: Column) -> Column:
    return F.nullif(F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(".")), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """``domain``, ``category``, ``since``, ``until`` (excluded; null: still open) from ``domain, category, action, day``."""
    known = entries.filter("domain IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')").select(F.rtrim(F.lower("domain"), F.lit(".")).alias("domain"), F.coalesce("category", F.lit("")).alias("category"), "action", "day")
    last = known.groupBy("domain", "category", "day").agg(F.min("action").alias("action"))  # 'add' before 'remove'
    own = Window.partitionBy("domain", "category").orderBy("day")  # one row a day
    return last.withColumn("until", F.lead("day").over(own)).filter("action = 'add'").select("domain", "category", F.col("day").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame, *, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """``captures`` with ``host``, ``blocked``, ``blocked_by`` (the domain), ``category`` and ``listed_since``."""
    added = ("host", "blocked", "blocked_by", "category", "listed_since")
    names = [c for c in captures.columns if c not in added]
    own = [F.col(c).alias(f"own_{i}") for i, c in enumerate(names)]
    rows = captures.select(*own, host_of(F.col(url)).alias("host"), F.to_date(fetched).alias("day"))
    asked = rows.filter("host IS NOT NULL AND day IS NOT NULL").select("host", "day").distinct()
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    domains = asked.select("host", "day", F.explode(above).alias("domain"))
    active = domains.join(intervals(entries), "domain").filter("day >= since AND (until IS NULL OR day < until)")
    decided = active.groupBy("host", "day").agg(F.min(F.struct((-F.length("domain")).alias("shorter"), "category", "since", "domain")).alias("best"))
    decided = stored(decided, keep="decided")  # apart from the rows, so that the join can split a very common host and day
    out = rows.join(decided, ["host", "day"], "left")
    back = [F.col(f"own_{i}").alias(c) for i, c in enumerate(names)]
    return out.select(*back, "host", F.col("best").isNotNull().alias("blocked"), F.col("best.domain").alias("blocked_by"), F.col("best.category").alias("category"), F.col("best.since").alias("listed_since"))


def captures_of(pages: DataFrame) -> DataFrame:
    """The pages with a fetch time, which the table lacks: hours of 2024 counted by page_id."""
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 3600, F.lit(366 * 86400))).alias("fetched"))


def dated_list(pages: DataFrame) -> DataFrame:
    """A dated list over the pages' own hosts: each is drawn by a digest and has up to three changes; three domains are listed as a whole."""
    hosts = pages.select(host_of(F.col("url")).alias("domain")).filter("domain IS NOT NULL").distinct()
    draw = F.conv(F.substring(F.md5("domain"), 1, 4), 16, 10).cast("int")
    start = F.date_add(F.lit("2024-01-01").cast("date"), draw % 200)
    changes = F.array(
        F.struct(F.lit("add").alias("action"), start.alias("day")),
        F.struct(F.lit("remove").alias("action"), F.date_add(start, 60).alias("day")),
        F.struct(F.lit("add").alias("action"), F.date_add(start, 120).alias("day")),
    )
    own = hosts.filter(draw % 3 == 0).select("domain", F.when(draw % 2 == 0, "spam").otherwise("adult").alias("category"), F.explode(F.slice(changes, F.lit(1), 1 + draw % 3 + (draw / 3).cast("int") % 3)).alias("c"))
    spark = pages.sparkSession
    whole = spark.sql(
        "SELECT * FROM VALUES ('spam-farm.example.org', 'spam', 'add', DATE'2024-02-01'), ('spam-farm.example.org', 'spam', 'remove', DATE'2024-05-01'),"
        " ('spam-farm.example.org', 'malware', 'add', DATE'2024-04-01'), ('example.net', 'test', 'add', DATE'2024-10-01') AS t(domain, category, action, day)"
    )
    return own.select("domain", "category", "c.action", "c.day").union(whole)


#: The result of ``op7`` in DuckDB's SQL.
ORACLE = r"""
WITH p AS (SELECT page_id, url, nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)', 1)), '.'), '') AS host,
  CAST(TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (page_id % (366 * 24)) AS DATE) AS day FROM pages),
h AS (SELECT DISTINCT host AS domain, CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) AS draw FROM p WHERE host IS NOT NULL),
own AS (SELECT domain, CASE WHEN draw % 2 = 0 THEN 'spam' ELSE 'adult' END AS category, k, draw % 200 AS start, 1 + draw % 3 + (draw // 3) % 3 AS many FROM h, (VALUES (1), (2), (3)) AS v(k) WHERE draw % 3 = 0),
entries AS (SELECT domain, category, CASE WHEN k = 2 THEN 'remove' ELSE 'add' END AS action, CAST(DATE '2024-01-01' + CAST(start + 60 * (k - 1) AS INTEGER) AS DATE) AS day FROM own WHERE k <= many
  UNION ALL SELECT * FROM (VALUES ('spam-farm.example.org', 'spam', 'add', DATE '2024-02-01'), ('spam-farm.example.org', 'spam', 'remove', DATE '2024-05-01'), ('spam-farm.example.org', 'malware', 'add', DATE '2024-04-01'), ('example.net', 'test', 'add', DATE '2024-10-01')) AS t(domain, category, action, day)),
last AS (SELECT domain, category, day, min(action) AS action FROM entries GROUP BY ALL),
spans AS (SELECT *, lead(day) OVER (PARTITION BY domain, category ORDER BY day) AS until FROM last),
hit AS (SELECT p.page_id, s.domain, s.category, s.day AS since, row_number() OVER (PARTITION BY p.page_id ORDER BY length(s.domain) DESC, s.category, s.day) AS r
  FROM p JOIN spans s ON s.action = 'add' AND (p.host = s.domain OR ends_with(p.host, '.' || s.domain)) AND p.day >= s.day AND (s.until IS NULL OR p.day < s.until))
SELECT p.page_id, p.url, p.host, hit.domain IS NOT NULL AS blocked, hit.domain AS blocked_by, hit.category, CAST(hit.since AS VARCHAR) AS listed_since
FROM p LEFT JOIN hit ON hit.page_id = p.page_id AND hit.r = 1
"""
