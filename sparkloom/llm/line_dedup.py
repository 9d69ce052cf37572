"""Recurring lines by a log-template tree of fixed depth.

A line goes down the tree by its number of tokens and its leading tokens, in
which a token with a digit counts as a variable. In a leaf, a token without a
digit is constant at its place if lines of ``min_docs`` texts have it there,
however large the leaf is; the others are variable. A line that is mostly constant
has its constants as template, any other line the line itself. Templates that
stand in ``min_docs`` different texts recur: all their lines but the first
(smallest doc_id, then line number) are dropped. So a line that recurs word for
word is dropped whatever its leaf, and one with variable fields if enough of it is
constant.

Only lines of leaves that enough different texts reach are looked at further:
those leaves' bits, in a table of fixed size, sieve the lines before they are
shuffled. Constants are joined token by token, and a template is two sums over
its constants, so no leaf's tokens or lines are gathered. Each text is counted
once, so copies of a document don't make its lines recur. The small tables of
leaves, constants and templates are stored apart from what they are joined with,
so that a hot key's rows can be split between tasks.

Defined results: a null text has no lines and stays null. Blank lines are kept. A
line of fewer than ``min_tokens`` tokens recurs only word for word. A null doc_id
counts as 2**63 - 1; of lines at one place of different texts with one doc_id, all
are first if one is. Rows that repeat both doc_id and text are one document and
all come back. An empty table gives no rows. Extra columns come back, unless named
like an added column. Lines and tokens are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

LEADING, MIN_TOKENS, MIN_DOCS = 3, 4, 5
#: Share of a line's tokens that must be constant.
CONSTANT = 0.8
VARIABLE = "<*>"
LAST = (1 << 63) - 1
#: Rows of the sieve, each with 64 bits.
SLOTS = 1 << 17
BLANK = r"[^ \t\r\f]"


def _lines(texts: DataFrame, leading: int, min_tokens: int) -> DataFrame:
    """``o, t1, t2, i, line, n, leaf`` of the lines that are not blank; a line of few tokens is a leaf by itself."""
    lines = texts.select("o", "t1", "t2", F.posexplode(F.split("text", "\n")).alias("i", "line")).filter(F.col("line").rlike(BLANK))
    tokens = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    lead = F.regexp_replace(F.substring_index("line", " ", leading), "[^ ]*[0-9][^ ]*", VARIABLE)
    return lines.withColumn("n", tokens).withColumn("leaf", F.when(F.col("n") >= min_tokens, F.xxhash64("n", lead)).otherwise(F.xxhash64(F.lit("line"), "line")))


def _sieved(lines: DataFrame, leaves: DataFrame) -> DataFrame:
    """Lines whose leaf may be among ``leaves``, and few others."""
    slot, bit = F.pmod("leaf", F.lit(SLOTS)), F.expr("cast(shiftright(leaf, 20) & 63 as int)")
    bits = leaves.groupBy(slot.alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftright(leaf, 20) & 63 as int))")).alias("bits"))
    # broadcast: at most SLOTS rows of two numbers
    met = lines.join(F.broadcast(bits), slot == F.col("slot"))
    return met.filter(F.getbit("bits", bit) == 1).drop("slot", "bits")


def recurring(texts: DataFrame, *, leading: int, min_tokens: int, min_docs: int, constant: float) -> DataFrame:
    """``t1, t2, i, first_o, first_i`` of every line whose template recurs, from ``texts(o, t1, t2, text)``."""
    lines = _lines(texts, leading, min_tokens)
    leaves = stored(lines.select("leaf", "t1").distinct().groupBy("leaf").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs).select("leaf"), keep="leaves")
    hot = stored(_sieved(lines, leaves).join(leaves, "leaf").withColumn("v", F.xxhash64("leaf", "line")), keep="hot")
    # different lines of a leaf, each with the number of texts that have it
    long = hot.filter(F.col("n") >= min_tokens).groupBy("leaf", "n", "v", "t1").agg(F.min("line").alias("line"))
    kinds = stored(long.groupBy("leaf", "n", "v").agg(F.count("*").alias("m"), F.min("line").alias("line")), keep="kinds")
    tokens = kinds.select("leaf", "n", "v", "m", F.posexplode(F.split("line", " ")).alias("place", "token")).filter(~F.col("token").rlike("[0-9]"))
    tokens = tokens.select("leaf", "n", "v", "m", F.xxhash64("leaf", "place", "token").alias("k"))
    constants = stored(tokens.groupBy("k").agg(F.sum("m").alias("m")).filter(F.col("m") >= min_docs).select("k"), keep="constants")
    # the constants of a line differ in place, so a sum over their hashes names their set
    held = tokens.select("leaf", "n", "v", "k").join(constants, "k").groupBy("leaf", "n", "v").agg(F.count("*").alias("c"), F.bit_xor("k").alias("x"), F.bit_xor(F.xxhash64("k")).alias("y"))
    shapes = stored(held.filter(F.col("c") >= constant * F.col("n")).select("v", F.xxhash64("leaf", "c", "x", "y").alias("shape")), keep="shapes")
    discard(leaves, kinds, constants)
    once = hot.groupBy("t1", "t2", "i", "v").agg(F.min("o").alias("o"))  # copies of a text
    marks = stored(once.join(shapes, "v", "left").select("t1", "t2", "i", "o", F.coalesce("shape", "v").alias("template")), keep="marks")
    discard(hot, shapes)
    first = marks.groupBy("template", "t1").agg(F.min(F.struct("o", "i")).alias("f"))
    counts = stored(first.groupBy("template").agg(F.count("*").alias("docs"), F.min("f").alias("f")).filter(F.col("docs") >= min_docs).select("template", F.col("f.o").alias("first_o"), F.col("f.i").alias("first_i")), keep="counts")
    return marks.join(counts, "template").select("t1", "t2", "i", "first_o", "first_i")


def drop_recurring(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", leading: int = LEADING, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS, constant: float = CONSTANT) -> DataFrame:
    """``docs`` with ``text`` without its recurring lines, and ``n_lines``, ``n_dropped``."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    keyed = docs.select(*(F.col(c).alias(f"x_{c}") for c in names if c != text), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("o"), F.col(text).cast("string").alias("text"))
    keyed = keyed.select("*", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"))
    found = recurring(keyed.select("o", "t1", "t2", "text"), leading=leading, min_tokens=min_tokens, min_docs=min_docs, constant=constant)
    per_text = stored(found.groupBy("t1", "t2").agg(F.collect_set(F.struct("i", "first_o", "first_i")).alias("found")), keep="found")  # of one text
    joined = keyed.join(per_text, ["t1", "t2"], "left")
    gone = F.coalesce(F.transform(F.filter("found", lambda f: ~((f.first_o == F.col("o")) & (f.first_i == f.i))), lambda f: f.i), F.array().cast("array<int>"))
    lines = F.split("text", "\n")
    # what stays is the runs of lines between those that go; both lists are made once, so the work is in proportion to the lines
    both = F.struct(lines.alias("lines"), F.concat(F.array(F.lit(-1)), F.array_sort(gone), F.array(F.size(lines))).alias("edges"))
    runs = F.transform(F.array(both), lambda x: F.flatten(F.transform(F.slice(x.edges, 2, F.size(x.edges) - 1), lambda end, j: F.slice(x.lines, F.get(x.edges, j) + 2, end - F.get(x.edges, j) - 1))))
    out = F.when(F.size(gone) > 0, F.array_join(F.get(runs, F.lit(0)), "\n")).otherwise(F.col("text"))
    fields = [out.alias(c) if c == text else F.col(f"x_{c}").alias(c) for c in names]
    return joined.select(*fields, F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.size(gone).alias("n_dropped"))


#: The result of ``op4`` in DuckDB's SQL.
ORACLE = rf"""
WITH d AS (SELECT doc_id, text, coalesce(doc_id, {LAST}) AS o FROM documents),
once AS (SELECT text, min(o) AS o FROM d WHERE text IS NOT NULL GROUP BY text),
cut AS (SELECT text, o, string_split(text, chr(10)) AS ls FROM once),
l AS (SELECT text, o, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM cut),
tok AS (SELECT text, o, i, line, string_split(line, ' ') AS tokens, len(string_split(line, ' ')) AS n FROM l WHERE regexp_matches(line, '{BLANK}')),
lead_ AS (SELECT *, CASE WHEN n >= {MIN_TOKENS} THEN list_transform(tokens[1:{LEADING}], lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '{VARIABLE}' ELSE t END) ELSE [line] END AS ld FROM tok),
leaves AS (SELECT n, ld FROM lead_ GROUP BY n, ld HAVING count(DISTINCT text) >= {MIN_DOCS}),
own AS (SELECT lead_.* FROM lead_ JOIN leaves USING (n, ld)),
kinds AS (SELECT n, ld, line, tokens, count(DISTINCT text) AS m FROM own WHERE n >= {MIN_TOKENS} GROUP BY ALL),
places AS (SELECT n, ld, place, token FROM (SELECT n, ld, m, unnest(range(n)) AS place, unnest(tokens) AS token FROM kinds) WHERE NOT regexp_matches(token, '[0-9]') GROUP BY ALL HAVING sum(m) >= {MIN_DOCS}),
kept AS (SELECT n, ld, list(place || ' ' || token) AS constants FROM places GROUP BY n, ld),
held AS (SELECT own.*, list_filter(list_transform(range(n), lambda j: j || ' ' || tokens[j + 1]), lambda t: list_contains(coalesce(constants, []), t)) AS held FROM own LEFT JOIN kept USING (n, ld)),
shaped AS (SELECT text, o, i, n, ld, CASE WHEN n >= {MIN_TOKENS} AND len(held) >= {CONSTANT} * n THEN held ELSE NULL END AS held, CASE WHEN n >= {MIN_TOKENS} AND len(held) >= {CONSTANT} * n THEN NULL ELSE line END AS line FROM held),
marks AS (SELECT text, o, i, md5(CAST(struct_pack(n := n, ld := ld, held := held, line := line) AS VARCHAR)) AS template FROM shaped),
counts AS (SELECT template, min({{'o': o, 'i': i}}) AS f FROM marks GROUP BY template HAVING count(DISTINCT text) >= {MIN_DOCS}),
gone AS (SELECT text, list({{'i': i, 'fo': f.o, 'fi': f.i}}) AS g FROM marks JOIN counts USING (template) GROUP BY text),
j AS (SELECT d.doc_id, d.text, list_transform(list_filter(coalesce(g, []), lambda x: NOT (x.fo = d.o AND x.fi = x.i)), lambda x: x.i) AS drops, string_split(d.text, chr(10)) AS ls FROM d LEFT JOIN gone ON d.text = gone.text)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS INTEGER) AS n_lines, CAST(len(drops) AS INTEGER) AS n_dropped,
  md5(CASE WHEN len(drops) > 0 THEN array_to_string(list_transform(list_filter(range(len(ls)), lambda k: NOT list_contains(drops, k)), lambda k: ls[k + 1]), chr(10)) ELSE text END) AS text_md5
FROM j
"""
