"""Fill-in-middle, substring dedup by anchors and the conversation trie against plain versions."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

pytest.importorskip("sparkloom.llm")

from sparkloom.llm import anchors, fim, trie  # noqa: E402
from test_operators import WORDS  # noqa: E402

rng = random.Random(5)
TEXTS = "doc_id long, text string, output string, n long, r string, kept string, g int, words int"


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def clashing(spark, rows):
    """Documents with further columns that are named like the operators' own."""
    return spark.createDataFrame([(k, t, "x", 1, "y", "z", 2, 3) for k, t in rows], TEXTS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# fill-in-middle


def plain_fim(doc_id, text, rate=90, spm=20):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return (doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_equals_plain_version(spark):
    rows = [(k, prose(rng, rng.randint(0, 60))) for k in range(200)]
    rows += [(None, "no id at all"), (None, None), (201, None), (202, ""), (203, "has <P> in it"), (204, "ends <S"), (205, "P>starts"), (206, "\n\r\n  \t"), (207, "é𝄞\U0001f600" * 40), (208, "a"), (5, "again"), (5, "again"), (209, "<M"), (210, "< < <P")]
    rows += [(k, "<" * 50 + "S>"[: k % 2] + "M>"[: k % 3]) for k in range(300, 330)]
    made = fim.transform(clashing(spark, rows)).withColumn("back", fim.restored()).collect()
    expected = [plain_fim(*r) for r in rows]
    assert sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made))) == sorted(map(repr, expected))
    assert sorted(repr((r.doc_id, r.back)) for r in made) == sorted(repr((k, t or "")) for k, t in rows)
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert fim.transform(clashing(spark, [])).count() == 0


def test_fill_in_middle_in_windows_and_other_units(spark):
    text = prose(rng, 900) + " é𝄞"
    for window in (1, 7, 100, 1 << 20):
        units = fim.Units(text, window=window)
        assert units.n == len(text) and all(units.end(k) == k for k in (0, 1, 6, 7, 8, 100, 101, len(text)))
        spoken = fim.Units(text, r"\S+\s*|\s+", window)
        ends = [m.end() for m in re.finditer(r"\S+\s*|\s+", text)]
        assert spoken.n == len(ends) and [spoken.end(k) for k in range(len(ends) + 1)] == [0, *ends]
    with pytest.raises(ValueError, match="cover"):
        fim.Units("abc def", r"[a-z]")
    long = ("word " * 60_000 + "é") * 3  # several windows of the real size
    rows = spark.createDataFrame([(k, long) for k in range(12)], "doc_id long, text string")
    made = fim.transform(rows, rate=100).withColumn("same", fim.restored() == F.lit(long)).collect()
    assert all(r.same and r.n == len(long) for r in made)
    assert sorted((r.doc_id, r.form, r.prefix_chars, r.output) for r in made) == sorted((k, x[2], x[3], x[5]) for k in range(12) for x in [plain_fim(k, long, rate=100)])


# substring dedup


def plain_anchors(rows, length=20):
    docs = {}
    for k, t in rows:
        docs[((1 << 63) - 1 if k is None else k, t or "")] = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    first = {}
    order = sorted(docs)
    for key in order:
        w = docs[key]
        for p in range(len(w) - length + 1):
            first.setdefault(tuple(w[p : p + length]), (key, p))
    out = []
    for k, t in rows:
        key = ((1 << 63) - 1 if k is None else k, t or "")
        w = docs[key]
        gone = set()
        for p in range(len(w) - length + 1):
            if first[tuple(w[p : p + length])] != (key, p):
                gone.update(range(p, p + length))
        out.append((k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def passages(seed, n=120):
    r = random.Random(seed)
    common = [" ".join(r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randint(0, 30)) for _ in range(r.randint(12, 70))) for _ in range(8)]
    rows = []
    for k in range(n):
        parts = []
        for _ in range(r.randint(0, 6)):
            parts.append(r.choice(common) if r.random() < 0.5 else prose(r, r.randint(1, 40)))
        rows.append((k, r.choice([" ", "\n", "  \t"]).join(parts)))
    return rows


EDGES = [(None, None), (None, "x y"), (500, ""), (501, " \n\t "), (502, "a " * 200), (503, "a b " * 100), (504, "A b " * 100), (505, "one " * 20), (506, "one " * 19), (506, "one " * 21)]


@pytest.mark.parametrize("length, stretch, size", [(20, 1 << 20, 12 << 20), (20, 3000, 500), (20, 150, 100), (7, 200, 150), (2, 60, 50)])
def test_anchors_equal_brute_force(spark, length, stretch, size):
    rows = passages(length)
    rows += [(900 + k, t) for k, (_, t) in enumerate(rows[:15])] + rows[3:6] + EDGES + [(None, rows[7][1]), (None, rows[8][1])]
    rows.append((901, " ".join(t for _, t in rows[20:40])))
    got = anchors.remove_repeats(clashing(spark, rows).repartition(5), length=length, stretch=stretch, range_bytes=size).collect()
    expected = [r for r in plain_anchors(rows, length)]
    if length == 20:
        assert sum(r[2] for r in expected) > 1000
    # documents of one doc_id are in the order of a hash; which of them keeps a passage is free, how much is not
    single = {k for k, _ in rows if k is not None and len({t for j, t in rows if j == k}) == 1}
    plain = lambda rs: sorted(r for r in rs if r[0] in single)
    assert plain((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == plain(expected)
    assert len(got) == len(rows) and sorted(repr((r.doc_id, r.n_words)) for r in got) == sorted(repr(r[:2]) for r in expected)


def test_anchors_on_texts_over_several_stretches(spark):
    r = random.Random(3)
    body = " ".join(str(r.randint(0, 5000)) for _ in range(330_000))  # about 1.6 MB
    tail = body[700_000:1_300_000]
    rows = [(1, body), (2, "start " + tail + " end"), (3, body), (4, "x " * 30 + body[1_048_000:1_049_200]), (5, "q" * 1_200_000 + " " + "w" * 1_100_000 + " z"), (6, "q" * 1_200_000 + " " + "w" * 1_100_000 + " z")]
    got = anchors.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.n_words, x.n_removed, sha(x.kept)) for x in got) == [(*x[:3], sha(x[3])) for x in plain_anchors(rows)]


def test_anchors_do_not_move_texts(spark):
    table, _ = anchors._table(spark.createDataFrame(passages(1), "doc_id long, text string"), "text", "doc_id", 20, 1 << 20)
    answers = spark.createDataFrame([], anchors.ANSWER)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = anchors._answered(table, answers, anchors._facts(table))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Bucketed: true" in next(x for x in plan.splitlines() if "FileScan" in x and "part#" in x)
    moved = [x for x in plan.splitlines() if "Exchange" in x]
    assert len(moved) == 1 and "g_" in moved[0]
    assert anchors.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# conversation trie


def plain_trie(rows, family=20, opening=3):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % (opening + 1)
        made[c] = tuple(own.get(c - (c % family if c >= 0 else -(-c % family)), [])[:h] + turns[h:])
    members = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def below(node):
        out, stack = [], [node]
        while stack:
            x = stack.pop()
            out.append(x)
            stack += children.get(x, [])
        return out

    result = []
    for node, cs in members.items():
        sub = below(node)
        saved = sum((len(members[x]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0) for x in sub)
        ends = ",".join(str(c) for c in sorted(c for c in cs if made[c] == node))
        result.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children.get(node, [])), sum(x not in children for x in sub), saved, sha(ends)))
    return sorted(map(repr, result))


SPOKEN = "conv_id long, turn long, role string, text string, c long, d long, words long, path string"


def spoken(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "p") for r in rows], SPOKEN)


def trie_rows(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(repr(tuple(r[n] for n in names)) for r in df.collect())


def test_trie_equals_plain_version(spark):
    r = random.Random(8)
    rows = []
    for c in [*range(0, 90), 1000, 5000, 12345, -3, -20, -25]:
        depth = r.randint(1, 7)
        for t in range(depth):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["hi", "hi there", "a b c", ""])))
    rows += [(7, 3, None, None), (7, None, "user", "first of all"), (7, None, "user", "first of all"), (8, 2, "z", "tie"), (8, 2, "a", "tie"), (8, 2, "a", "a tie"), (None, 1, "user", "nobody"), (21, 0, "user", "x")]
    got = trie_rows(trie.prefix_trie(spoken(spark, rows)))
    assert got == plain_trie(rows)


def test_trie_of_long_conversations_and_copies(spark):
    base = [("user", f"turn {k % 5} of many") for k in range(40)]
    rows = []
    for c, seq in [(20, base), (40, base), (60, base[:35]), (80, base[:39] + [("user", "other")]), (100, base[:1]), (120, [("assistant", "alone")] * 60), (140, base)]:
        rows += [(c, t, *x) for t, x in enumerate(seq)]
    assert trie_rows(trie.prefix_trie(spoken(spark, rows))) == plain_trie(rows)
    # a member without turns belongs to the root, which may be all there is
    lone = [(c, 0, "user", "x") for c in range(3) if zlib.crc32(str(c).encode()) % 4 and c % 20] or [(1, 0, "user", "x")]
    assert trie_rows(trie.prefix_trie(spoken(spark, lone))) == plain_trie(lone)
    assert trie.prefix_trie(spoken(spark, [])).count() == 0


def test_trie_ends_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 3)
    rows = [(c, 0, "user", "same") for c in range(0, 400, 20)] + [(c, t, "user", "same") for c in range(400, 800, 20) for t in (0, 1)]
    assert trie_rows(trie.prefix_trie(spoken(spark, rows))) == plain_trie(rows)


# mends of earlier operators


def test_labels_of_one_kind_say_nothing(spark):
    from sparkloom.llm import quality

    docs = spark.createDataFrame([(k, f"some text {k}\nof two lines") for k in range(30)], "doc_id long, text string")
    for kind in (0, 1):
        labels = spark.createDataFrame([(k, kind) for k in range(30)], "doc_id long, quality int")
        field = quality.learn(docs, labels)
        assert field is None and {r.score for r in quality.scores(docs, field).collect()} == {0.5}


def test_lines_of_very_long_texts(spark):
    from sparkloom.llm import line_dedup

    n = 50_000
    texts = [(k, "\n".join(f"the common line {'abcdefghij'[i % 10]} is in all of them" if i % 5 == 0 else f"own{k}x{i} {i * 31 + k}" for i in range(n))) for k in range(6)]
    got = {r.doc_id: r for r in line_dedup.drop_recurring(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for k, t in texts:
        lines, seen = t.split("\n"), set()
        kept = []
        for line in lines:
            if line.startswith("own"):
                kept.append(line)
            elif k == 0 and line not in seen:  # the first document keeps each once
                kept.append(line)
                seen.add(line)
        assert got[k].n_lines == n and got[k].text == "\n".join(kept)


def test_texts_that_share_a_hash_are_different_texts(spark, monkeypatch):
    from sparkloom.llm import suffix_dedup

    r = random.Random(6)
    common = "".join(r.choice("abcdef ") for _ in range(300))
    rows = [(k, "".join(r.choice("abcdefgh ") for _ in range(150)) + (common if k % 2 else common[50:220]) + str(k)) for k in range(14)] + [(20, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    own = suffix_dedup._identified

    def colliding(*args, **kwargs):
        found = own(*args, **kwargs)
        return found.withColumn("t1", F.when(F.length("text") > 0, F.col("t1") % 3).otherwise(F.col("t1")))

    monkeypatch.setattr(suffix_dedup, "_identified", colliding)
    got = {x.doc_id: (x.n_removed, bytes(x.kept)) for x in suffix_dedup.remove_repeats(df).collect()}
    monkeypatch.setattr(suffix_dedup, "_identified", own)
    plain = {x.doc_id: (x.n_removed, bytes(x.kept)) for x in suffix_dedup.remove_repeats(df).collect()}
    assert got == plain and sum(x[0] for x in got.values()) > 1000
    monkeypatch.setattr(suffix_dedup, "ALIKE", 1)
    monkeypatch.setattr(suffix_dedup, "_identified", colliding)
    with pytest.raises(ValueError, match="shared"):
        suffix_dedup.remove_repeats(df)
