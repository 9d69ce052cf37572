"""Text rules as column expressions: normal forms, parsing, routing of questions and finishing of answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom import vocab as V

#: White space as Python's str.split and re know it.
WHITE = "(?U)[\\s\\x1c-\\x1f]+"


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def normalize(text: Column) -> Column:
    """Lower case, white space trimmed and made single."""
    return F.trim(F.regexp_replace(F.lower(text), WHITE, " "))


def polarity(text: Column) -> Column:
    """True for an answer that starts with yes, False with no, else null."""
    t = normalize(text)
    return F.when(F.startswith(t, F.lit("yes")), True).when(F.startswith(t, F.lit("no")), False)


def case_number(*texts: Column) -> Column:
    """The number after the first ``case`` (any case, an underscore may follow) of the first text that has one; else null."""
    return F.coalesce(*(F.nullif(F.regexp_extract(t, r"(?i)case_?(\d+)", 1), F.lit("")).cast("int") for t in texts))


def question_type(identifier: Column) -> Column:
    """Type of a question by its id; null if none is named."""
    rules = [("_tp_bal_", "tool_presence"), *((f"_{t}_", t) for t in V.TYPE_SLOTS)]
    return F.coalesce(*(F.when(F.contains(identifier, F.lit(mark)), F.lit(kind)) for mark, kind in rules))


def id_type(identifier: Column) -> Column:
    """What stands between the start second and the last number of an id."""
    return F.nullif(F.regexp_extract(identifier, r"_t\d+_(.+)_\d+$", 1), F.lit(""))


def part_number(path: Column) -> Column:
    """The number after the last ``part_`` of a file name, else 1."""
    return F.coalesce(F.regexp_extract(path, r"part_0*(\d{1,9})(?:\.mp4)?$", 1).try_cast("int"), F.lit(1))


def capitalize(text: Column) -> Column:
    """First letter upper, all others lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def capitalize_words(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, " "), capitalize), " ")


def upper_first(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def english_list(items: Column) -> Column:
    """``A``, ``A and B``, ``A, B and C``; null for an empty array."""
    size = F.size(items)
    head = F.array_join(F.slice(items, F.lit(1), F.greatest(size - 1, F.lit(0))), ", ")
    return F.when(size == 1, F.get(items, F.lit(0))).when(size > 1, F.concat(head, F.lit(" and "), F.get(items, size - 1)))


def clock_seconds(text: Column) -> Column:
    """Seconds of ``H:M:S``, ``M:S`` or a number; 0.0 for anything else."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda p: F.when(F.trim(p).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(p).try_cast("double")))
    value = lambda i: F.get(parts, F.lit(i))
    size = F.size(parts)
    total = F.when(size == 3, value(0) * 3600 + value(1) * 60 + value(2)).when(size == 2, value(0) * 60 + value(1)).when(size == 1, value(0))
    return F.coalesce(total, F.lit(0.0))


def join_key(value: Column) -> Column:
    """One text for equal keys: numbers without needless digits (rounded to 6 places), else trimmed lower case; null stays null."""
    text = F.trim(value.cast("string"))
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), text.try_cast("decimal(38,12)"))
    plain = F.regexp_replace(F.regexp_replace(F.round(number, 6).cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(F.lower(text) == "nan", None).when(number.isNotNull(), plain).otherwise(F.lower(text))


def stable_fraction(identifier: Column) -> Column:
    """A number in [0, 1) from the first 8 bytes of the id's SHA-256."""
    return F.conv(F.substring(F.sha2(identifier, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def plain_number(number: Column) -> Column:
    """Text of a double as Python writes it: the shortest digits, with an exponent below 1e-4 and from 1e16 on (there the JVM may write a digit more)."""
    told = F.abs(number.cast("double")).cast("string")
    digits = F.regexp_replace(F.regexp_extract(told, r"^(\d\.\d+)E", 1), r"\.0$", "")
    power = F.regexp_extract(told, r"E(-?\d+)$", 1).try_cast("int")
    run = F.replace(digits, F.lit("."), F.lit(""))
    n = F.length(run)
    above = F.when(n <= power + 1, F.concat(F.rpad(run, power + 1, F.lit("0")), F.lit(".0"))).otherwise(F.concat(F.substring(run, F.lit(1), power + 1), F.lit("."), F.substring(run, power + 2, n)))
    below = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-power - 1, F.lit(0))), run)
    far = F.concat(digits, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0")))
    text = F.when(F.isnan(number.cast("double")), "nan").when(told == "Infinity", "inf").when(power.isNull(), told).when(power.between(0, 15), above).when(power.between(-4, -1), below).otherwise(far)
    negative = (number < 0) | F.startswith(number.cast("double").cast("string"), F.lit("-"))
    return F.when(number.isNotNull(), F.concat(F.when(negative & ~F.isnan(number.cast("double")), "-").otherwise(""), text))


def segment_key(video: Column, start: Column, end: Column) -> Column:
    """MD5 of the video and the times in seconds, joined by vertical bars."""
    return F.md5(F.concat_ws("|", video, plain_number(start), plain_number(end)))


def legacy_path(path: Column, root: str, legacy_root: str) -> Column:
    """The path as an older layout wrote it: what stands from the folder ``root`` on, below ``legacy_root``, with back slashes; null if it is not below it."""
    found = F.nullif(F.regexp_extract(path, rf"(?i)(?:^|[\\/])({root}(?:[\\/].*)?)$", 1), F.lit(""))
    return F.concat(F.lit(legacy_root + "\\"), F.replace(found, F.lit("/"), F.lit("\\")))


def cache_keys(video: Column, start: Column, end: Column, root: str, legacy_root: str) -> Column:
    """Keys under which a segment's frames may lie: by its path, then by its older path."""
    old = legacy_path(video, root, legacy_root)
    return F.array_compact(F.array_distinct(F.array(segment_key(video, start, end), F.when(old.isNotNull(), segment_key(old, start, end)))))


def relative_path(path: Column, root: str) -> Column:
    """The part of a path from the folder ``root`` on, with forward slashes; the whole path if it is not below it."""
    found = F.regexp_extract(path, rf"(?i)[\\/]({root}[\\/].*)$", 1)
    return F.replace(F.coalesce(F.nullif(found, F.lit("")), path), F.lit("\\"), F.lit("/"))


# questions


def is_binary(question: Column) -> Column:
    q = normalize(question)
    return ~reduce(lambda a, b: a | b, (F.startswith(q, F.lit(p)) for p in V.OPEN_PREFIXES))


def is_forceps_type(question: Column) -> Column:
    q = normalize(question)
    return _any(q, ["forceps type", "type of forceps"]) & _any(q, V.FORCEPS_VERBS)


def is_tool_presence(question: Column) -> Column:
    q = normalize(question)
    return is_binary(question) & ~is_forceps_type(question) & _any(q, V.PRESENCE_TARGETS) & _any(q, V.PRESENCE_STEMS)


def is_tissue_cutting(question: Column) -> Column:
    q = normalize(question)
    return is_binary(question) & (q.rlike(r"\bcut(ting)?\b") | (F.contains(q, F.lit("tissue")) & F.contains(q, F.lit("dissect"))))


def is_suture_required(question: Column) -> Column:
    q = normalize(question)
    return is_binary(question) & F.contains(q, F.lit("sutur")) & F.contains(q, F.lit("required"))


def is_procedure_type(question: Column) -> Column:
    return _any(normalize(question), V.PROCEDURE_MARKERS)


def is_tool_purpose(question: Column) -> Column:
    return _any(normalize(question), ["purpose", "role is"])


def is_organ(question: Column) -> Column:
    return _any(normalize(question), V.ORGAN_MARKERS)


def purpose_answer(question: Column) -> Column:
    """The purpose of the longest tool that the question names, as a sentence; null without one."""
    q = normalize(question)
    by_length = sorted(V.TOOLS, key=len, reverse=True)
    named = [F.when(F.contains(q, F.lit(t)), F.lit(V.PURPOSE[t])) for t in by_length]
    found = F.coalesce(*named, F.when(F.contains(q, F.lit("forceps")), F.lit(V.PURPOSE["cadiere forceps"])))
    return F.concat(upper_first(found), F.lit("."))


def forceps_named(text: Column) -> Column:
    """The forceps that a text names, in canonical order."""
    t = normalize(text)
    return F.filter(F.array(*map(F.lit, V.FORCEPS)), lambda v: F.contains(t, v))


def canonical_forceps(prediction: Column) -> Column:
    return F.coalesce(english_list(F.transform(forceps_named(prediction), capitalize_words)), F.lit(V.NO_FORCEPS))


def canonical_organ(prediction: Column) -> Column:
    return F.when(_any(normalize(prediction), V.KNOWN_ORGANS), prediction).otherwise(F.lit(V.ORGAN_FALLBACK))


def frame_answer(question: Column, answer: Column) -> Column:
    """A bare answer in a sentence that echoes the question; sentences and blank answers stay as they are."""
    text, q = F.trim(answer), normalize(question)
    sentence = F.concat(F.lit(" "), normalize(text), F.lit(" ")).rlike(" (is|are|was|were|shows) ")
    bare = F.regexp_replace(text, "[ .]+$", "")
    framed = F.lit(None).cast("string")
    for marker, frame in reversed(V.FRAMES):
        before, after = frame.split("{}")
        body = F.regexp_replace(bare, "^([Tt]he|[Aa]n?) ", "") if before.endswith(" the ") else bare
        framed = F.when(F.contains(q, F.lit(marker)), F.concat(F.lit(before), body, F.lit(after))).otherwise(framed)
    return F.when((text == "") | sentence, answer).otherwise(F.coalesce(framed, answer))


def finish_answer(question: Column, prediction: Column) -> Column:
    """The answer that closed vocabularies allow; other predictions stay as they are."""
    return (
        F.when(is_procedure_type(question), F.lit(V.PROCEDURE_ANSWER))
        .when(is_tool_purpose(question), F.coalesce(purpose_answer(question), prediction))
        .when(is_forceps_type(question), frame_answer(question, canonical_forceps(prediction)))
        .when(is_organ(question), canonical_organ(prediction))
        .otherwise(prediction)
    )


def route(question: Column) -> Column:
    """Which rule answers a question."""
    return (
        F.when(is_tool_presence(question), "tool_presence")
        .when(is_tissue_cutting(question), "tissue_cutting")
        .when(is_suture_required(question), "suture_required")
        .when(is_procedure_type(question), "procedure_type")
        .when(is_tool_purpose(question), F.when(purpose_answer(question).isNotNull(), "tool_purpose").otherwise("tool_purpose_NO_LOOKUP"))
        .when(is_forceps_type(question), "forceps_type")
        .when(is_organ(question), "organ")
        .otherwise("free_generation")
    )


def threshold_answer(question: Column, margin: Column, prediction: Column, thresholds: dict[str, float]) -> Column:
    """Yes or No by the margin for the binary routes, the finished prediction for the others and for margins that are not finite."""
    way = route(question)
    limit = F.coalesce(*(F.when(way == k, F.lit(v)) for k, v in thresholds.items()))
    finite = margin.isNotNull() & ~F.isnan(margin) & (F.abs(margin) != float("inf"))
    return F.when(limit.isNotNull() & finite, F.when(margin >= limit, "Yes").otherwise("No")).otherwise(finish_answer(question, prediction))


def fallback_answer(question: Column) -> Column:
    """What is answered without a prediction."""
    done = finish_answer(question, F.lit(""))
    return F.when(done != "", done).when(is_binary(question), "Yes").otherwise("The surgical field is visible in this clip.")


def semantic_organ_answers(first: Column) -> Column:
    label = F.regexp_replace(F.trim(first), "[.?!]+$", "")
    return F.array(label, *(F.concat(F.lit(a.split("{}")[0]), F.lower(label), F.lit(a.split("{}")[1])) for a in V.SEMANTIC_ANSWERS))
