"""Question and answer templates as column expressions: ``question`` and five ``answers`` of a segment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom import vocab as V
from sparkloom.functions.text import capitalize, capitalize_words, english_list, stable_fraction, upper_first
from sparkloom.operators.sampling import choose


def _fill(template: str, parts: dict[str, Column]) -> Column:
    """A template with its named places filled."""
    out: list[Column] = []
    rest = template
    while rest:
        found = [(rest.find(k), k) for k in parts if k in rest]
        if not found:
            out.append(F.lit(rest))
            break
        at, k = min(found)
        if at:
            out.append(F.lit(rest[:at]))
        out.append(parts[k])
        rest = rest[at + len(k) :]
    return F.concat(*out)


def _all(templates: list[str], parts: dict[str, Column] | None = None) -> Column:
    return F.array(*(_fill(t, parts or {}) for t in templates))


def _pick(kind: str, key: Column, parts: dict[str, Column] | None = None) -> Column:
    """One of the type's questions by the key, with its places filled."""
    options = _all(V.QUESTIONS[kind], parts)
    place = choose([str(k) for k in range(len(V.QUESTIONS[kind]))], key).cast("int")
    return F.get(options, place)


def _row(question: Column, answers: Column) -> Column:
    return F.struct(question.alias("question"), answers.alias("answers"))


def tool_presence(tools: Column, commercial: Column, target: Column, key: Column) -> Column:
    """Is a tool, any forceps, or a commercial variant listed as installed?"""
    variant = target.isin(*(v for vs in V.VARIANTS.values() for v in vs))
    present = F.when(target == "forceps", F.arrays_overlap(tools, F.array(*map(F.lit, V.FORCEPS)))).when(variant, F.array_contains(commercial, target)).otherwise(F.array_contains(tools, target))
    name = {"{}": target}
    return _row(_pick("tool_presence", key, name), F.when(present, _all(V.ANSWERS["presence_yes"], name)).otherwise(_all(V.ANSWERS["presence_no"], name)))


def forceps_type(tools: Column) -> Column:
    active = F.filter(F.array(*map(F.lit, V.FORCEPS)), lambda t: F.array_contains(tools, t))
    name = {"{}": F.coalesce(english_list(F.transform(active, capitalize_words)), F.lit(""))}
    n = F.size(active)
    pick = lambda kinds, make: F.when(n == 0, make(kinds[0])).when(n == 1, make(kinds[1])).otherwise(make(kinds[2]))
    kinds = ["forceps_none", "forceps_one", "forceps_many"]
    return _row(pick(kinds, lambda k: F.lit(V.QUESTIONS[k][0])), pick(kinds, lambda k: _all(V.ANSWERS[k], name)))


def suture_required(task: Column) -> Column:
    return _row(F.lit(V.QUESTIONS["suture_required"][0]), F.when(F.contains(F.lower(task), F.lit("suturing")), _all(V.ANSWERS["suture_yes"])).otherwise(_all(V.ANSWERS["suture_no"])))


def task_identification(task: Column, key: Column) -> Column:
    name = {"{}": F.when(F.coalesce(task, F.lit("")) == "", V.OUTSIDE_TASK).otherwise(capitalize(task))}
    return _row(_pick("task_id", key), _all(V.ANSWERS["task_id"], name))


def organ_of(task: Column, description: Column) -> Column:
    by_task = [F.when(task == t, F.lit(o)) for t, o in V.TASK_ORGAN.items()]
    by_word = [F.when(F.contains(F.lower(description), F.lit(w)), F.lit(o)) for w, o in V.ORGAN_WORDS]
    return F.coalesce(*by_task, *by_word, F.lit(V.DEFAULT_ORGAN))


def organ(task: Column, description: Column, key: Column) -> Column:
    o = organ_of(task, description)
    return _row(_pick("organ", key), _all(V.ANSWERS["organ"], {"{}": o, "{C}": capitalize(o)}))


def procedure_type(key: Column) -> Column:
    return _row(_pick("procedure_type", key), _all(V.ANSWERS["procedure_type"]))


def tool_purpose(tools: Column, key: Column) -> Column:
    """The purpose of one active tool; null without one."""
    active = F.filter(F.array(*map(F.lit, V.TOOLS)), lambda t: F.array_contains(tools, t))
    place = F.least(F.floor(stable_fraction(F.concat(key.cast("string"), F.lit("|tool"))) * F.size(active)), F.size(active) - 1).cast("int")
    tool = F.get(active, place)
    purpose = F.coalesce(*(F.when(tool == t, F.lit(p)) for t, p in V.PURPOSE.items()))
    parts = {"{}": tool, "{p}": purpose, "{P}": upper_first(purpose), "{C}": capitalize(tool)}
    return F.when(F.size(active) > 0, _row(_pick("tool_purpose", key, parts), _all(V.ANSWERS["tool_purpose"], parts)))


def tissue_cutting(tools: Column, task: Column, key: Column) -> Column:
    cuts = F.arrays_overlap(tools, F.array(*map(F.lit, V.CUTTING_TOOLS))) | F.lower(task).isin(*V.CUTTING_TASKS)
    return _row(_pick("tissue_cutting", key), F.when(cuts, _all(V.ANSWERS["cutting_yes"])).otherwise(_all(V.ANSWERS["cutting_no"])))


def clean_description(text: Column, style: str = "short") -> Column:
    """The first sentence (or, long, about 200 characters) of a description; null if it is missing, short or a placeholder."""
    clean = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    low = F.lower(clean)
    bad = clean.isNull() | (low == "nan") | (F.length(clean) < 10)
    for marker in V.DESCRIPTION_REJECTS:
        bad = bad | F.contains(low, F.lit(marker))
    most = 140 if style == "short" else 200
    cut = F.concat(F.regexp_replace(F.regexp_replace(F.substring(clean, 1, most), " [^ ]*$", ""), "[ ,;:]+$", ""), F.lit("."))
    ended = F.when(clean.rlike(r"[.!?]$"), clean).otherwise(F.concat(clean, F.lit(".")))
    done = F.when(F.length(clean) > most, cut).otherwise(ended)
    if style == "short":
        first = F.regexp_extract(F.substring(clean, 1, most), r"^([^.!?]*[.!?])", 1)
        done = F.when(F.length(first) >= 16, first).otherwise(done)
    return F.when(~bad, done)


def description(text: Column, key: Column, style: str = "short") -> Column:
    d = clean_description(text, style)
    body = F.regexp_replace(d, "[.!?]$", "")
    lowered = F.concat(F.lower(F.substring(body, 1, 1)), F.substring(body, 2, 1 << 30))
    return F.when(d.isNotNull(), _row(_pick("description", key), _all(V.ANSWERS["description"], {"{D}": d, "{b}": lowered})))


def for_type(kind: Column, *, tools: Column, commercial: Column, target: Column, task: Column, text: Column, key: Column, style: str = "short") -> Column:
    """The row of a type for a segment."""
    return (
        F.when(kind == "tool_presence", tool_presence(tools, commercial, target, key))
        .when(kind == "forceps_type", forceps_type(tools))
        .when(kind == "suture_required", suture_required(task))
        .when(kind == "task_id", task_identification(task, key))
        .when(kind == "organ", organ(task, text, key))
        .when(kind == "procedure_type", procedure_type(key))
        .when(kind == "tool_purpose", tool_purpose(tools, key))
        .when(kind == "tissue_cutting", tissue_cutting(tools, task, key))
        .when(kind == "description", description(text, key, style))
    )
