"""Curation of question/answer rows: visual status, drop, weight and rewrite rules, summaries, constraint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom import vocab as V
from sparkloom.functions.text import normalize, semantic_organ_answers, stable_fraction

KEY = ["video", "t_start", "t_end"]
DROP_REASONS = ["drop_fully_black_visual_question", "drop_generic_organ_fallback"]


def visual_status(audit: DataFrame, confirmed: DataFrame) -> DataFrame:
    """One status for each segment key: fully black dominates partially black; other keys are not listed."""
    sure = confirmed.filter("all_three_near_black").select(*KEY).distinct().withColumn("_sure", F.lit(True))
    rows = audit.join(sure, KEY, "left")
    fully = (F.startswith("source", F.lit("cache")) & F.col("all_near_black")) | F.coalesce("_sure", F.lit(False))
    rank = F.when(fully, 2).when(F.col("any_near_black"), 1).otherwise(0)
    return rows.groupBy(*KEY).agg(F.max(rank).alias("_r")).filter("_r > 0").select(*KEY, F.when(F.col("_r") == 2, "fully_black").otherwise("partially_black").alias("visual_status"))


def grounding_status(kind: Column, first_answer: Column) -> Column:
    return (
        F.when((kind == "organ") & (F.lower(F.trim(first_answer)) == V.GENERIC_ORGAN), "generic_fallback")
        .when(kind == "organ", "semantic_task_label")
        .when(kind.isin(*V.DROP_WHEN_BLACK), "visual_claim")
        .otherwise("metadata_or_language")
    )


def curate(rows: DataFrame, keep: float = 0.1) -> DataFrame:
    """Rows (``id, question, answers, question_type, visual_status, grounding_status``) with ``drop_reason``, ``sample_weight``, ``curation_action``, rewritten questions and ``original_question``."""
    if not 0 < keep <= 1:
        raise ValueError("keep must be in (0, 1]")
    kind, seen, ground = F.col("question_type"), F.col("visual_status"), F.col("grounding_status")
    fraction = stable_fraction(F.col("id"))
    black, partly = seen == "fully_black", seen == "partially_black"
    generic, semantic = ground == "generic_fallback", ground == "semantic_task_label"
    reason = F.when(black & kind.isin(*V.DROP_WHEN_BLACK), "drop_fully_black_visual_question").when(generic & (fraction >= keep), "drop_generic_organ_fallback")
    black_weight = F.coalesce(*(F.when(kind == k, F.lit(w)) for k, w in V.BLACK_WEIGHTS.items()), F.lit(0.1))
    weight = F.when(black, black_weight).when(partly, 0.5).otherwise(1.0)
    weight = F.when(generic | semantic, F.least(weight, F.lit(0.5))).otherwise(weight)
    actions = F.array_compact(
        F.array(
            F.when(black, "downweight_fully_black_metadata").when(partly, "downweight_partially_black"),
            F.when(generic, "downsample_generic_organ_fallback").when(semantic, "rewrite_semantic_organ"),
        )
    )
    place = F.least(F.floor(fraction * len(V.SEMANTIC_QUESTIONS)), F.lit(len(V.SEMANTIC_QUESTIONS) - 1)).cast("int")
    return rows.withColumns(
        {
            "drop_reason": reason,
            "sample_weight": weight,
            "curation_action": F.when(F.size(actions) > 0, F.array_join(actions, "+")).otherwise("keep"),
            "original_question": F.when(semantic, F.col("question")),
            "question": F.when(semantic, F.get(F.array(*map(F.lit, V.SEMANTIC_QUESTIONS)), place)).otherwise(F.col("question")),
            "answers": F.when(semantic, semantic_organ_answers(F.get("answers", F.lit(0)))).otherwise(F.col("answers")),
        }
    )


def histograms(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of the values of each column, and of all rows (``column`` null), in one pass of grouping sets."""
    sets = [F.array(F.struct(F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("value")), *(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))]
    return rows.select(F.explode(sets[0]).alias("s")).groupBy("s.column", "s.value").agg(F.count("*").alias("n"))


def slices(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Each row once for every named condition that holds for it, with ``slice``."""
    named = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in conditions.items())))
    return rows.withColumn("slice", F.explode(named))


def violations(rows: DataFrame, rules: dict[str, Column], stops: tuple[str, ...] = ()) -> DataFrame:
    """One row (all columns and ``rule``) for each rule that a row breaks; a broken rule of ``stops`` hides those after it."""
    broken, halted = [], F.lit(False)
    for name, bad in rules.items():
        now = F.coalesce(bad, F.lit(False)) & ~halted
        broken.append(F.when(now, F.lit(name)))
        if name in stops:
            halted = halted | F.coalesce(bad, F.lit(False))
    judged = rows.withColumn("_broken", F.array_compact(F.array(*broken)))  # rules may hold window functions, generators may not
    return judged.withColumn("rule", F.explode("_broken")).drop("_broken")


def normalized(rows: DataFrame) -> DataFrame:
    """Rows with ``_answers`` and ``_question`` in normal form, which most of ``answer_rules`` read."""
    return rows.withColumns({"_answers": F.transform("answers", normalize), "_question": normalize(F.col("question"))})


def answer_rules(order: str = "ord", ready: bool = False) -> dict[str, Column]:
    """Rules on one question/answer row joined with its segment (``tools``, ``commercial_tools``, ``found``); ``ready``: the rows are ``normalized``, so texts are brought into normal form once."""
    answers = F.col("_answers") if ready else F.transform("answers", normalize)
    question = F.col("_question") if ready else normalize(F.col("question"))
    text = F.concat_ws(" ", "question", F.array_join("answers", " "))
    kind = F.col("question_type")
    key = Window.partitionBy(*KEY, question).orderBy(order)
    signature = F.sort_array(answers)  # in any one order
    truth = (
        F.when(F.col("tool") == "forceps", F.arrays_overlap("tools", F.array(*map(F.lit, V.FORCEPS))))
        .when(F.col("tool").isin(*(v for vs in V.VARIANTS.values() for v in vs)), F.array_contains("commercial_tools", F.col("tool")))
        .otherwise(F.array_contains("tools", F.col("tool")))
    )
    active = F.filter(F.array(*map(F.lit, V.FORCEPS)), lambda t: F.array_contains("tools", t))
    return {
        "missing_field": F.col("id").isNull() | F.col("question").isNull() | F.col("answers").isNull(),
        "not_five": F.size("answers") != 5,
        "empty_reference": F.exists(answers, lambda a: a == ""),
        "not_unique": F.size(F.array_distinct(answers)) != 5,
        **{f"grammar_{k}": text.rlike("(?i)" + p) for k, p in enumerate(V.FORBIDDEN)},
        "conflict": (F.row_number().over(key) > 1) & (F.first(signature).over(key) != signature),
        "duplicate": (F.row_number().over(key) > 1) & (F.first(signature).over(key) == signature),
        "no_segment": ~F.col("found"),
        "presence_wording": (kind == "tool_presence") & ~(F.contains(question, F.lit("listed")) | F.contains(question, F.lit("installation record"))),
        "presence_claim": (kind == "tool_presence") & question.rlike("(?i)" + V.PRESENCE_CLAIM),
        "presence_label": (kind == "tool_presence") & ((F.get(answers, F.lit(0)) == "yes") != truth),
        "forceps_omitted": (kind == "forceps_type") & F.exists(answers, lambda a: F.exists(active, lambda t: ~F.contains(a, t))),
        "forceps_singular": (kind == "forceps_type") & (F.size(active) >= 2) & ~F.contains(question, F.lit("types")),
        "purpose_no_tool": (kind == "tool_purpose") & (F.size("tools") == 0),
        "purpose_other_tool": (kind == "tool_purpose") & (F.size("tools") > 0) & ~F.exists("tools", lambda t: F.contains(question, t)),
        "organ_not_unique": (kind == "organ") & (F.col("grounding_status") == "semantic_task_label") & (F.size(F.array_distinct(answers)) != 5),
        "description_placeholder": (kind == "description") & F.lower(text).rlike("|".join(V.DESCRIPTION_REJECTS)),
    }


STOPS = ("missing_field", "not_five", "no_segment")


def fail_on(report: DataFrame) -> DataFrame:
    """The report, which cannot be read if it has rows."""
    return report.filter(F.raise_error(F.concat(F.lit("constraint violated: "), F.col("rule"))).isNotNull())
