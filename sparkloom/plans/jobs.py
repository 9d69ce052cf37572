"""The curation jobs from end to end: segments, questions, curation, evaluation. Configurations are frozen values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sparkloom import vocab as V
from sparkloom.functions import arrays as A
from sparkloom.functions import text as X
from sparkloom.operators import curate as C
from sparkloom.operators import dedup as D
from sparkloom.operators import epochs as E
from sparkloom.operators import intervals as I
from sparkloom.operators import measure as M
from sparkloom.operators import sampling as S
from sparkloom.operators import splits as P
from sparkloom.operators import templates as T
from sparkloom.sources.shared import kept


@dataclass(frozen=True)
class Windows:
    size: float = V.WINDOW_S
    step: float = V.STEP_S
    least: float = V.MIN_OVERLAP
    bucket: float | None = 900.0


@dataclass(frozen=True)
class Questions:
    most: int = 60
    share: float = 0.8
    types: int = 3
    target: float = 0.5
    tolerance: float = 0.1
    cap: int = 600
    dominant: float = 0.5
    style: str = "short"
    seed: str = "42"


def localized(parts: DataFrame, rows: DataFrame, names: tuple[str, str, str, str], repair: bool) -> DataFrame:
    """Cross-part intervals in each part that they touch (``i_start``, ``i_end`` in its own seconds)."""
    start_part, start, stop_part, stop = names
    met = rows.join(parts.select("case", "part", "duration"), "case").filter(F.coalesce(F.col(start_part), F.lit(1)) <= F.col("part")).filter(F.col("part") <= F.coalesce(F.col(stop_part), F.lit(1)))
    a, b = X.clock_seconds(F.col(start)), X.clock_seconds(F.col(stop))
    one = F.coalesce(F.col(start_part), F.lit(1)) == F.coalesce(F.col(stop_part), F.lit(1))
    if repair:
        b = F.when(one, I.repaired(a, b, F.col("duration"))).otherwise(b)
    begin, end = I.local_interval(F.col("part"), F.col("duration"), F.coalesce(F.col(start_part), F.lit(1)), a, F.coalesce(F.col(stop_part), F.lit(1)), b)
    return met.withColumn("i_start", begin).withColumn("i_end", end).filter("i_end IS NOT NULL")


def segments(parts: DataFrame, tasks: DataFrame, tools: DataFrame, config: Windows = Windows()) -> DataFrame:
    """Windows of all parts with their task, description and sets of tools."""
    windows = I.sliding_windows(parts, config.size, config.step).select("case", "video_path", "part", "t_start", "t_end")
    own = tasks.withColumn("label", F.struct(F.col("groundtruth_taskname").alias("task"), F.col("matched_description").alias("description")))
    local = localized(parts, own, ("start_part", "start_time", "stop_part", "stop_time"), False).select("case", "part", "i_start", "i_end", F.to_json("label").alias("label"), "row_no")
    labelled = I.majority_label(windows, local, ["case", "part"], "label", "row_no", least=config.least, bucket=config.bucket)
    got = F.from_json("label", "task string, description string")
    task = F.coalesce(F.nullif(F.trim(got.task), F.lit("")), F.lit(V.OUTSIDE_TASK))
    told = F.when(F.lower(F.trim(got.description)).isin("", "nan"), None).otherwise(got.description)
    default = F.when(task == V.OUTSIDE_TASK, "This segment contains activity outside of the structured training.").otherwise(F.concat(F.lit("The training activity is "), task, F.lit(".")))
    labelled = labelled.withColumn("task", task).withColumn("description", F.coalesce(told, default))
    name = F.lower(F.trim("groundtruth_toolname"))
    known = tools.withColumn("tool", name).filter(F.col("tool").isin(*V.TOOLS))
    sold = F.lower(F.trim("commercial_toolname"))
    known = known.withColumn("sold", F.when(~F.coalesce(sold, F.lit("")).isin("", "nan", V.UNKNOWN_COMMERCIAL), sold))
    placed = localized(parts, known, ("install_case_part", "install_case_time", "uninstall_case_part", "uninstall_case_time"), True).select("case", "part", "i_start", "i_end", "tool", "sold")
    out = I.active_sets(labelled, placed, ["case", "part"], {"tools": "tool", "commercial_tools": "sold"}, bucket=config.bucket)
    return out.select("case", "video_path", "part", "t_start", "t_end", "task", "description", "tools", "commercial_tools")


def _cut(rows: DataFrame) -> DataFrame:
    """Rows that several later steps read, written once to the shared folder."""
    return kept(rows, "cut")


def presence_targets(tools: Column, commercial: Column) -> dict[str, Column]:
    """Whether each tool, any forceps, or each commercial variant is present."""
    own: dict[str, Column] = {t: F.arrays_overlap(tools, F.array(*map(F.lit, V.FORCEPS))) if t == "forceps" else F.array_contains(tools, t) for t in V.PRESENCE_TARGETS}
    return own | {v: F.array_contains(commercial, v) for vs in V.VARIANTS.values() for v in vs}


def balanced_presence(made: DataFrame, pool: DataFrame, config: Questions) -> DataFrame:
    """Further presence questions, so that no key's share of yes is far from the target; segments come from the whole pool."""
    asked = made.filter("tool IS NOT NULL").withColumn("_yes", F.get("answers", F.lit(0)) == "Yes")
    needs = D.answer_needs(asked, "tool", F.col("_yes"), target=config.target, tolerance=config.tolerance, cap=config.cap)
    fit = D.presence_pool(pool, "tool", presence_targets(F.col("tools"), F.col("commercial_tools")))
    drawn = D.top_up(needs, fit, "tool", "present", "key", config.seed, config.cap, few_keys=True)
    each = F.concat_ws("|", F.lit("balance"), "key", "tool")
    qa = T.tool_presence(F.col("tools"), F.col("commercial_tools"), F.col("tool"), each)
    named = F.concat_ws("_", "key", F.lit("tp_bal"), (100 + F.pmod(F.xxhash64(each), F.lit(900))).cast("string"))
    return drawn.withColumn("qa", qa).select(named.alias("id"), F.col("video_path").alias("video"), "t_start", "t_end", "qa.question", "qa.answers", "tool", F.lit("tool_presence").alias("question_type"), each.alias("ord"))


def questions(rows: DataFrame, config: Questions = Questions()) -> DataFrame:
    """Sampled segments with questions of drawn types: presence balanced, dominant answers capped, without repeats, with unique ids.

    Where a list's order would decide (first of equal keys, ties of frequent
    answers, running numbers), a hash of the row's key does, which holds for any
    partitioning.
    """
    keyed = rows.withColumn("key", F.concat(F.col("case"), F.lit("_p"), F.col("part").cast("string"), F.lit("_t"), F.col("t_start").cast("long").cast("string")))
    chosen = S.stratified(keyed, "case", "key", (F.size("tools") > 0) | (F.col("task") != V.OUTSIDE_TASK), config.most, config.share, config.seed)
    drawn = S.slots(chosen, "key", V.TYPE_SLOTS, config.types, config.seed)
    each = F.concat_ws("|", "key", "slot_type", F.col("slot").cast("string"))
    targets = [*V.PRESENCE_TARGETS, *(v for vs in V.VARIANTS.values() for v in vs)]
    target = S.choose(targets, F.concat(F.lit("target|"), each))
    qa = T.for_type(F.col("slot_type"), tools=F.col("tools"), commercial=F.col("commercial_tools"), target=target, task=F.col("task"), text=F.col("description"), key=each, style=config.style)
    number = (100 + F.pmod(F.xxhash64(each), F.lit(900))).cast("string")
    made = drawn.withColumn("qa", qa).filter("qa IS NOT NULL")
    made = made.select(F.concat_ws("_", "key", "slot_type", number).alias("id"), F.col("video_path").alias("video"), "t_start", "t_end", "qa.question", "qa.answers", F.when(F.col("slot_type") == "tool_presence", target).alias("tool"), F.col("slot_type").alias("question_type"), each.alias("ord"))
    made = _cut(made)
    made = _cut(made.unionByName(balanced_presence(made, keyed, config)))
    capped = made.filter(~F.col("question_type").isin("task_id", "description"))
    some = made.filter(F.col("question_type").isin("task_id", "description")).withColumn("first", F.get("answers", F.lit(0)))
    kept = D.cap_dominant(some.withColumn("_o", F.xxhash64("ord")), "question_type", "first", "_o", "ord", config.dominant, config.seed).drop("first", "_o")
    both = _cut(capped.unionByName(kept))
    once = D.dedup_or_fail(both, ["video", "t_start", "t_end", X.normalize(F.col("question"))], "ord", F.to_json(F.array_sort(F.transform("answers", X.normalize))))
    return D.unique_ids(once.withColumn("_o", F.xxhash64("ord")), "id", "_o").drop("_o")


def curated(qa: DataFrame, statuses: DataFrame, keep: float = 0.1) -> DataFrame:
    """Questions with status, weight and action; rows with ``drop_reason`` are those to leave out."""
    seen = qa.join(statuses, C.KEY, "left").withColumn("visual_status", F.coalesce("visual_status", F.lit("valid")))
    return C.curate(seen.withColumn("grounding_status", C.grounding_status(F.col("question_type"), F.get("answers", F.lit(0)))), keep)


@dataclass
class Curated:
    """What one pass over the rows has made: the kept rows, all rows with their marks, and the counts of both."""

    kept: DataFrame
    annotated: DataFrame
    manifest: DataFrame


def curated_once(rows: DataFrame, path: str, vocabulary: dict[str, list[str]]) -> Curated:
    """Write marked rows (of ``curated``) below ``path``, kept and dropped ones apart, and count them while they are written.

    The counts are observed metrics of the write: rows, drops by reason, and the
    kept rows by the values of ``vocabulary`` (``other`` for all else), a number fixed
    by the vocabularies. A retried task's rows count once. The folder must be new.
    """
    spark = rows.sparkSession
    stays = F.col("drop_reason").isNull()
    figures = {("original_examples", ""): F.count("*"), ("curated", ""): F.count_if(stays), ("sample_weight", ""): F.coalesce(F.sum(F.when(stays, (F.col("sample_weight") * 100).cast("long"))), F.lit(0))}
    for column, values in {"drop_reason": C.DROP_REASONS, **vocabulary}.items():
        of = ~stays if column == "drop_reason" else stays
        for v in values:
            figures[column, v] = F.count_if(of & (F.col(column) == v))
        figures[column, "other"] = F.count_if(of & ~F.coalesce(F.col(column).isin(*values), F.lit(False)))
    seen = Observation("curation")
    marked = rows.observe(seen, *(c.alias(f"m{i}") for i, c in enumerate(figures.values())))
    marked.withColumn("outcome", F.when(stays, "kept").otherwise("dropped")).write.partitionBy("outcome").parquet(path)
    counts = seen.get
    manifest = spark.createDataFrame([(section, name, int(counts[f"m{i}"])) for i, (section, name) in enumerate(figures)], "section string, name string, n bigint")
    back = spark.read.schema(StructType([*rows.schema.fields, StructField("outcome", StringType())])).parquet(path)
    return Curated(back.filter("outcome = 'kept'").select(*rows.columns), back.select(*rows.columns), manifest)


@dataclass(frozen=True)
class Training:
    """How examples become batches."""

    epochs: int = 1
    size: int = 16
    most: int = 256
    spread: float = 1.25
    pad: int = 0
    seed: str = "train"


def training_batches(rows: DataFrame, tokens: Callable[[Column], Column], prompt: Callable[[Column], Column], whole: Callable[[Column, Column], Column], config: Training = Training()) -> DataFrame:
    """Rows (``id, question, answers, sample_weight``) as collated batches of every epoch.

    An epoch trains each row on one answer, in batches of like length that come in an
    order of the epoch's own; ``tokens`` turns a text into ids, ``prompt`` and ``whole``
    are the texts before and with the answer. Columns: ``epoch, batch, slot, width, id,
    sample_weight, ids, labels, attention_mask``.
    """
    stored = kept(rows.withColumn("_row", F.monotonically_increasing_id()), "examples")  # written, as ids may repeat and row numbers must hold
    every = stored.withColumn("epoch", F.explode(F.array(*(F.lit(e).cast("long") for e in range(config.epochs)))))
    chosen = every.withColumn("answer", E.epoch_answer(F.col("answers"), F.col("id"), F.col("epoch")))
    long = chosen.select("epoch", "_row", "answer", F.size(tokens(whole(F.col("question"), F.col("answer")))).alias("_n"), F.concat_ws("|", F.col("epoch").cast("string"), F.col("id").cast("string")).alias("_key"))
    # lengths alone are sorted and dealt; texts meet their places in one join
    batches = E.length_batches(kept(long, "lengths"), "_n", "_key", config.size, config.most, config.spread, config.seed, group="epoch")
    met = E.shuffled_batches(batches, "epoch", config.seed).join(stored.select("_row", "id", "question", "sample_weight"), "_row")
    encoded = met.select("epoch", "id", "sample_weight", tokens(prompt(F.col("question"))).alias("_p"), tokens(whole(F.col("question"), F.col("answer"))).alias("ids"), "batch", "slot", "width")
    labelled = encoded.withColumn("labels", A.supervised_labels(F.col("_p"), F.col("ids"), config.most))
    return E.collated(labelled.select("epoch", "id", "sample_weight", "ids", "labels", "batch", "slot", "width"), "ids", "labels", config.pad)


def diagnostic(rows: DataFrame, case: Column) -> DataFrame:
    """Curated rows (dropped ones included) once for each diagnostic slice that they are in, with ``slice``.

    The slices of black segments hold dropped rows too, on purpose.
    """
    (v0, v1), (t0, t1) = P.CASES["val"], P.CASES["test"]
    val, test, kept = case.between(v0, v1), case.between(t0, t1), F.col("drop_reason").isNull()
    seen, ground, kind = F.col("visual_status"), F.col("grounding_status"), F.col("question_type")
    clean = kept & (seen == "valid") & (ground != "generic_fallback")
    return C.slices(
        rows,
        {
            "val_clean": val & clean,
            "val_black": val & (seen == "fully_black"),
            "val_partial_black": val & (seen == "partially_black"),
            "val_simulated_organ": val & kept & (ground == "semantic_task_label"),
            "val_forceps": val & kept & (kind == "forceps_type"),
            "test_clean": test & clean,
            "test_forceps": test & kept & (kind == "forceps_type"),
        },
    )


def answered(items: DataFrame, outputs: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Items with the final ``prediction``: of a model's ``prediction`` and ``margin`` at the same ``place``, by the question's route; never blank."""
    met = M.aligned(items, outputs, "place", ["prediction", "margin"])
    done = X.threshold_answer(F.col("question"), F.col("margin"), F.col("prediction"), thresholds)
    return met.withColumn("prediction", F.coalesce(F.when(F.trim(done) != "", done), X.fallback_answer(F.col("question"))))


def evaluated(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of answered items: scores by type and over all, yes/no metrics, forceps metrics. Items without references are an error."""
    known = rows.filter(F.when(F.size("answers") > 0, F.lit(True)).otherwise(F.raise_error(F.lit("reference answers are missing")).cast("boolean")))
    scored = known.withColumn("bleu4", M.best_reference(F.col("answers"), F.col("prediction")))
    kind = F.coalesce("question_type", F.lit("unknown"))
    binary = known.filter(kind.isin("tool_presence")).withColumn("reference", F.get("answers", F.lit(0)))
    return M.score_rollup(scored, "question_type", ["bleu4"]), M.presence_metrics(binary, "prediction", "reference"), M.forceps_metrics(known.filter(kind == "forceps_type"), "prediction", "answers")


def validated(rows: DataFrame, whole: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The summary of each split, and one row for each broken rule (``rule``, ``detail``).

    ``rows`` has the splits' rows with ``split`` and ``place`` (from 1 in each split),
    ``whole`` the rows of all with ``place``, ``segments`` has ``row_no``.
    """
    case = X.case_number(F.col("id"), F.col("video"))
    met = P.with_segment(rows, segments, ["tools", "commercial_tools"], "row_no")
    rules = {"case_range": P.outside_cases(F.col("split"), case)} | C.answer_rules("place", ready=True)
    broken = C.violations(C.normalized(met), rules, C.STOPS).select("rule", F.concat_ws(" ", "split", "id").alias("detail"))
    shared = P.shared_ids(rows, "split", "id").select(F.lit("shared_ids").alias("rule"), F.concat_ws(" ", "left", "right", F.col("ids").cast("string")).alias("detail"))
    parts = [rows.filter(F.col("split") == s) for s in P.CASES]
    moved = P.misplaced(P.concatenated(parts, "place"), whole, "place", "id").select(F.lit("not_concatenated").alias("rule"), F.concat_ws(" ", F.col("place").cast("string"), "expected", "found").alias("detail"))
    repeated = P.id_counts(whole, "id").filter("NOT unique").select(F.lit("repeated_ids").alias("rule"), (F.col("rows") - F.col("ids")).cast("string").alias("detail"))
    return P.summary(rows.withColumn("case", case), "split", "case", "question_type"), broken.unionByName(shared).unionByName(moved).unionByName(repeated)


def one_response(question: DataFrame, output: DataFrame | None = None) -> DataFrame:
    """The response to a case: the model's answer (``prediction``, one row) if there is one that is not blank, else the fallback; always one row."""
    asked = question.agg(F.first("question", ignorenulls=True).alias("question"))
    said = F.lit(None).cast("string") if output is None else F.col("said")
    both = asked if output is None else asked.join(F.broadcast(output.agg(F.first("prediction", ignorenulls=True).alias("said"), F.lit(1).alias("_one"))), F.col("_one") == 1, "left").drop("_one")
    finished = X.finish_answer(F.col("question"), said)
    fallback = F.coalesce(X.fallback_answer(F.col("question")), F.lit("The surgical field is visible in this clip."))
    return both.select("question", F.coalesce(F.when(F.trim(finished) != "", finished), F.when(F.trim(said) != "", said), fallback).alias("response"))
