"""Summaries of scored responses (AGG-13 .. AGG-19) and joins of questions with explanations (JN-6, JN-7)."""

from __future__ import annotations

# Fixed values throughout this module: the keys of reports, which results must share.

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import answers as A


def score(rows: DataFrame) -> DataFrame:
    """Adds jaccard, calibration and hallucination to rows of expected, actual, answer_type, confidence, context.

    Failed answers (null, empty, starting with ERROR or [ERROR]) go (FLT-10).
    """
    a = F.col("actual")
    rows = rows.where(a.isNotNull() & (a != "") & ~a.startswith("[ERROR]") & ~a.startswith("ERROR"))
    rows = rows.withColumn("jaccard", A.jaccard(A.clean_answer(F.col("expected")), A.clean_answer(a), F.col("answer_type")))
    return rows.withColumn("calibration", A.calibration(F.col("confidence"), F.col("jaccard"))).withColumn("hallucination", A.hallucination_rate(a, F.col("expected"), F.col("context"), F.col("answer_type")))


#: A response is well calibrated, or clean of made-up names, from these scores on; below SEVERE it is severely off.
CALIBRATED, CLEAN, SEVERE = 0.7, 0.7, 0.3


def _spread(name: str, value: str | Column) -> list[Column]:
    return [F.round(F.avg(value), 6).alias(name), F.round(F.stddev_pop(value), 6).alias(f"{name}_std")]


def _share(c: Column) -> Column:
    return F.round(F.avg(c.cast("double")), 6)


def _summary(columns: list[str]) -> list[Column]:
    """Figures of scored rows; those of response_time, token_count and inference_count where the columns are there."""
    j, h = F.col("jaccard"), F.col("hallucination")
    partial = (F.col("answer_type") != "BIN") & (j > 0) & (j < 1)
    out = [
        F.count("*").alias("n"), *_spread("accuracy", "jaccard"), F.count_if(j >= 1).alias("perfect"), F.count_if(partial).alias("partial"), F.count_if((j < 1) & ~partial).alias("wrong"),
        _share(j >= 1).alias("perfect_rate"), _share(partial).alias("partial_rate"), _share((j < 1) & ~partial).alias("wrong_rate"), *_spread("calibration", "calibration"),
        F.count_if(F.col("calibration") >= CALIBRATED).alias("well_calibrated"), *_spread("hallucination", "hallucination"), F.count_if(h >= CLEAN).alias("clean"), F.count_if(h < SEVERE).alias("severe"), _share(h < CLEAN).alias("hallucination_rate"),
    ]
    for c in ("response_time", "token_count"):
        out += _spread(c, c) if c in columns else []
    return [*out, F.round(F.avg("inference_count"), 6).alias("inference_count")] if "inference_count" in columns else out


def summary(rows: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """AGG-13: by model, and by model and answer type (answer_type ALL for the former); population deviation.

    With ``questions`` (answer_type) coverage is the percent of all questions of the kind that were evaluated.
    """
    both = rows.groupingSets([["model"], ["model", "answer_type"]], "model", "answer_type").agg(*_summary(rows.columns), F.grouping_id().alias("_g"))
    both = both.withColumn("answer_type", F.when(F.col("_g") == 0, F.col("answer_type")).otherwise("ALL")).drop("_g")
    if questions is None:
        return both
    sizes = questions.groupingSets([[], ["answer_type"]], "answer_type").agg(F.count("*").alias("_all"), F.grouping_id().alias("_g"))
    sizes = sizes.select(F.when(F.col("_g") == 0, F.col("answer_type")).otherwise("ALL").alias("answer_type"), "_all")
    return both.join(F.broadcast(sizes), "answer_type", "left").withColumn("coverage", F.round(100.0 * F.col("n") / F.col("_all"), 4)).drop("_all")


def composition(questions: DataFrame) -> DataFrame:
    """AGG-7: all questions, those of either kind, and their shares in percent."""
    n, b, m = F.count("*"), F.count_if(F.col("answer_type") == "BIN"), F.count_if(F.col("answer_type") == "MC")
    return questions.agg(n.alias("total"), b.alias("bin"), m.alias("mc"), F.round(100.0 * b / n, 4).alias("bin_percent"), F.round(100.0 * m / n, 4).alias("mc_percent"))


def group_summary(rows: DataFrame, least: int = 3) -> DataFrame:
    """AGG-14: by model and tag group, for groups of at least ``least`` rows."""
    g = rows.withColumn("tag_group", F.explode("tag_groups")).groupBy("model", "tag_group")
    return g.agg(*_summary(rows.columns), F.count_if(F.col("answer_type") == "BIN").alias("n_bin"), F.count_if(F.col("answer_type") == "MC").alias("n_mc")).where(F.col("n") >= least)


def key_findings(overall: DataFrame, groups: DataFrame, shares: DataFrame) -> DataFrame:
    """SNK-10: (model, json) of the summary file: preformatted overall figures, tag groups and answer types.

    overall is ``summary`` with coverage, groups ``group_summary``, shares ``tags.distribution`` (tag_group, share).
    """
    rate = lambda x: F.format_string("%.1f%%", F.coalesce(F.col(x), F.lit(0.0)) * 100)
    plain = lambda x: F.format_string("%.2f", F.coalesce(F.col(x), F.lit(0.0)))
    metrics = F.struct(
        rate("accuracy").alias("average_accuracy"), rate("perfect_rate").alias("perfect_answers"), rate("partial_rate").alias("partial_answers"), rate("wrong_rate").alias("wrong_answers"),
        rate("calibration").alias("confidence_calibration"), rate("hallucination").alias("hallucination_score"), plain("response_time").alias("average_response_time_ms"), plain("token_count").alias("average_token_count"),
    )
    kind = F.struct(F.format_string("%d (%.1f%%)", "n", "coverage").alias("successfully_evaluated"), rate("accuracy").alias("average_accuracy"), plain("response_time").alias("average_response_time_ms"), plain("token_count").alias("average_token_count"))
    whole = overall.groupBy("model").agg(F.max(F.when(F.col("answer_type") == "ALL", metrics)).alias("overall_metrics"), F.max(F.when(F.col("answer_type") == "BIN", kind)).alias("binary"), F.max(F.when(F.col("answer_type") == "MC", kind)).alias("mc"))
    named = groups.join(F.broadcast(shares.select("tag_group", "share")), "tag_group", "left")
    one = F.struct("tag_group", F.struct(rate("accuracy").alias("accuracy"), F.format_string("%.1f%%", F.coalesce(F.col("share"), F.lit(0.0))).alias("percentage_of_total")).alias("v"))
    by = named.groupBy("model").agg(F.map_from_entries(F.array_sort(F.collect_list(one))).alias("tag_group_analysis"))  # a row a tag group, of which there are ten
    out = whole.join(by, "model", "left")
    return out.select("model", F.to_json(F.struct("overall_metrics", "tag_group_analysis", F.struct("binary", "mc").alias("performance_by_answer_type"))).alias("json"))


def performance(rows: DataFrame, value: str = "response_time") -> DataFrame:
    """AGG-15: successes and errors, and the spread of positive times (sample deviation, exact median)."""
    v = F.when(F.col(value) > 0, F.col(value))
    return rows.groupBy("model").agg(
        F.count_if(~F.col("error")).alias("successes"), F.count_if(F.col("error")).alias("errors"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("std"),
        F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.percentile(v, 0.5), 6).alias("median"),
    )


def pattern_counts(rows: DataFrame, text: str, answer_type: str, task_type: str | None = None) -> DataFrame:
    """AGG-16, AGG-17: questions by kind, length and task; a dot anywhere makes a query count as complex."""
    n = A.words(F.col(text))
    tasks = [F.count_if(F.col(task_type) == "Membership").alias("membership"), F.count_if(F.col(task_type) == "Property Assertion").alias("property")] if task_type else []
    return rows.agg(
        *tasks,
        F.count("*").alias("total"), F.count_if(F.col(answer_type) == "BIN").alias("bin"), F.count_if(F.col(answer_type) == "MC").alias("mc"), F.count_if(n <= 5).alias("short"), F.count_if((n > 5) & (n <= 10)).alias("middle"),
        F.count_if(n > 10).alias("long"), F.count_if(F.contains(F.col(text), F.lit("."))).alias("complex"),
    )


def checkpoint_stats(rows: DataFrame) -> DataFrame:
    """AGG-18"""
    right = F.count_if(F.col("correctness") > 0.5)
    return rows.groupBy("model").agg(F.count_if(~F.col("error")).alias("responses"), F.count_if(F.col("error")).alias("errors"), right.alias("correct"), F.round(100.0 * F.try_divide(right, F.count_if(~F.col("error"))), 4).alias("accuracy"))


def context_sizes(rows: DataFrame, text: str) -> DataFrame:
    """AGG-19"""
    n = F.octet_length(text)
    return rows.agg(F.sum(n).cast("bigint").alias("total"), F.round(F.avg(n), 4).alias("mean"), F.count_if(n > 100_000).alias("above_100k"), F.count_if(n > 500_000).alias("above_500k"))


def time_estimate(calls: Column, workers: int, setting: str = "nl") -> Column:
    """AGG-22: planned seconds of a run."""
    return calls * (3.0 if setting == "nl" else 3.5) / workers


def top_groups(rows: DataFrame, k: int = 3) -> DataFrame:
    """LIM-2: the k groups of highest accuracy of each model, ties by name."""
    w = Window.partitionBy("model").orderBy(F.col("accuracy").desc(), "tag_group")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_available_context(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """SRC-14: the questions whose root entity has a context."""
    return questions.join(contexts.select("root_entity").distinct(), "root_entity", "left_semi")


def by_query(questions: DataFrame, explanations: DataFrame) -> DataFrame:
    """JN-6: equality of normalised queries; of several explanations the first by position."""
    e = explanations.groupBy(A.normal_query(F.col("query")).alias("norm")).agg(F.min(F.struct("pos", "explanation_id")).alias("m"))
    return questions.withColumn("norm", A.normal_query(F.col("query"))).join(e, "norm").select("question_id", "m.explanation_id")


def by_similarity(questions: DataFrame, explanations: DataFrame, least: float = 0.9) -> DataFrame:
    """JN-7: the first explanation whose token set has a Jaccard similarity of at least ``least``.

    A prefix join finds the pairs: of each set's tokens, rarest first, similar sets share one of the first
    n - ceil(least * n) + 1.  Only pairs that meet there are compared, so no cross join arises.
    """
    tokens = lambda df, i: df.select(F.col(i).alias("id"), *(["pos"] if "pos" in df.columns else []), F.array_distinct(F.split(A.normal_query(F.col("query")), " ")).alias("set"))
    q, e = tokens(questions, "question_id"), tokens(explanations, "explanation_id")
    often = q.select(F.explode("set").alias("t")).unionAll(e.select(F.explode("set").alias("t"))).groupBy("t").agg(F.count("*").alias("f"))

    def prefixes(df: DataFrame) -> DataFrame:
        r = df.select("id", F.size("set").alias("n"), F.explode("set").alias("t")).join(often, "t")
        w = Window.partitionBy("id").orderBy("f", "t")
        return r.withColumn("k", F.row_number().over(w)).where(F.col("k") <= F.col("n") - F.ceil(least * F.col("n")) + 1).select("id", "n", "t")

    a, b = prefixes(q), prefixes(e).select(F.col("id").alias("eid"), F.col("n").alias("m"), "t")
    met = a.join(b, "t").where(F.least("n", "m") >= least * F.greatest("n", "m")).select("id", "eid").distinct()
    full = met.join(q.select("id", F.col("set").alias("x")), "id").join(e.select(F.col("id").alias("eid"), "pos", F.col("set").alias("y")), "eid")
    like = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    best = full.where(like >= least).groupBy("id").agg(F.min(F.struct("pos", "eid")).alias("m"))
    return best.select(F.col("id").alias("question_id"), F.col("m.eid").alias("explanation_id"))
