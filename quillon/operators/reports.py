"""Run counters, timings, text figures and the records of a run (AGG-7, AGG-8, AGG-10, AGG-23, SNK-4, SNK-9, SNK-13, LIM-3, SUP-*)."""

from __future__ import annotations

# Fixed values throughout this module: the keys of reports, which results must share.

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Config:
    """SUP-11: the settings of a run, kept beside its results as one row."""

    mode: str = "nl"
    abstracted: bool = False
    checkpoint_frequency: int = 50
    batch_size: int = 25
    workers: int = 8

    def row(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(self).values())], "mode string, abstracted boolean, checkpoint_frequency int, batch_size int, workers int")


class Timers:
    """SUP-2: durations of named steps on the driver, in milliseconds; a step that runs twice adds up."""

    def __init__(self) -> None:
        self.taken: dict[str, int] = {}

    @contextmanager
    def step(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.taken[name] = self.taken.get(name, 0) + round((time.perf_counter() - began) * 1000)

    def table(self, spark: SparkSession) -> DataFrame:
        return durations(spark.createDataFrame([*self.taken.items()], "step string, ms bigint"))


def durations(steps: DataFrame) -> DataFrame:
    """AGG-8: (rank, step, ms) of all steps (step, ms), the longest first, ties by name, the total last with rank 0."""
    summed = steps.groupBy("step").agg(F.sum("ms").alias("ms"))  # a row a step of the program
    ranked = summed.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("ms"), "step"))).select("rank", "step", "ms")
    return ranked.unionByName(summed.agg(F.lit(0).alias("rank"), F.lit("total").alias("step"), F.sum("ms").alias("ms")))


def run_counters(questions: DataFrame, ontologies: DataFrame, inferences: DataFrame) -> DataFrame:
    """AGG-7, SUP-4: one row of a run: ontologies read and rejected, inferences, questions of either kind.

    questions has answer_type, ontologies graph_id and _error (null where it was read), inferences a row each.
    """
    o = ontologies.groupBy("graph_id").agg(F.max(F.col("_error").isNotNull()).alias("bad")).agg(F.count_if(~F.col("bad")).alias("ontologies"), F.count_if("bad").alias("errors"))
    q = questions.agg(F.count("*").alias("questions"), F.count_if(F.col("answer_type") == "BIN").alias("bin"), F.count_if(F.col("answer_type") == "MC").alias("mc"))
    return o.crossJoin(inferences.agg(F.count("*").alias("inferences"))).crossJoin(q)  # one row each


def errors(triples: DataFrame) -> DataFrame:
    """SUP-4: (graph_id, message) of what could not be read."""
    return triples.where("_error is not null").select("graph_id", F.col("_error").alias("message")).distinct()


def first_present(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """AGG-10: each group's first non-null value by ``order``; null where all are."""
    v = F.col(value)
    return rows.groupBy(*keys).agg(F.min(F.when(v.isNotNull(), F.struct(F.col(order).alias("o"), v.alias("v")))).alias("m")).select(*keys, F.col("m.v").alias(value))


def occurrences(axioms: Column) -> Column:
    """AGG-23: names of classes and properties in an axiom (kind, args): all distinct arguments but individuals."""
    k, x = axioms["kind"], F.array_distinct(axioms["args"])
    return F.when(k.isin("ClassAssertion", "PropertyAssertion"), F.lit(1)).otherwise(F.size(x))


def is_schema_axiom(axioms: Column) -> Column:
    """AGG-23: whether an axiom speaks of classes and properties alone."""
    return ~axioms["kind"].isin("ClassAssertion", "PropertyAssertion")


def last_results(rows: DataFrame, order: str, k: int = 5) -> DataFrame:
    """LIM-3: the k latest rows of each model; Spark keeps k rows a group of each task before they meet."""
    w = Window.partitionBy("model").orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def text_statistics(rows: DataFrame, done: Column, seconds: float) -> DataFrame:
    """SNK-13: (line) of the statistics file: all questions, those done, errors, rates and times."""
    n, ok = F.col("n"), F.col("ok")
    t = F.lit(float(seconds))
    lines = F.array(
        F.lit("Processing Statistics"), F.lit("===================="), F.format_string("Total questions: %d", n), F.format_string("Successfully processed: %d", ok), F.format_string("Errors: %d", n - ok),
        F.format_string("Success rate: %.1f%%", F.try_divide(ok, n) * 100), F.format_string("Total processing time: %.2f seconds", t), F.format_string("Average time per question: %.2f seconds", F.try_divide(t, n)),
    )
    return rows.agg(F.count("*").alias("n"), F.count_if(done).alias("ok")).select(F.posexplode(lines).alias("n", "line"))


def tagged_record(key: Column, explanation: Column, tags: Column, at: Column) -> Column:
    """SNK-4: ``"key": {explanation, tags, timestamp}`` with the time in milliseconds."""
    name = F.to_json(F.struct(key.alias("k")))
    body = F.to_json(F.struct(explanation.alias("explanation"), tags.alias("tags"), F.unix_millis(at).alias("timestamp")))
    return F.concat(name.substr(F.lit(6), F.length(name) - 6), F.lit(": "), body)


def experiment_summary(results: DataFrame, config: Config, seconds: float) -> DataFrame:
    """SNK-9: (json) of a run: its settings, times, calls, and by model success rate, mean time and correctness.

    results has task_id, model, error, seconds and correctness; a model is a setting, so the row has an entry for each.
    """
    good = ~F.col("error")
    by = results.groupBy("model").agg(
        F.count("*").alias("calls"), F.round(F.avg(good.cast("double")), 6).alias("success_rate"), F.round(F.avg(F.when(good, F.col("seconds"))), 6).alias("response_time"), F.round(F.avg(F.when(good, F.col("correctness"))), 6).alias("correctness")
    )
    per = by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", F.struct("calls", "success_rate", "response_time", "correctness").alias("v"))))).alias("performance_summary"), F.sum("calls").alias("total_api_calls"))
    asked = results.agg(F.count_distinct("task_id").alias("total_questions_processed"))
    conf = F.struct(*[F.lit(v).alias(k) for k, v in asdict(config).items()]).alias("config")
    return per.crossJoin(asked).select(F.to_json(F.struct(conf, F.lit(float(seconds)).alias("experiment_time_seconds"), "total_questions_processed", "total_api_calls", "performance_summary")).alias("json"))


def ontology_name(iri: Column) -> Column:
    """SUP-5: the local name of an ontology's IRI, ``unknown`` if it has none."""
    from quillon.functions.names import local_name

    return F.coalesce(F.nullif(local_name(iri), F.lit("")), F.lit("unknown"))
