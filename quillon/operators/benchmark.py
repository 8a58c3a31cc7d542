"""The final data set (AGG-11, AGG-24, JN-8 .. JN-10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.skew import running


def nest(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows nested under their keys as ``qas``, sorted by the fields; rows with a null key go."""
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("qas"))


def nested_lines(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """AGG-11, SNK-11 for groups of any size: (value) lines of one JSON array of groups, a line a question, in order.

    Lines are sorted over all tasks, and only marks of a group's first and last row are computed, so no group is one row.
    """
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    n = running(rows, keys, fields, "_n").join(rows.groupBy(*keys).agg(F.count("*").alias("_m")), keys)
    top = n.agg(F.max(F.struct(*keys)).alias("_top"))  # the last group, one row
    n = n.crossJoin(F.broadcast(top))
    head = F.to_json(F.struct(*keys))
    opening = F.concat(F.when(F.col("_n") == 1, F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(',"qas":['))).otherwise(F.lit("")))
    last = (F.col("_n") == F.col("_m")) & (F.col("_top") == F.struct(*keys))
    closing = F.when(last, F.lit("]}")).when(F.col("_n") == F.col("_m"), F.lit("]},")).otherwise(F.lit(","))
    body = n.select(F.lit(1).alias("_k"), *keys, "_n", F.concat(opening, F.to_json(F.struct(*fields)), closing).alias("value"))
    ends = rows.sparkSession.createDataFrame([(0, "["), (2, "]")], "_k int, value string").select("_k", *[F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in keys], F.lit(0).cast("bigint").alias("_n"), "value")
    return body.unionByName(ends).orderBy("_k", *keys, "_n").select("value")


def minimum(paths: DataFrame, keys: list[str]) -> DataFrame:
    """The shortest explanation of each key, the first by position on ties; needs n and pos."""
    return paths.groupBy(*keys).agg(F.min(F.struct("n", "pos", "explanation")).alias("m")).select(*keys, F.col("m.explanation").alias("explanation"))


def attach(questions: DataFrame, explanations: DataFrame, compat: bool = False) -> DataFrame:
    """Questions with their minimum explanations by triple; ``compat`` looks up by task id alone, the last one winning."""
    if not compat:
        return questions.join(minimum(explanations, ["triple_key"]), "triple_key", "left")
    last = explanations.select(F.explode("task_ids").alias("task_id"), "pos", "explanation").groupBy("task_id").agg(F.max(F.struct("pos", "explanation")).alias("m"))
    return questions.join(last.select("task_id", F.col("m.explanation").alias("explanation")), "task_id", "left")


def zip_sides(nl: DataFrame, abstract: DataFrame, keys: tuple = ("task_id", "sparql_query"), order: str = "pos") -> DataFrame:
    """JN-9: plain and abstracted questions of the same task and query.

    Rows that share their keys meet in their order on both sides, one to one; what is left over has no partner.
    """
    left = running(nl, [*keys], [order], "_n")
    right = running(abstract, [*keys], [order], "_n").select(*keys, "_n", F.col("question").alias("abs_question"))
    return left.join(right, [*keys, "_n"], "left").drop("_n")


def with_context(questions: DataFrame, contexts: DataFrame, name: str) -> DataFrame:
    """JN-10, SRC-11: contexts by root entity; where there is none the text says so."""
    c = contexts.select("root_entity", F.col("context").alias(name))
    return questions.join(c, "root_entity", "left").withColumn(name, F.coalesce(name, F.concat(F.lit("File not found: "), "root_entity")))
