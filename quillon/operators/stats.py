"""Statistics and sampling (STAT-1 .. STAT-8)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType

from quillon.plans.skew import running


def bin_edges(df: DataFrame, value: str) -> DataFrame:
    """STAT-1: one row of n, least, most and bins, the larger of the Sturges and Freedman-Diaconis counts."""
    q = df.agg(F.count(value).alias("n"), F.min(value).cast("double").alias("least"), F.max(value).cast("double").alias("most"), F.percentile(value, 0.25).alias("q1"), F.percentile(value, 0.75).alias("q3"))
    span = F.col("most") - F.col("least")
    sturges = F.try_divide(span, F.log2(F.col("n")) + 1)
    fd = 2.0 * (F.col("q3") - F.col("q1")) * F.pow(F.col("n").cast("double"), F.lit(-1.0 / 3))
    width = F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
    return q.select("n", "least", "most", F.when(span > 0, F.greatest(F.lit(1), F.ceil(span / width))).otherwise(1).cast("int").alias("bins"))


def cut(df: DataFrame, value: str, out: str) -> DataFrame:
    """STAT-2: equal-width bins from 0, closed on the right, the least value in the first; the edges are one broadcast row."""
    e = bin_edges(df, value)
    width = (F.col("most") - F.col("least")) / F.col("bins")
    k = F.when(width > 0, F.least(F.greatest(F.ceil((F.col(value) - F.col("least")) / width) - 1, F.lit(0)), F.col("bins") - 1)).otherwise(0)
    return df.crossJoin(F.broadcast(e)).withColumn(out, k.cast("int")).drop("n", "least", "most", "bins")


def strata(df: DataFrame, a: str, b: str) -> DataFrame:
    """STAT-3"""
    return cut(cut(df, a, "_a"), b, "_b").withColumn("strata", F.concat_ws("_", F.col("_a").cast("string"), F.col("_b").cast("string"))).drop("_a", "_b")


# The task types that are sampled.
TASK_TYPES = ("Membership", "Property Assertion")


def sampled_tasks(questions: DataFrame, task_type: str = "Task Type", task_id: str = "Task ID") -> DataFrame:
    """FLT-9, PRJ-13: distinct questions of the two task types, with the task id less its answer kind as ``task_group``."""
    rows = questions.dropDuplicates().where(F.col(task_type).isin(*TASK_TYPES))
    return rows.withColumn("task_group", F.regexp_replace(task_id, "-(BIN|MC)$", ""))


def split_size(n: int, classes: int, test: float) -> int:
    """STAT-4: rows of the test side; halves round to even, each side has at least one row a class."""
    if n == 0:
        raise ValueError("nothing to split")
    if n < 2 * classes:
        raise ValueError("fewer rows than two a class")
    return min(max(round(test * n), classes), n - classes)


def stratified_keep(df: DataFrame, key: str, test: float = 0.95, seed: int = 42, least: int = 2) -> DataFrame:
    """STAT-5, FLT-13: the train side of a stratified split, by largest remainders.

    Strata below ``least`` rows go to the other side.  The rows of a stratum with the smallest md5 of seed and key are
    kept, so the result does not depend on partitioning.  The allocation table has a row per stratum.
    """
    sized = df.groupBy("strata").agg(F.count("*").alias("c")).where(F.col("c") >= least)
    # The counts are a row per stratum, a product of two bin counts, not of the data's size.
    counts = {r["strata"]: r["c"] for r in sized.collect()}
    n = sum(counts.values())
    train = n - split_size(n, len(counts), test)
    exact = {k: train * c / n for k, c in counts.items()}
    whole = {k: math.floor(v) for k, v in exact.items()}
    extra = sorted(counts, key=lambda k: (-(exact[k] - whole[k]), k))[: train - sum(whole.values())]
    take = df.sparkSession.createDataFrame([(k, whole[k] + (k in set(extra))) for k in sorted(counts)], "strata string, take int")
    hashed = df.join(F.broadcast(take), "strata").withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    return running(hashed, ["strata"], ["_h", key], "_n").where("_n <= take").drop("_n", "take", "_h")


#: A resample's weight of a row is Poisson(1): the number of these cumulative chances at or below a uniform number.
_POISSON = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(10))
_PRIME = (1 << 31) - 1


def bootstrap_ci(df: DataFrame, group: str, key: str, value: str, samples: int = 1000, seed: int = 42) -> DataFrame:
    """STAT-6: percentile interval of the mean, seeded, by the Poisson bootstrap.

    Sample b weighs a row by Poisson(1) of the number (h1 + b h2) mod a prime, h1 and h2 from the md5 of seed and key; so
    rows draw alone.  A task adds its rows into one array of sums a group, and only these arrays leave it.  Null values are no rows.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    half = lambda k: F.pmod(F.conv(F.substring(digest, k, 8), 16, 10).cast("bigint"), F.lit(_PRIME))
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"), half(1).alias("h1"), half(9).alias("h2"))
    kind = rows.schema["g"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, held = np.arange(1, samples + 1), {}
        for b in batches:
            v, h1, h2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("v", "h1", "h2"))
            codes = b.column("g").dictionary_encode()
            at = codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
            for c, name in enumerate([*codes.dictionary.to_pylist(), None]):
                own = np.flatnonzero(at == c)
                for k in range(0, len(own), 512):
                    some = own[k : k + 512]
                    u = ((h1[some, None] + turns * h2[some, None]) % _PRIME) / float(_PRIME)
                    weight = np.searchsorted(_POISSON, u, side="right")
                    s, n = held.setdefault(name, (np.zeros(samples), np.zeros(samples, np.int64)))
                    s += v[some] @ weight
                    n += weight.sum(0)
        if held:
            yield pa.record_batch([pa.array([*held], to_arrow_type(kind)), pa.array([s for s, _ in held.values()], pa.list_(pa.float64())), pa.array([n for _, n in held.values()], pa.list_(pa.int64()))], names=["g", "s", "n"])

    sums = rows.mapInArrow(run, f"g {kind.simpleString()}, s array<double>, n array<bigint>")
    means = sums.select("g", F.posexplode(F.arrays_zip("s", "n")).alias("b", "x")).groupBy("g", "b").agg(F.sum("x.s").alias("s"), F.sum("x.n").alias("n")).where("n > 0")
    return means.groupBy(F.col("g").alias(group)).agg(F.round(F.percentile(F.col("s") / F.col("n"), 0.025), 6).alias("low"), F.round(F.percentile(F.col("s") / F.col("n"), 0.975), 6).alias("high"))


def mann_whitney(df: DataFrame, group: str, value: str, pairs: list[tuple[str, str]] | None = None, least: int = 30) -> DataFrame:
    """STAT-7: U of the first group, tie- and continuity-corrected z, mean difference, for pairs of groups over ``least`` rows.

    Values are counted per (group, value) first; ranks are running sums over distinct values, dealt over tasks by ranges of
    values.
    """
    names = sorted(r[0] for r in df.groupBy(group).agg(F.count(value).alias("n")).where(F.col("n") > least).select(group).collect())  # one name a model
    chosen = pairs or [(a, b) for k, a in enumerate(names) for b in names[k + 1 :]]
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("k"))
    table = F.broadcast(df.sparkSession.createDataFrame(chosen or [("", "")], "a string, b string"))
    both = counts.join(table, (F.col(group) == F.col("a")) | (F.col(group) == F.col("b")))
    v = both.groupBy("a", "b", value).agg(F.sum(F.when(F.col(group) == F.col("a"), F.col("k")).otherwise(0)).alias("ka"), F.sum("k").alias("t"))
    v = running(v, ["a", "b"], [value], "_upto", "t").withColumn("rank", F.col("_upto") - F.col("t") + (F.col("t") + 1) / 2)
    s = v.groupBy("a", "b").agg(
        F.sum("ka").cast("double").alias("n1"), (F.sum("t") - F.sum("ka")).cast("double").alias("n2"), F.sum(F.col("ka") * F.col("rank")).alias("r1"), F.sum(F.pow(F.col("t"), 3) - F.col("t")).alias("ties"),
        (F.sum(F.col("ka") * F.col(value)) / F.sum("ka") - F.sum((F.col("t") - F.col("ka")) * F.col(value)) / (F.sum("t") - F.sum("ka"))).alias("difference"),
    )
    n = F.col("n1") + F.col("n2")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    mid = F.col("n1") * F.col("n2") / 2
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    far = F.greatest(u, F.col("n1") * F.col("n2") - u)
    return s.select("a", "b", u.alias("u"), F.round(F.coalesce(F.try_divide(far - mid - 0.5, sd), F.lit(0.0)), 6).alias("z"), F.round("difference", 6).alias("difference"))


@F.pandas_udf(DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value; Spark has no error function."""
    return z.map(lambda x: min(1.0, math.erfc(x / math.sqrt(2))))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def percent(c: Column) -> Column:
    """STAT-8"""
    return F.format_string("%.1f%%", c * 100)


def signed_percent(c: Column) -> Column:
    """STAT-8: a difference in percent with its sign."""
    return F.format_string("%+.1f%%", c * 100)


def p_text(c: Column) -> Column:
    """STAT-8: a p-value with six places."""
    return F.format_string("%.6f", c)


def count_percent(n: Column, percent_of: Column) -> Column:
    """STAT-8: a count with its share of a whole."""
    return F.format_string("%d (%.1f%%)", n, F.coalesce(F.try_divide(n * 100.0, percent_of), F.lit(0.0)))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
