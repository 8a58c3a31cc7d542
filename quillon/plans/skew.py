"""Joins in which one key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.plans.lineage import settle

#: At most so many keys are treated as hot, whatever the input: a key is hot beyond rows / HOT_KEYS rows.
HOT_KEYS, LEAST_HOT = 1 << 16, 64


def hot_keys(counts: DataFrame, keys: list[str], count: str, total: int) -> DataFrame | None:
    """keys and _parts of the hot keys, at most HOT_KEYS rows as ``total`` is the sum of the counts; None if there are none.

    As their number is bounded they are gathered and enter plans as a local table: without hot keys a join stays plain.
    """
    most = max(LEAST_HOT, -(-total // HOT_KEYS))
    found = counts.where(F.col(count) > most).select(*keys, F.ceil(F.col(count) / most).cast("int").alias("_parts")).toArrow()
    return counts.sparkSession.createDataFrame(found) if found.num_rows else None


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], spread: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``many`` joined to ``one`` on the keys, the rows of a hot key dealt over parts by a hash of ``spread``.

    Rows of ``one`` under a hot key are copied to each of its parts.  Only the hot keys are broadcast, and their number
    is bounded (see ``hot_keys``), so the join holds at any size and any skew.
    """
    if hot is None:
        return many.join(one, keys, how)
    a = many.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    b = one.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts") - 1, F.lit(0))))).drop("_parts")
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def running(df: DataFrame, by: list[str], order: list[str], out: str, weight: str | None = None) -> DataFrame:
    """Adds ``out``: the running sum of ``weight`` (or the row number from 1) within ``by`` in the given order.

    Rows are dealt to tasks by ranges of the whole order, so a group as large as the table is still summed in all of
    them; what a group holds before a range is a sum of the (few) range totals.  The order must be total.
    """
    if not by:
        df, by = df.withColumn("_one", F.lit(0)), ["_one"]
    rows = settle(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    sums = rows.groupBy(*by, "_part").agg((F.sum(weight) if weight else F.count("*")).alias("_all"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_part", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_own", (F.sum(weight) if weight else F.count("*")).over(own))
    return rows.join(sums, [*by, "_part"]).withColumn(out, F.col("_before") + F.col("_own")).drop("_part", "_before", "_own", "_one")
