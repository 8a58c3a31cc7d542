"""Closures and shortest chains of hierarchies that no driver holds (RSN-1, RSN-3, RSN-22, EXP-9 .. EXP-12).

Edges are rows; each round joins only what the last one found, drops what is known and settles the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.lineage import settle

#: More rounds than any hierarchy needs: paths double with each round of ``closure``.
GUARD = 64
#: Rows of a table that is sent to all tasks; edges of nodes above no other that a task of ``distances`` takes.
BROADCAST_ROWS, LOWEST_EDGES = 1 << 16, 1 << 20


def closure(edges: DataFrame, swap: bool = False) -> DataFrame:
    """(a, b) for every path of edges (a, b); with ``swap`` also whether the edges' swaps along the path add up to one.

    Path lengths double with each round, so a chain of n edges takes log2(n) rounds; cycles end as nothing is new.
    """
    keys = ["a", "b", "swap"] if swap else ["a", "b"]
    known = settle(edges.select(*keys).distinct())
    new = known

    def joined(x: DataFrame, y: DataFrame) -> DataFrame:
        x, y = x.select("a", F.col("b").alias("_m"), *(F.col(k).alias("_x") for k in keys[2:])), y.select(F.col("a").alias("_m"), "b", *(F.col(k).alias("_y") for k in keys[2:]))
        return x.join(y, "_m").select("a", "b", *([(F.col("_x") != F.col("_y")).alias("swap")] if swap else []))

    for _ in range(GUARD):
        new = settle(joined(new, known).unionByName(joined(known, new)).distinct().join(known, keys, "left_anti"))
        if new.isEmpty():
            return known
        known = settle(known.unionByName(new))
    raise RuntimeError(f"a closure did not end after {GUARD} doublings")


def shortest_chains(edges: DataFrame, most: int) -> DataFrame:
    """(a, b, nodes, kinds): for each pair the shortest chain of at most ``most`` nodes, ties by the nodes' names.

    Edges are (a, b, kind); ``kinds`` has those along the chain.  A chain's beginning is the best one to its node, so a round keeps
    one row a pair whatever number of ways there are.
    """
    edges = settle(edges.where("a <> b").groupBy("a", "b").agg(F.min("kind").alias("kind")))
    step = edges.select(F.col("a").alias("_m"), F.col("b").alias("_b"), F.col("kind").alias("_k"))
    front = edges.select("a", "b", F.array("a", "b").alias("nodes"), F.array("kind").alias("kinds"))
    known = front
    for _ in range(most - 2):
        longer = front.join(step, F.col("b") == F.col("_m")).where("_b <> a").select("a", F.col("_b").alias("b"), F.concat("nodes", F.array("_b")).alias("nodes"), F.concat("kinds", F.array("_k")).alias("kinds"))
        best = longer.groupBy("a", "b").agg(F.min(F.struct("nodes", "kinds")).alias("m")).select("a", "b", "m.*")
        front = settle(best.join(known.select("a", "b"), ["a", "b"], "left_anti"))
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known


def all_chains(edges: DataFrame, most: int) -> DataFrame:
    """(a, b, nodes): every cycle-free chain of at most ``most`` nodes, as EXP-11 and EXP-12 list them."""
    edges = settle(edges.where("a <> b").select("a", "b").distinct())
    step = edges.select(F.col("a").alias("_m"), F.col("b").alias("_b"))
    front = edges.select("a", "b", F.array("a", "b").alias("nodes"))
    known = front
    for _ in range(most - 2):
        front = settle(front.join(step, F.col("b") == F.col("_m")).where(~F.array_contains("nodes", F.col("_b"))).select("a", F.col("_b").alias("b"), F.concat("nodes", F.array("_b")).alias("nodes")))
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known


def distances(edges: DataFrame) -> DataFrame:
    """(a, b, n, via): for each pair of a hierarchy of any depth the number of edges between them and the node before b.

    Of several nodes before b on shortest chains the smallest is taken, so following ``via`` back from b gives a chain
    without a row holding it.  Rounds: the longest distance.  They go over the edges between nodes that lie above others; a node
    that lies above none, as most of a large hierarchy, gets its rows at the end from those of the nodes next to it, and moves once.
    """
    edges = settle(edges.where("a <> b").select("a", "b").distinct())
    above = settle(edges.select(F.col("b").alias("a")).distinct())
    # A table that the driver may hold is sent to all tasks.
    near = F.broadcast(above) if above.count() <= BROADCAST_ROWS else above
    known = settle(_rounds_of_distances(settle(edges.join(near, "a", "left_semi"))))
    lowest = edges.join(near, "a", "left_anti")
    parts = max(edges.sparkSession.sparkContext.defaultParallelism, lowest.count() // LOWEST_EDGES + 1)
    lowest = lowest.repartition(parts, "a")
    further = known.select(F.col("a").alias("_m"), F.col("b").alias("_b"), "n", "via")
    further = F.broadcast(further) if known.count() <= BROADCAST_ROWS else further
    first = lowest.select("a", "b", F.lit(1).cast("bigint").alias("n"), F.col("a").alias("via"))
    longer = lowest.join(further, F.col("b") == F.col("_m")).select("a", F.col("_b").alias("b"), (F.col("n") + 1).alias("n"), "via")
    best = first.unionByName(longer).groupBy("a", "b").agg(F.min(F.struct("n", "via")).alias("m")).select("a", "b", "m.n", "m.via")
    return known.unionByName(best)


def _rounds_of_distances(edges: DataFrame) -> DataFrame:
    """``distances`` of settled edges, round by round."""
    step = edges.select(F.col("a").alias("_m"), F.col("b").alias("_b"))
    front = settle(edges.select("a", "b", F.lit(1).cast("bigint").alias("n"), F.col("a").alias("via")))
    known, k = front, 1
    while True:
        k += 1
        longer = front.join(step, F.col("b") == F.col("_m")).where("_b <> a").groupBy("a", F.col("_b").alias("b")).agg(F.lit(k).cast("bigint").alias("n"), F.min("_m").alias("via"))
        front = settle(longer.join(known.select("a", "b"), ["a", "b"], "left_anti"))
        if front.isEmpty():
            return known
        known = known.unionByName(front)
        known = settle(known) if k % 8 == 0 else known


def list_ranks(cells: DataFrame) -> DataFrame:
    """(cell, last, left): for each cell of linked lists (cell, next; the end has no row) the list's last cell and the
    number of cells from here to it, by pointers that double.  Cells on a cycle have no end and are left out."""
    n = cells.count()
    state = settle(cells.select("cell", F.col("next").alias("to"), F.col("cell").alias("last"), F.lit(1).cast("bigint").alias("left")))
    for _ in range(max(1, n).bit_length() + 1):
        ahead = state.select(F.col("cell").alias("_c"), F.col("to").alias("_t"), F.col("last").alias("_l"), F.col("left").alias("_n"))
        joined = state.join(ahead, F.col("to") == F.col("_c"), "left")
        if state.join(ahead, F.col("to") == F.col("_c"), "left_semi").isEmpty():
            break
        state = settle(joined.select("cell", F.when(F.col("_c").isNull(), F.col("to")).otherwise(F.col("_t")).alias("to"), F.coalesce("_l", "last").alias("last"), (F.col("left") + F.coalesce("_n", F.lit(0))).alias("left")))
    ends = state.select("cell")
    return state.join(ends.withColumnRenamed("cell", "_c"), F.col("to") == F.col("_c"), "left_anti").select("cell", "last", "left")
