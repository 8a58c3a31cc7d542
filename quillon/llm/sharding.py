"""Sharding by sampled splitters (operator 7).

Rows are ordered by (hash of the text, doc_id, a number of the row), so equal texts stand together.  Size-weighted samples
give quantile boundaries that range-partition the order; ranges that turn out overfull, and those in which a shard ends, are
subdivided by samples of their own, until each shard's end is the splitter nearest to its share of the bytes.  The shards
are what lies between these splitters; slots number the rows of each range after those of the shard's earlier ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import schema, settle, table

SHARDS = 16
#: Ranges per shard, from the least to the most; between, one for each ROWS_A_RANGE rows.
RANGES = (16, 1024)
ROWS_A_RANGE = 500_000
#: Expected samples for each range; a range is overfull beyond this many times its share.
SAMPLES_A_RANGE, OVERFULL = 32, 2.0
#: A range in which a shard ends is cut into so many, or looked at row by row once it has no more than so many rows.
NARROW, FEW = 64, 4096

#: A place in the order: hash of the text, id (the least number for null), number of the row.
Splitter = tuple[int, int, int]
_ORDER = ("_key", "_id", "_tie")


def range_of(*args) -> np.ndarray:
    """Number of splitters (the last argument, sorted tuples) at or below each row, whose parts are the other arguments."""
    *columns, splitters = args
    cut = np.array([s[0] for s in splitters], np.int64)
    low, high = np.searchsorted(cut, columns[0], "left"), np.searchsorted(cut, columns[0], "right")
    if len(columns) == 1:
        return high
    out = low.copy()
    for k in np.unique(low[low < high]):  # rows that begin as splitters do: the copies of a text
        own = np.flatnonzero((low == k) & (low < high))
        out[own] = k + range_of(*[c[own] for c in columns[1:]], [s[1:] for s in splitters[k : high[own[0]]]])
    return out


def with_range(rows: DataFrame, splitters: list[Splitter]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(splitters)  # a few times the ranges, of which there are at most shards * RANGES[1]
    names = rows.columns
    at = [names.index(c) for c in _ORDER]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = range_of(*[b.column(k).to_numpy(zero_copy_only=False) for k in at], shared.value)
            yield pa.record_batch([*b.columns, pa.array(got, pa.int64())], names=[*names, "_range"])

    return rows.mapInArrow(run, schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", _range bigint"))


def _quantiles(sample: list[tuple[Splitter, float]], parts: int) -> list[Splitter]:
    """Splitters at the weighted quantiles of a sorted sample."""
    weight = np.cumsum([w for _, w in sample])
    if not len(weight) or parts < 2:
        return []
    at = np.searchsorted(weight, weight[-1] * np.arange(1, parts) / parts)
    return sorted({sample[i][0] for i in at})


def _sample(rows: DataFrame, rate: Column) -> list[tuple[Splitter, float]]:
    """(place, weight) of rows drawn with a chance of ``rate`` times their size; sure rows weigh more than 1."""
    u = F.pmod(F.xxhash64(F.lit(11), *_ORDER), F.lit(1 << 40)) / float(1 << 40)
    got = rows.where(u < F.col("size") * rate).select(*_ORDER, F.greatest(F.lit(1.0), F.col("size") * rate).alias("w")).toArrow()
    return sorted(zip(zip(*(got.column(i).to_pylist() for i in range(3)), strict=True), got.column(3).to_pylist(), strict=True))


def _sums(ranged: DataFrame) -> list:
    """Bytes and rows of every range, its largest row, in the order of the ranges: one row a range."""
    return sorted(ranged.groupBy("_range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.max("size").alias("most")).collect())


def splitters_of(rows: DataFrame, total: int, shards: int, parts: int) -> tuple[list[Splitter], list]:
    """Splitters into about ``parts`` ranges of near-equal size, with the ranges' sums.

    Ends when no range is overfull and no shard ends within a range of several rows.  Only rows equal in all three parts,
    which a hash of the row's number keeps apart, could not be divided.
    """
    found = _quantiles(_sample(rows, F.lit(parts * SAMPLES_A_RANGE / max(1, total))), parts)
    target = max(1, total / parts)
    while True:
        ranged = with_range(rows, found)
        sums = _sums(ranged)
        wanted, before = [], 0  # range, pieces, bytes before it, rate of its sample
        for r in sums:
            end = before * shards // total + 1  # the first shard that may end within
            inside = end < shards and end * total < (before + r["bytes"]) * shards
            if r["rows"] > 1 and (inside or r["bytes"] > OVERFULL * target + r["most"]):
                pieces = max(NARROW if inside else 2, int(np.ceil(r["bytes"] / target)))
                few = inside and r["rows"] <= FEW
                wanted.append((r["_range"], 0 if few else pieces, before, 1.0 if few else pieces * SAMPLES_A_RANGE / r["bytes"]))
            before += r["bytes"]
        if not wanted:
            return found, sums
        rates = rows.sparkSession.createDataFrame([(w[0], w[3]) for w in wanted], "_range bigint, _rate double")
        drawn = _sample(ranged.join(F.broadcast(rates), "_range"), F.col("_rate"))
        where = range_of(*[np.array(x, np.int64) for x in zip(*[p for p, _ in drawn], strict=True)], found) if drawn else np.zeros(0, np.int64)
        more: set[Splitter] = set()
        for at, pieces, before, _ in wanted:
            own = [drawn[k] for k in np.flatnonzero(where == at)]
            if pieces:
                more |= set(_quantiles(own, pieces))
                continue
            # All rows are here: the row in which a shard ends becomes a range of its own.
            for k, (_, size) in enumerate(own):
                end = before * shards // total + 1
                if end < shards and end * total < (before + size) * shards:
                    more |= {own[j][0] for j in (k, k + 1) if j < len(own)}
                before += int(size)
        if not more - set(found):
            return found, sums
        found = sorted(set(found) | more)


def ends_of(sums: list, total: int, shards: int) -> list[int]:
    """Of all shards but the last the number of ranges that lie before its end: the nearest splitter, of two the earlier."""
    edges = np.concatenate([[0], np.cumsum([r["bytes"] for r in sums])])
    return [int(np.abs(edges * shards - k * total).argmin()) for k in range(1, shards)]


def assign(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row, under the law ``bytes``.

    size is the text's UTF-8 length plus 1 (a null text has length 0 and crc 0); shards end at the splitters nearest to the
    multiples of total/shards, found down to single rows, so sizes differ by less than the largest rows.  Ids are cast to bigint.
    Slots count the rows of a shard from 0 without gaps in the order (by hash of the text, then doc_id, nulls first); fully equal
    rows take slots in any order.  Copies of a text stand together, but a shard may end among them: they may be more than a shard
    holds.  grown_shard belongs to the law ``key`` alone and is null.  Further columns are ignored; an empty table gives no rows.
    """
    data = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), (F.octet_length(data) + 1).cast("bigint").alias("size"), F.crc32(data.cast("binary")).alias("text_crc32"), F.xxhash64(data).alias("_key"))
    rows = settle(rows.select("*", F.coalesce("doc_id", F.lit(-(1 << 63))).cast("bigint").alias("_id"), F.xxhash64(F.monotonically_increasing_id()).alias("_tie")))
    got = rows.agg(F.count("*").alias("n"), F.sum("size").alias("s")).first()
    n, total = got["n"], got["s"] or 1
    parts = shards * int(min(RANGES[1], max(RANGES[0], -(-n // (shards * ROWS_A_RANGE)))))
    splitters, sums = splitters_of(rows, total, shards, parts)
    ends = ends_of(sums, total, shards)
    places, held = [], [0] * shards  # range, its shard, rows of the shard before it
    for k, r in enumerate(sums):
        shard = sum(e <= k for e in ends)
        places.append((r["_range"], shard, held[shard]))
        held[shard] += r["rows"]
    of = docs.sparkSession.createDataFrame(places, "_range bigint, shard int, _before bigint")
    number = F.row_number().over(Window.partitionBy("_range").orderBy(*_ORDER)) - 1
    return with_range(rows, splitters).withColumn("_at", number).join(F.broadcast(of), "_range").select(
        F.col("doc_id").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_before") + F.col("_at")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id") -> None:
    """Writes the documents under ``path`` in one folder ``_shard=N`` a shard, rows in slot order within each written file.

    Needs unique keys, as the text joins its place by key; null keys are refused.  Further columns are written as they are;
    one named ``_shard`` (in any case) is refused, as the folders carry that name.
    """
    if "_shard" in [c.lower() for c in docs.columns]:
        raise ValueError("a column is named _shard")
    slot = "_slot"
    while slot in docs.columns:
        slot += "_"
    at = assign(docs, shards, key).select(F.when(F.col(key).isNull(), F.raise_error(F.lit("a key is null"))).otherwise(F.col(key)).alias(key), F.col("shard").alias("_shard"), F.col("slot").alias(slot))
    docs.join(at, key).repartition(F.col("_shard"), F.floor(F.col(slot) / 250_000)).sortWithinPartitions("_shard", slot).drop(slot).write.partitionBy("_shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))
