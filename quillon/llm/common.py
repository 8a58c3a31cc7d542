"""Helpers shared by the training-data operators.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.reasoning import rounds
from quillon.plans.lineage import keep, release, scratch, settle, temporary
from quillon.plans.skew import hot_keys, salted_join

__all__ = ["keep", "release", "scratch", "settle", "temporary"]

#: Bytes of text that one step of a Python operator holds at a time.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark (works for any file system Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_HELD: dict[tuple, object] = {}


def held(make: Callable, *args):
    """``make(*args)``, kept by this Python worker for its next tasks until another operator runs here.

    Workers outlive stages; caches of one operator would else stand beside the next one's memory.
    """
    key = (make, *args)
    if key not in _HELD:
        _HELD.clear()
        give_back()
        _HELD[key] = make(*args)
    return _HELD[key]


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries run within the block leave no shuffle files when they end; only for tables that are made and read there."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Rows of an Arrow batch of texts: at Spark's default of 10 000, texts of 100 KB would make batches of a GB.
BATCH_ROWS = 1024


def bounded_batches(df: DataFrame) -> DataFrame:
    """The same rows; the session then hands at most BATCH_ROWS rows at a time to Python, unless it was set to other than
    Spark's default.  Results do not depend on it."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(BATCH_ROWS))
    return df


def slices(batches: Iterator[pa.RecordBatch], column: str, holding: bool = False) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the column's text stays near SLICE_BYTES in each; a longer row comes alone.

    holding: whether the caller works with an object of ``held``; others let it go.
    """
    import pyarrow.compute as pc

    if not holding and _HELD:
        _HELD.clear()
        give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and held + size > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)
    give_back()


def give_back() -> None:
    """Returns freed memory to the system at a task's end: idle Python workers would otherwise keep their peak."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        return


def id_crc(column: str = "doc_id"):
    """crc32 of an identifier as decimal text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def bounded_sample(df: DataFrame, key: str, rows: int, stratum: str | None = None) -> DataFrame:
    """About ``rows`` rows, chosen by a hash of the row's key, never more than 1.25 times as many.

    With a ``stratum`` (a column of few values) each value gets an equal part of the rows, and what rare values leave
    over goes to the others, so none of them vanishes.  Only for fitting a model; ``rows`` is a documented parameter of each caller.
    """
    by = [stratum] if stratum else []
    sizes = {tuple(r)[:-1]: r["count"] for r in (df.groupBy(*by).count().collect())}
    if sum(sizes.values()) <= rows:
        return df.limit(rows)
    left, quota = rows, {}
    for k, (name, n) in enumerate(sorted(sizes.items(), key=lambda x: x[1])):
        quota[name] = min(n, left // (len(sizes) - k))
        left -= quota[name]
    kind = df.schema[stratum].dataType.simpleString() if stratum else "int"
    shares = df.sparkSession.createDataFrame([(*(name or (0,)), quota[name] / n) for name, n in sizes.items()], f"_stratum {kind}, _share double")
    at = F.pmod(F.xxhash64(F.lit(7), *[F.col(c) for c in df.columns]), F.lit(1 << 31)) / float(1 << 31)
    same = F.col("_stratum").eqNullSafe(F.col(stratum)) if stratum else F.lit(True)
    return df.join(F.broadcast(shares), same).where(at < F.col("_share")).select(*df.columns).limit(rows + rows // 4)


def byte_view(column: pa.Array):
    """(bytes of all rows end to end as uint8, row offsets) of a string array, nulls as empty."""
    import numpy as np
    import pyarrow.compute as pc

    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, object]]:
    """Tables of whole groups from rows sorted by ``keys``, with the groups' bounds; an open group waits for the next batch."""
    import numpy as np

    def bounds(t: pa.Table):
        change = np.zeros(t.num_rows, bool)
        for k in keys:
            v = t.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        change[0] = True
        return np.append(np.flatnonzero(change), t.num_rows)

    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        new = pa.Table.from_batches([b])
        held = new if held is None else pa.concat_tables([held, new])
        at = bounds(held)
        if len(at) > 2:
            yield held.slice(0, at[-2]).combine_chunks(), at[:-1]
            held = held.slice(at[-2])
    if held is not None and held.num_rows:
        held = held.combine_chunks()
        yield held, bounds(held)
    del held
    give_back()


def maybe_among(rows: DataFrame, key: str, ids: DataFrame, id_column: str) -> DataFrame:
    """(row, maybe): the rows as structs, and false only where the key is surely not among the ids.

    A broadcast bitmap of hashed ids, 16 bits for each id (``ids`` is settled, so counting costs little), from 512 KB
    to 64 MB whatever their number.  It spares texts a shuffle before an exact join; beyond 33 million ids more rows
    than needed pass, and the exact join still decides.
    """
    bits = 1 << min(29, max(22, (16 * ids.count()).bit_length()))

    def hashed(c):
        return F.pmod(F.xxhash64(c.cast("bigint")), F.lit(bits))

    maps = ids.where(F.col(id_column).isNotNull()).select(hashed(F.col(id_column)).alias("h")).groupBy(F.expr("bitmap_bucket_number(h)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("m"))
    # The columns go into one struct, so that none of theirs can clash with one of these.
    found = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(f"`{key}`").alias("k")).withColumn("h", hashed(F.col("k"))).withColumn("b", F.expr("bitmap_bucket_number(h)"))
    byte = F.conv(F.hex(F.expr("substring(m, cast(bitmap_bit_position(h) div 8 + 1 as int), 1)")), 16, 10).cast("int")
    hit = F.call_function("getbit", byte, (F.expr("bitmap_bit_position(h)") % 8).cast("int")).cast("int") == 1
    return found.join(F.broadcast(maps), "b", "left").select("row", F.coalesce(hit & F.col("k").isNotNull(), F.lit(False)).alias("maybe"))


def without_ids(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is not in ``gone`` (a settled table of one column ``key``); null keys stay.

    Rows that the bitmap clears never move; only the others meet the exact anti-join.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    flagged = maybe_among(docs, key, gone, key)
    return flagged.where("not maybe").select("row.*").union(flagged.where("maybe").select("row.*").join(gone, [key], "left_anti").select(*names))


def pack_numbers(values) -> tuple:
    """(bytes, end of each number in them): whole numbers from 0 in groups of seven bits, the lowest first."""
    import numpy as np

    v = np.asarray(values, np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, (int(v.max(initial=0)).bit_length() + 6) // 7):
        size += v >= np.uint64(1 << 7 * k)
    ends = np.cumsum(size)
    out, start = np.empty(ends[-1] if len(v) else 0, np.uint8), ends - size
    for k in range(size.max(initial=0)):
        own = size > k
        out[start[own] + k] = ((v[own] >> np.uint64(7 * k)) & np.uint64(127)) | np.where(size[own] > k + 1, np.uint64(128), np.uint64(0))
    return out, ends


def unpack_numbers(packed: bytes):
    """The numbers that ``pack_numbers`` has put into bytes, as int64."""
    import numpy as np

    raw = np.frombuffer(packed, np.uint8)
    ends = np.flatnonzero(raw < 128) + 1
    start = np.append(0, ends[:-1])[: len(ends)]
    size, out = ends - start, np.zeros(len(ends), np.int64)
    for k in range(size.max(initial=0)):
        own = size > k
        out[own] |= (raw[start[own] + k] & 127).astype(np.int64) << (7 * k)
    return out


def schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id of the undirected edges (a, b): the smallest id that it reaches.

    Alternates large-star and small-star steps on settled tables until the edge set stops changing.  Hub vertices hold
    no list: their minima are combined map-side, and their edges meet the minimum in several parts.
    """

    def minima(rows: DataFrame, least) -> DataFrame:
        return settle(rows.groupBy("a").agg(least.alias("m"), F.count("*").alias("n")))

    def to_least(rows: DataFrame, low: DataFrame, total: int) -> DataFrame:
        return salted_join(rows, low.select("a", "m"), ["a"], "b", hot_keys(low, ["a"], "n", total))

    def mark(rows: DataFrame):
        return rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    now = mark(edges)
    for _ in rounds("components"):
        if not now["n"]:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = minima(both, F.least(F.min("b"), F.col("a")))
        large = to_least(both.where("b > a"), low, 2 * now["n"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = settle(large.where("a <> b").distinct())
        least = minima(large, F.min("b"))
        small = to_least(large, least, 2 * now["n"])
        new = settle(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        release(edges, low, large, least)
        edges, before = new, now
        now = mark(edges)
        if now == before:
            break
    # Settled edges are (id, root), one for each id that is no root.
    keep(edges)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
