"""Near-duplicate embeddings by cross-polytope hashing (operator 10).

Equal vectors of a label are one class first.  A class is hashed by the nearest signed axis after fast Hadamard
rotations; several rotations side by side make a table's code, several tables make candidates, and multiprobe adds the
codes of each rotation's next axes.  Buckets hold ids alone.  Every member of a bucket is verified against the
bucket's first class, by cosine in double precision; buckets whose other members still lie in several components are
compared in blocks.  So components of links are known, and as linked vectors share a component, a last pass counts links inside
components, again in blocks.  A vector travels to its few candidates and to the blocks of its component, not to its
buckets, and no pair is written but those with a bucket's first class.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import components, keep, maybe_among, schema, settle, table, temporary, whole_groups
from quillon.plans.skew import hot_keys, salted_join

COSINE = 0.93
#: Tables, rotations side by side in a table's code, and codes that each vector takes in a table.
TABLES, DEPTH, PROBES = 8, 3, 5
ROUNDS = 3
#: Members of a bucket or component, and bytes of their vectors, that one task compares with each other or with another
#: such block; groups up to SMALL are compared many at a time.
BLOCK, BLOCK_BYTES, SMALL = 512, 8 << 20, 32


def _transform(x: np.ndarray, spare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fast Walsh-Hadamard transform of columns whose length is a power of two, scaled to keep lengths; result and spare.

    A column is a vector, so every step adds and subtracts long rows, and the two arrays take turns.
    """
    n, h = len(x), 1
    while h < n:
        v, out = (a.reshape(n // (2 * h), 2, h, -1) for a in (x, spare))
        np.add(v[:, 0], v[:, 1], out=out[:, 0])
        np.subtract(v[:, 0], v[:, 1], out=out[:, 1])
        x, spare, h = spare, x, 2 * h
    x /= np.sqrt(n)
    return x, spare


def hadamard(x: np.ndarray) -> np.ndarray:
    """The transform of rows."""
    return _transform(x.T.copy(), np.empty(x.T.shape))[0].T


def axes(x: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """(rows, tables, 3, DEPTH): each rotation's nearest and second signed axis, and the rotations by how close these are.

    A rotation is ROUNDS of random signs and a Hadamard transform, of vectors padded to a power of two.
    """
    n, dim = x.shape
    width = max(2, 1 << (dim - 1).bit_length())
    out = np.empty((n, tables, 3, DEPTH), np.uint32)
    columns, all_rows = np.zeros((width, n)), np.arange(n)
    columns[:dim] = x.T
    a, b = np.empty((width, n)), np.empty((width, n))
    for t in range(tables):
        gap = np.empty((n, DEPTH))
        for k in range(DEPTH):
            a[:] = columns
            for signs in np.random.default_rng([410, t, k, width]).integers(0, 2, (ROUNDS, width)) * 2 - 1:
                a *= signs[:, None]
                a, b = _transform(a, b)
            size = np.abs(a)
            for place in (0, 1):
                axis = size.argmax(0)
                top = size[axis, all_rows]
                gap[:, k] = top if place == 0 else gap[:, k] - top
                out[:, t, place, k] = 2 * axis + (a[axis, all_rows] < 0)
                size[axis, all_rows] = -1
        out[:, t, 2] = np.argsort(gap, axis=1, kind="stable")
    return out


def codes_of(marks: np.ndarray, dim: int) -> np.ndarray:
    """(rows, tables, PROBES) codes from ``axes``: the first from the nearest axes, the others with second axes in some.

    The rotations whose two largest coordinates are closest change first: none, the closest, the next, both, the third.
    """
    flips = [(), (0,), (1,), (0, 1), (2,), (0, 2), (1, 2)]
    width = 2 * max(2, 1 << (dim - 1).bit_length())
    out = np.empty((*marks.shape[:2], PROBES), np.int64)
    for p in range(PROBES):
        chosen = marks[:, :, 0].astype(np.int64)
        for f in flips[p]:
            at = marks[:, :, 2, f : f + 1].astype(np.int64)
            np.put_along_axis(chosen, at, np.take_along_axis(marks[:, :, 1], at, 2).astype(np.int64), 2)
        code = np.zeros(marks.shape[:2], np.int64)
        for k in range(DEPTH):
            code = code * width + chosen[:, :, k]
        out[:, :, p] = code
    return out


def codes(x: np.ndarray, tables: int = TABLES) -> np.ndarray:
    return codes_of(axes(x, tables), x.shape[1])


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; by the largest component first, so that nothing overflows."""
    y = x.astype(np.float64)
    y /= np.abs(y).max(1, keepdims=True)
    return y / np.sqrt(np.einsum("ij,ij->i", y, y))[:, None]


def _lists(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the usable vectors of a list column, one length at a time."""
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()), 0)
    values, begin = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    for dim in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == dim)
        x = values[begin[rows][:, None] + np.arange(dim)].astype(column.type.value_type.to_pandas_dtype())
        ok = np.isfinite(x).all(1) & (x != 0).any(1)
        if ok.any():
            yield rows[ok], x[ok]


def hashed(vectors: DataFrame, key: str, vector: str, label: str, tables: int) -> DataFrame:
    """id, label, dim, h1, h2 (a 128-bit hash of the unit vector), marks (its axes) and vec of every row.

    vec is in the input's own precision.  Where a row cannot link, the columns from dim on are null.
    """
    kind = "float" if vectors.schema[vector].dataType.elementType.simpleString() == "float" else "double"
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast(f"array<{kind}>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 2048):
                part = b.slice(start, 2048)
                usable = part.column(0).is_valid().to_numpy(zero_copy_only=False) & part.column(1).is_valid().to_numpy(zero_copy_only=False)
                dims, h1, h2, marks, vecs = ([None] * part.num_rows for _ in range(5))
                for at, x in _lists(part.column(2)):
                    at, x = at[usable[at]], x[usable[at]]
                    if len(at):
                        unit = unit_rows(x)
                        a = axes(unit, tables).astype(np.uint8 if x.shape[1] <= 128 else np.uint32)
                        for k, i in enumerate(at.tolist()):
                            d = blake2b(unit[k].tobytes(), digest_size=16).digest()
                            dims[i], h1[i], h2[i] = x.shape[1], int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
                            marks[i], vecs[i] = a[k].tobytes(), x[k].tobytes()
                columns = [part.column(0), part.column(1), *(pa.array(c, t) for c, t in ((dims, pa.int32()), (h1, pa.int64()), (h2, pa.int64()), (marks, pa.binary()), (vecs, pa.binary())))]
                yield pa.record_batch(columns, names=["id", "label", "dim", "h1", "h2", "marks", "vec"])

    return rows.mapInArrow(run, schema("id bigint, label string, dim int, h1 bigint, h2 bigint, marks binary, vec binary"))


def _entries(reps: DataFrame, tables: int) -> DataFrame:
    """(bucket, c): where a class stands; every class takes PROBES codes of each table.  A bucket is a 64-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims):
                own = b.filter(pa.array(dims == dim))
                marks = np.frombuffer(b"".join(own.column(3).to_pylist()), np.uint8 if dim <= 128 else np.uint32).reshape(own.num_rows, tables, 3, DEPTH)
                h = own.column(1).to_numpy().view(np.uint64)[:, None, None] + np.arange(1, tables + 1, dtype=np.uint64)[None, :, None] * np.uint64(0x9E3779B97F4A7C15)
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + codes_of(marks, int(dim)).view(np.uint64)
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(32)
                yield pa.record_batch([pa.array(h.reshape(-1).view(np.int64)), pa.array(np.repeat(own.column(0).to_numpy(), tables * PROBES))], names=["bucket", "c"])

    return reps.select("c", F.xxhash64("label", "dim").alias("k"), "dim", "marks").mapInArrow(run, schema("bucket bigint, c bigint"))


def _units(column: pa.Array, dim: int, wide: str) -> np.ndarray:
    return unit_rows(np.frombuffer(b"".join(column.to_pylist()), wide).reshape(-1, dim))


def _linked(pairs: DataFrame, cosine: float, wide: str) -> DataFrame:
    """The pairs (a, b) of one label and length whose cosine is at least ``cosine``, from their vectors x and y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims):
                own = b.filter(pa.array(dims == dim))
                for start in range(0, own.num_rows, 4096):
                    part = own.slice(start, 4096)
                    ok = np.einsum("ij,ij->i", _units(part.column(3), dim, wide), _units(part.column(4), dim, wide)) >= cosine
                    yield part.select([0, 1]).filter(pa.array(ok))

    return pairs.select("a", "b", "dim", "x", "y").mapInArrow(run, schema("a bigint, b bigint"))


def _forest(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Places of pairs that connect all that the pairs connect: minima spread over the pairs, round by round."""
    ids, at = np.unique(np.concatenate([p, q]), return_inverse=True)
    a, b = at[: len(p)], at[len(p) :]
    root, chosen = np.arange(len(ids)), []
    while True:
        x, y = root[a], root[b]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            return np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, int)
        # Each tree takes one pair to a smaller-numbered neighbour tree, where it has one: no circle can close.
        high, low = np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart])
        trees, one = np.unique(high, return_index=True)
        chosen.append(apart[one])
        root[trees] = low[one]
        while (root[root] != root).any():
            root = root[root]


def _in_blocks(rows: DataFrame, group: str, sizes: DataFrame) -> DataFrame:
    """The rows of the groups in ``sizes`` (group, k rows, m blocks), each with its group's blocks i <= j that it belongs to."""
    total = sizes.agg(F.sum("k")).first()[0] or 0
    rows = salted_join(rows, sizes.select(group, "m"), [group], "c", hot_keys(sizes, [group], "k", total))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("c"), F.col("m")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    return rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "m")


def _blocks_of(k, dim):
    return F.ceil(F.greatest(k / BLOCK, k * dim * 8 / BLOCK_BYTES)).cast("int")


def _similar(held: pa.Table, group: np.ndarray, cosine: float, wide: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left rows, right rows, linked) for stacks of groups that lie end to end: index arrays (k, n), (k, m) and (k, n, m).

    A group of one block is compared with itself (left and right are one array, linked is symmetric, its diagonal false),
    one of two blocks across.
    """
    i, j, own, dims = (held.column(c).to_numpy() for c in ("i", "j", "own", "dim"))
    raw = held.column("vec").to_pylist()
    size, mixed = np.diff(group), (i != j)[group[:-1]]

    def unit(rows: np.ndarray, dim: int) -> np.ndarray:
        return unit_rows(np.frombuffer(b"".join([raw[k] for k in rows.ravel().tolist()]), wide).reshape(-1, dim)).reshape(*rows.shape, dim)

    dim_of = dims[group[:-1]]
    pure = np.maximum.reduceat(dims, group[:-1]) == np.minimum.reduceat(dims, group[:-1])
    for dim in np.unique(dim_of):
        for n in np.unique(size[(size <= SMALL) & (size > 1) & ~mixed & pure & (dim_of == dim)]):
            starts = group[:-1][(size == n) & ~mixed & pure & (dim_of == dim)]
            step = max(1, 20_000 // (n * n))
            for k in range(0, len(starts), step):
                rows = starts[k : k + step, None] + np.arange(n)
                x = unit(rows, dim)
                ok = np.triu(x @ x.transpose(0, 2, 1) >= cosine, 1)
                yield rows, rows, ok | ok.transpose(0, 2, 1)
    for g in np.flatnonzero((size > 1) & ((size > SMALL) | mixed | ~pure)):
        every = np.arange(group[g], group[g + 1])
        for dim in np.unique(dims[every]):  # a hash collision may put two lengths into one bucket
            rows = every[dims[every] == dim]
            if mixed[g]:
                first = own[rows] == i[group[g]]
                a, b = rows[first], rows[~first]
                if len(a) and len(b):
                    yield a[None], b[None], (unit(a, dim) @ unit(b, dim).T >= cosine)[None]
            elif len(rows) > 1:
                x, one = unit(rows, dim), rows[None]
                ok = np.triu(x @ x.T >= cosine, 1)
                yield one, one, (ok | ok.T)[None]


def _links_between(rows: DataFrame, cosine: float, wide: str) -> DataFrame:
    """Links (a, b) that connect all links between different components (column root) in the blocks of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, group in whole_groups(batches, ("bucket", "i", "j")):
            c, root = held.column("c").to_numpy(), held.column("root").to_numpy()
            label = held.column("label").combine_chunks().dictionary_encode()
            label = (label.chunk(0) if isinstance(label, pa.ChunkedArray) else label).indices.to_numpy()
            p, q = [], []
            for left, right, ok in _similar(held, group, cosine, wide):
                at, x, y = np.nonzero(ok)
                a, b = left[at, x], right[at, y]
                new = (root[a] < root[b]) & (label[a] == label[b]) if left is right else (root[a] != root[b]) & (label[a] == label[b])
                p.append(a[new])
                q.append(b[new])
            p, q = (np.concatenate(x) if x else np.zeros(0, int) for x in (p, q))
            if len(p):
                tree = _forest(root[p], root[q])
                yield pa.record_batch([pa.array(c[p[tree]]), pa.array(c[q[tree]])], names=["a", "b"])

    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "c").mapInArrow(run, schema("a bigint, b bigint"))


def _counted(rows: DataFrame, cosine: float, wide: str) -> DataFrame:
    """(c, links): the weights of the classes that each class links with, block by block of its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, group in whole_groups(batches, ("root", "i", "j")):
            c, w = held.column("c").to_numpy(), held.column("w").to_numpy()
            links = np.zeros(len(c), np.int64)
            for left, right, ok in _similar(held, group, cosine, wide):
                np.add.at(links, left, (ok * w[right][:, None, :]).sum(2))
                if left is not right:
                    np.add.at(links, right, (ok * w[left][:, :, None]).sum(1))
            some = np.flatnonzero(links)
            yield pa.record_batch([pa.array(c[some]), pa.array(links[some])], names=["c", "links"])

    return rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "c").mapInArrow(run, schema("c bigint, links bigint"))


def near_embeddings(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, tables: int = TABLES) -> DataFrame:
    """key, n_links, component_id and kept of every row.

    Rows with a null label or id, and vectors that are null, empty, zero or hold null or non-finite components, link
    with nothing; a null id has a null component and is kept.  Vectors of different lengths never link.  Equal unit
    vectors of a label always link.  Rows that repeat an id are separate vectors for n_links and share a component.
    Further columns are ignored, whatever their names; an empty table gives no rows.  A link is found if its two
    vectors meet in a bucket, or if other found links connect them.
    """
    with temporary():
        rows = keep(settle(hashed(vectors, key, vector, label, tables).withColumn("rid", F.monotonically_increasing_id())))
        wide = "<f4" if vectors.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"
        usable = rows.where("h1 is not null")
        same = ["label", "dim", "h1", "h2"]
        classes = settle(usable.groupBy(*same).agg(F.min("id").alias("low"), F.count("*").alias("w"), F.min("rid").alias("c")))
        reps = settle(usable.select(F.col("rid").alias("c"), "label", "dim", "marks").join(classes.select("c", "w", "low"), "c"))
        twice = settle(_entries(reps, tables).groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1").select("bucket"))
        found = settle(maybe_among(_entries(reps, tables), "bucket", twice, "bucket").where("maybe").select("row.bucket", "row.c"))
        # Two probes of one class may hash to one bucket, so members count once.
        shared = settle(found.groupBy("bucket").agg(F.min("c").alias("leader"), F.count("*").alias("k")).where("k > 1"))
        total = shared.agg(F.sum("k")).first()[0] or 0
        members = settle(salted_join(found, shared, ["bucket"], "c", hot_keys(shared, ["bucket"], "k", total)).where("c <> leader"))
        pairs = settle(members.select(F.col("leader").alias("a"), F.col("c").alias("b")).distinct())
        involved = settle(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct())
        vecs = maybe_among(usable.select(F.col("rid").alias("c"), "label", "dim", "vec"), "c", involved, "c").where("maybe").select("row.*").join(involved, "c", "left_semi")
        vecs = settle(vecs)
        hot = hot_keys(pairs.groupBy("a").agg(F.count("*").alias("n")), ["a"], "n", pairs.count())
        both = salted_join(pairs, vecs.select(F.col("c").alias("a"), "label", "dim", F.col("vec").alias("x")), ["a"], "b", hot)
        both = both.join(vecs.select(F.col("c").alias("b"), "label", "dim", F.col("vec").alias("y")), ["b", "label", "dim"])
        links = settle(_linked(both, cosine, wide))
        roots = settle(components(links).withColumnRenamed("id", "c"))
        rest = members.where("k > 2").select("bucket", "c").distinct().join(roots, "c", "left").select("bucket", "c", F.coalesce("root", "c").alias("root"))
        rest = settle(rest)
        split = rest.groupBy("bucket").agg(F.min("root").alias("r"), F.max("root").alias("z"), F.count("*").alias("k")).where("r <> z")
        split = settle(split.join(rest.join(reps.select("c", "dim"), "c").groupBy("bucket").agg(F.max("dim").alias("dim")), "bucket").select("bucket", "k", _blocks_of(F.col("k"), F.col("dim")).alias("m")))
        if not split.isEmpty():
            placed = _in_blocks(rest, "bucket", split).join(vecs, "c")
            links = settle(links.union(_links_between(placed, cosine, wide)))
            roots = settle(components(links).withColumnRenamed("id", "c"))
        linked = roots.join(reps.select("c", "low", "w", "dim"), "c")
        sizes = settle(linked.groupBy("root").agg(F.count("*").alias("k"), F.max("dim").alias("dim")).select("root", "k", _blocks_of(F.col("k"), F.col("dim")).alias("m")))
        counted = _counted(_in_blocks(linked.select("root", "c", "w"), "root", sizes).join(vecs.select("c", "dim", "vec"), "c"), cosine, wide)
        of_class = settle(counted.groupBy("c").agg(F.sum("links").alias("links")))
        of_class = classes.join(of_class, "c", "left").select(*same, "low", "w", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n"))
        hot = hot_keys(classes, same, "w", usable.count())
        of_row = keep(settle(salted_join(usable.select("id", *same), of_class, same, "id", hot).select("id", "low", "n")))
        low = reps.select("c", "low")
        edges = roots.join(low, "c").join(low.withColumnsRenamed({"c": "root", "low": "b"}), "root").select(F.col("low").alias("a"), "b")
        edges = edges.union(of_row.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")))
        placed_ids = components(edges)
    out = of_row.select("id", "n").join(placed_ids, "id", "left").union(rows.where("h1 is null").select("id", F.lit(0).cast("bigint"), F.lit(None).cast("bigint")))
    root = F.coalesce("root", "id")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_links"), root.alias("component_id"), F.coalesce(F.col("id") == root, F.lit(True)).alias("kept"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))
