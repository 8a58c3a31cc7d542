"""Near-duplicate documents by b-bit MinHash (operator 8).

Each text's set of word shingles gives 200 minima.  Bands of five minima make candidate buckets; of every minimum only
the low four bits are kept, packed, and the share of equal groups, corrected for chance collisions, estimates the
similarity of a candidate pair.  Pairs near or over the threshold are confirmed on the full shingle sets.

Equal sets are one class before any pair is made, whatever ids their rows have.  Then every bucket member is paired
with the bucket's first class alone.  Only buckets whose other members still lie in several components go on, split by
set size (sets of too different sizes cannot be similar) and dealt into blocks bounded in rows and bytes: signatures
find the members that have a close partner in another component, and those are compared on their full sets inside the
task, only while their components are apart.  So the search is exhaustive over the buckets, and no group is ever
written as all its pairs.  The work in one bucket still grows with the square of the members of about one size that
share it without being linked to its first class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, byte_view, components, keep, maybe_among, schema, settle, slices, table, temporary, whole_groups, without_ids
from quillon.plans.skew import hot_keys, salted_join

WORDS, SIMILARITY = 5, 0.75
#: 1 - (1 - 0.75**5)**40 > 0.9999: the chance that a pair at the threshold meets in a band.
ROWS, BANDS, BITS = 5, 40, 4
MINIMA = ROWS * BANDS
#: Pairs estimated this far below the threshold are not confirmed: 4.5 standard errors of the estimate.
SLACK = 4.5 * (0.75 * 0.25 / MINIMA) ** 0.5 / (1 - 2**-BITS)
#: Members of a bucket, and bytes of their sets, that one task compares with each other or with another such block.
BLOCK, BLOCK_BYTES = 1024, 8 << 20
#: Groups up to this size are compared many at a time.
SMALL = 32
_random = np.random.default_rng(811)
_MULTIPLY = _random.integers(1, 1 << 32, MINIMA, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _random.integers(0, 1 << 32, MINIMA, dtype=np.uint64).astype(np.uint32)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _random.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_hashes(raw: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of rows laid end to end, A-Z in lower case, and the rows' offsets among the words.

    blank marks the bytes that separate words.
    """
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    ink = ~blank[raw]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    starts_of_rows = offsets[:-1][offsets[:-1] < len(raw)]
    first[starts_of_rows] = ink[starts_of_rows]
    starts = np.flatnonzero(first)
    upto = np.concatenate([[0], np.cumsum(first)])
    if not len(starts):
        return np.zeros(0, np.uint64), upto[offsets]
    place = np.arange(len(raw)) - starts[np.maximum(upto[1:] - 1, 0)]
    np.maximum(place, 0, out=place)
    power = np.cumprod(np.full(int(place.max()) + 1, _STEP, np.uint64))
    value = _BYTE[_LOWER[raw]] * power[place]
    value[~ink] = 0
    return _mix(np.add.reduceat(value, starts)), upto[offsets]


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of rows (with repeats) and the rows' offsets among them.

    A row of one to four words has its whole sequence as one shingle, a row without words none.
    """
    words, at = word_hashes(raw, offsets)
    n = np.diff(at)
    size = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    upto = np.concatenate([[0], np.cumsum(size)])
    begin = np.repeat(at[:-1] - upto[:-1], size) + np.arange(upto[-1])
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    out = np.zeros(len(begin), np.uint64)
    left = np.repeat(n, size)  # words of the shingle's row; missing ones of short rows stay out
    for k in range(WORDS):
        part = _mix(padded[begin + k] + np.uint64(k + 1)) * _PLACE[k]
        out += np.where(k < left, part, np.uint64(0)) if (n < WORDS).any() else part
    return _mix(out), upto


def sketch(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MINIMA minima (uint32) of every non-empty row of shingle hashes."""
    low = (values >> np.uint64(32)).astype(np.uint32)
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(starts), MINIMA), np.uint32)
    for k in range(MINIMA):
        out[:, k] = np.minimum.reduceat(low * _MULTIPLY[k] + _ADD[k], starts)
    return out


def pack_bits(minima: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum, 64/BITS in a word."""
    a = 64 // BITS
    groups = -(-MINIMA // a)
    low = np.zeros((len(minima), groups * a), np.uint64)
    low[:, :MINIMA] = minima & np.uint32((1 << BITS) - 1)
    out = np.zeros((len(minima), groups), np.uint64)
    for k in range(a):
        out |= low[:, k::a] << np.uint64(BITS * k)
    return out


_EACH = np.uint64(sum(1 << (BITS * k) for k in range(64 // BITS)))


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures (last axis), corrected for collisions of unequal minima."""
    x = a ^ b
    for k in (1, 2)[: BITS.bit_length() - 1]:
        x = x | (x >> np.uint64(k))
    unequal = np.bitwise_count(x & _EACH).sum(-1, dtype=np.int64)
    match, chance = 1 - unequal / MINIMA, 2.0**-BITS
    return (match - chance) / (1 - chance)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n (set size), s1 and s2 (a 128-bit hash of the set), packed minima and band keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            values, at = shingles(*byte_view(b.column(1)))
            n, s1, s2 = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for i, (x, z) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                if z > x:
                    own = np.sort(values[x:z])
                    own = own[np.concatenate([[True], own[1:] != own[:-1]])]
                    n[i] = len(own)
                    s1[i], s2[i] = _digest(own)
            minima = sketch(values, at)
            packed = pack_bits(minima)
            keys = np.empty((len(minima), BANDS), np.uint64)
            for k in range(BANDS):
                h = np.full(len(minima), k + 1, np.uint64)
                for j in range(ROWS):
                    h = _mix(h * np.uint64(31) + minima[:, k * ROWS + j])
                keys[:, k] = h
            full = np.flatnonzero(n)
            sig: list = [None] * b.num_rows
            bands: list = [None] * b.num_rows
            for j, i in enumerate(full):
                sig[i], bands[i] = packed[j].tobytes(), keys[j].tobytes()
            yield pa.record_batch([b.column(0), pa.array(n), pa.array(s1), pa.array(s2), pa.array(sig, pa.binary()), pa.array(bands, pa.binary())], names=["id", "n", "s1", "s2", "sig", "bands"])

    rows = bounded_batches(docs.select(docs[key].cast("bigint").alias("id"), docs[text].cast("string").alias("text")))
    return rows.mapInArrow(run, schema("id bigint, n bigint, s1 bigint, s2 bigint, sig binary, bands binary"))


def _digest(own: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of a set of distinct shingle hashes, in any order."""
    return _signed(np.array([own.sum(), _mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum()]))


def shingle_sets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, s1, s2 and the distinct shingle hashes of every row with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            values, at = shingles(*byte_view(b.column(1)))
            own = [np.unique(values[x:z]) for x, z in zip(at[:-1], at[1:], strict=True)]
            marks = np.array([_digest(x) for x in own], np.int64).reshape(-1, 2)
            yield pa.record_batch([b.column(0), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], names=["id", "s1", "s2", "set"])

    rows = bounded_batches(docs.select(docs[key].cast("bigint").alias("id"), docs[text].cast("string").alias("text")))
    return rows.mapInArrow(run, schema("id bigint, s1 bigint, s2 bigint, set array<bigint>"))


def _member_rows(reps: DataFrame) -> DataFrame:
    """(bucket, band, c): one row for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64)
                yield pa.record_batch([pa.array(keys), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows)), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], names=["bucket", "band", "c"])

    return reps.select("c", "bands").mapInArrow(run, schema("bucket bigint, band int, c bigint"))


def _hot_firsts(pairs: DataFrame) -> DataFrame:
    """The classes that stand first in so many pairs that their joins must be dealt over tasks."""
    return hot_keys(pairs.groupBy("a").agg(F.count("*").alias("n")), ["a"], "n", pairs.count())


def _likely(pairs: DataFrame, reps: DataFrame, cut: float) -> DataFrame:
    """The pairs (a, b) whose signatures estimate a similarity of at least ``cut``."""
    sig = reps.select(F.col("c").alias("a"), F.col("sig").alias("x"))
    both = salted_join(pairs, sig, ["a"], "b", _hot_firsts(pairs)).join(sig.select(F.col("a").alias("b"), F.col("x").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint64).reshape(b.num_rows, -1) for i in (2, 3))
                yield b.select([0, 1]).filter(pa.array(estimate(x, y) >= cut))

    return both.mapInArrow(run, schema("a bigint, b bigint"))


def _sets_of(classes: DataFrame, reps: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(c, set) of the classes (a settled column c), read from a row of each class's smallest id.

    A bitmap of those ids keeps other texts out; rows that repeat a text under one id are combined map-side.
    """
    wanted = settle(reps.join(classes, "c", "left_semi").select("c", F.col("low").alias("id"), "s1", "s2"))
    rows = maybe_among(docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where("text is not null"), "id", wanted, "id")
    sets = shingle_sets(rows.where("maybe").select("row.*"), "id", "text").dropDuplicates(["id", "s1", "s2"])
    return sets.join(wanted, ["id", "s1", "s2"]).select("c", "set")


def _confirm(pairs: DataFrame, reps: DataFrame, docs: DataFrame, key: str, text: str, similarity: float) -> DataFrame:
    """The pairs whose full shingle sets have the similarity, compared in whole percent without rounding."""
    classes = settle(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct())
    sets = settle(_sets_of(classes, reps, docs, key, text))
    both = salted_join(pairs, sets.select(F.col("c").alias("a"), F.col("set").alias("x")), ["a"], "b", _hot_firsts(pairs))
    both = both.join(sets.select(F.col("c").alias("b"), F.col("set").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(100 * shared >= round(100 * similarity) * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _close_pairs(held: pa.Table, group: np.ndarray, cut: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs, within groups, of different components that are estimated close and meet here first.

    Two sets that are both below their group's size class (no ``top``) meet in the class below.
    """
    sig = np.frombuffer(b"".join(held.column("sig").to_pylist()), np.uint64).reshape(held.num_rows, -1)
    root, own, i, j, band, top = (held.column(c).to_numpy(zero_copy_only=False) for c in ("root", "own", "i", "j", "band", "top"))
    size, mixed = np.diff(group), (i != j)[group[:-1]]
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def keep(p: np.ndarray, q: np.ndarray) -> None:
        ok = (root[p] != root[q]) & (top[p] | top[q])
        if ok.any():
            p, q = p[ok], q[ok]
            near = estimate(sig[p], sig[q]) >= cut
            found.append((p[near], q[near]))

    for n in np.unique(size[(size <= SMALL) & ~mixed & (size > 1)]):
        starts = group[:-1][(size == n) & ~mixed]
        a, b = np.triu_indices(n, 1)
        step = max(1, 100_000 // len(a))
        for k in range(0, len(starts), step):
            at = starts[k : k + step, None]
            keep((at + a).ravel(), (at + b).ravel())
    for g in np.flatnonzero((size > SMALL) | (mixed & (size > 1))):
        rows = np.arange(group[g], group[g + 1])
        first = own[rows] == own[rows].min() if mixed[g] else np.ones(len(rows), bool)
        for k in rows[first]:
            rest = rows[~first] if mixed[g] else rows[rows > k]
            keep(np.full(len(rest), k), rest)
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    p, q = (np.concatenate(x) for x in zip(*found, strict=True))
    keys = np.frombuffer(b"".join(held.column("bands").to_pylist()), np.int64).reshape(held.num_rows, -1)
    ok = np.ones(len(p), bool)
    for k in range(0, len(p), 50_000):
        met = keys[p[k : k + 50_000]] == keys[q[k : k + 50_000]]
        ok[k : k + 50_000] = met.argmax(1) == band[p[k : k + 50_000]]
    return p[ok], q[ok]


_GROUP = ("bucket", "i", "j")
_BLOCK_ROW = "bucket bigint, i int, j int, own int, band int, top boolean, c bigint, root bigint, n bigint"


def _levels(placed: DataFrame, similarity: float) -> DataFrame:
    """(bucket, band, c, root, n) under their size class and the next one: bucket is then the class's, top marks the former.

    Sets of n and m shingles with n / m below the similarity cannot be similar; others lie in one size class or in two
    neighbouring ones.
    """
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.005 / similarity))).cast("int")
    rows = placed.withColumn("_at", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.select(F.xxhash64("bucket", level + F.col("_at")).alias("bucket"), "band", (F.col("_at") == 0).alias("top"), "c", "root", "n")


def _dealt(rows: DataFrame, sets: bool) -> DataFrame:
    """Rows of _BLOCK_ROW: the members of buckets that hold several components, in blocks bounded in rows (and in bytes of sets)."""
    blocks = F.greatest(F.col("k") / BLOCK, F.col("s") * 8 / BLOCK_BYTES) if sets else F.col("k") / BLOCK
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("k"), F.sum("n").alias("s"), F.min("root").alias("r"), F.max("root").alias("z"), F.max("top").alias("t")).where("r <> z and t")
    sizes = settle(sizes.select("bucket", "k", F.ceil(blocks).cast("int").alias("m")))
    total = sizes.agg(F.sum("k")).first()[0] or 0
    rows = salted_join(rows, sizes.select("bucket", "m"), ["bucket"], "c", hot_keys(sizes, ["bucket"], "k", total))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("c"), F.col("m")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    return rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "band", "top", "c", "root", "n")


def _close_members(rows: DataFrame, cut: float) -> DataFrame:
    """The rows that have a close, unlinked partner in their block, by signatures alone; a row at most once a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, group in whole_groups(batches, _GROUP):
            p, q = _close_pairs(held, group, cut)
            if len(p):
                yield from held.select([f.split()[0] for f in _BLOCK_ROW.split(", ")]).take(pa.array(np.unique(np.concatenate([p, q])))).to_batches()

    return rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "c").mapInArrow(run, schema(_BLOCK_ROW))


def _links_within(rows: DataFrame, cut: float, similarity: float) -> DataFrame:
    """Links (a, b) that connect all links between the components of each block, confirmed on the full sets.

    Within a block a pair is compared only while its two components are still apart.
    """
    percent = round(100 * similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, group in whole_groups(batches, _GROUP):
            p, q = _close_pairs(held, group, cut)
            ids, root = held.column("c").to_numpy(), held.column("root").to_numpy()
            sets = held.column("set")
            own: dict[int, np.ndarray] = {}
            parent: dict[int, int] = {}

            def find(v: int, parent=parent) -> int:
                while parent.setdefault(v, v) != v:
                    parent[v] = parent[parent[v]]
                    v = parent[v]
                return v

            links = []
            for a, b in zip(p.tolist(), q.tolist(), strict=True):
                if (u := find(int(root[a]))) != (v := find(int(root[b]))):
                    x, y = (own.setdefault(k, sets[k].values.to_numpy()) if k not in own else own[k] for k in (a, b))
                    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                        continue
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * shared >= percent * (len(x) + len(y) - shared):
                        parent[max(u, v)] = min(u, v)
                        links.append((min(ids[a], ids[b]), max(ids[a], ids[b])))
            if links:
                yield pa.record_batch([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "c").mapInArrow(run, schema("a bigint, b bigint"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """key, n_shingles, component_id and kept of every row.

    A null text or one without words has an empty set and stands alone.  Equal sets are linked always.  component_id
    is the smallest id reachable by links; rows that repeat an id, with equal or different texts, share what any of
    them reaches.  A row with a null id links with nothing, has a null component_id and is kept.  Further columns are
    ignored, whatever their names; an empty table gives no rows.  Ids must be integers.
    """
    with temporary():
        all_rows = keep(settle(signatures(docs, key, text)))
        full = all_rows.where("n > 0 and id is not null")
        reps = full.groupBy("s1", "s2", "n").agg(F.min("id").alias("low"), F.count("*").alias("w"), F.min(F.struct("sig", "bands")).alias("r"))
        reps = settle(reps.select(F.monotonically_increasing_id().alias("c"), "s1", "s2", "n", "low", "w", "r.*"))
        found = settle(_member_rows(reps))
        shared = settle(found.groupBy("bucket").agg(F.min("c").alias("leader"), F.count("*").alias("k")).where("k > 1"))
        total = shared.agg(F.sum("k")).first()[0] or 0
        members = settle(salted_join(found, shared, ["bucket"], "c", hot_keys(shared, ["bucket"], "k", total)).where("c <> leader"))
        cut = similarity - SLACK
        pairs = settle(members.select(F.col("leader").alias("a"), F.col("c").alias("b")).distinct())
        pairs = settle(_likely(pairs, reps, cut))
        links = settle(_confirm(pairs, reps, docs, key, text, similarity))
        # All pairs with a bucket's leader are settled; what is left lies between its other members.
        rest = members.where("k > 2").select("bucket", "band", "c")
        placed = rest.join(components(links).withColumnRenamed("id", "c"), "c", "left").select("bucket", "band", "c", F.coalesce("root", "c").alias("root"))
        placed = settle(placed)
        split = settle(placed.groupBy("bucket").agg(F.min("root").alias("r"), F.max("root").alias("z"), F.count("*").alias("k")).where("r <> z"))
        total = split.agg(F.sum("k")).first()[0] or 0
        if total:
            placed = salted_join(placed, split.select("bucket"), ["bucket"], "c", hot_keys(split, ["bucket"], "k", total))
            marks = reps.select("c", "sig", "bands")
            rows = settle(_levels(placed.join(reps.select("c", "n"), "c"), similarity))
            close = _close_members(_dealt(rows, sets=False).join(marks, "c"), cut).drop("i", "j", "own").dropDuplicates(["bucket", "c"])
            close = settle(close)
            sets = _sets_of(settle(close.select("c").distinct()), reps, docs, key, text)
            links = links.union(_links_within(_dealt(close, sets=True).join(marks, "c").join(sets, "c"), cut, similarity))
        # Links join the classes by their smallest ids; members of a class join through its smallest id, rows of one id
        # through the id.
        low = reps.select("c", "low")
        links = links.join(low.withColumnsRenamed({"c": "a", "low": "x"}), "a").join(low.withColumnsRenamed({"c": "b", "low": "y"}), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        hot = hot_keys(reps, ["s1", "s2", "n"], "w", full.count())
        equal = salted_join(full.select("id", "s1", "s2", "n"), reps.select("s1", "s2", "n", "low"), ["s1", "s2", "n"], "id", hot).where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b"))
        roots = components(links.union(equal))
    known = all_rows.where("id is not null").select("id", F.col("n").alias("n_shingles")).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    out = known.union(all_rows.where("id is null").select("id", "n", F.lit(None).cast("bigint")))
    return out.select(F.col("id").alias(key), "n_shingles", F.col("root").alias("component_id"), F.coalesce(F.col("id") == F.col("root"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their group, columns as they were.

    Ids that repeat keep all their rows or none; rows with a null id stay.
    """
    return without_ids(docs, key, settle(near_duplicates(docs, key, text).where("not kept").select(key).distinct()))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
