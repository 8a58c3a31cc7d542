"""Ranked lexical search over an inverted index in shards (operator 12)."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, keep, pack_numbers, release, schema, settle, slices, table, temporary, unpack_numbers, whole_groups

#: A shard is closed at so many bytes of text or so many documents.
SHARD_BYTES, SHARD_ROWS = 16 << 20, 8192
#: Item terms searched in one pass over the index, about; terms that are broadcast to the postings at most.
BLOCK_TERMS, BROADCAST_TERMS = 1 << 20, 1 << 18
# Bytes of terms in lower case (A-Z alone are changed), all others a blank: letters and digits of ASCII and every byte above it.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: A header row of a shard has no term: its documents in the order of their ids, and their lengths.  The other rows hold a
#: term's postings: pairs (step from the last place, occurrences) in bytes of seven bits.
INDEX = "shard bigint, term string, n_docs bigint, n_terms bigint, postings binary, ids array<bigint>, lengths array<bigint>"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, with repeats."""
    return text.encode().translate(_LOWER).split() if text else []


class _Shard:
    """Collects documents and turns them into the rows of one shard."""

    def __init__(self):
        self.numbers: dict[bytes, int] = defaultdict(count().__next__)
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.codes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        words = terms_of(text)
        codes, counts = np.unique(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)), return_counts=True)
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.codes.append(codes)
        self.counts.append(counts.astype(np.int32))
        self.bytes += len(text or "")

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] or 0))
        ids, lengths = [self.ids[k] for k in order], [self.lengths[k] for k in order]
        kinds = schema_of_index()
        header = [[shard], [None], [sum(n > 0 for n in lengths)], [sum(lengths)], [None], [ids], [lengths]]
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(header, kinds, strict=True)], schema=kinds)
        codes = np.concatenate([self.codes[k] for k in order])
        if not len(codes):
            return
        place = np.repeat(np.arange(len(order)), [len(self.codes[k]) for k in order])
        counts = np.concatenate([self.counts[k] for k in order])
        by = np.argsort(codes, kind="stable")
        codes, place, counts = codes[by], place[by], counts[by]
        opens = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        step = place - np.append(0, place[:-1])
        step[opens] = place[opens]
        raw, ends = pack_numbers(np.column_stack([step, counts]).ravel())
        bounds = np.append(0, ends[np.append(opens[1:], len(codes)) * 2 - 1])
        n_docs = np.diff(np.append(opens, len(codes)))
        names = pa.array(list(self.numbers), pa.binary()).cast(pa.string()).take(pa.array(codes[opens]))
        postings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(opens), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
        n = len(opens)
        whole = pa.record_batch([pa.array(np.full(n, shard)), names, pa.array(n_docs), pa.array(np.add.reduceat(counts.astype(np.int64), opens)), postings, pa.nulls(n, kinds[5].type), pa.nulls(n, kinds[6].type)], schema=kinds)
        for k in range(0, n, 10_000):
            yield whole.slice(k, 10_000)


def schema_of_index() -> pa.Schema:
    longs = pa.list_(pa.int64())
    return pa.schema([("shard", pa.int64()), ("term", pa.string()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("postings", pa.binary()), ("ids", longs), ("lengths", longs)])


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The inverted index of all rows, written to the shared folder: one header and a row a term for each shard.

    A shard holds documents that one task read, in the order of their ids, so nothing is shuffled and a term that stands
    everywhere has a bounded row in every shard.  Terms are ASCII letters and digits (A-Z in lower case) and all
    other characters above ASCII, in longest stretches.  Null and empty texts are documents without terms.  Memory: a shard's numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        shard, made = _Shard(), 0
        for b in slices(batches, "_text"):
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard.add(k, t)
                if shard.bytes >= shard_bytes or len(shard.ids) >= SHARD_ROWS:
                    yield from shard.rows(first + made)
                    shard, made = _Shard(), made + 1
        if shard.ids:
            yield from shard.rows(first + made)

    source = bounded_batches(docs).select(docs[key].cast("bigint").alias("_key"), docs[text].cast("string").alias("_text"))
    return settle(source.mapInArrow(run, schema(INDEX)))


class Postings:
    """A term's postings in one shard: places in ascending order and what each adds to a score."""

    __slots__ = ("places", "gains", "most")

    def __init__(self, packed: bytes, weight: int, dampers: np.ndarray):
        pairs = unpack_numbers(packed).reshape(-1, 2)
        places, n = np.cumsum(pairs[:, 0]), pairs[:, 1]
        gains = weight * ((1_000_000_000 * n) // (1000 * n + 8 * dampers[places]))
        self.places, self.gains, self.most = places.tolist(), gains.tolist(), int(gains.max())


def rank_shard(lists: list[tuple[Postings, int]], ids: list[float], most: int, best: list[tuple[int, float]]) -> None:
    """Merges an item's postings document by document and offers each score to ``best``.

    lists: postings and how often the item names their term.  ``best`` is a heap of at most ``most`` (score, -doc_id),
    the worst first.  A heap holds the next place of each list; all that stand at its lowest place make a document.
    Lists whose bounds together stay below the worst score kept cannot bring a document in by themselves: they are
    left out of the merge and looked up for the documents that the others bring, as long as the worst score is in reach.
    """
    lists = sorted(lists, key=lambda x: x[0].most * x[1])
    bounds = [*accumulate((p.most * n for p, n in lists), initial=0)]
    places, gains, times = [p.places for p, _ in lists], [p.gains for p, _ in lists], [n for _, n in lists]
    at = [0] * len(lists)
    full = len(best) >= most
    least = best[0][0] if full else 1
    first = 0
    while first < len(lists) and bounds[first + 1] < least:
        first += 1
    width = len(lists)
    merge = [places[j][0] * width + j for j in range(first, width)]
    heapify(merge)
    while merge:
        place = merge[0] // width
        limit, score = (place + 1) * width, 0
        while merge and merge[0] < limit:
            j = merge[0] - place * width
            k = at[j]
            score += gains[j][k] * times[j]
            at[j] = k = k + 1
            if k < len(places[j]):
                heapreplace(merge, places[j][k] * width + j)
            else:
                heappop(merge)
        for j in range(first - 1, -1, -1):
            if score + bounds[j + 1] < least:
                break
            own = places[j]
            at[j] = k = bisect_left(own, place, at[j])
            if k < len(own) and own[k] == place:
                score += gains[j][k] * times[j]
        if score < least:
            continue
        entry = (score, -ids[place])
        if not full:
            heappush(best, entry)
            full = len(best) >= most
        elif entry > best[0]:
            heapreplace(best, entry)
        if full and best[0][0] > least:
            least = best[0][0]
            before = first
            while first < width and bounds[first + 1] < least:
                first += 1
            if first > before:
                merge = [x for x in merge if x % width >= first]
                heapify(merge)


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, key, term, n): every row of ``items`` is an item of its own, with its terms and how often it names them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            found = [np.unique(np.array(terms_of(t), object), return_counts=True) for t in b.column(2).to_pylist()]
            rows = np.repeat(np.arange(len(found)), [len(x) for x, _ in found])
            terms = pa.array([t for x, _ in found for t in x], pa.binary()).cast(pa.string())
            n = np.concatenate([c for _, c in found]).astype(np.int64)
            yield pa.record_batch([b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), terms, pa.array(n)], names=["item", "_key", "term", "n"])

    source = bounded_batches(items).select(F.monotonically_increasing_id().alias("item"), items[key].alias("_key"), items[text].cast("string").alias("_text"))
    kind = source.schema[1].dataType.simpleString()
    return settle(source.mapInArrow(run, schema(f"item bigint, _key {kind}, term string, n bigint")))


def search(index: DataFrame, items: DataFrame, most: int = 10, key: str = "item_id", text: str = "text") -> DataFrame:
    """key, rank, doc_id and score of the ``most`` documents that score highest for each item, of those above 0.

    Weights and scores are whole numbers (see README); equal scores go by ascending doc_id, null ids last.  Each shard
    is merged document by document, with a bounded heap for an item that stays with the task for its next shards, and the tasks'
    heaps are merged.  Items meet the postings by term: up to BROADCAST_TERMS terms are broadcast, more are joined by a
    shuffle; items go in blocks of about BLOCK_TERMS terms.  Items without text have no result; repeated items are each ranked.
    """
    spark = index.sparkSession
    kind = items.schema[key].dataType.simpleString()
    empty = f"_key {kind}, rank int, doc_id bigint, score bigint"
    with temporary():
        wanted = item_terms(items, key, text)
        n_docs, n_terms = index.where("term IS NULL").agg(F.sum("n_docs"), F.sum("n_terms")).first()
        pairs = wanted.count()
        if not n_terms or not pairs:
            return spark.createDataFrame([], empty).withColumnRenamed("_key", key)
        blocks = -(-pairs // BLOCK_TERMS)
        found = []
        for block in range(blocks):
            own = wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
            by_term = own.groupBy("term").agg(F.collect_list(F.struct("item", "n")).alias("items"))
            small = by_term.count() <= BROADCAST_TERMS

            def near(x: DataFrame, small=small) -> DataFrame:
                return F.broadcast(x) if small else x

            frequent = index.join(near(by_term.select("term")), "term").groupBy("term").agg(F.sum("n_docs").alias("df"))
            weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
            weighted = settle(by_term.join(frequent.select("term", weight.cast("bigint").alias("weight")), "term").where("weight > 0"))
            rows = index.join(near(weighted), "term").select("shard", "term", "postings", "weight", "items", F.expr("CAST(NULL AS array<bigint>) AS ids"), F.expr("CAST(NULL AS array<bigint>) AS lengths"))
            heads = index.where("term IS NULL").select("shard", "term", "postings", F.expr("CAST(NULL AS bigint) AS weight"), F.expr("CAST(NULL AS array<struct<item:bigint,n:bigint>>) AS items"), "ids", "lengths")
            found.append(settle(_ranked(rows.unionByName(heads), n_docs, n_terms, most)))
        every = found[0]
        for f in found[1:]:
            every = every.union(f)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        top = every.withColumn("rank", rank).where(F.col("rank") <= most)
        named = wanted.select("item", "_key").distinct()
        out = settle(top.join(named, "item").select("_key", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
        return keep(out).withColumnRenamed("_key", key)


def _ranked(rows: DataFrame, n_docs: int, n_terms: int, most: int) -> DataFrame:
    """(item, doc_id, score): the heaps of every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = defaultdict(list)
        for group, bounds in whole_groups(batches, ("shard",)):
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                shard = group.slice(a, b - a)
                if b - a < 2:
                    continue
                # The header is first.
                ids = [float("inf") if i is None else i for i in shard.column("ids")[0].as_py()]
                lengths = np.array(shard.column("lengths")[0].as_py(), np.int64)
                dampers = 100 - 75 + (75 * lengths * n_docs) // n_terms
                lists: dict[int, list] = defaultdict(list)
                for packed, weight, items in zip(*(shard.column(c).slice(1).to_pylist() for c in ("postings", "weight", "items")), strict=True):
                    own = Postings(packed, weight, dampers)
                    for x in items:
                        lists[x["item"]].append((own, x["n"]))
                for item, own in lists.items():
                    rank_shard(own, ids, most, best[item])
        flat = [(i, None if d == float("-inf") else -d, s) for i, heap in best.items() for s, d in heap]
        yield pa.record_batch([pa.array([x[k] for x in flat], pa.int64()) for k in range(3)], names=["item", "doc_id", "score"])

    dealt = bounded_batches(rows).repartition("shard").sortWithinPartitions("shard", F.asc_nulls_first("term"))
    return dealt.mapInArrow(run, schema("item bigint, doc_id bigint, score bigint"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(table(spark, sf_dir, "documents"))
    found = search(index, table(spark, sf_dir, "benchmark"))
    release(index)
    return found


#: The same ranking in SQL.
SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
q AS (SELECT item_id, t, count(*) AS k FROM i GROUP BY ALL),
a AS (SELECT CAST(count(*) AS BIGINT) AS n_all, CAST(sum(len(w)) AS BIGINT) AS l_all FROM d WHERE len(w) > 0),
x AS (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d), p AS (SELECT doc_id, n, t, count(*) AS tf FROM x GROUP BY ALL),
f AS (SELECT t, CAST(floor(1000 * ln((2 * n_all + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, a WHERE t IN (SELECT t FROM q) GROUP BY t, n_all),
s AS (SELECT item_id, doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_all) // l_all)))) AS BIGINT) AS score FROM q JOIN f USING (t) JOIN p USING (t), a GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10"""
