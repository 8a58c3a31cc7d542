"""Benchmark decontamination by CGK embeddings and bit-sampling LSH (operator 1).

A word sequence is embedded by the random walk of Chakraborty, Goldenberg and Koucky: at every step the walk writes the
word it stands on and then stays or moves on, as a random function of step and word says.  Sequences a few edits apart
fall back into step, so edit distance becomes Hamming distance, and sampling a few steps of the embedding is a
locality-sensitive hash.  Windows of about an item's size start at every s-th word of a document; an item is
hashed at every offset that leaves such a window, so that one of them stands where a copy's windows start.  Steps are
sampled from the first half of a walk, before edits have pushed many walks apart; every second walk goes through windows
and items from their ends, so that edits crowded into one part leave the walks of the other part together.
Repeated walks and samples reach the target recall, and every candidate is verified by its exact edit distance in words
(words are compared by 64-bit hashes).  Items that the walks do not find often enough are searched for by counting shared
words, which loses none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, byte_view, release, schema, settle, slices, table
from quillon.llm.neardup import _mix, word_hashes

#: An item is found where a document's words are within this share of its length in word edits.
MOST_EDITS = 0.2
#: Samples of a walk and steps of a sample; as many walks are made as TARGET needs for items with as many edits as are
#: accepted, in the worst of the PLACEMENTS of edits, measured on every item, TRIALS times at least in all.  Items below
#: the target after WALKS walks are counted instead.
SAMPLES, STEPS, WALKS = 8, 4, 24
TARGET, TRIALS = 0.92, 1024
PLACEMENTS = ("everywhere", "front", "middle", "back")
#: Words of the items of one pass over the documents; more items take more passes.
ITEM_WORDS = 400_000
#: Least and most bits of the filter before a key lookup: it has about 128 for each key, and stays near the processor.
FILTER_BITS = (16, 22)

_BREAK = np.ones(256, bool)
_BREAK[48:58] = _BREAK[65:91] = _BREAK[97:123] = _BREAK[128:] = False


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (letters, digits and all non-ASCII) of texts, and their offsets; A-Z and Latin-1 in lower case."""
    raw, offsets = byte_view(texts)
    at = np.flatnonzero(raw[:-1] == 0xC3)
    at = at[(raw[at + 1] <= 0x9E) & (raw[at + 1] != 0x97)] + 1
    if len(at):
        raw = raw.copy()
        raw[at] += 0x20
    return word_hashes(raw, offsets, blank=_BREAK)


def stride_of(n: int) -> int:
    return 8 if n >= 24 else 4 if n >= 12 else 2 if n >= 6 else 1


def window_of(n: int) -> int:
    """Window size for an item of n words: the largest of a ladder of sizes that leaves all phases of its stride."""
    most, size = n - stride_of(n) + 1, 1
    while (bigger := max(size + 1, int(size * 1.25))) <= most:
        size = bigger
    return size


@dataclass
class Group:
    """Hashes of all items whose windows have one size: per repeat sorted keys with item and offset, and a bit filter."""

    size: int
    keys: list[np.ndarray]
    item: list[np.ndarray]
    offset: list[np.ndarray]
    filters: list[np.ndarray]


@dataclass
class Index:
    """Items with their hashes by direction (0: from their beginnings, 1: from their ends) and stride."""

    ids: list[int]
    words: list[np.ndarray]
    walks: int
    strides: tuple[dict[int, list[Group]], dict[int, list[Group]]]
    counted: tuple[int, ...] = ()

    def walks_of(self, direction: int) -> range:
        return range(direction, self.walks, 2)


def _sampled_steps(size: int, walk: int) -> np.ndarray:
    """(SAMPLES, STEPS) sorted steps among the first ``size`` of a walk, in which edits have pushed few walks apart yet."""
    rng = np.random.default_rng([size, walk, 23])
    n = max(1, size)
    return np.stack([np.sort(rng.choice(n, STEPS, replace=n < STEPS)) for _ in range(SAMPLES)])


def window_keys(words: np.ndarray, start: np.ndarray, end: np.ndarray, sizes: list[int], walk: int) -> dict[int, np.ndarray]:
    """Per window size the (SAMPLES, windows) keys of the windows at ``start``; words from ``end`` on are blank.

    One walk serves all sizes, as a shorter window's walk is the beginning of a longer one's.
    """
    plan = {n: _sampled_steps(n, walk) for n in sizes}
    keys = {n: np.tile((np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n))[:, None], len(start)) for n in sizes}
    last = max(int(p.max()) for p in plan.values()) + 1
    padded = np.append(words, np.uint64(0))
    at, top = start.astype(np.int64), len(words)
    bits = padded
    for step in range(last):
        if step % 60 == 0:
            bits = _mix(padded + np.uint64(1 + walk * 1000 + step))
        here = np.minimum(at, top)
        for n, steps in plan.items():
            uses = np.flatnonzero((steps == step).any(1))
            if len(uses):
                symbol = np.where(at < np.minimum(start + n, end), padded[here], np.uint64(0))
                for k in uses:
                    keys[n][k] = (keys[n][k] ^ symbol) * np.uint64(0xD6E8FEB86659FD93)
                    keys[n][k] ^= keys[n][k] >> np.uint64(31)
        at = at + ((bits[here] >> np.uint64(step % 60)) & np.uint64(1)).view(np.int64)
    return keys


def build(ids: list[int], words: list[np.ndarray], walks: int) -> Index:
    by: dict[tuple[int, int], list[int]] = {}
    for k, w in enumerate(words):
        if len(w):
            by.setdefault((stride_of(len(w)), window_of(len(w))), []).append(k)
    index = Index(ids, words, walks, ({}, {}))
    for direction in (0, 1):
        _hash_items(index, by, direction)
    return index


def _hash_items(index: Index, by: dict[tuple[int, int], list[int]], direction: int) -> None:
    words = index.words if direction == 0 else [w[::-1] for w in index.words]
    for (stride, size), chosen in sorted(by.items()):
        joined = np.concatenate([words[k] for k in chosen])
        begin = np.concatenate([[0], np.cumsum([len(words[k]) for k in chosen])])
        item = np.concatenate([np.full(len(words[k]) - size + 1, k) for k in chosen])
        offset = np.concatenate([np.arange(len(words[k]) - size + 1) for k in chosen])
        start = np.concatenate([begin[i] + np.arange(len(words[k]) - size + 1) for i, k in enumerate(chosen)])
        group = Group(size, [], [], [], [])
        for walk in index.walks_of(direction):
            for key in window_keys(joined, start, start + size, [size], walk)[size]:
                order = np.argsort(key, kind="stable")
                group.keys.append(key[order])
                group.item.append(item[order])
                group.offset.append(offset[order])
                bits = np.zeros(1 << min(FILTER_BITS[1], max(FILTER_BITS[0], (128 * len(key)).bit_length())), bool)
                bits[key & np.uint64(len(bits) - 1)] = True
                group.filters.append(bits)
        index.strides[direction].setdefault(stride, []).append(group)


def candidates(index: Index, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Distinct (row, item, place of the item's first word in the row) where a window shares a key with an item."""
    forth = _met(index, 0, words, offsets)
    # The same from the ends: rows and items turned round, then places turned back.
    back = _met(index, 1, words[::-1], offsets[-1] - offsets[::-1])
    n, size = np.diff(offsets), np.array([len(w) for w in index.words], np.int64)
    rows = len(n) - 1 - back[:, 0]
    back = np.stack([rows, back[:, 1], n[rows] - back[:, 2] - size[back[:, 1]]], 1)
    counted = [_by_counting(k, index.words[k], words, offsets) for k in index.counted]
    return np.unique(np.concatenate([forth, back, *counted]), axis=0)


def _by_counting(k: int, item: np.ndarray, words: np.ndarray, offsets: np.ndarray, share: float = MOST_EDITS) -> np.ndarray:
    """(row, item, place) of all places from which an alignment within the accepted edits can start: it keeps all but
    ``slack`` of the item's words and is at most ``slack`` longer, so counts of the item's words over such stretches lose none."""
    slack, known = int(share * len(item)), np.unique(item)
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(words)) - offsets[:-1][row]
    total = np.append(0, np.cumsum(known[np.searchsorted(known, words).clip(0, len(known) - 1)] == words)) if len(words) else np.zeros(1, np.int64)
    end = np.minimum(np.arange(len(words)) + len(item) + slack, offsets[1:][row])
    at = np.flatnonzero(total[end] - total[:-1] >= len(item) - slack)
    return np.stack([row[at], np.full(len(at), k), place[at]], 1)


def _met(index: Index, direction: int, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    found = []
    n = np.diff(offsets)
    for stride, groups in index.strides[direction].items():
        many = -(-n // stride)
        row = np.repeat(np.arange(len(n)), many)
        start = offsets[:-1][row] + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * stride
        end = offsets[1:][row]
        for turn, walk in enumerate(index.walks_of(direction)):
            keys = window_keys(words, start, end, [g.size for g in groups], walk)
            for g in groups:
                for k in range(SAMPLES):
                    r, key = turn * SAMPLES + k, keys[g.size][k]
                    bits = g.filters[r]
                    maybe = np.flatnonzero(bits[key & np.uint64(len(bits) - 1)])
                    maybe = maybe[start[maybe] + g.size <= end[maybe]]  # else blanks would meet blanks
                    if not len(maybe):
                        continue
                    low, high = np.searchsorted(g.keys[r], key[maybe], "left"), np.searchsorted(g.keys[r], key[maybe], "right")
                    hit = np.repeat(maybe, high - low)
                    if len(hit):
                        at = np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange(len(hit))
                        found.append(np.stack([row[hit], g.item[r][at], start[hit] - offsets[:-1][row[hit]] - g.offset[r][at]], 1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def semi_global(item: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Least word edits between the item and any part of each window (rows; ends are free)."""
    n, m = windows.shape
    ramp = np.arange(m + 1)
    d = np.zeros((n, m + 1), np.int64)
    for i, w in enumerate(item.tolist()):
        new = np.empty_like(d)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(d[:, 1:] + 1, d[:, :-1] + (windows != np.uint64(w)))
        d = np.minimum.accumulate(new - ramp, 1) + ramp
    return d.min(1)


def verify(index: Index, words: np.ndarray, offsets: np.ndarray, found: np.ndarray, share: float) -> np.ndarray:
    """(row, item, edits, place) of the candidates within ``share`` edits, the best place of each row and item."""
    out, n = [], np.diff(offsets)
    for k in np.unique(found[:, 1]):
        own = found[found[:, 1] == k]
        item = index.words[k]
        slack, known = int(share * len(item)), np.unique(item)
        begin = np.maximum(own[:, 2] - slack, 0)
        at = begin[:, None] + np.arange(len(item) + 2 * slack)
        for lo in range(0, len(own), 4096):
            part = at[lo : lo + 4096]
            rows = own[lo : lo + 4096, 0]
            inside = part < n[rows][:, None]
            windows = np.where(inside, words[np.minimum(offsets[:-1][rows][:, None] + part, max(0, len(words) - 1))], np.uint64(0))
            # An alignment with so few edits keeps all but ``slack`` of the item's words, so others need no table.
            likely = np.flatnonzero(known[np.searchsorted(known, windows).clip(0, len(known) - 1)] == windows)
            likely = np.flatnonzero(np.bincount(likely // windows.shape[1], minlength=len(rows)) >= len(item) - slack)
            edits = semi_global(item, windows[likely])
            ok = likely[edits <= slack]
            out.append(np.stack([rows[ok], np.full(len(ok), k), edits[edits <= slack], np.maximum(own[lo : lo + 4096, 2][ok], 0)], 1))
    got = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
    got = got[np.lexsort((got[:, 3], got[:, 2], got[:, 1], got[:, 0]))]
    if len(got):
        first = np.concatenate([[True], (got[1:, :2] != got[:-1, :2]).any(1)])
        got = got[first]
    return got


def edited(rng: np.random.Generator, words: np.ndarray, edits: int, where: str = "everywhere") -> np.ndarray:
    """The words after substitutions, deletions and insertions of words that occur nowhere else: at random places, or of
    every second word at the front, in the middle or at the back."""
    out = words.tolist()
    first = {"front": 0, "middle": max(0, (len(out) - 2 * edits) // 2), "back": max(0, len(out) - 2 * edits)}.get(where)
    for turn in reversed(range(edits)):
        kind = rng.integers(3)
        at = int(rng.integers(max(1, len(out)))) if first is None else min(first + 2 * turn, max(0, len(out) - 1))
        new = int(rng.integers(1, 1 << 62))
        if kind == 0 and out:
            out[at] = new
        elif kind == 1 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, new)
    return np.array(out, np.uint64)


def measured_hits(index: Index, share: float, where: str, trials: int = TRIALS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """For each trial its item, and whether the item, edited and set into random words, is met; every item is tried."""
    rng = np.random.default_rng(seed)
    full = [k for k, w in enumerate(index.words) if len(w)]
    own = np.array([full[t % len(full)] for t in range(len(full) * -(-trials // len(full)))] if full else [], np.int64)
    rows = []
    for k in own.tolist():
        body = edited(rng, index.words[k], int(share * len(index.words[k])), where)
        pad = rng.integers(1, 1 << 62, 60).astype(np.uint64)
        cut = int(rng.integers(8, 50))
        rows.append(np.concatenate([pad[:cut], body, pad[cut:]]))
    if not rows:
        return own, np.zeros(0, bool)
    got = candidates(index, np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]))
    met = np.zeros(len(own), bool)
    met[got[own[got[:, 0]] == got[:, 1], 0]] = True
    return own, met


def measured_recall(index: Index, share: float, trials: int = TRIALS, seed: int = 5) -> float:
    """The share of trials met in the worst placement of edits."""
    return min((met.mean() if len(met) else 1.0) for where in PLACEMENTS for _, met in [measured_hits(index, share, where, trials, seed)])


def index_items(ids: list[int], texts: list[str | None], target: float = TARGET, share: float = MOST_EDITS, most: int = WALKS) -> Index:
    """The least number of walks that reaches the target recall on items with ``share`` of their words edited; items that
    stay below it with ``most`` walks are counted instead."""
    values, at = words_of(pa.array(texts, pa.string()))
    words = [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    for walks in range(2, most + 1):
        index = build(ids, words, walks)
        if measured_recall(index, share) >= target:
            return index
    missed = set()
    for where in PLACEMENTS:
        own, met = measured_hits(index, share, where, 16 * len(words))
        tried = np.bincount(own, minlength=len(words))
        missed |= set(np.flatnonzero(np.bincount(own, met, len(words)) < target * tried).tolist())
    index.counted = tuple(sorted(missed))
    return index


def _indexes(items: DataFrame, key: str, text: str, share: float) -> Iterator[tuple[Index, bool]]:
    """Indexes of blocks of items, of about ITEM_WORDS words each whatever the number of items, one after the other, and
    whether a block is the last; the driver holds one of them at a time."""
    rows = items.select(F.col(key).cast("bigint").alias("i"), F.col(text).cast("string").alias("t")).where("i is not null and t is not null")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-int(size) // (6 * ITEM_WORDS)) or 1
    for k in range(blocks):
        got = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).toArrow()
        yield index_items(got.column(0).to_pylist(), got.column(1).to_pylist(), share=share), k == blocks - 1


def find_contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", share: float = MOST_EDITS) -> DataFrame:
    """One row for each document row and item found in it: key, item_id, edits, first_word, item_words.

    edits is the exact word edit distance of the item to the nearest part of the document around the best candidate,
    at most ``share`` of the item's words; first_word is about where the item starts.  Null texts, and items without
    words or with a null id, give nothing.  A document's null key stays null.  Repeated documents give repeated rows, an item
    repeated under one id one row each time it stands in ``items``.  Further columns are ignored, whatever their names; empty tables
    give no rows.  A broadcast index holds a
    block of at most about ITEM_WORDS item words; each block is a pass over the documents.
    """
    rows = bounded_batches(docs).select(docs[key].alias("_key"), docs[text].cast("string").alias("_text")).where(F.col("_text").isNotNull())
    kind = rows.schema[0].dataType.simpleString()
    out = None
    for index, last in _indexes(items, item_key, item_text, share):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in slices(batches, "_text"):
                words, offsets = words_of(b.column(1))
                got = verify(index, words, offsets, candidates(index, words, offsets), share)
                if len(got):
                    lengths = [len(index.words[k]) for k in got[:, 1]]
                    yield pa.record_batch([b.column(0).take(pa.array(got[:, 0])), pa.array([index.ids[k] for k in got[:, 1]], pa.int64()), pa.array(got[:, 2].astype(np.int32)), pa.array(got[:, 3]), pa.array(lengths, pa.int32())], names=["_key", "item_id", "edits", "first_word", "item_words"])

        one = rows.mapInArrow(run, schema(f"_key {kind}, item_id bigint, edits int, first_word bigint, item_words int"))
        if not last:  # a block's matches are written before the next block's index is made
            one = settle(one)
            shared.destroy()
        out = one if out is None else out.union(one)
    return out.withColumnRenamed("_key", key)


def keep_clean(docs: DataFrame, items: DataFrame, share: float = MOST_EDITS) -> DataFrame:
    """The rows of ``docs`` in which no item is found, columns as they were; one pass for each block of items.

    Null and empty texts hold no item and stay; null ids, repeated rows and further columns change nothing.
    """
    at = docs.columns.index("text")
    before = None
    for index, last in _indexes(items, "item_id", "text", share):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text"):
                words, offsets = words_of(b.column(at))
                got = verify(shared.value, words, offsets, candidates(shared.value, words, offsets), share)
                keep = np.ones(b.num_rows, bool)
                keep[got[:, 0]] = False
                yield b.filter(pa.array(keep))

        docs = bounded_batches(docs).mapInArrow(run, docs.schema)
        if not last:
            docs = settle(docs)
            shared.destroy()
            if before is not None:
                release(before)
            before = docs
    return docs


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
