"""Periodic runs of words by partition refinement (operator 13)."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, schema, slices, table

#: A run reported has at least so many words, and repeats its period at least so often.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Up to this factor length the positions of all texts of a slice are refined together; what is left goes on text by text.
TOGETHER = 6

Run = tuple[int, int, int]


def _merged(starts: Iterable[int], period: int) -> Iterator[Run]:
    """(start, length, period) of the stretches that squares at consecutive starts (ascending) make."""
    first = last = None
    for s in starts:
        if first is not None and s != last + 1:
            yield first, last - first + 2 * period, period
            first = None
        first, last = s if first is None else first, s
    if first is not None:
        yield first, last - first + 2 * period, period


def refine_together(key: np.ndarray, lengths: int, members: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Classes of equal factors of lengths 1, 2, ... of one sequence, as (length, class by position, starts of squares).

    ``key`` is negative where no factor may reach (between texts).  Classes of fewer than ``members`` positions are
    given up (class -1): a position before one of them has no larger class in the next round.
    """
    n = len(key)
    classes = np.append(key, -1)
    at = np.flatnonzero(key >= 0)
    for length in range(1, lengths + 1):
        if length > 1:
            at = at[classes[at + 1] >= 0]
            pairs = classes[at] * np.int64(n + 1) + classes[at + 1]
        else:
            pairs = classes[at]
        order = np.argsort(pairs, kind="stable")
        by, at = pairs[order], at[order]
        opens = np.flatnonzero(np.append(True, by[1:] != by[:-1])) if len(by) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(opens, len(by)))
        kept = np.repeat(sizes >= members, sizes)
        number = np.repeat(np.arange(len(sizes)), sizes)[kept]
        at = at[kept]
        classes = np.full(n + 1, -1, np.int64)
        classes[at] = number
        squares = at[:-1][(number[1:] == number[:-1]) & (at[1:] - at[:-1] == length)]
        at = np.sort(at)
        yield length, classes, np.sort(squares)
        if not len(at):
            return


class Refinement:
    """Refines the position classes of one text from a given factor length on.

    A class of length k+1 is told apart by the class of length k that its next positions are in.  Of the parts into
    which a class falls the largest is passed over, the others split the classes before them in the next round, so a
    position is moved at most log2(n) times.  Each class is a list of ascending linked positions; ``gaps`` holds the
    positions by the distance to the next member.
    """

    def __init__(self, classes: dict[int, list[int]], length: int, members: int):
        self.length, self.members = length, members
        self.class_of: dict[int, int] = {i: c for c, own in classes.items() for i in own}
        self.size = {c: len(own) for c, own in classes.items()}
        self.last = {c: own[-1] for c, own in classes.items()}
        self.after: dict[int, int] = {}
        self.before: dict[int, int] = {}
        self.gaps: dict[int, set[int]] = defaultdict(set)
        for own in classes.values():
            for a, b in zip(own, own[1:], strict=False):
                self._link(a, b)
        self.splitters = [list(own) for own in classes.values()]
        self.gone = [i + 1 for i in self.class_of if i + 1 not in self.class_of]
        self.fresh = count(max(classes) + 1)

    def _link(self, a: int, b: int) -> None:
        self.after[a], self.before[b] = b, a
        if b - a > self.length:
            self.gaps[b - a].add(a)

    def _unlink(self, i: int) -> None:
        """Takes a position out of the list of its class."""
        c = self.class_of[i]
        a, b = self.before.pop(i, None), self.after.pop(i, None)
        if a is not None:
            self.gaps[i - a].discard(a)
        if b is not None:
            self.gaps[b - i].discard(i)
        if a is None and b is not None:
            del self.before[b]
        elif b is None and a is not None:
            del self.after[a]
            self.last[c] = a
        elif a is not None:
            self._link(a, b)
        self.size[c] -= 1

    def step(self) -> list[int]:
        """Goes on to the next length; the starts of squares of that period, ascending."""
        class_of, size = self.class_of, self.size
        family: dict[int, list[int]] = {}
        for i in self.gone:  # what precedes a class too small is in one itself now
            if i - 1 in class_of:
                c = class_of[i - 1]
                self._unlink(i - 1)
                del class_of[i - 1]
                family.setdefault(c, [c])
        gone = [i - 1 for i in self.gone]
        for splitter in self.splitters:
            part: dict[int, int] = {}
            for j in splitter:
                i = j - 1
                c = class_of.get(i)
                if c is None:
                    continue
                self._unlink(i)
                d = part.get(c)
                if d is None:
                    d = part[c] = next(self.fresh)
                    size[d] = 0
                    family.setdefault(c, [c]).append(d)
                else:
                    self._link(self.last[d], i)
                class_of[i], self.last[d] = d, i
                size[d] += 1
        self.length += 1
        self.splitters = []
        for parts in family.values():
            largest = max(parts, key=size.__getitem__)
            for c in parts:
                if size[c] < self.members:
                    own = self._members(c)
                    for i in own:
                        self._unlink(i)
                    for i in own:
                        del class_of[i]
                    gone += own
                    del size[c]
                    self.last.pop(c, None)
                elif c != largest:
                    self.splitters.append(self._members(c))
        self.gone = gone
        return sorted(self.gaps.pop(self.length, ()))

    def _members(self, c: int) -> list[int]:
        out, i = [], self.last[c] if self.size[c] else None
        while i is not None:
            out.append(i)
            i = self.before.get(i)
        return out[::-1]


def runs_of(texts: list[np.ndarray], least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> list[list[Run]]:
    """Of each sequence of word numbers its runs (start, length, period) by start, then period.

    A run is a longest stretch with a smallest period, of at least ``least`` words and ``times`` periods.  Every period
    of such a run stands among the distances of neighbours in a class of its length, and each of its factors recurs
    ``times - 1`` times, so smaller classes are given up.  Work: n log n moves for n words.
    """
    members = max(2, times - 1)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    key = np.full(begins[-1], -1, np.int64)
    widest = 1 + max((int(t.max()) for t in texts if len(t)), default=0)
    for k, t in enumerate(texts):
        if len(t):
            key[begins[k] : begins[k] + len(t)] = t + k * widest
    found: list[list[Run]] = [[] for _ in texts]

    def keep(k: int, runs: Iterable[Run]) -> None:
        found[k] += [r for r in runs if r[1] >= least and r[1] >= times * r[2]]

    left = None
    for length, classes, squares in refine_together(key, TOGETHER, members):
        if len(squares):
            of = np.searchsorted(begins, squares, side="right") - 1
            for k in np.unique(of).tolist():
                keep(k, _merged((squares[of == k] - begins[k]).tolist(), length))
        left = classes
    if left is not None:
        at = np.flatnonzero(left >= 0)
        of = np.searchsorted(begins, at, side="right") - 1
        for k in np.unique(of).tolist():
            own = at[of == k]
            classes: dict[int, list[int]] = defaultdict(list)
            for c, i in zip(left[own].tolist(), (own - begins[k]).tolist(), strict=True):
                classes[c].append(i)
            refinement = Refinement(classes, TOGETHER, members)
            while refinement.class_of and refinement.length < sizes[k] // times:
                squares = refinement.step()
                if squares:
                    keep(k, _merged(squares, refinement.length))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in found]


def repeated(runs: list[Run], n: int) -> np.ndarray:
    """Which of n words stand in a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) > 0


Arrange = Callable[[object, int], np.ndarray | None]


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", arrange: Arrange | None = None, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> DataFrame:
    """Key, n_words, runs (array of start, length, period by start, then period) and the text without repeats of every row.

    Words are what ASCII white space separates, numbered from 0; ``collapsed`` joins by one blank the words that stand
    in no run after its first period.  ``arrange`` gives for a key and a number of words the order in which they are to
    be taken (numbers may repeat), or None for their own.  A null text has no words, no runs and an empty collapsed
    text, as an empty one; repeated rows and null keys give rows like any other; an empty table gives none; further
    columns are ignored, whatever their names.  Memory: SLICE_BYTES of text, or one longer text, and a few numbers for each of its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            numbers: dict[bytes, int] = defaultdict(count().__next__)
            words, orders, codes = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = t.encode().split() if t else []
                code = np.fromiter(map(numbers.__getitem__, own), np.int64, len(own))
                order = arrange(k, len(own)) if arrange and own else None
                words.append(own)
                orders.append(order)
                codes.append(code if order is None else code[order])
            runs = runs_of(codes, least, times)
            texts = []
            for own, order, r in zip(words, orders, runs, strict=True):
                if r or order is not None:
                    taken = np.arange(len(own)) if order is None else order
                    own = map(own.__getitem__, taken[~repeated(r, len(taken))].tolist())
                texts.append(b" ".join(own))
            flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
            each = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], names=["start", "length", "period"])
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]), pa.int32())
            yield pa.record_batch(
                [b.column(0), pa.array([len(c) for c in codes], pa.int64()), pa.ListArray.from_arrays(offsets, each), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["_key", "n_words", "runs", "collapsed"],
            )

    source = bounded_batches(docs).select(docs[key].alias("_key"), docs[text].cast("string").alias("_text"))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, schema(f"_key {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")).withColumnRenamed("_key", key)


def planted(doc_id: object, n: int) -> np.ndarray | None:
    """The contract's planted period: for one id in ten the words from ``a`` on repeat the first ``p`` of them."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def run_digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Key, n_runs, the run that repeats its period most often (ties: smallest start, then period) and the digests of
    the list of runs and of the collapsed text, of a result of ``find_runs``."""
    best = F.element_at(F.expr("array_sort(runs, (x, y) -> CASE WHEN x.length * y.period <> y.length * x.period THEN CAST(sign(y.length * x.period - x.length * y.period) AS INT) WHEN x.start <> y.start THEN IF(x.start < y.start, -1, 1) ELSE CAST(sign(x.period - y.period) AS INT) END)"), 1)
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    found = found.select(F.col(key), "runs", "collapsed", F.when(F.size("runs") > 0, best).alias("best"), lines.alias("lines"))
    return found.select(
        key, F.size("runs").cast("bigint").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(find_runs(table(spark, sf_dir, "documents"), arrange=planted))
