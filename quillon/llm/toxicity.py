"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration (operator 6)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, bounded_sample, id_crc, release, schema, settle, slices, table

#: Labelled rows that the lexicon, the trees and the calibration are fitted on, and the folds of the cross-fitting.
SAMPLE_ROWS = 8000
FOLDS = 4
TREES, DEPTH, RATE, BINS, LEAST_ROWS = 90, 4, 0.12, 48, 8.0
NEAR_WORDS = 4
PREFIX = 4

# General insults in the four languages, and second-person words.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb fool loser losers trash garbage scum pathetic worthless disgusting clown clowns jerk creep liar ugly useless imbecile "
    "dumm blöd trottel versager abschaum wertlos ekelhaft idiotisch lügner nutzlos hässlich "
    "stupide imbécile crétin minable ordure dégoûtant débile menteur inutile raclure "
    "estúpido estúpida idiota imbécil basura escoria patético asqueroso mentiroso inútil payaso".encode().split()
)
SECOND_PERSON = frozenset("you your yours yourself u du dich dir dein deine ihr euch tu toi te ton ta tes vous votre vos usted ti tus su".encode().split())

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
FEATURES = (
    "insults", "insults_share", "learned", "learned_share", "prefixes", "prefixes_share", "near_second_person", "second_person_share", "capitals", "all_capitals", "marks",
    "exclaims", "symbols", "inner_symbols", "inner_digits", "runs", "digits", "not_ascii", "log_words", "word_length",
)


@dataclass
class Lexicon:
    words: frozenset
    prefixes: frozenset


def _share(x: np.ndarray, n: int) -> float:
    return float(np.count_nonzero(x)) / n


_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True
_DIGITS = np.zeros(256, bool)
_DIGITS[48:58] = True
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[*b"#$%&*@^~|+=<>_\\/"]] = True
_STOPS = np.zeros(256, bool)
_STOPS[[*b"!?.,;:\"'()-"]] = True


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The FEATURES of one text; all zero if it is null or empty.  Counts are log-scaled, rates are per byte or word."""
    if not text:
        return [0.0] * len(FEATURES)
    data = text.encode()
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    words = data.translate(_TABLE).split()
    m = max(1, len(words))
    insults = sum(map(INSULTS.__contains__, words))
    learned = sum(map(lexicon.words.__contains__, words))
    prefixes = sum([w[:PREFIX] in lexicon.prefixes for w in words])
    second = sum(map(SECOND_PERSON.__contains__, words))
    near = 0
    if second and (insults or learned or prefixes):
        persons = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        hits = [i for i, w in enumerate(words) if w in INSULTS or w in lexicon.words or w[:PREFIX] in lexicon.prefixes]
        at = np.searchsorted(persons, hits)
        persons = np.array([-(10**9), *persons, 10**9])
        near = int(np.count_nonzero(np.minimum(np.array(hits) - persons[at], persons[at + 1] - np.array(hits)) <= NEAR_WORDS))
    letters, digits, symbols = _LETTERS[raw], _DIGITS[raw], _SYMBOLS[raw]
    between = letters[:-2] & letters[2:] if n > 2 else np.zeros(0, bool)
    upper = (raw >= 65) & (raw <= 90)
    same = (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & letters[2:] if n > 2 else np.zeros(0, bool)
    log = np.log1p
    return [
        float(log(insults)), insults / m, float(log(learned)), learned / m, float(log(prefixes)), prefixes / m, near / m, second / m, _share(upper, n), _share(upper[1:] & upper[:-1], n),
        _share(_STOPS[raw], n), _share(raw == 33, n), _share(symbols, n), _share(between & symbols[1:-1], n) if n > 2 else 0.0, _share(between & digits[1:-1], n) if n > 2 else 0.0, _share(same, n), _share(digits, n),
        _share(raw >= 128, n), float(log(len(words))), n / m,
    ]


def matrix(texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
    return np.array([features(t, lexicon) for t in texts], dtype=float).reshape(-1, len(FEATURES))


def learn_lexicons(sample: DataFrame, least: int, purity: float = 0.55) -> list[Lexicon]:
    """Words and word prefixes found in at least ``least`` toxic texts that make up ``purity`` of all texts with them.

    sample has text, toxic and fold.  FOLDS lexicons, each learned without one fold, then the one of all rows.  Words
    are counted on the executors and only chosen ones travel; words beyond 64 bytes are no lexicon words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            seen: Counter = Counter()
            for text, toxic, fold in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words = {w for w in (text or "").encode().translate(_TABLE).split() if len(w) <= 64}
                for kind, found in enumerate((words, {w[:PREFIX] for w in words if len(w) > PREFIX})):
                    seen.update((kind, w, fold, toxic) for w in found)
            kinds, words, folds, toxics = zip(*seen, strict=True) if seen else ((),) * 4
            yield pa.record_batch([pa.array(kinds, pa.int32()), pa.array(words, pa.binary()), pa.array(folds, pa.int32()), pa.array(toxics, pa.int32()), pa.array([*seen.values()], pa.int64())], names=["kind", "word", "fold", "toxic", "n"])

    counts = bounded_batches(sample).select("text", "toxic", "fold").mapInArrow(run, schema("kind int, word binary, fold int, toxic int, n bigint"))
    without = [F.col("fold") != k for k in range(FOLDS)] + [F.lit(True)]
    sums = counts.groupBy("kind", "word").agg(*[F.sum(F.when(w & (F.col("toxic") == 1) if t else w, F.col("n")).otherwise(0)).alias(f"{'te'[1 - t]}{k}") for k, w in enumerate(without) for t in (0, 1)])
    good = [(F.col(f"t{k}") >= least) & (F.col(f"t{k}") >= purity * F.col(f"e{k}")) for k in range(FOLDS + 1)]
    rows = sums.select("kind", "word", F.array(*good).alias("good")).where(F.exists("good", lambda g: g)).toArrow().to_pylist()
    return [Lexicon(*(frozenset(bytes(r["word"]) for r in rows if r["kind"] == kind and r["good"][k]) for kind in (0, 1))) for k in range(FOLDS + 1)]


@dataclass
class Forest:
    edges: list[np.ndarray]
    base: float
    #: Per tree: feature and bin limit of the 2**DEPTH - 1 inner nodes, values of the 2**DEPTH leaves.
    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.binned(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for f, lim, v in zip(self.feature, self.limit, self.value, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[rows, f[node]] > lim[node])
            out += v[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Forest:
    """Logistic gradient boosting on quantile-binned features, level by level, with Newton leaf values."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    forest = Forest(edges, float(np.log(rate / (1 - rate))), np.zeros((TREES, 2**DEPTH - 1), int), np.full((TREES, 2**DEPTH - 1), BINS + 1), np.zeros((TREES, 2**DEPTH)))
    b, n, many = forest.binned(x), len(y), x.shape[1]
    rows, width = np.arange(n), BINS + 2
    score = np.full(n, forest.base)
    cell = b + np.arange(many) * width
    for t in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, int)
        for level in range(DEPTH):
            first = 2**level - 1
            at = ((node - first)[:, None] * (many * width) + cell).ravel()
            shape = (2**level, many, width)
            size = 2**level * many * width
            sums = [np.bincount(at, np.repeat(v, many), size).reshape(shape).cumsum(2) for v in (g, h, np.ones(n))]
            (gl, hl, cl), (gt, ht, ct) = sums, [s[:, :, -1:] for s in sums]
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            gain[(cl < LEAST_ROWS) | (ct - cl < LEAST_ROWS)] = -1
            flat = gain.reshape(2**level, -1)
            best = flat.argmax(1)
            ok = flat[np.arange(2**level), best] > 1e-9
            forest.feature[t, first : first + 2**level] = np.where(ok, best // width, 0)
            forest.limit[t, first : first + 2**level] = np.where(ok, best % width, width)
            node = 2 * node + 1 + (b[rows, forest.feature[t][node]] > forest.limit[t][node])
        leaf = node - (2**DEPTH - 1)
        forest.value[t] = -RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        score += forest.value[t][leaf]
    return forest


def isotonic(score: np.ndarray, y: np.ndarray, prior: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the increasing fit by pooling adjacent violators, each pool's mean drawn to 1/2.

    Without ``prior`` the knots are the least-squares increasing fit; with it a pool of n rows counts as 2 * prior rows
    more, half of them positive, so that small pools are not told as certain.
    """
    order = np.lexsort((y, score))
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(s), float(s)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            v2 = blocks.pop()
            blocks[-1][0] += v2[0]
            blocks[-1][1] += v2[1]
            blocks[-1][3] = v2[3]
    xs = [e for b in blocks for e in (b[2], b[3])]
    ys = [(b[0] + prior) / (b[1] + 2 * prior) for b in blocks for _ in (0, 1)]
    return np.array(xs), np.maximum.accumulate(np.array(ys)) if ys else np.array(ys)


@dataclass
class Model:
    lexicon: Lexicon
    forest: Forest | None
    knots: tuple[np.ndarray, np.ndarray]
    base: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.forest is None:
            return np.full(len(texts), self.base)
        raw = self.forest.raw(matrix(texts, self.lexicon))
        return np.clip(np.interp(raw, *self.knots), 0, 1) if len(self.knots[0]) else 1 / (1 + np.exp(-raw))


def fit(sample: DataFrame) -> Model:
    """Lexicon, trees and calibration of rows (text, toxic 0 or 1, fold), cross-fitted; a constant if one class is nearly missing.

    A row's features come from a lexicon learned on the other folds, and its score for the calibration from trees grown on
    the other folds, so neither is fitted to what it is used on.  The final lexicon is learned on all rows, the final
    trees are grown on all rows' features.  The driver receives numbers and lexicon words, no texts.
    """
    got = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    n, positive = got["n"], int(got["t"])
    base = (positive + 0.5) / (n + 1)
    if n < 60 or min(positive, n - positive) < 2 * FOLDS:
        return Model(Lexicon(frozenset(), frozenset()), None, (np.zeros(0), np.zeros(0)), base)
    lexicons = learn_lexicons(sample, max(2, min(6, positive // 40)))
    shared = sample.sparkSession.sparkContext.broadcast(lexicons)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts, folds = b.column(0).to_pylist(), b.column(2).to_pylist()
            x = [features(t, shared.value[f]) for t, f in zip(texts, folds, strict=True)]
            yield pa.record_batch([b.column(1), b.column(2), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "fold", "x"])

    rows = sample.select("text", "toxic", "fold").mapInArrow(run, schema("toxic int, fold int, x array<double>")).toArrow()
    x = np.array(rows.column(2).to_pylist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort([*x.T, rows.column(0).to_numpy()])  # rows come in any order; the fit must not depend on it
    x, y, fold = x[order], rows.column(0).to_numpy()[order].astype(float), rows.column(1).to_numpy()[order]
    raw = np.zeros(len(y))
    for k in range(FOLDS):
        if (fold == k).any():
            raw[fold == k] = boost(x[fold != k], y[fold != k]).raw(x[fold == k])
    return Model(lexicons[-1], boost(x, y), isotonic(raw, y), base)


def fit_from(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most 1.25 * ``rows`` labelled documents of those whose crc32(doc_id) mod 5 is not 0.

    Rows with a null label or id are no examples; of several labels of a document the largest counts, of equal ids the
    smallest text.  Ids may be of any type.
    """
    taught = labels.where(F.col("toxic").isNotNull() & (F.pmod(id_crc(), F.lit(5)) != 0)).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = bounded_sample(taught, "doc_id", rows)  # bounded by rows, so its ids may be broadcast
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = settle(found.select("text", "toxic", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")))
    model = fit(sample)
    release(sample)
    return model


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, score and predicted (score >= 0.5) of every row.

    Null and empty texts get the score of an all-zero feature row; null keys stay null, repeated keys give repeated
    rows, an empty table none; further columns are ignored, whatever their names; without labelled rows every score is
    the same base rate.  The broadcast model is bounded by SAMPLE_ROWS.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            s = shared.value.score(b.column(1).to_pylist())
            yield pa.record_batch([b.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype("int32"), pa.int32())], names=["_key", "score", "predicted"])

    source = bounded_batches(docs).select(docs[key].alias("_key"), docs[text].cast("string").alias("_text"))
    return source.mapInArrow(run, schema(f"_key {source.schema[0].dataType.simpleString()}, score double, predicted int")).withColumnRenamed("_key", key)


def keep_civil(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, columns as they were.

    Null and empty texts score as in ``score_documents``; null ids, repeated rows and further columns change nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield b.filter(pa.array(shared.value.score(b.column(at).to_pylist()) < limit, pa.bool_()))

    return bounded_batches(docs).mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score_documents(docs, fit_from(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(F.pmod(id_crc(), F.lit(5)) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
