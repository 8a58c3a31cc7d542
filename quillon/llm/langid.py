"""Language identification by language-bitmask n-gram filters (operator 3).

Training puts the byte n-grams that are typical of a language into that language's Bloom filter.  The filters of all
languages are bit-sliced: one array whose cell holds a bit per language, so the AND of an n-gram's cells is the set of
languages that contain it.  A text's per-language popcounts, less the hits expected from false positives, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, bounded_sample, byte_view, id_crc, release, schema, settle, slices, table

#: Labelled rows that the filters are fitted on: a bounded, hash-chosen sample, the same number of each language as far
#: as there are so many (prediction covers every text).
SAMPLE_ROWS = 6000
GRAM, SLOTS, HASHES = 4, 1 << 21, 2
#: An n-gram enters a language's filter if seen so often there (once or twice where a language has under ROWS_A_SIGHT or
#: twice as many texts), and at this share of its highest relative frequency.
LEAST_SEEN, ROWS_A_SIGHT, LEAST_SHARE = 3, 50, 0.34
UNDETERMINED = "und"
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@dataclass
class Model:
    """The languages, more texts first; cells[w, slot] holds the bits of languages 64 w to 64 w + 63 (8 if there are no more)."""

    languages: list[str]
    cells: np.ndarray
    false_rates: np.ndarray


def _fold(raw: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case, all other ASCII as blanks."""
    keep = np.full(256, 32, np.uint8)
    keep[97:123] = keep[65:91] = np.arange(97, 123)
    keep[128:] = np.arange(128, 256)
    low = keep[raw]
    if len(raw) > 1:
        upper = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        low[1:][upper] += 0x20
    return low


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the byte n-grams of rows laid end to end, runs of blanks as one; their rows' new offsets.

    A gram that would run over its row's end is left out, so no gram mixes two rows.
    """
    low = _fold(raw)
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    starts = offsets[:-1][offsets[:-1] < len(low)]
    keep[starts] = True
    upto = np.concatenate([[0], np.cumsum(keep)])
    low, offsets = low[keep].astype(np.uint32), upto[offsets]
    n = max(0, len(low) - GRAM + 1)
    codes = np.zeros(n, np.uint32)
    for k in range(GRAM):
        codes |= low[k : k + n] << np.uint32(8 * k)
    whole = np.ones(n, bool)
    for k in range(1, GRAM):
        at = offsets[1:-1] - k
        whole[at[(at >= 0) & (at < n)]] = False
    upto = np.concatenate([[0], np.cumsum(whole)])
    return codes[whole], upto[np.minimum(offsets, n)]


def _cells_of(codes: np.ndarray) -> list[np.ndarray]:
    shift = np.uint64(64 - SLOTS.bit_length() + 1)
    wide = codes.astype(np.uint64)
    return [((wide * m) >> shift).astype(np.int64) for m in _MULTIPLIERS[:HASHES]]


def _gram_counts(taught: DataFrame) -> DataFrame:
    """(bit, code, n): how often each n-gram occurs in the texts of each language; taught has text and bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            codes, offsets = grams(*byte_view(b.column(0)))
            bits = np.repeat(b.column(1).to_numpy(), np.diff(offsets)).astype(np.uint64)
            both, n = np.unique(bits << np.uint64(32) | codes.astype(np.uint64), return_counts=True)
            yield pa.record_batch([pa.array((both >> np.uint64(32)).astype(np.int32)), pa.array((both & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n.astype(np.int64))], names=["bit", "code", "n"])

    return bounded_batches(taught).select("text", "bit").mapInArrow(run, schema("bit int, code bigint, n bigint")).groupBy("bit", "code").agg(F.sum("n").alias("n"))


def fit(taught: DataFrame, order: list[tuple[str, int]]) -> Model:
    """Filters from texts (text, lang); ``order`` has the languages and their numbers of texts, the tie-break's order.

    N-grams are counted and chosen on the executors; the driver receives filled cells, at most SLOTS for 64 languages.
    """
    spark, many = taught.sparkSession, len(order)
    kind = np.uint8 if many <= 8 else np.uint64
    cells = np.zeros((max(1, -(-many // 64)), SLOTS), kind)
    if many:
        names = spark.createDataFrame([(name, bit, min(LEAST_SEEN, 1 + n // ROWS_A_SIGHT)) for bit, (name, n) in enumerate(order)], "lang string, bit int, least int")
        counts = settle(_gram_counts(taught.join(F.broadcast(names), "lang")))
        share = F.col("n") / F.col("total")
        counts_of = counts.join(F.broadcast(counts.groupBy("bit").agg(F.sum("n").alias("total"))), "bit").join(F.broadcast(names.select("bit", "least")), "bit").withColumn("share", share)
        chosen = counts_of.join(counts_of.groupBy("code").agg(F.max("share").alias("top")), "code").where((F.col("n") >= F.col("least")) & (F.col("share") >= LEAST_SHARE * F.col("top"))).select("bit", "code")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bits, codes = b.column(0).to_numpy().astype(np.int64), b.column(1).to_numpy().astype(np.uint32)
                mask = (np.uint64(1) << (bits % 64).astype(np.uint64)).view(np.int64)
                for at in _cells_of(codes):
                    yield pa.record_batch([pa.array(bits // 64), pa.array(at), pa.array(mask)], names=["word", "slot", "mask"])

        got = chosen.mapInArrow(run, schema("word bigint, slot bigint, mask bigint")).groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
        release(counts)
        cells[got.column(0).to_numpy(), got.column(1).to_numpy()] = got.column(2).to_numpy().view(np.uint64).astype(kind)
    fill = np.array([(cells[b // 64] >> kind(b % 64) & kind(1)).mean() for b in range(many)])
    return Model([name for name, _ in order], cells, fill**HASHES)


def predict(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    n, many = len(texts), len(model.languages)
    has_letter = np.array([bool(x) and any(map(str.isalpha, x)) for x in texts.to_pylist()], bool)
    if not many or not n:
        return [UNDETERMINED] * n, np.zeros(n)
    codes, offsets = grams(*byte_view(texts))
    slots, kind = _cells_of(codes), model.cells.dtype.type
    total = np.diff(offsets).astype(float)
    hits = np.zeros((many, n))
    for word, cells in enumerate(model.cells):
        held = np.full(len(codes), ~kind(0), kind)
        for at in slots:
            held &= cells[at]
        for bit in range(64 * word, min(many, 64 * word + 64)):
            upto = np.concatenate([[0], np.cumsum((held >> kind(bit % 64)) & kind(1), dtype=np.int64)])
            hits[bit] = upto[offsets[1:]] - upto[offsets[:-1]]
    rate = model.false_rates[:, None]
    hits = np.clip((hits - rate * total) / np.maximum(1e-9, 1 - rate), 0, None)
    best = hits.argmax(0)
    first = hits[best, np.arange(n)]
    rest = hits.copy()
    rest[best, np.arange(n)] = 0
    second = rest.max(0) if many > 1 else np.zeros(n)
    score = np.where(has_letter, first / np.maximum(1e-9, first + second), 0.0)
    return [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, has_letter, strict=True)], np.clip(score, 0, 1)


def fit_from(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most 1.25 * ``rows`` rows with a language, of those whose crc32(doc_id) mod 3 is not 1.

    Rows with a null text or language teach nothing; rows that repeat count as often as they stand there.
    """
    taught = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    taught = taught.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(F.pmod(id_crc(), F.lit(3)) != 1, F.lit(True)))
    order = sorted(((r["lang"], r["count"]) for r in taught.groupBy("lang").count().collect()), key=lambda x: (-x[1], x[0]))  # one row a language
    return fit(settle(bounded_sample(taught, "doc_id", rows, "lang").select("text", "lang")), order)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, lang_pred and score of every row.

    Null, empty and letterless texts (no character of a letter category) give ``und`` with score 0; with no labelled row at all every text does.  Ties go
    to the language with more labelled rows.  Null keys stay null, repeated keys give repeated rows, an empty table
    none; further columns are ignored, whatever their names.  The broadcast model has SLOTS cells for each 64 languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            names, scores = predict(shared.value, b.column(1))
            yield pa.record_batch([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["_key", "lang_pred", "score"])

    source = bounded_batches(docs).select(docs[key].alias("_key"), docs[text].cast("string").alias("_text"))
    return source.mapInArrow(run, schema(f"_key {source.schema[0].dataType.simpleString()}, lang_pred string, score double")).withColumnRenamed("_key", key)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text has a determined language with a score of at least ``least``, columns as they were.

    Rows with null, empty or letterless texts go; null ids, repeated rows and further columns change nothing.
    """
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found, scores = predict(shared.value, b.column(at))
            yield b.filter(pa.array([x != UNDETERMINED and s >= least for x, s in zip(found, scores, strict=True)], pa.bool_()))

    return bounded_batches(docs).mapInArrow(run, docs.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit_from(docs))
    return found.select("doc_id", F.coalesce(F.pmod(id_crc(), F.lit(3)) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
