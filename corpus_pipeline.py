"""A corpus pipeline of five stages over ``documents``, each calling one operator of ``quillon.llm``.

Each stage takes what its predecessor kept, written as Parquet and read again, and all but the last return the columns
of ``documents``.  In every stage rows may repeat, ids may be null, texts may be null, empty or very long and further columns
may have any names: they pass through unchanged (the last stage leaves them out), and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontaminate, langid, neardup, tokens, toxicity
from quillon.llm.common import scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a determined language; null, empty and letterless texts go, repeated rows all stay or go."""
    return langid.keep_identified(docs, langid.fit_from(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; equal texts score alike, whatever their ids."""
    return toxicity.keep_civil(docs, toxicity.fit_from(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the smallest doc_id of each group of near duplicates.

    Rows that repeat an id stay or go together; rows with a null id, and texts without words, stay.
    """
    return neardup.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; null texts hold none and stay, as do all without items."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text; a null text counts as empty."""
    return tokens.encode_digests(docs)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: No SQL: learned models and a tokenizer are no SQL expressions; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(at := f"{base}/{k}_{name}")
        docs = spark.read.parquet(at)
    return docs
