"""The corpus pipeline stage by stage, and the SQL of this subpackage's queries."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import corpus_pipeline as P  # noqa: E402
from oracle import compare, connect  # noqa: E402
from test_operators import brute_groups  # noqa: E402

from quillon.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in P.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), docs.schema)
        after = {r["doc_id"] for r in kept.collect()}
        assert kept.columns == columns and after <= set(before) and len(after) > 0.6 * len(before), name
        if name == "near_dedup":
            ids = sorted(before)
            groups = brute_groups([before[i] for i in ids])
            assert after == {ids[k] for k, (_, root, _) in groups.items() if root == k}
    last = P.STAGES[-1][1](spark, kept, SF)
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in kept.collect()}
    assert {r["doc_id"] for r in P.run(spark, SF).collect()} == {r["doc_id"] for r in kept.collect()}


def odd_documents(spark, rows):
    """Documents with null ids and texts, repeated rows, a very long text and columns of names used inside the operators."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _key int, _text string, id int, c int, root int, _maybe int, bucket string"
    return spark.createDataFrame([(i, t, "en", None, len(t or ""), 1, "x", 2, 3, 4, 5, "b") for i, t in rows], schema)


LONG = " ".join(f"word{k % 977} and number{k}" for k in range(30_000))
ROWS = [(1, "the quick brown fox jumps over the lazy dog again"), (1, "the quick brown fox jumps over the lazy dog again"), (2, "The quick brown fox jumps over the lazy dog again"), (None, "the quick brown fox jumps over the lazy dog again"), (None, None), (5, ""), (6, "123 !?"), (7, LONG), (8, LONG), (9, None)]


@pytest.fixture
def odd_folder(spark, tmp_path):
    odd_documents(spark, ROWS).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_stages_take_odd_rows(spark, odd_folder):
    docs = odd_documents(spark, ROWS)
    # What each stage leaves of the same rows, by (doc_id, start of the text).
    short = lambda df: sorted((r["doc_id"] or 0, (r["text"] or "-")[:3]) for r in df.collect())
    every = short(docs)
    lettered = sorted([(0, "the"), (1, "the"), (1, "the"), (2, "The"), (7, "wor"), (8, "wor")])
    want = {"language_id": lettered, "toxicity": every, "near_dedup": sorted(set(every) - {(2, "The"), (8, "wor")}), "decontamination": every}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, odd_folder)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        got = short(out)
        assert (sorted(set(got)) if name == "near_dedup" else got) == want[name], name
        assert stage(spark, docs.limit(0), odd_folder).count() == 0, name
    last = P.STAGES[-1][1](spark, docs, odd_folder)
    assert last.count() == len(ROWS) and P.STAGES[-1][1](spark, docs.limit(0), odd_folder).count() == 0


def test_run_takes_odd_rows_and_empty_tables(spark, odd_folder, tmp_path):
    kept = sorted(r["doc_id"] or 0 for r in P.run(spark, odd_folder).collect())
    assert kept == [0, 1, 1, 7]
    empty = tmp_path / "empty"
    odd_documents(spark, []).write.parquet(str(empty / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(empty / f"{name}.parquet"))
    assert P.run(spark, str(empty)).count() == 0


def test_run_equals_its_operators_one_by_one(spark):
    """The rows that are left, from the operators' decisions and brute force for near duplicates, without the stages."""
    from quillon.llm import decontaminate, langid, toxicity

    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    docs = read("documents")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = set(text)
    subset = lambda: docs.where(docs["doc_id"].isin(sorted(left)))
    left = {r["doc_id"] for r in langid.identify(subset(), langid.fit_from(docs)).collect() if r["lang_pred"] != "und" and r["score"] >= 0.5}
    left &= {r["doc_id"] for r in toxicity.score_documents(subset(), toxicity.fit_from(subset(), read("labels"))).collect() if not r["predicted"]}
    ids = sorted(left)
    left = {ids[k] for k, (_, root, _) in brute_groups([text[i] for i in ids]).items() if root == k}
    left -= {r["doc_id"] for r in decontaminate.find_contamination(subset(), read("benchmark")).collect()}
    assert {r["doc_id"] for r in P.run(spark, SF).collect()} == left


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    assert compare(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name]) == ""
