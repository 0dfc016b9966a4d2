"""The pipeline's stages against plain loops, each on its own input."""

import re

import duckdb
import pytest

import corpus_pipeline
from martflow.llm.common import stored, table
from martflow.llm.oracles import ORACLES
from tests.llm import brute


@pytest.fixture(scope="module")
def results(spark, small):
    docs, out = table(spark, small, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, small), "test-stage")
        out.append((name, docs))
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(results, spark, small):
    own = table(spark, small, "documents")
    for _, df in results[:-1]:
        assert df.dtypes == own.dtypes


def test_quality(results, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = {i for i, kept in con.execute(f"SELECT doc_id, kept FROM ({ORACLES['op2_host_rules']})").fetchall() if kept}
    assert {i for i, _ in texts(results[0][1])} == want


def test_near_duplicates(results):
    before, after = texts(results[0][1]), texts(results[1][1])
    assert {i for i, _ in after} == {i for i, _, _, kept in brute.op3(before, 5) if kept}


def test_decontamination(results, rows_of):
    items = rows_of("benchmark", "item_id", "text")
    before, after = texts(results[1][1]), texts(results[2][1])
    assert {i for i, _ in after} == {i for i, t in before if not brute.holds_item(t, items)}


def test_personal_data(results):
    before, after = dict(texts(results[2][1])), dict(texts(results[3][1]))
    assert before.keys() == after.keys()
    rows = brute.op8_base(list(before.items()))
    for i, *counts, _ in rows:
        if any(counts):
            assert before[i] != after[i] and not any(brute.op8_base([(i, after[i])])[0][1:5])
        elif not re.search("[0-9]", before[i]):
            assert before[i] == after[i]


def test_tokens(results):
    want = {r[0]: r[1:3] for r in brute.op7(texts(results[3][1]))}
    rows = results[4][1].collect()
    assert {r.doc_id: (r.n_tokens, brute.digest(" ".join(map(str, r.ids)))) for r in rows} == want
    assert all(r.round_trip for r in rows)


def test_run(results, spark, small):
    assert corpus_pipeline.run(spark, small).count() == results[4][1].count()
    assert corpus_pipeline.ORACLE_SQL is None
