"""The registered queries: against their SQL where there is one, and the whole pipeline."""

from collections import Counter

import pytest

import corpus_pipeline
from riskloom.llm import oracle, queries
from verification.compare import connect, rows

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(oracle.all_sql()))
def test_query_equals_sql(spark, name):
    df = queries.all_queries()[name](spark, DIR)
    con = connect(DIR)
    cursor = con.execute(oracle.all_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    mine, theirs = rows(df.columns, df.collect()), rows(names, cursor.fetchall())
    assert not mine - theirs and not theirs - mine


def test_native_queries_run_no_python(spark):
    for name in ("op1_decontamination", "op2_url_filter", "op9_secret_scan"):
        plan = queries.all_queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
        assert not [w for w in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop") if w in plan]


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.all_queries()) == list(range(1, 14))


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    columns, left = docs.columns, set(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, DIR), name)
        kept = {r["doc_id"] for r in docs.collect()}
        assert docs.columns == columns and kept <= left
        left = kept
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DIR).collect()
    assert {r["doc_id"] for r in pieces} == left and 0.5 * len(texts) < len(left) < len(texts)
    tokens = Counter()
    for r in pieces:
        tokens[r["doc_id"]] += r["length"]
    assert all(r["doc_tokens"] == tokens[r["doc_id"]] for r in pieces)
