"""Inputs made from keys against the texts of their views, on rows of the tests' own."""

import random
import re

import pytest
from pyspark.sql import functions as F

from riskloom.operators import assessments
from verification import bindings


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with null and unknown keys, and rows that come twice."""
    rng, d = random.Random(3), tmp_path_factory.mktemp("tables")
    keys = [*range(1, 25), None]
    tables = {
        "part": ("p_partkey long, p_size int", [(k, rng.choice([None, 3, 17])) for k in keys for _ in range(rng.choice([1, 1, 2]))]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, day string", [
            (k, rng.choice([None, 5, 6]), None, rng.choice([None, "2001-05-06"])) for k in keys for _ in range(rng.choice([1, 1, 2]))]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string", [
            (rng.choice([*keys, 99]), rng.choice([*keys, 98]), rng.choice([*keys, 97]), rng.choice([None, 1, 2, 3]),
             rng.choice([None, 4.0, 9.0]), rng.choice([None, "R", "A"])) for _ in range(600)]),
    }
    for name, (schema, rows) in tables.items():
        df = spark.createDataFrame(rows, schema)
        if name == "orders":
            df = df.withColumn("o_orderdate", F.col("day").cast("timestamp_ntz")).drop("day")
        df.coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return str(d)


@pytest.mark.parametrize("name", sorted(bindings.BUILT))
def test_inputs_from_keys(spark, folder, name):
    built, written = bindings.view(spark, folder, name), bindings.written_view(spark, folder, name)
    assert built.schema.simpleString() == written.schema.simpleString()
    assert built.count() > 50
    assert built.exceptAll(written).count() == written.exceptAll(built).count() == 0


def test_commits_are_grouped_by_numbers(spark, folder):
    """No task sorts the lines of a piece of the file by names before they are dealt out."""
    plan = bindings.view(spark, folder, "fx_commit_files")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    assert not re.search(r"HashAggregate\(keys=\[[^]]*(stem|path)", plan)


def test_responses_are_dealt_out_before_they_are_parsed(spark, tmp_path):
    spark.createDataFrame([(f"h{i}", '{"security_impact": 1}' if i % 2 else "none") for i in range(20)], "content_hash string, text string") \
        .coalesce(1).write.parquet(f"{tmp_path}/r")
    read = assessments.accepted(assessments.parse_responses(spark.read.parquet(f"{tmp_path}/r")))
    plan = read._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning(content_hash"):] if "Exchange" in plan else plan
    dealt = plan.rindex("REPARTITION_BY_NUM")
    assert "from_json" not in plan[dealt:] and "from_json" in plan[:dealt], below
    assert sorted(r["content_hash"] for r in read.collect()) == sorted(f"h{i}" for i in range(1, 20, 2))
