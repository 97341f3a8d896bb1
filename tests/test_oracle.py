"""Every registered query against its SQL on the smallest given tables."""

import pytest

import __spark_entry__
from verification import queries as registered
from verification.bindings import staged_view
from verification.compare import connect, differences
from verification.oracle import all_sql
from riskloom.sources.staging import stage

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = connect(DIR)
    yield connection
    connection.close()


@pytest.fixture(scope="module", autouse=True)
def tables():
    """Inputs and scored tables are written once, as tables are in use."""
    known = {}

    def saved(inputs, name, build):
        if name not in known:
            known[name] = stage(build(), name)
        return known[name]

    patch = pytest.MonkeyPatch()
    patch.setattr(registered.Inputs, "bind", staticmethod(staged_view))
    patch.setattr(registered.Inputs, "saved", saved)
    yield
    patch.undo()


@pytest.mark.parametrize("name", list(registered.all_queries()))
def test_query(spark, con, name):
    _, extra, missing, _ = differences(spark, con, name, DIR)
    assert not extra and not missing


def test_every_query_has_sql():
    assert set(registered.all_queries()) == set(all_sql())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "tier" in df.columns


def test_merge_reads_every_assessment(spark):
    every = registered.all_queries()["assessments"](spark, DIR).select("content_hash")
    merged = registered.all_queries()["assessment_merge_whole"](spark, DIR).select("content_hash")
    assert not every.exceptAll(merged).count() and not merged.exceptAll(every).count()
    assert registered.all_queries()["assessment_merge"](spark, DIR).count() < every.count()
