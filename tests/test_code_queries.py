import pytest
from conftest import DATA

from lintel.plans import code_queries, engine


@pytest.mark.parametrize("name", code_queries.QUERIES)
def test_rows(spark, name):
    assert code_queries.QUERIES[name](spark, DATA).count() > 0


def test_flows_of_the_templates(spark):
    got = {(r["type"], r["n"]) for r in code_queries.code_flows(spark, DATA).groupBy("type").count().withColumnRenamed("count", "n").collect()}
    assert got == {("SQL Injection", 50), ("OS Command Injection", 25), ("Open Redirect", 25)}


def test_every_applied_fix_is_gone(spark):
    rows = code_queries.fix_verify(spark, DATA).groupBy("status").count().collect()
    assert {r["status"] for r in rows} >= {"applied"}


@pytest.mark.parametrize("name", ["code_units", "code_flows"])
def test_files_of_a_small_table_are_dealt_over_all_cores(spark, name):
    assert code_queries.QUERIES[name](spark, DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_scan_reads_its_files_in_parts(spark):
    files, found = engine.parsed(code_queries.code_files(spark, DATA))
    assert len(files.inputFiles()) > 1 and len(found.inputFiles()) > 1
    assert files.count() == code_queries.code_files(spark, DATA).count()
