"""Every table query against its SQL twin, on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract

SF = os.environ.get("PLUMELINE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return float(f"{float(v):.12g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    result = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    want = [tuple(plain(x) for x in row) for row in result.fetchall()]
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_query_runs(spark, name):
    assert contract.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() == 720


def test_heavy_work_on_table_rows_is_spread(spark):
    """A table may be one row group: parsing starts behind a shuffle, and no filter takes it ahead of that."""
    from plumeline.plans import log_tables, table_queries

    sf = "/root/testdata/sf0.001"
    plan = table_queries.name_cleanup(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(p_partkey" in plan
    for query in (log_tables.syslog_events, log_tables.text_log_events, log_tables.json_log_events, log_tables.log_rejects):
        files = query(spark, sf).inputFiles()
        assert files and all("/spread-" in f for f in files), query.__name__


def test_stored_commands_are_parsed_once(spark):
    from plumeline.plans import log_tables

    sf = "/root/testdata/sf0.001"
    for query, name in ((log_tables.normalise_commands, "/commands-"), (log_tables.normalise_updates, "/updates-")):
        files = query(spark, sf).inputFiles()
        assert files and all(name in f for f in files), query.__name__


def test_brackets_are_counted_run_by_run(spark):
    from pyspark.sql import functions as F

    from plumeline.functions import text as tx

    row = spark.range(1).select(F.lit("ab" * 500 + "<x<y>z>c>d<e").alias("t"))
    assert row.select(F.size(tx._runs(F.col("t"), "<", ">"))).first()[0] == 13
    got = row.select(tx.strip_nested(F.col("t"), "<", ">", "R"), tx.outer_groups(F.col("t"), "<", ">")).first()
    assert got[0] == "ab" * 500 + "Rce" and got[1] == ["<x<y>z>"]
    assert row.select(tx.strip_nested(F.lit("a[b[c]]\\d"), "[", "]")).first()[0] == "a\\d"
