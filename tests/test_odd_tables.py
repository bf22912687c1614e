"""Queries against their SQL on small tables with odd rows."""

import duckdb
import pytest

from wireloom.functions.tables import dealt_by
from wireloom.jobs.registry import ORACLE_SQL, QUERIES
from wireloom.jobs.stand_ins import part_executables

from .conftest import SMALL, same_rows


def against_sql(spark, folder, query, **tables):
    """Whether the query's columns are those of its SQL, its rows and those of the SQL, over the tables (rows, schema)."""
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    return same_rows(QUERIES[query](spark, str(folder)), con, ORACLE_SQL[query])


def test_scripts_without_words(spark, tmp_path):
    texts = ["A.", "", None, "one", "two words", "a b c 1 2 3", "var x", "aa|bb'cc\\dd"]
    rows = [(i, texts[i // 3]) for i in range(3 * len(texts))]
    named, got, want = against_sql(spark, tmp_path, "deobfuscate", documents=(rows, "doc_id long, text string"))
    assert named and got == want


@pytest.mark.parametrize("name", ["gzip_objects", "continued_and_reopened", "client_of_frames", "chunked_bodies", "slice_block_whole", "deobfuscate_whole"])
def test_wide_rows_reach_python_a_few_at_a_time(spark, name):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    QUERIES[name](spark, SMALL)
    assert 0 < int(spark.conf.get(key)) <= 4 << 20


def test_parts_are_dealt_to_all_cores(spark):
    assert part_executables(spark, SMALL).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_more_rows_take_more_tasks(spark):
    rows = spark.range(0, 1000, 1, 2).selectExpr("id % 100 as k", "id")
    for n, least in ((1000, 4), (50, 20)):
        own = dealt_by(rows, ["k"], n)
        assert own.rdd.getNumPartitions() == least
        assert sorted(own.collect()) == sorted(rows.collect())


@pytest.mark.parametrize("name", ["reassemble", "reassemble_long", "stream_starts"])
def test_lines_are_dealt_by_their_number(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_scripts_are_made_once(spark):
    plan = QUERIES["deobfuscate"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1
