"""Every registered query against its SQL on whole small tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, difference
from tidepool.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, data, con, name):
    assert difference(QUERIES[name](spark, data), con, ORACLE_SQL[name]) in ("", "no rows")


def test_value_columns_with_waits_that_are_not_positive(spark, data, con, tmp_path):
    """Waits of 0, negative ones and nulls of every sixth row stand as in the SQL."""
    rows = spark.read.parquet(f"{data}/events.parquet").withColumn("value", F.when(F.col("event_id") % 18 == 0, 0.0).when(F.col("event_id") % 18 == 6, F.when(F.col("event_id") % 36 == 6, -2.5)).otherwise(F.col("value")))
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    other = duckdb.connect()
    other.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert difference(QUERIES["value_columns"](spark, str(tmp_path)), other, ORACLE_SQL["value_columns"]) == ""


@pytest.mark.parametrize("name", ["cluster_groups", "cluster_decisions"])
def test_clustering_deals_films_into_tasks_by_their_number(spark, data, con, monkeypatch, name):
    """A task holds about so many films, however many there are: the tasks grow with the table, the rows stay the same."""
    from tidepool.operators import decisions

    monkeypatch.setattr(decisions, "FILMS", 50)
    films = con.sql("SELECT count(DISTINCT o_orderkey) FROM orders SEMI JOIN lineitem ON l_orderkey = o_orderkey").fetchall()[0][0]
    out = QUERIES[name](spark, data)
    assert f", {-(-films // 50)}), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString() and films > 1000
    assert difference(out, con, ORACLE_SQL[name]) == ""
