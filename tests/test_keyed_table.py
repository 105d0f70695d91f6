"""The keyed table: replays, failures before the swap, two writers, buckets that stay, restarts of a stream."""

import uuid

import pytest
from pyspark.sql import functions as F

from tidepool.sources.keyed_table import KeyedTable, StaleManifest
from tidepool.streaming import streams

SCHEMA = "k long, g string, v double"


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "t"), ["k"], spark.createDataFrame([], SCHEMA).schema, 4)


def held(t, version=None):
    return sorted(tuple(r) for r in t.rows(version).collect())


def test_batches_replays_and_counts(spark, table):
    assert held(table) == []
    df = lambda *rows: spark.createDataFrame(rows, SCHEMA)
    assert table.upsert(df((1, "a", 1.0), (2, "b", 2.0), (2, "b", 2.0)), 0) == {"inserted": 2, "updated": 0, "unchanged": 0}
    assert table.upsert(df((2, "c", 3.0), (3, None, None), (1, "a", 1.0)), 1) == {"inserted": 1, "updated": 1, "unchanged": 1}
    after = held(table) if True else None
    assert after == [(1, "a", 1.0), (2, "c", 3.0), (3, None, None)]
    # what came before comes again, and does nothing; another writer's numbers are its own
    assert table.upsert(df((9, "z", 9.0)), 1) == {"inserted": 1, "updated": 1, "unchanged": 1} and held(table) == after
    assert table.upsert(df((9, "z", 9.0)), 0) and held(table) == after
    assert table.upsert(df((9, "z", 9.0)), 0, "other") == {"inserted": 1, "updated": 0, "unchanged": 0}
    assert table.upsert(df(), 2) == {"inserted": 0, "updated": 0, "unchanged": 0}
    assert held(table, 1) == [(1, "a", 1.0), (2, "b", 2.0)]


def test_which_row_of_a_key_counts_and_what_is_kept(spark, table):
    df = lambda *rows: spark.createDataFrame(rows, SCHEMA)
    table.upsert(df((1, "a", 1.0), (1, "b", 5.0), (1, "c", 3.0)), 0, order=[F.desc("v")])
    assert held(table) == [(1, "b", 5.0)]
    table.upsert(df((1, "x", 4.0), (2, "y", 1.0)), 1, when=F.col("new_v") > F.col("old_v"))
    assert held(table) == [(1, "b", 5.0), (2, "y", 1.0)]
    table.upsert(df((1, "x", 6.0), (2, "x", None)), 2, keep=("g",))
    assert held(table) == [(1, "b", 6.0), (2, "y", None)]
    assert table.upsert(df((1, "q", 0.0), (4, "q", 0.0)), 3, ignore=True) == {"inserted": 1, "updated": 0, "unchanged": 1}
    assert held(table) == [(1, "b", 6.0), (2, "y", None), (4, "q", 0.0)]


def test_only_touched_buckets_are_rewritten(spark, table):
    table.upsert(spark.range(200).select(F.col("id").alias("k"), F.lit("a").alias("g"), F.lit(1.0).alias("v")), 0)
    before = table.manifest().parts
    assert len(before) == 4
    table.upsert(spark.createDataFrame([(7, "b", 2.0)], SCHEMA), 1)
    after = table.manifest().parts
    assert sum(before[b] != after[b] for b in before) == 1
    assert table.rows().count() == 200 and table.rows().where("g = 'b'").count() == 1


def test_a_failure_before_the_swap_changes_nothing(spark, table, monkeypatch):
    table.upsert(spark.createDataFrame([(1, "a", 1.0)], SCHEMA), 0)
    batch = spark.createDataFrame([(1, "b", 2.0), (2, "b", 2.0)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(table, "_put", lambda _: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            table.upsert(batch, 1)
    assert held(table) == [(1, "a", 1.0)]
    assert table.upsert(batch, 1) == {"inserted": 1, "updated": 1, "unchanged": 0}
    with pytest.raises(Exception, match="is null"):
        table.upsert(spark.createDataFrame([(None, "x", 1.0)], SCHEMA), 2)
    assert held(table) == [(1, "b", 2.0), (2, "b", 2.0)]


def test_a_second_writer_is_refused(spark, table):
    other = KeyedTable(spark, table.path)
    seen = other.manifest()
    table.upsert(spark.createDataFrame([(1, "a", 1.0)], SCHEMA), 0)
    seen.version += 1
    with pytest.raises(StaleManifest):
        other._put(seen)
    assert held(other) == [(1, "a", 1.0)]
    with pytest.raises(FileNotFoundError):
        KeyedTable(spark, table.path + "-none")


def test_clearing_keeps_the_latest_versions(spark, table):
    for i in range(5):
        table.upsert(spark.createDataFrame([(1, "a", float(i))], SCHEMA), i)
    assert table.clear(2) == 3
    assert held(table) == [(1, "a", 4.0)] and held(table, 4) == [(1, "a", 3.0)] and table.versions() == [4, 5]


def test_a_stream_that_starts_again_adds_nothing_twice(spark, tmp_path):
    schema = "k long, g string, v double, ts timestamp"
    rows = spark.range(40).select("id", F.lit("a").alias("g"), F.lit(1.0).alias("v"), F.timestamp_seconds("id").alias("ts")).withColumnRenamed("id", "k")
    rows.repartition(4).write.parquet(str(tmp_path / "in.parquet"))
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], spark.createDataFrame([], SCHEMA).schema, 4)
    calls = []
    write = table.batch_writer("s")

    def fails_once(batch, batch_id):
        write(batch, batch_id)
        calls.append(batch_id)
        if len(calls) == 2:
            raise RuntimeError("after the swap")

    source = spark.read.parquet(str(tmp_path / "in.parquet"))
    assert source.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    state = str(tmp_path / uuid.uuid4().hex)
    with pytest.raises(Exception, match="after the swap"):
        streams.run_batches(source, fails_once, state, name="in.parquet", maxFilesPerTrigger=1)
    streams.run_batches(source, fails_once, state, name="in.parquet", maxFilesPerTrigger=1)
    assert calls[1] == calls[2] and held(table) == [(i, "a", 1.0) for i in range(40)]
    assert table.manifest().version == 4
