"""Streaks, heartbeats and percentiles cut by time or value, against plain loops over whole keys."""

import datetime as dt
import math
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import metrics, runs

START = dt.datetime(2024, 1, 1)


def log_of(spark, seed, n=600, keys="aab", hours=200):
    """Rows with ties in time, bursts, long gaps and a key of most rows."""
    rng = random.Random(seed)
    rows = [(rng.choice(keys), START + dt.timedelta(seconds=rng.choice((1, 60, 3600)) * rng.randrange(hours)), i, rng.choice(("bad", "bad", "bad", "good", "skip")) if rng.random() < 0.5 else "bad") for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, ts timestamp, id long, what string")


@pytest.mark.parametrize("seconds", [1, 3600, 10 ** 7])
def test_streaks_over_slices(spark, seconds):
    rows, df = log_of(spark, 3)
    rows += [("c", START, -1, "skip"), ("d", START, -2, "good"), ("d", START + dt.timedelta(days=9), -3, "bad")]
    df = spark.createDataFrame(rows, df.schema)
    args = ("k", ["ts", "id"], F.col("what") == "bad", F.col("what") == "skip", seconds)
    want, longest = {}, {}
    for key in "abcd":
        n = 0
        for _, _, i, what in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            n = n + 1 if what == "bad" else n if what == "skip" else 0
            want[i] = n
            longest[key] = max(n, longest.get(key, 0))
    assert {r["id"]: r["streak"] for r in runs.streaks(df, *args).collect()} == want
    assert {r["k"]: r["longest"] for r in runs.longest_streak(df, *args).collect()} == longest


@pytest.mark.parametrize(("seconds", "block"), [(60, 60), (60, 61), (60, 7200), (3000, None), (1, 1)])
def test_heartbeats_over_blocks(spark, seconds, block):
    rows, df = log_of(spark, 4)
    # times a block's end apart, before 1970 and at the very border
    rows += [("x", START + dt.timedelta(seconds=s), 0, "bad") for s in (0, 59, 60, 119, 120, 180)] + [("y", dt.datetime(1969, 12, 31, 23, 59, s), 0, "bad") for s in (1, 2, 59)] + [("y", dt.datetime(1970, 1, 1, 0, 1), 0, "bad"), (None, START, 0, "bad"), ("z", None, 0, "bad")]
    df = spark.createDataFrame(rows, df.schema)
    want = []
    for key in "abxy":
        last = None
        for t in sorted(r[1] for r in rows if r[0] == key):
            if last is None or t - last >= dt.timedelta(seconds=seconds):
                want.append((key, t))
                last = t
    assert sorted((r["k"], r["at"]) for r in runs.heartbeats(df, "k", "ts", seconds, block).collect()) == sorted(want)


def test_a_blocks_exits_are_those_of_the_chain():
    rng = np.random.default_rng(5)
    for n in (1, 2, 50, 400):
        times = np.sort(rng.integers(0, 1000, n))
        enter, leave = runs.chain_exits(times, 30, 60)
        for t in range(-5, 61):
            taken = runs.chain_rows(times, 30, t)
            i = np.searchsorted(enter, t)
            assert (times[taken[-1]] if len(taken) else None) == (leave[i] if i < len(enter) else None)


def plain_rank(values, q):
    return sorted(values)[max(1, math.ceil(len(values) * q - 1e-9)) - 1]


@pytest.mark.parametrize("q", [0.0, 0.01, 0.5, 0.9, 0.999, 1.0])
def test_nearest_rank_of_odd_groups(spark, q):
    rng = random.Random(6)
    groups = {
        "tail": [rng.lognormvariate(0, 8) for _ in range(3000)] + [1e15, -1e300, 1e300], "same": [4.0] * 2500, "third": [7.0] * 1000 + [rng.random() for _ in range(2000)],
        "one": [3.0], "two": [2.0, 1.0] * 700, "close": [1e15 + i % 7 for i in range(2000)], "nan": [float("nan")] * 3, None: [rng.gauss(0, 1) for _ in range(1500)]}
    rows = [(g, v) for g, vs in groups.items() for v in [*vs, None]]
    rng.shuffle(rows)
    got = {r["place"]: r["inside"] for r in metrics.nearest_rank(spark.createDataFrame(rows, "place string, inside double"), "inside", q, ["place"], 60).collect()}
    want = {g: plain_rank(v, q) for g, v in groups.items()}
    assert set(got) == set(want) and all(got[g] == want[g] or g == "nan" and math.isnan(got[g]) for g in want)


def test_nearest_rank_of_all_and_of_other_types(spark):
    rows = [(i, Decimal(i * 37 % 1009) / 7, 2 ** 60 + i * 37 % 1009) for i in range(1009)]
    df = spark.createDataFrame(rows, "i int, d decimal(12,4), l long")
    assert metrics.nearest_rank(df, "l", 0.25, [], 50).collect()[0]["l"] == plain_rank([r[2] for r in rows], 0.25)
    assert metrics.nearest_rank(df, "d", 0.25, [], 50).collect()[0]["d"] == df.select("d").orderBy("d").collect()[math.ceil(1009 * 0.25) - 1]["d"]
    assert metrics.nearest_rank(df.limit(0), "l", 0.5, ["i"]).count() == 0


def test_heartbeats_go_through_blocks_in_batches(spark):
    """Blocks that go over several batches, and batches of many blocks, give the rows of a plain walk; no call to Python for each block."""
    import random

    from pyspark.sql import functions as F

    from tidepool.operators import runs

    rng = random.Random(2)
    log = [(rng.choice("abcde"), rng.randrange(40_000)) for _ in range(900)]
    want, last = set(), {}
    for k, t in sorted(log):
        if k not in last or t - last[k] >= 300:
            last[k] = t
            want.add((k, t))
    df = spark.createDataFrame(log, "k string, t long").withColumn("at", F.timestamp_seconds("t"))
    out = runs.heartbeats(df, "k", "at", 300, 1200)
    assert "FlatMapGroups" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "FlatMapCoGroups" not in plan
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = [(r[0], r[1]) for r in out.select("k", F.unix_seconds("at")).collect()]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(got) == len(set(got)) and set(got) == want
