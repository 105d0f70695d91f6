"""Machines over keyed state: each deadline and tie, batches cut and mixed at will, and nothing left open for ever."""

import datetime as dt
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidepool.streaming import keyed, streams

DAY, HOUR = 86_400_000_000, 3_600_000_000


def told(machine, rows, mark):
    return keyed.advance(machine, rows, None, mark)


def test_a_held_story_is_confirmed_created_or_expires():
    m = keyed.Holds(14)
    out, _ = told(m, [[0, "story", 1], [14 * DAY, "change", 9]], 15 * DAY)
    assert out == [[1, "confirmed", 9, 14 * DAY]]
    out, state = told(m, [[0, "story", 1], [14 * DAY + 1, "change", 9]], 40 * DAY)
    assert out == [[1, "expired", None, 14 * DAY]] and state is None
    out, _ = told(m, [[0, "change", 9], [14 * DAY, "story", 1], [14 * DAY + 1, "story", 2]], 15 * DAY)
    assert out == [[1, "created", 9, 14 * DAY]]
    # a change at a story's own time goes first, and a later change counts from then on
    assert told(m, [[5, "story", 1], [5, "change", 7]], 6)[0] == [[1, "created", 7, 5]]
    assert told(m, [[5, "change", 7], [6, "change", 8], [7, "story", 1]], 8)[0] == [[1, "created", 8, 7]]
    # one change confirms all that waits, and what expires comes out in order
    out, state = told(m, [[0, "story", 1], [DAY, "story", 2], [2 * DAY, "change", 3]], 3 * DAY)
    assert [x[:3] for x in out] == [[1, "confirmed", 3], [2, "confirmed", 3]] and state == ([], [3, 2 * DAY])
    assert [x[0] for x in told(m, [[DAY, "story", 2], [0, "story", 1]], 99 * DAY)[0]] == [1, 2]


def test_a_beat_returns_after_its_window():
    m = keyed.Once(14)
    assert told(m, [[0, "b", 1], [14 * DAY, "b", 2], [14 * DAY + 1, "b", 3], [20 * DAY, "b", 4]], 21 * DAY)[0] == [[1, 0], [3, 14 * DAY + 1]]
    assert told(m, [[0, "b", 1]], 14 * DAY + 1)[1] is None


def test_heartbeats_are_throttled_and_runs_go_quiet():
    m = keyed.Beats(60, 1800)
    s = 1_000_000
    rows = [[0, "r", 1], [59 * s, "r", 2], [60 * s, "r", 3], [61 * s, "r", 4], [1861 * s, "r", 5], [3662 * s, "r", 6]]
    assert told(m, rows, 3663 * s)[0] == [[1, "heartbeat", 0], [3, "heartbeat", 60 * s], [5, "heartbeat", 1861 * s], [5, "quiet", 3661 * s], [6, "heartbeat", 3662 * s]]


def random_rows(seed, n=300):
    rng = random.Random(seed)
    return [(rng.choice("abc"), rng.randrange(0, 40 * DAY, HOUR), rng.choice(("change", "story", "story")), i) for i in range(n)]


@pytest.mark.parametrize("machine", [keyed.Holds(3), keyed.Once(3), keyed.Beats(7200, 36000)])
def test_state_may_be_written_at_any_place(machine):
    """The same rows in one go and in steps, with the state as text in between."""
    for key in "abc":
        rows = sorted(r[1:] for r in random_rows(1) if r[0] == key)
        whole, _ = keyed.advance(machine, rows, None, 50 * DAY)
        parts, state = [], None
        for d in range(51):
            out, state = keyed.advance(machine, [r for r in rows if (d - 1) * DAY <= r[0] < d * DAY], state, d * DAY)
            parts += out
            state = json.loads(json.dumps(state))
        assert [tuple(x) for x in parts] == [tuple(x) for x in whole]


@pytest.mark.parametrize("machine", [keyed.Holds(3), keyed.Once(3)])
def test_the_stream_gives_the_same_in_any_batches(spark, tmp_path, machine):
    rows = sorted(random_rows(2), key=lambda r: r[1])
    start = dt.datetime(2024, 1, 1)
    schema = "key string, at timestamp, kind string, ref long"
    # batches of some days each, mixed within a day, with rows that have no time or no key
    for batch in range(8):
        part = [(k, start + dt.timedelta(microseconds=t), kind, r) for k, t, kind, r in rows if t // (5 * DAY) == batch]
        random.Random(batch).shuffle(part)
        spark.createDataFrame([*part, (None, start, "story", -1), ("a", None, "story", -2)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    out = streams.run_available(keyed.run(source, "key", "at", F.col("kind"), "ref", machine, "1 day"), str(tmp_path / uuid.uuid4().hex))
    micros = lambda t: (t - start) // dt.timedelta(microseconds=1)
    got = sorted(str((r["key"], *(micros(x) if isinstance(x, dt.datetime) else x for x in r[1:]))) for r in out.collect())
    mark = max(r[1] for r in rows) - DAY
    want = sorted(str((key, *x)) for key in "abc" for x in keyed.advance(machine, [r[1:] for r in rows if r[0] == key and r[1] < mark], None, mark)[0])
    assert got == want and got


@pytest.mark.parametrize("buckets", [1, 5])
def test_keys_of_any_kind_share_a_bucket(spark, tmp_path, buckets):
    """Far fewer states than keys, and each key's rows are still its own."""
    start = dt.datetime(2024, 1, 1)
    names = ['a "b"', "", "ß\\", *map(str, range(40))]
    rows = [(2**60 + i, dt.date(2024, 1, 1 + i % 28), name, start + dt.timedelta(microseconds=t * HOUR + i), x, 100 * i + t) for i, name in enumerate(names) for t, x in ((0, "story"), (30, "change"), (90, "story"), (999, "story"))]
    spark.createDataFrame(rows, "n long, d date, s string, at timestamp, kind string, ref long").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("n long, d date, s string, at timestamp, kind string, ref long").parquet(str(tmp_path / "in"))
    for k, key in enumerate("nds"):
        out = streams.run_available(keyed.run(source, key, "at", F.col("kind"), "ref", keyed.Holds(2), "1 day", buckets=buckets), str(tmp_path / uuid.uuid4().hex))
        micros = lambda t: (t - start) // dt.timedelta(microseconds=1)
        mark = max(micros(r[3]) for r in rows) // 1000 * 1000 - DAY
        want = [(x, *got) for x in {r[k] for r in rows} for got in keyed.advance(keyed.Holds(2), [[micros(r[3]), r[4], r[5]] for r in rows if r[k] == x and micros(r[3]) < mark], None, mark)[0]]
        assert sorted((r[0], r[1], r[2], r[3], micros(r[4])) for r in out.collect()) == sorted(tuple(x) for x in want) and want
        assert out.schema[key].dataType == source.schema[key].dataType
