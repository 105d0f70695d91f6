"""Run control and monitoring over event logs: streaks, stale runs, watermarks, rates, heartbeats."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import predicates as P
from tidepool.functions import values as V

# How many failures alone fail a stage whose items get no second chance, and one whose items do.
FAILURE_FLOOR = {"lossy": 1, "self_healing": 2}


def _sliced(log: DataFrame, by: str, order: list[str], failed: Column, neutral: Column | None, seconds: int) -> tuple[DataFrame, DataFrame]:
    """log with its place in a slice of time, and (by, __slice, lead, best, carry): what each slice begins with, its best run, and the run that comes into it.

    A slice is summed up as its run up to the first reset, its run after the last one, and whether it has a reset. Such sums
    join to that of a longer stretch, so only slices are ordered over a whole key; rows are ordered within theirs.
    """
    skip = F.lit(False) if neutral is None else F.coalesce(neutral, F.lit(False))
    rows = log.withColumns({"__slice": F.floor(F.unix_micros(F.col(order[0]).cast("timestamp")) / (seconds * 1_000_000)), "__bad": (failed & ~skip).cast("int"), "__reset": (~failed & ~skip).cast("int")})
    within = Window.partitionBy(by, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__island", F.coalesce(F.sum("__reset").over(within), F.lit(0)))
    parts = rows.groupBy(by, "__slice", "__island").agg(F.coalesce(F.sum("__bad"), F.lit(0)).alias("n"))
    sums = parts.groupBy(by, "__slice").agg(F.coalesce(F.max(F.when(F.col("__island") == 0, F.col("n"))), F.lit(0)).alias("lead"), F.max_by("n", "__island").alias("trail"), F.max("n").alias("best"), F.max("__island").alias("resets"))
    key = Window.partitionBy(by).orderBy("__slice")
    sums = sums.withColumn("__stretch", F.sum((F.col("resets") > 0).cast("int")).over(key.rowsBetween(Window.unboundedPreceding, 0)))
    ends = F.sum("trail").over(Window.partitionBy(by, "__stretch").orderBy("__slice").rowsBetween(Window.unboundedPreceding, 0))  # the run that a slice ends with
    return rows, sums.withColumn("__ends", ends).select(by, "__slice", "lead", "best", F.coalesce(F.lag("__ends").over(key), F.lit(0)).alias("carry"))


def streaks(log: DataFrame, by: str, order: list[str], failed: Column, neutral: Column | None = None, seconds: int = 86_400) -> DataFrame:
    """log with streak: consecutive failures up to and with each row. Success resets it; neutral rows leave it as it is.

    order begins with a time; time is cut into slices of that many seconds, and no task orders more of a key than a slice.
    """
    rows, sums = _sliced(log, by, order, failed, neutral, seconds)
    local = F.sum("__bad").over(Window.partitionBy(by, "__slice", "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__local", local).withColumnRenamed("__slice", "__own")
    own = sums.select(F.col(by).alias("__by"), F.col("__slice").alias("__of"), "carry")
    joined = rows.join(own, F.col(by).eqNullSafe(F.col("__by")) & F.col("__own").eqNullSafe(F.col("__of")))
    return joined.select(*log.columns, (F.col("__local") + F.when(F.col("__island") == 0, F.col("carry")).otherwise(0)).alias("streak"))


def longest_streak(log: DataFrame, by: str, order: list[str], failed: Column, neutral: Column | None = None, seconds: int = 86_400) -> DataFrame:
    """(by, longest); see streaks."""
    _, sums = _sliced(log, by, order, failed, neutral, seconds)
    return sums.groupBy(by).agg(F.max(F.greatest("best", F.col("carry") + F.col("lead"))).alias("longest"))


def run_state(log: DataFrame, run: str, at: str, finished: Column) -> DataFrame:
    """(run, started_at, progressed_at, status) from a log of progress rows."""
    return log.groupBy(run).agg(F.min(at).alias("started_at"), F.max(at).alias("progressed_at"), F.when(F.bool_or(finished), "finished").otherwise("running").alias("status"))


def stale(runs: DataFrame, cutoff: Column) -> DataFrame:
    return runs.where(P.stale_run(F.col("status"), F.col("progressed_at"), F.col("started_at"), cutoff))


def cancel_stale(runs: DataFrame, cutoff: Column) -> DataFrame:
    dead = P.stale_run(F.col("status"), F.col("progressed_at"), F.col("started_at"), cutoff)
    return runs.withColumn("status", F.when(dead, "cancelled").otherwise(F.col("status")))


def watermark(runs: DataFrame, kind: str) -> DataFrame:
    """When the last finished run of each kind began."""
    return runs.where("status = 'finished'").groupBy(kind).agg(F.max("started_at").alias("watermark"))


def stage_failure(tally: DataFrame, kinds: dict[str, str], stage: str = "stage") -> DataFrame:
    """tally (stage, processed, failed) with total_failure: nothing processed, and as many failures as the stage's kind needs. An unknown stage is an error."""
    floor = F.coalesce(V.mapped(F.col(stage), {k: FAILURE_FLOOR[v] for k, v in kinds.items()}), F.raise_error(F.concat(F.lit("unknown stage: "), F.coalesce(stage, F.lit("null")))).cast("int"))
    return tally.withColumn("total_failure", (F.col("processed") == 0) & (F.col("failed") >= floor))


def run_status(*errors: Column) -> tuple[Column, Column]:
    """Status and error text: succeeded without any."""
    text = F.concat_ws("; ", *errors)
    return F.when(text == "", "succeeded").otherwise("failed"), F.nullif(text, F.lit(""))


def rate_audit(log: DataFrame, by: str, at: str, seconds: int, limit: int) -> DataFrame:
    """log with in_window, the calls of the last seconds up to each one, and over, whether they pass the limit.

    Time is cut into spans of that length: a row also stands, as a copy that only counts, in the span after its own, and the window
    runs within (key, span). So a key with a third of all rows is split by time.
    """
    micros = seconds * 1_000_000
    t = F.unix_micros(F.col(at).cast("timestamp"))
    span = F.floor(t / micros)
    rows = log.withColumn("__t", t).withColumn("__span", F.explode(F.array(span, span + 1))).withColumn("__own", F.floor(F.col("__t") / micros) == F.col("__span"))
    w = Window.partitionBy(by, "__span").orderBy("__t").rangeBetween(-micros, 0)
    counted = rows.withColumn("in_window", F.count("*").over(w)).where("__own")
    return counted.drop("__t", "__span", "__own").withColumn("over", F.col("in_window") > limit)


def chain_exits(times: np.ndarray, wait: int, until: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted times of one block: (entries, exits). A chain that may go on from a time t not after until begins at the first row from t on; the first
    entry not before t gives the last row that the chain takes in this block.

    Each row points to the next that the chain takes after it; pointers are followed in doubling steps until all stand at their last.
    """
    n = len(times)
    after = np.searchsorted(times, times + wait)
    jump = np.where(after < n, after, np.arange(n))
    while len(step := jump[jump]) and (step != jump).any():
        jump = step
    first = np.arange(min(n, np.searchsorted(times, until) + 1))
    last = jump[first]
    # neighbours that lead to the same end are one entry, at the latest of them
    ends = np.flatnonzero(np.append(last[1:] != last[:-1], True)) if len(first) else first
    return times[first[ends]], times[last[ends]]


def chain_rows(times: np.ndarray, wait: int, t: int) -> np.ndarray:
    """The rows that a chain takes which may begin at t."""
    out, i = [], int(np.searchsorted(times, t))
    while i < len(times):
        out.append(i)
        i = int(np.searchsorted(times, times[i] + wait))
    return np.array(out, np.int64)


def heartbeats(log: DataFrame, by: str, at: str, seconds: int, block_seconds: int | None = None) -> DataFrame:
    """(by, at) of the rows that are emitted: the first of each key, then each that comes seconds or more after the last emitted one.

    Each depends on the one before, but time is cut into blocks: for each place where a chain may enter a block, the block tells
    where it leaves; only these few entries go through a key in order; then every block emits its rows by itself.
    So no task holds more rows of a key than a block. Rows without a time or a key are left out.
    """
    wait = seconds * 1_000_000
    width = max(wait, (block_seconds or 64 * seconds) * 1_000_000)
    rows = log.where(F.col(at).isNotNull() & F.col(by).isNotNull()).select(F.col(by).alias("k"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"))
    rows = rows.withColumn("block", F.floor(F.col("us") / width))
    kind = rows.schema["k"].dataType.simpleString()

    def entries(batches):
        for parts in _groups(batches, ["k", "block"]):
            times, block = parts["us"].to_numpy(), parts["block"][0].as_py()
            enter, leave = chain_exits(times, wait, block * width + wait)
            yield [parts["k"].slice(0, 1), pa.array([block], pa.int64()), pa.array([enter], pa.list_(pa.int64())), pa.array([leave], pa.list_(pa.int64()))]

    def compose(batches):
        for group in _groups(batches, ["k"]):
            t, starts = -(1 << 62), []
            for enter, leave in zip(group["enter"].to_pylist(), group["leave"].to_pylist(), strict=True):
                starts.append(t)
                i = bisect.bisect_left(enter, t)
                t = leave[i] + wait if i < len(enter) else t
            yield [group["k"], group["block"], pa.array(starts, pa.int64())]

    def emit(batches):
        for group in _groups(batches, ["k", "block"]):
            # the block's start stands before its rows
            times, start = group["us"].slice(1).to_numpy(), group["start"][0].as_py()
            taken = times[chain_rows(times, wait, start)]
            yield [group["k"].take(pa.array(np.zeros(len(taken), np.int64))), pa.array(taken, pa.int64())]

    dealt = lambda df, keys, *order: df.repartition(*keys).sortWithinPartitions(*keys, *order)
    tables = dealt(rows, ["k", "block"], "us").mapInArrow(_in_batches(entries, ["k", "block", "enter", "leave"]), f"k {kind}, block long, enter array<long>, leave array<long>")
    starts = dealt(tables, ["k"], "block").mapInArrow(_in_batches(compose, ["k", "block", "start"]), f"k {kind}, block long, start long")
    both = rows.withColumn("start", F.lit(None).cast("long")).unionByName(starts.withColumn("us", F.lit(None).cast("long")))
    out = dealt(both, ["k", "block"], F.col("us").asc_nulls_first()).mapInArrow(_in_batches(emit, ["k", "us"]), f"k {kind}, us long")
    return out.select(F.col("k").alias(by), F.timestamp_micros("us").alias("at"))


def _groups(batches, keys: list[str]):
    """The rows of each group, as a mapping of columns, from batches sorted by keys: a group may go over several batches, one is held at a time."""
    held = []
    whole = lambda: {n: pa.concat_arrays([b.column(n) for b in held]) for n in held[0].schema.names} if len(held) > 1 else {n: held[0].column(n) for n in held[0].schema.names}
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for c in keys:
            column = batch.column(c)
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            new[0] |= not held or held[-1].column(c)[-1] != column[0]
        ends = [*np.flatnonzero(new).tolist(), batch.num_rows]
        if held and ends[0] > 0:
            held.append(batch.slice(0, ends[0]))
        for begin, end in zip(ends, ends[1:]):
            if held:
                yield whole()
            held = [batch.slice(begin, end - begin)]
    if held:
        yield whole()


def _in_batches(run, names: list[str], most: int = 1000):
    """run's groups of columns, some of them to one batch."""
    def batches(source):
        waiting = []
        for columns in run(source):
            waiting.append(columns)
            if len(waiting) == most:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*waiting, strict=True)], names=names)
                waiting = []
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*waiting, strict=True)], names=names)

    return batches


def usage_by(calls: DataFrame, *keys: str) -> DataFrame:
    """Calls and the four token counts."""
    return calls.groupBy(*keys).agg(F.count("*").alias("calls"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")))


def usage_merged(stored: DataFrame, batch: DataFrame, *keys: str) -> DataFrame:
    """Stored counts with a batch's added: one row for each key."""
    both = stored.unionByName(batch)
    return both.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in stored.columns if c not in keys))


def with_health(rows: DataFrame, health: DataFrame, probes: DataFrame, run: str = "run_id") -> DataFrame:
    """rows with their run's health and its probe totals: picks and, of those, retrieved; a run without probes has none (0, 0)."""
    totals = probes.groupBy(run).agg(F.count("*").alias("picks"), F.count_if("retrieved").alias("picks_retrieved"))
    return rows.join(health, run, "left").join(totals, run, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("picks", "picks_retrieved")})


def health_trend(health: DataFrame, runs: DataFrame, run: str, n: int, probes: DataFrame | None = None, since: Column | None = None) -> DataFrame:
    """The newest n runs with a health row, those since a time if one is given, with their probe totals if there are probes."""
    rows = health.join(runs, run)
    rows = (rows if since is None else rows.where(F.col("started_at") >= since)).orderBy(F.desc("started_at"), F.desc(run)).limit(n)
    return rows if probes is None else with_health(rows, health.select(run), probes, run)


def usage_window(usage: DataFrame, runs: DataFrame, start: Column, end: Column, by: str, run: str = "run_id") -> DataFrame:
    """Usage of the runs that began from start up to and without end, summed up."""
    return usage_by(usage.join(runs.where((F.col("started_at") >= start) & (F.col("started_at") < end)).select(run), run, "left_semi"), by)


def detail_text(parts: dict[str, Column]) -> Column:
    """"name value" of each part that has one, in order, joined by semicolons."""
    return F.concat_ws("; ", *(F.when(c.isNotNull(), F.concat_ws(" ", F.lit(k), c.cast("string"))) for k, c in parts.items()))
