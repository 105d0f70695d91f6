"""Structured Streaming forms: rollups, sessions, sliding counts, deduplication and idempotent batches.

The transformations hold for batch and stream alike, so a stream over a table must give what the batch does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.session import shared_folder


def day_rollup(rows: DataFrame, by: list[str], at: str, delay: str = "1 day") -> DataFrame:
    """Counts and sums per key and day."""
    return rows.withWatermark(at, delay).groupBy(F.window(at, "1 day"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(*by, F.col("window.start").alias("day"), "n", "total")


def sessions(rows: DataFrame, by: str, at: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Runs of rows of a key with less than gap between them."""
    return rows.withWatermark(at, delay).groupBy(F.session_window(at, gap), by).agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def sliding_counts(rows: DataFrame, at: str, width: str = "10 seconds", step: str = "1 second", delay: str = "1 minute") -> DataFrame:
    return rows.withWatermark(at, delay).groupBy(F.window(at, width, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def first_seen(rows: DataFrame, key: str, at: str, delay: str = "3 days") -> DataFrame:
    """Each key once within the watermark; rows without a time go round it, since a watermark would drop them."""
    return rows.where(F.col(at).isNotNull()).withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def undated(rows: DataFrame, at: str) -> DataFrame:
    return rows.where(F.col(at).isNull())


def once_within(rows: DataFrame, keys: list[str], at: str, horizon: str = "14 days") -> DataFrame:
    """The first row of each key, and no other of that key for at least the horizon; the state of a key leaves after it."""
    return rows.withWatermark(at, horizon).dropDuplicatesWithinWatermark(keys)


def within_window(rows: DataFrame, last: DataFrame, at: str, days: int) -> DataFrame:
    """Rows of the days before the latest time, a table of one row (last)."""
    return rows.join(F.broadcast(last)).where(F.col(at) >= F.col("last") - F.expr(f"INTERVAL {int(days)} DAYS")).drop("last")


def confirmed_holds(held: DataFrame, changes: DataFrame, key: str, days: int = 14, keep: tuple[str, ...] = ()) -> DataFrame:
    """Stream-stream join: held rows that a change of their key confirms within days, before or after."""
    a = held.withWatermark("held_at", f"{days} days").alias("h")
    b = changes.withWatermark("changed_at", f"{days} days").alias("c")
    near = F.expr(f"c.changed_at BETWEEN h.held_at - INTERVAL {int(days)} DAYS AND h.held_at + INTERVAL {int(days)} DAYS")
    return a.join(b, (F.col(f"h.{key}") == F.col(f"c.{key}")) & near).select("h.*", "c.changed_at", *(f"c.{x}" for x in keep))


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what is there and return what it made, as a table in folder: rows are appended once their watermark has passed, state is dropped behind it."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def files_of(table: DataFrame, name: str) -> tuple[str, str]:
    """The folder that holds a table's files and a pattern of their names: its own folder, or for a table of one file that file alone."""
    first = table.inputFiles()[0]
    above, file = first.rsplit("/", 1)
    return (above, file) if file == name else (first.split(f"/{name}/")[0] + f"/{name}", "*.parquet")


def source_of(table: DataFrame, name: str = "events.parquet", at: str = "ts", **options) -> DataFrame:
    """A table's files as a stream; options are the file source's, such as maxFilesPerTrigger."""
    folder, pattern = files_of(table, name)
    source = table.sparkSession.readStream.schema(table.schema).options(**options).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(folder)
    return source.withColumn(at, F.col(at).cast("timestamp"))


def run_batches(table: DataFrame, write: Callable[[DataFrame, int], None], state: str, name: str = "events.parquet", **options) -> None:
    """What there is of a table, batch by batch through write; a run with the same state folder goes on where the last one stopped."""
    source_of(table, name, **options).writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def run_table(table: DataFrame, transform: Callable[[DataFrame], DataFrame], name: str = "events.parquet", at: str = "ts") -> DataFrame:
    """The transformation run as a stream over all of a table's files."""
    return run_available(transform(source_of(table, name, at)), shared_folder(table.sparkSession))
