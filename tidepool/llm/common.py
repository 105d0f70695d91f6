"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and all runs on one machine (tests) a temporary folder is made. What is written there
    stays until whoever named the folder clears it: results read from it lazily.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="tidepool-"))
    return _own_dir[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, name: str, column: str) -> DataFrame:
    """As materialize, but as a table bucketed by column, one bucket for each shuffle partition: grouping what is read by column needs no shuffle."""
    spark = df.sparkSession
    own = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    (df.write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/{own}")
     .bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).format("parquet").saveAsTable(own))
    return spark.table(own)


def blocks_for(rows: int, per_block: int) -> int:
    """How many blocks hold rows at about per_block each."""
    return max(1, math.ceil(rows / per_block))


def held_out(column: str = "doc_id"):
    """crc32 of the id's text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_sample(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """About rows rows of df and never more, those with the least hashes of columns.

    A count thins df by the hash first, so that no task and no reply to the driver holds much more than the sample.
    """
    n = df.count()
    h = F.pmod(F.xxhash64(*columns), F.lit(1 << 40))
    return df.withColumn("__h", h).where(F.col("__h") < int((1 << 40) * min(1.0, (1.2 * rows + 50) / max(1, n)))).orderBy("__h").limit(rows).drop("__h")


def give_back() -> None:
    """Return freed memory to the system. A Python worker serves many tasks of unlike stages, and its allocators keep what one of them freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library of Linux; others give back by themselves
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives memory back at the end of its partition."""
    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole
