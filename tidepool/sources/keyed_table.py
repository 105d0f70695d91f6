"""A keyed table of Parquet parts: upserts rewrite the buckets they touch, a manifest names the current parts, a batch counts once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class StaleManifest(RuntimeError):
    """Another writer has put its manifest in place since this one read the table."""


@dataclass
class Manifest:
    """The state of a table: its schema, keys and number of buckets, the folder of each bucket that has rows, and the last batch of each writer with its counts."""

    version: int
    schema: dict
    keys: list[str]
    buckets: int
    parts: dict[str, str]
    writers: dict[str, dict]


class KeyedTable:
    """Rows by key under a folder of a file system that driver and executors share.

    A row lies in the bucket of its key's hash, so a batch reads and rewrites only the buckets of its keys, and keys spread evenly however
    often one of them comes: of each key a batch keeps one row before anything is shuffled further. A batch's new parts are
    written to a folder of their own; the table changes at the one moment when the next manifest takes its name. A writer that
    fails before leaves unnamed files only, so a batch may be run again; one that was applied does nothing. Readers keep the
    parts of the manifest they read, since parts are never changed; clear removes what no manifest of the last versions names.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str] | None = None, schema: StructType | None = None, buckets: int = 64):
        """Open the table in path, or make it if keys and schema are given and it isn't there."""
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self.versions():
            return
        if keys is None or schema is None:
            raise FileNotFoundError(f"{path} holds no keyed table")
        self._put(Manifest(0, schema.jsonValue(), keys, buckets, {}, {}))

    # --- manifests ---

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        return sorted(int(n[:-5]) for s in self._fs.listStatus(folder) if (n := s.getPath().getName()).endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> Manifest:
        version = self.versions()[-1] if version is None else version
        text = self._fs.open(self._path(f"{self.path}/manifests/{version:012d}.json"))
        try:
            return Manifest(**json.loads(bytes(text.readAllBytes()).decode()))
        finally:
            text.close()

    def _put(self, m: Manifest) -> None:
        """Write the manifest beside its name and rename it: readers see all of it or none. A name that is taken is refused."""
        final = self._path(f"{self.path}/manifests/{m.version:012d}.json")
        draft = self._path(f"{self.path}/manifests/.{m.version:012d}-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(m.__dict__).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise StaleManifest(f"version {m.version} of {self.path} is there already")

    # --- rows ---

    def _bucket(self, m: Manifest) -> Column:
        return F.pmod(F.xxhash64(*m.keys), F.lit(m.buckets)).cast("int")

    def _rows(self, m: Manifest, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(m.schema)
        folders = [f"{self.path}/{p}" for b, p in m.parts.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def rows(self, version: int | None = None) -> DataFrame:
        """The rows of the latest version, or of an earlier one that hasn't been cleared."""
        return self._rows(self.manifest(version))

    def upsert(self, batch: DataFrame, batch_id: int, writer: str = "default", order: list[Column] | None = None, keep: tuple[str, ...] = (),
               when: Column | None = None, ignore: bool = False) -> dict[str, int]:
        """Put a batch in and return {inserted, updated, unchanged}; a batch_id that this writer has reached before changes nothing and gives the last counts.

        Of each key the batch's first row by order counts (by all its columns where none is given). Stored rows take the batch's
        values but for the columns in keep, and only where when (over old_<column> and new_<column>) holds; with ignore
        stored rows stay as they are. Rows with a null in a key are refused. Columns that the table lacks are left out.
        """
        m = self.manifest()
        if writer in m.writers and batch_id <= m.writers[writer]["batch"]:
            return m.writers[writer]["counts"]
        schema = StructType.fromJson(m.schema)
        rest = [c for c in schema.names if c not in m.keys]
        rows = batch.select(*(F.col(f.name).cast(f.dataType) for f in schema))
        first = Window.partitionBy(*m.keys).orderBy(*(order or [F.asc_nulls_last(c) for c in schema.names]))
        rows = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
        known = F.lit(True)
        for c in m.keys:
            known &= F.col(c).isNotNull()
        rows = rows.withColumn("__bucket", F.when(known, self._bucket(m)).otherwise(F.raise_error(F.lit(f"a key of {m.keys} is null"))))
        folder = f"data/{uuid.uuid4().hex}"
        # the batch is read twice (which buckets, which rows), so it is written first
        rows.write.parquet(f"{self.path}/{folder}-batch")
        rows = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}-batch")
        touched = sorted(r[0] for r in rows.select("__bucket").distinct().collect())  # at most as many as the table has buckets
        stored = self._rows(m, touched)
        old = stored.select(*m.keys, *(F.col(c).alias(f"old_{c}") for c in rest), F.lit(True).alias("__old"))
        new = rows.select(*m.keys, *(F.col(c).alias(f"new_{c}") for c in rest), F.lit(True).alias("__new"))
        is_old, is_new = F.col("__old").isNotNull(), F.col("__new").isNotNull()
        take = is_new & (~is_old | (F.lit(not ignore) & F.coalesce(F.lit(True) if when is None else when, F.lit(False))))
        value = {c: F.when(take & ~(is_old & F.lit(c in keep)), F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")) for c in rest}
        changed = F.lit(False)
        for c in rest:
            changed |= ~value[c].eqNullSafe(F.col(f"old_{c}"))
        both = old.join(new, m.keys, "full_outer").select(*m.keys, *(v.alias(c) for c, v in value.items()), F.when(~is_new, "other").when(~is_old, "inserted").when(changed, "updated").otherwise("unchanged").alias("__what"))
        seen = Observation()
        counted = both.observe(seen, *(F.count_if(F.col("__what") == k).alias(k) for k in ("inserted", "updated", "unchanged")))
        out = counted.select(*schema.names, self._bucket(m).alias("__bucket")).repartition(max(1, len(touched)), "__bucket")
        out.write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        counts = {k: int(v) for k, v in seen.get.items()}
        parts = m.parts | {str(b): f"{folder}/__bucket={b}" for b in touched}
        self._put(Manifest(m.version + 1, m.schema, m.keys, m.buckets, parts, m.writers | {writer: {"batch": batch_id, "counts": counts}}))
        self._fs.delete(self._path(f"{self.path}/{folder}-batch"), True)
        return counts

    def batch_writer(self, writer: str = "stream", make: Callable[[DataFrame], DataFrame] | None = None, **how) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: each batch, made into rows by make, goes in once, however often the stream runs it."""
        def write(batch: DataFrame, batch_id: int) -> None:
            self.upsert(batch if make is None else make(batch), batch_id, writer, **how)

        return write

    def clear(self, versions: int = 2) -> int:
        """Delete the parts and manifests that none of the latest versions names; returns how many folders went. Not while a batch is being written."""
        kept = self.versions()[-versions:]
        named = {p.split("/")[1] for v in kept for p in self.manifest(v).parts.values()}
        gone = 0
        folder = self._path(f"{self.path}/data")
        for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            if s.getPath().getName() not in named:
                gone += bool(self._fs.delete(s.getPath(), True))
        for v in self.versions()[:-versions]:
            self._fs.delete(self._path(f"{self.path}/manifests/{v:012d}.json"), False)
        return gone
