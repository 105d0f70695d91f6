"""The table of source domains: judged once, overridden by hand, listed with the tier that counts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators.decisions import effective_tier
from tidepool.sources.keyed_table import KeyedTable

SCHEMA = "domain string, llm_tier string, llm_reason string, llm_model string, admin_override string, first_seen_at timestamp, judged_at timestamp, updated_at timestamp"


def open_table(spark: SparkSession, path: str, buckets: int = 16) -> KeyedTable:
    return KeyedTable(spark, path, ["domain"], spark.createDataFrame([], SCHEMA).schema, buckets)


def judge(table: KeyedTable, verdicts: DataFrame, model: str, now: dt.datetime, batch_id: int) -> dict[str, int]:
    """Put verdicts (domain, tier, reason) in; a domain that is known stays as it is, so each is judged once. Returns the counts."""
    at = F.lit(now)
    rows = verdicts.select("domain", F.col("tier").alias("llm_tier"), F.col("reason").alias("llm_reason"), F.lit(model).alias("llm_model"), F.lit("none").alias("admin_override"), at.alias("first_seen_at"), at.alias("judged_at"), at.alias("updated_at"))
    return table.upsert(rows, batch_id, "judge", ignore=True)


def override(table: KeyedTable, overrides: DataFrame, now: dt.datetime, batch_id: int) -> dict[str, int]:
    """Set or clear (none) the override of domains (domain, override); a domain never seen gets a row without a verdict. What was judged stays."""
    at, none = F.lit(now), F.lit(None)
    rows = overrides.select(F.lower(F.trim("domain")).alias("domain"), none.alias("llm_tier"), none.alias("llm_reason"), none.alias("llm_model"), F.col("override").alias("admin_override"), at.alias("first_seen_at"), none.alias("judged_at"), at.alias("updated_at"))
    return table.upsert(rows, batch_id, "override", keep=("llm_tier", "llm_reason", "llm_model", "first_seen_at", "judged_at"))


def listed(rows: DataFrame, default: str = "acceptable") -> DataFrame:
    """All domains with the tier that counts, those touched last first, then by name."""
    return rows.withColumn("tier", effective_tier(F.col("llm_tier"), F.col("admin_override"), default)).orderBy(F.desc("updated_at"), F.asc("domain"))
