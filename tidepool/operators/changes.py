"""Change capture and mutation over snapshots: diffs, upserts, repairs, violations. Each returns the new rows; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import predicates as P

# Columns whose changes aren't logged.
UNLOGGED = ("popularity", "vote_average", "vote_count", "revenue", "tmdb_raw", "updated_at", "credits_observed_at", "release_dates_observed_at", "tmdb_missing_at")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def insert_ignore(stored: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The batch's rows to insert: of each key the first in order, unless it is stored."""
    return first_per_key(batch, keys, order).join(stored.select(*keys).distinct(), keys, "left_anti")


def upsert_last_wins(stored: DataFrame, batch: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """All keys: the batch's row of highest seq where the batch has the key, else the stored one."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(batch.withColumn("__new", F.lit(1)))
    return first_per_key(both, keys, [F.desc("__new"), F.desc(seq)]).drop("__new")


def merge(stored: DataFrame, batch: DataFrame, keys: list[str], keep: tuple[str, ...] = (), when=None) -> DataFrame:
    """Stored and batch rows by key. Columns in keep (ids, slugs, creation times) stay as stored; others take the batch's.

    when: a condition over old_<column> and new_<column>; where it fails the stored row stays whole.
    """
    rest = [c for c in stored.columns if c not in keys]
    old = stored.select(*keys, *(F.col(c).alias(f"old_{c}") for c in rest), F.lit(True).alias("__old"))
    new = batch.select(*keys, *(F.col(c).alias(f"new_{c}") for c in rest), F.lit(True).alias("__new"))
    take = F.col("__new").isNotNull() & (F.col("__old").isNull() | F.coalesce(F.lit(True) if when is None else when, F.lit(False)))
    value = lambda c: F.when(F.col("__old").isNotNull(), F.coalesce(f"old_{c}", f"new_{c}")).otherwise(F.col(f"new_{c}")) if c in keep else F.col(f"new_{c}")
    return old.join(new, keys, "full_outer").select(*keys, *(F.when(take, value(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in rest))


def rebuild_children(stored: DataFrame, touched: DataFrame, fresh: DataFrame, parent: str) -> DataFrame:
    """Children of touched parents are replaced by the fresh ones, others stay."""
    return stored.join(touched.select(parent).distinct(), parent, "left_anti").unionByName(fresh.join(touched.select(parent).distinct(), parent, "left_semi"))


def field_changes(old: DataFrame, new: DataFrame, key: str, changed_at: Column, unlogged: tuple[str, ...] = UNLOGGED) -> DataFrame:
    """(key, field, old_value, new_value, changed_at) for each column whose value differs; new keys log nothing.

    Values are JSON texts; a null value is SQL null on that side.
    """
    fields = [c for c in old.columns if c != key and c not in unlogged]
    text = lambda side, c: F.nullif(F.regexp_extract(F.to_json(F.struct(F.col(f"{side}.{c}").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit(""))
    each = F.array(*(F.struct(F.lit(c).alias("field"), text("o", c).alias("old_value"), text("n", c).alias("new_value"),
                              F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")).alias("same")) for c in fields))
    both = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"))
    return both.select(F.col(f"o.{key}").alias(key), F.explode(F.filter(each, lambda s: ~s["same"])).alias("c")).select(
        key, "c.field", "c.old_value", "c.new_value", changed_at.alias("changed_at"))


def set_changes(previous: DataFrame, current: DataFrame, observed: DataFrame, parent: str, identity: list[str]) -> DataFrame:
    """Members added to and removed from each parent: (identity, change).

    observed: the parents that were looked at before. Without an earlier look there is no change, only a baseline;
    an earlier look that found nothing makes every member an addition.

    Both sides meet in one grouping of members, in which nulls are equal; only what changed is held against the parents.
    """
    sides = previous.select(*identity, F.lit(True).alias("__was"), F.lit(False).alias("__is")).unionByName(current.select(*identity, F.lit(False).alias("__was"), F.lit(True).alias("__is")))
    rows = sides.groupBy(*identity).agg(F.bool_or("__was").alias("__was"), F.bool_or("__is").alias("__is")).where(F.col("__was") != F.col("__is"))
    return P.having(rows, observed, parent).select(*identity, F.when(F.col("__is"), "added").otherwise("removed").alias("change"))


def date_changes(previous: DataFrame, current: DataFrame, observed: DataFrame, parent: str, subject: list[str], date: str, order: str) -> DataFrame:
    """Dates set or moved: (subject, previous_date, new_date, change). Withdrawn dates log nothing.

    A subject that stands twice in previous counts with its last row; each different current date gives a row.
    """
    seen = observed.select(parent).distinct()
    old = previous.groupBy(*subject).agg(F.max_by(date, order).alias("previous_date"))
    rows = current.join(seen, parent, "left_semi").select(*subject, F.col(date).alias("new_date")).join(old, subject, "left")
    return rows.where(~F.col("previous_date").eqNullSafe(F.col("new_date"))).withColumn("change", F.when(F.col("previous_date").isNull(), "set").otherwise("moved"))


def latest(df: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """The latest row of each key, by a maximum alone: no sort within the groups."""
    rest = [c for c in df.columns if c not in (*keys, order, tie)]
    return df.groupBy(*keys).agg(F.max(F.struct(order, tie, *rest)).alias("s")).select(*keys, "s.*")


def marked_once(column: str, now: Column) -> Column:
    return F.coalesce(F.col(column), now)


def tombstoned(present: Column, missing_at: str, now: Column) -> Column:
    """Cleared where the row is present, stamped once where it isn't."""
    return F.when(present, F.lit(None)).otherwise(F.coalesce(F.col(missing_at), now))


def slugs(films: DataFrame, taken: DataFrame | None, base: Column, film: str = "film_id") -> DataFrame:
    """(film, slug): the lowest id of each base keeps it plain unless it is taken, others get the id behind it.

    A slug with an id behind it may itself be taken, or be another film's plain slug; such a film gets its id behind it once more.
    """
    b = films.select(film, base.alias("slug_base"))
    rows = b.withColumn("__n", F.row_number().over(Window.partitionBy("slug_base").orderBy(film)))
    used = (taken.select("slug") if taken is not None else films.select(F.lit(None).cast("string").alias("slug")).limit(0)).distinct()
    rows = rows.join(used.select(F.col("slug").alias("slug_base"), F.lit(True).alias("__taken")), "slug_base", "left")
    plain = (F.col("__n") == 1) & F.col("__taken").isNull()
    longer = F.concat_ws("-", "slug_base", film)
    claimed = used.union(rows.where(plain).select(F.col("slug_base").alias("slug"))).distinct()
    rows = rows.withColumn("__plain", plain).withColumn("slug", F.when(plain, F.col("slug_base")).otherwise(longer))
    clash = claimed.select("slug", F.lit(True).alias("__clash"))
    return rows.join(clash, "slug", "left").select(film, F.when(~F.col("__plain") & F.col("__clash").isNotNull(), F.concat_ws("-", "slug", film)).otherwise(F.col("slug")).alias("slug"))


def event_repair(events: DataFrame, members: DataFrame, rejected: DataFrame | None = None, *, event: str = "event_id", story: str = "story_id", occurred: str = "occurred_at", at: str = "at") -> DataFrame:
    """(event, action, occurred_at, n_left): what becomes of events once rejected stories leave.

    No story left: delete. Otherwise the time is the earliest of what is left, and the summary goes (repair) if a story
    left or the event's own time was too early; untouched events are not returned.
    """
    m = members if rejected is None else members.join(rejected.select(story).distinct().withColumn("__out", F.lit(True)), story, "left")
    m = m.withColumn("__out", F.coalesce("__out", F.lit(False))) if rejected is not None else m.withColumn("__out", F.lit(False))
    sums = m.groupBy(event).agg(F.count_if(~F.col("__out")).alias("n_left"), F.count_if("__out").alias("n_out"), F.min(F.when(~F.col("__out"), F.col(at))).alias("__first"))
    rows = events.select(event, F.col(occurred).alias("__was")).join(sums, event)
    action = F.when(F.col("n_left") == 0, "delete").when((F.col("n_out") > 0) | (F.col("__first") > F.col("__was")), "repair")
    return rows.withColumn("action", action).where("action IS NOT NULL").select(event, "action", F.col("__first").alias(occurred), "n_left")


def cascade_delete(gone: DataFrame, key: str, *tables: DataFrame) -> list[DataFrame]:
    keys = gone.select(key).distinct()
    return [t.join(keys, key, "left_anti") for t in tables]


def detach(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The key becomes null where its row is gone."""
    flags = gone.select(key).distinct().withColumn("__gone", F.lit(True))
    return rows.join(flags, key, "left").withColumn(key, F.when(F.col("__gone").isNull(), F.col(key))).drop("__gone").select(*rows.columns)


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): rows that break each rule; a rule that is null counts as kept."""
    counts = df.agg(*(F.count_if(~r).alias(name) for name, r in rules.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules))).alias("r")).select("r.*")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def queued(state: Column, url: Column) -> Column:
    """The first state of an address: pending if it has to be resolved, else none; later states stay."""
    return F.when(state.isNull() | (state == "none"), F.when(url.isNotNull(), "pending").otherwise("none")).otherwise(state)


def resolve_attempt(state: Column, attempts: Column, resolved: Column, most: int) -> tuple[Column, Column]:
    """Next state and attempts of a pending url: resolved, or failed after the last attempt."""
    n = attempts + 1
    return F.when(state != "pending", state).when(resolved.isNotNull(), "resolved").when(n >= most, "failed").otherwise("pending"), F.when(state == "pending", n).otherwise(attempts)

