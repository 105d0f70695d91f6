"""Predicates as columns and as filters. Today is always a parameter, never the clock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions import values as V

# Statuses out of play, early event types, writing jobs, and how many billed count.
EXCLUDED_STATUSES = ("Released", "Canceled")
EARLY_TYPES = ("announced", "casting", "crew_attached", "production_start", "production_wrap")
SEED_JOBS = ("Writer", "Screenplay")
TOP_BILLED = 5


def in_play(release_date: Column, status: Column, today: dt.date, excluded: tuple[str, ...] = EXCLUDED_STATUSES) -> Column:
    """Undated or not yet out, and of no excluded status; nulls stay in play."""
    return (release_date.isNull() | (release_date >= F.lit(today))) & (status.isNull() | ~status.isin(*excluded))


def last_activity(films: DataFrame, changes: DataFrame, stories: DataFrame, key: str = "film_id", created: str = "created_at") -> DataFrame:
    """films with last_activity: the latest of creation, any change, and any story's link or arrival.

    changes: (key, changed_at); stories: (key, linked_at, created_at). Both are summed up before the join, so no row multiplies.
    """
    c = changes.groupBy(key).agg(F.max("changed_at").alias("__change"))
    s = stories.groupBy(key).agg(F.max(F.coalesce("linked_at", "created_at")).alias("__story"))
    return films.join(c, key, "left").join(s, key, "left").withColumn("last_activity", F.greatest(created, "__change", "__story")).drop("__change", "__story")


def dormant(release_date: Column, last: Column, today: dt.date, days: int) -> Column:
    return F.coalesce(release_date.isNull() & (F.to_date(last) < F.date_sub(F.lit(today), days)), F.lit(False))


def active(release_date: Column, status: Column, last: Column, today: dt.date, days: int, excluded: tuple[str, ...] = EXCLUDED_STATUSES) -> Column:
    return in_play(release_date, status, today, excluded) & ~dormant(release_date, last, today, days)


def refresh_due(playing: Column, missing_at: Column, is_dormant: Column, updated_at: Column, due: Column, watermark: Column | None = None) -> Column:
    """Present and awake: changed since the watermark is due at once; dormant or missing rows wait for their own due time."""
    fresh = F.lit(True) if watermark is None else F.coalesce(updated_at < watermark, F.lit(True))
    return F.coalesce(playing & ((missing_at.isNull() & ((~is_dormant & fresh) | (is_dormant & (updated_at < due)))) | (missing_at < due)), F.lit(False))


def visible_event(event_type: Column, hidden: tuple[str, ...] = ("other",)) -> Column:
    return ~event_type.isin(*hidden)


def region_visible(event_type: Column, region: Column, origin: Column, home: str = "US") -> Column:
    return (event_type != "release_date") | region.isNull() | (region == home) | V.holds(origin, region)


def calendar_visible(region: Column, release_type: Column, day: Column, slug: Column, adult: Column, runtime: Column, popularity: Column, today: dt.date) -> Column:
    return ((region == "US") & release_type.isin(2, 3) & (day >= F.lit(today)) & slug.isNotNull() & ~F.coalesce(adult, F.lit(False))
            & (runtime.isNull() | (runtime == 0) | (runtime >= 75)) & (popularity > 1.5))


def skip_reason(status: Column, runtime: Column, excluded: tuple[str, ...] = EXCLUDED_STATUSES, least_runtime: int = 75) -> Column:
    """Why a row is skipped, status before runtime; null if it isn't."""
    return F.when(status.isin(*excluded), F.concat(F.lit("status:"), status)).when((runtime > 0) & (runtime < least_runtime), "runtime")


def seed_role(credit_type: Column, job: Column, order: Column) -> Column:
    """director, writer, cast (billed above the fifth) or null."""
    crew = credit_type == "crew"
    return F.when(crew & (job == "Director"), "director").when(crew & job.isin(*SEED_JOBS), "writer").when((credit_type == "cast") & (order < TOP_BILLED), "cast")


def displayable_release(release_type: Column, region: Column, origin: Column, home: str = "US") -> Column:
    return F.coalesce(release_type.isin(*V.RELEASE_BUCKET) & ((region == home) | V.holds(origin, region)), F.lit(False))


def within_days(a: Column, b: Column, days: int) -> Column:
    return a.between(b - F.expr(f"INTERVAL {int(days)} DAYS"), b + F.expr(f"INTERVAL {int(days)} DAYS"))


def recent(published: Column, fetched: Column, cutoff: Column) -> Column:
    return F.coalesce(published, fetched) >= cutoff


def not_stale(published: Column, cutoff: Column) -> Column:
    """Undated rows stay."""
    return published.isNull() | (published >= cutoff)


def title_hit(tokens: Column, text: Column, least: float) -> Column:
    """A title without tokens is kept; else the share of its tokens, repeats counted, must reach least."""
    hits = F.size(F.filter(tokens, lambda t: F.array_contains(text, t)))
    return (F.size(tokens) == 0) | F.coalesce(V.ratio(hits, F.size(tokens)) >= least, F.lit(False))


def label_violations(relation: Column, expected: Column, news: Column, category: Column) -> Column:
    """Names of the rules that a labelled row breaks: about needs a film and others have none, exclusions need no news."""
    return F.filter(F.array(
        F.when((relation == "about") & expected.isNull(), "about-without-film"),
        F.when((relation != "about") & expected.isNotNull(), "film-without-about"),
        F.when((relation != "about") & F.coalesce(news, F.lit(False)), "news-without-about"),
        F.when(F.coalesce(news, F.lit(False)) & category.isNotNull(), "news-with-exclusion")), lambda x: x.isNotNull())


def stale_stage(event_type: Column, status: Column, release_date: Column, as_of: dt.date) -> Column:
    """An early beat of a film that is already finished or out."""
    return event_type.isin(*EARLY_TYPES) & (F.coalesce(status.isin("Post Production", "Released"), F.lit(False)) | F.coalesce(release_date < F.lit(as_of), F.lit(False)))


def replaceable_summary(model: Column, edited_at: Column, sentinel: str) -> Column:
    return (model == sentinel) & edited_at.isNull()


def stale_run(status: Column, progressed: Column, started: Column, cutoff: Column) -> Column:
    return (status == "running") & (F.coalesce(progressed, started) < cutoff)


def linkable(relation: Column, news: Column, film: Column) -> Column:
    return (relation == "about") & ~news.eqNullSafe(F.lit(False)) & film.isNotNull()


def ingested_after(created: Column, pin: dt.date) -> Column:
    return F.to_date(created) > F.lit(pin)


def oversized(df: DataFrame, n: int) -> bool:
    """Has df more than n rows? Looks at n + 1 rows at most."""
    return df.limit(n + 1).count() > n


def too_short(query: str, least: int = 2) -> bool:
    """Does a search query have fewer letters and digits than least?"""
    return sum(c.isalnum() for c in query) < least


def having(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Rows of df whose keys stand in other."""
    return df.join(other.select(*keys).distinct(), list(keys), "left_semi")


def lacking(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Rows of df whose keys don't stand in other."""
    return df.join(other.select(*keys).distinct(), list(keys), "left_anti")


def flagged(df: DataFrame, other: DataFrame, name: str, *keys: str) -> DataFrame:
    """df with a boolean: do its keys stand in other?"""
    seen = other.select(*keys).distinct().withColumn(name, F.lit(True))
    return df.join(seen, list(keys), "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))
