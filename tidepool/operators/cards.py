"""Change logs turned into events, and films discovered through people."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions import predicates as P
from tidepool.functions import values as V
from tidepool.functions.text import prose_list


def lookback(changes: DataFrame, now: dt.datetime, days: int, at: str = "changed_at") -> DataFrame:
    """The changes of the last days. Read anew each time; what is carded already is taken out by the cards' own rules."""
    return changes.where(F.col(at) >= F.lit(now - dt.timedelta(days=days)))


def once_per_entity(changes: DataFrame, events: DataFrame, *, film: str = "film_id", event_type: str = "event_type", at: str = "changed_at", tie: str = "id") -> DataFrame:
    """The first change of each (film, type) that has no event of that type yet."""
    first = changes.groupBy(film, event_type).agg(F.min(F.struct(at, tie)).alias("s")).select(film, event_type, "s.*")
    return P.lacking(first, events, film, event_type)


def status_cards(changes: DataFrame, events: DataFrame, *, film: str = "film_id") -> DataFrame:
    """Status changes that are milestones, once per film and type whatever made the earlier event."""
    typed = changes.where(F.col("field") == "status").withColumn("event_type", V.mapped(F.col("new_value"), V.STATUS_EVENT)).where("event_type IS NOT NULL")
    return once_per_entity(typed, events, film=film)


def credit_cards(changes: DataFrame, people: DataFrame, events: DataFrame, *, film: str = "film_id") -> DataFrame:
    """(film, changed_at, event_type, people, names): added seed credits by film, time and type.

    people: (person_id, name_key, missing_at). A person already recorded for that type is left out, a group whose
    exact (film, type, time) has an event too, and so are empty groups. events: (film, event_type, occurred_at, subject_key).
    """
    rows = (changes.where(F.col("change") == "added").join(people.where("missing_at IS NULL"), "person_id")
            .withColumn("event_type", V.mapped(F.col("role"), V.ROLE_EVENT)).where("event_type IS NOT NULL"))
    said = events.select(film, "event_type", F.explode("subject_key").alias("name_key"))
    rows = P.lacking(rows, said, film, "event_type", "name_key")
    rows = P.lacking(rows, events.select(film, "event_type", F.col("occurred_at").alias("changed_at")), film, "event_type", "changed_at")
    return rows.groupBy(film, "changed_at", "event_type").agg(F.array_sort(F.collect_set("person_id")).alias("people"), F.array_sort(F.collect_set("name_key")).alias("names"))


def release_cards(moves: DataFrame, *, film: str = "film_id", home: str = "US") -> DataFrame:
    """(film, changed_at, region, subjects): moves of one time together; the home region if it is among them, else the least."""
    bucket = F.concat_ws(":", "iso_3166_1", V.mapped(F.col("release_type"), V.RELEASE_BUCKET))
    return moves.where(F.col("release_type").isin(*V.RELEASE_BUCKET)).groupBy(film, "changed_at").agg(
        F.when(F.bool_or(F.col("iso_3166_1") == home), F.lit(home)).otherwise(F.min("iso_3166_1")).alias("region"), F.array_sort(F.collect_set(bucket)).alias("subjects"))


def interval_dedup(changes: DataFrame, events: DataFrame, days: int, keys: list[str], at: str = "changed_at", occurred: str = "occurred_at") -> DataFrame:
    """Changes without an event of the same keys: within days for a story's event, at the exact time for a catalog's.

    Both times are cut into spans of days and an event stands in its own span and its neighbours, so the join is an equi-join
    on keys and span; the exact condition follows.
    """
    width = days * 86_400
    span = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / width)
    story = events.where("provenance = 'story'").select(*keys, F.col(occurred).alias("__at"), F.explode(F.array(span(occurred) - 1, span(occurred), span(occurred) + 1)).alias("__span")).distinct()
    left = changes.withColumn("__span", span(at))
    cond = [left[k] == story[k] for k in keys] + [left["__span"] == story["__span"], P.within_days(F.col("__at"), F.col(at), days)]
    out = left.join(story, cond, "left_anti").drop("__span")
    catalog = events.where("provenance = 'catalog'").select(*keys, F.col(occurred).alias(at))
    return P.lacking(out, catalog, *keys, at)


def status_sentence(title: Column, event_type: Column) -> Column:
    return F.when(event_type == "production_start", F.concat(title, F.lit(" is now in production."))).when(event_type == "production_wrap", F.concat(title, F.lit(" has wrapped production.")))


def release_sentence(title: Column, previous: Column, new: Column, region: Column) -> Column:
    return F.concat(title, F.when(previous.isNull(), " is dated for ").otherwise(" moves to "), V.long_date(new), F.lit(" in "), region, F.lit("."))


def credits_sentence(title: Column, names: Column, role: Column) -> Column:
    verb = F.when(F.size(names) > 1, " join ").otherwise(" joins ")
    tail = V.mapped(role, {"director": " as director.", "writer": " as writer.", "cast": " in the cast."}, ".")
    return F.concat(prose_list(names), verb, title, tail)


def seed_people(credits: DataFrame, films: DataFrame, people: DataFrame, *, film: str = "film_id", person: str = "person_id") -> DataFrame:
    """Distinct people with a seed credit on an active film, unless they are known to be missing; unknown people stay."""
    role = P.seed_role(F.col("credit_type"), F.col("job"), F.col("credit_order"))
    rows = P.having(credits.where(role.isNotNull()), films, film).select(person).distinct()
    return rows.join(people.select(person, "missing_at"), person, "left").where("missing_at IS NULL").select(person)


def attachments(filmographies: DataFrame, *, film: str = "film_id") -> DataFrame:
    """Seed credits of people on undated films: (person_id, film, role)."""
    role = P.seed_role(F.col("credit_type"), F.col("job"), F.col("credit_order"))
    return filmographies.where(F.coalesce("release_date", F.lit("")) == "").withColumn("role", role).where("role IS NOT NULL").select("person_id", film, "role").distinct()


def tally(found: DataFrame, known: DataFrame, *, film: str = "film_id", person: str = "person_id") -> DataFrame:
    """(film, n_people, roles) of films that aren't known: distinct people, and their roles in a fixed order."""
    return P.lacking(found, known, film).groupBy(film).agg(F.count_distinct(person).alias("n_people"), V.joined_in_order(F.collect_set("role"), V.ROLE_ORDER).alias("roles"))


def histogram(tallied: DataFrame, n: str = "n_people", top: int = 3) -> DataFrame:
    """How many films have 1, 2, ... and top or more people."""
    return tallied.groupBy(F.least(F.col(n), F.lit(top).cast("long")).alias("people")).agg(F.count("*").alias("films"))


def judged(candidates: DataFrame, least_people: int = 2) -> DataFrame:
    """Each candidate's verdict, the first that applies: dated, its skip reason, too few people without a director, or admitted."""
    skip = P.skip_reason(F.col("status"), F.col("runtime"))
    verdict = (F.when(F.col("release_date").isNotNull(), "dated").when(skip.isNotNull(), skip)
               .when((F.col("n_people") < least_people) & ~F.contains(F.col("roles"), F.lit("director")), "uncorroborated").otherwise("admit"))
    return candidates.withColumn("verdict", verdict)


def reason_text(judged_rows: DataFrame, by: str = "verdict") -> DataFrame:
    """One line: each reason with its count, in order; reasons without rows don't show."""
    n = judged_rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"))
    return n.agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%s=%d", by, "n"))), ", ").alias("reasons"))


def summary_work(events: DataFrame, summaries: DataFrame, stories: DataFrame, sentinel: str, *, event: str = "event_id") -> DataFrame:
    """Events to be summed up: they have a story, and no summary or one that may be replaced."""
    rows = P.having(events, stories, event).join(summaries.select(event, "model", "edited_at"), event, "left")
    return rows.where(F.col("model").isNull() | P.replaceable_summary(F.col("model"), F.col("edited_at"), sentinel)).select(*events.columns)
