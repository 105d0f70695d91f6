"""Reading queries: pages of a feed by row and by day, calendars, search, sitemap, ordered reads within a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import predicates as P
from tidepool.functions import text as X
from tidepool.functions import values as V


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of rows. Spark takes the top limit + offset rows of each partition, so nothing is sorted as a whole."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_of_keys(df: DataFrame, key: str, limit: int, offset: int = 0, descending: bool = True) -> DataFrame:
    """All rows of one page of distinct keys (days): the page is N keys, however many rows they have."""
    keys = df.select(key).distinct().orderBy(F.col(key).desc() if descending else F.col(key).asc()).offset(offset).limit(limit)
    return df.join(F.broadcast(keys), key, "left_semi")  # at most limit keys


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group in order, numbered from 1. Spark limits each group before its shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def top_n_distinct(df: DataFrame, by: list[str], distinct_key: Column, order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """Per group the first row of each distinct key, and of these the first n."""
    first = top_n(df.withColumn("__key", distinct_key), [*by, "__key"], order, 1, "__first").drop("__first", "__key")
    return top_n(first, by, order, n, rank)


def visible_spine(events: DataFrame, summaries: DataFrame, films: DataFrame, event_id: str = "event_id", film_id: str = "film_id") -> DataFrame:
    """Events that have a summary and a film: without a summary an event can't be seen."""
    return events.join(summaries, event_id).join(films, film_id)


def grouped_days(events: DataFrame, film: str, day: str, event_type: str, has_story: str) -> DataFrame:
    """One row for each film and day: how many events, their distinct types in order, and whether any has a story."""
    return events.groupBy(film, day).agg(
        F.count("*").alias("n_events"), F.array_sort(F.collect_set(event_type)).alias("types"), F.bool_or(has_story).alias("has_story"))


def most_significant(types: Column, rank) -> Column:
    """Of an ordered array the item of highest rank, the first of equals."""
    return F.try_element_at(F.transform(F.array_sort(F.transform(types, lambda t: F.struct((-rank(t)).alias("r"), t.alias("t")))), lambda s: s["t"]), F.lit(1))


def by_significance(types: Column, rank) -> Column:
    return F.transform(F.array_sort(F.transform(types, lambda t: F.struct((-rank(t)).alias("r"), t.alias("t")))), lambda s: s["t"])


def day_grouped_feed(events: DataFrame, films: DataFrame, stories: DataFrame, days: int, offset: int = 0, *, film: str = "film_id", day: str = "day",
                     event_type: str = "event_type", event_id: str = "event_id", popularity: str = "popularity", slug: str = "slug", rank) -> DataFrame:
    """A page of days, newest first: for each film and day its count, types by significance, main type, story flag and total of days."""
    total = events.select(F.count_distinct(day).alias("total_days"))
    rows = P.flagged(page_of_keys(events, day, days, offset), stories, "has_story", event_id)
    cards = grouped_days(rows, film, day, event_type, "has_story").join(films.select(film, popularity, slug), film)
    return (cards.withColumn("main_type", most_significant(F.col("types"), rank)).withColumn("types", by_significance(F.col("types"), rank))
            .join(F.broadcast(total)))  # one row


def sitemap(events: DataFrame, films: DataFrame, film: str = "film_id", slug: str = "slug", created: str = "created_at") -> DataFrame:
    """slug and lastmod (the day of its newest event) of each film with an event."""
    last = events.groupBy(film).agg(F.max(created).alias("last"))
    return last.join(films.select(film, slug), film).select(slug, F.date_format("last", "yyyy-MM-dd").alias("lastmod"))


def search(films: DataFrame, alternatives: DataFrame | None, query: str, limit: int, offset: int = 0, *, film: str = "film_id", title: str = "title",
           original: str | None = None, popularity: str = "popularity") -> DataFrame:
    """Films whose title, original title or another title holds the folded query; matches in a main title first, then by popularity, then id.

    A query of fewer than two letters and digits finds nothing.
    """
    if P.too_short(query):
        return films.withColumn("primary_match", F.lit(False)).limit(0)
    q = X.search_fold(F.lit(query))
    hit = F.contains(X.search_fold(F.col(title)), q)
    if original:
        hit = hit | F.coalesce(F.contains(X.search_fold(F.col(original)), q), F.lit(False))
    found = films.withColumn("primary_match", F.coalesce(hit, F.lit(False)))
    if alternatives is not None:
        found = P.flagged(found, alternatives.where(F.contains(X.search_fold(F.col(title)), q)), "__alt", film).where(F.col("primary_match") | F.col("__alt")).drop("__alt")
    else:
        found = found.where("primary_match")
    return page(found, [F.desc("primary_match"), F.col(popularity).desc_nulls_last(), F.asc(film)], limit, offset)


def by_reference(films: DataFrame, ref: str, film: str = "film_id", slug: str = "slug") -> DataFrame:
    """The film that a reference names: an exact slug beats a leading id."""
    number = ref.split("-")[0]
    asked = (F.col(slug) == ref) | ((F.col(film) == int(number)) if number.isdigit() else F.lit(False))
    return films.where(asked).orderBy((F.col(slug) == ref).desc(), F.asc(film)).limit(1)


def detail(film_rows: DataFrame, film: str, **children: DataFrame) -> DataFrame:
    """Each film with its child rows as an ordered array of structs per name; a film without children has an empty one.

    A child holds the film's key and `position`, its place; every child is gathered before its join, so rows don't multiply.
    """
    out = film_rows
    for name, rows in children.items():
        rest = [c for c in rows.columns if c not in (film, "position")]
        each = rows.groupBy(film).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", *rest))), lambda s: F.struct(*(s[c].alias(c) for c in rest))).alias(name))
        out = out.join(each, film, "left").withColumn(name, F.coalesce(name, F.array().cast(each.schema[name].dataType)))
    return out


def ordered_join(df: DataFrame, by: list[str], value: str, order: list[str], name: str, separator: str = ", ") -> DataFrame:
    """A group's values in order, as one text."""
    return df.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v")))), lambda s: s["__v"]), separator).alias(name))


def distinct_casings(titles: DataFrame, by: str, title: str, banned: list[str], n: int = 8) -> DataFrame:
    """Other titles without those in banned, one of each casing (the least), the first n by lower case."""
    low = F.lower(title)
    kept = titles.where(~low.isin(*(b.lower() for b in banned))).groupBy(by, low.alias("__low")).agg(F.min(title).alias(title))
    return top_n(kept, [by], [F.asc("__low")], n).drop("__low")


def calendar(releases: DataFrame, films: DataFrame, directors: DataFrame, days: int, offset: int = 0, *, film: str = "film_id", day: str = "day") -> DataFrame:
    """A page of release days, soonest first, with each film once a day and its directors in billing order."""
    rows = page_of_keys(releases, day, days, offset, descending=False).dropDuplicates([film, day])
    named = ordered_join(directors, [film], "name", ["credit_order", "name"], "directors")
    return rows.join(films, film).join(named, film, "left")


def flat_feed(events: DataFrame, summaries: DataFrame, films: DataFrame, members: DataFrame, stories: DataFrame, limit: int, offset: int = 0, *, outlets: int = 3, hidden: tuple[str, ...] = ("other",), home: str = "US") -> DataFrame:
    """A page of visible events, newest first, each with up to `outlets` stories of different outlets (newest first) and the count of all visible events.

    events: (event_id, film_id, event_type, region, created_at); films: (film_id, slug, origin, an array of countries); members: (event_id, story_id);
    stories: (story_id, outlet, published_at). Stories are fetched for the page's events alone.
    """
    seen = P.visible_event(F.col("event_type"), hidden) & P.region_visible(F.col("event_type"), F.col("region"), F.col("origin"), home)
    rows = visible_spine(events, summaries, films).where(seen)
    total = rows.agg(F.count("*").alias("total"))
    shown = page(rows, [F.desc("created_at"), F.asc("event_id")], limit, offset)
    of_page = P.having(members, shown, "event_id").join(stories, "story_id")
    best = top_n_distinct(of_page, ["event_id"], X.outlet_key(F.col("outlet")), [F.col("published_at").desc_nulls_last(), F.asc("story_id")], outlets)
    told = best.groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "story_id"))), lambda x: x["story_id"]).alias("stories"))
    return shown.join(told, "event_id", "left").join(F.broadcast(total))  # one row


def visible_calendar(releases: DataFrame, films: DataFrame, genres: DataFrame, directors: DataFrame, today, days: int, offset: int = 0) -> DataFrame:
    """A page of coming release days, soonest first: visible releases, each film once a day with its label, first genres and directors.

    releases: (film_id, region, release_type, at); films: (film_id, slug, adult, runtime, popularity).
    """
    day = F.to_date("at")
    rows = releases.where(F.col("at") >= F.lit(today)).join(films, "film_id").withColumn("day", day)
    rows = rows.where(P.calendar_visible(F.col("region"), F.col("release_type"), F.col("day"), F.col("slug"), F.col("adult"), F.col("runtime"), F.col("popularity"), today))
    rows = page_of_keys(rows, "day", days, offset, descending=False)
    once = rows.groupBy("film_id", "day", "slug").agg(F.max("release_type").alias("release_type"))
    label = V.mapped(F.col("release_type"), V.RELEASE_LABEL)
    three = top_n(P.having(genres, once, "film_id"), ["film_id"], [F.asc("name")], 3, "place")
    return (once.withColumn("label", label).join(ordered_join(three, ["film_id"], "name", ["place"], "genres"), "film_id", "left")
            .join(ordered_join(P.having(directors, once, "film_id"), ["film_id"], "name", ["credit_order", "name"], "directors"), "film_id", "left"))


def other_titles(titles: Column, title: Column, original: Column, n: int = 8) -> Column:
    """Of an array of (low, title) the titles that are neither of two in any casing; one of each casing (the least), the first n by lower case."""
    other = F.filter(titles, lambda t: ~t["low"].eqNullSafe(title) & ~t["low"].eqNullSafe(original) & t["low"].isNotNull())
    # the sorted array is told once, as the one item of another; the first of each casing stays
    once = F.transform(F.array(F.array_sort(other)), lambda own: F.filter(own, lambda t, i: ~t["low"].eqNullSafe(F.get(own, i - 1)["low"])))
    return F.transform(F.slice(F.get(once, F.lit(0)), 1, n), lambda t: t["title"])


def in_order(items: Column, keys: Callable[[Column], list[Column]], *fields: str, first: int | None = None) -> Column:
    """The items of an array by their keys (nulls first), with these fields; the first few, if asked for."""
    keyed = F.array_sort(F.transform(items, lambda x: F.struct(F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys(x)))).alias("key"), F.struct(*(x[f].alias(f) for f in fields)).alias("item"))))
    return F.transform(keyed if first is None else F.slice(keyed, 1, first), lambda x: x["item"])


def event_sources(members: DataFrame, outlets: int = 3, fields: tuple[str, ...] = ("url", "outlet", "headline", "published_at")) -> DataFrame:
    """(event_id, sources): the newest stories of different outlets, from (event_id, story_id, outlet, published_at, ...) of an event's members."""
    told = top_n_distinct(members, ["event_id"], X.outlet_key(F.col("outlet")), [F.col("published_at").desc_nulls_last(), F.asc("story_id")], outlets)
    return told.groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", *fields))), lambda x: x.dropFields("rank")).alias("sources"))


def film_page(films: DataFrame, *, events: DataFrame, summaries: DataFrame, members: DataFrame, stories: DataFrame | None = None, releases: DataFrame, genres: DataFrame, companies: DataFrame,
              collections: DataFrame, titles: DataFrame, credits: DataFrame, hidden: tuple[str, ...] = ("other",), home: str = "US", billed: int = 12, outlets: int = 3) -> DataFrame:
    """What film_page_of gives, from tables of their own.

    events: (event_id, film_id, event_type, region, confidence, provenance, created_at); summaries: (event_id, summary, edited_at); members: (event_id, story_id);
    stories: (story_id, outlet, url, headline, published_at); releases: (film_id, iso_3166_1, release_type, release_date, certification); genres, companies: (film_id, id, name);
    titles: (film_id, title); credits: (film_id, name, credit_type, character, job, department, credit_order). Without stories the members bear their columns.
    """
    sources = event_sources(members if stories is None else members.join(stories, "story_id"), outlets)
    shown = events.join(summaries, "event_id").join(sources, "event_id", "left").where(P.visible_event(F.col("event_type"), hidden))
    parts = {"event": (shown, EVENT), "release": (releases, RELEASE), "genre": (genres, ("id", "name")), "company": (companies, ("id", "name")), "credit": (credits, CREDIT)}
    rows = titles.select("film_id", "title")
    for name, (table, fields) in parts.items():
        rows = rows.unionByName(table.select("film_id", F.struct(*fields).alias(name)), allowMissingColumns=True)
    return film_page_of(films, rows, collections, hidden=hidden, home=home, billed=billed)


EVENT = ("event_id", "event_type", "region", "confidence", "provenance", "created_at", "summary", "edited_at", "sources")
RELEASE = ("iso_3166_1", "release_type", "release_date", "certification")
CREDIT = ("name", "credit_type", "character", "job", "department", "credit_order")


def film_page_of(films: DataFrame, rows: DataFrame, collections: DataFrame, *, hidden: tuple[str, ...] = ("other",), home: str = "US", billed: int = 12) -> DataFrame:
    """Films with all that their pages show: stage, and as ordered arrays events (oldest first, with summary, whether it was edited, and sources of different outlets), release_dates,
    genres, production_companies, alternative_titles, cast and crew; collection is one struct or null.

    films: (film_id, title, original_title, status, origin, collection_id, ...); collections: (collection_id, name, poster_path). rows: (film_id, event, release, genre, company, title, credit), each but
    the film null where a row has none: structs of EVENT, RELEASE, (id, name) and CREDIT, and a text. A row can bear items of several kinds, so one table that tells them all is shuffled once, by film,
    and each film's items are cut and put in order where it is gathered. Equal genres, companies and titles of a film count once.
    """
    name_id = lambda x: [x["name"], x["id"]]
    rows = rows.withColumn("title", F.when(F.col("title").isNotNull(), F.struct(F.lower("title").alias("low"), "title")))
    each = rows.groupBy("film_id").agg(*(gather(c).alias(f"__{c}") for c, gather in (("event", F.collect_list), ("release", F.collect_list), ("genre", F.collect_set), ("company", F.collect_set), ("title", F.collect_set), ("credit", F.collect_list))))
    out = films.withColumns({"arc_stage": V.arc_stage(F.col("status")), "__a": F.lower("title"), "__b": F.lower("original_title")}).join(each, "film_id", "left")
    for c in each.columns[1:]:
        out = out.withColumn(c, F.coalesce(c, F.array().cast(each.schema[c].dataType)))
    shown = F.filter("__event", lambda e: P.visible_event(e["event_type"], hidden) & P.region_visible(e["event_type"], e["region"], F.col("origin"), home))
    shown = F.transform(shown, lambda e: e.withField("summary_edited", e["edited_at"].isNotNull()).withField("sources", F.coalesce(e["sources"], F.array().cast(each.schema["__event"].dataType.elementType["sources"].dataType))))
    dates = F.filter("__release", lambda r: P.displayable_release(r["release_type"], r["iso_3166_1"], F.col("origin"), home))
    dates = F.transform(dates, lambda r: F.struct(r["iso_3166_1"].alias("country"), r["release_type"].alias("release_type"), V.mapped(r["release_type"], V.RELEASE_LABEL).alias("type_label"), r["release_date"].alias("date"), r["certification"].alias("certification")))
    credited = lambda kind: F.filter("__credit", lambda c: c["credit_type"] == kind)
    out = out.select(
        *films.columns, "arc_stage",
        in_order(shown, lambda e: [e["created_at"], e["event_id"]], "event_id", "event_type", "confidence", "created_at", "summary", "summary_edited", "provenance", "sources").alias("events"),
        in_order(dates, lambda r: [r["date"], r["release_type"], r["country"], r["certification"]], "country", "release_type", "type_label", "date", "certification").alias("release_dates"),
        in_order(F.col("__genre"), name_id, "name").alias("genres"), in_order(F.col("__company"), name_id, "name").alias("production_companies"),
        F.transform(other_titles(F.col("__title"), F.col("__a"), F.col("__b")), lambda t: F.struct(t.alias("title"))).alias("alternative_titles"),
        in_order(credited("cast"), lambda c: [c["credit_order"].isNull(), c["credit_order"], c["name"], c["character"].isNull(), c["character"]], "name", "character", first=billed).alias("cast"),
        in_order(credited("crew"), lambda c: V.crew_keys(c["department"], c["job"], c["credit_order"], c["name"]), "name", "job", "department").alias("crew"))
    one = collections.select("collection_id", F.struct("name", "poster_path").alias("collection"))
    return out.join(one, "collection_id", "left").drop("collection_id")
