"""Sources: payload documents, feeds, enumerations, labelled sets. Schemas are declared, never inferred."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOVIE = (
    "id int, title string, original_title string, release_date string, status string, overview string, poster_path string, imdb_id string, popularity double, "
    "original_language string, adult boolean, budget bigint, homepage string, revenue bigint, runtime int, tagline string, vote_average double, vote_count int, origin_country array<string>, "
    "genres array<struct<id:int,name:string>>, production_companies array<struct<id:int,name:string>>, belongs_to_collection struct<id:int,name:string>, "
    "release_dates struct<results:array<struct<iso_3166_1:string,release_dates:array<struct<certification:string,note:string,release_date:string,type:int>>>>>, "
    "alternative_titles struct<titles:array<struct<iso_3166_1:string,title:string,type:string>>>, "
    "credits struct<cast:array<struct<id:int,name:string,credit_id:string,character:string,`order`:int>>,crew:array<struct<id:int,name:string,credit_id:string,department:string,job:string>>>")
PERSON = "id int, cast array<struct<id:int,title:string,release_date:string,credit_id:string,character:string,`order`:int>>, crew array<struct<id:int,title:string,release_date:string,credit_id:string,department:string,job:string>>"
LABEL = "url string, source string, title string, summary string, relation string, expected_film_tmdb_id int, event_type string, event_group string, is_production_news boolean, exclusion_category string"
#: Keys of a feed entry that are kept as they came.
RAW_KEYS = ("title", "link", "summary", "published", "updated", "id", "author", "source")


def _read(payloads: DataFrame, column: str) -> DataFrame:
    return payloads.select(F.from_json(column, MOVIE + ", __bad string", {"columnNameOfCorruptRecord": "__bad"}).alias("m"), column)


def malformed(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """The documents that movies drops."""
    return _read(payloads, column).where("m IS NULL OR m.__bad IS NOT NULL").select(column)


def movies(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Movie documents; empty dates become null, unknown fields are ignored, malformed documents are dropped (see malformed)."""
    return _read(payloads, column).where("m IS NOT NULL AND m.__bad IS NULL").select("m.*", F.col(column).alias("raw")).drop("__bad").withColumn("release_date", F.try_to_date(F.nullif("release_date", F.lit(""))))


def _credit_rows(m: DataFrame) -> DataFrame:
    cast = m.select(F.col("id").alias("film_id"), F.posexplode("credits.cast").alias("position", "c")).select("film_id", "position", F.col("c.id").alias("person_id"), "c.name", "c.credit_id", F.lit("cast").alias("credit_type"), "c.character", F.lit(None).cast("string").alias("job"), F.lit(None).cast("string").alias("department"), F.col("c.order").alias("credit_order"))
    crew = m.select(F.col("id").alias("film_id"), F.posexplode("credits.crew").alias("position", "c")).select("film_id", "position", F.col("c.id").alias("person_id"), "c.name", "c.credit_id", F.lit("crew").alias("credit_type"), F.lit(None).cast("string").alias("character"), "c.job", "c.department", F.lit(None).cast("int").alias("credit_order"))
    return cast.unionByName(crew)


def movie_credits(m: DataFrame) -> DataFrame:
    """(film, person_id, name, credit_id, credit_type, character, job, department, credit_order), each credit_id once: the one seen first, cast before crew, each in its own order, then the lesser film id. Credits without an id or a person are dropped."""
    rows = _credit_rows(m).where("credit_id IS NOT NULL AND person_id IS NOT NULL")
    return rows.groupBy("credit_id").agg(F.min(F.struct("credit_type", "position", "film_id", "person_id", "name", "character", "job", "department", "credit_order")).alias("s")).select("credit_id", "s.*").drop("position")


def movie_people(m: DataFrame) -> DataFrame:
    """(person_id, name): each person once, with the name seen first, in cast before crew, each in its own order, then of the lesser film id."""
    rows = _credit_rows(m).where("person_id IS NOT NULL AND name IS NOT NULL")
    return rows.groupBy("person_id").agg(F.min(F.struct("credit_type", "position", "film_id", "name")).alias("s")).select("person_id", "s.name")


def movie_release_dates(m: DataFrame) -> DataFrame:
    """Two nested levels made flat; entries without a date are dropped."""
    return (m.select(F.col("id").alias("film_id"), F.explode("release_dates.results").alias("r")).select("film_id", "r.iso_3166_1", F.posexplode("r.release_dates").alias("position", "d"))
            .select("film_id", "iso_3166_1", "position", F.col("d.type").alias("release_type"), F.try_to_timestamp(F.nullif("d.release_date", F.lit(""))).alias("release_date"), "d.certification").where("release_date IS NOT NULL"))


def filmographies(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(person_id, film_id, title, release_date, credit_type, job, credit_order) of both arrays."""
    p = payloads.select(F.from_json(column, PERSON).alias("p"))
    each = lambda kind, job, order: p.select(F.col("p.id").alias("person_id"), F.explode(f"p.{kind}").alias("c")).select("person_id", F.col("c.id").alias("film_id"), "c.title", "c.release_date", F.lit(kind).alias("credit_type"), job.alias("job"), order.alias("credit_order"))
    return each("cast", F.lit(None).cast("string"), F.col("c.order")).unionByName(each("crew", F.col("c.job"), F.lit(None).cast("int")))


def take_while(df: DataFrame, order: list[str], ok) -> DataFrame:
    """The rows before the first, in order, that isn't ok; a null counts as not ok. One aggregate finds that row's place, no sort is needed."""
    bad = df.where(~F.coalesce(ok, F.lit(False))).agg(F.min(F.struct(*order)).alias("__end"))  # one row
    return df.join(F.broadcast(bad)).where(F.col("__end").isNull() | (F.struct(*order) < F.col("__end"))).drop("__end")


def feed_time(text: Column) -> Column:
    """A feed's time: ISO 8601, or as in mail (RFC 822), with a numeric zone, GMT, UT, UTC or Z, or a North American zone; null for anything else."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    for name, offset in (("GMT|UTC|UT|Z", "+0000"), ("EST|CDT", "-0500"), ("EDT", "-0400"), ("CST|MDT", "-0600"), ("MST|PDT", "-0700"), ("PST", "-0800")):
        bare = F.regexp_replace(bare, rf" (?:{name})$", f" {offset}")
    mail = F.coalesce(*(F.try_to_timestamp(F.when(bare.rlike(r"^\d{1,2} [A-Z][a-z]{2} \d{4} "), bare), F.lit(p)) for p in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z")))
    return F.coalesce(F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-"), text)), mail)


def feed_entries(raw: DataFrame, now: dt.datetime, days: int = 3, source: str = "source", entry: str = "entry") -> DataFrame:
    """Entries with a url and a title: published, else updated, else null; those older than days go, undated ones stay; eight raw keys are kept."""
    e = F.col(entry)  # map<string,string>
    at = F.coalesce(feed_time(e["published"]), feed_time(e["updated"]))
    rows = raw.select(source, e["link"].alias("url"), e["title"].alias("title"), at.alias("published_at"), F.map_filter(e, lambda k, v: k.isin(*RAW_KEYS) & v.isNotNull()).alias("raw"))
    cutoff = F.lit(now - dt.timedelta(days=days))
    return rows.where((F.length("url") > 0) & (F.length("title") > 0) & (F.col("published_at").isNull() | (F.col("published_at") >= cutoff)))


def feed_list(spark: SparkSession, fixed: list[tuple[str, str]], extra: list[tuple[str, str]], with_extra: bool) -> DataFrame:
    """(name, url) of the feeds to read, and the extra queries only when they are switched on."""
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(fixed)], "position int, name string, url string")
    more = spark.createDataFrame([(len(fixed) + i, *x) for i, x in enumerate(extra)], "position int, name string, url string")
    return rows.unionByName(more.where(F.lit(with_extra)))


def atom_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom files, by Spark's XML reader: (link, title, published, updated, summary, id); the first link that is no other relation."""
    rows = spark.read.option("rowTag", "entry").schema("title string, link array<struct<_href:string,_rel:string>>, published string, updated string, summary string, id string").xml(path)
    own = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    return rows.withColumn("link", F.get(own, F.lit(0))["_href"])


def rss_entries(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files, by Spark's XML reader: (link, title, pubDate, description, guid)."""
    return spark.read.option("rowTag", "item").schema("link string, title string, pubDate string, description string, guid string").xml(path)


def search_sources(films: DataFrame, prefix: str, title: str = "title") -> DataFrame:
    """A search url for each title."""
    return films.select(F.concat(F.lit(prefix), F.replace(F.url_encode(F.concat(F.lit('"'), F.col(title), F.lit('"'))), F.lit("+"), F.lit("%20"))).alias("url"), F.concat(F.lit("Search: "), F.col(title)).alias("source"))


def labelled(texts: DataFrame, column: str = "value") -> DataFrame:
    """Labelled rows from documents of either shape: a bare list, or an object with items and as_of_date."""
    bare = F.from_json(column, f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in LABEL.split(', '))}>>")
    wrapped = F.from_json(column, f"as_of_date date, items array<struct<{', '.join(c.replace(' ', ':', 1) for c in LABEL.split(', '))}>>")
    is_list = F.ltrim(F.col(column)).startswith("[")
    return texts.select(F.when(~is_list, wrapped["as_of_date"]).alias("as_of_date"), F.explode(F.when(is_list, bare).otherwise(wrapped["items"])).alias("i")).select("as_of_date", "i.*")


def catalog_export(films: DataFrame, alternatives: DataFrame, film: str = "film_id", title: str = "title", original: str = "original_title") -> DataFrame:
    """Each film's titles with its distinct other titles in order."""
    other = alternatives.groupBy(film).agg(F.array_sort(F.collect_set(title)).alias("alternative_titles"))
    return films.select(film, title, original).join(other, film, "left").withColumn("alternative_titles", F.coalesce("alternative_titles", F.array().cast("array<string>")))
