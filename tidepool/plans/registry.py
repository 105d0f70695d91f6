"""The library's operators as named queries over whole tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import predicates as P
from tidepool.functions import text as X
from tidepool.functions import values as V
from tidepool.operators import cards, changes, decisions, feeds, metrics, retrieval, runs
from tidepool.sources import readers, sinks
from tidepool.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name; its arguments after the session are the tables it names."""
    def put(f):
        names = f.__code__.co_varnames[:f.__code__.co_argcount]

        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names))

        call.__name__, call.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = call
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f
    return put


def day_text(c: str):
    return F.date_format(c, "yyyy-MM-dd")


PRIORITY_RANK = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3, "5-LOW": 4}


# --- reading ---


@query("""
    WITH e AS (SELECT o_custkey AS film_id, o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS t FROM orders),
    d AS (SELECT DISTINCT day FROM e ORDER BY day DESC LIMIT 20 OFFSET 5),
    s AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
    SELECT e.film_id, CAST(e.day AS VARCHAR) AS day, count(*) AS n_events, string_agg(DISTINCT t, ',' ORDER BY t DESC) AS types, max(t) AS main_type,
           bool_or(s.l_orderkey IS NOT NULL) AS has_story, any_value(c_acctbal) AS popularity, any_value(c_name) AS slug, (SELECT count(DISTINCT day) FROM e) AS total_days
    FROM e JOIN d USING (day) JOIN customer ON c_custkey = e.film_id LEFT JOIN s ON s.l_orderkey = e.o_orderkey GROUP BY e.film_id, e.day""")
def feed_day_grouped(orders, customer, lineitem):
    """A page of days of a feed: each film and day with its types by significance."""
    events = orders.select(F.col("o_custkey").alias("film_id"), F.col("o_orderkey").alias("event_id"), V.utc_day(F.col("o_orderdate")).alias("day"), F.col("o_orderpriority").alias("event_type"))
    films = customer.select(F.col("c_custkey").alias("film_id"), F.col("c_acctbal").alias("popularity"), F.col("c_name").alias("slug"))
    stories = lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("event_id"))
    out = feeds.day_grouped_feed(events, films, stories, 20, 5, rank=lambda t: V.mapped(t, PRIORITY_RANK, -1))
    return out.withColumn("types", F.array_join("types", ",")).withColumn("day", day_text("day")).select("film_id", "day", "n_events", "types", "main_type", "has_story", "popularity", "slug", "total_days")


@query("""
    SELECT o_orderkey, o_custkey, c_name, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders JOIN customer ON c_custkey = o_custkey
    WHERE o_orderpriority <> '5-LOW' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100""")
def feed_flat_page(orders, customer):
    rows = orders.where(P.visible_event(F.col("o_orderpriority"), ("5-LOW",))).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return feeds.page(rows, [F.col("o_orderdate").desc_nulls_last(), F.asc("o_orderkey")], 50, 100).select("o_orderkey", "o_custkey", "c_name", day_text("o_orderdate").alias("day"))


@query("""
    WITH r AS (SELECT DISTINCT l_orderkey AS film_id, CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_returnflag = 'N' AND l_shipdate >= TIMESTAMP '1998-01-01'),
    p AS (SELECT DISTINCT day FROM r ORDER BY day LIMIT 10 OFFSET 2),
    n AS (SELECT l_orderkey AS film_id, string_agg(s_name, ', ' ORDER BY l_linenumber, s_name) AS directors FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)
    SELECT r.film_id, CAST(r.day AS VARCHAR) AS day, o_orderstatus AS status, n.directors FROM r JOIN p USING (day) JOIN orders ON o_orderkey = r.film_id LEFT JOIN n ON n.film_id = r.film_id""")
def calendar_page(lineitem, orders, supplier):
    releases = lineitem.where((F.col("l_returnflag") == "N") & (F.col("l_shipdate") >= "1998-01-01")).select(F.col("l_orderkey").alias("film_id"), V.utc_day(F.col("l_shipdate")).alias("day"))
    films = orders.select(F.col("o_orderkey").alias("film_id"), F.col("o_orderstatus").alias("status"))
    directors = lineitem.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("film_id"), F.col("l_linenumber").alias("credit_order"), F.col("s_name").alias("name"))
    return feeds.calendar(releases, films, directors, 10, 2).select("film_id", day_text("day").alias("day"), "status", "directors")


@query("SELECT c_name AS slug, strftime(max(o_orderdate), '%Y-%m-%d') AS lastmod FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority <> '5-LOW' GROUP BY c_custkey, c_name")
def sitemap_lastmod(orders, customer):
    events = orders.where(P.visible_event(F.col("o_orderpriority"), ("5-LOW",))).select(F.col("o_custkey").alias("film_id"), F.col("o_orderdate").alias("created_at"))
    return feeds.sitemap(events, customer.select(F.col("c_custkey").alias("film_id"), F.col("c_name").alias("slug")))


@query("""SELECT '<url><loc>https://example.org/films/' || c_name || '</loc><lastmod>' || strftime(max(o_orderdate), '%Y-%m-%d') || '</lastmod></url>' AS line
    FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_custkey, c_name""")
def sitemap_xml(orders, customer):
    events = orders.select(F.col("o_custkey").alias("film_id"), F.col("o_orderdate").alias("created_at"))
    return sinks.sitemap_lines(feeds.sitemap(events, customer.select(F.col("c_custkey").alias("film_id"), F.col("c_name").alias("slug"))), "https://example.org/films/")


@query("""SELECT p_partkey AS film_id, p_name AS title, p_retailprice AS popularity FROM part
    WHERE contains(regexp_replace(strip_accents(lower(p_name)), '[^a-z0-9]', '', 'g'), 'lbo') ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 40 OFFSET 5""")
def title_search_fold(part):
    films = part.select(F.col("p_partkey").alias("film_id"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("popularity"))
    return feeds.search(films, None, "L-Bó", 40, 5).drop("primary_match")


@query("""SELECT l_orderkey, rank, l_quantity, l_partkey FROM (SELECT l_orderkey, l_quantity, l_partkey,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC NULLS LAST, l_partkey) AS rank FROM lineitem) WHERE rank <= 3""")
def top3_billed(lineitem):
    return feeds.top_n(lineitem.select("l_orderkey", "l_quantity", "l_partkey"), ["l_orderkey"], [F.col("l_quantity").desc_nulls_last(), F.asc("l_partkey")], 3)


@query("""WITH f AS (SELECT lang, source, max(doc_id) AS doc_id FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL)
    SELECT lang, source, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS rank FROM f) WHERE rank <= 3""")
def topn_distinct_outlet(documents):
    rows = documents.where("lang IS NOT NULL AND source IS NOT NULL").select("lang", "source", "doc_id")
    return feeds.top_n_distinct(rows, ["lang"], X.outlet_key(F.col("source")), [F.desc("doc_id")], 3)


# --- text ---

_NORMAL = "lower(nfc_normalize(coalesce(text, '')))"
_STOP = "('the','a','an','of','and','or','to','in','on','at','for','part')"


def _tokens(normal: str) -> str:
    """SQL of the significant tokens of a text in normal form. A sign marks the places of an initialism's separators, from its first three letters on."""
    t = f"regexp_replace({normal}, '(^|[^\\p{{L}}\\p{{N}}])(\\p{{L}})[./](\\p{{L}})[./](\\p{{L}})', '\\1\\2\u2063\\3\u2063\\4', 'g')"
    for _ in range(12):
        t = f"regexp_replace({t}, '\u2063(\\p{{L}})[./]', '\u2063\\1\u2063', 'g')"
    return f"list_filter(regexp_extract_all(replace({t}, '\u2063', ''), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 1 AND w NOT IN {_STOP})"


# initials planted in every seventh text, so that the rule for them has work to do
_DOTTED = "CASE WHEN doc_id % 7 = 0 THEN regexp_replace(coalesce(text, ''), '([A-Za-z])([a-z])([a-z]) ', '\\1.\\2.\\3. ', 'g') ELSE text END"


@query(f"""WITH d AS (SELECT doc_id, {_DOTTED} AS text FROM documents), t AS (SELECT doc_id, {_tokens(_NORMAL)} AS w FROM d)
    SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct, md5(array_to_string(w, ' ')) AS tokens_md5 FROM t""")
def significant_tokens(documents):
    text = F.coalesce("text", F.lit(""))
    dotted = F.when(F.col("doc_id") % 7 == 0, F.regexp_replace(text, "([A-Za-z])([a-z])([a-z]) ", "$1.$2.$3. ")).otherwise(text)
    t = documents.select("doc_id", X.significant_tokens(X.lower_nfc(dotted)).alias("w"))
    return t.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.md5(F.array_join("w", " ")).alias("tokens_md5"))


@query(f"SELECT doc_id, md5(regexp_replace({_NORMAL}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS fold_md5 FROM documents")
def squash_fold(documents):
    return documents.select("doc_id", F.md5(X.squash_fold(X.lower_nfc(F.coalesce("text", F.lit(""))))).alias("fold_md5"))


def _catalog(pages):
    return pages.select(F.col("page_id").alias("film_id"), F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))


def _terms(documents):
    return retrieval.story_terms(documents.select(F.col("doc_id").alias("story_id"), F.lit("").alias("headline"), F.coalesce("text", F.lit("")).alias("dek")))


_TITLE = "lower(nfc_normalize(regexp_extract(html, '<title>(.*?)</title>', 1)))"
_SCORES = f"""
    t AS (SELECT page_id AS film_id, list_distinct({_tokens(_TITLE)}) AS w FROM pages),
    i AS (SELECT film_id, len(w) AS n, unnest(w) AS token FROM t),
    s AS (SELECT doc_id AS story_id, unnest(list_distinct({_tokens(_NORMAL)})) AS token FROM documents),
    sc AS (SELECT story_id, film_id, count(*) / any_value(n) AS score FROM s JOIN i USING (token) GROUP BY ALL),
    ov AS (SELECT *, count(*) OVER (PARTITION BY story_id) AS n_over, row_number() OVER (PARTITION BY story_id ORDER BY score DESC, film_id) AS rank FROM sc WHERE score >= 0.5)"""


@query(f"WITH {_SCORES} SELECT story_id, film_id, round(score, 6) AS score, n_over, rank FROM ov WHERE rank <= 47")
def candidate_topk(documents, pages):
    return retrieval.best_films(_terms(documents), retrieval.searchable_titles(_catalog(pages)), 0.5, 47).select("story_id", "film_id", F.round("score", 6).alias("score"), "n_over", "rank")


@query(f"""WITH {_SCORES}, p AS (SELECT doc_id, coalesce(max(n_over), 0) AS n_over FROM documents LEFT JOIN ov ON story_id = doc_id GROUP BY doc_id)
    SELECT count(*) AS n, count(*) FILTER (n_over = 0) AS zero, count(*) FILTER (n_over > 47) AS saturated, sum(least(n_over, 47))::BIGINT AS offered,
           round(count(*) FILTER (n_over = 0) / count(*), 6) AS zero_rate, round(count(*) FILTER (n_over > 47) / count(*), 6) AS saturation_rate, round(sum(least(n_over, 47)) / count(*), 6) AS mean_offered,
           count(*) >= 50 AND zero_rate > 0.1 AS hard_breach, count(*) >= 50 AND saturation_rate > 0.05 AS soft_breach FROM p""")
def retrieval_health(documents, pages):
    tally = retrieval.tallies(_terms(documents), retrieval.searchable_titles(_catalog(pages)), [0.5], most=48)
    told = retrieval.per_story_of(tally, documents.select(F.col("doc_id").alias("story_id")), 47)
    return retrieval.health(told).select("n", "zero", "saturated", "offered", *(F.round(c, 6).alias(c) for c in ("zero_rate", "saturation_rate", "mean_offered")), "hard_breach", "soft_breach")


@query(f"""WITH {_SCORES}, g AS (SELECT threshold, cap FROM (VALUES (0.5), (0.75), (1.0)) a(threshold), (VALUES (10), (47)) b(cap)),
    e AS (SELECT threshold, story_id, count(*) AS n FROM sc, (SELECT DISTINCT threshold FROM g) WHERE score >= threshold GROUP BY ALL)
    SELECT g.threshold::DOUBLE AS threshold, g.cap::INTEGER AS cap, (SELECT count(DISTINCT doc_id) FROM documents) AS n_stories, (SELECT count(DISTINCT doc_id) FROM documents) - count(e.story_id) AS zero,
           count(*) FILTER (e.n > g.cap) AS saturated, coalesce(sum(least(e.n, g.cap)), 0)::BIGINT AS offered FROM g LEFT JOIN e USING (threshold) GROUP BY ALL""")
def threshold_sweep(documents, pages):
    tally = retrieval.tallies(_terms(documents), retrieval.searchable_titles(_catalog(pages)), [0.5, 0.75, 1.0], most=48)
    return retrieval.sweep_of(tally, documents.select(F.col("doc_id").alias("story_id")), [0.5, 0.75, 1.0], [10, 47])


@query(f"""WITH {_SCORES}, k AS (SELECT page_id, row_number() OVER (ORDER BY page_id) AS n FROM pages), z AS (SELECT unnest([50, 100, 200]) AS size)
    SELECT size::INTEGER AS size, count(*) AS candidates FROM z JOIN k ON n <= size JOIN sc ON film_id = page_id WHERE score >= 0.5 GROUP BY size""")
def catalog_growth(documents, pages):
    films = _catalog(pages)
    known = P.having(films, retrieval.first_films(films, 200), "film_id")
    scores = retrieval.token_scores(_terms(documents), retrieval.searchable_titles(known), least=0.5)
    return retrieval.growth_curve(scores, films, [50, 100, 200])


@query("""WITH d AS (SELECT doc_id AS story_id, regexp_replace(lower(nfc_normalize(coalesce(text, ''))), '[^\\p{L}\\p{N}]+', '', 'g') AS fold FROM documents),
    b AS (SELECT item_id AS film_id, regexp_replace(lower(nfc_normalize(text)), '[^\\p{L}\\p{N}]+', '', 'g') AS f FROM benchmark)
    SELECT DISTINCT story_id, film_id FROM d JOIN b ON length(f) >= 6 AND contains(fold, f)""")
def squash_rescue(documents, benchmark):
    stories = documents.select(F.col("doc_id").alias("story_id"), F.lit("").alias("headline"), F.coalesce("text", F.lit("")).alias("dek"))
    titles = retrieval.searchable_titles(benchmark.select(F.col("item_id").alias("film_id"), F.col("text").alias("title")))
    return retrieval.rescued(retrieval.story_terms(stories), titles)


@query("""SELECT page_id, regexp_extract(lower(url), '://(?:www\\.)?([^/:?#]+)', 1) AS host, regexp_extract(lower(url), '://[^/]*?([^./]+\\.[^./]+)(?:[/?#]|$)', 1) AS domain,
    regexp_replace(url, '([?&](?:page|ref)=)[^&#\\s]*', '\\1REDACTED', 'g') AS redacted FROM pages""")
def domain_of_url(pages):
    return pages.select("page_id", X.bare_host(F.col("url")).alias("host"), X.registrable_domain(F.col("url")).alias("domain"), X.redact_url(F.col("url"), ("page", "ref")).alias("redacted"))


@query("""SELECT page_id, nullif(regexp_extract(t, '^.* - (.*)$', 1), '') AS outlet, nullif(regexp_extract(html, '\\slang="([^"]*)"', 1), '') AS lang
    FROM (SELECT page_id, html, regexp_extract(html, '<title>(.*?)</title>', 1) || ' - ' || regexp_extract(url, '://([^/]+)', 1) AS t FROM pages)""")
def outlet_suffix(pages):
    title = F.concat(F.regexp_extract("html", "<title>(.*?)</title>", 1), F.lit(" - "), F.regexp_extract("url", "://([^/]+)", 1))
    return pages.select("page_id", X.outlet_suffix(title).alias("outlet"), X.html_attribute(F.col("html"), "lang").alias("lang"))


# --- activity, changes and cards ---

_TODAY = dt.date(2024, 1, 20)
_FILMS = """f AS (SELECT c_custkey AS film_id, CASE WHEN c_custkey % 3 <> 0 THEN DATE '2024-01-01' + CAST(c_custkey % 40 AS INTEGER) END AS release_date,
    CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS status, TIMESTAMP '2023-12-01' + INTERVAL 1 DAY * CAST(c_custkey % 60 AS INTEGER) AS created_at FROM customer),
    c AS (SELECT user_id AS film_id, max(ts) AS t FROM events WHERE event_type = 'view' GROUP BY 1),
    s AS (SELECT user_id AS film_id, max(ts) AS t FROM events WHERE event_type = 'click' AND value > 20 GROUP BY 1),
    l AS (SELECT f.*, greatest(created_at, c.t, s.t) AS last_activity FROM f LEFT JOIN c USING (film_id) LEFT JOIN s USING (film_id)),
    a AS (SELECT *, (release_date IS NULL OR release_date >= DATE '2024-01-20') AND (status IS NULL OR status NOT IN ('BUILDING')) AS playing,
          release_date IS NULL AND CAST(last_activity AS DATE) < DATE '2024-01-20' - 10 AS dormant FROM l)"""


def _films(customer, events):
    k = F.col("c_custkey")
    films = customer.select(k.alias("film_id"), F.when(k % 3 != 0, F.date_add(F.lit(dt.date(2024, 1, 1)), (k % 40).cast("int"))).alias("release_date"), F.when(k % 7 != 0, F.col("c_mktsegment")).alias("status"),
                            (F.lit(dt.datetime(2023, 12, 1)) + F.make_dt_interval(days=(k % 60).cast("int"))).alias("created_at"))
    log = events.where("event_type = 'view'").select(F.col("user_id").alias("film_id"), F.col("ts").alias("changed_at"))
    stories = events.where("event_type = 'click' AND value > 20").select(F.col("user_id").alias("film_id"), F.lit(None).cast("timestamp").alias("linked_at"), F.col("ts").alias("created_at"))
    return P.last_activity(films, log, stories)


@query(f"WITH {_FILMS} SELECT film_id FROM a WHERE playing AND NOT dormant")
def active_set(customer, events):
    rows = _films(customer, events)
    return rows.where(P.active(F.col("release_date"), F.col("status"), F.col("last_activity"), _TODAY, 10, ("BUILDING",))).select("film_id")


@query(f"WITH {_FILMS} SELECT film_id, CAST(CAST(last_activity AS DATE) AS VARCHAR) AS last_day FROM a WHERE dormant")
def dormant_set(customer, events):
    return _films(customer, events).where(P.dormant(F.col("release_date"), F.col("last_activity"), _TODAY, 10)).select("film_id", day_text("last_activity").alias("last_day"))


@query(f"""WITH {_FILMS} SELECT film_id FROM a WHERE playing AND ((NOT dormant AND created_at < TIMESTAMP '2024-01-10') OR (dormant AND created_at < TIMESTAMP '2023-12-20'))""")
def refresh_due(customer, events):
    rows = _films(customer, events)
    playing, asleep = P.in_play(F.col("release_date"), F.col("status"), _TODAY, ("BUILDING",)), P.dormant(F.col("release_date"), F.col("last_activity"), _TODAY, 10)
    return rows.where(P.refresh_due(playing, F.lit(None).cast("timestamp"), asleep, F.col("created_at"), F.lit(dt.datetime(2023, 12, 20)), F.lit(dt.datetime(2024, 1, 10)))).select("film_id")


@query("SELECT user_id, event_type, max(event_id) FILTER (rn = 1) AS event_id, max(value) FILTER (rn = 1) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) GROUP BY ALL")
def latest_change(events):
    return changes.latest(events.select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query("""WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS p_size, CASE WHEN p_partkey % 11 <> 0 THEN p_brand END AS p_brand FROM part)
    SELECT p_partkey, 'p_size' AS field, CAST(o.p_size AS VARCHAR) AS old_value, CAST(n.p_size AS VARCHAR) AS new_value FROM part o JOIN n USING (p_partkey) WHERE o.p_size IS DISTINCT FROM n.p_size
    UNION ALL SELECT p_partkey, 'p_brand', '"' || o.p_brand || '"', '"' || n.p_brand || '"' FROM part o JOIN n USING (p_partkey) WHERE o.p_brand IS DISTINCT FROM n.p_brand""")
def field_change_cdc(part):
    new = part.withColumn("p_size", F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))).withColumn("p_brand", F.when(F.col("p_partkey") % 11 != 0, F.col("p_brand")))
    return changes.field_changes(part, new, "p_partkey", F.lit(dt.datetime(2024, 1, 1))).drop("changed_at")


@query("""WITH a AS (SELECT DISTINCT l_orderkey, l_suppkey, l_returnflag FROM lineitem WHERE l_linenumber <= 4), b AS (SELECT DISTINCT l_orderkey, l_suppkey, l_returnflag FROM lineitem WHERE l_linenumber >= 3),
    o AS (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus <> 'P')
    SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) SEMI JOIN o USING (l_orderkey) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) SEMI JOIN o USING (l_orderkey)""")
def snapshot_diff(lineitem, orders):
    identity = ["l_orderkey", "l_suppkey", "l_returnflag"]
    return changes.set_changes(lineitem.where("l_linenumber <= 4"), lineitem.where("l_linenumber >= 3"), orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", identity)


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, CAST(max(l_shipdate) AS DATE) AS d FROM lineitem WHERE l_orderkey % 3 <> 0 OR l_linenumber > 2 GROUP BY 1, 2),
    c AS (SELECT DISTINCT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) + CASE WHEN l_orderkey % 5 = 0 THEN 7 ELSE 0 END AS d FROM lineitem), o AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
    SELECT c.l_orderkey, c.l_linenumber, CAST(p.d AS VARCHAR) AS previous_date, CAST(c.d AS VARCHAR) AS new_date, CASE WHEN p.d IS NULL THEN 'set' ELSE 'moved' END AS change
    FROM c SEMI JOIN o ON o_orderkey = l_orderkey LEFT JOIN p USING (l_orderkey, l_linenumber) WHERE p.d IS DISTINCT FROM c.d""")
def date_moved(lineitem, orders):
    day = V.utc_day(F.col("l_shipdate"))
    old = lineitem.where("l_orderkey % 3 <> 0 OR l_linenumber > 2").select("l_orderkey", "l_linenumber", day.alias("d"))
    new = lineitem.select("l_orderkey", "l_linenumber", F.date_add(day, F.when(F.col("l_orderkey") % 5 == 0, 7).otherwise(0)).alias("d")).distinct()
    seen = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    out = changes.date_changes(old, new, seen, "l_orderkey", ["l_orderkey", "l_linenumber"], "d", "d")
    return out.select("l_orderkey", "l_linenumber", day_text("previous_date").alias("previous_date"), day_text("new_date").alias("new_date"), "change")


@query("SELECT url, min(page_id) AS page_id FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0) GROUP BY url")
def insert_ignore(pages):
    rows = pages.select("page_id", "url")
    return changes.insert_ignore(rows.where("page_id % 2 = 0"), rows.unionByName(rows), ["url"], [F.asc("page_id")])


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM (SELECT user_id, event_id, value, event_type = 'purchase' AS b, bool_or(event_type = 'purchase') OVER (PARTITION BY user_id) AS any_b FROM events) WHERE b = any_b GROUP BY user_id")
def upsert_last_wins(events):
    rows = events.select("user_id", "event_id", "value")
    kind = events["event_type"] == "purchase"
    return changes.upsert_last_wins(rows.where(~kind), rows.where(kind), ["user_id"], "event_id")


@query("""WITH o AS (SELECT p_partkey, p_size, p_brand FROM part WHERE p_partkey % 5 <> 0), n AS (SELECT p_partkey, p_size + 10 AS p_size, 'new' AS p_brand FROM part WHERE p_partkey % 2 = 0)
    SELECT p_partkey, CASE WHEN o.p_partkey IS NULL OR (n.p_partkey IS NOT NULL AND o.p_size < 25) THEN n.p_size ELSE o.p_size END AS p_size, CASE WHEN o.p_partkey IS NULL THEN n.p_brand ELSE o.p_brand END AS p_brand FROM o FULL JOIN n USING (p_partkey)""")
def conditional_upsert(part):
    old = part.where("p_partkey % 5 <> 0").select("p_partkey", "p_size", "p_brand")
    new = part.where("p_partkey % 2 = 0").select("p_partkey", (F.col("p_size") + 10).alias("p_size"), F.lit("new").alias("p_brand"))
    return changes.merge(old, new, ["p_partkey"], keep=("p_brand",), when=F.col("old_p_size") < 25)


@query("""SELECT event_id, user_id FROM events c WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'signup' AND e.user_id = c.user_id AND e.ts BETWEEN c.ts - INTERVAL 1 DAY AND c.ts + INTERVAL 1 DAY)
    AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'error' AND e.user_id = c.user_id AND e.ts = c.ts)""")
def interval_dedup(events):
    carded = events.where("event_type IN ('signup', 'error')").select("user_id", F.col("ts").alias("occurred_at"), F.when(F.col("event_type") == "signup", "story").otherwise("catalog").alias("provenance"))
    log = events.where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("changed_at"))
    return cards.interval_dedup(log, carded, 1, ["user_id"]).select("event_id", "user_id")


@query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE value > 80) GROUP BY ALL")
def once_per_entity(events):
    log = events.select(F.col("user_id").alias("film_id"), "event_type", F.col("ts").alias("changed_at"), F.col("event_id").alias("id"))
    done = events.where("value > 80").select(F.col("user_id").alias("film_id"), "event_type")
    return cards.once_per_entity(log, done).select(F.col("film_id").alias("user_id"), "event_type", F.col("id").alias("event_id"))


@query("""WITH m AS (SELECT l_orderkey AS event_id, l_shipdate AS t, l_returnflag = 'R' AS gone FROM lineitem), g AS (SELECT event_id, count(*) FILTER (NOT gone) AS n_left, count(*) FILTER (gone) AS n_out, min(t) FILTER (NOT gone) AS f FROM m GROUP BY 1)
    SELECT event_id, CASE WHEN n_left = 0 THEN 'delete' ELSE 'repair' END AS action, strftime(f, '%Y-%m-%d') AS day, n_left FROM g JOIN orders ON o_orderkey = event_id WHERE n_left = 0 OR n_out > 0 OR f > o_orderdate""")
def event_repair(orders, lineitem):
    members = lineitem.select(F.col("l_orderkey").alias("event_id"), F.concat_ws(":", "l_orderkey", "l_returnflag").alias("story_id"), F.col("l_shipdate").alias("at"))
    gone = lineitem.where("l_returnflag = 'R'").select(F.concat_ws(":", "l_orderkey", "l_returnflag").alias("story_id"))
    out = changes.event_repair(orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("occurred_at")), members, gone)
    return out.select("event_id", "action", day_text("occurred_at").alias("day"), "n_left")


@query("SELECT 'price' AS rule, count(*) FILTER (NOT p_retailprice >= 905) AS n FROM part UNION ALL SELECT 'size', count(*) FILTER (NOT p_size BETWEEN 1 AND 45) FROM part")
def constraint_violations(part):
    return changes.violations(part, {"price": F.col("p_retailprice") >= 905, "size": F.col("p_size").between(1, 45)})


@query("SELECT c_custkey, CASE WHEN row_number() OVER (PARTITION BY b ORDER BY c_custkey) = 1 THEN b ELSE b || '-' || c_custkey END AS slug FROM (SELECT c_custkey, lower(c_mktsegment) || '-' || c_nationkey AS b FROM customer)")
def slug_assignment(customer):
    return changes.slugs(customer, None, X.slugify(F.concat_ws(" ", "c_mktsegment", "c_nationkey")), "c_custkey")


# --- people ---

_ROLES = "CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 'director' WHEN l_returnflag = 'A' AND l_linenumber = 2 THEN 'writer' WHEN l_returnflag = 'N' AND l_linenumber < 5 THEN 'cast' END"


def _credits(lineitem):
    return lineitem.select(F.col("l_orderkey").alias("film_id"), F.col("l_suppkey").alias("person_id"), F.when(F.col("l_returnflag") == "A", "crew").when(F.col("l_returnflag") == "N", "cast").alias("credit_type"),
                           F.when(F.col("l_linenumber") == 1, "Director").when(F.col("l_linenumber") == 2, "Writer").alias("job"), F.col("l_linenumber").alias("credit_order"))


@query(f"SELECT DISTINCT l_suppkey AS person_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderstatus = 'O' AND {_ROLES} IS NOT NULL AND coalesce(s_acctbal, 1) >= 0")
def seed_people(lineitem, orders, supplier):
    people = supplier.select(F.col("s_suppkey").alias("person_id"), F.when(F.col("s_acctbal") < 0, F.lit(dt.datetime(2024, 1, 1))).alias("missing_at"))
    return cards.seed_people(_credits(lineitem), orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("film_id")), people)


_TALLY = f"""t AS (SELECT l_orderkey AS film_id, count(DISTINCT l_suppkey) AS n_people, concat_ws('|', CASE WHEN bool_or(role = 'director') THEN 'director' END, CASE WHEN bool_or(role = 'writer') THEN 'writer' END, CASE WHEN bool_or(role = 'cast') THEN 'cast' END) AS roles
    FROM (SELECT *, {_ROLES} AS role FROM lineitem) WHERE role IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1)"""


def _tally(lineitem, orders):
    found = cards.attachments(_credits(lineitem).withColumn("release_date", F.lit(None).cast("string")))
    return cards.tally(found, orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("film_id")))


@query(f"WITH {_TALLY} SELECT * FROM t")
def attachment_tally(lineitem, orders):
    return _tally(lineitem, orders)


@query(f"WITH {_TALLY} SELECT least(n_people, 3) AS people, count(*) AS films FROM t GROUP BY 1")
def attachment_histogram(lineitem, orders):
    return cards.histogram(_tally(lineitem, orders))


_VERDICT = f"""{_TALLY}, j AS (SELECT t.film_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'dated' WHEN o_orderstatus = 'P' THEN 'status:Released' WHEN o_custkey % 100 BETWEEN 1 AND 74 THEN 'runtime'
    WHEN n_people < 2 AND NOT contains(roles, 'director') THEN 'uncorroborated' ELSE 'admit' END AS verdict FROM t JOIN orders ON o_orderkey = film_id)"""


def _judged(lineitem, orders):
    o = orders.select(F.col("o_orderkey").alias("film_id"), F.when(F.col("o_orderpriority") == "1-URGENT", V.utc_day(F.col("o_orderdate"))).alias("release_date"),
                      F.when(F.col("o_orderstatus") == "P", "Released").alias("status"), (F.col("o_custkey") % 100).alias("runtime"))
    return cards.judged(_tally(lineitem, orders).join(o, "film_id"))


@query(f"WITH {_VERDICT} SELECT verdict, count(*) AS n FROM j GROUP BY 1")
def admission_verdicts(lineitem, orders):
    return _judged(lineitem, orders).groupBy("verdict").agg(F.count("*").alias("n"))


@query(f"WITH {_VERDICT} SELECT string_agg(verdict || '=' || n, ', ' ORDER BY verdict) AS reasons FROM (SELECT verdict, count(*) AS n FROM j GROUP BY 1)")
def skip_reasons(lineitem, orders):
    return cards.reason_text(_judged(lineitem, orders))


# --- decisions and evaluation ---


@query("""WITH s AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1), o AS (SELECT DISTINCT conv_id, turn AS rank, length(text) % 50 AS film FROM conversations WHERE role = 'user' AND conv_id % 6 <> 0),
    r AS (SELECT conv_id, turn AS seq, turn % 4 AS i, (length(text) % 100) / 100 AS c, CASE length(text) % 5 WHEN 0 THEN 'mention' WHEN 1 THEN 'not-news' ELSE 'about' END AS reason, CASE WHEN conv_id % 2 = 0 THEN 'roundup' ELSE 'odd' END AS category FROM conversations WHERE role = 'assistant'),
    l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY seq DESC) = 1)
    SELECT s.conv_id AS story_id, CASE WHEN n.conv_id IS NOT NULL AND reason = 'about' AND film IS NOT NULL AND c >= 0.3 THEN 'linked' ELSE 'rejected' END AS link_status, CASE WHEN n.conv_id IS NOT NULL AND reason = 'about' AND c >= 0.3 THEN film END AS film,
           CASE WHEN n.conv_id IS NULL THEN 'no-candidates' WHEN seq IS NULL THEN 'no-decision' WHEN reason = 'about' AND film IS NOT NULL AND c >= 0.3 THEN NULL WHEN reason = 'about' AND film IS NOT NULL THEN 'below-floor' WHEN film IS NULL THEN 'out-of-list'
                WHEN reason = 'mention' THEN 'mention' WHEN reason = 'not-news' THEN 'not-news' || CASE WHEN category = 'roundup' THEN ':roundup' ELSE '' END ELSE 'no-match' END AS note
    FROM s LEFT JOIN l USING (conv_id) LEFT JOIN (SELECT DISTINCT conv_id FROM o) n USING (conv_id) LEFT JOIN o ON o.conv_id = s.conv_id AND o.rank = l.i""")
def decision_apply(conversations):
    n = F.length("text")
    stories = conversations.select(F.col("conv_id").alias("story_id")).distinct()
    offered = conversations.where("role = 'user' AND conv_id % 6 <> 0").select(F.col("conv_id").alias("story_id"), F.col("turn").alias("rank"), (n % 50).cast("long").alias("film")).distinct()
    replies = conversations.where("role = 'assistant'").select(
        F.col("conv_id").alias("story_id"), F.col("turn").alias("seq"), (F.col("turn") % 4).alias("film_index"), ((n % 100) / 100).alias("confidence"),
        F.when(n % 5 == 0, "mention").when(n % 5 == 1, "not-news").otherwise("about").alias("reason"), F.when(F.col("conv_id") % 2 == 0, "roundup").otherwise("odd").alias("category"))
    return decisions.apply_links(stories, replies, offered, 0.3)


_PRF = "tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"


def _rounded(df, *names):
    return df.select(*(F.round(c, 6).alias(c) if c in names else c for c in df.columns))


@query(f"""WITH c AS (SELECT count(*) FILTER (e IS NOT NULL AND p IS NOT DISTINCT FROM e) AS tp, count(*) FILTER (p IS NOT NULL AND p IS DISTINCT FROM e) AS fp, count(*) FILTER (e IS NOT NULL AND p IS DISTINCT FROM e) AS fn
    FROM (SELECT CASE WHEN quality = 1 THEN doc_id % 5 END AS p, CASE WHEN toxic = 0 THEN doc_id % 7 % 5 END AS e FROM labels)) SELECT {_PRF} FROM c""")
def link_prf(labels):
    rows = labels.select(F.when(F.col("quality") == 1, F.col("doc_id") % 5).alias("p"), F.when(F.col("toxic") == 0, F.col("doc_id") % 7 % 5).alias("e"))
    return _rounded(metrics.prf(rows, F.col("e"), F.col("p")), "precision", "recall", "f1")


@query(f"""WITH c AS (SELECT floor, count(*) FILTER (e IS NOT NULL AND q IS NOT DISTINCT FROM e) AS tp, count(*) FILTER (q IS NOT NULL AND q IS DISTINCT FROM e) AS fp, count(*) FILTER (e IS NOT NULL AND q IS DISTINCT FROM e) AS fn
    FROM (SELECT f.floor, e, CASE WHEN k >= f.floor THEN p END AS q FROM (SELECT doc_id % 5 AS p, CASE WHEN toxic = 0 THEN doc_id % 7 % 5 END AS e, (doc_id % 100) / 100 AS k FROM labels), (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.9)) f(floor)) GROUP BY floor)
    SELECT floor, {_PRF} FROM c""")
def floor_sweep(labels):
    rows = labels.select((F.col("doc_id") % 5).alias("p"), F.when(F.col("toxic") == 0, F.col("doc_id") % 7 % 5).alias("e"), ((F.col("doc_id") % 100) / 100).alias("k"))
    return _rounded(metrics.floor_sweep(rows, "e", "p", "k", [0.0, 0.25, 0.5, 0.9]), "precision", "recall", "f1")


@query("""SELECT count(*) AS clusters, sum(n)::BIGINT AS rows, round(sum(top) / sum(n), 6) AS purity FROM (SELECT source, max(n) AS top, sum(n) AS n FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source)""")
def cluster_purity(documents):
    return _rounded(metrics.purity(documents, "source", "lang"), "purity")


@query("""WITH p AS (SELECT a.source = b.source AS s, a.lang = b.lang AS g FROM labels x JOIN documents a USING (doc_id) JOIN labels y ON y.doc_id < x.doc_id JOIN documents b ON b.doc_id = y.doc_id),
    c AS (SELECT count(*) FILTER (s AND g) AS both_pairs, count(*) FILTER (s) AS pred_pairs, count(*) FILTER (g) AS true_pairs FROM p)
    SELECT *, round(both_pairs / pred_pairs, 6) AS precision, round(both_pairs / true_pairs, 6) AS recall, round(2 * both_pairs / (pred_pairs + true_pairs), 6) AS f1 FROM c""")
def cluster_pairwise(documents, labels):
    rows = P.having(documents, labels, "doc_id")
    return _rounded(metrics.pairwise(rows, "doc_id", "source", "lang"), "precision", "recall", "f1")


@query("SELECT coalesce(lang, 'other') AS category, count(*) AS n FROM labels JOIN documents USING (doc_id) WHERE quality = 1 AND toxic <> 0 GROUP BY 1")
def news_value_leaks(labels, documents):
    return metrics.leaks(labels.join(documents.select("doc_id", "lang"), "doc_id"), F.col("quality") == 1, F.col("toxic") == 0, "lang")


@query("""WITH d AS (SELECT doc_id, source, CASE WHEN source LIKE 'src1%' THEN 'feed' ELSE 'search' END AS bucket, lang = 'en' AS linked, length(coalesce(text, '')) % 97 AS ev FROM documents),
    u AS (SELECT ev FROM d WHERE linked GROUP BY ev HAVING NOT bool_or(source IN ('src1', 'src2'))),
    e AS (SELECT source, bucket, count(DISTINCT d.ev) AS events, count(DISTINCT u.ev) AS unique_events FROM d LEFT JOIN u USING (ev) WHERE linked GROUP BY ALL),
    r AS (SELECT source, bucket, count(*) AS volume, count(*) FILTER (linked) AS linked FROM d GROUP BY ALL),
    b AS (SELECT r.*, coalesce(events, 0) AS events, coalesce(unique_events, 0) AS unique_events FROM r LEFT JOIN e USING (source, bucket))
    SELECT bucket, source, sum(volume)::BIGINT AS volume, sum(linked)::BIGINT AS linked, sum(events)::BIGINT AS events, sum(unique_events)::BIGINT AS unique_events, round(100 * sum(volume) / (SELECT count(*) FROM d), 4) AS cost
    FROM b GROUP BY GROUPING SETS ((bucket, source), (bucket))""")
def source_roi(documents):
    d = documents.select(F.col("doc_id").alias("story_id"), "source", (F.col("lang") == "en").alias("linked"), (F.length(F.coalesce("text", F.lit(""))) % 97).alias("event_id"))
    out = metrics.source_return(d.drop("event_id"), d.where("linked").select("story_id", "event_id"), ["src1", "src2"], 100.0, F.when(F.col("source").startswith("src1"), "feed").otherwise("search"))
    return out.withColumn("cost", F.round("cost", 4))


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1), s AS (SELECT *, n * 137 / sum(n) OVER () AS share FROM c), f AS (SELECT *, floor(share)::BIGINT AS fl FROM s)
    SELECT source, n, fl + CASE WHEN row_number() OVER (ORDER BY share - fl DESC, source) <= 137 - sum(fl) OVER () THEN 1 ELSE 0 END AS quota FROM f""")
def quota_largest_remainder(documents):
    counts = documents.where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("n"))
    return metrics.quotas(counts, 137, "source")


@query("SELECT lang, doc_id, place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('seed7' || doc_id), doc_id) AS place FROM documents) WHERE place <= 5")
def hash_sample(documents):
    return metrics.hash_sample(documents.select("lang", "doc_id"), "lang", "doc_id", "seed7", 5).select("lang", "doc_id", "place")


@query("SELECT event_type, quantile_disc(value, 0.9) AS value FROM events GROUP BY 1")
def percentile_nearest_rank(events):
    return metrics.nearest_rank(events, "value", 0.9, ["event_type"])


_CALLS = """t AS (SELECT conv_id, role, turn, length(coalesce(text, '')) AS input_tokens, length(coalesce(text, '')) // 4 AS output_tokens, turn % 2 = 0 AS batch FROM conversations)"""


def _calls(conversations):
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    return conversations.select("conv_id", "role", "turn", n.alias("input_tokens"), F.floor(n / 4).alias("output_tokens"), F.lit(0).cast("long").alias("cache_read_tokens"), F.lit(0).cast("long").alias("cache_write_tokens"), (F.col("turn") % 2 == 0).alias("batch"))


@query(f"WITH {_CALLS} SELECT role, round(sum((input_tokens * i + output_tokens * o) * CASE WHEN batch THEN 0.5 ELSE 1 END / 1e6), 3) AS cost FROM t JOIN (VALUES ('user', 1.0::DOUBLE, 5.0::DOUBLE), ('assistant', 3.0, 15.0), ('system', 0.14, 0.28)) r(role, i, o) USING (role) GROUP BY role")
def call_cost(conversations):
    rates = conversations.sparkSession.createDataFrame([("user", 1.0, 5.0, 1.25, 0.1), ("assistant", 3.0, 15.0, 1.25, 0.1), ("system", 0.14, 0.28, 1.0, 0.02)], "role string, input double, output double, write_mult double, read_mult double")
    return metrics.call_cost(_calls(conversations), rates, ["role"]).groupBy("role").agg(F.round(F.sum(F.col("cost_usd").cast("double")), 3).alias("cost"))


@query(f"WITH {_CALLS} SELECT role, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM t GROUP BY 1")
def usage_by_stage(conversations):
    return runs.usage_by(_calls(conversations), "role").drop("cache_read_tokens", "cache_write_tokens")


# --- runs and streams ---


@query("""WITH g AS (SELECT user_id, ts, event_id, event_type = 'error' AS bad, sum(CASE WHEN event_type NOT IN ('error', 'signup') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events)
    SELECT user_id, max(n)::BIGINT AS longest FROM (SELECT user_id, island, count(*) FILTER (bad) AS n FROM g GROUP BY ALL) GROUP BY user_id""")
def failure_streaks(events):
    return runs.longest_streak(events, "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "signup")


@query("SELECT user_id FROM events GROUP BY user_id HAVING NOT bool_or(event_type = 'signup' AND value > 150) AND max(ts) < TIMESTAMP '2024-01-30 18:00:00'")
def stale_runs(events):
    log = runs.run_state(events, "user_id", "ts", (F.col("event_type") == "signup") & (F.col("value") > 150))
    return runs.stale(log, F.lit(dt.datetime(2024, 1, 30, 18))).select("user_id")


@query("SELECT event_id, in_window FROM (SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_window FROM events) WHERE in_window > 5")
def rate_audit(events):
    return runs.rate_audit(events, "event_type", "ts", 3600, 5).where("over").select("event_id", "in_window")


@query("""WITH b AS (SELECT min((p_retailprice * -1, p_partkey)) AS e FROM part WHERE p_retailprice < 950) SELECT p_partkey FROM part, b WHERE (p_retailprice * -1, p_partkey) < e""")
def take_while_floor(part):
    rows = part.withColumn("__down", F.col("p_retailprice") * -1)
    return readers.take_while(rows, ["__down", "p_partkey"], F.col("p_retailprice") >= 950).select("p_partkey")


# A stream gives what its watermark has closed: windows that end by the latest time less the delay.


@query("""WITH w AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events)
    SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS total FROM events, w WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= mark GROUP BY 1, 2""")
def stream_day_rollup(events):
    out = streams.run_table(events, lambda s: streams.day_rollup(s, ["user_id"], "ts"))
    return out.select("user_id", day_text("day").alias("day"), "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM i GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_sessions(events):
    """Runs of progress with less than half an hour between rows: a run whose session has closed is stale."""
    out = streams.run_table(events, lambda s: streams.sessions(s, "user_id", "ts"))
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("""WITH w AS (SELECT epoch_us(max(ts)) // 1000 - 60000 AS mark FROM events), s AS (SELECT unnest(range(0, 10)) AS k), b AS (SELECT epoch_us(ts) // 60000000 - k AS m FROM events, s)
    SELECT strftime(make_timestamp(m * 60000000), '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM b, w WHERE (m + 10) * 60000 <= mark GROUP BY m""")
def stream_sliding_counts(events):
    """Calls in sliding windows, the audit of a rate limit."""
    out = streams.run_table(events, lambda s: streams.sliding_counts(s, "ts", "10 minutes", "1 minute"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query("SELECT user_id, event_type FROM events WHERE event_type IN ('signup', 'error') GROUP BY ALL")
def stream_singular_beats(events):
    """Beats that count once: the first of each user and kind, within a horizon longer than the table."""
    rows = events.where("event_type IN ('signup', 'error')")
    return streams.run_table(rows, lambda s: streams.once_within(s.where("event_type IN ('signup', 'error')"), ["user_id", "event_type"], "ts", "400 days")).select("user_id", "event_type")


@query("""SELECT h.event_id AS held, c.event_id AS change FROM events h JOIN events c ON h.user_id = c.user_id AND h.event_type = 'signup' AND c.event_type = 'purchase' AND c.ts BETWEEN h.ts - INTERVAL 4 DAY AND h.ts + INTERVAL 4 DAY""")
def stream_confirmed_holds(events):
    """Held rows that a change confirms within four days, before or after: a stream joined to a stream; what isn't met in time leaves the state."""
    def holds(s):
        held = s.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("held"), F.col("ts").alias("held_at"))
        moved = s.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("change"), F.col("ts").alias("changed_at"))
        return streams.confirmed_holds(held, moved, "user_id", 4, ("change",))

    return streams.run_table(events, holds).select("held", "change")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'view' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 4 DAY")
def stream_link_window(events):
    """Rows that are still within the window of four days when all has been read; what is older is lost."""
    last = events.agg(F.max("ts").alias("last"))
    out = streams.run_table(events, lambda s: s.where("event_type = 'view'").select("event_id", "user_id", "ts"))
    return streams.within_window(out, last, "ts", 4).select("event_id", "user_id")


from tidepool.plans import views, lookups, state  # noqa: E402, F401, I001  register their queries here
