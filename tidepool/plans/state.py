"""Named queries over keyed state and time: held stories, windows that expire, heartbeats, streaks. Registered beside those of registry."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidepool.operators import audits, cards, decisions, metrics, runs
from tidepool.plans.registry import day_text, query
from tidepool.plans.views import pick, texts
from tidepool.sources.keyed_table import KeyedTable
from tidepool.streaming import keyed, streams

# What the watermark of a stream has passed when all is read: a time whose millisecond lies before the latest one less a day.


@query("""WITH r AS (SELECT *, event_type = 'purchase' AS change FROM events WHERE event_type = 'signup' OR (event_type = 'purchase' AND value > 60)),
    w AS (SELECT epoch_ms(max(ts)) - 86400000 AS mark FROM r), h AS (SELECT r.* FROM r, w WHERE NOT change AND epoch_ms(ts) < mark), c AS (SELECT r.* FROM r, w WHERE change AND epoch_ms(ts) < mark),
    x AS (SELECT h.user_id, h.event_id, h.ts, max((b.ts, b.event_id)) FILTER (b.ts <= h.ts) AS before, min((b.ts, b.event_id)) FILTER (b.ts > h.ts) AS after
        FROM h LEFT JOIN c b ON b.user_id = h.user_id AND b.ts BETWEEN h.ts - INTERVAL 14 DAY AND h.ts + INTERVAL 14 DAY GROUP BY ALL),
    o AS (SELECT *, CASE WHEN before IS NOT NULL THEN 'created' WHEN after IS NOT NULL THEN 'confirmed' WHEN epoch_ms(ts + INTERVAL 14 DAY) < mark THEN 'expired' END AS outcome FROM x, w)
    SELECT user_id, event_id AS story_id, outcome, CASE outcome WHEN 'created' THEN before[2] WHEN 'confirmed' THEN after[2] END AS change_id,
        strftime(CASE outcome WHEN 'created' THEN ts WHEN 'confirmed' THEN after[1] ELSE ts + INTERVAL 14 DAY END, '%Y-%m-%d %H:%M:%S') AS at FROM o WHERE outcome IS NOT NULL""")
def stream_holds(events):
    """Held stories: created where a change came before them, confirmed by the first one after, or expired after fourteen days."""
    def machine(s):
        rows = s.where("event_type = 'signup' OR (event_type = 'purchase' AND value > 60)")
        return keyed.run(rows, "user_id", "ts", F.when(F.col("event_type") == "purchase", "change").otherwise("story"), "event_id", keyed.Holds(14))

    return streams.run_table(events, machine).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query("""WITH RECURSIVE r AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'signup'), w AS (SELECT epoch_ms(max(ts)) - 86400000 AS mark FROM r),
    p AS (SELECT r.* FROM r, w WHERE epoch_ms(ts) < mark),
    n AS (SELECT a.user_id, a.event_id, a.ts, (SELECT min((b.ts, b.event_id)) FROM p b WHERE b.user_id = a.user_id AND b.ts > a.ts + INTERVAL 4 DAY) AS x FROM p a),
    k AS (SELECT user_id, min((ts, event_id)) AS x FROM p GROUP BY 1 UNION ALL SELECT k.user_id, n.x FROM k JOIN n ON n.user_id = k.user_id AND n.event_id = k.x[2] WHERE n.x IS NOT NULL)
    SELECT user_id, x[2] AS event_id, strftime(x[1], '%Y-%m-%d %H:%M:%S') AS at FROM k""")
def stream_once_in_window(events):
    """Beats that count once: the first of each user, and again once four days have gone by since the last that counted."""
    out = streams.run_table(events, lambda s: keyed.run(s.where("event_type = 'signup'"), "user_id", "ts", F.lit("beat"), "event_id", keyed.Once(4)))
    return out.select("user_id", F.col("ref").alias("event_id"), F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""WITH RECURSIVE w AS (SELECT epoch_ms(max(ts)) - 86400000 AS mark FROM events), p AS (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events, w WHERE epoch_ms(ts) < mark),
    q AS (SELECT p.* FROM p, w WHERE coalesce(next > ts + INTERVAL 12 HOUR, epoch_ms(ts + INTERVAL 12 HOUR) < mark)),
    s AS (SELECT *, max(ts) FILTER (gap) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 12 HOUR, true) AS gap FROM p)),
    n AS (SELECT a.user_id, a.event_id, a.run, (SELECT min((b.ts, b.event_id)) FROM s b WHERE b.user_id = a.user_id AND b.run = a.run AND b.ts >= a.ts + INTERVAL 3 HOUR) AS x FROM s a),
    k AS (SELECT user_id, run, (ts, event_id) AS x FROM s WHERE gap UNION ALL SELECT k.user_id, k.run, n.x FROM k JOIN n ON n.user_id = k.user_id AND n.event_id = k.x[2] WHERE n.x IS NOT NULL)
    SELECT user_id, x[2] AS event_id, 'heartbeat' AS beat, strftime(x[1], '%Y-%m-%d %H:%M:%S') AS at FROM k UNION ALL SELECT user_id, event_id, 'quiet', strftime(ts + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') FROM q""")
def stream_heartbeats(events):
    """Heartbeats of runs, at most one in three hours, and a time-out once a run has been quiet for twelve."""
    out = streams.run_table(events, lambda s: keyed.run(s, "user_id", "ts", F.lit("row"), "event_id", keyed.Beats(3 * 3600, 12 * 3600)))
    return out.select("user_id", F.col("ref").alias("event_id"), "beat", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


_GROUPS = """s AS (SELECT l_orderkey AS k, l_linenumber AS ln, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
    f AS (SELECT k, count(*) AS m, list(CASE ln % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'trusted' END ORDER BY n) AS t FROM s GROUP BY 1),
    x AS (SELECT *, k % 5 = 0 AS old, k % 7 = 0 AS cat, k % 2 = 0 AS even, CASE WHEN t[1] = 'low' THEN 'rumored' ELSE 'confirmed' END AS c1, CASE WHEN t[3] = 'low' THEN 'rumored' ELSE 'confirmed' END AS c3, CASE WHEN t[4] = 'low' THEN 'rumored' ELSE 'confirmed' END AS c4,
        CASE WHEN (t[5] = 'low' OR coalesce(t[6] = 'low', false)) AND NOT coalesce(t[5] = 'trusted', false) AND NOT coalesce(t[6] = 'trusted', false) THEN 'rumored' ELSE 'confirmed' END AS c6 FROM f)"""


@query(f"""WITH {_GROUPS}
    SELECT k AS film_id, 1 AS group_no, 'create' AS intent, CASE WHEN old THEN 'dedup_attach' ELSE 'create' END AS outcome, NULL AS note, CASE WHEN old THEN 'e' || k || 't' ELSE 'new:' || k || ':1' END AS event_ref, CASE WHEN NOT old THEN c1 END AS confidence, NULL AS names, 1 AS stories FROM x
    UNION ALL SELECT k, 2, 'create', CASE WHEN m = 1 THEN 'superseded' ELSE 'dedup_attach' END, NULL, CASE WHEN m > 1 THEN CASE WHEN old THEN 'e' || k || 't' ELSE 'new:' || k || ':1' END END, NULL, NULL, CASE WHEN m = 1 THEN 0 ELSE 1 END FROM x
    UNION ALL SELECT k, 3, 'create', CASE WHEN m = 2 THEN 'superseded' WHEN cat THEN 'catalog_attach' ELSE 'create' END, NULL, CASE WHEN m > 2 THEN CASE WHEN cat THEN 'e' || k || 'c' ELSE 'new:' || k || ':3' END END, CASE WHEN m > 2 AND NOT cat THEN c3 END,
        CASE WHEN m > 2 THEN CASE WHEN cat THEN 'ann' ELSE 'ann,bo' END END, CASE WHEN m = 2 THEN 0 ELSE 1 END FROM x WHERE m >= 2
    UNION ALL SELECT k, 4, 'create', CASE WHEN cat THEN 'catalog_attach' WHEN even THEN 'create' ELSE 'reject' END, CASE WHEN NOT cat AND NOT even THEN 'casting-recorded' END, CASE WHEN cat THEN 'e' || k || 'c' WHEN even THEN 'new:' || k || ':4' END, CASE WHEN even AND NOT cat THEN c4 END,
        CASE WHEN even THEN 'cy' WHEN cat THEN '' END, 1 FROM x WHERE m >= 4
    UNION ALL SELECT k, 3 + (m >= 2)::INT + (m >= 4)::INT, 'attach', 'superseded', NULL, NULL, NULL, NULL, 0 FROM x
    UNION ALL SELECT k, 6, 'create', 'create', NULL, 'new:' || k || ':6', c6, NULL, CASE WHEN m = 5 THEN 1 ELSE 2 END FROM x WHERE m >= 5
    UNION ALL SELECT k, 7, 'create', CASE WHEN m = 6 THEN 'superseded' ELSE 'dedup_attach' END, NULL, CASE WHEN m > 6 THEN 'new:' || k || ':6' END, NULL, NULL, CASE WHEN m = 6 THEN 0 ELSE 1 END FROM x WHERE m >= 6""")
def cluster_groups(orders, lineitem):
    """Replies of up to seven groups: later groups lose stories that earlier ones took, join events that earlier ones made, and know the names that earlier ones recorded."""
    k = F.col("o_orderkey")
    group = lambda kind, numbers, cast=None, existing="null": f'{{"type": "{kind}", "confidence": "confirmed", "stories": {numbers}, "existing": {existing}, "cast": {cast or "[]"}}}'
    first = [group("trailer", [1]), group("trailer", [1, 2]), group("casting", [2, 3], '["Ann", "Bo"]')]
    rest = [group("first_look", [1, 2, 3, 4], existing="1"), group("first_look", [5, 6]), group("first_look", [6, 7])]
    reply = lambda cast: '{"events": [' + ", ".join([*first, group("casting", [4], cast), *rest]) + "]}"
    # replies are wide: they are made once it is known which films have stories
    asked = orders.join(lineitem.select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi")
    films = asked.select(k.alias("film_id"), F.lit("Planned").alias("status"), F.lit(None).cast("date").alias("release_date"), F.lit(None).cast("timestamp").alias("changed_at"),
                          F.when(k % 2 == 0, reply('["Bo", "Cy"]')).otherwise(reply('["BO "]')).alias("reply"))
    rows = lineitem.groupBy(F.col("l_orderkey").alias("film_id"), "l_linenumber").agg(F.min("l_shipdate").alias("at"))
    stories = audits.latest_in_order(rows, ["film_id"], [F.asc("l_linenumber")], [F.asc("l_linenumber")], 100).select(
        "film_id", "n", (F.col("film_id") * 10 + F.col("l_linenumber")).alias("story_id"), "at", pick(F.col("l_linenumber") % 3, "low", "trusted", None).alias("tier"))
    event = lambda rows, position, ref, kind, origin, names: rows.select(k.alias("film_id"), F.lit(position).alias("position"), F.concat(F.lit("e"), k.cast("string"), F.lit(ref)).alias("event_ref"), F.lit(kind).alias("event_type"),
                                                                        F.lit(origin).alias("provenance"), F.lit(dt.datetime(1997, 12, 30)).alias("occurred_at"), names.cast("array<string>").alias("subject_key"))
    known = event(orders.where(k % 5 == 0), 1, "t", "trailer", "story", F.array()).unionByName(event(orders.where(k % 7 == 0), 2, "c", "casting", "catalog", F.array(F.lit("bo"))))
    out = decisions.cluster(stories, known, films, dt.date(1998, 1, 1))
    return out.select("film_id", "group_no", "intent", "outcome", "note", "event_ref", "confidence", texts("subject_key").alias("names"), F.size("story_ids").alias("stories"))


# --- tables that batches go into ---


def _catalog_batches(part):
    """Two batches of a catalog: the even parts, then every third part with a new price and, for some, a lower one."""
    rows = part.select("p_partkey", "p_name", F.col("p_retailprice").alias("price"))
    again = rows.where("p_partkey % 3 = 0").select("p_partkey", F.concat(F.lit("new "), "p_name").alias("p_name"), (F.col("price") + F.when(F.col("p_partkey") % 5 == 0, -1).when(F.col("p_partkey") % 7 == 0, 0).otherwise(1)).alias("price"))
    return rows.where("p_partkey % 2 = 0"), again


def _catalog_table(part):
    first, second = _catalog_batches(part)
    table = KeyedTable(part.sparkSession, streams.shared_folder(part.sparkSession), ["p_partkey"], first.schema, 16)
    higher = F.col("new_price") >= F.col("old_price")
    # each batch comes twice, and each of its rows too; the second time changes nothing
    counts = [table.upsert(b.unionByName(b), i, keep=("p_name",), when=higher) for i, b in ((0, first), (0, second), (1, second), (1, first), (0, second))]
    return table, counts


_CATALOG = """a AS (SELECT p_partkey, p_name, p_retailprice AS price FROM part WHERE p_partkey % 2 = 0),
    b AS (SELECT p_partkey, 'new ' || p_name AS p_name, p_retailprice + CASE WHEN p_partkey % 5 = 0 THEN -1 WHEN p_partkey % 7 = 0 THEN 0 ELSE 1 END AS price FROM part WHERE p_partkey % 3 = 0)"""


@query(f"""WITH {_CATALOG} SELECT p_partkey, coalesce(a.p_name, b.p_name) AS p_name, round(CASE WHEN a.price IS NULL OR b.price >= a.price THEN b.price ELSE a.price END, 4) AS price FROM a FULL JOIN b USING (p_partkey)""")
def upsert_rows(part):
    """A table after two batches that came more than once: names stay as first stored, prices only rise."""
    table, _ = _catalog_table(part)
    return table.rows().withColumn("price", F.round("price", 4))


@query(f"""WITH {_CATALOG}, j AS (SELECT a.p_partkey IS NOT NULL AS had, b.price > a.price AS more FROM b LEFT JOIN a USING (p_partkey)),
    x AS (SELECT (SELECT count(*) FROM a) AS n, count(*) FILTER (NOT had) AS i, count(*) FILTER (had AND more) AS u, count(*) FILTER (had AND NOT more) AS k FROM j)
    SELECT call::INTEGER AS call, CASE WHEN call < 2 THEN n ELSE i END AS inserted, CASE WHEN call < 2 THEN 0 ELSE u END AS updated, CASE WHEN call < 2 THEN 0 ELSE k END AS unchanged FROM x, range(5) r(call)""")
def upsert_counts(part):
    """What each call put in: a batch that comes again reports what it did the first time."""
    _, counts = _catalog_table(part)
    return part.sparkSession.createDataFrame([(i, c["inserted"], c["updated"], c["unchanged"]) for i, c in enumerate(counts)], "call int, inserted long, updated long, unchanged long")


@query("""WITH r AS (SELECT user_id, event_type, event_id, ts, CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 1 ELSE 2 END AS run FROM events WHERE event_type IN ('signup', 'error') AND value > 40),
    a AS (SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM r WHERE run = 1 AND ts >= TIMESTAMP '2024-01-13' GROUP BY ALL),
    b AS (SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM r WHERE ts >= TIMESTAMP '2024-01-18' AND ts < TIMESTAMP '2024-01-25' AND (user_id, event_type) NOT IN (SELECT user_id, event_type FROM a) GROUP BY ALL)
    SELECT *, 1 AS run FROM a UNION ALL SELECT *, 2 FROM b""")
def cards_reread(events):
    """Two runs over a change log, the second on the 25th, each reading the seven days before it: what the first carded is not carded again, older changes are never read."""
    log = events.where("event_type IN ('signup', 'error') AND value > 40").select(F.col("user_id").alias("film_id"), "event_type", F.col("ts").alias("changed_at"), F.col("event_id").alias("id"))
    schema = log.select("film_id", "event_type", "id", F.lit(1).alias("run")).schema
    table = KeyedTable(events.sparkSession, streams.shared_folder(events.sparkSession), ["film_id", "event_type"], schema, 8)
    for run, now in ((1, dt.datetime(2024, 1, 20)), (2, dt.datetime(2024, 1, 25)), (2, dt.datetime(2024, 1, 25))):
        seen = cards.lookback(log.where(F.col("changed_at") < F.lit(now)), now, 7)
        found = cards.once_per_entity(seen, table.rows())
        table.upsert(found.withColumn("run", F.lit(run)), run, ignore=True)
    return table.rows().select(F.col("film_id").alias("user_id"), "event_type", F.col("id").alias("event_id"), "run")


@query("""SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type IN ('signup', 'error') GROUP BY ALL""")
def stream_cards(events):
    """The change log as a stream, batch by batch into a table of cards: the earliest change of each film and kind, in whatever batches it came."""
    spark = events.sparkSession
    folder = streams.shared_folder(spark)
    table = KeyedTable(spark, f"{folder}/table", ["user_id", "event_type"], events.select("user_id", "event_type", "event_id", "ts").schema, 8)
    earlier = F.struct("new_ts", "new_event_id") < F.struct("old_ts", "old_event_id")
    write = table.batch_writer("cards", lambda b: b.where("event_type IN ('signup', 'error')"), order=[F.asc("ts"), F.asc("event_id")], when=earlier)
    streams.run_batches(events, write, f"{folder}/state")
    return table.rows().select("user_id", "event_type", "event_id")


# --- streaks, heartbeats and percentiles without a whole key in one task ---


@query("""WITH g AS (SELECT *, event_type = 'error' AS bad, event_type = 'signup' AS skip FROM events), i AS (SELECT *, sum(CASE WHEN NOT bad AND NOT skip THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id) AS island FROM g)
    SELECT event_id, sum(bad::INT) OVER (PARTITION BY island ORDER BY ts, event_id)::BIGINT AS streak FROM i""")
def streaks_of_all(events):
    """The streak up to each row over the whole log: one key holds every row, and its slices of a day share the work."""
    out = runs.streaks(events.withColumn("all", F.lit(1)), "all", ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "signup")
    return out.select("event_id", "streak")


@query("""WITH RECURSIVE e AS (SELECT CASE WHEN user_id % 3 = 0 THEN -1 ELSE user_id END AS k, ts FROM events), n AS (SELECT a.k, a.ts, (SELECT min(b.ts) FROM e b WHERE b.k = a.k AND b.ts >= a.ts + INTERVAL 6 HOUR) AS next FROM (SELECT DISTINCT k, ts FROM e) a),
    c AS (SELECT k, min(ts) AS ts FROM e GROUP BY 1 UNION ALL SELECT c.k, n.next FROM c JOIN n USING (k, ts) WHERE n.next IS NOT NULL)
    SELECT k, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM c""")
def heartbeats_throttled(events):
    """At most one heartbeat in six hours for each run; a third of all rows belong to one run."""
    log = events.select(F.when(F.col("user_id") % 3 == 0, -1).otherwise(F.col("user_id")).alias("k"), "ts")
    return runs.heartbeats(log, "k", "ts", 6 * 3600, 24 * 3600).select("k", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""SELECT event_type, quantile_disc(v, 0.5) AS middle, quantile_disc(v, 0.99) AS high FROM (SELECT event_type, CASE WHEN event_id % 50 = 0 THEN value * 1e13 WHEN event_id % 3 = 0 THEN 7 ELSE value END AS v FROM events) GROUP BY 1""")
def percentile_heavy_tail(events):
    """Percentiles where a few values are a million million times the others and a third are equal."""
    v = events.select("event_type", F.when(F.col("event_id") % 50 == 0, F.col("value") * 1e13).when(F.col("event_id") % 3 == 0, 7).otherwise(F.col("value")).alias("v"))
    each = lambda q, name: metrics.nearest_rank(v, "v", q, ["event_type"], 500).withColumnRenamed("v", name)
    return each(0.5, "middle").join(each(0.99, "high"), "event_type")
