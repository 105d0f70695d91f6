"""Replies of a classifier applied to stories, source tiers, and the clustering of a film's stories into events."""

from __future__ import annotations

import datetime as dt
import json
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import values as V
from tidepool.functions.predicates import EARLY_TYPES

CATEGORIES = ("reaction", "roundup", "streaming-move", "interview-quote", "downstream")
EVENT_TYPES = ("announced", "casting", "production_start", "production_wrap", "release_date", "trailer", "first_look", "other")
SINGULAR = ("trailer", "first_look")
ONCE = ("production_start", "production_wrap")
CREDIT_TYPES = ("casting", "crew_attached")
REPLY = "array<struct<id:string,film:bigint,confidence:double,reason:string,category:string>>"


def parsed_replies(replies: DataFrame, text: str = "text", call: str = "call_id") -> DataFrame:
    """(call, position, id, film, confidence, reason, category) of each array found in a reply; a malformed one gives no rows (see reply_faults)."""
    from tidepool.functions.text import json_span

    return replies.select(call, F.posexplode(F.from_json(json_span(F.col(text), array=True), REPLY)).alias("position", "r")).select(call, "position", "r.*")


def fault_of(text: Column) -> Column:
    """What is wrong with a reply: no-array, malformed (no JSON, or one broken off) or not-decisions (an array of anything but objects); null if nothing is. An empty array is an answer."""
    from tidepool.functions.text import json_span

    span = json_span(text, array=True)
    value = F.try_parse_json(span)
    kind = F.schema_of_variant(value)
    return F.when(span.isNull(), "no-array").when(value.isNull(), "malformed").when(~kind.startswith("ARRAY<OBJECT") & (kind != "ARRAY<VOID>"), "not-decisions")


def reply_faults(replies: DataFrame, text: str = "text", call: str = "call_id") -> DataFrame:
    """(call, fault) of the replies that can't be read: calls to be made again."""
    return replies.select(call, fault_of(F.col(text)).alias("fault")).where("fault IS NOT NULL")


def answered_calls(replies: DataFrame, started: str = "started_at", finished: str = "finished_at", text: str = "text", call: str = "call_id") -> DataFrame:
    """(call, fault, n_decisions, latency_ms, and the four token counts, 0 where the reply tells none): what each call of a classifier gave and cost."""
    from tidepool.functions.text import json_span

    fault = fault_of(F.col(text))
    n = F.when(fault.isNull(), F.size(F.from_json(json_span(F.col(text), array=True), REPLY))).otherwise(0)
    tokens = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")]
    latency = ((F.unix_micros(finished) - F.unix_micros(started)) / 1000).cast("long")
    return replies.select(call, fault.alias("fault"), n.cast("long").alias("n_decisions"), latency.alias("latency_ms"), *tokens)


def apply_links(stories: DataFrame, replies: DataFrame, offered: DataFrame, floor: float, *, story: str = "story_id") -> DataFrame:
    """Each story with link_status, film and note. replies: (story, seq, film_index, confidence, reason, category), the last of a story counts.

    offered: (story, rank, film), what the reply's index points into. Only about, a film of the list and enough confidence link;
    a story without a reply is rejected as such, one without candidates before any call.
    """
    last = replies.groupBy(story).agg(F.max(F.struct("seq", "film_index", "confidence", "reason", "category")).alias("r")).select(story, "r.*")
    any_ = offered.groupBy(story).agg(F.count("*").alias("n_offered"))
    rows = (stories.join(last, story, "left").join(any_, story, "left")
            .join(offered.select(story, F.col("rank").cast("long").alias("film_index"), F.col("film").alias("found")), [story, "film_index"], "left"))
    about = F.col("reason") == "about"
    linked = about & F.col("found").isNotNull() & (F.col("confidence") >= floor)
    note = (F.when(F.col("n_offered").isNull(), "no-candidates").when(F.col("seq").isNull(), "no-decision").when(linked, F.lit(None))
            .when(about & F.col("found").isNotNull(), "below-floor").when(F.col("film_index").isNotNull() & F.col("found").isNull(), "out-of-list")
            .when(F.col("reason") == "mention", "mention")
            .when(F.col("reason") == "not-news", F.concat(F.lit("not-news"), F.when(F.col("category").isin(*CATEGORIES), F.concat(F.lit(":"), F.col("category"))).otherwise("")))
            .otherwise("no-match"))
    ok = F.coalesce(linked, F.lit(False)) & F.col("n_offered").isNotNull()
    return rows.select(*stories.columns, F.when(ok, "linked").otherwise("rejected").alias("link_status"), F.when(ok, F.col("found")).alias("film"), F.when(~ok, note).alias("note"))


def effective_tier(tier: Column, override: Column, default: str) -> Column:
    """An override first, then the judged tier, then the default."""
    return F.coalesce(V.mapped(override, V.OVERRIDE_TIER), tier, F.lit(default))


def gate_sources(stories: DataFrame, domains: DataFrame, default: str, *, domain: str = "domain") -> DataFrame:
    """Stories with their tier, those of blocked domains dropped; a null domain takes the default."""
    tiers = domains.select(domain, "llm_tier", "admin_override")
    return stories.join(tiers, domain, "left").withColumn("tier", effective_tier(F.col("llm_tier"), F.col("admin_override"), default)).where("tier <> 'blocked'").drop("llm_tier", "admin_override")


def best_tier(tier: str, default: str) -> Column:
    """Aggregate: the highest tier."""
    back = F.create_map(*(F.lit(x) for k, v in V.TIER_RANK.items() for x in (v, k)))
    return F.coalesce(F.try_element_at(back, F.max(V.mapped(F.col(tier), V.TIER_RANK))), F.lit(default))


def verdicts(parsed: DataFrame, asked: DataFrame, domain: str = "domain") -> DataFrame:
    """Verdicts (domain, position, tier, reason) on asked domains with a valid tier, the last of each."""
    ok = parsed.where(F.col("tier").isin(*V.TIER_RANK)).join(asked.select(domain).distinct(), domain, "left_semi")
    return ok.groupBy(domain).agg(F.max(F.struct("position", "tier", "reason")).alias("r")).select(domain, "r.tier", "r.reason")


def films_to_cluster(stories: DataFrame, event_story: DataFrame, *, film: str = "film_id", story: str = "story_id") -> DataFrame:
    return stories.where(F.col("link_status") == "linked").join(event_story.select(story).distinct(), story, "left_anti").select(film).distinct()


def chunked(df: DataFrame, by: str, order: list[Column], size: int, name: str = "chunk") -> DataFrame:
    return df.withColumn(name, F.floor((F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1) / size))


# --- clustering: one film's groups in order; each decision depends on those before it ---

GROUP_SCHEMA = "film_id long, group_no int, intent string, outcome string, event_type string, event_ref string, note string, region string, occurred_at timestamp, confidence string, subject_key array<string>, story_ids array<long>"
FILMS = 50_000  # films of one task: their replies, stories and events are some 100 MB
_EPOCH = dt.date(1970, 1, 1).toordinal()
_DAY = 86_400_000_000


def epoch_day(day: dt.date) -> int:
    return day.toordinal() - _EPOCH


def parse_groups(reply: str, n_stories: int) -> list[dict] | None:
    """The groups of a reply: whole story numbers in range and once each, region of two letters, ISO dates (as days since 1970), text names; None if unreadable."""
    a, b = reply.find("{"), reply.rfind("}")
    try:
        events = json.loads(reply[a:b + 1])["events"]
    except (ValueError, KeyError, TypeError):
        return None
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    out = []
    for e in events if isinstance(events, list) else []:
        if not isinstance(e, dict):
            continue
        numbers = e.get("stories") if isinstance(e.get("stories"), list) else []
        numbers = list(dict.fromkeys(n for n in numbers if whole(n) and 1 <= n <= n_stories))
        if not numbers:
            continue
        region, day = e.get("region"), e.get("claimed_date")
        try:
            day = epoch_day(dt.date.fromisoformat(day)) if isinstance(day, str) else None
        except ValueError:
            day = None
        out.append({
            "existing": e["existing"] if whole(e.get("existing")) else None, "type": e.get("type"), "confidence": e.get("confidence"), "stories": numbers, "claimed": day,
            "region": region.upper() if isinstance(region, str) and re.fullmatch("[A-Za-z]{2}", region) else None,
            "cast": [c for c in e.get("cast") or [] if isinstance(c, str)] if isinstance(e.get("cast"), list) else []})
    return out


def person_key(name: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", name).casefold().split())


class FilmState:
    """What one film's groups have come to so far: stories that are used, beats that others join, names on record. Times are microseconds, days since 1970."""

    def __init__(self, film: dict, as_of: int, window_days: int, dedup_days: int, default_rank: int):
        self.film, self.as_of, self.window, self.default_rank = film, as_of, window_days, default_rank
        self.stories = {s["n"]: s for s in film["s"] or ()}
        self.known = [{**e, "names": list(e["subject_key"] or ())} for e in sorted(film["e"] or (), key=lambda e: e["position"])]
        self.beats: dict[str, dict] = {}
        for e in self.known:
            if e["event_type"] in SINGULAR and e["day"] >= as_of - dedup_days and (e["event_type"] not in self.beats or e["us"] > self.beats[e["event_type"]]["us"]):
                self.beats[e["event_type"]] = e
        self.recorded = {n for e in self.known if e["event_type"] == "casting" for n in e["names"]}
        self.used: set[int] = set()

    def catalog_target(self, kind: str, names: list[str]) -> dict | None:
        """The catalog's own event that a group of this kind joins: one that names someone of it, one that happens once, or a release change in the window."""
        pool = [e for e in self.known if e["provenance"] == "catalog"]
        if kind in CREDIT_TYPES:
            pool = [e for e in pool if e["event_type"] in CREDIT_TYPES and set(e["names"]) & set(names)]
        elif kind in ONCE:
            pool = [e for e in pool if e["event_type"] == kind]
        elif kind == "release_date" and self.film["changed_us"] is not None:
            pool = [e for e in pool if e["event_type"] == kind and abs(e["us"] - self.film["changed_us"]) <= self.window * _DAY]
        else:
            pool = []
        return max(pool, key=lambda e: (e["us"], e["event_ref"]), default=None)

    def refusal(self, group: dict, first_day: int) -> tuple[str, str | None] | None:
        """(outcome, note) if a new event of this group may not form."""
        f, kind = self.film, group["type"]
        if kind == "off_topic":
            return "reject", "off-topic"
        if kind not in EVENT_TYPES or group["confidence"] not in ("confirmed", "rumored"):
            return "invalid", None
        if kind in EARLY_TYPES and (f["status"] in ("Post Production", "Released") or f["release_day"] is not None and f["release_day"] < self.as_of):
            return "reject", f"stale-stage:{kind}"
        if kind == "release_date" and (f["changed_day"] is None or self.as_of - f["changed_day"] > self.window):
            if group["claimed"] is None:
                return "reject", "release-date-unchanged"
            if group["claimed"] == f["release_day"]:
                return "reject", "release-date-restated"
            return ("hold", None) if self.as_of - first_day <= self.window else ("reject", "release-date-uncorroborated")
        return None

    def decide(self, no: int, g: dict) -> list:
        """The row of one group; what it uses, makes and names is kept for those after it."""
        mine = [self.stories[n] for n in g["stories"] if n in self.stories and self.stories[n]["story_id"] not in self.used]
        ids, kind = [s["story_id"] for s in mine], g["type"]
        intent = "create" if g["existing"] is None else "attach"

        def row(outcome, ref=None, note=None, region=None, at=None, conf=None, names=None):
            if outcome not in ("superseded", "invalid", "hold"):
                self.used.update(ids)
            return [self.film["film_id"], no, intent, outcome, kind, ref, note, region, at, conf, names, ids]

        if not mine:
            return row("superseded")
        if g["existing"] is not None and 1 <= g["existing"] <= len(self.known):
            return row("attach", self.known[g["existing"] - 1]["event_ref"])
        refused = self.refusal(g, min((s["us"], s["day"]) for s in mine)[1])
        if refused:
            return row(refused[0], note=refused[1])
        names = list(dict.fromkeys(n for n in map(person_key, g["cast"]) if n)) if kind == "casting" else []
        new = [n for n in names if n not in self.recorded]
        if kind in SINGULAR and kind in self.beats:
            return row("dedup_attach", self.beats[kind]["event_ref"])
        target = self.catalog_target(kind, names)
        if kind == "casting" and not new and target is None:
            return row("reject", note="casting-recorded")
        self.recorded.update(new)
        if target is not None:
            target["names"] += new
            return row("catalog_attach", target["event_ref"], names=new)
        best = max((-1 if s["rank"] is None else s["rank"] for s in mine), default=-1)
        best = self.default_rank if best < 0 else best
        ref, at = f"new:{self.film['film_id']}:{no}", min(s["us"] for s in mine)
        if kind in SINGULAR:
            self.beats[kind] = {"event_ref": ref, "us": at}
        return row("create", ref, region=g["region"] if kind == "release_date" else None, at=at, conf="rumored" if best == V.TIER_RANK["low"] else g["confidence"], names=new if kind == "casting" else None)


def cluster(stories: DataFrame, events: DataFrame, films: DataFrame, as_of: dt.date, window_days: int = 14, dedup_days: int = 14, default_tier: str = "acceptable") -> DataFrame:
    """One row for each group of each film's reply: what the reply meant, what was decided, and what it makes.

    stories: (film_id, n, story_id, at, tier); events: (film_id, position, event_ref, event_type, provenance, occurred_at, subject_key);
    films: (film_id, status, release_date, changed_at, reply), one row each. Only stories whose number stands in the film's reply are brought to
    it, so a reply bounds its stories however many wait; events are those that the reply's positions point into. Films are spread over the cluster.
    Times, days and tiers are made numbers by Spark; Python only goes through the groups of a film, each of which depends on those before.
    """
    # three tables meet per film, each dealt by it once: into as many tasks as the session shuffles by, or more, so that none holds over about FILMS films
    spark = films.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-films.select("film_id").count() // FILMS))
    films, stories, events = (x.repartition(parts, "film_id") for x in (films, stories, events))
    # stories and events travel as arrays of one film each
    number = lambda c: (F.unix_micros(c).alias("us"), F.unix_date(F.to_date(c)).alias("day"))
    numbers = films.select("film_id", F.transform(F.regexp_extract_all("reply", F.lit(r"\d{1,9}"), F.lit(0)), lambda x: x.cast("int")).alias("numbers"))
    named = stories.withColumn("n", F.col("n").cast("int")).join(numbers, "film_id").where(F.array_contains("numbers", F.col("n")))
    s = named.groupBy("film_id").agg(F.collect_list(F.struct("n", F.col("story_id").cast("long").alias("story_id"), *number(F.col("at").cast("timestamp")), V.mapped(F.col("tier"), V.TIER_RANK, None).alias("rank"))).alias("s"))
    e = events.groupBy("film_id").agg(F.collect_list(F.struct("position", "event_ref", "event_type", "provenance", *number(F.col("occurred_at").cast("timestamp")), "subject_key")).alias("e"))
    changed = number(F.col("changed_at").cast("timestamp"))
    rows = films.select("film_id", "status", F.unix_date("release_date").alias("release_day"), changed[0].alias("changed_us"), changed[1].alias("changed_day"), F.coalesce("reply", F.lit("")).alias("reply"))
    rows = rows.join(s, "film_id", "left").join(e, "film_id", "left")
    today, rank = epoch_day(as_of), V.TIER_RANK[default_tier]
    types = [pa.int64(), pa.int32(), *[pa.string()] * 6, pa.timestamp("us", tz="UTC"), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64())]
    columns = [c.split()[0] for c in GROUP_SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            out = []
            for film in batch.to_pylist():
                state = FilmState(film, today, window_days, dedup_days, rank)
                groups = parse_groups(film["reply"], max(state.stories, default=0))
                if groups is None:
                    out.append([film["film_id"], 0, None, "unparseable", None, None, None, None, None, None, None, []])
                else:
                    out += [state.decide(no, g) for no, g in enumerate(groups, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names=columns)

    return rows.mapInArrow(run, GROUP_SCHEMA)
