"""Moderation, cleanup and audits: blocked sources, summaries edited and rendered anew, labels demoted, clusterings and judges compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import text as X
from tidepool.functions import values as V
from tidepool.operators import changes, decisions


def named_source(source: Column, prefix: str, names: tuple[str, ...] = ()) -> Column:
    """Does a source's name begin with prefix, or stand in names?"""
    return F.coalesce(source.startswith(prefix) | source.isin(*names), F.lit(False))


def blocked_stories(stories: DataFrame, domains: DataFrame, default: str, *, domain: str = "domain") -> DataFrame:
    """Linked stories whose effective tier is blocked; an unknown or null domain takes the default."""
    tiers = domains.select(domain, "llm_tier", "admin_override")
    rows = stories.where("link_status = 'linked'").join(tiers, domain, "left")
    return rows.where(decisions.effective_tier(F.col("llm_tier"), F.col("admin_override"), default) == "blocked").select(*stories.columns)


def cleanup_report(events: DataFrame, members: DataFrame, gone: DataFrame, **names: str) -> DataFrame:
    """One row: stories rejected, events deleted, events summed up anew. This is all that a dry run does."""
    fate = changes.event_repair(events, members, gone, **names).where(F.col("action").isNotNull())
    touched = fate.join(members.join(gone.select("story_id").distinct(), "story_id").select("event_id").distinct(), "event_id", "left_semi")
    return gone.select(F.count_distinct("story_id").alias("stories_rejected")).join(touched.agg(
        F.count_if(F.col("action") == "delete").alias("events_deleted"), F.count_if(F.col("action") == "repair").alias("events_resummarized")))  # one row each


def cleaned(events: DataFrame, members: DataFrame, summaries: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, members, summaries) once the stories have left: empty events go, the others take their earliest time, touched summaries go."""
    hit = members.join(gone.select("story_id").distinct(), "story_id", "left_semi").select("event_id").distinct()
    fate = changes.event_repair(events, members, gone).join(hit, "event_id", "left_semi")
    left = events.join(fate.where("action = 'delete'"), "event_id", "left_anti").join(
        fate.where("action = 'repair'").select("event_id", F.col("occurred_at").alias("__at")), "event_id", "left")
    left = left.withColumn("occurred_at", F.coalesce("__at", "occurred_at")).select(*events.columns)
    return left, members.join(gone.select("story_id").distinct(), "story_id", "left_anti"), summaries.join(fate.select("event_id"), "event_id", "left_anti")


def affected(rows: DataFrame, by: str) -> DataFrame:
    """How many rows of each key, most first, ties by key."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(by))


def edited_summaries(summaries: DataFrame, edits: DataFrame, event: str = "event_id") -> DataFrame:
    """summaries (event, summary, edited_at) after edits (event, text, at): a text replaces and marks, a null text takes an edited row out.

    Edits of events without a summary, and resets of unedited ones, change nothing.
    """
    both = summaries.join(edits.select(event, "text", "at", F.lit(True).alias("__edit")), event, "left")
    reset = F.col("__edit") & F.col("text").isNull() & F.col("edited_at").isNotNull()
    new = F.col("text").isNotNull()
    return both.where(~F.coalesce(reset, F.lit(False))).select(
        event, F.when(new, F.col("text")).otherwise(F.col("summary")).alias("summary"), F.when(new, F.col("at")).otherwise(F.col("edited_at")).alias("edited_at"))


def rerendered(summaries: DataFrame, bodies: DataFrame, model: str, event: str = "event_id") -> DataFrame:
    """(event, old, new) of unedited summaries made by a template whose text differs from its new body."""
    own = summaries.where((F.col("model") == model) & F.col("edited_at").isNull())
    return own.join(bodies.select(event, "body"), event).where("body <> summary").select(event, F.col("summary").alias("old"), F.col("body").alias("new"))


def demoted(labels: DataFrame, labelable: DataFrame, film: str = "film_id") -> DataFrame:
    """Labelled rows about a film that can't be labelled become rows about none, without what only the first kind has."""
    known = labelable.select(film).distinct().withColumn("__known", F.lit(True))
    out = (F.col("relation") == "about") & F.col("__known").isNull()
    rows = labels.join(known, film, "left")
    clear = {film, "event_type", "event_group", "is_production_news", "exclusion_category"} & set(labels.columns)
    return rows.select(*(F.when(out, F.lit("none")).otherwise(F.col(c)).alias(c) if c == "relation" else F.when(~out, F.col(c)).alias(c) if c in clear else c for c in labels.columns),
                       out.alias("untracked_film"))


def news_value(df: DataFrame, linked: Column, news: Column) -> DataFrame:
    """tp, fp, fn, tn, precision and recall of linked rows being news; only an explicit false is no news."""
    real = ~news.eqNullSafe(F.lit(False))
    t = df.agg(F.count_if(linked & real).alias("tp"), F.count_if(linked & ~real).alias("fp"), F.count_if(~linked & real).alias("fn"), F.count_if(~linked & ~real).alias("tn"))
    return t.withColumn("precision", V.ratio(F.col("tp"), F.col("tp") + F.col("fp"), 0.0)).withColumn("recall", V.ratio(F.col("tp"), F.col("tp") + F.col("fn"), 0.0))


def false_drops(df: DataFrame, title: Column, text: Column, ratios: list[float]) -> DataFrame:
    """For each ratio how many rows a title filter would drop though they are about the film, of how many."""
    from tidepool.functions.predicates import title_hit

    each = df.select(title.alias("t"), text.alias("x")).withColumn("ratio", F.explode(F.array(*(F.lit(float(r)) for r in ratios))))
    n = each.withColumn("drop", ~title_hit(F.col("t"), F.col("x"), F.col("ratio"))).groupBy("ratio").agg(F.count_if("drop").alias("drops"), F.count("*").alias("n"))
    return n.withColumn("rate", V.ratio(F.col("drops"), F.col("n"), 0.0))


def class_counts(labels: DataFrame) -> DataFrame:
    about = F.col("relation") == "about"
    return labels.agg(F.count("*").alias("total"), F.count_if(about).alias("about"), F.count_if(about & ~F.col("is_production_news").eqNullSafe(F.lit(False))).alias("linkable_about"),
                      F.count_if(F.col("relation") == "mention").alias("mention"), F.count_if(F.col("relation") == "none").alias("none"), F.count_if(F.col("relation") == "TODO").alias("todo"))


def judge_verdict(reply: Column) -> tuple[Column, Column]:
    """(passed, reason) of a judge's JSON reply; whatever can't be read has failed."""
    span = X.json_span(reply)
    said = F.try_variant_get(F.try_parse_json(span), "$.pass", "variant")
    clear = F.coalesce(F.schema_of_variant(said) == "BOOLEAN", F.lit(False))
    return clear & F.coalesce(F.try_variant_get(said, "$", "boolean"), F.lit(False)), F.when(clear, F.coalesce(F.get_json_object(span, "$.reason"), F.lit(""))).otherwise(F.lit("unparseable"))


def redirect_target(body: Column) -> Column:
    """The address in a reply of nested JSON: after a guard and an empty line a list, whose marked entry holds a second JSON document as its third item."""
    outer = F.from_json(F.regexp_extract(body, r"(?s)\n\n(.*)$", 1), "array<array<string>>")
    inner = F.filter(outer, lambda e: (F.size(e) > 2) & (F.get(e, F.lit(1)) == "Fbv4je"))
    url = F.get(F.from_json(F.get(F.get(inner, F.lit(0)), F.lit(2)), "array<string>"), F.lit(1))
    return F.when(url.startswith("http"), url)


def clustering_gate(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row that compares two clusterings (film_id, story_id, kind, target, type, confidence): a new group's target is its number in the film.

    near_share and totals of new groups per film; story agreement (both new, or attached to one event); merges: groups of b that hold stories
    of several new groups of a; type and confidence of b's groups against the group of a they overlap most (the first of equals);
    and pairs of common stories grouped alike. Pairs are counted from group sizes.
    """
    def new(df):
        return df.where("kind = 'new'")

    both_films = a.select("film_id").distinct().join(b.select("film_id").distinct(), "film_id")
    count = lambda df, n: new(df).groupBy("film_id").agg(F.count_distinct("target").alias(n))
    films = a.select("film_id").union(b.select("film_id")).distinct()
    size = films.join(count(a, "a"), "film_id", "left").join(count(b, "b"), "film_id", "left").na.fill(0, ["a", "b"]).agg(
        V.ratio(F.count_if(F.abs(F.col("a") - F.col("b")) <= 1), F.count("*"), 1.0).alias("near_share"), F.coalesce(F.sum("a"), F.lit(0)).alias("total_a"), F.coalesce(F.sum("b"), F.lit(0)).alias("total_b"))
    keys = ["film_id", "story_id"]
    left, right = (x.join(both_films, "film_id").select(*keys, *(F.col(c).alias(f"{s}_{c}") for c in ("kind", "target", "type", "confidence"))) for s, x in (("a", a), ("b", b)))
    met = left.join(right, keys, "full_outer")
    agree = (F.col("a_kind") == F.col("b_kind")) & ((F.col("a_kind") == "new") | (F.col("a_target") == F.col("b_target")))
    stories = met.agg(V.ratio(F.count_if(agree), F.count("*"), 1.0).alias("story_share"))
    grouped = met.where("a_kind = 'new' AND b_kind = 'new'").groupBy("film_id", "b_target", "a_target").agg(
        F.count("*").alias("n"), F.first("a_type").alias("at"), F.first("a_confidence").alias("ac"), F.first("b_type").alias("bt"), F.first("b_confidence").alias("bc"))
    best = grouped.groupBy("film_id", "b_target").agg(F.count("*").alias("groups"), F.min(F.struct((-F.col("n")).alias("k"), "a_target", "at", "ac", "bt", "bc")).alias("s"))
    told = F.col("s.at").isNotNull() & F.col("s.ac").isNotNull() & F.col("s.bt").isNotNull() & F.col("s.bc").isNotNull()
    same = told & (F.col("s.at") == F.col("s.bt")) & (F.col("s.ac") == F.col("s.bc"))
    groups = best.agg(F.count_if(F.col("groups") >= 2).alias("merges"), V.ratio(F.count_if(same), F.count_if(told), 1.0).alias("type_share"))
    pairs = lambda n: n * (n - 1) / 2
    common = met.where("a_kind IS NOT NULL AND b_kind IS NOT NULL")
    cell = common.groupBy("film_id", F.struct("a_kind", "a_target").alias("x"), F.struct("b_kind", "b_target").alias("y")).agg(F.count("*").alias("n"))
    in_both = cell.agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("both"))
    in_a, in_b = (cell.groupBy("film_id", c).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias(f"in_{c}")) for c in ("x", "y"))
    all_pairs = cell.groupBy("film_id").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("every"))
    rand = in_both.join(in_a).join(in_b).join(all_pairs).select(V.ratio(F.col("every") - F.col("in_x") - F.col("in_y") + 2 * F.col("both"), F.col("every"), 1.0).alias("pair_share"))
    out = size.join(stories).join(groups).join(rand)  # one row each
    passed = ((F.col("near_share") >= 0.9) & (F.abs(F.col("total_a") - F.col("total_b")) <= 0.1 * F.greatest("total_a", F.lit(1))) & (F.col("story_share") >= 0.9)
              & (F.col("merges") == 0) & (F.col("type_share") >= 0.85))
    return out.withColumn("passed", passed)


def type_agreement(df: DataFrame, cluster: str, predicted: str, gold: str) -> DataFrame:
    """The share of clusters whose type is the commonest gold type of their rows (the least of equals), and its band."""
    from tidepool.operators.metrics import band, majority_type

    own = df.groupBy(cluster).agg(F.min(predicted).alias("own")).join(majority_type(df, cluster, gold), cluster)
    share = V.ratio(F.count_if(F.col("own").eqNullSafe(F.col("majority"))), F.count("*"), 1.0)
    return own.agg(F.count("*").alias("clusters"), share.alias("share")).withColumn("band", band(F.col("share"), 0.85, 0.7))


def latest_in_order(df: DataFrame, by: list[str], newest: list[Column], oldest: list[Column], n: int) -> DataFrame:
    """The latest n rows of each group, numbered from its oldest: what a reply's positions point into."""
    kept = df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*newest))).where(F.col("__n") <= n).drop("__n")
    return kept.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*oldest)))


def reloaded(df: DataFrame, key: str, order: list) -> DataFrame:
    """The rows of some keys in the order in which the keys are given (position, from 0); unknown keys give no row."""
    given = df.sparkSession.createDataFrame(list(enumerate(order)), f"position int, {key} {df.schema[key].dataType.simpleString()}")
    return df.join(F.broadcast(given), key)  # as many rows as keys were named


def first_seen(df: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """The value of each group's first row, the least of equals."""
    return df.groupBy(by).agg(F.min(F.struct(order, value)).alias("s")).select(by, F.col(f"s.{value}").alias(value))


def united(df: DataFrame, by: list[str], array: str) -> DataFrame:
    """All items of a group's arrays, each once, in order."""
    return df.select(*by, F.explode(array).alias("__x")).groupBy(*by).agg(F.array_sort(F.collect_set("__x")).alias(array))


def without_own_picks(rows: DataFrame, cutoff: Column) -> DataFrame:
    """Rows (pick_score, pick_rank, pick_at) whose pick came at or after cutoff keep their place in the count but lose the pick; others, undated ones too, stay."""
    late = F.coalesce(F.col("pick_at") >= cutoff, F.lit(False))
    return rows.select(*(F.when(~late, F.col(c)).alias(c) if c in ("pick_score", "pick_rank") else c for c in rows.columns))


def deepest_pick(rows: DataFrame, threshold: float) -> DataFrame:
    """The largest rank of a pick that reaches the threshold; null if none does."""
    return rows.agg(F.max(F.when(F.col("pick_score") >= threshold, F.col("pick_rank"))).alias("deepest"))
