"""Evaluation and reports: link and cluster quality, sweeps, sources' return, quotas, samples, percentiles."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import predicates as P
from tidepool.functions import values as V
from tidepool.session import written


def prf(df: DataFrame, expected: Column, predicted: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of a link to one of many: a wrong link is a false positive and a false negative."""
    right = predicted.eqNullSafe(expected)
    t = df.groupBy(*(by or [])).agg(
        F.count_if(expected.isNotNull() & right).alias("tp"), F.count_if(predicted.isNotNull() & ~right).alias("fp"), F.count_if(expected.isNotNull() & ~right).alias("fn"))
    t = t.withColumn("precision", V.ratio(F.col("tp"), F.col("tp") + F.col("fp"), 0.0)).withColumn("recall", V.ratio(F.col("tp"), F.col("tp") + F.col("fn"), 0.0))
    return t.withColumn("f1", V.f1(F.col("precision"), F.col("recall")))


def floor_sweep(df: DataFrame, expected: str, predicted: str, confidence: str, floors: list[float]) -> DataFrame:
    """prf at each confidence floor, in one pass over the rows."""
    each = df.withColumn("floor", F.explode(F.array(*(F.lit(float(f)) for f in floors))))
    return prf(each, F.col(expected), F.when(F.col(confidence) >= F.col("floor"), F.col(predicted)), ["floor"])


def miss_reason(expected: Column, predicted: Column, confidence: Column, floor: float) -> Column:
    return F.when(expected.isNull() | (predicted.eqNullSafe(expected) & (confidence >= floor)), F.lit(None)).when(predicted.isNull(), "declined").when(
        ~predicted.eqNullSafe(expected), "wrong").otherwise("below-floor")


def purity(df: DataFrame, cluster: str, gold: str) -> DataFrame:
    """Rows in their cluster's majority class, over all rows."""
    n = df.groupBy(cluster, gold).agg(F.count("*").alias("n"))
    return n.groupBy(cluster).agg(F.max("n").alias("top"), F.sum("n").alias("n")).agg(
        F.count("*").alias("clusters"), F.sum("n").alias("rows"), V.ratio(F.sum("top"), F.sum("n"), 0.0).alias("purity"))


def pairwise(df: DataFrame, item: str, predicted: str, gold: str) -> DataFrame:
    """Pairs of items grouped together, predicted and in truth: counts, precision, recall (1 of none) and f1.

    Pairs are counted from group sizes, never listed: a group of n items has n (n - 1) / 2, and those common to both
    are the pairs within (predicted, gold) cells.
    """
    pairs = lambda n: n * (n - 1) / 2
    rows = df.dropDuplicates([item])
    cells = rows.groupBy(predicted, gold).agg(F.count("*").alias("n"))
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("both"))
    p = cells.groupBy(predicted).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("pred"))
    g = cells.groupBy(gold).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("true"))
    t = both.join(p).join(g).select(*(F.col(c).cast("long").alias(f"{c}_pairs") for c in ("both", "pred", "true")))  # one row each
    t = t.withColumn("precision", V.ratio(F.col("both_pairs"), F.col("pred_pairs"), 1.0)).withColumn("recall", V.ratio(F.col("both_pairs"), F.col("true_pairs"), 1.0))
    return t.withColumn("f1", V.f1(F.col("precision"), F.col("recall")))


def leaks(df: DataFrame, predicted: Column, expected: Column, category: str) -> DataFrame:
    """Rows taken for news that aren't, by category."""
    return df.where(predicted & ~expected).groupBy(F.coalesce(category, F.lit("other")).alias("category")).agg(F.count("*").alias("n"))


def or_own_group(group: str, item: str) -> Column:
    """Items without a group stand alone."""
    return F.coalesce(F.col(group).cast("string"), F.concat(F.lit("__"), F.col(item).cast("string")))


def band(value: Column, green: float, tune: float) -> Column:
    return F.when(value >= green, "green").when(value >= tune, "tune").otherwise("escalate")


def majority_type(df: DataFrame, cluster: str, gold_type: str) -> DataFrame:
    """The commonest type of each cluster, the least of equals."""
    n = df.groupBy(cluster, gold_type).agg(F.count("*").alias("n"))
    return n.groupBy(cluster).agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(gold_type).alias("t"))).alias("s")).select(cluster, F.col("s.t").alias("majority"))


def source_return(stories: DataFrame, members: DataFrame, trusted: list[str], total_cost: float, bucket: Column, *, source: str = "source", story: str = "story_id", event: str = "event_id", linked: str = "linked") -> DataFrame:
    """Per source and per bucket (source null): volume, linked, events, events no trusted source has, and cost by share of volume."""
    s = stories.withColumn("bucket", bucket)
    volume = s.groupBy(source, "bucket").agg(F.count("*").alias("volume"), F.count_if(linked).alias("linked"))
    m = members.join(s.select(story, source, "bucket"), story)
    sole = m.groupBy(event).agg(F.bool_or(F.col(source).isin(*trusted)).alias("t")).where("NOT t").select(event, F.lit(1).alias("sole"))
    per = m.select(event, source, "bucket").distinct().join(sole, event, "left").groupBy(source, "bucket").agg(F.count("*").alias("events"), F.count("sole").alias("unique_events"))
    rows = volume.join(per, [source, "bucket"], "left").na.fill(0, ["events", "unique_events"])
    sums = [F.sum(c).alias(c) for c in ("volume", "linked", "events", "unique_events")]
    both = rows.groupingSets([[F.col("bucket"), F.col(source)], [F.col("bucket")]], "bucket", source).agg(*sums)
    whole = stories.agg(F.count("*").alias("__all"))  # one row
    return both.join(whole).withColumn("cost", V.ratio(F.col("volume") * F.lit(float(total_cost)), F.col("__all"))).drop("__all")


def quotas(counts: DataFrame, total: int, key: str, n: str = "n") -> DataFrame:
    """Largest remainder: whole quotas in proportion that sum to total; ties to the lesser key. counts has a row for each stratum."""
    whole = counts.agg(F.sum(n).alias("__sum"))
    rows = counts.join(whole).withColumn("__share", F.col(n) * F.lit(total) / F.col("__sum")).withColumn("__floor", F.floor("__share"))
    every = Window.partitionBy(F.lit(0))  # strata, not rows: few
    left = F.lit(total) - F.sum("__floor").over(every)
    place = F.row_number().over(every.orderBy((F.col("__share") - F.col("__floor")).desc(), F.asc(key)))
    return rows.select(key, n, (F.col("__floor") + (place <= left).cast("long")).alias("quota"))


def hash_sample(df: DataFrame, strata: str, ident: str, seed: str, n: int) -> DataFrame:
    """The n rows of each stratum whose hash with the seed is least: the same rows every time."""
    h = F.md5(F.concat(F.lit(seed), F.col(ident).cast("string")))
    return df.withColumn("hash", h).withColumn("place", F.row_number().over(Window.partitionBy(strata).orderBy("hash", ident))).where(F.col("place") <= n)


def nearest_rank(df: DataFrame, value: str, q: float, by: list[str], few: int = 50_000, groups: int = 100_000) -> DataFrame:
    """The ceil(q n)-th smallest value of each group; nulls don't count. However the values lie, no task holds a group.

    A KLL sketch of each group brackets the place between two values, and what lies below and between them is counted exactly.
    That is repeated within the brackets until they hold at most few rows or one value; then their values are counted, in order.
    A bracket that misses the place (sketches err) is not taken and made wider. Tables of at most `groups` groups (they
    are counted) are broadcast to the rows, so that no group is dealt to one task.
    """
    keys = [f"__k{i}" for i in range(max(1, len(by)))]
    rows = df.where(F.col(value).isNotNull()).select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=False)), F.col(value).alias("__v"))
    rows = rows if by else rows.withColumn("__k0", F.lit(0))
    on = lambda left, right: functools.reduce(lambda a, b: a & b, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys))
    place = F.greatest(F.lit(1), F.ceil(F.col("inside") * F.lit(q) - F.lit(1e-9)))
    state = rows.groupBy(*keys).agg(F.count("*").alias("inside"), F.min("__v").alias("low"), F.max("__v").alias("high"))
    state = written(state.select(*keys, "low", "high", "inside", place.alias("place"), F.lit(0.02).alias("margin"), F.lit(False).alias("stuck")))
    open_ = (F.col("inside") > few) & (F.col("low") < F.col("high")) & ~F.col("stuck")

    def inside(g: DataFrame, *more: str) -> DataFrame:
        g = F.broadcast(g) if not P.oversized(g, groups) else g
        return rows.alias("r").join(g.alias("g"), on("r", "g")).where(F.col("__v").between(F.col("low"), F.col("high"))).select("r.*", *more)

    number = F.col("__v").cast("double")  # a bracket in doubles holds all values that round to its ends
    while not state.where(open_).isEmpty():
        part = inside(state.where(open_), "place", "inside", "margin").groupBy(*keys, "place", "inside", "margin").agg(F.kll_sketch_agg_double(number).alias("s"))
        rank = F.col("place") / F.col("inside")
        # a sketch answers constant ranks only: it gives 257 of them, and the bracket is cut at two
        grid = part.withColumn("cuts", F.kll_sketch_get_quantile_double("s", F.array(*(F.lit(i / 256) for i in range(257)))))
        cut = lambda i: F.element_at("cuts", F.greatest(F.lit(0), F.least(F.lit(256), i)).cast("int") + 1)
        guess = written(grid.select(*keys, cut(F.floor((rank - F.col("margin")) * 256)).alias("from"), cut(F.ceil((rank + F.col("margin")) * 256)).alias("to")))
        ahead = state.alias("a").join(guess.alias("b"), on("a", "b")).select("a.*", "from", "to")
        between = number.between(F.col("from"), F.col("to"))
        counts = inside(ahead, "from", "to").groupBy(*keys).agg(F.count_if(number < F.col("from")).alias("below"), F.count_if(between).alias("between"), F.min(F.when(between, F.col("__v"))).alias("new_low"), F.max(F.when(between, F.col("__v"))).alias("new_high"))
        hit = F.coalesce((F.col("place") > F.col("below")) & (F.col("place") <= F.col("below") + F.col("between")) & (F.col("between") < F.col("inside")), F.lit(False))
        take = lambda new, old: F.when(hit, new).otherwise(F.col(old)).alias(old)
        # where even a bracket of the whole group is no narrower, its values are counted as they are
        state = written(state.alias("a").join(counts.alias("b"), on("a", "b"), "left").select(
            *(f"a.{k}" for k in keys), take(F.col("new_low"), "low"), take(F.col("new_high"), "high"), take(F.col("between"), "inside"), take(F.col("place") - F.col("below"), "place"),
            F.when(hit, 0.02).otherwise(F.col("margin") * 2).alias("margin"), (F.col("stuck") | (~hit & (F.col("margin") > 1))).alias("stuck")))
    kept = inside(state, "place").groupBy(*keys, "place", "__v").agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__v"))
    found = kept.withColumn("__to", upto).where((F.col("__to") >= F.col("place")) & (F.col("__to") - F.col("__c") < F.col("place")))
    return found.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=False)), F.col("__v").alias(value))


def call_cost(calls: DataFrame, rates: DataFrame, keys: list[str]) -> DataFrame:
    """calls with cost_usd as decimal(12,6). rates: keys, input, output, write_mult, read_mult, per million tokens; batch calls cost half."""
    t = calls.join(rates, keys, "left")  # a price list is small, which Spark sees by itself
    cost = (F.col("input_tokens") * F.col("input") + F.col("output_tokens") * F.col("output") + F.col("cache_write_tokens") * F.col("input") * F.col("write_mult")
            + F.col("cache_read_tokens") * F.col("input") * F.col("read_mult")) / 1e6
    return t.withColumn("cost_usd", (cost * F.when(F.col("batch"), 0.5).otherwise(1.0)).cast("decimal(12,6)")).drop("input", "output", "write_mult", "read_mult")


def unpriced(used: DataFrame, rates: DataFrame, keys: list[str]) -> DataFrame:
    """What is used without a price; none should be."""
    return used.select(*keys).distinct().join(rates.select(*keys), keys, "left_anti")


def config_faults(used: DataFrame, rates: DataFrame, credentials: DataFrame, keys: list[str], owner: str) -> DataFrame:
    """(keys, fault) of everything that stands in the way of a run, all at once: unpriced, or without credentials of its owner."""
    bare = used.select(*keys).distinct().join(credentials.select(owner).distinct(), owner, "left_anti")
    return unpriced(used, rates, keys).withColumn("fault", F.lit("unpriced")).unionByName(bare.select(*keys).withColumn("fault", F.lit("no-credentials")))
