"""How filters act on one another: what each removes at each place of each order, from one cube of failure flags.

Every document gets its failure flags. The documents are counted by flags and part, and SQL CUBE rolls these counts up:
the grouping-set row whose kept flags are all false counts the documents that survive exactly those filters, in any order.
A step of an order is then the difference of two such rows, the subset before it and the subset after it.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MOST_FILTERS = 7  # 7 filters have 5,040 orders; the table of steps is broadcast
COUNTED = ["n", "good", "toxic"]


def conditions(text: Column) -> dict[str, Column]:
    """The failure conditions that one text decides: few words, repeated words, capitals, signs. A word is a run of anything but ASCII white space."""
    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def flag_counts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, A, B, C, D, E, n, good, toxic): how many documents of a part fail exactly these filters, how many of them are good and how many toxic.

    E: the text stands under a smaller doc_id anywhere in the table; texts are compared by their SHA-256 digests. Texts leave
    the scan as digests and flags. Equal rows are counted before each shuffle, and copies by part and label before they
    meet, so a text that a third of all rows hold brings at most four rows for each part.
    """
    label = labels.select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic").where("id IS NOT NULL").groupBy("id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(whole, 256)).alias("digest"), *(c.alias(k) for k, c in conditions(whole).items()))
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    # rows without an id have no label; a salt deals them out
    rows = rows.withColumns({"key": F.coalesce("id", F.lit(0).cast("long")), "salt": F.when(F.col("id").isNull(), F.xxhash64("digest").bitwiseOR(F.lit(1))).otherwise(0)})
    rows = rows.join(label.select(F.col("id").alias("key"), F.lit(0).cast("long").alias("salt"), "good", "toxic"), ["key", "salt"], "left")
    kind = ["digest", "part", "good", "toxic", "A", "B", "C", "D"]
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))  # unlike labels of one id don't exist, so (id, n) is one row of its kind
    kinds = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}).groupBy(*kind).agg(
        F.sum("n").alias("n"), first.alias("first"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"))
    low = kinds.groupBy("digest").agg(F.min("first.id").alias("low"))
    kinds = kinds.join(low, "digest")
    passing = F.col("unnamed") + F.when(F.col("first.id") == F.col("low"), F.col("first.n")).otherwise(0)
    each = kinds.select("part", "good", "toxic", "A", "B", "C", "D", F.explode(F.array(
        F.struct(F.lit(False).alias("E"), passing.alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - passing).alias("n")))).alias("copies")).select("part", "good", "toxic", "A", "B", "C", "D", "copies.*").where("n > 0")
    return each.groupBy("part", *FILTERS).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
                                              F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def survivors(counts: DataFrame, filters: str) -> DataFrame:
    """(part, subset, n, good, toxic): what survives each subset of the filters, a bit for each; zeros included.

    counts has a flag column for each filter. Flags are grouped or rolled up by CUBE: where a flag is grouped, the row
    in which it is false is the one that survives.
    """
    cube = counts.cube(*filters, "part").agg(*(F.sum(c).alias(c) for c in COUNTED), *(F.grouping(c).alias(f"all_{c}") for c in (*filters, "part")))
    for c in filters:
        cube = cube.where(F.col(f"all_{c}").eqNullSafe(1) | ~F.col(c))
    subset = sum(((1 - F.col(f"all_{c}").cast("int")) * (1 << i) for i, c in enumerate(filters)), F.lit(0))
    found = cube.where("all_part = 0").select("part", subset.cast("int").alias("subset"), *COUNTED)
    every = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("subset"))
    return every.join(found, ["part", "subset"], "left").select("part", "subset", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTED))


def steps(counts: DataFrame, filters: str) -> DataFrame:
    """(part, filter, before, kept, removed, good_lost, toxic_lost): each filter after each subset of the others."""
    alive = survivors(counts, filters)
    bit = [(c, b, b | 1 << i) for i, c in enumerate(filters) for b in range(1 << len(filters)) if not b >> i & 1]
    pairs = F.broadcast(counts.sparkSession.createDataFrame(bit, "filter string, before int, after int"))  # at most 7 * 64 rows
    left = alive.withColumnRenamed("subset", "before").join(pairs, "before")
    right = alive.select("part", F.col("subset").alias("after"), *(F.col(c).alias(f"{c}_after") for c in COUNTED))
    return left.join(right, ["part", "after"]).select(
        "part", "filter", "before", F.col("n_after").alias("kept"), (F.col("n") - F.col("n_after")).alias("removed"),
        (F.col("good") - F.col("good_after")).alias("good_lost"), (F.col("toxic") - F.col("toxic_after")).alias("toxic_lost"))


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part, order of the filters and step.

    counts: (part, a boolean column for each letter of filters, n, good, toxic), as flag_counts gives it. redundant fails
    the step's filter but went before; unique_fails fails this filter only; shapley is what the filter removes, summed
    over all orders. Zeros are kept; a table without rows gives none. At most 7 filters.
    """
    k = len(filters)
    if not 0 < k <= MOST_FILTERS or len(set(filters)) < k:
        raise ValueError(f"1 to {MOST_FILTERS} filters of different letters are audited, not {filters!r}")
    each = steps(counts, filters)
    place = {c: 1 << i for i, c in enumerate(filters)}
    orders = [("".join(p), i + 1, c, sum(place[x] for x in p[:i])) for p in itertools.permutations(filters) for i, c in enumerate(p)]
    orders = F.broadcast(counts.sparkSession.createDataFrame(orders, "filter_order string, step int, filter string, before int"))  # k! * k rows
    size = F.bit_count("before")
    orders_of = F.element_at(F.array(*(F.lit(math.factorial(s) * math.factorial(k - 1 - s)) for s in range(k))), size + 1)
    alone = F.element_at(F.create_map(*(F.lit(x) for c in filters for x in (c, (1 << k) - 1 - place[c]))), F.col("filter"))
    whole = each.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed")).otherwise(0)).alias("fails"), F.sum(F.when(F.col("before") == alone, F.col("removed")).otherwise(0)).alias("unique_fails"),
        F.sum(F.col("removed") * orders_of).alias("shapley"))
    return each.join(whole, ["part", "filter"]).join(orders, ["filter", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def of_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the filters A to E over documents, by source.

    A null text is empty, a null source the part ''. A null doc_id is smaller than none and has no label. Rows that repeat
    an id count each; under one id they don't fail E by one another. An id with several labels is good (toxic) if one
    of them says so. Other columns are ignored; an empty table gives no rows.
    """
    return audit(flag_counts(docs, labels))
