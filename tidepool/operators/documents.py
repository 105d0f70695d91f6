"""Changes inside nested documents: every path whose value differs between two versions, with the types on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.session import written


def kind_of(v: Column) -> Column:
    """object, array, string, number, boolean or null: what a JSON document tells apart."""
    t = F.schema_of_variant(v)
    return (F.when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t == "VOID", "null").otherwise("number"))


LEVELS = 6  # levels of a document that one pass goes down


def _leaves(rows: DataFrame, text: str) -> DataFrame:
    """rows with path, kind and value in place of text: one row for each leaf.

    A pass goes down LEVELS levels in place, without a shuffle: a leaf stays as it is, an object or array gives way to its parts. Only
    what is nested deeper goes through another pass, so a document of any depth becomes rows.
    """
    spark, own = rows.sparkSession, [c for c in rows.columns if c != text]
    level = rows.where(F.col(text).isNotNull()).select(*own, F.lit("").alias("path"), F.col(text).alias("text"), F.try_parse_json(F.col(text)).alias("v"))
    out = None
    while True:
        for _ in range(LEVELS):
            parts = level.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer()).toDF("pos", "name", "part"))
            step = F.coalesce(F.replace(F.replace("name", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")), F.col("pos").cast("string"))
            level = parts.select(*own, F.when(step.isNull(), F.col("path")).otherwise(F.concat("path", F.lit("/"), step)).alias("path"),
                                 F.when(step.isNull(), F.col("text")).alias("text"), F.when(step.isNull(), F.col("v")).otherwise(F.col("part")).alias("v"))
        kind = F.when(F.col("v").isNull(), "malformed").otherwise(kind_of(F.col("v")))
        done = written(level.select(*own, "path", kind.alias("kind"), F.coalesce(F.to_json("v"), "text").alias("value")))
        deep = F.col("kind").isin("object", "array") & ~F.col("value").isin("{}", "[]")
        found = done.where(~deep).select(*own, "path", "kind", "value")
        out = found if out is None else out.unionByName(found)
        if done.where(deep).isEmpty():
            return out
        level = done.where(deep).select(*own, "path", F.lit(None).cast("string").alias("text"), F.parse_json("value").alias("v"))


def paths(docs: DataFrame, key: str, document: str) -> DataFrame:
    """(key, path, kind, value) of every leaf of the documents: a value that is no object or array, or an empty one of these.

    Paths are JSON pointers (/a/b/0), the whole document is the empty one; value is JSON text. A null document has no paths;
    an unreadable one is a single leaf of kind malformed.
    """
    return _leaves(docs.select(F.col(key).alias("k"), F.col(document).alias("doc")), "doc").withColumnRenamed("k", key)


def document_changes(old: DataFrame, new: DataFrame, key: str, document: str) -> DataFrame:
    """(key, path, change, old_kind, old_value, new_kind, new_value) for keys that both sides have: paths added, removed and changed.

    A number and a text of the same letters differ. Elements of arrays are told by their place. Where an object takes the place
    of a value, the value's path is removed and the object's are added. A null document has no paths.

    The two versions of a key meet once, as whole documents; equal ones go at once, the others' leaves are told apart within the key.
    """
    side = lambda df, name: df.select(F.col(key).alias("k"), F.col(document).alias(name))
    both = side(old, "old").join(side(new, "new"), "k").where(~F.col("old").eqNullSafe(F.col("new")))
    docs = both.select("k", F.explode(F.array(F.struct(F.lit(False).alias("is_new"), F.col("old").alias("doc")), F.struct(F.lit(True).alias("is_new"), F.col("new").alias("doc")))).alias("d"))
    leaf = F.struct("kind", "value")
    pairs = _leaves(docs.select("k", "d.is_new", "d.doc"), "doc").groupBy("k", "path").agg(F.max(F.when(~F.col("is_new"), leaf)).alias("a"), F.max(F.when(F.col("is_new"), leaf)).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return pairs.where(~F.col("a").eqNullSafe(F.col("b"))).select(
        F.col("k").alias(key), "path", change.alias("change"), F.col("a.kind").alias("old_kind"), F.col("a.value").alias("old_value"), F.col("b.kind").alias("new_kind"), F.col("b.value").alias("new_value"))
