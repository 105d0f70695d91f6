"""Vector tables cut into blocks, and every query block met with every data block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import blocks_for, materialize

DATA_BLOCK = 8192
QUERY_BLOCK = 8192
RESULT = "query_id long, vec_id long, score {}"


def clean_vectors(df: DataFrame, id_col: str, vector_col: str, drop_zero: bool) -> DataFrame:
    """(vec_id, vec array<double>): rows whose id and components are all present and finite.

    A repeated id counts once, with the smallest of its usable vectors. Other columns are dropped.
    """
    x = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("vec")).where(
        F.col("vec_id").isNotNull()
        & F.col("vec").isNotNull()
        & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    )
    if drop_zero:
        rows = rows.where(F.exists("vec", lambda v: v != 0))
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column as a dense float64 matrix; shorter vectors are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if not len(n):
        return np.zeros((0, 1))
    if (n == n[0]).all():
        return flat.reshape(len(n), n[0]) if n[0] else np.zeros((len(n), 1))
    out = np.zeros((len(n), max(1, n.max())))
    out[np.arange(out.shape[1]) < n[:, None]] = flat
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))


Meet = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def search_blocks(vectors: DataFrame, every: int, k: int, meet: Meet, score_type: str,
                  data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k best of all rows for each row whose id is divisible by every.

    meet gets (query ids, queries, data ids, data, k) of one pair of blocks and yields
    (query ids, data ids, scores): at least the k best of that pair for each query.
    Both block sizes are fixed, so a task's memory doesn't grow with the tables; what the pairs
    yield is merged per query by a window that Spark limits to k rows before its shuffle.
    """
    vectors = materialize(vectors, "vectors")
    is_query = F.col("vec_id") % every == 0
    n, nq = vectors.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    nd, nq = blocks_for(n, data_block), blocks_for(nq, query_block)
    h = F.xxhash64("vec_id")
    data = vectors.select("vec_id", "vec", F.pmod(h, F.lit(nd)).cast("int").alias("d"),
                          F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("q"))
    queries = vectors.where(is_query).select(
        "vec_id", "vec", F.pmod(F.shiftright(h, 20), F.lit(nq)).cast("int").alias("q"),
        F.explode(F.sequence(F.lit(0), F.lit(nd - 1))).alias("d"))
    arrow_type = {"long": pa.int64(), "double": pa.float64()}[score_type]

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [[], [], []]
        if left.num_rows and right.num_rows:
            q, d = same_width(matrix(left["vec"]), matrix(right["vec"]))
            for part in meet(left["vec_id"].to_numpy(), q, right["vec_id"].to_numpy(), d, k):
                for to, x in zip(found, part, strict=True):
                    to.append(x)
        a, b, c = (np.concatenate(x) if x else np.zeros(0) for x in found)
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, arrow_type)})

    met = queries.groupBy("q", "d").cogroup(data.groupBy("q", "d")).applyInArrow(pair, RESULT.format(score_type))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
