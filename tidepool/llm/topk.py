"""Exact top-k search by inner product: dual-tree search over cover trees.

The top of the tree is shared by queries and data and spans the whole table: cells around sampled centres, each with its
covering radius. A cell is cut into blocks of bounded size. Every query block first meets one block of the most promising cell, which gives
each query a score to beat; then only those cells are shipped to it whose bound reaches the worst of these. Within a pair of blocks
the search goes on over cover trees of both.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import blocks_for, hash_sample, materialize
from tidepool.llm.vectors import DATA_BLOCK, QUERY_BLOCK, RESULT, clean_vectors, matrix, same_width

LEAF = 48


class Node:
    """A ball: centre, covering radius, the rows within it, and its children (none: a leaf)."""

    __slots__ = ("centre", "radius", "norm", "rows", "children")

    def __init__(self, centre, radius, rows, children):
        self.centre, self.radius, self.rows, self.children = centre, radius, rows, children
        self.norm = float(np.sqrt(centre @ centre))


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Node:
    """A cover tree: each level's centres are points over scale apart and cover their rows within it; scales halve.

    Where nothing is near anything at a scale, rows are dealt to leaves of the parent's radius instead.
    """

    def ball(rows: np.ndarray, centre: np.ndarray, children=None) -> Node:
        away = points[rows] - centre
        return Node(centre, float(np.sqrt(np.einsum("ij,ij->i", away, away).max())), rows, children)

    def build(rows: np.ndarray, centre: np.ndarray, scale: float) -> Node:
        node = ball(rows, centre)
        if len(rows) <= leaf:
            return node
        scale = min(scale, node.radius) / 2
        covered, rest = [], rows
        while node.radius > 0 and len(rest) and len(covered) <= len(rows) // leaf + leaf:
            at = points[rest[0]]
            d = points[rest] - at
            near = np.einsum("ij,ij->i", d, d) <= scale * scale
            covered.append((rest[near], at))
            rest = rest[~near]
        if len(rest) or node.radius == 0:
            node.children = [ball(rows[i:i + leaf], centre) for i in range(0, len(rows), leaf)]
        else:
            node.children = [build(r, at, scale) for r, at in covered]
        return node

    return build(np.arange(len(points)), points[0], np.inf)


def dual_tree(q_ids: np.ndarray, queries: np.ndarray, d_ids: np.ndarray, data: np.ndarray, k: int, least: np.ndarray | None = None, visited: list[int] | None = None):
    """Every query's k best of data, ties to the smaller id, never its own id: (query ids, ids, scores).

    least is a score that each query has k candidates for already: what is below it is left out. The numbers of pairs scored are added to visited.

    Pairs of a query ball and a data ball are taken best bound first and the wider ball is opened.
    <q, p> over two balls is at most <cq, cp> + rq |cp| + rp |cq| + rq rp; a pair is pruned where that
    is below the worst kth score of its query group. Equal bounds are visited, so ids settle ties.
    Products are whole numbers, exact as doubles up to 2^53.
    """
    scores = np.full((len(queries), k), -np.inf)
    ids = np.full((len(queries), k), np.iinfo(np.int64).max)

    least = np.full(len(queries), -np.inf) if least is None else least

    def visit(a: np.ndarray, b: np.ndarray) -> None:
        if visited is not None:
            visited.append(len(a) * len(b))
        s = queries[a] @ data[b].T
        s = np.where(q_ids[a][:, None] == d_ids[b][None, :], -np.inf, s)
        all_s = np.concatenate([scores[a], s], 1)
        all_i = np.concatenate([ids[a], np.broadcast_to(d_ids[b], s.shape)], 1)
        order = np.lexsort((all_i, -all_s), axis=1)[:, :k]
        scores[a] = np.take_along_axis(all_s, order, 1)
        ids[a] = np.take_along_axis(all_i, order, 1)

    def bound(a: Node, b: Node) -> float:
        x = float(a.centre @ b.centre) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius
        return x + 1e-9 * abs(x) + 1e-6

    top = cover_tree(queries), cover_tree(data)
    heap, n = [(-bound(*top), 0, *top)], 0
    while heap:
        upper, _, a, b = heapq.heappop(heap)
        if -upper < np.maximum(scores[a.rows, k - 1], least[a.rows]).min():
            continue
        if a.children is None and b.children is None:
            visit(a.rows, b.rows)
            continue
        open_data = a.children is None or b.children is not None and b.radius >= a.radius
        for x, y in [(a, c) for c in b.children] if open_data else [(c, b) for c in a.children]:
            n += 1
            heapq.heappush(heap, (-bound(x, y), n, x, y))
    hit = (scores > -np.inf) & (scores >= least[:, None])
    return np.repeat(q_ids, hit.sum(1)), ids[hit], scores[hit].astype(np.int64)


def cells_of(vectors: DataFrame, cells: int) -> tuple[DataFrame, dict[int, tuple[np.ndarray, float, int]]]:
    """vectors with its cell and the distance from the cell's centre, and (centre, covering radius, rows) of each cell.

    Centres are at most `cells` sampled vectors: all that reaches the driver.
    """
    centres = matrix(pa.array([r["vec"] for r in hash_sample(vectors.select("vec_id", "vec"), cells, "vec_id").collect()], pa.list_(pa.float64())))
    shared = vectors.sparkSession.sparkContext.broadcast(np.unique(centres, axis=0))

    def assign(batches):
        for batch in batches:
            x, c = same_width(matrix(batch.column("vec")), shared.value)
            cell, away = np.zeros(len(x), np.int32), np.zeros(len(x))
            if len(c):
                half = 0.5 * (c * c).sum(1)
                for i in range(0, len(x), 1024):
                    near = (x[i:i + 1024] @ c.T - half).argmax(1)
                    cell[i:i + 1024] = near
                    away[i:i + 1024] = np.sqrt(((x[i:i + 1024] - c[near]) ** 2).sum(1)) * (1 + 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vec"), pa.array(cell, pa.int32()), pa.array(away)], names=["vec_id", "vec", "cell", "away"])

    dealt = materialize(vectors.select("vec_id", "vec").mapInArrow(assign, "vec_id long, vec array<double>, cell int, away double"), "cells")
    known = {r["cell"]: (shared.value[r["cell"]], float(r["radius"]), int(r["n"]))
             for r in dealt.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect()}
    return dealt, known


def reach(centre: np.ndarray, radius: float, others: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """The largest inner product of a row of one ball and a row of each of the others."""
    x = others @ centre + radius * np.sqrt((others * others).sum(1)) + radii * (np.sqrt(centre @ centre) + radius)
    return x + 1e-9 * np.abs(x) + 1e-6


def block_pairs(query_blocks: DataFrame, cells: dict[int, tuple[np.ndarray, float, int]], data_block: int) -> DataFrame:
    """(q_cell, q_salt, cell, salt) of the pairs of blocks that may hold one of a query's k best, for query_blocks (cell, salt, radius, least)."""
    names = sorted(cells)
    shared = query_blocks.sparkSession.sparkContext.broadcast((names, np.stack([cells[c][0] for c in names]), np.array([cells[c][1] for c in names]), [blocks_for(cells[c][2], data_block) for c in names]))

    def near(batches):
        names, centres, radii, blocks = shared.value
        at = {c: i for i, c in enumerate(names)}
        for batch in batches:
            out = [[], [], [], []]
            for cell, salt, radius, least in zip(*(batch.column(c).to_pylist() for c in ("cell", "salt", "radius", "least")), strict=True):
                for i in np.flatnonzero(reach(centres[at[cell]], radius, centres, radii) >= least).tolist():
                    for to, x in zip(out, ([cell] * blocks[i], [salt] * blocks[i], [names[i]] * blocks[i], range(blocks[i])), strict=True):
                        to.extend(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in out], names=["q_cell", "q_salt", "cell", "salt"])

    return query_blocks.select("cell", "salt", "radius", "least").mapInArrow(near, "q_cell int, q_salt int, cell int, salt int")


def meet_blocks(queries: DataFrame, data: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): each query's k best of the data blocks that its block meets, none below the query's least."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, c = np.zeros((3, 0), np.int64)
        if left.num_rows and right.num_rows:
            q, d = same_width(matrix(left["l_vec"]), matrix(right["r_vec"]))
            a, b, c = dual_tree(left["l_vec_id"].to_numpy(), q, right["r_vec_id"].to_numpy(), d, k, left["l_least"].to_numpy())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.int64())})

    pairs = materialize(pairs, "pairs")
    by = ["q_cell", "q_salt", "cell", "salt"]
    left = pairs.join(queries.select(F.col("cell").alias("q_cell"), F.col("salt").alias("q_salt"), "vec_id", "vec", "least"), ["q_cell", "q_salt"])
    right = pairs.join(data.select("cell", "salt", "vec_id", "vec"), ["cell", "salt"])
    left, right = (x.select(*(F.col(c).alias(f"{side}_{c}") for c in (*by, *(c for c in x.columns if c not in by)))) for side, x in (("l", left), ("r", right)))
    return left.groupBy(*left.columns[:4]).cogroup(right.groupBy(*right.columns[:4])).applyInArrow(search, RESULT.format("long"))


def exact_top_k(df: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding",
                data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK, cells: int = 1024) -> DataFrame:
    """The k rows of largest integer inner product for each row whose id is divisible by every.

    Components become floor(scale * x). Returns query_id, rank (from 1), vec_id, score (long).
    Null vectors, and those with a null or non-finite component, take no part; a repeated id counts once
    and a query never finds its own id; shorter vectors count as filled with zeros; fewer than k
    candidates are all returned; an empty table gives no rows. Other columns are ignored. Scores are exact
    up to 2^53. The table has at most `cells` cells, and fewer where blocks would be far from full.
    """
    rows = clean_vectors(df, id_col, vector_col, drop_zero=False)
    rows = materialize(rows.withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale).cast("double"))), "vectors")
    spark = df.sparkSession
    data, known = cells_of(rows, min(cells, blocks_for(rows.count(), data_block)))
    if not known:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    names = sorted(known)
    centres, radii = np.stack([known[c][0] for c in names]), np.array([known[c][1] for c in names])
    is_query, h = F.col("vec_id") % every == 0, F.xxhash64("vec_id")
    asked = {r["cell"]: r["n"] for r in data.where(is_query).groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each cell at most
    plan = spark.createDataFrame(
        [(c, blocks_for(known[c][2], data_block), blocks_for(asked.get(c, 0), query_block), int(names[int((centres @ known[c][0]).argmax())])) for c in names],
        "cell int, blocks int, q_blocks int, first int")
    placed = data.join(F.broadcast(plan), "cell")
    queries = placed.where(is_query).select("vec_id", "vec", "cell", F.pmod(F.shiftright(h, 20), "q_blocks").cast("int").alias("salt"), "away", "first")
    data = placed.select("vec_id", "vec", "cell", F.pmod(h, "blocks").cast("int").alias("salt"))
    none = F.lit(float("-inf"))
    # the first block of each query block: of the cell with the best centre
    widths = plan.select(F.col("cell").alias("first"), F.col("blocks").alias("n"))
    first = queries.groupBy("cell", "salt", "first").agg(F.max("away").alias("radius")).join(F.broadcast(widths), "first")
    first = first.select(F.col("cell").alias("q_cell"), F.col("salt").alias("q_salt"), F.col("first").alias("cell"), F.pmod("q_salt", "n").alias("salt"), "radius")
    met = materialize(meet_blocks(queries.withColumn("least", none), data, first.drop("radius"), k), "first-block")
    kth = met.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(none).alias("least"))
    queries = materialize(queries.join(kth.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").fillna(float("-inf"), ["least"]), "queries")
    blocks = queries.groupBy("cell", "salt").agg(F.max("away").alias("radius"), F.min("least").alias("least"))
    pairs = block_pairs(blocks, known, data_block).join(first.drop("radius"), ["q_cell", "q_salt", "cell", "salt"], "left_anti")
    met = met.unionByName(meet_blocks(queries, data, pairs, k))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
