"""Nearest neighbours by blocks: int8 tiles bound every product, survivors are recomputed in doubles."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame

from tidepool.llm.vectors import clean_vectors, search_blocks

TILE = 1024


def norms(m: np.ndarray) -> np.ndarray:
    """Lengths of rows; squares don't overflow before the length does."""
    top = np.abs(m).max(1, initial=0)
    return top * np.sqrt(((m / np.where(top > 0, top, 1)[:, None]) ** 2).sum(1))


def product_of(a: np.ndarray, b: np.ndarray) -> float:
    """The inner product; where partial sums overflow it is taken of scaled vectors, so it is never undefined."""
    with np.errstate(over="ignore", invalid="ignore"):
        x = float(a @ b)
        if np.isfinite(x):
            return x
        tops = sorted((float(np.abs(a).max()), float(np.abs(b).max())))
        return float((a / np.abs(a).max()) @ (b / np.abs(b).max())) * tops[0] * tops[1]


def quantise(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, each row's step, and the length of what rounding lost in each row."""
    step = np.abs(m).max(1) / 127.0
    codes = np.rint(m / np.where(step > 0, step, 1)[:, None]).astype(np.int8)
    lost = m - codes * step[:, None]
    return codes, step, norms(lost)


def tile_join(q_ids: np.ndarray, queries: np.ndarray, d_ids: np.ndarray, data: np.ndarray, k: int):
    """Every query's k nearest of data by inner product: (query ids, ids, scores).

    With q = a + e and p = b + f (codes times steps, and what rounding lost), <q, p> differs from <a, b>
    by at most |e| |p| + |a| |f|. Per tile a query's pairs are kept where product + bound reaches its kth
    best lower bound so far; only these are recomputed in doubles and offered to the query's heap.
    """
    qc, qs, qe = quantise(queries)
    dc, ds, de = quantise(data)
    qa, dn = norms(queries) + qe, norms(data)
    heaps: list[list[tuple[float, int]]] = [[] for _ in q_ids]
    qf = qc.astype(np.float64 if queries.shape[1] > 1000 else np.float32)  # whole numbers, exact in either
    for at in range(0, len(d_ids), TILE):
        part = slice(at, at + TILE)
        with np.errstate(over="ignore", invalid="ignore"):
            product = (qf @ dc[part].T.astype(qf.dtype)) * (qs[:, None] * ds[part][None, :])
            bound = (qe[:, None] * dn[part][None, :] + qa[:, None] * de[part][None, :]) * (1 + 1e-9) + 1e-12
            low, high = product - bound, product + bound
        # values whose products overflow have no bound: they say nothing of others, and survive
        open_ = ~np.isfinite(low) | ~np.isfinite(high)
        low[open_], high[open_] = -np.inf, np.inf
        own = q_ids[:, None] == d_ids[part][None, :]
        low[own] = -np.inf
        width = low.shape[1]
        floor = np.partition(low, width - k, 1)[:, width - k] if width >= k else np.full(len(q_ids), -np.inf)
        floor = np.maximum(floor, [h[0][0] if len(h) == k else -np.inf for h in heaps])
        for i, j in zip(*np.nonzero((high >= floor[:, None]) & ~own), strict=True):
            item = (product_of(queries[i], data[at + j]), -int(d_ids[at + j]))
            if len(heaps[i]) < k:
                heapq.heappush(heaps[i], item)
            elif item > heaps[i][0]:
                heapq.heapreplace(heaps[i], item)
    flat = [(q, -i, s) for q, h in zip(q_ids, heaps, strict=True) for s, i in h]
    if flat:
        q, i, s = zip(*flat, strict=True)
        yield np.array(q), np.array(i), np.array(s, dtype=np.float64)


def nearest(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", **blocks) -> DataFrame:
    """The k rows of largest inner product for each row whose id is divisible by every.

    The bounds are proven, so nothing is missed: recall is 1. Returns query_id, rank (from 1), vec_id,
    score (double, on the original vectors), ties to the smaller id. Null and zero vectors, and those with a
    null or non-finite component, take no part; a repeated id counts once; a query never finds its own
    id; an empty table gives no rows; other columns are ignored.
    """
    return search_blocks(clean_vectors(df, id_col, vector_col, drop_zero=True), every, k, tile_join, "double", **blocks)
