"""Quality scores from a sparse ensemble of rules.

Statistics of a text are Spark columns. Boosted trees over a bounded labelled sample propose rules: each
tree path is a conjunction of thresholds on statistics. A lasso logistic regression weighs the rules, most
to zero, and the rest are compiled back into one Spark column expression.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import hash_sample, held_out

#: Characters whose share of the text is a statistic each.
MARKS = {"bar": "|", "star": "*", "hash": "#", "percent": "%", "dollar": "$", "amp": "&", "bang": "!", "question": "?", "dot": ".", "comma": ",", "newline": "\n", "brace": "{", "less": "<", "slash": "/"}
Rule = tuple[tuple[int, float, bool], ...]  # (statistic, threshold, at most it)


def statistics(text: str = "text") -> dict[str, Column]:
    """Statistics of the whole text by name; a null text counts as empty, and all are 0 for it."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.length(t)
    words = F.split(t, r"\s+")
    lines = F.split(t, "\n")
    n_words, n_lines = F.size(words), F.size(lines)

    def share(x: Column, of: Column) -> Column:
        return F.coalesce(x / F.when(of > 0, of), F.lit(0.0)).cast("double")

    stats = {
        "chars": n.cast("double"),
        "words": F.when(n > 0, n_words).otherwise(0).cast("double"),
        "lines": F.when(n > 0, n_lines).otherwise(0).cast("double"),
        "word_length": share(n, n_words),
        "distinct_words": F.when(n > 0, share(F.size(F.array_distinct(words)), n_words)).otherwise(0.0),
        "distinct_lines": F.when(n > 0, share(F.size(F.array_distinct(lines)), n_lines)).otherwise(0.0),
        "capitals": share(n - F.length(F.regexp_replace(t, r"\p{Lu}+", "")), n),
        "letters": share(n - F.length(F.regexp_replace(t, r"\p{L}+", "")), n),
        "digits": share(n - F.length(F.regexp_replace(t, "[0-9]+", "")), n),
    }
    return stats | {name: share(n - F.length(F.replace(t, F.lit(mark))), n) for name, mark in MARKS.items()}


def _tree(x: np.ndarray, edges: list[np.ndarray], rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, least: int) -> dict:
    """One regression tree on binned statistics by second-order gain."""
    g, h = grad[rows].sum(), hess[rows].sum()
    node = {"value": g / (h + 1.0)}
    if depth == 0 or len(rows) < 2 * least:
        return node
    best = (1e-6, -1, -1)
    for j in range(x.shape[1]):
        bins = len(edges[j]) + 1
        if bins < 2:
            continue
        b = x[rows, j]
        gs, hs, ns = (np.cumsum(np.bincount(b, w, bins))[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g * g / (h + 1)
        gain[(ns < least) | (len(rows) - ns < least)] = -1
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), j, k)
    if best[1] >= 0:
        _, j, k = best
        go = x[rows, j] <= k
        node |= {"split": (j, float(edges[j][k])), "low": _tree(x, edges, rows[go], grad, hess, depth - 1, least), "high": _tree(x, edges, rows[~go], grad, hess, depth - 1, least)}
    return node


def grow_rules(stats: np.ndarray, label: np.ndarray, trees: int = 40, depth: int = 3, bins: int = 32, seed: int = 5) -> list[Rule]:
    """The paths of boosted trees, as conjunctions, each once."""
    edges = [np.unique(np.quantile(stats[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(stats.shape[1])]
    x = np.stack([np.searchsorted(e, stats[:, j], "left") for j, e in enumerate(edges)], 1)
    rng = np.random.default_rng(seed)
    margin = np.zeros(len(label))
    found: dict[Rule, None] = {}

    def walk(node: dict, path: Rule, rows: np.ndarray) -> None:
        if path:
            found[tuple(sorted(path))] = None
        if "split" not in node:
            margin[rows] += 0.2 * node["value"]
            return
        j, at = node["split"]
        go = stats[rows, j] <= at
        walk(node["low"], (*path, (j, at, True)), rows[go])
        walk(node["high"], (*path, (j, at, False)), rows[~go])

    every = np.arange(len(label))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        rows = every[rng.random(len(label)) < 0.6]
        if len(rows):
            walk(_tree(x, edges, rows, label - p, p * (1 - p), depth, max(5, len(label) // 400)), (), every)
    return list(found)


def holds(stats: np.ndarray, rule: Rule) -> np.ndarray:
    return np.logical_and.reduce([(stats[:, j] <= at) if low else (stats[:, j] > at) for j, at, low in rule])


def lasso(rules: np.ndarray, label: np.ndarray, penalty: float = 0.002, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights of 0/1 rules and the intercept: accelerated proximal gradient on logistic loss with an L1 penalty."""
    n, m = rules.shape
    rate = 4.0 / (np.linalg.norm(rules, 2) ** 2 / n + 1)
    w = v = np.zeros(m)
    b = c = float(np.log((label.mean() + 1e-3) / (1 - label.mean() + 1e-3)))
    t = 1.0
    for _ in range(steps):
        err = 1 / (1 + np.exp(-(rules @ v + c))) - label
        new = v - rate * (rules.T @ err) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b = c - rate * err.mean()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / s * (new - w), new_b + (t - 1) / s * (new_b - b)
        w, b, t = new, new_b, s
    return w, b


def compile_rules(rules: list[tuple[Rule, float]], intercept: float, names: list[str]) -> Column:
    """The ensemble as one column over the named statistics."""
    parts = [F.when(reduce(lambda a, b: a & b, [(F.col(names[j]) <= at) if low else (F.col(names[j]) > at) for j, at, low in rule]), F.lit(w)).otherwise(0.0) for rule, w in rules]
    z = reduce(lambda a, b: a + b, parts, F.lit(intercept))
    return 1 / (1 + F.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int, text: str = "text") -> tuple[list[tuple[Rule, float]], float]:
    """Rules with weights, and the intercept, from at most sample_rows labelled documents that aren't held out.

    A document with several labels takes their rounded mean; null labels don't count.
    """
    each = (labels.where(~held_out() & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
            .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("__label")))
    bounded = hash_sample(each, sample_rows, "doc_id")
    stats = statistics(text)
    rows = docs.join(F.broadcast(bounded), "doc_id").select("__label", *(c.alias(k) for k, c in stats.items())).toPandas()
    if not len(rows):
        return [], 0.0
    label, x = rows["__label"].to_numpy(), rows[list(stats)].to_numpy(float)
    rules = grow_rules(x, label)
    if not rules:
        return [], float(np.log((label.mean() + 1e-3) / (1 - label.mean() + 1e-3)))
    w, b = lasso(np.stack([holds(x, r) for r in rules], 1).astype(float), label)
    return [(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-6], b


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = 12000, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: quality 1 likelier) and predicted (1 if score >= threshold) of every row.

    Learns from at most sample_rows labelled documents whose crc32(doc_id as text) mod 5 is not 0 (a parameter);
    scores use whole texts alone. A null text counts as empty and is scored; repeated rows each keep a row; no
    labels give every row 0.5; a null doc_id counts as not held out; other columns are ignored.
    """
    docs = docs.select("doc_id", F.col(text).alias("__text"))
    rules, intercept = fit(docs, labels.select("doc_id", "quality"), sample_rows, "__text")
    stats = statistics("__text")
    used = sorted({j for r, _ in rules for j, _, _ in r})
    names = list(stats)
    rows = docs.select("doc_id", held_out().alias("held_out"), *(stats[names[j]].alias(names[j]) for j in used))
    return (rows.withColumn("score", compile_rules(rules, intercept, names))
            .select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted")))
