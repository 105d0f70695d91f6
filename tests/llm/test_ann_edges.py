"""Nearest neighbours at the edges: values whose products overflow, ties at the last place, repeated ids."""

import numpy as np
import pytest

from tidepool.llm import ann


def exact(q, p):
    """The inner product in whole numbers of a fine grid, as a double (infinite beyond its range)."""
    from fractions import Fraction

    x = sum((Fraction(a) * Fraction(b) for a, b in zip(q, p, strict=True)), Fraction(0))
    try:
        return float(x)
    except OverflowError:
        return float("inf") if x > 0 else float("-inf")


def plain(rows, k, every):
    rows = {i: v for i, v in sorted(rows, key=lambda r: (r[0], r[1]), reverse=True)}
    out = {}
    for q in (i for i in rows if i % every == 0):
        near = sorted(((exact(rows[q], v), -i) for i, v in rows.items() if i != q), reverse=True)[:k]
        out[q] = [(-i, s) for s, i in near]
    return out


@pytest.mark.parametrize("huge", [60, 400, 5])
def test_values_whose_products_overflow(spark, huge):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (1e300 if i < huge else 1)]) for i in range(400)]
    want = plain(rows, 20, 20)
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), data_block=128, query_block=64).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want)
    for q, near in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in near]
        assert np.allclose([s for _, s in got[q]], [s for _, s in near], rtol=1e-9)


def test_ties_at_the_last_place_and_repeated_ids(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(200)] + [(40, [2.0, 1.0]), (40, [0.5, 1.0]), (7, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    best = {}
    for i, v in rows:
        best[i] = min(v, best.get(i, v))
    want = plain(list(best.items()), 20, 20)
    got = {}
    for r in ann.nearest(df, data_block=64, query_block=64).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == want
