"""The filter audit, the LSH forest and whitening against plain computations of the same contracts."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.oracle import connect, difference
from tidepool.llm import filter_audit, lsh_forest, queries, whitening

BASE = "the quick brown fox jumps over the lazy dog and runs far away from the old stone bridge near the river bank today"
LONG = " ".join(f"wort{i % 977} text{i % 31}" for i in range(60_000))
SCHEMA = "doc_id long, text string, source string, n long, part string, good boolean, id long, size int, low string, key int"
X = (7, "p", True, 1, 2, "z", 3)
WORDS = [f"w{i}" for i in range(400)]
ODD = [(1, None, "a"), (2, "", None), (3, BASE, "a"), (4, BASE.upper(), "a"), (4, BASE, "b"), (4, BASE, "b"), (5, BASE + " end", None), (6, LONG, "b"), (7, LONG + " tail", "b"), (None, BASE, "a"), (None, None, None),
       (8, "one two", "a"), (9, "One  TWO\n", ""), (10, "Ünï É x costs $5", "c"), (11, " \t\r\n", "c"), (12, " ".join(WORDS), "c"), (13, " ".join(WORDS[:390]), "c"), (14, "a b c d e f", "c"), (-3, BASE + " again", "d")]


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_lsh_forest"])
def test_same_rows_as_sql(spark, data, name):
    assert difference(queries.QUERIES[name](spark, data), connect(data), queries.ORACLE_SQL[name]) == ""


# --- filter audit ---


def audited(rows, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    first, good, toxic = {}, defaultdict(bool), defaultdict(bool)
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    for d, q, x in labels:
        good[d] |= q == 1
        toxic[d] |= x == 1
    docs = []
    for d, t, s in rows:
        t = t or ""
        w = words(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and first[t] < d}
        docs.append((s or "", {f for f in fails if fails[f]}, d is not None and good[d], d is not None and toxic[d]))
    out, shapley = {}, Counter()
    for order in itertools.permutations("ABCDE"):
        alive = dict.fromkeys(range(len(docs)))
        for i, f in enumerate(order):
            for part in {d[0] for d in docs}:
                own = [k for k in range(len(docs)) if docs[k][0] == part]
                gone = [k for k in own if k in alive and f in docs[k][1]]
                shapley[part, f] += len(gone)
                out[part, "".join(order), i + 1] = [sum(k in alive for k in own) - len(gone), len(gone), sum(f in docs[k][1] and k not in alive for k in own),
                                                    sum(docs[k][1] == {f} for k in own), sum(docs[k][2] for k in gone), sum(docs[k][3] for k in gone)]
            alive = {k: None for k in alive if f not in docs[k][1]}
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_audit_of_odd_rows(spark):
    labels = [(3, 1, 0), (4, 0, 1), (4, 1, None), (5, None, 1), (6, 1, 1), (99, 1, 1), (None, 1, 1), (12, 1, 0)]
    docs = spark.createDataFrame([(*r, *X) for r in ODD], SCHEMA)
    out = filter_audit.of_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in out.collect()}
    assert got == audited(ODD, labels)


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert filter_audit.of_documents(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_audit_of_other_filters(spark):
    counts = spark.createDataFrame([("p", True, False, 5, 1, 0), ("p", True, True, 2, 0, 2), ("q", False, False, 1, 1, 1)], "part string, x boolean, y boolean, n long, good long, toxic long")
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in filter_audit.audit(counts, "xy").collect()}
    assert got == {("p", "xy", 1): (0, 7, 0, 5, 12), ("p", "xy", 2): (0, 0, 2, 0, 2), ("p", "yx", 1): (5, 2, 0, 0, 2), ("p", "yx", 2): (0, 5, 2, 5, 12),
                   ("q", "xy", 1): (1, 0, 0, 0, 0), ("q", "xy", 2): (1, 0, 0, 0, 0), ("q", "yx", 1): (1, 0, 0, 0, 0), ("q", "yx", 2): (1, 0, 0, 0, 0)}
    with pytest.raises(ValueError, match="filters"):
        filter_audit.audit(counts, "xx")


# --- LSH forest ---


def shingled(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)] if w else [])


def near_components(rows):
    """(doc_id, n_shingles, component_id) of each row with an id, by comparing every pair of sets."""
    sets = [(d, shingled(t)) for d, t in rows if d is not None]
    names = list({s for _, s in sets if s})
    root = list(range(len(names)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in itertools.combinations(range(len(names)), 2):
        a, b = names[i], names[j]
        if min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
            root[find(j)] = find(i)
    place = {s: find(i) for i, s in enumerate(names)}
    low = {}
    for d, s in sets:
        if s:
            low[place[s]] = min(d, low.get(place[s], d))
    return Counter((d, len(s), low[place[s]] if s else d) for d, s in sets)


def found(out):
    rows = out.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows)


def test_forest_of_odd_rows(spark):
    docs = spark.createDataFrame([(*r, *X) for r in ODD], SCHEMA)
    assert found(lsh_forest.near_duplicates(docs)) == near_components([(d, t) for d, t, _ in ODD])
    assert lsh_forest.near_duplicates(docs.limit(0)).count() == 0
    assert found(lsh_forest.near_duplicates(docs.where("text IS NULL"))) == Counter([(1, 0, 1)])


def test_shingles_are_those_of_the_words():
    texts = [t for _, t, _ in ODD if t] + ["", "\n", "x", "ab c\nab c", "a b c d e a b c d e"]
    for t, s in zip(texts, lsh_forest.shingle_sets(texts, 4), strict=True):
        assert len(s) == len(shingled(t))
    one, other, more = lsh_forest.shingle_sets(["a b c d", "d c b a", "A\tB  c\rd"], 4)
    assert one != other and (one == more).all()


def dense(rows, chance, shared=60, own=60, seed=3):
    """Texts that hold a third to a half in common, some of them near copies of others, in chains."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(shared)]
    out = []
    for d in range(rows):
        if out and rng.random() < chance:
            words = rng.choice(out)[1].split()
            words[rng.randrange(shared, len(words))] = f"x{rng.randrange(9)}"
        else:
            words = common + [f"o{rng.randrange(10 ** 9)}" for _ in range(own)]
        out.append((d, " ".join(words)))
    rng.shuffle(out)
    return out


def test_forest_of_dense_regions(spark):
    rows = dense(800, 0.3)
    assert found(lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == near_components(rows)


def test_forest_with_small_ranges(spark, monkeypatch):
    """Regions cut by the ends of ranges give no credit, so sets go through further rounds, and at last through all tiles."""
    monkeypatch.setattr(lsh_forest, "RANGE", 300)
    rows = dense(500, 0.5, seed=5)
    calls = []
    tiles = lsh_forest.all_tiles
    monkeypatch.setattr(lsh_forest, "all_tiles", lambda *a: calls.append(1) or tiles(*a))
    assert found(lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == near_components(rows)
    assert calls


def test_regions_adapt_their_depth(monkeypatch):
    monkeypatch.setattr(lsh_forest, "REGION", 8)
    rng = np.random.default_rng(1)
    rows = 3000
    low = rng.integers(0, 256, (rows, lsh_forest.POSITIONS), np.uint8)
    keys = rng.integers(0, 4, (rows, lsh_forest.DEPTH)).astype(np.uint16)
    low[100:200] = low[100]
    keys[100:200] = keys[100]
    order = np.sort(rng.integers(0, 2, rows))
    at = np.lexsort((*keys.T[::-1], order))
    keys, low, at_place = keys[at], low[at], np.argsort(at)
    a, b, depth = lsh_forest.compare_range(keys, low, order, 0.6)
    tied = lsh_forest.tie(np.arange(rows), a, b)
    copies = [at_place[i] for i in range(100, 200)]
    for side in (0, 1):
        assert len({tied[i] for i in copies if order[i] == side}) <= 1
    assert depth[0] == depth[-1] == -1 and depth.max() <= lsh_forest.DEPTH and len(set(depth.tolist())) > 2
    for d in set(depth.tolist()) - {-1}:
        region = Counter((order[i], *keys[i, :d]) for i in range(rows))
        mine = [region[(order[i], *keys[i, :d])] for i in range(rows) if depth[i] == d]
        # small, or few of it outside its largest group, or as deep as it goes
        assert max(mine) <= 17 or max(mine) >= 40 or d == lsh_forest.DEPTH


def test_pairs_in_all_tiles(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "TILE", 64)
    rows = dense(400, 0.5, seed=8)
    sets = lsh_forest.shingle_sets([t for _, t in rows], 4)
    table = spark.createDataFrame([(d, bytearray(lsh_forest.signature(s).tobytes())) for (d, _), s in zip(rows, sets, strict=True)], "id long, sig binary")
    got = lsh_forest.all_tiles(table, 400, 0.8).collect()
    root = lsh_forest.tie(np.arange(400), np.array([r["a"] for r in got]), np.array([r["b"] for r in got]))
    by = {d: frozenset(s.tolist()) for (d, _), s in zip(rows, sets, strict=True)}
    for i, j in itertools.combinations(range(400), 2):
        if len(by[i] & by[j]) >= 0.8 * len(by[i] | by[j]):
            assert root[i] == root[j]


# --- whitening ---


def whitened(rows):
    """The contract in plain numpy: rows by position, or none."""
    usable = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v in usable), default=0)
    whole = [(i, [math.floor(256 * x) for x in v] + [0] * (width - len(v))) for i, v in usable]
    fit = sorted({tuple(x) for _, x in whole})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    if not n or not width:
        return [], n
    x = np.array(fit, float)
    centred = x - x.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = []
    for i, v in whole:
        for c in range(min(4, width)):
            e = values[-1 - c]
            if e > 1e-9:
                out.append((i, c + 1, n, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)), abs(float((np.array(v) - x.mean(0)) @ vectors[:, -1 - c] / math.sqrt(e))), e / values.sum()))
    return out, n


def check_whitened(spark, rows):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, n int, x string").repartition(5)
    all_rows = whitening.whiten(df).collect()
    got = sorted(((r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in all_rows), key=str)
    want = sorted(whitened(rows)[0], key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-6, atol=1e-6)
    assert len({r["identity_error"] for r in all_rows}) <= 1 and all(r["identity_error"] < 1e-9 for r in all_rows)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    scale = np.array([5, 3, 2, 1, 0.5, 0.1])
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6) * scale]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]
    rows += [(None, rows[3][1]), (5, rows[4][1]), (2000, None), (2001, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (2002, [float("nan")] * 6), (2003, [float("inf"), 1.0]), (2004, [0.25, -0.0]), (2005, [])]
    check_whitened(spark, rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])], [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0])], [(1, [0.0, 1.0, 0.0]), (2, [2.0, 0.0, 1.0]), (3, [1.0, 0.0, -1.0])]])
def test_whitening_of_few_rows(spark, rows):
    check_whitened(spark, rows)


def test_merged_moments_are_those_of_all():
    rng = np.random.default_rng(2)
    x = rng.integers(-900, 900, (1000, 7)) + 100_000
    total = whitening.EMPTY
    for part in np.split(x, [1, 2, 300, 301, 900]):
        total = whitening.merge(total, whitening.moments_of(part, whitening.exact_sums(part)))
    assert total.n == 1000 and total.sums == x.sum(0).tolist()
    assert np.allclose(total.scatter / 1000, np.cov(x.T, bias=True), rtol=1e-12)


def test_deviations_are_exact():
    x = np.array([[3, -4], [2 ** 40, 5], [2 ** 62, -(2 ** 62)]])
    for n, sums in ((7, [10, -3]), (10 ** 9, [10 ** 15, -(10 ** 14)])):
        want = [sum((n * int(v) - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x]
        assert whitening.deviations(x, n, sums) == [v if v < 2 ** 63 else None for v in want]
        assert whitening.deviations(x[:1], n, sums) == [v if v < 2 ** 63 else None for v in want[:1]]
    assert whitening.exact_sums(np.array([[2 ** 62], [2 ** 62]])) == [2 ** 63]
