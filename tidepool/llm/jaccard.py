"""Near-duplicate join of documents by the Jaccard similarity of their word n-grams: the chosen-path join.

Sets are embedded as minimum hashes. A run splits all sets on one sampled position: sets that share the
token there meet in a node. Nodes are split again on further sampled positions until they are small or can't be
split with gain, and are then compared by brute force on the embedding. Runs repeat until a pair at the
threshold is missed with at most the probability asked for. What meets is only a candidate: candidates are
gathered into components, and within each every pair is compared exactly on the whole n-gram sets.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import blocks_for, materialize, tidy

POSITIONS = 64
LEAF = 64
TILE = 256
HEADS = 16
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_seeds = mix(np.arange(1, POSITIONS + 1, dtype=np.uint64) * _M1)
_alnum: list[tuple[np.ndarray, np.ndarray]] = []


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: does it stand in a word (letters and digits), and its lower case."""
    if not _alnum:
        word, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
        for i in range(0x33480):
            c = chr(i)
            word[i] = c.isalnum()
            if len(x := c.lower()) == 1:
                lower[i] = ord(x)
        _alnum.append((word, lower))
    return _alnum[0]


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's n-word shingles; a shorter text has one shingle of all its words."""
    word, lower = _code_tables()
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    mask = word[codes]
    begins = np.flatnonzero(mask & ~np.concatenate(([False], mask[:-1])))
    if not len(begins):
        return [np.zeros(0, np.uint64) for _ in texts]
    kept = np.flatnonzero(mask)
    starts = np.searchsorted(kept, begins)
    c = lower[codes[kept]].astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        # a polynomial of each word's letters, from running sums: exact modulo 2^64
        place = np.arange(len(kept)) - np.repeat(starts, np.diff(np.append(starts, len(kept))))
        power = np.cumprod(np.full(int(place.max()) + 1, _M1))
        h = mix(np.add.reduceat(c * power[place], starts))
        rolled = h
        if n > 1:
            rolled = h.copy()
            for k in range(1, n):
                rolled[:-k] += mix(h[k:] + np.uint64(k))
            rolled = mix(rolled)
        ends = np.cumsum([len(t) + 1 for t in texts])
        last = np.searchsorted(begins, ends)
        out, at = [], 0
        for e in last.tolist():
            if e - at >= n:
                out.append(np.unique(rolled[at:e - n + 1]))
            elif e > at:
                few = np.uint64(e - at)
                for x in h[at:e]:
                    few = mix(np.array([few * _M1 + x]))[0]
                out.append(np.array([few], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
            at = e
    return out


def signature(tokens: np.ndarray) -> np.ndarray:
    """The minimum of each of POSITIONS hash functions over the set, 32 bits each."""
    low = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(tokens), 4096):
            x = tokens[i:i + 4096, None] ^ _seeds
            x = (x ^ (x >> np.uint64(29))) * _M2
            low = np.minimum(low, (x ^ (x >> np.uint64(32))).min(0))
    return (low & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def set_name(tokens: bytes) -> str:
    return hashlib.blake2b(tokens, digest_size=16).hexdigest()


def embed(docs: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """(doc_id, set_id, sig) of every document with a word: set_id names its n-gram set, sig is the embedding."""
    def run(batches):
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            row, ids, sigs, at, size = [], [], [], 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size < 1_000_000 and i + 1 < len(texts):
                    continue
                for k, tokens in enumerate(shingle_sets(texts[at:i + 1], n), at):
                    if len(tokens):
                        row.append(k)
                        ids.append(set_name(tokens.tobytes()))
                        sigs.append(signature(tokens).tobytes())
                at, size = i + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(ids, pa.string()), pa.array(sigs, pa.binary())], names=["doc_id", "set_id", "sig"])

    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
            .mapInArrow(tidy(run), "doc_id long, set_id string, sig binary"))


def local_roots(close: np.ndarray) -> np.ndarray:
    """The smallest index in each row's component of a symmetric matrix of links."""
    label = np.arange(len(close))
    while True:
        new = np.where(close, label[None, :], len(close)).min(1)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def tie(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """label, the smallest row of each row's component, after the links (x, y) are added."""
    while len(x := x[apart := label[x] != label[y]]):
        y = y[apart]
        low = np.minimum(label[x], label[y])
        label = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while ((new := label[label]) != label).any():
            label = new
    return label


def agreeing(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which rows of a and b agree in at least that share of the positions (of their low bytes, so rarely more)."""
    if len(a) * len(b) <= LEAF * LEAF:
        return (a[:, None] == b[None]).sum(2) >= least * POSITIONS
    count = np.zeros((len(a), len(b)), np.uint8)
    for x, y in zip(a.T, b.T, strict=True):
        count += x[:, None] == y[None, :]
    return count >= least * POSITIONS


def compare_all(low: np.ndarray, least: float) -> np.ndarray:
    """The smallest row of each row's component, where rows that agree in at least that share are linked: every pair counts.

    Of a large node the rows near a few heads are tied first: pairs of tiles that are tied already say nothing new.
    """
    label = np.arange(len(low))
    if len(low) > TILE:
        for _ in range(16):
            free = np.flatnonzero(np.bincount(label, minlength=len(low))[label] == 1)
            if not len(free):
                break
            near = np.flatnonzero((low == low[free[0]]).sum(1) >= least * POSITIONS)
            label = tie(label, near, np.full(len(near), free[0]))
            if 16 * len(near) < len(low):
                break
    order = np.argsort(label, kind="stable")
    for i in range(0, len(low), TILE):
        a = order[i:i + TILE]
        for j in range(i, len(low), 8 * TILE):
            b = order[j:j + 8 * TILE]
            if (label[a] == label[a[0]]).all() and (label[b] == label[a[0]]).all():
                continue
            x, y = np.nonzero(agreeing(low[a], low[b], least))
            label = tie(label, a[x], b[y])
    return label


def chosen_paths(ids: np.ndarray, sigs: np.ndarray, used: tuple[int, ...], least: float, rng: np.random.Generator, branch: int = 4):
    """Split one node on sampled positions down to small nodes; yield (id, smaller id) links of each.

    branch positions are sampled at each node, so a pair at 0.8 parts here with probability 0.2 ** branch; positions
    where all sets agree part nothing and don't count. A node whose parts would cost about as much to compare as
    itself is not split: all of its pairs are compared.
    """
    low = sigs.astype(np.uint8)
    stack = [(np.arange(len(ids)), frozenset(used))]
    while stack:
        rows, done = stack.pop()
        if len(rows) < 2:
            continue
        if len(rows) > LEAF:
            parts, splits = [], 0
            for i in rng.permutation([i for i in range(POSITIONS) if i not in done]).tolist():
                order = rows[np.argsort(sigs[rows, i], kind="stable")]
                cut = np.flatnonzero(np.diff(sigs[order, i])) + 1
                if not len(cut):
                    done |= {i}
                    continue
                parts += [(np.sort(p), i) for p in np.split(order, cut) if len(p) > 1]
                splits += 1
                if splits == branch:
                    break
            if splits == branch and sum(len(p) ** 2 for p, _ in parts) <= 0.7 * len(rows) ** 2:
                stack += [(p, done | {i}) for p, i in parts]
                continue
        label = compare_all(low[rows], least)
        yield from ((ids[rows[x]], ids[rows[label[x]]]) for x in np.flatnonzero(label != np.arange(len(rows))))


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of every node's component, for undirected edges (a, b).

    Alternating large-star and small-star steps; each is a minimum per node, joined back, and is written to the
    shared folder. Stops when a round changes nothing: each round brings nodes nearer to their component's smallest, so one does.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            out = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            low = e.groupBy("a").agg(F.min("b").alias("m"))
            out = e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    print_of = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = print_of(edges)
    while True:
        edges = materialize(star(star(edges, True), False), "edges")
        now = print_of(edges)
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = now


def at(i: int):
    """The token at a position of the embedding, named by the position."""
    return F.concat(F.lit(f"{i}:"), F.hex(F.expr(f"substring(sig, {4 * i + 1}, 4)")))


def _near_heads(rows: DataFrame, least: float) -> DataFrame:
    """(id, key, label, head) for rows (id, key, sig): a head of the node that the row is near to, and the first head near that one.

    Without a near head label is -1. A node has at most HEADS heads, and only large nodes come here, so the heads are few.
    """
    heads: dict[str, list] = {}
    first = F.min(F.struct(F.xxhash64("key", "id").alias("h"), "id", "sig")).alias("s")
    for r in rows.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(HEADS))).agg(first).select("key", "s.id", "s.sig").collect():
        heads.setdefault(r["key"], []).append((r["id"], np.frombuffer(r["sig"], np.uint32).astype(np.uint8)))
    known = {}
    for key, pairs in heads.items():
        low = np.stack([x for _, x in pairs])
        known[key] = (np.array([i for i, _ in pairs]), low, local_roots(agreeing(low, low, least)))
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def mark(batches):
        for batch in batches:
            ids, key = batch.column("id").to_numpy(), batch.column("key").to_numpy(zero_copy_only=False)
            label, head = np.full(len(ids), -1), ids.copy()
            order = np.argsort(key, kind="stable")
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, POSITIONS).astype(np.uint8)
            for k in np.split(order, np.flatnonzero(key[order][1:] != key[order][:-1]) + 1) if len(ids) else ():
                names, low, root = shared.value[key[k[0]]]
                near = agreeing(sigs[k], low, least)
                hit, near = near.any(1), near.argmax(1)
                label[k], head[k] = np.where(hit, root[near], -1), np.where(hit, names[near], ids[k])
                # heads that are near each other count as one group, so their links must be there too
                at_head = np.isin(ids[k], names)
                for x in k[at_head]:
                    label[x] = root[(names == ids[x]).argmax()]
                    head[x] = names[label[x]]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(label, pa.int32()), pa.array(head, pa.int64())], names=["id", "key", "label", "head"])

    return rows.select("id", "key", "sig").mapInArrow(tidy(mark), "id long, key string, label int, head long")


def divide(large: DataFrame, reps: DataFrame, least: float, picks: list[int], node_rows: int):
    """One level for nodes (id, key) of over node_rows sets: links, bounded nodes, their rows, and nodes still too large.

    Sets near a head of their node are tied to it, and pairs of sets tied to one head say nothing new. What is
    left outside the largest such group meets everything in tiles of that group, if it is at most node_rows sets;
    otherwise the node is split on the positions picks, or, where the parts would cost as much to compare as the node
    (or no position is left), each pair of its tiles becomes a node. No row is left out.
    """
    spark = large.sparkSession
    tagged = materialize(_near_heads(large.join(reps.select("id", "sig"), "id"), least), "heads")
    links = tagged.where("head <> id").select(F.col("id").alias("a"), F.col("head").alias("b"))
    sizes: dict[str, dict[int, int]] = {}
    for r in tagged.groupBy("key", "label").count().collect():  # at most HEADS + 1 rows of each large node
        sizes.setdefault(r["key"], {})[r["label"]] = r["count"]
    few, wide = [], {}
    for key, by in sizes.items():
        most = max((x for x in by if x >= 0), key=by.__getitem__, default=-1)
        rest = sum(by.values()) - by.get(most, 0) if most >= 0 else sum(by.values())
        if most >= 0 and 0 < rest <= node_rows:
            few.append((key, most, math.ceil(by[most] / node_rows), by[most], rest))
        elif rest:
            wide[key] = sum(by.values())
    bounded, total = [], 0
    if few:
        t = tagged.join(F.broadcast(spark.createDataFrame(few, "key string, most int, tiles int, n long, rest long")), "key")
        own = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
        every = F.sequence(F.lit(0), F.col("tiles") - 1)
        t = t.select("id", "key", F.explode(F.when(F.col("label") == F.col("most"), F.array(own)).otherwise(every)).alias("tile"))
        bounded.append(t.select("id", F.concat_ws("/", "key", F.concat(F.lit("t"), F.col("tile").cast("string"))).alias("key")))
        total += sum(n + rest * tiles for _, _, tiles, n, rest in few)
    again = None
    if wide and picks:
        t = tagged.join(F.broadcast(spark.createDataFrame([(k,) for k in wide], "key string")), "key").join(reps.select("id", "sig"), "id")
        kids = materialize(t.select("id", "label", F.col("key").alias("parent"), F.explode(F.array(*(F.concat_ws("/", "key", at(i)) for i in picks))).alias("key")), "parts")
        counts = kids.groupBy("parent", "key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
        counts = materialize(counts.where("n > 1 AND (low < high OR low < 0)"), "parts")
        cost = {r["parent"]: r["c"] for r in counts.groupBy("parent").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("c")).collect()}
        split = [k for k, n in wide.items() if cost.get(k, 0) <= 0.7 * n * n]
        if split:
            chosen = counts.join(F.broadcast(spark.createDataFrame([(k,) for k in split], "parent string")), "parent").select("key", "n")
            # the few large parts are found by broadcast, so none of them goes through one task of a shuffle
            again = kids.join(F.broadcast(chosen.where(F.col("n") > node_rows).select("key")), "key").select("id", "key")
            bounded.append(kids.join(chosen.where(F.col("n") <= node_rows), "key").select("id", "key"))
            total += int(chosen.where(F.col("n") <= node_rows).agg(F.sum("n")).first()[0] or 0)
        wide = {k: n for k, n in wide.items() if k not in set(split)}
    if wide:
        half = max(1, node_rows // 2)
        plan = [(k, math.ceil(n / half)) for k, n in wide.items()]
        t = tagged.join(F.broadcast(spark.createDataFrame(plan, "key string, tiles int")), "key")
        t = t.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        pair = F.concat_ws("-", F.least("tile", "other").cast("string"), F.greatest("tile", "other").cast("string"))
        bounded.append(t.select("id", F.concat_ws("/", "key", pair).alias("key")))
        total += sum(n * math.ceil(n / half) for n in wide.values())
    return links, bounded, total, again


def bounded_nodes(reps: DataFrame, threshold: float, miss: float, node_rows: int, branch: int = 4):
    """(nodes, links, rows): nodes (id, key) of about node_rows sets at most, links (a, b) found on the way (or None), and about how many rows nodes has.

    Runs: one sampled position each, as many as keep a pair at the threshold apart with probability at most miss. Nodes of
    over node_rows sets are divided by Spark, level by level on further positions, until all are bounded.
    """
    runs = math.ceil(math.log(miss) / math.log(1 - threshold))
    if runs > POSITIONS // 2:
        raise ValueError(f"a threshold of {threshold} at a miss rate of {miss} takes {runs} runs, over {POSITIONS // 2}")
    picks = [int(x) for x in np.random.default_rng(17).permutation(POSITIONS)]
    first, free = picks[:runs], picks[runs:]
    keys = reps.select("id", "sig", F.explode(F.array(*(at(i) for i in first))).alias("key"))
    counts = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(keys.select("id", "key").join(counts, "key"), "nodes")
    nodes, links, rows = met.where(F.col("n") <= node_rows).select("id", "key"), None, reps.count()
    large = met.where(F.col("n") > node_rows).select("id", "key")
    while large is not None and not large.isEmpty():
        found, bounded, more, large = divide(large, reps, least_share(threshold), free[:branch], node_rows)
        free, rows = free[branch:], rows + more
        links = found if links is None else links.unionByName(found)
        for b in bounded:
            nodes = nodes.unionByName(b)
        large = None if large is None else materialize(large, "nodes")
    return nodes, links, rows


def least_share(threshold: float) -> float:
    """The share of positions in which a pair at the threshold agrees, but for six standard deviations."""
    return threshold - 6 * math.sqrt(threshold * (1 - threshold) / POSITIONS)


def candidate_links(reps: DataFrame, threshold: float, miss: float, node_rows: int = 20_000) -> DataFrame:
    """(a, b) links that tie together all sets which may reach the threshold; no task gets a node of over about 2 * node_rows sets."""
    nodes, links, rows = bounded_nodes(reps, threshold, miss, node_rows)
    nodes = nodes.join(reps.select("id", "sig"), "id")
    parts = blocks_for(rows, 10_000)
    least = least_share(threshold)

    def split(group: pa.Table) -> pa.Table:
        order = np.lexsort((group["id"].to_numpy(), group["key"].to_numpy(zero_copy_only=False)))
        ids, key = group["id"].to_numpy()[order], group["key"].to_numpy(zero_copy_only=False)[order]
        sigs = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint32).reshape(-1, POSITIONS)[order]
        found: set[tuple[int, int]] = set()
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        for rows in np.split(np.arange(len(ids)), cut):
            if len(rows) > 1:
                used = tuple(int(x.split(":")[0]) for x in str(key[rows[0]]).split("/") if ":" in x)
                seed = int(sigs[rows[0], used[0]]) + used[0]
                found.update((int(a), int(b)) for a, b in chosen_paths(ids[rows], sigs[rows], used, least, np.random.default_rng(seed)))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    near = nodes.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(4 * parts))).groupBy("part").applyInArrow(split, "a long, b long")
    return near if links is None else near.unionByName(links)


def _links_within(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, threshold: float, own: bool):
    """Exact links of one pair of tiles (or one tile with itself): partner counts, and a star of links."""
    size = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    member = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(tokens, kind="stable")
    tokens, member = tokens[order], member[order]
    cut = np.concatenate(([0], np.flatnonzero(np.diff(tokens)) + 1, [len(tokens)]))
    column = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    shared = np.diff(cut)[column] > 1
    column, member = column[shared], member[shared]
    common = np.zeros((len(sets), len(sets)), np.float32)
    if len(column):
        column = np.cumsum(np.diff(column, prepend=column[0]) != 0)
        for at in range(0, int(column[-1]) + 1, 8192):
            k = slice(np.searchsorted(column, at), np.searchsorted(column, at + 8192))
            grid = np.zeros((len(sets), 8192), np.float32)
            grid[member[k], column[k] - at] = 1
            common += grid @ grid.T
    whole = size[:, None] + size[None, :] - common
    close = common >= threshold * whole - 1e-6
    np.fill_diagonal(close, False)
    if not own:
        close &= side[:, None] != side[None, :]
    return close.sum(1), local_roots(close)


def exact_links(members: DataFrame, threshold: float, rows: int) -> DataFrame:
    """(a, b, n) for members (id, root, size, tokens): star links (a, b) of each tile pair, and n, the links of a in it.

    Sets whose sizes differ by more than the threshold can't be near, so each size class (a power of the threshold) only meets itself and
    the next. A class of over TILE sets is cut into tiles by a hash of the id, and each pair of tiles that may be near is one
    group. A component of at most TILE sets is one tile.
    """
    step = F.floor(F.log(F.col("size").cast("double")) / -math.log(threshold) + 1e-9).cast("int")
    small = members.groupBy("root").agg((F.count("*") <= TILE).alias("small"))
    members = members.join(small, "root").withColumn("step", F.when(F.col("small"), 0).otherwise(step))
    sizes = members.groupBy("root", "step").agg(F.greatest(F.ceil(F.count("*") / TILE), F.lit(1)).cast("int").alias("tiles"))
    after = sizes.select("root", (F.col("step") - 1).alias("step"), F.col("tiles").alias("next"))
    before = sizes.select("root", (F.col("step") + 1).alias("step"), F.col("tiles").alias("last"))
    plan = sizes.join(after, ["root", "step"], "left").join(before, ["root", "step"], "left")
    name = lambda c, t: c.cast("long") * (1 << 32) + t
    tiled = members.join(plan, ["root", "step"]).withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    step = F.col("step")
    every = lambda c, n: F.transform(F.sequence(F.lit(0), n - 1), lambda t: name(c, t))
    some = lambda c, n: F.when(n.isNotNull(), every(c, F.coalesce(n, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    others = F.concat(every(step, F.col("tiles")), some(step + 1, F.col("next")), some(step - 1, F.col("last")))
    met = tiled.select("id", "root", "tokens", name(F.col("step"), F.col("t")).alias("tile"), F.explode(others).alias("other"))
    met = met.select("id", "root", "tokens", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    parts = blocks_for(rows, 500)  # about that many sets in a group, and none of over two tiles is split

    def compare(group: pa.Table) -> pa.Table:
        root, i, j, tile, ids = (group[c].to_numpy() for c in ("root", "i", "j", "tile", "id"))
        blobs = group["tokens"].combine_chunks() if group.num_rows else None
        order = np.lexsort((ids, j, i, root))
        cut = np.flatnonzero((np.diff(root[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)) + 1
        a, b, n = [], [], []
        for rows in np.split(order, cut):
            sets = [np.frombuffer(blobs[int(r)].as_buffer(), np.uint64) for r in rows]
            count, star = _links_within(ids[rows], sets, tile[rows], threshold, i[rows[0]] == j[rows[0]])
            k = np.flatnonzero(count)
            a += ids[rows][k].tolist()
            b += ids[rows][star[k]].tolist()
            n += count[k].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    return met.groupBy(F.pmod(F.xxhash64("root", "i", "j"), F.lit(parts)).alias("part")).applyInArrow(compare, "a long, b long, n long")


def join(docs: DataFrame, n: int = 5, threshold: float = 0.8, miss: float = 1e-6, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, same_id, n_links) of every distinct doc_id.

    same_id: the smallest doc_id with the same n-gram set (words: runs of letters and digits, lower case), so exact
    copies share it. n_links: how many other n-gram sets have a Jaccard similarity of at least threshold with
    this one's. class_id: the smallest doc_id of all documents that such links connect. A document of fewer
    than n words has one shingle of all of them; one without a word, or with a null text, stands alone. A doc_id
    that repeats keeps its smallest set; a null doc_id takes no part; an empty table gives no rows; other
    columns are ignored. A pair at the threshold is missed with probability miss at most, higher pairs with
    less; nothing else is lost, and no link below the threshold is kept.
    """
    all_ids = docs.select(F.col(doc_id).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    sets = materialize(embed(docs, doc_id, text, n).groupBy("doc_id").agg(F.min(F.struct("set_id", "sig")).alias("s")).select("doc_id", "s.*"), "sets")
    reps = materialize(sets.groupBy("set_id").agg(F.min(F.struct("doc_id", "sig")).alias("s")).select("set_id", F.col("s.doc_id").alias("id"), "s.sig"), "reps")
    near = components(candidate_links(reps, threshold, miss))
    near = near.union(near.select(F.col("root").alias("id"), "root").distinct())

    def tokens(batches):
        for batch in batches:
            got = [t for i in range(0, batch.num_rows, 256) for t in shingle_sets([x or "" for x in batch.column("text").slice(i, 256).to_pylist()], n)]
            raw = [t.tobytes() for t in got]
            size = pa.array(map(len, got), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("root"), pa.array(map(set_name, raw), pa.string()), size, pa.array(raw, pa.binary())], names=["id", "root", "name", "size", "tokens"]).filter(
                pa.array([len(t) > 0 for t in got], pa.bool_()))

    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    # an id may have several texts: the set of least name is the one that was embedded, so it is compared too
    named = texts.join(near, "id").mapInArrow(tidy(tokens), "id long, root long, name string, size int, tokens binary")
    members = materialize(named.groupBy("id").agg(F.min_by(F.struct("root", "size", "tokens"), "name").alias("s")).select("id", "s.*"), "members")
    links = materialize(exact_links(members, threshold, near.count()), "links")
    degree = links.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_links"))
    classes = components(links.select("a", "b"))
    known = (reps.select("set_id", "id").join(degree, "id", "left").join(classes, "id", "left")
             .select("set_id", F.col("id").alias("same_id"), F.coalesce("root", "id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))
    linked = sets.select("doc_id", "set_id").join(known, "set_id").select("doc_id", "class_id", "same_id", "n_links")
    alone = all_ids.join(sets.select("doc_id"), "doc_id", "left_anti").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("same_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone)
