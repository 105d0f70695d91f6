"""Near-duplicate documents by an LSH forest: sorted orders of minimum-hash signatures.

Each order sorts all shingle sets by their signatures, read in a permutation of its own. Sets with a long common prefix
then lie side by side. A region, the sets of one prefix, takes the shallowest depth at which it is small enough to be
compared whole, so depth adapts to how dense the sets lie. A set earns credit for each order, the less the deeper its region:
the probability that a partner at the threshold was missed. Sets with too little credit go into further orders. What is
found is a candidate only; candidates are tied into components, in which links are confirmed on the full sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import blocks_for, materialize
from tidepool.llm.jaccard import POSITIONS, agreeing, compare_all, components, exact_links, mix, set_name, signature, tie

ORDERS = 16  # sorted orders of a round
DEPTH = 12  # positions that an order sorts by
REGION = 512  # sets that are compared whole at the shallowest depth
RANGE = 100_000  # rows of one range of an order
TILE = 1024
HEADS = 16
_BLANKS = (0x20, *range(0x09, 0x0E))
_WORD = np.array([i not in _BLANKS for i in range(256)])
_LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint64) + np.uint64(1)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's n-word shingles; a text of fewer words has one of them all, one without words none.

    Words end at ASCII white space and A-Z are lower-cased: both can be told from the bytes of UTF-8.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    code = np.frombuffer(b"\n".join(raw), np.uint8)
    in_word = _WORD[code]
    begins = np.flatnonzero(in_word & ~np.concatenate(([False], in_word[:-1])))
    if not len(begins):
        return [np.zeros(0, np.uint64) for _ in texts]
    kept = np.flatnonzero(in_word)
    starts = np.searchsorted(kept, begins)
    with np.errstate(over="ignore"):
        # each word is a polynomial of its bytes, exact modulo 2^64
        place = np.arange(len(kept)) - np.repeat(starts, np.diff(np.append(starts, len(kept))))
        power = np.cumprod(np.full(int(place.max()) + 1, _PRIME))
        word = mix(np.add.reduceat(_LOWER[code[kept]] * power[place], starts))
        rolled = word.copy()
        for k in range(1, n):
            rolled = mix(rolled[:len(word) - k] * _PRIME + word[k:]) if len(word) > k else rolled[:0]
        out, at = [], 0
        for end in np.searchsorted(begins, np.cumsum([len(t) + 1 for t in raw])).tolist():
            if end - at >= n:
                out.append(np.unique(rolled[at:end - n + 1]))
            elif end > at:
                few = np.array([end - at], np.uint64)
                for x in word[at:end]:
                    few = mix(few * _PRIME + x)
                out.append(few)
            else:
                out.append(np.zeros(0, np.uint64))
            at = end
    return out


def text_slices(texts: list[str], most: int = 1_000_000):
    """(first, texts) of runs of texts of about most characters, so that long texts don't come together."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most or i + 1 == len(texts):
            yield at, texts[at:i + 1]
            at, size = i + 1, 0


def embed(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, set_id, size, sig) for docs (doc_id, text): the name of each shingle set, its size and its signature; an empty set has neither name nor signature."""
    def run(batches):
        for batch in batches:
            ids, sizes, sigs = [], [], []
            for _, texts in text_slices([t or "" for t in batch.column("text").to_pylist()]):
                for s in shingle_sets(texts, n):
                    ids.append(set_name(s.tobytes()) if len(s) else None)
                    sizes.append(len(s))
                    sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.string()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "set_id", "size", "sig"])

    return docs.mapInArrow(run, "doc_id long, set_id string, size long, sig binary")


def least_share(threshold: float) -> float:
    """The share of positions in which a pair at the threshold agrees, but for five standard deviations."""
    return threshold - 5 * math.sqrt(threshold * (1 - threshold) / POSITIONS)


def covered(low: np.ndarray, least: float) -> np.ndarray | None:
    """The labels of a region of over REGION sets if few lie outside the largest group around its heads, else None.

    Then what lies outside is compared with everything, and the group, tied already, needs no comparison within itself.
    """
    label = np.arange(len(low))
    for _ in range(HEADS):
        free = np.flatnonzero(np.bincount(label, minlength=len(low))[label] == 1)
        if not len(free):
            break
        near = np.flatnonzero((low == low[free[0]]).sum(1) >= least * POSITIONS)
        label = tie(label, near, np.full(len(near), free[0]))
    rest = np.flatnonzero(label != np.bincount(label).argmax())
    if len(rest) > 2 * REGION:
        return None
    for i in range(0, len(low), TILE):
        for j in range(0, len(rest), TILE):
            x, y = np.nonzero(agreeing(low[i:i + TILE], low[rest[j:j + TILE]], least))
            label = tie(label, x + i, rest[y + j])
    return label


def compare_range(keys: np.ndarray, low: np.ndarray, order: np.ndarray, least: float):
    """Regions of a sorted run of rows: (rows, other rows) that agree in that share at least, and the depth of each row's region.

    A region that touches either end may go on beyond it: its rows get depth -1, no credit.
    """
    links, depth = [], np.full(len(keys), -1)

    def parts(lo: int, hi: int, column: np.ndarray) -> list[tuple[int, int]]:
        cut = [lo, *(np.flatnonzero(column[lo + 1:hi] != column[lo:hi - 1]) + lo + 1).tolist(), hi]
        return list(zip(cut[:-1], cut[1:], strict=True))

    stack = [(a, b, 1) for lo, hi in parts(0, len(keys), order) for a, b in parts(lo, hi, keys[:, 0])] if len(keys) else []
    while stack:
        lo, hi, d = stack.pop()
        label = None
        if hi - lo == 1:
            label = np.zeros(1, np.int64)
        elif hi - lo <= REGION or d == keys.shape[1]:
            label = compare_all(low[lo:hi], least)
        elif (label := covered(low[lo:hi], least)) is None:
            stack += [(a, b, d + 1) for a, b in parts(lo, hi, keys[:, d])]
            continue
        if lo > 0 and hi < len(keys):
            depth[lo:hi] = d
        tied = np.flatnonzero(label != np.arange(hi - lo))
        links.append((tied + lo, label[tied] + lo))
    a, b = (np.concatenate(x) for x in zip(*links, strict=True)) if links else (np.zeros(0, int), np.zeros(0, int))
    return a, b, depth


def sorted_orders(sets: DataFrame, rows: int, seed: int, threshold: float) -> DataFrame:
    """(a, b, credit) of ORDERS sorted orders of sets (id, sig): candidate links (a, b), and for each set a its credit where that isn't the most an order gives."""
    least = least_share(threshold)
    picks = [np.random.default_rng(seed * ORDERS + i).permutation(POSITIONS)[:DEPTH].tolist() for i in range(ORDERS)]
    # two bytes of each position make up the key; one byte of every position tells how many agree
    key = [F.concat(*(F.expr(f"substring(sig, {4 * p + 1}, 2)") for p in order)) for order in picks]
    low = F.concat(*(F.expr(f"substring(sig, {4 * p + 3}, 1)") for p in range(POSITIONS)))
    rows_of = sets.select("id", low.alias("low"), F.posexplode(F.array(*key)).alias("order", "key"))
    ranges = rows_of.repartitionByRange(blocks_for(rows * ORDERS, RANGE), "order", "key", "id").sortWithinPartitions("order", "key", "id")

    def run(batches):
        whole = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if whole is None or not whole.num_rows:
            return
        flat = lambda c, t, w: np.frombuffer(b"".join(whole[c].to_pylist()), t).reshape(-1, w)
        ids = whole["id"].to_numpy()
        a, b, depth = compare_range(flat("key", np.uint16, DEPTH), flat("low", np.uint8, POSITIONS), whole["order"].to_numpy(), least)
        poor = np.flatnonzero((depth < 0) | (depth > 1))
        credit = np.where(depth[poor] < 0, 0.0, np.log1p(-threshold ** np.maximum(depth[poor], 1)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((ids[a], ids[poor]))), pa.array(np.concatenate((ids[b], np.zeros(len(poor), np.int64))), mask=np.arange(len(a) + len(poor)) >= len(a)),
                                          pa.array(np.concatenate((np.zeros(len(a)), credit)))], names=["a", "b", "credit"])

    return ranges.mapInArrow(run, "a long, b long, credit double")


def all_tiles(sets: DataFrame, rows: int, threshold: float) -> DataFrame:
    """(a, b) candidate links among sets (id, sig), every tile met with every tile."""
    least, tiles = least_share(threshold), blocks_for(rows, TILE)
    own = F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")
    met = sets.select("id", "sig", own.alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("other"))

    def compare(group: pa.Table) -> pa.Table:
        ids = group["id"].to_numpy()
        low = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint8).reshape(-1, 4 * POSITIONS)[:, 2::4]
        label = compare_all(low, least)
        a = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"a": ids[a], "b": ids[label[a]]})

    return met.groupBy(F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j")).applyInArrow(compare, "a long, b long")


def candidates(sets: DataFrame, threshold: float, miss: float) -> DataFrame:
    """(a, b) candidate links among distinct sets (id, sig): a pair at the threshold is missed with probability miss at most.

    All sets go through a round of orders. Those with too little credit (dense regions need depth, which costs recall) go
    through further rounds among themselves, until one would cost more than comparing each of them with all others.
    """
    found, poor, n, taken, rounds = None, sets, sets.count(), None, 0
    most = math.log1p(-threshold)  # the credit of an order at depth 1
    while n:
        out = materialize(sorted_orders(poor, n, rounds, threshold), "orders")
        links = out.where("b IS NOT NULL").select("a", "b")
        found = links if found is None else found.unionByName(links)
        # depth 1 gives no row, so what misses to the full credit is summed
        lost = out.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum(F.col("credit") - most).alias("lost"))
        taken = lost if taken is None else taken.unionByName(lost).groupBy("id").agg(F.sum("lost").alias("lost"))
        rounds += 1
        need = F.col("lost") + rounds * ORDERS * most > math.log(miss)
        short = materialize(taken.where(need), "credit")
        taken = short
        left = short.count()
        if not left:
            break
        poor = materialize(poor.join(short.select("id"), "id", "left_semi"), "short")
        n = left
        if ORDERS * REGION * rounds >= n:
            found = found.unionByName(all_tiles(poor, n, threshold))
            break
    return sets.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0) if found is None else found


def near_duplicates(docs: DataFrame, n: int = 4, threshold: float = 0.8, miss: float = 1e-6, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    n_shingles: the size of the document's set of n-word shingles (words: runs without ASCII white space, A-Z lower-cased; fewer words make one
    shingle, none an empty set). component_id: the smallest doc_id that links reach; documents with equal sets or a Jaccard
    similarity of at least threshold are linked, empty ones with nothing. kept: doc_id = component_id. A null doc_id takes no
    part. A doc_id that repeats gives a row for each of its rows, each by its own text. An empty table gives no rows;
    other columns are ignored. A pair at the threshold is missed with probability miss at most; no link below it is kept.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL")
    all_docs = materialize(embed(texts, n), "embedded")
    named = all_docs.where("set_id IS NOT NULL")
    sets = named.groupBy("set_id").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    sets = materialize(sets.withColumn("id", F.monotonically_increasing_id()), "sets")  # written, so the numbers stay
    near = components(candidates(sets.select("id", "sig"), threshold, miss))
    near = materialize(near.union(near.select(F.col("root").alias("id"), "root").distinct()), "near")

    def tokens(batches):
        for batch in batches:
            at = []
            raw = []
            for first, part in text_slices([t or "" for t in batch.column("text").to_pylist()]):
                names = batch.column("set_id").slice(first, len(part)).to_pylist()
                for i, s in enumerate(shingle_sets(part, n)):
                    # an id may have several texts: the one of this set counts
                    if set_name(x := s.tobytes()) == names[i]:
                        at.append(first + i)
                        raw.append(x)
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("root"), pa.array([len(x) // 8 for x in raw], pa.int32()), pa.array(raw, pa.binary())], names=["id", "root", "size", "tokens"])

    held = sets.select("id", "set_id", F.col("low").alias("doc_id")).join(near, "id")
    members = texts.join(held, "doc_id").mapInArrow(tokens, "id long, root long, size int, tokens binary")
    members = materialize(members.groupBy("id").agg(F.first("root").alias("root"), F.first("size").alias("size"), F.first("tokens").alias("tokens")), "members")
    tied = components(exact_links(members, threshold, near.count()).select("a", "b"))
    tied = tied.union(tied.select(F.col("root").alias("id"), "root").distinct())
    lows = sets.select("id", "set_id", "low", "copies").join(tied, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = lows.groupBy("root").agg(F.min("low").alias("component_id"))
    known = materialize(lows.join(least, "root").select("set_id", "component_id", "copies"), "known")
    total = all_docs.count()
    # a set of over a thousandth of all rows is hot; there are fewer than a thousand of them
    hot = F.broadcast(known.where(F.col("copies") > total / 1000).select("set_id", F.col("component_id").alias("hot_id")))
    marked = all_docs.select("doc_id", "set_id", "size").join(hot, "set_id", "left")
    direct = marked.where("set_id IS NULL OR hot_id IS NOT NULL").select("doc_id", "size", F.coalesce("hot_id", "doc_id").alias("component_id"))
    others = marked.where("set_id IS NOT NULL AND hot_id IS NULL").select("doc_id", "set_id", "size").join(known, "set_id").select("doc_id", "size", "component_id")
    return direct.unionByName(others).select("doc_id", F.col("size").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
