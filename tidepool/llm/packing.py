"""Packing token sequences: a configuration linear program over the histogram of piece lengths.

Documents are tokenized and cut into pieces of at most a sequence's length. Only the histogram of piece
lengths, as many entries as a sequence has tokens at most, reaches the driver. There multiplicative weights
price the lengths, knapsack dynamic programming finds the most valuable configuration at these prices, and
the fractional solution is rounded down; what it leaves is packed best-fit, whole runs of equal lengths at a
time. Ranks within each length then send every piece to its place.
"""

from __future__ import annotations

import bisect
import string
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import blocks_for, materialize, tidy

CAPACITY = 4096
RANK_BLOCKS = 1 << 16  # besides one of each length: so many counts of blocks are broadcast at most
Config = tuple[int, list[tuple[int, int]]]  # how many sequences, (length, pieces of it in each)

_LATIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]*$"
_MARKS = string.punctuation.replace("'", "")
_TRIAL = ("The", "naïve", "Straße", "don't", "word,", "word!!", "x.y", "ALL", "Été…", "日本語", "a1b2", "(see", "e-mail", "ÿ", "Ünïcödé?!", "tion***", "&&&", "i", "supercalifragilistic")
_CACHE_WORDS = 300_000  # a worker keeps them from task to task
# the letters that byte-level tokenizers write for bytes, but for the space
_BYTES = np.arange(256, dtype="<u4")
_BYTES[[b for b in range(256) if not (32 <= b < 127 or 161 <= b < 173 or b > 173)]] = [*range(256, 288), *range(289, 324)]


class Encoder:
    """Ids of whole texts, as the tokenizers library gives them; repeated words are encoded once.

    Where the tokenizer drops white space, never merges across it and parts Latin letters from the marks after them, a text's ids are those of
    its words between ASCII white space, and a word's those of its letters, in lower case and as bytes, by the tokenizer's model alone, and of its marks. That is
    tried on load, on words of all kinds; a tokenizer of another kind reads whole texts. Words of anything else, other white space included, go through the
    tokenizer as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.forget()
        self.by_word = True
        trial = [" ".join(_TRIAL), "  ".join(reversed(_TRIAL)), *_TRIAL]
        self.by_word = self.encode(trial) == self.whole(trial)

    def forget(self) -> None:
        """No words are known: their ids are one array, with where each word's begin and how many they are."""
        self.words, self.ids = pa.array([], pa.large_string()), np.zeros(0, "<u4")
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def learn(self, words: pa.Array) -> np.ndarray:
        """Add words that aren't known; their places."""
        latin = pc.match_substring_regex(words, _LATIN)
        parts, sizes = [], []
        letters, rest = words.filter(latin), words.filter(pc.invert(latin))
        for i in range(0, len(letters), 10_000):
            some = " ".join(letters.slice(i, 10_000).to_numpy(zero_copy_only=False)).encode()
            found = [self.model.tokenize(w) for w in _BYTES[np.frombuffer(some, np.uint8)].tobytes().decode("utf-32-le").split(" ")]
            sizes += map(len, found)
            parts.append(np.array([t.id for f in found for t in f], "<u4"))
        for i in range(0, len(rest), 1024):
            found = [np.frombuffer(ids, "<u4") for ids in self.whole(rest.slice(i, 1024).to_pylist())]
            sizes += map(len, found)
            parts += found
        size = np.array(sizes, np.int64)
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, *parts])
        places = np.empty(len(words), np.int64)
        places[np.argsort(~latin.to_numpy(zero_copy_only=False), kind="stable")] = len(self.words) + np.arange(len(words))
        self.words = pa.concat_arrays([self.words, letters, rest])
        return places

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_word:
            return self.whole(texts.to_pylist() if isinstance(texts, pa.Array) else texts)
        if len(self.words) > _CACHE_WORDS:
            self.forget()
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()))
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary
        core = pc.ascii_rtrim(distinct, characters=_MARKS)
        plain = pc.match_substring_regex(core, _LATIN)
        marks = tails(distinct, pc.if_else(plain, pc.subtract(pc.binary_length(distinct), pc.binary_length(core)), 0).to_numpy())
        # each word is its letters, or what it is else, and its marks
        parts = pa.concat_arrays([pc.if_else(plain, pc.utf8_lower(core), distinct), marks]).dictionary_encode()
        at = pc.fill_null(pc.index_in(parts.dictionary, value_set=self.words), -1).to_numpy().astype(np.int64)
        new = at < 0
        at[new] = self.learn(parts.dictionary.filter(pa.array(new)))
        at = at[parts.indices.to_numpy()]
        at = np.column_stack([at[:len(distinct)], at[len(distinct):]])[words.indices.to_numpy()].ravel()
        size = self.size[at]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.begin[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        upto = np.concatenate(([0], 4 * ends))[2 * (split.offsets.to_numpy() - split.offsets[0].as_py())].tolist()
        return [ids[a:b] for a, b in zip(upto, upto[1:])]


def tails(words: pa.Array, sizes: np.ndarray) -> pa.Array:
    """The last bytes of each word, as many as sizes tells."""
    sizes = sizes.astype(np.int64)
    ends = np.cumsum(sizes)
    stop = np.frombuffer(words.buffers()[1], np.int64)[words.offset + 1:words.offset + 1 + len(words)]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[np.repeat(stop - ends, sizes) + np.arange(ends[-1] if len(ends) else 0)]
    return pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64)), pa.py_buffer(data.tobytes()))


_encoders: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document: its ids, then end_id, cut after each capacity ids."""
    schema = docs.select("doc_id").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, Encoder(tokenizer))
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            row, piece, start, length, crc = [], [], [], [], []
            at, size = 0, 0
            for i, n in enumerate(pc.binary_length(texts).to_pylist()):
                size += n
                if size < 2_000_000 and i + 1 < len(texts):
                    continue
                for k, ids in enumerate(encoder.encode(texts[at:i + 1]), at):
                    ids += end
                    n = len(ids) // 4
                    for p, s in enumerate(range(0, n, capacity)):
                        m = min(capacity, n - s)
                        row.append(k)
                        piece.append(p)
                        start.append(s)
                        length.append(m)
                        crc.append(zlib.crc32(ids[4 * s:4 * (s + m)]))
                at, size = i + 1, 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=schema.names)

    return docs.select("doc_id", F.col("text")).mapInArrow(tidy(run), schema)


# --- the plan, over the histogram alone ---


def knapsack(lengths: np.ndarray, values: np.ndarray, limits: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """The most valuable multiset of lengths that fits: (position, copies). Copies are taken in doubling bundles."""
    best = np.zeros(capacity + 1)
    stages = []
    for i, (length, value, limit) in enumerate(zip(lengths.tolist(), values.tolist(), limits.tolist(), strict=True)):
        left, bundle = min(int(limit), capacity // length), 1
        while left > 0:
            n = min(bundle, left)
            moved = best[: capacity + 1 - n * length] + n * value
            better = moved > best[n * length:] + 1e-12
            best[n * length:][better] = moved[better]
            stages.append((i, n, n * length, better))
            left -= n
            bundle *= 2
    at, taken = int(best.argmax()), {}
    for i, n, weight, better in reversed(stages):
        if at >= weight and better[at - weight]:
            taken[i] = taken.get(i, 0) + n
            at -= weight
    return sorted(taken.items())


def linear_program(histogram: dict[int, int], capacity: int, rounds: int = 1500, items: int = 96, eta: float = 1.0) -> list[tuple[float, list[tuple[int, int]]]]:
    """A fractional packing: (amount, configuration). Prices fall as exp(-eta * covered share), lengths once covered leave.

    A round is a knapsack over at most `items` of the open lengths, half of them the dearest for their tokens and half spread over all, and covers one of them
    or more; at most `rounds` are made. Both bound the driver's time (some ten seconds); lengths still open then are left to the rounding.
    """
    lengths = np.array(sorted(histogram))
    demand = np.array([histogram[x] for x in lengths.tolist()], float)
    covered = np.zeros(len(lengths))
    out = []
    for _ in range(rounds):
        open_ = np.flatnonzero(demand - covered >= 1)
        if not len(open_):
            break
        price = lengths[open_] * (1 + 0.02 * lengths[open_] / capacity) * np.exp(-eta * covered[open_] / demand[open_] * 0.05)
        # the dearest per token, and the longest and shortest: every gap can be filled
        order = np.argsort(-price / lengths[open_])
        some = np.unique(np.concatenate([order[: items // 2], np.arange(len(open_))[:: max(1, len(open_) * 2 // items)]]))
        left = demand[open_[some]] - covered[open_[some]]
        config = knapsack(lengths[open_[some]], price[some], left, capacity)
        if not config:
            break
        picks = open_[some][[i for i, _ in config]]
        copies = np.array([n for _, n in config])
        amount = float(((demand[picks] - covered[picks]) / copies).min())
        covered[picks] += amount * copies
        out.append((amount, [(int(lengths[p]), int(n)) for p, n in zip(picks, copies, strict=True)]))
    return out


def best_fit(histogram: dict[int, int], capacity: int) -> list[Config]:
    """Best-fit decreasing, a run of equal lengths at a time: bins alike are kept as one group."""
    groups: dict[int, list[Config]] = {}
    spaces: list[int] = []

    def put(space: int, config: Config) -> None:
        if space not in groups:
            bisect.insort(spaces, space)
            groups[space] = []
        groups[space].append(config)

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n > 0:
            k = bisect.bisect_left(spaces, length)
            if k == len(spaces):
                space, count, content = capacity, n, []
            else:
                space = spaces[k]
                count, content = groups[space].pop()
                if not groups[space]:
                    del groups[space]
                    spaces.pop(k)
            each = min(space // length, n)
            bins = min(count, n // each)
            put(space - each * length, (bins, [*content, (length, each)]))
            n -= bins * each
            if content and count > bins:
                put(space, (count - bins, content))
    return [c for g in groups.values() for c in g]


def plan(histogram: dict[int, int], capacity: int) -> list[Config]:
    """Configurations with multiplicities that hold every piece exactly once.

    The program's configurations that are at least 0.99 full are rounded down, and what they leave is packed best fit. As late configurations are made of
    what is left over, the rounding keeps the first of them, up to the place (of a few tried) from which on best fit does better; at worst that is the first.
    """
    kept: list[tuple[int, list[tuple[int, int]]]] = []
    left = dict(histogram)
    for amount, config in linear_program(histogram, capacity):
        n = min([int(amount + 1e-9), *(left[length] // each for length, each in config)])
        if n and sum(a * b for a, b in config) >= 0.99 * capacity:
            kept.append((n, config))
            for length, each in config:
                left[length] -= n * each

    def rounded(k: int) -> list[Config]:
        rest = dict(histogram)
        for n, config in kept[:k]:
            for length, each in config:
                rest[length] -= n * each
        return kept[:k] + best_fit({length: n for length, n in rest.items() if n}, capacity)

    tried = sorted({round(len(kept) * share) for share in (1, 0.98, 0.95, 0.9, 0.75, 0.5, 0.25, 0)}, reverse=True)
    return min((rounded(k) for k in tried), key=lambda p: sum(n for n, _ in p))


def places(configs: list[Config]) -> dict[str, np.ndarray]:
    """For each length, in order of rank: first rank, pieces per sequence, first sequence, offset in it."""
    rows, ranks, base = [], {}, 0
    for n, config in configs:
        offset = 0
        for length, each in config:
            first = ranks.get(length, 0)
            rows.append((length, first, each, base, offset))
            ranks[length] = first + n * each
            offset += each * length
        base += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "each", "base", "offset"), table.T, strict=True))


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 1, rank_block: int = 1_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row of docs.

    A null text counts as empty (one piece, the end id alone); repeated rows are packed each; an empty table gives
    no rows; texts of any length are cut, none dropped; other columns are ignored. Sequences are filled without
    gaps from 0 and numbered from 0. Ranks are taken in blocks of rank_block pieces of a length, larger only where
    there would be over RANK_BLOCKS of them.
    """
    cut = materialize(pieces(docs, tokenizer or default_tokenizer(), capacity, end_id), "pieces")
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    per_block = max(rank_block, -(-sum(histogram.values()) // RANK_BLOCKS))
    salts = docs.sparkSession.createDataFrame([(k, blocks_for(n, per_block)) for k, n in histogram.items()], "length long, salts long")
    cut = cut.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), "salts"))
    counts = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.join(F.broadcast(counts), ["length", "salt"]).withColumn("rank", F.row_number().over(within) - 1 + F.col("before"))
    shared = docs.sparkSession.sparkContext.broadcast(places(plan(histogram, capacity)))
    schema = ranked.select("doc_id", "piece", "start", "length", "ids_crc32").schema.add("sequence_id", "long").add("offset", "long")

    def run(batches):
        p = shared.value
        edges = p["length"] * (1 << 44) + p["first"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            k = np.searchsorted(edges, length * (1 << 44) + rank, "right") - 1
            r = rank - p["first"][k]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in schema.names[:5]), pa.array(p["base"][k] + r // p["each"][k]), pa.array(p["offset"][k] + r % p["each"][k] * length)],
                names=schema.names)

    return ranked.select(*schema.names[:5], "rank").mapInArrow(tidy(run), schema)
