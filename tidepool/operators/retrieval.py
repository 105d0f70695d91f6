"""Candidates for stories: token overlap with titles, rescue by folded substring, threshold, ranking and cap, and their health."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import predicates as P
from tidepool.functions import text as X
from tidepool.functions import values as V
from tidepool.operators import automata

# The operating point and the limits of health.
THRESHOLD, CAP = 0.5, 47
ZERO_LIMIT, SATURATION_LIMIT, LEAST_N = 0.10, 0.05, 50
SEAM = "\u0001"  # between the tokens of a set; stands in no token
LETTERS = 2_000_000  # letters of the folds that one automaton holds: some 100 MB in each Python worker
SMALL = 4_000_000  # rows of the titles' index that one block may hold: some 30 MB of numbers in each Python worker


def searchable_titles(films: DataFrame, alternatives: DataFrame | None = None, *, film: str = "film_id", title: str = "title", original: str | None = None,
                      normal=X.lower_nfc) -> DataFrame:
    """(film, title_no, tokens, fold) of each film's titles, the main one first; equal (tokens, fold) of a film count once.

    alternatives: (film, position, title).
    """
    own = films.select(film, F.lit(0).cast("long").alias("title_no"), F.col(title).alias("__t"))
    if original:
        own = own.unionByName(films.select(film, F.lit(1).cast("long").alias("title_no"), F.col(original).alias("__t")))
    if alternatives is not None:
        own = own.unionByName(alternatives.select(film, (F.col("position") + 2).cast("long").alias("title_no"), F.col(title).alias("__t")))
    t = normal(F.col("__t"))
    rows = own.where("__t IS NOT NULL").select(film, "title_no", X.significant_tokens(t).alias("tokens"), X.squash_fold(t).alias("fold"))
    return rows.groupBy(film, "tokens", "fold").agg(F.min("title_no").alias("title_no"))


def inverted_index(titles: DataFrame, film: str = "film_id") -> DataFrame:
    """(token, film, title_no, n_tokens): one row for each distinct token of a title."""
    own = F.array_distinct("tokens")
    return titles.select(film, "title_no", F.size(own).cast("long").alias("n_tokens"), F.explode(own).alias("token"))


def rescue_folds(titles: DataFrame, film: str = "film_id") -> DataFrame:
    return titles.where(F.length("fold") >= X.FOLD_MIN_CHARS).select(film, "fold").distinct()


def story_terms(stories: DataFrame, *, story: str = "story_id", headline: str = "headline", dek: str = "dek", normal=X.lower_nfc) -> DataFrame:
    """(story, tokens, folds): tokens of headline and dek together, a fold of each by itself, so none crosses the seam."""
    whole = F.concat_ws(" ", headline, dek)
    return stories.select(story, F.array_distinct(X.significant_tokens(normal(whole))).alias("tokens"),
                          F.array(X.squash_fold(normal(F.coalesce(headline, F.lit("")))), X.squash_fold(normal(F.coalesce(dek, F.lit(""))))).alias("folds"))


class TitleIndex:
    """Titles of one block as arrays of numbers: for each token the distinct token sets it stands in, for each set its films in order."""

    def __init__(self, titles: pa.Table):
        """titles: film and key, the sorted tokens joined by SEAM."""
        order = pc.sort_indices(titles["film"], null_placement="at_start") if titles.num_rows else pa.array([], pa.int64())
        titles = titles.take(order).combine_chunks()
        film, key = (pa.concat_arrays(titles[c].chunks or [pa.array([], titles.schema.field(c).type)]).dictionary_encode("encode") for c in ("film", "key"))
        self.films = film.dictionary
        at, of = film.indices.to_numpy().astype(np.int64), key.indices.to_numpy().astype(np.int64)
        pairs = np.unique(of * max(1, len(self.films)) + at)
        self.members = (pairs % max(1, len(self.films))).astype(np.int32)
        self.begin = np.searchsorted(pairs, np.arange(len(key.dictionary) + 1) * max(1, len(self.films)))
        self.several = len(pairs) > len(self.films)  # does a film have more than one set?
        tokens = pc.split_pattern(key.dictionary, SEAM)
        self.size = np.diff(tokens.offsets.to_numpy())
        word = tokens.flatten().dictionary_encode()
        self.words, no = word.dictionary, word.indices.to_numpy()
        of_set = np.repeat(np.arange(len(self.size)), self.size)
        self.sets = of_set[np.argsort(no, kind="stable")].astype(np.int32)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(no, minlength=len(self.words)))]).astype(np.int64)
        # each set's tokens, the one of the fewest sets first, and the sets by that one
        self.first = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        self.tokens = no[np.lexsort((no, np.diff(self.start)[no], of_set))].astype(np.int32)
        own = np.flatnonzero(self.size)
        rarest = self.tokens[self.first[own]]
        self.by_rarest = own[np.argsort(rarest, kind="stable")].astype(np.int32)
        self.rarest_start = np.concatenate([[0], np.cumsum(np.bincount(rarest, minlength=len(self.words)))]).astype(np.int64)
        self.n_films = np.diff(self.begin)
        self.present = None

    def contained(self, tokens: np.ndarray) -> np.ndarray:
        """The sets whose tokens all are a story's: few others share their rarest token with it."""
        if self.present is None:
            self.present = np.zeros(len(self.words), bool)  # all false between calls
        present = self.present
        present[tokens] = True
        left = self.by_rarest[spread(self.rarest_start[tokens], self.rarest_start[tokens + 1] - self.rarest_start[tokens])]
        found, place = [], 1
        while len(left):
            over = self.size[left] == place
            found.append(left[over])
            left = left[~over]
            left = left[present[self.tokens[self.first[left] + place]]]
            place += 1
        present[tokens] = False
        return np.concatenate(found) if found else left

    def films_in(self, sets: np.ndarray) -> int:
        """How many films the sets have."""
        if not self.several:
            return int(self.n_films[sets].sum())
        return len(np.unique(self.members[spread(self.begin[sets], self.n_films[sets])]))

    def reached(self, tokens: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(sets, scores) of the sets that hold a token of a story and reach least; each token is the number of a word."""
        met = [self.sets[a:b] for a, b in zip(self.start[tokens].tolist(), self.start[tokens + 1].tolist(), strict=True)]
        met = np.concatenate(met) if met else self.sets[:0]
        if len(met) * 8 < len(self.size):
            found, hits = np.unique(met, return_counts=True)
        else:
            every = np.bincount(met, minlength=len(self.size))
            found = np.flatnonzero(every)
            hits = every[found]
        ok = hits >= least * self.size[found] - 1e-9
        return found[ok], hits[ok] / self.size[found[ok]]

    def count_over(self, stories: list[np.ndarray], threshold: float, together: int = 2048) -> np.ndarray:
        """For each story how many films reach the threshold, if each film has one set; many stories are counted at once, as bits of words."""
        every = np.arange(int(self.size.max(initial=0)) + 1)
        need = np.array([next((h for h in range(1, n + 1) if h / n >= threshold), n + 1) for n in every.tolist()])
        return np.concatenate([np.zeros(0, np.int64), *(self._counted(stories[at:at + together], need) for at in range(0, len(stories), together))])

    def _counted(self, stories: list[np.ndarray], need: np.ndarray, words: int = 16_384, rows: int = 32_768) -> np.ndarray:
        """need: how many of its tokens a set of each size must meet. A chunk has about so many words; that many rows of bits are summed up at once."""
        used = np.unique(np.concatenate(stories))
        row = np.full(len(self.words), -1, np.int32)
        row[used] = np.arange(len(used))
        bits = np.zeros((len(used), -(-len(stories) // 64)), np.uint64)  # a token's stories
        for i, tokens in enumerate(stories):
            bits[row[tokens], i >> 6] |= np.uint64(1 << (i & 63))
        # only sets of which some story could hold enough, and of these only tokens that a story has
        of_set, met = np.repeat(np.arange(len(self.size)), self.size), row[self.tokens]
        n = np.bincount(of_set[met >= 0], minlength=len(self.size))
        able = n >= need[self.size]
        met = met[(met >= 0) & able[of_set]]
        able = np.flatnonzero(able)
        n, least, films = n[able], need[self.size[able]], self.n_films[able]
        first = np.cumsum(n) - n
        order = np.lexsort((films, least, n))
        edges = np.flatnonzero(np.diff(n[order] * len(need) + least[order], prepend=-1, append=-1))
        out, waiting = np.zeros(bits.shape[1] * 64, np.int64), {}

        def sum_up(j: int) -> None:
            out[:] += ones(np.concatenate(waiting.pop(j))) << j

        step = max(1, words // bits.shape[1])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            for at in range(a, b, step):
                own = order[at:min(b, at + step)]
                enough = reached_bits([bits.take(met[first[own] + i], axis=0) for i in range(int(n[own[0]]))], int(least[own[0]]))
                for j in range(int(films[own].max()).bit_length()):  # a set counts as often as it has films
                    waiting.setdefault(j, []).append(enough[(films[own] >> j & 1).astype(bool)])
                    if len(waiting[j]) * step >= rows:
                        sum_up(j)
        for j in list(waiting):
            sum_up(j)
        return out[:len(stories)]

    def pairs(self, sets: np.ndarray, scores: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(films as places, scores): every film of the sets, or the first most of each, with its best score."""
        n = self.begin[sets + 1] - self.begin[sets]
        n = n if most is None else np.minimum(n, most)
        film, score = self.members[spread(self.begin[sets], n)], np.repeat(scores, n)
        if self.several:
            order = np.lexsort((-score, film))
            film, score = film[order], score[order]
            first = np.diff(film, prepend=-1) != 0
            film, score = film[first], score[first]
        return film, score

    def best(self, sets: np.ndarray, scores: np.ndarray, cap: int) -> tuple[int, np.ndarray, np.ndarray]:
        """(films in all, the best cap of them, their scores): best first, ties by film."""
        if self.several:
            film, score = self.pairs(sets, scores)
            total = len(film)
        else:
            # sets below the score at which cap is full can't matter, nor a set's films behind its first cap
            n = self.begin[sets + 1] - self.begin[sets]
            total, order = int(n.sum()), np.argsort(-scores, kind="stable")
            full = min(int(np.searchsorted(np.cumsum(n[order]), cap)), len(order) - 1)
            near = scores >= scores[order[full]] if len(order) else scores > 0
            film, score = self.pairs(sets[near], scores[near], cap)
        order = np.lexsort((film, -score))[:cap]
        return total, film[order], score[order]


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1 and on, n of each, one behind the other."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def add_bits(a: np.ndarray, b: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sum, carry) of each place's bits."""
    x = a ^ b
    return (x, a & b) if c is None else (x ^ c, a & b | x & c)


def reached_bits(items: list[np.ndarray], least: int) -> np.ndarray:
    """The places at which at least so many of the items have a one: they are added up digit by digit, all places at once."""
    digits, out = [], ~np.zeros_like(items[0])
    while items:
        carries = []
        while len(items) > 1:
            one, carry = add_bits(*items[-3:])
            items[-3:] = [one]
            carries.append(carry)
        digits.append(items[0])
        items = carries
    for j, digit in enumerate(digits):
        out = out & digit if least >> j & 1 else out | digit
    return out if least < 1 << len(digits) else np.zeros_like(out)


def ones(rows: np.ndarray) -> np.ndarray:
    """How many ones each column of bits has: rows are added to one another by halves, digit by digit, until few are left to spread out."""
    digits = [rows]
    while len(digits[0]) > 64:
        if len(digits[0]) % 2:
            digits = [np.concatenate([d, np.zeros_like(d[:1])]) for d in digits]
        half, carry, new = len(digits[0]) // 2, None, []
        for d in digits:
            one, carry = add_bits(d[:half], d[half:], carry)
            new.append(one)
        digits = [*new, carry]
    return sum(np.unpackbits(d.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64) << j for j, d in enumerate(digits))


def _blocks(titles: DataFrame, film: str, small: int, most: int = 16) -> list | None:
    """Broadcast indexes of at most about `small` rows of the titles' index each (they are counted first); None if there are too many for `most` blocks.

    A film's titles lie in one block.
    """
    own = F.array_sort(F.array_distinct("tokens"))
    rows = titles.where(F.size("tokens") > 0).select(F.col(film).alias("film"), F.array_join(own, SEAM).alias("key"), F.size(own).alias("n"))
    rows = rows.persist()  # titles without their pages: counted and then gathered, made once
    try:
        size = rows.agg(F.sum("n")).first()[0] or 0
        if size > small * most:
            return None
        parts = max(1, math.ceil(size / max(1, small)))
        own = lambda part: rows if parts == 1 else rows.where(F.pmod(F.xxhash64("film"), F.lit(parts)) == part)
        return [titles.sparkSession.sparkContext.broadcast(TitleIndex(own(part).select("film", "key").toArrow())) for part in range(parts)]
    finally:
        rows.unpersist()


def _each_story(terms: DataFrame, blocks: list, story: str, schema: str, give: Callable[[TitleIndex, list[np.ndarray]], Iterator[list]]) -> DataFrame:
    """What give makes of each of some stories' tokens (numbers of words), as rows: the story, and the columns of schema in order, films as places.

    Stories are dealt by their key once, then only read through: nothing is sorted, shuffled or kept by pairs of story and film.
    Rows of one story are put together where a key repeats, which is looked up first.
    """
    one = terms.select(story, "tokens").repartition(story)
    if not terms.groupBy(story).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        one = one.groupBy(story).agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
    out = None
    for shared in blocks:
        run = _reader(shared, story, give, [c.split()[0] for c in schema.split(", ")])
        rows = one.mapInArrow(run, f"`{story}` {one.schema[story].dataType.simpleString()}, {schema}")
        out = rows if out is None else out.unionByName(rows)
    return out


def _reader(shared, story: str, give: Callable, names: list[str], most: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            lists = batch.column("tokens")
            ends = lists.offsets.to_numpy()
            word = pc.index_in(lists.flatten(), value_set=index.words)
            known = np.flatnonzero(word.is_valid().to_numpy(zero_copy_only=False))
            word, ends = word.drop_null().to_numpy(), np.searchsorted(known, ends - ends[0])
            at, columns, waiting = [], [], 0
            for i, made in enumerate(give(index, [np.unique(word[ends[i]:ends[i + 1]]) for i in range(batch.num_rows)])):
                at.append(np.full(len(made[0]), i))
                columns.append(made)
                waiting += len(made[0])
                if waiting > most or i + 1 == batch.num_rows:
                    data = [np.concatenate(c) for c in zip(*columns, strict=True)]
                    data = [index.films.take(pa.array(c, pa.int64())) if n == "film" else pa.array(c) for n, c in zip(names, data, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(story).take(pa.array(np.concatenate(at), pa.int64())), *data], names=[story, *names])
                    at, columns, waiting = [], [], 0

    return run


def token_scores(terms: DataFrame, titles: DataFrame, *, story: str = "story_id", film: str = "film_id", least: float = 0.0, small: int = SMALL) -> DataFrame:
    """(story, film, score): the best share of a title's distinct tokens that the story holds, where it reaches least.

    Titles are gathered by their distinct token sets, an index of them is broadcast in blocks of at most `small` rows (they are counted first),
    and stories are read through one by one (see best_films and tallies, which don't make the pairs). Beyond 16 blocks the index is joined by
    token, and with least over 0 only through the rarest tokens of each title (see rare_tokens), so that common words don't pair
    everything with everything; what meets there is then counted in full.
    """
    blocks = _blocks(titles, film, small)
    if blocks is None:
        return _scores_by_token(terms, inverted_index(titles, film), story, film, least)
    kind = titles.schema[film].dataType.simpleString()
    return _each_story(terms, blocks, story, f"film {kind}, score double", lambda index, stories: (index.pairs(*index.reached(t, least)) for t in stories)).withColumnRenamed("film", film)


def best_films(terms: DataFrame, titles: DataFrame, threshold: float = THRESHOLD, cap: int = CAP, *, story: str = "story_id", film: str = "film_id", small: int = SMALL) -> DataFrame:
    """What cut gives of the scores, (story, film, score, n_over, rank), without making them: each story's films are counted, and its best cap told, where the story is read.

    Where cap films' titles are held whole, they are the best, and the other films are only counted, for many stories at once.
    """
    blocks = _blocks(titles, film, small)
    if blocks is None:
        return cut(_scores_by_token(terms, inverted_index(titles, film), story, film, threshold), threshold, cap, story=story, film=film)
    kind = titles.schema[film].dataType.simpleString()

    def give(index, stories):
        held = [index.contained(t) if threshold <= 1 and not index.several else None for t in stories]
        full = [i for i, sets in enumerate(held) if sets is not None and index.films_in(sets) >= max(1, cap)]
        counts = dict(zip(full, index.count_over([stories[i] for i in full], threshold).tolist(), strict=True))
        for i, tokens in enumerate(stories):
            if i in counts:
                total, (_, films, score) = counts[i], index.best(held[i], np.ones(len(held[i])), cap)
            else:
                sets, scores = index.reached(tokens, threshold)
                over = scores >= threshold
                total, films, score = index.best(sets[over], scores[over], cap)
            yield [films, score, np.full(len(films), total, np.int64), np.arange(1, len(films) + 1, dtype=np.int32)]

    out = _each_story(terms, blocks, story, f"film {kind}, score double, n_over long, rank int", give).withColumnRenamed("film", film)
    if len(blocks) == 1:
        return out
    own = Window.partitionBy(story)  # at most cap rows of each block; its count stands at each block's first
    out = out.withColumn("n_over", F.sum(F.when(F.col("rank") == 1, F.col("n_over"))).over(own))
    return out.withColumn("rank", F.row_number().over(own.orderBy(F.desc("score"), F.asc(film)))).where(F.col("rank") <= cap)


def tallies(terms: DataFrame, titles: DataFrame, thresholds: list[float], *, most: int | None = None, story: str = "story_id", film: str = "film_id", small: int = SMALL) -> DataFrame:
    """(story, threshold, n): how many films reach each threshold, where any does.

    With most, n is at most that: a story that holds all tokens of so many films' titles is told by these alone, which are found by the rarest token of each title.
    """
    blocks = _blocks(titles, film, small)
    bounded = lambda n: n if most is None else F.least(n, F.lit(most).cast("long"))
    if blocks is None:
        return tallied(_scores_by_token(terms, inverted_index(titles, film), story, film, min(thresholds)), thresholds, story=story).withColumn("n", bounded(F.col("n")))
    grid = np.array(thresholds, np.float64)

    def tally(index, tokens):
        if most is not None and grid.max() <= 1 and index.films_in(index.contained(tokens)) >= most:
            return [grid, np.full(len(grid), most, np.int64)]
        sets, scores = index.reached(tokens, min(thresholds))
        if index.several:
            _, scores = index.pairs(sets, scores)
            n = (scores[:, None] >= grid).sum(0)
        else:
            n = np.array([index.n_films[sets[scores >= t]].sum() for t in thresholds])
        n = n if most is None else np.minimum(n, most)
        return [grid[n > 0], n[n > 0].astype(np.int64)]

    out = _each_story(terms, blocks, story, "threshold double, n long", lambda index, stories: (tally(index, t) for t in stories))
    return out if len(blocks) == 1 else out.groupBy(story, "threshold").agg(bounded(F.sum("n")).alias("n"))


def _best(hits: DataFrame, story: str, film: str, least: float) -> DataFrame:
    return hits.where(F.col("hits") >= F.lit(least) * F.col("n_tokens") - 1e-9).groupBy(story, film).agg(F.max(F.col("hits") / F.col("n_tokens")).alias("score"))


def rare_tokens(index: DataFrame, seen: DataFrame, film: str, least: float) -> DataFrame:
    """index with probe: the n - ceil(least n) + 1 tokens of each title that the fewest stories hold. A story that reaches least has one of them."""
    df = P.having(seen, index, "token").groupBy("token").agg(F.count("*").alias("__df"))
    place = F.row_number().over(Window.partitionBy(film, "title_no").orderBy(F.coalesce("__df", F.lit(0)), "token"))
    rows = index.join(df, "token", "left").withColumn("__place", place)
    return rows.withColumn("probe", F.col("__place") <= F.col("n_tokens") - F.ceil(F.lit(least) * F.col("n_tokens") - 1e-9) + 1).drop("__df", "__place")


def _scores_by_token(terms: DataFrame, index: DataFrame, story: str, film: str, least: float) -> DataFrame:
    seen = terms.select(story, F.explode("tokens").alias("token")).distinct()
    if least <= 0:
        return _best(seen.join(index, "token").groupBy(story, film, "title_no", "n_tokens").agg(F.count("*").alias("hits")), story, film, least)
    key = [film, "title_no", "n_tokens"]
    ranked = rare_tokens(index, seen, film, least)
    met = seen.join(ranked.where("probe").select(*key, "token"), "token").groupBy(story, *key).agg(F.count("*").alias("first"))
    rest = ranked.where("NOT probe").groupBy(*key).agg(F.collect_list("token").alias("rest"))
    more = met.join(rest, key).select(story, *key, F.explode("rest").alias("token")).join(seen, [story, "token"]).groupBy(story, *key).agg(F.count("*").alias("more"))
    hits = met.join(more, [story, *key], "left").withColumn("hits", F.col("first") + F.coalesce("more", F.lit(0)))
    return _best(hits, story, film, least)


def rescued(terms: DataFrame, titles: DataFrame, *, story: str = "story_id", film: str = "film_id", gram: int = X.FOLD_MIN_CHARS, letters: int = LETTERS, most: int = 16) -> DataFrame:
    """(story, film) where a title's fold stands in one of the story's folds.

    All folds are sought at once: an Aho-Corasick automaton over them goes over each text one time, whatever their number.
    Their letters are counted first: an automaton holds about `letters` of them, more folds make more automata, each with a
    pass over the texts. Folds for more than `most` automata are joined instead (rescued_by_runs).
    """
    folds = rescue_folds(titles, film).where(F.length("fold") >= gram)
    distinct = folds.select("fold").distinct()
    size = distinct.agg(F.sum(F.length("fold"))).first()[0] or 0
    parts = max(1, math.ceil(size / letters))
    if parts > most:
        return rescued_by_runs(terms, folds, story=story, film=film, gram=gram)
    texts = terms.select(story, F.explode("folds").alias("text")).where(F.length("text") >= gram)
    found = None
    for part in range(parts):
        own = distinct if parts == 1 else distinct.where(F.pmod(F.xxhash64("fold"), F.lit(parts)) == part)
        words = [r[0] for r in own.collect()]  # about `letters` letters
        hits = automata.occurring(texts, "text", words, story).withColumnRenamed("word", "fold")
        found = hits if found is None else found.unionByName(hits)
    return found.join(folds, "fold").select(story, film).distinct()


def rescued_by_runs(terms: DataFrame, folds: DataFrame, *, story: str = "story_id", film: str = "film_id", gram: int = X.FOLD_MIN_CHARS) -> DataFrame:
    """The same by a join, for folds (film, fold) of any number.

    A fold's first characters must stand in the text too: each story gives its distinct runs of that many characters, folds
    join on their first, and contains() settles what meets. So no pair is looked at without a shared run, and texts
    are fetched for such pairs alone.
    """
    texts = terms.select(story, F.posexplode("folds").alias("field", "text")).where(F.length("text") >= gram)
    runs = texts.select(story, "field", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{gram}}}))"), F.lit(1)))).alias("run"))
    met = runs.join(folds.withColumn("run", F.substring("fold", 1, gram)), "run").select(story, "field", film, "fold")
    return met.join(texts, [story, "field"]).where(F.contains("text", "fold")).select(story, film).distinct()


def candidates(terms: DataFrame, titles: DataFrame, threshold: float = THRESHOLD, cap: int = CAP, *, story: str = "story_id", film: str = "film_id",
               order: list[Column] | None = None, rescue: bool = True) -> DataFrame:
    """(story, film, score, rank, n_over): what reaches the threshold, best first, at most cap per story; n_over is the count before the cap."""
    found = token_scores(terms, titles, story=story, film=film, least=threshold)
    if rescue:
        found = found.unionByName(rescued(terms, titles, story=story, film=film).withColumn("score", F.lit(1.0))).groupBy(story, film).agg(F.max("score").alias("score"))
    return cut(found, threshold, cap, story=story, film=film, order=order)


def cut(scores: DataFrame, threshold: float, cap: int, *, story: str = "story_id", film: str = "film_id", order: list[Column] | None = None) -> DataFrame:
    over = scores.where(F.col("score") >= threshold)
    best = Window.partitionBy(story).orderBy(F.desc("score"), *(order or []), F.asc(film))
    return (over.withColumn("n_over", F.count("*").over(Window.partitionBy(story))).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= cap))


def per_story(stories: DataFrame, found: DataFrame, cap: int = CAP, *, story: str = "story_id") -> DataFrame:
    """(story, offered, n_over, saturated) of every story, those without candidates too."""
    n = found.groupBy(story).agg(F.count("*").alias("offered"), F.max("n_over").alias("n_over"))
    return stories.select(story).join(n, story, "left").select(
        story, F.coalesce("offered", F.lit(0)).alias("offered"), F.coalesce("n_over", F.lit(0)).alias("n_over"), (F.coalesce("n_over", F.lit(0)) > cap).alias("saturated"))


def per_story_of(tally: DataFrame, stories: DataFrame, cap: int = CAP, *, story: str = "story_id") -> DataFrame:
    """(story, offered, saturated) of every story from counts (story, n) of what reaches the threshold, which may end at cap + 1."""
    n = F.coalesce("n", F.lit(0).cast("long"))
    return stories.select(story).join(tally.select(story, "n"), story, "left").select(story, F.least(n, F.lit(cap).cast("long")).alias("offered"), (n > cap).alias("saturated"))


def health(tally: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, rates (null of nothing) and breaches: hard if too many stories find nothing, soft if too many are capped."""
    t = tally.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.count_if(F.col("offered") == 0).alias("zero"), F.count_if("saturated").alias("saturated"), F.sum("offered").alias("offered"))
    rate = {"zero_rate": F.col("zero"), "saturation_rate": F.col("saturated"), "mean_offered": F.coalesce("offered", F.lit(0))}
    for name, part in rate.items():
        t = t.withColumn(name, V.ratio(part, F.col("n")))
    enough = F.col("n") >= LEAST_N
    return t.withColumn("hard_breach", F.coalesce(enough & (F.col("zero_rate") > ZERO_LIMIT), F.lit(False))).withColumn(
        "soft_breach", F.coalesce(enough & (F.col("saturation_rate") > SATURATION_LIMIT), F.lit(False)))


def tallied(scores: DataFrame, thresholds: list[float], *, story: str = "story_id") -> DataFrame:
    """(story, threshold, n): how many of a story's scores reach each threshold."""
    grid = F.array(*(F.lit(float(t)) for t in thresholds))
    return scores.select(story, F.explode(F.filter(grid, lambda t: F.col("score") >= t)).alias("threshold")).groupBy(story, "threshold").agg(F.count("*").alias("n"))


def sweep(scores: DataFrame, stories: DataFrame, thresholds: list[float], caps: list[int], *, story: str = "story_id") -> DataFrame:
    """For each threshold and cap: stories, those with nothing, those capped, and candidates offered, from one scoring."""
    return sweep_of(tallied(scores, thresholds, story=story), stories, thresholds, caps, story=story)


def sweep_of(tally: DataFrame, stories: DataFrame, thresholds: list[float], caps: list[int], *, story: str = "story_id") -> DataFrame:
    """The same from counts (story, threshold, n): caps cost nothing more; the grid is a literal array."""
    grid = F.array(*(F.lit(float(t)) for t in thresholds))
    sums = tally.withColumn("cap", F.explode(F.array(*(F.lit(int(c)) for c in caps)))).groupBy("threshold", "cap").agg(
        F.count("*").alias("found"), F.count_if(F.col("n") > F.col("cap")).alias("saturated"), F.sum(F.least("n", F.col("cap").cast("long"))).alias("offered"))
    total = stories.select(F.count_distinct(story).alias("n_stories"))
    every = total.select("n_stories", F.explode(grid).alias("threshold")).select("n_stories", "threshold", F.explode(F.array(*(F.lit(int(c)) for c in caps))).alias("cap"))
    return every.join(sums, ["threshold", "cap"], "left").select(
        "threshold", "cap", "n_stories", (F.col("n_stories") - F.coalesce("found", F.lit(0))).alias("zero"),
        F.coalesce("saturated", F.lit(0)).alias("saturated"), F.coalesce("offered", F.lit(0)).alias("offered"))


def growth_curve(scores: DataFrame, films: DataFrame, sizes: list[int], threshold: float = THRESHOLD, *, story: str = "story_id", film: str = "film_id") -> DataFrame:
    """Candidates over the threshold if only the first size films by id were known.

    Only the first max(sizes) films are numbered, in one task: the sizes, not the catalog, bound it. Each size's last id then bounds its films.
    """
    bounds = films.select(film).distinct().orderBy(film).limit(max(sizes)).withColumn("n", F.row_number().over(Window.orderBy(film)))  # at most max(sizes) rows
    edge = [bounds.select(F.max(F.when(F.col("n") <= s, F.col(film))).alias("last"), F.lit(int(s)).alias("size")) for s in sizes]
    edges = edge[0]
    for e in edge[1:]:
        edges = edges.unionByName(e)
    counts = scores.where(F.col("score") >= threshold).groupBy(film).agg(F.count("*").alias("c"))
    return counts.join(F.broadcast(edges), F.col(film) <= F.col("last")).groupBy("size").agg(F.sum("c").alias("candidates"))  # one row for each size


def first_films(films: DataFrame, n: int, film: str = "film_id") -> DataFrame:
    """The first n ids of films: all that a growth curve up to n looks at."""
    return films.select(film).distinct().orderBy(film).limit(n)


def coverage(labels: DataFrame, found: DataFrame, scores: DataFrame, films: DataFrame, cap: int = CAP, threshold: float = THRESHOLD, *, story: str = "story_id", film: str = "film_id") -> DataFrame:
    """labels (story, film) with outcome: retrieved, or why not: not-in-catalog, not-indexed, below-threshold or capped."""
    hit = found.select(story, film, F.col("rank").alias("hit_rank"))
    score = scores.select(story, film, F.col("score").alias("label_score"))
    known = films.select(film).distinct().withColumn("known", F.lit(True))
    outcome = (F.when(F.col("hit_rank").isNotNull(), "retrieved").when(F.col("known").isNull(), "not-in-catalog").when(F.col("label_score").isNull(), "not-indexed")
               .when(F.col("label_score") < threshold, "below-threshold").otherwise("capped"))
    return labels.join(hit, [story, film], "left").join(score, [story, film], "left").join(known, film, "left").select(story, film, "hit_rank", "label_score", outcome.alias("outcome"))


def recall(covered: DataFrame) -> DataFrame:
    """Retrieved over all labels whose film is in the catalog."""
    inside = F.count_if(F.col("outcome") != "not-in-catalog")
    hits = F.count_if(F.col("outcome") == "retrieved")
    return covered.agg(hits.alias("retrieved"), inside.alias("labels"), V.ratio(hits, inside, 0.0).alias("recall"))


def display_attributes(films: DataFrame, genres: DataFrame, directors: DataFrame, cast: DataFrame, *, film: str = "film_id", collections: DataFrame | None = None, release: str | None = None) -> DataFrame:
    """Films with genres, directors and the three first billed as text; each is gathered before its join.

    collections (collection_id, collection) name the film's collection if it has one; release is a date column whose year is added.
    """
    if collections is not None:
        films = films.join(collections.select("collection_id", "collection"), "collection_id", "left")
    if release:
        films = films.withColumn("year", F.year(release))
    from tidepool.operators.feeds import ordered_join, top_n

    top = top_n(cast, [film], [F.asc_nulls_last("credit_order"), F.asc("name")], 3, "place")
    return (films.join(ordered_join(genres, [film], "name", ["name"], "genres"), film, "left")
            .join(ordered_join(directors, [film], "name", ["credit_order", "name"], "directors"), film, "left")
            .join(ordered_join(top, [film], "name", ["place"], "cast"), film, "left"))


def rendered(candidate: DataFrame, columns: list[str], *, title: str = "title", original: str = "original_title", overview: str = "overview") -> DataFrame:
    """Each candidate as compact JSON: empty fields left out, the original title only where it differs, 120 characters of overview."""
    fields = []
    for c in columns:
        x = F.nullif(F.col(c).cast("string"), F.lit(""))
        x = F.when(~F.col(c).eqNullSafe(F.col(title)), x) if c == original else F.substring(x, 1, 120) if c == overview else x
        fields.append(x.alias(c))
    return candidate.withColumn("rendered", F.to_json(F.struct(*fields)))


def batches(stories: DataFrame, size: int, *, by: str, order: list[Column]) -> DataFrame:
    """Rows numbered into batches of size within each group."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return stories.withColumn("batch", F.floor((n - 1) / size))
