"""Language of documents: a linear-chain conditional random field labels every word.

Words are maximal runs of letters. A word's score for a language adds learned weights of hashed features:
its prefixes and suffixes of 1 to 3 letters (affixes), its n-grams of 2 to 4 letters, and the whole word
(lexicon). Learned transitions tie neighbours together. Forward-backward gives each word's probability of
each language; a document's language is the one with the largest sum over all its words, its score that
language's mean probability. Code-switched text keeps a label for each word.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import held_out, tidy

FEATURES = 1 << 16
STEP = 64  # words in a chunk
PART = 300_000  # letters worked on at once
WINDOW = re.compile(r"(?s).{1,400}(?!\S)|.{1,400}")  # what a text is cut into to learn from it: all of it, between words where it has any
BUFFER = 8_192  # windows that a task holds and takes in an order of chance
UND = "und"
_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: is it a letter, and its lower case (itself where that is no single letter)."""
    if not _tables:
        n = 0x33480
        letter = np.zeros(0x110000, bool)
        lower = np.arange(0x110000, dtype=np.uint32)
        for i in range(n):
            if unicodedata.category(c := chr(i))[0] == "L":
                letter[i] = True
                if len(x := c.lower()) == 1:
                    lower[i] = ord(x)
        _tables.append((letter, lower))
    return _tables[0]


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points of all words in a row, where each word begins, and how many words each text has."""
    letter, lower = _letters()
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])  # one past each text's separator
    mask = letter[codes]
    before = np.concatenate(([False], mask[:-1]))
    begins = np.flatnonzero(mask & ~before)
    per_text = np.diff(np.searchsorted(begins, ends), prepend=0)
    kept = np.flatnonzero(mask)
    return lower[codes[kept]], np.searchsorted(kept, begins), per_text


def features_of(codes: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """(feature numbers, the word of each; None: one per letter) for the words that begin at starts."""
    n, m = len(codes), len(starts)
    ends = np.append(starts[1:], n)
    length = ends - starts

    def slot(h: np.ndarray, salt: int) -> np.ndarray:
        h = (h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(48)).astype(np.int32)

    c = codes.astype(np.uint64)
    word = np.repeat(np.arange(m, dtype=np.int32), length)
    left = (np.repeat(ends, length) - np.arange(n)).astype(np.int32)  # letters from here to the word's end
    out = []
    gram = c
    with np.errstate(over="ignore"):
        for k in (2, 3, 4):
            gram = gram[:-1] * np.uint64(0x100000001B3) + c[k - 1:]
            at = np.flatnonzero(left[:len(gram)] >= k)
            out.append((slot(gram[at], k), word[at]))
        for k in (1, 2, 3):
            size = np.minimum(length, k)
            for salt, first in ((10, starts), (20, ends - size)):
                h = np.zeros(m, np.uint64)
                for j in range(k):
                    ok = j < size
                    h = np.where(ok, h * np.uint64(0x100000001B3) + c[np.minimum(first + j, n - 1)] + np.uint64(1), h)
                out.append((slot(h, salt + k), None))
        power = np.cumprod(np.full(33, np.uint64(0x100000001B3)))
        place = np.minimum(np.arange(n) - np.repeat(starts, length), 32)
        out.append((slot(np.add.reduceat(c * power[place], starts), 40), None))
    return out


def scores_of(features: list[tuple[np.ndarray, np.ndarray | None]], words: int, weights: np.ndarray) -> np.ndarray:
    """The score of each word for each language."""
    total = np.zeros((words, weights.shape[1]), np.float32)
    for slots, word in features:
        if word is None:
            total += weights[slots]
        elif len(word):
            at = np.flatnonzero(np.diff(word, prepend=-1))
            total[word[at]] += np.add.reduceat(weights[slots], at, axis=0)
    return total


def emissions(codes: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The score of each word for each language."""
    return scores_of(features_of(codes, starts) if len(starts) else [], len(starts), weights)


def known_share(codes: np.ndarray, starts: np.ndarray, per_text: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The share of each text's features that the weights have met before, less what chance makes of features never met: 1 if all are known, about 0 if none is."""
    n = len(starts)
    known, all_ = np.zeros(n), np.zeros(n)
    for slots, word in features_of(codes, starts) if n else ():
        hit = used[slots]
        known += hit if word is None else np.bincount(word, hit, n)
        all_ += 1 if word is None else np.bincount(word, minlength=n)
    some = np.flatnonzero(per_text)
    begin = np.cumsum(per_text)[some] - per_text[some]
    out, chance = np.zeros(len(per_text)), used.mean()
    if len(some):
        out[some] = (np.add.reduceat(known, begin) / np.add.reduceat(all_, begin) - chance) / max(1e-9, 1 - chance)
    return out


def forward_backward(scores: np.ndarray, per_text: np.ndarray, transitions: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Each word's probability of each language, given all words of its text.

    To pairs, if given, is added how often each language is expected to follow each within the texts: the sums of the
    pairwise marginals. A text's first word has no transition before it.

    Texts are cut into chunks of STEP words, which are worked on side by side. A first pass gives each chunk's
    transfer matrix; messages across a text's chunks follow from these; then each chunk is labelled. The
    result is that of one chain over the whole text.
    """
    n, L = scores.shape
    if not n:
        return scores
    trans = np.exp(transitions).astype(np.float32)
    chunks = -(-per_text // STEP)
    total = int(chunks.sum())
    of = np.repeat(np.arange(len(per_text)), chunks)
    first = np.cumsum(chunks) - chunks
    order = np.arange(total) - first[of]
    begin = (np.cumsum(per_text) - per_text)[of] + order * STEP
    size = np.minimum(STEP, per_text[of] - order * STEP)
    at = begin[:, None] + np.arange(STEP)
    live = np.arange(STEP) < size[:, None]
    e = np.exp(scores - scores.max(1, keepdims=True))
    e = np.maximum(e, 1e-12)[np.minimum(at, n - 1)]  # chunk, step, language
    e = np.ascontiguousarray(e.transpose(1, 0, 2))
    live = live.T

    def norm(x: np.ndarray) -> np.ndarray:
        return x / x.sum(-1, keepdims=True)

    m = np.broadcast_to(np.eye(L, dtype=np.float32), (total, L, L)).copy()
    opens = (order == 0)[:, None]
    for t in range(STEP):
        new = (m.reshape(-1, L) @ trans).reshape(m.shape)
        if t == 0:
            new = np.where(opens[:, :, None], m, new)
        new = new * e[t][:, None, :]
        new /= new.sum((1, 2), keepdims=True)
        m = np.where(live[t][:, None, None], new, m)
    into = np.full((total, L), 1.0 / L, np.float32)
    back = np.full((total, L), 1.0 / L, np.float32)
    by_order = np.argsort(order, kind="stable")
    bounds = np.searchsorted(order[by_order], np.arange(1, int(chunks.max()) + 1))
    groups = np.split(by_order, bounds)[: int(chunks.max())]
    for g in groups[1:]:
        into[g] = norm(np.einsum("ci,cij->cj", into[g - 1], m[g - 1]))
    for g in groups[:0:-1]:
        back[g - 1] = norm(np.einsum("cij,cj->ci", m[g], back[g]))
    alpha = np.empty_like(e)
    a = into
    for t in range(STEP):
        new = norm((np.where(opens, a, a @ trans) if t == 0 else a @ trans) * e[t])
        a = np.where(live[t][:, None], new, a)
        alpha[t] = a
    b = back
    for t in range(STEP - 1, -1, -1):
        if pairs is not None:
            both = (alpha[t - 1] if t else into)[:, :, None] * trans * (e[t] * b)[:, None, :]
            both /= both.sum((1, 2), keepdims=True)
            pairs += both[live[t] if t else live[t] & ~opens[:, 0]].sum(0)
        alpha[t] *= b
        b = np.where(live[t][:, None], norm((b * e[t]) @ trans.T), b)
    p = norm(alpha)
    out = np.empty((n, L), np.float32)
    out[at.T[live]] = p[live]
    return out


class Trainer:
    """Weights (feature by language) and transitions, by adaptive gradient steps on the chain's log-likelihood; how often each feature was met.

    Sequences are made of windows of labelled documents, two windows one after the other, so that the language
    changes within them; every word bears its document's language.
    """

    def __init__(self, languages: int, rate: float = 0.5, seed: int = 7):
        self.rate, self.rng = rate, np.random.default_rng(seed)
        self.weights = np.zeros((FEATURES, languages), np.float32)
        self.trans = np.where(np.eye(languages, dtype=bool), 2.0, 0.0).astype(np.float32)
        self.met = np.zeros(FEATURES, np.int64)
        self.seen_w, self.seen_t = np.full_like(self.weights, 1e-3), np.full_like(self.trans, 1.0)

    def learn(self, texts: list[str], labels: np.ndarray, epochs: int = 1) -> None:
        """As many passes over all texts, in an order of chance."""
        for _ in range(epochs):
            order = self.rng.permutation(len(texts))
            for i in range(0, len(order), 256):
                pick = order[i:i + 256]
                self._step([texts[j] for j in pick], labels[pick])

    def _step(self, texts: list[str], labels: np.ndarray) -> None:
        codes, starts, per_text = words_of(texts)
        if not len(starts):
            return
        weights, trans = self.weights, self.trans
        languages = len(trans)
        gold = np.repeat(labels, per_text)
        pairs = np.add.reduceat(np.append(per_text, 0) if len(per_text) % 2 else per_text, np.arange(0, len(per_text), 2))
        soft = np.zeros_like(trans)
        features = features_of(codes, starts)
        p = forward_backward(scores_of(features, len(starts), weights), pairs, trans, soft)
        err = np.eye(languages, dtype=np.float32)[gold] - p
        grad = np.zeros_like(weights)
        for slots, word in features:
            each = err if word is None else err[word]
            for x in range(languages):
                grad[:, x] += np.bincount(slots, each[:, x], FEATURES)
            self.met += np.bincount(slots, minlength=FEATURES)
        grad /= len(texts)
        self.seen_w += grad * grad
        weights += self.rate * grad / np.sqrt(self.seen_w) * (grad != 0)
        inner = np.ones(len(gold), bool)
        ends = np.cumsum(pairs) - 1
        inner[ends[ends >= 0]] = False
        k = np.flatnonzero(inner)
        k = k[k + 1 < len(gold)]
        real = np.zeros_like(trans)
        np.add.at(real, (gold[k], gold[k + 1]), 1)
        g = (real - soft) / max(1, len(k))
        self.seen_t += g * g
        trans += self.rate * g / np.sqrt(self.seen_t)


def learned(rows: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, transitions and which features count as known, from the whole texts of all rows (doc_id, text, lang).

    Rows are dealt into tasks by chance; each learns from its own, window by window, and the models are put together: a feature's weights are the mean
    of those of the tasks, by how often each met it. Whole passes are made over all that a task has: one, or where that is at most BUFFER windows, five.
    A feature is known if it is met more often than features are in the mean. That doesn't depend on how much there was to learn from.
    """
    at = {n: i for i, n in enumerate(names)}
    shape = (FEATURES, len(names))

    def run(batches):
        trainer, windows, labels, full, count = Trainer(len(names)), [], [], False, 0
        for batch in batches:
            for t, x in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                found = WINDOW.findall(t)
                windows += found
                labels += [at[x]] * len(found)
                count += len(found)
                if len(windows) > BUFFER:
                    trainer.learn(windows, np.array(labels))
                    windows, labels, full = [], [], True
        if windows:
            trainer.learn(windows, np.array(labels), 1 if full else 5)
        if count:
            met = trainer.met.astype(np.float64) / (1 if full else 5)
            sums = np.concatenate([(trainer.weights * met[:, None]).ravel(), met, trainer.trans.ravel() * count, [count]])
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    parts = rows.repartition(F.xxhash64("doc_id", "text")).select("text", "lang").mapInArrow(tidy(run), "sums binary")
    total = parts.rdd.map(lambda r: np.frombuffer(r["sums"])).treeReduce(np.add, 3)
    weights, met, trans, count = np.split(total, np.cumsum([FEATURES * len(names), FEATURES, len(names) ** 2]))
    trans = trans.reshape(len(names), -1) / count[0]
    return ((weights.reshape(shape) / np.maximum(met, 1)[:, None]).astype(np.float32), np.clip(trans - trans.max(), -8, 0).astype(np.float32), met > met.mean())


def runs_of(texts: list[str]):
    """(begin, end) of runs of texts of about PART letters, which bound the arrays; a longer text is alone."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > PART or i + 1 == len(texts):
            yield at, i + 1
            at, size = i + 1, 0


class Labeller:
    """A trained model that workers share: names of the languages, weights, transitions and known features.

    It learns from the whole texts of all rows that aren't held out and have a language. least is the known share (see known_share) under which a text
    counts as in none of the languages: two thirds (0.65) of what all but a hundredth of the texts reach that the weights weren't learned from; no bar where
    there are too few texts to tell, and none without bar.
    """

    def __init__(self, docs: DataFrame, doc_id: str, text: str, lang: str, bar: bool = False):
        rows = docs.where(~held_out(doc_id) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
            F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
        # of every five texts one sets the bar, the others the weights; a language that has texts of the first kind only is learned from these
        sizes = {r["lang"]: (r["all"], r["apart"]) for r in rows.groupBy("lang").agg(F.count("*").alias("all"), F.count_if(F.crc32("text") % 5 == 0).alias("apart")).collect()}
        self.names = sorted(sizes)
        bar = bar and sum(n for n, _ in sizes.values()) >= 50 and all(k < n for n, k in sizes.values()) and any(k for _, k in sizes.values())
        apart = F.crc32("text") % 5 == 0
        self.least = -np.inf
        self.model = docs.sparkSession.sparkContext.broadcast(learned(rows.where(~apart) if bar else rows, self.names) if sizes else None)
        if bar:
            def run(batches):
                for batch in batches:
                    yield pa.RecordBatch.from_arrays([pa.array(self.known(batch.column("text").to_pylist()), pa.float64())], names=["known"])

            self.least = 0.65 * rows.where(apart).select("text").mapInArrow(tidy(run), "known double").agg(F.percentile_approx("known", 0.01, 100_000)).first()[0]

    def known(self, texts: list[str]) -> np.ndarray:
        """The known share of each text's features."""
        done = [known_share(*words_of(texts[a:b]), self.model.value[2]) for a, b in runs_of(texts)]
        return np.concatenate(done) if done else np.zeros(0)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Number of the language (-1: none), score, words and switches of each text."""
        done = [self._label(texts[a:b]) for a, b in runs_of(texts)]
        return tuple(np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in range(4))

    def _label(self, texts: list[str]):
        codes, starts, per_text = words_of(texts)
        best, score, switches = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        if self.model.value is None or not len(starts):
            return best, score, per_text, switches
        weights, trans, _ = self.model.value
        p = forward_backward(emissions(codes, starts, weights), per_text, trans)
        some = np.flatnonzero(per_text)
        begin = np.cumsum(per_text)[some] - per_text[some]
        mean = np.add.reduceat(p.astype(np.float64), begin, axis=0) / per_text[some][:, None]
        best[some], score[some] = mean.argmax(1), np.clip(mean.max(1), 0, 1)
        hard = p.argmax(1)
        change = np.diff(hard, prepend=hard[0]) != 0
        change[begin] = False
        switches[some] = np.add.reduceat(change.astype(np.int64), begin)
        return best, score, per_text, switches


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words and n_switches for every row of docs.

    Learns from the whole texts of all documents whose crc32(doc_id as text) mod 5 is not 0 and whose lang is not
    null; predicts from the whole text alone. lang_pred is a learned value, or 'und' with score 0 if the text is
    null or holds no letter, or if nothing could be learned. n_switches counts neighbouring words with different
    labels. Repeated rows each keep a row; an empty table gives no rows; a null doc_id counts as not held out;
    other columns are ignored.
    """
    label = Labeller(docs, doc_id, text, lang)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    schema = rows.select("doc_id", "held_out").schema.add("lang_pred", "string").add("score", "double").add("n_words", "long").add("n_switches", "long")

    def run(batches):
        for batch in batches:
            best, score, count, switches = label([x or "" for x in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([label.names[b] if b >= 0 else UND for b in best.tolist()], pa.string()),
                 pa.array(score, pa.float64()), pa.array(count.astype(np.int64), pa.int64()), pa.array(switches.astype(np.int64), pa.int64())],
                names=["doc_id", "held_out", "lang_pred", "score", "n_words", "n_switches"])

    return rows.mapInArrow(tidy(run), schema)


def keep_known(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs whose text is in one of the learned languages, or in several; lang becomes the predicted language.

    Rows that detect would call 'und' go, and so do those of which the model knows too few features (affixes, n-grams, words; see Labeller.least):
    texts in an unknown language or script, or of letters that make no words. Where
    nothing could be learned (no row with a lang), rows with a letter stay as they are; where there is little to learn from, all rows
    with a letter stay. Other columns, repeated rows and the order of columns stay; an empty
    table gives no rows; a null text goes.
    """
    label = Labeller(docs, doc_id, text, lang, bar=True)

    def run(batches):
        for batch in batches:
            texts = [x or "" for x in batch.column(text).to_pylist()]
            best, _, count, _ = label(texts)
            keep = count > 0
            if label.names:
                keep &= label.known(texts) >= label.least
                at = batch.schema.get_field_index(lang)
                new = pa.array([label.names[b] if b >= 0 else None for b in best.tolist()], pa.string())
                batch = batch.set_column(at, batch.schema.field(at).with_type(pa.string()), new)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
