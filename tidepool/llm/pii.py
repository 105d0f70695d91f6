"""Personal data in text: base patterns, and a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy from labelled spans: windows of the corpus into which generated entities of
known kind and place are written, and look-alikes (versions, dates, prices, keys) without a label. Texts are
read in overlapping windows; each is decoded by Viterbi, and the spans of all windows of a text are
reconciled together. Base spans always stay; the network adds spans that overlap none of them.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import hash_sample, tidy

KINDS = ("email", "ip", "card", "phone")
SECRET = len(KINDS)  # keys, tokens and passwords: found by the network alone and reported apart
NAMES = (*KINDS, "secret")
TAGS = 1 + 2 * len(NAMES)  # outside, then begin and inside of each kind
WIDTH, STRIDE, HIDDEN = 128, 64, 16
LEAST = 0.6  # mean probability of a span's characters
Span = tuple[int, int, int]  # start, end (exclusive), number of the kind

DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANCHOR = re.compile(r"[0-9@]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def digits_of(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def octet(s: str) -> bool:
    return len(s.lstrip("0")) <= 3 and int(s.lstrip("0") or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """The base patterns' matches: leftmost, non-overlapping per kind; failing matches are dropped, without retries.

    Takes time in proportion to the text. An address is found from its @: its local part is the run of
    local characters before it, back to the last address at most.
    """
    out: list[Span] = []
    done = 0
    for m in DOMAIN.finditer(text):
        at = start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            done = m.end()
            out.append((start, done, 0))
    for m in IP.finditer(text):
        if all(map(octet, m.group().split("."))):
            out.append((*m.span(), 1))
    for m in CARD.finditer(text):
        if 14 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            out.append((*m.span(), 2))
    for m in PHONE.finditer(text):
        if 10 <= len(digits_of(m.group())) <= 15:
            out.append((*m.span(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def plausible(s: str, kind: int) -> bool:
    """What a span of a kind must fulfil whatever the network says: the rules that the base patterns have beside their form."""
    d = digits_of(s)
    if kind == 0:
        name, at, host = s.partition("@")
        return bool(at and name.strip() and "@" not in host and re.search(r"[A-Za-z0-9-]\W*\.\W*[A-Za-z0-9-]", host))
    if kind == SECRET:
        return len(s) <= 120 and any(any(c.isdigit() for c in w) and any(c.isalpha() for c in w) for w in re.findall(r"[A-Za-z0-9_/+-]{12,}", s))
    if any(c.isalpha() for c in s):
        return False
    if kind == 1:
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(map(octet, parts))
    if kind == 2:
        return 14 <= len(d) <= 19 and luhn(d)
    return 10 <= len(d) <= 15


# --- the network ---

_ASCII = {c: i + 4 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz@.+-()[]_%/:,;'\"=#&*|!?$")}
SYMBOLS = 4 + len(_ASCII) + 1


def _symbol_table() -> np.ndarray:
    """Symbol of each code point: 0 padding, 1 white space, 2 digit, 3 other letter, one for each common mark, last: the rest."""
    table = np.full(0x110000, SYMBOLS - 1, np.uint8)
    for i in range(0x3000):
        c = chr(i)
        table[i] = 1 if c.isspace() else 2 if c in "0123456789" else _ASCII.get(c.lower(), 3 if c.isalpha() else SYMBOLS - 1)
    table[0x3000:0xD800] = 3
    return table


_table: list[np.ndarray] = []


def symbols_of(text: str) -> np.ndarray:
    if not _table:
        _table.append(_symbol_table())
    return _table[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def lstm(ids: np.ndarray, wx: np.ndarray, wh: np.ndarray, keep: bool = False):
    """Hidden states (step, window, unit) of one direction; with keep also what the backward pass needs."""
    n, T = ids.shape
    H = wh.shape[0]
    h, c = np.zeros((n, H), np.float32), np.zeros((n, H), np.float32)
    out = np.empty((T, n, H), np.float32)
    saved = []
    for t in range(T):
        z = wx[ids[:, t]] + h @ wh
        gates = sigmoid(z[:, :3 * H])
        i, f, o, g = gates[:, :H], gates[:, H:2 * H], gates[:, 2 * H:], np.tanh(z[:, 3 * H:])
        before, old = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            saved.append((i, f, o, g, before, tc, old))
    return out, saved


def lstm_grads(dh_out: np.ndarray, ids: np.ndarray, wx: np.ndarray, wh: np.ndarray, saved: list) -> tuple[np.ndarray, np.ndarray]:
    T, n, H = dh_out.shape
    dwh, all_dz = np.zeros_like(wh), np.empty((T, n, 4 * H), np.float32)
    dh, dc = np.zeros((n, H), np.float32), np.zeros((n, H), np.float32)
    for t in range(T - 1, -1, -1):
        i, f, o, g, before, tc, old = saved[t]
        dh = dh + dh_out[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        dwh += old.T @ dz
        all_dz[t] = dz
        dh, dc = dz @ wh.T, dc * f
    one_hot = np.eye(len(wx), dtype=np.float32)[ids.T.ravel()]
    return one_hot.T @ all_dz.reshape(T * n, 4 * H), dwh


def tag_scores(ids: np.ndarray, model: dict[str, np.ndarray], keep: bool = False):
    a, sa = lstm(ids, model["fx"], model["fh"], keep)
    b, sb = lstm(ids[:, ::-1], model["bx"], model["bh"], keep)
    h = np.concatenate([a, b[::-1]], 2)
    return h @ model["wo"] + model["bo"], h, sa, sb


def viterbi(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags (window, step)."""
    T, n, K = scores.shape
    best, back = scores[0], np.empty((T, n, K), np.int8)
    for t in range(1, T):
        step = best[:, :, None] + trans
        back[t] = step.argmax(1)
        best = np.take_along_axis(step, back[t][:, None, :].astype(np.int64), 1)[:, 0] + scores[t]
    tags = np.empty((n, T), np.int8)
    tags[:, -1] = at = best.argmax(1)
    for t in range(T - 1, 0, -1):
        at = back[t][np.arange(n), at]
        tags[:, t - 1] = at
    return tags


def messages(scores: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, ...]:
    """exp of scores and transitions, and the forward and backward messages, each scaled to 1 at every step."""
    T = len(scores)
    e, a = np.exp(scores - scores.max(2, keepdims=True)), np.exp(trans)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[0] = e[0] / e[0].sum(1, keepdims=True)
    for t in range(1, T):
        x = (alpha[t - 1] @ a) * e[t]
        alpha[t] = x / x.sum(1, keepdims=True)
    for t in range(T - 2, -1, -1):
        x = (e[t + 1] * beta[t + 1]) @ a.T
        beta[t] = x / x.sum(1, keepdims=True)
    return e, a, alpha, beta


def marginals(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Each tag's probability (step, window, tag)."""
    *_, alpha, beta = messages(scores, trans)
    p = alpha * beta
    return p / p.sum(2, keepdims=True)


def crf_grads(scores: np.ndarray, trans: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the negative log-likelihood for scores and transitions."""
    T, _, K = scores.shape
    e, a, alpha, beta = messages(scores, trans)
    p = alpha * beta
    p /= p.sum(2, keepdims=True)
    pair = np.zeros_like(trans)
    for t in range(1, T):
        x = alpha[t - 1][:, :, None] * a * (e[t] * beta[t])[:, None, :]
        pair += (x / x.sum((1, 2), keepdims=True)).sum(0)
    g = p - np.eye(K, dtype=np.float32)[gold.T]
    np.subtract.at(pair, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    return g, pair


def generated(rng: np.random.Generator) -> tuple[str, int]:
    """An entity and its kind's number, or a look-alike and -1."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda lo, hi: "".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(lo, hi)))
    pick = lambda *x: x[rng.integers(len(x))]
    mixed = lambda n, letters: "".join(pick(*"0123456789") if rng.random() < 0.5 else pick(*letters) for _ in range(n))
    kind = int(rng.integers(-2, 5))
    if kind == 0:
        at, dot = pick("@", "@", " @ "), pick(".", ".", " . ")
        return pick(word(3, 9), word(3, 7) + pick(".", "_", "-") + word(3, 9), word(3, 7) + d(2)) + at + word(3, 10) + dot + pick("com", "org", "net", "example.com", "de", "co.uk"), 0
    if kind == 1:
        return pick(".", ".", ".", "[.]", " . ").join(str(x) for x in rng.integers(0, 256, 4)), 1
    if kind == 2:
        body = d(int(rng.integers(13, 16)))
        body = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        return pick("", " ", "-", ".", " - ").join([body[:4], body[4:8], body[8:12], body[12:]]), 2
    if kind == 3:
        return pick(f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"00{d(2)} {d(3)} {d(3)} {d(4)}", f"00{d(1)} {d(3)} {d(3)} {d(4)}", f"+{d(11)}", f"({d(3)}) {d(3)} {d(4)}"), 3
    if kind == SECRET:
        return pick("AKIA" + mixed(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), f'token = "{mixed(40, "abcdef")}"', f"password={mixed(18, 'abcdef')}", f"api_key: {mixed(int(rng.integers(20, 33)), 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ')}", f"sk-{mixed(32, 'abcdefghijklmnopqrstuvwxyz')}"), SECRET
    return pick(f"20{d(2)}-{d(2)}-{d(2)}", f"{d(1)}.{d(1)}", f"version {d(1)}.{d(1)}.{d(1)}", f"${d(3)}.{d(2)}", d(5), d(3) + "," + d(3), f"{word(3, 8)}-{d(2)}", f"{word(2, 6)}{d(2)}", f"{word(5, 12)}_{word(5, 12)}", f"token = \"{word(3, 8)}\"", f"password={word(3, 7)}", f"{d(2)}:{d(2)}", f"{d(3)}%", f"@{word(3, 9)}", f"{d(1)}. ", f"{d(24)}"), -1


def training_windows(texts: list[str], count: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    ids, gold = np.zeros((count, WIDTH), np.uint8), np.zeros((count, WIDTH), np.int64)
    texts = [t for t in texts if t.strip()] or ["no text to learn from but this line"]
    for row in range(count):
        t = texts[rng.integers(len(texts))]
        at = int(rng.integers(0, max(1, len(t) - WIDTH)))
        line, tags = re.sub(r"[0-9@]", "", t[at:at + WIDTH]), []
        line_tags = np.zeros(len(line), np.int64)
        for _ in range(int(rng.integers(0, 3))):
            s, kind = generated(rng)
            spots = [m.end() for m in re.finditer(r"\s", line) if line_tags[m.start()] == 0]
            p = spots[rng.integers(len(spots))] if spots else 0
            s_tags = np.zeros(len(s) + 1, np.int64)
            if kind >= 0:
                s_tags[0], s_tags[1:len(s)] = 1 + 2 * kind, 2 + 2 * kind
            end = " " if rng.random() < 0.8 else ". "[int(rng.integers(2))]
            line = line[:p] + s + end + line[p:]
            line_tags = np.concatenate([line_tags[:p], s_tags, line_tags[p:]])
        cut = int(rng.integers(0, max(1, len(line) - WIDTH + 1)))
        got = symbols_of(line[cut:cut + WIDTH])
        tags = line_tags[cut:cut + WIDTH]
        ids[row, :len(got)], gold[row, :len(tags)] = got, tags
    return ids, gold


def train(texts: list[str], windows: int = 6000, epochs: int = 7, batch: int = 50, rate: float = 0.03, seed: int = 11) -> dict[str, np.ndarray]:
    """The network's weights, by Adam on the CRF's log-likelihood."""
    rng = np.random.default_rng(seed)
    H = HIDDEN
    init = lambda *s: (rng.standard_normal(s) / np.sqrt(H)).astype(np.float32)
    model = {"fx": init(SYMBOLS, 4 * H), "fh": init(H, 4 * H), "bx": init(SYMBOLS, 4 * H), "bh": init(H, 4 * H), "wo": init(2 * H, TAGS), "bo": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
    for x in ("fx", "bx"):
        model[x][:, H:2 * H] += 1
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    ids, gold = training_windows(texts, windows, rng)
    steps = 0
    total = epochs * (windows // batch)
    for _ in range(epochs):
        order = rng.permutation(windows)
        for i in range(0, windows - batch + 1, batch):
            x, y = ids[order[i:i + batch]], gold[order[i:i + batch]]
            scores, h, sa, sb = tag_scores(x, model, keep=True)
            ds, dtrans = crf_grads(scores, model["trans"], y)
            ds, dtrans = (ds / batch).astype(np.float32), (dtrans / batch).astype(np.float32)
            dh = ds @ model["wo"].T
            grads = {"wo": np.einsum("tnh,tnk->hk", h, ds), "bo": ds.sum((0, 1)), "trans": dtrans}
            grads["fx"], grads["fh"] = lstm_grads(dh[:, :, :H], x, model["fx"], model["fh"], sa)
            grads["bx"], grads["bh"] = lstm_grads(dh[::-1, :, H:], x[:, ::-1], model["bx"], model["bh"], sb)
            steps += 1
            lr = rate * min(1, steps / 20) * (1 - 0.95 * steps / total)
            for k, g in grads.items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model[k] = (model[k] - lr * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.999**steps)) + 1e-8)).astype(np.float32)
    return model


def decode(windows: np.ndarray, model: dict[str, np.ndarray], at_once: int = 1024):
    """Viterbi tags of each window, and for those with a span each character's probability of being in a span of the kind of its tag (else None)."""
    for i in range(0, len(windows), at_once):
        scores = tag_scores(windows[i:i + at_once], model)[0]
        tags = viterbi(scores, model["trans"])
        some = np.flatnonzero(tags.any(1))
        sure: list[np.ndarray | None] = [None] * len(tags)
        if len(some):
            p = marginals(scores[:, some], model["trans"]).transpose(1, 0, 2)
            kinds = np.concatenate([p[:, :, :1], p[:, :, 1::2] + p[:, :, 2::2]], 2)
            got = np.take_along_axis(kinds, ((tags[some].astype(np.int64) + 1) // 2)[:, :, None], 2)[:, :, 0]
            for n, x in zip(some.tolist(), got, strict=True):
                sure[n] = x
        yield from zip(tags, sure, strict=True)


def tagged_spans(tags: np.ndarray) -> list[Span]:
    """Spans of one window's tags; an inside tag that continues nothing begins a span."""
    out: list[Span] = []
    for i in map(int, np.flatnonzero(tags)):
        kind, begins = (int(tags[i]) - 1) // 2, tags[i] % 2 == 1
        if out and not begins and out[-1][1:] == (i, kind):
            out[-1] = (out[-1][0], i + 1, kind)
        else:
            out.append((i, i + 1, kind))
    return out


def whole_words(text: str, start: int, end: int, kind: int) -> tuple[int, int]:
    """A span with its ends moved to the ends of the words that they cut; of the words before an @ only the last belongs to an address."""
    least, most = start - 40, end + 40
    while start > max(0, least) and (text[start - 1].isalnum() or kind == 0 and text[start - 1] in LOCAL):
        start -= 1
    while end < min(len(text), most) and text[end].isalnum():
        end += 1
    if kind == 0 and "@" in (s := text[start:end]):
        name = s.partition("@")[0].rstrip()
        start += max((i + 1 for i, c in enumerate(name) if c.isspace()), default=0)
    return start, end


def reconcile(found: list[tuple[Span, bool]], base: list[Span], text: str) -> list[Span]:
    """One set of spans from all windows of a text: whole before cut off at a window's edge, then longer, then earlier.

    A span that overlaps a base span, or a better one, or breaks the rules of its kind, goes.
    """
    taken = sorted(base)
    out: list[Span] = []
    for (start, end, kind), cut in sorted(set(found), key=lambda x: (x[1], x[0][0] - x[0][1], x[0])):
        while end > start and text[end - 1] in " .,;:-":
            end -= 1
        while end > start and text[start] in " .,;:-":
            start += 1
        start, end = whole_words(text, start, end, kind)
        if plausible(text[start:end], kind) and not any(s < end and start < e for s, e, _ in taken) and not any(s < end and start < e for s, e, _ in out):
            before, after = text[start - 1:start], text[end:end + 1]
            if not (before.isalnum() or after.isalnum() or cut and (before.strip() or after.strip())):
                out.append((start, end, kind))
    return sorted(out)


def spans_of(texts: list[str], model: dict[str, np.ndarray]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, added spans) of each text.

    Every span of a kind holds a digit or an @, so only windows that hold one are decoded: no other could add a
    span. Windows overlap by half.
    """
    base = [base_spans(t) if ANCHOR.search(t) else [] for t in texts]
    places, windows = [], []
    for n, t in enumerate(texts):
        last = -1
        wanted: set[int] = set()
        for m in ANCHOR.finditer(t):
            k = m.start() // STRIDE
            if k != last:
                wanted.update((max(0, k - 1), k))
                last = k
        if wanted:
            ids = symbols_of(t)
            for k in sorted(wanted):
                w = np.zeros(WIDTH, np.uint8)
                part = ids[k * STRIDE:k * STRIDE + WIDTH]
                w[:len(part)] = part
                places.append((n, k * STRIDE, len(part), k * STRIDE + WIDTH >= len(ids)))
                windows.append(w)
    added: dict[int, list[tuple[Span, bool]]] = {}
    if windows:
        for (n, at, size, last), (tags, sure) in zip(places, decode(np.array(windows), model), strict=True):
            for s, e, kind in tagged_spans(tags[:size]):
                if sure[s:e].mean() < LEAST:
                    continue
                cut = s == 0 and at > 0 or e == size and not last
                added.setdefault(n, []).append(((at + s, at + e, kind), cut))
    return [(b, reconcile(added[n], b, texts[n]) if n in added else []) for n, b in enumerate(base)]


def written(spans: list[Span]) -> str:
    return ",".join(f"{NAMES[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2])))


def sample_texts(docs: DataFrame, doc_id: str, text: str, rows: int, width: int = 2000) -> list[str]:
    """Parts of at most rows documents, of at most width characters each, for the training windows."""
    t = F.coalesce(F.col(text), F.lit(""))
    part = F.substring(t, (F.pmod(F.xxhash64(doc_id), F.greatest(F.length(t) - width, F.lit(1))) + 1).cast("int"), F.lit(width))
    return [r["part"] for r in hash_sample(docs.select(doc_id, part.alias("part")), rows, doc_id).collect()]


def find(docs: DataFrame, sample_rows: int = 300, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, secrets and n_found for every row of docs.

    The counts and base_sha256 (of the spans as written, by start, then kind) are those of the base patterns; spans holds all,
    n_added says how many the network added. secrets holds the spans of keys, tokens and passwords, n_found counts spans and secrets. Places count code points. The network learns from at most
    sample_rows parts of documents (a parameter). A null text counts as empty; repeated rows each keep a row; an
    empty table gives no rows; other columns are ignored.
    """
    model = train(sample_texts(docs, doc_id, text, sample_rows))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(F.col(doc_id).alias("doc_id")).schema
    for c in KINDS:
        schema = schema.add(f"n_{c}", "long")
    schema = schema.add("base_sha256", "string").add("spans", "string").add("n_added", "long").add("secrets", "string").add("n_found", "long")

    def run(batches):
        for batch in batches:
            got = spans_of([x or "" for x in batch.column("text").to_pylist()], shared.value)
            counts = [pa.array([sum(s[2] == k for s in b) for b, _ in got], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in got], pa.string()),
                 pa.array([written(b + [x for x in a if x[2] != SECRET]) for b, a in got], pa.string()), pa.array([sum(x[2] != SECRET for x in a) for _, a in got], pa.int64()),
                 pa.array([written([x for x in a if x[2] == SECRET]) for _, a in got], pa.string()), pa.array([len(b) + len(a) for b, a in got], pa.int64())],
                names=schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), schema)


def _masked(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for s, e, k in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{NAMES[k]}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, sample_rows: int = 300, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every span of personal data in the text replaced by its kind in brackets; null texts stay null."""
    model = train(sample_texts(docs, doc_id, text, sample_rows))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = batch.column(text).to_pylist()
            got = spans_of([x or "" for x in texts], shared.value)
            new = pa.array([t if t is None else _masked(t, b + a) for t, (b, a) in zip(texts, got, strict=True)], pa.string())
            yield batch.set_column(batch.schema.get_field_index(text), text, new)

    return docs.mapInArrow(tidy(run), docs.schema)
