"""Each operator against a plain computation of the same contract."""

import base64
import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidepool.llm import ann, bpe, htmltext, jaccard, langid, packing, pii, quality, queries, suffix_dedup, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, rank int"
LONG = " ".join(f"wort{i % 977} text{i % 31}" for i in range(60_000))
BASE = "the quick brown fox jumps over the lazy dog and runs far away from the old stone bridge near the river bank today"
ODD = [
    (1, None, "en", "a", 0, 1, 1), (2, "", None, "a", 0, 1, 1), (3, BASE, "en", "a", 0, 1, 1), (4, BASE, "en", "b", 0, None, None),
    (4, BASE, "en", "b", 0, None, None), (5, BASE + " end", "en", None, None, 1, 1), (6, LONG, "de", "a", 0, 1, 1), (7, "mail a.b@c.org or +1 (555) 010-9999, 10.0.0.300 10.0.0.30", "en", "a", 0, 1, 1),
    (8, "!!! 123 \n\n", None, "a", 0, 1, 1), (9, "card 4111 1111 1111 1111 x@y@z.co", "fr", "a", 0, 1, 1), (10, "día 日本語 " * 40, "es", "a", 0, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def removed(rows, length=50):
    starts = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            w = raw[i:i + length]
            if w not in starts or d < starts[w]:
                starts[w] = d
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if starts[raw[i:i + length]] < d:
                gone[i:i + length] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((d, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def shingles(text, n=5):
    words = ["".join(c.lower() if len(c.lower()) == 1 else c for c in w) for w in re.findall(r"[^\W_]+", text or "")]
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) or (frozenset([tuple(words)]) if words else frozenset())


def near_classes(rows, threshold=0.8):
    sets = defaultdict(list)
    for d, t in dict(rows).items():
        sets[shingles(t) or ("none", d)].append(d)
    keys = sorted(sets, key=lambda k: min(sets[k]))
    root, links = list(range(len(keys))), [0] * len(keys)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(keys):
        for j in range(i):
            b = keys[j]
            if isinstance(a, frozenset) and isinstance(b, frozenset) and (c := len(a & b)) and c >= threshold * (len(a) + len(b) - c) - 1e-9:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {d: (min(sets[keys[find(i)]]), min(sets[k]), links[i]) for i, k in enumerate(keys) for d in sets[k]}


def base_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_suffix_dedup(docs, odd):
    for df in (docs, odd):
        got = sorted(tuple(r) for r in suffix_dedup.remove(df).collect())
        assert got == removed(rows_of(df))


def test_suffix_dedup_of_long_texts(spark):
    """Texts beyond the size of a part, passages across their borders, bytes 0, repeats within a document alone, and the order of rows."""
    rng = np.random.default_rng(2)
    text = lambda n: "".join(map(chr, rng.choice([0, 9, 32, 65, 66, 97, 98, 99, 233, 26085], n)))
    assert suffix_dedup.PART_BYTES < 1_500_000
    long, passage = text(700_000), text(49)
    rows = [(5, long), (2, "x" + long[100:300] + "y" + passage), (9, passage + "z"), (7, long[-600_000:] + "q" * 3000), (8, "q" * 100), (1, "q" * 49), (3, None), (None, long[:200]), (6, passage + passage)]
    for _ in range(2):
        rows = [rows[i] for i in rng.permutation(len(rows))]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted((tuple(r) for r in suffix_dedup.remove(df).collect() if r["doc_id"] is not None))
        assert got == removed([r for r in rows if r[0] is not None])
    with pytest.raises(ValueError):
        suffix_dedup.remove(df.withColumn("n_bytes", F.lit(1)), carry=("n_bytes",))


def test_near_duplicates(docs, odd):
    for df in (docs, odd):
        got = {r["doc_id"]: (r["class_id"], r["same_id"], r["n_links"]) for r in jaccard.join(df).collect()}
        assert got == near_classes(rows_of(df))


def chosen(rows):
    """Of each id the text whose set has the smallest name: the operator's rule for repeated ids."""
    best = {}
    for d, t in rows:
        (s,) = jaccard.shingle_sets([t or ""], 5)
        if len(s):
            best[d] = min(best.get(d, ("g",)), (jaccard.set_name(s.tobytes()), t))
        best.setdefault(d, ("g", None))
    return [(d, t) for d, (_, t) in best.items()]


def test_near_duplicates_of_repeated_ids(spark):
    """Ids with several texts, in every order of the rows; links of sets in one component with very different sizes; several thresholds."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(500)]
    a, b = (" ".join(rng.choice(words, 60)) for _ in range(2))
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (None, a), (4, None), (4, a + " other end")]
    want = near_classes(chosen([r for r in rows if r[0]]))
    for _ in range(3):
        rng.shuffle(rows)
        df = spark.createDataFrame([tuple(None if x is None else x for x in (None if r[0] is None else int(r[0]), r[1])) for r in rows], "doc_id long, text string").repartition(3)
        assert {r["doc_id"]: (r["class_id"], r["same_id"], r["n_links"]) for r in jaccard.join(df).collect()} == want


def test_chain_of_near_copies(spark):
    """1,000 texts, each near the next few only: one class, exact links, and recall at several thresholds."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in rng.integers(0, 100_000, 2200)]
    rows = [(i, " ".join(words[2 * i:2 * i + 60 + i // 8])) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [shingles(t) for _, t in rows]
    for threshold in (0.6, 0.8, 0.9):
        want = near_classes(rows, threshold)
        got = {r["doc_id"]: (r["class_id"], r["same_id"], r["n_links"]) for r in jaccard.join(df, threshold=threshold).collect()}
        assert sum(got[d][2] for d in got) >= 0.999 * sum(want[d][2] for d in want)
        assert got == want
    assert len(sets) == 1000
    with pytest.raises(ValueError):
        jaccard.join(df, threshold=0.2)


def test_bpe_round_trip(docs, odd):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (docs, odd):
        want = []
        for d, t in rows_of(df):
            ids = enc.encode_ordinary(t or "")
            want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        assert sorted(tuple(r) for r in bpe.round_trip(df).collect()) == sorted(want)


def test_packing(docs, odd):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for df in (docs, odd):
        want = []
        for d, t in rows_of(df):
            ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
            for p, s in enumerate(range(0, len(ids), 4096)):
                part = np.array(ids[s:s + 4096], "<u4")
                want.append((d, p, s, len(part), zlib.crc32(part.tobytes())))
        got = packing.pack(df).collect()
        assert sorted(tuple(r)[:5] for r in got) == sorted(want)
        by = defaultdict(list)
        for r in got:
            by[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in by.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 4096
        assert len(by) <= -(-sum(w[3] for w in want) // 4096) * 1.02 + 2


def test_personal_data(docs, odd):
    for df in (docs, odd):
        got = sorted((r["doc_id"], r["base_sha256"]) for r in pii.find(df).collect())
        assert got == sorted((d, hashlib.sha256(base_spans(t or "").encode()).hexdigest()) for d, t in rows_of(df))
    masked = {r["doc_id"]: r["text"] for r in pii.mask(odd).collect()}
    assert masked[1] is None and "[email]" in masked[7] and "[ip]" in masked[7] and "[card]" in masked[9]


def test_personal_data_beyond_the_patterns():
    """Planted entities that no base pattern finds, in texts of another part of the corpus: recall, precision, and nothing in clean texts."""
    learn, other = ([r[0] for r in duckdb.sql(f"SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL AND doc_id % 2 = {k} ORDER BY doc_id").fetchall()] for k in (0, 1))
    model = pii.train([t[:2000] for t in learn[:300]])
    rng = np.random.default_rng(99)
    docs, gold = [], []
    for t in other * 2:
        t = re.sub(r"[0-9@]", "", t)[:1500]
        spots = [m.end() for m in re.finditer(r"\s", t)]
        if spots:
            (s, kind), p = pii.generated(rng), spots[rng.integers(len(spots))]
            docs.append(f"{t[:p]}{s} {t[p:]}")
            gold.append((p, p + len(s), kind))
    hit, wrong, added = {k: [] for k in range(5)}, 0, 0
    for (base, new), g in zip(pii.spans_of(docs, model), gold, strict=True):
        added, wrong = added + len(new), wrong + sum(x != g for x in new)
        if g[2] >= 0 and not any(s < g[1] and g[0] < e for s, e, _ in base):
            hit[g[2]].append(g in new)
    assert all(len(x) >= 30 and np.mean(x) >= 0.9 for x in hit.values()), {k: (len(x), np.mean(x)) for k, x in hit.items()}
    assert wrong <= 0.03 * added
    clean = [re.sub(r"[0-9@]", "", t) for t in other]
    assert not any(a or b for a, b in pii.spans_of(clean, model))


def test_personal_data_columns(spark, odd):
    """Counts and spans say the same; added spans overlap no base span."""
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for r in pii.find(odd).collect():
        base = [x for x in base_spans(texts[r["doc_id"]]).split(",") if x]
        spans = [x for x in r["spans"].split(",") if x]
        assert set(base) <= set(spans) and len(spans) == len(base) + r["n_added"]
        assert spans == sorted(spans, key=lambda x: (int(x.split(":")[1]), pii.KINDS.index(x.split(":")[0])))
        assert r["n_found"] == len(spans) + len([x for x in r["secrets"].split(",") if x])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x.startswith(k) for x in base) for k in pii.KINDS]


def test_language(docs, odd):
    rows = langid.detect(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.detect(odd).collect()}
    assert got[1] == got[2] == got[8] == "und" and got[3] == "en"


JUNK = [
    (-1, "Съешь же ещё этих мягких французских булок да выпей чаю " * 5), (-2, "吾輩は猫である。名前はまだ無い。どこで生れたか " * 6), (-3, "xqzk vwpt kkjh zzrtl qqw mnbv xcvzl " * 30),
    (-4, " ".join("".join(chr(97 + x) for x in np.random.default_rng(i).integers(0, 26, 2 + i % 7)) for i in range(300))), (-5, None), (-6, "123 !!!")]


def test_language_stage(spark, docs):
    """Texts in unknown languages and letters that make no words go, all clean documents stay, lang is the model's."""
    hidden = docs.selectExpr("doc_id", "text", "if(crc32(cast(doc_id AS string)) % 5 = 0, 'zz', lang) AS lang", "source", "n_chars", "1 AS __extra")
    rows = hidden.union(spark.createDataFrame([(i, t, None, "junk", 0, 2) for i, t in JUNK], hidden.schema))
    kept = langid.keep_known(rows.union(rows.where("doc_id = 7")))
    assert kept.columns == rows.columns
    got = kept.collect()
    want = {r["doc_id"]: r["lang"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert {r["doc_id"] for r in got} == set(want)
    assert sum(r["doc_id"] == 7 for r in got) == 2
    assert sum(want[r["doc_id"]] == r["lang"] for r in got) >= 0.97 * len(got)
    assert langid.keep_known(rows.limit(0)).count() == 0


def test_language_gradient():
    """Word and pairwise marginals against all label sequences of short chains, and of one cut into chunks."""
    rng = np.random.default_rng(1)
    trans = rng.normal(size=(3, 3)).astype(np.float32)
    scores, per_text = rng.normal(size=(9, 3)).astype(np.float32), np.array([5, 0, 1, 3])
    word, pair, at = np.zeros((9, 3)), np.zeros((3, 3)), 0
    for n in per_text.tolist():
        total, w, q = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=n):
            p = np.exp(sum(scores[at + i, x] for i, x in enumerate(path)) + sum(trans[x, y] for x, y in itertools.pairwise(path)))
            total += p
            for i, x in enumerate(path):
                w[i, x] += p
            for x, y in itertools.pairwise(path):
                q[x, y] += p
        word[at:at + n] = w / total
        pair += q / total
        at += n
    soft = np.zeros((3, 3), np.float32)
    assert np.allclose(langid.forward_backward(scores, per_text, trans, soft), word, atol=1e-4)
    assert np.allclose(soft, pair, atol=1e-4)
    long = rng.normal(size=(3 * langid.STEP + 7, 3)).astype(np.float32)
    alpha = np.empty((len(long), 3))
    beta = np.ones((len(long), 3))
    alpha[0] = np.exp(long[0])
    for i in range(1, len(long)):
        alpha[i] = alpha[i - 1] / alpha[i - 1].sum() @ np.exp(trans) * np.exp(long[i])
    for i in range(len(long) - 2, -1, -1):
        beta[i] = np.exp(trans) @ (np.exp(long[i + 1]) * beta[i + 1] / beta[i + 1].sum())
    want = alpha * beta / (alpha * beta).sum(1, keepdims=True)
    assert np.allclose(langid.forward_backward(long, np.array([len(long)]), trans), want, atol=1e-3)


def test_quality(spark, odd):
    big = "/root/testdata/sf0.01"
    d, lab = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(d, lab).join(lab, "doc_id").where("held_out AND quality IS NOT NULL").collect()
    pos, neg = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert auc >= 0.9
    assert quality.score(odd, lab.limit(0)).count() == len(ODD)


def vectors(spark, data):
    return spark.read.parquet(f"{data}/embeddings.parquet")


def best(ids, x, q, k, score=None):
    s = x @ x[q]
    order = [i for i in np.lexsort((ids, -s)) if i != q][:k]
    return [(int(ids[q]), r + 1, int(ids[i]), s[i]) for r, i in enumerate(order)]


def test_vector_search(spark, data):
    df = vectors(spark, data)
    rows = sorted((r["vec_id"], r["embedding"]) for r in df.collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    want = [w for q in range(len(ids)) if ids[q] % 100 == 0 for w in best(ids, np.floor(x * 1024), q, 10)]
    got = sorted(tuple(r) for r in topk.exact_top_k(df, data_block=100, query_block=3).collect())
    assert got == [(a, b, c, int(s)) for a, b, c, s in sorted(want)]
    want = {w[:3] for q in range(len(ids)) if ids[q] % 20 == 0 for w in best(ids, x, q, 20)}
    assert {tuple(r)[:3] for r in ann.nearest(df).collect()} == want
    bad = spark.createDataFrame([(0, [1.0, 2.0]), (100, [None, 1.0]), (200, None), (300, [float("nan"), 1.0]), (20, [0.0, 0.0]), (40, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.exact_top_k(bad).orderBy("rank").collect()] == [(0, 1, 40, 5 * 1024 * 1024), (0, 2, 20, 0)]
    assert sorted(tuple(r)[:3] for r in ann.nearest(bad).collect()) == [(0, 1, 40), (40, 1, 0)]


def test_top_k_prunes(spark):
    """Clusters far apart: few pairs are scored within blocks, blocks that can't win are never shipped, and ties at the kth place go to smaller ids."""
    rng = np.random.default_rng(6)
    centres = np.sign(rng.normal(size=(20, 32))) * rng.uniform(2, 3, (20, 1))
    x = np.repeat(centres, 100, 0) + 0.02 * rng.normal(size=(2000, 32))
    x[500:600] = x[500]  # ties
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] * 2, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.exact_top_k(df, data_block=100, query_block=50).collect())
    scaled = np.floor(x * 1024)
    want = []
    for q in np.flatnonzero(ids % 100 == 0):
        s = scaled @ scaled[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:10]
        want += [(int(ids[q]), r + 1, int(ids[i]), int(s[i])) for r, i in enumerate(order)]
    assert got == sorted(want)
    visited: list[int] = []
    topk.dual_tree(ids[::10], scaled[::10], ids, scaled, 10, visited=visited)
    assert sum(visited) < 0.2 * len(x) * len(x[::10])
    dealt, known = topk.cells_of(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, scaled, strict=True)], "vec_id long, vec array<double>"), 150)
    blocks = dealt.groupBy("cell").agg(F.lit(0).alias("salt"), F.max("away").alias("radius"))
    norm = {c: float(v[0] @ v[0]) for c, v in known.items()}
    least = spark.createDataFrame([(c, 0.98 * n) for c, n in norm.items()], "cell int, least double")
    assert topk.block_pairs(blocks.join(least, "cell"), known, 10_000).count() < 0.3 * len(known) ** 2


def test_html_text(spark):
    page = "<html><body><nav><a href='/'>Home</a></nav><article><h1>Title &amp; more</h1><p>First  long paragraph of the text, with words.</p><p>Second <b>part</b> of it follows here.</p></article><div class='comments'><p>Nice post!</p></div><footer>Copyright</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page, 1), (2, "u", None, 2), (3, None, "", 3)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in htmltext.extract(df).collect()}
    text = "Title & more\nFirst long paragraph of the text, with words.\nSecond part of it follows here."
    assert got == {1: (text, len(text)), 2: ("", 0), 3: ("", 0)}


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vec = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for df in (pii.find(none), langid.detect(none), packing.pack(none), quality.score(none, lab), jaccard.join(none), suffix_dedup.remove(none), bpe.round_trip(none), topk.exact_top_k(vec), ann.nearest(vec)):
        assert df.count() == 0
    assert set(queries.QUERIES) >= set(queries.ORACLE_SQL)
