"""What the findings of round 3 asked for."""

import random

import pyarrow as pa

from tidepool.llm import langid, packing


def test_words_are_encoded_once_whatever_their_case_and_marks():
    e = packing.Encoder(packing.default_tokenizer())
    assert e.by_word
    e.forget()
    text = "Straße STRASSE straße, Straße!! the The THE the,"
    assert e.encode(pa.array([text])) == e.whole([text])
    assert sorted(filter(None, e.words.to_pylist())) == ["!!", ",", "strasse", "straße", "the"]


def test_ids_are_those_of_whole_texts():
    rng = random.Random(5)
    letters = list("abcXYZéÉßÿÀİΣςµªº'.,!?-_*&# \t\n\r\x0b\x1c\x1f\x85\xa0᠎ 　̧́​﻿01٣日本語ﬁ\U0001f600stmdrevl")
    bits = ["<|endoftext|>", "'s", "'re", "don't", "l'arbre", "ÉCOLE,", "STRASSE!!", "é", " "]
    texts = ["".join(rng.choice(letters if rng.random() < 0.8 else bits) for _ in range(rng.randrange(60))) for _ in range(5000)]
    texts += ["a" + chr(i) + "B" for i in range(0x2100)]
    e = packing.Encoder(packing.default_tokenizer())
    for i in range(0, len(texts), 997):
        assert e.encode(pa.array(texts[i:i + 997])) == e.whole(texts[i:i + 997])
    assert e.encode(pa.array(["left out", *texts[:9]]).slice(1)) == e.whole(texts[:9])


def test_languages_are_learned_from_whole_texts(spark):
    """What tells the languages apart stands in the last quarter of each text; the rest is the same."""
    rng = random.Random(3)
    words = {"aa": ["mirolo", "tapene", "sulavi", "borane"], "bb": ["krusht", "zwelgn", "phlomp", "dwirst"]}
    filler = ["of", "and", "the", "with", "from"]
    text = lambda lang: " ".join([*rng.choices(filler, k=900), *rng.choices(words[lang], k=120)])
    rows = [(i, text(lang), lang) for i, lang in enumerate(["aa", "bb"] * 40)]
    rows += [(1000 + i, " ".join(rng.choices(words[lang], k=12)), None) for i, lang in enumerate(["aa", "bb"] * 5)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.detect(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[1000 + i] for i in range(10)] == ["aa", "bb"] * 5
    for t in [r[1] for r in rows] + ["", "x" * 1000, "日本" * 700 + "\n a", " \n" * 500]:
        assert "".join(langid.WINDOW.findall(t)) == t


def test_features_are_known_whatever_the_size(spark):
    """The bar's features are those met often, not all that were ever met: more of the same changes little."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bdfklmnrst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    shares = []
    for n in (60, 600):
        rows = [(i, " ".join(word() for _ in range(300)), "aa") for i in range(n)]
        shares.append(langid.learned(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ["aa"])[2].mean())
    assert 0 < shares[1] < 1.2 * shares[0] < 0.5
