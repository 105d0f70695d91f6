"""What the findings of round 4 ask for: work of retrieval that stops early, film pages in two shuffles, counts of many stories at once."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest

from tidepool.operators import retrieval


def made(seed, stories=90, titles=160, words=16, several=False):
    """Stories (some in two rows, one null, one empty) and titles of words, some equal; with several, films of two titles."""
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(words)]
    told = [(i % (stories - 5), sorted(set(rng.choices(names, k=rng.randint(0, 9))))) for i in range(stories)] + [(900, None), (901, []), (902, ["other"])]
    cat = [(i % (titles * 2 // 3) if several else i, i // (titles * 2 // 3) if several else 0, rng.sample(names, k=rng.randint(0, 5)), "") for i in range(titles)]
    return told, cat


def frames(spark, told, cat):
    return spark.createDataFrame(told, "story_id long, tokens array<string>"), spark.createDataFrame(cat, "film_id long, title_no long, tokens array<string>, fold string")


@pytest.mark.parametrize("several", [False, True])
def test_tallies_that_end_at_most_are_the_least_of_both(spark, several):
    """stories that hold all of so many titles are told without scoring the others; the others are counted in full."""
    terms, cat = frames(spark, *made(3, several=several))
    exact = retrieval.tallies(terms, cat, [0.5, 0.75, 1.0])
    rows = sorted(map(tuple, exact.select("story_id", "threshold", "n").collect()))
    for most, small in ((3, 0), (3, 120), (1, 10**6), (10**6, 10**6)):
        got = retrieval.tallies(terms, cat, [0.5, 0.75, 1.0], most=most, small=small).select("story_id", "threshold", "n")
        assert sorted(map(tuple, got.collect())) == [(a, b, min(n, most)) for a, b, n in rows]
    tally = retrieval.tallies(terms, cat, [0.5], most=4)
    told = retrieval.per_story_of(tally, terms.select("story_id").distinct(), 3)
    full = retrieval.per_story(terms.select("story_id").distinct(), retrieval.best_films(terms, cat, 0.5, 3), 3)
    assert sorted(told.collect()) == sorted(full.select("story_id", "offered", "saturated").collect()) and told.where("saturated").count() > 10


def test_sets_held_whole_are_found_by_their_rarest_token():
    told, cat = made(4)
    keys = [retrieval.SEAM.join(sorted(t)) for _, _, t, _ in cat if t]
    index = retrieval.TitleIndex(pa.table({"film": pa.array(range(len(keys)), pa.int64()), "key": keys}))
    words, sets = index.words.to_pylist(), [set(k.split(retrieval.SEAM)) for k in dict.fromkeys(keys)]
    for _, tokens in told:
        own = np.array([words.index(t) for t in tokens or [] if t in words], np.int64)
        assert sorted(index.contained(own)) == [i for i, s in enumerate(sets) if s <= set(tokens or [])]
        assert not index.present.any()


def test_stories_in_one_row_each_are_not_gathered(spark):
    """Rows of a story are put together only where a key repeats."""
    told, cat = made(5)
    terms, titles = frames(spark, told, cat)
    once = terms.dropDuplicates(["story_id"])
    plan = lambda t: retrieval.tallies(t, titles, [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan(terms) and "collect_list" not in plan(once)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.75, 1.0, 1.5])
def test_many_stories_are_counted_at_once(threshold):
    """counts as bits of words are those of each story by itself: sets with many films, more stories than a word has bits, chunks of any size."""
    told, cat = made(6, stories=400, titles=700, words=12)
    keys = [retrieval.SEAM.join(sorted(t)) for _, _, t, _ in cat if t]
    index = retrieval.TitleIndex(pa.table({"film": pa.array(range(len(keys)), pa.int64()), "key": keys}))
    words = {w: i for i, w in enumerate(index.words.to_pylist())}
    stories = [np.array(sorted(words[t] for t in tokens or [] if t in words), np.int64) for _, tokens in told]
    stories = [s for s in stories if len(s)]
    want = []
    for s in stories:
        sets, scores = index.reached(s, threshold)
        want.append(int(index.n_films[sets[scores >= threshold]].sum()))
    assert index.n_films.max() > 2 and len(stories) > 300 and (threshold > 1 or max(want) > 50)
    for together in (1, 63, 64, 130, 4096):
        assert index.count_over(stories, threshold, together).tolist() == want
    need = np.array([next((h for h in range(1, n + 1) if h / n >= threshold), n + 1) for n in range(int(index.size.max()) + 1)])
    assert index._counted(stories, need, words=7, rows=5).tolist() == want
    rng = np.random.default_rng(1)
    for n in (1, 2, 63, 64, 65, 1000):
        bits = rng.integers(0, 2, (n, 128), np.uint8)
        assert retrieval.ones(np.packbits(bits, axis=1, bitorder="little").view(np.uint64)).tolist() == bits.sum(0).tolist()


@pytest.mark.parametrize("several", [False, True])
def test_best_films_of_stories_that_hold_many_titles(spark, several):
    """where cap films' titles are held whole the others are only counted; rows are those of the pairs, in one block and several."""
    terms, cat = frames(spark, *made(7, several=several))
    scores = retrieval.token_scores(terms, cat, least=0.5)
    for cap in (2, 5):
        want = sorted(retrieval.cut(scores.where("score >= 0.5"), 0.5, cap).select("story_id", "film_id", "score", "n_over", "rank").collect())
        for small in (120, 10**6):
            assert sorted(retrieval.best_films(terms, cat, 0.5, cap, small=small).select("story_id", "film_id", "score", "n_over", "rank").collect()) == want


def test_film_pages_read_lines_three_times_and_shuffle_them_by_film_once(spark, data):
    """the lines go by order twice, with few columns, and once by film; their collections aren't shuffled apart."""
    from tidepool.plans.registry import QUERIES

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["film_pages"](spark, data)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(event_id") == 2 and plan.count("/lineitem.parquet") == 3
    assert plan.count("Exchange hashpartitioning(film_id") == 3  # the rows once, films on both sides of them


def test_film_page_from_tables_of_their_own(spark):
    """Every collection with its order, cuts and nulls; a film without anything has empty ones."""
    from tidepool.operators import feeds

    day = lambda d: dt.datetime(2024, 1, d)
    films = spark.createDataFrame([(1, "Main", "Orig", "Released", ["DE"], 7), (2, "Bare", None, "Released", None, None)], "film_id int, title string, original_title string, status string, origin array<string>, collection_id int")
    events = [("a", 1, "release_date", "US", day(3)), ("b", 1, "casting", "FR", day(2)), ("c", 1, "other", None, day(1)), ("d", 1, "release_date", "FR", day(1)), ("e", 1, "release_date", "DE", day(3)), ("f", 1, "casting", None, None), ("g", 1, "casting", None, day(9))]
    events = spark.createDataFrame(events, "event_id string, film_id int, event_type string, region string, created_at timestamp").selectExpr("*", "'confirmed' AS confidence", "'story' AS provenance")
    summaries = spark.createDataFrame([(e, e.upper(), day(5) if e == "b" else None) for e in "abcdef"], "event_id string, summary string, edited_at timestamp")
    members = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 4), ("a", 5), ("b", 2)], "event_id string, story_id int")
    stories = spark.createDataFrame([(1, "The X", "u1", day(1)), (2, "x", "u2", day(2)), (3, "y", "u3", None), (4, "z", "u4", day(1)), (5, "w", "u5", day(1))], "story_id int, outlet string, url string, published_at timestamp").selectExpr("*", "'h' AS headline")
    releases = spark.createDataFrame([(1, "US", 3, day(2)), (1, "FR", 3, day(1)), (1, "DE", 2, day(2)), (1, "US", 4, day(1)), (1, "US", 2, None)], "film_id int, iso_3166_1 string, release_type int, release_date timestamp").selectExpr("*", "'c' AS certification")
    genres = spark.createDataFrame([(1, 1, "b"), (1, 2, "a"), (1, 1, "b")], "film_id int, id int, name string")
    titles = spark.createDataFrame([(1, t) for t in ["MAIN", "orig", "Ab", "AB", None, "z", *"klmnopqr"]], "film_id int, title string")
    credits = [(1, "p", "cast", "x", None, None, None), (1, "q", "cast", "y", None, None, 2), (1, "q", "cast", None, None, None, 2), (1, "n", "crew", None, "j", "Sound", None), (1, "m", "crew", None, "j", "Directing", None), (1, "o", "crew", None, "i", "Directing", None), (1, "?", None, None, None, None, None)]
    credits = spark.createDataFrame(credits, "film_id int, name string, credit_type string, character string, job string, department string, credit_order int")
    collections = spark.createDataFrame([(7, "C", None)], "collection_id int, name string, poster_path string")
    page = feeds.film_page(films, events=events, summaries=summaries, members=members, stories=stories, releases=releases, genres=genres, companies=genres.limit(0), collections=collections, titles=titles, credits=credits, billed=2)
    one, bare = page.orderBy("film_id").collect()
    assert [(e.event_id, e.summary_edited, [x.url for x in e.sources]) for e in one.events] == [("f", False, []), ("b", True, ["u2"]), ("a", False, ["u2", "u4", "u5"]), ("e", False, [])]
    assert [(r.date and r.date.day, r.country, r.type_label) for r in one.release_dates] == [(None, "US", "Limited"), (2, "DE", "Limited"), (2, "US", "Wide")]
    assert [g.name for g in one.genres] == ["a", "b"] and one.production_companies == [] and one.collection.name == "C"
    assert [t.title for t in one.alternative_titles] == ["AB", *"klmnopq"]
    assert [tuple(c) for c in one.cast] == [("q", "y"), ("q", None)] and [c.name for c in one.crew] == ["o", "m", "n"]
    assert bare.collection is None and all(bare[c] == [] for c in ("events", "release_dates", "genres", "production_companies", "alternative_titles", "cast", "crew"))
