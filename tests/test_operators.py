"""Operators that SQL can't express, and the edges of those it can, on small tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidepool.functions import predicates as P
from tidepool.functions import text as X
from tidepool.functions import values as V
from tidepool.operators import cards, changes, decisions, feeds, metrics, retrieval, runs
from tidepool.sources import readers, sinks
from tidepool.sources.keyed_table import KeyedTable
from tidepool.streaming import streams

D, TS = dt.date, dt.datetime


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (0,)], schema).select(column.alias("y")).first()["y"]


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


TEXT = [
    (lambda: X.significant_tokens(X.lower_nfc(F.col("t"))), "The War of the Worlds, war", ["war", "worlds", "war"]),
    (lambda: X.squash_fold(X.lower_nfc(F.col("t"))), "Amélie_2!", "amélie2"),
    (lambda: X.search_fold(F.col("t")), "Spider-Man: Ñandú", "spidermannandu"),
    (lambda: X.collapse_initialisms(F.col("t")), "u.s.a. and s/f or a.b.c", "usa and s/f or abc"),
    (lambda: X.outlet_key(F.col("t")), "  The  Daily   News ", "daily news"),
    (lambda: X.name_key(F.col("t")), " Zoë  STRAẞE ", "zoë strasse"),
    (lambda: X.slugify(F.col("t")), "Amélie: Part 2!", "amelie-part-2"),
    (lambda: X.leading_id(F.col("t")), "123-some-film", 123),
    (lambda: X.leading_id(F.col("t")), "abc", None),
    (lambda: X.registrable_domain(F.col("t")), "https://www.news.bbc.co.uk:80/a?b", "bbc.co.uk"),
    (lambda: X.article_id(F.col("t")), "https://a.b/c/XYZ?o=1", "XYZ"),
    (lambda: X.is_redirect(F.col("t"), ("news.example.com",), "/articles/"), "https://news.example.com/rss/articles/1", True),
    (lambda: X.outlet_suffix(F.col("t")), "A - B - The Times", "The Times"),
    (lambda: X.headline(F.col("t")), "A - B - The Times", "A - B"),
    (lambda: X.json_span(F.col("t")), 'Sure: {"a": {"b": 1}} ok', '{"a": {"b": 1}}'),
    (lambda: X.recovered_summary(F.col("t")), '{"summary": "Two\nlines  here"', "Two lines here"),
    (lambda: X.recovered_summary(F.col("t")), '{"summary": "Two\nlines  here"}', "Two lines here"),
    (lambda: X.redact_url(F.col("t")), "https://a/b?api_key=SECRET&q=1", "https://a/b?api_key=REDACTED&q=1"),
    (lambda: X.xml_escape(F.col("t")), "a<b>&c", "a&lt;b&gt;&amp;c"),
    (lambda: X.html_attribute(F.col("t"), "data-id"), '<c data-id="7" data-id="8">', "7"),
    (lambda: V.iso_date(F.col("t")), "2024-2-3", None),
    (lambda: V.iso_date(F.col("t")), "20240203", D(2024, 2, 3)),
    (lambda: V.long_date(F.to_date("t")), "2026-08-14", "14 August 2026"),
    (lambda: V.token_estimate(F.col("t")), "abcdefghij", 2),
    (lambda: V.json_text(F.col("t"), "summary"), "[1]", ""),
    (lambda: V.json_int(F.col("t"), "n"), '{"n": 3}', 3),
    (lambda: V.json_int(F.col("t"), "n"), '{"n": true}', None),
    (lambda: V.json_int(F.col("t"), "n"), '{"n": "3"}', None),
    (lambda: V.arc_stage(F.col("t")), "Unknown", "announced"),
    (lambda: V.event_rank(F.col("t")), "other", -1),
]


@pytest.mark.parametrize("column,value,want", TEXT)
def test_scalars(spark, column, value, want):
    assert one(spark, column(), t=value) == want


def test_values(spark):
    assert one(spark, X.prose_list(F.col("a")), a=["A", "B", "C"]) == "A, B and C"
    assert one(spark, X.prose_list(F.col("a")), a=["A"]) == "A"
    assert one(spark, V.overlap_ratio(F.col("a"), F.col("b")), a=["x", "x", "y"], b=["x"]) == 0.5
    assert one(spark, P.title_hit(F.col("a"), F.col("b"), 0.6), a=["x", "x", "y"], b=["x"]) is True
    assert one(spark, V.overlaps(F.col("a"), F.col("b")), a=["x", None], b=["z"]) is False
    assert one(spark, V.item_at(F.col("a"), F.col("n")), a=["x"], n=2) is None
    assert one(spark, V.backoff_seconds(F.col("n"), 1.0, 10.0), n=6) == 10.0
    assert one(spark, V.joined_in_order(F.col("a"), V.ROLE_ORDER), a=["cast", "director"]) == "director|cast"
    assert P.too_short("-a!") and not P.too_short("ab")


def test_predicates_keep_nulls(spark):
    df = spark.createDataFrame([(1, None, None), (2, D(2024, 1, 1), None), (3, None, "Released"), (4, D(2024, 3, 1), "Planned")], "i long, d date, s string")
    assert rows(df.where(P.in_play(F.col("d"), F.col("s"), D(2024, 2, 1))).select("i"), "i") == [(1,), (4,)]
    assert rows(df.select(P.skip_reason(F.col("s"), F.lit(10))).distinct()) != []
    assert rows(df.where(P.stale_stage(F.lit("casting"), F.col("s"), F.col("d"), D(2024, 2, 1))).select("i"), "i") == [(2,), (3,)]


def test_diffs_follow_the_baseline_rule(spark):
    schema = "film_id long, person long, job string"
    old = spark.createDataFrame([(1, 10, None), (1, 11, "Writer")], schema)
    new = spark.createDataFrame([(1, 10, None), (1, 12, "Writer"), (2, 20, None), (3, 30, None)], schema)
    seen = spark.createDataFrame([(1,), (3,)], "film_id long")  # 3 was seen empty, 2 never
    got = changes.set_changes(old.na.fill(""), new.na.fill(""), seen, "film_id", ["film_id", "person", "job"])
    assert rows(got.select("film_id", "person", "change"), "film_id", "person") == [(1, 11, "removed"), (1, 12, "added"), (3, 30, "added")]
    assert changes.set_changes(new, new, seen, "film_id", ["film_id", "person"]).count() == 0


def test_upserts_are_idempotent(spark):
    stored = spark.createDataFrame([(1, "a", 1)], "k long, v string, seq long")
    batch = spark.createDataFrame([(1, "b", 0), (2, "c", 1), (2, "d", 2)], "k long, v string, seq long")
    once = changes.upsert_last_wins(stored, batch, ["k"], "seq")
    assert rows(once.select("k", "v"), "k") == [(1, "b"), (2, "d")]
    assert rows(changes.upsert_last_wins(once, batch, ["k"], "seq").select("k", "v"), "k") == [(1, "b"), (2, "d")]
    assert rows(changes.insert_ignore(stored, batch, ["k"], [F.asc("seq")]).select("k", "v")) == [(2, "c")]
    assert rows(changes.rebuild_children(batch, stored, stored, "k").select("k", "v"), "k", "v") == [(1, "a"), (2, "c"), (2, "d")]


def test_retrieval_scores_and_rescue(spark):
    films = spark.createDataFrame([(1, "The War of the Worlds"), (2, "Spider-Man"), (3, "The Of"), (4, "Dune")], "film_id long, title string")
    stories = spark.createDataFrame([(7, "Spiderman returns to the worlds", "war begins"), (8, "nothing", None)], "story_id long, headline string, dek string")
    titles, terms = retrieval.searchable_titles(films), retrieval.story_terms(stories)
    got = retrieval.candidates(terms, titles)
    assert rows(got.select("story_id", "film_id", "score", "rank", "n_over"), "rank") == [(7, 1, 1.0, 1, 2), (7, 2, 1.0, 2, 2)]
    tally = retrieval.per_story(stories, got)
    h = retrieval.health(tally).first()
    assert (h["n"], h["zero"], h["offered"], h["hard_breach"]) == (2, 1, 2, False)
    assert retrieval.health(tally.limit(0)).first()["zero_rate"] is None
    labels = spark.createDataFrame([(7, 2), (7, 4), (8, 9)], "story_id long, film_id long")
    cov = retrieval.coverage(labels, got, retrieval.token_scores(terms, titles), films)
    assert rows(cov.select("film_id", "outcome"), "film_id") == [(2, "retrieved"), (4, "not-indexed"), (9, "not-in-catalog")]
    assert retrieval.recall(cov).first()["recall"] == 0.5


STORIES = [(1, 1, 101, TS(2024, 1, 10), "trusted"), (1, 2, 102, TS(2024, 1, 9), "low"), (1, 3, 103, TS(2024, 1, 8), "low"), (1, 4, 104, TS(2024, 1, 7), "low"), (1, 5, 105, TS(2024, 1, 6), "low")]
EVENTS = [(1, 1, "e1", "trailer", "story", TS(2024, 1, 5), None), (1, 2, "e2", "crew_attached", "catalog", TS(2023, 1, 5), ["ann dee"])]


def clustered(spark, groups, status="Planned", release=None, changed=None):
    stories = spark.createDataFrame(STORIES, "film_id long, n int, story_id long, at timestamp, tier string")
    events = spark.createDataFrame(EVENTS, "film_id long, position int, event_ref string, event_type string, provenance string, occurred_at timestamp, subject_key array<string>")
    films = spark.createDataFrame([(1, status, release, changed, groups if isinstance(groups, str) else "ok " + json.dumps({"events": groups}))], "film_id long, status string, release_date date, changed_at timestamp, reply string")
    return [(r["outcome"], r["event_ref"] or r["note"]) for r in decisions.cluster(stories, events, films, D(2024, 1, 12)).orderBy("group_no").collect()]


def group(kind, stories, **x):
    return {"type": kind, "confidence": "confirmed", "stories": stories} | x


def test_clustering_goes_through_groups_in_order(spark):
    assert clustered(spark, "no reply") == [("unparseable", None)]
    assert clustered(spark, [group("casting", [1], cast=["Bo"]), group("casting", [1]), group("casting", [2], cast=["BO "]), group("casting", [3], cast=["Ann Dee"]), group("wrong", [4]), group("announced", [4])]) == [
        ("create", "new:1:1"), ("superseded", None), ("reject", "casting-recorded"), ("catalog_attach", "e2"), ("invalid", None), ("create", "new:1:6")]
    assert clustered(spark, [group("trailer", [1]), group("first_look", [2]), group("first_look", [3]), group("x", [4], existing=2), group("off_topic", [5])]) == [
        ("dedup_attach", "e1"), ("create", "new:1:2"), ("dedup_attach", "new:1:2"), ("attach", "e2"), ("reject", "off-topic")]
    assert clustered(spark, [group("release_date", [1], claimed_date="2025-01-01"), group("release_date", [2]), group("announced", [3])], "Released") == [("hold", None), ("reject", "release-date-unchanged"), ("reject", "stale-stage:announced")]
    assert clustered(spark, [group("release_date", [1], region="us")], changed=TS(2024, 1, 11)) == [("create", "new:1:1")]


def test_cards(spark):
    log = spark.createDataFrame([(1, "status", "In Production", TS(2024, 1, 2), 1), (1, "status", "In Production", TS(2024, 1, 1), 2), (2, "status", "Post Production", TS(2024, 1, 1), 3), (3, "status", "Released", TS(2024, 1, 1), 4)], "film_id long, field string, new_value string, changed_at timestamp, id long")
    done = spark.createDataFrame([(2, "production_wrap", TS(2020, 1, 1), ["x"])], "film_id long, event_type string, occurred_at timestamp, subject_key array<string>")
    assert rows(cards.status_cards(log, done).select("film_id", "event_type", "id")) == [(1, "production_start", 2)]
    people = spark.createDataFrame([(1, "ann", None), (2, "bo", None), (3, "cy", TS(2024, 1, 1))], "person_id long, name_key string, missing_at timestamp")
    added = spark.createDataFrame([(1, p, "director", "added", TS(2024, 1, 1)) for p in (1, 2, 3)], "film_id long, person_id long, role string, change string, changed_at timestamp")
    said = spark.createDataFrame([(1, "crew_attached", TS(2023, 1, 1), ["bo"])], done.schema)
    got = cards.credit_cards(added, people, said)
    assert rows(got.select("event_type", "names")) == [("crew_attached", ["ann"])]
    again = said.unionByName(got.select("film_id", "event_type", F.col("changed_at").alias("occurred_at"), F.col("names").alias("subject_key")))
    assert cards.credit_cards(added, people, again).count() == 0
    moves = spark.createDataFrame([(1, "FR", 3, TS(2024, 1, 1)), (1, "US", 2, TS(2024, 1, 1)), (1, "DE", 1, TS(2024, 1, 1))], "film_id long, iso_3166_1 string, release_type int, changed_at timestamp")
    assert rows(cards.release_cards(moves).select("region", "subjects")) == [("US", ["FR:wide", "US:limited"])]


def test_runs(spark):
    log = spark.createDataFrame([(1, TS(2024, 1, 1) + dt.timedelta(seconds=s)) for s in (0, 30, 60, 100, 121)], "run long, at timestamp")
    assert [r["at"].second + 60 * r["at"].minute for r in runs.heartbeats(log, "run", "at", 60).collect()] == [0, 60, 121]
    tally = spark.createDataFrame([("a", 0, 1), ("b", 0, 1), ("b", 0, 2), ("a", 1, 5)], "stage string, processed long, failed long")
    kinds = {"a": "lossy", "b": "self_healing"}
    assert sorted(r["total_failure"] for r in runs.stage_failure(tally, kinds).collect()) == [False, False, True, True]


def test_reading(spark):
    films = spark.createDataFrame([(7, "seven"), (8, "7-x")], "film_id long, slug string")
    assert feeds.by_reference(films, "7-x").first()["film_id"] == 8
    assert feeds.by_reference(films, "7-other").first()["film_id"] == 7
    cast = spark.createDataFrame([(7, 2, "b"), (7, 1, "a")], "film_id long, position int, name string")
    got = feeds.detail(films, "film_id", cast=cast).orderBy("film_id").collect()
    assert [[x["name"] for x in r["cast"]] for r in got] == [["a", "b"], []]
    alt = spark.createDataFrame([(1, "Ab"), (1, "AB"), (1, "c"), (1, "main")], "film_id long, t string")
    assert rows(feeds.distinct_casings(alt, "film_id", "t", ["Main"]).select("t"), "t") == [("AB",), ("c",)]


def test_metrics(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, None, "y")], "i long, p string, g string")
    got = metrics.pairwise(df.withColumn("p", metrics.or_own_group("p", "i")), "i", "p", "g").first()
    assert (got["both_pairs"], got["pred_pairs"], got["true_pairs"], got["precision"]) == (1, 1, 3, 1.0)
    assert metrics.pairwise(df.limit(0), "i", "p", "g").first()["precision"] == 1.0
    n = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, n long")
    assert rows(metrics.quotas(n, 4, "k").select("k", "quota"), "k") == [("a", 2), ("b", 1), ("c", 1)]


def test_sources(spark, tmp_path):
    movie = {"id": 1, "title": "A", "release_date": "", "odd": 1, "credits": {"cast": [{"id": 5, "name": "P", "credit_id": "c1", "order": 0}], "crew": [{"id": 6, "name": "Q", "credit_id": "c2", "job": "Director", "department": "Directing"}]},
             "release_dates": {"results": [{"iso_3166_1": "US", "release_dates": [{"type": 3, "release_date": "2024-01-01T00:00:00.000Z"}, {"type": 2, "release_date": ""}]}]}}
    m = readers.movies(spark.createDataFrame([(json.dumps(movie),), ("broken",)], "payload string")).where("id IS NOT NULL")
    assert m.first()["release_date"] is None
    assert rows(readers.movie_credits(m).select("credit_id", "credit_type"), "credit_id") == [("c1", "cast"), ("c2", "crew")]
    assert readers.movie_release_dates(m).count() == 1
    labels = spark.createDataFrame([('{"as_of_date": "2024-01-01", "items": [{"url": "u"}]}',), ('[{"url": "v"}, {"url": "w"}]',)], "value string")
    assert rows(readers.labelled(labels).select("url", "as_of_date"), "url") == [("u", D(2024, 1, 1)), ("v", None), ("w", None)]
    feed = spark.createDataFrame([("s", {"link": "u", "title": "t", "published": "2024-01-01 00:00:00", "x": "1"}), ("s", {"link": "v", "title": "t"}), ("s", {"title": "t"}), ("s", {"link": "w", "title": "t", "updated": "2020-01-01 00:00:00"})], "source string, entry map<string,string>")
    assert rows(readers.feed_entries(feed, TS(2024, 1, 2)).select("url"), "url") == [("u",), ("v",)]
    assert readers.search_sources(spark.createDataFrame([("A b",)], "title string"), "q=").first()["url"] == "q=%22A%20b%22"
    sinks.write_csv(labels, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").columns == ["value"]
    assert sinks.markdown_lines(spark.createDataFrame([("a|b", None)], "x string, y string")).first()["line"] == "| a\\|b |  |"


def test_stream_appends_each_key_once(spark, tmp_path):
    df = spark.createDataFrame([("u", TS(2024, 1, 1)), ("u", TS(2024, 1, 1)), ("v", TS(2024, 1, 2))], "url string, at timestamp")
    table = KeyedTable(spark, f"{tmp_path}/t", ["url"], df.schema, 4)
    write = table.batch_writer(ignore=True)
    write(df, 0)
    write(df, 1)
    assert rows(table.rows().select("url"), "url") == [("u",), ("v",)]
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    assert streams.run_available(streams.first_seen(stream, "url", "at"), f"{tmp_path}/out").count() == 2


def test_scores_by_rare_tokens_are_the_same(spark):
    """The broadcast index, the join by rare tokens alone, and plain counting give the same scores; the rare tokens are fewer."""
    import random

    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.6)) % 60}" for _ in range(4000)]
    stories = [(i, sorted(set(rng.choices(words, k=25)))) for i in range(120)]
    titles = [(i, 0, rng.sample(words, k=rng.randint(1, 8)), "") for i in range(80)]
    want = {}
    for s, tokens in stories:
        for f, _, t, _ in titles:
            share = len(set(t) & set(tokens)) / len(set(t))
            if share >= 0.5:
                want[s, f] = share
    terms = spark.createDataFrame(stories, "story_id long, tokens array<string>")
    cat = spark.createDataFrame(titles, "film_id long, title_no long, tokens array<string>, fold string")
    for small in (0, 10**6):
        assert {(r[0], r[1]): r[2] for r in retrieval.token_scores(terms, cat, least=0.5, small=small).collect()} == want
    index = retrieval.inverted_index(cat)
    probes = retrieval.rare_tokens(index, terms.select("story_id", F.explode("tokens").alias("token")), "film_id", 0.5)
    assert probes.where("probe").count() < 0.8 * index.count()


def test_initialisms(spark):
    cases = [("Warner’s ‘F.A.S.T.’ and S/H/V", ["warner", "fast", "shv"]), ("U.S. box office", ["box", "office"]), ("u.s.army", ["usarmy"]), ("noS.O.S", ["nos"]), ("x.J.R.R. Tolkien", ["xjrr", "tolkien"]), ("A/B", [])]
    for text, want in cases:
        assert one(spark, X.significant_tokens(X.lower_nfc(F.col("t"))), t=text) == want
    assert one(spark, X.lower_nfc(F.col("t")), t="Ame\u0301lie") == "amélie"


def test_feed_times_and_malformed_payloads(spark):
    for text, want in (("Wed, 02 Oct 2024 13:00:00 GMT", TS(2024, 10, 2, 13)), ("2 Oct 2024 13:00:00 +0200", TS(2024, 10, 2, 11)), ("Wed, 02 Oct 2024 13:00 EST", TS(2024, 10, 2, 18)), ("2024-10-02T13:00:00Z", TS(2024, 10, 2, 13)), ("soon", None)):
        assert one(spark, readers.feed_time(F.col("t")), t=text) == want
    payloads = spark.createDataFrame([('{"id": 1, "title": "A"}',), ("not json",), ('{"id": 2',)], "payload string")
    assert [r["id"] for r in readers.movies(payloads).collect()] == [1] and readers.malformed(payloads).count() == 2


def test_atom_and_feed_lists(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<feed><entry><title>T</title><link rel="self" href="x"/><link href="https://a/1"/><updated>2024-01-02T00:00:00Z</updated></entry></feed>')
    assert [(r["title"], r["link"]) for r in readers.atom_entries(spark, f"file://{tmp_path}/a.xml").collect()] == [("T", "https://a/1")]
    assert readers.feed_list(spark, [("A", "a"), ("B", "b")], [("C", "c")], False).count() == 2
    assert [r["name"] for r in readers.feed_list(spark, [("A", "a")], [("C", "c")], True).orderBy("position").collect()] == ["A", "C"]


def test_unknown_stage_is_an_error(spark):
    tally = spark.createDataFrame([("x", 0, 1)], "stage string, processed long, failed long")
    with pytest.raises(Exception, match="unknown stage"):
        runs.stage_failure(tally, {"a": "lossy"}).collect()


def test_rescue_by_automata_and_by_runs_is_the_same(spark):
    """One automaton, several, and the join find what plain containment finds: nested, overlapping and repeated folds, two fields, nulls, folds of several films."""
    import random

    rng = random.Random(7)
    words = ["abcdef", "bcdefg", "abcdefg", "defghi", "cdefgh", "zzzzzz", "zzzzzzz", "ééééoü", "日本日本日本"]
    texts = ["".join(rng.choice([*words, "ab", "cd", "efg", "z", " - "]) for _ in range(rng.randrange(12))) for _ in range(300)]
    stories = spark.createDataFrame([(i, None if i % 50 == 0 else t, None if i % 7 == 0 else texts[-i]) for i, t in enumerate(texts)], "story_id long, headline string, dek string")
    titles = retrieval.searchable_titles(spark.createDataFrame([(i, w) for i, w in enumerate([*words, "abc def", "A-B-C-D-E-F", "abcde", "never there", None])], "film_id long, title string"))
    terms = retrieval.story_terms(stories)
    want = {tuple(r) for r in terms.select("story_id", F.explode("folds").alias("t")).crossJoin(retrieval.rescue_folds(titles)).where(F.contains("t", "fold")).select("story_id", "film_id").collect()}
    assert len(want) > 300 and len({f for _, f in want}) >= len(words)
    for letters, most in ((1000, 16), (9, 16), (9, 1)):
        got = [tuple(r) for r in retrieval.rescued(terms, titles, letters=letters, most=most).collect()]
        assert len(got) == len(want) and set(got) == want
    assert retrieval.rescued(terms, titles.limit(0)).count() == 0


@pytest.mark.parametrize(("url", "domain", "hosted"), [
    ("https://news.bbc.co.uk:80/a?b", "bbc.co.uk", "bbc.co.uk"), ("https://www.mshale.com/a", "mshale.com", "mshale.com"), ("m.mshale.com/amp", "mshale.com", "mshale.com"), ("//a.b.c.com", "c.com", "c.com"),
    ("http://www.ck/x", "www.ck", "www.ck"), ("http://a.www.ck", "www.ck", "www.ck"), ("http://foo.ck", None, None), ("http://bar.foo.ck", "bar.foo.ck", "bar.foo.ck"), ("http://ck", None, None),
    ("http://co.uk/", None, None), ("http://com", None, None), ("https://me.github.io/x", "github.io", "me.github.io"), ("https://github.io", "github.io", None), ("http://a.eu.compute.amazonaws.com", "amazonaws.com", "a.eu.compute.amazonaws.com"),
    ("http://city.kawasaki.jp", "city.kawasaki.jp", "city.kawasaki.jp"), ("http://a.b.kawasaki.jp", "a.b.kawasaki.jp", "a.b.kawasaki.jp"), ("http://b.kawasaki.jp", None, None),
    ("http://127.0.0.1/a", None, None), ("http://[::1]/a", None, None), ("not a url", None, None), (None, None, None), ("", None, None), ("HTTPS://User@WWW.Example.ORG./", "example.org", "example.org"), ("http://x.unlisted", "x.unlisted", "x.unlisted")])
def test_registrable_domains(spark, url, domain, hosted):
    row = spark.createDataFrame([(url,)], "t string").select(X.registrable_domain(F.col("t")).alias("d"), X.registrable_domain(F.col("t"), X.suffix_rules(private=True)).alias("h")).first()
    assert (row["d"], row["h"]) == (domain, hosted)


def test_suffix_rules_of_another_file(spark, tmp_path):
    (tmp_path / "list.txt").write_text("// ===BEGIN ICANN DOMAINS===\n\ncom  // a note\na.b.c.d.e\n// ===END ICANN DOMAINS===\n// ===BEGIN PRIVATE DOMAINS===\nx.com\n// ===END PRIVATE DOMAINS===\n")
    rules = X.suffix_rules(str(tmp_path / "list.txt"))
    assert rules == (frozenset({"com", "a.b.c.d.e"}), frozenset(), frozenset())
    df = spark.createDataFrame([("http://q.z.a.b.c.d.e",), ("http://q.x.com",), ("http://q.net",)], "t string")
    assert [r[0] for r in df.select(X.registrable_domain(F.col("t"), rules, unlisted=False)).collect()] == ["z.a.b.c.d.e", "x.com", None]


def test_waits(spark):
    df = spark.createDataFrame([(1, None), (3, None), (9, None), (1, 0.0), (2, -4.0), (1, 7.0), (1, 900.0)], "n int, own double")
    wait = V.backoff_seconds(F.col("n"), 1.0, 30.0, F.col("own"), 60.0)
    assert [r[0] for r in df.select(wait).collect()] == [1.0, 4.0, 30.0, 1.0, 2.0, 7.0, 60.0]
    spread = V.backoff_seconds(F.col("n"), 1.0, 30.0, F.col("own"), 60.0, 0.5, V.draw_of(F.col("n"), F.col("own")))
    both = df.select(wait.alias("w"), spread.alias("s"), F.col("own")).collect()
    assert all((r["w"] == r["s"]) if (r["own"] or 0) > 0 else r["w"] / 2 < r["s"] <= r["w"] for r in both)
    assert [r[0] for r in df.select(V.backoff_seconds(F.col("n"), 1.0, 30.0, jitter=0.5, draw=F.lit(1.0))).collect()][:2] == [0.5, 2.0]
    with pytest.raises(ValueError, match="draw"):
        V.backoff_seconds(F.col("n"), 1.0, 30.0, jitter=0.5)
    texts = spark.createDataFrame([("7",), (" 2.5 ",), ("0",), ("-3",), ("soon",), ("Mon, 01 Jan 2024 00:02:00 GMT",), ("Sun, 31 Dec 2023 00:00:00 GMT",), ("nan",), (None,)], "t string")
    assert [r[0] for r in texts.select(V.wait_header(F.col("t"), F.lit(TS(2024, 1, 1)))).collect()] == [7.0, 2.5, None, None, None, 120.0, None, None, None]


def test_outlets_are_case_folded(spark):
    df = spark.createDataFrame([("The STRASSE  Post",), ("Straße post",), ("ΟΔΟΣ",), ("οδος",)], "t string")
    a, b, c, d = (r[0] for r in df.select(X.outlet_key(F.col("t"))).collect())
    assert a == b == "strasse post" and c == d


def test_credits_and_people_are_those_seen_first(spark):
    def movie(i, cast, crew):
        return json.dumps({"id": i, "credits": {"cast": cast, "crew": crew}})
    docs = spark.createDataFrame([
        (movie(2, [{"id": 5, "name": "Late", "credit_id": "z", "character": "Second"}, {"id": 5, "name": "Later", "credit_id": "z", "character": "Third"}], [{"id": 6, "name": "Bo", "credit_id": "z", "job": "Writer"}, {"id": 6, "name": "Bo 2", "credit_id": "y", "job": "Director"}]),),
        (movie(1, [{"id": None, "name": "No", "credit_id": "n"}, {"id": 5, "name": "Ann", "credit_id": "x", "character": "First"}], [{"id": 7, "name": "Cy", "credit_id": None}, {"id": 6, "name": "B", "credit_id": "w", "job": "Editor"}]),)], "payload string")
    m = readers.movies(docs)
    got = {r["credit_id"]: (r["film_id"], r["credit_type"], r["character"], r["job"]) for r in readers.movie_credits(m).collect()}
    assert got == {"z": (2, "cast", "Second", None), "x": (1, "cast", "First", None), "y": (2, "crew", None, "Director"), "w": (1, "crew", None, "Editor")}
    assert {r["person_id"]: r["name"] for r in readers.movie_people(m).collect()} == {5: "Late", 6: "Bo", 7: "Cy"}


def test_faults_of_replies(spark):
    texts = ['[]', 'x [{"id": 1}] y', '[{"id": 1}', '[{"id": 1]', 'none', '', None, '{"a": [1]}', '["a"]', '[[1]]', '[null]']
    df = spark.createDataFrame(list(enumerate(texts)), "call_id int, text string")
    assert {r["call_id"]: r["fault"] for r in decisions.reply_faults(df).collect()} == {2: "no-array", 3: "malformed", 4: "no-array", 5: "no-array", 6: "no-array", 7: "not-decisions", 8: "not-decisions", 9: "not-decisions"}


def test_numbers_of_documents_by_their_own_key(spark):
    docs = [('{"k": 7}', 7), ('{"k": "7"}', None), ('{"a": {"k": "x"}, "k": -3}', -3), ('{"k": 7.5}', None), ('{"k": true}', None), ('{"k": 99999999999999999999}', None), ("no", None), (None, None), ('{"a": 1}', None), ('{"k": null}', None)]
    df = spark.createDataFrame(docs, "t string, want long")
    assert [r[0] for r in df.select(V.json_int(F.col("t"), "k")).collect()] == [w for _, w in docs]


def test_small_helpers(spark, tmp_path):
    log = spark.createDataFrame([(1, "running", TS(2024, 1, 1), TS(2024, 1, 1)), (2, "running", TS(2024, 1, 1), TS(2024, 1, 9)), (3, "finished", TS(2024, 1, 1), TS(2024, 1, 1))], "run int, status string, started_at timestamp, progressed_at timestamp")
    assert rows(runs.cancel_stale(log, F.lit(TS(2024, 1, 5))).select("run", "status")) == [(1, "cancelled"), (2, "running"), (3, "finished")]
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9), ("b", 9)], "k string, i int")
    assert rows(decisions.chunked(df.where("k = 'a'"), "k", [F.asc("i")], 2).select("i", "chunk")) == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)]
    assert rows(changes.duplicate_keys(df, ["k", "i"])) == [("b", 9, 2)]
    assert sinks.report_lines(df.where("i = 4"), "%-3s|%3d", "k", "i").first()["line"] == "a  |  4"
    assert streams.undated(spark.createDataFrame([(1, None), (2, TS(2024, 1, 1))], "i int, at timestamp"), "at").count() == 1
    X.register(spark)
    assert tuple(spark.sql("SELECT lower_nfc('E\u0301X'), name_key('  Straße  Ａ ')").first()) == ("éx", "strasse a")


def test_best_films_and_tallies_without_pairs(spark):
    """Counts, ranks and tallies told where each story is read are those of the pairs: in one block and several, films of several titles, a story in two rows, equal sets, nulls."""
    import random

    rng = random.Random(5)
    words = [f"w{i}" for i in range(14)]
    stories = [(i % 55, sorted(set(rng.choices(words, k=7)))) for i in range(60)] + [(90, None), (91, []), (92, ["other"])]
    titles = [(i % 70, i // 70, rng.sample(words, k=rng.randint(0, 4)), "") for i in range(90)]
    terms = spark.createDataFrame(stories, "story_id long, tokens array<string>")
    cat = spark.createDataFrame([*titles, (200, 0, None, "")], "film_id long, title_no long, tokens array<string>, fold string")
    for own in (cat, cat.where("title_no = 0")):
        scores = retrieval.token_scores(terms, own, small=0).where("score >= 0.5")
        want = retrieval.cut(scores, 0.5, 6).select("story_id", "film_id", "score", "n_over", "rank").collect()
        grid = sorted(retrieval.tallied(scores, [0.5, 0.75, 1.0]).select("story_id", "threshold", "n").collect())
        assert len(want) > 200 and grid
        for small in (50, 10**6):
            got = retrieval.best_films(terms, own, 0.5, 6, small=small).select("story_id", "film_id", "score", "n_over", "rank")
            assert sorted(got.collect()) == sorted(want)
            assert sorted(retrieval.token_scores(terms, own, least=0.5, small=small).select("story_id", "film_id", "score").collect()) == sorted(scores.select("story_id", "film_id", "score").collect())
            assert sorted(retrieval.tallies(terms, own, [0.5, 0.75, 1.0], small=small).select("story_id", "threshold", "n").collect()) == grid
    plan = retrieval.best_films(terms, cat)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert retrieval.best_films(terms, cat.limit(0)).count() == 0


def test_set_changes_hold_nulls_equal_and_read_each_side_once(spark):
    old = spark.createDataFrame([(1, None), (1, "a"), (1, "a"), (2, "b"), (3, "c")], "k long, v string")
    new = spark.createDataFrame([(1, None), (1, "d"), (1, "d"), (2, "b"), (4, "e"), (5, "f")], "k long, v string")
    seen = spark.createDataFrame([(1,), (1,), (2,), (3,), (4,), (None,)], "k long")
    out = changes.set_changes(old, new, seen, "k", ["k", "v"])
    assert rows(out, "k", "v") == [(1, "a", "removed"), (1, "d", "added"), (3, "c", "removed"), (4, "e", "added")]
    # one reading of each side and one of the parents
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 3


def test_film_pages_shuffle_members_once(spark, data):
    """No shuffle by story: the members bear the stories' columns."""
    from tidepool.plans.registry import QUERIES

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["film_pages"](spark, data)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(event_id" in plan and "hashpartitioning(story_id" not in plan
