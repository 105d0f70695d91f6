"""Feed documents of both formats, broken ones too, from columns, files and streams; changes inside nested documents."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidepool.operators import documents
from tidepool.sources import feed_documents, readers
from tidepool.streaming import streams

RSS = b"""<?xml version="1.0" encoding="ISO-8859-1"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:media="http://m/"><channel><title>Channel</title><link>http://c/</link>
<item><title>One &amp; <![CDATA[<b>two</b>]]> \xe9</title><link> http://a/1 </link><description>d</description><pubDate>Tue, 02 Jan 2024 03:04:05 EST</pubDate><guid isPermaLink="false">g1</guid><dc:creator>Ann</dc:creator><source url="http://s/">Outlet</source><media:content><media:title>no</media:title></media:content></item>
<item><title>By guid</title><guid>http://a/2</guid><dc:date>2024-01-03T00:00:00Z</dc:date></item>
<item><title>No link</title><guid isPermaLink="false">http://a/3</guid></item>
</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>Feed</title><link href="http://f/"/><entry><title type="xhtml"><div>A <b>bold</b> one</div></title><link rel="self" href="http://no/"/><link rel="alternate" href="http://b/1"/>
<id>urn:1</id><updated>2024-01-04T00:00:00+01:00</updated><summary>s</summary><author><name>Bo</name><email>e@x</email></author><source><id>urn:src</id><title>Paper</title></source></entry>
<entry><title>Second</title><link href="http://b/2"/><published>2024-01-05T00:00:00Z</published><updated>2024-01-06T00:00:00Z</updated></entry></feed>"""


def test_both_formats_give_the_same_names():
    form, entries, error = feed_documents.parse(RSS)
    assert (form, error) == ("rss", None)
    assert entries[0] == {"title": "One & <b>two</b> é", "link": "http://a/1", "summary": "d", "published": "Tue, 02 Jan 2024 03:04:05 EST", "id": "g1", "author": "Ann", "source": "Outlet"}
    assert entries[1] == {"title": "By guid", "id": "http://a/2", "link": "http://a/2", "published": "2024-01-03T00:00:00Z"} and "link" not in entries[2]
    form, entries, error = feed_documents.parse(ATOM)
    assert (form, error) == ("atom", None)
    assert entries[0] == {"title": "A bold one", "link": "http://b/1", "id": "urn:1", "updated": "2024-01-04T00:00:00+01:00", "summary": "s", "author": "Bo", "source": "Paper"}
    assert entries[1] == {"title": "Second", "link": "http://b/2", "published": "2024-01-05T00:00:00Z", "updated": "2024-01-06T00:00:00Z"}


@pytest.mark.parametrize(("document", "n", "fault"), [
    (RSS[:RSS.index(b"<item><title>No")], 2, "malformed"), (b"<html><body>blocked</body></html>", 0, "no feed"), (b"", 0, "malformed"), (None, 0, "malformed"), (b"<rss><channel/></rss>", 0, None),
    (b"<rss><channel><item><title>&nope;</title></item></channel></rss>", 0, "malformed"), (b'<?xml version="1.0" encoding="nothing-known"?><rss/>', 0, "malformed"), ("<rss><item><title>x</title></item></rss> trailing", 1, "malformed")])
def test_faults_are_told_and_what_came_before_is_kept(document, n, fault):
    _, entries, error = feed_documents.parse(document)
    assert len(entries) == n and (error is None if fault is None else error.startswith(fault))


def test_files_in_a_folder_and_as_a_stream(spark, tmp_path):
    folder = tmp_path / "feeds"
    folder.mkdir()
    (folder / "a.xml").write_bytes(RSS)
    (folder / "b.atom").write_text(ATOM)
    (folder / "c.html").write_text("<html/>")
    rows = feed_documents.read(spark, str(folder))
    assert [tuple(r) for r in feed_documents.faults(rows).collect()] == [(5, 1, 1)]
    got = readers.feed_entries(rows.where("position >= 0"), dt.datetime(2024, 1, 5), 2, source="path").orderBy("url").collect()
    assert [(r["url"], r["published_at"]) for r in got] == [("http://a/2", dt.datetime(2024, 1, 3)), ("http://b/1", dt.datetime(2024, 1, 3, 23)), ("http://b/2", dt.datetime(2024, 1, 5))]
    stream = feed_documents.read(spark, str(folder), stream=True).where("position >= 0").select("entry")
    out = str(tmp_path / "out")
    assert streams.run_available(stream, out).count() == 5
    (folder / "d.xml").write_bytes(RSS)
    again = feed_documents.read(spark, str(folder), stream=True).where("position >= 0").select("entry")
    assert streams.run_available(again, out).count() == 8  # the files that were read are not read again


def leaves(doc, path=""):
    if isinstance(doc, dict) and doc:
        return {k: v for n, x in doc.items() for k, v in leaves(x, f"{path}/{n.replace('~', '~0').replace('/', '~1')}").items()}
    if isinstance(doc, list) and doc:
        return {k: v for n, x in enumerate(doc) for k, v in leaves(x, f"{path}/{n}").items()}
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(doc), "number")
    return {path: (kind, json.dumps(doc, separators=(",", ":"), ensure_ascii=False))}


def random_document(rng, depth=0):
    kind = rng.randrange(9 if depth < 4 else 6)
    if kind >= 7:
        return {rng.choice(("a", "b", "c/d", "e~f", "é \"q\"", "")): random_document(rng, depth + 1) for _ in range(rng.randrange(4))}
    if kind == 6:
        return [random_document(rng, depth + 1) for _ in range(rng.randrange(4))]
    return (rng.randrange(-5, 5), rng.choice(("", "x", "7", "null", "é\n")), True, False, None, rng.choice((0.5, 123456789012, -2.25)))[kind]


def test_changes_of_random_documents(spark):
    rng = random.Random(11)
    old = {i: random_document(rng) for i in range(250)}
    new = {i: random_document(rng) if rng.random() < 0.5 else old[i] for i in range(20, 250)} | {300: {"x": 1}}
    table = lambda docs: spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()], "k int, d string")
    want = set()
    for k in old.keys() & new.keys():
        a, b = leaves(old[k]), leaves(new[k])
        want |= {(k, p, "added" if p not in a else "removed" if p not in b else "changed", *a.get(p, (None, None)), *b.get(p, (None, None))) for p in a.keys() | b.keys() if a.get(p) != b.get(p)}
    got = [tuple(r) for r in documents.document_changes(table(old), table(new), "k", "d").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_changes_of_odd_documents(spark):
    old = spark.createDataFrame([(1, "nope"), (2, None), (3, "5"), (4, '{"a":"1"}'), (5, None), (6, "[1, 2]"), (7, "{}")], "k int, d string")
    new = spark.createDataFrame([(1, "{}"), (2, "1"), (3, None), (4, '{"a":1}'), (5, None), (6, "[2]"), (8, "{}")], "k int, d string")
    got = {tuple(r) for r in documents.document_changes(old, new, "k", "d").collect()}
    assert got == {(1, "", "changed", "malformed", "nope", "object", "{}"), (2, "", "added", None, None, "number", "1"), (3, "", "removed", "number", "5", None, None), (4, "/a", "changed", "string", '"1"', "number", "1"),
                   (6, "/0", "changed", "number", "1", "number", "2"), (6, "/1", "removed", "number", "2", None, None)}
    assert documents.document_changes(old.limit(0), new, "k", "d").count() == 0
    assert documents.paths(old.where(F.col("k") == 5), "k", "d").count() == 0


def test_documents_go_down_in_few_passes(spark, monkeypatch):
    """Both versions of documents of five levels are told apart in one pass; deeper ones take one more for each six levels, and lose nothing."""
    passes, real = [], documents.written
    monkeypatch.setattr(documents, "written", lambda df: passes.append(1) or real(df))
    one = spark.createDataFrame([(1, '{"a": {"b": {"c": {"d": 1}}}}'), (2, '{"a": 1}')], "k int, d string")
    two = spark.createDataFrame([(1, '{"a": {"b": {"c": {"d": 2}}}}'), (2, '{"a": 1}')], "k int, d string")
    assert [tuple(r) for r in documents.document_changes(one, two, "k", "d").collect()] == [(1, "/a/b/c/d", "changed", "number", "1", "number", "2")]
    assert len(passes) == 1
    deep = lambda x: spark.createDataFrame([(1, '{"a":[' * 7 + x + "]}" * 7)], "k int, d string")
    assert [tuple(r) for r in documents.document_changes(deep("1"), deep("[]"), "k", "d").collect()] == [(1, "/a/0" * 7, "changed", "number", "1", "array", "[]")]
    assert len(passes) <= 4
