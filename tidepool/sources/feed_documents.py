"""Feeds of either format as entries of one shape: RSS and Atom documents, from files or from a column, in batch or as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The names that the two formats give to what is kept of an entry.
NAMES = {
    "title": "title", "link": "link", "description": "summary", "summary": "summary", "pubdate": "published", "published": "published", "issued": "published", "date": "published",
    "updated": "updated", "modified": "updated", "guid": "id", "id": "id", "author": "author", "creator": "author", "source": "source",
}
ENTRY = "position int, format string, entry map<string,string>, error string"


class _Feed:
    """One document's entries, from the parser's events. What was complete before a document breaks off is kept."""

    def __init__(self):
        self.entries: list[dict[str, str]] = []
        self.format: str | None = None
        self.open: list[str] = []
        self.entry: dict[str, str] | None = None
        self.depth = 0
        self.field: str | None = None
        self.text: list[str] = []
        self.is_link = False

    def start(self, name: str, attributes: dict[str, str]) -> None:
        local = name.rsplit(":", 1)[-1].lower()
        self.open.append(local)
        if self.format is None:
            self.format = {"rss": "rss", "rdf": "rss", "feed": "atom"}.get(local, "")
        if local in ("item", "entry") and self.entry is None:
            self.entry, self.depth = {}, len(self.open)
        elif self.entry is not None and len(self.open) == self.depth + 1:
            self.field, self.text = NAMES.get(local), []
            if self.field == "link" and self.format == "atom":
                if attributes.get("rel", "alternate") == "alternate" and attributes.get("href"):
                    self.entry.setdefault("link", attributes["href"].strip())
                self.field = None
            self.is_link = local == "guid" and attributes.get("isPermaLink", "true").lower() == "true"
        elif self.field in ("author", "source") and self.format == "atom" and local in ("name", "title"):
            self.text = []  # of a person or another feed the name counts

    def data(self, text: str) -> None:
        if self.field and not (self.format == "atom" and self.field in ("author", "source") and self.open[-1] not in ("name", "title", "author", "creator", "source")):
            self.text.append(text)

    def end(self, _: str) -> None:
        local = self.open.pop()
        if self.entry is None:
            return
        if len(self.open) == self.depth and self.field:
            value = "".join(self.text).strip()
            if value:
                self.entry.setdefault(self.field, value)
                if self.is_link:
                    self.entry.setdefault("__guid", value)
            self.field = None
        elif len(self.open) == self.depth - 1 and local in ("item", "entry"):
            guid = self.entry.pop("__guid", None)
            if guid and "://" in guid:
                self.entry.setdefault("link", guid)
            self.entries.append(self.entry)
            self.entry = None


def parse(document: bytes | str | None) -> tuple[str | None, list[dict[str, str]], str | None]:
    """(format, entries, error) of one document; entries before a fault are kept, and a document that is no feed is a fault too."""
    feed = _Feed()
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = feed.start, feed.end, feed.data
    error = None
    try:
        parser.Parse(document if document is not None else b"", True)
    except (expat.ExpatError, LookupError, ValueError) as e:
        error = f"malformed: {expat.ErrorString(e.code) if isinstance(e, expat.ExpatError) else e}"
    if not feed.format:
        return None, [], error or "no feed"
    return feed.format, feed.entries, error


def entries_of(documents: DataFrame, column: str, *keep: str) -> DataFrame:
    """(keep, position, format, entry, error): a row for each entry of each document, in a map of the eight names, and one more (position -1) with the fault of a document that has one.

    The map has what an entry gives of title, link, summary, published, updated, id, author and source. Works on batches and streams alike.
    """
    kept = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]
        for batch in batches:
            for i, doc in enumerate(batch.column(column)):
                form, entries, error = parse(doc.as_py())
                rows = [(n, form, list(e.items()), None) for n, e in enumerate(entries)] + ([(-1, form, None, error)] if error else [])
                if rows:
                    own = batch.select(list(keep)).take(pa.array([i] * len(rows), pa.int64())).columns
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=[*keep, "position", "format", "entry", "error"])

    return documents.select(*keep, column).mapInArrow(run, f"{kept}, {ENTRY}" if keep else ENTRY)


def read(spark: SparkSession, path: str, stream: bool = False, **options: str) -> DataFrame:
    """(path, position, format, entry, error) of all feed files in a folder. Spark's own file source finds and reads them, so any store and, as a stream, its record of files that were read will do."""
    reader = spark.readStream if stream else spark.read
    schema = "path string, modificationTime timestamp, length long, content binary"
    return entries_of(reader.format("binaryFile").schema(schema).options(**options).load(path), "content", "path")


def faults(entries: DataFrame, *by: str) -> DataFrame:
    """(by, entries, unusable, faults): how many entries there are, how many lack a link or a title and can't be stored, and how many documents have a fault."""
    e = F.col("entry")
    bad = F.coalesce(F.length(e["link"]), F.lit(0)).eqNullSafe(0) | F.coalesce(F.length(e["title"]), F.lit(0)).eqNullSafe(0)
    return entries.groupBy(*by).agg(F.count_if(F.col("position") >= 0).alias("entries"), F.count_if((F.col("position") >= 0) & bad).alias("unusable"), F.count_if(F.col("position") < 0).alias("faults"))
