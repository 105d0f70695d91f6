"""Many words sought at once in texts, by an Aho-Corasick automaton."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

_built: dict[str, ahocorasick.Automaton] = {}


def automaton(key: str, words: list[str]) -> ahocorasick.Automaton:
    """The automaton of a broadcast word list; a worker builds it once and keeps the last one."""
    if key not in _built:
        _built.clear()
        a = ahocorasick.Automaton()
        for i, w in enumerate(words):
            a.add_word(w, i)
        a.make_automaton()
        _built[key] = a
    return _built[key]


def occurring(rows: DataFrame, text: str, words: list[str], *keep: str) -> DataFrame:
    """(keep, word): each word of the list that stands anywhere in a row's text, once for each row; an empty word stands nowhere. The list is broadcast."""
    words = sorted({w for w in words if w})
    shared, name = rows.sparkSession.sparkContext.broadcast(words), uuid.uuid4().hex
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seek = automaton(name, shared.value).iter if shared.value else lambda _: ()
        for batch in batches:
            at, found = [], []
            for i, t in enumerate(batch.column(text)):
                hits = {n for _, n in seek(t.as_py() or "")}
                at += [i] * len(hits)
                found += [shared.value[n] for n in hits]
            yield pa.RecordBatch.from_arrays([*batch.select(list(keep)).take(pa.array(at, pa.int64())).columns, pa.array(found, pa.string())], names=[*keep, "word"])

    return rows.select(*keep, text).mapInArrow(find, f"{schema}, word string")
