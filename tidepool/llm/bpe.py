"""Byte-level BPE encoding and decoding through one global table of distinct words.

Texts are split into pre-tokens. A block of texts keeps, for each text, the numbers of its pre-tokens in order
(their positions), and each distinct word of the block once: so a word travels once for each block, not once
for each place. The blocks' words are shuffled together by a hash of the word and each is encoded once; the ids
go back to the blocks' words by number, and each block puts its texts together by position. Decoding looks the
ids up in the table of token bytes.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.llm.common import blocks_for, materialize_by

BLOCK_CHARS = 32_000_000
ROW_CHARS = 400_000
BUCKET_WORDS = 300_000  # words of blocks for each bucket


class Vocabulary:
    """The ranks of a .tiktoken file, an encoder over them, and the bytes of every token."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)


_vocabularies: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    return _vocabularies.get((path, pattern)) or _vocabularies.setdefault((path, pattern), Vocabulary(path, pattern))


def gather(codes: np.ndarray, start: np.ndarray, length: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of flat that codes name, one after the other, and where each ends."""
    n = length[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(start[codes] - (ends - n), n) + np.arange(total)
    return flat[at], ends


def pack_words(words: list[str]) -> bytes:
    """Words as one compressed run: how many, their lengths in bytes, their bytes."""
    raw = [w.encode() for w in words]
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(raw), *map(len, raw)], "<u4").tobytes() + b"".join(raw))


def unpack_words(data: bytes) -> list[str]:
    whole = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(whole[:4], "little")
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(whole, "<u4", n, 4), dtype=np.int64)).tolist()
    return [whole[a:b].decode() for a, b in zip([4 + 4 * n, *ends], ends, strict=False)]


def split_blocks(docs: DataFrame, pattern: str) -> DataFrame:
    """Rows of blocks: (block, n_words, words) once for each block, (block, doc_ids, counts, codes) for runs of texts."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block long, n_words long, words binary, doc_ids array<{doc_type}>, counts array<int>, codes binary"

    def run(batches):
        import regex

        find = regex.compile(pattern).findall
        pack = zstandard.ZstdCompressor(level=3).compress
        number: dict[str, int] = {}
        block, size = TaskContext.get().partitionId() << 32, 0
        ids, counts, codes, chars = [], [], [], 0
        kind = None

        def row(words=None, texts=False):
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([words and len(words)], pa.int64()), pa.array([words and pack_words(words)], pa.binary()),
                 pa.array([ids if texts else None], pa.list_(kind)), pa.array([counts if texts else None], pa.list_(pa.int32())),
                 pa.array([pack(np.array(codes, np.uint32).tobytes()) if texts else None], pa.binary())],
                names=["block", "n_words", "words", "doc_ids", "counts", "codes"])

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = find(text or "")
                for w in set(words).difference(number):
                    number[w] = len(number)
                ids.append(doc_id)
                counts.append(len(words))
                codes += map(number.__getitem__, words)
                chars += len(text or "")
                if chars >= ROW_CHARS:
                    yield row(texts=True)
                    size += chars
                    ids, counts, codes, chars = [], [], [], 0
                    if size >= BLOCK_CHARS:
                        yield row(list(number))
                        block, size, number = block + 1, 0, {}
        if ids:
            yield row(texts=True)
        if number:
            yield row(list(number))

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def encode_words(words: DataFrame, path: str, pattern: str, buckets: int) -> DataFrame:
    """(of_block, nos, sizes, ids) for each block and bucket: the numbers of its words, how many ids each has, and the ids.

    Each block's distinct words are dealt to buckets by a hash of the word, so all blocks' copies of a word meet
    in one bucket, where the word is encoded once.
    """

    def deal(batches):
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("words").to_pylist(), strict=True):
                all_words = unpack_words(data)
                h = np.array([zlib.crc32(w.encode()) for w in all_words]) % buckets
                order = np.argsort(h, kind="stable")
                cut = np.searchsorted(h[order], np.arange(buckets + 1))
                for k in np.flatnonzero(np.diff(cut)):
                    nos = order[cut[k]:cut[k + 1]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block], pa.int64()), pa.array([k], pa.int64()), pa.array([pack_words([all_words[i] for i in nos.tolist()])], pa.binary()),
                         pa.array([zstandard.compress(np.diff(nos, prepend=0).astype("<u4").tobytes(), 3)], pa.binary())],
                        names=["block", "bucket", "words", "nos"])

    def encode(group: pa.Table) -> pa.Table:
        one = vocabulary(path, pattern).encoding._encode_single_piece  # a word is one match of the pattern: it isn't split again
        known: dict[str, bytes] = {}
        sizes, ids = [], []
        for data in group["words"].to_pylist():
            words = unpack_words(data)
            known.update((w, np.array(one(w), "<u2" if small else "<u4").tobytes()) for w in set(words).difference(known))
            got = list(map(known.__getitem__, words))
            sizes.append(zstandard.compress(np.array([len(x) // width for x in got], "<u4").tobytes(), 3))
            ids.append(zstandard.compress(b"".join(got), 3))
        return pa.table({"of_block": group["block"], "nos": group["nos"], "sizes": pa.array(sizes, pa.binary()), "ids": pa.array(ids, pa.binary())})

    small = len(vocabulary(path, pattern).length) <= 1 << 16
    width = 2 if small else 4
    dealt = words.mapInArrow(deal, "block long, bucket long, words binary, nos binary")
    return dealt.groupBy("bucket").applyInArrow(encode, "of_block long, nos binary, sizes binary, ids binary")


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 (with keep_ids also ids, array<int>) of every row of docs.

    A null text counts as empty (no tokens); repeated rows each keep a row; an empty table gives no rows; texts are
    encoded whole; other columns are ignored.
    """
    own = default_files()
    path, pattern = path or own[0], pattern or own[1]
    blocks = materialize_by(split_blocks(docs, pattern), "bpe-blocks", "block")  # so that codes are written once and never shuffled
    words = blocks.where(F.col("words").isNotNull())
    buckets = blocks_for(words.agg(F.sum("n_words")).first()[0] or 0, BUCKET_WORDS)
    known = encode_words(words.select("block", "words"), path, pattern, buckets)
    runs = blocks.where(F.col("counts").isNotNull()).select("block", "doc_ids", "counts", "codes")
    id_type = "<u2" if len(vocabulary(path, pattern).length) <= 1 << 16 else "<u4"
    schema = docs.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if keep_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        v = vocabulary(path, pattern)
        unpack = zstandard.ZstdDecompressor().decompress
        nos, sizes, ids_ = ([unpack(x) for x in right[c].to_pylist()] for c in ("nos", "sizes", "ids"))
        no = np.concatenate([np.cumsum(np.frombuffer(x, "<u4"), dtype=np.int64) for x in nos] or [np.zeros(0, np.int64)])
        size = np.frombuffer(b"".join(sizes), "<u4").astype(np.int64)
        data = np.frombuffer(b"".join(ids_), id_type).astype(np.uint32)
        length, start = np.zeros(len(no), np.int64), np.zeros(len(no), np.int64)
        length[no], start[no] = size, np.cumsum(size) - size
        doc, n_tokens, sha, back, kept = [], [], [], [], []
        for ids, counts, codes in zip(left["doc_ids"].to_pylist(), left["counts"].to_pylist(), left["codes"].to_pylist(), strict=True):
            tokens, word_ends = gather(np.frombuffer(unpack(codes), np.uint32), start, length, data)
            text, token_ends = gather(tokens, v.start, v.length, v.bytes)
            raw, decoded = tokens.astype("<u4").tobytes(), text.tobytes()
            at = a = b = 0
            for doc_id, n in zip(ids, counts, strict=True):
                at += n
                a2 = int(word_ends[at - 1]) if at else 0
                b2 = int(token_ends[a2 - 1]) if a2 else 0
                doc.append(doc_id)
                n_tokens.append(a2 - a)
                sha.append(hashlib.sha256(raw[4 * a:4 * a2]).hexdigest())
                back.append(hashlib.sha256(decoded[b:b2]).hexdigest())
                if keep_ids:
                    kept.append(tokens[a:a2].astype(np.int32))
                a, b = a2, b2
        out = {"doc_id": pa.array(doc, left.schema.field("doc_ids").type.value_type), "n_tokens": pa.array(n_tokens, pa.int64()), "ids_sha256": pa.array(sha, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
        if keep_ids:
            out["ids"] = pa.array(kept, pa.list_(pa.int32()))
        return pa.table(out)

    return runs.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(assemble, schema)
