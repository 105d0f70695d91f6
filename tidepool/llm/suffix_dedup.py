"""Removal of repeated byte strings across documents: suffixes of a cover sample sorted bucket by bucket.

A suffix counts up to `length` bytes. The cover sample holds, of each window of `length` bytes, the place whose
hashed `gram` bytes are least. Like the sample of a difference cover it holds, for two equal windows, places at the same offset in
both; it is chosen by content instead of by fixed residues, so that this offset is the same for all windows that are equal, wherever
they stand, and not one for each pair of residues. Samples whose gram stands in one document alone leave first, and with them all
windows they cover. Then one suffix bucket at a time, the samples over some grams, is sorted: their suffixes byte by byte, and what
precedes them, read backwards. With the ranks and the longest common prefixes of both orders, two ranks say whether two windows
over samples are equal, at any offset, however long the ties run on outside of them: no window is sorted or compared by itself, and
memory is bounded by the samples of a bucket and at most `length` bytes to either side.

Texts stay in compressed blocks. What moves are packed arrays: grams, the bytes around repeated
samples (each once for a block), and one bit for each window in return. Hashes only choose and filter; what is removed was equal by its bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.llm.common import blocks_for, materialize, materialize_by, tidy

BLOCK_BYTES = 6_000_000
PART_BYTES = 1_000_000
BUCKET_BYTES = 8_000_000  # text for each bucket
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base modulo 2^64, and of its inverse."""
    if not _powers or len(_powers[0][0]) < n:
        back = np.uint64(pow(int(_A), -1, 1 << 64))
        one = np.ones(1, np.uint64)
        _powers[0] = tuple(np.concatenate((one, np.cumprod(np.full(n, x, np.uint64)))) for x in (_A, back))
    return _powers[0]


_bytes = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _C)


def hash_windows(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each size bytes: a polynomial over mixed bytes from running sums, exact modulo 2^64."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_bytes[data] * up[:len(data)], out=sums[1:])
    return mix((sums[size:] - sums[:n]) * down[:n])


class Samples:
    """The cover samples of some texts laid end to end."""

    def __init__(self, texts: list[bytes], length: int, gram: int):
        self.length, self.gram = length, gram
        size = np.array([len(t) for t in texts], np.int64)
        self.first = np.cumsum(size) - size
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        n, span = len(self.data), length - gram + 1
        windows = np.zeros(0, np.int64)
        if n >= length:
            h = hash_windows(self.data, gram)
            # the least hash of each window, the leftmost of equals: the place in the low bits decides
            key = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
            width = 1
            low = key
            while width * 2 <= span:
                low = np.minimum(low[:-width], low[width:])
                width *= 2
            if width < span:
                low = np.minimum(low[:len(low) - (span - width)], low[span - width:])
            at = (low & np.uint64(0xFFFFFF)).astype(np.int64)
            whole = np.zeros(n, bool)  # windows within one text
            for f, s in zip(self.first.tolist(), size.tolist(), strict=True):
                whole[f:f + max(0, s - length + 1)] = True
            windows = np.flatnonzero(whole[:len(at)])
            at = at[windows]
            new = np.flatnonzero(np.diff(at, prepend=-1) | (np.diff(windows, prepend=-2) != 1))
            self.place = at[new]
            self.low = windows[new]  # first and last window over each sample
            self.high = windows[np.append(new[1:], len(windows)) - 1] if len(new) else windows
            self.hash = h[self.place]
        else:
            self.place = self.low = self.high = windows
            self.hash = np.zeros(0, np.uint64)
        self.text = np.searchsorted(self.first, self.low, "right") - 1
        # empty texts share their place with the next one
        if len(texts):
            starts = np.flatnonzero(size)
            self.text = starts[np.searchsorted(self.first[starts], self.low, "right") - 1] if len(starts) else self.text


def parts_of(texts: list[bytes]):
    """Runs of texts of about PART_BYTES; a longer text is alone."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PART_BYTES:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]


def long_samples(text: bytes, length: int, gram: int, step: int = PART_BYTES):
    """Samples of a text in overlapping pieces, so places fit their bits: (offset, Samples)."""
    for at in range(0, max(1, len(text) - length + 1), step):
        yield at, Samples([text[at:at + step + length - 1]], length, gram)


def block_samples(texts: list[bytes], length: int, gram: int):
    """(number of the first text, offset in it, samples) covering all windows of a block, in a fixed order."""
    for at, part in parts_of(texts):
        if len(part) == 1 and len(part[0]) > PART_BYTES:
            yield from ((at, offset, s) for offset, s in long_samples(part[0], length, gram))
        else:
            yield at, 0, Samples(part, length, gram)


def unique_grams(samples: list, ids: list) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of a block's samples in order, and which of them stand under more than one doc_id."""
    hashes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    number = {d: i for i, d in enumerate(dict.fromkeys(ids))}
    code = np.array([number[d] for d in ids], np.int64)
    for at, _, s in samples:
        hashes.append(s.hash)
        docs.append(code[at + s.text])
    h, d = np.concatenate(hashes), np.concatenate(docs)
    order = np.argsort(h, kind="stable")
    h, d = h[order], d[order]
    begin = np.flatnonzero(np.diff(h, prepend=h[:1] + np.uint64(1)) != 0) if len(h) else np.zeros(0, np.int64)
    if not len(h):
        return h, np.zeros(0, bool)
    return h[begin], np.maximum.reduceat(d, begin) != np.minimum.reduceat(d, begin)


def blocks_of(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """(block, doc_ids, sizes, n_bytes, data, carried): whole texts as bytes, compressed together; null texts are empty.

    carried holds the rows' other columns that are asked for, as structs.
    """
    struct = docs.select(*carry).schema
    schema = T.StructType().add("block", "long").add("doc_ids", T.ArrayType(T.LongType())).add("sizes", T.ArrayType(T.LongType())).add("n_bytes", "long").add("data", "binary")
    if carry:
        schema = schema.add("carried", T.ArrayType(struct))

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        pack = zstandard.ZstdCompressor(level=3).compress
        ids, texts, size, others = [], [], 0, []
        kind = None

        def row():
            columns = {"block": pa.array([block], pa.int64()), "doc_ids": pa.array([ids], pa.list_(pa.int64())), "sizes": pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                       "n_bytes": pa.array([size], pa.int64()), "data": pa.array([pack(b"".join(texts))], pa.binary())}
            if carry:
                columns["carried"] = pa.array([others], pa.list_(kind))
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            kind = pa.struct([batch.schema.field(c) for c in carry])
            rows = batch.select(list(carry)).to_pylist() if carry else [None] * batch.num_rows
            for doc_id, text, other in zip(batch.column("doc_id").to_pylist(), batch.column("text"), rows, strict=True):
                others.append(other)
                t = text.as_buffer().to_pybytes() if text.is_valid else b""
                ids.append(doc_id)
                texts.append(t)
                size += len(t)
                if size >= BLOCK_BYTES:
                    yield row()
                    block, ids, texts, size, others = block + 1, [], [], 0, []
        if ids:
            yield row()

    return docs.select("doc_id", "text", *carry).mapInArrow(tidy(run), schema)


def unpacked(data: bytes, sizes: list[int]) -> list[bytes]:
    whole = zstandard.ZstdDecompressor().decompress(data) if sum(sizes) else b""
    ends = np.cumsum(sizes).tolist()
    return [whole[e - n:e] for e, n in zip(ends, sizes, strict=True)]


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def around(flat: np.ndarray, at: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """The bytes of flat from each place on, at most size and width of them, in rows of whole 8-byte words filled with zeros."""
    width = -(-width // 8) * 8
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([flat, np.zeros(width, np.uint8)]), width)[at]
    rows[np.arange(width) >= size[:, None]] = 0
    return rows


def sorted_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lexicographic order of rows of bytes, and how many bytes each row there has in common with the one before."""
    order = np.lexsort(rows.view(">u8").astype(np.uint64).T[::-1])
    common = np.zeros(len(rows), np.int64)
    for i in range(1, len(rows), 65_536):
        a = rows[order[i - 1:i + 65_536]]
        differ = a[1:] != a[:-1]
        common[i:i + 65_536] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return order, common


def ranks(order: np.ndarray, common: np.ndarray, size: int) -> np.ndarray:
    """Each row's rank among all by its first size bytes; equal bytes, equal rank."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < size)
    return out


class Contexts:
    """A block's windows over repeated samples: each distinct (gram, bytes around it) once, and where it stands."""

    def __init__(self, samples: list, ids: list, repeated: np.ndarray, length: int, gram: int):
        self.where = []  # (text, first window, entry) of every occurrence
        side = length - gram
        known: dict[tuple[int, int, bytes], int] = {}
        self.hash, self.doc, self.shift, self.bytes = [], [], [], []
        for at, offset, s in samples:
            near = np.searchsorted(repeated, s.hash)
            keep = np.flatnonzero((near < len(repeated)) & (repeated[np.minimum(near, len(repeated) - 1)] == s.hash)) if len(repeated) else near[:0]
            raw = s.data.tobytes()
            base = s.first[s.text[keep]]
            for h, text, low, high, place, f in zip(s.hash[keep].tolist(), (at + s.text[keep]).tolist(), s.low[keep].tolist(), s.high[keep].tolist(), s.place[keep].tolist(), base.tolist(), strict=True):
                doc = ids[text]
                if doc is None:
                    continue
                key = (h, low - place + side, raw[low:high + length])
                e = known.get(key)
                if e is None:
                    e = known[key] = len(known)
                    self.hash.append(h)
                    self.doc.append(doc)
                    self.shift.append(key[1])
                    self.bytes.append(key[2])
                elif doc < self.doc[e]:
                    self.doc[e] = doc
                self.where.append((text, low - f + offset, high - low + 1, e))


def remove(docs: DataFrame, length: int = 50, gram: int = 24, keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs.

    With keep_text also text, the kept bytes; carry names other columns to keep.

    A byte goes if a string of length bytes that covers it also starts in a document with a smaller doc_id, judged
    on the input. A null text counts as empty; texts shorter than length lose nothing; rows with the same doc_id are
    the same document, so they don't remove each other's strings; a row with a null doc_id keeps all and removes
    nothing; an empty table gives no rows; other columns are ignored. Bytes kept may cut a character: text drops
    what is no whole character.
    """
    blocks = materialize_by(blocks_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry), carry), "dedup-blocks", "block")  # read by block twice, without a shuffle
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = blocks_for(total, BUCKET_BYTES)

    def grams(batches):
        for batch in batches:
            for block, ids, sizes, data in zip(*(batch.column(c).to_pylist() for c in ("block", "doc_ids", "sizes", "data")), strict=True):
                h, multi = unique_grams(block_samples(unpacked(data, sizes), length, gram), ids)
                b = bucket_of(h, buckets)
                order = np.argsort(b, kind="stable")
                cut = np.searchsorted(b[order], np.arange(buckets + 1))
                for k in np.flatnonzero(np.diff(cut)):
                    rows = order[cut[k]:cut[k + 1]]
                    low = h[rows].view(np.uint8).reshape(-1, 8)[:, :5]  # 40 bits beside the bucket: enough for a filter
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block], pa.int64()), pa.array([k], pa.int64()), pa.array([np.ascontiguousarray(low).tobytes()], pa.binary()), pa.array([np.packbits(multi[rows]).tobytes()], pa.binary())],
                        names=["block", "bucket", "grams", "multi"])

    def repeated(group: pa.Table) -> pa.Table:
        blobs = group["grams"].to_pylist()
        raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 5)
        h = np.zeros((len(raw), 8), np.uint8)
        h[:, :5] = raw
        h = h.view(np.uint64).ravel()
        n = [len(x) // 5 for x in blobs]
        multi = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=k) for m, k in zip(group["multi"].to_pylist(), n, strict=True)]).astype(bool)
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        hit = np.zeros(len(h), bool)
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        # a gram that is in several documents of one block is repeated in that block at any rate
        hit |= multi
        bits = [np.packbits(x).tobytes() for x in np.split(hit, np.cumsum(n)[:-1])]
        return pa.table({"of_block": group["block"], "bucket": group["bucket"], "bits": pa.array(bits, pa.binary())})

    asked = blocks.select("block", "doc_ids", "sizes", "data").mapInArrow(tidy(grams), "block long, bucket long, grams binary, multi binary")
    known = materialize(asked.groupBy("bucket").applyInArrow(repeated, "of_block long, bucket long, bits binary"), "dedup-known")

    def contexts(block: pa.Table, bits: pa.Table) -> tuple[list, list[bytes], Contexts]:
        ids, texts = block["doc_ids"][0].as_py(), unpacked(block["data"][0].as_py(), block["sizes"][0].as_py())
        samples = list(block_samples(texts, length, gram))  # texts once more, and a place for each ten bytes or so
        h, _ = unique_grams(samples, ids)
        b = bucket_of(h, buckets)
        hit = np.zeros(len(h), bool)
        order = np.argsort(b, kind="stable")
        cut = np.searchsorted(b[order], np.arange(buckets + 1))
        for k, packed in zip(bits["bucket"].to_pylist(), bits["bits"].to_pylist(), strict=True):
            rows = order[cut[k]:cut[k + 1]]
            hit[rows] = np.unpackbits(np.frombuffer(packed, np.uint8), count=len(rows)).astype(bool)
        return ids, texts, Contexts(samples, ids, h[hit], length, gram)

    side = length - gram  # a window starts at most so far before its sample

    def entries(block: pa.Table, bits: pa.Table) -> pa.Table:
        out = {c: [] for c in ("block", "bucket", "head", "sizes", "data")}
        if block.num_rows:
            _, _, c = contexts(block, bits)
            h = np.array(c.hash, np.uint64)
            b = bucket_of(h, buckets)
            pack = zstandard.ZstdCompressor(level=3).compress
            order = np.argsort(b, kind="stable")
            cut = np.searchsorted(b[order], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(cut)):
                rows = order[cut[k]:cut[k + 1]].tolist()
                out["block"].append(block["block"][0].as_py())
                out["bucket"].append(int(k))
                out["head"].append(pack(h[rows].tobytes() + np.array([c.doc[r] for r in rows], np.int64).tobytes()))
                out["sizes"].append(bytes(x for r in rows for x in (c.shift[r], len(c.bytes[r]))))
                out["data"].append(pack(b"".join(c.bytes[r] for r in rows)))
        return pa.table({k: pa.array(v, pa.int64() if k in ("block", "bucket") else pa.binary()) for k, v in out.items()})

    def decide(group: pa.Table) -> pa.Table:
        """For each entry and each of its windows: does the window stand under a doc_id smaller than the entry's?"""
        unpack = zstandard.ZstdDecompressor().decompress
        hashes, docs_, shifts, lens, datas, counts = [], [], [], [], [], []
        for head, sizes, data in zip(*(group[c].to_pylist() for c in ("head", "sizes", "data")), strict=True):
            s = np.frombuffer(sizes, np.uint8).reshape(-1, 2)
            raw = unpack(head)
            hashes.append(np.frombuffer(raw[:8 * len(s)], np.uint64))
            docs_.append(np.frombuffer(raw[8 * len(s):], np.int64))
            shifts.append(s[:, 0].astype(np.int64))
            lens.append(s[:, 1].astype(np.int64))
            datas.append(np.frombuffer(unpack(data), np.uint8))
            counts.append(len(s))
        h, doc, shift, size, flat = (np.concatenate(x) for x in (hashes, docs_, shifts, lens, datas))
        first = np.cumsum(size) - size
        mask = np.zeros(len(h), np.uint64)
        # entries of a gram come together; a gram known from one entry alone has nothing smaller
        order = np.argsort(h, kind="stable")
        new = np.diff(h[order], prepend=h[order][:1] + np.uint64(1)) != 0
        group_size = np.diff(np.append(np.flatnonzero(new), len(h)))
        live = order[np.repeat(group_size, group_size) > 1]
        at = (first + side - shift)[live]  # the samples
        right, right_lcp = sorted_rows(around(flat, at, (first + size)[live] - at, length))
        left, left_lcp = sorted_rows(around(flat[::-1], len(flat) - at, side - shift[live], side))
        for k in range(side + 1):  # windows that start at one offset from the sample, together
            rows = np.flatnonzero((shift[live] <= k) & (size[live] - length >= k - shift[live]))
            if len(rows) < 2:
                continue
            w = ranks(left, left_lcp, side - k)[rows] * len(live) + ranks(right, right_lcp, gram + k)[rows]
            by = np.argsort(w)
            w, d = w[by], doc[live[rows]][by]
            begin = np.flatnonzero(np.diff(w, prepend=w[0] - 1) != 0)
            least = np.repeat(np.minimum.reduceat(d, begin), np.diff(np.append(begin, len(w))))
            hit = live[rows[by[d > least]]]
            mask[hit] |= np.uint64(1) << np.uint64(k)
        bits = [x.tobytes() for x in np.split(mask, np.cumsum(counts)[:-1])]
        return pa.table({"of_block": group["block"], "bucket": group["bucket"], "masks": pa.array(bits, pa.binary())})

    told = (blocks.groupBy("block").cogroup(known.groupBy("of_block"))
            .applyInArrow(entries, "block long, bucket long, head binary, sizes binary, data binary"))
    decided = materialize(told.groupBy("bucket").applyInArrow(decide, "of_block long, bucket long, masks binary"), "dedup-decided")
    both = known.groupBy("of_block").agg(F.collect_list(F.struct("bucket", "bits")).alias("bits")).join(
        decided.groupBy("of_block").agg(F.collect_list(F.struct("bucket", "masks")).alias("masks")), "of_block", "left")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    if keep_text:
        schema = schema.add("text", "string")
    own = schema.names
    if clash := set(own).intersection(carry):
        raise ValueError(f"columns {sorted(clash)} can't be carried: the result has its own")
    schema = T.StructType([*schema, *docs.select(*carry).schema])

    def cut_out(block: pa.Table, replies: pa.Table) -> pa.Table:
        bits = replies["bits"][0].as_py() if replies.num_rows else []
        masks = (replies["masks"][0].as_py() or []) if replies.num_rows else []
        ids, texts, c = contexts(block, pa.table({"bucket": pa.array([x["bucket"] for x in bits], pa.int64()), "bits": pa.array([x["bits"] for x in bits], pa.binary())}))
        h = np.array(c.hash, np.uint64)
        b = bucket_of(h, buckets)
        order = np.argsort(b, kind="stable")
        edge = np.searchsorted(b[order], np.arange(buckets + 1))
        smaller = np.zeros(len(h), np.uint64)
        for x in masks:
            smaller[order[edge[x["bucket"]]:edge[x["bucket"] + 1]]] = np.frombuffer(x["masks"], np.uint64)
        gone: dict[int, list[tuple[int, int]]] = {}
        for text, low, n, e in c.where:
            if ids[text] > c.doc[e]:  # the same bytes stand under a smaller doc_id in this block
                gone.setdefault(text, []).append((low, low + n - 1 + length))
            elif m := int(smaller[e]) >> c.shift[e]:
                k = 0
                while m:
                    skip = (m & -m).bit_length() - 1
                    m >>= skip
                    run = (~m & (m + 1)).bit_length() - 1
                    gone.setdefault(text, []).append((low + k + skip, low + k + skip + run - 1 + length))
                    m >>= run
                    k += skip + run
        out = {c: [] for c in own}
        for i, (doc_id, t) in enumerate(zip(ids, texts, strict=True)):
            kept, at, removed, spans, last = [], 0, 0, 0, -1
            for s, e in sorted(gone.get(i, ())):
                if s > last:
                    spans += 1
                    kept.append(t[at:s])
                    at = last = e
                    removed += e - s
                elif e > last:
                    removed += e - last
                    at = last = e
            kept.append(t[at:])
            rest = b"".join(kept)
            out["doc_id"].append(doc_id)
            out["n_bytes"].append(len(t))
            out["n_removed"].append(removed)
            out["n_spans"].append(spans)
            out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
            if keep_text:
                out["text"].append(rest.decode("utf-8", "ignore"))
        table = pa.table({c: pa.array(v, pa.string() if c in ("kept_sha256", "text") else pa.int64()) for c, v in out.items()})
        if carry:
            rows = block["carried"].combine_chunks().flatten()
            for c in carry:
                table = table.append_column(c, pc.struct_field(rows, c))
        return table

    return blocks.groupBy("block").cogroup(both.groupBy("of_block")).applyInArrow(cut_out, schema)
