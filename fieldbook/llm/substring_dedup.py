"""Substring dedup by super-k-mer partitioning.

A window is ``k`` consecutive words. Its minimiser is the ``m``-word run in it with the smallest hash; consecutive
windows with one minimiser form a super-k-mer, which travels as one packed string to the bucket of its minimiser.
Equal windows have equal minimisers, so each bucket sees every copy of its windows and counts them exactly by sorting.

Before the shuffle a task keeps, of equal super-k-mers, only those of the smallest document it has seen: all others
are certainly repeated and are marked at once. So a passage that a third of all documents share reaches its bucket as
a few strings per task, not once per document. In the bucket, super-k-mers whose minimiser came from one document only
are dropped, the words of the rest get exact codes, and windows are ranked by doubling (pairs of ranks are sorted until
a rank stands for ``k`` words): no hash decides that two windows are equal.

There is a bucket for every ``BUCKET_BYTES`` of text, so buckets grow in number and not in size; a task holds one at a time.
A bucket that outgrows ``LIMIT_BYTES`` (a minimiser that very many different windows share) is judged in chunks of that size:
what is repeated within a chunk is marked, and the windows that are left go on, one by one, to the bucket of the whole
window's hash, where they are ranked in the same way.

Defined results: null, empty and blank texts have no words and keep none; texts of fewer than ``k`` words lose nothing; a very
long text is cut into super-k-mers whole; repeats within one document are not removed; rows with the same id are one document
for the purpose of "a smaller id", and each row keeps its own result (spans belong to id and text, so rows that agree in
both, and only those, share them); a null id is larger than any other, so its repeats are removed, and it comes back null; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lm_score import pack, unpack
from .shared import shuffle_partitions
from .tokens import grams, hash_words, mix64, slices, split_words, starts_of

K = 13
M = 3
NULL_ID = (1 << 63) - 1
BUCKET_BYTES = 8 << 20
LIMIT_BYTES = 40 << 20
BLOB_SCHEMA = "bucket int, blob binary, doc bigint, tag bigint, at int, len int"
SPAN_SCHEMA = "doc bigint, tag bigint, at int, len int"


def super_kmers(h: np.ndarray, counts: np.ndarray, k: int = K, m: int = M) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first word, number of windows, minimiser)`` of every super-k-mer, as indices into the flat words."""
    g = mix64(grams(h, m), 99)
    n_windows = len(h) - k + 1
    if n_windows <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = g[:n_windows].copy()
    for step in range(1, k - m + 1):
        np.minimum(low, g[step : step + n_windows], out=low)
    ends = np.repeat(np.cumsum(counts), counts)[:n_windows]
    ok = np.arange(n_windows) + k <= ends  # windows that stay within their text
    fresh = np.ones(n_windows, bool)
    fresh[1:] = (low[1:] != low[:-1]) | ~ok[:-1] | (ends[1:] != ends[:-1])
    first = np.flatnonzero(ok & fresh)
    run = np.cumsum(ok & fresh)
    sizes = np.bincount(run[ok] - 1, minlength=len(first))
    return first, sizes.astype(np.int64), low[first]


def _pack(minimisers: np.ndarray, docs: np.ndarray, tags: np.ndarray, places: np.ndarray, strings: list[bytes]) -> bytes:
    """One blob of super-k-mers in ascending order of their minimisers: 32 bits of each (they only group; a chance meeting costs a
    comparison), the row of each in a table of ids and tags, its place, the strings."""
    order = np.lexsort((tags, docs))
    d, t = docs[order], tags[order]
    new = np.concatenate([[True], (np.diff(d) != 0) | (np.diff(t) != 0)])
    row = np.empty(len(order), np.int64)
    row[order] = np.cumsum(new) - 1
    small = np.uint16 if new.sum() <= 1 << 16 else np.uint32
    low = (minimisers >> np.uint64(32)).astype(np.uint32)
    meta = pack(np.diff(low, prepend=np.uint32(0)), row.astype(small), places.astype(np.uint32), np.diff(d[new], prepend=np.int64(0)), t[new])
    text = b"\n".join(strings)
    return struct.pack("<II", len(meta), len(text)) + meta + zstandard.ZstdCompressor(6).compress(text)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """``(minimisers, ids, tags, places, strings)``; the strings stay compressed: most blobs hold nothing that is shared."""
    size, _ = struct.unpack_from("<II", blob)
    low, row, places, docs, tags = unpack(blob[8 : 8 + size])
    return np.cumsum(low, dtype=np.uint32), np.cumsum(docs)[row], tags[row], places, blob[8 + size :]


def text_bytes(blob: bytes) -> int:
    """Length of a blob's strings, unpacked."""
    return struct.unpack_from("<II", blob)[1]


def spaced_words(flat: pa.Array) -> tuple[bytes, np.ndarray]:
    """All words in one buffer, each followed by a space, and where each begins: a run of words is one slice of it."""
    lengths = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    spaced = pc.cast(pc.binary_join_element_wise(pc.cast(flat, pa.binary()), pa.scalar(b"", pa.binary()), pa.scalar(b" ", pa.binary())), pa.binary())
    return spaced.buffers()[2].to_pybytes(), np.concatenate([[0], np.cumsum(lengths + 1)])


def _by_bucket(hashes: np.ndarray, buckets: int, docs: np.ndarray, tags: np.ndarray, places: np.ndarray, strings: list[bytes]) -> dict[int, bytes]:
    """Blobs of the strings by bucket of their hash."""
    bucket = (mix64(hashes, 7) % np.uint64(buckets)).astype(np.int64)
    by = np.lexsort((hashes, bucket))
    out = {}
    for rows in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(by) else []:
        out[int(bucket[rows[0]])] = _pack(hashes[rows], docs[rows], tags[rows], places[rows], [strings[r] for r in rows.tolist()])
    return out


def partition(docs: np.ndarray, tags: np.ndarray, texts: pa.Array, buckets: int, k: int = K, m: int = M) -> tuple[dict[int, bytes], list[np.ndarray]]:
    """Packed super-k-mers by bucket, and ``(doc, tag, first word, words)`` of spans that are certainly repeated."""
    flat, counts = split_words(texts)
    h = hash_words(flat)
    first, sizes, low = super_kmers(h, counts, k, m)
    if not len(first):
        return {}, [np.zeros(0, np.int64)] * 4
    at = starts_of(counts)
    buffer, begin = spaced_words(flat)
    owner = np.searchsorted(at, first, side="right") - 1
    place = first - at[owner]
    order = np.lexsort((place, docs[owner]))
    held: dict[bytes, tuple[int, list[int]]] = {}
    marked: list[int] = []
    who = docs[owner].tolist()
    lo, hi = begin[first].tolist(), (begin[first + sizes + k - 1] - 1).tolist()
    for i in order.tolist():
        s = buffer[lo[i] : hi[i]]
        old = held.get(s)
        if old is None:
            held[s] = (who[i], [i])
        elif old[0] == who[i]:
            old[1].append(i)
        else:
            marked.append(i)
    strings, index = [], []
    for s, (_, rows) in held.items():
        for i in rows:
            strings.append(s)
            index.append(i)
    index, marked = np.array(index, np.int64), np.array(marked, np.int64)
    packed = _by_bucket(low[index], buckets, docs[owner[index]], tags[owner[index]], place[index], strings)
    return packed, [docs[owner[marked]], tags[owner[marked]], place[marked], sizes[marked] + k - 1]


def _rank(*columns: np.ndarray) -> np.ndarray:
    """Dense rank of each tuple of two small integers, by sorting."""
    a, b = columns
    return np.unique(a.astype(np.int64) * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)


def window_ranks(codes: np.ndarray, k: int) -> np.ndarray:
    """Rank of every run of ``k`` codes: equal ranks exactly for equal runs."""
    rank, width = codes, 1
    while width * 2 <= k:
        rank = _rank(rank[:-width], rank[width:])
        width *= 2
    return rank if width == k else _rank(rank[: len(rank) - (k - width)], rank[k - width :])


def judge_bucket(blobs: list[bytes], k: int = K, buckets: int = 0) -> tuple[list[np.ndarray], dict[int, bytes]]:
    """``(doc, tag, first word, words)`` of the windows of these blobs that also start in a smaller document of them.

    With ``buckets``, the blobs are a part of their bucket: all other windows come too, packed by the bucket of their hash.
    """
    columns = [_unpack(blob) for blob in blobs]
    low, doc, tag, place = (np.concatenate([c[k] for c in columns]) for k in range(4))
    nothing = [np.zeros(0, np.int64)] * 4
    shared = np.ones(len(low), bool)
    if not buckets:  # minimisers seen in one document only cannot hold a repeated window
        order = np.argsort(low, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], np.diff(low[order]) > 0])) if len(order) else np.zeros(0, np.int64)
        shared[order] = np.repeat(np.minimum.reduceat(doc[order], edge) < np.maximum.reduceat(doc[order], edge), np.diff(np.append(edge, len(order))))
    if not shared.any():
        return nothing, {}
    at, kept = 0, []
    for mins, *_, text in columns:
        part = shared[at : at + len(mins)]
        if part.any():
            lines = zstandard.ZstdDecompressor().decompress(text).split(b"\n")
            kept += [lines[i] for i in np.flatnonzero(part).tolist()]
        at += len(mins)
    doc, tag, place = doc[shared], tag[shared], place[shared].astype(np.int64)
    lists = pc.split_pattern(pa.array(kept, pa.binary()).cast(pa.string()), " ")
    del kept, columns
    n, flat = np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten()
    rank = window_ranks(flat.dictionary_encode().indices.to_numpy().astype(np.int64), k)
    starts = starts_of(n)
    ok = np.flatnonzero(np.arange(len(rank)) + k <= np.repeat(starts[1:], n)[: len(rank)])
    owner = np.repeat(np.arange(len(n)), n)[ok]
    r, d, p = rank[ok], doc[owner], place[owner] + ok - starts[owner]
    order = np.lexsort((d, r))
    first = np.concatenate([[True], np.diff(r[order]) > 0])
    least = d[order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    again = d[order] > least
    onward = {}
    if buckets:
        rest = order[~again]
        buffer, begin = spaced_words(flat)
        word = ok[rest]
        strings = [buffer[a:b] for a, b in zip(begin[word].tolist(), (begin[word + k] - 1).tolist())]
        onward = _by_bucket(grams(hash_words(flat), k)[word], buckets, d[rest], tag[owner[rest]], p[rest], strings)
    out = order[again]
    # neighbouring windows of a row become one span
    t = tag[owner]
    out = out[np.lexsort((p[out], t[out], d[out]))]
    d, t, p = d[out], t[out], p[out]
    if not len(d):
        return nothing, onward
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(d) != 0) | (np.diff(t) != 0) | (np.diff(p) > 1)]))
    end = np.append(begin[1:], len(d)) - 1
    return [d[begin], t[begin], p[begin], p[end] - p[begin] + k], onward


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, doc, tag, text``; the tag tells rows of one id apart by their text."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.select("id", F.coalesce("id", F.lit(NULL_ID)).alias("doc"), F.xxhash64("text").alias("tag"), "text")


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, m: int = M) -> DataFrame:
    """``doc, tag, at, len``: spans (first word, number of words) to remove; they may overlap."""
    rows, partitions = _rows(docs, id_col, text_col), shuffle_partitions(docs.sparkSession)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, limit = max(partitions, -(-size // BUCKET_BYTES)), LIMIT_BYTES
    partitions = max(partitions, -(-buckets // 16))
    names = ["bucket", "blob", "doc", "tag", "at", "len"]

    def blob_rows(packed: dict[int, bytes]) -> pa.RecordBatch:
        n = len(packed)
        nulls = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(list(packed), pa.int32()), pa.array(list(packed.values()), pa.binary()), *nulls], names)

    def span_rows(spans: list[np.ndarray]) -> pa.RecordBatch:
        """Spans need no more counting; they ride along, spread over the buckets."""
        n, types = len(spans[0]), (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array((mix64((spans[0] + spans[2]).astype(np.uint64), 3) % np.uint64(buckets)).astype(np.int32)), pa.nulls(n, pa.binary()), *(pa.array(x, t) for x, t in zip(spans, types))], names)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in slices(batch, "text", 6 << 20):
                packed, marked = partition(cut.column("doc").to_numpy(), cut.column("tag").to_numpy(), cut.column("text"), buckets, k, m)
                yield blob_rows(packed)
                yield span_rows(marked)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch | None, list[bytes], bool]]:
        """Spans as they come, and the blobs of each bucket, at most ``limit`` bytes at a time; true: a part of its bucket."""
        now, held, size, split = None, [], 0, False
        for batch in batches:
            ready = batch.filter(pc.is_valid(batch.column("doc")))
            if len(ready):
                yield ready, [], False
            rest = batch.filter(pc.is_valid(batch.column("blob")))
            for b, blob in zip(rest.column("bucket").to_pylist(), rest.column("blob")):
                if b != now:
                    if held:
                        yield None, held, split
                    now, held, size, split = b, [], 0, False
                blob = blob.as_py()
                if held and size + text_bytes(blob) > limit:
                    yield None, held, True
                    held, size, split = [], 0, True
                held.append(blob)
                size += text_bytes(blob)
        if held:
            yield None, held, split

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ready, blobs, split in chunks(batches):
            if ready is not None:
                yield ready
                continue
            spans, onward = judge_bucket(blobs, k, buckets if split else 0)
            yield span_rows(spans)
            yield blob_rows(onward)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            ready = batch.filter(pc.is_valid(batch.column("doc")))
            yield ready.select(names[2:])
            rest = batch.filter(pc.is_valid(batch.column("blob")))
            for b, blob in zip(rest.column("bucket").to_pylist(), rest.column("blob").to_pylist()):
                if b != now and held:
                    yield span_rows(judge_bucket(held, k)[0]).select(names[2:])
                    held = []
                now = b
                held.append(blob)
        if held:
            yield span_rows(judge_bucket(held, k)[0]).select(names[2:])

    deal = lambda df: df.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    judged = deal(rows.select("doc", "tag", "text").mapInArrow(scatter, BLOB_SCHEMA)).mapInArrow(gather, BLOB_SCHEMA)
    return deal(judged).mapInArrow(settle, SPAN_SCHEMA)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, m: int = M) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` of every row: the text without the words of repeated windows."""
    spans = duplicate_spans(docs, id_col, text_col, k, m)
    by_row = spans.groupBy("doc", "tag").agg(F.sort_array(F.collect_set(F.struct("at", "len"))).alias("spans"))
    joined = _rows(docs, id_col, text_col).join(by_row.hint("shuffle_hash"), ["doc", "tag"], "left").select("id", "text", "spans")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in slices(batch, "text"):
                flat, counts = split_words(cut.column("text"))
                at = starts_of(counts)
                cover = np.zeros(len(flat) + 1, np.int64)
                lists = cut.column("spans")
                base = np.repeat(at[:-1], pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                inner = lists.flatten()
                first, size = inner.field("at").to_numpy(zero_copy_only=False), inner.field("len").to_numpy(zero_copy_only=False)
                np.add.at(cover, base + first, 1)
                np.add.at(cover, base + first + size, -1)
                keep = np.cumsum(cover[:-1]) == 0
                kept = np.add.reduceat(np.append(keep, False).astype(np.int64), at[:-1]) * (counts > 0) if len(counts) else counts
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts_of(kept), pa.int32()), flat.filter(pa.array(keep))), " ")
                yield pa.RecordBatch.from_arrays([cut.column("id"), pa.array(counts), pa.array(counts - kept), text], ["doc_id", "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(cut_out, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")
