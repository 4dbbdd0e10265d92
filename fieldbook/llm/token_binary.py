"""Token-ID output as directly addressable codes (DAC).

An id is split into 8-bit chunks, lowest first. Level ``k`` holds the ``k``-th chunk of every id that has one, with a
continuation bitmap (bit set: the id goes on in level ``k+1``) and a rank directory (set bits before each 512-bit block).
Token ``i`` is read with one rank per level: a few bytes are read at known places, and no block is decoded.

Layout: documents are range-partitioned by id; each task encodes its range into *segments* of a few megabytes of text, which go
out as raw bytes (Spark's text writer, uncompressed, with the raw bytes as its lines: so every store that Spark writes works and
the commit protocol covers lost executors). A file has at most ``SEGMENTS_PER_FILE`` segments, each followed by one line feed;
a segment's header names its length and the place of each part, so files are walked without a look at their codes. A manifest
(Parquet) has one row for each segment: file, byte offset, count of all ids before it. :func:`token_at` opens only the files that
hold the wanted positions and seeks in them.

Defined results: null text counts as empty (just the end id); null ids sort first and come back null; repeated rows each get their
own entry, in text order; a very long text is one segment of its own; an empty table writes no segment and an empty manifest;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import scratch_dir, shuffle_partitions
from .tokens import slices

MAGIC = b"FBDAC2\0\0"
HEAD = struct.Struct("<8sQQQI")  # magic, bytes of the segment, documents, ids, levels
LEVEL = struct.Struct("<QQQQ")  # chunks of the level; where its chunks, bitmap and directory begin
BLOCK_BITS = 512
END_ID = 0
CACHE_ENTRIES = 700_000
SEGMENT_BYTES = 6 << 20  # of text
SEGMENTS_PER_FILE = 2  # about 12 MB of text: a file is read back as one value

SEGMENT_SCHEMA = "path string, offset bigint, n_bytes bigint, first_in_file bigint, n_tokens bigint, n_docs bigint"


# ---------------------------------------------------------------- codes


def _rank_directory(bits: np.ndarray) -> np.ndarray:
    """Set bits before each block of ``BLOCK_BITS``."""
    pad = -len(bits) % BLOCK_BITS
    blocks = np.pad(bits, (0, pad)).reshape(-1, BLOCK_BITS).sum(axis=1, dtype=np.int64)
    return np.concatenate([[0], np.cumsum(blocks)[:-1]]).astype("<u4") if len(blocks) else np.zeros(0, "<u4")


def dac_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of ``(chunks uint8, continuation bitmap uint8, rank directory uint32)``."""
    rest, levels = ids.astype(np.uint64), []
    while True:
        chunks = (rest & np.uint64(255)).astype(np.uint8)
        more = rest > 255
        levels.append((chunks, np.packbits(more, bitorder="little"), _rank_directory(more)))
        if not more.any():
            return levels
        rest = rest[more] >> np.uint64(8)


def pack_segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One self-describing segment: header, level table, document table, then the levels."""
    valid = np.array([x is not None for x in doc_ids], np.uint8)
    keys = np.array([x or 0 for x in doc_ids], "<i8")
    levels = dac_levels(ids)
    out = [keys.tobytes(), valid.tobytes(), lengths.astype("<u8").tobytes()]
    at = HEAD.size + LEVEL.size * len(levels) + sum(map(len, out))
    table = []
    for parts in levels:
        places = []
        for x in parts:
            places.append(at)
            out.append(x.tobytes())
            at += len(out[-1])
        table.append(LEVEL.pack(len(parts[0]), *places))
    return b"".join([HEAD.pack(MAGIC, at, len(doc_ids), len(ids), len(levels)), *table, *out])


class Segment:
    """Reader of one segment of an open file; ``token(i)`` seeks to the few bytes it needs."""

    def __init__(self, source: BinaryIO, offset: int = 0):
        self.source, self.offset = source, offset
        magic, self.n_bytes, self.n_docs, self.n_tokens, n_levels = HEAD.unpack(self._read(0, HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token segment")
        self._docs = HEAD.size + LEVEL.size * n_levels
        self.levels = list(LEVEL.iter_unpack(self._read(HEAD.size, LEVEL.size * n_levels)))

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(self.offset + at)
        got = self.source.read(n)
        if len(got) < n:
            raise ValueError("the file ends within a segment")
        return got

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """``(ids, numbers of token ids)`` of the documents."""
        raw, n = self._read(self._docs, 17 * self.n_docs), self.n_docs
        keys, valid, lengths = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "u1", n, 8 * n), np.frombuffer(raw, "<u8", n, 9 * n)
        return [int(k) if v else None for k, v in zip(keys, valid)], lengths.astype(np.int64)

    def token(self, i: int) -> int:
        """Random access to one id."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for k, (_, chunks, bitmap, ranks) in enumerate(self.levels):
            value |= self._read(chunks + i, 1)[0] << (8 * k)
            block = i // BLOCK_BITS
            bits = int.from_bytes(self._read(bitmap + block * (BLOCK_BITS // 8), i // 8 - block * (BLOCK_BITS // 8) + 1), "little")
            inside = i - block * BLOCK_BITS
            if not bits >> inside & 1:
                break
            (before,) = struct.unpack("<I", self._read(ranks + 4 * block, 4))
            i = before + (bits & ((1 << inside) - 1)).bit_count()
        return value

    def all_tokens(self) -> np.ndarray:
        """Every id, level by level (the scan of the read-back)."""
        value = np.zeros(self.n_tokens, np.uint64)
        where = np.arange(self.n_tokens)
        for k, (n, chunks, bitmap, ranks) in enumerate(self.levels):
            value[where] |= np.frombuffer(self._read(chunks, n), np.uint8).astype(np.uint64) << np.uint64(8 * k)
            where = where[np.unpackbits(np.frombuffer(self._read(bitmap, ranks - bitmap), np.uint8), count=n, bitorder="little").astype(bool)]
        return value.astype("<u4")


def walk(source: BinaryIO) -> Iterator[Segment]:
    """The segments of an open file, in order."""
    at, end = 0, source.seek(0, io.SEEK_END)
    while at < end:
        segment = Segment(source, at)
        if at + segment.n_bytes > end:
            raise ValueError("the file ends within a segment")
        yield segment
        at += segment.n_bytes + 1  # the line feed after it


# ---------------------------------------------------------------- tokenizing


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _encode(path: str, texts: list[str]) -> list[np.ndarray]:
    return [np.array(e.ids, np.uint32) for e in _tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


class PieceCache:
    """Ids of pieces seen by this worker process, in one pool.

    When ``CACHE_ENTRIES`` would be passed, the pieces that were looked up more than once stay, at most half of them all: most pieces
    of a corpus are met once and take no room for long, the common ones are encoded once.
    """

    def __init__(self, path: str):
        self.path = path
        vocab = _tokenizer(path).get_vocab()
        self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes that each id stands for
        for token, i in vocab.items():
            self.n_bytes[i] = len(token)  # the byte-level alphabet has a character for each byte
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.sizes, self.pools = [], []
        self.flat = None
        self.hits = np.zeros(CACHE_ENTRIES, np.int32)

    def shrink(self) -> None:
        """Keeps the pieces in use, the most used ones first."""
        n = len(self.slot)
        if not n:
            return
        self._flatten()
        hits = self.hits[:n]
        keep = hits > 1
        if keep.sum() > CACHE_ENTRIES // 2:
            keep = hits > np.partition(hits, n - CACHE_ENTRIES // 2)[n - CACHE_ENTRIES // 2]
        names = [x for x, k in zip(self.slot, keep) if k]
        sizes = self.sizes[0][keep]
        self.pools, self.sizes, self.flat = [self.pools[0][np.repeat(keep, self.sizes[0])]], [sizes], None
        self.slot = dict(zip(names, range(len(names))))
        self.hits[: len(names)] = hits[keep] // 2
        self.hits[len(names) :] = 0

    def _flatten(self) -> None:
        if self.flat is None:
            self.sizes, self.pools = [np.concatenate(self.sizes)], [np.concatenate(self.pools)]
            self.flat = np.concatenate([[0], np.cumsum(self.sizes[0])])

    def add(self, pieces: list[str]) -> None:
        """Encodes pieces that all start with a space: a run of them is a text whose ids fall apart by byte lengths."""
        for at in range(0, len(pieces), 4000):
            part = pieces[at : at + 4000]
            ids = np.array(_tokenizer(self.path).encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum([len(x.encode()) for x in part])
            upto = np.cumsum(self.n_bytes[ids])
            cut = np.searchsorted(upto, ends)
            if not (len(ids) and np.array_equal(upto[np.minimum(cut, len(ids) - 1)], ends)):
                single = _encode(self.path, part)
                ids, cut = np.concatenate(single), np.cumsum([len(x) for x in single]) - 1
            self.slot.update(zip(part, range(len(self.slot), len(self.slot) + len(part))))
            self.sizes.append(np.diff(cut + 1, prepend=0))
            self.pools.append(ids)
        self.flat = None

    def lookup(self, pieces: list[str]) -> pa.ListArray:
        """The ids of each piece."""
        k = self._places(pieces)
        missing = np.flatnonzero(k < 0)
        if len(self.slot) + len(missing) > CACHE_ENTRIES:
            self.shrink()
            k = self._places(pieces)
            missing = np.flatnonzero(k < 0)
            if len(self.slot) + len(missing) > CACHE_ENTRIES:  # one slice has more pieces than there is room for beside the rest
                self.clear()
                missing = np.arange(len(pieces))
        if len(missing):
            k[missing] = len(self.slot) + np.arange(len(missing))
            self.add([pieces[j] for j in missing.tolist()])
        self._flatten()
        if len(self.slot) > len(self.hits):
            self.hits = np.concatenate([self.hits, np.zeros(len(self.slot) - len(self.hits), np.int32)])
        self.hits[k] += 1
        return pa.ListArray.from_arrays(pa.array(self.flat.astype(np.int32)), pa.array(self.pools[0])).take(pa.array(k))

    def _places(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.slot.get, pieces, repeat(-1)), np.int64, len(pieces))


@lru_cache(maxsize=2)
def _cache(path: str) -> PieceCache:
    return PieceCache(path)


#: Texts in which white space stands next to a space, at an end, or that hold the special token are encoded whole.
_WHOLE = r"^[\s\pZ\x{85}\x1c-\x1f\x0b]|[\s\pZ\x{85}\x1c-\x1f\x0b]$| [\s\pZ\x{85}\x1c-\x1f\x0b]|[\s\pZ\x{85}\x1c-\x1f\x0b] |<\|"


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each followed by ``END_ID``, and the number of ids of each text.

    Byte-level BPE never merges across a single space before a non-space, so a text falls into pieces
    (a space and what follows it) that are encoded once per distinct piece.
    """
    n = len(texts)
    whole = pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False).astype(bool)
    pieces = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
    counts = np.diff(pieces.offsets.to_numpy()).astype(np.int64)
    flat = pieces.flatten().dictionary_encode()
    codes = flat.indices.to_numpy().astype(np.int64)
    words = flat.dictionary.to_pylist()
    # a piece at the start of its text has no space before it
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    later = np.ones(len(codes), bool)
    later[first] = False
    used = np.flatnonzero(np.bincount(codes[later], minlength=len(words)))
    slot = np.zeros(len(words), np.int64)
    slot[used] = np.arange(len(used))
    opening, outer = np.unique(codes[first], return_inverse=True)
    codes[first] = len(used) + outer
    codes[later] = slot[codes[later]]
    single = _encode(path, [words[k] for k in opening])
    known = _cache(path).lookup([" " + words[k] for k in used]) if len(used) else pa.array([], pa.list_(pa.uint32()))
    # a last list is the end id; each text's pieces are followed by it
    lists = pa.concat_arrays([known, pa.array([*single, np.array([END_ID], np.uint32)], pa.list_(pa.uint32()))])
    edges = np.cumsum(counts)
    codes = np.insert(codes, edges, len(lists) - 1)
    out = lists.take(pa.array(codes)).flatten().to_numpy()
    upto = np.cumsum(np.diff(lists.offsets.to_numpy())[codes], dtype=np.int64)
    lengths = np.diff(upto[edges + np.arange(n)], prepend=0)
    if whole.any():
        parts = np.split(out, np.cumsum(lengths)[:-1])
        rows = np.flatnonzero(whole)
        for k, e in zip(rows, _encode(path, [texts[int(k)].as_py() for k in rows])):
            parts[k] = np.append(e, np.uint32(END_ID))
        lengths = np.array([len(p) for p in parts], np.int64)
        out = np.concatenate(parts)
    return out, lengths


# ---------------------------------------------------------------- the job


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/tokens").select("path", "content")


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes segment files (``tokens/``) and manifest (``manifest/``) in ascending id order under ``path``, which it returns."""
    spark = docs.sparkSession
    path = path or scratch_dir(spark, "token_ids")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in slices(batch, "text", SEGMENT_BYTES):
                ids, lengths = encode_texts(pc.fill_null(cut.column("text"), ""), tokenizer_path)
                yield pa.RecordBatch.from_arrays([pa.array([pack_segment(cut.column("id").to_pylist(), lengths, ids)], pa.binary())], ["segment"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows, first = [], 0
                for x in walk(pa.BufferReader(content.as_buffer())):
                    rows.append((name, x.offset, x.n_bytes, first, x.n_tokens, x.n_docs))
                    first += x.n_tokens
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], [c.split()[0] for c in SEGMENT_SCHEMA.split(", ")])

    ranged = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .repartitionByRange(shuffle_partitions(spark), F.col("id"))
        .sortWithinPartitions("id", "text")
    )
    # a cast of bytes to a string keeps them as they are, and the text writer writes them so
    raw = ranged.mapInArrow(encode, "segment binary").select(F.col("segment").cast("string").alias("value"))
    raw.write.option("lineSep", "\n").option("compression", "none").option("maxRecordsPerFile", SEGMENTS_PER_FILE).text(f"{path}/tokens")
    segments = _files(spark, path).mapInArrow(index, SEGMENT_SCHEMA)
    # files ascend by task, then by number within the task; only totals of files and tasks are added up by windows
    segments = segments.withColumns({"part": F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1).cast("int"), "file": F.regexp_extract("path", r"-c(\d+)[^/]*$", 1).cast("int")})
    segments.write.parquet(f"{path}/index")
    segments = spark.read.parquet(f"{path}/index")
    files = segments.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    parts = files.groupBy("part").agg(F.sum("n").alias("n"))  # one row for each task of the range partitioning
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before(Window.orderBy("part")).alias("base"))
    files = files.join(parts, "part").select("part", "file", (F.col("base") + before(Window.partitionBy("part").orderBy("file"))).alias("base"))
    manifest = segments.join(files, ["part", "file"]).select("path", "offset", "n_bytes", (F.col("base") + F.col("first_in_file")).alias("first_token"), "n_tokens", "n_docs")
    manifest.write.parquet(f"{path}/manifest")
    return path


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``path, offset, n_bytes, first_token, n_tokens, n_docs`` of every segment."""
    return spark.read.parquet(f"{path}/manifest")


def token_at(spark: SparkSession, path: str, positions: list[int]) -> list[int]:
    """The ids at some positions of the whole output; reads the manifest rows and the few bytes that they need."""
    from pyarrow import fs

    m = read_manifest(spark, path)
    near = F.exists(F.lit(positions), lambda p: (F.col("first_token") <= p) & (p < F.col("first_token") + F.col("n_tokens")))
    found = sorted((r["first_token"], r["n_tokens"], r["path"], r["offset"]) for r in m.where(near).collect()) if positions else []
    out = {}
    for first, n, name, offset in found:
        store, place = fs.FileSystem.from_uri(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name)
        with store.open_input_file(place) as source:
            segment = Segment(source, offset)
            out |= {p: segment.token(p - first) for p in positions if first <= p < first + n}
    if len(out) < len(set(positions)):
        raise IndexError("no such position")
    return [out[p] for p in positions]


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    # one row for each file: the position of its first id
    first = read_manifest(spark, path).where("offset = 0").select(F.col("path").alias("_path"), F.col("first_token").alias("base"))
    placed = _files(spark, path).join(first, F.col("path") == F.col("_path")).select("base", "content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, content in zip(batch.column("base").to_pylist(), batch.column("content")):
                for segment in walk(pa.BufferReader(content.as_buffer())):
                    doc_ids, lengths = segment.documents()
                    starts, ids = np.concatenate([[0], np.cumsum(lengths)]), segment.all_tokens()
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts[:-1], starts[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts[:-1] + base), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    base += segment.n_tokens

    return placed.mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
