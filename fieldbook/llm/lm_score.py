"""Language-model scoring by deleted interpolation (Jelinek-Mercer) of word bigrams.

``P(w|h) = l2[b] c(h,w)/c(h) + l1[b] P1(w) + l0[b] / (V+1)``; ``b`` is the frequency bucket of the context ``h``. The weights
of each bucket are learned by expectation-maximisation: one tenth of the training documents is deleted from the counts
and all its bigrams are the held-out counts. Counts cover all training documents and are exact.

How the job moves data:

1. Unigram counts of all training words, pre-aggregated, one shuffle by word.
2. The most frequent words (``VOCABULARY`` of them, a fixed bound) are broadcast. Pairs of the ``TOP`` most frequent ones,
   which no partitioning could spread, are counted in a dense matrix of fixed size. The same pass sends all other bigrams,
   pre-aggregated and packed, to the bucket of their hash, where each held-out bigram meets its count in the kept texts;
   counts of words outside the vocabulary are joined. Expectation-maximisation sees the matrix cell by cell and the other
   held-out counts summed, all of them, in a fixed grid of probabilities (``GRID`` cells per factor of two) with their means.
3. Every other bigram occurrence travels once, packed by task and bucket, to the bucket of its hash, where its training
   count is taken and its log probability added up by row. A bucket gets at most a fraction ``1/TOP`` of all tokens
   from one bigram. Words outside the vocabulary bring their contexts to one bucket and contexts outside it bring their
   successors, so their counts are exact too.
4. Bigrams of two words outside the vocabulary go on from the bucket of the context to that of the word, which has the
   word's count; the same shuffle adds up the sums by row.
5. Sums by row: one shuffle of packed rows.

Memory: there is a bucket for every ``BUCKET_TOKENS`` training tokens, so buckets grow in number and not in size; a partition
has several, sorted by bucket, and a task holds one at a time. Texts are read ``SLICE`` bytes at a time into compact columns,
which are packed every ``FLUSH`` tokens.

``P1`` is the relative frequency in the training texts of every word, 0 for words that they don't have; the size of the
vocabulary decides only which way an occurrence takes.
Hashes are 64 bits for words and, within a bucket, 48 bits for bigrams; the chance of a clash does not grow with the corpus.

Defined results: every input row gives one row, also where ids repeat or are null (rows are told apart by a number of their
own); a null id counts as the empty string in the fold rule and comes back null; null, empty and blank texts have one token,
the end; equal texts of equal folds get equal scores; a very long text is scored whole, in one slice of its own; without
training documents every token is unknown; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_id import id_crc
from .shared import materialize, shuffle_partitions
from .tokens import hash_words, mix64, owners, slices, split_words, starts_of

VOCABULARY = 1 << 19
TOP = 1024
GRID = 16
BUCKETS = 16
EM_ROUNDS = 60
SLICE = 2 << 20
FLUSH = 1 << 20
BUCKET_TOKENS = 2 << 20
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)  # reserved hashes
NULL_ID = -(1 << 63)

PACKED_SCHEMA = "bucket int, kind int, blob binary"
BIGRAMS, SUMS, WORDS, WAITING = range(4)  # kinds of blobs: bigrams, sums by row, counts of words, bigrams that wait for them
PAIRS = 4  # of training: cells of the pair matrix
COUNT_SCHEMA = "kind int, at bigint, h bigint, w bigint, c2 bigint, ch bigint, cw bigint, m bigint, s2 double, s1 double"
GRID_SCHEMA = "at bigint, m bigint, s2 double, s1 double"
SUM_SCHEMA = "doc bigint, n_tokens bigint, known bigint, base double, score double"


def fold(ids: np.ndarray) -> np.ndarray:
    """crc32 of the id as text, modulo 10."""
    return np.fromiter((zlib.crc32(b"" if i == NULL_ID else str(i).encode()) % 10 for i in ids.tolist()), np.int64, len(ids))


def sequence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(previous word, word, count of each text)`` hashes: every text is its words (A-Z lower-cased), then the end."""
    flat, counts = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    h, at = hash_words(flat), starts_of(counts)
    w = np.insert(h, at[1:], END)
    prev = np.insert(h, at[:-1], START)
    return prev, w, counts + 1


def bucket_of(c: np.ndarray) -> np.ndarray:
    """Frequency bucket of a context count: 0 for unseen, then powers of two."""
    c = np.asarray(c, np.float64)
    return np.where(c < 1, 0, np.minimum(BUCKETS - 1, np.floor(np.log2(np.maximum(c, 1))) + 1)).astype(np.int64)


def em(m: np.ndarray, p2: np.ndarray, p1: np.ndarray, p0: float, bucket: np.ndarray, rounds: int = EM_ROUNDS) -> np.ndarray:
    """``BUCKETS x 3`` weights (bigram, unigram, uniform) that raise the likelihood of the held-out counts ``m``."""
    lam = np.full((BUCKETS, 3), np.nan)
    for b in np.unique(bucket).tolist():
        at = bucket == b
        p = np.stack([p2[at], p1[at], np.full(at.sum(), p0)], axis=1)
        w = np.array([0.4, 0.4, 0.2]) if b else np.array([0.0, 0.7, 0.3])
        for _ in range(rounds):
            share = p * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * m[at][:, None]).sum(axis=0) / m[at].sum()
        w = np.maximum(w, [1e-4 if b else 0.0, 1e-4, 1e-4])
        lam[b] = w / w.sum()
    learned = np.flatnonzero(~np.isnan(lam[:, 0]))
    for b in np.flatnonzero(np.isnan(lam[:, 0])).tolist():  # a bucket without held-out counts takes its nearest neighbour's
        near = [k for k in learned.tolist() if k > 0] if b else []
        lam[b] = lam[min(near, key=lambda k: abs(k - b))] if near else ([0.4, 0.4, 0.2] if b else [0.0, 0.8, 0.2])
    return lam


# ---------------------------------------------------------------- blobs


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b""


def pack(*columns: np.ndarray) -> bytes:
    """Columns as byte planes, compressed together."""
    head = struct.pack("<I", len(columns)) + b"".join(struct.pack("<4sQ", c.dtype.str[1:].encode().ljust(4), len(c)) for c in columns)
    return zstandard.ZstdCompressor(3).compress(head + b"".join(_planes(c) for c in columns))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,), at, out = struct.unpack_from("<I", raw), 4, []
    heads = [struct.unpack_from("<4sQ", raw, 4 + 12 * k) for k in range(n)]
    at += 12 * n
    for kind, size in heads:
        dtype = np.dtype("<" + kind.decode().strip())
        planes = np.frombuffer(raw, np.uint8, size * dtype.itemsize, at).reshape(dtype.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
        at += size * dtype.itemsize
    return out


# ---------------------------------------------------------------- model


class Model:
    """What every task needs: vocabulary counts, the pair matrix, weights and totals. Of fixed size."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, kept: np.ndarray, totals: dict):
        order = np.argsort(words)
        self.words, self.counts, self.kept = words[order], counts[order], kept[order]
        self.total, self.vocab = totals["total"], totals["vocab"]  # N and V of the base score
        self.kept_total = totals["kept"]
        self.p0 = 1.0 / (self.vocab + 1)
        forced = np.isin(self.words, [START, END])
        rank = np.argsort(-(self.counts + forced * (1 << 60)), kind="stable")[:TOP]
        self.top = np.full(len(self.words), -1, np.int32)
        self.top[rank] = np.arange(len(rank))
        self.pairs = np.zeros((TOP, TOP), np.int64)
        self.weights = np.zeros((BUCKETS, 3))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Vocabulary index of each hash, -1 outside."""
        if not len(self.words):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at, -1)


def at(values: np.ndarray, index: np.ndarray, default: int = 0) -> np.ndarray:
    """Values by index; ``default`` where the index is negative."""
    return np.where(index < 0, default, values[index]) if len(values) else np.full(len(index), default)


def pair_key(prev: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(mix64(prev, 5) * np.uint64(0x100000001B3) + w, 6)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(rows, fold, previous, word, counts)`` slice by slice."""
    for batch in batches:
        for cut in slices(batch, "text", SLICE):
            yield cut, fold(pc.fill_null(cut.column("id"), NULL_ID).to_numpy()), *sequence(cut.column("text"))


def flush_tokens(buckets: int) -> int:
    """Tokens that a task gathers before it packs them: enough for blobs of some size, up to a fixed bound."""
    return min(4 * FLUSH, max(FLUSH, 64 * buckets))


def unigrams(rows: DataFrame) -> DataFrame:
    """``(h, n, kept)`` of all training tokens; ``kept``: without the deleted tenth. ``START`` counts training texts."""

    def merged(held: list[list[np.ndarray]]) -> list[np.ndarray]:
        words, inverse = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return [words, *(np.bincount(inverse, weights=np.concatenate([h[k] for h in held]), minlength=len(words)).astype(np.int64) for k in (1, 2))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for _, f, _, w, counts in _cuts(batches):
            part = np.repeat(f, counts)
            trained = part != 0
            one = [w[trained], np.ones(int(trained.sum()), np.int64), (part[trained] != 1).astype(np.int64)]
            texts = [np.array([START], np.uint64), np.array([(f != 0).sum()]), np.array([(f > 1).sum()])]
            held.append(merged([one, texts]))
            if sum(len(h[0]) for h in held) > FLUSH:
                yield _unigram_batch(merged(held))
                held = []
        if held:
            yield _unigram_batch(merged(held))

    return rows.mapInArrow(count, "h bigint, n bigint, kept bigint").groupBy("h").agg(F.sum("n").alias("n"), F.sum("kept").alias("kept"))


def _unigram_batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[0].view(np.int64)), *(pa.array(c) for c in columns[1:])], ["h", "n", "kept"])


# ---------------------------------------------------------------- buckets


class Buckets:
    """How hashes are dealt: ``n`` buckets, several to a partition."""

    def __init__(self, tokens: int, partitions: int):
        self.n = max(partitions, -(-tokens // BUCKET_TOKENS))
        self.partitions = max(partitions, -(-self.n // 16))
        self.shift = np.uint64(max(0, 16 - self.n.bit_length()))  # leaves 48 bits or more within a bucket

    def key(self, prev: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Bigram keys, as long as the number of buckets asks for; buckets ascend with them."""
        return pair_key(prev, w) >> self.shift

    def of_key(self, key: np.ndarray) -> np.ndarray:
        return (((key << self.shift) >> np.uint64(32)) * np.uint64(self.n) >> np.uint64(32)).astype(np.int32)

    def of_hash(self, x: np.ndarray, seed: int) -> np.ndarray:
        return (mix64(x, seed) % np.uint64(self.n)).astype(np.int32)

    def edges(self, to: np.ndarray) -> np.ndarray:
        """First row of each bucket, and the end, of rows sorted by bucket."""
        return np.searchsorted(to, np.arange(self.n + 1))

    def deal(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.partitions, "bucket").sortWithinPartitions("bucket")


def _packed(kinds: int | list[int], to: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    kinds = [kinds] * len(to) if isinstance(kinds, int) else kinds
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "blob"])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """``(bucket, blobs of each kind)`` of rows sorted by bucket: one bucket is held at a time."""
    now, held = None, None
    for batch in batches:
        for b, kind, blob in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob")):
            if b != now:
                if held is not None:
                    yield now, held
                now, held = b, [[] for _ in range(PAIRS + 1)]
            held[kind].append(blob.as_py())
    if held is not None:
        yield now, held


def _as_arrays(df: DataFrame, *columns: str) -> list[np.ndarray]:
    t = df.select(*columns).toArrow()
    return [t.column(c).to_numpy() for c in columns]


def cells_of(kept_total: int, m: np.ndarray, c2: np.ndarray, ch: np.ndarray, cw: np.ndarray) -> tuple[np.ndarray, ...]:
    """Held-out counts by grid cell: ``(cell, sum of m, sums of m p2 and m p1)``; a cell is context bucket, p2, p1."""
    p2, p1 = c2 / np.maximum(ch, 1), cw / max(1, kept_total)
    step = lambda p: np.where(p > 0, np.clip(np.floor(-np.log2(np.where(p > 0, p, 1)) * GRID) + 1, 1, 1023), 0).astype(np.int64)
    cell, inverse = np.unique((bucket_of(ch) << 20) | (step(p2) << 10) | step(p1), return_inverse=True)
    return cell, *(np.bincount(inverse, weights=x, minlength=len(cell)).astype(t) for x, t in ((m, np.int64), (m * p2, float), (m * p1, float)))


def _count_rows(kind: int, n: int, **columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    names = ["at", "h", "w", "c2", "ch", "cw", "m"]
    cols = [pa.array(columns[c]) if c in columns else pa.nulls(n, pa.int64()) for c in names]
    sums = [pa.array(columns[c]) if c in columns else pa.nulls(n, pa.float64()) for c in ("s2", "s1")]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *cols, *sums], ["kind", *names, "s2", "s1"])


class CountsOut:
    """Bigrams of training texts on their way to the buckets: kept ones ``(key, n)``, deleted ones with their words."""

    def __init__(self, m: Model, to: Buckets):
        self.m, self.to = m, to
        self.pairs = np.zeros((2, m.pairs.size), np.int64)  # pairs of top words: kept, deleted
        self.kept, self.deleted, self.size = [], [], 0

    def add(self, part: np.ndarray, prev: np.ndarray, w: np.ndarray) -> None:
        p, q = self.m.find(prev), self.m.find(w)
        tp, tq = at(self.m.top, p, -1), at(self.m.top, q, -1)
        both = (tp >= 0) & (tq >= 0)
        cell = tp.astype(np.int64) * len(self.m.pairs) + tq
        for k, mine in enumerate((part > 1, part == 1)):
            self.pairs[k] += np.bincount(cell[both & mine], minlength=self.m.pairs.size)
        keep, out = ~both & (part > 1), ~both & (part == 1)
        self.kept.append(np.unique(self.to.key(prev[keep], w[keep]), return_counts=True))
        key, index, n = np.unique(self.to.key(prev[out], w[out]), return_index=True, return_counts=True)
        self.deleted.append((key, n, *(x[out][index] for x in (p.astype(np.int32), q.astype(np.int32), prev, w))))
        self.size += len(self.kept[-1][0]) + 2 * len(key)

    def flush(self) -> pa.RecordBatch:
        key, n = map(np.concatenate, zip(*self.kept))
        kept, inverse = np.unique(key, return_inverse=True)
        n = np.bincount(inverse, weights=n, minlength=len(kept)).astype(np.uint32)
        key, dn, dp, dq, dh, dw = map(np.concatenate, zip(*self.deleted))
        deleted, index, inverse = np.unique(key, return_index=True, return_inverse=True)
        dn = np.bincount(inverse, weights=dn, minlength=len(deleted)).astype(np.uint32)
        dp, dq, dh, dw = (x[index] for x in (dp, dq, dh, dw))
        ka, da = (self.to.edges(self.to.of_key(x)) for x in (kept, deleted))
        full = np.flatnonzero((np.diff(ka) > 0) | (np.diff(da) > 0)).tolist()
        blobs = []
        for k in full:
            a, b = slice(ka[k], ka[k + 1]), slice(da[k], da[k + 1])
            blobs.append(pack(np.diff(kept[a], prepend=np.uint64(0)), n[a], np.diff(deleted[b], prepend=np.uint64(0)), dn[b], dp[b], dq[b], dh[b][dp[b] < 0], dw[b][dq[b] < 0]))
        self.kept, self.deleted, self.size = [], [], 0
        return _packed(BIGRAMS, full, blobs)

    def cells(self) -> pa.RecordBatch:
        """The pair matrices of the task, dealt by cell."""
        cells = np.flatnonzero(self.pairs.any(axis=0))
        places = min(self.to.n, 64)
        deal = [(k, x) for k in range(places) if len(x := cells[cells % places == k])]
        return _packed(PAIRS, [k for k, _ in deal], [pack(np.diff(x, prepend=0), *(p[x] for p in self.pairs)) for _, x in deal])


def _gather_counts(m: Model, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Held-out bigrams of one bucket with their counts in the kept texts: grid cells, and rows where a word is outside."""
    cols = [[] for _ in range(7)]
    for blob in blobs:
        k, n, d, dn, dp, dq, dh, dw = unpack(blob)
        h, w = np.zeros(len(d), np.uint64), np.zeros(len(d), np.uint64)
        h[dp < 0], w[dq < 0] = dh, dw
        for c, x in zip(cols, (np.cumsum(k, dtype=np.uint64), n, np.cumsum(d, dtype=np.uint64), dn, np.stack([dp, dq], axis=1), h, w)):
            c.append(x)
    kept, n, deleted, dn, index, h, w = map(np.concatenate, cols)
    types, first, inverse = np.unique(deleted, return_index=True, return_inverse=True)
    if not len(types):
        return
    count = np.bincount(inverse, weights=dn).astype(np.int64)
    i = np.minimum(np.searchsorted(types, kept), len(types) - 1)
    hit = types[i] == kept
    c2 = np.bincount(i[hit], weights=n[hit], minlength=len(types)).astype(np.int64)
    (p, q), h, w = index[first].T, h[first], w[first]
    ch, cw, hot = at(m.kept, p), at(m.kept, q), (p >= 0) & (q >= 0)
    cell, s, s2, s1 = cells_of(m.kept_total, count[hot], c2[hot], ch[hot], cw[hot])
    yield _count_rows(2, len(cell), at=cell, m=s, s2=s2, s1=s1)
    rest = ~hot
    outside = lambda x, k: pa.array(x[rest].view(np.int64), mask=k[rest] >= 0)
    yield _count_rows(0, int(rest.sum()), h=outside(h, p), w=outside(w, q), c2=c2[rest], ch=ch[rest], cw=cw[rest], m=count[rest])


def train(rows: DataFrame, vocabulary: int = VOCABULARY) -> Model:
    """Counts, vocabulary, pair matrix and interpolation weights."""
    start = F.lit(int(START))
    uni = materialize(unigrams(rows).where("n > 0"), "unigrams")
    t = uni.where(F.col("h") != start).agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum("kept").alias("k")).first()
    totals = {"total": t["n"] or 0, "vocab": t["v"], "kept": t["k"] or 0}
    # the smallest count that the vocabulary reaches down to, from a histogram of a fixed number of cells
    cell = F.floor(F.log2("n") * 16).cast("int")
    size, floor = 0, None
    for r in sorted(uni.groupBy(cell.alias("c")).count().collect(), key=lambda r: -r["c"]):
        if size + r["count"] > vocabulary:
            break
        size, floor = size + r["count"], r["c"]
    hot = uni.where((cell >= F.lit(floor if floor is not None else 1 << 30)) | F.col("h").isin(int(START), int(END)))
    words, counts, kept = _as_arrays(hot, "h", "n", "kept")
    model = Model(words.view(np.uint64), counts, kept, totals)
    spark = rows.sparkSession
    first, to = spark.sparkContext.broadcast(model), Buckets(totals["total"], shuffle_partitions(spark))
    limit = flush_tokens(to.n)

    def scatter_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = CountsOut(first.value, to)
        for _, f, prev, w, counts in _cuts(batches):
            out.add(np.repeat(f, counts), prev, w)
            if out.size > limit:
                yield out.flush()
        if out.size:
            yield out.flush()
        yield out.cells()

    def gather_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _by_bucket(batches):
            if held[PAIRS]:
                got = [unpack(x) for x in held[PAIRS]]
                place, inverse = np.unique(np.concatenate([np.cumsum(g[0]) for g in got]), return_inverse=True)
                kept, out = (np.bincount(inverse, weights=np.concatenate([g[k] for g in got])).astype(np.int64) for k in (1, 2))
                yield _count_rows(1, len(place), at=place, c2=kept, m=out)
            if held[BIGRAMS]:
                yield from _gather_counts(first.value, held[BIGRAMS])

    def grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cells_of(totals["kept"], *(batch.column(c).to_numpy() for c in ("m", "c2", "ch", "cw")))], ["at", "m", "s2", "s1"])

    sent = to.deal(rows.where(id_crc("id") % 10 != 0).mapInArrow(scatter_counts, PACKED_SCHEMA))
    found = materialize(sent.mapInArrow(gather_counts, COUNT_SCHEMA), "bigrams")
    place, n, out = _as_arrays(found.where("kind = 1"), "at", "c2", "m")  # at most TOP * TOP rows
    model.pairs.ravel()[place] = n + out
    # held-out bigrams with a word outside the vocabulary: its count in the kept texts is joined
    rest = found.where("kind = 0").select("h", "w", "c2", "ch", "cw", "m")
    for word, count in (("h", "ch"), ("w", "cw")):
        of = uni.select(F.col("h").alias(word), F.col("kept").alias("_kept"))
        known = rest.where(F.col(word).isNull())
        joined = rest.where(F.col(word).isNotNull()).join(of, word, "left").withColumn(count, F.coalesce("_kept", F.lit(0))).select(*rest.columns)
        rest = known.unionByName(joined)
    cells = rest.select("m", "c2", "ch", "cw").mapInArrow(grid, GRID_SCHEMA).unionByName(found.where("kind = 2").select("at", "m", "s2", "s1"))
    cell, gm, g2, g1 = _as_arrays(cells.groupBy("at").agg(*(F.sum(c).alias(c) for c in ("m", "s2", "s1"))), "at", "m", "s2", "s1")
    place, n, out = place[out > 0], n[out > 0], out[out > 0]
    of_rank = np.zeros(TOP, np.int64)
    ranked = np.flatnonzero(model.top >= 0)
    of_rank[model.top[ranked]] = model.kept[ranked]
    ch, cw = of_rank[place // TOP], of_rank[place % TOP]
    model.weights = em(
        np.concatenate([out, gm]).astype(float), np.concatenate([n / np.maximum(ch, 1), g2 / gm]), np.concatenate([cw / max(1, totals["kept"]), g1 / gm]),
        model.p0, np.concatenate([bucket_of(ch), cell >> 20]),
    )
    first.unpersist()
    return model


# ---------------------------------------------------------------- scoring


class BigramsOut:
    """Occurrences on their way to the buckets, in compact columns, and what each row has without them."""

    def __init__(self, m: Model, to: Buckets):
        self.m, self.to = m, to
        self.clear()

    def clear(self) -> None:
        self.far, self.low_h, self.low_w, self.local, self.docs, self.size = [], [], [], [], 0, 0

    def add(self, rows: np.ndarray, ids: pa.Array, f: np.ndarray, prev: np.ndarray, w: np.ndarray, counts: np.ndarray) -> None:
        m, docs = self.m, len(rows)
        own = owners(counts).astype(np.int32)
        p, q = m.find(prev).astype(np.int32), m.find(w).astype(np.int32)
        hot_h, hot_w = p >= 0, q >= 0
        ch, cw = at(m.counts, p), at(m.counts, q)
        weight = np.log10(cw[hot_w] + 0.1) - math.log10(m.total + 0.1 * (m.vocab + 1))
        base = np.bincount(own[hot_w], weights=weight, minlength=docs).astype(float)
        known = np.bincount(own[hot_w], weights=cw[hot_w] > 0, minlength=docs).astype(np.int64)
        p1 = np.where(hot_w, cw / max(1, m.total), -1.0)  # -1: known in the bucket of the word only
        b = bucket_of(ch).astype(np.int8)
        l2 = m.weights[:, 0][b]
        low = m.weights[:, 1][b] * p1 + m.weights[:, 2][b] * m.p0
        tp, tq = at(m.top, p, -1), at(m.top, q, -1)
        both, score = hot_h & hot_w, np.zeros(docs)
        seen = both & (ch > 0)
        near = seen & (tp >= 0) & (tq >= 0)
        bare = both & ~seen  # a context of the vocabulary that no training text has: lower orders only
        far = seen & ~near
        unit = l2[far] / ch[far]
        for mask, value in ((near, l2[near] * m.pairs[tp[near], tq[near]] / ch[near] + low[near]), (bare, low[bare]), (far, unit)):
            score += np.bincount(own[mask], weights=np.log10(value), minlength=docs)
        shifted = own + np.int32(self.docs)
        self.far.append((self.to.key(prev[far], w[far]), shifted[far], (low[far] / unit).astype(np.float32)))
        self.low_h.append((self.to.of_hash(prev[~hot_h], 8), prev[~hot_h], w[~hot_h], shifted[~hot_h], p1[~hot_h].astype(np.float32)))
        self.low_w.append((self.to.of_hash(w[~hot_w], 9), w[~hot_w], shifted[~hot_w], p[~hot_w]))
        self.local.append((rows, (f != 0).astype(np.uint8), pc.fill_null(ids, 0).to_numpy(), np.where(ids.is_null(), 2, 1).astype(np.uint8), counts, known, base, score))
        self.docs += docs
        self.size += int(far.sum() + (~hot_h).sum() + (~hot_w).sum()) + docs

    def flush(self) -> Iterator[pa.RecordBatch]:
        rows, trained, ids, flag, tokens, known, base, score = map(np.concatenate, zip(*self.local))
        a, b, c = (list(map(np.concatenate, zip(*x))) for x in (self.far, self.low_h, self.low_w))
        self.clear()
        for x, by in ((a, a[0]), (b, b[0]), (c, c[0])):
            order = np.argsort(by, kind="stable")
            x[:] = [column[order] for column in x]
        ea, eb, ec = self.to.edges(self.to.of_key(a[0])), self.to.edges(b[0]), self.to.edges(c[0])
        full = np.flatnonzero((np.diff(ea) > 0) | (np.diff(eb) > 0) | (np.diff(ec) > 0)).tolist()
        blobs = []
        for k in full:
            ia, ib, ic = (slice(e[k], e[k + 1]) for e in (ea, eb, ec))
            used, own = np.unique(np.concatenate([a[1][ia], b[3][ib], c[2][ic]]), return_inverse=True)
            own = np.split(own.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32), np.cumsum([ia.stop - ia.start, ib.stop - ib.start]))
            blobs.append(
                pack(
                    np.diff(rows[used], prepend=np.int64(0)), trained[used], np.diff(a[0][ia], prepend=np.uint64(0)), own[0], a[2][ia],
                    b[1][ib], b[2][ib], own[1], b[4][ib], c[1][ic], own[2], c[3][ic],
                )
            )
        yield _packed(BIGRAMS, full, blobs)
        yield by_row(self.to, rows, tokens, known, base, score, ids, flag)


def by_row(to: Buckets, rows: np.ndarray, tokens: np.ndarray, known: np.ndarray, base: np.ndarray, value: np.ndarray, ids: np.ndarray, flag: np.ndarray) -> pa.RecordBatch:
    """Parts of sums, packed by the bucket of their row; ``flag``: 1 with the row's id, 2 if it is null, 0 without."""
    bucket = to.of_hash((rows >> 8).view(np.uint64), 12)  # neighbouring rows stay together
    order = np.lexsort((rows, bucket))
    cols = [x[order] for x in (rows, tokens.astype(np.int32), known.astype(np.int32), base.astype(np.float64), value.astype(np.float64), ids.astype(np.int64), flag.astype(np.uint8))]
    edges = to.edges(bucket[order])
    full = np.flatnonzero(np.diff(edges)).tolist()
    cut = lambda k: [x[edges[k] : edges[k + 1]] for x in cols]
    return _packed(SUMS, full, [pack(np.diff(r, prepend=np.int64(0)), *rest) for r, *rest in map(cut, full)])


def sums_of(blobs: list[bytes]) -> list[np.ndarray]:
    """``rows, tokens, known, base, value, ids, flag`` of one bucket, one entry a row."""
    got = [unpack(x) for x in blobs]
    rows, place = np.unique(np.concatenate([np.cumsum(g[0]) for g in got]), return_inverse=True)
    tokens, known, base, value, ids, flag = (np.concatenate([g[k] for g in got]) for k in range(1, 7))
    out = [np.bincount(place, weights=x, minlength=len(rows)).astype(t) for x, t in ((tokens, np.int64), (known, np.int64), (base, float), (value, float))]
    id_of, flag_of, own = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.uint8), flag > 0
    id_of[place[own]], flag_of[place[own]] = ids[own], flag[own]
    return [rows, *out, id_of, flag_of]


def by_word(to: Buckets, kind: int, words: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Columns, packed by the bucket of their word."""
    bucket = to.of_hash(words, 9)
    order = np.argsort(bucket, kind="stable")
    edges = to.edges(bucket[order])
    full = np.flatnonzero(np.diff(edges)).tolist()
    return _packed(kind, full, [pack(*(c[order[edges[k] : edges[k + 1]]] for c in (words, *columns))) for k in full])


def occurrences_by_key(key: np.ndarray, trained: np.ndarray) -> np.ndarray:
    """Training occurrences of each key, at each of its occurrences."""
    if not len(key):
        return np.zeros(0, np.int64)
    order = np.argsort(key)
    ordered = key[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    n = np.add.reduceat(trained[order].astype(np.int32), first)
    out = np.empty(len(key), np.int32)
    out[order] = np.repeat(n, np.diff(np.append(first, len(key))))
    return out


def _gather_bucket(m: Model, blobs: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """``(row, known, base, score)`` sums of one bucket, ``(word, count)`` that other buckets need, and bigrams whose word has its
    count elsewhere: ``(word, row, bucket of the context, relative frequency)``."""
    cols, shift = [[] for _ in range(12)], 0
    while blobs:
        u = unpack(blobs.pop())
        u[0], u[2] = np.cumsum(u[0]), np.cumsum(u[2], dtype=np.uint64)
        for k in (3, 7, 10):
            u[k] = u[k].astype(np.int32) + np.int32(shift)
        shift += len(u[0])
        for k, x in enumerate(u):
            cols[k].append(x)
    rows, trained, ka, da, qa, hb, wb, db, pb, wc, dc, hc = map(np.concatenate, cols)
    cols.clear()
    trained = trained.astype(bool)
    score, base, known = np.zeros(shift), np.zeros(shift), np.zeros(shift, np.int64)
    score += np.bincount(da, weights=np.log10(occurrences_by_key(ka, trained[da]) + qa.astype(np.float64)), minlength=shift)
    del ka, da, qa
    words, waiting = [np.zeros(0, np.uint64), np.zeros(0, np.int64)], [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0)]
    if len(hb):
        ch, c2, here = occurrences_by_key(hb, trained[db]), occurrences_by_key(pair_key(hb, wb), trained[db]), pb >= 0
        b, part = bucket_of(ch), c2 / np.maximum(ch, 1)
        p = interpolate(m, b[here], part[here], pb[here].astype(np.float64))
        score += np.bincount(db[here], weights=np.log10(p), minlength=shift)
        waiting = [wb[~here], rows[db[~here]], b[~here].astype(np.uint8), part[~here]]
    if len(wc):
        c, here = occurrences_by_key(wc, trained[dc]), hc >= 0
        h = hc[here]
        ch, c2 = m.counts[h], occurrences_by_key(pair_key(m.words[h], wc[here]), trained[dc[here]])
        p = interpolate(m, bucket_of(ch), c2 / np.maximum(ch, 1), c[here] / max(1, m.total))
        score += np.bincount(dc[here], weights=np.log10(p), minlength=shift)
        words[0], first = np.unique(wc[~here], return_index=True)
        words[1] = c[~here][first].astype(np.int64)
        base += np.bincount(dc, weights=np.log10(c + 0.1) - math.log10(m.total + 0.1 * (m.vocab + 1)), minlength=shift)
        known += np.bincount(dc, weights=c > 0, minlength=shift).astype(np.int64)
    return [rows, known, base, score], words, waiting


def interpolate(m: Model, bucket: np.ndarray, p2: np.ndarray, p1: np.ndarray) -> np.ndarray:
    return m.weights[:, 0][bucket] * p2 + m.weights[:, 1][bucket] * p1 + m.weights[:, 2][bucket] * m.p0


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = VOCABULARY) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    rows = _rows(docs, id_col, text_col)
    spark = docs.sparkSession
    model = train(rows, vocabulary)
    shared, to = spark.sparkContext.broadcast(model), Buckets(model.total, shuffle_partitions(spark))
    limit = flush_tokens(to.n)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = BigramsOut(shared.value, to)
        for cut, f, prev, w, counts in _cuts(batches):
            out.add(cut.column("row").to_numpy(), cut.column("id"), f, prev, w, counts)
            if out.size > limit:
                yield from out.flush()
        if out.size:
            yield from out.flush()

    def parts_of(rows: np.ndarray, known: np.ndarray, base: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        """Sums of a bucket, one entry a row; their values have the precision of single floats."""
        unique, place = np.unique(rows, return_inverse=True)
        known, base, value = (np.bincount(place, weights=x, minlength=len(unique)) for x in (known, base, value))
        none = np.zeros(len(unique), np.int64)
        return by_row(to, unique, none, known, base.astype(np.float32), value.astype(np.float32), none, none)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, held in _by_bucket(batches):
            yield _packed(SUMS, [b] * len(held[SUMS]), held[SUMS])
            if held[BIGRAMS]:
                sums, words, waiting = _gather_bucket(shared.value, held[BIGRAMS])
                yield parts_of(*sums)
                yield by_word(to, WORDS, *words)
                yield by_word(to, WAITING, *waiting)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, held in _by_bucket(batches):
            if held[SUMS]:
                yield by_row(to, *sums_of(held[SUMS]))
            if held[WAITING]:
                known, c = map(np.concatenate, zip(*map(unpack, held[WORDS])))
                order = np.argsort(known)
                w, at_row, level, p2 = map(np.concatenate, zip(*map(unpack, held[WAITING])))
                p1 = c[order][np.searchsorted(known[order], w)] / max(1, shared.value.total)
                none = np.zeros(len(w), np.int64)
                yield parts_of(at_row, none, none, np.log10(interpolate(shared.value, level, p2, p1)))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _by_bucket(batches):
            _, tokens, known, base, value, ids, flag = sums_of(held[SUMS])
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=flag == 2), *(pa.array(x) for x in (tokens, known, base, value))], ["doc", "n_tokens", "known", "base", "score"])

    packed = to.deal(rows.mapInArrow(scatter, PACKED_SCHEMA)).mapInArrow(gather, PACKED_SCHEMA)
    settled = to.deal(packed).mapInArrow(settle, PACKED_SCHEMA)
    total = to.deal(settled).mapInArrow(add_up, SUM_SCHEMA)
    doc = F.col("doc")
    return total.select(
        doc.alias("doc_id"), (F.crc32(F.coalesce(doc.cast("string"), F.lit("")).cast("binary")) % 10 == 0).alias("held_out"), "n_tokens", F.col("known").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score",
    )
