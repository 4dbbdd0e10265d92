"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH, exact edit verification.

A benchmark item matches a document if some stretch of the document is within ``max_rate`` of the item in word edit
distance (at most ``floor(max_rate * n)`` edits for an item of ``n`` lower-cased words).

1. Screen, lossless: by the q-gram lemma a match shares at least ``n - q + 1 - q e`` q-grams with its item on nearly one
   diagonal; other positions cannot match. It only says where windows of which length are worth embedding: grams are looked up by item
   length, so a gram that many items share counts once.
2. CGK: every item and every such window of the item's size walks randomly through its words to a string of length
   ``3 n``, under ``repeats`` independent walks; edit distance becomes Hamming distance.
3. Bit-sampling LSH: each walk keeps a few sampled positions; window and item meet if all agree in some repeat. The
   number of repeats is fitted for each class of lengths (powers of two): as many as it takes until a share ``recall`` of its
   items, edited at random as often as is allowed, have met themselves. A class that ``MOST_REPEATS`` don't bring there is compared
   with all its windows.
4. Exact: an item that met a window and has all but its edits of its words around it (no match has fewer) is aligned: semi-global edit
   distance within the window widened by the allowed edits. Equal surroundings are compared once.

Items of one to four words may have no edit; they are found exactly, by the hashes of word runs.

The screen is there because embedding every window of every length is out of reach: each word would start a window for each
item length, and each window takes ``3 n`` steps in each repeat. It leaves the windows that can match; a row is found only if
its window and item meet in the LSH.

Items are the stated query set; they are taken in blocks bounded in number and bytes, so what is broadcast is bounded. With
several blocks each is searched on its own, its matches are written and its broadcast is released. A document is judged within
its own row: nothing is shuffled and no text is cut.

Defined results: null, empty and blank texts and items match nothing; repeated document rows each give their rows, also with equal
or null ids; of equally good stretches the leftmost counts; equal items all match; items with a null id are left out (nothing could name them); items with fewer than
``min_words`` words (a parameter, 5 by default: a word or two name no text, and take no document out) are left out, with 1 none is; very
long texts and items are compared whole; an empty table on either side gives no matches and keeps all documents; other columns are
kept by the filter, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize
from .tokens import grams, hash_words, inside, mix64, owners, slices, split_words, starts_of

MAX_RATE = 0.2
RECALL = 0.99
SAMPLED = 2
#: From so many words on an item is a text that may be edited; shorter ones are found as they are, if they are asked for.
MIN_WORDS = WORDS_OF_A_TEXT = 5
MOST_REPEATS = 1_024
#: Places of grams that are looked at together.
PLACES = 1 << 20
ITEMS_PER_BLOCK = 20_000
BYTES_PER_BLOCK = 32 << 20
TRIALS = 400
SEED = 11
ROWS = 20_000

MATCH_SCHEMA = "doc_id bigint, item_id bigint, edits int, item_words int, start_word bigint, repeats_hit int"


def edits_allowed(n: int, max_rate: float = MAX_RATE) -> int:
    return int(math.floor(max_rate * n + 1e-9))


def gram_size(n: int, e: int) -> int:
    """Largest q up to 3 for which the q-gram lemma still promises a shared q-gram."""
    return max(1, min(3, n // (e + 1)))


def cgk_at(strings: np.ndarray, walks: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """Sampled positions of the CGK embedding of rows of equal length ``n`` to length ``3 n``: ``walks x sampled x rows``.

    At step ``j`` the current word is written; the pointer moves on if the walk's random bit for (step, word) is set.
    Past the end a pad symbol (0) is written. All walks go on together, and only the positions in ``picks`` (one row for
    each walk) are kept.
    """
    m, n = strings.shape
    padded = np.concatenate([strings, np.zeros((m, 1), np.uint64)], axis=1).ravel()
    at = np.zeros((len(walks), m), np.int64)
    base = np.arange(m, dtype=np.int64) * (n + 1)
    out = np.empty((*picks.shape, m), np.uint64)
    for j in range(int(picks.max()) + 1):
        now = padded[base + at]
        for r, k in zip(*np.nonzero(picks == j)):
            out[r, k] = now[r]
        move = (mix64(now, (walks * 1009 + j * 7 + 3)[:, None]) >> np.uint64(33)) & np.uint64(1)
        at = np.minimum(at + move.astype(np.int64), n)
    return out


def lsh_keys(strings: np.ndarray, repeats: int, seed: int = SEED, sampled: int = SAMPLED) -> np.ndarray:
    """``rows x repeats`` bucket keys: one CGK walk and ``sampled`` of its positions each."""
    m, n = strings.shape
    picks = np.stack([np.sort(np.random.default_rng([seed, r, n]).choice(3 * n, size=min(sampled, 3 * n), replace=False)) for r in range(repeats)])
    keys = np.empty((m, repeats), np.uint64)
    for a in range(0, m, ROWS):
        e = cgk_at(strings[a : a + ROWS], seed + 131 * np.arange(repeats), picks)
        key = np.repeat(np.arange(1, repeats + 1, dtype=np.uint64)[:, None], e.shape[2], axis=1)
        for k in range(e.shape[1]):
            key = mix64(key * np.uint64(0x100000001B3) + e[:, k], k + 5)
        keys[a : a + ROWS] = key.T
    return keys


def length_class(n: int) -> int:
    return n.bit_length()


def randomly_edited(rng: np.random.Generator, item: np.ndarray, edits: int, pool: np.ndarray) -> np.ndarray:
    """The item after some random substitutions, deletions and insertions, cut or padded to its own length."""
    other = list(item)
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(len(other)))
        if kind == 0:
            other[at] = pool[rng.integers(len(pool))]
        elif kind == 1 and len(other) > 1:
            del other[at]
        else:
            other.insert(at, pool[rng.integers(len(pool))])
    return np.array((other + [np.uint64(0)] * len(item))[: len(item)], np.uint64)


def fit_repeats(items: list[np.ndarray], max_rate: float = MAX_RATE, recall: float = RECALL, seed: int = SEED, trials: int = TRIALS, most: int = MOST_REPEATS) -> int | None:
    """Repeats after which a share ``recall`` of the items, each with the edits it is allowed, have met themselves.

    None if ``most`` repeats don't do: the windows of such items are compared with all of them.
    """
    rng, pool, by_length = np.random.default_rng(seed), np.concatenate(items), {}
    for t in range(trials):
        item = items[t % len(items)]
        by_length.setdefault(len(item), []).append((item, randomly_edited(rng, item, edits_allowed(len(item), max_rate), pool)))
    repeats = 8
    while repeats <= most:
        first = []  # the repeat in which each trial meets
        for pairs in by_length.values():
            a, b = (lsh_keys(np.stack(x), repeats, seed) for x in zip(*pairs))
            same = a == b
            first += np.where(same.any(axis=1), same.argmax(axis=1) + 1, repeats + 1).tolist()
        enough = sorted(first)[math.ceil(recall * len(first)) - 1]
        if enough <= repeats:
            return enough
        repeats *= 2
    return None


def best_alignment(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """``(edits, start)``: least word edits of the whole item against any stretch of the text, leftmost on ties."""
    m = len(text)
    cost, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
    for w in item:
        sub = cost[:-1] + (text != w)
        up = cost + 1
        new, new_start = up.copy(), start.copy()
        better = sub < up[1:]
        new[1:][better], new_start[1:][better] = sub[better], start[:-1][better]
        # words of the text left over: new[j] = min over k <= j of new[k] + (j - k)
        low = np.minimum.accumulate(new - np.arange(m + 1))
        leftmost = np.searchsorted(-low, -low, side="left")  # first place that reaches the running minimum
        cost, start = low + np.arange(m + 1), new_start[leftmost]
    j = int(np.argmin(cost))
    return int(cost[j]), int(start[j])


class Items:
    """The benchmark block: q-gram index by item length, LSH tables per item length, word runs of short items."""

    def __init__(self, ids: list[int], texts: list[str], max_rate: float = MAX_RATE, recall: float = RECALL, min_words: int = 1):
        flat, counts = split_words(pc.utf8_lower(pa.array(texts, pa.string())))
        h, at = hash_words(flat), starts_of(counts)
        keep = [k for k in range(len(ids)) if counts[k] >= max(1, min_words)]
        self.ids = [ids[k] for k in keep]
        self.items = [h[at[k] : at[k + 1]] for k in keep]
        self.n = np.array([len(x) for x in self.items], np.int64)
        lengths = sorted({n for n in self.n.tolist() if n >= WORDS_OF_A_TEXT})
        self.edits = {n: edits_allowed(n, max_rate) for n in lengths}
        self.rows = {n: np.flatnonzero(self.n == n) for n in lengths}  # item rows of each length, and their words
        self.words = {n: np.stack([self.items[k] for k in rows]) for n, rows in self.rows.items()}
        self.index = {}  # by q: grams, the item lengths they occur in, and where; each place once, however many items have it
        for q in sorted({gram_size(n, e) for n, e in self.edits.items()}):
            mine = [n for n in lengths if gram_size(n, self.edits[n]) == q]
            # grams of n words begin at positions 0 to n - q of each of the rows
            parts = [(grams(m.ravel(), q), np.arange(m.size - q + 1) % n, n) for n, m in ((n, self.words[n]) for n in mine)]
            spots = np.unique(np.concatenate([np.stack([g[p <= n - q], np.full(int((p <= n - q).sum()), n, np.uint64), p[p <= n - q].astype(np.uint64)], axis=1) for g, p, n in parts]), axis=0)
            self.index[q] = (spots[:, 0], spots[:, 1].astype(np.int64), spots[:, 2].astype(np.int64), self._bits(spots[:, 0]))
        top = max(lengths, default=0) + 1
        self.need, self.width = np.ones(top, np.int64), np.ones(top, np.int64)
        for n, e in self.edits.items():
            q = gram_size(n, e)
            self.need[n], self.width[n] = max(1, n - q + 1 - q * e), 2 * (2 * e + 1)
        repeats = {c: fit_repeats([self.items[k] for n in lengths if length_class(n) == c for k in self.rows[n]], max_rate, recall) for c in {length_class(n) for n in lengths}}
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray] | None] = {}  # keys, their order and the sorted keys of each repeat
        for n in lengths:
            if (r := repeats[length_class(n)]) is None:
                self.tables[n] = None
                continue
            keys = lsh_keys(self.words[n], r)
            order = np.argsort(keys, axis=0, kind="stable")
            self.tables[n] = (keys, order, np.take_along_axis(keys, order, axis=0))
        self.short = {}
        for n in sorted({n for n in self.n.tolist() if n < WORDS_OF_A_TEXT}):
            rows = np.flatnonzero(self.n == n)
            g = grams(np.concatenate([self.items[k] for k in rows]), n)[::n]
            order = np.argsort(g, kind="stable")
            self.short[n] = (g[order], rows[order])

    @staticmethod
    def _bits(g: np.ndarray) -> np.ndarray:
        bits = np.zeros(1 << 20, bool)
        bits[(g >> np.uint64(44)).astype(np.int64)] = True
        return bits

    def windows(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Distinct ``(document row, item length, start)`` worth embedding; start is an index into ``h``."""
        found, owner = [np.zeros((0, 3), np.int64)], owners(counts)
        for q, (keys, of, pos, bits) in self.index.items():
            g = grams(h, q)
            at = np.flatnonzero(bits[(g >> np.uint64(44)).astype(np.int64)] & inside(counts, q)) if len(g) else np.zeros(0, np.int64)
            lo, hi = np.searchsorted(keys, g[at], "left"), np.searchsorted(keys, g[at], "right")
            at, lo, each = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            # documents are taken together until their places pass a bound; the lengths of one that passes it alone are taken one by one
            upto, doc = np.cumsum(each), owner[at]
            begin = 0
            while begin < len(at):
                end = int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PLACES, "right"))
                end = int(np.searchsorted(doc, doc[end], "left")) if end < len(at) else end
                end = max(end, int(np.searchsorted(doc, doc[begin], "right")))
                here = slice(begin, end)
                whole = int(each[here].sum()) <= 2 * PLACES
                for n in [None] if whole else np.unique(of).tolist():
                    found.append(self._cells(at[here], lo[here], each[here], doc[here], of, pos, n, len(h)))
                begin = end
        return np.unique(np.concatenate(found), axis=0)

    def _cells(self, at: np.ndarray, lo: np.ndarray, each: np.ndarray, doc: np.ndarray, of: np.ndarray, pos: np.ndarray, only: int | None, size: int) -> np.ndarray:
        """Starts of windows in cells of diagonals that hold as many grams as a match of that length must share."""
        at, doc = np.repeat(at, each), np.repeat(doc, each)
        k = np.repeat(lo, each) + np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
        if only is not None:
            mine = of[k] == only
            at, doc, k = at[mine], doc[mine], k[mine]
        n, diag = of[k], at - pos[k]
        good = np.zeros(len(at), bool)
        for shift in (0, 1):  # two grids: any stretch of 2 e + 1 diagonals lies within one cell of one of them
            cell = (diag + size + shift * (self.width[n] // 2)) // self.width[n]
            key = (doc * len(self.need) + n) * (4 * size + 2) + cell
            _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            good |= count[inverse] >= self.need[n]
        return np.unique(np.stack([doc[good], n[good], diag[good]], axis=1), axis=0)

    def _short_matches(self, h: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """Items of fewer words than a text has: their first equal run in each document."""
        at, owner = starts_of(counts), owners(counts)
        for n, (keys, rows) in self.short.items():
            g = grams(h, n)
            spots = np.flatnonzero(np.isin(g, keys) & inside(counts, n)) if len(g) else np.zeros(0, np.int64)
            _, first = np.unique(np.stack([owner[spots].astype(np.uint64), g[spots]], axis=1), axis=0, return_index=True)
            for spot in spots[first].tolist():
                for k in rows[np.searchsorted(keys, g[spot], "left") : np.searchsorted(keys, g[spot], "right")].tolist():
                    if np.array_equal(self.items[k], h[spot : spot + n]):
                        yield int(owner[spot]), k, 0, spot - int(at[owner[spot]]), 1

    def matches(self, h: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """``(document row, item row, edits, start word, repeats hit)``: the best verified stretch of each pair."""
        at = starts_of(counts)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        w = self.windows(h, counts)
        for n in np.unique(w[:, 1]).tolist():
            rows = w[w[:, 1] == n]
            for begin in range(0, len(rows), ROWS):
                for d, k, cost, start, hits in self._verified(h, at, n, rows[begin : begin + ROWS, 0], rows[begin : begin + ROWS, 2]):
                    new = (cost, start - int(at[d]), hits)
                    if (d, k) not in best or new[:2] < best[d, k][:2]:
                        best[d, k] = new
        return sorted([*((d, k, *v) for (d, k), v in best.items()), *self._short_matches(h, counts)])

    def _verified(self, h: np.ndarray, at: np.ndarray, n: int, docs: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """Items of ``n`` words that met a window and are within their edits of its surroundings.

        Equal surroundings are compared once. Before it is aligned, an item must have all but its edits of its words there.
        """
        e, rows, words, table = self.edits[n], self.rows[n], self.words[n], self.tables[n]
        m = len(docs)
        lo = hi = met = None
        if table is not None:
            index = starts[:, None] + np.arange(n)
            ok = (index >= at[docs][:, None]) & (index < at[docs + 1][:, None])
            met = lsh_keys(np.where(ok, h[np.clip(index, 0, len(h) - 1)], np.uint64(0)), table[0].shape[1])
            lo, hi = (np.stack([np.searchsorted(table[2][:, r], met[:, r], side) for r in range(met.shape[1])]) for side in ("left", "right"))
        known: dict[bytes, list[tuple[int, int, int]]] = {}
        for p in range(m) if table is None else np.flatnonzero((hi > lo).any(axis=0)).tolist():
            a, b = max(int(at[docs[p]]), int(starts[p]) - 2 * e - 1), min(int(at[docs[p] + 1]), int(starts[p]) + n + 2 * e + 1)
            if b <= a:
                continue
            name = h[a:b].tobytes() + (b"" if met is None else met[p].tobytes())
            if name not in known:
                near = np.arange(len(rows)) if table is None else np.unique(np.concatenate([table[1][lo[r, p] : hi[r, p], r] for r in np.flatnonzero(hi[:, p] > lo[:, p])]))
                near = near[np.isin(words[near], h[a:b]).sum(axis=1) >= n - e]
                found = []
                for k in near.tolist():
                    cost, start = best_alignment(words[k], h[a:b])
                    if cost <= e:
                        found.append((k, cost, start, 1 if met is None else int((table[0][k] == met[p]).sum())))
                known[name] = found
            for k, cost, start, hits in known[name]:
                yield int(docs[p]), int(rows[k]), cost, a + start, hits


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = ITEMS_PER_BLOCK, most: int = BYTES_PER_BLOCK) -> list[DataFrame]:
    """The query set in blocks of about ``size`` items and ``most`` bytes at most, dealt by hash."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null").distinct()
    n, n_bytes = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(-(-n // size), -(-(n_bytes or 0) // most))
    if blocks <= 1:
        return [rows] * blocks
    return [rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(2 * blocks)) == b) for b in range(2 * blocks)]


def _matcher(block: DataFrame, max_rate: float, recall: float, min_words: int) -> Items:
    items = sorted(map(tuple, block.collect()))  # one block: bounded by item_blocks
    return Items([r[0] for r in items], [r[1] for r in items], max_rate, recall, min_words)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat, counts = split_words(pc.utf8_lower(texts))
    return hash_words(flat), counts


def find_matches(
    docs: DataFrame, benchmark: DataFrame, max_rate: float = MAX_RATE, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, **blocks: int
) -> DataFrame:
    """One row per matching ``(document row, item)``: edits, item length, start word, LSH repeats that met."""
    spark = docs.sparkSession
    rows, found, several = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), [], item_blocks(benchmark, **blocks)
    for block in several:
        shared = spark.sparkContext.broadcast(_matcher(block, max_rate, recall, min_words))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                for cut in slices(batch, "text"):
                    got = items.matches(*_words(cut.column("text")))
                    if got:
                        row, item, edits, start, hits = map(list, zip(*got))
                        yield pa.RecordBatch.from_arrays(
                            [
                                cut.column("id").take(pa.array(row)), pa.array([items.ids[k] for k in item], pa.int64()), pa.array(edits, pa.int32()),
                                pa.array(items.n[item], pa.int32()), pa.array(start, pa.int64()), pa.array(hits, pa.int32()),
                            ],
                            ["doc_id", "item_id", "edits", "item_words", "start_word", "repeats_hit"],
                        )

        part = rows.mapInArrow(search, MATCH_SCHEMA)
        if len(several) > 1:
            part = materialize(part, "matches")
            shared.destroy()
        found.append(part)
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], MATCH_SCHEMA)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, max_rate: float = MAX_RATE, recall: float = RECALL, text_col: str = "text", min_words: int = MIN_WORDS, **blocks: int) -> DataFrame:
    """The rows of ``docs``, all columns, that match no item."""
    spark, out, several = docs.sparkSession, docs, item_blocks(benchmark, **blocks)
    for block in several:
        shared = spark.sparkContext.broadcast(_matcher(block, max_rate, recall, min_words))

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for cut in slices(batch, text_col):
                    keep = np.ones(len(cut), bool)
                    keep[[g[0] for g in shared.value.matches(*_words(cut.column(text_col)))]] = False
                    yield cut.filter(pa.array(keep))

        out = out.mapInArrow(clean, docs.schema)
        if len(several) > 1:
            out = materialize(out, "clean")
            shared.destroy()
    return out
