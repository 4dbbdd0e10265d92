"""Whole texts as flat arrays of word hashes, a slice of an Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def slices(batch: pa.RecordBatch, column: str, most: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds about ``most`` bytes of text, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cum, at = np.cumsum(size), 0
    while at < len(size):
        base = cum[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(cum, base + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``(words of all texts in order, word count of each text)``; words are ``[^\\x20\\x09-\\x0D]+``, null has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    counts = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(full).as_py():  # white space at an end of a text leaves an empty word there
        keep = full.to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(owner[keep], minlength=len(counts))
        flat = flat.filter(full)
    return flat, counts.astype(np.int64)


def hash_words(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, computed once per distinct word."""
    if not len(flat):
        return np.zeros(0, np.uint64)
    d = flat.dictionary_encode()
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, d.dictionary.to_pylist()), np.uint64, len(d.dictionary))
    return table[d.indices.to_numpy()]


def mix64(x: np.ndarray, seed: int | np.ndarray = 0) -> np.ndarray:
    """A bijective 64-bit mix (the finaliser of a multiply-xorshift generator); seeds may be an array that broadcasts."""
    with np.errstate(over="ignore"):
        key = seed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) if isinstance(seed, np.ndarray) else np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = x ^ key
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hash of each run of ``n`` hashes; has ``len(h) - n + 1`` entries (none if shorter)."""
    size = len(h) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = mix64(h[:size], 1)
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out = mix64(out * np.uint64(0x100000001B3) + h[k : k + size], k + 1)
    return out


def starts_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def inside(counts: np.ndarray, n: int) -> np.ndarray:
    """Mask over the flat ``grams(h, n)``: true where the run does not cross into the next text."""
    total = int(counts.sum())
    if total < n:
        return np.zeros(0, bool)
    ends = np.repeat(np.cumsum(counts), counts)[: total - n + 1]
    return np.arange(total - n + 1) + n <= ends


def owners(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)
