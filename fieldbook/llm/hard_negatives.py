"""Hard-negative mining by bit-sliced integer products.

Components become integers (``floor(256 * x)``). A row's product with an anchor is taken a bit-plane of the row's components at a time,
most significant first (the sign plane of the two's complement counts negative). After each plane the planes still to come can add
between ``(2^k - 1) * (sum of the anchor's negative components)`` and ``(2^k - 1) * (sum of its positive ones)``: pairs whose
interval cannot meet the wanted scores are dropped, and what is left after the last plane is exact.

Rows are packed into blocks. Every block of anchors (the query set, about a hundredth of the rows) is sent to every group of row
blocks, so a cell (row group, anchor group) has all it needs: it holds its anchors, which are bounded in bytes, and streams its rows. Two
passes follow: the first finds each anchor's best rows of its label (the interval must reach the fifth best so far), the second the
rows of other labels within the band of each positive (between 80 % of its score, or the fifth best so far, and its score). A cell
gives at most five rows for each list, which are merged by anchor.

Defined results: rows with a null label or vector, or a null or non-finite component, take no part; a null vec_id is never an anchor
and comes after all others among equal scores; rows that repeat a vec_id are rows of their own (a copy of an anchor can be its positive,
and repeated anchors each give their rows); vectors of unequal length are compared as if the shorter went on with zeros; an empty vector has
the score 0; scores beyond a long are cut to its ends; equal scores go by smaller vec_id; a label that one row has gives no positive
and so no row; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, shuffle_partitions

BLOCK_ROWS, BLOCK_BYTES = 2_048, 4 << 20
#: Components of the anchors that one cell holds.
CELL_COMPONENTS = 1 << 23
#: Anchors compared with a block at a time.
CHUNK = 1_024
#: Below this share of pairs still in question the next planes are computed pair by pair.
SPARSE = 0.03
TOP = 5
SCALE = 256
FAR = np.iinfo(np.int64).max


# ---------------------------------------------------------------- products by planes


def _number_type(a: np.ndarray, bits: int) -> type:
    """The fastest number type in which every partial product is exact."""
    if a.dtype == object or bits > 62:
        return object
    most = float(np.abs(a.astype(np.float64)).sum(axis=1).max(initial=0)) * 2.0**bits
    return np.float32 if most < 2.0**24 else np.float64 if most < 2.0**53 else np.int64 if most < 2.0**62 else object


def _bits(r: np.ndarray) -> int:
    """Bits of the two's complement of all components."""
    low, high = int(r.min(initial=0)), int(r.max(initial=0))
    return max((~low).bit_length() if low < 0 else 0, high.bit_length()) + 1


def sliced_products(a: np.ndarray, r: np.ndarray, low: np.ndarray, high: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, score)`` of all pairs with ``allowed[i, j]`` and ``low[i] <= a[i] . r[j] <= high[i]``.

    ``a`` and ``r`` hold integers; bounds are floats, which may be infinite.
    """
    bits = _bits(r)
    kind = _number_type(a, bits)
    x = a.astype(kind)
    least, most = np.minimum(x, 0).sum(axis=1), np.maximum(x, 0).sum(axis=1)
    rows, cols = np.arange(len(r)), None  # cols: pairs as (anchor, place in rows) once few are left
    partial: np.ndarray = np.zeros((len(a), len(r)), kind)
    alive, pair_a = allowed, np.zeros(0, np.int64)
    for k in range(bits - 1, -1, -1):
        weight = -(1 << k) if k == bits - 1 else 1 << k
        plane = ((r[rows] >> k) & 1).astype(kind)
        rest = (1 << k) - 1
        if cols is None:
            partial = partial + weight * (x @ plane.T)
            alive = alive & (partial + (rest * most)[:, None] >= low[:, None]) & (partial + (rest * least)[:, None] <= high[:, None])
            keep = alive.any(axis=0)
            if not keep.all():
                rows, partial, alive = rows[keep], partial[:, keep], alive[:, keep]
            if k and alive.sum() < SPARSE * len(a) * len(r):
                pair_a, cols = np.nonzero(alive)
                partial = partial[pair_a, cols]
        else:
            for begin in range(0, len(cols), 1 << 16):  # a bounded number of gathered vectors
                s = slice(begin, begin + (1 << 16))
                partial[s] += weight * (x[pair_a[s]] * plane[cols[s]]).sum(axis=1)
            keep = (partial + rest * most[pair_a] >= low[pair_a]) & (partial + rest * least[pair_a] <= high[pair_a])
            pair_a, cols, partial = pair_a[keep], cols[keep], partial[keep]
    if cols is None:
        pair_a, cols = np.nonzero(alive)
        partial = partial[pair_a, cols]
    if kind is object:
        partial = np.array([max(-FAR, min(FAR, v)) for v in partial], np.int64)
    return pair_a, rows[cols], partial.astype(np.int64)


class Best:
    """The best rows of several lists: highest score, then smallest id, null ids last."""

    def __init__(self, lists: int):
        self.lists = lists
        self.key = np.zeros((4, 0), np.int64)  # list, -score, id is null, id
        self.fifth = np.full(lists, -np.inf)

    def add(self, of: np.ndarray, score: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        key = np.concatenate([self.key, np.stack([of, ~score, null.astype(np.int64), ids])], axis=1)
        key = key[:, np.lexsort(key[::-1])]
        begins = np.searchsorted(key[0], key[0])
        place = np.arange(key.shape[1]) - begins
        self.key = key[:, place < TOP]
        last = self.key[:, place[place < TOP] == TOP - 1]
        self.fifth[last[0]] = (~last[1]).astype(float) - (np.abs(last[1]) >> 52 != 0) * 2.0**11  # a float bound never above it

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(list, score, id is null, id)`` in order."""
        return self.key[0], ~self.key[1], self.key[2].astype(bool), self.key[3]


# ---------------------------------------------------------------- blocks

BLOCK = "n int, dim int, width int, ids binary, valid binary, labels binary, parts binary"


def _integers(column: pa.Array) -> np.ndarray:
    """``floor(256 * x)`` of a list column as a matrix, short lists filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    large = np.abs(flat) >= 2.0**62
    if large.any():
        raw = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        values = np.array([int(v) * SCALE if b else int(f) for v, f, b in zip(raw, np.where(large, 0, flat), large)], object)
    else:
        values = flat.astype(np.int64)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), values.dtype)
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out


def _pack(ids: np.ndarray, valid: np.ndarray, labels: np.ndarray, q: np.ndarray) -> tuple:
    """A block; components take as few bytes as all of them fit in."""
    bits = _bits(q)
    width = next((w for w in (1, 2, 4, 8) if bits <= 8 * w), bits // 8 + 1)
    if width <= 8:
        parts = q.astype(f"<i{width}").tobytes()
    else:
        parts = b"".join(int(v).to_bytes(width, "little", signed=True) for v in q.ravel())
    return len(ids), q.shape[1], width, ids.astype("<i8").tobytes(), valid.astype("u1").tobytes(), labels.astype("<i8").tobytes(), parts


def _unpack(n: int, dim: int, width: int, ids: bytes, valid: bytes, labels: bytes, parts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if width <= 8:
        q = np.frombuffer(parts, f"<i{width}").astype(np.int64)
    else:
        q = np.array([int.from_bytes(parts[k : k + width], "little", signed=True) for k in range(0, len(parts), width)] + [None], object)[:-1]
    return np.frombuffer(ids, "<i8"), np.frombuffer(valid, "u1").astype(bool), np.frombuffer(labels, "<i8"), q.reshape(n, dim)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], [f for f, _ in fields])


def packed(embeddings: DataFrame) -> DataFrame:
    """Blocks of the rows that take part, each with a number; labels are changed where the id is divisible by 7."""
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    label = F.col("label").cast("long")
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), F.col("embedding").cast("array<double>").alias("vector")
    ).where("label is not null and vector is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = max(1, int(np.diff(batch.column(2).offsets.to_numpy()).max(initial=0)))
            step = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * most)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = part.column(0)
                yield _batch([_pack(ids.fill_null(FAR).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), part.column(1).to_numpy(), _integers(part.column(2)))], BLOCK)

    return materialize(rows.where(good).mapInArrow(run, BLOCK).withColumn("block", F.monotonically_increasing_id()), "blocks")


ANCHOR = "block bigint, place int, vec_id bigint, label bigint, dim int, width int, parts binary"


def anchors_of(blocks: DataFrame, every: int) -> DataFrame:
    """One row for each anchor, from the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, valid, labels, q = _unpack(*(row[k.split()[0]] for k in BLOCK.split(", ")))
                found = np.nonzero(valid & (ids % every == 0))[0]
                if len(found):
                    made = [_pack(ids[k : k + 1], valid[k : k + 1], labels[k : k + 1], q[k : k + 1]) for k in found]
                    yield _batch([(row["block"], int(k), int(ids[k]), int(labels[k]), m[1], m[2], m[6]) for k, m in zip(found, made)], ANCHOR)

    return materialize(blocks.mapInArrow(run, ANCHOR), "anchors")


def _cells(blocks: DataFrame, anchors: DataFrame, groups: int, parts: int) -> DataFrame:
    """Row blocks and anchors dealt over the cells ``(row group, anchor part)``, a cell's anchors first."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = anchors.withColumn("part", F.pmod(F.xxhash64("block", "place"), F.lit(parts))).withColumn("group", every(groups)).withColumn("kind", F.lit(0))
    rows = blocks.withColumn("part", every(parts)).withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups))).withColumn("kind", F.lit(1))
    both = queries.unionByName(rows, allowMissingColumns=True).withColumn("cell", (F.col("group") * parts + F.col("part")).cast("int")).drop("group", "part")
    return both.repartition(groups * parts, "cell").sortWithinPartitions("cell", "kind")


FOUND = "block bigint, place int, list int, score bigint, is_null int, id bigint"


class Chunk:
    """Some anchors of a cell and their lists; ``bands`` are the positives' scores of each anchor, or None when positives are sought."""

    def __init__(self, anchors: list[dict], with_bands: bool):
        self.at = np.array([(a["block"], a["place"]) for a in anchors], np.int64)
        self.labels = np.array([a["label"] for a in anchors], np.int64)
        q = [_unpack(1, a["dim"], a["width"], bytes(8), b"\1", bytes(8), a["parts"])[3][0] for a in anchors]
        self.q = np.zeros((len(q), max(map(len, q))), object if any(x.dtype == object for x in q) else np.int64)
        for row, x in zip(self.q, q):
            row[: len(x)] = x
        self.bands = None
        if with_bands:
            self.bands = np.full((len(anchors), TOP), -1, np.int64)  # a band below 0 is empty, as is one that isn't there
            for row, a in zip(self.bands, anchors):
                row[: len(a["bands"])] = a["bands"]
        self.best = Best(len(anchors) * (TOP if with_bands else 1))

    def meet(self, block: int, ids: np.ndarray, valid: np.ndarray, labels: np.ndarray, r: np.ndarray) -> None:
        """Compares all anchors with the rows of a block."""
        dim = max(r.shape[1], self.q.shape[1])
        r, q = (np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in (r, self.q))
        if self.bands is None:
            parts = []
            for label in np.intersect1d(labels, self.labels):
                rows, mine = np.nonzero(labels == label)[0], np.nonzero(self.labels == label)[0]
                other = (self.at[mine, 0] != block)[:, None] | (self.at[mine, 1][:, None] != rows)
                i, j, score = sliced_products(q[mine], r[rows], self.best.fifth[mine], np.full(len(mine), np.inf), other)
                parts.append((mine[i], rows[j], score))
            if parts:
                of, j, score = (np.concatenate(c) for c in zip(*parts))
                self.best.add(of, score, ~valid[j], ids[j])
            return
        # 80 * p <= 100 * s  <=>  s >= p - floor(p / 5), for p >= 0
        least = self.bands - self.bands // 5
        low = np.where(self.bands >= 0, np.maximum(least * np.where(least < 1 << 50, 1, 1 - 2.0**-50), self.best.fifth.reshape(-1, TOP)), np.inf).min(axis=1)
        above = np.where(self.bands == FAR, np.inf, self.bands * np.where(self.bands < 1 << 50, 1, 1 + 2.0**-50))  # a cut score has no end
        high = np.where(self.bands >= 0, above, -np.inf).max(axis=1)
        i, j, score = sliced_products(q, r, low, high, self.labels[:, None] != labels)
        inside = (self.bands[i] >= 0) & (score[:, None] <= self.bands[i]) & (score[:, None] >= least[i])
        pair, k = np.nonzero(inside)
        if len(pair):
            self.best.add(i[pair] * TOP + k, score[pair], ~valid[j[pair]], ids[j[pair]])

    def found(self) -> Iterator[pa.RecordBatch]:
        of, score, null, ids = self.best.rows()
        anchor, place = np.divmod(of, TOP) if self.bands is not None else (of, np.zeros_like(of))
        if len(of):
            columns = [self.at[anchor, 0], self.at[anchor, 1].astype(np.int32), place.astype(np.int32), score, null.astype(np.int32), ids]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f.split()[0] for f in FOUND.split(", ")])


def _search(cells: DataFrame, with_bands: bool) -> DataFrame:
    """The best rows of each list of each cell; anchors come before the rows of their cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting, chunks = None, [], []
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["cell"] != number:
                    for chunk in chunks:
                        yield from chunk.found()
                    number, waiting, chunks = row["cell"], [], []
                if row["kind"] == 0:
                    waiting.append(row)
                    if len(waiting) == CHUNK:
                        chunks.append(Chunk(waiting, with_bands))
                        waiting = []
                    continue
                if waiting:
                    chunks.append(Chunk(waiting, with_bands))
                    waiting = []
                block = _unpack(*(row[k.split()[0]] for k in BLOCK.split(", ")))
                for chunk in chunks:
                    chunk.meet(row["block"], *block)
        for chunk in chunks:
            yield from chunk.found()

    return cells.mapInArrow(run, FOUND)


def _merged(found: DataFrame) -> DataFrame:
    """``block, place, list, best``: the first rows of each list over all cells, of which each gives at most five."""
    row = F.struct((-F.col("score")).alias("down"), "is_null", "id", "score")
    return found.groupBy("block", "place", "list").agg(F.slice(F.sort_array(F.collect_list(row)), 1, TOP).alias("best"))


def mine(embeddings: DataFrame, every: int = 100) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for anchors whose id is divisible by ``every``."""
    blocks = packed(embeddings)
    anchors = anchors_of(blocks, every)
    held = anchors.agg(F.sum(F.greatest("dim", F.lit(1)).cast("long"))).first()[0] or 0
    parts = -(-held // CELL_COMPONENTS) or 1
    groups = max(1, min(shuffle_partitions(embeddings.sparkSession) // parts, blocks.count()))
    positives = materialize(_merged(_search(_cells(blocks, anchors, groups, parts), False)).drop("list"), "positives")
    bands = anchors.join(positives.select("block", "place", F.col("best.score").alias("bands")), ["block", "place"])
    negatives = _merged(_search(_cells(blocks, bands, groups, parts), True))
    ids = lambda b: F.when(b["is_null"] == 0, b["id"])
    by_list = positives.select("block", "place", F.posexplode("best").alias("list", "p")).join(negatives, ["block", "place", "list"])
    named = by_list.join(anchors.select("block", "place", F.col("vec_id").alias("anchor_id")), ["block", "place"])
    return named.select("anchor_id", "p", F.posexplode("best").alias("k", "m")).select(
        "anchor_id", ids(F.col("p")).alias("positive_id"), (F.col("k") + 1).alias("rank"), ids(F.col("m")).alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("m.score").alias("negative_score")
    )
