"""N-gram Jaccard self-join by chosen paths (all pairs of texts with Jaccard >= 0.8 on five-word shingles).

* A text is its set of hashed five-word shingles (one shingle of all words if it has fewer). Texts with equal sets form one
  copy group that is joined once, whatever its size.
* Every set keeps a consistent sample of ``SKETCH`` of its shingles. A run starts from all sets and splits them: under a path
  of shingles, a set goes on to the sampled shingles with the smallest hash under that path, ``ROOT_BRANCH`` of them at the
  root and ``BRANCH`` below. Two similar sets share most samples and so share a path with high probability in each run;
  ``runs_for(recall)`` independent runs are made.
* Buckets of at most ``LIMIT`` sets are compared by brute force; larger ones are split again along longer paths, so sets that
  share one passage only drift apart. A large bucket that a split hardly thins out holds near copies: it is compared at once, by
  pairs of blocks, as is what is still large at ``DEPTH``. No bucket is dropped or capped.
* Sets whose samples agree loosely (well below the threshold) are tied into candidate groups, and each group's full sets are
  compared exactly, by pairs of blocks where the group is large. Links are counted in place; only one edge per set and block
  leaves a task, so a group of any size gives rows in proportion to its members.

The sample only proposes: a pair at the threshold shares four fifths of its sample on average, whatever the length of its texts, and
its full sets decide. Recall is measured against all pairs in the tests, on long texts too.

Defined results: null, empty and blank texts have no shingles, no links and a class of their own; a text of fewer than five words has
one shingle, all of them; equal texts link to each other, whatever their ids; rows with the same id are kept apart by their texts,
rows that agree in both are copies of each other; a null id is larger than any other and comes back null (a class of null ids only
has a null class id); very long texts are compared whole; an empty table gives no rows; other columns are ignored by the join and
kept by :func:`keep_one`, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import connected_components, materialize, shuffle_partitions
from .tokens import grams, hash_words, inside, mix64, owners, slices, split_words

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
SKETCH = 64
ROOT_BRANCH = 4
BRANCH = 2
LIMIT = 512
DEPTH = 6
THINNED = 0.7
LOOSE = 0.6
BLOCK = 512


def runs_for(recall: float, threshold: float = THRESHOLD, branch: int = ROOT_BRANCH) -> int:
    """Runs until a pair at the threshold shares a path with probability ``recall``.

    Of ``branch`` shingles a pair shares about ``branch * 2 t / (1 + t)`` on each level; ``q`` is the chance that a
    Poisson branching process with that mean dies out before it reaches any depth.
    """
    mean, q = branch * 2 * threshold / (1 + threshold), 0.0
    for _ in range(200):
        q = math.exp(-mean * (1 - q))
    return max(1, math.ceil(math.log(1 - recall) / math.log(q)))


def shingles(texts: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """``(row, shingle)`` of the distinct shingles of each text, sorted by row and shingle."""
    flat, counts = split_words(texts)
    h = hash_words(flat)
    ok, own = inside(counts, n), owners(counts)
    rows, sh = own[: len(ok)][ok], grams(h, n)[ok] if len(ok) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        starts = np.cumsum(counts) - counts
        more = np.array([grams(h[starts[k] : starts[k] + counts[k]], int(counts[k]))[0] for k in short.tolist()], np.uint64)
        rows, sh = np.concatenate([rows, short]), np.concatenate([sh, mix64(more, 77)])
    order = np.lexsort((sh, rows))
    rows, sh = rows[order], sh[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (sh[1:] != sh[:-1])
    return rows[new], sh[new]


def _set_keys(rows: np.ndarray, sh: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(size, end, digest)`` of each row's set; the digest does not depend on the order of its shingles."""
    size = np.bincount(rows, minlength=n)
    ends = np.cumsum(size)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(sh, 21), dtype=np.uint64)])
    return size, ends, mix64(total[ends] - total[ends - size] + size.astype(np.uint64), 22).view(np.int64)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, tag, key, size, sketch`` of every row: digests of the text and of the shingle set (null without shingles), its size, its sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in slices(batch, "text"):
                rows, sh = shingles(cut.column("text"))
                size, ends, key = _set_keys(rows, sh, len(cut))
                rank = mix64(sh, 23)
                order = np.lexsort((rank, rows))
                place = np.arange(len(rows)) - np.repeat(ends - size, size)
                picked = order[place < SKETCH]
                sketch = rank[picked].astype(np.uint32).tobytes()
                at = np.concatenate([[0], np.cumsum(np.minimum(size, SKETCH))]) * 4
                yield pa.RecordBatch.from_arrays(
                    [cut.column("id"), cut.column("tag"), pa.array(key, mask=size == 0), pa.array(size, pa.int32()), pa.array([sketch[a:b] for a, b in zip(at[:-1], at[1:])], pa.binary())],
                        ["id", "tag", "key", "size", "sketch"],
                )

    return _tagged(docs, id_col, text_col).mapInArrow(run, "id bigint, tag bigint, key bigint, size int, sketch binary")


def _tagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, tag, text``; id and tag name a row up to repetitions of it."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("tag"), F.col(text_col).alias("text"))


def _matrix(sketches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sketches as rows of a padded matrix, and the mask of its real entries."""
    values = [np.frombuffer(b, np.uint32) for b in sketches.to_pylist()]
    mask = np.zeros((len(values), SKETCH), bool)
    m = np.zeros((len(values), SKETCH), np.uint32)
    for k, v in enumerate(values):
        m[k, : len(v)], mask[k, : len(v)] = v, True
    return m, mask


def children(paths: np.ndarray, sketch: np.ndarray, mask: np.ndarray, branch: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, child path)``: under its path, each row goes on to its ``branch`` shingles of smallest hash."""
    score = mix64(sketch.astype(np.uint64) ^ paths[:, None], 31)
    score[~mask] = np.uint64(0xFFFFFFFFFFFFFFFF)
    k = min(branch, score.shape[1])
    pick = np.argpartition(score, k - 1, axis=1)[:, :k]
    ok = np.take_along_axis(mask, pick, axis=1)
    child = np.take_along_axis(score, pick, axis=1)  # names path and shingle at once
    return np.repeat(np.arange(len(paths)), k)[ok.ravel()], child.ravel()[ok.ravel()]


def _split(rows: DataFrame, roots: int) -> DataFrame:
    """``path, key, was`` of the children of ``(path, key, sketch, n)`` rows; with ``roots``, of that many root paths instead.

    ``was`` is the size of the bucket that a child comes from (0 at the root).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2000):
                batch = whole.slice(at, 2000)
                sketch, mask = _matrix(batch.column("sketch"))
                keys = batch.column("key").to_numpy()
                if roots:
                    starts, was = [np.full(len(batch), mix64(np.array([r + 1], np.uint64), 41)[0]) for r in range(roots)], np.zeros(len(batch), np.int64)
                else:
                    starts, was = [batch.column("path").to_numpy().view(np.uint64)], batch.column("n").to_numpy()
                for p in starts:
                    row, child = children(p, sketch, mask, ROOT_BRANCH if roots else BRANCH)
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(keys[row]), pa.array(was[row])], ["path", "key", "was"])

    return rows.mapInArrow(run, "path bigint, key bigint, was bigint")


def _overlaps(values: np.ndarray, rows: np.ndarray, n: int, chunk: int = 4096) -> np.ndarray:
    """``n x n`` counts of common values; only values of several rows count, a block of columns at a time."""
    u, inverse, count = np.unique(values, return_inverse=True, return_counts=True)
    both = count[inverse] > 1
    col = np.cumsum(count > 1)[inverse[both]] - 1
    r = rows[both]
    out = np.zeros((n, n), np.float32)
    width = int((count > 1).sum())
    order = np.argsort(col, kind="stable")
    col, r = col[order], r[order]
    for a in range(0, width, chunk):
        lo, hi = np.searchsorted(col, [a, a + chunk])
        x = np.zeros((n, min(chunk, width - a)), np.float32)
        x[r[lo:hi], col[lo:hi] - a] = 1
        out += x @ x.T
    return out


def _stars(linked: np.ndarray, keys: np.ndarray) -> list[tuple[int, int]]:
    """``(smallest key, other key)`` of every component of a symmetric boolean matrix.

    Buckets that hold the same group mostly name the same smallest key, so their edges coincide.
    """
    seen, edges = np.zeros(len(linked), bool), []
    for root in np.flatnonzero(linked.any(axis=1)).tolist():
        if seen[root]:
            continue
        seen[root] = True
        members, front = [root], np.array([root])
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & ~seen)
            seen[front] = True
            members += front.tolist()
        own = keys[members]
        least = own.min()
        edges += [(int(least), int(k)) for k in own.tolist() if k != least]
    return edges


def _grouped(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """Runs of rows that agree on ``columns``, from batches sorted by them."""
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, at: int) -> tuple:
        return tuple(batch.column(c)[at].as_py() for c in columns)

    for batch in batches:
        if not len(batch):
            continue
        change = np.zeros(len(batch), bool)
        for c in columns:
            v = batch.column(c).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = batch.slice(a, b - a)
            if held and key(held[0], 0) != key(part, 0):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _blocks(df: DataFrame, group: str, n: str, limit: int) -> DataFrame:
    """Each row once for every pair of blocks that its block belongs to: adds ``bi, bj`` (own block: ``own``).

    A group of ``n`` rows has ``ceil(n / limit)`` blocks; up to ``limit`` rows there is one pair.
    """
    k = F.ceil(F.col(n) / F.lit(limit)).cast("int")
    own = F.pmod(F.xxhash64("key", group), k).cast("int")
    spread = df.withColumns({"_k": k, "own": own}).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return spread.withColumns({"bi": F.least("own", "_o"), "bj": F.greatest("own", "_o")}).drop("_k", "_o")


def _tie(buckets: DataFrame) -> DataFrame:
    """``a, b``: star edges between sets of a bucket whose samples agree loosely. Input: path, key, sketch, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for t in _grouped(batches, ["path", "bi", "bj"]):
            keys = t.column("key").to_numpy()
            parts = [np.frombuffer(x, np.uint32) for x in t.column("sketch").to_pylist()]
            size = np.array([len(p) for p in parts])
            if len(keys) == 2:
                common = len(np.intersect1d(parts[0], parts[1], assume_unique=True))
                if common >= LOOSE * size.min():
                    a.append(keys[0])
                    b.append(keys[1])
            elif len(keys) > 2:
                common = _overlaps(np.concatenate(parts), np.repeat(np.arange(len(parts)), size), len(parts))
                linked = common >= LOOSE * np.minimum(size[:, None], size[None, :])
                np.fill_diagonal(linked, False)
                for x, y in _stars(linked, keys):
                    a.append(x)
                    b.append(y)
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    parts = shuffle_partitions(buckets.sparkSession)
    ready = _blocks(buckets, "path", "n", 2 * LIMIT).select("path", "bi", "bj", "key", "sketch").repartition(parts, "path", "bi", "bj").sortWithinPartitions("path", "bi", "bj")
    return ready.mapInArrow(run, "a bigint, b bigint")


def candidate_edges(classes: DataFrame, recall: float = RECALL) -> DataFrame:
    """``a, b`` between set keys: the chosen-path runs. ``classes``: one row per distinct set (``key, sketch``)."""
    rows, roots, ties = classes, runs_for(recall), None
    for depth in range(1, DEPTH + 1):
        paths = materialize(_split(rows, roots if depth == 1 else 0), "paths")
        sizes = paths.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        # samples grow with the corpus, so they are shuffled at every size and never broadcast
        met = paths.join(sizes, "path").join(classes.select("key", "sketch").hint("merge"), "key")
        met = materialize(met.select("path", "key", "sketch", "n", "was"), "met")
        big = (F.col("n") > LIMIT) & ((F.col("was") == 0) | (F.col("n") < THINNED * F.col("was")))
        done = met.where(~big) if depth < DEPTH else met
        edges = _tie(done)
        ties = edges if ties is None else ties.unionByName(edges)
        rows = met.where(big)
        if depth == DEPTH or rows.isEmpty():
            break
    return ties


def _exact(sets: DataFrame) -> DataFrame:
    """Links within candidate groups. Input: ``comp, n, key, copies, set``. Output rows: ``a, b, texts, docs``.

    ``b`` set: a star edge of the links found; else the number of linked texts and documents of ``a`` in one block pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, ["comp", "bi", "bj"]):
            t = t.take(np.unique(t.column("key").to_numpy(), return_index=True)[1])  # repeated rows
            keys, copies, own = (t.column(c).to_numpy() for c in ("key", "copies", "own"))
            if len(keys) < 2:
                continue
            parts = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
            size = np.array([len(p) for p in parts], np.float64)
            common = _overlaps(np.concatenate(parts), np.repeat(np.arange(len(parts)), size.astype(np.int64)), len(parts)).astype(np.float64)
            linked = common >= THRESHOLD * (size[:, None] + size[None, :] - common) - 1e-9
            np.fill_diagonal(linked, False)
            if t.column("bi")[0].as_py() != t.column("bj")[0].as_py():
                linked &= own[:, None] != own[None, :]  # pairs within a block are counted where the block meets itself
            hit = np.flatnonzero(linked.any(axis=1))
            if not len(hit):
                continue
            edges = _stars(linked, keys)
            a = [x for x, _ in edges] + keys[hit].tolist()
            b = [y for _, y in edges] + [None] * len(hit)
            texts = [0] * len(edges) + linked[hit].sum(axis=1).tolist()
            docs = [0] * len(edges) + (linked[hit] @ copies).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(texts, pa.int64()), pa.array(docs, pa.int64())], ["a", "b", "texts", "docs"])

    parts = shuffle_partitions(sets.sparkSession)
    ready = _blocks(sets, "comp", "n", BLOCK).select("comp", "bi", "bj", "own", "key", "copies", "set").repartition(parts, "comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj")
    return ready.mapInArrow(run, "a bigint, b bigint, texts bigint, docs bigint")


def _classes(docs: DataFrame, id_col: str, text_col: str, recall: float) -> tuple[DataFrame, DataFrame]:
    """``(features of every row, key: first, copies, texts, docs)``; ``first``: the least row of the class, as ``(null, id, tag)``."""
    feats = materialize(features(docs, id_col, text_col), "features")
    row = F.struct(F.col("id").isNull().alias("null"), "id", "tag")  # null ids come last
    classes = feats.where("key is not null").groupBy("key").agg(F.min(row).alias("rep"), F.count("*").alias("copies"), F.min("sketch").alias("sketch"))
    classes = materialize(classes, "classes")
    groups = materialize(connected_components(candidate_edges(classes, recall)).withColumnsRenamed({"node": "key", "component": "comp"}), "groups")
    sizes = groups.groupBy("comp").agg(F.count("*").alias("n"))
    wanted = groups.join(sizes, "comp").join(classes.select("key", "rep", "copies"), "key")

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in slices(batch, "text"):
                rows, sh = shingles(cut.column("text"))
                size, ends, _ = _set_keys(rows, sh, len(cut))
                data = sh.tobytes()
                sets = [data[8 * a : 8 * b] for a, b in zip(ends - size, ends)]
                yield pa.RecordBatch.from_arrays([*(cut.column(c) for c in ("comp", "n", "key", "copies")), pa.array(sets, pa.binary())], ["comp", "n", "key", "copies", "set"])

    # one row of each wanted set carries its text (repetitions of that row are dropped where they meet)
    keyed = wanted.select("comp", "n", "key", "copies", F.col("rep.id").alias("_id"), F.col("rep.tag").alias("_tag"))
    picked = _tagged(docs, id_col, text_col).join(keyed.hint("shuffle_hash"), F.expr("id <=> _id and tag = _tag")).select("comp", "n", "key", "copies", "text")
    found = materialize(_exact(picked.mapInArrow(full_sets, "comp bigint, n bigint, key bigint, copies bigint, set binary")), "links")
    comps = connected_components(found.where("b is not null").select("a", "b")).withColumnsRenamed({"node": "key", "component": "comp"})
    counts = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    info = classes.select("key", "rep", "copies").join(comps, "key", "left").join(counts, "key", "left")
    info = info.withColumn("comp", F.coalesce("comp", "key"))
    least = info.groupBy("comp").agg(F.min("rep").alias("first"))
    return feats, info.join(least, "comp").select("key", "first", "copies", "texts", "docs")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """One row per document: ``doc_id, class_id, n_links, n_copies, n_texts``.

    class_id: smallest id of its class (documents connected by links). n_links: other documents with Jaccard >= 0.8, copies
    counted. n_copies: documents with the same shingle set. n_texts: other distinct sets that it links to.
    """
    feats, info = _classes(docs, id_col, text_col, recall)
    return feats.select("id", "key").join(info, "key", "left").select(
        F.col("id").alias("doc_id"),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("class_id"),
        F.coalesce(F.col("copies") - 1 + F.coalesce("docs", F.lit(0)), F.lit(0)).alias("n_links"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
        F.coalesce("texts", F.lit(0)).alias("n_texts"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """One row of each class, all columns: that with the smallest id, of equal ids that with the smallest text digest.

    Texts without words are classes of their own and all stay.
    """
    feats, info = _classes(docs, id_col, text_col, recall)
    placed = feats.where("key is not null").join(info.select("key", "first"), "key")
    rows = placed.groupBy("id", "tag").agg(F.count("*").alias("n"), F.first(F.expr("first.id <=> id and first.tag = tag")).alias("stays"))
    rows = materialize(rows.where("not stays or n > 1").select(F.col("id").alias("__id"), F.col("tag").alias("__tag"), "stays"), "decided")
    same = docs[id_col].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__tag"))
    out = docs.join(rows.hint("merge"), same, "left_anti")  # grows with the corpus: shuffled at every size, never broadcast
    if not rows.where("stays").isEmpty():  # the row that stays is there several times
        packed = docs.join(rows.where("stays"), same, "left_semi").select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_tag"))
        w = Window.partitionBy("_id", "_tag").orderBy("_tag")  # a group limit leaves one row of each task before the shuffle
        out = out.unionByName(packed.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("_doc.*"))
    return out
