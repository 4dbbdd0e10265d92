"""Prefix trie of conversations: distributed MSD radix partitioning over dictionary-encoded turns.

Distinct turns (role, text) are told apart by 128 bits of SHA-256 and numbered; the numbers of very common turns are broadcast (they are
bounded in number), the others joined, so no common turn gathers its rows in one task. A conversation becomes an array of turn numbers and
equal conversations one *class* with a count. All classes begin in one bucket. A bucket of more than ``MEMBERS`` classes (or ``IDS``
turns) is split: its longest common prefix becomes a chain of nodes at once, and the next turn is the digit that deals its classes
over new buckets. Buckets small enough are finished in one task each by multikey quicksort (three-way partition on the turn at the
current depth), which emits a node for each part of equal turns. Counts below a split bucket are summed upwards, round by round, from one row
for each bucket. Text is read once, where it is hashed; nothing wider than a turn's number is shuffled.

Defined results: rows with a null conv_id name no conversation and take no part; null roles and texts are empty; null turns come first;
rows of one conversation with equal turns are ordered by role, then by the digest of the turn (repeated rows stay and are turns of
their own); very long texts are hashed whole; a conversation is held as an array, 12 bytes a turn; a conversation without turns
(rebuilding may leave none) ends in the root; an empty table has no node, not even a root; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, shuffle_partitions

#: A bucket is finished in one task if it has at most so many classes and turns (or one class).
MEMBERS, IDS = 8_192, 500_000
#: Common turns whose numbers are broadcast: at most so many for each shuffle partition.
COMMON = 16
#: Ids of a class that are joined into one part before the parts are hashed in order.
PART = 1_024
#: Split buckets up to this number are broadcast to their rows.
BROADCAST_BUCKETS = 50_000
EMPTY = hashlib.sha256(b"").hexdigest()
#: The turn that every sequence begins with: the root.
ROOT = -1

SHARED, BLOCK = 6, 100


def numbered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest, id, size`` from ``conv_id, turn, role, text``; ``size`` is the text's code points."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.substring(F.unhex(F.sha2(named, 256)), 1, 16).alias("digest"), F.length(text).alias("size")
    )
    rows = materialize(rows, "turns")
    words = materialize(rows.groupBy("digest").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "dictionary")
    total = words.agg(F.sum("n")).first()[0] or 0
    common = max(total // (COMMON * shuffle_partitions(turns.sparkSession)), 1_000)
    known = rows.join(F.broadcast(words.where(F.col("n") >= common).select("digest", "id")), "digest", "left")
    rare = known.where("id is null").drop("id").join(words.where(F.col("n") < common).select("digest", "id"), "digest")
    return known.where("id is not null").unionByName(rare)


def sequences(numbered: DataFrame) -> DataFrame:
    """``conv_id, steps``: the turns of each conversation in order, as ``(id, size)``."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "digest", "id", "size")))
    return numbered.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("steps"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Each conversation begins with the first turns of that at the start of its block of ids."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    own = materialize(own, "own")
    first = own.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("base"), F.slice("steps", 1, SHARED - 1).alias("lead"))
    rows = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK).withColumn("h", h.cast("int")).join(first, "base", "left")
    lead = F.coalesce(F.slice("lead", F.lit(1), F.col("h")), F.slice("steps", 1, 0))
    rest = F.slice("steps", F.col("h") + 1, F.greatest(F.size("steps") - F.col("h"), F.lit(0)))
    return rows.select("conv_id", F.concat(lead, rest).alias("steps"))


def _hash_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the parts of each class in order; holds one batch and one running hash."""
    key, state, out = None, None, []
    for batch in batches:
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k == key:
                state.update(b"," + text.encode())
            else:
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(text.encode())
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["class", "ends"])
            out = []
    if key is not None:
        out.append((key, state.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["class", "ends"])


def classes(conversations: DataFrame) -> DataFrame:
    """``seq, sizes, n, conv_id, ends``: the distinct sequences with their members' number, smallest id and digest.

    Ids of a class meet in parts of consecutive ids, however many members it has; the parts are hashed one after the other.
    """
    rows = conversations.select("conv_id", F.concat(F.array(F.lit(ROOT).cast("long")), F.col("steps.id")).alias("seq"), F.concat(F.array(F.lit(0)), F.col("steps.size")).alias("sizes"))
    rows = materialize(rows.withColumn("class", F.substring(F.unhex(F.sha2(F.array_join("seq", ","), 256)), 1, 16)), "rebuilt")
    parts = rows.groupBy("class", F.floor(F.col("conv_id") / PART).alias("part")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    ends = parts.repartition(shuffle_partitions(rows.sparkSession), "class").sortWithinPartitions("class", "part").select("class", "ids").mapInArrow(_hash_parts, "class binary, ends string")
    found = rows.groupBy("class", "seq", "sizes").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    return found.join(ends, "class").drop("class")


# ---------------------------------------------------------------- buckets in one task

NODES = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def multikey_quicksort(seqs: list[np.ndarray], depth: int, n: np.ndarray, conv: np.ndarray) -> tuple[list[int], list[int], list[int], list[int], list[int], list[int]]:
    """Nodes below ``depth`` of distinct sequences that agree up to it.

    Returns ``(conv, depth, parent, n, member, end)`` of each node; parents come first, ``parent`` is a node's place (-1: none),
    ``member`` any of its sequences, ``end`` the sequence that ends there (-1: none).
    """
    out: tuple[list[int], ...] = ([], [], [], [], [], [])

    def emit(*node: int) -> int:
        for column, x in zip(out, node):
            column.append(x)
        return len(out[0]) - 1

    todo = [(np.arange(len(seqs)), depth, -1)]
    while todo:
        rows, d, parent = todo.pop()
        if len(rows) == 1:  # the rest of a single sequence is a chain
            k = int(rows[0])
            last = len(seqs[k])
            for at in range(d + 1, last + 1):
                parent = emit(int(conv[k]), at, parent, int(n[k]), k, k if at == last else -1)
            continue
        turn = np.array([seqs[k][d] for k in rows])
        pivot = sorted((turn[0], turn[len(turn) // 2], turn[-1]))[1]
        less, equal = turn < pivot, turn == pivot
        for side in (rows[less], rows[turn > pivot]):
            if len(side):
                todo.append((side, d, parent))
        same = rows[equal]
        done = [k for k in same if len(seqs[k]) == d + 1]  # at most one, as the sequences are distinct
        node = emit(int(conv[same].min()), d + 1, parent, int(n[same].sum()), int(same[0]), int(done[0]) if done else -1)
        more = same[[len(seqs[k]) > d + 1 for k in same]]
        if len(more):
            todo.append((more, d + 1, node))
    return out


def _finish(table: pa.Table) -> pa.Table:
    """All nodes of one bucket."""
    depth, above = table["depth"][0].as_py(), table["above"][0].as_py()
    seqs = [np.asarray(x.values) for x in table["seq"]]
    sizes = [np.asarray(x.values) for x in table["sizes"]]
    ends = table["ends"].to_pylist()
    conv, at, parent, n, member, end = multikey_quicksort(seqs, depth, table["n"].to_numpy(), table["conv_id"].to_numpy())
    children, leaves = [0] * len(conv), [0] * len(conv)
    saved = [(c - 1) * int(sizes[m][d - 1]) for c, m, d in zip(n, member, at)]
    for k in range(len(conv) - 1, -1, -1):
        leaves[k] = leaves[k] or 1
        if (p := parent[k]) >= 0:
            children[p] += 1
            leaves[p] += leaves[k]
            saved[p] += saved[k]
    names = [x.split()[0] for x in NODES.split(", ")]
    columns = [conv, [d - 1 for d in at], [conv[p] if p >= 0 else above for p in parent], n, children, leaves, saved, [ends[e] if e >= 0 else EMPTY for e in end], [p < 0 for p in parent]]
    types = [*[pa.int64()] * 7, pa.string(), pa.bool_()]
    made = pa.table([pa.array(c, t) for c, t in zip(columns, types)], [*names, "top"])
    up = table["up"][0].as_py()
    return made.append_column("up", pa.array([up] * len(made), pa.string()))


# ---------------------------------------------------------------- partitioning


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays."""
    both = F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda t: t["x"].eqNullSafe(t["y"]))
    differs = F.array_position(both, F.lit(False))
    return F.when(differs > 0, differs - 1).otherwise(F.least(F.size(a), F.size(b)).cast("long")).cast("int")


def _deal(rows: DataFrame, large: DataFrame) -> DataFrame:
    """The rows of the split buckets with their bucket's columns: a broadcast while the buckets are few, else a salted join."""
    if large.count() <= BROADCAST_BUCKETS:
        return rows.join(F.broadcast(large), "bucket")
    salted = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(16)).cast("int")).join(salted, ["bucket", "salt"]).drop("salt")


def nodes(found: DataFrame, members: int = MEMBERS, ids: int = IDS) -> DataFrame:
    """The trie of the classes ``seq, sizes, n, conv_id, ends``, whose sequences all begin with :data:`ROOT`."""
    start = [F.lit("").alias("bucket"), F.lit(None).cast("string").alias("up"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("above")]
    active = materialize(found.select("*", *start), "classes")
    local, split = [], []
    while True:
        sizes = active.groupBy("bucket").agg(F.count("*").alias("members"), F.sum(F.size("seq") - F.col("depth")).alias("turns"))
        large = (F.col("members") > 1) & ((F.col("members") > members) | (F.col("turns") > ids))
        sizes = materialize(sizes.select("bucket", large.alias("large")), "buckets")
        if sizes.where("large").isEmpty():
            local.append(active)
            break
        marked = _deal(active, sizes)
        local.append(marked.where("not large").drop("large"))
        rest = marked.where("large").drop("large")
        about = rest.groupBy("bucket", "up", "depth", "above").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"))
        about = materialize(about.withColumn("stop", common_prefix(F.col("lo"), F.col("hi"))).drop("lo", "hi"), "prefixes")
        dealt = _deal(rest, about.select("bucket", "stop", F.col("conv_id").alias("over")))
        ended = F.size("seq") == F.col("stop")
        dealt = materialize(dealt, "dealt")
        chains = dealt.groupBy("bucket").agg(F.min_by(F.slice("sizes", F.col("depth") + 1, F.col("stop") - F.col("depth")), "conv_id").alias("chain"), F.max(F.when(ended, F.col("ends"))).alias("ends"))
        split.append(materialize(about.join(chains, "bucket"), "split"))
        key = F.concat_ws(".", "bucket", F.element_at("seq", F.col("stop") + 1).cast("string"))
        active = dealt.where(~ended).select("seq", "sizes", "n", "conv_id", "ends", key.alias("bucket"), F.col("bucket").alias("up"), F.col("stop").alias("depth"), F.col("over").alias("above"))
    rows = local[0]
    for more in local[1:]:
        rows = rows.unionByName(more)
    made = rows.groupBy("bucket").applyInArrow(_finish, f"{NODES}, top boolean, up string")
    columns = [x.split()[0] for x in NODES.split(", ")]
    if not split:
        return made.select(columns)
    made = materialize(made, "local")
    tops, parts = made.where("top").select("up", "n_leaves", "saved_tokens"), [made.select(columns)]
    for about in reversed(split):
        below = tops.groupBy(F.col("up").alias("bucket")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        whole = about.join(below, "bucket")
        saving = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x) * (F.col("n") - 1) + F.col("below")
        whole = materialize(whole.withColumn("saved_tokens", saving(F.col("chain"))), "summed")
        tops = tops.unionByName(whole.select("up", "n_leaves", "saved_tokens"))
        each = whole.select("*", F.explode(F.sequence(F.col("depth") + 1, F.col("stop"))).alias("at"))
        last = F.col("at") == F.col("stop")
        parts.append(
            each.select(
                "conv_id", (F.col("at") - 1).cast("long").alias("depth"), F.when(F.col("at") == F.col("depth") + 1, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
                F.when(last, F.col("n_children")).otherwise(F.lit(1).cast("long")).alias("n_children"), "n_leaves",
                saving(F.slice("chain", F.col("at") - F.col("depth"), F.col("stop") - F.col("at") + 1)).alias("saved_tokens"),
                F.when(last & F.col("ends").isNotNull(), F.col("ends")).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
            )
        )
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def trie(conversations: DataFrame, rebuild: bool = True, members: int = MEMBERS, ids: int = IDS) -> DataFrame:
    """The nodes of the conversations' trie; ``rebuild`` gives each the shared first turns of its block of ids."""
    own = sequences(numbered_turns(conversations))
    return nodes(classes(rebuilt(own) if rebuild else own), members, ids)
