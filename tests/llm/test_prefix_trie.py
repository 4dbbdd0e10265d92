"""The prefix trie against a dictionary of all prefixes."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldbook.llm import prefix_trie as pt
from fieldbook.llm.shared import table

SCHEMA = "conv_id bigint, turn bigint, role string, text string, id string, size string, digest string, bucket int, seq string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "i", "s", "d", 1, "q") for r in rows], SCHEMA)


def by_hand(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own.setdefault(conv, []).append((turn is not None, turn or 0, role, key, text))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in own.items()}
    whole, members, kids = {}, {}, {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
        for d in range(len(whole[c]) + 1):
            members.setdefault(tuple(whole[c][:d]), []).append(c)
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids.get(k, [])) or 1
        saved[k] = sum(saved[x] for x in kids.get(k, [])) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
        ends = ",".join(map(str, sorted(c for c in members[k] if len(whole[c]) == len(k))))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def in_order(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[:2])


def odd_conversations():
    rng = random.Random(1)
    rows = []
    for c in [*range(-30, 260), 1000, 1001, 2005]:
        rows += [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "häß 😀", None, "c" * 30])) for t in range(rng.choice([1, 1, 2, 3, 7, 9]))]
    rows += [(None, 1, "user", "x"), (7, 1, "user", "a"), (7, 1, "user", "a"), (8, 1, "user", "long " * 50_000)]
    rows += [(c, t, "user", "same") for c in range(300, 340) for t in range(40)]  # copies of one conversation
    return rows + [(c, t, "user", f"s{t // 30 * c}") for c in range(340, 360) for t in range(40)]  # that share their first turns


@pytest.mark.parametrize(("members", "ids"), [(pt.MEMBERS, pt.IDS), (10, 10**6), (2, 10**6), (50, 60)])
def test_odd_rows_at_any_bucket_size(spark, members, ids):
    rows = odd_conversations()
    assert in_order(pt.trie(frame(spark, rows), members=members, ids=ids)) == by_hand(rows)


def test_dictionary_with_common_turns_and_salted_buckets(spark, monkeypatch):
    """Turns above and below the broadcast bound, and buckets that are joined with salt."""
    monkeypatch.setattr(pt, "BROADCAST_BUCKETS", 0)
    rows = [(c, t, "user", "hello" if t == 0 else f"t{c % 7}{t}") for c in range(1200) for t in range(3)]
    assert in_order(pt.trie(frame(spark, rows), members=20)) == by_hand(rows)
    numbered = pt.numbered_turns(frame(spark, rows).drop("id", "size", "digest"))
    assert numbered.count() == len(rows) and numbered.select("id").distinct().count() == numbered.select("digest").distinct().count()


def test_empty_table(spark):
    assert pt.trie(frame(spark, [])).collect() == []


def test_turnless_conversation_ends_in_the_root(spark):
    conv = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    found = in_order(pt.trie(frame(spark, [(conv, 0, "user", "x"), (conv, 1, "user", "y")])))
    assert found == [(conv, 0, None, 1, 0, 1, 0, hashlib.sha256(str(conv).encode()).hexdigest())]


def test_parts_of_a_large_class(spark, monkeypatch):
    """Ids of one class over several parts are hashed in numerical order."""
    monkeypatch.setattr(pt, "PART", 3)
    rows = [(c, 0, "user", "x") for c in range(-20, 150)]
    assert in_order(pt.trie(frame(spark, rows), rebuild=False))[1][7] == hashlib.sha256(",".join(map(str, range(-20, 150))).encode()).hexdigest()


def test_multikey_quicksort_visits_every_prefix_once():
    rng = random.Random(4)
    seqs = sorted({tuple(rng.choices(range(3), k=rng.randint(1, 6))) for _ in range(80)})
    conv, depth, parent, n, member, end = pt.multikey_quicksort([np.array(s) for s in seqs], 0, np.ones(len(seqs), np.int64), np.arange(len(seqs)))
    found = [seqs[m][:d] for m, d in zip(member, depth)]
    assert sorted(found) == sorted({s[:d] for s in seqs for d in range(1, len(s) + 1)})
    assert all(found[k][:-1] == (found[p] if p >= 0 else ()) for k, p in enumerate(parent))
    assert {found[k] for k, e in enumerate(end) if e >= 0} == set(seqs) and all(n[k] == sum(s[: len(f)] == f for s in seqs) for k, f in enumerate(found))


def test_common_prefix(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2, 4]), ([1], [1, 2]), ([], [1]), ([5], [5])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(pt.common_prefix(F.col("a"), F.col("b"))).collect()] == [2, 1, 0, 1]


def test_given_rows(spark):
    df = table(spark, "/root/testdata/sf0.1", "conversations")
    assert in_order(pt.trie(df, members=50)) == by_hand([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
