import random
import time
import re
from collections import defaultdict

import pyarrow as pa
import pytest

from fieldbook.llm import decontaminate, jaccard_join, substring_dedup

from .conftest import sentence


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_spans(rows, k=13):
    least = {}
    big = 1 << 62
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - k + 1):
            x = tuple(w[i : i + k])
            least[x] = min(least.get(x, big), big if d is None else d)
    out = []
    for d, t in rows:
        w, gone = words(t), set()
        for i in range(len(w) - k + 1):
            if least[tuple(w[i : i + k])] < (big if d is None else d):
                gone.update(range(i, i + k))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def test_substring_odd_rows(spark, odd, odd_rows, empty):
    got = sorted((tuple(r) for r in substring_dedup.remove_repeats(odd).collect()), key=repr)
    assert got == brute_spans([r[:2] for r in odd_rows])
    assert substring_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("k, m", [(13, 3), (5, 2), (8, 8)])
def test_substring_shared_passages(spark, docs_of, k, m):
    rng = random.Random(k)
    passages = [sentence(rng, 25, 10_000) for _ in range(4)]
    rows = []
    for d in range(80):
        parts = [sentence(rng, rng.randrange(30)), rng.choice(passages), sentence(rng, rng.randrange(20), 10_000), rng.choice(passages)]
        rows.append((d, "\n".join(parts), "en", "s"))
    got = sorted((tuple(r) for r in substring_dedup.remove_repeats(docs_of(rows), k=k, m=m).collect()), key=repr)
    assert got == brute_spans([r[:2] for r in rows], k)


def test_substring_repeated_and_null_ids(spark, docs_of):
    """Rows of one id with different texts each keep their own positions."""
    rng = random.Random(4)
    p = " ".join(f"q{i}" for i in range(20))
    texts = [(1, p), (5, "a b c d e " + p), (5, "n1 n2 n3 n4 n5 n6 n7 n8 n9"), (5, "x " * 30 + p + " tail"), (None, p), (None, "z z z"), (None, "k " + p + " " + sentence(rng, 50)), (1, p), (7, None), (7, p[3:] + " end")]
    rows = [(d, t, "en", "s") for d, t in texts]
    got = sorted((tuple(r) for r in substring_dedup.remove_repeats(docs_of(rows).coalesce(1)).collect()), key=repr)
    assert got == brute_spans([r[:2] for r in rows])
    assert next(r[2] for r in got if r[0] == 1) == 0


@pytest.mark.parametrize("limit", [1, 3000])
def test_substring_hot_minimiser(spark, docs_of, monkeypatch, limit):
    """Buckets beyond the limit are judged in chunks and by whole windows."""
    monkeypatch.setattr(substring_dedup, "LIMIT_BYTES", limit)
    rng = random.Random(6)
    common, passages = "hot1 hot2 hot3", [sentence(rng, 20, 10**6) for _ in range(3)]
    rows = []
    for d in range(150):
        around = [sentence(rng, 6, 10**6) for _ in range(8)]
        rows.append((rng.choice([d, d, 3, None]), f" {common} ".join(around) + " " + rng.choice(passages), "en", "s"))
    got = sorted((tuple(r) for r in substring_dedup.remove_repeats(docs_of(rows).repartition(7)).collect()), key=repr)
    assert got == brute_spans([r[:2] for r in rows])


def brute_join(rows):
    sets = []
    for d, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-12:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i, (d, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((d, min(ids) if ids else None, len(links[i])))
    return sorted(out, key=repr)


def near_copies(rng, n, words_each, edits):
    base = [f"t{rng.randrange(10**6)}" for _ in range(words_each)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("limit, block", [(512, 512), (6, 4)])
def test_join_against_brute_force(spark, docs_of, monkeypatch, limit, block):
    """Small limits send the groups through deeper paths and pairs of blocks."""
    monkeypatch.setattr(jaccard_join, "LIMIT", limit)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(3)
    passage = sentence(rng, 60, 10**6)
    texts = near_copies(rng, 25, 200, 2) + near_copies(rng, 4, 120, 3) + [f"{passage} {sentence(rng, 90, 10**6)}" for _ in range(30)] + [sentence(rng, 80, 10**6) for _ in range(10)]
    texts += [texts[0]] * 3 + ["a b", "a b", "a b c", "", None]
    rows = [(1000 - i, t, "en", "s") for i, t in enumerate(texts)]
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.join(docs_of(rows)).collect()), key=repr)
    want = brute_join([r[:2] for r in rows])
    assert len(got) == len(want)
    blank = {rows[i][0] for i in (len(rows) - 1, len(rows) - 2)}
    assert [g for g in got if g[0] not in blank] == [w for w in want if w[0] not in blank]
    assert all(g[1] == g[0] and g[2] == 0 for g in got if g[0] in blank)


def test_join_odd_rows(spark, odd, odd_rows, empty):
    got = {}
    for r in jaccard_join.join(odd).collect():
        got.setdefault(r["doc_id"], set()).add(r["class_id"])
    assert got[10] == got[0] == got[11] == {0} and got[None] == got[1] == {1} and got[17] == {16} and got[12] == {12}
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert 10 not in ids and 17 not in ids and {0, 1, 12, 13, 14, 15, 16} <= set(ids)
    assert jaccard_join.join(empty).count() == 0


def test_keep_one_of_repeated_and_null_ids(spark, docs_of):
    """One row of each class stays: no copy of it, and no other document that only shares its id."""
    rng = random.Random(9)
    a, b, c, d = (sentence(rng, 40, 10**6) for _ in range(4))
    rows = [(1, a), (1, a), (1, b), (2, a), (None, a), (None, c), (None, c + " more"), (None, d), (3, d + " x"), (4, None), (4, ""), (5, c + " q r s t u v w x y z a b c d e f g h i")]
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.keep_one(docs_of([(*r, "en", "s") for r in rows])).collect()]
    assert sorted(kept, key=repr) == sorted([(1, a), (1, b), (3, d + " x"), (4, None), (4, ""), (5, rows[-1][1]), max((r for r in kept if r[1] and r[1].startswith(c) and r[0] is None), key=len)], key=repr)


def exact_links(rows):
    """All pairs with Jaccard >= 0.8 through an inverted index."""
    sets = {}
    for d, t in rows:
        w = words(t)
        if len(w) >= 5:
            sets[d] = {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}
    index, pairs = defaultdict(list), set()
    for d in sorted(sets, key=lambda d: (len(sets[d]), d)):
        x, common = sets[d], defaultdict(int)
        # a partner that is not longer shares one of the rarest fifth of the shingles, in any fixed order
        prefix = sorted(x, key=hash)[: len(x) - int(0.8 * len(x) - 1e-9) + 1]
        for sh in prefix:
            for e in index[sh]:
                common[e] += 1
            index[sh].append(d)
        pairs |= {(min(d, e), max(d, e)) for e in common if len(x & sets[e]) >= 0.8 * len(x | sets[e]) - 1e-12}
    return pairs


@pytest.mark.parametrize("long", [False, True])
def test_join_recall_against_all_pairs(spark, docs_of, long):
    if long:
        rng = random.Random(21)
        texts = [t for n in (3_000, 9_000) for e in (10, 30) for t in near_copies(rng, 6, n, e * n // 3_000)]
        rows = [(i, t) for i, t in enumerate(texts)]
        df = docs_of([(*r, "en", "s") for r in rows])
    else:
        df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    pairs, want = exact_links(rows), defaultdict(int)
    for a, b in pairs:
        want[a] += 1
        want[b] += 1
    got = {r["doc_id"]: r["n_links"] for r in jaccard_join.join(df).collect()}
    assert all(got[d] <= want[d] for d in want)
    recall = sum(got[d] for d in want) / max(1, sum(want.values()))
    print("links", len(pairs), "recall", recall)
    assert recall >= 0.99 and len(pairs) > 10


def test_more_recall_needs_more_runs():
    assert jaccard_join.runs_for(0.9) <= jaccard_join.runs_for(0.9999) <= 6


BENCH = "item_id bigint, text string, extra string"


def edited(rng, ws, n):
    ws = list(ws)
    for _ in range(n):
        k, at = rng.randrange(3), rng.randrange(len(ws))
        if k == 0:
            ws[at] = f"sub{rng.randrange(999)}"
        elif k == 1:
            del ws[at]
        else:
            ws.insert(at, f"ins{rng.randrange(999)}")
    return ws


def test_decontamination_recall_and_cleanness(spark, docs_of):
    rng = random.Random(8)
    items = [[f"v{rng.randrange(3000)}" for _ in range(rng.randrange(10, 50))] for _ in range(60)]
    rows, planted = [], set()
    for k, it in enumerate(items):
        for e in (0, decontaminate.edits_allowed(len(it))):
            d = len(rows)
            rows.append((d, " ".join([*(f"v{rng.randrange(3000)}" for _ in range(40)), *edited(rng, it, e), *(f"v{rng.randrange(3000)}" for _ in range(40))]), "en", "s"))
            planted.add((d, k, e == 0))
    clean = [(len(rows) + i, " ".join(f"v{rng.randrange(3000)}" for _ in range(200)), "en", "s") for i in range(40)]
    bench = spark.createDataFrame([(k, " ".join(it), "x") for k, it in enumerate(items)], BENCH)
    df = docs_of(rows + clean)
    found = decontaminate.find_matches(df, bench).collect()
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in found}
    assert all(got.get((d, k)) == 0 for d, k, exact in planted if exact)
    assert sum((d, k) in got for d, k, _ in planted) >= 0.97 * len(planted)
    assert all(e <= decontaminate.edits_allowed(len(items[k])) for (_, k), e in got.items())
    left = {r[0] for r in decontaminate.remove_contaminated(df, bench).select("doc_id").collect()}
    assert {c[0] for c in clean} <= left and left == {r[0] for r in rows + clean} - {d for d, _ in got}


def test_best_alignment_is_exact():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(300):
        a, t = rng.integers(0, 4, rng.integers(1, 9)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 14)).astype(np.uint64)
        assert decontaminate.best_alignment(a, t)[0] == plain_distance(a, t)


def plain_distance(item, text):
    """Least word edits of the item against any stretch of the text."""
    prev = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        cur = [i]
        for j in range(1, len(text) + 1):
            cur.append(min(prev[j - 1] + (text[j - 1] != w), prev[j] + 1, cur[j - 1] + 1))
        prev = cur
    return min(prev)


def test_decontamination_all_pairs(spark, docs_of):
    """Every document against every item by plain edit distance; also with several blocks of items."""
    rng = random.Random(12)
    pool = [f"v{i}" for i in range(60)]
    items = [[rng.choice(pool) for _ in range(n)] for n in (5, 6, 9, 14, 14, 20, 33, 40, 70)] * 2
    texts = [[rng.choice(pool) for _ in range(rng.randrange(80))] for _ in range(12)]
    texts += [[*rng.sample(pool, 8), *edited(rng, it, rng.randrange(len(it) // 4 + 1)), *rng.sample(pool, 5)] for it in items for _ in range(2)]
    df = docs_of([(None if i % 9 == 0 else i, " ".join(t), "en", "s") for i, t in enumerate(texts)])
    bench = spark.createDataFrame([(k, " ".join(it), "x") for k, it in enumerate(items)], BENCH)
    want = {(i, k): e for i, t in enumerate(texts) for k, it in enumerate(items) if (e := plain_distance(it, t)) <= decontaminate.edits_allowed(len(it))}
    for options in ({}, {"size": 5}, {"most": 300}):
        found = decontaminate.find_matches(df, bench, **options).collect()
        got = {(r["doc_id"], r["item_id"]): r["edits"] for r in found if r["doc_id"] is not None}
        assert all(want[key] == e for key, e in got.items())
        named = {key for key in want if key[0] % 9}
        assert len(got) >= 0.97 * len(named)
        left = decontaminate.remove_contaminated(df, bench, **options).where("doc_id is not null").select("doc_id").collect()
        assert {r[0] for r in left} == {i for i in range(len(texts)) if i % 9} - {i for i, _ in got}


def test_decontamination_repeats_reach_recall():
    """Held-out random edits of hard items meet as often as the fit promises."""
    import numpy as np

    rng = np.random.default_rng(5)
    items = [rng.integers(1, 1 << 40, n).astype(np.uint64) for n in (10, 12, 14, 15) for _ in range(60)]
    repeats = decontaminate.fit_repeats(items)
    met = 0
    for item in items:
        other = decontaminate.randomly_edited(rng, item, decontaminate.edits_allowed(len(item)), np.concatenate(items))
        keys = decontaminate.lsh_keys(np.stack([item, other]), repeats)
        met += bool((keys[0] == keys[1]).any())
    assert met >= 0.96 * len(items)


def test_decontamination_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], BENCH)
    odd_bench = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "x y", "x"), (None, "a b c d e f", "x"), (4, " ".join(["zz"] * 12), "x"), (4, " ".join(["zz"] * 12), "x")], BENCH)
    assert decontaminate.find_matches(odd, none).count() == 0 and decontaminate.find_matches(odd, odd_bench).count() == 0
    assert decontaminate.remove_contaminated(odd, odd_bench).count() == odd.count()
    assert decontaminate.remove_contaminated(empty, odd_bench).columns == empty.columns


def test_decontamination_finds_short_items_exactly(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(12)]
    docs = [(k, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for k in range(80)]
    items = [(k, " ".join(rng.choices(words, k=1 + k % 4)).upper()) for k in range(24)]
    got = decontaminate.find_matches(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), min_words=1).collect()
    want = {}
    for d, text in docs:
        for i, item in items:
            t, x = text.split(), item.lower().split()
            at = next((p for p in range(len(t) - len(x) + 1) if t[p : p + len(x)] == x), None)
            if at is not None:
                want[d, i] = (0, len(x), at)
    assert {(r["doc_id"], r["item_id"]): (r["edits"], r["item_words"], r["start_word"]) for r in got} == want and len(want) > 200


def test_decontamination_with_a_shared_template():
    """Many items that share half their words, and documents that repeat the template: no match, in bounded time; a real copy is found."""
    rng = random.Random(9)
    template = [f"t{k}" for k in range(11)]
    items = [" ".join(template + [f"x{rng.randrange(50_000)}" for _ in range(rng.randint(11, 14))]) for _ in range(8_000)]
    block = decontaminate.Items(list(range(len(items))), items)
    text = " ".join(" ".join(template + [f"y{rng.randrange(50_000)}" for _ in range(6)]) for _ in range(400))
    copy = items[77].split()
    copy[15] = "changed"
    began = time.perf_counter()
    h, counts = decontaminate._words(pa.array([text, " ".join(copy), text + " " + items[5]]))
    found = block.matches(h, counts)
    assert {(d, k) for d, k, *_ in found} == {(1, 77), (2, 5)} and time.perf_counter() - began < 60


def test_repeats_are_bounded_and_the_rest_is_exact(monkeypatch):
    rng = random.Random(10)
    items = [" ".join(f"v{rng.randrange(30)}" for _ in range(20)) for _ in range(15)]
    text = " ".join(f"v{rng.randrange(30)}" for _ in range(200))
    docs = [text, text + " " + " ".join(items[3].split()[:-2]) + " " + text, items[9]]
    plain = decontaminate.Items(list(range(15)), items)
    monkeypatch.setattr(decontaminate, "MOST_REPEATS", 0)
    monkeypatch.setattr(decontaminate.fit_repeats, "__defaults__", (*decontaminate.fit_repeats.__defaults__[:-1], 0))
    monkeypatch.setattr(decontaminate, "PLACES", 5)
    exact = decontaminate.Items(list(range(15)), items)
    assert all(t is None for t in exact.tables.values())
    h, counts = decontaminate._words(pa.array(docs))
    a, b = ({(d, k): e for d, k, e, *_ in x.matches(h, counts)} for x in (plain, exact))
    assert a == b and {(1, 3), (2, 9)} <= set(b)
