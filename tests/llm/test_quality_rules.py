import math
import re
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from fieldbook.llm import quality_rules as q

LABELS = "doc_id bigint, quality int, toxic int"


def base_rule(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(win)
    rep = {j for i, x in enumerate(win) if n[x] > 1 for j in range(i, i + 5)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)


def check(spark, df, labels):
    got = q.judge(df, q.weights(df, q.trusted_ids(labels)))
    for r in got.collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base_rule(r["text"]), r["doc_id"]
        assert r["kept"] == (not r["base_failed"] and r["llr"] >= q.THRESHOLD)
    return got


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, None), (2, 0, 0), (None, 1, 0), (0, 1, 0)], LABELS)
    assert check(spark, odd, labels).count() == odd.count()
    kept = q.keep(odd, q.weights(odd, q.trusted_ids(labels)))
    assert kept.columns == odd.columns and kept.select("n_words").distinct().count() == 1


def test_windows_and_lines(spark, docs_of):
    texts = ["a b c d e a b c d e", "a a a a a a a", "l1 x\nl1 x\n\n\nl1 x\nl2", "#a *b $c <d> &e |f %g", "é ü ß " * 8, "A b\x0bC d e f g h i j k"]
    check(spark, docs_of([(i, t, "en", "s") for i, t in enumerate(texts)]), spark.createDataFrame([], LABELS))


def test_empty(spark, empty):
    labels = spark.createDataFrame([], LABELS)
    assert q.keep(empty, q.weights(empty, q.trusted_ids(labels))).count() == 0


def plain_ratios(texts, trusted, buckets):
    """Mean log2 ratio of each text, from plain counts of hashed words and pairs."""
    signed = lambda x: struct.pack("<Q", x)

    def grams(text):
        h = [xxhash.xxh64_intdigest(w.lower(), seed=42) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        pairs = [xxhash.xxh64_intdigest(signed(b), seed=xxhash.xxh64_intdigest(signed(a), seed=42)) for a, b in zip(h, h[1:])]
        return [x % buckets for x in h + pairs]

    raw, target = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(grams(t))
        if i in trusted:
            target.update(grams(t))
    n, m = raw.total(), target.total()
    p = [(raw[b] + 1) / (n + buckets) for b in range(buckets)]
    ratio = [math.log2((target[b] + buckets * p[b]) / (m + buckets)) - math.log2(p[b]) if m else 0.0 for b in range(buckets)]
    return [sum(ratio[b] for b in g) / len(g) if (g := grams(t)) else 0.0 for t in texts]


@pytest.mark.parametrize("trusted", [{0, 3}, set(), {1}])
def test_ratio_against_plain_counts(spark, docs_of, odd_rows, trusted):
    texts = [r[1] for r in odd_rows] + ["Good words and good pairs " * 3, "\u00c9t\u00e9 d'hiver", "a"]
    df = docs_of([(i, t, "en", "s") for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, int(i in trusted), 0) for i in range(len(texts))], LABELS)
    for buckets in (64, q.BUCKETS):
        want = plain_ratios(texts, trusted, buckets)
        got = {r["doc_id"]: r for r in q.judge(df, q.weights(df, q.trusted_ids(labels), buckets=buckets), buckets=buckets).collect()}
        for i, x in enumerate(want):
            assert got[i]["llr"] == pytest.approx(x, abs=1e-5), i
            if abs(x - q.THRESHOLD) > 1e-4:
                assert got[i]["kept"] == (not got[i]["base_failed"] and x >= q.THRESHOLD)


def test_separates_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    got = q.judge(docs, q.weights(docs, q.trusted_ids(labels))).join(labels, "doc_id").where("not base_failed")
    rate = {r["quality"]: r["r"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("r")).collect()}
    assert rate[1] >= 0.99 and rate[0] <= 0.2


@pytest.mark.parametrize("n", [0, 3])
def test_trusted_is_bounded(spark, n):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)], LABELS)
    assert q.trusted_ids(labels, max_trusted=n).count() == n


def test_windows_alike_but_not_equal(spark, docs_of):
    """Windows that agree in lower case, in their outer pairs or in both pairs swapped are no repeats; no step looks words up by a list of positions."""
    texts = ["a b c d e x A b c d e", "a b c d e x a b Q d e", "a b c d e x d e c a b", "a b c d e x A b c d e y a b c d e", "a b a b a b a b a b a", "\n\n \n\nl a\n\nl a\n \nm b", "İx b c d e i̇x b c d e"]
    df = docs_of([(i, t, "en", "s") for i, t in enumerate([*texts, None, " "])])
    check(spark, df, spark.createDataFrame([], LABELS))
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (q.bucket_counts(df), q.judge(df, q.weights(df, q.trusted_ids(spark.createDataFrame([], LABELS)))))]
    assert not any("sequence(" in x for x in plans)
