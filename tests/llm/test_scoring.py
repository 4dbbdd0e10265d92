import math
import re
import zlib
from collections import Counter

import pytest

from fieldbook.llm import language_id, lm_score, queries

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)), "\0end"]


def brute(rows, model):
    """``id, tokens, known, base, score`` of every row, from plain counts and the model's weights; and N."""
    train = [tokens(t) for d, t in rows if zlib.crc32(b"" if d is None else str(d).encode()) % 10]
    c, pairs = Counter(x for t in train for x in t), Counter(p for t in train for p in zip(["\0start", *t], t))
    ctx = Counter(p[0] for p in pairs.elements())
    n, v = sum(c.values()), len(c)
    out = []
    for d, t in rows:
        t = tokens(t)
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
        score = 0.0
        for h, w in zip(["\0start", *t], t):
            lam = model.weights[int(lm_score.bucket_of(ctx[h]))]
            score += math.log10((lam[0] * pairs[h, w] / ctx[h] if ctx[h] else 0.0) + lam[1] * c[w] / max(1, n) + lam[2] / (v + 1))
        out.append((d, len(t), sum(c[x] > 0 for x in t), base, score))
    return out, n


def same_rows(got, want):
    """Rows with equal ids are told apart by their counts and scores."""
    key = lambda r: (repr(r[0]), r[1], r[2], round(r[3], 3))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    for g, w in zip(got, want):
        assert g[3] == pytest.approx(w[3], rel=1e-6, abs=1e-6) and g[4] == pytest.approx(w[4], rel=1e-5)


@pytest.mark.parametrize("vocabulary, top, small", [(1 << 19, 1024, False), (40, 8, False), (40, 8, True), (0, 8, True)])
def test_lm_against_brute_force(spark, odd, odd_rows, monkeypatch, vocabulary, top, small):
    """The small vocabulary sends most words and contexts through the shuffled paths, small buckets through many of them."""
    monkeypatch.setattr(lm_score, "TOP", top)
    if small:
        monkeypatch.setattr(lm_score, "BUCKET_TOKENS", 700)
        monkeypatch.setattr(lm_score, "flush_tokens", lambda n: 300)
    held = {}
    train = lm_score.train
    monkeypatch.setattr(lm_score, "train", lambda *a: held.setdefault("m", train(*a)))
    got = lm_score.score(odd, vocabulary=vocabulary).collect()
    want, n = brute([r[:2] for r in odd_rows], held["m"])
    same_rows([(r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got], want)
    for r in got:
        assert r["train_tokens"] == n and r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 10 == 0)


def test_lm_repeated_and_null_ids(spark, docs_of, monkeypatch):
    """Each row is scored for itself, whatever its id."""
    rows = [(7, "a b c"), (7, "a b c d e f"), (None, "q"), (None, "a b"), (None, None), (7, "a b c"), (8, "a b c")]
    held, train = {}, lm_score.train
    monkeypatch.setattr(lm_score, "train", lambda *a: held.setdefault("m", train(*a)))
    got = lm_score.score(docs_of([(*r, "en", "s") for r in rows])).collect()
    same_rows([(r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got], brute(rows, held["m"])[0])


def test_lm_without_training(spark, docs_of, empty):
    assert lm_score.score(empty).count() == 0
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    got = lm_score.score(docs_of([(i, "a b c", "en", "s") for i in ids])).collect()
    assert all(r["held_out"] and r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in got)


def test_lm_beats_base_on_held_out(spark):
    r = queries.op1_lm_score(spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert r[0] > r[1]


def test_em_raises_likelihood():
    import numpy as np

    m, p2, p1, b = np.array([5.0, 3.0, 1.0]), np.array([0.5, 0.0, 0.1]), np.array([0.1, 0.2, 0.01]), np.array([3, 3, 3])
    like = lambda w: float((m * np.log(w[0] * p2 + w[1] * p1 + w[2] * 0.001)).sum())
    assert like(lm_score.em(m, p2, p1, 0.001, b)[3]) > like([0.4, 0.4, 0.2])


def test_lm_weights_from_all_held_out_bigrams(spark, docs_of, monkeypatch):
    """The weights are those of plain counts over every deleted bigram, whatever the vocabulary."""
    import random

    import numpy as np

    rng = random.Random(3)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(150)), "en", "s") for i in range(300)]
    part = lambda i: zlib.crc32(str(i).encode()) % 10
    kept, out = [tokens(r[1]) for r in rows if part(r[0]) > 1], [tokens(r[1]) for r in rows if part(r[0]) == 1]
    bigrams = lambda texts: Counter(p for t in texts for p in zip(["\0start", *t], t))
    c, c2, m = Counter(x for t in kept for x in t), bigrams(kept), bigrams(out)
    ctx, total = Counter(), sum(c.values())
    for (h, _), n in c2.items():
        ctx[h] += n
    p0 = 1 / (len(set(c) | {w for _, w in m}) + 1)
    ch = np.array([ctx[h] for h, _ in m])
    want = lm_score.em(np.array([*m.values()], float), np.array([c2[k] for k in m]) / np.maximum(ch, 1), np.array([c[w] for _, w in m]) / total, p0, lm_score.bucket_of(ch))
    monkeypatch.setattr(lm_score, "TOP", 8)
    docs = lm_score._rows(docs_of(rows), "doc_id", "text")
    for vocabulary in (1 << 19, 40):
        assert np.abs(lm_score.train(docs, vocabulary).weights - want).max() < 2e-3


def test_lm_unseen_words(spark, odd, odd_rows, docs_of, monkeypatch):
    """P1 is c(w)/N for every word, 0 for unseen ones, whatever the vocabulary."""
    new = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [*(r[:2] for r in odd_rows), (new, "unseen words w1 w390 w391 unseen w1")]
    docs = odd.unionByName(docs_of([(*rows[-1], "en", "s")]))
    monkeypatch.setattr(lm_score, "TOP", 8)
    train = lm_score.train
    for vocabulary in (1 << 19, 40, 0):
        held = {}
        monkeypatch.setattr(lm_score, "train", lambda *a, held=held: held.setdefault("m", train(*a)))
        got = lm_score.score(docs, vocabulary=vocabulary).collect()
        same_rows([(r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got], brute(rows, held["m"])[0])


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"), "doc_id")
    held = got.where("held_out and length(text) > 40")
    assert held.where("lang_pred = lang").count() >= 0.97 * held.count() > 0
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


def test_language_odd_rows(spark, odd, empty):
    got = language_id.identify(odd, language_id.train(odd))
    rows = got.collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (12, 13, 14, 18))
    assert {r["lang_pred"] for r in rows} <= {"en", "de", "und"}
    assert language_id.identify(empty, language_id.train(empty)).count() == 0
    nothing = language_id.identify(odd, language_id.train(empty)).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in nothing] == [("und", 0.0)]


def gram_set(text):
    """Byte n-grams of the lower-cased text, as hashed cells."""
    data, out = text.lower().encode(), set()
    for n in language_id.LENGTHS:
        for i in range(len(data) - n + 1):
            code = int.from_bytes(data[i : i + n], "big")
            h = ((code + n) * 2654435761 % 2**32) ^ (code >> 15)
            out.add((h * 2246822519 % 2**32) >> (32 - language_id.CELL_BITS))
    return out


def test_language_model_against_plain_sets():
    """Kernel from sets, Nyström features and ridge regression from textbook formulas."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    alphabets = {"aa": "abcdef ghé", "bb": "efghij kl", "cc": "klmnop qßr"}
    make = lambda lang, n: "".join(rng.choice(list(alphabets[lang]), n))
    learn = [(lang, make(lang, 30 + 10 * i)) for lang in alphabets for i in range(8)]
    fresh = [make(lang, n) for lang in alphabets for n in (12, 300)] + ["", "a", "\u4e2d\u6587"]
    langs, texts = [x for x, _ in learn], [t for _, t in learn]
    model = language_id.fit(language_id.presence(pa.array(texts)), langs, landmarks=9, ridge=0.1)
    k = lambda a, b: len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b)))
    gram = lambda xs, ys: np.array([[k(gram_set(a), gram_set(b)) for b in ys] for a in xs])
    land = [texts[i] for r in range(3) for i in (r, 8 + r, 16 + r)]
    values, vectors = np.linalg.eigh(gram(land, land))
    keep = values > 1e-6 * values.max()
    half = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.hstack([gram(texts, land) @ half, np.ones((len(texts), 1))])
    weight = np.full(len(texts), 1 / (3 * 8))
    y = np.array([[1.0 if x == n else -1.0 for n in sorted(alphabets)] for x in langs])
    w = np.linalg.solve((phi.T * weight) @ phi + 0.1 / len(phi) * np.eye(phi.shape[1]), (phi.T * weight) @ y)
    want = np.hstack([gram(fresh, land) @ half, np.ones((len(fresh), 1))]) @ w
    names, score = language_id.predict(model, pa.array(fresh))
    for i, text in enumerate(fresh):
        if text:
            assert names[i] == sorted(alphabets)[want[i].argmax()] and score[i] == pytest.approx(min(1, max(0, (want[i].max() + 1) / 2)), abs=1e-4)
        else:
            assert (names[i], score[i]) == ("und", 0.0)


def test_language_learning_rows(spark, docs_of):
    """The rows of smallest rank, each once, however often rows repeat."""
    rows = [(i, f"text {i}", ["en", "de"][i % 2], "s") for i in range(400)] + [(5, "text 5", "de", "s")] * 5000 + [(7, "other", "de", "s"), (7, "another", "de", "s"), (None, "nameless", "fr", "s"), (None, "nameless too", "fr", "s"), (1, None, "en", "s"), (2, "x", None, "s")]
    got = language_id.learning_rows(docs_of(rows), "doc_id", "text", "lang", 50).collect()
    by = Counter(r["lang"] for r in got)
    assert by == {"en": 50, "de": 50, "fr": 2} and len({(r["lang"], r["id"], r["tag"]) for r in got}) == len(got)
    every = {r["rank"] for r in language_id.learning_rows(docs_of(rows), "doc_id", "text", "lang", 10**6).collect() if r["lang"] == "de"}
    assert {r["rank"] for r in got if r["lang"] == "de"} == set(sorted(every)[:50])


@pytest.mark.parametrize("chars", [60, 3_000, 300_000])
def test_language_accuracy_by_length(spark, chars):
    """Texts cut or joined to a length: the presence of n-grams still tells languages apart in very long ones."""
    import pyarrow as pa

    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text").where("text is not null and lang is not null").collect()]
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(df.where(~(language_id.id_crc() % 4 == 2)))
    held, texts = {}, []
    for d, lang, text in docs:
        if zlib.crc32(str(d).encode()) % 4 == 2:
            held.setdefault(lang, []).append(text)
    for lang, own in held.items():
        joined = " ".join(own)
        joined = joined * (1 + 3 * chars // len(joined))
        texts += [(lang, joined[k * chars : (k + 1) * chars]) for k in range(3)]
    names, _ = language_id.predict(model, pa.array([t for _, t in texts]))
    assert sum(n == lang for n, (lang, _) in zip(names, texts)) >= 0.9 * len(texts)
