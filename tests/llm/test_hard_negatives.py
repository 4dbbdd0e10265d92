"""Hard negatives against brute force with plain integers."""

import math
import random

import numpy as np
import pytest

from fieldbook.llm import hard_negatives as hn
from fieldbook.llm.shared import table

SCHEMA = "vec_id bigint, embedding array<double>, label int, block string, place string, cell int, kind string"
LONG = 2**63 - 1


def frame(spark, rows):
    return spark.createDataFrame([(*r, "b", "p", 1, "k") for r in rows], SCHEMA)


def by_hand(rows, every=100):
    good = []
    for vec_id, vector, label in rows:
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
            good.append((vec_id, label, [math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in vector]))
    out = []
    for a, (vec_id, label, q) in enumerate(good):
        if vec_id is None or vec_id % every:
            continue
        scores = sorted((-max(-LONG, min(LONG, sum(x * y for x, y in zip(q, g[2])))), g[0] is None, g[0] or 0, k) for k, g in enumerate(good) if k != a)
        for p, *_, at in [s for s in scores if good[s[3]][1] == label][:5]:
            band = [s for s in scores if good[s[3]][1] != label and 80 * -p <= 100 * -s[0] <= 100 * -p]
            out += [(vec_id, good[at][0], k + 1, good[s[3]][0], -p, -s[0]) for k, s in enumerate(band[:5])]
    return sorted(out, key=str)


def vectors(n, scale, dim=8, labels=4, seed=1):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, scale) for _ in range(dim)], rng.randrange(labels)) for i in range(n)]


def odd_vectors():
    rows = [(k - 100, v, label) for k, v, label in vectors(700, 1.0)]
    rows += [(None, rows[3][1], 1), (100, rows[200][1], 2), (100, rows[200][1], 2), (5000, None, 1), (5100, rows[4][1], None), (5200, [1.0, None], 1), (5300, [float("nan")] * 8, 1)]
    rows += [(5400, [], 1), (5500, [0.5, 1.0], 1), (5600, vectors(1, 1.0, 20)[0][1], 2), (5700, [float("inf")] * 8, 1), (5800, [0.0] * 8, 9)]
    return rows + [(6000 + k, rows[7][1], k % 3) for k in range(60)]  # one vector many times: ties


def test_odd_rows(spark):
    assert sorted(map(tuple, hn.mine(frame(spark, odd_vectors())).collect()), key=str) == by_hand(odd_vectors())


def test_many_cells(spark, monkeypatch):
    monkeypatch.setattr(hn, "CELL_COMPONENTS", 60)
    monkeypatch.setattr(hn, "CHUNK", 3)
    monkeypatch.setattr(hn, "BLOCK_ROWS", 40)
    assert sorted(map(tuple, hn.mine(frame(spark, odd_vectors())).collect()), key=str) == by_hand(odd_vectors())


@pytest.mark.parametrize("scale", [1e-3, 1e5, 1e8, 1e200])
def test_scales(spark, scale):
    """Few and many bit-planes: single, double, long and big integers; scores beyond a long are cut."""
    rows = vectors(200, scale, 4, 3)
    assert sorted(map(tuple, hn.mine(frame(spark, rows), every=20).collect()), key=str) == by_hand(rows, 20)


def test_empty_table_and_single_row(spark):
    assert hn.mine(frame(spark, [])).collect() == [] and hn.mine(frame(spark, [(0, [1.0], 1)])).collect() == []


@pytest.mark.parametrize("most", [3, 300, 1 << 20, 1 << 34])
def test_sliced_products_are_exact(most):
    """All pairs within the bounds, and only those, at any size of the components."""
    rng = np.random.default_rng(most)
    a, r = (rng.integers(-most, most, (n, 16)) for n in (9, 200))
    whole = a.astype(object) @ r.T.astype(object)
    low, high = np.quantile(whole.astype(float), 0.9, axis=1), np.quantile(whole.astype(float), 0.97, axis=1)
    allowed = rng.random((9, 200)) < 0.8
    i, j, score = hn.sliced_products(a, r, low, high, allowed)
    want = {(x, y, int(whole[x, y])) for x in range(9) for y in range(200) if allowed[x, y] and low[x] <= whole[x, y] <= high[x]}
    assert set(zip(i.tolist(), j.tolist(), score.tolist())) == {(x, y, max(-LONG, min(LONG, s))) for x, y, s in want}


def test_planes_drop_pairs_early():
    """The intervals decide most pairs before the last plane, where the wanted scores are far out."""
    rng = np.random.default_rng(0)
    a, r = rng.integers(-256, 256, (4, 64)), rng.integers(-256, 256, (500, 64))
    seen = []
    plain = np.nonzero

    class Spy:
        def __getattr__(self, name):
            return getattr(np, name)

        def nonzero(self, x):
            seen.append(int(np.sum(x)))
            return plain(x)

    high = np.full(4, np.inf)
    whole = a @ r.T
    low = np.sort(whole, axis=1)[:, -3].astype(float)
    hn_np, hn.np = hn.np, Spy()
    try:
        i, j, score = hn.sliced_products(a, r, low, high, np.ones((4, 500), bool))
    finally:
        hn.np = hn_np
    assert len(i) == 12 and seen and seen[0] < hn.SPARSE * 2000


def test_given_rows(spark):
    """The whole table at sf0.01 against brute force."""
    df = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]], r["label"]) for r in df.collect()]
    assert sorted(map(tuple, hn.mine(df).collect()), key=str) == by_hand(rows)
