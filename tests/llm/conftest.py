import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, n_words string, _doc string, path string, key string"


def sentence(rng: random.Random, n: int, pool: int = 400) -> str:
    return " ".join(f"w{int(rng.paretovariate(1.0)) % pool}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, repeated rows, ties; clashing extra columns are added by ``docs_of``."""
    rng = random.Random(5)
    base = [sentence(rng, 60) for _ in range(6)]
    rows = [(i, t, "en", f"s{i % 2}") for i, t in enumerate(base)]
    rows += [(10, base[0], "en", "s0"), (10, base[0], "en", "s0"), (11, base[0] + " tail", None, None), (12, None, "en", "s1"), (13, "", "de", "s1"), (14, " \t\n ", "de", None), (15, sentence(rng, 30_000), "en", "s0")]
    return [*rows, (None, base[1], "de", "s1"), (16, "x y", "de", "s1"), (17, "x y", "de", "s1"), (18, "12 34 !!", "en", "s0"), (19, base[2].replace("w1 ", "w9 ", 1), "en", "s1")]


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows):
        return spark.createDataFrame([(d, t, lang, src, len(t or ""), False, "n", "d", "p", "k") for d, t, lang, src in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd(docs_of, odd_rows):
    return docs_of(odd_rows)


@pytest.fixture(scope="session")
def empty(docs_of):
    return docs_of([])
