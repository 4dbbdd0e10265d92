"""The pipeline against brute-force stages on a small fixture."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from fieldbook.llm import decontaminate, hard_negatives, jaccard_join, language_id, lm_score, main_text, mixing, prefix_trie, quality_rules, queries, substring_dedup, token_binary, url_filters, warc
from fieldbook.llm.shared import materialize

from .test_duplicates import brute_join

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "decontaminate", "mixing", "token_binary"]
    current, columns = docs, docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, current, SF)
        assert out.columns == columns
        current = spark.createDataFrame(out.toPandas(), docs.schema)
        seen.append((name, current))
    quality, joined, clean, mixed = (x for _, x in seen)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = quality_rules.judge(docs, quality_rules.weights(docs, quality_rules.trusted_ids(labels)))
    ids = lambda d: {r[0] for r in d.select("doc_id").collect()}
    assert ids(quality) == {r["doc_id"] for r in judged.where("kept").collect()}
    classes = brute_join([(r["doc_id"], r["text"]) for r in quality.collect()])
    assert ids(joined) == {d for d, c, _ in classes if c == d}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    hit = {r["doc_id"] for r in decontaminate.find_matches(joined, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    verbatim = {r["doc_id"] for r in joined.collect() if any(b["text"] in r["text"] for b in bench)}
    assert verbatim <= hit and ids(clean) == ids(joined) - hit
    assert ids(mixed) == ids(clean)
    final = corpus_pipeline.run(spark, SF).collect()
    tok = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    want = sorted((r["doc_id"], len(tok.encode(r["text"], add_special_tokens=False).ids) + 1) for r in mixed.collect())
    assert sorted((r["doc_id"], r["n_tokens"]) for r in final) == want
    starts = sorted((r["start"], r["n_tokens"]) for r in final)
    assert [s for s, _ in starts] == np.concatenate([[0], np.cumsum([n for _, n in starts])[:-1]]).tolist()
    assert corpus_pipeline.ORACLE_SQL is None


MODULES = [lm_score, language_id, warc, url_filters, decontaminate, jaccard_join, mixing, quality_rules, substring_dedup, token_binary, hard_negatives, prefix_trie, main_text, corpus_pipeline]


@pytest.mark.parametrize("part", MODULES, ids=lambda m: m.__name__)
@pytest.mark.parametrize("case", ["null", "empty", "long", "repeat|equal", "empty table", "name"])
def test_cases_are_stated(part, case):
    assert re.search(case, part.__doc__[part.__doc__.index("Defined results") :].replace("\n", " "))


def in_turn(spark, docs, upto=4):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:upto]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = materialize(out, f"stage{k}")
    return docs


def test_odd_rows_through_the_stages(spark, odd_rows, docs_of):
    """Nulls, repeated rows and ids, near copies, very long texts and clashing columns, behind texts that all pass the base rule."""
    rng = random.Random(1)
    good = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").orderBy("doc_id").limit(40).collect()]
    rows = [*odd_rows, *((100 + i, t, "en", f"s{i % 3}") for i, t in enumerate(good)), (100, good[0], "en", "s0"), (100, good[1], "en", None), (None, good[2], "en", "s1"), (None, good[3] + " tail", None, None), (900, " ".join(rng.sample(good, 30)), "en", "s9")]
    docs = docs_of(rows)
    kept = in_turn(spark, docs, 2).collect()
    quality = {(r["doc_id"], r["text"]) for r in corpus_pipeline.quality(spark, docs, SF).collect()}
    assert {(r["doc_id"], r["text"]) for r in kept} <= quality
    texts = [r["text"] for r in kept]
    assert len(texts) == len(set(texts)) and {t for _, t in quality if t in good} <= set(texts)
    mixed = in_turn(spark, docs)
    assert {(r["doc_id"], r["text"]) for r in mixed.collect()} <= {(r["doc_id"], r["text"]) for r in kept}
    tokens = corpus_pipeline.token_ids(spark, mixed, SF)
    assert tokens.count() == mixed.count()


def test_empty_table_through_the_stages(spark, empty):
    docs = in_turn(spark, empty)
    assert docs.count() == 0 and corpus_pipeline.token_ids(spark, docs, SF).count() == 0
