"""Corpus pipeline: quality rules, near-duplicate removal, decontamination, source mixing, token output.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read as the next
stage's documents. All but the last return the columns of ``documents``.

Defined results: null, empty and blank texts fail the base rule and go in the first stage; of repeated rows, near copies and rows
that only share an id, one row of each class of texts stays (smallest id, null ids last), so no document goes because another has its
id; a row with a null id is kept or dropped like any other and comes last out with a null id; very long texts are judged whole by
every stage; the mixing stage leaves no document out and repeats those of small sources; equal ids drawn several times each get their
own entry in the token files; an empty table, or one of which nothing is kept, gives no rows; further columns of ``documents`` pass
through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldbook.llm import decontaminate, jaccard_join, mixing, quality_rules, token_binary
from fieldbook.llm.queries import TOKENIZER
from fieldbook.llm.shared import materialize, table

#: Evenness of the source weights in the pipeline; with the covering budget every document is drawn at least once.
EVENNESS = 0.9


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base rule and the log-likelihood ratio threshold."""
    trusted = quality_rules.trusted_ids(table(spark, sf_dir, "labels"))
    return quality_rules.keep(docs, quality_rules.weights(docs, trusted))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of the Jaccard join, that with the smallest id."""
    return jaccard_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents by tempered source weights; small sources are repeated, no document is left out. A mix that is even enough is not sharpened."""
    return mixing.mixed_documents(docs, budget="cover", evenness=EVENNESS, sharpen=False)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns each drawn document's place in them, read back from the files."""
    import public_tokenizers

    return token_binary.read_tokens(spark, token_binary.write_tokens(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("decontaminate", decontaminated),
    ("mixing", mixed),
    ("token_binary", token_ids),
]

#: SQL cannot express the stages (hashed models, random walks, a tokenizer); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
