"""Set operations and text joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def multiset_equal(a: DataFrame, b: DataFrame) -> bool:
    """Same rows with the same multiplicity."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def unconsumed(df: DataFrame, used: DataFrame, key: str) -> DataFrame:
    return df.join(used.select(key), key, "left_anti")


def flagged(df: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    """All rows, with a flag for those whose key is listed."""
    listed = ids.select(key).distinct().withColumn(flag, F.lit(True))
    return df.join(listed, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def required_reference(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Inner join that fails if a row has no partner."""
    j = df.join(other.withColumn("_found", F.lit(True)), key, "left")
    ok = F.assert_true(F.col("_found").isNotNull(), F.concat(F.lit(f"no row for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return j.where(ok.isNull()).drop("_found")


_GAP = r"[ \t\n\x0B\f\r]+"


def _tagged(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_tag"), F.col(text_col).alias("_text"))


def _run_hashes(words: Column, run: int) -> Column:
    """Hash of each run of ``run`` words; none for fewer words."""
    n = F.size(words)
    return F.when(n >= run, F.transform(F.sequence(F.lit(0), n - run), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(run)]))).otherwise(F.array().cast("array<bigint>"))


def _spot(words: Column, width: int):
    """Length and hash of the run of words that begins at a place."""
    return lambda i: F.struct(F.length(F.array_join(F.slice(words, i + 1, F.lit(width)), " ")).alias("n"), F.xxhash64(*[F.get(words, i + k) for k in range(width)]).alias("h"))


def phrase_matches(texts: DataFrame, id_col: str, text_col: str, phrases: DataFrame, phrase_id: str, phrase_col: str, run: int = 3) -> DataFrame:
    """``_id, _tag, phrase id`` of the phrases that a text holds verbatim; ``_tag`` tells texts of one id apart.

    A phrase's inner words are whole words of any text that holds it. Its longest run of ``run`` of them is looked up among the runs of
    all texts by an equi-join of hashes, and the few pairs found are compared in full. A phrase with fewer inner words is looked up
    by its longest inner word; one without any (at most two words) is looked up among all stretches of its length.
    """
    words = lambda c: F.filter(F.split(c, _GAP), lambda w: w != "")
    rows = _tagged(texts, id_col, text_col)
    split = rows.select("_id", "_tag", words(F.col("_text")).alias("_words"))  # a step of its own: its words are used many times
    inner = F.slice(F.split(F.col("_phrase"), _GAP), F.lit(2), F.greatest(F.size(F.split(F.col("_phrase"), _GAP)) - 2, F.lit(0)))
    p = phrases.select(F.col(phrase_id).alias("_p"), F.col(phrase_col).alias("_phrase")).where("_phrase <> ''").withColumn("_inner", inner)
    found = []
    for low, high, width in ((run, None, run), (1, run - 1, 1)):
        part = p.where((F.size("_inner") >= low) & (F.size("_inner") <= high if high else F.lit(True)))
        spots = F.transform(F.sequence(F.lit(0), F.size("_inner") - width), _spot(F.col("_inner"), width))
        keyed = part.select("_p", "_phrase", F.array_max(spots)["h"].alias("_h"))
        runs = split.select("_id", "_tag", F.explode(F.array_distinct(_run_hashes(F.col("_words"), width))).alias("_h"))
        met = runs.join(keyed, "_h").select("_id", "_tag", "_p", "_phrase").distinct()
        other = rows.withColumnsRenamed({"_id": "_i", "_tag": "_t"})
        found.append(met.join(other, F.expr("_id <=> _i and _tag = _t")).where(F.contains("_text", F.col("_phrase"))).select("_id", "_tag", "_p"))
    short = p.where(F.size("_inner") == 0).select("_p", "_phrase")
    lengths = [r[0] for r in short.select(F.length("_phrase")).distinct().collect()]  # a number for each length
    if lengths:
        # texts are cut into every stretch of a length that a short phrase has, and those are joined with the phrases of that length
        stretches = lambda n: F.transform(F.sequence(F.lit(1), F.length("_text") - n + 1), lambda i: F.substr("_text", i, n))
        whole = F.flatten(F.transform(F.filter(F.lit(lengths), lambda n: n <= F.length("_text")), stretches))
        pieces = rows.select("_id", "_tag", F.explode(F.array_distinct(whole)).alias("_phrase"))
        found.append(pieces.join(short, "_phrase").select("_id", "_tag", "_p"))
    return reduce(DataFrame.unionByName, found).distinct().withColumnRenamed("_p", phrase_id)


def contains_pairs(texts: DataFrame, id_col: str, text_col: str, phrases: DataFrame, phrase_id: str, phrase_col: str) -> DataFrame:
    """``id, phrase id`` for every text row and each phrase that occurs verbatim in it."""
    keys = texts.select(F.col(id_col), F.xxhash64(text_col).alias("_t"))
    found = phrase_matches(texts, id_col, text_col, phrases, phrase_id, phrase_col)
    return keys.join(found, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_tag"))).select(id_col, phrase_id)


def first_containing(texts: DataFrame, id_col: str, text_col: str, phrases: DataFrame, phrase_id: str, phrase_col: str, out: str) -> DataFrame:
    """All text rows with the smallest id of a phrase that they hold; null where there is none."""
    first = phrase_matches(texts, id_col, text_col, phrases, phrase_id, phrase_col).groupBy("_id", "_tag").agg(F.min(phrase_id).alias(out))
    return texts.join(first, F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_tag")), "left").drop("_id", "_tag")


def stable_body(df: DataFrame, volatile: Sequence[str] = ()) -> Column:
    """All columns of a row but the volatile ones as JSON: what a content hash is taken of."""
    return F.to_json(F.struct(*[c for c in df.columns if c not in volatile]), {"ignoreNullFields": "false"})


def manifest_hash(files: DataFrame, path: str, body: Column) -> DataFrame:
    """``hash, n_files`` over all (path, body) rows, whatever their order: a tree of two levels.

    Rows are hashed, grouped by the hash of their path (4,096 groups), each group is hashed in path order, and the groups' hashes are
    hashed in order; no task sees more rows than a group has.
    """
    rows = files.select(F.sha2(F.concat_ws("\u0000", F.col(path), body), 256).alias("h"), F.col(path).cast("string").alias("p"))
    groups = rows.groupBy(F.substring(F.sha2("p", 256), 1, 3).alias("g")).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), "\n"), 256).alias("h"), F.count("*").alias("n"))
    return groups.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), "\n"), 256).alias("hash"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"))


def meaningful_changes(before: DataFrame, after: DataFrame, key: str, volatile: Sequence[str]) -> DataFrame:
    """``key, change``: added, removed, changed, or volatile_only where nothing but the volatile columns differs."""
    digest = lambda df, skip: F.xxhash64(stable_body(df, skip))
    a = before.select(key, digest(before, ()).alias("_a"), digest(before, volatile).alias("_sa"))
    b = after.select(key, digest(after, ()).alias("_b"), digest(after, volatile).alias("_sb"))
    j = a.join(b, key, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_sa") != F.col("_sb"), "changed").when(F.col("_a") != F.col("_b"), "volatile_only")
    return j.select(key, change.alias("change")).where("change is not null")
