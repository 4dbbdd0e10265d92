"""Merging records of several sources: field picks with trace, conflicts, folds, duplicates, strategies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rank import top_per_group


def has_value(c: Column) -> Column:
    """Not null and, as text, not empty."""
    return c.isNotNull() & (c.cast("string") != "")


def first_available(df: DataFrame, keys: Sequence[str], fields: Sequence[str], source: str, priority: Column, tie: Column) -> DataFrame:
    """Per key and field, the first value in source order, and the source that gave it (``<field>_source``).

    One aggregation with map-side partials; ``priority`` ascending, then ``tie``.
    """
    aggs = []
    for f in fields:
        pick = F.min_by(F.struct(F.col(f).alias("v"), F.col(source).alias("s")), F.when(has_value(F.col(f)), F.struct(priority.alias("p"), tie.alias("t"))))
        aggs += [pick.getField("v").alias(f), pick.getField("s").alias(f"{f}_source")]
    return df.groupBy(*keys).agg(*aggs)


def priority_pick(df: DataFrame, keys: Sequence[str], field: str, source: str, priority: Column, confidence: Column, rules: DataFrame | None = None) -> DataFrame:
    """Highest (priority, confidence) value of a field with its trace: field, selected source, candidate count, strategy.

    ``rules``: ``field, strategy`` lookup of fixed size.
    """
    ok = has_value(F.col(field))
    best = F.max_by(F.struct(F.col(field).cast("string").alias("v"), F.col(source).alias("s")), F.when(ok, F.struct(priority.alias("p"), confidence.alias("c"), F.col(source).alias("s"))))
    out = df.groupBy(*keys).agg(best.getField("v").alias("value"), best.getField("s").alias("selected_source"), F.count_if(ok).alias("candidate_count")).withColumn("field", F.lit(field))
    return out if rules is None else out.join(F.broadcast(rules), "field", "left")


# fixed values: sources whose address of a race comes first, by kind of address
URL_SOURCES = {"official_url": ("runchina", "itra"), "registration_url": ("zuicool",)}


def pick_urls(df: DataFrame, keys: Sequence[str], source: str, priority: Column, confidence: Column, order: Column) -> DataFrame:
    """``official_url, registration_url`` of each key by their special rule: the preferred sources' best row with either address gives it.

    If that row has none of this kind, or there is no such row, the best row with one does. Best: priority, confidence (both descending), ``order``.
    """
    rank = F.struct((-priority).alias("p"), (-confidence).alias("c"), order.alias("o"))
    any_url = has_value(F.col("official_url")) | has_value(F.col("registration_url"))

    def picked(name: str, sources: Sequence[str]) -> Column:
        value = F.struct(F.col(name).alias("v"))
        first = lambda c: F.min_by(value, F.when(c, rank))["v"]
        return F.coalesce(first(F.col(source).isin(*sources) & any_url), first(has_value(F.col(name))), first(F.lit(True))).alias(name)

    return df.groupBy(*keys).agg(*[picked(*x) for x in URL_SOURCES.items()])


def conflicts(df: DataFrame, keys: Sequence[str], field: str, source: str) -> DataFrame:
    """Keys whose field has several distinct values: ``field, n_values, options`` (source=value, sorted)."""
    ok = df.where(has_value(F.col(field))).select(*keys, F.col(field).cast("string").alias("v"), F.col(source).alias("s"))
    return (
        ok.groupBy(*keys)
        .agg(F.count_distinct("v").alias("n_values"), F.array_join(F.sort_array(F.collect_set(F.concat_ws("=", F.col("s").cast("string"), "v"))), ";").alias("options"))
        .where("n_values > 1")
        .withColumn("field", F.lit(field))
    )


def fold(df: DataFrame, keys: Sequence[str], last_known: Sequence[str], last_any: Sequence[str], order: Column) -> DataFrame:
    """One row per key: the last non-null of some fields, the last row's value of others."""
    aggs = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in last_known] + [F.max_by(c, order).alias(c) for c in last_any]
    return df.groupBy(*keys).agg(*aggs)


def keep_best(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """First row of each key in the given order."""
    return top_per_group(df, keys, order, 1, "_rn").drop("_rn")


def exact_dedupe(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Adds ``first_id`` (smallest id of the rows with the same key) and ``is_duplicate``.

    The key is hashed to 256 bits before the shuffle, so long texts don't travel.
    """
    w = df.select(F.col(order).alias("_id"), F.sha2(key, 256).alias("_k"))
    first = w.groupBy("_k").agg(F.min("_id").alias("first_id"))
    out = w.join(first, "_k").select(F.col("_id").alias(order), "first_id")
    return out.withColumn("is_duplicate", F.col(order) != F.col("first_id"))


def possible_duplicates(df: DataFrame, keys: Sequence[str], differs: str, flags: Mapping[str, str]) -> DataFrame:
    """Groups of several rows whose ``differs`` value is not the same throughout; a null is a value of its own.

    ``flags``: output name -> column that is checked to be equal in the whole group.
    """
    val = F.coalesce(F.col(differs).cast("string"), F.lit("\u0000"))
    equal = [(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))) == 1).alias(n) for n, c in flags.items()]
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_distinct(val).alias("n_values"), *equal).where("n_rows > 1 and n_values > 1")


# fixed values: points of matching parts
MATCH_POINTS = {"name": 35, "city": 20, "year": 15, "date": 20, "distance": 10}


def match_score(flags: Mapping[str, Column]) -> Column:
    """Duplicate score of a pair or group from its equality flags."""
    out = F.lit(0)
    for name, flag in flags.items():
        out = out + F.when(flag, MATCH_POINTS[name]).otherwise(0)
    return out


def race_confidence(name: Column, date: Column, city: Column, distance: Column, link: Column, trusted: Column) -> Column:
    """Confidence 0..100 of a normalised row."""
    pts = [(name, 20), (date, 20), (city, 15), (distance, 15), (link, 10), (trusted, 20)]
    out = F.lit(0)
    for c, p in pts:
        out = out + F.when(c, p).otherwise(0)
    return F.least(out, F.lit(100))


def connector_confidence(trusted: Column, high_quality: Column, link: Column, categories: Column, n_warnings: Column) -> Column:
    """Confidence 0.30..0.95 in integer hundredths."""
    c = F.when(trusted, 76).otherwise(68) + F.when(high_quality, 10).otherwise(0) + F.when(link, 4).otherwise(0) + F.when(categories, 6).otherwise(0)
    return F.greatest(F.lit(30), F.least(F.lit(95), c - F.least(n_warnings * 3, F.lit(12))))


def missing_fields(columns: Mapping[str, Column]) -> Column:
    """Names of the fields that have no value, in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(has_value(c), F.lit(False)), F.lit(n)) for n, c in columns.items()]))


def source_map(df: DataFrame, keys: Sequence[str], field: str, source: str) -> DataFrame:
    """Source of each field over a group: the one source, or ``merged`` where several gave it."""
    return df.groupBy(*keys, field).agg(F.when(F.count_distinct(source) > 1, F.lit("merged")).otherwise(F.min(source)).alias("source"))


def best_quality(quality: Column, order: Sequence[str], value: Column) -> Column:
    """Aggregate: the value with the best quality word."""
    rank = F.lit(len(order))
    for k in range(len(order) - 1, -1, -1):
        rank = F.when(quality == order[k], k).otherwise(rank)
    return F.min_by(value, rank)


STRATEGIES = ("First Available", "Merge All", "Latest Timestamp Wins", "Highest Confidence", "Manual Review", "Ignore External", "Derived")


def apply_strategies(
    df: DataFrame, keys: Sequence[str], field: str, source: str, priority: Column, confidence: Column, at: Column, internal: Column, strategies: Sequence[str] = STRATEGIES
) -> DataFrame:
    """``keys, strategy, value, needs_review`` of a field per key under the documented strategies, from one aggregation.

    First Available: by priority. Merge All: all distinct values, sorted. Latest Timestamp Wins, Highest Confidence: as named.
    Manual Review: a value only if all sources agree, else a review. Ignore External: internal sources only. Derived: no
    value is taken from sources.
    """
    v = F.when(has_value(F.col(field)), F.col(field).cast("string"))
    src = F.col(source).cast("string")
    agreed = F.count_distinct(v) <= 1
    value = {
        "First Available": F.min_by(v, F.when(v.isNotNull(), F.struct(priority.alias("p"), src.alias("s")))),
        "Merge All": F.array_join(F.sort_array(F.collect_set(v)), "; "),
        "Latest Timestamp Wins": F.max_by(v, F.when(v.isNotNull(), F.struct(at.alias("t"), src.alias("s")))),
        "Highest Confidence": F.max_by(v, F.when(v.isNotNull(), F.struct(confidence.alias("c"), src.alias("s")))),
        "Manual Review": F.when(agreed, F.min(v)),
        "Ignore External": F.min_by(F.when(internal, v), F.when(internal & v.isNotNull(), F.struct(priority.alias("p"), src.alias("s")))),
        "Derived": F.max(F.lit(None).cast("string")),
    }
    wide = df.groupBy(*keys).agg(*[value[s].alias(s) for s in strategies], (~agreed).alias("_open"))
    long = wide.unpivot([*keys, "_open"], list(strategies), "strategy", "value")
    return long.select(*keys, "strategy", "value", ((F.col("strategy") == "Manual Review") & F.col("_open")).alias("needs_review"))


def average_confidence(df: DataFrame, keys: Sequence[str], confidence: str) -> DataFrame:
    """Mean confidence of each group in hundredths, half up; groups of several sources gain six, to 98 at most."""
    g = df.groupBy(*keys).agg(F.avg(confidence).alias("_m"), F.count("*").alias("n"))
    mean = F.floor(F.col("_m") * 100 + 0.5)
    return g.select(*keys, "n", (mean / 100).alias("confidence"), F.when(F.col("n") > 1, F.least(F.lit(98), mean + 6) / 100).otherwise(mean / 100).alias("seed_confidence"))


def argmax_name(scores: Mapping[str, Column]) -> Column:
    """Name of the largest of some scores; the earlier of equal ones."""
    placed = F.array(*[F.struct((-c).alias("s"), F.lit(k).alias("k"), F.lit(n).alias("n")) for k, (n, c) in enumerate(scores.items())])
    return F.get(F.array_sort(placed), F.lit(0))["n"]


def star_pairs(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Each later row of a group against the first one: ``first_id, id``."""
    first = df.groupBy(*keys).agg(F.min(id_col).alias("first_id"))
    return df.join(first, list(keys)).where(F.col(id_col) > F.col("first_id")).select("first_id", F.col(id_col).alias("id"))


def earliest_seen(history: DataFrame, key: str, at: str, columns: Sequence[str]) -> DataFrame:
    """First time each key was seen, with the rest of its latest row."""
    return history.groupBy(key).agg(F.min(at).alias("first_seen"), *[F.max_by(c, at).alias(c) for c in columns])


def first_by_order(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
