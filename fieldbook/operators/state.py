"""Keyed state advanced by batches: upserts, hash gates, transitions, exposure, failure ladders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(store: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the batch replace stored rows with the same key; the rest of the store stays."""
    return store.join(batch.select(*keys).distinct(), list(keys), "left_anti").unionByName(batch)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``: a partial aggregate per task, one row per key in the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def hash_gate(state: DataFrame, observed: DataFrame, keys: Sequence[str], versions: Sequence[str]) -> DataFrame:
    """Observed rows to process: unknown key, or any version column differs from the last success (nulls compare equal)."""
    last = state.select(*keys, *[F.col(v).alias(f"_old_{v}") for v in versions], F.lit(True).alias("_known"))
    changed = F.lit(False)
    for v in versions:
        changed = changed | ~F.col(v).eqNullSafe(F.col(f"_old_{v}"))
    return observed.join(last, list(keys), "left").where(F.col("_known").isNull() | changed).select(*observed.columns)


def advance(state: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """State after a batch: the observed hash always moves, the success columns only with a success; a failed fetch moves neither.

    state: keys, ``observed_hash, success_hash, checked_at, fetch_status``. results: keys, ``hash, fetched, succeeded, at``.
    """
    j = state.join(results, list(keys), "full_outer")
    seen, fetched, ok = F.col("at").isNotNull(), F.coalesce("fetched", F.lit(False)), F.coalesce("succeeded", F.lit(False))
    return j.select(
        *keys, F.when(fetched, F.col("hash")).otherwise(F.col("observed_hash")).alias("observed_hash"),
        F.when(fetched & ok, F.col("hash")).otherwise(F.col("success_hash")).alias("success_hash"),
        F.when(seen, F.col("at")).otherwise(F.col("checked_at")).alias("checked_at"),
        F.when(seen, F.when(fetched, "ok").otherwise("failed")).otherwise(F.col("fetch_status")).alias("fetch_status"),
    )


def exposure_once(df: DataFrame, keys: Sequence[str], ratio: str, order: Sequence[str], threshold: float = 0.25) -> DataFrame:
    """The first exposure of each key that shows at least a quarter of the item."""
    kept = df.where(F.col(ratio) >= threshold)
    rest = [c for c in df.columns if c not in keys]
    first = kept.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f"))
    return first.select(*keys, *[F.col(f"_f.{c}").alias(c) for c in rest])


def health(failures: Column) -> Column:
    return F.when(failures <= 0, "Healthy").when(failures < 3, "Warning").otherwise("Error")


def trailing_failures(df: DataFrame, keys: Sequence[str], order: Sequence[str], failed: Column) -> DataFrame:
    """Number of failures since the last success of each key."""
    o = F.struct(*order)
    last_ok = F.max(F.when(~failed, o))
    per = df.groupBy(*keys).agg(last_ok.alias("_ok"))
    after = df.join(per, list(keys)).where(failed & (F.col("_ok").isNull() | (o > F.col("_ok"))))
    counts = after.groupBy(*keys).agg(F.count("*").alias("_n"))
    return per.join(counts, list(keys), "left").select(*keys, F.coalesce("_n", F.lit(0)).alias("failures"))


def crossed(df: DataFrame, keys: Sequence[str], order: Sequence[str], passed: Column) -> DataFrame:
    """Rows where a flag differs from the row before of the same key (a boundary was crossed between two checks)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = df.withColumns({"_now": passed}).withColumn("_before", F.lag("_now").over(w))
    return step.where(F.col("_before").isNotNull() & (F.col("_before") != F.col("_now"))).drop("_now", "_before")


# fixed values: sync frequency by lifecycle, else by source type
LIFECYCLE_SYNC = {"archived": "manual_only", "race_day": "emergency_as_needed", "registration": "daily_with_2h_critical_fields", "countdown": "daily", "finished": "weekly"}
SOURCE_SYNC = {"Official": "daily_before_race", "Aggregator": "daily", "International": "weekly", "Community": "daily", "Commercial": "daily", "Internal": "daily_recompute", "Map": "weekly"}


def sync_frequency(source_type: Column, lifecycle: Column) -> Column:
    table = lambda m, c: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in m.items()])
    return F.coalesce(table(LIFECYCLE_SYNC, lifecycle), table(SOURCE_SYNC, source_type))


def emergency_sync(field: Column, old: Column, new: Column, source_type: Column) -> Column:
    """Whether a change asks for a sync at once."""
    watched = field.isin("raceDate", "registrationStatus", "remainingQuota", "rulebookUrl", "lifecycleStatus")
    strong = ((field == "lifecycleStatus") & (new == "cancelled")) | ((field == "registrationStatus") & new.isin("cancelled", "registration_closed")) | ((field == "raceDate") & ~old.eqNullSafe(new))
    return F.coalesce(watched & (F.coalesce(strong, F.lit(False)) | F.coalesce(source_type == "Official", F.lit(False))), F.lit(False))
