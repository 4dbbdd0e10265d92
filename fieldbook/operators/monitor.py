"""Monitoring aggregates: coverage, health, quality, summaries, alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .merge import has_value


def field_coverage(df: DataFrame, source: str, fields: Sequence[str]) -> DataFrame:
    """``field, source, n_rows, n_present`` per source and (source null) in total: one pass with grouping sets."""
    long = df.select(F.col(source).alias("source"), *[has_value(F.col(f)).cast("int").alias(f) for f in fields]).unpivot("source", list(fields), "field", "present")
    out = long.groupingSets([["field", "source"], ["field"]], "field", "source").agg(F.count("*").alias("n_rows"), F.sum("present").alias("n_present"), F.grouping("source").alias("is_total"))
    return out


def best_sources(coverage: DataFrame) -> DataFrame:
    """Sources with the highest coverage of each field; ties all stand, joined in order."""
    per = coverage.where("is_total = 0").withColumn("share", F.col("n_present") / F.col("n_rows"))
    top = per.groupBy("field").agg(F.max("share").alias("share"))
    return per.join(top, ["field", "share"]).groupBy("field").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("best_sources"))


def coverage_health(entities: DataFrame, reports: DataFrame, key: str, ok: Column) -> DataFrame:
    """Per entity: number of reports and good ones, and HEALTHY, PARTIAL, FAILED or NO_SOURCE."""
    r = reports.groupBy(key).agg(F.count("*").alias("n_reports"), F.count_if(ok).alias("n_ok"))
    j = entities.select(key).join(r, key, "left").na.fill(0, ["n_reports", "n_ok"])
    return j.withColumn("health", F.when(F.col("n_reports") == 0, "NO_SOURCE").when(F.col("n_ok") == F.col("n_reports"), "HEALTHY").when(F.col("n_ok") > 0, "PARTIAL").otherwise("FAILED"))


def summary(df: DataFrame, counts: Mapping[str, Column], sums: Mapping[str, Column] | None = None) -> DataFrame:
    """One row of conditional counts and null-safe sums."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in counts.items()], *[F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).alias(n) for n, c in (sums or {}).items()])


def missing_counts(df: DataFrame, missing: str) -> DataFrame:
    return df.select(F.explode(missing).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def completeness(columns: Sequence[Column]) -> Column:
    """Present share of some columns in whole percent, half up."""
    n = sum((F.when(F.coalesce(has_value(c), F.lit(False)), 1).otherwise(0) for c in columns), F.lit(0))
    return F.floor(n * 100 / len(columns) + 0.5).cast("int")


def alert_attention(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Alerts with ``is_new``: unknown id, or another signature than before."""
    old = previous.select("alert_id", F.col("signature").alias("_sig"))
    return current.join(old, "alert_id", "left").withColumn("is_new", ~F.col("signature").eqNullSafe(F.col("_sig"))).drop("_sig")


def verification_alerts(facts: DataFrame, as_of: str, horizon_days: int = 14) -> DataFrame:
    """Alerts of facts: ``edition_id, field, reason, severity``; each rule is a DataFrame of its own, united.

    facts: edition_id, field, race_date, status (UNKNOWN, NOT, THIS_RUN, INHERITED), n_sources, n_conflicts, source_failed, expired.
    """
    days = F.datediff("race_date", F.lit(as_of).cast("date"))
    near = days.between(0, horizon_days)
    rules = (
        ("no_source", F.col("n_sources") == 0, F.when(near, "high").otherwise("medium")),
        ("source_conflict", F.col("n_conflicts") > 1, F.lit("high")),
        ("source_unreachable", F.col("source_failed"), F.when(near, "high").otherwise("low")),
        ("never_verified", F.col("status").isin("UNKNOWN", "NOT"), F.when(near, "high").otherwise("medium")),
        ("evidence_expired", F.col("expired"), F.lit("medium")),
        ("race_imminent_inherited", near & (F.col("status") == "INHERITED"), F.lit("medium")),
    )
    out = None
    for reason, hit, severity in rules:
        part = facts.where(F.coalesce(hit, F.lit(False))).select("edition_id", "field", F.lit(reason).alias("reason"), severity.alias("severity"))
        out = part if out is None else out.unionByName(part)
    return out


def shared_hosts(sources: DataFrame, host: str, owner: str) -> DataFrame:
    """Hosts that several owners use."""
    return sources.groupBy(host).agg(F.count_distinct(owner).alias("n_owners")).where("n_owners > 1")
