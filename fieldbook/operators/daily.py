"""The summaries of a run in one aggregation: relations of different grain meet as one tagged stream of measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name of a metric -> (relation, condition or value of a row)
Metrics = dict[str, tuple[str, Column]]


def one(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)


def all_rows() -> Column:
    return F.lit(1)


def daily_metrics() -> Metrics:
    """The 23 numbers of a daily run. Relations: editions, sources, changes (required ones with ``created``), reviews, alerts."""
    status = F.col("extraction")
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    return {
        "editions_checked": ("editions", all_rows()),
        "sources_checked": ("sources", all_rows()),
        "sources_fetched": ("sources", one(F.col("fetch") == "success")),
        "sources_failed": ("sources", one(~status.isin("success", "unchanged"))),
        "sources_identity_rejected": ("sources", one(F.col("identity") == "rejected")),
        "sources_identity_uncertain": ("sources", one(F.col("identity") == "uncertain")),
        "sources_unchanged": ("sources", one(status == "unchanged")),
        "sources_extracted": ("sources", one((F.col("request") == "success") & (status == "success"))),
        "model_calls": ("sources", one(F.col("request").isin("success", "error"))),
        "input_tokens": ("sources", number("input_tokens")),
        "output_tokens": ("sources", number("output_tokens")),
        "total_tokens": ("sources", number("total_tokens")),
        "candidates": ("sources", number("n_candidates")),
        "accepted": ("sources", number("n_accepted")),
        "rejected": ("sources", number("n_rejected")),
        "changes": ("changes", all_rows()),
        "pending_created": ("changes", one(F.col("created"))),
        "pending_deduped": ("changes", one(~F.col("created"))),
        "semantic_reviews": ("reviews", all_rows()),
        "canonical_writes": ("sources", one(F.col("written"))),
        "verification_alerts": ("alerts", all_rows()),
        "verification_alerts_high": ("alerts", one(F.col("severity") == "HIGH")),
        "verification_alerts_review": ("alerts", one(F.col("severity") == "REVIEW")),
    }


def discovery_metrics() -> Metrics:
    """The numbers of a discovery run. Relations: runs (one row an edition), found (candidates of editions)."""
    return {
        "editions_checked": ("runs", all_rows()), "new_sources": ("found", one(F.col("is_new"))), "candidates": ("found", all_rows()), "unresolved_review": ("found", one(F.col("review") == "unresolved")),
        "changed_candidates": ("found", one(F.col("changed"))), "failed": ("runs", one(F.col("n_errors") > 0)), "not_covered": ("runs", one(F.col("status") == "NOT_COVERED")),
    }


def verification_metrics() -> Metrics:
    """Counts of health classes and of the status of fields. Relations: editions, facts."""
    health = {f"health_{h.lower()}": ("editions", one(F.col("health") == h)) for h in ("HEALTHY", "PARTIAL", "FAILED", "NO_SOURCE")}
    facts = {f"facts_{s.lower()}": ("facts", one(F.col("status") == s)) for s in ("VERIFIED_THIS_RUN", "VERIFIED_INHERITED", "NOT_VERIFIED_THIS_RUN", "UNKNOWN")}
    return health | facts | {"facts_checked": ("facts", all_rows()), "facts_verified": ("facts", one(F.col("status").isin("VERIFIED_THIS_RUN", "VERIFIED_INHERITED")))}


def summary(relations: dict[str, DataFrame], metrics: Metrics, by: str | None = None) -> DataFrame:
    """All metrics in one job: each relation gives its own measures and null for the others', and one partial sum goes over the union.

    With ``by`` (a column that all relations have) there is a row for each value and one (null) for the whole, by grouping sets.
    """
    parts = []
    for name, df in relations.items():
        own = {m: value.cast("bigint").alias(m) for m, (of, value) in metrics.items() if of == name}
        rest = [F.lit(None).cast("bigint").alias(m) for m in metrics if m not in own]
        parts.append(df.select(*([F.col(by).alias("by")] if by else []), *own.values(), *rest).select(*(["by"] if by else []), *metrics))
    both = reduce(DataFrame.unionByName, parts)
    sums = [F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in metrics]
    if by is None:
        return both.agg(*sums)
    return both.groupingSets([["by"], []], "by").agg(*sums, F.grouping("by").alias("is_total"))
