"""Change tracking: candidate facts against a snapshot, risk classes, pending changes, apply."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET = ("entity_type", "entity_id", "field")

# fixed values: fields by risk, transitions, threshold
LOW_RISK = ("Edition.registrationStatus", "Edition.registrationOpenDate", "Edition.registrationCloseDate", "Edition.registrationUrl")
HIGH_IMPACT = (
    "Edition.raceDate", "Edition.endDate", "Category.startAt", "Category.startTimes", "Category.startLocation", "Category.finishLocation",
    "Category.distanceKm", "Category.elevationGain", "Category.elevationLoss", "Category.cutoffTimeHours",
)
MIN_CONFIDENCE = 0.8


def unpivot_facts(df: DataFrame, entity_type: str, id_col: str, fields: Sequence[str]) -> DataFrame:
    """``entity_type, entity_id, field, value`` of some columns of a wide table, values as text."""
    wide = df.select(F.col(id_col).cast("string").alias("entity_id"), *[F.col(f).cast("string").alias(f) for f in fields])
    return wide.unpivot("entity_id", list(fields), "field", "value").withColumn("entity_type", F.lit(entity_type)).select(*TARGET, "value")


def fact_diff(snapshot: DataFrame, candidates: DataFrame) -> DataFrame:
    """Status of every snapshot or candidate target.

    CONFLICT: several distinct candidate values. MISSING: the snapshot lacks the target. NO_CANDIDATE: nothing was
    said about it (that is not a deletion). UNCHANGED / CHANGED: the one value against the snapshot.
    candidates: target columns, ``value, source_id, confidence``.
    """
    c = candidates.groupBy(*TARGET).agg(
        F.count_distinct("value").alias("n_values"), F.min("value").alias("new_value"), F.min("confidence").alias("confidence"),
        F.array_join(F.sort_array(F.collect_set("source_id")), ",").alias("sources"),
    )
    s = snapshot.select(*TARGET, F.col("value").alias("old_value"), F.lit(True).alias("_known"))
    both = s.join(c, list(TARGET), "full_outer")
    status = (
        F.when(F.col("n_values").isNull(), "NO_CANDIDATE").when(F.col("n_values") > 1, "CONFLICT").when(F.col("_known").isNull(), "MISSING")
        .when(F.col("old_value").eqNullSafe(F.col("new_value")), "UNCHANGED").otherwise("CHANGED")
    )
    return both.select(*TARGET, status.alias("status"), "old_value", F.when(F.col("n_values") == 1, F.col("new_value")).alias("new_value"), "confidence", "sources")


def conflict_options(candidates: DataFrame) -> DataFrame:
    """``target, value, sources, n_evidence`` of targets with several values."""
    many = candidates.groupBy(*TARGET).agg(F.count_distinct("value").alias("n")).where("n > 1").drop("n")
    grouped = candidates.groupBy(*TARGET, "value").agg(F.array_join(F.sort_array(F.collect_set("source_id")), ",").alias("sources"), F.count("*").alias("n_evidence"))
    return grouped.join(many, list(TARGET), "left_semi")


def classify(diff: DataFrame, eligible: Column, reverse: Column, low: Sequence[str] = LOW_RISK, high: Sequence[str] = HIGH_IMPACT) -> DataFrame:
    """Adds ``risk, action`` to CHANGED, CONFLICT and MISSING rows of a diff.

    ``eligible``: the source may be applied automatically. ``reverse``: an abnormal backward status step.
    """
    key = F.concat_ws(".", "entity_type", "field")
    is_high, is_low = key.isin(*high), key.isin(*low)
    risk = F.when(F.col("status") == "MISSING", "structural").when(is_high, "high_impact").when(is_low, "low").otherwise("structural")
    action = (
        F.when(F.col("status").isin("CONFLICT", "MISSING"), "needs_review").when(is_high, "pending_review").when(~is_low, "needs_review")
        .when(F.coalesce(reverse, F.lit(False)), "pending_review").when(~F.coalesce(eligible, F.lit(False)), "needs_review")
        .when(F.col("confidence").isNull() | F.isnan("confidence") | (F.col("confidence") < MIN_CONFIDENCE), "needs_review").otherwise("auto_apply")
    )
    return diff.where(F.col("status").isin("CHANGED", "CONFLICT", "MISSING")).withColumns({"risk": risk, "action": action})


def change_id(length: int = 16) -> Column:
    """Stable id of a change: target and values."""
    return F.substring(F.sha2(F.concat_ws("|", *TARGET, F.coalesce("old_value", F.lit("")), F.coalesce("new_value", F.lit(""))), 256), 1, length)


def merge_pending(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """Idempotent merge of pending changes by ``change_id``.

    A reviewed row (any status but ``pending``) stays as it is; a pending row takes up new evidence; a new id is added.
    Both have ``change_id, status, value, evidence array<string>``. Adds ``outcome``: kept, immutable, refreshed, new, collision
    (same id, another value: the stored row stands).
    """
    new = incoming.select("change_id", F.col("value").alias("_v"), F.col("evidence").alias("_e"), F.col("status").alias("_s"))
    j = store.join(new, "change_id", "full_outer")
    is_new, silent = F.col("status").isNull(), F.col("_s").isNull()
    clash = ~is_new & ~silent & ~F.col("value").eqNullSafe(F.col("_v"))
    reviewed = ~is_new & (F.col("status") != "pending")
    outcome = F.when(is_new, "new").when(silent, "kept").when(clash, "collision").when(reviewed, "immutable").otherwise("refreshed")
    merged = F.array_sort(F.array_union(F.coalesce("evidence", F.array().cast("array<string>")), F.coalesce("_e", F.array().cast("array<string>"))))
    return j.select(
        "change_id", F.coalesce("status", "_s").alias("status"), F.when(is_new, F.col("_v")).otherwise(F.col("value")).alias("value"),
        F.when(is_new | (outcome == "refreshed"), merged).otherwise(F.col("evidence")).alias("evidence"), outcome.alias("outcome"),
    )


# fixed values: allowed steps of a pending change
TRANSITIONS = (("pending", "approved"), ("pending", "rejected"), ("approved", "applied"))


def transition(store: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(new store, refused steps)``: steps ``change_id, to`` that the state machine does not allow are refused."""
    allowed = F.lit(False)
    for a, b in TRANSITIONS:
        allowed = allowed | ((F.col("status") == a) & (F.col("to") == b))
    j = store.join(steps, "change_id", "left")
    moved = j.withColumn("status", F.when(allowed, F.col("to")).otherwise(F.col("status"))).select(*store.columns)
    unknown = steps.join(store.select("change_id", "status"), "change_id", "left")
    return moved, unknown.where(~F.coalesce(allowed, F.lit(False)))


def apply_changes(snapshot: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Applies approved changes whose old value still stands; ``(new snapshot, stale changes)``.

    Several changes of one target are taken in ``seq`` order as long as each one's old value is the value before it.
    """
    approved = changes.where("status = 'approved'")
    chain = approved.groupBy(*TARGET).agg(F.sort_array(F.collect_list(F.struct("seq", "change_id", "old_value", "new_value"))).alias("steps"))
    j = snapshot.join(chain, list(TARGET), "left")
    start = F.struct(F.col("value").alias("v"), F.array().cast("array<string>").alias("stale"))
    walk = F.aggregate(
        "steps", start,
        lambda a, s: F.when(a["v"].eqNullSafe(s["old_value"]), F.struct(s["new_value"].alias("v"), a["stale"].alias("stale"))).otherwise(
            F.struct(a["v"].alias("v"), F.concat(a["stale"], F.array(s["change_id"])).alias("stale"))
        ),
    )
    done = j.withColumn("_w", walk)
    after = done.select(*TARGET, F.when(F.col("steps").isNull(), F.col("value")).otherwise(F.col("_w.v")).alias("value"))
    stale = done.where("steps is not null").select(F.explode("_w.stale").alias("change_id"))
    lost = approved.join(snapshot, list(TARGET), "left_anti").select("change_id")
    return after, stale.unionByName(lost)


def abnormal_transition(old: Column, new: Column) -> Column:
    """A registration status that moves backwards (fixed values)."""
    back = (old == "registration_closed") & new.isin("registration_open", "lottery", "waiting_list")
    ended = old.isin("race_finished", "cancelled") & (new != old)
    return F.coalesce(back | ended, F.lit(False))


CHANGE_COLUMNS = ("change_id", "event_id", "edition_id", "category_id", "entity_type", "field")
EVIDENCE_COLUMNS = ("source_id", "source_url", "evidence_text", "evidence_locator", "confidence", "fetched_at", "content_hash", "extraction_method")


def pending_rows(changes: DataFrame, created_at: str) -> DataFrame:
    """Changes as pending rows: the first evidence beside the row, no candidate value where sources conflict. A change without evidence fails.

    changes: ``CHANGE_COLUMNS, old_value, new_value, conflict, risk, reason, evidence`` (array of structs of ``EVIDENCE_COLUMNS``).
    """
    first = F.get("evidence", F.lit(0))
    ok = F.assert_true(F.coalesce(F.size("evidence") > 0, F.lit(False)), F.concat(F.lit("pending change without evidence: "), F.col("change_id")))
    rows = changes.where(ok.isNull())
    none = F.lit(None).cast("string")
    return rows.select(
        *CHANGE_COLUMNS, F.col("old_value").alias("current_value"), F.when(~F.col("conflict"), F.col("new_value")).alias("candidate_value"), *[first[c].alias(c) for c in EVIDENCE_COLUMNS], "evidence", "conflict", "risk", "reason",
        F.lit("pending").alias("status"), F.lit(created_at).alias("created_at"), none.alias("reviewed_at"), none.alias("review_reason"), none.alias("applied_at"),
    )


def change_rows(pending: DataFrame) -> DataFrame:
    """Pending rows as changes again, with the sources of all their evidence. A row without a selected value fails."""
    ok = F.assert_true(F.col("candidate_value").isNotNull(), F.concat(F.lit("pending change without a value: "), F.col("change_id")))
    each = lambda c: F.transform("evidence", lambda e: e[c])
    return pending.where(ok.isNull()).select(
        *CHANGE_COLUMNS, F.col("current_value").alias("old_value"), F.col("candidate_value").alias("new_value"), each("source_id").alias("source_ids"), each("source_url").alias("source_urls"), F.col("created_at").alias("detected_at"), "risk",
        F.lit("pending_review").alias("action"), "reason", "evidence", F.coalesce("conflict", F.lit(False)).alias("conflict"),
    )


def same_fact(pending: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming_id, change_id`` of the stored change that says the same: equal id, else equal target and values.

    Of several equal ones a reviewed row with the same evidence stands before a pending one; a conflict is the same only by its
    target. Rows: ``change_id, status`` (stored), target columns, ``old_value, new_value, conflict, evidence_hash``.
    """
    fact = [*TARGET, F.coalesce("old_value", F.lit("\u0000")).alias("_o"), F.coalesce("new_value", F.lit("\u0000")).alias("_n")]
    key = lambda df, keep: df.select(*keep, *fact[: len(TARGET)], F.when(F.col("conflict"), "").otherwise(F.xxhash64(*fact[len(TARGET) :]).cast("string")).alias("_v"), "conflict", "evidence_hash")
    a = key(incoming, [F.col("change_id").alias("incoming_id")])
    b = key(pending, ["change_id", "status"]).withColumnRenamed("evidence_hash", "_e")
    by_id = incoming.select(F.col("change_id").alias("incoming_id")).join(pending.select("change_id"), F.col("incoming_id") == F.col("change_id"))
    met = a.join(b, [*TARGET, "_v", "conflict"]).where((F.col("status") == "pending") | (F.col("_e") == F.col("evidence_hash")))
    best = met.groupBy("incoming_id").agg(F.min_by("change_id", F.struct((F.col("status") == "pending").alias("p"), "change_id")).alias("change_id"))
    return by_id.unionByName(best.join(by_id.select("incoming_id"), "incoming_id", "left_anti"))
