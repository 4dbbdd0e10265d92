"""Validation gates: ordered course points, publication facts, field values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import strict_date, zoned_instant

# fixed values
POINT_TYPES = ("checkpoint", "water_point", "finish")
POINT_SERVICES = ("water", "food", "hot_food", "drop_bag", "medical")
ORDER_DERIVED = r"-(?:cp|point|checkpoint)-?\d+$"


def issues(*rules: tuple[Column, str]) -> Column:
    """Names of the rules that hold, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in rules])))


def not_decreasing(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the value is below the last known one before it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.col(value) < F.last(value, ignorenulls=True).over(w), F.lit(False)))


def seen_before(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: an earlier row of the group has the same value."""
    w = Window.partitionBy(*keys, value).orderBy(*order)
    return df.withColumn(out, F.col(value).isNotNull() & (F.row_number().over(w) > 1))


def course_point_issues(points: DataFrame) -> DataFrame:
    """One row per point with ``issues``. Points: category_id, point_id, display_order, name, type, distance_km, cutoff_at."""
    order = ["display_order", "point_id"]
    p = points.withColumn("_cut", zoned_instant(F.col("cutoff_at")))
    p = not_decreasing(p, ["category_id"], order, "distance_km", "_back")
    p = not_decreasing(p, ["category_id"], order, "_cut", "_early")
    p = seen_before(p, ["category_id"], order, "point_id", "_dup_id")
    p = seen_before(p, ["category_id"], order, "display_order", "_dup_order")
    prefix = F.concat(F.col("category_id"), F.lit("-"))
    rest = F.when(F.col("point_id").startswith(prefix), F.substring("point_id", F.length(prefix) + 1, F.length("point_id")))
    bad_id = F.col("point_id").isNull() | rest.isNull() | ~F.coalesce(rest.rlike("[a-z]"), F.lit(False)) | F.col("point_id").rlike(ORDER_DERIVED)
    found = issues(
        (bad_id, "pointId_identity"), (~bad_id & F.col("_dup_id"), "pointId_unique"), (F.col("display_order").isNull() | (F.col("display_order") < 1) | F.col("_dup_order"), "displayOrder"),
        (F.col("name").isNull() | (F.trim("name") == ""), "name"), (~F.col("type").isin(*POINT_TYPES), "type"), (F.isnan("distance_km") | (F.col("distance_km") < 0), "distance_value"),
        (F.col("_back"), "distance_decreases"), (F.col("cutoff_at").isNotNull() & F.col("_cut").isNull(), "cutoff_value"), (F.col("_early"), "cutoff_backwards"),
    )
    return p.withColumn("issues", found).drop("_cut", "_back", "_early", "_dup_id", "_dup_order")


def publication_gate(r: DataFrame) -> DataFrame:
    """Adds ``gate_issues, gate_publishable`` to editions with their gate.

    Columns: event_id, edition_event_id, edition_id, edition_year, race_date, end_date, city, venue, primary_category_id,
    category_ids array, source_ids array, active_source_ids array (null: no registry entry), gate struct<requested_year, latest_year,
    latest_source, primary_source, secondary_source, date_sources array, date_evidence, conflict_status, publishable>,
    latest_source_year (year that the latest source states), evidence_dates array (dates that the date sources state).
    """
    g = lambda f: F.col(f"gate.{f}")
    no_gate = F.col("gate").isNull()
    conflict = ~g("requested_year").eqNullSafe(g("latest_year")) | ~F.col("edition_year").eqNullSafe(g("latest_year"))
    known = lambda c: F.coalesce(F.array_contains("source_ids", c), F.lit(False))
    cited = F.array_compact(F.concat(F.array(g("primary_source"), g("secondary_source"), g("latest_source")), g("date_sources")))
    date = F.col("race_date")
    with_gate = [
        (~g("requested_year").eqNullSafe(g("latest_year")), "requested_official_edition_conflict"),
        (~F.col("edition_year").eqNullSafe(g("latest_year")), "canonical_official_edition_conflict"),
        ((g("conflict_status") == "needs_review") != conflict, "conflict_status_mismatch"),
        (~known(g("primary_source")), "primary_source_missing"),
        (~known(g("latest_source")), "latest_official_source_missing"),
        (g("secondary_source").isNotNull() & ~known(g("secondary_source")), "secondary_source_missing"),
        (~F.col("latest_source_year").eqNullSafe(g("latest_year")), "latest_official_edition_evidence_mismatch"),
        (F.col("active_source_ids").isNotNull() & (F.size(F.array_except(cited, "active_source_ids")) > 0), "registry_source_missing"),
        (date.isNull() & (g("date_evidence") != "exhausted_no_reliable_date"), "race_date_missing_before_source_check"),
        (date.isNotNull() & strict_date(date).isNull(), "race_date_invalid"),
        (date.isNotNull() & ((g("date_evidence") != "verified") | (F.size(F.array_intersect(g("date_sources"), "source_ids")) == 0)), "race_date_evidence_missing"),
        (date.isNotNull() & F.exists("evidence_dates", lambda d: d != date), "race_date_evidence_mismatch"),
        (F.coalesce("city", "venue").isNull(), "location_missing"),
        (~F.coalesce(F.array_contains("category_ids", F.col("primary_category_id")), F.lit(False)), "primary_category_missing"),
    ]
    base = [
        (F.col("event_id").isNull() | ~F.col("edition_event_id").eqNullSafe(F.col("event_id")), "event_identity_invalid"),
        (~F.col("edition_id").eqNullSafe(F.concat_ws("-", "event_id", F.col("edition_year").cast("string"))), "edition_identity_invalid"),
    ]
    without = ["latest_official_source_missing", "primary_source_missing", "race_date_missing_before_source_check", "conflict_status_mismatch", "publishable_status_mismatch"]
    found = issues(*base, *[(~no_gate & c, n) for c, n in with_gate], *[(no_gate, n) for n in without])
    r = r.withColumn("gate_issues", found)
    derived = (F.size("gate_issues") == 0) & (g("conflict_status") == "none")
    wrong = ~no_gate & ~g("publishable").eqNullSafe(derived)
    r = r.withColumn("gate_issues", F.when(wrong, F.array_union("gate_issues", F.array(F.lit("publishable_status_mismatch")))).otherwise(F.col("gate_issues")))
    return r.withColumn("gate_publishable", (F.size("gate_issues") == 0) & F.coalesce(g("publishable"), F.lit(False)))


def field_value_issues(field: Column, value: Column) -> Column:
    """Issue of a fact value by the type of its field; null if it is valid."""
    num = F.when(value.rlike(r"^-?\d+(\.\d+)?$"), value.cast("double"))
    return (
        F.when(value.isNull(), "empty")
        .when(field.isin("raceDate", "endDate", "registrationOpenDate", "registrationCloseDate", "lotteryResultDate") & strict_date(value).isNull(), "date")
        .when(field.isin("startAt") & zoned_instant(value).isNull(), "zoned_time")
        .when(field.isin("distanceKm", "cutoffTimeHours") & F.coalesce(num <= 0, F.lit(True)), "positive_number")
        .when(field.isin("elevationGain", "elevationLoss") & F.coalesce(num < 0, F.lit(True)), "number")
        .when(field.isin("registrationUrl") & ~value.rlike(r"^https?://[^\s/]+"), "url")
    )


def unique_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once (must be empty)."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
