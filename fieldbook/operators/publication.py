"""The public view of the race graph: which editions and categories may be shown, and what is shown of them.

A record row has ``event, edition`` (structs) and ``categories`` (array of structs), as read from a canonical snapshot.
Governance of each is ``struct<verified, verification_status, internal_flags array, missing_fields array, field_sources
map<field, source type>, merge_trace array<struct<field, selected_source, n_candidates>>, sources array<struct<source_type,
raw_data map<string,string>>>>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import strict_date
from ..functions.display import date_range_text, grouped_number, location_text, number_text, start_text
from ..functions.text import js_trim
from .catalog import publishable
from .gates import course_point_issues

# fixed values
NON_PRODUCTION_FLAGS = ("foundation_fixture", "test_only", "non_production_fixture", "not_production_data", "do_not_publish")
VERIFIED = ("verified", "auto_verified")
CONFLICT_FLAG = "_conflict_needs_review"
CORE_FACTS = ("distanceKm", "cutoffTimeHours", "startLocation", "finishLocation")
#: facts of a category that a conflict can be about, and their columns
CATEGORY_FACTS = {
    "categoryName": "category_name", "shortName": "short_name", "distanceKm": "distance_km", "elevationGain": "elevation_gain", "elevationLoss": "elevation_loss",
    "cutoffTimeHours": "cutoff_time_hours", "startAt": "start_at", "startLocation": "start_location", "finishLocation": "finish_location", "registrationUrl": "registration_url",
}
#: names of places that are shown in another language, for one category each (category id, official text, shown text)
SHOWN_PLACES = (
    ("beijing-marathon-2026-marathon", "start_location", "Tian'anmen Square", "天安门广场"),
    ("beijing-marathon-2026-marathon", "finish_location", "Landscape Avenue, Central Area of Beijing Olympic Park", "奥林匹克公园中心区景观大道"),
)
NO_DATE = "9999-12-31"
DETAIL_ONLY = ("categories", "race_guide", "race_strategy", "accommodation_recommendations")


def _full(c: Column) -> Column:
    return F.coalesce(js_trim(c) != "", F.lit(False))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def governance_publishable(g: Column) -> Column:
    """Verified, and without a flag that keeps it from production."""
    return publishable(g["internal_flags"], NON_PRODUCTION_FLAGS, g["verified"], g["verification_status"].isin(*VERIFIED))


def localized_conflict(c: Column) -> Column:
    """A pending category that may be shown all the same: its only conflicts are about optional facts that it leaves out.

    All flags name a conflict under review, an official source states the core facts, and every unresolved conflict is about a
    fact that is listed as missing and has no value.
    """
    g = c["governance"]
    positive = lambda x: _yes((x > 0) & (x < float("inf")))
    official = F.filter(g["sources"], lambda s: s["source_type"] == "official")
    stated = lambda fact, column: F.exists(official, lambda s: _yes(F.element_at(s["raw_data"], F.lit(fact)) == c[column]))
    by_official = lambda fact: _yes(F.element_at(g["field_sources"], F.lit(fact)) == "official")
    open_ = F.filter(F.coalesce(g["merge_trace"], F.array()), lambda t: _yes((t["selected_source"] == "placeholder") & (t["n_candidates"] > 1)))
    facts = F.map_from_arrays(F.array(*map(F.lit, CATEGORY_FACTS)), F.array(*[c[x].cast("string") for x in CATEGORY_FACTS.values()]))
    optional = lambda t: (
        _full(t["field"]) & _yes(F.array_contains(g["missing_fields"], t["field"])) & F.element_at(facts, t["field"]).isNull() & ~_yes(t["field"].isin(*CORE_FACTS))
    )
    flags = F.coalesce(g["internal_flags"], F.array().cast("array<string>"))
    return (
        _yes(g["verification_status"] == "pending") & (F.size(flags) > 0) & F.forall(flags, lambda f: f.endswith(CONFLICT_FLAG)) & (F.size(official) > 0)
        & positive(c["distance_km"]) & positive(c["cutoff_time_hours"]) & _full(c["start_location"]) & _full(c["finish_location"])
        & by_official("distanceKm") & by_official("cutoffTimeHours") & stated("startLocation", "start_location") & stated("finishLocation", "finish_location")
        & (F.size(open_) > 0) & F.forall(open_, optional)
    )


def points_status_valid(c: Column, core_complete: Column) -> Column:
    """Whether the stated status of the course points fits them: ``available`` needs all core fields, points need a status."""
    status, has = c["course_point_data_status"], F.coalesce(F.size(c["course_points"]) > 0, F.lit(False))
    shown = _yes(status.isin("available", "partial"))
    return F.when(~has, ~shown).otherwise(shown & (~_yes(status == "available") | core_complete))


def core_points_complete(c: Column) -> Column:
    """Every point has its id, name, order, distance and cutoff, and no two have one order."""
    points = c["course_points"]
    whole = lambda p: (
        p["point_id"].startswith(F.concat(c["category_id"], F.lit("-"))) & _full(p["name"]) & (p["display_order"] > 0) & (p["distance_km"] < float("inf")) & F.try_to_timestamp(p["cutoff_at"]).isNotNull()
        & p["cutoff_at"].rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:\d{2})$")
    )
    return F.forall(points, lambda p: _yes(whole(p))) & (F.size(F.array_distinct(F.transform(points, lambda p: p["display_order"]))) == F.size(points))


def category_sound(c: Column, edition_id: Column) -> Column:
    """Whether a category may be shown as far as its own row tells; the order of its course points is checked as rows."""
    return (
        _full(c["category_id"]) & _yes(c["edition_id"] == edition_id) & _full(c["category_name"]) & _yes(F.abs(c["display_order"]) < float("inf"))
        & (c["elevation_loss"].isNull() | _yes((c["elevation_loss"] >= 0) & (c["elevation_loss"] < float("inf"))))
        & _yes(points_status_valid(c, core_points_complete(c))) & (governance_publishable(c["governance"]) | localized_conflict(c))
    )


def bad_points(records: DataFrame) -> DataFrame:
    """``edition_id, category_id`` of the categories whose course points have issues."""
    c = F.col("category")
    rows = records.select(F.col("edition.edition_id").alias("edition_id"), F.explode("categories").alias("category"))
    points = rows.select("edition_id", c["category_id"].alias("category_id"), F.explode(c["course_points"]).alias("p")).select("edition_id", "category_id", "p.*")
    return course_point_issues(points).where(F.size("issues") > 0).select("edition_id", "category_id").distinct()


def public_category(c: Column, primary: Column) -> Column:
    """What is shown of a category; course points in display order."""
    place = lambda column: F.coalesce(*[F.when((c["category_id"] == i) & (c[column] == a), F.lit(b)) for i, k, a, b in SHOWN_PLACES if k == column], c[column])
    ordered = F.array_sort(F.transform(c["course_points"], lambda p: F.struct(p["display_order"].alias("display_order"), p["point_id"].alias("point_id"), p["type"].alias("type"), p["name"].alias("name"), p["distance_km"].alias("distance_km"), p["cutoff_at"].alias("cutoff_at"))))
    return F.struct(
        c["display_order"].alias("display_order"), c["category_id"].alias("category_id"), c["category_name"].alias("name"), c["short_name"].alias("short_name"), c["distance_km"].alias("distance_km"),
        c["elevation_gain"].alias("elevation_gain"), c["elevation_loss"].alias("elevation_loss"), c["cutoff_time_hours"].alias("cutoff_time_hours"), c["start_at"].alias("start_at"),
        place("start_location").alias("start_location"), place("finish_location").alias("finish_location"), c["registration_url"].alias("registration_url"),
        _yes(c["category_id"] == primary).alias("is_primary_category"), ordered.alias("course_points"), F.coalesce(c["course_point_data_status"], F.lit("unknown")).alias("course_point_data_status"),
    )


def publishable_details(records: DataFrame, gate: DataFrame) -> DataFrame:
    """The public detail of every edition that may be shown.

    ``gate``: ``edition_id, gate_publishable`` of the publication gate. An edition needs a sound identity, active life cycles, valid
    dates in order, verified governance, an open gate, and its primary category among those that may be shown.
    """
    e, v = F.col("edition"), F.col("event")
    start, end = strict_date(e["race_date"]), strict_date(e["end_date"])
    conditions = [
        _full(v["event_id"]), _full(e["edition_id"]), e["event_id"] == v["event_id"], _full(e["edition_name"]), v["lifecycle_status"] == "active", e["lifecycle_status"] == "active",
        e["race_date"].isNull() | start.isNotNull(), e["end_date"].isNull() | _yes(end >= start), governance_publishable(v["governance"]), governance_publishable(e["governance"]),
    ]
    none, primary = F.array().cast("array<string>"), F.when(F.col("_primary") != "", F.col("_primary"))
    has_primary = primary.isNull() | F.exists("categories", lambda c: c["category_id"] == primary)
    # an edition is judged in its own row, and only what may be shown then travels
    own = records.where(publishable(none, (), *conditions)).withColumn("_shown", F.filter(F.coalesce("categories", F.array()), lambda c: category_sound(c, e["edition_id"])))
    place = [e[x] for x in ("country", "province", "city", "district", "venue")]
    rows = own.select(
        e["edition_id"].alias("edition_id"), v["event_id"].alias("event_id"), e["edition_id"].alias("slug"), e["edition_name"].alias("name"), v["event_type"].alias("race_type"), e["race_date"].alias("race_date"),
        e["end_date"].alias("end_date"), date_range_text(e["race_date"], e["end_date"]).alias("date_display"), F.struct(*[x.alias(n) for x, n in zip(place, ("country", "province", "city", "district", "venue"))]).alias("location"),
        location_text(*place).alias("location_display"), e["cover_image"].alias("cover_image"), e["hero_image"].alias("hero_image"), e["registration_status"].alias("registration_status"), e["registration_url"].alias("registration_url"),
        F.array_sort(F.transform("_shown", lambda c: public_category(c, e["primary_category_id"]))).alias("categories"), e["primary_category_id"].alias("_primary"),
        F.transform("categories", lambda c: c["category_id"]).alias("_category_ids"),
    )
    rows = rows.where(has_primary)
    bad = bad_points(records).groupBy("edition_id").agg(F.collect_set("category_id").alias("_bad"))  # categories of one edition
    j = rows.join(gate.select("edition_id", "gate_publishable"), "edition_id").where("gate_publishable").join(bad, "edition_id", "left").drop("gate_publishable")
    kept = F.when(F.col("_bad").isNull(), F.col("categories")).otherwise(F.filter("categories", lambda c: ~F.array_contains("_bad", c["category_id"])))
    return j.withColumn("categories", kept).drop("_bad").where(has_primary)


def with_editorial(details: DataFrame, content: DataFrame, rooms: DataFrame) -> DataFrame:
    """Adds guide, strategy and accommodation; null or empty where an edition has none.

    content: ``event_id, guide, strategy`` (see :func:`public_guide`, :func:`public_strategy`); the strategy is shown only for the primary
    category, and only if the edition has it. rooms: ``edition_id, recommendation`` (struct that begins with its display order).
    """
    listed = rooms.groupBy("edition_id").agg(F.array_sort(F.collect_list("recommendation")).alias("accommodation_recommendations"))
    j = details.join(content.select("event_id", "guide", "strategy"), "event_id", "left").join(listed, "edition_id", "left")
    fits = _yes((F.col("strategy.category_id") == F.col("_primary")) & F.array_contains("_category_ids", F.col("strategy.category_id")))
    rooms_or_none = F.coalesce("accommodation_recommendations", F.array().cast(listed.schema["accommodation_recommendations"].dataType))
    return j.withColumns({"race_guide": F.col("guide"), "race_strategy": F.when(fits, F.col("strategy")), "accommodation_recommendations": rooms_or_none}).drop("guide", "strategy", "_primary", "_category_ids")


def public_guide(c: Column) -> Column:
    """Guide of an editorial content: opening, judgment, experiences, fit of runners (null without items), closing."""
    texts = lambda ps: F.transform(ps, lambda p: p["text"])
    part = lambda x: F.struct(x["title"].alias("title"), texts(x["paragraphs"]).alias("body"))
    some = lambda x: F.when(x != "", x)
    fit = F.struct(c["suitability"]["title"].alias("title"), some(c["suitability"]["introduction"]).alias("introduction"), F.transform(c["suitability"]["items"], part).alias("items"))
    sections = F.transform(c["evidence"]["sections"], lambda s: F.struct(s["title"].alias("title"), s["paragraphs"].alias("body"), some(s["emphasis"]).alias("conclusion")))
    guide = F.struct(
        part(c["impression"]).alias("opening"), part(c["viewpoint"]).alias("judgment"), sections.alias("experiences"), F.when(F.size(c["suitability"]["items"]) > 0, fit).alias("runner_fit"), c["transition"].alias("closing")
    )
    return F.when(c.isNotNull(), guide)


def public_strategy(c: Column) -> Column:
    """Strategy of an editorial content: its sections as numbered items with marked paragraphs."""
    paragraph = lambda p: F.struct(p["text"].alias("text"), _yes(p["emphasis"]).alias("emphasis"))
    item = lambda s: F.struct(s["number"].alias("number"), s["title"].alias("title"), F.transform(s["paragraphs"], paragraph).alias("paragraphs"))
    strategy = F.struct(*[c[n].alias(n) for n in ("category_id", "eyebrow", "title", "scope_note")], F.transform(c["sections"], item).alias("items"), c["closing"].alias("closing"))
    return F.when(c.isNotNull(), strategy)


def public_list(details: DataFrame) -> DataFrame:
    """List rows: details without what only a detail has, by date (undated last), then id."""
    kept = details.drop(*DETAIL_ONLY, "_primary", "_category_ids")
    return kept.orderBy(F.coalesce("race_date", F.lit(NO_DATE)), "edition_id")


def public_detail(details: DataFrame, edition_id: str) -> DataFrame:
    """``status, race``: 200 with the detail, or 404 with none; always one row."""
    found = details.where(F.col("edition_id") == edition_id).limit(1).select(F.struct("*").alias("race"))
    one = details.sparkSession.range(1).select(F.lit(1).alias("_one"))
    return one.join(found.withColumn("_one", F.lit(1)), "_one", "left").select(F.when(F.col("race").isNull(), 404).otherwise(200).alias("status"), "race")


def data_updated_at(generated_at: str, records: DataFrame) -> DataFrame:
    """``data_updated_at``: the largest time stamp as text, over snapshot, events, editions and categories."""
    stamps = F.concat(F.array("event.updated_at", "edition.updated_at"), F.transform("categories", lambda c: c["updated_at"]))
    latest = records.select(F.array_max(F.filter(stamps, _full)).alias("t")).agg(F.max("t").alias("t"))
    return latest.select(F.greatest("t", F.lit(generated_at)).alias("data_updated_at"))


def upcoming(races: DataFrame, today: str) -> DataFrame:
    """Races whose last day is today or later, undated ones too; by date (undated last), then id."""
    day = F.coalesce(strict_date(F.col("end_date")), strict_date(F.col("race_date")))
    return races.where(day.isNull() | (day >= F.lit(today).cast("date"))).orderBy(strict_date(F.col("race_date")).asc_nulls_last(), "edition_id")


def json_ld(details: DataFrame) -> DataFrame:
    """``edition_id, json_ld``: a schema.org event of each detail; absent facts are left out."""
    place = F.struct(F.lit("Place").alias("@type"), F.col("location_display").alias("name"), F.struct(F.lit("PostalAddress").alias("@type"), F.col("location.country").alias("addressCountry"), F.col("location.province").alias("addressRegion"), F.col("location.city").alias("addressLocality")).alias("address"))
    distances = F.array_join(F.transform(F.filter("categories", lambda c: c["distance_km"].isNotNull()), lambda c: F.concat(number_text(c["distance_km"]), F.lit("KM"))), " / ")
    event = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("SportsEvent").alias("@type"), F.col("name"), F.col("race_date").alias("startDate"), F.coalesce("end_date", "race_date").alias("endDate"),
        place.alias("location"), F.col("cover_image").alias("image"), F.col("registration_url").alias("url"), F.when(distances != "", distances).alias("description"),
    )
    return details.select("edition_id", F.to_json(event).alias("json_ld"))


def fact_rows(c: Column) -> Column:
    """Key, label and value of the facts of a public category, in order; a place that is start and finish is shown once."""
    row = lambda key, label, value: F.when(value.isNotNull() & (value != ""), F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"), value.alias("value")))
    amount = lambda x, unit: F.concat(grouped_number(x), F.lit(unit))
    start, finish = c["start_location"], c["finish_location"]
    both = F.coalesce((start != "") & (start == finish), F.lit(False))
    return F.array_compact(
        F.array(
            row("distance", "距离", amount(c["distance_km"], " km")), row("elevationGain", "爬升", amount(c["elevation_gain"], " m")), row("elevationLoss", "下降", amount(c["elevation_loss"], " m")), row("cutoff", "关门时间", amount(c["cutoff_time_hours"], " h")),
            row("startAt", "出发时间", start_text(c["start_at"])), F.when(both, row("startFinish", "起终点", start)), F.when(~both, row("start", "起点", start)), F.when(~both, row("finish", "终点", finish)),
        )
    )
