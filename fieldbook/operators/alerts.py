"""Evidence of critical facts by single candidate, and the alerts of an edition.

Candidates meet their source's report and are reduced to one row for each thing they say before they meet the facts; whether a fact is
confirmed or contradicted is then decided by conditional maxima in one aggregation. Each edition has one row of what its sources did, from
which all its alerts are made together.

Tables (further columns are ignored):

* records: ``event_id, edition_id, timezone, race_date, end_date, registration_open_date, registration_close_date, lottery_result_date``,
  all text, ``registration_status``, ``monitored`` (boolean)
* facts: ``edition_id, category_id`` (null: of the edition), ``field, value`` (JSON text)
* registry: ``edition_id, source_id, tier, source_type, status, is_primary``
* reports: ``edition_id, source_id, source_url, source_tier, identity, extraction, request, fetched_at``
* candidates: ``edition_id, source_id`` (of the report), ``event_id, target_edition_id, category_id, entity_type, field, value,
  current_value, source_url, action, diff, authority, evidence_text, evidence_locator, evidence_verified_at``
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import ZONED
from .registry import active_sources

IMMINENT_DAYS = 14
ZONES = sorted(zoneinfo.available_timezones())
BOUNDARIES = ("registration_open_date", "registration_close_date", "lottery_result_date", "race_date", "end_date")
OFFICIAL = "primary_official"
CONFIRMED = ("VERIFIED_THIS_RUN", "VERIFIED_INHERITED")

# fixed values: what an alert says
OPEN_LIKE = ("registration_open", "upcoming", "lottery", "waiting_list")
GENERAL_FIELDS = ("raceDate", "registrationStatus", "startAt/startTimes")
TEXTS = {
    "OFFICIAL_SOURCE_NOT_REGISTERED": (
        "An approved Edition-scoped official source and current direct field evidence.",
        "Review official source coverage and approve a source before relying on current facts.",
    ),
    "OFFICIAL_SOURCE_UNAVAILABLE": (
        "Current Edition-matched official processing and direct critical-fact evidence.",
        "Check official sources manually; do not promote auxiliary sources or infer new values.",
    ),
    "OFFICIAL_SOURCE_DEGRADED": (
        "Effective processing of the primary official source(s).",
        "Inspect the failed primary source and confirm critical facts using direct official evidence.",
    ),
    "EDITION_IDENTITY_UNCERTAIN": (
        "Unambiguous target-Edition identity in the fetched official content.",
        "Check the source's Edition scope; do not accept its facts until identity passes.",
    ),
    "REGISTRATION_LIFECYCLE_REVIEW": (
        "An accepted, Edition-matched official statement with a verifiable publication or effective time after the lifecycle boundary.",
        "Verify the current registration stage with the organizer; do not derive a new status from time alone.",
    ),
    "CRITICAL_FACT_UNVERIFIED": (
        "Accepted current-run official evidence matching each affected Canonical field.",
        "Review the current official schedule and start times; keep high-impact changes in Pending.",
    ),
}
STATUS_MISSING = "An accepted, Edition-matched official statement of the current registration status."
NOT_REGISTERED = "No eligible official source is registered for this Edition."
CLOSE_PASSED = "The recorded registration close boundary has passed without time-qualified official status confirmation after it."
LOTTERY_PASSED = "The recorded lottery result boundary has passed without time-qualified official status confirmation after it."
NEAR_WITHOUT_STATUS = f"Race is within {IMMINENT_DAYS} calendar days without direct official registration-status confirmation this run."
NEAR_UNVERIFIED = f"Race is within {IMMINENT_DAYS} calendar days; listed critical facts lack direct official confirmation this run."
MATCHES_ONLY = "Current-run official value matches Canonical; post-boundary applicability is unverified."


def no(c: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(c, F.lit(False))


def known_zone(records: DataFrame) -> DataFrame:
    """Records with null for a time zone that isn't one; done once, as the list of zones is long."""
    return records.withColumn("timezone", F.when(F.col("timezone").isin(ZONES), F.col("timezone")))


def local_day(at: Column, zone: Column) -> Column:
    """Local day of an instant in a known zone; null without one."""
    return F.when(zone.isNotNull(), F.to_date(F.from_utc_timestamp(at, F.coalesce(zone, F.lit("UTC")))))


def past_boundary(value: Column, zone: Column, at: Column) -> Column:
    """A date is past when its local day is over, a zoned time when it is before ``at``; anything else never is."""
    day = value.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return no(F.when(day, value < F.date_format(local_day(at, zone), "yyyy-MM-dd")).when(value.rlike(ZONED), F.try_to_timestamp(value) < at))


def days_until(race_date: Column, zone: Column, at: Column) -> Column:
    """Days from the local day of ``at`` to the race; null where one of them is not known."""
    day = F.substring(race_date, 1, 10)
    return F.datediff(F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(day, "yyyy-MM-dd")), local_day(at, zone))


def crossed_boundary(before: Column, after: Column) -> Column:
    """A material boundary of the row's record lies between two times given as text, so evidence of the first no longer holds."""
    a, b, zone = F.try_to_timestamp(before), F.try_to_timestamp(after), F.col("timezone")
    moved = F.lit(False)
    for name in BOUNDARIES:
        moved = moved | (past_boundary(F.col(name), zone, a) != past_boundary(F.col(name), zone, b))
    then, now = days_until(F.col("race_date"), zone, a), days_until(F.col("race_date"), zone, b)
    near = ((then > IMMINENT_DAYS) & (now <= IMMINENT_DAYS)) | ((then > 0) & (now <= 0))
    return a.isNull() | b.isNull() | no(a > b) | moved | no(near)


def official_ids(registry: DataFrame) -> DataFrame:
    return active_sources(registry).where(F.col("tier") == OFFICIAL).select("edition_id", "source_id", F.lit(True).alias("_o")).distinct()


def official_reports(registry: DataFrame, reports: DataFrame) -> DataFrame:
    """Reports with ``official``: their source is an eligible official source of the edition."""
    return reports.join(official_ids(registry), ["edition_id", "source_id"], "left").withColumn("official", no(F.col("_o"))).drop("_o")


def fact_evidence(records: DataFrame, facts: DataFrame, registry: DataFrame, reports: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each critical fact of a monitored edition: ``edition_id, category_id, field, present, n_effective, status, sources``.

    What a row tells by itself is decided before it travels, so only reports and candidates that can count do, with the columns that count.
    """
    matched = (F.col("source_tier") == OFFICIAL) & (F.col("identity") == "matched") & F.col("extraction").isin("success", "unchanged")
    request = (F.col("request") == "success") | ((F.col("extraction") == "unchanged") & (F.col("request") == "skipped"))
    fresh = F.col("extraction") == "success"
    usable = reports.where(matched).select("edition_id", "source_id", F.when(no(request), F.col("source_url")).alias("_url"), no(request).alias("_asked"), fresh.alias("_fresh"), F.when(~fresh, F.col("fetched_at")).alias("_until"))
    usable = usable.join(official_ids(registry), ["edition_id", "source_id"], "left_semi")
    effective = usable.groupBy("edition_id").agg(F.count_distinct("source_id").alias("n_effective"))
    direct_text = (F.trim("evidence_text") != "") & (F.trim("evidence_locator") != "")
    direct = no((F.col("action") == "no_change") & (F.col("diff") == "UNCHANGED") & direct_text & F.col("value").eqNullSafe(F.col("current_value")))
    entity = F.when(F.col("category_id").isNull(), "Edition").otherwise("Category")
    said = candidates.where((F.col("authority") == "authoritative") & (F.col("target_edition_id") == F.col("edition_id")) & (F.col("entity_type") == entity)).select(
        "edition_id", "source_id", F.coalesce("category_id", F.lit("")).alias("_c"), "field", F.col("event_id").alias("_event"), F.col("value").alias("_value"), direct.alias("_direct"), F.when(direct, F.col("source_url")).alias("_said_url"), F.when(direct, F.col("evidence_verified_at")).alias("_since")
    )
    said = said.join(usable, ["edition_id", "source_id"])
    told = F.col("_direct") & F.col("_asked") & F.col("_said_url").eqNullSafe(F.col("_url"))
    # what neither confirms nor contradicts goes no further; of what contradicts, neither source nor time counts
    said = said.withColumn("_direct", told).where(F.col("_direct") | F.col("_fresh"))
    stale = F.col("_direct") & ~F.col("_fresh")
    said = said.select("edition_id", "_c", "field", "_event", "_value", "_direct", "_fresh", F.when(F.col("_direct"), F.col("source_id")).alias("source_id"), F.when(stale, F.col("_since")).alias("_since"), F.when(stale, F.col("_until")).alias("_until"))
    # many candidates say the same: one row for each thing that a source says; it meets its record, so that facts needn't carry boundaries
    about = known_zone(records.where("monitored")).select("edition_id", F.col("event_id").alias("_event"), "timezone", *BOUNDARIES)
    said = said.distinct().join(about, ["edition_id", "_event"])
    holds = F.col("_fresh") | ((F.coalesce("_since", F.lit("")) != "") & ~crossed_boundary(F.col("_since"), F.col("_until")))
    said = said.select("edition_id", "_c", "field", "_value", "_fresh", F.when(F.col("_direct") & holds, F.col("source_id")).alias("_by")).where(F.col("_fresh") | F.col("_by").isNotNull())
    checked = records.where("monitored").select("edition_id").distinct().join(effective, "edition_id", "left")
    rows = facts.withColumn("_c", F.coalesce("category_id", F.lit(""))).join(checked, "edition_id").join(said, ["edition_id", "_c", "field"], "left")
    same = F.col("_value").eqNullSafe(F.col("value"))
    agrees, contrary = F.col("_by").isNotNull() & same, no(F.col("_fresh") & ~same)
    out = rows.groupBy("edition_id", "_c", "category_id", "field", "value").agg(
        F.max(contrary).alias("_no"), F.max(agrees & F.col("_fresh")).alias("_now"), F.max(agrees).alias("_ever"), F.sort_array(F.collect_set(F.when(agrees, F.col("_by")))).alias("sources"), F.max("n_effective").alias("n_effective")
    )
    present = F.coalesce(~F.col("value").isin("", "null", '""', "[]", '"unknown"'), F.lit(False))
    status = F.when(~present, "UNKNOWN").when(no(F.col("_no")), "NOT_VERIFIED_THIS_RUN").when(no(F.col("_now")), CONFIRMED[0]).when(no(F.col("_ever")), CONFIRMED[1]).otherwise("NOT_VERIFIED_THIS_RUN")
    return out.select("edition_id", "category_id", "field", present.alias("present"), F.coalesce("n_effective", F.lit(0)).alias("n_effective"), status.alias("status"), "sources")


def _ids(condition: Column) -> Column:
    return F.sort_array(F.collect_set(F.when(no(condition), F.col("source_id"))))


def edition_sources(registry: DataFrame, reports: DataFrame) -> DataFrame:
    """One row for each edition that has sources or reports: what its sources are and did, as sorted ids."""
    good = F.col("extraction").isin("success", "unchanged")
    own = active_sources(registry).where(F.col("tier") == OFFICIAL).select("edition_id", "source_id", F.lit(True).alias("_own"), no(F.col("is_primary")).alias("_primary"))
    what = reports.select(
        "edition_id", "source_id", no((F.col("source_tier") == OFFICIAL) & (F.col("identity") == "matched") & good).alias("_effective"), no(F.col("extraction") == "identity_uncertain").alias("_uncertain"), no(good).alias("_auxiliary")
    )
    flags = ("_own", "_primary", "_effective", "_uncertain", "_auxiliary")
    # one shuffle by edition serves both steps; a source's registry rows and reports meet first, so the sets of an edition grow with its sources and not with its reports
    both = own.unionByName(what, allowMissingColumns=True).repartition("edition_id")
    each = both.groupBy("edition_id", "source_id").agg(*[no(F.max(f)).alias(f) for f in flags], F.count_if(F.col("_uncertain")).alias("_n"))
    mine = F.col("_own") & F.col("source_id").isNotNull()
    each = each.withColumns({"_effective": mine & F.col("_effective"), "_uncertain": mine & F.col("_uncertain"), "_auxiliary": ~mine & F.col("_auxiliary"), "_n": F.when(mine, F.col("_n")).otherwise(0)})
    return each.groupBy("edition_id").agg(
        _ids(F.col("_own")).alias("official"), _ids(F.col("_effective")).alias("effective"), _ids(F.col("_own") & F.col("_primary") & ~F.col("_effective")).alias("failed_primary"),
        _ids(F.col("_uncertain")).alias("uncertain"), _ids(F.col("_auxiliary")).alias("auxiliary"), F.sum("_n").alias("n_uncertain"),
    )


def alert_id(edition: Column, reason: Column, fields: Column) -> Column:
    named = F.to_json(F.array(edition, reason))
    whole = F.concat(F.substring(named, F.lit(1), F.length(named) - 1), F.lit(","), F.to_json(fields), F.lit("]"))
    return F.concat(F.lit("va-"), F.substring(F.sha2(whole, 256), 1, 16))


def _alert(when: Column, reason: str, severity: Column | str, fields: Column, trigger: Column | str, evidence: Column, sources: Column, missing: Column | None = None) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    of = {"reason_code": F.lit(reason), "severity": lit(severity), "affected_fields": fields, "trigger_reason": lit(trigger), "available_evidence": evidence, "source_ids": sources}
    of |= {"missing_evidence": F.lit(TEXTS[reason][0]) if missing is None else missing, "human_review_action": F.lit(TEXTS[reason][1])}
    return F.when(no(when), F.struct(*[c.alias(n) for n, c in of.items()]))


def edition_alerts(records: DataFrame, evidence: DataFrame, sources: DataFrame, as_of: str) -> DataFrame:
    """Alerts of monitored editions, from :func:`fact_evidence` and :func:`edition_sources`; ``as_of`` is the run's end as a zoned time."""
    at, zone = F.try_to_timestamp(F.lit(as_of)), F.col("timezone")
    none = F.array().cast("array<string>")
    about_status = F.col("category_id").isNull() & (F.col("field") == "registrationStatus")
    named = F.when(F.col("category_id").isNull(), F.concat(F.lit("Edition."), "field")).otherwise(F.concat(F.lit("Category."), "field", F.lit(":"), "category_id"))
    open_fact = F.col("present") & ~F.col("status").isin(*CONFIRMED) & ((F.col("field") == "raceDate") | F.col("category_id").isNotNull())
    facts = evidence.groupBy("edition_id").agg(F.max(F.when(about_status, F.col("status"))).alias("_status"), F.sort_array(F.collect_set(F.when(open_fact, named))).alias("_open"))
    rows = known_zone(records.where("monitored")).join(facts, "edition_id", "left").join(sources, "edition_id", "left")
    lists = ("official", "effective", "failed_primary", "uncertain", "auxiliary", "_open")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in lists}).withColumns(
        {"_days": days_until(F.col("race_date"), zone, at), "_closed": past_boundary(F.col("registration_close_date"), zone, at), "_drawn": past_boundary(F.col("lottery_result_date"), zone, at)}
    )
    n = lambda c: F.size(c).cast("string")
    near, passed = F.col("_days").between(0, IMMINENT_DAYS), F.col("_closed") | F.col("_drawn")
    unconfirmed = ~F.coalesce(F.col("_status").isin(*CONFIRMED), F.lit(False))
    say = lambda prefix, c: F.transform(c, lambda x: F.concat(F.lit(prefix), x))
    each = lambda *xs: F.array_compact(F.array(*xs))
    status = F.coalesce(F.col("registration_status"), F.lit("undefined"))
    alerts = F.array_compact(
        F.array(
            _alert(F.size("official") == 0, "OFFICIAL_SOURCE_NOT_REGISTERED", "HIGH", F.array(*map(F.lit, GENERAL_FIELDS)), NOT_REGISTERED, none, none),
            _alert(
                (F.size("official") > 0) & (F.size("effective") == 0), "OFFICIAL_SOURCE_UNAVAILABLE", "HIGH", F.array(*map(F.lit, GENERAL_FIELDS)),
                F.concat(F.lit("0/"), n("official"), F.lit(" registered official sources were effectively processed this run.")), say("Auxiliary source processed: ", "auxiliary"), F.col("official"),
            ),
            _alert(
                (F.size("effective") > 0) & (F.size("failed_primary") > 0), "OFFICIAL_SOURCE_DEGRADED", "REVIEW", F.array(F.lit("official_source_health")),
                F.concat(n("failed_primary"), F.lit(" primary official source(s) did not complete effective processing.")), say("Official source processed: ", "effective"), F.col("failed_primary"),
            ),
            _alert(
                F.size("uncertain") > 0, "EDITION_IDENTITY_UNCERTAIN", "REVIEW", F.array(F.lit("edition_identity")),
                F.concat(F.col("n_uncertain").cast("string"), F.lit(" official source(s) were fetched but the target Edition could not be confirmed.")), say("Fetched source: ", "uncertain"), F.col("uncertain"),
            ),
            _alert(
                ~F.col("registration_status").eqNullSafe(F.lit("registration_closed")) & (passed | (no(near) & unconfirmed)), "REGISTRATION_LIFECYCLE_REVIEW",
                F.when(no(F.col("registration_status").isin(*OPEN_LIKE)), "HIGH").otherwise("REVIEW"), F.array(F.lit("registrationStatus")),
                F.when(F.col("_closed"), CLOSE_PASSED).when(F.col("_drawn"), LOTTERY_PASSED).otherwise(NEAR_WITHOUT_STATUS),
                each(
                    F.concat(F.lit("Canonical registrationStatus: "), status), F.when(F.col("_status") == CONFIRMED[0], MATCHES_ONLY),
                    F.when(F.col("_closed"), F.concat(F.lit("Canonical registrationCloseDate: "), "registration_close_date")),
                    F.when(F.col("_drawn"), F.concat(F.lit("Canonical lotteryResultDate: "), "lottery_result_date")),
                ),
                F.col("official"), F.when(passed, TEXTS["REGISTRATION_LIFECYCLE_REVIEW"][0]).otherwise(STATUS_MISSING),
            ),
            _alert(
                near & (F.size("_open") > 0), "CRITICAL_FACT_UNVERIFIED", "REVIEW", F.col("_open"), NEAR_UNVERIFIED,
                F.array(F.concat(F.lit("Canonical raceDate: "), F.coalesce("race_date", F.lit("UNKNOWN")))), F.col("official"),
            ),
        )
    )
    found = rows.select("edition_id", F.explode(alerts).alias("a")).select("edition_id", "a.*")
    return found.withColumn("alert_id", alert_id(F.col("edition_id"), F.col("reason_code"), F.col("affected_fields")))


def signature(alerts: DataFrame) -> DataFrame:
    """Alerts with the hash that tells whether one is new: of all it says but its evidence."""
    parts = F.struct("severity", F.col("reason_code").alias("reason"), F.col("affected_fields").alias("fields"), F.col("source_ids").alias("sourceIds"), F.col("trigger_reason").alias("trigger"), F.col("missing_evidence").alias("missing"))
    return alerts.withColumn("signature", F.sha2(F.to_json(parts), 256))


def attention(previous: DataFrame | None, alerts: DataFrame) -> DataFrame:
    """Alerts with ``is_new``: unknown before or with another signature; without a previous state all are new."""
    signed = signature(alerts)
    if previous is None:
        return signed.withColumn("is_new", F.lit(True))
    old = previous.select("alert_id", F.col("signature").alias("_old"))
    return signed.join(old, "alert_id", "left").withColumn("is_new", ~F.col("_old").eqNullSafe(F.col("signature"))).drop("_old")
