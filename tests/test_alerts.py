"""Alerts and their evidence: each case is an edition of its own, all judged in one run."""

import hashlib
import json

import pytest

from fieldbook.operators import alerts as al

NOW = "2026-10-10T08:00:00.000Z"
RECORD = "event_id string, edition_id string, timezone string, race_date string, end_date string, registration_open_date string, registration_close_date string, lottery_result_date string, registration_status string, monitored boolean"
REGISTRY = "edition_id string, source_id string, tier string, source_type string, status string, is_primary boolean"
REPORT = "edition_id string, source_id string, source_url string, source_tier string, identity string, extraction string, request string, fetched_at string"
CANDIDATE = "edition_id string, source_id string, event_id string, target_edition_id string, category_id string, entity_type string, field string, value string, current_value string, source_url string, action string, diff string, authority string, evidence_text string, evidence_locator string, evidence_verified_at string"
FACT = "edition_id string, category_id string, field string, value string"

BASE = {"timezone": "Asia/Shanghai", "race_date": "2026-12-20", "end_date": None, "registration_open_date": None, "registration_close_date": "2026-09-22", "lottery_result_date": None, "registration_status": "lottery", "monitored": True}
SAID = {"category_id": None, "entity_type": "Edition", "field": "registrationStatus", "value": '"lottery"', "current_value": '"lottery"', "action": "no_change", "diff": "UNCHANGED", "authority": "authoritative", "evidence_text": "The lottery is ongoing.", "evidence_locator": "text", "evidence_verified_at": None}


class Case:
    """An edition with its sources (id: tier, extraction; further report columns) and candidates."""

    def __init__(self, name, sources=(("o", "primary_official", "success"),), said=(), register=None, facts=(), **record):
        self.name = name
        self.record = {**BASE, **record, "event_id": f"event-{name}", "edition_id": name}
        kind = {"primary_official": "category_page", "trusted_structured": "structured_connector"}
        listed = [s[:2] for s in sources] if register is None else register
        self.registry = [(name, s, tier, kind[tier], "active", True) for s, tier in dict(listed).items()]
        self.reports, self.said = [], []
        for s, tier, extraction, *more in sources:
            identity = "uncertain" if extraction == "identity_uncertain" else None if extraction == "fetch_error" else "matched"
            row = {"edition_id": name, "source_id": s, "source_url": f"https://example.test/{s}", "source_tier": tier, "identity": identity, "extraction": extraction, "request": "success" if extraction == "success" else "skipped", "fetched_at": NOW}
            self.reports.append({**row, **(more[0] if more else {})})
        for c in said:
            row = {**SAID, "edition_id": name, "source_id": "o", "event_id": f"event-{name}", "target_edition_id": name, "source_url": "https://example.test/o"}
            self.said.append({**row, **c})
        self.facts = [(name, None, "registrationStatus", json.dumps(self.record["registration_status"])), (name, None, "raceDate", json.dumps(self.record["race_date"])), *((name, *f) for f in facts)]


VARIED = {
    "empty evidence": {"evidence_text": " "}, "empty locator": {"evidence_locator": ""}, "wrong event": {"event_id": "other"}, "wrong edition": {"target_edition_id": "other"},
    "wrong category": {"category_id": "c"}, "wrong field": {"field": "registrationOpenDate"}, "wrong url": {"source_url": "https://example.test/wrong"},
    "wrong value": {"value": '"x"', "current_value": '"lottery"'}, "wrong current value": {"current_value": '"x"'}, "changed": {"diff": "CHANGED"}, "no action": {"action": "pending"}, "advisory": {"authority": "advisory"},
}
O, T = "primary_official", "trusted_structured"
CASES = [
    Case("lottery", [("o", O, "unchanged")]),
    Case("ten-failed", [*((f"o{k}", O, "fetch_error") for k in range(10)), ("aux", T, "unchanged")], registration_status="unknown"),
    Case("uncertain", [("o", O, "identity_uncertain"), ("aux", T, "unchanged")]),
    Case("uncertain-twice", [("o", O, "identity_uncertain"), ("o", O, "identity_uncertain")]),
    Case("not-registered", [], register=[("aux", T)]),
    Case("trusted-says", [("aux", T, "success")], [{"source_id": "aux", "source_url": "https://example.test/aux"}]),
    Case("confirmed", said=[{}, {}]),
    Case("contradicted", said=[{}, {"value": '"registration_closed"', "action": "pending"}]),
    Case("downgraded", [("o", O, "success", {"source_tier": T})], [{}]),
    Case("other-identity", [("o", O, "success", {"identity": "uncertain"})], [{}]),
    *(Case(name.replace(" ", "-"), said=[c]) for name, c in VARIED.items()),
    Case("hash-only", [("o", O, "unchanged")]),
    Case("closed", [("o", O, "unchanged")], registration_status="registration_closed"),
    Case("before-boundary", [("o", O, "unchanged")], registration_close_date="2026-10-20"),
    Case("close-today", registration_close_date="2026-10-10"),
    Case("close-yesterday", registration_close_date="2026-10-09"),
    Case("no-zone", registration_close_date="2026-10-09", timezone=None),
    Case("bad-zone", registration_close_date="2026-10-09", timezone="Nowhere/City"),
    Case("lottery-drawn", registration_close_date=None, lottery_result_date="2026-10-09T10:00:00+08:00"),
    Case("imminent", race_date="2026-10-20", registration_close_date=None, facts=[("c1", "startAt", '"2026-10-20T08:00:00+08:00"'), ("c1", "distanceKm", "null")]),
    Case("imminent-confirmed", race_date="2026-10-24", registration_close_date=None, said=[{}, {"field": "raceDate", "value": '"2026-10-24"', "current_value": '"2026-10-24"'}]),
    Case("fifteen-days", race_date="2026-10-25", registration_close_date=None),
    Case("category-fact", facts=[("c1", "startTimes", '["08:00"]')], said=[{"category_id": "c1", "entity_type": "Category", "field": "startTimes", "value": '["08:00"]', "current_value": '["08:00"]'}]),
    Case("inherited", [("o", O, "unchanged")], [{"evidence_verified_at": "2026-10-01T00:00:00Z"}]),
    Case("inherited-crossed", [("o", O, "unchanged")], [{"evidence_verified_at": "2026-09-20T00:00:00Z"}]),
    Case("inherited-no-time", [("o", O, "unchanged")], [{}]),
    Case("inherited-later", [("o", O, "unchanged")], [{"evidence_verified_at": "2026-10-11T00:00:00Z"}]),
    Case("degraded", [("o", O, "success"), ("p", O, "fetch_error")]),
    Case("over", monitored=False),
]


@pytest.fixture(scope="module")
def judged(spark):
    rows = lambda ddl, dicts: spark.createDataFrame([tuple(d[f.split()[0]] for f in ddl.split(", ")) for d in dicts], ddl)
    records = rows(RECORD, [c.record for c in CASES])
    registry = spark.createDataFrame([r for c in CASES for r in c.registry], REGISTRY)
    reports, candidates = rows(REPORT, [r for c in CASES for r in c.reports]), rows(CANDIDATE, [r for c in CASES for r in c.said])
    facts = spark.createDataFrame([f for c in CASES for f in c.facts], FACT)
    evidence = al.fact_evidence(records, facts, registry, reports, candidates)
    alerts = al.edition_alerts(records, evidence, al.edition_sources(registry, reports), NOW)
    status = {(r["edition_id"], r["category_id"], r["field"]): r for r in evidence.collect()}
    return status, {(r["edition_id"], r["reason_code"]): r for r in alerts.collect()}, alerts


def of(judged, name):
    return {reason for e, reason in judged[1] if e == name}


def status(judged, name, field="registrationStatus", category=None):
    return judged[0][name, category, field]["status"]


def test_lifecycle_review(judged):
    alert = judged[1]["lottery", "REGISTRATION_LIFECYCLE_REVIEW"]
    assert alert["severity"] == "HIGH" and alert["affected_fields"] == ["registrationStatus"] and "official statement" in alert["missing_evidence"] and "do not derive a new status" in alert["human_review_action"]
    assert alert["available_evidence"] == ["Canonical registrationStatus: lottery", "Canonical registrationCloseDate: 2026-09-22"]
    hits = lambda *names: all("REGISTRATION_LIFECYCLE_REVIEW" in of(judged, n) for n in names)
    assert hits("close-yesterday", "lottery-drawn", "imminent") and "lottery result boundary" in judged[1]["lottery-drawn", "REGISTRATION_LIFECYCLE_REVIEW"]["trigger_reason"]
    assert not any(hits(n) for n in ("closed", "before-boundary", "close-today", "no-zone", "bad-zone", "imminent-confirmed", "fifteen-days", "over"))
    kept = judged[1]["confirmed", "REGISTRATION_LIFECYCLE_REVIEW"]  # a confirmed value says nothing about when it was stated
    assert "without time-qualified official status confirmation" in kept["trigger_reason"] and any("post-boundary applicability is unverified" in x for x in kept["available_evidence"])


def test_sources_of_an_edition(judged):
    gone = judged[1]["ten-failed", "OFFICIAL_SOURCE_UNAVAILABLE"]
    assert gone["severity"] == "HIGH" and len(gone["source_ids"]) == 10 and gone["trigger_reason"].startswith("0/10 ") and gone["available_evidence"] == ["Auxiliary source processed: aux"]
    assert status(judged, "ten-failed") == "UNKNOWN" and judged[0]["ten-failed", None, "registrationStatus"]["n_effective"] == 0
    assert judged[1]["uncertain", "EDITION_IDENTITY_UNCERTAIN"]["severity"] == "REVIEW" and status(judged, "uncertain", "raceDate") == "NOT_VERIFIED_THIS_RUN"
    assert judged[1]["uncertain-twice", "EDITION_IDENTITY_UNCERTAIN"]["trigger_reason"].startswith("2 ") and judged[1]["uncertain-twice", "EDITION_IDENTITY_UNCERTAIN"]["source_ids"] == ["o"]
    assert "OFFICIAL_SOURCE_NOT_REGISTERED" in of(judged, "not-registered") and "OFFICIAL_SOURCE_UNAVAILABLE" not in of(judged, "not-registered")
    assert judged[1]["degraded", "OFFICIAL_SOURCE_DEGRADED"]["source_ids"] == ["p"] and of(judged, "over") == set()


def test_direct_evidence(judged):
    assert status(judged, "confirmed") == "VERIFIED_THIS_RUN" and judged[0]["confirmed", None, "registrationStatus"]["sources"] == ["o"] and status(judged, "confirmed", "raceDate") == "NOT_VERIFIED_THIS_RUN"
    assert status(judged, "category-fact", "startTimes", "c1") == "VERIFIED_THIS_RUN"
    for name in ["trusted-says", "contradicted", "downgraded", "other-identity", "hash-only", *(n.replace(" ", "-") for n in VARIED)]:
        assert status(judged, name) == "NOT_VERIFIED_THIS_RUN", name


def test_inherited_evidence_ends_at_a_boundary(judged):
    assert status(judged, "inherited") == "VERIFIED_INHERITED"
    assert all(status(judged, f"inherited-{n}") == "NOT_VERIFIED_THIS_RUN" for n in ("crossed", "no-time", "later"))


def test_imminent_races(judged):
    alert = judged[1]["imminent", "CRITICAL_FACT_UNVERIFIED"]
    assert alert["affected_fields"] == ["Category.startAt:c1", "Edition.raceDate"] and alert["available_evidence"] == ["Canonical raceDate: 2026-10-20"]
    assert status(judged, "imminent", "distanceKm", "c1") == "UNKNOWN"
    assert "CRITICAL_FACT_UNVERIFIED" not in of(judged, "imminent-confirmed") | of(judged, "fifteen-days")


def test_ids_and_attention(judged, spark):
    _, found, alerts = judged
    assert len({r["alert_id"] for r in found.values()}) == len(found)
    one = found["degraded", "OFFICIAL_SOURCE_DEGRADED"]
    text = json.dumps(["degraded", "OFFICIAL_SOURCE_DEGRADED", ["official_source_health"]], separators=(",", ":"))
    assert one["alert_id"] == "va-" + hashlib.sha256(text.encode()).hexdigest()[:16]
    before = al.signature(alerts).where("edition_id <> 'degraded'").selectExpr("alert_id", "if(edition_id = 'lottery', 'x', signature) as signature")
    new = {r["edition_id"] for r in al.attention(before, alerts).where("is_new").collect()}
    assert new == {"degraded", "lottery"} and al.attention(None, alerts).where("not is_new").isEmpty()


def test_few_shuffles(spark):
    """Sources of editions take one shuffle, and facts none after they met what is said about them."""
    empty = lambda ddl: spark.createDataFrame([], ddl)
    registry, reports = empty(REGISTRY), empty(REPORT)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert plan(al.edition_sources(registry, reports)).count("Exchange hashpartitioning(edition_id") == 1
        shuffles = [x for x in plan(al.fact_evidence(empty(RECORD), empty(FACT), registry, reports, empty(CANDIDATE))).split("\n") if "Exchange hashpartitioning" in x]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert shuffles and not any("category_id" in x for x in shuffles)
