"""Gates, change tracking, recommenders, text rules and state on hand-built rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldbook.functions import dates, text
from fieldbook.operators import catalog, cdc, gates, merge, monitor, rank, sets, state


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, shown", [("2026北京马拉松赛", "北京马拉松"), ("【热门】第三届 杭州越野赛", "热门 第三届 杭州越野"), ("第三届 杭州越野赛", "杭州越野"), (None, "unknown"), ("", "unknown"), ("2026 年 宁海越野", "年 宁海越野"), ("2026年宁海越野", "年宁海越野")]
)
def test_display_name(spark, raw, shown):
    assert one(spark, raw, text.display_name) == shown


@pytest.mark.parametrize("raw, key", [("2026 杭州·马拉松赛", "杭州马拉松"), ("ABC（站）Trail 2025", "abctrail")])
def test_dedupe_name(spark, raw, key):
    assert one(spark, raw, text.dedupe_name) == key


@pytest.mark.parametrize("raw, km", [("半程马拉松", 21.1), ("全程马拉松", 42.2), ("10 miles", 16.1), ("50KM", 50.0), ("30k", 30.0), ("", None), (None, None), ("x", None)])
def test_distance(spark, raw, km):
    assert one(spark, raw, text.distance_km) == km


@pytest.mark.parametrize(
    "raw, want", [("2026年3月8日", (2026, 3, "2026-03-08")), ("2026.11", (2026, 11, None)), ("soon 2026", (2026, None, None)), (None, (None, None, None)), ("2026/12/31", (2026, 12, "2026-12-31"))]
)
def test_flexible_date(spark, raw, want):
    y, m, d = text.flexible_date(F.col("c"))
    assert tuple(spark.createDataFrame([(raw,)], "c string").select(y, m, d).first()) == want


def test_status_orders_differ(spark):
    """The connector rules see an open registration where the display rules see a closed one."""
    assert one(spark, "报名截止", text.connector_status) == "registration_open"
    status = lambda c: text.race_status(c, F.lit(None).cast("date"), F.lit(None).cast("int"), "2026-01-01")
    assert one(spark, "报名截止", status) == "closed"
    assert one(spark, None, status) == "unknown"


def test_rounding_and_white_space(spark):
    assert [one(spark, v, text.js_round, "double") for v in (-2.5, 2.5, 0.49)] == [-2, 3, 0]
    assert one(spark, "　a ", text.js_trim) == "a"


def test_urls(spark):
    assert one(spark, "https://x.cn/a?utm_source=q&b=2&a=1#f", text.normalize_url) == "https://x.cn/a?a=1&b=2"
    assert one(spark, "HTTPS://www.X.cn:80/a", text.domain) == "x.cn"
    for url, ok in (("https://example.com/", True), ("http://127.0.0.1/", False), ("http://10.2.3.4/", False), ("http://[::1]/", False), ("ftp://a.b/", False), ("http://u:p@a.b/", False), (None, False), ("http://172.32.0.1/", True)):
        assert one(spark, url, text.public_url) is ok, url


def test_html(spark):
    page = "<html><nav><a href='/x'>menu</a></nav><script>var a='</p>'</script><p>A &amp; B</p>\n\n<!-- c --> C</html>"
    assert one(spark, page, lambda c: text.normalize_lines(text.strip_html(text.remove_noise(c)))) == "A & B C"
    assert one(spark, page, lambda c: F.size(text.links(c))) == 1


def test_ids(spark):
    df = spark.createDataFrame([("ninghai-trail", 2026, " 100 KM|A "), ("Bad Id", 2026, "x"), ("a", 2026, "100")], "e string, y int, k string")
    got = df.select(text.edition_id(F.col("e"), F.col("y")).alias("ed"), "k").select("ed", text.category_id(F.col("ed"), F.col("k")).alias("c")).collect()
    assert [tuple(r) for r in got] == [("ninghai-trail-2026", "ninghai-trail-2026-100-km-a"), (None, None), ("a-2026", None)]


@pytest.mark.parametrize(
    "end, zone, now, done",
    [("2026-09-27", "Asia/Shanghai", "2026-09-27 15:59:59", False), ("2026-09-27", "Asia/Shanghai", "2026-09-27 16:00:00", True), (None, "Asia/Shanghai", "2026-09-25 15:59:59", False), (None, "Asia/Shanghai", "2026-09-25 16:00:00", True),
     (None, "America/Los_Angeles", "2026-09-26 06:59:59", False), (None, "America/Los_Angeles", "2026-09-26 07:00:00", True), (None, "Mars/Base", "2030-01-01 00:00:00", False)],
)
def test_completed_edition(spark, end, zone, now, done):
    df = spark.createDataFrame([("2026-09-25", end, zone, now)], "s string, e string, z string, n string")
    zones = ["Asia/Shanghai", "America/Los_Angeles"]
    c = dates.edition_completed(F.col("s").cast("date"), F.col("e").cast("date"), F.col("z"), F.col("n").cast("timestamp"), zones)
    assert df.select(c.alias("x")).first()["x"] is done


def test_strict_dates(spark):
    assert [one(spark, v, dates.strict_date) for v in ("2026-2-3", "2026-02-30", "2026-02-28", None)] == [None, None, dt.date(2026, 2, 28), None]


def test_course_points(spark):
    rows = [
        ("c", "c-start", 1, "S", "checkpoint", 0.0, "2026-05-01T06:00:00+08:00"), ("c", "c-mid", 2, "M", "water_point", None, None), ("c", "c-ridge", 3, "R", "checkpoint", 20.0, "2026-05-02T01:00:00+08:00"),
        ("c", "c-back", 4, "B", "checkpoint", 15.0, "2026-05-01T23:00:00+08:00"), ("c", "c-back", 5, " ", "tent", 30.0, "2026-05-02"), ("c", "c-cp-6", 6, "X", "finish", 40.0, None),
    ]
    df = spark.createDataFrame(rows, "category_id string, point_id string, display_order int, name string, type string, distance_km double, cutoff_at string")
    got = {r["display_order"]: r["issues"] for r in gates.course_point_issues(df).collect()}
    assert got == {1: [], 2: [], 3: [], 4: ["distance_decreases", "cutoff_backwards"], 5: ["pointId_unique", "name", "type", "cutoff_value"], 6: ["pointId_identity"]}


def gate_rows(spark, **change):
    gate = dict(requested_year=2026, latest_year=2026, latest_source="s1", primary_source="s1", secondary_source=None, date_sources=["s1"], date_evidence="verified", conflict_status="none", publishable=True)
    row = dict(event_id="e", edition_event_id="e", edition_id="e-2026", edition_year=2026, race_date="2026-05-01", end_date=None, city="X", venue=None, primary_category_id="c", category_ids=["c"], source_ids=["s1"],
               active_source_ids=None, gate=gate, latest_source_year=2026, evidence_dates=["2026-05-01"])
    for k, v in change.items():
        if k in gate:
            gate[k] = v
        else:
            row[k] = v
    schema = (
        "event_id string, edition_event_id string, edition_id string, edition_year int, race_date string, end_date string, city string, venue string, primary_category_id string, category_ids array<string>, "
        "source_ids array<string>, active_source_ids array<string>, gate struct<requested_year:int,latest_year:int,latest_source:string,primary_source:string,secondary_source:string,date_sources:array<string>,"
        "date_evidence:string,conflict_status:string,publishable:boolean>, latest_source_year int, evidence_dates array<string>"
    )
    r = gates.publication_gate(spark.createDataFrame([row], schema)).first()
    return r["gate_issues"], r["gate_publishable"]


def test_publication_gate(spark):
    assert gate_rows(spark) == ([], True)
    assert gate_rows(spark, race_date="2026-5-1", evidence_dates=["2026-5-1"]) == (["race_date_invalid", "publishable_status_mismatch"], False)
    assert "requested_official_edition_conflict" in gate_rows(spark, requested_year=2025)[0]
    assert gate_rows(spark, gate=None)[0][0] == "latest_official_source_missing"
    assert "primary_category_missing" in gate_rows(spark, primary_category_id="z")[0]
    assert "registry_source_missing" in gate_rows(spark, active_source_ids=["s9"])[0]


def test_fact_diff_and_risk(spark):
    snap = spark.createDataFrame([("Edition", "a", "registrationStatus", "lottery"), ("Edition", "a", "raceDate", "2026-01-01"), ("Edition", "b", "raceDate", None)], "entity_type string, entity_id string, field string, value string")
    cand = spark.createDataFrame(
        [("Edition", "a", "registrationStatus", "registration_open", "s1", 0.8), ("Edition", "a", "raceDate", "2026-01-02", "s1", 0.9), ("Edition", "a", "raceDate", "2026-01-03", "s2", 0.9), ("Category", "z", "distanceKm", "5", "s1", 0.9)],
        "entity_type string, entity_id string, field string, value string, source_id string, confidence double",
    )
    diff = cdc.fact_diff(snap, cand)
    assert {(r["entity_id"], r["field"]): r["status"] for r in diff.collect()} == {("a", "registrationStatus"): "CHANGED", ("a", "raceDate"): "CONFLICT", ("b", "raceDate"): "NO_CANDIDATE", ("z", "distanceKm"): "MISSING"}
    got = {r["entity_id"] + r["field"]: (r["risk"], r["action"]) for r in cdc.classify(diff, F.lit(True), cdc.abnormal_transition(F.col("old_value"), F.col("new_value"))).collect()}
    assert got == {"aregistrationStatus": ("low", "auto_apply"), "araceDate": ("high_impact", "needs_review"), "zdistanceKm": ("structural", "needs_review")}
    low = cdc.classify(diff.withColumn("confidence", F.lit(0.79)), F.lit(True), F.lit(False)).where("status = 'CHANGED'").first()
    assert low["action"] == "needs_review"


def test_pending_merge_is_idempotent(spark):
    schema = "change_id string, status string, value string, evidence array<string>"
    store = spark.createDataFrame([("1", "pending", "x", ["e1"]), ("2", "approved", "y", ["e1"]), ("3", "pending", "z", ["e1"])], schema)
    new = spark.createDataFrame([("1", "pending", "x", ["e2"]), ("2", "pending", "y", ["e9"]), ("3", "pending", "OTHER", ["e2"]), ("4", "pending", "n", ["e1"])], schema)
    first = cdc.merge_pending(store, new)
    assert {r["change_id"]: (r["outcome"], r["evidence"]) for r in first.collect()} == {"1": ("refreshed", ["e1", "e2"]), "2": ("immutable", ["e1"]), "3": ("collision", ["e1"]), "4": ("new", ["e1"])}
    again = cdc.merge_pending(first.drop("outcome"), new).drop("outcome")
    assert sets.multiset_equal(again, first.drop("outcome"))


def test_transitions_and_apply(spark):
    store = spark.createDataFrame([("1", "pending"), ("2", "applied")], "change_id string, status string")
    steps = spark.createDataFrame([("1", "approved"), ("2", "pending"), ("9", "approved")], "change_id string, to string")
    moved, refused = cdc.transition(store, steps)
    assert dict(moved.collect()) == {"1": "approved", "2": "applied"}
    assert sorted(r["change_id"] for r in refused.collect()) == ["2", "9"]
    snap = spark.createDataFrame([("E", "a", "f", "1"), ("E", "b", "f", "1")], "entity_type string, entity_id string, field string, value string")
    ch = spark.createDataFrame(
        [("c1", "E", "a", "f", "1", "2", 1, "approved"), ("c2", "E", "a", "f", "2", "3", 2, "approved"), ("c3", "E", "b", "f", "0", "9", 1, "approved"), ("c4", "E", "q", "f", "0", "9", 1, "approved"), ("c5", "E", "b", "f", "1", "8", 1, "pending")],
        "change_id string, entity_type string, entity_id string, field string, old_value string, new_value string, seq int, status string",
    )
    after, stale = cdc.apply_changes(snap, ch)
    assert {r["entity_id"]: r["value"] for r in after.collect()} == {"a": "3", "b": "1"}
    assert sorted(r[0] for r in stale.collect()) == ["c3", "c4"]


def test_recommenders(spark):
    races = spark.createDataFrame(
        [("t1", "trail", "east_china", ["TRAIL", "TRAIL"], [(30.0, "L5", True), (60.0, "L9", False)]), ("t2", "utmb", "asia", ["UTMB"], [(30.0, "L5", False)]), ("m", "marathon", "east_china", [], [(42.0, "L5", False)])],
        "id string, type string, region string, tags array<string>, categories array<struct<distanceKm:double,difficultyLevel:string,beginnerFriendly:boolean>>",
    )
    profile = dict(targetRaceType="trail", targetDistance=30, longestCompletedRace="trail_20k", runnerExperience="foundation", regionPreference="east_china", travelScope="nationwide", isFirstTrail=True)
    got = rank.recommend_categories(races, profile).collect()
    assert [(r["id"], r["score"]) for r in got] == [("t1", 25 + 20 + 30 + 15 + 4 + 2)]
    cards = spark.createDataFrame(
        [("a", "trail", [(50.0,)], "intermediate", "east", "http://r", "http://s", "registration_open", "2026-05-01", True, True), ("b", "marathon", [], "unknown", "west", None, None, "unknown", None, False, False)],
        "id string, type string, categories array<struct<distanceKm:double>>, difficulty string, region string, registrationUrl string, sourceUrl string, registrationStatus string, raceDate string, hasDistance boolean, hasElevation boolean",
    )
    p = dict(goal="first_trail", stage="beginner", targetDistance="30_50", region="east", registrationPreference="open")
    assert [(r["id"], r["match_score"]) for r in rank.recommend_cards(cards, p).collect()] == [("a", 30 + 25 + 9 + 10 + 10 + 10)]
    assert one(spark, 0.0, lambda c: rank.distance_points(c, "lte30"), "double") == 10
    assert [one(spark, v, lambda c: rank.distance_points(c, "50_100"), "double") for v in (100.0, 110.0, 30.0, 29.0, 130.0)] == [25, 16, 7, 0, 7]


def test_state(spark):
    keys = ["edition_id", "source_id"]
    st = spark.createDataFrame([("e", "s", "h1", "h1", "d1", "ok"), ("e", "t", "h1", "h0", "d1", "ok")], "edition_id string, source_id string, observed_hash string, success_hash string, checked_at string, fetch_status string")
    res = spark.createDataFrame([("e", "s", "h2", True, False, "d2"), ("e", "t", None, False, False, "d2"), ("e", "u", "h9", True, True, "d2")], "edition_id string, source_id string, hash string, fetched boolean, succeeded boolean, at string")
    got = {r["source_id"]: (r["observed_hash"], r["success_hash"], r["checked_at"], r["fetch_status"]) for r in state.advance(st, res, keys).collect()}
    assert got == {"s": ("h2", "h1", "d2", "ok"), "t": ("h1", "h0", "d2", "failed"), "u": ("h9", "h9", "d2", "ok")}
    seen = spark.createDataFrame([("e", "s", None)], "edition_id string, source_id string, hash string")
    assert state.hash_gate(seen, seen, keys, ["hash"]).count() == 0


def test_alerts_and_references(spark):
    facts = spark.createDataFrame([("e", "raceDate", "2026-01-05", "UNKNOWN", 0, 0, False, False), ("f", "raceDate", "2026-06-01", "INHERITED", 1, 2, True, True)], "edition_id string, field string, race_date string, status string, n_sources int, n_conflicts int, source_failed boolean, expired boolean")
    got = {(r["edition_id"], r["reason"], r["severity"]) for r in monitor.verification_alerts(facts, "2026-01-01").collect()}
    assert got == {("e", "no_source", "high"), ("e", "never_verified", "high"), ("f", "source_conflict", "high"), ("f", "source_unreachable", "low"), ("f", "evidence_expired", "medium")}
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="no row for k"):
        sets.required_reference(a, a.where("k = 2").withColumnRenamed("v", "w"), "k").collect()


def test_facets_and_conflicts(spark):
    df = spark.createDataFrame([("trail", 1), ("ultra_trail", 2), ("road", 3)], "type string, n int")
    widen = {"type": {"trail": ("ultra_trail",)}}
    assert catalog.facet_filter(df, {"type": "trail"}, widen).count() == 2
    assert catalog.facet_filter(df, {"type": "ultra_trail", "n": "all"}, widen).count() == 1
    rows = spark.createDataFrame([("k", "a", ""), ("k", "b", "1"), ("k", "c", None)], "k string, s string, v string")
    assert merge.conflicts(rows, ["k"], "v", "s").count() == 0
