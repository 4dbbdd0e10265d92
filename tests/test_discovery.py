"""Source candidates, category documents, field matrices, stays and pending rows."""

import json

import pytest
from pyspark.sql import functions as F

from fieldbook.operators import cdc, publication
from fieldbook.operators import discovery as d


def test_cms_candidates(spark):
    rec = lambda i, title, tag, url: {"id": i, "title": title, "tag": tag, "url": url}
    body = json.dumps([rec("1", "2026湖滨马拉松公告", "2026", "https://www.lake.cn/a/#x"), rec("2", "重复", "2026", "https://www.lake.cn/a"), rec("3", "旧闻 2025", "2026", "https://www.lake.cn/b"), rec("4", "旧", "2025", "https://www.lake.cn/c"), rec("5", "湖滨 10 公里", "2026", "https://www.lake.cn/d"),
                       rec("6", "其他", "2026", "https://other.cn/e?b=1&a=2"), rec("7", "坏", "2026", "ftp://x"), rec("", "无", "2026", "https://x.cn"), rec("9", None, "2026", "https://y.cn")])
    df = spark.createDataFrame([(body,), ("not json",), (None,)], "body string")
    got = {r["normalized_url"]: r for r in d.cms_candidates(df, "lake-2026", 2026, "湖滨马拉松|湖马", "lake.cn", r"10\s*(?:公里|km)").collect()}
    assert set(got) == {"https://www.lake.cn/a", "https://other.cn/e?a=2&b=1"}
    a, b = got["https://www.lake.cn/a"], got["https://other.cn/e?a=2&b=1"]
    assert (a["title"], a["event_status"], a["edition_status"], a["authority"]) == ("2026湖滨马拉松公告", "title_match", "title_year_match", "official_site_unapproved") and a["candidate_id"].startswith("sc-") and len(a["candidate_id"]) == 23
    assert (b["event_status"], b["edition_status"], b["authority"]) == ("needs_review", "cms_tag_only_needs_review", "external_link_unverified")


def test_category_documents(spark):
    good = {"id": 5, "name": "C-60", "distance": 60.5, "elevationGain": 3000, "startPoint": "A", "endPoint": None, "buttons": [{"linkUrl": "http://x/t.gpx"}, {"linkUrl": "https://x/t.gpx?v=1"}]}
    wrap = lambda code=0, **more: json.dumps({"code": code, "data": good | more})
    cases = [(wrap(), None), (wrap(1), "envelope"), ("x", "envelope"), (wrap(id=6), "identity"), (wrap(name="Z"), "identity"), (wrap(distance=0), "facts"), (wrap(elevationGain=-1), "facts"), (wrap(buttons=[]), "track_link"), (wrap(buttons=None), "facts")]
    df = spark.createDataFrame([(f"https://n.cn/get?id=5&k={i}", b) for i, (b, _) in enumerate(cases)] + [("https://n.cn/get?id=99", wrap())], "url string, body string")
    got = {r["url"]: r for r in d.category_documents(df, {5: "C-60"}).collect()}
    assert [got[f"https://n.cn/get?id=5&k={i}"]["error"] for i in range(len(cases))] == [e for _, e in cases] and got["https://n.cn/get?id=99"]["error"] == "identity"
    one = got["https://n.cn/get?id=5&k=0"]
    assert (one["distanceKm"], one["startLocation"], one["finishLocation"], one["track_url"]) == (60.5, "A", None, "https://x/t.gpx?v=1") and got["https://n.cn/get?id=5&k=1"]["distanceKm"] is None


def test_field_matrix(spark):
    known = spark.createDataFrame([("c1", "G1", {"elevationGain": ["3000", "2900"]}, "60", "3000", "A", None), ("c2", "G2", None, "25", None, None, None), ("c3", "G3", None, "1", "1", "1", "1")], "category_id string, group string, conflicts map<string,array<string>>, distanceKm string, elevationGain string, startLocation string, finishLocation string")
    found = spark.createDataFrame([("G1", "linked_asset", "60.5", "3000", "A", "B"), ("G3", "year_conflict", "1", "1", "1", None)], "group string, identity string, distanceKm string, elevationGain string, startLocation string, finishLocation string")
    got = {(r["category_id"], r["field"]): r["action"] for r in d.field_matrix(known, found).collect()}
    assert [got["c1", f] for f in ("distanceKm", "elevationGain", "startLocation", "finishLocation")] == ["ACTUAL_COURSE_DISTANCE_ONLY", "CONFLICT_NEEDS_REVIEW", "NO_CHANGE_VERIFIED", "FACT_CANDIDATE"]
    assert {v for k, v in got.items() if k[0] == "c2"} == {"FETCH_OR_EXTRACTION_BLOCKED"} and {v for k, v in got.items() if k[0] == "c3"} == {"VERIFICATION_ALERT"} and len(got) == 12


def test_share_and_stay(spark):
    df = spark.createDataFrame([("湖马", "lake 2026", "https://x.cn/races/lake/2026/cover.webp?v=1", None), ("山", "h", "a.webp", "b.JPG?x"), ("无", "n", None, "c.gif")], "name string, id string, a string, b string")
    got = [r[0] for r in df.select(d.share_card(*[F.col(c) for c in ("name", "id", "a", "b")])).collect()]
    assert [r["image_url"] for r in got] == ["https://x.cn/races/lake/2026/share-cover-5x4.jpg", "b.JPG?x", None] and got[0]["query"] == "editionId=lake%202026&source=share" and got[0]["title"] == "湖马｜下一场参赛指南"
    pages = spark.createDataFrame([("p1", "e1", None, None, None, None, [("balance", "城东", "u", "r", "a")]), ("p2", "e2", None, "杭州", None, None, []), ("p3", "e3", None, None, None, None, [])], "id string, event_id string, venue string, city string, district string, province string, areas array<struct<kind string, name string, url string, reason string, advantage string>>")
    areas = {r["id"]: r["areas"] for r in d.stay_areas(pages).collect()}
    assert [a["id"] for a in areas["p1"]] == ["balance-0"] and areas["p1"][0]["label"] == "综合优先" and "provider=ctrip" in areas["p1"][0]["link"] and len(areas["p2"]) == 3 and "eventId=p2" in areas["p2"][0]["link"] and areas["p3"] == []
    listed = spark.createDataFrame([("e1", "balance", "https://c/1", 2), ("e1", "balance", "https://c/0", 1)], "event_id string, kind string, url string, ord int")
    asks = spark.createDataFrame([("e1", "balance", "ctrip"), ("e1", "balance", "other"), ("e1", "distance", "ctrip"), ("zz", "balance", "ctrip"), (None, None, None)], "event_id string, kind string, provider string")
    assert sorted(r["target"] for r in d.stay_redirects(asks, listed).collect()) == ["/races"] * 4 + ["https://c/0"]


EVIDENCE = "array<struct<source_id string, source_url string, evidence_text string, evidence_locator string, confidence double, fetched_at string, content_hash string, extraction_method string>>"


def test_pending_rows(spark):
    ev = ("s", "u", "t", "l", 0.9, "f", "h", "m")
    schema = f"change_id string, event_id string, edition_id string, category_id string, entity_type string, field string, old_value string, new_value string, conflict boolean, risk string, reason string, evidence {EVIDENCE}"
    rows = [("c1", "e", "e-1", None, "Edition", "raceDate", "a", "b", False, "high", "r", [ev, ev]), ("c2", "e", "e-1", None, "Edition", "city", None, "x", True, "low", "r", [ev])]
    df = spark.createDataFrame(rows, schema)
    got = {r["change_id"]: r for r in cdc.pending_rows(df, "now").collect()}
    assert (got["c1"]["candidate_value"], got["c1"]["source_id"], got["c1"]["status"], got["c2"]["candidate_value"]) == ("b", "s", "pending", None)
    back = cdc.change_rows(cdc.pending_rows(df.where("change_id = 'c1'"), "now")).first()
    assert (back["old_value"], back["new_value"], back["source_ids"], back["detected_at"]) == ("a", "b", ["s", "s"], "now")
    with pytest.raises(Exception, match="without a value"):
        cdc.change_rows(cdc.pending_rows(df, "now")).collect()
    with pytest.raises(Exception, match="without evidence"):
        cdc.pending_rows(df.withColumn("evidence", F.slice("evidence", 1, 0)), "now").collect()


def test_same_fact(spark):
    cols = "change_id string, entity_type string, entity_id string, field string, old_value string, new_value string, conflict boolean, evidence_hash string"
    stored = spark.createDataFrame([("a", "E", "1", "f", None, "v", False, "h1", "pending"), ("b", "E", "1", "f", None, "v", False, "h2", "rejected"), ("c", "E", "2", "f", "o", "v", True, "h3", "pending"), ("d", "E", "3", "f", "o", "v", False, "h4", "applied")], cols + ", status string")
    new = spark.createDataFrame([("x", "E", "1", "f", None, "v", False, "h2"), ("y", "E", "1", "f", None, "v", False, "h9"), ("z", "E", "2", "f", "q", None, True, "h9"), ("w", "E", "3", "f", "o", "v", False, "h5"), ("d", "E", "9", "f", None, "v", False, "h")], cols)
    assert {r["incoming_id"]: r["change_id"] for r in cdc.same_fact(stored, new).collect()} == {"x": "b", "y": "a", "z": "c", "d": "d"}


def test_fact_rows(spark):
    schema = "c struct<distance_km double, elevation_gain double, elevation_loss double, cutoff_time_hours double, start_at string, start_location string, finish_location string>"
    df = spark.createDataFrame([((42.195, 1200.0, None, 6.0, "2026-05-03T07:30:00+08:00", "广场", "广场"),), ((None, None, None, None, None, "A", "B"),)], schema)
    a, b = (r[0] for r in df.select(publication.fact_rows(F.col("c"))).collect())
    assert [(x["key"], x["value"]) for x in a] == [("distance", "42.195 km"), ("elevationGain", "1,200 m"), ("cutoff", "6 h"), ("startAt", "2026.05.03 07:30"), ("startFinish", "广场")] and [x["key"] for x in b] == ["start", "finish"]
