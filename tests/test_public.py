"""Public views, shown texts, normalizers and the source registry on hand-built rows."""

import json

import pytest
from pyspark.sql import functions as F

from fieldbook.functions import display as d
from fieldbook.functions import text
from fieldbook.operators import normalize as n
from fieldbook.operators import publication as p
from fieldbook.operators import registry as r

GOV = "struct<verified boolean, verification_status string, internal_flags array<string>, missing_fields array<string>, field_sources map<string,string>, merge_trace array<struct<field string, selected_source string, n_candidates int>>, sources array<struct<source_type string, raw_data map<string,string>>>>"
POINT = "struct<point_id string, display_order int, name string, type string, distance_km double, cutoff_at string>"
CATEGORY = f"struct<category_id string, edition_id string, category_name string, short_name string, distance_km double, elevation_gain double, elevation_loss double, cutoff_time_hours double, start_at string, start_location string, finish_location string, registration_url string, display_order int, course_points array<{POINT}>, course_point_data_status string, updated_at string, governance {GOV}>"
EDITION = f"struct<edition_id string, event_id string, edition_name string, race_date string, end_date string, cover_image string, hero_image string, primary_category_id string, country string, province string, city string, district string, venue string, registration_status string, registration_url string, lifecycle_status string, updated_at string, governance {GOV}>"
RECORD = f"event struct<event_id string, event_type string, lifecycle_status string, updated_at string, governance {GOV}>, edition {EDITION}, categories array<{CATEGORY}>"
GOOD = {"verified": True, "verification_status": "verified", "internal_flags": None, "missing_fields": None, "field_sources": None, "merge_trace": None, "sources": []}


def category(key="full", edition="lake-2026", **more):
    base = {"category_id": f"{edition}-{key}", "edition_id": edition, "category_name": key, "short_name": None, "distance_km": 42.2, "elevation_gain": None, "elevation_loss": None, "cutoff_time_hours": 6.0, "start_at": None,
            "start_location": "A", "finish_location": "B", "registration_url": None, "display_order": 1, "course_points": None, "course_point_data_status": None, "updated_at": "2026-01-02", "governance": GOOD}
    return base | more


def record(edition="lake-2026", categories=None, event=None, **more):
    base = {"edition_id": edition, "event_id": edition[:-5], "edition_name": "Lake", "race_date": "2026-05-03", "end_date": None, "cover_image": "c", "hero_image": None, "primary_category_id": f"{edition}-full", "country": "中国", "province": "浙江省",
            "city": "杭州市", "district": None, "venue": "浙江省杭州市湖滨公园", "registration_status": "unknown", "registration_url": None, "lifecycle_status": "active", "updated_at": "2026-01-01", "governance": GOOD}
    return ({"event_id": edition[:-5], "event_type": "marathon", "lifecycle_status": "active", "updated_at": "2026-01-03", "governance": GOOD} | (event or {}), base | more, [category(edition=edition)] if categories is None else categories)


def shown(spark, *records, gate=True):
    df = spark.createDataFrame(list(records), RECORD)
    return p.publishable_details(df, df.select("edition.edition_id", F.lit(gate).alias("gate_publishable")))


def test_edition_conditions(spark):
    bad = GOOD | {"verified": False}
    cases = {
        "a-2026": {}, "b-2026": {"race_date": None}, "c-2026": {"race_date": "2026-02-30"}, "d-2026": {"end_date": "2026-05-02"}, "e-2026": {"end_date": "2026-05-04"}, "f-2026": {"race_date": None, "end_date": "2026-05-04"},
        "g-2026": {"lifecycle_status": "draft"}, "h-2026": {"edition_name": " "}, "i-2026": {"event_id": "other"}, "j-2026": {"governance": bad}, "k-2026": {"primary_category_id": "x"}, "l-2026": {"primary_category_id": None, "categories": []},
        "m-2026": {"event": {"lifecycle_status": "retired"}}, "n-2026": {"event": {"governance": GOOD | {"internal_flags": ["test_only"]}}}, "o-2026": {"governance": GOOD | {"verification_status": "auto_verified", "internal_flags": ["other"]}},
    }
    got = {x["edition_id"] for x in shown(spark, *(record(k, **v) for k, v in cases.items())).collect()}
    assert got == {"a-2026", "b-2026", "e-2026", "l-2026", "o-2026"}
    assert shown(spark, record(), gate=False).count() == 0


def test_editions_are_judged_in_their_own_rows(spark):
    """Categories were taken apart, joined and collected again with all their governance; two rows of one id got each other's categories."""
    point = lambda at, km: (f"lake-2026-late-{at}", {"a": 1, "b": 2}[at], at, "aid", km, None)
    late = category("late", display_order=3, course_points=[point("a", 9.0), point("b", 5.0)], course_point_data_status="partial")
    fine = category("fine", display_order=2)
    out = shown(spark, record(categories=[category(), late, fine]))
    assert [c["category_id"] for c in out.first()["categories"]] == ["lake-2026-full", "lake-2026-fine"]
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    twice = shown(spark, record(), record(categories=[category(), fine])).collect()
    assert sorted(len(x["categories"]) for x in twice) == [1, 1, 2, 2]  # the gate has two rows too


def conflict(**more):
    g = {"verified": False, "verification_status": "pending", "internal_flags": ["elevation_conflict_needs_review"], "missing_fields": ["elevationGain"], "field_sources": {"distanceKm": "official", "cutoffTimeHours": "official"},
         "merge_trace": [{"field": "elevationGain", "selected_source": "placeholder", "n_candidates": 2}], "sources": [{"source_type": "official", "raw_data": {"startLocation": "A", "finishLocation": "B"}}]}
    return g | more


def test_localized_conflict(spark):
    cases = [
        ({}, {}, True), ({"distance_km": None}, {}, False), ({"elevation_gain": 900.0}, {}, False), ({"start_location": "Z"}, {}, False), ({}, {"internal_flags": []}, False), ({}, {"internal_flags": ["x_conflict_needs_review", "test_only"]}, False),
        ({}, {"missing_fields": []}, False), ({}, {"merge_trace": []}, False), ({}, {"merge_trace": [{"field": "distanceKm", "selected_source": "placeholder", "n_candidates": 2}], "missing_fields": ["distanceKm"]}, False),
        ({}, {"field_sources": {"distanceKm": "media", "cutoffTimeHours": "official"}}, False), ({}, {"sources": []}, False), ({}, {"verification_status": "rejected"}, False),
    ]
    rows = [record(f"r{k}-2026", [category(edition=f"r{k}-2026", governance=conflict(**g), **c)]) for k, (c, g, _) in enumerate(cases)]
    got = {x["edition_id"] for x in shown(spark, *rows).collect()}
    assert [f"r{k}-2026" in got for k in range(len(cases))] == [c[2] for c in cases]


def test_course_points_gate_categories(spark):
    point = lambda key, order, km, cut: {"point_id": f"lake-2026-full-{key}", "display_order": order, "name": key, "type": "checkpoint", "distance_km": km, "cutoff_at": cut}
    a, b = point("lakeside", 1, 10.0, "2026-05-03T09:00:00+08:00"), point("bridge", 2, 20.0, "2026-05-03T11:00:00+08:00")
    cases = [([a, b], "available", True), ([b, a], "available", True), ([a, b | {"distance_km": 5.0}], "partial", False), ([a, b | {"cutoff_at": None}], "available", False), ([a, b | {"cutoff_at": None}], "partial", True), ([a], None, False),
             ([], "available", False), (None, "not_published", True), ([a, b | {"display_order": 1}], "partial", False), ([a | {"point_id": "x"}], "partial", False)]
    for points, status, want in cases:
        got = shown(spark, record(categories=[category(course_points=points, course_point_data_status=status)])).collect()
        assert (len(got) == 1) is want, (points, status)
    detail = shown(spark, record(categories=[category(course_points=[b, a], course_point_data_status="available"), category("half", display_order=0)])).first()
    assert [c["category_id"] for c in detail["categories"]] == ["lake-2026-half", "lake-2026-full"] and [c["is_primary_category"] for c in detail["categories"]] == [False, True]
    assert [x["display_order"] for x in detail["categories"][1]["course_points"]] == [1, 2]


def test_list_detail_and_views(spark):
    rows = [record("b-2026", race_date="2026-09-01"), record("c-2026", race_date=None), record("a-2026", race_date="2026-09-01", end_date="2026-09-02")]
    details = shown(spark, *rows)
    assert [x["edition_id"] for x in p.public_list(details).collect()] == ["a-2026", "b-2026", "c-2026"]
    assert not set(p.DETAIL_ONLY) & set(p.public_list(details).columns)
    assert tuple(p.public_detail(details, "b-2026").select("status", "race.edition_id").first()) == (200, "b-2026")
    assert tuple(p.public_detail(details, "zz").select("status", "race.edition_id").first()) == (404, None)
    assert p.data_updated_at("2026-01-01", spark.createDataFrame(rows, RECORD)).first()[0] == "2026-01-03" and p.data_updated_at("2027", spark.createDataFrame(rows, RECORD)).first()[0] == "2027"
    ld = json.loads(p.json_ld(details).where("edition_id = 'a-2026'").first()["json_ld"])
    assert ld["startDate"] == "2026-09-01" and ld["endDate"] == "2026-09-02" and "url" not in ld and ld["location"]["address"]["addressLocality"] == "杭州市"
    assert details.where("edition_id = 'a-2026'").select("date_display", "location_display").first()[:] == ("9月1–2日", "浙江省 · 杭州市 · 湖滨公园")
    races = spark.createDataFrame([("x", "2026-05-01", None), ("y", "2026-04-30", "2026-05-02"), ("z", None, None), ("w", "2026-05-01", "bad")], "edition_id string, race_date string, end_date string")
    assert [x[0] for x in p.upcoming(races, "2026-05-02").collect()] == ["y", "z"]


def test_shown_place_for_one_category(spark):
    key, column, official, shown_as = p.SHOWN_PLACES[0]
    edition = key.rsplit("-", 1)[0]
    cat = category(key.rsplit("-", 1)[1], edition=edition, start_location=official)
    got = shown(spark, record(edition, [cat], primary_category_id=key), record("lake-2026", [category(start_location=official)])).collect()
    assert {x["edition_id"]: x["categories"][0][column] for x in got} == {edition: shown_as, "lake-2026": official}


def test_editorial(spark):
    details = shown(spark, record(), record("hill-2026"))
    words = "struct<title string, paragraphs array<struct<text string>>>"
    schema = f"event_id string, c struct<impression {words}, viewpoint {words}, evidence struct<sections array<struct<title string, paragraphs array<string>, emphasis string>>>, suitability struct<title string, introduction string, items array<{words}>>, transition string>, s struct<category_id string, eyebrow string, title string, scope_note string, sections array<struct<number string, title string, paragraphs array<struct<text string, emphasis boolean>>>>, closing string>"
    block = ("T", [("p1",), ("p2",)])
    guide = (block, block, ([("S", ["x"], "")],), ("F", "", []), None)
    content = spark.createDataFrame([("lake", guide, ("lake-2026-full", "e", "t", "n", [("1", "i", [("a", True), ("b", None)])], None)), ("hill", None, ("other", "e", "t", "n", [], None))], schema)
    content = content.select("event_id", p.public_guide(F.col("c")).alias("guide"), p.public_strategy(F.col("s")).alias("strategy"))
    rooms = spark.createDataFrame([("lake-2026", (2, "h2")), ("lake-2026", (1, "h1"))], "edition_id string, recommendation struct<display_order int, hotel string>")
    got = {x["edition_id"]: x for x in p.with_editorial(details, content, rooms).collect()}
    lake, hill = got["lake-2026"], got["hill-2026"]
    assert lake["race_guide"]["opening"]["body"] == ["p1", "p2"] and lake["race_guide"]["runner_fit"] is None and lake["race_guide"]["experiences"][0]["conclusion"] is None
    assert [x["emphasis"] for x in lake["race_strategy"]["items"][0]["paragraphs"]] == [True, False] and [x["hotel"] for x in lake["accommodation_recommendations"]] == ["h1", "h2"]
    assert hill["race_guide"] is None and hill["race_strategy"] is None and hill["accommodation_recommendations"] == []


def values(spark, column, kind, cases):
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], f"k int, c {kind}")
    return [x[0] for x in df.orderBy("k").select(column(F.col("c"))).collect()]


def test_shown_texts(spark):
    assert values(spark, d.grouped_number, "double", [1234567.0, 999.0, 1234.5, None]) == ["1,234,567", "999", "1,234.5", None]
    assert values(spark, d.distances_text, "array<double>", [[42.195, 21.0, 21.0, None, 0.0], []]) == ["42.2KM / 21KM", "距离待更新"]
    assert values(spark, d.elevations_text, "array<double>", [[1200.0, 800.0], [None]]) == ["1200m / 800m", "爬升待更新"]
    assert values(spark, d.price_text, "array<double>", [[100.0, 300.0], [100.0, None], [0.0]]) == ["¥100 - ¥300", "¥100", "报名信息待更新"]
    assert values(spark, lambda c: F.struct(*[x.alias(k) for x, k in zip(d.fee_lines(c), "ms")]), "array<double>", [[300.0, 100.0], [None, None, None], []]) == [("¥100 起", "2 个组别"), ("3 个组别", ""), ("报名信息待更新", "")]
    assert values(spark, d.start_text, "string", ["2026-05-03T07:30:00+08:00", "2026-05-03 07:30", "2026-05-03", "soon"]) == ["2026.05.03 07:30", "2026.05.03 07:30", "2026.05.03", "soon"]
    assert values(spark, d.start_times_text, "array<string>", [["2026-05-03T07:30", "2026-05-03T08:00"], ["2026-05-03T07:30", "2026-05-04T08:00"], ["a", "2026-05-03T07:30"]]) == ["2026.05.03 07:30 / 08:00 分枪", "2026.05.03 07:30 / 2026.05.04 08:00 分枪", "a / 2026-05-03T07:30 分枪"]
    two = lambda f: lambda c: f(c["a"], c["b"])
    pair = "struct<a string, b string>"
    dates = [("2026-05-03", None), ("2026-05-03", "2026-05-03"), ("2026-05-03", "2026-05-04"), ("2026-05-30", "2026-06-01"), ("2026-12-31", "2027-01-01"), (None, None), ("x", None), ("2026-05-03", "x")]
    assert values(spark, two(d.date_range_text), pair, dates) == ["5月3日", "5月3日", "5月3–4日", "5月30日–6月1日", "2026年12月31日–2027年1月1日", "日期待公布", "x", "2026-05-03"]
    assert values(spark, two(d.list_date_text), pair, dates) == ["2026.05.03 周日", "2026.05.03 周日", "2026.05.03–05.04", "2026.05.30–06.01", "2026.12.31–2027.01.01", "日期待公布", "日期待公布", "2026.05.03 周日"]
    assert values(spark, two(lambda a, b: d.card_date_text(a, b.cast("int"))), pair, [("2026-05-03", "2026"), (None, "2026"), (None, None), ("soon", None)]) == ["2026.05.03 周日", "2026年，日期待更新", "比赛日期待更新", "soon"]
    assert values(spark, two(d.call_to_action), pair, [("u", "o"), ("", "o"), (None, None)]) == [("去报名", "u", False), ("查看官网", "o", False), ("信息待更新", None, True)]
    tags = values(spark, lambda c: d.core_tags(c, ["x"], ["b", "a"], F.lit("new"), F.lit("view")), "array<string>", [["x", "q", "a", "b", "r", "s"], ["new"]])
    assert tags == [["new", "a", "b", "q", "r"], ["new", "view"]]


@pytest.mark.parametrize(
    "place, want",
    [
        (("中国", "上海市", "上海", "黄浦区", "上海市黄浦区外滩"), "上海市 · 黄浦区 · 外滩"), (("中国", None, None, None, None), "中国"), (("中国", "浙江", "杭州市", "", "中国·浙江·杭州市"), "浙江 · 杭州市"),
        (("中国", "四川", "甘孜州", "泸定县", "磨西镇"), "四川 · 甘孜州 · 泸定县 · 磨西镇"), ((None, None, None, None, "  广场 "), "广场"), ((None, "香港特别行政区", "香港", None, "香港"), "香港特别行政区"),
    ],
)
def test_location(spark, place, want):
    df = spark.createDataFrame([place], "a string, b string, c string, d string, e string")
    assert df.select(d.location_text(*[F.col(x) for x in "abcde"])).first()[0] == want


RAW = "source string, raw_id string, source_url string, raw_name string, raw_date string, raw_province string, raw_city string, raw_location string, raw_distance string, raw_elevation_gain string, raw_difficulty string, raw_type string, raw_tags array<string>, raw_registration_status string, raw_official_url string, raw_registration_url string"


def test_normalized_races(spark):
    rows = [
        ("runchina", "7", "u", "2026杭州马拉松赛", "2026年11月1日", None, None, "浙江省杭州市", None, None, None, None, None, "报名中", "o", "r"),
        ("zuicool", None, "u", "莫干山越野挑战", "2026.10", "浙江", "湖州", None, "55km", "D+2600", None, None, ["trail"], None, None, None),
        ("itra", "x", "u", None, None, None, None, "Chamonix France", None, None, None, None, None, None, None, ""),
        ("zuicool", "9", None, "第二届 上海半程马拉松", "2025-03-01", None, "", None, None, None, None, None, None, None, None, None),
    ]
    got = n.normalized_races(spark.createDataFrame(rows, RAW), "2026-06-30").collect()
    a, b, c, e = got
    assert (a["name"], a["type"], a["status"], a["year"], a["month"], a["date"]) == ("杭州马拉松", "marathon", "registration_open", 2026, 11, "2026-11-01")
    assert (a["province"], a["city"], a["region"], a["country"], a["confidence"], a["data_quality"], a["verified"]) == ("浙江", "浙江省杭州", "east_china", "中国", 100, "partially_verified", True)
    assert a["categories"][0]["name"] == "全程马拉松" and a["missing_fields"] == ["elevationGain"] and a["field_sources"]["elevationGain"] == "placeholder" and a["field_sources"]["city"] == "runchina"
    assert a["slug"].startswith("2026-7-") or "-" in a["slug"]
    assert (b["type"], b["status"], b["date"], b["city"], b["confidence"]) == ("trail", "upcoming", None, "湖州", 50) and b["categories"][0]["name"] == "55KM" and b["categories"][0]["elevation_gain"] == 2600
    assert (c["name"], c["province"], c["region"], c["country"], c["data_quality"]) == ("unknown", "unknown", "europe", "unknown", "placeholder") and "missing rawName; used placeholder name" in c["notes"]
    assert (e["name"], e["province"], e["city"], e["status"], e["type"]) == ("上海半程马拉松", "上海", "上海", "finished", "half_marathon") and e["categories"][0]["name"] == "半程马拉松"


def test_connector_records(spark):
    fields = {"name": " 2026湖滨·马拉松赛 ", "raceDate": "2026-11-01", "province": "浙江", "city": " ", "statusText": "点此报名", "registrationUrl": "u", "categories": [{"categoryName": "全马", "distanceKm": "42.2", "registrationFee": "x", "categoryFee": 150}]}
    df = spark.createDataFrame([("runchina", "1", "s", "high", ["w"] * 5, json.dumps(fields)), ("zuicool", "2", "s", "low", None, "{}"), ("zuicool", "3", "s", "low", [], None)], "source_id string, raw_id string, source_url string, data_quality string, warnings array<string>, fields string")
    a, b, c = n.connector_records(df).collect()
    assert (a["id"], a["original_name"], a["canonical_name_candidate"], a["normalized_name"], a["edition_year"], a["registration_status"]) == ("runchina-1", "2026湖滨·马拉松赛", "湖滨·马拉松", "湖滨马拉松", 2026, "registration_open")
    assert a["categories"][0]["distance_km"] == 42.2 and a["categories"][0]["registration_fee"] == 150 and a["missing_fields"] == ["city"] and a["confidence"] == pytest.approx(0.84)
    assert set(a["field_sources"]) == {*fields, "rawId", "sourceUrl"} and b["confidence"] == c["confidence"] == 0.68
    assert b["missing_fields"] == ["originalName", "canonicalNameCandidate", "editionYear", "raceDate", "province", "city", "registrationStatus", "registrationUrl", "categories"]


def test_scraped_texts(spark):
    likely = lambda s: lambda c: n.likely_race(c, s)
    assert values(spark, likely("runchina"), "string", ["2026杭州马拉松", "马拉松平台", "2026", None, ""]) == [True, False, False, False, False]
    assert values(spark, likely("zuicool"), "string", [" 更多 ", "100 km 挑战", "训练营 跑", "湖滨"]) == [False, True, False, False]
    assert values(spark, likely("itra"), "string", ["Race Calendar", "Alpine Trail", "about trail", "100k"]) == [False, True, False, True]
    assert values(spark, n.clean_title, "string", ["湖滨马拉松报名- 最酷ZUICOOL 页", "  a   b ", ""]) == ["湖滨马拉松", "a b", None]
    assert values(spark, n.category_names, "string", ['["a", "b"]', "全马、半马，10km/亲子", "7", '"x"', "[bad", "", None]) == [["a", "b"], ["全马", "半马", "10km", "亲子"], ["7"], ['"x"'], ["[bad"], [], []]
    where = lambda c: F.struct(*[x.alias(f"p{k}") for k, x in enumerate(n.date_location(c))])
    assert values(spark, where, "string", ["2026.5.3 · 浙江 杭州 西湖 湖滨 公园", "2026.5", None]) == [("2026-05-03", "浙江", "杭州", "西湖", "湖滨 公园"), (None, None, None, None, None), (None, None, None, None, None)]
    kinds = {k: values(spark, lambda c, k=k: n.connector_distance(c, k), "string", ["半马", "全程", "马拉松", "50 km", "30K", "x"]) for k in n.CONNECTOR_DISTANCES}
    assert kinds["zuicool"] == [21.1, 42.2, None, 50.0, None, None] and kinds["runchina"] == [21.1, 42.2, 42.2, 50.0, None, None] and kinds["seed"] == [21.1, 42.2, 42.2, 50.0, 30.0, None] and kinds["catalog"] == [None, None, 42.195, 50.0, 30.0, None]
    assert values(spark, n.connector_climb, "string", ["累计爬升 2600米", "D+12", "x"]) == [2600, None, None] and values(spark, n.cutoff_text, "string", ["关门时间 6小时，补给", "x"]) == ["关门时间 6小时", None]


def test_seed_candidates(spark):
    rows = [("zuicool", "1", "杭州湖滨马拉松报名", "2026.11.1 · 浙江 杭州 西湖", "即将开始", None, "s", "全程马拉松、半程马拉松"), ("runchina", "2", None, None, None, None, None, None), ("zuicool", "3", "莫干山越野", "2026.1.1 · 浙江 湖州", "报名", "u", "s", '["60km 爬升3000米"]')]
    df = spark.createDataFrame(rows, "source_id string, raw_id string, name string, date_location string, status_text string, registration_url string, source_url string, categories_text string")
    a, b, c = n.seed_candidates(df, "2026-06-30").collect()
    assert (a["name"], a["race_date"], a["city"], a["registration_status"], a["type"], a["popularity"], a["confidence"]) == ("杭州湖滨马拉松", "2026-11-01", "杭州", "upcoming", "marathon", 38, 0.84)
    assert b["missing_fields"] == ["name", "province", "city", "raceDate", "registrationUrl", "sourceUrl", "categories"] and (b["type"], b["registration_status"], b["confidence"]) == ("other", "unknown", 0.68)
    assert (c["registration_status"], c["type"], c["categories"][0]["elevation_gain"]) == ("finished", "ultra_trail", 3000)
    ok = n.valuable_candidate(F.col("s"), F.col("d"), F.col("st"), F.col("u"), "2026-06-30")
    cases = [("s", "2026-07-01", "closed", "u", True), ("s", "2026-07-01", "closed", None, False), ("s", None, "upcoming", None, True), ("s", None, "closed", "u", False), ("", "2026-07-01", "upcoming", "u", False), ("s", "2026-06-01", "upcoming", "u", False), ("s", "2026-06-30", "unknown", None, True)]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(cases)], "k int, s string, d string, st string, u string, want boolean")
    assert all(x["got"] == x["want"] for x in df.withColumn("got", ok).collect())


REG = "edition_id string, source_id string, url string, tier string, source_type string, status string, is_primary boolean"


def test_eligibility(spark):
    cases = [
        ("e", "e", "active", "primary_official", "notice", (True, True, "official_document")), ("e", "f", "active", "primary_official", "notice", (False, False, None)), ("e", "e", "retired", "primary_official", "notice", (False, False, None)),
        ("e", "e", "active", "primary_official", "media_report", (False, False, None)), ("e", "e", "active", "trusted_structured", "structured_connector", (True, False, "structured_connector")),
        ("e", "e", "active", "trusted_structured", "calendar", (True, False, "trusted_document")), ("e", "e", "active", "trusted_secondary", "official_partner_announcement", (True, False, "trusted_document")), ("e", "e", "active", "trusted_secondary", "calendar", (False, False, None)), ("e", "e", None, None, None, (False, False, None)),
    ]
    df = spark.createDataFrame([(k, *c[:5]) for k, c in enumerate(cases)], "k int, a string, b string, status string, tier string, kind string")
    got = df.orderBy("k").select(r.eligibility(*[F.col(x) for x in ("a", "b", "status", "tier", "kind")]).alias("x")).select("x.*").collect()
    assert [tuple(x)[:3] for x in got] == [c[5] for c in cases] and all(x["reason"] for x in got)


def registry(spark):
    return spark.createDataFrame(
        [
            ("lake-2026", "home", "https://lake.cn/", "primary_official", "event_home", "active", True), ("lake-2026", "news", "https://lake.cn/news", "primary_official", "notice", "active", False), ("lake-2026", "old", "https://lake.cn/old", "primary_official", "notice", "retired", False),
            ("hill-2026", "home", "https://hill.cn/", "primary_official", "event_home", "active", True), ("lake-2025", "home", "https://lake.cn/2025", "primary_official", "event_home", "active", True), ("hill-2026", "shared", "https://both.cn/h", "primary_official", "notice", "active", False),
            ("lake-2026", "shared", "https://both.cn/l", "primary_official", "notice", "active", False), ("hill-2026", "conn", "https://c.cn", "trusted_structured", "structured_connector", "active", False),
        ],
        REG,
    )


def test_sources_of_candidates(spark):
    import hashlib

    key = lambda parent, url: f"{parent}::announcement:{hashlib.sha256(url.encode()).hexdigest()[:24]}"
    urls = [("home", "https://lake.cn/a/1", True), ("home", "https://lake.cn/admin/1", False), ("home", "https://other.cn/1", False), ("home", "http://lake.cn/1", False), ("home", "https://lake.cn/1?token=x", False), ("home", "https://lake.cn/1#x", False), ("shared", "https://both.cn/1", False), ("home", "https://lake.cn/old", False), ("gone", "https://lake.cn/2", False)]
    rows = [("lake-2026", key(p_, u), u) for p_, u, _ in urls] + [("lake-2026", "news", "https://lake.cn/news"), ("lake-2026", "nope", "https://lake.cn/news"), ("lake-2026", key("home", "https://lake.cn/a/1"), "https://lake.cn/a/2")]
    df = spark.createDataFrame(rows, "edition_id string, source_id string, source_url string")
    got = {(x["source_id"], x["source_url"]): (x["tier"], x["source_type"], x["delegated_by"]) for x in r.with_source(df, registry(spark)).collect()}
    assert len(got) == len(rows)
    for p_, u, ok in urls:
        assert got[key(p_, u), u] == (("primary_official", "notice", p_) if ok else (None, None, None)), u
    assert got["news", "https://lake.cn/news"] == ("primary_official", "notice", None) and got[rows[-2][1:]][0] is None and got[rows[-1][1:]][0] is None


def test_registry_rows(spark):
    reg = registry(spark)
    assert {x["source_id"] for x in r.active_sources(reg, "hill-2026").collect()} == {"home", "shared", "conn"} and r.active_sources(reg).count() == 7
    entries = [(x["edition_id"], x["source_id"], x["rank"]) for x in r.entry_sources(reg).orderBy("edition_id", "rank").collect()]
    assert entries == [("hill-2026", "home", 1), ("hill-2026", "shared", 2), ("lake-2025", "home", 1), ("lake-2026", "home", 1), ("lake-2026", "news", 2)]
    best = r.most_authoritative(reg.where("source_id <> 'home'"), ["edition_id"])
    assert {x["edition_id"]: x["source_id"] for x in best.collect()} == {"lake-2026": "news", "hill-2026": "shared"}
    later = r.fetch_budget(spark.range(13).selectExpr("'e' AS e", "id"), ["e"], ["id"]).groupBy("fetch").count().collect()
    assert {x["fetch"]: x["count"] for x in later} == {"now": 10, "deferred": 3}
    groups = spark.createDataFrame([("g", ["b", "zz", "a"])], "g string, race_ids array<string>")
    races = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    assert [tuple(x) for x in r.group_members(groups, races).orderBy("member_rank").select("id", "v").collect()] == [("b", 2), ("a", 1)]
    assert r.by_status(races.withColumn("status", F.lit("pending"))).count() == 2 and r.by_status(races.withColumn("status", F.lit("pending")), "applied").count() == 0
    assert {x["id"]: x["e"] for x in r.enriched(races, spark.createDataFrame([("a", 9)], "id string, e int"), "id").collect()} == {"a": 9, "b": None}


def test_field_verification(spark):
    fields = spark.createDataFrame([("e", None, "raceDate", "d1"), ("e", None, "city", None), ("e", "c", "distanceKm", "60"), ("e", None, "endDate", "d2"), ("e", None, "status", "unknown"), ("e", None, "venue", "v")], "edition_id string, category_id string, field string, value string")
    reports = spark.createDataFrame([("e", "s1", "primary_official", True, "success", "success"), ("e", "s2", "primary_official", True, "unchanged", "skipped"), ("e", "s3", "trusted", True, "success", "success"), ("e", "s4", "primary_official", False, "success", "success")], "edition_id string, source_id string, tier string, identity_matched boolean, extraction string, request string")
    said = spark.createDataFrame(
        [("e", "s1", None, "raceDate", "d1", True, True), ("e", "s2", "c", "distanceKm", "60", True, True), ("e", "s1", None, "endDate", "d9", True, True), ("e", "s2", None, "endDate", "d2", True, True), ("e", "s3", None, "venue", "v", True, True), ("e", "s4", None, "venue", "v", True, True)],
        "edition_id string, source_id string, category_id string, field string, value string, authoritative boolean, direct boolean",
    )
    got = {x["field"]: (x["status"], x["sources"]) for x in r.field_verification(fields, reports, said).collect()}
    assert got == {"raceDate": ("VERIFIED_THIS_RUN", ["s1"]), "city": ("UNKNOWN", []), "distanceKm": ("VERIFIED_INHERITED", ["s2"]), "endDate": ("NOT_VERIFIED_THIS_RUN", ["s2"]), "status": ("UNKNOWN", []), "venue": ("NOT_VERIFIED_THIS_RUN", [])}


def test_failures_and_pilot(spark):
    df = spark.createDataFrame([([("u", "HTTP 403")], [], 0), ([("u", "odd")], ["needs render"], 0), ([], [], 0), ([], [], 3)], "f array<struct<url string, reason string>>, notes array<string>, n int")
    got = [x[0] for x in df.select(r.failure_categories(F.col("f"), F.col("notes"), F.col("n"))).collect()]
    assert got == [["HTTP 访问失败", "反爬限制"], ["页面需要 JS 渲染"], ["数据源本身不适合 POC"], []]
    df = spark.createDataFrame([(65, "湖滨", True), (64, "湖滨", True), (90, "亲子跑", True), (90, "湖滨", None)], "s int, n string, x boolean")
    assert [x[0] for x in df.select(r.pilot_eligible(F.col("s"), F.col("n"), F.col("x"))).collect()] == [True, False, False, False]


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://X.cn/a//?utm_source=q&b=2&a=1&fbclid=z#f", "https://x.cn/a?a=1&b=2"), ("HTTP://x.cn:80", "http://x.cn/"), ("https://x.cn/?spm=1&from=2&ref=3", "https://x.cn/?from=2&ref=3&spm=1"), ("https://x.cn/a?token=1", None), ("ftp://x.cn/", None),
        ("https://10.0.0.1/a", None), ("https://x.cn/a?b=2&b=1", "https://x.cn/a?b=2&b=1"), ("https://x.cn/A/B/", "https://x.cn/A/B"), (None, None),
    ],
)
def test_normalize_url(spark, url, want):
    assert values(spark, text.normalize_url, "string", [url]) == [want]


def test_race_links_and_names(spark):
    page = "<a href='/1'>湖滨马拉松</a><a href='/1'>湖滨马拉松</a><a href='/2'>更多内容在此</a><a href='/3'>跑步</a>"
    assert [x["href"] for x in values(spark, text.race_links, "string", [page])[0]] == ["/1"]
    assert values(spark, text.catalog_name, "string", ["2026 湖滨·马拉松（站）赛", "湖滨赛 2026"]) == ["湖滨马拉松", "湖滨"]


def test_normalized_races_query_drops_ids(spark):
    """The query shows no ids, so neither their slugs nor their hashes may be worked out for its rows."""
    import __spark_entry__ as entry

    plan = entry.queries()["normalized_races"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "nfkd" not in plan and "conv(" not in plan
