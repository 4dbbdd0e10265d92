"""Cards, recommendation texts and decision pages on hand-built rows."""

import pytest
from pyspark.sql import functions as F

from fieldbook.operators import cards as k

CATS = "array<struct<category_name string, distance_km double, elevation_gain double, registration_fee double, cutoff_time string, registration_url string>>"
RECORD = f"id string, normalized_name string, original_names array<string>, edition_year int, race_date string, province string, city string, district string, venue string, registration_status string, registration_url string, source_url string, cover_image string, confidence double, categories {CATS}"
AS_OF = "2026-06-30"


def records(spark):
    full, half, ultra = ("全马", 42.2, None, 200.0, None, None), (None, 21.0, None, 100.0, "6h", "u"), ("60K", 60.0, 3000.0, None, None, None)
    rows = [
        ("m", "湖滨马拉松", ["2026湖滨马拉松"], 2026, "2026-07-20", "浙江", "杭州", "西湖", None, None, "https://r", "https://s", "c", 0.9, [full, half]),
        ("t", "莫干山越野", [], 2026, None, "浙江", "湖州", None, None, "即将报名", None, "https://s", None, 0.7, [ultra]),
        ("h", "城市跑", ["城市跑"], None, "2026-06-30", "日本", None, None, None, "closed", None, None, None, 0.5, [half]),
        ("p", "旧赛", [], 2025, "2025-01-01", None, None, None, None, "1", None, None, None, 0.8, []),
        ("o", "某赛", [], None, "2026-12-01", "上海", None, None, None, "抽签中", None, None, None, 0.4, [(None, None, None, None, None, None), ("亲子", None, None, None, None, None)]),
    ]
    return spark.createDataFrame(rows, RECORD)


def test_cards(spark):
    got = {r["id"]: r for r in k.cards(records(spark), AS_OF).collect()}
    m, t, h, p, o = (got[x] for x in "mthpo")
    assert (m["name"], m["type"], m["region"], m["difficulty"], m["registration_status"], m["distances_text"], m["price_text"], m["fee_main"], m["fee_sub"]) == ("2026湖滨马拉松", "marathon", "east_china", "intermediate", "registration_open", "42.2KM / 21KM", "¥100 - ¥200", "¥100 起", "2 个组别")
    assert m["date_text"] == "2026.07.20 周一" and m["countdown_text"] == "距离开赛 20 天" and m["summary"] == "杭州 西湖 · 2 个组别 · 报名信息已接入"
    assert (t["type"], t["difficulty"], t["registration_status"], t["date_text"], t["countdown_text"], t["elevation_text"]) == ("ultra_trail", "challenge", "registration_open", "2026年，日期待更新", "具体日期待更新", "3000m")
    assert (h["type"], h["registration_status"], h["countdown_text"], h["region"]) == ("half_marathon", "racing", "今日开赛", "overseas")
    assert (p["type"], p["registration_status"], p["countdown_text"], p["region"], p["fee_main"]) == ("other", "finished", "已结束", "unknown", "报名信息待更新") and o["registration_status"] == "lottery" and o["type"] == "other"
    assert [r["id"] for r in k.valuable(k.cards(records(spark), AS_OF)).collect()] == ["h", "m", "o", "t"]


def test_card_texts(spark):
    c = k.cards(records(spark), AS_OF)
    everyone = {"goal": "any", "stage": "any", "region": "all", "targetDistance": "any"}
    got = {r["id"]: r["x"] for r in c.select("id", k.card_reasons(everyone, F.lit(None).cast("double")).alias("x")).collect()}
    assert got["m"] == ["有报名入口，可以进一步查看。", "比赛日期明确，便于安排行程。", "距离和组别信息较完整。"] and got["p"] == ["比赛日期明确，便于安排行程。", "报名状态清晰，便于判断是否行动。"]
    goal = {"goal": "first_marathon", "stage": "half_marathon", "region": "east_china", "targetDistance": "30_50"}
    got = {r["id"]: r["x"] for r in c.select("id", k.card_reasons(goal, F.lit(42.2)).alias("x")).collect()}
    assert got["m"] == ["30KM - 50KM 区间覆盖全马目标，适合从半马进阶。", "路跑赛事结构清晰，方便从半马过渡到全马。", "组别距离接近你的目标距离。"]
    assert got["t"] == ["组别距离接近你的目标距离。", "所在地区符合你的偏好。", "比赛位于湖州，便于你提前评估交通和住宿。"]
    risk = {r["id"]: r["x"][:4] for r in c.select("id", k.card_risk("any").alias("x")).collect()}
    assert risk["t"] == "请重点关" and risk["m"] == "请结合近" and c.select(k.card_risk("challenge_100k")).first()[0].startswith("100K")


def test_category_texts(spark):
    df = spark.createDataFrame([("trail", "east_china", (55.0, "L6", False)), ("marathon", "x", (42.2, "L9", True))], "type string, region string, category struct<distanceKm double, difficultyLevel string, beginnerFriendly boolean>")
    profile = {"targetRaceType": "trail", "targetDistance": 50, "longestCompletedRace": "trail_50k", "regionPreference": "east_china", "hasPersonalBest": True}
    a, b = df.select(k.category_conclusion(profile).alias("c"), k.category_reasons(profile, (5, 7, 8)).alias("r"), k.category_risk(profile, (5, 7, 8)).alias("x")).collect()
    assert a["c"] == "适合从中距离越野走向更长距离挑战" and b["c"] == "适合作为你下一阶段的比赛选择"
    assert a["r"] == ["赛事类型符合你的目标方向。", "组别距离接近你的目标距离。", "难度落在你的当前能力范围内。", "地区符合你的参赛偏好。"] and b["r"] == ["赛事类型符合你的目标方向。", "组别距离接近你的目标距离。", "已参考你的近期成绩。"]
    assert a["x"] == "风险提示：这场比赛不适合作为完全新手的第一场比赛。长距离赛事对耐力、补给和恢复要求较高，建议确认近期训练量后再报名。" and b["x"].startswith("风险提示：这场比赛略高于")
    assert df.select(k.category_conclusion(profile | {"longestCompletedRace": "trail_30k"})).first()[0] == "适合从 30KM 越野进阶到 50KM"
    easy = k.category_risk({"targetDistance": 21}, (9, 9, 9))
    assert df.select(easy.alias("x")).collect()[1]["x"] == "风险提示：请结合近期训练量、伤病情况和赛事官网关门时间，再决定是否报名。"


def test_decision_pages(spark):
    got = {r["id"]: r for r in k.decision_pages(records(spark), AS_OF).collect()}
    m, t, h, p, o = (got[x] for x in "mthpo")
    assert (m["type"], m["registration_status"], m["date_text"], m["location_text"], m["countdown_text"], m["category_text"]) == ("marathon", "registration_open", "2026.07.20 周一", "浙江 · 杭州 · 西湖", "距离比赛 20 天", "42.2KM / 21KM")
    assert [(c["id"], c["name"], c["registration_url"]) for c in m["categories"]] == [("m-0", "全马", "https://r"), ("m-1", "组别 2", "u")]
    a = m["categories"][1]["advice"]
    assert a["verdict"].startswith("半马距离") and a["advice"] == "先按 21KM 的距离评估近期训练量，最后对照官方关门时间倒推配速和补给计划。报名前优先核对官方比赛规程和关门要求。" and len(a["recommended_for"]) == 3 and len(a["not_recommended_for"]) == 2 and a["guide"]["finish"].startswith("用官方")
    trail = t["categories"][0]["advice"]
    assert t["type"] == "ultra_trail" and trail["verdict"].startswith("进阶越野") and "累计爬升 3000m" in trail["guide"]["caution"] and trail["not_recommended_for"][0].startswith("没有越野")
    assert (h["registration_status"], h["countdown_text"], p["registration_status"], p["location_text"], p["date_text"]) == ("racing", "今日比赛", "finished", None, "2025.01.01 周三")
    assert [c["id"] for c in o["categories"]] == ["o-0"] and o["category_text"] == "亲子" and o["categories"][0]["advice"]["guide"] is None and o["categories"][0]["advice"]["verdict"] is None
    assert m["faq"][0]["question"] == "如何报名2026湖滨马拉松？" and m["faq"][0]["answer"] == k.ANSWERS["open"] and "42.2KM / 21KM" in m["faq"][3]["answer"] and p["faq"][3]["answer"] == k.ANSWERS["unlisted"]
    labels = k.decision_pages(records(spark), AS_OF).where("id = 'm'").select(k.category_labels(F.col("categories"))).first()[0]
    assert labels == ["42.2KM", "21KM"]


@pytest.mark.parametrize(
    "place, want",
    [
        ("上海市黄浦区", ("上海", "上海市", "黄浦区", "上海市黄浦区")), ("福建厦门", ("福建", "厦门市", None, "福建厦门")), ("福建泉州", ("福建", None, None, "福建泉州")), ("四川甘孜泸定", ("四川", "甘孜州", "泸定县", "四川甘孜泸定")),
        ("香港", ("香港", "香港", None, "香港")), (" 某地 ", ("某地", None, None, "某地")), ("", (None, None, None, None)),
    ],
)
def test_curated_place(spark, place, want):
    df = spark.createDataFrame([(place,)], "c string")
    assert tuple(df.select(k.curated_place(F.col("c")).alias("x")).first()["x"]) == want


def test_merged_records(spark):
    rows = spark.createDataFrame([("e1", "湖滨马拉松赛", 2026, "2026-11-01/02", "北京朝阳", "upcoming", ["马拉松", "10km"], None, "s"), ("e2", "2026山径", 2026, None, "", None, [], "c", None)], "event_id string, event_name string, event_year int, event_date string, event_location string, event_status string, categories array<string>, cover_image string, source_url string")
    a, b = k.curated_records(rows).collect()
    assert (a["original_names"], a["normalized_name"], a["race_date"], a["city"], a["missing_fields"]) == (["2026湖滨马拉松赛"], "湖滨马拉松", "2026-11-01", "北京市", ["coverImage"]) and [c["distance_km"] for c in a["categories"]] == [42.195, 10.0]
    assert b["original_names"] == ["2026山径"] and b["race_date"] is None and b["missing_fields"] == [] and b["province"] is None
    seeds = spark.createDataFrame([("s1", None, "2026-01-02", "p", "c", None, "x", None, None, ["runchina", "zuicool"], None, [], 0.8), ("s2", "名", None, None, None, None, None, "u", None, [], "s", ["a"], 0.5)], "id string, name string, race_date string, province string, city string, district string, registration_status string, registration_url string, cover_image string, source_ids array<string>, source_url string, missing_fields array<string>, confidence double").withColumn("categories", F.array())
    a, b = k.seed_records(seeds).collect()
    assert (a["normalized_name"], a["original_names"], a["edition_year"], a["primary_source"], a["registration_source"]) == ("s1", [], 2026, "runchina", "zuicool") and (b["source_ids"], b["registration_source"]) == (["zuicool"], "zuicool")


def test_curated_match(spark):
    curated = spark.createDataFrame([(2, "hk", "港百", ["HK100"]), (1, "bm", "北京马拉松", ["北马"]), (3, "sh", "上海马拉松", [])], "ord int, key string, name string, words array<string>")
    rows = spark.createDataFrame([("bm", "x"), ("q", "2026 北京 马拉松"), ("q", "hk100越野"), ("q", "上海"), ("q", ""), ("q", None), ("q", "北马与HK100")], "id string, name string")
    got = [r["curated_id"] for r in k.curated_match(rows, "id", "name", curated, "key", "name", "words").collect()]
    assert got == ["bm", "bm", "hk", "sh", None, None, "bm"]


def test_analytics(spark):
    df = spark.createDataFrame([("e", "e-1", None, 3, None), ("e", "e-1", "home", None, "h"), ("e", "e-1", "ad", 1, "h")], "event_id string, edition_id string, source string, position int, hotel_id string")
    got = k.analytics_events(df, "click", {"position": F.col("position"), "hotel_id": F.col("hotel_id")}).collect()
    assert [(r["source"], r["params"]) for r in got] == [("direct", {"position": "3"}), ("home", {"hotel_id": "h"}), ("other", {"position": "1", "hotel_id": "h"})]
