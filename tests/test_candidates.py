"""Unicode text rules and candidate scoring on hand-built rows."""

import json

import pytest
from pyspark.sql import functions as F

from fieldbook.functions import unicode as u
from fieldbook.operators import candidates as c

CATEGORIES = "array<struct<categoryName string, distanceKm double, elevationGain double, cutoffTime string, registrationFee double, categoryRegistrationUrl string>>"
ROWS = f"id string, ord int, name string, type string, province string, city string, district string, registrationUrl string, registrationStatus string, raceDate string, sourceUrl string, categories {CATEGORIES}"


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()])
    return df.select(column).first()[0]


def test_identity_and_slug(spark):
    a = F.col("a")
    assert one(spark, u.identity_text(a), a="ＡＢ-c １２ 杭州！") == "abc12杭州"
    assert one(spark, u.evidence_identity(F.col("s"), a), s="x", a="开赛 2026，九月 。") == "x|开赛2026九月"
    assert one(spark, u.slug(a), a="Café  Trail 50K!") == "cafe-trail-50k"
    assert one(spark, u.slug(a), a="杭 州") == "e69dad20e5b79e"
    assert one(spark, u.slug(a), a=None) is None and one(spark, u.identity_text(a), a=None) is None


def test_stable_json_and_urls(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, u.stable_json(a), a='{"b": 42.0, "a": [1.5, null, "é"]}') == '{"a":[1.5,null,"é"],"b":42}'
    assert one(spark, u.stable_json(a), a="not json") is None
    assert one(spark, u.absolute_url(a, b), a="../x?q=1", b="https://h.org/a/b/c") == "https://h.org/a/x?q=1"
    assert one(spark, u.absolute_url(a, b), a="", b="https://h.org/") is None


@pytest.mark.parametrize(
    "title, tag, want",
    [("2026北京", None, "title_year_match"), ("2025 and 2026", None, "year_conflict"), ("open", "2026", "cms_tag_only_needs_review"), ("open", "2025", "year_conflict"), ("a2026", None, "needs_review"), (None, None, "needs_review")],
)
def test_edition_year_class(spark, title, tag, want):
    assert one(spark, u.edition_year_class(F.col("t"), F.col("g"), 2026), t=title, g=tag) == want


def test_article_and_json_ld(spark):
    a = F.col("a")
    assert one(spark, u.article_html(a), a="<nav>n</nav><main>x<main>y</main>z</main>t") == "x<main>y</main>z"
    assert one(spark, u.article_html(a), a="<article>open") is None
    assert one(spark, u.article_html(a), a="<nav>n</nav>body<div class='a footer'>f") == " body"
    graph = {"@graph": [{"@type": ["Thing", "SportsEvent"], "name": "Run", "startDate": "2026-05-01", "location": {"address": {"addressRegion": "R", "addressLocality": "L"}}}, {"@type": "Person", "name": "P"}]}
    html = f'<script type="application/ld+json">{json.dumps(graph)}</script><script type="application/ld+json">{{bad</script>'
    got = one(spark, u.json_ld_events(a), a=html)
    assert [(r["name"], r["start_date"], r["location"], r["url"]) for r in got] == [("Run", "2026-05-01", "R L", None)]
    assert one(spark, u.json_ld_events(a), a=None) == []


def rows(spark):
    full = [("全程", 42.2, None, "6h", 100.0, None)]
    trail = [("50K", 55.0, 2600.0, "14h", 300.0, "u"), ("30K", 30.0, 1200.0, None, None, None), ("15K", 15.0, 0.0, "", 0.0, "")]
    return spark.createDataFrame(
        [
            ("m", 1, "六盘水马拉松赛2026", "road", "贵州", "六盘水", None, "https://r", "registration_open", "2026-07-01", "https://s", full),
            ("t", 2, "莫干山越野挑战", None, "浙江", "湖州", None, None, "upcoming", None, None, trail),
            ("h", 3, "亲子半马", None, "线上", None, None, "", None, "", None, []),
            ("n", 4, None, None, None, None, None, None, None, None, None, None),
        ],
        ROWS,
    )


def test_candidate_scores(spark):
    got = {r["id"]: r for r in c.candidate_notes(c.candidate_scores(rows(spark))).collect()}
    values = {k: tuple(r[x] for x in ("candidate_type", "attention", "search", "commercial", "complexity", "completeness", "total", "cost", "role")) for k, r in got.items()}
    # marathon: 8+7+10, 8+4+5+8, 5+4+4+5, 8+1, round(10*.7 + round(2/4*5)*.6)
    assert values["m"] == ("marathon", 25, 25, 18, 9, 9, 86, "low", "road_search")
    # ultra trail: 8+8+10+3, 8+5+8, 5+4+6, 12+2+1+1, round(round(6/7*10)*.7 + round(3/4*5)*.6)
    assert values["t"] == ("ultra_trail", 29, 21, 15, 15, 9, 89, "low", "decision_complexity")
    assert values["h"][:4] == ("half_marathon", 5, 3, 0)
    # four issues are still a medium cost, five are a high one
    assert got["h"]["issues"] == ["date", "registration", "distance", "fee"] and values["h"][7] == "medium"
    assert values["n"] == ("other", 8, 8, 5, 5, 0, 26, "high", "data_repair")
    assert got["t"]["issues"] == ["date"] and got["n"]["issues"] == ["date", "place", "registration", "distance", "fee"]


def test_top_score(spark):
    s = rows(spark).select("id", c.top_score(F.lit(10), F.lit(5), F.when(F.col("id") == "m", 100)).alias("s"))
    assert {r["id"]: r["s"] for r in s.collect()} == {"m": 15 + 30 + 24 + 12 + 12 + 10 + 10, "t": 15 + 18 + 10, "h": 15, "n": 15}


def test_pick_in_turn(spark):
    df = rows(spark)
    rules = [F.col("id") == "t", F.col("city").isNotNull(), lambda p: ~F.col("id").isin([x["id"] for x in p]) & (F.col("ord") > 3)]
    got = c.pick_in_turn(df, rules, ["ord"], "id", 4).orderBy("turn")
    assert [r["id"] for r in got.collect()] == ["t", "m", "n", "h"]
    assert c.pick_in_turn(df.limit(0), rules, ["ord"], "id", 4).count() == 0


def test_advantages(spark):
    from fieldbook.operators import candidates

    rows = [("trail", 30, 25, 20, 15, 10), ("trail", 0, 0, 0, 5, 0), ("marathon", 5, 19, 14, 12, 7), ("marathon", 22, 0, 0, 13, 8), ("other", 3, 3, 3, 2, 0)]
    df = spark.createDataFrame(rows, "candidate_type string, attention int, search int, commercial int, complexity int, completeness int")
    got = candidates.advantages(df, "X").collect()
    texts = [t.replace("{site}", "X") for *_, t in candidates.ADVANTAGES]
    assert [r["advantages"] for r in got] == [texts[:4], [candidates.TRAIL_ADVANTAGE], [], [texts[0], texts[3], texts[4]], []]
    assert got[0]["reason"] == "；".join(texts[:4]) and got[2]["reason"] == "当前候选主要优势来自 searchValue。" and got[4]["reason"] == "当前候选主要优势来自 runnerAttention。"


def test_pick_urls(spark):
    from pyspark.sql import functions as F

    from fieldbook.operators import merge

    rows = [
        ("a", "zuicool", 1, 0.9, 0, "o-z", "r-z"), ("a", "itra", 3, 0.5, 1, None, "r-i"), ("a", "runchina", 2, 0.5, 2, "o-r", None), ("b", "itra", 3, 0.5, 0, None, None), ("b", "runchina", 2, 0.5, 1, "o-r", "r-r"), ("b", "zuicool", 1, 0.9, 2, "o-z", None),
        ("c", "other", 9, 0.5, 0, "o-x", "r-x"), ("c", "zuicool", 1, 0.5, 1, None, "r-z"), ("d", "other", 1, 0.5, 0, None, ""), ("e", "zuicool", 1, 0.5, 1, None, "second"), ("e", "zuicool", 1, 0.5, 0, None, "first"), ("e", "zuicool", 1, 0.6, 2, None, "surest"),
    ]
    df = spark.createDataFrame(rows, "k string, source string, priority int, confidence double, n int, official_url string, registration_url string")
    got = {r["k"]: (r["official_url"], r["registration_url"]) for r in merge.pick_urls(df, ["k"], "source", F.col("priority"), F.col("confidence"), F.col("n")).collect()}
    # a: the best preferred row has only the other kind of address, so the general rule finds the official one
    assert got == {"a": ("o-r", "r-z"), "b": ("o-r", "r-r"), "c": ("o-x", "r-z"), "d": (None, ""), "e": (None, "surest")}
