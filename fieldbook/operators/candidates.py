"""Candidate scoring of catalog entries: type, points by aspect, issues, cost and role, top score, rule-by-rule selection.

Rows have ``name, type, province, city, district, registrationUrl, registrationStatus, raceDate, categories
array<struct<categoryName, distanceKm, elevationGain, cutoffTime, registrationFee, categoryRegistrationUrl>>``; null
categories count as none, 0 and the empty string as missing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import js_round
from .catalog import has_text, nested_max_floor0

# fixed values: words that say something about a candidate
TRAIL_NAMES = "越野|跑山|山径|穿越|trail|贡嘎|崇礼|柴古|莫干|武功山|168|山野"
KNOWN_NAMES = "崇礼168|六盘水马拉松|斯巴达|越山向海|武功山|莫干山|贡嘎|柴古|熊猫|香山|青海|贵阳|阿尔山|天山"
MINOR_NAMES = "训练营|训练赛|亲子|青少年|线上|徒步|急救培训|彩色|荧光"
SEARCHED_NAMES = "马拉松|越野|跑山|168|100|50K|斯巴达|香山|六盘水|崇礼|武功山|莫干山|贡嘎|柴古|阿尔山|天山"
RARELY_SEARCHED = "线上|培训|亲子|青少年|Colorful|荧光|徒步"
TRAVEL_PLACES = "贵州|云南|四川|青海|内蒙古|河北|吉林|新疆|西藏|海南|张家口|六盘水|贵阳|阿尔山|崇礼|甘孜|西湖|杭州"
NO_TRAVEL = "线上|亲子|青少年|培训|荧光"
DEMANDING_NAMES = "贡嘎|崇礼|天山|阿尔山|西湖|高海拔|冰川|山径|跑山|穿越"
ANYWHERE = "不限地点|线上"

TRAIL = ("trail", "ultra_trail")


def _says(c: Column, words: str) -> Column:
    return F.coalesce(c.rlike(f"(?i){words}"), F.lit(False))


def _points(*terms: tuple[Column, int], start: int = 0) -> Column:
    out = F.lit(start)
    for when, n in terms:
        out = out + F.when(when, F.lit(n)).otherwise(0)
    return out


def _clamp(c: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), js_round(c))).cast("int")


def _any(test: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.exists("categories", lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))


def _number(field: str) -> Column:
    return _any(lambda x: x[field].isNotNull() & (x[field] != 0))


def _text(field: str) -> Column:
    return _any(lambda x: x[field] != "")


def _n_categories() -> Column:
    return F.coalesce(F.size("categories"), F.lit(0))


def candidate_type() -> Column:
    """Type by name, then climb, distance and the stored type."""
    km, climb = (nested_max_floor0(F.col(f"categories.{f}")) for f in ("distanceKm", "elevationGain"))
    name = F.coalesce("name", F.lit(""))
    return (
        F.when(_says(name, TRAIL_NAMES) | (climb >= 500), F.when(km >= 50, "ultra_trail").otherwise("trail"))
        .when(name.rlike("半程|半马"), "half_marathon")
        .when(name.rlike("马拉松") | _any(lambda x: (x["distanceKm"] >= 40) & (x["distanceKm"] < 50)), "marathon")
        .when(F.col("type").isin("marathon", "half_marathon", *TRAIL), F.col("type"))
        .otherwise("other")
    )


def _with_link() -> Column:
    return has_text("registrationUrl") | _text("categoryRegistrationUrl")


def completeness() -> tuple[Column, Column]:
    """Points of the seven first-rank fields (of 10) and of the four second-rank fields (of 5)."""
    place = has_text("city") | (has_text("province") & ~_says(F.col("province"), ANYWHERE))
    first = [has_text("name"), has_text("raceDate"), place, _text("categoryName"), _number("distanceKm"), _with_link(), has_text("registrationStatus")]
    second = [_number("elevationGain"), _text("cutoffTime"), _number("registrationFee")]
    share = lambda checks, n, most: js_round(_points(*((c, 1) for c in checks)) / n * most)  # noqa: E731  the fourth of the second rank is never known
    return share(first, 7, 10), share(second, 4, 5)


def candidate_scores(df: DataFrame) -> DataFrame:
    """Adds candidate_type, attention, search, commercial, complexity, completeness and their total."""
    kind, name = F.col("candidate_type"), F.coalesce("name", F.lit(""))
    km = nested_max_floor0(F.col("categories.distanceKm"))
    trail, many = kind.isin(*TRAIL), _n_categories() >= 3
    place = F.concat_ws(" ", "province", "city", "district")
    attention = _points(
        (kind == "ultra_trail", 8), (kind == "trail", 6), (kind == "marathon", 7), (kind == "half_marathon", 4), (_says(name, KNOWN_NAMES), 10), (name.rlike(MINOR_NAMES), -7), (many, 3), start=8
    )
    search = _points((F.length(name) >= 8, 4), (kind.isin("marathon", "ultra_trail"), 5), (_says(name, SEARCHED_NAMES), 8), (name.rlike(RARELY_SEARCHED), -5), start=8)
    physical = has_text("city") & ~_says(F.col("province"), ANYWHERE)
    commercial = _points((physical, 4), (trail, 6), (kind == "marathon", 4), (place.rlike(TRAVEL_PLACES), 5), (name.rlike(NO_TRAVEL), -5), start=5)
    base = F.when(trail, 12).when(kind.isin("marathon", "half_marathon"), 8).otherwise(5)
    complexity = base + _points(((kind == "ultra_trail") | (km >= 50), 2), (_number("elevationGain") | _text("cutoffTime"), 1), (many, 1), (_says(name, DEMANDING_NAMES), 1))
    first, second = completeness()
    scored = df.withColumn("candidate_type", candidate_type()).withColumns(
        {"attention": _clamp(attention, 0, 30), "search": _clamp(search, 0, 25), "commercial": _clamp(commercial, 0, 20), "complexity": _clamp(complexity, 5, 15), "completeness": _clamp(first * 0.7 + second * 0.6, 0, 10)}
    )
    return scored.withColumn("total", F.col("attention") + F.col("search") + F.col("commercial") + F.col("complexity") + F.col("completeness"))


# fixed values: what a score from a bound on speaks for, and the texts of the reason; at most four stand
ADVANTAGES = (
    ("attention", 22, "跑者认知或赛事品牌信号较强"), ("search", 20, "赛事名和类型具备明确搜索价值"), ("commercial", 15, "住宿、交通、装备或旅行商业场景较强"),
    ("complexity", 13, "用户报名决策复杂，需要 {site} 提供判断"), ("completeness", 8, "现有 P0/P1 字段基础较好"),
)
TRAIL_ADVANTAGE, MOST_ADVANTAGES = "可验证越野赛事高决策成本场景", 4
SCORE_NAMES = {"attention": "runnerAttention", "search": "searchValue", "commercial": "commercialValue", "complexity": "decisionComplexity", "completeness": "dataCompleteness"}
BEST_SCORE = "当前候选主要优势来自 {}。"


def advantages(scored: DataFrame, site: str) -> DataFrame:
    """Adds what speaks for a scored candidate (``advantages``) and the ``reason``: those, or its best score where there are none.

    ``site`` is the name by which the texts call the site.
    """
    said = [F.when(F.col(c) >= least, F.lit(words.replace("{site}", site))) for c, least, words in ADVANTAGES]
    trail = F.when(F.col("candidate_type").isin(*TRAIL), F.lit(TRAIL_ADVANTAGE))
    best = F.array_sort(F.array(*[F.struct((-F.col(c)).cast("double").alias("down"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (c, name) in enumerate(SCORE_NAMES.items())]))
    prefix, suffix = BEST_SCORE.split("{}")
    out = scored.withColumn("advantages", F.slice(F.array_compact(F.array(*said, trail)), 1, MOST_ADVANTAGES))
    return out.withColumn("reason", F.when(F.size("advantages") > 0, F.array_join("advantages", "；")).otherwise(F.concat(F.lit(prefix), F.get(best, F.lit(0))["name"], F.lit(suffix))))


def candidate_notes(scored: DataFrame) -> DataFrame:
    """Adds issue codes in order, the completion cost and the role of a scored candidate."""
    trail = F.col("candidate_type").isin(*TRAIL)
    rules = (
        (~has_text("raceDate"), "date"), (~has_text("city") & ~has_text("province"), "place"), (~_with_link(), "registration"), (~_number("distanceKm"), "distance"),
        (trail & ~_number("elevationGain"), "elevation"), (trail & ~_text("cutoffTime"), "cutoff"), (~_number("registrationFee"), "fee"),
    )
    issues = F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in rules]))
    issues = F.when(F.size(issues) > 0, issues).otherwise(F.array(F.lit("verification")))
    n = F.size("issues")
    role = (
        F.when(trail & (F.col("complexity") >= 13), "decision_complexity")
        .when(trail & (F.col("completeness") >= 8), "trail_depth")
        .when((F.col("candidate_type") == "marathon") & (F.col("search") >= 20), "road_search")
        .when(F.col("commercial") >= 15, "commercial_travel")
        .otherwise("data_repair")
    )
    cost = F.when((n <= 2) & _with_link() & _number("distanceKm"), "low").when(n <= 4, "medium").otherwise("high")
    return scored.withColumn("issues", issues).withColumns({"cost": cost, "role": role})


def top_score(popularity: Column, source_priority: Column, days_until: Column) -> Column:
    """Selection score of a candidate; an unknown date gets no nearness points."""
    status, kind = F.col("registrationStatus"), F.col("type")
    near = F.coalesce(F.greatest(F.lit(0), 12 - F.floor(days_until / 45)), F.lit(0))
    known = _points(
        (status == "registration_open", 30), (status == "lottery", 28), (status == "upcoming", 18), (has_text("registrationUrl"), 24), (has_text("sourceUrl"), 12), (has_text("raceDate"), 12),
        (_n_categories() > 0, 10), (kind.isin("marathon", "half_marathon"), 6), (kind.isin(*TRAIL), 8),
    )
    return (popularity + source_priority + known + near).cast("int")


def pick_in_turn(df: DataFrame, rules: Sequence[Column | Callable[[list], Column]], order: Sequence[str], id_col: str, k: int = 5) -> DataFrame:
    """For each rule in turn the first row by ``order`` that it holds for, then the first of the rest, ``k`` rows in all.

    A rule may be a function of the rows picked so far. A rule whose first row is already picked adds none. Each step
    is one top-1 query, and only ``k`` rows ever reach the driver.
    """
    picked: list = []
    for rule in rules:
        best = df.where(rule(picked) if callable(rule) else rule).orderBy(*order).limit(1).collect()
        picked += [r for r in best if r[id_col] not in {p[id_col] for p in picked}]
    chosen = [p[id_col] for p in picked[:k]]
    rest = df.where(~F.col(id_col).isin(chosen)) if chosen else df
    more = [r[id_col] for r in rest.orderBy(*order).limit(k - len(chosen)).collect()]
    turn = F.array_position(F.array(*[F.lit(x) for x in [*chosen, *more]]), F.col(id_col)) if chosen or more else F.lit(0)
    return df.where(F.col(id_col).isin([*chosen, *more])).withColumn("turn", turn.cast("int"))
