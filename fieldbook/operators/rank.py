"""Additive scores, top-k, quota top-k, nearest values, and the two recommenders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import js_round
from .catalog import any_nested, has_text, nested_max_floor0, rank_of


def additive_score(*terms: Column, low: int = 0, high: int = 100) -> Column:
    """Sum of terms, rounded half up, clamped."""
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.greatest(F.lit(low), F.least(F.lit(high), js_round(total))).cast("int")


def stepwise(value: Column, steps: Sequence[tuple[float, int]], otherwise: int = 0) -> Column:
    """Points of the first step whose limit the value does not pass."""
    out = F.lit(otherwise)
    for limit, points in reversed(list(steps)):
        out = F.when(value <= limit, F.lit(points)).otherwise(out)
    return out


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def quota_top_k(df: DataFrame, group: str, quotas: Mapping[object, int], order: Sequence[Column], limit: int, id_col: str) -> DataFrame:
    """Up to a quota of each group, then the best of the rest up to ``limit``; groups without quota only backfill.

    Groups fill in the order of ``quotas`` until the limit is reached. Adds ``picked_by`` (quota or backfill).
    """
    names = list(quotas)
    quota = F.create_map(*[x for g in names for x in (F.lit(g), F.lit(quotas[g]))])
    best = top_per_group(df.where(F.col(group).isin(names)), [group], order, max(quotas.values()), "_rn").where(F.col("_rn") <= F.element_at(quota, F.col(group)))
    # at most sum(quotas) rows from here
    first = best.orderBy(rank_of(group, names), "_rn").limit(limit).drop("_rn").withColumn("picked_by", F.lit("quota"))
    rest = df.join(F.broadcast(first.select(id_col)), id_col, "left_anti").orderBy(*order).limit(limit)
    both = first.withColumn("_first", F.lit(0)).unionByName(rest.withColumns({"picked_by": F.lit("backfill"), "_first": F.lit(1)}))
    return both.orderBy("_first", *order).limit(limit).drop("_first")


def nearest(array: str, target: float, key) -> Column:
    """Element whose ``key`` is nearest to ``target``; the earlier of two equally near ones; null keys never win."""
    scored = F.transform(F.filter(array, lambda x: key(x).isNotNull()), lambda x, i: F.struct(F.abs(key(x) - F.lit(target)).alias("d"), i.alias("i"), x.alias("x")))
    return F.get(F.array_sort(scored), 0)["x"]


def nearest_others(df: DataFrame, group: str, value: str, id_col: str, k: int = 3) -> DataFrame:
    """``left_id, right_id, rank``: for each row the ``k`` others of its group with the nearest values, by id among equals.

    Of each value only its ``k + 1`` smallest ids can be an answer, and only the ``k`` values before and after, so a group's rows are
    reduced to its distinct values before they are ordered, and no pairs of rows are made.
    """
    few = top_per_group(df.select(group, value, id_col), [group, value], [F.col(id_col)], k + 1, "_rn")
    values = few.groupBy(group, value).agg(F.sort_array(F.collect_list(id_col)).alias("_ids"))
    w = Window.partitionBy(group).orderBy(value)
    at = lambda n: F.struct(F.lag(value, n).over(w).alias("v"), F.lag("_ids", n).over(w).alias("ids"))
    around = values.select(group, value, F.array(*[at(n) for n in range(-k, k + 1)]).alias("_near"))
    near = F.flatten(F.transform(F.filter("_near", lambda x: x["v"].isNotNull()), lambda x: F.transform(x["ids"], lambda i: F.struct(x["v"].alias("v"), i.alias("id")))))
    rows = df.select(F.col(group), F.col(value), F.col(id_col)).join(around, [group, value])
    ranked = F.array_sort(F.transform(F.filter(near, lambda x: x["id"] != F.col(id_col)), lambda x: F.struct(F.abs(x["v"] - F.col(value)).alias("gap"), x["id"].alias("id"))))
    return rows.select(F.col(id_col).alias("left_id"), F.posexplode(F.slice(ranked, 1, k)).alias("_p", "x")).select("left_id", F.col("x.id").alias("right_id"), (F.col("_p") + 1).alias("rank"))


# ---- recommender over categories -------------------------------------------------------------------------

# fixed values: allowed types of a target in priority order, wanted tags, ability ranges, nudges, regions
TARGET_TYPES = {"marathon": ("marathon", "half_marathon", "road_running"), "trail": ("trail", "ultra_trail", "utmb"), "utmb": ("utmb", "ultra_trail")}
TARGET_TAGS = {
    "marathon": ("MARATHON", "FIRST_MARATHON", "CITY_ROUTE"),
    "trail": ("TRAIL", "FIRST_TRAIL", "MOUNTAIN_ROUTE"),
    "utmb": ("UTMB", "UTMB_QUALIFIER", "WORLD_CLASS_EVENT"),
}
COMPLETED_RANGES = {
    "none": (1, 3, 4), "five_k": (1, 3, 4), "ten_k": (1, 3, 4), "half_marathon": (3, 5, 6), "marathon": (4, 6, 7),
    "trail_20k": (4, 5, 6), "trail_30k": (5, 7, 8), "trail_50k": (7, 8, 9), "trail_100k": (9, 10, 10),
}
EXPERIENCE_NUDGE = {"beginner": -1, "foundation": 0, "intermediate": 0, "advanced": 1, "elite": 2}
OVERSEAS = ("asia", "europe", "north_america", "other_overseas")


def ability_range(longest: str, experience: str) -> tuple[int, int, int]:
    """Lowest, highest and challenge level of a runner, each within 1 to 10."""
    return tuple(max(1, min(10, v + EXPERIENCE_NUDGE[experience])) for v in COMPLETED_RANGES[longest])


def recommend_categories(races: DataFrame, profile: Mapping[str, object], top: int = 5) -> DataFrame:
    """Scores every race x category for a runner profile; best ``top`` by type priority, then score.

    races: ``type, region, tags array<string>, categories array<struct<distanceKm, difficultyLevel 'L1'.., beginnerFriendly>>``.
    profile: targetRaceType, targetDistance, longestCompletedRace, runnerExperience, regionPreference, travelScope,
    isFirstTrail, hasPersonalBest. Ties keep input order through ``ord`` if the races have it.
    """
    types = TARGET_TYPES[profile["targetRaceType"]]
    overseas = F.col("region").isin(*OVERSEAS)
    wish, scope = profile["regionPreference"], profile["travelScope"]
    home = {"nationwide": ~overseas, "overseas": overseas}.get(wish, F.col("region") == F.lit(wish))
    allowed = {"overseas": F.lit(True), "nationwide": ~overseas}.get(scope, home)
    rows = races.where(F.col("type").isin(*types) & allowed).withColumn("category", F.explode("categories"))
    low, high, challenge = ability_range(profile["longestCompletedRace"], profile["runnerExperience"])
    level = F.regexp_replace("category.difficultyLevel", "^L", "").cast("int")
    rows = rows.where(level <= challenge)
    first_trail = bool(profile.get("isFirstTrail"))
    wanted = [*TARGET_TAGS[profile["targetRaceType"]], *(("FIRST_TRAIL", "BEGINNER", "MODERATE") if first_trail else ())]
    priority = rank_of("type", types)
    gap = F.abs(F.col("category.distanceKm") - F.lit(float(profile["targetDistance"])))
    if wish == "nationwide":
        region = F.lit(10)
    elif wish == "overseas":
        region = F.when(overseas, 15).otherwise(4)
    else:
        region = F.when(F.col("region") == F.lit(wish), 15)
        region = region.when(~overseas, 8) if scope == "nationwide" else region
        region = region.otherwise(6 if scope == "overseas" else 0)
    tags = F.least(F.lit(8), 2 * F.size(F.filter("tags", lambda t: t.isin(*wanted))))
    if first_trail:
        tags = tags + F.when(F.col("category.beginnerFriendly"), 2).otherwise(0)
    tags = F.least(F.lit(10), tags + (2 if profile.get("hasPersonalBest") else 0))
    score = additive_score(
        F.when(priority == 0, 25).when(priority == 1, 16).otherwise(8), stepwise(gap, [(1, 20), (10, 14), (25, 8)]),
        F.when(level.between(low, high), 30).when(level <= challenge, 18).otherwise(0), region, tags,
    )
    ordinal = ["ord"] if "ord" in races.columns else []
    return rows.withColumns({"type_priority": priority, "score": score}).orderBy("type_priority", F.desc("score"), *ordinal).limit(top)


# ---- recommender over cards ------------------------------------------------------------------------------

TRAIL_GOALS = ("first_trail", "challenge_50k", "challenge_100k", "scenic_trail")
# fixed values: target distance -> nominal kilometres, and (points, low, high, low included) in order; highs are included
NOMINAL_KM = {"lte30": 30, "30_50": 50, "50_100": 100, "gt100": 100}
DISTANCE_STEPS = {
    "lte30": ((25, None, 30, False), (16, None, 50, False), (7, None, 100, False)),
    "30_50": ((25, 30, 50, False), (16, 20, 60, False), (7, None, 100, False)),
    "50_100": ((25, 50, 100, False), (16, 40, 120, False), (7, 30, None, True)),
    "gt100": ((25, 100, None, False), (16, 80, None, True), (7, 50, None, True)),
}


def within(km: Column, low: float | None, high: float | None, low_included: bool) -> Column:
    above = F.lit(True) if low is None else (km >= low) if low_included else (km > low)
    return above & (F.lit(True) if high is None else km <= high)


def distance_points(km: Column, target: str) -> Column:
    """Points of one distance for a target interval; null or 0 counts as unknown (10)."""
    out = F.lit(0)
    for points, *bounds in reversed(DISTANCE_STEPS[target]):
        out = F.when(within(km, *bounds), F.lit(points)).otherwise(out)
    return F.when(km.isNull() | (km == 0), F.lit(10)).otherwise(out)


def card_score(profile: Mapping[str, str]) -> Column:
    """Match score 0..100 of a card row.

    Card columns: type, categories array<struct<distanceKm>>, difficulty, region, registrationUrl, sourceUrl,
    registrationStatus, raceDate, hasDistance, hasElevation (the texts are known).
    """
    goal, stage, target = profile["goal"], profile["stage"], profile["targetDistance"]
    kind, level = F.col("type"), F.col("difficulty")
    if goal == "any":
        type_points = F.when(kind == "other", 16).otherwise(22)
    elif goal in ("first_half", "first_marathon"):
        best, second = ("half_marathon", "marathon") if goal == "first_half" else ("marathon", "half_marathon")
        type_points = F.when(kind == best, 30).when(kind == second, 12).otherwise(0)
    else:
        type_points = F.when(kind.isin("trail", "ultra_trail"), 30).otherwise(0) if goal in TRAIL_GOALS else F.lit(0)
    km = F.filter(F.transform("categories", lambda c: c["distanceKm"]), lambda d: d.isNotNull() & (d != 0))
    if target == "any" or (stage == "any" and goal == "any"):
        distance = F.when(~F.col("hasDistance"), 8).when(F.size("categories") >= 2, 22).otherwise(18)
    else:
        points, *bounds = DISTANCE_STEPS[target][0]
        close = F.get(F.array_sort(F.transform(km, lambda d, i: F.struct(F.abs(d - NOMINAL_KM[target]).alias("g"), i.alias("i"), d.alias("d")))), 0)["d"]
        distance = F.when(F.size(km) == 0, 10).when(F.exists(km, lambda d: within(d, *bounds)), points).otherwise(distance_points(close, target))
    longest = nested_max_floor0(km)
    if goal == "challenge_100k":
        fit = F.when((longest >= 90) & (level == "high_challenge"), 15).when(longest >= 50, 8).otherwise(0)
    elif goal == "challenge_50k":
        fit = F.when((longest >= 40) & (longest < 100), 15).when(longest >= 100, 6).otherwise(4)
    elif stage == "any" and goal == "any":
        fit = F.when(level == "unknown", 6).when(level == "high_challenge", 8).otherwise(12)
    elif stage == "beginner" or goal == "first_half":
        fit = F.when(level == "beginner", 15).when(level == "intermediate", 9).otherwise(0)
    elif stage != "trail" and goal == "first_trail":
        fit = F.when(longest >= 100, 0).when(level.isin("beginner", "intermediate"), 15).when(level == "challenge", 7).otherwise(3)
    elif stage == "advanced":
        fit = F.when(level.isin("challenge", "high_challenge"), 15).otherwise(8)
    else:
        fit = F.when(level == "unknown", 5).otherwise(11)
    region = F.lit(8) if profile["region"] == "all" else F.when(F.col("region") == F.lit(profile["region"]), 10).otherwise(0)
    reg, src, status = has_text("registrationUrl"), has_text("sourceUrl"), F.col("registrationStatus")
    if profile["registrationPreference"] == "any":
        registration = F.when(reg, 10).when(src, 7).when(status == "unknown", 3).otherwise(5)
    else:
        registration = F.when((status == "registration_open") & reg, 10).when(src, 6).when(status == "unknown", 2).otherwise(0)
    minus = lambda c, n: F.when(c, F.lit(n)).otherwise(0)
    complete = 10 - minus(~has_text("raceDate"), 2) - minus(~reg & ~src, 2) - minus(status == "unknown", 1) - minus(~F.col("hasDistance"), 4) - minus(F.size("categories") == 0, 2)
    if goal in TRAIL_GOALS:
        complete = complete - minus(~F.col("hasElevation"), 2)
    return additive_score(type_points, distance, fit, region, registration, F.greatest(F.lit(0), complete))


def recommend_cards(cards: DataFrame, profile: Mapping[str, str], threshold: int = 70, top: int = 10) -> DataFrame:
    """Cards that score at least ``threshold``; best ``top`` by score, then date."""
    scored = cards.withColumn("match_score", card_score(profile)).where(F.col("match_score") >= threshold)
    return scored.orderBy(F.desc("match_score"), F.col("raceDate").asc_nulls_last()).limit(top)


def within_goal(low: float | None, high: float | None) -> Column:
    """Any category within a distance range (hard filter of a goal)."""
    return any_nested("categories", lambda c: (c["distanceKm"] >= F.lit(low if low is not None else 0.0)) & (c["distanceKm"] <= F.lit(high if high is not None else 1e9)))
