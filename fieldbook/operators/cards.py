"""Cards and decision pages: merged records, shown card columns, recommendation texts, advice by category, questions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import display as dp
from ..functions import text as tx
from ..functions.dates import countdown_days, strict_date
from .catalog import has_text, nested_max_floor0, truthy_number
from .normalize import connector_distance, type_by_distance

TRAIL = ("trail", "ultra_trail")
# fixed values: how cards read names, states, provinces and difficulties
CARD_TRAIL = r"(?i)越野|跑山|山径|trail|贡嘎|FUGA"
PAGE_TRAIL = r"(?i)越野|跑山|山径|穿越|trail|贡嘎|崇礼|柴古|莫干|武功山|168"
CARD_STATUS = ((r"lottery|抽签|摇号", "lottery"), (r"waiting|候补|等候", "registration_open"), (r"closed|截止|关闭", "closed"), (r"finished|结束|cancel|取消", "finished"))
CARD_STATUS_LATE = ((r"open|报名|点此", "registration_open"), (r"upcoming|即将", "upcoming"))
PAGE_STATUS = ((r"lottery|抽签|摇号", "lottery"), (r"closed|截止|关闭", "closed"), (r"finished|结束", "finished"), (r"upcoming|即将", "upcoming"), (r"open|报名", "registration_open"))
OVERSEAS_PROVINCE = r"澳大利亚|美国|日本|韩国|欧洲|海外"
DIFFICULTIES = {"half_marathon": "beginner", "marathon": "intermediate"}
UNNAMED = "未命名组别"
#: places of curated records by how they begin: (start, province, city, part of the text that decides the city, district, part that decides it)
CURATED_PLACES = (
    ("上海", "上海", "上海市", None, "黄浦区", "黄浦"), ("北京", "北京", "北京市", None, None, None), ("福建", "福建", "厦门市", "厦门", None, None), ("香港", "香港", "香港", None, "西贡", "西贡"), ("四川", "四川", "甘孜州", "甘孜", "泸定县", "泸定"),
)
#: advice by lowest distance: (trail?, kilometres from, text)
VERDICTS = ((100, "长距离高消耗越野组别，只适合有成熟百公里经验的跑者。"), (50, "进阶越野挑战组别，需要稳定长距离训练和爬升能力。"), (0, "中短距离越野组别，适合想体验山地路线的跑者谨慎评估。"))
ROAD_VERDICTS = ((40, "全马距离组别，适合已有系统备赛周期的跑者。"), (20, "半马距离组别，适合有连续跑步习惯的跑者。"), (0, "短距离组别，适合作为轻量参赛或亲友同行选择。"))
FIT_TRAIL = (
    (100, ("完成过 50K 以上越野", "具备夜跑与长时间补给经验", "能独立处理山地天气和装备问题")), (50, ("有马拉松或越野完赛经验", "近三个月有稳定爬升训练", "愿意提前做路线和装备准备")), (0, ("有连续跑步基础", "想尝试山地路线", "能接受非铺装路面和爬升变化")),
)
FIT_ROAD = ((40, ("完成过半马", "有 12 周以上系统备赛时间", "近期训练稳定且无明显伤病")), (20, ("有 10K 以上训练基础", "希望挑战半马距离", "需要一个清晰比赛目标")), (0, ("首次参赛跑者", "亲友同行", "想低压力体验赛事氛围")))
UNFIT_TRAIL = ((50, ("没有越野补给和装备经验", "近期缺少长距离训练", "无法接受天气和路线不确定性")),)
UNFIT_ROAD = ((40, ("近期跑量不足", "仍在伤病恢复期", "没有完整备赛周期")), (20, ("完全没有连续跑步基础", "无法按计划完成赛前训练")))
CHECKS = ("报名前优先核对官方强制装备和路线说明。", "报名前优先核对官方比赛规程和关门要求。")
QUESTIONS = ("如何报名{0}？", "参加{0}住哪里更方便？", "{0}比赛当天如何到达？", "{0}有哪些组别？")
ANSWERS = {
    "open": "当前有可访问的报名或赛事来源入口，请以官方或报名平台页面的最新状态为准。", "closed": "当前没有可靠的开放报名入口，建议等待官方或报名平台更新。",
    "stay": "优先比较赛事地点附近、交通便利区域和综合性价比区域。住宿选择应围绕距离、交通和价格三个因素判断。", "way": "请优先核对官方发布的比赛地点、集合点和交通接驳信息，再结合机场、高铁站和市内公共交通规划到达方式。",
    "listed": "当前页面收录的赛事组别包括：{0}。具体报名组别、资格和名额请以官方信息为准。", "unlisted": "当前页面暂未收录完整组别信息，请以官方发布的报名信息为准。",
}
GUIDE = {
    "level": ("适合有稳定跑步基础，并愿意为爬升、下坡和补给做专项准备的跑者。", "适合能保持规律跑步，并愿意围绕比赛日期完成阶段性备赛的跑者。"), "preparation": ("围绕 {0} 建立训练计划，赛前至少完成一次接近比赛强度的关键训练。", "先确认官方距离和路线，再决定训练周期。"),
    "gear": ("优先准备越野鞋、软水壶或水袋、能量补给、防风雨层和官方要求的强制装备。", "优先准备已磨合跑鞋、比赛服装、号码布固定方式和赛中补给。"), "caution": ("累计爬升 {0}m 会显著影响体感强度，配速目标应比平路保守。", "请在报名前核对官方规程、关门时间、补给安排和退改政策。"),
    "finish": ("用官方关门时间倒推分段目标，宁可前半程保守，也不要过早透支。", "比赛日以稳定完赛为第一目标，遇到异常天气或身体信号及时调整。"),
}


def filled(template: str, value: Column) -> Column:
    """A template with its one place filled."""
    head, tail = template.split("{0}")
    return F.concat(F.lit(head), value, F.lit(tail))


def first_step(km: Column, steps: Sequence[tuple[float, object]]) -> Column:
    """What belongs to the highest step that the distance reaches; null below all."""
    value = lambda v: F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v)
    return F.coalesce(*[F.when(km >= low, value(v)) for low, v in steps])


def curated_place(location: Column) -> Column:
    """``struct<province, city, district, venue>`` of a curated place text, by how it begins; else the text is the province."""
    c = tx.js_trim(location)
    full = F.when(c != "", c)
    part = lambda value, sign: F.lit(None).cast("string") if value is None else F.lit(value) if sign is None else F.when(c.contains(sign), F.lit(value))
    place = lambda p, city, dist: F.struct(p.alias("province"), city.alias("city"), dist.alias("district"), full.alias("venue"))
    none = F.lit(None).cast("string")
    out = place(full, none, none)
    for start, province, city, city_sign, district, district_sign in reversed(CURATED_PLACES):
        out = F.when(c.startswith(start), place(F.lit(province), part(city, city_sign), part(district, district_sign))).otherwise(out)
    return out


def curated_records(rows: DataFrame) -> DataFrame:
    """Curated rows as merged records: ``event_id, event_name, event_year, event_date, event_location, event_status, categories array<string>, cover_image, source_url``."""
    c = F.col
    year = c("event_year").cast("string")
    name = F.when(year.isNotNull() & (c("event_year") != 0) & ~F.contains("event_name", year), F.concat(year, c("event_name"))).otherwise(c("event_name"))
    place = curated_place(c("event_location"))
    item = lambda n: F.struct(n.alias("category_name"), connector_distance(n, "catalog").alias("distance_km"), F.lit(None).cast("double").alias("elevation_gain"), F.lit(None).cast("double").alias("registration_fee"))
    return rows.select(
        c("event_id").alias("id"), tx.catalog_name(name).alias("normalized_name"), F.array(name).alias("original_names"), c("event_year").alias("edition_year"), F.split_part("event_date", F.lit("/"), F.lit(1)).alias("race_date"), place["province"].alias("province"), place["city"].alias("city"),
        place["district"].alias("district"), place["venue"].alias("venue"), c("event_status").alias("registration_status"), F.lit(None).cast("string").alias("registration_url"), "cover_image", F.transform("categories", item).alias("categories"), F.array(F.lit("zuicool")).alias("source_ids"),
        "source_url", F.when(has_text("cover_image"), F.array().cast("array<string>")).otherwise(F.array(F.lit("coverImage"))).alias("missing_fields"), F.lit(90.0).alias("confidence"),
    )


def seed_records(seeds: DataFrame) -> DataFrame:
    """Seed rows as merged records: sources default to one, the registration comes from the registration platform if it is among them."""
    ids = F.when(F.size("source_ids") > 0, F.col("source_ids")).otherwise(F.array(F.lit("zuicool")))
    primary = F.get(ids, F.lit(0))
    name = F.when(has_text("name"), F.col("name"))
    return seeds.select(
        "id", tx.catalog_name(F.coalesce(name, "id")).alias("normalized_name"), F.when(name.isNull(), F.array().cast("array<string>")).otherwise(F.array(name)).alias("original_names"), F.substring("race_date", 1, 4).try_cast("int").alias("edition_year"), "race_date", "province", "city", "district",
        F.lit(None).cast("string").alias("venue"), "registration_status", "registration_url", "cover_image", "categories", ids.alias("source_ids"), "source_url", "missing_fields", "confidence", primary.alias("primary_source"),
        F.when(F.array_contains(ids, "zuicool"), "zuicool").otherwise(primary).alias("registration_source"),
    )


def _distances() -> Column:
    return F.transform("categories", lambda c: c["distance_km"])


def card_status(value: Column, url: Column, date: Column, as_of: str) -> Column:
    """Registration status of a card: the race day, then a link, then words, then the date, then weaker words."""
    left = countdown_days(strict_date(date), as_of)
    said = F.coalesce(value, F.lit(""))
    late = F.when(left < 0, "finished").when((said == "") | (said == "1"), "unknown").otherwise(tx.first_match(said, CARD_STATUS_LATE, F.lit("unknown")))
    return F.when(left == 0, "racing").when(has_text(url), "registration_open").otherwise(tx.first_match(said, CARD_STATUS, late))


def page_status(value: Column, any_link: Column, date: Column, as_of: str) -> Column:
    """Registration status of a page: the date first, then a link of the race or of a category, then words."""
    left = countdown_days(strict_date(date), as_of)
    return F.when(left == 0, "racing").when(left < 0, "finished").when(any_link, "registration_open").otherwise(tx.first_match(F.coalesce(value, F.lit("")), PAGE_STATUS, F.lit("unknown")))


def cards(records: DataFrame, as_of: str) -> DataFrame:
    """Card columns of merged records (see :func:`curated_records`)."""
    c = F.col
    longest = F.coalesce(nested_max_floor0(_distances()), F.lit(0.0))
    kind = type_by_distance(c("normalized_name"), F.filter(_distances(), lambda x: F.coalesce(x != 0, F.lit(False))), CARD_TRAIL)
    r = records.withColumn("type", kind)
    trail = c("type").isin(*TRAIL)
    hard = F.when(trail & (longest >= 100), "high_challenge").when(trail & (longest >= 50), "challenge").when(trail, "intermediate")
    difficulty = F.coalesce(hard, *[F.when(c("type") == k, F.lit(v)) for k, v in DIFFICULTIES.items()], F.lit("unknown"))
    provinces = [("|".join(ps), region) for region, ps in tx.REGION_PROVINCES.items()]
    fees = F.transform("categories", lambda x: x["registration_fee"])
    main, sub = dp.fee_lines(fees)
    n = F.size("categories")
    where = F.when(has_text("city"), F.when(has_text("district"), F.concat_ws(" ", "city", "district")).otherwise(c("city")))
    summary = F.array_join(F.array_compact(F.array(where, F.when(n > 0, F.concat(n.cast("string"), F.lit(" 个组别"))), F.when(has_text("registration_url"), "报名信息已接入").otherwise("报名信息待更新"))), " · ")
    left = countdown_days(strict_date(c("race_date")), as_of)
    countdown = F.when(~has_text("race_date"), "具体日期待更新").when(left > 0, F.concat(F.lit("距离开赛 "), left.cast("string"), F.lit(" 天"))).when(left == 0, "今日开赛").otherwise("已结束")
    return r.withColumns(
        {
            "name": F.coalesce(F.get("original_names", F.lit(0)), c("normalized_name")), "region": F.when(has_text("province"), tx.first_match(c("province"), [*provinces, (OVERSEAS_PROVINCE, "overseas")], F.lit("unknown"))).otherwise("unknown"), "difficulty": difficulty,
            "month": F.substring("race_date", 6, 2).try_cast("int"), "date_text": dp.card_date_text(c("race_date"), c("edition_year")), "days_until": left, "countdown_text": countdown, "registration_status": card_status(c("registration_status"), c("registration_url"), c("race_date"), as_of),
            "distances_text": dp.distances_text(_distances()), "elevation_text": dp.elevations_text(F.transform("categories", lambda x: x["elevation_gain"])), "price_text": dp.price_text(fees), "fee_main": main, "fee_sub": sub, "summary": summary, "longest_km": longest,
        }
    )


def valuable(cards_: DataFrame) -> DataFrame:
    """Cards worth a recommendation: not closed, not over; undated ones only with a live status. By date (undated last), then confidence."""
    status = F.col("registration_status")
    dated = F.coalesce(F.col("days_until") >= 0, F.lit(True))
    ok = ~status.isin("closed", "finished") & F.when(has_text("race_date"), dated).otherwise(status.isin("registration_open", "upcoming", "lottery"))
    return cards_.where(ok).orderBy(strict_date(F.col("race_date")).asc_nulls_last(), F.col("confidence").desc_nulls_last())


def _listed(rules: Sequence[tuple[Column | bool, Column | str]], most: int) -> Column:
    """Texts of the rules that hold, in order, each once, at most so many."""
    one = lambda ok, text: F.when(F.coalesce(ok if isinstance(ok, Column) else F.lit(ok), F.lit(False)), text if isinstance(text, Column) else F.lit(text))
    return F.slice(F.array_distinct(F.array_compact(F.array(*[one(*r) for r in rules]))), 1, most)


def card_reasons(profile: Mapping[str, str], closest: Column) -> Column:
    """Up to three reasons for a card. ``closest``: distance nearest to the target; the profile has goal, stage, region, targetDistance."""
    c, goal, stage = F.col, profile["goal"], profile["stage"]
    link, source, dated, far, n = has_text("registration_url"), has_text("source_url"), has_text("race_date"), c("days_until") > 60, F.size("categories")
    known_km, known_climb = c("distances_text") != dp.DISTANCE_PENDING, c("elevation_text") != dp.ELEVATION_PENDING
    trail, kind, km = c("type").isin(*TRAIL), c("type"), c("longest_km")
    look, prepare = "可先查看赛事来源页面，确认报名安排。", "距离比赛还有较长准备周期，适合安排系统训练。"
    if stage == "any" and goal == "any":
        return _listed(
            [(link, "有报名入口，可以进一步查看。"), (~link & source, look), (dated, "比赛日期明确，便于安排行程。"), (known_km & (n > 0), "距离和组别信息较完整。"), (c("registration_status") != "unknown", "报名状态清晰，便于判断是否行动。"), (far, prepare)], 3
        )
    ranges = {"lte30": closest <= 30, "30_50": (closest > 30) & (closest <= 50), "50_100": (closest > 50) & (closest <= 100), "gt100": closest > 100}
    close = F.coalesce((closest != 0) & ranges.get(profile["targetDistance"], F.lit(False)), F.lit(False))
    return _listed(
        [
            ((kind == "half_marathon") & (goal == "first_half"), "≤30KM 区间适合作为首个半马目标。"), ((kind == "marathon") & (goal == "first_marathon"), "30KM - 50KM 区间覆盖全马目标，适合从半马进阶。"), ((kind == "marathon") & (stage == "half_marathon"), "路跑赛事结构清晰，方便从半马过渡到全马。"),
            (trail & (goal == "first_trail"), F.when(km >= 100, "距离偏长，不建议作为首次越野的唯一选择。").otherwise("距离适合作为首次越野尝试。")), ((km >= 40) & (km < 100) & (goal == "challenge_50k"), "组别距离接近 50K，适合作为进阶挑战。"),
            ((km >= 90) & (goal == "challenge_100k"), "长距离组别匹配 100K 挑战目标。"), (trail & (goal == "scenic_trail"), "越野路线更符合风景型赛事偏好。"), (close, "组别距离接近你的目标距离。"), ((c("region") == profile["region"]) & (profile["region"] != "all"), "所在地区符合你的偏好。"),
            (has_text("city"), F.concat(F.lit("比赛位于"), c("city"), F.lit("，便于你提前评估交通和住宿。"))), (link, "报名信息完整，可以直接行动。"), (~link & source, look), (~link & ~source & (c("registration_status") == "unknown"), "报名信息仍不完整，适合作为观察候选。"),
            (n >= 2, F.concat(n.cast("string"), F.lit(" 个组别可选，方便比较报名选择。"))), (trail & known_climb, "累计爬升信息有助于判断赛事难度。"), (trail & ~known_climb, "爬升信息待补充，报名前建议查看官方信息。"), (c("days_until").between(1, 30), "比赛时间较近，适合已有训练基础的跑者。"),
            (far, prepare), (~dated, "比赛日期待补充，建议先作为备选观察。"),
        ],
        3,
    )


def card_risk(goal: str) -> Column:
    """The risk note of a card."""
    long = (F.col("longest_km") >= 100) | F.lit(goal == "challenge_100k")
    return (
        F.when(long, "100K 越野对训练量、装备、补给和夜间能力要求较高，请谨慎评估后报名。").when(F.col("type").isin(*TRAIL), "请重点关注累计爬升、关门时间、强制装备和近期训练量，再决定是否报名。")
        .otherwise("请结合近期训练量、伤病情况和赛事官方关门时间，再决定是否报名。")
    )


def category_conclusion(profile: Mapping[str, object]) -> Column:
    """What a recommended category is good for, from the runner's profile; else from its distance."""
    target, longest, kind = profile.get("targetDistance"), profile.get("longestCompletedRace"), profile.get("targetRaceType")
    fixed = [
        (kind == "trail" and bool(profile.get("isFirstTrail")), "适合作为你的第一场越野赛"), (target == 30 and longest == "half_marathon", "适合从半马走向 30KM 越野"), (target == 50 and longest == "trail_30k", "适合从 30KM 越野进阶到 50KM"),
        (kind == "marathon" and longest == "half_marathon", "适合作为你的首马目标赛事"), (kind == "utmb", "适合作为 UTMB 积分积累赛事"),
    ]
    for ok, words in fixed:
        if ok:
            return F.lit(words)
    return F.when(F.col("type").isin(*TRAIL) & (F.col("category.distanceKm") >= 50), "适合从中距离越野走向更长距离挑战").otherwise("适合作为你下一阶段的比赛选择")


def category_reasons(profile: Mapping[str, object], levels: tuple[int, int, int]) -> Column:
    """Up to four reasons for a recommended category; ``levels``: the runner's lowest, highest and challenge level."""
    level = F.regexp_replace("category.difficultyLevel", "^L", "").cast("int")
    low, high, challenge = levels
    anywhere = profile["regionPreference"] in ("nationwide", "overseas")
    return _listed(
        [
            (True, "赛事类型符合你的目标方向。"), (F.abs(F.col("category.distanceKm") - F.lit(float(profile["targetDistance"]))) <= 10, "组别距离接近你的目标距离。"), (level.between(low, high), "难度落在你的当前能力范围内。"),
            (~level.between(low, high) & (level <= challenge), "难度略高于当前能力区间，可作为挑战目标。"), (F.lit(anywhere) | (F.col("region") == profile["regionPreference"]), "地区符合你的参赛偏好。"), (bool(profile.get("hasPersonalBest")), "已参考你的近期成绩。"),
            (F.lit(bool(profile.get("isFirstTrail"))) & F.col("category.beginnerFriendly"), "更适合作为入门越野选择。"),
        ],
        4,
    )


def category_risk(profile: Mapping[str, object], levels: tuple[int, int, int]) -> Column:
    """The risk note of a recommended category: every hint that applies, or a general one."""
    level = F.regexp_replace("category.difficultyLevel", "^L", "").cast("int")
    hints = _listed(
        [
            (level > levels[1], "这场比赛略高于你当前能力区间，建议作为挑战目标，并提前准备专项训练。"), ((level >= 5) & bool(profile.get("isFirstTrail")), "首次越野建议重点准备爬升、下坡、补给和装备。"), (~F.col("category.beginnerFriendly"), "这场比赛不适合作为完全新手的第一场比赛。"),
            (profile["targetDistance"] >= 50, "长距离赛事对耐力、补给和恢复要求较高，建议确认近期训练量后再报名。"),
        ],
        4,
    )
    general = F.array(F.lit("请结合近期训练量、伤病情况和赛事官网关门时间，再决定是否报名。"))
    return F.concat(F.lit("风险提示："), F.array_join(F.when(F.size(hints) > 0, hints).otherwise(general), ""))


def category_advice(kind: Column, c: Column) -> Column:
    """``struct`` of verdict, advice, who it is for and not for, and a guide, for a category of a race type; nulls where nothing is known."""
    km, gain, cutoff = truthy_number(c["distance_km"]), truthy_number(c["elevation_gain"]), F.when(c["cutoff_time"] != "", c["cutoff_time"])
    trail = kind.isin(*TRAIL)
    parts = F.array_compact(
        F.array(
            F.when(km.isNotNull(), F.concat(F.lit("先按 "), dp.kilometres(km), F.lit(" 的距离评估近期训练量"))), F.when(gain.isNotNull(), F.concat(F.lit("再按累计爬升 "), dp.number_text(gain), F.lit("m 检查爬坡和下坡能力"))),
            F.when(cutoff.isNotNull(), "最后对照官方关门时间倒推配速和补给计划"),
        )
    )
    none = F.array().cast("array<string>")
    guide = {
        "level": F.when(trail, GUIDE["level"][0]).otherwise(GUIDE["level"][1]), "preparation": F.when(km.isNotNull(), filled(GUIDE["preparation"][0], dp.kilometres(km))).otherwise(GUIDE["preparation"][1]), "gear": F.when(trail, GUIDE["gear"][0]).otherwise(GUIDE["gear"][1]),
        "caution": F.when(gain.isNotNull(), filled(GUIDE["caution"][0], dp.number_text(gain))).otherwise(GUIDE["caution"][1]), "finish": F.when(cutoff.isNotNull(), GUIDE["finish"][0]).otherwise(GUIDE["finish"][1]),
    }
    unfit = F.when(trail & (F.coalesce(km, F.lit(0.0)) >= 50), first_step(km, UNFIT_TRAIL)).otherwise(first_step(km, UNFIT_ROAD))
    return F.struct(
        F.when(trail & km.isNotNull() & gain.isNotNull(), first_step(km, VERDICTS)).otherwise(first_step(km, ROAD_VERDICTS)).alias("verdict"),
        F.when(F.size(parts) > 0, F.concat(F.array_join(parts, "，"), F.lit("。"), F.when(trail, CHECKS[0]).otherwise(CHECKS[1]))).alias("advice"),
        F.coalesce(F.when(trail, first_step(km, FIT_TRAIL)).otherwise(first_step(km, FIT_ROAD)), none).alias("recommended_for"), F.coalesce(unfit, none).alias("not_recommended_for"),
        F.when(km.isNotNull() | gain.isNotNull() | cutoff.isNotNull(), F.struct(*[v.alias(k) for k, v in guide.items()])).alias("guide"),
    )


def decision_pages(records: DataFrame, as_of: str) -> DataFrame:
    """``id, name, type, registration_status, date_text, location_text, countdown_text, categories, category_text, faq`` of merged records.

    Category ids count the categories that are shown: those with a name, a distance, a fee or a link. Categories have ``cutoff_time,
    registration_url`` besides the fields of :func:`curated_records`.
    """
    c = F.col
    words = F.concat_ws(" ", "normalized_name", F.array_join("original_names", " "))
    km, gain = (F.transform("categories", _field(f)) for f in ("distance_km", "elevation_gain"))
    longest, steepest = F.coalesce(F.array_max(km), F.lit(0.0)), F.coalesce(F.array_max(gain), F.lit(0.0))
    full = F.exists(km, lambda x: (x >= 40) & (x < 50))
    kind = (
        F.when(words.rlike(PAGE_TRAIL) | (steepest >= 500), F.when(longest >= 50, "ultra_trail").otherwise("trail")).when(words.rlike("半程|半马"), "half_marathon").when(words.rlike("马拉松") | full, "marathon").otherwise("other")
    )
    link = has_text("registration_url") | F.exists("categories", lambda x: F.coalesce(x["registration_url"] != "", F.lit(False)))
    name = F.coalesce(F.get("original_names", F.lit(0)), c("normalized_name"))
    r = records.withColumns({"type": kind, "registration_status": page_status(c("registration_status"), link, c("race_date"), as_of), "name": name})
    useful = F.filter("categories", lambda x: F.coalesce(x["category_name"] != "", F.lit(False)) | F.coalesce(x["distance_km"] != 0, F.lit(False)) | F.coalesce(x["registration_fee"] != 0, F.lit(False)) | F.coalesce(x["registration_url"] != "", F.lit(False)))
    shown = F.transform(
        useful,
        lambda x, i: F.struct(
            F.concat_ws("-", c("id"), i.cast("string")).alias("id"), F.coalesce(x["category_name"], F.concat(F.lit("组别 "), (i + 1).cast("string"))).alias("name"), x["distance_km"].alias("distance_km"), x["elevation_gain"].alias("elevation_gain"), x["registration_fee"].alias("fee"),
            F.coalesce(x["registration_url"], c("registration_url")).alias("registration_url"), category_advice(c("type"), x).alias("advice"),
        ),
    )
    r = r.withColumn("categories", shown)
    known = F.array_distinct(dp.known(F.transform("categories", lambda x: x["distance_km"])))
    names = F.slice(F.filter(F.transform("categories", lambda x: x["name"]), lambda n: n != ""), 1, 3)
    category_text = F.when(F.size(known) > 0, F.array_join(F.transform(known, dp.kilometres), " / ")).when(F.size(names) > 0, F.array_join(names, " / "))
    left = countdown_days(strict_date(c("race_date")), as_of)
    r = r.withColumns({"category_text": category_text, "date_text": F.coalesce(dp.weekday_date_text(c("race_date")), F.when(has_text("race_date"), c("race_date"))), "location_text": dp.place_line(c("province"), c("city"), c("district"))})
    r = r.withColumn("countdown_text", F.when(left > 0, F.concat(F.lit("距离比赛 "), left.cast("string"), F.lit(" 天"))).when(left == 0, "今日比赛"))
    answers = [
        F.when((c("registration_status") == "registration_open") & (has_text("registration_url") | has_text("source_url")), ANSWERS["open"]).otherwise(ANSWERS["closed"]), F.lit(ANSWERS["stay"]), F.lit(ANSWERS["way"]),
        F.when(has_text("category_text"), filled(ANSWERS["listed"], c("category_text"))).otherwise(ANSWERS["unlisted"]),
    ]
    faq = F.array(*[F.struct(filled(q, c("name")).alias("question"), a.alias("answer")) for q, a in zip(QUESTIONS, answers)])
    return r.select("id", "name", "type", "registration_status", "date_text", "location_text", "countdown_text", "categories", "category_text", faq.alias("faq"))


def _field(name: str):
    return lambda x: F.coalesce(x[name], F.lit(0.0))


def category_labels(categories: Column) -> Column:
    """Distinct labels of categories: their distance, else their name."""
    label = lambda x: F.coalesce(F.when(F.coalesce(x["distance_km"] != 0, F.lit(False)), dp.kilometres(x["distance_km"])), F.when(x["name"] != "", x["name"]))
    return F.array_distinct(F.array_compact(F.transform(categories, label)))


def curated_match(texts: DataFrame, id_col: str, name_col: str, curated: DataFrame, key: str, name: str, keywords: str) -> DataFrame:
    """The first curated event (by its ``ord``) of each row: equal id, else a name within the other, else a keyword in the name.

    ``curated`` is the curated list, a handful of rows by its nature: it becomes one array literal column, not a join of pairs.
    """
    listed = curated.agg(F.array_sort(F.collect_list(F.struct("ord", F.col(key).alias("id"), F.lower(F.regexp_replace(name, r"\s+", "")).alias("name"), F.col(keywords).alias("words")))).alias("_all"))
    mine = F.lower(F.regexp_replace(name_col, r"\s+", ""))
    fits = lambda e: (F.col(id_col) == e["id"]) | ((mine != "") & (F.contains(mine, e["name"]) | F.contains(e["name"], mine))) | F.exists(e["words"], lambda w: F.contains(mine, F.lower(w)))
    return texts.withColumn("_all", listed.scalar()).withColumn("curated_id", F.get(F.filter("_all", lambda e: F.coalesce(fits(e), F.lit(False))), F.lit(0))["id"]).drop("_all")


def analytics_events(rows: DataFrame, name: str, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Event rows: ``event_name, event_id, edition_id, source`` (home, share, direct or other) and the extra parameters that are set, as a map."""
    given = F.coalesce(F.col("source"), F.lit(""))
    source = F.when(given == "", "direct").when(given.isin("home", "share", "direct"), given).otherwise("other")
    pairs = reduce(lambda a, kv: F.concat(a, F.array(F.struct(F.lit(kv[0]).alias("k"), kv[1].cast("string").alias("v")))), (extra or {}).items(), F.array().cast("array<struct<k:string,v:string>>"))
    params = F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull()))
    return rows.select(F.lit(name).alias("event_name"), "event_id", "edition_id", source.alias("source"), params.alias("params"))
