"""Normalized rows: raw records and connector records brought to one form, with field sources, missing fields, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.display import number_text
from ..functions.unicode import slug
from .catalog import has_text

# fixed values: priorities of sources, words of placeholder categories
SOURCE_PRIORITY = {"runchina": 100, "itra": 90, "zuicool": 70}
NAMED_CATEGORIES = ((42.2, "全程马拉松"), (21.1, "半程马拉松"))
TRAIL_TYPES = ("trail", "ultra_trail", "utmb")
# fixed values: what makes a scraped name a race, by source: (words that rule it out, words that must be there)
LIKELY_RACE = {
    "runchina": ((r"系统|平台|公告|通知|征集|协会|服务|申报|监管|博览会",), r"(?i)马拉松|半程|半马|越野|跑"),
    "zuicool": (
        (r"(?i)^\s*(?:路跑报名|越野报名|赛事报名|报名|更多|全部赛事)\s*$", r"平台|系统|登录|注册|训练|装备|照片|成绩查询"),
        r"(?i)20\d{2}|马拉松|半程|半马|越野|百公里|百英里|trail|marathon|ultra|\d+\s?(?:km|公里)",
    ),
    "itra": (
        (r"(?i)^\s*(?:races?|race calendar|race results?|race map|events?|calendar)\s*$", r"(?i)login|sign in|register|organization|runner|contact|about|discover trail-running"),
        r"(?i)20\d{2}|\d+\s?(?:km|k(?![0-9A-Za-z_]))|trail|ultra|marathon|mountain",
    ),
}
# fixed values: distances and climbs in connector texts
CONNECTOR_DISTANCES = {
    "zuicool": ([(r"半程|半马", 21.1), (r"全程|全马", 42.2)], r"(\d+(?:\.\d+)?)\s?(?:km|KM|公里)"),
    "runchina": ([(r"半程|半马", 21.1), (r"全程|全马|马拉松", 42.2)], r"(\d+(?:\.\d+)?)\s?(?:km|KM|公里)"),
    "seed": ([(r"半程|半马", 21.1), (r"全程|全马|马拉松", 42.2)], r"(\d+(?:\.\d+)?)\s?(?:km|KM|公里|K)"),
    "catalog": ([(r"马拉松", 42.195)], r"(?i)(\d+(?:\.\d+)?)\s*(?:k|km|公里)"),
}
CONNECTOR_CLIMB = r"(?i)(?:累计爬升|爬升|D\+)\s*(\d{3,5})\s*(?:米|m)?"
CUTOFF = r"关门时间([^，。；;]+)"
CONNECTOR_FIELDS = ("name", "raceDate", "province", "city", "district", "venue", "registrationStatus", "statusText", "registrationUrl", "coverImage")
CATEGORY_SCHEMA = "array<struct<categoryName string, distanceKm string, elevationGain string, cutoffTime string, registrationFee string, categoryFee string, categoryRegistrationUrl string>>"


def likely_race(name: Column, source: str) -> Column:
    """Whether a scraped name looks like a race of that source."""
    out, must = LIKELY_RACE[source]
    ok = name.rlike(must)
    for pattern in out:
        ok = ok & ~name.rlike(pattern)
    return F.coalesce((name != "") & ok, F.lit(False))


def clean_title(title: Column) -> Column:
    """A scraped title without the name of its site and what follows 报名; null for an empty one."""
    return F.when(title != "", tx.js_trim(tx.rewrite(title, [(r"(?i)- 最酷ZUICOOL.*$", ""), (r"报名.*$", ""), (rf"{tx.WS}+", " ")])))


def connector_distance(text: Column, kind: str) -> Column:
    """Kilometres in a category name by the words of one connector; null where there are none."""
    named, pattern = CONNECTOR_DISTANCES[kind]
    km = F.regexp_extract(text, pattern, 1)
    return tx.first_match(text, named, F.when(km != "", km.cast("double")))


def connector_climb(text: Column) -> Column:
    m = F.regexp_extract(text, CONNECTOR_CLIMB, 1)
    return F.when(m != "", m.cast("int"))


def cutoff_text(text: Column) -> Column:
    """The phrase that states a cutoff time."""
    m = F.regexp_extract(text, CUTOFF, 0)
    return F.when(m != "", m)


def address_parts(address: Column) -> tuple[Column, Column, Column]:
    """Province, city and district of ``a / b / c``."""
    parts = F.filter(F.transform(F.split(F.coalesce(address, F.lit("")), "/"), tx.js_trim), lambda x: x != "")
    return tuple(F.get(parts, F.lit(k)) for k in range(3))


def date_location(value: Column) -> tuple[Column, Column, Column, Column, Column]:
    """Date, province, city, district and venue of ``2026.05.03 · a b c rest of it``."""
    halves = F.transform(F.split(value, "·"), tx.js_trim)
    day = lambda k: F.regexp_extract(F.get(halves, F.lit(0)), r"(20\d{2})[./-](\d{1,2})(?:[./-](\d{1,2}))?", k)
    date = F.when(day(3) != "", F.concat_ws("-", day(1), F.lpad(day(2), 2, "0"), F.lpad(day(3), 2, "0")))
    parts = F.filter(F.split(F.coalesce(F.get(halves, F.lit(1)), F.lit("")), rf"{tx.WS}+"), lambda x: x != "")
    venue = F.array_join(F.slice(parts, F.lit(4), F.greatest(F.size(parts), F.lit(1))), " ")
    return date, *(F.get(parts, F.lit(k)) for k in range(3)), F.when(venue != "", venue)


def category_names(value: Column) -> Column:
    """Names of a JSON array or of a delimited list; a JSON value of another kind is one name. Empty for an empty text."""
    trimmed = tx.js_trim(value)
    listed = F.from_json(trimmed, "array<string>")
    is_array = trimmed.startswith("[") & listed.isNotNull()
    scalar = trimmed.rlike(r'^(?:-?\d+(?:\.\d+)?|true|false|null|"[^"]*"|\{.*\})$')
    split = F.filter(F.transform(F.split(value, "[、,，/]"), tx.js_trim), lambda x: x != "")
    return F.when(F.coalesce(value, F.lit("")) == "", F.array().cast("array<string>")).when(is_array, listed).when(scalar, F.array(value)).otherwise(split)


def normalized_races(raw: DataFrame, as_of: str) -> DataFrame:
    """The normalized race of every raw one.

    raw: ``source, raw_id, source_url, raw_name, raw_date, raw_province, raw_city, raw_location, raw_distance, raw_elevation_gain,
    raw_difficulty, raw_type, raw_tags array<string>, raw_registration_status, raw_official_url, raw_registration_url``.
    """
    c = F.col
    text = lambda *names: F.coalesce(*[F.when(c(n) != "", c(n)) for n in names])
    year, month, date = tx.date_parts(c("_date"))
    province, city, region = tx.location_parts(c("raw_province"), c("raw_city"), c("raw_location"), c("raw_name"))
    words = F.concat_ws(" ", *[F.coalesce(c(n), F.lit("")) for n in ("raw_type", "raw_name", "raw_distance")], F.array_join(F.coalesce("raw_tags", F.array().cast("array<string>")), " "))
    # what several rules read is worked out once, in a step of its own: branches of rules don't share it
    r = raw.withColumns(
        {
            "_date": tx.date_match(F.when(c("raw_date") != "", c("raw_date"))), "_words": F.lower(words), "_km": F.lower(F.coalesce("raw_distance", "raw_type", "raw_name")),
        }
    ).withColumns(
        {
            "name": tx.display_name(c("raw_name")), "year": year, "month": month, "date": date, "province": province, "city": city, "region": region,
            "type": tx.race_type(c("_words")), "distance_km": tx.distance_km(c("_km")),
            "elevation_gain": tx.elevation_m(F.coalesce("raw_elevation_gain", "raw_difficulty")),
        }
    )
    r = r.withColumn("status", tx.race_status(F.coalesce("raw_registration_status", F.lit("")), tx_date(c("date")), c("year"), as_of))
    base = F.concat_ws("-", F.when(c("name") != "", c("name")), c("year").cast("string"), F.when(c("city") != "unknown", c("city")), F.coalesce("raw_id", "source"))
    r = r.withColumn("slug", F.regexp_replace(F.concat_ws("-", slug(base), tx.poly_hash(base)), "^-+", ""))
    source_if = lambda ok: F.when(F.coalesce(ok, F.lit(False)), c("source")).otherwise("placeholder")
    has = lambda n: has_text(n)
    sources = {
        "name": has("raw_name"), "type": has("raw_type") | has("raw_name"), "status": has("raw_registration_status"), "summary": F.lit(False), "year": c("year").isNotNull(),
        "month": c("month") > 0, "date": c("date").isNotNull(), "country": c("province") != "unknown", "province": c("province") != "unknown", "city": c("city") != "unknown",
        "region": c("region") != "unknown", "distanceKm": c("distance_km").isNotNull(), "elevationGain": c("elevation_gain").isNotNull(), "officialUrl": has("raw_official_url"),
        "registrationUrl": has("raw_registration_url"), "categories": c("distance_km").isNotNull() | c("elevation_gain").isNotNull(), "tags": F.lit(False), "decision": F.lit(False),
    }
    lacking = {
        "name": ~has("raw_name"), "date": c("date").isNull(), "province": c("province") == "unknown", "city": c("city") == "unknown", "distanceKm": c("distance_km").isNull(),
        "elevationGain": c("elevation_gain").isNull(), "registrationUrl": ~has("raw_registration_url"), "officialUrl": ~has("raw_official_url"),
    }
    points = [
        (has("raw_name"), 20), (c("date").isNotNull(), 20), (c("city") != "unknown", 15), (c("distance_km").isNotNull(), 15),
        (has("raw_registration_url") | has("raw_official_url"), 10), (c("source").isin("runchina", "itra"), 20),
    ]
    trail = c("type").isin(*TRAIL_TYPES)
    category = F.coalesce(
        *[F.when(c("distance_km") == km, F.lit(name)) for km, name in NAMED_CATEGORIES], F.when(c("distance_km") > 0, F.concat(number_text(c("distance_km")), F.lit("KM"))),
        F.when(trail, "越野组别待补全"), F.lit("组别待补全"),
    )
    notes = [
        (~has("raw_name"), "missing rawName; used placeholder name"), (~has("raw_date"), "missing date"), (has("raw_date") & c("date").isNull(), "date not precise to day"),
        (c("province") == "unknown", "missing or unparsed province"), (c("city") == "unknown", "missing or unparsed city"),
        (c("distance_km").isNull(), "missing distance; category uses placeholder distance 0"), (c("elevation_gain").isNull() & trail, "missing elevation gain for trail race"),
        (F.lit(True), "generated placeholder, should be enriched by tag/difficulty/recommendation engine"),
    ]
    flags = lambda pairs: F.array_compact(F.array(*[F.when(ok, F.lit(n)) for ok, n in pairs]))
    return r.select(
        F.concat(F.lit("race-"), c("slug")).alias("id"), "name", "slug", "type", "status", text("raw_official_url").alias("official_url"), text("raw_registration_url").alias("registration_url"),
        "year", "month", "date", F.when((c("province") == "unknown") & (c("source") == "itra"), "unknown").otherwise("中国").alias("country"), "province", "city", "region",
        F.array(F.struct(
            F.concat(c("slug"), F.lit("-main")).alias("id"), category.alias("name"), F.coalesce("distance_km", F.lit(0.0)).alias("distance_km"),
            F.coalesce("elevation_gain", F.lit(0)).alias("elevation_gain"), F.lit("L1").alias("difficulty_level"), F.lit(0).alias("difficulty_score"), F.lit(False).alias("beginner_friendly"),
        )).alias("categories"),
        "source", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SOURCE_PRIORITY.items() for x in kv]), c("source")), F.lit(0)).alias("source_priority"), "source_url", "raw_id",
        F.create_map(*[x for n, ok in sources.items() for x in (F.lit(n), source_if(ok))]).alias("field_sources"),
        sum((F.when(F.coalesce(ok, F.lit(False)), p).otherwise(0) for ok, p in points), F.lit(0)).alias("confidence"), flags((ok, n) for n, ok in lacking.items()).alias("missing_fields"),
        F.when(has("raw_name") & c("date").isNotNull() & (c("city") != "unknown"), "partially_verified").when(has("raw_name"), "unverified").otherwise("placeholder").alias("data_quality"),
        ((c("source") == "runchina") & has("raw_name")).alias("verified"), F.concat(F.array(F.concat(F.lit("source="), c("source"))), flags(notes)).alias("notes"),
    )


def tx_date(text: Column) -> Column:
    """A date string as a date; null where it is none."""
    return F.try_to_date(text, "yyyy-MM-dd")


def read_string(c: Column) -> Column:
    """Trimmed text; null for an empty one."""
    return F.when(tx.js_trim(c) != "", tx.js_trim(c))


def read_number(c: Column) -> Column:
    """Number of a text; null where it is none or not finite."""
    n = tx.js_trim(c).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def connector_records(records: DataFrame) -> DataFrame:
    """Source records in the form of connector rows.

    records: ``source_id, raw_id, source_url, data_quality, warnings array<string>, fields`` (the extracted fields as a JSON object).
    """
    parsed = records.withColumns({"f": F.from_json("fields", ", ".join(f"{n} string" for n in CONNECTOR_FIELDS) + ", categories string"), "keys": F.map_keys(F.from_json("fields", "map<string,string>"))})
    f = lambda n: read_string(F.col(f"f.{n}"))
    name, date = f("name"), f("raceDate")
    candidate = tx.connector_name(F.coalesce(name, F.lit("")))
    from_date, from_name = F.regexp_extract(F.coalesce(date, F.lit("")), r"^(20\d{2})", 1), F.regexp_extract(F.coalesce(name, F.lit("")), r"20\d{2}", 0)
    year = F.coalesce(F.when(from_date != "", from_date), F.when(from_name != "", from_name)).cast("int")
    item = lambda x: F.struct(
        read_string(x["categoryName"]).alias("category_name"), read_number(x["distanceKm"]).alias("distance_km"), read_number(x["elevationGain"]).alias("elevation_gain"), read_string(x["cutoffTime"]).alias("cutoff_time"),
        F.coalesce(read_number(x["registrationFee"]), read_number(x["categoryFee"])).alias("registration_fee"), read_string(x["categoryRegistrationUrl"]).alias("category_registration_url"),
    )
    listed = F.from_json("f.categories", CATEGORY_SCHEMA)
    rows = parsed.select(
        F.concat_ws("-", "source_id", "raw_id").alias("id"), name.alias("original_name"), candidate.alias("canonical_name_candidate"), tx.dedupe_name(candidate).alias("normalized_name"),
        "source_id", "raw_id", "source_url", year.alias("edition_year"), date.alias("race_date"), *[f(n).alias(n) for n in ("province", "city", "district", "venue")],
        tx.connector_status(F.coalesce(f("registrationStatus"), f("statusText"))).alias("registration_status"), f("registrationUrl").alias("registration_url"), f("coverImage").alias("cover_image"),
        F.coalesce(F.transform(listed, item), F.array().cast("array<struct<category_name string, distance_km double, elevation_gain double, cutoff_time string, registration_fee double, category_registration_url string>>")).alias("categories"),
        F.map_from_arrays(*(lambda k: (k, F.transform(k, lambda _: F.col("source_id"))))(F.array_union(F.coalesce("keys", F.array().cast("array<string>")), F.array(F.lit("rawId"), F.lit("sourceUrl"))))).alias("field_sources"),
        (F.col("f.registrationUrl") != "").alias("_has_url"), "data_quality", F.size(F.coalesce("warnings", F.array().cast("array<string>"))).alias("_warnings"),
    )
    lacking = {
        "originalName": F.col("original_name").isNull(), "canonicalNameCandidate": F.col("canonical_name_candidate") == "", "editionYear": F.col("edition_year").isNull(), "raceDate": F.col("race_date").isNull(),
        "province": F.col("province").isNull(), "city": F.col("city").isNull(), "registrationStatus": F.col("registration_status").isNull(), "registrationUrl": F.col("registration_url").isNull(), "categories": F.size("categories") == 0,
    }
    # whole hundredths: no rounding of binary fractions
    points = F.when(F.col("source_id") == "runchina", 76).otherwise(68)
    for ok, p in ((F.col("data_quality") == "high", 10), (F.col("_has_url"), 4), (F.size("categories") > 0, 6)):
        points = points + F.when(F.coalesce(ok, F.lit(False)), p).otherwise(0)
    points = F.greatest(F.lit(30), F.least(F.lit(95), points - F.least(F.lit(12), 3 * F.col("_warnings"))))
    return rows.withColumns(
        {"missing_fields": F.array_compact(F.array(*[F.when(ok, F.lit(n)) for n, ok in lacking.items()])), "confidence": points / 100}
    ).drop("_has_url", "_warnings", "data_quality")


# fixed values: seed records — status from text, race types by name, popular places and names
SEED_STATUS_RULES = [
    (r"(?i)抽签|摇号|lottery", "lottery"), (r"(?i)报名|点此|一键报名|open", "registration_open"), (r"(?i)即将|预告|upcoming", "upcoming"), (r"(?i)截止|关闭|closed", "closed"), (r"(?i)结束|已结束|finished", "finished"),
]
SEED_TRAIL = r"(?i)越野|跑山|山径|trail|FUGA|贡嘎|柴古|UTMB"
POPULAR_CITIES = r"北京|上海|广州|深圳|杭州|南京|成都|重庆|武汉|西安|厦门|苏州|无锡|长沙|郑州|青岛|兰州|太原"
POPULAR_NAMES = r"马拉松|半程马拉松|越野|UTMB|贡嘎|柴古|崇礼|江南|黄山|莫干山|四姑娘山"
TYPE_POINTS = {"marathon": 8, "half_marathon": 6, "trail": 8, "ultra_trail": 8}


def seed_status(value: Column, registration_url: Column, date: Column, as_of: str) -> Column:
    """Status of a seed candidate: a past date, then a registration link, then its words."""
    past = F.coalesce(tx_date(date) < F.lit(as_of).cast("date"), F.lit(False))
    return F.when(past, "finished").when(has_text(registration_url), "registration_open").otherwise(tx.first_match(F.coalesce(value, F.lit("")), SEED_STATUS_RULES, F.lit("unknown")))


def type_by_distance(text: Column, distances: Column, trail: str, half_by_distance: bool = True) -> Column:
    """Race type from words and the distances of the categories."""
    longest = F.greatest(F.coalesce(F.array_max(distances), F.lit(0.0)), F.lit(0.0))
    any_full = F.exists(distances, lambda d: F.coalesce((d >= 40) & (d < 50), F.lit(False)))
    return (
        F.when(text.rlike(trail), F.when(longest >= 50, "ultra_trail").otherwise("trail")).when(any_full, "marathon")
        .when((F.size(distances) > 0) & (longest <= 22) if half_by_distance else F.lit(False), "half_marathon")
        .when(text.rlike("半程|半马"), "half_marathon").when(text.rlike("马拉松"), "marathon").otherwise("other")
    )


def seed_candidates(records: DataFrame, as_of: str) -> DataFrame:
    """Seed candidates of scraped rows: ``source_id, raw_id, name, date_location, status_text, registration_url, source_url, categories_text``."""
    c = F.col
    date, province, city, district, _ = date_location(c("date_location"))
    names = category_names(c("categories_text"))
    item = lambda n: F.struct(n.alias("category_name"), connector_distance(n, "seed").alias("distance_km"), connector_climb(n).alias("elevation_gain"), cutoff_text(n).alias("cutoff_time"))
    r = records.withColumns({"name": clean_title(c("name")), "race_date": date, "province": province, "city": city, "district": district, "categories": F.transform(F.array_distinct(names), item)})
    distances = F.transform("categories", lambda x: F.coalesce(x["distance_km"], F.lit(0.0)))
    words = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.array_join(F.transform("categories", lambda x: x["category_name"]), " "))
    r = r.withColumns({"registration_status": seed_status(c("status_text"), c("registration_url"), c("race_date"), as_of), "type": type_by_distance(words, distances, SEED_TRAIL)})
    where = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("city", F.lit("")))
    popularity = F.when(where.rlike(POPULAR_CITIES), 18).otherwise(0) + F.when(where.rlike(POPULAR_NAMES), 12).otherwise(0)
    popularity = popularity + F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_POINTS.items() for x in kv]), c("type")), F.lit(0))
    lacking = [(n, ~has_text(col)) for n, col in (("name", "name"), ("province", "province"), ("city", "city"), ("raceDate", "race_date"), ("registrationUrl", "registration_url"), ("sourceUrl", "source_url"))]
    lacking.append(("categories", F.size("categories") == 0))
    points = F.when(c("source_id") == "runchina", 68).otherwise(62)
    for ok, p in ((has_text("race_date"), 8), (has_text("source_url"), 4), (has_text("registration_url"), 8), (F.size("categories") > 0, 6), (has_text("province") & has_text("city"), 4)):
        points = points + F.when(ok, p).otherwise(0)
    return r.withColumns(
        {"popularity": popularity, "missing_fields": F.array_compact(F.array(*[F.when(ok, F.lit(n)) for n, ok in lacking])), "confidence": F.least(F.lit(96), points) / 100}
    ).drop("date_location", "status_text", "categories_text")


def valuable_candidate(source_url: Column, date: Column, status: Column, registration_url: Column, as_of: str) -> Column:
    """A seed candidate worth keeping: it has a source, is not over, and is not closed without a link."""
    ended = status == "finished"
    undated = ~status.isin("closed", "finished")
    dated = ~F.coalesce(tx_date(date) < F.lit(as_of).cast("date"), F.lit(False)) & ~ended & ~((status == "closed") & ~has_text(registration_url))
    return has_text(source_url) & F.when(has_text(date), dated).otherwise(undated)
