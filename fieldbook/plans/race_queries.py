"""Registered queries of the normalizers, registry, publication, evidence and shown texts, and their DuckDB SQL.

The driver's tables hold no race texts, so each row's texts are picked from the lists below by its key: both sides get the same input
for every row of a table, and each works the rules out for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display, text
from ..operators import cards, cdc, gates, merge, monitor, normalize, publication, rank, registry, sets, state
from ..operators import evidence as ev
from .queries import query, t

AS_OF = "2026-06-30"
NAMES = ["2026杭州湖滨马拉松赛", "【热门】第三届 杭州越野赛", "2025 杭州·马拉松赛", "ABC（站）Trail 2025", "第二届 湖滨“山径”挑战赛 2026", "莫干山-越野跑", "湖滨半程马拉松报名- 最酷ZUICOOL 页", "Race Calendar", "平台公告 跑"]
DATES = ["2026年11月1日", "2026.3.8", "2026/12/31", "2026-5", "赛期 2026 年", "x2025-1-2y", "待定", None]
DISTANCES = ["半程马拉松", "全程马拉松", "全马42.2", "50KM", "30k", "10 miles", "12.5 公里", "100km", "马拉松", "无", None]
CLIMBS = ["D+2600", "累计爬升 1200米", "爬升80", "无", "关门时间 6小时，补给", None]
PLACES = ["浙江省杭州市", "上海黄浦", "内蒙古 呼和浩特市", "Chamonix France", "Tokyo Japan", "甘孜自治州", "", None]
CITIES = ["杭州", "", None, "unknown"]
STATES = ["报名中", "抽签", "已截止", "取消", "完赛", "Registration Open", "候补", None]
SOURCES = ["runchina", "zuicool", "itra"]


def pick(key: Column, values: list, step: int = 1) -> Column:
    """A value of the list by the row's key; ``step`` rows in a row get the same."""
    return F.element_at(F.array(*[F.lit(v).cast("string") if v is None else F.lit(v) for v in values]), (F.floor(key / step) % len(values) + 1).cast("int"))


def sql_pick(key: str, values: list, step: int = 1) -> str:
    quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"([{', '.join(map(quote, values))}])[1 + ({key} // {step}) % {len(values)}]"


def chain(expr: str, *steps: tuple[str, str]) -> str:
    for pattern, by in steps:
        expr = f"regexp_replace({expr}, '{pattern}', '{by}', 'g')"
    return expr


TRIM = (r"^\s+|\s+$", "")
DISPLAY_SQL = [(r"[【】\[\]()（）]", " "), (r"\b20\d{2}\b", " "), (r"20\d{2}\s*年?", " "), (r"\s+", " "), (r"^第[一二三四五六七八九十\d]+届\s*", ""), ("赛$", ""), TRIM]
CONNECTOR_SQL = [(r"^\s*20\d{2}\s*", ""), (r"\s*20\d{2}\s*$", ""), (r"^[·・\-—\s]+|[·・\-—\s]+$", ""), ("赛$", ""), (r"\s+", ""), TRIM]
MARKS_SQL = [(r"[·・\-—“”\"'']", ""), (r"（.*?）|\(.*?\)", "")]
RAW_NAME = f"CASE p_partkey % 3 WHEN 0 THEN {sql_pick('p_partkey', NAMES)} WHEN 1 THEN split_part(p_name, ' ', 1) || {sql_pick('p_partkey', NAMES)} ELSE {sql_pick('p_partkey', NAMES)} || split_part(p_name, ' ', 1) END"


def raw_name() -> Column:
    k, word = F.col("p_partkey"), F.split_part("p_name", F.lit(" "), F.lit(1))
    name = pick(k, NAMES)
    return F.when(k % 3 == 0, name).when(k % 3 == 1, F.concat(word, name)).otherwise(F.concat(name, word))


@query(rf"""
WITH n AS (SELECT p_partkey, {RAW_NAME} AS s FROM part)
SELECT p_partkey, {chain('s', *DISPLAY_SQL)} AS shown, {chain('s', *CONNECTOR_SQL)} AS connector, lower({chain('s', *CONNECTOR_SQL, *MARKS_SQL)}) AS dedupe,
  {chain('lower(' + chain('s', *CONNECTOR_SQL[:2], *MARKS_SQL, ('赛$', ''), (chr(92) + 's+', '')) + ')', TRIM)} AS catalog,
  {chain('s', ('(?i)- 最酷ZUICOOL.*$', ''), ('报名.*$', ''), (chr(92) + 's+', ' '), TRIM)} AS title,
  regexp_matches(s, '(?i)马拉松|半程|半马|越野|跑') AND NOT regexp_matches(s, '系统|平台|公告|通知|征集|协会|服务|申报|监管|博览会') AS likely_runchina,
  regexp_matches(s, '(?i)20\d{{2}}|\d+\s?(km|k\b)|trail|ultra|marathon|mountain') AND NOT regexp_matches(s, '(?i)^\s*(races?|race calendar|race results?|race map|events?|calendar)\s*$')
    AND NOT regexp_matches(s, '(?i)login|sign in|register|organization|runner|contact|about|discover trail-running') AS likely_itra
FROM n
""")
def shown_names(spark: SparkSession, d: str) -> DataFrame:
    """The four kinds of names, scraped titles, and whether a name looks like a race."""
    s = F.col("s")
    return t(spark, d, "part").select("p_partkey", raw_name().alias("s")).select(
        "p_partkey", text.display_name(s).alias("shown"), text.connector_name(s).alias("connector"), text.dedupe_name(s).alias("dedupe"), text.catalog_name(s).alias("catalog"), normalize.clean_title(s).alias("title"),
        normalize.likely_race(s, "runchina").alias("likely_runchina"), normalize.likely_race(s, "itra").alias("likely_itra"),
    )


DATE_SQL = chain("d", ("[年月/.]", "-"), ("日", ""), (r"\s+", ""))
DATE_FULL = r"(20\d{2})-(\d{1,2})-(\d{1,2})"
DATE_PART = r"(20\d{2})-(\d{1,2})"
KM_SQL = r"""CASE WHEN {0} = '' THEN NULL WHEN regexp_matches(lower({0}), '半程马拉松|半马|21\.0975|21\.1') THEN 21.1 WHEN regexp_matches(lower({0}), '全马|马拉松|42\.195|42\.2') AND NOT contains({0}, '半') THEN 42.2
  WHEN regexp_matches(lower({0}), '(\d+(\.\d+)?)\s?(miles?|英里)') THEN floor(CAST(regexp_extract(lower({0}), '(\d+(\.\d+)?)\s?(miles?|英里)', 1) AS DOUBLE) * 1.60934 * 10 + 0.5) / 10
  WHEN regexp_matches(lower({0}), '(\d+(\.\d+)?)\s?(km|公里|k\b)') THEN floor(CAST(regexp_extract(lower({0}), '(\d+(\.\d+)?)\s?(km|公里|k\b)', 1) AS DOUBLE) * 10 + 0.5) / 10 END::DOUBLE"""


def connector_km_sql(c: str, full: str, unit: str) -> str:
    return rf"CASE WHEN regexp_matches({c}, '半程|半马') THEN 21.1 WHEN regexp_matches({c}, '{full}') THEN 42.2 WHEN regexp_matches({c}, '(\d+(\.\d+)?)\s?({unit})') THEN CAST(regexp_extract({c}, '(\d+(\.\d+)?)\s?({unit})', 1) AS DOUBLE) END::DOUBLE"


@query(rf"""
WITH x AS (SELECT p_partkey, {sql_pick('p_partkey', DATES)} AS d, {sql_pick('p_partkey', DISTANCES, 8)} AS k, {sql_pick('p_partkey', CLIMBS, 3)} AS c FROM part), n AS (SELECT *, {DATE_SQL} AS dash FROM x)
SELECT p_partkey, CAST(nullif(CASE WHEN regexp_matches(dash, '{DATE_FULL}') THEN regexp_extract(dash, '{DATE_FULL}', 1) WHEN regexp_matches(dash, '{DATE_PART}') THEN regexp_extract(dash, '{DATE_PART}', 1) ELSE regexp_extract(d, '20\d{{2}}') END, '') AS INTEGER) AS year,
  CAST(CASE WHEN regexp_matches(dash, '{DATE_FULL}') THEN regexp_extract(dash, '{DATE_FULL}', 2) WHEN regexp_matches(dash, '{DATE_PART}') THEN regexp_extract(dash, '{DATE_PART}', 2) END AS INTEGER) AS month,
  CASE WHEN regexp_matches(dash, '{DATE_FULL}') THEN regexp_extract(dash, '{DATE_FULL}', 1) || '-' || lpad(regexp_extract(dash, '{DATE_FULL}', 2), 2, '0') || '-' || lpad(regexp_extract(dash, '{DATE_FULL}', 3), 2, '0') END AS date,
  {KM_SQL.format('k')} AS km, {connector_km_sql('k', '全程|全马', 'km|KM|公里')} AS km_zuicool, {connector_km_sql('k', '全程|全马|马拉松', 'km|KM|公里')} AS km_runchina, {connector_km_sql('k', '全程|全马|马拉松', 'km|KM|公里|K')} AS km_seed,
  CAST(nullif(regexp_extract(c, '(?i)(D\+|爬升|累计爬升)?\s*(\d{{2,5}})\s?(m|米)?', 2), '') AS INTEGER) AS climb, CAST(nullif(regexp_extract(c, '(?i)(累计爬升|爬升|D\+)\s*(\d{{3,5}})\s*(米|m)?', 2), '') AS INTEGER) AS connector_climb,
  nullif(regexp_extract(c, '关门时间([^，。；;]+)'), '') AS cutoff FROM n
""")
def loose_values(spark: SparkSession, d: str) -> DataFrame:
    """Dates, distances, climbs and cutoffs written loosely, by each reader's own rules."""
    k = F.col("p_partkey")
    x = t(spark, d, "part").select("p_partkey", pick(k, DATES).alias("d"), pick(k, DISTANCES, 8).alias("k"), pick(k, CLIMBS, 3).alias("c"))
    year, month, date = text.flexible_date(F.col("d"))
    kinds = [normalize.connector_distance(F.col("k"), n).alias(f"km_{n}") for n in ("zuicool", "runchina", "seed")]
    return x.select("p_partkey", year.alias("year"), month.alias("month"), date.alias("date"), text.distance_km(F.col("k")).alias("km"), *kinds, text.elevation_m(F.col("c")).alias("climb"), normalize.connector_climb(F.col("c")).alias("connector_climb"), normalize.cutoff_text(F.col("c")).alias("cutoff"))


REGION_SQL = "CASE " + " ".join(f"WHEN {{0}} IN ({', '.join(repr(p) for p in ps)}) THEN '{r}'" for r, ps in text.REGION_PROVINCES.items())
PROVINCE_SQL = "CASE " + " ".join(f"WHEN contains(txt, '{p}') THEN '{p}'" for p in sorted((p for ps in text.REGION_PROVINCES.values() for p in ps), key=len, reverse=True)) + " END"
RAW_SQL = rf"""
x AS (SELECT o_orderkey, {sql_pick('o_orderkey', SOURCES, 2)} AS source, {sql_pick('o_orderkey', [*NAMES[:7], None])} AS name, {sql_pick('o_orderkey', DATES, 3)} AS d, {sql_pick('o_orderkey', CITIES, 5)} AS city, {sql_pick('o_orderkey', PLACES, 7)} AS place,
  {sql_pick('o_orderkey', DISTANCES, 11)} AS dist, {sql_pick('o_orderkey', CLIMBS, 2)} AS climb, {sql_pick('o_orderkey', STATES, 9)} AS st, CASE WHEN o_orderkey % 4 = 0 THEN 'https://o' END AS official, CASE WHEN o_orderkey % 5 = 0 THEN 'https://r' WHEN o_orderkey % 5 = 1 THEN '' END AS reg FROM orders),
y AS (SELECT *, {DATE_SQL} AS dash, concat_ws(' ', nullif(city, ''), nullif(place, ''), name) AS txt, coalesce(dist, name) AS ktext, lower(concat_ws(' ', '', coalesce(name, ''), coalesce(dist, ''), '')) AS words FROM x),
z AS (SELECT *, CASE WHEN regexp_matches(dash, '{DATE_FULL}') THEN regexp_extract(dash, '{DATE_FULL}', 1) || '-' || lpad(regexp_extract(dash, '{DATE_FULL}', 2), 2, '0') || '-' || lpad(regexp_extract(dash, '{DATE_FULL}', 3), 2, '0') END AS date,
  CAST(nullif(CASE WHEN regexp_matches(dash, '{DATE_FULL}') THEN regexp_extract(dash, '{DATE_FULL}', 1) WHEN regexp_matches(dash, '{DATE_PART}') THEN regexp_extract(dash, '{DATE_PART}', 1) ELSE regexp_extract(d, '20\d{{2}}') END, '') AS INTEGER) AS year,
  coalesce({PROVINCE_SQL}, 'unknown') AS province, {KM_SQL.format('ktext')} AS km, CAST(nullif(regexp_extract(climb, '(?i)(D\+|爬升|累计爬升)?\s*(\d{{2,5}})\s?(m|米)?', 2), '') AS INTEGER) AS gain FROM y),
w AS (SELECT *, CASE WHEN city IS NOT NULL AND city NOT IN ('', 'unknown') THEN city WHEN province IN ('北京', '上海', '天津', '重庆') THEN province
    WHEN regexp_matches(txt, '[\x{{4e00}}-\x{{9fa5}}]{{2,8}}(市|自治州|地区|盟|县)') THEN regexp_replace(regexp_extract(txt, '[\x{{4e00}}-\x{{9fa5}}]{{2,8}}(市|自治州|地区|盟|县)'), '市|自治州|地区|盟|县|区$', '') ELSE 'unknown' END AS town,
  CASE WHEN regexp_matches(words, 'utmb') THEN 'utmb' WHEN regexp_matches(words, 'triathlon|铁人三项') THEN 'triathlon' WHEN regexp_matches(words, 'ultra|100\s?km|百公里|超级|超马') AND regexp_matches(words, 'trail|越野|山') THEN 'ultra_trail'
    WHEN regexp_matches(words, 'trail|越野|山地') THEN 'trail' WHEN regexp_matches(words, '半程马拉松|半马|21\.?1') THEN 'half_marathon' WHEN regexp_matches(words, '马拉松|全马|42\.?2|42\.195|marathon') THEN 'marathon' WHEN regexp_matches(words, '跑|run|running|km|公里') THEN 'road_running' ELSE 'other' END AS type FROM z)"""


@query(rf"""
WITH {RAW_SQL}
SELECT o_orderkey, CASE WHEN name IS NULL THEN 'unknown' ELSE {chain('name', *DISPLAY_SQL)} END AS name, type, year, date, province, town AS city,
  coalesce({REGION_SQL.format('province')} END, CASE WHEN regexp_matches(txt, '(?i)hong kong|macau|taiwan|香港|澳门|台湾') THEN 'hongkong_macao_taiwan' WHEN regexp_matches(txt, '(?i)japan|korea|thailand|singapore|asia') THEN 'asia'
    WHEN regexp_matches(txt, '(?i)france|italy|spain|switzerland|europe') THEN 'europe' WHEN regexp_matches(txt, '(?i)usa|canada|america|north america') THEN 'north_america' WHEN regexp_matches(txt, '(?i)[a-z]{{3,}}') THEN 'other_overseas' ELSE 'unknown' END) AS region,
  CASE WHEN regexp_matches(st, '(?i)报名中|开放|registration open') THEN 'registration_open' WHEN regexp_matches(st, '(?i)抽签|lottery') THEN 'lottery' WHEN regexp_matches(st, '(?i)已截止|截止|closed') THEN 'closed' WHEN regexp_matches(st, '(?i)取消|cancel') THEN 'cancelled'
    WHEN regexp_matches(st, '(?i)结束|完赛|finished') THEN 'finished' WHEN date < '{AS_OF}' THEN 'finished' WHEN year < 2026 THEN 'finished' WHEN year >= 2026 THEN 'upcoming' ELSE 'unknown' END AS status,
  coalesce(km, 0) AS km, coalesce(gain, 0) AS gain, CASE WHEN km = 42.2 THEN '全程马拉松' WHEN km = 21.1 THEN '半程马拉松' WHEN km > 0 THEN CASE WHEN km = floor(km) THEN CAST(CAST(km AS BIGINT) AS VARCHAR) ELSE CAST(km AS VARCHAR) END || 'KM'
    WHEN type IN ('trail', 'ultra_trail', 'utmb') THEN '越野组别待补全' ELSE '组别待补全' END AS category,
  CASE WHEN province = 'unknown' AND source = 'itra' THEN 'unknown' ELSE '中国' END AS country, CASE source WHEN 'runchina' THEN 100 WHEN 'itra' THEN 90 ELSE 70 END AS source_priority,
  CAST(CASE WHEN name IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN date IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN town <> 'unknown' THEN 15 ELSE 0 END + CASE WHEN km IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN reg <> '' OR official IS NOT NULL THEN 10 ELSE 0 END
    + CASE WHEN source IN ('runchina', 'itra') THEN 20 ELSE 0 END AS INTEGER) AS confidence,
  array_to_string(list_filter([CASE WHEN name IS NULL THEN 'name' END, CASE WHEN date IS NULL THEN 'date' END, CASE WHEN province = 'unknown' THEN 'province' END, CASE WHEN town = 'unknown' THEN 'city' END, CASE WHEN km IS NULL THEN 'distanceKm' END,
    CASE WHEN gain IS NULL THEN 'elevationGain' END, CASE WHEN coalesce(reg, '') = '' THEN 'registrationUrl' END, CASE WHEN official IS NULL THEN 'officialUrl' END], lambda x: x IS NOT NULL), ',') AS missing,
  CASE WHEN name IS NOT NULL AND date IS NOT NULL AND town <> 'unknown' THEN 'partially_verified' WHEN name IS NOT NULL THEN 'unverified' ELSE 'placeholder' END AS quality, source = 'runchina' AND name IS NOT NULL AS verified,
  CASE WHEN town <> 'unknown' THEN source ELSE 'placeholder' END AS city_source, CASE WHEN km IS NOT NULL OR gain IS NOT NULL THEN source ELSE 'placeholder' END AS categories_source FROM w
""")
def normalized_races(spark: SparkSession, d: str) -> DataFrame:
    """Raw rows brought to the normalized form, with field sources, missing fields and confidence."""
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    raw = t(spark, d, "orders").select(
        pick(k, SOURCES, 2).alias("source"), k.cast("string").alias("raw_id"), none.alias("source_url"), pick(k, [*NAMES[:7], None]).alias("raw_name"), pick(k, DATES, 3).alias("raw_date"), none.alias("raw_province"), pick(k, CITIES, 5).alias("raw_city"),
        pick(k, PLACES, 7).alias("raw_location"), pick(k, DISTANCES, 11).alias("raw_distance"), pick(k, CLIMBS, 2).alias("raw_elevation_gain"), none.alias("raw_difficulty"), none.alias("raw_type"), F.lit(None).cast("array<string>").alias("raw_tags"),
        pick(k, STATES, 9).alias("raw_registration_status"), F.when(k % 4 == 0, "https://o").alias("raw_official_url"), F.when(k % 5 == 0, "https://r").when(k % 5 == 1, "").alias("raw_registration_url"),
    )
    c = F.col("category")
    # read once without its id, so that Spark drops the ids and their hashes, which no column of the result needs
    return normalize.normalized_races(raw, AS_OF).withColumn("category", F.col("categories")[0].dropFields("id")).select(
        F.col("raw_id").cast("bigint").alias("o_orderkey"), "name", "type", "year", "date", "province", "city", "region", "status", c["distance_km"].alias("km"), c["elevation_gain"].alias("gain"), c["name"].alias("category"), "country", "source_priority",
        F.col("confidence").cast("int").alias("confidence"), F.array_join("missing_fields", ",").alias("missing"), F.col("data_quality").alias("quality"), "verified", F.col("field_sources.city").alias("city_source"), F.col("field_sources.categories").alias("categories_source"),
    )


TIERS, KINDS, LIVE = ["primary_official", "trusted_structured", "trusted_secondary"], ["notice", "structured_connector", "calendar", "media_report", "official_partner_announcement", "registration_platform", "event_home"], ["active", "active", "retired"]
SOURCE_SQL = f"s AS (SELECT l_orderkey, l_linenumber, {sql_pick('(l_orderkey + l_linenumber)', TIERS)} AS tier, {sql_pick('(l_orderkey + 2 * l_linenumber)', KINDS)} AS kind, {sql_pick('(l_orderkey + l_linenumber)', LIVE, 5)} AS status, l_linenumber = 1 AS is_primary FROM lineitem)"


def sources(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("l_orderkey"), F.col("l_linenumber")
    return t(spark, d, "lineitem").select(
        a.cast("string").alias("edition_id"), F.concat_ws("-", a.cast("string"), b.cast("string")).alias("source_id"), F.lit("https://x.cn/").alias("url"), pick(a + b, TIERS).alias("tier"), pick(a + 2 * b, KINDS).alias("source_type"), pick(a + b, LIVE, 5).alias("status"),
        (b == 1).alias("is_primary"), "l_orderkey", "l_linenumber",
    )


@query(f"""
WITH {SOURCE_SQL}
SELECT l_orderkey, l_linenumber, CASE WHEN tier = 'primary_official' THEN 'official_document' WHEN kind = 'structured_connector' THEN 'structured_connector' ELSE 'trusted_document' END AS mode, tier = 'primary_official' AS auto_apply FROM s
WHERE status = 'active' AND ((tier = 'primary_official' AND kind IN ('event_home', 'notice', 'regulations', 'registration_notice', 'registration_platform', 'category_page', 'official_calendar'))
  OR (tier = 'trusted_structured' AND kind IN ('structured_connector', 'calendar', 'certification_platform', 'event_directory', 'registration_platform')) OR (tier = 'trusted_secondary' AND kind = 'official_partner_announcement'))
""")
def active_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources that may speak for their edition, and how."""
    got = registry.active_sources(sources(spark, d))
    return got.select("l_orderkey", "l_linenumber", F.col("eligibility.mode").alias("mode"), F.col("eligibility.auto_apply").alias("auto_apply"))


@query(f"""
WITH {SOURCE_SQL}, e AS (SELECT *, l_orderkey || '-' || l_linenumber AS id FROM s), f AS (SELECT l_orderkey, id, row_number() OVER (PARTITION BY l_orderkey ORDER BY is_primary DESC, kind = 'event_home' DESC, id) AS rn FROM e WHERE status = 'active' AND tier = 'primary_official' AND kind IN ('event_home', 'notice')),
r AS (SELECT l_orderkey, id, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN is_primary THEN 0 WHEN tier = 'primary_official' THEN 1 WHEN tier = 'trusted_structured' THEN 2 ELSE 3 END, id) AS rn FROM e)
SELECT 'entry' AS kind, l_orderkey, id, CAST(rn AS INTEGER) AS rank FROM f WHERE rn <= 2 UNION ALL SELECT 'authority', l_orderkey, id, 1 FROM r WHERE rn = 1
""")
def source_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The first two pages to read of each edition, and the source of the highest authority."""
    s = sources(spark, d)
    first = registry.entry_sources(s).select(F.lit("entry").alias("kind"), "l_orderkey", F.col("source_id").alias("id"), "rank")
    best = registry.most_authoritative(s, ["edition_id"]).select(F.lit("authority").alias("kind"), "l_orderkey", F.col("source_id").alias("id"), F.lit(1).alias("rank"))
    return first.unionByName(best)


def one_line(spark: SparkSession, d: str) -> DataFrame:
    """Line items with unique keys (some repeat in the tables)."""
    return t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_returnflag", "l_linestatus", "l_quantity", "l_shipdate")])


@query("""
WITH one_line AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL),
f AS (SELECT CAST(o_orderkey AS VARCHAR) AS e, o_orderstatus AS v, o_orderkey FROM orders),
c AS (SELECT CAST(l_orderkey AS VARCHAR) AS e, l_linenumber AS n, CASE WHEN l_linenumber % 4 = 3 THEN 'X' ELSE o_orderstatus END AS v, l_returnflag = 'N' AS auth, l_linenumber % 2 = 1 AS fresh, l_quantity > 10 AS matched FROM one_line JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT f.e, bool_or(auth AND fresh AND c.v <> f.v) FILTER (matched) AS contrary, bool_or(fresh AND c.v = f.v) FILTER (matched) AS now, bool_or(c.v = f.v) FILTER (matched) AS ever,
  string_agg(DISTINCT CASE WHEN matched AND c.v = f.v THEN CAST(n AS VARCHAR) END, ',' ORDER BY CASE WHEN matched AND c.v = f.v THEN CAST(n AS VARCHAR) END) AS sources FROM f LEFT JOIN c ON f.e = c.e GROUP BY f.e)
SELECT f.o_orderkey, CASE WHEN v = 'P' THEN 'UNKNOWN' WHEN coalesce(contrary, false) THEN 'NOT_VERIFIED_THIS_RUN' WHEN coalesce(now, false) THEN 'VERIFIED_THIS_RUN' WHEN coalesce(ever, false) THEN 'VERIFIED_INHERITED' ELSE 'NOT_VERIFIED_THIS_RUN' END AS status, coalesce(sources, '') AS sources
FROM (SELECT e, CASE WHEN v = 'P' THEN 'P' ELSE v END AS v, o_orderkey FROM f) f LEFT JOIN (SELECT * FROM g) g ON f.e = g.e WHERE v <> 'P' UNION ALL SELECT o_orderkey, 'UNKNOWN', '' FROM f WHERE v = 'P'
""")
def field_verification(spark: SparkSession, d: str) -> DataFrame:
    """What the official sources say about a field of each edition, this time or before."""
    o, l = t(spark, d, "orders"), one_line(spark, d)
    none = F.lit(None).cast("string")
    fields = o.select(F.col("o_orderkey").cast("string").alias("edition_id"), none.alias("category_id"), F.lit("status").alias("field"), F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(F.col("o_orderstatus")).alias("value"))
    n, e = F.col("l_linenumber"), F.col("l_orderkey").cast("string").alias("edition_id")
    fresh = F.when(n % 2 == 1, "success").otherwise("unchanged")
    reports = l.select(e, n.cast("string").alias("source_id"), F.lit("primary_official").alias("tier"), (F.col("l_quantity") > 10).alias("identity_matched"), fresh.alias("extraction"), F.when(n % 2 == 1, "success").otherwise("skipped").alias("request"))
    said = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        e, n.cast("string").alias("source_id"), none.alias("category_id"), F.lit("status").alias("field"), F.when(n % 4 == 3, "X").otherwise(F.col("o_orderstatus")).alias("value"), (F.col("l_returnflag") == "N").alias("authoritative"), F.lit(True).alias("direct")
    )
    got = registry.field_verification(fields, reports, said)
    return got.select(F.col("edition_id").cast("bigint").alias("o_orderkey"), "status", F.when(F.col("present"), F.array_join("sources", ",")).otherwise("").alias("sources"))


PROVINCE_NAMES, CITY_NAMES, VENUES = ["浙江省", "上海市", "四川", None], ["杭州市", "上海", None], ["浙江省杭州市湖滨公园", "外滩", "上海市上海外滩", " ", None]


@query(rf"""
WITH e AS (SELECT o_orderkey, 'ev' || o_custkey AS event_id, strftime(o_orderdate, '%Y-%m-%d') AS race_date, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') END AS end_date,
    o_orderstatus <> 'P' AS active, o_orderkey % 7 <> 0 AS verified, o_orderkey % 11 = 0 AS test_flag, o_orderkey % 13 <> 0 AS gate FROM orders),
c AS (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag <> 'R' AS ok, l_returnflag = 'R' AND l_linenumber % 2 = 0 AND l_quantity > 5 AS conflict FROM lineitem),
s AS (SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber DESC) AS categories, bool_or(l_linenumber = 1) AS has_primary, CAST(count(*) AS BIGINT) AS n FROM c WHERE ok OR conflict GROUP BY l_orderkey),
p AS (SELECT e.*, categories, n FROM e JOIN s ON o_orderkey = l_orderkey WHERE has_primary AND active AND verified AND NOT test_flag AND gate AND (end_date IS NULL OR end_date >= race_date)),
x AS (SELECT *, CAST(substr(race_date, 6, 2) AS INTEGER) AS m, CAST(substr(race_date, 9, 2) AS INTEGER) AS a, CAST(substr(end_date, 6, 2) AS INTEGER) AS m2, CAST(substr(end_date, 9, 2) AS INTEGER) AS b FROM p)
SELECT o_orderkey, event_id, race_date, end_date, categories, n, CASE WHEN end_date IS NULL THEN m || '月' || a || '日' WHEN substr(race_date, 1, 4) <> substr(end_date, 1, 4) THEN substr(race_date, 1, 4) || '年' || m || '月' || a || '日–' || substr(end_date, 1, 4) || '年' || m2 || '月' || b || '日'
  WHEN m = m2 THEN m || '月' || a || '–' || b || '日' ELSE m || '月' || a || '日–' || m2 || '月' || b || '日' END AS date_display FROM x
""")
def public_editions(spark: SparkSession, d: str) -> DataFrame:
    """Editions that may be shown, with those of their categories that may be, in display order."""
    o, l = t(spark, d, "orders"), t(spark, d, "lineitem")
    none = lambda kind="string": F.lit(None).cast(kind)
    strings = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")

    def governance(verified, status, flags, missing=None, facts=None, trace=None, said=None):
        fields = {
            "verified": verified, "verification_status": status, "internal_flags": flags, "missing_fields": missing if missing is not None else none("array<string>"), "field_sources": facts if facts is not None else none("map<string,string>"),
            "merge_trace": trace if trace is not None else none("array<struct<field:string,selected_source:string,n_candidates:int>>"), "sources": said if said is not None else none("array<struct<source_type:string,raw_data:map<string,string>>>"),
        }
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    trace = F.array(F.struct(F.lit("elevationGain").alias("field"), F.lit("placeholder").alias("selected_source"), F.lit(2).alias("n_candidates")))

    def category(line):
        n, q, returned = line["l_linenumber"], line["l_quantity"].cast("double"), line["l_returnflag"] == "R"
        official = F.array(F.struct(F.lit("official").alias("source_type"), F.create_map(F.lit("startLocation"), F.lit("A"), F.lit("finishLocation"), F.when(n % 2 == 0, "B").otherwise("other")).alias("raw_data")))
        facts = F.create_map(F.lit("distanceKm"), F.when(q > 5, "official").otherwise("media"), F.lit("cutoffTimeHours"), F.lit("official"))
        pending = governance(F.lit(False), F.lit("pending"), strings("elevation_conflict_needs_review"), strings("elevationGain"), facts, trace, official)
        ready = governance(F.lit(True), F.lit("verified"), none("array<string>"), none("array<string>"), facts, trace, official)
        fields = {
            "category_id": F.concat_ws("-", "l_orderkey", n.cast("string")), "edition_id": F.col("l_orderkey").cast("string"), "category_name": F.lit("c"), "short_name": none(), "distance_km": q, "elevation_gain": none("double"), "elevation_loss": none("double"), "cutoff_time_hours": F.lit(6.0),
            "start_at": none(), "start_location": F.lit("A"), "finish_location": F.lit("B"), "registration_url": none(), "display_order": (100 - n).cast("int"), "course_points": none("array<struct<point_id:string,display_order:int,name:string,type:string,distance_km:double,cutoff_at:string>>"),
            "course_point_data_status": none(), "updated_at": F.lit("t"), "governance": F.when(returned, pending).otherwise(ready),
        }
        return F.struct(*[c.alias(k) for k, c in fields.items()])

    # lines travel as they are and become categories in their order's row
    cats = l.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag")).alias("lines")).select("l_orderkey", F.transform("lines", category).alias("categories"))
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    own = governance(k % 7 != 0, F.lit("auto_verified"), F.when(k % 11 == 0, strings("test_only")).otherwise(strings("other")))
    fine = governance(F.lit(True), F.lit("verified"), none("array<string>"))
    event = F.concat(F.lit("ev"), F.col("o_custkey").cast("string"))
    edition = {
        "edition_id": k.cast("string"), "event_id": event, "edition_name": F.lit("E"), "race_date": day.cast("string"), "end_date": F.when(k % 4 == 0, F.date_add(day, 1)).when(k % 4 == 1, F.date_add(day, -1)).cast("string"), "cover_image": none(), "hero_image": none(),
        "primary_category_id": F.concat(k.cast("string"), F.lit("-1")), "country": F.lit("中国"), "province": pick(k, PROVINCE_NAMES), "city": pick(k, CITY_NAMES, 4), "district": none(), "venue": pick(k, VENUES, 12), "registration_status": none(), "registration_url": none(),
        "lifecycle_status": F.when(F.col("o_orderstatus") == "P", "draft").otherwise("active"), "updated_at": F.lit("t"), "governance": own,
    }
    records = o.join(cats, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.struct(event.alias("event_id"), F.lit("marathon").alias("event_type"), F.lit("active").alias("lifecycle_status"), F.lit("t").alias("updated_at"), fine.alias("governance")).alias("event"), F.struct(*[c.alias(n) for n, c in edition.items()]).alias("edition"), "categories"
    )
    gate = o.select(k.cast("string").alias("edition_id"), (k % 13 != 0).alias("gate_publishable"))
    got = publication.publishable_details(records, gate)
    shown = F.transform("categories", lambda c: F.split_part(c["category_id"], F.lit("-"), F.lit(2)))
    return got.select(F.col("edition_id").cast("bigint").alias("o_orderkey"), "event_id", "race_date", "end_date", F.array_join(shown, ",").alias("categories"), F.size("categories").cast("bigint").alias("n"), "date_display")


@query(r"""
WITH g AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS q, list(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 10 ELSE 0 END) AS f, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_orderkey),
u AS (SELECT *, list_filter(f, lambda x: x <> 0) AS paid, list_transform(list_filter(range(1, len(q) + 1), lambda i: list_position(q, q[i]) = i), lambda i: CAST(CAST(q[i] AS BIGINT) AS VARCHAR) || 'KM') AS shown FROM g)
SELECT l_orderkey, array_to_string(shown, ' / ') AS distances, CASE WHEN len(paid) = 0 THEN '报名信息待更新' WHEN list_min(paid) = list_max(paid) THEN '¥' || CAST(list_min(paid) AS BIGINT) ELSE '¥' || CAST(list_min(paid) AS BIGINT) || ' - ¥' || CAST(list_max(paid) AS BIGINT) END AS price,
  CASE WHEN len(paid) > 0 THEN '¥' || CAST(list_min(paid) AS BIGINT) || ' 起' ELSE n || ' 个组别' END AS fee_main, CASE WHEN len(paid) > 0 THEN n || ' 个组别' ELSE '' END AS fee_sub FROM u
""")
def nested_texts(spark: SparkSession, d: str) -> DataFrame:
    """Distances, prices and fee lines of nested categories."""
    lines = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("double").alias("q")))).alias("l"))
    km, fee = F.transform("l", lambda x: x["q"]), F.transform("l", lambda x: F.when(x["l_linenumber"] % 2 == 0, x["q"] * 10).otherwise(0.0))
    main, sub = display.fee_lines(fee)
    return lines.select("l_orderkey", display.distances_text(km).alias("distances"), display.price_text(fee).alias("price"), main.alias("fee_main"), sub.alias("fee_sub"))


@query(r"""
WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS a, CASE WHEN o_orderkey % 3 > 0 THEN strftime(o_orderdate + to_days(CAST(o_orderkey % 40 AS INTEGER)), '%Y-%m-%d') END AS b, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders)
SELECT o_orderkey, CASE WHEN b > a THEN replace(a, '-', '.') || '–' || CASE WHEN substr(a, 1, 4) = substr(b, 1, 4) THEN replace(substr(b, 6), '-', '.') ELSE replace(b, '-', '.') END
  ELSE replace(a, '-', '.') || ' ' || (['周日', '周一', '周二', '周三', '周四', '周五', '周六'])[1 + dayofweek(CAST(a AS DATE))] END AS list_date,
  replace(a, '-', '.') || ' 07:30 / 0' || (8 + o_orderkey % 2) || ':00 分枪' AS starts, format('{:,}', price) AS grouped FROM o
""")
def shown_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates of lists, start times and grouped numbers."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    a, b = day.cast("string"), F.when(k % 3 > 0, F.date_add(day, (k % 40).cast("int"))).cast("string")
    starts = F.array(F.concat(a, F.lit("T07:30:00+08:00")), F.concat(a, F.lit("T0"), (8 + k % 2).cast("string"), F.lit(":00:00+08:00")))
    return t(spark, d, "orders").select("o_orderkey", display.list_date_text(a, b).alias("list_date"), display.start_times_text(starts).alias("starts"), display.grouped_number(F.floor("o_totalprice")).alias("grouped"))


SAYINGS = ["组别官方标称距离：{n} km", "实际赛道距离：{n}.5 km", "报名中，{n}:30 起跑", "registration is closed", "约{n}公里", "结束日期 {n} 日", "抽签中 1{n}:30", "无"]
SAYING_SQL = "replace(" + sql_pick("l_orderkey", SAYINGS) + ", '{n}', CAST(l_linenumber AS VARCHAR))"


@query(rf"""
WITH x AS (SELECT l_orderkey, l_linenumber AS n, {SAYING_SQL} AS e FROM lineitem)
SELECT l_orderkey, n AS l_linenumber, regexp_matches(e, '(^|[^0-9.])' || n || '($|[^0-9.])') AS has_number, regexp_matches(e, '(^|[^0-9])0?' || n || ':30($|[^0-9])') AS has_time,
  regexp_matches(e, '(?i)registration\s+is\s+open|registration\s+open\s+now|报名中|正在报名') AS says_open, regexp_matches(e, '(?i)registration\s+is\s+closed|registration\s+has\s+closed|报名已结束|报名结束') AS says_closed,
  regexp_matches(e, '(?i)end(ing)?\s+date|ends?\s+on|through|until|date\s+range|结束日期|结束时间|至\s*\d') AS says_end, CASE WHEN contains(e, '实际赛道距离') THEN 'actual_course' WHEN contains(e, '组别官方标称距离') THEN 'official_category' ELSE 'unknown' END AS meaning,
  contains(e, '约') AS inexact FROM x
""")
def evidence_tests(spark: SparkSession, d: str) -> DataFrame:
    """Whether a quoted text states a number, a time, a status, an end date, and which distance it means."""
    e, n, v = F.col("e"), F.col("l_linenumber"), F.col("l_linenumber").cast("string")
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.replace(pick(F.col("l_orderkey"), SAYINGS), F.lit("{n}"), v).alias("e"))
    return x.select(
        "l_orderkey", n, ev.has_number(e, v).alias("has_number"), ev.has_time(e, F.concat(F.lpad(v, 2, "0"), F.lit(":30"))).alias("has_time"), ev.states_status(e, F.lit("registration_open")).alias("says_open"), ev.states_status(e, F.lit("registration_closed")).alias("says_closed"),
        e.rlike(ev.END_DATE_WORDS).alias("says_end"), ev.distance_meaning(e).alias("meaning"), ev.inexact_number(e, v).alias("inexact"),
    )


@query("""
WITH one_line AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_quantity) AS l_quantity, min(l_shipdate) AS l_shipdate FROM lineitem GROUP BY ALL),
p AS (SELECT l_orderkey, l_linenumber AS n, l_orderkey || '-' || CASE WHEN l_linenumber % 5 = 0 THEN 'cp-1' ELSE 'lake' || (l_linenumber % 3) END AS id, CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS km,
    CASE WHEN l_linestatus = 'O' THEN l_shipdate END AS cut, l_returnflag = 'A' AS bad_type FROM one_line),
w AS (SELECT *, last_value(km IGNORE NULLS) OVER a AS before, last_value(cut IGNORE NULLS) OVER a AS cut_before, row_number() OVER (PARTITION BY l_orderkey, id ORDER BY n) > 1 AS again FROM p WINDOW a AS (PARTITION BY l_orderkey ORDER BY n, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT l_orderkey, n AS l_linenumber, array_to_string(list_filter([CASE WHEN n % 5 = 0 THEN 'pointId_identity' END, CASE WHEN n % 5 <> 0 AND again THEN 'pointId_unique' END, CASE WHEN bad_type THEN 'type' END, CASE WHEN km < before THEN 'distance_decreases' END,
  CASE WHEN cut < cut_before THEN 'cutoff_backwards' END], lambda x: x IS NOT NULL), ',') AS issues FROM w
""")
def course_points(spark: SparkSession, d: str) -> DataFrame:
    """Ordered course points: identity, order, distances that don't fall, cutoffs that don't go back."""
    n, e = F.col("l_linenumber"), F.col("l_orderkey").cast("string")
    key = F.when(n % 5 == 0, "cp-1").otherwise(F.concat(F.lit("lake"), (n % 3).cast("string")))
    pts = one_line(spark, d).select(
        "l_orderkey", "l_linenumber", e.alias("category_id"), F.concat_ws("-", e, key).alias("point_id"), n.alias("display_order"), F.lit("p").alias("name"), F.when(F.col("l_returnflag") == "A", "x").otherwise("finish").alias("type"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast("double")).alias("distance_km"), F.when(F.col("l_linestatus") == "O", F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))).alias("cutoff_at"),
    )
    return gates.course_point_issues(pts).select("l_orderkey", "l_linenumber", F.array_join("issues", ",").alias("issues"))


@query("""
WITH s AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'applied' END AS status, 'v' || o_orderkey % 3 AS v FROM orders WHERE o_orderkey % 4 <> 0), i AS (SELECT o_orderkey AS k, 'v' || CASE WHEN o_orderkey % 10 = 1 THEN 9 ELSE o_orderkey % 3 END AS v FROM orders WHERE o_orderkey % 3 = 1)
SELECT coalesce(s.k, i.k) AS o_orderkey, coalesce(status, 'pending') AS status, CASE WHEN s.k IS NULL THEN i.v ELSE s.v END AS value,
  CASE WHEN s.k IS NULL THEN 'new' WHEN i.k IS NULL THEN 'kept' WHEN s.v <> i.v THEN 'collision' WHEN status <> 'pending' THEN 'immutable' ELSE 'refreshed' END AS outcome,
  CASE WHEN s.k IS NULL THEN 'b' WHEN i.k IS NOT NULL AND s.v = i.v AND status = 'pending' THEN 'a,b' ELSE 'a' END AS evidence FROM s FULL OUTER JOIN i ON s.k = i.k
""")
def pending_merge(spark: SparkSession, d: str) -> DataFrame:
    """Pending changes merged with incoming ones: reviewed rows stand, pending ones take up evidence, other values collide."""
    o, k = t(spark, d, "orders"), F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "approved").otherwise("applied")
    row = lambda df, status, v, e: df.select(k.alias("change_id"), status.alias("status"), F.concat(F.lit("v"), v.cast("string")).alias("value"), F.array(F.lit(e)).alias("evidence"))
    got = cdc.merge_pending(row(o.where(k % 4 != 0), status, k % 3, "a"), row(o.where(k % 3 == 1), F.lit("pending"), F.when(k % 10 == 1, 9).otherwise(k % 3), "b"))
    return got.select(F.col("change_id").alias("o_orderkey"), "status", "value", "outcome", F.array_join("evidence", ",").alias("evidence"))


@query("""
WITH s AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' ELSE 'applied' END AS status, CASE c_custkey % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'applied' ELSE 'rejected' END AS to_ FROM customer)
SELECT c_custkey, CASE WHEN (status = 'pending' AND to_ IN ('approved', 'rejected')) OR (status = 'approved' AND to_ = 'applied') THEN to_ ELSE status END AS status FROM s
""")
def change_transitions(spark: SparkSession, d: str) -> DataFrame:
    """One step of the review state machine for every change; refused steps leave it as it is."""
    k = F.col("c_custkey")
    c = t(spark, d, "customer")
    store = c.select(k.alias("change_id"), pick(k, ["pending", "approved", "rejected", "applied"]).alias("status"))
    moved, _ = cdc.transition(store, c.select(k.alias("change_id"), pick(k, ["approved", "applied", "rejected"]).alias("to")))
    return moved.select(F.col("change_id").alias("c_custkey"), "status")


@query("""
WITH f AS (SELECT l_orderkey, l_linenumber, date_diff('day', DATE '1996-06-30', CAST(l_shipdate AS DATE)) AS days, l_quantity AS q, l_returnflag AS r, l_linestatus AS s FROM lineitem),
a AS (SELECT *, days BETWEEN 0 AND 14 AS near FROM f)
SELECT l_orderkey, l_linenumber, 'no_source' AS reason, CASE WHEN near THEN 'high' ELSE 'medium' END AS severity FROM a WHERE q < 5
UNION ALL SELECT l_orderkey, l_linenumber, 'source_conflict', 'high' FROM a WHERE q > 45
UNION ALL SELECT l_orderkey, l_linenumber, 'source_unreachable', CASE WHEN near THEN 'high' ELSE 'low' END FROM a WHERE r = 'R'
UNION ALL SELECT l_orderkey, l_linenumber, 'never_verified', CASE WHEN near THEN 'high' ELSE 'medium' END FROM a WHERE r = 'N' AND s = 'O'
UNION ALL SELECT l_orderkey, l_linenumber, 'evidence_expired', 'medium' FROM a WHERE q = 30
UNION ALL SELECT l_orderkey, l_linenumber, 'race_imminent_inherited', 'medium' FROM a WHERE near AND NOT (r = 'N' AND s = 'O')
""")
def verification_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of critical facts by reason and severity."""
    q = F.col("l_quantity")
    unverified = (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")
    facts = t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("edition_id"), F.col("l_linenumber").alias("field"), F.to_date("l_shipdate").alias("race_date"), F.when(unverified, "UNKNOWN").otherwise("INHERITED").alias("status"), F.when(q < 5, 0).otherwise(1).alias("n_sources"),
        F.when(q > 45, 2).otherwise(1).alias("n_conflicts"), (F.col("l_returnflag") == "R").alias("source_failed"), (q == 30).alias("expired"),
    )
    return monitor.verification_alerts(facts, "1996-06-30").withColumnsRenamed({"edition_id": "l_orderkey", "field": "l_linenumber"})


FACT_FIELDS = ["raceDate", "startAt", "distanceKm", "elevationGain", "registrationUrl", "city"]
FACT_VALUES = ["2026-02-30", "2026-05-03", "2026-05-03T07:30:00+08:00", "2026-05-03T07:30:00", "0", "-5", "12.5", "https://x.cn/a", "x.cn", None]


@query(rf"""
WITH x AS (SELECT p_partkey, {sql_pick('p_partkey', FACT_FIELDS)} AS f, {sql_pick('p_partkey', FACT_VALUES, 6)} AS v FROM part), n AS (SELECT *, CASE WHEN regexp_matches(v, '^-?\d+(\.\d+)?$') THEN CAST(v AS DOUBLE) END AS num FROM x)
SELECT p_partkey, CASE WHEN v IS NULL THEN 'empty' WHEN f = 'raceDate' AND (NOT regexp_matches(v, '^\d{{4}}-\d{{2}}-\d{{2}}$') OR try_cast(v AS DATE) IS NULL) THEN 'date' WHEN f = 'startAt' AND v <> '2026-05-03T07:30:00+08:00' THEN 'zoned_time'
  WHEN f = 'distanceKm' AND coalesce(num <= 0, true) THEN 'positive_number' WHEN f = 'elevationGain' AND coalesce(num < 0, true) THEN 'number' WHEN f = 'registrationUrl' AND NOT regexp_matches(v, '^https?://[^\s/]+') THEN 'url' END AS issue FROM n
""")
def field_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of facts by the kind of their field."""
    k = F.col("p_partkey")
    return t(spark, d, "part").select("p_partkey", gates.field_value_issues(pick(k, FACT_FIELDS), pick(k, FACT_VALUES, 6)).alias("issue"))


@query("""
WITH s AS (SELECT c_custkey, 'h' || c_custkey % 5 AS observed, 'h' || c_custkey % 7 AS success FROM customer WHERE c_custkey % 6 <> 0), r AS (SELECT c_custkey, 'n' || c_custkey % 4 AS hash, c_custkey % 3 <> 0 AS fetched, c_custkey % 2 = 0 AS ok FROM customer WHERE c_custkey % 4 <> 1)
SELECT coalesce(s.c_custkey, r.c_custkey) AS c_custkey, CASE WHEN fetched THEN hash ELSE observed END AS observed_hash, CASE WHEN fetched AND ok THEN hash ELSE success END AS success_hash,
  CASE WHEN r.c_custkey IS NULL THEN 'ok' WHEN fetched THEN 'ok' ELSE 'failed' END AS fetch_status FROM s FULL OUTER JOIN r ON s.c_custkey = r.c_custkey
""")
def source_state(spark: SparkSession, d: str) -> DataFrame:
    """State of sources after a run: observed hashes always move, successful ones with a success, a failed fetch moves neither."""
    c, k = t(spark, d, "customer"), F.col("c_custkey")
    tag = lambda p, n: F.concat(F.lit(p), (k % n).cast("string"))
    before = c.where(k % 6 != 0).select("c_custkey", tag("h", 5).alias("observed_hash"), tag("h", 7).alias("success_hash"), F.lit("t0").alias("checked_at"), F.lit("ok").alias("fetch_status"))
    run = c.where(k % 4 != 1).select("c_custkey", tag("n", 4).alias("hash"), (k % 3 != 0).alias("fetched"), (k % 2 == 0).alias("succeeded"), F.lit("t1").alias("at"))
    return state.advance(before, run, ["c_custkey"]).select("c_custkey", "observed_hash", "success_hash", "fetch_status")


@query("""
WITH a AS (SELECT s_suppkey AS k, s_nationkey AS n, 'x' AS at FROM supplier WHERE s_suppkey % 5 <> 0), b AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 = 0 THEN -1 ELSE s_nationkey END AS n, CASE WHEN s_suppkey % 3 = 0 THEN 'y' ELSE 'x' END AS at FROM supplier WHERE s_suppkey % 4 <> 0)
SELECT s_suppkey, change FROM (SELECT coalesce(a.k, b.k) AS s_suppkey, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.n <> b.n THEN 'changed' WHEN a.at <> b.at THEN 'volatile_only' END AS change FROM a FULL OUTER JOIN b ON a.k = b.k) WHERE change IS NOT NULL
""")
def meaningful_changes(spark: SparkSession, d: str) -> DataFrame:
    """Rows that changed in more than their volatile columns, and those that did not."""
    s, k = t(spark, d, "supplier"), F.col("s_suppkey")
    a = s.where(k % 5 != 0).select("s_suppkey", "s_nationkey", F.lit("x").alias("at"))
    b = s.where(k % 4 != 0).select("s_suppkey", F.when(k % 7 == 0, F.lit(-1).cast(s.schema["s_nationkey"].dataType)).otherwise(F.col("s_nationkey")).alias("s_nationkey"), F.when(k % 3 == 0, "y").otherwise("x").alias("at"))
    return sets.meaningful_changes(a, b, "s_suppkey", ["at"])


@query("""
WITH g AS (SELECT o_custkey, count(*) AS n, avg(CAST(o_orderkey % 4 AS DOUBLE) / 4) AS s FROM orders GROUP BY o_custkey), f AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)
SELECT f.o_custkey, f.o_orderkey, CASE WHEN rn <= 10 THEN 'now' ELSE 'deferred' END AS fetch, CAST(floor(s * 100 + 0.5) AS BIGINT) AS mean_hundredths FROM f JOIN g USING (o_custkey)
""")
def fetch_budget(spark: SparkSession, d: str) -> DataFrame:
    """The first ten requests of each group now, the rest later; with the group's mean confidence in hundredths."""
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey")
    mean = merge.average_confidence(o.withColumn("c", (F.col("o_orderkey") % 4).cast("double") / 4), ["o_custkey"], "c")
    mean = mean.select("o_custkey", F.floor(F.col("confidence") * 100 + 0.5).cast("bigint").alias("mean_hundredths"))
    return registry.fetch_budget(o, ["o_custkey"], ["o_orderkey"]).join(mean, "o_custkey")


CARD_NAMES, CARD_STATES, CARD_PROVINCES = ["湖滨马拉松", "莫干山越野", "城市跑", "半程赛", "FUGA 挑战"], [None, "1", "lottery", "候补", "closed", "已结束", "即将开始", "open", "?"], ["浙江", "日本", None, "四川", "某地"]
RECORD_SQL = f"""
c AS (SELECT l_orderkey, list(CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity * 2 END) AS km, max(CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_quantity * 2 END) AS longest, bool_or(l_linenumber % 3 <> 0 AND l_quantity * 2 >= 40 AND l_quantity * 2 < 50) AS full_, count(*) FILTER (l_linenumber % 3 <> 0) AS n_km,
  count(*) AS n, max(CASE WHEN l_linenumber = 2 THEN l_quantity * 40 ELSE 0 END) AS steep FROM lineitem GROUP BY l_orderkey),
r AS (SELECT o_orderkey, {sql_pick('o_orderkey', CARD_NAMES)} AS name, {sql_pick('o_orderkey', CARD_STATES, 2)} AS st, {sql_pick('o_orderkey', CARD_PROVINCES, 3)} AS province, CASE WHEN o_orderkey % 9 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date, CASE WHEN o_orderkey % 5 = 0 THEN 'u' END AS url,
  date_diff('day', DATE '1996-06-30', CAST(o_orderdate AS DATE)) AS days, c.* FROM orders JOIN c ON o_orderkey = l_orderkey)"""


def race_records(spark: SparkSession, d: str) -> DataFrame:
    n, q, k = F.col("l_linenumber"), F.col("l_quantity").cast("double"), F.col("o_orderkey")
    none = F.lit(None).cast("string")
    item = F.struct(none.alias("category_name"), F.when(n % 3 != 0, q * 2).alias("distance_km"), F.when(n == 2, q * 40).alias("elevation_gain"), F.lit(None).cast("double").alias("registration_fee"), none.alias("cutoff_time"), none.alias("registration_url"))
    cats = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("categories"))
    name = pick(k, CARD_NAMES)
    return t(spark, d, "orders").join(cats, k == F.col("l_orderkey")).select(
        k.cast("string").alias("id"), name.alias("normalized_name"), F.array(name).alias("original_names"), F.lit(None).cast("int").alias("edition_year"), F.when(k % 9 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("race_date"), pick(k, CARD_PROVINCES, 3).alias("province"), none.alias("city"),
        none.alias("district"), none.alias("venue"), pick(k, CARD_STATES, 2).alias("registration_status"), F.when(k % 5 == 0, "u").alias("registration_url"), none.alias("source_url"), none.alias("cover_image"), (k % 100).cast("double").alias("confidence"), "categories",
    )


@query(rf"""
WITH {RECORD_SQL},
y AS (SELECT *, CASE WHEN regexp_matches(name, '(?i)越野|跑山|山径|trail|贡嘎|FUGA') THEN CASE WHEN longest >= 50 THEN 'ultra_trail' ELSE 'trail' END WHEN full_ THEN 'marathon' WHEN n_km > 0 AND longest <= 22 THEN 'half_marathon' WHEN regexp_matches(name, '半程|半马') THEN 'half_marathon'
  WHEN contains(name, '马拉松') THEN 'marathon' ELSE 'other' END AS type, CASE WHEN date IS NOT NULL AND days = 0 THEN 'racing' WHEN url IS NOT NULL THEN 'registration_open' WHEN regexp_matches(st, 'lottery|抽签|摇号') THEN 'lottery' WHEN regexp_matches(st, 'waiting|候补|等候') THEN 'registration_open'
  WHEN regexp_matches(st, 'closed|截止|关闭') THEN 'closed' WHEN regexp_matches(st, 'finished|结束|cancel|取消') THEN 'finished' WHEN date IS NOT NULL AND days < 0 THEN 'finished' WHEN st IS NULL OR st = '1' THEN 'unknown' WHEN regexp_matches(st, 'open|报名|点此') THEN 'registration_open'
  WHEN regexp_matches(st, 'upcoming|即将') THEN 'upcoming' ELSE 'unknown' END AS status FROM r)
SELECT o_orderkey, type, status, CASE WHEN province IS NULL THEN 'unknown' ELSE CASE province WHEN '浙江' THEN 'east_china' WHEN '四川' THEN 'southwest_china' WHEN '日本' THEN 'overseas' ELSE 'unknown' END END AS region,
  CASE WHEN type = 'half_marathon' THEN 'beginner' WHEN type = 'marathon' THEN 'intermediate' WHEN type IN ('trail', 'ultra_trail') THEN CASE WHEN longest >= 100 THEN 'high_challenge' WHEN longest >= 50 THEN 'challenge' ELSE 'intermediate' END ELSE 'unknown' END AS difficulty,
  CASE WHEN date IS NULL THEN '具体日期待更新' WHEN days > 0 THEN '距离开赛 ' || days || ' 天' WHEN days = 0 THEN '今日开赛' ELSE '已结束' END AS countdown,
  status NOT IN ('closed', 'finished') AND CASE WHEN date IS NOT NULL THEN days >= 0 ELSE status IN ('registration_open', 'upcoming', 'lottery') END AS valuable FROM y
""")
def race_cards(spark: SparkSession, d: str) -> DataFrame:
    """Card columns of merged records, and whether a card is worth a recommendation."""
    c = cards.cards(race_records(spark, d), "1996-06-30")
    good = cards.valuable(c).select("id", F.lit(True).alias("valuable"))
    out = c.join(good, "id", "left")
    return out.select(F.col("id").cast("bigint").alias("o_orderkey"), "type", F.col("registration_status").alias("status"), "region", "difficulty", F.col("countdown_text").alias("countdown"), F.coalesce("valuable", F.lit(False)).alias("valuable"))


@query(rf"""
WITH {RECORD_SQL},
y AS (SELECT *, CASE WHEN regexp_matches(name, '(?i)越野|跑山|山径|穿越|trail|贡嘎|崇礼|柴古|莫干|武功山|168') OR steep >= 500 THEN CASE WHEN longest >= 50 THEN 'ultra_trail' ELSE 'trail' END WHEN regexp_matches(name, '半程|半马') THEN 'half_marathon' WHEN contains(name, '马拉松') OR full_ THEN 'marathon' ELSE 'other' END AS type,
  CASE WHEN date IS NOT NULL AND days = 0 THEN 'racing' WHEN date IS NOT NULL AND days < 0 THEN 'finished' WHEN url IS NOT NULL THEN 'registration_open' WHEN regexp_matches(st, 'lottery|抽签|摇号') THEN 'lottery' WHEN regexp_matches(st, 'closed|截止|关闭') THEN 'closed' WHEN regexp_matches(st, 'finished|结束') THEN 'finished'
    WHEN regexp_matches(st, 'upcoming|即将') THEN 'upcoming' WHEN regexp_matches(st, 'open|报名') THEN 'registration_open' ELSE 'unknown' END AS status FROM r)
SELECT o_orderkey, type, status, n_km AS n_categories, CASE WHEN longest >= 40 THEN '全马' WHEN longest >= 20 THEN '半马' WHEN longest > 0 THEN '短距' END AS road, CASE WHEN date IS NOT NULL AND days > 0 THEN '距离比赛 ' || days || ' 天' WHEN date IS NOT NULL AND days = 0 THEN '今日比赛' END AS countdown,
  '如何报名' || name || '？' AS question, status = 'registration_open' AND url IS NOT NULL AS open FROM y
""")
def decision_pages(spark: SparkSession, d: str) -> DataFrame:
    """Decision pages of merged records: type, status, categories shown, the verdict of the longest one on the road, questions."""
    p = cards.decision_pages(race_records(spark, d), "1996-06-30")
    longest = F.array_max(F.transform("categories", lambda c: c["distance_km"]))
    road = cards.category_advice(F.lit("marathon"), F.struct(longest.alias("distance_km"), F.lit(None).cast("double").alias("elevation_gain"), F.lit(None).cast("string").alias("cutoff_time")))["verdict"]
    return p.select(
        F.col("id").cast("bigint").alias("o_orderkey"), "type", F.col("registration_status").alias("status"), F.size("categories").cast("bigint").alias("n_categories"), F.left(road, F.lit(2)).alias("road"), F.col("countdown_text").alias("countdown"), F.col("faq")[0]["question"].alias("question"),
        (F.col("faq")[0]["answer"] == cards.ANSWERS["open"]).alias("open"),
    )


PROFILE = {"targetRaceType": "trail", "targetDistance": 30, "longestCompletedRace": "half_marathon", "runnerExperience": "intermediate", "regionPreference": "east_china", "travelScope": "nationwide", "isFirstTrail": True, "hasPersonalBest": True}
RACE_TYPES, REGIONS = ["trail", "ultra_trail", "marathon", "utmb"], ["east_china", "south_china", "asia"]


@query(f"""
WITH p AS (SELECT p_partkey, {sql_pick('p_partkey', RACE_TYPES)} AS type, {sql_pick('p_partkey', REGIONS, 4)} AS region, p_size AS km, 1 + p_partkey % 10 AS level, p_partkey % 2 = 0 AS easy, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS tags FROM part),
s AS (SELECT p_partkey, CASE type WHEN 'trail' THEN 0 WHEN 'ultra_trail' THEN 1 ELSE 2 END AS pr, CASE type WHEN 'trail' THEN 25 WHEN 'ultra_trail' THEN 16 ELSE 8 END + CASE WHEN abs(km - 30) <= 1 THEN 20 WHEN abs(km - 30) <= 10 THEN 14 WHEN abs(km - 30) <= 25 THEN 8 ELSE 0 END
  + CASE WHEN level BETWEEN 3 AND 5 THEN 30 ELSE 18 END + CASE WHEN region = 'east_china' THEN 15 ELSE 8 END + least(10, least(8, 2 * tags) + CASE WHEN easy THEN 2 ELSE 0 END + 2) AS score FROM p WHERE type <> 'marathon' AND region <> 'asia' AND level <= 6 AND (level BETWEEN 3 AND 5 OR level <= 6))
SELECT p_partkey, CAST(pr AS INTEGER) AS type_priority, CAST(score AS INTEGER) AS score FROM s ORDER BY pr, score DESC, p_partkey LIMIT 20
""")
def recommended_categories(spark: SparkSession, d: str) -> DataFrame:
    """The best race categories for a runner profile; the limit is the feature (a top-k report)."""
    k = F.col("p_partkey")
    tags = F.when(k % 3 == 0, F.array(F.lit("TRAIL"), F.lit("MOUNTAIN_ROUTE"), F.lit("x"))).otherwise(F.array(F.lit("BEGINNER"), F.lit("y")))
    item = F.struct(F.col("p_size").cast("double").alias("distanceKm"), F.concat(F.lit("L"), (k % 10 + 1).cast("string")).alias("difficultyLevel"), (k % 2 == 0).alias("beginnerFriendly"))
    races = t(spark, d, "part").select("p_partkey", pick(k, RACE_TYPES).alias("type"), pick(k, REGIONS, 4).alias("region"), tags.alias("tags"), F.array(item).alias("categories"), k.alias("ord"))
    return rank.recommend_categories(races, PROFILE, 20).select("p_partkey", "type_priority", "score")
