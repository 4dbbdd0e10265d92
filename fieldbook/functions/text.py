"""Text rules: white space and rounding of the source system, names, dates, distances, states, URLs, HTML, hashes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the source system: includes NBSP and the ideographic space.
WS = r"(?U)[\s﻿]"


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s﻿]+|[\s﻿]+$", "")


def js_round(c: Column) -> Column:
    """Half rounds up, towards positive infinity."""
    return F.floor(c + F.lit(0.5))


def word_bound(pattern: str) -> str:
    """``\\b`` as the source system has it: only ASCII letters, digits and _ are word characters."""
    return rf"(?<![0-9A-Za-z_])(?:{pattern})(?![0-9A-Za-z_])"


def first_match(text: Column, rules: Sequence[tuple[str, object]], otherwise: Column | None = None) -> Column:
    """Value of the first rule whose pattern is found; the order of the rules decides."""
    return first_match_all(text, [((pattern,), value) for pattern, value in rules], otherwise)


def first_match_all(text: Column, rules: Sequence[tuple[tuple[str, ...], object]], otherwise: Column | None = None) -> Column:
    """Value of the first rule all of whose patterns are found; a value may be a column."""
    out = otherwise if otherwise is not None else F.lit(None)
    for patterns, value in reversed(rules):
        hit = reduce(lambda x, y: x & y, (text.rlike(p) for p in patterns))
        out = F.when(hit, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def rewrite(text: Column, steps: Sequence[tuple[str, str]]) -> Column:
    """The text after each ``(pattern, replacement)`` step."""
    return reduce(lambda c, step: F.regexp_replace(c, *step), steps, text)


# fixed values: ordered keyword rules, first hit wins
RACE_STATUS_RULES = [
    (r"(?i)报名中|开放|registration open", "registration_open"),
    (r"(?i)抽签|lottery", "lottery"),
    (r"(?i)已截止|截止|closed", "closed"),
    (r"(?i)取消|cancel", "cancelled"),
    (r"(?i)结束|完赛|finished", "finished"),
]
CONNECTOR_STATUS_RULES = [
    (r"registration_open|报名|点此报名|一键报名", "registration_open"),
    (r"lottery|抽签", "lottery"),
    (r"closed|关闭|截止|结束", "closed"),
    (r"finished|完赛|已结束", "finished"),
]


def race_status(text: Column, date: Column, year: Column, as_of: str) -> Column:
    """Status from text, else from the date or year against ``as_of`` (YYYY-MM-DD)."""
    today, this_year = F.lit(as_of).cast("date"), int(as_of[:4])
    by_time = F.when(date.isNotNull() & (date < today), "finished").when(year < this_year, "finished").when(year >= this_year, "upcoming").otherwise("unknown")
    return first_match(F.coalesce(text, F.lit("")), RACE_STATUS_RULES, by_time)


def connector_status(text: Column) -> Column:
    """Connector variant: any mention of registration counts as open; unknown words stay as they are."""
    return F.when(text.isNull() | (text == ""), F.lit(None)).otherwise(first_match(text, CONNECTOR_STATUS_RULES, text))


# fixed values: race types of a lower-cased text, first rule all of whose patterns are found
RACE_TYPE_RULES = [
    ((r"utmb",), "utmb"),
    ((r"triathlon|铁人三项",), "triathlon"),
    ((r"ultra|100\s?km|百公里|超级|超马", r"trail|越野|山"), "ultra_trail"),
    ((r"trail|越野|山地",), "trail"),
    ((r"半程马拉松|半马|21\.?1",), "half_marathon"),
    ((r"马拉松|全马|42\.?2|42\.195|marathon",), "marathon"),
    ((r"跑|run|running|km|公里",), "road_running"),
]
# fixed values: what is taken out of names, step by step (the four kinds of names differ on purpose)
DISPLAY_NAME_STEPS = [
    (r"[【】\[\]()（）]", " "),
    (word_bound(r"20\d{2}"), " "),
    (rf"20\d{{2}}{WS}*年?", " "),
    (rf"{WS}+", " "),
    (rf"^第[一二三四五六七八九十\d]+届{WS}*", ""),
    (r"赛$", ""),
]
CONNECTOR_NAME_STEPS = [(rf"^{WS}*20\d{{2}}{WS}*", ""), (rf"{WS}*20\d{{2}}{WS}*$", ""), (r"(?U)^[·・\-—\s]+|[·・\-—\s]+$", ""), (r"赛$", ""), (rf"{WS}+", "")]
DEDUPE_NAME_STEPS = [(r"[·・\-—“”\"']", ""), (r"（.*?）|\(.*?\)", "")]
CATALOG_NAME_STEPS = [(rf"^{WS}*20\d{{2}}{WS}*", ""), (rf"{WS}*20\d{{2}}{WS}*$", ""), *DEDUPE_NAME_STEPS, (r"赛$", ""), (rf"{WS}+", "")]
# fixed values: distances by name (a second pattern rules them out), and units in kilometres
NAMED_DISTANCES = [(r"半程马拉松|半马|21\.0975|21\.1", None, 21.1), (r"全马|马拉松|42\.195|42\.2", "半", 42.2)]
DISTANCE_UNITS = [(r"(?:mile|miles|英里)", 1.60934), (r"(?:km|公里|k(?![0-9A-Za-z_]))", 1.0)]
ELEVATION = r"(?i)(?:D\+|爬升|累计爬升)?\s*(\d{2,5})\s?(?:m|米)?"


def race_type(text: Column) -> Column:
    """Race type of a text by its words."""
    return first_match_all(F.lower(text), RACE_TYPE_RULES, F.lit("other"))


def display_name(name: Column) -> Column:
    """Shown name: brackets, years, edition ordinals and a final 赛 removed; empty gives ``unknown``."""
    return F.when(name.isNull() | (name == ""), F.lit("unknown")).otherwise(js_trim(rewrite(name, DISPLAY_NAME_STEPS)))


def connector_name(name: Column) -> Column:
    """Connector name: leading or final year, edge dots and dashes, a final 赛 and all white space removed."""
    return js_trim(rewrite(name, CONNECTOR_NAME_STEPS))


def dedupe_name(name: Column) -> Column:
    """Key for duplicate search: connector name without dots, quotes and bracketed parts, lower-cased."""
    return F.lower(rewrite(connector_name(name), DEDUPE_NAME_STEPS))


def catalog_name(name: Column) -> Column:
    """Key of catalog records: as for duplicate search, but marks go before the final 赛, so more of them lose it."""
    return js_trim(F.lower(rewrite(name, CATALOG_NAME_STEPS)))


def date_match(text: Column) -> Column:
    """The date in a loosely written text as ``y-m-d``, ``y-m`` or ``y``; null where there is none."""
    dashed = F.translate(rewrite(text, [(rf"{WS}+", "")]), "年月/.日", "----")
    # the first full date counts, wherever a shorter one stands before it
    found = [F.regexp_extract(t, pattern, 0) for t, pattern in ((dashed, r"20\d{2}-\d{1,2}-\d{1,2}"), (dashed, r"20\d{2}-\d{1,2}"), (text, r"20\d{2}"))]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found])


def date_parts(match: Column) -> tuple[Column, Column, Column]:
    """``(year, month, date string)`` of a :func:`date_match`."""
    parts = F.split(match, "-")
    part = lambda k: F.get(parts, F.lit(k))
    date = F.when(part(2).isNotNull(), F.concat_ws("-", part(0), F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0")))
    return part(0).cast("int"), part(1).cast("int"), date


def flexible_date(text: Column) -> tuple[Column, Column, Column]:
    """``(year, month, date string)`` of a loosely written date; no calendar check."""
    return date_parts(date_match(text))


def distance_km(text: Column) -> Column:
    """Kilometres of a distance text; named distances first, then miles, then kilometres."""
    t = F.lower(text)
    out = F.lit(None).cast("double")
    for unit, factor in reversed(DISTANCE_UNITS):
        n = F.regexp_extract(t, rf"(\d+(?:\.\d+)?)\s?{unit}", 1)
        out = F.coalesce(js_round(n.try_cast("double") * factor * 10) / 10, out)
    for pattern, but, km in reversed(NAMED_DISTANCES):
        out = F.when(t.rlike(pattern) & (~t.rlike(but) if but else F.lit(True)), F.lit(km)).otherwise(out)
    return F.when(text != "", out)


def elevation_m(text: Column) -> Column:
    return F.regexp_extract(text, ELEVATION, 1).try_cast("int")


# fixed values: provinces by region
REGION_PROVINCES = {
    "east_china": ("上海", "江苏", "浙江", "安徽", "福建", "江西", "山东"),
    "south_china": ("广东", "广西", "海南"),
    "hongkong_macao_taiwan": ("香港", "澳门", "台湾"),
    "north_china": ("北京", "天津", "河北", "山西", "内蒙古"),
    "central_china": ("河南", "湖北", "湖南"),
    "southwest_china": ("重庆", "四川", "贵州", "云南", "西藏"),
    "northwest_china": ("陕西", "甘肃", "青海", "宁夏", "新疆"),
    "northeast_china": ("辽宁", "吉林", "黑龙江"),
}
MUNICIPALITIES = ("北京", "上海", "天津", "重庆")
OVERSEAS_RULES = [
    (r"(?i)hong kong|macau|taiwan|香港|澳门|台湾", "hongkong_macao_taiwan"),
    (r"(?i)japan|korea|thailand|singapore|asia", "asia"),
    (r"(?i)france|italy|spain|switzerland|europe", "europe"),
    (r"(?i)usa|canada|america|north america", "north_america"),
    (r"(?i)[a-z]{3,}", "other_overseas"),
]
CITY = r"([\x{4e00}-\x{9fa5}]{2,8}(?:市|自治州|地区|盟|县))"
CITY_SUFFIX = r"市|自治州|地区|盟|县|区$"


#: Region of each place, longer names first: a name may hold a shorter one.
REGION_OF = dict(sorted(((p, region) for region, places in REGION_PROVINCES.items() for p in places), key=lambda x: -len(x[0])))


def location_parts(province: Column, city: Column, location: Column, name: Column) -> tuple[Column, Column, Column]:
    """``(province, city, region)``, each by its levels of evidence: what is stated, what follows from the province, what the texts name.

    ``unknown`` stands where no level speaks. The texts are joined once and looked up in the table of places.
    """
    unknown, said = F.lit("unknown"), [F.nullif(c, F.lit("")) for c in (province, city, location, name)]
    places, regions = F.array(*map(F.lit, REGION_OF)), F.create_map(*[F.lit(x) for pair in REGION_OF.items() for x in pair])

    def found(text: Column) -> Column:
        town = F.regexp_replace(F.regexp_extract(text, CITY, 1), f"^(.*?)(?:{CITY_SUFFIX})", "$1")
        return F.struct(F.get(F.filter(places, lambda p: F.contains(text, p)), F.lit(0)).alias("place"), F.nullif(town, F.lit("")).alias("town"), first_match(text, OVERSEAS_RULES, unknown).alias("region"))

    of_texts = F.get(F.transform(F.array(F.concat_ws(" ", *said)), found), F.lit(0))
    where = F.coalesce(said[0], of_texts["place"], unknown)
    own_city = F.when(where.isin(*MUNICIPALITIES), where)
    return where, F.coalesce(F.nullif(said[1], unknown), own_city, of_texts["town"], unknown), F.coalesce(F.try_element_at(regions, where), of_texts["region"])


# ---- HTML ------------------------------------------------------------------------------------------------

# fixed values: entities that are decoded, in order
ENTITIES = (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def decode_entities(c: Column) -> Column:
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


# fixed values: what counts as noise in a page, and what an anchor looks like
INVISIBLE = ("script", "style")
NOISE = (*INVISIBLE, "noscript", "svg", "nav", "footer", "form")
ANCHOR = r"""(?is)<a\b[^>]*?href=["']([^"']+)["'][^>]*>(.*?)</a>"""
RACE_WORDS = r"(?i)马拉松|半程|半马|越野|跑|trail|marathon|ultra|race|event|calendar|赛事|公里|km"


def strip_html(html: Column) -> Column:
    """Text of a page: scripts, styles and tags become spaces, then entities, then runs of white space."""
    steps = [*((rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ") for tag in INVISIBLE), (r"(?s)<[^>]+>", " ")]
    return F.btrim(F.regexp_replace(decode_entities(rewrite(html, steps)), r"[ \t\n\r\f\x0B]+", " "))


def remove_noise(html: Column) -> Column:
    """Drops comments and whole elements of the kinds in ``NOISE``."""
    return rewrite(html, [(r"(?s)<!--.*?-->", " "), (rf"(?is)<({'|'.join(NOISE)})\b[^>]*>.*?</\1>", " ")])


def normalize_lines(text: Column) -> Column:
    """Lines trimmed, inner white space single, blank lines dropped."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: js_trim(F.regexp_replace(x, rf"{WS}+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def links(html: Column) -> Column:
    """``array<struct<href, label>>`` of the anchors of a page."""
    found = F.arrays_zip(*[F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(k)).alias(n) for k, n in ((1, "href"), (2, "label"))])
    return F.transform(found, lambda x: F.struct(x["href"].alias("href"), strip_html(x["label"]).alias("label")))


def race_links(html: Column) -> Column:
    """Anchors whose label has 4 to 80 characters and a race word, each label and link once."""
    return F.array_distinct(F.filter(links(html), lambda x: F.length(x["label"]).between(4, 80) & x["label"].rlike(RACE_WORDS)))


# ---- URLs ------------------------------------------------------------------------------------------------

# fixed values: parameters that are dropped, and those that make an address unfit to be kept
TRACKING = r"(?i)^(?:utm_|fbclid$|gclid$)"
SECRET_PARAMETERS = r"(?i)^(?:token|access_token|api_key|password|secret)$"


def candidate_url(url: Column, drop: str | None = None) -> Column:
    """http(s) address for comparing: host in lower case, no fragment, parameters sorted by name, no final slashes.

    Null for other schemes. Parameters of one name keep their order; ``drop`` matches names that are left out.
    """
    part = lambda k: F.regexp_extract(url, r"^(?i)(https?)://([^/?#]+)([^?#]*)(?:\?([^#]*))?", k)
    host = F.regexp_replace(F.lower(part(2)), F.when(F.lower(part(1)) == "https", r":443$").otherwise(r":80$"), F.lit(""))
    path = F.regexp_replace(part(3), "/+$", "")
    path = F.when((path == "") | (part(3) == ""), F.lit("/")).otherwise(path)
    name = lambda p: F.substring_index(p, "=", 1)
    pairs = F.filter(F.split(part(4), "&"), lambda p: (p != "") & (~name(p).rlike(drop) if drop else F.lit(True)))
    placed = F.array_sort(F.transform(pairs, lambda p, i: F.struct(name(p).alias("name"), i.alias("at"), p.alias("pair"))))
    query = F.array_join(F.transform(placed, lambda x: x["pair"]), "&")
    whole = F.concat(F.lower(part(1)), F.lit("://"), host, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(part(1) != "", whole)


def normalize_url(url: Column) -> Column:
    """A public candidate address without tracking parameters; null if it is not public or names a secret."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    secret = F.exists(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1).rlike(SECRET_PARAMETERS))
    return F.when(public_url(url) & ~secret, candidate_url(url, TRACKING))


def domain(url: Column) -> Column:
    """Lower-cased host without ``www.``; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)), r"^www\.", "")


def public_url(url: Column) -> Column:
    """http(s) URL without credentials whose host is neither local nor a private address."""
    host = F.lower(F.regexp_extract(url, r"^(?i)https?://([^/?#]*)", 1))
    name = F.regexp_replace(host, r":\d+$", "")
    private = name.rlike(r"^(localhost|0\.|10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|198\.1[89]\.|22[4-9]\.|2[3-5]\d\.|\[(::1?|f[cd][0-9a-f]*:|fe[89ab][0-9a-f]:).*\]$)") | name.rlike(r"\.(local|internal|localhost)$")
    return F.coalesce((name != "") & ~host.contains("@") & ~private, F.lit(False))


# ---- hashes and ids --------------------------------------------------------------------------------------


def content_hash(text: Column, length: int = 64) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def poly_hash(text: Column) -> Column:
    """31-polynomial hash modulo 2**32 in base 36, six characters at most."""
    h = F.aggregate(F.split(text, ""), F.lit(0).cast("bigint"), lambda a, c: F.pmod(a * 31 + F.when(c == "", F.lit(0)).otherwise(F.ascii(c)), F.lit(4294967296)))
    return F.left(F.lower(F.conv(h.cast("string"), 10, 36)), F.lit(6))


STABLE_ID = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"


def edition_id(event_id: Column, year: Column) -> Column:
    """``event-year``; null unless the event id is kebab-case and the year has four digits."""
    return F.when(event_id.rlike(STABLE_ID) & year.between(1000, 9999), F.concat_ws("-", event_id, year.cast("string")))


def category_id(edition: Column, key: Column) -> Column:
    """``edition-key`` with the key brought to kebab-case; null without a letter in the key."""
    k = F.regexp_replace(F.lower(js_trim(key)), r"[\s_./\\:|‐‑‒–—−]+", "-")
    k = F.regexp_replace(F.regexp_replace(k, "-+", "-"), "^-+|-+$", "")
    return F.when(edition.rlike(STABLE_ID) & k.rlike(STABLE_ID) & k.rlike("[a-z]"), F.concat_ws("-", edition, k))


def secret_marker(text: Column) -> Column:
    """Mentions something that looks like a credential."""
    return F.lower(text).rlike(r"api[_-]?key|secret|password|authorization:|bearer |private key")


def context(text: Column, evidence: Column, around: int = 320) -> Column:
    """Text around the first occurrence of the evidence; null where it is not found."""
    at = F.instr(text, evidence)
    start = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, F.substring(text, start, at - start + F.length(evidence) + around))
