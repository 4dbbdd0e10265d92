"""Shown texts: numbers, dates, start times, distances, fees, places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import strict_date
from .text import js_trim

# fixed values: words that stand in for what is not known, and week days from Sunday on
WEEKDAYS = ("周日", "周一", "周二", "周三", "周四", "周五", "周六")
DATE_PENDING, DISTANCE_PENDING, ELEVATION_PENDING, PRICE_PENDING = "日期待公布", "距离待更新", "爬升待更新", "报名信息待更新"
ADMINISTRATIVE = r"(?:特别行政区|壮族自治区|回族自治区|维吾尔自治区|自治区|省|市|地区|自治州|州|区|县)$"
PLACE_GAP = " · "


def number_text(c: Column) -> Column:
    """A number without a needless fraction."""
    d = c.cast("double")
    return F.when(d == F.floor(d), F.floor(d).cast("bigint").cast("string")).otherwise(d.cast("string"))


def grouped_number(c: Column) -> Column:
    """Thousands separated by commas; the fraction stays as it is."""
    text = number_text(c)
    whole = F.regexp_replace(F.split_part(text, F.lit("."), F.lit(1)), r"\B(?=(\d{3})+(?!\d))", ",")
    fraction = F.split_part(text, F.lit("."), F.lit(2))
    return F.when(fraction == "", whole).when(fraction != "", F.concat_ws(".", whole, fraction))


def kilometres(c: Column) -> Column:
    """``21.1KM``, ``100KM``: whole numbers plain, others with one decimal."""
    d = c.cast("double")
    return F.concat(F.when(d == F.floor(d), number_text(d)).otherwise(F.format_string("%.1f", d)), F.lit("KM"))


def known(values: Column) -> Column:
    """Numbers of an array that are neither null nor 0."""
    return F.filter(values, lambda x: F.coalesce(x != 0, F.lit(False)))


def joined_or(values: Column, show, otherwise: str) -> Column:
    """Distinct known numbers, shown and joined; a stand-in where there are none."""
    kept = F.array_distinct(known(values))
    return F.when(F.size(kept) > 0, F.array_join(F.transform(kept, show), " / ")).otherwise(otherwise)


def distances_text(values: Column) -> Column:
    return joined_or(values, kilometres, DISTANCE_PENDING)


def elevations_text(values: Column) -> Column:
    return joined_or(values, lambda x: F.concat(number_text(x), F.lit("m")), ELEVATION_PENDING)


def price_text(fees: Column) -> Column:
    """One fee or the range of fees."""
    low, high = F.array_min(known(fees)), F.array_max(known(fees))
    money = lambda x: F.concat(F.lit("¥"), number_text(x))
    return F.when(low.isNull(), PRICE_PENDING).when(low == high, money(low)).otherwise(F.concat_ws(" - ", money(low), money(high)))


def fee_lines(fees: Column) -> tuple[Column, Column]:
    """``(main, sub)`` line: the lowest fee and the number of categories, or what is known of them. One entry a category."""
    low, n = F.array_min(known(fees)), F.size(fees)
    count = F.when(n > 0, F.concat(n.cast("string"), F.lit(" 个组别"))).otherwise("")
    main = F.when(low.isNotNull(), F.concat(F.lit("¥"), number_text(low), F.lit(" 起"))).when(n > 0, count).otherwise(PRICE_PENDING)
    return main, F.when(low.isNotNull(), count).otherwise("")


def date_range_text(start: Column, end: Column) -> Column:
    """``5月3日``, ``5月3–4日``, ``5月30日–6月1日``, with years where they differ; dates are checked for their form only."""
    part = lambda c, k: F.regexp_extract(c, r"^(\d{4})-(\d{2})-(\d{2})$", k)
    formed = lambda c: part(c, 1) != ""
    y, m, d = ([part(c, k).cast("int").cast("string") for c in (start, end)] for k in (1, 2, 3))
    day = lambda k: F.concat(m[k], F.lit("月"), d[k], F.lit("日"))
    full = lambda k: F.concat(y[k], F.lit("年"), day(k))
    has_end = F.coalesce(end != "", F.lit(False))
    return (
        F.when(F.coalesce(start, F.lit("")) == "", DATE_PENDING)
        .when(~formed(start) | (has_end & ~formed(end)), start)
        .when(~has_end | (start == end), day(0))
        .when((y[0] == y[1]) & (m[0] == m[1]), F.concat(m[0], F.lit("月"), d[0], F.lit("–"), d[1], F.lit("日")))
        .when(y[0] == y[1], F.concat_ws("–", day(0), day(1)))
        .otherwise(F.concat_ws("–", full(0), full(1)))
    )


def weekday_date_text(date: Column) -> Column:
    """``2026.05.03 周日``; null for null and for what is no date."""
    day = strict_date(date)
    return F.concat_ws(" ", F.date_format(day, "yyyy.MM.dd"), F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.dayofweek(day)))


def card_date_text(date: Column, year: Column) -> Column:
    """Date with its week day, else the year, else a stand-in; a date that can't be read stays as it is."""
    by_year = F.when(year != 0, F.concat(year.cast("string"), F.lit("年，日期待更新"))).otherwise("比赛日期待更新")
    return F.when(F.coalesce(date, F.lit("")) == "", by_year).when(strict_date(date).isNull(), date).otherwise(weekday_date_text(date))


def list_date_text(start: Column, end: Column) -> Column:
    """``2026.05.03 周日``, or ``2026.05.03–05.04`` for several days; the end counts only if it is a later date."""
    a, b = strict_date(start), strict_date(end)
    last = F.when(F.year(a) == F.year(b), F.date_format(b, "MM.dd")).otherwise(F.date_format(b, "yyyy.MM.dd"))
    return F.when(a.isNull(), DATE_PENDING).when(b > a, F.concat_ws("–", F.date_format(a, "yyyy.MM.dd"), last)).otherwise(weekday_date_text(start))


_STAMP = r"^(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2})"


def _stamp(c: Column) -> tuple[Column, Column]:
    part = lambda k: F.regexp_extract(c, _STAMP, k)
    return F.when(part(1) != "", F.concat_ws(".", part(1), part(2), part(3))), F.when(part(1) != "", F.concat_ws(":", part(4), part(5)))


def start_text(value: Column) -> Column:
    """``2026.05.03 07:30``, the date alone, or the value as it is."""
    day, time = _stamp(value)
    return F.coalesce(F.when(day.isNotNull(), F.concat_ws(" ", day, time)), F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.replace(value, F.lit("-"), F.lit("."))), value)


def start_times_text(values: Column) -> Column:
    """Several starts: the date once if it is one for all, every date otherwise, the values as they are if any can't be read."""
    days, times = F.transform(values, lambda v: _stamp(v)[0]), F.transform(values, lambda v: _stamp(v)[1])
    whole = F.transform(values, lambda v: F.concat_ws(" ", *_stamp(v)))
    one_day = F.concat_ws(" ", F.get(days, F.lit(0)), F.array_join(times, " / "))
    shown = F.when(F.exists(days, lambda x: x.isNull()), F.array_join(values, " / ")).when(F.size(F.array_distinct(days)) == 1, one_day).otherwise(F.array_join(whole, " / "))
    return F.concat(shown, F.lit(" 分枪"))


def administrative_name(c: Column) -> Column:
    """A place without the kind of its administration."""
    return F.regexp_replace(js_trim(c), ADMINISTRATIVE, "")


def _without_lead(value: Column, parts: Column) -> Column:
    """The value without any of the parts at its beginning, however many follow each other, longest first."""
    longest_first = F.transform(F.array_sort(F.transform(parts, lambda p, i: F.struct((-F.length(p)).alias("n"), i.alias("i"), p.alias("p")))), lambda x: x["p"])

    def strip(text: Column, _: Column) -> Column:
        return F.aggregate(longest_first, text, lambda t, p: F.when(t.startswith(p), F.regexp_replace(js_trim(F.substr(t, F.length(p) + 1)), r"^[·,，、/\s-]+", "")).otherwise(t))

    # a round takes off a part at least, or all further rounds change nothing: as many rounds as the value has characters do
    rounds = F.sequence(F.lit(0), F.length(value))
    return F.aggregate(rounds, js_trim(value), strip)


def location_text(country: Column, province: Column, city: Column, district: Column, venue: Column) -> Column:
    """``Province · City · District · Venue``: no place twice, the venue without places that lead it; else the country."""
    full = lambda c: F.when(js_trim(c) != "", c)
    places = F.array_compact(F.array(full(province), full(city), full(district)))
    held = lambda list_, x: F.exists(list_, lambda y: administrative_name(y) == administrative_name(x))
    empty = F.array().cast("array<string>")
    segments = F.aggregate(places, empty, lambda a, x: F.when(held(a, x), a).otherwise(F.concat(a, F.array(x))))
    inner = _without_lead(venue, F.array_compact(F.concat(F.array(full(country)), segments)))
    venue_shown = F.when((js_trim(venue) != "") & (inner != "") & ~held(segments, inner), inner)
    everything = F.array_compact(F.concat(segments, F.array(venue_shown)))
    return F.when(F.size(everything) > 0, F.array_join(everything, PLACE_GAP)).otherwise(F.coalesce(full(country), F.lit("")))


def place_line(*parts: Column) -> Column:
    """Non-empty places joined; null where there are none."""
    line = F.array_join(F.array_compact(F.array(*[F.when(p != "", p) for p in parts])), PLACE_GAP)
    return F.when(line != "", line)


def call_to_action(registration_url: Column, official_url: Column) -> Column:
    """``struct<label, href, disabled>``: registration, else the official page, else nothing to follow (fixed labels)."""
    answer = lambda label, href, off: F.struct(F.lit(label).alias("label"), href.alias("href"), F.lit(off).alias("disabled"))
    return (
        F.when(registration_url != "", answer("去报名", registration_url, False))
        .when(official_url != "", answer("查看官网", official_url, False))
        .otherwise(answer("信息待更新", F.lit(None).cast("string"), True))
    )


def core_tags(tags: Column, repeated: list[str], priority: list[str], first: Column, last: Column) -> Column:
    """Tags without the repeated ones, priority ones before others, four of them; a leading and a final one added, five in all.

    ``first`` and ``last`` are null or a label, which is not added twice.
    """
    base = F.filter(tags, lambda x: ~x.isin(*repeated) if repeated else F.lit(True))
    picked = F.slice(F.concat(F.filter(base, lambda x: x.isin(*priority)), F.filter(base, lambda x: ~x.isin(*priority))), 1, 4)
    new = lambda label, held: F.when(label.isNotNull() & ~F.coalesce(F.array_contains(held, label), F.lit(False)), label)
    led = F.array_compact(F.concat(F.array(new(first, picked)), picked))
    return F.slice(F.array_compact(F.concat(led, F.array(new(last, led)))), 1, 5)
