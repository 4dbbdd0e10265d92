"""Listings and blocks of pages: links of feeds, sitemaps and pages, list cards, details, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.normalize import connector_climb, connector_distance, cutoff_text, date_location
from .text import decode_entities, js_trim, strip_html
from .unicode import absolute_url

# fixed values: what entries, titles and links look like; marks of one registration platform's pages
FEED_ENTRY = r"(?is)<(?:item|entry|url)\b[^>]*>(.*?)</(?:item|entry|url)>"
TITLE, PLACE, LINK_HREF = r"(?is)<title[^>]*>(.*?)</title>", r"(?is)<(?:loc|link)[^>]*>(.*?)</(?:loc|link)>", r"""(?is)<link\b[^>]*href=["']([^"']+)["']"""
HIDDEN = r"(?is)<!--.*?-->|<(script|style|noscript)\b[^>]*>.*?</\1>"
PAGE_LINK = r"""(?is)<a\b[^>]*href\s*=\s*["']([^"']+)["'][^>]*>(.*?)</a>"""
FEED_LINK = r"""(?is)<link\b(?=[^>]*(?:rss|atom|sitemap))[^>]*href=["']([^"']+)["'][^>]*>"""
IMAGE_TEXT = r"""(?i)<img\b[^>]*alt=["']([^"']+)["'][^>]*>"""
CARD = r"""(?s)<div class="event" style="padding-bottom: 10px">(.*?)(?=<div class="event" style="padding-bottom: 10px">|<nav class="pagination-wrap">)"""
CARD_PARTS = {
    "event_id": r"zuicool\.com/event/(\d+)", "name": r'(?s)<h4 class="name">(.*?)</h4>', "info": r'(?s)<div class="info">(.*?)</div>', "description": r'(?s)<p style="font-size: 12px;[^>]*>(.*?)</p>', "status": r'(?s)class="status_bth[^>]*>(.*?)</a>',
    "deadline": r"报名截止：([^<]+)", "logo": r'<img src="([^"]+)" class="logo"',
}
PACKAGE, TABLE_ROW = r'(?s)<div class="pkg2">(.*?)(?=<div class="pkg2">|<div class="clearfix">)', r'(?s)<tr>\s*<td class="name">(.*?)</tr>'
HEADING, FEE, ROW_FEE, CATEGORY_LINK = r"(?s)<h[45][^>]*>(.*?)</h[45]>", r'<div class="price">\s*([\d.]+)', r'(?s)<td class="fee">.*?<p>\s*([\d.]+)', r"""(?i)href=["'](https://reg\.zuicool\.com/\d+/\d+)["']"""
META = r"""(?is)<meta[^>]+(?:name|property)=["'](?:{0})["'][^>]+content=["']([^"']*)["']"""
REGISTER_BUTTON, REGISTER_LINK = r"""(?i)href=["'](https://reg\.zuicool\.com/\d+)["'][^>]*>\s*点此报名\s*</a>""", r"""(?i)href=["'](https://reg\.zuicool\.com/\d+)["']"""
MOST_LINKS = 200


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The first match of a pattern; null where there is none."""
    m = F.regexp_extract(c, pattern, group)
    return F.when(m != "", m)


def shown(c: Column) -> Column:
    """Text of a piece of a page; null for an empty one."""
    text = strip_html(c)
    return F.when(text != "", text)


def listing_links(pages: DataFrame, id_col: str, body: str, base: str, kind: str, most: int = MOST_LINKS) -> DataFrame:
    """``id, rank, url, title, method`` of the links of listings: entries of feeds and sitemaps, else anchors of a page, then its feeds.

    A listing gives at most ``most`` entries or anchors, which is how a listing is defined here; links that can't be joined to
    their page are left out.
    """
    b = F.col(body)
    is_feed = F.coalesce(F.col(kind).rlike("(?i)xml"), F.lit(False)) | b.rlike(r"^\s*<\?xml")
    plain = F.regexp_replace(b, HIDDEN, " ")
    item = lambda href, title, method: F.struct(href.alias("href"), title.alias("title"), method.alias("method"))

    def entry(x: Column) -> Column:
        href = F.coalesce(found(x, PLACE), found(x, LINK_HREF))
        title = F.regexp_replace(F.coalesce(found(x, TITLE), F.url_decode(F.regexp_extract(href, r"^(?:[^/]*//[^/]*)?(/[^?#]*)", 1))), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
        return item(F.regexp_replace(href, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), title, F.when(F.contains(x, F.lit("<loc")), "sitemap").otherwise("rss"))

    entries = F.filter(F.transform(F.regexp_extract_all(b, F.lit(FEED_ENTRY), F.lit(1)), entry), lambda x: x["href"].isNotNull())
    anchors = F.zip_with(F.regexp_extract_all(plain, F.lit(PAGE_LINK), F.lit(1)), F.regexp_extract_all(plain, F.lit(PAGE_LINK), F.lit(2)), lambda h, t: item(h, F.regexp_replace(t, IMAGE_TEXT, "$1"), F.lit("html_link")))
    feeds = F.transform(F.regexp_extract_all(plain, F.lit(FEED_LINK), F.lit(1)), lambda h: item(h, F.lit("rss"), F.lit("html_link")))
    every = F.when(is_feed, F.slice(entries, 1, most)).otherwise(F.concat(F.slice(anchors, 1, most), feeds))
    rows = pages.select(id_col, F.col(base).alias("_base"), F.posexplode(every).alias("rank", "x"))
    out = rows.select(id_col, "rank", absolute_url(js_trim(decode_entities(F.col("x.href"))), F.col("_base")).alias("url"), js_trim(decode_entities(strip_html(F.col("x.title")))).alias("title"), F.col("x.method").alias("method"))
    return out.where(F.col("url").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"))


def list_cards(pages: DataFrame, body: str, base: str, site: str) -> DataFrame:
    """``event_id, detail_url, name, date_location, description, status_text, deadline, cover_image`` of list pages; the first card of each event."""
    part = lambda n: found(F.col("block"), CARD_PARTS[n])
    rows = pages.select(F.monotonically_increasing_id().alias("_page"), F.col(base).alias("_base"), F.posexplode(F.regexp_extract_all(F.col(body), F.lit(CARD), F.lit(1))).alias("_at", "block"))
    cards = rows.select(
        "_page", "_at", part("event_id").alias("event_id"), shown(part("name")).alias("name"), shown(part("info")).alias("date_location"), shown(part("description")).alias("description"), shown(part("status")).alias("status_text"), js_trim(part("deadline")).alias("deadline"),
        absolute_url(part("logo"), F.col("_base")).alias("cover_image"),
    )
    first = cards.where("event_id is not null").groupBy("event_id").agg(F.min_by(F.struct("name", "date_location", "description", "status_text", "deadline", "cover_image"), F.struct("_page", "_at")).alias("c"))
    return first.select("event_id", F.concat(F.lit(site), "event_id").alias("detail_url"), "c.*").where("name is not null")


def category_blocks(body: Column, pattern: str) -> Column:
    """Categories of the blocks of a page: ``array<struct<category_name, fee, registration_url, distance_km, elevation_gain, cutoff_time>>``; unnamed ones are left out."""

    def category(x: Column) -> Column:
        name, text = shown(found(x, HEADING)), shown(x)
        words = F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(text, F.lit("")))
        return F.struct(
            name.alias("category_name"), F.coalesce(found(x, FEE), found(x, ROW_FEE)).try_cast("double").alias("fee"), found(x, CATEGORY_LINK).alias("registration_url"), connector_distance(words, "zuicool").alias("distance_km"), connector_climb(text).alias("elevation_gain"), cutoff_text(text).alias("cutoff_time")
        )

    return F.filter(F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)), category), lambda c: c["category_name"].isNotNull())


def details(pages: DataFrame, key: str, body: str) -> DataFrame:
    """``key, title, description, cover_image, registration_url, categories`` of detail pages."""
    b = F.col(body)
    return pages.select(
        key, shown(found(b, TITLE)).alias("title"), shown(found(b, META.format("description|og:description"))).alias("page_description"), found(b, META.format("og:image")).alias("page_image"), F.coalesce(found(b, REGISTER_BUTTON), found(b, REGISTER_LINK)).alias("registration_url"), category_blocks(b, PACKAGE).alias("categories")
    )


def connector_rows(cards: DataFrame, detail: DataFrame, registration: DataFrame) -> DataFrame:
    """Cards with their detail and registration pages, both optional: one row an event.

    detail: see :func:`details`, by ``event_id``. registration: ``event_id, registration_categories``. A category of both keeps the detail's
    values and takes the missing ones from the registration page; categories of one of them stand by themselves.
    """
    j = cards.join(detail, "event_id", "left").join(registration, "event_id", "left")
    none = F.array().cast(detail.schema["categories"].dataType)
    a, b = F.coalesce("categories", none), F.coalesce("registration_categories", none)
    names = ("fee", "registration_url", "distance_km", "elevation_gain", "cutoff_time")
    twin = lambda x, other: F.get(F.filter(other, lambda y: y["category_name"] == x["category_name"]), F.lit(0))
    merged = F.transform(a, lambda x: F.struct(x["category_name"].alias("category_name"), *[F.coalesce(x[n], twin(x, b)[n]).alias(n) for n in names]))
    rest = F.filter(b, lambda y: ~F.exists(a, lambda x: x["category_name"] == y["category_name"]))
    date, province, city, district, venue = date_location(F.col("date_location"))
    quality = F.when(F.col("title").isNotNull() | F.col("categories").isNotNull(), "medium").otherwise("low")
    return j.select(
        "event_id", F.coalesce("title", "name").alias("name"), date.alias("race_date"), province.alias("province"), city.alias("city"), district.alias("district"), venue.alias("venue"), "description", "status_text", "deadline", "detail_url", "registration_url",
        F.coalesce("page_image", "cover_image").alias("cover_image"), F.concat(merged, rest).alias("categories"), quality.alias("data_quality"),
    )
