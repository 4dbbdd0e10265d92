"""Source candidates of official listings, category documents in JSON, and the comparison of their fields with what is known."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import candidate_url, domain
from ..functions.unicode import edition_year_class
from .catalog import has_text

LISTING = "array<struct<id: string, title: string, tag: string, url: string>>"
GROUP = "code int, data struct<id: bigint, name: string, distance: double, elevationGain: double, startPoint: string, endPoint: string, buttons: array<struct<linkUrl: string>>>"
# fixed values: fields of a category document and where they stand in it
DOCUMENT_FIELDS = (("distanceKm", "distance"), ("elevationGain", "elevationGain"), ("startLocation", "startPoint"), ("finishLocation", "endPoint"))


def cms_candidates(listings: DataFrame, edition_id: str, year: int, names: str, home: str, other_event: str | None = None) -> DataFrame:
    """Candidates of an official CMS: ``candidate_id, normalized_url, title, event_status, edition_status, authority, response_hash``.

    listings: ``body`` (JSON array of records with id, title, tag, url). Records of another year, of another event (``other_event``, a
    pattern) or without a title, id or address are left out; the first of several with one address stands, by its place in the listing.
    ``names`` is a pattern of the event's names. Nothing here approves a source or verifies a fact.
    """
    rows = listings.select(F.sha2("body", 256).alias("response_hash"), F.posexplode(F.from_json("body", LISTING)).alias("at", "r")).select("response_hash", "at", "r.*")
    year_class = edition_year_class(F.col("title"), F.col("tag"), year)
    kept = rows.where((F.col("tag") == str(year)) & F.col("title").isNotNull() & has_text("id")).withColumns({"normalized_url": candidate_url(F.col("url")), "edition_status": year_class})
    kept = kept.where("normalized_url is not null and edition_status <> 'year_conflict'")
    kept = kept.where(~F.col("title").rlike(other_event)) if other_event else kept
    first = kept.groupBy("normalized_url").agg(F.min_by(F.struct("title", "id", "edition_status", "response_hash"), F.struct("at", "response_hash")).alias("r")).select("normalized_url", "r.*")
    return first.select(
        F.concat(F.lit("sc-"), F.substring(F.sha2(F.concat(F.lit(edition_id + "\n"), "normalized_url"), 256), 1, 20)).alias("candidate_id"), "normalized_url", "title", F.col("id").alias("article_id"),
        F.when(F.col("title").rlike(names), "title_match").otherwise("needs_review").alias("event_status"), "edition_status",
        F.when(domain(F.col("normalized_url")) == F.lit(home), "official_site_unapproved").otherwise("external_link_unverified").alias("authority"), "response_hash",
    )


def category_documents(raw: DataFrame, approved: dict[int, str]) -> DataFrame:
    """Category documents (``url, body``) of an approved interface, or why they are not taken: ``error`` envelope, identity, facts or track_link.

    The address names the id (``?id=``), the document must have that id and the approved name, a positive distance, a climb that is not
    negative, and a link to a public GPX track.
    """
    d, wanted = F.col("d.data"), F.regexp_extract("url", r"[?&]id=(\d+)(?:&|$)", 1).try_cast("bigint")
    name = F.element_at(F.create_map(*[x for k, v in approved.items() for x in (F.lit(k).cast("bigint"), F.lit(v))]), wanted)
    track = F.get(F.filter(F.transform(d["buttons"], lambda b: b["linkUrl"]), lambda u: F.coalesce(u.rlike(r"^https://[^?#]*\.gpx(?:[?#]|$)"), F.lit(False))), F.lit(0))
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    error = (
        F.when(bad((F.col("d.code") == 0) & d.isNotNull()), "envelope").when(bad((d["id"] == wanted) & (d["name"] == name)), "identity")
        .when(bad((d["distance"] > 0) & (d["distance"] < float("inf")) & (d["elevationGain"] >= 0) & d["buttons"].isNotNull()), "facts").when(track.isNull(), "track_link")
    )
    parsed = raw.withColumn("d", F.from_json("body", GROUP)).withColumns({"error": error, "track": track})
    ok = F.col("error").isNull()
    return parsed.select("url", "error", *[F.when(ok, d[n]).alias(a) for a, n in (("id", "id"), ("name", "name"), *DOCUMENT_FIELDS)], F.when(ok, F.col("track")).alias("track_url"))


def field_matrix(known: DataFrame, found: DataFrame, fields: Sequence[str] = tuple(f for f, _ in DOCUMENT_FIELDS)) -> DataFrame:
    """One row for each category and field: the known value, the found one, and what to do.

    known: ``category_id, group, conflicts map<field, array of other sources' values>`` and the fields as text. found: ``group, identity`` and the
    fields as text. Actions: FETCH_OR_EXTRACTION_BLOCKED (no document), VERIFICATION_ALERT (of another edition), SOURCE_DISCOVERY_REQUIRED (no
    value), ACTUAL_COURSE_DISTANCE_ONLY, CONFLICT_NEEDS_REVIEW, NO_CHANGE_VERIFIED, FACT_CANDIDATE.
    """
    long = lambda df, keys, out: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(out)) for f in fields])).alias("x")).select(*keys, "x.*")
    a = long(known, ["category_id", "group", "conflicts"], "current_value")
    b = long(found, ["group", "identity"], "candidate_value")
    j = a.join(b, ["group", "field"], "left")
    v, now = F.col("candidate_value"), F.col("current_value")
    other = (F.col("field") != "distanceKm") & v.isNotNull() & F.coalesce(F.exists(F.element_at("conflicts", F.col("field")), lambda x: x != v), F.lit(False))
    action = (
        F.when(F.col("identity").isNull(), "FETCH_OR_EXTRACTION_BLOCKED").when(F.col("identity") != "linked_asset", "VERIFICATION_ALERT").when(v.isNull(), "SOURCE_DISCOVERY_REQUIRED")
        .when(F.col("field") == "distanceKm", "ACTUAL_COURSE_DISTANCE_ONLY").when(other, "CONFLICT_NEEDS_REVIEW").when(v.eqNullSafe(now), "NO_CHANGE_VERIFIED").otherwise("FACT_CANDIDATE")
    )
    return j.select("category_id", "field", "current_value", now.isNull().alias("missing"), "candidate_value", other.alias("third_party_conflict"), action.alias("action"))


def share_image(*images: Column) -> Column:
    """The picture to share: the cut next to a race's own picture, else the first PNG or JPEG; null without any."""
    own = r"(?i)^((?:https?://[^/?#]+)?/races/[^/?#]+/\d{4}/)[^/?#]+(?:[?#].*)?$"
    one = lambda c: F.when(c.rlike(own), F.concat(F.regexp_extract(c, own, 1), F.lit("share-cover-5x4.jpg"))).when(c.rlike(r"(?i)\.(?:png|jpe?g)(?:[?#].*)?$"), c)
    return F.coalesce(*map(one, images))


def share_card(name: Column, edition_id: Column, *images: Column) -> Column:
    """``struct<title, path, query, image_url>`` of a shared race."""
    query = F.concat(F.lit("editionId="), F.regexp_replace(F.url_encode(edition_id), r"\+", "%20"), F.lit("&source=share"))
    return F.struct(F.concat(name, F.lit("｜下一场参赛指南")).alias("title"), F.concat(F.lit("/pages/races/detail/index?"), query).alias("path"), query.alias("query"), share_image(*images).alias("image_url"))


# fixed values: kinds of places to stay: (id, kind, name, label, reason, advantage)
STAY_AREAS = (
    ("near-event", "distance", "住在比赛附近", "距离优先", "适合希望减少比赛日通勤不确定性的跑者。", "离比赛区域近，检录和存包更从容。"),
    ("transport", "transportation", "住交通方便的位置", "交通优先", "适合兼顾高铁、机场和市内公共交通的跑者。", "到达和离开更顺，换乘成本更低。"),
    ("value", "balance", "平衡距离与成本", "综合优先", "适合在便利性和住宿成本之间取得平衡的跑者。", "兼顾距离、交通和价格，整体参赛成本更可控。"),
)
STAY_LABELS = {kind: label for _, kind, _, label, _, _ in STAY_AREAS}
PROVIDERS = ("ctrip",)


def stay_link(event_id: Column, kind: Column, provider: str) -> Column:
    """Tracked address of a place to stay."""
    return F.concat(F.lit("/go/accommodation?eventId="), F.url_encode(event_id), F.lit("&areaType="), kind, F.lit(f"&provider={provider}&source=event_page_accommodation"))


def stay_areas(pages: DataFrame) -> DataFrame:
    """``id, areas`` of decision pages: the curated areas, else three general ones where any place is known, else none.

    pages: ``id, event_id, venue, city, district, province, areas array<struct<kind, name, url, reason, advantage>>``.
    """
    area = lambda i, kind, name, label, why, plus, link: F.struct(i.alias("id"), kind.alias("kind"), name.alias("name"), label.alias("label"), why.alias("reason"), plus.alias("advantage"), link.alias("link"))
    label = lambda kind: F.element_at(F.create_map(*[F.lit(x) for kv in STAY_LABELS.items() for x in kv]), kind)
    curated = F.transform("areas", lambda x, i: area(F.concat_ws("-", x["kind"], i.cast("string")), x["kind"], x["name"], label(x["kind"]), x["reason"], x["advantage"], stay_link(F.col("event_id"), x["kind"], PROVIDERS[0])))
    general = F.array(*[area(F.lit(i), F.lit(k), F.lit(n), F.lit(lb), F.lit(w), F.lit(p), stay_link(F.col("id"), F.lit(k), "placeholder")) for i, k, n, lb, w, p in STAY_AREAS])
    anywhere = F.coalesce("venue", "city", "district", "province").isNotNull()
    return pages.select("id", F.when(F.size("areas") > 0, curated).when(anywhere, general).otherwise(F.slice(general, 1, 0)).alias("areas"))


def stay_redirects(requests: DataFrame, areas: DataFrame, fallback: str = "/races") -> DataFrame:
    """Adds ``target`` to requests (``event_id, kind, provider``): the listed address of a known kind and provider, else the fallback.

    areas: ``event_id, kind, url``; the first by ``ord`` if several are listed.
    """
    listed = areas.groupBy("event_id", "kind").agg(F.min_by("url", "ord").alias("_url"))
    ok = F.col("kind").isin(*STAY_LABELS) & F.col("provider").isin(*PROVIDERS)
    return requests.join(listed, ["event_id", "kind"], "left").withColumn("target", F.when(ok & F.col("_url").isNotNull(), F.col("_url")).otherwise(fallback)).drop("_url")
