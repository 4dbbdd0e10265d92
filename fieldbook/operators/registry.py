"""Source registry: which sources may speak for an edition, how a candidate fact finds its source, who ranks first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import domain, public_url
from .catalog import has_text

# fixed values: kinds of sources, and what each tier of them may be used for
CONTEXT_ONLY = ("government_context", "media_report", "previous_edition_media", "previous_edition_report", "specialist_media")
OFFICIAL_DOCUMENTS = ("event_home", "notice", "regulations", "registration_notice", "registration_platform", "category_page", "official_calendar")
TRUSTED_DOCUMENTS = ("calendar", "certification_platform", "event_directory", "registration_platform")
DELEGATING = ("event_home", "notice", "regulations", "registration_notice")
#: (tier, source types, mode, may be applied automatically, reason); the first that fits decides
ELIGIBILITY = (
    ("primary_official", OFFICIAL_DOCUMENTS, "official_document", True, "Active edition-scoped primary official document source."),
    ("trusted_structured", ("structured_connector",), "structured_connector", False, "Active edition-scoped trusted connector is eligible for extraction and cross-check only."),
    ("trusted_structured", TRUSTED_DOCUMENTS, "trusted_document", False, "Trusted source is eligible for extraction and cross-check but is not field-authoritative by tier alone."),
    ("trusted_secondary", ("official_partner_announcement",), "trusted_document", False, "Official partner announcement is extractable but cannot auto-apply facts."),
)
AUTHORITY = ("primary_official", "trusted_structured")
MARKER = "::announcement:"
#: reasons of a failed crawl in its messages; the second tables reads the notes of the run too
FAILURES = (
    (r"(?i)HTTP|fetch failed|abort|timeout", "HTTP 访问失败", False), (r"(?i)EdgeOne|access restricted|403|429|反爬|blocked", "反爬限制", False), (r"(?i)JS|render", "页面需要 JS 渲染", True),
    (r"(?i)结构|structure|入口|列表页", "页面结构变化", True), (r"(?i)列表页|入口", "找不到稳定列表页", True), (r"(?i)首屏 HTML|HTML", "字段不在首屏 HTML", True), (r"(?i)login|登录", "需要登录", False),
)
NO_REASON = "数据源本身不适合 POC"
PILOT_SCORE, NO_PILOT = 65, r"线上|亲子|青少年|培训|荧光|徒步"


def eligibility(registry_edition: Column, target_edition: Column, status: Column, tier: Column, kind: Column) -> Column:
    """``struct<eligible, auto_apply, mode, reason>`` of a source for an edition."""
    verdict = lambda ok, auto, mode, reason: F.struct(F.lit(ok).alias("eligible"), F.lit(auto).alias("auto_apply"), F.lit(mode).cast("string").alias("mode"), reason.alias("reason"))
    no = lambda reason: verdict(False, False, None, reason)
    out = no(F.concat(F.lit("The "), F.coalesce(tier, F.lit("null")), F.lit("/"), F.coalesce(kind, F.lit("null")), F.lit(" combination is not freshness eligible.")))
    for t, kinds, mode, auto, reason in reversed(ELIGIBILITY):
        out = F.when((tier == t) & kind.isin(*kinds), verdict(True, auto, mode, F.lit(reason))).otherwise(out)
    return (
        F.when(~registry_edition.eqNullSafe(target_edition), no(F.lit("Source registry edition identity does not match the target edition.")))
        .when(~status.eqNullSafe(F.lit("active")), no(F.lit("Only active sources are freshness eligible.")))
        .when(kind.isin(*CONTEXT_ONLY), no(F.concat(kind, F.lit(" is context-only and excluded from automatic fact extraction."))))
        .otherwise(out)
    )


def active_sources(registry: DataFrame, edition_id: str | None = None) -> DataFrame:
    """Eligible sources of an edition (of each, without one). Registry: ``edition_id, source_id, url, tier, source_type, status, is_primary``."""
    rows = registry if edition_id is None else registry.where(F.col("edition_id") == edition_id)
    target = F.col("edition_id") if edition_id is None else F.lit(edition_id)
    return rows.withColumn("eligibility", eligibility(F.col("edition_id"), target, F.col("status"), F.col("tier"), F.col("source_type"))).where("eligibility.eligible")


def announcement_id(parent: Column, url: Column) -> Column:
    """Id of a document of an official site, under the source that stands for the site."""
    return F.concat(parent, F.lit(MARKER), F.substring(F.sha2(url, 256), 1, 24))


def with_source(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """Candidates (``edition_id, source_id, source_url``) with their registered source.

    A source that is not registered may be a document of a registered official site: its id names that site and the hash of its
    address, the address is public, of the same https origin, not a government host, of no other event, no interface or account
    page and without secrets, and not registered itself as anything but an active official source. Adds ``tier, source_type,
    is_primary, delegated_by``; null where there is no source.
    """
    reg = registry.select("edition_id", "source_id", "url", "tier", "source_type", "is_primary", "status")
    direct = candidates.join(reg.withColumnRenamed("url", "_url"), ["edition_id", "source_id"], "left")
    found = direct.where("status is not null").withColumn("delegated_by", F.lit(None).cast("string"))
    rest = direct.where("status is null").select(*candidates.columns)
    parent = F.when(F.contains("source_id", F.lit(MARKER)), F.regexp_extract("source_id", f"^(.*){MARKER}", 1))
    site = reg.select("edition_id", F.col("source_id").alias("_parent"), F.col("url").alias("_entry"), *[F.col(x).alias(f"_{x}") for x in ("tier", "source_type", "status")])
    event = lambda c: F.regexp_replace(c, r"-\d{4}$", "")
    hosts = reg.select(domain(F.col("url")).alias("_host"), event(F.col("edition_id")).alias("_event")).groupBy("_host").agg(F.min("_event").alias("_one"), F.max("_event").alias("_other"))
    barred = reg.where("status <> 'active' or tier <> 'primary_official'").select("edition_id", F.col("url").alias("source_url"), F.lit(True).alias("_barred")).distinct()
    url = F.col("source_url")
    origin = lambda c: F.lower(F.regexp_extract(c, r"^(https://[^/?#]+)", 1))
    path, names = F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1), F.transform(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: F.substring_index(p, "=", 1))
    mine = event(F.col("edition_id"))
    ok = (
        (F.col("_status") == "active") & (F.col("_tier") == "primary_official") & F.col("_source_type").isin(*DELEGATING) & public_url(url) & public_url(F.col("_entry"))
        & (origin(url) != "") & (origin(url) == origin(F.col("_entry"))) & ~url.contains("#") & ~F.regexp_extract(url, r"^[^:]+://([^/?#:]*)", 1).rlike(r"(?i)(?:^|\.)gov\.[a-z.]+$")
        & (F.col("_one").isNull() | ((F.col("_one") == mine) & (F.col("_other") == mine))) & ~path.rlike(r"(?i)/app-api/|/api/|/(?:login|logout|admin|manage|account)(?![0-9A-Za-z_])")
        & ~F.exists(names, lambda n: n.rlike(r"(?i)token|password|secret|api.?key")) & F.col("_barred").isNull() & (F.col("source_id") == announcement_id(F.col("_parent"), url))
    )
    j = rest.withColumn("_parent", parent).join(site, ["edition_id", "_parent"], "left").withColumn("_host", domain(url)).join(hosts, "_host", "left").join(barred, ["edition_id", "source_url"], "left")
    good = F.coalesce(ok, F.lit(False))
    derived = j.select(
        *candidates.columns, F.when(good, F.col("_tier")).alias("tier"), F.when(good, F.lit("notice")).alias("source_type"), F.when(good, F.lit(False)).alias("is_primary"), F.when(good, F.col("_parent")).alias("delegated_by")
    )
    return found.select(*derived.columns).unionByName(derived)


def entry_sources(registry: DataFrame, per_edition: int = 2) -> DataFrame:
    """The first sources of each edition to read: primary ones, then home pages, then by id."""
    rows = registry.where((F.col("status") == "active") & (F.col("tier") == "primary_official") & F.col("source_type").isin(*DELEGATING))
    w = Window.partitionBy("edition_id").orderBy(F.desc("is_primary"), (F.col("source_type") == "event_home").desc(), "source_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_edition)


def authority_rank(is_primary: Column, tier: Column) -> Column:
    """0 for the primary source, then official, structured, others."""
    ranked = F.coalesce(*[F.when(tier == t, F.lit(k + 1)) for k, t in enumerate(AUTHORITY)], F.lit(len(AUTHORITY) + 1))
    return F.when(F.coalesce(is_primary, F.lit(False)), F.lit(0)).otherwise(ranked)


def most_authoritative(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each group: that of the highest authority, by source id among equals."""
    first = F.min_by(F.struct("*"), F.struct(authority_rank(F.col("is_primary"), F.col("tier")), "source_id"))
    return rows.groupBy(*keys).agg(first.alias("_row")).select("_row.*")


def fetch_budget(requests: DataFrame, keys: list[str], order: list[str], most: int = 10) -> DataFrame:
    """Adds ``fetch``: the first ``most`` requests of each group now, the rest deferred."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return requests.withColumn("fetch", F.when(F.row_number().over(w) <= most, "now").otherwise("deferred"))


def field_verification(fields: DataFrame, reports: DataFrame, candidates: DataFrame) -> DataFrame:
    """``status`` of every critical field: UNKNOWN, NOT_VERIFIED_THIS_RUN, VERIFIED_THIS_RUN or VERIFIED_INHERITED, and its sources.

    fields: ``edition_id, category_id, field, value`` (JSON text; null: none). reports: ``edition_id, source_id, tier, identity_matched, extraction, request``
    of registered official sources. candidates: ``edition_id, source_id, category_id, field, value, authoritative, direct``.
    """
    usable = reports.where("tier = 'primary_official' and identity_matched").withColumns(
        {"_fresh": F.col("extraction") == "success", "_usable": (F.col("extraction") == "success") & (F.col("request") == "success") | (F.col("extraction") == "unchanged") & F.col("request").isin("success", "skipped")}
    )
    said = candidates.join(usable.select("edition_id", "source_id", "_fresh", "_usable"), ["edition_id", "source_id"])
    said = said.select("edition_id", F.coalesce("category_id", F.lit("")).alias("_c"), "field", F.col("value").alias("_v"), "source_id", "authoritative", "direct", "_fresh", "_usable")
    j = fields.withColumn("_c", F.coalesce("category_id", F.lit(""))).join(said, ["edition_id", "_c", "field"], "left")
    agrees = F.coalesce(F.col("direct") & F.col("_usable") & (F.col("_v") == F.col("value")), F.lit(False))
    contrary = F.coalesce(F.col("authoritative") & F.col("_fresh") & ~F.col("_v").eqNullSafe(F.col("value")), F.lit(False))
    g = j.groupBy("edition_id", "category_id", "field", "value").agg(
        F.max(contrary).alias("_contrary"), F.max(agrees & F.col("_fresh")).alias("_now"), F.max(agrees).alias("_ever"), F.sort_array(F.collect_set(F.when(agrees, F.col("source_id")))).alias("sources")
    )
    present = has_text("value") & ~F.col("value").isin("unknown", '"unknown"', "[]", '""', "null")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = F.when(~present, "UNKNOWN").when(yes("_contrary"), "NOT_VERIFIED_THIS_RUN").when(yes("_now"), "VERIFIED_THIS_RUN").when(yes("_ever"), "VERIFIED_INHERITED").otherwise("NOT_VERIFIED_THIS_RUN")
    return g.select("edition_id", "category_id", "field", present.alias("present"), status.alias("status"), "sources")


def failure_categories(failures: Column, notes: Column, n_found: Column) -> Column:
    """Kinds of failure in ``array<struct<url, reason>>``, each once, in the order in which they are first met."""
    tail = F.concat(F.lit(" "), F.array_join(notes, " "))

    def of_one(x: Column) -> Column:
        text = F.concat_ws(" ", x["url"], x["reason"])
        return F.array_compact(F.array(*[F.when((F.concat(text, tail) if wide else text).rlike(p), F.lit(name)) for p, name, wide in FAILURES]))

    found = F.array_distinct(F.flatten(F.transform(failures, of_one)))
    return F.when((F.size(found) == 0) & (n_found == 0), F.array(F.lit(NO_REASON))).otherwise(found)


def pilot_eligible(score: Column, name: Column, next_stage: Column) -> Column:
    """A candidate that a pilot may take up."""
    return F.coalesce((score >= PILOT_SCORE) & ~name.rlike(NO_PILOT) & next_stage, F.lit(False))


def by_status(pending: DataFrame, status: str = "all") -> DataFrame:
    return pending if status == "all" else pending.where(F.col("status") == status)


def group_members(groups: DataFrame, races: DataFrame, ids: str = "race_ids", key: str = "id") -> DataFrame:
    """Members of each group in the order of its list; ids without a race are dropped."""
    listed = groups.select("*", F.posexplode(ids).alias("member_rank", "_id"))
    return listed.join(races, F.col("_id") == F.col(key)).drop("_id", ids)


def enriched(races: DataFrame, enrichment: DataFrame, key: str) -> DataFrame:
    """Races with their enrichment, nulls where there is none; enrichment has one row a race."""
    return races.join(enrichment, key, "left")
