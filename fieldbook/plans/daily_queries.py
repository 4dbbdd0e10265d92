"""Registered queries of the daily check: evidence and alerts, extraction, inheritance, identity, apply, releases, summaries.

Inputs come from the columns of the given tables: an order is an edition, its lines are sources with reports and candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import alerts, apply, candidates, daily, extractors, history, identity, merge, monitor, release
from .queries import query, t

AS_OF = "1997-06-17T12:00:00Z"


def day(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def edition_records(spark: SparkSession, sf: str) -> DataFrame:
    """An order as an edition."""
    after = lambda n: day(F.date_add(F.to_date("o_orderdate"), n.cast("int")))
    status = F.element_at(F.array(*map(F.lit, ("registration_open", "lottery", "unknown", "registration_closed", "upcoming"))), F.substring("o_orderpriority", 1, 1).cast("int"))
    return t(spark, sf, "orders").select(
        F.concat(F.lit("e"), "o_custkey").alias("event_id"), F.concat(F.lit("o"), "o_orderkey").alias("edition_id"), F.when(F.col("o_custkey") % 5 != 0, "UTC").alias("timezone"),
        after(F.col("o_custkey") % 60).alias("race_date"), F.lit(None).cast("string").alias("end_date"), F.lit(None).cast("string").alias("registration_open_date"),
        F.when(F.col("o_orderstatus") != "P", after(F.col("o_custkey") % 17)).alias("registration_close_date"),
        F.when(F.col("o_orderkey") % 3 == 0, after(F.lit(20))).alias("lottery_result_date"), status.alias("registration_status"), (F.col("o_totalprice") > 2_000).alias("monitored"), "o_custkey", "o_orderkey",
    )


def check_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """``records, facts, registry, reports, candidates``."""
    records = edition_records(spark, sf)
    none = F.lit(None).cast("string")
    said = [(none, "registrationStatus", quoted(F.col("registration_status"))), (none, "raceDate", quoted(F.col("race_date"))), *((F.lit(f"c{k}"), "distanceKm", (F.col("o_custkey") % 5 + k).cast("string")) for k in (0, 1))]
    own = F.inline(F.array(*[F.struct(c.alias("category_id"), F.lit(field).alias("field"), v.alias("value")) for c, field, v in said]))
    facts = records.select("edition_id", own)
    ids = {"edition_id": F.concat(F.lit("o"), "l_orderkey"), "source_id": F.concat_ws("-", F.concat(F.lit("s"), "l_linenumber"), "l_partkey", "l_suppkey")}
    lines = t(spark, sf, "lineitem").withColumns(ids)
    official = F.col("l_linestatus") == "O"
    tier = F.when(official, alerts.OFFICIAL).otherwise("trusted_structured")
    registry = lines.select("edition_id", "source_id", tier.alias("tier"), F.when(official, "notice").otherwise("structured_connector").alias("source_type"), F.when(F.col("l_tax") < 0.07, "active").otherwise("paused").alias("status"), (F.col("l_linenumber") <= 2).alias("is_primary"))
    fate = F.when(F.col("l_returnflag") == "A", "success").when(F.col("l_returnflag") == "N", "unchanged").when(F.col("l_discount") > 0.05, "fetch_error").otherwise("identity_uncertain")
    url = F.concat(F.lit("https://"), "source_id", F.lit(".test/"))
    reports = lines.select("edition_id", "source_id", url.alias("source_url"), tier.alias("source_tier"), F.when(F.col("l_returnflag") != "R", "matched").alias("identity"), fate.alias("extraction"), F.when(F.col("l_returnflag") == "A", "success").otherwise("skipped").alias("request"), F.lit(AS_OF).alias("fetched_at"))
    own = records.select("o_orderkey", "event_id", "race_date", "registration_status", "o_custkey")
    j = t(spark, sf, "lineitem").join(own, F.col("l_orderkey") == F.col("o_orderkey")).withColumns(ids)  # keys are short: texts are made after the shuffle
    kind = F.col("l_suppkey") % 3
    value = F.when(kind == 0, F.when(F.col("l_partkey") % 4 == 0, '"lottery"').otherwise(quoted(F.col("registration_status")))).when(kind == 1, quoted(F.when(F.col("l_partkey") % 6 == 0, day(F.col("l_shipdate"))).otherwise(F.col("race_date"))))
    value = value.otherwise((F.col("o_custkey") % 5 + F.col("l_linenumber") % 2).cast("string"))
    said = j.select(
        "edition_id", "source_id", "event_id", F.col("edition_id").alias("target_edition_id"), F.when(kind == 2, F.concat(F.lit("c"), (F.col("l_linenumber") % 2).cast("string"))).alias("category_id"),
        F.when(kind == 2, "Category").otherwise("Edition").alias("entity_type"), F.when(kind == 0, "registrationStatus").when(kind == 1, "raceDate").otherwise("distanceKm").alias("field"), value.alias("value"),
        F.when(F.col("l_partkey") % 7 == 0, '"x"').otherwise(value).alias("current_value"), url.alias("source_url"), F.when(F.col("l_quantity") > 5, "no_change").otherwise("pending").alias("action"), F.lit("UNCHANGED").alias("diff"),
        F.when(F.col("l_suppkey") % 4 != 0, "authoritative").otherwise("advisory").alias("authority"), F.when(F.col("l_extendedprice") > 1_000, "said").otherwise(" ").alias("evidence_text"), F.lit("text").alias("evidence_locator"),
        F.concat(day(F.col("l_shipdate")), F.lit("T00:00:00Z")).alias("evidence_verified_at"),
    )
    return records, facts, registry, reports, said


RECORDS_SQL = """
rec AS (SELECT 'e' || o_custkey AS event_id, 'o' || o_orderkey AS edition_id, CASE WHEN o_custkey % 5 <> 0 THEN 'UTC' END AS zone, o_custkey,
    strftime(CAST(o_orderdate AS DATE) + CAST(o_custkey % 60 AS INTEGER), '%Y-%m-%d') AS race_date,
    CASE WHEN o_orderstatus <> 'P' THEN strftime(CAST(o_orderdate AS DATE) + CAST(o_custkey % 17 AS INTEGER), '%Y-%m-%d') END AS close_date,
    CASE WHEN o_orderkey % 3 = 0 THEN strftime(CAST(o_orderdate AS DATE) + 20, '%Y-%m-%d') END AS lottery_date,
    ['registration_open', 'lottery', 'unknown', 'registration_closed', 'upcoming'][CAST(o_orderpriority[1] AS INTEGER)] AS status, o_totalprice > 2000 AS monitored FROM orders),
lin AS (SELECT *, 'o' || l_orderkey AS edition_id, 's' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS source_id, l_linestatus = 'O' AS official_tier, l_linestatus = 'O' AND l_tax < 0.07 AS official,
    l_linestatus = 'O' AND l_tax < 0.07 AND l_returnflag <> 'R' AS effective FROM lineitem)"""
STATUS_SQL = """
fact AS (SELECT edition_id, NULL AS category_id, 'registrationStatus' AS field, '"' || status || '"' AS value FROM rec WHERE monitored
  UNION ALL SELECT edition_id, NULL, 'raceDate', '"' || race_date || '"' FROM rec WHERE monitored
  UNION ALL SELECT edition_id, 'c' || k, 'distanceKm', CAST(o_custkey % 5 + k AS VARCHAR) FROM rec, range(2) r(k) WHERE monitored),
cand AS (SELECT l.*, r.race_date, r.close_date, r.lottery_date, r.zone, CASE WHEN l_suppkey % 3 = 2 THEN 'c' || (l_linenumber % 2) END AS category_id,
    ['registrationStatus', 'raceDate', 'distanceKm'][l_suppkey % 3 + 1] AS field,
    CASE l_suppkey % 3 WHEN 0 THEN CASE WHEN l_partkey % 4 = 0 THEN '"lottery"' ELSE '"' || r.status || '"' END
      WHEN 1 THEN '"' || CASE WHEN l_partkey % 6 = 0 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE r.race_date END || '"' ELSE CAST(o_custkey % 5 + l_linenumber % 2 AS VARCHAR) END AS value,
    strftime(l_shipdate, '%Y-%m-%d') AS since FROM lin l JOIN rec r USING (edition_id) WHERE effective AND l_suppkey % 4 <> 0),
told AS (SELECT *, l_returnflag = 'A' AS fresh, l_partkey % 7 <> 0 AND l_quantity > 5 AND l_extendedprice > 1000 AND (l_returnflag = 'A' OR (since <= '1997-06-17' AND (zone IS NULL OR NOT (
      (close_date < '1997-06-17') <> (close_date < since) AND close_date IS NOT NULL OR (lottery_date < '1997-06-17') <> (lottery_date < since) AND lottery_date IS NOT NULL
      OR (race_date < '1997-06-17') <> (race_date < since)
      OR (CAST(race_date AS DATE) - CAST(since AS DATE) > 14 AND CAST(race_date AS DATE) - DATE '1997-06-17' <= 14)
      OR (CAST(race_date AS DATE) - CAST(since AS DATE) > 0 AND CAST(race_date AS DATE) - DATE '1997-06-17' <= 0))))) AS direct FROM cand),
eff AS (SELECT edition_id, count(DISTINCT source_id) AS n FROM lin WHERE effective GROUP BY edition_id),
fs AS (SELECT f.edition_id, f.category_id, f.field, f.value <> '"unknown"' AS present, bool_or(c.fresh AND c.value <> f.value) AS contrary,
    bool_or(c.direct AND c.fresh AND c.value = f.value) AS now, bool_or(c.direct AND c.value = f.value) AS ever,
    coalesce(string_agg(DISTINCT c.source_id, ',' ORDER BY c.source_id) FILTER (c.direct AND c.value = f.value), '') AS sources
  FROM fact f LEFT JOIN told c ON c.edition_id = f.edition_id AND c.field = f.field AND c.category_id IS NOT DISTINCT FROM f.category_id GROUP BY ALL),
st AS (SELECT fs.edition_id, category_id, field, present, coalesce(eff.n, 0) AS n_effective, sources, CASE WHEN NOT present THEN 'UNKNOWN' WHEN contrary THEN 'NOT_VERIFIED_THIS_RUN'
    WHEN now THEN 'VERIFIED_THIS_RUN' WHEN ever THEN 'VERIFIED_INHERITED' ELSE 'NOT_VERIFIED_THIS_RUN' END AS status FROM fs LEFT JOIN eff USING (edition_id))"""


@query(f"WITH {RECORDS_SQL}, {STATUS_SQL} SELECT edition_id, category_id, field, present, n_effective, status, sources FROM st")
def fact_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.fact_evidence(*check_inputs(spark, sf)).withColumn("sources", F.array_join("sources", ","))


@query(rf"""
WITH {RECORDS_SQL}, {STATUS_SQL},
src AS (SELECT edition_id, coalesce(list_sort(list(DISTINCT source_id) FILTER (official)), []) AS official, coalesce(list_sort(list(DISTINCT source_id) FILTER (effective)), []) AS good,
    coalesce(list_sort(list(DISTINCT source_id) FILTER (official AND l_linenumber <= 2 AND NOT effective)), []) AS failed,
    coalesce(list_sort(list(DISTINCT source_id) FILTER (official AND l_returnflag = 'R' AND l_discount <= 0.05)), []) AS uncertain,
    coalesce(list_sort(list(DISTINCT source_id) FILTER (NOT official AND l_returnflag <> 'R')), []) AS auxiliary FROM lin GROUP BY edition_id),
facts AS (SELECT edition_id, max(status) FILTER (field = 'registrationStatus') AS said,
    coalesce(list_sort(list(CASE WHEN category_id IS NULL THEN 'Edition.' || field ELSE 'Category.' || field || ':' || category_id END)
      FILTER (present AND status NOT LIKE 'VERIFIED%' AND field <> 'registrationStatus')), []) AS open FROM st GROUP BY edition_id),
e AS (SELECT r.*, coalesce(official, []) AS official, coalesce(good, []) AS good, coalesce(failed, []) AS failed, coalesce(uncertain, []) AS uncertain, coalesce(auxiliary, []) AS auxiliary, said, open,
    CASE WHEN zone IS NOT NULL THEN CAST(race_date AS DATE) - DATE '1997-06-17' END AS days, coalesce(zone IS NOT NULL AND close_date < '1997-06-17', false) AS closed,
    coalesce(zone IS NOT NULL AND lottery_date < '1997-06-17', false) AS drawn FROM rec r LEFT JOIN src USING (edition_id) LEFT JOIN facts USING (edition_id) WHERE monitored),
a AS (SELECT edition_id, 'OFFICIAL_SOURCE_NOT_REGISTERED' AS reason_code, 'HIGH' AS severity, ['raceDate', 'registrationStatus', 'startAt/startTimes'] AS fields, 'No eligible official source is registered for this Edition.' AS trigger_reason, CAST([] AS VARCHAR[]) AS evidence, CAST([] AS VARCHAR[]) AS ids FROM e WHERE len(official) = 0
  UNION ALL SELECT edition_id, 'OFFICIAL_SOURCE_UNAVAILABLE', 'HIGH', ['raceDate', 'registrationStatus', 'startAt/startTimes'], '0/' || len(official) || ' registered official sources were effectively processed this run.', list_transform(auxiliary, lambda x: 'Auxiliary source processed: ' || x), official FROM e WHERE len(official) > 0 AND len(good) = 0
  UNION ALL SELECT edition_id, 'OFFICIAL_SOURCE_DEGRADED', 'REVIEW', ['official_source_health'], len(failed) || ' primary official source(s) did not complete effective processing.', list_transform(good, lambda x: 'Official source processed: ' || x), failed FROM e WHERE len(good) > 0 AND len(failed) > 0
  UNION ALL SELECT edition_id, 'EDITION_IDENTITY_UNCERTAIN', 'REVIEW', ['edition_identity'], len(uncertain) || ' official source(s) were fetched but the target Edition could not be confirmed.', list_transform(uncertain, lambda x: 'Fetched source: ' || x), uncertain FROM e WHERE len(uncertain) > 0
  UNION ALL SELECT edition_id, 'REGISTRATION_LIFECYCLE_REVIEW', CASE WHEN status IN ('registration_open', 'lottery', 'upcoming') THEN 'HIGH' ELSE 'REVIEW' END, ['registrationStatus'],
    CASE WHEN closed THEN 'The recorded registration close boundary has passed without time-qualified official status confirmation after it.' WHEN drawn THEN 'The recorded lottery result boundary has passed without time-qualified official status confirmation after it.'
      ELSE 'Race is within 14 calendar days without direct official registration-status confirmation this run.' END,
    list_filter(['Canonical registrationStatus: ' || status, CASE WHEN said = 'VERIFIED_THIS_RUN' THEN 'Current-run official value matches Canonical; post-boundary applicability is unverified.' END,
      CASE WHEN closed THEN 'Canonical registrationCloseDate: ' || close_date END, CASE WHEN drawn THEN 'Canonical lotteryResultDate: ' || lottery_date END], lambda x: x IS NOT NULL), official
    FROM e WHERE status <> 'registration_closed' AND (closed OR drawn OR (days BETWEEN 0 AND 14 AND said NOT LIKE 'VERIFIED%'))
  UNION ALL SELECT edition_id, 'CRITICAL_FACT_UNVERIFIED', 'REVIEW', open, 'Race is within 14 calendar days; listed critical facts lack direct official confirmation this run.', ['Canonical raceDate: ' || race_date], official FROM e WHERE days BETWEEN 0 AND 14 AND len(open) > 0)
SELECT edition_id, reason_code, severity, array_to_string(fields, '|') AS affected_fields, trigger_reason, array_to_string(evidence, '|') AS available_evidence, array_to_string(ids, '|') AS source_ids,
  'va-' || left(sha256('["' || edition_id || '","' || reason_code || '",["' || array_to_string(fields, '","') || '"]]'), 16) AS alert_id FROM a
""")
def edition_alerts(spark: SparkSession, sf: str) -> DataFrame:
    records, facts, registry, reports, candidates = check_inputs(spark, sf)
    found = alerts.edition_alerts(records, alerts.fact_evidence(records, facts, registry, reports, candidates), alerts.edition_sources(registry, reports), AS_OF)
    lists = {c: F.array_join(c, "|") for c in ("affected_fields", "available_evidence", "source_ids")}
    return found.withColumns(lists).select("edition_id", "reason_code", "severity", *lists, "trigger_reason", "alert_id")


@query(r"""
WITH p AS (SELECT page_id, 'u' || page_id AS url, 'G' || (page_id % 5) AS name, page_id % 11 = 0 AS other, page_id % 4 = 0 AS no_distance, page_id % 13 = 0 AS no_track, length(html) AS gain,
    nullif(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '') AS host, nullif(regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1), '') AS folder FROM pages),
e AS (SELECT *, CASE WHEN other THEN 'ValueError: identity' WHEN no_distance THEN 'ValueError: facts' WHEN no_track THEN 'ValueError: track_link' END AS error FROM p)
SELECT url, 'elevationGain' AS field, CAST(gain AS VARCHAR) AS "candidateValue", name || ' data.elevationGain: ' || gain AS "evidenceText", error FROM e WHERE error IS NULL
UNION ALL SELECT url, 'startLocation', '"' || host || '"', name || ' data.startPoint: ' || host, error FROM e WHERE error IS NULL AND host IS NOT NULL
UNION ALL SELECT url, 'finishLocation', '"' || folder || '"', name || ' data.endPoint: ' || folder, error FROM e WHERE error IS NULL AND folder IS NOT NULL
UNION ALL SELECT url, NULL, NULL, NULL, error FROM e WHERE error IS NOT NULL
""")
def extracted_facts(spark: SparkSession, sf: str) -> DataFrame:
    k, name = F.col("page_id"), F.concat(F.lit("G"), (F.col("page_id") % 5).cast("string"))
    part = lambda pattern: F.regexp_extract("url", pattern, 1)
    data = F.struct(
        F.when(k % 11 == 0, k + 1).otherwise(k).alias("id"), name.alias("name"), F.when(k % 4 == 0, 0).otherwise(42).alias("distance"), F.length("html").alias("elevationGain"), part(r"^[a-z]+://([^/?#]+)").alias("startPoint"),
        part(r"^[a-z]+://[^/]+/([a-z]+)/").alias("endPoint"), F.array(F.struct(F.when(k % 13 == 0, "https://x.test/page").otherwise("https://x.test/t.gpx").alias("linkUrl"))).alias("buttons"),
    )
    docs = t(spark, sf, "pages").select(
        F.concat(F.lit("s"), (k % 7).cast("string")).alias("source_id"), F.concat(F.lit("u"), k.cast("string")).alias("url"), F.sha2("html", 256).alias("content_hash"), F.to_json(F.struct(F.lit(0).alias("code"), data.alias("data"))).alias("body"),
        F.lit("ev").alias("event_id"), F.lit("ev-2026").alias("edition_id"), F.concat(F.lit("ev-2026-"), name).alias("category_id"), k.alias("group_id"), name.alias("group_name"),
    )
    return extractors.extracted_facts(docs, extractors.CategoryJson, salts=4).select("url", "field", "candidateValue", "evidenceText", "error")


@query(r"""
WITH a AS (SELECT item_id AS event_id, regexp_replace(lower(nfc_normalize(array_to_string(list_slice(string_split(text, ' '), k, k + 1), ''))), '[^\p{L}\p{N}]+', '', 'g') AS name FROM benchmark, range(1, 10, 3) r(k)),
d AS (SELECT doc_id, regexp_replace(lower(nfc_normalize(text)), '[^\p{L}\p{N}]+', '', 'g') AS hay FROM documents)
SELECT DISTINCT doc_id, event_id FROM d, (SELECT DISTINCT event_id, name FROM a WHERE length(name) >= 3) n WHERE contains(hay, name)
""")
def document_names(spark: SparkSession, sf: str) -> DataFrame:
    """Word pairs of benchmark items as names of events, looked up in all documents."""
    words = F.split("text", " ")
    events = t(spark, sf, "benchmark").select(F.col("item_id").alias("event_id"), F.array(*[F.array_join(F.slice(words, k, 2), "") for k in (1, 4, 7)]).alias("names"))
    return identity.name_hits(t(spark, sf, "documents"), identity.identity_names(events))


@query("""
WITH h AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type <> 'purchase' GROUP BY user_id, ts)
SELECT e.event_id, e.user_id, h.event_id AS prior_id, epoch_us(e.ts) - epoch_us(h.ts) AS since_us FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN h ON e.user_id = h.user_id AND e.ts > h.ts
""")
def prior_event(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases with the newest other event of their user before them."""
    e = t(spark, sf, "events")
    rows, old = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type <> 'purchase'").select("user_id", "ts", F.struct("ts", "event_id").alias("of"))
    out = history.as_of(rows, old, ["user_id"], "ts")
    return out.select("event_id", "user_id", F.col("prior.of.event_id").alias("prior_id"), (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("prior.of.ts").cast("timestamp"))).alias("since_us"))


@query("""
WITH RECURSIVE c AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq, l_quantity > 40 AS withdraws, l_discount < 0.05 AS by_first,
    'v' || (l_suppkey % 3) AS old_value, 'v' || (l_partkey % 3) AS new_value, l_tax > 0.07 AS conflict FROM lineitem),
f AS (SELECT o_orderkey AS k, CAST(0 AS BIGINT) AS seq, 'v' || (o_custkey % 3) AS value, false AS gone, CAST(NULL AS VARCHAR) AS outcome FROM orders
  UNION ALL SELECT c.k, c.seq, CASE WHEN NOT conflict AND NOT withdraws AND NOT (gone AND by_first) AND value = old_value THEN new_value ELSE value END,
    gone OR (NOT conflict AND withdraws), CASE WHEN conflict THEN 'conflict' WHEN withdraws THEN 'applied' WHEN gone AND by_first THEN 'evidence:not_eligible' WHEN value = old_value THEN 'applied' ELSE 'stale' END
  FROM f JOIN c ON c.k = f.k AND c.seq = f.seq + 1)
SELECT 'o' || k AS edition_id, 'change' AS kind, k || '-' || seq AS change_id, outcome, CAST(NULL AS VARCHAR) AS value FROM f WHERE seq > 0
UNION ALL SELECT 'o' || k, 'value', NULL, NULL, arg_max(value, seq) FROM f GROUP BY k
""")
def ordered_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as changes of their order, in order: values that follow each other, and lines that withdraw a source."""
    own, none = F.concat(F.lit("o"), "edition"), F.lit(None).cast("string")
    orders = t(spark, sf, "orders").select(F.col("o_orderkey").alias("edition"), (F.col("o_custkey") % 3).cast("string").alias("start"))
    snapshot = orders.select(F.lit("ev").alias("event_id"), own.alias("edition_id"), none.alias("category_id"), F.lit("Edition").alias("entity_type"), F.lit("registrationStatus").alias("field"), F.concat(F.lit("v"), "start").alias("value"))
    sources = orders.select(own.alias("edition_id"), F.explode(F.array(F.lit("s1"), F.lit("s2"))).alias("source_id")).select("edition_id", "source_id", F.concat(F.lit("https://"), "source_id").alias("url"), none.alias("content_hash"), F.lit(True).alias("eligible"), F.lit(True).alias("auto"))
    lines = t(spark, sf, "lineitem").withColumn("edition", F.col("l_orderkey")).withColumn("seq", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    withdraws = F.col("l_quantity") > 40
    by = F.when((F.col("l_discount") < 0.05) & ~withdraws, "s1").otherwise("s2")
    proof = F.array(F.struct(by.alias("source_id"), F.concat(F.lit("https://"), by).alias("source_url"), F.sha2(F.lit("text"), 256).alias("content_hash"), F.lit("said").alias("evidence_text"), F.lit("text").alias("evidence_locator"), F.lit(1.0).alias("confidence")))
    changes = lines.select(
        "seq", F.concat_ws("-", "edition", "seq").alias("change_id"), F.lit("ev").alias("event_id"), own.alias("edition_id"), F.when(withdraws, "s1").alias("category_id"), F.when(withdraws, "Source").otherwise("Edition").alias("entity_type"),
        F.when(withdraws, "status").otherwise("registrationStatus").alias("field"), F.concat(F.lit("v"), (F.col("l_suppkey") % 3).cast("string")).alias("old_value"),
        F.when(withdraws, "withdrawn").otherwise(F.concat(F.lit("v"), (F.col("l_partkey") % 3).cast("string"))).alias("new_value"), F.lit("low").alias("risk"), F.lit("pending_review").alias("action"), (F.col("l_tax") > 0.07).alias("conflict"), proof.alias("evidence"),
    )
    out = apply.apply_in_order(snapshot, sources, changes, reviewed=True)
    return out.select("edition_id", "kind", "change_id", "outcome", F.when(F.col("kind") == "value", F.col("value")).alias("value"))


@query("""
WITH e AS (SELECT '/api/races/' || page_id AS path, sha256(html) AS body FROM pages WHERE page_id % 23 <> 5),
l AS (SELECT '/api/races/' || page_id AS path, CASE WHEN page_id % 17 = 3 THEN '{"rawData":1}' ELSE sha256(html) END AS body FROM pages WHERE page_id % 19 <> 7),
d AS (SELECT coalesce(e.path, l.path) AS path, CASE WHEN l.path IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'unexpected' WHEN e.body <> l.body THEN 'changed' END AS issue, l.body FROM e FULL JOIN l ON e.path = l.path)
SELECT path, issue FROM d WHERE issue IS NOT NULL UNION ALL SELECT path, 'leak:rawData' FROM d WHERE issue IN ('changed', 'unexpected') AND contains(body, '"rawData":')
""")
def release_check(spark: SparkSession, sf: str) -> DataFrame:
    pages = t(spark, sf, "pages").select("page_id", F.concat(F.lit("/api/races/"), F.col("page_id").cast("string")).alias("path"), F.sha2("html", 256).alias("body"))
    live = pages.where("page_id % 19 <> 7").withColumn("body", F.when(F.col("page_id") % 17 == 3, '{"rawData":1}').otherwise(F.col("body")))
    return release.release_check(live.drop("page_id"), pages.where("page_id % 23 <> 5").drop("page_id"))


@query("""
WITH s AS (SELECT CASE l_returnflag WHEN 'A' THEN 'success' WHEN 'N' THEN 'unchanged' ELSE 'fetch_error' END AS x, CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'success' END AS f, CASE WHEN l_tax < 0.02 THEN 'rejected' WHEN l_tax < 0.04 THEN 'uncertain' ELSE 'matched' END AS i,
    CASE WHEN l_linestatus = 'O' THEN 'success' ELSE 'skipped' END AS r, * FROM lineitem)
SELECT (SELECT count(*) FROM orders) AS editions_checked, count(*) AS sources_checked, count(*) FILTER (f = 'success') AS sources_fetched, count(*) FILTER (x = 'fetch_error') AS sources_failed,
  count(*) FILTER (i = 'rejected') AS sources_identity_rejected, count(*) FILTER (i = 'uncertain') AS sources_identity_uncertain, count(*) FILTER (x = 'unchanged') AS sources_unchanged,
  count(*) FILTER (r = 'success' AND x = 'success') AS sources_extracted, count(*) FILTER (r = 'success') AS model_calls, CAST(sum(l_partkey) FILTER (r = 'success') AS BIGINT) AS input_tokens,
  CAST(sum(l_suppkey) FILTER (r = 'success') AS BIGINT) AS output_tokens, CAST(sum(l_partkey + l_suppkey) FILTER (r = 'success') AS BIGINT) AS total_tokens, CAST(sum(l_linenumber) AS BIGINT) AS candidates,
  count(*) FILTER (l_linenumber > 2) AS accepted, count(*) FILTER (l_linenumber <= 2) AS rejected, (SELECT count(*) FROM events) AS changes, (SELECT count(*) FROM events WHERE event_type = 'signup') AS pending_created,
  (SELECT count(*) FROM events WHERE event_type <> 'signup') AS pending_deduped, (SELECT count(*) FROM part) AS semantic_reviews, CAST(0 AS BIGINT) AS canonical_writes, (SELECT count(*) FROM customer) AS verification_alerts,
  (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS verification_alerts_high, (SELECT count(*) FROM customer WHERE c_acctbal >= 0) AS verification_alerts_review FROM s
""")
def daily_summary(spark: SparkSession, sf: str) -> DataFrame:
    flag, asked = F.col("l_returnflag"), F.col("l_linestatus") == "O"
    sources = t(spark, sf, "lineitem").select(
        F.when(flag == "A", "success").when(flag == "N", "unchanged").otherwise("fetch_error").alias("extraction"), F.when(flag == "R", "failed").otherwise("success").alias("fetch"),
        F.when(F.col("l_tax") < 0.02, "rejected").when(F.col("l_tax") < 0.04, "uncertain").otherwise("matched").alias("identity"), F.when(asked, "success").otherwise("skipped").alias("request"),
        F.when(asked, F.col("l_partkey")).alias("input_tokens"), F.when(asked, F.col("l_suppkey")).alias("output_tokens"), F.when(asked, F.col("l_partkey") + F.col("l_suppkey")).alias("total_tokens"),
        F.col("l_linenumber").alias("n_candidates"), (F.col("l_linenumber") > 2).cast("int").alias("n_accepted"), (F.col("l_linenumber") <= 2).cast("int").alias("n_rejected"), F.lit(False).alias("written"),
    )
    relations = {
        "editions": t(spark, sf, "orders"), "sources": sources, "changes": t(spark, sf, "events").select((F.col("event_type") == "signup").alias("created")), "reviews": t(spark, sf, "part"),
        "alerts": t(spark, sf, "customer").select(F.when(F.col("c_acctbal") < 0, "HIGH").otherwise("REVIEW").alias("severity")),
    }
    return daily.summary(relations, daily.daily_metrics())


@query("""
WITH r AS (SELECT o_orderpriority AS "by", 1 AS n, 0 AS fresh, 0 AS open, 0 AS moved, 0 AS c, CASE WHEN o_totalprice < 50000 THEN 1 ELSE 0 END AS failed, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS bare FROM orders
  UNION ALL SELECT o_orderpriority, 0, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END, CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END, 1, 0, 0 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT "by", CAST(sum(n) AS BIGINT) AS editions_checked, CAST(sum(fresh) AS BIGINT) AS new_sources, CAST(sum(c) AS BIGINT) AS candidates, CAST(sum(open) AS BIGINT) AS unresolved_review, CAST(sum(moved) AS BIGINT) AS changed_candidates,
  CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(bare) AS BIGINT) AS not_covered FROM r GROUP BY GROUPING SETS (("by"), ())
""")
def discovery_summary(spark: SparkSession, sf: str) -> DataFrame:
    orders = t(spark, sf, "orders")
    runs = orders.select(F.col("o_orderpriority").alias("by"), (F.col("o_totalprice") < 50_000).cast("int").alias("n_errors"), F.when(F.col("o_orderstatus") == "P", "NOT_COVERED").alias("status"))
    lines = t(spark, sf, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("by")), "l_orderkey")
    found = lines.select("by", (F.col("l_returnflag") == "N").alias("is_new"), F.when(F.col("l_linestatus") == "O", "unresolved").alias("review"), (F.col("l_quantity") > 30).alias("changed"))
    return daily.summary({"runs": runs, "found": found}, daily.discovery_metrics(), "by").drop("is_total")


@query(f"""
WITH {RECORDS_SQL}, {STATUS_SQL}, h AS (SELECT monitored, sum(CAST(effective AS INTEGER)) AS ok, count(edition_id) AS n FROM (SELECT r.monitored, r.edition_id AS e, l.edition_id, l.effective FROM rec r LEFT JOIN lin l USING (edition_id)) GROUP BY e, monitored),
f AS (SELECT count(*) AS facts_checked, count(*) FILTER (status = 'VERIFIED_THIS_RUN') AS facts_verified_this_run, count(*) FILTER (status = 'VERIFIED_INHERITED') AS facts_verified_inherited, count(*) FILTER (status = 'NOT_VERIFIED_THIS_RUN') AS facts_not_verified_this_run,
    count(*) FILTER (status = 'UNKNOWN') AS facts_unknown, count(*) FILTER (status LIKE 'VERIFIED%') AS facts_verified FROM st)
SELECT count(*) FILTER (n > 0 AND ok = n) AS health_healthy, count(*) FILTER (ok > 0 AND ok < n) AS health_partial, count(*) FILTER (n > 0 AND ok = 0) AS health_failed, count(*) FILTER (n = 0) AS health_no_source,
  any_value(f.facts_verified_this_run) AS facts_verified_this_run, any_value(f.facts_verified_inherited) AS facts_verified_inherited, any_value(f.facts_not_verified_this_run) AS facts_not_verified_this_run,
  any_value(f.facts_unknown) AS facts_unknown, any_value(f.facts_checked) AS facts_checked, any_value(f.facts_verified) AS facts_verified FROM h, f
""")
def verification_summary(spark: SparkSession, sf: str) -> DataFrame:
    records, facts, registry, reports, candidates = check_inputs(spark, sf)
    good = F.col("official") & (F.col("identity") == "matched")
    health = monitor.coverage_health(records, alerts.official_reports(registry, reports), "edition_id", F.coalesce(good, F.lit(False)))
    return daily.summary({"editions": health, "facts": alerts.fact_evidence(records, facts, registry, reports, candidates)}, daily.verification_metrics())


@query("""
WITH l AS (SELECT l_orderkey, ['runchina', 'zuicool', 'itra', 'other'][l_partkey % 4 + 1] AS s, CAST(l_quantity AS INTEGER) AS p, l_discount AS c, (l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS o,
    CASE WHEN l_tax < 0.04 THEN 'https://o.test/' || l_partkey END AS u, CASE l_returnflag WHEN 'N' THEN 'https://r.test/' || l_suppkey WHEN 'R' THEN '' END AS r FROM lineitem),
a AS (SELECT *, coalesce(u <> '', false) OR coalesce(r <> '', false) AS either FROM l)
SELECT l_orderkey, coalesce(first(u ORDER BY p DESC, c DESC, o) FILTER (s IN ('runchina', 'itra') AND either), first(u ORDER BY p DESC, c DESC, o) FILTER (u <> ''), first(u ORDER BY p DESC, c DESC, o)) AS official_url,
  coalesce(first(r ORDER BY p DESC, c DESC, o) FILTER (s = 'zuicool' AND either), first(r ORDER BY p DESC, c DESC, o) FILTER (r <> ''), first(r ORDER BY p DESC, c DESC, o)) AS registration_url FROM a GROUP BY l_orderkey
""")
def merged_urls(spark: SparkSession, sf: str) -> DataFrame:
    source = F.element_at(F.array(*map(F.lit, ("runchina", "zuicool", "itra", "other"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    flag = F.col("l_returnflag")
    rows = t(spark, sf, "lineitem").withColumns({
        "source": source, "official_url": F.when(F.col("l_tax") < 0.04, F.concat(F.lit("https://o.test/"), F.col("l_partkey").cast("string"))),
        "registration_url": F.when(flag == "N", F.concat(F.lit("https://r.test/"), F.col("l_suppkey").cast("string"))).when(flag == "R", ""),
    })
    return merge.pick_urls(rows, ["l_orderkey"], "source", F.col("l_quantity").cast("int"), F.col("l_discount"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))


@query("""
WITH s AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'trail' WHEN 'MACHINERY' THEN 'ultra_trail' WHEN 'AUTOMOBILE' THEN 'marathon' ELSE 'other' END AS kind,
    c_custkey % 31 AS a, c_custkey % 26 AS b, c_nationkey % 21 AS c, 5 + c_custkey % 11 AS d, c_custkey % 11 AS e FROM customer),
w AS (SELECT *, list_slice(list_filter([CASE WHEN a >= 22 THEN '跑者认知或赛事品牌信号较强' END, CASE WHEN b >= 20 THEN '赛事名和类型具备明确搜索价值' END, CASE WHEN c >= 15 THEN '住宿、交通、装备或旅行商业场景较强' END,
    CASE WHEN d >= 13 THEN '用户报名决策复杂，需要 X 提供判断' END, CASE WHEN e >= 8 THEN '现有 P0/P1 字段基础较好' END, CASE WHEN kind IN ('trail', 'ultra_trail') THEN '可验证越野赛事高决策成本场景' END], lambda x: x IS NOT NULL), 1, 4) AS said FROM s)
SELECT c_custkey, len(said) AS n, CASE WHEN len(said) > 0 THEN array_to_string(said, '；') ELSE '当前候选主要优势来自 ' || CASE greatest(a, b, c, d, e) WHEN a THEN 'runnerAttention' WHEN b THEN 'searchValue' WHEN c THEN 'commercialValue'
  WHEN d THEN 'decisionComplexity' ELSE 'dataCompleteness' END || '。' END AS reason FROM w
""")
def candidate_advantages(spark: SparkSession, sf: str) -> DataFrame:
    k, segment = F.col("c_custkey"), F.col("c_mktsegment")
    kind = F.when(segment == "BUILDING", "trail").when(segment == "MACHINERY", "ultra_trail").when(segment == "AUTOMOBILE", "marathon").otherwise("other")
    scored = t(spark, sf, "customer").select(
        "c_custkey", kind.alias("candidate_type"), (k % 31).alias("attention"), (k % 26).alias("search"), (F.col("c_nationkey") % 21).alias("commercial"), (k % 11 + 5).alias("complexity"), (k % 11).alias("completeness")
    )
    return candidates.advantages(scored, "X").select("c_custkey", F.size("advantages").cast("bigint").alias("n"), "reason")
