"""Registered queries over the driver's tables, one or more operators each, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import catalog, cdc, gates, merge, monitor, rank, sets, state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

STATUSES = ("O", "P", "F")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
EVENT_TYPES = ("view", "click", "purchase", "signup", "error")
AS_OF = "1996-06-30"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c) -> object:
    """A money column as whole cents."""
    return F.floor(F.col(c) * 100 + 0.5).cast("bigint")


SQL_CENTS = "CAST(floor({0} * 100 + 0.5) AS BIGINT)"


def order_cards(spark: SparkSession, d: str) -> DataFrame:
    """Orders with customer, nation and region: the catalog table of these queries."""
    o, c, n, r = (t(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    return (
        o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == n.n_nationkey).join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey)
    )


# ---- catalog ---------------------------------------------------------------------------------------------


@query("""
SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS order_date, c_mktsegment, n_name, r_name,
       CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS status_rank
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND o_orderstatus IN ('O', 'P') AND c_mktsegment = 'BUILDING'
""")
def catalog_facets(spark: SparkSession, d: str) -> DataFrame:
    """Facet filter with a wildcard and a widened facet, calendar order."""
    cards = order_cards(spark, d)
    facets = catalog.facet_filter(cards, {"r_name": "ASIA", "o_orderstatus": "O", "c_mktsegment": "BUILDING", "n_name": catalog.ALL}, {"o_orderstatus": {"O": ("P",)}})
    out = facets.select("o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("order_date"), "c_mktsegment", "n_name", "r_name", catalog.rank_of("o_orderstatus", STATUSES).alias("status_rank"))
    return out.orderBy("status_rank", F.col("order_date").asc_nulls_last(), "o_orderkey")


@query("""
SELECT o_orderkey, o_orderstatus, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber) AS parts, CAST(count(*) AS BIGINT) AS n_lines
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey = 7 GROUP BY ALL
""")
def catalog_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Point lookup with its nested rows in display order; the key reaches both scans. Lines of one number stay in the table's order."""
    o = catalog.point_lookup(t(spark, d, "orders"), "o_orderkey", 7)
    place = F.struct(F.col("l_linenumber").isNull().alias("unnumbered"), "l_linenumber", "_metadata.file_path", "_metadata.row_index")
    lines = catalog.point_lookup(t(spark, d, "lineitem"), "l_orderkey", 7).select("l_orderkey", "l_partkey", place.alias("place"))
    j = o.join(lines, o.o_orderkey == lines.l_orderkey).groupBy("o_orderkey", "o_orderstatus").agg(F.array_sort(F.collect_list(F.struct("place", "l_partkey"))).alias("lines"))
    parts = F.array_compact(F.transform("lines", lambda x: x["l_partkey"].cast("string")))
    return j.select("o_orderkey", "o_orderstatus", F.when(F.size(parts) > 0, F.array_join(parts, ",")).alias("parts"), F.size("lines").cast("bigint").alias("n_lines"))


@query("""
SELECT d.doc_id, d.lang, d.source, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE d.n_chars > 200 AND d.lang IN ('en', 'de') AND l.quality = 1 AND coalesce(l.toxic, 0) = 0
""")
def public_list_gate(spark: SparkSession, d: str) -> DataFrame:
    """Publication gate with a deny flag, list projection."""
    j = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    flags = F.array_compact(F.array(F.when(F.col("toxic") == 1, F.lit("toxic")), F.when(F.col("quality").isNull(), F.lit("unreviewed"))))
    ok = catalog.publishable(flags, ("toxic", "unreviewed"), F.col("n_chars") > 200, F.col("lang").isin("en", "de"), F.col("quality") == 1)
    return catalog.list_item(j.where(ok), ("text", "n_chars", "toxic")).withColumn("quality", F.coalesce("quality", F.lit(-1)))




def nested_lines(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_partkey")).alias("lines"))


@query("""
SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n_lines FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_quantity >= 45 AND l_quantity <= 50)
""")
def nested_category_exists(spark: SparkSession, d: str) -> DataFrame:
    """Parents that have any nested row within a range."""
    n = nested_lines(spark, d)
    return n.where(catalog.any_nested("lines", lambda x: x["l_quantity"].between(45, 50))).select("l_orderkey", F.size("lines").cast("bigint").alias("n_lines"))


@query("""
SELECT l_orderkey, CAST(min(CASE WHEN l_quantity <> 0 THEN l_quantity END) AS BIGINT) AS low, CAST(max(CASE WHEN l_quantity <> 0 THEN l_quantity END) AS BIGINT) AS high,
       CAST(greatest(max(coalesce(l_quantity, 0)), 0) AS BIGINT) AS floor0 FROM lineitem GROUP BY l_orderkey
""")
def nested_minmax(spark: SparkSession, d: str) -> DataFrame:
    q = nested_lines(spark, d).withColumn("q", F.transform("lines", lambda x: x["l_quantity"]))
    low, high = catalog.nested_range(F.col("q"))
    return q.select("l_orderkey", low.cast("bigint").alias("low"), high.cast("bigint").alias("high"), catalog.nested_max_floor0(F.col("q")).cast("bigint").alias("floor0"))


# ---- ranking ---------------------------------------------------------------------------------------------

PART_SCORE = """
  CAST(greatest(0, least(100, floor(
    (CASE WHEN p_type LIKE 'PROMO%' THEN 25 WHEN p_type LIKE 'STANDARD%' THEN 16 ELSE 8 END)
    + (CASE WHEN abs(p_size - 25) <= 1 THEN 20 WHEN abs(p_size - 25) <= 10 THEN 14 WHEN abs(p_size - 25) <= 25 THEN 8 ELSE 0 END)
    + (CASE WHEN p_retailprice < 1200 THEN 30 WHEN p_retailprice < 1600 THEN 18 ELSE 0 END) + 0.5))) AS INTEGER)"""


def part_scores(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_type").startswith("PROMO"), 25).when(F.col("p_type").startswith("STANDARD"), 16).otherwise(8)
    size = rank.stepwise(F.abs(F.col("p_size") - 25), [(1, 20), (10, 14), (25, 8)])
    price = F.when(F.col("p_retailprice") < 1200, 30).when(F.col("p_retailprice") < 1600, 18).otherwise(0)
    return t(spark, d, "part").withColumn("score", rank.additive_score(kind, size, price))


@query(f"SELECT p_partkey, {PART_SCORE} AS score FROM part ORDER BY score DESC, p_partkey LIMIT 20")
def additive_score_topk(spark: SparkSession, d: str) -> DataFrame:
    """Additive score, clamped; the limit is the feature (top-k report)."""
    return part_scores(spark, d).orderBy(F.desc("score"), "p_partkey").limit(20).select("p_partkey", "score")


@query(f"""
SELECT p_partkey, p_size, score FROM (SELECT p_partkey, p_size, {PART_SCORE} AS score FROM part) WHERE score >= 50 ORDER BY score DESC, p_size, p_partkey LIMIT 10
""")
def score_threshold_top10(spark: SparkSession, d: str) -> DataFrame:
    s = part_scores(spark, d).where("score >= 50")
    return s.orderBy(F.desc("score"), "p_size", "p_partkey").limit(10).select("p_partkey", "p_size", "score")


@query("""
WITH r AS (SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders),
q AS (SELECT * FROM r WHERE (o_orderpriority = '1-URGENT' AND rn <= 24) OR (o_orderpriority = '2-HIGH' AND rn <= 18) OR (o_orderpriority = '3-MEDIUM' AND rn <= 8)),
b AS (SELECT * FROM r WHERE o_orderkey NOT IN (SELECT o_orderkey FROM q) ORDER BY o_totalprice DESC, o_orderkey LIMIT 50)
SELECT o_orderkey, o_orderpriority, 'quota' AS picked_by FROM q UNION ALL SELECT o_orderkey, o_orderpriority, 'backfill' FROM b
""")
def quota_topk_backfill(spark: SparkSession, d: str) -> DataFrame:
    order = [F.desc("o_totalprice"), F.col("o_orderkey")]
    quotas = {"1-URGENT": 24, "2-HIGH": 18, "3-MEDIUM": 8}
    got = rank.quota_top_k(t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderpriority", quotas, order, 100, "o_orderkey")
    return got.select("o_orderkey", "o_orderpriority", "picked_by")


@query("""
WITH s AS (SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier),
p AS (SELECT a.s_suppkey AS left_id, b.s_suppkey AS right_id,
             row_number() OVER (PARTITION BY a.s_suppkey ORDER BY abs(a.s_acctbal - b.s_acctbal), b.s_suppkey) AS rank
      FROM s a JOIN s b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey)
SELECT left_id, right_id, CAST(rank AS INTEGER) AS rank FROM p WHERE rank <= 3
""")
def next_similar_top3(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest others of the same nation."""
    return rank.nearest_others(t(spark, d, "supplier"), "s_nationkey", "s_acctbal", "s_suppkey")


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(l_quantity - 25), l_linenumber, l_quantity) AS rn FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS quantity FROM r WHERE rn = 1
""")
def nearest_value(spark: SparkSession, d: str) -> DataFrame:
    n = nested_lines(spark, d).withColumn("lines", F.array_sort("lines"))
    n = n.withColumn("x", rank.nearest("lines", 25.0, lambda x: x["l_quantity"]))
    return n.select("l_orderkey", "x.l_linenumber", F.col("x.l_quantity").cast("bigint").alias("quantity"))


# ---- merging ---------------------------------------------------------------------------------------------

SRC_ORDER = "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'error' THEN 4 ELSE 5 END"


@query(f"""
WITH e AS (SELECT *, CAST(ts AS DATE) AS day, {SRC_ORDER} AS p, CASE WHEN value >= 20 THEN {SQL_CENTS.format('value')} END AS amount FROM events),
r AS (SELECT user_id, day, event_type, amount, row_number() OVER (PARTITION BY user_id, day ORDER BY p, event_id) AS rn FROM e WHERE amount IS NOT NULL)
SELECT k.user_id, k.day, r.amount, r.event_type AS amount_source FROM (SELECT DISTINCT user_id, day FROM e) k LEFT JOIN r ON k.user_id = r.user_id AND k.day = r.day AND rn = 1
""")
def group_merge_first_available(spark: SparkSession, d: str) -> DataFrame:
    """First available value by source order, with the source that gave it."""
    e = t(spark, d, "events").withColumns({"day": F.to_date("ts"), "amount": F.when(F.col("value") >= 20, cents("value"))})
    return merge.first_available(e, ["user_id", "day"], ["amount"], "event_type", catalog.rank_of("event_type", EVENT_TYPES), F.col("event_id"))


@query("""
WITH r AS (SELECT o_custkey, o_orderpriority, o_orderstatus, o_totalprice,
       row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END DESC, o_totalprice DESC) AS rn,
       count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_orderpriority AS value, o_orderstatus AS selected_source, CAST(n AS BIGINT) AS candidate_count, 'o_orderpriority' AS field, 'Highest Confidence' AS strategy FROM r WHERE rn = 1
""")
def priority_pick_with_trace(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    rules = spark.createDataFrame([("o_orderpriority", "Highest Confidence")], "field string, strategy string")
    got = merge.priority_pick(t(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderstatus", p, F.col("o_totalprice"), rules)
    return got.select("o_custkey", "value", "selected_source", "candidate_count", "field", "strategy")


@query("""
SELECT l_orderkey, CAST(count(DISTINCT l_returnflag) AS BIGINT) AS n_values, string_agg(DISTINCT l_linestatus || '=' || l_returnflag, ';' ORDER BY l_linestatus || '=' || l_returnflag) AS options,
       'l_returnflag' AS field FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1
""")
def conflict_detection(spark: SparkSession, d: str) -> DataFrame:
    return merge.conflicts(t(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag", "l_linestatus")


@query("""
WITH l AS (SELECT *, CASE WHEN l_discount >= 0.05 THEN l_returnflag END AS known FROM lineitem)
SELECT l_orderkey, l_partkey, arg_max(known, row(l_linenumber, l_quantity, l_extendedprice)) FILTER (known IS NOT NULL) AS known, arg_max(l_linestatus, row(l_linenumber, l_quantity, l_extendedprice)) AS l_linestatus FROM l GROUP BY l_orderkey, l_partkey
""")
def category_fold(spark: SparkSession, d: str) -> DataFrame:
    """Fold of nested rows by key: last known value of one field, last row's value of another."""
    l = t(spark, d, "lineitem").withColumn("known", F.when(F.col("l_discount") >= 0.05, F.col("l_returnflag")))
    return merge.fold(l, ["l_orderkey", "l_partkey"], ["known"], ["l_linestatus"], F.struct("l_linenumber", "l_quantity", "l_extendedprice"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_quantity DESC, l_linenumber) AS rn FROM lineitem)
SELECT l_orderkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT) AS quantity FROM r WHERE rn = 1
""")
def category_keep_max(spark: SparkSession, d: str) -> DataFrame:
    best = merge.keep_best(t(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"], F.desc("l_quantity"), F.col("l_linenumber"))
    return best.select("l_orderkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("quantity"))


@query("""
SELECT doc_id, min(doc_id) OVER (PARTITION BY lower(text)) AS first_id, doc_id <> min(doc_id) OVER (PARTITION BY lower(text)) AS is_duplicate FROM documents
""")
def exact_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return merge.exact_dedupe(t(spark, d, "documents"), F.lower("text"), "doc_id")


@query("""
SELECT min_id AS first_id, doc_id AS id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS min_id FROM documents) WHERE doc_id > min_id
""")
def duplicate_star_pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("k"))
    return merge.star_pairs(docs, ["k"], "doc_id")


@query("""
SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS n_values,
  count(DISTINCT o_orderpriority) = 1 AS same_priority, CAST(35 + 15 + CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN 20 ELSE 0 END AS INTEGER) AS score
FROM orders GROUP BY 1, 2 HAVING count(*) > 1 AND count(DISTINCT o_orderstatus) > 1
""")
def possible_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Groups of one customer and year whose status differs, with their match score."""
    o = t(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    g = merge.possible_duplicates(o, ["o_custkey", "year"], "o_orderstatus", {"same_priority": "o_orderpriority"})
    return g.withColumn("score", merge.match_score({"name": F.lit(True), "year": F.lit(True), "city": F.col("same_priority")}))


@query("""
SELECT d.doc_id, CAST(least(100, 20 + CASE WHEN n_chars > 500 THEN 20 ELSE 0 END + CASE WHEN lang <> 'en' THEN 15 ELSE 0 END + CASE WHEN l.quality IS NOT NULL THEN 15 ELSE 0 END
   + CASE WHEN l.quality = 1 THEN 10 ELSE 0 END + CASE WHEN source IN ('src0', 'src1') THEN 20 ELSE 0 END) AS INTEGER) AS confidence,
  CAST(greatest(30, least(95, CASE WHEN source IN ('src0', 'src1') THEN 76 ELSE 68 END + CASE WHEN l.quality = 1 THEN 10 ELSE 0 END + CASE WHEN n_chars > 500 THEN 4 ELSE 0 END
   - least(coalesce(l.toxic, 0) * 3, 12))) AS INTEGER) AS connector_hundredths
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def merge_confidence(spark: SparkSession, d: str) -> DataFrame:
    j = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    trusted, good = F.col("source").isin("src0", "src1"), F.coalesce(F.col("quality") == 1, F.lit(False))
    a = merge.race_confidence(F.lit(True), F.col("n_chars") > 500, F.col("lang") != "en", F.col("quality").isNotNull(), good, trusted)
    b = merge.connector_confidence(trusted, good, F.col("n_chars") > 500, F.lit(False), F.coalesce("toxic", F.lit(0)))
    return j.select("doc_id", a.cast("int").alias("confidence"), b.cast("int").alias("connector_hundredths"))


@query("""
SELECT field, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT unnest(list_filter([CASE WHEN l.quality IS NULL THEN 'quality' END, CASE WHEN l.toxic IS NULL THEN 'toxic' END, CASE WHEN nullif(d.lang, 'en') IS NULL THEN 'lang' END], lambda x: x IS NOT NULL)) AS field
  FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY field
""")
def missing_fields_counts(spark: SparkSession, d: str) -> DataFrame:
    j = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left").withColumn("other_lang", F.nullif("lang", F.lit("en")))
    m = merge.missing_fields({"quality": F.col("quality"), "toxic": F.col("toxic"), "lang": F.col("other_lang")})
    return monitor.missing_counts(j.withColumn("m", m), "m")




@query(
    """
WITH e AS (SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, value, ts FROM events)
SELECT user_id, 'First Available' AS strategy, arg_min(event_type, row(CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END, event_type)) AS value, false AS needs_review FROM e GROUP BY user_id
UNION ALL SELECT user_id, 'Merge All', string_agg(DISTINCT event_type, '; ' ORDER BY event_type), false FROM e GROUP BY user_id
UNION ALL SELECT user_id, 'Latest Timestamp Wins', arg_max(event_type, row(ts, event_type)), false FROM e GROUP BY user_id
UNION ALL SELECT user_id, 'Highest Confidence', arg_max(event_type, row(value, event_type)), false FROM e GROUP BY user_id
UNION ALL SELECT user_id, 'Manual Review', CASE WHEN count(DISTINCT event_type) <= 1 THEN min(event_type) END, count(DISTINCT event_type) > 1 FROM e GROUP BY user_id
UNION ALL SELECT user_id, 'Ignore External', min(CASE WHEN event_type = 'signup' THEN event_type END), false FROM e GROUP BY user_id
UNION ALL SELECT user_id, 'Derived', NULL, false FROM e GROUP BY user_id
"""
)
def merge_strategies(spark: SparkSession, d: str) -> DataFrame:
    """The seven documented strategies on one field."""
    pr = F.when(F.col("event_type") == "purchase", 0).otherwise(1)
    return merge.apply_strategies(t(spark, d, "events"), ["user_id"], "event_type", "event_type", pr, F.col("value"), F.col("ts"), F.col("event_type") == "signup")


# ---- monitoring ------------------------------------------------------------------------------------------


@query("""
WITH j AS (SELECT d.source, d.lang, CAST(l.quality AS VARCHAR) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)),
u AS (SELECT source, 'lang' AS field, (nullif(lang, '') IS NOT NULL)::INT AS p FROM j UNION ALL SELECT source, 'quality', (quality IS NOT NULL)::INT FROM j)
SELECT field, source, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(p) AS BIGINT) AS n_present, CAST(grouping(source) AS TINYINT) AS is_total FROM u GROUP BY GROUPING SETS ((field, source), (field))
""")
def field_coverage_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    j = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    return monitor.field_coverage(j, "source", ["lang", "quality"])


@query("SELECT quality, CAST(count(*) AS BIGINT) AS n FROM labels GROUP BY quality")
def quality_counts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "labels").groupBy("quality").agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT o_custkey, count(*) AS n_reports, count(*) FILTER (o_orderstatus = 'F') AS n_ok FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY o_custkey)
SELECT c_custkey, CAST(coalesce(n_reports, 0) AS BIGINT) AS n_reports, CAST(coalesce(n_ok, 0) AS BIGINT) AS n_ok,
  CASE WHEN coalesce(n_reports, 0) = 0 THEN 'NO_SOURCE' WHEN n_ok = n_reports THEN 'HEALTHY' WHEN n_ok > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS health
FROM customer LEFT JOIN r ON c_custkey = o_custkey
""")
def coverage_health(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")).withColumnRenamed("o_custkey", "c_custkey")
    return monitor.coverage_health(t(spark, d, "customer"), o, "c_custkey", F.col("o_orderstatus") == "F")


@query(f"""
SELECT count(*) AS n_rows, count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (value > 50) AS n_large,
  CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN {SQL_CENTS.format('value')} END), 0) AS BIGINT) AS purchase_cents FROM events
""")
def summary_conditional(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return monitor.summary(
        t(spark, d, "events"), {"n_rows": F.lit(True), "n_error": kind == "error", "n_large": F.col("value") > 50}, {"purchase_cents": F.when(kind == "purchase", cents("value"))}
    )


@query("""
WITH c AS (SELECT source, count(*) AS n, sum((l.quality IS NOT NULL)::INT) AS p FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source), s AS (SELECT *, p / n AS share FROM c)
SELECT 'quality' AS field, string_agg(source, ',' ORDER BY source) AS best_sources FROM s WHERE share = (SELECT max(share) FROM s)
""")
def best_source_ties(spark: SparkSession, d: str) -> DataFrame:
    j = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    return monitor.best_sources(monitor.field_coverage(j, "source", ["quality"]))


@query("""
WITH d AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/]*/([a-z]+)/', 1) AS lang FROM pages)
SELECT host, CAST(count(DISTINCT lang) AS BIGINT) AS n_owners FROM d GROUP BY host HAVING count(DISTINCT lang) > 1
""")
def shared_hosts(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "://[^/]*/([a-z]+)/", 1).alias("lang"))
    return monitor.shared_hosts(p, "host", "lang")


# ---- joins and sets --------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')")
def unconsumed_anti(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")).select(F.col("o_custkey").alias("c_custkey"))
    return sets.unconsumed(t(spark, d, "customer").select("c_custkey", "c_name"), o, "c_custkey")


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AS big_spender FROM customer")
def flag_semi(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return sets.flagged(t(spark, d, "customer").select("c_custkey"), o, "c_custkey", "big_spender")


@query("SELECT n.n_nationkey, n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def required_reference(spark: SparkSession, d: str) -> DataFrame:
    """Inner join that fails on a missing partner."""
    r = t(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return sets.required_reference(t(spark, d, "nation"), r, "n_regionkey").select("n_nationkey", "n_name", "r_name")


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def evidence_verbatim(spark: SparkSession, d: str) -> DataFrame:
    """Every document with each benchmark item that it holds word for word."""
    return sets.contains_pairs(t(spark, d, "documents"), "doc_id", "text", t(spark, d, "benchmark"), "item_id", "text")


@query("SELECT d.doc_id, min(item_id) AS first_item FROM documents d LEFT JOIN benchmark b ON contains(d.text, b.text) GROUP BY d.doc_id")
def contains_match_first(spark: SparkSession, d: str) -> DataFrame:
    found = sets.first_containing(t(spark, d, "documents"), "doc_id", "text", t(spark, d, "benchmark"), "item_id", "text", "first_item")
    return found.select("doc_id", "first_item")


@query("""
SELECT 'union_all' AS op, CAST(count(*) AS BIGINT) AS n FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'distinct', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'except', count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT n_nationkey FROM nation INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
UNION ALL SELECT 'except_all', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)
""")
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    s = t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    n, rich = t(spark, d, "nation").select(F.col("n_nationkey").alias("k")), t(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    ops = {"union_all": c.unionByName(s), "distinct": c.union(s).distinct(), "except": n.subtract(rich), "intersect": n.intersect(rich), "except_all": c.exceptAll(s)}
    out = None
    for name, df in ops.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = part if out is None else out.unionByName(part)
    return out


# ---- change tracking -------------------------------------------------------------------------------------

CANDIDATES = """
base AS (SELECT CAST(o_orderkey AS VARCHAR) AS entity_id, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice, o_orderkey FROM orders),
s AS (SELECT 'Edition' AS entity_type, entity_id, 'registrationStatus' AS field, status AS value FROM base UNION ALL SELECT 'Edition', entity_id, 'raceDate', day FROM base),
c AS (
  SELECT 'Edition' AS entity_type, entity_id, 'registrationStatus' AS field, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE status END AS value, 'a' AS source_id, 0.9 AS confidence FROM base WHERE o_orderkey % 3 = 0
  UNION ALL SELECT 'Edition', entity_id, 'registrationStatus', 'Y', 'b', 0.7 FROM base WHERE o_orderkey % 21 = 0
  UNION ALL SELECT 'Edition', entity_id, 'raceDate', day, 'a', 0.9 FROM base WHERE o_orderkey % 2 = 0
  UNION ALL SELECT 'Edition', '-' || entity_id, 'raceDate', day, 'c', 0.9 FROM base WHERE o_orderkey % 11 = 0),
g AS (SELECT entity_type, entity_id, field, count(DISTINCT value) AS n, min(value) AS new_value, min(confidence) AS confidence, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS sources FROM c GROUP BY ALL),
diff AS (SELECT coalesce(s.entity_type, g.entity_type) AS entity_type, coalesce(s.entity_id, g.entity_id) AS entity_id, coalesce(s.field, g.field) AS field,
  CASE WHEN g.n IS NULL THEN 'NO_CANDIDATE' WHEN g.n > 1 THEN 'CONFLICT' WHEN s.entity_id IS NULL THEN 'MISSING' WHEN s.value = g.new_value THEN 'UNCHANGED' ELSE 'CHANGED' END AS status,
  s.value AS old_value, CASE WHEN g.n = 1 THEN g.new_value END AS new_value, CAST(g.confidence AS DOUBLE) AS confidence, g.sources
  FROM s FULL OUTER JOIN g ON s.entity_type = g.entity_type AND s.entity_id = g.entity_id AND s.field = g.field)"""


def order_facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Snapshot facts of the orders, and candidate facts that partly differ, conflict or have no target."""
    base = t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("registrationStatus"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("raceDate"))
    snap = cdc.unpivot_facts(base, "Edition", "o_orderkey", ["registrationStatus", "raceDate"])
    k = F.col("o_orderkey")

    def some(where, field, value, source, confidence, entity=k.cast("string")):
        fact = {"entity_type": F.lit("Edition"), "entity_id": entity, "field": F.lit(field), "value": value, "source_id": F.lit(source), "confidence": F.lit(confidence)}
        return F.when(where, F.struct(*[c.alias(n) for n, c in fact.items()]))

    facts = [
        some(k % 3 == 0, "registrationStatus", F.when(k % 5 == 0, "X").otherwise(F.col("registrationStatus")), "a", 0.9),
        some(k % 21 == 0, "registrationStatus", F.lit("Y"), "b", 0.7),
        some(k % 2 == 0, "raceDate", F.col("raceDate"), "a", 0.9),
        some(k % 11 == 0, "raceDate", F.col("raceDate"), "c", 0.9, F.concat(F.lit("-"), k.cast("string"))),
    ]
    return snap, base.select(F.inline(F.array_compact(F.array(*facts))))


@query(f"WITH {CANDIDATES} SELECT * FROM diff")
def fact_diff(spark: SparkSession, d: str) -> DataFrame:
    return cdc.fact_diff(*order_facts(spark, d))


@query(f"""
WITH {CANDIDATES} SELECT entity_type, entity_id, field, status,
  CASE WHEN status = 'MISSING' THEN 'structural' WHEN field = 'raceDate' THEN 'high_impact' ELSE 'low' END AS risk,
  CASE WHEN status IN ('CONFLICT', 'MISSING') THEN 'needs_review' WHEN field = 'raceDate' THEN 'pending_review' WHEN old_value = 'F' AND new_value = 'X' THEN 'pending_review'
       WHEN sources <> 'a' THEN 'needs_review' WHEN confidence < 0.8 THEN 'needs_review' ELSE 'auto_apply' END AS action
FROM diff WHERE status IN ('CHANGED', 'CONFLICT', 'MISSING')
""")
def risk_classify(spark: SparkSession, d: str) -> DataFrame:
    diff = cdc.fact_diff(*order_facts(spark, d))
    out = cdc.classify(diff, F.col("sources") == "a", (F.col("old_value") == "F") & (F.col("new_value") == "X"))
    return out.select("entity_type", "entity_id", "field", "status", "risk", "action")


@query(f"""
WITH {CANDIDATES} SELECT s.entity_type, s.entity_id, s.field, CASE WHEN d.status = 'CHANGED' THEN d.new_value ELSE s.value END AS value
FROM s JOIN diff d ON s.entity_type = d.entity_type AND s.entity_id = d.entity_id AND s.field = d.field
""")
def apply_changes(spark: SparkSession, d: str) -> DataFrame:
    snap, cand = order_facts(spark, d)
    changed = cdc.fact_diff(snap, cand).where("status = 'CHANGED'").withColumns({"change_id": cdc.change_id(), "status": F.lit("approved"), "seq": F.lit(1)})
    return cdc.apply_changes(snap, changed)[0]


@query(f"""
WITH {CANDIDATES}, m AS (SELECT entity_type, entity_id, field FROM c GROUP BY ALL HAVING count(DISTINCT value) > 1)
SELECT c.entity_type, c.entity_id, c.field, value, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS sources, CAST(count(*) AS BIGINT) AS n_evidence FROM c JOIN m USING (entity_type, entity_id, field) GROUP BY ALL
""")
def conflict_options(spark: SparkSession, d: str) -> DataFrame:
    return cdc.conflict_options(order_facts(spark, d)[1])


# ---- state -----------------------------------------------------------------------------------------------


@query(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT user_id, event_type, event_id, {SQL_CENTS.format('value')} AS cents FROM r WHERE rn = 1
""")
def keyed_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Two batches, the later one replacing keys of the earlier one."""
    e = t(spark, d, "events").select("user_id", "event_type", "ts", "event_id", cents("value").alias("cents"))
    cut = F.lit("2024-01-15").cast("timestamp")
    keys, order = ["user_id", "event_type"], ["ts", "event_id"]
    out = state.upsert(state.latest(e.where(F.col("ts") < cut), keys, order), state.latest(e.where(F.col("ts") >= cut), keys, order), keys)
    return out.select("user_id", "event_type", "event_id", "cents")


@query("""
SELECT doc_id, sha256(text) AS hash FROM documents WHERE NOT (doc_id % 4 <> 0 AND lang = 'en')
""")
def hash_gate(spark: SparkSession, d: str) -> DataFrame:
    """Documents to process again: unknown, or their content hash changed."""
    now = t(spark, d, "documents").select("doc_id", "lang", text.content_hash(F.col("text")).alias("hash"))
    known = now.where("lang = 'en'").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.lit("old")).otherwise(F.col("hash")).alias("hash"))
    return state.hash_gate(known, now.select("doc_id", "hash"), ["doc_id"], ["hash"])


@query("""
SELECT conv_id, turn, role, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS user_no, lpad(CAST(row_number() OVER w AS VARCHAR), 2, '0') AS label
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)
""")
def running_index(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    no = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("string")
    label = F.when(F.length(no) >= 2, no).otherwise(F.lpad(no, 2, "0"))
    return t(spark, d, "conversations").select("conv_id", "turn", "role", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w).alias("user_no"), label.alias("label"))


@query("""
WITH e AS (SELECT *, CASE WHEN value > 10 THEN value END AS known FROM events),
p AS (SELECT *, last_value(known IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
             row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nth FROM e)
SELECT event_id, user_id, coalesce(known < prev, false) AS decreases, nth > 1 AS seen FROM p
""")
def monotonic_check(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").withColumn("known", F.when(F.col("value") > 10, F.col("value")))
    e = gates.not_decreasing(e, ["user_id"], ["ts", "event_id"], "known", "decreases")
    return gates.seen_before(e, ["user_id"], ["ts", "event_id"], "event_type", "seen").select("event_id", "user_id", "decreases", "seen")


@query("""
WITH p AS (SELECT event_id, user_id, ts >= TIMESTAMP '2024-01-15' AS now, lag(ts >= TIMESTAMP '2024-01-15') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, user_id FROM p WHERE before IS NOT NULL AND before <> now
""")
def boundary_crossing(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select("event_id", "user_id", "ts")
    return state.crossed(e, ["user_id"], ["ts", "event_id"], F.col("ts") >= F.lit("2024-01-15").cast("timestamp")).select("event_id", "user_id")


@query("""
WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events WHERE value >= 0.25)
SELECT user_id, event_type, event_id FROM r WHERE rn = 1
""")
def exposure_once(spark: SparkSession, d: str) -> DataFrame:
    return state.exposure_once(t(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], "value", ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("""
WITH k AS (SELECT user_id, max(row(ts, event_id)) FILTER (event_type <> 'error') AS ok FROM events GROUP BY user_id),
f AS (SELECT e.user_id, count(*) AS n FROM events e JOIN k USING (user_id) WHERE event_type = 'error' AND (ok IS NULL OR row(ts, event_id) > ok) GROUP BY e.user_id)
SELECT k.user_id, CAST(coalesce(n, 0) AS BIGINT) AS failures, CASE WHEN coalesce(n, 0) <= 0 THEN 'Healthy' WHEN n < 3 THEN 'Warning' ELSE 'Error' END AS health FROM k LEFT JOIN f USING (user_id)
""")
def failure_ladder(spark: SparkSession, d: str) -> DataFrame:
    f = state.trailing_failures(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")
    return f.withColumn("health", state.health(F.col("failures")))


@query("""
SELECT user_id, min(ts) AS first_seen, arg_max(event_type, ts) AS event_type FROM (SELECT user_id, ts, min(event_type) AS event_type FROM events GROUP BY ALL) GROUP BY user_id
""")
def earliest_seen(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").groupBy("user_id", "ts").agg(F.min("event_type").alias("event_type"))
    return merge.earliest_seen(e, "user_id", "ts", ["event_type"]).select("user_id", F.col("first_seen"), "event_type")


# ---- scalar functions ------------------------------------------------------------------------------------


@query(f"""
SELECT o_orderkey, CAST(date_diff('day', DATE '{AS_OF}', CAST(o_orderdate AS DATE)) AS INTEGER) AS days,
  CASE WHEN CAST(o_orderdate AS DATE) > DATE '{AS_OF}' THEN 'D-' || date_diff('day', DATE '{AS_OF}', CAST(o_orderdate AS DATE)) WHEN CAST(o_orderdate AS DATE) = DATE '{AS_OF}' THEN 'today' ELSE 'past' END AS label,
  CAST(dayofweek(o_orderdate) AS INTEGER) AS weekday, CAST(day(last_day(CAST(o_orderdate AS DATE))) AS INTEGER) AS month_days FROM orders
""")
def countdown_display(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return t(spark, d, "orders").select(
        "o_orderkey", dates.countdown_days(day, AS_OF).alias("days"), dates.countdown_label(day, AS_OF).alias("label"), dates.weekday(day).alias("weekday"), dates.days_in_month(day).alias("month_days")
    )


@query("""
WITH x AS (SELECT p_partkey, p_type || ' ' || p_name || CASE p_partkey % 5 WHEN 0 THEN ' 报名截止' WHEN 1 THEN ' 抽签' WHEN 2 THEN ' closed' WHEN 3 THEN ' 半马 21.1km' ELSE ' ultra trail 100 km' END AS s FROM part)
SELECT p_partkey,
  CASE WHEN regexp_matches(s, 'registration_open|报名|点此报名|一键报名') THEN 'registration_open' WHEN regexp_matches(s, 'lottery|抽签') THEN 'lottery' WHEN regexp_matches(s, 'closed|关闭|截止|结束') THEN 'closed'
       WHEN regexp_matches(s, 'finished|完赛|已结束') THEN 'finished' ELSE s END AS connector_status,
  CASE WHEN regexp_matches(lower(s), '报名中|开放|registration open') THEN 'registration_open' WHEN regexp_matches(lower(s), '抽签|lottery') THEN 'lottery' WHEN regexp_matches(lower(s), '已截止|截止|closed') THEN 'closed'
       WHEN regexp_matches(lower(s), '取消|cancel') THEN 'cancelled' WHEN regexp_matches(lower(s), '结束|完赛|finished') THEN 'finished' ELSE 'upcoming' END AS status
FROM x
""")
def status_from_text(spark: SparkSession, d: str) -> DataFrame:
    """Two status rule sets whose order differs."""
    return _tagged_parts(spark, d).select(
        "p_partkey", text.connector_status(F.col("s")).alias("connector_status"), text.race_status(F.col("s"), F.lit(None).cast("date"), F.lit(2030), AS_OF).alias("status")
    )


def _tagged_parts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    tail = F.when(k == 0, " 报名截止").when(k == 1, " 抽签").when(k == 2, " closed").when(k == 3, " 半马 21.1km").otherwise(" ultra trail 100 km")
    return t(spark, d, "part").select("p_partkey", F.concat("p_type", F.lit(" "), "p_name", tail).alias("s"))


@query("""
WITH x AS (SELECT p_partkey, lower(p_type || ' ' || p_name || CASE p_partkey % 5 WHEN 0 THEN ' 报名截止' WHEN 1 THEN ' 抽签' WHEN 2 THEN ' closed' WHEN 3 THEN ' 半马 21.1km' ELSE ' ultra trail 100 km' END) AS s FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(s, 'utmb') THEN 'utmb' WHEN regexp_matches(s, 'triathlon|铁人三项') THEN 'triathlon'
  WHEN regexp_matches(s, 'ultra|100\\s?km|百公里|超级|超马') AND regexp_matches(s, 'trail|越野|山') THEN 'ultra_trail' WHEN regexp_matches(s, 'trail|越野|山地') THEN 'trail'
  WHEN regexp_matches(s, '半程马拉松|半马|21\\.?1') THEN 'half_marathon' WHEN regexp_matches(s, '马拉松|全马|42\\.?2|42\\.195|marathon') THEN 'marathon'
  WHEN regexp_matches(s, '跑|run|running|km|公里') THEN 'road_running' ELSE 'other' END AS race_type,
  CASE WHEN regexp_matches(s, '半程马拉松|半马|21\\.0975|21\\.1') THEN CAST(21.1 AS DOUBLE) WHEN regexp_matches(s, '全马|马拉松|42\\.195|42\\.2') AND NOT contains(s, '半') THEN CAST(42.2 AS DOUBLE)
    WHEN regexp_matches(s, '(\\d+(?:\\.\\d+)?)\\s?(?:mile|miles|英里)') THEN floor(CAST(regexp_extract(s, '(\\d+(?:\\.\\d+)?)\\s?(?:mile|miles|英里)', 1) AS DOUBLE) * 1.60934 * 10 + 0.5) / 10
    WHEN regexp_matches(s, '(\\d+(?:\\.\\d+)?)\\s?(?:km|公里|k\\b)') THEN floor(CAST(regexp_extract(s, '(\\d+(?:\\.\\d+)?)\\s?(?:km|公里|k\\b)', 1) AS DOUBLE) * 10 + 0.5) / 10 END AS km FROM x
""")
def type_from_text(spark: SparkSession, d: str) -> DataFrame:
    return _tagged_parts(spark, d).select("p_partkey", text.race_type(F.col("s")).alias("race_type"), text.distance_km(F.col("s")).alias("km"))


URL_TAILS = ["", "?utm_source=x&b=2&a=1#f", "/?gclid=9&UTM_medium=q&z=1&z=0", "?token=1&a=2", "//?spm=1&from=2&ref=3", "?a=1&FBCLID=2"]


@query(f"""
WITH u AS (SELECT page_id, url || ({URL_TAILS!r})[1 + page_id % {len(URL_TAILS)}] AS url FROM pages),
p AS (SELECT page_id, lower(regexp_extract(url, '(?i)^(https?)://', 1)) AS scheme, lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path,
  list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '') AS q FROM u),
k AS (SELECT *, list_filter(q, lambda x: NOT regexp_matches(split_part(x, '=', 1), '(?i)^(utm_|fbclid$|gclid$)')) AS kept,
  len(list_filter(q, lambda x: regexp_matches(split_part(x, '=', 1), '(?i)^(token|access_token|api_key|password|secret)$'))) > 0 AS secret FROM p),
s AS (SELECT *, array_to_string(list_transform(list_sort(list_transform(range(len(kept)), lambda i: struct_pack(n := split_part(kept[i + 1], '=', 1), i := i, v := kept[i + 1]))), lambda x: x.v), '&') AS sorted FROM k)
SELECT page_id, CASE WHEN scheme <> '' AND NOT secret THEN scheme || '://' || host || CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END
  || CASE WHEN sorted = '' THEN '' ELSE '?' || sorted END END AS url, regexp_replace(regexp_extract(host, '^[^:]*'), '^www\\.', '') AS domain FROM s
""")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Addresses without tracking parameters, sorted, without final slashes; none where a secret is named."""
    tail = F.element_at(F.array(*map(F.lit, URL_TAILS)), (F.col("page_id") % len(URL_TAILS) + 1).cast("int"))
    url = F.concat("url", tail)
    return t(spark, d, "pages").select("page_id", text.normalize_url(url).alias("url"), text.domain(url).alias("domain"))


@query(r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'gs') AS x FROM pages)
SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS text_hash FROM a
""")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", F.sha2(text.strip_html(F.col("html")), 256).alias("text_hash"))


@query(r"""
SELECT page_id, CAST(len(regexp_extract_all(html, '(?is)<a\b[^>]*?href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 1)) AS BIGINT) AS n_links,
  array_to_string(regexp_extract_all(html, '(?is)<a\b[^>]*?href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 1), ' ') AS hrefs FROM pages
""")
def link_extract(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "pages").select("page_id", text.links(F.col("html")).alias("l"))
    return p.select("page_id", F.size("l").cast("bigint").alias("n_links"), F.array_join(F.transform("l", lambda x: x["href"]), " ").alias("hrefs"))


@query("""
SELECT p_partkey, left(lower(to_base(CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(p_name, ''), lambda x: CAST(unicode(x) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) AS BIGINT), 36)), 6) AS hash FROM part
""")
def poly_hash_slug(spark: SparkSession, d: str) -> DataFrame:
    """31-polynomial hash in base 36; pytest compares it with a plain loop too."""
    return t(spark, d, "part").select("p_partkey", text.poly_hash(F.col("p_name")).alias("hash"))


@query("""
SELECT doc_id, sha256(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: trim(regexp_replace(x, '[\\s]+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS hash FROM documents
""")
def line_normalize(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.sha2(text.normalize_lines(F.col("text")), 256).alias("hash"))


@query("""
SELECT l_orderkey, l_linenumber, CASE l_linestatus WHEN 'F' THEN 'weekly' ELSE CASE l_returnflag WHEN 'R' THEN 'daily_before_race' WHEN 'A' THEN 'daily' ELSE 'weekly' END END AS frequency,
  l_returnflag = 'R' AND l_linestatus = 'O' AS emergency FROM lineitem
""")
def sync_policy(spark: SparkSession, d: str) -> DataFrame:
    l = t(spark, d, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "Official").when(F.col("l_returnflag") == "A", "Aggregator").otherwise("Map")
    life = F.when(F.col("l_linestatus") == "F", "finished").otherwise("upcoming")
    field = F.when(F.col("l_linestatus") == "O", "rulebookUrl").otherwise("venue")
    return l.select("l_orderkey", "l_linenumber", state.sync_frequency(kind, life).alias("frequency"), state.emergency_sync(field, F.lit("a"), F.lit("b"), kind).alias("emergency"))


@query("""
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 3 = 0 THEN 'date' END, CASE WHEN o_totalprice > 400000 THEN 'large' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END], lambda x: x IS NOT NULL), ',') AS issues FROM orders
""")
def issue_codes(spark: SparkSession, d: str) -> DataFrame:
    """Issue arrays of a gate: rule names in order, each once."""
    day = F.when(F.col("o_orderkey") % 3 == 0, F.lit("1996-2-30")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    i = gates.issues((dates.strict_date(day).isNull(), "date"), (F.col("o_totalprice") > 400000, "large"), (F.col("o_orderstatus") == "P", "pending"))
    return t(spark, d, "orders").select("o_orderkey", F.array_join(i, ",").alias("issues"))


@query("""
SELECT event_type, date_trunc('day', ts) AS window_start, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL
""")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per day and type; the streaming form is ``streaming.state.event_counts``."""
    e = t(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return e.select("event_type", F.col("w.start").alias("window_start"), "n")
