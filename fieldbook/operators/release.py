"""Releases: hash trees that are compared from the top down, leak scan of what changed, and validated snapshot reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# fixed values: keys of internal data that no public body may have
INTERNAL_KEYS = ("governance", "rawData", "mergeTrace", "confidence", "pending", "contentHash")
SECRET_MARKS = ("api_key", "authorization:", "bearer ", "-----begin")
SNAPSHOT_VERSION = "race-graph-v1"
#: Bits of the path's hash that name a leaf group, and those that each level above takes off.
LEAF_BITS, FAN_BITS = 16, 4
EMPTY = "-"


def tree(files: DataFrame, path: str = "path", body: str = "body", bits: int = LEAF_BITS) -> dict[int, DataFrame]:
    """Hash tree of a release by level (bits of the path's hash): ``g, h`` for each group; level 0 is the root.

    A group's hash is the sum of its rows' (or groups') hashes, which needs no order and no group in one task: partial sums travel.
    Hashes are sums of two 31-bit halves of SHA-256 over all members with their multiplicity.
    """
    row = F.sha2(F.concat_ws("\u0000", F.col(path), F.coalesce(F.concat(F.lit("="), F.col(body)), F.lit("~"))), 256)
    part = lambda k: F.conv(F.substring(row, 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)")
    group = F.conv(F.substring(F.sha2(F.coalesce(F.col(path), F.lit("")), 256), 1, 8), 16, 10).cast("long")
    low = files.select(F.shiftrightunsigned(group, 32 - bits).alias("g"), *[part(k).alias(f"p{k}") for k in range(4)])
    names = [f"p{k}" for k in range(4)]
    level = low.groupBy("g").agg(*[F.sum(n).alias(n) for n in names], F.count("*").alias("n"))
    out = {}
    while True:
        digest = F.sha2(F.concat_ws("/", *[F.col(n).cast("string") for n in names], F.col("n").cast("string")), 256)
        out[bits] = level.select("g", digest.alias("h"), "n")
        if bits == 0:
            return out
        step = min(FAN_BITS, bits)
        bits -= step
        level = level.groupBy(F.shiftrightunsigned("g", step).alias("g")).agg(*[F.sum(n).alias(n) for n in names], F.sum("n").alias("n"))


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    j = a.select("g", F.col("h").alias("x")).join(b.select("g", F.col("h").alias("y")), "g", "full_outer")
    return j.where(~F.col("x").eqNullSafe(F.col("y"))).select("g")


def release_diff(live: DataFrame, expected: DataFrame, live_tree: dict[int, DataFrame] | None = None, expected_tree: dict[int, DataFrame] | None = None, bits: int = LEAF_BITS) -> DataFrame:
    """``path, change`` (missing, unexpected, changed) of two releases ``path, body``.

    Trees that were stored with their releases (:func:`tree`, written) are compared from the root: level by level only groups below differing
    ones are looked at. Without both of them the leaf groups are hashed and compared at once. Either way only rows of differing leaf groups are
    compared.
    """
    if live_tree and expected_tree:
        levels = sorted(live_tree)
        bits = levels[-1]
        groups = _differing(live_tree[0], expected_tree[0])
        for above, level in zip(levels, levels[1:]):
            under = lambda d: d.withColumn("_up", F.shiftrightunsigned("g", level - above)).join(groups.select(F.col("g").alias("_up")), "_up", "left_semi")  # noqa: B023, E731
            groups = _differing(under(live_tree[level]), under(expected_tree[level]))
    else:
        groups = _differing(tree(live, bits=bits)[bits], tree(expected, bits=bits)[bits])
    leaf = F.shiftrightunsigned(F.conv(F.substring(F.sha2(F.coalesce(F.col("path"), F.lit("")), 256), 1, 8), 16, 10).cast("long"), 32 - bits)
    of = lambda df, name: df.withColumn("g", leaf).join(groups, "g", "left_semi").groupBy("path").agg(F.sort_array(F.collect_list(F.coalesce(F.sha2("body", 256), F.lit(EMPTY)))).alias(name))
    x, y = of(live, "_l"), of(expected, "_e").withColumnRenamed("path", "_p")
    j = x.join(y, F.expr("path <=> _p"), "full_outer").select(F.coalesce("path", "_p").alias("path"), "_l", "_e")
    change = F.when(F.col("_l").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("_l") != F.col("_e"), "changed")
    return j.select("path", change.alias("change")).where("change is not null")


def leaks(body: Column) -> Column:
    """Names of internal keys and secret marks that a body holds, in order."""
    keys = [F.when(F.contains(body, F.lit(f'"{k}":')), k) for k in INTERNAL_KEYS]
    marks = [F.when(F.contains(F.lower(body), F.lit(m)), F.trim(F.lit(m))) for m in SECRET_MARKS]
    return F.array_compact(F.array(*keys, *marks))


def release_check(live: DataFrame, expected: DataFrame, allowed: str = r"^/api/races(?:/[a-z0-9%-]+)?$", most: int = 5_000_000, bits: int = LEAF_BITS) -> DataFrame:
    """``path, issue`` of a live release: wrong paths, bodies too large, leaks in what differs or is new, and differences.

    Bodies equal to the expected ones were scanned when their release was built; only those that differ are scanned here.
    """
    diff = release_diff(live, expected, bits=bits)
    moved = live.join(diff.where("change <> 'missing'").select("path"), "path", "left_semi")
    leaked = moved.select("path", F.explode(leaks(F.col("body"))).alias("k")).select("path", F.concat(F.lit("leak:"), "k").alias("issue")).distinct()
    large = live.where(F.octet_length("body") > most).select("path", F.lit("too_large").alias("issue"))
    wrong = expected.where(~F.coalesce(F.col("path").rlike(allowed), F.lit(False))).select("path", F.lit("path").alias("issue"))
    return diff.select("path", F.col("change").alias("issue")).unionByName(leaked).unionByName(large).unionByName(wrong)


# ---------------------------------------------------------------- snapshots


def snapshot_violations(record: str = "r") -> Column:
    """Names of the invariants that a record ``struct<event, edition, categories>`` breaks, in order."""
    r = lambda p: F.col(f"{record}.{p}")
    empty = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    ids = F.transform(r("categories"), lambda c: c["categoryId"])
    rules = (
        ("event", r("event").isNull() | empty(r("event.eventId"))), ("edition", r("edition").isNull() | empty(r("edition.editionId"))), ("categories", r("categories").isNull()),
        ("edition_event", ~r("edition.eventId").eqNullSafe(r("event.eventId"))),
        ("edition_id", ~r("edition.editionId").eqNullSafe(F.concat_ws("-", r("event.eventId"), r("edition.editionYear").cast("string")))),
        ("category_edition", F.exists(r("categories"), lambda c: ~c["editionId"].eqNullSafe(r("edition.editionId")))),
        ("category_unique", F.size(F.array_distinct(ids)) < F.size(ids)), ("primary_category", r("edition.primaryCategoryId").isNotNull() & ~F.array_contains(ids, r("edition.primaryCategoryId"))),
    )
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules]))


RECORD = (
    "struct<event struct<eventId string, canonicalName string>, edition struct<editionId string, eventId string, editionYear int, primaryCategoryId string, raceDate string>, "
    "categories array<struct<categoryId string, editionId string, categoryName string>>>"
)


def read_snapshot(spark: SparkSession, path: str, out: str, record: str = RECORD) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """``(records, quarantined, counts)`` of a snapshot file of one record a line, ``{"schemaVersion", "generatedAt", "record"}``.

    One job reads the text, judges each line and writes it under ``out`` by its verdict, while its counts are gathered on the way
    (an observation, no second pass). A line that is no JSON of this shape, of another version or without a time is quarantined with the
    reason; records whose event or edition occurs twice are found from the ids of what was written.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.withColumn("j", F.from_json("value", f"schemaVersion string, generatedAt string, record {record}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    broken = F.col("j._bad").isNotNull() | F.col("j").isNull()
    head = F.array_compact(F.array(F.when(~F.col("j.schemaVersion").eqNullSafe(F.lit(SNAPSHOT_VERSION)), "schema_version"), F.when(F.coalesce(F.trim("j.generatedAt") == "", F.lit(True)), "generated_at")))
    judged = parsed.withColumn("r", F.col("j.record")).withColumn("issues", F.when(broken, F.array(F.lit("json"))).otherwise(F.concat(head, snapshot_violations("r"))))
    names = ("json", "schema_version", "generated_at", "event", "edition", "categories", "edition_event", "edition_id", "category_edition", "category_unique", "primary_category")
    seen = Observation("snapshot")
    counted = judged.observe(seen, F.count("*").alias("lines"), F.count_if(F.size("issues") == 0).alias("good"), *[F.count_if(F.array_contains("issues", n)).alias(n) for n in names])
    counted.select("r", "issues", "value", (F.size("issues") == 0).alias("ok")).write.mode("overwrite").partitionBy("ok").parquet(out)
    counts = dict(seen.get)
    kept = spark.read.schema(f"r {record}, issues array<string>, value string, ok boolean").parquet(out)
    good = kept.where("ok").select("r.*")
    twice = _repeated(good, "edition.editionId").unionByName(_repeated(good, "event.eventId", "edition.editionYear"))
    repeated = twice.select("id").distinct()
    records = good.join(repeated, good["edition.editionId"] == repeated["id"], "left_anti")
    doubled = good.join(repeated, good["edition.editionId"] == repeated["id"], "left_semi").select(F.to_json(F.struct("*")).alias("value"), F.array(F.lit("repeated")).alias("issues"))
    return records, kept.where("not ok").select("value", "issues").unionByName(doubled), counts


def _repeated(df: DataFrame, *keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("n"), F.collect_set("edition.editionId").alias("ids")).where("n > 1").select(F.explode("ids").alias("id"))
