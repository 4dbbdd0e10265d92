"""Readers: JSON arrays and envelopes, pages, documents; a failed source gives no rows and the run goes on."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import normalize_lines, race_links, remove_noise, strip_html


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store it names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a JSON array file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_envelope(spark: SparkSession, path: str, record_schema: str, version: str | None = None) -> DataFrame:
    """Records of ``{schemaVersion, generatedAt, records: [...]}``; another version fails the read."""
    env = spark.read.schema(f"schemaVersion string, generatedAt string, records array<struct<{record_schema}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    if version is not None:
        env = env.where(F.assert_true(F.col("schemaVersion").eqNullSafe(F.lit(version)), F.lit("unexpected schemaVersion")).isNull())
    return env.select(F.inline("records"))


def or_empty(spark: SparkSession, path: str, schema: StructType | str, read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """The table, or an empty one where the file is missing."""
    return read(spark, path) if exists(spark, path) else spark.createDataFrame([], schema)


def first_non_empty(*tables: DataFrame) -> DataFrame:
    """The first table that has rows, else the last."""
    for t in tables[:-1]:
        if not t.isEmpty():
            return t
    return tables[-1]


def run_sources(sources: Mapping[str, Callable[[], DataFrame]], schema: str, spark: SparkSession, landing: str) -> tuple[DataFrame, dict[str, str]]:
    """Union of all sources and the errors of those that failed.

    Each source is read into a table of its own under ``landing`` before it counts, so a read that fails in a task fails
    its source and nothing else.
    """
    out, errors = spark.createDataFrame([], schema), {}
    for name, fetch in sources.items():
        try:
            part = fetch()
            part.write.mode("overwrite").parquet(f"{landing}/{name}")
        except Exception as e:  # noqa: BLE001 a source's failure is data here
            errors[name] = str(e).splitlines()[0]
            continue
        out = out.unionByName(spark.read.schema(part.schema).parquet(f"{landing}/{name}"), allowMissingColumns=True)
    return out, errors


def connector_outputs(spark: SparkSession, paths: Sequence[str], record_schema: str) -> DataFrame:
    """Records of several connector files (``{generatedAt, records: [...]}``) in one table."""
    env = spark.read.schema(f"generatedAt string, records array<struct<{record_schema}>>").option("multiLine", True).option("mode", "FAILFAST").json(list(paths))
    return env.select(F.inline("records"))


def documents(spark: SparkSession, path: str, max_bytes: int = 5 << 20) -> DataFrame:
    """Text files as documents: ``path, text, content_hash``; larger ones are left out by their length."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= max_bytes)
    text = F.decode("content", "UTF-8")
    body = F.when(F.col("path").rlike(r"\.html?$"), normalize_lines(strip_html(remove_noise(text)))).otherwise(normalize_lines(text))
    return files.select("path", body.alias("text")).withColumn("content_hash", F.sha2("text", 256))


def page_links(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``id, href, label`` of links whose label looks like a race, each once a page."""
    return pages.select(id_col, F.explode(race_links(F.col(html_col))).alias("l")).select(id_col, "l.href", "l.label")


def newest_valid(runs: DataFrame, kind: str, run: str, payload: str) -> DataFrame:
    """Per kind the payload of the newest run that has one."""
    return runs.where(F.col(payload).isNotNull()).groupBy(kind).agg(F.max_by(payload, run).alias(payload), F.max(run).alias(run))
