"""What the training-data operators share: scratch tables, table reading, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word definition ``[^\x20\x09-\x0D]+``.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir`` (shared by driver and executors).

    Where the session leaves that setting unset, a temporary folder serves a local session; on a cluster it is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("fieldbook.scratch", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="fieldbook-")
        spark.conf.set("fieldbook.scratch", root)
    scope = spark.conf.get("fieldbook.scope", None)
    return f"{root.rstrip('/')}/fieldbook/{f'{scope}/' if scope else ''}{uuid.uuid4().hex}/{name}"


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside are deleted at its end, so results must be written before. Scopes may lie in one another."""
    outer = spark.conf.get("fieldbook.scope", None)
    scope = f"{outer}/{uuid.uuid4().hex}" if outer else uuid.uuid4().hex
    spark.conf.set("fieldbook.scope", scope)
    try:
        yield
    finally:
        if outer:
            spark.conf.set("fieldbook.scope", outer)
        else:
            spark.conf.unset("fieldbook.scope")
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("fieldbook.scratch", None)
        if root:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/fieldbook/{scope}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column | str) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null text gives an empty array."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as ``(a, b)`` long pairs: ``(node, component)``.

    Alternates large-star and small-star rewiring until no edge changes; every round is written to the
    shared folder. The component is its smallest node. Self loops are ignored; an empty graph gives no rows.
    Star rewiring moves only edges (one row each), so a component of any size never sits in one task's memory.
    """
    cur = materialize(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    for _ in range(rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt = materialize(
            small.unionByName(least.select("u", F.col("m").alias("v")))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .where("u <> v")
            .distinct(),
            "edges",
        )
        before, after = (
            d.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
            for d in (cur, nxt)
        )
        cur = nxt
        if before == after:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
