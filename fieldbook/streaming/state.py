"""The batch state operators under Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import latest
from ..sources.readers import exists, remove


BUCKETS = 64


def upsert_stream(stream: DataFrame, store: str, checkpoint: str, keys: Sequence[str], order: Sequence[str], buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps the latest row of every key in ``store``, a table in ``buckets`` partitions by hash of the key.

    A micro-batch reads and rewrites only the partitions that its keys fall into; they are written aside first and then put in
    place one by one. Merging is idempotent, so a batch that is run again after a failure leaves the same table. A store
    that is gone after the first batch is an error, not an empty table.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = latest(batch, keys, order).withColumn("_bucket", F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # at most one row for each bucket
        if not touched:
            return
        if exists(spark, store):
            old = spark.read.schema(new.schema).parquet(store).where(F.col("_bucket").isin(touched))
            new = latest(old.unionByName(new), [*keys, "_bucket"], order)  # a late row must not replace a newer one
        elif n:
            raise FileNotFoundError(f"{store} is missing at batch {n}")
        aside = f"{store}.batch-{n}"
        new.write.mode("overwrite").parquet(aside)
        staged = spark.read.schema(new.schema).parquet(aside)
        staged.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(store)
        remove(spark, aside)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exposures(stream: DataFrame, keys: Sequence[str], ratio: str, at: str, late: str = "1 hour", threshold: float = 0.25) -> DataFrame:
    """First exposure of each key within the watermark."""
    timed = stream.where(F.col(ratio) >= threshold).withColumn(at, F.col(at).cast("timestamp"))
    return timed.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def event_counts(stream: DataFrame, at: str, kind: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events per window and kind, closed by the watermark."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp"))
    return timed.withWatermark(at, late).groupBy(F.window(at, window), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), kind, "n")
