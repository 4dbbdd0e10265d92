"""Writers: validated staging writes, ordered durability, sanitized reports, release manifests."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_validated(df: DataFrame, path: str, check: Callable[[DataFrame], bool]) -> None:
    """Writes to a staging folder, reads it back, validates, and only then puts it in place.

    The old table is moved aside first and comes back if the move fails, so readers find either version.
    """
    spark = df.sparkSession
    staging, aside = f"{path}.staging-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    fs, Path = _fs(spark, path)
    try:
        df.write.parquet(staging)
        if not check(spark.read.parquet(staging)):
            raise ValueError(f"validation failed for {path}")
        had = fs.exists(Path(path))
        if had:
            fs.rename(Path(path), Path(aside))
        if not fs.rename(Path(staging), Path(path)):
            if had:
                fs.rename(Path(aside), Path(path))
            raise OSError(f"cannot put {path} in place")
        if had:
            fs.delete(Path(aside), True)
    finally:
        fs.delete(Path(staging), True)


def write_in_order(first: tuple[DataFrame, str], second: tuple[DataFrame, str], key: str, required: DataFrame) -> None:
    """Writes the first store, makes sure that a reload has all required keys, then writes the second."""
    write_validated(first[0], first[1], lambda t: required.select(key).join(t.select(key), key, "left_anti").isEmpty())
    write_validated(second[0], second[1], lambda t: True)


def sanitized(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Only the approved columns, in their order."""
    return df.select(*[c for c in allowed if c in df.columns])


def write_or_restore(new: DataFrame, path: str, then: Callable[[], None]) -> None:
    """Writes a table, then does what depends on it; if that fails, the table before comes back and the failure goes on."""
    spark = new.sparkSession
    fs, Path = _fs(spark, path)
    before = f"{path}.before-{uuid.uuid4().hex}"
    had = fs.exists(Path(path))
    if had:
        spark.read.parquet(path).write.parquet(before)
    try:
        write_validated(new, path, lambda t: True)
        then()
    except Exception:
        if had:
            write_validated(spark.read.parquet(before), path, lambda t: True)
        else:
            fs.delete(Path(path), True)
        raise
    finally:
        fs.delete(Path(before), True)
