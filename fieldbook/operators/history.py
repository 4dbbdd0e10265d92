"""As-of joins over versioned history, and what an extraction inherits from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Stretches of time that the rows of one key may be spread over.
STRETCHES = 256


def as_of(rows: DataFrame, history: DataFrame, keys: Sequence[str], at: str, stretches: int = STRETCHES) -> DataFrame:
    """All rows with ``prior``: the newest history row (a struct) of equal keys before the row's time; null where there is none.

    Both tables become one stream in the order of keys and time. Time is cut into stretches of about equal numbers of rows, so a key with any
    share of all rows is walked in many tasks: a stretch begins with the last history row of the stretches before it, which comes from
    one row for each key and stretch. Null keys equal each other; of several history rows of one time the largest stands.
    """
    other = [c for c in history.columns if c not in keys]
    both = rows.select(*keys, F.col(at).alias("_at"), F.struct(*rows.columns).alias("_row"), F.lit(None).cast(history.select(F.struct(*other)).schema[0].dataType).alias("_old"))
    both = both.unionByName(history.select(*keys, F.col(at).alias("_at"), F.struct(*other).alias("_old")), allowMissingColumns=True)
    cuts = both.agg(F.percentile_approx(F.col("_at").cast("timestamp").cast("double"), [k / stretches for k in range(1, stretches)], 10_000)).first()[0] or []
    bounds = F.lit(sorted(set(cuts))) if cuts else F.array().cast("array<double>")
    both = both.withColumn("_stretch", F.size(F.filter(bounds, lambda b: b < F.col("_at").cast("timestamp").cast("double"))))
    last = both.where("_old is not null").groupBy(*keys, "_stretch").agg(F.max(F.struct("_at", "_old")).alias("_end"))
    there = both.groupBy(*keys, "_stretch").agg(F.lit(1).alias("_one"))
    of_key = Window.partitionBy(*keys).orderBy("_stretch")
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in (*keys, "_stretch")]
    marks = there.alias("x").join(last.alias("y"), _all(same(there, last)), "left").select(*[there[k] for k in (*keys, "_stretch")], "_end")
    carried = marks.withColumn("_carry", F.last("_end", True).over(of_key.rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    walk = Window.partitionBy(*keys, "_stretch").orderBy("_at", F.col("_old").isNotNull(), "_old").rowsBetween(Window.unboundedPreceding, -1)
    walked = both.withColumn("_prior", F.last("_old", True).over(walk))
    done = walked.where("_row is not null")
    out = done.join(carried, _all(same(done, carried)), "left")
    return out.select("_row.*", F.coalesce("_prior", "_carry._old").alias("prior"))


def _all(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


SAME = ("edition_id", "source_id", "url", "content_hash", "processing_version", "provider", "model", "prompt_version")


def inherited(documents: DataFrame, history: DataFrame) -> DataFrame:
    """Documents with ``mode``: ``inherit`` (an equal extraction came before), ``repeat_rejection`` or ``extract``, and ``prior``.

    documents: :data:`SAME` columns, ``fetched_at, forced`` (boolean), ``last_status`` (of the source's state; null: new), ``value_changed, crossed``
    (since the last success). history: :data:`SAME`, ``fetched_at, identity, status, n_accepted, n_rejected``. Only a matched extraction
    of the same text by the same versions counts: a successful one is inherited unless something moved since, and one that was
    rejected as a whole is not bought again.
    """
    h = history.where((F.col("identity") == "matched") & F.col("status").isin("success", "unchanged", "validation_error"))
    rows = as_of(documents, h.select(*SAME, "fetched_at", F.struct("fetched_at", "status", "n_accepted", "n_rejected").alias("of")), SAME, "fetched_at")
    prior, free = F.col("prior.of"), ~F.coalesce("forced", F.lit(False)) & ~F.coalesce("crossed", F.lit(False))
    rejected = free & (F.col("last_status") == "validation_error") & (prior["status"] == "validation_error") & (prior["n_accepted"] == 0) & (prior["n_rejected"] > 0)
    good = free & ~F.coalesce("value_changed", F.lit(False)) & F.col("last_status").isin("success", "unchanged") & prior["status"].isin("success", "unchanged")
    no = lambda c: F.coalesce(c, F.lit(False))
    return rows.select(*documents.columns, F.when(no(rejected), "repeat_rejection").when(no(good), "inherit").otherwise("extract").alias("mode"), prior.alias("prior"))
