"""Quality rules: hashed n-gram log-likelihood ratio between trusted-target and raw-corpus multinomials.

Main path: DataFrame functions only. Each document is judged inside its own row, so no text is shuffled.

* Raw multinomial: hashed unigrams and bigrams of *all* documents, one partial aggregate per task.
* Target multinomial: the same over at most ``max_trusted`` trusted documents (quality 1, not toxic), the
  ones with the smallest hashed id; the bound keeps the broadcast of their ids small.
* Verdict: mean log2 ratio per n-gram below ``threshold`` rejects; no sampling, no randomness.

Defined results: a null, empty or blank text has zero words and fails the base rule; equal texts get equal verdicts, whatever their
ids; repeated rows and rows with a null id are judged like others; a score equal to the threshold is kept; a very long text is
judged whole, in its own row; labels with a null id, and ids labelled more than once, count once or not at all (null); without
trusted documents both multinomials coincide (ratio 0); an empty table gives no rows; other columns stay, but :func:`judge` replaces
those that have the name of a column it adds, while :func:`keep` returns all as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import words

BUCKETS = 1 << 15
THRESHOLD = -0.25
MAX_TRUSTED = 20_000
SMOOTHING = 1.0
SYMBOLS = r"[#*$%&|<>]"


def _hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(F.lower(x)))


def _bucket(h: Column, buckets: int) -> Column:
    return h.bitwiseAND(F.lit(buckets - 1))


def _pairs(h: Column) -> Column:
    """Hashes of the neighbours in an array of word hashes."""
    n = F.greatest(F.lit(0), F.size(h) - 1)
    return F.zip_with(F.slice(h, 1, n), F.slice(h, 2, n), lambda a, b: F.xxhash64(a, b))


def _met_again(s: Column) -> Column:
    """Positions in a sorted array of ``(h, i)`` whose hash occurs more than once, by comparing neighbours."""
    return F.transform(F.filter(s, lambda x, k: (F.get(s, k + 1)["h"] == x["h"]) | (F.get(s, k - 1)["h"] == x["h"])), lambda x: x["i"])


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)``: how often each hashed n-gram bucket occurs in all rows."""
    h = docs.select(_hashes(words(text_col)).alias("_h"))
    # an inner explode would be given a filter on the array's size, which works the array out once more
    word = h.select("_h", F.posexplode_outer("_h").alias("_i", "_a")).where(F.col("_a").isNotNull()).select("_a", F.get("_h", F.col("_i") + 1).alias("_b"))
    pair = F.when(F.col("_b").isNotNull(), _bucket(F.xxhash64("_a", "_b"), buckets))
    grams = word.select(F.explode(F.array(_bucket(F.col("_a"), buckets), pair).cast("array<int>")).alias("bucket")).where(F.col("bucket").isNotNull())
    return grams.groupBy("bucket").agg(F.count("*").alias("n"))


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """At most ``max_trusted`` ids labelled good and not toxic, by hashed id: a bounded table."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col(id_col).isNotNull())
    good = good.select(F.col(id_col)).distinct()
    return good.orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(max_trusted)


def weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row, ``w array<float>``: log2 of target over raw probability for each bucket.

    ``trusted`` must be bounded (see :func:`trusted_ids`); it is broadcast.
    """
    mine = docs.select(F.col(id_col), F.col(text_col)).join(F.broadcast(trusted), id_col, "left_semi")
    counts = (
        bucket_counts(docs, text_col, buckets)
        .select("bucket", F.col("n").alias("raw"), F.lit(0).cast("long").alias("target"))
        .unionByName(bucket_counts(mine, text_col, buckets).select("bucket", F.lit(0).cast("long").alias("raw"), F.col("n").alias("target")))
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    )
    # bounded by the number of buckets, whatever the corpus
    every = docs.sparkSession.range(0, buckets, 1, 1).select(F.col("id").cast("int").alias("bucket"))
    rows = every.join(counts, "bucket", "left").na.fill(0, ["raw", "target"])
    packed = rows.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("c"), F.sum("raw").alias("nr"), F.sum("target").alias("nt"))
    # the target is smoothed by the raw multinomial: a bucket that it lacks has the ratio of the smoothing's share, however
    # large it is in the corpus, and with few trusted documents every ratio is near 0
    mass = SMOOTHING * buckets
    raw = lambda x: (x["raw"] + SMOOTHING) / (F.col("nr") + mass)
    return packed.select(
        F.transform(
            "c", lambda x: F.when(F.col("nt") == 0, F.lit(0.0)).otherwise(F.log2((x["target"] + mass * raw(x)) / (F.col("nt") + mass)) - F.log2(raw(x))).cast("float")
        ).alias("w")
    )


def judge(docs: DataFrame, weight_row: DataFrame, text_col: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """Adds to every row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept.

    Added columns replace columns of the same name. They name the row number so that the optimizer doesn't push a
    later filter on them below the steps of the verdict, which would repeat every step's expression in the next.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    has_word = r"[^\x20\x09-\x0D]"
    step = docs.withColumns({"_words": words(text_col)})
    step = step.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "_lines": F.array_remove(F.split(text, "\n", -1), ""),
            "_lower": _hashes(F.col("_words")),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        }
    )
    with_word = lambda lines: F.size(F.filter(lines, lambda x: x.rlike(has_word)))
    once = F.array_distinct("_lines")
    again = F.when(F.size("_lines") > F.size(once), with_word("_lines") - with_word(once)).otherwise(0)
    step = step.withColumns({"n_dup_lines": again.cast("long"), "_pairs": _pairs(F.col("_lower"))}).drop("_lines")
    # equal windows have equal first and last pairs in lower case; only windows that agree in these with another are compared whole
    n = F.greatest(F.lit(0), F.size("_words") - 4)
    ends = F.zip_with(F.slice("_pairs", 1, n), F.slice("_pairs", 4, n), lambda a, b: a.bitwiseXOR(b))
    step = step.withColumns({"_ends": ends, "_grams": F.concat("_lower", "_pairs")}).drop("_lower", "_pairs")
    entry = lambda h, i: F.struct(h.alias("h"), i.alias("i"))
    alike = F.size("_ends") > F.size(F.array_distinct("_ends"))
    step = step.withColumn("_sorted", F.when(alike, F.sort_array(F.transform("_ends", entry)))).drop("_ends")
    step = step.withColumn("_at", _met_again(F.col("_sorted"))).drop("_sorted")
    w = F.col("_words")
    step = step.withColumn("_sorted", F.sort_array(F.transform("_at", lambda i: entry(F.xxhash64(F.slice(w, i + 1, 5)), i)))).drop("_at", "_words")
    step = step.withColumn("_starts", F.sort_array(_met_again(F.col("_sorted")))).drop("_sorted")
    p = F.col("_starts")
    covered = F.aggregate(
        F.transform(p, lambda x, i: F.when(i == 0, F.lit(5)).otherwise(F.least(F.lit(5), x - F.get(p, i - 1)))), F.lit(0), lambda a, x: a + x
    )
    w = weight_row.select(F.col("w").cast("array<double>")).scalar()
    step = step.withColumns({"n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"), "_w": w}).drop("_starts")
    wc = F.col("_w")
    step = step.withColumn(
        "llr",
        F.when(F.size("_grams") == 0, F.lit(0.0)).otherwise(
            F.aggregate("_grams", F.lit(0.0), lambda a, g: a + wc[_bucket(g, buckets)]) / F.size("_grams")
        ),
    ).drop("_grams", "_w")
    step = step.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    step = step.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(threshold)))
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept"]
    step = step.withColumn("_row", F.monotonically_increasing_id())
    return step.withColumns({c: F.when(F.col("_row") >= 0, F.col(c)) for c in added}).drop("_row")


def keep(docs: DataFrame, weight_row: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`judge` keeps."""
    text_col = options.pop("text_col", "text")
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), F.col(text_col).alias("text"))
    return judge(packed, weight_row, **options).where("kept").select("_doc.*")
