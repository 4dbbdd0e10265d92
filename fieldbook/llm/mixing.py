"""Mixing sources to target weights: temperature mixing realised as budgeted block permutations.

* Weights: ``w_i ~ share_i ** alpha``; ``alpha`` is bisected until the entropy of the weights meets the target, below 1 for a mix less even
  than it and above 1 for a more even one, and held where no source is repeated more than ``max_repeats`` times under the token
  budget. Each step needs two sums over the sources for each of ``STEPS`` candidate exponents: over their totals on the driver up to
  ``FEW_SOURCES``, by Spark beyond, so sources stay a table, however many there are.
* Realisation: each source is cut by hash into at most ``CELLS`` blocks. An epoch visits all blocks in an order of
  its own; a source gives whole epochs, then whole blocks, then the documents of one cut block up to its quota.
  Only block totals (at most ``CELLS`` per source) are ordered by a window, never a source's documents.

Defined results: null source is a source of its own; null, empty or blank text has zero tokens and goes with its block; a source
without tokens has weight 0 and gives no rows, but with the covering budget all its rows once; rows with equal ids (null ids too)
fall into the same block and are drawn together; a very long text counts whole; equal sources get equal weights; an empty table
gives no rows, as does one without tokens unless the budget is the covering one; other columns are kept by
:func:`mixed_documents`, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

CELLS = 4096
BLOCK_TOKENS = 200_000
TARGET_EVENNESS = 0.97
MAX_REPEATS = 3.0
STEPS = 32
#: Largest exponent that is tried.
STEEPEST = 64.0
#: Sources whose totals the driver may hold (a number each).
FEW_SOURCES = 100_000
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


class Shares:
    """Sums over sources with tokens that decide the exponent, each source's tokens taken as a share ``t`` of the largest one's.

    ``sums(alphas)`` gives ``(sum t**a, sum t**a ln t)`` of each exponent.
    """

    def __init__(self, live: int, least: int, most: int, total: int, sums: Callable[[list[float]], list[tuple[float, float]]]):
        self.live, self.least, self.most, self.total, self.sums = live, least, most, total, sums

    def entropies(self, alphas: list[float]) -> list[float]:
        """Of the weights ``t**a / z``."""
        return [math.log(z) - a * s / z for a, (z, s) in zip(alphas, self.sums(alphas))]

    def _power(self, tokens: int, alpha: float) -> float:
        """Tokens over the power of their share: ``tokens / t**alpha``."""
        return tokens * (self.most / tokens) ** alpha

    def covering(self, alphas: list[float]) -> list[float]:
        """The least budget under which every source is visited at least once; the largest source is the last up to 1, the smallest beyond."""
        return [z * max(self._power(self.most, a), self._power(self.least, a)) for a, (z, _) in zip(alphas, self.sums(alphas))]

    def repeats(self, alphas: list[float], budget: float | None) -> list[float]:
        """How often the source that is repeated most is drawn, under the covering budget if none is given."""
        budgets = self.covering(alphas) if budget is None else [budget] * len(alphas)
        return [b / (z * min(self._power(self.most, a), self._power(self.least, a))) for a, b, (z, _) in zip(alphas, budgets, self.sums(alphas))]


def smallest_alpha(ok: Callable[[list[float]], list[bool]], low: float = 0.0, high: float = 1.0) -> float:
    """Smallest exponent from ``low`` to ``high`` that is ok (``high`` if none), where all larger ones are too; ``STEPS`` are tried at once."""
    if ok([low])[0]:
        return low
    while high - low > 1e-10:
        tried = [low + (high - low) * (k + 1) / (STEPS + 1) for k in range(STEPS)]
        good = ok(tried)
        first = good.index(True) if True in good else STEPS
        low, high = ([low] + tried)[first], (tried + [high])[first]
    return high


def solve_alpha(shares: Shares, budget: float | None, evenness: float = TARGET_EVENNESS, max_repeats: float = MAX_REPEATS, sharpen: bool = True) -> float:
    """The exponent whose weights have an entropy of ``evenness`` times its maximum, as far as the repetition limit lets it.

    Entropy falls as alpha grows. A mix less even than the target is flattened (alpha below 1; small sources are repeated, which sets a
    least alpha), a more even one is sharpened (alpha above 1; large sources are repeated, which sets a largest alpha) unless ``sharpen``
    is false. Sources as large as the largest never part from it, so a target below their own entropy ends at ``STEEPEST`` (equal sources stay as they are).
    """
    if shares.live == 0:
        return 1.0
    target = evenness * math.log(shares.live)
    even = lambda alphas: [h <= target for h in shares.entropies(alphas)]
    if even([1.0])[0]:
        return max(smallest_alpha(even), smallest_alpha(lambda alphas: [r <= max_repeats for r in shares.repeats(alphas, budget)]))
    if not sharpen or shares.least == shares.most:
        return 1.0
    high = 2.0
    while high < STEEPEST and not even([high])[0]:
        high *= 2
    high = smallest_alpha(even, 1.0, high)
    return smallest_alpha(lambda alphas: [r >= max_repeats for r in shares.repeats(alphas, budget)], 1.0, high)


def shares_of(sources: DataFrame, few: int = FEW_SOURCES) -> Shares:
    """Sums over ``source, n`` rows: on the driver from their totals where sources are few, by Spark where they are many."""
    live = sources.where("n > 0")
    r = live.agg(F.count("*").alias("live"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("total")).first()
    known: dict[float, tuple[float, float]] = {}
    logs = np.sort(np.log([x[0] / r["most"] for x in live.select("n").collect()])) if 0 < r["live"] <= few else None

    def sums(alphas: list[float]) -> list[tuple[float, float]]:
        if logs is not None:
            return [(float(p.sum()), float((p * logs).sum())) for p in (np.exp(a * logs) for a in alphas)]
        share = F.log(F.col("n") / F.lit(float(r["most"])))
        new = [a for a in alphas if a not in known]
        if new:
            got = live.agg(*(F.sum(x) for a in new for x in (F.exp(F.lit(a) * share), F.exp(F.lit(a) * share) * share))).first()
            known.update(zip(new, zip(got[::2], got[1::2])))
        return [known[a] for a in alphas]

    return Shares(r["live"], r["least"] or 0, r["most"] or 0, r["total"] or 0, sums)


def _cell(id_col: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), F.lit(CELLS)).cast("int")


def _order(id_col: str, seed: int) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), F.lit(seed + 1))


def plan_mix(
    docs: DataFrame, budget: int | str | None = None, evenness: float = TARGET_EVENNESS, max_repeats: float = MAX_REPEATS,
    block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, sharpen: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(narrow, plan, sources)``.

    narrow: ``id, source, n_tokens, cell, order_key`` of every row. plan: ``source, block, epoch, block_rank, cut_key``
    (``cut_key`` null: the whole block; else rows with ``order_key <= cut_key``). sources: weights and quotas.
    budget: tokens to draw; None: as many as there are; "cover": the least with which every document is drawn.
    """
    narrow = materialize(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"),
            _cell(id_col, seed).alias("cell"), _order(id_col, seed).alias("order_key"),
        ),
        "mix",
    )
    cells = materialize(narrow.groupBy("source", "cell").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs")), "cells")
    totals = materialize(cells.groupBy("source").agg(F.sum("n_tokens").alias("n")), "totals")
    shares, cover = shares_of(totals), budget == "cover"
    alpha = solve_alpha(shares, None if cover else budget or shares.total, evenness, max_repeats, sharpen)
    tokens = (shares.covering([alpha])[0] if cover else budget or shares.total) if shares.live else 0
    mass = shares.sums([alpha])[0][0] if shares.live else 1.0
    n = F.col("n")
    sources = totals.select(
        "source", n.alias("source_tokens"), F.when(n > 0, F.exp(F.lit(alpha) * F.log(n / F.lit(float(shares.most)))) / mass).otherwise(0.0).alias("weight"),
        F.greatest(F.lit(1), F.least(F.lit(CELLS), F.floor(n / block_tokens))).cast("int").alias("n_blocks"), F.lit(alpha).alias("alpha"),
    )
    sources = sources.withColumn("quota", F.floor(F.col("weight") * float(tokens) + 0.5).cast("long"))
    # a source without tokens is one epoch of its own where all documents are wanted
    epochs = F.when(F.col("source_tokens") > 0, F.expr("quota div source_tokens")).otherwise(F.lit(int(cover)))
    sources = sources.withColumn("epochs", epochs.cast("long"))
    sources = materialize(sources.withColumn("rest", F.col("quota") - F.col("epochs") * F.col("source_tokens")), "sources")
    by_block = (
        cells.join(sources.where("quota > 0 or epochs > 0").withColumnRenamed("source", "_s"), F.expr("source <=> _s"))
        .drop("_s")
        .withColumn("block", F.floor(F.col("cell") * F.col("n_blocks") / CELLS).cast("int"))
        .groupBy("source", "block", "epochs", "rest")
        .agg(F.sum("n_tokens").alias("n_tokens"))
    )
    visits = by_block.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs").cast("int"))))
    w = Window.partitionBy("source", "epoch").orderBy(F.xxhash64("block", "epoch", F.lit(seed)), "block")
    visits = visits.withColumns({"block_rank": F.row_number().over(w), "_upto": F.sum("n_tokens").over(w)})
    before = F.col("_upto") - F.col("n_tokens")
    full = (F.col("epoch") < F.col("epochs")) | ((F.col("_upto") <= F.col("rest")) & (F.col("rest") > 0))
    visits = materialize(
        visits.where(full | ((before < F.col("rest")) & (F.col("_upto") > F.col("rest"))))
        .select("source", "block", "epoch", "block_rank", F.when(~full, F.col("rest") - before).alias("left")),
        "visits",
    )
    # the cut block of each source: documents in order of their key up to what is left of the quota
    n_blocks = sources.select(F.col("source").alias("_s"), "n_blocks")
    placed = narrow.join(n_blocks, F.expr("source <=> _s")).withColumn("block", F.floor(F.col("cell") * F.col("n_blocks") / CELLS).cast("int"))
    cut = visits.where("left is not null").select(F.col("source").alias("_cs"), F.col("block").alias("_cb"), "left")
    inside = placed.join(cut, F.expr("source <=> _cs and block = _cb")).select("source", "block", "order_key", "n_tokens", "left")
    per_key = inside.groupBy("source", "block", "left", "order_key").agg(F.sum("n_tokens").alias("n"))
    run = F.sum("n").over(Window.partitionBy("source", "block").orderBy("order_key"))
    keys = per_key.withColumn("_run", run).where("_run <= left").groupBy("source", "block").agg(F.max("order_key").alias("cut_key"))
    left = visits.alias("v").join(keys.alias("k"), F.expr("v.source <=> k.source and v.block = k.block and v.left is not null"), "left")
    plan = left.where("v.left is null or k.cut_key is not null").select("v.source", "v.block", "v.epoch", "v.block_rank", "k.cut_key")
    return narrow, materialize(plan, "plan"), sources


def _placed(rows: DataFrame, plan: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with ``cell, order_key`` and their source as ``_source``, once per epoch that draws them."""
    # sources and plan are written tables: Spark broadcasts them if their size allows it, and shuffles otherwise
    s = sources.select(F.col("source").alias("_s"), "n_blocks")
    with_block = rows.join(s, F.col("_source").eqNullSafe(F.col("_s"))).withColumn("_block", F.floor(F.col("_cell") * F.col("n_blocks") / CELLS).cast("int"))
    p = plan.select(F.col("source").alias("_ps"), F.col("block").alias("_pb"), F.col("epoch").alias("_epoch"), F.col("block_rank").alias("_block_rank"), "cut_key")
    on = F.col("_source").eqNullSafe(F.col("_ps")) & (F.col("_block") == F.col("_pb"))
    return with_block.join(p, on).where(F.col("cut_key").isNull() | (F.col("_order_key") <= F.col("cut_key")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per drawn document and epoch: ``doc_id, source, n_tokens, epoch, block, block_rank, order_key``.

    Sorting by ``epoch, block_rank, order_key`` within a source gives the realised order.
    """
    narrow, plan, sources = plan_mix(docs, **options)
    rows = narrow.select(F.col("id").alias("doc_id"), F.col("source").alias("_source"), "n_tokens", F.col("cell").alias("_cell"), F.col("order_key").alias("_order_key"))
    got = _placed(rows, plan, sources)
    return got.select("doc_id", F.col("_source").alias("source"), "n_tokens", F.col("_epoch").alias("epoch"), F.col("_block").alias("block"), F.col("_block_rank").alias("block_rank"), F.col("_order_key").alias("order_key"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """The drawn rows with all columns of ``docs``; a row drawn in several epochs comes several times."""
    _, plan, sources = plan_mix(docs, id_col=id_col, source_col=source_col, seed=seed, **options)
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("_doc")  # extra columns keep their names, whatever they are
    rows = docs.select(whole, F.col(source_col).alias("_source"), _cell(id_col, seed).alias("_cell"), _order(id_col, seed).alias("_order_key"))
    return _placed(rows, plan, sources).select("_doc.*")
