"""Operators over per-group weight distributions (next-token tables)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.operators.lookup import spread_join
from corpuslab.operators.prefix import running

#: exponents to a bin: a bin's sum of any number of terms stays within a double
BIN = 256.0


def top_k_ties(
    df: DataFrame, keys: Sequence[str], val: str, k: int, row_id: Sequence[str],
) -> DataFrame:
    """Rows not below the ``k``-th largest value of their group, ties kept.

    The threshold needs ``k`` rows per group, cut on the map side; a group whose
    values all tie is then filtered where it lies.
    """
    top = df.select(*keys, val).withColumn(
        "_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(val).desc()))
    ).where(F.col("_n") <= k)
    limits = top.groupBy(*keys).agg(F.min(val).alias("_limit"))
    return spread_join(df, limits, keys, row_id).where(F.col(val) >= F.col("_limit")).drop("_limit")


def _exp_totals(scaled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, _origin, _sum)``: the sum of ``exp(_z - _origin)`` of each key.

    Values are summed by bins of ``BIN`` exponents, each relative to its own bin, so that sums of parts can be
    added without a peak known beforehand; the origin is the topmost bin. Only that one and its neighbour
    matter (what lies lower is below ``exp(-BIN)`` of the sum); one of them is even and one is odd, so
    a key's state is the top bin of either kind. NaN where every value is minus infinity.
    """
    bins = scaled.withColumn("_bin", F.floor(F.col("_z") / BIN)).groupBy(*keys, "_bin").agg(
        F.sum(F.exp(F.col("_z") - F.col("_bin") * F.lit(BIN))).alias("_s"))
    tops = bins.groupBy(*keys).agg(*[
        F.max(F.when(F.pmod("_bin", F.lit(2)) == i, F.struct("_bin", "_s"))).alias(f"_top{i}")
        for i in (0, 1)])
    top = F.greatest("_top0._bin", "_top1._bin")
    parts = [F.coalesce(
        F.col(f"_top{i}._s") * F.exp((F.col(f"_top{i}._bin") - top) * F.lit(BIN)), F.lit(0.0))
        for i in (0, 1)]
    total = parts[0] + parts[1]
    return tops.select(*keys, (top * F.lit(BIN)).alias("_origin"), F.when(
        total > 0, total).otherwise(F.lit(float("nan"))).alias("_sum"))


def _shifted(
    df: DataFrame, keys: Sequence[str], logit: str, temperature: float, row_id: Sequence[str],
) -> DataFrame:
    scaled = df.withColumn("_z", F.col(logit).cast("double") / max(1e-8, temperature))
    joined = spread_join(scaled, _exp_totals(scaled, keys), keys, row_id)
    return joined.withColumn("_z", F.col("_z") - F.col("_origin")).drop("_origin")


def softmax(
    df: DataFrame, keys: Sequence[str], logit: str, row_id: Sequence[str],
    temperature: float = 1.0, out: str = "prob",
) -> DataFrame:
    """Softmax within each group, the temperature held above 1e-8.

    The sums come from one aggregate over the rows and return in one join, so no group is
    gathered.
    """
    return _shifted(df, keys, logit, temperature, row_id).withColumn(
        out, F.exp("_z") / F.col("_sum")).drop("_z", "_sum")


def log_softmax(
    df: DataFrame, keys: Sequence[str], logit: str, row_id: Sequence[str],
    temperature: float = 1.0, out: str = "logprob",
) -> DataFrame:
    return _shifted(df, keys, logit, temperature, row_id).withColumn(
        out, F.col("_z") - F.ln("_sum")).drop("_z", "_sum")


def nucleus(
    df: DataFrame, keys: Sequence[str], weight: str, p: float, tie: Sequence[str],
    out: str = "prob",
) -> DataFrame:
    """Tokens by falling weight while their running share stays within ``p``, the first
    always, renormalised. ``tie`` orders equal weights and identifies the row."""
    totals = df.groupBy(*keys).agg(F.sum(weight).alias("_total"))
    ranked = running(
        df, [F.col(weight).desc(), *tie],
        {"_cum": (F.col(weight).cast("double"), "sum"), "_n": (F.lit(1).cast("long"), "sum")}, keys,
    )
    kept = spread_join(ranked, totals, keys, tie).where(
        (F.col("_n") == 1) | (F.col("_cum") <= F.lit(p) * F.col("_total"))
    ).drop("_total", "_cum", "_n")
    sums = kept.groupBy(*keys).agg(F.sum(weight).alias("_sum"))
    return spread_join(kept, sums, keys, tie).withColumn(
        out, F.col(weight) / F.col("_sum")).drop("_sum")


def uniform(seed: int, *row_id: str | Column) -> Column:
    """A repeatable number in (0, 1) per row."""
    return (drawn_bits(seed, *row_id).cast("double") + 0.5) / F.lit(float(2**52))


def drawn_bits(seed: int, *row_id: str | Column) -> Column:
    """52 bits of the MD5 of seed and id, the same in every engine."""
    text = F.concat_ws(":", F.lit(seed).cast("string"), *[
        (F.col(c) if isinstance(c, str) else c).cast("string") for c in row_id])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def weighted_draw(
    df: DataFrame, keys: Sequence[str], weight: str, seed: int, row_id: Sequence[str],
) -> DataFrame:
    """One row per group, drawn in proportion to its weight (exponential races)."""
    race = -F.ln(uniform(seed, *row_id)) / F.col(weight)
    kept = df.where(F.col(weight) > 0)
    row = F.struct(*[c for c in df.columns if c not in keys])
    order = F.struct(race, *row_id)
    return kept.groupBy(*keys).agg(F.min_by(row, order).alias("_row")).select(*keys, "_row.*")
