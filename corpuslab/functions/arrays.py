"""Column functions over token and vector arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keep_last(ids: Column, n: int) -> Column:
    """The last ``n`` ids (context clip)."""
    return F.slice(ids, F.greatest(F.size(ids) - n + 1, F.lit(1)), n)


def keep_first(ids: Column, n: int) -> Column:
    return F.slice(ids, 1, n)


def xy_pair(window: Column, block: int | Column) -> Column:
    """Inputs and targets, one step apart, of a window of ``block + 1`` ids."""
    block = F.lit(block) if isinstance(block, int) else block
    return F.struct(
        F.slice(window, F.lit(1), block).alias("x"), F.slice(window, F.lit(2), block).alias("y"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda acc, x: acc + x,
    )


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(
        vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    ))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when a side has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def l2_normalize(vec: Column, eps: float = 1e-12) -> Column:
    length = F.greatest(norm(vec), F.lit(eps))
    return F.zip_with(
        vec, F.array_repeat(length, F.size(vec)), lambda x, n: x.cast("double") / n
    )


def finite(vec: Column) -> Column:
    """NaN and infinities become 0."""
    return F.transform(
        vec,
        lambda x: F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0))
        .otherwise(x),
    )


def masked_mean(vecs: Column, mask: Column, dim: int) -> Column:
    """Mean of the vectors whose mask is 1, by dimension; the divisor is at least 1e-9."""
    kept = F.aggregate(mask, F.lit(0.0), lambda acc, m: acc + m.cast("double"))
    total = F.aggregate(
        F.zip_with(vecs, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m)),
        F.array_repeat(F.lit(0.0), dim),
        lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b),
    )
    return F.zip_with(
        total, F.array_repeat(F.greatest(kept, F.lit(1e-9)), dim), lambda t, k: t / k
    )
