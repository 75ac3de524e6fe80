"""Ordered running values that never gather an ordered group in one task.

A plain ``sum() OVER (PARTITION BY k ORDER BY o)`` sends all rows of ``k`` to one
task, and with no key all rows of the table. Both helpers below work on ranges of
the order instead, so a key that holds a third of the table is still split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.session import shared_dir

FANOUT = 4096


def locate(df: DataFrame, order: str, size: Column, target: int) -> tuple[int, int] | None:
    """Find the row whose running total of ``size`` first reaches ``target``.

    ``order`` is a unique integer column. Returns ``(order value, total before it)``
    or None if the whole table stays below the target. The bounds read the id column
    alone. Each pass histograms one range into at most ``FANOUT`` cells (map-side sums,
    at most ``FANOUT`` rows to the driver) and descends into the cell that crosses, so
    the sizes are read whole once and the second pass scans 1/4096 of the id range, as
    a filter the parquet reader can use.
    """
    sized = df.select(F.col(order).cast("long").alias("o"), size.cast("long").alias("s"))
    low, high = sized.agg(F.min("o"), F.max("o")).first()
    if low is None:
        return None
    before = 0
    while True:
        width = (high - low) // FANOUT + 1
        cells = (
            sized.where(F.col("o").between(low, high))
            .groupBy(_cell(low, width).alias("cell"))
            .agg(F.sum("s").alias("s"))
            .collect()
        )
        for cell, cell_total in sorted((r["cell"], r["s"]) for r in cells):
            if before + cell_total >= target:
                low = low + cell * width
                high = min(high, low + width - 1)
                break
            before += cell_total
        else:
            return None
        if low == high:
            return low, before


def _cell(low: int, width: int) -> Column:
    """The cell of id ``o``; in decimals, as ids may lie further apart than a bigint holds."""
    away = F.col("o").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")
    return F.floor(away / F.lit(width).cast("decimal(20,0)")).cast("long")


def range_blocks(df: DataFrame, sort: Sequence[Column | str]) -> DataFrame:
    """Number contiguous, size-balanced ranges of ``sort`` as ``_block``.

    The range exchange samples its bounds, so the numbering is fixed by a reliable
    checkpoint before two branches of a plan use it.
    """
    shared_dir(df.sparkSession)
    return (
        df.repartitionByRange(*sort)
        .withColumn("_block", F.spark_partition_id())
        .checkpoint()
    )


_COMBINE = {
    "sum": lambda a, b: a + b,
    "min": F.least,
    "max": F.greatest,
}
_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def running(
    df: DataFrame,
    order: Sequence[Column | str],
    values: dict[str, tuple[Column, str]],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Add inclusive running ``sum``/``min``/``max`` columns per key, in ``order``.

    ``values`` maps an output name to (column, aggregate); ``order`` must be total
    within a key. Rows are range-split on (keys, order); a sorted range is entered by
    at most one key that began earlier, so the carried table has fewer rows than there
    are blocks and is safe to broadcast. Rows then meet their own block only.
    """
    keys = list(keys)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    staged = df.select(
        "*", *[column.alias(f"_in_{name}") for name, (column, _) in values.items()]
    )
    blocks = range_blocks(staged, [*keys, *order])
    totals = blocks.groupBy(*keys, "_block").agg(
        *[_AGG[kind](f"_in_{name}").alias(f"_t_{name}") for name, (_, kind) in values.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_block").alias("_carry_block"),
        F.row_number().over(Window.partitionBy(*keys).orderBy("_block")).alias("_nth"),
        *[_AGG[kind](f"_t_{name}").over(earlier).alias(f"_c_{name}")
          for name, (_, kind) in values.items()],
    ).where(F.col("_nth") > 1)
    match = F.col("_block") == F.col("_carry_block")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    within = (
        Window.partitionBy("_block", *keys).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    local = blocks.select(
        "*",
        *[_AGG[kind](f"_in_{name}").over(within).alias(f"_l_{name}")
          for name, (_, kind) in values.items()],
    )
    joined = local.join(F.broadcast(carried), match, "left")
    out = []
    for name, (_, kind) in values.items():
        here, carry = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        out.append(
            F.when(carry.isNull(), here)
            .when(here.isNull(), carry)
            .otherwise(_COMBINE[kind](carry, here))
            .alias(name)
        )
    return joined.select(*df.columns, *out)
