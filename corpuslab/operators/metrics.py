"""Accuracy, loss and series metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions.text import lang_head
from corpuslab.operators.lookup import spread_join, with_family
from corpuslab.operators.prefix import running


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _hit(pred: str | Column, gold: str | Column) -> Column:
    return F.coalesce((_col(pred) == _col(gold)).cast("int"), F.lit(0))


def accuracy(df: DataFrame, pred: str | Column, gold: str | Column) -> DataFrame:
    """One row ``(accuracy, n)``; accuracy 0.0 for no rows."""
    return df.agg(
        F.coalesce(F.avg(_hit(pred, gold)), F.lit(0.0)).alias("accuracy"),
        F.count(F.lit(1)).alias("n"),
    )


def accuracy_by(df: DataFrame, key: str, pred: str | Column, gold: str | Column) -> DataFrame:
    """``(key, accuracy, n)`` per group plus overall (key NULL), overall from the counts.

    Groups are counted first and the rollup works on the counts, so no input row is
    expanded. Rows without a key count overall only.
    """
    groups = df.groupBy(key).agg(
        F.sum(_hit(pred, gold)).alias("correct"), F.count(F.lit(1)).alias("n")
    )
    # an empty input still has an overall row
    none = df.sparkSession.range(1).select(
        F.lit(None).cast(df.schema[key].dataType).alias(key),
        F.lit(0).cast("long").alias("correct"), F.lit(0).cast("long").alias("n"))
    out = groups.unionByName(none).rollup(key).agg(
        F.sum("correct").alias("correct"), F.sum("n").alias("n"), F.grouping(key).alias("_all")
    ).where((F.col("_all") == 1) | F.col(key).isNotNull())
    return out.select(
        key, F.coalesce(F.try_divide("correct", "n"), F.lit(0.0)).alias("accuracy"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def macro_mean(
    df: DataFrame, keys: Sequence[str], val: str = "accuracy", error: str = "error",
    samples: str = "total_samples", strict_parity: bool = False,
) -> DataFrame:
    """Mean over languages, rows with an error left out.

    A language that failed to load reports zero samples and no error; it is left out
    as well unless ``strict_parity`` asks for the published arithmetic.
    """
    good = df.where(F.col(error).isNull())
    if not strict_parity:
        good = good.where(F.col(samples) > 0)
    return good.groupBy(*keys).agg(
        F.avg(val).alias(f"avg_{val}"), F.count(F.lit(1)).alias("languages")
    )


def family_scores(scores: DataFrame, families: DataFrame) -> DataFrame:
    """Mean score per (model, family) of rows ``(model, lang, score)``."""
    headed = scores.withColumn("lang", lang_head(F.col("lang")))
    return with_family(headed, families).groupBy("model", "family").agg(
        F.avg("score").alias("score"))


def language_scores(scores: DataFrame) -> DataFrame:
    """Mean score per (model, language head)."""
    return scores.groupBy("model", lang_head(F.col("lang")).alias("lang")).agg(
        F.avg("score").alias("score"))


def pass_at_1(df: DataFrame, keys: Sequence[str] = (), passed: str = "pass") -> DataFrame:
    """Share of tasks passed; the detail rows are ``df`` itself."""
    return df.groupBy(*keys).agg(
        F.coalesce(F.avg(F.coalesce(F.col(passed).cast("int"), F.lit(0))), F.lit(0.0)).alias("pass_at_1"),
        F.count(F.lit(1)).alias("n"),
    )


def mean_loss(df: DataFrame, keys: Sequence[str], loss: str = "loss") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(loss).alias("loss"), F.count(F.lit(1)).alias("batches"))


def token_nll(df: DataFrame, target: str = "target", ignore: int = -1) -> DataFrame:
    """Rows that count towards a loss: targets equal to ``ignore`` are skipped."""
    return df.where(F.col(target) != ignore)


def perplexity(
    df: DataFrame, nll: str | Column, n_tokens: str | Column, keys: Sequence[str] = (),
) -> DataFrame:
    """Average loss per token and its exponential."""
    return df.groupBy(*keys).agg(
        F.try_divide(F.sum(_col(nll)), F.sum(_col(n_tokens))).alias("avg_loss")
    ).withColumn("perplexity", F.exp("avg_loss"))


def throughput(
    df: DataFrame, keys: Sequence[str] = (), tokens: str = "tokens", seconds: str = "seconds",
) -> DataFrame:
    """Tokens per second, seconds held above 1e-9."""
    return df.groupBy(*keys).agg(
        F.sum(tokens).alias("tokens"), F.sum(seconds).alias("seconds")
    ).withColumn("tok_per_sec", F.col("tokens") / F.greatest("seconds", F.lit(1e-9)))


def argmax_choice(
    df: DataFrame, item: Sequence[str], idx: str = "idx", score: str = "score",
) -> DataFrame:
    """The best choice per item, the first index on ties, NaN above all as in numpy."""
    return df.groupBy(*item).agg(
        F.max_by(idx, F.struct(F.col(score), -F.col(idx))).alias("pred")
    )


def last_per_key(df: DataFrame, key: Sequence[str], order: Column, val: str) -> DataFrame:
    return df.groupBy(*key).agg(F.max_by(val, order).alias(val))


def running_mean(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], val: str,
    every: int = 10, first: int = 0, last: bool = True,
) -> DataFrame:
    """Running mean per key, kept at every ``every``-th row, the first ``first`` rows and
    (``last``) the final one."""
    run = running(
        df, order, {"_sum": (F.col(val).cast("double"), "sum"), "_n": (F.lit(1).cast("long"), "sum")}, keys
    ).withColumn("running_mean", F.col("_sum") / F.col("_n"))
    keep = (F.col("_n") % every == 0) | (F.col("_n") <= first)
    if last:
        if keys:
            ends = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
            run = spread_join(run, ends, keys, order)
        else:
            run = run.withColumn("_total", F.lit(df.count()))
        keep = keep | (F.col("_n") == F.col("_total"))
    return run.where(keep).withColumnRenamed("_n", "n").drop("_sum", "_total")


def running_skips(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bad: Column, every: int = 100,
) -> DataFrame:
    """Progress rows: at every ``every``-th row from the first, the rows ``done`` and
    ``skipped`` before it."""
    one = bad.cast("long")
    run = running(
        df.withColumn("_bad", one), order,
        {"_s": (F.col("_bad"), "sum"), "_n": (F.lit(1).cast("long"), "sum")}, keys)
    return run.where((F.col("_n") - 1) % every == 0).select(
        *df.columns, (F.col("_n") - 1).alias("done"), (F.col("_s") - F.col("_bad")).alias("skipped"))


def ema(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], val: str, a: float = 0.1,
    out: str = "ema",
) -> DataFrame:
    """``(1-a)*previous + a*x`` per key, seeded with the first value.

    A row is the affine map ``y -> (1-a)*y + w``; maps compose, so a long series is cut into
    chunks whose carries are a shorter series of the same kind (:func:`recurrence`).
    """
    keys = list(keys)
    numbered = running(df, order, {"_n": (F.lit(1).cast("long"), "sum")}, keys)
    weighed = numbered.withColumn("_n", F.col("_n") - 1).withColumn(
        "_w", F.when(F.col("_n") == 0, F.col(val).cast("double")).otherwise(
            F.col(val).cast("double") * a))
    return recurrence(weighed, keys, 1.0 - a).select(
        *df.columns, F.col("_y").alias(out))


LONGEST_CHUNK = 100_000


def recurrence(df: DataFrame, keys: Sequence[str], keep: float) -> DataFrame:
    """Add ``_y``: ``_y[n] = keep * _y[n - 1] + _w[n]`` per key, from ``_n`` = 0 on.

    A chunk is as long as ``keep`` stays far above the smallest doubles. Within it, weights
    are scaled down to its first row and summed. The last value of a chunk depends on the
    one before by the same recurrence, with ``keep`` to the power of the length, so the carries
    are found by this function; each level is shorter by the length of a chunk.
    """
    keys = list(keys)
    if keep <= 0.0:
        return df.withColumn("_y", F.col("_w"))
    far = -math.log(keep) if keep < 1.0 else 0.0
    if keep < 1e-30:  # a value fades below the smallest double within a few rows
        reach = int(650 * math.log(10) / far) + 1
        sent = df.select(*keys, "_n", F.explode(F.array(*[
            F.struct((F.col("_n") + d).alias("_at"), (F.col("_w") * keep**d).alias("_v"))
            for d in range(reach + 1)])).alias("_s"))
        sums = sent.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_s._at").alias(
            "_at")).agg(F.sum("_s._v").alias("_y"))
        match = F.col("_n") == F.col("_at")
        for k in keys:
            match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        return df.join(sums, match).select(*df.columns, "_y")
    span = min(LONGEST_CHUNK, max(2, int(60 * math.log(10) / far))) if far else LONGEST_CHUNK
    placed = df.withColumn("_chunk", F.expr(f"_n div {span}")).withColumn(
        "_i", (F.col("_n") % span).cast("double"))
    within = Window.partitionBy(*keys, "_chunk").orderBy("_i").rowsBetween(
        Window.unboundedPreceding, 0)
    power = lambda n: F.pow(F.lit(keep), n)
    scaled = F.sum(F.col("_w") * power(F.lit(float(span)) - F.col("_i"))).over(within)
    local = placed.withColumn("_y", scaled * power(F.col("_i") - F.lit(float(span))))
    if (df.agg(F.max("_n")).first()[0] or 0) < span:
        return local.drop("_chunk", "_i")
    ends = placed.groupBy(*keys, "_chunk").agg(
        F.sum(F.col("_w") * power(F.lit(float(span - 1)) - F.col("_i"))).alias("_w"))
    carries = recurrence(
        ends.withColumnRenamed("_chunk", "_n"), keys, keep**span).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], (F.col("_n") + 1).alias("_after"),
        F.col("_y").alias("_carry"))
    match = F.col("_chunk") == F.col("_after")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return local.join(carries, match, "left").withColumn(
        "_y", F.col("_y") + F.coalesce("_carry", F.lit(0.0)) * power(F.col("_i") + 1)
    ).select(*df.columns, "_y")


def running_best(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], val: str, out: str = "best",
) -> DataFrame:
    """The smallest value so far per key."""
    return running(df, order, {out: (F.col(val), "min")}, keys)


def sort_by(df: DataFrame, *key: str) -> DataFrame:
    return df.orderBy(*key)


def first_details(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(n)


def sorted_axis(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)
