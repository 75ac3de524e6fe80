"""Corpus assembly: projection, limits, validity, character budget, union."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions.text import code_text, qa_text
from corpuslab.operators.prefix import locate


def texts(df: DataFrame, column: str | Column = "text") -> DataFrame:
    """Only the text, from a column name or any expression that builds it."""
    return df.select((F.col(column) if isinstance(column, str) else column).alias("text"))


def coalesce_columns(df: DataFrame, names: Sequence[str], out: str) -> DataFrame:
    """The first of ``names`` that the row has; rows that have none are dropped."""
    present = [F.col(n) for n in names if n in df.columns]
    value = F.coalesce(*present) if present else F.lit(None).cast("string")
    return df.withColumn(out, value).where(F.col(out).isNotNull())


def max_chars(df: DataFrame, n: int = 1000, column: str = "text") -> DataFrame:
    return df.where(F.length(column) <= n)


def head(df: DataFrame, n: int, order: Sequence[str | Column]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def head_per_group(
    df: DataFrame, keys: Sequence[str], n: int, order: Sequence[str | Column],
) -> DataFrame:
    """First ``n`` rows per group; every task keeps ``n`` per group before the shuffle."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_n") <= n).drop("_n")


def only_in(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(F.col(column).isin(list(values)))


def with_reason(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Name the first rule a row breaks as ``reason``; NULL for a good row.

    A rule is (name, condition that makes the row bad). A condition that is NULL
    could not be evaluated, which isolates the row as bad too.
    """
    reason = F.lit(None).cast("string")
    for name, bad in reversed(list(rules)):
        reason = F.when(F.coalesce(bad, F.lit(True)), F.lit(name)).otherwise(reason)
    return df.withColumn("reason", reason)


def validate(
    df: DataFrame, rules: Sequence[tuple[str, Column]],
) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the count of skipped rows per reason."""
    marked = with_reason(df, rules)
    skipped = marked.where(F.col("reason").isNotNull()).groupBy("reason").agg(
        F.count(F.lit(1)).alias("skipped"))
    return marked.where(F.col("reason").isNull()).drop("reason"), skipped


def char_budget(
    df: DataFrame, order: str, limit: int, column: str = "text", size: Column | None = None,
) -> DataFrame:
    """Rows in ``order`` until ``limit`` characters are reached, the last one cut to fit.

    ``order`` is a unique integer id. Only one row straddles the limit, so it is
    located first; the rest is a range filter on the id that reaches the scan and moves
    no text. ``size`` may name a stored length in place of counting characters.
    """
    if limit <= 0:
        return df.where(F.lit(False))
    found = locate(df, order, F.length(column) if size is None else size, limit)
    if found is None:
        return df
    last, before = found
    return df.where(F.col(order) <= last).withColumn(
        column,
        F.when(F.col(order) == last, F.substring(column, 1, min(limit - before, 2**31 - 1)))
        .otherwise(F.col(column)),
    )


def union_corpora(
    corpus: DataFrame, qa: DataFrame | None = None, code: DataFrame | None = None,
    limit: int = 1000,
) -> DataFrame:
    """``(source, text)`` of the corpus and, if given, question and code tables, each
    held to ``limit`` characters. A table with a ``split`` column counts by its train rows."""
    parts = []
    for source, df, build in (
        ("corpus", corpus, lambda d: F.col("text")), ("qa", qa, qa_text), ("code", code, code_text),
    ):
        if df is None:
            continue
        if source != "corpus" and "split" in df.columns:
            df = df.where(F.col("split") == "train")
        parts.append(max_chars(df.select(F.lit(source).alias("source"), build(df).alias("text")), limit))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def char_counts(df: DataFrame, keys: Sequence[str] = (), column: str = "text") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.length(column)), F.lit(0)).alias("chars")
    )


def charset(df: DataFrame, keys: Sequence[str] = (), column: str = "text") -> DataFrame:
    """Distinct characters; a text contributes each of its characters once before the shuffle."""
    return df.select(
        *keys, F.explode(F.array_distinct(F.split(column, ""))).alias("ch")
    ).where(F.col("ch") != "").distinct()
