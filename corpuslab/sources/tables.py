"""Parquet corpora, benchmark splits and token shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_TOKEN = 65_535


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan of fewer pieces than cores out to all cores, for work heavy per byte.

    A table of many files or row groups is split by the scan itself and left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_corpus(spark: SparkSession, path: str, text_col: str = "text") -> DataFrame:
    """A parquet corpus with its text column named ``text``."""
    df = spread(spark.read.parquet(path))
    return df if text_col == "text" else df.withColumnRenamed(text_col, "text")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick_split(df: DataFrame, prefer: Sequence[str] = ("test", "train"), column: str = "split") -> DataFrame:
    """Rows of the first preferred split present, else of the first split by name."""
    wanted = df.where(F.col(column).isin(list(prefer))).select(column).distinct().collect()
    present = {r[0] for r in wanted}
    chosen = next((s for s in prefer if s in present), None)
    if chosen is None:
        chosen = df.agg(F.min(column)).first()[0]
    return df.where(F.col(column) == F.lit(chosen))


def read_split(
    spark: SparkSession, base: str, prefer: Sequence[str] = ("test", "train"), column: str = "split",
) -> DataFrame:
    """One split of a parquet benchmark laid out by ``column``; other splits are not read."""
    return pick_split(spark.read.parquet(base), prefer, column)


def list_subsets(df: DataFrame, column: str = "subject") -> DataFrame:
    """The subjects present."""
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def write_corpus(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_tokens(
    df: DataFrame, path: str, name: str = "", lang: str = "", mode: str = "errorifexists",
) -> str:
    """Write ``(doc_id, split, start, tokens)`` shards below ``{path}/{name}_{lang}``.

    Ids must fit sixteen bits; an id outside fails the write.
    """
    target = f"{path}/{name}_{lang}" if name else path
    each = F.transform("tokens", lambda t: F.when(
        t.between(0, MAX_TOKEN), t.cast("int")
    ).otherwise(F.raise_error(F.concat(F.lit("token id out of range: "), t.cast("string"))).cast("int")))
    # whole lists are compared in compiled loops; only a list that fails is taken token by token
    inside = (F.coalesce(F.array_min("tokens") >= 0, F.lit(True))
              & F.coalesce(F.array_max("tokens") <= MAX_TOKEN, F.lit(True))
              & F.coalesce(~F.array_contains("tokens", -1), F.lit(False)))  # null if a token is null
    checked = df.withColumn("tokens", F.when(inside, F.col("tokens").cast("array<int>")).otherwise(each))
    checked.write.mode(mode).partitionBy("split").parquet(target)
    return target


def read_tokens(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)
