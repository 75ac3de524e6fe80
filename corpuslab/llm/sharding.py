"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Rows are numbered in the order of their id; a keyed Feistel network over ``a * b >= n``
numbers, walked again while it leaves ``0 .. n - 1``, permutes the numbers without
storing the permutation. A row's shard and slot are the remainder and the quotient of its
new place, so anyone can compute them from the row number, ``n`` and the key.

A null text counts as empty and has the checksum 0; a null id sorts first; repeated rows
get places of their own (they are alike, so which is which makes no difference); an empty
table gives no rows. Only id, size and checksum are shuffled, never the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm.common import table
from corpuslab.operators.prefix import running

ROUNDS = 6


def permute(places: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """The place of each number of ``0 .. n - 1`` after the keyed permutation."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = -(-n // a) if n else 1
    keys = _round_keys(key, rounds)
    out = _network(places.astype(np.int64), a, b, keys)
    outside = out >= n
    while outside.any():  # cycle walking
        out[outside] = _network(out[outside], a, b, keys)
        outside = out >= n
    return out


def _round_keys(key: int, rounds: int) -> list[int]:
    return [int(x) for x in np.random.Generator(np.random.PCG64(key)).integers(1, 2**62, rounds)]


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 63-bit hash of each number (multiply and fold twice)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(key)
        for _ in range(2):
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(29))) >> np.uint64(1)).astype(np.int64)


def _network(x: np.ndarray, a: int, b: int, keys: list[int]) -> np.ndarray:
    left, right = x // b, x % b
    for i, key in enumerate(keys):  # each half in turn is moved by a hash of the other
        if i % 2 == 0:
            left = (left + _mix(right, key)) % a
        else:
            right = (right + _mix(left, key)) % b
    return left * b + right


def shuffled_places(row: Column, n: int, key: int) -> Column:
    """Column form of :func:`permute`."""
    @F.pandas_udf("long")
    def places(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in rows:
            yield pd.Series(permute(batch.to_numpy(), n, key))

    return places(row)


def shard(
    rows: DataFrame, shards: int, key: int = 20_240, order: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Add ``row`` (global number in ``order``), ``shard`` and ``slot``.

    Counts of the shards differ by one at most, and slots of a shard are gapless from 0.
    Columns of these three names that ``rows`` has already are replaced.
    """
    rows = rows.drop("row", "shard", "slot")
    numbered = running(rows, list(order), {"row": (F.lit(1), "sum")})
    place = shuffled_places(F.col("row") - 1, rows.count(), key)
    return (
        numbered.withColumn("_place", place)
        .withColumn("row", F.col("row") - 1)
        .withColumn("shard", (F.col("_place") % shards).cast("int"))
        .withColumn("slot", F.expr(f"_place div {shards}"))
        .drop("_place")
    )


def op10_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal counts."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    sized = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"))
    return shard(sized, 40, order=("doc_id", "text_crc32", "size")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
