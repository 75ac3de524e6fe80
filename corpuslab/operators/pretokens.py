"""Splitting text into pretokens, and counting them."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions.text import normalize_text
from corpuslab.operators.prefix import running
from corpuslab.session import fixed_table

META = "▁"

# Fixed value: the public byte-level split (contractions, letters, digits, marks, blanks).
BYTE_LEVEL = (
    r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def pretokens(text: Column, mode: str) -> Column:
    """Array of pretokens: ``byte``, ``whitespace``, ``metaspace``, ``char`` or ``none``."""
    if mode == "byte":
        return F.regexp_extract_all(text, F.lit(BYTE_LEVEL), F.lit(0))
    if mode == "whitespace":
        return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))
    if mode == "metaspace":
        marked = F.replace(text, F.lit(" "), F.lit(META))
        led = F.when(F.startswith(marked, F.lit(META)) | (marked == ""), marked).otherwise(
            F.concat(F.lit(META), marked))
        return F.regexp_extract_all(led, F.lit(f"(?s){META}[^{META}]*"), F.lit(0))
    if mode == "char":
        return F.filter(F.split(text, ""), lambda c: c != "")
    if mode == "none":
        return F.filter(F.array(text), lambda t: t != "")
    raise ValueError(f"unknown mode {mode}")


# How each kind of vocabulary prepares text: (normaliser, pretoken mode).
PREPARE = {
    "char": (None, "char"),
    "bpe": (None, "byte"),
    "wordpiece": ("bert", "whitespace"),
    "unigram": ("sequence", "metaspace"),
}


def prepared(text: Column, kind: str, mode: str | None = None) -> Column:
    style, default = PREPARE[kind]
    return pretokens(normalize_text(text, style) if style else text, mode or default)


def pretoken_counts(
    df: DataFrame, tokens: Column, keys: Sequence[str] = (),
) -> DataFrame:
    """``(word, freq)``; frequent words collapse before the shuffle."""
    return df.select(*keys, F.explode(tokens).alias("word")).groupBy(*keys, "word").agg(
        F.count(F.lit(1)).alias("freq"))


def assign_ids(tokens: DataFrame, specials: Sequence[str] = (), few: bool = False) -> DataFrame:
    """``(token, id)``: the specials first, then the distinct tokens in code-point order.

    Numbered by running counts over ranges of the order, whatever the number of tokens. Tokens that
    are ``few`` by nature, such as characters, are numbered by a plain window instead.
    """
    rest = tokens.select("token").distinct().where(~F.col("token").isin(list(specials)))
    base = len(specials)
    if few:
        numbered = rest.withColumn("_n", F.row_number().over(Window.orderBy("token")))
    else:
        numbered = running(rest, ["token"], {"_n": (F.lit(1), "sum")})
    numbered = numbered.select("token", (F.col("_n") + (base - 1)).cast("int").alias("id"))
    if not specials:
        return numbered
    fixed = fixed_table(
        tokens.sparkSession, token=(pa.string(), list(specials)),
        id=(pa.int32(), list(range(base))))
    return fixed.unionByName(numbered)
