"""Corpus to token shards, and the corpus report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.corpus import char_budget, max_chars
from corpuslab.operators.encode import encode_corpus
from corpuslab.operators.tokens import split_tokens
from corpuslab.operators.vocab import Vocabulary


def training_corpus(
    documents: DataFrame, limit: int, longest: int = 1000, order: str = "doc_id",
) -> DataFrame:
    """Documents in id order up to ``limit`` characters, then those not over ``longest``.

    The budget counts before the length filter: a long document still spends it.
    """
    return max_chars(char_budget(documents, order, limit), longest)


def corpus_report(corpus: DataFrame, key: str = "lang") -> DataFrame:
    """Documents, characters and distinct characters per ``key`` in one pass.

    A document emits one row with its counts and one per distinct character; both
    collapse to at most one row per key and character before the shuffle.
    """
    totals = F.struct(F.lit("").alias("ch"), F.lit(1).alias("docs"), F.length("text").alias("chars"))
    chars = F.transform(
        F.filter(F.array_distinct(F.split("text", "")), lambda c: c != ""),
        lambda c: F.struct(c.alias("ch"), F.lit(0).alias("docs"), F.lit(0).alias("chars")))
    return (
        corpus.select(key, F.explode(F.concat(F.array(totals), chars)).alias("e"))
        .groupBy(key, "e.ch").agg(F.sum("e.docs").alias("docs"), F.sum("e.chars").alias("chars"))
        .groupBy(key).agg(
            F.sum("docs").alias("docs"), F.sum("chars").alias("chars"),
            F.count_if(F.col("ch") != "").alias("distinct_chars"))
    )


def token_shards(
    corpus: DataFrame, vocab: Vocabulary, order: str = "doc_id", frac: float = 0.9,
) -> DataFrame:
    """Encode a corpus and cut its token stream into train and validation rows."""
    return split_tokens(encode_corpus(corpus, vocab, order), order, frac)
