"""Multiple-choice evaluation from items to a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.text import parse_gold
from corpuslab.operators.corpus import coalesce_columns, validate
from corpuslab.operators.pretokens import pretokens
from corpuslab.operators.scoring import (
    BigramScorer, evaluate_choices, mcq_requests, score_continuations,
)


def loose_items(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items of any column naming to ``(…, question, choices, gold)``; bad rows counted."""
    named = df
    for names, out in (
        (("question", "soru", "text"), "question"),
        (("choices", "secenekler", "options"), "choices"),
        (("answer", "cevap"), "answer"),
    ):
        named = coalesce_columns(named, names, out)
    parsed = named.withColumn("gold", parse_gold(F.col("answer")))
    return validate(parsed, [
        ("gold not parseable", F.col("gold").isNull()),
        ("gold out of range", (F.col("gold") < 0) | (F.col("gold") >= F.size("choices"))),
    ])


def tokenised(requests: DataFrame, mode: str = "byte") -> DataFrame:
    """Requests with token arrays in place of texts."""
    return requests.withColumn("context", pretokens(F.col("context"), mode)).withColumn(
        "continuation", pretokens(F.col("continuation"), mode))


def evaluate_mcq(
    items: DataFrame, corpus: DataFrame, key: str = "subject", style: str = "en",
    mode: str = "whitespace",
) -> DataFrame:
    """Accuracy by ``key`` of a bigram model trained on ``corpus(text)``."""
    scorer = BigramScorer.train(corpus, pretokens(F.col("text"), mode))
    scores = score_continuations(tokenised(mcq_requests(items, style=style), mode), scorer)
    return evaluate_choices(scores, items.select("item", key, "gold"), key)
