"""Loss and perplexity of a scorer on windows sampled from a token stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.metrics import mean_loss, running_mean
from corpuslab.operators.scoring import Scorer, score_continuations
from corpuslab.operators.tokens import sample_windows
from corpuslab.session import staged


def window_losses(
    stream: DataFrame, scorer: Scorer, n: int, block: int, seed: int = 1337,
    splits: tuple[str, ...] = ("train", "val"),
) -> DataFrame:
    """``(split, sample, loss)``: mean loss per token of ``n`` windows of each split.

    ``stream`` is ``(split, start, tokens)`` with ``start`` counted within the split. Only the
    windows drawn are scored; each is one request whose context is its first token. The stream
    is written once, since every split is measured and searched and it may be a join.
    """
    stream, parts = staged(stream.select("split", "start", "tokens"), "stream"), None
    for split in splits:
        drawn = sample_windows(stream.where(F.col("split") == split), n, block, seed)
        requests = drawn.select(
            F.col("sample").alias("item"), F.lit(0).alias("idx"),
            F.slice("x", 1, 1).alias("context"), F.col("y").alias("continuation"))
        losses = score_continuations(requests, scorer).select(
            F.lit(split).alias("split"), F.col("item").alias("sample"),
            (-F.col("score") / block).alias("loss"))
        parts = losses if parts is None else parts.unionByName(losses)
    return parts


def evaluate_loss(
    stream: DataFrame, scorer: Scorer, n: int, block: int, seed: int = 1337,
    splits: tuple[str, ...] = ("train", "val"), every: int = 0,
) -> tuple[DataFrame, DataFrame | None]:
    """``(split, loss, batches, perplexity)``, and the running mean every ``every`` windows."""
    losses = window_losses(stream, scorer, n, block, seed, splits)
    summary = mean_loss(losses, ["split"]).withColumn("perplexity", F.exp("loss"))
    return summary, running_mean(losses, ["split"], ["sample"], "loss", every) if every else None
