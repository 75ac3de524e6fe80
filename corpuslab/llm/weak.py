"""Weak supervision over vote columns: each vote is -1, 0 (abstain) or 1.

Rows are reduced to their vote patterns, at most 3 ** rules rows whatever the size of the
corpus; expectation-maximisation then runs as one small aggregate per iteration over
that table, with the current parameters as literals of the plan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.session import staged

VOTES = (-1, 0, 1)


@dataclass(frozen=True)
class VoteModel:
    """``prior`` of the positive class and, per rule, the log-odds its votes add."""

    rules: tuple[str, ...]
    prior: float
    positive: dict[str, tuple[float, float, float]]
    negative: dict[str, tuple[float, float, float]]

    def accuracy(self, rule: str) -> float:
        """The share of right votes among the votes a rule is expected to cast."""
        p, n = self.positive[rule], self.negative[rule]
        right = self.prior * p[2] + (1 - self.prior) * n[0]
        cast = right + self.prior * p[0] + (1 - self.prior) * n[2]
        return right / cast if cast else 0.5

    def log_odds(self) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for rule in self.rules:
            low, none, high = (
                math.log(p / n) for p, n in zip(self.positive[rule], self.negative[rule]))
            total = total + F.when(F.col(rule) < 0, low).when(F.col(rule) > 0, high).otherwise(none)
        return total

    def posterior(self) -> Column:
        """Probability of the positive class given the votes."""
        odds = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), self.log_odds()))
        return 1 / (1 + F.exp(-odds))


def patterns(votes: DataFrame, rules: Sequence[str], times: str | None = None) -> DataFrame:
    """How many rows (or how many ``times``) cast each combination of votes."""
    many = F.sum(times) if times else F.count(F.lit(1))
    return votes.groupBy(*rules).agg(many.alias("_n"))


def majority(rules: Sequence[str]) -> Column:
    """The first guess: a soft majority of the votes cast."""
    total = sum((F.col(r) for r in rules), F.lit(0))
    return 1 / (1 + F.exp(-total.cast("double")))


def fit_votes(
    votes: DataFrame, rules: Sequence[str], iterations: int = 12, smoothing: float = 1.0,
    times: str | None = None,
) -> VoteModel:
    """Estimate prior and vote probabilities of both classes by expectation-maximisation.

    It starts from the majority, so the positive class is the one that the positive votes
    name. An empty table gives the smoothed, uninformative model.
    """
    rules = tuple(rules)
    counted = staged(patterns(votes, rules, times).coalesce(1), "vote-patterns")
    share, model = majority(rules), None
    for _ in range(iterations):
        weighted = counted.select(
            *rules, (F.col("_n") * share).alias("_p"), (F.col("_n") * (1 - share)).alias("_q"))
        sums = weighted.agg(
            F.sum("_p").alias("p"), F.sum("_q").alias("q"),
            *[F.sum(F.when(F.col(r) == v, F.col(side)).otherwise(0.0)).alias(f"{side}{r}{v}")
              for r in rules for v in VOTES for side in ("_p", "_q")]).first()
        p, q = float(sums["p"] or 0), float(sums["q"] or 0)
        table = {
            side: {
                r: tuple((float(sums[f"{side}{r}{v}"] or 0) + smoothing) / (total + 3 * smoothing)
                         for v in VOTES)
                for r in rules}
            for side, total in (("_p", p), ("_q", q))}
        model = VoteModel(rules, (p + 1) / (p + q + 2), table["_p"], table["_q"])
        share = model.posterior()
    return model
