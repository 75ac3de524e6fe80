"""Benchmark scoring: choices, pluggable scorers, numeric answers, sweeps."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpuslab.functions.arrays import keep_last
from corpuslab.functions.text import (
    answers_match, cue_number, extract_number, gold_number, labels, last_number, mcq_prompt,
    strip_echo,
)
from corpuslab.operators.lookup import small, spread_join
from corpuslab.operators.metrics import accuracy_by
from corpuslab.operators.pretokens import pretokens
from corpuslab.session import staged

# A scorer takes rows (…, context, continuation) and returns them with ``score``.
Scorer = Callable[[DataFrame], DataFrame]

#: tokens counted at once on a worker, and rows of a table of words or pairs that may be sent along
RUN_TOKENS = 2**21
BROADCAST_WORDS = 1_000_000


def expand_choices(df: DataFrame, choices: str | Column, out: str = "continuation") -> DataFrame:
    """One row per choice with its index."""
    return df.select("*", F.posexplode(choices).alias("idx", out))


def fit_prompt(text: Column, n: int, split: Callable[[Column], Column] | None = None) -> Column:
    """Shorten a prompt of at least ``n - 2`` tokens from its front, keeping its answer cue.

    The part from the last ``Answer: `` stays whole. Of the rest the last
    ``n - cue - 10`` tokens stay, if that is more than 50; the cut continues to the
    next blank and is marked by ``...``. What is still too long loses its end.
    """
    once = _once if split is None else (lambda value, use: use(value))  # a user's function may not stand in a lambda
    split = split or (lambda t: pretokens(t, "byte"))
    prefix = F.regexp_extract(text, r"(?s)^(.*)Answer: .*$", 1)
    suffix = F.regexp_extract(text, r"(?s)^.*(Answer: .*)$", 1)

    def marked(suffix: Column, head: Column, room: Column) -> Column:
        cut = F.concat(F.array_join(F.slice(head, F.greatest(F.size(head) - room + 1, F.lit(1)), F.greatest(
            room, F.lit(0))), ""), suffix)
        return once(cut, lambda c: F.when(
            F.contains(c, F.lit(" ")),
            F.concat(F.lit("..."), F.substring(c, F.instr(c, " "), F.length(c))),
        ).otherwise(c))

    def fitted(suffix: Column) -> Column:
        room = F.lit(n - 10) - F.size(split(suffix))
        return F.when(suffix != "", once(room, lambda r: F.when(r > 50, once(split(prefix), lambda head: F.when(
            F.size(head) > r, marked(suffix, head, r)).otherwise(text))).otherwise(text))).otherwise(text)

    def clipped(fitted: Column) -> Column:
        return once(split(fitted), lambda kept: F.when(
            F.size(kept) > n - 2, F.array_join(F.slice(kept, 1, n - 2), "")).otherwise(fitted))

    # a text of fewer tokens is left as it is, and no text is split again for each use of its tokens
    return F.when(F.size(split(text)) >= n - 2, once(once(suffix, fitted), clipped)).otherwise(text)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where the value is worked out once a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@dataclass
class BigramScorer:
    """Add-``k`` bigram model, the scorer that needs no weights.

    ``pairs(prev, tok, n)`` are the corpus counts, ``size`` the number of distinct tokens.
    """

    pairs: DataFrame
    size: int
    k: float = 1.0
    block: int = 1024

    @staticmethod
    def train(df: DataFrame, tokens: Column, k: float = 1.0, block: int = 1024) -> BigramScorer:
        """Count adjacent tokens of every document in one pass; the counts are the model and
        are written once. A first token counts after NULL, so that the counts hold every token.

        Most pairs of a corpus are distinct, so that their number hardly falls before the
        shuffle. It gets them in sorted runs, by token: neighbours share most of their
        bytes, and the codec of the shuffle stores little more than the word that differs.
        A token lies in one written part, so that counting the distinct ones shuffles each once.
        """
        lists = df.select(tokens.alias("t")).where(F.size("t") > 0)
        kind = lists.schema["t"].dataType.elementType
        runs = lists.mapInArrow(_adjacent, StructType([
            StructField("prev", kind), StructField("tok", kind), StructField("n", LongType())]))
        counts = staged(
            runs.repartition("tok").groupBy("prev", "tok").agg(F.sum("n").alias("n")), "bigrams")
        pairs = counts.where(F.col("prev").isNotNull())
        return BigramScorer(pairs, counts.select("tok").distinct().count(), k, block)

    def table(self, needed: DataFrame) -> DataFrame:
        """``(prev, tok, logprob)`` for the distinct pairs asked for.

        The model is cut to the asked words before anything is summed or shuffled: they
        are few beside a corpus, and are sent along up to a bound.
        """
        words = small(needed.select("tok").distinct(), BROADCAST_WORDS)
        pairs = self.pairs.join(words, "tok", "left_semi").join(
            small(needed, BROADCAST_WORDS), ["prev", "tok"]).withColumnRenamed("n", "_pair")
        heads = self.heads(needed.select("prev").distinct()).withColumnRenamed("n", "_head")
        return (
            needed.join(pairs, ["prev", "tok"], "left").join(heads, ["prev"], "left")
            .select("prev", "tok", F.ln(
                (F.coalesce("_pair", F.lit(0)) + F.lit(self.k))
                / (F.coalesce("_head", F.lit(0)) + F.lit(self.k * self.size))).alias("logprob"))
        )

    def heads(self, asked: DataFrame) -> DataFrame:
        """How often each asked ``prev`` was followed by anything."""
        return self.pairs.join(small(asked, BROADCAST_WORDS), "prev", "left_semi").groupBy(
            "prev").agg(F.sum("n").alias("n"))

    def __call__(self, requests: DataFrame) -> DataFrame:
        """Rows keyed by ``item, idx`` with token arrays ``context`` and ``continuation``."""
        last = F.try_element_at(keep_last(F.col("context"), self.block - 1), F.lit(-1))
        # an empty continuation keeps one row without a token and scores the empty sum
        steps = staged(
            requests.select("item", "idx", F.explode_outer(F.arrays_zip(
                F.concat(F.array(last), F.slice("continuation", F.lit(1), F.greatest(
                    F.size("continuation") - 1, F.lit(0)))).alias("prev"),
                F.col("continuation").alias("tok"))).alias("e"))
            .select("item", "idx", "e.prev", "e.tok"), "steps")
        needed = staged(steps.select("prev", "tok").where(
            F.col("prev").isNotNull() & F.col("tok").isNotNull()).distinct(), "asked")
        known = staged(self.table(needed), "known")
        few = small(known, BROADCAST_WORDS)
        # a token without a context before it is any token
        blank = F.lit(-math.log(max(self.size, 1)))
        scored = (steps.join(few, ["prev", "tok"], "left") if few is not known
                  else spread_join(steps, known, ["prev", "tok"], ["item", "idx"], "left"))
        return scored.groupBy("item", "idx").agg(F.sum(F.when(
            F.col("tok").isNotNull(), F.coalesce("logprob", blank)).otherwise(0.0)).alias("score"))


def _adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(prev, tok, n)`` of rows with one list of tokens, counted and sorted in runs; no list is empty.

    A run holds whole lists, of ``RUN_TOKENS`` tokens together or one longer list.
    """
    for batch in batches:
        lists = batch.column(0)
        bounds, start = lists.offsets.to_numpy(), 0
        while start < len(lists):
            stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + RUN_TOKENS, "right")) - 1)
            coded = lists.values.slice(bounds[start], bounds[stop] - bounds[start]).dictionary_encode()
            order = pc.array_sort_indices(coded.dictionary)
            words = coded.dictionary.take(order)
            code = np.zeros(len(words) + 1, np.int64)  # the last place is that of a null, code 0
            code[order.to_numpy()] = np.arange(1, len(words) + 1)
            tok = code[coded.indices.fill_null(-1).to_numpy()]
            prev = np.zeros_like(tok)
            prev[1:] = tok[:-1]
            prev[bounds[start:stop] - bounds[start]] = 0
            keys, n = np.unique(tok * (len(words) + 1) + prev, return_counts=True)
            tok, prev = np.divmod(keys, len(words) + 1)
            yield pa.RecordBatch.from_arrays(
                [words.take(pa.array(c - 1, mask=c == 0)) for c in (prev, tok)] + [pa.array(n)],
                names=["prev", "tok", "n"])
            start = stop


def score_continuations(requests: DataFrame, scorer: Scorer) -> DataFrame:
    """``(item, idx, score)``: the log probability of each continuation, not length-normalised."""
    return scorer(requests).select("item", "idx", "score")


def score_labels(requests: DataFrame, scorer: Scorer) -> DataFrame:
    """Score by the first token of each label; a label without a token scores -inf."""
    first = requests.withColumn("continuation", F.slice("continuation", 1, 1))
    scored = score_continuations(first.where(F.size("continuation") > 0), scorer)
    return scored.unionByName(requests.where(F.size("continuation") == 0).select(
        "item", "idx", F.lit(float("-inf")).alias("score")))


def mcq_requests(
    items: DataFrame, item: str = "item", question: str = "question", choices: str = "choices",
    style: str = "en",
) -> DataFrame:
    """``(item, idx, context, continuation)`` texts for the letters of each item's choices."""
    letters = labels(F.col(choices), None)
    cued = mcq_prompt(F.col(question), F.col(choices), style)
    context = cued if style == "full" else F.concat(cued, F.lit(" "))
    return items.select(
        F.col(item).alias("item"), context.alias("context"), F.posexplode(letters).alias("idx", "continuation"))


def best_choices(scores: DataFrame) -> DataFrame:
    """``(item, pred)``: the best choice, first index on ties; an item whose choices all
    score -inf is skipped."""
    return scores.groupBy("item").agg(
        F.max_by("idx", F.struct("score", -F.col("idx"))).alias("pred"), F.max("score").alias("_best"),
    ).where(F.col("_best") > F.lit(float("-inf"))).drop("_best")


def evaluate_choices(
    scores: DataFrame, gold: DataFrame, key: str, gold_col: str = "gold",
) -> DataFrame:
    """Accuracy by ``key`` and overall of the best choice against ``gold(item, key, gold)``."""
    return accuracy_by(best_choices(scores).join(gold, "item"), key, "pred", gold_col)


# How each published variant reads an answer: (from gold, from completion, comparison).
VARIANTS = {
    "marked": (extract_number, extract_number, "text"),
    "last": (last_number, last_number, "text"),
    "cued": (gold_number, cue_number, "number"),
}


def numeric_rows(df: DataFrame, variant: str = "marked", prompt: str | None = None) -> DataFrame:
    """Add ``gold_answer``, ``predicted_answer`` and ``correct`` to (answer, completion).

    ``marked`` and ``last`` count every row. ``cued`` drops rows without a question,
    an answer or a gold number, and reads an unparseable completion as 0.
    """
    read_gold, read_pred, mode = VARIANTS[variant]
    said = strip_echo(F.col("completion"), F.col(prompt)) if prompt else F.col("completion")
    rows = df.withColumn("gold_answer", read_gold(F.col("answer"))).withColumn(
        "predicted_answer", read_pred(said))
    if variant == "cued":
        asked = F.col("question").isNotNull() if "question" in df.columns else F.lit(True)
        rows = rows.where(asked & F.col("gold_answer").isNotNull()).withColumn(
            "predicted_answer", F.coalesce("predicted_answer", F.lit(0.0)))
    return rows.withColumn(
        "correct", answers_match(F.col("predicted_answer"), F.col("gold_answer"), mode))


def numeric_eval(
    df: DataFrame, variant: str = "marked", keys: Sequence[str] = (), prompt: str | None = None,
) -> DataFrame:
    """``(accuracy, n)`` of numeric answers, 0.0 for no rows."""
    return numeric_rows(df, variant, prompt).groupBy(*keys).agg(
        F.coalesce(F.avg(F.col("correct").cast("int")), F.lit(0.0)).alias("accuracy"),
        F.count(F.lit(1)).alias("n"))


def sweep(
    df: DataFrame, pred: str, gold: str, keys: Sequence[str] = ("model", "language"),
    seconds: str | None = None, error: str | None = None,
) -> DataFrame:
    """Accuracy of every (model, language) in one job, in the shape of a language report."""
    bad = F.col(error).isNotNull() if error else F.lit(False)
    hit = F.when(~bad, F.coalesce((F.col(pred) == F.col(gold)).cast("int"), F.lit(0)))
    return df.groupBy(*keys).agg(
        F.coalesce(F.avg(hit), F.lit(0.0)).alias("accuracy"),
        F.count(hit).alias("total_samples"),
        (F.sum(seconds) if seconds else F.lit(None).cast("double")).alias("elapsed_time"),
        (F.max(error) if error else F.lit(None).cast("string")).alias("error"),
    )
