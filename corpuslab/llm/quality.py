"""Document quality by weak supervision, in DataFrame functions only.

Rules look at whole texts and vote good (1), bad (-1) or abstain (0). Expectation-
maximisation (``weak``) learns how far each can be trusted, and the posterior
probability of "good" takes the place of an all-must-pass filter.

A null text is an empty one: no words, counts of 0, base rules failed. Repeated rows are
judged alike, an empty table gives no rows, and a text is never cut: all its words count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm.common import table, words
from corpuslab.llm.weak import VoteModel, fit_votes
from corpuslab.session import staged

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_letters", "n_shouts", "n_distinct", "n_function")
RULES = ("v_length", "v_function_words", "v_letters", "v_symbols", "v_lines", "v_repeats",
         "v_word_size", "v_case", "v_shouts", "v_variety")
# fixed values: function words of the languages
FUNCTION_WORDS = (
    "the of and to in that is was it for with on be by this are as he she not but from at or an "
    "der die das und in den von zu mit ist im auf dem nicht ein eine für als sich auch "
    "de la le et les des en un une que est du au pour dans qui sur pas par avec "
    "el los del las y se por con para su al lo una como más pero").split()


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts and those that the rules need.

    Three-word windows are compared by their 64-bit hashes, first by a hash set; only a
    text in which a window returns is sorted to find the words that repeats cover.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_w", words(F.col(text))).withColumn("_t", plain)
    out = out.withColumn("n_words", F.size("_w").cast("long"))
    out = out.withColumn(
        "_h", F.when(F.col("n_words") >= 3, F.transform(
            F.sequence(F.lit(0), F.size("_w") - 3),
            lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))))
    # a window that returns: its neighbours in sorted order are equal
    out = out.withColumn(
        "_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(
            F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    again = F.filter("_s", lambda e, j: (
        F.coalesce(F.get("_s", j - 1)["h"] == e["h"], F.lit(False))
        | F.coalesce(F.get("_s", j + 1)["h"] == e["h"], F.lit(False))))
    out = out.withColumn("_starts", F.sort_array(F.transform(again, lambda e: e["i"])))
    covered = F.aggregate(
        F.transform("_starts", lambda x, j: F.least(
            F.lit(3), F.coalesce(F.get("_starts", j + 1) - x, F.lit(3)))),
        F.lit(0).cast("long"), lambda a, b: a + b)
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("_lines", lines)
    kept_only = lambda pattern: F.length(F.regexp_replace("_t", pattern, "")).cast("long")
    return out.select(
        *docs.columns, "n_words",
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        kept_only(r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        kept_only(r"\P{Lu}+").alias("n_upper"),
        kept_only(r"\P{L}+").alias("n_letters"),
        kept_only(r"[^!?]+").alias("n_shouts"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        F.size(F.filter("_w", lambda x: x.isin(*FUNCTION_WORDS))).cast("long")
        .alias("n_function"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def votes() -> dict[str, Column]:
    """The rules over the counts of :func:`with_counts`."""
    def rule(value: Column, bad: Column, good: Column | None = None) -> Column:
        vote = F.when(value.isNull(), 0).when(bad, -1)
        return (vote if good is None else vote.when(good, 1)).otherwise(0)

    n, share = F.col("n_words"), lambda x: F.col(x) / F.nullif(F.col("n_words"), F.lit(0))
    function, symbols = share("n_function"), share("n_symbols")
    repeats, shouts, size = share("n_repeat_words"), share("n_shouts"), share("word_chars")
    letters = F.col("n_letters") / F.nullif(F.col("word_chars"), F.lit(0))
    lines = F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0))
    case = F.col("n_upper") / F.nullif(F.col("n_letters"), F.lit(0))
    variety = share("n_distinct")
    return {
        "v_length": rule(n, n < 50, n >= 100),
        "v_function_words": rule(function, function < 0.05, function > 0.12),
        "v_letters": rule(letters, letters < 0.85, letters > 0.93),
        "v_symbols": rule(symbols, symbols > 0.2),
        "v_lines": rule(lines, lines > 0.3),
        "v_repeats": rule(repeats, repeats > 0.3),
        "v_word_size": rule(size, (size < 2.5) | (size > 13)),
        "v_case": rule(case, case > 0.4),
        "v_shouts": rule(shouts, shouts > 0.2),
        "v_variety": rule(variety, variety < 0.15),
    }


def quality(docs: DataFrame, text: str = "text") -> tuple[DataFrame, VoteModel]:
    """Counts, votes, ``posterior`` and ``kept`` of every row, and the fitted model."""
    taken = (*COUNTS, *EXTRA, *RULES, "base_failed", "posterior", "kept")
    names = [c for c in docs.columns if c not in taken]
    counted = with_counts(docs.select(*names), text).drop(text)
    judged = staged(
        counted.withColumn("base_failed", base_failed()).withColumns(votes()), "quality")
    model = fit_votes(judged, RULES)
    scored = judged.withColumn("posterior", model.posterior())
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5)), model


def op1_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", *COUNTS, "base_failed", "kept", "posterior", *RULES)
