"""Benchmark results: stringified task results and structured score maps to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.lookup import strip

SCORE = "struct<main_score:double,hf_subset:string,languages:array<string>>"
TASKS = f"map<string,struct<test:array<{SCORE}>>>"


def parse_scores(df: DataFrame, column: str, style: str = "regex") -> DataFrame:
    """Rows ``(…, pos, lang, score)`` out of a stringified task result.

    ``pair``: the first ``hf_subset='…'`` with the first ``main_score``, one row, bad
    strings skipped. ``literal``: every entry of ``test`` in the printed scores.
    ``regex``: every ``main_score`` with the first language printed after it.
    """
    text = F.col(column)
    keep = [c for c in df.columns if c != column]
    if style == "pair":
        lang = F.regexp_extract(text, r"(?s)hf_subset='([^']*)", 1)
        score = F.regexp_extract(text, r"(?s)main_score': ([^,]*)", 1)
        return (
            df.where(F.contains(text, F.lit("hf_subset='")))
            .select(*keep, F.lit(0).alias("pos"), lang.alias("lang"),
                    strip(score).try_cast("double").alias("score"))
            .where(F.col("score").isNotNull())
        )
    if style == "literal":
        printed = F.regexp_extract(text, r"(?s) scores=(.*?) evaluation_time", 1)
        as_json = printed
        for word, value in (("None", "null"), ("True", "true"), ("False", "false")):
            as_json = F.regexp_replace(as_json, rf"(?<=[\s:\[(]){word}(?=[\s,\])}}])", value)
        parsed = F.from_json(as_json, f"test array<{SCORE}>")
        return df.select(*keep, F.posexplode(parsed["test"]).alias("pos", "_e")).select(
            *keep, "pos", F.try_element_at("_e.languages", F.lit(1)).alias("lang"),
            F.col("_e.main_score").alias("score"),
        )
    if style == "regex":
        pattern = F.lit(r"(?s)'main_score': ([0-9.]+).*?'languages': \['(.*?)'\]")
        found = F.arrays_zip(
            F.regexp_extract_all(text, pattern, F.lit(1)).alias("s"),
            F.regexp_extract_all(text, pattern, F.lit(2)).alias("l"),
        )
        return df.select(*keep, F.posexplode(found).alias("pos", "_e")).select(
            *keep, "pos", F.col("_e.l").alias("lang"),
            F.col("_e.s").try_cast("double").alias("score"),
        )
    raise ValueError(f"unknown style {style}")


def explode_scores(df: DataFrame, column: str = "results") -> DataFrame:
    """Rows ``(…, task, lang_tag, languages, score)`` out of a task → test-entries map;
    entries without a language or score are left out."""
    keep = [c for c in df.columns if c != column]
    return (
        df.select(*keep, F.explode(column).alias("task", "_t"))
        .select(*keep, "task", F.explode("_t.test").alias("_e"))
        .select(*keep, "task", F.coalesce("_e.hf_subset", F.lit("")).alias("lang_tag"),
                F.col("_e.languages").alias("languages"), F.col("_e.main_score").alias("score"))
        .where((F.split_part("lang_tag", F.lit("-"), F.lit(1)) != "") & F.col("score").isNotNull())
    )
