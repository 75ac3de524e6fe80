"""Result analytics: run summaries to chart tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.scores import explode_scores, parse_scores
from corpuslab.operators.lookup import dense_grid
from corpuslab.operators.metrics import family_scores, language_scores, last_per_key
from corpuslab.session import fixed_table

# Language to family.
FAMILIES = (
    ("ara", "Afro-Asiatic"), ("bul", "Indo-European"), ("deu", "Indo-European"),
    ("ell", "Indo-European"), ("eng", "Indo-European"), ("spa", "Indo-European"),
    ("fra", "Indo-European"), ("hin", "Indo-European"), ("rus", "Indo-European"),
    ("swa", "Niger-Congo"), ("tha", "Kra-Dai"), ("tur", "Turkic"),
    ("vie", "Austroasiatic"), ("zho", "Sino-Tibetan"),
)
# Short names of language models and of embedding models.
LANGUAGE_MODELS = (
    ("mbert", "bert-base-multilingual-cased"), ("xlmr", "xlm-roberta-base"),
    ("mt5", "google/mt5-base"), ("mgpt", "ai-forever/mGPT"),
    ("bloomz", "bigscience/bloomz-560m"), ("xglm", "facebook/xglm-564M"),
    ("llama2-7b", "meta-llama/Llama-2-7b-hf"), ("mistral-7b", "mistralai/Mistral-7B-v0.1"),
)
EMBEDDING_MODELS = (
    ("embeddinggemma", "google/embedding-gemma-base"),
    ("stsb-xlm-r", "sentence-transformers/stsb-xlm-r-multilingual"),
    ("cohere-v3", "Cohere/embed-multilingual-v3.0"),
    ("jina-v3", "jinaai/jina-embeddings-v3"), ("kalm", "kaist-nlp-lab/kalm-embedding-base"),
)


def families(spark) -> DataFrame:
    langs, names = zip(*FAMILIES)
    return fixed_table(spark, lang=(pa.string(), list(langs)), family=(pa.string(), list(names)))


def aliases(spark, kind: str = "language") -> DataFrame:
    rows = LANGUAGE_MODELS if kind == "language" else EMBEDDING_MODELS
    names, ids = zip(*rows)
    return fixed_table(spark, alias=(pa.string(), list(names)), id=(pa.string(), list(ids)))


def family_rows(summaries: DataFrame) -> DataFrame:
    """``(model, lang, score)`` of structured and printed results alike."""
    printed = parse_scores(
        summaries.select("model", F.explode("results_list").alias("entry")), "entry", "pair")
    structured = explode_scores(
        summaries.where(F.col("results_map").isNotNull()).select("model", F.col("results_map").alias("results")))
    return printed.select("model", "lang", "score").unionByName(
        structured.select("model", F.col("lang_tag").alias("lang"), "score"))


def family_table(summaries: DataFrame) -> DataFrame:
    """The family chart as a table: every model against every family."""
    scores = family_scores(family_rows(summaries), families(summaries.sparkSession))
    return dense_grid(scores, "model", "family", "score")


def _printed(summaries: DataFrame, first_only: bool) -> DataFrame:
    """``(model, task, entry)`` of printed results; published charts read the first of a run."""
    listed = F.slice("results_list", 1, 1) if first_only else F.col("results_list")
    return summaries.select("model", F.posexplode(listed).alias("task", "entry"))


def language_table(summaries: DataFrame, first_only: bool = False) -> DataFrame:
    """The language chart as a table, over all printed entries of each run."""
    scores = parse_scores(_printed(summaries, first_only), "entry", "literal")
    return dense_grid(language_scores(scores), "model", "lang", "score")


def model_scores(summaries: DataFrame, first_only: bool = False) -> DataFrame:
    """One model's score per language in language order, the last entry winning."""
    rows = summaries.where(F.col("results_rows").isNotNull()).select(
        "model", F.posexplode("results_rows").alias("pos", "e")).select(
        "model", F.lit(0).alias("task"), "pos",
        F.try_element_at("e.languages", F.lit(1)).alias("lang"), F.col("e.main_score").alias("score"))
    both = parse_scores(_printed(summaries, first_only), "entry", "regex").select(
        "model", "task", "pos", "lang", "score").unionByName(rows)
    return last_per_key(
        both, ["model", "lang"], F.struct("task", "pos"), "score").orderBy("model", "lang")
