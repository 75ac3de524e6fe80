"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept and returns the columns of ``documents``; the last one
returns the packed pieces. Documents whose id is null pass the two stages that select by id,
since an id is what they go by; column names that begin with an underscore are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import contamination, language, packing, pii, similarity
from corpuslab.llm.common import table
from corpuslab.session import small_batches, staged

#: the packed result depends on trained models and iterated matching, which SQL has no words for
ORACLE_SQL = None
BROADCAST_IDS = 1_000_000


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; all of them if no row is labelled.

    The field names a learned language for every text with a letter, also for one in a language
    it never learned and for letter noise; neither its choice nor its score rejects any.
    """
    model = language.fit(docs)
    if model is None:
        return docs
    # the other columns pass under names that no result has
    names = [c if c in ("doc_id", "text") else f"_{i}" for i, c in enumerate(docs.columns)]
    told = language.predict(docs.toDF(*names), model, keep=tuple(names))
    return told.where(F.col("lang_pred") != "und").select(*names).toDF(*docs.columns)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id is not among ``ids(doc_id)``; sent along only while they are few."""
    with small_batches(docs.sparkSession):
        ids = staged(ids, "dropped")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti").select(*docs.columns)


def keep_one_of_a_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each near-duplicate group; rows that repeat it go too."""
    groups = staged(similarity.similar_groups(docs.select("doc_id", "text")), "groups")
    kept = without(docs, groups.where("component_id <> doc_id").select("doc_id").distinct())
    again = groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    return kept.dropDuplicates(["doc_id", "text"]) if again.limit(1).count() else kept


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = contamination.leaks(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.select("doc_id").distinct())


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    found = pii.personal_data(docs, out="_found", keep_text=True)
    clean = found.withColumn("text", pii.redacted(F.col("text"), F.col("_found")))
    return clean.withColumn(
        "n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of at most 4,096 tokens."""
    return packing.packed_documents(docs)


STAGES = [
    ("language", keep_languages),
    ("near duplicates", keep_one_of_a_group),
    ("decontamination", keep_clean),
    ("personal data", redact),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each to what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with small_batches(spark):
            docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
