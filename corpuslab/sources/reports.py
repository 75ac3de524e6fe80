"""Evaluation reports, run summaries and model cards as JSON."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions.scores import SCORE, TASKS
from corpuslab.functions.text import dir_to_model, model_to_dir
from corpuslab.session import fixed_table, staged

CELL = "struct<accuracy:double,n:bigint>"
REPORT = (
    f"overall {CELL}, per_subject map<string,{CELL}>, accuracy double, n bigint,"
    " dataset_used string, total_subjects int, correct bigint, total_examples bigint, `pass@1` double,"
    " detailed_results array<string>, details array<string>"
)
LANGUAGE = "struct<accuracy:double,total_samples:bigint,elapsed_time:double,error:string>"
LANGUAGE_REPORT = f"model string, languages map<string,{LANGUAGE}>, avg_accuracy double"

# The fields of a model card, all text unless listed in CARD_TYPES.
CARD_FIELDS = (
    "name", "revision", "release_date", "languages", "n_parameters", "memory_usage_mb",
    "max_tokens", "embed_dim", "license", "open_weights", "public_training_code",
    "public_training_data", "framework", "reference", "similarity_fn_name",
    "use_instructions", "training_datasets", "adapted_from", "superseded_by",
    "is_cross_encoder", "modalities", "loader",
)
CARD_TYPES = {
    "languages": "array<string>", "n_parameters": "bigint", "memory_usage_mb": "double",
    "max_tokens": "double", "embed_dim": "bigint", "open_weights": "boolean",
    "framework": "array<string>", "use_instructions": "boolean",
    "is_cross_encoder": "boolean", "modalities": "array<string>",
}
CARD = ", ".join(f"{f} {CARD_TYPES.get(f, 'string')}" for f in CARD_FIELDS)


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every document of every file, be it one spread over lines or one to a line.

    A document that ends before a line on which another begins has no comma between them, which
    cannot happen inside one document, so that is where a file is cut.
    """
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    parts = files.select("path", F.explode(F.split("value", r"(?<=\})\s*\n\s*(?=\{)")).alias("value"))
    return parts.where(F.trim("value") != "").select(
        "path", F.from_json("value", schema).alias("document")).select("path", "document.*")


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Run summaries: ``results_map`` when structured, ``results_list`` when printed.

    Entries of a list that are objects instead of strings land in ``results_rows``.
    """
    raw = _json(spark, path, "model string, elapsed_sec double, results string")
    is_list = F.startswith(F.ltrim("results"), F.lit("["))
    as_rows = F.from_json("results", f"array<{SCORE}>")
    listed = F.from_json("results", "array<string>")
    objects = F.startswith(F.ltrim(F.try_element_at(listed, F.lit(1))), F.lit("{"))
    return raw.select(
        "path", "model", "elapsed_sec",
        F.when(~is_list, F.from_json("results", TASKS)).alias("results_map"),
        F.when(is_list & ~objects, listed).alias("results_list"),
        F.when(is_list & objects, as_rows).alias("results_rows"),
    )


def read_model_meta(spark: SparkSession, path: str) -> DataFrame:
    """Model cards; the model id is the third folder above the file, the group the fourth.
    A folder may be written as ``name=value``."""
    parts = F.transform(F.split("path", "/"), lambda p: F.regexp_replace(p, "^[a-z_]+=", ""))
    return _json(spark, path, CARD).select(
        dir_to_model(F.try_element_at(parts, F.lit(-4))).alias("model"),
        F.try_element_at(parts, F.lit(-5)).alias("group"), *CARD_FIELDS,
    )


def _reports(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, REPORT).withColumn(
        "report", F.regexp_extract("path", r"([^/]+)\.(?:json|txt)[^/]*$", 1))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Accuracy reports as rows ``(report, subject, accuracy, n)``; subject NULL is overall.

    ``correct`` and ``total_examples`` of the whole report stand on each of its rows.
    """
    raw = _reports(spark, path)
    overall = F.array(F.struct(
        F.lit(None).cast("string").alias("key"),
        F.struct(
            F.coalesce("overall.accuracy", "accuracy", "`pass@1`").alias("accuracy"),
            F.coalesce("overall.n", "n", "total_examples").alias("n"),
        ).alias("value"),
    ))
    subjects = F.coalesce(
        F.map_entries("per_subject"),
        F.array().cast(f"array<struct<key:string,value:{CELL}>>"),
    )
    whole = ["report", "dataset_used", "total_subjects", "correct", "total_examples"]
    return raw.select(*whole, F.explode(F.concat(overall, subjects)).alias("e")).select(
        *whole, F.col("e.key").alias("subject"), "e.value.accuracy", "e.value.n")


def read_report_details(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """``(report, position, detail)``: the detail rows of reports, as JSON or parsed by ``schema``."""
    rows = _reports(spark, path).select("report", F.posexplode(
        F.coalesce("detailed_results", "details")).alias("position", "detail"))
    return rows if schema is None else rows.withColumn("detail", F.from_json("detail", schema))


def _written_in_order(lines: DataFrame, path: str, keys: list[str], mode: str, by: str | None = None) -> None:
    """Write ``line`` rows as text, sorted by ``keys``, whole documents in one file each.

    The rows of a document are sorted (on disk if they are many) and written as they come, so a document
    of any length passes through its task without being held.
    """
    dealt = lines.repartition(by) if by else lines.repartition(1)
    rows = dealt.sortWithinPartitions(*keys)
    if by is None:
        rows.select("line").write.mode(mode).text(path)
    else:
        rows.select(by, "line").write.mode(mode).partitionBy(by).text(path)


def _entry(key: str, value: Column, first: Column) -> Column:
    """One line of a JSON object; all but the first begin with a comma."""
    name = F.replace(F.to_json(F.struct(F.col(key).alias("k"))), F.lit('{"k":'), F.lit(""))
    name = F.substr(name, F.lit(1), F.length(name) - 1)
    return F.concat(F.when(F.col(key) == first, "").otherwise(","), name, F.lit(":"), F.to_json(
        value, {"ignoreNullFields": "true"}))


def opened(head: str) -> str:
    """A JSON object as text, left open for one more field."""
    return head[:-1] + ("," if head != "{}" else "")


def write_report(
    rows: DataFrame, path: str, key: str = "subject", mode: str = "errorifexists",
    details: DataFrame | None = None, order: str = "doc_id", detail_rows: int | None = 10, **meta,
) -> None:
    """Write ``(key, accuracy, n)`` rows, key NULL for overall, as one nested report.

    ``correct`` and ``total_examples`` are those of the overall row. ``details`` adds its first
    ``detail_rows`` rows by the integer ``order`` as ``detailed_results`` (all of them for None). The
    input is run once; subjects of any number are written in order, one to a line.
    """
    rows = staged(rows.select(F.col(key).alias("key"), "accuracy", "n"), "report")
    cell = F.struct("accuracy", "n")
    extra = [F.lit(v).alias(k) for k, v in meta.items()]
    # one row: what stands outside the subjects
    whole = rows.agg(
        F.first(F.when(F.col("key").isNull(), cell), ignorenulls=True).alias("overall"),
        F.min("key").alias("first")).select("first", F.to_json(F.struct(
            "overall",
            F.round(F.col("overall.accuracy") * F.col("overall.n")).cast("long").alias("correct"),
            F.col("overall.n").alias("total_examples"), *extra)).alias("head")).first()
    fixed = [(0, opened(whole["head"]) + '"per_subject":{'), (4, "}}")]
    lines = rows.where("key is not null").select(
        F.lit(1).alias("part"), F.col("key").alias("place"), F.lit(0).cast("long").alias("nth"),
        _entry("key", cell, F.lit(whole["first"])).alias("line"))
    if details is not None:
        kept = details.orderBy(order)
        kept = staged(kept if detail_rows is None else kept.limit(detail_rows), "details")
        least = kept.agg(F.min(order)).first()[0]
        lines = lines.union(kept.select(F.lit(3), F.lit(""), F.col(order).cast("long"), F.concat(
            F.when(F.col(order) == F.lit(least), "").otherwise(","),
            F.to_json(F.struct(*[F.col(c) for c in details.columns])))))
        fixed[1:] = [(2, '},"detailed_results":['), (4, "]}")]
    parts, texts = (list(c) for c in zip(*fixed))
    lines = lines.union(fixed_table(
        rows.sparkSession, part=(pa.int32(), parts), place=(pa.string(), [""] * len(parts)),
        nth=(pa.int64(), [0] * len(parts)), line=(pa.string(), texts)))
    _written_in_order(lines, path, ["part", "place", "nth"], mode)


def write_language_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows ``(model, language, accuracy, total_samples, elapsed_time, error)`` to one folder per
    model, and all models together under ``all_results``.

    The average leaves rows with an error out. The input is run once; languages of any number are
    written in order, one to a line.
    """
    rows = staged(df.select(
        "model", F.coalesce("language", F.lit("")).alias("language"), "accuracy", "total_samples", "elapsed_time", "error"), "languages")
    models = staged(rows.groupBy("model").agg(
        F.avg(F.when(F.col("error").isNull(), F.col("accuracy"))).alias("avg_accuracy"),
        F.min("language").alias("first")), "models")
    head = F.to_json(F.struct("model", "avg_accuracy"), {"ignoreNullFields": "false"})
    opening = models.select(
        "model", F.lit(0).alias("part"), F.lit("").alias("place"),
        F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"languages":{')).alias("line"))
    cell = F.struct("accuracy", "total_samples", "elapsed_time", "error")
    entries = rows.join(models.select("model", "first"), "model").select(
        "model", F.lit(1), "language", _entry("language", cell, F.col("first")))
    lines = opening.union(entries).union(models.select("model", F.lit(2), F.lit(""), F.lit("}}")))
    keys = ["model", "part", "place"]
    _written_in_order(lines.withColumn("model_dir", model_to_dir(F.col("model"))), f"{path}/models",
                      ["model_dir", *keys], mode, by="model_dir")
    lines.repartition("model").sortWithinPartitions(*keys).select("line").write.mode(mode).text(
        f"{path}/all_results")


def read_language_reports(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, LANGUAGE_REPORT).drop("path")


def write_summary(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``(model, elapsed_sec, results)`` with results kept structured, a folder per model."""
    df.withColumn("model_dir", model_to_dir(F.col("model"))).write.mode(mode).partitionBy(
        "model_dir").json(path)
