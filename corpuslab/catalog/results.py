"""Reports and run summaries, written and read back, and their chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.catalog import query
from corpuslab.catalog.corpus import documents
from corpuslab.catalog.joins import TAGGED, tagged, values_sql
from corpuslab.catalog.metrics import labelled
from corpuslab.functions.scores import explode_scores, parse_scores
from corpuslab.functions.text import model_to_dir
from corpuslab.operators.metrics import accuracy_by
from corpuslab.operators.scoring import sweep
from corpuslab.plans.results_plan import FAMILIES, family_table, language_table, model_scores
from corpuslab.session import scratch_path
from corpuslab.sources.reports import (
    read_language_reports, read_model_meta, read_report_details, read_reports, read_summaries,
    write_language_report, write_report,
    write_summary,
)
from corpuslab.sources.tables import table


def printed_results(spark, sf):
    """Every event as a printed task result with two scores."""
    entry = F.concat(
        F.lit("TaskResult(task_name=X scores={'test': [{'main_score': "), F.col("value").cast("string"),
        F.lit(", 'hf_subset': 'en', 'note': None, 'languages': ['eng-Latn']},\n {'main_score': "),
        F.col("user_id").cast("string"), F.lit(".5, 'hf_subset': 'de', 'languages': ['"), F.col("event_type"),
        F.lit("-Latn']}]} evaluation_time=1.0 hf_subset='"), F.col("event_type"), F.lit("-x')"))
    return table(spark, sf, "events").select("event_id", entry.alias("entry"))


BOTH = """
select event_id, 0 as pos, 'eng-Latn' as lang, value as score from events
union all select event_id, 1, event_type || '-Latn', user_id + 0.5::double from events
"""


@query("select event_id, 0 as pos, event_type || '-x' as lang, value as score from events")
def parsed_pairs(spark, sf):
    return parse_scores(printed_results(spark, sf), "entry", "pair")


@query(BOTH)
def parsed_literals(spark, sf):
    return parse_scores(printed_results(spark, sf), "entry", "literal")


@query(BOTH)
def parsed_patterns(spark, sf):
    return parse_scores(printed_results(spark, sf), "entry", "regex")


@query("""
select event_id, 'task' as task, event_type || '-x' as lang_tag, value as score from events where user_id <> 8
""")
def structured_scores(spark, sf):
    score = F.when(F.col("user_id") != 8, F.col("value"))
    entry = F.struct(
        score.alias("main_score"), F.concat("event_type", F.lit("-x")).alias("hf_subset"),
        F.array(F.lit("eng-Latn")).alias("languages"))
    empty = F.struct(
        score.alias("main_score"), F.lit("").alias("hf_subset"), F.array(F.lit("eng-Latn")).alias("languages"))
    rows = table(spark, sf, "events").select(
        "event_id", F.create_map(F.lit("task"), F.struct(F.array(entry, empty).alias("test"))).alias("results"))
    return explode_scores(rows).select("event_id", "task", "lang_tag", "score")


@query("""
select 'documents' as dataset_used, d.lang as subject,
       sum((1 - l.toxic = l.quality)::int)::double / count(*) as accuracy, count(*) as n
from labels l join documents d on d.doc_id = l.doc_id group by rollup (d.lang)
""")
def report_written(spark, sf):
    rows = accuracy_by(labelled(spark, sf), "lang", "pred", "quality").withColumnRenamed("lang", "subject")
    path = scratch_path(spark, "report")
    write_report(rows, path, dataset_used="documents")
    return read_reports(spark, path).select("dataset_used", "subject", "accuracy", "n")


@query("""
with rows as (select d.doc_id, d.lang, l.quality, 1 - l.toxic as pred from labels l join documents d on d.doc_id = l.doc_id),
totals as (select sum((pred = quality)::int)::bigint as correct, count(*) as total_examples from rows)
select (row_number() over (order by doc_id) - 1)::int as position, doc_id, pred = quality as passed, correct, total_examples
from rows, totals order by doc_id limit 10
""")
def report_details_written(spark, sf):
    """A report with its totals and the first ten detail rows, written and read back."""
    rows = labelled(spark, sf)
    path = scratch_path(spark, "report")
    write_report(
        accuracy_by(rows, "lang", "pred", "quality").withColumnRenamed("lang", "subject"), path,
        details=rows.select("doc_id", (F.col("pred") == F.col("quality")).alias("passed")))
    whole = read_reports(spark, path).where("subject is null").select("report", "correct", "total_examples")
    details = read_report_details(spark, path, "doc_id bigint, passed boolean")
    return details.join(whole, "report").select(
        "position", "detail.doc_id", "detail.passed", "correct", "total_examples")


@query("""
with s as (select d.source as model, d.lang as language, avg((1 - l.toxic = l.quality)::int) as accuracy,
                  count(*) as total_samples
           from labels l join documents d on d.doc_id = l.doc_id group by 1, 2)
select model, language, round(accuracy, 9) as accuracy, total_samples,
       round(avg(accuracy) over (partition by model), 9) as avg_accuracy from s
""")
def language_report_written(spark, sf):
    rows = labelled(spark, sf).withColumnsRenamed({"source": "model", "lang": "language"})
    path = scratch_path(spark, "languages")
    write_language_report(sweep(rows, "pred", "quality"), path)
    return read_language_reports(spark, f"{path}/all_results").select(
        "model", "avg_accuracy", F.explode("languages").alias("language", "r")).select(
        "model", "language", F.round("r.accuracy", 9).alias("accuracy"), "r.total_samples",
        F.round("avg_accuracy", 9).alias("avg_accuracy"))


@query("""
select distinct 'org/' || source as model, 'found' as grp, 'none' as name, true as open_weights from documents
""")
def model_cards(spark, sf):
    """One card per source, written to the folders a model id becomes, and read back."""
    cards = documents(spark, sf).select(
        F.lit("found").alias("grp"), model_to_dir(F.concat(F.lit("org/"), "source")).alias("model_dir"),
        F.lit("none").alias("name_dir"), F.lit("none").alias("revision_dir"),
        F.lit("none").alias("name"), F.lit(True).alias("open_weights")).distinct()
    path = scratch_path(spark, "cards")
    cards.write.partitionBy("grp", "model_dir", "name_dir", "revision_dir").json(path)
    return read_model_meta(spark, f"{path}/*/*/*/*/*.json").select(
        "model", F.col("group").alias("grp"), "name", "open_weights")


def _lang_means(spark, sf):
    return documents(spark, sf).groupBy(
        F.concat(F.lit("org/"), "source").alias("model"), tagged(F.col("lang")).alias("tag")).agg(
        F.round(F.avg("n_chars"), 6).alias("score"))


def _entry():
    return F.struct(F.col("score").alias("main_score"), F.col("tag").alias("hf_subset"),
                    F.array("tag").alias("languages"))


MEANS = f"""
select 'org/' || source as model, {TAGGED} as tag, round(avg(n_chars), 6) as score from documents group by 1, 2
"""
FAMILY_MEANS = f"""
select m.model, coalesce(f.family, 'Other') as family, avg(score) as score from ({MEANS}) m
left join (values {values_sql(FAMILIES)}) f(lang, family) on f.lang = split_part(m.tag, '-', 1) group by 1, 2
"""


@query(f"""
with c as ({FAMILY_MEANS})
select a.model, b.family, round(c.score, 6) as score from (select distinct model from c) a
cross join (select distinct family from c) b left join c on c.model = a.model and c.family = b.family
""")
def family_chart(spark, sf):
    """Structured summaries, one file per model, written, read and charted."""
    # a model has one entry per language, so its collected list is bounded
    runs = _lang_means(spark, sf).groupBy("model").agg(
        F.struct(F.struct(F.sort_array(F.collect_list(_entry())).alias("test")).alias("lengths")).alias("results"),
    ).select("model", F.lit(1.5).alias("elapsed_sec"), "results")
    path = scratch_path(spark, "summaries")
    write_summary(runs, path)
    return family_table(read_summaries(spark, f"{path}/*/*.json")).withColumn("score", F.round("score", 6))


def _printed_runs(spark, sf):
    one = F.concat(F.lit("{'main_score': "), F.col("score").cast("string"), F.lit(", 'languages': ['"), "tag", F.lit("']}"))
    return _lang_means(spark, sf).groupBy("model").agg(F.array(F.concat(
        F.lit("TaskResult(task_name=X scores={'test': ["),
        F.array_join(F.sort_array(F.collect_list(one)), ", "),
        F.lit("]} evaluation_time=1.0 hf_subset='en')"))).alias("results")).select(
        "model", F.lit(1.5).alias("elapsed_sec"), "results")


@query(f"""
with c as (select model, split_part(tag, '-', 1) as lang, avg(score) as score from ({MEANS}) group by 1, 2)
select a.model, b.lang, round(c.score, 6) as score from (select distinct model from c) a
cross join (select distinct lang from c) b left join c on c.model = a.model and c.lang = b.lang
""")
def language_chart(spark, sf):
    path = scratch_path(spark, "summaries")
    write_summary(_printed_runs(spark, sf), path)
    return language_table(read_summaries(spark, f"{path}/*/*.json")).withColumn("score", F.round("score", 6))


@query(f"select model, tag as lang, score from ({MEANS})")
def model_chart(spark, sf):
    path = scratch_path(spark, "summaries")
    write_summary(_printed_runs(spark, sf), path)
    return model_scores(read_summaries(spark, f"{path}/*/*.json"))
