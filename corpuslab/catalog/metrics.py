"""Accuracy, losses, means and totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.catalog import query
from corpuslab.catalog.corpus import documents
from corpuslab.catalog.joins import FAMILIES, TAGGED, families, tagged, values_sql
from corpuslab.operators.metrics import (
    accuracy, accuracy_by, argmax_choice, family_scores, language_scores, last_per_key, macro_mean,
    mean_loss, pass_at_1, perplexity, throughput, token_nll,
)
from corpuslab.operators.vectors import mean_pool
from corpuslab.sources.tables import table


def labelled(spark, sf):
    """Quality is the gold answer, the opposite of toxic the prediction."""
    return table(spark, sf, "labels").withColumn("pred", 1 - F.col("toxic")).join(
        documents(spark, sf).select("doc_id", "lang", "source"), "doc_id")


@query("""
select coalesce(avg((1 - toxic = quality)::int), 0.0) as accuracy, count(*) as n from labels
""")
def accuracy_overall(spark, sf):
    rows = table(spark, sf, "labels").withColumn("pred", 1 - F.col("toxic"))
    return accuracy(rows, "pred", "quality")


@query("""
select d.lang, round(sum((1 - l.toxic = l.quality)::int)::double / count(*), 9) as accuracy, count(*) as n
from labels l join documents d on d.doc_id = l.doc_id group by rollup (d.lang)
""")
def accuracy_by_language(spark, sf):
    return accuracy_by(labelled(spark, sf), "lang", "pred", "quality").withColumn(
        "accuracy", F.round("accuracy", 9))


@query("""
with a as (
  select d.source as model, d.lang, avg((1 - l.toxic = l.quality)::int) as accuracy, sum(l.quality) as gold
  from labels l join documents d on d.doc_id = l.doc_id group by 1, 2)
select model, round(avg(accuracy), 9) as avg_accuracy, count(*) as languages
from a where gold > 0 group by model
""")
def macro_accuracy(spark, sf):
    # a language in which no gold answer is positive has nothing to be right about: it failed
    per_language = labelled(spark, sf).groupBy(F.col("source").alias("model"), "lang").agg(
        F.avg((F.col("pred") == F.col("quality")).cast("int")).alias("accuracy"),
        F.count(F.lit(1)).alias("total_samples"), F.sum("quality").alias("_gold"),
    ).withColumn("error", F.when(F.col("_gold") == 0, F.lit("no positive gold")))
    return macro_mean(per_language, ["model"]).withColumn(
        "avg_accuracy", F.round("avg_accuracy", 9))


@query(f"""
select d.source as model, coalesce(f.family, 'Other') as family, round(avg(d.n_chars), 6) as score
from (select *, split_part({TAGGED}, '-', 1) as head from documents) d
left join (values {values_sql(FAMILIES)}) f(lang, family) on f.lang = d.head group by 1, 2
""")
def scores_by_family(spark, sf):
    rows = documents(spark, sf).select(
        F.col("source").alias("model"), tagged(F.col("lang")).alias("lang"), F.col("n_chars").alias("score"))
    return family_scores(rows, families(spark)).withColumn("score", F.round("score", 6))


@query(f"""
select source as model, split_part({TAGGED}, '-', 1) as lang, round(avg(n_chars), 6) as score
from documents group by 1, 2
""")
def scores_by_language(spark, sf):
    rows = documents(spark, sf).select(
        F.col("source").alias("model"), tagged(F.col("lang")).alias("lang"), F.col("n_chars").alias("score"))
    return language_scores(rows).withColumn("score", F.round("score", 6))


@query("""
select d.lang, round(avg(l.quality), 9) as pass_at_1, count(*) as n
from labels l join documents d on d.doc_id = l.doc_id group by 1
""")
def passed_share(spark, sf):
    rows = labelled(spark, sf).withColumn("pass", F.col("quality") == 1)
    return pass_at_1(rows, ["lang"]).withColumn("pass_at_1", F.round("pass_at_1", 9))


@query("select event_type as split, round(avg(value), 6) as loss, count(*) as batches from events group by 1")
def loss_by_split(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("split"), F.col("value").alias("loss"))
    return mean_loss(rows, ["split"]).withColumn("loss", F.round("loss", 6))


@query("""
select event_type, round(sum(value / 100) / sum(1), 9) as avg_loss, round(exp(sum(value / 100) / sum(1)), 6) as perplexity
from events where user_id <> 8 group by 1
""")
def perplexity_by_type(spark, sf):
    # the target 8 stands for the ignored one
    rows = token_nll(table(spark, sf, "events"), "user_id", 8)
    return perplexity(rows, F.col("value") / 100, F.lit(1), ["event_type"]).select(
        "event_type", F.round("avg_loss", 9).alias("avg_loss"), F.round("perplexity", 6).alias("perplexity"))


@query("""
select event_type as run, sum(user_id)::bigint as tokens, round(sum(value), 6) as seconds,
       round(sum(user_id) / greatest(sum(value), 1e-9::double), 6) as tok_per_sec
from events group by 1
""")
def tokens_per_second(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("run"), F.col("user_id").alias("tokens"), F.col("value").alias("seconds"))
    return throughput(rows, ["run"]).select(
        "run", "tokens", F.round("seconds", 6).alias("seconds"),
        F.round("tok_per_sec", 6).alias("tok_per_sec"))


@query("""
select label, round(list_sum(v), 6) as total, round(v[1], 6) as first, round(v[64], 6) as last
from (select label, list(m order by i) as v
      from (select label, i, avg(embedding[i]::double) as m
            from (select label, embedding, unnest(range(1, 65)) as i from embeddings where embedding[1] > 0)
            group by label, i) group by label)
""")
def masked_mean_vectors(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("mask", (F.get("embedding", 0) > 0).cast("int"))
    pooled = mean_pool(rows, ["label"], "embedding", 64, "mask")
    return pooled.select(
        "label", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
        F.round(F.get("vector", 0), 6).alias("first"), F.round(F.get("vector", 63), 6).alias("last"))


@query("""
select l_orderkey, arg_max(l_linenumber, (l_quantity, -l_linenumber)) as pred from lineitem group by 1
""")
def best_choice(spark, sf):
    return argmax_choice(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber", "l_quantity")


@query("""
select user_id, event_type, arg_max(value, (ts, event_id)) as value from events group by 1, 2
""")
def last_value(spark, sf):
    return last_per_key(
        table(spark, sf, "events"), ["user_id", "event_type"], F.struct("ts", "event_id"), "value")
