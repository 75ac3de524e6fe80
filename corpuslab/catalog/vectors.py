"""Document vectors and pair evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.catalog import query
from corpuslab.catalog.corpus import documents
from corpuslab.operators.encode import encode_chars
from corpuslab.operators.vectors import embed, pair_eval, score_pairs, sts_eval
from corpuslab.operators.vocab import char_vocab
from corpuslab.sources.tables import table


@query("""
with v as (select ch, row_number() over (order by ch) as id
           from (select distinct ch from (select unnest(string_split(text, '')) as ch from documents)) where ch <> ''),
c as (select doc_id, ch, count(*) as m from (select doc_id, unnest(string_split(text, '')) as ch from documents)
      group by 1, 2),
m as (select c.doc_id, i, sum(c.m * e.embedding[i]::double) / sum(c.m) as x
      from c join v on v.ch = c.ch join embeddings e on e.vec_id = v.id cross join (select unnest(range(1, 65)) as i)
      group by 1, 2),
n as (select doc_id, sqrt(sum(x * x)) as len from m group by 1)
select m.doc_id, round(max(x / len) filter (i = 1), 6) as first, round(max(x / len) filter (i = 64), 6) as last,
       round(sum(x / len), 6) as total
from m join n on n.doc_id = m.doc_id group by 1
""")
def document_vectors(spark, sf):
    docs = documents(spark, sf)
    tokens = [r["token"] for r in char_vocab(docs).orderBy("id").collect()]
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("int").alias("id"), F.col("embedding").alias("vector"))
    rows = embed(encode_chars(docs, tokens), vectors, 64)
    return rows.select(
        "doc_id", F.round(F.get("vector", 0), 6).alias("first"), F.round(F.get("vector", 63), 6).alias("last"),
        F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def vector_pairs(spark, sf):
    """Every vector next to those 1, 7 and 13 places on; a pair is positive on equal labels."""
    vectors = table(spark, sf, "embeddings")
    left = vectors.select(
        F.explode(F.array(F.lit(1), F.lit(7), F.lit(13))).alias("step"), "vec_id",
        F.col("embedding").alias("a"), F.col("label").alias("la")).withColumn("other", F.col("vec_id") + F.col("step"))
    right = vectors.select(F.col("vec_id").alias("other"), F.col("embedding").alias("b"), F.col("label").alias("lb"))
    pairs = left.join(right, "other").select(
        F.col("la").alias("grp"), "step", "vec_id", "a", "b",
        (F.col("la") == F.col("lb")).cast("int").alias("gold"), F.abs(F.col("la") - F.col("lb")).alias("gap"))
    return score_pairs(pairs).withColumn("score", F.round("score", 6))


PAIRS = """
select a.label as grp, s.step, a.vec_id, (a.label = b.label)::int as gold, abs(a.label - b.label) as gap,
       round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score
from embeddings a cross join (select unnest([1, 7, 13]) as step) s join embeddings b on b.vec_id = a.vec_id + s.step
"""


@query(f"select grp, step, vec_id, gold, score from ({PAIRS})")
def pair_scores(spark, sf):
    return vector_pairs(spark, sf).select("grp", "step", "vec_id", "gold", "score")


@query(f"""
with p as ({PAIRS}),
c as (select grp, score, sum(gold) as pos, count(*) as seen from p group by 1, 2),
r as (select *, sum(pos) over w as tp, sum(seen) over w as k, sum(pos) over (partition by grp) as positives,
             sum(seen) over (partition by grp) as n
      from c window w as (partition by grp order by score desc rows unbounded preceding))
select grp, positives::bigint as positives, n::bigint as n,
       round(coalesce(sum(pos * (tp / k)) / nullif(positives, 0), 0), 6) as ap,
       round(greatest(max(tp + (n - positives) - (k - tp)), n - positives) / n, 6) as best_accuracy
from r group by grp, positives, n
""")
def pair_evaluation(spark, sf):
    return pair_eval(vector_pairs(spark, sf), ["grp"]).select(
        "grp", "positives", "n", F.round("ap", 6).alias("ap"), F.round("best_accuracy", 6).alias("best_accuracy"))


@query(f"""
with p as ({PAIRS}),
r as (select step, rank() over (partition by step order by score) + (count(*) over (partition by step, score) - 1) / 2.0::double as rx,
             rank() over (partition by step order by gap) + (count(*) over (partition by step, gap) - 1) / 2.0::double as ry from p)
select step, count(*) as n, round(corr(rx, ry), 6) as spearman from r group by step
""")
def similarity_correlation(spark, sf):
    return sts_eval(vector_pairs(spark, sf), ["step"], gold="gap").select(
        "step", "n", F.round("spearman", 6).alias("spearman"))
