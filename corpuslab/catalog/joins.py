"""Dictionary, vector, window and gold joins, and the dense grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.catalog import query
from corpuslab.catalog.corpus import documents
from corpuslab.functions.text import lang_head
from corpuslab.operators.encode import decode_corpus, encode_chars
from corpuslab.operators.lookup import (
    axis, dense_grid, expand_aliases, expand_names, join_gold, lookup_vectors, wide_grid, with_family,
)
from corpuslab.operators.metrics import argmax_choice
from corpuslab.operators.tokens import token_stream, token_total, windows_at
from corpuslab.operators.vocab import Vocabulary, char_vocab
from corpuslab.plans.results_plan import FAMILIES, LANGUAGE_MODELS, aliases, families
from corpuslab.sources.tables import table


def values_sql(rows) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in rows)


@query(f"""
with names as (select doc_id, trim(unnest(string_split('MBERT, ' || source || ' ,xglm,' || lang, ','))) as name
               from documents)
select doc_id, coalesce(a.id, n.name) as model_id
from names n left join (values {values_sql(LANGUAGE_MODELS)}) a(alias, id) on a.alias = lower(n.name)
""")
def alias_expansion(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.concat(
        F.lit("MBERT, "), "source", F.lit(" ,xglm,"), "lang").alias("models"))
    return expand_aliases(rows, "models", aliases(spark)).select("doc_id", "model_id")


@query("""
select doc_id, trim(name) as name
from (select doc_id, unnest(string_split(source || ', ,' || lang || ' ,', ',')) as name from documents)
where trim(name) <> ''
""")
def task_names(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.concat(
        "source", F.lit(", ,"), "lang", F.lit(" ,")).alias("tasks"))
    return expand_names(rows, "tasks").select("doc_id", "name")


# the tables name languages by two letters, the family table by three
TAGGED = "case lang when 'en' then 'eng-Latn' when 'de' then 'deu-Latn' when 'fr' then 'fra-Latn' else lang end"


def tagged(lang):
    return (F.when(lang == "en", "eng-Latn").when(lang == "de", "deu-Latn")
            .when(lang == "fr", "fra-Latn").otherwise(lang))


@query(f"""
select d.doc_id, coalesce(f.family, 'Other') as family
from (select doc_id, split_part({TAGGED}, '-', 1) as head from documents) d
left join (values {values_sql(FAMILIES)}) f(lang, family) on f.lang = d.head
""")
def language_family(spark, sf):
    rows = documents(spark, sf).select("doc_id", lang_head(tagged(F.col("lang"))).alias("lang"))
    return with_family(rows, families(spark)).select("doc_id", "family")


@query("""
with v as (select ch, row_number() over (order by ch) as id
           from (select distinct ch from (select unnest(string_split(text, '')) as ch from documents)) where ch <> ''),
c as (select doc_id, unnest(string_split(text, '')) as ch from documents)
select c.doc_id, count(*) as n, round(sum(e.embedding[1]::double), 6) as first,
       round(sum(e.embedding[64]::double), 6) as last
from c join v on v.ch = c.ch join embeddings e on e.vec_id = v.id group by 1
""")
def token_vectors(spark, sf):
    docs = documents(spark, sf)
    tokens = [r["token"] for r in char_vocab(docs).orderBy("id").collect()]
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("int").alias("id"), F.col("embedding").alias("vector"))
    found = lookup_vectors(encode_chars(docs, tokens), vectors, 64)
    return found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(F.get("vector", 0).cast("double")), 6).alias("first"),
        F.round(F.sum(F.get("vector", 63).cast("double")), 6).alias("last"))


@query("""
with s as (select string_agg(text, '' order by doc_id) as stream, sum(length(text))::bigint as n from documents)
select doc_id, ((doc_id * 7919) % (n - 64))::bigint as at,
       substr(stream, ((doc_id * 7919) % (n - 64) + 1)::bigint, 64) as text
from documents, s
""")
def stream_windows(spark, sf):
    docs = documents(spark, sf)
    vocab = Vocabulary("char", [r["token"] for r in char_vocab(docs).orderBy("id").collect()])
    stream = token_stream(encode_chars(docs, vocab.tokens), size="n_tokens")
    n = token_total(stream, size="n_tokens")
    offsets = docs.select("doc_id", ((F.col("doc_id") * 7919) % (n - 64)).alias("at"))
    windows = windows_at(stream, offsets, 64, offset="at")
    return offsets.join(decode_corpus(windows, vocab, ids="window"), "doc_id").select(
        "doc_id", "at", "text")


@query("""
with s as (select l_orderkey, l_linenumber, l_extendedprice,
                  row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as rn
           from lineitem)
select s.l_orderkey, s.l_linenumber as pred, (length(o.o_orderpriority) % 7)::int as gold
from s join orders o on o.o_orderkey = s.l_orderkey where rn = 1
""")
def predictions_with_gold(spark, sf):
    scores = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    pred = argmax_choice(scores, ["l_orderkey"], "l_linenumber", "l_extendedprice")
    gold = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        (F.length("o_orderpriority") % 7).alias("gold"))
    return join_gold(pred, gold, "l_orderkey")


CELLS = """
select d.source, d.lang, round(avg(d.n_chars), 6) as score
from documents d join labels l on l.doc_id = d.doc_id where l.toxic = 1 group by 1, 2
"""


def _cells(spark, sf):
    toxic = table(spark, sf, "labels").where(F.col("toxic") == 1)
    return documents(spark, sf).join(toxic, "doc_id").groupBy("source", "lang").agg(
        F.round(F.avg("n_chars"), 6).alias("score"))


@query(f"""
with c as ({CELLS})
select s.source, g.lang, c.score from (select distinct source from c) s
cross join (select distinct lang from c) g left join c on c.source = s.source and c.lang = g.lang
""")
def score_grid(spark, sf):
    return dense_grid(_cells(spark, sf), "source", "lang", "score")


@query(f"""
with c as ({CELLS})
select source, max(score) filter (lang = 'de') as de, max(score) filter (lang = 'en') as en,
       max(score) filter (lang = 'es') as es, max(score) filter (lang = 'fr') as fr
from c group by source
""")
def score_grid_wide(spark, sf):
    return wide_grid(
        _cells(spark, sf), "source", "lang", "score", axis(documents(spark, sf), "lang"))
