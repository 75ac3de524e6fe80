"""Scans, sinks, projections, limits, budgets, unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.catalog import query
from corpuslab.functions.text import code_text, last_number, qa_text
from corpuslab.operators.corpus import (
    char_budget, char_counts, charset, coalesce_columns, distinct_values, head, head_per_group,
    max_chars, only_in, texts, union_corpora, with_reason,
)
from corpuslab.operators.encode import encode_chars
from corpuslab.operators.metrics import sorted_axis
from corpuslab.operators.pretokens import pretoken_counts, pretokens
from corpuslab.operators.tokens import split_tokens, token_counts
from corpuslab.operators.vocab import char_vocab
from corpuslab.plans.corpus_plan import corpus_report, training_corpus
from corpuslab.session import scratch_path
from corpuslab.sources.tables import (
    list_subsets, pick_split, read_corpus, read_tokens, table, write_corpus, write_tokens,
)

def budget(spark: SparkSession, sf: str) -> int:
    """Half of the corpus, in characters."""
    return table(spark, sf, "documents").agg(F.sum("n_chars")).first()[0] // 2


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_corpus(spark, f"{sf}/documents.parquet")


def qa_table(spark: SparkSession, sf: str) -> DataFrame:
    """User turns as questions, the turn after as answer."""
    turns = table(spark, sf, "conversations")
    asked = turns.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question"))
    said = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(said, ["conv_id", "turn"])


QA = """
select q.conv_id, q.turn, q.text as question, a.text as answer
from conversations q join conversations a
  on a.conv_id = q.conv_id and a.turn = q.turn + 1 and a.role = 'assistant'
where q.role = 'user'
"""
# rows inside the character budget, the row across it cut
BUDGETED = """
select doc_id, lang, source, left(text, least(half - before, length(text))::bigint) as text
from (select *, sum(length(text)) over (order by doc_id) - length(text) as before from documents),
     (select sum(n_chars)::bigint // 2 as half from documents)
where before < half
"""


@query(f"""
with kept as (select * from ({BUDGETED}) where length(text) <= 1000),
chars as (select lang, unnest(string_split(text, '')) as ch from kept)
select k.lang, k.docs, k.chars, c.distinct_chars
from (select lang, count(*) as docs, sum(length(text))::bigint as chars from kept group by lang) k
join (select lang, count(distinct ch) as distinct_chars from chars where ch <> '' group by lang) c
  on c.lang = k.lang
""")
def corpus_by_language(spark, sf):
    return corpus_report(training_corpus(documents(spark, sf), budget(spark, sf)))


@query("select doc_id, lang, md5(text) as digest, length(text)::int as n from documents")
def corpus_scan(spark, sf):
    return documents(spark, sf).select("doc_id", "lang", F.md5("text").alias("digest"), F.length("text").alias("n"))


@query("select doc_id, lang as split, n_chars from documents where lang = 'es'")
def benchmark_split(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.col("lang").alias("split"), "n_chars")
    return pick_split(rows, ("test", "es"))


@query("select distinct source from documents")
def subsets(spark, sf):
    return list_subsets(documents(spark, sf), "source")


@query("select doc_id, lang, md5(text) as digest from documents")
def corpus_written(spark, sf):
    path = scratch_path(spark, "corpus")
    write_corpus(documents(spark, sf), path)
    return read_corpus(spark, path).select("doc_id", "lang", F.md5("text").alias("digest"))


@query("""
with d as (select doc_id, length(text) as n, sum(length(text)) over (order by doc_id) - length(text) as b
           from documents),
t as (select floor(sum(n)::double * 0.9::double)::bigint as cut from d)
select 'train' as split, count(*) as docs, sum(least(n, cut - b))::bigint as tokens, max(b)::bigint as last_start
from d, t where b < cut and n > 0
union all
select 'val', count(*), sum(b + n - greatest(b, cut))::bigint, max(greatest(b, cut) - cut)::bigint
from d, t where b + n > cut and n > 0
""")
def token_shards_written(spark, sf):
    docs = documents(spark, sf)
    tokens = [r["token"] for r in char_vocab(docs).orderBy("id").collect()]
    path = write_tokens(
        split_tokens(encode_chars(docs, tokens)), scratch_path(spark, "shards"), "char", "all")
    return read_tokens(spark, path).groupBy("split").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.size("tokens")).alias("tokens"),
        F.max("start").alias("last_start"))


@query("""
with d as (select doc_id, length(text) as n, sum(length(text)) over (order by doc_id) - length(text) as b
           from documents),
t as (select floor(sum(n)::double * 0.9::double)::bigint as cut from d)
select doc_id, 'train' as split, b::bigint as start, least(n, cut - b)::int as n_tokens
from d, t where b < cut and n > 0
union all
select doc_id, 'val', (greatest(b, cut) - cut)::bigint, (b + n - greatest(b, cut))::int
from d, t where b + n > cut and n > 0
""")
def token_split(spark, sf):
    docs = documents(spark, sf)
    tokens = [r["token"] for r in char_vocab(docs).orderBy("id").collect()]
    return split_tokens(encode_chars(docs, tokens)).select(
        "doc_id", "split", "start", F.size("tokens").alias("n_tokens"))


@query("""
select lang as split, sum(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')))::bigint as tokens
from documents group by lang
""")
def token_totals(spark, sf):
    rows = documents(spark, sf).select(
        F.col("lang").alias("split"), pretokens(F.col("text"), "whitespace").alias("tokens"))
    return token_counts(rows)


@query("select md5(text) as digest, length(text)::int as n from (select html as text from pages)")
def text_projection(spark, sf):
    return texts(table(spark, sf, "pages"), "html").select(
        F.md5("text").alias("digest"), F.length("text").alias("n"))


@query(f"""
select conv_id, turn, md5('Q:' || chr(10) || question || chr(10) || chr(10) || 'A:' || chr(10) || answer) as digest
from ({QA})
""")
def qa_texts(spark, sf):
    rows = qa_table(spark, sf)
    return rows.select("conv_id", "turn", F.md5(qa_text(rows)).alias("digest"))


@query("""
select page_id, md5('# Prompt' || chr(10) || url || chr(10) || chr(10) || '# Solution' || chr(10) || html) as digest
from pages
""")
def code_texts(spark, sf):
    rows = table(spark, sf, "pages").select(
        "page_id", F.col("url").alias("prompt"), F.col("html").alias("solution"))
    return rows.select("page_id", F.md5(code_text(rows)).alias("digest"))


@query("select conv_id, turn, md5(text) as digest from conversations where role in ('user', 'assistant')")
def column_aliases(spark, sf):
    turns = table(spark, sf, "conversations")
    rows = turns.select(
        "conv_id", "turn",
        F.when(F.col("role") == "user", F.col("text")).alias("soru"),
        F.when(F.col("role") == "assistant", F.col("text")).alias("text"))
    return coalesce_columns(rows, ["question", "soru", "text"], "stem").select(
        "conv_id", "turn", F.md5("stem").alias("digest"))


@query("select doc_id, n_chars from documents where length(text) <= 1000")
def length_filter(spark, sf):
    return max_chars(documents(spark, sf), 1000).select("doc_id", "n_chars")


@query("""
select l_orderkey, l_linenumber, l_partkey from lineitem
order by l_orderkey, l_linenumber, l_partkey limit 1000
""")
def first_rows(spark, sf):
    return head(table(spark, sf, "lineitem"), 1000, ["l_orderkey", "l_linenumber", "l_partkey"]).select(
        "l_orderkey", "l_linenumber", "l_partkey")


@query("""
select l_suppkey, l_orderkey, l_linenumber from (
  select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) as rn from lineitem)
where rn <= 5
""")
def first_rows_per_group(spark, sf):
    return head_per_group(
        table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber"),
        ["l_suppkey"], 5, ["l_orderkey", "l_linenumber"])


@query("select doc_id, lang from documents where lang in ('de', 'fr')")
def chosen_languages(spark, sf):
    return only_in(documents(spark, sf), "lang", ["de", "fr"]).select("doc_id", "lang")


@query("""
select case when length(d.text) > 2048 then 'prompt too long'
            when l.quality is null then 'gold not parseable'
            when l.quality + l.toxic > 1 then 'gold out of range' else 'good' end as reason,
       count(*) as n
from documents d left join labels l on l.doc_id = d.doc_id group by 1
""")
def validity_counts(spark, sf):
    rows = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    marked = with_reason(rows, [
        ("prompt too long", F.length("text") > 4 * 512),
        ("gold not parseable", F.col("quality").isNull()),
        ("gold out of range", F.col("quality") + F.col("toxic") > 1),
    ])
    return marked.groupBy(F.coalesce("reason", F.lit("good")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"))


@query("""
with x as (select doc_id, lang, list_extract(regexp_extract_all(text, '-?[0-9]+(?:\\.[0-9]+)?'), -1) as num from documents)
select lang, case when try_cast(num as double) is null then 'not a number'
                  when try_cast(num as double) > 1000 then 'too large' else 'good' end as reason,
       count(*) as n
from x group by 1, 2
""")
def row_isolation(spark, sf):
    number = last_number(F.col("text")).try_cast("double")
    marked = with_reason(documents(spark, sf).withColumn("num", number), [
        ("not a number", F.col("num").isNull()), ("too large", F.col("num") > 1000)])
    return marked.groupBy("lang", F.coalesce("reason", F.lit("good")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"))


@query(f"select doc_id, length(text)::int as n, md5(text) as digest from ({BUDGETED})")
def character_budget(spark, sf):
    return char_budget(documents(spark, sf), "doc_id", budget(spark, sf)).select(
        "doc_id", F.length("text").alias("n"), F.md5("text").alias("digest"))


@query(f"""
with u as (
  select 'corpus' as source, text from ({BUDGETED})
  union all
  select 'qa', 'Q:' || chr(10) || question || chr(10) || chr(10) || 'A:' || chr(10) || answer from ({QA})
  union all
  select 'code', '# Prompt' || chr(10) || url || chr(10) || chr(10) || '# Solution' || chr(10) || html from pages)
select source, count(*) as docs, sum(length(text))::bigint as chars, min(md5(text)) as digest
from u where length(text) <= 1000 group by source
""")
def corpus_union(spark, sf):
    code = table(spark, sf, "pages").select(F.col("url").alias("prompt"), F.col("html").alias("code"))
    union = union_corpora(
        char_budget(documents(spark, sf), "doc_id", budget(spark, sf)), qa_table(spark, sf), code)
    return union.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars"),
        F.min(F.md5("text")).alias("digest"))


@query("select distinct event_type from events")
def distinct_event_types(spark, sf):
    return distinct_values(table(spark, sf, "events"), "event_type")


@query("select lang, count(*) as docs, sum(length(text))::bigint as chars from documents group by lang")
def character_totals(spark, sf):
    return char_counts(documents(spark, sf), ["lang"])


@query("""
select distinct lang, ch from (select lang, unnest(string_split(text, '')) as ch from documents) where ch <> ''
""")
def character_sets(spark, sf):
    return charset(documents(spark, sf), ["lang"])


@query("select distinct source from documents order by source")
def source_axis(spark, sf):
    return sorted_axis(documents(spark, sf), "source")


@query("""
select word, count(*) as freq
from (select unnest(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) as word from documents) group by word
""")
def word_counts(spark, sf):
    return pretoken_counts(documents(spark, sf), pretokens(F.col("text"), "whitespace"))


# No look-ahead in this regex dialect: a mark is put before the last blank of a run that
# a word follows, then blank runs end at the mark.
@query("""
with marked as (
  select regexp_replace(text, '(\\s+)(\\s\\S)', '\\1' || chr(1) || '\\2', 'g') as text from documents),
words as (
  select unnest(regexp_extract_all(text,
    '''s|''t|''re|''ve|''m|''ll|''d| ?\\pL+| ?\\pN+| ?[^\\s\\pL\\pN\\x01]+|\\s+')) as word from marked)
select word, count(*) as freq from words group by word
""")
def byte_level_word_counts(spark, sf):
    return pretoken_counts(documents(spark, sf), pretokens(F.col("text"), "byte"))
