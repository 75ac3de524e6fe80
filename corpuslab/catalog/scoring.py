"""Choice scoring, numeric answers, windows, sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.catalog import query
from corpuslab.catalog.corpus import documents
from corpuslab.catalog.metrics import labelled
from corpuslab.catalog.texts import CHOICES, CUED, SAID, choice_items, completions
from corpuslab.operators.encode import encode_chars
from corpuslab.operators.pretokens import pretokens
from corpuslab.operators.scoring import (
    BigramScorer, evaluate_choices, expand_choices, numeric_eval, score_continuations,
    score_labels, sweep,
)
from corpuslab.operators.tokens import sample_windows, split_tokens, token_stream
from corpuslab.operators.vocab import char_vocab
from corpuslab.plans.choice_plan import evaluate_mcq, loose_items
from corpuslab.plans.loss_plan import evaluate_loss

SPLIT = "regexp_extract_all({}, '[^ \\t\\n\\r\\f\\v]+')"
BIGRAMS = f"""
words as (select {SPLIT.format('text')} as w from documents),
pairs as (select w[i] as prev, w[i + 1] as tok, count(*) as n
          from (select w, unnest(range(1, len(w))) as i from words) group by 1, 2),
heads as (select prev, sum(n) as n from pairs group by 1),
vocab as (select count(distinct tok) as size from (select unnest(w) as tok from words))
"""
SCORED = CHOICES + f""", {BIGRAMS},
asks as (select item, i - 1 as idx, list_concat({SPLIT.format('question')}[-1:], {SPLIT.format('choices[i]')}) as t
         from (select item, question, choices, unnest(range(1, 5)) as i from picked)),
steps as (select item, idx, t[j] as prev, t[j + 1] as tok
          from (select item, idx, t, unnest(range(1, len(t))) as j from asks)),
scores as (select s.item, s.idx, sum(ln((coalesce(p.n, 0) + 1) / (coalesce(h.n, 0) + v.size)::double)) as score
           from steps s cross join vocab v left join pairs p on p.prev = s.prev and p.tok = s.tok
           left join heads h on h.prev = s.prev group by 1, 2)
"""


def _requests(spark, sf):
    rows = expand_choices(choice_items(spark, sf), "choices")
    return rows.select(
        "item", "idx", pretokens(F.col("question"), "whitespace").alias("context"),
        pretokens(F.col("continuation"), "whitespace").alias("continuation"))


def _scorer(spark, sf):
    return BigramScorer.train(documents(spark, sf), pretokens(F.col("text"), "whitespace"))


@query(SCORED + "select item, idx::int as idx, round(score, 6) as score from scores")
def continuation_scores(spark, sf):
    return score_continuations(_requests(spark, sf), _scorer(spark, sf)).select(
        "item", "idx", F.round("score", 6).alias("score"))


@query(CHOICES + f""", {BIGRAMS},
asks as (select item, i - 1 as idx, {SPLIT.format('question')}[-1] as prev, {SPLIT.format('choices[i]')}[1] as tok
         from (select item, question, choices, unnest(range(1, 5)) as i from picked))
select s.item, s.idx::int as idx,
       round(ln((coalesce(p.n, 0) + 1) / (coalesce(h.n, 0) + v.size)::double), 6) as score
from asks s cross join vocab v left join pairs p on p.prev = s.prev and p.tok = s.tok
left join heads h on h.prev = s.prev
""")
def label_scores(spark, sf):
    return score_labels(_requests(spark, sf), _scorer(spark, sf)).select(
        "item", "idx", F.round("score", 6).alias("score"))


@query(SCORED + """,
pred as (select item, arg_max(idx, (round(score, 9), -idx)) as pred from scores group by 1)
select 's' || (item % 7) as subject, round(avg((pred = item % 4)::int), 9) as accuracy, count(*) as n
from pred group by rollup ('s' || (item % 7))
""")
def ending_accuracy(spark, sf):
    scores = score_continuations(_requests(spark, sf), _scorer(spark, sf)).withColumn(
        "score", F.round("score", 9))
    gold = choice_items(spark, sf).select(
        "item", F.concat(F.lit("s"), (F.col("item") % 7).cast("string")).alias("subject"),
        (F.col("item") % 4).alias("gold"))
    return evaluate_choices(scores, gold, "subject").withColumn("accuracy", F.round("accuracy", 9))


# every prompt ends in a blank, so a letter's score is its count after a blank
@query(CHOICES + """,
best as (select arg_max(idx, (n, -idx)) as pred from (
  select i as idx, sum((length(text) - length(replace(text, ' ' || chr((65 + i)::int), ''))) / 2) as n
  from documents cross join range(0, 4) t(i) group by i))
select 's' || (item % 7) as subject, round(avg((pred = item % 4)::int), 9) as accuracy, count(*) as n
from picked cross join best group by rollup ('s' || (item % 7))
""")
def choice_accuracy(spark, sf):
    raw = choice_items(spark, sf).select(
        "item", F.concat(F.lit("s"), (F.col("item") % 7).cast("string")).alias("subject"),
        F.col("question").alias("soru"), "choices",
        F.char(F.lit(65) + F.col("item") % 4).alias("cevap"))
    good, _ = loose_items(raw)
    return evaluate_mcq(good, documents(spark, sf), style="tr", mode="char").withColumn(
        "accuracy", F.round("accuracy", 9))


@query(f"""
select user_id, round(avg(coalesce(coalesce(nullif(regexp_extract(said, '####\\s*(-?[0-9]+(?:\\.[0-9]+)?)', 1), ''),
    list_extract(regexp_extract_all(said, '-?[0-9]+(?:\\.[0-9]+)?'), -1)) = value::varchar, false)::int), 9) as accuracy,
  count(*) as n
from ({SAID}) group by 1
""")
def numeric_accuracy_marked(spark, sf):
    rows = completions(spark, sf).select(
        "user_id", F.concat(F.lit("x #### "), F.col("value").cast("string")).alias("answer"),
        F.col("said").alias("completion"))
    return numeric_eval(rows, "marked", ["user_id"]).withColumn("accuracy", F.round("accuracy", 9))


@query(f"""
select user_id, round(avg(coalesce(list_extract(regexp_extract_all(said, '-?[0-9]+(?:\\.[0-9]+)?'), -1)
  = value::varchar, false)::int), 9) as accuracy, count(*) as n
from ({SAID}) group by 1
""")
def numeric_accuracy_last(spark, sf):
    rows = completions(spark, sf).select(
        "user_id", F.concat(F.lit("x "), F.col("value").cast("string")).alias("answer"),
        F.col("said").alias("completion"))
    return numeric_eval(rows, "last", ["user_id"]).withColumn("accuracy", F.round("accuracy", 9))


@query(f"""
select user_id, round(avg((abs(coalesce({CUED}, 0) - value) < 1e-6::double)::int), 9) as accuracy, count(*) as n
from ({SAID}) where event_type <> 'error' group by 1
""")
def numeric_accuracy_cued(spark, sf):
    # an error event has no number in its answer, so its row is not counted
    answer = F.when(F.col("event_type") != "error", F.concat(
        F.lit("#### "), F.col("value").cast("string"))).otherwise("yok")
    rows = completions(spark, sf).select(
        "user_id", F.lit("soru").alias("question"), answer.alias("answer"), F.col("said").alias("completion"))
    return numeric_eval(rows, "cued", ["user_id"]).withColumn("accuracy", F.round("accuracy", 9))


@query("""
with v as (select ch, row_number() over (order by ch) as id
           from (select distinct ch from (select unnest(string_split(text, '')) as ch from documents)) where ch <> ''),
s as (select string_agg(text, '' order by doc_id) as stream, sum(length(text))::bigint as n from documents),
o as (select i as sample, ('0x' || substr(md5('1337:' || i), 1, 13))::bigint % (n - 256) as place, stream
      from s cross join (select unnest(range(0, 2400)) as i)),
w as (select sample, place, unnest(range(0, 257)) as p, unnest(string_split(substr(stream, (place + 1)::bigint, 257), '')) as ch from o)
select sample, place::bigint as offset_at, md5(string_agg(v.id, ',' order by p) filter (p < 256)) as x,
       md5(string_agg(v.id, ',' order by p) filter (p > 0)) as y
from w join v on v.ch = w.ch group by 1, 2
""")
def sampled_windows(spark, sf):
    docs = documents(spark, sf)
    tokens = [r["token"] for r in char_vocab(docs).orderBy("id").collect()]
    rows = sample_windows(token_stream(encode_chars(docs, tokens)), 200 * 12, 256, 1337)
    joined = lambda c: F.md5(F.array_join(F.transform(c, lambda i: i.cast("string")), ","))
    return rows.select(
        "sample", F.col("offset").alias("offset_at"), joined("x").alias("x"), joined("y").alias("y"))


@query("""
select d.source as model, d.lang as language, round(avg((1 - l.toxic = l.quality)::int), 9) as accuracy,
       count(*) as total_samples, round(sum(d.n_chars / 1000), 6) as elapsed_time, null::varchar as error
from labels l join documents d on d.doc_id = l.doc_id group by 1, 2
""")
def language_sweep(spark, sf):
    rows = labelled(spark, sf).join(
        documents(spark, sf).select("doc_id", (F.col("n_chars") / 1000).alias("seconds")), "doc_id")
    out = sweep(rows.withColumnsRenamed({"source": "model", "lang": "language"}), "pred", "quality", seconds="seconds")
    return out.withColumn("accuracy", F.round("accuracy", 9)).withColumn(
        "elapsed_time", F.round("elapsed_time", 6))


@query("""
with c as (select doc_id, string_split(text, '') as w from documents),
pairs as (select w[i] as prev, w[i + 1] as tok, count(*) as n
          from (select w, unnest(range(1, len(w))) as i from c) group by 1, 2),
heads as (select prev, sum(n) as n from pairs group by 1),
vocab as (select count(distinct ch) as size from (select unnest(w) as ch from c) where ch <> ''),
s as (select string_agg(text, '' order by doc_id) as stream, sum(length(text))::bigint as n,
             floor(sum(length(text)) * 0.9::double)::bigint as cut from documents),
p as (select 'train' as split, 0::bigint as low, cut as n, stream from s
      union all select 'val', cut, n - cut, stream from s),
t as (select split, i as sample, string_split(substr(stream, (low + ('0x' || substr(md5('1337:' || i), 1, 13))::bigint % (n - 64) + 1)::bigint, 65), '') as w
      from p cross join (select unnest(range(0, 200)) as i)),
steps as (select split, sample, w[j] as prev, w[j + 1] as tok
          from (select *, unnest(range(1, 65)) as j from t)),
losses as (select s.split, s.sample, -sum(ln((coalesce(a.n, 0) + 1) / (coalesce(h.n, 0) + v.size)::double)) / 64 as loss
           from steps s cross join vocab v left join pairs a on a.prev = s.prev and a.tok = s.tok
           left join heads h on h.prev = s.prev group by 1, 2)
select split, round(avg(loss), 6) as loss, count(*) as batches, round(exp(avg(loss)), 5) as perplexity
from losses group by 1
""")
def sampled_loss(spark, sf):
    docs = documents(spark, sf)
    tokens = [r["token"] for r in char_vocab(docs).orderBy("id").collect()]
    encoded = encode_chars(docs, tokens)
    scorer = BigramScorer.train(encoded, F.col("tokens"))
    summary, _ = evaluate_loss(split_tokens(encoded), scorer, 200, 64)
    return summary.select(
        "split", F.round("loss", 6).alias("loss"), "batches", F.round("perplexity", 5).alias("perplexity"))
