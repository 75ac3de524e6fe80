"""Running values, smoothing, and operators over weight distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.catalog import query
from corpuslab.catalog.corpus import documents
from corpuslab.operators.dist import log_softmax, nucleus, softmax, top_k_ties, weighted_draw
from corpuslab.operators.metrics import (
    ema, first_details, running_best, running_mean, running_skips, sort_by,
)
from corpuslab.operators.pretokens import assign_ids
from corpuslab.sources.tables import table


def events(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")


@query("""
with r as (
  select event_type, event_id, row_number() over w as n, avg(value) over w as m,
         count(*) over (partition by event_type) as total
  from events window w as (partition by event_type order by event_id rows unbounded preceding))
select event_type, event_id, n, round(m, 6) as running_mean from r
where n % 50 = 0 or n <= 10 or n = total
""")
def running_means(spark, sf):
    rows = running_mean(events(spark, sf), ["event_type"], ["event_id"], "value", every=50, first=10)
    return rows.select("event_type", "event_id", "n", F.round("running_mean", 6).alias("running_mean"))


@query("""
with r as (
  select lang, doc_id, row_number() over w as n, sum((length(text) > 2048)::int) over w as s,
         (length(text) > 2048)::int as bad
  from documents window w as (partition by lang order by doc_id rows unbounded preceding))
select lang, doc_id, n - 1 as done, (s - bad)::bigint as skipped from r where (n - 1) % 100 = 0
""")
def skip_progress(spark, sf):
    rows = documents(spark, sf).select("lang", "doc_id", (F.length("text") > 4 * 512).alias("long"))
    return running_skips(rows, ["lang"], ["doc_id"], F.col("long")).drop("long")


@query("""
select l_returnflag, l_orderkey, l_linenumber, l_quantity from (
  select *, rank() over (partition by l_returnflag order by l_quantity desc) as r from lineitem)
where r <= 100
""")
def top_values_with_ties(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity")
    return top_k_ties(rows, ["l_returnflag"], "l_quantity", 100, ["l_orderkey", "l_linenumber"])


@query("""
with w as (select user_id, event_id, value as weight from events where value > 0),
c as (select *, sum(weight) over (partition by user_id order by weight desc, event_id rows unbounded preceding) as cum,
             row_number() over (partition by user_id order by weight desc, event_id) as rn,
             sum(weight) over (partition by user_id) as total from w),
k as (select * from c where rn = 1 or cum <= 0.9::double * total)
select user_id, event_id, round(weight / sum(weight) over (partition by user_id), 9) as prob from k
""")
def nucleus_filter(spark, sf):
    rows = events(spark, sf).where(F.col("value") > 0).select(
        "user_id", "event_id", F.col("value").alias("weight"))
    return nucleus(rows, ["user_id"], "weight", 0.9, ["event_id"]).select(
        "user_id", "event_id", F.round("prob", 9).alias("prob"))


LOGITS = """
select event_type, event_id, value / 0.7::double as z, max(value / 0.7::double) over (partition by event_type) as peak from events
"""


@query(f"""
select event_type, event_id, round(exp(z - peak) / sum(exp(z - peak)) over (partition by event_type), 12) as prob
from ({LOGITS})
""")
def softmax_weights(spark, sf):
    rows = events(spark, sf).select("event_type", "event_id", "value")
    return softmax(rows, ["event_type"], "value", ["event_id"], 0.7).select(
        "event_type", "event_id", F.round("prob", 12).alias("prob"))


@query(f"""
select event_type, event_id, round(z - peak - ln(sum(exp(z - peak)) over (partition by event_type)), 6) as logprob
from ({LOGITS})
""")
def log_softmax_weights(spark, sf):
    rows = events(spark, sf).select("event_type", "event_id", "value")
    return log_softmax(rows, ["event_type"], "value", ["event_id"], 0.7).select(
        "event_type", "event_id", F.round("logprob", 6).alias("logprob"))


@query("""
with d as (select user_id, event_id, value,
                  -ln((('0x' || substr(md5('1337:' || event_id), 1, 13))::bigint + 0.5::double) / 4503599627370496::double) / value as race
           from events where value > 0)
select user_id, arg_min(event_id, race) as event_id, arg_min(value, race) as value from d group by 1
""")
def drawn_rows(spark, sf):
    rows = events(spark, sf).select("user_id", "event_id", "value")
    return weighted_draw(rows, ["user_id"], "value", 1337, ["event_id"])


@query("""
with s as (select event_type, event_id, list(value) over (
  partition by event_type order by event_id rows unbounded preceding) as seen from events)
select event_type, event_id, round(list_reduce(seen, lambda a, x: 0.9::double * a + 0.1::double * x), 6) as ema from s
""")
def smoothed_series(spark, sf):
    rows = events(spark, sf).select("event_type", "event_id", "value")
    return ema(rows, ["event_type"], ["event_id"], "value", 0.1).select(
        "event_type", "event_id", F.round("ema", 6).alias("ema"))


@query("""
select event_type, event_id, min(value) over (
  partition by event_type order by event_id rows unbounded preceding) as best from events
""")
def best_so_far(spark, sf):
    return running_best(events(spark, sf), ["event_type"], ["event_id"], "value").select(
        "event_type", "event_id", "best")


@query("""
select token, (row_number() over (order by token) + 1)::int as id from (select distinct p_name as token from part)
union all select '<unk>', 0 union all select '<pad>', 1
""")
def dense_ids(spark, sf):
    return assign_ids(
        table(spark, sf, "part").select(F.col("p_name").alias("token")), ["<unk>", "<pad>"])


@query("select lang, count(*) as docs from documents group by lang order by lang")
def sorted_counts(spark, sf):
    return sort_by(documents(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("docs")), "lang")


@query("select event_id, event_type, value from events order by event_id limit 10")
def first_detail_rows(spark, sf):
    return first_details(events(spark, sf), ["event_id"]).select("event_id", "event_type", "value")
