"""Prompts, answer extraction, clean-up and array functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.catalog import query
from corpuslab.catalog.corpus import QA, documents, qa_table
from corpuslab.functions.arrays import finite, keep_first, keep_last, l2_normalize, masked_mean, xy_pair
from corpuslab.functions.text import (
    answers_match, cue_number, cut_at, dir_to_model, ending_context, extract_number, fmt,
    gold_number, labels, lang_head, last_number, mcq_prompt, model_to_dir, normalize_text,
    numeric_prompt, parse_gold, preview, strip, strip_echo,
)
from corpuslab.operators.pretokens import pretokens
from corpuslab.operators.scoring import expand_choices, fit_prompt
from corpuslab.operators.tokens import add_specials
from corpuslab.sources.tables import table

# Four benchmark texts for every user turn, chosen by arithmetic on its ids.
CHOICES = """
with asked as (select conv_id * 100 + turn as item, text as question from conversations where role = 'user'),
size as (select count(*) as n from benchmark),
picked as (select a.item, any_value(a.question) as question, list(b.text order by s.i) as choices
           from asked a cross join (select unnest(range(0, 4)) as i) s cross join size
           join benchmark b on b.item_id = (a.item + s.i * 7) % size.n group by a.item)
"""


def choice_items(spark, sf):
    """``(item, question, choices)``; the benchmark is met by an equi-join on its id."""
    bench = table(spark, sf, "benchmark")
    size = bench.count()
    asked = table(spark, sf, "conversations").where(F.col("role") == "user").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("item"), F.col("text").alias("question"))
    slots = asked.select("item", "question", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).withColumn(
        "item_id", (F.col("item") + F.col("i") * 7) % size)
    return slots.join(bench, "item_id").groupBy("item", "question").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "text"))), lambda s: s["text"]).alias("choices"))


BODY = "'A. ' || choices[1] || chr(10) || 'B. ' || choices[2] || chr(10) || 'C. ' || choices[3] || chr(10) || 'D. ' || choices[4]"


@query(CHOICES + f"""
select item, md5(question || chr(10) || {BODY} || chr(10) || 'Answer:') as en,
       md5(question || chr(10) || {BODY} || chr(10) || 'Cevap:') as tr,
       md5('Question: ' || question || chr(10) || {BODY} || chr(10) || 'Answer: ') as full_form
from picked
""")
def choice_prompts(spark, sf):
    items = choice_items(spark, sf)
    q, c = F.col("question"), F.col("choices")
    return items.select(
        "item", F.md5(mcq_prompt(q, c, "en")).alias("en"), F.md5(mcq_prompt(q, c, "tr")).alias("tr"),
        F.md5(mcq_prompt(q, c, "full")).alias("full_form"))


@query("""
with w as (select doc_id, len(string_split(source, 'src')) + doc_id % 6 as n from documents)
select doc_id, array_to_string(list_transform(range(0, least(n, 30)), lambda i: chr((65 + i)::int)), '') as every,
       array_to_string(list_transform(range(0, least(n, 4)), lambda i: chr((65 + i)::int)), '') as capped
from w
""")
def choice_labels(spark, sf):
    n = F.size(F.split("source", "src")) + F.col("doc_id") % 6
    rows = documents(spark, sf).select("doc_id", F.array_repeat(F.lit("x"), n.cast("int")).alias("c"))
    return rows.select(
        "doc_id", F.array_join(labels(F.col("c")), "").alias("every"),
        F.array_join(labels(F.col("c"), 4), "").alias("capped"))


@query("""
with t as (select doc_id, case when doc_id % 3 = 0 then ' ' || left(lang, 1) || ' '
  when doc_id % 3 = 1 then (doc_id % 11)::varchar else source end as answer from documents)
select doc_id, case when upper(trim(answer)) in ('A','B','C','D','E') then ord(upper(trim(answer))) - 65
  else try_cast(trim(answer) as int) end as gold from t
""")
def gold_indexes(spark, sf):
    answer = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), F.left("lang", F.lit(1)), F.lit(" ")))
        .when(F.col("doc_id") % 3 == 1, (F.col("doc_id") % 11).cast("string")).otherwise(F.col("source")))
    return documents(spark, sf).select("doc_id", parse_gold(answer).alias("gold"))


WS = "e' \\n\\t\\r\\f\\x0b'"


@query(f"""
select conv_id, turn, md5(trim(question || ' ' || answer, {WS}) || ' ') as spaced, md5(question || answer) as joined
from ({QA})
""")
def ending_contexts(spark, sf):
    a, b = F.col("question"), F.col("answer")
    return qa_table(spark, sf).select(
        "conv_id", "turn", F.md5(ending_context(a, b)).alias("spaced"),
        F.md5(ending_context(a, b, "joined")).alias("joined"))


@query(f"""
select page_id, md5(trim(html, {WS}) || chr(10) || 'Answer:') as en,
       md5('Question: ' || trim(html, {WS}) || chr(10) || 'Answer:') as question,
       md5('Soru: ' || html || chr(10) || chr(10) || 'Çözüm:') as tr
from pages
""")
def numeric_prompts(spark, sf):
    q = F.col("html")
    return table(spark, sf, "pages").select(
        "page_id", F.md5(numeric_prompt(q, "en")).alias("en"),
        F.md5(numeric_prompt(q, "question")).alias("question"),
        F.md5(numeric_prompt(q, "tr")).alias("tr"))


@query("""
with p as (select page_id, regexp_extract(html, '####\\s*(-?[0-9]+(?:\\.[0-9]+)?)', 1) as marked,
  list_extract(regexp_extract_all(html, '-?[0-9]+(?:\\.[0-9]+)?'), -1) as last,
  list_extract(regexp_extract_all(html, '[+-]?[0-9]*\\.?[0-9]+'), -1) as decimal from pages)
select page_id, coalesce(nullif(marked, ''), last) as first_or_last, last, try_cast(decimal as double) as gold from p
""")
def page_numbers(spark, sf):
    t = F.col("html")
    return table(spark, sf, "pages").select(
        "page_id", extract_number(t).alias("first_or_last"), last_number(t).alias("last"),
        gold_number(t).alias("gold"))


# a completion for every event, in one of six phrasings
SAID = """
select event_id, event_type, user_id, value, case event_id % 6
  when 0 then 'Önce ' || user_id || ' sonra #### ' || value || ' tamam 3'
  when 1 then 'Toplam: ' || value || ' olur, yani ' || user_id
  when 2 then user_id || ' + 2 = ' || value || ' eder'
  when 3 then 'CEVAP ' || user_id || ' ya da cevap: ' || value
  when 4 then user_id || ' kişi ' || value || ' lira öder'
  else event_type || ' yok' end as said
from events
"""


def completions(spark, sf):
    v, u = F.col("value").cast("string"), F.col("user_id").cast("string")
    kind = F.col("event_id") % 6
    said = (
        F.when(kind == 0, F.concat(F.lit("Önce "), u, F.lit(" sonra #### "), v, F.lit(" tamam 3")))
        .when(kind == 1, F.concat(F.lit("Toplam: "), v, F.lit(" olur, yani "), u))
        .when(kind == 2, F.concat(u, F.lit(" + 2 = "), v, F.lit(" eder")))
        .when(kind == 3, F.concat(F.lit("CEVAP "), u, F.lit(" ya da cevap: "), v))
        .when(kind == 4, F.concat(u, F.lit(" kişi "), v, F.lit(" lira öder")))
        .otherwise(F.concat("event_type", F.lit(" yok"))))
    return table(spark, sf, "events").select(
        "event_id", "event_type", "user_id", "value", said.alias("said"))


NUM = "([+-]?[0-9]*\\.?[0-9]+)"
CUED = f"""coalesce(try_cast(nullif(regexp_extract(said, '####\\s*{NUM}', 1), '') as double),
  try_cast(list_extract(regexp_extract_all(said, '(?i)cevap[:\\s]*{NUM}', 1), -1) as double),
  try_cast(list_extract(regexp_extract_all(said, '(?i)sonuç[:\\s]*{NUM}', 1), -1) as double),
  try_cast(list_extract(regexp_extract_all(said, '(?i)toplam[:\\s]*{NUM}', 1), -1) as double),
  try_cast(list_extract(regexp_extract_all(said, '=\\s*{NUM}', 1), -1) as double),
  try_cast(list_extract(regexp_extract_all(said, '(?i){NUM}\\s*TL', 1), -1) as double),
  try_cast(list_extract(regexp_extract_all(said, '(?i){NUM}\\s*lira', 1), -1) as double),
  try_cast(list_extract(regexp_extract_all(said, '(?i){NUM}\\s*kilogram', 1), -1) as double),
  try_cast(list_extract(regexp_extract_all(said, '(?i){NUM}\\s*metre', 1), -1) as double),
  try_cast(list_extract(regexp_extract_all(said, '(?i){NUM}\\s*saat', 1), -1) as double),
  try_cast(list_extract(regexp_extract_all(said, '(?i){NUM}\\s*dakika', 1), -1) as double),
  try_cast(list_extract(regexp_extract_all(said, '{NUM}', 1), -1) as double))"""


@query(f"""
select event_id, {CUED} as cued, abs(coalesce({CUED}, 0) - value) < 1e-6::double as numeric_match,
       coalesce(list_extract(regexp_extract_all(said, '-?[0-9]+(?:\\.[0-9]+)?'), -1) = value::varchar, false) as text_match
from ({SAID})
""")
def cued_answers(spark, sf):
    said = F.col("said")
    return completions(spark, sf).select(
        "event_id", cue_number(said).alias("cued"),
        answers_match(cue_number(said), F.col("value"), "number").alias("numeric_match"),
        answers_match(last_number(said), F.col("value").cast("string")).alias("text_match"))


WORDS = "regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')"


@query(f"""
select doc_id, md5(array_to_string(w[greatest(len(w) - 1022, 1):], ' ')) as last_words,
       md5(array_to_string(w[1:512], ' ')) as first_words
from (select doc_id, {WORDS} as w from documents)
""")
def clipped_ids(spark, sf):
    rows = documents(spark, sf).select("doc_id", pretokens(F.col("text"), "whitespace").alias("w"))
    return rows.select(
        "doc_id", F.md5(F.array_join(keep_last(F.col("w"), 1023), " ")).alias("last_words"),
        F.md5(F.array_join(keep_first(F.col("w"), 512), " ")).alias("first_words"))


def byte_split(text: str) -> str:
    """The byte-level split; a mark before the last blank of a run stands for look-ahead."""
    return (f"regexp_extract_all(regexp_replace({text}, '(\\s+)(\\s\\S)', '\\1' || chr(1) || '\\2', 'g'), "
            "'''s|''t|''re|''ve|''m|''ll|''d| ?\\pL+| ?\\pN+| ?[^\\s\\pL\\pN\\x01]+|\\s+')")


# the cue has three tokens, which with ten to spare leaves the question 512 - 10 - 3
@query(f"""
with p as (select doc_id, 'Question: ' || text || chr(10) as head, 'Answer: ' as cue from documents),
h as (select *, {byte_split("head")} as w, len({byte_split("head || cue")}) as n from p),
c as (select doc_id, head || cue as whole, n, len(w) as m,
             array_to_string(w[greatest(len(w) - 498, 1):], '') || cue as cut from h),
f as (select doc_id, case when n >= 510 and m > 499 then
        case when contains(cut, ' ') then '...' || substr(cut, instr(cut, ' ')) else cut end
      else whole end as prompt from c),
k as (select doc_id, prompt, {byte_split("prompt")} as w from f)
select doc_id, case when len(w) > 510 then array_to_string(w[:510], '') else prompt end as prompt from k
""")
def fitted_prompts(spark, sf):
    prompt = F.concat(F.lit("Question: "), "text", F.lit("\nAnswer: "))
    return documents(spark, sf).select("doc_id", fit_prompt(prompt, 512).alias("prompt"))


@query("""
with c as (select page_id, html, least(coalesce(nullif(instr(html, chr(10) || '<p'), 0), 1000000000),
  coalesce(nullif(instr(html, '</h1>'), 0), 1000000000), length(html) + 1) as p from pages)
select page_id, md5(left(html, p - 1)) as kept, (p - 1)::int as n from c
""")
def stopped_texts(spark, sf):
    kept = cut_at(F.col("html"), ["\n<p", "</h1>"])
    return table(spark, sf, "pages").select(
        "page_id", F.md5(kept).alias("kept"), F.length(kept).alias("n"))


@query(f"""
select conv_id, turn, md5(trim(answer, {WS})) as rest from ({QA})
""")
def stripped_echoes(spark, sf):
    rows = qa_table(spark, sf).withColumn("said", F.concat("question", F.lit(" \n"), "answer"))
    return rows.select("conv_id", "turn", F.md5(strip_echo(F.col("said"), F.col("question"))).alias("rest"))


@query("""
select page_id, case when length(html) > 200 then left(html, 200) || '...' else html end as preview from pages
""")
def previews(spark, sf):
    return table(spark, sf, "pages").select("page_id", preview(F.col("html")).alias("preview"))


@query("""
select doc_id, source || '__' || lang as dir, source || '/' || lang as model,
       split_part(lang || '-' || source, '-', 1) as head
from documents
""")
def model_names(spark, sf):
    model = F.concat_ws("/", "source", "lang")
    return documents(spark, sf).select(
        "doc_id", model_to_dir(model).alias("dir"), dir_to_model(model_to_dir(model)).alias("model"),
        lang_head(F.concat_ws("-", "lang", "source")).alias("head"))


@query("""
select o_orderkey, format('{:,}', o_orderkey) as key_label, printf('%.3f', o_totalprice + 0.00001::double) as price
from orders
""")
def number_labels(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", fmt(F.col("o_orderkey"), 0, thousands=True).alias("key_label"),
        fmt(F.col("o_totalprice") + 0.00001, 3).alias("price"))


@query("""
with v as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
n as (select vec_id, v, greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12::double) as len from v)
select vec_id, round(v[1] / len, 6) as first, round(v[64] / len, 6) as last,
       round(list_sum(list_transform(v, lambda x: x / len)), 6) as total
from n
""")
def unit_vectors(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", l2_normalize(F.col("embedding")).alias("u"))
    return rows.select(
        "vec_id", F.round(F.get("u", 0), 6).alias("first"), F.round(F.get("u", 63), 6).alias("last"),
        F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("""
with v as (select vec_id, list_transform(embedding, lambda x: case when x > 0.2 then 'nan'::double
  when x < -0.2 then '-infinity'::double else x::double end) as v from embeddings)
select vec_id, round(list_sum(list_transform(v, lambda x: case when isfinite(x) then x else 0.0::double end)), 6) as total from v
""")
def finite_vectors(spark, sf):
    holed = F.transform("embedding", lambda x: F.when(x > F.lit(0.2).cast("double"), F.lit(float("nan")))
                        .when(x < F.lit(-0.2).cast("double"), F.lit(float("-inf")))
                        .otherwise(x.cast("double")))
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(
        finite(holed), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"""
select conv_id, turn, md5(trim(text, {WS})) as stripped from conversations
""")
def trimmed_texts(spark, sf):
    padded = F.concat(F.lit(" \n\t"), "text", F.lit("\r\n "))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.md5(strip(padded)).alias("stripped"))


@query("""
select doc_id, md5(regexp_replace(replace(replace(strip_accents(text), '``', '"'), '''''', '"'), ' {2,}', ' ', 'g')) as digest
from documents
""")
def normalised_texts(spark, sf):
    return documents(spark, sf).select(
        "doc_id", F.md5(normalize_text(F.col("text"), "sequence")).alias("digest"))


@query("""
select doc_id, md5(lower(strip_accents(regexp_replace(regexp_replace(
  text, '[\\t\\n\\r\\p{Zs}]', ' ', 'g'), '[\\p{Cc}\\p{Cf}]', '', 'g')))) as digest from documents
""")
def bert_normalised_texts(spark, sf):
    return documents(spark, sf).select(
        "doc_id", F.md5(normalize_text(F.col("text"), "bert")).alias("digest"))


@query(f"""
select doc_id, md5(array_to_string(w[1:len(w) - 1], ' ')) as x, md5(array_to_string(w[2:], ' ')) as y
from (select doc_id, {WORDS} as w from documents) where len(w) > 1
""")
def next_token_pairs(spark, sf):
    rows = documents(spark, sf).select(
        "doc_id", pretokens(F.col("text"), "whitespace").alias("w")).where(F.size("w") > 1)
    pair = rows.select("doc_id", xy_pair(F.col("w"), F.size("w") - 1).alias("p"))
    return pair.select("doc_id", F.md5(F.array_join("p.x", " ")).alias("x"), F.md5(
        F.array_join("p.y", " ")).alias("y"))


@query(CHOICES + """
select item, (i - 1)::int as idx, md5(choices[i]) as continuation
from (select item, choices, unnest(range(1, 5)) as i from picked)
""")
def expanded_choices(spark, sf):
    return expand_choices(choice_items(spark, sf).select("item", "choices"), "choices").select(
        "item", "idx", F.md5("continuation").alias("continuation"))


@query("""
with v as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
m as (select vec_id, [v[1:16], v[17:32], v[33:48], v[49:64]] as vs,
             [1.0::double, (v[1] > 0)::int::double, 0.0::double, 1.0::double] as mask from v)
select vec_id, round((vs[1][1] * mask[1] + vs[2][1] * mask[2] + vs[4][1]) / list_sum(mask), 6) as first,
  round((vs[1][16] * mask[1] + vs[2][16] * mask[2] + vs[4][16]) / list_sum(mask), 6) as last from m
""")
def masked_list_means(spark, sf):
    v = F.col("embedding").cast("array<double>")
    quarters = F.array(*[F.slice(v, 1 + 16 * i, 16) for i in range(4)])
    mask = F.array(F.lit(1.0), (F.get("embedding", 0) > 0).cast("int").cast("double"), F.lit(0.0), F.lit(1.0))
    rows = table(spark, sf, "embeddings").select("vec_id", masked_mean(quarters, mask, 16).alias("m"))
    return rows.select(
        "vec_id", F.round(F.get("m", 0), 6).alias("first"), F.round(F.get("m", 15), 6).alias("last"))


@query("""
with d as (select doc_id, list_transform(range(1, doc_id % 5 + 2), lambda i: (doc_id + i)::int) as a,
                  list_transform(range(1, doc_id % 3 + 2), lambda i: (doc_id * 2 + i)::int) as b from documents)
select doc_id,
  array_to_string([2] || a || [3] || b || [3], ',') as bert,
  array_to_string(list_concat([0], list_transform(a, lambda x: 0), [0], list_transform(b, lambda x: 1), [1]), ',') as bert_types,
  array_to_string(a || [1] || [0], ',') as xlnet,
  array_to_string(list_concat(list_transform(a, lambda x: 0), [0, 2]), ',') as xlnet_types
from d
""")
def special_tokens(spark, sf):
    d = F.col("doc_id")
    rows = documents(spark, sf).select(
        "doc_id",
        F.transform(F.sequence(F.lit(1), (d % 5 + 1).cast("int")), lambda i: (d + i).cast("int")).alias("a"),
        F.transform(F.sequence(F.lit(1), (d % 3 + 1).cast("int")), lambda i: (d * 2 + i).cast("int")).alias("b"))
    both = rows.select(
        "doc_id", add_specials(F.col("a"), F.col("b"), "bert", 2, 3).alias("p"),
        add_specials(F.col("a"), None, "xlnet", 0, 1).alias("s"))
    return both.select("doc_id", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(n) for c, n in (
        ("p.ids", "bert"), ("p.types", "bert_types"), ("s.ids", "xlnet"), ("s.types", "xlnet_types"))])
