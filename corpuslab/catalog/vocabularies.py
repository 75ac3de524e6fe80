"""Learned vocabularies, encoding and decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.catalog import query
from corpuslab.catalog.corpus import documents
from corpuslab.operators.encode import decode_corpus, encode_corpus
from corpuslab.operators.vocab import (
    Vocabulary, char_vocab, eos_id, train_bpe, train_unigram, train_wordpiece, vocab_size,
)
from corpuslab.plans.corpus_plan import token_shards

CHARS = """
select distinct ch from (select unnest(string_split(text, '')) as ch from documents) where ch <> ''
"""
_LEARNED: dict[tuple, Vocabulary] = {}


def learned(spark, sf, train) -> Vocabulary:
    """A vocabulary at the operator's own size, learned once per session and corpus."""
    key = (spark.sparkContext.applicationId, sf, train.__name__)
    if key not in _LEARNED:
        _LEARNED[key] = train(documents(spark, sf))
    return _LEARNED[key]


@query(f"""
select '<unk>' as token, 0 as id
union all select ch, row_number() over (order by ch)::int from ({CHARS})
""")
def char_vocabulary(spark, sf):
    return char_vocab(documents(spark, sf))


@query(f"""
with v as (select ch, row_number() over (order by ch) as id from ({CHARS}))
select doc_id, count(*)::int as n, sum(v.id)::bigint as total, max(v.id)::int as largest
from (select doc_id, unnest(string_split(text, '')) as ch from documents) d join v on v.ch = d.ch
group by doc_id
""")
def char_encoded(spark, sf):
    docs = documents(spark, sf)
    vocab = Vocabulary("char", [r["token"] for r in char_vocab(docs).orderBy("id").collect()])
    ids = encode_corpus(docs, vocab)
    return ids.select(
        "doc_id", F.size("tokens").alias("n"),
        F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
        F.array_max("tokens").alias("largest"))


@query("select doc_id, md5(text) as digest from documents")
def char_decoded(spark, sf):
    docs = documents(spark, sf)
    vocab = Vocabulary("char", [r["token"] for r in char_vocab(docs).orderBy("id").collect()])
    return decode_corpus(encode_corpus(docs, vocab), vocab).select("doc_id", F.md5("text").alias("digest"))


@query(f"""
select (count(*) + 1)::bigint as size, null::int as eos_id from ({CHARS})
""")
def vocabulary_size(spark, sf):
    vocab = char_vocab(documents(spark, sf))
    size = vocab_size(vocab).first()["size"]
    return eos_id(vocab).select(F.lit(size).cast("long").alias("size"), "eos_id")


@query()
def bpe_merges(spark, sf):
    return learned(spark, sf, train_bpe).merge_table(spark)


@query("select doc_id, md5(text) as digest from documents")
def bpe_decoded(spark, sf):
    """Learn, encode, decode: byte-level text comes back whole."""
    docs = documents(spark, sf)
    vocab = learned(spark, sf, train_bpe)
    return decode_corpus(encode_corpus(docs, vocab), vocab).select("doc_id", F.md5("text").alias("digest"))


@query()
def bpe_token_shards(spark, sf):
    docs = documents(spark, sf)
    shards = token_shards(docs, learned(spark, sf, train_bpe))
    return shards.groupBy("split").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.size("tokens")).alias("tokens"))


@query()
def wordpiece_merges(spark, sf):
    return learned(spark, sf, train_wordpiece).merge_table(spark)


@query()
def wordpiece_encoded(spark, sf):
    docs = documents(spark, sf)
    ids = encode_corpus(docs, learned(spark, sf, train_wordpiece))
    return ids.select("doc_id", F.size("tokens").alias("n"))


@query()
def unigram_pieces(spark, sf):
    return learned(spark, sf, train_unigram).piece_table(spark)


@query()
def unigram_encoded(spark, sf):
    docs = documents(spark, sf)
    ids = encode_corpus(docs, learned(spark, sf, train_unigram))
    return ids.select("doc_id", F.size("tokens").alias("n"))
