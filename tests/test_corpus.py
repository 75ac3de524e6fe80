import random

import pytest
from pyspark.sql import functions as F

from corpuslab.operators.corpus import (
    char_budget, charset, coalesce_columns, head_per_group, union_corpora, validate,
)
from corpuslab.operators.lookup import dense_grid, expand_aliases, spread_join
from corpuslab.operators.prefix import locate, running


def budget_by_hand(rows, limit):
    out, before = [], 0
    for i, text in sorted(rows):
        if before < limit:
            out.append((i, text[: limit - before]))
        before += len(text)
    return out


@pytest.mark.parametrize("limit", [0, 1, 7, 50, 333, 10**10])
def test_budget_by_hand(spark, limit):
    rng = random.Random(limit)
    ids = rng.sample(range(-10**15, 10**15), 20) + list(range(40))
    rows = [(i, "é😀x"[i % 3] * rng.randrange(0, 12)) for i in ids]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r[0], r[1]) for r in char_budget(df, "doc_id", limit).collect())
    want = budget_by_hand(rows, limit)
    assert got == want


def test_locate(spark):
    df = spark.createDataFrame([(5, 3), (9, 0), (10**12, 4)], "k bigint, n int")
    assert locate(df, "k", F.col("n"), 3) == (5, 0)
    assert locate(df, "k", F.col("n"), 4) == (10**12, 3)
    assert locate(df, "k", F.col("n"), 8) is None


def test_budget_moves_no_text(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    plan = char_budget(spark.read.parquet(path), "doc_id", 100_000)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "LessThanOrEqual(doc_id" in plan


def test_running_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(None if k == 3 else f"k{k}", i, rng.randrange(100)) for i in range(2000)
            for k in [0 if rng.random() < 0.4 else rng.randrange(5)]]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    got = {(r.k, r.o): (r.s, r.lo, r.hi) for r in running(df, ["o"], {
        "s": (F.col("v"), "sum"), "lo": (F.col("v"), "min"), "hi": (F.col("v"), "max")}, ["k"]).collect()}
    state, want = {}, {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        s, lo, hi = state.get(k, (0, 10**9, -1))
        state[k] = want[(k, o)] = (s + v, min(lo, v), max(hi, v))
    assert got == want


def test_running_keeps_rows_off_one_task(spark):
    df = spark.range(1000).withColumn("payload", F.lit("x"))
    plan = running(df, ["id"], {"s": (F.col("id"), "sum")})._jdf.queryExecution().executedPlan().toString()
    carried = plan[plan.index("BroadcastExchange"):]
    assert "SinglePartition" not in plan[: plan.index("BroadcastExchange")]
    assert "payload" not in carried.split("SinglePartition")[0]


def test_aliases(spark):
    names = spark.createDataFrame([(" MGPT ,x/Y,, xlmr",)], "models string")
    table = spark.createDataFrame([("mgpt", "a/mGPT"), ("xlmr", "xlm")], "alias string, id string")
    got = sorted(r[0] for r in expand_aliases(names, "models", table).select("model_id").collect())
    assert got == ["", "a/mGPT", "x/Y", "xlm"]


def test_spread_join_keeps_every_row(spark):
    big = spark.range(1000).withColumn("k", (F.col("id") % 3 == 0).cast("int"))
    stats = big.groupBy("k").agg(F.count("*").alias("n"))
    got = spread_join(big, stats, ["k"], ["id"]).agg(F.count("*"), F.sum("n"), F.countDistinct("id")).first()
    assert tuple(got) == (1000, 334 * 334 + 666 * 666, 1000)


def test_dense_grid(spark):
    df = spark.createDataFrame([("m", "a", 1.0), ("n", "b", 2.0)], "model string, fam string, score double")
    got = sorted(tuple(r) for r in dense_grid(df, "model", "fam", "score").collect())
    assert got == [("m", "a", 1.0), ("m", "b", None), ("n", "a", None), ("n", "b", 2.0)]
    assert dense_grid(df, "model", "fam", "score", nan=True).where(F.isnan("score")).count() == 2


def test_validate_isolates_bad_rows(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,), ("900",)], "a string")
    good, skipped = validate(df, [
        ("unreadable", F.col("a").try_cast("int").isNull()), ("large", F.col("a").try_cast("int") > 500)])
    assert [r.a for r in good.collect()] == ["1"]
    assert {r.reason: r.skipped for r in skipped.collect()} == {"unreadable": 2, "large": 1}
    good, skipped = validate(df, [("large", F.col("a").try_cast("int") > 500)])
    assert [r.a for r in good.collect()] == ["1"]
    assert skipped.first().skipped == 3


def test_union(spark):
    corpus = spark.createDataFrame([("a",), ("b" * 1001,)], "text string")
    qa = spark.createDataFrame([("q", "a", "train"), ("q", "a", "test")], "question string, answer string, split string")
    got = sorted((r.source, r.text) for r in union_corpora(corpus, qa).collect())
    assert got == [("corpus", "a"), ("qa", "Q:\nq\n\nA:\na")]


def test_small_operators(spark):
    df = spark.createDataFrame([("ab",), ("bé",), ("",)], "text string")
    assert sorted(r.ch for r in charset(df).collect()) == ["a", "b", "é"]
    loose = spark.createDataFrame([("x", None), (None, "y"), (None, None)], "soru string, text string")
    got = sorted(r.stem for r in coalesce_columns(loose, ["question", "soru", "text"], "stem").collect())
    assert got == ["x", "y"]
    groups = spark.range(10).withColumn("g", F.col("id") % 2)
    got = head_per_group(groups, ["g"], 2, ["id"]).orderBy("g", "id").collect()
    assert [(r.g, r.id) for r in got] == [(0, 0), (0, 2), (1, 1), (1, 3)]


def test_budget_over_ids_further_apart_than_a_bigint(spark):
    rows = [(-(2**63), "abc"), (-5, "de"), (0, "f"), (2**63 - 1, "ghi")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from corpuslab.operators.corpus import char_budget

    assert sorted(r.doc_id for r in char_budget(df, "doc_id", 6).collect()) == [-(2**63), -5, 0]
