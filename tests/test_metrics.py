import csv
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import metrics as M
from corpuslab.operators.dist import (
    log_softmax, nucleus, softmax, top_k_ties, weighted_draw,
)
from corpuslab.operators.scoring import best_choices

HERE = os.path.dirname(__file__)


def published(spark):
    """One row per answered question, from published counts of right answers."""
    with open(os.path.join(HERE, "fixtures", "subject_counts.csv")) as f:
        rows = [(r["subject"], int(r["correct"]), int(r["n"])) for r in csv.DictReader(f)]
    return spark.createDataFrame(rows, "subject string, correct int, n int").select(
        "subject", F.explode(F.expr("sequence(1, n)")).alias("i"), "correct").select(
        "subject", (F.col("i") <= F.col("correct")).cast("int").alias("pred"), F.lit(1).alias("gold"))


def test_published_accuracy(spark):
    got = {r.subject: (r.accuracy, r.n) for r in M.accuracy_by(published(spark), "subject", "pred", "gold").collect()}
    assert len(got) == 58
    assert got[None] == (0.2355077624270047, 14042)
    assert got["abstract_algebra"] == (0.19, 100)
    macro = sum(a for s, (a, _) in got.items() if s) / 57
    assert round(macro, 6) == 0.234756


def test_accuracy_of_nothing(spark):
    df = spark.createDataFrame([], "subject string, pred int, gold int")
    assert tuple(M.accuracy(df, "pred", "gold").first()) == (0.0, 0)
    assert [tuple(r) for r in M.accuracy_by(df, "subject", "pred", "gold").collect()] == [(None, 0.0, 0)]
    assert tuple(M.pass_at_1(df.select(F.col("pred").alias("pass"))).first()) == (0.0, 0)


def test_null_prediction_and_key(spark):
    df = spark.createDataFrame([("a", None, 1), (None, 1, 1)], "subject string, pred int, gold int")
    got = {r.subject: (r.accuracy, r.n) for r in M.accuracy_by(df, "subject", "pred", "gold").collect()}
    assert got == {"a": (0.0, 1), None: (0.5, 2)}


def test_macro_mean(spark):
    df = spark.createDataFrame(
        [("m", 0.5, 10, None), ("m", 0.0, 0, None), ("m", 0.9, 5, "failed")],
        "model string, accuracy double, total_samples int, error string")
    assert M.macro_mean(df, ["model"]).first().avg_accuracy == 0.5
    assert M.macro_mean(df, ["model"], strict_parity=True).first().avg_accuracy == 0.25


def test_best_choice(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, 0, 2.0), (1, 1, 2.0), (2, 0, -inf), (2, 1, -inf), (3, 0, 5.0), (3, 1, nan), (4, 0, -inf), (4, 1, -9.0)]
    df = spark.createDataFrame(rows, "item int, idx int, score double")
    assert {r.item: r.pred for r in best_choices(df).collect()} == {1: 0, 3: 1, 4: 1}
    assert {r.item: r.pred for r in M.argmax_choice(df, ["item"]).collect()} == {1: 0, 2: 0, 3: 1, 4: 1}


def test_perplexity_and_throughput(spark):
    df = spark.createDataFrame([(2.0, 1, 5), (4.0, 1, -1)], "nll double, n int, target int")
    got = M.perplexity(M.token_nll(df), "nll", "n").first()
    assert got.avg_loss == 2.0 and math.isclose(got.perplexity, math.exp(2))
    run = spark.createDataFrame([(10, 0.0)], "tokens int, seconds double")
    assert math.isclose(M.throughput(run).first().tok_per_sec, 1e10)


def test_running_mean(spark):
    df = spark.createDataFrame([("r", i, float(i)) for i in range(1, 26)], "run string, it int, loss double")
    got = {r.n: r.running_mean for r in M.running_mean(df, ["run"], ["it"], "loss", every=10, first=2).collect()}
    assert got == {1: 1.0, 2: 1.5, 10: 5.5, 20: 10.5, 25: 13.0}
    whole = {r.n: r.running_mean for r in M.running_mean(df, [], ["it"], "loss", every=10).collect()}
    assert whole == {10: 5.5, 20: 10.5, 25: 13.0}


@pytest.mark.parametrize("a", [0.1, 0.5, 0.9])
def test_ema_equals_the_recursion(spark, a):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 30}", i, rng.uniform(-100, 100)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, it int, x double")
    got = {(r.k, r.it): r.ema for r in M.ema(df, ["k"], ["it"], "x", a).collect()}
    state = {}
    for k, it, x in rows:
        state[k] = x if k not in state else (1 - a) * state[k] + a * x
        assert math.isclose(got[(k, it)], state[k], rel_tol=1e-9, abs_tol=1e-9)
    assert len(got) == len(rows)


def test_running_best(spark):
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate([3.0, 5.0, 2.0, 2.5])], "run string, it int, loss double")
    got = [r.best for r in M.running_best(df, ["run"], ["it"], "loss").orderBy("it").collect()]
    assert got == [3.0, 3.0, 2.0, 2.0]


def test_last_per_key(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0)], "lang string, pos int, score double")
    assert M.last_per_key(df, ["lang"], F.col("pos"), "score").first().score == 2.0


def next_tokens(spark):
    rows = [("c", t, w) for t, w in zip("abcde", [0.5, 0.2, 0.2, 0.06, 0.04])] + [("d", "x", 0.97), ("d", "y", 0.03)]
    return spark.createDataFrame(rows, "ctx string, token string, weight double")


def test_top_k_keeps_ties(spark):
    got = {(r.ctx, r.token) for r in top_k_ties(next_tokens(spark), ["ctx"], "weight", 2, ["token"]).collect()}
    assert got == {("c", "a"), ("c", "b"), ("c", "c"), ("d", "x"), ("d", "y")}


def test_nucleus_keeps_the_set_within_p(spark):
    got = {(r.ctx, r.token): r.prob for r in nucleus(next_tokens(spark), ["ctx"], "weight", 0.75, ["token"]).collect()}
    assert set(got) == {("c", "a"), ("c", "b"), ("d", "x")}
    assert math.isclose(got[("c", "a")], 0.5 / 0.7) and got[("d", "x")] == 1.0


def test_softmax_over_far_exponents_reads_rows_once(spark):
    rng = random.Random(6)
    spans = {"near": (-3, 3), "wide": (-900, 900), "edge": (250, 262), "low": (-5_000, -4_900)}
    rows = [(g, i, rng.uniform(*span)) for g, span in spans.items() for i in range(50)]
    rows += [("masked", 0, -math.inf), ("masked", 1, 0.5), ("masked", 2, None), (None, 0, 1.0), (None, 1, 1.0),
             ("binned", 0, 511.9), ("binned", 1, 512.1), ("binned", 2, -700.0)]
    df = spark.createDataFrame(rows, "g string, i int, z double")
    found = softmax(df, ["g"], "z", ["g", "i"])
    got = {(r.g, r.i): r.prob for r in found.collect()}
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        z = {r[1]: r[2] for r in rows if r[0] == g and r[2] is not None}
        peak = max(z.values())
        total = sum(math.exp(v - peak) for v in z.values())
        for i, v in z.items():
            assert got[g, i] == pytest.approx(math.exp(v - peak) / total, rel=1e-12, abs=1e-300)
    assert got["masked", 2] is None
    logs = {(r.g, r.i): r.logprob for r in log_softmax(df, ["g"], "z", ["g", "i"]).collect()}
    assert logs["binned", 2] == pytest.approx(-700 - 512.1 - math.log(1 + math.exp(-0.2)), rel=1e-12)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_softmax(spark):
    df = spark.createDataFrame([("g", 0, 1000.0), ("g", 1, 1001.0)], "g string, i int, z double")
    p = {r.i: r.prob for r in softmax(df, ["g"], "z", ["i"]).collect()}
    assert math.isclose(p[1], 1 / (1 + math.exp(-1))) and math.isclose(sum(p.values()), 1.0)
    lp = {r.i: r.logprob for r in log_softmax(df, ["g"], "z", ["i"]).collect()}
    assert math.isclose(lp[0], math.log(p[0]))
    cold = {r.i: r.prob for r in softmax(df, ["g"], "z", ["i"], temperature=0.0).collect()}
    assert cold == {0: 0.0, 1: 1.0}


def test_weighted_draw_follows_the_weights(spark):
    df = spark.range(4000).select(F.col("id").alias("g"), F.explode(F.array(*[
        F.struct(F.lit(t).alias("token"), F.lit(w).alias("weight"))
        for t, w in (("a", 0.7), ("b", 0.3), ("z", 0.0))])).alias("e")).select("g", "e.*")
    drawn = weighted_draw(df, ["g"], "weight", 7, ["g", "token"])
    share = {r.token: r["count"] / 4000 for r in drawn.groupBy("token").count().collect()}
    assert set(share) == {"a", "b"} and abs(share["a"] - 0.7) < 0.03
    again = weighted_draw(df.repartition(7), ["g"], "weight", 7, ["g", "token"])
    assert drawn.exceptAll(again).count() == 0


@pytest.mark.parametrize("a", [0.1, 1e-5, 0.9, 1.0])
def test_ema_keeps_a_large_head(spark, a):
    rows = [("k", i, 1e40 if i == 0 else 0.0) for i in range(1500)] + [(None, i, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, it int, x double")
    got = {(r.k, r.it): r.ema for r in M.ema(df, ["k"], ["it"], "x", a).collect()}
    assert len(got) == len(rows)
    for i in (0, 1, 790, 800, 1499):
        want = 1e40 * (1.0 - a) ** i
        assert got["k", i] == pytest.approx(want, rel=1e-9, abs=1e-300)
    assert got[None, 2] == pytest.approx(1.0)


def test_recurrence_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(M, "LONGEST_CHUNK", 7)
    rng = random.Random(5)
    xs = [rng.uniform(-5, 5) for _ in range(400)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "it int, x double")
    got = {r.it: r.ema for r in M.ema(df, [], ["it"], "x", 0.001).collect()}
    y = xs[0]
    for i, x in enumerate(xs):
        y = y if i == 0 else 0.999 * y + 0.001 * x
        assert got[i] == pytest.approx(y, rel=1e-9)
