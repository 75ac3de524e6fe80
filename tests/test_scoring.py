import collections
import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import scoring
from corpuslab.operators.pretokens import pretokens
from corpuslab.operators.scoring import (
    BigramScorer, evaluate_choices, expand_choices, fit_prompt, mcq_requests, numeric_eval,
    numeric_rows, score_continuations, score_labels, sweep,
)
from corpuslab.plans.choice_plan import evaluate_mcq, loose_items


def fit_by_hand(text, n, split):
    tokens = split(text)
    if len(tokens) >= n - 2:
        at = text.rfind("Answer: ")
        if at != -1:
            head, tail = split(text[:at]), split(text[at:])
            room = n - len(tail) - 10
            if room > 50 and len(head) > room:
                text = "".join(head[-room:]) + text[at:]
                text = "..." + text[text.find(" "):] if " " in text else text
    tokens = split(text)
    return "".join(tokens[:n - 2]) if len(tokens) > n - 2 else text


@pytest.mark.parametrize("n", [20, 80, 100, 400])
def test_fit_prompt(one, n):
    regex = pytest.importorskip("regex")
    split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
    long = "Question: " + " ".join(f"word{i}" for i in range(120))
    texts = [long + "\nAnswer: ", "short\nAnswer: ", long, "Answer: x " + long + "\nAnswer: ", "x" * 500 + "\nAnswer: ",
             "a" * 3 + "1b2c" * 80 + "Answer: "]
    got = one(lambda d: fit_prompt(F.col("t"), n), [(t,) for t in texts], "t string")
    assert got == [fit_by_hand(t, n, split) for t in texts]


@pytest.fixture(scope="module")
def scorer(spark):
    docs = spark.createDataFrame([("a b a c",), ("b",), ("c a b",)], "text string")
    return BigramScorer.train(docs, pretokens(F.col("text"), "whitespace"))


def test_bigram_scores(spark, scorer):
    assert scorer.size == 3
    requests = spark.createDataFrame([
        (1, 0, ["x", "a"], ["b", "a"]), (1, 1, ["a"], ["z"]), (1, 2, ["z"], ["a"]), (1, 3, [], ["a", "b"]),
        (1, 4, ["a"], [])], "item int, idx int, context array<string>, continuation array<string>")
    got = {r.idx: r.score for r in score_continuations(requests, scorer).collect()}
    pairs = collections.Counter({("a", "b"): 2, ("b", "a"): 1, ("a", "c"): 1, ("c", "a"): 1})
    heads = collections.Counter(a=3, b=1, c=1)
    lp = lambda a, b: math.log((pairs[a, b] + 1) / (heads[a] + 3))
    want = {0: lp("a", "b") + lp("b", "a"), 1: lp("a", "z"), 2: lp("z", "a"), 3: math.log(1 / 3) + lp("a", "b"), 4: 0.0}
    assert set(got) == set(want)
    for i in want:
        assert math.isclose(got[i], want[i])
    one = {r.idx: r.score for r in score_labels(requests, scorer).collect()}
    assert math.isclose(one[0], lp("a", "b")) and one[4] == float("-inf")


def test_bigram_counts_cross_in_sorted_runs(spark, monkeypatch):
    texts = [["a", "b", "a", "c"], ["b"], ["c", None, "b", "a", "b"], ["é", "a"] * 9]
    monkeypatch.setattr(scoring, "RUN_TOKENS", 6)
    lists = pa.array([["x"], *texts]).slice(1)
    runs = [r.to_pylist() for r in scoring._adjacent([pa.RecordBatch.from_arrays([lists], names=["t"])])]
    order = lambda r: (r["tok"] or "", r["prev"] or "")
    assert len(runs) == 3 and all(r == sorted(r, key=order) for r in runs)
    assert all(len({(r["prev"], r["tok"]) for r in run}) == len(run) for run in runs)
    want = collections.Counter(pair for t in texts for pair in zip([None, *t], t))
    got = collections.Counter()
    for r in sum(runs, []):
        got[r["prev"], r["tok"]] += r["n"]
    assert got == want
    trained = BigramScorer.train(spark.createDataFrame([(t,) for t in [*texts, [], None]], "t array<string>"), F.col("t"))
    assert {(r.prev, r.tok): r.n for r in trained.pairs.collect()} == {k: n for k, n in want.items() if k[0] is not None}
    assert trained.size == 5  # a null token is one of them


def test_asked_pairs_do_not_shuffle_the_model(spark, scorer):
    needed = spark.createDataFrame([("a", "b"), ("z", "a")], "prev string, tok string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = scorer.table(needed)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("BroadcastHashJoin") >= 3 and "SortMergeJoin [tok" not in plan
    assert "LeftSemi" not in "".join(line for line in plan.splitlines() if "SortMergeJoin" in line)


def test_any_scorer_fits(spark):
    items = spark.createDataFrame([(1, "s", "q", ["x", "yy"], 1), (2, "s", "q", ["zzz", "y"], 1)],
                                  "item int, subject string, question string, choices array<string>, gold int")
    longest = lambda requests: requests.withColumn("score", F.length("continuation").cast("double"))
    requests = expand_choices(items, "choices").withColumnRenamed("question", "context")
    got = {r.subject: (r.accuracy, r.n) for r in evaluate_choices(
        score_continuations(requests, longest), items, "subject").collect()}
    assert got == {"s": (0.5, 2), None: (0.5, 2)}


def test_requests(spark):
    items = spark.createDataFrame([(1, "q", list("vwxyz")), (2, "q", [])], "item int, question string, choices array<string>")
    en = {(r.item, r.idx): (r.context, r.continuation) for r in mcq_requests(items).collect()}
    assert en[1, 3] == ("q\nA. v\nB. w\nC. x\nD. y\nE. z\nAnswer: ", "D") and len(en) == 5
    tr = mcq_requests(items, style="tr").collect()
    assert len(tr) == 5 and tr[0].context.endswith("\nE. z\nCevap: ")


def test_loose_items(spark):
    rows = [("q", None, ["a", "b", "c", "d"], "b"), (None, "s", ["a", "b", "c", "d"], "2"),
            ("q", None, ["a", "b", "c", "d"], "E"), ("q", None, ["a"] * 5, "E"), ("q", None, ["a"], "x"),
            (None, None, ["a"], "A"), ("q", None, ["a", "b"], "-1")]
    df = spark.createDataFrame(rows, "question string, soru string, secenekler array<string>, cevap string")
    good, skipped = loose_items(df)
    assert sorted(r.gold for r in good.collect()) == [1, 2, 4]
    assert {r.reason: r.skipped for r in skipped.collect()} == {"gold out of range": 2, "gold not parseable": 1}


def test_mcq_end_to_end(spark):
    corpus = spark.createDataFrame([("x Answer: B",), ("Answer: B A",)], "text string")
    items = spark.createDataFrame([(1, "m", "q", ["1", "2"], 1), (2, "n", "q", ["1", "2"], 0)],
                                  "item int, subject string, question string, choices array<string>, gold int")
    got = {r.subject: (r.accuracy, r.n) for r in evaluate_mcq(items, corpus).collect()}
    assert got == {"m": (1.0, 1), "n": (0.0, 1), None: (0.5, 2)}


def test_numeric_variants(spark):
    rows = [("q", "x #### 42", "is 42"), ("q", "x #### 42", "no idea"), ("q", "nothing", "7"),
            ("q", "#### 0", "hiç"), (None, "#### 1", "1"), ("q", "#### 5", "SONUÇ: 5 son 9")]
    df = spark.createDataFrame(rows, "question string, answer string, completion string")
    by = lambda v: tuple(numeric_eval(df, v).first())
    assert by("marked") == (2 / 6, 6)
    assert by("last") == (2 / 6, 6)
    # the row without a number and the row without a question are not counted
    assert by("cued") == (3 / 4, 4)
    empty = df.where("false")
    assert tuple(numeric_eval(empty, "cued").first()) == (0.0, 0)
    echoed = spark.createDataFrame([("ask 9", "#### 3", "ask 9 gives 3")], "question string, answer string, completion string")
    assert numeric_rows(echoed, "last", "question").first().predicted_answer == "3"


def test_sweep(spark):
    rows = [("m", "de", 1, 1, None), ("m", "de", 0, 1, None), ("m", "fr", None, None, "no such split")]
    df = spark.createDataFrame(rows, "model string, language string, pred int, gold int, error string")
    got = {r.language: (r.accuracy, r.total_samples, r.error) for r in sweep(df, "pred", "gold", error="error").collect()}
    assert got == {"de": (0.5, 2, None), "fr": (0.0, 0, "no such split")}


def test_a_prompt_is_not_split_again_for_each_use(spark):
    df = spark.createDataFrame([(1, "a")], "i int, t string").select(fit_prompt(F.col("t"), 512).alias("p"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 6
