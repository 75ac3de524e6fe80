from pyspark.sql import functions as F

from corpuslab.operators.dist import softmax, top_k_ties
from corpuslab.operators.corpus import head_per_group
from corpuslab.operators.models import encode_sentences, generate_answers, model_scorer
from corpuslab.operators.scoring import numeric_eval, score_continuations


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_model_hooks(spark):
    rows = spark.range(100).select(
        F.col("id").alias("item"), F.lit(0).alias("idx"), F.lit("ctx").alias("context"),
        F.repeat(F.lit("x"), (F.col("id") % 5).cast("int")).alias("continuation"))
    scorer = model_scorer(lambda: lambda contexts, texts: [-float(len(t)) for t in texts], batch=7)
    got = score_continuations(rows, scorer).collect()
    assert len(got) == 100 and all(r.score == -(r.item % 5) for r in got)
    vectors = encode_sentences(rows, lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], "continuation")
    assert all(r.vector == [r.item % 5, 1.0] for r in vectors.collect())
    asked = spark.createDataFrame([("2 + 2?", "#### 4")], "prompt string, answer string")
    said = generate_answers(asked, lambda: lambda prompts: [p + " 4" for p in prompts])
    assert tuple(numeric_eval(said, "marked", prompt="prompt").first()) == (1.0, 1)


def test_group_limits_cut_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3).withColumn("v", F.col("id") % 10)
    for limited in (head_per_group(df, ["g"], 3, ["id"]), top_k_ties(df, ["g"], "v", 2, ["id"])):
        plan = plan_of(limited)
        assert plan.count("WindowGroupLimit") >= 2, plan


def test_null_group_is_a_group(spark):
    df = spark.createDataFrame([(None, 1, 0.0), (None, 2, 0.0), ("a", 3, 1.0)], "g string, i int, z double")
    got = {r.i: r.prob for r in softmax(df, ["g"], "z", ["i"]).collect()}
    assert got == {1: 0.5, 2: 0.5, 3: 1.0}
