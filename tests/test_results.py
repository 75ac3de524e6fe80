import pytest
import json
import math
import os
import random

from pyspark.sql import functions as F

from corpuslab.functions.scores import explode_scores, parse_scores
from corpuslab.operators.metrics import accuracy_by
from corpuslab.operators import vectors
from corpuslab.operators.vectors import embed, mean_pool, pair_eval, sts_eval
from corpuslab.plans.results_plan import family_rows, family_table, language_table, model_scores
from corpuslab.session import scratch_path
from corpuslab.sources import reports as R
from corpuslab.sources.tables import list_subsets, read_split
from tests.test_metrics import published

PRINTED = (
    "TaskResult(task_name=X scores={'test': [{'main_score': 0.5, 'hf_subset': 'en', 'languages': ['eng-Latn']},\n"
    " {'main_score': 0.25, 'hf_subset': 'de', 'languages': ['deu-Latn'], 'x': None}]} evaluation_time=1.0 hf_subset='en')"
)


def dump(folder, name, value):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        json.dump(value, f, indent=2)


def test_parsers(spark):
    df = spark.createDataFrame([(PRINTED,), ("hf_subset='x' main_score': bad,",), ("junk",)], "entry string")
    rows = lambda style: [(r.lang, r.score) for r in parse_scores(df, "entry", style).orderBy("pos").collect()]
    assert rows("pair") == [("en", 0.5)]
    assert rows("literal") == [("eng-Latn", 0.5), ("deu-Latn", 0.25)]
    assert rows("regex") == [("eng-Latn", 0.5), ("deu-Latn", 0.25)]


def test_summaries(spark, tmp_path):
    dump(f"{tmp_path}/results/a", "summary.json", {"model": "o/a", "elapsed_sec": 1.5, "results": [PRINTED]})
    dump(f"{tmp_path}/results/b", "summary.json", {"model": "o/b", "elapsed_sec": 2, "results": {
        "T": {"test": [{"hf_subset": "eng-Latn", "main_score": 0.4, "languages": ["eng"]},
                       {"hf_subset": "tur", "main_score": 0.8}, {"hf_subset": "", "main_score": 1.0},
                       {"hf_subset": "xyz", "main_score": None}, {"hf_subset": "xyz", "main_score": 0.1}]}}})
    summaries = R.read_summaries(spark, f"{tmp_path}/results/*/summary.json")
    assert summaries.count() == 2
    assert sorted((r.model, r.lang, r.score) for r in family_rows(summaries).collect()) == [
        ("o/a", "en", 0.5), ("o/b", "eng-Latn", 0.4), ("o/b", "tur", 0.8), ("o/b", "xyz", 0.1)]
    grid = {(r.model, r.family): r.score for r in family_table(summaries).collect()}
    assert grid[("o/a", "Other")] == 0.5 and grid[("o/b", "Turkic")] == 0.8 and grid[("o/a", "Turkic")] is None
    assert len(grid) == 6
    langs = {(r.model, r.lang): r.score for r in language_table(summaries).collect()}
    assert langs == {("o/a", "deu"): 0.25, ("o/a", "eng"): 0.5}
    dump(f"{tmp_path}/more/c", "summary.json", {"model": "c", "elapsed_sec": 1, "results": [
        {"languages": ["b"], "main_score": 0.1}, {"languages": ["a"], "main_score": 0.2},
        {"languages": ["b"], "main_score": 0.3}]})
    listed = R.read_summaries(spark, f"{tmp_path}/more/*/summary.json")
    assert [(r.lang, r.score) for r in model_scores(listed).collect()] == [("a", 0.2), ("b", 0.3)]


def test_explode_scores_of_empty_map(spark):
    df = spark.createDataFrame([("m", {})], f"model string, results {R.TASKS}")
    assert explode_scores(df).count() == 0


def test_model_cards(spark, tmp_path):
    card = dict.fromkeys(R.CARD_FIELDS) | {"name": "none", "open_weights": True, "framework": [], "modalities": ["text"]}
    for group, names in (("g1", ["org__m-1", "plain"]), ("g2", ["a__b"])):
        for name in names:
            dump(f"{tmp_path}/{group}/{name}/n/r", "model_meta.json", card)
    rows = R.read_model_meta(spark, f"{tmp_path}/*/*/*/*/model_meta.json").orderBy("model").collect()
    assert [(r.group, r.model) for r in rows] == [("g2", "a/b"), ("g1", "org/m-1"), ("g1", "plain")]
    assert rows[0].modalities == ["text"] and rows[0].open_weights is True and rows[0].n_parameters is None


def test_report_files(spark, tmp_path):
    dump(str(tmp_path), "one.json", {"overall": {"accuracy": 0.5, "n": 4}, "per_subject": {
        "s": {"accuracy": 1.0, "n": 2}, "t": {"accuracy": 0.0, "n": 2}}, "dataset_used": "d", "total_subjects": 2})
    dump(str(tmp_path), "two.json", {"accuracy": 0.25, "n": 8})
    rows = {(r.report, r.subject): (r.accuracy, r.n, r.dataset_used, r.total_subjects)
            for r in R.read_reports(spark, f"{tmp_path}/*.json").collect()}
    assert rows == {("one", None): (0.5, 4, "d", 2), ("one", "s"): (1.0, 2, "d", 2), ("one", "t"): (0.0, 2, "d", 2),
                    ("two", None): (0.25, 8, None, None)}


def test_report_round_trip_of_published_counts(spark):
    rows = accuracy_by(published(spark), "subject", "pred", "gold")
    path = scratch_path(spark, "report")
    R.write_report(rows, path, dataset_used="d", total_subjects=57)
    back = R.read_reports(spark, path)
    assert back.select("subject", "accuracy", "n").exceptAll(rows).count() == 0
    assert back.count() == 58 and back.first().total_subjects == 57


def test_language_reports(spark):
    df = spark.createDataFrame(
        [("o/m", "de", 0.5, 10, 1.0, None), ("o/m", "fr", 0.0, 0, 0.0, "failed"), ("n", "de", 0.1, 3, 2.0, None)],
        "model string, language string, accuracy double, total_samples bigint, elapsed_time double, error string")
    path = scratch_path(spark, "lang")
    R.write_language_report(df, path)
    got = {r.model: r for r in R.read_language_reports(spark, f"{path}/all_results").collect()}
    assert got["o/m"].avg_accuracy == 0.5 and got["o/m"].languages["fr"].error == "failed"
    assert got["n"].languages["de"].error is None
    alone = R.read_language_reports(spark, f"{path}/models/model_dir=o__m").collect()
    assert [r.model for r in alone] == ["o/m"]


def test_reports_of_many_entries_keep_their_order_and_run_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    schema = "subject string, accuracy double, n bigint"
    rows = [(f'k{i:04} "é"', i / 2_000, 10) for i in range(2_000)] + [(None, 0.25, 8)]
    df = spark.createDataFrame(rows, schema).repartition(5).mapInArrow(count, schema)
    path = scratch_path(spark, "report")
    details = spark.createDataFrame([(i, f"line\n{{{i}}}", None) for i in range(30)],
                                    "doc_id bigint, text string, x int").repartition(3)
    R.write_report(df, path, details=details, detail_rows=None)
    assert seen.value == 2_001
    back = R.read_reports(spark, path)
    assert sorted(map(tuple, back.select("subject", "accuracy", "n").collect()), key=repr) == sorted(rows, key=repr)
    assert {(r.correct, r.total_examples) for r in back.collect()} == {(2, 8)}
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    assert list(json.loads(text)["per_subject"]) == sorted(r[0] for r in rows if r[0])
    got = R.read_report_details(spark, path, "doc_id bigint, text string").orderBy("position").collect()
    assert [(r.position, r.detail.doc_id, r.detail.text) for r in got] == [
        (i, i, f"line\n{{{i}}}") for i in range(30)]


def test_passed_report_with_details(spark, tmp_path):
    dump(str(tmp_path), "h.json", {"pass@1": 0.5, "n": 2, "details": [
        {"task_id": "a", "pass": True}, {"task_id": "b", "pass": False}]})
    path = f"{tmp_path}/h.json"
    assert [(r.subject, r.accuracy, r.n) for r in R.read_reports(spark, path).collect()] == [(None, 0.5, 2)]
    got = R.read_report_details(spark, path, "task_id string, `pass` boolean").orderBy("position").collect()
    assert [(r.report, r.detail.task_id, r.detail["pass"]) for r in got] == [("h", "a", True), ("h", "b", False)]


def test_empty_report(spark):
    path = scratch_path(spark, "report")
    R.write_report(spark.createDataFrame([], "subject string, accuracy double, n bigint"), path)
    assert [(r.subject, r.n) for r in R.read_reports(spark, path).collect()] == [(None, None)]


def test_language_reports_of_many_languages(spark):
    rows = [(m, f"l{i:03}", i / 1_000, i, 1.0, None if i % 2 else "failed") for m in ("a/b", "a__b", "c") for i in range(300)]
    df = spark.createDataFrame([*rows, ("d", None, 0.5, 1, 1.0, None)],
        "model string, language string, accuracy double, total_samples bigint, elapsed_time double, error string")
    path = scratch_path(spark, "lang")
    R.write_language_report(df.repartition(7), path)
    for place in ("all_results", "models"):
        found = {r.model: r for r in R.read_language_reports(spark, f"{path}/{place}").collect()}
        assert set(found) == {"a/b", "a__b", "c", "d"}
        assert set(found["c"].languages) == {f"l{i:03}" for i in range(300)}
        assert found["a/b"].languages["l007"].accuracy == 0.007 and found["d"].languages[""].total_samples == 1
        assert found["c"].avg_accuracy == pytest.approx(0.15)
    text = spark.read.text(f"{path}/models/model_dir=c", wholetext=True).first()[0]
    assert list(json.loads(text)["languages"]) == [f"l{i:03}" for i in range(300)]


def test_splits(spark):
    df = spark.createDataFrame([("train", 1), ("zeta", 2), ("alpha", 3)], "split string, v int")
    path = scratch_path(spark, "splits")
    df.write.partitionBy("split").parquet(path)
    assert [r.v for r in read_split(spark, path).collect()] == [1]
    assert [r.v for r in read_split(spark, path, ("nope",)).collect()] == [3]
    assert "PartitionFilters: [isnotnull(split" in read_split(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.split for r in list_subsets(df, "split").collect()) == ["alpha", "train", "zeta"]


def test_pooling(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], 1), ("a", [3.0, 4.0], 1), ("a", [9.0, 9.0], 0), ("b", [5.0, 5.0], 0)],
                               "k string, v array<double>, m int")
    assert {r.k: r.vector for r in mean_pool(df, ["k"], "v", 2, "m").collect()} == {"a": [2.0, 3.0], "b": [0.0, 0.0]}
    table = spark.createDataFrame([(0, [3.0, 0.0]), (1, [0.0, 4.0])], "id int, vector array<float>")
    docs = spark.createDataFrame([(1, [0, 0, 1]), (2, []), (3, [0])], "doc_id bigint, tokens array<int>")
    got = {r.doc_id: r.vector for r in embed(docs, table, 2, max_length=2).collect()}
    assert got == {1: [1.0, 0.0], 2: [0.0, 0.0], 3: [1.0, 0.0]}


def test_embed_sums_documents_where_they_lie(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(1, [5, 6, 5]), (1, [6]), (2, []), (3, None), (None, [5]), (4, [7, 7])], "doc_id int, tokens array<int>")
    table = spark.createDataFrame([(5, [3.0, 0.0]), (6, [0.0, 4.0]), (7, [0.0, 1.0]), (7, [1.0, 0.0]), (9, [1.0, 1.0])],
                                  "id int, vector array<double>")
    half = 0.5 ** 0.5
    want = sorted([("1", 0.6, 0.8), ("1", 0.6, 0.8), ("2", 0, 0), ("3", 0, 0), ("None", 0, 0), ("4", half, half)])
    told = lambda df: sorted((str(r[0]), *(round(x, 9) for x in r[1])) for r in df.collect())
    got = embed(docs, table, 2)
    assert "token_id" not in got._jdf.queryExecution().executedPlan().toString()
    assert told(got) == [(k, round(x, 9), round(y, 9)) for k, x, y in want]
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 0)
    assert told(embed(docs, table, 2)) == [(k, round(x, 9), round(y, 9)) for k, x, y in want]
    monkeypatch.undo()
    with pytest.raises(Exception, match="no vector for token id 8"):
        embed(spark.createDataFrame([(1, [8])], "doc_id int, tokens array<int>"), table, 2).collect()


def ap_by_hand(pairs):
    pairs = sorted(pairs, key=lambda p: -p[0])
    positives = sum(g for _, g in pairs)
    total, best, i, tp, seen = 0.0, len(pairs) - positives, 0, 0, 0
    while i < len(pairs):
        j = i
        while j < len(pairs) and pairs[j][0] == pairs[i][0]:
            j += 1
        pos = sum(g for _, g in pairs[i:j])
        tp, seen = tp + pos, j
        total += pos * tp / seen
        best = max(best, tp + (len(pairs) - positives) - (seen - tp))
        i = j
    return (total / positives if positives else 0.0), best / len(pairs)


def test_pair_evaluation(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 2 else f"k{i % 6}", round(rng.random(), 1), int(rng.random() < 0.4)) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, score double, gold int")
    for r in pair_eval(df, ["k"]).collect():
        ap, acc = ap_by_hand([(s, g) for k, s, g in rows if k == r.k])
        assert math.isclose(r.ap, ap, rel_tol=1e-9) and math.isclose(r.best_accuracy, acc)


def test_rank_correlation(spark):
    rng = random.Random(4)
    rows = [("a", round(x, 1), round(x + rng.gauss(0, 1), 0)) for x in (rng.gauss(0, 1) for _ in range(400))]
    df = spark.createDataFrame(rows, "k string, score double, gold double")
    import pandas as pd
    p = pd.DataFrame(rows, columns=["k", "x", "y"])
    want = p.x.rank().corr(p.y.rank())
    got = sts_eval(df, ["k"]).first()
    assert got.n == 400 and math.isclose(got.spearman, want, rel_tol=1e-9)
    flat = df.withColumn("gold", F.lit(1.0))
    assert sts_eval(flat, ["k"]).first().spearman is None


def test_two_runs_of_a_model_are_two_summaries(spark, tmp_path):
    from corpuslab.sources.reports import read_summaries, write_summary

    rows = spark.createDataFrame(
        [("a/m", 1.0, ["x"]), ("a/m", 2.0, ["y"]), ("b/n", 3.0, ["z"])],
        "model string, elapsed_sec double, results array<string>")
    write_summary(rows.coalesce(1), str(tmp_path / "s"))
    got = read_summaries(spark, f"{tmp_path}/s/*/*.json")
    assert sorted((r.model, r.elapsed_sec) for r in got.collect()) == [("a/m", 1.0), ("a/m", 2.0), ("b/n", 3.0)]


def test_grid_with_a_missing_label(spark):
    from corpuslab.operators.lookup import dense_grid

    df = spark.createDataFrame([("a", "x", 1.0), ("a", None, 2.0), ("b", None, 3.0)], "r string, c string, v double")
    assert sorted(map(tuple, dense_grid(df, "r", "c", "v").collect())) == [("a", "x", 1.0), ("b", "x", None)]


def test_a_token_without_a_vector_fails(spark):
    from pyspark.errors import PySparkException

    from corpuslab.operators.lookup import lookup_vectors

    tokens = spark.createDataFrame([(0, [1, 2])], "doc_id int, tokens array<int>")
    table = spark.createDataFrame([(1, [0.5])], "id int, vector array<double>")
    with pytest.raises(PySparkException, match="no vector for token id 2"):
        lookup_vectors(tokens, table, 1).collect()
