import random

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import tokens
from corpuslab.operators.tokens import (
    add_specials, sample_windows, split_tokens, token_counts, token_stream, token_total, windows_at, with_offsets,
)
from corpuslab.plans import loss_plan
from corpuslab.session import scratch_path
from corpuslab.sources.tables import read_tokens, write_tokens


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    return [(i * 3, [rng.randrange(65536) for _ in range(rng.choice([0, 1, 5, 400, 2500]))]) for i in range(60)]


@pytest.fixture(scope="module")
def stream(docs):
    return [t for _, tokens in sorted(docs) for t in tokens]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id bigint, tokens array<int>").repartition(5)


@pytest.mark.parametrize("frac", [0.0, 0.33, 0.9, 1.0])
def test_split(spark, docs, stream, frac):
    rows = split_tokens(frame(spark, docs), frac=frac).collect()
    cut = int(len(stream) * frac)
    for split, want in (("train", stream[:cut]), ("val", stream[cut:])):
        parts = sorted((r.start, r.tokens) for r in rows if r.split == split)
        assert [t for _, tokens in parts for t in tokens] == want
        at = 0
        for start, tokens in parts:
            assert start == at
            at += len(tokens)


def test_windows(spark, docs, stream):
    rng = random.Random(6)
    at = [0, 0, 0, len(stream) - 17] + [rng.randrange(len(stream) - 17) for _ in range(200)]
    offsets = spark.createDataFrame(list(enumerate(at)), "sample int, offset bigint")
    got = windows_at(with_offsets(frame(spark, docs)), offsets, 17).collect()
    assert len(got) == len(at)
    for r in got:
        assert r.window == stream[r.offset:r.offset + 17]


def test_long_windows(spark, docs, stream):
    offsets = spark.createDataFrame([(0, 5), (1, 3000)], "sample int, offset bigint")
    for r in windows_at(with_offsets(frame(spark, docs)), offsets, 5000).collect():
        assert r.window == stream[r.offset:r.offset + 5000]


def test_windows_plan_has_no_nested_loop(spark, docs):
    offsets = spark.createDataFrame([(0, 5)], "sample int, offset bigint")
    plan = windows_at(with_offsets(frame(spark, docs)), offsets, 17)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("most, kind", [(100, "tinyint"), (1000, "smallint"), (65536, "int")])
def test_stream_tokens_cross_in_the_narrowest_type(spark, docs, most, kind):
    docs = [(i, [t % most for t in tokens]) for i, tokens in docs]
    stream = [t for _, tokens in docs for t in tokens]
    placed = token_stream(frame(spark, docs), size="n")
    assert dict(placed.dtypes)["tokens"] == f"array<{kind}>"
    assert token_total(placed, size="n") == token_total(placed) == len(stream)
    offsets = spark.createDataFrame([(i, i * 97) for i in range(50)], "sample int, offset bigint")
    got = windows_at(placed, offsets, 17)
    assert dict(got.dtypes)["window"] == "array<int>"
    rows = got.collect()
    assert len(rows) == 50 and all(r.window == stream[r.offset:r.offset + 17] for r in rows)


def test_stream_total_reads_no_token(spark, docs):
    placed = token_stream(frame(spark, docs), size="n")
    plan = placed.agg(F.sum("n"))._jdf.queryExecution().executedPlan().toString()
    assert "tokens" not in plan.split("FileScan parquet", 1)[1].split("ReadSchema")[1].split(">")[0]


def test_samples(spark, docs, stream):
    placed = with_offsets(frame(spark, docs))
    rows = sample_windows(placed, 300, 8, seed=1).collect()
    assert len(rows) == 300 and len({r.offset for r in rows}) > 250
    for r in rows:
        assert 0 <= r.offset < len(stream) - 8
        assert r.x == stream[r.offset:r.offset + 8] and r.y == stream[r.offset + 1:r.offset + 9]
    again = {(r.sample, r.offset) for r in sample_windows(placed, 300, 8, seed=1).collect()}
    assert again == {(r.sample, r.offset) for r in rows}


def test_shards(spark, docs, stream):
    path = write_tokens(split_tokens(frame(spark, docs)), scratch_path(spark, "t"), "char", "en")
    assert path.endswith("/char_en")
    cut = int(len(stream) * 0.9)
    assert {r.split: r.tokens for r in token_counts(read_tokens(spark, path)).collect()} == {
        "train": cut, "val": len(stream) - cut}
    assert read_tokens(spark, path, "val").select("split").distinct().count() == 1


@pytest.mark.parametrize("bad", [65536, -1])
def test_ids_outside_sixteen_bits_fail(spark, bad):
    rows = spark.createDataFrame([(0, "train", 0, [65535, bad])], "doc_id bigint, split string, start bigint, tokens array<int>")
    with pytest.raises(Exception, match="out of range"):
        write_tokens(rows, scratch_path(spark, "t"))


def test_specials(spark):
    df = spark.createDataFrame([([10, 11], [12])], "a array<int>, b array<int>")
    def made(pair, template):
        r = df.select(add_specials(F.col("a"), F.col("b") if pair else None, template, 1, 2).alias("r")).first().r
        return r["ids"], r["types"]
    assert made(False, "bert") == ([1, 10, 11, 2], [0, 0, 0, 0])
    assert made(True, "bert") == ([1, 10, 11, 2, 12, 2], [0, 0, 0, 0, 1, 1])
    assert made(False, "xlnet") == ([10, 11, 2, 1], [0, 0, 0, 2])
    assert made(True, "xlnet") == ([10, 11, 2, 12, 2, 1], [0, 0, 0, 1, 1, 2])


def test_tokens_are_neither_sorted_nor_read_for_their_sizes(spark, monkeypatch):
    docs = [(i, list(range(i % 4))) for i in range(40)]
    plans, first = [], tokens.running
    monkeypatch.setattr(tokens, "running", lambda df, *rest: plans.append(
        df._jdf.queryExecution().executedPlan().toString()) or first(df, *rest))
    split = split_tokens(frame(spark, docs))
    plans.append(split._jdf.queryExecution().executedPlan().toString())
    assert "tokens#" not in plans[0].replace("_tokens#", "") and "SortMergeJoin" not in plans[1]
    assert "ShuffledHashJoin" in plans[1]
    assert split.agg(F.sum(F.size("tokens"))).first()[0] == sum(i % 4 for i in range(40))


def test_written_tokens_are_checked_by_list(spark):
    odd = [(1, [0, 65_535]), (2, []), (3, None)]
    rows = spark.createDataFrame(odd, "doc_id int, tokens array<long>").withColumns(
        {"split": F.lit("train"), "start": F.lit(0)})
    got = read_tokens(spark, write_tokens(rows, scratch_path(spark, "t"))).select("doc_id", "tokens")
    assert sorted(map(tuple, got.collect())) == odd and got.schema["tokens"].dataType.simpleString() == "array<int>"
    for bad in ([65_536], [-1], [3, None]):
        with pytest.raises(Exception):
            write_tokens(rows.withColumn("tokens", F.lit(bad).cast("array<long>") if None not in bad else F.expr(
                "array(3L, cast(null as bigint))")), scratch_path(spark, "t"))


def test_loss_reads_a_written_stream(spark, monkeypatch):
    names, first = [], loss_plan.staged
    monkeypatch.setattr(loss_plan, "staged", lambda df, name: names.append(name) or first(df, name))
    stream = split_tokens(frame(spark, [(i, [i % 3] * 9) for i in range(40)]))
    scores = lambda requests: requests.select("item", "idx", F.lit(-1.0).alias("score"))
    assert loss_plan.window_losses(stream, scores, 3, 4).count() == 6 and names == ["stream"]
