"""The operators on spelling variants, repeated passages and whitening, next to brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslab.llm import spelling, substrings, whitening
from corpuslab.llm.common import join_counted

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = "doc_id long, text string, word string, n int, start int, x string, kept string"
LONG = "word " * 40_000 + "x" * 20_000


def odd_rows(texts):
    return [(i, t, "w", 1, 2, "x", None) for i, t in texts]


# ---- spelling variants

def edits_apart(a, b):
    """Whether one inserted, deleted or replaced character turns ``a`` into ``b``."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(counts):
    near = {w: [v for v in counts if edits_apart(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None)
            for w, n in counts.items()}


def told(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_variants_equal_all_pairs(spark):
    rng = random.Random(5)
    counts = collections.Counter()
    while len(counts) < 400:
        word = "".join(rng.choice("aabé") for _ in range(rng.randint(2, 6)))
        counts[word] = rng.choice((1, 2, 3, 30, 31, 400, 5_000))
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(7)
    assert told(spelling.variants(df, least=2, seen=1)) == brute_variants(counts)


def test_variants_add_up_rows_and_follow_chains(spark):
    counts = {"aaaaaaa": 1, "aaaaaab": 10, "aaaaabb": 100, "aaaabbb": 1_000, "aaabbbb": 10_000,
              "😀aaaaaa": 2, "zzzzzzz": 5}
    rows = [(w, n - n // 2) for w, n in counts.items()] + [(w, n // 2) for w, n in counts.items()]
    df = spark.createDataFrame([*rows, (None, 9), ("short", 50)], "word string, n long")
    found = told(spelling.variants(df, seen=1))
    assert found == brute_variants(counts)
    assert {r[2] for r in found if r[0] == "aaaaaaa"} == {"aaabbbb"}


def test_node_numbers_are_the_same_in_any_number_of_ranges(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(300)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    many = {r["word"]: r["nodes"] for r in spelling.number_nodes(df, "word", "nodes").collect()}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        split = {r["word"]: r["nodes"] for r in spelling.number_nodes(df, "word", "nodes").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert many == split
    node = {}
    for word in words:
        for i in range(len(word) + 1):
            assert node.setdefault(word[:i], many[word][i]) == many[word][i]
    assert len(set(node.values())) == len(node)
    assert sorted(words) == sorted(words, key=lambda w: many[w][-1])


def brute_words(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 31 == 0:
                at = h % len(low)
                low = low[:at] + low[at + 1:]
            if len(low) >= 7:
                counts[low] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def test_words_of_documents(spark):
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choice(("Ünfähig", "MISSPELL", "misspelt", "ÀÉÎÕÜÝÞß", "seven77letters",
                                      "overlooked")) for _ in range(30))) for i in range(60)]
    rows = [*texts, (None, "misspell misspell"), (7, None), (8, ""), (9, LONG), (9, LONG)]
    df = spark.createDataFrame(odd_rows(rows), ODD)
    found = told(spelling.variants(spelling.document_words(df)))
    assert found == brute_variants(brute_words(rows))
    assert any(r[1] for r in found)


def test_variants_of_nothing(spark):
    df = spark.createDataFrame([], ODD)
    assert spelling.variants(spelling.document_words(df)).collect() == []


# ---- repeated passages

def brute_repeats(rows, size):
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = collections.Counter(
        tuple(w[j:j + size]) for _, w in texts for j in range(len(w) - size + 1))
    out = []
    for doc_id, w in texts:
        gone = set()
        for j in range(len(w) - size + 1):
            if seen[tuple(w[j:j + size])] > 1:
                gone.update(range(j, j + size))
        rest = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc_id, len(w), len(gone), rest))
    return sorted(out, key=repr)


def repeats(df, **options):
    found = substrings.without_repeats(df, **options)
    return sorted(map(tuple, found.select("doc_id", "n_words", "n_removed", "kept").collect()), key=repr)


def planted(seed, alphabet, docs=60):
    rng = random.Random(seed)
    passages = [[rng.choice(alphabet) for _ in range(rng.randint(4, 60))] for _ in range(6)]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages) if rng.random() < 0.4 else [
                rng.choice(alphabet) for _ in range(rng.randint(1, 30))]
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed,alphabet,size,seed_words", [
    (1, "abcdefghijklmnopqrst", 9, 3), (2, "ab", 8, 2), (3, "ab", 6, 6), (4, "abc", 7, 1)])
def test_repeats_equal_brute_force(spark, seed, alphabet, size, seed_words):
    rows = planted(seed, alphabet)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert repeats(df, size=size, seed=seed_words) == brute_repeats(rows, size)


def test_repeats_in_odd_rows(spark):
    rng = random.Random(9)
    page = " ".join(str(rng.randint(0, 10**6)) for _ in range(50))
    edge = " ".join(str(rng.randint(0, 10**6)) for _ in range(34))
    rows = [(1, page), (1, page), (1, page), (None, page + "\x0b tail"), (None, "lead " + page), (None, None),
            (2, ""), (3, None), (4, " \t\n"), (5, edge), (6, edge), (7, "\x85    "), (8, LONG),
            (9, "a b c " * 30), (9, edge + " 1 2"), (9, "x " + edge + " 1")]
    df = spark.createDataFrame(odd_rows(rows), ODD)
    assert repeats(df) == brute_repeats(rows, 35)
    digest = substrings.without_repeats(df, digest=True).where("doc_id = 5").collect()
    assert [r["kept"] for r in digest] == [hashlib.sha256(edge.encode()).hexdigest()]


def test_repeats_of_nothing(spark):
    assert repeats(spark.createDataFrame([], ODD)) == []


def test_a_passage_of_a_third_of_the_documents(spark):
    rng = random.Random(2)

    def fill(n):
        return " ".join(str(rng.randint(0, 10**9)) for _ in range(n))

    common = fill(36)
    rows = [(i, f"{fill(20)} {common} {fill(20)}" if i % 3 == 0 else fill(60)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = repeats(df)
    assert found == brute_repeats(rows, 35)
    assert sum(r[2] for r in found) == 300 * 36


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.integers(1, 9))
def test_sliding_least_is_the_rightmost(values, size):
    values = np.array(values, np.uint64)
    expected = [max(range(i, i + size), key=lambda j: (-int(values[j]), j))
                for i in range(len(values) - size + 1)]
    assert substrings.rightmost_least(values, size).tolist()[:len(expected)] == expected


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ab", "c"]), max_size=60), st.integers(1, 12))
def test_run_hashes_tell_runs_apart(words, size):
    coded = pa.array(words, pa.string()).dictionary_encode()
    hashes = substrings.run_hashes(substrings.word_hashes(coded)[0], size, substrings.BASES[0])
    runs = [tuple(words[i:i + size]) for i in range(len(words) - size + 1)]
    assert len(hashes) == len(runs)
    assert len(set(zip(runs, hashes.tolist()))) == len(set(runs)) == len(set(hashes.tolist()))


# ---- whitening

def brute_whitening(vectors, weights=None, components=4):
    x = np.floor(256 * np.array(vectors, float)).astype(np.int64)
    distinct, counts = np.unique(x, axis=0, return_counts=True)
    w = counts if weights == "count" else np.ones(len(distinct), np.int64)
    n, sums = int(w.sum()), (distinct * w[:, None]).sum(axis=0)
    away = distinct - sums / n
    values, axes = np.linalg.eigh((away * w[:, None]).T @ away / n)
    order = np.argsort(-values)[:components]
    y = (x - sums / n) @ axes[:, order] / np.sqrt(values[order])
    return n, y, values[order] / values.sum(), ((n * x - sums) ** 2).sum(axis=1)


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening_equals_numpy(spark, weights):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 7)) * np.array([9, 5, 3, 2, 1, 1, 0.5]) + 3
    vectors = np.concatenate([base, np.repeat(base[:1], 200, axis=0)]).astype(np.float32)
    df = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, v array<float>").repartition(5)
    found = whitening.whiten(df, "vec_id", "v", weights=weights).toPandas()
    n, y, explained, deviation = brute_whitening(vectors, weights)
    table = found.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.abs(table) - np.abs(y)).max() < 1e-9
    assert set(found["n"]) == {n}
    assert np.allclose(found.drop_duplicates("component").sort_values("component")["explained"], explained)
    assert found.drop_duplicates("vec_id").sort_values("vec_id")["deviation"].tolist() == deviation.tolist()
    assert found["identity_error"].max() < 1e-9 and found["identity_error"].nunique() == 1


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, -0.0]), (1, [1.0, 0.0]), (None, [0.5, -2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]),
            (5, [inf, 1.0]), (6, []), (7, [1.0, 2.0, 3.0]), (8, [-inf, 0.0]), (9, [2.0, 1.0]), (10, [-0.001, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2.0, 3) for r in rows],
                               "vec_id long, v array<float>, n int, whitened double, component int")
    found = whitening.whiten(df, "vec_id", "v").toPandas()
    planes = found[found["vec_id"] != 7]
    assert sorted(planes["component"].value_counts().to_dict().items()) == [(1, 5), (2, 5)]
    assert set(planes["n"]) == {4} and planes["identity_error"].max() < 1e-9
    assert planes["vec_id"].isna().sum() == 2
    alone = found[found["vec_id"] == 7]
    assert alone["whitened"].isna().all() and alone["identity_error"].isna().all()
    assert alone["deviation"].tolist() == [0, 0, 0] and alone["explained"].tolist() == [0.0] * 3


def test_whitening_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, v array<float>")
    found = whitening.whiten(df, "vec_id", "v")
    assert found.columns[:3] == ["vec_id", "component", "n"] and found.collect() == []


def test_whitening_beyond_longs_is_exact_or_null(spark):
    df = spark.createDataFrame([(1, [1e18, 1.0]), (2, [-1e18, 2.0])], "vec_id long, v array<double>")
    found = whitening.whiten(df, "vec_id", "v").collect()
    assert all(r["deviation"] is None for r in found) and len(found) == 4


def test_join_counted_splits_hot_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 10}") for i in range(3_000)], "i long, k string")
    counted = rows.groupBy("k").count().withColumnRenamed("count", "c")
    joined = join_counted(rows, counted, ["k"], "c", 3_000, ["i"])
    assert joined.count() == 3_000 and joined.select("i").distinct().count() == 3_000
    assert joined.where("k = 'hot'").select("c").distinct().collect()[0][0] == 2_000
