"""Every registered query against its SQL at the smallest scale."""

import math

import pytest

from corpuslab.catalog import load

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
QUERIES, ORACLES = load()
# training runs are checked against brute force on small texts in test_vocab
TRAINING = {n for n in QUERIES if n.startswith(("bpe", "wordpiece", "unigram"))}


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - TRAINING))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got
    if name in ORACLES:
        cur = sql.execute(ORACLES[name])
        columns = [d[0] for d in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows(columns, cur.fetchall())


def test_registry():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 100
