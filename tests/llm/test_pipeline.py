"""The pipeline over the smallest tables, each stage against brute force on its own input."""

import collections
import re

import pytest

import corpus_pipeline
from corpuslab.llm import queries
from corpuslab.session import staged
from tests.llm.test_operators import WORD, base_spans, brute_groups

SF = "/root/testdata/sf0.001"


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def plain(text):
    return " ".join(WORD.findall((text or "").lower()))


def test_stages(spark):
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    before = texts(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), "stage")
        assert docs.columns == columns, name
        assert docs.count() == docs.select("doc_id").distinct().count()
        kept[name] = texts(docs)
    with_letters = {i for i, t in before.items() if re.search(r"[^\W\d_]", t or "")}
    assert set(kept["language"]) == with_letters
    groups = brute_groups(sorted(kept["language"].items()))
    assert set(kept["near duplicates"]) == {i for i, n, c in groups if i == c or n == 0}
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {i for i, t in kept["near duplicates"].items() if any(x in plain(t) for x in items)}
    assert leaked and set(kept["decontamination"]) == set(kept["near duplicates"]) - leaked
    found = 0
    for i, text in kept["personal data"].items():
        was = kept["decontamination"][i]
        if base_spans(was):
            found += 1
            assert text != was and not base_spans(text)
        elif "[" not in text:
            assert text == was
    assert found and set(kept["personal data"]) == set(kept["decontamination"])
    lengths = {r.doc_id: r.n_chars for r in docs.select("doc_id", "n_chars").collect()}
    assert all(lengths[i] == len(t) for i, t in kept["personal data"].items())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(kept["personal data"])
    ends = collections.Counter()
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 4096


def test_rows_without_an_id_and_repeated_rows(spark):
    rows = [(None, "some text without an id", "en"), (1, "one text that comes twice in the table", "en"),
            (1, "one text that comes twice in the table", "en"), (2, "one text that comes twice in the table", "en"),
            (3, None, "en"), (4, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    once = corpus_pipeline.keep_one_of_a_group(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in once) == [
        (0, "some text without an id"), (1, "one text that comes twice in the table"), (3, ""), (4, "")]
    empty = docs.where("false")
    assert corpus_pipeline.keep_languages(spark, empty, SF).collect() == []
    assert corpus_pipeline.keep_one_of_a_group(spark, empty, SF).collect() == []
    assert corpus_pipeline.keep_clean(spark, empty, SF).collect() == []


def test_registered():
    names = list(queries.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5
