"""Operators on small tables: odd rows, brute force, planted cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corpuslab.llm import (
    contamination, extraction, language, lm, packing, pii, quality, sharding, similarity, toxicity,
)
from corpuslab.llm.common import Workspace, held_out, first_by_hash
from corpuslab.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
LONG = "unbroken" * 4000 + " " + "many words in one line " * 3000
ROWS = [
    (1, None), (2, ""), (3, "  \n\t"), (4, "one two three"), (5, "one two three"), (5, "one two three"),
    (6, LONG), (None, "a text without an id"), (7, "naïve Ünïcode ÉTÉ 日本語 👍🏽 !!! ###"),
    (8, "a b c d a b c d a b c x\nsame line\nsame line\n\nlast"), (None, None),
]
CLASHING = ("text_", "score", "n_words", "spans", "shard", "slot", "row", "lang_pred", "node", "component")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and columns named like results."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_quality_counts(odd, none):
    scored, _ = quality.quality(odd)
    got = collections.Counter(rows(scored.select("doc_id", *quality.COUNTS, "base_failed")))
    want = collections.Counter()
    for i, text in ROWS:
        text = text or ""
        w = WORD.findall(text)
        seen = collections.Counter(tuple(w[j:j + 3]) for j in range(len(w) - 2))
        again = {j + k for j in range(len(w) - 2) if seen[tuple(w[j:j + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)),
              len(lines) - len(set(lines)), len(again), len(w) < 50 or 2 * len(again) > len(w))] += 1
    assert got == want
    assert rows(quality.quality(none)[0]) == []


def test_quality_posterior_follows_the_votes(spark):
    good = "the cat sat on the mat and it was a very good day for all of us in the town "
    rng = random.Random(1)
    text = lambda bad: " ".join(
        w + rng.choice(["###", "$$$"]) if bad else w for w in rng.sample(good.split() * 9, 120))
    df = spark.createDataFrame([(i, text(i % 5 == 0)) for i in range(100)], "doc_id long, text string")
    scored, model = quality.quality(df)
    got = {r.doc_id: r.posterior for r in scored.select("doc_id", "posterior").collect()}
    assert all((got[i] < 0.5) == (i % 5 == 0) for i in got)
    assert model.accuracy("v_symbols") > 0.9


def languages(n, seed=1):
    rng = random.Random(seed)
    words = {"aa": ["tik", "tak", "tiko", "katik", "kit"], "bb": ["lumo", "mola", "olum", "lo", "mu"]}
    return [(i, " ".join(rng.choices(words[lang], k=30)), lang)
            for i in range(n) for lang in [rng.choice(["aa", "bb"])]]


def test_language(spark, odd, none):
    known = spark.createDataFrame(languages(60), "doc_id long, text string, lang string")
    model = language.fit(known)
    got = {r.doc_id: r for r in language.predict(known, model, keep=("lang",)).collect()}
    assert all(r.lang_pred == r.lang and 0.5 < r.score <= 1 for r in got.values())
    mixed = spark.createDataFrame([(1, "TIK tak lumo mola mu lo olum!")], "doc_id long, text string")
    assert language.predict(mixed, model).first().lang_pred == "bb"
    told = language.predict(odd, model, keep=CLASHING)
    assert collections.Counter(r[0] for r in rows(told)) == collections.Counter(r[0] for r in ROWS)
    und = {r.doc_id for r in told.where("lang_pred = 'und'").collect()}
    assert {1, 2, 3} <= und and 4 not in und
    assert rows(language.predict(none, model)) == []
    assert language.fit(known.where("false")) is None
    assert language.predict(mixed, None).first().lang_pred == "und"


def test_marginals_switch_with_the_language(spark):
    import pyarrow as pa

    known = spark.createDataFrame(languages(60), "doc_id long, text string, lang string")
    model = language.fit(known)
    marginals, lettered, _ = language.label_texts(model, pa.array(["tik tak kit lumo mola lo", None]))
    assert marginals[lettered].argmax(1).tolist() == [0, 0, 0, 1, 1, 1]


def test_first_by_hash(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("y"))
    got = collections.Counter(r.y for r in first_by_hash(df, "y", ["k"], 100).collect())
    assert got == {"a": 100, "b": 100}


@pytest.mark.parametrize("hot", range(6))  # ids whose hashes lie high and low
def test_first_by_hash_of_one_id(spark, hot):
    df = spark.range(6000).select(F.lit(hot).alias("k"), F.lit("a").alias("y"), F.col("id").alias("t"))
    df = df.unionByName(spark.createDataFrame([(9, "b", 1), (None, "b", 2)], "k int, y string, t long"))
    assert sorted(rows(first_by_hash(df, "y", ["k"], 100).select("y"))) == [("a",), ("b",), ("b",)]
    got = collections.Counter(r.y for r in first_by_hash(df, "y", ["k", "t"], 100).collect())
    assert got == {"a": 100, "b": 2}


def test_samples_with_repeated_ids(spark):
    """A language whose rows share one id is learned within its bound, copies or not."""
    texts = [(1, f"tik tak {i} kit", "x") for i in range(300)] + [(2, "lumo mola lo", "y")] * 300
    texts += [(i + 3, "bra kru tro", "z") for i in range(20)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    chains, labels = language.sample_chains(df, 40, 1, 8, "lang", "text", "doc_id")
    assert labels == ["x", "y", "z"]
    assert len(chains) == 40 + 1 + 20


def test_packing(spark, odd, none):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    whole = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    cut = packing.pieces(odd, path, 50, with_ids=True)
    got = collections.Counter()
    for r in cut.collect():
        assert len(r.ids) == r.length <= 50
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r.ids))
        got[r.doc_id, r.piece, r.start, tuple(r.ids)] += 1
    want = collections.Counter()
    for i, text in ROWS:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        for k, s in enumerate(range(0, len(ids), 50)):
            want[i, k, s, tuple(ids[s:s + 50])] += 1
    assert got == want
    placed = packing.pack(cut.drop("ids"), 50).collect()
    assert len(placed) == sum(want.values())
    by_sequence = collections.defaultdict(list)
    for r in placed:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 50
    assert rows(packing.pack(packing.pieces(none, path))) == []


def test_packing_takes_small_batches(spark, tmp_path, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    whole = pytest.importorskip("tokenizers").Tokenizer.from_file(public.path("word_bpe_49k.json"))
    key, log, plain = "spark.sql.execution.arrow.maxBytesPerBatch", str(tmp_path / "sizes"), packing.slices

    def noted(batch, text, size):
        with open(log, "a") as out:
            out.write(f"{batch.nbytes}\n")
        return plain(batch, text, size)

    monkeypatch.setattr(packing, "slices", noted)
    before, text = spark.conf.get(key, None), "some words " * 1000
    docs = spark.range(0, 2000, 1, 1).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 1000).alias("text"))
    got = packing.packed_documents(docs).select("doc_id", "length").collect()
    length = len(whole.encode(text, add_special_tokens=False).ids) + 1
    assert sorted(map(tuple, got)) == [(i, length) for i in range(2000)]
    with open(log) as sizes:
        seen = [int(x) for x in sizes]
    assert sum(seen) > 20e6 and max(seen) < 6e6
    assert spark.conf.get(key, None) == before


def test_toxicity(spark, odd, none):
    rng = random.Random(4)
    plain = ["house", "tree", "river", "stone", "cloud", "field", "bread", "light"]
    def text(toxic):
        out = rng.choices(plain, k=40)
        if toxic:
            for at in rng.sample(range(40), 4):
                out[at] = rng.choice(["gromblit", "snarfle", "dolt"])
        return " ".join(out)
    docs = [(i, text(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = df.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")).union(
        spark.sql("select 9999L, cast(null as int)"))
    model = toxicity.fit(df, labels)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert all((r.score >= 0.7) == (i % 4 == 0) == bool(r.predicted) for i, r in got.items())
    probe = spark.createDataFrame([
        (1, "you gromblitt, you snarrfle, you absolute GROMBL1T and dolt of the house"),
        (2, 'he said "gromblit" and wrote "snarfle": the definition of the word dolt'), (3, "")],
        "doc_id long, text string")
    by = {r.doc_id: r.score for r in toxicity.score(probe, model).collect()}
    assert by[1] >= 0.7 > by[2] and by[3] < 0.5
    told = toxicity.score(odd, model).collect()
    assert len(told) == len(ROWS) and all(0 <= r.score <= 1 for r in told)
    assert rows(toxicity.score(none, model)) == []
    assert toxicity.fit(df, labels.where("false")) is None
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def brute_groups(docs):
    sets = [(i, shingles(t)) for i, t in docs if i is not None]
    parent = {i: i for i, _ in sets}
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            both = len(a & b)
            if a and 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {(i, len(s), root(i)) for i, s in sets}


def test_similar_groups(spark, odd, none, monkeypatch):
    monkeypatch.setattr(similarity, "HUB_ROUNDS", 1)
    monkeypatch.setattr(similarity, "BLOCK_ITEMS", 3000)
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    docs, n = [], 0
    shared = [word() for _ in range(60)]
    for family in range(14):
        base = [word() for _ in range(rng.choice([3, 5, 7, 9, 20, 60, 200]))]
        if family % 3 == 0:
            base = base + shared
        for _ in range(rng.choice([1, 2, 12, 30])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = word()
            docs.append((n, " ".join(copy).title()))
            n += 1
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert set(rows(similarity.similar_groups(df))) == brute_groups(docs)
    got = rows(similarity.similar_groups(odd))
    assert len(got) == len(ROWS)
    assert {r for r in got if r[0] is not None} == brute_groups(ROWS)
    assert rows(similarity.similar_groups(none)) == []


def test_similar_groups_are_not_clustered_by_common_passages(spark, monkeypatch):
    """Sets that share only what many sets share are not compared with each other."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    docs = []
    passage = [word() for _ in range(70)]
    for family in range(12):
        base = [word() for _ in range(110)]
        for _ in range(8):
            changed = base[:]
            for at in rng.sample(range(110), 9):
                changed[at] = word()
            docs.append((len(docs), " ".join(passage + changed)))
    sizes = []
    staged = Workspace.staged

    def spy(work, df, name):
        out = staged(work, df, name)
        if name == "clusters":
            sizes.extend(r["count"] for r in out.groupBy("cluster").count().collect())
        return out

    monkeypatch.setattr(Workspace, "staged", spy)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert set(rows(similarity.similar_groups(df))) == brute_groups(docs)
    assert len(sizes) > 4 and max(sizes) <= 8


def test_components_end_at_stars(spark, monkeypatch):
    written = []
    keep = Workspace.staged
    monkeypatch.setattr(Workspace, "staged", lambda self, df, name: written.append(name) or keep(self, df, name))
    found = lambda edges: dict(rows(components(spark.createDataFrame(edges, "a long, b long"))))
    assert found([]) == {} and written == ["edges"]  # no round for what a round would not change
    written.clear()
    assert found([(5, 1), (1, 7), (9, 2), (3, 3), (5, 1), (None, 4)]) == {1: 1, 5: 1, 7: 1, 2: 2, 9: 2}
    assert written == ["edges"]
    written.clear()
    assert found([(3, 1), (3, 2), (4, 2)]) == {1: 1, 2: 1, 3: 1, 4: 1} and len(written) > 1


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = dict(rows(components(spark.createDataFrame(edges, "a long, b long"))))
    parent = {x: x for e in edges for x in e}
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


KINDS = ("email", "ip", "card", "phone")
BASE = [re.compile(p) for p in (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(text):
    def good(k, m):
        digits = re.sub("[^0-9]", "", m)
        luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, digits[::-1])))
        return (True, k == 1 and all(int(p) <= 255 for p in m.split(".")),
                14 <= len(digits) <= 19 and luhn % 10 == 0, 10 <= len(digits) <= 15)[k]
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(
        (m.start(), k, m.end()) for k in range(4) for m in BASE[k].finditer(text) if good(k, m.group())))


TRICKY = [
    "a@b.com_x@d.org", "x.y+z@mail-9.example.co.uk.", "a@b c@d.e", "1.2.3.4.5.6.7.8.9", "300.1.2.3 10.0.0.255",
    "0000255.1.1.01", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111", "+1 (555) 010-2030 x",
    "+12 345", "é@ü.de ñ+49 (0)30.12.34.56 78é", "5" * 5000, "1." * 3000, "@" * 50 + "a@b.c" * 300, "a" * 20000 + "@",
    "1 2 " * 4000, "👍🏽 a@b.co 👍🏽 +49 30 1234567 10.1.2.3",
]


def test_personal_data(spark, odd, none):
    docs = [(100 + i, t) for i, t in enumerate(TRICKY)] + ROWS
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = pii.personal_data(df)
    text_of = lambda c: pii.written(c)
    got = collections.Counter(rows(found.select(
        "doc_id", text_of(F.filter("spans", lambda e: e["base"])))))
    assert got == collections.Counter((i, base_spans(t or "")) for i, t in docs)
    assert len(rows(pii.personal_data(odd))) == len(ROWS) and rows(pii.personal_data(none)) == []


def test_personal_data_adds_spelled_out_addresses(spark):
    docs = [(i, f"please write a mail to me{i}@example.com or call +1 (555) 010-20{i:02d} today") for i in range(30)]
    docs += [(99, "my e-mail: jane.doe (at) example (dot) com, phone (555) 010-2030 please call")]
    found = pii.personal_data(spark.createDataFrame(docs, "doc_id long, text string"), keep_text=True)
    row = found.where("doc_id = 99").select(
        "text", pii.written(F.col("spans")).alias("s"), pii.redacted(F.col("text"), F.col("spans")).alias("r")).first()
    assert "email:11:" in row.s and "phone:" in row.s
    assert row.r.startswith("my e-mail: [EMAIL], phone ")


def test_candidates_of_all_forms(spark):
    forms = {
        3: ["(555) 123-4567", "555-123-4567", "030 12345678", "(030) 12345678", "030/1234567", "0171 123 4567",
            "06 12 34 56 78", "06-12-34-56-78", "612 345 678", "612 34 56 78", "91 123 45 67"],
        0: ["jane at host dot com", "jane.doe at mail dot host dot org", "jane arroba host punto es", "jane (at) host (dot) com"],
        1: ["10[.]0[.]0[.]1", "10 dot 0 dot 0 dot 1", "10.0.0[.]1", "2001:db8:0:0:0:0:0:1", "fe80::1ff:fe23"],
    }
    docs = [(k, v, f"{before}{v}{after}") for k, vs in forms.items() for v in vs
            for before, after in (("call ", ". Then"), ("see ", " today"), ("(x) ", "-"), ("", ""))]
    df = spark.createDataFrame(docs, "kind int, value string, text string")
    missed = pii.find_spans(df).select("kind", "value", "text", F.exists("_spans", lambda e: (e["kind"] == F.col("kind")) & (
        e["end"] - e["start"] == F.length("value"))).alias("hit")).where("not hit")
    assert rows(missed) == []
    some = [(i, f"please call our phone {v}.") for i, v in enumerate(forms[3][:7])]
    some += [(100 + i, f"please call our phone +49 30 1234{i:04d} today or write a mail to me{i}@example.com") for i in range(40)]
    found = pii.personal_data(spark.createDataFrame(some, "doc_id long, text string"), keep_text=True)
    got = rows(found.where("doc_id < 100").select(pii.redacted(F.col("text"), F.col("spans"))))
    assert got == [("please call our phone [PHONE].",)] * 7


def test_redaction_joins_overlapping_spans(spark):
    df = spark.createDataFrame([(1, "x +1 10.0.0.1 2345 y 10.0.0.9"), (2, "nothing"), (3, None)], "doc_id long, text string")
    found = pii.personal_data(df, keep_text=True)
    got = dict(rows(found.select("doc_id", pii.redacted(F.col("text"), F.col("spans")))))
    assert got[2] == "nothing" and got[3] is None
    assert re.fullmatch(r"x \[\w+\] y \[IP\]", got[1]), got[1]


def test_language_model(spark, odd, none):
    rng = random.Random(9)
    docs = ROWS + [(20 + i, " ".join(rng.choices(["Ab", "c", "d,", "e"], k=rng.randint(0, 30)))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("held_out", held_out(F.col("doc_id"), 5))
    token = lambda t: [*WORD.findall((t or "").translate(LOW)), "\n"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = collections.Counter(w for i, t in docs if not held(i) for w in token(t))
    total, kinds = sum(counts.values()), len(counts)
    got = lm.scores(df).collect()
    assert len(got) == len(docs)
    want = collections.defaultdict(list)
    for i, t in docs:
        want[i].append((held(i), len(token(t)), sum(counts[w] > 0 for w in token(t)), total,
                        sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in token(t))))
    for r in got:
        assert any(tuple(r[1:5]) == w[:4] and math.isclose(r.base_score, w[4], rel_tol=1e-9) for w in want[r.doc_id])
        assert math.isfinite(r.score)
    assert rows(lm.scores(none.withColumn("held_out", F.lit(False)))) == []
    assert len(rows(lm.scores(odd.withColumn("held_out", F.lit(True))))) == len(ROWS)


def test_language_model_knows_repeated_texts(spark):
    rng = random.Random(10)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=3)) for _ in range(60))
    known = [text() for _ in range(40)]
    docs = [(i, known[i % 40]) for i in range(400)] + [(1000 + i, text()) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("held_out", F.col("doc_id") >= 1000)
    gain = dict(rows(lm.scores(df).groupBy("held_out").agg(F.avg((F.col("score") - F.col("base_score")) / F.col("n_tokens")))))
    assert gain[False] > 0.5 > gain[True] + 0.3


def test_language_model_tunes_its_weights(spark, monkeypatch):
    rng = random.Random(11)
    known = [" ".join("".join(rng.choices("abcdefgh", k=3)) for _ in range(60)) for _ in range(40)]
    df = spark.createDataFrame([(i, known[i % 40]) for i in range(800)], "doc_id long, text string").withColumn(
        "held_out", held_out(F.col("doc_id"), lm.FOLDS))
    tuned = df.where(~F.col("held_out") & lm.tuning(F.col("doc_id"))).count()
    assert 0 < tuned < 60
    seen, fit = [], lm.fit_weights
    monkeypatch.setattr(lm, "fit_weights", lambda scored: seen.extend(fit(scored)) or seen)
    gain = lm.scores(df).agg(F.avg((F.col("score") - F.col("base_score")) / F.col("n_tokens"))).first()[0]
    assert gain > 0.5 and all(g > 0 for g in seen) and max(lm.GRID[g] for g in seen) >= 0.55
    assert fit(spark.createDataFrame([], "gains array<float>")) == [lm.GRID.index(lm.UNTUNED)] * lm.BANDS


def test_language_model_beyond_one_broadcast(spark, odd, monkeypatch):
    rng = random.Random(12)
    docs = ROWS + [(20 + i, " ".join(f"w{rng.randint(0, 400)}" for _ in range(80))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn(
        "held_out", held_out(F.col("doc_id"), lm.FOLDS))
    scored = lambda: sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in lm.scores(df).collect())
    want = scored()
    monkeypatch.setattr(lm, "FILTER_BITS", 2**10)
    assert scored() == want and len(want) == len(docs)
    monkeypatch.setattr(lm, "SEGMENT_TOKENS", 2**9)
    assert len(scored()) == len(docs)
    assert len(rows(lm.scores(odd.withColumn("held_out", F.lit(True))))) == len(ROWS)


def test_language_model_holds_the_shuffles_of_one_step(spark, monkeypatch):
    rng = random.Random(13)
    docs = [(i, " ".join(f"w{rng.randint(0, 400)}" for _ in range(80))) for i in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("held_out", F.lit(False))
    seen, staged = [], lm.staged
    monkeypatch.setattr(lm, "staged", lambda df, name: seen.append(name) or staged(df, name))
    monkeypatch.setattr(lm, "forget_shuffles", lambda spark: seen.append("forgotten"))
    assert lm.scores(df).count() == 100
    assert seen == ["token-counts", "forgotten", "levels", "forgotten", "scored"]


def test_filter_of_a_segment_counts_all_blocks(spark):
    docs = [(i, i % 3, i < 300, "a b") for i in range(330)] + [(999, 3, False, "a b x y")]
    df = spark.createDataFrame(docs, "doc_id long, block long, learned boolean, text string")
    found = lm.bigram_levels(df, 0).collect()
    assert sorted((r.block, sorted(r.blob)) for r in found) == [
        (b, [9, 9, 9]) for b in range(3)] + [(3, [0, 0, 0, 9, 9])]


def test_extraction(spark):
    pages = spark.createDataFrame(
        [(i, "u", f"<body><nav><a href=x>Home {i}</a></nav><article><h1>Title {i}</h1><p>Some long text of the "
          f"story number {i}, as it was told to us.</p></article><footer>&copy; us</footer></body>") for i in range(40)]
        + [(97, None, None), (98, "u", ""), (99, "u", "<div class='menu'>a</div>"), (1, "u", "<p>same id, another page, with words enough.</p>")],
        "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    model = extraction.fit(pages)
    got = extraction.main_text(pages, model).collect()
    assert len(got) == 44
    by = {r.page_id: r.text for r in got}
    assert by[5] == "Title 5 Some long text of the story number 5, as it was told to us."
    assert by[97] == by[98] == by[99] == ""
    assert rows(extraction.main_text(pages.where("false"), extraction.fit(pages.where("false")))) == []


def test_chosen_pages_are_bounded_and_each_read_once(spark, monkeypatch):
    page = "<article><p>Some long text of the story number {}, as it was told to us.</p></article>"
    pages = spark.createDataFrame(
        [(1, page.format(100))] * 500 + [(i, page.format(i)) for i in range(60)] + [(1, page.format(99)), (None, page.format(98))],
        "page_id long, html string")
    seen = []
    monkeypatch.setattr(extraction, "train", lambda sources: seen.append(sources) or extraction.prior())
    extraction.fit(pages)
    monkeypatch.setattr(extraction, "PAGES", 7)
    extraction.fit(pages)
    assert len(seen[0]) == len(set(seen[0])) == 63 and seen[1] == seen[0][:7]


def test_repeated_items_are_not_broadcast_beyond_the_bound(spark, monkeypatch):
    item = "one two three four five six seven eight nine ten people walked along the wide river towards a town"
    items = spark.createDataFrame([(i, item) for i in range(300)] + [(1000, "plus 25 = 12"), (1001, "plus 25 = 12")],
                                  "item_id long, text string")
    long = "here is a rather plain filler sentence about nothing much at all. " * 20000
    docs = spark.createDataFrame([(1, long + item + " " + long + item), (2, long), (3, "so plus 25 = 12 it is")], "doc_id long, text string")
    want = sorted((r.doc_id, r.item_id, r.matched) for r in contamination.leaks(docs, items).collect())
    assert [w[:2] for w in want] == [(1, i) for i in range(300)] + [(3, 1000), (3, 1001)]
    monkeypatch.setattr(contamination, "FILTER_WINDOWS", 50)  # windows are fewer than that, their rows are not
    frames, broadcast = [], F.broadcast
    monkeypatch.setattr(contamination.F, "broadcast", lambda df: frames.append(df.count()) or broadcast(df))
    assert sorted((r.doc_id, r.item_id, r.matched) for r in contamination.leaks(docs, items).collect()) == want
    assert all(n <= 50 for n in frames)


def test_template_leaks(spark, odd, none):
    item = ("A train leaves the big station at 7 with 120 people and Anna buys 3 tickets for the long way home "
            "before 9 in the evening while it rains")
    other = "Something else entirely that nobody would ever write twice in the same order of words here today"
    items = spark.createDataFrame([(1, item), (2, other), (3, None), (4, ""), (5, "too short")], "item_id long, text string")
    swapped = item.replace("7", "8").replace("120", "45").replace("Anna", "Karl").replace("3", "11")
    pre = "some words that come before the passage in this text and mean nothing at all "
    docs = ROWS + [
        (10, pre + item + " and more words"), (11, pre + swapped), (12, pre + item.upper().replace(" ", "  ")),
        (13, pre + " ".join(random.Random(1).sample(item.split(), len(item.split())))), (14, pre * 4),
        (15, item[:40]), (10, pre + item + " and more words"), (None, pre + other)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("place", F.lit(0)).withColumn("window", F.lit(1))
    got = {(r.doc_id, r.item_id): r for r in contamination.leaks(df, items).collect()}
    assert {(10, 1), (11, 1), (None, 2)} <= set(got) <= {(10, 1), (11, 1), (12, 1), (None, 2)}
    assert got[11, 1].reparameterised and not got[10, 1].reparameterised
    assert rows(contamination.leaks(none, items)) == []
    assert rows(contamination.leaks(df, items.where("false"))) == []


def test_slots_must_agree(spark):
    item = "first 4 apples lie here then 4 pears lie there and 4 plums lie under the old green tree outside"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = [(1, item.replace("4", "9")), (2, "first 9 apples lie here then 8 pears lie there and 7 plums lie under the old green tree outside")]
    got = [r.doc_id for r in contamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()]
    assert got == [1]


def test_one_torn_slot_leaves_the_rest(spark):
    twice = ("the slow journey over the high mountains takes 2 hours while both of them sit beside the window and "
             "look at 2 trains that stand in the valley below as evening falls over the quiet village")
    once = twice.replace("2 trains", "7 trains")
    items = spark.createDataFrame([(1, twice), (2, once.replace("journey", "trip")[::-1])], "item_id long, text string")
    docs = [(1, twice), (2, once), (3, twice.replace("2 hours", "5 hours").replace("2 trains", "9 trains")),
            (4, twice.replace("2", "6"))]
    got = {r.doc_id: r for r in contamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert [got[i].reparameterised for i in (1, 2, 3, 4)] == [False, True, True, True]


def test_items_without_windows_and_long_runs(spark, monkeypatch):
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ra", "so", "ti") for b in ("den", "fel", "gor", "hin", "jas", "kum", "lir")]
    items = spark.createDataFrame(
        [(1, "What is 17 plus 25?"), (2, "12 + 30 - 7 = 35 and 8 x 9 = 72 or 4 / 2 = 2"), (3, " ".join(words)), (4, None), (5, "!!")],
        "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "so we ask: what is 17 plus 25 in all"), (2, "so we ask: what is 17 plus 26 in all"),
         (3, "sums 12 + 30 - 7 = 35 and 8 x 9 = 72 or 4 / 2 = 2 are easy"), (4, "12 + 30 - 7 = 35 and 8 x 9 = 73 or 4 / 2 = 2"),
         (5, "before " + " ".join(words[20:33]) + " after"), (6, "before " + " ".join(words[20:32]) + " after"),
         (7, None), (8, "What is 17 plus 25? What is 17 plus 25?"), (9, "plus 25"), (None, "what is 17 plus 25")],
        "doc_id long, text string")
    pairs = lambda: sorted((str(r.doc_id), r.item_id) for r in contamination.leaks(docs, items).collect())
    want = [("1", 1), ("3", 2), ("5", 3), ("8", 1), ("None", 1)]
    assert pairs() == want
    monkeypatch.setattr(contamination, "FILTER_WINDOWS", 0)
    assert pairs() == want


def test_unfiltered_join_finds_the_same(spark, monkeypatch):
    item = "one two three four five six seven eight nine ten people walked along the wide river towards a town"
    items = spark.createDataFrame([(1, item + " far away from here")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + item + " far away from here"), (2, "no")], "doc_id long, text string")
    want = rows(contamination.leaks(docs, items))
    monkeypatch.setattr(contamination, "FILTER_WINDOWS", 0)
    assert rows(contamination.leaks(docs, items)) == want and len(want) == 1


def test_shards(spark, odd, none):
    got = sharding.shard(odd.select("doc_id", "shard", "text"), 4).collect()
    assert len(got) == len(ROWS)
    sizes = collections.Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    import numpy as np
    place = sharding.permute(np.arange(len(ROWS)), len(ROWS), 20_240)
    assert all((r["shard"], r["slot"]) == (place[r["row"]] % 4, place[r["row"]] // 4) for r in got)
    assert rows(sharding.shard(none, 4)) == []
