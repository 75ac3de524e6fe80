import collections
import random
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import vocab as V
from corpuslab.operators.encode import decode_corpus, encode_corpus, in_slices, word_encoder, words_encoder
from corpuslab.operators.merges import MergeTable, chains, flat, lists_of, merge_band
from corpuslab.operators.pretokens import assign_ids, pretoken_counts, pretokens
from corpuslab.operators.subwords import (
    PieceIndex, best_pieces, best_split, expected_pieces, expected_uses, prefixes,
)
from corpuslab.operators.vocab import (
    SPECIALS, Vocabulary, byte_alphabet, char_vocab, eos_id, exact_batch, train_bpe, train_unigram,
    train_wordpiece, vocab_size,
)

TEXTS = [
    "the cat sat on the mat, the cat's hat", "banana bandana anna aaaa aaaaa", "Été à la plage 2024  \n\n fin",
    "lower lowest newer newest wider widest", "日本語 text 😀😀 mixed", "I'll they've we're it's don't",
    "aaaa bbbb abab abab baba", "", " lead and trail ", "the the the then there these",
]


@pytest.fixture(params=["bands", "small bands", "short ranking", "batches"])
def route(request, monkeypatch):
    """All ways of merging: words in bands of any size, and pair by pair of the ranking."""
    symbols, ranked = {
        "bands": (500_000, 20_000), "small bands": (250, 20_000), "short ranking": (500, 40),
        "batches": (0, 512)}[request.param]
    monkeypatch.setattr(V, "BAND_SYMBOLS", symbols)
    monkeypatch.setattr(V, "RANKED_PAIRS", ranked)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").repartition(3).cache()


def learn_by_hand(words, specials, size, glue):
    """One merge at a time: highest count, then smallest ids."""
    vocab = [*specials, *sorted({s for w in words for s in w})]
    index = {t: i for i, t in enumerate(vocab)}
    state = [([index[s] for s in w], n) for w, n in words.items()]
    merges = []
    while len(vocab) < size:
        counts = collections.Counter()
        for ids, n in state:
            for pair in zip(ids, ids[1:]):
                counts[pair] += n
        if not counts:
            break
        pair = min(counts, key=lambda p: (-counts[p], p))
        token = glue(vocab[pair[0]], vocab[pair[1]])
        if token not in index:
            index[token] = len(vocab)
            vocab.append(token)
        merges.append((*pair, index[token]))
        for ids, _ in state:
            i = 0
            while i < len(ids) - 1:
                if (ids[i], ids[i + 1]) == pair:
                    ids[i:i + 2] = [index[token]]
                i += 1
    return vocab, merges


def byte_words(texts):
    regex = pytest.importorskip("regex")
    split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    alphabet = byte_alphabet()
    return collections.Counter(
        tuple(alphabet[b] for b in w.encode()) for t in texts for w in split.findall(t))


def test_byte_level_split(spark, corpus):
    alphabet = byte_alphabet()
    got = {tuple(alphabet[b] for b in r.word.encode()): r.freq
           for r in pretoken_counts(corpus, pretokens(F.col("text"), "byte")).collect()}
    assert got == dict(byte_words(TEXTS))


@pytest.mark.parametrize("size", [90, 400])
def test_bpe_equals_one_merge_at_a_time(corpus, size, route):
    vocab = train_bpe(corpus, size=size)
    tokens, merges = learn_by_hand(byte_words(TEXTS), SPECIALS["bpe"], size, lambda a, b: a + b)
    assert vocab.merges == merges
    assert vocab.tokens == tokens


def test_bpe_on_random_words(spark, route):
    rng = random.Random(11)
    texts = ["".join(rng.choice("aaabbc d") for _ in range(60)) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    vocab = train_bpe(df, size=120)
    assert vocab.merges == learn_by_hand(byte_words(texts), SPECIALS["bpe"], 120, lambda a, b: a + b)[1]


def test_earliest_merge_in_columns_equals_word_by_word():
    rng = random.Random(4)
    merges = [(0, 0, 3), (0, 1, 4), (3, 1, 5), (4, 4, 6), (1, 2, 7), (6, 7, 8), (2, 2, 9)]
    table = MergeTable(merges)
    words = [[rng.randrange(3) for _ in range(rng.randint(1, 40))] for _ in range(200)]
    ids, row = table.apply(*flat(pa.array(words, pa.list_(pa.int32()))))
    assert lists_of(ids, row, len(words)).to_pylist() == [table.apply_word(w) for w in words]


@pytest.mark.parametrize("kind", ["bpe", "wordpiece", "unigram"])
def test_a_word_of_many_letters(corpus, kind):
    train = {"bpe": train_bpe, "wordpiece": train_wordpiece, "unigram": train_unigram}[kind]
    vocab = train(corpus, size=150)
    rng = random.Random(8)
    word = "".join(rng.choice("abethn") for _ in range(300_000))
    encode = word_encoder(vocab)
    started = time.perf_counter()
    ids = encode(word)
    assert time.perf_counter() - started < 60
    assert "".join(vocab.tokens[i].removeprefix("##") for i in ids) == word
    tk = pytest.importorskip("tokenizers")  # quadratic or worse, so it gets the head of the word
    head = word[:2_000]
    if kind == "bpe":
        model = tk.models.BPE({t: i for i, t in enumerate(vocab.tokens)},
                              [(vocab.tokens[a], vocab.tokens[b]) for a, b, _ in vocab.merges])
        assert [t.id for t in model.tokenize(head)] == encode(head)
    if kind == "wordpiece":
        model = tk.models.WordPiece({t: i for i, t in enumerate(vocab.tokens)}, unk_token="[UNK]",
                                    max_input_chars_per_word=len(head))
        assert [t.id for t in model.tokenize(head)] == encode(head)


def test_exact_batch():
    assert exact_batch([(1, 2, 9), (3, 4, 8), (2, 5, 7)], True, 99) == [(1, 2), (3, 4)]
    assert exact_batch([(1, 2, 9), (1, 3, 8)], True, 99) == [(1, 2), (1, 3)]
    assert exact_batch([(1, 1, 9), (3, 4, 8)], True, 99) == [(1, 1)]
    assert exact_batch([(1, 2, 9), (3, 3, 8)], True, 99) == [(1, 2)]
    # an equal-count neighbour on the left of a merged pair may win the tie
    assert exact_batch([(1, 2, 9), (3, 4, 8), (5, 1, 8)], True, 99) == [(1, 2)]
    assert exact_batch([(1, 2, 9), (3, 4, 8), (5, 6, 8)], False, 99) == [(1, 2)]
    assert exact_batch([(1, 2, 9), (3, 4, 8)], True, 1) == [(1, 2)]


def test_bpe_against_public_library(corpus):
    tk = pytest.importorskip("tokenizers")
    tok = tk.Tokenizer(tk.models.BPE())
    tok.pre_tokenizer = tk.pre_tokenizers.ByteLevel(add_prefix_space=False)
    tok.train_from_iterator(TEXTS, tk.trainers.BpeTrainer(
        vocab_size=130, special_tokens=["<|endoftext|>"], show_progress=False))
    vocab = train_bpe(corpus, size=130)
    assert {t: i for i, t in enumerate(vocab.tokens)} == tok.get_vocab()
    got = {r.doc_id: r.tokens for r in encode_corpus(corpus, vocab).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i] == tok.encode(text, add_special_tokens=False).ids


def test_round_trips(corpus):
    for vocab in (train_bpe(corpus, size=100),
                  Vocabulary("char", [r.token for r in char_vocab(corpus).orderBy("id").collect()])):
        back = {r.doc_id: r.text for r in decode_corpus(encode_corpus(corpus, vocab), vocab).collect()}
        assert back == dict(enumerate(TEXTS))


def test_decoding_of_torn_empty_and_null_lists(spark):
    vocab = Vocabulary("bpe", [*SPECIALS["bpe"], *byte_alphabet()])
    snow = [1 + b for b in "☃".encode()]
    rows = [(0, snow[:2]), (1, []), (2, None), (3, [0, *snow, 0]), (4, [1 + 65])]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens array<int>").coalesce(1)
    got = {r.doc_id: r.text for r in decode_corpus(df, vocab).collect()}
    assert got == {0: "\ufffd", 1: "", 2: "", 3: "☃", 4: "A"}


def test_dense_ids_of_any_number(spark):
    tokens = spark.createDataFrame([(f"t{i % 700:03}",) for i in range(5_000)], "token string").repartition(6)
    want = {"<a>": 0, "<b>": 1} | {f"t{i:03}": i + 2 for i in range(700)}
    assert {r.token: r.id for r in assign_ids(tokens, ("<a>", "<b>")).collect()} == want


def test_char_vocabulary(spark, corpus):
    rows = char_vocab(corpus).orderBy("id").collect()
    want = ["<unk>", *sorted(set("".join(TEXTS)))]
    assert [r.token for r in rows] == want
    other = spark.createDataFrame([(0, "aé☃😀")], "doc_id bigint, text string")
    got = encode_corpus(other, Vocabulary("char", want)).first().tokens
    assert got == [want.index("a"), want.index("é"), 0, want.index("😀")]
    table = char_vocab(corpus)
    assert vocab_size(table).first()[0] == len(want)
    assert eos_id(table).first()[0] is None
    named = spark.createDataFrame([("</s>", 3), ("<eos>", 2)], "token string, id int")
    assert eos_id(named).first()[0] == 2


def test_wordpiece(corpus, route):
    vocab = train_wordpiece(corpus, size=110)
    import unicodedata
    def norm(t):
        t = "".join(" " + c + " " if "一" <= c <= "鿿" else c for c in t.replace("\n", " "))
        return "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn").lower()
    words = collections.Counter(w for t in TEXTS for w in norm(t).split())
    spelled = collections.Counter({
        tuple(c if i == 0 else "##" + c for i, c in enumerate(w)): n for w, n in words.items()})
    tokens, merges = learn_by_hand(
        spelled, SPECIALS["wordpiece"], 110, lambda a, b: a + b.removeprefix("##"))
    assert (vocab.tokens, vocab.merges) == (tokens, merges)
    encode = word_encoder(vocab)
    ids = {t: i for i, t in enumerate(tokens)}
    assert word_encoder(vocab, longest=100)("t" * 101) == [ids["[UNK]"]] and encode("☃") == [ids["[UNK]"]]
    assert encode("t" * 101)[0] == ids["t"] and len(encode("t" * 101)) > 1
    assert "".join(tokens[i].removeprefix("##") for i in encode("there")) == "there"


def test_wordpiece_without_pretokens_takes_whole_texts(corpus):
    vocab = train_wordpiece(corpus, size=180, pretok="none")
    assert any(" " in t for t in vocab.tokens)


def test_wordpiece_encoding_against_public_library(corpus):
    tk = pytest.importorskip("tokenizers")
    vocab = train_wordpiece(corpus, size=110)
    tok = tk.Tokenizer(tk.models.WordPiece({t: i for i, t in enumerate(vocab.tokens)}, unk_token="[UNK]"))
    tok.normalizer = tk.normalizers.BertNormalizer(lowercase=True)
    tok.pre_tokenizer = tk.pre_tokenizers.WhitespaceSplit()
    got = {r.doc_id: r.tokens for r in encode_corpus(corpus, vocab).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i] == tok.encode(text).ids


def test_wordpiece_decoding_against_public_library(spark):
    tk = pytest.importorskip("tokenizers")
    pieces = ["##ab", "the", "ca", "##t", ".", "is", "n't", "it", "'s", ",", "x", "##.", "?"]
    vocab = Vocabulary("wordpiece", [*SPECIALS["wordpiece"], *pieces])
    rows = [(0, list(range(5, 18))), (1, [6, 7, 8, 2, 9]), (2, []), (3, [9, 6])]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens array<int>")
    got = {r.doc_id: r.text for r in decode_corpus(df, vocab).collect()}
    decoder = tk.decoders.WordPiece(prefix="##")
    for i, ids in rows:
        assert got[i] == decoder.decode([vocab.tokens[t] for t in ids if t > 4])


@pytest.mark.parametrize("limit", [1, 37, 200, 100_000])
def test_unigram_seeds_are_not_ranked_on_the_driver(spark, monkeypatch, limit):
    rng = random.Random(8)
    words = collections.Counter("".join(rng.choices("abcé", k=rng.randrange(1, 7))) for _ in range(300))
    n = collections.Counter()
    for word, freq in words.items():
        for i in range(len(word)):
            for j in range(i + 1, min(len(word), i + 4) + 1):
                n[word[i:j]] += freq
    longer = sorted((-c * len(p), p) for p, c in n.items() if len(p) > 1 and c > 1)[:limit]
    want = sorted((p, c) for p, c in n.items() if len(p) == 1) + [(p, n[p]) for _, p in longer]
    df = spark.createDataFrame(list(words.items()), "word string, freq bigint").repartition(4)
    plans, collect = [], type(df).collect

    def spy(self):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return collect(self)

    monkeypatch.setattr(type(df), "collect", spy)
    assert V._seed_pieces(df, limit, 4) == want
    assert plans and not any("TakeOrdered" in p for p in plans)


def test_unigram_likelihood_does_not_fall(corpus):
    history = []
    vocab = train_unigram(corpus, size=90, steps=4, history=history)
    for losses in history:
        assert all(b >= a - 1e-6 for a, b in zip(losses, losses[1:]))
    assert len(vocab.tokens) <= 90 and vocab.tokens[:7] == list(SPECIALS["unigram"])
    assert set("▁abet") <= set(vocab.tokens)


def test_unigram_encoding_against_public_library(corpus):
    tk = pytest.importorskip("tokenizers")
    vocab = train_unigram(corpus, size=90)
    tok = tk.Tokenizer(tk.models.Unigram(list(zip(vocab.tokens, [
        -99.0 if t in SPECIALS["unigram"] else s for t, s in zip(vocab.tokens, vocab.scores)])), 2, False))
    n = tk.normalizers
    tok.normalizer = n.Sequence([n.Replace("``", '"'), n.Replace("''", '"'), n.NFKD(), n.StripAccents(),
                                 n.Replace(tk.Regex(" {2,}"), " ")])
    tok.pre_tokenizer = tk.pre_tokenizers.Metaspace()
    got = {r.doc_id: r.tokens for r in encode_corpus(corpus, vocab).collect()}
    for i, text in enumerate(TEXTS):
        want = tok.encode(text, add_special_tokens=False).ids
        score = lambda ids: sum(vocab.scores[t] for t in ids)
        assert got[i] == want or abs(score(got[i]) - score(want)) < 1e-9
    back = {r.doc_id: r.text for r in decode_corpus(encode_corpus(corpus, vocab), vocab).collect()}
    assert back[0] == TEXTS[0] and back[3] == TEXTS[3]


def test_splits_in_columns_equal_splits_word_by_word():
    rng = random.Random(3)
    scores = {"".join(rng.choice("abcé😀") for _ in range(rng.randint(1, 4))): -rng.random() * 8 for _ in range(60)}
    scores |= {c: -9.0 for c in "ab"} | {"é": -40.0}
    words = ["", *("".join(rng.choice("abcdé😀") for _ in range(rng.randint(1, 14))) for _ in range(2_000))]
    freqs = np.array([rng.randint(1, 5) for _ in words])
    index, starts = PieceIndex(scores), prefixes(scores)
    pieces, counts = best_pieces(words, index)
    got = [[index.pieces[i] if i >= 0 else None for i in p] for p in np.split(pieces, np.cumsum(counts)[:-1])]
    assert got == [[p if p in scores else None for p in best_split(w, scores, starts)[0]] for w in words]
    uses, loss = expected_uses(words, freqs, index)
    want, total = expected_pieces(words, freqs.tolist(), scores, starts)
    assert loss == pytest.approx(total)
    assert uses == pytest.approx(np.array([want.get(p, 0.0) for p in index.pieces]))


@pytest.mark.parametrize("kind", ["bpe", "wordpiece", "unigram"])
def test_encoding_in_columns_equals_encoding_word_by_word(corpus, kind):
    train = {"bpe": train_bpe, "wordpiece": train_wordpiece, "unigram": train_unigram}[kind]
    vocab = train(corpus, size=150)
    if kind == "bpe":  # tokens made in several ways, also after merges they are part of
        at = {t: i for i, t in enumerate(vocab.tokens)}
        vocab = Vocabulary("bpe", [*vocab.tokens, "zq", "qz", "zqz", "zqzz"], [*vocab.merges])
        zq, qz, both, more = (len(vocab.tokens) - i for i in (4, 3, 2, 1))
        vocab.merges += [(at["e"], at["t"], zq), (zq, at["h"], both), (both, at["e"], more), (at["t"], at["h"], qz),
                         (at["e"], qz, both), (at["a"], at["b"], both), (at["t"], at["h"], qz)]
    rng = random.Random(8)
    words = ["", *{"".join(rng.choice("abethn☃") for _ in range(rng.randint(1, 30))) for _ in range(3_000)}]
    for longest in (None, 6):
        ids, counts = words_encoder(vocab, longest)(words)
        encode = word_encoder(vocab, longest)
        assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [encode(w) for w in words]


def test_chains_are_cut_at_rare_pairs():
    words = pa.RecordBatch.from_arrays(
        [pa.array([[1, 2, 3, 1, 2], [9, 1, 2, 3], [7, 8], [2, 2, 2, 9]], pa.list_(pa.int32())), pa.array([5, 2, 9, 1])],
        ["ids", "freq"])
    got = chains(words, [], np.sort(np.array([1 << 32 | 2, 2 << 32 | 2, 2 << 32 | 3])))
    assert got.to_pydict() == {"ids": [[1, 2, 3], [1, 2], [1, 2, 3], [2, 2, 2]], "freq": [5, 5, 2, 1]}


def test_rounds_of_merging_do_not_grow_with_the_words(spark, monkeypatch):
    """Words that share their frequent pairs and differ in rare letters make one band, however many there are."""
    monkeypatch.setattr(V, "BAND_SYMBOLS", 2_000)
    bands = []
    monkeypatch.setattr(V, "merge_band", lambda lists, *rest: bands.append(len(lists)) or merge_band(lists, *rest))
    rng = random.Random(6)
    heads = ["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(12)]
    texts = [f"{rng.choice(heads)}{chr(0x4E00 + i)}{rng.choice(heads)}" for i in range(2_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    vocab = train_bpe(df, size=330)
    assert vocab.merges == learn_by_hand(byte_words(texts), SPECIALS["bpe"], 330, lambda a, b: a + b)[1]
    assert 1 <= len(bands) <= 4 and sum(bands) < 2_000


def test_batches_are_worked_on_in_slices():
    texts = ["ab" * 300, "", None, "c" * 2_000, "d", "e" * 999, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["doc_id", "text"])
    parts = list(in_slices(iter([batch, batch.slice(0, 0)]), pc.utf8_length, 1_000))
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts
    assert [p.num_rows for p in parts] == [3, 2, 2]  # a slice goes beyond its measure by one row at most
