"""Pieces that run inside tasks, against brute force."""

import itertools
import random
import sys
import time

import numpy as np
import pyarrow as pa
import pytest

from corpuslab.llm import contamination, extraction, language, lm, packing, sharding, similarity
from corpuslab.llm.tokens import WordIds
from corpuslab.llm.toxicity import Automaton, Trie

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


def test_marginals_of_a_chain():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 4, 0, 3])
    potentials, steps = rng.normal(size=(8, 3)), rng.normal(size=(3, 3))
    got, pairs, norm = language.forward_backward(potentials, lengths, steps, pairs=True)
    at, want_pairs, want_norm = 0, np.zeros((3, 3)), 0.0
    for n in lengths:
        if not n:
            continue
        weights = {}
        for ys in itertools.product(range(3), repeat=int(n)):
            weights[ys] = np.exp(sum(potentials[at + i, y] for i, y in enumerate(ys))
                                 + sum(steps[a, b] for a, b in zip(ys, ys[1:])))
        total = sum(weights.values())
        want_norm += np.log(total)
        want = np.zeros((n, 3))
        for ys, w in weights.items():
            for i, y in enumerate(ys):
                want[i, y] += w / total
            for a, b in zip(ys, ys[1:]):
                want_pairs[a, b] += w / total
        assert np.allclose(got[at:at + n], want)
        at += n
    assert np.allclose(pairs, want_pairs) and np.isclose(norm, want_norm)


def test_marginals_of_a_tree():
    page = extraction.Page("<body><div class=menu><p>One two.</p></div><p>Three <b>four</b></p></body>")
    model = extraction.prior()
    got, pair = extraction.Forest([page, extraction.Page("")]).marginals(model)
    n = len(page.parents)
    own = [sum(model.unary[f] for f in fs) for fs in page.features]
    total, want, want_pair = 0.0, np.zeros(n), np.zeros((2, 2))
    for ys in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(o for o, y in zip(own, ys) if y)
                   + sum(model.pairs[ys[p], ys[i]] for i, p in enumerate(page.parents) if p >= 0))
        total += w
        want += w * np.array(ys)
        for i, p in enumerate(page.parents):
            if p >= 0:
                want_pair[ys[p], ys[i]] += w
    assert np.allclose(got[:n], want / total) and np.allclose(pair, want_pair / total)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(2)
    word = lambda low, high: "".join(rng.choice("abc") for _ in range(rng.randint(low, high)))
    terms = sorted({word(3, 10) for _ in range(25)})
    trie = Trie()
    for t in terms:
        trie.add(t, False)
    automaton = Automaton(trie)
    for w in {word(1, 12) for _ in range(1500)} | set(terms):
        near = [t for t in terms if distance(w, t) <= (len(t) >= 5) + (len(t) >= 9)]
        assert automaton.match(w) == (2 if w in terms else 1 if near else 0), w


def test_stems_open_words():
    trie = Trie()
    trie.add("achlich", True)
    automaton = Automaton(trie)
    assert [automaton.match(w) for w in ("achlich", "achlichkeit", "achlic", "xachlich", "")] == [2, 2, 0, 0, 0]


ODD = [
    "", " ", "A b c", "It's  the\nend.", "naïve Ünïcode ÉTÉ ñ", "<|startoftext|> x<|endoftext|>y",
    "日本語 text", "İstanbul ǅ Σας", "a b c", "12 345,6 $9.99", "x" * 3000, "é ́a",
    "don't we'll I'M", "\x1c\x00\x7f ok", "👍🏽 emoji",
]


def test_word_ids_equal_the_library():
    path = public.path("word_bpe_49k.json")
    whole = tokenizers.Tokenizer.from_file(path)
    ids, bounds = WordIds(path).texts(pa.array([*ODD, None]))
    for i, text in enumerate([*ODD, ""]):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_ids_of_words_are_kept_small():
    path = public.path("word_bpe_49k.json")
    known = WordIds(path)
    known.texts(pa.array([" ".join(f"word{i} other{i} Some-{i}" for i in range(2000))]))
    kept = [*known.words.values(), *known.parts.values()]
    assert len(known.words) == 6000
    assert sum(map(sys.getsizeof, kept)) <= 64 * len(kept)


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan(seed):
    rng = random.Random(seed)
    sizes = [min(100, int(rng.expovariate(1 / 30)) + 1) for _ in range(rng.choice([0, 1, 50, 2000]))]
    counts = {s: sizes.count(s) for s in set(sizes)}
    plan = packing.Sweeps(counts, 100)
    used, placed = {}, 0
    for size, low, high, first, offset in plan.placed:
        for k in range(high - low + 1):
            used.setdefault(first + k, []).append((offset, size))
            placed += 1
    assert placed == len(sizes) and sorted(used) == list(range(plan.sequences))
    for parts in used.values():
        end = 0
        for offset, size in sorted(parts):
            assert offset == end
            end += size
        assert end <= 100
    bins = []
    for s in sorted(sizes, reverse=True):  # best fit, one document at a time
        fits = [b for b in range(len(bins)) if bins[b] >= s]
        if fits:
            bins[min(fits, key=lambda b: bins[b])] -= s
        else:
            bins.append(100 - s)
    assert plan.sequences <= max(len(bins) * 1.02, len(bins) + 1)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 97, 100, 1000])
def test_permutation(n):
    places = sharding.permute(np.arange(n), n, 7)
    assert sorted(places.tolist()) == list(range(n))
    if n >= 97:
        assert places.tolist() != list(range(n)) and places.tolist() != sharding.permute(np.arange(n), n, 8).tolist()


@pytest.mark.parametrize("size", [3, 4, 5, 7, 12, 30, 80, 300])
def test_similar_sets_share_as_many_signatures_as_they_need(size):
    rng = np.random.default_rng(size)
    for _ in range(60):
        other = int(rng.integers(-(-size * 3 // 4), size * 4 // 3 + 1))
        common = -(-3 * (size + other) // 7)  # the least that is similar
        if common > min(size, other):
            continue
        pool = rng.integers(0, 2**63, size + other - common).astype(np.uint64)
        a = np.unique(pool[:size])
        b = np.unique(np.concatenate([pool[:common], pool[size:]]))
        if len(a) != size or len(b) != other:
            continue
        sig, at, band, need = similarity.signatures(np.concatenate([a, b]), np.array([0, size, size + other]))
        mine = [{(s, g): n for s, g, n, o in zip(sig, band, need, at) if o == k} for k in (0, 1)]
        shared = set(mine[0]) & set(mine[1])
        assert any(
            sum(g == x for _, g in shared) >= max(
                max((n for (_, g), n in m.items() if g == x), default=0) for m in mine)
            for x in {g for _, g in shared}), (size, other)


def test_filter_never_reads_too_little():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**63, 500).astype(np.uint64)
    counts = rng.integers(1, 40, 500)
    lookup = lm.Filter(2**16, 4)
    bits = np.zeros(lookup.part << 4, bool)
    bucket, key = lm.split_key(keys, 4)
    for level in range(1, 7):
        often = counts >= 2 ** (level - 1)
        for probe in range(lm.PROBES):
            bits[lookup.place(bucket[often], key[often], level, probe)] = True
    lookup.data[:] = np.packbits(bits, bitorder="little")
    read = lookup.read(keys)
    assert (read >= np.log2(counts).astype(int) + 1).all()
    assert (read == np.log2(counts).astype(int) + 1).mean() > 0.95
    assert (lookup.read(rng.integers(0, 2**63, 2000).astype(np.uint64)) > 0).mean() < 0.1


def test_templates():
    text = "In 1999 the shop of Mary sold 12 kg of the best green tea. The end"
    hashed, plain, at, word, bounds = contamination.template(pa.array([text, None, "", "!!"]))
    assert bounds.tolist() == [0, 16, 16, 16, 16]
    assert [word[i] for i, p in zip(at, plain) if not p] == ["1999", "mary", "12", "kg"]


def test_pages_with_unended_silent_elements():
    article = "<article><h1>Title</h1><p>Some long text of the story, as it was told to us that day.</p></article>"
    want = "Title Some long text of the story, as it was told to us that day."
    pages = [
        f"<html><head><title>T</title><meta charset=utf-8><body>{article}</body></html>",
        f"<html><head><title>T</title><style>p{{}}</style>{article}</html>",
        f"<html><head><noscript><link href=x></noscript><script>1</script></head><body>{article}</body></html>",
        f"<html><head><noscript><img src=x></noscript><title>T</title><body>{article}</body></html>",
        f"<body><svg><path d=x>{article}</body>", f"<body><object data=x>{article}</body>",
        f"<body><noscript><p>Turn it on, we ask you, it is needed here.</p></noscript>{article}</body>",
        f"<body><noscript>{article}<noscript>x</noscript></body>", f"<head><title>T</title>\n</head><body>{article}</body>", f"<body><object><p>It needs a plugin, we are sorry.</p></object>{article}</body>",
    ]
    assert extraction.extract(extraction.train([]), pages) == [want] * len(pages)


HOSTILE = {
    "quotes without an end": '<a href="', "mixed quotes": "<a x=\"<b y='", "tags without an end": "<p ", "nested": "<svg>",
    "nested inline": "<b>", "strange ends": "<b></i>", "sections": "<![CDATA[", "declarations": "<!x", "open objects": "<object",
    "implied ends": "<dl><dd>", "paragraphs": "<p><b>",
}


@pytest.mark.parametrize("unit", HOSTILE.values(), ids=HOSTILE)
def test_pages_are_read_in_linear_time(unit):
    article = "<article><p>Some long text of the story, as it was told to us that day.</p></article>"
    started = time.process_time()
    page = extraction.Page(article + unit * (2_000_000 // len(unit)))
    assert time.process_time() - started < 30  # minutes to hours if each place looks at all others
    assert page.runs[min(page.runs)] == "Some long text of the story, as it was told to us that day."


def test_ends_of_damaged_tags():
    read = lambda source: list(extraction.Page(source).runs.values())
    assert read('a <b x="1>2" y=\'>\'>c</b> d') == ["a c d"]
    assert read("a <b x=\"> c <i>d</i> e") == ['a <b x="> c d e']  # the quote never ends: the sign is text
    assert read("a <b x=\"> c <i y='> d <u z=\"'>e") == ['a <b x="> c e']  # and <i> reaches to the last sign
    assert read("a <![CDATA[x <b> y]]> c <![CDATA[ d> e <! f") == ["a x <b> y c e <! f"]
    assert read("a <!-- b > c --> d <!-- e <p>f") == ["a d"]
    assert read("a <object><p>b<p>c</object> d <object><p>e") == ["a", "d", "e"]  # a block parts runs, also a silent one


def test_page_parts():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
    <ul id="main-menu"><li><a href="/">Home</a></li></ul><script>var t = "</p>";</script>
    <div class="wrap"><h1>The news &amp; more</h1><p>First   words of the <b>long</b> story, told by
    someone who was there that day.<p>Second&nbsp;part<br>third part of the same story, again quite long.
    <div class="ad-slot">Buy our very fine things today, they are cheap.</div><!-- no > comment -->
    <div class='comments'><p>I was there too, and it was not like that at all, believe me.</p></div></div>
    <aside><p>Other stories that you may like, some of them long ones.</p></aside>
    <form><label>Mail</label><button>Send</button></form><footer>&copy; us</footer></body></html>"""
    text, empty, none = extraction.extract(extraction.train([]), [page, "", "<p"])
    assert text == (
        "The news & more First words of the long story, told by someone who was there that day. "
        "Second part third part of the same story, again quite long.")
    assert empty == "" and isinstance(none, str)
