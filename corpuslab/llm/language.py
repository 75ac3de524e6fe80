"""Language identification by a linear-chain conditional random field over words.

Each word is a position of the chain. Its features are character n-grams of orders two to
four with marks at both ends (those at the ends are its affixes) and, for words met often in
training, the word itself (the lexicon). Transitions between languages are learned as well:
some training chains join pieces of texts in different languages. Forward-backward gives the
marginal of each language at each word, so text that switches languages is labelled word by
word; a document's language is the one with the largest sum of marginals over its words with
letters, and its score that language's share.

Training takes at most ``per_label`` documents of each language (those first in the order of a
hash of their id) and ``chains`` windows of ``span`` words of each, the only bound in this module.
Prediction covers whole texts, in chains of ``CHAIN`` words.

A null text and a text without a letter are ``und`` with score 0; so is every text if no
labelled row is left to learn from. Ties go to the language first in order. Rows with a null
label are not learned from; repeated rows are predicted alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm.common import first_by_hash, held_out, table, words
from corpuslab.llm.tokens import slices

CHAIN, BITS, ORDERS = 256, 16, (2, 3, 4)
FOLDS = 3


@dataclass
class Model:
    labels: list[str]
    grams: np.ndarray  # weights of hashed n-grams, one row each
    lexicon: dict[str, int]
    lexical: np.ndarray  # weights of lexicon words
    steps: np.ndarray  # log transitions


def letters_only(found: pa.Array) -> list[str]:
    """Lower-cased words reduced to their letters."""
    return pc.replace_substring_regex(pc.utf8_lower(found), r"[^\p{L}]+", "").to_pylist()


def gram_ids(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram features: (index of the word, feature), ordered by word."""
    marked = "".join([f"\x02{w}\x03" for w in found])
    points = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(found)), np.fromiter(map(len, found), np.int64, len(found)) + 2)
    rows, features = [], []
    rolled = points * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for order in range(2, max(ORDERS) + 1):
            if len(points) < order:
                break
            rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            rolled = rolled + points[order - 1:] * np.uint64(0x94D049BB133111EB)
            same = owner[:-(order - 1)] == owner[order - 1:]
            rows.append(owner[:-(order - 1)][same])
            mixed = rolled[same]
            features.append(((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x2545F4914F6CDD1D)
                             >> np.uint64(64 - BITS)).astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row, feature = np.concatenate(rows), np.concatenate(features)
    order_by = np.argsort(row, kind="stable")
    return row[order_by], feature[order_by]


def emissions(model: Model, found: list[str]) -> np.ndarray:
    """Log potentials of each distinct word, one column for each label; 0 without letters."""
    out = np.zeros((len(found), len(model.labels)), np.float32)
    row, feature = gram_ids(found)
    for k in range(out.shape[1]):
        out[:, k] = np.bincount(row, model.grams[feature, k], len(found))
    known = [(i, model.lexicon[w]) for i, w in enumerate(found) if w in model.lexicon]
    if known:
        at, word = np.array(known).T
        out[at] += model.lexical[word]
    out[[not w for w in found]] = 0
    return out


def forward_backward(
    potentials: np.ndarray, lengths: np.ndarray, steps: np.ndarray, pairs: bool = False,
) -> tuple[np.ndarray, np.ndarray | None, float]:
    """Marginals of chains that lie one after another in ``potentials``.

    Chains run side by side, longest first, one position at a time. Also gives, if asked, the
    expected transitions, and the sum of the log partition functions.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    longest = int(lengths.max(initial=0))
    active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), "right")
    top = potentials.max(1, keepdims=True)
    e = np.exp(potentials - top)
    move = np.exp(steps - steps.max()).astype(e.dtype)
    alpha, beta = np.empty_like(e), np.empty_like(e)
    norm, state = float(top.sum(dtype=np.float64)), None
    for t in range(longest):
        at = starts[:active[t]] + t
        state = e[at] if t == 0 else (state[:active[t]] @ move) * e[at]
        total = state.sum(1, keepdims=True)
        state = state / total
        alpha[at] = state
        if pairs:
            norm += float(np.log(total, dtype=np.float64).sum()) + (t > 0) * active[t] * steps.max()
    expected = np.zeros_like(move) if pairs else None
    width = e.shape[1]
    later = np.zeros((0, width), e.dtype)
    for t in range(longest - 1, -1, -1):
        at = starts[:active[t]] + t
        here = np.ones((active[t], width), e.dtype)
        if len(later):
            weight = later * e[at[:len(later)] + 1]
            here[:len(later)] = weight @ move.T
            if pairs:
                joint = alpha[at[:len(later)], :, None] * move * weight[:, None, :]
                expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        here /= here.sum(1, keepdims=True)
        beta[at] = here
        later = here
    marginals = alpha * beta
    marginals /= marginals.sum(1, keepdims=True)
    return marginals, expected, norm


def train(
    chains: list[tuple[list[str], list[int]]], labels: list[str], rounds: int = 40,
    rate: float = 0.3, decay: float = 1e-4, frequent: int = 3,
) -> Model:
    """Fit by gradient ascent (Adagrad) on the likelihood of whole labelled chains."""
    flat = letters_only(pa.array([w for found, _ in chains for w in found], pa.string()))
    gold = np.array([y for _, ys in chains for y in ys])
    lengths = np.array([len(found) for found, _ in chains])
    distinct, index = np.unique(np.array(flat, dtype=object).astype(str), return_inverse=True)
    distinct = distinct.tolist()
    counts = np.bincount(index, minlength=len(distinct))
    lexicon = {w: i for i, w in enumerate(
        w for w, c in zip(distinct, counts) if c >= frequent and w)}
    width = len(labels)
    model = Model(labels, np.zeros((2**BITS, width), np.float32), lexicon,
                  np.zeros((len(lexicon), width), np.float32), np.zeros((width, width), np.float32))
    row, feature = gram_ids(distinct)
    lexical = np.array([lexicon.get(w, -1) for w in distinct])
    blank = np.array([not w for w in distinct])
    last = np.cumsum(lengths) - 1
    inner = np.ones(len(gold), bool)
    inner[last] = False
    before = np.flatnonzero(inner)
    seen = np.zeros((width, width), np.float32)
    np.add.at(seen, (gold[before], gold[before + 1]), 1)
    target = np.eye(width, dtype=np.float32)[gold]
    past = [np.full_like(x, 1e-6) for x in (model.grams, model.lexical, model.steps)]
    for _ in range(rounds):
        marginals, expected, _ = forward_backward(
            emissions(model, distinct)[index], lengths, model.steps, pairs=True)
        gap = target - marginals
        by_word = np.stack([np.bincount(index, gap[:, k], len(distinct)) for k in range(width)], 1)
        by_word[blank] = 0
        grams = np.stack([np.bincount(feature, by_word[row, k], 2**BITS) for k in range(width)], 1)
        lex = np.zeros_like(model.lexical)
        lex[lexical[lexical >= 0]] = by_word[lexical >= 0]
        for weights, slope, squares in zip(
                (model.grams, model.lexical, model.steps), (grams, lex, seen - expected), past):
            slope = slope / len(chains) - decay * weights
            squares += slope**2
            weights += (rate * slope / np.sqrt(squares)).astype(np.float32)
    return model


def sample_chains(
    docs: DataFrame, per_label: int, chains: int, span: int, label: str, text: str, key: str,
) -> tuple[list[tuple[list[str], list[int]]], list[str]]:
    """Training chains from the bounded sample; every third one joins two languages.

    Drawn are distinct (id, text) pairs, so that an id with many texts or copies counts by its texts.
    """
    usable = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("_id"), F.xxhash64(text).alias("_h"), label, text)
    ids = first_by_hash(usable, label, ["_id", "_h"], per_label).toDF("_i", "_g", "_y")
    same = (F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_g"))
            & (F.col(label) == F.col("_y")))
    found = usable.join(F.broadcast(ids), same, "left_semi").distinct().select(
        F.col("_id").alias(key), label, words(F.col(text)).alias("w"))
    windows = [
        F.slice("w", 1 + F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(i)),
                                F.greatest(F.lit(1), F.size("w") - span + 1)).cast("int"), span)
        for i in range(chains)]
    rows = found.select(key, label, F.explode(F.array(*windows)).alias("w")).where(
        F.size("w") > 0).orderBy(F.xxhash64(F.col("w")), label).collect()
    labels = sorted({r[label] for r in rows})
    coded = [(r["w"], [labels.index(r[label])] * len(r["w"])) for r in rows]
    out = []
    for i, (w, y) in enumerate(coded):
        if i % 3 == 2:
            (u, z), cut = coded[i - 1], len(w) // 2
            w, y = u[:len(u) // 2] + w[cut:], z[:len(u) // 2] + y[cut:]
        out.append((w, y))
    return out, labels


def fit(docs: DataFrame, per_label: int = 800, chains: int = 2, span: int = 40,
        label: str = "lang", text: str = "text", key: str = "doc_id") -> Model | None:
    """Learn from labelled rows; None if there are none."""
    found, labels = sample_chains(docs, per_label, chains, span, label, text, key)
    return train(found, labels) if found else None


def label_texts(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of every word of every text, which words have letters, and text bounds."""
    lists = pc.split_pattern_regex(pc.fill_null(texts, ""), r"[\x09-\x0d\x20]+")
    coded = lists.values.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    found = letters_only(coded.dictionary)
    potentials = emissions(model, found)
    lettered = np.array([bool(w) for w in found], bool)
    if not len(index):
        return np.zeros((0, len(model.labels))), np.zeros(0, bool), bounds
    sizes = np.diff(bounds)
    full, rest = sizes // CHAIN, sizes % CHAIN
    lengths = np.full(int((full + (rest > 0)).sum()), CHAIN)
    ends = np.cumsum(full + (rest > 0))
    lengths[ends[rest > 0] - 1] = rest[rest > 0]
    marginals, _, _ = forward_backward(potentials[index], lengths, model.steps)
    return marginals, lettered[index], bounds


def predict(docs: DataFrame, model: Model | None, text: str = "text", key: str = "doc_id",
            keep: tuple[str, ...] = ()) -> DataFrame:
    """``(key, keep…, lang_pred, score, n_words)`` of every row; ``keep`` may name the text.

    A column to keep that has the name of a result gives way to it.
    """
    names = [c for c in dict.fromkeys([key, *keep]) if c not in ("lang_pred", "score", "n_words")]
    rows = docs.select(*dict.fromkeys([*names, text]))
    schema = "".join(f"`{c}` {dict(docs.dtypes)[c]}, " for c in names) + (
        "lang_pred string, score double, n_words long")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            for part in slices(batch, text, 2 * 2**20):
                n = part.num_rows
                found, scores = np.full(n, "und", object), np.zeros(n)
                counts = np.zeros(n, np.int64)
                if crf is not None:
                    marginals, lettered, bounds = label_texts(crf, part.column(text))
                    sums = np.concatenate([np.zeros((1, len(crf.labels))), np.cumsum(
                        marginals * lettered[:, None], 0, dtype=np.float64)])
                    by_text = sums[bounds[1:]] - sums[bounds[:-1]]
                    counts = np.diff(np.concatenate([[0], np.cumsum(lettered)])[bounds])
                    told = counts > 0
                    best = by_text.argmax(1)
                    found[told] = np.array(crf.labels, object)[best[told]]
                    scores[told] = np.clip(
                        by_text[told, best[told]] / counts[told], 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in names]
                    + [pa.array(found, pa.string()), pa.array(scores), pa.array(counts)],
                    names=[*names, "lang_pred", "score", "n_words"])

    return rows.mapInArrow(label, schema)


def op2_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", held_out(F.col("doc_id"), FOLDS).alias("held_out"))
    model = fit(docs.where(~F.col("held_out")).select("doc_id", "text", "lang"))
    return predict(docs, model, keep=("held_out",))
