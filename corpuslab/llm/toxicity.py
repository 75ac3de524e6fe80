"""Toxicity by Levenshtein automata over a lexicon trie, judged in context.

The lexicon (whole terms, and stems that open many toxic words) is learned from labelled
texts by log-odds. Terms and stems form a trie; its intersection with the Levenshtein automata
of the terms is run as one automaton whose states are built when first met, so that a word
is followed for as long as some term is within reach: one edit for terms from five letters,
two from nine. Each hit is judged by a window of words around it: quotation marks, reporting
words and the like speak for quotation, other hits and direct address for abuse. A logistic
model over the counts of a whole text, trained on the same labelled rows, gives the score.

Learning takes at most ``per_class`` labelled texts of either class (first in the order of a hash
of the id) and keeps at most ``terms`` lexicon entries. Scoring covers whole texts.

A null text is an empty one. Without labelled rows every score is 0; rows with a null label
teach nothing; repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm.common import first_by_hash, held_out, table, words
from corpuslab.llm.tokens import slices

FOLDS, PREDICTED_FROM = 3, 0.7
WINDOW = 6
FEATURES = 8
# fixed values: words and marks that speak for quotation, and words of direct address
REPORTING = frozenset(
    "said says say quote quoted quotes called calls wrote writes word words term definition "
    "dijo dice palabra dit mot citation sagte sagt wort zitat".split())
ADDRESS = frozenset("you your yours youre u ur du dich dein ihr tu te toi vous ton tú usted".split())
QUOTE_MARKS = "\"“”„«»‘’`"
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")


@dataclass
class Trie:
    """Terms and stems; ``exact``: 1 for a term, 2 for a stem that any ending may follow."""

    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    exact: list[int] = field(default_factory=lambda: [0])
    edits: list[int] = field(default_factory=lambda: [0])
    reach: list[int] = field(default_factory=lambda: [0])

    def add(self, word: str, stem: bool) -> None:
        allowed = 0 if stem else (len(word) >= 5) + (len(word) >= 9)
        node = 0
        self.reach[0] = max(self.reach[0], allowed)
        for letter in word:
            nxt = self.children[node].get(letter)
            if nxt is None:
                nxt = len(self.children)
                self.children[node][letter] = nxt
                self.children.append({})
                self.exact.append(0)
                self.edits.append(0)
                self.reach.append(0)
            node = nxt
            self.reach[node] = max(self.reach[node], allowed)
        self.exact[node] = max(self.exact[node], 2 if stem else 1)
        self.edits[node] = max(self.edits[node], allowed)


class Automaton:
    """The deterministic form of trie and edits, grown as words need it."""

    LIMIT = 200_000

    def __init__(self, trie: Trie) -> None:
        self.trie = trie
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.verdicts: list[int] = []
        self.moves: dict[tuple[int, str], int] = {}
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The state of these (node, edits), letters missing from the word included; -1 if none."""
        trie, todo = self.trie, list(nodes)
        while todo:
            node = todo.pop()
            spent = nodes[node] + 1
            for child in trie.children[node].values():
                if spent <= trie.reach[child] and spent < nodes.get(child, 9):
                    nodes[child] = spent
                    todo.append(child)
        if not nodes:
            return -1
        key = frozenset(nodes.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            verdict = 0
            for node, spent in key:
                if trie.exact[node] and spent == 0:
                    verdict = max(verdict, 2 + trie.exact[node])
                elif trie.exact[node] == 1 and spent <= trie.edits[node]:
                    verdict = max(verdict, 1)
            self.verdicts.append(verdict)
        return self.ids[key]

    def _move(self, state: int, letter: str) -> int:
        trie, out = self.trie, {}
        for node, spent in self.sets[state]:
            if spent < trie.reach[node]:  # a letter too many
                out[node] = min(out.get(node, 9), spent + 1)
            for other, child in trie.children[node].items():
                cost = spent + (other != letter)
                if cost == spent or cost <= trie.reach[child]:
                    out[child] = min(out.get(child, 9), cost)
        return self._state(out)

    def match(self, word: str) -> int:
        """2 for a term or a word that a stem opens, 1 within the edits of a term, 0 else."""
        if len(self.moves) > self.LIMIT:
            self._clear()
        state, moves = self.start, self.moves
        for letter in word:
            nxt = moves.get((state, letter))
            if nxt is None:
                nxt = moves[state, letter] = self._move(state, letter)
            if nxt < 0:
                return 0
            if self.verdicts[nxt] == 4:  # a stem: any ending follows
                return 2
            state = nxt
        return min(2, self.verdicts[state])


@dataclass
class Model:
    trie: Trie
    weights: np.ndarray
    center: np.ndarray
    scale: np.ndarray


def spelled(found: pa.Array) -> list[str]:
    """Lower-cased words without marks at their ends, look-alike signs inside read as letters."""
    bare = pc.replace_substring_regex(
        pc.utf8_lower(found), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").to_pylist()
    return [w if w.isalpha() else "".join(c for c in w.translate(LOOKALIKES) if c.isalpha())
            for w in bare]


def count_hits(automaton: Automaton, texts: pa.Array) -> np.ndarray:
    """The features of each text: what hits it has and how their windows judge them."""
    lists = pc.split_pattern_regex(pc.fill_null(texts, ""), r"[\x09-\x0d\x20]+")
    coded = lists.values.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    raw, bare = coded.dictionary.to_pylist(), spelled(coded.dictionary)
    kinds = np.array([automaton.match(w) if w else 0 for w in bare], np.int8)
    out = np.zeros((len(texts), FEATURES))
    out[:, 7] = np.log1p(np.diff(bounds))
    if not len(index):
        return out
    hits = kinds[index]
    for at in np.flatnonzero(hits):
        text = int(np.searchsorted(bounds, at, "right")) - 1
        low, high = max(bounds[text], at - WINDOW), min(bounds[text + 1], at + WINDOW + 1)
        near = index[low:high]
        around = [bare[i] for i in near]
        quoted = (
            any(c in raw[index[at]] for c in QUOTE_MARKS)
            or (any(raw[i][:1] in QUOTE_MARKS for i in index[low:at + 1] if raw[i])
                and any(raw[i].rstrip(".,;:!?")[-1:] in QUOTE_MARKS
                        for i in index[at:high] if raw[i].rstrip(".,;:!?")))
            or any(w in REPORTING for w in around))
        row = out[text]
        if quoted:
            row[3] += 1
        elif hits[at] == 2:
            row[0] += 1
        else:
            row[1] += 1
        row[4] += any(w in ADDRESS for w in around) and not quoted
        row[5] += int((hits[low:high] > 0).sum() > 1) and not quoted
    row_words = np.maximum(1, np.diff(bounds))
    out[:, 2] = (out[:, 0] + out[:, 1]) / np.sqrt(row_words)
    out[:, 6] = out[:, 0] > 0
    for k in (0, 1, 3, 4, 5):
        out[:, k] = np.log1p(out[:, k])
    return out


def learn_terms(sample: DataFrame, text: str, label: str, terms: int, evidence: float) -> Trie:
    """Words and stems whose share of toxic texts is far above the usual, as a trie.

    ``evidence`` is the least log-likelihood gain (in nats) of an entry.
    """
    totals = sample.groupBy(label).count().collect()
    sizes = {r[label]: r["count"] for r in totals}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    trie = Trie()
    if not toxic or not clean:
        return trie
    rate = toxic / (toxic + clean)
    bare = F.array_distinct(F.transform(
        words(F.lower(text)),
        lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    found = sample.select(label, F.explode(bare).alias("w")).where(
        F.col("w").rlike(r"^\p{L}{3,40}$"))
    entries = found.select(label, F.explode(F.concat(
        F.array(F.struct(F.col("w").alias("w"), F.lit(False).alias("stem"))),
        F.transform(
            F.filter(F.array(F.lit(5), F.lit(6), F.lit(7)), lambda n: n < F.length("w")),
            lambda n: F.struct(F.substring("w", F.lit(1), n).alias("w"),
                               F.lit(True).alias("stem")))
    )).alias("e")).select(label, "e.*")
    counted = entries.groupBy("w", "stem").agg(
        F.sum(F.col(label)).alias("t"), F.count(F.lit(1)).alias("n"))
    share = F.col("t") / F.col("n")
    gain = F.col("t") * F.log(share / rate)
    best = counted.where((F.col("t") >= 3) & (share > 0.75)).withColumn("gain", gain).where(
        F.col("gain") >= evidence).orderBy(F.desc("gain"), "w").limit(terms).collect()
    for row in best:
        trie.add(row["w"], row["stem"])
    return trie


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the last one for the constant) by Newton steps with a ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weights = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (y - p) - penalty @ weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + penalty
        weights = weights + np.linalg.solve(curve, slope)
    return weights


def with_features(rows: DataFrame, trie: Trie, text: str) -> DataFrame:
    """Replace the text by the feature list of each row."""
    names = [c for c in rows.columns if c != text]
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", features array<double>"
    shared = rows.sparkSession.sparkContext.broadcast(trie)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(shared.value)
        for batch in batches:
            for part in slices(batch, text):
                counts = count_hits(automaton, part.column(text))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in names],
                     pa.array(list(counts), pa.list_(pa.float64()))],
                    names=[*names, "features"])

    return rows.select(*names, text).mapInArrow(count, schema)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 5000, terms: int = 2000,
        evidence: float = 9.0, text: str = "text", key: str = "doc_id",
        label: str = "toxic") -> Model | None:
    """Learn lexicon and weights from a bounded sample; None without labelled texts."""
    told = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(
        F.max(label).cast("int").alias("_y"))
    usable = docs.where(F.col(text).isNotNull()).select(
        key, F.xxhash64(text).alias("_h"), F.col(text).alias("_t"))
    chosen = first_by_hash(told.join(usable.select(key, "_h").distinct(), key), "_y", [key, "_h"], per_class)
    sample = usable.join(F.broadcast(chosen), [key, "_h"]).select("_t", "_y").distinct().persist()
    try:
        trie = learn_terms(sample, "_t", "_y", terms, evidence)
        rows = with_features(sample, trie, "_t").collect()
    finally:
        sample.unpersist()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["_y"], r["features"]))  # sums in one order, whatever came first
    x, y = np.array([r["features"] for r in rows]), np.array([r["_y"] for r in rows], float)
    center, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    return Model(trie, logistic((x - center) / scale, y), center, scale)


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Replace the text by ``score`` and ``predicted``, and columns of these names as well."""
    docs = docs.drop("score", "predicted", "features")
    if model is None:
        rest = docs.drop(text)
        return rest.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0))
    plain = model.weights[:-1] / model.scale
    constant = float(model.weights[-1] - plain @ model.center)
    odds = sum((F.get("features", F.lit(i)) * float(w) for i, w in enumerate(plain)),
               F.lit(constant))
    counted = with_features(docs, model.trie, text)
    scored = counted.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), odds))))
    return scored.withColumn("predicted", (F.col("score") >= PREDICTED_FROM).cast("int")).drop(
        "features")


def op4_toxicity_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", held_out(F.col("doc_id"), FOLDS).alias("held_out"), "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(
        ~held_out(F.col("doc_id"), FOLDS))
    return score(docs, fit(docs, labels))
