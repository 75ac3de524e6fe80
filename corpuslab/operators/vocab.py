"""Learning vocabularies: characters, byte-level BPE, WordPiece, Unigram.

The corpus is only ever read as distributed counts of distinct pretokens. What comes
to the driver is bounded by the vocabulary: ranked pairs, merges, piece scores.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.operators.corpus import charset
from corpuslab.operators.merges import MergeTable, chains, count_pairs, merge_band, merged_rows
from corpuslab.operators.pretokens import assign_ids, prepared, pretoken_counts
from corpuslab.operators.subwords import (
    LONG, PieceIndex, best_split, expected_pieces, expected_uses, prefixes,
)
from corpuslab.session import fixed_table, shared_dir, sorted_limits, staged

END_OF_TEXT = "<|endoftext|>"
# Special tokens per kind, and the names an end-of-text token may have.
SPECIALS = {
    "char": ("<unk>",),
    "bpe": (END_OF_TEXT,),
    "wordpiece": ("[UNK]", "[PAD]", "[CLS]", "[SEP]", "[MASK]"),
    "unigram": ("<cls>", "<sep>", "<unk>", "<pad>", "<mask>", "<s>", "</s>"),
}
END_NAMES = (END_OF_TEXT, "<eos>", "</s>")
MAX_SYMBOLS = 1_200_000
#: how far the ranking of pairs is looked at in a round
RANKED_PAIRS = 20_000
#: chains of no more symbols than this (about 100 MB while they are merged) make up a band
BAND_SYMBOLS = 500_000
#: cells to a doubling in the histogram of what pieces cover, some thousands in all
SEED_CELLS = 256
#: so many merges are written into the words once, rather than applied in every round
CHECKPOINT_MERGES = 200


@dataclass
class Vocabulary:
    """A learned vocabulary; ``tokens[i]`` has id ``i``."""

    kind: str
    tokens: list[str]
    merges: list[tuple[int, int, int]] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    mode: str | None = None

    def table(self, spark: SparkSession) -> DataFrame:
        return fixed_table(
            spark, token=(pa.string(), self.tokens), id=(pa.int32(), list(range(len(self.tokens)))))

    def merge_table(self, spark: SparkSession) -> DataFrame:
        left, right, merged = ([self.tokens[m[i]] for m in self.merges] for i in range(3))
        return fixed_table(
            spark, rank=(pa.int32(), list(range(len(self.merges)))), left=(pa.string(), left),
            right=(pa.string(), right), merged=(pa.string(), merged))

    def piece_table(self, spark: SparkSession) -> DataFrame:
        return fixed_table(
            spark, token=(pa.string(), self.tokens), id=(pa.int32(), list(range(len(self.tokens)))),
            score=(pa.float64(), self.scores))


def vocab_size(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.count(F.lit(1)).alias("size"))


def eos_id(vocab: DataFrame, names: Sequence[str] = END_NAMES) -> DataFrame:
    """The id of the first end-of-text name the vocabulary has, NULL for none."""
    ids = [F.max(F.when(F.col("token") == n, F.col("id"))) for n in names]
    return vocab.agg(F.coalesce(*ids).alias("eos_id"))


def char_vocab(df: DataFrame, text: str = "text") -> DataFrame:
    """``(token, id)``: ``<unk>`` is 0, then the characters in code-point order."""
    return assign_ids(charset(df, column=text).withColumnRenamed("ch", "token"), SPECIALS["char"], few=True)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Visible Latin-1 bytes stand for themselves, the others for characters from U+0100 up.
    """
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    chars = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [chars[b] for b in range(256)]


def _byte_symbols(word: Column) -> Column:
    alphabet = F.array(*[F.lit(c) for c in byte_alphabet()])
    pairs = F.regexp_extract_all(F.hex(F.encode(word, "UTF-8")), F.lit(".."), F.lit(0))
    return F.transform(pairs, lambda h: F.element_at(
        alphabet, F.conv(h, 16, 10).cast("int") + 1))


def _piece_symbols(word: Column) -> Column:
    return F.transform(
        F.filter(F.split(word, ""), lambda c: c != ""),
        lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.lit("##"), c)))


def exact_batch(
    ranked: list[tuple[int, int, int]], complete: bool, room: int,
    repeats: Callable[[int, int], bool] = lambda left, right: False,
) -> list[tuple[int, int]]:
    """The pairs at the head of a ranking that one-at-a-time merging would take next.

    ``ranked`` is (left, right, count), best first. Two pairs can only overlap in a text
    where the right symbol of one is the left symbol of the other, so while the lefts
    and rights of the batch stay apart its merges leave each other's counts alone. A
    merge creates pairs out of neighbours on its left and right, which are pairs outside
    the batch and count no more than they did: less than the batch, or as much, and then
    a created pair could win the tie only by a smaller left id, which needs an
    equal-count neighbour on the left. A symbol merged with itself, or a merge that
    spells a known token (``repeats``), can raise a count and so ends the batch.
    """
    batch: list[tuple[int, int]] = []
    lefts: set[int] = set()
    rights: set[int] = set()
    floor = 0 if complete else ranked[-1][2]
    neighbours: dict[int, set[int]] = {}
    for _, right, count in ranked:
        neighbours.setdefault(count, set()).add(right)
    for left, right, count in ranked:
        if batch:
            if left in rights or right in lefts or left == right or count <= floor:
                break
            if lefts & neighbours[count]:
                break
        batch.append((left, right))
        lefts.add(left)
        rights.add(right)
        if left == right or len(batch) == room or repeats(left, right):
            break
    return batch


def _dealt(df: DataFrame, rows: int, per_task: int = 100_000) -> DataFrame:
    """Spread work that is heavy for its bytes, which adaptive coalescing would pack into
    a few tasks: all cores from some thousand rows on."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(min(cores, rows // 1_000 + 1), rows // per_task))


def _learn_merges(
    words: DataFrame, symbols: Callable[[Column], Column], specials: Sequence[str], size: int,
    glue: Callable[[str, str], str], checkpoint_every: int = 12,
) -> tuple[list[str], list[tuple[int, int, int]]]:
    """Merge the most frequent adjacent pair until the vocabulary is full.

    A word is its array of symbol ids, ties go to the smaller ids. A round counts all pairs once: tasks
    apply the merges since the last checkpoint, sums collapse on the map side, the head of the ranking
    reaches the driver. Words are cut wherever a pair is below a floor (:func:`chains`) and equal chains
    are summed by a shuffle; the floor is raised until these have at most ``BAND_SYMBOLS`` symbols,
    which are fetched and merged down to the floor (:func:`merge_band`), often thousands of merges at
    once. How many chains there are depends on the frequent pairs more than on the number of words, so
    the rounds do not grow with the corpus as they would with whole words. Where no floor is high
    enough, merges are taken from the ranking as far as none can influence another
    (:func:`exact_batch`). The result is that of one merge at a time, at every size.
    """
    spark = words.sparkSession
    shared_dir(spark)
    spelled = words.select("word", "freq", symbols(F.col("word")).alias("syms")).checkpoint()
    seen = spelled.select(F.explode("syms").alias("token")).distinct().limit(MAX_SYMBOLS + 1)
    alphabet = sorted(r[0] for r in seen.collect())
    if len(alphabet) > MAX_SYMBOLS:
        raise ValueError("too many symbols for one vocabulary")
    vocab = [*specials, *alphabet]
    index = {t: i for i, t in enumerate(vocab)}

    def as_ids(batches):
        for batch in batches:
            lists = batch.column("syms")
            flat = lists.flatten().dictionary_encode()
            known = pa.array([index[t] for t in flat.dictionary.to_pylist()], pa.int32())
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(offsets, known.take(flat.indices)), batch.column("freq")],
                ["ids", "freq"])

    state = (
        _dealt(spelled.where(F.size("syms") > 1).select("syms", "freq"), spelled.count())
        .mapInArrow(as_ids, "ids array<int>, freq bigint").checkpoint()
    )
    cores = spark.sparkContext.defaultParallelism
    merges: list[tuple[int, int, int]] = []
    # merges to apply, in lists: a known token may bring back a merged pair, so it ends its list
    pending: list[list[tuple[int, int, int]]] = [[]]
    rounds = 0

    def name(left: int, right: int) -> tuple[int, bool]:
        token = glue(vocab[left], vocab[right])
        known = token in index
        if not known:
            index[token] = len(vocab)
            vocab.append(token)
        return index[token], known

    def in_tasks(work, schema, *args):
        segments = [m for m in pending if m]

        def run(batches):
            tables = [MergeTable(m) for m in segments]
            return (work(b, tables, *args) for b in batches if b.num_rows)

        return state.mapInArrow(run, schema)

    def cut_at(band, cut):
        """The summed chains of the pairs of ``band``; from those of a longer band, if there are any."""
        def run(batches):
            return (chains(b, [], band) for b in batches if b.num_rows)

        parts = in_tasks(chains, state.schema, band) if cut is None else cut.mapInArrow(run, state.schema)
        return parts.groupBy("ids").agg(F.sum("freq").alias("freq")).checkpoint()

    reach = min(RANKED_PAIRS, 500)
    while len(vocab) < size:
        cut = None
        # batches arrive summed; a round is short, so it shuffles to the cores there are
        pairs = in_tasks(count_pairs, "l int, r int, n bigint").repartition(
            cores, "l", "r").groupBy("l", "r").agg(F.sum("n").alias("n"))
        top = pairs.orderBy(F.col("n").desc(), "l", "r").limit(RANKED_PAIRS).toArrow()
        if not top.num_rows:
            break
        left, right, n = (top.column(c).to_numpy() for c in ("l", "r", "n"))
        keys = (left.astype(np.int64) << 32) | right
        spelled_now: set[str] = set()

        def repeats(a: int, b: int) -> bool:
            token = glue(vocab[a], vocab[b])
            known = token in index or token in spelled_now
            spelled_now.add(token)
            return known

        apart = exact_batch(
            list(zip(left.tolist(), right.tolist(), n.tolist())), len(n) < RANKED_PAIRS,
            size - len(vocab), repeats)
        reach = min(reach, len(n))
        found = None
        while found is None and reach > len(apart):
            # the ranking goes on below its last row, and a band does not end within a count
            whole = reach == len(n) < RANKED_PAIRS
            floor = 1 if whole else int(n[reach - 1]) + 1
            band = np.sort(keys[n >= floor])
            if len(band) > len(apart):
                cut = cut_at(band, cut)
                if (cut.agg(F.sum(F.size("ids"))).first()[0] or 0) <= BAND_SYMBOLS:
                    found = cut.toArrow().combine_chunks()
                    break
            reach //= 4
        if found is not None:
            taken = merge_band(
                found.column("ids").chunk(0), found.column("freq").to_numpy(), floor,
                name, lambda: len(vocab) < size)
            reach *= 4
        else:
            taken = []
            for a, b in apart:
                token, known = name(a, b)
                taken.append(((a, b, token), known))
            reach = max(4 * reach, 4 * len(apart) + 4)
        for merge, known in taken:
            merges.append(merge)
            pending[-1].append(merge)
            if known:
                pending.append([])
        rounds += 1
        if rounds % checkpoint_every == 0 or sum(map(len, pending)) >= CHECKPOINT_MERGES:
            state = in_tasks(merged_rows, state.schema).checkpoint()
            pending = [[]]
    return vocab, merges


def train_bpe(df: DataFrame, text: str = "text", size: int = 25_000) -> Vocabulary:
    """Byte-level BPE over the whole corpus."""
    words = pretoken_counts(df, prepared(F.col(text), "bpe"))
    tokens, merges = _learn_merges(words, _byte_symbols, SPECIALS["bpe"], size, lambda a, b: a + b)
    return Vocabulary("bpe", tokens, merges)


def train_wordpiece(
    df: DataFrame, text: str = "text", size: int = 25_000, pretok: str = "whitespace",
) -> Vocabulary:
    """WordPiece by pair counts with ``##`` continuations; ``pretok="none"`` takes each
    whole text as one word."""
    words = pretoken_counts(df, prepared(F.col(text), "wordpiece", pretok))
    tokens, merges = _learn_merges(
        words, _piece_symbols, SPECIALS["wordpiece"], size, lambda a, b: a + b.removeprefix("##"))
    return Vocabulary("wordpiece", tokens, merges, mode=pretok)


def _seed_pieces(words: DataFrame, limit: int, longest: int) -> list[tuple[str, int]]:
    """Every character, and the substrings that cover most of the corpus.

    What covers least is left out by a histogram before any is ranked, and the rest is sorted by ranges: the
    driver gets about ``limit`` rows, not as many from each task.
    """
    word = F.col("word")
    starts = F.sequence(F.lit(1), F.length(word))
    substrings = F.flatten(F.transform(starts, lambda s: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(longest), F.length(word) - s + 1)),
        lambda n: F.substring(word, s, n))))
    counts = staged(words.select(F.explode(substrings).alias("piece"), "freq").groupBy("piece").agg(
        F.sum("freq").alias("n")).where((F.length("piece") == 1) | (F.col("n") > 1)), "pieces")
    chars = counts.where(F.length("piece") == 1).limit(MAX_SYMBOLS).collect()
    covered = F.col("n") * F.length("piece")
    cell = F.floor(F.log2(covered) * SEED_CELLS)
    ranked = counts.where(F.length("piece") > 1)
    found, least = 0, 0
    for least, many in sorted(map(tuple, ranked.groupBy(cell).count().collect()), reverse=True):
        found += many
        if found >= limit:
            break
    with sorted_limits(words.sparkSession):
        longer = ranked.where(cell >= least).orderBy(covered.desc(), "piece").limit(limit).collect()
    return [(r["piece"], r["n"]) for r in sorted(chars)] + [(r["piece"], r["n"]) for r in longer]


def _e_step(words: DataFrame, scores: dict[str, float]) -> tuple[dict[str, float], float]:
    """Expected use of each piece, and the log likelihood of the corpus.

    A task sums over its words in columns and sends one row for each piece it met.
    """
    index = PieceIndex(scores)

    def run(batches):
        uses, total = np.zeros(len(index.pieces)), 0.0
        starts = None
        for batch in batches:
            long = pc.greater(pc.utf8_length(batch.column("word")), LONG)
            short = batch.filter(pc.invert(long))
            if short.num_rows:
                more, loss = expected_uses(
                    short.column("word").to_pylist(), short.column("freq").to_numpy(), index)
                uses += more
                total += loss
            if short.num_rows < batch.num_rows:
                rest = batch.filter(long)
                if starts is None:
                    number = {p: i for i, p in enumerate(index.pieces)}
                    values = dict(zip(index.pieces, index.scores.tolist()))
                    starts = prefixes(values)
                more, loss = expected_pieces(
                    rest.column("word").to_pylist(), rest.column("freq").to_pylist(), values, starts)
                total += loss
                for piece, n in more.items():
                    uses[number[piece]] += n
        met = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(met, -1), pa.int32()), pa.array(np.append(uses[met], total))], ["piece", "uses"])

    rows = words.mapInArrow(run, "piece int, uses double").groupBy("piece").agg(
        F.sum("uses").alias("uses")).toArrow()
    found = dict(zip(rows.column("piece").to_pylist(), rows.column("uses").to_pylist()))
    total = found.pop(-1, 0.0)
    return {index.pieces[i]: n for i, n in found.items()}, total


def _normalised(uses: dict[str, float], chars: set[str]) -> dict[str, float]:
    kept = {p: max(u, 1e-6 if p in chars else 0.0) for p, u in uses.items()}
    for ch in chars:
        kept.setdefault(ch, 1e-6)
    total = math.log(sum(kept.values()))
    return {p: math.log(u) - total for p, u in kept.items() if u > 0.0}


def _pruned(
    spark: SparkSession, scores: dict[str, float], uses: dict[str, float], chars: set[str], room: int,
) -> dict[str, float]:
    """Drop the pieces whose absence costs the corpus least, never a character."""
    longer = fixed_table(spark, piece=(pa.string(), [p for p in scores if p not in chars]))

    def run(batches):
        starts = prefixes(scores)
        for batch in batches:
            pieces = batch.column("piece").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(pieces, pa.string()),
                 pa.array([best_split(p, scores, starts, without=p)[1] for p in pieces], pa.float64())],
                ["piece", "other"])

    # the piece table is as small as the vocabulary
    others = _dealt(longer, len(scores)).mapInArrow(
        run, "piece string, other double").collect()
    cost = {r["piece"]: uses.get(r["piece"], 0.0) * (scores[r["piece"]] - r["other"]) for r in others}
    best = sorted(cost, key=lambda p: (-cost[p], p))[: max(0, room - len(chars))]
    keep = chars.union(best)
    total = math.log(sum(math.exp(s) for p, s in scores.items() if p in keep))
    return {p: s - total for p, s in scores.items() if p in keep}


def train_unigram(
    df: DataFrame, text: str = "text", size: int = 25_000, seeds: int = 200_000,
    longest: int = 16, shrink: float = 0.75, steps: int = 2, history: list | None = None,
) -> Vocabulary:
    """Unigram pieces by expectation maximisation over distinct words, pruned to ``size``.

    ``history`` receives the log likelihood of each step, grouped by pruning round.
    """
    words = pretoken_counts(df, prepared(F.col(text), "unigram"))
    shared_dir(df.sparkSession)
    words = words.checkpoint()
    words = _dealt(words, words.count()).checkpoint()
    seeded = _seed_pieces(words, seeds, longest)
    chars = {p for p, _ in seeded if len(p) == 1}
    room = max(size - len(SPECIALS["unigram"]), len(chars))
    scores = _normalised({p: float(n) for p, n in seeded}, chars)
    while True:
        losses = []
        for _ in range(steps):
            uses, loss = _e_step(words, scores)
            losses.append(loss)
            scores = _normalised(uses, chars)
        if history is not None:
            history.append(losses)
        if len(scores) <= room:
            break
        scores = _pruned(df.sparkSession, scores, uses, chars, max(room, int(len(scores) * shrink)))
    pieces = sorted(scores, key=lambda p: (-scores[p], p))
    specials = SPECIALS["unigram"]
    return Vocabulary(
        "unigram", [*specials, *pieces], scores=[0.0] * len(specials) + [scores[p] for p in pieces])
