"""Removal of passages that occur more than once: seeds by winnowing, then extension.

A window is ``size`` consecutive words of one document. Of the short word runs (``seed`` words) of a window
the one with the least hash is its anchor, the rightmost of equal ones. The choice depends on the
window's words alone, so equal windows have equal anchors, at the same place: no repeat of ``size`` words
is without a shared anchor. An anchor stands for the consecutive windows that chose it, its
neighbourhood. Anchors that occur once have no repeats. Where all places of an anchor extend to the same
neighbourhood, all of its windows repeat. Only where neighbourhoods differ (at the ends of a repeat) are
windows compared, by grouping. No pair of places is formed, so a passage in a third of the
documents costs one row per place. What repeats is merged into maximal intervals, and goes.

Words and windows are compared by 64-bit hashes of two kinds (anchor and neighbourhood or window, 128 bits
together). A place is (id, hash of the text, position): null and repeated ids are told apart by
their texts, and repeated rows count as places of their own. Null texts have no words; documents shorter
than a window lose nothing; windows may overlap themselves in periodic texts. An empty table gives
no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm.common import Workspace, join_counted, table
from corpuslab.llm.tokens import slices
from corpuslab.session import staged

SIZE, SEED = 35, 8
SPACE = r"[\x09-\x0d\x20]+"
#: odd multipliers of the two polynomial hashes
BASES = np.array([[0x9E3779B97F4A7C15], [0xD6E8FEB86659FD93]], np.uint64)
HASH_KEYS = ("first word hash ", "second word hash")
SLICE = 4 * 2**20
PLACE = ["doc_id", "text_hash"]
RESULT = ["doc_id", "n_words", "n_removed", "kept"]
OPEN = ["text_hash", "text", "gone", "asked"]


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a number made to depend on all others."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in a row, dictionary-coded, and where each text begins."""
    lists = pc.split_pattern_regex(pc.fill_null(texts, ""), SPACE)
    coded = lists.flatten().dictionary_encode()
    filled = pc.not_equal(coded.dictionary, "").take(coded.indices).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(filled)])
    return coded.filter(pa.array(filled, pa.bool_())), ends[lists.offsets.to_numpy()]


def word_hashes(words: pa.Array) -> list[np.ndarray]:
    """Two independent 64-bit hashes of each word (SipHash under two keys)."""
    spelled = words.dictionary.to_numpy(zero_copy_only=False)
    places = words.indices.to_numpy(zero_copy_only=False)
    return [pd.util.hash_array(spelled, hash_key=key, categorize=False)[places] for key in HASH_KEYS]


def run_hashes(words: np.ndarray, size: int, base: np.ndarray) -> np.ndarray:
    """The hash of each run of ``size`` numbers: a polynomial by doubling, then mixed."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power = np.zeros(n, np.uint64), 0, words  # power: hashes of runs of 1, 2, 4 ...
    width, factor = 1, base
    left = size
    while left:
        if left & 1:
            out = out * factor + power[done: done + n]
            done += width
        left >>= 1
        if left:
            power = power[:-width] * factor + power[width:]
            width, factor = width * 2, factor * factor
    return mixed(out)


def rightmost_least(values: np.ndarray, size: int) -> np.ndarray:
    """The place of the least of each ``size`` consecutive values, the rightmost of equal ones."""
    at, width = np.arange(len(values)), 1
    while width < size:
        step = min(width, size - width)
        a, b = at[:-step], at[step:]
        at = np.where(values[b] <= values[a], b, a)
        width += step
    return at


def neighbourhoods(texts: pa.Array, size: int, seed: int) -> Iterator[tuple]:
    """``(rows, anchor, starts, counts, windows)`` of all anchors of the texts.

    ``rows`` is the text of each anchor, ``starts`` the word where its first window starts in that text,
    ``counts`` how many windows chose it, ``windows`` the hash of every window, in order.
    """
    words, bounds = split_words(texts)
    first, second = word_hashes(words)
    anchors = run_hashes(first, seed, BASES[0])
    windows = run_hashes(second, size, BASES[1])
    chosen = rightmost_least(anchors, size - seed + 1)
    many = np.maximum(np.diff(bounds) - size + 1, 0)  # windows of each text
    inside = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
    inside = inside + np.arange(len(inside))  # where each window that stays in its text starts
    chosen, windows = chosen[inside], windows[inside]
    row = np.repeat(np.arange(len(many)), many)
    new = np.ones(len(chosen), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return (row[at], anchors[chosen[at]], inside[at] - bounds[row[at]],
            np.diff(np.append(at, len(chosen))), windows)


def neighbourhood_hash(windows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One hash of the windows of each neighbourhood, in their order."""
    begins = np.cumsum(counts) - counts
    order = np.arange(len(windows)) - np.repeat(begins, counts)
    told = mixed(windows + order.astype(np.uint64) * BASES[0])
    return np.add.reduceat(told, begins) if len(begins) else np.zeros(0, np.uint64)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def anchors(docs: DataFrame, size: int = SIZE, seed: int = SEED) -> DataFrame:
    """``(doc_id, text_hash, start, many, anchor, around)``, one row per anchor of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                rows, anchor, starts, counts, windows = neighbourhoods(part.column("text"), size, seed)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c).take(pa.array(rows)) for c in PLACE],
                     pa.array(starts, pa.int32()), pa.array(counts, pa.int32()), signed(anchor),
                     signed(neighbourhood_hash(windows, counts))],
                    [*PLACE, "start", "many", "anchor", "around"])

    return docs.mapInArrow(
        run, f"doc_id {kind}, text_hash long, start int, many int, anchor long, around long")


def seeds(found: DataFrame) -> DataFrame:
    """``(anchor, places, same)``: anchors of several places, and whether all extend alike."""
    return found.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("places"), (F.min("around") == F.max("around")).alias("same"),
    ).where("places > 1")


def window_rows(open_docs: DataFrame, size: int, seed: int) -> DataFrame:
    """``(doc_id, text_hash, start, anchor, window)`` of all windows in ``asked`` neighbourhoods."""
    kind = open_docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                rows, anchor, starts, counts, windows = neighbourhoods(part.column("text"), size, seed)
                asked = part.column("asked")
                wanted = np.stack([
                    np.repeat(np.arange(len(asked)), pc.list_value_length(asked).to_numpy(False)),
                    asked.flatten().to_numpy()])
                # a text has less than 2^31 words; both lists are sorted by (text, start)
                told = (rows << 31) + starts
                keep = np.isin(told, (wanted[0] << 31) + wanted[1])
                each = np.repeat(keep, counts)
                begins = np.repeat(starts - (np.cumsum(counts) - counts), counts)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c).take(pa.array(np.repeat(rows, counts)[each])) for c in PLACE],
                     pa.array((begins + np.arange(len(begins)))[each], pa.int32()),
                     signed(np.repeat(anchor, counts)[each]), signed(windows[each])],
                    [*PLACE, "start", "anchor", "window"])

    return open_docs.mapInArrow(
        run, f"doc_id {kind}, text_hash long, start int, anchor long, window long")


def rest_of(part: pa.RecordBatch, size: int, digest: bool) -> list[pa.Array]:
    """The columns of ``RESULT`` of texts from which the windows in ``gone`` are taken."""
    words, bounds = split_words(part.column("text"))
    gone = part.column("gone")
    spans = gone.flatten()
    starts, many = (spans.field(c).to_numpy(zero_copy_only=False) for c in ("start", "many"))
    counts = pc.fill_null(pc.list_value_length(gone), 0).to_numpy(zero_copy_only=False)
    starts = starts + np.repeat(bounds[:-1], counts)
    # how many windows begin and end before each word
    n = len(words) + 1
    open_windows = np.cumsum(np.bincount(starts, minlength=n)
                             - np.bincount(starts + many + size - 1, minlength=n))
    kept = open_windows[:-1] == 0
    left = np.concatenate([[0], np.cumsum(kept)])[bounds]
    rest = words.filter(pa.array(kept, pa.bool_())).dictionary_decode()
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), rest), " ")
    if digest:
        texts = pa.array([hashlib.sha256(t.encode()).hexdigest()
                          for t in texts.to_numpy(zero_copy_only=False)], pa.string())
    return [part.column("doc_id"), pa.array(np.diff(bounds)),
            pa.array(np.diff(bounds) - np.diff(left)), texts]


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Documents with what was found at their place, null for nothing."""
    right = spans.withColumnsRenamed({c: f"_{c}" for c in PLACE})
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PLACE]
    return docs.join(right, on, "left").drop(*[f"_{c}" for c in PLACE])


def without_repeats(
    docs: DataFrame, size: int = SIZE, seed: int = SEED, digest: bool = False,
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of ``docs(doc_id, text)``.

    ``kept`` is the text without repeated passages, its words joined by one blank, or with ``digest``
    the SHA-256 of that text in hex.
    """
    if not 1 <= seed <= size:
        raise ValueError("a seed has at least one word and no more than a window")
    spark = docs.sparkSession
    work = Workspace(spark)
    placed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = anchors(placed, size, seed)
    shared = work.staged(seeds(found), "seeds")
    total = shared.agg(F.sum("places")).first()[0] or 0
    hits = join_counted(found, shared, ["anchor"], "places", total, PLACE + ["start"])
    # rows that repeat are one place here, so that a row repeated any number of times is no large group
    spans = hits.groupBy(*PLACE).agg(
        F.collect_set(F.when(F.col("same"), F.struct("start", "many"))).alias("gone"),
        F.collect_set(F.when(~F.col("same"), F.col("start"))).alias("asked"))
    joined = with_spans(placed, spans)

    def settle(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                is_open = pc.greater(pc.fill_null(pc.list_value_length(part.column("asked")), 0), 0)
                closed, waiting = part.filter(pc.invert(is_open)), part.filter(is_open)
                none = [pa.nulls(closed.num_rows, part.schema.field(c).type) for c in OPEN]
                yield pa.RecordBatch.from_arrays(
                    [*rest_of(closed, size, digest), *none], RESULT + OPEN)
                blank = [pa.nulls(waiting.num_rows, t) for t in (pa.int64(), pa.int64(), pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [waiting.column("doc_id"), *blank, *[waiting.column(c) for c in OPEN]],
                    RESULT + OPEN)

    spans_of = "array<struct<start: int, many: int>>"
    first = staged(joined.mapInArrow(
        settle, f"doc_id {kind}, n_words long, n_removed long, kept string, text_hash long, "
                f"text string, gone {spans_of}, asked array<int>"), "settled")
    waiting = first.where("text_hash is not null")
    compared = window_rows(waiting.select(*PLACE, "text", "asked"), size, seed)
    work.clear()
    twice = staged(compared.groupBy("anchor", "window").agg(
        F.count(F.lit(1)).alias("places")).where("places > 1"), "windows")
    many = twice.agg(F.sum("places")).first()[0] or 0
    again = join_counted(
        compared, twice, ["anchor", "window"], "places", many, PLACE + ["start"]).groupBy(*PLACE).agg(
        F.collect_set(F.struct("start", F.lit(1).alias("many"))).alias("also"))
    rest = with_spans(waiting.drop("asked"), again).withColumn(
        "gone", F.concat("gone", F.coalesce("also", F.array().cast(spans_of)))).drop("also")

    def finish(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield pa.RecordBatch.from_arrays(rest_of(part, size, digest), RESULT)

    last = rest.select("doc_id", "text", "gone").mapInArrow(
        finish, f"doc_id {kind}, n_words long, n_removed long, kept string")
    return first.where("text_hash is null").select(*RESULT).union(last)


def op12_winnowed_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without passages of 35 words that occur anywhere else."""
    return without_repeats(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed(
        "kept", "kept_sha256")
