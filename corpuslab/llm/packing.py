"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Lengths are whole numbers up to the capacity, so documents of one length are a run of
equals, and so are sequences with one gap. A superstep sorts both by size, sweeps once
downward so that each document takes its successor, the smallest free gap that holds it
(gaps on a stack, the innermost first), settles conflicts within a run by rank, shrinks
the gaps that were filled, and repeats; when no gap holds what is left of a size class, it
opens sequences. What a sweep needs from the corpus is the number of documents of each
length, a distributed aggregate of at most ``capacity`` rows; its work and memory depend on
the capacity, not on the corpus. Documents meet the plan by (length, rank) in joins, the
ranks being numbered in parallel, so that a length with a third of all rows is no hot key.

Only documents over the capacity are cut. A null text is an empty one, which is the end
token alone; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslab.llm.common import partitions, table
from corpuslab.llm.tokens import slices, word_ids
from corpuslab.session import small_batches, staged

CAPACITY, END = 4096, 1
BLOCK = 1024


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Tokenise and cut: ``(key, piece, start, length, ids_crc32[, ids])``."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    if with_ids:
        schema += ", ids array<int>"
    names = [field.split()[0] for field in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", 2 * 2**20):
                yield pa.RecordBatch.from_arrays(
                    cut_ids(part.column("doc_id"), *encoder.texts(part.column("text")),
                            capacity, with_ids),
                    names=names)
        encoder.shrink()

    return rows.mapInArrow(cut, schema)


def cut_ids(
    docs: pa.Array, ids: np.ndarray, bounds: np.ndarray, capacity: int, with_ids: bool,
) -> list[pa.Array]:
    """Columns of the pieces of documents, whose ids lie in a row, parted at ``bounds``."""
    ids = np.insert(ids, bounds[1:], END).astype("<u4", copy=False)
    firsts = bounds + np.arange(len(bounds))  # each document is one token longer now
    sizes = np.diff(firsts)
    many = -(-sizes // capacity)
    row = np.repeat(np.arange(len(sizes)), many)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    start = piece * capacity
    length = np.minimum(sizes[row] - start, capacity)
    low = firsts[row] + start
    view = memoryview(ids).cast("B")
    sums = [zlib.crc32(view[a:b]) for a, b in zip((4 * low).tolist(), (4 * (low + length)).tolist())]
    columns = [docs.take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start),
               pa.array(length), pa.array(sums, pa.int64())]
    if with_ids:  # pieces stand in a row too, without a hole
        ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32))))
    return columns


class Sweeps:
    """The packing plan for ``counts`` documents of each length.

    ``placed`` lists ``(length, first rank, last rank, first sequence, offset)``: the
    documents of a length with these ranks go to consecutive sequences at one offset.
    """

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity, self.left = capacity, dict(counts)
        self.rank = dict.fromkeys(counts, 0)
        self.placed: list[tuple[int, int, int, int, int]] = []
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, how many)
        self.sequences = 0
        upper = capacity
        for parts in (2, 3, 4, 5, 6, 8, 12, 16, 32, 64, capacity + 1):
            lower = capacity // parts
            sizes = [s for s in sorted(self.left, reverse=True) if lower < s <= upper]
            while any(self.left[s] for s in sizes):
                if not self.sweep(sizes):
                    self.open(sizes)
            upper = lower

    def open(self, sizes: list[int]) -> None:
        """New sequences for what is left of a class, as few as could hold it."""
        total = sum(s * self.left[s] for s in sizes)
        many = -(-total // self.capacity)
        if 2 * sizes[-1] > self.capacity:  # no two share a sequence
            many = sum(self.left[s] for s in sizes)
        self.gaps.setdefault(self.capacity, []).append((self.sequences, many))
        self.sequences += many

    def sweep(self, sizes: list[int]) -> int:
        """Match the documents left of these sizes, at most one for each gap."""
        waiting = sorted((g for g in self.gaps if g >= sizes[-1]), reverse=True)
        stack: list[tuple[int, int, int]] = []
        filled: list[tuple[int, int, int]] = []
        matched = at = 0
        for size in sizes:
            while at < len(waiting) and waiting[at] >= size:
                gap = waiting[at]
                stack.extend((gap, first, many) for first, many in self.gaps.pop(gap))
                at += 1
            while self.left[size] and stack:
                gap, first, many = stack.pop()
                taken = min(many, self.left[size])
                if taken < many:
                    stack.append((gap, first + taken, many - taken))
                rank = self.rank[size]
                self.placed.append((size, rank, rank + taken - 1, first, self.capacity - gap))
                self.rank[size] += taken
                self.left[size] -= taken
                filled.append((gap - size, first, taken))
                matched += taken
        for gap, first, many in [*stack, *filled]:
            if gap:
                self.gaps.setdefault(gap, []).append((first, many))
        return matched


def ranked(items: DataFrame, size: str, ids: list[str]) -> DataFrame:
    """Number the rows of each size from 0 as ``_rank``, a hot size by many tasks."""
    spread = max(8, partitions(items.sparkSession))
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(*ids), F.lit(spread)))
    many = salted.groupBy(size, "_salt").agg(F.count(F.lit(1)).alias("_many"))
    before = Window.partitionBy(size).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = many.select(
        size, "_salt", F.coalesce(F.sum("_many").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(size, "_salt").orderBy(*ids)) - 1
    return (salted.withColumn("_in", inside).join(starts, [size, "_salt"])
            .withColumn("_rank", F.col("_in") + F.col("_before"))
            .drop("_salt", "_in", "_before"))


def pack(items: DataFrame, capacity: int = CAPACITY, size: str = "length",
         ids: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows of a ``size`` between 1 and ``capacity``.

    Columns of these names that ``items`` has already are replaced.
    """
    items = items.drop("sequence_id", "offset")
    spark = items.sparkSession
    counts = {r[size]: r["n"] for r in
              items.groupBy(size).agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = Sweeps(counts, capacity).placed
    columns = list(zip(*plan)) if plan else [[]] * 5
    runs = spark.createDataFrame(pa.table({
        name: pa.array(values, pa.int64())
        for name, values in zip(("_size", "_low", "_high", "_first", "offset"), columns)}))
    runs = runs.select("*", F.explode(F.expr(
        f"sequence(_low div {BLOCK}, _high div {BLOCK})")).alias("_block"))
    rows = ranked(items, size, list(ids)).withColumn("_at", F.expr(f"_rank div {BLOCK}"))
    match = ((F.col(size) == F.col("_size")) & (F.col("_at") == F.col("_block"))
             & F.col("_rank").between(F.col("_low"), F.col("_high")))
    return rows.join(runs, match).select(
        *items.columns, (F.col("_first") + F.col("_rank") - F.col("_low")).alias("sequence_id"),
        "offset")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenised and packed into sequences of at most 4,096 tokens."""
    return packed_documents(table(spark, sf_dir, "documents"))


def packed_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    with small_batches(docs.sparkSession):
        cut = staged(pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces")
    return pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id",
                            "offset")
