"""Spelling variants: words one edit apart, by a dictionary of trie-node pairs.

The words are laid in a trie and, read backwards, in a second one; the nodes of both are numbered in
the order of a walk through the sorted words. A word cut at any place is a pair of numbers
(node of what is before, node of what follows). A word with one position skipped is such a pair as
well. Two words that differ by one replaced character have the same pair where that position is skipped;
a word with one character more has, where it is skipped, the pair of a cut of the other. Both are equi-joins on
two integers and exact. A pair of nodes is shared by at most one word per character of the
alphabet, and by at most one cut, so no group is large and no pair of words is ever written.

Words are counted over all rows of the input (null words: none); words below ``least`` characters or
``seen`` occurrences are no words here. Ties of counts go to the smaller word in code-point order.
A word of any length is a row of as many numbers. A form has ten times the count of its word, so a chain
of forms ends after as many steps as a count has digits. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslab.llm.common import Workspace, table
from corpuslab.session import shared_dir, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTER = r"[A-Za-zÀ-ÿ]"


@dataclass(frozen=True)
class Carry:
    """What a block of sorted words takes over from the blocks before it."""

    nodes: list[int]  #: numbers of the nodes that its first word shares with the word before
    base: int  #: nodes numbered before

    def number(self, path: list[int]) -> list[int]:
        """The numbers among all blocks of nodes numbered within the block."""
        shared = len(self.nodes)
        return [k + self.base - shared if k > shared else self.nodes[k - 1] for k in path]


def shared_prefix(a: str, b: str) -> int:
    """How many leading characters two words have in common."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def step(word: str, before: str, path: list[int], made: int) -> tuple[list[int], int]:
    """The nodes on the way of the word after ``before``, numbered on from ``made``."""
    keep = shared_prefix(before, word)
    new = len(word) - keep
    return path[:keep] + list(range(made + 1, made + 1 + new)), made + new


def number_nodes(words: DataFrame, word: str, out: str) -> DataFrame:
    """Add ``out``: the numbers of the trie nodes from the root (0) to the end of each word.

    Words are distinct. A node is numbered where the first word below it stands in code-point order.
    Sorted ranges are walked in parallel, each as if it were the first; what a range shares with the
    ones before it is known from its first and their last word, one row per range in the driver.
    """
    shared_dir(words.sparkSession)
    blocks = words.repartitionByRange(word).sortWithinPartitions(word).withColumn(
        "_block", F.spark_partition_id()).checkpoint()

    def ends(batches):
        first, last, path, made, block = None, "", [], 0, 0
        for batch in batches:
            for value, block in zip(*(c.to_pylist() for c in batch.columns)):
                first = value if first is None else first
                path, made = step(value, last, path, made)
                last = value
        if first is not None:
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([block], pa.int32()), "first": [first], "last": [last],
                "path": pa.array([path], pa.list_(pa.int64())), "made": pa.array([made], pa.int64())})

    found = blocks.select(word, "_block").mapInArrow(
        ends, "block int, first string, last string, path array<long>, made long"
    ).orderBy("block").collect()
    carries: dict[int, Carry] = {}
    last, path, base = "", [], 0
    for r in found:
        carry = Carry(path[:shared_prefix(last, r["first"])], base)
        carries[r["block"]] = carry
        last, path = r["last"], carry.number(r["path"])
        base += r["made"] - len(carry.nodes)

    def number(batches):
        before, path, made, carry = "", [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            carry = carry or carries[batch.column("_block")[0].as_py()]
            flat, offsets = [], [0]
            for value in batch.column(word).to_pylist():
                path, made = step(value, before, path, made)
                before = value
                flat.append(0)
                flat += carry.number(path)
                offsets.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))
            names = [c for c in batch.schema.names if c != "_block"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], lists], [*names, out])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema)
    return blocks.mapInArrow(number, f"{kept}, `{out}` array<long>")


def node_pairs(numbered: DataFrame) -> DataFrame:
    """``(p, s, kind, id, n)``: the cuts (kind 2) and skipped positions (0, 1) of all words.

    Skips of one run of equal characters spell the same shorter word; kind 1 is the first of a run.
    """
    size = F.size("ahead") - 1
    cuts = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(
        F.get("ahead", i).alias("p"), F.get("back", size - i).alias("s"),
        F.lit(2).alias("kind")))
    letter = lambda at: F.substr("word", at, F.lit(1))
    skips = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(
        F.get("ahead", i).alias("p"), F.get("back", size - i - 1).alias("s"),
        F.when((i > 0) & (letter(i) == letter(i + 1)), 0).otherwise(1).alias("kind")))
    return numbered.select(
        F.explode(F.concat(cuts, skips)).alias("at"), F.element_at("ahead", -1).alias("id"), "n",
    ).select("at.p", "at.s", "at.kind", "id", "n")


def nearest(pairs: DataFrame) -> DataFrame:
    """``(id, n_near, best)``: near words of each word that has any, and the most frequent one.

    ``best`` is (count, minus id). In a group of one node pair, words with a skip are each other's
    replacements, and those with the first skip of a run are one longer than the cut.
    """
    group = Window.partitionBy("p", "s")
    row = F.struct("n", (-F.col("id")).alias("minus"))
    cut, run = F.col("kind") == 2, F.col("kind") == 1

    def top(which: Column) -> Column:
        return F.max(F.when(which, F.col("own"))).over(group)

    shared = pairs.withColumn("others", F.count(F.lit(1)).over(group) - 1).where("others > 0")
    best = shared.withColumn("own", row).select(
        "*", top(~cut).alias("first"), top(run).alias("longer"), top(cut).alias("shorter"),
        F.sum(F.when(run, 1).otherwise(0)).over(group).alias("n_longer"),
        F.sum(F.when(cut, 0).otherwise(1)).over(group).alias("n_skips"),
        # the best of the others is the group's best, or for that one the second
        F.lead(F.when(~cut, F.col("own"))).over(
            group.orderBy(cut.cast("int"), F.col("own").desc())).alias("next"))
    replaced = F.when(F.col("own") == F.col("first"), F.col("next")).otherwise(F.col("first"))
    told = best.select(
        "id",
        F.when(cut, F.col("n_longer")).otherwise(
            F.col("n_skips") - 1 + F.when(run & F.col("shorter").isNotNull(), 1).otherwise(0)
        ).alias("near"),
        F.when(cut, F.col("longer")).when(run, F.greatest(replaced, F.col("shorter")))
        .otherwise(replaced).alias("best"))
    return told.where("near > 0").groupBy("id").agg(
        F.sum("near").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``(id, root)``: the end of the chain of forms of each id of ``forms(id, form)``.

    Pointers are doubled until none moves: as many rounds as the log of the longest chain.
    """
    spark = forms.sparkSession
    work = Workspace(spark)
    links = work.staged(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        on = links.select(F.col("id").alias("root"), F.col("root").alias("further"))
        moved = links.join(on, "root").limit(1).count()
        if not moved:
            return links
        earlier, work = work, Workspace(spark)
        links = work.staged(links.join(on, "root", "left").select(
            "id", F.coalesce("further", "root").alias("root")), "roots")
        earlier.clear()


def variants(words: DataFrame, least: int = 7, seen: int = 2, ratio: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``words(word, n)``.

    ``n`` of rows with the same word are added up. The form of a word is its most frequent near word, if
    that has at least ``ratio`` times its count.
    """
    counts = words.where(F.length("word") >= least).groupBy("word").agg(
        F.sum("n").alias("n")).where(F.col("n") >= seen)
    ahead = number_nodes(counts, "word", "ahead")
    known = staged(ahead.select(F.element_at("ahead", -1).alias("id"), "word", "n"), "words")
    both = number_nodes(ahead.withColumn("drow", F.reverse("word")), "drow", "back")
    work = Workspace(words.sparkSession)
    near = work.staged(nearest(node_pairs(both)), "near")
    judged = known.join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("best.n") >= ratio * F.col("n"), F.col("best")).alias("best"))
    judged = staged(judged.select(
        "id", "word", "n", "n_near", (-F.col("best.minus")).alias("form_id"),
        F.col("best.n").alias("form_n")), "judged")
    work.clear()
    chained = roots(judged.where("form_id is not null").select("id", F.col("form_id").alias("form")))
    names = known.select(F.col("id").alias("form_id"), F.col("word").alias("form"))
    ends = known.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    told = judged.where("form_id is not null").join(names, "form_id").join(chained, "id").join(
        ends, "root").select("word", "form", F.col("root_word").alias("root"), "n", "n_near", "form_n")
    return told.union(judged.where("form_id is null").select(
        "word", F.lit(None).cast("string"), "word", "n", "n_near", F.lit(None).cast("long")))


def misspelled(doc_id: Column, run: Column, every: int = 31) -> Column:
    """The lower-cased run; one in ``every`` lacks one character, by a checksum of id and run."""
    low = F.translate(run, UPPER, LOWER)
    mark = F.crc32(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), low).cast("binary"))
    at = (mark % F.length(low)).cast("int")
    return F.when(mark % every == 0, F.concat(
        F.substr(low, F.lit(1), at), F.substr(low, at + 2))).otherwise(low)


def document_words(docs: DataFrame, least: int = 7) -> DataFrame:
    """``(word, n)`` for each run of at least ``least`` letters of all texts."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(
        "text", F.lit(f"{LETTER}{{{least},}}"), F.lit(0))).alias("run"))
    return runs.select(
        misspelled(F.col("doc_id"), F.col("run")).alias("word"), F.lit(1).cast("long").alias("n"))


def op11_node_pair_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of all words of at least 7 letters that occur twice."""
    return variants(document_words(table(spark, sf_dir, "documents")))
