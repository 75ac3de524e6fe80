"""Exact Jaccard self-join of word shingle sets by PartEnum signatures.

Two sets of sizes a and b with similarity s or more differ in at most (1 - s) / (1 + s) (a + b)
shingles. For every size band the domain of shingles is hashed into a fixed number of
parts, and each part a set touches gives one signature, the hash of all its shingles there: a
subset enumeration with a second level of single parts. Two sets that differ in k shingles
differ in at most k parts, so a set that touches more than k parts shares a whole touched part
with each partner. A set that touches fewer tries further seeds, and emits the signatures of
each, until it does; thus empty parts never have to match. Bands overlap, so that every pair
that can be similar shares a band.

Sets, not documents, are nodes: copies fall together at once by the hash of their set, before
anything is shuffled within a partition. From there:

1. signatures are shuffled, and only those of two sets or more survive;
2. a set needs as many shared signatures as parts it touches beyond k, or has no partner;
3. each set is compared with the first and the last set of the signatures it shares most often,
   two comparisons instead of all pairs of a group; links join sets into stars;
4. only sets that share as many signatures as they need with other stars can link two
   stars. Sets that share a signature that is rare for both form clusters, in which each is compared
   with a hub (a few rounds), and those outside the largest star are counted against all sets of the
   cluster, block by block; pairs that share as many signatures as they need are compared where they
   meet, so no pairs are written;
5. links found by exact comparison are joined into components.

No pair is lost and no group is capped: pairs of one star are connected already. Shingles are
64-bit hashes. A null or empty text has the empty set, linked with nothing; repeated rows are
copies of one set; an empty table gives no rows; a null id is not a name for a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslab.llm.common import Workspace, forget_shuffles, partitions, table
from corpuslab.llm.components import components
from corpuslab.llm.tokens import slices
from corpuslab.session import small_batches, staged

WORDS, PERCENT = 5, 75
BAND, SPARE = 3.0, 1.06
SEEDS = 64
BROADCAST_NODES = 500_000
HUB_ROUNDS = 2
BLOCK_ITEMS = 2_000_000
SET_SCHEMA = "doc_id long, node long, n long, shingles array<long>"
U = np.uint64


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser, another one for each salt."""
    with np.errstate(over="ignore"):
        x = (x ^ U((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(32))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(29))


def shingle_sets(texts: pa.Array, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts in a row, and where each text begins."""
    lists = pc.split_pattern_regex(
        pc.ascii_lower(pc.fill_null(texts, "")), r"[\x09-\x0d\x20]+")
    coded = lists.values.dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), U, len(names))
    full = np.array([bool(w) for w in names], bool)
    index = coded.indices.to_numpy(zero_copy_only=False)
    kept = full[index] if len(index) else np.zeros(0, bool)
    bounds = np.concatenate([[0], np.cumsum(kept)])[lists.offsets.to_numpy()]
    found = hashed[index[kept]] if len(index) else np.zeros(0, U)
    sets, size = [], np.zeros(len(texts) + 1, np.int64)
    with np.errstate(over="ignore"):
        whole = len(found) - width + 1
        rolled = np.zeros(max(whole, 0), U)
        for i in range(width):
            rolled = mix(rolled + found[i:i + max(whole, 0)], i + 1)
        for i in range(len(texts)):
            start, stop = bounds[i], bounds[i + 1]
            if stop - start >= width:
                own = np.unique(rolled[start:stop - width + 1])
            elif stop > start:
                last = np.zeros(1, U)
                for j in range(start, stop):
                    last = mix(last + found[j], 101 + int(j - start))
                own = last
            else:
                own = np.zeros(0, U)
            sets.append(own)
            size[i + 1] = len(own)
    return (np.concatenate(sets) if sets else np.zeros(0, U)), np.cumsum(size)


def set_nodes(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The hash of each set, whatever the order of its members; 0 for the empty set."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(flat, 7), dtype=U)])
    with np.errstate(over="ignore"):
        total = sums[bounds[1:]] - sums[bounds[:-1]]
    sizes = np.diff(bounds)
    out = mix(total + sizes.astype(U), 8)
    out[sizes == 0] = 0
    return out.view(np.int64)


def most_apart(size: int, percent: int) -> int:
    """How far a set of this size can be from a partner."""
    other = size * 100 // percent
    return (100 - percent) * (size + other) // (100 + percent)


@lru_cache(maxsize=None)
def bands(percent: int, up_to: int) -> tuple[tuple[int, int, int], ...]:
    """``(least size, largest size, parts)`` of bands that cover sizes to ``up_to``."""
    out, low = [], 1
    while not out or out[-1][1] < up_to:
        high = max(low + 2, int(low * BAND))
        wanted = SPARE * (most_apart(high, percent) + 1) + 1
        parts = 2
        while parts * (1 - (1 - 1 / parts) ** high) < min(wanted, high - 0.5):
            parts = int(parts * 1.02) + 1
        out.append((low, high, parts))
        low = max(low + 1, percent * (high + 1) // 100)
    return tuple(out)


def signatures(
    flat: np.ndarray, bounds: np.ndarray, percent: int = PERCENT,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(signature, index of the set, band, need)``: need is the number to be shared."""
    sizes = np.diff(bounds)
    pairs, seed, out = [], 0, []
    for band, (low, high, parts) in enumerate(bands(percent, int(sizes.max(initial=1)))):
        inside = np.flatnonzero((sizes >= low) & (sizes <= high))
        pairs.append((inside, np.full(len(inside), band), np.full(len(inside), parts)))
    owner, band, parts = (np.concatenate(c) for c in zip(*pairs))
    apart = np.array([most_apart(int(s), percent) for s in sizes], np.int64)
    while len(owner) and seed < SEEDS:
        many = sizes[owner]
        ends = np.cumsum(many)
        at = np.arange(int(ends[-1])) + np.repeat(bounds[owner] - (ends - many), many)
        base = np.cumsum(parts) - parts
        values = flat[at]
        part = (mix(values, 1000 + seed) >> U(11)) % np.repeat(parts, many).astype(U)
        cell = np.repeat(base, many) + part.astype(np.int64)
        cells = int(base[-1] + parts[-1])
        content = mix(values, 2000 + seed)
        low = np.bincount(cell, (content & U(0xFFFFFFFF)).astype(np.float64), cells)
        high = np.bincount(cell, (content >> U(32)).astype(np.float64), cells)
        touched = np.bincount(cell, minlength=cells) > 0
        which = np.repeat(np.arange(len(owner)), parts)
        occupied = np.bincount(which[touched], minlength=len(owner))
        spare = occupied - apart[owner]
        need = np.maximum(1, spare) if seed == 0 else np.ones(len(owner), np.int64)
        place = (np.arange(cells) - base[which])[touched].astype(U)
        which = which[touched]
        sig = mix(mix(low[touched].astype(U), 3) + high[touched].astype(U), 4)
        sig = mix(sig + place * U(31), 5000 + seed)
        sig = mix(sig + band[which].astype(U), 6)
        # a set that has to try further seeds can be met under any of them
        lenient = np.where(spare > 0, need, 1)
        out.append((sig, owner[which], band[which], lenient[which]))
        again = spare <= 0
        owner, band, parts = owner[again], band[again], parts[again]
        seed += 1
    if not out:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), none, none, none
    return tuple(np.concatenate(c) for c in zip(*out))


def _emit(percent: int, width: int):
    """Membership rows (info < 0: doc_id and size) and signature rows (band and need)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text", 2 * 2**20):
                flat, bounds = shingle_sets(part.column("text"), width)
                nodes, sizes = set_nodes(flat, bounds), np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes), part.column("doc_id"), pa.array(-1 - sizes)],
                    names=["key", "node", "info"])
                fresh = [i for i, x in enumerate(nodes.tolist())
                         if sizes[i] and not (x in seen or seen.add(x))]
                own = np.concatenate([flat[bounds[i]:bounds[i + 1]] for i in fresh]
                                     ) if fresh else np.zeros(0, U)
                ends = np.concatenate([[0], np.cumsum(sizes[fresh])]).astype(np.int64)
                sig, at, band, need = signatures(own, ends, percent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig.view(np.int64)), pa.array(nodes[fresh][at]),
                     pa.array(band * 2**32 + need)], names=["key", "node", "info"])
    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one shuffle partition: memberships, and signatures that two sets or more have."""
    kept: list[list[np.ndarray]] = [[], [], []]
    for batch in batches:
        info = batch.column("info").to_numpy()
        member = batch.filter(pa.array(info < 0))
        nothing = pa.nulls(len(member), pa.int64())
        yield member.append_column("low", nothing).append_column("high", nothing)
        for column, name in zip(kept, ("key", "node", "info")):
            column.append(batch.column(name).to_numpy(zero_copy_only=False)[info >= 0])
    if not kept[0]:
        return
    key, node, info = (np.concatenate(c).astype(np.int64) for c in kept)
    order = np.lexsort((node, key))
    key, node, info = key[order], node[order], info[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node, info = key[fresh], node[fresh], info[fresh]
    next_same = np.zeros(len(key), bool)
    next_same[:-1] = key[1:] == key[:-1]
    shared = next_same.copy()
    shared[1:] |= next_same[:-1]
    fresh = ~_same(key)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(key)) - 1
    group = np.cumsum(fresh) - 1
    yield pa.RecordBatch.from_arrays(
        [pa.array(x[shared]) for x in (key, node, info, node[first[group]], node[last[group]])],
        names=["key", "node", "info", "low", "high"])


def _same(key: np.ndarray) -> np.ndarray:
    """Whether each element equals the one before."""
    out = np.zeros(len(key), bool)
    out[1:] = key[1:] == key[:-1]
    return out


def _sent(nodes: DataFrame) -> DataFrame:
    """A table of one row per node, marked for broadcast while it is small."""
    return F.broadcast(nodes) if nodes.limit(
        BROADCAST_NODES + 1).count() <= BROADCAST_NODES else nodes


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, node, n, shingles)`` of rows ``(doc_id, text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 * 2**20):
                flat, bounds = shingle_sets(part.column("text"), width)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(set_nodes(flat, bounds)),
                     pa.array(np.diff(bounds)),
                     pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)),
                                              pa.array(flat.view(np.int64)))],
                    names=["doc_id", "node", "n", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, SET_SCHEMA)


def _linked(percent: int):
    """Whether the sets ``s`` and ``o`` of a row are similar, by exact comparison."""
    both = F.size(F.array_intersect("s", "o"))
    return 100 * both >= percent * (F.size("s") + F.size("o") - both)


def _compare_block(percent: int):
    """Links between an outlier (right) and a set of this block (left) in another star.

    Pairs are counted by shared signatures, and those with enough are compared by their sets.
    """
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        if len(left) and len(right):
            sizes = left["sigs"].map(len).to_numpy()
            sig = np.concatenate(left["sigs"].to_list())
            order = np.argsort(sig, kind="stable")
            sig, at = sig[order], np.repeat(np.arange(len(left)), sizes)[order]
            node, star = left["node"].to_numpy(), left["star"].to_numpy()
            need, outer = left["need"].to_numpy(), left["outlier"].to_numpy()
            sets, lengths = left["shingles"].to_list(), left["shingles"].map(len).to_numpy()
            for x, x_star, x_need, x_sigs, own in zip(*(
                    right[f"o_{c}"] for c in ("node", "star", "need", "sigs", "shingles"))):
                low, high = np.searchsorted(sig, x_sigs, "left"), np.searchsorted(sig, x_sigs, "right")
                many = high - low
                if not many.sum():
                    continue
                ends = np.cumsum(many)
                hits = at[np.arange(int(ends[-1])) + np.repeat(low - (ends - many), many)]
                good = np.bincount(hits, minlength=len(left)) >= np.maximum(need, x_need)
                good &= (star != x_star) & ((node < x) | ~outer)
                n = len(own)
                good &= (100 * n >= percent * lengths) & (100 * lengths >= percent * n)
                for i in np.flatnonzero(good):
                    both = len(np.intersect1d(own, sets[i], assume_unique=True))
                    if 100 * both >= percent * (n + lengths[i] - both):
                        found.append((x, node[i]))
        a, b = zip(*found) if found else ((), ())
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Add ``linked`` to rows ``(node, hub, …)``; sets meet at the hub, each once for a row."""
    hubs = pairs.select("hub").distinct().join(
        sets.select(F.col("node").alias("hub"), F.col("shingles").alias("o")), "hub")
    return sets.withColumnRenamed("shingles", "s").join(_sent(pairs), "node").join(
        hubs, "hub").withColumn("linked", _linked(percent)).drop("s", "o")


def _largest_share(shared: DataFrame, hub: str) -> DataFrame:
    """``(node, hub)``: of the first (or last) sets of its signatures, the one met most often."""
    met = shared.where(F.col(hub) != F.col("node")).groupBy("node", F.col(hub).alias("hub")).agg(
        F.count(F.lit(1)).alias("c"))
    return met.groupBy("node").agg(F.max_by("hub", F.struct("c", "hub")).alias("hub"))


def links(docs: DataFrame, percent: int = PERCENT, width: int = WORDS
          ) -> tuple[DataFrame, DataFrame]:
    """Members ``(node, doc_id, n)`` of every set and links ``(a, b)`` between sets.

    The links connect exactly the sets that chains of similar pairs connect.
    """
    spark = docs.sparkSession
    work = Workspace(spark)
    rows = docs.select("doc_id", "text").mapInArrow(
        _emit(percent, width), "key long, node long, info long")
    with small_batches(spark):
        dealt = work.staged(rows.repartition(partitions(spark), "key").mapInArrow(
            _shared, "key long, node long, info long, low long, high long"), "signatures")
    forget_shuffles(spark)
    members = staged(dealt.where("info < 0").select(
        F.col("key").alias("node"), F.col("node").alias("doc_id"),
        (-1 - F.col("info")).alias("n")), "members")
    shared = dealt.where("info >= 0").select(
        F.col("key").alias("sig"), "node", "low", "high", F.expr("info >> 32").alias("band"),
        F.expr("info & 4294967295").alias("need"))
    # a set that shares fewer signatures than any partner would need has none
    degree = work.staged(_enough(shared).groupBy("node").agg(
        F.sum("c").alias("degree"), F.min("m").alias("need")), "degrees")
    shared = shared.join(_sent(degree.select("node")), "node", "left_semi")

    least = work.staged(members.join(_sent(degree.select("node")), "node", "left_semi").groupBy(
        "node").agg(F.min("doc_id").alias("doc_id")), "survivors")
    ids = least.select("doc_id").distinct()
    picked = docs.select("doc_id", "text").join(_sent(ids), "doc_id", "left_semi")
    with small_batches(spark):
        sets = work.staged(sets_of(picked, width).join(
            _sent(least), ["doc_id", "node"], "left_semi").dropDuplicates(["node"]).select(
            "node", "shingles"), "sets")

    # what several queries read is written, so that none plans and shuffles it again
    pairs = work.staged(
        _largest_share(shared, "low").union(_largest_share(shared, "high")).distinct(), "pairs")
    forget_shuffles(spark)
    spokes = work.staged(_compared(pairs, sets, percent).where("linked").select(
        F.col("node").alias("a"), F.col("hub").alias("b")), "spokes")

    # what could still link two stars: sets that share enough signatures with other stars
    stars = work.staged(_stars(degree, spokes), "stars")
    mixed = shared.join(_sent(stars), "node")
    open_sigs = mixed.groupBy("sig").agg(
        F.min("star").alias("x"), F.max("star").alias("y"), F.count(F.lit(1)).alias("many")).where(
        "x <> y").select("sig", "many")
    mixed = work.staged(mixed.join(open_sigs, "sig").select(
        "sig", "node", "band", "need", "many"), "mixed")
    able = work.staged(_enough(mixed).groupBy("node").agg(F.min("m").alias("need")), "able-nodes")
    mixed = work.staged(_marked_rare(mixed.drop("need", "band").join(_sent(able), "node")), "able")
    forget_shuffles(spark)
    # what is common joins far more sets than can be linked, and each cluster is a quadratic step
    rare = mixed.where("rare").select("sig", "node")
    first = rare.groupBy("sig").agg(F.min("node").alias("b"), F.max("node").alias("last")).where(
        "b <> last").select("sig", "b")
    cluster = components(rare.join(first, "sig").select(F.col("node").alias("a"), "b")).join(
        _sent(able), "node").select("node", "need", F.col("component").alias("cluster"))
    cluster = work.staged(cluster.join(degree.select("node", "degree"), "node"), "clusters")
    waiting = cluster
    for _ in range(HUB_ROUNDS):
        best = waiting.groupBy("cluster").agg(
            F.max_by("node", F.struct("degree", "node")).alias("hub"))
        trial = work.staged(waiting.join(best, "cluster").where("node <> hub"), "trial")
        tested = work.staged(_compared(trial, sets, percent), "tested")
        forget_shuffles(spark)
        spokes = spokes.union(tested.where("linked").select(
            F.col("node").alias("a"), F.col("hub").alias("b")))
        waiting = tested.where("not linked").select("node", "need", "cluster", "degree")

    stars = work.staged(_stars(degree, spokes), "stars")
    starred = work.staged(cluster.join(_sent(stars), "node"), "starred")
    largest = starred.groupBy("cluster", "star").agg(F.count(F.lit(1)).alias("c")).groupBy(
        "cluster").agg(F.max_by("star", F.struct("c", "star")).alias("main"),
                       F.count(F.lit(1)).alias("many"))
    open_sets = work.staged(starred.join(largest.where("many > 1"), "cluster").select(
        "node", "cluster", "star", "need", (F.col("star") != F.col("main")).alias("outlier")), "open")
    sigs = mixed.select("sig", "node").join(
        _sent(open_sets.select("node")), "node", "left_semi").groupBy("node").agg(
        F.collect_set("sig").alias("sigs"))  # as many as the parts of its bands
    whole = work.staged(sets.join(_sent(open_sets), "node").join(sigs, "node"), "whole")
    sizes = whole.groupBy("cluster").agg(F.ceil(
        F.sum(F.size("sigs") + F.size("shingles")) / BLOCK_ITEMS).cast("int").alias("blocks"))
    whole = whole.join(sizes, "cluster")
    left = whole.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    right = whole.where("outlier").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = right.select(*[F.col(c).alias(f"o_{c}") for c in right.columns])
    found = left.groupBy("cluster", "block").cogroup(
        right.groupBy("o_cluster", "o_block")).applyInPandas(
        _compare_block(percent), "a long, b long")
    out = staged(spokes.union(found), "links")
    work.clear()
    return members, out


def _enough(shared: DataFrame) -> DataFrame:
    """``(node, band, c, m)`` of sets that share the ``m`` signatures a partner would need."""
    return shared.groupBy("node", "band").agg(
        F.count(F.lit(1)).alias("c"), F.max("need").alias("m")).where("c >= m")


def _marked_rare(shared: DataFrame) -> DataFrame:
    """Add ``rare`` to rows ``(sig, node, many, need)``: all but the ``need - 1`` commonest of a set.

    In one order for all sets, those with the fewest sets first: of the signatures that a pair shares, as
    many as both need, the first is rare for both, as at least ``need - 1`` others follow it in either.
    """
    own = Window.partitionBy("node")  # as many rows as the parts of its bands
    nth = F.row_number().over(own.orderBy("many", "sig"))
    return shared.withColumn("rare", nth <= F.count(F.lit(1)).over(own) - F.col("need") + 1)


def _stars(nodes: DataFrame, spokes: DataFrame) -> DataFrame:
    """``(node, star)``: what the links so far connect."""
    joined = components(spokes).withColumnRenamed("component", "star")
    return nodes.select("node").join(joined, "node", "left").select(
        "node", F.coalesce("star", "node").alias("star"))


def similar_groups(docs: DataFrame, percent: int = PERCENT, width: int = WORDS) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row of ``(doc_id, text)``."""
    members, found = links(docs, percent, width)
    least = members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = found.join(least.select(F.col("node").alias("a"), F.col("least").alias("x")), "a").join(
        least.select(F.col("node").alias("b"), F.col("least").alias("y")), "b")
    groups = components(named.select(F.col("x").alias("a"), F.col("y").alias("b")))
    lowest = least.join(groups.withColumnRenamed("node", "least"), "least", "left").select(
        "node", F.coalesce("component", "least").alias("lowest"))
    return members.join(lowest, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.coalesce("lowest", "doc_id").alias("component_id"))


def op5_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: five-word shingles, similarity 0.75."""
    return similar_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
