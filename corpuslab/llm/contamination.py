"""Benchmark decontamination by templates.

Words of benchmark items and documents become templates: numbers, names and units turn into
typed placeholders, everything else into bare lower-case words. Windows of a template are
hash-joined, so that a question with new numbers or names still meets its original; then the
slots are checked: along one alignment of a document with an item, a value of the document stands
for a value of the item if it does so at half or more of the places of that value, and windows
in which another one does, or two do, are left out. Windows that agree word for word always
stay. An item is found in a document if enough of its windows are left, or if such windows cover
``RUN`` words in a row without a difference.

The benchmark decides how the join runs: its window hashes go to the workers as a filter while
there are at most ``FILTER_WINDOWS`` (8 bytes each), and all windows of the documents are shuffled to
the join beyond that. Documents are read whole.

Windows of placeholders (fewer than ``LITERALS`` plain words) are not searched. An item that has no
other, or fewer words than a window, is one window as a whole, and is found where all its bare
words stand in a row; then it counts as one matched window of one.

Null and empty texts have no words and are never found. Repeated rows are found alike, and repeated items too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslab.llm.common import table
from corpuslab.llm.tokens import slices
from corpuslab.session import small_batches, staged

WIDTH, LITERALS, COVERAGE, LEAST = 6, 4, 0.35, 3
RUN = 13  # words
FILTER_WINDOWS = 2_000_000
U = np.uint64
# fixed values: what a template keeps as a type
UNITS = frozenset(
    "mm cm m km inch inches ft feet foot yard yards mile miles mg g kg gram grams kilogram kilograms "
    "lb lbs oz ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes "
    "h hour hours day days week weeks month months year years cent cents dollar dollars euro euros "
    "pound pounds percent % $ € £ °c °f kmh mph".split())
NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty "
    "hundred thousand million".split())
TYPES = ("<number>", "<unit>", "<name>")


def template(texts: pa.Array):
    """Template hashes, plain-word flags and bare words of all texts, and where each begins."""
    lists = pc.split_pattern_regex(pc.fill_null(texts, ""), r"[\x09-\x0d\x20]+")
    coded = lists.values.dictionary_encode()
    names, index = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    bare = pc.replace_substring_regex(
        pc.utf8_lower(names), r"^[^\p{L}\p{N}%$€£°]+|[^\p{L}\p{N}%$€£°]+$", "")
    bare = pc.replace_substring_regex(bare, r"^[%$€£]+([\p{L}\p{N}])", r"\1")
    bare = pc.replace_substring_regex(bare, r"([\p{L}\p{N}])[%$€£]+$", r"\1")
    word = bare.to_pylist()
    flag = lambda x, pattern: pc.match_substring_regex(x, pattern).to_numpy(zero_copy_only=False)
    number = flag(bare, r"^[\p{N}.,:/x-]*\p{N}[\p{N}.,:/x-]*$") | np.array(
        [w in NUMBERS for w in word], bool)
    unit = np.array([w in UNITS for w in word], bool)
    capital = flag(names, r"^[^\p{L}\p{N}]*\p{Lu}\p{Ll}")
    ends = flag(names, r"[.!?:;]['\")\]]*$")
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in word), U, len(word))
    kinds = [U(xxhash.xxh3_64_intdigest(t)) for t in TYPES]
    real = np.array([bool(w) for w in word], bool)
    if not len(index):
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), none.astype(bool), none, word, np.zeros(len(texts) + 1, np.int64)
    kept = real[index]
    bounds = np.concatenate([[0], np.cumsum(kept)])[lists.offsets.to_numpy()]
    at = index[kept]
    opens = np.ones(len(at), bool)
    opens[1:] = ends[at[:-1]]
    opens[np.minimum(bounds[:-1], max(len(at) - 1, 0))[np.diff(bounds) > 0]] = True
    name = capital[at] & ~opens
    out, plain = hashed[at], np.ones(len(at), bool)
    for mask, kind in ((name, kinds[2]), (unit[at], kinds[1]), (number[at], kinds[0])):
        out[mask], plain[mask] = kind, False
    return out, plain, at, word, bounds


def windows(texts: pa.Array, width: int = WIDTH):
    """``(text index, place, hash)`` of every window with enough plain words, and the parts."""
    hashed, plain, at, word, bounds = template(texts)
    sizes = np.diff(bounds)
    with np.errstate(over="ignore"):
        many = max(0, len(hashed) - width + 1)
        rolled = np.zeros(many, U)
        for i in range(width):
            rolled = (rolled ^ (rolled >> U(31))) * U(0x9E3779B97F4A7C15) + hashed[i:i + many]
        rolled = (rolled ^ (rolled >> U(29))) * U(0xBF58476D1CE4E5B9)
    counted = np.concatenate([[0], np.cumsum(plain)])
    literals = counted[width:] - counted[:-width] if many else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    same = owner[:many] == owner[width - 1:width - 1 + many] if many else np.zeros(0, bool)
    place = np.flatnonzero(same & (literals >= LITERALS))
    return owner[place], place, rolled[place].view(np.int64), (hashed, plain, at, word, bounds)


def _slots(place: np.ndarray, width: int, parts) -> list[list[str]]:
    _, plain, at, word, _ = parts
    return [[word[at[i]] for i in range(p, p + width) if not plain[i]] for p in place]


def _spots(place: np.ndarray, width: int, parts) -> list[list[int]]:
    """Where in its window each slot stands."""
    return [[i for i in range(width) if not parts[1][p + i]] for p in place]


def find_windows(rows: DataFrame, key: str, text: str, width: int = WIDTH,
                 only: np.ndarray | None = None) -> DataFrame:
    """``(key, place, window, slots, spots, windows)``; with ``only``, the windows among these hashes.

    ``windows`` counts all windows of the text that could be matched.
    """
    kind = dict(rows.dtypes)[key]
    wanted = rows.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = wanted.value
        for batch in batches:
            for part in slices(batch, text, 2 * 2**20):
                owner, place, hashes, parts = windows(part.column(text), width)
                total = np.bincount(owner, minlength=part.num_rows)
                if among is not None and len(among):
                    at = np.minimum(np.searchsorted(among, hashes), len(among) - 1)
                    hit = among[at] == hashes
                    owner, place, hashes = owner[hit], place[hit], hashes[hit]
                elif among is not None:
                    owner, place, hashes = owner[:0], place[:0], hashes[:0]
                yield pa.RecordBatch.from_arrays(
                    [part.column(key).take(pa.array(owner)),
                     pa.array(place - parts[4][owner]), pa.array(hashes),
                     pa.array(_slots(place, width, parts), pa.list_(pa.string())),
                     pa.array(_spots(place, width, parts), pa.list_(pa.int64())),
                     pa.array(total[owner])],
                    names=[key, "place", "window", "slots", "spots", "windows"])

    return rows.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, place long, window long, slots array<string>, "
             "spots array<long>, windows long")


def index_items(items: DataFrame, item: str, text: str, width: int) -> DataFrame:
    """The windows of all items."""
    rows = items.select(F.col(item).alias("item_id"), F.col(text).alias("text"))
    return staged(find_windows(rows, "item_id", "text", width).select(
        "window", "item_id", F.col("place").alias("item_place"),
        F.col("slots").alias("item_slots"), "spots", F.col("windows").alias("item_windows")), "items")


def _consistent(hits: DataFrame, lines: list[str]) -> DataFrame:
    """Windows that agree word for word or whose slots stand for what they mostly do in the line."""
    places = hits.select(*lines, F.explode("pairs").alias("p")).select(*lines, "p.*").distinct()
    votes = places.groupBy(*lines, "b", "d").agg(F.count(F.lit(1)).alias("n"))
    rare = votes.groupBy(*lines, "b").agg(
        F.sum("n").alias("all"), F.collect_list(F.struct("d", "n")).alias("told")).select(
        *lines, "b", F.explode(F.filter("told", lambda v: 2 * v["n"] < F.col("all"))).alias("v"))
    torn = rare.groupBy(*lines).agg(F.collect_set(F.struct("b", "v.d")).alias("torn"))
    match = [F.col(f"h.{c}").eqNullSafe(F.col(f"t.{c}")) for c in lines]
    told = F.transform("pairs", lambda p: F.struct(p["b"].alias("b"), p["d"].alias("d")))
    own = F.size(F.array_distinct(told)) == F.size(F.array_distinct(F.col("pairs.b")))
    fits = F.col("torn").isNull() | ~F.arrays_overlap(told, "torn")
    return hits.alias("h").join(torn.alias("t"), match, "left").where(
        F.col("same") | (own & fits)).select("h.*")


def _whole_windows(texts: pa.Array):
    """Where the bare words of each text begin, and a function of their hashes at a length."""
    _, _, at, word, bounds = template(texts)
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in word), U, len(word))[at]
    base = U(0x9E3779B97F4A7C15)  # odd, so that it has an inverse
    back = U(pow(int(base), -1, 2**64))
    ones = np.ones(max(0, len(hashed) - 1), U)
    first = np.ones(min(1, len(hashed)), U)
    up, down = (np.cumprod(np.concatenate([first, ones * x])) for x in (base, back))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(hashed * up)])
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))

    def rolled(size: int):
        """``(text index, place, hash)`` of all runs of ``size`` words within a text."""
        many = max(0, len(hashed) - size + 1)
        place = np.flatnonzero(owner[:many] == owner[len(hashed) - many:])
        sum_ = (sums[place + size] - sums[place]) * down[place]
        sum_ = (sum_ ^ (sum_ >> U(29)) ^ U(size)) * U(0xBF58476D1CE4E5B9)
        return owner[place], place - bounds[owner[place]], sum_.view(np.int64)

    return bounds, rolled


def bounded(rows: DataFrame) -> bool:
    """Whether there are few enough rows for one place: of windows, or of the items' rows with them."""
    return rows.limit(FILTER_WINDOWS + 1).count() <= FILTER_WINDOWS


def whole_items(items: DataFrame, item: str, text: str, width: int) -> DataFrame:
    """``(item_id, size, window)`` of the items that have words but no window to search."""
    kind = dict(items.dtypes)[item]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 * 2**20):
                owner, _, _, parts = windows(part.column("text"), width)
                sizes = np.diff(parts[4])
                bare = np.flatnonzero((np.bincount(owner, minlength=part.num_rows) == 0) & (sizes > 0))
                if not len(bare):
                    continue
                alone = part.take(pa.array(bare))
                _, rolled = _whole_windows(alone.column("text"))
                found = np.zeros(len(bare), np.int64)
                for size in np.unique(sizes[bare]):
                    own, place, hashes = rolled(int(size))
                    fits = sizes[bare][own] == size
                    found[own[fits]] = hashes[fits]
                yield pa.RecordBatch.from_arrays(
                    [alone.column("item_id"), pa.array(sizes[bare]), pa.array(found)],
                    names=["item_id", "size", "window"])

    return staged(items.select(F.col(item).alias("item_id"), F.col(text).alias("text")).mapInArrow(
        run, f"item_id {kind}, size long, window long"), "whole-items")


def _whole_leaks(docs: DataFrame, whole: DataFrame, key: str, text: str) -> DataFrame | None:
    """The pairs of ``leaks`` for items searched as a whole; None if there are none."""
    sizes = sorted(r["size"] for r in whole.select("size").distinct().collect())
    if not sizes:
        return None
    hashes = whole.select("window").distinct()
    few = bounded(hashes)
    wanted = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(
        [r["window"] for r in hashes.collect()], np.int64)) if few else None)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = wanted.value
        for batch in batches:
            for part in slices(batch, text, 2 * 2**20):
                _, rolled = _whole_windows(part.column(text))
                for size in sizes:
                    owner, place, hashes = rolled(size)
                    if only is not None:
                        at = np.minimum(np.searchsorted(only, hashes), len(only) - 1)
                        hit = only[at] == hashes
                        owner, place, hashes = owner[hit], place[hit], hashes[hit]
                    # the first of the equal ones in a text
                    _, first = np.unique(np.stack([owner, hashes]), axis=1, return_index=True)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(key).take(pa.array(owner[first])), pa.array(place[first]),
                         pa.array(hashes[first])], names=[key, "place", "window"])

    found = docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, place long, window long")
    index = whole.select("window", "item_id")
    return found.join(F.broadcast(index) if bounded(index) else index, "window").groupBy(key, "item_id").agg(
        F.min("place").alias("place")).select(
        key, "item_id", F.lit(1).cast("long").alias("matched"), F.lit(1).cast("long").alias("windows"),
        "place", F.lit(False).alias("reparameterised"), F.lit(1.0).alias("coverage"))


def _runs(kept: DataFrame, lines: list[str], width: int) -> DataFrame:
    """``(key, item_id, run)``: the most words in a row that windows without a difference cover."""
    order = Window.partitionBy(*lines).orderBy("item_place")
    opens = F.col("item_place") - F.lag("item_place").over(order) > width
    islands = kept.where("same").select(*lines, "item_place").distinct().withColumn(
        "new", F.when(opens, 1).otherwise(0)).withColumn("island", F.sum("new").over(order))
    return islands.groupBy(*lines, "island").agg(
        (F.max("item_place") - F.min("item_place") + width).alias("run")).groupBy(
        *lines[:2]).agg(F.max("run").alias("run"))


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id",
          text: str = "text", width: int = WIDTH, coverage: float = COVERAGE) -> DataFrame:
    """``(key, item_id, matched, windows, coverage, reparameterised)`` of found pairs."""
    index = index_items(items, item, text, width)
    hashes = index.select("window").distinct()
    few = bounded(hashes)
    only = np.sort(np.array(
        [r["window"] for r in hashes.collect()], np.int64)) if few else None
    found = find_windows(docs.select(key, text), key, text, width, only).drop("windows", "spots")
    with small_batches(docs.sparkSession):
        hits = staged(found.join(F.broadcast(index) if bounded(index) else index, "window").select(
            key, "item_id", "item_place", "item_windows", "place",
            (F.col("place") - F.col("item_place")).alias("shift"),
            F.arrays_zip(F.col("item_slots").alias("b"), F.col("slots").alias("d"),
                         F.transform("spots", lambda i: F.col("item_place") + i).alias("at")).alias("pairs"),
            (F.col("item_slots") == F.col("slots")).alias("same")), "hits")
    lines = [key, "item_id", "shift"]
    whole = _consistent(hits, lines)
    long = [F.col(f"p.{c}").eqNullSafe(F.col(f"r.{c}")) for c in lines[:2]]
    runs = _runs(whole, lines, width).where(F.col("run") >= RUN)
    pairs = whole.groupBy(key, "item_id").agg(
        F.count_distinct("item_place").alias("matched"), F.max("item_windows").alias("windows"),
        F.min("place").alias("place"), (~F.min("same")).alias("reparameterised"))
    share = F.col("matched") / F.col("windows")
    pairs = pairs.alias("p").join(runs.alias("r"), long, "left").select("p.*", "run")
    out = pairs.withColumn("coverage", share).where(
        F.col("run").isNotNull()
        | (share >= coverage) & (F.col("matched") >= F.least(F.lit(LEAST), F.col("windows")))).drop("run")
    others = _whole_leaks(docs, whole_items(items, item, text, width), key, text)
    return out if others is None else out.union(others.select(*out.columns))


def op9_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other numbers and names."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
