"""Language-model scores from a log-frequency Bloom filter of bigram counts.

Counts of bigrams are quantised to powers of two; a bigram of level q enters the filter with the
levels 1 to q, and its count is read back by probing level after level until one is missing. The
filter is built in segments, each by the task that holds the bigrams of that segment and sized by
what enters it (``BITS_PER_ENTRY`` for each level of a distinct bigram), so that the rate of false
hits is the same at every size of the input. Segments stay where they are: the distinct bigrams of a
block of texts go there once, with their counts in the texts that the filter learns from, and come
back with their levels.

The probability of a token is a mixture of its relative frequency after its predecessor, as the
filter tells it, and of its smoothed unigram frequency. The weight depends on how often the
predecessor occurs, and is chosen on training texts kept out of the filter (one in fifty, by a hash
that no rule for held-out texts uses). Where no such text has a token, the weight is ``UNTUNED``.

Unigram counts are exact and unbounded in number, so they are never gathered: texts are dealt into
blocks, each block sends the counts of its distinct tokens to where they are summed, and gets
back those of its tokens that other blocks have as well.

Tokens are words (A-Z lowered) and one end per text; the predecessor of the first is an end. A null
text is an empty one, the end alone; without training texts only the constant part of the base
is left; repeated rows count each; an empty table gives no rows. Token counts, by hashes
of 64 bits, cover whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm.common import forget_shuffles, held_out, partitions, table
from corpuslab.llm.tokens import slices
from corpuslab.session import staged

FOLDS, DEV_FOLDS = 5, 50
FILTER_BITS, BITS_PER_ENTRY, PROBES, MAX_LEVEL = 2**29, 12, 3, 48  # the first: most marked at once, a byte each
SEGMENT_TOKENS = 2**22
KEY_BYTES = 5
SLICE = 2**21  # bytes of text worked on at once, beside the filter
GRID = (0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 0.55, 0.8)
UNTUNED = 0.1  # one of the grid
BANDS = 12
U = np.uint64
END = U(xxhash.xxh3_64_intdigest("\n"))
#: bytes that are no white space, and the lower case of A-Z
IN_WORD, LOWER = np.ones(256, bool), np.arange(256, dtype=np.uint8)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER[0x41:0x5B] += 0x20
BLOB = "kind int, block long, bucket int, blob binary"


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ U((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(31))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(30))


def coded_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, the end last; which of them each token is, and where a text begins.

    White space is found in the bytes of all texts at once; only distinct words are hashed one by one.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, places, data = texts.buffers()
    at = np.frombuffer(places, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data or b"", np.uint8)[at[0]:at[-1]]
    at = at - at[0]
    inside = IN_WORD[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    real = np.diff(at) > 0  # a word ends with its text
    for mark, edge in ((opens, at[:-1][real]), (closes, at[1:][real] - 1)):
        mark[edge] = inside[edge]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    places = np.concatenate([[0], np.cumsum(last - first + 1)])
    coded = pa.Array.from_buffers(pa.large_binary(), len(first), [
        None, pa.py_buffer(places), pa.py_buffer(LOWER[data[inside]])]).dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False)  # many times faster than a list of scalars
    hashed = np.empty(len(names) + 1, U)
    hashed[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, names), U, len(names))
    hashed[-1] = END
    bounds = np.searchsorted(first, at) + np.arange(len(at))
    index = np.full(int(bounds[-1]), len(names), np.int64)
    inner = np.ones(len(index), bool)
    inner[bounds[1:] - 1] = False
    index[inner] = coded.indices.to_numpy(zero_copy_only=False)
    return hashed, index, bounds


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts, the end of each included, and where each begins."""
    hashed, index, bounds = coded_tokens(texts)
    return hashed[index], bounds


def bigram_keys(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each token with its predecessor."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[bounds[:-1]] = END
    with np.errstate(over="ignore"):
        return mix(mix(before, 21) + tokens, 22)


class Filter:
    """A log-frequency Bloom filter in ``2 ** segments`` equal parts."""

    def __init__(self, bits: int, segments: int) -> None:
        self.segments, self.part = segments, max(64, bits >> segments)
        self.data = np.zeros((self.part << segments) // 8, np.uint8)

    def place(self, bucket: np.ndarray, key: np.ndarray, level: int, probe: int) -> np.ndarray:
        inside = mix(key, 1000 * level + probe) % U(self.part)
        return bucket * self.part + inside.astype(np.int64)

    def read(self, keys: np.ndarray) -> np.ndarray:
        """The level of each bigram: 0 if unseen, else 1 + the binary logarithm of its count."""
        return self.levels(*split_key(keys, self.segments))

    def levels(self, bucket: np.ndarray, key: np.ndarray) -> np.ndarray:
        level, alive = np.zeros(len(key), np.int64), np.arange(len(key))
        for step in range(1, MAX_LEVEL + 1):
            for probe in range(PROBES):
                if not len(alive):
                    return level
                at = self.place(bucket[alive], key[alive], step, probe)
                alive = alive[(self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
            if not len(alive):
                break
            level[alive] = step
        return level


def split_key(keys: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment (the highest bits) and the low bits that stand for the bigram in it."""
    bucket = (keys >> U(64 - segments)).astype(np.int64) if segments else np.zeros(
        len(keys), np.int64)
    return bucket, keys & U(2 ** (8 * KEY_BYTES) - 1)


def _segments(spark: SparkSession, tokens: int) -> int:
    """The binary logarithm of the number of filter segments: one task has a few tokens only."""
    return min(24, max(4, (partitions(spark) - 1).bit_length(),
                       (tokens // SEGMENT_TOKENS).bit_length()))


def _pack(key: np.ndarray) -> np.ndarray:
    return key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]


def _unpack(blob: bytes, n: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :KEY_BYTES] = np.frombuffer(blob, np.uint8, n * KEY_BYTES).reshape(n, KEY_BYTES)
    return wide.reshape(-1).view("<u8").astype(U)


def _by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by bucket, and (bucket, from, to) of each run."""
    order = np.argsort(bucket, kind="stable")
    values, first = np.unique(bucket[order], return_index=True)
    ends = [*first[1:], len(bucket)]
    return order, [(int(v), int(f), int(e)) for v, f, e in zip(values, first, ends)]


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)],
        names=["kind", "block", "bucket", "blob"])


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Consecutive rows with one value of ``key``."""
    current, held = None, []
    for batch in batches:
        values = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for start, stop in zip(cuts, cuts[1:]):
            if start == stop:
                continue
            if held and values[start] != current:
                yield current, held
                held = []
            current = values[start]
            held.append(batch.slice(start, stop - start))
    if held:
        yield current, held


def blocked(docs: DataFrame) -> DataFrame:
    """Texts by block, each block within one task and in a row."""
    many = 2 * partitions(docs.sparkSession)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(many))
    return docs.withColumn("block", block)


def _local_counts(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of a block and their counts in its training texts."""
    found, many = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for batch in parts:
        for part in slices(batch, "text", SLICE):
            hashed, index, bounds = coded_tokens(part.column("text"))
            train = np.repeat(~part.column("held_out").to_numpy(zero_copy_only=False),
                              np.diff(bounds))
            found.append(hashed)
            many.append(np.bincount(index, train, len(hashed)))
    found, at = np.unique(np.concatenate(found), return_inverse=True)
    return found, np.bincount(at, np.concatenate(many), len(found)).astype(np.int64)


def count_tokens(docs: DataFrame, buckets: int) -> DataFrame:
    """``(block, blob)``: tokens whose count in all training texts is not the block's own, with it.

    Rows of block -1 hold the number of training tokens and of distinct ones in a bucket.
    """
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in _groups(batches, "block"):
            found, many = _local_counts(parts)
            order, runs = _by_bucket((found >> U(40)).astype(np.int64) % buckets)
            found, many = found[order], many[order]
            yield _blobs([
                (0, int(block), b, found[f:e].tobytes() + many[f:e].tobytes())
                for b, f, e in runs])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, parts in _groups(batches, "bucket"):
            blocks, found, many = [], [], []
            for batch in parts:
                for block, blob in zip(batch.column("block").to_pylist(),
                                       batch.column("blob").to_pylist()):
                    n = len(blob) // 16
                    found.append(np.frombuffer(blob, U, n))
                    many.append(np.frombuffer(blob, np.int64, n, 8 * n))
                    blocks.append(np.full(n, block))
            tokens, own, block = (np.concatenate(x) for x in (found, many, blocks))
            each, at = np.unique(tokens, return_inverse=True)
            sums = np.bincount(at, own, len(each)).astype(np.int64)
            summary = np.array([sums.sum(), (sums > 0).sum()], np.int64)
            changed = np.flatnonzero(sums[at] != own)
            order, runs = _by_bucket(block[changed])
            changed = changed[order]
            yield _blobs([(0, -1, int(bucket), summary.tobytes())] + [
                (0, b, int(bucket), tokens[changed[f:e]].tobytes() + sums[at[changed[f:e]]].tobytes())
                for b, f, e in runs])

    many = partitions(docs.sparkSession)
    dealt = docs.repartition(many, "block").sortWithinPartitions("block").mapInArrow(send, BLOB)
    return staged(dealt.repartition(many, "bucket").sortWithinPartitions("bucket").mapInArrow(
        total, BLOB), "token-counts")


def built_filter(key: np.ndarray, count: np.ndarray) -> Filter:
    """The filter of a segment: of distinct bigrams and how often each occurs."""
    entries = int(np.frexp(count.astype(np.float64))[1].sum())
    own = Filter(-(-BITS_PER_ENTRY * entries // 8) * 8, 0)
    for begin in range(0, own.part, FILTER_BITS):
        used = np.zeros(min(FILTER_BITS, own.part - begin), bool)
        level, left, many = 1, key, count
        while len(left):
            for probe in range(PROBES):
                at = own.place(np.zeros(len(left), np.int64), left, level, probe) - begin
                used[at[(at >= 0) & (at < len(used))]] = True
            more = many >= 2**level
            left, many, level = left[more], many[more], level + 1
        packed = np.packbits(used, bitorder="little")
        own.data[begin // 8:begin // 8 + len(packed)] = packed
    return own


def bigram_levels(docs: DataFrame, segments: int) -> DataFrame:
    """``(kind, block, bucket, blob)``: a byte for each distinct bigram of the block and segment.

    They are in the order of the bigrams' hashes. The filter learns from the texts with ``learned``;
    a task builds and reads one segment at a time.
    """
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in _groups(batches, "block"):
            found, many = [], []
            for batch in held:
                for part in slices(batch, "text", SLICE):
                    tokens, bounds = token_hashes(part.column("text"))
                    learned = np.repeat(part.column("learned").to_numpy(zero_copy_only=False), np.diff(bounds))
                    keys, at = np.unique(bigram_keys(tokens, bounds), return_inverse=True)
                    found.append(keys)
                    many.append(np.bincount(at, learned, len(keys)))
            keys, at = np.unique(np.concatenate(found), return_inverse=True)
            many = np.bincount(at, np.concatenate(many), len(keys)).astype(np.int64)
            bucket, key = split_key(keys, segments)
            _, runs = _by_bucket(bucket)
            packed, short = _pack(key), np.minimum(many, 255).astype(np.uint8)
            yield _blobs([(e - f, int(block), b, packed[f:e].tobytes() + short[f:e].tobytes()
                           + many[f:e][short[f:e] == 255].tobytes()) for b, f, e in runs])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in _groups(batches, "bucket"):
            asked = []
            for batch in held:
                for n, block, blob in zip(*(batch.column(c).to_pylist() for c in ("kind", "block", "blob"))):
                    many = np.frombuffer(blob, np.uint8, n, n * KEY_BYTES).astype(np.int64)
                    many[many == 255] = np.frombuffer(blob, np.int64, -1, n * (KEY_BYTES + 1)) if (
                        len(blob) > n * (KEY_BYTES + 1)) else 0
                    asked.append((block, _unpack(blob, n), many))
            key, at = np.unique(np.concatenate([k[m > 0] for _, k, m in asked]), return_inverse=True)
            own = built_filter(key, np.bincount(
                at, np.concatenate([m[m > 0] for _, _, m in asked]), len(key)).astype(np.int64))
            for block, key, _ in asked:
                level = own.levels(np.zeros(len(key), np.int64), key)
                yield _blobs([(1, block, int(bucket), level.astype(np.uint8).tobytes())])

    many = partitions(docs.sparkSession)
    sent = docs.select("text", "learned", "block").repartition(
        many, "block").sortWithinPartitions("block").mapInArrow(send, BLOB)
    return staged(sent.repartition(max(many, 1 << segments), "bucket").sortWithinPartitions(
        "bucket").mapInArrow(answer, BLOB), "levels")


def _read_block(parts: list[pa.RecordBatch], total: int, known: int):
    """Slices of a block with bounds, counts, unigram probabilities and levels of its tokens."""
    texts = [b.filter(pc.is_null(b.column("blob"))) for b in parts]
    blobs = [x for b in parts for x in zip(b.column("bucket").to_pylist(),
                                           b.column("blob").to_pylist()) if x[1] is not None]
    sent = [blob for bucket, blob in blobs if bucket is None]
    told = b"".join(blob for bucket, blob in sorted(x for x in blobs if x[0] is not None))
    read = [(part, *coded_tokens(part.column("text")))
            for batch in texts for part in slices(batch, "text", SLICE)]
    if not read:
        return
    found, at = np.unique(np.concatenate([hashed for _, hashed, _, _ in read]), return_inverse=True)
    many, starts = np.zeros(len(found), np.int64), np.cumsum([0] + [len(hashed) for _, hashed, _, _ in read])
    for (part, hashed, index, bounds), start in zip(read, starts):
        train = np.repeat(~part.column("held_out").to_numpy(zero_copy_only=False), np.diff(bounds))
        own = np.bincount(index, train, len(hashed)).astype(np.int64)
        np.add.at(many, at[start:start + len(hashed)], own)
    for blob in sent:
        n = len(blob) // 16
        many[np.searchsorted(found, np.frombuffer(blob, U, n))] = np.frombuffer(
            blob, np.int64, n, 8 * n)
    bigrams, place = np.unique(np.concatenate(
        [bigram_keys(hashed[index], bounds) for _, hashed, index, bounds in read]), return_inverse=True)
    levels = np.frombuffer(told, np.uint8, len(bigrams))
    begin = 0
    for (part, hashed, index, bounds), start in zip(read, starts):
        own = slice(begin, begin + len(index))
        counts = many[at[start:start + len(hashed)]][index]
        begin += len(index)
        yield (part, bounds, counts, (counts + 0.5) / (total + 0.5 * (known + 1)),
               levels[place[own]].astype(np.int64))


def _gains(level, bounds, counts, base) -> np.ndarray:
    """Per text, band of the predecessor and weight of the grid: what the bigrams add."""
    before = np.empty_like(counts)
    before[1:] = counts[:-1]
    before[bounds[:-1]] = counts[bounds[1:] - 1]  # the count of ends
    count = np.where(level > 0, 1.5 * 2.0 ** (level - 1) - 0.5, 0.0)
    share = np.minimum(1.0, count / np.maximum(1, before))
    band = np.minimum(BANDS - 1, np.log2(before + 1.0).astype(np.int64) // 2)
    texts = len(bounds) - 1
    cell = np.repeat(np.arange(texts), np.diff(bounds)) * BANDS + band
    seen = np.flatnonzero(share)
    ratio = share[seen] / base[seen]

    def gain(weight: float) -> np.ndarray:
        each = np.repeat(np.log10(np.array([1 - weight])), len(share))  # of an unseen bigram
        each[seen] = np.log10(weight * ratio + (1 - weight))
        return np.bincount(cell, each, texts * BANDS).reshape(texts, BANDS)

    return np.stack([gain(weight) for weight in GRID], axis=2)


def _with_counts(docs: DataFrame, counts: DataFrame, levels: DataFrame) -> DataFrame:
    """Texts and the counts and levels sent to their block, block by block."""
    key = dict(docs.dtypes)["doc_id"]
    sent = counts.where("block >= 0").withColumn("bucket", F.lit(None).cast("int"))
    blobs = sent.union(levels).select(
        F.lit(None).cast(key).alias("doc_id"), F.lit(None).cast("string").alias("text"),
        F.lit(True).alias("held_out"), "block", "bucket", "blob")
    texts = docs.select("doc_id", "text", "held_out", "block", F.lit(None).cast("int").alias("bucket"),
                        F.lit(None).cast("binary").alias("blob"))
    return texts.union(blobs).repartition(
        partitions(docs.sparkSession), "block").sortWithinPartitions("block")


def tuning(doc_id: Column) -> Column:
    """Training texts kept out of the filter; independent of what ``held_out`` goes by."""
    place = F.pmod(F.xxhash64(doc_id.cast("string"), F.lit("tuning")), F.lit(DEV_FOLDS))
    return doc_id.isNotNull() & (place == 1)


def _cell(band: int, weight: int) -> Column:
    return F.get("gains", F.lit(band * len(GRID) + weight)).cast("double")


def fit_weights(scored: DataFrame) -> list[int]:
    """For each band, the place in the grid of the weight with the largest gain on these texts."""
    size = len(GRID)
    sums = scored.agg(*[F.sum(_cell(band, g)).alias(f"g{band}_{g}")
                        for band in range(BANDS) for g in range(size)]).first()
    best = []
    for band in range(BANDS):
        own = [x or 0.0 for x in sums[band * size:(band + 1) * size]]
        best.append(max(range(size), key=lambda g: (own[g], -g)) if any(own)
                    else GRID.index(UNTUNED))
    return best


def scores(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``.

    ``docs`` has ``doc_id``, ``text`` and ``held_out`` (null means False).
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    rows = blocked(docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("held_out", F.lit(False)).alias("held_out")))
    counts = count_tokens(rows, partitions(spark))
    forget_shuffles(spark)  # each step goes on from a written table, and holds its own shuffles alone
    total = known = 0
    for r in counts.where("block = -1").select(
            F.sum(_number("blob", 0)).alias("n"), F.sum(_number("blob", 1)).alias("v")).collect():
        total, known = int(r["n"] or 0), int(r["v"] or 0)
    dev = tuning(F.col("doc_id"))
    levels = bigram_levels(rows.withColumn("learned", ~F.col("held_out") & ~dev), _segments(spark, total))
    forget_shuffles(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _groups(batches, "block"):
            for part, bounds, many, base, level in _read_block(parts, total, known):
                gains = _gains(level, bounds, many, base)
                told = np.concatenate([[0], np.cumsum(many > 0)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"),
                     pa.array(np.diff(bounds)), pa.array(np.diff(told[bounds])),
                     pa.array([float(np.log10(base[f:e]).sum())
                               for f, e in zip(bounds[:-1], bounds[1:])]),
                     pa.array(list(gains.reshape(len(gains), -1).astype(np.float32)),
                              pa.list_(pa.float32()))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "gains"])

    scored = staged(_with_counts(rows, counts, levels).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, "
             "gains array<float>"), "scored")
    best = fit_weights(scored.where(~F.col("held_out") & dev))
    gain = sum((_cell(band, g) for band, g in enumerate(best)), F.lit(0.0))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        "base_score", (F.col("base_score") + gain).alias("score"))


def _number(blob: str, place: int):
    """A little-endian number of a binary column."""
    part = F.substring(F.hex(blob), 16 * place + 1, 16)
    turned = F.regexp_replace(
        part, "(..)(..)(..)(..)(..)(..)(..)(..)", "$8$7$6$5$4$3$2$1")
    return F.conv(turned, 16, 10).cast("long")


def op7_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, learned from those that are not held out."""
    return scores(table(spark, sf_dir, "documents").select(
        "doc_id", "text", held_out(F.col("doc_id"), FOLDS).alias("held_out")))
