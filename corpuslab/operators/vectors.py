"""Pooling and pair evaluation of vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from corpuslab.functions.arrays import cosine, finite, keep_first, l2_normalize
from corpuslab.operators.encode import in_slices
from corpuslab.operators.lookup import BROADCAST_BYTES, spread_join, with_vectors
from corpuslab.operators.prefix import running
from corpuslab.session import staged


def mean_pool(
    df: DataFrame, key: Sequence[str], vec: str, dim: int, mask: str | None = None,
    out: str = "vector",
) -> DataFrame:
    """Mean vector per key over the rows whose mask is 1; zeros when there are none.

    The vector mean is one aggregate with a partial step, so the dimensions are never
    exploded into rows and a long key is summed where its rows lie.
    """
    vector = F.col(vec)
    if isinstance(df.schema[vec].dataType, ArrayType):
        vector = array_to_vector(vector.cast("array<double>"))
    kept = F.lit(True) if mask is None else F.coalesce(F.col(mask) > 0, F.lit(False))
    if mask is not None:
        zeros = array_to_vector(F.array_repeat(F.lit(0.0), dim))
        vector = F.when(kept, vector).otherwise(zeros)
    rows = df.select(*key, vector.alias("_v"), kept.cast("double").alias("_n"))
    pooled = rows.groupBy(*key).agg(
        Summarizer.sum(F.col("_v"), F.lit(1.0)).alias("_s"), F.sum("_n").alias("_n"))
    return pooled.select(
        *key,
        F.when(F.col("_n") > 0, F.zip_with(
            vector_to_array("_s"), F.array_repeat(F.col("_n"), dim), lambda s, n: s / n
        )).otherwise(F.array_repeat(F.lit(0.0), dim)).alias(out),
    )


def embed(
    encoded: DataFrame, table: DataFrame, dim: int, key: str = "doc_id", ids: str = "tokens",
    max_length: int | None = None,
) -> DataFrame:
    """Document vectors from token ids: clip if asked, look up, pool, normalise, clean.

    The vectors of the ids that occur go to the workers, up to the broadcast bound; a document is summed
    where it lies, and only its sum crosses the wire, to meet those of other rows with its key. Beyond the
    bound the tokens are counted and joined with their vectors. A document without tokens gets the
    zero vector, as does one without a key.
    """
    tokens = F.col(ids) if max_length is None else keep_first(F.col(ids), max_length)
    clipped = encoded.select(key, tokens.alias(ids))
    used = clipped.select(F.explode(F.array_distinct(ids)).alias("id")).distinct()
    vectors = staged(table.select("id", "vector").join(used, "id"), "vectors")
    fitting = BROADCAST_BYTES // (8 * dim)
    if vectors.limit(fitting + 1).count() <= fitting:
        summed = _summed(clipped, vectors, dim, key)
    else:
        counted = clipped.select(key, F.explode(ids).alias("token_id")).groupBy(key, "token_id").agg(
            F.count(F.lit(1)).cast("double").alias("_n"))
        met = with_vectors(counted, vectors, dim, [key]).select(key, F.transform(
            "vector", lambda x: x.cast("double") * F.col("_n")).alias("_s"), "_n", F.lit(0).alias("_rows"))
        summed = met.unionByName(clipped.select(key, F.array_repeat(F.lit(0.0), dim).alias("_s"), F.lit(0.0).alias(
            "_n"), F.lit(1).alias("_rows")))
    pooled = summed.groupBy(key).agg(
        Summarizer.sum(array_to_vector("_s"), F.lit(1.0)).alias("_s"), F.sum("_n").alias("_n"),
        F.sum("_rows").cast("int").alias("_rows"))
    mean = F.when((F.col("_n") > 0) & F.col(key).isNotNull(), F.transform(
        vector_to_array("_s"), lambda s: s / F.col("_n"))).otherwise(F.array_repeat(F.lit(0.0), dim))
    return pooled.select(key, finite(l2_normalize(mean)).alias("vector"), F.explode(
        F.array_repeat(F.lit(True), F.col("_rows"))).alias("_row")).drop("_row")


def _summed(clipped: DataFrame, vectors: DataFrame, dim: int, key: str) -> DataFrame:
    """``(key, _s, _n, _rows)``: the sum and number of the vectors of each row's ids."""
    held = vectors.select("id", F.col("vector").cast("array<double>")).toArrow()
    every = held.column("vector").combine_chunks()
    if len(every.flatten()) != dim * len(every):
        raise ValueError(f"a vector has not {dim} numbers")
    known, at = np.unique(held.column("id").to_numpy(), return_inverse=True)
    sums = np.zeros((len(known), dim))
    np.add.at(sums, at, every.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
    sent = clipped.sparkSession.sparkContext.broadcast((known, sums, np.bincount(at, minlength=len(known))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums, times = sent.value
        for batch in in_slices(batches, pc.list_value_length):
            rows = batch.num_rows
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            place = np.searchsorted(known, flat)
            lost = known[np.minimum(place, len(known) - 1)] != flat if len(known) else np.ones(len(flat), bool)
            if lost.any():
                raise ValueError(f"no vector for token id {flat[lost][0]}")
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            cell, many = np.unique(
                np.repeat(np.arange(rows), sizes) * max(1, len(known)) + place, return_counts=True)
            row, place = np.divmod(cell, max(1, len(known)))
            total = np.stack([np.bincount(row, many * sums[place, i], rows) for i in range(dim)], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(
                    pa.array(np.arange(rows + 1) * dim, pa.int32()), pa.array(total.ravel().astype(float))),
                 pa.array(np.bincount(row, many * times[place], rows).astype(float)),
                 pa.array(np.ones(rows, np.int32))], names=[key, "_s", "_n", "_rows"])

    kind = clipped.schema[key].dataType.simpleString()
    return clipped.mapInArrow(run, f"`{key}` {kind}, _s array<double>, _n double, _rows int")


def score_pairs(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return pairs.withColumn("score", cosine(F.col(a), F.col(b))).drop(a, b)


def pair_eval(
    scored: DataFrame, keys: Sequence[str], gold: str = "gold", score: str = "score",
) -> DataFrame:
    """Per key: pairs, positives, average precision and the accuracy at the best threshold.

    Pairs with equal scores are summed before they are ranked, so the running sums
    see distinct scores. A threshold lies between two distinct scores. The sums are
    written once, since scoring the pairs again would cost more.
    """
    keys = list(keys)
    cells = staged(scored.groupBy(*keys, score).agg(
        F.sum(F.col(gold).cast("long")).alias("_pos"), F.count(F.lit(1)).alias("_all")), "pairs")
    ranked = running(cells, [F.col(score).desc()], {
        "_tp": (F.col("_pos"), "sum"), "_seen": (F.col("_all"), "sum")}, keys)
    totals = cells.groupBy(*keys).agg(
        F.sum("_pos").alias("positives"), F.sum("_all").alias("n"))
    joined = spread_join(ranked, totals, keys, [score])
    # predicted positive above the threshold; right: those positives, and negatives below
    right = F.col("_tp") + (F.col("n") - F.col("positives")) - (F.col("_seen") - F.col("_tp"))
    return joined.groupBy(*keys, "positives", "n").agg(
        F.coalesce(F.try_divide(
            F.sum(F.col("_pos") * (F.col("_tp") / F.col("_seen"))), F.first("positives")
        ), F.lit(0.0)).alias("ap"),
        (F.greatest(F.max(right), F.first("n") - F.first("positives")) / F.first("n")).alias("best_accuracy"),
    )


def _ranks(cells: DataFrame, keys: list[str], val: str, out: str) -> DataFrame:
    """Average rank of each distinct value; the middle of its run of equal values."""
    values = cells.groupBy(*keys, val).agg(F.sum("_n").alias("_m"))
    return running(values, [val], {"_end": (F.col("_m"), "sum")}, keys).select(
        *keys, val, (F.col("_end") - (F.col("_m") - 1) / 2).alias(out))


def sts_eval(
    scored: DataFrame, keys: Sequence[str], gold: str = "gold", score: str = "score",
) -> DataFrame:
    """Spearman correlation of score and gold per key, ties at their average rank.

    Equal (score, gold) rows are counted before anything is shuffled by value. The rank
    tables may be as long as the rows, so they are not copied per salt; adaptive
    execution splits a value that many rows share.
    """
    keys = list(keys)
    cells = staged(
        scored.groupBy(*keys, score, gold).agg(F.count(F.lit(1)).alias("_n")), "pairs")
    ranked = spread_join(cells, _ranks(cells, keys, score, "_rx"), [*keys, score], [gold], salts=1)
    ranked = spread_join(ranked, _ranks(cells, keys, gold, "_ry"), [*keys, gold], [score], salts=1)
    n, x, y = F.col("_n"), F.col("_rx"), F.col("_ry")
    means = ranked.groupBy(*keys).agg(
        F.sum("_n").alias("n"), (F.sum(n * x) / F.sum(n)).alias("_mx"))
    # both rankings have the mean (n + 1) / 2
    centred = spread_join(ranked, means, keys, [score, gold])
    dx, dy = x - F.col("_mx"), y - F.col("_mx")
    return centred.groupBy(*keys, "n").agg(
        F.try_divide(
            F.sum(F.col("_n") * dx * dy),
            F.sqrt(F.sum(F.col("_n") * dx * dx)) * F.sqrt(F.sum(F.col("_n") * dy * dy)),
        ).alias("spearman"))
