"""Whitening of embeddings by the covariance of their distinct vectors.

Vectors become whole numbers (floors of 256 times each entry). Identical ones are one group with
its multiplicity; a group enters the fit with weight one or with its multiplicity. Counts, sums and
the centred products are added up per partition and then per cell, so that only one matrix of
``d x d`` numbers reaches the driver. Each distinct vector is whitened once and joined back.

Rows whose vector is null, or holds a null, a NaN or an infinity, are left out. Vectors of
different lengths are different spaces, fitted one by one. An empty vector has no components and
gives no rows; of ``d < components`` dimensions there are ``d`` components. A component without
variance (fewer distinct vectors than dimensions) has a null ``whitened`` and is left out of the identity
error, which is null if none is left. ``deviation`` is null where the exact number is beyond a long, and
entries beyond a long saturate. Null and repeated ids stay as they are, each row for itself; an empty table
gives no rows; other columns of the table are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm.common import Workspace, join_counted, table

STEP = 256
#: integers below this stay exact through one more addition
EXACT = 2**62
#: eigenvalues of less than this share of the trace are rounding, not variance
FLAT = 1e-12
SCHEMA = ("component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


@dataclass(frozen=True)
class Fit:
    """Weight, exact sums and the leading components of one space."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def varied(self) -> np.ndarray:
        return self.values > FLAT * self.trace


def whole_vectors(vector: Column, step: int = STEP) -> Column:
    """``floor(step * entry)`` of each entry as longs; null for a vector that is not finite."""
    usable = F.forall(vector, lambda c: F.coalesce(
        ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    return F.when(usable, F.transform(
        vector, lambda c: F.floor(c.cast("double") * F.lit(float(step))).cast("long")))


def matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def exact_centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums`` exactly: longs where they hold it, else Python's integers."""
    top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if top * n + max(map(abs, sums), default=0) < EXACT:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def squared_lengths(centred: np.ndarray) -> list[int | None]:
    """Exact sums of squares of each row; None beyond a long."""
    if centred.dtype != object:
        top = max(abs(int(centred.max(initial=0))), abs(int(centred.min(initial=0))))
        if top * top * centred.shape[1] < EXACT:
            return (centred * centred).sum(axis=1).tolist()
    exact = (centred.astype(object) ** 2).sum(axis=1).tolist()
    return [int(s) if s < 2**63 else None for s in exact]


def _sums(groups: DataFrame, weight: Column) -> tuple[int, list[int]]:
    """The weight of all groups and the exact weighted sum of each dimension."""
    def run(batches):
        n, total = 0, 0
        for batch in batches:
            if batch.num_rows:
                x, w = matrix(batch.column("x")).astype(object), batch.column("w").to_numpy()
                n, total = n + int(w.sum()), total + (x * w.astype(object)[:, None]).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({
                "place": pa.array(range(-1, len(total)), pa.int32()),
                "s": pa.array([str(v) for v in (n, *total)])})

    cells = (
        groups.select("x", weight.alias("w")).mapInArrow(run, "place int, s string")
        .groupBy("place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        .orderBy("place").collect())
    return int(cells[0]["s"]), [int(r["s"]) for r in cells[1:]]


def _covariance(groups: DataFrame, weight: Column, n: int, sums: list[int]) -> np.ndarray:
    """The weighted covariance with divisor ``n``, centred before it is multiplied."""
    d = len(sums)
    upper = np.triu_indices(d)

    def run(batches):
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                away = exact_centred(matrix(batch.column("x")), n, sums).astype(float) / n
                total += (away * batch.column("w").to_numpy()[:, None]).T @ away
        yield pa.RecordBatch.from_pydict({
            "cell": np.arange(len(upper[0])), "s": total[upper]})

    cells = (
        groups.select("x", weight.alias("w")).mapInArrow(run, "cell long, s double")
        .groupBy("cell").agg(F.sum("s").alias("s")).toPandas().sort_values("cell"))
    out = np.zeros((d, d))
    out[upper] = cells["s"].to_numpy() / n
    return out + np.triu(out, 1).T


def fit(groups: DataFrame, weight: Column, components: int) -> Fit:
    """Fit one space to ``groups(x, multiplicity)``, whose vectors have one length."""
    n, sums = _sums(groups, weight)
    v = _covariance(groups, weight, n, sums)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    vectors = vectors[:, order]
    # either sign is right; the largest entry is made positive so that runs agree
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return Fit(n, sums, np.maximum(values[order], 0.0), vectors * signs, float(np.trace(v)))


def _whitened(groups: DataFrame, fitted: Fit) -> DataFrame:
    """Each group with its whitened entries and its exact deviation."""
    keep = fitted.varied
    scale = fitted.vectors[:, keep] / np.sqrt(fitted.values[keep])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                centred = exact_centred(matrix(batch.column("x")), fitted.n, fitted.sums)
                y = (centred.astype(float) / fitted.n) @ scale
                offsets = pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("x"), batch.column("multiplicity"),
                     pa.ListArray.from_arrays(offsets, pa.array(y.ravel())),
                     pa.array(squared_lengths(centred), pa.int64())],
                    ["x", "multiplicity", "y", "deviation"])

    return groups.mapInArrow(
        run, "x array<long>, multiplicity long, y array<double>, deviation long")


def identity_error(whitened: DataFrame, weight: Column, n: int, size: int) -> float | None:
    """The largest entry by which the covariance of the fit list differs from the identity."""
    if not size:
        return None
    at = [F.get("y", F.lit(i)) for i in range(size)]
    means = whitened.agg(*[F.sum(weight * c) / n for c in at]).first()
    away = [c - F.lit(float(m)) for c, m in zip(at, means)]
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    found = whitened.agg(*[F.sum(weight * away[i] * away[j]) / n for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs))


def whiten(
    rows: DataFrame, key: str, vector: str, components: int = 4, weights: str = "one",
) -> DataFrame:
    """One row per usable row and component, see the module; ``weights`` is ``one`` or ``count``."""
    if weights not in ("one", "count"):
        raise ValueError(f"unknown weights {weights}")
    spark = rows.sparkSession
    work = Workspace(spark)
    weight = F.lit(1).cast("long") if weights == "one" else F.col("multiplicity")
    usable = rows.select(F.col(key).alias("_key"), whole_vectors(F.col(vector)).alias("x")).where(
        F.size("x") > 0)
    groups = work.staged(
        usable.groupBy("x").agg(F.count(F.lit(1)).alias("multiplicity")), "vectors")
    spaces = groups.groupBy(F.size("x").alias("d")).agg(
        F.sum("multiplicity").alias("rows")).orderBy("d").collect()
    out = spark.createDataFrame([], f"_key {dict(usable.dtypes)['_key']}, {SCHEMA}")
    for d, many in spaces:
        here = F.size("x") == d
        fitted = fit(groups.where(here), weight, components)
        whitened = Workspace(spark).staged(_whitened(groups.where(here), fitted), "whitened")
        error = identity_error(whitened, weight, fitted.n, int(fitted.varied.sum()))
        shares = [float(e / fitted.trace) if fitted.trace else 0.0 for e in fitted.values]
        joined = join_counted(
            usable.where(here), whitened, ["x"], "multiplicity", many, ["_key"])
        out = out.union(joined.select(
            "_key", F.lit(fitted.n).cast("long").alias("n"), "deviation", "y",
            F.posexplode(F.lit(shares)).alias("_at", "explained")).select(
            "_key", (F.col("_at") + 1).alias("component"), "n", "deviation",
            F.get("y", F.col("_at")).alias("whitened"), "explained",
            F.lit(error).cast("double").alias("identity_error")))
    work.clear()
    return out.withColumnRenamed("_key", key)


def op13_weighted_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of all embeddings; each distinct vector counts once."""
    return whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
