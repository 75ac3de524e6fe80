"""Joins against dictionaries and per-key statistics, and the dense grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 256 * 2**20


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a dictionary table for broadcast if its row count proves to be small.

    Beyond ``rows`` the table is returned unmarked and the join shuffles.
    """
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def spread_join(
    big: DataFrame,
    stats: DataFrame,
    on: Sequence[str],
    salt_by: Sequence[str],
    how: str = "inner",
    salts: int = 8,
) -> DataFrame:
    """Join rows to a table with one row per key when a key may hold many rows.

    The rows of a key are spread over ``salts`` shuffle keys by a hash of
    ``salt_by`` (their own id, so a retried task repeats it) and each stats row is
    copied to every salt. ``stats`` is an aggregate, hence the smaller side. A NULL key
    is a key like any other.
    """
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    values = [c for c in stats.columns if c not in on]
    copies = stats.select(
        *[F.col(k).alias(f"_on_{k}") for k in on], *values,
        F.explode(F.array(*[F.lit(i) for i in range(salts)])).alias("_on_salt"))
    match = F.col("_salt") == F.col("_on_salt")
    for k in on:
        match = match & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
    return salted.join(copies, match, how).select(*big.columns, *values)


def expand_aliases(df: DataFrame, column: str, aliases: DataFrame, out: str = "model_id") -> DataFrame:
    """One row per comma-separated name, replaced by its id in ``aliases(alias, id)``."""
    names = df.withColumn("_name", F.explode(F.split(column, ","))).withColumn(
        "_name", strip(F.col("_name"))
    )
    lookup = aliases.select(F.col("alias").alias("_alias"), F.col("id").alias("_id"))
    return (
        names.join(small(lookup), F.lower("_name") == F.col("_alias"), "left")
        .withColumn(out, F.coalesce("_id", "_name"))
        .drop("_name", "_alias", "_id")
    )


def expand_names(df: DataFrame, column: str, out: str = "name") -> DataFrame:
    """One row per comma-separated name, trimmed, blanks dropped."""
    return df.withColumn(out, F.explode(F.split(column, ","))).withColumn(
        out, strip(F.col(out))
    ).where(F.length(out) > 0)


def strip(column: Column) -> Column:
    """Trim every kind of white space, separators U+001C to U+001F included."""
    return F.regexp_replace(column, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def with_family(
    df: DataFrame, families: DataFrame, lang: str = "lang", out: str = "family",
    default: str = "Other",
) -> DataFrame:
    """Add the family of a language from ``families(lang, family)``."""
    lookup = families.select(F.col("lang").alias("_lang"), F.col("family").alias("_family"))
    return (
        df.join(small(lookup), F.col(lang) == F.col("_lang"), "left")
        .withColumn(out, F.coalesce("_family", F.lit(default)))
        .drop("_lang", "_family")
    )


def lookup_vectors(
    tokens: DataFrame, table: DataFrame, dim: int, key: str = "doc_id", ids: str = "tokens",
) -> DataFrame:
    """Explode token ids to ``(key, pos, token_id, vector)`` through ``table(id, vector)``
    with vectors of ``dim`` numbers.

    An id that the table lacks is an error, as a mean over the others would be wrong.
    """
    exploded = tokens.select(key, F.posexplode(ids).alias("pos", "token_id"))
    return with_vectors(exploded, table, dim, [key, "pos"])


def with_vectors(
    rows: DataFrame, table: DataFrame, dim: int, salt_by: Sequence[str],
) -> DataFrame:
    """Add ``vector`` of ``token_id``; fails on an id that ``table(id, vector)`` lacks.

    A table whose counted rows pass the broadcast bound in bytes is joined with salted
    keys, since frequent tokens are hot keys by nature.
    """
    vectors = table.select(F.col("id").alias("token_id"), "vector", F.lit(True).alias("_known"))
    fitting = BROADCAST_BYTES // (8 * dim)
    if vectors.limit(fitting + 1).count() <= fitting:
        found = rows.join(F.broadcast(vectors), "token_id", "left")
    else:
        found = spread_join(rows, vectors, ["token_id"], salt_by, "left")
    known = F.coalesce("_known", F.raise_error(F.concat(
        F.lit("no vector for token id "), F.col("token_id").cast("string"))).cast("boolean"))
    return found.where(known).drop("_known")


def join_gold(pred: DataFrame, gold: DataFrame, key: Sequence[str] | str) -> DataFrame:
    """Match predictions to gold answers by item id."""
    return pred.join(gold, key)


def axis(df: DataFrame, column: str, limit: int = 10_000) -> list:
    """Distinct values in order, for a chart or grid axis; refuses unbounded columns."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} distinct values, not an axis")
    return sorted(r[0] for r in rows)


def dense_grid(
    df: DataFrame, row: str, column: str, value: str, nan: bool = False,
) -> DataFrame:
    """Every row label against every column label; a missing cell is NULL (or NaN).

    ``df`` holds one value per cell; a cell without a column label has no place in the grid,
    though its row has. The column axis is checked to be small and laid
    out by ``explode`` of a literal, one shuffle on the row label, no cross join.
    """
    labels = axis(df, column)
    cells = df.groupBy(row).agg(
        F.map_from_entries(F.collect_list(
            F.when(F.col(column).isNotNull(), F.struct(column, value)))).alias("_cells")
    )
    out = cells.select(
        row, F.explode(F.array(*[F.lit(v) for v in labels])).alias(column), "_cells"
    ).select(row, column, F.try_element_at("_cells", F.col(column)).alias(value))
    if nan:
        out = out.withColumn(value, F.coalesce(value, F.lit(float("nan"))))
    return out


def wide_grid(
    df: DataFrame, row: str, column: str, value: str, labels: Sequence | None = None,
) -> DataFrame:
    """The same grid with one column per label."""
    return df.groupBy(row).pivot(column, labels or axis(df, column)).agg(F.first(value))
