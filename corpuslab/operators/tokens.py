"""The token stream: global offsets, the train/validation cut, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.arrays import xy_pair
from corpuslab.operators.dist import drawn_bits
from corpuslab.operators.lookup import small
from corpuslab.operators.prefix import running
from corpuslab.session import staged


def token_total(df: DataFrame, ids: str = "tokens", size: str | None = None) -> int:
    """The number of tokens; if ``size`` names a column with that of each row, no token is read."""
    many = F.size(ids).cast("long") if size is None else F.col(size)
    return df.agg(F.coalesce(F.sum(many), F.lit(0))).first()[0]


def token_counts(df: DataFrame, ids: str = "tokens", key: str = "split") -> DataFrame:
    return df.groupBy(key).agg(F.sum(F.size(ids).cast("long")).alias("tokens"))


def with_offsets(
    df: DataFrame, order: str = "doc_id", ids: str = "tokens", size: str | None = None,
) -> DataFrame:
    """Add ``start``, the position of a document's first token in the whole stream.

    Only ids and sizes are ranged and checkpointed; tokens cross the wire once, in
    the join on the unique document id, where the starts are hashed and no token is sorted.
    Pass a written table: it is read twice, the first time without tokens if ``size`` names
    a column with their number, which is left out of the result.
    """
    many = F.size(ids).cast("long") if size is None else F.col(size)
    return (df if size is None else df.drop(size)).join(_starts(df, order, many).hint("shuffle_hash"), order)


def _starts(df: DataFrame, order: str, size: Column) -> DataFrame:
    sizes = df.select(order, size.alias("_size"))
    return running(sizes, [order], {"_end": (F.col("_size"), "sum")}).select(
        order, (F.col("_end") - F.col("_size")).alias("start"))


def token_stream(
    encoded: DataFrame, order: str = "doc_id", ids: str = "tokens", size: str | None = None,
) -> DataFrame:
    """Encode once: write the tokens, then place them in the stream.

    They cross the wire in the narrowest type that holds the ids, of which :func:`windows_at` makes
    integers again. ``size`` names a column for their number, by which :func:`token_total` reads no token.
    """
    many = "_tokens" if size is None else size
    tokens = staged(encoded.select(order, ids, F.size(ids).cast("long").alias(many)), "tokens")
    placed = narrowed(tokens, ids).join(_starts(tokens, order, F.col(many)).hint("shuffle_hash"), order)
    return placed.drop(many) if size is None else placed


def narrowed(tokens: DataFrame, ids: str) -> DataFrame:
    """Lists of integers in the narrowest type that holds all of a written table."""
    if tokens.schema[ids].dataType.simpleString() != "array<int>":
        return tokens
    low, high = tokens.agg(F.min(F.array_min(ids)), F.max(F.array_max(ids))).first()
    for kind, most in (("tinyint", 2**7), ("smallint", 2**15)):
        if low is not None and -most <= low and high < most:
            return tokens.withColumn(ids, F.col(ids).cast(f"array<{kind}>"))
    return tokens


def split_tokens(
    df: DataFrame, order: str = "doc_id", frac: float = 0.9, ids: str = "tokens",
) -> DataFrame:
    """Rows ``(order, split, start, tokens)``: the first ``int(frac * N)`` tokens of the
    stream are ``train``, the rest ``val``; a document across the cut becomes two rows.
    ``start`` counts within the split."""
    tokens = staged(df.select(
        order, F.col(ids).alias("tokens"), F.size(ids).cast("long").alias("_tokens")), "tokens")
    total = tokens.agg(F.coalesce(F.sum("_tokens"), F.lit(0))).first()[0]
    cut = int(total * frac)
    placed = with_offsets(tokens, order, size="_tokens")
    inside = F.greatest(
        F.lit(0), F.least(F.lit(cut) - F.col("start"), F.size("tokens").cast("long"))
    ).cast("int")
    halves = F.array(
        F.struct(F.lit("train").alias("split"), F.col("start"),
                 F.when(inside == F.size("tokens"), F.col("tokens")).otherwise(
                     F.slice("tokens", F.lit(1), inside)).alias("tokens")),
        F.struct(F.lit("val").alias("split"),
                 (F.col("start") + inside - F.lit(cut)).alias("start"),
                 F.when(inside == 0, F.col("tokens")).otherwise(
                     F.slice("tokens", inside + 1, F.size("tokens"))).alias("tokens")),
    )
    return placed.select(order, F.explode(halves).alias("h")).select(order, "h.*").where(
        F.size("tokens") > 0)


def blocks_of(
    stream: DataFrame, size: int, start: str = "start", ids: str = "tokens",
    only: DataFrame | None = None,
) -> DataFrame:
    """Re-cut a token stream into ``(block, lo, cell)``: positions ``lo`` on, in blocks of
    ``size`` positions, whatever the documents' lengths. A block holds at most ``size``
    tokens, so its collected pieces are bounded. With ``only(block)`` the other blocks are
    left out before anything is shuffled or collected."""
    first = F.expr(f"{start} div {size}")
    last = F.expr(f"({start} + size({ids}) - 1) div {size}")
    parts = stream.where(F.size(ids) > 0).select(
        start, ids, F.explode(F.sequence(first, last)).alias("block"))
    if only is not None:
        parts = parts.join(only, "block", "left_semi")
    return (
        parts.withColumn("lo", F.greatest(F.col(start), F.col("block") * size))
        .select(
            "block", "lo",
            F.slice(ids, (F.col("lo") - F.col(start) + 1).cast("int"), F.least(
                F.size(ids).cast("long"), (F.col("block") + 1) * size - F.col("lo")
            ).cast("int")).alias("piece"),
        )
        .groupBy("block").agg(F.sort_array(F.collect_list(F.struct("lo", "piece"))).alias("p"))
        .select("block", F.get("p", F.lit(0))["lo"].alias("lo"),
                F.flatten(F.transform("p", lambda s: s["piece"])).alias("cell"))
    )


def windows_at(
    stream: DataFrame, offsets: DataFrame, length: int, offset: str = "offset",
    start: str = "start", ids: str = "tokens",
) -> DataFrame:
    """``window`` = the ``length`` tokens from each offset of ``offsets``.

    A range lookup as an equi-join: stream and windows are cut at multiples of one
    block size and meet on the block number, one row per block. Offsets drawn more than
    once are looked up once, so a block meets at most its own size of windows.
    """
    size = max(length, 1024)
    wanted = offsets.select(F.col(offset).alias("_at")).distinct().withColumn(
        "block",
        F.explode(F.sequence(F.expr(f"_at div {size}"), F.expr(f"(_at + {length - 1}) div {size}"))),
    )
    cells = blocks_of(stream, size, start, ids, only=small(wanted.select("block").distinct()))
    skip = F.greatest(F.col("_at") - F.col("lo"), F.lit(0))
    end = F.least(F.col("_at") + length - F.col("lo"), F.size("cell").cast("long"))
    found = (
        wanted.join(cells, "block")
        .withColumn("_skip", skip).withColumn("_len", end - skip)
        .where(F.col("_len") > 0)
        .select("_at", (F.col("lo") + F.col("_skip")).alias("lo"), F.slice(
            "cell", (F.col("_skip") + 1).cast("int"), F.col("_len").cast("int")).alias("piece"))
    )
    # a window is at most `length` tokens, so the collected list is bounded
    windows = found.groupBy("_at").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("lo", "piece"))),
                              lambda s: s["piece"])).alias("window")
    )
    if stream.schema[ids].dataType.simpleString() in ("array<tinyint>", "array<smallint>"):
        windows = windows.withColumn("window", F.col("window").cast("array<int>"))
    return offsets.join(windows, offsets[offset] == windows["_at"]).drop("_at")


def sample_offsets(spark, n: int, total: int, length: int, seed: int) -> DataFrame:
    """``n`` start positions with replacement, the same on every retry."""
    if total <= length:
        raise ValueError("the stream must be longer than a window")
    return spark.range(n).select(
        F.col("id").alias("sample"),
        (drawn_bits(seed, "id") % F.lit(total - length)).alias("offset"),
    )


def sample_windows(
    stream: DataFrame, n: int, block: int, seed: int, total: int | None = None,
    start: str = "start", ids: str = "tokens",
) -> DataFrame:
    """``n`` training examples ``(sample, offset, x, y)`` of ``block`` tokens."""
    total = token_total(stream, ids) if total is None else total
    offsets = sample_offsets(stream.sparkSession, n, total, block, seed)
    windows = windows_at(stream, offsets, block + 1, start=start, ids=ids)
    return windows.withColumn("_xy", xy_pair(F.col("window"), block)).select(
        "sample", "offset", "_xy.x", "_xy.y")


def add_specials(
    ids: Column, pair: Column | None, template: str, cls: int, sep: int,
) -> Column:
    """Struct of ids and type ids. ``bert``: CLS A SEP (B SEP), types 0/1.
    ``xlnet``: A SEP (B SEP) CLS, types 0/1 and 2 for CLS."""
    def typed(arr: Column, kind: int) -> Column:
        return F.array_repeat(F.lit(kind), F.size(arr))

    c, s = F.array(F.lit(cls)), F.array(F.lit(sep))
    out, types = [ids, s], [typed(ids, 0), F.array(F.lit(0))]
    if pair is not None:
        out += [pair, s]
        types += [typed(pair, 1), F.array(F.lit(1))]
    if template == "bert":
        out, types = [c, *out], [F.array(F.lit(0)), *types]
    elif template == "xlnet":
        out, types = [*out, c], [*types, F.array(F.lit(2))]
    else:
        raise ValueError(f"unknown template {template}")
    return F.struct(F.concat(*out).alias("ids"), F.concat(*types).alias("types"))
