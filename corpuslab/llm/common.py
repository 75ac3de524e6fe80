"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslab.session import scratch_path

#: the white space of ASCII parts words; everything else belongs to a word
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, folds: int) -> Column:
    """Rows that training must not see: crc32 of the id as text, modulo ``folds``, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 1, F.lit(False))


def words(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


class Workspace:
    """Written tables of one job, deleted together when nothing reads them any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table to the shared folder and go on from the files."""
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.parquet(path)

    def clear(self) -> None:
        """Delete all tables, by the file system that holds them."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
        self.paths = []


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now.

    It does so when the driver's JVM has collected their plans, which may be half an hour
    later by default; a job with a large shuffle that goes on from a written table need not hold
    the disk for that long.
    """
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def first_by_hash(rows: DataFrame, label: str, keys: list[str], many: int) -> DataFrame:
    """At most ``many`` distinct rows ``(*keys, label)`` of each label, those first by a hash of the keys.

    Rows far down the order are left out before any is shuffled, so that a label with most
    of the rows is no hot key. How far is told by the number of distinct places, not of rows: repeated
    rows share a place, and a label whose rows are all alike keeps it. Labels are few; they are counted on
    the way.
    """
    placed = rows.select(*keys, label, F.xxhash64(*[F.col(k).cast("string") for k in keys]).alias("_place"))
    counts = placed.groupBy(label).agg(F.approx_count_distinct("_place").alias("n")).collect()
    upper = F.lit(None).cast("long")
    for label_value, n in counts:
        share = min(1.0, (2 * many + 50) / max(1, n))
        upper = F.when(F.col(label) == F.lit(label_value),
                       F.lit(-(2**63) + int(2**64 * share) - 1)).otherwise(upper)
    near = placed.where(F.col("_place") <= upper).distinct()
    order = Window.partitionBy(label).orderBy("_place", *keys)
    return near.withColumn("_nth", F.row_number().over(order)).where(
        F.col("_nth") <= many).select(*keys, label)


def join_counted(
    rows: DataFrame, counted: DataFrame, on: list[str], count: str, total: int, spread: list[str],
) -> DataFrame:
    """Inner join of ``rows`` with ``counted``, whose keys ``on`` are unique and not null.

    ``counted[count]`` says how many of the ``total`` rows have a key. A key with more than a
    quarter of a partition's share is split: its rows go by a hash of ``spread`` to so many parts
    that each is within that share, and its one partner is copied to each part. There are at most
    four such keys for each partition, which bounds what is broadcast to mark their rows.
    """
    share = max(1, total // (4 * partitions(rows.sparkSession)))
    parts = F.ceil(F.col(count) / F.lit(share)).cast("int")
    hot = counted.where(F.col(count) > share).select(*on, parts.alias("_parts"))
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("_part", F.coalesce(
        F.pmod(F.xxhash64(*spread), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    copied = counted.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(
        parts, F.lit(1)) - 1)))
    return dealt.join(copied, [*on, "_part"]).drop("_part")
