"""Rows dealt to parts in ranges: sizes differ by one at most, and the first parts have the larger ones."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coomat.session import settled


def row_range(rows: int, part: int, parts: int) -> tuple[int, int]:
    """The half-open range of one part."""
    if parts < 1 or not 0 <= part < parts or rows < 0:
        raise ValueError("no such part")
    base, more = divmod(rows, parts)
    start = part * base + min(part, more)
    return start, start + base + (part < more)


def part_of(row: Column, rows: int, parts: int) -> Column:
    """The part of a row number, in closed form: no window, so no shuffle."""
    base, more = divmod(rows, parts)
    large = more * (base + 1)
    in_large = F.floor(row / F.lit(base + 1))
    return F.when(row < large, in_large).otherwise(more + F.floor((row - large) / F.lit(max(1, base)))).cast("int")


def with_part(df: DataFrame, rows: int, parts: int, column: str = "i") -> DataFrame:
    return df.withColumn("part", part_of(F.col(column), rows, parts))


def part_table(spark: SparkSession, rows: int, parts: int) -> DataFrame:
    """(part, start_row, end_row)."""
    base, more = divmod(rows, parts)
    at = lambda k: k * base + F.least(k, F.lit(more))
    part = F.col("id")
    return spark.range(parts).select(part.cast("int").alias("part"), at(part).alias("start_row"), at(part + 1).alias("end_row"))


def scattered(df: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """Rows dealt by their keys once, in order, and kept in the executors: joins and sums by these keys move them no more.

    The number of parts is given, so adaptive execution leaves it, and the rows are in place when this returns: only then
    later plans know where they lie.  ``unpersist`` lets them go.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartition(parts, *keys).sortWithinPartitions(*keys).persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    return out


def with_positions(df: DataFrame, *keys: str, into: str = "pos") -> DataFrame:
    """df + the place of each row in the order of its keys, from 0.

    Rows are dealt by ranges of their keys and numbered where they lie; the table of first places has a row for each part.
    Keys must tell rows apart: then no range can be larger than sampling has it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = settled(df)
    placed = settled(once.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over the parts
    firsts = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_c")).select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_first"))
    return placed.join(F.broadcast(firsts), part == F.col("_p")).select(*df.columns, (F.col("_first") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias(into))


#: Names that one window of ``dense_ids`` should hold.
NAMES_A_BUCKET = 50_000


def dense_ids(names: DataFrame, column: str, into: str = "node") -> tuple[DataFrame, int]:
    """(column, into) of the distinct values that aren't null, numbered 0 to n - 1, and n.

    Values are dealt to hash buckets; the bucket's first number comes from a small table of bucket sizes, and a window
    over the bucket does the rest.  So numbers depend on the values alone, and no task holds more than a bucket.
    """
    once = settled(names.select(column).filter(F.col(column).isNotNull()).distinct())
    n = once.count()
    buckets = 1 << (n // NAMES_A_BUCKET).bit_length()
    dealt = once.withColumn("_b", F.pmod(F.xxhash64(column), F.lit(buckets)))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # over the buckets, n / NAMES_A_BUCKET rows
    firsts = dealt.groupBy("_b").agg(F.count(F.lit(1)).alias("_c")).select("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_first"))
    placed = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_b").orderBy(column)) - 1)
    return placed.join(firsts, "_b").select(column, (F.col("_first") + F.col("_at")).cast("bigint").alias(into)), n
