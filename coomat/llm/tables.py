"""Helpers that the operators share: checkpoints and fixed-size membership filters."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coomat.session import ensure_checkpoints, settled

__all__ = ["aside", "compact", "ensure_checkpoints", "filter_bits", "maybe_in", "membership", "only", "removed", "settled", "written"]


def aside(df: DataFrame, *names: str) -> DataFrame:
    """The same columns in order, all but the named ones under names that clash with nothing (``toDF`` gives them back).

    Names are told apart exactly, so other columns may differ from these in case only or repeat them.
    """
    seen: set[str] = set()
    return df.toDF(*(c if c in names and not (c in seen or seen.add(c)) else f"__other_{k}" for k, c in enumerate(df.columns)))


def compact(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Settled, and in no more partitions than its rows need: small results then cost later shuffles few files."""
    df = settled(df)
    return df.coalesce(max(1, -(-df.count() // rows)))


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The same rows from a table in the shared checkpoint folder, and the table's own folder, for ``removed``.

    Unlike a checkpoint it is compressed and read by column.
    """
    spark = df.sparkSession
    ensure_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def removed(spark: SparkSession, *folders: str) -> None:
    """Deletes folders of the shared store: what was made of them must be in place."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, whatever else the table has."""
    return aside(df, *names).select(*names)


#: Most bits of a membership filter: 2**24 bits are at most 266,306 rows of (slot, bits), about 4 MB when broadcast.
FILTER_BITS = 1 << 24
#: A filter keeps 63 bits in a row, so that the shifted bit never meets the sign.
SLOT = 63


def _place(key: Column, bits: int) -> tuple[Column, Column]:
    place = F.pmod(F.xxhash64(key, F.lit(11)), F.lit(bits))
    return F.floor(place / SLOT), (place % SLOT).cast("int")


def filter_bits(rows: int) -> int:
    """Bits for so many keys: 64 for each, within fixed bounds."""
    return int(min(FILTER_BITS, max(1 << 12, 1 << max(1, (64 * rows - 1)).bit_length())))


def membership(keys: DataFrame, column: str, rows: int) -> tuple[DataFrame, int]:
    """A one-hash Bloom filter as a table (slot, bits) of at most FILTER_BITS / 63 rows, however many keys there are."""
    bits = filter_bits(rows)
    slot, bit = _place(F.col(column), bits)
    return keys.groupBy(slot.alias("_slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("_bits")), bits


def maybe_in(df: DataFrame, key: Column, table: tuple[DataFrame, int], negate: bool = False) -> DataFrame:
    """Rows whose key may be in the filter (or surely is not).  The broadcast side is bounded by FILTER_BITS."""
    words, bits = table
    slot, bit = _place(key, bits)
    marked = df.withColumns({"_at": slot, "_bit": bit}).join(F.broadcast(words), F.col("_at") == F.col("_slot"), "left")
    hit = F.coalesce(F.call_function("shiftright", F.col("_bits"), F.col("_bit")).bitwiseAND(F.lit(1).cast("bigint")) == 1, F.lit(False))
    return marked.filter(~hit if negate else hit).drop("_at", "_bit", "_slot", "_bits")
