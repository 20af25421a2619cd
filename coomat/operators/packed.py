"""Matrices packed by rows into arrays, for products with a vector that fits a broadcast.

The rows of a matrix are cut into ranges, and the cells of a range are packed once, in the task that gets them, into one
row of binary columns: the numbers of its rows, where each row starts, columns and values.  A product then sends the
vector to all tasks as one array; each task multiplies its blocks and sums the segments of rows; what comes back is one
partial sum for each row of a block.  Blocks are bounded: a range with more cells than BLOCK is dealt to several by
column, so no row or range, however hot, lies in one task, and partial sums are added.

The vector has at most BROADCAST_ROWS values (checked), and so have the sums.

Tiles are for a vector that is spread, too: pieces of SIDE values are rows of a table, and the cells of a piece's columns
lie together.  A product then moves pieces to tiles and partial sums to pieces, and the driver has no part of either.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coomat.operators.multiply import BROADCAST_ROWS
from coomat.session import settled

#: Cells of a block, some 12 MB packed; small matrices are cut finer, so that all tasks have some, but not below LEAST.
BLOCK = 1 << 20
LEAST = 1 << 13
#: Rows of a range.
RANGE = 1 << 16
#: Partial sums that come to the driver at once; beyond, those of a range are added before.
GATHERED = 8 * BROADCAST_ROWS

#: Values of a piece of a spread vector, and cells of a tile, some 4 MB packed.
SIDE = 1 << 14
TILE = 1 << 18

_PACKED = "range bigint, rows binary, starts binary, cols binary, vals binary"


def _numbers(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(column.as_py(), kind)


def pack(cells: DataFrame, n_rows: int, n_cols: int, nnz: int) -> DataFrame:
    """(i, j, v), each cell once -> a row for each block; nnz is the number of cells."""
    if n_cols > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} columns for packed rows")
    tasks = 2 * cells.sparkSession.sparkContext.defaultParallelism
    block = max(LEAST, min(BLOCK, -(-nnz // tasks)))
    size = max(1, min(RANGE, -(-n_rows // tasks)))
    ranged = cells.select("i", "j", "v", F.expr(f"i div {size}").alias("range"))
    # n_rows / RANGE rows or some per task: always small
    parts = ranged.groupBy("range").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    dealt = ranged.join(F.broadcast(parts), "range").withColumn("part", F.pmod(F.xxhash64("j"), F.col("parts")))

    def packed(key, table):
        i, j, v = (table.column(c).to_numpy() for c in ("i", "j", "v"))
        by = np.lexsort((j, i))
        i, j, v = i[by], j[by], v[by]
        starts = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        blobs = [i[starts].astype("<i8"), starts.astype("<i4"), j.astype("<i4"), v.astype("<f8")]
        return pa.table({"range": [key[0].as_py()], **{n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(("rows", "starts", "cols", "vals"), blobs, strict=True)}})

    return dealt.groupBy("range", "part").applyInArrow(packed, _PACKED)


def partial_sums(blocks: DataFrame, x) -> DataFrame:
    """Packed blocks and a broadcast array -> range, rows, sums (binary), and the seconds that the block took."""

    def times(batches):
        for b in batches:
            out = []
            for k in range(b.num_rows):
                began = time.perf_counter()
                rows, starts, cols, vals = (_numbers(b.column(n)[k], kind) for n, kind in (("rows", "<i8"), ("starts", "<i4"), ("cols", "<i4"), ("vals", "<f8")))
                sums = np.add.reduceat(vals * x.value[cols], starts)
                out.append((b.column("range")[k].as_py(), rows.tobytes(), sums.tobytes(), time.perf_counter() - began))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.float64()), strict=True)], ["range", "rows", "sums", "seconds"])

    return blocks.mapInArrow(times, "range bigint, rows binary, sums binary, seconds double")


def _added(key, table):
    rows, sums = (np.concatenate([_numbers(x, kind) for x in table.column(c)]) for c, kind in (("rows", "<i8"), ("sums", "<f8")))
    rows, at = np.unique(rows, return_inverse=True)
    return pa.table({"range": [key[0].as_py()], "rows": [rows.astype("<i8").tobytes()], "sums": [np.bincount(at, sums).astype("<f8").tobytes()], "seconds": [max(table.column("seconds").to_pylist())]})


@dataclass
class Packed:
    """A packed matrix that stays in the executors until ``drop``."""

    blocks: DataFrame
    n_rows: int
    n_cols: int
    stored: int

    @classmethod
    def of(cls, cells: DataFrame, n_rows: int, n_cols: int, nnz: int) -> Packed:
        blocks = pack(cells, n_rows, n_cols, nnz).persist(StorageLevel.MEMORY_AND_DISK)
        return cls(blocks, n_rows, n_cols, blocks.agg(F.coalesce(F.sum(F.octet_length("rows")), F.lit(0))).first()[0] // 8)

    def multiply(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """The product as an array, and the seconds of the slowest block."""
        shared = self.blocks.sparkSession.sparkContext.broadcast(x)
        sums = partial_sums(self.blocks, shared)
        if self.stored > GATHERED:
            sums = sums.groupBy("range").applyInArrow(_added, sums.schema)
        y, slowest = np.zeros(self.n_rows), 0.0
        for b in sums.select("rows", "sums", "seconds").toArrow().to_batches():
            for k in range(b.num_rows):
                y[_numbers(b.column("rows")[k], "<i8")] += _numbers(b.column("sums")[k], "<f8")
                slowest = max(slowest, b.column("seconds")[k].as_py())
        shared.destroy()
        return y, slowest

    def drop(self) -> None:
        self.blocks.unpersist()


def as_array(rows: DataFrame, key: str, value: str, n: int) -> np.ndarray:
    """A vector of at most BROADCAST_ROWS values; missing ones are 0."""
    if n > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} values for one array")
    out, table = np.zeros(n), rows.select(key, value).toArrow()
    out[table[key].to_numpy()] = table[value].to_numpy()
    return out


def as_rows(like: DataFrame, values: np.ndarray, key: str, value: str) -> DataFrame:
    """The array as (key, value) rows, made in the tasks from a broadcast."""
    spark = like.sparkSession
    shared = spark.sparkContext.broadcast(values)

    def rows(batches):
        for b in batches:
            at = b.column(0)
            yield pa.RecordBatch.from_arrays([at, pa.array(shared.value[at.to_numpy()])], [key, value])

    return spark.range(len(values)).mapInArrow(rows, f"{key} bigint, {value} double")


def piece_of(column: str) -> Column:
    return F.expr(f"{column} div {SIDE}")


def tiles(cells: DataFrame, nnz: int) -> tuple[DataFrame, DataFrame]:
    """(i, j, v), each cell once -> packed tiles (c, sub, rows, starts, cols, vals), and (c, subs) of each piece c of columns.

    The cells of a piece are dealt to tiles by row, so a tile has about TILE of them, or those of a row, at most SIDE.
    """
    size = max(LEAST, min(TILE, -(-nnz // (2 * cells.sparkSession.sparkContext.defaultParallelism))))
    ranged = cells.select(piece_of("j").alias("c"), "i", "j", "v")
    subs = settled(ranged.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("subs")))  # a row for SIDE columns
    dealt = ranged.join(subs, "c").select("c", F.pmod(F.xxhash64("i"), F.col("subs")).cast("int").alias("sub"), "i", "j", "v")

    def packed(key, table):
        i, j, v = (table.column(c).to_numpy() for c in ("i", "j", "v"))
        by = np.lexsort((j, i))
        i, j, v = i[by], j[by], v[by]
        starts = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        blobs = [i[starts].astype("<i8"), starts.astype("<i4"), (j - key[0].as_py() * SIDE).astype("<i4"), v.astype("<f8")]
        return pa.table({"c": [key[0].as_py()], "sub": pa.array([key[1].as_py()], pa.int32()), **{n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(("rows", "starts", "cols", "vals"), blobs, strict=True)}})

    return dealt.groupBy("c", "sub").applyInArrow(packed, "c bigint, sub int, rows binary, starts binary, cols binary, vals binary"), subs


def tile_sums(held: DataFrame, subs: DataFrame, pieces: DataFrame) -> DataFrame:
    """Tiles, and pieces (c, x binary) of a vector -> partial sums (r, rows, sums) of pieces r of the product; rows as places in r."""
    copies = pieces.join(subs, "c").select("c", "x", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"))

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                rows, starts, cols, vals, x = (_numbers(b.column(n)[k], kind) for n, kind in (("rows", "<i8"), ("starts", "<i4"), ("cols", "<i4"), ("vals", "<f8"), ("x", "<f8")))
                sums = np.add.reduceat(vals * x[cols], starts)
                r = rows // SIDE
                at = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
                parts = list(zip(at, [*at[1:], len(r)], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(r[at]), pa.array([(rows[lo:hi] - r[lo] * SIDE).astype("<i4").tobytes() for lo, hi in parts], pa.binary()), pa.array([sums[lo:hi].tobytes() for lo, hi in parts], pa.binary())], ["r", "rows", "sums"])

    return held.join(copies.hint("merge"), ["c", "sub"]).select("rows", "starts", "cols", "vals", "x").mapInArrow(times, "r bigint, rows binary, sums binary")


def added_to(total: np.ndarray, rows: pa.Scalar, sums: pa.Scalar) -> None:
    """Adds one partial sum, whose rows are different ones."""
    total[_numbers(rows, "<i4")] += _numbers(sums, "<f8")
