"""Rank vectors and run metadata in files.

A rank vector is a file of little-endian doubles without a header, or a folder of such files whose names sort in the
order of their contents; the tasks that read and write them hold one file of a folder, or one split of a large file.
"""

from __future__ import annotations

from itertools import accumulate, batched

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Doubles of one written file: 8 MB.
FILE = 1 << 20
#: Files of this size and more don't fit a binary value and are read in splits.
WHOLE = 1 << 31
_SCHEMA = "node bigint, rank double"


def read_rank_vector(spark: SparkSession, path: str) -> DataFrame:
    """(node, rank).  Only the last file may have trailing bytes of no whole double; they are left."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter("length > 0").select("path", "length").orderBy("path").collect()
    if any(f.length % 8 for f in files[:-1]):
        raise ValueError(f"a file of {path} before the last ends within a double")
    if len(files) == 1 and files[0].length >= WHOLE:
        return _in_splits(spark, files[0].path, files[0].length)
    if any(f.length >= WHOLE for f in files):
        raise ValueError(f"one of several files of {path} has 2 GB or more")
    starts = dict(zip((f.path for f in files), accumulate((f.length // 8 for f in files), initial=0)))

    def unpack(batches):
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                data = content.as_buffer() if content.is_valid else b""
                v = np.frombuffer(data, "<f8", len(data) // 8)
                for lo in range(0, len(v), 1 << 16):
                    part = v[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(part)) + starts[name]), pa.array(part)], ["node", "rank"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter("length > 0").select("path", "content").mapInArrow(unpack, _SCHEMA)


def _in_splits(spark: SparkSession, path: str, length: int) -> DataFrame:
    """A large file as records of 8 bytes, which Spark cuts at split ends; a first pass counts those of each split."""
    if length % 8:
        raise ValueError(f"{path} ends within a double")
    records = spark.sparkContext.binaryRecords(path, 8)

    def rows(pairs):
        for some in batched(pairs, 1 << 14):
            v = np.frombuffer(b"".join(r for r, _ in some), "<f8")
            yield from zip(range(some[0][1], some[0][1] + len(v)), v.tolist(), strict=True)

    return spark.createDataFrame(records.zipWithIndex().mapPartitions(rows), _SCHEMA)


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_rank_vector(ranks: DataFrame, path: str, size: int = FILE) -> int:
    """A folder of files of ``size`` ranks, each written by the task that has them and named by its first node.

    Every node from 0 must be there once.  A file is written under another name and then renamed, so a task that runs
    again leaves the same.  Returns the number of ranks.
    """
    n, high, low = ranks.agg(F.count(F.lit(1)), F.max("node"), F.min("node")).first()
    if n and (low or high != n - 1):
        raise ValueError("ranks must have every node from 0 once")
    place, folder = _place(path)
    place.create_dir(folder)

    def write(key, table):
        start, node = key[0].as_py() * size, table.column("node").to_numpy()
        out = np.full(min(size, n - start), np.nan)
        out[node - start] = table.column("rank").to_numpy()
        if len(node) != len(out) or np.bincount(node - start).max() > 1:
            raise ValueError("ranks must have every node from 0 once")
        own, top = _place(path)
        name = f"{top}/part-{start:015d}.bin"
        with own.open_output_stream(name + ".new") as stream:
            stream.write(out.astype("<f8").tobytes())
        own.move(name + ".new", name)
        return pa.table({"start": [start], "n": [len(out)]})

    return ranks.select("node", "rank").groupBy(F.expr(f"node div {size}")).applyInArrow(write, "start bigint, n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of key=value lines."""
    lines = spark.read.text(path).filter(F.col("value").contains("="))
    at = F.instr("value", "=")
    return lines.select(F.trim(F.substring(F.col("value"), F.lit(1), at - 1)).alias("key"), F.trim(F.substring(F.col("value"), at + 1, F.length("value"))).alias("value"))


def write_meta(meta: DataFrame, path: str) -> None:
    """(key, value) rows, which are few, as one file of key=value lines in order of the keys."""
    meta.select(F.concat("key", F.lit("="), "value").alias("value")).orderBy("value").coalesce(1).write.mode("overwrite").text(path)
