"""Operator 10: a reproducible global shuffle by a Feistel permutation with cycle walking.

Rows get global numbers 0 to N - 1 in an order that depends on their keys alone; the permutation sends number r to
place p, and shard = p mod S, slot = p div S.  Either way is computable for one row (``place_of``, ``row_at``), shard
counts are at most one apart and slots have no gaps.

Global numbers: rows are counted by key first, so a third of all rows under one key is one row here; the keys are
dealt to hash buckets, a bounded table of bucket sizes gives each bucket its first number, and a window gives numbers
within a bucket.

Defined cases: a null text has no bytes (crc32 of nothing is 0); a null doc_id is a key like any other; repeated
rows get numbers of their own; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coomat.llm.kernels import U, mix
from coomat.llm.tables import only, settled

ROUNDS = 6
#: The table of bucket sizes, which is broadcast, has at most so many rows.
MOST_BUCKETS = 1 << 16


def _rounds(x: np.ndarray, half: int, seed: int, back: bool) -> np.ndarray:
    mask, left, right = U((1 << half) - 1), x >> U(half), x & U((1 << half) - 1)
    for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
        key = mix(np.array([seed * ROUNDS + k + 1], U))[0]
        if back:
            left, right = right ^ (mix(left + key) & mask), left
        else:
            left, right = right, left ^ (mix(right + key) & mask)
    return left << U(half) | right


def _walk(x: np.ndarray, n: int, seed: int, back: bool) -> np.ndarray:
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    out = _rounds(x.astype(U), half, seed, back)
    while len(far := np.flatnonzero(out >= U(n))):  # at most 4 in 4 ** half places lie outside: it ends soon
        out[far] = _rounds(out[far], half, seed, back)
    return out.astype(np.int64)


def place_of(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The shuffled places of row numbers below n."""
    return _walk(rows, n, seed, False)


def row_at(places: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The row numbers at shuffled places: the inverse."""
    return _walk(places, n, seed, True)


def row_numbers(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """keys + row (0 to n - 1), and n.  Equal rows are counted first and spread again at the end."""
    counted = settled(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")))
    n, kinds = counted.agg(F.coalesce(F.sum("_c"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = min(MOST_BUCKETS, max(16, 1 << (kinds // 20_000).bit_length()))
    counted = counted.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counted.groupBy("_b").agg(F.sum("_c").alias("_s")).select("_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("_b").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    started = counted.withColumn("_at", F.coalesce(F.sum("_c").over(within), F.lit(0))).join(F.broadcast(firsts), "_b")
    start = F.col("_first") + F.col("_at")
    # a long run is cut into pieces that can go to other tasks before it becomes rows
    piece = 100_000
    cut = started.select(*keys, start.alias("_from"), (start + F.col("_c")).alias("_to"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_c") - 1) / piece))).alias("_k"))
    low = F.col("_from") + F.col("_k") * piece
    return cut.select(*keys, F.explode(F.sequence(low, F.least(low + piece, F.col("_to")) - 1)).alias("row")), n


def sharded(rows: DataFrame, keys: list[str], shards: int = 40, seed: int = 20) -> DataFrame:
    """keys + row, shard, slot."""
    numbered, n = row_numbers(rows, keys)

    def permute(batches):
        for b in batches:
            p = place_of(b.column("row").to_numpy(), n, seed)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((p % shards).astype(np.int32)), pa.array(p // shards)], [*b.schema.names, "shard", "slot"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema)
    return numbered.mapInArrow(permute, f"{schema}, shard int, slot bigint")


def sharded_documents(docs: DataFrame, shards: int = 40, seed: int = 20) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = only(docs, "doc_id", "text").select("doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).cast("bigint").alias("text_crc32"))
    out = sharded(rows, ["doc_id", "size", "text_crc32"], shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row")
