"""Operator 8: variable-capacity best-fit packing of documents into training sequences.

Texts longer than the largest capacity are cut into pieces of that capacity; pieces are packed longest first.  A piece
goes to the open bin it fills best.  If none has room, the bin size of least projected cost opens: its price, less the
worth of the room that the pieces still to come can fill.  At the end each bin is downsized to the smallest permitted
capacity that holds its contents.

Pieces are dealt by a hash of the document into parts, sorted, and each part is packed by itself in runs of at most RUN
pieces, so memory is bounded whatever one key holds, and a part that is computed again gives the same bins.  A piece
never meets the bins of another run; each run leaves few bins half empty.

Lengths default to UTF-8 bytes of the text (the tokens of byte-level models) plus one end mark; any other column of
lengths can be given.  Pieces are ranges of these tokens, so a cut may fall inside a character; joined pieces are whole.

Defined cases: a null or empty text is one piece that holds the end mark only; a null doc_id is carried; repeated
rows are packed each; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coomat.llm.tables import only

CAPACITIES = (2048, 4096, 8192, 16384)
#: The price of a bin in tokens: OPENING for any sequence, one for each place, and attention, which grows with the square.
OPENING = 64
ATTENTION = 1 / (1 << 18)
RUN = 50_000


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, opening: int = OPENING) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the capacity of each bin.  No length may exceed the largest capacity."""
    caps = sorted(capacities)
    order = np.argsort(-lengths, kind="stable")
    left = int(lengths.sum())
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    size: list[int] = []
    used: list[int] = []
    rooms: list[int] = []  # the different amounts of room, sorted
    having: dict[int, list[int]] = {}  # room -> bins
    for i in order.tolist():
        n = int(lengths[i])
        left -= n
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            k = having[room].pop()
            if not having[room]:
                del having[room], rooms[at]
        else:
            # least cost for each token it will hold, if the pieces to come (none longer than this) fill the room
            k, best = len(size), None
            for c in caps[bisect_left(caps, n) :]:
                filled = n + min(c - n, left)
                cost = (opening + c + ATTENTION * c * c) / filled if filled else 0.0
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, c)
            size.append(best[1])
            used.append(0)
            room = best[1]
        bins[i], offsets[i] = k, used[k]
        used[k] += n
        room -= n
        if room not in having:
            having[room] = []
            insort(rooms, room)
        having[room].append(k)
    final = np.array([caps[bisect_left(caps, u)] for u in used], np.int64)
    return bins, offsets, final


def pieces(docs: DataFrame, length: Column, largest: int) -> DataFrame:
    """doc_id, part_key, piece, start, length: whole documents, or cuts of the largest capacity."""
    cut = docs.select("doc_id", F.greatest(length.cast("bigint"), F.lit(1)).alias("_n"), F.xxhash64("doc_id", "text").alias("part_key"))
    cut = cut.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / largest))))
    start = F.col("piece") * largest
    return cut.select("doc_id", "part_key", F.col("piece").cast("int").alias("piece"), start.alias("start"), F.least(F.lit(largest), F.col("_n") - start).alias("length"))


def packed_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, opening: int = OPENING, length: Column | None = None) -> DataFrame:
    """(doc_id, text, ...) -> a row for each piece: doc_id, piece, start, length, bin, capacity, at (its place in the bin).

    A bin is named part:run:number.
    """
    if length is None:
        docs = only(docs, "doc_id", "text")
        length = F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        part, turn = TaskContext.get().partitionId(), 0

        def packed(table):
            table = table.combine_chunks()
            bins, at, sizes = pack(table.column("length").to_numpy(), capacities, opening)
            names = pa.array([f"{part}:{turn}:{k}" for k in range(len(sizes))]).take(pa.array(bins)) if len(sizes) else pa.array([], pa.string())
            columns = [*(table.column(c).combine_chunks() for c in ("doc_id", "piece", "start", "length")), names, pa.array(sizes[bins].astype(np.int32)), pa.array(at)]
            yield from pa.table(columns, ["doc_id", "piece", "start", "length", "bin", "capacity", "at"]).to_batches(max_chunksize=10_000)

        held, rows = [], 0
        for b in batches:
            while b.num_rows:
                some = b.slice(0, RUN - rows)
                b = b.slice(len(some))
                held.append(some)
                rows += len(some)
                if rows == RUN:
                    yield from packed(pa.Table.from_batches(held))
                    held, rows, turn = [], 0, turn + 1
        if rows:
            yield from packed(pa.Table.from_batches(held))

    cut = pieces(docs, length, max(capacities))
    return cut.repartition("part_key").sortWithinPartitions("part_key", "doc_id", "piece").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, bin string, capacity int, at bigint")
