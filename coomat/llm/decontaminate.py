"""Operator 9: benchmark decontamination by spaced-seed hashing.

Tokens are lower-cased runs of letters and digits.  Each of a few fixed masks picks some of the tokens in a window and
ignores the others, so a hash still matches when ignored tokens were substituted.  The hashes of all test items form
a sorted array; every training position looks its hash up there (first in a bit table, then by binary search).  A hit
fixes an alignment of a document with an item; around it, tokens are compared along the whole item, and the document
overlaps the item if some window of WINDOW tokens (the item itself, if shorter) agrees in at least 80 of 100 tokens.

The test side is cut into blocks of at most BLOCK_BYTES of text; each block goes through the training side in turn.
A block's arrays take some 13 bytes for each byte of its text (16 for each token and mask), so broadcasts are bounded
however large the benchmark is.  The training side is never shuffled.  Seeds that many items share are looked up in
pieces of at most HITS alignments, so a common line can't fill a task's memory.

Items of one to four tokens have masks of their own length and so must occur token by token: a benchmark with an item of
one common word takes every document that has the word.

Defined cases: null and empty texts overlap nothing, and null and empty items nothing either; every one of several test
items with equal tokens is reported; repeated documents get equal results; an empty benchmark leaves every document
clean; other columns pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coomat.llm import kernels as K
from coomat.llm.tables import aside, only

#: Fixed masks: 1 counts, 0 is ignored.  Five tokens count in each; the first is for items of five tokens and for dense stretches.
MASKS = ("11111", "1101011", "10110011", "110010101")
#: For items under SHORT tokens: with one token substituted, these still fit.  Four tokens count in each.
SHORT_MASKS = ("1111", "10111", "11011", "11101")
SHORT = 8
WINDOW = 13
PERCENT = 80
#: For items of just so many tokens.
TINY_MASKS = ("1", "11", "111")
BLOCK_BYTES = 8 << 20
HITS = 1 << 22
#: Alignments that are compared in a piece.
PAIRS = 1 << 17
#: Tokens that are compared at once: some 100 MB.
COMPARED = 1 << 21
TABLE_BITS = 20


def tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slice by slice: the first document's index, all token hashes, and their bounds by document."""
    sep, value = K.byte_table(letters_only=True)
    data, offs = K.text_bytes(pc.utf8_lower(column))
    for lo, hi in K.slices(offs):
        part, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        starts, ends, bounds = K.word_bounds(part, o, sep)
        yield lo, K.word_hashes(part, starts, ends, value), bounds


def spaced(words: np.ndarray, bounds: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """The mask's hashes and the positions where they start; no window leaves its document."""
    span = len(mask)
    if len(words) < span:
        return np.zeros(0, np.int64), np.zeros(0, K.U)
    picked = [i for i, c in enumerate(mask) if c == "1"]
    factors = K.mix(np.arange(1, span + 1).astype(K.U) + K.U(int(mask, 2) << 8)) | K.U(1)
    size = len(words) - span + 1
    rolled = np.zeros(size, K.U)
    for i in picked:
        rolled += words[i : i + size] * factors[i]
    inside = np.ones(len(words) + 1, bool)
    for k in range(1, span):  # starts too close to the end of their document
        at = bounds[1:] - k
        inside[at[at >= bounds[:-1]]] = False
    at = np.flatnonzero(inside[:size])
    return at, K.mix(rolled[at])


class Items:
    """The hashes of one block of test items; items with equal tokens are one here, with several ids."""

    def __init__(self, rows: list[tuple]):
        seen: dict[bytes, tuple[list, np.ndarray]] = {}
        if rows:
            rows = sorted(rows, key=lambda r: (r[0] is None, r[0]))
            for lo, words, bounds in tokens(pa.array([r[1] for r in rows], pa.string())):
                for i in range(len(bounds) - 1):
                    own = words[bounds[i] : bounds[i + 1]]
                    if len(own):
                        seen.setdefault(own.tobytes(), ([], own))[0].append(rows[lo + i][0])
        self.ids = [x for x, _ in seen.values()]
        self.words = [own for _, own in seen.values()]
        flat = np.concatenate(self.words) if self.words else np.zeros(0, K.U)
        self.sizes = np.array([len(x) for x in self.words], np.int64)
        bounds = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.flat, self.starts = flat, bounds[:-1]
        of = np.repeat(np.arange(len(self.words)), self.sizes)
        self.masks = []
        short = self.sizes < SHORT
        tiny = [m for m in TINY_MASKS if (self.sizes == len(m)).any()]
        for mask in (*MASKS, *(SHORT_MASKS if short.any() else ()), *tiny):
            at, hashes = spaced(flat, bounds, mask)
            if mask not in MASKS:
                some = (self.sizes == len(mask))[of[at]] if mask in TINY_MASKS else short[of[at]]
                at, hashes = at[some], hashes[some]
            by = np.argsort(hashes, kind="stable")
            at, hashes = at[by], hashes[by]
            table = np.zeros(1 << TABLE_BITS, bool)
            table[(hashes >> K.U(64 - TABLE_BITS)).astype(np.int64)] = True
            self.masks.append((mask, hashes, of[at].astype(np.int32), (at - bounds[of[at]]).astype(np.int32), table))

    def alignments(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pieces of (item, where its first token would lie); each once, if the slice has at most HITS look-ups that hit."""
        held, size = [], 0
        for mask, hashes, item, place, table in self.masks:
            at, own = spaced(words, bounds, mask)
            hit = np.flatnonzero(table[(own >> K.U(64 - TABLE_BITS)).astype(np.int64)])
            at, own = at[hit], own[hit]
            left = np.searchsorted(hashes, own)
            n = np.searchsorted(hashes, own, "right") - left
            ends = np.cumsum(n)
            for lo in range(0, int(n.sum()), HITS):  # the lo-th alignment to the next
                k = np.arange(lo, min(lo + HITS, int(ends[-1])))
                of = np.searchsorted(ends, k, "right")
                which = left[of] + k - (ends[of] - n[of])
                held.append((item[which].astype(np.int64) << 40) + (at[of] - place[which] + (1 << 39)))  # one number, to sort
                size += len(k)
                if size >= HITS:
                    yield from self._once(held)
                    held, size = [], 0
        yield from self._once(held)

    @staticmethod
    def _once(held: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if held:
            codes = np.unique(np.concatenate(held))
            for lo in range(0, len(codes), PAIRS):
                some = codes[lo : lo + PAIRS]
                yield some >> 40, (some & ((1 << 40) - 1)) - (1 << 39)

    def overlaps(self, column: pa.Array, any_item: bool = False) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, first token, tokens that agree, tokens of the window), the best window for each row and item.

        With ``any_item`` a row is done with its first item.
        """
        for lo, words, bounds in tokens(column):
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            done = np.zeros(len(bounds) - 1, bool)
            for item, d in self.alignments(words, bounds):
                for rows in self.compared(words, bounds, item, d, done if any_item else None):
                    for doc, i, agree, start, width in zip(*(x.tolist() for x in rows), strict=True):
                        key, new = (lo + doc, i), (agree, -start, width)
                        best[key] = max(best.get(key, new), new)
                        done[doc] = True
            for (row, i), (agree, start, width) in sorted(best.items()):
                yield row, i, -start, agree, width

    def compared(self, words: np.ndarray, bounds: np.ndarray, item: np.ndarray, d: np.ndarray, done: np.ndarray | None) -> Iterator[tuple[np.ndarray, ...]]:
        """The alignments that overlap: document, item, tokens that agree in the best window, its first token, its width.

        An alignment may start before its document or end behind it, and then touches several; ``done`` documents are left out.
        """
        stop = d + self.sizes[item]
        first = np.searchsorted(bounds, np.maximum(d, 0), "right") - 1
        n = np.minimum(np.searchsorted(bounds, stop - 1, "right"), len(bounds) - 1) - first
        of = np.repeat(np.arange(len(item)), np.maximum(n, 0))
        doc = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(np.maximum(n, 0)) - np.maximum(n, 0), np.maximum(n, 0))
        item, d = item[of], d[of]
        lo, hi = np.maximum(d, bounds[doc]), np.minimum(stop[of], bounds[doc + 1])
        width = np.minimum(WINDOW, self.sizes[item])
        some = hi - lo >= width
        if done is not None:
            some &= ~done[doc]
        item, d, doc, lo, hi, width = (x[some] for x in (item, d, doc, lo, hi, width))
        total = np.cumsum(hi - lo)
        k = 0
        while k < len(item):  # by about COMPARED tokens
            z = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + COMPARED)))
            yield self._windows(words, bounds, *(x[k:z] for x in (item, d, doc, lo, hi, width)))
            k = z

    def _windows(self, words, bounds, item, d, doc, lo, hi, width) -> tuple[np.ndarray, ...]:
        n = hi - lo
        ends = np.cumsum(n)
        begin = ends - n
        of = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(of)) - begin[of]  # place in the stretch
        same = words[lo[of] + at] == self.flat[self.starts[item][of] + (lo - d)[of] + at]
        sums = np.concatenate([[0], np.cumsum(same)])
        here = np.arange(len(of))
        agree = np.where(at + width[of] <= n[of], sums[np.minimum(here + width[of], len(of))] - sums[here], -1)
        coded = np.maximum.reduceat((agree << 40) - at, begin)  # of equal windows the first
        most = -(-coded >> 40)
        start = (most << 40) - coded
        hit = 100 * most >= PERCENT * width
        return doc[hit], item[hit], most[hit], (lo + start - bounds[doc])[hit], width[hit]


def blocks(benchmark: DataFrame, size: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The test side in blocks of about ``size`` bytes of text; one is in memory at a time."""
    rows = only(benchmark, "item_id", "text").filter("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // size)
    for k in range(n):
        yield [tuple(r) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toLocalIterator()]


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> a row for each overlapping document and item: doc_id, item_id, start, agree, width."""
    spark, docs, out = docs.sparkSession, only(docs, "doc_id", "text"), None
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {only(benchmark, 'item_id').schema['item_id'].dataType.simpleString()}, start bigint, agree int, width int"
    for rows in blocks(benchmark):
        shared = spark.sparkContext.broadcast(Items(rows))

        def run(batches, shared=shared):
            items = shared.value
            for b in batches:
                found = [(x[0], i, *x[2:]) for x in items.overlaps(b.column("text")) for i in items.ids[x[1]]]
                at = pa.array([x[0] for x in found], pa.int64())
                ids = pa.array([x[1] for x in found])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), ids.cast(pa.int64()) if pa.types.is_null(ids.type) else ids, *(pa.array([x[k] for x in found], t) for k, t in ((2, pa.int64()), (3, pa.int32()), (4, pa.int32())))], ["doc_id", "item_id", "start", "agree", "width"])

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap no item, with their columns; rows are judged by themselves, so nothing is shuffled."""
    names, docs = docs.columns, aside(docs, "text")
    for rows in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Items(rows))

        def run(batches, shared=shared):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[x[0] for x in shared.value.overlaps(b.column(b.schema.get_field_index("text")), any_item=True)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs.toDF(*names)
