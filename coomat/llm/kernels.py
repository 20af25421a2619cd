"""Vectorised text kernels over Arrow string buffers.

Everything here works on the UTF-8 bytes of whole batches, so no Python object is made per word.
Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; that is the same split on code points,
because the separators are ASCII.  Memory is bounded by slicing a batch at about ``SLICE`` bytes of text
(a single longer document is a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
U = np.uint64
SHINGLE = 5


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def byte_table(lower: bool = True, letters_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(separator flags, 64-bit value of each byte).  ``letters_only`` makes ASCII punctuation separate words."""
    sep = np.zeros(256, bool)
    sep[[9, 10, 11, 12, 13, 32]] = True
    if letters_only:
        keep = np.zeros(256, bool)
        keep[48:58] = keep[65:91] = keep[97:123] = keep[128:] = True
        sep = ~keep
    code = np.arange(256)
    if lower:
        code[65:91] += 32
    return sep, mix((code + 1).astype(U) * U(0x9E3779B97F4A7C15))


class Local(dict):
    """A cache of this process; it travels empty."""

    def __reduce__(self):
        return Local, ()


_POWERS = Local()
BASE = 0x5851F42D4C957F2D


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(n + 1, 1 << 16)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            x = np.full(size, base, U)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its values; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``size`` bytes."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_bounds(data: np.ndarray, offs: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each document the index of its first word (n + 1 values)."""
    is_word = ~sep[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    first = is_word.copy()
    first[1:] &= ~is_word[:-1] | edge[1:-1]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial by prefix sums, then a finaliser."""
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, U)
    np.cumsum(value[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's n-word windows in order, and their n_docs + 1 bounds.

    A document of fewer than n words (but at least one) has one hash, of its whole sequence.
    """
    counts = np.diff(bounds)
    factors = mix(np.arange(1, n + 1).astype(U)) | U(1)
    out_counts = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    out_bounds = np.concatenate([[0], np.cumsum(out_counts)])
    if not len(words):
        return np.zeros(0, U), out_bounds
    size = max(0, len(words) - n + 1)
    rolled = np.zeros(len(words), U)
    for k in range(n):
        rolled[:size] += words[k : k + size] * factors[k]
    rolled = mix(rolled + U(n))
    keep = np.zeros(len(words), bool)
    at = np.arange(len(words)) - np.repeat(bounds[:-1], counts)
    left = np.repeat(counts, counts) - at
    keep[left >= n] = True
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        lo = bounds[i]
        part = words[lo : bounds[i + 1]]
        rolled[lo] = mix(np.array([(part * factors[: len(part)]).sum(dtype=U) + U(len(part))], U))[0]
        keep[lo] = True
    return rolled[keep], out_bounds


def slice_shingles(column: pa.Array, n: int = SHINGLE, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slice by slice: the first document's index, the shingle hashes in order, and their bounds by document."""
    sep, value = byte_table(lower)
    data, offs = text_bytes(column)
    for lo, hi in slices(offs):
        part, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        starts, ends, bounds = word_bounds(part, o, sep)
        yield lo, *shingle_hashes(word_hashes(part, starts, ends, value), bounds, n)


def doc_shingles(column: pa.Array, n: int = SHINGLE, lower: bool = True) -> Iterator[np.ndarray]:
    """For each document the sorted distinct shingle hashes of its whole text."""
    for _, hashes, at in slice_shingles(column, n, lower):
        for i in range(len(at) - 1):
            yield np.unique(hashes[at[i] : at[i + 1]])
