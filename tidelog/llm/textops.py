"""Vectorised text primitives over Arrow string buffers: words, hashes, shingles.

All of them work on whole texts. A batch is cut into chunks at document borders so that the
temporaries stay within a few tens of MB; a document longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_WS = np.zeros(256, dtype=bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Longer segments than LANES lanes of 8 bytes are hashed by a library, one by one.
LANES = 8
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1], U64)
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def fmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def release() -> None:
    """Gives back what a batch no longer needs: Arrow's and the allocator's free memory. A Python worker goes
    on from task to task and would keep its peak otherwise."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def string_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (n + 1) and data of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offs - offs[0], raw[offs[0] : offs[-1]]


def chunks(offs: np.ndarray, limit: int = 1 << 20, most: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Runs of at most `most` documents and of at most limit bytes together, one document at least."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        hi = min(hi, n, lo + most)
        yield lo, hi
        lo = hi


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def ws_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of each document: starts, ends, and word offsets by document (n + 1)."""
    n = len(data)
    if n == 0:
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offs), np.int64)
    ws = _WS[data]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    first = ~ws
    last = first.copy()
    first[1:] &= ws[:-1] | cut[1:n]
    last[:-1] &= ws[1:] | cut[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def segment_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes data[starts[i]:ends[i]] for each i.

    The bytes are mixed in lane after lane of 8, over all segments that reach so far; the mixing is one to one,
    so that different segments of up to 8 bytes and one length never share a hash.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))
    size = ends - starts
    h = fmix(size.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(0x9E3779B97F4A7C15))
    live = np.flatnonzero((size > 0) & (size <= 8 * LANES))
    for lane in range(LANES):
        left = size[live] - 8 * lane
        h[live] = fmix(h[live] ^ (lanes[starts[live] + 8 * lane] & _KEEP[np.minimum(left, 8)]))
        live = live[left > 8]
        if not len(live):
            break
    for i in np.flatnonzero(size > 8 * LANES).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(padded[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


_MULT = fmix(np.arange(1, 65, dtype=U64)) | U64(1)
_CHECK = fmix(np.arange(1001, 1065, dtype=U64)) | U64(1)


def window_hash(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k word hashes from each position of at."""
    h = np.full(len(at), k * 0x9E3779B97F4A7C15 % 2**64, U64)
    for j in range(k):
        h += words[at + j] * _MULT[j]
    return fmix(h)


def window_check(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """32 more bits on the k word hashes from each position of at, independent of window_hash."""
    h = np.zeros(len(at), U64)
    for j in range(k):
        h += words[at + j] * _CHECK[j]
    return (fmix(h) >> U64(32)).astype(np.uint32)


def sequence_hash(words: np.ndarray) -> np.uint64:
    """Hash of a whole sequence of fewer words than a shingle has."""
    with np.errstate(over="ignore"):
        h = fmix((words * _MULT[: len(words)]).sum(keepdims=True) + U64(len(words)) * U64(0xA0761D6478BD642F))
    return h[0]


def window_starts(word_offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of k words that lie in one document, and how many each document has."""
    counts = np.maximum(np.diff(word_offs) - k + 1, 0)
    total = int(counts.sum())
    before = np.concatenate([[0], np.cumsum(counts)])
    return np.arange(total) - np.repeat(before[:-1] - word_offs[:-1], counts), counts


def shingle_sets(words: np.ndarray, word_offs: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each document; a shorter one has its whole sequence as one."""
    at, counts = window_starts(word_offs, k)
    hashes = window_hash(words, at, k)
    ends = np.cumsum(counts)
    out = []
    for i, (c, e) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
        if c:
            s = np.sort(hashes[e - c : e])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif (a := word_offs[i]) < (b := word_offs[i + 1]):
            out.append(sequence_hash(words[a:b])[None])
        else:
            out.append(np.zeros(0, U64))
    return out


def binary(values: np.ndarray, lengths: np.ndarray | None = None) -> pa.Array:
    """A binary column of rows of values: a 2-d array's rows, or runs of the given lengths."""
    if lengths is None:
        width = values.shape[1] * values.itemsize
        offs = np.arange(values.shape[0] + 1, dtype=np.int32) * np.int32(width)
        rows = values.shape[0]
    else:
        offs = (np.concatenate([[0], np.cumsum(lengths)]) * values.itemsize).astype(np.int32)
        rows = len(lengths)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def binary_rows(column: pa.Array, dtype: type) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in column.to_pylist()]
