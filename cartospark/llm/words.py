"""Vectorised word hashing over Arrow string columns.

A *word* is a maximal run of UTF-8 bytes outside ``[\\x20\\x09-\\x0D]``.  Words are never
materialised as Python strings: a polynomial hash of every word of a whole slice of documents
comes out of one prefix sum, so the cost is a few nanoseconds a byte and memory is bounded by
the slice (``SLICE_BYTES`` of text, or one document where that is longer).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18  # arrays of eight bytes a byte stand beside a slice, in every worker of an executor

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply, shift); bijective, so it loses nothing."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], dtype=np.uint64))[0])


_WS = np.zeros(256, dtype=bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]

LETTER = np.zeros(256, bool)  # letters and digits, and all beyond ASCII
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, _U), np.ones(1, _U))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        tables = []
        for base in (_P, _P_INV):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers = tuple(tables)
    return _powers


@dataclass
class Words:
    """Words of a slice of documents. ``first[d]:first[d+1]`` are the words of document d."""

    data: np.ndarray  # uint8, all texts end to end
    bounds: np.ndarray  # byte offsets of the documents, len n_docs + 1
    start: np.ndarray  # byte offset of each word
    end: np.ndarray
    hash: np.ndarray  # uint64
    first: np.ndarray  # len n_docs + 1
    space: np.ndarray  # bool, which bytes are white space
    total: np.ndarray  # prefix sums behind the hashes

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans, of the words' kind (lower-cased or not)."""
        return span_hashes(self.total, start, end)

    @property
    def n_docs(self) -> int:
        return len(self.bounds) - 1

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.first))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    lo, hi = int(bounds[0]), int(bounds[-1])
    raw = np.frombuffer(data, np.uint8, hi - lo, lo) if data is not None and hi > lo else np.zeros(0, np.uint8)
    return raw, bounds - lo


def hash_words(data: np.ndarray, bounds: np.ndarray, lower: bool = True) -> Words:
    n = len(data)
    ws = _WS[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[bounds] = True
    opens = ~ws
    opens[1:] &= ws[:-1] | cut[1:n]
    closes = ~ws
    closes[:-1] &= ws[1:] | cut[1:n]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    total = prefix_hash(data, lower)
    return Words(data, bounds, start, end, span_hashes(total, start, end), np.searchsorted(start, bounds), ws, total)


def bare_spans(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the words without punctuation (ASCII, up to four characters) at either side; a word of nothing else keeps one character."""
    start, end, data = words.start.copy(), words.end.copy(), words.data
    for _ in range(4):
        end -= (end - 1 > start) & ~LETTER[data[end - 1]]
        start += (start < end - 1) & ~LETTER[data[np.minimum(start, len(data) - 1)]]
    return start, end


def bare_hashes(words: Words) -> np.ndarray:
    return words.spans(*bare_spans(words))


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Running sums from which the hash of any span comes (see span_hashes)."""
    up, _ = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[: len(data)], out=total[1:])
    return total


def span_hashes(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _power_tables(len(total))
    h = (total[end] - total[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64) * _U(0xA24BAED4963EE407))


_trim = None


def release() -> None:
    """Gives memory that earlier batches and stages left in this worker's allocators back to the system."""
    global _trim
    if _trim is None:
        try:
            _trim = ctypes.CDLL(None).malloc_trim
        except (OSError, AttributeError):  # another C library
            _trim = lambda _: 0
    pa.default_memory_pool().release_unused()
    _trim(0)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of a batch whose texts hold about SLICE_BYTES, with their bytes and offsets."""
    i, texts = 0, batch.column(column)
    if not batch.num_rows:
        return
    release()
    data, bounds = text_buffers(texts)
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SLICE_BYTES, "right")) - 1)
        j = min(j, i + 20_000, batch.num_rows)
        yield batch.slice(i, j - i), data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j


_LANES = mix(np.arange(1, 65, dtype=np.uint64) * _U(0xBF58476D1CE4E5B9)) | _U(1)


def window_hashes(h: np.ndarray, offsets: list[int]) -> np.ndarray:
    """Hash of h[i + o] for o in offsets, for every i where the widest offset still fits."""
    n = len(h) - max(offsets)
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for lane, o in enumerate(offsets):
        out += h[o : o + n] * _LANES[lane]
    return mix(out)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of the distinct `size`-word shingles, sorted by doc then hash.

    A text with 1..size-1 words has its whole sequence as its one shingle; none without words.
    """
    counts = np.diff(words.first)
    full = window_hashes(words.hash, list(range(size)))
    doc = words.doc
    inside = doc[: len(full)] == doc[size - 1 :] if len(full) else np.zeros(0, bool)
    docs, hashes = [doc[: len(full)][inside]], [full[inside]]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            at = words.first[short]
            acc = np.full(len(short), n * 0x2545F4914F6CDD1D & (2**64 - 1), dtype=np.uint64)
            for k in range(n):
                acc += words.hash[at + k] * _LANES[32 + k]
            docs.append(short)
            hashes.append(mix(acc))
    d, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    if len(d):
        keep = np.ones(len(d), bool)
        keep[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        d, h = d[keep], h[keep]
    return d, h
