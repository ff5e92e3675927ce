"""Quality rules with compression bands.

Every text gets plain counts (words, symbols, repeated lines and windows) and two kinds of zstandard
ratio, raw bytes / compressed bytes: of the whole text and of each fixed chunk of it, the last of which ends with the text.  Repetitive
text compresses too well, noise hardly at all; the limits depend on the length, as short texts carry the
frame's overhead and long ones find more matches.  All is computed inside one Arrow pass, a megabyte of
text at a time, with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .words import Words, hash_words, slices, window_hashes

_U = np.uint64

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """From `least` bytes on: ratios in [low, high] are those of ordinary text."""

    least: int
    low: float
    high: float


#: The lower limits lie between noise (words of random letters and digits: 0.9 at 100 bytes, 1.36 at most) and prose (1.14 at 100
#: bytes, 1.47 at 512, 2.1 at 4096); the upper ones above prose of which a third repeats.
WHOLE = (
    Band(0, 0.0, 2.5), Band(100, 0.98, 2.8), Band(128, 1.09, 3.0), Band(192, 1.14, 3.2), Band(256, 1.22, 3.4), Band(384, 1.29, 3.5), Band(512, 1.34, 3.6), Band(768, 1.42, 3.8), Band(1024, 1.48, 4.0),
    Band(1536, 1.52, 4.2), Band(2048, 1.56, 4.4), Band(4096, 1.6, 4.8), Band(16384, 1.65, 5.5), Band(131072, 1.65, 7.0),
)
CHUNK_BYTES = 4096
#: A chunk outside this band is bad.
CHUNK = Band(CHUNK_BYTES, 1.55, 5.0)
#: More than so many percent bad chunks reject the text.
BAD_CHUNKS_PERCENT = 20

_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))

FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()), T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()), T.StructField("n_repeat_words", T.LongType()), T.StructField("ratio", T.DoubleType()),
    T.StructField("n_chunks", T.LongType()), T.StructField("n_bad_chunks", T.LongType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()),
]


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeats(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): positions sorted by (doc, h), and whether each equals the one before it."""
    key = h + doc.astype(_U) * _U(0x9E3779B97F4A7C15)
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    if len(key):
        k, d = key[order], doc[order]
        same[1:] = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    return order, same


def repeated_words(words: Words, window: int = 8) -> np.ndarray:
    """Words of each text that lie in a window of so many words found twice or more in it."""
    h = window_hashes(words.hash, list(range(window)))
    if not len(h):
        return np.zeros(words.n_docs, np.int64)
    doc = words.doc
    inside = np.flatnonzero(doc[: len(h)] == doc[window - 1 :])
    order, same = _repeats(doc[inside], h[inside])
    twice = same.copy()
    twice[:-1] |= same[1:]
    at = inside[order[twice]]
    steps = np.zeros(len(doc) + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + window, -1)
    return _per_doc(np.cumsum(steps[:-1]) > 0, words.first)


def repeated_lines(words: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same text."""
    data, bounds = words.data, words.bounds
    cuts = np.unique(np.concatenate([bounds, np.flatnonzero(data == 10) + 1]))
    start, end = cuts[:-1], cuts[1:].copy()
    if not len(start):
        return np.zeros(words.n_docs, np.int64)
    end -= data[end - 1] == 10
    used = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[used], end[used]
    doc = np.searchsorted(bounds, start, "right") - 1
    order, same = _repeats(doc, words.spans(start, end))
    return np.bincount(doc[order[same]], minlength=words.n_docs)


def _band(bands: tuple[Band, ...], size: int) -> Band:
    return next(b for b in reversed(bands) if size >= b.least)


def _measure(data: np.ndarray, bounds: np.ndarray, whole: tuple[Band, ...], chunk: Band, bad_percent: int) -> list[np.ndarray]:
    words = hash_words(data, bounds, lower=False)
    n_words = np.diff(words.first)
    inside = ((data & 0xC0) != 0x80) & ~words.space
    repeat = repeated_words(words)
    base_failed = (n_words < 20) | (100 * repeat > 30 * n_words)
    pack, view = zstandard.ZstdCompressor(level=3), memoryview(data)
    ratio, n_chunks, n_bad, kept = [], [], [], []
    for lo, hi, failed in zip(bounds[:-1].tolist(), bounds[1:].tolist(), base_failed.tolist()):
        size = hi - lo
        full = size / len(pack.compress(view[lo:hi])) if size else 0.0
        places = [*range(lo, hi - chunk.least + 1, chunk.least)]
        if places and places[-1] + chunk.least < hi:
            places.append(hi - chunk.least)
        parts = [chunk.least / len(pack.compress(view[a : a + chunk.least])) for a in places]
        bad = sum(not chunk.low <= r <= chunk.high for r in parts)
        band = _band(whole, size)
        ratio.append(full)
        n_chunks.append(len(parts))
        n_bad.append(bad)
        kept.append(not failed and band.low <= full <= band.high and 100 * bad <= bad_percent * len(parts))
    counts = [n_words, _per_doc(inside, bounds), _per_doc(_SYMBOL[data], bounds), repeated_lines(words), repeat]
    return [np.asarray(c, np.int64) for c in counts] + [np.array(ratio), np.array(n_chunks, np.int64), np.array(n_bad, np.int64), base_failed, np.array(kept, bool)]


def quality_rules(df: DataFrame, text_col: str = "text", prefix: str = "", whole: tuple[Band, ...] = WHOLE, chunk: Band = CHUNK, bad_percent: int = BAD_CHUNKS_PERCENT) -> DataFrame:
    """df with the counts, ratios and verdict of FIELDS added, each named `prefix` + its name.

    A null text counts as empty: no words, ratio 0, base_failed, not kept.  Very long texts are compressed whole.
    Repeated rows are judged alike, each on its own.  A column of df that has the name of an added one is replaced.
    """
    names = [prefix + f.name for f in FIELDS]
    left = [c for c in df.columns if c not in names]
    schema = T.StructType([df.schema[c] for c in left] + [T.StructField(n, f.dataType) for n, f in zip(names, FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in slices(batch, text_col):
                added = [pa.array(a) for a in _measure(data, bounds, whole, chunk, bad_percent)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in left] + added, left + names)

    return df.mapInArrow(run, schema)
