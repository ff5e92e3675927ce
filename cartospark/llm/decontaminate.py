"""Benchmark decontamination by spaced seeds.

A seed is a window of words under a fixed mask; masked-out positions may hold any word, so a substituted
word breaks the seeds that look at it and leaves the others.  Equal seed hashes of a text and a test item
give a diagonal (text position - item position); along it the two are compared word by word.  An item of
up to WHOLE words needs LEAST_SHARE of its words, a longer one LEAST_MATCH equal words in the
stretch that scores best (match +1, substitution -SUBSTITUTION).

How it scales:

* All texts are hashed once.  A bit table of the items' seeds, of a fixed size at most, sends on only
  positions that may have a partner; more seeds than it takes mean more passes, each for its part of the hashes.
* What is left of the texts' seeds is joined with the items' seeds by hash, one row for a text and a seed with all their
  positions, so that a word that fills a text is one row.  Equal texts are one text up to here.
* The candidates, a list of items and diagonals for each text that has any, go back to the texts by their hash, broadcast
  if their checked size allows, and only those texts are compared.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import Scratch, free_names
from .words import bare_hashes, hash_words, mix, slices, text_buffers, window_hashes

#: Fixed masks: 1 takes the word, 0 ignores it.  Every stretch that verification accepts, of whatever length, has a
#: hit of one of them; the tests walk all patterns.
MASKS = ("1111", "11011", "11101", "10111", "110011")
SHORTEST = min(map(len, MASKS)) + 1  # items with fewer words are found as whole texts
WHOLE = 17
LEAST_SHARE_PERCENT = 75
LEAST_MATCH = 13
SUBSTITUTION = 2
TABLE_BITS = 28  # of the seeds' bit table at most: 32 MB
SEEDS_PER_PASS = 1 << 22
BROADCAST_BYTES = 32 << 20
CELLS = 4_000_000  # word pairs that are compared at once

OVERLAP = T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("item_start", T.LongType()), T.StructField("matched", T.LongType()),
])

_U = np.uint64
_SLICES = 64
_SALTS = mix(np.arange(1, len(MASKS) + SHORTEST + 1, dtype=np.uint64))


def _need(size: int) -> int:
    """Equal words that an item of so many words needs."""
    if size < SHORTEST:
        return size
    return -(-LEAST_SHARE_PERCENT * size // 100) if size <= WHOLE else LEAST_MATCH


def seeds(hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(seed, text, word) of every mask at every place, and of short texts as wholes."""
    sizes = np.diff(first)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    for k, mask in enumerate(MASKS):
        offsets = [i for i, c in enumerate(mask) if c == "1"]
        h = window_hashes(hashes, offsets)
        if len(h):
            at = np.flatnonzero(doc[: len(h)] == doc[len(mask) - 1 :])
            yield h[at] ^ _SALTS[k], doc[at], at - first[doc[at]]
    for n in range(1, SHORTEST):
        short = np.flatnonzero(sizes == n)
        h = np.full(len(short), _SALTS[len(MASKS) + n - 1])
        for k in range(n):
            h = mix(h + hashes[first[short] + k])
        yield h, short, np.zeros(len(short), np.int64)


def _grouped(seed: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(doc, seed, places as bytes), one row for each text and seed."""
    order = np.lexsort((at, seed, doc))
    seed, doc, at = seed[order], doc[order], at[order].astype(np.int32)
    fresh = np.ones(len(seed), bool)
    fresh[1:] = (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])
    cuts = np.append(np.flatnonzero(fresh), len(seed))
    return doc[fresh], seed[fresh].view(np.int64), [at[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]


def _words(texts) -> tuple[np.ndarray, np.ndarray]:
    words = hash_words(*text_buffers(texts))
    return bare_hashes(words), words.first


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, words): the items that have words; words are 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, first = _words(batch.column("text"))
            rows = [hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.binary())], ["item_id", "words"])

    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    return rows.mapInArrow(run, "item_id long, words binary").where(F.octet_length("words") > 0).withColumn("item", F.monotonically_increasing_id())


def _item_seeds(items: DataFrame) -> DataFrame:
    """(item, seed, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("words").to_pylist()
            first = np.concatenate([[0], np.cumsum([len(x) // 8 for x in raw])]).astype(np.int64)
            for found in seeds(np.frombuffer(b"".join(raw), _U), first):
                doc, seed, places = _grouped(*found)
                yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(doc)), pa.array(seed), pa.array(places, pa.binary())], ["item", "seed", "places"])

    return items.select("item", "words").mapInArrow(run, "item long, seed long, places binary")


def _table(found: DataFrame, bits: int, turn: int, turns: int) -> np.ndarray:
    """Bit table of the seeds of this turn."""
    span = 1 << (bits - 6)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seed = batch.column("seed").to_numpy().view(_U)
            slot = np.unique((seed[seed % _U(turns) == _U(turn)] >> _U(64 - bits)).astype(np.int64))
            cuts = np.searchsorted(slot, np.arange(_SLICES + 1) * span)
            rows = [(slot[a:b] % span).astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array(rows, pa.binary())], ["slice", "slots"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros(span, bool)
        table[np.frombuffer(b"".join(pdf["slots"]), np.int32)] = True
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "table": [np.packbits(table, bitorder="little").tobytes()]})

    out = np.zeros(1 << (bits - 3), np.uint8)
    for k, table in found.select("seed").mapInArrow(cut, "slice int, slots binary").groupBy("slice").applyInPandas(merge, "slice int, table binary").collect():  # 2^bits bits
        out[k * span // 8 : (k + 1) * span // 8] = np.frombuffer(table, np.uint8)
    return out


def _text_key(text_col: str, a: str, b: str) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(F.col(f"`{text_col}`")).alias(a), F.xxhash64(F.lit(1), F.col(f"`{text_col}`")).alias(b)]


def _hits(df: DataFrame, text_col: str, table: np.ndarray, turn: int, turns: int) -> DataFrame:
    """(k1, k2, seed, at): the seeds of every text that the table holds, with their places."""
    held = df.sparkSession.sparkContext.broadcast(table)
    bits = len(table).bit_length() + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            for part, data, bounds in slices(batch, "text"):
                words = hash_words(data, bounds)
                rows = []
                for seed, doc, at in seeds(bare_hashes(words), words.first):
                    slot = seed >> _U(64 - bits)
                    on = ((table[(slot >> _U(3)).astype(np.int64)] >> (slot & _U(7)).astype(np.uint8)) & 1).astype(bool)
                    if turns > 1:
                        on &= seed % _U(turns) == _U(turn)
                    rows.append((seed[on], doc[on], at[on]))
                doc, seed, places = _grouped(*(np.concatenate(x) for x in zip(*rows)))
                doc = pa.array(doc)
                yield pa.RecordBatch.from_arrays([part.column("k1").take(doc), part.column("k2").take(doc), pa.array(seed), pa.array(places, pa.binary())], ["k1", "k2", "seed", "at"])

    texts = df.select(*_text_key(text_col, "k1", "k2"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    return texts.mapInArrow(run, "k1 long, k2 long, seed long, at binary")


def _diagonals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, item, diagonal) of joined seeds, each once for a text, an item and a seed."""
    for batch in batches:
        rows, found = [], []
        for r, (at, places) in enumerate(zip(batch.column("at").to_pylist(), batch.column("places").to_pylist())):
            at, places = np.frombuffer(at, np.int32).astype(np.int64), np.frombuffer(places, np.int32)
            step = max(1, CELLS // len(places))
            own = np.unique(np.concatenate([np.unique(at[i : i + step, None] - places) for i in range(0, len(at), step)]))
            rows.append(np.full(len(own), r))
            found.append(own)
        if rows:
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("k1", "k2", "item")), pa.array(np.concatenate(found))], ["k1", "k2", "item", "diagonal"])


def candidates(df: DataFrame, benchmark: DataFrame, text_col: str, item_id: str, item_text: str, scratch: Scratch) -> tuple[DataFrame, int]:
    """((k1, k2, items): for every text that has any, the items with a common seed, their words and the diagonals; their bytes)."""
    items = scratch.keep(_items(benchmark, item_id, item_text), "items")
    own = scratch.keep(_item_seeds(items), "seeds")
    count = own.count()
    turns = -(-count // SEEDS_PER_PASS) or 1
    bits = max(12, min(TABLE_BITS, (1024 * count // turns).bit_length()))
    hits = None
    for turn in range(turns):
        found = _hits(df, text_col, _table(own, bits, turn, turns), turn, turns)
        hits = found if hits is None else hits.union(found)
    hits = hits.dropDuplicates(["k1", "k2", "seed"])  # equal texts
    pairs = hits.join(own, "seed").select("k1", "k2", "item", "at", "places").mapInArrow(_diagonals, "k1 long, k2 long, item long, diagonal long")
    pairs = pairs.groupBy("k1", "k2", "item").agg(F.collect_set("diagonal").alias("diagonals")).join(items, "item")
    size = Observation()
    lists = pairs.groupBy("k1", "k2").agg(F.collect_list(F.struct("item_id", "words", "diagonals")).alias("items"))
    cost = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["words"]) + 8 * F.size(x["diagonals"]) + 64)
    lists = scratch.keep(lists.observe(size, F.coalesce(F.sum(cost), F.lit(0)).alias("bytes")), "candidates")
    scratch.drop("items", "seeds")
    return lists, size.get["bytes"]


def verify(text: np.ndarray, item: np.ndarray, diagonals: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(start, end, item start, matched) of the item's overlaps with the text, in words; of those that overlap each other in the
    text the one with most equal words."""
    size, found = len(item), []
    need, step = _need(size), np.arange(size)
    rows = max(1, CELLS // size)
    for lo in range(0, len(diagonals), rows):
        base = np.sort(diagonals)[lo : lo + rows]
        at = base[:, None] + step
        inside = (at >= 0) & (at < len(text))
        equal = (text[np.clip(at, 0, len(text) - 1)] == item) & inside
        if size <= WHOLE:
            matched, start, end = equal.sum(axis=1), equal.argmax(axis=1), size - 1 - equal[:, ::-1].argmax(axis=1)
        else:  # of equally good stretches the one with more equal words
            unit = 1 << 32
            total = np.cumsum(np.where(equal, unit + 1, -SUBSTITUTION * unit), axis=1)
            before = np.concatenate([np.zeros((len(base), 1), np.int64), total[:, :-1]], axis=1)
            low = np.minimum.accumulate(before, axis=1)
            end = np.argmax(total - low, axis=1)
            pick = np.arange(len(base))
            start = np.argmax(before == low[pick, end][:, None], axis=1)
            hits = np.concatenate([np.zeros((len(base), 1), np.int64), np.cumsum(equal, axis=1)], axis=1)
            matched = hits[pick, end + 1] - hits[pick, start]
        for r in np.flatnonzero(matched >= need).tolist():
            if size >= SHORTEST or len(text) == size:
                found.append((int(base[r] + start[r]), int(base[r] + end[r]) + 1, int(start[r]), int(matched[r])))
    kept: list[tuple[int, int, int, int]] = []
    for x in sorted(found, key=lambda x: (-x[3], x)):
        i = bisect_left(kept, x)
        if (i == 0 or kept[i - 1][1] <= x[0]) and (i == len(kept) or x[1] <= kept[i][0]):
            kept.insert(i, x)
    return kept


def find_overlaps(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", out_col: str = "overlaps") -> DataFrame:
    """df with `out_col`: array of (item_id, start, end, item_start, matched) for every verified overlap.

    start and end count words of the text, end excluded.  Words are lower-cased A-Z and compared without the
    punctuation round them.  Of an item's overlaps that overlap each other in the text, the best is given.  A null or empty
    text has no overlaps, an empty benchmark gives none; null items and those without words are
    not looked for, and an item under SHORTEST words is found in texts that are nothing but it.  Items with a null id keep a
    null item_id.  Repeated rows are searched alike.  A word that is inserted or left out ends a stretch.
    A column of df named `out_col` is replaced.
    """
    left = [c for c in df.columns if c.lower() != out_col.lower()]
    lists, size = candidates(df, benchmark, text_col, item_id, item_text, Scratch(df.sparkSession, "decontaminate"))
    a, b, items, x, y = free_names(df.columns, "k1", "k2", "items", "x", "y")
    lists = lists.toDF(x, y, items)
    keyed = df.select(*[F.col(f"`{c}`") for c in left], *_text_key(text_col, a, b))
    joined = keyed.join(F.broadcast(lists) if size <= BROADCAST_BYTES else lists, (F.col(a) == F.col(x)) & (F.col(b) == F.col(y)), "left")
    schema = T.StructType([df.schema[c] for c in left] + [T.StructField(out_col, T.ArrayType(OVERLAP))])
    kind = pa.list_(pa.struct([(f.name, pa.int64()) for f in OVERLAP]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists: list[list] = [[] for _ in range(batch.num_rows)]
            for r in np.flatnonzero(~np.asarray(batch.column(items).is_null())).tolist():
                text, _ = _words(batch.column(text_col).slice(r, 1))
                for item in batch.column(items)[r].as_py():
                    for found in verify(text, np.frombuffer(item["words"], _U), np.array(item["diagonals"], np.int64)):
                        lists[r].append(dict(zip(OVERLAP.names, (item["item_id"], *found))))
                lists[r].sort(key=lambda o: tuple((v is None, v or 0) for v in o.values()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in left] + [pa.array(lists, kind)], schema.names)

    return joined.select(*[F.col(f"`{c}`") for c in left], items).mapInArrow(run, schema)


def decontaminate(df: DataFrame, benchmark: DataFrame, text_col: str = "text", **names) -> DataFrame:
    """The rows of df that overlap no test item (see find_overlaps), with df's columns."""
    (out,) = free_names(df.columns, "overlaps")
    return find_overlaps(df, benchmark, text_col, out_col=out, **names).where(F.size(out) == 0).drop(out)
