"""Token ids in byte-aligned variable-length files.

Ids are replaced by frequency ranks (rank 0 the most frequent id of the corpus), and ranks are stored in 1 to 4
bytes, the shortest that holds them.  Lengths stand apart from the data: a control byte holds four 2-bit
lengths.  Frequent ids take one byte, and a block decodes with numpy alone: a table gives each control byte's
four lengths, a running sum gives every rank's place.

File format (one row of a Parquet file per segment; Spark's writer commits it, so it lives in any
store that Spark reaches):

    segment  long    ascending; documents are in ascending id order across segments
    ids      array   document ids, one per document of the segment
    sizes    array   ids stored for each document, its end id included
    control  binary  one byte for every four ranks, lowest bits first; length - 1
    data     binary  the ranks' bytes, low byte first

with the rank table beside it (`ranks`: rank, id, occurrences).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import Scratch
from .words import prefix_hash, slices, span_hashes

SEGMENT_IDS = 1 << 20
BROADCAST_SEGMENTS = 500_000
MEMO_CHUNKS = 1_500_000  # distinct chunks whose ids a worker remembers


# --- variable-length coding ----------------------------------------------------------------------

_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    quad = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    quad[: len(ranks)] = size - 1
    control = (quad.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    ends = np.cumsum(size, dtype=np.int64)
    starts, out = ends - size, np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[starts] = ranks & 0xFF
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        out[starts[more] + k] = (ranks[more] >> np.uint32(8 * k)) & 0xFF
    return control.tobytes(), out.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ranks back, by table lookup."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    ends = np.cumsum(size, dtype=np.int64)
    raw = np.frombuffer(data, np.uint8)
    starts = ends - size
    out = raw[starts].astype(np.uint32) if count else np.zeros(0, np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        out[more] |= raw[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


# --- encoding texts ------------------------------------------------------------------------------


class ChunkEncoder:
    """Byte-level BPE of whole texts through the tokenizers library, remembering chunks.

    The pre-tokenizer never joins a space and what stands before it, so a text whose white space comes one
    character at a time may be cut before each space and the pieces encoded apart, with the same ids.  For the same reason
    it may be cut round a line feed, and between a letter and the one full stop or comma that ends the piece.  Texts
    with other white space, or with the string of an added token, go to the library whole.

    Chunks are known by 64-bit hashes; a worker remembers MEMO_CHUNKS of them, the latest also in a direct-mapped table.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}  # hash: number; -1 for the end of a text
        self.first = np.zeros(1 << 16, np.int64)  # where a number's ids begin
        self.ids = np.zeros(1 << 18, np.uint32)
        self.slot_hash, self.slot_number = np.zeros(1 << _SLOT_BITS, np.uint64), np.zeros(1 << _SLOT_BITS, np.int32)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for i in range(0, len(texts), 50_000) for e in self.tokenizer.encode_batch_fast(texts[i : i + 50_000], add_special_tokens=False)]

    def _put(self, hashes: list[int], found: list[list[int]]) -> np.ndarray:
        """Numbers of new chunks with these ids."""
        old, sizes = len(self.known), np.fromiter(map(len, found), np.int64, len(found))
        while old + len(found) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        ends = self.first[old] + np.cumsum(sizes)
        while ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.first[old] : ends[-1]] = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        self.first[old + 1 : old + 1 + len(found)] = ends
        self.known.update(zip(hashes, range(old, old + len(found))))
        return np.arange(old, old + len(found))

    def _numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = span_hashes(prefix_hash(data), start, end)
        slot = (h >> _U(64 - _SLOT_BITS)).astype(np.int64)
        out = self.slot_number[slot].astype(np.int64)
        miss = np.flatnonzero(self.slot_hash[slot] != h)
        if len(miss):
            keys, at, back = np.unique(h[miss], return_index=True, return_inverse=True)
            names = keys.tolist()
            numbers = np.fromiter((self.known.get(k, -1) for k in names), np.int64, len(names))
            new = np.flatnonzero(numbers < 0)
            if len(new):
                raw, spans = data.tobytes(), miss[at[new]]
                texts = [raw[a:b].decode() for a, b in zip(start[spans].tolist(), end[spans].tolist())]
                numbers[new] = self._put(keys[new].tolist(), self._library(texts))
            out[miss] = numbers[back]
            self.slot_hash[slot[miss]], self.slot_number[slot[miss]] = h[miss], out[miss]
        return out

    def __call__(self, data: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, each followed by end_id; how many of them each text has)."""
        if len(self.known) > MEMO_CHUNKS:
            self._forget()
        odd = _irregular(data, bounds, self.added)
        start, end, doc = _chunks(data, bounds, odd)
        numbers = self._numbers(data, start, end)
        # every text ends with one more chunk, whose only id is end_id
        stop = self.known.get(-1)
        if stop is None:
            stop = int(self._put([-1], [[end_id]])[0])
        n_docs = len(bounds) - 1
        per_doc = np.bincount(doc, minlength=n_docs)
        numbers = np.insert(numbers, np.cumsum(per_doc), stop)
        counts = self.first[numbers + 1] - self.first[numbers]
        ends = np.cumsum(counts)
        at = np.repeat(self.first[numbers] - (ends - counts), counts)
        at += np.arange(len(at))
        ids = self.ids[at]
        last = np.concatenate([[0], ends[np.cumsum(per_doc + 1) - 1]]) if n_docs else np.zeros(1, np.int64)
        sizes = np.diff(last)
        if odd.any():
            raw, places = data.tobytes(), np.flatnonzero(odd)
            whole = self._library([raw[bounds[d] : bounds[d + 1]].decode() for d in places])
            parts = np.split(ids, last[1:-1])
            for d, found in zip(places.tolist(), whole):
                parts[d] = np.array([*found, end_id], np.uint32)
                sizes[d] = len(found) + 1
            ids = np.concatenate(parts)
        return ids, sizes


_SLOT_BITS = 20
_U = np.uint64
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_ASCII_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])


def _irregular(data: np.ndarray, bounds: np.ndarray, added: list[bytes]) -> np.ndarray:
    """Texts with two white-space characters in a row, white space beyond ASCII, or an added token's string."""
    space = _SPACE[data]
    bad = np.zeros(len(data) + 1, np.int32)
    flag = np.zeros(len(data), bool)
    flag[1:] = space[1:] & space[:-1]
    inner = bounds[1:-1]
    flag[inner[inner < len(data)]] = False  # the pair lies in two texts
    for at in np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3))) if (data >= 0xC2).any() else ():
        flag[at] |= data[at : at + 3].tobytes() in _WIDE or data[at : at + 2].tobytes() in _WIDE
    for token in added:
        raw, at = data.tobytes(), -1
        while (at := raw.find(token, at + 1)) >= 0:
            flag[at] = True
    np.cumsum(flag, out=bad[1:])
    return bad[bounds[1:]] > bad[bounds[:-1]]


#: UTF-8 of the white-space characters beyond ASCII.
_WIDE = frozenset(chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def _chunks(data: np.ndarray, bounds: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the chunks of all texts that aren't odd."""
    n = len(data)
    opens = np.zeros(n + 2, bool)
    opens[bounds] = True
    opens[:n] |= data == 32
    feed = np.flatnonzero(data == 10)
    opens[feed] = opens[feed + 1] = True
    # a full stop or comma that ends a chunk, after a letter
    mark = np.flatnonzero((data == 44) | (data == 46))
    mark = mark[opens[mark + 1] & (mark > 0)]
    mark = mark[_ASCII_LETTER[data[mark - 1]] & ~opens[mark]]
    opens[mark] = True
    start = np.flatnonzero(opens[:n])
    doc = np.searchsorted(bounds, start, "right") - 1
    end = np.append(start[1:], n)
    keep = ~odd[doc]
    return start[keep], end[keep], doc[keep]


_encoders: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    """One for each worker process, so that later tasks find what earlier ones learned."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def encode_documents(df: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """(id, ids binary): the encoded text and its end id, as little-endian unsigned 16-bit or 32-bit ids."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            for part, data, bounds in slices(batch, text_col):
                ids, sizes = encoder(data, bounds, end_id)
                ends = np.cumsum(sizes)
                rows = [_narrow(ids[e - s : e]) for s, e in zip(sizes.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(rows, pa.binary())], ["id", "ids"])

    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids binary")


def _narrow(ids: np.ndarray) -> bytes:
    """A first byte 2 or 4 tells the width."""
    return b"\x02" + ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else b"\x04" + ids.astype("<u4").tobytes()


def _joined(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all documents end to end, how many each has)."""
    sizes = np.array([(len(x) - 1) // x[0] for x in raws], np.int64)
    if all(x[0] == 2 for x in raws):
        return np.frombuffer(b"".join([x[1:] for x in raws]), "<u2"), sizes
    return np.concatenate([np.frombuffer(x, "<u2" if x[0] == 2 else "<u4", offset=1).astype(np.uint32) for x in raws]), sizes


def count_ids(encoded: DataFrame) -> DataFrame:
    """(id, c): occurrences of every id over all documents."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            raws = batch.column("ids").to_pylist()
            for i in range(0, len(raws), 1000):
                c = np.bincount(_joined(raws[i : i + 1000])[0])
                if len(c) > len(total):
                    c[: len(total)] += total
                    total = c
                else:
                    total[: len(c)] += c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "c"])

    return encoded.select("ids").mapInArrow(run, "id long, c long").groupBy("id").agg(F.sum("c").alias("c"))


# --- files ---------------------------------------------------------------------------------------

_SEGMENT = "segment long, ids array<{}>, sizes array<long>, control binary, data binary"


def write_token_file(df: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Writes `folder`/segments and `folder`/ranks, documents in ascending id order (nulls first, ties by a hash of their token ids, then by those).

    A null text is empty: its end id alone.  An empty table gives empty tables.  Other columns of df are left out.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "tokens")
    encoded = scratch.keep(encode_documents(df, tokenizer, id_col, text_col, end_id), "encoded", compression="zstd")
    order = Window.orderBy(F.desc("c"), "id")  # at most one row per id of the vocabulary
    ranks = count_ids(encoded).withColumn("rank", F.row_number().over(order) - 1)
    ranks.select("rank", "id", F.col("c").alias("occurrences")).coalesce(1).write.parquet(f"{folder}/ranks")
    held = spark.sparkContext.broadcast(_rank_of(spark, folder))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        segment = TaskContext.get().partitionId() << 32
        for lo_ids, lo_raw in _segments(batches):
            ids, sizes = _joined(lo_raw)
            control, data = pack(held.value[ids])
            row = [[segment], [lo_ids], [sizes.tolist()], [control], [data]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, arrow)], names)
            segment += 1

    schema = T.StructType.fromDDL(_SEGMENT.format(kind))
    from pyspark.sql.pandas.types import to_arrow_type

    names, arrow = schema.names, [to_arrow_type(f.dataType) for f in schema.fields]
    size = encoded.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    parts = max(1, -(-size // (16 << 20)))
    sorted_rows = encoded.repartitionByRange(parts, "id", F.xxhash64("ids")).sortWithinPartitions("id", F.xxhash64("ids"), "ids")
    sorted_rows.mapInArrow(run, schema).write.parquet(f"{folder}/segments")
    scratch.drop("encoded")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    ids, raws, n = [], [], 0
    for batch in batches:
        for i, raw in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist()):
            ids.append(i)
            raws.append(raw)
            n += len(raw)
            if n >= SEGMENT_IDS * 2:
                yield ids, raws
                ids, raws, n = [], [], 0
    if ids:
        yield ids, raws


def _rank_table(spark: SparkSession, folder: str) -> list:
    """At most one row for each id of the vocabulary."""
    return spark.read.schema("rank int, id long, occurrences long").parquet(f"{folder}/ranks").collect()


def _rank_of(spark: SparkSession, folder: str) -> np.ndarray:
    rows = _rank_table(spark, folder)
    out = np.zeros(max((r.id for r in rows), default=0) + 1, np.uint32)
    for r in rows:
        out[r.id] = r.rank
    return out


def read_token_file(spark: SparkSession, folder: str, per_doc: Callable[[np.ndarray], bytes] | None = None, id_type: str = "long") -> DataFrame:
    """(id, start, n_tokens, ids_crc32, ids binary or null) of every document, decoded from the files.

    start counts the ids of all documents before it; ids_crc32 is that of the ids as little-endian unsigned 32-bit integers;
    ids are those bytes if `per_doc` is given, as it returns them.
    """
    rows = _rank_table(spark, folder)
    table = np.zeros(len(rows), np.uint32)
    for r in rows:
        table[r.rank] = r.id
    held = spark.sparkContext.broadcast(table)
    segments = spark.read.schema(_SEGMENT.format(id_type)).parquet(f"{folder}/segments")
    totals = segments.select("segment", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    # two levels, so that no task sees all segments: files, then segments within a file
    file = F.shiftright("segment", 32)
    per_file = totals.groupBy(file.alias("file")).agg(F.sum("n").alias("n"))
    before = per_file.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    within = F.sum("n").over(Window.partitionBy(file).orderBy("segment")) - F.col("n")
    starts = totals.withColumn("within", within).withColumn("file", file).join(before, "file").select("segment", (F.col("before") + F.col("within")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sizes = np.array(batch.column("sizes")[k].as_py(), np.int64)
                ids = held.value[unpack(batch.column("control")[k].as_py(), batch.column("data")[k].as_py(), int(sizes.sum()))].astype("<u4")
                ends = np.cumsum(sizes)
                starts = ends - sizes + batch.column("first")[k].as_py()
                docs = [ids[e - s : e] for s, e in zip(sizes, ends)]
                sums = pa.array([crc32(d.tobytes()) for d in docs], pa.int64())
                extra = pa.array([per_doc(d) if per_doc else None for d in docs], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values, pa.array(starts), pa.array(sizes), sums, extra], ["id", "start", "n_tokens", "ids_crc32", "ids"])

    if totals.count() <= BROADCAST_SEGMENTS:
        starts = F.broadcast(starts)  # two longs a segment, checked
    return segments.join(starts, "segment").mapInArrow(run, f"id {id_type}, start long, n_tokens long, ids_crc32 long, ids binary")
