"""N-gram Jaccard join by prefix filters under several global token orders.

Every text is its set of distinct word shingles.  Two sets with Jaccard similarity >= t must share a
token among the first few tokens of *any* global order, so a pair becomes a candidate only if it does
so under each of several orders; only then are the whole sets compared.

How it scales:

* Equal sets collapse to one class first, so exact copies never meet in the join.
* Orders put rare tokens first: a token's level (seen once, a few times, often, very often) comes from
  counts over all documents, held in fixed-size bit tables, and a seeded hash orders each level.  Levels
  only steer efficiency; a hash collision in them can't lose a link.  Their thresholds rise with the tables' load.
* A text with enough once-seen tokens can't have a partner and ends there; of the remaining *suspects* only the prefix moves.
* Suspects that share prefix tokens of the first order gather round a common head, and heads that are alike (by a minimum hash) make one
  group, so that a crowd of near copies falls into a few groups. What may be compared are blocks: a group
  with itself, and the sets of two groups that hold a prefix token of each other's.  Every pair of sets with a common prefix
  token is in exactly one of them.  Blocks are cut by tokens, so that none needs more than CHUNK_TOKENS of either side in memory.
* The tables fill up as the corpus grows, and then texts share prefix tokens by chance. So a set stays in a block only if it shares a
  token with another one there under the later orders too, told by 32 bits of each prefix token; the whole sets of those that stay are fetched, by
  another pass over the texts.
* A block looks at two sets only after the filters of all orders let the pair pass.  It returns a star for each of its
  components and each set's number of links, never pairs.

Nothing is capped: each linked pair of different sets is found and counted once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .store import Scratch, free_names
from .words import hash_words, mix, shingles, slices

ORDERS = 3
LEVELS = (2, 8, 64)  # a token seen fewer times than LEVELS[0] has level 0, and so on
TABLE_BITS = 27  # of the first level's bit table at most, three less of the others: 20 MB together, whatever the input
BUCKET_TOKENS = 1_000_000
BROADCAST_SETS = 1_000_000
CHUNK_TOKENS = 1 << 18

_U = np.uint64
_SEEDS = mix(np.arange(11, 11 + ORDERS, dtype=np.uint64))


def _signature(docs: np.ndarray, hashes: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(set size, order-free 64-bit digest) of each document's set."""
    sizes = np.bincount(docs, minlength=n_docs)
    ends = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes ^ _U(0x51)), out=ends[1:])
    last = np.cumsum(sizes)
    return sizes, mix(ends[last] - ends[last - sizes] + sizes.astype(np.uint64)).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], column: str, size: int):
    """Slices of the input with (docs, hashes, sizes, digests)."""
    for batch in batches:
        for part, data, bounds in slices(batch, column):
            words = hash_words(data, bounds)
            docs, hashes = shingles(words, size)
            yield part, docs, hashes, *_signature(docs, hashes, words.n_docs)


def _fresh(seen: set, sizes: np.ndarray, sigs: np.ndarray) -> np.ndarray:
    """True for the first row of each set in this task. Forgetting (when large) only repeats work."""
    if len(seen) > 300_000:
        seen.clear()
    out = np.zeros(len(sigs), bool)
    for i, key in enumerate((sigs ^ (sizes.astype(np.int64) << 40)).tolist()):
        if key not in seen:
            seen.add(key)
            out[i] = True
    return out


def set_sizes(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, n, sig) for every row; rows with equal sets have equal (n, sig). sig is 0 for the empty set."""

    def run(batches):
        for part, _, _, sizes, sigs in _sets(batches, text_col, size):
            sigs = np.where(sizes > 0, sigs, 0)
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(sizes.astype(np.int64)), pa.array(sigs)], ["id", "n", "sig"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, n long, sig long")


def _level_tables(df: DataFrame, text_col: str, size: int, total: int) -> list[np.ndarray]:
    """For each of LEVELS, a bit table of hashed tokens that occur in at least so many sets.

    A slot of the first table counts all tokens that fall into it, so the higher thresholds stand above its mean load.
    """
    fine = max(16, min(TABLE_BITS, int(total).bit_length() + 3))
    wide = [fine, *[fine - 3] * (len(LEVELS) - 1)]
    bits = fine - 16 if fine > 22 else 6  # a slot within its bucket is a number of 16 bits
    salts = max(1, total // (4 * BUCKET_TOKENS << bits))  # groups in which a bucket's tokens are counted before they're summed
    span, load = 1 << (fine - bits), total / (1 << fine)
    least = [LEVELS[0], *(x + load + 6 * load**0.5 for x in LEVELS[1:])]

    def emit(batches):
        from pyspark import TaskContext

        seen: set = set()
        held, n, salt = [], 0, TaskContext.get().partitionId()

        def flush():
            slots = np.sort((np.concatenate(held) >> _U(64 - fine)).astype(np.uint32))
            cuts = np.searchsorted(slots >> np.uint32(fine - bits), np.arange((1 << bits) + 1))
            slots = (slots & np.uint32(span - 1)).astype(np.uint16)
            rows = [slots[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(range(1 << bits), pa.int32()), pa.array(np.full(1 << bits, salt % salts)), pa.array(rows, pa.binary())], ["bucket", "salt", "prints"])

        for _, docs, hashes, sizes, sigs in _sets(batches, text_col, size):
            hashes = mix(hashes[_fresh(seen, sizes, sigs)[docs]])
            held.append(hashes)
            n += len(hashes)
            if n >= BUCKET_TOKENS:
                yield flush()
                held, n, salt = [], 0, salt + 1
        if held:
            yield flush()

    def counted(prints) -> np.ndarray:
        return np.bincount(np.frombuffer(b"".join(prints), np.uint16), minlength=span)

    def row(pdf: pd.DataFrame, counts: np.ndarray) -> pd.DataFrame:
        tables = [counts.reshape(-1, 1 << (fine - b)).max(axis=1) >= x for b, x in zip(wide, least)]
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "tables": [b"".join(np.packbits(t, bitorder="little").tobytes() for t in tables)]})

    found = df.select(text_col).mapInArrow(emit, "bucket int, salt long, prints binary")
    if salts > 1:
        part = lambda pdf: pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "sums": [counted(pdf["prints"]).tobytes()]})
        found = found.groupBy("bucket", "salt").applyInPandas(part, "bucket int, sums binary")
        found = found.groupBy("bucket").applyInPandas(lambda pdf: row(pdf, sum(np.frombuffer(x, np.int64) for x in pdf["sums"])), "bucket int, tables binary")
    else:
        found = found.groupBy("bucket").applyInPandas(lambda pdf: row(pdf, counted(pdf["prints"])), "bucket int, tables binary")
    out = [np.zeros(1 << (b - 3), np.uint8) for b in wide]
    for bucket, tables in found.collect():  # the tables' bits, a fixed size at most
        at = 0
        for b, table in zip(wide, out):
            n = span >> (fine - b) >> 3
            table[bucket * n : (bucket + 1) * n] = np.frombuffer(tables, np.uint8, n, at)
            at += n
    return out


def _levels(tables: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    at = mix(hashes)
    out = np.zeros(len(hashes), np.uint8)
    for table in tables:
        slot = at >> _U(64 - (len(table).bit_length() + 2))  # 2^k bits in 2^(k - 3) bytes
        out += (table[(slot >> _U(3)).astype(np.int64)] >> (slot & _U(7)).astype(np.uint8)) & 1
    return out


def _least_share(n, percent: int):
    """ceil(t * n): the least overlap of a set of n with any partner."""
    return -(-percent * n // 100)


def _suspect_rows(batches, text_col: str, size: int, percent: int, tables: list[np.ndarray]):
    """For each slice (sigs, sizes, hashes, levels, rows): the sets that may have a partner, each once in a task as far as it remembers."""
    seen: set = set()
    for _, docs, hashes, sizes, sigs in _sets(batches, text_col, size):
        level = _levels(tables, hashes)
        once = np.bincount(docs[level == 0], minlength=len(sizes))
        spare = sizes - _least_share(sizes, percent)  # a partner may miss so many tokens
        # the nearest different set is the set and one token more
        pick = np.flatnonzero((once <= spare) & (100 * sizes >= percent * (sizes + 1)))
        pick = pick[_fresh(seen, sizes[pick], sigs[pick])]
        ends = np.cumsum(sizes)
        yield sigs, sizes, hashes, level, [(i, slice(ends[i] - sizes[i], ends[i])) for i in pick.tolist()]


def _suspects(df: DataFrame, text_col: str, size: int, percent: int, held) -> DataFrame:
    """(sig, n, kin, toks, places): one row per set that may have a partner, with its prefix of the first order.

    kin is the token, of all those that are seen more than once, of the least hash: sets as alike as their Jaccard similarity have the same.
    """

    def run(batches):
        for sigs, sizes, hashes, level, rows in _suspect_rows(batches, text_col, size, percent, held.value):
            if not rows:
                continue
            pick = np.array([i for i, _ in rows])
            n = sizes[pick].astype(np.int64)
            owner, toks, places = _prefix(np.concatenate([hashes[r] for _, r in rows]), np.concatenate([level[r] for _, r in rows]), np.repeat(np.arange(len(n)), n), n, percent, 0)
            cuts = np.searchsorted(owner, np.arange(len(n) + 1))
            cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())  # noqa: B023, E731
            kin = [_kin(hashes[r], level[r]) for _, r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(sigs[pick]), pa.array(n), pa.array(kin, pa.int64()), cut(toks), cut(places.astype(np.int32))], ["sig", "n", "kin", "toks", "places"])

    found = df.select(text_col).mapInArrow(run, "sig long, n long, kin long, toks binary, places binary")
    return found.dropDuplicates(["sig", "n"])


def _kin(hashes: np.ndarray, level: np.ndarray) -> int:
    shared = hashes[level > 0]
    return int(mix((shared if len(shared) else hashes) ^ _SEEDS[0]).min().view(np.int64))


def _unpacked(suspects: DataFrame) -> DataFrame:
    """(tok, place, sig, n)."""

    def run(batches):
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, 1000)
                at += part.num_rows
                toks, places = part.column("toks").to_pylist(), part.column("places").to_pylist()
                who = pa.array(np.repeat(np.arange(len(toks)), [len(x) // 8 for x in toks]))
                columns = [pa.array(np.frombuffer(b"".join(toks), np.int64)), pa.array(np.frombuffer(b"".join(places), np.int32).astype(np.int64)), part.column("sig").take(who), part.column("n").take(who)]
                yield pa.RecordBatch.from_arrays(columns, ["tok", "place", "sig", "n"])

    return suspects.mapInArrow(run, "tok long, place long, sig long, n long")


def _of_keys(found: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows with these keys (sig, n), one of each."""
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_SETS else keys  # two longs a set
    return found.join(keys, ["sig", "n"], "left_semi").dropDuplicates(["sig", "n"])


def _whole_sets(df: DataFrame, text_col: str, size: int, percent: int, held, keys: DataFrame) -> DataFrame:
    """(sig, n, tokens, levels) of the sets with these keys (sig, n), by a pass over the texts."""

    def run(batches):
        for sigs, sizes, hashes, level, rows in _suspect_rows(batches, text_col, size, percent, held.value):
            if rows:
                pick = np.array([i for i, _ in rows])
                columns = [pa.array(sigs[pick]), pa.array(sizes[pick].astype(np.int64)), pa.array([hashes[r].tobytes() for _, r in rows], pa.binary()), pa.array([level[r].tobytes() for _, r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["sig", "n", "tokens", "levels"])

    return _of_keys(df.select(text_col).mapInArrow(run, "sig long, n long, tokens binary, levels binary"), keys)


def _prints(df: DataFrame, text_col: str, size: int, percent: int, held, keys: DataFrame) -> DataFrame:
    """(sig, n, p1, p2, ...) of the sets with these keys (sig, n): 32 bits of each prefix token of the later orders, by a pass over the texts."""
    names = [f"p{k}" for k in range(1, ORDERS)]

    def run(batches):
        for sigs, sizes, hashes, level, rows in _suspect_rows(batches, text_col, size, percent, held.value):
            if rows:
                pick = np.array([i for i, _ in rows])
                n = sizes[pick].astype(np.int64)
                tokens, levels, owner = np.concatenate([hashes[r] for _, r in rows]), np.concatenate([level[r] for _, r in rows]), np.repeat(np.arange(len(n)), n)
                columns = [pa.array(sigs[pick]), pa.array(n)]
                for k in range(1, ORDERS):
                    who, found, _ = _prefix(tokens, levels, owner, n, percent, k)
                    prints, cuts = (mix(found) >> _U(32)).astype(np.uint32), np.searchsorted(who, np.arange(len(n) + 1))
                    columns.append(pa.array([prints[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["sig", "n", *names])

    return _of_keys(df.select(text_col).mapInArrow(run, "sig long, n long, " + ", ".join(f"{c} binary" for c in names)), keys)


def _prefix(tokens: np.ndarray, levels: np.ndarray, owner: np.ndarray, n: np.ndarray, percent: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, token, place) of the sets' prefix tokens under the order, less those that no other set has; owner is ascending."""
    rank = np.lexsort((mix(tokens ^ _SEEDS[order]), levels, owner))
    first = np.cumsum(n) - n
    place = np.arange(len(owner)) - first[owner]  # owners stand together before and after
    keep = (place < (n - _least_share(n, percent) + 1)[owner]) & (levels[rank] > 0)
    rank = rank[keep]
    return owner[rank], tokens[rank], place[keep]


def _flat(tokens: list[bytes], levels: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, levels, owner, sizes) of sets end to end."""
    n = np.array([len(x) for x in levels], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint64), np.frombuffer(b"".join(levels), np.uint8), np.repeat(np.arange(len(n)), n), n


class _Postings:
    """Which sets of a block hold each token, from (owner, token) with ascending owners."""

    def __init__(self, owner: np.ndarray, tokens: np.ndarray, sets: int):
        order = np.argsort(tokens, kind="stable")
        tokens, self.holder, self.sets = tokens[order], owner[order], sets
        fresh = np.ones(len(tokens), bool)
        fresh[1:] = tokens[1:] != tokens[:-1]
        self.start = np.append(np.flatnonzero(fresh), len(tokens))
        self.number = np.empty(len(tokens), np.int64)
        self.number[order] = np.cumsum(fresh) - 1
        self.first = np.searchsorted(owner, np.arange(sets + 1))

    def shares(self, i: int) -> np.ndarray:
        """Common tokens of set i with each set."""
        own = self.number[self.first[i] : self.first[i + 1]]
        lo, wide = self.start[own], self.start[own + 1] - self.start[own]
        ends = np.cumsum(wide)
        at = np.repeat(lo - (ends - wide), wide) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.holder[at], minlength=self.sets)


_EDGE = "a long, an long, b long, bn long, w long"


def _links(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The links of a block, between its two sides or (side null) among all its sets: rows (a, b, 0) join a component's sets to one
    of them, and rows (a, null, w) give a set's number of linked rows."""
    pdf = pdf.sort_values(["n", "sig"], ignore_index=True)
    m, sig, copies = len(pdf), pdf["sig"].to_numpy(), pdf["copies"].to_numpy()
    across = bool(pdf["side"].notna().any())
    side = pdf["side"].to_numpy(bool) if across else np.zeros(m, bool)
    tokens, levels, owner, n = _flat(pdf["tokens"].tolist(), pdf["levels"].tolist())
    filters = [_Postings(*_prefix(tokens, levels, owner, n, percent, k)[:2], m) for k in range(ORDERS)]
    whole = _Postings(owner, tokens, m)
    label, linked_rows = np.arange(m), np.zeros(m, np.int64)
    for i in np.flatnonzero(~side):
        passed = 100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])
        if across:
            passed &= side
        else:
            passed[: i + 1] = False
        for order in filters:  # all of them before any comparison
            if passed.any():
                passed &= order.shares(i) > 0
        if not passed.any():
            continue
        share = whole.shares(i)
        found = np.flatnonzero(passed & (100 * share >= percent * (n[i] + n - share)))
        if len(found):
            linked_rows[i] += copies[found].sum()
            linked_rows[found] += copies[i]
            joined = np.unique(label[np.append(found, i)])
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
    leaf, held = np.flatnonzero(label != np.arange(m)), np.flatnonzero(linked_rows)
    edges = pd.DataFrame({"a": sig[label[leaf]], "an": n[label[leaf]], "b": sig[leaf], "bn": n[leaf], "w": 0})
    counts = pd.DataFrame({"a": sig[held], "an": n[held], "b": None, "bn": None, "w": linked_rows[held]})
    return pd.concat([edges.astype("Int64"), counts.astype("Int64")], ignore_index=True)


def _chunks(tokens) -> F.Column:
    return F.ceil(tokens / CHUNK_TOKENS).cast("int")


def _blocks_within(groups: DataFrame) -> DataFrame:
    """(g, h, i, j, side, sig, n, copies): every group with itself, by pairs of chunks i <= j."""
    chunks = groups.groupBy("head").agg(_chunks(F.sum("n")).alias("chunks"), F.count("*").alias("c")).where("c > 1").drop("c")
    placed = groups.join(chunks, "head").withColumn("chunk", F.pmod(F.xxhash64("sig", "n"), F.col("chunks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    side = F.when(F.col("chunk") != F.col("other"), F.col("chunk") > F.col("other"))
    return placed.select(F.col("head").alias("g"), F.col("head").alias("h"), F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), side.alias("side"), "sig", "n", "copies")


def _room(place: str, lo: str, hi: str, percent: int) -> F.Column:
    """Whether a set of n that holds a common token at that place can link with some set of lo to hi tokens."""
    least = F.greatest(F.col(lo), F.ceil(percent * F.col("n") / 100))
    fits = (100 * F.col("n") >= percent * F.col(lo)) & (100 * F.col(hi) >= percent * F.col("n"))
    return fits & ((100 + percent) * (F.col("n") - F.col(place)) >= percent * (F.col("n") + least))


def _meetings(groups: DataFrame, percent: int) -> DataFrame:
    """(g, h, side, sig, n, copies): sets that hold a prefix token which a set of another group, of a fitting size, holds too; g < h."""
    rows = groups.select("sig", "n", "copies", "head", F.inline("toks"))
    heads = rows.groupBy("tok", F.col("head").alias("other")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    mixed = heads.groupBy("tok").agg(F.count("*").alias("c")).where("c > 1").select("tok")
    meet = rows.join(mixed, "tok", "left_semi").join(heads, "tok").where((F.col("head") != F.col("other")) & _room("place", "lo", "hi", percent))
    return meet.select(F.least("head", "other").alias("g"), F.greatest("head", "other").alias("h"), (F.col("head") > F.col("other")).alias("side"), "sig", "n", "copies").distinct()


def _blocks_across(meet: DataFrame) -> DataFrame:
    """As _blocks_within, for the sets of two groups g < h that meet."""
    count = lambda on_side: F.greatest(F.lit(1), _chunks(F.coalesce(F.sum(F.when(F.col("side") == on_side, F.col("n"))), F.lit(0))))
    one = F.min(F.col("side").cast("int")) != F.max(F.col("side").cast("int"))  # sets of both groups are left
    chunks = meet.groupBy("g", "h").agg(count(False).alias("left"), count(True).alias("right"), one.alias("both")).where("both").drop("both")
    placed = meet.join(chunks, ["g", "h"])
    own, others = F.when(F.col("side"), F.col("right")).otherwise(F.col("left")), F.when(F.col("side"), F.col("left")).otherwise(F.col("right"))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("sig", "n"), own).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    pick = lambda right: F.when(F.col("side") == right, F.col("chunk")).otherwise(F.col("other"))
    return placed.select("g", "h", pick(False).alias("i"), pick(True).alias("j"), "side", "sig", "n", "copies")


_BLOCK = "g long, h long, i int, j int, side boolean, sig long, n long, copies long"


def _passing(blocks: pa.Table) -> np.ndarray:
    """Which rows of whole blocks hold, under each later order, a print of another set of their block, of its other side where it has two."""
    ids = [blocks.column(c).to_numpy() for c in ("g", "h", "i", "j")]
    block = np.cumsum(np.append(False, np.any([x[1:] != x[:-1] for x in ids], axis=0))).astype(_U)
    side = blocks.column("side")
    right, within = side.fill_null(False).to_numpy(), side.is_null().to_numpy()
    keep, before = np.ones(len(block), bool), -1
    orders = []
    for k in range(1, ORDERS):
        rows = blocks.column(f"p{k}").to_pylist()
        owner = np.repeat(np.arange(len(rows)), [len(x) // 4 for x in rows])
        orders.append((owner, (block[owner] << _U(32)) | np.frombuffer(b"".join(rows), np.uint32)))
    while before != (before := int(keep.sum())):
        for owner, prints in orders:
            left = keep[owner]
            who = owner[left]
            _, place = np.unique(prints[left], return_inverse=True)
            every, of_right = np.bincount(place), np.bincount(place, weights=right[who])
            met = np.where(within[who], every[place] > 1, (of_right[place] > 0) & (of_right[place] < every[place]))
            keep &= np.bincount(who[met], minlength=len(keep)) > 0
    return keep


def _filtered(blocks: DataFrame) -> DataFrame:
    """The rows of blocks that pass the filters of the later orders, by their prints; each linked pair of a block stays in it."""

    def run(batches):
        names = [x.split()[0] for x in _BLOCK.split(", ")]
        held: list[pa.RecordBatch] = []

        def judged(table: pa.Table):
            if table.num_rows:
                yield from table.select(names).filter(pa.array(_passing(table))).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [batch.column(c).to_numpy() for c in ("g", "h", "i", "j")]
            cut = batch.num_rows  # where the last block begins
            last = np.all([x == x[-1] for x in ids], axis=0)
            cut = 0 if last.all() else int(np.flatnonzero(~last)[-1]) + 1
            if cut:
                yield from judged(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in ("g", "h", "i", "j")):
                yield from judged(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from judged(pa.Table.from_batches(held))

    key = ["g", "h", "i", "j"]
    return blocks.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, _BLOCK)


def jaccard_links(df: DataFrame, text_col: str, total: int, copies: DataFrame, scratch: Scratch, size: int = 3, percent: int = 90) -> DataFrame:
    """Links (a, an, b, bn, w) between sets (digest, size) that connect whatever the similarity join connects.

    Rows without b give the set a w linked rows of other sets; they sum up to all of its links.  copies: (sig, n, copies).
    """
    held = df.sparkSession.sparkContext.broadcast(_level_tables(df, text_col, size, total))
    scratch.sweep()
    suspects = scratch.keep(_suspects(df, text_col, size, percent, held), "suspects")
    first = _unpacked(suspects.drop("kin"))
    heads = first.groupBy("tok").agg(F.min(F.struct("sig", "n")).alias("head"), F.count("*").alias("c")).where("c > 1").drop("c")
    shared = first.join(heads, "tok").groupBy("sig", "n").agg(F.mode("head", True).alias("head"), F.collect_list(F.struct("tok", "place")).alias("toks"))  # a set's prefix
    # groups of alike heads are one: near copies of one text would else gather round many heads, and each set meet each of them
    kin = suspects.select(F.struct("sig", "n").alias("head"), "kin")
    groups = shared.join(kin, "head").join(copies, ["sig", "n"]).select("sig", "n", "copies", F.col("kin").alias("head"), "toks")
    groups = scratch.keep(groups, "groups")
    scratch.drop("suspects")
    meet = scratch.keep(_meetings(groups, percent), "meet0")
    blocks = scratch.keep(_blocks_within(groups.drop("toks")).unionByName(_blocks_across(meet)), "blocks")
    scratch.drop("groups", "meet0")
    prints = scratch.keep(_prints(df, text_col, size, percent, held, blocks.select("sig", "n").distinct()), "prints")
    passed = scratch.keep(_filtered(blocks.join(prints, ["sig", "n"])), "passed")  # the filters of all orders, before any whole set moves
    scratch.drop("blocks", "prints")
    filled = passed.join(_whole_sets(df, text_col, size, percent, held, passed.select("sig", "n").distinct()), ["sig", "n"])
    links = scratch.keep(filled.groupBy("g", "h", "i", "j").applyInPandas(lambda pdf: _links(pdf, percent), _EDGE), "links")
    held.destroy()  # what reads it is written
    scratch.drop("passed")
    return links


def _classes(df: DataFrame, id_col: str, text_col: str, size: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(id, n, sig) of every row, and (sig, n, least, root, component_id, class_size, links) of every set."""
    sizes = scratch.keep(set_sizes(df, id_col, text_col, size), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    every = scratch.keep(sizes.where("n > 0").groupBy("sig", "n").agg(F.min("id").alias("least"), F.count("*").alias("copies")), "sets")
    links = jaccard_links(df, text_col, total, every.select("sig", "n", "copies"), scratch, size, percent)
    node = lambda s, n: F.struct(F.col(s).alias("sig"), F.col(n).alias("n"))
    edges = links.where("b is not null").select(node("a", "an").alias("a"), node("b", "bn").alias("b"))
    roots = connected_components(edges, scratch)
    degree = links.where("b is null").groupBy(node("a", "an").alias("node")).agg(F.sum("w").alias("links"))
    classes = every.select(node("sig", "n").alias("node"), "least", "copies").join(roots, "node", "left").join(degree, "node", "left")
    classes = scratch.keep(classes.select("node", F.coalesce("root", "node").alias("root"), "least", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "classes")
    wholes = classes.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("copies").alias("class_size"))
    named = scratch.keep(classes.join(wholes, "root").select("node.sig", "node.n", "least", "root", "component_id", "class_size", "links"), "named")
    scratch.drop("sets", "links", "classes")
    return sizes, named


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """Similarity classes of the texts: (id, n_shingles, component_id, class_size, links).

    Two texts link when their sets of distinct `size`-word shingles (words lower-cased A-Z; a shorter text is
    one shingle) have Jaccard similarity of at least `percent` / 100; component_id is the smallest id reachable,
    class_size the number of rows in the component, links the number of other rows that the row's text links with
    (rows of equal sets among them).

    Null or wordless texts have no shingles and link with nothing, not even each other.  Repeated ids give
    one row each.  A null id keeps its row; component_id is the smallest id of the component that isn't
    null, or null.  Other columns of df are left out.
    """
    sizes, named = _classes(df, id_col, text_col, size, percent, Scratch(df.sparkSession, "jaccard"))
    rows = sizes.join(named, ["sig", "n"], "left")
    return rows.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("links", F.lit(0)).alias("links"),
    )


def _signed(df: DataFrame, text_col: str, size: int, n: str, sig: str) -> DataFrame:
    """df with the size and digest of each row's set, under these names."""

    def run(batches):
        for part, _, _, sizes, sigs in _sets(batches, text_col, size):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sizes.astype(np.int64)), pa.array(np.where(sizes > 0, sigs, 0))], [*part.schema.names, n, sig])

    schema = T.StructType([*df.schema.fields, T.StructField(n, T.LongType()), T.StructField(sig, T.LongType())])
    return df.mapInArrow(run, schema)


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df, less all but one of each similarity class: the row of the smallest id stays.

    A null id comes after all others.  Of rows that tie (the same smallest id), those of one set stay, and of
    equal ids and sets one row.  Wordless and null texts all stay, as they link with nothing.  Other columns of df, of any name,
    stay as they are.
    """
    scratch = Scratch(df.sparkSession, "near-copies")
    sizes, named = _classes(df, id_col, text_col, size, percent, scratch)
    # null ids last: a class with any id is represented by its least one
    first = named.groupBy("root").agg(F.min_by(F.struct("sig", "n"), F.struct(F.col("least").isNull(), "least", "sig", "n")).alias("x"))
    chosen = named.join(first.select("x.sig", "x.n"), ["sig", "n"]).select("sig", "n", F.col("least").alias("id"))
    rows = sizes.groupBy("id", "sig", "n").agg(F.count("*").alias("copies"))
    c = chosen.select(F.col("sig").alias("cs"), F.col("n").alias("cn"), F.col("id").alias("ci"))
    stay = rows.where("n > 0").join(c, (F.col("sig") == F.col("cs")) & (F.col("n") == F.col("cn")) & F.col("id").eqNullSafe(F.col("ci")))
    stay = stay.select("id", "sig", "n", (F.col("copies") > 1).alias("many")).union(rows.where("n = 0").select("id", "sig", "n", F.lit(False)))
    n, sig, key, s, k, many = free_names(df.columns, "n", "sig", "id", "s", "k", "many")
    stay = scratch.keep(stay.toDF(key, s, k, many), "stay")
    scratch.drop("sizes", "named")
    on = F.col(id_col).eqNullSafe(F.col(key)) & (F.col(sig) == F.col(s)) & (F.col(n) == F.col(k))
    signed = _signed(df, text_col, size, n, sig)
    if stay.where(many).isEmpty():
        return signed.join(stay, on, "left_semi").select(*[f"`{c}`" for c in df.columns])
    kept = signed.join(stay, on)
    one = kept.where(many).dropDuplicates([id_col, sig, n])
    return kept.where(f"not {many}").unionByName(one).select(*[f"`{c}`" for c in df.columns])
