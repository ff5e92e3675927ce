"""Sampled SentencePiece segmentations, without replacement, by Gumbel top-k.

A text's segmentations are the paths of its piece lattice; their probabilities come from a unigram law over the
pieces (Zipf's law over the model's merge ranks, sharpened or flattened by `theta`).  Every path gets a
Gumbel-perturbed log-probability and the k largest are k distinct samples without replacement.  They are
found without listing paths, by best-first search from above: the largest perturbed value of any set of
paths is itself a Gumbel variable with the set's total mass, so the search keeps sets with their exact
maxima (an admissible bound that is reached) and always opens the best one.

    open a set at a lattice node: draw the edge of its best path by the edges' conditional masses; the edge keeps
    the set's maximum, the other edges stay behind as one set whose maximum is drawn below it; go on to the end.
    A whole chunk that takes its path of heaviest edges is one step: all its other paths stay behind as one set.

So a sample costs one pass over the nodes of its own path.  No piece crosses from a character to a
following space mark, so the lattice is a chain of chunk lattices; these are built once per distinct
chunk (a task remembers a bounded number of them), and passes run over all chunks of all texts of the slice at once in numpy.  The last set
left over gives the threshold kappa, and with it every sample's inclusion probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .words import mix, release

SLICE_CHARS = 1 << 18
LATTICE_NODES = 2_000_000  # of distinct chunks that a task remembers
MARK, LITERAL_MARK = 0x2581, 0x110000
_PIECE_BITS, _CHUNK_BITS = 19, 18
THETA = 1.0

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)
_tables: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_tables[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            t = np.full(max(n, 2 * SLICE_CHARS), base, _U)
            t[0] = 1
            _tables[k] = np.multiply.accumulate(t)
    return _tables


def _prefix(chars: np.ndarray) -> np.ndarray:
    up = _powers(len(chars) + 1)[0]
    total = np.zeros(len(chars) + 1, _U)
    np.cumsum(mix(chars.astype(_U) + _U(1)) * up[: len(chars)], out=total[1:])
    return total


def _spans(total: np.ndarray, start: np.ndarray, size) -> np.ndarray:
    down = _powers(len(total))[1]
    return mix((total[start + size] - total[start]) * down[start] + np.asarray(size).astype(_U) * _U(0x9E3779B97F4A7C15))


class Pieces:
    """The model's pieces as hash tables, with log-probabilities."""

    def __init__(self, model: str, theta: float = THETA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.bytes_of = np.full(n, b"", object)
        self.byte_id = np.zeros(256, np.int64)
        plain = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain.append((i, piece, sp.get_score(i)))
                self.bytes_of[i] = piece.replace(chr(MARK), " ").encode()
        by_score = sorted(plain, key=lambda x: (-x[2], x[0]))
        rank = np.empty(n)
        rank[:] = n
        for k, (i, _, _) in enumerate(by_score):
            rank[i] = k
        weight = -theta * np.log(rank + 2.7)
        self.log_p = weight - np.log(np.exp(weight).sum())
        self.width = max(len(p) for _, p, _ in plain)
        entries: dict[int, int] = {}
        for i, piece, _ in plain:
            chars = np.array([ord(c) for c in piece], np.uint32)
            keys = _spans(_prefix(chars), np.zeros(len(chars), np.int64), np.arange(1, len(chars) + 1))
            for key in keys[:-1].tolist():
                entries.setdefault(key, -1)
            entries[int(keys[-1])] = i
        keys = np.array(sorted(entries), _U)
        ids = np.array([entries[k] for k in keys.tolist()], np.int64)
        slot = (keys >> _U(64 - _PIECE_BITS)).astype(np.int64)
        first = np.concatenate([[True], slot[1:] != slot[:-1]])
        self.slot_key, self.slot_id = np.zeros(1 << _PIECE_BITS, _U), np.full(1 << _PIECE_BITS, -2, np.int64)
        self.slot_key[slot[first]], self.slot_id[slot[first]] = keys[first], ids[first]
        self.shared = np.zeros(1 << _PIECE_BITS, bool)  # slots of several keys
        self.shared[slot[~first]] = True
        self.keys, self.ids = keys[~first], ids[~first]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece id, -1 for the beginning of a longer piece, -2 for neither."""
        slot = (h >> _U(64 - _PIECE_BITS)).astype(np.int64)
        same = self.slot_key[slot] == h
        out = np.where(same, self.slot_id[slot], -2)
        rest = np.flatnonzero(self.shared[slot] & ~same)
        if len(rest):
            at = np.minimum(np.searchsorted(self.keys, h[rest]), len(self.keys) - 1)
            out[rest] = np.where(self.keys[at] == h[rest], self.ids[at], -2)
        return out


class Lattice:
    """Piece lattices of distinct chunks, end to end; grows as new chunks come.

    Characters are nodes; the nodes added together are ranked by their distance from the chunk's end, so that masses are
    summed from the ends.  The edges of the node of rank r are first[r]:first[r + 1], by length.
    """

    _GROWN = {"chars": np.uint32, "rank": np.int32, "best": np.int32, "first": np.int32, "piece": np.int32, "size": np.int8, "mass": np.float64, "begin": np.int64, "top_mass": np.float64, "top_log": np.float64, "top_rest": np.float64, "ids_first": np.int64, "ids": np.int32}
    _EDGE = ("piece", "size", "mass")

    def __init__(self, pieces: Pieces, room: int = 1 << 16):
        self.pieces, self.nodes, self.edges = pieces, 0, 0
        self._room = {k: np.empty(room if k not in self._EDGE else 4 * room, t) for k, t in self._GROWN.items()}
        self._room["ids_first"][0] = 0
        self.types: dict[int, int] = {}  # chunk's hash: its number
        self._slot_key, self._slot_type = np.zeros(1 << _CHUNK_BITS, _U), np.zeros(1 << _CHUNK_BITS, np.int64)  # the latest, by part of the hash

    def __getattr__(self, name: str) -> np.ndarray:
        try:
            return self.__dict__["_room"][name]
        except KeyError:
            raise AttributeError(name) from None

    def _put(self, name: str, values: np.ndarray, at: int) -> None:
        room = self._room[name]
        if at + len(values) > len(room):
            grown = np.empty(max(2 * len(room), at + len(values)), room.dtype)
            grown[:at] = room[:at]
            room = self._room[name] = grown
        room[at : at + len(values)] = values

    def numbers(self, keys: np.ndarray, chars: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of the chunks of a text with these hashes; new ones are added."""
        slot = (keys >> _U(64 - _CHUNK_BITS)).astype(np.int64)
        out = self._slot_type[slot]
        miss = np.flatnonzero(self._slot_key[slot] != keys)
        if len(miss):
            unique, at, back = np.unique(keys[miss], return_index=True, return_inverse=True)
            names = unique.tolist()
            found = np.fromiter((self.types.get(x, -1) for x in names), np.int64, len(names))
            new = np.flatnonzero(found < 0)
            if len(new):
                rows = miss[at[new]]
                own, ends = size[rows], np.cumsum(size[rows])
                source = np.repeat(start[rows] - (ends - own), own) + np.arange(own.sum())
                found[new] = self.add(unique[new].tolist(), chars[source], own)
            out[miss] = found[back]
            self._slot_key[slot[miss]], self._slot_type[slot[miss]] = keys[miss], out[miss]
        return out

    def add(self, keys: list[int], chars: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of new chunks: their hashes, characters end to end and numbers of characters."""
        pieces, n, old_nodes, old_edges = self.pieces, len(chars), self.nodes, self.edges
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(n)  # characters to the chunk's end, itself included
        order = np.argsort(left, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        total = _prefix(chars)
        found, at, degree = [], np.arange(n), np.zeros(n, np.int64)
        for size in range(1, pieces.width + 1):
            at = at[left[at] >= size]
            ids = pieces.find(_spans(total, at, size))
            if size == 1:  # a character without a piece of its own is spelled in bytes, several of them as id -1
                lone = np.flatnonzero(ids < 0)
                c = chars[lone]
                weight = pieces.log_p[np.maximum(ids, 0)]
                weight[lone] = pieces.log_p[pieces.byte_id[0]] * (1 + (c > 0x7F).astype(int) + (c > 0x7FF) + ((c > 0xFFFF) & (c < LITERAL_MARK)))
                on = ids > -2
                ids[lone] = np.where(c < 0x80, pieces.byte_id[np.minimum(c, 255)], -1)
                found.append((at, ids, weight))
                degree[at] += 1
                at = at[on]
                continue
            hit = ids >= 0
            found.append((at[hit], ids[hit], pieces.log_p[ids[hit]]))
            degree[at[hit]] += 1
            at = at[ids > -2]
            if not len(at):
                break
        degrees = degree[order]
        first = np.zeros(n + 1, np.int64)
        np.cumsum(degrees, out=first[1:])
        edges = int(first[-1])
        cursor = first[:-1][rank]
        piece, length, mass, goal = np.empty(edges, np.int32), np.empty(edges, np.int8), np.empty(edges), np.empty(edges, np.int64)
        for size, (nodes, ids, weight) in enumerate(found, 1):
            e = cursor[nodes]
            cursor[nodes] += 1
            piece[e], length[e], mass[e] = ids, size, weight
            goal[e] = np.where(left[nodes] == size, n, nodes + size)
        beta = np.zeros(n + 1)  # log mass of all paths from a character to its chunk's end
        cuts = np.searchsorted(left[order], np.arange(1, int(left.max()) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a == b:
                continue
            rows, starts = slice(first[a], first[b]), first[a:b] - first[a]
            value = mass[rows] + beta[goal[rows]]
            top = np.maximum.reduceat(value, starts)
            value = np.exp(value - np.repeat(top, degrees[a:b]))
            sums = np.add.reduceat(value, starts)
            beta[order[a:b]] = top + np.log(sums)
            mass[rows] = value / np.repeat(sums, degrees[a:b])
        top = np.flatnonzero(mass == np.repeat(np.maximum.reduceat(mass, first[:-1]), degrees))[::-1]
        best = np.empty(n, np.int64)  # heaviest edge of each rank
        best[np.repeat(np.arange(n), degrees)[top]] = top
        for name, values in (("chars", chars), ("rank", rank + old_nodes), ("best", best + old_edges), ("first", first + old_edges)):
            self._put(name, values, old_nodes)
        for name, values in (("piece", piece), ("size", length), ("mass", mass)):
            self._put(name, values, old_edges)
        self.nodes, self.edges = old_nodes + n, old_edges + edges
        return self._add_types(keys, ends - sizes + old_nodes, ends + old_nodes)

    def _add_types(self, keys: list[int], begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Each chunk's path of heaviest edges: its mass and its ids."""
        found, log_mass = [], np.zeros(len(keys))
        chunk, at = np.arange(len(keys)), begin
        while len(chunk):
            edge = self.best[self.rank[at]]
            log_mass[chunk] += np.log(self.mass[edge])
            found.append((chunk, edge, at))
            at = at + self.size[edge]
            on = at < end[chunk]
            chunk, at = chunk[on], at[on]
        chunk, edge, at = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(chunk, kind="stable")
        ids, spread = self.spell(edge[order], at[order])
        counts = np.bincount(np.repeat(chunk[order], spread), minlength=len(keys))
        old, old_ids = len(self.types), int(self.ids_first[len(self.types)])
        self._put("ids", ids, old_ids)
        self._put("ids_first", np.cumsum(counts) + old_ids, old + 1)
        for name, values in (("begin", begin), ("top_log", log_mass), ("top_mass", np.exp(log_mass)), ("top_rest", _log_rest(np.exp(log_mass)))):
            self._put(name, values, old)
        numbers = np.arange(old, old + len(keys))
        self.types.update(zip(keys, numbers.tolist()))
        return numbers

    def spell(self, edge: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids along edges from the nodes `at`, and how many each edge gives (more than one for bytes)."""
        ids, spread = self.piece[edge], np.ones(len(edge), np.int64)
        if len(ids) and ids.min() < 0:
            parts = [[i] if i >= 0 else self.pieces.byte_id[list(_utf8(c))].tolist() for i, c in zip(ids.tolist(), self.chars[at].tolist())]
            ids, spread = np.array([x for p in parts for x in p], np.int32), np.array([len(p) for p in parts])
        return ids, spread

    def top_path(self, number: int, end: int) -> tuple[list[int], list[int]]:
        """Nodes and edges of a chunk's path of heaviest edges."""
        at, nodes, edges = int(self.begin[number]), [], []
        while at < end:
            nodes.append(at)
            edges.append(int(self.best[self.rank[at]]))
            at += int(self.size[edges[-1]])
        return nodes, edges

    def last_edge(self, rank: np.ndarray) -> np.ndarray:
        return np.where(rank + 1 < self.nodes, self.first[np.minimum(rank + 1, self.nodes - 1)], self.edges) - 1

    def draw(self, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node, by its mass: the heaviest has the first part of the unit interval, the others the rest in order."""
        rank = self.rank[at]
        edge = self.best[rank]
        mass = self.mass[edge]
        other = np.flatnonzero(u >= mass)
        if len(other):
            best, left = edge[other], u[other] - mass[other]
            pick = self.first[rank[other]].astype(np.int64)  # step on from the node's first edge; nodes have few
            own = np.where(pick == best, 0.0, self.mass[pick])
            last = self.last_edge(rank[other])
            on = np.flatnonzero((left >= own) & (pick < last))
            while len(on):
                left[on] -= own[on]
                pick[on] += 1
                own[on] = np.where(pick[on] == best[on], 0.0, self.mass[pick[on]])
                on = on[(left[on] >= own[on]) & (pick[on] < last[on])]
            pick -= (pick == best) & (pick > 0) & (self.first[rank[other]] < pick)  # rounding past the end
            edge[other] = pick
        return edge


def _utf8(c: int) -> bytes:
    return chr(MARK if c == LITERAL_MARK else c).encode("utf-8", "surrogatepass")


def _unit(hashed: np.ndarray) -> np.ndarray:
    return ((hashed >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _high(hashed: np.ndarray) -> np.ndarray:
    """A uniform number from the upper half; _low gives another from the lower."""
    return ((hashed >> _U(32)).astype(np.float64) + 0.5) * 2.0**-32


def _low(hashed: np.ndarray) -> np.ndarray:
    return ((hashed & _U(0xFFFFFFFF)).astype(np.float64) + 0.5) * 2.0**-32


def _uniform(key: np.ndarray) -> np.ndarray:
    return _unit(mix(key))


_NODES = {"chunk": np.int64, "at": np.int64, "edge": np.int64, "mass": np.float64, "key": np.uint64}


def _below(limit: np.ndarray, log_mass: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The maximum of a set of that mass, given that it's below the limit."""
    with np.errstate(divide="ignore"):
        return -np.logaddexp(-limit, np.log(-np.log(u)) - log_mass)


class Texts:
    """A slice of texts as chunks over a lattice of its distinct chunks."""

    def __init__(self, lattice: Lattice, texts: list[str], seeds: np.ndarray):
        plain = np.array([len(t) for t in texts], np.int64)
        raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = plain + (plain > 0)
        self.first_char = np.concatenate([[0], np.cumsum(sizes)])
        chars = np.full(self.first_char[-1], MARK, np.uint32)
        body = np.ones(len(chars), bool)
        body[self.first_char[:-1][sizes > 0]] = False
        chars[body] = np.where(raw == 0x20, MARK, np.where(raw == MARK, LITERAL_MARK, raw))
        mark = chars == MARK
        opens = mark.copy()
        opens[1:] &= ~mark[:-1]
        opens[self.first_char[:-1][sizes > 0]] = True
        start = np.flatnonzero(opens)
        size = np.diff(np.append(start, len(chars)))
        self.chunk_first = np.searchsorted(start, self.first_char)  # chunks of each text
        self.chunk_doc = np.repeat(np.arange(len(texts)), np.diff(self.chunk_first))
        self.lattice = lattice
        self.type = lattice.numbers(_spans(_prefix(chars), start, size), chars, start, size)
        self.begin = lattice.begin[self.type]  # of each chunk, in the lattice
        self.end = self.begin + size
        self.chunk_base = start - self.first_char[self.chunk_doc] - self.begin
        self.seeds, self.chunk_seed = seeds, seeds[self.chunk_doc]
        self.n_docs = len(texts)
        self.top_mass, self.top_log, self.top_rest = (x[self.type] for x in (lattice.top_mass, lattice.top_log, lattice.top_rest))
        self.ids_from = lattice.ids_first[self.type]
        self.n_ids = lattice.ids_first[self.type + 1] - self.ids_from
        self.key_base = self.chunk_seed + (self.begin + self.chunk_base).astype(_U) * _U(128 * int(_GOLDEN) & _M)

    def key(self, chunk: np.ndarray, at: np.ndarray, sample: int, use: int) -> np.ndarray:
        """Hashed numbers for the draws at the nodes `at`, or at whole chunks for use 3."""
        place = (self.chunk_base[chunk] + at).astype(_U)
        return mix(self.chunk_seed[chunk] + (place * _U(128) + _U(4 * sample + use)) * _GOLDEN)

    def nodes(self, chunk: np.ndarray, at: np.ndarray, top: np.ndarray, sample: int) -> dict[str, np.ndarray]:
        """Paths from the nodes `at` to the ends of their chunks, in text order.

        top: where above 0, the mass of the path of heaviest edges from the node on, which must not be taken.
        """
        found, lat = [], self.lattice
        while len(chunk):
            key = self.key(chunk, at, sample, 0)
            u = _high(key)
            bound = np.flatnonzero(top > 0)
            if len(bound):
                best = lat.best[lat.rank[at[bound]]]
                m, whole = lat.mass[best], top[bound]
                leave = np.minimum(1.0, (1 - m) / np.maximum(1 - whole, 1e-300))
                off = u[bound] < leave
                # on the heaviest edge, or on another one in proportion to its mass
                u[bound] = np.where(off, m + u[bound] / np.maximum(leave, 1e-300) * (1 - m), m * 0.5)
                top = top.copy()
                top[bound] = np.where(off, 0.0, whole / m)
            edge = lat.draw(at, np.minimum(u, 1 - 1e-16))
            found.append((chunk, at, edge, lat.mass[edge], key))
            at = at + lat.size[edge]
            on = at < self.end[chunk]
            chunk, at, top = chunk[on], at[on], top[on]
        if not found:
            return {k: np.zeros(0, t) for k, t in _NODES.items()}
        columns = [np.concatenate(x) for x in zip(*found)]
        order = np.argsort(columns[0], kind="stable")
        return {k: x[order] for k, x in zip(_NODES, columns)}


def _log_rest(mass: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(mass >= 1 - 1e-12, -np.inf, np.log1p(-np.minimum(mass, 1.0)))


class _Path:
    """One sample of each text that has it, from its head on: the nodes `inner` of the head's chunk, then whole chunks.

    A chunk takes its path of heaviest edges, and leaves all others behind as one set; or it takes another path, node by
    node, and each node leaves a set behind.
    """

    def __init__(self, t: Texts, chunks: np.ndarray, inner: dict[str, np.ndarray], start: np.ndarray, best: np.ndarray, sample: int):
        lat, n = t.lattice, t.n_docs
        every = len(chunks) == len(t.type)
        of = lambda x: x if every else x[chunks]
        key = mix(of(t.key_base) + _U((4 * sample + 3) * int(_GOLDEN) & _M))
        top = _high(key) < of(t.top_mass)
        other = chunks[~top]
        walked = t.nodes(other, t.begin[other], t.top_mass[other], sample)
        rows = {k: np.concatenate([inner[k], walked[k]]) for k in _NODES}
        order = np.argsort(rows["chunk"], kind="stable")
        self.nodes = rows = {k: x[order] for k, x in rows.items()}
        self.chunks, self.top = chunks, top
        row_doc, doc = t.chunk_doc[rows["chunk"]], of(t.chunk_doc)
        docs = np.arange(n + 1)
        self.row_first, self.chunk_first = np.searchsorted(row_doc, docs), np.searchsorted(doc, docs)
        step = np.log(rows["mass"])
        # log mass of each chunk's path, and of reaching each chunk
        own = of(t.top_log).copy()
        per = np.concatenate([[0.0], np.cumsum(step)])
        opens = np.flatnonzero(np.concatenate([[True], rows["chunk"][1:] != rows["chunk"][:-1]])) if len(rows["chunk"]) else np.zeros(0, np.int64)
        run = np.searchsorted(rows["chunk"][opens], other)
        closes = np.append(opens[1:], len(rows["chunk"]))
        lo, hi = opens[run], closes[run]
        own[~top] = per[hi] - per[lo]
        head = np.zeros(n)
        np.add.at(head, t.chunk_doc[inner["chunk"]], np.log(inner["mass"]))
        begin = start + head
        sums = np.concatenate([[0.0], np.cumsum(own)])
        self.reached = sums[:-1] + (begin - sums[self.chunk_first[:-1]])[doc]
        self.log_p = begin + sums[self.chunk_first[1:]] - sums[self.chunk_first[:-1]]
        at_chunk = np.full(len(t.type), 0.0)
        at_chunk[chunks] = self.reached
        inside = np.zeros(len(t.type), bool)
        inside[inner["chunk"]] = True
        base = np.where(inside[rows["chunk"]], start[row_doc], at_chunk[rows["chunk"]])
        first_row = np.repeat(opens, closes - opens)
        self.row_reached = per[:-1] - per[first_row] + base
        self.row_rest = _below(best[row_doc], self.row_reached + _log_rest(rows["mass"]), _low(rows["key"]))
        self.rest = np.where(top, _below(best[doc], self.reached + of(t.top_rest), _low(key)), -np.inf)
        # ids of the head's inner nodes and of every chunk, end to end
        ids, spread = lat.spell(rows["edge"], rows["at"])
        row_ends = np.concatenate([[0], np.cumsum(spread)])
        counts = of(t.n_ids).copy()
        counts[~top] = row_ends[hi] - row_ends[lo]
        source = np.where(top, of(t.ids_from), 0)
        ends = np.cumsum(counts)
        at = np.repeat(source - (ends - counts), counts)
        at += np.arange(len(at))
        if counts.max(initial=0) > len(lat.ids):
            np.minimum(at, len(lat.ids) - 1, out=at)
        self.ids = lat.ids[at]
        few = np.flatnonzero(~top)  # their ids stand in `ids`
        n_few = counts[few]
        each, base = np.arange(int(n_few.sum())), np.cumsum(n_few)
        self.ids[np.repeat(ends[few] - base, n_few) + each] = ids[np.repeat(row_ends[lo] - (base - n_few), n_few) + each]
        self.id_ends = np.concatenate([[0], ends])
        self.lead: dict[int, tuple] = {}  # text: (sample left, its chunk, edges and nodes before the inner ones)

    def best_left(self, d: int) -> tuple[float, bool, int]:
        """(maximum, whether of a whole chunk, its row) of the sets left behind in text d."""
        found = (-np.inf, True, -1)
        lo, hi = self.chunk_first[d], self.chunk_first[d + 1]
        if hi > lo:
            j = lo + int(self.rest[lo:hi].argmax())
            found = (float(self.rest[j]), True, j)
        lo, hi = self.row_first[d], self.row_first[d + 1]
        if hi > lo:
            j = lo + int(self.row_rest[lo:hi].argmax())
            if self.row_rest[j] > found[0]:
                found = (float(self.row_rest[j]), False, j)
        return found


@dataclass
class _Set:
    """Paths that follow sample `sample` up to `chunk`, then the nodes and edges of `lead`, then leave node `at` by none of `out`."""

    maximum: float
    sample: int
    chunk: int
    lead: tuple[list[int], list[int]]
    at: int
    out: tuple[int, ...]
    reached: float


_M = (1 << 64) - 1


def _mix_one(x: int) -> int:
    """mix() of one number."""
    x ^= x >> 31
    x = x * 0x7FB5D329728EA185 & _M
    x ^= x >> 27
    x = x * 0x81DADEF4BC2DD44D & _M
    return x ^ x >> 33


def _draw_one(t: Texts, chunk: int, at: int, sample: int, use: int) -> float:
    place = int(t.chunk_base[chunk]) + at
    key = _mix_one(int(t.chunk_seed[chunk]) + (place * 128 + 4 * sample + use) * int(_GOLDEN) & _M)
    return ((key >> 11) + 0.5) * 2.0**-53


def _below_one(limit: float, log_mass: float, u: float) -> float:
    if log_mass == -math.inf:
        return -math.inf
    a, b = -limit, math.log(-math.log(u)) - log_mass
    return -(max(a, b) + math.log1p(math.exp(-abs(a - b))))


def _open_chunk(t: Texts, path: _Path, p: int, j: int, top: float, sample: int) -> tuple[_Set, list[_Set]]:
    """Splits what a chunk left behind by the node that first leaves the heaviest path: (the set that holds the maximum, the others)."""
    lat, chunk = t.lattice, int(path.chunks[j])
    nodes, edges = lat.top_path(int(t.type[chunk]), int(t.end[chunk]))
    mass = lat.mass[edges]
    before = np.concatenate([[0.0], np.cumsum(np.log(mass))[:-1]])
    log_mass = before + _log_rest(mass)
    weight = np.exp(log_mass - log_mass.max())
    i = min(int(np.searchsorted(np.cumsum(weight), _draw_one(t, chunk, nodes[0], sample, 2) * weight.sum())), int(np.flatnonzero(weight).max()))
    sets = []
    for k, (at, edge) in enumerate(zip(nodes, edges)):
        reached = float(path.reached[j] + before[k])
        low = top if k == i else _below_one(top, float(path.reached[j] + log_mass[k]), _draw_one(t, chunk, at, sample, 1))
        sets.append(_Set(low, p, chunk, (nodes[:k], edges[:k]), at, (edge,), reached))
    return sets[i], [x for k, x in enumerate(sets) if k != i and x.maximum > -np.inf]


def sample_slice(lattice: Lattice, texts: list[str], seeds: np.ndarray, k: int) -> list[list[tuple[float, float, float, np.ndarray]]]:
    """For each text its samples (log_p, perturbed, log_inclusion, ids), best first, k at most."""
    t = Texts(lattice, texts, seeds)
    n = t.n_docs
    best = -np.log(-np.log(_uniform(seeds ^ _U(0x6A09E667F3BCC909))))
    none = {key: np.zeros(0, kind) for key, kind in _NODES.items()}
    paths = [_Path(t, np.arange(len(t.type)), none, np.zeros(n), best, 0)]
    spans = lambda path, d: path.ids[path.id_ends[path.chunk_first[d]] : path.id_ends[path.chunk_first[d + 1]]]
    samples = [[spans(paths[0], d)] for d in range(n)]
    # for each text and sample, where the ids of its chunks begin
    marks = [[paths[0].id_ends[paths[0].chunk_first[d] : paths[0].chunk_first[d + 1]] - paths[0].id_ends[paths[0].chunk_first[d]]] for d in range(n)]
    out = [[(float(paths[0].log_p[d]), float(best[d]))] for d in range(n)]
    opened: list[list[_Set]] = [[] for _ in range(n)]
    alive = np.diff(t.chunk_first) > 0
    kappa = np.full(n, -np.inf)
    for s in range(1, k + 1):
        start, limit = np.zeros(n), np.full(n, -np.inf)
        heads: dict[int, tuple[_Set, int]] = {}
        for d in np.flatnonzero(alive).tolist():
            top, where = -np.inf, None
            for p, path in enumerate(paths):
                found = path.best_left(d)
                if found[0] > top:
                    top, where = found[0], (p, *found[1:])
            again = max(opened[d], key=lambda x: x.maximum, default=None)
            if again is not None and again.maximum >= top:
                top, where = again.maximum, None
            if top == -np.inf:
                alive[d] = False
                continue
            limit[d] = top
            if s == k:
                continue
            if where is None:
                opened[d].remove(again)
                chosen = again
            elif where[1]:
                p, _, j = where
                paths[p].rest[j] = -np.inf
                chosen, others = _open_chunk(t, paths[p], p, j, top, s)
                opened[d] += others
            else:
                p, _, j = where
                chosen = _of_row(paths[p], p, j, d, top)
                paths[p].row_rest[j] = -np.inf
            edge, own, rest = _other_edge(lattice, chosen, _draw_one(t, chosen.chunk, chosen.at, s, 0))
            if rest > 1e-12 * own:
                low = _below_one(top, chosen.reached + float(np.log(rest)), _draw_one(t, chosen.chunk, chosen.at, s, 1))
                opened[d].append(_Set(low, chosen.sample, chosen.chunk, chosen.lead, chosen.at, (*chosen.out, edge), chosen.reached))
            start[d] = chosen.reached + float(np.log(own))
            heads[d] = (chosen, edge)
        kappa = limit
        if s == k or not heads:
            break
        going = np.array(sorted(heads), np.int64)
        chunk = np.array([heads[d][0].chunk for d in going.tolist()], np.int64)
        at = np.array([heads[d][0].at + int(lattice.size[heads[d][1]]) for d in going.tolist()], np.int64)
        steps = np.zeros(len(t.type) + 1, np.int64)
        np.add.at(steps, chunk + 1, 1)
        np.add.at(steps, t.chunk_first[going + 1], -1)
        later = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
        on = at < t.end[chunk]
        path = _Path(t, later, t.nodes(chunk[on], at[on], np.zeros(int(on.sum())), s), start, limit, s)
        for d in going.tolist():
            chosen, edge = heads[d]
            nodes, edges = [*chosen.lead[0], chosen.at], [*chosen.lead[1], edge]
            path.lead[d] = (chosen.sample, chosen.chunk, nodes, edges)
            rows = slice(path.row_first[d], path.row_first[d + 1])
            own = path.nodes["chunk"][rows] == chosen.chunk
            nodes, edges = np.concatenate([nodes, path.nodes["at"][rows][own]]).astype(np.int64), np.concatenate([edges, path.nodes["edge"][rows][own]]).astype(np.int64)
            head_ids = lattice.spell(edges, nodes)[0]
            c = chosen.chunk - t.chunk_first[d]
            before, marked = samples[d][chosen.sample], marks[d][chosen.sample]
            base = int(marked[c])
            lo, hi = path.chunk_first[d], path.chunk_first[d + 1]
            samples[d].append(np.concatenate([before[:base], head_ids, spans(path, d)]))
            marks[d].append(np.concatenate([marked[: c + 1], path.id_ends[lo:hi] - path.id_ends[lo] + base + len(head_ids)]))
            out[d].append((float(path.log_p[d]), float(limit[d])))
        paths.append(path)
    final = []
    for d in range(n):
        cap = kappa[d] if alive[d] else -np.inf
        final.append([(p, g, _log_inclusion(p, cap), x.astype("<u4")) for (p, g), x in zip(out[d], samples[d])])
    return final


def _of_row(path: _Path, p: int, j: int, d: int, top: float) -> _Set:
    """The set that a node of a sample left behind."""
    rows = path.nodes
    chunk = int(rows["chunk"][j])
    first = int(np.searchsorted(rows["chunk"], chunk))
    nodes, edges = rows["at"][first:j].tolist(), rows["edge"][first:j].tolist()
    sample = p
    if d in path.lead and path.lead[d][1] == chunk:
        sample, _, lead_nodes, lead_edges = path.lead[d]
        nodes, edges = lead_nodes + nodes, lead_edges + edges
    return _Set(top, sample, chunk, (nodes, edges), int(rows["at"][j]), (int(rows["edge"][j]),), float(path.row_reached[j]))


def _other_edge(lattice: Lattice, chosen: _Set, u: float) -> tuple[int, float, float]:
    """(edge, its mass, the mass of those that remain) drawn from the edges that the set hasn't left by."""
    rank = int(lattice.rank[chosen.at])
    low = int(lattice.first[rank])
    high = int(lattice.first[rank + 1]) if rank + 1 < lattice.nodes else lattice.edges
    mass = lattice.mass[low:high].copy()
    mass[np.array(chosen.out) - low] = 0
    pick = min(int(np.searchsorted(np.cumsum(mass), u * mass.sum())), int(np.flatnonzero(mass).max()))
    own = float(mass[pick])
    mass[pick] = 0
    return low + pick, own, float(mass.sum())


def _log_inclusion(log_p: float, kappa: float) -> float:
    """log(1 - exp(-exp(log_p - kappa))); 0 if every path was taken."""
    if kappa == -np.inf:
        return 0.0
    d = log_p - kappa
    return float(d) if d < -30 else float(np.log(-np.expm1(-np.exp(min(d, 30.0)))))


def _ids(pieces: Pieces, t: Texts, nodes: dict[str, np.ndarray], rows: slice) -> np.ndarray:
    return _ids_of(pieces, t, nodes["at"][rows], nodes["edge"][rows])


def decode_bytes(pieces: Pieces, ids: np.ndarray) -> bytes:
    """The text's UTF-8; the mark that every non-empty text is given in front goes."""
    return b"".join(pieces.bytes_of[ids])[1:]


def decode(pieces: Pieces, ids: np.ndarray) -> str:
    return decode_bytes(pieces, ids).decode("utf-8", "surrogatepass")


def row_seed(key: object) -> int:
    return int.from_bytes(blake2b(repr(key).encode(), digest_size=8).digest(), "little")


SAMPLE = [
    T.StructField("sample", T.IntegerType()), T.StructField("log_prob", T.DoubleType()), T.StructField("perturbed", T.DoubleType()),
    T.StructField("log_inclusion", T.DoubleType()), T.StructField("ids", T.BinaryType()), T.StructField("round_trip", T.BooleanType()),
]


def sample_segmentations(df: DataFrame, model: str, k: int = 3, theta: float = THETA, id_col: str = "doc_id", text_col: str = "text", lattice_nodes: int = LATTICE_NODES) -> DataFrame:
    """(id, sample, log_prob, perturbed, log_inclusion, ids, round_trip): up to k distinct segmentations of each text.

    sample counts from 0 in falling order of the perturbed log-probability; log_prob is the path's normalised log-probability;
    log_inclusion the log-probability that the path is among the k, given the threshold; ids little-endian unsigned 32-bit
    piece ids; round_trip whether they decode to the text.  A text with fewer than k segmentations gives all of them, with
    log_inclusion 0; an empty or null text has the empty one alone.  Draws depend on the id, the text and k's
    prefix only: a larger k adds samples and changes none.  Rows with equal ids and texts get equal samples; a null id is
    a key like others.  lattice_nodes bounds what a task remembers, and changes no result.  Other columns of df are left out.
    """
    kind = df.schema[id_col].dataType.simpleString()
    held = df.sparkSession.sparkContext.broadcast(Pieces(model, theta))  # the vocabulary
    schema = T.StructType([df.schema[id_col], *SAMPLE])
    names = schema.names
    del kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = held.value
        lattice = Lattice(pieces, lattice_nodes + SLICE_CHARS)  # untouched room takes no memory
        for batch in batches:
            release()
            keys, texts = batch.column(id_col), [x or "" for x in batch.column(text_col).to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, size = lo + 1, len(texts[lo])
                while hi < len(texts) and size + len(texts[hi]) <= SLICE_CHARS:
                    size += len(texts[hi])
                    hi += 1
                part = texts[lo:hi]
                seeds = mix(np.array([row_seed(x) for x in keys.slice(lo, hi - lo).to_pylist()], _U))
                if lattice.nodes > lattice_nodes:
                    lattice = Lattice(pieces, lattice_nodes + SLICE_CHARS)
                found = sample_slice(lattice, part, seeds, k)
                rows = [(lo + d, s, *x) for d, samples in enumerate(found) for s, x in enumerate(samples)]
                at, nth, log_p, perturbed, inclusion, ids = zip(*rows)
                utf8 = [x.encode("utf-8", "surrogatepass") for x in part]
                same = [decode_bytes(pieces, x) == utf8[d - lo] for d, x in zip(at, ids)]
                columns = [keys.take(pa.array(at)), pa.array(nth, pa.int32()), pa.array(log_p), pa.array(perturbed), pa.array(inclusion), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(same)]
                yield pa.RecordBatch.from_arrays(columns, names)
                lo = hi

    return df.select(id_col, text_col).mapInArrow(run, schema)
