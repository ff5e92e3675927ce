"""Hidden Markov language model, trained by Baum-Welch over all partitions.

A text is its words and one end token.  Latent states emit word classes (a hash of a word's last letters,
CLASSES of them, so that unseen words have a class too) and a class emits its words by their corpus counts:

    P(text) = sum over state paths of  pi(s1) prod A(s, s') B(s, class(w))  x  prod P(w | class(w))

Both factors are proper distributions, so scores are log-probabilities of the text over the training
vocabulary and one unknown word a class.  The forward recursion is scaled at every step, which makes the likelihood
exact for texts of any length.

How it scales.  One pass over the texts writes them as blocks: token numbers local to the block and the block's
vocabulary.  Vocabularies, not tokens, are exchanged: every block sends its word hashes and counts, which are summed by word with
map-side combine and joined back.  Each Baum-Welch round reads the blocks and sends fixed-size sufficient
statistics, which are added in groups of FAN_IN; the texts never move.  Blocks hold at most BLOCK_WORDS words (or one document).

Long texts are cut into pieces of PIECE tokens only to work on them side by side: products of the transition steps of each piece
carry the state exactly from piece to piece, forwards and backwards, so training and scores are those of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch
from .words import Words, hash_words, mix, slices

STATES = 8
ROUNDS = 4
CLASSES = 1 << 15
BLOCK_WORDS = 1 << 21
PIECE = 2048  # tokens
SMOOTH = 0.1
FAN_IN = 64
_SLICES = 16

_U = np.uint64
END_HASH = _U(0x3C6EF372FE94F82B)
_END_CLASS = CLASSES - 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_class(words: Words) -> np.ndarray:
    """Class of each word: its last four letters, and whether there are more."""
    key = np.zeros(len(words.start), _U)
    for k in range(1, 5):
        inside = words.end - k >= words.start
        key = key * _U(257) + np.where(inside, _LOWER[words.data[np.maximum(words.end - k, 0)]].astype(_U) + _U(1), _U(0))
    return (mix(key) % _U(CLASSES - 1)).astype(np.uint16)


def held_out(key: object) -> bool:
    """A tenth of the ids: crc32 of the id as text divides by 10. A null id counts as the empty text."""
    return crc32(b"" if key is None else str(key).encode()) % 10 == 0


_BLOCK = "block long, ids array<{}>, sizes binary, held binary, tokens binary, words binary, classes binary, counts binary"


def write_blocks(df: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()

    def pack(number: int, held: list) -> pa.RecordBatch:
        ids = pa.concat_arrays([h[0] for h in held])
        sizes = np.concatenate([h[1] for h in held]).astype(np.int64)
        hashes = np.concatenate([h[2] for h in held])
        classes = np.concatenate([h[3] for h in held])
        words, first, tokens = np.unique(hashes, return_index=True, return_inverse=True)
        out = np.array([held_out(x) for x in ids.to_pylist()], bool)
        train = ~np.repeat(out, sizes)
        counts = np.bincount(tokens[train], minlength=len(words)).astype(np.int32)
        blobs = [sizes, out, tokens.astype(np.int32), words, classes[first], counts]
        column = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([pa.array([number]), column, *[pa.array([x.tobytes()], pa.binary()) for x in blobs]], ["block", "ids", "sizes", "held", "tokens", "words", "classes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for part, data, bounds in slices(batch, text_col):
                words = hash_words(data, bounds)
                n = np.diff(words.first)
                at = words.first[1:] + np.arange(words.n_docs)  # where the end tokens go
                hashes, classes = np.empty(len(words.hash) + len(n), _U), np.empty(len(words.hash) + len(n), np.uint16)
                is_end = np.zeros(len(hashes), bool)
                is_end[at] = True
                hashes[~is_end], classes[~is_end] = words.hash, word_class(words)
                hashes[is_end], classes[is_end] = END_HASH, _END_CLASS
                held.append((part.column(id_col), n + 1, hashes, classes))
                size += len(hashes)
                if size >= BLOCK_WORDS:
                    yield pack(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield pack(number, held)

    return scratch.keep(df.select(id_col, text_col).mapInArrow(run, _BLOCK.format(kind)), "blocks", compression="zstd")


def exchange_counts(blocks: DataFrame, scratch: Scratch) -> tuple[DataFrame, dict]:
    """((block, counts): corpus counts of each block's words; totals by class over the corpus)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, classes, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "classes", "counts"))):
                words = np.frombuffer(words, np.int64)
                columns = [np.full(len(words), block), np.arange(len(words), dtype=np.int32), words, np.frombuffer(classes, np.uint16).astype(np.int32), np.frombuffer(counts, np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["block", "at", "word", "class", "n"])

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(len(pdf), np.int64)
        counts[pdf["at"].to_numpy()] = pdf["c"].to_numpy()
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "counts": [counts.tobytes()]})

    sent = blocks.select("block", "words", "classes", "counts").mapInArrow(send, "block long, at int, word long, class int, n int")
    totals = scratch.keep(sent.groupBy("word").agg(F.sum("n").alias("c"), F.max("class").alias("class")), "totals")
    by_class = totals.where("c > 0").groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("types"))
    out = {k: np.zeros(CLASSES, np.int64) for k in ("n", "types")}
    for row in by_class.collect():  # CLASSES rows at most
        out["n"][row["class"]], out["types"][row["class"]] = row.n, row.types
    back = sent.select("word", "block", "at").join(totals.select("word", "c"), "word").select("block", "at", "c")
    return back.groupBy("block").applyInPandas(pack, "block long, counts binary"), out


class Model:
    """pi, A (states x states) and B (classes x states), all float64."""

    def __init__(self, pi: np.ndarray, a: np.ndarray, b: np.ndarray):
        self.pi, self.a, self.b = pi, a, b

    @classmethod
    def start(cls, n_class: np.ndarray, states: int) -> Model:
        """Sticky transitions; every state prefers a hashed part of the classes."""
        noise = (mix(np.arange(CLASSES * states, dtype=_U) + _U(77)) >> _U(11)).astype(float).reshape(CLASSES, states) * 2.0**-53
        b = (n_class[:, None] + SMOOTH) * np.exp(2.0 * noise)
        a = np.full((states, states), 0.02 / max(1, states - 1))
        np.fill_diagonal(a, 0.98 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), a, b / b.sum(axis=0))

    @classmethod
    def from_counts(cls, pi: np.ndarray, a: np.ndarray, b: np.ndarray, n_class: np.ndarray) -> Model:
        """Expected counts, smoothed; a class's prior weight follows its corpus count."""
        prior = (n_class + SMOOTH) / (n_class + SMOOTH).sum()
        b = b + 50.0 * prior[:, None]
        pi, a = pi + 1.0, a + 1.0
        return cls(pi / pi.sum(), a / a.sum(axis=1, keepdims=True), b / b.sum(axis=0))


def _layout(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences longest first: (their order, starts, how many are alive at each step)."""
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    longest = int(sizes.max(initial=0))
    alive = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(longest), "right")
    return order, starts, alive


class Pieces:
    """Texts cut into pieces of PIECE tokens, with what each piece needs from its neighbours.

    prior: the states' probabilities at its first token given all tokens before it in the text; after: weights of the states
    at its last token by all tokens that follow (of any scale).
    """

    def __init__(self, model: Model, classes: np.ndarray, sizes: np.ndarray):
        k = len(model.pi)
        n = -(-sizes // PIECE)
        self.text = np.repeat(np.arange(len(sizes)), n)
        ends = np.cumsum(n)
        self.nth = np.arange(len(self.text)) - np.repeat(ends - n, n)
        self.sizes = np.full(len(self.text), PIECE, np.int64)
        self.sizes[ends - 1] = sizes - (n - 1) * PIECE
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.prior = np.repeat(model.pi[None], len(self.text), axis=0)
        self.after = np.ones((len(self.text), k))
        several = np.flatnonzero(np.repeat(n, n) > 1)
        if not len(several):
            return
        steps = np.zeros((len(self.text), k, k))
        steps[several] = self._products(model, classes, several)
        most = int(n.max())
        state = np.zeros((len(sizes), k))
        state[:] = model.pi
        for r in range(1, most):  # all texts that have a piece r
            now = np.flatnonzero(n > r)
            before = (ends - n)[now] + r - 1
            moved = np.einsum("ij,ijk->ik", state[now], steps[before])
            state[now] = moved / moved.sum(axis=1, keepdims=True)
            self.prior[before + 1] = state[now] @ model.a
        weight = np.ones((len(sizes), k))
        for r in range(most - 1, 0, -1):
            now = np.flatnonzero(n > r)
            own = (ends - n)[now] + r
            moved = np.einsum("ijk,ik->ij", steps[own], weight[now])
            weight[now] = moved / moved.sum(axis=1, keepdims=True)
            self.after[own - 1] = weight[now]

    def _products(self, model: Model, classes: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The product of each piece's steps (transition, then emission; a text's first token has no transition), scaled."""
        k = len(model.pi)
        order, starts, alive = _layout(self.sizes[which])
        starts = self.starts[which][order]
        out = np.zeros((len(which), k, k))
        out[:] = np.eye(k)
        first = (self.nth[which][order] == 0)[:, None, None]
        for t, n in enumerate(alive.tolist()):
            moved = out[:n] @ model.a if t else np.where(first[:n], out[:n], model.a)
            moved = moved * model.b[classes[starts[:n] + t]][:, None, :]
            out[:n] = moved / moved.sum(axis=(1, 2), keepdims=True)
        back = np.empty_like(out)
        back[order] = out
        return back


def _forward(model: Model, classes: np.ndarray, pieces: Pieces, each) -> None:
    """Scaled forward recursion over all pieces side by side: calls each(places, alpha, scale) at every step."""
    order, _, alive = _layout(pieces.sizes)
    starts, alpha = pieces.starts[order], pieces.prior[order]
    for t, n in enumerate(alive.tolist()):
        if t:
            alpha = alpha[:n] @ model.a
        rows = starts[:n] + t
        alpha = alpha[:n] * model.b[classes[rows]]
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        each(rows, alpha, scale)


def log_likelihood(model: Model, classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log of each sequence's probability, by the scaled forward recursion."""
    scales = np.ones(len(classes))

    def each(rows, _, scale):
        scales[rows] = scale

    _forward(model, classes, Pieces(model, classes, sizes), each)
    total = np.concatenate([[0.0], np.cumsum(np.log(scales))])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def expected_counts(model: Model, classes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts (pi, A, B) of the sequences."""
    k = len(model.pi)
    pieces = Pieces(model, classes, sizes)
    gamma = np.empty((len(classes), k), np.float32)
    scales = np.empty(len(classes))

    def each(rows, alpha, scale):
        gamma[rows], scales[rows] = alpha, scale

    _forward(model, classes, pieces, each)
    order, _, alive = _layout(pieces.sizes)
    starts, last = pieces.starts[order], pieces.starts + pieces.sizes - 1
    ends = gamma[last].astype(float)  # states at each piece's end, from all tokens up to it
    after = (pieces.after / (ends * pieces.after).sum(axis=1, keepdims=True))[order]
    at, moves = model.a.T.copy(), np.zeros((k, k))
    beta, n_after = np.zeros((0, k)), 0
    for t in range(len(alive) - 1, -1, -1):
        n = int(alive[t])
        rows = starts[:n] + t
        new = after[:n].copy()
        if n_after:
            ahead = rows[:n_after] + 1
            weighted = model.b[classes[ahead]] * beta / scales[ahead][:, None]
            moves += gamma[rows[:n_after]].T.astype(float) @ weighted
            new[:n_after] = weighted @ at
        gamma[rows] *= new
        beta, n_after = new, n
    opens = np.empty((len(starts), k))  # the backward weights at each piece's first token
    opens[order] = beta
    later = np.flatnonzero(pieces.nth > 0)
    places = pieces.starts[later]
    moves += ends[later - 1].T @ (model.b[classes[places]] * opens[later] / scales[places][:, None])
    first = gamma[pieces.starts[pieces.nth == 0]].astype(float).sum(axis=0)
    b = np.stack([np.bincount(classes, weights=gamma[:, s], minlength=CLASSES) for s in range(k)], axis=1)
    return first, moves * model.a, b


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, float) for x in pdf["sums"])
    return pd.DataFrame({"part": [pdf["part"].iloc[0]], "task": [pdf["task"].iloc[0]], "sums": [total.tobytes()]})


def baum_welch(blocks: DataFrame, n_class: np.ndarray, states: int, rounds: int) -> Model:
    model = Model.start(n_class, states)
    wide, tasks = CLASSES // _SLICES, blocks.rdd.getNumPartitions()
    for _ in range(rounds):
        held = blocks.sparkSession.sparkContext.broadcast(model)

        def expect(batches, held=held):
            from pyspark import TaskContext

            pi, a, b = np.zeros(states), np.zeros((states, states)), np.zeros((CLASSES, states))
            for batch in batches:
                for sizes, out, tokens, classes in zip(*(batch.column(c).to_pylist() for c in ("sizes", "held", "tokens", "classes"))):
                    sizes, out = np.frombuffer(sizes, np.int64), np.frombuffer(out, bool)
                    train = np.repeat(~out, sizes)
                    if train.any():
                        seq = np.frombuffer(classes, np.uint16)[np.frombuffer(tokens, np.int32)[train]]
                        x, y, z = expected_counts(held.value, seq, sizes[~out])
                        pi, a, b = pi + x, a + y, b + z
            parts = [b[i * wide : (i + 1) * wide].tobytes() for i in range(_SLICES)]
            parts.append(np.concatenate([pi, a.ravel()]).tobytes())
            task = np.full(_SLICES + 1, TaskContext.get().partitionId(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES + 1), pa.int32()), pa.array(task), pa.array(parts, pa.binary())], ["part", "task", "sums"])

        sums, left = blocks.select("sizes", "held", "tokens", "classes").mapInArrow(expect, "part int, task long, sums binary"), tasks
        while left > FAN_IN:  # no task adds more than FAN_IN rows
            left = -(-left // FAN_IN)
            sums = sums.groupBy("part", F.pmod("task", F.lit(left)).alias("task")).applyInPandas(_add, "part int, task long, sums binary")
        sums = sums.groupBy("part").applyInPandas(_add, "part int, task long, sums binary")
        got = {row.part: np.frombuffer(row.sums, float) for row in sums.collect()}  # CLASSES x states numbers
        held.destroy()
        if not got:
            return model
        b = np.concatenate([got[i].reshape(wide, states) for i in range(_SLICES)])
        model = Model.from_counts(got[_SLICES][:states], got[_SLICES][states:].reshape(states, states), b, n_class)
    return model


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of df.

    The model learns from the rows whose id isn't held out (see held_out) and scores all.  Words are lower-cased
    A-Z.  score is the model's log10 probability of the text, base_score the smoothed unigram one.  A null text is
    empty: its end token alone.  Repeated rows count and are scored each; with no training rows every count is 0.
    Other columns of df are left out.
    """
    scratch = Scratch(df.sparkSession, "hmm")
    blocks = write_blocks(df, id_col, text_col, scratch)
    counts, totals = exchange_counts(blocks, scratch)
    model = baum_welch(blocks, totals["n"], states, rounds)
    held = df.sparkSession.sparkContext.broadcast((model, totals))  # CLASSES x states numbers
    kind = df.schema[id_col].dataType.simpleString()
    whole = blocks.select("block", "ids", "sizes", "held", "tokens", "classes").join(counts, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, totals = held.value
        n, v = int(totals["n"].sum()), int(totals["types"].sum())
        inner = totals["n"] + SMOOTH * (totals["types"] + 1)
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c, t: np.frombuffer(batch.column(c)[i].as_py(), t)  # noqa: B023, E731
                sizes, out, tokens, classes = get("sizes", np.int64), get("held", bool), get("tokens", np.int32), get("classes", np.uint16)
                c = get("counts", np.int64)
                ends = np.cumsum(sizes)
                per_doc = lambda x: np.add.reduceat(x[tokens], ends - sizes)  # noqa: B023, E731  every text has its end token
                base = per_doc(np.log10((c + SMOOTH) / (n + SMOOTH * (v + 1))))
                emitted = per_doc(np.log10((c + SMOOTH) / inner[classes]))
                score = log_likelihood(model, classes[tokens], sizes) / np.log(10) + emitted
                columns = [batch.column("ids")[i].values, pa.array(out), pa.array(sizes), pa.array(per_doc((c > 0).astype(np.int64))), pa.array(np.full(len(sizes), n)), pa.array(base), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return whole.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
