"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features and ordered thresholds t_0 < t_1 < ...:

    P(grade <= j) = sigmoid(t_j - w . x)

so a text's score moves the whole distribution over grades; the expected grade and the probability of the
upper tail come from it.  Fitting uses a bounded sample of rated rows (SAMPLE, a parameter), chosen by
the hash of their ids, in one task; scoring covers every text in one Arrow pass without a shuffle.

Features of a text with n words, hashed into 2^BITS columns: its words without outer punctuation, their beginnings, and
their shapes (case, last bytes, length), each with value sqrt(count / n); and a few measures of the whole text (length, distinct words,
capitals, symbols) cut into bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import LETTER, Words, bare_spans, hash_words, mix, slices

BITS = 18
STEMS = (4, 6)  # bytes of a word's beginning that are features too
SAMPLE = 16384
EPOCHS = 150
RATE = 0.15
DECAY = 1e-5

_U = np.uint64
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_KIND = np.zeros(256, np.uint8)  # classes of bytes for shapes
_KIND[33:48] = np.arange(33, 48)
_KIND[58:65] = np.arange(58, 65)
_KIND[91:97] = np.arange(91, 97)
_KIND[123:128] = np.arange(123, 128)
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 1, 2, 3, 3


def _bins(doc_stats: np.ndarray, salt: int) -> np.ndarray:
    return mix(doc_stats.astype(np.int64).astype(_U) + _U(salt << 32))


def features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, columns, values): columns and values of text d are at first[d]:first[d + 1]."""
    data, doc, n_docs = words.data, words.doc, words.n_docs
    n = np.diff(words.first)
    start, end = bare_spans(words)
    core = words.spans(start, end)
    stems = [mix(words.spans(start, np.minimum(start + k, end)) + _U(k << 44)) for k in STEMS]
    last, before = data[words.end - 1], data[np.maximum(words.end - 2, words.start)]
    second = data[np.minimum(words.start + 1, words.end - 1)]
    shape = np.zeros(len(core), _U)
    for part in (_KIND[last], _KIND[before], _KIND[data[words.start]], _UPPER[second], np.minimum(words.end - words.start, 20) // 4):
        shape = shape * _U(131) + part.astype(_U)
    capitals, symbols = _UPPER[second] & (words.end - words.start > 1), ~LETTER[last] & ~np.isin(last, [44, 46])
    share = lambda flag: 20 * np.bincount(doc[flag], minlength=n_docs) // np.maximum(n, 1)
    order = np.lexsort((core, doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (core[order][1:] != core[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order[fresh]], minlength=n_docs)
    stats = [np.log2(n + 1), 20 * distinct // np.maximum(n, 1) + 32 * (np.log2(n + 1).astype(int) // 2), share(capitals), share(symbols)]
    key = np.concatenate([core, mix(shape + _U(1 << 40)), *stems, *[_bins(x, 100 + i) for i, x in enumerate(stats)]]) >> _U(64 - BITS)
    every = np.arange(n_docs)
    per_word = 2 + len(stems)
    owner = np.concatenate([*[doc] * per_word, *[every] * len(stats)])
    is_bin = np.zeros(len(key), bool)
    is_bin[per_word * len(doc) :] = True
    joint = (owner.astype(_U) << _U(BITS + 1)) + (key << _U(1)) + is_bin.astype(_U)
    found, counts = np.unique(joint, return_counts=True)
    d = (found >> _U(BITS + 1)).astype(np.int64)
    values = np.where(found & _U(1), 0.3, np.sqrt(counts / np.maximum(n[d], 1))).astype(np.float32)
    return np.searchsorted(d, np.arange(n_docs + 1)), ((found >> _U(1)) & _U((1 << BITS) - 1)).astype(np.int32), values


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each value."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def negative_log_likelihood(w: np.ndarray, t: np.ndarray, owner: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(mean loss, its gradient by the weights and by the parameters t of the thresholds: the first one, then logs of the steps)."""
    n = len(grades)
    cuts = np.concatenate([[-np.inf], np.cumsum(np.concatenate([t[:1], np.exp(t[1:])])), [np.inf]])
    score = np.bincount(owner, weights=values * w[columns], minlength=n)
    upper, lower = _sigmoid(cuts[grades + 1] - score), _sigmoid(cuts[grades] - score)
    p = np.maximum(upper - lower, 1e-9)
    du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
    by_weight = np.bincount(columns, weights=values * ((du - dl) / n)[owner], minlength=len(w))
    by_cut = np.zeros(len(t) + 2)
    np.add.at(by_cut, grades + 1, -du / n)
    np.add.at(by_cut, grades, dl / n)
    tail = np.cumsum(by_cut[1:-1][::-1])[::-1]  # a step moves all thresholds above it
    return float(-np.log(p).mean()), by_weight, tail * np.concatenate([[1.0], np.exp(t[1:])])


def fit(first: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, levels: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by maximum likelihood with adaptive full-batch steps."""
    w, m, v = np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(1 << BITS)
    share = np.clip(np.cumsum(np.bincount(grades, minlength=levels))[:-1] / max(1, len(grades)), 1e-3, 1 - 1e-3)
    base = np.log(share / (1 - share))
    # thresholds as a first one and positive steps
    t = np.concatenate([base[:1], np.log(np.maximum(np.diff(base), 1e-2))])
    tm, tv = np.zeros_like(t), np.zeros_like(t)
    owner = owners(first)
    for epoch in range(1, epochs + 1):
        _, g, tg = negative_log_likelihood(w, t, owner, columns, values, grades)
        g += DECAY * w
        for x, gx, mx, vx in ((w, g, m, v), (t, tg, tm, tv)):
            mx += 0.1 * (gx - mx)
            vx += 0.01 * (gx * gx - vx)
            x -= RATE * (mx / (1 - 0.9**epoch)) / (np.sqrt(vx / (1 - 0.99**epoch)) + 1e-8)
    return w.astype(np.float32), np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))


def train(docs: DataFrame, ratings: DataFrame, levels: int, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Fits on at most `sample` rated ids. ratings(id, grade int from 0 to levels - 1); null ids or grades don't count.

    An id that is rated several times has its lowest grade; of texts that share an id the one with the least hash counts, chosen
    with map-side combine, so an id with any number of rows sends one.  A null text is an empty one.
    Without rated texts the weights are 0 and every grade is as likely as the next.
    """
    chosen = ratings.where(F.col(id_col).isNotNull() & F.col("grade").isNotNull()).select(F.col(id_col).alias("__id"), "grade")
    chosen = chosen.groupBy("__id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    rated = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")  # `sample` rows
    rated = rated.groupBy("__id").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text"), F.min("grade").alias("grade"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in slices(batch, "__text"):
                first, columns, values = features(hash_words(data, bounds))
                cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([part.column("__id").cast(pa.string()), part.column("grade"), cut(columns), cut(values)], ["id", "grade", "columns", "values"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        columns = [np.frombuffer(x, np.int32) for x in pdf["columns"]]
        first = np.concatenate([[0], np.cumsum([len(c) for c in columns])])
        values = np.concatenate([np.frombuffer(x, np.float32) for x in pdf["values"]])
        w, t = fit(first, np.concatenate(columns), values, pdf["grade"].to_numpy(), levels)
        return pd.DataFrame({"w": [w.tobytes()], "t": [t.tobytes()]})

    rows = rated.mapInArrow(read, "id string, grade int, columns binary, values binary").withColumn("all", F.lit(0)).groupBy("all").applyInPandas(solve, "w binary, t binary").collect()  # one row
    if not rows:
        return np.zeros(1 << BITS, np.float32), np.log(np.arange(1, levels) / np.arange(levels - 1, 0, -1))
    return np.frombuffer(rows[0].w, np.float32), np.frombuffer(rows[0].t, float)


GRADE_FIELDS = [T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_prob", T.DoubleType()), T.StructField("kept", T.BooleanType())]


def grade(df: DataFrame, weights: np.ndarray, thresholds: np.ndarray, least: int, least_prob: float, text_col: str = "text", prefix: str = "") -> DataFrame:
    """df with expected_grade, tail_prob = P(grade >= least) and kept = tail_prob >= least_prob, named with the prefix.

    A null or empty text has the features of an empty one.  Repeated rows are graded alike.  Columns of df with the
    added names are replaced.
    """
    names = [prefix + f.name for f in GRADE_FIELDS]
    left = [c for c in df.columns if c not in names]
    schema = T.StructType([df.schema[c] for c in left] + [T.StructField(n, f.dataType) for n, f in zip(names, GRADE_FIELDS)])
    held = df.sparkSession.sparkContext.broadcast((weights, thresholds))  # 2^BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, t = held.value
        for batch in batches:
            for part, data, bounds in slices(batch, text_col):
                first, columns, values = features(hash_words(data, bounds))
                total = np.concatenate([[0.0], np.cumsum(values * w[columns], dtype=float)])
                score = total[first[1:]] - total[first[:-1]]
                above = 1 - _sigmoid(t[None, :] - score[:, None])  # P(grade > j)
                tail = above[:, least - 1]
                added = [pa.array(above.sum(axis=1)), pa.array(tail), pa.array(tail >= least_prob)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in left] + added, left + names)

    return df.select(*[f"`{c}`" for c in left]).mapInArrow(run, schema)


#: Grades of the labels table: 0 toxic, 1 poor, 2 good.
LEVELS, GOOD, GOOD_PROB = 3, 2, 0.5


def label_grades(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select(id_col, grade.cast("int").alias("grade"))
