import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from cartospark.llm import segmentation as S
from cartospark.llm.words import mix

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return S.Pieces(MODEL)


def every_path(pieces, text):
    """All segmentations of a short text by trying every cut: {ids: normalised log-probability}."""
    known = {}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            known[sp.id_to_piece(i)] = i
    marked = "▁" + text.replace(" ", "▁")
    byte = float(pieces.log_p[pieces.byte_id[0]])
    out = {}

    def walk(at, ids, weight):
        if at == len(marked):
            out[tuple(ids)] = weight
            return
        for end in range(at + 1, min(len(marked), at + pieces.width) + 1):
            if marked[at:end] in known:
                i = known[marked[at:end]]
                walk(end, [*ids, i], weight + float(pieces.log_p[i]))
        if marked[at] not in known:
            raw = marked[at].encode()
            walk(at + 1, [*ids, *(int(pieces.byte_id[b]) for b in raw)], weight + byte * len(raw))

    walk(0, [], 0.0)
    total = np.logaddexp.reduce(list(out.values()))
    return {k: v - total for k, v in out.items()}


def draw(pieces, text, n, k):
    lattice, out = S.Lattice(pieces), []
    for lo in range(0, n, 500):
        seeds = mix(np.arange(lo, min(n, lo + 500), dtype=np.uint64) + np.uint64(1))
        out += S.sample_slice(lattice, [text] * len(seeds), seeds, k)
    return out


@pytest.mark.parametrize("text", ["the cat", "abc\nde", "né x"])
def test_samples_follow_the_law(pieces, text):
    truth = every_path(pieces, text)
    found = draw(pieces, text, 4000, 2)
    first, both = Counter(), Counter()
    for samples in found:
        ids = [tuple(x[3].tolist()) for x in samples]
        assert len(set(ids)) == len(ids) == min(2, len(truth))
        for i, x in zip(ids, samples):
            assert x[0] == pytest.approx(truth[i], abs=1e-9)
        assert all(a[1] >= b[1] for a, b in zip(samples, samples[1:]))
        first[ids[0]] += 1
        both.update(ids)
    p = {k: math.exp(v) for k, v in truth.items()}
    for path, chance in p.items():
        for counts, expected in ((first, chance), (both, chance + sum(q * chance / (1 - q) for other, q in p.items() if other != path and q < 1))):
            spread = math.sqrt(max(expected * (1 - expected), 1e-9) / 4000)
            assert abs(counts[path] / 4000 - expected) < 5 * spread + 1e-3


def test_all_paths_without_replacement(pieces):
    truth = every_path(pieces, "ab")
    for samples in draw(pieces, "ab", 20, 31):
        assert {tuple(x[3].tolist()) for x in samples} == set(truth) and all(x[2] == 0 for x in samples)


def test_inclusion_is_unbiased(pieces):
    """Weighted by 1 / inclusion, k samples sum to the number of paths' total probability, 1, on average."""
    total = 0.0
    for samples in draw(pieces, "there is", 3000, 4):
        total += sum(math.exp(p - q) for p, _, q, _ in samples)
    assert total / 3000 == pytest.approx(1, abs=0.1)


def test_more_samples_change_none(pieces):
    two, five = (draw(pieces, "some words here, and there.\nmore", 30, k) for k in (2, 5))
    for a, b in zip(two, five):
        assert [x[3].tolist() for x in a] == [x[3].tolist() for x in b[:2]] and [x[1] for x in a] == [x[1] for x in b[:2]]


def test_documents(spark, tiny):
    odd = ["", None, " ", "  two  spaces ", "▁literal▁mark", "a" * 3000, "𝄞 é 中文\t\x00x", "x"]
    df = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    df = df.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)] + [(None, "null id"), (5, "twice"), (5, "twice")], "doc_id long, text string")).withColumn("sample", F.lit("clash"))
    out = S.sample_segmentations(df, MODEL, k=3)
    rows = out.collect()
    assert all(r.round_trip for r in rows)
    per = Counter(r.doc_id for r in rows)
    assert per[10**6] == 1 and per[10**6 + 1] == 1 and per[5] == 6 + (df.where("doc_id = 5").count() - 2) * 3
    assert all(bytes(r.ids) == b"" and r.log_prob == 0 for r in rows if r.doc_id in (10**6, 10**6 + 1))
    again = S.sample_segmentations(df.repartition(7), MODEL, k=3)
    key = lambda d: sorted((r.doc_id or -1, r["sample"], bytes(r.ids), round(r.log_prob, 6)) for r in d.collect())
    assert key(out) == key(again)
    assert S.sample_segmentations(df.limit(0), MODEL).count() == 0
    p = S.Pieces(MODEL)
    text = {r.doc_id: r.text for r in df.collect()}
    for r in rows[:200]:
        assert S.decode(p, np.frombuffer(r.ids, "<u4")) == (text[r.doc_id] or "") or r.doc_id == 5
