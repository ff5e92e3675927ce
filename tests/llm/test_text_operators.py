import itertools
import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cartospark.llm import decontaminate as D
from cartospark.llm import hmm_lm as H
from cartospark.llm import quality_classifier as C
from cartospark.llm import quality_rules as Q
from cartospark.llm import sharding as S
from cartospark.llm import token_file as T
from cartospark.llm.words import bare_hashes, hash_words, text_buffers
from tests.llm.helpers import lower, words

ODD = ["", None, " ", "\n", "one", "a\nb\na\n\n b", "é È É", "x" * 5000, "tab\tvt\x0bff\x0ccr\rnb sp\x1c", "a b c d e f g h i a b c d e f g h j", "Ａ fullwidth 𝄞 music"]


def docs(spark, texts, **more):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, kept int")


@pytest.fixture(scope="module")
def documents(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


# --- words --------------------------------------------------------------------------------------------


def test_word_hashes_are_those_of_equal_words():
    texts = [*ODD, "Word word WORD wOrd drow"]
    w = hash_words(*text_buffers(pa.array(texts)))
    found = {}
    for d, t in enumerate(texts):
        own = words(t)
        assert w.first[d + 1] - w.first[d] == len(own)
        for h, x in zip(w.hash[w.first[d] : w.first[d + 1]].tolist(), own):
            assert found.setdefault(h, x) == x
    assert len(set(found.values())) == len(found)


# --- quality rules ------------------------------------------------------------------------------------


def plain_rules(text):
    w, text = words(text, fold=False), text or ""
    lines = [x for x in text.split("\n") if words(x, fold=False)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_rule_counts(spark, documents):
    for df in (docs(spark, ODD), documents.select("doc_id", "text")):
        out = Q.quality_rules(df)
        assert out.columns.count("kept") == 1
        for r in out.collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_rules(r.text), r.doc_id
            assert not (r.base_failed and r.kept)
    assert Q.quality_rules(docs(spark, [])).count() == 0


def test_compression_bands(spark):
    rng = random.Random(3)
    syllables = ["ka", "lo", "mi", "ren", "tas", "ul", "vo", "shi", "dre", "pon"]
    prose = " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(3000))
    noise = " ".join("".join(chr(rng.randint(33, 0x2FFF)) for _ in range(9)) for _ in range(2000))
    loop = " ".join(f"{a} {b}" for a in ("ab", "ba") for b in range(1000)) * 1
    half = prose[:9000] + " ".join(["zz", "yy", "xx"][rng.randrange(3)] for _ in range(9000))
    texts = [prose, noise, "na " * 4000, half, prose[:200] + " " + prose[300:700]]
    kept = [r.kept for r in Q.quality_rules(docs(spark, texts)).orderBy("doc_id").collect()]
    assert kept == [True, False, False, False, True]
    assert loop


@pytest.mark.parametrize("size", [180, 250, 300, 450, 600, 900, 1300, 1800, 3000, 5000, 9000, 20000, 150000])
def test_bands_at_every_length(size):
    """Prose of invented words stays; noise and loops go, alone and behind prose."""
    rng = random.Random(size)
    syllables = "the er on tion an re he in ed nd ha at en es of or nt ea ti to io le is ou ar as de rt ve".split()
    vocabulary = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(3000)]
    weights = [1 / (k + 3) for k in range(3000)]
    prose = lambda n: " ".join(rng.choices(vocabulary, weights, k=n // 3)).capitalize()[:n]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    noise = lambda n: " ".join("".join(rng.choices(letters, k=rng.randint(4, 12))) for _ in range(n // 4))[:n]
    kept = lambda t: bool(Q._measure(*text_buffers(pa.array([t])), Q.WHOLE, Q.CHUNK, Q.BAD_CHUNKS_PERCENT)[-1][0])
    assert kept(prose(size)) and not kept(noise(size)) and not kept(("go on " * size)[:size])
    if size >= 5000:
        assert not kept(prose(size) + " " + noise(size // 2)) and not kept(prose(4096) + " " + noise(4000))


# --- decontamination ----------------------------------------------------------------------------------


def plain_overlap(a, b):
    """Equal words of b in a, over all diagonals: all of them for a short item, those of the best stretch for a longer one."""
    if len(b) < D.SHORTEST:
        return len(b) if a == b else 0
    best = 0
    for shift in range(-len(b) + 1, len(a)):
        same = [0 <= shift + j < len(a) and a[shift + j] == b[j] for j in range(len(b))]
        if len(b) <= D.WHOLE:
            best = max(best, sum(same))
            continue
        every = [(sum(x) - D.SUBSTITUTION * (len(x) - sum(x)), sum(x)) for i in range(len(b)) if same[i] for j in range(i + 1, len(b) + 1) for x in [same[i:j]]]
        best = max(best, max(every, default=(0, 0))[1])
    return best


def needed(b):
    return len(b) if len(b) < D.SHORTEST else math.ceil(0.75 * len(b)) if len(b) <= 17 else 13


def test_decontamination(spark):
    rng = random.Random(5)
    pool = [f"v{i}" for i in range(3000)]
    some = lambda n: [rng.choice(pool) for _ in range(n)]
    items = [some(30) for _ in range(6)] + [some(6), some(3)]
    texts = [some(80) for _ in range(6)]
    texts += [some(20) + items[i] + some(20) for i in range(6)]  # whole passages
    for k, gap in enumerate((9, 8, 10)):  # substituted words
        broken = [f"new{j}" if j % gap == gap - 1 else w for j, w in enumerate(items[k])]
        texts.append(some(5) + broken + some(5))
    texts += [some(9) + items[0][4:20] + some(9), some(9) + items[1][:10] + some(9), items[6] + some(30), items[6][:5] + ["other"], items[7], items[0] * 3]
    rows = [" ".join(t).upper() if i % 2 else " ".join(t) for i, t in enumerate(texts)] + ["", None]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(99, None), (98, ""), (None, " ".join(some(20)))], "item_id long, text string")
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, item_id string")
    found = {r.doc_id: {o.item_id for o in r.overlaps} for r in D.find_overlaps(df, bench).collect()}
    for i, t in enumerate(rows):
        want = {j for j, b in enumerate(items) if plain_overlap(words(t), b) >= needed(b)}
        assert found[i] == want, i
    spans = D.find_overlaps(df, bench).where("doc_id = 6").first().overlaps
    assert [(o.start, o.end, o.item_start, o.matched) for o in spans] == [(20, 50, 0, 30)]
    clean = D.decontaminate(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {i for i, s in found.items() if not s}
    assert D.decontaminate(df, bench.limit(0)).count() == len(rows)


def unseeded(need):
    """A stretch of any length that verification accepts and no mask hits, as 1s and 0s."""
    wide, masks = max(map(len, D.MASKS)), [(len(m), int(m, 2)) for m in D.MASKS]
    todo, seen = [(1, 1, 1, 1, 1, "1")], set()
    while todo:
        bits, size, score, top, hits, shown = todo.pop()
        for same in (0, 1):
            b, n, x, h = (bits << 1 | same) & ((1 << wide) - 1), size + 1, score + (1 if same else -D.SUBSTITUTION), min(need, hits + same)
            if x < 0 or same and any(n >= k and b & m == m for k, m in masks):
                continue
            if x > top and h >= need:
                return shown + str(same)
            t = max(top, x)
            key = (b, min(n, wide), min(x, 60), min(t - x, 60), h)
            if key not in seen:
                seen.add(key)
                todo.append((b, key[1], key[2], key[2] + key[3], h, shown + str(same)))
    return None


def test_every_accepted_stretch_has_a_seed():
    """Every pattern of substitutions that verification accepts, in items of 5 to 17 words, and any stretch of longer ones."""
    masks = [(len(m), int(m, 2)) for m in D.MASKS]
    for n in range(D.SHORTEST, D.WHOLE + 1):
        for k in range(n - needed(range(n)) + 1):
            for out in itertools.combinations(range(n), k):
                bits = sum(1 << i for i in range(n) if i not in out)
                assert any(bits >> s & m == m for w, m in masks for s in range(n - w + 1)), bin(bits)
    assert unseeded(D.LEAST_MATCH) is None
    assert all(D._need(n) == needed(range(n)) for n in range(1, 60))


def test_recall_under_random_substitutions(spark):
    """A tenth of the words of a whole passage substituted at random: at least nine of ten are found, from 8 words up."""
    rng = random.Random(9)
    sizes = (8, 10, 12, 15, 18, 25, 40)
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in sizes}
    rows = []
    for n in sizes:
        for _ in range(150):
            passage = [f"s{rng.random()}" if rng.random() < 0.1 else w for w in items[n]]
            rows.append((len(rows), " ".join([f"b{rng.random()}" for _ in range(9)] + passage + ["after"] * 3), n))
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    found = D.find_overlaps(spark.createDataFrame(rows, "doc_id long, text string, n long"), bench).collect()
    for n in sizes:
        hit = [{o.item_id for o in r.overlaps} == {n} for r in found if r.n == n]
        assert sum(hit) >= 0.9 * len(hit), (n, sum(hit))


def test_verification_equals_the_plain_comparison():
    rng = random.Random(4)
    h = lambda w: np.array([int(x) + 1 for x in w], np.uint64)
    for _ in range(300):
        n = rng.choice([3, 5, 8, 16, 18, 22, 30])
        item = [rng.randrange(3 if rng.random() < 0.3 else 50) for _ in range(n)]
        text = [rng.randrange(50) for _ in range(rng.randint(0, 9))] + [x if rng.random() < 0.8 else 99 for x in item[rng.randint(0, 4) :]] + [rng.randrange(50) for _ in range(rng.randint(0, 9))]
        found = D.verify(h(text), h(item), np.arange(-n + 1, len(text)))
        best = plain_overlap(text, item)
        assert max((x[3] for x in found), default=0) == (best if best >= needed(item) else 0)
        assert all(text[a] == item[c] and text[b - 1] == item[c + b - 1 - a] for a, b, c, _ in found)
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))


def test_a_word_that_fills_a_text_ends_in_seconds(spark):
    import time

    df = spark.createDataFrame([(1, "na " * 20_000), (2, "x y")], "doc_id long, text string")
    start = time.time()
    rows = D.find_overlaps(df, spark.createDataFrame([(7, "na " * 80), (8, "other words here")], "item_id long, text string")).collect()
    assert time.time() - start < 60
    assert {r.doc_id: len(r.overlaps) for r in rows} == {1: 250, 2: 0}


def test_punctuation_and_frequent_substitutions(spark):
    item = [f"w{i}x" for i in range(40)]
    marked = [w + ("," if i % 3 else "!") if i % 2 else f'"{w}' for i, w in enumerate(item)]
    every = {n: [w if i % n else "other" for i, w in enumerate(item)] for n in (4, 5, 6, 7)}
    rows = [(0, " ".join(marked)), *[(n, " ".join(w)) for n, w in every.items()], (99, " ".join(item[::-1]))]
    found = D.find_overlaps(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert {r.doc_id: len(r.overlaps) for r in found.collect()} == {0: 1, 4: 1, 5: 1, 6: 1, 7: 1, 99: 0}


def test_benchmark_in_several_passes_and_without_a_broadcast(spark, monkeypatch, documents, tiny):
    bench = spark.read.parquet(f"{tiny}/benchmark.parquet")
    one = {r.doc_id: {o.item_id for o in r.overlaps} for r in D.find_overlaps(documents, bench).collect()}
    monkeypatch.setattr(D, "SEEDS_PER_PASS", 9000)
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    many = {r.doc_id: {o.item_id for o in r.overlaps} for r in D.find_overlaps(documents, bench).collect()}
    assert one == many and any(one.values())


# --- sharding -----------------------------------------------------------------------------------------


def test_sharding(spark, documents, tmp_path):
    df = documents.withColumn("shard", F.lit("clash")).unionByName(spark.createDataFrame([(None, None, None, None, None, "c"), (5, "dup", None, None, None, "c"), (5, "dup", None, None, None, "c")], documents.withColumn("shard", F.lit("")).schema))
    rows = S.shard_by_slots(df, 8, str(tmp_path / "m")).collect()
    assert len(rows) == df.count()
    sizes, places = Counter(), {}
    for r in rows:
        sizes[r.shard] += r["size"]
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(places) <= set(range(8))
    assert max(sizes.values()) - min(sizes.values()) <= max(r["size"] for r in rows)
    text = {r.doc_id: r.text for r in documents.collect()}
    for r in rows:
        if r.doc_id in text and r.doc_id != 5:
            raw = text[r.doc_id].encode()
            assert (r["size"], r.text_crc32) == (len(raw) + 1, crc32(raw))
    assert S.shard_by_slots(df.limit(0), 8, str(tmp_path / "e")).count() == 0


def test_rebalancing_moves_little(spark, documents, tmp_path):
    rows = S.with_parts(S.measured(documents, slots=512).withColumn("row", F.monotonically_increasing_id()), 512)
    sizes = S.slot_sizes(rows)
    one = S.rebalance(S.even_slot_map(spark, 4, 512), sizes, 4).cache()
    two = S.rebalance(one, sizes, 5).cache()
    before, after = ({(r.virtual_slot, r.part): r.shard for r in m.collect()} for m in (one, two))
    assert set(before) == set(after) and set(after.values()) == set(range(5))
    loads = {r.shard: r.b for r in two.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    fair = sum(loads.values()) / 5
    assert max(loads.values()) < 1.2 * fair
    moved = sum(r.bytes for r in two.collect() if before[r.virtual_slot, r.part] != r.shard)
    assert moved < 1.5 * fair
    back = S.rebalance(two, sizes, 3)
    assert set(r.shard for r in back.collect()) <= {0, 1, 2} and back.count() == one.count()
    S.save_slot_map(one, str(tmp_path / "v"), 1)
    S.save_slot_map(two, str(tmp_path / "v"), 2)
    assert {(r.virtual_slot, r.part): r.shard for r in S.load_slot_map(spark, str(tmp_path / "v"), 2).collect()} == after
    with pytest.raises(Exception, match="(?i)exists"):
        S.save_slot_map(two, str(tmp_path / "v"), 2)


def test_one_row_that_repeats_is_spread(spark, documents, tmp_path):
    """Half of all bytes are copies of one row, with a null id."""
    bulk = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("copy " * 100).alias("text"))
    df = documents.select("doc_id", "text").unionByName(bulk)
    rows = S.shard_by_slots(df, 8, str(tmp_path / "m")).collect()
    sizes = Counter()
    places = {}
    for r in rows:
        sizes[r.shard] += r["size"]
        places.setdefault(r.shard, []).append(r.slot)
    assert max(sizes.values()) - min(sizes.values()) <= 501 * (3000 // S.PARTS + 1)  # a part of the copies
    assert len(rows) == df.count() and all(sorted(p) == list(range(len(p))) for p in places.values())
    first = {r.virtual_slot: r.shard for r in S.load_slot_map(spark, str(tmp_path / "m"), 1).collect()}
    assert first == {i: i % 8 for i in range(S.SLOTS)}


# --- language model -----------------------------------------------------------------------------------


def test_forward_equals_all_paths():
    rng = np.random.default_rng(2)
    model = H.Model(*(x / x.sum(axis=-1, keepdims=True) for x in (rng.random(3), rng.random((3, 3)))), b=rng.random((H.CLASSES, 3)))
    seqs = [[5, 9, 9, 7], [1], [2, 3]]
    flat, sizes = np.array(sum(seqs, []), np.uint16), np.array([len(s) for s in seqs])
    got = H.log_likelihood(model, flat, sizes)
    for s, g in zip(seqs, got):
        total = 0.0
        for path in np.ndindex(*[3] * len(s)):
            p = model.pi[path[0]] * model.b[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.a[path[t - 1], path[t]] * model.b[s[t], path[t]]
            total += p
        assert g == pytest.approx(math.log(total))
    first, moves, b = H.expected_counts(model, flat, sizes)
    assert first.sum() == pytest.approx(3) and moves.sum() == pytest.approx(4, rel=1e-5) and b.sum() == pytest.approx(7, rel=1e-5)


@pytest.mark.parametrize("piece", [1, 2, 7, 64])
def test_pieces_change_nothing(monkeypatch, piece):
    rng = np.random.default_rng(6)
    model = H.Model(*(x / x.sum(axis=-1, keepdims=True) for x in (rng.random(4), rng.random((4, 4)))), b=rng.random((H.CLASSES, 4)))
    sizes = np.array([1, 30, 7, 2, 500, 64, 8])
    flat = rng.integers(0, 90, sizes.sum()).astype(np.uint16)
    whole = H.log_likelihood(model, flat, sizes), *H.expected_counts(model, flat, sizes)
    monkeypatch.setattr(H, "PIECE", piece)
    for x, y in zip(whole, (H.log_likelihood(model, flat, sizes), *H.expected_counts(model, flat, sizes))):
        assert np.allclose(x, y, rtol=1e-4, atol=1e-5)


def test_one_very_long_text():
    import time

    n, start = 400_000, time.time()
    model = H.Model.start(np.ones(H.CLASSES), 8)
    flat = (np.arange(n) * 7919 % 5000).astype(np.uint16)
    assert np.isfinite(H.log_likelihood(model, flat, np.array([n]))).all()
    assert H.expected_counts(model, flat, np.array([n]))[2].sum() == pytest.approx(n, rel=1e-4)
    assert time.time() - start < 60


def test_sums_in_several_steps(spark, documents, monkeypatch):
    df = documents.select("doc_id", "text").repartition(5)
    score = lambda: {r.doc_id: r.score for r in H.score_documents(df, rounds=2).collect()}
    one = score()
    monkeypatch.setattr(H, "FAN_IN", 2)
    assert one == pytest.approx(score(), rel=1e-6)


def test_baum_welch_never_loses_likelihood():
    rng = np.random.default_rng(4)
    flat, sizes = rng.integers(0, 50, 600).astype(np.uint16), np.full(20, 30)
    n = np.bincount(flat, minlength=H.CLASSES).astype(float)
    model, last = H.Model.start(n, 4), -np.inf
    for _ in range(5):
        now = H.log_likelihood(model, flat, sizes).sum()
        assert now >= last - 1e-6
        last = now
        pi, a, b = H.expected_counts(model, flat, sizes)
        model = H.Model(pi / pi.sum(), a / a.sum(axis=1, keepdims=True), b / b.sum(axis=0))


def test_scores(spark, documents):
    df = documents.select("doc_id", "text").unionByName(docs(spark, ["", None, "zzz"]).select((F.col("doc_id") + 100000).alias("doc_id"), "text")).unionByName(spark.createDataFrame([(None, "null id")], "doc_id long, text string"))
    rows = {r.doc_id: r for r in H.score_documents(df).collect()}
    texts = {r.doc_id: r.text for r in df.collect()}
    held = {i: crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i in texts}
    tokens = {i: [*words(t), None] for i, t in texts.items()}
    counts = Counter(x for i, t in tokens.items() if not held[i] for x in t)
    n, v = sum(counts.values()), len(counts)
    for i, r in rows.items():
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens[i])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens[i]), sum(counts[x] > 0 for x in tokens[i]), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    out = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert H.score_documents(df.limit(0)).count() == 0


# --- token files --------------------------------------------------------------------------------------


def test_variable_length_coding():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = T.pack(ranks)
        assert len(control) == -(-n // 4) and (T.unpack(control, data, n) == ranks).all()
    assert len(T.pack(np.array([0, 255, 256, 65535, 65536, 2**24], np.uint32))[1]) == 1 + 1 + 2 + 2 + 3 + 4


def test_token_file(spark, documents, tmp_path):
    from tokenizers import Tokenizer

    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    odd = ["a  b\n c", "it's 5.5, ok. x...", "\ttab", "a\n\nb", " lead", "end ", "x.\ny,z 3.\n'tis", "é. ñ, 中文。 a.b. C,", "", None, "a b c", "don't. I'll, \nhe.", "0. 1, a1. ².", "\n", ".a", "x <|endoftext|> y", "“q” – it's… ok.", ". , .", "　x", "\x1c y\x85 z"]
    df = documents.select("doc_id", "text").unionByName(docs(spark, odd).select((F.col("doc_id") + 10**6).alias("doc_id"), "text")).withColumn("start", F.lit("clash")).repartition(5)
    T.write_token_file(df, str(tmp_path / "f"), path)
    rows = T.read_token_file(spark, str(tmp_path / "f"), per_doc=lambda d: d.tobytes()).orderBy("id").collect()
    plain, start = Tokenizer.from_file(path), 0
    for r, (i, t) in zip(rows, sorted((r.doc_id, r.text) for r in df.collect())):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (i, start, len(ids), crc32(ids.tobytes()), ids.tobytes()), (i, t)
        start += len(ids)
    assert len(rows) == df.count()
    T.write_token_file(df.limit(0), str(tmp_path / "e"), path)
    assert T.read_token_file(spark, str(tmp_path / "e")).count() == 0


# --- classifier ---------------------------------------------------------------------------------------


def test_classifier_on_held_out_rows(spark, documents):
    d = "/root/testdata/sf0.1"
    all_docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    grades = C.label_grades(labels)
    seen, unseen = grades.where("doc_id % 2 = 0"), grades.where("doc_id % 2 = 1")
    w, t = C.train(all_docs, seen.unionByName(spark.createDataFrame([(None, 1), (3, None)], seen.schema)), C.LEVELS)
    assert t[0] < t[1]
    rows = C.grade(all_docs.withColumn("kept", F.lit("clash")), w, t, C.GOOD, C.GOOD_PROB).join(unseen.withColumnRenamed("grade", "truth"), "doc_id").collect()
    kept = {g: (sum(r.kept for r in rows if r.truth == g), sum(r.truth == g for r in rows)) for g in range(3)}
    assert kept[2][0] >= 0.98 * kept[2][1] and kept[0][0] <= 0.3 * kept[0][1] and kept[1][0] <= 0.2 * kept[1][1], kept
    assert all(0 <= r.tail_prob <= 1 and 0 <= r.expected_grade <= 2 for r in rows)


def test_classifier_without_ratings(spark):
    df = docs(spark, ODD)
    w, t = C.train(df, spark.createDataFrame([], "doc_id long, grade int"), 3)
    assert C.grade(df, w, t, 2, 0.5).count() == len(ODD) and C.grade(df.limit(0), w, t, 2, 0.5).count() == 0


def test_gradient_equals_differences_of_the_plain_likelihood():
    """The loss by the book, one text and one grade at a time, and its slopes by differences."""
    rng = np.random.default_rng(5)
    n, wide, levels = 12, 6, 4
    first = np.concatenate([[0], np.cumsum(rng.integers(0, 4, n))])
    columns, values, grades = rng.integers(0, wide, first[-1]), rng.normal(size=first[-1]), rng.integers(0, levels, n)
    w, t = rng.normal(size=wide), np.array([-1.0, 0.2, -0.5])

    def plain(w, t):
        cuts, loss = [t[0], t[0] + math.exp(t[1]), t[0] + math.exp(t[1]) + math.exp(t[2])], 0.0
        for d in range(n):
            score = sum(values[j] * w[columns[j]] for j in range(first[d], first[d + 1]))
            at_most = [1 / (1 + math.exp(score - c)) for c in cuts] + [1.0]
            loss -= math.log(at_most[grades[d]] - (at_most[grades[d] - 1] if grades[d] else 0.0))
        return loss / n

    loss, by_weight, by_step = C.negative_log_likelihood(w, t, C.owners(first), columns, values, grades)
    assert loss == pytest.approx(plain(w, t), rel=1e-9)
    bump = lambda x, i, e: np.concatenate([x[:i], [x[i] + e], x[i + 1 :]])
    for i in range(wide):
        assert by_weight[i] == pytest.approx((plain(bump(w, i, 1e-5), t) - plain(bump(w, i, -1e-5), t)) / 2e-5, abs=1e-7)
    for i in range(levels - 1):
        assert by_step[i] == pytest.approx((plain(w, bump(t, i, 1e-5)) - plain(w, bump(t, i, -1e-5))) / 2e-5, abs=1e-7)


def test_rated_id_with_many_texts(spark):
    """One row for an id comes to the fit; all its rows are graded."""
    rows = [(1, f"bad text number {i}") for i in range(50)] + [(2, "good one"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    w, t = C.train(df, spark.createDataFrame([(1, 0), (1, 2), (2, 2), (3, 1), (9, 1)], "doc_id long, grade int"), 3)
    assert C.grade(df, w, t, 2, 0.5).count() == 52 and np.isfinite(w).all() and t[0] < t[1]


def test_ordinal_gradient_fits_ordered_grades():
    rng = np.random.default_rng(0)
    n = 600
    strength = rng.random(n)
    grades = (strength * 3).astype(int)
    columns, values = np.tile([3, 7], n).astype(np.int32), np.stack([strength, np.ones(n)], axis=1).ravel().astype(np.float32)
    w, t = C.fit(np.arange(0, 2 * n + 1, 2), columns, values, grades, 3, epochs=300)
    score = strength * w[3] + w[7]
    assert t[0] < t[1] and np.mean((score[:, None] > t).sum(axis=1) == grades) > 0.9
    assert lower("ÀBC") == "Àbc"
