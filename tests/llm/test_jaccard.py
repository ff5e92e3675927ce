import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartospark.llm import jaccard_join as J
from cartospark.llm.components import connected_components
from cartospark.llm.store import Scratch
from tests.llm.helpers import classes, shingle_set


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 120))] for _ in range(n // 3)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append((i, " ".join(w)))
    return out + [(n, ""), (n + 1, None), (n + 2, " \n "), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "one two")]


@pytest.mark.parametrize("size,percent,chunk", [(3, 90, 1 << 18), (5, 80, 1 << 18), (3, 60, 150)])
def test_equals_brute_force(spark, monkeypatch, size, percent, chunk):
    monkeypatch.setattr(J, "CHUNK_TOKENS", chunk)
    rows = corpus(size * 100 + percent)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, sets = classes(dict(rows), size, percent)
    got = {r.doc_id: r for r in J.jaccard_join(df, size=size, percent=percent).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}


def test_group_whose_members_link_only_in_part(spark, monkeypatch):
    """A chain: each text shares enough with the next one only; cut into small chunks."""
    monkeypatch.setattr(J, "CHUNK_TOKENS", 490)
    w = [f"t{i}" for i in range(400)]
    rows = [(i, " ".join(w[i * 4 : i * 4 + 100])) for i in range(40)]
    want, _ = classes(dict(rows), 3, 85)
    got = {r.doc_id: r.component_id for r in J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=85).collect()}
    assert got == want and set(want.values()) == {0}


@pytest.mark.parametrize("size,percent,n", [(3, 90, 11), (5, 80, 8)])
def test_set_without_a_token_to_spare_links_with_a_larger_one(spark, size, percent, n):
    w = [f"t{i}" for i in range(40)]
    rows = [(1, " ".join(w[:n])), (2, " ".join(w[: n + 1])), (3, " ".join(w[20 : 19 + n])), (4, " ".join(w[20 : 20 + n]))]
    want, _ = classes(dict(rows), size, percent)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert want == {1: 1, 2: 1, 3: 3, 4: 4}  # a set that is smaller by one doesn't link any more
    assert {r.doc_id: r.component_id for r in J.jaccard_join(df, size=size, percent=percent).collect()} == want
    assert sorted(r.doc_id for r in J.drop_near_copies(df, size=size, percent=percent).collect()) == [1, 3, 4]


@pytest.mark.parametrize("percent,chunk", [(90, 1 << 18), (60, 120)])
def test_links_are_all_of_them(spark, monkeypatch, percent, chunk):
    """Copies, groups of mutually similar texts and pairs across groups: every link counts once at either end."""
    monkeypatch.setattr(J, "CHUNK_TOKENS", chunk)
    w = [f"t{i}" for i in range(60)]
    near = [w[:40], w[:41], w[:42], w[1:42], w[1:43], w[2:44], w[:40], w[3:47], w[30:], w[10:50]]
    rows = [(i, " ".join(t)) for i, t in enumerate(near)] + [(100 + i, t) for i, t in corpus(percent, 60)]
    sets = {i: shingle_set(t, 3) for i, t in rows}
    want = {i: sum(1 for j, y in sets.items() if i != j and x & y and 100 * len(x & y) >= percent * len(x | y)) for i, x in sets.items()}
    got = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size=3, percent=percent)
    assert {r.doc_id: r.links for r in got.collect()} == want


def test_rows_of_blocks_grow_with_the_sets_not_with_their_pairs(spark):
    """Near copies of one text, and many texts round one passage: no step makes a row for each pair."""
    w = [f"t{i}" for i in range(60)]
    near = [(i, " ".join([*w[:30], f"x{i}", *w[31:]])) for i in range(60)]
    around = [(100 + i, " ".join([*w[:6], *(f"y{i}_{j}" for j in range(3))])) for i in range(60)]
    tokens = lambda i: sorted(hash(s) & ((1 << 63) - 1) for s in shingle_set(dict(near + around)[i], 3))
    first = [(t, k, i, len(tokens(i))) for i, _ in near + around for k, t in enumerate(tokens(i)[:6])]
    groups = [(i, len(tokens(i)), (i % 7, 5), 1) for i, _ in near + around]
    first = spark.createDataFrame(first, "tok long, place long, sig long, n long")
    groups = spark.createDataFrame(groups, "sig long, n long, head struct<sig long, n long>, copies long")
    assert J._blocks_within(groups).count() == len(near + around)
    assert J._blocks_across(J._meetings(first, groups, 60)).count() <= 6 * len(near + around)


def test_level_tables_that_are_summed_in_two_steps(spark, monkeypatch):
    rows = [(i, f"a b c {' '.join(f'w{j}' for j in range(i % 7 * 3, 40))}") for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    one = J._level_tables(df, "text", 3, 2000)
    monkeypatch.setattr(J, "BUCKET_TOKENS", 40)
    two = J._level_tables(df, "text", 3, 64 * 4 * 40 * 3)
    assert [t.nbytes for t in one] == [1 << 13, 1 << 10, 1 << 10] and one[0].any() and two[0].any()
    few = [[J._levels(t, J.mix(np.arange(1000, dtype=np.uint64))) for t in x] for x in ([one], [two])]
    assert [len(x[0]) for x in few] == [1000, 1000]


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c d", 5), (1, "a b c d", 6), (None, "a b c d", 7), (None, None, 8), (2, "x", 9)], "doc_id long, text string, n long")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in J.jaccard_join(df).collect())
    assert got == [(-1, 0, -1), (-1, 2, 1), (1, 2, 1), (1, 2, 1), (2, 1, 2)]
    assert J.jaccard_join(df.limit(0)).count() == 0
    left = J.drop_near_copies(df, size=3, percent=90)
    assert left.columns == df.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in left.collect()) == [(-1, ""), (1, "a b c d"), (2, "x")]
    clash = df.withColumns({"__n": F.lit(1), "__SIG": F.lit("s"), "__id": F.lit(2), "__many": F.lit(True)})
    assert J.drop_near_copies(clash, size=3, percent=90).columns == clash.columns and J.drop_near_copies(clash, size=3, percent=90).count() == 3


def test_drop_keeps_one_of_each_group(spark):
    rows = corpus(7)
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, n_shingles string")
    want, _ = classes(dict(rows), 5, 80)
    left = J.drop_near_copies(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(want.values()))


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 500)] + [(7, 7)]
    root = {}
    for a, b in links:
        root.setdefault(a, a), root.setdefault(b, b)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()
    assert {r.node: r.root for r in got} == {x: find(x) for x in root if any(x in p and p[0] != p[1] for p in links)}
    assert len(got) == len({r.node for r in got})
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_shingle_sizes_of_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    got = {r.doc_id: r.n_shingles for r in J.jaccard_join(docs.select("doc_id", "text", F.lit(1).alias("links"))).collect()}
    assert got == {r.doc_id: len(shingle_set(r.text, 3)) for r in docs.collect()}


def test_crowd_of_near_copies_meets_in_few_groups(spark, monkeypatch):
    """Rows that move for a crowd grow with its sets, not with their square; every set still links with all of its partners."""
    rng, met = random.Random(5), []
    rows = []
    for i in range(300):
        w = [f"b{k}" for k in range(150)]
        for k in rng.sample(range(150), rng.choice([2, 7])):
            w[k] = f"v{k}-{rng.randrange(4)}"
        rows.append((i, " ".join(w)))
    keep = Scratch.keep

    def counted(self, df, name, *more):
        out = keep(self, df, name, *more)
        met.extend([out.count()] if name == "meet0" else [])
        return out

    monkeypatch.setattr(Scratch, "keep", counted)
    want, sets = classes(dict(rows), 3, 85)
    got = {r.doc_id: r for r in J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=85).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    near = lambda a, b: 100 * len(a & b) >= 85 * len(a | b)
    assert {i: r.links for i, r in got.items()} == {i: sum(near(sets[i], sets[j]) for j in sets if j != i) for i in sets}
    assert met[0] < 3 * len(rows), met


def test_sets_that_meet_by_chance_leave_their_blocks(spark):
    """Only sets that share a print under every later order with another one of their block, on its other side, stay."""
    p = lambda *x: np.array(x, np.uint32).tobytes()
    rows = [
        (1, 1, 0, 0, None, 1, 5, 1, p(1, 2), p(7)), (1, 1, 0, 0, None, 2, 5, 1, p(2, 3), p(7, 8)), (1, 1, 0, 0, None, 3, 5, 1, p(3), p(9)),
        (1, 2, 0, 0, False, 1, 5, 1, p(1), p(7)), (1, 2, 0, 0, False, 2, 5, 1, p(1), p(7)), (1, 2, 0, 0, True, 4, 5, 1, p(6), p(7)),
        (2, 3, 0, 0, False, 5, 5, 1, p(4), p(6)), (2, 3, 0, 0, True, 6, 5, 1, p(4), p(6)), (2, 3, 0, 0, True, 7, 5, 1, p(4), b""),
    ]
    blocks = spark.createDataFrame(rows, f"{J._BLOCK}, p1 binary, p2 binary")
    want = [(1, 1, 1), (1, 1, 2), (2, 3, 5), (2, 3, 6)]
    assert sorted((r.g, r.h, r.sig) for r in J._filtered(blocks).collect()) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # blocks over several batches
    try:
        assert sorted((r.g, r.h, r.sig) for r in J._filtered(blocks.coalesce(1)).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_shuffle_files_go_when_the_next_table_is_kept(spark):
    """Those of the last one may stay, as its frame is still held."""
    files = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if "shuffle_" in f.getName()}
    before, scratch = files(), Scratch(spark, "sweep")
    for k in range(4):
        scratch.keep(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 5).alias("x")).count(), str(k))
    until = time.time() + 10
    while len(left := {f.split("_")[1] for f in files() - before}) > 2 and time.time() < until:
        time.sleep(0.2)
    assert len(left) <= 2  # a query has two
