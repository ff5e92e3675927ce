import pytest

import corpus_pipeline as P
from cartospark.llm import queries as Q
from cartospark.llm.quality_rules import quality_rules
from cartospark.llm.store import Scratch
from tests.llm.helpers import classes, words


@pytest.fixture(scope="module")
def steps(spark, tiny):
    scratch, docs = Scratch(spark, "steps"), spark.read.parquet(f"{tiny}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        docs = scratch.keep(stage(spark, docs, tiny), str(k))
        out.append(docs)
    return out


def test_stages(steps, spark, tiny):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "quality rules", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding and decoding"]
    for df in steps[1:5]:
        assert df.columns == steps[0].columns
    sizes = [df.count() for df in steps[:5]]
    assert sizes == sorted(sizes, reverse=True) and sizes[4] > 0.3 * sizes[0]


def test_decisions(steps, spark, tiny):
    ids = [{r.doc_id: r.text for r in df.select("doc_id", "text").collect()} for df in steps[:5]]
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{tiny}/labels.parquet").collect()}
    rated = [i for i in ids[0] if i in labels]
    right = sum((i in ids[1]) == (labels[i] == (1, 0)) for i in rated)
    assert right >= 0.95 * len(rated)
    judged = {r.doc_id for r in quality_rules(steps[1], prefix="x_").where("x_kept").collect()}
    assert set(ids[2]) == judged
    want, _ = classes(ids[2], 5, 80)
    assert set(ids[3]) == set(want.values())
    items = [words(r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    joined = [" " + " ".join(w) + " " for w in items]
    whole = {i for i, t in ids[3].items() if any(b in " " + " ".join(words(t)) + " " for b in joined)}
    assert whole.isdisjoint(ids[4]) and len(set(ids[3]) - set(ids[4])) <= len(whole) + 2


def test_samples_of_what_is_left(steps):
    rows = steps[5].collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in steps[4].collect()} and all(r.round_trip for r in rows)


def test_run(spark, tiny, steps):
    key = lambda df: sorted((r.doc_id, r["sample"], r.ids_crc32) for r in df.collect())
    assert key(P.run(spark, tiny)) == key(steps[5])


def test_empty_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, tiny)
        assert docs.count() == 0
        docs = docs if "text" in docs.columns else docs


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_contract_columns(spark, tiny, name):
    wanted = {
        "op1": {"doc_id", "n_shingles", "component_id"}, "op3": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}, "op4": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
        "op5": {"doc_id", "start", "n_tokens", "ids_crc32"}, "op6": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}, "op9": {"page_id", "url", "text", "n_chars"},
    }.get(name.split("_")[0], set())
    kinds = dict(Q.QUERIES[name](spark, tiny).dtypes)
    assert wanted <= set(kinds)
    assert all(kinds[c] == "bigint" for c in wanted & {"doc_id", "n_shingles", "component_id", "size", "text_crc32", "slot", "n_tokens", "train_tokens", "ids_crc32", "n_words", "n_chars"})


def test_queries_run_from_another_folder(tmp_path):
    """Workers get the package even if the driver wasn't started in the repository."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(P.__file__).resolve().parent
    code = (
        f"import sys; sys.path.insert(0, {str(root)!r})\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "import __spark_entry__ as e\n"
        "print('ROWS', e.queries()['op6_quality_rules'](s, '/root/testdata/sf0.001').count(), e.queries()['wkt_codec'](s, '/root/testdata/sf0.001').count())\n"
    )
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 200 200" in out.stdout, out.stderr[-2000:]


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_sql_gives_the_same(spark, tiny, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    df = Q.QUERIES[name](spark, tiny)
    found = con.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    flat = lambda rows: sorted((tuple(round(v, 5) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v for v in r) for r in rows), key=str)
    assert flat(df.select(*names).collect()) == flat(found.fetchall())
