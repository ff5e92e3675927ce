"""Every registered query runs at the smallest scale, with its SQL's columns and rows."""

import duckdb
import pytest

from cartospark import queries as Q

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con(tiny):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    return c


def values(rows):
    flat = lambda v: round(v, 5) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
    return sorted(tuple(map(flat, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, tiny, con, name):
    df = Q.QUERIES[name](spark, tiny)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    if name not in Q.ORACLE_SQL:
        assert got
        return
    found = con.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = [tuple(r[i] for i in order) for r in found.fetchall()]
    fill = lambda rows: values([tuple(-1 if v is None else v for v in r) for r in rows])
    assert fill(got) == fill(want)


def test_entry_without_training_operators(spark):
    import __spark_entry__ as entry

    assert set(Q.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
