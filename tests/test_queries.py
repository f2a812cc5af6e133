"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from swathlake.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    clean = lambda v: None if v is None or v != v else float(v) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(clean(r[k]) for k in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    r = duck.execute(catalog.oracle_sql()[name])
    want = rows([d[0] for d in r.description], r.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in r.description)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=2e-6, rel=1e-9) if all(not isinstance(v, (str, bool, type(None))) for v in (*a, *b)) else a == b or repr(a) == repr(b)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
