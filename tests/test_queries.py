"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("SKEIN_TEST_TABLES", "/root/testdata/sf0.001")
CORE = {k: v for k, v in entry.queries().items() if v.__module__.startswith("skein.plans")}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def normal(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_matches_sql(spark, duck, name):
    got = CORE[name](spark, DATA).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    want = duck.execute(sql).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
