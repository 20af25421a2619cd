import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def rows(df):
    return sorted(map(tuple, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(entry.catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, DIR).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_whole_matrices_are_multiplied(spark):
    queries, n = entry.queries(), entry.catalogue.Tables(spark, DIR).n_supp()
    parts = entry.catalogue.Tables(spark, DIR).n_part()
    sizes = {"spmv_dense": n, "to_dense": 12 * parts, "spmv_into_slice": n + 15, "matmul_add": 12 * (n + 4)}
    assert {name: queries[name](spark, DIR).count() for name in sizes} == sizes
    want = {r.i: r.v for r in queries["spmv"](spark, DIR).collect()}
    into = {r.i: r.v for r in queries["spmv_into_slice"](spark, DIR).collect()}
    assert all(into[i + 7] == v for i, v in want.items())


def test_entry(spark):
    assert entry.entry(spark).count() == 10
