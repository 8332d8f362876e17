"""Every registered query against its DuckDB SQL on the small tables, or at least to a result."""

import duckdb
import pytest

from quarrydeck.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def plain(df):
    return sorted((tuple(None if x is None or x != x else str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, sf, con, name):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), con.execute(registry.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_flagship(spark, sf):
    assert 0 < registry.flagship(spark, sf).count() <= 10
