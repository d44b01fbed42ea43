"""Every registered analytics query against its SQL oracle on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from strataframe.plans import catalog, catalog_eval, catalog_more, catalog_pages, catalog_policies, catalog_rest, catalog_text  # noqa: F401  (registers its queries)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    told = lambda v: None if pd.isna(v) else str(v) if isinstance(v, str | pd.Timestamp) or type(v).__name__.startswith("bool") else float(v)
    return sorted((tuple(map(told, r)) for r in frame[sorted(frame.columns)].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(name, spark, sf_dir, duck):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalog.ORACLE_SQL:
        want = duck.execute(catalog.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
