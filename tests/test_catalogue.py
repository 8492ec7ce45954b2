"""Every registered query of the engine against its SQL, and the driver's contract."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from quillspark.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    from pathlib import Path

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sql, name):
    found = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.SQL:
        want = sql.sql(catalogue.SQL[name]).df()
        assert sorted(found.columns) == sorted(want.columns) and plain(found) == plain(want)
    else:
        assert len(found)


def test_entry(spark):
    rows = entry.entry(spark).toPandas()
    assert len(rows) == 142 and list(rows.columns) == ["uri", "score", "terms"] and rows.score.is_monotonic_decreasing


def test_texts_of_pages(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    texts = catalogue.QUERIES["strip_html"](spark, SF).toPandas()
    assert len(texts) == len(pages) and not texts.text.str.contains(r"<p>|<div|&amp;").any()
