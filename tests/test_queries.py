"""Every query with an SQL twin gives the twin's rows; the others give rows."""

import pandas as pd
import pytest

from turnloom import queries as Q

from .conftest import DATA


def rows(df):
    df = df[sorted(df.columns)]

    def cell(x):
        if x is None or pd.isna(x):
            return "None"
        return str(int(x)) if isinstance(x, float) and x == int(x) else str(x)

    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, duck, name):
    a, b = Q.QUERIES[name](spark, DATA).toPandas(), duck.sql(Q.ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_query_without_twin_has_rows(spark, name):
    assert Q.QUERIES[name](spark, DATA).take(1)


NAMES = (
    "The Größe The Größe", "Foo Baŕ Foo Baŕ", "Foo Bar\u0301 Foo Bar\u0301", "ÉFoo Bar ÉFoo Bar", "Foo\x0bBar Foo, Bar Foo", "Foo Bar\u00a0Foo Bar",
    "Foo\x0bBar Foo\x0bBar Foo", "New York CityX new york New York", "xNew York New_York New York9", "New\r\nYork, New\r\nYork", "The " * 20000 + ("The " * 9999 + "End. ") * 2, "", None,
)


def test_names_equal_sql_beside_other_letters_blanks_and_in_long_groups(spark, tmp_path):
    import duckdb

    spark.createDataFrame(list(enumerate(NAMES)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    name = "proper_noun_topics_documents"
    a, b = Q.QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(Q.ORACLES[name]).df()
    assert len(b) and rows(a) == rows(b)
