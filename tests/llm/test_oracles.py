"""Queries of operators against their SQL on the smallest tables."""

import duckdb
import pytest

from larkspur.llm import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want, got = con.execute(oracles.SQL[name]).df(), queries.queries()[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns) and len(want) > 0
    cell = lambda x: None if x is None or x != x else round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    rows = lambda df: sorted((tuple(map(cell, r)) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False)), key=str)
    assert rows(got) == rows(want)


def test_every_sql_has_its_query():
    assert set(oracles.SQL) < set(queries.queries())
