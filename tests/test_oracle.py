"""Every query that has SQL gives the SQL's rows on the smallest tables."""

import duckdb
import pytest

from larkspur.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def cell(x):
    if x is None or x != x:
        return None
    return round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, oracle, name):
    want, got = oracle.execute(catalogue.oracle_sql()[name]).df(), catalogue.queries()[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    rows = lambda df: sorted((tuple(cell(x) for x in r) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False)), key=str)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_pushdown_and_pruning(spark):
    """The scan reads the needed columns only and gets the filters."""
    plan = catalogue.queries()["json_key_filter"](spark, SF)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(event_type,view)" in plan and "user_id" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_nothing_imports_the_optional_part():
    from pathlib import Path

    root = Path(catalogue.__file__).resolve().parent.parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "larkspur.llm" not in path.read_text(), path
