import duckdb
import pytest

import __spark_entry__ as contract
from tarnflow import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(value):
    if isinstance(value, float):
        return float(f"{value:.8g}")
    if isinstance(value, (list, tuple)):
        return tuple(same(v) for v in value)
    return value


def listed(rows, columns):
    return sorted(repr([same(row[c]) for c in sorted(columns)]) for row in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    found = [r.asDict(recursive=True) for r in df.collect()]
    if name not in catalog.SQL:
        assert found
        return
    with duckdb.connect() as db:
        for table in TABLES:
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
        result = db.execute(catalog.SQL[name])
        columns = [c[0] for c in result.description]
        wanted = [dict(zip(columns, row, strict=True)) for row in result.fetchall()]
    assert sorted(df.columns) == sorted(columns)
    assert listed(found, columns) == listed(wanted, columns)


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = catalog.QUERIES["flagship_hourly_activity"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,0.0)" in plan
    assert "props" not in plan and "event_type" not in plan
