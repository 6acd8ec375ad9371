"""Materialized aggregates: both refresh modes give what a rebuild gives, and freshness decides when."""

import random
import time

import pytest

from tarnflow.streaming.materialized import MaterializedTable

SELECT = {"n": "COUNT(*)", "known": "COUNT(v)", "total": "SUM(v)", "low": "MIN(v * 2)", "high": "MAX(d)", "mean": "AVG(v)", "exact": "SUM(d)"}


def add(spark, path, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["a", "b", None, "c"]), rnd.choice([None, *range(9)]), round(rnd.random(), 2)) for _ in range(60)]
    df = spark.createDataFrame(rows, "k string, v int, d double").selectExpr("k", "v", "CAST(d AS DECIMAL(10,2)) AS d")
    df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("mode", ["full", "continuous"])
def test_refreshes_equal_a_rebuild(spark, tmp_path, mode):
    source = str(tmp_path / "in")
    schema = add(spark, source, 1)
    table = MaterializedTable(str(tmp_path / "t"), source, schema, ["k"], SELECT, "v IS NULL OR v < 8", mode)
    for seed in (2, 3):
        table.refresh(spark)
        assert table.read(spark).schema.simpleString() == table.query(spark).schema.simpleString()
        assert rows(table.read(spark)) == rows(table.query(spark))
        table.refresh(spark)  # nothing is new
        assert rows(table.read(spark)) == rows(table.query(spark))
        before = table.read(spark)
        add(spark, source, seed)
        assert rows(before) != rows(table.query(spark))
    table.refresh(spark)
    assert rows(table.read(spark)) == rows(table.query(spark))


def test_only_new_files_are_read(spark, tmp_path):
    import os

    source = str(tmp_path / "in")
    schema = add(spark, source, 1)
    table = MaterializedTable(str(tmp_path / "t"), source, schema, ["k"], {"n": "COUNT(*)"}, mode="continuous")
    table.refresh(spark)
    for name in os.listdir(source):
        os.remove(f"{source}/{name}")  # what was read is not needed again
    add(spark, source, 2)
    table.refresh(spark)
    assert sum(r.n for r in table.read(spark).collect()) == 120


def test_freshness_and_modes(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = add(spark, source, 1)
    table = MaterializedTable(str(tmp_path / "t"), source, schema, ["k"], {"n": "COUNT(*)", "kinds": "COUNT(DISTINCT v)"}, freshness="3 seconds")
    assert not table.continuous and table.refresh_if_due(spark) and not table.refresh_if_due(spark)
    time.sleep(3.1)
    assert table.refresh_if_due(spark) and rows(table.read(spark)) == rows(table.query(spark))
    assert MaterializedTable("x", source, schema, ["k"], SELECT).continuous
    assert not MaterializedTable("x", source, schema, ["k"], {"s": "SUM(v) + SUM(d)"}).continuous
    for bad in ({"mode": "continuous", "select": {"s": "COUNT(DISTINCT v)"}}, {"mode": "sometimes", "select": SELECT}):
        with pytest.raises(ValueError):
            MaterializedTable("x", source, schema, ["k"], **bad)
    with pytest.raises(ValueError, match="never refreshed"):
        MaterializedTable(str(tmp_path / "none"), source, schema, ["k"], SELECT, mode="full").read(spark)
