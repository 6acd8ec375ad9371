"""State that expires, and pipelines that start, name, trigger and restart their own streams."""

import os
import time
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from tarnflow.functions.types import Watermark
from tarnflow.plans.pipeline import Pipeline
from tarnflow.streaming import runner
from tarnflow.streaming.stateful import match_stream, top_n_stream

START = datetime(2024, 1, 1)


def add(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize(("ttl", "kept"), [(None, [9, 7]), ("1 second", [7])])
def test_top_n_forgets_after_ttl(spark, tmp_path, ttl, kept):
    path, schema = str(tmp_path / "in"), "k string, v int, d decimal(20,2), at timestamp, tags array<string>"
    stream = spark.readStream.schema(schema).parquet
    last = []

    def keep(rows):
        found = rows.orderBy("rownum").collect()
        if found:
            last[:] = found

    def run():
        before = list(last)
        top = top_n_stream(stream(path), ["k"], [("v", True)], 2, ttl)
        query = runner.start(top, str(tmp_path / "c"), "update", sinks=[keep], trigger={"processingTime": "200 milliseconds"})
        until = time.time() + 60
        while last == before and time.time() < until:
            time.sleep(0.2)
        query.stop()

    add(spark, path, [("a", 9, Decimal("1.25"), START, ["x", None])], schema)
    run()
    assert [tuple(r) for r in last] == [("a", 9, Decimal("1.25"), START, ["x", None], 1)]
    time.sleep(2)
    add(spark, path, [("a", 7, None, None, None)], schema)
    run()
    assert [r.v for r in last] == kept


@pytest.mark.parametrize(("ttl", "found"), [(None, [(1, 2)]), ("1 second", [])])
def test_patterns_forget_after_ttl(spark, tmp_path, ttl, found):
    path, schema = str(tmp_path / "in"), "k long, v int, ts timestamp"
    rows = [[(7, 1, START)], [(7, 2, START + timedelta(minutes=1))], [(0, 0, START + timedelta(hours=2))], [(0, 0, START + timedelta(hours=3))]]
    for some in rows:
        add(spark, path, some, schema)
        stream = spark.readStream.schema(schema).parquet(path)
        query = match_stream(stream, ["k"], Watermark("ts", "1 minute"), "A B", {"A": "v = 1", "B": "v = 2"}, {"a": ("A.v", "INT"), "b": ("B.v", "INT")}, "10 minutes", ttl)
        runner.start(query, str(tmp_path / "c"), path=str(tmp_path / "o")).awaitTermination()
        time.sleep(1.2)
    assert [(r.a, r.b) for r in spark.read.schema("k long, a int, b int").parquet(str(tmp_path / "o")).collect()] == found


def test_pipeline_options_act(spark, tmp_path):
    """State store, checkpoint folder, trigger and restarts come from the pipeline."""
    path, schema = str(tmp_path / "in"), "k string, v int"
    add(spark, path, [("a", 1), ("a", 2), ("b", 5)], schema)
    seen, failures = [], [1, 1]

    def sink(rows):
        if failures:
            failures.pop()
            raise RuntimeError("lost")
        seen.extend(map(tuple, rows.collect()))

    flow = Pipeline("ranks", mode="streaming", checkpoint="2 seconds", checkpoint_path=str(tmp_path / "cp"), state_backend="rocksdb", restart=3)
    rows = flow.source(spark.readStream.schema(schema).parquet(path), name="rows")
    top = rows.top_n(partition_by=["k"], order_by={"v": "DESC"}, n=1)
    top.stream_to("best", available_now=True, sinks=[sink])
    assert "2" in flow.trigger()["processingTime"]
    assert not [f for f in flow.check() if f.level == "error"]
    query = flow.run(spark)["best"]
    query.awaitTermination()
    assert sorted(seen) == [("a", 2, 1), ("b", 5, 1)] and query.left == 1
    assert os.path.isdir(tmp_path / "cp" / "ranks" / "best" / "offsets")
    flow.options["state_ttl"] = "1 hour"
    with pytest.raises(ValueError, match="does not end"):
        flow.run(spark)
    with pytest.raises(ValueError, match="checkpoint_path"):
        bare = Pipeline("bare", mode="streaming")
        bare.source(spark.readStream.schema(schema).parquet(path), name="rows").stream_to("out", path=str(tmp_path / "o"))
        bare.run(spark)


def test_options_of_a_query_do_not_stay(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    with runner.session_options(spark, {key: "x"}):
        assert spark.conf.get(key) == "x"
    assert spark.conf.get(key, None) == before
