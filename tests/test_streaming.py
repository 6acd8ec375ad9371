from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarnflow.functions.types import Schema, Watermark
from tarnflow.operators import aggregate
from tarnflow.plans.pipeline import Changelog
from tarnflow.sources.readers import generated_source
from tarnflow.sources.writers import KeyedTable
from tarnflow.streaming import runner
from tarnflow.streaming.stateful import match_stream, top_n_stream

SCHEMA = Schema({"id": "BIGINT", "k": "STRING", "ts": "TIMESTAMP_LTZ(3)", "v": "DOUBLE"}, Watermark("ts", "5 minutes"))


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """Six files in the order of time, some rows twice."""
    path = str(tmp_path_factory.mktemp("feed") / "in")
    start = datetime(2024, 1, 1)
    for part in range(6):
        rows = [(part * 20 + i, "ab"[i % 2], start + timedelta(minutes=part * 20 + i), float(i)) for i in range(20)]
        spark.createDataFrame([*rows, rows[0]], SCHEMA.to_spark()).coalesce(1).write.mode("append").parquet(path)
    return path


def finish(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_windows_equal_batch(spark, feed, tmp_path):
    aggregates = {"n": "COUNT(*)", "total": "SUM(v)"}
    stream = aggregate.tumble(runner.replay(spark, feed, SCHEMA), "ts", "10 minutes", ["k"], aggregates)
    finish(runner.start(stream, str(tmp_path / "c"), path=str(tmp_path / "o")))
    got = spark.read.parquet(str(tmp_path / "o"))
    want = aggregate.tumble(spark.read.parquet(feed), "ts", "10 minutes", ["k"], aggregates).where(F.col("window_end") <= F.lit(datetime(2024, 1, 1, 1, 50)))
    assert sorted(map(tuple, got.where(F.col("window_end") <= F.lit(datetime(2024, 1, 1, 1, 50))).collect())) == sorted(map(tuple, want.collect()))


def test_deduplicate_and_distinct(spark, feed, tmp_path):
    raw = spark.readStream.schema(SCHEMA.to_spark()).option("maxFilesPerTrigger", 1).parquet(feed)
    finish(runner.start(runner.deduplicate_stream(raw, ["id"], SCHEMA.watermark), str(tmp_path / "c"), path=str(tmp_path / "o")))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 120
    counted = runner.replay(spark, feed, SCHEMA).groupBy("k").agg(runner.distinct_count("id").alias("ids"))
    finish(runner.start(counted, str(tmp_path / "c2"), "complete", memory="distinct_ids"))
    assert sorted(map(tuple, spark.table("distinct_ids").collect())) == [("a", 60), ("b", 60)]


def test_keyed_sink_and_several_sinks(spark, feed, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ["k"], ["ts", "id"])
    finish(runner.start(runner.replay(spark, feed, SCHEMA, 3), str(tmp_path / "c"), table=table))
    assert sorted(r.id for r in table.read(spark).collect()) == [118, 119]
    seen = []
    finish(runner.start(runner.replay(spark, feed, SCHEMA, 3), str(tmp_path / "c2"), sinks=[lambda d: seen.append(d.count()), lambda d: seen.append(d.where("k = 'a'").count())]))
    assert sum(seen[::2]) == 126 and sum(seen[1::2]) == 66


def test_top_n_stream(spark, feed, tmp_path):
    top = top_n_stream(runner.replay(spark, feed, SCHEMA).select("id", "k", "v", "ts"), ["k"], [("v", True), ("id", False)], 2)
    last = {}

    def keep(rows):
        for r in rows.collect():
            last[(r.k, r.rownum)] = (r.id, r.v, r.ts)

    finish(runner.start(top, str(tmp_path / "c"), "update", sinks=[keep]))
    at = {r.id: r.ts for r in spark.read.parquet(feed).collect()}
    assert last == {("a", 1): (18, 18.0, at[18]), ("a", 2): (38, 18.0, at[38]), ("b", 1): (19, 19.0, at[19]), ("b", 2): (39, 19.0, at[39])}


def test_stream_join(spark, feed, tmp_path):
    raw = spark.readStream.schema(SCHEMA.to_spark()).parquet(feed)
    left, right = raw.select(F.col("id").alias("a"), "k", F.col("ts").alias("at")), raw.select(F.col("id").alias("b"), "k", F.col("ts").alias("bt"))
    joined = runner.join_streams(left, right, "l.k = r.k", Watermark("at", "5 minutes"), Watermark("bt", "5 minutes"), "0 s", "2 minutes")
    finish(runner.start(joined, str(tmp_path / "c"), path=str(tmp_path / "o")))
    pairs = {(r.a, r.b) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert pairs == {(i, j) for i in range(120) for j in (i, i + 2) if j < 120}


def test_modes_and_rate_source(spark):
    assert runner.output_mode(Changelog(), False) == "append"
    assert runner.output_mode(Changelog("retract", ("k",)), False) == "update"
    assert runner.output_mode(Changelog("retract"), False) == "complete"
    assert generated_source(spark, SCHEMA, rows_per_second=5).isStreaming
    tries = []

    class Query:
        def awaitTermination(self):
            from pyspark.errors import StreamingQueryException

            tries.append(1)
            if len(tries) < 3:
                raise StreamingQueryException("lost")

    runner.run_with_restarts(Query, 3, 0)
    assert len(tries) == 3


def test_patterns_equal_batch(spark, feed, tmp_path):
    from tarnflow.operators import pattern

    define = {"A": "v % 5 = 0", "B": "v % 5 <> 0", "C": "v % 6 >= 4"}
    measures = {"started": ("FIRST(A.ts)", "TIMESTAMP_LTZ"), "low": ("FIRST(A.v)", "DOUBLE"), "high": ("LAST(C.v)", "DOUBLE"), "n": ("COUNT(*)", "BIGINT")}
    raw = spark.readStream.schema(SCHEMA.to_spark()).option("maxFilesPerTrigger", 1).parquet(feed)
    found = match_stream(raw, ["k"], SCHEMA.watermark, "A B{1,3} C", define, measures, "20 minutes")
    finish(runner.start(found, str(tmp_path / "c"), path=str(tmp_path / "o")))
    until = F.col("started") < F.lit(datetime(2024, 1, 1, 1, 20))
    got = spark.read.parquet(str(tmp_path / "o")).where(until)
    want = pattern.match_rows(spark.read.parquet(feed), ["k"], ["ts"], "A B{1,3} C", define, measures).where(until)
    assert got.count() > 3 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
