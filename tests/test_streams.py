"""The message log and the row counter: offsets, startup modes, restarts, rates."""

import time
from datetime import datetime, timezone

import pytest

from tarnflow.functions.types import Schema
from tarnflow.sources import readers
from tarnflow.sources.streams import register

SCHEMA = Schema({"id": "BIGINT", "v": "STRING", "part": "INT", "at": "BIGINT"}, metadata={"part": "partition", "at": "offset"})


def send(spark, path, ids, seconds=0, partitions=3):
    register(spark)
    at = datetime.fromtimestamp(1_700_000_000 + seconds, timezone.utc)
    df = spark.createDataFrame([(f"k{i}", f'{{"id": {i}, "v": "x{i}"}}', at) for i in ids], "key string, value string, timestamp timestamp").coalesce(2)
    df.write.format("message_log").options(path=path, topic="t", partitions=partitions).mode("append").save()


def drain(stream, folder, name):
    stream.writeStream.option("checkpointLocation", str(folder / f"c-{name}")).trigger(availableNow=True).format("parquet").option("path", str(folder / f"o-{name}")).start().awaitTermination()
    return sorted(r.id for r in stream.sparkSession.read.parquet(str(folder / f"o-{name}")).collect())


def test_offsets_and_restarts(spark, tmp_path):
    path = str(tmp_path / "log")
    send(spark, path, range(10))
    raw = spark.read.format("message_log").options(path=path, topic="t").load()
    by_part = {}
    for r in raw.collect():
        by_part.setdefault(r.partition, []).append(r.offset)
    assert len(by_part) == 3 and all(sorted(v) == list(range(len(v))) for v in by_part.values())

    def stream():
        return readers.topic_source(spark, "t", SCHEMA, log=path)

    assert drain(stream(), tmp_path, "a") == list(range(10))
    assert drain(stream(), tmp_path, "a") == list(range(10))  # nothing comes twice
    send(spark, path, range(10, 25))
    assert drain(stream(), tmp_path, "a") == list(range(25))  # goes on at the offset
    rows = spark.read.parquet(str(tmp_path / "o-a")).collect()
    assert len({(r.part, r["at"]) for r in rows}) == 25
    keyed = raw.sparkSession.read.format("message_log").options(path=path, topic="t").load().selectExpr("CAST(key AS STRING) AS k", "partition").distinct()
    assert keyed.count() == 25  # a key keeps its partition


def test_startup_modes(spark, tmp_path):
    path = str(tmp_path / "log")
    send(spark, path, range(5))
    send(spark, path, range(5, 9), seconds=100)

    def ids(startup, streaming=False):
        df = readers.topic_source(spark, "t", SCHEMA, log=path, startup=startup, streaming=streaming)
        return drain(df, tmp_path, f"s{len(startup)}") if streaming else sorted(r.id for r in df.collect())

    assert ids("earliest") == list(range(9)) and ids("latest") == []
    assert ids("1700000050000") == [5, 6, 7, 8] and ids("1700000050000", True) == [5, 6, 7, 8]
    ends = {str(r.partition): r.n for r in spark.read.format("message_log").options(path=path, topic="t").load().groupBy("partition").count().withColumnRenamed("count", "n").collect()}
    some = '{"0": %d}' % ends.get("0", 0)
    assert len(ids(some)) == 9 - ends.get("0", 0)
    with pytest.raises(Exception, match="no such startup"):
        ids("sometime")
    assert readers.topic_source(spark, "none", SCHEMA, log=path, streaming=False).count() == 0


def test_lost_offsets_are_told(spark, tmp_path):
    import os

    path = tmp_path / "log"
    send(spark, str(path), range(6), partitions=1)
    stream = readers.topic_source(spark, "t", SCHEMA, log=str(path), startup='{"0": 2}')
    first = min((path / "t" / "0").iterdir())
    send(spark, str(path), range(6, 9), partitions=1)
    os.rename(first, tmp_path / "moved.parquet")
    with pytest.raises(Exception, match="is gone"):
        drain(stream, tmp_path, "lost")


def test_streams_into_the_log(spark, tmp_path):
    path = str(tmp_path / "log")
    send(spark, path, range(7))
    source = spark.readStream.format("message_log").options(path=path, topic="t", startup="earliest").load().select("key", "value", "timestamp")
    for _ in range(2):
        source.writeStream.format("message_log").options(path=path, topic="copy", partitions=2, writer="q", checkpointLocation=str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        assert readers.topic_source(spark, "copy", SCHEMA, log=path, streaming=False).count() == 7


def test_rate_bound_and_restart(spark, tmp_path):
    """Row numbers go on after a restart, the bound holds, and so does the rate."""
    schema = Schema({"n": "BIGINT", "x": "INT"})

    def run(name, seconds, **options):
        df = readers.generated_source(spark, schema, fields={"n": {"kind": "sequence"}}, **options)
        query = df.writeStream.option("checkpointLocation", str(tmp_path / f"c{name}")).trigger(processingTime="200 milliseconds").format("parquet").option("path", str(tmp_path / f"o{name}")).start()
        began = time.time()
        query.awaitTermination(seconds)
        query.processAllAvailable() if options.get("stream_rows") else None
        query.stop()
        return sorted(r.n for r in spark.read.schema("n long, x int").parquet(str(tmp_path / f"o{name}")).collect()), time.time() - began

    first, took = run("a", 6, rows_per_second=50)
    assert first == list(range(len(first))) and 0 < len(first) <= 50 * took + 50
    second, _ = run("a", 6, rows_per_second=50)
    assert second == list(range(len(second))) and len(second) > len(first)
    assert run("b", 8, rows_per_second=1000, stream_rows=120)[0] == list(range(120))
