"""Running operators on streams: output modes, keyed sinks, replay, restarts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.functions.types import Schema, Watermark, to_interval, with_watermark
from tarnflow.plans.pipeline import Changelog
from tarnflow.sources.writers import KeyedTable, write_all


def output_mode(changelog: Changelog, watermarked: bool) -> str:
    """``append`` where rows are final, ``update`` where keyed rows change, else ``complete``."""
    if changelog.mode == "append-only" or watermarked:
        return "append"
    return "update" if changelog.key else "complete"


def replay(spark: SparkSession, path: str, schema: Schema, files_per_batch: int = 1) -> DataFrame:
    """Parquet files as a stream, in the order of their times; rows should be in event order over the files."""
    df = spark.readStream.schema(schema.to_spark()).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return with_watermark(df, schema.watermark)


def deduplicate_stream(df: DataFrame, key: list[str], watermark: Watermark) -> DataFrame:
    """The first row of each key within the watermark's delay."""
    return with_watermark(df, watermark).dropDuplicatesWithinWatermark(key)


def distinct_count(column: str) -> F.Column:
    """An exact distinct count that streams allow."""
    return F.size(F.collect_set(column)).cast("long")


#: The state store that keeps typed state; hash maps in memory do not.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def session_options(spark: SparkSession, options: dict[str, str]) -> Iterator[None]:
    """Options for what starts inside; a query keeps those it was started with."""
    before = {k: spark.conf.get(k, None) for k in options}
    for key, value in options.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def start(
    df: DataFrame,
    checkpoint: str,
    mode: str = "append",
    sinks: list[Callable[[DataFrame], None]] | None = None,
    table: KeyedTable | None = None,
    path: str | None = None,
    memory: str | None = None,
    trigger: dict | None = None,
    options: dict[str, str] | None = None,
):
    """Start a query into files, a keyed table, several sinks at once, or memory.

    Keyed tables and sinks get micro-batches with their number, so a batch that is repeated after
    a failure counts once in a keyed table. State is kept in RocksDB unless ``options`` name another store.
    """
    writer = df.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(**(trigger or {"availableNow": True}))
    if table:
        writer = writer.foreachBatch(lambda rows, number: table.write(rows, number, checkpoint))
    elif sinks:
        writer = writer.foreachBatch(lambda rows, number: write_all(rows, sinks))
    elif memory:
        writer = writer.format("memory").queryName(memory)
    else:
        writer = writer.format("parquet").option("path", path)
    with session_options(df.sparkSession, ROCKSDB | (options or {})):
        return writer.start()


class Supervised:
    """A query that starts again from its checkpoint when it fails, a bounded number of times."""

    def __init__(self, make: Callable[[], object], attempts: int = 3, wait_s: float = 1.0) -> None:
        self.make, self.left, self.wait_s = make, attempts, wait_s
        self.query = make()

    def awaitTermination(self) -> None:
        while True:
            try:
                self.query.awaitTermination()
                return
            except StreamingQueryException:
                if not self.left:
                    raise
                self.left -= 1
                time.sleep(self.wait_s)
                self.query = self.make()

    def __getattr__(self, name: str):
        return getattr(self.query, name)


def run_with_restarts(make: Callable[[], object], attempts: int = 3, wait_s: float = 1.0) -> None:
    """Start a query, wait for its end, and start it again from its checkpoint if it fails."""
    Supervised(make, attempts, wait_s).awaitTermination()


def window_counts(df: DataFrame, watermark: Watermark, size: str | int, key: list[str], select: dict[str, str]) -> DataFrame:
    """A tumbling aggregation that emits each window once, when the watermark has passed it."""
    from tarnflow.operators.aggregate import tumble

    return tumble(with_watermark(df, watermark), watermark.column, size, key, select)


def join_streams(left: DataFrame, right: DataFrame, on: str, left_time: Watermark, right_time: Watermark, before: str | int, after: str | int, how: str = "inner") -> DataFrame:
    """Interval join of two streams: right rows from ``before`` earlier to ``after`` later than the left row."""
    from tarnflow.operators.joins import interval_join

    l_time, r_time = left_time.column, right_time.column
    return interval_join(
        with_watermark(left, left_time), with_watermark(right, right_time), on,
        f"l.{l_time} - INTERVAL {to_interval(before)}", f"l.{l_time} + INTERVAL {to_interval(after)}", r_time, how,
    )
