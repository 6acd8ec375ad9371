"""Sources of Spark's own kind, written in Python: a log of messages by topic and partition, and a counter of rows.

The log keeps messages as Parquet segments ``<path>/<topic>/<partition>/<first offset>-<count>.parquet`` in any
store that Arrow reaches. It has the columns, offsets and startup modes of a broker's topic, so a
pipeline can be developed and replayed without one.
"""

from __future__ import annotations

import json
import re
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, SimpleDataSourceStreamReader, WriterCommitMessage

MESSAGE = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp"
_SEGMENT = re.compile(r"(\d{20})-(\d+)\.parquet$")


@dataclass
class Slice(InputPartition):
    """Messages ``low`` to ``high`` (not included) of a segment."""

    partition: int
    path: str
    first: int
    low: int
    high: int


@dataclass
class Written(WriterCommitMessage):
    """What a task has staged: partition, path and messages of each file."""

    files: list[tuple[int, str, int]]


class _Topic:
    """Segments of a topic in a store."""

    def __init__(self, options: dict) -> None:
        from pyarrow.fs import FileSystem

        self.name = options["topic"]
        self.store, root = FileSystem.from_uri(options["path"])
        self.folder = f"{root.rstrip('/')}/{self.name}"

    def segments(self) -> dict[int, list[tuple[int, int, str]]]:
        """``(first, end, path)`` of each partition, in the order of offsets."""
        from pyarrow.fs import FileSelector

        found: dict[int, list[tuple[int, int, str]]] = {}
        for info in self.store.get_file_info(FileSelector(self.folder, allow_not_found=True, recursive=True)):
            part = info.path.removeprefix(f"{self.folder}/").split("/")
            if len(part) == 1 and part[0].isdigit():
                found.setdefault(int(part[0]), [])
            name = _SEGMENT.search(part[-1])
            if name and len(part) == 2 and part[0].isdigit():
                found.setdefault(int(part[0]), []).append((int(name[1]), int(name[1]) + int(name[2]), info.path))
        return {p: sorted(s) for p, s in sorted(found.items())}

    def ends(self) -> dict[str, int]:
        return {str(p): s[-1][1] if s else 0 for p, s in self.segments().items()}

    def starts(self, startup: str) -> dict[str, int]:
        """First offsets: ``earliest``, ``latest``, a time in milliseconds, or JSON of an offset for each partition."""
        segments = self.segments()
        if startup == "latest":
            return self.ends()
        if startup.startswith("{"):
            return {str(p): int(json.loads(startup).get(str(p), s[0][0] if s else 0)) for p, s in segments.items()}
        if startup.isdigit():
            return {str(p): self._at(s, int(startup)) for p, s in segments.items()}
        if startup != "earliest":
            raise ValueError(f"no such startup mode: {startup}")
        return {str(p): s[0][0] if s else 0 for p, s in segments.items()}

    def _at(self, segments: list[tuple[int, int, str]], millis: int) -> int:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        for first, _, path in segments:
            times = pq.read_table(path, columns=["timestamp"], filesystem=self.store).column("timestamp").cast("int64")
            late = pc.index(pc.greater_equal(times, millis * 1000), True).as_py()
            if late >= 0:
                return first + late
        return segments[-1][1] if segments else 0

    def slices(self, start: dict, end: dict) -> list[Slice]:
        """What lies between two offsets, a slice for each segment; offsets that were deleted are an error."""
        found = []
        for p, segments in self.segments().items():
            low, high = int(start.get(str(p), 0)), int(end.get(str(p), 0))
            if low < high and (not segments or segments[0][0] > low) and str(p) in start:
                raise ValueError(f"offset {low} of partition {p} of {self.name} is gone")
            found += [Slice(p, path, first, max(low, first), min(high, last)) for first, last, path in segments if first < high and last > low]
        return found

    def read(self, part: Slice) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.parquet as pq

        table = pq.read_table(part.path, filesystem=self.store).slice(part.low - part.first, part.high - part.low)
        n = table.num_rows
        added = {"topic": pa.array([self.name] * n, pa.string()), "partition": pa.array(np.full(n, part.partition, np.int32)), "offset": pa.array(np.arange(part.low, part.low + n))}
        columns = [table.column("key"), table.column("value"), *added.values(), table.column("timestamp")]
        yield from pa.table(columns, names=["key", "value", *added, "timestamp"]).to_batches()


class _LogReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[Slice]:
        topic = _Topic(self.options)
        return topic.slices(topic.starts(self.options.get("startup", "earliest")), topic.ends()) or [Slice(0, "", 0, 0, 0)]

    def read(self, partition: Slice) -> Iterator:
        return _Topic(self.options).read(partition) if partition.path else iter(())


class _LogStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return _Topic(self.options).starts(self.options.get("startup", "latest"))

    def latestOffset(self) -> dict:
        return _Topic(self.options).ends()

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return _Topic(self.options).slices(start, end)

    def read(self, partition: Slice) -> Iterator:
        return _Topic(self.options).read(partition)


class _LogWriter(DataSourceWriter):
    """Tasks stage files; the driver gives them offsets. One writer at a time; a failed job leaves only staged files."""

    def __init__(self, options: dict, columns: list[str]) -> None:
        self.options, self.columns = options, columns

    def write(self, iterator: Iterator) -> Written:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        topic, n = _Topic(self.options), int(self.options.get("partitions", "1"))
        rows: dict[int, list[tuple]] = {}
        now = int(time.time() * 1_000_000)
        for row in iterator:
            cells = dict(zip(self.columns, row, strict=True))
            key, value = (v.encode() if isinstance(v, str) else None if v is None else bytes(v) for v in (cells.get("key"), cells.get("value")))
            at = cells.get("timestamp")
            place = zlib.crc32(key) % n if key is not None else TaskContext.get().partitionId() % n
            rows.setdefault(place, []).append((key, value, int(at.timestamp() * 1_000_000) if at else now))
        files = []
        for place, some in sorted(rows.items()):
            columns = list(zip(*some, strict=True))
            arrays = [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int64()).cast(pa.timestamp("us", "UTC"))]
            path = f"{topic.folder}/_staged/{uuid.uuid4().hex}.parquet"
            topic.store.create_dir(f"{topic.folder}/_staged", recursive=True)
            pq.write_table(pa.table(arrays, names=["key", "value", "timestamp"]), path, filesystem=topic.store)
            files.append((place, path, len(some)))
        return Written(files)

    def commit(self, messages: list[Written], batchId: int | None = None) -> None:
        topic = _Topic(self.options)
        marker = f"{topic.folder}/_batches/{self.options.get('writer', 'stream')}-{batchId}"
        if batchId is not None and topic.store.get_file_info(marker).is_file:
            return  # this batch is in the log already
        for p in range(int(self.options.get("partitions", "1"))):
            topic.store.create_dir(f"{topic.folder}/{p}", recursive=True)
        ends = {int(p): n for p, n in topic.ends().items()}
        for place, path, count in [f for m in messages if m for f in m.files]:
            topic.store.move(path, f"{topic.folder}/{place}/{ends.get(place, 0):020d}-{count}.parquet")
            ends[place] = ends.get(place, 0) + count
        if batchId is not None:
            topic.store.create_dir(f"{topic.folder}/_batches", recursive=True)
            topic.store.open_output_stream(marker).close()

    def abort(self, messages: list[Written], batchId: int | None = None) -> None:
        topic = _Topic(self.options)
        for _, path, _ in [f for m in messages if m for f in m.files]:
            topic.store.delete_file(path)


class _LogStreamWriter(_LogWriter, DataSourceStreamWriter):
    """A batch that comes again after it was committed adds nothing; ``writer`` names the query that batches belong to."""


class MessageLog(DataSource):
    """``message_log``: options ``path``, ``topic``, ``startup``, and for writing ``partitions`` and ``writer``."""

    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return MESSAGE

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _LogStreamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _LogWriter(dict(self.options), schema.names)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _LogStreamWriter(dict(self.options), schema.names)


class _CountReader(SimpleDataSourceStreamReader):
    """Stretches of row numbers that have become due; Spark makes the rows."""

    def __init__(self, options: dict) -> None:
        self.rate, self.most, self.parts = float(options.get("rowspersecond", "10")), int(options.get("numrows", "-1")), int(options.get("partitions", "8"))
        self.resumed = False

    def initialOffset(self) -> dict:
        return {"rows": 0, "at": int(time.time() * 1000)}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = int(time.time() * 1000)
        # While the query was down nothing became due.
        at = start["at"] if self.resumed or not start["rows"] else now
        self.resumed = True
        due = start["rows"] + max(0, int((now - at) * self.rate / 1000))
        due = due if self.most < 0 else min(due, max(self.most, start["rows"]))
        end = {"rows": due, "at": at + round((due - start["rows"]) * 1000 / self.rate)} if due > start["rows"] else start
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        low, n = start["rows"], end["rows"] - start["rows"]
        bounds = [low + n * k // self.parts for k in range(self.parts + 1)]
        return iter([(a, b, end["at"]) for a, b in zip(bounds, bounds[1:], strict=False) if b > a])


class RowCounter(DataSource):
    """``row_counter``: stretches ``low, high, at`` of rows at ``rowsPerSecond``, ending after ``numRows`` if given."""

    @classmethod
    def name(cls) -> str:
        return "row_counter"

    def schema(self) -> str:
        return "low long, high long, at long"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _CountReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make the sources known to a session; doing so again changes nothing."""
    for source in (MessageLog, RowCounter):
        spark.dataSource.register(source)
