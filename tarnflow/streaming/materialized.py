"""Materialized aggregates: a stored result that is brought up to date from new files, or computed anew and swapped in."""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.functions.dialect import quote, rewrite
from tarnflow.functions.types import to_milliseconds
from tarnflow.sources.writers import KeyedTable

_AGGREGATE = re.compile(r"\s*(SUM|COUNT|MIN|MAX|AVG)\s*\((.*)\)\s*$", re.I | re.S)


@dataclass
class MaterializedTable:
    """An aggregate over a folder of Parquet files, kept under ``path``.

    ``select`` maps columns to aggregates by ``group_by``. In mode ``full`` a refresh computes all and makes the
    new version visible at once; in mode ``continuous`` it reads the files that are new since the last one, and
    merges their partial aggregates by group, each file once whatever fails in between. That
    takes SUM, COUNT, MIN, MAX and AVG; ``automatic`` is continuous where it can be. ``freshness`` is how old the table may get
    before :meth:`refresh_if_due` refreshes it.
    """

    path: str
    source: str
    schema: T.StructType
    group_by: list[str]
    select: dict[str, str]
    where: str | None = None
    mode: str = "automatic"
    freshness: str | int | None = None
    keep: int = 2

    def __post_init__(self) -> None:
        mergeable = all(self._parts(e) for e in self.select.values())
        if self.mode not in ("full", "continuous", "automatic"):
            raise ValueError(f"no such refresh mode: {self.mode}")
        if self.mode == "continuous" and not mergeable:
            raise ValueError("continuous refresh takes SUM, COUNT, MIN, MAX and AVG")
        self.continuous = self.mode == "continuous" or (self.mode == "automatic" and mergeable)
        self.path = self.path.rstrip("/")
        partials = {f"{alias}__{k}": kind for alias, e in self.select.items() for k, (_, kind) in enumerate(self._parts(e))}
        self.table = KeyedTable(f"{self.path}/groups", self.group_by, [], "aggregation", partials, keep=self.keep)

    @staticmethod
    def _parts(expression: str) -> list[tuple[str, str]]:
        """Partial aggregates of an expression and how they merge; none if it cannot be merged."""
        found = _AGGREGATE.fullmatch(expression)
        if not found or re.match(r"\s*DISTINCT\b", found[2], re.I) or found[2].count("(") != found[2].count(")"):
            return []
        depth = 0
        for sign in found[2]:
            depth += (sign == "(") - (sign == ")")
            if depth < 0:
                return []  # more than one call, such as SUM(a) + SUM(b)
        kind = found[1].upper()
        if kind == "AVG":
            return [(f"SUM({found[2]})", "sum"), (f"COUNT({found[2]})", "sum")]
        return [(expression, {"SUM": "sum", "COUNT": "sum", "MIN": "min", "MAX": "max"}[kind])]

    def _filtered(self, df: DataFrame) -> DataFrame:
        return df.where(rewrite(self.where)) if self.where else df

    def _aggregate(self, df: DataFrame, columns: dict[str, str]) -> DataFrame:
        made = [F.expr(rewrite(e)).alias(a) for a, e in columns.items()]
        return self._filtered(df).groupBy(*map(quote, self.group_by)).agg(*made)

    def query(self, spark: SparkSession) -> DataFrame:
        """The result as it is now, computed from all files."""
        return self._aggregate(spark.read.schema(self.schema).parquet(self.source), self.select)

    def refresh(self, spark: SparkSession) -> None:
        """Bring the table up to date."""
        if self.continuous:
            partials = {f"{alias}__{k}": e for alias, whole in self.select.items() for k, (e, _) in enumerate(self._parts(whole))}

            def merge(rows: DataFrame, number: int) -> None:
                self.table.write(self._aggregate(rows, partials), number, "files")

            stream = spark.readStream.schema(self.schema).parquet(self.source)
            stream.writeStream.option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()
            self._tell(spark, {})
            return
        version = f"v{uuid.uuid4().hex}"
        self.query(spark).write.parquet(f"{self.path}/{version}")
        before = self._told(spark).get("versions", [])
        self._tell(spark, {"versions": [*before, version][-self.keep :]})
        for old in before[: max(0, len(before) + 1 - self.keep)]:
            path, store = self._store(spark)
            store.delete(path(f"{self.path}/{old}"), True)

    def read(self, spark: SparkSession) -> DataFrame:
        """The table as of the last refresh; readers of an earlier version keep it for one refresh more."""
        if not self.continuous:
            versions = self._told(spark).get("versions")
            if not versions:
                raise ValueError(f"{self.path} was never refreshed")
            return spark.read.parquet(f"{self.path}/{versions[-1]}")
        held = self.table.read(spark)
        if held is None:
            return self.query(spark).limit(0)
        kinds = {f.name: f.dataType for f in self.query(spark).schema.fields}
        made = []
        for alias, e in self.select.items():
            parts = [F.col(quote(f"{alias}__{k}")) for k in range(len(self._parts(e)))]
            value = parts[0] if len(parts) == 1 else F.when(parts[1] > 0, parts[0] / parts[1])
            made.append(value.cast(kinds[alias]).alias(alias))
        return held.select(*map(quote, self.group_by), *made)

    def is_due(self, spark: SparkSession) -> bool:
        """Whether the last refresh is longer ago than the table may be old."""
        at = self._told(spark).get("at")
        return at is None or (self.freshness is not None and time.time() * 1000 - at >= to_milliseconds(self.freshness))

    def refresh_if_due(self, spark: SparkSession) -> bool:
        due = self.is_due(spark)
        if due:
            self.refresh(spark)
        return due

    def _store(self, spark: SparkSession):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _told(self, spark: SparkSession) -> dict:
        path, store = self._store(spark)
        folder = path(f"{self.path}/_refreshes")
        names = sorted(s.getPath().getName() for s in store.listStatus(folder)) if store.exists(folder) else []
        return json.loads(spark.read.option("wholetext", True).text(f"{self.path}/_refreshes/{names[-1]}").first()[0]) if names else {}

    def _tell(self, spark: SparkSession, what: dict) -> None:
        """State of the table, under a name of its own that appears at once."""
        path, store = self._store(spark)
        at = int(time.time() * 1000)
        draft, final = path(f"{self.path}/_drafts/{uuid.uuid4().hex}"), path(f"{self.path}/_refreshes/{at:020d}.json")
        stream = store.create(draft)
        stream.write(bytearray(json.dumps(what | {"at": at}).encode()))
        stream.close()
        store.mkdirs(final.getParent())
        if not store.rename(draft, final):
            raise RuntimeError(f"{self.path} was refreshed by another writer")
        names = sorted(s.getPath().getName() for s in store.listStatus(final.getParent()))
        for name in names[: -self.keep]:
            store.delete(path(f"{self.path}/_refreshes/{name}"), False)
