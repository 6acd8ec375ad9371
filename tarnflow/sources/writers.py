"""Sinks, and running several of them over one input."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.functions.dialect import quote
from tarnflow.operators.cdc import begin, combine, finish

#: Partition functions, the columns they make and their types.
PARTITIONS = {
    "DATE": ("dt", lambda c: F.to_date(c)),
    "YEAR": ("yr", lambda c: F.year(c).cast("long")),
    "MONTH": ("mo", lambda c: F.month(c).cast("long")),
    "DAY": ("dy", lambda c: F.day(c).cast("long")),
    "HOUR": ("hr", lambda c: F.hour(c).cast("long")),
}
#: Connectors under names that Spark does not know.
CONNECTORS = {"print": "console", "blackhole": "noop"}


def partition_columns(df: DataFrame, partition_by: list[str]) -> tuple[DataFrame, list[str]]:
    """Append the columns of entries such as ``DATE(ts)``; others name columns that exist."""
    names = []
    for number, entry in enumerate(partition_by):
        found = re.fullmatch(r"\s*(\w+)\s*\(\s*`?(\w+)`?\s*\)\s*", entry)
        if not found:
            names.append(entry)
            continue
        name, make = PARTITIONS.get(found[1].upper(), (f"_p_{found[1].lower()}{number or ''}", None))
        df = df.withColumn(name, make(F.col(quote(found[2]))) if make else F.expr(entry).cast("string"))
        names.append(name)
    return df, names


def write_files(df: DataFrame, path: str, format: str = "parquet", partition_by: list[str] | None = None, mode: str = "append", rows_per_file: int | None = None, distribution: str = "none", **options: str) -> None:
    """Partitioned files. ``rows_per_file`` rolls them; ``distribution`` (hash or range) gathers a partition's rows."""
    df, names = partition_columns(df, partition_by or [])
    if names and distribution != "none":
        df = df.repartition(*map(quote, names)) if distribution == "hash" else df.repartitionByRange(*map(quote, names))
    writer = df.write.mode(mode).format(format).options(**options)
    writer = writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer
    (writer.partitionBy(*names) if names else writer).save(path)


def write_connector(df: DataFrame, connector: str, mode: str = "append", **options: str) -> None:
    """Any connector that the session has; ``print`` and ``blackhole`` by those names."""
    kind = CONNECTORS.get(connector, connector)
    if kind == "console":
        df.show(truncate=False)
    else:
        df.write.mode("overwrite" if kind == "noop" else mode).format(kind).options(**options).save()


def message_columns(df: DataFrame, key: list[str] | None = None, format: str = "json") -> DataFrame:
    """``key`` and ``value`` as a topic takes them; keyed rows are upserts."""
    body = F.to_json(F.struct("*")) if format == "json" else F.to_csv(F.struct("*"))
    return df.select((F.to_json(F.struct(*map(quote, key))) if key else F.lit(None).cast("string")).alias("key"), body.alias("value"))


def write_topic(df: DataFrame, topic: str, servers: str, key: list[str] | None = None, format: str = "json") -> None:
    """Messages to a broker; needs the connector's jar and could not be tried here."""
    message_columns(df, key, format).write.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic}).save()


def write_jdbc(df: DataFrame, url: str, table: str, key: list[str] | None = None, staging: str | None = None, run: Callable[[str], None] | None = None, **options: str) -> None:
    """Append over JDBC, or with ``key`` upsert through a staging table.

    ``run`` executes a statement on the database; it gets the upsert after the rows are staged.
    """
    if not key:
        df.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()
        return
    stage = staging or f"{table}_{uuid.uuid4().hex[:12]}"
    df.write.format("jdbc").options(url=url, dbtable=stage, **options).mode("overwrite").save()
    if run is None:
        raise ValueError("an upsert needs a way to run statements")
    run(upsert_statement(table, stage, df.columns, key))


def upsert_statement(table: str, staging: str, columns: list[str], key: list[str]) -> str:
    """The statement that moves staged rows into a keyed table."""
    others = [c for c in columns if c not in key]
    action = "UPDATE SET " + ", ".join(f"{c} = excluded.{c}" for c in others) if others else "NOTHING"
    listed = ", ".join(columns)
    return f"INSERT INTO {table} ({listed}) SELECT {listed} FROM {staging} ON CONFLICT ({', '.join(key)}) DO {action}"


class KeyedTable:
    """A table with a primary key and a merge engine, kept as Parquet.

    It holds accumulators, not results: deletes with their sequence, the sequence of each
    column's value, counts and lists. So rows may come in any split over writes and in any
    order and give what one :func:`merge` of them all gives. Where sequences tie, the later
    write wins (``first-row`` and ``first_value``: the earlier).

    Rows lie in ``buckets`` by key, and a write makes new files for those buckets alone that
    it has rows for. A manifest names the files of each bucket and the last batch of each
    query; it appears at once, so readers see all of a write or nothing, and a batch that comes
    again changes nothing. Files that none of the last ``keep`` manifests names are deleted.
    Deletes stay in the table, as late rows may still come. One writer at a time: a second one
    that commits the same version fails.
    """

    def __init__(
        self, path: str, key: list[str], sequence: list[str], engine: str = "deduplicate", aggregates: dict[str, str] | None = None, buckets: int = 8, keep: int = 2
    ) -> None:
        self.path, self.key, self.sequence, self.engine, self.aggregates, self.buckets, self.keep = path.rstrip("/"), key, sequence, engine, aggregates, buckets, keep

    def _files(self, spark):
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self, spark) -> list[int]:
        path, system = self._files(spark)
        folder = path(f"{self.path}/_manifests")
        names = [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _manifest(self, spark, number: int) -> dict:
        return json.loads(spark.read.option("wholetext", True).text(f"{self.path}/_manifests/{number}").first()[0])

    def _commit(self, spark, number: int, manifest: dict) -> None:
        path, system = self._files(spark)
        draft = path(f"{self.path}/_drafts/{uuid.uuid4().hex}")
        stream = system.create(draft)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        system.mkdirs(path(f"{self.path}/_manifests"))
        final = path(f"{self.path}/_manifests/{number}")
        if system.exists(final) or not system.rename(draft, final):
            raise RuntimeError(f"version {number} of {self.path} was written by another writer")
        self._expire(spark)

    def _expire(self, spark) -> None:
        """Delete manifests but the last ones, and the files that only deleted ones named."""
        path, system = self._files(spark)
        numbers = self._manifests(spark)
        kept = [self._manifest(spark, n) for n in numbers[-self.keep :]]
        used = {(v, k) for m in kept for k, v in m["buckets"].items()}
        for n in numbers[: -self.keep]:
            for k, v in self._manifest(spark, n)["buckets"].items():
                if (v, k) not in used:
                    system.delete(path(f"{self.path}/{v}/__bucket={k}"), True)
                if v not in {w for w, _ in used}:
                    system.delete(path(f"{self.path}/{v}"), True)
            system.delete(path(f"{self.path}/_manifests/{n}"), False)

    def _state(self, spark, manifest: dict, buckets: set[str] | None = None) -> DataFrame | None:
        """Accumulators of some buckets or all."""
        paths = [f"{self.path}/{v}/__bucket={k}" for k, v in sorted(manifest["buckets"].items()) if buckets is None or k in buckets]
        return spark.read.schema(T.StructType.fromJson(manifest["schema"])).parquet(*paths) if paths else None

    def read(self, spark) -> DataFrame | None:
        """The rows of the last write, or None before the first."""
        numbers = self._manifests(spark)
        if not numbers:
            return None
        manifest = self._manifest(spark, numbers[-1])
        return finish(self._state(spark, manifest), self.key, self.engine, self.aggregates)

    def write(self, rows: DataFrame, batch_id: int | None = None, query: str = "") -> None:
        """Merge rows (with ``__op`` if some are deletes).

        ``batch_id`` makes repeats of a batch harmless; batches of a ``query`` are numbered in
        their order, and each query (and each stream by its checkpoint) counts for itself.
        """
        spark = rows.sparkSession
        numbers = self._manifests(spark)
        old = self._manifest(spark, numbers[-1]) if numbers else {"buckets": {}, "batches": {}}
        if batch_id is not None and batch_id <= old["batches"].get(query, -1):
            return
        number = numbers[-1] + 1 if numbers else 0
        if old.get("of", self.buckets) != self.buckets:
            raise ValueError(f"{self.path} has {old['of']} buckets")
        bucket = F.pmod(F.xxhash64(*[F.col(quote(k)) for k in self.key]), F.lit(self.buckets)).cast("int")
        fresh = combine(begin(rows, self.key, self.engine, self.sequence, self.aggregates, number), self.key, self.engine, self.aggregates).persist()
        try:
            touched = {str(r[0]) for r in fresh.select(bucket.alias("b")).distinct().collect()}
            state = self._state(spark, old, touched) if numbers else None
            merged = fresh if state is None else combine(state.unionByName(fresh), self.key, self.engine, self.aggregates)
            folder = f"v{number}-{uuid.uuid4().hex}"
            if touched:
                merged.withColumn("__bucket", bucket).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        finally:
            fresh.unpersist()
        batches = old["batches"] | ({query: batch_id} if batch_id is not None else {})
        self._commit(spark, number, {"of": self.buckets, "schema": fresh.schema.jsonValue(), "buckets": old["buckets"] | dict.fromkeys(touched, folder), "batches": batches})


def write_all(df: DataFrame, sinks: list[Callable[[DataFrame], None]]) -> None:
    """Several sinks over one input that is computed once; also the body of a streaming batch."""
    from pyspark import StorageLevel

    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for sink in sinks:
            sink(df)
    finally:
        df.unpersist()
