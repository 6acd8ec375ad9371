"""Sinks into catalog-managed tables: DDL, appends, replaced partitions, and keyed merges.

Tables are reached through Spark's catalogs, so a table format is its catalog on the
class path and what is said here of its properties. Where a catalog can merge rows, keyed
writes are ``MERGE INTO``; tables over JDBC merge inside the database, from a staging table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.functions.dialect import quote

MB = 1 << 20
#: Option, property of the table format, and the factor of its unit.
PROPERTIES = {
    "paimon": {
        "merge_engine": ("merge-engine", 1),
        "changelog_producer": ("changelog-producer", 1),
        "sequence_field": ("sequence.field", 1),
        "bucket": ("bucket", 1),
        "bucket_key": ("bucket-key", 1),
        "full_compaction_commits": ("full-compaction.delta-commits", 1),
        "write_buffer_mb": ("write-buffer-size", MB),
        "snapshots_min": ("snapshot.num-retained.min", 1),
        "snapshots_max": ("snapshot.num-retained.max", 1),
    },
    "iceberg": {
        "format_version": ("format-version", 1),
        "upsert": ("write.upsert.enabled", 1),
        "equality_columns": ("equality-field-columns", 1),
        "commit_interval_s": ("commit-interval-ms", 1000),
        "distribution": ("write.distribution-mode", 1),
        "target_file_mb": ("write.target-file-size-bytes", MB),
        "compression": ("write.parquet.compression-codec", 1),
    },
    "fluss": {"buckets": ("bucket.num", 1)},
    "jdbc": {},
    "generic": {},
}
#: Fixed values that options may take.
VALUES = {
    "merge_engine": ("deduplicate", "partial-update", "aggregation", "first-row"),
    "changelog_producer": ("none", "input", "lookup", "full-compaction"),
    "distribution": ("none", "hash", "range"),
    "compression": ("zstd", "snappy", "gzip", "none"),
    "format_version": (1, 2),
}


@dataclass(frozen=True)
class TableSpec:
    """A table of a catalog and how it is kept.

    ``kind`` names the table format; ``partition_by`` takes columns and Spark's transforms
    (``days(ts)``, ``bucket(8, id)``); ``types`` replaces the SQL types of columns; ``options`` are those of
    :data:`PROPERTIES`; ``jdbc`` (url, driver, table, user and so on) reaches the database of a keyed JDBC table.
    """

    kind: str
    catalog: str
    database: str
    table: str
    primary_key: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)
    types: dict = field(default_factory=dict)
    jdbc: dict = field(default_factory=dict)

    @property
    def name(self) -> str:
        return ".".join(map(quote, (self.catalog, self.database, self.table)))


def table_properties(spec: TableSpec) -> dict[str, str]:
    """The properties that a spec's options stand for; unset options give none.

    A bucket key is the primary key unless given, and only where buckets are set; upserts take the primary key as
    equality columns unless given. Primary keys are properties where the format has them as such.
    """
    given = {k: v for k, v in spec.options.items() if v is not None and v is not False}
    unknown = set(given) - set(PROPERTIES[spec.kind])
    if unknown:
        raise ValueError(f"{spec.kind} has no option {', '.join(sorted(unknown))}")
    if spec.primary_key and "bucket" in given:
        given.setdefault("bucket_key", spec.primary_key)
    if spec.primary_key and given.get("upsert"):
        given.setdefault("equality_columns", spec.primary_key)

    def text(value: object, factor: int) -> str:
        if isinstance(value, (list, tuple)):
            return ",".join(value)
        return "true" if value is True else str(value) if factor == 1 else str(int(value * factor))

    made = {name: text(given[option], factor) for option, (name, factor) in PROPERTIES[spec.kind].items() if option in given}
    if spec.primary_key and spec.kind in ("paimon", "fluss"):
        made["primary-key" if spec.kind == "paimon" else "primary.key"] = ",".join(spec.primary_key)
    return made


def create_statements(spec: TableSpec, schema: T.StructType) -> list[str]:
    """DDL that makes database and table where they are missing. Key columns are NOT NULL."""
    columns = []
    for f in schema.fields:
        kind = spec.types.get(f.name, f.dataType.simpleString())
        columns.append(f"{quote(f.name)} {kind}" + " NOT NULL" * (f.name in spec.primary_key))
    table = f"CREATE TABLE IF NOT EXISTS {spec.name} ({', '.join(columns)})"
    table += f" USING {spec.kind}" if spec.kind in ("paimon", "iceberg") else ""
    table += f" PARTITIONED BY ({', '.join(spec.partition_by)})" if spec.partition_by else ""
    listed = ", ".join(f"'{k}' = '{v}'" for k, v in table_properties(spec).items())
    table += f" TBLPROPERTIES ({listed})" if listed else ""
    return [f"CREATE NAMESPACE IF NOT EXISTS {quote(spec.catalog)}.{quote(spec.database)}", table]


def ensure_table(spark: SparkSession, spec: TableSpec, schema: T.StructType) -> None:
    """Run :func:`create_statements`; a table over JDBC gets its primary key as well."""
    fresh = spec.kind == "jdbc" and spec.primary_key and not spark.catalog.tableExists(spec.name)
    for statement in create_statements(spec, schema):
        spark.sql(statement)
    if fresh:
        listed = ", ".join(f'"{c}"' for c in spec.primary_key)
        run_statements(spark, spec.jdbc, [f'ALTER TABLE "{spec.database}"."{spec.table}" ADD PRIMARY KEY ({listed})'])


def problems(spec: TableSpec, changelog: str = "append-only", parallelism: int | None = None) -> list[tuple[str, str]]:
    """``(level, message)`` of what cannot work or works badly for rows that change as ``changelog`` says."""
    found = [("error", f"{k} is one of {', '.join(map(str, VALUES[k]))}") for k, v in spec.options.items() if k in VALUES and v is not None and v not in VALUES[k]]
    option = spec.options.get
    try:
        table_properties(spec)
    except ValueError as error:
        found.append(("error", str(error)))
    if spec.kind == "iceberg" and option("upsert"):
        if not (option("equality_columns") or spec.primary_key):
            found.append(("error", "upserts need equality_columns or a primary key"))
        if option("format_version", 2) < 2:
            found.append(("error", "upserts need format_version 2"))
    if spec.kind == "iceberg" and option("distribution") == "none" and (parallelism or 1) > 1:
        found.append(("warning", "distribution none with several writers makes many small files"))
    if spec.kind == "paimon" and option("merge_engine") and not spec.primary_key:
        found.append(("error", "merge_engine needs a primary key"))
    if option("bucket_key") and not option("bucket"):
        found.append(("error", "bucket_key needs bucket"))
    keyed = bool(option("upsert")) if spec.kind == "iceberg" else bool(spec.primary_key)
    if changelog != "append-only" and not keyed:
        found.append(("error", f"the input is {changelog}, and the table has no key to take rows back by"))
    if spec.kind == "iceberg" and keyed and changelog == "append-only":
        found.append(("warning", "upserts of rows that never change cost a lookup for nothing"))
    return found


def write_table(df: DataFrame, spec: TableSpec, mode: str = "append", sequence: list[str] | None = None) -> None:
    """Write rows into the table, which is made if it is missing.

    ``append`` adds rows; ``overwrite_partitions`` replaces the partitions that rows fall in; ``overwrite`` replaces
    all rows; ``upsert`` merges by the primary key: of rows with one key the last by ``sequence`` counts, and
    ``__op`` = ``delete`` takes a key away.
    """
    if mode == "upsert":
        merge_rows(df, spec, sequence)
        return
    ensure_table(df.sparkSession, spec, df.schema)
    writer = df.writeTo(spec.name)
    {"append": writer.append, "overwrite_partitions": writer.overwritePartitions, "overwrite": lambda: writer.overwrite(F.lit(True))}[mode]()


def merge_rows(df: DataFrame, spec: TableSpec, sequence: list[str] | None = None) -> None:
    """Upsert and delete by key. Rows of one key are folded first, so each key is touched once."""
    if not spec.primary_key:
        raise ValueError("a merge needs a primary key")
    changes = df if "__op" in df.columns else df.withColumn("__op", F.lit("insert"))
    columns = [c for c in df.columns if c != "__op"]
    ensure_table(df.sparkSession, spec, df.select(*map(quote, columns)).schema)
    last = last_changes(changes, list(spec.primary_key), sequence)
    if spec.kind == "jdbc":
        merge_jdbc(last, spec)
        return
    source = f"changes_{uuid.uuid4().hex}"
    last.createOrReplaceTempView(source)
    try:
        df.sparkSession.sql(merge_into(spec, columns, source))
    finally:
        df.sparkSession.catalog.dropTempView(source)


def merge_into(spec: TableSpec, columns: list[str], source: str) -> str:
    """The ``MERGE INTO`` of changes (columns and ``__op``) in ``source``."""
    same = " AND ".join(f"t.{quote(k)} = s.{quote(k)}" for k in spec.primary_key)
    others = ", ".join(f"t.{quote(c)} = s.{quote(c)}" for c in columns if c not in spec.primary_key)
    update = f"WHEN MATCHED THEN UPDATE SET {others} " if others else ""
    values = ", ".join(f"s.{quote(c)}" for c in columns)
    return (
        f"MERGE INTO {spec.name} t USING {source} s ON {same} WHEN MATCHED AND s.__op = 'delete' THEN DELETE {update}"
        f"WHEN NOT MATCHED AND s.__op <> 'delete' THEN INSERT ({', '.join(map(quote, columns))}) VALUES ({values})"
    )


def last_changes(changes: DataFrame, key: list[str], sequence: list[str] | None) -> DataFrame:
    """One row a key: the last by ``sequence``. Without sequence keys have to be unique."""
    if not sequence:
        return changes
    order = F.struct(*[F.col(quote(c)) for c in sequence])
    best = changes.groupBy(*map(quote, key)).agg(F.max_by(F.struct(*[F.col(quote(c)) for c in changes.columns]), order).alias("__last"))
    return best.select("__last.*")


def run_statements(spark: SparkSession, jdbc: dict, statements: list[str]) -> list[int]:
    """Run statements in one transaction of a database; counts of changed rows."""
    jvm = spark.sparkContext._jvm
    if "driver" in jdbc:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(jdbc["driver"])
    properties = jvm.java.util.Properties()
    for name in ("user", "password"):
        if name in jdbc:
            properties.setProperty(name, jdbc[name])
    connection = jvm.java.sql.DriverManager.getConnection(jdbc["url"], properties)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        counts = [statement.executeUpdate(s) for s in statements]
        connection.commit()
        return counts
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def merge_statements(table: str, staging: str, columns: list[str], key: list[str], url: str, types: dict[str, str] | None = None) -> list[str]:
    """Statements that move staged rows (with ``__op``) into a keyed table, in the database's own words; ``types`` are cast to."""
    cell = {c: f'CAST(s."{c}" AS {types[c]})' if types and c in types and c not in key else f's."{c}"' for c in columns}
    listed, others = ", ".join(f'"{c}"' for c in columns), [c for c in columns if c not in key]
    same = " AND ".join(f't."{k}" = s."{k}"' for k in key)
    delete = f"DELETE FROM {table} t WHERE EXISTS (SELECT 1 FROM {staging} s WHERE {same} AND s.\"__op\" = 'delete')"
    if url.startswith(("jdbc:postgresql", "jdbc:sqlite")):
        action = "UPDATE SET " + ", ".join(f'"{c}" = excluded."{c}"' for c in others) if others else "NOTHING"
        inserted = f"INSERT INTO {table} ({listed}) SELECT {', '.join(cell.values())} FROM {staging} s WHERE s.\"__op\" <> 'delete' ON CONFLICT ({', '.join(chr(34) + k + chr(34) for k in key)}) DO {action}"
        return [delete, inserted]
    merge = f"MERGE INTO {table} t USING {staging} s ON {same} WHEN MATCHED AND s.\"__op\" = 'delete' THEN DELETE"
    if others:
        merge += " WHEN MATCHED AND s.\"__op\" <> 'delete' THEN UPDATE SET " + ", ".join(f'"{c}" = {cell[c]}' for c in others)
    return [f"{merge} WHEN NOT MATCHED AND s.\"__op\" <> 'delete' THEN INSERT ({listed}) VALUES ({', '.join(cell.values())})"]


def merge_jdbc(last: DataFrame, spec: TableSpec) -> None:
    """Stage rows in a table of their own, merge them in one transaction, and drop the staging table."""
    spark, jdbc = last.sparkSession, spec.jdbc
    staging = f"stage_{uuid.uuid4().hex[:16]}"
    connection = {k: v for k, v in jdbc.items() if k != "table"}
    # Other columns are staged as Spark writes them, which takes nulls in any database, and cast when they are merged.
    kinds = [f"{quote(c)} {t}" for c, t in (spec.types | {"__op": "VARCHAR(16)"}).items() if c in spec.primary_key or c == "__op"]
    writer = last.write.format("jdbc").options(**connection, dbtable=f'"{spec.database}"."{staging}"', createTableColumnTypes=", ".join(kinds))
    try:
        writer.mode("append").save()
        columns = [c for c in last.columns if c != "__op"]
        run_statements(spark, jdbc, merge_statements(f'"{spec.database}"."{spec.table}"', f'"{spec.database}"."{staging}"', columns, list(spec.primary_key), jdbc["url"], spec.types))
    finally:
        run_statements(spark, jdbc, [f'DROP TABLE "{spec.database}"."{staging}"'])


def stream_table(df: DataFrame, spec: TableSpec, checkpoint: str, mode: str = "append", sequence: list[str] | None = None, trigger: dict | None = None):
    """Start a query into the table; batches of ``upsert`` merge by key, so a batch that comes again changes nothing."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    if mode == "append" and spec.kind != "jdbc":
        ensure_table(df.sparkSession, spec, df.schema)
        return writer.toTable(spec.name)
    return writer.outputMode("update" if mode == "upsert" else "append").foreachBatch(lambda rows, _: write_table(rows, spec, mode, sequence)).start()


def table_sink(spec: TableSpec, mode: str = "append", sequence: list[str] | None = None, checkpoint: str | None = None) -> Callable[[DataFrame], object]:
    """A sink of a pipeline, for batch and streaming results."""

    def write(df: DataFrame) -> object:
        if df.isStreaming:
            if not checkpoint:
                raise ValueError("a stream into a table needs a checkpoint folder")
            return stream_table(df, spec, checkpoint, mode, sequence)
        return write_table(df, spec, mode, sequence)

    return write
