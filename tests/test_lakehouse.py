"""Catalog-managed tables: DDL and properties of each format, and whole runs on the JDBC catalog over Derby."""

import uuid

import pytest
from pyspark.errors import UnsupportedOperationException

from tarnflow.plans.pipeline import Changelog, Pipeline
from tarnflow.sources.lakehouse import TableSpec, create_statements, merge_into, merge_statements, problems, run_statements, stream_table, table_properties, table_sink, write_table


@pytest.fixture(scope="module")
def derby(spark):
    name = f"derby{uuid.uuid4().hex[:8]}"
    jdbc = {"url": f"jdbc:derby:memory:{name};create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    base = f"spark.sql.catalog.{name}"
    spark.conf.set(base, "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
    for key, value in jdbc.items():
        spark.conf.set(f"{base}.{key}", value)
    return name, jdbc


def spec_of(derby, table, **more):
    return TableSpec("jdbc", derby[0], "shop", table, types={"id": "BIGINT", "name": "VARCHAR(40)"}, jdbc=derby[1], **more)


def rows_of(spark, spec):
    return sorted(map(tuple, spark.table(spec.name).collect()), key=repr)


def test_append_and_overwrite(spark, derby):
    spec = TableSpec("generic", derby[0], "shop", "plain")
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    write_table(df, spec)
    write_table(df.where("id = 1"), spec)
    assert rows_of(spark, spec) == [(1, "a"), (1, "a"), (2, None)]
    write_table(df.where("id = 2"), spec, "overwrite")
    assert rows_of(spark, spec) == [(2, None)]
    assert "id = 2" in spark.table(spec.name).where("id = 2")._jdf.queryExecution().toString()


def test_upserts_deletes_and_repeats(spark, derby):
    spec = spec_of(derby, "keyed", primary_key=("id",))
    first = spark.createDataFrame([(1, "a", "insert", 1), (2, "b", "insert", 1), (1, "c", "update", 2), (3, "d", "insert", 1)], "id long, name string, __op string, at int")
    flat = first.drop("at")
    write_table(flat.where("name <> 'a'"), spec, "upsert")
    assert rows_of(spark, spec) == [(1, "c"), (2, "b"), (3, "d")]
    second = spark.createDataFrame([(1, None, "delete"), (2, "B", "insert"), (9, None, "delete"), (4, "e", "insert")], "id long, name string, __op string")
    for _ in range(2):  # a batch that comes again changes nothing
        write_table(second, spec, "upsert")
        assert rows_of(spark, spec) == [(2, "B"), (3, "d"), (4, "e")]
    with pytest.raises(Exception, match="duplicate"):
        run_statements(spark, derby[1], ['INSERT INTO "shop"."keyed" VALUES (2, \'x\')'])
    assert not spark.sql(f"SHOW TABLES IN `{derby[0]}`.`shop`").where("tableName LIKE 'stage%'").collect()


def test_last_change_of_a_key_counts(spark, derby):
    spec = spec_of(derby, "ordered", primary_key=("id",))
    rows = [(k % 3, f"n{k}", "delete" if k == 8 else "insert", k) for k in range(9)]
    df = spark.createDataFrame(rows, "id long, name string, __op string, at int").repartition(4)
    write_table(df, spec, "upsert", ["at"])
    assert [r[:2] for r in rows_of(spark, spec)] == [(0, "n6"), (1, "n7")]


def test_failed_merge_leaves_the_table(spark, derby):
    spec = spec_of(derby, "safe", primary_key=("id",))
    write_table(spark.createDataFrame([(1, "a")], "id long, name string"), spec, "upsert")
    twice = spark.createDataFrame([(1, "x"), (5, "y"), (5, "z")], "id long, name string")  # without sequence, keys must be unique
    with pytest.raises(Exception):  # noqa: B017
        write_table(twice, spec, "upsert")
    assert rows_of(spark, spec) == [(1, "a")]
    assert not spark.sql(f"SHOW TABLES IN `{derby[0]}`.`shop`").where("tableName LIKE 'stage%'").collect()


def test_stream_of_upserts(spark, derby, tmp_path):
    spec = spec_of(derby, "streamed", primary_key=("id",))
    source = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame([(1, f"v{k}", k), (10 + k, "x", k)], "id long, name string, at int").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id long, name string, at int").option("maxFilesPerTrigger", 1).parquet(source)
    stream_table(stream, spec, str(tmp_path / "cp"), "upsert", ["at"]).awaitTermination()
    assert [r[0] for r in rows_of(spark, spec)] == [1, 10, 11, 12]
    stream_table(stream, spec, str(tmp_path / "cp"), "upsert", ["at"]).awaitTermination()
    assert len(rows_of(spark, spec)) == 4


def test_pipeline_into_a_table(spark, derby):
    spec = spec_of(derby, "piped", primary_key=("id",))
    flow = Pipeline("p", mode="batch")
    flow.source(spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string"), name="rows").filter(condition="id > 1").into(spec, "upsert")
    assert not [f for f in flow.check() if f.level == "error"]
    flow.run(spark)
    assert rows_of(spark, spec) == [(2, "b")]
    bad = Pipeline("q", mode="streaming", parallelism=4)
    changing = bad.source(spark.range(1), name="s", changelog=Changelog("retract"))
    changing.into(TableSpec("iceberg", "c", "d", "t", options={"upsert": True, "distribution": "none"}))
    levels = {(f.level, f.message.split(" ")[0]) for f in bad.check(columns=False)}
    assert ("error", "upserts") in levels and ("warning", "distribution") in levels
    with pytest.raises(ValueError, match="checkpoint"):
        table_sink(spec)(spark.readStream.format("rate").load())


def test_ddl(spark):
    schema = spark.createDataFrame([], "id long, ts timestamp, v decimal(10,2)").schema
    paimon = TableSpec("paimon", "lake", "db", "t", ("id",), ("days(ts)",), {"merge_engine": "partial-update", "bucket": 8, "write_buffer_mb": 256, "snapshots_min": 3})
    assert create_statements(paimon, schema) == [
        "CREATE NAMESPACE IF NOT EXISTS `lake`.`db`",
        "CREATE TABLE IF NOT EXISTS `lake`.`db`.`t` (`id` bigint NOT NULL, `ts` timestamp, `v` decimal(10,2)) USING paimon PARTITIONED BY (days(ts)) TBLPROPERTIES ("
        "'merge-engine' = 'partial-update', 'bucket' = '8', 'bucket-key' = 'id', 'write-buffer-size' = '268435456', 'snapshot.num-retained.min' = '3', 'primary-key' = 'id')",
    ]
    for spec in (paimon, TableSpec("generic", "x", "y", "z", partition_by=("bucket(4, id)", "ts"))):
        for statement in create_statements(spec, schema):  # Spark reads it
            spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)


def test_properties():
    iceberg = TableSpec("iceberg", "c", "d", "t", ("a", "b"), options={"upsert": True, "format_version": 2, "commit_interval_s": 10, "target_file_mb": 256, "compression": "zstd", "distribution": None})
    assert table_properties(iceberg) == {
        "format-version": "2", "write.upsert.enabled": "true", "equality-field-columns": "a,b", "commit-interval-ms": "10000", "write.target-file-size-bytes": "268435456", "write.parquet.compression-codec": "zstd"
    }
    assert table_properties(TableSpec("iceberg", "c", "d", "t", ("a",))) == {}
    assert table_properties(TableSpec("fluss", "c", "d", "t", ("a",), options={"buckets": 4})) == {"bucket.num": "4", "primary.key": "a"}
    with pytest.raises(ValueError, match="no option"):
        table_properties(TableSpec("fluss", "c", "d", "t", options={"bucket": 4}))


def test_problems():
    def levels(kind, key=(), changelog="append-only", parallelism=None, **options):
        return [level for level, _ in problems(TableSpec(kind, "c", "d", "t", key, options=options), changelog, parallelism)]

    assert levels("paimon", merge_engine="deduplicate") == ["error"]
    assert levels("paimon", ("k",), merge_engine="no such") == ["error"]
    assert levels("paimon", bucket_key="k") == ["error"]
    assert levels("iceberg", upsert=True) == ["error", "warning"] and levels("iceberg", ("k",), "retract", upsert=True, format_version=1) == ["error"]
    assert levels("fluss", (), "retract") == ["error"] and levels("fluss", ("k",), "retract") == []


def test_merge_texts(spark, derby):
    spec = spec_of(derby, "merged", primary_key=("id", "name"))
    write_table(spark.createDataFrame([(1, "a")], "id long, name string"), spec)
    spark.createDataFrame([(1, "a", "insert")], "id long, name string, __op string").createOrReplaceTempView("changes_of_merge")
    text = merge_into(spec, ["id", "name"], "changes_of_merge")
    assert "UPDATE" not in text and "THEN DELETE WHEN NOT MATCHED" in text
    with pytest.raises(UnsupportedOperationException, match="MERGE INTO TABLE"):  # it is read, and the table's source cannot do it
        spark.sql(text)
    delete, insert = merge_statements("t", "s", ["id", "v"], ["id"], "jdbc:postgresql://h/db")
    assert delete.startswith("DELETE FROM t t WHERE EXISTS") and insert.endswith('ON CONFLICT ("id") DO UPDATE SET "v" = excluded."v"')
