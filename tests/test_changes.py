import json

import pytest
from pyspark.sql import types as T

from tarnflow.functions.types import Schema
from tarnflow.operators import cdc
from tarnflow.sources import readers, writers
from tarnflow.sources.catalogs import catalog_options

ROW = T.StructType().add("id", "long").add("v", "string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def messages(spark, items):
    return spark.createDataFrame([(json.dumps(i) if not isinstance(i, (str, type(None))) else i,) for i in items], "value string")


def test_debezium(spark):
    feed = messages(spark, [
        {"op": "c", "ts_ms": 1, "before": None, "after": {"id": 1, "v": "a"}},
        {"payload": {"op": "u", "ts_ms": 3, "before": {"id": 1, "v": "a"}, "after": {"id": 1, "v": "b"}}},
        {"op": "r", "ts_ms": 1, "after": {"id": 2, "v": "x"}},
        {"op": "d", "ts_ms": 5, "before": {"id": 2, "v": "x"}, "after": None},
        None, "not json",
    ])
    changes = cdc.decode_changes(feed, ROW, "debezium-json")
    assert rows(changes) == [("delete", 5, 2, "x"), ("insert", 1, 1, "a"), ("insert", 1, 2, "x"), ("update", 3, 1, "b")]
    assert rows(cdc.fold(changes, ["id"], ["__ts"]).drop("__ts")) == [(1, "b")]


def test_canal_and_maxwell(spark):
    canal = messages(spark, [{"type": "INSERT", "ts": 1, "data": [{"id": 1, "v": "a"}, {"id": 2, "v": "b"}]}, {"type": "DELETE", "ts": 2, "data": [{"id": 1, "v": "a"}]}, {"type": "ALTER", "ts": 3, "data": None}])
    assert rows(cdc.fold(cdc.decode_changes(canal, ROW, "canal-json"), ["id"], ["__ts"]).drop("__ts")) == [(2, "b")]
    maxwell = messages(spark, [{"type": "bootstrap-insert", "ts": 1, "data": {"id": 1, "v": "a"}}, {"type": "update", "ts": 2, "data": {"id": 1, "v": "c"}}])
    assert rows(cdc.fold(cdc.decode_changes(maxwell, ROW, "maxwell-json"), ["id"], ["__ts"])) == [(2000, 1, "c")]
    with pytest.raises(ValueError):
        cdc.decode_changes(maxwell, ROW, "other")


@pytest.mark.parametrize(
    "engine, wanted",
    [("deduplicate", (1, 3, None, "c")), ("first-row", (1, 1, 10, None)), ("partial-update", (1, 3, 20, "c")), ("aggregation", (1, 3, 30, "b,c"))],
)
def test_merge_engines(spark, engine, wanted):
    df = spark.createDataFrame([(1, 2, 20, "b"), (1, 1, 10, None), (1, 3, None, "c")], "id int, seq int, n int, v string")
    assert rows(cdc.merge(df, ["id"], engine, ["seq"], {"seq": "max", "n": "sum", "v": "listagg"})) == [wanted]


def test_keyed_table(spark, tmp_path):
    table = writers.KeyedTable(str(tmp_path / "t"), ["id"], ["seq"])
    table.write(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id int, seq int, v string"), 0)
    late = spark.createDataFrame([(1, 2, "c", "update"), (2, 2, "b", "delete")], "id int, seq int, v string, __op string")
    table.write(late, 1)
    table.write(late, 1)  # a batch that comes again changes nothing
    assert rows(table.read(spark)) == [(1, 2, "c")]
    sums = writers.KeyedTable(str(tmp_path / "s"), ["id"], ["seq"], "aggregation", {"n": "sum", "seq": "max"}, buckets=2)
    for k in range(3):
        sums.write(spark.createDataFrame([(1, k, 5)], "id int, seq int, n int"))
    assert rows(sums.read(spark).select("id", "n")) == [(1, 15)]


ENGINES = {"seq": "max", "n": "sum", "m": "count", "f": "first_value", "l": "last_value", "v": "listagg"}


@pytest.mark.parametrize("engine", ["deduplicate", "first-row", "partial-update", "aggregation"])
def test_keyed_table_in_steps_is_as_at_once(spark, tmp_path, engine):
    """Any split and order of writes gives what one merge of all rows gives."""
    import random

    random.seed(5)
    data = [(k, s, s if s % 3 else None, s if s % 2 else None, s, s, None if s % 4 == 1 else f"x{s}") for k in range(6) for s in range(9)]
    random.shuffle(data)
    columns = "id int, seq int, n int, m int, f int, l int, v string"
    table = writers.KeyedTable(str(tmp_path / "t"), ["id"], ["seq"], engine, ENGINES, buckets=3)
    for k in range(0, len(data), 11):
        table.write(spark.createDataFrame(data[k : k + 11], columns))
    wanted = cdc.merge(spark.createDataFrame(data, columns), ["id"], engine, ["seq"], ENGINES)
    assert rows(table.read(spark).select(*wanted.columns)) == rows(wanted)


def test_keyed_table_keeps_deletes_and_batches(spark, tmp_path):
    table = writers.KeyedTable(str(tmp_path / "t"), ["id"], ["seq"])

    def change(seq, v, op):
        return spark.createDataFrame([(1, seq, v, op)], "id int, seq int, v string, __op string")

    table.write(change(1, "a", "insert"))
    table.write(change(2, "b", "update"), 0, "one")  # the first batch of a stream after a plain write counts
    table.write(change(9, "no", "update"), 0, "one")  # but not again
    assert rows(table.read(spark)) == [(1, 2, "b")]
    table.write(change(5, "b", "delete"), 0, "two")
    table.write(change(3, "late", "update"), 1, "one")
    assert rows(table.read(spark)) == []
    table.write(change(6, "back", "insert"), 1, "two")
    assert rows(table.read(spark)) == [(1, 6, "back")]
    table.write(change(6, "tie", "update"), 2, "two")
    assert rows(table.read(spark)) == [(1, 6, "tie")]
    table.write(change(7, "x", "update").limit(0), 3, "two")
    assert rows(table.read(spark)) == [(1, 6, "tie")]
    with pytest.raises(ValueError):
        writers.KeyedTable(str(tmp_path / "t"), ["id"], ["seq"], buckets=5).write(change(8, "y", "update"))
    sums = writers.KeyedTable(str(tmp_path / "s"), ["id"], ["seq"], "aggregation")
    with pytest.raises(Exception, match="takes no deletes"):
        sums.write(change(1, "a", "delete"))


def test_keyed_table_rewrites_touched_buckets_and_expires_versions(spark, tmp_path):
    table = writers.KeyedTable(str(tmp_path / "t"), ["id"], ["seq"], buckets=4)
    table.write(spark.range(100).selectExpr("id", "0 AS seq", "'a' AS v"))
    for k in range(1, 6):
        table.write(spark.createDataFrame([(7, k, "b")], "id long, seq int, v string"))
    first = next(d for d in (tmp_path / "t").iterdir() if d.name.startswith("v0-"))
    assert len([d for d in first.iterdir() if d.name.startswith("__bucket")]) == 3  # the other three are still those of the first write
    assert len([d for d in (tmp_path / "t").iterdir() if d.name.startswith("v")]) == 3
    assert table.read(spark).where("seq = 5").count() == 1 and table.read(spark).count() == 100


def test_files_with_partition_functions(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    writers.write_files(events, str(tmp_path / "out"), partition_by=["DATE(ts)", "HOUR(ts)", "event_type"], distribution="hash", rows_per_file=50)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == events.count() and {"dt", "hr", "event_type"} <= set(back.columns)
    df, names = writers.partition_columns(events, ["YEAR(ts)", "MONTH(ts)", "DAY(ts)", "upper(event_type)"])
    assert names[:3] == ["yr", "mo", "dy"] and dict(df.dtypes)["yr"] == "bigint" and dict(df.dtypes)[names[3]] == "string"


def test_other_sinks(spark):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    writers.write_connector(df, "blackhole")
    assert rows(writers.message_columns(df, ["id"])) == [('{"id":1}', '{"id":1,"v":"a"}')]
    assert writers.upsert_statement("t", "s", ["id", "v"], ["id"]) == "INSERT INTO t (id, v) SELECT id, v FROM s ON CONFLICT (id) DO UPDATE SET v = excluded.v"
    seen = []
    writers.write_all(df, [lambda d: seen.append(d.count()), lambda d: seen.append(d.columns)])
    assert seen == [1, ["id", "v"]]


def test_sources(spark, tmp_path):
    schema = Schema({"id": "BIGINT", "v": "STRING", "ok": "BOOLEAN", "x": "DOUBLE", "at": "TIMESTAMP(3)"})
    made = readers.generated_source(spark, schema, rows=100, fields={"id": {"kind": "sequence", "start": 5}, "x": {"min": 1, "max": 2}, "v": {"length": 4}})
    assert made.schema.names == list(schema.fields) and rows(made) == rows(readers.generated_source(spark, schema, rows=100, fields={"id": {"kind": "sequence", "start": 5}, "x": {"min": 1, "max": 2}, "v": {"length": 4}}))
    assert made.selectExpr("min(id)", "max(id)", "min(x) >= 1", "max(length(v))").first() == (5, 104, True, 4)
    small = Schema({"id": "BIGINT", "v": "STRING"}, primary_key=("id",))
    values = readers.values_source(spark, [(1, "a"), (2, "b")], small)
    text = messages(spark, [{"id": 1, "v": "a"}])
    assert rows(readers.decode_values(text, small)) == [(1, "a")]
    assert rows(readers.decode_values(spark.createDataFrame([("3,c",)], "value string"), small, "csv")) == [(3, "c")]
    path = str(tmp_path / "m")
    text.write.text(path)
    assert rows(readers.topic_source(spark, "t", small, replay=path, streaming=False)) == [(1, "a")]
    values.write.csv(str(tmp_path / "c"))
    assert rows(readers.file_source(spark, str(tmp_path / "c"), "csv", small)) == [(1, "a"), (2, "b")]
    feed = messages(spark, [{"op": "u", "ts_ms": 1, "before": None, "after": {"id": 1, "v": "z"}}])
    assert rows(readers.change_source(spark, small, values, feed)) == [(1, "z"), (2, "b")]
    assert rows(readers.change_source(spark, small, values, feed, "initial_only")) == [(1, "a"), (2, "b")]
    assert rows(readers.change_source(spark, small, values, feed, "never")) == [(1, "z")]


def test_catalog_options():
    assert catalog_options("iceberg", "c", catalog_type="rest", uri="u")["spark.sql.catalog.c.type"] == "rest"
    assert catalog_options("generic", "c", implementation="x.Y", a=1) == {"spark.sql.catalog.c": "x.Y", "spark.sql.catalog.c.a": "1"}
    with pytest.raises(ValueError):
        catalog_options("other", "c")
