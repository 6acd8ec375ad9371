"""Sources: each gives a batch or streaming DataFrame with the declared columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.functions.types import Schema, parse_type, with_watermark
from tarnflow.operators.cdc import CHANGE_FORMATS, decode_changes, fold
from tarnflow.sources.streams import register

#: Connectors under names that Spark does not know.
FORMATS = {"filesystem": "parquet"}


def table_source(spark: SparkSession, name: str, streaming: bool = False) -> DataFrame:
    """A table of a catalog (``catalog.database.table``)."""
    return spark.readStream.table(name) if streaming else spark.table(name)


def file_source(spark: SparkSession, path: str, format: str = "parquet", schema: Schema | None = None, streaming: bool = False, **options: str) -> DataFrame:
    """Files; a stream needs a schema and takes new files as they come."""
    reader = (spark.readStream if streaming else spark.read).format(FORMATS.get(format, format)).options(**options)
    if schema:
        reader = reader.schema(schema.to_spark(with_metadata=False))
    df = reader.load(path)
    if schema:
        df = df.select("*", *[F.col(f"_metadata.{source}").cast(parse_type(schema.fields[n])).alias(n) for n, source in schema.metadata.items()])
        df = df.select(*schema.fields)
    return with_watermark(df, schema.watermark) if schema and streaming else df


def generic_source(spark: SparkSession, connector: str, schema: Schema | None = None, streaming: bool = False, **options: str) -> DataFrame:
    """Any connector that the session has."""
    options = dict(options)
    kind = options.pop("format", None) if connector == "filesystem" else connector
    reader = (spark.readStream if streaming else spark.read).format(kind or "parquet")
    reader = reader.schema(schema.to_spark()) if schema else reader
    return reader.options(**options).load()


def jdbc_source(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table over JDBC; ``partition`` (column, low, high, number) reads it in parallel."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition:
        column, low, high, number = partition
        reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=number)
    return reader.load()


def generated_source(spark: SparkSession, schema: Schema, rows: int | None = None, rows_per_second: int = 10, fields: dict[str, dict] | None = None, seed: int = 0, stream_rows: int | None = None) -> DataFrame:
    """Synthetic rows: ``rows`` of them in batch, else a stream at a rate, with ``stream_rows`` one that ends.

    ``fields`` gives a column ``kind`` (random or sequence), ``min``, ``max``, ``length``, ``start``,
    ``end``. Values depend on the row number and the seed only. A stream goes on after the last
    row of its checkpoint when it starts again.
    """
    if rows is not None:
        base = spark.range(rows).select(F.col("id").alias("__n"))
    else:
        register(spark)
        options = {"rowsPerSecond": rows_per_second} | ({"numRows": stream_rows} if stream_rows is not None else {})
        due = spark.readStream.format("row_counter").options(**options).load()
        base = due.select(F.explode(F.sequence("low", F.col("high") - 1)).alias("__n"), F.timestamp_millis("at").alias("timestamp"))

    def column(k: int, name: str, kind: str) -> F.Column:
        option = (fields or {}).get(name, {})
        wanted = parse_type(kind)
        if option.get("kind") == "sequence":
            start, end = option.get("start", 0), option.get("end")
            value = F.col("__n") + start
            return (F.lit(start) + F.pmod(F.col("__n"), F.lit(end - start + 1)) if end is not None else value).cast(wanted)
        unit = F.pmod(F.xxhash64("__n", F.lit(seed), F.lit(k)), F.lit(1 << 53)) / F.lit(float(1 << 53))
        name_of = wanted.typeName()
        if name_of == "string":
            return F.substring(F.sha2(F.concat_ws(":", "__n", F.lit(seed), F.lit(k)), 512), 1, option.get("length", 100))
        if name_of == "boolean":
            return unit < 0.5
        if name_of.startswith("timestamp") and "timestamp" in base.columns:
            return F.col("timestamp").cast(wanted)
        if name_of.startswith("timestamp") or name_of == "date":
            return F.timestamp_seconds(F.floor(unit * (1 << 30))).cast(wanted)
        low, high = option.get("min", 0), option.get("max", 100 if name_of == "byte" else 10_000)
        value = F.lit(low) + unit * (high - low)
        return (F.floor(F.lit(low) + unit * (high - low + 1)) if name_of in ("byte", "short", "integer", "long") else value).cast(wanted)

    df = base.select(*[column(k, n, t).alias(n) for k, (n, t) in enumerate(schema.fields.items())])
    return with_watermark(df, schema.watermark) if rows is None else df


def decode_values(df: DataFrame, schema: Schema, format: str = "json", value: str = "value") -> DataFrame:
    """Message bodies as columns: json, csv, or a change format's envelope (with ``__op`` and ``__ts``)."""
    wanted = schema.to_spark(with_metadata=False)
    if format in CHANGE_FORMATS:
        return decode_changes(df, wanted, format, value)
    text = F.col(value).cast("string")
    others = [c for c in df.columns if c in schema.metadata.values()]
    if format == "json":
        parsed = df.select(F.from_json(text, wanted).alias("__m"), *others)
    elif format == "csv":
        parsed = df.select(F.from_csv(text, wanted.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")).alias("__m"), *others)
    elif format == "avro":
        import json

        from pyspark.sql.avro.functions import from_avro

        kinds = {"string": "string", "long": "long", "integer": "int", "double": "double", "float": "float", "boolean": "boolean", "binary": "bytes"}
        described = {"type": "record", "name": "row", "fields": [{"name": f.name, "type": ["null", kinds[f.dataType.typeName()]]} for f in wanted.fields]}
        parsed = df.select(from_avro(F.col(value), json.dumps(described)).alias("__m"), *others)
    else:
        raise ValueError(f"no such format: {format}")
    return parsed.select("__m.*", *[F.col(source).alias(n) for n, source in schema.metadata.items() if source in others])


def topic_source(
    spark: SparkSession, topic: str, schema: Schema, servers: str | None = None, format: str = "json", startup: str = "earliest", group: str | None = None, replay: str | None = None, streaming: bool = True, log: str | None = None
) -> DataFrame:
    """A topic as typed rows.

    ``startup`` is ``earliest``, ``latest``, or a timestamp in milliseconds. With a key and a plain
    format the topic holds upserts; fold them with :func:`latest_by_key`. ``log`` reads a
    message log (see :mod:`tarnflow.sources.streams`) with the same offsets and startup modes, ``replay`` text
    files of messages instead of a broker. The broker connector needs its jar and could not be
    tried here.
    """
    if log:
        register(spark)
        options = {"path": log, "topic": topic, "startup": startup}
        raw = (spark.readStream if streaming else spark.read).format("message_log").options(**options).load()
    elif replay:
        raw = spark.readStream.text(replay) if streaming else spark.read.text(replay)
    else:
        options = {"kafka.bootstrap.servers": servers or "localhost:9092", "subscribe": topic}
        options |= {"startingTimestamp": startup} if startup.isdigit() else {"startingOffsets": startup}
        options |= {"kafka.group.id": group} if group else {}
        raw = (spark.readStream if streaming else spark.read).format("kafka").options(**options).load()
    df = decode_values(raw, schema, format)
    return with_watermark(df, schema.watermark) if streaming and schema.watermark and schema.watermark.column in df.columns else df


def latest_by_key(df: DataFrame, schema: Schema, order: list[str]) -> DataFrame:
    """The rows that an upsert topic or a keyed log stands for."""
    if not schema.primary_key:
        return df
    return fold(df if "__op" in df.columns else df.withColumn("__op", F.lit("insert")), list(schema.primary_key), order)


def change_source(spark: SparkSession, schema: Schema, snapshot: DataFrame | None, feed: DataFrame | None, mode: str = "initial", envelope: str = "debezium-json") -> DataFrame:
    """A database table from a snapshot and its change feed.

    ``mode``: ``initial`` (snapshot, then changes), ``never`` (changes only), ``initial_only``. The
    snapshot is any batch DataFrame, such as :func:`jdbc_source`; its rows are older than all changes.
    """
    parts = []
    if mode in ("initial", "initial_only") and snapshot is not None:
        parts.append(snapshot.select(F.lit("insert").alias("__op"), F.lit(0).cast("long").alias("__ts"), *schema.fields))
    if mode in ("initial", "never") and feed is not None:
        parts.append(decode_changes(feed, schema.to_spark(), envelope))
    if not parts:
        raise ValueError(f"nothing to read in mode {mode}")
    changes = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return fold(changes, list(schema.primary_key), ["__ts"]).drop("__ts")


def values_source(spark: SparkSession, rows: list[tuple], schema: Schema) -> DataFrame:
    """Rows given in place."""
    return spark.createDataFrame(rows, schema.to_spark())
