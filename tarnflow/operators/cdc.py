"""Change feeds: decoding of envelopes, folding to current rows, merge engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.functions.dialect import quote

#: Formats that carry changes.
CHANGE_FORMATS = ("debezium-json", "debezium-avro", "debezium-protobuf", "canal-json", "maxwell-json")


def decode_changes(df: DataFrame, schema: T.StructType, envelope: str, value: str = "value") -> DataFrame:
    """``__op`` (insert, update, delete), ``__ts`` (milliseconds) and the row's columns from JSON envelopes.

    Deletes carry the row as it was. Messages that are null or cannot be read go.
    """
    text = F.col(quote(value)).cast("string")
    row = schema.simpleString()
    if envelope == "debezium-json":
        read = F.from_json(text, f"struct<op:string,ts_ms:bigint,before:{row},after:{row},payload:struct<op:string,ts_ms:bigint,before:{row},after:{row}>>")
        body = F.coalesce(F.col("m.payload"), F.struct("m.op", "m.ts_ms", "m.before", "m.after"))
        opened = df.select(read.alias("m")).select(body.alias("b"))
        op = F.when(F.col("b.op").isin("c", "r"), "insert").when(F.col("b.op") == "u", "update").when(F.col("b.op") == "d", "delete")
        found = opened.select(op.alias("__op"), F.col("b.ts_ms").alias("__ts"), F.when(F.col("b.op") == "d", F.col("b.before")).otherwise(F.col("b.after")).alias("r"))
    elif envelope == "canal-json":
        read = F.from_json(text, f"struct<type:string,ts:bigint,data:array<{row}>>")
        opened = df.select(read.alias("m")).select(F.lower("m.type").alias("__op"), F.col("m.ts").alias("__ts"), F.explode("m.data").alias("r"))
        found = opened.where(F.col("__op").isin("insert", "update", "delete"))
    elif envelope == "maxwell-json":
        read = F.from_json(text, f"struct<type:string,ts:bigint,data:{row}>")
        opened = df.select(read.alias("m")).select(F.regexp_replace(F.lower("m.type"), "^bootstrap-", "").alias("__op"), (F.col("m.ts") * 1000).alias("__ts"), F.col("m.data").alias("r"))
        found = opened.where(F.col("__op").isin("insert", "update", "delete"))
    else:
        raise ValueError(f"no decoder for {envelope}")
    return found.where("__op IS NOT NULL AND r IS NOT NULL").select("__op", "__ts", "r.*")


def _order(sequence: list[str], ascending: bool) -> list[F.Column]:
    return [F.col(quote(c)).asc_nulls_first() if ascending else F.col(quote(c)).desc_nulls_last() for c in sequence]


def fold(changes: DataFrame, key: list[str], sequence: list[str], op: str = "__op") -> DataFrame:
    """Current rows: the latest change of each key, unless it is a delete."""
    rank = F.row_number().over(Window.partitionBy(*[quote(k) for k in key]).orderBy(*_order(sequence, False)))
    return changes.withColumn("__rank", rank).where((F.col("__rank") == 1) & ~F.col(op).eqNullSafe(F.lit("delete"))).drop("__rank", op)


def merge(rows: DataFrame, key: list[str], engine: str, sequence: list[str], aggregates: dict[str, str] | None = None) -> DataFrame:
    """Rows of one key as a keyed table would hold them.

    ``deduplicate`` keeps the latest, ``first-row`` the earliest, ``partial-update`` the
    latest value of each column that is not null, and ``aggregation`` a function per column
    (``sum min max count first_value last_value last_non_null_value bool_and bool_or
    listagg``; columns without one take their last value). All but the ranked ones are
    partial aggregations, so a hot key is reduced before the shuffle.
    """
    columns = [c for c in rows.columns if c not in key]
    keys = [F.col(quote(k)) for k in key]
    order = F.struct(*[F.col(quote(c)) for c in sequence])
    if engine in ("deduplicate", "first-row"):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*_order(sequence, engine == "first-row")))
        return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")

    def latest(c: str) -> F.Column:
        return F.max_by(F.col(quote(c)), F.when(F.col(quote(c)).isNotNull(), order))

    if engine == "partial-update":
        return rows.groupBy(*keys).agg(*[latest(c).alias(c) for c in columns]).select(*[quote(c) for c in rows.columns])
    if engine != "aggregation":
        raise ValueError(f"no merge engine {engine}")
    made = []
    for c in columns:
        column = F.col(quote(c))
        functions = {
            "sum": lambda x: F.sum(x), "min": lambda x: F.min(x), "max": lambda x: F.max(x), "count": lambda x: F.count(x), "product": lambda x: F.product(x),
            "first_value": lambda x: F.min_by(x, order), "last_value": lambda x: F.max_by(x, order), "bool_and": lambda x: F.bool_and(x), "bool_or": lambda x: F.bool_or(x),
            "listagg": lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), x.cast("string").alias("v")))), lambda s: s["v"]), ","),
        }
        kind = (aggregates or {}).get(c, "last_non_null_value")
        if kind != "last_non_null_value" and kind not in functions:
            raise ValueError(f"no aggregate {kind}")
        made.append((latest(c) if kind == "last_non_null_value" else functions[kind](column)).alias(c))
    return rows.groupBy(*keys).agg(*made).select(*[quote(c) for c in rows.columns])


def upsert(current: DataFrame, changes: DataFrame, key: list[str], sequence: list[str]) -> DataFrame:
    """A keyed table after more changes (``__op`` as in :func:`decode_changes`)."""
    based = current.withColumn("__op", F.lit("insert"))
    return fold(based.unionByName(changes, allowMissingColumns=True), key, sequence)


def _kinds(columns: list[str], engine: str, aggregates: dict[str, str] | None) -> dict[str, str]:
    """The function of each column in the engines that merge column by column."""
    given = (aggregates or {}) if engine == "aggregation" else {}
    return {c: given.get(c, "last_non_null_value") for c in columns}


def begin(rows: DataFrame, key: list[str], engine: str, sequence: list[str], aggregates: dict[str, str] | None, write: int) -> DataFrame:
    """Rows as accumulators of a keyed table; ``write`` numbers the write that brings them.

    Ranked engines hold the row beside its sequence and whether it is a delete. The others
    hold each column as its function needs it. They know no deletes: one stops the write.
    """
    op = F.col("__op") if "__op" in rows.columns else F.lit(None).cast("string")
    gone = op.eqNullSafe(F.lit("delete"))
    columns = [c for c in rows.columns if c not in key and c != "__op"]
    keys = [F.col(quote(k)) for k in key]
    at = F.struct(*[F.col(quote(c)).alias(f"s{n}") for n, c in enumerate(sequence)], F.lit(write).cast("long").alias("write"))
    if engine in ("deduplicate", "first-row"):
        return rows.select(*keys, F.struct(at.alias("at"), gone.alias("gone"), F.struct(*[F.col(quote(c)) for c in columns]).alias("row")).alias("__held"))
    if engine not in ("partial-update", "aggregation"):
        raise ValueError(f"no merge engine {engine}")
    made = []
    for c, kind in _kinds(columns, engine, aggregates).items():
        x, of = F.col(quote(c)), rows.schema[c].dataType
        if kind == "sum" and isinstance(of, T.DecimalType):
            state = x.cast(T.DecimalType(38, of.scale))
        elif kind == "sum":
            state = x.cast("long" if isinstance(of, T.IntegralType) else "double")
        elif kind == "product":
            state = x.cast("double")
        elif kind in ("min", "max", "bool_and", "bool_or"):
            state = x
        elif kind == "count":
            state = F.when(x.isNotNull(), 1).otherwise(0).cast("long")
        elif kind in ("first_value", "last_value"):
            state = F.struct(at.alias("at"), x.alias("x"))
        elif kind == "last_non_null_value":
            state = F.when(x.isNotNull(), F.struct(at.alias("at"), x.alias("x")))
        elif kind == "listagg":
            state = F.filter(F.array(F.struct(at.alias("at"), x.cast("string").alias("x"))), lambda s: s["x"].isNotNull())
        else:
            raise ValueError(f"no aggregate {kind}")
        made.append(F.when(gone, F.raise_error(f"{engine} takes no deletes")).otherwise(state).alias(c) if "__op" in rows.columns else state.alias(c))
    return rows.select(*keys, *made)


def combine(state: DataFrame, key: list[str], engine: str, aggregates: dict[str, str] | None = None) -> DataFrame:
    """One accumulator per key; aggregates partially, so that a hot key is reduced before the shuffle."""
    keys = [F.col(quote(k)) for k in key]
    if engine in ("deduplicate", "first-row"):
        pick = F.max_by if engine == "deduplicate" else F.min_by
        return state.groupBy(*keys).agg(pick("__held", F.col("__held.at")).alias("__held"))
    made = []
    for c, kind in _kinds([c for c in state.columns if c not in key], engine, aggregates).items():
        x = F.col(quote(c))
        made.append({
            "sum": lambda x: F.sum(x), "count": lambda x: F.sum(x), "product": lambda x: F.product(x), "min": lambda x: F.min(x), "max": lambda x: F.max(x),
            "bool_and": lambda x: F.bool_and(x), "bool_or": lambda x: F.bool_or(x), "first_value": lambda x: F.min_by(x, x["at"]), "last_value": lambda x: F.max_by(x, x["at"]),
            "last_non_null_value": lambda x: F.max_by(x, x["at"]), "listagg": lambda x: F.flatten(F.collect_list(x)),
        }[kind](x).cast(state.schema[c].dataType).alias(c))
    return state.groupBy(*keys).agg(*made)


def finish(state: DataFrame, key: list[str], engine: str, aggregates: dict[str, str] | None = None) -> DataFrame:
    """The rows that accumulators stand for."""
    keys = [F.col(quote(k)) for k in key]
    if engine in ("deduplicate", "first-row"):
        return state.where("NOT __held.gone").select(*keys, "__held.row.*")
    made = []
    for c, kind in _kinds([c for c in state.columns if c not in key], engine, aggregates).items():
        x = F.col(quote(c))
        if kind in ("first_value", "last_value", "last_non_null_value"):
            x = x["x"]
        elif kind == "listagg":
            x = F.array_join(F.transform(F.array_sort(x), lambda s: s["x"]), ",")
        made.append(x.alias(c))
    return state.select(*keys, *made)
