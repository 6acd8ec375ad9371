"""Set operations, query blocks, raw SQL, functions, views and materialized tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.udtf import UserDefinedTableFunction

from tarnflow.functions.dialect import quote, rewrite
from tarnflow.functions.types import parse_type


def union(*inputs: DataFrame) -> DataFrame:
    """All rows of inputs with the same columns, matched by name."""
    first = inputs[0]
    for other in inputs[1:]:
        if sorted(first.dtypes) != sorted(other.dtypes):
            raise ValueError(f"union: {sorted(first.dtypes)} and {sorted(other.dtypes)} differ")
        first = first.unionByName(other)
    return first


def set_operation(left: DataFrame, right: DataFrame, kind: str) -> DataFrame:
    """``intersect``, ``intersect_all``, ``except``, ``except_all`` or ``union_distinct``."""
    return {
        "intersect": left.intersect, "intersect_all": left.intersectAll, "except": left.subtract, "except_all": left.exceptAll,
        "union_distinct": lambda other: left.unionByName(other).distinct(),
    }[kind](right)


def query(
    df: DataFrame,
    select: dict[str, str],
    where: str | None = None,
    group_by: list[str] | None = None,
    having: str | None = None,
    order_by: dict[str, str] | None = None,
    windows: dict[str, str] | None = None,
) -> DataFrame:
    """One SELECT block; HAVING needs a GROUP BY. ``windows`` names window specifications."""
    if not select:
        raise ValueError("query: nothing is selected")
    if having and not group_by:
        raise ValueError("query: HAVING needs GROUP BY")
    text = "SELECT " + ", ".join(f"{rewrite(e)} AS {quote(a)}" for a, e in select.items()) + " FROM {df}"
    text += f" WHERE {rewrite(where)}" if where else ""
    text += " GROUP BY " + ", ".join(rewrite(g) for g in group_by) if group_by else ""
    text += f" HAVING {rewrite(having)}" if having else ""
    text += " WINDOW " + ", ".join(f"{quote(n)} AS ({s})" for n, s in windows.items()) if windows else ""
    text += " ORDER BY " + ", ".join(f"{c} {d}" for c, d in order_by.items()) if order_by else ""
    return df.sparkSession.sql(text, df=df)


def raw_sql(spark: SparkSession, sql: str, inputs: dict[str, DataFrame] | None = None, output: dict[str, str] | None = None) -> DataFrame:
    """A statement over named inputs; the result must have the declared columns and types."""
    found = spark.sql(sql, **(inputs or {}))
    if output is not None:
        wanted = {n: parse_type(t) for n, t in output.items()}
        if {f.name: f.dataType for f in found.schema.fields} != wanted:
            raise ValueError(f"raw_sql: result has {found.schema.simpleString()}, declared {wanted}")
    return found


def register_function(spark: SparkSession, name: str, function: Callable | str, returns: str | None = None) -> None:
    """A scalar, pandas or table function, or a JVM class by its name."""
    if isinstance(function, str):
        spark.udf.registerJavaFunction(name, function, parse_type(returns) if returns else None)
    elif isinstance(function, UserDefinedTableFunction):
        spark.udtf.register(name, function)
    elif returns and not hasattr(function, "evalType"):
        spark.udf.register(name, function, parse_type(returns))
    else:
        spark.udf.register(name, function)


def view(df: DataFrame, name: str, cache: bool = False) -> DataFrame:
    """Name a result; ``cache`` keeps it for several readers."""
    kept = df.cache() if cache else df
    kept.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def materialized_table(df: DataFrame, name: str, partition_by: list[str] | None = None, bucket_by: tuple[int, list[str]] | None = None, mode: str = "overwrite") -> DataFrame:
    """Write a result as a table of the session's catalog and read that."""
    writer = df.write.mode(mode).format("parquet")
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    writer = writer.bucketBy(bucket_by[0], *bucket_by[1]) if bucket_by else writer
    writer.saveAsTable(name)
    return df.sparkSession.table(name)
