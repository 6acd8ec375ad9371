"""Filters, projections and edits of single columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.functions.dialect import quote, rewrite
from tarnflow.functions.types import parse_type


def _require(df: DataFrame, names: list[str], what: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what}: no column {', '.join(missing)}; there are {', '.join(df.columns)}")


def filter_rows(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which the condition is true."""
    return df.where(rewrite(condition))


def map_columns(df: DataFrame, select: dict[str, str]) -> DataFrame:
    """A new projection: alias to expression."""
    return df.select(*[F.expr(rewrite(e)).alias(a) for a, e in select.items()])


def flat_map(df: DataFrame, unnest: str, into: dict[str, str]) -> DataFrame:
    """One row per element of an array or map, next to all input columns.

    Rows without elements go. ``into`` names the element's columns and their types;
    row elements spread by position, maps give key and value.
    """
    _require(df, [unnest], "flat_map")
    names, kind = list(into), df.schema[unnest].dataType
    column = F.col(quote(unnest))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        if len(kind.elementType.fields) != len(names):
            raise ValueError(f"flat_map: elements have {len(kind.elementType.fields)} fields, {len(names)} are named")
        opened = df.withColumn("__element", F.explode(column))
        parts = [F.col("__element").getField(f.name).cast(parse_type(into[n])).alias(n) for f, n in zip(kind.elementType.fields, names, strict=True)]
        return opened.select(*[quote(c) for c in df.columns], *parts)
    opened = df.select("*", F.explode(column).alias(*(f"__{n}" for n in names)))
    return opened.select(*[quote(c) for c in df.columns], *[F.col(quote(f"__{n}")).cast(parse_type(into[n])).alias(n) for n in names])


def rename(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rename columns in place."""
    _require(df, list(columns), "rename")
    return df.withColumnsRenamed(columns)


def drop(df: DataFrame, columns: list[str]) -> DataFrame:
    """All but these columns."""
    _require(df, columns, "drop")
    return df.drop(*columns)


def cast(df: DataFrame, columns: dict[str, str], safe: bool = False) -> DataFrame:
    """Change types in place; ``safe`` gives null where a value does not fit, else that is an error."""
    _require(df, list(columns), "cast")
    return df.select(*[_cast(F.col(quote(c)), columns[c], safe).alias(c) if c in columns else F.col(quote(c)) for c in df.columns])


def _cast(column: F.Column, kind: str, safe: bool) -> F.Column:
    return column.try_cast(parse_type(kind)) if safe else column.cast(parse_type(kind))


def coalesce(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Replace nulls in place by a default expression."""
    _require(df, list(columns), "coalesce")
    return df.select(*[F.coalesce(F.col(quote(c)), F.expr(rewrite(columns[c]))).alias(c) if c in columns else F.col(quote(c)) for c in df.columns])


def add_field(df: DataFrame, columns: dict[str, str], types: dict[str, str] | None = None) -> DataFrame:
    """Append computed columns; they see input columns only and may not reuse a name."""
    taken = [c for c in columns if c in df.columns]
    if taken:
        raise ValueError(f"add_field: {', '.join(taken)} already exists")
    made = [F.expr(rewrite(e)) for e in columns.values()]
    made = [c.cast(parse_type(types[n])) if types and n in types else c for n, c in zip(columns, made, strict=True)]
    return df.select("*", *[c.alias(n) for n, c in zip(columns, made, strict=True)])
