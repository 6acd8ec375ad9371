"""Deduplication, top-N, window functions and filters on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.functions.dialect import quote, rewrite


def _order(order_by: dict[str, str] | list[str]) -> list[F.Column]:
    pairs = order_by.items() if isinstance(order_by, dict) else [(c, "ASC") for c in order_by]
    return [F.col(quote(c)).desc_nulls_last() if d.upper() == "DESC" else F.col(quote(c)).asc_nulls_first() for c, d in pairs]


def top_n(df: DataFrame, partition_by: list[str], order_by: dict[str, str], n: int, keep_rank: bool = True) -> DataFrame:
    """The first ``n`` rows of each partition, with ``rownum`` unless told otherwise.

    Spark limits partitions before the shuffle already, so a hot key sends n rows per task.
    """
    ranked = df.withColumn("rownum", F.row_number().over(Window.partitionBy(*[quote(c) for c in partition_by]).orderBy(*_order(order_by)))).where(F.col("rownum") <= n)
    return ranked.withColumn("rownum", F.col("rownum").cast("long")) if keep_rank else ranked.drop("rownum")


def deduplicate(df: DataFrame, key: list[str], order: str | list[str], keep: str = "first", keep_rank: bool = True) -> DataFrame:
    """The first or last row of each key by the order columns."""
    direction = {"first": "ASC", "last": "DESC"}[keep]
    columns = [order] if isinstance(order, str) else order
    return top_n(df, key, dict.fromkeys(columns, direction), 1, keep_rank)


def window_columns(df: DataFrame, columns: dict[str, str], windows: dict[str, str] | None = None) -> DataFrame:
    """Append window expressions; ``windows`` names specifications that they may use by ``OVER name``."""
    named = ", ".join(f"{quote(n)} AS ({s})" for n, s in (windows or {}).items())
    made = ", ".join(f"{rewrite(e)} AS {quote(a)}" for a, e in columns.items())
    return df.sparkSession.sql(f"SELECT *, {made} FROM {{df}}" + (f" WINDOW {named}" if named else ""), df=df)


def qualify(df: DataFrame, condition: str, columns: dict[str, str], windows: dict[str, str] | None = None, keep: bool = False) -> DataFrame:
    """Rows whose window columns fulfil a condition; the columns go unless ``keep``."""
    found = window_columns(df, columns, windows).where(rewrite(condition))
    return found if keep else found.drop(*columns)


def sort_limit(df: DataFrame, order_by: dict[str, str], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Sorted rows, skipping ``offset`` and stopping after ``limit``."""
    found = df.orderBy(*_order(order_by))
    found = found.offset(offset) if offset else found
    return found.limit(limit) if limit is not None else found
