"""Grouped aggregation and time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.functions.dialect import quote, rewrite
from tarnflow.functions.types import to_interval, to_milliseconds


def _outputs(group_by: list[str], select: dict[str, str], order: str | None) -> list[F.Column]:
    """Aggregates under their aliases; an entry named like a group column must be that column."""
    made = []
    for alias, expression in select.items():
        if alias in group_by:
            if expression.strip().strip("`") != alias:
                raise ValueError(f"{alias} is a group column and cannot be {expression!r}")
            continue
        made.append(F.expr(rewrite(expression, order)).alias(alias))
    return made


def aggregate(df: DataFrame, group_by: list[str], select: dict[str, str], having: str | None = None, order: str | None = None) -> DataFrame:
    """Group columns first, then the aggregates; without group columns one row for all."""
    grouped = df.groupBy(*[F.col(quote(c)) for c in group_by]).agg(*_outputs(group_by, select, order))
    return grouped.where(rewrite(having)) if having else grouped


def grouping(df: DataFrame, kind: str, group_by: list[str], select: dict[str, str], sets: list[list[str]] | None = None) -> DataFrame:
    """``cube``, ``rollup`` or ``sets`` over the group columns."""
    columns = [F.col(quote(c)) for c in group_by]
    made = _outputs(group_by, select, None)
    if kind == "cube":
        return df.cube(*columns).agg(*made)
    if kind == "rollup":
        return df.rollup(*columns).agg(*made)
    return df.groupingSets([[F.col(quote(c)) for c in s] for s in sets or []], *columns).agg(*made)


def _flat(df: DataFrame, keys: list[str], made: list[F.Column], window: F.Column) -> DataFrame:
    names = [c for c in df.groupBy(*[F.col(quote(k)) for k in keys], window.alias("__w")).agg(*made).columns if c != "__w"]
    grouped = df.groupBy(*[F.col(quote(k)) for k in keys], window.alias("__w")).agg(*made)
    return grouped.select(*[quote(n) for n in names], F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"))


def tumble(df: DataFrame, on: str, size: str | int, group_by: list[str], select: dict[str, str]) -> DataFrame:
    """Windows ``[start, end)`` aligned to the epoch; keys, aggregates, ``window_start``, ``window_end``."""
    return _flat(df, group_by, _outputs(group_by, select, on), F.window(on, to_interval(size)))


def slide(df: DataFrame, on: str, size: str | int, step: str | int, group_by: list[str], select: dict[str, str]) -> DataFrame:
    """Overlapping windows of ``size``, one every ``step``."""
    return _flat(df, group_by, _outputs(group_by, select, on), F.window(on, to_interval(size), to_interval(step)))


def session(df: DataFrame, on: str, gap: str | int, group_by: list[str], select: dict[str, str], scope: str = "key") -> DataFrame:
    """Sessions that end after ``gap`` without rows, per group key or over all rows (``scope='global'``)."""
    if scope == "key":
        return _flat(df, group_by, _outputs(group_by, select, on), F.session_window(on, to_interval(gap)))
    return _flat(session_windows(df, on, gap, []).withColumn("__s", F.struct(F.col("window_start").alias("start"), F.col("window_end").alias("end"))).drop("window_start", "window_end"), group_by, _outputs(group_by, select, on), F.col("__s"))


def tumble_windows(df: DataFrame, on: str, size: str | int, step: str | int | None = None) -> DataFrame:
    """All rows with ``window_start`` and ``window_end``; with ``step`` a row per window it lies in."""
    window = F.window(on, to_interval(size), to_interval(step)) if step else F.window(on, to_interval(size))
    return df.select("*", window.alias("__w")).select(*[quote(c) for c in df.columns], F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"))


def session_windows(df: DataFrame, on: str, gap: str | int, keys: list[str]) -> DataFrame:
    """All rows with the bounds of their session: islands between gaps.

    Without keys the islands are found in two levels: every day's rows on their own, then the
    days in order, so that no task sorts all rows.
    """
    milliseconds = to_milliseconds(gap)
    micros = F.unix_micros(F.col(quote(on)).cast("timestamp"))
    if keys:
        order = Window.partitionBy(*[quote(k) for k in keys]).orderBy("__t")
        timed = df.withColumn("__t", micros).withColumn("__before", F.lag("__t").over(order))
        cut = timed.withColumn("__n", F.sum(F.when(F.col("__t") - F.col("__before") <= milliseconds * 1000, 0).otherwise(1)).over(order))
        whole = Window.partitionBy(*[quote(k) for k in keys], "__n")
        start, end = F.min(quote(on)).over(whole), F.max(quote(on)).over(whole)
    else:
        day = F.floor(F.col("__t") / 86_400_000_000)
        timed = df.withColumn("__t", micros).withColumn("__day", day)
        days = timed.groupBy("__day").agg(F.max("__t").alias("__last"))
        by_day = Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
        ends = days.select(F.col("__day").alias("__d"), F.max("__last").over(by_day).alias("__carry"))
        inside = Window.partitionBy("__day").orderBy("__t")
        joined = timed.join(ends, F.col("__day") == F.col("__d"), "left").withColumn("__before", F.coalesce(F.lag("__t").over(inside), F.col("__carry")))
        opened = joined.withColumn("__new", F.when(F.col("__t") - F.col("__before") <= milliseconds * 1000, 0).otherwise(1))
        counts = opened.groupBy("__day").agg(F.sum("__new").alias("__opened")).select(F.col("__day").alias("__e"), F.coalesce(F.sum("__opened").over(by_day), F.lit(0)).alias("__base"))
        cut = opened.join(counts, F.col("__day") == F.col("__e"), "left").withColumn("__n", F.col("__base") + F.sum("__new").over(inside))
        bounds = cut.groupBy(F.col("__n").alias("__m")).agg(F.min(quote(on)).alias("__lo"), F.max(quote(on)).alias("__hi"))
        cut = cut.join(bounds, F.col("__n") == F.col("__m"))
        start, end = F.col("__lo"), F.col("__hi")
    return cut.withColumn("window_start", start).withColumn("window_end", end + F.expr(f"INTERVAL '{milliseconds / 1000}' SECOND")).select(*[quote(c) for c in df.columns], "window_start", "window_end")


def cumulate(df: DataFrame, on: str, size: str | int, step: str | int, group_by: list[str], select: dict[str, str]) -> DataFrame:
    """Windows that start together and grow by ``step`` up to ``size``."""
    full, part = to_milliseconds(size), to_milliseconds(step)
    opened = df.select("*", F.window(on, to_interval(size)).alias("__w"))
    nth = F.floor((F.unix_micros(F.col(quote(on)).cast("timestamp")) - F.unix_micros(F.col("__w.start").cast("timestamp"))) / (part * 1000))
    grown = opened.withColumn("__k", F.explode(F.sequence(nth + 1, F.lit(full // part).cast("long"))))
    end = F.col("__w.start") + F.make_dt_interval(secs=F.col("__k") * F.lit(part / 1000.0))
    framed = grown.withColumn("__c", F.struct(F.col("__w.start").alias("start"), end.alias("end"))).drop("__w", "__k")
    return _flat(framed, group_by, _outputs(group_by, select, on), F.col("__c"))
