"""Branches, side outputs and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.functions.dialect import quote, rewrite


def route(df: DataFrame, branches: dict[str, str], default: str | None = None, default_mode: str = "all") -> dict[str, DataFrame]:
    """A DataFrame per branch; branches are independent, so a row may enter several.

    The default branch gets every row, or with ``default_mode='unmatched'`` those that no branch takes.
    """
    found = {name: df if condition.strip().lower() == "true" else df.where(rewrite(condition)) for name, condition in branches.items()}
    if default:
        taken = " OR ".join(f"coalesce(({rewrite(c)}), false)" for c in branches.values()) or "false"
        found[default] = df if default_mode == "all" else df.where(f"NOT ({taken})")
    return found


def route_once(df: DataFrame, branches: dict[str, str], path: str, default: str | None = None, default_mode: str = "all") -> dict[str, DataFrame]:
    """The branches of :func:`route`, but the input is computed once, however many sinks follow.

    Every row is tagged with the branches that take it and written once for each of them, to a partition of
    ``path`` by tag; a branch reads its partition alone. The folder is the caller's to delete.
    """
    taken = {name: f"coalesce(({rewrite(c)}), false)" for name, c in branches.items()}
    if default:
        taken[default] = "true" if default_mode == "all" else f"NOT ({' OR '.join(taken.values()) or 'false'})"
    tag = unused_column("route", df.columns)
    tags = F.filter(F.array(*[F.when(F.expr(c), F.lit(name)) for name, c in taken.items()]), lambda t: t.isNotNull())
    df.withColumn(tag, F.explode(tags)).write.mode("overwrite").partitionBy(tag).parquet(path)
    written = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField(tag, T.StringType())])).parquet(path)
    return {name: written.where(F.col(tag) == name).drop(tag) for name in taken}


def unused_column(name: str, taken: list[str]) -> str:
    """``name`` behind underscores that no column has."""
    held = {t.lower() for t in taken}
    found = f"__{name}"
    while found in held:
        found = f"_{found}"
    return found


def validate_once(df: DataFrame, path: str, null_as_reject: bool = False, **checks) -> tuple[DataFrame, DataFrame]:
    """:func:`validate` with the input computed once; ``checks`` are those of :func:`rules`."""
    every = " AND ".join(f"({c})" for c in rules(**checks).values()) or "true"
    every = f"coalesce({every}, false)" if null_as_reject else f"({every})"
    found = route_once(df, {"valid": every, "rejected": f"NOT {every}"}, path)
    return found["valid"], validate(found["rejected"], null_as_reject=null_as_reject, **checks)[1]


def side_output(df: DataFrame, condition: str, tag: str | None = None, null_to_side: bool = False) -> tuple[DataFrame, DataFrame]:
    """Main rows (condition false) and side rows (true) with ``_side_ts`` and ``_side_tag``.

    A null condition drops the row from both unless ``null_to_side``.
    """
    test = f"coalesce(({rewrite(condition)}), true)" if null_to_side else f"({rewrite(condition)})"
    side = df.where(test).withColumn("_side_ts", F.current_timestamp())
    return df.where(f"NOT {test}"), side.withColumn("_side_tag", F.lit(tag)) if tag else side


def rules(not_null: list[str] | None = None, ranges: dict[str, tuple] | None = None, expressions: dict[str, str] | None = None) -> dict[str, str]:
    """Labels and conditions, in the order in which a failure is reported."""
    found = {f"notNull:{c}": f"{quote(c)} IS NOT NULL" for c in not_null or []}
    for column, (low, high) in (ranges or {}).items():
        found[f"range:{column}[{low},{high}]"] = f"{quote(column)} BETWEEN {low} AND {high}"
    return found | {f"expression:{name}": rewrite(e) for name, e in (expressions or {}).items()}


def validate(
    df: DataFrame,
    not_null: list[str] | None = None,
    ranges: dict[str, tuple] | None = None,
    expressions: dict[str, str] | None = None,
    null_as_reject: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected ones with ``_validation_error`` (first failing rule) and ``_validated_at``.

    A rule that is null sends the row to neither side unless ``null_as_reject``.
    """
    checks = rules(not_null, ranges, expressions)
    every = " AND ".join(f"({c})" for c in checks.values()) or "true"
    if null_as_reject:
        every = f"coalesce({every}, false)"
    error = F.lit(None).cast("string")
    for label, check in reversed(checks.items()):
        error = F.when(F.expr(f"NOT coalesce(({check}), false)" if null_as_reject else f"NOT ({check})"), F.lit(label)).otherwise(error)
    rejected = df.where(f"NOT ({every})").withColumn("_validation_error", error).withColumn("_validated_at", F.current_timestamp())
    return df.where(every), rejected
