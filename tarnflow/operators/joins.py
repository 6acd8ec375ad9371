"""Joins: regular, broadcast, lookup, interval, as-of and lateral."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.functions.dialect import quote, rewrite
from tarnflow.functions.types import to_milliseconds

KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}
_PART = r"(?:(?:`[^`]+`|\w+)\.)?(?:`([^`]+)`|(\w+))"
_EQUAL = re.compile(rf"\s*\(?\s*{_PART}\s*=\s*{_PART}\s*\)?\s*")


_WORD = re.compile(r"'(?:[^']|'')*'|`[^`]*`|[()]|\b(?:AND|BETWEEN|CASE|END)\b", re.I)


def conjuncts(condition: str) -> list[str]:
    """The parts that AND joins at the top: not in brackets, quotes, CASE or after BETWEEN."""
    parts, begin, depth, between = [], 0, 0, 0
    for found in _WORD.finditer(condition):
        word = found[0].upper()
        if word in ("(", "CASE"):
            depth += 1
        elif word in (")", "END"):
            depth -= 1
        elif word == "BETWEEN" and not depth:
            between += 1
        elif word == "AND" and not depth and between:
            between -= 1
        elif word == "AND" and not depth:
            parts.append(condition[begin : found.start()])
            begin = found.end()
    return [*parts, condition[begin:]]


def shared_keys(on: str) -> list[str]:
    """Columns that a condition of the form ``a.k = b.k AND ...`` equates under one name."""
    keys = []
    for part in conjuncts(on):
        if re.fullmatch(r"\s*(?:`[^`]+`|\w+)\s*", part):
            keys.append(part.strip().strip("`"))
            continue
        found = _EQUAL.fullmatch(part)
        if not found:
            return []
        left, right = found[1] or found[2], found[3] or found[4]
        if left == right:
            keys.append(left)
    return keys


def _condition(on: str, left: str, right: str) -> str:
    """Bare names, alone or on both sides of an equation, are taken from both inputs."""
    parts = []
    for part in conjuncts(on):
        bare = re.fullmatch(r"\s*(?:`([^`]+)`|(\w+))\s*(?:=\s*(?:`([^`]+)`|(\w+))\s*)?", part)
        if bare:
            a = bare[1] or bare[2]
            b = bare[3] or bare[4] or a
            parts.append(f"{left}.{quote(a)} = {right}.{quote(b)}")
        else:
            parts.append(part)
    return rewrite(" AND ".join(parts))


def join(left: DataFrame, right: DataFrame, on: str, how: str = "inner", left_name: str = "l", right_name: str = "r", broadcast: str | None = None) -> DataFrame:
    """Join on a condition over ``left_name`` and ``right_name``.

    Columns equated under one name appear once, with the left value: null for rows that
    only the right has. Semi and anti joins return left columns; null keys pass an anti
    join. ``broadcast`` hints a side, which Spark follows where the kind of join allows.
    """
    if how not in KINDS:
        raise ValueError(f"no such join: {how}")
    a, b = left.alias(left_name), right.alias(right_name)
    if broadcast == "left":
        a = F.broadcast(a)
    elif broadcast == "right":
        b = F.broadcast(b)
    joined = a.join(b, F.expr(_condition(on, left_name, right_name)), KINDS[how])
    if how in ("semi", "anti"):
        return joined
    keys = set(shared_keys(on))
    kept = [F.col(f"{right_name}.{quote(c)}") for c in right.columns if c not in keys]
    return joined.select(*[F.col(f"{left_name}.{quote(c)}") for c in left.columns], *kept)


def inequality_join(left: DataFrame, right: DataFrame, keys: tuple[str, str], greater: str, less: str, block_rows: int = 2048) -> DataFrame:
    """Inner join on equal ``keys`` (one column of each side) and ``greater > less`` (expressions over the left's and the right's columns).

    A plain join sends all rows of a key to one task. Here right rows are dealt by key and stretch of ``less``, about ``block_rows``
    rows each (1,024 stretches of a key at most; rows with one value lie together), and left rows are copied to the stretches
    that begin below them, so hardly any pair is looked at in vain and the tasks grow in number with the right side.
    Columns of both sides have to differ in name.
    """
    spark = left.sparkSession
    filed = right.withColumns({"__key": F.col(quote(keys[1])), "__less": F.expr(rewrite(less))}).where("__key IS NOT NULL AND __less IS NOT NULL")
    asking = left.withColumns({"__key": F.col(quote(keys[0])), "__greater": F.expr(rewrite(greater))}).where("__key IS NOT NULL AND __greater IS NOT NULL")
    most = 1024
    cuts = F.percentile_approx("__less", F.array(*[F.lit(k / most) for k in range(1, most)]), 10_000).alias("cuts")
    every = F.greatest(F.lit(1), F.floor(F.lit(most * block_rows) / F.col("n"))).cast("int").alias("every")
    edges = filed.groupBy("__key").agg(cuts, F.count("*").alias("n")).select("__key", "cuts", every)
    edges = edges.select("__key", F.filter("cuts", lambda _, at: (at + 1) % F.col("every") == 0).alias("__edges"))

    def below(value: str) -> F.Column:
        """How many edges are below a value, by halving."""
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("__edges", at + step - 1) < F.col(value), at + step).otherwise(at))

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-right.count() // block_rows))
    blocks = filed.join(edges, "__key").withColumn("__block", below("__less")).drop("__edges").repartition(parts, "__key", "__block")
    copies = asking.join(edges, "__key").withColumn("__block", F.explode(F.sequence(F.lit(0), below("__greater")))).drop("__edges").repartition(parts, "__key", "__block")
    return copies.join(blocks, ["__key", "__block"]).where("__greater > __less").select(*[quote(c) for c in [*left.columns, *right.columns]])


def broadcast_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner", limit_bytes: int = 64 << 20, **names: str) -> DataFrame:
    """Join with the right side sent to all tasks if Spark's statistics bound it by ``limit_bytes``, else as Spark plans it.

    The statistics come from files and catalog without running anything; where there are none they
    count as unbounded, and adaptive execution may still broadcast what turns out small.
    """
    size = int(str(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return join(left, right, on, how, broadcast="right" if size <= limit_bytes else None, **names)


def lookup_join(df: DataFrame, dimension: DataFrame, on: str, select: dict[str, str] | None = None, with_proc_time: bool = True) -> DataFrame:
    """Left join with a table as it is now; adds ``proc_time``.

    In a stream the dimension is read again for every micro-batch if it is a file or
    table source. ``select`` projects over ``l`` and ``r``.
    """
    stream = df.withColumn("proc_time", F.current_timestamp()) if with_proc_time else df
    if select is None:
        return join(stream, dimension, on, "left")
    joined = stream.alias("l").join(dimension.alias("r"), F.expr(_condition(on, "l", "r")), "left")
    return joined.select(*[F.expr(rewrite(e)).alias(a) for a, e in select.items()])


def interval_join(
    left: DataFrame, right: DataFrame, on: str, left_from: str, left_to: str, right_time: str, how: str = "inner", bucket: str | int | None = None
) -> DataFrame:
    """Join on a condition and ``right_time BETWEEN left_from AND left_to`` (inclusive, expressions over ``l``).

    ``bucket``, a duration about as long as the interval, makes the time part of the join
    key: left rows are copied to every bucket that their interval touches. It spreads
    hot keys and long histories over tasks and is for bounded inner joins.
    """
    condition = F.expr(_condition(on, "l", "r")) & F.expr(f"r.{quote(right_time)} BETWEEN {rewrite(left_from)} AND {rewrite(left_to)}")
    keys = set(shared_keys(on))
    columns = [F.col(f"l.{quote(c)}") for c in left.columns] + [F.col(f"r.{quote(c)}") for c in right.columns if c not in keys]
    if bucket is None:
        return left.alias("l").join(right.alias("r"), condition, KINDS[how]).select(*columns)
    if how != "inner":
        raise ValueError("buckets are for inner joins")
    width = to_milliseconds(bucket) * 1000

    def micros(column: F.Column) -> F.Column:
        return F.unix_micros(column.cast("timestamp"))

    start, end = (micros(F.expr(rewrite(e))) for e in (left_from, left_to))
    slots = F.when(start <= end, F.sequence(F.floor(start / width), F.floor(end / width)))
    dealt = left.alias("l").withColumn("__slot", F.explode(slots)).alias("l")
    filed = right.withColumn("__slot", F.floor(micros(F.col(quote(right_time))) / width)).alias("r")
    return dealt.join(filed, (F.col("l.__slot") == F.col("r.__slot")) & condition).select(*columns)


def as_of_join(
    stream: DataFrame, versions: DataFrame, key: str | list[str], as_of: str, version_time: str, prefix: str = "", deleted: str | None = None, bucket: str | int | None = None
) -> DataFrame:
    """Left join with the version that was valid at ``as_of``: the last with ``version_time <= as_of`` per key.

    Both sides are dealt once by key and sorted by time; a running ``last`` carries the
    version to the rows after it, so nothing is paired. Version columns that clash with a
    stream column get ``prefix`` or go if it is empty. Where ``deleted`` is true of a
    version, the key has none from then on; versions without a time are none.

    ``bucket``, a duration, spreads a hot key: rows are dealt by key and stretch of time, and the last version of each
    stretch is carried on to later ones in a second step over one row for each stretch.
    """
    keys = [key] if isinstance(key, str) else key
    carried = [c for c in versions.columns if c not in keys and (prefix or c not in stream.columns)]
    names = {c: f"{prefix}{c}" if prefix or c in stream.columns else c for c in carried}
    version = F.struct(*[F.col(quote(c)) for c in carried])
    live = F.when(F.expr(deleted), F.lit(None)).otherwise(version) if deleted else version
    facts = stream.select(*[F.col(quote(k)).alias(f"__k{n}") for n, k in enumerate(keys)], F.col(quote(as_of)).alias("__at"), F.lit(1).alias("__side"), F.struct("*").alias("__row"), F.lit(None).alias("__version"))
    known = versions.select(*[F.col(quote(k)).alias(f"__k{n}") for n, k in enumerate(keys)], F.col(quote(version_time)).alias("__at"), F.lit(0).alias("__side"), F.lit(None).alias("__row"), F.struct(live.alias("v")).alias("__version")).where("__at IS NOT NULL")
    names_of_keys = [f"__k{n}" for n in range(len(keys))]
    merged = facts.unionByName(known)
    dealt = names_of_keys
    if bucket is not None:
        width = to_milliseconds(bucket) * 1000
        merged = merged.withColumn("__slot", F.floor(F.unix_micros(F.col("__at").cast("timestamp")) / width))
        dealt = [*names_of_keys, "__slot"]
    order = Window.partitionBy(*dealt).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged_found = merged.withColumn("__found", F.last("__version", ignorenulls=True).over(order)).where("__side = 1")
    if bucket is not None:
        ends = merged.groupBy(*dealt).agg(F.max_by("__version", F.when(F.col("__side") == 0, F.col("__at"))).alias("__end"))
        before = Window.partitionBy(*names_of_keys).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
        carried_on = ends.withColumn("__carried", F.last("__end", ignorenulls=True).over(before)).where("__carried IS NOT NULL").select(*dealt, "__carried")
        merged_found = merged_found.join(carried_on, dealt, "left").withColumn("__found", F.coalesce("__found", "__carried"))
    merged = merged_found
    valid = F.col("__at").isNotNull()
    for n in range(len(keys)):
        valid = valid & F.col(f"__k{n}").isNotNull()
    return merged.select("__row.*", *[F.when(valid, F.col("__found.v").getField(c)).alias(names[c]) for c in carried])


def lateral_join(df: DataFrame, function: str, args: list[str], into: dict[str, str], how: str = "cross") -> DataFrame:
    """Rows of a registered table function applied to each row (``left`` keeps rows without any)."""
    spark = df.sparkSession
    join_word = "LEFT JOIN" if how == "left" else "JOIN"
    names = ", ".join(quote(n) for n in into)
    calls = ", ".join(rewrite(a) for a in args)
    tail = " ON true" if how == "left" else ""
    return spark.sql(f"SELECT * FROM {{df}} AS l {join_word} LATERAL {function}({calls}) AS t({names}){tail}", df=df)
