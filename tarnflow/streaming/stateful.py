"""Stateful operators with typed state that expires: a changing top-N, and row patterns.

Both keep rows as lists in the state store under their own types, by ``transformWithState``, so
every value comes back as it was and a key's list is appended to or replaced as a whole.
The state store has to be RocksDB (see :func:`tarnflow.streaming.runner.start`).
"""

from __future__ import annotations

import math
import re
import time
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tarnflow.functions.dialect import quote, rewrite
from tarnflow.functions.types import Watermark, parse_type, to_milliseconds, with_watermark
from tarnflow.operators.pattern import _NAME, _assignments, _bounds, _match, _measure, compile_pattern


def _rank(value: object) -> tuple:
    """Spark's order: nulls first, not-a-numbers last."""
    if value is None:
        return (0,)
    return (2,) if isinstance(value, float) and math.isnan(value) else (1, value)


class _TopRows(StatefulProcessor):
    """The first rows of a key; every batch that touches the key emits its list."""

    def __init__(self, schema: T.StructType, order: list[tuple[int, bool]], n: int, ttl_ms: int | None) -> None:
        self.schema, self.order, self.n, self.ttl_ms = schema, order, n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("rows", self.schema, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best = [*map(tuple, self.held.get()), *map(tuple, rows)]
        for place, falling in reversed(self.order):
            best.sort(key=lambda r, place=place: _rank(r[place]), reverse=falling)
        best = best[: self.n]
        self.held.put(best)
        made = Row(*self.schema.fieldNames(), "rownum")
        for k, row in enumerate(best):
            yield made(*row, k + 1)

    def close(self) -> None:
        pass


def top_n_stream(df: DataFrame, key: list[str], order: list[tuple[str, bool]], n: int, ttl: str | int | None = None) -> DataFrame:
    """A changing top-N: every batch emits the list of each key it touched (``update`` mode), with ``rownum``.

    ``order`` is columns and whether they descend; nulls are smallest, and among equal rows the earlier stay. State
    is the n rows of a key. With ``ttl`` a key's rows are forgotten so long (in processing time) after the key was last touched;
    Spark then runs batches for as long as the query lives, so it takes a trigger by time and does not end by itself.
    """
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
    places = [(df.columns.index(c), falling) for c, falling in order]
    out = T.StructType([*schema.fields, T.StructField("rownum", T.LongType())])
    processor = _TopRows(schema, places, n, to_milliseconds(ttl) if ttl is not None else None)
    return df.groupBy(*map(quote, key)).transformWithState(processor, out, "update", "None" if ttl is None else "ProcessingTime")


class _Matches(StatefulProcessor):
    """Matches of a pattern in the rows of a key; state is the rows that may still be part of one."""

    def __init__(self, names: list[str], used: list[str], schema: T.StructType, steps: list[tuple], bit: dict[str, int], measures: list[str], limit: int, ttl_ms: int | None) -> None:
        self.names, self.used, self.schema, self.steps, self.bit, self.measures, self.limit, self.ttl_ms = names, used, schema, steps, bit, measures, limit, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getListState("rows", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n = len(self.used)
        arrived = int(time.time() * 1000)
        new = [(*tuple(r)[-n - 2 :], arrived) for r in rows]
        return self._advance(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def _advance(self, key: tuple, new: list[tuple], passed: int) -> Iterator[Row]:
        rows = [*map(tuple, self.held.get()), *new]
        if self.ttl_ms is not None:
            oldest = int(time.time() * 1000) - self.ttl_ms
            rows = [r for r in rows if r[-1] >= oldest]
        rows.sort(key=lambda r: r[-2])
        times = [r[-2] for r in rows]
        n_final = bisect_right(times, passed)
        masks = [r[-3] for r in rows[:n_final]]
        at = free = 0
        while at < n_final:
            end = min(n_final, bisect_right(times, times[at] + self.limit))
            names = _match(None, masks[:end] if end < n_final else masks, self.steps, self.bit, {}, at)
            open_end = end == n_final and times[at] + self.limit > passed
            if names and not (open_end and at + len(names) == end):
                matched = [dict(zip(self.used, r, strict=False)) for r in rows[at : at + len(names)]]
                yield Row(*self.names)(*key, *[_measure(m, matched, names) for m in self.measures])
                at += len(names)
                free = at
            elif open_end:
                break  # rows that have not come yet may complete a match that starts here
            else:
                at += 1
                free = at
        rest = rows[free:]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rest:
            self.held.put(rest)
            self.handle.registerTimer(max(rest[0][-2] + self.limit + 1, passed + 1))
        else:
            self.held.clear()

    def close(self) -> None:
        pass


def match_stream(
    df: DataFrame,
    partition_by: list[str],
    watermark: Watermark,
    pattern: str,
    define: dict[str, str],
    measures: dict[str, tuple[str, str]],
    within: str | int,
    ttl: str | int | None = None,
) -> DataFrame:
    """Matches of a pattern in event-time order, each emitted once the watermark has passed its rows.

    Conditions look at their own row only; the pattern is a sequence of variables with
    quantifiers. A match spans at most ``within``, so rows older than that leave the state, by a timer
    if no row of the key comes again. With ``ttl`` rows that came longer ago (in processing time) take part in no match. After
    a match the search goes on past its last row. The result is in ``append`` mode.
    """
    variables = list(dict.fromkeys(_NAME.findall(re.sub(r"\{[^}]*\}", "", pattern))))
    compile_pattern(pattern, variables)
    steps = [(n, *_bounds(q)) for n, q in _assignments(pattern)]
    if not steps:
        raise ValueError("a pattern on a stream is a sequence of variables")
    time_column = watermark.column
    mask = F.lit(0)
    for k, name in enumerate(variables):
        mask = mask + F.when(F.expr(rewrite(define.get(name, "true"))), 1 << k).otherwise(0)
    used = [c for c in df.columns if c not in partition_by and (c == time_column or any(re.search(rf"\b{re.escape(c)}\b", m) for m, _ in measures.values()))]
    timed = with_watermark(df, watermark)
    keys = [timed[quote(c)].alias(f"__k{i}") for i, c in enumerate(partition_by)]
    marked = timed.select(*keys, *map(quote, used), mask.alias("__mask"), F.unix_millis(quote(time_column)).alias("__at"))
    held = T.StructType([*[T.StructField(c, timed.schema[c].dataType) for c in used], T.StructField("__mask", T.IntegerType()), T.StructField("__at", T.LongType()), T.StructField("__arrived", T.LongType())])
    out = T.StructType([df.schema[c] for c in partition_by] + [T.StructField(a, parse_type(t)) for a, (_, t) in measures.items()])
    processor = _Matches(out.fieldNames(), used, held, steps, {v: k for k, v in enumerate(variables)}, [m for m, _ in measures.values()], to_milliseconds(within), to_milliseconds(ttl) if ttl is not None else None)
    return marked.groupBy(*[f"__k{i}" for i in range(len(partition_by))]).transformWithState(processor, out, "append", "EventTime")
