"""Lookup joins against an outside table, with a cache that is bounded and expires, and lookups side by side."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.functions.dialect import quote
from tarnflow.functions.types import to_milliseconds

#: Rows of the outside table for keys: ``fetch(keys)`` gives ``(key, row)`` pairs; a key may have several rows or none.
Fetch = Callable[[list[tuple]], Iterable[tuple[tuple, tuple]]]


class LookupCache:
    """Rows by key: the most recently used keys, each for a limited time. Keys without rows are remembered too."""

    def __init__(self, most: int, ttl_ms: int | None, clock: Callable[[], float] = time.monotonic) -> None:
        self.most, self.ttl_ms, self.clock = most, ttl_ms, clock
        self.held: OrderedDict[tuple, tuple[float, list[tuple]]] = OrderedDict()

    def get(self, key: tuple) -> list[tuple] | None:
        found = self.held.get(key)
        if found is None:
            return None
        if self.ttl_ms is not None and (self.clock() - found[0]) * 1000 >= self.ttl_ms:
            del self.held[key]
            return None
        self.held.move_to_end(key)
        return found[1]

    def put(self, key: tuple, rows: list[tuple]) -> None:
        if self.most <= 0:
            return
        self.held[key] = (self.clock(), rows)
        self.held.move_to_end(key)
        while len(self.held) > self.most:
            self.held.popitem(last=False)


#: Caches of this worker by name; they serve all its tasks.
_CACHES: dict[tuple, LookupCache] = {}


def look_up(fetch: Fetch, keys: list[tuple], cache: LookupCache, batch: int, parallel: int, timeout_s: float | None, retries: int) -> dict[tuple, list[tuple]]:
    """Rows of each distinct key: from the cache, else fetched in batches, several at a time."""
    found: dict[tuple, list[tuple]] = {}
    missing = []
    for key in dict.fromkeys(keys):
        rows = cache.get(key)
        if rows is None:
            missing.append(key)
        else:
            found[key] = rows
    chunks = [missing[k : k + batch] for k in range(0, len(missing), batch)]

    def one(chunk: list[tuple]) -> list[tuple[tuple, tuple]]:
        for attempt in range(retries + 1):
            try:
                return list(fetch(chunk))
            except Exception:
                if attempt == retries:
                    raise
                time.sleep(0.05 * 2**attempt)
        return []

    if chunks:
        with ThreadPoolExecutor(max(1, min(parallel, len(chunks)))) as pool:
            for chunk, pairs in zip(chunks, pool.map(one, chunks, timeout=timeout_s), strict=True):
                fresh: dict[tuple, list[tuple]] = {key: [] for key in chunk}
                for key, row in pairs:
                    fresh[tuple(key)].append(tuple(row))
                for key, rows in fresh.items():
                    cache.put(key, rows)
                found.update(fresh)
    return found


def lookup_rows(
    df: DataFrame,
    fetch: Fetch,
    key: list[str],
    schema: str | T.StructType,
    how: str = "left",
    cache_rows: int = 10_000,
    cache_ttl: str | int | None = "10 minutes",
    batch: int = 256,
    parallel: int = 4,
    timeout: str | int | None = "3 minutes",
    retries: int = 3,
    cache_name: str = "lookup",
    with_proc_time: bool = True,
) -> DataFrame:
    """Join with an outside table by ``fetch``, which runs in the tasks; batch or stream.

    ``schema`` describes the rows of the table, whose columns follow those of ``df``; clashing names are an error. ``how`` is
    ``left`` or ``inner``; null keys match nothing and are not asked for. Distinct keys of a batch of rows are looked up ``batch`` at
    a time, ``parallel`` such calls side by side; a call that fails is tried ``retries`` times more. Each Python worker
    remembers ``cache_rows`` keys under ``cache_name`` for ``cache_ttl``, so the table may be seen that much late; 0 rows
    switch the cache off. Nothing is shuffled.
    """
    table = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    clashing = {c.lower() for c in df.columns} & {f.name.lower() for f in table.fields}
    if clashing or how not in ("left", "inner"):
        raise ValueError(f"columns on both sides: {', '.join(sorted(clashing))}" if clashing else f"no such join: {how}")
    ttl_ms = None if cache_ttl is None else to_milliseconds(cache_ttl)
    timeout_s = None if timeout is None else to_milliseconds(timeout) / 1000
    named = [f"__f{k}" for k in range(len(table.fields))]
    found_type = T.ArrayType(T.StructType([T.StructField(n, f.dataType) for n, f in zip(named, table.fields, strict=True)]))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for keys in batches:
            cache = _CACHES.setdefault((cache_name, cache_rows, ttl_ms), LookupCache(cache_rows, ttl_ms))
            rows = [tuple(None if v is None or v != v else v for v in r) for r in keys.itertuples(index=False, name=None)]
            found = look_up(fetch, [r for r in rows if None not in r], cache, batch, parallel, timeout_s, retries)
            yield pd.Series([[dict(zip(named, x, strict=True)) for x in found.get(r, [])] for r in rows])

    fetched = F.pandas_udf(run, found_type, F.PandasUDFType.SCALAR_ITER)
    stream = df.withColumn("proc_time", F.current_timestamp()) if with_proc_time else df
    looked = stream.withColumn("__rows", fetched(F.struct(*[F.col(quote(k)) for k in key])))
    spread = F.explode_outer("__rows") if how == "left" else F.explode("__rows")
    return looked.withColumn("__row", spread).select(*map(quote, stream.columns), *[F.col(f"__row.{n}").alias(f.name) for n, f in zip(named, table.fields, strict=True)])
