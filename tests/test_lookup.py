"""Lookups in a database outside Spark: how many are made, when they are made again, what rows they give."""

import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from tarnflow.operators.lookup import LookupCache, look_up, lookup_rows


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "dim.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE dim (id INTEGER, name TEXT, score REAL)")
        db.executemany("INSERT INTO dim VALUES (?, ?, ?)", [(k, f"n{k}", k / 2 if k % 3 else None) for k in range(50)] + [(7, "again", 0.5)])
        db.execute("CREATE TABLE asked (id INTEGER)")
    return path


def fetcher(path):
    def fetch(keys):
        import sqlite3

        with sqlite3.connect(path, timeout=30) as db:
            marks = ",".join("?" * len(keys))
            db.executemany("INSERT INTO asked VALUES (?)", keys)
            return [((r[0],), r[1:]) for r in db.execute(f"SELECT id, name, score FROM dim WHERE id IN ({marks})", [k[0] for k in keys])]

    return fetch


def asked(path):
    with sqlite3.connect(path) as db:
        return db.execute("SELECT count(*), count(DISTINCT id) FROM asked").fetchone()


def test_rows_and_number_of_lookups(spark, database):
    df = spark.range(4000).select((F.col("id") % 60).alias("k"), F.col("id").alias("n")).union(spark.sql("SELECT CAST(NULL AS BIGINT), 9999L")).coalesce(1)
    joined = lookup_rows(df, fetcher(database), ["k"], "name string, score double", cache_name="a", batch=7)
    rows = joined.collect()
    by_key = {}
    for r in rows:
        by_key.setdefault(r.k, set()).add((r.name, r.score))
    assert len(rows) == 4001 + sum(r.k == 7 for r in rows) // 2
    assert by_key[7] == {("n7", 3.5), ("again", 0.5)} and by_key[6] == {("n6", None)} and by_key[55] == by_key[None] == {(None, None)}
    assert asked(database) == (60, 60)  # each key once, those without rows too, null never
    assert lookup_rows(df, fetcher(database), ["k"], "name string, score double", how="inner", cache_name="a", batch=7).where("k >= 50 OR k IS NULL").count() == 0
    with pytest.raises(ValueError, match="both sides"):
        lookup_rows(df, fetcher(database), ["k"], "n string")


def test_rows_are_asked_for_again_after_ttl(spark, database):
    df = spark.range(3).select(F.col("id").alias("k")).coalesce(1)

    def run(ttl):
        return sorted(r.name for r in lookup_rows(df, fetcher(database), ["k"], "name string, score double", cache_ttl=ttl, cache_name=f"ttl{ttl}").collect())

    for ttl in ("1 second", None):
        assert run(ttl) == ["n0", "n1", "n2"]
    with sqlite3.connect(database) as db:
        db.execute("UPDATE dim SET name = 'new' WHERE id = 1")
    time.sleep(1.2)
    assert run("1 second") == ["n0", "n2", "new"]
    assert run(None) in (["n0", "n1", "n2"], ["n0", "n2", "new"])  # the cache of the worker that has it, or a new worker's


def test_cache_is_bounded_and_expires():
    now = [0.0]
    cache = LookupCache(2, 1000, lambda: now[0])
    calls = []

    def fetch(keys):
        calls.extend(keys)
        return [(k, k) for k in keys]

    def ask(*keys):
        return look_up(fetch, [(k,) for k in keys], cache, 2, 3, 5, 0)

    assert ask(1, 2, 1) == {(1,): [(1,)], (2,): [(2,)]} and calls == [(1,), (2,)]
    ask(1)
    ask(3)  # 2 goes, as 1 was used since
    ask(1)
    assert calls == [(1,), (2,), (3,)]
    now[0] = 1.0
    ask(1)
    assert calls[-1] == (1,) and len(cache.held) <= 2


def test_failures_are_tried_again_and_calls_run_side_by_side():
    tries = []

    def shaky(keys):
        tries.append(1)
        if len(tries) < 3:
            raise OSError("lost")
        return [(k, (1,)) for k in keys]

    assert look_up(shaky, [(1,)], LookupCache(1, None), 1, 1, 5, 2) == {(1,): [(1,)]}
    with pytest.raises(OSError):
        look_up(lambda keys: (_ for _ in ()).throw(OSError("gone")), [(1,)], LookupCache(1, None), 1, 1, 5, 1)

    def slow(keys):
        time.sleep(0.2)
        return []

    began = time.perf_counter()
    assert look_up(slow, [(k,) for k in range(8)], LookupCache(0, None), 1, 8, 5, 0) == {(k,): [] for k in range(8)}
    assert time.perf_counter() - began < 1.2
    with pytest.raises(TimeoutError):
        look_up(slow, [(1,)], LookupCache(0, None), 1, 1, 0.05, 0)
