"""Hits that do not overlap, chosen in one pass over the hits of a key."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tarnflow.operators import pattern


@pytest.mark.parametrize("size", [2, 5])
def test_choice_equals_a_plain_scan(spark, size):
    rnd = random.Random(size)
    hits = {key: sorted(rnd.sample(range(1, 400), n)) for key, n in (("a", 399), ("b", 200), ("c", 40), (None, 100), ("d", 1))}
    rows = [(k, at, (at,)) for k, places in hits.items() for at in places]
    df = spark.createDataFrame(rows, "k string, __at long, __m struct<v: long>").repartition(5)
    wanted = []
    for k, places in hits.items():
        free = 0
        for at in places:
            if at >= free:
                wanted.append((k, at))
                free = at + size
    found = pattern.choose_apart(df, ["k"], size).select("k", "__m.v").collect()
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)
    keyless = pattern.choose_apart(df.where("k = 'a'").drop("k"), [], size)
    assert sorted(r["__at"] for r in keyless.collect()) == sorted(at for k, at in wanted if k == "a")


def test_one_key_of_many_rows(spark):
    """Time is linear in the rows of a key, and no task holds all of it."""
    took = []
    for n in (100_000, 1_000_000):
        df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("t"), (F.col("id") % 7).alias("v"))
        began = time.perf_counter()
        found = pattern.match_rows(df, ["k"], ["t"], "A B", {"A": "v < 6", "B": "true"}, {"t": ("FIRST(A.t)", "BIGINT")})
        assert found.count() == n // 7 * 3 + {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3}[n % 7]
        took.append(time.perf_counter() - began)
    assert took[1] < 20 * max(1.0, took[0])
