"""The divergence audit, against dense exact arithmetic in plain Python and against its SQL."""

import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from tarnflow.llm import divergence, queries


def dense(rows, min_df=divergence.MIN_DF, top=divergence.TOP_TERMS):
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df, total = Counter(t for d in own for t in d[2]), Counter()
        for d in own:
            total.update(d[2])
        kept = [t for t, n in df.items() if n >= min_df]

        def shares(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (n + 2 * len(kept)) for t in kept}

        counts = {}
        for _, source, c in own:
            counts.setdefault(source, Counter()).update(c)
        p, q = {s: shares(c) for s, c in counts.items()}, shares(total)

        def f(x, y):
            return (x - y) ** 2 // (x + y)

        for s in p:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in p if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                listed = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(listed)]
    return sorted(out)


def test_op12(spark, sf_dir):
    found = sorted(map(tuple, queries.QUERIES["op12_source_divergence"](spark, sf_dir).collect()))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text").collect()
    assert found == dense([tuple(r) for r in docs]) and {r[2] for r in found} == {"pair", "term"}
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
        assert found == sorted(db.sql(queries.SQL["op12_source_divergence"]).fetchall())


def test_odd_rows(spark):
    """Nulls, empties, languages without terms or with one source, non-ASCII letters, repeats and clashing names."""
    rnd = random.Random(7)
    words = ["alpha", "Beta", "BETA", "é", "É", "ünï", "中文", "x1y", "a-b", "naïve", "K", "ſ"]
    rows = [(rnd.choice(["en", "de", None, ""]), rnd.choice(["a", "b", "c", None, "é", "Z"]), " ".join(rnd.choices(words, k=rnd.randrange(9)))) for _ in range(400)]
    rows += [("fr", "a", "rare word"), ("fr", "b", None), ("fr", "a", ""), ("it", "a", "only one source"), ("es", None, None)] + [("en", "long", "alpha " * 30_000)] * 2
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({c: F.lit("x") for c in ("term", "count", "p", "terms", "value", "part", "df")}).repartition(5)
    for min_df in (1, 10, 40):
        found = divergence.audit(df, min_df=min_df)
        assert sorted(map(tuple, found.collect())) == dense(rows, min_df)
    assert divergence.audit(df.where("lang = 'none'")).count() == 0


def test_large_counts_are_exact(spark):
    rnd = random.Random(1)
    rows = [(n := rnd.randrange(9 * 10**13), n + rnd.randrange(10**14), rnd.randrange(1, 10**9)) for _ in range(200)]
    df = spark.createDataFrame(rows, "c long, n long, v long")
    found = df.select(divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert [r.p for r in found] == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in rows]
