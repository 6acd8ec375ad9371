from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarnflow.operators import aggregate, joins, pattern, project, ranking, relations, routing


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def small(spark):
    return spark.createDataFrame([(1, "a", 5.0), (2, None, None), (3, "c", 200.0)], "id long, name string, amount double")


def test_flat_map_drops_rows_without_elements(spark):
    df = spark.createDataFrame([(1, [1, None]), (2, []), (3, None)], "id int, xs array<int>")
    assert rows(project.flat_map(df, "xs", {"x": "INT"})) == [(1, [1, None], 1), (1, [1, None], None)]
    empty = spark.createDataFrame([(1, {"k": 2}), (2, None)], "id int, m map<string,int>")
    assert rows(project.flat_map(empty, "m", {"k": "STRING", "v": "INT"})) == [(1, {"k": 2}, "k", 2)]


def test_field_edits(small):
    assert project.rename(small, {"name": "label"}).columns == ["id", "label", "amount"]
    assert project.drop(small, ["name"]).columns == ["id", "amount"]
    assert rows(project.coalesce(small, {"name": "CONCAT('n', id)"}).select("name")) == [("a",), ("c",), ("n2",)]
    assert rows(project.cast(small, {"name": "INT"}, safe=True).select("name")) == [(None,), (None,), (None,)]
    with pytest.raises(ValueError):
        project.add_field(small, {"name": "1"})
    with pytest.raises(ValueError):
        project.drop(small, ["missing"])


def test_shared_key_keeps_left_value(spark):
    left = spark.createDataFrame([(1, "l1")], "k int, a string")
    right = spark.createDataFrame([(1, "r1"), (2, "r2")], "k int, b string")
    assert rows(joins.join(left, right, "`l`.k = `r`.k", "right")) == [(1, "l1", "r1"), (None, None, "r2")]
    assert joins.shared_keys("a.k = b.k AND `a`.`x` = `b`.`x`") == ["k", "x"]
    assert joins.shared_keys("a.k = b.j") == []


def test_anti_join_keeps_null_keys(spark):
    left = spark.createDataFrame([(1,), (None,), (2,)], "k int")
    right = spark.createDataFrame([(1,), (None,)], "k int")
    assert rows(joins.join(left, right, "l.k = r.k", "anti")) == [(2,), (None,)]


def test_inequality_join_spreads_a_key(spark):
    """A key's right rows lie in many tasks, and the rows are those of the plain join; null, NaN and equal values too."""
    left = spark.createDataFrame([(k, [1, 2, None][k % 3], [float(k % 40), None, float("nan")][(k % 50) // 48]) for k in range(300)], "a long, ak int, av double")
    right = spark.createDataFrame([(k, [1, 1, 1, 3, None][k % 5], [float(k % 61), 7.0, None, float("nan")][(k % 40) // 37]) for k in range(900)], "b long, bk int, bv double")
    found = joins.inequality_join(left, right, ("ak", "bk"), "av", "bv + 5", block_rows=16)
    plain = left.join(right, F.expr("ak = bk AND av > bv + 5"))
    assert found.columns == ["a", "ak", "av", "b", "bk", "bv"] and rows(found) == rows(plain) and plain.count() > 1000
    tasks = found.groupBy(F.spark_partition_id()).count().count()
    assert found.select("bk").distinct().count() == 1 and tasks > 5
    assert joins.inequality_join(left, right.limit(0), ("ak", "bk"), "av", "bv").count() == joins.inequality_join(left.limit(0), right, ("ak", "bk"), "av", "bv").count() == 0


def test_as_of_join(spark):
    at = datetime(2024, 1, 1)
    facts = spark.createDataFrame([("a", at + timedelta(seconds=s), s) for s in (0, 5, 10, 20)] + [("b", at, 1), (None, at, 2)], "k string, t timestamp_ntz, n int")
    versions = spark.createDataFrame([("a", at + timedelta(seconds=5), 1.5, False), ("a", at + timedelta(seconds=10), None, True), ("a", at + timedelta(seconds=15), 2.5, False), (None, at, 9.0, False)], "k string, vt timestamp_ntz, rate double, gone boolean")
    found = {(r.k, r.n): r.rate for r in joins.as_of_join(facts, versions, "k", "t", "vt", deleted="gone").collect()}
    assert found == {("a", 0): None, ("a", 5): 1.5, ("a", 10): None, ("a", 20): 2.5, ("b", 1): None, (None, 2): None}


def test_interval_join_bounds_are_inclusive(spark):
    at = datetime(2024, 1, 1)
    left = spark.createDataFrame([(1, at)], "k int, lt timestamp_ntz")
    right = spark.createDataFrame([(1, at + timedelta(minutes=m)) for m in (-1, 0, 5, 6)], "k int, rt timestamp_ntz")
    for bucket in (None, "5 minutes"):
        found = joins.interval_join(left, right, "l.k = r.k", "l.lt", "l.lt + INTERVAL '5' MINUTE", "rt", bucket=bucket)
        assert [r.rt.minute for r in found.orderBy("rt").collect()] == [0, 5]


def test_broadcast_only_when_small(spark):
    left, right = spark.range(100).toDF("k"), spark.range(50).toDF("k")
    assert joins.broadcast_join(left, right, "l.k = r.k", limit_bytes=10).count() == 50
    assert joins.broadcast_join(left, right, "l.k = r.k").count() == 50


def test_aggregate_columns(small):
    assert aggregate.aggregate(small, ["id"], {"id": "id", "n": "COUNT(*)"}).columns == ["id", "n"]
    with pytest.raises(ValueError):
        aggregate.aggregate(small, ["id"], {"id": "id + 1"})
    assert rows(aggregate.aggregate(small, [], {"n": "COUNT(amount)"})) == [(2,)]


def test_session_merges_at_the_gap(spark):
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([("u", at), ("u", at + timedelta(minutes=30)), ("u", at + timedelta(minutes=61)), ("v", at + timedelta(minutes=45))], "k string, ts timestamp_ntz")
    assert sorted(r.n for r in aggregate.session(df, "ts", "30 minutes", ["k"], {"n": "COUNT(*)"}).collect()) == [1, 1, 2]
    # Over all rows the key does not cut sessions.
    found = aggregate.session(df, "ts", "30 minutes", ["k"], {"n": "COUNT(*)"}, scope="global").collect()
    assert sorted((r.k, r.n) for r in found) == [("u", 3), ("v", 1)]


def test_dedup_and_top_n(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, None, "z"), (2, 3, "w")], "k int, t int, v string")
    assert [r.v for r in ranking.deduplicate(df, ["k"], "t").orderBy("k").collect()] == ["x", "z"]
    assert [r.v for r in ranking.deduplicate(df, ["k"], "t", keep="last").orderBy("k").collect()] == ["y", "w"]
    top = ranking.top_n(df, ["k"], {"t": "DESC"}, 1)
    assert dict(top.dtypes)["rownum"] == "bigint" and top.count() == 2
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_union_checks_columns(small):
    with pytest.raises(ValueError):
        relations.union(small, small.drop("name"))
    swapped = small.select("amount", "id", "name")
    assert relations.union(small, swapped).count() == 6


def test_query_needs_group_by_for_having(small):
    with pytest.raises(ValueError):
        relations.query(small, {"id": "id"}, having="id > 1")


def test_raw_sql_checks_output(spark, small):
    assert relations.raw_sql(spark, "SELECT id FROM {t}", {"t": small}, {"id": "BIGINT"}).count() == 3
    with pytest.raises(ValueError):
        relations.raw_sql(spark, "SELECT id FROM {t}", {"t": small}, {"id": "STRING"})


def test_routes_are_independent(small):
    found = routing.route(small, {"big": "amount > 100", "any": "true"}, default="rest")
    assert {k: v.count() for k, v in found.items()} == {"big": 1, "any": 3, "rest": 3}
    assert routing.route(small, {"big": "amount > 100"}, "rest", "unmatched")["rest"].count() == 2


def test_null_condition_is_on_neither_side(small):
    main, side = routing.side_output(small, "amount > 100", tag="big")
    assert (main.count(), side.count()) == (1, 1) and side.first()["_side_tag"] == "big"
    main, side = routing.side_output(small, "amount > 100", null_to_side=True)
    assert (main.count(), side.count()) == (1, 2)


def test_validation_reports_first_failure(small):
    good, bad = routing.validate(small, ["name"], {"amount": (0, 100)}, {"odd": "id % 2 = 1"})
    assert [r.id for r in good.collect()] == [1]
    assert {r.id: r["_validation_error"] for r in bad.collect()} == {2: "notNull:name", 3: "range:amount[0,100]"}
    unknown = small.where("id = 2").select("id", "amount")
    assert sum(df.count() for df in routing.validate(unknown, ranges={"amount": (0, 1)})) == 0
    assert routing.validate(unknown, ranges={"amount": (0, 1)}, null_as_reject=True)[1].count() == 1


@pytest.fixture
def ticks(spark):
    values = [10, 9, 8, 12, 11, 13, 7, 7, 9]
    return spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "k string, t int, v int")


def test_pattern_greedy_and_reluctant(ticks):
    measures = {"n": ("COUNT(*)", "BIGINT"), "first": ("FIRST(A.t)", "INT"), "last": ("LAST(B.t)", "INT")}
    define = {"A": "v >= 8", "B": "v >= 12"}
    assert rows(pattern.match_rows(ticks, ["k"], ["t"], "A+ B", define, measures)) == [("s", 6, 0, 5)]
    assert rows(pattern.match_rows(ticks, ["k"], ["t"], "A+? B", define, measures)) == [("s", 2, 4, 5), ("s", 4, 0, 3)]
    nexts = pattern.match_rows(ticks, ["k"], ["t"], "A B", {"A": "true", "B": "v < PREV(v)"}, measures, after="next_row")
    assert sorted(r["first"] for r in nexts.collect()) == [0, 1, 3, 5]


def test_pattern_relations_and_errors(ticks):
    found = pattern.match_rows(ticks, ["k"], ["t"], "A B{2,} C?", {"B": lambda row, bound: row["v"] < bound["A"][0]["v"], "C": "v > 12"}, {"a": ("A.v", "INT"), "n": ("COUNT(B.*)", "BIGINT"), "c": ("LAST(C.v)", "INT")})
    assert rows(found) == [("s", 10, 2, None), ("s", 13, 3, None)]
    with pytest.raises(ValueError):
        pattern.match_rows(ticks, ["k"], ["t"], "(A|B)", {"B": lambda row, bound: True}, {"n": ("COUNT(*)", "BIGINT")})
    grouped = pattern.match_rows(ticks, ["k"], ["t"], "(A B)+", {"A": "v % 2 = 1", "B": "v % 2 = 0"}, {"n": ("COUNT(*)", "BIGINT")})
    assert rows(grouped) == [("s", 2)]


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "k string, ts timestamp_ntz, v double")
    assert aggregate.tumble(df, "ts", "1 hour", ["k"], {"n": "COUNT(*)"}).count() == 0
    assert ranking.top_n(df, ["k"], {"v": "DESC"}, 3).count() == 0
    assert joins.as_of_join(df, df.select("k", F.col("ts").alias("vt")), "k", "ts", "vt").count() == 0
    assert pattern.match_rows(df, ["k"], ["ts"], "A", {}, {"n": ("COUNT(*)", "BIGINT")}).count() == 0


def test_pattern_conditions_between_variables(spark):
    """The fraud example: places that change after a large amount, matched by windows and by the matcher."""
    data = [(1, 1, 2000, "x"), (1, 2, 10, "y"), (1, 3, 20, "z"), (1, 4, 600, "x"), (1, 5, 700, "q"), (1, 6, 5, "q"), (2, 1, 3000, "x"), (2, 2, None, "y"), (2, 3, 900, "x")]
    df = spark.createDataFrame(data, "card int, t int, amount int, place string")
    define = {"A": "A.amount > 1000", "B": "B.place <> A.place", "C": "C.amount > 500 AND C.place <> B.place"}
    measures = {"first": ("A.t", "INT"), "last": ("C.t", "INT"), "total": ("A.amount + SUM(B.amount) + C.amount", "BIGINT"), "n": ("COUNT(B.t) + 2", "BIGINT"), "gap": ("LAST(C.amount) - FIRST(A.amount)", "INT")}
    found = pattern.match_rows(df, ["card"], ["t"], "A B+ C", define, measures, after="next_row")
    assert rows(found) == [(1, 1, 4, 2630, 4, -1400), (2, 1, 3, None, 3, -2100)]
    fixed = pattern.match_rows(df, ["card"], ["t"], "A B{2} C", define, measures)
    assert rows(fixed) == [(1, 1, 4, 2630, 4, -1400)]
    summed = pattern.match_rows(df, ["card"], ["t"], "A B* C", {"A": "true", "B": "SUM(B.amount) <= 30 AND NOT B.place IS NULL", "C": "amount >= 600"}, {"a": ("A.t", "INT"), "n": ("COUNT(B.*)", "BIGINT")})
    assert rows(summed) == [(1, 1, 2), (2, 2, 0)]
    with pytest.raises(ValueError):
        pattern.match_rows(df, ["card"], ["t"], "A B+", {"B": "B.place LIKE A.place"}, {"n": ("COUNT(*)", "BIGINT")})


def test_pattern_windows_match_as_the_matcher(spark):
    """Window plans against the matcher, which a function as condition calls for."""
    import random

    random.seed(3)
    df = spark.createDataFrame([(k, t, random.randint(0, 3) or None) for k in range(8) for t in range(40)], "k int, t int, v int")
    measures = {"a": ("FIRST(t)", "INT"), "z": ("LAST(t)", "INT"), "s": ("SUM(v)", "BIGINT"), "m": ("MAX(v)", "INT"), "c": ("COUNT(v)", "BIGINT"), "g": ("AVG(v)", "DOUBLE")}
    define = {"A": "v >= 1", "B": "v >= 2"}
    slow = {"A": lambda row, _: (row["v"] or 0) >= 1, "B": lambda row, _: (row["v"] or 0) >= 2}
    for shape in ("A B A", "A{2} B", "A A", "A{2,}", "A{2,3}", "A{3,}?", "A+", "A?", "A{0,2}"):
        for after in ("past_last", "next_row"):
            fast = pattern.match_rows(df, ["k"], ["t"], shape, define, measures, after)
            assert rows(fast) == rows(pattern.match_rows(df, ["k"], ["t"], shape, slow, measures, after)), (shape, after)
    plan = pattern.match_rows(df, ["k"], ["t"], "A B A", define, measures)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and plan.count("Exchange") == 1


def test_branches_of_one_pass(spark, tmp_path):
    """Routes and validations give the same rows as plain ones, and the input is computed once."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame([(k, None if k % 7 == 0 else k % 5, "x") for k in range(200)], "id int, v int, __route string").repartition(3)
    counted = df.mapInArrow(count, df.schema)
    branches = {"low": "v < 2", "a/b=c": "v > 3 OR id < 10", "none": "v > 100"}
    for mode in ("all", "unmatched"):
        seen.value = 0
        once = routing.route_once(counted, branches, str(tmp_path / mode), "rest", mode)
        plain = routing.route(df, branches, "rest", mode)
        assert {n: rows(d) for n, d in once.items()} == {n: rows(d) for n, d in plain.items()} and seen.value == 200
        assert once["low"].columns == df.columns
    checks = {"not_null": ["v"], "ranges": {"v": (1, 4)}, "expressions": {"odd": "id % 2 = 1"}}
    for null_as_reject in (False, True):
        seen.value = 0
        good, bad = routing.validate_once(counted, str(tmp_path / f"v{null_as_reject}"), null_as_reject, **checks)
        plain_good, plain_bad = routing.validate(df, null_as_reject=null_as_reject, **checks)
        assert rows(good) == rows(plain_good) and rows(bad.drop("_validated_at")) == rows(plain_bad.drop("_validated_at")) and seen.value == 200


def test_as_of_buckets_spread_a_hot_key(spark):
    """The same rows with and without buckets; one key with all rows is dealt over many tasks."""
    import random
    from datetime import datetime, timedelta

    rnd, start = random.Random(4), datetime(2024, 1, 1)

    def table(n, name, keys):
        rows = [(rnd.choice(keys), None if k % 50 == 7 else start + timedelta(minutes=rnd.randrange(20_000), seconds=k % 60, microseconds=k), k, rnd.random() < 0.2) for k in range(n)]
        return spark.createDataFrame(rows, f"k string, {name} timestamp, {name}_n int, {name}_gone boolean")

    facts, versions = table(600, "t", ["a", "b", None, "c"]), table(80, "vt", ["a", "b", None, "d"])
    for deleted in (None, "vt_gone"):
        plain = joins.as_of_join(facts, versions, "k", "t", "vt", deleted=deleted)
        for bucket in ("1 hour", "3 days", "400 days"):
            spread = joins.as_of_join(facts, versions, "k", "t", "vt", deleted=deleted, bucket=bucket)
            assert spread.columns == plain.columns and sorted(map(repr, rows(spread))) == sorted(map(repr, rows(plain)))
    hot = facts.withColumn("k", F.lit("a")).where("t IS NOT NULL")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = [len({r.p for r in joins.as_of_join(hot, versions, "k", "t", "vt", bucket=b).withColumn("p", F.spark_partition_id()).collect()}) for b in (None, "1 hour")]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks[0] == 1 and tasks[1] == 4


def test_join_conditions_are_split_at_the_top_only(spark):
    assert joins.conjuncts("l.a = r.a AND l.t BETWEEN r.lo AND hi AND (x = 1 AND y = 2)") == ["l.a = r.a ", " l.t BETWEEN r.lo AND hi ", " (x = 1 AND y = 2)"]
    assert joins.conjuncts("a = ' AND ' AND CASE WHEN p AND q THEN 1 END = 1 and b") == ["a = ' AND ' ", " CASE WHEN p AND q THEN 1 END = 1 ", " b"]
    left = spark.createDataFrame([(1, 5), (1, 50), (2, 5)], "k int, t int")
    right = spark.createDataFrame([(1, 0, 9), (2, 6, 9)], "k int, lo int, hi int")
    assert rows(joins.join(left, right, "l.k = r.k AND l.t BETWEEN r.lo AND hi")) == [(1, 5, 1, 0, 9)]


def test_broadcast_join_goes_by_size(spark, sf_dir):
    orders, customer = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "customer"))
    for limit, hinted in ((64 << 20, True), (10, False)):
        df = joins.broadcast_join(orders, customer, "l.o_custkey = r.c_custkey", limit_bytes=limit)
        assert ("rightHint=(strategy=broadcast)" in df._jdf.queryExecution().analyzed().toString() or "strategy=broadcast" in df._jdf.queryExecution().optimizedPlan().toString()) == hinted
