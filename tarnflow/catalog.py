"""Registry of queries over the operators and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.operators import aggregate, cdc, joins, pattern, project, ranking, relations, routing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    """Register the function under its name, with the SQL of the same rows."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def _read(spark: SparkSession, sf_dir: str, *names: str):
    found = [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]
    return found[0] if len(found) == 1 else found


# Projection, filter and edits of fields


@_query("""
SELECT user_id, count(*) AS n_events, round(sum(value), 4) AS total_value,
       time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end
FROM events WHERE value > 0 GROUP BY user_id, time_bucket(INTERVAL '1 hour', ts)
""")
def flagship_hourly_activity(spark, sf_dir):
    events = project.filter_rows(_read(spark, sf_dir, "events"), "value > 0")
    return aggregate.tumble(events, "ts", "1 hour", ["user_id"], {"n_events": "COUNT(*)", "total_value": "ROUND(SUM(value), 4)"})


@_query("SELECT * FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'F'")
def filter_orders(spark, sf_dir):
    return project.filter_rows(_read(spark, sf_dir, "orders"), "o_totalprice > 100000 AND o_orderstatus <> 'F'")


@_query("SELECT o_orderkey AS id, upper(o_orderpriority) AS priority, o_totalprice * 2 AS gross, CASE WHEN o_totalprice > 100000 THEN 'large' ELSE 'small' END AS size FROM orders")
def map_orders(spark, sf_dir):
    return project.map_columns(
        _read(spark, sf_dir, "orders"),
        {"id": "o_orderkey", "priority": "UPPER(o_orderpriority)", "gross": "o_totalprice * 2", "size": "CASE WHEN o_totalprice > 100000 THEN 'large' ELSE 'small' END"},
    )


@_query("SELECT vec_id, label, unnest(embedding) AS component FROM embeddings")
def flatmap_array(spark, sf_dir):
    return project.flat_map(_read(spark, sf_dir, "embeddings"), "embedding", {"component": "FLOAT"}).drop("embedding")


@_query("SELECT l_orderkey AS order_id, l_linenumber AS line, l_quantity AS quantity FROM lineitem")
def flatmap_rows(spark, sf_dir):
    items = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("items"))
    opened = project.flat_map(items, "items", {"line": "INT", "quantity": "DOUBLE"})
    return opened.select(F.col("l_orderkey").alias("order_id"), "line", "quantity")


@_query("SELECT event_id, 'type' AS k, event_type AS v FROM events UNION ALL SELECT event_id, 'user' AS k, user_id::VARCHAR AS v FROM events")
def flatmap_map(spark, sf_dir):
    events = _read(spark, sf_dir, "events").select("event_id", F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string")).alias("tags"))
    return project.flat_map(events, "tags", {"k": "STRING", "v": "STRING"}).drop("tags")


@_query("SELECT event_id AS id, ts AS at, user_id, event_type AS kind, value, props FROM events")
def rename_fields(spark, sf_dir):
    return project.rename(_read(spark, sf_dir, "events"), {"event_id": "id", "ts": "at", "event_type": "kind"})


@_query("SELECT event_id, user_id, event_type FROM events")
def drop_fields(spark, sf_dir):
    return project.drop(_read(spark, sf_dir, "events"), ["ts", "value", "props"])


@_query("SELECT event_id::VARCHAR AS event_id, ts, user_id::INTEGER AS user_id, TRY_CAST(event_type AS BIGINT) AS event_type, value, props FROM events")
def cast_safe(spark, sf_dir):
    return project.cast(_read(spark, sf_dir, "events"), {"event_id": "STRING", "user_id": "INT", "event_type": "BIGINT"}, safe=True)


@_query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice::DECIMAL(15,2) AS o_totalprice, o_orderdate::DATE AS o_orderdate, o_orderpriority FROM orders")
def cast_strict(spark, sf_dir):
    return project.cast(_read(spark, sf_dir, "orders"), {"o_totalprice": "DECIMAL(15, 2)", "o_orderdate": "DATE"})


@_query("SELECT event_id, coalesce(CASE WHEN event_type <> 'error' THEN event_type END, concat('user-', user_id)) AS label FROM events")
def coalesce_defaults(spark, sf_dir):
    events = project.map_columns(_read(spark, sf_dir, "events"), {"event_id": "event_id", "label": "CASE WHEN event_type <> 'error' THEN event_type END", "user_id": "user_id"})
    return project.drop(project.coalesce(events, {"label": "CONCAT('user-', user_id)"}), ["user_id"])


@_query("SELECT *, l_extendedprice * (1 - l_discount) AS net, extract(year FROM l_shipdate)::BIGINT AS ship_year FROM lineitem")
def add_fields(spark, sf_dir):
    return project.add_field(_read(spark, sf_dir, "lineitem"), {"net": "l_extendedprice * (1 - l_discount)", "ship_year": "YEAR(l_shipdate)"}, {"ship_year": "BIGINT"})


@_query("SELECT event_id, json_extract_string(props, '$.k') AS k, char_length(event_type)::INTEGER AS n, replace(event_type, 'e', 'E') AS replaced, substr(event_type, 2, 3) AS part, coalesce(nullif(event_type, 'view'), '-') AS other, abs(value) AS a, round(power(value, 2), 4) AS squared, floor(value)::BIGINT AS whole, (user_id % 7)::BIGINT AS rest FROM events")
def scalar_functions(spark, sf_dir):
    return project.map_columns(
        _read(spark, sf_dir, "events"),
        {
            "event_id": "event_id", "k": "get_json_object(props, '$.k')", "n": "CHAR_LENGTH(event_type)", "replaced": "REPLACE(event_type, 'e', 'E')", "part": "SUBSTRING(event_type, 2, 3)",
            "other": "IFNULL(NULLIF(event_type, 'view'), '-')", "a": "ABS(value)", "squared": "ROUND(POWER(value, 2), 4)", "whole": "FLOOR(value)", "rest": "MOD(user_id, 7)",
        },
    )


@_query("SELECT event_id, extract(year FROM ts)::BIGINT AS y, extract(hour FROM ts)::BIGINT AS h, strftime(ts, '%Y-%m-%d %H:%M') AS minute, date_sub('second', TIMESTAMP '2020-01-01', ts)::BIGINT AS seconds, ts + INTERVAL 7 DAY AS later FROM events")
def time_functions(spark, sf_dir):
    return project.map_columns(
        _read(spark, sf_dir, "events"),
        {"event_id": "event_id", "y": "CAST(YEAR(ts) AS BIGINT)", "h": "CAST(EXTRACT(HOUR FROM ts) AS BIGINT)", "minute": "DATE_FORMAT(ts, 'yyyy-MM-dd HH:mm')", "seconds": "TIMESTAMPDIFF(SECOND, TIMESTAMP_NTZ '2020-01-01 00:00:00', ts)", "later": "ts + INTERVAL '7' DAY"},
    )


# Aggregation


@_query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount, count(*) AS n, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY ALL")
def aggregate_group(spark, sf_dir):
    return aggregate.aggregate(
        _read(spark, sf_dir, "lineitem"),
        ["l_returnflag", "l_linestatus"],
        {"sum_qty": "ROUND(SUM(l_quantity), 2)", "revenue": "ROUND(SUM(l_extendedprice * (1 - l_discount)), 2)", "avg_discount": "ROUND(AVG(l_discount), 6)", "n": "COUNT(*)", "first_ship": "MIN(l_shipdate)", "last_ship": "MAX(l_shipdate)"},
    )


@_query("SELECT count(*) AS n, round(sum(value), 3) AS total FROM events")
def aggregate_global(spark, sf_dir):
    return aggregate.aggregate(_read(spark, sf_dir, "events"), [], {"n": "COUNT(*)", "total": "ROUND(SUM(value), 3)"})


@_query("SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT date_trunc('day', ts)) AS days FROM events GROUP BY event_type")
def aggregate_distinct(spark, sf_dir):
    return aggregate.aggregate(_read(spark, sf_dir, "events"), ["event_type"], {"users": "COUNT(DISTINCT user_id)", "days": "COUNT(DISTINCT date_trunc('day', ts))"})


@_query("SELECT user_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::BIGINT AS purchases, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 3) AS spent FROM events GROUP BY user_id")
def aggregate_case_sum(spark, sf_dir):
    return aggregate.aggregate(_read(spark, sf_dir, "events"), ["user_id"], {"purchases": "SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)", "spent": "ROUND(SUM(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 3)"})


@_query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 5")
def aggregate_having(spark, sf_dir):
    return aggregate.aggregate(_read(spark, sf_dir, "events"), ["user_id"], {"n": "COUNT(*)"}, having="n > 5")


@_query("SELECT event_type, round(stddev_pop(value), 5) AS sp, round(stddev_samp(value), 5) AS ss, round(var_pop(value), 3) AS vp, round(var_samp(value), 3) AS vs FROM events GROUP BY event_type")
def aggregate_deviation(spark, sf_dir):
    return aggregate.aggregate(_read(spark, sf_dir, "events"), ["event_type"], {"sp": "ROUND(STDDEV_POP(value), 5)", "ss": "ROUND(STDDEV_SAMP(value), 5)", "vp": "ROUND(VAR_POP(value), 3)", "vs": "ROUND(VAR_SAMP(value), 3)"})


@_query("SELECT user_id, string_agg(event_type, ',' ORDER BY ts) AS path FROM events GROUP BY user_id")
def aggregate_listagg(spark, sf_dir):
    return aggregate.aggregate(_read(spark, sf_dir, "events"), ["user_id"], {"path": "LISTAGG(event_type)"}, order="ts")


@_query("SELECT user_id, arg_min(event_type, ts) AS first_type, arg_max(value, ts) AS last_value FROM events GROUP BY user_id")
def aggregate_first_last(spark, sf_dir):
    return aggregate.aggregate(_read(spark, sf_dir, "events"), ["user_id"], {"first_type": "FIRST_VALUE(event_type)", "last_value": "LAST_VALUE(value)"}, order="ts")


@_query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def grouping_cube(spark, sf_dir):
    return aggregate.grouping(_read(spark, sf_dir, "lineitem"), "cube", ["l_returnflag", "l_linestatus"], {"n": "COUNT(*)"})


@_query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def grouping_rollup(spark, sf_dir):
    return aggregate.grouping(_read(spark, sf_dir, "lineitem"), "rollup", ["l_returnflag", "l_linestatus"], {"n": "COUNT(*)"})


@_query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))")
def grouping_sets(spark, sf_dir):
    return aggregate.grouping(_read(spark, sf_dir, "lineitem"), "sets", ["l_returnflag", "l_linestatus"], {"n": "COUNT(*)"}, [["l_returnflag"], ["l_linestatus"]])


# Time windows


@_query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end FROM events GROUP BY event_type, time_bucket(INTERVAL '1 hour', ts)")
def window_tumble(spark, sf_dir):
    return aggregate.tumble(_read(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], {"n": "COUNT(*)", "users": "COUNT(DISTINCT user_id)"})


@_query("SELECT event_type, arg_min(value, ts) AS o, max(value) AS h, min(value) AS l, arg_max(value, ts) AS c, time_bucket(INTERVAL '1 day', ts) AS window_start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS window_end FROM events GROUP BY event_type, time_bucket(INTERVAL '1 day', ts)")
def window_ohlc(spark, sf_dir):
    return aggregate.tumble(_read(spark, sf_dir, "events"), "ts", "1 day", ["event_type"], {"o": "FIRST_VALUE(value)", "h": "MAX(value)", "l": "MIN(value)", "c": "LAST_VALUE(value)"})


@_query("""
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, w AS window_start, w + INTERVAL '1 hour' AS window_end
FROM (SELECT *, unnest([time_bucket(INTERVAL '15 minutes', ts) - INTERVAL '15 minutes' * k FOR k IN range(4)]) AS w FROM events) GROUP BY event_type, w
""")
def window_slide(spark, sf_dir):
    return aggregate.slide(_read(spark, sf_dir, "events"), "ts", "1 hour", "15 minutes", ["event_type"], {"n": "COUNT(*)", "mean": "ROUND(AVG(value), 6)"})


_ISLANDS = """
WITH marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY {key} ORDER BY ts) <= INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events),
cut AS (SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY ts) AS island FROM marked)
"""


@_query(_ISLANDS.format(key="user_id") + "SELECT user_id, count(*) AS n, string_agg(event_type, ',' ORDER BY ts) AS path, min(ts) AS window_start, max(ts) + INTERVAL '30 minutes' AS window_end FROM cut GROUP BY user_id, island")
def window_session(spark, sf_dir):
    return aggregate.session(_read(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"], {"n": "COUNT(*)", "path": "LISTAGG(event_type)"})


@_query(_ISLANDS.format(key="1").replace("30 minutes", "2 minutes") + "SELECT event_type, count(*) AS n, min(lo) AS window_start, min(hi) + INTERVAL '2 minutes' AS window_end FROM (SELECT *, min(ts) OVER (PARTITION BY island) AS lo, max(ts) OVER (PARTITION BY island) AS hi FROM cut) GROUP BY event_type, island")
def window_session_global(spark, sf_dir):
    return aggregate.session(_read(spark, sf_dir, "events"), "ts", "2 minutes", ["event_type"], {"n": "COUNT(*)"}, scope="global")


@_query("SELECT event_id, ts, time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end FROM events")
def window_passthrough(spark, sf_dir):
    return aggregate.tumble_windows(_read(spark, sf_dir, "events").select("event_id", "ts"), "ts", "1 hour")


@_query(_ISLANDS.format(key="user_id") + "SELECT event_id, ts, user_id, min(ts) OVER (PARTITION BY user_id, island) AS window_start, max(ts) OVER (PARTITION BY user_id, island) + INTERVAL '30 minutes' AS window_end FROM cut")
def window_session_passthrough(spark, sf_dir):
    return aggregate.session_windows(_read(spark, sf_dir, "events").select("event_id", "ts", "user_id"), "ts", "30 minutes", ["user_id"])


@_query("""
SELECT count(*) AS n, b AS window_start, b + INTERVAL '6 hours' * k AS window_end
FROM (SELECT time_bucket(INTERVAL '1 day', ts) AS b, unnest(range((date_sub('hour', time_bucket(INTERVAL '1 day', ts), ts) // 6 + 1)::BIGINT, 5)) AS k FROM events) GROUP BY b, k
""")
def window_cumulate(spark, sf_dir):
    return aggregate.cumulate(_read(spark, sf_dir, "events"), "ts", "1 day", "6 hours", [], {"n": "COUNT(*)"})


@_query("""
WITH sales AS (SELECT l_partkey, sum(l_quantity) AS quantity, time_bucket(INTERVAL '1 day', l_shipdate) AS window_start, time_bucket(INTERVAL '1 day', l_shipdate) + INTERVAL '1 day' AS window_end FROM lineitem GROUP BY 1, 3, 4)
SELECT l_partkey, quantity, window_start, window_end, row_number() OVER (PARTITION BY window_start ORDER BY quantity DESC, l_partkey)::BIGINT AS rownum FROM sales QUALIFY rownum <= 3
""")
def window_top_n(spark, sf_dir):
    sales = aggregate.tumble(_read(spark, sf_dir, "lineitem"), "l_shipdate", "1 day", ["l_partkey"], {"quantity": "SUM(l_quantity)"})
    return ranking.top_n(sales, ["window_start"], {"quantity": "DESC", "l_partkey": "ASC"}, 3)


@_query("""
WITH d AS (SELECT * FROM (SELECT * FROM events UNION ALL SELECT * FROM events) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1)
SELECT event_type, count(*) AS n, time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end FROM d GROUP BY 1, 3, 4
""")
def window_after_dedup(spark, sf_dir):
    events = _read(spark, sf_dir, "events")
    return aggregate.tumble(ranking.deduplicate(relations.union(events, events), ["event_id"], "ts"), "ts", "1 hour", ["event_type"], {"n": "COUNT(*)"})


@_query("""
WITH h AS (SELECT event_type, count(*) AS n, time_bucket(INTERVAL '1 hour', ts) AS w FROM events GROUP BY 1, 3)
SELECT event_type, max(n) AS busiest, time_bucket(INTERVAL '1 day', w) AS window_start, time_bucket(INTERVAL '1 day', w) + INTERVAL '1 day' AS window_end FROM h GROUP BY 1, 3, 4
""")
def window_chained(spark, sf_dir):
    hours = aggregate.tumble(_read(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], {"n": "COUNT(*)"})
    return aggregate.tumble(hours.select("event_type", "n", F.col("window_start").alias("w")), "w", "1 day", ["event_type"], {"busiest": "MAX(n)"})


# Ranking and analytic functions


@_query("SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id)::BIGINT AS rownum FROM events QUALIFY rownum = 1")
def dedup_first(spark, sf_dir):
    return ranking.deduplicate(_read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"])


@_query("SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC)::BIGINT AS rownum FROM events QUALIFY rownum = 1")
def dedup_last(spark, sf_dir):
    return ranking.deduplicate(_read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], ["ts", "event_id"], keep="last")


@_query("SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC NULLS LAST, event_id)::BIGINT AS rownum FROM events QUALIFY rownum <= 10")
def top_n_rows(spark, sf_dir):
    return ranking.top_n(_read(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_type"], {"value": "DESC", "event_id": "ASC"}, 10)


@_query("SELECT event_id, user_id, value FROM events QUALIFY rank() OVER (PARTITION BY user_id ORDER BY value DESC) <= 2")
def qualify_rank(spark, sf_dir):
    events = _read(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return ranking.qualify(events, "place <= 2", {"place": "RANK() OVER w"}, {"w": "PARTITION BY user_id ORDER BY value DESC"})


@_query("SELECT event_id, user_id, lag(value) OVER w AS before, lead(event_type) OVER w AS next_type, dense_rank() OVER (PARTITION BY event_type ORDER BY user_id)::INTEGER AS place, first_value(event_type) OVER w AS opened, round(sum(value) OVER w, 4) AS running FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def window_functions(spark, sf_dir):
    events = _read(spark, sf_dir, "events")
    found = ranking.window_columns(
        events,
        {"before": "LAG(value) OVER w", "next_type": "LEAD(event_type) OVER w", "place": "DENSE_RANK() OVER (PARTITION BY event_type ORDER BY user_id)", "opened": "FIRST_VALUE(event_type) OVER w", "running": "ROUND(SUM(value) OVER w, 4)"},
        {"w": "PARTITION BY user_id ORDER BY ts, event_id"},
    )
    return found.select("event_id", "user_id", "before", "next_type", "place", "opened", "running")


@_query("SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving FROM events")
def window_frames(spark, sf_dir):
    found = ranking.window_columns(_read(spark, sf_dir, "events"), {"moving": "ROUND(AVG(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6)"})
    return found.select("event_id", "user_id", "moving")


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def sort_limit_offset(spark, sf_dir):
    return ranking.sort_limit(_read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), {"o_totalprice": "DESC", "o_orderkey": "ASC"}, 20, 5)


# Set operations, query blocks, SQL, functions, views


@_query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('click', 'view', 'purchase')")
def union_streams(spark, sf_dir):
    events = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return relations.union(*[events.where(F.col("event_type") == t) for t in ("click", "view", "purchase")])


@_query("SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id")
def union_aggregate(spark, sf_dir):
    events = _read(spark, sf_dir, "events").select("user_id", "event_type")
    return aggregate.aggregate(relations.union(events.where("event_type = 'click'"), events.where("event_type = 'view'")), ["user_id"], {"n": "COUNT(*)"})


@_query("SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def set_intersect(spark, sf_dir):
    events = _read(spark, sf_dir, "events")
    return relations.set_operation(events.where("event_type = 'purchase'").select("user_id"), events.where("event_type = 'error'").select("user_id"), "intersect")


@_query("SELECT user_id FROM events WHERE event_type = 'purchase' EXCEPT ALL SELECT user_id FROM events WHERE event_type = 'error'")
def set_except_all(spark, sf_dir):
    events = _read(spark, sf_dir, "events")
    return relations.set_operation(events.where("event_type = 'purchase'").select("user_id"), events.where("event_type = 'error'").select("user_id"), "except_all")


@_query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderpriority HAVING count(*) > 10")
def query_block(spark, sf_dir):
    return relations.query(
        _read(spark, sf_dir, "orders"),
        {"o_orderpriority": "o_orderpriority", "n": "COUNT(*)", "total": "ROUND(SUM(o_totalprice), 2)"},
        where="o_totalprice > 1000", group_by=["o_orderpriority"], having="n > 10", order_by={"total": "DESC"},
    )


@_query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS nth, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS change FROM orders")
def query_named_window(spark, sf_dir):
    return relations.query(
        _read(spark, sf_dir, "orders"),
        {"o_orderkey": "o_orderkey", "nth": "ROW_NUMBER() OVER w", "change": "ROUND(o_totalprice - LAG(o_totalprice) OVER w, 2)"},
        windows={"w": "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"},
    )


@_query("SELECT n_name, count(*)::BIGINT AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def raw_sql(spark, sf_dir):
    customer, nation = _read(spark, sf_dir, "customer", "nation")
    return relations.raw_sql(
        spark, "SELECT n_name, count(*) AS customers FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name",
        {"customer": customer, "nation": nation}, {"n_name": "STRING", "customers": "BIGINT"},
    )


@_query("SELECT r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def named_view(spark, sf_dir):
    nation, region = _read(spark, sf_dir, "nation", "region")
    relations.view(joins.join(nation, region, "l.n_regionkey = r.r_regionkey"), "tarnflow_nations")
    return aggregate.aggregate(spark.table("tarnflow_nations"), ["r_name"], {"nations": "COUNT(*)"})


@_query("SELECT event_id, round(value * 2 + 1, 6) AS scaled FROM events")
def user_function(spark, sf_dir):
    relations.register_function(spark, "tarnflow_scale", F.udf(lambda value: value * 2 + 1, "double", useArrow=True))
    return project.map_columns(_read(spark, sf_dir, "events"), {"event_id": "event_id", "scaled": "ROUND(tarnflow_scale(value), 6)"})


# Joins

_ORDERS = ("o_orderkey", "o_custkey", "o_totalprice")
_CUSTOMERS = ("c_custkey", "c_name")


def _orders_customers(spark, sf_dir):
    orders, customer = _read(spark, sf_dir, "orders", "customer")
    return orders.select(*_ORDERS), customer.select(*_CUSTOMERS)


def _join_query(how: str):
    def run(spark, sf_dir):
        orders, customer = _orders_customers(spark, sf_dir)
        return joins.join(orders, customer, "l.o_custkey = r.c_custkey AND l.o_totalprice > 100000", how)

    run.__name__ = f"join_{how}"
    _query(f"SELECT o_orderkey, o_custkey, o_totalprice, c_custkey, c_name FROM orders {how} JOIN customer ON o_custkey = c_custkey AND o_totalprice > 100000")(run)


for _how in ("inner", "left", "right", "full"):
    _join_query(_how)


@_query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_semi(spark, sf_dir):
    orders, customer = _orders_customers(spark, sf_dir)
    return joins.join(customer, orders.where("o_totalprice > 200000"), "l.c_custkey = r.o_custkey", "semi")


@_query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_anti(spark, sf_dir):
    orders, customer = _orders_customers(spark, sf_dir)
    return joins.join(customer, orders.where("o_totalprice > 200000"), "l.c_custkey = r.o_custkey", "anti")


@_query("SELECT a.k AS k, a.u AS u, b.v AS v FROM (SELECT user_id AS k, count(*) AS u FROM events WHERE event_type = 'click' GROUP BY 1) a FULL JOIN (SELECT user_id AS k, count(*) AS v FROM events WHERE event_type = 'error' GROUP BY 1) b ON a.k = b.k")
def join_shared_key(spark, sf_dir):
    events = _read(spark, sf_dir, "events").withColumnRenamed("user_id", "k")
    clicks = aggregate.aggregate(events.where("event_type = 'click'"), ["k"], {"u": "COUNT(*)"})
    errors = aggregate.aggregate(events.where("event_type = 'error'"), ["k"], {"v": "COUNT(*)"})
    return joins.join(clicks, errors, "l.k = r.k", "full")


@_query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_acctbal > c_acctbal + 9000")
def join_theta(spark, sf_dir):
    supplier, customer = _read(spark, sf_dir, "supplier", "customer")
    supplier, customer = supplier.select("s_suppkey", "s_nationkey", "s_acctbal"), customer.select("c_custkey", "c_nationkey", "c_acctbal")
    return joins.inequality_join(supplier, customer, ("s_nationkey", "c_nationkey"), "s_acctbal", "c_acctbal + 9000").select("s_suppkey", "c_custkey")


@_query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def join_broadcast(spark, sf_dir):
    customer, nation = _read(spark, sf_dir, "customer", "nation")
    return joins.broadcast_join(customer, nation, "l.c_nationkey = r.n_nationkey", "left").select("c_custkey", "n_name")


@_query("SELECT o_orderkey, r_name, round(o_totalprice, 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_multi(spark, sf_dir):
    orders, customer, nation, region = _read(spark, sf_dir, "orders", "customer", "nation", "region")
    enriched = joins.join(orders, customer, "l.o_custkey = r.c_custkey")
    enriched = joins.join(joins.join(enriched, nation, "l.c_nationkey = r.n_nationkey"), region, "l.n_regionkey = r.r_regionkey")
    return project.map_columns(enriched, {"o_orderkey": "o_orderkey", "r_name": "r_name", "total": "ROUND(o_totalprice, 2)"})


@_query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def join_lookup(spark, sf_dir):
    orders, customer = _orders_customers(spark, sf_dir)
    return joins.lookup_join(orders, customer, "o_custkey = c_custkey", {"o_orderkey": "l.o_orderkey", "c_name": "r.c_name"})


_PURCHASES = "SELECT event_id AS p_id, user_id, ts AS p_ts FROM events WHERE event_type = 'purchase'"
_CLICKS = "SELECT event_id AS c_id, user_id, ts AS c_ts FROM events WHERE event_type = 'click'"


def _purchases_clicks(spark, sf_dir):
    events = _read(spark, sf_dir, "events")
    purchases = events.where("event_type = 'purchase'").select(F.col("event_id").alias("p_id"), "user_id", F.col("ts").alias("p_ts"))
    return purchases, events.where("event_type = 'click'").select(F.col("event_id").alias("c_id"), "user_id", F.col("ts").alias("c_ts"))


@_query(f"SELECT p_id, p.user_id, p_ts, c_id, c_ts FROM ({_PURCHASES}) p JOIN ({_CLICKS}) c ON p.user_id = c.user_id AND c_ts BETWEEN p_ts - INTERVAL '6 hours' AND p_ts")
def interval_inner(spark, sf_dir):
    purchases, clicks = _purchases_clicks(spark, sf_dir)
    return joins.interval_join(purchases, clicks, "l.user_id = r.user_id", "l.p_ts - INTERVAL '6' HOUR", "l.p_ts", "c_ts")


@_query(f"SELECT p_id, p.user_id, p_ts, c_id, c_ts FROM ({_PURCHASES}) p LEFT JOIN ({_CLICKS}) c ON p.user_id = c.user_id AND c_ts BETWEEN p_ts - INTERVAL '6 hours' AND p_ts")
def interval_left(spark, sf_dir):
    purchases, clicks = _purchases_clicks(spark, sf_dir)
    return joins.interval_join(purchases, clicks, "l.user_id = r.user_id", "l.p_ts - INTERVAL '6' HOUR", "l.p_ts", "c_ts", "left")


@_query(f"SELECT p_id, p.user_id, p_ts, c_id, c_ts FROM ({_PURCHASES}) p FULL JOIN ({_CLICKS}) c ON p.user_id = c.user_id AND c_ts BETWEEN p_ts - INTERVAL '6 hours' AND p_ts")
def interval_full(spark, sf_dir):
    purchases, clicks = _purchases_clicks(spark, sf_dir)
    return joins.interval_join(purchases, clicks, "l.user_id = r.user_id", "l.p_ts - INTERVAL '6' HOUR", "l.p_ts", "c_ts", "full")


@_query(f"SELECT p_id, p.user_id, p_ts, c_id, c_ts FROM ({_PURCHASES}) p JOIN ({_CLICKS}) c ON p.user_id = c.user_id AND c_ts BETWEEN p_ts - INTERVAL '6 hours' AND p_ts")
def interval_bucketed(spark, sf_dir):
    purchases, clicks = _purchases_clicks(spark, sf_dir)
    return joins.interval_join(purchases, clicks, "l.user_id = r.user_id", "l.p_ts - INTERVAL '6' HOUR", "l.p_ts", "c_ts", bucket="6 hours")


@_query(f"SELECT p_id, p.user_id, p_ts, c_id, c_ts FROM ({_PURCHASES}) p ASOF LEFT JOIN ({_CLICKS}) c ON p.user_id = c.user_id AND p_ts >= c_ts")
def as_of(spark, sf_dir):
    purchases, clicks = _purchases_clicks(spark, sf_dir)
    return joins.as_of_join(purchases, clicks, "user_id", "p_ts", "c_ts")


@_query(f"SELECT p_id, p.user_id, p_ts, c_id, c_ts FROM ({_PURCHASES}) p ASOF LEFT JOIN ({_CLICKS}) c ON p.user_id = c.user_id AND p_ts >= c_ts")
def as_of_spread(spark, sf_dir):
    """A hot key dealt by stretches of time; the last version of each is carried over."""
    purchases, clicks = _purchases_clicks(spark, sf_dir)
    return joins.as_of_join(purchases, clicks, "user_id", "p_ts", "c_ts", bucket="12 hours")


@_query(r"SELECT doc_id, unnest(string_split(text, ' ')) AS token FROM documents")
def lateral_function(spark, sf_dir):
    from pyspark.sql.functions import udtf

    class Tokens:
        def eval(self, text: str):
            for token in text.split(" ") if text is not None else ():
                yield (token,)

    relations.register_function(spark, "tarnflow_tokens", udtf(Tokens, returnType="token string", useArrow=True))
    documents = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return joins.lateral_join(documents, "tarnflow_tokens", ["l.text"], {"token": "STRING"}).select("doc_id", "token")


# Routing and validation


@_query("""
SELECT 'high' AS branch, event_id FROM events WHERE value > 80 UNION ALL SELECT 'errors', event_id FROM events WHERE event_type = 'error' UNION ALL SELECT 'all', event_id FROM events
""")
def route_branches(spark, sf_dir):
    found = routing.route(_read(spark, sf_dir, "events"), {"high": "value > 80", "errors": "event_type = 'error'"}, default="all")
    return relations.union(*[df.select(F.lit(name).alias("branch"), "event_id") for name, df in found.items()])


@_query("SELECT 'rest' AS branch, event_id FROM events WHERE NOT coalesce(value > 80, false) AND NOT coalesce(event_type = 'error', false)")
def route_unmatched(spark, sf_dir):
    found = routing.route(_read(spark, sf_dir, "events"), {"high": "value > 80", "errors": "event_type = 'error'"}, default="rest", default_mode="unmatched")
    return found["rest"].select(F.lit("rest").alias("branch"), "event_id")


@_query("SELECT event_id, 'main' AS tag FROM events WHERE NOT (nullif(event_type, 'view') = 'error') UNION ALL SELECT event_id, 'err' AS tag FROM events WHERE nullif(event_type, 'view') = 'error'")
def side_outputs(spark, sf_dir):
    main, side = routing.side_output(_read(spark, sf_dir, "events"), "NULLIF(event_type, 'view') = 'error'", tag="err")
    return relations.union(main.select("event_id", F.lit("main").alias("tag")), side.select("event_id", F.col("_side_tag").alias("tag")))


_CHECKED = "(SELECT event_id, user_id, nullif(event_type, 'view') AS kind, value FROM events)"


@_query(f"SELECT event_id, 'ok' AS error FROM {_CHECKED} WHERE kind IS NOT NULL AND value BETWEEN 1 AND 90 AND user_id % 5 <> 0 UNION ALL SELECT event_id, CASE WHEN kind IS NULL THEN 'notNull:kind' WHEN NOT (value BETWEEN 1 AND 90) THEN 'range:value[1,90]' ELSE 'expression:not_fifth' END FROM {_CHECKED} WHERE NOT (kind IS NOT NULL AND value BETWEEN 1 AND 90 AND user_id % 5 <> 0)")
def validated(spark, sf_dir):
    events = project.map_columns(_read(spark, sf_dir, "events"), {"event_id": "event_id", "user_id": "user_id", "kind": "NULLIF(event_type, 'view')", "value": "value"})
    good, bad = routing.validate(events, ["kind"], {"value": (1, 90)}, {"not_fifth": "user_id % 5 <> 0"})
    return relations.union(good.select("event_id", F.lit("ok").alias("error")), bad.select("event_id", F.col("_validation_error").alias("error")))


# Change feeds and merge engines

_FEED = "SELECT user_id AS id, ts AS seq, event_id, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' ELSE 'update' END AS op, event_type AS kind, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS amount FROM events"


def _feed(spark, sf_dir):
    return _read(spark, sf_dir, "events").selectExpr(
        "user_id AS id", "ts AS seq", "event_id", "CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' ELSE 'update' END AS op", "event_type AS kind", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS amount"
    )


@_query(f"SELECT id, seq, event_id, kind, amount FROM ({_FEED}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC, event_id DESC) = 1 AND op <> 'delete'")
def cdc_fold(spark, sf_dir):
    return cdc.fold(_feed(spark, sf_dir), ["id"], ["seq", "event_id"], op="op")


@_query("SELECT user_id AS id, event_type AS kind, round(value, 6) AS amount FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error'")
def cdc_decode(spark, sf_dir):
    """Envelopes written from events are decoded and folded."""
    from pyspark.sql import types as T

    row = F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("kind"), F.col("value").alias("amount"))
    deleted = F.col("event_type") == "error"
    messages = _read(spark, sf_dir, "events").select(
        F.to_json(F.struct(F.when(deleted, "d").otherwise("u").alias("op"), F.col("event_id").alias("ts_ms"), F.when(deleted, row).alias("before"), F.when(~deleted, row).alias("after"))).alias("value")
    )
    schema = T.StructType().add("id", "long").add("kind", "string").add("amount", "double")
    current = cdc.fold(cdc.decode_changes(messages, schema, "debezium-json"), ["id"], ["__ts"])
    return current.select("id", "kind", F.round("amount", 6).alias("amount"))


@_query(f"SELECT id, seq, event_id, op, kind, amount FROM ({_FEED}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC, event_id DESC) = 1")
def merge_deduplicate(spark, sf_dir):
    return cdc.merge(_feed(spark, sf_dir), ["id"], "deduplicate", ["seq", "event_id"])


@_query(f"SELECT id, seq, event_id, op, kind, amount FROM ({_FEED}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq, event_id) = 1")
def merge_first_row(spark, sf_dir):
    return cdc.merge(_feed(spark, sf_dir), ["id"], "first-row", ["seq", "event_id"])


@_query(f"SELECT id, max(seq) AS seq, arg_max(event_id, seq) AS event_id, arg_max(op, seq) AS op, arg_max(kind, seq) AS kind, arg_max(amount, seq) FILTER (WHERE amount IS NOT NULL) AS amount FROM ({_FEED}) GROUP BY id")
def merge_partial_update(spark, sf_dir):
    return cdc.merge(_feed(spark, sf_dir), ["id"], "partial-update", ["seq"])


@_query(f"SELECT id, max(seq) AS seq, min(event_id) AS event_id, arg_min(op, seq) AS op, string_agg(kind, ',' ORDER BY seq) AS kind, round(sum(amount), 5) AS amount FROM ({_FEED}) GROUP BY id")
def merge_aggregation(spark, sf_dir):
    merged = cdc.merge(_feed(spark, sf_dir), ["id"], "aggregation", ["seq"], {"seq": "max", "event_id": "min", "op": "first_value", "kind": "listagg", "amount": "sum"})
    return merged.withColumn("amount", F.round("amount", 5))


# Row patterns


@_query("""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn, lead(event_type) OVER w AS t2, lead(ts) OVER w AS ts2, lead(value) OVER w AS v2, lead(event_type, 2) OVER w AS t3, lead(ts, 2) OVER w AS ts3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id, ts AS started, ts3 AS ended, v2 AS clicked FROM o WHERE event_type = 'view' AND t2 = 'click' AND t3 = 'purchase'
""")
def pattern_fixed(spark, sf_dir):
    return pattern.match_rows(
        _read(spark, sf_dir, "events"), ["user_id"], ["ts"], "A B C",
        {"A": "event_type = 'view'", "B": "event_type = 'click'", "C": "event_type = 'purchase'"},
        {"started": ("FIRST(A.ts)", "TIMESTAMP"), "ended": ("LAST(C.ts)", "TIMESTAMP"), "clicked": ("LAST(B.value)", "DOUBLE")},
    )


@_query("""
WITH o AS (SELECT *, event_type = 'error' AS bad FROM events), g AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS grp FROM o)
SELECT user_id, count(*)::BIGINT AS errors, round(sum(value), 5) AS total, min(ts) AS started FROM g WHERE bad GROUP BY user_id, grp HAVING count(*) >= 2
""")
def pattern_runs(spark, sf_dir):
    found = pattern.match_rows(
        _read(spark, sf_dir, "events"), ["user_id"], ["ts"], "E{2,}", {"E": "event_type = 'error'"},
        {"errors": ("COUNT(E.*)", "BIGINT"), "total": ("SUM(E.value)", "DOUBLE"), "started": ("FIRST(E.ts)", "TIMESTAMP")},
    )
    return found.withColumn("total", F.round("total", 5))


@_query("""
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events),
m AS (SELECT a.user_id, a.rn AS s, a.value AS low, min(c.rn) AS e, arg_min(c.value, c.rn) AS high FROM o a JOIN o c ON a.user_id = c.user_id AND c.rn >= a.rn + 2 AND c.value > a.value WHERE a.event_type = 'view' GROUP BY ALL),
n AS (SELECT m.user_id, m.s, any_value(m.e) AS e, any_value(m.low) AS low, any_value(m.high) AS high, min(f.s) AS nxt FROM m LEFT JOIN m f ON f.user_id = m.user_id AND f.s > m.e GROUP BY m.user_id, m.s),
w AS (SELECT * FROM n WHERE (user_id, s) IN (SELECT (user_id, min(s)) FROM m GROUP BY user_id) UNION ALL SELECT n.* FROM w JOIN n ON n.user_id = w.user_id AND n.s = w.nxt)
SELECT user_id, low, high, (e - s - 1)::BIGINT AS between FROM w
""")
def pattern_related(spark, sf_dir):
    """A condition that compares a row with one matched before."""
    return pattern.match_rows(
        _read(spark, sf_dir, "events"), ["user_id"], ["ts"], "A B+? C", {"A": "event_type = 'view'", "C": "C.value > A.value"},
        {"low": ("FIRST(A.value)", "DOUBLE"), "high": ("LAST(C.value)", "DOUBLE"), "between": ("COUNT(B.*)", "BIGINT")},
    )


@_query("""
WITH o AS (SELECT *, row_number() OVER w AS rn, lag(event_type) OVER w AS before, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS same FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
a AS (SELECT o.*, coalesce(t.rn, 1000000000) AS stop FROM o LEFT JOIN o t ON o.same = t.event_id WHERE o.value > 20),
m AS (SELECT a.user_id, a.rn AS s, any_value(a.event_id) AS first_id, any_value(a.value) AS v, max(c.rn) AS e FROM a JOIN o c ON a.user_id = c.user_id AND c.rn BETWEEN a.rn + 2 AND a.stop AND c.value > 10 AND c.event_type <> c.before GROUP BY a.user_id, a.rn)
SELECT m.user_id, first_id, arg_max(x.event_id, x.rn) AS last_id, round(sum(x.value), 5) AS total, count(*)::BIGINT AS n FROM m JOIN o x ON x.user_id = m.user_id AND x.rn BETWEEN m.s AND m.e GROUP BY m.user_id, m.s, first_id
""")
def pattern_changes(spark, sf_dir):
    """Large values while the kind of event keeps changing; arithmetic over measures, search goes on at the next row."""
    found = pattern.match_rows(
        _read(spark, sf_dir, "events"), ["user_id"], ["ts"], "A B+ C",
        {"A": "A.value > 20", "B": "B.event_type <> A.event_type", "C": "C.value > 10 AND C.event_type <> B.event_type"},
        {"first_id": ("A.event_id", "BIGINT"), "last_id": ("C.event_id", "BIGINT"), "total": ("A.value + SUM(B.value) + C.value", "DOUBLE"), "n": ("COUNT(B.event_id) + 2", "BIGINT")},
        after="next_row",
    )
    return found.withColumn("total", F.round("total", 5))


@_query("""
WITH o AS (SELECT *, lead(event_type) OVER w AS t2, lead(value) OVER w AS v2, lead(value, 2) OVER w AS v3, lead(event_id, 2) OVER w AS last_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id, event_id AS first_id, last_id, round(v3 - value, 5) AS gain FROM o WHERE t2 <> event_type AND v2 < value AND v3 > value
""")
def pattern_rebound(spark, sf_dir):
    """A fixed sequence whose conditions compare its rows."""
    found = pattern.match_rows(
        _read(spark, sf_dir, "events"), ["user_id"], ["ts"], "A B C",
        {"B": "B.event_type <> A.event_type AND B.value < A.value", "C": "C.value > A.value"},
        {"first_id": ("A.event_id", "BIGINT"), "last_id": ("C.event_id", "BIGINT"), "gain": ("LAST(C.value) - FIRST(A.value)", "DOUBLE")}, after="next_row",
    )
    return found.withColumn("gain", F.round("gain", 5))


@_query("""
WITH o AS (SELECT *, value > 5 AS high, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events),
g AS (SELECT *, rn - row_number() OVER (PARTITION BY user_id ORDER BY ts) AS grp FROM o WHERE high),
p AS (SELECT *, (row_number() OVER (PARTITION BY user_id, grp ORDER BY ts) - 1) // 3 AS piece FROM g)
SELECT user_id, count(*)::BIGINT AS n, round(sum(value), 5) AS total, min(ts) AS first_ts, max(ts) AS last_ts FROM p GROUP BY user_id, grp, piece HAVING count(*) = 3
""")
def pattern_repeated(spark, sf_dir):
    """A reluctant repetition: the shortest matches, one after the other."""
    found = pattern.match_rows(
        _read(spark, sf_dir, "events"), ["user_id"], ["ts"], "high{3,}?", {"high": "value > 5"},
        {"n": ("COUNT(*)", "BIGINT"), "total": ("SUM(value)", "DOUBLE"), "first_ts": ("FIRST(ts)", "TIMESTAMP"), "last_ts": ("LAST(ts)", "TIMESTAMP")},
    )
    return found.withColumn("total", F.round("total", 5))


# Whole pipelines


@_query("""
SELECT r_name, date_trunc('month', o_orderdate) AS month, count(*) AS n, round(sum(o_totalprice), 2) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderstatus <> 'P' GROUP BY 1, 2
""")
def report_pipeline(spark, sf_dir):
    """The plan layer end to end: sources, joins, aggregation, one result."""
    from tarnflow.plans.pipeline import Pipeline

    flow = Pipeline("report", mode="batch")
    orders, customer, nation, region = [flow.source(_read(spark, sf_dir, n), name=n) for n in ("orders", "customer", "nation", "region")]
    enriched = orders.filter(condition="o_orderstatus <> 'P'").join(customer, on="l.o_custkey = r.c_custkey").join(nation, on="l.c_nationkey = r.n_nationkey").join(region, on="l.n_regionkey = r.r_regionkey")
    report = enriched.add_field(columns={"month": "date_trunc('month', o_orderdate)"}).aggregate(group_by=["r_name", "month"], select={"n": "COUNT(*)", "revenue": "ROUND(SUM(o_totalprice), 2)"})
    return report.dataframe()
