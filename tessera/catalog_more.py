"""Further queries of the library, each with equal SQL: joins by order, service sources and sinks, cells of markup, unlike rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import functions as fn
from .catalog import _round_trip, query
from .functions import lit, ref
from .operators.frame import Frame
from .operators.temporal import asof_join, interval_join
from .session import shared_folder
from .sources.memory import from_all

# joins by order


@query("SELECT e.event_id, p.event_id AS p_event_id, p.value AS p_value FROM events e ASOF LEFT JOIN events p ON e.user_id = p.user_id AND e.ts > p.ts")
def asof_previous(t, spark):
    own = t("events").select("event_id", "user_id", "ts", "value")
    return asof_join(own, own, "ts", ["user_id"], strict=True, prefix="p_").select("event_id", "p_event_id", "p_value")


@query(
    """WITH o AS (SELECT o_orderdate, max(o_orderkey) AS k FROM orders GROUP BY 1)
SELECT l_orderkey, l_linenumber, CASE WHEN b.k IS NULL OR f.o_orderdate - l_shipdate < l_shipdate - b.o_orderdate THEN f.k ELSE b.k END AS o_orderkey
FROM lineitem ASOF LEFT JOIN o b ON l_shipdate >= b.o_orderdate ASOF LEFT JOIN o f ON l_shipdate <= f.o_orderdate"""
)
def asof_nearest_of_all(t, spark):
    """One key: all rows meet in time ranges."""
    dates = Frame(t("orders").df.groupBy("o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey")))
    found = asof_join(t("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), dates, ("l_shipdate", "o_orderdate"), direction="nearest", range_rows=20_000)
    return found.select("l_orderkey", "l_linenumber", "o_orderkey")


@query(
    """SELECT e.event_id, CASE WHEN e.ts - n.ts >= INTERVAL '-6 hours' THEN n.event_id END AS n_event_id
FROM events e ASOF LEFT JOIN events n ON e.event_type = n.event_type AND e.ts < n.ts"""
)
def asof_next_within(t, spark):
    """A handful of keys, each hot."""
    own = t("events").select("event_id", "event_type", "ts")
    return asof_join(own, own, "ts", ["event_type"], "forward", strict=True, tolerance="6 hours", prefix="n_", range_rows=1_000).select("event_id", "n_event_id")


@query(
    """SELECT a.o_orderkey, b.o_orderkey AS b_o_orderkey FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey
AND a.o_orderdate <= b.o_orderdate + INTERVAL 10 DAY AND b.o_orderdate <= a.o_orderdate + INTERVAL 10 DAY"""
)
def interval_overlaps(t, spark):
    spans = Frame(t("orders").df.select("o_orderkey", "o_custkey", "o_orderdate", F.expr("o_orderdate + INTERVAL 10 DAYS AS until")))
    found = interval_join(spans, spans, ("o_orderdate", "until"), ("o_orderdate", "until"), ["o_custkey"], prefix="b_")
    return found.select("o_orderkey", "b_o_orderkey")


@query(
    """SELECT l_orderkey, l_linenumber, o_orderkey FROM lineitem LEFT JOIN orders ON o_custkey = l_suppkey
AND l_shipdate < o_orderdate + to_days(CAST(1 + o_orderkey % 300 AS INTEGER)) AND o_orderdate < l_shipdate"""
)
def interval_points(t, spark):
    """Moments in spans of very unlike lengths; moments without a span stay."""
    spans = Frame(t("orders").df.select("o_orderkey", "o_custkey", "o_orderdate", F.expr("o_orderdate + make_interval(0, 0, 0, cast(1 + o_orderkey % 300 AS int)) AS until")))
    found = interval_join(t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate"), spans, ("l_shipdate", "l_shipdate"), ("o_orderdate", "until"), {"l_suppkey": "o_custkey"}, closed=False, how="left")
    return found.select("l_orderkey", "l_linenumber", "o_orderkey")


# databases


def _database(spark, ddl: str):
    """Connections to a new SQLite file in the shared folder, which has this table."""
    import os
    import sqlite3
    import uuid

    folder = shared_folder(spark).removeprefix("file://")
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{uuid.uuid4().hex}.db"

    def connect():
        return sqlite3.connect(path, timeout=60)

    connection = connect()
    connection.execute(ddl)
    connection.commit()
    connection.close()
    return connect


CUSTOMERS = "CREATE TABLE customers (c_custkey INTEGER PRIMARY KEY, c_name TEXT, c_acctbal REAL)"


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def table_insert_keyset(t, spark):
    from .sinks import to_table_insert
    from .sources.keyset import from_db_keyset

    connect = _database(spark, CUSTOMERS)
    f = t("customer").select("c_custkey", "c_name", "c_acctbal")
    for _ in range(2):  # the second time the ledger knows the job
        f.write(to_table_insert(connect, "customers", job="customers"))
    return from_db_keyset(spark, connect, "customers", "c_custkey", "c_custkey long, c_name string, c_acctbal double", page_size=500)


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN upper(c_name) ELSE c_name END AS c_name, CASE WHEN c_nationkey = 3 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def table_update_pages(t, spark):
    from .sinks import to_table_insert, to_table_update
    from .sources.remote import from_db_limit_offset

    connect = _database(spark, CUSTOMERS)
    f = t("customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    f.drop("c_nationkey").write(to_table_insert(connect, "customers"))
    changed = f.filter(ref("c_nationkey").equals(3)).drop("c_nationkey").with_entries({"c_name": ref("c_name").upper(), "c_acctbal": lit(0.0)})
    changed.write(to_table_update(connect, "customers", ["c_custkey"]))
    return from_db_limit_offset(spark, connect, "customers", ["c_custkey"], "c_custkey long, c_name string, c_acctbal double", page_size=300)


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000 AND c_custkey <= 1000")
def keyset_filters(t, spark):
    from .sinks import to_table_insert
    from .sources.keyset import from_db_keyset

    connect = _database(spark, CUSTOMERS)
    t("customer").select("c_custkey", "c_name", "c_acctbal").write(to_table_insert(connect, "customers", skip_conflicts=True))
    f = from_db_keyset(spark, connect, "customers", ["c_custkey"], "c_custkey long, c_name string, c_acctbal double", ranges=3)
    return f.filters(ref("c_acctbal").greater_than(5000), ref("c_custkey").less_than_equal(1000)).select("c_custkey", "c_name")


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def db_query_per_set(t, spark):
    """A query of the database for each set of parameters."""
    from .sinks import to_table_insert
    from .sources.remote import from_db_queries

    connect = _database(spark, "CREATE TABLE nations (n_nationkey INTEGER, n_regionkey INTEGER)")
    t("nation").select("n_nationkey", "n_regionkey").write(to_table_insert(connect, "nations"))
    sets = [(r.r_regionkey,) for r in t("region").select("r_regionkey").fetch()]
    return from_db_queries(spark, connect, "SELECT n_regionkey, count(*) AS n FROM nations WHERE n_regionkey = ? GROUP BY 1", sets, "n_regionkey int, n long")


# cells of markup


@query("SELECT l_orderkey, l_linenumber::VARCHAR AS line, l_returnflag AS flag, l_quantity::INTEGER::VARCHAR AS quantity FROM lineitem")
def xml_nested_cells(t, spark):
    """Orders as XML texts with repeated and attributed elements, cast to nested values, written and cast again."""
    line = F.concat(F.lit('<line n="'), "l_linenumber", F.lit('" flag="'), "l_returnflag", F.lit('"><q>'), F.col("l_quantity").cast("int"), F.lit("</q></line>"))
    texts = t("lineitem").df.groupBy("l_orderkey").agg(F.concat(F.lit("<order>"), F.concat_ws("", F.collect_list(line)), F.lit("</order>")).alias("node"))
    cast = Frame(texts).cast_xml("node")
    again = cast.xml_text("node").cast_xml("node", cast.df.schema["node"].dataType)
    lines = again.df.select("l_orderkey", F.explode("node.order.line").alias("x"))
    return lines.select("l_orderkey", F.col("x.`@attributes`.n").alias("line"), F.col("x.`@attributes`.flag").alias("flag"), F.col("x.q.`@value`").alias("quantity"))


# files


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def json_array_ranges(t, spark):
    """Arrays written a task a file, read back in ranges of bytes."""
    from .sinks import to_json
    from .sources.json_arrays import from_json_array

    f = t("orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return _round_trip(f, spark, lambda p: to_json(p, as_array=True), lambda s, p: from_json_array(s, p, chunk=1 << 20))


@query("SELECT p_partkey::VARCHAR AS p_partkey, 'size \"' || p_size || '\", ' || p_name AS label FROM part")
def csv_doubled_quotes(t, spark):
    from .sinks import to_csv
    from .sources.files import from_csv

    label = fn.concat(lit('size "'), ref("p_size").cast("string"), lit('", '), ref("p_name"))
    f = t("part").with_entry("label", label).select("p_partkey", "label")
    return _round_trip(f, spark, lambda p: to_csv(p, escape='"'), lambda s, p: from_csv(s, p, separator=",", enclosure='"'))


# rows of unlike schemas


@query(
    """SELECT 'order' AS what, o_orderkey AS id, o_totalprice AS price, CAST(NULL AS VARCHAR) AS name, 'ARRAY<DOUBLE>' AS kind FROM orders
UNION ALL SELECT 'customer', c_custkey, NULL, c_name, 'OBJECT<name: STRING, nation: BIGINT>' FROM customer UNION ALL SELECT 'part', p_partkey, NULL, p_name, 'OBJECT<name: STRING>' FROM part"""
)
def unlike_rows_union(t, spark):
    """Lists, structures and maps in one column: variants, each with a schema of its own, typed again."""
    from .variants import row_schemas

    orders = Frame(t("orders").df.select(F.lit("order").alias("what"), F.col("o_orderkey").alias("id"), F.array("o_totalprice").alias("value")))
    customers = Frame(t("customer").df.select(F.lit("customer").alias("what"), F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).alias("value")))
    parts = Frame(t("part").df.select(F.lit("part").alias("what"), F.col("p_partkey").alias("id"), F.create_map(F.lit("name"), "p_name").alias("value")))
    rows = row_schemas(from_all(orders, customers, parts).df, "value", "kind")
    return rows.select("what", "id", F.try_variant_get("value", "$[0]", "double").alias("price"), F.try_variant_get("value", "$.name", "string").alias("name"), "kind")


# windows and groups beyond the usual ones


@query(
    """SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_orderkey, 2, -1) OVER w AS after, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 9) AS part,
first_value(o_orderkey) OVER w AS first_order, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_order
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""
)
def window_offsets(t, spark):
    w = fn.window().partition_by("o_custkey").order_by("o_orderdate", "o_orderkey")
    f = t("orders").with_entries({"before": fn.lag("o_totalprice").over(w), "after": fn.lead("o_orderkey", 2, -1).over(w), "quarter": fn.ntile(4).over(w)})
    f = f.with_entries({"part": fn.percent_rank().over(w), "first_order": fn.first_value("o_orderkey").over(w), "second_order": fn.nth_value("o_orderkey", 2).over(w)})
    return f.with_entry("part", ref("part").round(9)).select("o_orderkey", "before", "after", "quarter", "part", "first_order", "second_order")


@query(
    """SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS within_hour,
round(sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 4) AS near_sum,
max(user_id) OVER (PARTITION BY event_type ORDER BY user_id RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near_user FROM events"""
)
def window_frames(t, spark):
    w = fn.window().partition_by("event_type")
    f = t("events").with_entry("within_hour", fn.count("event_id").over(w.order_by("ts").range_between(-3600, 0)))
    f = f.with_entry("near_sum", fn.sum_("value").over(w.order_by("ts", "event_id").rows_between(-3, 1))).with_entry("near_user", fn.max_("user_id").over(w.order_by("user_id").range_between(-5, 5)))
    return f.with_entry("near_sum", ref("near_sum").round(4)).select("event_id", "within_hour", "near_sum", "near_user")


@query(
    """WITH l AS (SELECT *, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag FROM lineitem)
SELECT flag, l_linestatus, CAST(GROUPING(flag, l_linestatus) AS INTEGER) AS level, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM l GROUP BY CUBE (flag, l_linestatus)"""
)
def cube_with_null_keys(t, spark):
    """A key that has nulls of its own beside totals."""
    flag = fn.when(ref("l_returnflag").not_equals("N"), ref("l_returnflag"))
    f = t("lineitem").with_entry("flag", flag).group_by("flag", "l_linestatus").cube("level").aggregate(fn.count("l_orderkey").alias("n"), fn.sum_("l_quantity").alias("quantity"))
    return f.with_entry("quantity", ref("quantity").round(2))


@query("SELECT c_nationkey, c_mktsegment, CAST(GROUPING(c_nationkey, c_mktsegment) AS INTEGER) AS grouping, count(*) AS n, max(c_nationkey) AS most FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)")
def rollup_levels(t, spark):
    return t("customer").group_by("c_nationkey", "c_mktsegment").rollup().aggregate(fn.count("c_custkey").alias("n"), fn.max_("c_nationkey").alias("most"))


@query("SELECT l_returnflag, TRUE AS parts_close, TRUE AS median_close, count(*) AS n FROM lineitem GROUP BY 1")
def sketches_merged(t, spark):
    """Sketches for each flag and supplier, merged for each flag, against exact counts and ranks: within four standard errors, and 2 % of all ranks."""
    from .functions import sketches as sk

    keyed = t("lineitem").select("l_returnflag", "l_suppkey", "l_partkey", "l_extendedprice")
    parts = keyed.group_by("l_returnflag", "l_suppkey").aggregate(sk.distinct_sketch("l_partkey").alias("d"), sk.quantile_sketch("l_extendedprice").alias("q"))
    merged = parts.group_by("l_returnflag").aggregate(sk.merge_distinct("d").alias("d"), sk.merge_quantiles("q").alias("q"))
    merged = merged.with_entries({"distinct": sk.distinct_estimate("d"), "median": sk.quantile("q", 0.5)}).drop("d", "q")
    exact = keyed.df.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("truly"), F.count(F.lit(1)).alias("n"))
    below = keyed.df.join(F.broadcast(merged.df), "l_returnflag").groupBy("l_returnflag").agg(F.avg((F.col("l_extendedprice") <= F.col("median")).cast("int")).alias("rank"))  # one row a flag
    both = merged.df.join(exact, "l_returnflag").join(below, "l_returnflag")
    close = F.abs(F.col("distinct") - F.col("truly")) <= 4 * sk.distinct_error() * F.col("truly")
    return both.select("l_returnflag", close.alias("parts_close"), (F.abs(F.col("rank") - 0.5) < 0.02).alias("median_close"), "n")
