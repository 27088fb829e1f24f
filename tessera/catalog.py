"""The library's own queries over the standard tables, each with equal SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as fn
from .functions import lit, ref, window
from .operators.frame import Frame
from .operators.joins import compare_all, compare_any, equal, identical, join_on
from .schema import Schema, datetime_schema, int_schema, str_schema
from .session import SETTINGS, shared_folder
from .sources import memory
from .sources.memory import from_all

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for k, v in SETTINGS.items():
                spark.conf.set(k, v)
            out = f(lambda table: Frame(spark.read.parquet(f"{sf_dir}/{table}.parquet")), spark)
            return out.df if isinstance(out, Frame) else out

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return run

    return register


# relational verbs


@query("SELECT strftime(l_shipdate, '%Y/%m') AS month, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY 1")
def monthly_revenue(t, spark):
    revenue = ref("l_extendedprice").multiply(lit(1).minus(ref("l_discount")))
    f = t("lineitem").with_entry("month", ref("l_shipdate").date_format("Y/m")).with_entry("r", revenue)
    f = f.group_by("month").aggregate(fn.sum_("r")).with_entry("revenue", ref("r_sum").round(2))
    return f.select("month", "revenue").sort_by("month")


@query("SELECT o_orderkey, o_totalprice * 2 AS doubled, CAST(NULL AS VARCHAR) AS not_there FROM orders")
def select_missing(t, spark):
    return t("orders").with_entry("doubled", ref("o_totalprice").multiply(2)).select("o_orderkey", "doubled", "not_there")


@query("SELECT c_custkey, c_acctbal + 1 AS a, (c_acctbal + 1) * 2 AS b FROM customer")
def with_entries_sequential(t, spark):
    return t("customer").with_entries({"a": ref("c_acctbal").plus(1), "b": ref("a").multiply(2)}).select("c_custkey", "a", "b")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def drop_columns(t, spark):
    return t("customer").drop("c_nationkey", "c_acctbal", "absent")


@query("SELECT n_nationkey AS id, n_name, n_regionkey FROM nation")
def rename_one(t, spark):
    return t("nation").rename("n_nationkey", "id")


@query("SELECT r_regionkey AS region_regionkey, r_name AS region_name FROM region")
def rename_all(t, spark):
    return t("region").rename_all("r_", "region_")


@query("SELECT s_suppkey AS \"sSuppkey\", s_name AS \"sName\", s_nationkey AS \"sNationkey\", s_acctbal AS \"sAcctbal\" FROM supplier")
def rename_style(t, spark):
    return t("supplier").rename_all_style("camel")


@query("SELECT p_brand, p_name, p_partkey, p_retailprice, p_size, p_type FROM part")
def reorder_by_name(t, spark):
    return t("part").reorder_entries("name")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_discount <= 0.02")
def filter_compare(t, spark):
    return t("lineitem").filter(fn.all_(ref("l_quantity").greater_than(45), ref("l_discount").less_than_equal(0.02))).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 50000")
def between_half_open(t, spark):
    return t("orders").filter(ref("o_totalprice").between(1000, 50000)).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_acctbal < 0")
def filter_any(t, spark):
    return t("customer").filter(fn.any_(ref("c_mktsegment").is_in(["BUILDING", "MACHINERY"]), ref("c_acctbal").less_than(0))).select("c_custkey")


@query("SELECT o_orderkey, NOT coalesce(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END > 100000, FALSE) AS low FROM orders")
def not_null_logic(t, spark):
    price = fn.when(ref("o_orderstatus").equals("F"), None, ref("o_totalprice"))
    return t("orders").with_entry("price", price).with_entry("low", fn.not_(ref("price").greater_than(100000))).select("o_orderkey", "low")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'high' WHEN o_totalprice > 50000 THEN 'middle' ELSE 'low' END AS class FROM orders")
def when_chain(t, spark):
    c = fn.when(ref("o_totalprice").greater_than(150000), "high", fn.when(ref("o_totalprice").greater_than(50000), "middle", "low"))
    return t("orders").with_entry("class", c).select("o_orderkey", "class")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(t, spark):
    return t("orders").sort_by(ref("o_totalprice").desc(), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 50")
def offset_limit(t, spark):
    return t("orders").sort_by("o_orderkey").offset(50).limit(100).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey < coalesce((SELECT min(o_orderkey) FROM orders WHERE o_totalprice > 499000), 9e18)")
def until_ordered(t, spark):
    return t("orders").until(ref("o_totalprice").less_than_equal(499000), "o_orderkey").select("o_orderkey")


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) = 1")
def drop_duplicates(t, spark):
    return t("lineitem").drop_duplicates("l_suppkey", order_by=["l_orderkey", "l_linenumber"]).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(t, spark):
    return t("lineitem").select("l_returnflag", "l_linestatus").unique()


@query("SELECT c_name AS name, c_acctbal AS balance, CAST(NULL AS VARCHAR) AS s_name FROM customer UNION ALL SELECT NULL, s_acctbal, s_name FROM supplier")
def union_by_name(t, spark):
    a = t("customer").select("c_name", "c_acctbal").rename("c_name", "name").rename("c_acctbal", "balance")
    b = t("supplier").select("s_acctbal", "s_name").rename("s_acctbal", "balance")
    return from_all(a, b)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def diff_left(t, spark):
    return t("orders").select("o_orderkey").diff_left(t("lineitem").select("l_orderkey").rename("l_orderkey", "o_orderkey"))


# aggregation


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price, min(l_discount) AS low, max(l_tax) AS high, count(*) AS n FROM lineitem GROUP BY 1, 2")
def group_aggregates(t, spark):
    g = t("lineitem").group_by("l_returnflag", "l_linestatus").aggregate(
        fn.sum_("l_quantity").alias("qty"), fn.average("l_extendedprice").alias("price"), fn.min_("l_discount").alias("low"), fn.max_("l_tax").alias("high"), fn.count("l_orderkey").alias("n")
    )
    return g.with_entries({"qty": ref("qty").round(2), "price": ref("price").round(4)})


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, strftime(max(o_orderdate), '%Y-%m-%d') AS newest FROM orders")
def global_aggregate(t, spark):
    f = t("orders").aggregate(fn.count("o_orderkey").alias("n"), fn.sum_("o_totalprice").alias("total"), fn.max_("o_orderdate").alias("newest"))
    return f.with_entries({"total": ref("total").round(2), "newest": ref("newest").date_format("Y-m-d")})


@query("SELECT n_regionkey, CAST(to_json(list(n_name ORDER BY n_nationkey)) AS VARCHAR) AS names FROM nation GROUP BY 1")
def collect_sorted(t, spark):
    return t("nation").group_by("n_regionkey").aggregate(fn.collect("n_name", order_by="n_nationkey").alias("names")).with_entry("names", ref("names").json_encode())


@query("SELECT c_nationkey, CAST(to_json(list_sort(list(DISTINCT c_mktsegment))) AS VARCHAR) AS segments FROM customer GROUP BY 1")
def collect_unique(t, spark):
    f = t("customer").group_by("c_nationkey").aggregate(fn.collect_unique("c_mktsegment", order_by="c_mktsegment").alias("segments"))
    return f.with_entry("segments", ref("segments").array_sort().json_encode())


@query("SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS oldest, arg_max(o_orderstatus, o_orderkey) AS newest FROM orders GROUP BY 1")
def first_last(t, spark):
    return t("orders").group_by("o_custkey").aggregate(fn.first("o_orderstatus", "o_orderkey").alias("oldest"), fn.last("o_orderstatus", "o_orderkey").alias("newest"))


@query("""SELECT o_orderpriority, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS f, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS o,
 round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS p FROM orders GROUP BY 1""")
def pivot_status(t, spark):
    f = t("orders").group_by("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).aggregate(fn.sum_("o_totalprice"))
    return f.rename_all_lower_case().with_entries({c: ref(c).round(2) for c in ("f", "o", "p")})


@query("SELECT n_regionkey, count(*) AS members FROM nation GROUP BY 1")
def group_to_array(t, spark):
    return t("nation").group_to_array("n_regionkey", "rows").with_entry("members", ref("rows").size().cast("int")).select("n_regionkey", "members")


# joins


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_inner(t, spark):
    return t("customer").join(t("nation"), {"c_nationkey": "n_nationkey"}, "inner").select("c_custkey", "n_name")


@query("SELECT c_custkey, c_nationkey, n_nationkey AS joined_n_nationkey, n_name AS joined_n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) ON c_nationkey = n_nationkey")
def join_left_prefix(t, spark):
    right = t("nation").filter(ref("n_regionkey").equals(1)).select("n_nationkey", "n_name")
    return t("customer").select("c_custkey", "c_nationkey").join(right, join_on({"c_nationkey": "n_nationkey"}, "joined_"))


@query("SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey")
def join_right(t, spark):
    left = t("orders").select("o_orderkey", "o_custkey")
    return left.join(t("customer").select("c_custkey"), join_on([identical("o_custkey", "c_custkey")]), "right").select("o_orderkey", "c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_left_anti(t, spark):
    return t("orders").select("o_orderkey", "o_custkey").join(t("lineitem").select("l_orderkey"), {"o_orderkey": "l_orderkey"}, "left_anti")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) ON c_custkey = o_custkey")
def join_first_match(t, spark):
    right = t("orders").select("o_custkey", "o_orderkey")
    return t("customer").select("c_custkey").join(right, {"c_custkey": "o_custkey"}, match="first", order_by=["o_orderkey"]).select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey OR s_nationkey = n_regionkey")
def join_any(t, spark):
    on = join_on(compare_any(equal("s_nationkey", "n_nationkey"), equal("s_nationkey", "n_regionkey")))
    return t("supplier").join(t("nation"), on, "inner").select("s_suppkey", "n_name")


@query("SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS r_l_linenumber FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey")
def join_all(t, spark):
    left = t("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    right = t("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    on = join_on(compare_all(equal("l_orderkey", "l_orderkey"), equal("l_suppkey", "l_suppkey")), "r_")
    return left.join(right, on, "inner").select("l_orderkey", "l_linenumber", "r_l_linenumber")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_join(t, spark):
    return t("region").select("r_name").cross_join(t("nation").select("n_name"))


@query("SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def join_each_lookup(t, spark):
    def lookup(asked):
        return t("nation").join(asked, {"n_nationkey": "s_nationkey"}, "inner").select("n_nationkey", "n_name")

    return t("supplier").select("s_suppkey", "s_nationkey").join_each(lookup, {"s_nationkey": "n_nationkey"}, keys=["s_nationkey"]).select("s_suppkey", "n_name")


# windows


@query("SELECT s_suppkey, CAST(rank() OVER w AS INTEGER) AS rank, CAST(dense_rank() OVER w AS INTEGER) AS dense_rank FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY round(s_acctbal / 1000) DESC)")
def window_ranks(t, spark):
    w = window().partition_by("s_nationkey").order_by(ref("k").desc())
    f = t("supplier").with_entry("k", ref("s_acctbal").divide(1000).round(0)).with_entry("rank", fn.rank().over(w)).with_entry("dense_rank", fn.dense_rank().over(w))
    return f.select("s_suppkey", "rank", "dense_rank")


@query("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS nth FROM orders")
def window_row_number(t, spark):
    return t("orders").with_entry("nth", fn.row_number().over(window().partition_by("o_custkey").order_by("o_orderdate", "o_orderkey"))).select("o_orderkey", "nth")


@query("SELECT c_custkey, round(sum(c_acctbal) OVER w, 2) AS total, round(avg(c_acctbal) OVER w, 4) AS mean, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS alike FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
def window_aggregates(t, spark):
    w = window().partition_by("c_nationkey").order_by("c_custkey")  # the order does not make the sums run
    f = t("customer").with_entries({"total": fn.sum_("c_acctbal").over(w), "mean": fn.average("c_acctbal").over(w), "alike": fn.count("c_mktsegment").over(w)})
    return f.with_entries({"total": ref("total").round(2), "mean": ref("mean").round(4)}).select("c_custkey", "total", "mean", "alike")


# scalar functions


@query("""SELECT p_partkey, p_size::BIGINT + 1 AS a, p_size::BIGINT - 3 AS b, p_size::BIGINT * 2 AS c, CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / (p_size % 5) END AS d,
 CAST(p_size % 7 AS BIGINT) AS e, pow(p_size, 2) AS f, round(p_retailprice, 1) AS g FROM part""")
def math_ops(t, spark):
    s = ref("p_size").cast("int")
    f = t("part").with_entries({"a": s.plus(1), "b": s.minus(3), "c": s.multiply(2), "d": s.divide(s.mod(5)), "e": s.mod(7), "f": s.power(2), "g": ref("p_retailprice").round(1)})
    return f.select("p_partkey", "a", "b", "c", "d", "e", "f", "g")


@query("SELECT c_custkey, format('{:,.1f}', round(c_acctbal, 1)) AS text FROM customer")
def number_format(t, spark):
    return t("customer").with_entry("text", ref("c_acctbal").round(1).number_format(1)).select("c_custkey", "text")


@query("""SELECT p_partkey, lower(p_brand) AS low, upper(p_name) AS up, length(p_name) AS size, contains(p_type, 'STEEL') AS steel, starts_with(p_brand, 'Brand#1') AS starts,
 suffix(p_brand, '3') AS ends, p_brand || '/' || p_type AS both, replace(p_brand, 'Brand', 'B') AS short FROM part""")
def string_ops(t, spark):
    e = {
        "low": ref("p_brand").lower(), "up": ref("p_name").upper(), "size": ref("p_name").size().cast("int"), "steel": ref("p_type").contains("STEEL"),
        "starts": ref("p_brand").starts_with("Brand#1"), "ends": ref("p_brand").ends_with("3"), "both": fn.concat(ref("p_brand"), "/", ref("p_type")), "short": ref("p_brand").str_replace("Brand", "B"),
    }
    return t("part").with_entries(e).select("p_partkey", *e)


@query("""SELECT n_nationkey, CASE WHEN length(n_name) >= 10 THEN n_name ELSE lpad(n_name, 10, '*') END AS l, CASE WHEN length(n_name) >= 10 THEN n_name ELSE rpad(n_name, 10, '*') END AS r,
 CASE WHEN length(n_name) >= 10 THEN n_name ELSE rpad(repeat('*', (10 - length(n_name)) // 2) || n_name, 10, '*') END AS b FROM nation""")
def pad(t, spark):
    n = ref("n_name")
    return t("nation").with_entries({"l": n.str_pad_left(10, "*"), "r": n.str_pad_right(10, "*"), "b": n.str_pad_both(10, "*")}).select("n_nationkey", "l", "r", "b")


@query("SELECT c_custkey, split_part(c_name, '#', 1) AS head, len(string_split(c_name, '#')) AS parts, left(c_name, 3) || repeat('*', length(c_name) - 3) AS masked FROM customer")
def split_sanitize(t, spark):
    c = ref("c_name")
    return t("customer").with_entries({"head": c.split("#").array_get("0"), "parts": c.split("#").size().cast("int"), "masked": c.sanitize("*", 3)}).select("c_custkey", "head", "parts", "masked")


@query("SELECT p_partkey, regexp_extract(p_brand, '#(\\d)(\\d)', 1) AS a, regexp_matches(p_type, '^[A-Z]') AS m, regexp_replace(p_brand, '\\d', 'x', 'g') AS r FROM part")
def regex_ops(t, spark):
    b = ref("p_brand")
    e = {"a": fn.when(b.regex_match(r"/#(\d)(\d)/"), b.regex(r"/#(\d)(\d)/").array_get("1"), ""), "m": ref("p_type").regex_match("/^[A-Z]/"), "r": b.regex_replace(r"/\d/", "x")}
    return t("part").with_entries(e).select("p_partkey", *e)


@query("SELECT n_nationkey, printf('%s has key %d', n_name, n_nationkey) AS s, trim(n_name, 'AB') AS t FROM nation")
def sprintf_trim(t, spark):
    return t("nation").with_entries({"s": fn.sprintf("%s has key %d", ref("n_name"), ref("n_nationkey")), "t": ref("n_name").trim("both", "AB")}).select("n_nationkey", "s", "t")


@query("SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS text, strftime(date_trunc('day', o_orderdate), '%Y-%m-%d %H:%M:%S') AS day, epoch_us(o_orderdate) AS micros FROM orders")
def date_ops(t, spark):
    d = ref("o_orderdate")
    return t("orders").with_entries({"text": d.date_format("d.m.Y"), "day": d.to_date().date_time_format("Y-m-d H:i:s"), "micros": d.cast("int")}).select("o_orderkey", "text", "day", "micros")


@query("SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS tokyo FROM events")
def timezone(t, spark):
    return t("events").with_entry("tokyo", ref("ts").to_timezone("Asia/Tokyo").date_time_format("Y-m-d H:i")).select("event_id", "tokyo")


@query("SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s FROM customer")
def hashes(t, spark):
    return t("customer").with_entries({"m": ref("c_name").hash("md5"), "s": ref("c_name").hash("sha256")}).select("c_custkey", "m", "s")


@query("SELECT s_suppkey, TRY_CAST(s_name AS BIGINT) AS a, CAST(s_suppkey AS VARCHAR) AS b, CAST(s_suppkey AS DOUBLE) AS c, s_suppkey = s_suppkey AS d FROM supplier")
def casts(t, spark):
    e = {"a": ref("s_name").cast("int"), "b": ref("s_suppkey").cast("string"), "c": ref("s_suppkey").cast("float"), "d": ref("s_suppkey").equals(ref("b"))}
    return t("supplier").with_entries(e).select("s_suppkey", *e)


# nested values


@query("SELECT vec_id, len(embedding) AS n, embedding[1]::DOUBLE AS first, round(list_max(embedding)::DOUBLE, 6) AS most, embedding[-1]::DOUBLE AS last FROM embeddings")
def list_ops(t, spark):
    e = ref("embedding")
    f = t("embeddings").with_entries({"n": e.size().cast("int"), "first": e.array_get("0").cast("float"), "most": e.array_sort("rsort").array_get("0").cast("float").round(6), "last": e.array_reverse().array_get("0").cast("float")})
    return f.select("vec_id", "n", "first", "most", "last")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * 2)), 4) AS doubled, len(list_concat(embedding, embedding)) AS twice FROM embeddings")
def on_each_merge(t, spark):
    from .functions.expr import Expr

    e = ref("embedding")
    scaled = e.on_each(ref("element").cast("float").multiply(2))
    total = Expr(lambda ctx: F.aggregate(scaled.resolve(ctx), F.lit(0.0), lambda a, x: a + x))
    return t("embeddings").with_entries({"doubled": total.round(4), "twice": e.array_merge(e).size().cast("int")}).select("vec_id", "doubled", "twice")


@query("SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings")
def expand_list(t, spark):
    return t("embeddings").with_entry("y", ref("embedding").expand()).with_entry("x", ref("y").cast("float")).select("vec_id", "x")


@query("SELECT c_custkey, unnest(['name', 'segment']) AS k, unnest([c_name, c_mktsegment]) AS v FROM customer")
def combine_expand(t, spark):
    m = fn.combine(lit(["name", "segment"]), lit([ref("c_name"), ref("c_mktsegment")]))
    f = t("customer").with_entry("m", m).with_entry("e", ref("m").expand("both"))
    from .functions.expr import Expr

    return f.with_entries({"k": Expr(lambda ctx: F.map_keys("e")[0]), "v": Expr(lambda ctx: F.map_values("e")[0])}).select("c_custkey", "k", "v")


@query("SELECT event_id, props, json_extract_string(props, '$.k') AS k FROM events")
def json_path(t, spark):
    return t("events").with_entry("k", ref("props").array_get("k")).select("event_id", "props", "k")


@query("SELECT n_nationkey, n_name AS \"s.name\", n_regionkey AS \"s.region\" FROM nation")
def struct_unpack(t, spark):
    from .functions.expr import Expr

    s = Expr(lambda ctx: F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), F.lit(1).alias("skipped")))
    f = t("nation").with_entry("s", s).with_entry("s", ref("s").unpack(skip=["skipped"]))
    return Frame(f.df.select("n_nationkey", F.col("`s.name`"), F.col("`s.region`")))


@query("SELECT o_custkey, CAST(list_sum(list(o_orderkey)) AS BIGINT) AS keys FROM orders GROUP BY 1")
def wildcard_path(t, spark):
    from .functions.expr import Expr

    f = t("orders").select("o_custkey", "o_orderkey", "o_orderstatus").group_to_array("o_custkey", "rows")
    keys = ref("rows").array_get("*.o_orderkey")
    return f.with_entry("keys", Expr(lambda ctx: F.aggregate(keys.resolve(ctx), F.lit(0).cast("long"), lambda a, x: a + x))).select("o_custkey", "keys")


@query("SELECT n_nationkey, n_name AS value, 'a' AS attribute, 1 AS attributes FROM nation")
def xml_values(t, spark):
    x = fn.concat('<n k="a">', ref("n_name"), "</n>")
    f = t("nation").with_entry("x", x)
    e = {"value": ref("x").dom_element_value(), "attribute": ref("x").dom_element_attribute_value("k"), "attributes": ref("x").dom_element_attributes_count().cast("int")}
    return Frame(f.with_entries(e).df.select("n_nationkey", "value", "attribute", F.col("attributes").cast("int")))


# types, sources and sinks


@query("SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier")
def auto_cast(t, spark):
    texts = t("supplier").with_entries({c: ref(c).cast("string") for c in ("s_suppkey", "s_nationkey", "s_acctbal")})
    return texts.auto_cast()


@query("SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def schema_validate(t, spark):
    wanted = Schema(int_schema("o_orderkey"), str_schema("o_orderstatus", True), datetime_schema("o_orderdate", True))
    f = t("orders").with_entry("o_orderdate", ref("o_orderdate").cast("datetime")).select("o_orderkey", "o_orderstatus", "o_orderdate")
    return f.validate(wanted).with_entry("day", ref("o_orderdate").date_format("Y-m-d")).select("o_orderkey", "o_orderstatus", "day")


def _round_trip(f: Frame, spark: SparkSession, sink, read, partitions: tuple[str, ...] = ()) -> Frame:
    import atexit
    import uuid

    path = f"{shared_folder(spark)}/round-trip-{uuid.uuid4().hex}"

    def drop():
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit
            pass

    atexit.register(drop)
    if partitions:
        f = f.partition_by(*partitions)
    f.mode("overwrite").write(sink(path))
    return read(spark, path)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_round_trip(t, spark):
    from .sinks import to_csv
    from .sources.files import from_csv

    back = _round_trip(t("customer").select("c_custkey", "c_name", "c_acctbal"), spark, to_csv, from_csv)
    return back.with_entries({"c_custkey": ref("c_custkey").cast("int"), "c_acctbal": ref("c_acctbal").cast("float")})


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def json_round_trip(t, spark):
    from .sinks import to_json
    from .sources.files import from_json

    back = _round_trip(t("nation").select("n_nationkey", "n_name"), spark, to_json, lambda s, p: from_json(s, p, multi_line=False))
    return back.select("n_nationkey", "n_name")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
def partition_write_prune(t, spark):
    from .sinks import to_parquet
    from .sources.files import from_parquet

    back = _round_trip(t("orders").select("o_orderkey", "o_orderstatus"), spark, to_parquet, from_parquet, ("o_orderstatus",))
    return back.filter_partitions(ref("o_orderstatus").equals("P")).select("o_orderkey", "o_orderstatus")


@query("SELECT n_name AS text FROM nation")
def text_round_trip(t, spark):
    from .sinks import to_text
    from .sources.files import from_text

    return _round_trip(t("nation").select("n_name"), spark, to_text, from_text)


@query("SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def xml_round_trip(t, spark):
    from .sinks import to_xml
    from .sources.files import from_xml_rows

    return _round_trip(t("region"), spark, to_xml, lambda s, p: from_xml_rows(s, p, "row")).select("r_regionkey", "r_name")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 200000")
def branch(t, spark):
    from .sinks import to_branch, to_parquet
    from .sources.files import from_parquet

    return _round_trip(t("orders").select("o_orderkey", "o_totalprice"), spark, lambda p: to_branch(ref("o_totalprice").greater_than(200000), to_parquet(p)), from_parquet).select("o_orderkey")


@query("SELECT CAST(range AS BIGINT) AS n, o_orderkey FROM range(0, (SELECT max(o_orderkey) + 1 FROM orders), 5) LEFT JOIN orders ON o_orderkey = range")
def sequence_numbers(t, spark):
    """Every fifth number up to the greatest key of a table, and the order that has it."""
    most = t("orders").aggregate(fn.max_("o_orderkey").alias("most")).first().most
    return memory.from_sequence_number(spark, "n", 0, most, 5).join(t("orders").select("o_orderkey"), {"n": "o_orderkey"}).select("n", "o_orderkey")


@query("""SELECT strftime(d, '%Y-%m-%d') AS day, count(event_id) AS n FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-01', INTERVAL 1 DAY)) AS d)
LEFT JOIN events ON strftime(ts, '%Y-%m-%d') = strftime(d, '%Y-%m-%d') GROUP BY 1""")
def sequence_dates(t, spark):
    """The events of every day of a period, days without any too."""
    days = memory.from_sequence_date_period(spark, "d", "2024-01-01", "1 day", "2024-03-01").with_entry("day", ref("d").date_format("Y-m-d")).select("day")
    counts = t("events").with_entry("at", ref("ts").date_format("Y-m-d")).group_by("at").aggregate(fn.count("event_id").alias("n"))
    return days.join(counts, {"day": "at"}).with_entry("n", fn.when(ref("n").is_null(), 0, ref("n")).cast("int")).select("day", "n")


@query("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def json_plan(t, spark):
    from .plans.json_plan import Builder

    b = Builder(spark)
    call = {"method": "filter", "args": [{"function": "ref", "args": ["c_acctbal"], "call": {"method": "greaterThan", "args": [0]}}]}
    call["call"] = {"method": "groupBy", "args": ["c_nationkey"], "call": {"method": "aggregate", "args": [{"function": "count", "args": ["c_custkey"], "call": {"method": "as", "args": ["n"]}}]}}
    return b._calls(t("customer"), call)


@query("SELECT n_name AS \"N_NAME\", n_regionkey AS \"N_REGIONKEY\" FROM nation")
def rename_upper(t, spark):
    return t("nation").select("n_name", "n_regionkey").rename_all_upper_case()


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def diff_right(t, spark):
    return t("supplier").select("s_suppkey").rename("s_suppkey", "c_custkey").diff_right(t("customer").select("c_custkey"))


@query("SELECT p_partkey FROM part ORDER BY p_partkey DESC LIMIT 10")
def take_right(t, spark):
    return t("part").select("p_partkey").take_right(10, "p_partkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM part ORDER BY p_partkey DESC LIMIT 10)")
def drop_right(t, spark):
    return t("part").select("p_partkey").drop_right(10, "p_partkey")


@query("SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderstatus FROM orders")
def partition_values(t, spark):
    return t("orders").partition_values("o_orderdate", "o_orderstatus")


@query("SELECT event_id, TRUE AS a, props IS NOT NULL AS b, ts IS NOT NULL AS c, FALSE AS d, TRUE AS e FROM events")
def type_tests(t, spark):
    e = {"a": ref("event_id").is_numeric(), "b": ref("props").is_type("string"), "c": ref("ts").is_type("datetime", "null"), "d": ref("event_id").is_type("string", "list"), "e": ref("absent").exists().equals(False)}
    return t("events").with_entries(e).select("event_id", *e)


@query("SELECT n_nationkey, n_nationkey % 2 = 0 AS even, n_nationkey % 2 <> 0 AS odd, n_nationkey = 3 AS same, n_name IS NULL AS missing FROM nation")
def parity_same_null(t, spark):
    k = ref("n_nationkey")
    e = {"even": k.is_even(), "odd": k.is_odd(), "same": k.same(3), "missing": ref("n_name").is_null()}
    return t("nation").with_entries(e).select("n_nationkey", *e)


@query("SELECT c_custkey, ltrim(c_name, 'C') AS l, rtrim(c_name, '0123456789') AS r, CAST(length(trim('  ' || c_name || ' ')) AS INTEGER) AS n FROM customer")
def trims(t, spark):
    c = ref("c_name")
    e = {"l": c.trim("left", "C"), "r": c.trim("right", "0123456789"), "n": fn.concat("  ", c, " ").trim().size()}
    return t("customer").with_entries(e).select("c_custkey", *e)


@query("SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM part")
def capitalize(t, spark):
    return t("part").with_entry("title", ref("p_type").capitalize()).select("p_partkey", "title")


@query("SELECT p_partkey, array_to_string(regexp_extract_all(p_brand, '\\d'), '-') AS digits, CAST(len(regexp_extract_all(p_type, '[A-Z]+')) AS INTEGER) AS words FROM part")
def regex_all(t, spark):
    e = {"digits": ref("p_brand").regex_all("/[0-9]/").array_get("0"), "words": ref("p_type").regex_all("/[A-Z]+/").array_get("0").size()}
    f = t("part").with_entries(e)
    return Frame(f.df.select("p_partkey", F.array_join("digits", "-").alias("digits"), F.coalesce("words", F.lit(0)).alias("words")))


@query("SELECT p_partkey, regexp_replace(p_brand, '\\d', 'x') AS once FROM part")
def regex_replace_limit(t, spark):
    return t("part").with_entry("once", ref("p_brand").regex_replace("/[0-9]/", "x", 1)).select("p_partkey", "once")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN floor(c_acctbal) + CAST(c_acctbal - floor(c_acctbal) > 0.5 AS INT) ELSE floor(c_acctbal + 0.5) END AS up FROM customer")
def round_half_up(t, spark):
    return t("customer").with_entry("up", ref("c_acctbal").round(0)).select("c_custkey", "up")


@query("SELECT o_orderkey, strftime(TIMESTAMP '1970-01-01' + to_seconds(o_orderkey * 3600), '%Y-%m-%d %H:%M:%S') AS moment, strftime(strptime('15.06.2024', '%d.%m.%Y'), '%Y-%m-%d') AS parsed FROM orders")
def parse_dates(t, spark):
    e = {"moment": ref("o_orderkey").multiply(3600).to_date_time().date_time_format("Y-m-d H:i:s"), "parsed": lit("15.06.2024").to_date("d.m.Y").date_format()}
    return t("orders").with_entries(e).select("o_orderkey", *e)


@query("SELECT n_nationkey, CAST(to_json({'key': n_nationkey, 'name': n_name}) AS VARCHAR) AS j FROM nation")
def json_encode(t, spark):
    from .functions.expr import Expr

    s = Expr(lambda ctx: F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")))
    return t("nation").with_entry("s", s).with_entry("j", ref("s").json_encode()).select("n_nationkey", "j")


@query("SELECT n_nationkey, n_name AS a, CAST(n_regionkey AS INTEGER) AS b, CAST(NULL AS VARCHAR) AS c FROM nation")
def json_decode(t, spark):
    from .functions.expr import Expr

    j = Expr(lambda ctx: F.to_json(F.struct(F.col("n_name").alias("a"), F.col("n_regionkey").alias("b"))))
    f = t("nation").with_entry("j", j).with_entry("d", ref("j").json_decode("a string, b int"))
    return f.with_entries({"a": ref("d").array_get("a"), "b": ref("d").array_get("b"), "c": ref("d").array_get("?c")}).select("n_nationkey", "a", "b", "c")


@query("SELECT n_nationkey, n_name AS left_name, TRUE AS has, FALSE AS hasnt FROM nation")
def struct_select_merge(t, spark):
    from .functions.expr import Expr

    a = Expr(lambda ctx: F.struct(F.col("n_name").alias("name"), F.lit(1).alias("x")))
    b = Expr(lambda ctx: F.struct(F.lit(2).alias("x")))
    f = t("nation").with_entries({"a": a, "b": b}).with_entry("m", ref("a").array_merge(ref("b")))
    e = {"left_name": ref("m").select("name").array_key_rename("name", "renamed").array_get("renamed"), "has": ref("m").array_path_exists("x"), "hasnt": ref("m").array_path_exists("y")}
    return f.with_entries(e).select("n_nationkey", *e)


@query("SELECT n_regionkey, CAST(to_json(list({'n_name': n_name} ORDER BY n_nationkey)) AS VARCHAR) AS picked FROM nation GROUP BY 1")
def list_select(t, spark):
    f = t("nation").select("n_regionkey", "n_nationkey", "n_name").group_to_array("n_regionkey", "rows")
    from .functions.expr import Expr

    ordered = Expr(lambda ctx: F.array_sort(F.transform("rows", lambda r: F.struct(r["n_nationkey"], r["n_name"]))))
    return f.with_entry("rows", ordered).with_entry("picked", ref("rows").select("n_name").json_encode()).select("n_regionkey", "picked")


@query("SELECT n_nationkey, unnest(['a', 'b']) AS k FROM nation")
def expand_map_keys(t, spark):
    return t("nation").with_entry("m", lit({"a": 1, "b": 2})).with_entry("k", ref("m").expand("keys")).select("n_nationkey", "k")


@query("SELECT n_nationkey, CAST(to_json([n_name, 'x', 'y']) AS VARCHAR) AS flat FROM nation")
def merge_collection(t, spark):
    nested = lit([lit([ref("n_name")]), lit(["x", "y"])])
    return t("nation").with_entry("l", nested).with_entry("flat", ref("l").array_merge_collection().json_encode()).select("n_nationkey", "flat")


@query("""SELECT strftime(d, '%Y-%m-%d') AS day, count(o_orderkey) AS n FROM (SELECT TIMESTAMP '1995-01-31' + to_months(CAST(range AS INTEGER)) AS d FROM range(0, 13))
LEFT JOIN orders ON strftime(o_orderdate, '%Y-%m-%d') = strftime(d, '%Y-%m-%d') GROUP BY 1""")
def sequence_recurrences(t, spark):
    """The orders of the last day of each of 13 months."""
    days = memory.from_sequence_date_period_recurrences(spark, "d", "1995-01-31", "1 month", 12).with_entry("day", ref("d").date_format("Y-m-d")).select("day")
    counts = t("orders").with_entry("at", ref("o_orderdate").date_format("Y-m-d")).group_by("at").aggregate(fn.count("o_orderkey").alias("n"))
    return days.join(counts, {"day": "at"}).with_entry("n", fn.when(ref("n").is_null(), 0, ref("n")).cast("int")).select("day", "n")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal <= 0")
def chained_sources(t, spark):
    c = t("customer").select("c_custkey", "c_acctbal")
    return from_all(c.filter(ref("c_acctbal").greater_than(5000)), c.filter(ref("c_acctbal").less_than_equal(0)))


@query("SELECT p_partkey, '<b>' || p_name || '</b>' AS node, p_name AS text FROM part")
def xpath_nodes(t, spark):
    f = t("part").with_entry("node", fn.concat("<b>", ref("p_name"), "</b>"))
    return f.with_entry("text", ref("node").xpath("/b/text()").array_get("0")).select("p_partkey", "node", "text")


@query("SELECT c_nationkey, CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS long_enough FROM customer GROUP BY 1")
def identifiers(t, spark):
    f = t("customer").with_entries({"a": fn.uuid_v4(), "b": fn.uuid_v7(), "c": fn.ulid(), "d": fn.random_string(8)})
    ok = fn.all_(ref("a").size().equals(36), ref("b").regex_match("/^.{14}7/"), ref("c").size().equals(26), ref("d").size().equals(8))
    return f.with_entry("ok", ok).group_by("c_nationkey").aggregate(fn.count("a").alias("n"), fn.sum_(ref("ok").cast("int")).alias("long_enough"))


# extensions: event time


@query("""SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def tumbling_windows(t, spark):
    from .streaming.streams import windowed

    f = windowed(t("events"), "ts", "1 hour", fn.count("event_id").alias("n"), fn.sum_("value").alias("total"), keys=("event_type",))
    return f.with_entries({"start": ref("window_start").date_time_format("Y-m-d H:i"), "total": ref("total").round(2)}).select("start", "event_type", "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events),
 s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
 SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def session_windows(t, spark):
    from .streaming.streams import sessions

    f = sessions(t("events"), "ts", "30 minutes", fn.count("event_id").alias("n"), keys=("user_id",))
    return f.with_entry("start", ref("window_start").date_time_format("Y-m-d H:i:s")).select("user_id", "start", "n")


# verbs and functions by themselves


@query("""SELECT c_custkey, c_nationkey <> 3 AS ne, c_acctbal >= 0 AS ge, c_name IS NOT NULL AS there, TRUE AS worded, c_nationkey <> 4 AS ns FROM customer""")
def comparisons_negated(t, spark):
    e = {"ne": ref("c_nationkey").not_equals(3), "ge": ref("c_acctbal").greater_than_equal(0), "there": ref("c_name").is_not_null(), "worded": ref("c_name").is_not_numeric(), "ns": ref("c_nationkey").not_same(4)}
    return t("customer").with_entries(e).select("c_custkey", *e)


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus <> 'F' AND o_orderpriority IS NOT NULL")
def filters_listed(t, spark):
    return t("orders").filters(ref("o_totalprice").greater_than_equal(100000), ref("o_orderstatus").not_equals("F"), ref("o_orderpriority").is_not_null()).select("o_orderkey")


@query("SELECT n_nationkey, n_name AS a, CAST(NULL AS VARCHAR) AS b, CAST(NULL AS VARCHAR) AS c FROM nation")
def optional_columns(t, spark):
    e = {"a": fn.optional(ref("n_name")), "b": fn.optional(ref("absent").upper()), "c": fn.optional(ref("n_nationkey").array_get("x"))}
    return t("nation").with_entries(e).select("n_nationkey", *e)


@query("SELECT p_partkey, regexp_matches(p_brand, '#\\d') AS every, TRUE AS searched FROM part")
def regex_match_all(t, spark):
    e = {"every": ref("p_brand").regex_match_all(r"/#\d/"), "searched": ref("p_brand").regex_match_all("/nowhere/", compat=True)}
    return t("part").with_entries(e).select("p_partkey", *e)


@query("SELECT n_regionkey, CAST(to_json(list({'n_name': n_name} ORDER BY n_nationkey)) AS VARCHAR) AS names, arg_min(n_name, n_nationkey) AS first_name FROM nation GROUP BY 1")
def collection_keys(t, spark):
    rows = t("nation").select("n_nationkey", "n_name", "n_regionkey").group_to_array("n_regionkey", "rows")
    f = rows.with_entries({"names": ref("rows").array_get_collection("n_name").json_encode(), "one": ref("rows").array_get_collection_first("n_name")})
    return f.with_entry("first_name", ref("one").array_get("n_name")).select("n_regionkey", "names", "first_name")


@query("SELECT n_nationkey, CAST(to_json({'nation_name': n_name, 'region_key': n_regionkey}) AS VARCHAR) AS j FROM nation")
def keys_style_convert(t, spark):
    from .functions.expr import Expr

    s = Expr(lambda ctx: F.struct(F.col("n_name").alias("nationName"), F.col("n_regionkey").alias("regionKey")))
    return t("nation").with_entry("s", s).with_entry("j", ref("s").array_keys_style_convert("snake").json_encode()).select("n_nationkey", "j")


@query('SELECT n_name AS "N_name", n_nationkey AS "N_nationkey" FROM nation')
def rename_upper_first(t, spark):
    return t("nation").select("n_name", "n_nationkey").rename_all_upper_case_first()


@query('SELECT n_name AS "Nation Name", n_nationkey AS "Nation Key" FROM nation')
def rename_upper_word(t, spark):
    return t("nation").select("n_name", "n_nationkey").rename("n_name", "nation name").rename("n_nationkey", "nation key").rename_all_upper_case_word()


@query("SELECT n_nationkey, n_name FROM nation")
def entries_sorted(t, spark):
    return t("nation").select("n_nationkey", "n_name").sort_entries()


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sort_descending_take(t, spark):
    return t("orders").sort_by((ref("o_totalprice"), False), "o_orderkey").take(25).select("o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10")
def sort_ascending_take(t, spark):
    return t("orders").sort_descending("o_orderkey").sort_ascending("o_orderkey").take(10).select("o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 10")
def reverse_take(t, spark):
    return t("orders").sort_by("o_orderkey").reverse().take(10).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (ORDER BY l_quantity DESC, l_orderkey DESC, l_linenumber DESC) > 1000")
def drop_right_ties(t, spark):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity").drop_right(1000, "l_quantity")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (ORDER BY l_quantity DESC, l_orderkey DESC, l_linenumber DESC) <= 77")
def take_right_ties(t, spark):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity").take_right(77, "l_quantity")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (ORDER BY l_quantity, l_orderkey, l_linenumber) <> 501")
def remove_one_of_ties(t, spark):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity").remove(500, "l_quantity")


@query("SELECT n_nationkey, upper(n_comment) AS c FROM (SELECT n_nationkey, n_name AS n_comment FROM nation)")
def map_rows(t, spark):
    return t("nation").select("n_nationkey", "n_name").map(lambda r: {"n_nationkey": r["n_nationkey"], "c": r["n_name"].upper()}, "n_nationkey long, c string").select("n_nationkey", "c").with_entry("n_nationkey", ref("n_nationkey").cast("int"))


@query("SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS word FROM nation")
def flat_map_rows(t, spark):
    return t("nation").batch_size(7).flat_map(lambda r: [{"n_nationkey": r["n_nationkey"], "word": w} for w in r["n_name"].split(" ")], "n_nationkey int, word string")


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_each_inner(t, spark):
    lookup = lambda asked: t("nation").join(asked.rename("s_nationkey", "asked"), {"n_nationkey": "asked"}, "inner")  # noqa: E731 - only the keys that are asked for
    return t("supplier").join_each(lookup, {"s_nationkey": "n_nationkey"}, "inner", keys=["s_nationkey"]).select("s_suppkey", "n_name")


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def join_each_anti(t, spark):
    return t("customer").select("c_custkey", "c_nationkey").join_each(lambda asked: t("supplier"), {"c_nationkey": "s_nationkey"}, "left_anti").select("c_custkey")


@query("SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_each_right(t, spark):
    return t("supplier").join_each(lambda asked: t("nation"), {"s_nationkey": "n_nationkey"}, "right").select("s_suppkey", "n_name")


@query("SELECT a.c_custkey, b.c_custkey AS other_c_custkey, b.c_acctbal * 2 AS other_c_acctbal FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey + 1")
def join_derived(t, spark):
    c = t("customer").select("c_custkey", "c_acctbal")
    other = c.with_entries({"next": ref("c_custkey").plus(1), "c_acctbal": ref("c_acctbal").multiply(2)})
    return c.join(other, join_on({"c_custkey": "next"}, "other_"), "inner").select("c_custkey", "other_c_custkey", "other_c_acctbal")


@query("SELECT s_suppkey, c_custkey FROM supplier LEFT JOIN customer ON s_nationkey = c_custkey OR s_suppkey = c_custkey")
def join_any_left(t, spark):
    on = join_on(compare_any(equal("s_nationkey", "c_custkey"), equal("s_suppkey", "c_custkey")))
    return t("supplier").select("s_suppkey", "s_nationkey").join(t("customer").select("c_custkey"), on, "left").select("s_suppkey", "c_custkey")


@query("SELECT c_custkey, rate FROM customer JOIN (VALUES ('BUILDING', 1.5), ('MACHINERY', 2.0), ('FURNITURE', NULL)) v(s, rate) ON c_mktsegment = s")
def array_source(t, spark):
    """A table's rows with those of a list."""
    rates = memory.from_array(spark, [{"s": "BUILDING", "rate": 1.5}, {"s": "MACHINERY", "rate": 2.0}, {"s": "FURNITURE"}])
    return t("customer").join(rates, {"c_mktsegment": "s"}, "inner").select("c_custkey", "rate")


@query("SELECT CAST(n_regionkey AS BIGINT) AS task, n_name FROM nation")
def generator_source(t, spark):
    """A generator for each region, which yields the region's nations."""
    from .sources.remote import from_generator

    names: dict[int, list[str]] = {}
    for r in t("nation").fetch():
        names.setdefault(r.n_regionkey, []).append(r.n_name)
    return from_generator(spark, lambda i: ({"task": i, "n_name": n} for n in names.get(i, [])), "task long, n_name string", tasks=t("region").count())


@query("SELECT n_nationkey, n_name FROM nation")
def cached_source(t, spark):
    from .operators.frame import from_cache

    return from_cache(spark, "catalogue-nations", fallback=t("nation").select("n_nationkey", "n_name"), clear=False).select("n_nationkey", "n_name")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def stored_cache(t, spark):
    import uuid

    from .cache import FilesystemCache
    from .operators.frame import from_cache

    store, name = FilesystemCache(), f"nations-{uuid.uuid4().hex}"
    t("nation").select("n_nationkey", "n_name").cache(name, store)
    return from_cache(spark, name, store=store).with_entry("n_nationkey", ref("n_nationkey").cast("int"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def partition_folders(t, spark):
    from .sinks import to_parquet
    from .sources.files import from_path_partitions

    orders = t("orders").select("o_orderkey", "o_orderstatus")
    folders = _round_trip(orders, spark, to_parquet, from_path_partitions, ("o_orderstatus",))
    names = folders.with_entry("o_orderstatus", ref("partitions").array_get("o_orderstatus")).select("o_orderstatus").unique()
    return names.join(orders.group_by("o_orderstatus").aggregate(fn.count("o_orderkey").alias("n")), join_on({"o_orderstatus": "o_orderstatus"}, "r_"), "inner").select("o_orderstatus", "r_n").rename("r_n", "n")


@query("SELECT o_orderkey FROM orders")
def partitions_dropped(t, spark):
    return t("orders").select("o_orderkey", "o_orderstatus").partition_by("o_orderstatus").drop_partitions(drop_columns=True)


@query("SELECT 'parquet' AS extension, TRUE AS is_file, TRUE AS some")
def files_listed(t, spark):
    from .sinks import to_parquet
    from .sources.files import files

    f = _round_trip(t("nation"), spark, to_parquet, files)
    f = f.filter(fn.all_(ref("extension").equals("parquet"), ref("is_dir").equals(False))).group_by("extension", "is_file").aggregate(fn.sum_("size").alias("bytes"))
    return f.with_entry("some", ref("bytes").greater_than(0)).select("extension", "is_file", "some")


@query("SELECT s_suppkey::BIGINT AS s_suppkey, s_name || chr(10) || 'second line' AS s_name FROM supplier")
def csv_line_ends(t, spark):
    from .sinks import to_csv
    from .sources.files import from_csv

    f = t("supplier").with_entry("s_name", fn.concat(ref("s_name"), lit("\n"), lit("second line"))).select("s_suppkey", "s_name")
    return _round_trip(f, spark, to_csv, lambda s, p: from_csv(s, p, separator=",", enclosure='"', multi_line=True)).with_entry("s_suppkey", ref("s_suppkey").cast("int"))


@query("SELECT n_name FROM nation")
def xml_by_path(t, spark):
    from .sinks import to_xml
    from .sources.files import from_xml

    nodes = _round_trip(t("nation").select("n_name"), spark, lambda p: to_xml(p, "nations", "nation"), lambda s, p: from_xml(s, p, "nations/nation"))
    return nodes.with_entry("n_name", ref("node").dom_element_value("/nation/n_name")).select("n_name")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '2026-01-01'")
def now_is_later(t, spark):
    return t("orders").with_entry("now", fn.now()).filter(ref("now").greater_than(ref("o_orderdate"))).select("o_orderkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def find_rows(t, spark):
    return t("nation").find(ref("n_regionkey").equals(1)).collect().select("n_nationkey", "n_name")


@query("SELECT r_name, r_regionkey FROM region")
def reorder_by_type(t, spark):
    return t("region").select("r_name", "r_regionkey").reorder_entries("type_and_name")


from . import catalog_actions, catalog_more  # noqa: E402, F401 - they add their queries to these
