"""Queries that run the verbs which act, report or call back, over whole tables, each with equal SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import functions as fn
from . import sinks
from .catalog import _round_trip, query
from .functions import lit, ref
from .operators.frame import Frame
from .session import shared_folder
from .sources.files import from_csv, from_parquet


def _rows(spark, rows, schema: str) -> Frame:
    return Frame(spark.createDataFrame(rows, schema))


@query("SELECT count(*) AS n FROM lineitem")
def count_rows(t, spark):
    return _rows(spark, [(t("lineitem").count(),)], "n long")


@query("SELECT count(*) AS n, 5 AS columns FROM customer")
def run_report(t, spark):
    f = t("customer")
    f.run()
    found = f.run(analyze=True)
    return _rows(spark, [(found.rows, len(found.schema.names))], "n long, columns int")


@query("SELECT 0 AS n, (SELECT count(*) FROM orders) AS kept")
def void_keeps_nothing(t, spark):
    f = t("orders")
    return _rows(spark, [(f.void().count(), f.count())], "n int, kept long")


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS total, max(l_quantity) AS most FROM lineitem")
def reduce_combined(t, spark):
    """A fold in each task, one value a task combined."""

    def fold(a, r):
        return a[0] + r["l_linenumber"], max(a[1], r["l_quantity"])

    total = t("lineitem").select("l_linenumber", "l_quantity").reduce(fold, (0, 0.0), lambda a, b: (a[0] + b[0], max(a[1], b[1])))
    return _rows(spark, [total], "total long, most double")


@query("SELECT s_name FROM supplier")
def reduce_to_list(t, spark):
    return _rows(spark, [(x,) for x in t("supplier").reduce_to_array("s_name", "s_name")], "s_name string")


@query("SELECT 'r_regionkey' AS name, r_regionkey::VARCHAR AS value FROM region UNION ALL SELECT 'r_name', r_name FROM region")
def entries_of_rows(t, spark):
    pairs = [(n, str(v)) for row in t("region").select("r_regionkey", "r_name").entries() for n, v in row]
    return _rows(spark, pairs, "name string, value string")


@query("SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1")
def first_of_sorted(t, spark):
    row = t("customer").sort_by(ref("c_acctbal").desc(), "c_custkey").first()
    return _rows(spark, [(row.c_custkey,)], "c_custkey long")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
def find_one_row(t, spark):
    row = t("nation").find_one(ref("n_nationkey").equals(7))
    return _rows(spark, [(row.n_nationkey, row.n_name)], "n_nationkey int, n_name string")


@query("SELECT CAST(i AS INTEGER) AS batch, CAST(least(30, n - 30 * i) AS INTEGER) AS size FROM (SELECT count(*) AS n FROM supplier), range(0, 1000000) r(i) WHERE 30 * i < n")
def batches_of_rows(t, spark):
    return _rows(spark, [(i, len(b)) for i, b in enumerate(t("supplier").get(30))], "batch int, size int")


@query("SELECT s_suppkey, s_name FROM supplier")
def rows_one_by_one(t, spark):
    return _rows(spark, [(r.s_suppkey, r.s_name) for r in t("supplier").get_each()], "s_suppkey long, s_name string")


@query("SELECT n_name, n_regionkey FROM nation")
def rows_as_arrays(t, spark):
    f = t("nation").select("n_name", "n_regionkey")
    each, batches = list(f.get_each_as_array()), [r for b in f.get_as_array(10) for r in b]
    key = lambda r: r["n_name"]
    same = sorted(each, key=key) == sorted(batches, key=key) == sorted(f.to_array(), key=key)
    return _rows(spark, [(r["n_name"], r["n_regionkey"]) for r in each] if same else [], "n_name string, n_regionkey int")


@query("SELECT count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS total FROM supplier")
def for_each_batch(t, spark):
    seen = []
    t("supplier").for_each(lambda rows: seen.append((len(rows), sum(r.s_suppkey for r in rows))), 40)
    return _rows(spark, [(sum(a for a, _ in seen), sum(b for _, b in seen))], "n long, total long")


@query("SELECT TRUE AS same, FALSE AS changed FROM (SELECT count(*) FROM customer)")
def hash_of_content(t, spark):
    """The same for the same rows in any order, another one for other rows."""
    f = t("customer")
    whole = f.hash()
    return _rows(spark, [(f.sort_by(ref("c_name").desc()).hash() == whole, f.filter(ref("c_custkey").greater_than(1)).hash() == whole)], "same boolean, changed boolean")


@query("SELECT column_name AS name FROM (DESCRIBE SELECT * FROM lineitem)")
def schema_of_table(t, spark):
    return _rows(spark, [(n,) for n in t("lineitem").schema().names], "name string")


@query("SELECT column_name AS name FROM (DESCRIBE SELECT * FROM events)")
def refs_of_table(t, spark):
    return _rows(spark, [(n,) for n in t("events").collect_refs()], "name string")


@query("SELECT r_name AS shown FROM region")
def displayed_rows(t, spark):
    """The names that a printed table shows."""
    lines = t("region").select("r_name").display(100, False).splitlines()
    shown = [cells[1].strip() for line in lines if len(cells := line.split("|")) > 2]
    return _rows(spark, [(x,) for x in shown if x != "r_name"], "shown string")


@query("SELECT count(*) AS n FROM supplier")
def rows_to_a_callable(t, spark):
    seen = []
    t("supplier").write(sinks.to_callable(lambda rows: seen.extend(rows), 100))
    return _rows(spark, [(len(seen),)], "n long")


@query("SELECT n_nationkey, n_name FROM nation")
def rows_to_memory(t, spark):
    held: list[dict] = []
    t("nation").select("n_nationkey", "n_name").load(sinks.to_memory(held))
    return _rows(spark, [(r["n_nationkey"], r["n_name"]) for r in held], "n_nationkey int, n_name string")


@query("SELECT o_orderkey, upper(o_orderpriority) AS o_orderpriority FROM orders")
def transformed_before_writing(t, spark):
    f = t("orders").select("o_orderkey", "o_orderpriority")
    change = lambda df: df.withColumn("o_orderpriority", F.upper("o_orderpriority"))
    return _round_trip(f, spark, lambda p: sinks.to_transformation(change, sinks.to_parquet(p)), from_parquet)


@query("SELECT s_suppkey, s_name FROM supplier")
def search_bulk_bodies(t, spark):
    """Bodies of bulk requests, kept as files by a sender that runs in the tasks, and read back."""
    folder = f"{shared_folder(spark)}/bulk-{uuid.uuid4().hex}"

    def send(body: str) -> None:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(folder)
        files.create_dir(path)
        with files.open_output_stream(f"{path}/{uuid.uuid4().hex}.txt") as out:
            out.write(body.encode())

    t("supplier").select("s_suppkey", "s_name").write(sinks.to_search_bulk(send, "suppliers", sinks.entry_id_factory("s_suppkey"), batch_size=500))
    lines = spark.read.text(folder).where(~F.startswith("value", F.lit('{"index"')))
    return lines.select(F.from_json("value", "s_suppkey long, s_name string").alias("x")).select("x.*")


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1")
def rows_of_pages(t, spark):
    """A search service whose pages are what the tables hold: hits by offset, each page a request of its own."""
    counts = [(r.l_suppkey, r["count"]) for r in t("lineitem").df.groupBy("l_suppkey").count().orderBy("l_suppkey").collect()]

    def search(parameters: dict) -> dict:
        at = parameters["offset"]
        return {"hits": [{"l_suppkey": k, "n": n} for k, n in counts[at : at + parameters["limit"]]]}

    from .sources.remote import from_meilisearch

    return from_meilisearch(spark, search, {"q": ""}, "l_suppkey long, n long", page_size=33)


@query("SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def streamed_files(t, spark):
    """The events as a stream of files, each batch in a place of its own, and what they add up to."""
    from .streaming.streams import start, stream_files

    source, base = t("events").df, f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    folder = source.inputFiles()[0].rsplit("/", 1)[0]
    chosen = {} if folder.endswith(".parquet") else {"pathGlobFilter": "events.parquet"}  # a folder of files, or one file among other tables
    stream = stream_files(spark, "parquet", folder, source.schema, **chosen)
    started = start(stream, lambda n: sinks.to_parquet(f"{base}/out/batch={n}"), f"{base}/checkpoint", by_batch=True)
    started.awaitTermination()
    return from_parquet(spark, f"{base}/out").group_by("event_type").aggregate(fn.count("event_id").alias("n"), fn.sum_("event_id").alias("ids"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 5 <> 0")
def rejected_casts(t, spark):
    """Values that no number can be made from leave their rows out."""
    code = fn.when(ref("o_orderkey").mod(5).equals(0), lit("unknown"), ref("o_custkey").cast("string"))
    f = t("orders").with_entry("code", code).on_error("skip").with_entry("o_custkey", ref("code").cast("int"))
    return f.select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, 'ValueError: odd' AS reason FROM customer WHERE c_custkey % 2 = 1")
def rejected_rows(t, spark):
    """Rows at which a function raised, with its reason."""

    def even(r: dict) -> dict:
        if r["c_custkey"] % 2:
            raise ValueError("odd")
        return r

    bad = t("customer").select("c_custkey", "c_name").on_error("skip").map(even).rejected()
    return bad.df.select(F.get_json_object("row", "$.c_custkey").cast("long").alias("c_custkey"), "reason")


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name FROM customer")
def command_line_convert(t, spark):
    """Parquet to CSV by the command line, read back."""
    from .cli import main

    base = f"{shared_folder(spark)}/cli-{uuid.uuid4().hex}"
    t("customer").select("c_custkey", "c_name").write(sinks.to_parquet(f"{base}/in.parquet"))
    main(["convert", f"{base}/in.parquet", f"{base}/out.csv", "--mode", "overwrite"])
    return from_csv(spark, f"{base}/out.csv", separator=",", enclosure='"')
