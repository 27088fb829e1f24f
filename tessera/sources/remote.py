"""Databases, HTTP and search services. Connections and clients are callables, opened where the rows are read."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.frame import Frame, arrow_mapped


def from_jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None, partition_column: str | None = None, bounds: tuple | None = None, partitions: int | None = None, **options) -> Frame:
    """A table or query through a JDBC driver; with a partition column, in parallel ranges."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    reader = reader.option("dbtable", table) if table else reader.option("query", query)
    if partition_column:
        reader = reader.options(partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return Frame(reader.load())


def _fetched(rows: DataFrame, fetch: Callable[[dict], Iterator[dict]], schema: T.StructType | str) -> DataFrame:
    """The rows that ``fetch`` yields for each request row, a request a task at most as often as Spark retries."""
    return arrow_mapped(rows, fetch, schema)


def from_generator(spark: SparkSession, make: Callable[[int], Iterator[dict]], schema: T.StructType | str, tasks: int = 1) -> Frame:
    """The rows of ``make(i)`` for each i below ``tasks``, each in a task of its own."""
    return Frame(_fetched(spark.range(0, tasks, 1, tasks), lambda r: make(r["id"]), schema))


def from_db_queries(spark: SparkSession, connect: Callable, query: str, parameter_sets: list[tuple], schema: T.StructType | str, fetch_size: int = 1000) -> Frame:
    """One run of the query for each set of parameters, each in a task of its own, over DB-API connections; rows are fetched ``fetch_size`` at a time."""
    requests = spark.createDataFrame([(i,) for i in range(len(parameter_sets))], "i int").repartition(max(1, len(parameter_sets)), "i")

    def fetch(request):
        connection = connect()
        try:
            cursor = connection.cursor()
            cursor.execute(query, parameter_sets[request["i"]])
            names = [d[0] for d in cursor.description]
            while rows := cursor.fetchmany(fetch_size):
                yield from (dict(zip(names, r)) for r in rows)
        finally:
            connection.close()

    return Frame(_fetched(requests, fetch, schema))


def from_db_query(spark: SparkSession, connect: Callable, query: str, schema: T.StructType | str, parameters: tuple = ()) -> Frame:
    return from_db_queries(spark, connect, query, [parameters], schema)


def from_db_limit_offset(spark: SparkSession, connect: Callable, table: str, order_by: list[str], schema: T.StructType | str, page_size: int = 1000, maximum: int | None = None) -> Frame:
    """A table in pages of a stable order. An offset costs the database all rows before it, so that neighbouring pages are one query, of which there are at
    most four for each core, and a task takes ``page_size`` rows of it at a time. Where the order is by a unique key, ``from_db_keyset`` reads each row once."""
    if not order_by:
        raise ValueError("pages need an order")
    connection = connect()
    try:
        cursor = connection.cursor()
        cursor.execute(f"SELECT count(*) FROM {table}")
        total = cursor.fetchone()[0]
    finally:
        connection.close()
    total = total if maximum is None else min(total, maximum)
    sql = f"SELECT * FROM {table} ORDER BY {', '.join(order_by)} LIMIT ? OFFSET ?"
    each = page_size * max(1, -(-total // (page_size * 4 * spark.sparkContext.defaultParallelism)))
    pages = [(min(each, total - at), at) for at in range(0, total, each)]
    if not pages:
        return Frame(spark.createDataFrame([], schema))
    return from_db_queries(spark, connect, sql, pages, schema, page_size)


HTTP = "request_uri string, request_method string, status int, body string"


def _call(client, method: str, uri: str, body: str | None) -> dict:
    status, text = client(method, uri, body)
    return {"request_uri": uri, "request_method": method, "status": status, "body": text}


def from_static_http_requests(spark: SparkSession, client: Callable[[str, str, str | None], tuple[int, str]], requests: list[tuple]) -> Frame:
    """A row for each (method, uri[, body]); the client runs in the tasks."""
    rows = spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None) for r in requests], "method string, uri string, body string")
    return Frame(_fetched(rows, lambda r: iter([_call(client, r["method"], r["uri"], r["body"])]), HTTP))


def from_dynamic_http_requests(spark: SparkSession, client: Callable, following: Callable[[dict | None], tuple | None]) -> Frame:
    """Each request is made from the response before it, so one task makes them all in turn."""

    def run(batches):
        for _ in batches:
            last = None
            while (request := following(last)) is not None:
                last = _call(client, request[0], request[1], request[2] if len(request) > 2 else None)
                yield pa.RecordBatch.from_pylist([last], schema=pa.schema([("request_uri", pa.string()), ("request_method", pa.string()), ("status", pa.int32()), ("body", pa.string())]))

    return Frame(spark.range(1).coalesce(1).mapInArrow(run, HTTP))


def from_search_pages(spark: SparkSession, search: Callable[[int, int], list[dict]], total: int, schema: T.StructType | str, page_size: int = 1000) -> Frame:
    """Hits of a search service by offset and limit, pages in parallel."""
    pages = spark.range(0, total, page_size).repartition(max(1, -(-total // page_size)), "id")
    return Frame(_fetched(pages, lambda r: iter(search(int(r["id"]), page_size)), schema))


def _hit(hit: dict) -> dict:
    return {"_id": hit.get("_id")} | hit.get("_source", {})


def from_es(
    spark: SparkSession, search: Callable[[dict], dict], body: dict, schema: T.StructType | str, page_size: int = 1000, open_point_in_time: Callable[[], str] | None = None, slices: int = 1, to_row: Callable[[dict], dict] = _hit
) -> Frame:
    """All hits of a search, a row each (by default its ``_id`` and source). ``search`` posts a body and gives the response.

    A body with a ``sort`` follows the last hit's sort values from page to page (search_after), which reaches any number of hits; one without is paged by
    from and size, which services limit. A point in time, opened once, keeps pages apart from changes; with one, ``slices`` tasks read in parallel."""
    if slices > 1 and open_point_in_time is None:
        raise ValueError("slices need a point in time")
    shared = {"pit": {"id": open_point_in_time(), "keep_alive": "5m"}} if open_point_in_time else {}

    def fetch(request):
        asked = body | shared | {"size": page_size}
        if slices > 1:
            asked["slice"] = {"id": request["id"], "max": slices}
        at = 0
        while hits := search(asked)["hits"]["hits"]:
            yield from map(to_row, hits)
            at += len(hits)
            asked = asked | ({"search_after": hits[-1]["sort"]} if "sort" in body else {"from": at})

    return Frame(_fetched(spark.range(0, slices, 1, slices), fetch, schema))


def from_meilisearch(spark: SparkSession, search: Callable[[dict], dict], parameters: dict, schema: T.StructType | str, page_size: int = 1000) -> Frame:
    """All hits of a search by offset and limit, until a page is empty."""

    def fetch(_):
        at = 0
        while hits := search(parameters | {"offset": at, "limit": page_size})["hits"]:
            yield from hits
            at += len(hits)

    return Frame(_fetched(spark.range(0, 1, 1, 1), fetch, schema))


def hits_to_rows(frame: Frame, column: str = "hits", source: str | None = "_source") -> Frame:
    """A row for each hit of a response column."""
    hit = frame.df.select(F.explode(column).alias("hit"))
    return Frame(hit.select(f"hit.{source}.*" if source else "hit.*"))


es_hits_to_rows = hits_to_rows


def meilisearch_hits_to_rows(frame: Frame, column: str = "hits") -> Frame:
    return hits_to_rows(frame, column, None)


def sheet_range(sheet: str, first_column: str, last_column: str, first_row: int, last_row: int) -> str:
    """A range in A1 notation."""
    if not (first_column.isalpha() and last_column.isalpha() and 1 <= first_row <= last_row):
        raise ValueError("columns are letters, rows count from 1")
    return f"{sheet}!{first_column.upper()}{first_row}:{last_column.upper()}{last_row}"


def from_sheet(spark: SparkSession, read: Callable[[str], list[list]], sheet: str, columns: tuple[str, str] = ("A", "Z"), with_header: bool = True, rows_per_page: int = 1000) -> Frame:
    """A spreadsheet by pages of rows until one is empty; short rows are filled with nulls, long ones cut. A sheet is small: it is read on the driver."""
    rows: list[list] = []
    at = 1
    while page := read(sheet_range(sheet, *columns, at, at + rows_per_page - 1)):
        rows += page
        at += rows_per_page
    if not rows:
        return Frame(spark.createDataFrame([], T.StructType()))
    names = [str(v) for v in rows[0]] if with_header else [f"e{i:02d}" for i in range(max(map(len, rows)))]
    body = [tuple(None if v is None else str(v) for v in [*r, *[None] * len(names)][: len(names)]) for r in rows[with_header:]]
    return Frame(spark.createDataFrame(body, T.StructType([T.StructField(n, T.StringType()) for n in names])))
