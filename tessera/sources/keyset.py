"""Database tables by keyset pages: a Spark data source whose tasks read ranges of a key, page after page from the last key they saw."""

from __future__ import annotations

import base64
import time
from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.frame import Frame

#: Comparisons that a database is asked for besides Spark, which tests every row again.
_SIGNS = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}


def packed(spec: dict) -> str:
    """Options of a Python data source are texts; connections are functions."""
    return base64.b64encode(cloudpickle.dumps(spec)).decode()


def unpacked(options: dict) -> dict:
    return cloudpickle.loads(base64.b64decode(options["spec"]))


def _number(v: Any) -> bool:
    return isinstance(v, (int, float, Decimal)) and not isinstance(v, bool)


class Asked:
    """Conditions and their parameters."""

    def __init__(self, parts: tuple[str, ...] = (), values: tuple = ()) -> None:
        self.parts, self.values = parts, values

    def plus(self, part: str, *values) -> Asked:
        return Asked((*self.parts, part), (*self.values, *values))

    @property
    def sql(self) -> str:
        return " WHERE " + " AND ".join(self.parts) if self.parts else ""


def pushed(filters: list[ds.Filter], columns: list[str]) -> Asked:
    """What of Spark's filters the database can answer without leaving out a row that Spark would keep: numbers are compared, texts only for equality,
    whatever the database's order of texts is."""
    asked = Asked()
    for f in filters:
        path = getattr(f, "attribute", ())
        if len(path) != 1 or path[0] not in columns:
            continue
        name = path[0]
        if type(f) in _SIGNS and (_number(f.value) or (isinstance(f, ds.EqualTo) and isinstance(f.value, str))):
            asked = asked.plus(f"{name} {_SIGNS[type(f)]} ?", f.value)
        elif isinstance(f, ds.In) and f.value and all(_number(v) or isinstance(v, str) for v in f.value):
            asked = asked.plus(f"{name} IN ({', '.join('?' * len(f.value))})", *f.value)
        elif isinstance(f, ds.IsNull):
            asked = asked.plus(f"{name} IS NULL")
        elif isinstance(f, ds.IsNotNull):
            asked = asked.plus(f"{name} IS NOT NULL")
    return asked


class Range(ds.InputPartition):
    """Rows with low <= first key column < high; None: open."""

    def __init__(self, low: Any, high: Any) -> None:
        self.low, self.high = low, high


class KeysetReader(ds.DataSourceReader):
    def __init__(self, spec: dict, schema: T.StructType) -> None:
        self.spec, self.schema, self.asked = spec, schema, Asked()

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        self.asked = pushed(filters, self.schema.names)
        yield from filters  # Spark tests all of them again

    def partitions(self) -> list[Range]:
        first = self.spec["keys"][0]
        cuts = self.spec["splits"]
        if cuts is None:
            connection = self.spec["connect"]()
            try:
                cursor = connection.cursor()
                cursor.execute(f"SELECT min({first}), max({first}) FROM {self.spec['table']}{self.asked.sql}", self.asked.values)
                low, high = cursor.fetchone()
            finally:
                connection.close()
            if not _number(low) or not _number(high):
                cuts = []
            else:
                n = self.spec["ranges"]
                cuts = sorted({low + (high - low) * i // n if isinstance(low, int) and isinstance(high, int) else low + (high - low) * i / n for i in range(1, n)} - {low})
        ends = [None, *cuts, None]
        return [Range(a, b) for a, b in zip(ends, ends[1:])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """A page is asked for by the last key of the page before. A connection that fails is opened anew and asked for the same page, so that
        nothing is read twice; a task that Spark runs again begins its range anew, and Spark drops what the lost one had given."""
        from pyspark.sql.pandas.types import to_arrow_schema

        spec, names = self.spec, self.schema.names
        keys, size, most = spec["keys"], spec["page"], spec["maximum"]
        base = self.asked
        if partition.low is not None:
            base = base.plus(f"{keys[0]} >= ?", partition.low)
        if partition.high is not None:
            base = base.plus(f"{keys[0]} < ?", partition.high)
        wanted = [*names, *[k for k in keys if k not in names]]
        kind = to_arrow_schema(self.schema)
        last, given, failures, connection = None, 0, 0, None
        try:
            while most is None or given < most:
                n = size if most is None else min(size, most - given)
                asked = base
                if last is not None:
                    row = f"({', '.join(keys)}) > ({', '.join('?' * len(keys))})" if len(keys) > 1 else f"{keys[0]} > ?"
                    asked = base.plus(row, *last)
                try:
                    connection = connection or spec["connect"]()
                    cursor = connection.cursor()
                    cursor.execute(f"SELECT {', '.join(wanted)} FROM {spec['table']}{asked.sql} ORDER BY {', '.join(keys)} LIMIT {n}", asked.values)
                    rows = cursor.fetchall()
                except Exception:
                    failures += 1
                    if failures > spec["retries"]:
                        raise
                    connection = None
                    time.sleep(min(0.1 * 2**failures, 5))
                    continue
                failures = 0
                if rows:
                    at = [wanted.index(k) for k in keys]
                    last = tuple(rows[-1][i] for i in at)
                    if None in last:
                        raise ValueError("a key column is null")
                    given += len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)], schema=kind)
                if len(rows) < n:
                    break
        finally:
            if connection is not None:
                connection.close()


class KeysetSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_keyset"

    def reader(self, schema: T.StructType) -> KeysetReader:
        return KeysetReader(unpacked(dict(self.options)), schema)


def from_db_keyset(
    spark: SparkSession, connect: Callable, table: str, keys: str | list[str], schema: T.StructType | str, page_size: int = 1000, ranges: int | None = None, splits: list | None = None, maximum: int | None = None, retries: int = 3
) -> Frame:
    """The columns of ``schema`` of a table, over DB-API connections (with ``?`` as their mark) that ``connect`` opens in the tasks.

    ``keys`` name columns that are unique together, never null, and indexed. A task reads one of ``ranges`` (four for each core) equal parts of a numeric first key, or what lies
    between ``splits``; other keys are read by one task. It reads pages of ``page_size`` rows, each found by the index from the last key on: every row is read once, where pages by offset read
    the rows before them again. Filters on numbers, equality of texts and tests for null go to the database. ``maximum`` keeps the first rows of the key's order, and no range reads more.
    A page whose connection fails is asked for ``retries`` times more. An empty table gives no rows."""
    keys = [keys] if isinstance(keys, str) else keys
    if not keys:
        raise ValueError("pages need a key")
    kind = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(KeysetSource)
    spec = {"connect": connect, "table": table, "keys": keys, "page": page_size, "ranges": ranges or 4 * spark.sparkContext.defaultParallelism, "splits": splits, "maximum": maximum, "retries": retries}
    df: DataFrame = spark.read.format(KeysetSource.name()).schema(kind).option("spec", packed(spec)).load()
    if maximum is not None:
        if not set(keys) <= set(kind.names):
            raise ValueError("a maximum needs the key among the columns")
        df = df.orderBy(*[F.col(f"`{k}`") for k in keys]).limit(maximum)
    return Frame(df)
