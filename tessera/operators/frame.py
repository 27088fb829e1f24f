"""Frame: an immutable, lazy wrapper of a Spark DataFrame with the library's verbs."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import cache
from ..functions.aggregates import Agg, sort_column
from ..functions.expr import Context, Expand, Expr, Unpack, all_, as_expr
from ..functions.styles import restyle
from ..schema import Schema, auto_cast, validated
from . import joins

MODES = {"append": "append", "overwrite": "overwrite", "ignore": "ignore", "exception_if_exists": "error", "error": "error"}
#: Order of columns by type (fixed values): identifiers and numbers first, nested values last.
TYPE_ORDER = (T.LongType, T.IntegerType, T.DoubleType, T.FloatType, T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType, T.StringType, T.ArrayType, T.MapType, T.StructType, T.VariantType)
def arrow_mapped(df: DataFrame, function: Callable[[dict], Iterator[dict]], schema: T.StructType | str, batch: int | None = None) -> DataFrame:
    """The rows that ``function`` makes of each row, both as dictionaries. Values go through Arrow as they are: a long stays one beside nulls."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = df.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, batch or max(1, whole.num_rows)):
                rows = whole.slice(at, batch or whole.num_rows).to_pylist(maps_as_pydicts="lossy")
                made = [x for r in rows for x in function(r)]
                if made:
                    yield pa.RecordBatch.from_pylist(made, schema=arrow)

    return df.mapInArrow(run, kind)


def _ties(df: DataFrame) -> list[Column]:
    """The columns that can be ordered: they settle the place of rows with one key."""

    def orders(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return orders(kind.elementType)
        if isinstance(kind, T.StructType):
            return all(orders(f.dataType) for f in kind)
        return not isinstance(kind, (T.MapType, T.VariantType))

    return [F.col(f"`{f.name}`") for f in df.schema if orders(f.dataType)]


class Report:
    def __init__(self, schema: Schema, rows: int) -> None:
        self.schema, self.rows = schema, rows


class Frame:
    def __init__(self, df: DataFrame, mode: str = "exception_if_exists", partitions: tuple[str, ...] = (), on_error: str = "throw", batch: int | None = None, orders: tuple = (), rejects: tuple[DataFrame, ...] = ()) -> None:
        self.df, self._mode, self._partitions, self._on_error, self._batch, self._orders, self._rejects = df, mode, partitions, on_error, batch, orders, rejects

    def _with(self, df: DataFrame | None = None, **changes) -> Frame:
        state = {"mode": self._mode, "partitions": self._partitions, "on_error": self._on_error, "batch": self._batch, "rejects": self._rejects} | changes
        return Frame(self.df if df is None else df, **state)

    @property
    def ctx(self) -> Context:
        return Context(self.df)

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    # columns
    def select(self, *items: str | Expr) -> Frame:
        """These columns in order; one that is not there is a null text."""
        ctx, out = self.ctx, []
        for item in items:
            e = as_expr(item)
            plain = isinstance(item, str) and not ctx.has(item)
            out.append((F.lit(None).cast("string") if plain else e.resolve(ctx)).alias(e.name or "value"))
        return self._with(self.df.select(*out))

    def drop(self, *names: str) -> Frame:
        return self._with(self.df.drop(*names))

    def with_entry(self, name: str, e: Any) -> Frame:
        from ..functions.expr import lift

        e, ctx = e if isinstance(e, Column) else lift(e), self.ctx
        if isinstance(e, Unpack):
            return self._with(self.df.withColumns({f"{name}.{k}": c for k, c in e.columns(ctx).items()}))
        if self._on_error == "skip" and isinstance(e, Expr) and e.source is not None:
            failed = e.source.resolve(ctx).isNotNull() & e.resolve(ctx).isNull()
            return self._sorted_out(self.df.withColumn("_reason", F.when(failed, F.lit(f"{name} has no such value")))).with_entry(name, e.resolve(ctx))
        return self._with(self.df.withColumn(name, e if isinstance(e, Column) else e.resolve(ctx)))

    def _sorted_out(self, tagged: DataFrame) -> Frame:
        """Rows without a ``_reason`` go on, the others are kept apart as (row, reason)."""
        own = [F.col(f"`{c}`") for c in tagged.columns if c != "_reason"]
        bad = tagged.where("_reason IS NOT NULL").select(F.to_json(F.struct(*own)).alias("row"), F.col("_reason").alias("reason"))
        return self._with(tagged.where("_reason IS NULL").drop("_reason"), rejects=(*self._rejects, bad))

    def rejected(self) -> Frame:
        """(row, reason): the rows that steps after ``on_error("skip")`` have left out, as JSON texts, to be written where failures go. It is computed from the frame's
        own plan when it is read."""
        if not self._rejects:
            return self._with(self.df.sparkSession.createDataFrame([], "row string, reason string"), rejects=())
        return self._with(functools.reduce(DataFrame.unionAll, self._rejects), rejects=())

    def with_entries(self, entries: dict[str, Any]) -> Frame:
        """One after the other: later ones see earlier ones."""
        return functools.reduce(lambda f, kv: f.with_entry(*kv), entries.items(), self)

    def rename(self, name: str, new: str) -> Frame:
        if name not in self.columns:
            raise KeyError(f"no column {name}")
        return self._with(self.df.withColumnRenamed(name, new))

    def _named(self, change: Callable[[str], str]) -> Frame:
        return self._with(self.df.toDF(*map(change, self.columns)))

    def rename_all(self, search: str, replace: str) -> Frame:
        return self._named(lambda n: n.replace(search, replace))

    def rename_all_lower_case(self) -> Frame:
        return self._named(str.lower)

    def rename_all_upper_case(self) -> Frame:
        return self._named(str.upper)

    def rename_all_upper_case_first(self) -> Frame:
        return self._named(lambda n: n[:1].upper() + n[1:])

    def rename_all_upper_case_word(self) -> Frame:
        return self._named(lambda n: re.sub(r"(^|\s)(\S)", lambda m: m[1] + m[2].upper(), n))

    def rename_all_style(self, style: str) -> Frame:
        return self._named(lambda n: restyle(n, style))

    def reorder_entries(self, by: str = "name", descending: bool = False) -> Frame:
        """By ``name``, ``type``, or ``type_and_name``."""

        def place(n: str) -> int:
            kind = self.df.schema[n].dataType
            return next((i for i, t in enumerate(TYPE_ORDER) if isinstance(kind, t)), len(TYPE_ORDER))

        keys = {"name": lambda n: n, "type": place, "type_and_name": lambda n: (place(n), n)}
        return self._with(self.df.select(*[f"`{n}`" for n in sorted(self.columns, key=keys[by], reverse=descending)]))

    def auto_cast(self) -> Frame:
        return self._with(auto_cast(self.df))

    def cast_xml(self, name: str, schema: T.StructType | None = None) -> Frame:
        """XML texts as nested values: elements with ``@attributes``, ``@value`` and their children. Without a schema it is merged over all rows first."""
        from ..functions.markup import cast_xml

        return self._with(cast_xml(self.df, name, schema))

    def xml_text(self, name: str) -> Frame:
        """Nested values in the form of ``cast_xml`` as XML texts."""
        from ..functions.markup import xml_text

        return self._with(self.df.withColumn(name, xml_text(F.col(f"`{name}`"), self.df.schema[name].dataType)))

    # rows
    def filter(self, e: Expr) -> Frame:
        return self._with(self.df.where(e.predicate(self.ctx)))

    def filters(self, *parts: Expr) -> Frame:
        return self.filter(all_(*parts))

    def filter_partitions(self, e: Expr) -> Frame:
        """The same predicate; on partition columns it prunes the files that are read."""
        return self.filter(e)

    def until(self, e: Expr, order_by: str | list[str]) -> Frame:
        """Rows before the first one, by ``order_by``, that fails the predicate. The first failing key is one aggregate: nothing is sorted."""
        keys = [order_by] if isinstance(order_by, str) else order_by
        ctx = self.ctx
        key = F.struct(*[F.col(f"`{k}`") for k in keys])
        from ..functions.expr import truthy

        stop = self.df.where(~truthy(e, ctx)).agg(F.min(key).alias("_stop"))
        joined = self.df.join(F.broadcast(stop))  # one row
        return self._with(joined.where(F.col("_stop").isNull() | (key < F.col("_stop"))).drop("_stop"))

    def limit(self, n: int) -> Frame:
        if n <= 0:
            raise ValueError("a limit is positive")
        return self._with(self.df.limit(n))

    def offset(self, n: int) -> Frame:
        return self._with(self.df.offset(n))

    def sort_by(self, *orders) -> Frame:
        """Nulls are smallest."""
        return self._with(self.df.orderBy(*[sort_column(o, self.ctx) for o in orders]), orders=orders)

    def drop_duplicates(self, *keys: str | Expr, order_by: str | list[str] | None = None) -> Frame:
        """One row for each key; by ``order_by`` the first one, else any."""
        if not keys:
            raise ValueError("at least one key")
        ctx = self.ctx
        names = [k for k in keys if isinstance(k, str) and ctx.has(k)]
        if order_by is None and len(names) == len(keys):
            return self._with(self.df.dropDuplicates(names))
        from pyspark.sql import Window

        columns = [F.lit(None) if isinstance(k, str) and not ctx.has(k) else as_expr(k).resolve(ctx) for k in keys]
        orders = [order_by] if isinstance(order_by, str) else order_by or [self.columns[0]]
        w = Window.partitionBy(*columns).orderBy(*[F.col(f"`{o}`") for o in orders])
        return self._with(self.df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth"))

    def unique(self) -> Frame:
        return self._with(self.df.distinct())

    def union(self, *others: Frame) -> Frame:
        """By name; a column that a side lacks is null."""
        from ..sources.memory import union_all

        return self._with(union_all([self.df, *[o.df for o in others]]))

    merge = add = union

    def _difference(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Rows of ``a`` that ``b`` does not have, each as often as ``a`` has it."""
        condition = functools.reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in a.columns])
        return a.join(b, condition, "left_anti")

    def diff_left(self, other: Frame) -> Frame:
        return self._with(self._difference(self.df, other.df))

    def diff_right(self, other: Frame) -> Frame:
        return self._with(self._difference(other.df, self.df))

    def _split_at(self, n: int, order_by: str, ascending: bool) -> tuple[DataFrame, DataFrame, int] | None:
        """(rows before the key of row n of the order, rows of that key, how many of these come before row n); None if there is no row n. Nulls are smallest.

        One bounded sort finds the key and one aggregate the count; only the key's own rows are ordered further, by their other columns."""
        key = F.struct(F.col(f"`{order_by}`").isNotNull().alias("a"), F.col(f"`{order_by}`").alias("b"))
        found = self.df.select(key.alias("k")).orderBy(F.col("k").asc() if ascending else F.col("k").desc()).offset(n).limit(1).collect()
        if not found:
            return None
        at = F.lit(None) if found[0].k.b is None else F.lit(found[0].k.b).cast(self.df.schema[order_by].dataType)
        column = F.col(f"`{order_by}`")
        same = column.eqNullSafe(at)
        if found[0].k.b is None:
            before = F.lit(False) if ascending else column.isNotNull()
        else:
            before = (column.isNull() | (column < at)) if ascending else F.coalesce(column > at, F.lit(False))
        ahead = self.df.where(before)
        return ahead, self.df.where(same), n - ahead.count()

    def drop_right(self, n: int, order_by: str) -> Frame:
        """Without the last n rows of the order; of rows with one key the greater by their other columns go first."""
        if n <= 0:
            return self
        split = self._split_at(n, order_by, ascending=False)
        if split is None:  # no more than n rows, or just n
            return self._with(self.df.limit(0))
        _, same, taken = split
        column = F.col(f"`{order_by}`")
        key = same.select(column).first()[0]
        rest = self.df.where(F.lit(False) if key is None else column.isNull() | (column < F.lit(key)))
        return self._with(rest.unionAll(same.orderBy(*[c.desc() for c in _ties(same)]).offset(taken)))

    def take_right(self, n: int, order_by: str) -> Frame:
        """The last n rows of the order, last first; ties as in ``drop_right``."""
        return self._with(self.df.orderBy(F.col(f"`{order_by}`").desc(), *[c.desc() for c in _ties(self.df)]).limit(n))

    def take(self, n: int) -> Frame:
        return self.limit(n)

    def skip(self, n: int) -> Frame:
        return self.offset(n)

    def sort_ascending(self, key: str | Expr) -> Frame:
        return self.sort_by((as_expr(key), True))

    def sort_descending(self, key: str | Expr) -> Frame:
        return self.sort_by((as_expr(key), False))

    def reverse(self, *orders) -> Frame:
        """The frame in the reverse of its order: of the ``sort_by`` just before, or of ``orders``. A table without an order has no reverse."""
        given = orders or self._orders
        if not given:
            raise ValueError("a frame without an order has no reverse")
        pairs = [o if isinstance(o, tuple) else (o, True) for o in given]
        return self.sort_by(*[(as_expr(e), not up) for e, up in pairs])

    def sort_entries(self) -> Frame:
        return self.reorder_entries("name")

    def remove(self, position: int, order_by: str) -> Frame:
        """Without the one row at a position, from 0, of the order; rows of one key are ordered by their other columns."""
        split = self._split_at(position, order_by, ascending=True)
        if split is None:
            return self
        _, same, at = split
        column = F.col(f"`{order_by}`")
        others = self.df.where(~column.eqNullSafe(F.lit(same.select(column).first()[0])))
        ordered = same.orderBy(*_ties(same))
        kept = ordered.offset(at + 1)
        return self._with(others.unionAll(ordered.limit(at).unionAll(kept) if at else kept))

    @property
    def is_partitioned(self) -> bool:
        return bool(self._partitions)

    def partition_values(self, *names: str) -> Frame:
        """The distinct partition values as the folders name them: moments as days, all as texts."""
        from ..functions.expr import TIMES

        made = []
        for n in names:
            kind = self.df.schema[n].dataType
            if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
                raise TypeError(f"{n} is nested and cannot name folders")
            made.append((F.date_format(f"`{n}`", "yyyy-MM-dd") if isinstance(kind, TIMES) else F.col(f"`{n}`").cast("string")).alias(n))
        return self._with(self.df.select(*made).distinct())

    # groups and joins
    def group_by(self, *keys: str | Expr) -> Grouped:
        return Grouped(self, tuple(map(as_expr, keys)))

    def aggregate(self, *aggs: Agg) -> Frame:
        return self._with(self.df.agg(*[a.resolve(self.ctx).alias(a.name) for a in aggs]))

    def group_to_array(self, key: str, name: str) -> Frame:
        """All rows of a key as one list of structs."""
        rows = F.sort_array(F.collect_list(F.struct(*[f"`{c}`" for c in self.columns])))
        return self._with(self.df.groupBy(key).agg(rows.alias(name)))

    def join(self, other: Frame, on: joins.On | dict, how: str = "left", match: str = "all", order_by: list[str] | None = None) -> Frame:
        on = on if isinstance(on, joins.On) else joins.join_on(on)
        return self._with(joins.join(self.df, other.df, on, how, match, order_by))

    def join_each(self, factory: Callable[[Frame], Frame], on: joins.On | dict, how: str = "left", keys: list[str] | None = None, batch: int = 1000) -> Frame:
        """The right side is made by ``factory`` from this frame (its distinct keys, if ``keys`` names them), once for all of it: a lookup."""
        asked = self._with(self.df.select(*[f"`{k}`" for k in keys]).distinct()) if keys else self
        return self.join(factory(asked), on, how)

    def cross_join(self, other: Frame, prefix: str = "", compat: bool = False) -> Frame:
        return self._with(joins.cross_join(self.df, other.df, prefix, compat))

    # functions over rows and frames
    def map(self, function: Callable[[dict], dict], schema: T.StructType | str | None = None) -> Frame:
        """A function of each row as a dictionary, in Arrow batches. After ``on_error("skip")`` rows at which it raises are left out, after ``ignore`` they stay as they are."""
        return self._mapped(lambda r: [function(r)], schema or self.df.schema)

    def flat_map(self, function: Callable[[dict], list[dict]], schema: T.StructType | str) -> Frame:
        return self._mapped(function, schema)

    def _mapped(self, function: Callable[[dict], list[dict]], schema: T.StructType | str) -> Frame:
        if self._on_error == "throw":
            return self._with(arrow_mapped(self.df, function, schema, self._batch))
        kind = self.df.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema
        open_ = T.StructType([T.StructField(f.name, f.dataType) for f in kind])
        if self._on_error == "ignore":

            def tried(r: dict) -> list[dict]:
                try:
                    return list(function(r))
                except Exception:  # noqa: BLE001 - any failure of the caller's function leaves the row
                    return [{n: r.get(n) for n in open_.names}]

            return self._with(arrow_mapped(self.df, tried, open_, self._batch))

        def caught(r: dict) -> list[dict]:
            try:
                return list(function(r))
            except Exception as failure:  # noqa: BLE001 - any failure of the caller's function rejects the row
                return [{"_row": json.dumps(r, default=str), "_reason": f"{type(failure).__name__}: {failure}"}]

        both = arrow_mapped(self.df, caught, T.StructType([*open_, T.StructField("_row", T.StringType()), T.StructField("_reason", T.StringType())]), self._batch)
        bad = both.where("_reason IS NOT NULL").select(F.col("_row").alias("row"), F.col("_reason").alias("reason"))
        return self._with(both.where("_reason IS NULL").drop("_row", "_reason"), rejects=(*self._rejects, bad))

    def reduce(self, function: Callable[[Any, dict], Any], initial: Any = None, combine: Callable[[Any, Any], Any] | None = None) -> Any:
        """A fold of all rows as dictionaries. With ``combine`` each task folds its rows, from ``initial``, and the driver combines one value a task; without it
        rows stream to the driver in the frame's order."""
        if combine is None:
            return functools.reduce(function, self.get_each_as_array(), initial)
        import pickle

        def run(batches):
            value, seen = initial, False
            for b in batches:
                for r in b.to_pylist(maps_as_pydicts="lossy"):
                    value, seen = function(value, r), True
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(value)], pa.binary())], names=["value"])

        parts = [pickle.loads(r.value) for r in self.df.mapInArrow(run, "value binary").collect()]
        return functools.reduce(combine, parts) if parts else initial

    def entries(self) -> list[list[tuple[str, Any]]]:
        """Each row's (name, value) pairs, for results that fit the driver."""
        return [list(zip(self.columns, r)) for r in self.fetch()]

    def transform(self, change: Callable[[Frame], Frame]) -> Frame:
        return change(self)

    rows = transform

    def reduce_to_array(self, name: str, order_by: str | None = None) -> list:
        from ..functions.aggregates import collect

        return self.aggregate(collect(name, order_by).alias("x")).df.first().x

    # physical hints
    def collect(self) -> Frame:
        """All rows as one batch: a hint that a distributed plan has no use for."""
        return self

    def batch_size(self, n: int) -> Frame:
        """At most so many rows at a time are made for this frame's Python functions; 0 or less: as they come."""
        return self._with(batch=n if n > 0 else None)

    def cache(self, name: str | None = None, store=None) -> Frame:
        """Kept by the session, under a name or none; or by a store of ``tessera.cache`` that outlives it."""
        return self._with((store or cache.DEFAULT).set(name, self.df) if name else self.df.persist())

    def partition_by(self, *names: str) -> Frame:
        return self._with(self.df.repartition(*[F.col(f"`{n}`") for n in names]), partitions=names)

    def drop_partitions(self, drop_columns: bool = False) -> Frame:
        return self._with(self.df.drop(*self._partitions) if drop_columns else None, partitions=())

    # writing and running
    def mode(self, mode: str) -> Frame:
        if mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        return self._with(mode=mode)

    save_mode = mode

    def on_error(self, how: str) -> Frame:
        """What becomes of rows that fail, here and in the steps that follow. ``throw``: the run fails. ``skip``: the rows are left out, and ``rejected`` has them with the reason. ``ignore``: they stay, with null values.

        Rows fail whose record could not be read (``_corrupt_record``), at which a function of ``map`` or ``flat_map`` raises, or, with ``skip``, whose value a cast, a date or a JSON text
        of an entry cannot be made from (null, else). ``throw`` leaves such entries null, as the rule of expressions is."""
        if how not in ("throw", "skip", "ignore"):
            raise ValueError("throw, skip or ignore")
        df = self.df
        if "_corrupt_record" in df.columns:
            bad = F.col("_corrupt_record").isNotNull()
            if how == "throw":
                df = df.where(F.when(bad, F.raise_error(F.lit("a record could not be read")).cast("boolean")).otherwise(True))
            elif how == "skip":
                reason = F.when(bad, F.lit("a record could not be read"))
                return self._with(on_error=how)._sorted_out(df.withColumn("_reason", reason))
        return self._with(df, on_error=how)

    def validate(self, wanted: Schema, strict: bool = True) -> Frame:
        return self._with(validated(self.df, wanted, strict))

    def write(self, sink: Callable[[DataFrame, str, tuple[str, ...]], None]) -> Frame:
        """Run a sink with this frame's mode and partitions; the frame goes on."""
        sink(self.df, MODES[self._mode], self._partitions)
        return self

    load = write

    def void(self) -> Frame:
        self.df.write.format("noop").mode("overwrite").save()
        return self._with(self.df.where(F.lit(False)))

    def count(self) -> int:
        return self.df.count()

    def fetch(self, limit: int | None = None) -> list[Row]:
        return (self.df if limit is None else self.df.limit(limit)).collect()

    def get_each(self) -> Iterator[Row]:
        return self.df.toLocalIterator(prefetchPartitions=True)

    def get(self, size: int = 1000) -> Iterator[list[Row]]:
        batch: list[Row] = []
        for r in self.get_each():
            batch.append(r)
            if len(batch) == size:
                yield batch
                batch = []
        if batch:
            yield batch

    chunks = get

    def to_array(self) -> list[dict]:
        return [r.asDict(True) for r in self.fetch()]

    def get_each_as_array(self) -> Iterator[dict]:
        return (r.asDict(True) for r in self.get_each())

    def get_as_array(self, size: int = 1000) -> Iterator[list[dict]]:
        return ([r.asDict(True) for r in b] for b in self.get(size))

    def for_each(self, function: Callable[[list[Row]], None] | None = None, size: int = 1000) -> None:
        for b in self.get(size):
            if function:
                function(b)

    each = for_each

    def first(self) -> Row:
        row = self.df.first()
        if row is None:
            raise LookupError("no rows")
        return row

    def find_one(self, e: Expr) -> Row | None:
        return self.filter(e).df.first()

    def find(self, e: Expr) -> Frame:
        return self.filter(e)

    def run(self, analyze: bool = False) -> Report | None:
        """Execute; ``analyze`` counts the rows on their way."""
        if not analyze:
            self.df.write.format("noop").mode("overwrite").save()
            return None
        from pyspark.sql import Observation

        seen = Observation()
        self.df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
        return Report(self.schema(), seen.get["rows"])

    def schema(self) -> Schema:
        return Schema.of(self.df.schema)

    def hash(self) -> str:
        """Of the content, whatever the order of rows."""
        total = self.df.agg(F.sum(F.xxhash64(*[F.to_json(F.struct(f"`{c}`")) for c in self.columns]).cast("decimal(38,0)")).alias("h")).first().h
        return f"{int(total or 0) & (2**64 - 1):016x}"

    def collect_refs(self) -> list[str]:
        return self.columns

    def display(self, limit: int = 20, truncate: int | bool = 20) -> str:
        from ..sinks import ascii_table

        return ascii_table(self.columns, [list(r) for r in self.fetch(limit)], truncate)

    def print_rows(self, limit: int = 20, truncate: int | bool = 20) -> None:
        print(self.display(limit, truncate))

    def print_schema(self) -> None:
        print(self.schema().ascii())

    def __getattr__(self, name: str):
        """Verbs also go by their names in camel case."""
        snake = re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).lower()
        if snake != name and not snake.startswith("_") and hasattr(type(self), snake):
            return getattr(self, snake)
        raise AttributeError(name)


class Grouped:
    def __init__(self, frame: Frame, keys: tuple[Expr, ...], pivot: tuple | None = None, sets: list[tuple[str, ...]] | None = None, level: str = "grouping") -> None:
        self.frame, self.keys, self._pivot, self._sets, self._level = frame, keys, pivot, sets, level

    def grouping_sets(self, *sets: list[str] | tuple[str, ...], level: str = "grouping") -> Grouped:
        """Groups by each of these sets of the keys' names, in one pass; a further capability of this library. ``level`` names a column that tells which keys
        a row leaves out: the sum of powers of two, the last key's being 1. So the null of a key that is left out differs from a null value."""
        names = [k.name for k in self.keys]
        unknown = {n for s in sets for n in s if n not in names}
        if unknown or not sets:
            raise ValueError(f"sets are of the keys {', '.join(map(str, names))}")
        return Grouped(self.frame, self.keys, None, [tuple(s) for s in sets], level)

    def rollup(self, level: str = "grouping") -> Grouped:
        """All keys, then without the last one, and so on to the total."""
        names = [k.name for k in self.keys]
        return self.grouping_sets(*[names[:n] for n in range(len(names), -1, -1)], level=level)

    def cube(self, level: str = "grouping") -> Grouped:
        """Every subset of the keys."""
        import itertools

        names = [k.name for k in self.keys]
        return self.grouping_sets(*[s for n in range(len(names), -1, -1) for s in itertools.combinations(names, n)], level=level)

    def pivot(self, column: str, values: list | None = None) -> Grouped:
        """A column for each value; without ``values`` one distinct query finds them first."""
        return Grouped(self.frame, self.keys, (column, values))

    def aggregate(self, *aggs: Agg) -> Frame:
        ctx = self.frame.ctx
        if self._sets is not None:
            # keys of their own: an aggregate of a key sees its values where the key is left out
            kept = self.frame.df.withColumns({f"_key_{i}": k.resolve(ctx) for i, k in enumerate(self.keys)})
            place = {k.name: F.col(f"_key_{i}") for i, k in enumerate(self.keys)}
            grouped = kept.groupingSets([[place[n] for n in s] for s in self._sets], *place.values())
            made = grouped.agg(F.grouping_id().cast("int").alias(self._level), *[a.resolve(ctx).alias(a.name) for a in aggs])
            return self.frame._with(made.withColumnsRenamed({f"_key_{i}": k.name for i, k in enumerate(self.keys)}))
        keys = [k.resolve(ctx).alias(k.name or f"key_{i}") for i, k in enumerate(self.keys)]
        grouped = self.frame.df.groupBy(*keys)
        if self._pivot:
            if len(aggs) != 1 or len(keys) != 1:
                raise ValueError("a pivot has one key and one aggregate")
            column, values = self._pivot
            # an empty cell stays null: the aggregate's own default for no rows must not fill it
            value = F.when(F.count(F.lit(1)) > 0, aggs[0].resolve(ctx))
            return self.frame._with(grouped.pivot(column, values).agg(value.alias(aggs[0].name)))
        return self.frame._with(grouped.agg(*[a.resolve(ctx).alias(a.name) for a in aggs]))


def from_cache(spark: SparkSession, name: str, fallback: Frame | None = None, clear: bool = False, store=None) -> Frame:
    """The frame that was cached by this name; ``clear``: the store forgets it."""
    store = store or cache.DEFAULT
    df = store.get(spark, name)
    if df is None:
        if fallback is None:
            raise KeyError(f"nothing is cached as {name}")
        return fallback.cache(name, store)
    if clear:
        if store is not cache.DEFAULT:
            raise ValueError("frames are lazy: delete from a store after the frame was read")
        store.held.pop(name)  # the frame in hand stays persisted
    return Frame(df)


__all__ = ["Column", "Expand", "Frame", "Grouped", "Report", "from_cache"]
