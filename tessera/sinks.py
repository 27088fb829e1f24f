"""Sinks: each is a function of (frame, Spark save mode, partition columns)."""

from __future__ import annotations

import html
import json
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.expr import Context, Expr
from .functions.expr import to_text as _as_text
from .functions.styles import ATOM, java_pattern

Sink = Callable[[DataFrame, str, tuple[str, ...]], None]


def _writer(df: DataFrame, mode: str, partitions: tuple[str, ...]):
    w = df.write.mode(mode)
    if mode == "overwrite" and partitions:
        w = w.option("partitionOverwriteMode", "dynamic")  # untouched partitions stay
    return w.partitionBy(*partitions) if partitions else w


def to_parquet(path: str, compression: str = "snappy", **options) -> Sink:
    return lambda df, mode, parts: _writer(df, mode, parts).options(compression=compression, **options).parquet(path)


def _flat(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Nested columns as JSON texts, for formats without nesting."""
    out: list[Column] = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) and f.name not in keep
        out.append(_as_text(c, f.dataType).alias(f.name) if nested else c)
    return df.select(*out)


def to_csv(path: str, header: bool = True, separator: str = ",", enclosure: str = '"', escape: str = "\\", new_line: str = "\n", date_time_format: str = ATOM) -> Sink:
    def write(df, mode, parts):
        options = {"header": header, "sep": separator, "quote": enclosure, "escape": escape, "lineSep": new_line, "timestampFormat": java_pattern(date_time_format)}
        _writer(_flat(df), mode, parts).options(**options).csv(path)

    return write


def to_json(path: str, as_array: bool = False) -> Sink:
    """A record a line; ``as_array``: each file is one JSON array, of the rows of one task."""

    def brackets(batches):
        import pyarrow as pa

        mark = "["
        for b in batches:
            if b.num_rows:
                lines = b.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([mark + lines[0], *["," + x for x in lines[1:]]])], names=["value"])
                mark = ","
        if mark == ",":
            yield pa.RecordBatch.from_arrays([pa.array(["]"])], names=["value"])

    def write(df, mode, parts):
        if not as_array:
            return _writer(df, mode, parts).option("ignoreNullFields", "false").json(path)
        rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
        return rows.mapInArrow(brackets, "value string").write.mode(mode).text(path)

    return write


def to_text(path: str) -> Sink:
    def write(df, mode, parts):
        columns = [c for c in df.columns if c not in parts]
        if len(columns) != 1:
            raise ValueError("text files have one column")
        _writer(df, mode, parts).text(path)

    return write


def to_xml(path: str, root: str = "rows", row: str = "row", attribute_prefix: str = "_") -> Sink:
    """Columns whose names begin with the prefix become attributes."""
    return lambda df, mode, parts: _writer(df, mode, parts).format("xml").options(rootTag=root, rowTag=row, attributePrefix=attribute_prefix).save(path)


def to_avro(path: str) -> Sink:
    raise NotImplementedError("Avro is not supported")


def to_jdbc(url: str, table: str, batch_size: int = 1000, **options) -> Sink:
    """Inserts in batches through a JDBC driver."""
    return lambda df, mode, parts: df.write.mode(mode).format("jdbc").options(url=url, dbtable=table, batchsize=batch_size, **options).save()


def conflict_sql(columns: list[str], dialect: str = "postgresql", skip_conflicts: bool = False, conflict_columns: list[str] | None = None, constraint: str | None = None, update_columns: list[str] | None = None) -> tuple[str, str]:
    """The verb before the table, and what follows the rows: the dialect's rule for rows that are there already."""
    changed = update_columns if update_columns is not None else [c for c in columns if c not in (conflict_columns or [])]
    if dialect == "mysql":
        if skip_conflicts:
            return "INSERT IGNORE INTO", ""
        if update_columns is not None:
            return "INSERT INTO", " ON DUPLICATE KEY UPDATE " + ", ".join(f"{c} = VALUES({c})" for c in changed)
        return "INSERT INTO", ""
    if dialect not in ("postgresql", "sqlite"):
        raise ValueError(f"unknown dialect {dialect!r}")
    if skip_conflicts:
        return "INSERT INTO", " ON CONFLICT DO NOTHING"
    if constraint or conflict_columns:
        target = f"ON CONSTRAINT {constraint}" if constraint else f"({', '.join(conflict_columns)})"
        return "INSERT INTO", f" ON CONFLICT {target} DO UPDATE SET " + ", ".join(f"{c} = excluded.{c}" for c in changed)
    return "INSERT INTO", ""


def insert_sql(table: str, columns: list[str], rows: int, dialect: str = "postgresql", **conflicts) -> str:
    """One INSERT of several rows; ``?`` for each value."""
    verb, rule = conflict_sql(columns, dialect, **conflicts)
    one = "(" + ", ".join("?" * len(columns)) + ")"
    return f"{verb} {table} ({', '.join(columns)}) VALUES {', '.join([one] * rows)}{rule}"


def to_table_insert(connect: Callable, table: str, batch_size: int = 1000, dialect: str = "sqlite", job: str | None = None, **conflicts) -> Sink:
    """Bulk inserts over DB-API connections that ``connect`` opens; every row once, whatever tasks are run again (see ``tessera.ledger``). ``conflicts`` (skip_conflicts,
    conflict_columns, update_columns) says what becomes of rows that the table has already. A ``job`` that was written before is not written again."""
    from .ledger import write_once

    return lambda df, mode, parts: write_once(df, {"connect": connect, "table": table, "batch": batch_size, "dialect": dialect, "conflicts": conflicts}, job)


def to_table_update(connect: Callable, table: str, primary: list[str], batch_size: int = 1000, job: str | None = None) -> Sink:
    """Rows of the table with these primary keys get the other columns' values, all in one transaction. A primary key that comes twice is an error, and nothing is changed."""
    from .ledger import write_once

    return lambda df, mode, parts: write_once(df, {"connect": connect, "table": table, "batch": batch_size, "dialect": "sqlite", "primary": primary}, job)


def _decoded(v):
    """JSON texts of lists and objects as what they say."""
    if isinstance(v, str) and v[:1] in "[{":
        try:
            return json.loads(v)
        except ValueError:
            return v
    return v


def bulk_lines(rows: list[dict], index: str, id_of: Callable[[dict], str], action: str = "index") -> str:
    """The body of one bulk request to a search index; JSON texts become objects."""

    lines = []
    for r in rows:
        body = {k: _decoded(v) for k, v in r.items()}
        lines += [json.dumps({action: {"_index": index, "_id": id_of(r)}}), json.dumps({"doc": body} if action == "update" else body, default=str)]
    return "\n".join(lines) + "\n"


def entry_id_factory(column: str) -> Callable[[dict], str]:
    return lambda row: str(row[column])


def hash_id_factory(*columns: str) -> Callable[[dict], str]:
    import hashlib

    return lambda row: hashlib.sha1("\0".join(str(row[c]) for c in columns).encode()).hexdigest()


def _batched(send: Callable[[list[dict]], None], batch_size: int) -> Sink:
    """Batches of rows as dictionaries, sent from the tasks."""

    def write(df, mode, parts):
        def each(rows):
            batch: list[dict] = []
            for r in rows:
                batch.append(r.asDict(True))
                if len(batch) == batch_size:
                    send(batch)
                    batch = []
            if batch:
                send(batch)

        df.foreachPartition(each)

    return write


def to_search_bulk(send: Callable[[str], None], index: str, id_of: Callable[[dict], str], action: str = "index", batch_size: int = 1000) -> Sink:
    """``send`` posts one bulk body; it runs in the tasks. A task that is retried sends the same ids again, which replace themselves."""
    return _batched(lambda rows: send(bulk_lines(rows, index, id_of, action)), batch_size)


def to_meilisearch_bulk_index(update_documents: Callable[[list[dict]], object], wait: Callable[[object], None] | None = None, batch_size: int = 1000) -> Sink:
    """``update_documents`` adds or updates a batch by primary key and gives its task, for which ``wait`` waits; both run in Spark's tasks. JSON texts become objects."""

    def send(rows):
        task = update_documents([{k: _decoded(v) for k, v in r.items()} for r in rows])
        if wait:
            wait(task)

    return _batched(send, batch_size)


to_meilisearch_bulk_update = to_meilisearch_bulk_index


def to_callable(function: Callable[[list], None], batch_size: int = 1000) -> Sink:
    """Batches of rows on the driver, streamed partition by partition."""

    def write(df, mode, parts):
        batch: list = []
        for r in df.toLocalIterator():
            batch.append(r)
            if len(batch) == batch_size:
                function(batch)
                batch = []
        if batch:
            function(batch)

    return write


def to_array(target: list) -> Sink:
    return lambda df, mode, parts: target.extend(r.asDict(True) for r in df.collect())


to_memory = to_array


def to_logger(logger, message: str = "row", level: str = "info") -> Sink:
    return to_callable(lambda rows: [getattr(logger, level)("%s %s", message, r.asDict(True)) for r in rows] and None)


def to_branch(condition: Expr, sink: Sink) -> Sink:
    """Only rows that meet the condition go to the sink."""
    return lambda df, mode, parts: sink(df.where(condition.predicate(Context(df))), mode, parts)


def to_transformation(change: Callable[[DataFrame], DataFrame], sink: Sink) -> Sink:
    return lambda df, mode, parts: sink(change(df), mode, parts)


def to_output(stream=None, limit: int = 20, truncate: int | bool = 20, schema: bool = False) -> Sink:
    def write(df, mode, parts):
        from .schema import Schema

        text = ascii_table(df.columns, [list(r) for r in df.limit(limit).collect()], truncate)
        if schema:
            text += Schema.of(df.schema).ascii()
        print(text, file=stream)

    return write


def to_stdout(**options) -> Sink:
    return lambda df, mode, parts: to_output(sys.stdout, **options)(df, mode, parts)


def to_stderr(**options) -> Sink:
    return lambda df, mode, parts: to_output(sys.stderr, **options)(df, mode, parts)


def to_stream(stream, **options) -> Sink:
    return to_output(stream, **options)


def ascii_table(columns: list[str], rows: list[list], truncate: int | bool = 20) -> str:
    """A table with a border and a count; longer values are cut to ``truncate`` characters."""
    most = 20 if truncate is True else int(truncate)

    def cell(v) -> str:
        text = "null" if v is None else str(v).lower() if isinstance(v, bool) else json.dumps(v.asDict(True) if hasattr(v, "asDict") else v, default=str) if isinstance(v, (list, dict, tuple)) else str(v)
        return text[:most] if most else text

    body = [[cell(v) for v in r] for r in rows]
    heads = [c[:most] if most else c for c in columns]
    widths = [max([len(h), *(len(r[i]) for r in body)]) for i, h in enumerate(heads)]
    line = "+" + "+".join("-" * (w + 2) for w in widths) + "+\n"
    show = lambda cells: "|" + "|".join(f" {c:>{w}} " for c, w in zip(cells, widths)) + "|\n"
    return line + show(heads) + line + "".join(map(show, body)) + line + f"{len(rows)} rows\n"


class Chart:
    """A bar, line or pie chart of a small result: a label column and numeric columns."""

    def __init__(self, kind: str, label: str, datasets: list[str], options: dict | None = None) -> None:
        if kind not in ("bar", "line", "pie"):
            raise ValueError("bar, line or pie")
        self.kind, self.label, self.datasets, self.options = kind, label, datasets, options or {}

    def data(self, rows: list) -> dict:
        labels = [str(r[self.label]) for r in rows]
        sets = [{"label": d, "data": [r[d] for r in rows]} for d in self.datasets]
        return {"type": self.kind, "data": {"labels": labels, "datasets": sets}, "options": self.options}


def bar_chart(label: str, *datasets: str, **options) -> Chart:
    return Chart("bar", label, list(datasets), options)


def line_chart(label: str, *datasets: str, **options) -> Chart:
    return Chart("line", label, list(datasets), options)


def pie_chart(label: str, *datasets: str, **options) -> Chart:
    return Chart("pie", label, list(datasets), options)


CHART_ROWS = 10_000


def to_chart_var(chart: Chart, target: dict) -> Sink:
    """The chart's definition into a dictionary. A chart has few points: more than CHART_ROWS rows are refused."""

    def write(df, mode, parts):
        rows = df.limit(CHART_ROWS + 1).collect()
        if len(rows) > CHART_ROWS:
            raise ValueError(f"a chart of more than {CHART_ROWS} points")
        target.update(chart.data(rows))

    return write


def to_chart_file(chart: Chart, path: str) -> Sink:
    def write(df, mode, parts):
        data: dict = {}
        to_chart_var(chart, data)(df, mode, parts)
        with open(path, "w", encoding="utf-8") as f:
            f.write(f'<!doctype html><canvas id="chart" data-chart="{html.escape(json.dumps(data, default=str))}"></canvas>\n')

    return write
