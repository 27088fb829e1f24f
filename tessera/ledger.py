"""Exactly-once writes to database tables: attempts of tasks fill a staging table, and the driver merges those that count in one transaction.

Spark's data source protocol decides which attempt of each task counts: its message reaches ``commit``. A ledger beside the table holds the jobs that were merged, so that a job (or a
stream's batch) that is run again after its merge changes nothing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from .sources.keyset import packed, unpacked

LEDGER = "tessera_ledger"


@dataclass
class Attempt(ds.WriterCommitMessage):
    part: int
    attempt: str
    rows: int


class TableWriter(ds.DataSourceWriter):
    def __init__(self, spec: dict, columns: list[str]) -> None:
        self.spec, self.columns = spec, sorted(columns)

    @property
    def stage(self) -> str:
        return f"tessera_stage_{self.spec['run']}"

    def _connected(self, work) -> object:
        connection = self.spec["connect"]()
        try:
            cursor = connection.cursor()
            try:
                out = work(cursor)
                connection.commit()
                return out
            except BaseException:
                connection.rollback()
                raise
        finally:
            connection.close()

    def prepare(self) -> bool:
        """Makes ledger and stage; whether the job is still to be done."""

        def work(cursor) -> bool:
            cursor.execute(f"CREATE TABLE IF NOT EXISTS {LEDGER} (job VARCHAR(200) PRIMARY KEY, added BIGINT)")
            if self._done(cursor):
                return False
            names = ", ".join(self.columns)
            cursor.execute(f"CREATE TABLE {self.stage} AS SELECT 0 AS tessera_part, CAST('' AS VARCHAR(64)) AS tessera_attempt, {names} FROM {self.spec['table']} WHERE 1 = 0")
            return True

        return self._connected(work)

    def _done(self, cursor) -> bool:
        cursor.execute(f"SELECT added FROM {LEDGER} WHERE job = ?", (self.spec["job"],))
        return cursor.fetchone() is not None

    def write(self, iterator: Iterator[Row]) -> Attempt:
        """In a task. Its rows carry the attempt's mark; what a failed attempt leaves is never merged."""
        from .sinks import insert_sql

        context = TaskContext.get()
        part, attempt = (context.partitionId(), f"{context.taskAttemptId()}-{uuid.uuid4().hex}") if context else (0, uuid.uuid4().hex)
        names = ["tessera_part", "tessera_attempt", *self.columns]

        def work(cursor) -> int:
            rows, batch = 0, []

            def flush():
                if batch:
                    cursor.execute(insert_sql(self.stage, names, len(batch), self.spec["dialect"]), [v for r in batch for v in r])
                    batch.clear()

            for r in iterator:
                batch.append([part, attempt, *(r[c] for c in self.columns)])
                rows += 1
                if len(batch) == self.spec["batch"]:
                    flush()
            flush()
            return rows

        return Attempt(part, attempt, self._connected(work))

    def commit(self, messages: list[Attempt | None]) -> None:
        won = {(m.part, m.attempt) for m in messages if m is not None}
        added = sum(m.rows for m in messages if m is not None)

        def work(cursor) -> None:
            if self._done(cursor):
                return
            cursor.execute(f"INSERT INTO {LEDGER} (job, added) VALUES (?, ?)", (self.spec["job"], added))  # first: of two drivers one waits here, and fails
            cursor.execute(f"SELECT DISTINCT tessera_part, tessera_attempt FROM {self.stage}")
            for lost in [r for r in cursor.fetchall() if tuple(r) not in won]:
                cursor.execute(f"DELETE FROM {self.stage} WHERE tessera_part = ? AND tessera_attempt = ?", tuple(lost))
            cursor.execute(self.merge_sql(cursor))

        try:
            self._connected(work)
        finally:
            self._drop()

    def merge_sql(self, cursor) -> str:
        table, primary = self.spec["table"], self.spec.get("primary")
        names = ", ".join(self.columns)
        if primary:
            keys = ", ".join(primary)
            cursor.execute(f"CREATE INDEX {self.stage}_keys ON {self.stage} ({keys})")  # each row of the table looks for its own; without it each reads the whole stage
            cursor.execute(f"SELECT {keys} FROM {self.stage} GROUP BY {keys} HAVING count(*) > 1 LIMIT 1")
            if twice := cursor.fetchone():
                raise ValueError(f"two rows have the primary key {tuple(twice)}")
            same = " AND ".join(f"{self.stage}.{k} = {table}.{k}" for k in primary)
            changed = ", ".join(f"{c} = (SELECT {self.stage}.{c} FROM {self.stage} WHERE {same})" for c in self.columns if c not in primary)
            return f"UPDATE {table} SET {changed} WHERE EXISTS (SELECT 1 FROM {self.stage} WHERE {same})"
        from .sinks import conflict_sql

        verb, rule = conflict_sql(self.columns, self.spec["dialect"], **self.spec["conflicts"])
        return f"{verb} {table} ({names}) SELECT {names} FROM {self.stage} WHERE 1 = 1{rule}"

    def abort(self, messages: list[Attempt | None]) -> None:
        self._drop()

    def _drop(self) -> None:
        self._connected(lambda cursor: cursor.execute(f"DROP TABLE IF EXISTS {self.stage}"))


class TableSink(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_table"

    def writer(self, schema: T.StructType, overwrite: bool) -> TableWriter:
        return TableWriter(unpacked(dict(self.options)), schema.names)


def write_once(df: DataFrame, spec: dict, job: str | None = None) -> None:
    """Writes the frame's rows, each once. ``job`` names the write for good: after its merge the same name writes nothing. Without one, each call is a job of its own."""
    spark = df.sparkSession
    run = uuid.uuid4().hex
    spec = spec | {"run": run, "job": job or run}
    if not TableWriter(spec, df.columns).prepare():
        return
    spark.dataSource.register(TableSink)
    df.write.format(TableSink.name()).mode("append").option("spec", packed(spec)).save()
