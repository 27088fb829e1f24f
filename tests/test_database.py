"""Keyset pages and exactly-once writes, over sqlite."""

import os
import sqlite3
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import datasource as ds

from tessera import ledger, sinks
from tessera.functions import ref
from tessera.operators.frame import Frame
from tessera.sources import keyset
from tessera.sources.keyset import from_db_keyset
from tessera.sources.remote import from_db_limit_offset

N = 100_000


class Counted:
    """A connection that writes down how many rows each statement gave, and may fail at one of them."""

    def __init__(self, path, log, fail=None):
        self.inner, self.log, self.fail = sqlite3.connect(path, timeout=60), log, fail

    def cursor(self):
        outer, inner = self, self.inner.cursor()

        class Cursor:
            description = property(lambda self: inner.description)

            def execute(self, sql, values=()):
                if outer.fail and "ORDER BY" in sql and not os.path.exists(outer.fail):
                    open(outer.fail, "w").close()
                    raise sqlite3.OperationalError("connection lost")
                self.sql = sql
                inner.execute(sql, values)

            def fetchone(self):
                return inner.fetchone()

            def fetchall(self):
                rows = inner.fetchall()
                with open(outer.log, "a") as f:
                    f.write(f"{len(rows)} {self.sql}\n")
                return rows

        return Cursor()

    def close(self):
        self.inner.close()


@pytest.fixture(scope="module")
def base(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "big.db")
    c = sqlite3.connect(path)
    c.execute("CREATE TABLE big (id INTEGER PRIMARY KEY, part TEXT, n INTEGER, x REAL)")
    c.executemany("INSERT INTO big VALUES (?, ?, ?, ?)", ((3 * i - 5, f"p{i % 7}", None if i % 11 == 0 else i % 100, i / 4) for i in range(N)))
    c.execute("CREATE TABLE pairs (a TEXT, b INTEGER, v TEXT, PRIMARY KEY (a, b))")
    c.executemany("INSERT INTO pairs VALUES (?, ?, ?)", ((f"k{i % 37:02d}", i // 37, str(i)) for i in range(5000)))
    c.execute("CREATE TABLE none (id INTEGER PRIMARY KEY)")
    c.commit()
    c.close()
    return path


SCHEMA = "id long, part string, n long, x double"


def read(log):
    return [(int(line.split(" ", 1)[0]), line) for line in open(log)] if os.path.exists(log) else []


@pytest.mark.parametrize("fail", [False, True])
def test_every_row_is_read_once(spark, base, tmp_path, fail):
    log, once = str(tmp_path / "log"), str(tmp_path / "failed") if fail else None
    f = from_db_keyset(spark, lambda: Counted(base, log, once), "big", "id", SCHEMA, page_size=1000, ranges=6)
    assert f.df.rdd.getNumPartitions() == 6
    rows = f.df.collect()
    assert len(rows) == N and sum(r.id for r in rows) == sum(3 * i - 5 for i in range(N)) and {r.part for r in rows} == {f"p{i}" for i in range(7)}
    assert sum(n for n, _ in read(log)) == N  # nothing twice, also where a connection was lost
    assert fail == bool(once and os.path.exists(once))


def test_filters_reach_the_database(spark, base, tmp_path):
    log = str(tmp_path / "log")
    f = from_db_keyset(spark, lambda: Counted(base, log), "big", "id", SCHEMA, ranges=3)
    got = f.df.where("id >= 1000 AND id < 2500 AND part IN ('p1', 'p3') AND n IS NOT NULL AND x > 0.5 AND part LIKE '%1'").collect()
    want = [i for i in range(N) if 1000 <= 3 * i - 5 < 2500 and i % 7 == 1 and i % 11]
    assert sorted(r.id for r in got) == [3 * i - 5 for i in want]
    assert sum(n for n, _ in read(log)) < 250
    assert keyset.pushed([ds.EqualTo(("s",), "a"), ds.GreaterThan(("s",), "a"), ds.Not(ds.EqualTo(("s",), "a")), ds.EqualTo(("s", "t"), 1), ds.EqualTo(("b",), True), ds.IsNull(("s",))], ["s", "b"]).parts == ("s = ?", "s IS NULL")


def test_maximum_composite_keys_splits_and_empty_tables(spark, base, tmp_path):
    log = str(tmp_path / "log")
    connect = lambda: Counted(base, log)
    first = from_db_keyset(spark, connect, "big", "id", SCHEMA, ranges=4, maximum=25, page_size=10)
    assert [r.id for r in first.df.collect()] == [3 * i - 5 for i in range(25)]
    assert sum(n for n, _ in read(log)) == 100
    pairs = from_db_keyset(spark, connect, "pairs", ["a", "b"], "a string, v string", page_size=64, splits=["k10", "k20"])
    assert pairs.df.rdd.getNumPartitions() == 3
    assert sorted(int(r.v) for r in pairs.df.collect()) == list(range(5000))
    assert from_db_keyset(spark, connect, "none", "id", "id long").df.collect() == []
    with pytest.raises(ValueError):
        from_db_keyset(spark, connect, "none", [], "id long")


def test_offset_pages_are_few_queries(spark, base):
    f = from_db_limit_offset(spark, lambda: sqlite3.connect(base), "pairs", ["a", "b"], "a string, b long, v string", page_size=7)
    assert sorted(int(r.v) for r in f.df.collect()) == list(range(5000))
    assert f.df.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism


def _table(path, *rows):
    c = sqlite3.connect(path)
    c.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT)")
    c.executemany("INSERT INTO t VALUES (?, ?)", rows)
    c.commit()
    c.close()
    return lambda: sqlite3.connect(path, timeout=60)


def content(connect, sql="SELECT id, name FROM t ORDER BY id"):
    c = connect()
    try:
        return c.execute(sql).fetchall()
    finally:
        c.close()


def stages(connect):
    return content(connect, "SELECT name FROM sqlite_master WHERE name LIKE 'tessera_stage%'")


def test_a_job_is_written_once(spark, tmp_path):
    connect = _table(str(tmp_path / "t.db"))
    f = Frame(spark.range(1000).selectExpr("id", "'n' || id AS name").repartition(5))
    for _ in range(2):
        f.write(sinks.to_table_insert(connect, "t", batch_size=64, job="load of day 1"))
    assert content(connect) == [(i, f"n{i}") for i in range(1000)] and stages(connect) == []
    f.filter(ref("id").less_than(10)).with_entry("name", ref("name").upper()).write(sinks.to_table_update(connect, "t", ["id"]))
    assert content(connect)[:11] == [(i, f"N{i}") for i in range(10)] + [(10, "n10")]


def test_updates_look_keys_up_in_the_stage(tmp_path):
    connect = _table(str(tmp_path / "t.db"))
    spec = {"connect": connect, "table": "t", "batch": 2, "dialect": "sqlite", "primary": ["id"], "run": "r", "job": "j"}
    writer = ledger.TableWriter(spec, ["id", "name"])
    assert writer.prepare()
    connection = connect()
    cursor = connection.cursor()
    plan = [r[-1] for r in cursor.execute("EXPLAIN QUERY PLAN " + writer.merge_sql(cursor)).fetchall()]
    connection.close()
    assert any(f"SEARCH {writer.stage} USING INDEX" in x for x in plan) and not any(f"SCAN {writer.stage}" in x for x in plan)


def test_attempts_that_do_not_count_leave_nothing(tmp_path):
    connect = _table(str(tmp_path / "t.db"))
    from pyspark.sql import Row

    spec = {"connect": connect, "table": "t", "batch": 2, "dialect": "sqlite", "conflicts": {}, "run": "r", "job": "j"}
    writer = ledger.TableWriter(spec, ["id", "name"])
    assert writer.prepare()
    rows = [Row(id=i, name=str(i)) for i in range(5)]
    writer.write(iter(rows))  # an attempt whose message is lost after its rows were stored
    won = writer.write(iter(rows))

    def broken():
        yield rows[0]
        yield rows[1]
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(broken())
    writer.commit([won, None])
    assert content(connect) == [(i, str(i)) for i in range(5)] and stages(connect) == []
    assert not ledger.TableWriter(spec | {"run": "s"}, ["id", "name"]).prepare()


def test_failed_jobs_and_repeated_keys_change_nothing(spark, tmp_path):
    connect = _table(str(tmp_path / "t.db"), (1, "old"), (2, "old"))
    bad = Frame(spark.range(6).selectExpr("id", "CASE WHEN id = 5 THEN raise_error('no') ELSE 'x' END AS name"))
    with pytest.raises(Exception, match="no"):
        bad.write(sinks.to_table_insert(connect, "t"))
    twice = Frame(spark.createDataFrame([(1, "a"), (1, "b")], "id long, name string"))
    with pytest.raises(Exception, match="primary key"):
        twice.write(sinks.to_table_update(connect, "t", ["id"]))
    assert content(connect) == [(1, "old"), (2, "old")] and stages(connect) == []


SCRIPT = """
import os, sqlite3, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
from tessera.operators.frame import Frame
from tessera.sinks import to_table_insert
from tessera.sources.keyset import from_db_keyset
folder = sys.argv[1]
connect = lambda: sqlite3.connect(folder + "/t.db", timeout=60)

def once(row):
    # the last rows of a task fail the first time, when most of its rows were sent
    mark = f"{folder}/failed-{row['id'] // 250}"
    if row["id"] % 250 == 249 and not os.path.exists(mark):
        open(mark, "w").close()
        raise RuntimeError("lost executor")
    return row

Frame(spark.range(0, 1000, 1, 4).selectExpr("id", "'n' || id AS name")).map(once).write(to_table_insert(connect, "t", batch_size=10))
print("rows", from_db_keyset(spark, connect, "t", "id", "id long, name string", page_size=50, ranges=3).map(once).df.count())
"""


def test_tasks_that_are_run_again_write_and_read_each_row_once(tmp_path):
    connect = _table(str(tmp_path / "t.db"))
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(SCRIPT), str(tmp_path)], capture_output=True, text=True, timeout=180, env=os.environ | {"PYTHONPATH": os.getcwd()})
    assert "rows 1000" in done.stdout, done.stderr[-2000:]
    assert content(connect) == [(i, f"n{i}") for i in range(1000)] and stages(connect) == []
    assert len([x for x in os.listdir(tmp_path) if x.startswith("failed")]) == 4
