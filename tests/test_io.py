import json
import logging
import sqlite3
from pathlib import Path

import pytest

from tessera import functions as fn
from tessera import sinks
from tessera.cli import main
from tessera.functions import ref
from tessera.plans import json_plan
from tessera.sources import files, remote
from tessera.sources.memory import from_array
from tessera.streaming.streams import deduplicate, sessions, start, stream_files, windowed


@pytest.fixture
def rows(spark):
    return from_array(spark, [{"id": i, "name": f"n{i}", "tags": ["a", "b"], "group": "x" if i % 2 else "y"} for i in range(6)])


def test_csv_round_trip_and_detection(spark, rows, tmp_path):
    rows.write(sinks.to_csv(str(tmp_path / "a"), separator=";"))
    back = files.from_csv(spark, str(tmp_path / "a"), escape="\\")
    assert files.csv_detect_separator(spark, str(tmp_path / "a"))[0] == ";"
    assert back.columns == ["id", "name", "tags", "group"] and json.loads(back.sort_by("id").fetch()[0].tags) == ["a", "b"]


def test_csv_edges(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("id,,name\n1,a\n2,b,c,d\n3,,\n")
    f = files.from_csv(spark, str(p), separator=",", enclosure='"')
    assert f.columns == ["id", "e01", "name"]
    assert [tuple(r) for r in f.sort_by("id").fetch()] == [("1", "a", None), ("2", "b", "c"), ("3", None, None)]
    assert files.from_csv(spark, str(p), with_header=False, separator=",", enclosure='"').columns == ["e00", "e01", "e02"]


@pytest.mark.parametrize(("lines", "sep"), [(["a,b,c", "1,2,3"], ","), (["a;b", "1,5;2"], ";"), (["a\tb", '"x,y,z"\t2'], "\t"), (["a|b|c", "1|2|3"], "|")])
def test_detect(lines, sep):
    assert files.detect_csv(lines)[0] == sep


def test_save_modes(spark, rows, tmp_path):
    path = str(tmp_path / "m")
    rows.write(sinks.to_parquet(path))
    with pytest.raises(Exception, match="already exists"):
        rows.write(sinks.to_parquet(path))
    rows.mode("ignore").write(sinks.to_parquet(path))
    assert files.from_parquet(spark, path).count() == 6
    rows.mode("append").write(sinks.to_parquet(path))
    assert files.from_parquet(spark, path, columns=["id", "nope"], offset=2).count() == 10
    rows.mode("overwrite").write(sinks.to_parquet(path))
    assert files.from_parquet(spark, path).count() == 6


def test_overwriting_touches_only_its_partitions(spark, rows, tmp_path):
    path = str(tmp_path / "p")
    rows.partition_by("group").write(sinks.to_parquet(path))
    rows.filter(ref("id").equals(1)).partition_by("group").mode("overwrite").write(sinks.to_parquet(path))
    f = files.from_parquet(spark, path, input_file_uri=True)
    assert f.count() == 4 and "group=" in f.fetch()[0]._input_file_uri
    plan = f.filter_partitions(ref("group").equals("x")).df._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(group" in plan or "PartitionFilters: [(group" in plan
    parts = files.from_path_partitions(spark, path).fetch()
    assert {r.partitions["group"] for r in parts} == {"x", "y"}
    assert rows.partition_by("group").drop_partitions(drop_columns=True).columns == ["id", "name", "tags"]


def test_json(spark, rows, tmp_path):
    rows.write(sinks.to_json(str(tmp_path / "lines"))).write(sinks.to_json(str(tmp_path / "array"), as_array=True))
    assert files.from_json(spark, str(tmp_path / "lines"), multi_line=False).count() == 6
    assert files.from_json(spark, str(tmp_path / "array" / "*.txt")).sort_by("id").fetch()[2].tags == ["a", "b"]
    (tmp_path / "deep.json").write_text(json.dumps({"a": {"items": [{"k": 1}, {"k": 2}]}}))
    assert [r.k for r in files.from_json(spark, str(tmp_path / "deep.json"), pointer="/a/items").sort_by("k").fetch()] == [1, 2]


def test_text_and_xml(spark, rows, tmp_path):
    rows.select("name").write(sinks.to_text(str(tmp_path / "t")))
    assert files.from_text(spark, str(tmp_path / "t")).count() == 6
    with pytest.raises(ValueError):
        rows.write(sinks.to_text(str(tmp_path / "u")))
    rows.select("id", ref("name").alias("_name")).write(sinks.to_xml(str(tmp_path / "x")))
    nodes = files.from_xml(spark, str(tmp_path / "x"), "rows/row").with_entries({"n": ref("node").dom_element_attribute_value("name"), "i": ref("node").dom_element_value("/row/id")})
    assert sorted((r.i, r.n) for r in nodes.fetch()) == [(str(i), f"n{i}") for i in range(6)]
    assert files.from_xml_rows(spark, str(tmp_path / "x"), "row").count() == 6
    for f in (files.from_avro, sinks.to_avro):
        with pytest.raises(NotImplementedError):
            f("x")


def test_files_listing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x")
    (tmp_path / "d").mkdir()
    got = {r.base_name: (r.file_name, r.extension, r.is_file, r.is_dir) for r in files.files(spark, str(tmp_path)).fetch()}
    assert got == {"a.csv": ("a", "csv", True, False), "d": ("d", None, False, True)}


def test_database(spark, rows, tmp_path):
    db = str(tmp_path / "x.db")
    connect = lambda: sqlite3.connect(db)
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT)")
    f = rows.select("name", "id")
    f.df.coalesce(1)
    one = f._with(f.df.coalesce(1))
    one.write(sinks.to_table_insert(connect, "t", batch_size=4))
    one.write(sinks.to_table_insert(connect, "t", skip_conflicts=True))
    one.with_entry("name", ref("name").upper()).write(sinks.to_table_update(connect, "t", ["id"]))
    one.with_entry("name", ref("name").concat("!")).filter(ref("id").equals(0)).write(sinks.to_table_insert(connect, "t", conflict_columns=["id"]))
    back = remote.from_db_limit_offset(spark, connect, "t", ["id"], "id long, name string", page_size=4)
    assert [tuple(r) for r in back.sort_by("id").fetch()] == [(0, "n0!"), *((i, f"N{i}") for i in range(1, 6))]
    assert remote.from_db_queries(spark, connect, "SELECT id FROM t WHERE id = ?", [(1,), (3,)], "id long").count() == 2
    assert remote.from_db_limit_offset(spark, connect, "t", ["id"], "id long, name string", maximum=3).count() == 3


def test_bulk_sql():
    assert sinks.insert_sql("t", ["a", "b"], 2) == "INSERT INTO t (a, b) VALUES (?, ?), (?, ?)"
    assert sinks.insert_sql("t", ["a", "b"], 1, conflict_columns=["a"]).endswith("ON CONFLICT (a) DO UPDATE SET b = excluded.b")
    assert sinks.insert_sql("t", ["a"], 1, constraint="k").endswith("ON CONFLICT ON CONSTRAINT k DO UPDATE SET a = excluded.a")
    assert sinks.insert_sql("t", ["a", "b"], 1, "mysql", update_columns=["b"]).endswith("ON DUPLICATE KEY UPDATE b = VALUES(b)")
    assert sinks.insert_sql("t", ["a"], 1, "mysql", skip_conflicts=True).startswith("INSERT IGNORE")


def test_http_search_and_sheets(spark, rows):
    def client(method, uri, body):
        return 200, json.dumps({"page": int(uri.rsplit("/", 1)[1])})

    got = remote.from_static_http_requests(spark, client, [("GET", "http://x/1"), ("GET", "http://x/2")])
    assert sorted(r.body for r in got.fetch()) == ['{"page": 1}', '{"page": 2}']

    def following(last):
        n = 0 if last is None else json.loads(last["body"])["page"]
        return ("GET", f"http://x/{n + 1}") if n < 3 else None

    assert remote.from_dynamic_http_requests(spark, client, following).count() == 3
    pages = remote.from_search_pages(spark, lambda at, n: [{"i": i} for i in range(at, min(at + n, 25))], 25, "i long", page_size=10)
    assert sorted(r.i for r in pages.fetch()) == list(range(25))
    hits = from_array(spark, [{"hits": [{"_id": "1", "_source": {"a": 1}}, {"_id": "2", "_source": {"a": 2}}]}])
    assert sorted(r.a for r in remote.es_hits_to_rows(hits).fetch()) == [1, 2]
    table = [["h1", "h2"], ["a"], ["b", "c", "d"]]
    sheet = remote.from_sheet(spark, lambda r: table if r == "S!A1:Z1000" else [], "S")
    assert [tuple(r) for r in sheet.fetch()] == [("a", None), ("b", "c")]
    with pytest.raises(ValueError):
        remote.sheet_range("S", "A", "B", 2, 1)


def test_search_bulk_body():
    body = sinks.bulk_lines([{"id": 1, "j": '{"a": 1}'}], "idx", sinks.entry_id_factory("id"), "update")
    assert [json.loads(x) for x in body.splitlines()] == [{"update": {"_index": "idx", "_id": "1"}}, {"doc": {"id": 1, "j": {"a": 1}}}]
    assert sinks.hash_id_factory("a")({"a": 1}) == sinks.hash_id_factory("a")({"a": "1"})


def test_small_sinks(rows, tmp_path, caplog, capsys):
    out, chart, batches = [], {}, []
    rows.write(sinks.to_array(out)).write(sinks.to_branch(ref("id").less_than(2), sinks.to_callable(batches.append))).write(sinks.to_chart_var(sinks.bar_chart("name", "id"), chart))
    rows.write(sinks.to_transformation(lambda df: df.limit(1), sinks.to_output(schema=True))).write(sinks.to_chart_file(sinks.pie_chart("name", "id"), str(tmp_path / "c.html")))
    with caplog.at_level(logging.INFO):
        rows.limit(1).write(sinks.to_logger(logging.getLogger("t")))
    assert len(out) == 6 and len(batches[0]) == 2 and chart["data"]["labels"][0] == "n0" and "n0" in caplog.text
    assert "1 rows" in capsys.readouterr().out and "canvas" in Path(tmp_path / "c.html").read_text()


def test_error_handling(spark, tmp_path):
    p = tmp_path / "bad.json"
    p.write_text('{"a": 1}\n{bad\n')
    f = files.from_json(spark, str(p), multi_line=False, schema=spark.createDataFrame([], "a long, _corrupt_record string").schema)
    f = f._with(f.df.cache())
    assert f.on_error("skip").count() == 1 and f.on_error("ignore").count() == 2
    with pytest.raises(Exception, match="could not be read"):
        f.on_error("throw").run()


def test_json_plan(spark, tmp_path):
    def ref_(name, **more):
        return {"function": "ref", "args": [name], **more}

    plan = [{
        "function": "data_frame",
        "call": {"method": "read", "args": [{"function": "from_array", "args": [[{"id": 1, "n": 2}, {"id": 2, "n": 5}, {"id": 3, "n": 7}]]}],
            "call": {"method": "filter", "args": [ref_("n", call={"method": "greaterThan", "args": [2]})],
                "call": {"method": "withEntry", "args": ["m", ref_("n", call={"method": "multiply", "args": [10]})],
                    "call": {"method": "sortBy", "args": [ref_("m", call={"method": "desc"})],
                        "call": {"method": "write", "args": [{"function": "to_parquet", "args": [str(tmp_path / "o")]}]}}}}},
    }]
    assert [r.m for r in json_plan.from_json(spark, json.dumps(plan)).fetch()] == [70, 50]
    (tmp_path / "plan.json").write_text(json.dumps(plan).replace(str(tmp_path / "o"), str(tmp_path / "o2")))
    assert main(["run", str(tmp_path / "plan.json")]) == 0 and main(["count", str(tmp_path / "o2"), "--input-format", "parquet"]) == 0
    for bad in ("{", "[]", '[{"function": "eval"}]', '[{"function": "data_frame"}]', '[{"function": "df", "call": {"method": "__class__"}}]', '[{"function": "df", "call": {"method": "read", "args": [{"function": "open", "args": ["x"]}]}}]'):
        with pytest.raises(json_plan.PlanError):
            json_plan.from_json(spark, bad)


def test_command_line(spark, tmp_path, capsys):
    p = tmp_path / "in.csv"
    p.write_text("id,name\n1,a\n2,b\n")
    assert main(["read", str(p)]) == 0 and "|  1 |    a |" in capsys.readouterr().out
    assert main(["schema", str(p), "--auto-cast"]) == 0 and "|-- id: ?bigint" in capsys.readouterr().out
    assert main(["convert", str(p), str(tmp_path / "out.json")]) == 0
    assert files.from_json(spark, str(tmp_path / "out.json"), multi_line=False).count() == 2
    with pytest.raises(SystemExit):
        main(["read", str(tmp_path / "x.zip")])


def test_streams(spark, tmp_path):
    source, out = str(tmp_path / "s"), str(tmp_path / "o")
    f = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:05"), (2, "2024-01-01 00:20:00")], "k long, t string").selectExpr("k", "cast(t as timestamp) t")
    f.write.parquet(source)
    stream = stream_files(spark, "parquet", source, f.schema)
    q = start(deduplicate(stream, ["k"], "t", "1 hour"), sinks.to_parquet(out), str(tmp_path / "c"))
    q.awaitTermination(60)
    assert spark.read.parquet(out).count() == 2
    batch = files.from_parquet(spark, source)
    assert windowed(batch, "t", "10 minutes", fn.count("k").alias("n")).sort_by("window_start").fetch()[0].n == 2
    assert sessions(batch, "t", "10 minutes", fn.count("k").alias("n")).count() == 2
