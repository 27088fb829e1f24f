"""JSON arrays in parallel ranges against Python's parser."""

import json
import random

import numpy as np
import pytest

from tessera.sources import json_arrays
from tessera.sources.json_arrays import from_json_array


def rows_of(frame):
    return sorted((json.dumps({k: v for k, v in r.asDict(True).items() if v is not None}, sort_keys=True, ensure_ascii=False) for r in frame.df.collect()))


def plain(rows):
    return sorted(json.dumps({k: v for k, v in r.items() if v is not None}, sort_keys=True, ensure_ascii=False) for r in rows)


def some(n, seed=1):
    rng = random.Random(seed)
    texts = ['a,b', '"q"', "\\", '\\"', "]}[{", "é\n", "", "x" * 50, '{"k": [1,2', "\\\\"]
    return [{"id": i, "t": rng.choice(texts) + rng.choice(texts), "l": [rng.randrange(9)] * rng.randrange(3), "o": {"p": rng.choice(texts), "q": rng.choice([None, 1.5])}} for i in range(n)]


@pytest.mark.parametrize("chunk", [190, 1 << 20])
@pytest.mark.parametrize("pointer", [None, "/a/items"])
def test_equal_rows_whatever_the_chunks(spark, tmp_path, chunk, pointer):
    wanted = []
    for f, indent in enumerate((None, 2)):
        rows = some(12, f)
        wanted += rows
        whole = rows if pointer is None else {"x": {"items": [{"id": -1}], "y": "]"}, "items": [1, 2], "a": {"b": [[3]], "items": rows, "z": {"items": [4]}}, "last": [5]}
        (tmp_path / f"{f}.json").write_text(json.dumps(whole, indent=indent, ensure_ascii=bool(f)), encoding="utf-8")
    got = from_json_array(spark, str(tmp_path / "*.json"), pointer, chunk=chunk)
    assert rows_of(got) == plain(wanted)


def test_edges(spark, tmp_path):
    (tmp_path / "none.json").write_text('{"a": {"items": []}}')
    (tmp_path / "other.json").write_text('{"b": [1]}')
    (tmp_path / "empty.json").write_text("")
    assert from_json_array(spark, str(tmp_path / "*.json"), "/a/items").df.collect() == []
    (tmp_path / "numbers.txt").write_text('{"n": [1, 2.5, null, -3]}')
    assert sorted(r.n for r in from_json_array(spark, str(tmp_path / "numbers.txt"), "/n", chunk=4).df.where("n is not null").collect()) == [-3, 1, 2.5]
    (tmp_path / "unlike.txt").write_text('[{"a": 1, "b": {"c": 1}}, {"a": "x", "b": {"d": true}}, {"a": [1]}]')
    f = from_json_array(spark, str(tmp_path / "unlike.txt"), chunk=10)
    assert f.df.schema["a"].dataType.simpleString() == "variant" and f.df.schema["b"].dataType.simpleString() == "struct<c:bigint,d:boolean>"
    assert sorted(f.df.selectExpr("to_json(a) AS a").toPandas().a) == ['"x"', "1", "[1]"]
    schema = spark.createDataFrame([], "a string").schema
    assert from_json_array(spark, str(tmp_path / "unlike.txt"), schema=schema).df.columns == ["a"]


def test_quotes_after_backslashes():
    for text in ['"a\\"b"', '"\\\\"', '"\\\\\\""x', '\\\\"', '""', "\\"]:
        data, want, inside = np.frombuffer(text.encode(), np.uint8), [], False
        for i, c in enumerate(text):
            back = len(text[:i]) - len(text[:i].rstrip("\\"))
            if c == '"' and back % 2 == 0:
                want.append(i)
        assert json_arrays.quotes(data).tolist() == want


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "large.json"
    row = json.dumps({"id": 0, "text": "some, text [with] {marks} " * 8})
    n = 100_000
    with open(path, "w") as f:
        f.write('{"head": {"n": 1}, "data": [')
        f.writelines((", " if i else "") + row.replace('"id": 0', f'"id": {i}') for i in range(n))
        f.write('], "tail": []}')
    schema = spark.createDataFrame([], "id long, text string").schema
    out = from_json_array(spark, str(path), "/data", schema, chunk=4 << 20)
    per_task = out.df.selectExpr("spark_partition_id() AS p", "id").groupBy("p").agg({"id": "sum", "*": "count"}).collect()
    assert len(per_task) >= 4 and sum(r["count(1)"] for r in per_task) == n and sum(r["sum(id)"] for r in per_task) == n * (n - 1) // 2


def test_the_index_is_made_once(spark, tmp_path):
    """Whoever reads the elements reads ranges; chunks are not gone through again for their structure."""
    path = tmp_path / "rows.json"
    path.write_text(json.dumps(some(40)))
    elements = json_arrays.array_elements(spark, str(path), chunk=300)
    plan = elements._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Window" not in plan and "Aggregate" not in plan
    assert elements.count() == elements.count() == 40
