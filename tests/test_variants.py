"""Rows of unlike schemas: arrays, JSON and unions give variants, and these read back."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import variants
from tessera.operators.frame import Frame
from tessera.sources.files import from_json
from tessera.sources.memory import from_all, from_array


def texts(df, column):
    return [json.loads(r[0]) if r[0] is not None else None for r in df.select(F.to_json(column) if isinstance(df.schema[column].dataType, T.VariantType) else column).collect()]


def test_arrays_of_unlike_rows(spark):
    rows = [{"i": 0, "m": {}}, {"i": 1, "m": {"a": 1}}, {"i": 2, "m": [1, "x"]}, {"i": 3, "m": None}, {"i": 4}, {"i": 5, "m": 7}]
    f = from_array(spark, rows)
    assert isinstance(f.df.schema["m"].dataType, T.VariantType)
    assert texts(f.df.orderBy("i"), "m") == [{}, {"a": 1}, [1, "x"], None, None, 7]
    nested = from_array(spark, [{"s": {"x": [{}, {"k": {"b": 1}}, {"k": [1]}]}}])
    assert variants.holds_variant(nested.df.schema)
    assert json.loads(nested.df.select(F.to_json("s")).first()[0])["x"][-1] == {"k": [1]} or "variant" in nested.df.schema.simpleString()


def test_unions_of_unlike_columns(spark):
    a = Frame(spark.createDataFrame([(1, 2.5)], "id int, v double"))
    b = Frame(spark.createDataFrame([(2, ("x", 3))], "id int, v struct<n string, k int>"))
    c = Frame(spark.createDataFrame([(3, {4: "y"})], "id int, v map<int, string>"))
    d = Frame(spark.createDataFrame([(4, None)], "id int, v array<int>"))
    both = from_all(a, b, c, d)
    got = {r.id: r.v for r in both.df.select("id", F.to_json("v").alias("v")).collect()}
    assert {k: v and json.loads(v) for k, v in got.items()} == {1: 2.5, 2: {"n": "x", "k": 3}, 3: {"4": "y"}, 4: None}
    again = variants.typed(both.df, "v", "struct<n string, k int>")
    assert {r.id: r.v for r in again.collect()}[2] == ("x", 3) and {r.id: r.v for r in again.collect()}[1] is None
    own = {r.id: r.schema for r in variants.row_schemas(both.df, "v").collect()}
    assert own[2] == "OBJECT<k: BIGINT, n: STRING>" or own[2].startswith("OBJECT<")


def test_json_of_unlike_records(spark, tmp_path):
    rows = [{"a": 1, "b": {"c": 1}}, {"a": "x", "b": {"c": 2, "d `e`": True}}, {"a": [1], "n": None}]
    (tmp_path / "x.json").write_text(json.dumps(rows))
    f = from_json(spark, str(tmp_path / "x.json"), unlike=True)
    assert {x.name: x.dataType.simpleString() for x in f.df.schema}["a"] == "variant"
    assert f.df.schema["b"].dataType.names == ["c", "d `e`"]
    assert sorted(map(str, texts(f.df, "a"))) == ["1", "[1]", "x"]
    assert sorted(str(r.c) for r in f.df.select("b.c").collect()) == ["1", "2", "None"]


def test_types_of_texts_and_values():
    assert variants.spark_type("OBJECT<`OBJECT<x`: DECIMAL(2,1), a: VOID, b: ARRAY<VARIANT>>") == "STRUCT<`OBJECT<x`: DOUBLE, a: STRING, b: ARRAY<VARIANT>>"
    assert json.loads(variants.as_json({"t": dt.date(2024, 1, 2), "b": b"\x01"})) == {"t": "2024-01-02", "b": "01"}


@pytest.mark.parametrize("value", [1, "x", 2.5, True, [1, 2], None])
def test_every_value_becomes_a_variant(spark, value):
    f = from_array(spark, [{"v": value}])
    c = variants.to_variant(F.col("v"), f.df.schema["v"].dataType)
    got = f.df.select(F.to_json(c)).first()[0]
    assert (json.loads(got) if got is not None else None) == value
