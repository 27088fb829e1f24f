"""XML texts as nested values, and back."""

import random

import pytest
from pyspark.sql import types as T

from tessera.functions import markup
from tessera.operators.frame import Frame

NODES = [
    '<item id="1"><name>A &amp; b</name><tag>x</tag><tag>y</tag><size u="cm">3</size><empty/><n0>0</n0></item>',
    "<item><name>B</name><tag>z</tag><size>4</size><deep><p q='1 &lt; 2'><r>t</r></p></deep>  </item>",
    '<item id="7">just text</item>',
    None,
    "<item>broken",
    "",
    '<?xml version="1.0"?><!-- c --><other xmlns:x="u" x:a="n"><![CDATA[<raw>]]></other>',
    "<item>first<name>n</name>second\n</item>",
]


def frame(spark, nodes):
    return Frame(spark.createDataFrame(list(enumerate(nodes)), "i int, node string").repartition(3))


def by_row(f):
    return {r.i: r.node and r.node.asDict(True) for r in f.df.collect()}


def test_nested_repeated_and_attributed_nodes(spark):
    cast = frame(spark, NODES).cast_xml("node")
    got = by_row(cast)
    first = got[0]["item"]
    assert first["@attributes"] == {"id": "1"} and first["@value"] is None and first["name"] == {"@value": "A & b"}
    assert [t["@value"] for t in first["tag"]] == ["x", "y"] and [t["@value"] for t in got[1]["item"]["tag"]] == ["z"] and got[2]["item"]["tag"] is None
    assert first["size"] == {"@attributes": {"u": "cm"}, "@value": "3"} and first["empty"] == {"@value": None} and first["n0"] == {"@value": "0"}
    assert got[1]["item"]["deep"] == {"p": {"@attributes": {"q": "1 < 2"}, "r": {"@value": "t"}}}
    assert got[2]["item"]["@value"] == "just text" and got[2]["other"] is None
    assert got[3] is got[4] is got[5] is None
    assert got[6] == {"item": None, "other": {"@attributes": {"x:a": "n"}, "@value": "<raw>"}}
    assert got[7]["item"]["@value"] == "second\n"
    assert isinstance(cast.df.schema["node"].dataType["item"].dataType["tag"].dataType, T.ArrayType)


def test_round_trip(spark):
    rng = random.Random(4)

    def some(depth):
        name = rng.choice("abc")
        attributes = "".join(f' {k}="{rng.choice(["1", "&quot;q&quot;", "x &amp; y", "&#10;"])}"' for k in rng.sample("pq", rng.randrange(3)))
        inner = rng.choice(["", "text", " t ", "&lt;b&gt;", "é"]) if depth > 3 or rng.random() < 0.4 else "".join(some(depth + 1) for _ in range(rng.randrange(4)))
        return f"<{name}{attributes}>{inner}</{name}>"

    cast = frame(spark, [some(0) for _ in range(150)] + NODES).cast_xml("node")
    schema = cast.df.schema["node"].dataType
    again = cast.xml_text("node").cast_xml("node", schema)
    assert by_row(again) == by_row(cast)
    assert "Arrow" not in cast.xml_text("node").df._jdf.queryExecution().optimizedPlan().toString().split("Project", 1)[0]


def test_given_schema_empty_tables_and_depth(spark):
    schema = T.StructType.fromDDL("item struct<name struct<`@value` string>, tag struct<`@value` string>>")
    got = by_row(frame(spark, NODES).cast_xml("node", schema))
    assert got[0]["item"] == {"name": {"@value": "A & b"}, "tag": {"@value": "y"}} and got[6] == {"item": None}
    with pytest.raises(ValueError):
        frame(spark, [None, "broken"]).cast_xml("node")
    with pytest.raises(ValueError, match="deeper"):
        markup.parsed("<a>" * 70 + "</a>" * 70)


def test_merging_shapes_does_not_depend_on_order():
    found = [markup.shape_of(markup.parsed(n)) for n in NODES if n and markup.parsed(n)]
    ways = []
    for seed in range(5):
        random.Random(seed).shuffle(found)
        ways.append(markup.struct_of(markup.all_merged(found), True).json())
    assert len(set(ways)) == 1


def test_texts_of_one_outline_are_merged_once(spark, monkeypatch):
    """Shapes are made of each different outline only; whether a name is repeated, has attributes or a value is told apart."""
    texts = ["<a><b/></a>", "<a><b/><b/></a>", "<a><b x='1'/></a>", "<a><b>1</b></a>", "<a><b>2</b></a>", "<a b=''/>", "<a><b/>v</a>", "<b/>", "<a><b>"]
    outlines = [markup.outline(t) for t in texts]
    assert outlines[3] == outlines[4] and len(set(outlines)) == 8 and outlines[8] is None
    made = markup.all_merged([markup.shape_of(p) for t in texts if (p := markup.parsed(t))])
    monkeypatch.setattr(markup, "OUTLINES", 2)
    assert markup.xml_schema(frame(spark, texts * 3).df, "node") == markup.struct_of(made, True)
    kind = T.StructType.fromDDL("a struct<`@attributes` struct<c string>, b array<struct<`@attributes` struct<x string>>>>")
    read = markup.fitted(kind)
    assert read(texts[2]) == {"a": {"b": [{"@attributes": {"x": "1"}}]}} and read(texts[8]) is None
    got = by_row(frame(spark, texts).cast_xml("node", kind))
    assert got[5] == {"a": {"@attributes": {"c": None}, "b": None}} and got[7] == {"a": None} and got[8] is None
    with pytest.raises(ValueError, match="deeper"):
        read("<a>" * 65 + "</a>" * 65)
    assert read("<z>" * 64 + "</z>" * 64) == {}
