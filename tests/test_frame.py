import datetime as dt

import pytest

from tessera import functions as fn
from tessera.functions import ref, window
from tessera.operators.frame import Frame, from_cache
from tessera.operators.joins import compare_any, cross_join, equal, identical, join, join_on
from tessera.schema import Schema, enum_schema, float_schema, int_schema, list_schema, merge_types, schema_from_json, schema_to_json, str_schema, struct_schema
from tessera.sources.memory import from_all, from_array, from_sequence_date_period, from_sequence_date_period_recurrences, from_sequence_number


@pytest.fixture
def people(spark):
    rows = [("a", "PL", 20), ("b", "PL", 30), ("c", "US", 40), ("d", "US", 50), ("e", None, 45)]
    return from_array(spark, [{"id": i, "country": c, "age": a} for i, c, a in rows])


def test_select_keeps_order_and_fills_missing(people):
    f = people.select("age", "nope", ref("id").alias("name"))
    assert f.columns == ["age", "nope", "name"] and f.fetch(1)[0].nope is None


def test_frames_are_immutable_and_lazy(people):
    before = people.columns
    people.with_entry("x", ref("age").plus(1)).drop("age")
    assert people.columns == before


def test_renames(people):
    assert people.rename("id", "Id").rename_all("ou", "OU").columns == ["Id", "cOUntry", "age"]
    assert people.rename_all_upper_case().columns == ["ID", "COUNTRY", "AGE"] and people.rename_all_upper_case_first().columns[0] == "Id"
    assert people.renameAllStyle("pascal").columns == ["Id", "Country", "Age"]
    with pytest.raises(KeyError):
        people.rename("x", "y")


def test_reorder(people):
    assert people.reorder_entries().columns == ["age", "country", "id"]
    assert people.reorder_entries("type_and_name").columns == ["age", "country", "id"] and people.reorder_entries("name", True).columns[0] == "id"


def test_limit_offset_until(people):
    s = people.sort_by(ref("age").desc())
    assert [r.id for r in s.limit(2).fetch()] == ["d", "e"] and [r.id for r in s.offset(3).fetch()] == ["b", "a"]
    assert sorted(r.id for r in people.until(ref("age").less_than(40), "age").fetch()) == ["a", "b"]
    assert people.until(ref("age").less_than(99), "age").count() == 5
    with pytest.raises(ValueError):
        people.limit(0)


def test_sort_puts_nulls_lowest(people):
    assert people.sort_by("country", "age").fetch()[0].id == "e" and people.sort_by(ref("country").desc(), "age").fetch()[-1].id == "e"


def test_drop_duplicates(people):
    assert sorted(r.id for r in people.drop_duplicates("country", order_by="age").fetch()) == ["a", "c", "e"]
    assert people.drop_duplicates("absent", order_by="age").count() == 1
    with pytest.raises(ValueError):
        people.drop_duplicates()


def test_pivot(spark):
    f = from_array(spark, [{"d": d, "u": u, "n": n} for d, u, n in [("1", "x", 1), ("1", "y", 2), ("2", "x", 3), ("2", "x", 4)]])
    rows = f.group_by("d").pivot("u").aggregate(fn.sum_("n")).sort_by("d").fetch()
    assert [r.asDict() for r in rows] == [{"d": "1", "x": 1, "y": 2}, {"d": "2", "x": 7, "y": None}]
    with pytest.raises(ValueError):
        f.group_by("d").pivot("u").aggregate(fn.sum_("n"), fn.count("n"))


def test_window_sees_the_whole_partition(people):
    w = window().partition_by("country").order_by(ref("age").desc())
    f = people.with_entries({"r": fn.rank().over(w), "s": fn.sum_("age").over(w), "n": fn.count("country").over(window())})
    got = {r.id: (r.r, r.s, r.n) for r in f.fetch()}
    assert got == {"a": (2, 50, 2), "b": (1, 50, 2), "c": (2, 90, 2), "d": (1, 90, 2), "e": (1, 45, 1)}


def test_joins(spark, people):
    right = from_array(spark, [{"code": "PL", "name": "Poland"}, {"code": "PL", "name": "Polska"}, {"code": "DE", "name": "Germany"}, {"code": None, "name": "nowhere"}])
    assert sorted(r.name for r in people.join(right, {"country": "code"}, "inner").fetch()) == ["Poland", "Poland", "Polska", "Polska", "nowhere"]
    first = people.join(right, join_on({"country": "code"}, "j_"), "left", match="first", order_by=["name"]).sort_by("id").fetch()
    assert [(r.id, r.j_name) for r in first] == [("a", "Poland"), ("b", "Poland"), ("c", None), ("d", None), ("e", "nowhere")]
    assert sorted(r.id for r in people.join(right, {"country": "code"}, "left_anti").fetch()) == ["c", "d"]
    assert people.join(right, {"country": "code"}, "right").filter(ref("id").is_null()).fetch()[0].name == "Germany"
    clash = right.rename("code", "id")
    with pytest.raises(ValueError):
        people.join(clash, {"country": "id"})
    with pytest.raises(ValueError):
        join(people.df, right.df, join_on({"country": "code"}), "full")
    either = join_on(compare_any(equal("country", "code"), equal("id", "name")))
    assert people.join(right, either, "inner").count() == 5
    assert people.join(right, join_on([identical("age", "code")]), "inner").count() == 0  # unlike types, and no null on both sides


def test_joins_on_moments(spark):
    d = dt.datetime(2024, 1, 1)
    a, b = from_array(spark, [{"x": d, "i": 1}]), from_array(spark, [{"y": d, "j": 2}])
    assert a.join(b, {"x": "y"}, "inner").count() == 1


def test_cross_join_of_an_empty_side(spark, people):
    empty = people.filter(ref("age").greater_than(1000)).select("age").rename("age", "n")
    assert people.cross_join(empty).count() == 0 and people.cross_join(empty, compat=True).count() == 5
    assert cross_join(empty.df, people.df, compat=True).count() == 5
    with pytest.raises(ValueError):
        people.cross_join(people)


def test_join_each(spark, people):
    seen = []

    def factory(asked):
        seen.append(sorted(str(r.country) for r in asked.fetch()))
        return from_array(spark, [{"code": "PL", "name": "Poland"}])

    assert people.join_each(factory, {"country": "code"}, "inner", keys=["country"]).count() == 2 and seen == [["None", "PL", "US"]]


def test_sets(spark, people):
    a, b = people.select("country"), from_array(spark, [{"country": "PL"}, {"country": None}])
    assert sorted(r.country for r in a.diff_left(b).fetch()) == ["US", "US"] and a.diff_right(b).count() == 0
    u = from_all(people, from_array(spark, [{"id": 7, "extra": 1.5}]))
    assert u.columns == ["id", "country", "age", "extra"] and u.filter(ref("id").equals("7")).fetch()[0].extra == 1.5
    assert sorted(r.id for r in people.drop_right(2, "age").fetch()) == ["a", "b", "c"] and people.take_right(1, "age").fetch()[0].id == "d"
    assert people.hash() == people.sort_by("age").hash() != people.limit(2).hash()


def test_functions_over_rows(people):
    doubled = people.select("id", "age").map(lambda r: {"id": r["id"], "age": r["age"] * 2})
    assert sorted(r.age for r in doubled.fetch()) == [40, 60, 80, 90, 100]
    assert people.flat_map(lambda r: [{"x": r["id"]}] * 2, "x string").count() == 10
    assert people.transform(lambda f: f.limit(1)).count() == 1 and people.reduce_to_array("id", "id") == list("abcde")
    assert people.group_to_array("country", "rows").filter(ref("country").equals("PL")).fetch()[0].rows[0].id == "a"


def test_triggers(people, capsys):
    assert people.count() == 5 and [len(b) for b in people.get(2)] == [2, 2, 1] and sum(1 for _ in people.get_each_as_array()) == 5
    report = people.run(analyze=True)
    assert report.rows == 5 and report.schema.names == ["id", "country", "age"]
    assert people.void().count() == 0 and people.first().id == "a" and people.find_one(ref("age").equals(999)) is None
    text = people.select("id", "country").limit(1).display()
    assert text == "+----+---------+\n| id | country |\n+----+---------+\n|  a |      PL |\n+----+---------+\n1 rows\n"
    people.print_schema()
    assert "|-- age: ?int" in capsys.readouterr().out.replace("bigint", "int")


def test_cache(spark, people):
    people.cache("people")
    assert from_cache(spark, "people", clear=True).count() == 5
    with pytest.raises(KeyError):
        from_cache(spark, "people")
    assert from_cache(spark, "other", fallback=people).count() == 5


def test_sequences(spark):
    assert [r.n for r in from_sequence_number(spark, "n", 1, 10, 3).sort_by("n").fetch()] == [1, 4, 7, 10]
    assert from_sequence_date_period(spark, "d", "2024-01-01", "1 day", "2024-01-05", exclude_start=True).count() == 4
    months = from_sequence_date_period_recurrences(spark, "d", "2024-01-31", "1 month", 2).sort_by("d").fetch()
    assert [m.d.strftime("%m-%d") for m in months] == ["01-31", "02-29", "03-31"]


def test_inference_and_merging(spark):
    f = from_array(spark, [{"a": 1, "l": [1]}, {"a": 1.5, "l": [2.5], "s": {"x": 1}}, {"a": None, "s": {"y": "q"}}])
    kinds = {k.name: k.dataType.simpleString() for k in f.schema().fields}
    assert kinds == {"a": "double", "l": "array<double>", "s": "struct<x:bigint,y:string>"}
    assert merge_types(Schema.of(f.df.schema).get("l").dataType, Schema.of(f.df.schema).get("s").dataType).simpleString() == "variant"


def test_schema_api():
    s = Schema(int_schema("id"), str_schema("name", True), enum_schema("c", ["x"]), list_schema("l", int_schema("e").dataType), struct_schema("s", [float_schema("f")]))
    assert schema_from_json(schema_to_json(s)) == s and s.rename("id", "key").names[0] == "key" and s.keep("l").names == ["l"] and s.graceful_remove("zz", "l").find("l") is None
    with pytest.raises(KeyError):
        s.remove("zz")
    wider = s.add(int_schema("extra")).replace("id", int_schema("id", True))
    assert s.matches(wider, evolving=True) and not wider.matches(s, evolving=True) and not s.matches(wider) and s.matches(s)
    assert s.merge(Schema(int_schema("new"))).get("id").nullable and "|-- s: struct\n|    |-- f: double" in s.ascii()
    with pytest.raises(ValueError):
        Schema(int_schema("a"), int_schema("a"))


def test_validation(spark, people):
    kind = Schema.of(people.df.schema)
    assert people.validate(kind).count() == 5
    strict = kind.replace("country", str_schema("country"))
    with pytest.raises(Exception, match="country does not fit"):
        people.validate(strict).run()
    with pytest.raises(ValueError, match="age is not expected"):
        people.validate(kind.remove("age"))
    assert people.validate(kind.remove("age"), strict=False).count() == 5


def test_auto_cast(spark):
    rows = [{"i": "1", "f": "1.5", "b": "yes", "d": "2024-01-01", "j": "[1]", "t": "x", "n": "null", "z": "007"}, {"i": "-2", "f": "2", "b": "off", "d": "2024-01-02T10:00:00Z", "j": '{"a":1}', "t": "1", "n": None, "z": "1"}]
    f = from_array(spark, rows).auto_cast()
    kinds = {k.name: k.dataType.simpleString() for k in f.schema().fields}
    assert kinds == {"i": "bigint", "f": "double", "b": "boolean", "d": "timestamp", "j": "string", "t": "string", "n": "string", "z": "string"}
    assert f.schema().get("j").metadata["logical"] == "json"


def test_errors_of_unknown_verbs(people):
    with pytest.raises(AttributeError):
        people.no_such_verb  # noqa: B018
    with pytest.raises(ValueError):
        people.mode("sometimes")
    assert isinstance(people.groupBy("id").aggregate(fn.count("id")), Frame)


def test_collection_verbs(spark, people):
    assert people.take(2).count() == 2 and people.sort_ascending("age").skip(4).fetch()[0].id == "d" and people.reverse("age").fetch()[0].id == "d"
    assert sorted(r.id for r in people.remove(0, "age").fetch()) == ["b", "c", "d", "e"] and people.sort_entries().columns == ["age", "country", "id"]
    assert not people.is_partitioned and people.partition_by("country").is_partitioned and len(people.to_array()) == 5 and len(list(people.chunks(3))) == 2
    dated = from_array(spark, [{"d": dt.datetime(2024, 1, 1, 10), "l": [1]}, {"d": dt.datetime(2024, 1, 1, 11), "l": [1]}])
    assert [r.d for r in dated.partition_values("d").fetch()] == ["2024-01-01"]
    with pytest.raises(TypeError):
        dated.partition_values("l")


def test_type_constructors():
    from tessera import schema as s

    kind = s.struct_type(s.struct_element("a", s.type_int()), s.struct_element("m", s.type_map(s.type_string(), s.type_list(s.type_float()))))
    assert kind.simpleString() == "struct<a:bigint,m:map<string,array<double>>>"
    with pytest.raises(ValueError):
        s.struct_type()
