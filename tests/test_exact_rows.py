"""Rows, values and pairs that ties, nulls, large integers and derived frames must not change."""

import datetime as dt
import sqlite3

import pytest
from pyspark.sql import Row

from tessera import cache
from tessera.functions import ref
from tessera.operators.frame import from_cache
from tessera.operators.joins import compare_all, compare_any, equal, identical, join_on
from tessera.sinks import insert_sql, to_csv, to_meilisearch_bulk_index, to_parquet, to_table_insert
from tessera.sources import files, remote
from tessera.sources.memory import from_array
from tessera.streaming import streams

BIG = 9007199254740993


@pytest.fixture
def ties(spark):
    return from_array(spark, [{"n": n, "t": t} for n, t in [(1, "a"), (2, "b"), (2, "c"), (2, "c"), (None, "d"), (None, "e")]])


def left(frame):
    return sorted(((r.n is not None, r.n or 0, r.t) for r in frame.fetch()))


def test_drop_right_takes_just_so_many(ties):
    order = left(ties)  # nulls are smallest; ties by the other column
    for n in range(8):
        assert left(ties.drop_right(n, "n")) == order[: max(0, 6 - n)]
        assert [(r.n, r.t) for r in ties.take_right(n, "n").fetch()] == [(k if k or there else None, t) for there, k, t in reversed(order)][:n]


def test_remove_takes_one_row(ties):
    order = left(ties)
    for at in range(8):
        assert left(ties.remove(at, "n")) == order[:at] + order[at + 1 :]


def test_reverse_needs_and_turns_an_order(ties):
    forth = ties.sort_by("t", (ref("n"), False))
    assert [r.t for r in forth.reverse().fetch()] == list("edccba") and [r.t for r in forth.reverse().reverse().fetch()] == list("abccde")
    with pytest.raises(ValueError):
        ties.reverse()


def test_functions_keep_long_integers_beside_nulls(spark):
    f = from_array(spark, [{"i": BIG, "s": "x", "m": [1, None], "d": dt.datetime(2024, 2, 3, 4, 5, 6, 789)}, {"i": None, "s": None, "m": None, "d": None}])
    for made in (f.map(lambda r: r), f.batch_size(1).map(lambda r: r), f.flat_map(lambda r: [r], f.df.schema)):
        assert sorted(map(str, made.fetch())) == sorted(map(str, f.fetch()))
    assert [r.n for r in f.flat_map(lambda r: [{"n": r["i"]}] * (r["i"] is not None), "n long").fetch()] == [BIG]
    assert f.reduce(lambda a, r: a + (r["i"] or 0), 0) == f.reduce(lambda a, r: a + (r["i"] or 0), 0, lambda a, b: a + b) == BIG
    assert f.filter(ref("i").is_null()).filter(ref("i").is_not_null()).reduce(lambda a, r: a + 1, 7, lambda a, b: a + b) == 7
    assert f.select("i", "s").sort_by("s").entries() == [[("i", None), ("s", None)], [("i", BIG), ("s", "x")]]


def test_a_frame_joins_one_derived_from_it(spark, ties):
    few = ties.filter(ref("n").equals(2)).with_entry("k", ref("n"))
    assert ties.join(few, join_on({"n": "n"}, "r_"), "inner").count() == 9
    assert ties.join(few.drop_duplicates("n"), join_on({"n": "n"}, "r_"), "left").count() == 6
    assert ties.join(few, join_on({"n": "n"}, "r_"), "left_anti").count() == 3


@pytest.mark.parametrize("how", ["inner", "left", "right", "left_anti"])
def test_any_is_a_union_of_equi_joins(spark, how):
    a = [{"p": p, "q": q} for p in (1, 2, None, 5) for q in (1, 3, None)] + [{"p": 9, "q": 9}] * 2
    b = [{"x": x, "y": y} for x in (1, 2, 7, None) for y in (3, 1, 8)] + [{"x": 1, "y": 3}]
    on = compare_any(equal("p", "x"), compare_all(equal("q", "y"), compare_any(equal("p", "y"), identical("q", "x"))))
    joined = from_array(spark, a).join(from_array(spark, b), on, how)
    plan = joined.df._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    met = lambda r, s: r["p"] == s["x"] or r["q"] == s["y"] and (r["p"] == s["y"] or r["q"] == s["x"])
    want = [r | s for r in a for s in b if met(r, s)]
    if how == "left":
        want += [r | {"x": None, "y": None} for r in a if not any(met(r, s) for s in b)]
    if how == "right":
        want += [{"p": None, "q": None} | s for s in b if not any(met(r, s) for r in a)]
    if how == "left_anti":
        want = [r for r in a if not any(met(r, s) for s in b)]
    assert sorted(map(str, joined.to_array())) == sorted(map(str, want)) and want


def test_join_each_of_every_kind(spark, ties):
    right = from_array(spark, [{"k": 2, "v": "two"}, {"k": 3, "v": "three"}])
    counts = {how: ties.join_each(lambda asked: right, {"n": "k"}, how, keys=["n"]).count() for how in ("inner", "left", "left_anti", "right")}
    assert counts == {"inner": 3, "left": 6, "left_anti": 3, "right": 4}


def test_xml_by_its_whole_path(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<?xml version='1.0'?><root><items><item a='>'>y<item>z</item></item><item/><!-- <item>no</item> --></items><other><item>o</item></other></root>")
    (tmp_path / "b.xml").write_bytes("<?xml version='1.0' encoding='ISO-8859-1'?><root><items><item>\xe9</item ></items></root>".encode("latin-1"))
    got = [r.node for r in files.from_xml(spark, str(tmp_path), "root/items/item").fetch()]
    assert sorted(got) == sorted(["<item a='>'>y<item>z</item></item>", "<item/>", "<item>\xe9</item >"])
    assert {r._input_file_uri[-5:] for r in files.from_xml(spark, str(tmp_path), "root/items/item", input_file_uri=True).fetch()} == {"a.xml", "b.xml"}
    assert files.from_xml(spark, str(tmp_path), "item").count() == 0


def test_csv_values_with_line_ends(spark, tmp_path):
    f = from_array(spark, [{"a": "one\ntwo", "b": "x"}, {"a": "plain", "b": "y, z"}])
    f.write(to_csv(str(tmp_path / "c")))
    back = files.from_csv(spark, str(tmp_path / "c"), separator=",", enclosure='"', multi_line=True)
    assert sorted((r.a, r.b) for r in back.fetch()) == [("one\ntwo", "x"), ("plain", "y, z")]


def test_separators_are_found_among_the_characters():
    assert files.detect_csv(["a;b,c;d", "1;2;3"]) == (";", '"')
    assert files.detect_csv(["a!b!c", "1!2!3"]) == ("!", '"')
    assert files.detect_csv(["'a,b'/2", "'c'/3"]) == ("/", "'")
    assert files.detect_csv(["abc"]) == (",", '"')


def test_a_replayed_batch_is_there_once(spark, tmp_path):
    from_array(spark, [{"n": 1}, {"n": 2}]).write(to_parquet(str(tmp_path / "in")))
    frame = streams.stream_files(spark, "parquet", str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    for checkpoint in ("one", "two"):  # a new checkpoint replays the batch
        streams.start(frame, lambda n: to_parquet(str(tmp_path / f"out/batch={n}")), str(tmp_path / checkpoint), by_batch=True).awaitTermination()
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_database_keeps_long_integers(spark, tmp_path):
    db = str(tmp_path / "x.db")
    connect = lambda: sqlite3.connect(db)
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, n INTEGER)")
    f = from_array(spark, [{"id": 1, "n": BIG}, {"id": 2, "n": None}])
    f._with(f.df.coalesce(1)).write(to_table_insert(connect, "t"))
    got = remote.from_db_query(spark, connect, "SELECT id, n FROM t", "id long, n long")
    assert sorted((r.id, r.n) for r in got.fetch()) == [(1, BIG), (2, None)]
    assert "excluded.n" in insert_sql("t", ["id", "n"], 1, "sqlite", conflict_columns=["id"])


class Service:
    """A search service of 25 documents."""

    hits = [{"_id": str(i), "_source": {"n": i, "part": i % 3}, "sort": [i]} for i in range(25)]

    def search(self, body):
        found = [h for h in self.hits if "slice" not in body or h["_source"]["n"] % body["slice"]["max"] == body["slice"]["id"]]
        if "search_after" in body:
            found = [h for h in found if h["sort"] > body["search_after"]]
        at = body.get("from", 0)
        return {"hits": {"hits": found[at : at + body["size"]]}}


def test_search_sources(spark, tmp_path):
    s, kind = Service(), "_id string, n long, part long"
    ids = [(str(i), i) for i in range(25)]
    for frame in (
        remote.from_es(spark, s.search, {"sort": [{"n": "asc"}]}, kind, page_size=4),
        remote.from_es(spark, s.search, {}, kind, page_size=10),
        remote.from_es(spark, s.search, {"sort": [{"n": "asc"}]}, kind, page_size=3, open_point_in_time=lambda: "pit", slices=3),
    ):
        assert sorted(((r._id, r.n) for r in frame.fetch()), key=lambda x: x[1]) == ids
    with pytest.raises(ValueError):
        remote.from_es(spark, s.search, {}, kind, slices=2)
    found = remote.from_meilisearch(spark, lambda p: {"hits": [{"n": i} for i in range(p["offset"], min(11, p["offset"] + p["limit"]))]}, {"q": ""}, "n long", 4)
    assert sorted(r.n for r in found.fetch()) == list(range(11))
    made = remote.from_generator(spark, lambda i: ({"n": 10 * i + k} for k in range(i)), "n long", tasks=4)
    assert sorted(r.n for r in made.fetch()) == [10, 20, 21, 30, 31, 32]
    folder = tmp_path / "sent"
    folder.mkdir()

    def update(rows):
        import json
        import uuid

        (folder / uuid.uuid4().hex).write_text(json.dumps(rows))
        return len(rows)

    from_array(spark, [{"id": i, "tags": '["a"]'} for i in range(5)]).write(to_meilisearch_bulk_index(update, wait=lambda task: None, batch_size=2))
    import json

    sent = [r for p in folder.iterdir() for r in json.loads(p.read_text())]
    assert sorted(r["id"] for r in sent) == list(range(5)) and all(r["tags"] == ["a"] for r in sent)


@pytest.mark.parametrize("serializer", [None, cache.NativeSerializer(), cache.Base64Serializer(cache.CompressingSerializer())])
def test_caches(spark, tmp_path, serializer):
    f = from_array(spark, [{"n": BIG, "s": [1, 2]}, {"n": None, "s": None}])
    held = {}
    for store in (cache.FilesystemCache(str(tmp_path / "cache")), cache.KeyValueCache(held, serializer), cache.MemoryCache()):
        with pytest.raises(KeyError):
            from_cache(spark, "f", store=store)
        assert from_cache(spark, "f", fallback=f, store=store).count() == 2
        assert sorted(map(str, from_cache(spark, "f", store=store).fetch())) == sorted([str(Row(n=BIG, s=[1, 2])), str(Row(n=None, s=None))])
        store.delete(spark, "f")
        assert store.get(spark, "f") is None
    with pytest.raises(ValueError):
        cache.KeyValueCache(held, most=1).set("f", f.df)
    with pytest.raises(ValueError):
        cache.FilesystemCache(str(tmp_path)).set("../f", f.df)
    assert {type(s.load(s.dump({"a": 1}))) for s in (cache.NativeSerializer(), cache.CompressingSerializer(), cache.Base64Serializer())} == {dict}
