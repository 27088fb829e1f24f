"""Rows that fail: left out with a reason, left as they are, or fatal."""

import json

import pytest

from tessera import sinks
from tessera.functions import ref
from tessera.sources.files import from_parquet
from tessera.sources.memory import from_array

ROWS = [{"i": 1, "t": "10", "d": "2024-01-02"}, {"i": 2, "t": "x", "d": "2024-01-03"}, {"i": 3, "t": None, "d": "never"}, {"i": 4, "t": "7", "d": None}]


def ids(f):
    return sorted(r.i for r in f.fetch())


def rejects(f):
    return sorted((json.loads(r.row)["i"], r.reason) for r in f.rejected().fetch())


def test_a_cast_that_fails_leaves_its_row_out(spark, tmp_path):
    f = from_array(spark, ROWS).on_error("skip").with_entry("n", ref("t").cast("int")).with_entry("day", ref("d").to_date())
    assert ids(f) == [1, 4] and [r.n for r in f.sort_by("i").fetch()] == [10, 7]
    assert rejects(f) == [(2, "n has no such value"), (3, "day has no such value")]
    f.rejected().write(sinks.to_parquet(str(tmp_path / "dead")))
    assert from_parquet(spark, str(tmp_path / "dead")).count() == 2
    kept = from_array(spark, ROWS).with_entry("n", ref("t").cast("int"))
    assert ids(kept) == [1, 2, 3, 4] and kept.rejected().fetch() == []


def test_a_function_that_fails(spark):
    def halved(r):
        return r | {"t": str(100 // (r["i"] - 2))}

    f = from_array(spark, ROWS)
    skipped = f.on_error("skip").map(halved).flat_map(lambda r: [r] if r["i"] < 4 else [r][5], f.df.schema)
    assert ids(skipped) == [1, 3]
    assert rejects(skipped) == [(2, "ZeroDivisionError: integer division or modulo by zero"), (4, "IndexError: list index out of range")]
    assert sorted((r.i, r.t) for r in f.on_error("ignore").map(halved).fetch()) == [(1, "-100"), (2, "x"), (3, "100"), (4, "50")]
    with pytest.raises(Exception, match="ZeroDivisionError"):
        f.map(halved).fetch()
    with pytest.raises(ValueError):
        f.on_error("sometimes")


def test_long_numbers_and_nested_values_go_through(spark):
    rows = [{"i": 2**60 + k, "l": [1, 2], "s": {"a": None if k else 1}} for k in range(3)]

    def some(r):
        if r["i"] == 2**60:
            raise KeyError("first")
        return r

    f = from_array(spark, rows).on_error("skip").map(some)
    assert ids(f) == [2**60 + 1, 2**60 + 2] and rejects(f) == [(2**60, "KeyError: 'first'")]
