"""Frames, offsets and grouping sets where SQL rows do not reach: refusals and nulls."""

import pytest

from tessera import functions as fn
from tessera.sources.memory import from_array

ROWS = [{"k": "a", "n": 1, "v": 10}, {"k": "a", "n": 2, "v": None}, {"k": "a", "n": None, "v": 30}, {"k": None, "n": 4, "v": 40}]


def test_frames_are_checked(spark):
    f = from_array(spark, ROWS)
    w = fn.window().partition_by("k")
    for bad in (w.rows_between(0, 1), w.order_by("n", "v").range_between(-1, 0)):
        with pytest.raises(ValueError):
            f.with_entry("x", fn.sum_("v").over(bad))
    with pytest.raises(ValueError, match="ends before"):
        w.rows_between(2, 1)
    with pytest.raises(TypeError):
        f.with_entry("x", fn.sum_("v").over(w.order_by("k").range_between(-1, 0)))
    with pytest.raises(ValueError):
        f.with_entry("x", fn.lag("v").over(w))


def test_offsets_and_frames_see_nulls_first(spark):
    w = fn.window().partition_by("k").order_by("n")
    f = from_array(spark, ROWS).with_entries({"before": fn.lag("v").over(w), "total": fn.sum_("v").over(w.rows_between(None, 0)), "last": fn.last_value("v", True).over(w), "n_": fn.count("v").over(w.range_between(-1, 0))})
    got = {(r.k, r.n): (r.before, r.total, r["last"], r.n_) for r in f.fetch()}
    assert got[("a", None)] == (None, 30, 10, 1) and got[("a", 1)] == (30, 40, 10, 1) and got[("a", 2)] == (10, 40, 10, 2)
    assert got[(None, 4)] == (None, 40, 40, 1)


def test_null_keys_differ_from_totals(spark):
    f = from_array(spark, ROWS).group_by("k").rollup("level").aggregate(fn.sum_("v").alias("v"), fn.count("k").alias("n"))
    assert {(r.k, r.level): (r.v, r.n) for r in f.fetch()} == {("a", 0): (40, 3), (None, 0): (40, 1), (None, 1): (80, 4)}
    with pytest.raises(ValueError):
        from_array(spark, ROWS).group_by("k").grouping_sets(["n"])
    with pytest.raises(ValueError):
        from_array(spark, ROWS).group_by("k").grouping_sets()
