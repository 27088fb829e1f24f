"""As-of and interval joins against loops over all pairs."""

import bisect
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import temporal
from tessera.operators.frame import Frame
from tessera.operators.temporal import asof_join, interval_join


def _frame(spark, rows, schema):
    return Frame(spark.createDataFrame(rows, schema).repartition(3))


def brute_asof(left, right, direction, strict, tolerance):
    out = []
    for i, k, t in left:
        best = None
        for j, kk, tt in right:
            if t is None or tt is None or k != kk or (strict and t == tt):
                continue
            d = t - tt
            if (direction == "backward" and d < 0) or (direction == "forward" and d > 0):
                continue
            before = d >= 0
            # nearest: least distance, the earlier of two; ties of one time: the greatest before, the least after
            rank = (-abs(d), before, j if before and direction != "forward" else -j)
            if best is None or rank > best[0]:
                best = (rank, j, tt)
        if best and tolerance is not None and abs(t - best[2]) > tolerance:
            best = None
        out.append((i, k, t, best and best[1]))
    return sorted(out, key=str)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize(("range_rows", "tolerance"), [(500_000, None), (20, None), (20, 3)])
def test_asof_equals_all_pairs(spark, direction, strict, range_rows, tolerance):
    rng = random.Random(7)
    # a third of all rows has key 1; times tie
    key = lambda: rng.choice([1, 1, 1, 2, 3, 4, None, 6, 7])
    left = [(i, key(), rng.choice([None, *range(60)])) for i in range(150)]
    right = [(j, key(), rng.choice([None, *range(0, 120, 2)])) for j in range(120)]
    a = _frame(spark, left, "i int, k int, t int")
    b = _frame(spark, right, "j int, k int, t int")
    got = asof_join(a, b, "t", ["k"], direction, strict, tolerance, prefix="r_", range_rows=range_rows).df.collect()
    if direction == "nearest":
        # a tie of one time on the side after takes the least, on the side before the greatest
        want = brute_nearest(left, right, strict, tolerance)
    else:
        want = brute_asof(left, right, direction, strict, tolerance)
    assert sorted(((r.i, r.k, r.t, r.r_j) for r in got), key=str) == want


def brute_nearest(left, right, strict, tolerance):
    back = {r[0]: r for r in brute_asof(left, right, "backward", strict, None)}
    ahead = {r[0]: r for r in brute_asof(left, right, "forward", strict, None)}
    time = {j: t for j, _, t in right}
    out = []
    for i, k, t in left:
        options = [(abs(t - time[r[3]]), n, r[3]) for n, r in enumerate((back[i], ahead[i])) if r[3] is not None]
        best = min(options) if options else None
        out.append((i, k, t, best[2] if best and (tolerance is None or best[0] <= tolerance) else None))
    return sorted(out, key=str)


def test_asof_of_moments_without_a_key_and_inner(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    a = _frame(spark, [(m, at(m)) for m in range(0, 300, 7)], "m int, at timestamp")
    b = _frame(spark, [(p, at(p)) for p in range(10, 300, 50)], "price int, seen timestamp")
    for range_rows in (500_000, 9):
        got = asof_join(a, b, ("at", "seen"), tolerance="30 minutes", how="inner", range_rows=range_rows).df.collect()
        want = {m: max(p for p in range(10, 300, 50) if p <= m) for m in range(10, 300) if m % 7 == 0}
        assert {r.m: r.price for r in got} == {m: p for m, p in want.items() if m - p <= 30}


def test_asof_edges(spark):
    a = _frame(spark, [(1, 5)], "i int, t int")
    none = Frame(spark.createDataFrame([], "t int, j int"))
    assert [tuple(r) for r in asof_join(a, none, "t", prefix="r_").df.collect()] == [(1, 5, None, None)]
    assert asof_join(none, a, "t", prefix="r_").df.collect() == []
    with pytest.raises(ValueError, match="prefix"):
        asof_join(a, none, "t")
    with pytest.raises(ValueError):
        asof_join(a, none, "t", direction="sideways", prefix="r_")


def test_hot_key_is_cut_into_ranges(spark):
    a = Frame(spark.range(3000).selectExpr("id AS i", "id AS t"))
    b = Frame(spark.range(3000).where("id % 100 = 0").selectExpr("id AS j", "id AS t2"))
    out = asof_join(a, b, ("t", "t2"), range_rows=200)
    plan = out.df._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_b" in plan and "CartesianProduct" not in out.df._jdf.queryExecution().executedPlan().toString()
    assert all(r.j == r.i // 100 * 100 for r in out.df.collect())


def brute_overlaps(left, right, closed):
    out = []
    for i, k, s, e in left:
        for j, kk, ss, ee in right:
            if k == kk and None not in (s, e, ss, ee) and ((s <= ee and ss <= e) if closed else (s < ee and ss < e)):
                out.append((i, j))
    return sorted(out)


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("kind", ["long", "double"])
def test_intervals_equal_all_pairs(spark, closed, kind):
    rng = random.Random(5)

    def some(n):
        rows = []
        for i in range(n):
            s = rng.choice([None, 0, -40, *range(-300, 300)])
            length = rng.choice([0, 0, 1, 2, 3, 7, 8, 9, 64, 500, -3])
            s = s if s is None or kind == "long" else s / 4
            rows.append((i, rng.choice([1, 1, 1, 2, None]), s, None if s is None or rng.random() < 0.03 else s + length))
        return rows

    left, right = some(220), some(260)
    schema = f"k int, s {kind}, e {kind}"
    a, b = _frame(spark, left, f"i int, {schema}"), _frame(spark, right, f"j int, {schema}")
    got = interval_join(a, b, ("s", "e"), ("s", "e"), ["k"], closed, prefix="r_")
    assert sorted((r.i, r.r_j) for r in got.df.collect()) == brute_overlaps(left, right, closed)
    assert "NestedLoop" not in got.df._jdf.queryExecution().executedPlan().toString()
    kept = interval_join(a, b, ("s", "e"), ("s", "e"), ["k"], closed, how="left", prefix="r_").df.collect()
    matched = {i for i, _ in brute_overlaps(left, right, closed)}
    assert sorted(r.i for r in kept if r.r_j is None) == [i for i, *_ in left if i not in matched]


def test_points_in_a_crowded_bin_and_long_intervals(spark):
    points = Frame(spark.range(5000).selectExpr("id AS p", "cast(id % 10 AS long) AS at"))  # all in one bin of the wide intervals
    spans = _frame(spark, [(0, 0, 2), (1, 0, 10**15), (2, 50, 60), (3, 9, 9)], "j int, s long, e long")
    out = interval_join(points, spans, ("at", "at"), ("s", "e"))
    counts = {r.j: r["count"] for r in out.df.groupBy("j").count().collect()}
    assert counts == {0: 1500, 1: 5000, 3: 500}


def test_interval_edges(spark):
    a = _frame(spark, [(1, 1, 2)], "i int, s int, e int")
    none = Frame(spark.createDataFrame([], "j int, s int, e int"))
    assert interval_join(a, none, ("s", "e"), ("s", "e"), prefix="r_").df.collect() == []
    assert interval_join(none, a, ("s", "e"), ("s", "e"), prefix="r_").df.collect() == []
    assert len(interval_join(a, none, ("s", "e"), ("s", "e"), how="left", prefix="r_").df.collect()) == 1
    with pytest.raises(TypeError):
        interval_join(_frame(spark, [("a", "b")], "s string, e string"), a, ("s", "e"), ("s", "e"), prefix="r_")


def test_sparse_keys_meet_without_bins(spark):
    spans = Frame(spark.range(400).selectExpr("id AS j", "id % 100 AS k", "id AS s", "id + 1 + id % 50 AS e"))
    points = Frame(spark.range(900).selectExpr("id AS i", "id % 120 AS k", "id AS at"))
    out = interval_join(points, spans, ("at", "at"), ("s", "e"), ["k"], how="left", prefix="r_").df
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Join ") == 1
    left, right = ([tuple(r) for r in f.df.collect()] for f in (points, spans))
    found = brute_overlaps([(i, k, t, t) for i, k, t in left], right, True)
    met = {i for i, _ in found}
    assert sorted((r.i, -1 if r.r_j is None else r.r_j) for r in out.collect()) == sorted(found + [(i, -1) for i, *_ in left if i not in met])


def test_ranges_stay_small_however_many_rows(spark):
    both = spark.range(20_000).selectExpr("id AS _t")
    ranged, bounds, _ = temporal._ranged(both, [], 20)
    assert len(bounds) > 900 and ranged.groupBy("_b").count().agg(F.max("count")).first()[0] <= 80
    assert all(r._b == bisect.bisect_right(bounds, r._t) for r in ranged.collect())
    nulls = spark.range(1).select(temporal._range_of(F.lit(None).cast("long"), bounds).alias("b"))
    assert nulls.first().b == len(bounds)
