"""Joins: expressions of equality between two frames' columns, and the rule of one match per row."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import Context, _aligned, comparable, ref

TYPES = ("inner", "left", "left_anti", "right")


class Comparison:
    """Pairs of columns that must match: alternatives of conditions that all hold. Each condition is (left, right, strict)."""

    def __init__(self, alternatives: tuple[tuple[tuple[str, str, bool], ...], ...]) -> None:
        self.alternatives = alternatives

    @property
    def keys(self) -> tuple[tuple[str, str], ...]:
        return tuple(dict.fromkeys((a, b) for parts in self.alternatives for a, b, _ in parts))

    def conditions(self, a: DataFrame, b: DataFrame, names: dict[str, str]) -> list[Column]:
        """One condition for each alternative; ``names`` are the right columns' names in the join."""

        def one(left: str, right: str, strict: bool) -> Column:
            ka, kb = a.schema[left].dataType, b.schema[right].dataType
            x, y = F.col(f"`{left}`"), F.col(f"`{names[right]}`")
            if strict:  # of unlike types only nulls are equal; a key of its own, so that this is an equi-join too
                return x.eqNullSafe(y) if ka == kb else F.when(x.isNull(), F.lit(1)) == F.when(y.isNull(), F.lit(1))
            comparable(ka, kb)
            x, y = _aligned(x, y, ka, kb)
            return x.eqNullSafe(y)

        return [functools.reduce(lambda p, q: p & q, [one(*part) for part in parts]) for parts in self.alternatives]


def equal(left: str, right: str) -> Comparison:
    """Loose equality: types that compare are brought together, and two nulls are equal."""
    return Comparison((((left, right, False),),))


def identical(left: str, right: str) -> Comparison:
    """Equal value and type."""
    return Comparison((((left, right, True),),))


def compare_all(*parts: Comparison) -> Comparison:
    return Comparison(tuple(sum(chosen, ()) for chosen in itertools.product(*[p.alternatives for p in parts])))


def compare_any(*parts: Comparison) -> Comparison:
    return Comparison(sum((p.alternatives for p in parts), ()))


class On:
    def __init__(self, comparison: Comparison, prefix: str = "") -> None:
        self.comparison, self.prefix = comparison, prefix


def join_on(on: dict[str, str] | Comparison | list[Comparison], prefix: str = "") -> On:
    if isinstance(on, dict):
        on = [equal(a, b) for a, b in on.items()]
    if isinstance(on, list):
        on = on[0] if len(on) == 1 else compare_all(*on)
    return On(on, prefix)


def join(left: DataFrame, right: DataFrame, on: On, how: str = "left", match: str = "all", order_by: list[str] | None = None) -> DataFrame:
    """All columns of both sides, the right ones with the prefix. ``match="first"``: of the right rows of each key the first by ``order_by``."""
    if how not in TYPES:
        raise ValueError(f"join is one of {', '.join(TYPES)}")
    if match == "first":
        if not order_by:
            raise ValueError("the first match needs an order")
        ctx = Context(right)
        w = Window.partitionBy(*[k for _, k in on.comparison.keys]).orderBy(*[ref(o).resolve(ctx) for o in order_by])
        right = right.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
    hidden = {c: f"_right_{i}_{c}" for i, c in enumerate(right.columns)}
    other = right.select(*[F.col(f"`{c}`").alias(n) for c, n in hidden.items()])  # names of its own: a frame may meet one that is derived from it
    conditions = on.comparison.conditions(left, right, hidden)
    if how == "left_anti":
        return functools.reduce(lambda df, c: df.join(other, c, "left_anti"), conditions, left)
    renamed = [on.prefix + c for c in right.columns]
    clash = set(renamed) & set(left.columns)
    if clash:
        raise ValueError(f"both sides have {', '.join(sorted(clash))}; give a prefix")
    columns = [F.col(f"`{c}`") for c in left.columns] + [F.col(f"`{hidden[c]}`").alias(n) for c, n in zip(right.columns, renamed)]
    if len(conditions) == 1:
        return left.join(other, conditions[0], how).select(*columns)
    # an equi-join for each alternative, less the pairs that an earlier one has found; never a loop over all pairs
    found = [left.join(other, c if not i else c & ~functools.reduce(lambda p, q: p | q, conditions[:i]), "inner") for i, c in enumerate(conditions)]
    if how in ("left", "right"):
        own, lacking = (left, other) if how == "left" else (other, left)
        alone = functools.reduce(lambda df, c: df.join(lacking, c, "left_anti"), conditions, own)
        found.append(alone.withColumns({f.name: F.lit(None).cast(f.dataType) for f in lacking.schema}))
    return functools.reduce(lambda p, q: p.unionByName(q), found).select(*columns)


def cross_join(left: DataFrame, right: DataFrame, prefix: str = "", compat: bool = False) -> DataFrame:
    """``compat``: an empty side leaves the other one as it is."""
    renamed = right.toDF(*[prefix + c for c in right.columns])
    clash = set(renamed.columns) & set(left.columns)
    if clash:
        raise ValueError(f"both sides have {', '.join(sorted(clash))}; give a prefix")
    if compat and right.isEmpty():
        return left
    if compat and left.isEmpty():
        return renamed
    return left.crossJoin(renamed)
