"""Aggregates and window functions. An aggregate is named ``<column>_<function>`` unless it has an alias."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as SparkWindow
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expr import NUMBERS, TIMES, Context, Expr, as_expr


class Window:
    """Immutable: partition, order and frame. Without a frame aggregates see the whole partition; ranks and offsets follow the order.

    Frames go beyond the usual windows: ``rows_between`` counts rows, ``range_between`` distances of the one number or time that orders (for times in seconds). None is an open end, 0 the row
    itself (with RANGE and its equals), negative numbers are before it."""

    def __init__(self, partitions: tuple = (), orders: tuple = (), frame: tuple | None = None) -> None:
        self.partitions, self.orders, self.frame = partitions, orders, frame

    def partition_by(self, *keys: str | Expr) -> Window:
        return Window(self.partitions + tuple(map(as_expr, keys)), self.orders, self.frame)

    def order_by(self, *orders) -> Window:
        return Window(self.partitions, self.orders + tuple(o if isinstance(o, tuple) else (as_expr(o), True) for o in orders), self.frame)

    def _framed(self, kind: str, start: float | None, end: float | None) -> Window:
        if start is not None and end is not None and start > end:
            raise ValueError("a frame ends before it begins")
        return Window(self.partitions, self.orders, (kind, start, end))

    def rows_between(self, start: int | None, end: int | None) -> Window:
        return self._framed("rows", start, end)

    def range_between(self, start: float | None, end: float | None) -> Window:
        return self._framed("range", start, end)

    def spec(self, ctx: Context, extra: tuple = ()) -> WindowSpec:
        return SparkWindow.partitionBy(*[p.resolve(ctx) for p in (*self.partitions, *extra)])

    def ordered(self, ctx: Context) -> WindowSpec:
        if not self.orders:
            raise ValueError("a rank needs an order")
        return self.spec(ctx).orderBy(*[sort_column(o, ctx) for o in self.orders])

    def framed(self, ctx: Context) -> WindowSpec:
        """With the frame, or the whole partition."""
        if self.frame is None:
            return self.spec(ctx).rowsBetween(SparkWindow.unboundedPreceding, SparkWindow.unboundedFollowing)
        kind, start, end = self.frame
        low = SparkWindow.unboundedPreceding if start is None else start
        high = SparkWindow.unboundedFollowing if end is None else end
        if not self.orders:
            raise ValueError("a frame needs an order")
        if kind == "rows":
            return self.ordered(ctx).rowsBetween(low, high)
        if len(self.orders) != 1:
            raise ValueError("a range has one order")
        e, up = self.orders[0]
        at, of = e.resolve(ctx), ctx.type_of(e)
        if isinstance(of, TIMES):
            at = F.unix_micros(at.cast("timestamp"))
            low, high = (x if abs(x) > 2**62 else int(x * 1_000_000) for x in (low, high))
        elif not isinstance(of, NUMBERS):
            raise TypeError(f"no distances between values of {of.simpleString()}")
        return self.spec(ctx).orderBy(at.asc_nulls_first() if up else at.desc_nulls_last()).rangeBetween(low, high)


def sort_column(order, ctx: Context) -> Column:
    e, up = order if isinstance(order, tuple) else (as_expr(order), True)
    c = e.resolve(ctx)
    return c.asc_nulls_first() if up else c.desc_nulls_last()


def window() -> Window:
    return Window()


class Agg:
    def __init__(self, suffix: str, e: str | Expr, build: Callable[[Context, Expr], Column], over: Callable | None = None, name: str | None = None) -> None:
        self.suffix, self.e, self.build, self._over = suffix, as_expr(e), build, over
        self.name = name or f"{self.e.name or 'value'}_{suffix}"

    def alias(self, name: str) -> Agg:
        return Agg(self.suffix, self.e, self.build, self._over, name)

    as_ = alias

    def resolve(self, ctx: Context) -> Column:
        return self.build(ctx, self.e)

    def over(self, w: Window) -> Expr:
        if self._over:
            return Expr(lambda ctx: self._over(ctx, self.e, w), name=self.name)
        return Expr(lambda ctx: self.build(ctx, self.e).over(w.framed(ctx)), name=self.name)


def _number(ctx: Context, e: Expr) -> Column:
    """The value as a number; numeric text counts, anything else does not."""
    kind, x = ctx.type_of(e), e.resolve(ctx)
    if isinstance(kind, NUMBERS):
        return x
    return x.try_cast("double") if isinstance(kind, T.StringType) else F.lit(None).cast("double")


def sum_(e: str | Expr) -> Agg:
    """0 if there is no number."""

    def build(ctx, e):
        x = _number(ctx, e)
        return F.coalesce(F.sum(x), F.lit(0))

    def over(ctx, e, w):
        return F.coalesce(F.sum(_number(ctx, e)).over(w.framed(ctx)), F.lit(0))

    return Agg("sum", e, build, over)


def average(e: str | Expr) -> Agg:
    def over(ctx, e, w):
        return F.coalesce(F.avg(_number(ctx, e)).over(w.framed(ctx)), F.lit(0.0))

    return Agg("avg", e, lambda ctx, e: F.coalesce(F.avg(_number(ctx, e)), F.lit(0.0)), over)


def count(e: str | Expr) -> Agg:
    """Rows, nulls included. Over a window: rows of the partition with the same value; of one with a frame, the frame's rows."""
    return Agg("count", e, lambda ctx, e: F.count(F.lit(1)), lambda ctx, e, w: F.count(F.lit(1)).over(w.framed(ctx) if w.frame else w.spec(ctx, (e,))))


def count_non_null(e: str | Expr) -> Agg:
    return Agg("count", e, lambda ctx, e: F.count(e.resolve(ctx)))


def _extreme(ctx: Context, e: Expr) -> Column:
    return e.resolve(ctx) if isinstance(ctx.type_of(e), TIMES) else _number(ctx, e)


def min_(e: str | Expr) -> Agg:
    """Of numbers and moments; other texts do not count."""
    return Agg("min", e, lambda ctx, e: F.min(_extreme(ctx, e)))


def max_(e: str | Expr) -> Agg:
    return Agg("max", e, lambda ctx, e: F.max(_extreme(ctx, e)))


def _order(ctx: Context, by) -> Column:
    return F.struct(*[as_expr(b).resolve(ctx) for b in ([by] if isinstance(by, (str, Expr)) else by)])


def first(e: str | Expr, order_by=None) -> Agg:
    """By ``order_by`` the value of the least row, nulls included; without it any row's."""
    return Agg("first", e, lambda ctx, e: F.first(e.resolve(ctx)) if order_by is None else F.min_by(F.struct(e.resolve(ctx).alias("x")), _order(ctx, order_by)).getField("x"))


def last(e: str | Expr, order_by=None) -> Agg:
    return Agg("last", e, lambda ctx, e: F.last(e.resolve(ctx)) if order_by is None else F.max_by(F.struct(e.resolve(ctx).alias("x")), _order(ctx, order_by)).getField("x"))


def _collected(ctx: Context, e: Expr, order_by) -> Column:
    x = e.resolve(ctx)
    if order_by is None:
        return F.transform(F.collect_list(F.struct(x.alias("x"))), lambda s: s["x"])  # the struct keeps nulls
    return F.transform(F.sort_array(F.collect_list(F.struct(_order(ctx, order_by).alias("o"), x.alias("x")))), lambda s: s["x"])


def collect(e: str | Expr, order_by=None) -> Agg:
    """All values, nulls included, in the order of ``order_by``."""
    return Agg("collection", e, lambda ctx, e: _collected(ctx, e, order_by))


def collect_unique(e: str | Expr, order_by=None) -> Agg:
    return Agg("collection_unique", e, lambda ctx, e: F.array_distinct(_collected(ctx, e, order_by)))


class Ranking:
    def __init__(self, name: str, made: Callable[[], Column]) -> None:
        self.name, self._made = name, made

    def over(self, w: Window) -> Expr:
        return Expr(lambda ctx: self._made().over(w.ordered(ctx)), name=self.name)


def row_number() -> Ranking:
    return Ranking("row_number", F.row_number)


def rank() -> Ranking:
    return Ranking("rank", F.rank)


def dense_rank() -> Ranking:
    return Ranking("dense_rank", F.dense_rank)


dens_rank = dense_rank


# windows beyond the usual ones


class Offset:
    """A value of another row of the window's order."""

    def __init__(self, name: str, e: str | Expr, made: Callable[[Column], Column], framed: bool = False) -> None:
        self.e = as_expr(e)
        self.name, self._made, self._framed = f"{self.e.name or 'value'}_{name}", made, framed

    def over(self, w: Window) -> Expr:
        """First and last values are those of the frame; without one, of the whole partition in its order."""
        if not self._framed:
            return Expr(lambda ctx: self._made(self.e.resolve(ctx)).over(w.ordered(ctx)), name=self.name)
        return Expr(lambda ctx: self._made(self.e.resolve(ctx)).over((w if w.frame else w.rows_between(None, None)).framed(ctx)), name=self.name)


def lag(e: str | Expr, n: int = 1, default=None) -> Offset:
    return Offset("lag", e, lambda c: F.lag(c, n, default))


def lead(e: str | Expr, n: int = 1, default=None) -> Offset:
    return Offset("lead", e, lambda c: F.lead(c, n, default))


def first_value(e: str | Expr, ignore_nulls: bool = False) -> Offset:
    return Offset("first_value", e, lambda c: F.first_value(c, F.lit(ignore_nulls)), framed=True)


def last_value(e: str | Expr, ignore_nulls: bool = False) -> Offset:
    return Offset("last_value", e, lambda c: F.last_value(c, F.lit(ignore_nulls)), framed=True)


def nth_value(e: str | Expr, n: int) -> Offset:
    return Offset("nth_value", e, lambda c: F.nth_value(c, n), framed=True)


def ntile(n: int) -> Ranking:
    return Ranking("ntile", lambda: F.ntile(n))


def percent_rank() -> Ranking:
    return Ranking("percent_rank", F.percent_rank)


def cume_dist() -> Ranking:
    return Ranking("cume_dist", F.cume_dist)
