"""Joins by order instead of equality: the nearest row in time, and intervals that overlap. Both go beyond the usual verbs and use DataFrame functions only."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frame import Frame, _ties

#: A key with more rows is cut into time ranges of about so many rows, RANGES at most.
RANGE_ROWS, RANGES = 500_000, 4096

#: Rows that a task sorts, about; ranges are dealt over as many tasks as that takes.
TASK_ROWS = 500_000

#: At most so many keys, or keys and ranges, go out as a broadcast.
BROADCAST_ROWS = 100_000

#: Keys of at most so many right intervals meet by key alone, without bins: a left row has few to be tested against.
FEW = 64

DIRECTIONS = ("backward", "forward", "nearest")


def _pairs(by) -> list[tuple[str, str]]:
    return list(by.items()) if isinstance(by, dict) else [(k, k) for k in by]


def _packed(df: DataFrame, name: str) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _same(keys: list[str], a: str, b: str) -> Column:
    """Equal keys, nulls too, under these prefixes."""
    return functools.reduce(lambda x, k: x & F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}")), keys, F.lit(True))


def _range_of(time: Column, bounds: list) -> Column:
    """How many bounds are at or before a number, by a balanced tree of comparisons; null goes last."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(time < F.lit(bounds[mid]), tree(low, mid)).otherwise(tree(mid + 1, high))

    each = max(1, math.isqrt(len(bounds)))
    if each < 8:
        return tree(0, len(bounds))
    # many bounds: first which run of them, then where in the run; one tree over all is more code than is compiled
    runs = [bounds[i : i + each] for i in range(0, len(bounds), each)]
    run = F.greatest(_range_of(time, [r[0] for r in runs]) - 1, F.lit(0))
    table = F.array(*[F.array(*[F.lit(x) for x in r]) for r in runs])
    return F.when(time.isNull(), F.lit(len(bounds))).otherwise(run * each + F.size(F.filter(F.get(table, run), lambda x: x <= time)))


def asof_join(left: Frame, right: Frame, on: str | tuple[str, str], by: dict[str, str] | list[str] = (), direction: str = "backward", strict: bool = False, tolerance: str | float | None = None, how: str = "left", prefix: str = "", range_rows: int = RANGE_ROWS) -> Frame:
    """For each left row the right row of its key that is nearest before it (``backward``), after it (``forward``) or either way (``nearest``; of equal distances the earlier).

    ``on`` names the time, or the left and the right one; rows of one time match unless ``strict``. Of right rows of one key and time the greatest by its other columns is taken (the
    least for ``forward``). ``tolerance`` is the greatest distance, a number or an interval (``1 hour``). Null keys are equal, null times match nothing. ``how``: ``left`` keeps left rows without a match, ``inner`` does not.
    A right column that the left side has too needs a ``prefix``.

    Both sides meet in one shuffle by key and are sorted by time; the last right row is carried along. A key of more than ``range_rows`` rows is cut into
    time ranges, each sorted on its own, and what a range begins with is handed over from the ranges before it: no task sorts a whole hot key."""
    if direction not in DIRECTIONS or how not in ("left", "inner"):
        raise ValueError("direction is backward, forward or nearest; how is left or inner")
    times = (on, on) if isinstance(on, str) else on
    pairs = _pairs(by)
    renamed = [prefix + c for c in right.columns]
    clash = set(renamed) & set(left.columns)
    if clash:
        raise ValueError(f"both sides have {', '.join(sorted(clash))}; give a prefix")
    keys = [f"_k{i}" for i in range(len(pairs))]
    rows = left.df.select(*[F.col(f"`{a}`").alias(k) for k, (a, _) in zip(keys, pairs)], F.col(f"`{times[0]}`").alias("_t"), F.lit(1).alias("_side"), _packed(left.df, "_l"))
    others = right.df.where(F.col(f"`{times[1]}`").isNotNull())
    order = F.struct(*_ties(others)).alias("_tie")
    others = others.select(*[F.col(f"`{b}`").alias(k) for k, (_, b) in zip(keys, pairs)], F.col(f"`{times[1]}`").alias("_t"), F.lit(0).alias("_side"), _packed(others, "_r"), order)
    both = rows.unionByName(others, allowMissingColumns=True)
    both, bounds, hot = _ranged(both, keys, range_rows)
    found = []
    for forward in {"backward": [False], "forward": [True], "nearest": [False, True]}[direction]:
        name = f"_m{int(forward)}"
        both = _carried(both, keys, bounds, hot, forward, strict, name)
        found.append(F.col(name))
    out = both.where("_side = 1")
    distances = [_distance(F.col("_t"), m[times[1]], both.schema["_t"].dataType) for m in found]
    match = found[0] if len(found) == 1 else F.when(found[1].isNull() | (distances[0] <= distances[1]), found[0]).otherwise(found[1])
    if tolerance is not None:
        at = match[times[1]]
        limit = F.lit(tolerance) if not isinstance(tolerance, str) else F.expr(f"interval {tolerance}")
        match = F.when((at + limit >= F.col("_t")) & (F.col("_t") + limit >= at), match)
    out = out.select("_l", match.alias("_m"))
    out = out.where(F.col("_m").isNotNull()) if how == "inner" else out
    return left._with(out.select(*[F.col("_l")[c].alias(c) for c in left.columns], *[F.col("_m")[c].alias(n) for c, n in zip(right.columns, renamed)]))


def _distance(a: Column, b: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        a, b = F.unix_micros(a), F.unix_micros(b)
    elif isinstance(kind, T.TimestampNTZType):
        a, b = F.unix_micros(a.cast("timestamp")), F.unix_micros(b.cast("timestamp"))
    elif isinstance(kind, T.DateType):
        a, b = F.unix_date(a), F.unix_date(b)
    return F.abs(a - b)


def _ranged(both: DataFrame, keys: list[str], range_rows: int) -> tuple[DataFrame, list, DataFrame | None]:
    """Adds ``_b``, the time range of rows whose key has many; the ranges' bounds, equally deep over all such keys; and those keys."""
    counts = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.where(F.col("_n") > range_rows)
    is_hot = F.col("_n") > range_rows
    some, most, total = counts.agg(F.count(F.when(is_hot, 1)), F.max(F.when(is_hot, F.col("_n"))), F.sum("_n")).first()
    if not some:
        return both.withColumn("_b", F.lit(0)), [], None
    ranges = min(RANGES, math.ceil(most / range_rows))
    flagged = hot.select(*keys, F.lit(True).alias("_hot")) if keys else None
    if keys:
        other = flagged.select(*[F.col(k).alias(f"_h{k}") for k in keys], "_hot")
        both = both.join(_small(other, some), _same(keys, "", "_h"), "left").drop(*[f"_h{k}" for k in keys])
    else:
        both = both.withColumn("_hot", F.lit(True))
    cuts = [i / ranges for i in range(1, ranges)]
    kind = both.schema["_t"].dataType
    number = F.col("_t") if isinstance(kind, T.NumericType) else F.unix_date("_t") if isinstance(kind, T.DateType) else F.unix_micros(F.col("_t").cast("timestamp"))
    bounds = sorted(set(both.where("_hot").agg(F.percentile_approx(number, cuts, max(1000, 4 * ranges))).first()[0] or []))
    both = both.withColumn("_b", F.when(F.col("_hot"), _range_of(number, bounds)).otherwise(0)).drop("_hot")
    tasks = math.ceil(total / TASK_ROWS)
    if tasks > int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")):  # else Spark deals them, and joins small ones
        both = both.repartition(tasks, *keys, "_b")
    return both, bounds, flagged


def _carried(both: DataFrame, keys: list[str], bounds: list, hot: DataFrame | None, forward: bool, strict: bool, name: str) -> DataFrame:
    """Adds the last right row before each row (the first after it, if ``forward``)."""
    down = (lambda c: c.desc()) if forward else (lambda c: c.asc())
    side = F.col("_side").desc() if strict else F.col("_side").asc()
    w = Window.partitionBy(*keys, "_b").orderBy(down(F.col("_t")), side, down(F.col("_tie"))).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn(name, F.when(F.col("_t").isNotNull(), F.last("_r", ignorenulls=True).over(w)))
    if not bounds:
        return out
    place = F.struct("_t", "_tie")
    edges = both.where("_side = 0")
    if keys:
        hot = hot.select(*[F.col(k).alias(f"_h{k}") for k in keys])
        edges = edges.join(hot, _same(keys, "", "_h"), "left_semi")
    edges = edges.groupBy(*keys, "_b").agg((F.min_by if forward else F.max_by)("_r", place).alias("_edge"))
    # an edge holds for the ranges after it up to the next edge; a key has one row a range here, RANGES + 1 at most
    by_range = Window.partitionBy(*keys).orderBy(down(F.col("_b")))
    following = F.lead("_b").over(by_range)
    if forward:
        spans = F.sequence(F.coalesce(following, F.lit(0)), F.col("_b") - 1)
        spans = F.when(F.col("_b") > 0, spans)
    else:
        spans = F.sequence(F.col("_b") + 1, F.coalesce(following, F.lit(len(bounds))))
        spans = F.when(F.col("_b") < len(bounds), spans)
    handed = edges.withColumn("_span", spans).select(*[F.col(k).alias(f"_e{k}") for k in keys], F.explode("_span").alias("_eb"), "_edge")
    condition = (F.col("_b") == F.col("_eb")) & _same(keys, "", "_e")
    rows = (hot.count() if keys else 1) * (len(bounds) + 1)
    joined = out.join(_small(handed, rows), condition, "left")
    return joined.withColumn(name, F.when(F.col("_t").isNotNull(), F.coalesce(name, "_edge"))).drop("_edge", "_eb", *[f"_e{k}" for k in keys])


def _number(c: Column, kind: T.DataType) -> Column:
    """A whole number or a double in the order of the column."""
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.IntegralType):
        return c.cast("long")
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return c.cast("double")
    raise TypeError(f"intervals of {kind.simpleString()} have no length")


def interval_join(left: Frame, right: Frame, left_on: tuple[str, str], right_on: tuple[str, str], by: dict[str, str] | list[str] = (), closed: bool = True, how: str = "inner", prefix: str = "") -> Frame:
    """Pairs of rows whose intervals overlap, and whose ``by`` columns are equal (nulls too). ``closed``: intervals that only touch overlap. A point is an interval whose two columns are one.

    Null ends match nothing. ``how``: ``inner``, or ``left``, which keeps left rows without a match. A right column that the left side has too needs a ``prefix``.

    An interval belongs to the class of its length, a power of two, and stands in the few bins of that class's width that it covers. Two intervals meet in the bins of
    the longer one's class, and are emitted from the first bin that both cover: an equi-join on key, class and bin with a residual test, which adaptive execution splits where a bin is crowded. No pair of all rows is ever formed,
    and a long interval takes no more bins than a short one. Keys of at most FEW right rows need no bins: each row is shuffled once, by key, and left rows without a match come from the same join."""
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    pairs = _pairs(by)
    renamed = [prefix + c for c in right.columns]
    clash = set(renamed) & set(left.columns)
    if clash:
        raise ValueError(f"both sides have {', '.join(sorted(clash))}; give a prefix")
    keys = [f"_k{i}" for i in range(len(pairs))]
    if pairs:
        here, there = ([F.col(f"`{p[i]}`").alias(f"_h{k}") for k, p in zip(keys, pairs)] for i in (0, 1))
        crowded = right.df.groupBy(*there).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FEW).drop("_n")
        n = crowded.count()
        if not n:
            return left._with(_few(left.df, right.df, left_on, right_on, pairs, closed, how, renamed))
        crowded = _small(crowded, n)

        def parted(df: DataFrame, names: list[Column], kind: str) -> Frame:
            on = functools.reduce(lambda x, y: x & y, [F.col(f"_h{k}").eqNullSafe(c) for k, c in zip(keys, names)])
            return Frame(df.join(crowded, on, kind))

        own, other = [F.col(f"`{x}`") for x, _ in pairs], [F.col(f"`{y}`") for _, y in pairs]
        few = _few(parted(left.df, own, "left_anti").df, parted(right.df, other, "left_anti").df, left_on, right_on, pairs, closed, how, renamed)
        return left._with(few.unionByName(_binned_join(parted(left.df, own, "left_semi").df, parted(right.df, other, "left_semi").df, left_on, right_on, pairs, closed, how, renamed)))
    return left._with(_binned_join(left.df, right.df, left_on, right_on, pairs, closed, how, renamed))


def _few(left: DataFrame, right: DataFrame, left_on: tuple[str, str], right_on: tuple[str, str], pairs: list[tuple[str, str]], closed: bool, how: str, renamed: list[str]) -> DataFrame:
    """The join by key, the intervals' overlap tested on each pair of a key."""
    a = left.select(*[F.col(f"`{c}`").alias(f"_a{i}") for i, c in enumerate(left.columns)])
    b = right.select(*[F.col(f"`{c}`").alias(f"_b{i}") for i, c in enumerate(right.columns)])
    at = lambda df, tag, name: F.col(f"{tag}{df.columns.index(name)}")
    ends = [_number(at(df, t, e), df.schema[e].dataType) for df, t, on in ((left, "_a", left_on), (right, "_b", right_on)) for e in on]
    if not all(isinstance(df.schema[e].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType, T.IntegralType)) for df, on in ((left, left_on), (right, right_on)) for e in on):
        ends = [F.when(~F.isnan(c), c) for c in (c.cast("double") for c in ends)]
    start, end, low, high = ends
    meets = (start <= high) & (low <= end) if closed else (start < high) & (low < end)
    same = functools.reduce(lambda x, y: x & y, [at(left, "_a", x).eqNullSafe(at(right, "_b", y)) for x, y in pairs])
    found = a.join(b, same & meets, how)
    return found.select(*[F.col(f"_a{i}").alias(c) for i, c in enumerate(left.columns)], *[F.col(f"_b{i}").alias(n) for i, n in enumerate(renamed)])


def _binned_join(left: DataFrame, right: DataFrame, left_on: tuple[str, str], right_on: tuple[str, str], pairs: list[tuple[str, str]], closed: bool, how: str, renamed: list[str]) -> DataFrame:
    keys = [f"_k{i}" for i in range(len(pairs))]

    def side(df: DataFrame, ends: tuple[str, str], names: list[str], tag: str) -> DataFrame:
        a, b = (_number(F.col(f"`{e}`"), df.schema[e].dataType) for e in ends)
        key = [(F.col(f"`{n}`")).alias(f"{tag}{k}") for n, k in zip(names, keys)]
        return df.select(*key, a.alias(f"{tag}s"), b.alias(f"{tag}e"), _packed(df, f"{tag}row")).where(F.col(f"{tag}s").isNotNull() & F.col(f"{tag}e").isNotNull())

    a, b = side(left, left_on, [x for x, _ in pairs], "_a"), side(right, right_on, [y for _, y in pairs], "_b")
    whole = all(isinstance(df.schema[f"{t}{e}"].dataType, T.LongType) for df, t in ((a, "_a"), (b, "_b")) for e in "se")
    if not whole:
        a, b = (df.withColumns({f"{t}{e}": F.col(f"{t}{e}").cast("double") for e in "se"}) for df, t in ((a, "_a"), (b, "_b")))
        a, b = (df.where(~F.isnan(f"{t}s") & ~F.isnan(f"{t}e")) for df, t in ((a, "_a"), (b, "_b")))
    classes = [_classes(df, t) for df, t in ((a, "_a"), (b, "_b"))]
    least = min((c for found in classes for c in found if c is not None), default=0)
    own = [sorted({least if c is None else c for c in found}) for found in classes]
    if not whole:  # bins of doubles stay within the long integers
        top = [df.agg(F.max(F.greatest(F.abs(f"{t}s"), F.abs(f"{t}e")))).first()[0] or 0.0 for df, t in ((a, "_a"), (b, "_b"))]
        if math.isinf(max(top)):
            raise ValueError("an interval ends at infinity")
        floor = math.frexp(max(top))[1] - 61
        least = max(least, floor)
        own = [sorted({max(c, floor) for c in found}) for found in own]
    a, b = _binned(a, "_a", least, own[0], own[1], whole, True), _binned(b, "_b", least, own[1], own[0], whole, False)
    condition = (F.col("_ahalf") == F.col("_bhalf")) & (F.col("_alevel") == F.col("_blevel")) & (F.col("_abin") == F.col("_bbin"))
    condition = condition & _same(keys, "_a", "_b")
    meets = (F.col("_as") <= F.col("_be")) & (F.col("_bs") <= F.col("_ae")) if closed else (F.col("_as") < F.col("_be")) & (F.col("_bs") < F.col("_ae"))
    first = F.col("_abin") == F.greatest("_afirst", "_bfirst")
    found = a.join(b, condition & meets & first)
    inner = found.select(*[F.col("_arow")[c].alias(c) for c in left.columns], *[F.col("_brow")[c].alias(n) for c, n in zip(right.columns, renamed)])
    if how == "inner":
        return inner
    matched = found.select(F.col("_arow").alias("_row")).distinct()
    rows = left.select(_packed(left, "_l"))
    alone = rows.join(matched, F.col("_l").eqNullSafe(F.col("_row")), "left_anti").select("_l.*")
    return inner.unionByName(alone, allowMissingColumns=True)


def _class(tag: str) -> Column:
    """The power of two at or just under the length; null for points."""
    length = F.abs(F.col(f"{tag}e") - F.col(f"{tag}s"))
    return F.when(length > 0, F.floor(F.log2(length)).cast("int"))


def _classes(df: DataFrame, tag: str) -> list[int | None]:
    return [r[0] for r in df.select(_class(tag).alias("c")).distinct().collect()]  # 64 or so for whole numbers, some 2,000 for doubles at most


def _binned(df: DataFrame, tag: str, least: int, mine: list[int], other: list[int], whole: bool, left: bool) -> DataFrame:
    """A row for each bin: in the first half of the join the left interval's class is at least the right one's, in the second it is less."""
    df = df.withColumn(f"{tag}class", F.greatest(F.coalesce(_class(tag), F.lit(least)), F.lit(least)))
    at_own = F.array(F.struct(F.lit(0 if left else 1).alias("half"), F.col(f"{tag}class").alias("level")))
    above = F.array(*[F.lit(c) for c in other]) if other else F.array().cast("array<int>")
    longer = F.filter(above, lambda c: (c > F.col(f"{tag}class")) if left else (c >= F.col(f"{tag}class")))
    levels = F.concat(at_own, F.transform(longer, lambda c: F.struct(F.lit(1 if left else 0).alias("half"), c.alias("level"))))
    rows = df.withColumn("_at", F.explode(levels)).withColumns({f"{tag}half": F.col("_at.half"), f"{tag}level": F.col("_at.level")}).drop("_at")
    low, high = F.least(f"{tag}s", f"{tag}e"), F.greatest(f"{tag}s", f"{tag}e")

    def bin_of(c: Column) -> Column:
        level = F.col(f"{tag}level")
        return F.call_function("shiftright", c, F.least(level + 1, F.lit(62))) if whole else F.floor(c / F.pow(F.lit(2.0), level + 1)).cast("long")

    rows = rows.withColumn(f"{tag}first", bin_of(low))
    return rows.withColumn(f"{tag}bin", F.explode(F.sequence(f"{tag}first", bin_of(high))))
