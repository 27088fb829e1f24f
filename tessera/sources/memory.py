"""Sources without files: literal rows, sequences, unions."""

from __future__ import annotations

import functools
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import variants
from ..operators.frame import Frame
from ..schema import Schema, merge_types


def infer(value: Any) -> T.DataType:
    """The type of a Python value: lists of one type, maps of texts to one type, other dictionaries as structures."""
    import datetime as dt

    if value is None:
        return T.NullType()
    for kind, made in ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (str, T.StringType()), (dt.datetime, T.TimestampType()), (dt.date, T.TimestampType()), (bytes, T.BinaryType())):
        if isinstance(value, kind):
            return made
    if isinstance(value, dict):
        if not value:
            return T.MapType(T.StringType(), T.StringType())
        if all(isinstance(k, int) for k in value):
            return T.MapType(T.LongType(), functools.reduce(merge_types, map(infer, value.values())))
        return T.StructType([T.StructField(str(k), _solid(infer(v))) for k, v in value.items()])
    if isinstance(value, (list, tuple)):
        return T.ArrayType(_solid(functools.reduce(_merge, map(infer, value), T.NullType())))
    raise TypeError(f"no type for {type(value).__name__}")


def _solid(kind: T.DataType) -> T.DataType:
    return T.StringType() if isinstance(kind, T.NullType) else kind


def _merge(a: T.DataType, b: T.DataType) -> T.DataType:
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = {**{f.name: f.dataType for f in a}}
        for f in b:
            names[f.name] = _merge(names[f.name], f.dataType) if f.name in names else f.dataType
        return T.StructType([T.StructField(n, t) for n, t in names.items()])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_merge(a.elementType, b.elementType))
    return merge_types(a, b)


def infer_schema(rows: list[dict]) -> T.StructType:
    """Of rows that may differ in their columns."""
    kinds: dict[str, T.DataType] = {}
    for r in rows:
        for k, v in r.items():
            kinds[k] = _merge(kinds.get(k, T.NullType()), infer(v))
    return T.StructType([T.StructField(k, _solid(v)) for k, v in kinds.items()])


def _fit(value: Any, kind: T.DataType) -> Any:
    """The value in its column's type: integers in a column of floats, texts for scalars in a column of texts."""
    if value is None:
        return None
    if isinstance(kind, T.VariantType):
        return variants.as_json(value)
    if isinstance(kind, T.DoubleType):
        return float(value)
    if isinstance(kind, T.StringType) and not isinstance(value, str):
        return str(value).lower() if isinstance(value, bool) else str(value)
    if isinstance(kind, T.StructType) and isinstance(value, dict):
        return tuple(_fit(value.get(f.name), f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return [_fit(v, kind.elementType) for v in value]
    if isinstance(kind, T.MapType):
        return {k: _fit(v, kind.valueType) for k, v in value.items()}
    return value


def from_array(spark: SparkSession, rows: list[dict], schema: Schema | T.StructType | None = None) -> Frame:
    kind = schema.struct if isinstance(schema, Schema) else schema or infer_schema(rows)
    df = spark.createDataFrame([tuple(_fit(r.get(f.name), f.dataType) for f in kind) for r in rows], variants.stand_in(kind))
    return Frame(df.select(*[variants.revived(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in kind]) if variants.holds_variant(kind) else df)


from_rows = from_memory = from_array


def from_data_frame(df: DataFrame) -> Frame:
    return Frame(df)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """By name; columns that a side lacks are null, and types that differ are merged."""
    kinds: dict[str, T.DataType] = {}
    for df in frames:
        for f in df.schema:
            kinds[f.name] = merge_types(kinds[f.name], f.dataType) if f.name in kinds else f.dataType

    def fit(f: T.StructField):
        c, kind = F.col(f"`{f.name}`"), kinds[f.name]
        if f.dataType == kind:
            return c
        return variants.to_variant(c, f.dataType) if isinstance(kind, T.VariantType) else c.cast(kind)

    def cast(df):
        return df.select(*[fit(f).alias(f.name) for f in df.schema])

    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(cast, frames))


def from_all(*frames: Frame) -> Frame:
    return Frame(union_all([f.df for f in frames]))


def chunks_from(frame: Frame, size: int) -> Frame:
    return frame.batch_size(size)


def from_sequence_number(spark: SparkSession, name: str, start: float, end: float, step: float = 1) -> Frame:
    """Both ends included."""
    if step == 0:
        raise ValueError("the step is not zero")
    n = int((end - start) / step + 1e-9) + 1
    value = F.lit(start) + F.col("id") * F.lit(step)
    return Frame(spark.range(max(n, 0)).select(value.cast("long" if all(isinstance(x, int) for x in (start, end, step)) else "double").alias(name)))


def from_sequence_date_period(spark: SparkSession, name: str, start: str, interval: str, end: str, exclude_start: bool = False) -> Frame:
    """Moments from start by interval (``1 day``) before or at end."""
    if not re.fullmatch(r"-?\d+ (second|minute|hour|day|week|month|year)s?", interval.strip()):
        raise ValueError("an interval is a number and a unit")
    moments = F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr(f"interval {interval}"))
    df = spark.range(1).select(F.explode(moments).alias(name))
    return Frame(df.where(F.col(name) > F.lit(start).cast("timestamp")) if exclude_start else df)


def from_sequence_date_period_recurrences(spark: SparkSession, name: str, start: str, interval: str, recurrences: int, exclude_start: bool = False) -> Frame:
    if not re.fullmatch(r"-?\d+ (second|minute|hour|day|week|month|year)s?", interval.strip()):
        raise ValueError("an interval is a number and a unit")
    count, unit = interval.split()
    first = 1 if exclude_start else 0
    units = {"second": "secs", "minute": "mins", "hour": "hours", "day": "days", "week": "weeks", "month": "months", "year": "years"}
    step = F.make_interval(**{units[unit.rstrip("s")]: (F.col("id") * int(count)).cast("int")})
    return Frame(spark.range(first, recurrences + 1).select((F.lit(start).cast("timestamp") + step).alias(name)))
