"""Rows of unlike schemas: values that have no common type are variants, which keep what each row had and can be typed again.

A table has one schema; what differs from row to row stands in variant columns. One aggregate finds the type that all rows of such a column agree on."""

from __future__ import annotations

import datetime as dt
import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def spark_type(found: str) -> str:
    """A variant's schema text as a type. Numbers with decimals are doubles, parts that were always null texts."""
    parts = re.split("(`(?:[^`]|``)*`)", found)
    for i in range(0, len(parts), 2):  # outside quoted names
        parts[i] = re.sub(r"\bDECIMAL\(\d+,\d+\)", "DOUBLE", parts[i]).replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")
    return "".join(parts)


def merged_schema(df: DataFrame, column: Column | str) -> str:
    """The type that all variants of a column agree on, by one aggregate; parts on which they do not agree are variants."""
    return spark_type(df.agg(F.schema_of_variant_agg(column)).first()[0])


def _text_keys(c: Column, kind: T.DataType) -> Column:
    """Maps with texts as keys, however deep."""
    if isinstance(kind, T.MapType):
        values = F.transform_values(c, lambda _, v: _text_keys(v, kind.valueType))
        return F.transform_keys(values, lambda k, _: k.cast("string"))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _text_keys(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_text_keys(c[f.name], f.dataType).alias(f.name) for f in kind]))
    return c


def _has_keys(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return not isinstance(kind.keyType, T.StringType) or _has_keys(kind.valueType)
    if isinstance(kind, T.ArrayType):
        return _has_keys(kind.elementType)
    return isinstance(kind, T.StructType) and any(_has_keys(f.dataType) for f in kind)


def to_variant(c: Column, kind: T.DataType) -> Column:
    """Any value as a variant; null stays null."""
    if isinstance(kind, T.VariantType):
        return c
    if isinstance(kind, T.NullType):
        return F.lit(None).cast("variant")
    if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        return F.to_variant_object(_text_keys(c, kind) if _has_keys(kind) else c)
    return c.cast("variant")


def typed(df: DataFrame, column: str, schema: T.DataType | str | None = None) -> DataFrame:
    """A variant column as typed values, in its place: of the type that all rows agree on, or a given one, which values that do not fit leave null."""
    kind = schema.simpleString() if isinstance(schema, T.DataType) else schema or merged_schema(df, F.col(f"`{column}`"))
    return df.withColumn(column, F.try_variant_get(F.col(f"`{column}`"), "$", kind))


def row_schemas(df: DataFrame, column: str, name: str = "schema") -> DataFrame:
    """Adds each row's own schema of a variant column, as text."""
    return df.withColumn(name, F.schema_of_variant(F.col(f"`{column}`")))


def holds_variant(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(holds_variant(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return holds_variant(kind.elementType)
    if isinstance(kind, T.MapType):
        return holds_variant(kind.valueType)
    return isinstance(kind, T.VariantType)


def stand_in(kind: T.DataType) -> T.DataType:
    """The type with texts in the place of variants."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, stand_in(f.dataType), f.nullable, f.metadata) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(stand_in(kind.elementType), kind.containsNull)
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, stand_in(kind.valueType), kind.valueContainsNull)
    return T.StringType() if isinstance(kind, T.VariantType) else kind


def as_json(value: Any) -> str | None:
    """A Python value as the text that stands in for its variant."""

    def plain(v):
        if isinstance(v, (dt.datetime, dt.date)):
            return v.isoformat()
        return v.hex() if isinstance(v, bytes) else str(v)

    return None if value is None else json.dumps(value, default=plain)


def revived(c: Column, kind: T.DataType) -> Column:
    """Texts that stand in for variants as variants."""
    if not holds_variant(kind):
        return c
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[revived(c[f.name], f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: revived(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: revived(v, kind.valueType))
    return F.parse_json(c)
