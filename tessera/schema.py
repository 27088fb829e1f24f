"""Schemas: definitions with logical types, merging, matching, validation, and casting of texts by profile."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.expr import FALSE, INTEGERS, NUMBERS, TRUE, UUID

_FIELDS = {
    "int": T.LongType(), "str": T.StringType(), "bool": T.BooleanType(), "float": T.DoubleType(), "datetime": T.TimestampType(), "null": T.StringType(),
    "json": T.StringType(), "uuid": T.StringType(), "xml": T.StringType(), "xml_element": T.StringType(), "array": T.VariantType(), "object": T.VariantType(),
}


def _plain(kind: str):
    def make(name: str, nullable: bool = False, metadata: dict | None = None) -> T.StructField:
        meta = dict(metadata or {})
        if kind in ("json", "uuid", "xml", "xml_element", "null", "object"):
            meta["logical"] = kind
        return T.StructField(name, _FIELDS[kind], nullable or kind == "null", meta)

    make.__name__ = f"{kind}_schema"
    return make


int_schema, str_schema, bool_schema, float_schema = map(_plain, ("int", "str", "bool", "float"))
datetime_schema, null_schema, json_schema, uuid_schema = map(_plain, ("datetime", "null", "json", "uuid"))
xml_schema, xml_element_schema, array_schema, object_schema = map(_plain, ("xml", "xml_element", "array", "object"))


def type_of_name(name: str) -> T.DataType:
    names = {"integer": "int", "string": "str", "boolean": "bool", "double": "float", "date": "datetime"}
    return _FIELDS[names.get(name, name)]


def _type(name: str):
    def make() -> T.DataType:
        return _FIELDS[name]

    make.__name__ = f"type_{name}"
    return make


type_int, type_string, type_float, type_boolean = map(_type, ("int", "str", "float", "bool"))
type_datetime, type_json, type_uuid, type_xml = map(_type, ("datetime", "json", "uuid", "xml"))
type_array, type_object, type_null, type_xml_element = map(_type, ("array", "object", "null", "xml_element"))
type_integer = type_int


def type_list(element: T.DataType) -> T.DataType:
    return T.ArrayType(element)


def type_map(key: T.DataType, value: T.DataType) -> T.DataType:
    return T.MapType(key, value)


def struct_element(name: str, kind: T.DataType, nullable: bool = True) -> T.StructField:
    return T.StructField(name, kind, nullable)


def struct_type(*elements: T.StructField) -> T.DataType:
    if not elements:
        raise ValueError("a structure has at least one element")
    return T.StructType(list(elements))


def enum_schema(name: str, values: list[str], nullable: bool = False, metadata: dict | None = None) -> T.StructField:
    return T.StructField(name, T.StringType(), nullable, {**(metadata or {}), "logical": "enum", "values": list(values)})


def list_schema(name: str, element: T.DataType, nullable: bool = False, metadata: dict | None = None) -> T.StructField:
    return T.StructField(name, T.ArrayType(element), nullable, metadata)


def map_schema(name: str, key: T.DataType, value: T.DataType, nullable: bool = False, metadata: dict | None = None) -> T.StructField:
    return T.StructField(name, T.MapType(key, value), nullable, metadata)


def struct_schema(name: str, fields: list[T.StructField], nullable: bool = False, metadata: dict | None = None) -> T.StructField:
    if not fields:
        raise ValueError("a structure has at least one element")
    return T.StructField(name, T.StructType(fields), nullable, metadata)


structure_schema = struct_schema


class Schema:
    """An ordered set of named definitions; every change makes a new one."""

    def __init__(self, *fields: T.StructField) -> None:
        names = [f.name for f in fields]
        if len(set(names)) != len(names):
            raise ValueError("names repeat")
        self.fields = tuple(fields)

    @classmethod
    def of(cls, struct: T.StructType) -> Schema:
        return cls(*struct.fields)

    @property
    def struct(self) -> T.StructType:
        return T.StructType(list(self.fields))

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def find(self, name: str) -> T.StructField | None:
        return next((f for f in self.fields if f.name == name), None)

    def get(self, name: str) -> T.StructField:
        if (f := self.find(name)) is None:
            raise KeyError(f"no definition of {name}")
        return f

    def add(self, *fields: T.StructField) -> Schema:
        return Schema(*self.fields, *fields)

    def keep(self, *names: str) -> Schema:
        return Schema(*[self.get(n) for n in names])

    def remove(self, *names: str) -> Schema:
        for n in names:
            self.get(n)
        return self.graceful_remove(*names)

    def graceful_remove(self, *names: str) -> Schema:
        return Schema(*[f for f in self.fields if f.name not in names])

    def rename(self, name: str, new: str) -> Schema:
        self.get(name)
        return Schema(*[T.StructField(new, f.dataType, f.nullable, f.metadata) if f.name == name else f for f in self.fields])

    def replace(self, name: str, field: T.StructField) -> Schema:
        self.get(name)
        return Schema(*[field if f.name == name else f for f in self.fields])

    def nullable(self) -> Schema:
        return Schema(*[T.StructField(f.name, f.dataType, True, f.metadata) for f in self.fields])

    make_nullable = nullable

    def merge(self, other: Schema) -> Schema:
        """Columns of both; one that a side lacks is nullable."""
        out = []
        for f in self.fields:
            g = other.find(f.name)
            out.append(merge_fields(f, g) if g else T.StructField(f.name, f.dataType, True, f.metadata))
        out += [T.StructField(g.name, g.dataType, True, g.metadata) for g in other.fields if not self.find(g.name)]
        return Schema(*out)

    def matches(self, other: Schema, evolving: bool = False) -> bool:
        return (evolving_match if evolving else strict_match)(self, other)

    def to_json(self) -> str:
        return self.struct.json()

    normalize = to_json

    @classmethod
    def from_json(cls, text: str) -> Schema:
        return cls.of(T.StructType.fromJson(json.loads(text)))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Schema) and self.fields == other.fields

    def __hash__(self) -> int:
        return hash(self.to_json())

    def ascii(self) -> str:
        """The schema as an indented tree."""
        lines = ["schema"]

        def walk(field: T.StructField, depth: int) -> None:
            kind = field.metadata.get("logical") or field.dataType.simpleString().partition("<")[0]
            lines.append(f"{'|    ' * depth}|-- {field.name}: {'?' if field.nullable else ''}{kind}")
            inner = field.dataType
            while isinstance(inner, T.ArrayType):
                inner = inner.elementType
            if isinstance(inner, T.StructType):
                for f in inner.fields:
                    walk(f, depth + 1)

        for f in self.fields:
            walk(f, 0)
        return "\n".join(lines) + "\n"


schema = Schema


def schema_to_json(s: Schema) -> str:
    return s.to_json()


def schema_from_json(text: str) -> Schema:
    return Schema.from_json(text)


def merge_types(a: T.DataType, b: T.DataType) -> T.DataType:
    """Equal types stay; integers and floats give floats, text takes any scalar in, unlike collections give variants."""
    if a == b:
        return a
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    if isinstance(a, NUMBERS) and isinstance(b, NUMBERS):
        return T.LongType() if isinstance(a, INTEGERS) and isinstance(b, INTEGERS) else T.DoubleType()
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType) and all(isinstance(x.elementType, NUMBERS) for x in (a, b)):
        return T.ArrayType(merge_types(a.elementType, b.elementType))
    if isinstance(a, T.StringType) or isinstance(b, T.StringType):
        return T.StringType()
    if isinstance(a, nested) or isinstance(b, nested):
        return T.VariantType()
    raise TypeError(f"{a.simpleString()} and {b.simpleString()} have no common type")


def merge_fields(a: T.StructField, b: T.StructField) -> T.StructField:
    return T.StructField(a.name, merge_types(a.dataType, b.dataType), a.nullable or b.nullable, {**a.metadata, **b.metadata})


def strict_match(left: Schema, right: Schema) -> bool:
    """The same names, types and nullability, in any order."""
    key = lambda s: {f.name: (f.dataType, f.nullable) for f in s.fields}
    return key(left) == key(right)


def evolving_match(left: Schema, right: Schema) -> bool:
    """The right side may add columns and allow nulls, but not drop, retype or tighten a column."""
    return all((g := right.find(f.name)) is not None and g.dataType == f.dataType and (g.nullable or not f.nullable) for f in left.fields)


class SchemaError(ValueError):
    pass


def validated(df: DataFrame, wanted: Schema, strict: bool = True) -> DataFrame:
    """The frame, which fails when it runs if a column that must not be null is; wrong types and, if ``strict``, other columns fail at once."""
    have = Schema.of(df.schema)
    faults = [f"{f.name} is missing" for f in wanted.fields if not have.find(f.name)]
    faults += [f"{f.name} is {have.get(f.name).dataType.simpleString()}, not {f.dataType.simpleString()}" for f in wanted.fields if have.find(f.name) and have.get(f.name).dataType != f.dataType]
    if strict:
        faults += [f"{n} is not expected" for n in have.names if not wanted.find(n)]
    if faults:
        raise SchemaError("; ".join(faults))
    needed = [f.name for f in wanted.fields if not f.nullable]
    allowed = {f.name: f.metadata["values"] for f in wanted.fields if f.metadata.get("logical") == "enum"}
    for n in needed:
        ok = F.col(f"`{n}`").isNotNull()
        if n in allowed:
            ok &= F.col(f"`{n}`").isin(allowed[n])
        df = df.withColumn(n, F.when(ok, F.col(f"`{n}`")).otherwise(F.raise_error(F.lit(f"{n} does not fit its definition")).cast(df.schema[n].dataType)))
    return df


#: Types that a text column may turn out to have, tried in this order, and the test of a value.
_NULLS = ("null", "nil")


def _profile(x: Column) -> dict[str, Column]:
    low = F.lower(x)
    return {
        "null": low.isin(*_NULLS) | (x == ""),
        "integer": F.regexp_like(x, F.lit(r"^(0|-?[1-9]\d{0,17})$")),
        "float": F.regexp_like(x, F.lit(r"^-?(0|[1-9]\d*)\.\d+$")),
        "boolean": low.isin("true", "false", "yes", "no", "on", "off"),
        "json": F.regexp_like(x, F.lit(r"(?s)^\s*[\[{].*[\]}]\s*$")) & F.try_parse_json(x).isNotNull(),
        "uuid": F.regexp_like(x, F.lit(UUID)),
        "datetime": F.regexp_like(x, F.lit(r"^\d{4}-\d\d-\d\d([ T]\d\d:\d\d(:\d\d(\.\d+)?)?)?(Z|[+-]\d\d:?\d\d)?$")) & x.try_cast("timestamp").isNotNull(),
    }


def auto_cast(df: DataFrame) -> DataFrame:
    """Text columns as the type that all their values have. One pass counts the values of each type in every column."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    tests = {n: _profile(F.col(f"`{n}`")) for n in texts}
    wanted = [F.struct(F.count(F.col(f"`{n}`")).alias("all"), *[F.count_if(t).alias(k) for k, t in tests[n].items()]).alias(n) for n in texts]
    counts = df.agg(*wanted).first()
    for n in texts:
        c, x = counts[n], F.col(f"`{n}`")
        left = c["all"] - c["null"]
        if left == 0:
            continue
        value = F.when(~tests[n]["null"], x)
        if c["integer"] == left:
            df = df.withColumn(n, value.try_cast("long"))
        elif c["integer"] + c["float"] == left:
            df = df.withColumn(n, value.try_cast("double"))
        elif c["boolean"] == left:
            df = df.withColumn(n, F.when(F.lower(x).isin(*TRUE), F.lit(True)).when(F.lower(x).isin(*FALSE), F.lit(False)))
        elif c["json"] == left or c["uuid"] == left:
            df = df.withMetadata(n, {"logical": "json" if c["json"] == left else "uuid"})
        elif c["datetime"] == left:
            df = df.withColumn(n, value.try_cast("timestamp"))
    return df
