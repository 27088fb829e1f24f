"""Dot paths into nested columns, compiled to Column expressions.

A step is a struct field or map key, a list position, ``*`` (each element), ``?name`` (null where absent), ``?*`` (each element, absent ones
dropped) or, at the end, ``{a, b}`` (several names). A backslash keeps the next dot or star literal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def steps(path: str) -> list[str]:
    if not path:
        raise ValueError("a path has at least one step")
    out, step, i, depth = [], "", 0, 0
    while i < len(path):
        c = path[i]
        if c == "\\" and path[i + 1 : i + 2] == ".":
            step += "."
            i += 1
        elif c == "." and not depth:
            out.append(step)
            step = ""
        else:
            depth += (c == "{") - (c == "}")
            step += c
            if c == "}" and i != len(path) - 1:
                raise ValueError("{...} ends a path")
        i += 1
    if depth:
        raise ValueError("{ is not closed")
    return [*out, step]


class Missing(LookupError):
    """The path leads nowhere in the column's type."""


def follow(col: Column, kind: T.DataType, path: str | list[str]) -> tuple[Column, T.DataType]:
    """The column at ``path`` and its type."""
    todo = steps(path) if isinstance(path, str) else path
    if not todo:
        return col, kind
    step, rest = todo[0], todo[1:]
    loose = step.startswith("?")
    name = step[1:] if loose else step
    if name == "*":
        if isinstance(kind, T.MapType):
            col, kind = F.map_values(col), T.ArrayType(kind.valueType)
        elif isinstance(kind, T.StructType):
            col = F.array(*[col.getField(f.name) for f in kind])
            kind = T.ArrayType(kind[0].dataType)
        if not isinstance(kind, T.ArrayType):
            raise Missing(step)
        found = {}

        def each(e):
            found["col"], found["type"] = follow(e, kind.elementType, rest)
            return found["col"]

        out = F.transform(col, each)
        return (F.filter(out, lambda e: e.isNotNull()) if loose else out), T.ArrayType(found["type"])
    if name.startswith("{"):
        fields, made = [], []
        for part in (p.strip() for p in name[1:-1].split(",")):
            c, k = follow(col, kind, [part])
            fields.append(c.alias(part.lstrip("?")))
            made.append(T.StructField(part.lstrip("?"), k))
        return F.struct(*fields), T.StructType(made)
    name = name.replace("\\*", "*")
    if isinstance(kind, T.StructType):
        field = next((f for f in kind if f.name == name), None)
        if field is None:
            if loose:
                return F.lit(None).cast("string"), T.StringType()
            raise Missing(step)
        return follow(col.getField(name), field.dataType, rest)
    if isinstance(kind, T.MapType):
        return follow(F.try_element_at(col, F.lit(name).cast(kind.keyType)), kind.valueType, rest)
    if isinstance(kind, T.ArrayType) and name.lstrip("-").isdigit():
        return follow(F.get(col, F.lit(int(name))), kind.elementType, rest)
    if isinstance(kind, T.VariantType):
        where = "$" + "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in [name, *rest])
        return F.try_variant_get(col, where, "string"), T.StringType()
    if isinstance(kind, T.StringType):  # JSON text
        where = "$" + "".join(f"[{s}]" if s.isdigit() else f".{s.lstrip('?')}" for s in [name, *rest])
        return F.get_json_object(col, where), T.StringType()
    if loose:
        return F.lit(None).cast("string"), T.StringType()
    raise Missing(step)


def exists(col: Column, kind: T.DataType, path: str) -> Column:
    """Whether the path leads to a value (a null under an existing struct field counts as there, as types know it)."""
    todo = steps(path)
    try:
        parent, parent_kind = follow(col, kind, todo[:-1])
        found, _ = follow(col, kind, todo)
    except Missing:
        return F.lit(False)
    last = todo[-1]
    if isinstance(parent_kind, T.MapType):
        return F.coalesce(F.map_contains_key(parent, F.lit(last).cast(parent_kind.keyType)), F.lit(False))
    if isinstance(parent_kind, T.ArrayType) and last.isdigit():
        return F.coalesce(F.size(parent) > int(last), F.lit(False))
    if isinstance(parent_kind, T.StructType):
        return parent.isNotNull()
    return found.isNotNull()


def rename(col: Column, kind: T.DataType, path: str | list[str], new: str) -> Column:
    """The column with the key at ``path`` renamed."""
    todo = steps(path) if isinstance(path, str) else path
    step, rest = todo[0], todo[1:]
    if isinstance(kind, T.ArrayType) and step == "*":
        return F.transform(col, lambda e: rename(e, kind.elementType, rest, new))
    if isinstance(kind, T.MapType):
        if rest:
            return F.transform_values(col, lambda k, v: F.when(k == step, rename(v, kind.valueType, rest, new)).otherwise(v))
        return F.transform_keys(col, lambda k, v: F.when(k == step, F.lit(new)).otherwise(k))
    if not isinstance(kind, T.StructType) or step not in kind.names:
        raise Missing(step)
    fields = []
    for f in kind:
        c = col.getField(f.name)
        if f.name == step:
            fields.append(rename(c, f.dataType, rest, new).alias(f.name) if rest else c.alias(new))
        else:
            fields.append(c.alias(f.name))
    return F.when(col.isNotNull(), F.struct(*fields))


def restyled(kind: T.DataType, change) -> T.DataType:
    """The type with every struct key changed."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(change(f.name), restyled(f.dataType, change), f.nullable) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(restyled(kind.elementType, change), kind.containsNull)
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, restyled(kind.valueType, change), kind.valueContainsNull)
    return kind
