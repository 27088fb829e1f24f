"""XML texts as nested values and back.

An element is a struct of ``@attributes``, ``@value`` (its own text) and a field for each name of its children: a struct, or a list of structs where any node of the table repeats the name.
One schema holds for a whole column: it is merged over all nodes by an aggregate, part by part."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATTRIBUTES, VALUE = "@attributes", "@value"

#: Elements may be nested so deeply; a schema has no end otherwise.
DEPTH = 64

#: Different outlines that a task remembers.
OUTLINES = 20_000


def parsed(text: str) -> dict | None:
    """{root: element} with every child in a list of its name; None for a text that is not well formed.

    Of several pieces of an element's own text the last that is not blank is its value, as it stands. Names keep their prefixes; declarations of namespaces, comments and
    processing instructions are left out; CDATA is text."""
    parser, out = expat.ParserCreate(), {}
    parser.buffer_text = True
    stack: list[dict] = []

    def begin(name, attributes):
        if len(stack) >= DEPTH:
            raise ValueError(f"elements are nested deeper than {DEPTH}")
        element: dict = {}
        own = {k: v for k, v in attributes.items() if k != "xmlns" and not k.startswith("xmlns:")}
        if own:
            element[ATTRIBUTES] = own
        (stack[-1] if stack else out).setdefault(name, []).append(element)
        stack.append(element)

    def data(piece):
        if stack and piece.strip():
            stack[-1][VALUE] = piece

    parser.StartElementHandler, parser.CharacterDataHandler = begin, data
    parser.EndElementHandler = lambda _: stack.pop()
    try:
        parser.Parse(text, True)
    except expat.ExpatError:
        return None
    return out


def shape_of(element: dict) -> dict:
    """What an element has: attributes, whether it has a value, and its children's shapes with whether a name is repeated."""
    children = {k: [all_merged([shape_of(e) for e in v]), len(v) > 1] for k, v in element.items() if k not in (ATTRIBUTES, VALUE)}
    return {"a": sorted(element.get(ATTRIBUTES, ())), "v": VALUE in element, "c": children}


def all_merged(shapes: list[dict]) -> dict:
    out = {"a": [], "v": False, "c": {}}
    for s in shapes:
        out = merged(out, s)
    return out


def merged(a: dict, b: dict) -> dict:
    children = dict(a["c"])
    for name, (shape, many) in b["c"].items():
        children[name] = [merged(children[name][0], shape), children[name][1] or many] if name in children else [shape, many]
    return {"a": sorted({*a["a"], *b["a"]}), "v": a["v"] or b["v"], "c": children}


def struct_of(shape: dict, root: bool = False) -> T.StructType:
    """Fields in the order of their names, attributes and value first; an element that never holds anything has an empty value."""
    fields = []
    if shape["a"]:
        fields.append(T.StructField(ATTRIBUTES, T.StructType([T.StructField(a, T.StringType()) for a in shape["a"]])))
    if shape["v"] or not (root or shape["a"] or shape["c"]):
        fields.append(T.StructField(VALUE, T.StringType()))
    for name in sorted(shape["c"]):
        kind = struct_of(shape["c"][name][0])
        fields.append(T.StructField(name, T.ArrayType(kind, False) if shape["c"][name][1] else kind))
    return T.StructType(fields)


def outline(text: str) -> tuple | None:
    """The names of a text's elements and attributes as they stand, and where values are: texts of one outline have one shape. None for a text that is not well formed."""
    parser, out = expat.ParserCreate(), []
    parser.buffer_text = True

    def begin(name, attributes):
        out.append("<")
        out.append(name)
        if attributes:
            out.extend(attributes)

    def data(piece):
        if piece.strip():
            out.append("=")

    parser.StartElementHandler, parser.CharacterDataHandler = begin, data
    parser.EndElementHandler = lambda _: out.append(">")
    try:
        parser.Parse(text, True)
    except expat.ExpatError:
        return None
    return tuple(out)


def xml_schema(df: DataFrame, column: str) -> T.StructType:
    """The merged schema of a column's texts. Each task merges the shapes of the outlines that it meets, groups of tasks merge their shapes, and the driver the groups'."""

    def shapes(batches) -> Iterator[pa.RecordBatch]:
        total, met = None, set()
        for b in batches:
            for t in b.column(0).to_pylist():
                found = outline(t) if t is not None else None
                if found is None or found in met:
                    continue
                if len(met) >= OUTLINES:
                    met.clear()
                met.add(found)
                shape = shape_of(parsed(t))
                total = shape if total is None else merged(total, shape)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(total)])], names=["shape"])

    def together(batches) -> Iterator[pa.RecordBatch]:
        found = [json.loads(s) for b in batches for s in b.column(0).to_pylist()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(all_merged(found))])], names=["shape"])

    groups = max(1, math.isqrt(df.sparkSession.sparkContext.defaultParallelism))
    parts = df.select(F.col(f"`{column}`").cast("string")).mapInArrow(shapes, "shape string").repartition(groups)
    found = [json.loads(r.shape) for r in parts.mapInArrow(together, "shape string").collect()]
    return struct_of(all_merged(found), root=True)


def _places(kind: T.StructType) -> dict:
    """{name: (its own places, whether it is a list)} of the children that a schema has."""
    out = {}
    for f in kind:
        if f.name not in (ATTRIBUTES, VALUE):
            many = isinstance(f.dataType, T.ArrayType)
            out[f.name] = (_places(f.dataType.elementType if many else f.dataType), many)
    return out


def fitted(kind: T.StructType) -> Callable[[str], dict | None]:
    """A reader of texts as ``parsed`` reads them, whose elements stand as the schema has them: what it lacks is left out, and of a repeated element that it has once the last stands."""
    places = _places(kind)

    def read(text: str) -> dict | None:
        parser, out = expat.ParserCreate(), {}
        parser.buffer_text = True
        stack = [(out, places)]

        def begin(name, attributes):
            if len(stack) > DEPTH:
                raise ValueError(f"elements are nested deeper than {DEPTH}")
            above, at = stack[-1]
            if (place := at.get(name)) is None:
                stack.append(({}, {}))
                return
            element = {}
            if attributes and (own := {k: v for k, v in attributes.items() if k != "xmlns" and not k.startswith("xmlns:")}):
                element[ATTRIBUTES] = own
            if not place[1]:
                above[name] = element
            elif name in above:
                above[name].append(element)
            else:
                above[name] = [element]
            stack.append((element, place[0]))

        def data(piece):
            if len(stack) > 1 and piece.strip():
                stack[-1][0][VALUE] = piece

        parser.StartElementHandler, parser.CharacterDataHandler = begin, data
        parser.EndElementHandler = lambda _: stack.pop()
        try:
            parser.Parse(text, True)
        except expat.ExpatError:
            return None
        return out

    return read


def cast_xml(df: DataFrame, column: str, schema: T.StructType | None = None) -> DataFrame:
    """The column's texts as nested values, in their place. Without a schema one pass over all rows merges it. Null and malformed texts give null;
    what a given schema lacks is left out, and of a repeated element that it has once the last stands."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = schema or xml_schema(df, column)
    if not kind.fields:
        raise ValueError("no text has an element")
    fields = [T.StructField(f.name, kind) if f.name == column else f for f in df.schema]
    arrow, at = to_arrow_schema(T.StructType([T.StructField(column, kind)])).field(0), df.columns.index(column)
    _places(kind)  # a schema that does not fit elements is refused here

    def run(batches) -> Iterator[pa.RecordBatch]:
        read = fitted(kind)
        for b in batches:  # other columns go through as they are
            values = [None if t is None else read(t) for t in b.column(at).to_pylist()]
            yield b.set_column(at, arrow, pa.array(values, arrow.type))

    return df.mapInArrow(run, T.StructType(fields))


def _escaped(c: Column, quotes: bool = False) -> Column:
    c = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    if not quotes:
        return F.replace(c, F.lit("\r"), F.lit("&#13;"))
    for mark, code in (('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):  # blanks of attributes would all become spaces
        c = F.replace(c, F.lit(mark), F.lit(code))
    return c


def _element(name: str, c: Column, kind: T.DataType) -> Column:
    """Tags around what is within, in built-in functions; an empty text for null."""
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.concat_ws("", F.transform(c, lambda x: _element(name, x, kind.elementType))), F.lit(""))
    tag, within = [F.lit(f"<{name}")], []
    if isinstance(kind, T.StructType):
        for f in kind:
            child = c[f.name]
            if f.name == ATTRIBUTES:
                tag += [F.coalesce(F.concat(F.lit(f' {a.name}="'), _escaped(child[a.name].cast("string"), True), F.lit('"')), F.lit("")) for a in f.dataType]
            elif f.name == VALUE:
                within.append(F.coalesce(_escaped(child.cast("string")), F.lit("")))
            else:
                within.append(_element(f.name, child, f.dataType))
    else:
        within.append(_escaped(c.cast("string")))
    return F.when(c.isNotNull(), F.concat(*tag, F.lit(">"), *within, F.lit(f"</{name}>"))).otherwise("")


def xml_text(c: Column, kind: T.StructType) -> Column:
    """The element that a struct of one field, its root, stands for; of a column with several roots the one that is not null. Null gives null."""
    return F.when(c.isNotNull(), F.concat(*[_element(f.name, c[f.name], f.dataType) for f in kind]))
