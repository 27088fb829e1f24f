"""Large JSON documents whose rows are the elements of one array: read in parallel, however large a file is.

A structural index is made in a first pass over chunks of bytes. A chunk cannot know whether it begins within a text, so it reports its change of depth for both cases; a running sum over a
file's chunks decides. Then each chunk finds the first separator of the array's elements in it, and the ranges between these are cut into elements, which Spark's own reader parses."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.frame import Frame
from ..variants import spark_type

#: Bytes of a chunk, and bytes before it that are read along: backslashes before a quote and keys may reach back so far.
CHUNK, BEFORE = 8 << 20, 1 << 16

#: What encloses the array, brackets and keys, may be so many pieces.
OUTER = 1_000_000

_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*\Z', re.DOTALL)


def _reader(uri: str):
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    return files.open_input_file(path)


def read_range(uri: str, low: int, high: int) -> bytes:
    with _reader(uri) as f:
        f.seek(low)
        return f.read(high - low)


def quotes(data: np.ndarray) -> np.ndarray:
    """Where texts begin and end: quotes with an even number of backslashes before them."""
    at = np.flatnonzero(data == 34)
    odd, open_ = np.zeros(len(at), bool), np.arange(len(at))
    back = 1
    while len(open_):
        place = at[open_] - back
        open_ = open_[(place >= 0) & (data[np.maximum(place, 0)] == 92)]
        odd[open_] ^= True
        back += 1
    return at[~odd]


def structure(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of brackets and commas outside texts, and the depth after each, counted from the beginning of the data."""
    marks = np.zeros(len(data), np.int8)
    marks[quotes(data)] = 1
    free = (np.cumsum(marks, dtype=np.int32) + inside) % 2 == 0
    kinds = np.zeros(256, np.int8)
    kinds[[91, 123]], kinds[[93, 125]], kinds[44] = 1, -1, 2
    kind = np.where(free, kinds[data], 0)
    at = np.flatnonzero(kind)
    return at, np.cumsum(np.where(kind[at] == 2, 0, kind[at]), dtype=np.int64)


def _sums(rows: Iterator[tuple[str, int, int]]) -> Iterator[tuple]:
    """(uri, low, high, parity of quotes, change of depth from outside a text, from within one)."""
    for uri, low, high in rows:
        first = max(0, low - BEFORE)
        data = np.frombuffer(read_range(uri, first, high), np.uint8)
        own = data[low - first :]
        marks = np.zeros(len(own), np.int8)
        found = quotes(data) - (low - first)
        found = found[found >= 0]
        parity = len(found) % 2
        marks[found] = 1
        within = np.cumsum(marks, dtype=np.int32) % 2
        steps = np.isin(own, (91, 123)).astype(np.int8) - np.isin(own, (93, 125)).astype(np.int8)
        change = [int(steps[within == x].sum()) for x in (0, 1)]
        yield uri, low, high, parity, change[0], change[1]


def _marks(rows, depth: int) -> Iterator[tuple]:
    """(uri, place, kind, depth after, key): brackets that enclose or bound the array's elements, and the first comma between elements."""
    for uri, low, high, inside, at_depth in rows:
        first = max(0, low - BEFORE)
        raw = read_range(uri, first, high)
        data = np.frombuffer(raw, np.uint8)
        found, own = quotes(data), data.copy()
        own[: low - first] = 32
        own[(own == 34) | (own == 92)] = 32
        own[found[found >= low - first]] = 34  # only quotes that begin or end a text are left
        places, depths = structure(own, bool(inside))
        depths = depths + at_depth
        kinds = data[places]
        comma = places[(kinds == 44) & (depths == depth)]
        if len(comma):
            yield uri, first + int(comma[0]), ",", depth, None
        opened, closed = np.isin(kinds, (91, 123)), np.isin(kinds, (93, 125))
        for i in np.flatnonzero((opened & (depths <= depth)) | (closed & (depths < depth))):
            place, key = int(places[i]), None
            if opened[i]:
                match = _KEY.search(raw, max(0, place - 512), place) or _KEY.search(raw, 0, place)
                key = match[1].decode("utf-8", "replace") if match else None
            yield uri, first + place, chr(kinds[i]), int(depths[i]), key


def span_of(marks: list[tuple], keys: list[str]) -> tuple[int, int] | None:
    """The bytes within the array that the keys lead to; marks are (place, kind, depth after, key) in order."""
    path: list[str | None] = []
    begun = None
    for place, kind, depth, key in marks:
        if kind in "[{":
            path.append(key)
            if kind == "[" and begun is None and path[1:] == keys:
                begun, at = place + 1, len(path)
        elif kind in "]}":
            if begun is not None and len(path) == at:
                return begun, place
            path.pop()
    return None


def _ranges(rows, keys: list[str]) -> Iterator[tuple[str, int, int]]:
    """A file's ranges: what lies between the array's ends and one comma of each chunk."""
    for uri, marks in rows:
        mine = [(m["place"], m["kind"], m["depth"], m["key"]) for m in marks]
        outer = [m for m in mine if m[1] != ","]
        if len(outer) > OUTER:
            raise ValueError("what encloses the array is too large; name the array by its whole path")
        if (span := span_of(outer, keys)) is not None:
            cuts = [p for p, kind, *_ in mine if kind == "," and span[0] <= p < span[1]]
            yield from ((uri, a, b) for a, b in zip([span[0], *[c + 1 for c in cuts]], [*cuts, span[1]]))


def _elements(rows) -> Iterator[str]:
    for uri, low, high in rows:
        raw = read_range(uri, low, high)
        data = np.frombuffer(raw, np.uint8)
        places, depths = structure(data, False)
        ends = [*places[(data[places] == 44) & (depths == 0)].tolist(), len(raw)]
        begin = 0
        for end in ends:
            if piece := raw[begin:end].strip():
                yield piece.decode("utf-8", "replace")
            begin = end + 1


def _mapped(df: DataFrame, function, schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                made = list(function(iter([row])))
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def array_elements(spark: SparkSession, path: str, pointer: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(element): the JSON texts of the elements of the array at ``pointer`` (``/a/b``: keys from the root; none: the root itself) of each file that ``path`` names."""
    from .files import files

    keys = [s for s in (pointer or "").split("/") if s]
    depth = len(keys) + 1
    listed = [(r.path, r.protocol, r.size) for r in files(spark, path).df.where("is_file AND size > 0").collect() if not r.path.rsplit("/", 1)[-1].startswith(("_", "."))]
    schema = "uri string, low long, high long"
    pieces = [(f"{protocol}://{p}", low, min(low + chunk, size)) for p, protocol, size in listed for low in range(0, size, chunk)]
    if not pieces:
        return spark.createDataFrame([], "element string")
    tasks = 8 * spark.sparkContext.defaultParallelism
    spread = lambda rows, kind: spark.createDataFrame(rows, kind).repartition(min(tasks, len(rows)))  # noqa: E731 - chunks are dealt over the tasks
    sums = _mapped(spread(pieces, schema), _sums, schema + ", parity long, outside long, within long")
    states, inside, depth_at, of = [], 0, 0, None
    for uri, low, high, parity, outside, within in sorted(map(tuple, sums.collect())):  # six numbers a chunk
        if uri != of:
            inside, depth_at, of = 0, 0, uri
        states.append((uri, low, high, inside, depth_at))
        depth_at += within if inside else outside
        inside = (inside + parity) % 2
    marks = _mapped(spread(states, schema + ", inside long, depth long"), lambda rows: _marks(rows, depth), "uri string, place long, kind string, depth long, key string")
    grouped = marks.groupBy("uri").agg(F.sort_array(F.collect_list(F.struct("place", "kind", "depth", "key"))).alias("marks"))
    ranges = [tuple(r) for r in _mapped(grouped, lambda rows: _ranges(rows, keys), schema).collect()]  # the index is made once, whoever reads the elements
    if not ranges:
        return spark.createDataFrame([], "element string")
    return _mapped(spread(ranges, schema), lambda rows: ((e,) for e in _elements(rows)), "element string")


def from_json_array(spark: SparkSession, path: str, pointer: str | None = None, schema: T.StructType | None = None, chunk: int = CHUNK) -> Frame:
    """The rows of the array at ``pointer`` in each file, in parallel within a file. Objects become columns, of the types that all of them agree on (variants where they do not) unless a schema is given; other elements one column, by the
    last key's name or ``value``. Files without such an array, and empty ones, give no rows; the order of rows is not kept.

    Files are read by byte ranges with ``pyarrow.fs``, which reaches ``file``, ``s3``, ``gs`` and ``hdfs`` URIs. What encloses the array and a few numbers for each chunk go to the driver; its elements do not."""
    elements = array_elements(spark, path, pointer, chunk)
    keys = [k for k in (pointer or "").split("/") if k]
    if schema:
        kind = schema.simpleString()
    else:  # one pass tells the types and whether there are elements
        n, found = elements.agg(F.count(F.lit(1)), F.schema_of_variant_agg(F.parse_json("element"))).first()
        if not n:
            return Frame(spark.createDataFrame([], T.StructType()))
        kind = spark_type(found)
    value = F.from_json("element", kind) if kind.upper().startswith(("STRUCT<", "ARRAY<")) else F.from_json(F.concat(F.lit('{"v":'), "element", F.lit("}")), f"v {kind}")["v"]
    parsed = elements.select(value.alias(keys[-1] if keys else "value"))
    return Frame(parsed.select(f"`{parsed.columns[0]}`.*") if kind.upper().startswith("STRUCT<") else parsed)

