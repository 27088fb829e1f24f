"""File sources. Globs and Hive partitions are Spark's own; values of partitions stay texts."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.frame import Frame
from ..schema import Schema


def _struct(schema: Schema | T.StructType | None) -> T.StructType | None:
    return schema.struct if isinstance(schema, Schema) else schema


def _finish(df: DataFrame, uri: bool) -> Frame:
    return Frame(df.withColumn("_input_file_uri", F.col("_metadata.file_path")) if uri else df)


def from_parquet(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, offset: int | None = None, schema=None, input_file_uri: bool = False) -> Frame:
    reader = spark.read.schema(_struct(schema)) if schema else spark.read
    df = reader.parquet(*([path] if isinstance(path, str) else path))
    out = _finish(df, input_file_uri)
    if columns:
        out = out.select(*columns, *(["_input_file_uri"] if input_file_uri else []))
    return out.offset(offset) if offset else out


def detect_csv(sample: list[str]) -> tuple[str, str]:
    """Separator and quote of a few lines: the pair that cuts all of them into the same number, the most, of fields. Any character of the
    sample that is neither letter, digit nor quote may separate; of equals the one that a comma, tab, semicolon or bar is comes first."""
    best, chosen = (-1.0, 0), (",", '"')
    found = {c for line in sample for c in line if not c.isalnum() and c not in "\"'\\\r\n"}
    usual = [c for c in ",\t;|" if c in found]
    for quote in ('"', "'"):
        for sep in [*usual, *sorted(found.difference(usual))]:
            q = re.escape(quote)
            counts = [re.sub(f"{q}(?:[^{q}]|{q}{q})*{q}", "", line).count(sep) for line in sample]
            if not counts or not max(counts):
                continue
            even = sum(c == counts[0] for c in counts) / len(counts)
            quoted = sum(line.count(quote) for line in sample)
            score = (even + (0.5 if quoted and quoted % 2 == 0 else 0) + (0.5 if sep in ",\t;|" else 0), min(counts))
            if score > best:
                best, chosen = score, (sep, quote)
    return chosen


def csv_detect_separator(spark: SparkSession, path: str, lines: int = 5) -> tuple[str, str]:
    return detect_csv([r.value for r in spark.read.text(path).limit(lines).collect()])


def csv_detect_escape(spark: SparkSession, path: str, separator: str, enclosure: str) -> str:
    """What stands before an enclosure within a value: a backslash, or another enclosure. All lines are looked at, in one aggregate; files with both are an error, as either reading would lose text."""
    q, sep = re.escape(enclosure), re.escape(separator)
    plain = F.replace("value", F.lit("\\" + enclosure), F.lit(""))
    doubled = plain.rlike(f"[^{sep}]{q}{q}|{q}{q}[^{sep}]")
    slashed, twice = spark.read.text(path).agg(F.bool_or(F.contains("value", F.lit("\\" + enclosure))), F.bool_or(doubled)).first()
    if slashed and twice:
        raise ValueError("enclosures are escaped by backslashes and by doubling; name the escape")
    return enclosure if twice else "\\"


def _numbered(names: list[str]) -> list[str]:
    """Names that come again get their number: a, a_2, a_3."""
    out: list[str] = []
    for n in names:
        k, new = 1, n
        while new in out:
            k += 1
            new = f"{n}_{k}"
        out.append(new)
    return out


def from_csv(spark: SparkSession, path: str, with_header: bool = True, empty_to_null: bool = True, separator: str | None = None, enclosure: str | None = None, escape: str | None = None, schema=None, characters_read_in_line: int | None = None, multi_line: bool = False, input_file_uri: bool = False) -> Frame:
    """All values are texts unless a schema is given. Short rows are filled with nulls and long ones cut; blank headers become e00, e01 and so on, equal ones are numbered.
    Separator and enclosure are detected from the first lines where they are not given, and the escape (a backslash or the enclosure itself) from all lines. Values that hold line ends, which ``to_csv`` quotes, need ``multi_line``; a
    file is then read by one task."""
    if separator is None or enclosure is None:
        found = csv_detect_separator(spark, path)
        separator, enclosure = separator or found[0], enclosure or found[1]
    escape = csv_detect_escape(spark, path, separator, enclosure) if escape is None else escape
    options = {"sep": separator, "quote": enclosure, "escape": escape, "mode": "PERMISSIVE", "enforceSchema": "true", "nullValue": "" if empty_to_null else "\0", "emptyValue": ""}
    if multi_line:
        options["multiLine"] = "true"
    if characters_read_in_line:
        options["maxCharsPerColumn"] = characters_read_in_line
    head = spark.read.options(**options, header="false", inferSchema="false").csv(path).limit(1).collect()
    if not head:
        return Frame(spark.createDataFrame([], _struct(schema) or T.StructType()))
    first = list(head[0])
    parts = [f for f in spark.read.options(**options, header="false").csv(path).schema.names if not re.fullmatch(r"_c\d+", f)]
    first = first[: len(first) - len(parts)] if parts else first
    names = _numbered([(v if with_header and v not in (None, "") else f"e{i:02d}") for i, v in enumerate(first)])
    kind = T.StructType([T.StructField(n, T.StringType()) for n in names])
    if schema:
        wanted = {f.name: f.dataType for f in _struct(schema)}
        kind = T.StructType([T.StructField(n, wanted.get(n, T.StringType())) for n in names])
    df = spark.read.options(**options, header=str(with_header).lower()).schema(kind).csv(path)
    return _finish(df, input_file_uri)


def from_json(spark: SparkSession, path: str, pointer: str | None = None, schema=None, multi_line: bool = True, input_file_uri: bool = False, unlike: bool = False) -> Frame:
    """A JSON array or object a file, or a record a line (``multi_line=False``). ``pointer`` (``/a/b``) names the part to read; large files are better read by
    ``from_json_array``. ``unlike``: values on whose type the records do not agree are variants, not texts."""
    reader = spark.read.option("multiLine", str(multi_line).lower())
    if unlike:
        from ..variants import typed

        uri = [F.col("_metadata.file_path").alias("_input_file_uri")] if input_file_uri else []
        rows = typed(reader.option("singleVariantColumn", "row").json(path).select("row", *uri), "row")
        if isinstance(rows.schema["row"].dataType, T.ArrayType):
            rows = rows.withColumn("row", F.explode("row"))
        whole = isinstance(rows.schema["row"].dataType, T.StructType)
        return Frame(rows.select("row.*" if whole else "row", *rows.columns[1:]))
    if pointer is None:
        return _finish((reader.schema(_struct(schema)) if schema else reader).json(path), input_file_uri)
    df = reader.json(path)
    steps = [s for s in pointer.split("/") if s]
    for i, step in enumerate(steps):
        c = F.col(step if i == 0 else f"x.{step}")
        kind = df.select(c).schema[0].dataType
        df = df.select((F.explode(c) if isinstance(kind, T.ArrayType) else c).alias("x"))
    kind = df.schema[0].dataType
    df = df.select("x.*") if isinstance(kind, T.StructType) else df.withColumnRenamed("x", steps[-1])
    return Frame(df)


def from_text(spark: SparkSession, path: str, input_file_uri: bool = False) -> Frame:
    """One column, ``text``, without blanks at its end."""
    df = spark.read.text(path).withColumnRenamed("value", "text").withColumn("text", F.rtrim("text"))
    return _finish(df, input_file_uri)


#: A whole tag, whatever its quoted attribute values hold.
_TAG = re.compile(rb"""<(?:[^>"']|"[^"]*"|'[^']*')*>""")


def xml_nodes(content: bytes, path: list[str]) -> list[str]:
    """The elements at a path from the root, each as it stands in the document; found by a streaming parser, so nested elements of the same name are whole."""
    from xml.parsers import expat

    parser, stack, starts, out = expat.ParserCreate(), [], [], []
    encoding = (re.match(rb"""<\?xml[^>]*encoding=["']([\w.-]+)""", content) or [b"", b"utf-8"])[1].decode()

    def begin(name, _):
        stack.append(name)
        if stack == path:
            starts.append(parser.CurrentByteIndex)

    def finish(_):
        if stack == path:
            first = starts.pop()
            last = _TAG.match(content, first).end()
            if content[last - 2 : last] != b"/>":
                last = _TAG.match(content, parser.CurrentByteIndex).end()
            out.append(content[first:last].decode(encoding))
        stack.pop()

    parser.StartElementHandler, parser.EndElementHandler = begin, finish
    parser.Parse(content, True)
    return out


def from_xml(spark: SparkSession, path: str, node_path: str = "", input_file_uri: bool = False) -> Frame:
    """One text column, ``node``, with each element at ``node_path``, a whole path from the root (``root/items/item``); the whole document without one.

    A file is read by one task; large files of rows are better read by ``from_xml_rows``, which splits them."""
    if not node_path:
        return _finish(spark.read.text(path, wholetext=True).withColumnRenamed("value", "node"), input_file_uri)
    steps = [p for p in node_path.split("/") if p]

    def run(batches):
        for b in batches:
            for uri, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                nodes = xml_nodes(content, steps)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array([uri] * len(nodes), pa.string())], names=["node", "_input_file_uri"])

    nodes = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "node string, _input_file_uri string")
    return Frame(nodes if input_file_uri else nodes.drop("_input_file_uri"))


def from_xml_rows(spark: SparkSession, path: str, row: str, schema=None) -> Frame:
    """Typed columns from the elements named ``row``."""
    reader = spark.read.format("xml").option("rowTag", row)
    return Frame((reader.schema(_struct(schema)) if schema else reader).load(path))


def from_avro(*_, **__) -> Frame:
    raise NotImplementedError("Avro is not supported")


def files(spark: SparkSession, path: str) -> Frame:
    """(path, protocol, file_name, base_name, is_file, is_dir, extension, size) of the files and folders that a glob names; a folder's own entries."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = list(fs.globStatus(fs_path) or [])
    if len(found) == 1 and found[0].isDirectory():
        found = list(fs.listStatus(found[0].getPath()))
    rows = []
    for s in found:
        name = s.getPath().getName()
        base, dot, extension = name.rpartition(".")
        uri = s.getPath().toUri()
        rows.append((uri.getPath(), uri.getScheme() or "file", base if dot else name, name, s.isFile(), s.isDirectory(), extension if dot and s.isFile() else None, s.getLen()))
    return Frame(spark.createDataFrame(rows, "path string, protocol string, file_name string, base_name string, is_file boolean, is_dir boolean, extension string, size long"))


def from_path_partitions(spark: SparkSession, path: str) -> Frame:
    """(path, partitions): the ``name=value`` folders on the way to each file."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    pairs = F.regexp_extract_all("path", F.lit(r"/([^/=]+=[^/]*)(?=/)"), 1)
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.substring_index(p, "=", -1).alias("v")))
    return Frame(listed.select("path", F.map_from_entries(entries).alias("partitions")))
