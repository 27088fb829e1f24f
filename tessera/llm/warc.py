"""WARC archives: writing, normalising of whole-file gzip streams, and reading by a sidecar index."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, shuffle_partitions

#: A new archive begins after this many bytes of records.
ARCHIVE_BYTES = 16 << 20
READ = 1 << 20
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:page:"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, as the executors reach it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), urlsplit(uri).path
    return fs.FileSystem.from_uri(uri)


def record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None) -> list[bytes]:
    """A response record with the page's bytes, or a revisit record of ``refers_to`` that keeps the HTTP head only."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    body = [head] if refers_to is not None else [head, payload]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or 'urn:unknown', safe=':/?#[]@!$&()*+,;=%~-._' + chr(39))}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([] if refers_to is None else [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {sum(map(len, body))}",
    ]
    return [("\r\n".join(lines) + "\r\n\r\n").encode(), *body, b"\r\n\r\n"]


def mark_revisits(ws: Workspace, pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, url, html, refers_to). Copies are found on digests alone, added up before they are shuffled; the pages
    themselves move only if the list of repeated digests is too long for Spark's own broadcast limit."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.sha1(payload.cast("binary")).alias("digest"), (F.octet_length(payload) >= least_bytes).alias("counts"))
    same = rows.where("counts").groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    same = ws.table(same.where("n > 1").select("digest", "keeper", F.lit(True).alias("counts")), "repeated")
    joined = rows.join(same, ["digest", "counts"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def write_monolithic(rows: DataFrame, folder: str) -> DataFrame:
    """Archives that are one gzip stream each, as old crawlers left them; (archive) of each finished one.

    Names are random, so that a task that runs again never meets what its lost attempt wrote; only archives named in the
    result are read."""

    def run(batches):
        system, path = open_folder(folder)
        system.create_dir(path, recursive=True)
        out = pack = name = None
        size, done = 0, []
        for b in batches:
            for row in zip(*(b.column(i) for i in range(4))):
                if out is None:
                    name = f"{uuid.uuid4().hex}.whole.warc.gz"
                    out, pack, size = system.open_output_stream(f"{path}/{name}"), zlib.compressobj(LEVEL, wbits=31), 0
                for piece in record(*(v.as_py() for v in row)):
                    out.write(pack.compress(piece))
                    size += len(piece)
                if size >= ARCHIVE_BYTES:
                    out.write(pack.flush())
                    out.close()
                    done.append(name)
                    out = None
        if out is not None:
            out.write(pack.flush())
            out.close()
            done.append(name)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["archive"])

    return rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, "archive string")


def inflate(stream):
    """The content of a gzip file of one or more members, in pieces, read once from front to back."""
    unpack = zlib.decompressobj(wbits=31)
    fresh = True
    while data := stream.read(READ):
        while data:
            piece = unpack.decompress(data, READ)
            if piece:
                yield piece
            fresh = False
            data = unpack.unconsumed_tail
            if unpack.eof:
                data, unpack, fresh = unpack.unused_data, zlib.decompressobj(wbits=31), True
    if not fresh:
        raise ValueError("the gzip stream ends early")


def parse(pieces):
    """(header lines, body pieces) of each record; a record's body must be drawn before the next record."""
    held = bytearray()

    def fill() -> bool:
        for piece in pieces:
            held.extend(piece)
            return True
        return False

    def body(left: int):
        while left:
            if not held and not fill():
                raise ValueError("the archive ends within a record")
            piece = bytes(held[:left])
            del held[: len(piece)]
            left -= len(piece)
            yield piece

    while True:
        while not (held and held.strip(b"\r\n")) and fill():
            pass
        at = len(held) - len(held.lstrip(b"\r\n"))
        del held[:at]
        if not held:
            return
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill():
                raise ValueError("the archive ends within a header")
        head = bytes(held[:end])
        del held[: end + 4]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
        yield head, fields, body(int(fields["content-length"]))


def normalise(archive, out, index) -> int:
    """Inflate ``archive`` once and write every record to ``out`` as a gzip member of its own, and a line of
    ``index`` (offset, length, type, id, uri, digest) for each. Bodies pass in pieces: memory does not grow with a record."""
    offset = count = 0
    for head, fields, body in parse(inflate(archive)):
        pack = zlib.compressobj(LEVEL, wbits=31)
        size = 0
        for piece in (head, b"\r\n\r\n"):
            size += _put(out, pack.compress(piece))
        for piece in body:
            size += _put(out, pack.compress(piece))
        size += _put(out, pack.compress(b"\r\n\r\n"))
        size += _put(out, pack.flush())
        line = {"offset": offset, "length": size, "type": fields.get("warc-type"), "id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest")}
        index.write((json.dumps(line) + "\n").encode())
        offset, count = offset + size, count + 1
    return count


def _put(out, data: bytes) -> int:
    out.write(data)
    return len(data)


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """(archive, records) of the member-wise archives; the sidecar index of each stands beside it as ``.idx``.

    The source goes once its successor and index are complete. A task that runs again finds the successor and keeps it."""

    def run(batches):
        system, path = open_folder(folder)
        for b in batches:
            done, counts = [], []
            for name in b.column(0).to_pylist():
                new = name.replace(".whole.warc.gz", ".warc.gz")
                source, target = f"{path}/{name}", f"{path}/{new}"
                if system.get_file_info(f"{target}.idx").type == fs.FileType.NotFound:
                    part = f"{target}.{uuid.uuid4().hex}"
                    with system.open_input_stream(source) as src, system.open_output_stream(part) as out, system.open_output_stream(f"{part}.idx") as idx:
                        normalise(src, out, idx)
                    system.move(part, target)
                    system.move(f"{part}.idx", f"{target}.idx")  # last: it says that the archive is whole
                if system.get_file_info(source).type != fs.FileType.NotFound:
                    system.delete_file(source)
                with system.open_input_stream(f"{target}.idx") as idx:
                    counts.append(idx.read().count(b"\n"))
                done.append(new)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string()), pa.array(counts, pa.int64())], names=["archive", "records"])

    return archives.mapInArrow(run, "archive string, records long")


INDEX = "offset long, length long, type string, id string, uri string, digest string"


def read_index(spark, archives: DataFrame, folder: str) -> DataFrame:
    """The sidecar lines of the named archives, read where the archives' names are."""

    def run(batches):
        system, path = open_folder(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                with system.open_input_stream(f"{path}/{name}.idx") as idx:
                    lines = [json.loads(x) for x in idx.read().splitlines()]
                table = pa.Table.from_pylist([{"archive": name, **x} for x in lines], schema=pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("id", pa.string()), ("uri", pa.string()), ("digest", pa.string())]))
                yield from table.to_batches()

    return archives.select("archive").mapInArrow(run, f"archive string, {INDEX}")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to) of each indexed record.

    Each record is inflated from its own offset. A response's payload is measured and digested anew and must agree with
    its header; a revisit's length and digest come from its headers."""

    def run(batches):
        system, path = open_folder(folder)
        name = file = None
        window, begin = b"", 0
        for b in batches:
            out = []
            for archive, offset, length in zip(*(b.column(i).to_pylist() for i in range(3))):
                if archive != name:
                    name, file, window, begin = archive, system.open_input_file(f"{path}/{archive}"), b"", 0
                if not begin <= offset or offset + length > begin + len(window):
                    begin, window = offset, file.read_at(max(length, READ), offset)
                out.append(_read(window[offset - begin : offset - begin + length]))
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"])

    return index.select("archive", "offset", "length").mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long")


def _number(urn: str | None) -> int | None:
    text = (urn or "").strip("<>").removeprefix(ID)
    return int(text) if text else None


def _read(member: bytes) -> tuple:
    whole = zlib.decompress(member, wbits=31)
    ((_, fields, body),) = [(h, f, b"".join(b)) for h, f, b in parse(iter([whole]))]
    http, _, payload = body.partition(b"\r\n\r\n")
    stated = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != stated or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"record {fields['warc-record-id']} does not match its digest")
    return _number(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"], stated, digest, _number(fields.get("warc-refers-to"))


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> tuple[DataFrame, DataFrame, str]:
    """Write ``pages`` (page_id, url, html) as archives, normalise them, and read them back by their index.

    (records, index, folder). Of pages with equal payloads of at least ``least_bytes`` bytes the one with the largest page_id is the response and
    the others revisit it; rows that repeat its page_id are responses too. Null html is an empty payload, a null url ``urn:unknown``;
    a null page_id stays null and is a response only if no page with an id has its payload. Other columns are not read; an empty table gives no rows.
    """
    spark = pages.sparkSession
    ws = Workspace(spark, "warc")
    folder = ws.path("archives")
    whole = ws.table(write_monolithic(mark_revisits(ws, pages, least_bytes), folder), "whole")
    n = shuffle_partitions(spark)
    members = ws.table(normalise_archives(whole.repartition(n, "archive"), folder), "members")
    index = ws.table(read_index(spark, members.repartition(n, "archive"), folder), "index")
    dealt = index.repartition(n, "archive", F.floor(F.col("offset") / (8 * READ))).sortWithinPartitions("archive", "offset")
    return read_records(dealt, folder), index, folder
