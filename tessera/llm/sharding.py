"""Sharding by best-fit decreasing: indivisible groups, largest first, go to the bin whose room is tightest."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, fits, shuffle_partitions

#: Buckets of the slot numbering in each shard.
SLOT_BUCKETS = 4096
#: Groups with more than one in so many rows are joined apart, so that none crowds a task.
CROWDED = 1000
#: At most so many rows go out as a broadcast.
BROADCAST_ROWS = 1_000_000


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each item. Items come largest first (ties by position); each enters the bin with the tightest room that
    holds it, or opens a bin. An item over ``capacity`` gets a bin of its own."""
    rooms: list[tuple[int, int]] = []  # sorted (room, bin): a search and an insertion each
    bins, opened = [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(rooms, (sizes[i], -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b, opened = max(capacity, sizes[i]), opened, opened + 1
        bins[i] = b
        insort(rooms, (room - sizes[i], b))
    return bins


def best_fit_runs(runs: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """Best-fit decreasing of ``runs`` (size, number of groups of that size), largest first: (run, bin, groups) in the order of placement. Groups of one size that
    follow each other go on into the bin that took the first, as its room stays the tightest, so that a run costs a step for each bin
    and not for each group. None if more than ``most`` bins would open."""
    rooms: list[tuple[int, int]] = []
    out, opened = [], 0
    for i, (size, n) in enumerate(runs):
        while n:
            at = bisect_left(rooms, (size, -1))
            if at < len(rooms):
                room, b = rooms.pop(at)
            else:
                if opened == most:
                    return None
                room, b, opened = max(capacity, size), opened, opened + 1
            k = min(n, room // size)
            out.append((i, b, k))
            n -= k
            insort(rooms, (room - k * size, b))
    return out


def pack_runs(runs: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """(run, bin, groups) with bins below ``shards``, at the least capacity that best-fit decreasing can keep to. Groups larger than an even
    share take a bin alone, and the capacity of the others is sought without them."""
    total, alone, rest = sum(s * n for s, n in runs), [], list(runs)
    while rest and shards - len(alone) > 1 and rest[0][0] * (shards - len(alone)) > total:
        alone.append((len(runs) - len(rest), len(alone), 1))
        total -= rest[0][0]
        rest = [(rest[0][0], rest[0][1] - 1), *rest[1:]] if rest[0][1] > 1 else rest[1:]
    if not rest:
        return alone
    skipped, left = len(runs) - len(rest), shards - len(alone)
    low, high = max(-(-total // left), rest[0][0]), total
    while low < high:
        mid = (low + high) // 2
        if best_fit_runs(rest, mid, left) is not None:
            high = mid
        else:
            low = mid + 1
    return alone + [(skipped + i, len(alone) + b, k) for i, b, k in best_fit_runs(rest, high)]


def _ranked(ws: Workspace, groups: DataFrame) -> DataFrame:
    """(same, bytes, part, place): groups in the order of packing (largest first, ties by ``same``), dealt by ranges of it; place counts a part's rows from 0."""

    def run(batches):
        at = 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(at, at + n))], names=[*b.schema.names, "place"])
            at += n

    n = shuffle_partitions(ws.spark)
    dealt = groups.repartitionByRange(n, F.desc("bytes"), "same").sortWithinPartitions(F.desc("bytes"), "same")
    dealt = dealt.select("same", "bytes", F.spark_partition_id().alias("part"))
    return ws.table(dealt.mapInArrow(run, "same string, bytes long, part int, place long"), "ranked")


def place_groups(ws: Workspace, groups: DataFrame, shards: int) -> DataFrame:
    """(same, shard) of all ``groups`` (same, bytes), each packed by its own size.

    The driver packs runs of equal sizes. D different sizes add up to D * D / 2 bytes at least, so that no more than sqrt(2 * all bytes) of
    them reach it. A group then finds its shard by its rank among all groups, of which it knows the part's start and its place there."""
    ranked = _ranked(ws, groups)
    runs = [(r.bytes, r.n) for r in ranked.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("bytes")).collect()]
    counts = sorted((r.part, r.n) for r in ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    parts = np.array([p for p, _ in counts], np.int64)
    starts = np.cumsum([0, *(n for _, n in counts)])[:-1]
    placed = sorted(pack_runs(runs, shards), key=lambda x: x[0])  # stable: the bins of a run in the order in which they took its groups
    ends = ws.spark.sparkContext.broadcast((parts, starts, np.cumsum([k for _, _, k in placed]), np.array([b for _, b, _ in placed], np.int32)))

    def run(batches):
        parts, starts, ends_, bins = ends.value
        for b in batches:
            rank = starts[np.searchsorted(parts, b.column(1).to_numpy())] + b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bins[np.searchsorted(ends_, rank, side="right")])], names=["same", "shard"])

    return ws.table(ranked.select("same", "part", "place").mapInArrow(run, "same string, shard int"), "groups-placed")


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row for each row, under the law ``bytes``: equal texts stay together
    and the shards' bytes are as near to equal as best-fit decreasing makes them. size is the UTF-8 bytes of the text plus 1; null
    texts count as empty ones (crc 0). slot counts each shard's rows from 0 without gaps, in no promised order. Texts of any length are one item with
    their copies; other columns, whatever their names, are not read; an empty table gives no rows. What reaches the driver is one number for
    each different size of a group (``place_groups``) and shards * SLOT_BUCKETS counts.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "shards")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("same"))
    rows = ws.table(rows, "rows")
    groups = ws.table(rows.groupBy("same").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "groups")
    shard_of = place_groups(ws, groups.select("same", "bytes"), shards)
    n = groups.agg(F.sum("n")).first()[0] or 0
    crowded = F.broadcast(ws.table(groups.where(F.col("n") * CROWDED > n).select("same").join(shard_of, "same"), "crowded"))  # fewer than CROWDED
    placed = rows.join(crowded, "same").unionByName(rows.join(crowded, "same", "left_anti").join(fits(shard_of, BROADCAST_ROWS), "same"))
    placed = placed.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("row"), F.lit(SLOT_BUCKETS)).cast("int").alias("bucket"), "row")
    placed = ws.table(placed, "placed")
    counts = sorted(placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: (r.shard, r.bucket))
    firsts, at, shard = [], 0, None
    for r in counts:
        at = 0 if r.shard != shard else at
        firsts.append((r.shard, r.bucket, at))
        at, shard = at + r.n, r.shard
    firsts = spark.createDataFrame(firsts, "shard int, bucket int, first long")
    nth = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("row")) - 1
    out = placed.join(F.broadcast(firsts), ["shard", "bucket"]).withColumn("slot", (F.col("first") + nth).cast("long"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
