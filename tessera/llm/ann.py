"""Nearest neighbours by a blocked matrix join on int8 tiles with error bounds, verified in double precision."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

#: Bytes of query vectors that go out for one scan of the table (they bound the broadcast), and the tile's sides.
SCAN_BYTES, TILE_QUERIES, TILE_ROWS = 64 << 20, 1024, 2048


def vectors(ids: pa.Array, column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, double matrix) by dimension, of the usable rows: no null, no null or non-finite component, not zero."""
    column = column.cast(pa.list_(pa.float64()))
    keep = ~(np.asarray(column.is_null()) | np.asarray(ids.is_null()))
    sizes = np.where(keep, np.asarray(column.value_lengths().fill_null(0)), 0)
    keep &= sizes > 0
    flat, offsets = column.values, np.asarray(column.offsets)
    nulls = np.append(0, np.cumsum(np.asarray(flat.is_null()))) if flat.null_count else None
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    number = ids.fill_null(0).to_numpy(zero_copy_only=False)
    out = []
    for dim in np.unique(sizes[keep]):
        rows = np.flatnonzero(keep & (sizes == dim))
        if nulls is not None:
            rows = rows[nulls[offsets[rows] + dim] == nulls[offsets[rows]]]
        x = values[offsets[rows][:, None] + np.arange(dim)[None, :]]
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        out.append((number[rows[good]].astype(np.int64), x[good]))
    return [(i, x) for i, x in out if len(i)]


def scaled(x: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component between 1/2 and 1: no square over- or underflows, no digit
    is lost, and no cosine changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def total(x: np.ndarray) -> np.ndarray:
    """Sums of the rows, from the first component to the last, so that a score is the same wherever it is computed."""
    return np.cumsum(x, axis=1)[:, -1]


class Quantised:
    """Scaled vectors: norms, and of their unit vectors the int8 codes (held as float32), scales, and error norms."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = scaled(x)
        self.norm = np.sqrt(total(self.x * self.x))
        unit = self.x / self.norm[:, None]
        scale = np.abs(unit).max(axis=1) / 127
        code = np.rint(unit / scale[:, None]).astype(np.int8)
        rough = code * scale[:, None]
        self.code, self.scale = code.astype(np.float32), scale.astype(np.float32)
        self.error = np.sqrt(((unit - rough) ** 2).sum(axis=1)).astype(np.float32)
        self.length = np.sqrt((rough**2).sum(axis=1)).astype(np.float32)


def slack(dim: int) -> np.float32:
    """Bound of the rounding errors in a product of codes and its scaling. Up to 1040 components float32 holds the product exactly
    (127 * 127 * 1040 < 2 ** 24); beyond, each addition may err by 2 ** -24 of sums that scaling brings to 1 at most."""
    return np.float32(max(1e-5, dim * 2.0**-23))


class Block:
    """A block of queries of one dimension and each query's best k so far, in heaps of (score, -vec_id)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        self.ids, self.k, self.slack = ids, k, slack(x.shape[1])
        self.q = Quantised(x)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.floor = np.full(len(ids), -np.inf, np.float32)  # no score below it can enter the heap

    def join(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Tiles of this block against candidates: int8 products bound each score from above and below; pairs that may
        still be among the best k are recomputed from the original vectors."""
        for at in range(0, len(ids), TILE_ROWS):
            cid, c = ids[at : at + TILE_ROWS], Quantised(x[at : at + TILE_ROWS])
            for q0 in range(0, len(self.ids), TILE_QUERIES):
                rows = slice(q0, q0 + TILE_QUERIES)
                about = (self.q.code[rows] @ c.code.T) * (self.q.scale[rows, None] * c.scale[None, :])
                bound = self.q.error[rows, None] + self.q.length[rows, None] * c.error[None, :] + self.slack
                own = self.ids[rows, None] == cid[None, :]
                about[own] = -np.inf
                floor = self.floor[rows]
                if len(cid) > self.k:
                    low = np.partition(about - bound, len(cid) - self.k, axis=1)[:, len(cid) - self.k]
                    floor = np.maximum(floor, low)
                qi, ci = np.nonzero((about + bound >= floor[:, None]) & ~own)
                for part in range(0, len(qi), 200_000):
                    self._verify(qi[part : part + 200_000] + q0, ci[part : part + 200_000], cid, c)

    def _verify(self, qi, ci, cid, c) -> None:
        score = total(self.q.x[qi] * c.x[ci]) / (self.q.norm[qi] * c.norm[ci])
        ids = cid[ci]
        order = np.lexsort((ids, -score, qi))  # of many equal scores only the k smallest ids can stay
        first = np.append(True, qi[order][1:] != qi[order][:-1])
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        best = order[place < self.k]
        for q, s, i in zip(qi[best].tolist(), score[best].tolist(), ids[best].tolist()):
            heap, item = self.heaps[q], (s, -i)
            if len(heap) < self.k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)
            if len(heap) == self.k:
                self.floor[q] = np.float32(heap[0][0]) - self.slack


def nearest(embeddings: DataFrame, queries, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest cosine for each row that ``queries`` (a condition) selects.

    Exact, in double precision; ties go to the smaller vec_id; a row is never its own neighbour, nor are rows that repeat its id.
    Vectors that are null, zero or hold null or non-finite components take no part, and only vectors of one length
    compare; components may be as large or small as doubles are. A candidate row that repeats counts once for each time it is there, a query id that
    repeats asks once, with its least vector. Other columns, whatever their names, are not read; an empty table gives no rows.
    SCAN_BYTES of query vectors go out for each scan of the table; each task joins its candidates tile by tile and
    sends k rows per query, and those meet by query.
    """
    spark = embeddings.sparkSession
    ws = Workspace(spark, "nearest")
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    asked = ws.table(embeddings.where(queries).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")), "queries")
    held = asked.agg(F.sum(F.size("x").cast("long") * 8)).first()[0] or 0
    blocks = max(1, -(-held // SCAN_BYTES))
    found = ws.path("found")
    schema = "query_id long, vec_id long, score double"
    for n in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).toArrow().combine_chunks()
        batch = part.to_batches()
        mine = vectors(batch[0].column(0), batch[0].column(1)) if batch else []
        shipped = spark.sparkContext.broadcast(mine)
        rows.mapInArrow(_joiner(shipped, k), schema).write.mode("append").parquet(found)
        shipped.unpersist()
    best = spark.read.schema(schema).parquet(found)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _joiner(shipped, k: int):
    def run(batches):
        blocks = {x.shape[1]: Block(*_once(ids, x), k) for ids, x in shipped.value}
        for b in batches:
            for ids, x in vectors(b.column(0), b.column(1)):
                if (block := blocks.get(x.shape[1])) is not None:
                    block.join(ids, x)
        for block in blocks.values():
            out = [(q, -i, s) for q, heap in zip(block.ids.tolist(), block.heaps) for s, i in heap]
            if out:
                q, i, s = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def _once(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A query id that repeats asks once, with its least vector."""
    order = np.lexsort((*x.T[::-1], ids))
    ids, x = ids[order], x[order]
    keep = np.append(True, ids[1:] != ids[:-1])
    return ids[keep], x[keep]
