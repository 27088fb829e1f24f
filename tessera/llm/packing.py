"""Packing of documents into training sequences of several permitted lengths by best fit."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Bpe, vocabulary
from .common import Workspace

#: Items of one packing group, about; the groups' number follows from the input's pieces.
GROUP_ITEMS = 20_000
LENGTHS = (512, 1024, 2048, 4096)
#: Cost of a sequence of n tokens: n + n * n / QUADRATIC (attention).
QUADRATIC = 65536


def cost(n: int) -> float:
    return n + n * n / QUADRATIC


class Left:
    """Lengths of the items that are still to be placed: how often each occurs, and the largest that is no longer than a room."""

    def __init__(self, lengths: list[int]) -> None:
        self.count = Counter(lengths)
        self.there = 0  # a bit for each length
        for n in self.count:
            self.there |= 1 << n

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.there ^= 1 << n

    def fill(self, room: int) -> int:
        """Tokens that the items left would put into a room, the longest that fits first."""
        filled, below = 0, room
        while below > 0 and (n := (self.there & ((2 << below) - 1)).bit_length() - 1) > 0:
            k = min(self.count[n], room // n)
            filled, room = filled + k * n, room - k * n
            below = min(n - 1, room)
        return filled


def best_fit(lengths: list[int], permitted: tuple[int, ...]) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, its offset in the bin, capacity of each bin). Items, none over the largest permitted length, are placed
    longest first. An item enters the open bin with the tightest room that holds it; else a bin is opened. Its size is the one of least cost a token, after the
    items left have filled it as far as they can (``Left.fill``) and it has shrunk to them: a short sequence that stays half empty loses
    against a long one that fills. At last each bin shrinks to the least permitted length that holds its contents."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    rooms: list[tuple[int, int]] = []
    bins, offsets, used = [0] * len(lengths), [0] * len(lengths), []
    left = Left(lengths)
    least = {u: next(c for c in permitted if c >= u) for u in range(1, permitted[-1] + 1)}
    for i in order:
        n = lengths[i]
        left.take(n)
        at = bisect_left(rooms, (n, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            held = [(n + left.fill(c - n), c) for c in permitted if c >= n]
            room = min((cost(least[u]) / u, c) for u, c in held)[1]
            b = len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        if room > n:
            insort(rooms, (room - n, b))
    return bins, offsets, [least[u] for u in used]


def token_counts(docs: DataFrame, spec: str, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, n): the tokens of each row's whole text and one end mark, and a number of the row's own."""
    shipped = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        bpe = Bpe.shared(shipped.value)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                n = [n + 1 for n in bpe.count_all([t or "" for t in part.column(2).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], names=["doc_id", "row", "n"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, n long")


def pack_documents(docs: DataFrame, spec: str | None = None, lengths: tuple[int, ...] = LENGTHS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: (doc_id, piece, start, n_tokens, bin_id, bin_offset, bin_length).

    ``spec`` is the text of a vocabulary file (None: ``bpe.vocabulary()``). A document has its text's tokens and one end mark, so that null and empty texts are one token.
    Documents longer than the largest length are cut into pieces of that length and a rest; start is the piece's first token.
    Rows with the same doc_id, or without one, are documents of their own. Items are dealt by hash of row and piece into
    groups of about GROUP_ITEMS and each group is packed alone: the bins of a group waste at most a few parts
    in a thousand, and no task holds more than a group however large the corpus or one of its texts is. bin_id is unique over all
    groups; of equal lengths the lesser row comes first. Other columns, whatever their names, are not read; an empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "packing")
    permitted = tuple(sorted(set(lengths)))
    top = permitted[-1]
    sized = ws.table(token_counts(docs, spec or vocabulary(), id_col, text_col), "tokens")  # rows keep their numbers from here on
    items = sized.agg(F.sum(F.ceil(F.col("n") / top))).first()[0] or 0
    groups = max(1, -(-items // GROUP_ITEMS))
    pieces = sized.select("doc_id", "row", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / top))).alias("piece"))
    pieces = pieces.select("doc_id", "row", "piece", (F.col("piece") * top).alias("start"), F.least(F.lit(top), F.col("n") - F.col("piece") * top).cast("long").alias("n_tokens"))
    dealt = pieces.withColumn("pack", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("piece", "ascending")])
        bins, offsets, sizes = best_fit(table["n_tokens"].to_pylist(), permitted)
        first = table["pack"][0].as_py() << 32
        table = table.select(["doc_id", "piece", "start", "n_tokens"])
        for name, values in (("bin_id", [first + b for b in bins]), ("bin_offset", offsets), ("bin_length", [sizes[b] for b in bins])):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    return dealt.groupBy("pack").applyInArrow(run, "doc_id long, piece long, start long, n_tokens long, bin_id long, bin_offset long, bin_length long")
