"""SimHash near-duplicates: fingerprints, and all pairs within a Hamming distance by generalised pigeonhole.

If 64 bits fall into m parts and the parts have thresholds T with sum(T) = t - m + 1 (-1 leaves a part out), then two
fingerprints within t differ in at most T[i] bits of some part i. Parts are unions of 8-bit blocks that hold
correlated bits; each fingerprint gets thresholds of its own, chosen by dynamic programming on the candidates that
block histograms make likely. It then probes every value within T[i] of its own in part i, and each hit is verified.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, connected_components, fits, shuffle_partitions

LANES = np.uint64(0x0101010101010101)
BLOCKS, WIDTH = 8, 8
#: Blocks of each part, by number of parts.
PARTS = {m: [list(x) for x in np.array_split(np.arange(BLOCKS), m)] for m in range(1, BLOCKS + 1)}
#: A probe that is shuffled costs as much as this many candidates that are verified.
PROBE_COST = 16.0
#: Fingerprints that serve to choose the number of parts (any number gives the same links).
COST_SAMPLE = 2048
#: More data rows of one key than this are split over tiles.
TILE = 4096
#: At most so many probes of a task are held at once.
PROBES_HELD = 4_000_000


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle, repeats included; one of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(joined, 42)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - k + 1].tolist()
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist())], np.uint64)


#: Words of fewer characters are in every text of a language; a text with fewer than FEW longer ones has all its words as features.
LONG, FEW = 5, 3


def word_hashes(text: str | None) -> np.ndarray:
    """XXH64 (seed 42) of each distinct word of at least LONG bytes. An edit changes one of them where it changes five
    five-word shingles, so that copies of a shingle similarity of 0.8 are but a few bits apart."""
    words = set((text or "").encode("utf-8", "surrogatepass").lower().split())
    long_words = [w for w in words if len(w) >= LONG]
    return np.array([xxhash.xxh64_intdigest(w, 42) for w in (long_words if len(long_words) >= FEW else words)], np.uint64)


def majority(h: np.ndarray) -> int:
    """64-bit fingerprint, signed: a bit is 1 if it is set in over half of ``h``."""
    n = len(h)
    if n == 0:
        return 0
    padded = np.zeros(-(-n // 255) * 255, np.uint64)
    padded[:n] = h
    padded = padded.reshape(-1, 255)
    counts = np.empty((8, 8), np.int64)  # [byte, bit in byte]
    for bit in range(8):
        sums = ((padded >> np.uint64(bit)) & LANES).sum(axis=1, dtype=np.uint64)
        counts[:, bit] = sums.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = (2 * counts.reshape(64) > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of the texts' shingles, or of their distinct long words (None). A null or wordless text has fingerprint 0."""

    def run(batches):
        for b in batches:
            texts = b.column(1)
            fps = [majority(word_hashes(t.as_py()) if shingle is None else shingle_hashes(t.as_py(), shingle)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return ids.mapInArrow(run, "doc_id long, fp long")


def bits_of(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlated_blocks(distinct: DataFrame) -> np.ndarray:
    """(8, 8) bit numbers: blocks of bits, correlated bits together. Each task sends a 64 x 64 matrix of sums, and
    they are added up by cell before 4160 numbers reach the driver."""

    def run(batches):
        total, n = np.zeros((64, 64)), 0
        for b in batches:
            x = bits_of(b.column(0).to_numpy(zero_copy_only=False)).astype(np.float32) * 2 - 1
            total[:] += x.T @ x
            total[np.arange(64), np.arange(64)] += x.sum(axis=0) - len(x)  # the diagonal carries the sums
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(np.arange(4096), -1)), pa.array(np.append(total.reshape(-1), float(n)))], names=["cell", "x"]
            )

    rows = distinct.select("fp").mapInArrow(run, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect()
    cells = {r.cell: r.x for r in rows}
    n = max(1.0, cells.pop(-1, 1.0))
    m = np.array([cells.get(i, 0.0) for i in range(4096)]).reshape(64, 64) / n
    mean = np.diag(m).copy()
    cov = m - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(1 - mean**2, 1e-9))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, blocks = list(range(64)), []
    while left:
        sub = corr[np.ix_(left, left)]
        a = left[int(sub.max(axis=1).argmax())]
        block = [a]
        left.remove(a)
        while len(block) < WIDTH:
            b = left[int(corr[np.ix_(left, block)].mean(axis=1).argmax())]
            block.append(b)
            left.remove(b)
        blocks.append(sorted(block))
    return np.array(blocks)


def block_values(fps: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """(n, 8) uint8: the value of each block."""
    bits = bits_of(fps)
    return np.stack([np.packbits(bits[:, b], axis=1, bitorder="little")[:, 0] for b in blocks], axis=1)


def block_histograms(distinct: DataFrame, blocks: np.ndarray) -> np.ndarray:
    """(8, 256) counts over all fingerprints; 2048 numbers at any size."""

    def run(batches):
        total = np.zeros(BLOCKS * 256, np.int64)
        for b in batches:
            v = block_values(b.column(0).to_numpy(zero_copy_only=False), blocks)
            total += np.bincount((v + np.arange(BLOCKS) * 256).reshape(-1), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["cell", "n"])

    out = np.zeros(BLOCKS * 256, np.int64)
    for r in distinct.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out.reshape(BLOCKS, 256)


class Thresholds:
    """Per-part thresholds of each fingerprint by dynamic programming."""

    def __init__(self, hist: np.ndarray, distance: int, parts: int) -> None:
        self.distance, self.parts, self.members = distance, parts, PARTS[parts]
        self.n = float(max(1, hist[0].sum()))
        values = np.arange(256)
        apart = np.bitwise_count(values[:, None] ^ values[None, :])
        reach = distance + 1  # distances 0..distance matter
        #: share[b, v, d]: part of all fingerprints whose block b is d bits from v
        self.share = np.zeros((BLOCKS, 256, reach))
        for b in range(BLOCKS):
            for d in range(reach):
                self.share[b, :, d] = (apart == d) @ hist[b] / self.n
        from math import comb

        self.widths = [WIDTH * len(p) for p in self.members]
        self.probes = np.array([[sum(comb(w, k) for k in range(e + 1)) for e in range(reach)] for w in self.widths], float)

    def choose(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Thresholds (n, m) with sum distance - m + 1, and their cost."""
        n, m, reach = len(values), self.parts, self.distance + 1
        budget = self.distance + 1  # each part takes 0 (left out) .. distance + 1; all take distance + 1 together
        best = np.full((n, budget + 1), np.inf)
        best[:, 0] = 0
        taken = np.zeros((m, n, budget + 1), np.int8)
        for i, blocks in enumerate(self.members):
            near = np.zeros((n, reach))
            near[:, 0] = 1
            for b in blocks:
                share, fresh = self.share[b][values[:, b]], np.zeros((n, reach))
                for d in range(reach):
                    fresh[:, d:] += near[:, : reach - d] * share[:, d : d + 1]
                near = fresh
            cost = np.zeros((n, budget + 1))
            cost[:, 1:] = np.cumsum(near, axis=1) * self.n + PROBE_COST * self.probes[i]
            fresh = np.full((n, budget + 1), np.inf)
            for k in range(budget + 1):
                c = best[:, : budget + 1 - k] + cost[:, k : k + 1]
                better = c < fresh[:, k:]
                fresh[:, k:] = np.where(better, c, fresh[:, k:])
                taken[i][:, k:] = np.where(better, k, taken[i][:, k:])
            best = fresh
        t, left, row = np.zeros((n, m), np.int8), np.full(n, budget), np.arange(n)
        for i in reversed(range(m)):
            t[:, i] = taken[i][row, left] - 1
            left = left - taken[i][row, left]
        return t, best[:, budget]

    def part_value(self, values: np.ndarray, i: int) -> np.ndarray:
        """The key of part i: the blocks' bytes, and the part's number above them."""
        out = np.zeros(len(values), np.int64)
        for b in self.members[i]:
            out = (out << WIDTH) | values[:, b]
        return out + (i << 58) if self.parts > 1 else out


def ball(width: int, radius: int) -> np.ndarray:
    """Masks of 1..radius bits, by number of bits."""
    out = [sum(1 << x for x in c) for r in range(radius + 1) for c in combinations(range(width), r)]
    return np.array(out, np.int64)


class Forest:
    """Union-find over the fingerprints that one task links: only links that join two trees leave the task."""

    LIMIT = 2_000_000

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = q = up.get(p, p)
            x = q
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        if len(self.up) > self.LIMIT:  # forgetting only lets more links through
            self.up.clear()
        new = []
        for x, y in zip(a.tolist(), b.tolist()):
            r, s = self.root(x), self.root(y)
            if r != s:
                self.up[max(r, s)] = min(r, s)
                new.append((x, y))
        return new


def _pairs_in_groups(starts, n_data, n_query, fp, distance):
    """All (query, data) pairs of small groups whose distance holds; rows of a group: its data, then its queries."""
    n = n_data * n_query
    group = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
    d = fp[starts[group] + k % n_data[group]]
    q = fp[starts[group] + n_data[group] + k // n_data[group]]
    keep = (d > q) & (np.bitwise_count((d ^ q).view(np.uint64)) <= distance)
    return q[keep], d[keep]


def _pairs_in_tile(data, query, distance):
    """For a large group: for each query one hit in every tree of data that it joins; no more links than rows."""
    label = np.arange(len(data))
    out_q, out_d = [], []
    for at in range(0, len(query), 256):
        q = query[at : at + 256]
        hit = np.bitwise_count((q[:, None] ^ data[None, :]).view(np.uint64)) <= distance
        hit &= data[None, :] > q[:, None]
        some = hit.any(axis=1)
        out_q.append(q[some])
        out_d.append(data[hit.argmax(axis=1)[some]])
        while True:
            low = np.where(hit, label, len(data)).min(axis=1)
            high = np.where(hit, label, -1).max(axis=1)
            split = np.flatnonzero(some & (low < high))
            if not len(split):
                break
            row = split[0]
            labels, first = np.unique(label[hit[row]], return_index=True)
            out_q.append(np.full(len(labels), q[row]))
            out_d.append(data[np.flatnonzero(hit[row])[first]])
            label[np.isin(label, labels)] = labels[0]
    return np.concatenate(out_q), np.concatenate(out_d)


SMALL = 16


def link_sorted(batches, distance):
    """Links from rows (key, tile, role, fp) in that order; of a group only its data (at most about TILE rows) is kept
    from one batch to the next, while its queries stream by."""
    forest = Forest()
    held, held_key = np.empty(0, np.int64), None
    for b in batches:
        key, tile, role, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if not len(fp):
            continue
        if held_key is not None and (key[0], tile[0]) == held_key and len(held):
            n = len(held)
            key, tile = np.append(np.full(n, key[0]), key), np.append(np.full(n, tile[0]), tile)
            role, fp = np.append(np.zeros(n, role.dtype), role), np.append(held, fp)
        new = np.flatnonzero((key[1:] != key[:-1]) | (tile[1:] != tile[:-1])) + 1
        starts = np.append(0, new)
        sizes = np.diff(np.append(starts, len(fp)))
        n_query = np.add.reduceat(role.astype(np.int64), starts)
        n_data = sizes - n_query
        small = (n_data > 0) & (n_query > 0) & (n_data <= SMALL)
        found = [_pairs_in_groups(starts[small], n_data[small], n_query[small], fp, distance)]
        for g in np.flatnonzero((n_data > SMALL) & (n_query > 0)):
            a = starts[g]
            found.append(_pairs_in_tile(fp[a : a + n_data[g]], fp[a + n_data[g] : a + sizes[g]], distance))
        held_key = (key[-1], tile[-1])
        held = fp[starts[-1] : starts[-1] + n_data[-1]].copy()
        links = [x for q, d in found for x in forest.add(q, d)]
        if links:
            u, v = zip(*links)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _signatures(plan: Thresholds, fp: np.ndarray, values: np.ndarray, t: np.ndarray, with_queries: bool) -> pa.RecordBatch:
    """(key, role, fp): the key of each part as data (0), and the keys that it probes as a query (1)."""
    keys, roles, whose = [], [], []
    for i in range(plan.parts):
        v = plan.part_value(values, i)
        keys.append(v), roles.append(np.zeros(len(v), np.int8)), whose.append(fp)
        for radius in range(plan.distance + 1 if with_queries else 0):
            own = t[:, i] == radius
            if own.any():
                masks = ball(plan.widths[i], radius)
                k = (v[own][:, None] ^ masks[None, :]).reshape(-1)
                keys.append(k), roles.append(np.ones(len(k), np.int8)), whose.append(np.repeat(fp[own], len(masks)))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(roles)), pa.array(np.concatenate(whose))], names=["key", "role", "fp"])


def hamming_links(ws: Workspace, distinct: DataFrame, distance: int) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` within ``distance`` bits that connect just what all such
    links connect. Exact: every fingerprint is probed, and a key with many fingerprints is split over tiles."""
    spark = ws.spark
    blocks = correlated_blocks(distinct)
    hist = block_histograms(distinct, blocks)
    sample = np.array([r.fp for r in distinct.orderBy(F.xxhash64("fp")).select("fp").limit(COST_SAMPLE).collect()], np.int64)
    if not len(sample):
        return distinct.select(F.col("fp").alias("u"), F.col("fp").alias("v")).where("u <> v")
    options = {m: Thresholds(hist, distance, m) for m in range(2, min(BLOCKS, distance + 1) + 1)} or {1: Thresholds(hist, distance, 1)}
    plan = min(options.values(), key=lambda t: t.choose(block_values(sample, blocks))[1].mean() + PROBE_COST * t.parts)

    def signatures(with_queries):
        def run(batches):
            for b in batches:
                fps = b.column(0).to_numpy(zero_copy_only=False)
                for at in range(0, len(fps), 2000):
                    values = block_values(fps[at : at + 2000], blocks)
                    t, _ = plan.choose(values)
                    held = np.where(t >= 0, plan.probes[np.arange(plan.parts), np.maximum(t, 0)], 0).sum(axis=1)
                    part = (np.cumsum(held) // PROBES_HELD).astype(np.int64)  # slices of about so many probes
                    for n in np.unique(part):
                        mine = part == n
                        yield _signatures(plan, fps[at : at + 2000][mine], values[mine], t[mine], with_queries)

        return run

    schema = "key long, role byte, fp long"
    crowded = distinct.select("fp").mapInArrow(signatures(False), schema).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    crowded = ws.table(crowded.where(F.col("n") > TILE).select("key", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "crowded")
    rows = distinct.select("fp").mapInArrow(signatures(True), schema).join(crowded, "key", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    tiles = F.when(F.col("tiles").isNull(), F.array(F.lit(0))).when(F.col("role") == 0, F.array(own)).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))
    tiled = rows.select("key", F.explode(tiles).alias("tile"), "role", "fp")
    tiled = tiled.repartition(shuffle_partitions(spark), "key", "tile").sortWithinPartitions("key", "tile", "role", "fp")
    limit = plan.distance
    return tiled.mapInArrow(lambda batches: link_sorted(batches, limit), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int | None = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints a chain of links joins share the smallest doc_id.

    Equal fingerprints are one node, so that copies never meet pairwise. Null texts and texts without words have
    fingerprint 0 and link like any other; texts are read whole, however long; rows that repeat are rows of their own in the same group, and rows
    without an id link like any other but never name a group (one that has no id at all has no name). Texts of one id are linked only by what they say. Other columns of ``docs``, whatever their names, are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "simhash")
    fps = ws.table(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = ws.table(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links = ws.table(hamming_links(ws, distinct, distance), "links")
    groups = connected_components(ws, links)
    rooted = distinct.join(groups, distinct.fp == groups.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = ws.table(rooted, "rooted")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = ws.table(rooted.join(names, "root").select("fp", "component_id"), "named")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


#: A component of at most so many different texts is settled in one task.
SETTLED = 200


#: Other documents of a large component that meet its leaders in one task.
CHUNK = 400


def _settle(similarity: float):
    """(component_id, rid, leader) of one component: in order of doc_id, a document that is similar to an earlier leader goes, another becomes one."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("no_id", "ascending"), ("doc_id", "ascending"), ("rid", "ascending")])
        leaders, leads = [], []
        for sh in table["sh"]:
            mine = sh.values.to_numpy()
            leads.append(not any(_similar(mine, other, similarity) for other in leaders))
            if leads[-1]:
                leaders.append(mine)
        return table.select(["component_id", "rid"]).append_column("leader", pa.array(leads, pa.bool_()))

    return run


def _against_leaders(similarity: float):
    """(component_id, rid, close) of a chunk of a component that has its leaders among its rows."""

    def run(table: pa.Table) -> pa.Table:
        leads = table["leader"].to_pylist()
        sets = [x.values.to_numpy() for x in table["sh"]]
        leaders = [x for x, lead in zip(sets, leads) if lead]
        rest = [i for i, lead in enumerate(leads) if not lead]
        close = [any(_similar(sets[i], other, similarity) for other in leaders) for i in rest]
        return table.select(["component_id", "rid"]).take(pa.array(rest, pa.int64())).append_column("close", pa.array(close, pa.bool_()))

    return run


def _similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if not min(len(a), len(b)) >= similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The key of a row's document: rows alike in id and text share it, and rows without an id are told apart by their texts."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


#: Documents whose shingles say which are common, and how often one of these occurs among them.
SAMPLE, COMMON = 20_000, 4
#: At most so many common shingles are known to all tasks.
COMMON_SHINGLES = 1 << 17
#: Two similar documents share this many of their prefix shingles, or all that the shorter bound leaves.
SHARED = 3


def _common(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that are common in a sample of documents, ascending, and their counts. They only order the shingles: any
    counts give the same pairs."""

    def run(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.empty(0, np.int64)]))], names=["key"])

    n = max(1, rows.count())
    sample = rows.where(F.pmod(F.xxhash64("rid"), F.lit(n)) < SAMPLE).select("text").mapInArrow(run, "key long")
    counts = sample.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    found = counts.orderBy(F.desc("n"), "key").limit(COMMON_SHINGLES).toArrow()
    keys, counts = found["key"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def prefix(sh: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The rarest of a document's n distinct shingles, so many that two documents of the similarity share SHARED of these: they have
    at least similarity * n shingles in common, so all but n less that many can be left out, SHARED - 1 more taken in."""
    keys, counts = common
    both = int(np.ceil(similarity * len(sh) - 1e-9))
    rank = np.zeros(len(sh), np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, sh), len(keys) - 1)
        rank = np.where(keys[at] == sh, counts[at], 0)
    return sh[np.lexsort((sh, rank))[: len(sh) - both + min(SHARED, both)]]


def _alike(ws: Workspace, rows: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (u, v, ru, rv) of documents that have the similarity. Only documents in a pair are read for it."""
    wanted = ws.table(pairs.select(F.col("u").alias("rid")).union(pairs.select("v")).distinct(), "wanted")

    def shingled(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["rid", "sh"])

    def compare(batches):
        for b in batches:
            a, c = b.column(4), b.column(5)
            keep = [_similar(x.values.to_numpy(), y.values.to_numpy(), similarity) for x, y in zip(a, c)]
            yield pa.RecordBatch.from_arrays(b.columns[:4], names=b.schema.names[:4]).filter(pa.array(keep, pa.bool_()))

    sets = rows.join(fits(wanted, COPY_IDS), "rid", "left_semi").dropDuplicates(["rid"]).select("rid", "text").mapInArrow(shingled, "rid long, sh array<long>")
    sets = ws.table(sets, "sets")
    joined = pairs.join(sets.select(F.col("rid").alias("u"), F.col("sh").alias("su")), "u").join(sets.select(F.col("rid").alias("v"), F.col("sh").alias("sv")), "v")
    return ws.table(joined.select("u", "v", "ru", "rv", "su", "sv").mapInArrow(compare, "u long, v long, ru long, rv long"), "alike")


def _moved(df: DataFrame, top: DataFrame) -> DataFrame:
    """``df`` with each root that ``top`` (node, root) knows replaced."""
    return df.join(top.select(F.col("node").alias("root"), F.col("root").alias("_top")), "root", "left").withColumn("root", F.coalesce("_top", "root")).drop("_top")


def shared_components(ws: Workspace, rows: DataFrame, found: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``found`` (rid, component_id) with components joined so that all pairs of ``rows`` (rid, text) of the similarity are within one.

    Exact prefix filter: a pair of the similarity shares SHARED of its prefixes' shingles. Only pairs of different components matter: first every document meets the
    least one of each of its shingles; then, where a shingle still has several components, those outside its largest component meet all of other ones.
    """
    common = rows.sparkSession.sparkContext.broadcast(_common(rows, shingle))

    def run(batches):
        for b in batches:
            keys, rids, sizes = [np.empty(0, np.int64)], [], []
            for rid, t in zip(b.column(0).to_pylist(), b.column(1)):
                sh = np.unique(shingle_hashes(t.as_py(), shingle))
                mine = prefix(sh, common.value, similarity)
                keys.append(mine.view(np.int64)), rids.append(np.full(len(mine), rid, np.int64)), sizes.append(np.full(len(mine), len(sh), np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate([*rids, np.empty(0, np.int64)])), pa.array(np.concatenate([*sizes, np.empty(0, np.int32)]))], names=["key", "rid", "n"])

    keyed = ws.table(rows.select("rid", "text").mapInArrow(run, "key long, rid long, n int"), "prefixes")
    again = ws.table(keyed.groupBy("key").agg(F.min("rid").alias("low"), F.max("rid").alias("high")).where("low < high").select("key"), "again")
    named = keyed.join(fits(again, COPY_IDS), "key").distinct().join(found, "rid").select("key", "rid", "n", F.col("component_id").alias("root"))
    named = ws.table(named, "named")
    ws.drop(keyed)
    sized = (F.col("nu") >= F.col("nv") * F.lit(similarity) - F.lit(1e-6)) & (F.col("nv") >= F.col("nu") * F.lit(similarity) - F.lit(1e-6))
    least = named.groupBy("key").agg(F.min(F.struct("n", "rid", "root")).alias("low"), F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key", "low")
    least = ws.table(least, "least")
    stars = named.join(least, "key").select(F.col("rid").alias("u"), F.col("low.rid").alias("v"), F.col("root").alias("ru"), F.col("low.root").alias("rv"), F.col("n").alias("nu"), F.col("low.n").alias("nv"))
    stars = ws.table(stars.where((F.col("ru") != F.col("rv")) & sized).select("u", "v", "ru", "rv").distinct(), "stars")
    first = _alike(ws, rows, stars, shingle, similarity)
    top = ws.table(connected_components(ws, first.select(F.col("ru").alias("u"), F.col("rv").alias("v"))), "joined")
    named = ws.table(_moved(named.join(least.select("key"), "key", "left_semi"), top), "renamed")
    per = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    main = per.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    mixed = ws.table(named.join(ws.table(main.select("key", "main"), "mixed"), "key"), "several")
    a = mixed.where("root <> main").select("key", F.col("rid").alias("u"), F.col("n").alias("nu"), F.col("root").alias("ru"))
    b = mixed.select("key", F.col("rid").alias("v"), F.col("n").alias("nv"), F.col("root").alias("rv"), "main")
    pairs = a.join(b, (a.key == b.key) & (F.col("ru") != F.col("rv")) & ((F.col("rv") == F.col("main")) | (F.col("u") > F.col("v"))) & sized)
    pairs = pairs.select(F.greatest("u", "v").alias("p"), F.least("u", "v").alias("q"), F.when(F.col("u") > F.col("v"), F.col("ru")).otherwise(F.col("rv")).alias("ru"), F.when(F.col("u") > F.col("v"), F.col("rv")).otherwise(F.col("ru")).alias("rv"), F.least("nu", "nv").alias("n"))
    counted = pairs.groupBy(F.col("p").alias("u"), F.col("q").alias("v"), "ru", "rv", "n").agg(F.count(F.lit(1)).alias("c"))
    enough = F.col("c") >= F.least(F.lit(SHARED), F.ceil(F.col("n") * F.lit(similarity) - F.lit(1e-9)))
    rest = _alike(ws, rows, ws.table(counted.where(enough).select("u", "v", "ru", "rv"), "rest"), shingle, similarity)
    more = ws.table(connected_components(ws, rest.select(F.col("ru").alias("u"), F.col("rv").alias("v"))), "more")
    found = _moved(_moved(found.withColumnRenamed("component_id", "root"), top), more)
    return ws.table(found.select("rid", F.col("root").alias("component_id")), "components")


def near_copies(docs: DataFrame, distance: int = 7, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rid) of the documents that a kept one stands for: equal in text, or of a shingle similarity (Jaccard) of at least ``similarity``.

    Candidates are components of word fingerprints within ``distance`` bits, joined further by every pair of the similarity that two of
    them hold (``shared_components``): all similar documents are in one component. In each the document of least doc_id leads; those similar
    to it go, and the rest has a leader of its own, until none is left: no two kept documents of a component are
    similar. Small components are settled in a task each; of a large one the SETTLED least are, and its other documents meet these leaders in chunks over
    many tasks, again until few are left: no task ever holds a whole large component. Null texts and texts without words equal one another.
    A document is known by its ``row_key`` (rid): rows alike in id and text are one document, rows of one id and different texts are several. Documents without an id come after all others.
    """
    ws = Workspace(docs.sparkSession, "copies")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(row_key(id_col, text_col).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    found = ws.table(near_duplicates(rows, None, distance, "rid").select(F.col("doc_id").alias("rid"), "component_id").distinct(), "found")
    found = shared_components(ws, rows, found, shingle, similarity)
    crowded = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id")
    found = ws.table(found.join(ws.table(crowded, "crowded"), "component_id").select("rid", "component_id"), "members")
    held = rows.join(fits(found, COPY_IDS), "rid")

    def shingled(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["component_id", "rid", "doc_id", "same", "sh"])

    members = held.select("component_id", "rid", "doc_id", "text").mapInArrow(shingled, "component_id long, rid long, doc_id long, same long, sh array<long>")
    members = ws.table(members.withColumn("no_id", F.col("doc_id").isNull()), "shingles")
    place = ("no_id", "doc_id", "rid")
    first = ws.table(members.groupBy("component_id", "same").agg(F.min(F.struct(*place)).alias("least")), "firsts")
    placed = members.join(first, ["component_id", "same"])
    gone = [ws.table(placed.where("rid <> least.rid").select("rid"), "equal")]
    left = ws.table(placed.where("rid = least.rid").select("component_id", *place, "sh").dropDuplicates(["component_id", "rid"]), "different")
    settled = "component_id long, rid long, leader boolean"
    while True:
        sizes = ws.table(left.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
        small = left.join(sizes.where(F.col("n") <= SETTLED).select("component_id"), "component_id", "left_semi")
        done = ws.table(small.groupBy("component_id").applyInArrow(_settle(similarity), settled), "settled")
        gone.append(done.where("not leader").select("rid"))
        large = ws.table(sizes.where(F.col("n") > SETTLED).select("component_id", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "large")
        if large.isEmpty():
            break
        order = Window.partitionBy("component_id").orderBy(*place)
        part = left.join(large, "component_id")
        head = ws.table(part.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SETTLED).drop("nth"), "head")
        heads = ws.table(head.groupBy("component_id").applyInArrow(_settle(similarity), settled), "leaders")
        gone.append(heads.where("not leader").select("rid"))
        leaders = head.join(heads.where("leader"), ["component_id", "rid"])
        leaders = leaders.select("component_id", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), *place, "leader", "sh")
        rest = part.join(heads, ["component_id", "rid"], "left_anti")
        rest = ws.table(rest.select("component_id", F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int").alias("chunk"), *place, F.lit(False).alias("leader"), "sh"), "rest")
        compared = rest.unionByName(leaders).groupBy("component_id", "chunk").applyInArrow(_against_leaders(similarity), "component_id long, rid long, close boolean")
        compared = ws.table(compared, "compared")
        gone.append(compared.where("close").select("rid"))
        left = ws.table(rest.join(compared.where("not close"), ["component_id", "rid"]).select("component_id", *place, "sh"), "left")
    out = gone[0]
    for g in gone[1:]:
        out = out.unionByName(g)
    return members.select("rid", "doc_id").distinct().join(out.distinct(), "rid").select("doc_id", "rid")


#: At most so many document ids go out as a broadcast.
COPY_IDS = 500_000
