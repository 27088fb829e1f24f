"""Substring deduplication: word windows that occur more than once, found with suffix automata over shards of the corpus.

The reference is the corpus itself, so no automaton of it has a size bound and none is broadcast whole. Instead the corpus is cut
into contexts: runs of windows that share their least k-gram hash (minimiser). Equal windows have equal minimisers, so each
minimiser's contexts make up a shard that knows all occurrences of its windows. A bounded Bloom filter of repeated minimisers is broadcast; contexts that
pass it stream to their shard, whose suffix automaton, weighted by the copies of each context, gives matching statistics: at
each word the longest suffix that occurs twice. Spans of at least the window's length are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, fits, shuffle_partitions

#: Words of the k-gram whose least hash names a shard.
GRAM = 8
#: The filter's bits: 16 MB at any size of the corpus. A fuller filter lets more contexts through, and loses none.
FILTER_BITS = 1 << 27
#: Shards of more distinct contexts than this are counted window by window instead, spread over all tasks, so that no task holds a crowded shard.
SHARD_CONTEXTS = 256
#: At most so many rows go out as a broadcast, and of rows with lists of spans no more bytes than ``fits`` allows.
BROADCAST_ROWS = 500_000

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


class Powers:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.append(np.uint64(1), np.full(size - 1, _P, np.uint64)), dtype=np.uint64)
            self.down = np.cumprod(np.append(np.uint64(1), np.full(size - 1, _P_INV, np.uint64)), dtype=np.uint64)
        return self.up[:n], self.down[:n]


class Windows:
    """Rolling hashes of the windows of a word sequence, and their minimisers."""

    def __init__(self, window: int) -> None:
        if window <= GRAM:
            raise ValueError(f"a window has more than {GRAM} words")
        self.window, self.powers, self.known = window, Powers(), {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known, out = self.known, []
        for w in words:
            if (h := known.get(w)) is None:
                if len(known) >= 200_000:
                    known.clear()
                known[w] = h = xxhash.xxh64_intdigest(w, 11)
            out.append(h)
        return np.array(out, np.uint64)

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hash, minimiser) of each window."""
        n, w = len(words), self.window
        if n < w:
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        up, down = self.powers.reach(n)
        sums = np.append(np.uint64(0), np.cumsum(self.hashes(words) * up, dtype=np.uint64))
        whole = _mix((sums[w:] - sums[:-w]) * down[: n - w + 1])
        low = _mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
        span, left = 1, w - GRAM + 1
        while 2 * span <= left:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if left > span:
            low = np.minimum(low[: len(low) - (left - span)], low[left - span :])
        return whole, low

    def contexts(self, words: list[bytes]) -> list[tuple[int, int, int, bool]]:
        """(minimiser, first window, windows, whether a window repeats in this text) of each run of windows with one minimiser. Runs are cut
        to at most as many windows as a k-gram can be the least of."""
        whole, low = self.of(words)
        if not len(whole):
            return []
        longest = self.window - GRAM + 1
        starts = np.append(0, np.flatnonzero(low[1:] != low[:-1]) + 1)
        sizes = np.diff(np.append(starts, len(low)))
        if (sizes > longest).any():
            starts = np.concatenate([np.arange(a, a + n, longest) for a, n in zip(starts.tolist(), sizes.tolist())])
            sizes = np.diff(np.append(starts, len(low)))
        order = np.sort(whole)
        again = np.zeros(len(starts), bool)
        if (order[1:] == order[:-1]).any():
            _, back, count = np.unique(whole, return_inverse=True, return_counts=True)
            again = np.add.reduceat((count[back] > 1).astype(np.int64), starts) > 0
        return list(zip(low[starts].view(np.int64).tolist(), starts.tolist(), sizes.tolist(), again.tolist()))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class SuffixAutomaton:
    """Of a set of word sequences, each with a weight: how often every substring occurs."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.count = [-1], [0], [0]

    def _state(self, size: int, follows: dict[int, int], link: int) -> int:
        self.next.append(follows), self.link.append(link), self.size.append(size), self.count.append(0)
        return len(self.link) - 1

    def _fork(self, p: int, q: int, c: int) -> int:
        """A state of its own for the substrings of ``q`` that are no longer than those of ``p`` and one word."""
        fork = self._state(self.size[p] + 1, self.next[q].copy(), self.link[q])
        self.link[q] = fork
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = fork
            p = self.link[p]
        return fork

    def add(self, words: list[int], weight: int) -> None:
        last = 0
        follow, link, size = self.next, self.link, self.size
        for c in words:
            q = follow[last].get(c)
            if q is not None:
                last = q if size[q] == size[last] + 1 else self._fork(last, q, c)
            else:
                new = self._state(size[last] + 1, {}, 0)
                p = last
                while p != -1 and (q := follow[p].get(c)) is None:
                    follow[p][c] = new
                    p = link[p]
                if p != -1:
                    link[new] = q if size[q] == size[p] + 1 else self._fork(p, q, c)
                last = new
            self.count[last] += weight

    def settle(self) -> None:
        """Carry the counts from each substring to its suffixes; once, after all sequences."""
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            self.count[self.link[v]] += self.count[v]

    def repeated(self, words: list[int]) -> list[int]:
        """Matching statistics of a sequence: at each word, the length of the longest suffix that occurs at least twice."""
        v = matched = 0
        out = []
        for c in words:
            while v and c not in self.next[v]:
                v = self.link[v]
                matched = self.size[v]
            if c in self.next[v]:
                v, matched = self.next[v][c], matched + 1
            while v and self.count[v] < 2:
                v = self.link[v]
                matched = self.size[v]
            out.append(matched)
        return out


def spans(ends: np.ndarray, window: int) -> list[int]:
    """First and end of each maximal span that windows ending at the marked words cover, as a flat list."""
    at = np.flatnonzero(ends)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > window)
    first = at[np.append(0, cut + 1)] - window + 1
    end = at[np.append(cut, len(at) - 1)] + 1
    return np.stack([first, end], axis=1).reshape(-1).tolist()


def _shard(contexts: list[tuple[int, int, bytes]], window: int):
    """(context, spans) of one minimiser's contexts (hash, copies, words)."""
    if len(contexts) == 1 and contexts[0][1] > 1:
        return [(contexts[0][0], [0, len(contexts[0][2].split())])]
    ids: dict[bytes, int] = {}
    lists = [[ids.setdefault(w, len(ids)) for w in text.split()] for _, _, text in contexts]
    automaton = SuffixAutomaton()
    for words, (_, copies, _) in zip(lists, contexts):
        automaton.add(words, copies)
    automaton.settle()
    out = []
    for words, (cx, _, _) in zip(lists, contexts):
        if found := spans(np.array(automaton.repeated(words)) >= window, window):
            out.append((cx, found))
    return out


def _repeated_minimisers(rows: DataFrame, window: int) -> DataFrame:
    """(mh) that more than one window context has, or one context that repeats a window."""

    def run(batches):
        tool = Windows(window)
        for b in batches:
            mh, n = [], []
            for t in b.column(1):
                for m, _, _, again in tool.contexts((t.as_py() or "").encode("utf-8", "surrogatepass").split()):
                    mh.append(m), n.append(2 if again else 1)
            yield pa.RecordBatch.from_arrays([pa.array(mh, pa.int64()), pa.array(n, pa.int64())], names=["mh", "n"])

    return rows.mapInArrow(run, "mh long, n long").groupBy("mh").agg(F.sum("n").alias("n")).where("n > 1").select("mh")


def _filter_places(mh: np.ndarray) -> np.ndarray:
    x = mh.view(np.uint64)
    return np.stack([x >> np.uint64(37), (x * np.uint64(0x94D049BB133111EB)) >> np.uint64(37)]).astype(np.int64)


def _build_filter(repeated: DataFrame) -> np.ndarray:
    """The Bloom filter as 64-bit words; tasks send the words that they set, which are or-ed before FILTER_BITS / 64 of them at most reach the driver."""

    def run(batches):
        bits = np.zeros(FILTER_BITS // 64, np.uint64)
        for b in batches:
            places = _filter_places(b.column(0).to_numpy(zero_copy_only=False)).reshape(-1)
            np.bitwise_or.at(bits, places >> 6, np.uint64(1) << (places & 63).astype(np.uint64))
        at = np.flatnonzero(bits)
        for a in range(0, len(at), 100_000):
            part = at[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(bits[part].view(np.int64))], names=["at", "bits"])

    found = repeated.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


CONTEXT = "mh long, cx long, rid long, first int, copies int, words binary"


def _contexts(rows: DataFrame, bits, window: int) -> DataFrame:
    """Of each context that passes the filter, a row for where it stands (rid, first) and, once a task, one for its words and their copies in the task."""

    def run(batches):
        tool, passing = Windows(window), bits.value
        names = [x.split()[0] for x in CONTEXT.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        seen: dict[tuple[int, int], list] = {}
        held = 0

        def texts():
            cols = zip(*((m, c, None, None, n, text) for (m, c), (n, text) in seen.items()))
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(cols) or [()] * 6, kinds)], names=names)
            seen.clear()
            return batch

        for b in batches:
            out = []
            for rid, t in zip(b.column(0).to_pylist(), b.column(1)):
                words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                found = tool.contexts(words)
                if not found:
                    continue
                mh = np.array([f[0] for f in found], np.int64)
                places = _filter_places(mh)
                keep = ((passing[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)).all(axis=0)
                for (m, first, n, _), ok in zip(found, keep.tolist()):
                    if ok:
                        text = b" ".join(words[first : first + n + window - 1])
                        cx = xxhash.xxh3_64_intdigest(text) - (1 << 63)
                        out.append((m, cx, rid, first, None, None))
                        if (got := seen.get((m, cx))) is None:
                            seen[m, cx] = [1, text]
                            held += len(text)
                        else:
                            got[0] += 1
                if held > 16 << 20:  # the words of a task's contexts stay bounded; a context may then go out twice
                    yield texts()
                    held = 0
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 6, kinds)], names=names)
        yield texts()

    return rows.mapInArrow(run, CONTEXT)


FOUND = "mh long, cx long, spans array<int>"


def _groups(batches, key: int):
    """Rows of sorted batches by their key column: (key, rows) of each whole group."""
    last, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[key] != last and held:
                yield last, held
                held = []
            last = row[key]
            held.append(row)
    if held:
        yield last, held


def _found(rows) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.list_(pa.int32())])], names=["mh", "cx", "spans"])


def _by_automata(texts: DataFrame, window: int) -> DataFrame:
    def run(batches):
        out = []
        for mh, rows in _groups(batches, 0):
            merged: dict[int, list] = {}
            for _, cx, copies, words in rows:
                if cx in merged:
                    merged[cx][0] += copies
                else:
                    merged[cx] = [copies, words]
            out += [(mh, cx, s) for cx, s in _shard([(cx, n, w) for cx, (n, w) in merged.items()], window)]
            if len(out) > 5000:
                yield _found(out)
                out = []
        yield _found(out)

    n = shuffle_partitions(texts.sparkSession)
    return texts.select("mh", "cx", "copies", "words").repartition(n, "mh").sortWithinPartitions("mh", "cx").mapInArrow(run, FOUND)


def _by_windows(ws: Workspace, texts: DataFrame, window: int) -> DataFrame:
    """The same result for crowded shards: each window counts for itself, by a digest of 128 bits of its words, and the repeated ones go back to their
    contexts. Among 10 ** 13 windows the digests of two different ones are equal with a probability of less than one in 10 ** 12."""

    def explode(batches):
        digest = xxhash.xxh3_128_digest
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                cols = ([], [], [], [], [])
                for mh, cx, copies, text in zip(*(c.to_pylist() for c in part.columns)):
                    words = text.split()
                    n = len(words) - window + 1
                    for col, v in zip(cols, ([mh] * n, [cx] * n, [copies] * n, list(range(n)), [digest(b" ".join(words[i : i + window])) for i in range(n)])):
                        col += v
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()])], names=["mh", "cx", "copies", "at", "wh"])

    def gather(batches):
        for b in batches:
            rows = [(mh, cx, spans(np.bincount(at, minlength=max(at) + 1), window)) for mh, cx, at in zip(*(c.to_pylist() for c in b.columns))]
            yield _found(rows)

    texts = texts.groupBy("mh", "cx").agg(F.sum("copies").alias("copies"), F.min("words").alias("words"))
    seen = texts.mapInArrow(explode, "mh long, cx long, copies long, at int, wh binary")
    seen = ws.table(seen, "windows")
    again = ws.table(seen.groupBy("wh").agg(F.sum("copies").alias("n")).where("n > 1").select("wh"), "repeated-windows")
    hit = seen.join(again, "wh", "left_semi").groupBy("mh", "cx").agg(F.collect_set(F.col("at") + F.lit(window - 1)).alias("ends"))
    return hit.mapInArrow(gather, FOUND)


def repeated_spans(ws: Workspace, rows: DataFrame, window: int) -> DataFrame:
    """(rid, spans) of each row (rid, text) that has repeated windows: spans holds flat arrays of word positions."""
    spark = ws.spark
    bits = spark.sparkContext.broadcast(_build_filter(_repeated_minimisers(rows, window)))
    found = ws.table(_contexts(rows, bits, window), "contexts")
    texts, places = found.where(F.col("words").isNotNull()), found.where(F.col("words").isNull()).select("mh", "cx", "rid", "first")
    crowded = texts.groupBy("mh").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD_CONTEXTS).select("mh")
    crowded = ws.table(crowded, "crowded")
    few = fits(crowded, BROADCAST_ROWS)
    plain = _by_automata(texts.join(few, "mh", "left_anti"), window)
    spans_of = ws.table(plain.unionByName(_by_windows(ws, texts.join(few, "mh", "left_semi"), window)), "spans")
    back = places.join(fits(spans_of, BROADCAST_ROWS, _span_bytes()), ["mh", "cx"]).select("rid", F.transform("spans", lambda x: x + F.col("first")).alias("spans"))
    return ws.table(back.groupBy("rid").agg(F.flatten(F.collect_set("spans")).alias("spans")), "rows")


def _span_bytes() -> Column:
    return F.size("spans") * 4 + 32


def covered(n: int, flat: list[int] | None) -> np.ndarray:
    """Which of n words the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    if flat:
        np.add.at(edge, np.minimum(flat[::2], n), 1)
        np.add.at(edge, np.minimum(flat[1::2], n), -1)
    return np.cumsum(edge[:n]) > 0


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rid, n_words, n_removed, kept): kept holds the words that no repeated window covers, joined by blanks.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A window is repeated if its word sequence starts anywhere else in the input, the same document
    included; all its occurrences go. Null texts have no words, and texts of any length are taken whole. Other columns, whatever their names, are
    not read; an empty table gives no rows. Rows that repeat a doc_id are documents of their own,
    so equal rows of at least a window's length remove each other. rid is a hash of the row's id and text.
    """
    ws = Workspace(docs.sparkSession, "substring")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(F.col(id_col), text).alias("rid"), text.alias("text"))
    marks = repeated_spans(ws, rows, window)
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("rid"), text.alias("text"))

    def run(batches):
        for b in batches:
            out = []
            for doc, rid, t, flat in zip(*(b.column(i) for i in range(4))):
                words = t.as_py().encode("utf-8", "surrogatepass").split()
                gone = covered(len(words), flat.as_py())
                kept = words if not gone.any() else [w for w, g in zip(words, gone.tolist()) if not g]
                out.append((doc.as_py(), rid.as_py(), len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 5, kinds)], names=["doc_id", "rid", "n_words", "n_removed", "kept"])

    joined = whole.join(fits(marks, BROADCAST_ROWS, _span_bytes()), "rid", "left").select("doc_id", "rid", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, rid long, n_words long, n_removed long, kept string")


def strip_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns and rows, its text less the words that repeated windows cover. A text that loses nothing stays as it is,
    null included; another becomes its kept words joined by blanks."""
    ws = Workspace(docs.sparkSession, "substring")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marks = repeated_spans(ws, docs.select(F.xxhash64(F.col(id_col), text).alias("rid"), text.alias("text")), window)
    marks = fits(marks, BROADCAST_ROWS, _span_bytes()).select(F.col("rid").alias("_tessera_rid"), F.col("spans").alias("_tessera_spans"))
    joined = docs.withColumn("_tessera_rid", F.xxhash64(F.col(id_col), text)).join(marks, "_tessera_rid", "left").select(*docs.columns, "_tessera_spans")
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            for i, flat in enumerate(b.column(len(b.columns) - 1).to_pylist()):
                if flat:
                    words = texts[i].encode("utf-8", "surrogatepass").split()
                    gone = covered(len(words), flat).tolist()
                    texts[i] = b" ".join([w for w, g in zip(words, gone) if not g]).decode("utf-8", "surrogatepass")
            columns = list(b.columns[:-1])
            columns[at] = pa.array(texts, b.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)
