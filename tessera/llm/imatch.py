"""I-Match fingerprints over randomised lexicon subsets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

#: The band: terms in this share of all documents. The lower end bounds the lexicon at any size of the corpus: a document's mean
#: number of terms, over this share, is the most terms that can reach it (8 bytes each go out).
BAND = (5e-5, 0.05)
#: Lexicon subsets: COPIES independent orders of the terms; subset s of an order holds a term with probability 2 ** -s.
COPIES, SCALES = 12, 13
#: Distinct terms that one task counts before it sends its counts on.
COUNTED = 1_000_000
#: Hexadecimal digits of a subset's hash.
DIGITS = 6
#: ASCII letters in lower case, digits and bytes above 127 are parts of terms (fixed rule); the rest separates.
TERM_BYTES = bytes((c + 32 if 65 <= c <= 90 else c) if chr(c).isascii() and chr(c).isalnum() or c > 127 else 32 for c in range(256))


def terms_of(text: str) -> set[bytes]:
    return set(text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split())


class Hasher:
    """XXH64 of terms, remembered for the common ones."""

    def __init__(self, limit: int = 400_000) -> None:
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def __call__(self, terms: list[bytes]) -> np.ndarray:
        known = self.known
        out = list(map(known.get, terms))
        if None in out:
            for i, t in enumerate(terms):
                if out[i] is None:
                    if len(known) >= self.limit:
                        known.clear()
                    known[t] = out[i] = xxhash.xxh64_intdigest(t, 7)
        return np.array(out, np.uint64)


def lexicon(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Hashes of the terms in the band, ascending. Documents are counted for each term over the whole corpus: tasks add up what they
    see, the counts meet by term, and only terms in the band, whose number BAND bounds, reach the driver."""

    def run(batches):
        hasher, held, size = Hasher(), [], 0

        def counts():
            h, n = np.unique(np.concatenate([np.empty(0, np.uint64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

        for b in batches:
            for t in b.column(0):
                if terms := terms_of(t.as_py() or ""):
                    held.append(hasher(list(terms)))
                    size += len(terms)
                if size > COUNTED:
                    yield counts()
                    held, size = [], 0
        yield counts()

    n = docs.count()
    low, high = BAND[0] * n, max(BAND[1] * n, 2)
    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "term long, n long")
    kept = rows.groupBy("term").agg(F.sum("n").alias("n")).where((F.col("n") >= low) & (F.col("n") <= high)).select("term").toArrow()
    return np.sort(kept["term"].to_numpy().view(np.uint64))


_SEEDS = np.array([xxhash.xxh64_intdigest(b"order", i) | 1 for i in range(COPIES)], np.uint64)


#: Leading zeros of SCALES - 1 bits.
_LEADING = np.array([SCALES - 1 - i.bit_length() for i in range(1 << (SCALES - 1))], np.int8)


#: Subsets of an order, densest first, as a column.
_STEPS = np.arange(1, SCALES, dtype=np.int8)[:, None]


def _ranks(h: np.ndarray) -> np.ndarray:
    """(COPIES, terms): the sparsest subset of each order that holds the term; SCALES - 1 at most."""
    with np.errstate(over="ignore"):
        x = (h[None, :] ^ (h[None, :] >> np.uint64(29))) * _SEEDS[:, None]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return _LEADING[(x >> np.uint64(64 - SCALES + 1)).astype(np.int64)]


def fingerprint(text: str, lexicon: np.ndarray, hasher: Hasher) -> str:
    """The hash of all the text's terms in the lexicon, and for each order the hashes (DIGITS hexadecimal digits each) of the terms that its
    subsets leave, densest subset first, as far as they leave any; joined by blanks, an order without terms being ``-``.

    Terms are distinct and sorted (by their hashes) before they are hashed. If the lexicon has none of the text's terms, all its
    terms stand in, and for a text without terms the text itself."""
    terms = list(terms_of(text))
    if not terms:
        return "text-" + hashlib.sha1(text.encode("utf-8", "surrogatepass")).hexdigest()[:16]
    h = np.sort(hasher(terms))
    if len(lexicon):
        known = lexicon[np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)] == h
        if known.any():
            h = h[known]
    digest = xxhash.xxh64_hexdigest
    out = [digest(h.tobytes())]
    ranks = _ranks(h)
    for rank, top in zip(ranks, ranks.max(1).tolist()):
        out.append("".join([digest(h[left])[:DIGITS] for left in rank >= _STEPS[:top]]) or "-")
    return " ".join(out)


def likeness(a: str, b: str) -> float:
    """The share of orders with a subset that leaves both texts the same terms; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = a.split()[1:], b.split()[1:]
    if not x or not y:
        return 0.0
    same = 0
    for p, q in zip(x, y):
        n = min(len(p), len(q))  # equal at one subset, equal at each sparser one: the last that both have decides
        same += n >= DIGITS and p[n - DIGITS : n] == q[n - DIGITS : n]
    return same / COPIES


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of each text, a row for each row. Null counts as empty, and empty texts are equal texts; texts are fingerprinted
    whole, however long. Other columns, whatever their names, are not read; an empty table gives no rows."""
    known = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text_col))

    def run(batches):
        hasher = Hasher()
        for b in batches:
            prints = [fingerprint(t or "", known.value, hasher) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, tail, doc_id, text) dealt by ranges of doc_id and sorted in each: after a part's own rows comes, as its tail, the first row of the next
    part (of the first part, after the last). Ranges follow approximate quantiles of doc_id; what reaches the driver is one number a part."""
    parts = shuffle_partitions(docs.sparkSession)
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    lowest = -(2**63)
    ids = ids.select(F.coalesce("doc_id", F.lit(lowest)).alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("q")).first().q or []
    cuts = np.unique(np.array(cuts, np.int64))
    firsts = ids.mapInArrow(_first_of_part(cuts), "part int, doc_id long").groupBy("part").agg(F.min("doc_id").alias("doc_id")).collect()
    firsts = sorted((r.part, r.doc_id) for r in firsts)
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}  # each part's first row is the tail of the part before

    def route(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                rows = b.slice(at, 1000)
                doc = rows.column(0).fill_null(lowest).to_numpy(zero_copy_only=False)
                part = np.searchsorted(cuts, doc, side="right")
                tails = np.array([i for i, d in enumerate(doc.tolist()) if d in before], np.int64)
                take = np.append(np.arange(len(doc)), tails)
                to = np.append(part, [before[d] for d in doc[tails].tolist()]).astype(np.int32)
                is_tail = np.append(np.zeros(len(doc), bool), np.ones(len(tails), bool))
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(is_tail), rows.column(0).take(pa.array(take)), rows.column(1).take(pa.array(take))], names=["part", "tail", "doc_id", "text"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    routed = rows.mapInArrow(route, "part int, tail boolean, doc_id long, text string")
    return routed.repartitionById(max(1, len(cuts) + 1), F.col("part")).sortWithinPartitions("part", "tail", "doc_id", "text")


def _first_of_part(cuts):
    def run(batches):
        least: dict[int, int] = {}
        for b in batches:
            doc = b.column(0).to_numpy(zero_copy_only=False)
            part = np.searchsorted(cuts, doc, side="right")
            for p in np.unique(part).tolist():
                low = int(doc[part == p].min())
                least[p] = min(low, least.get(p, low))
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int32()), pa.array(list(least.values()), pa.int64())], names=["part", "doc_id"])

    return run


def edited(text: str, following: str) -> str:
    """The last quarter of the characters replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The next document is the one of next greater doc_id (rows of one doc_id by their text; a null id comes first), after the last the first. Null
    texts are empty. Whole texts, however long, move once, by range of doc_id; each task streams its range and holds two texts. Rows that repeat are
    each other's next; other columns, whatever their names, are not read; an empty table gives no rows."""
    known = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text_col))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        hasher, part, held = Hasher(), None, None

        def compared(own, text, mark, after, next_mark):
            new = edited(text, after)
            new_mark = mark if new == text else fingerprint(new, known.value, hasher)
            sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
            return own, len(text), sha, mark, new_mark, likeness(mark, new_mark), likeness(mark, next_mark)

        for b in batches:
            out = []
            for p, tail, doc, text in zip(*(b.column(i) for i in range(4))):
                p, tail, text = p.as_py(), tail.as_py(), text.as_py() or ""
                mark = fingerprint(text, known.value, hasher)
                if held is not None and p == part:
                    out.append(compared(*held, text, mark))
                held = None if tail else (doc.as_py(), text, mark)
                part = p
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 7, kinds)], names=names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs, id_col, text_col).mapInArrow(run, schema)
