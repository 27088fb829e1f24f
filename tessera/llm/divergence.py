"""Source divergence audit: how the words of each source of a language differ from those of its other sources and of the whole language.

Each kept term becomes one wide row, an array of its counts by source, and higher-order functions its shares. Tasks
add up the terms' contributions to every pair of sources by blocks of rows before anything is shuffled."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, fits

#: Terms are runs of the letters A-Z and a-z and of all that is not ASCII. Other bytes separate, capitals A-Z become small.
_FOLD = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

#: A task hands on its counts when it holds so many (group, term) pairs.
HELD = 1_000_000

#: A term is kept in a language if at least so many of its documents have it.
LEAST_DOCS = 3

#: The terms of a group that ``terms`` ranks.
TOP = 200


#: Shares that are added up at once, about: they stay in the processor's cache.
BLOCK = 16_384
_MOST = (1 << 63) - 1


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents, added up within a task; ``docs`` has lang, source and text."""

    def run(batches):
        held: dict[tuple, dict[bytes, int]] = {}
        size = 0

        def counts():
            lang, source, term, n = [], [], [], []
            for (a, b), found in held.items():
                lang += [a] * len(found)
                source += [b] * len(found)
                term += found
                n += found.values()
            packed = pa.array(n, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()), packed], names=["lang", "source", "term", "packed"])

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                group = held.setdefault((lang, source), {})
                before = len(group)
                for term, n in Counter(terms_of(text.as_py())).items():
                    group[term] = group.get(term, 0) + (n << 31 | 1)  # occurrences above, documents below
                size += len(group) - before
                if size > HELD:
                    yield counts()
                    held, size = {}, 0
        if size:
            yield counts()

    rows = docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(run, "lang string, source string, term binary, packed long")
    return rows.select("lang", "source", F.col("term").cast("string").alias("term"), F.shiftright("packed", 31).alias("n"), F.expr("packed & 2147483647").alias("d"))


def _share(a: str, of: str) -> str:
    """1 + floor(1e9 * a / of), three digits at a time: no step leaves the long integers while ``of`` is below 9e15."""
    one, two = f"(({a}) * 1000 % ({of}))", f"((({a}) * 1000 % ({of})) * 1000 % ({of}))"
    return f"1 + (({a}) * 1000 div ({of})) * 1000000 + ({one} * 1000 div ({of})) * 1000 + ({two} * 1000 div ({of}))"


def _block_sums(p: np.ndarray) -> np.ndarray:
    """Of shares (terms, sources): for each two sources the sum over the terms of floor((p - q)^2 / q). A square is below 2^63, as no share is over 1e9 + 1."""
    out = np.empty((p.shape[1], p.shape[1]), np.int64)
    for j, q in enumerate(np.ascontiguousarray(p.T)):
        away = p - q[:, None]
        away *= away
        away //= q[:, None]
        for i in np.flatnonzero(away.max(0) > _MOST // len(p)):  # may leave the long integers
            if sum(away[:, i].tolist()) > _MOST:
                raise OverflowError("a sum over terms leaves the long integers")
        out[:, j] = away.sum(0)
    return out


def _pair_sums(batches) -> Iterator[pa.RecordBatch]:
    """(lang, i, j, f) of a task's (lang, p)."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            shares = batch.column(1).filter(pc.equal(langs.indices, k))
            p = shares.flatten().to_numpy().reshape(len(shares), -1)
            step = max(1, BLOCK // p.shape[1])
            for at in range(0, len(p), step):
                found = _block_sums(p[at : at + step])
                if lang in sums and (sums[lang] > _MOST - found).any():
                    raise OverflowError("a sum over terms leaves the long integers")
                sums[lang] = sums[lang] + found if lang in sums else found
    for lang, found in sums.items():
        n = len(found)
        for i in range(n):  # a source's row at a time
            columns = [pa.array([lang] * n, pa.string()), pa.array(np.full(n, i, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(found[i])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "i", "j", "f"])


class Audit:
    """Counts of one corpus, ready for ``pairs`` and ``terms``.

    Null texts, languages and sources count as empty ones; other columns, whatever their names, are not read. Every row is a document, repeated ones too.
    Counts go by (language, term), so that a hot source or language is spread over all its terms; a term's row has one number for each source of its language."""

    def __init__(self, docs: DataFrame, least_docs: int = LEAST_DOCS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> None:
        ws = Workspace(docs.sparkSession, "divergence")
        docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
        rows = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
        wide = rows.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("counts"))
        self.counts = ws.table(wide.where(F.col("d") >= least_docs).select("lang", "term", "counts"), "counts")
        sums = self.counts.select("lang", F.explode("counts").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
        kept = self.counts.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
        groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(kept, "lang", "left")
        groups = groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"))
        listed = groups.groupBy("lang", "v").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("g"))
        self.langs = ws.table(listed.selectExpr("lang", "v", "g.source AS sources", "transform(g.n, n -> n + v) AS over", "aggregate(g.n, v, (a, n) -> a + n) AS over_all"), "langs")
        # one row a language; its size follows the number of its sources, and is checked
        langs = fits(self.langs, 100_000, F.size("sources") * 40)
        filled = self.counts.join(langs, "lang").selectExpr("lang", "term", "sources", "over", "over_all", "transform(sources, s -> coalesce(counts[s], 0L)) AS n")
        self.shares = filled.selectExpr("lang", "term", "sources", "n", f"zip_with(n, over, (a, o) -> {_share('a + 1', 'o')}) AS p", f"{_share('aggregate(n, 0L, (a, x) -> a + x) + 1', 'over_all')} AS q")

    def pairs(self) -> DataFrame:
        """(lang, source, item, value): for each two different sources of a language the sum over its kept terms of floor((p - q)^2 / q).

        Tasks add up whole blocks of terms, so that they hand on one matrix a language and not a row for each term and pair."""
        sums = self.shares.select("lang", "p").mapInArrow(_pair_sums, "lang string, i int, j int, f long").groupBy("lang", "i", "j").agg(F.sum("f").alias("f"))
        sources = self.langs.selectExpr("lang", "sources", "posexplode(sources) AS (i, source)")
        both = sources.selectExpr("lang", "source", "i", "posexplode(sources) AS (j, item)").where("i <> j")
        return both.join(sums, ["lang", "i", "j"], "left").selectExpr("lang", "source", "item", "coalesce(f, 0L) AS value")

    def terms(self) -> DataFrame:
        """(lang, source, item, value): for each group the terms that it has and that are commoner in it than in its language."""
        own = "filter(transform(sources, (s, i) -> named_struct('source', s, 'n', n[i], 'p', p[i])), x -> x.n > 0 AND x.p > q)"
        rows = self.shares.selectExpr("lang", "term AS item", "q", f"explode({own}) AS x")
        return rows.selectExpr("lang", "x.source AS source", "item", "(x.p - q) * (x.p - q) div q AS value")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of parts ``pair``, all ranks, and ``term``, ranks to ``top``; greater values first, ties by the item's bytes.

    Tasks keep no more than their first ``top`` terms of a group before these meet to be ranked. All arithmetic is of whole numbers; a value past the long integers is an error. No rows of
    ``docs``: no rows. A language without kept terms has its pairs, at 0."""
    found = Audit(docs, least_docs)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(order).alias("rank")
    pairs = found.pairs().select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    terms = found.terms().select("lang", "source", F.lit("term").alias("part"), "item", "value", rank).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
