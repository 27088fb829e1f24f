"""Toxicity: a linear-chain CRF tags toxic words; forward-backward marginals give spans and document scores.

Labels are of documents, so word labels are derived first: a word of a toxic training document is toxic if its text or
a prefix of it occurs almost only in toxic documents. The CRF (states clean, toxic; features of the word and
transitions) is fitted to those words, and a logistic map of a document's marginals to its label.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, kept_by_worker

#: Training documents of each label, at most; the share of each label over all usable labels weighs them.
TRAIN_DOCS = 1500
#: Longer texts are not learned from.
TRAIN_CHARS = 32_768
#: A feature marks toxic words if it is in at least MARK_DOCS sampled documents and this share of them is toxic.
MARK_DOCS, MARK_SHARE = 8, 0.93
ROUNDS, RATE, DECAY = 60, 0.5, 1e-4
LANES = 1024
#: Words of the training texts that are worked on at once, about.
PART = 150_000
CALIBRATE = 3
WORD = re.compile(r"\w+")


def features(word: str) -> list[str]:
    return [f"={word}", *(f"^{word[:n]}" for n in (3, 4, 5, 6) if len(word) > n), *([f"${word[-3:]}"] if len(word) > 3 else [])]


def _scan(e: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward vectors (n, 2), each scaled, of one chain that restarts where ``first`` is set.

    The chain is cut into lanes; products of the 2 x 2 step matrices carry the state over the lanes. A restart is a matrix with equal
    rows, which forgets what came before, so the result is exact for each document."""
    n = len(e)
    steps = -(-n // min(LANES, n))
    lanes = -(-n // steps)
    m = np.empty((lanes * steps, 2, 2))
    m[n:] = np.eye(2)
    head = m[:n]
    head[:, :, 0] = np.where(first[:, None], start[0], trans[:, 0])
    head[:, :, 1] = np.where(first[:, None], start[1], trans[:, 1])
    head[:, :, 1] += e[:, None]
    head -= head.max(axis=(1, 2), keepdims=True)
    np.exp(head, out=head)
    m = np.ascontiguousarray(m.reshape(lanes, steps, 2, 2).transpose(1, 2, 3, 0))  # [step, from, to, lane]

    def product(a, b):
        out = a[:, 0, None] * b[None, 0] + a[:, 1, None] * b[None, 1]
        return out / out.max(axis=(0, 1))

    whole = m[0]
    for t in range(1, steps):
        whole = product(whole, m[t])
    into, back = np.empty((2, lanes)), np.empty((2, lanes))
    v = np.array([1.0, 1.0])
    for k in range(lanes):
        into[:, k] = v
        v = v @ whole[:, :, k]
        v /= v.sum()
    v = np.array([1.0, 1.0])
    for k in reversed(range(lanes)):
        back[:, k] = v
        v = whole[:, :, k] @ v
        v /= v.sum()
    fore, aft = np.empty((steps, 2, lanes)), np.empty((steps, 2, lanes))
    for t in range(steps):
        into = into[0] * m[t, 0] + into[1] * m[t, 1]
        into = into / into.sum(axis=0)
        fore[t] = into
    for t in reversed(range(steps)):
        aft[t] = back
        back = m[t, :, 0] * back[0] + m[t, :, 1] * back[1]
        back = back / back.sum(axis=0)
    flat = lambda x: x.transpose(2, 0, 1).reshape(-1, 2)[:n]
    return flat(fore), flat(aft)


def marginals(e: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Probability of the toxic state of each word."""
    if not len(e):
        return np.empty(0)
    fore, aft = _scan(e, first, trans, start)
    p = fore * aft
    return p[:, 1] / p.sum(axis=1)


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -5.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    calibration: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.1, 0.0, 0.0]))

    def emission(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(word))

    def score(self, p: np.ndarray, docs: int, doc_of: np.ndarray) -> np.ndarray:
        return _sigmoid(summaries(p, docs, doc_of) @ self.calibration)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def summaries(p: np.ndarray, docs: int, doc_of: np.ndarray) -> np.ndarray:
    """(documents, 4): one, log-odds of the greatest marginal, log of one plus their sum, share of words."""
    most, total, n = np.full(docs, 1e-4), np.zeros(docs), np.zeros(docs)
    np.maximum.at(most, doc_of, p)
    np.add.at(total, doc_of, p)
    np.add.at(n, doc_of, 1)
    most = np.minimum(most, 1 - 1e-4)
    return np.stack([np.ones(docs), np.log(most / (1 - most)), np.log1p(total), total / np.maximum(n, 1)], axis=1)


def train(texts: list[str], labels: list[int], weight: dict[int, float]) -> Model:
    """Fit word tagger and document map. ``weight`` of a label: its documents in the corpus per sampled document.

    Every CALIBRATE-th document serves the map alone, as the tagger is surer of words that it was fitted to."""
    fitted = [i for i in range(len(texts)) if i % CALIBRATE]
    model = _tagger([texts[i] for i in fitted], [labels[i] for i in fitted])
    rest = [i for i in range(len(texts)) if not i % CALIBRATE]
    if model.weights and len({labels[i] for i in rest}) == 2:
        words = [WORD.findall(texts[i]) for i in rest]
        doc_of = np.repeat(np.arange(len(rest)), list(map(len, words)))
        if len(doc_of):
            e = np.array([model.emission(w.lower()) for ws in words for w in ws])
            p = marginals(e, np.append(True, doc_of[1:] != doc_of[:-1]), model.trans, model.start)
            y = np.array([labels[i] for i in rest])
            model.calibration = _logistic(summaries(p, len(rest), doc_of), y, np.array([weight[labels[i]] for i in rest]))
    return model


def _tagger(texts: list[str], labels: list[int]) -> Model:
    """The CRF of words, without a document map of its own."""
    model = Model()
    if not texts or len(set(labels)) < 2:
        return model
    vocab: dict[str, int] = {}
    ids, doc_of = [], []
    for d, text in enumerate(texts):
        words = [w.lower() for w in WORD.findall(text)]
        ids += [vocab.setdefault(w, len(vocab)) for w in words]
        doc_of += [d] * len(words)
    ids, doc_of = np.array(ids, np.int64), np.array(doc_of, np.int64)
    if not len(ids):
        return model
    y = np.array(labels)
    names: dict[str, int] = {}
    owned = [[names.setdefault(f, len(names)) for f in features(w)] for w in vocab]
    width = max(map(len, owned))
    table = np.array([o + [-1] * (width - len(o)) for o in owned])  # -1: none
    first = np.append(True, doc_of[1:] != doc_of[:-1])
    starts = np.flatnonzero(first)
    cuts = [0, *(int(c) for c in starts[np.flatnonzero(np.diff(starts // PART)) + 1]), len(ids)]  # parts of whole documents bound the memory
    parts = [slice(a, b) for a, b in zip(cuts, cuts[1:])]
    seen, toxic = np.zeros(len(names)), np.zeros(len(names))
    for part in parts:
        in_doc = np.unique(doc_of[part] * len(vocab) + ids[part])  # the distinct words of each document, then their distinct features
        pairs = np.unique(np.repeat(in_doc // len(vocab) * (len(names) + 1), width) + table[in_doc % len(vocab)].reshape(-1) + 1)
        doc, feature = pairs // (len(names) + 1), pairs % (len(names) + 1) - 1
        seen += np.bincount(feature[feature >= 0], minlength=len(names))
        toxic += np.bincount(feature[feature >= 0], weights=y[doc[feature >= 0]], minlength=len(names))
    marks = (seen >= MARK_DOCS) & ((toxic + 0.5) / (seen + 1) >= MARK_SHARE)
    used = seen >= 3
    marked = (np.append(marks, False)[table]).any(axis=1)
    target = (marked[ids] & (y[doc_of] == 1)).astype(float)
    w, bias, trans, start = np.zeros(len(names) + 1), -3.0, np.zeros((2, 2)), np.zeros(2)
    sums = [np.full_like(w, 1e-6), 1e-6, np.full((2, 2), 1e-6), np.full(2, 1e-6)]
    truth = np.zeros((2, 2))
    np.add.at(truth, (target[:-1][~first[1:]].astype(int), target[1:][~first[1:]].astype(int)), 1)
    begins = np.bincount(target[first].astype(int), minlength=2)
    live = np.append(used, False)
    for _ in range(ROUNDS):
        by_word = bias + np.where(live[table], w[table], 0).sum(axis=1)
        p, both = np.empty(len(ids)), np.zeros((2, 2))
        for part in parts:
            e = by_word[ids[part]]
            fore, aft = _scan(e, first[part], trans, start)
            p[part] = fore[:, 1] * aft[:, 1] / (fore * aft).sum(axis=1)
            weight = [np.ones(len(e) - 1), np.exp(np.clip(e[1:], -40, 40))]
            cells = [[fore[:-1, i] * np.exp(trans[i, j]) * weight[j] * aft[1:, j] for j in (0, 1)] for i in (0, 1)]
            inner = ~first[part][1:]
            each = 1 / (cells[0][0] + cells[0][1] + cells[1][0] + cells[1][1])[inner]
            both += np.array([[cells[i][j][inner] @ each for j in (0, 1)] for i in (0, 1)])
        g_word = np.bincount(ids, weights=target - p, minlength=len(vocab))
        grads = [np.zeros_like(w), (target - p).sum(), truth - both, begins - np.array([(1 - p)[first].sum(), p[first].sum()])]
        grads[0] = np.bincount(np.where(table < 0, len(names), table).reshape(-1), weights=np.repeat(g_word, width), minlength=len(w)) - DECAY * len(texts) * w
        sums = [s + g * g for s, g in zip(sums, grads)]
        w += RATE * grads[0] / np.sqrt(sums[0])
        bias += RATE * grads[1] / np.sqrt(sums[1])
        trans += RATE * grads[2] / np.sqrt(sums[2])
        start += RATE * grads[3] / np.sqrt(sums[3])
    model.weights = {f: float(w[i]) for f, i in names.items() if used[i] and abs(w[i]) >= 0.02}
    model.bias, model.trans, model.start = float(bias), trans, start
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton's method."""
    b, weight = np.zeros(x.shape[1]), weight / weight.mean()
    for _ in range(30):
        p = _sigmoid(x @ b)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.3 * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def held_out(doc_id) -> F.Column:
    """Documents that no model learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on at most ``train_docs`` documents of each label that are not held out, the ones of least hash of their id;
    whole texts, on the driver. Of those, texts of over TRAIN_CHARS characters are left out, so that at most 2 * train_docs * TRAIN_CHARS characters reach the driver;
    a repeated doc_id gives its least text. The counts that weigh the labels cover all usable rows. Without labels of both kinds, or without documents, the model
    calls nothing toxic."""
    usable = labels.where(~held_out(id_col) & F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    picks = [usable.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs) for v in (0, 1)]
    picked = docs.sparkSession.createDataFrame(picks[0].unionByName(picks[1]).collect(), "doc_id long, toxic int")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(F.char_length("text") <= TRAIN_CHARS)
    rows = rows.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: r.doc_id)
    y = [r.toxic for r in rows]
    model = train([r.text for r in rows], y, {v: share[v] / max(1, y.count(v)) for v in set(y)})
    del rows
    give_back()
    return model


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, spans): spans are (first, last, p) of words with p >= 0.5, in characters, last excluded.

    A text alone decides its score, whole, however long; null and empty texts have no words and get the score of no evidence. A row for each row; other
    columns, whatever their names, are not read; an empty table gives no rows. The model is a
    broadcast whose size the training bound limits. Nothing is shuffled."""
    shipped, own = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches):
        tag = kept_by_worker(("tagger", own), lambda: Tagger(shipped.value))
        for b in batches:
            for part, texts in _bounded(b, 1):
                score, p, ends = tag(texts)
                spans = []
                for d, text in enumerate(texts):
                    mine = p[ends[d] : ends[d + 1]]
                    hit = set(np.flatnonzero(mine >= 0.5).tolist())
                    spans.append([{"first": w.start(), "last": w.end(), "p": float(mine[k])} for k, w in enumerate(WORD.finditer(text)) if k in hit] if hit else [])
                kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("p", pa.float64())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, kind)],
                    names=["doc_id", "score", "predicted", "spans"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, spans array<struct<first int, last int, p double>>")


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below 0.5."""
    shipped, own = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    at = docs.columns.index(text_col)

    def run(batches):
        tag = kept_by_worker(("tagger", own), lambda: Tagger(shipped.value))
        for b in batches:
            for part, texts in _bounded(b, at):
                yield part.filter(pa.array(tag(texts)[0] < 0.5))

    return docs.mapInArrow(run, docs.schema)


#: Characters of the texts that are tagged at once, about.
CHUNK = 500_000


def _bounded(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch and their texts, of about CHUNK characters each; only those of one slice are held."""
    texts: list[str] = []
    size = 0
    for i, t in enumerate(batch.column(at)):
        texts.append(t.as_py() or "")
        size += len(texts[-1])
        if size > CHUNK or i == batch.num_rows - 1:
            yield batch.slice(i + 1 - len(texts), len(texts)), texts
            texts, size = [], 0


class Tagger:
    """Scores texts with a model; remembers the emissions of up to a quarter of a million words."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def look(self, word: str) -> float:
        if (got := self.known.get(word)) is None:
            if len(self.known) > 250_000:
                self.known.clear()
            self.known[word] = got = self.model.emission(word.lower())
        return got

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, marginals of all words, and where each text's words begin."""
        look, m = self.look, self.model
        words = [[look(w) for w in WORD.findall(t)] for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        e = np.array([x for w in words for x in w])
        doc_of = np.repeat(np.arange(len(texts)), sizes)
        first = np.append(True, doc_of[1:] != doc_of[:-1]) if len(e) else np.empty(0, bool)
        p = marginals(e, first, m.trans, m.start)
        return m.score(p, len(texts), doc_of), p, np.append(0, np.cumsum(sizes))
