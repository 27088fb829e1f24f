"""A gated recurrent language model: counts of all training words, a small network trained on all training texts, whole texts scored.

The network sees HEAD words one by one and all others by a class of their ending. Its output is factored: the class, by the network;
within a class of head words the word, by the network too; within a class of other words the word's share of the class's
counts. Counts are a table and never broadcast whole: the COMMON words go out, of the rest the ones that a text has meet their counts in a join."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Words of the network's own vocabulary, in CLASSES classes of equal size by rank; further classes are of word endings.
HEAD, CLASSES, ENDINGS = 2048, 32, 32

#: Words whose counts go out to every task.
COMMON = 200_000

#: Units of the network; tokens of a window, over which errors are traced back; lanes that are trained at once.
UNITS, WINDOW, LANES = 16, 16, 512

#: Every training document is read in one of so many rounds. After each round the tasks' networks become one, their mean by tokens read.
ROUNDS, RATE = 3, 0.02

#: Bytes of text that a task encodes at once (a longer text is on its own), and different words that it holds.
CHUNK, HELD = 8_000_000, 400_000

END = b""


def words(text: bytes) -> list[bytes]:
    """Runs of anything but space and \\x09-\\x0D; only A-Z become small."""
    return text.lower().split()


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def held_out(doc_id: str) -> F.Column:
    """Documents that nothing is learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of all texts and one end (the empty word) for each; tasks add up what they see before it is shuffled."""

    def run(batches):
        held: Counter[bytes] = Counter()
        for b in batches:
            for t in b.column(0):
                held.update(words(t.as_py()))
                held[END] += 1
                if len(held) > HELD:
                    yield made(held)
                    held = Counter()
        if held:
            yield made(held)

    def made(held):
        return pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The common words, most frequent first, with their counts; N and V of all training tokens; for each ending the sum of n + 1 over its words outside the head, and one for words never seen."""

    common: list[bytes]
    counts: np.ndarray
    tokens: int
    distinct: int
    endings: np.ndarray

    @property
    def head(self) -> list[bytes]:
        return self.common[:HEAD]


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Of a table of counts. The end of texts is always one of the head."""
    total = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    top = counts.where(F.octet_length("word") > 0).orderBy(F.col("n").desc(), "word").limit(COMMON).toArrow()
    ends = counts.where(F.octet_length("word") == 0).agg(F.sum("n")).first()[0] or 0
    found = [(END, ends), *zip(top["word"].to_pylist(), top["n"].to_pylist())]
    head = {w for w, _ in found[:HEAD]}

    def run(batches):
        sums = np.zeros(ENDINGS, np.int64)
        for b in batches:
            for w, n in zip(*[b.column(i).to_pylist() for i in range(2)]):
                if w not in head:
                    sums[ending(w)] += n + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(ENDINGS)), pa.array(sums)], names=["ending", "n"])

    endings = np.ones(ENDINGS, np.int64)
    for r in counts.select("word", "n").mapInArrow(run, "ending long, n long").groupBy("ending").agg(F.sum("n").alias("n")).collect():
        endings[r.ending] += r.n
    return Vocabulary([w for w, _ in found], np.array([n for _, n in found], np.int64), int(total[0] or 0), int(total[1]), endings)


class Encoder(dict):
    """Words as places in two growing lists: the network's symbol (head words by rank, then endings), and log10(n + 1), which is nan for words that are not common."""

    def __init__(self, v: Vocabulary) -> None:
        super().__init__(zip(v.common, range(len(v.common))))
        self.fixed = len(v.common)
        self.common = v.common
        self.first = [i if i < HEAD else HEAD + ending(w) for i, w in enumerate(v.common)]
        self.logs = np.log10(v.counts + 1.0)
        self.seen = v.counts > 0
        self.symbols, self.others = list(self.first), []

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self.symbols)
        self.symbols.append(HEAD + ending(word))
        self.others.append(word)
        return at

    def trim(self) -> None:
        if len(self.others) > HELD:
            for w in self.others:
                del self[w]
            self.symbols, self.others = list(self.first), []


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, x)
    np.exp(x, x)
    x += 1
    return np.reciprocal(x, x)


#: Weighted sums are held within this range where weights are so large that they could leave it; it keeps exponentials finite without a look for each row's greatest.
STEEPEST = 60


def _steep(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Whether weighted sums could leave STEEPEST, for each table of weights: states are within 1."""
    return (np.abs(weights).sum(-2) + np.abs(bias)).max(-1) > STEEPEST


def _normal(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, steep: bool, rows: np.ndarray, chosen: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray]:
    """The log of the chosen outcome's share in each row; and, to ``learn``, that log's slopes."""
    x = h @ weights
    x += bias
    if steep:
        np.clip(x, -STEEPEST, STEEPEST, out=x)
    picked = x[rows, chosen].astype(np.float64)
    np.exp(x, x)
    sums = x @ np.ones(x.shape[1], x.dtype)
    if learn:
        x *= (-1 / sums)[:, None]
        x[rows, chosen] += 1
    return picked - np.log(sums), x


class Network:
    """Weights as one flat vector, with views: ``inputs`` (a row of 3 * UNITS for each symbol and the start of a text), ``recurrent``, ``classes``, ``words``, and biases.

    Biases begin as the logarithms of the counts, so that a network that has learnt nothing gives the shares of the counts."""

    SHAPES = {"inputs": (HEAD + ENDINGS + 1, 3 * UNITS), "recurrent": (UNITS, 3 * UNITS), "bias": (UNITS,), "classes": (UNITS, CLASSES + ENDINGS), "class_bias": (CLASSES + ENDINGS,), "words": (CLASSES, UNITS, HEAD // CLASSES), "word_bias": (CLASSES, HEAD // CLASSES)}
    START = HEAD + ENDINGS

    def __init__(self, flat: np.ndarray) -> None:
        self.flat, at = flat, 0
        for name, shape in self.SHAPES.items():
            n = math.prod(shape)
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def size(cls) -> int:
        return sum(map(math.prod, cls.SHAPES.values()))

    @classmethod
    def new(cls, v: Vocabulary) -> Network:
        net = cls(np.zeros(cls.size(), np.float32))
        rng = np.random.default_rng(13)
        net.inputs[:] = rng.normal(0, 0.3, net.inputs.shape)
        net.recurrent[:] = rng.normal(0, 0.5 / math.sqrt(UNITS), net.recurrent.shape)
        share = np.zeros(HEAD)
        share[: len(v.head)] = v.counts[:HEAD] + 1.0
        share = share.reshape(CLASSES, -1)
        with np.errstate(divide="ignore"):
            net.word_bias[:] = np.maximum(np.log(share), -30) - np.log(np.maximum(share.sum(1), 1e-9))[:, None]
            net.class_bias[:] = np.maximum(np.log(np.append(share.sum(1), v.endings)), -30) - np.log(share.sum() + v.endings.sum())
        return net

    def step(self, symbols: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """(new state, gates, candidate, its recurrent part)."""
        x, u = self.inputs[symbols], h @ self.recurrent
        gates = _sigmoid(x[:, : 2 * UNITS] + u[:, : 2 * UNITS])
        inner = u[:, 2 * UNITS :] + self.bias
        candidate = np.tanh(x[:, 2 * UNITS :] + gates[:, UNITS:] * inner)
        return candidate + gates[:, :UNITS] * (h - candidate), gates, candidate, inner

    def log_shares(self, h: np.ndarray, targets: np.ndarray, learn: Network | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log (base e) of each target symbol's class and, for head words, of the word in it. With ``learn``: adds its weights' gradients, and returns those of h, of the sum."""
        head = targets < HEAD
        of = np.where(head, targets // (HEAD // CLASSES), targets - HEAD + CLASSES).astype(np.uint8)
        rows = np.arange(len(h))
        out, slopes = _normal(h, self.classes, self.class_bias, _steep(self.classes, self.class_bias), rows, of, learn is not None)
        back = None
        if learn is not None:
            learn.classes += h.T @ slopes
            learn.class_bias += slopes.sum(0)
            back = slopes @ self.classes.T
        order = np.argsort(np.where(head, of, np.uint8(CLASSES)), kind="stable")[: np.count_nonzero(head)]  # of few bits, so that numpy sorts by digits
        ends = np.searchsorted(of[order], np.arange(CLASSES + 1, dtype=np.uint8))
        states, places = h[order], targets[order] % (HEAD // CLASSES)
        logs, more = np.empty(len(order)), np.empty_like(states)
        steep = _steep(self.words, self.word_bias)
        for c in range(CLASSES):
            at = slice(ends[c], ends[c + 1])
            if at.start < at.stop:
                mine = states[at]
                logs[at], slopes = _normal(mine, self.words[c], self.word_bias[c], steep[c], rows[: len(mine)], places[at], learn is not None)
                if learn is not None:
                    learn.words[c] += mine.T @ slopes
                    learn.word_bias[c] += slopes.sum(0)
                    np.matmul(slopes, self.words[c].T, out=more[at])
        out[order] += logs
        if learn is not None:
            back[order] += more
        return out, back


def _inputs(targets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What the network reads before each target: the token before it, or the start of a text."""
    out = np.empty_like(targets)
    out[1:] = targets[:-1]
    out[starts] = Network.START
    return out


def log_likelihoods(net: Network, targets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The log10 of each text's classes and head words; texts stand one after the other, each begins at one of ``starts``.

    Texts are lanes, longest first; a lane's state goes on from window to window to the end of its text."""
    sizes = np.diff(np.append(starts, len(targets)))
    lanes = np.argsort(-sizes, kind="stable")
    first, sizes = starts[lanes], sizes[lanes]
    given, out = _inputs(targets, starts), np.zeros(len(starts))
    h = np.zeros((len(lanes), UNITS), np.float32)
    lane, at, states, held = [], [], [], 0

    def flush():
        nonlocal held
        if held:
            got, _ = net.log_shares(np.concatenate(states), targets[np.concatenate(at)])
            np.add.at(out, lanes[np.concatenate(lane)], got)
        lane.clear(), at.clear(), states.clear()
        held = 0

    active, numbers = len(lanes), np.arange(len(lanes))
    for t in range(int(sizes[0]) if len(sizes) else 0):
        while sizes[active - 1] <= t:
            active -= 1
        place = first[:active] + t
        states.append(h[:active].copy())
        lane.append(numbers[:active])
        at.append(place)
        held += active
        h[:active] = net.step(given[place], h[:active])[0]
        if held > 32_768:
            flush()
    flush()
    return out / math.log(10)


class Trainer:
    """Adam on windows of lanes. All tokens of a chunk stand in one row that is cut into lanes of equal length; a state begins anew where a text does."""

    def __init__(self, net: Network) -> None:
        self.net, self.grads = net, Network(np.zeros_like(net.flat))
        self.m, self.v, self.n, self.tokens = np.zeros_like(net.flat), np.zeros_like(net.flat), 0, 0

    def chunk(self, targets: np.ndarray, starts: np.ndarray, rate: float) -> None:
        n = len(targets)
        lanes = max(1, min(LANES, n // (64 * WINDOW)))  # 64 windows at least, so that small corpora are learnt from too
        length = -(-n // lanes)
        given = _inputs(targets, starts)
        fresh = np.zeros(n, bool)
        fresh[starts] = True
        base = np.arange(lanes) * length
        h = np.zeros((lanes, UNITS), np.float32)
        for t in range(0, length, WINDOW):
            places = [base + s for s in range(t, min(t + WINDOW, length))]
            h = self.window(places, given, targets, fresh, h)
            self.update(rate)
        self.tokens += n

    def window(self, places: list[np.ndarray], given, targets, fresh, h):
        net, trace, outs = self.net, [], []
        for place in places:
            live = place < len(targets)  # the last lanes may be shorter
            place = np.minimum(place, len(targets) - 1)
            keep = (~fresh[place] & live).astype(np.float32)[:, None]
            before = h * keep
            h, gates, candidate, inner = net.step(given[place], before)
            trace.append((place, live, keep, before, gates, candidate, inner))
            outs.append(before)
        live = np.concatenate([x[1] for x in trace])
        at = np.concatenate([x[0] for x in trace])
        target = targets[at]
        states = np.concatenate(outs)
        self.count = int(live.sum())
        if self.count == len(live):
            back = net.log_shares(states, target, self.grads)[1]
        else:
            back = np.zeros_like(states)
            _, back[live] = net.log_shares(states[live], target[live], self.grads)
        back = back.reshape(len(places), -1, UNITS)
        self.through(trace, given[at].astype(np.uint16), states, back)  # of few bits, so that numpy sorts by digits
        return h

    def through(self, trace, symbols, states, back) -> None:
        """Errors back through the window, not beyond it."""
        net, g, u = self.net, self.grads, UNITS
        error = np.zeros_like(back[0])
        inners = np.empty((*back.shape[:2], 3 * u), np.result_type(back, net.flat))
        rows = np.empty_like(inners)
        for (_, _, keep, before, gates, candidate, inner), more, d_u, row in zip(reversed(trace), back[::-1], inners[::-1], rows[::-1]):
            z, r = gates[:, :u], gates[:, u:]
            d_candidate = error * (1 - z) * (1 - candidate * candidate)
            np.multiply(error, before - candidate, out=d_u[:, :u])
            np.multiply(d_candidate, inner, out=d_u[:, u : 2 * u])
            d_u[:, : 2 * u] *= gates * (1 - gates)
            np.multiply(d_candidate, r, out=d_u[:, 2 * u :])
            row[:, : 2 * u] = d_u[:, : 2 * u]
            row[:, 2 * u :] = d_candidate
            error = (error * z + d_u @ net.recurrent.T + more) * keep
        inners, rows = inners.reshape(-1, 3 * u), rows.reshape(-1, 3 * u)
        g.recurrent += states.T @ inners
        g.bias += inners[:, 2 * u :].sum(0)
        order = np.argsort(symbols, kind="stable")
        symbols = symbols[order]
        ends = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
        g.inputs[symbols[ends]] += np.add.reduceat(rows[order], ends)

    def update(self, rate: float) -> None:
        g = self.grads.flat
        if self.count:
            self.n += 1
            g /= self.count
            self.m *= 0.9
            self.m += 0.1 * g
            self.v *= 0.99
            self.v += 0.01 * g * g
            scale = rate * math.sqrt(1 - 0.99**self.n) / (1 - 0.9**self.n)
            self.net.flat += scale * self.m / (np.sqrt(self.v) + 1e-6)
        g[:] = 0


def _chunks(batches, at: int, encoder: Encoder):
    """(slice of a batch, its encoded texts, each with an end) of about CHUNK bytes of text each."""
    for b in batches:
        texts, first, size = [], 0, 0
        for i, t in enumerate(b.column(at)):
            text = t.as_py()
            size += len(text)
            found = words(text)
            found.append(END)  # place 0
            texts.append(np.fromiter(map(encoder.__getitem__, found), np.int32, len(found)))
            if size > CHUNK or i == b.num_rows - 1:
                yield b.slice(first, i + 1 - first), texts
                texts, first, size = [], i + 1, 0
                encoder.trim()


def _longest_first(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Texts of like size are lanes of one chunk, so that few steps have few lanes."""
    return batch.take(pc.sort_indices(pc.binary_length(batch.column(3)), [("", "descending")]))


def train(texts: DataFrame, v: Vocabulary) -> Network:
    """A network that has read all of (part, text), ``part`` being the round. A task trains the last round's network on its share, of which there are at most eight for each
    core; the weights of up to the root of all tasks add up in one group before they reach the driver."""
    spark = texts.sparkSession
    tasks = 8 * spark.sparkContext.defaultParallelism
    net = Network.new(v)
    shared = spark.sparkContext.broadcast(v)
    for part in range(ROUNDS):
        weights = spark.sparkContext.broadcast(net.flat)
        rate = RATE / (1 + part)

        def run(batches):
            from pyspark import TaskContext

            trainer, encoder = None, None
            for b in batches:
                if trainer is None:
                    trainer, encoder = Trainer(Network(weights.value.copy())), Encoder(shared.value)
                for _, coded in _chunks([b], 0, encoder):
                    sizes = np.array([len(c) for c in coded])
                    trainer.chunk(np.array(encoder.symbols, np.int32)[np.concatenate(coded)], np.cumsum(sizes) - sizes, rate)
            if trainer is not None:
                total = trainer.net.flat.astype(np.float64) * trainer.tokens
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([trainer.tokens]), pa.array([total.tobytes()])], names=["task", "tokens", "total"])

        def added(tables):
            tokens, total = 0, 0.0
            for b in tables:
                tokens += sum(b.column(1).to_pylist())
                for x in b.column(2).to_pylist():
                    total = total + np.frombuffer(x)
            yield pa.RecordBatch.from_arrays([pa.array([tokens]), pa.array([total.tobytes()])], names=["tokens", "total"])

        mine = texts.where(F.col("part") == part).select("text").coalesce(tasks).mapInArrow(run, "task long, tokens long, total binary")
        groups = max(1, math.isqrt(tasks))
        sums = mine.repartition(groups, F.col("task") % groups).mapInArrow(lambda bs: added(bs) if (bs := list(bs)) else iter(()), "tokens long, total binary").collect()
        tokens = sum(r.tokens for r in sums)
        if tokens:
            net = Network((sum(np.frombuffer(r.total) for r in sums) / tokens).astype(np.float32))
        weights.unpersist()
    return net


class LanguageModel:
    """Learns from ``docs`` that are not held out.

    Null texts are empty: they have only their end. Repeated rows count as often as they are there; null ids are not held out. Without training documents every token is unseen,
    and the network has learnt nothing. Other columns are not read."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.ws = Workspace(docs.sparkSession, "language-model")
        text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text")
        texts = docs.where(~held_out(id_col)).select(text, F.pmod(F.xxhash64(F.col(id_col)), F.lit(ROUNDS)).alias("part"))
        self.counts = self.ws.table(word_counts(texts), "counts")
        self.vocabulary = vocabulary(self.counts)
        self.network = train(texts, self.vocabulary)

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``, whole texts; base is of the counts alone, score of the network. An empty table gives no rows."""
        spark = docs.sparkSession
        v, weights = spark.sparkContext.broadcast(self.vocabulary), spark.sparkContext.broadcast(self.network.flat)

        def run(batches):
            net, encoder = Network(weights.value), Encoder(v.value)
            rest = np.append(np.zeros(HEAD), np.log10(v.value.endings.astype(np.float64)))
            unit = math.log10(v.value.tokens + v.value.distinct + 1)
            for part, coded in _chunks(map(_longest_first, batches), 3, encoder):
                sizes = np.array([len(c) for c in coded])
                starts, ids = np.cumsum(sizes) - sizes, np.concatenate(coded)
                symbols = np.array(encoder.symbols, np.int32)[ids]
                common = ids < encoder.fixed
                held = np.minimum(ids, encoder.fixed - 1)
                log = np.where(common, encoder.logs[held], 0.0)
                known = np.add.reduceat((common & encoder.seen[held]).astype(np.int64), starts)
                base = np.add.reduceat(log, starts) - sizes * unit
                score = log_likelihoods(net, symbols, starts) + np.add.reduceat(np.where(symbols < HEAD, 0.0, log) - rest[symbols], starts)
                rare = np.flatnonzero(~common)
                found, times = np.unique(np.repeat(np.arange(len(sizes)), sizes)[rare] << 32 | ids[rare] - encoder.fixed, return_counts=True)
                texts = pa.array([encoder.others[i] for i in (found & 0xFFFFFFFF).tolist()], pa.binary())
                ends = np.searchsorted(found >> 32, np.arange(len(sizes) + 1)).astype(np.int32)
                tails = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([texts, pa.array(times)], ["word", "n"]))
                columns = [part.column(0), part.column(1), part.column(2), pa.array(sizes.astype(np.int64)), pa.array(known), pa.array(base), pa.array(score), tails]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "tail"])

        kind = docs.schema[id_col].dataType.simpleString()
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
        scored = rows.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, tail array<struct<word binary, n long>>")
        scored = self.ws.table(scored, "scored")
        tail = scored.select("row", F.inline("tail")).withColumnRenamed("n", "times").join(self.counts, "word")
        tail = tail.groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("log"))
        log = F.coalesce("log", F.lit(0.0))
        return scored.drop("tail").join(tail, "row", "left").select(
            "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(self.vocabulary.tokens).cast("long").alias("train_tokens"), (F.col("base") + log).alias("base_score"), (F.col("score") + log).alias("score")
        )
