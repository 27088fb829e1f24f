"""The language model: counts against plain counting, gradients against differences, states against one text at a time, and held-out likelihood."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import language_model as lm

SCHEMA = "doc_id long, text string"


def tokens(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), ""]


def brute(rows):
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(t for i, text in rows if not out(i) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    res = []
    for i, text in rows:
        mine = tokens(text)
        res.append((i, out(i), len(mine), sum(c[t] > 0 for t in mine), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in mine)))
    return res


def check(got, rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    got, want = sorted((tuple(r)[:6] for r in got), key=key), sorted(brute(rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], abs=1e-6)


TEXTS = ["The cat SAT on\x0bthe mat", "", None, " \t\n", "Ärger über ÉTÉ été", "the\x00cat the\x1fcat", "a" * 50_000, "x y " * 20_000, "the cat sat on the mat"]


def test_counts_and_base_equal_plain_counting(spark):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(60)] + [(None, "the unseen"), (None, None), (7, "again"), (7, "again")]
    df = spark.createDataFrame([(*r, 1, "w", 2) for r in rows], SCHEMA + ", n int, word string, row int").repartition(3)
    got = lm.LanguageModel(df).score(df).collect()
    check(got, rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    same = {}
    for r in got:  # equal texts, equal scores, but for single precision
        same.setdefault((r.n_tokens, round(r.base_score, 6)), []).append(r.score)
    assert all(s == pytest.approx([s[0]] * len(s), rel=1e-4) for s in same.values())


def test_words_beyond_the_common_ones_meet_their_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "COMMON", 5)
    monkeypatch.setattr(lm, "HELD", 3)
    monkeypatch.setattr(lm, "CHUNK", 40)
    rows = [(i, f"w{i % 7} w{i % 3} rare{i} rare{i} w1") for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    check(lm.LanguageModel(df).score(df).collect(), rows)


def test_empty_tables_and_no_training_documents(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = lm.LanguageModel(empty)
    assert model.score(empty).collect() == []
    held = [(i, "some words") for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2]
    df = spark.createDataFrame(held, SCHEMA)
    got = model.score(df).collect()
    check(got, held)
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in got)
    check(lm.LanguageModel(df).score(df).collect(), held)


def small(texts):
    c = Counter(t.encode() for x in texts for t in tokens(x))
    found = [(b"", c[b""]), *sorted(((w, n) for w, n in c.items() if w), key=lambda x: (-x[1], x[0]))]
    v = lm.Vocabulary([w for w, _ in found], np.array([n for _, n in found]), sum(c.values()), len(c), np.ones(lm.ENDINGS, np.int64))
    e = lm.Encoder(v)
    coded = [np.array([*map(e.__getitem__, lm.words(x.encode())), 0]) for x in texts]
    sizes = np.array([len(x) for x in coded])
    return v, np.array(e.symbols, np.int32)[np.concatenate(coded)], np.cumsum(sizes) - sizes


TEXT = ["a b c d e", "b b f g unknown", "", "c a c a c a g g"]


def test_a_new_network_has_the_shares_of_the_counts():
    v, targets, starts = small(TEXT)
    got = lm.log_likelihoods(lm.Network.new(v), targets, starts)
    net = lm.Network.new(v)
    net.inputs[:] = 0
    net.recurrent[:] = 0
    got = lm.log_likelihoods(net, targets, starts)
    total = v.counts.sum() + len(v.counts) + lm.ENDINGS
    counts = dict(zip(v.common, v.counts))
    want = [sum(math.log10((counts[t.encode()] + 1) / total) for t in tokens(x)) for x in TEXT]
    assert got == pytest.approx(want, abs=1e-3)


def test_gradients_equal_differences():
    v, targets, starts = small(TEXT)
    net = lm.Network(lm.Network.new(v).flat.astype(np.float64))
    rng = np.random.default_rng(1)
    net.flat += rng.normal(0, 0.05, len(net.flat))
    trainer = lm.Trainer(net)
    trainer.grads = lm.Network(np.zeros_like(net.flat))
    given, fresh = lm._inputs(targets, starts), np.zeros(len(targets), bool)
    fresh[starts] = True
    places = [np.array([t]) for t in range(len(targets))]
    trainer.window(places, given, targets, fresh, np.zeros((1, lm.UNITS)))

    def total():
        return lm.log_likelihoods(net, targets, starts).sum() * math.log(10)

    used = np.flatnonzero(trainer.grads.flat)
    for at in rng.choice(used, 60, replace=False):
        keep, step = net.flat[at], 1e-4
        net.flat[at] = keep + step
        up = total()
        net.flat[at] = keep - step
        down = total()
        net.flat[at] = keep
        # log_likelihoods holds states in single precision
        assert trainer.grads.flat[at] == pytest.approx((up - down) / (2 * step), abs=5e-3)


def test_lanes_and_windows_do_not_change_a_text():
    v, targets, starts = small([*TEXT, "a b " * 700])
    net = lm.Network.new(v)
    together = lm.log_likelihoods(net, targets, starts)
    ends = np.append(starts, len(targets))
    alone = [lm.log_likelihoods(net, targets[a:b], np.array([0]))[0] for a, b in zip(ends, ends[1:])]
    assert together == pytest.approx(alone, rel=1e-4)


def test_classes_and_words_sum_to_one():
    v, _, _ = small(TEXT)
    net = lm.Network.new(v)
    net.flat += np.random.default_rng(2).normal(0, 0.05, len(net.flat)).astype(np.float32)
    h = np.random.default_rng(3).normal(0, 1, (1, lm.UNITS)).astype(np.float32)
    every = np.arange(lm.HEAD + lm.ENDINGS)
    shares, _ = net.log_shares(np.repeat(h, len(every), 0), every)
    assert np.exp(shares).sum() == pytest.approx(1, abs=1e-3)


def test_held_out_texts_are_likelier_than_by_counts(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in lm.LanguageModel(df).score(df).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 0.97
    assert sum(r.score > r.base_score for r in held) > 0.9 * len(held)


def test_weights_learn_at_every_window():
    trainer = lm.Trainer(lm.Network(np.zeros(lm.Network.size(), np.float32)))
    targets = np.arange(7 * lm.WINDOW, dtype=np.int32) % 50
    trainer.chunk(targets, np.array([0]), 0.01)
    assert trainer.n == 7 and trainer.tokens == len(targets)


def test_a_word_in_each_class_learns_as_differences_say():
    """States that meet by class go back to their rows: gradients of the states too, with weights that could leave the range of exponentials in some classes only."""
    v, _, _ = small(TEXT)
    net = lm.Network(lm.Network.new(v).flat.astype(np.float64))
    rng = np.random.default_rng(4)
    net.flat += rng.normal(0, 0.1, len(net.flat))
    net.words[3] *= 300
    assert lm._steep(net.words, net.word_bias).tolist() == [(np.abs(w).sum(0) + np.abs(b)).max() > lm.STEEPEST for w, b in zip(net.words, net.word_bias)]
    assert lm._steep(net.words, net.word_bias)[3] and not lm._steep(net.words, net.word_bias)[4]
    targets = rng.permutation(np.append(rng.integers(0, lm.HEAD, 200), rng.integers(lm.HEAD, lm.HEAD + lm.ENDINGS, 40)))
    targets = targets[targets // (lm.HEAD // lm.CLASSES) != 3]
    h = rng.normal(0, 0.4, (len(targets), lm.UNITS))
    logs, back = net.log_shares(h, targets, lm.Network(np.zeros_like(net.flat)))
    one = np.array([net.log_shares(h[i : i + 1], targets[i : i + 1])[0][0] for i in range(len(targets))])
    assert logs == pytest.approx(one)
    for u in (0, 7, 15):
        step = np.zeros(lm.UNITS)
        step[u] = 1e-5
        slope = (net.log_shares(h + step, targets)[0] - net.log_shares(h - step, targets)[0]) / 2e-5
        assert back[:, u] == pytest.approx(slope, abs=1e-4)
