import collections

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import substring


def brute(rows, window):
    count = collections.Counter()
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for _, w in words:
        count.update(tuple(w[a : a + window]) for a in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = np.zeros(len(w), bool)
        for a in range(len(w) - window + 1):
            if count[tuple(w[a : a + window])] > 1:
                gone[a : a + window] = True
        out.append((i, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


def corpus():
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(2000)]
    say = lambda n: rng.choice(vocabulary, n).tolist()
    passage, line, rows = say(60), say(20), []
    for i in range(40):
        body = say(int(rng.integers(0, 80)))
        if i % 3 == 0:
            a, b = sorted(rng.integers(0, 60, 2).tolist())
            body += passage[a:b] + say(10)
        if i % 2 == 0:
            body += line + say(15)
        rows.append((i, " ".join(body)))
    rows += [(100, rows[5][1]), (101, rows[5][1] + " more words here"), (102, None), (103, ""), (104, "a " * 100), (105, " ".join(["x", "y"] * 18)), (106, " ".join(say(35))), (5, rows[5][1]), (107, "é\tü\n" * 30)]
    return rows


@pytest.mark.parametrize(("window", "crowd"), [(35, 2000), (35, 3), (10, 2000), (10, 2)])
def test_removal_equals_brute_force(spark, monkeypatch, window, crowd):
    monkeypatch.setattr(substring, "SHARD_CONTEXTS", crowd)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, mh int").repartition(5)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(docs, window).collect()]
    assert sorted(got, key=str) == brute(rows, window)


def test_strip_keeps_other_columns_and_untouched_texts(spark):
    rows = corpus()
    docs = spark.createDataFrame([(r[0], "k", r[1], 4) for r in rows], "doc_id long, rid string, text string, spans int")
    out = substring.strip_repeats(docs, 35)
    assert out.schema == docs.schema
    plain = {i: (n, k) for i, _, n, k in brute(rows, 35)}
    for r in out.collect():
        n, kept = plain[r.doc_id]
        original = next(t for i, t in rows if i == r.doc_id)
        assert r.text == (kept if n else original) and r.rid == "k" and r.spans == 4
    assert substring.strip_repeats(docs.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=12), st.integers(1, 2)), min_size=1, max_size=5))
def test_automaton_statistics(texts):
    a = substring.SuffixAutomaton()
    for words, weight in texts:
        a.add(words, weight)
    a.settle()
    count = collections.Counter()
    for words, weight in texts:
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                count[tuple(words[i:j])] += weight
    for words, _ in texts:
        want = [max([n for n in range(1, i + 2) if count[tuple(words[i + 1 - n : i + 1])] >= 2], default=0) for i in range(len(words))]
        assert a.repeated(words) == want


def test_minimisers_belong_to_their_windows():
    tool = substring.Windows(12)
    words = [b"%d" % x for x in np.random.default_rng(0).integers(0, 50, 200)]
    whole, low = tool.of(words)
    again, lower = tool.of(words[30:60])
    assert (whole[30:49] == again).all() and (low[30:49] == lower).all() and len(whole) == 189
    runs = tool.contexts(words)
    assert sum(n for _, _, n, _ in runs) == 189 and max(n for _, _, n, _ in runs) <= 12 - substring.GRAM + 1
