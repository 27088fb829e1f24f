import numpy as np
import pytest

from tessera.llm import simhash


def corpus():
    rng = np.random.default_rng(12)
    vocabulary = [f"word{i}" for i in range(4000)]
    rows = []
    for _ in range(6):
        base = rng.choice(vocabulary, 150).tolist()
        for k in range(12):
            w = list(base)
            for at in rng.choice(150, k // 2, replace=False).tolist():
                w[at] = str(rng.choice(vocabulary))
            rows.append(" ".join(w))
    rows += [" ".join(rng.choice(vocabulary, 60)) for _ in range(40)]
    return [*rows, rows[0], None, "", "  ", "one two", "one two"]


def jaccard(a, b):
    x, y = (set(simhash.shingle_hashes(t, 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("settled", [200, 3])
def test_leaders_stand_for_their_copies(spark, monkeypatch, settled):
    monkeypatch.setattr(simhash, "SETTLED", settled)
    monkeypatch.setattr(simhash, "CHUNK", 4)
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, sh string, same int").repartition(4)
    gone = {r.doc_id for r in simhash.near_copies(docs).collect()}
    component = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, None, 7).collect()}
    kept = [i for i in range(len(texts)) if i not in gone]
    for i in gone:
        assert any(component[k] == component[i] and jaccard(texts[k], texts[i]) >= 0.8 for k in kept if k < i)
    for n, i in enumerate(kept):
        assert not any(component[k] == component[i] and jaccard(texts[k], texts[i]) >= 0.8 for k in kept[:n])
    assert not gone & set(range(72, 112)) and 112 in gone and {114, 115, 117} <= gone and 113 not in gone
    near = [(i, j) for i in range(72) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    assert sum(component[i] == component[j] for i, j in near) >= 0.9 * len(near) > 50


def test_empty(spark):
    assert simhash.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("kind", ["tail", "run", "scattered"])
def test_all_pairs_of_the_similarity_are_met(spark, kind):
    rng = np.random.default_rng(5)
    vocabulary = [f"word{i}" for i in range(6000)]
    texts = []
    for k in range(60):
        base = rng.choice(vocabulary, 200).tolist()
        other, n = list(base), 17 + k % 5
        at = {"tail": range(200 - n, 200), "run": range(60, 60 + n - 3), "scattered": rng.choice(np.arange(4, 196), 4, replace=False).tolist()}[kind]
        for i in at:
            other[i] = f"fresh{k}x{i}"
        texts += [" ".join(base), " ".join(other)]
    pairs = [i for i in range(0, 120, 2) if 0.8 <= jaccard(texts[i], texts[i + 1])]
    assert len(pairs) >= 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in simhash.near_copies(docs).collect()} == {i + 1 for i in pairs}
