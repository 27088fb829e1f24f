import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.common import Workspace, connected_components


def plain_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, ids, distance):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, i in zip(fps, ids):
            for b, j in zip(fps, ids):
                if (a ^ b).bit_count() <= distance and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def texts(seed=1, n=60):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words, 80)) for _ in range(n // 4)]
    out = []
    for t in base:
        w = t.split()
        out += [t, t.upper(), " ".join([*w[:-1], "changed"]), " ".join(rng.choice(words, 30))]
    return [*out, None, "", " \t\n", "one", "One", "two words", "a b c d", "É a", "é a"]


def test_fingerprints_and_groups_equal_brute_force(spark):
    t = texts()
    docs = spark.createDataFrame([(i, x, "k", 5) for i, x in enumerate(t)], "doc_id long, text string, fp string, component_id int").repartition(5)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs, 4, 4).collect()}
    fps = [plain_fingerprint(x, 4) for x in t]
    assert [got[i].fp & (2**64 - 1) for i in range(len(t))] == fps
    assert {i: r.component_id for i, r in got.items()} == plain_components(fps, list(range(len(t))), 4)
    assert got[len(t) - 9].component_id == got[len(t) - 8].component_id  # null and empty


@pytest.mark.parametrize("distance", [0, 1, 3, 4, 6])
def test_links_are_complete(spark, distance):
    rng = np.random.default_rng(distance)
    base = rng.integers(-(2**63), 2**63 - 1, 40, dtype=np.int64)
    fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(6):
            flips = rng.choice(64, rng.integers(1, 8), replace=False)
            x = b & (2**64 - 1)
            for f in flips.tolist():
                x ^= 1 << f
            fps.add(x - 2**64 if x >= 2**63 else x)
    fps = sorted(fps)
    ws = Workspace(spark, "test")
    distinct = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = simhash.hamming_links(ws, distinct, distance)
    got = {r.node: r.root for r in connected_components(ws, links).collect()}
    want = plain_components([f & (2**64 - 1) for f in fps], fps, distance)
    assert {f: got.get(f, f) for f in fps} == want


def test_a_crowded_ball_is_linked_with_few_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 50)
    ball = sorted({(1 << a) | (1 << b) for a in range(40) for b in range(40)})  # all within four bits of each other
    ws = Workspace(spark, "test")
    links = simhash.hamming_links(ws, spark.createDataFrame([(f,) for f in ball], "fp long"), 4)
    rows = links.collect()
    assert len(rows) < 40 * len(ball) < len(ball) ** 2 / 2
    found = connected_components(ws, spark.createDataFrame(rows, "u long, v long"))
    assert {r.root for r in found.collect()} == {min(ball)} and found.count() == len(ball)


def test_tiles_link_like_pairs():
    rng = np.random.default_rng(3)
    data, query = np.sort(rng.integers(0, 4000, 300)), rng.integers(0, 4000, 500)
    q, d = simhash._pairs_in_tile(data, query, 2)
    forest, full = simhash.Forest(), simhash.Forest()
    forest.add(q, d)
    pairs = [(a, b) for a in query.tolist() for b in data.tolist() if b > a and (a ^ b).bit_count() <= 2]
    full.add(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    nodes = {x for p in pairs for x in p}
    same = lambda f: {frozenset(x for x in nodes if f.root(x) == r) for r in {f.root(x) for x in nodes}}
    assert same(forest) == same(full) and len(q) <= len(set(query.tolist())) + len(data) + len(query)


def test_probes_are_made_in_slices(spark, monkeypatch):
    rows = [(i, int(x)) for i, x in enumerate(np.random.default_rng(4).integers(-(2**62), 2**62, 200))]
    near = [(1000 + i, fp ^ (1 << (i % 60)) ^ (1 << ((i + 7) % 60))) for i, fp in rows[:80]]
    distinct = spark.createDataFrame(rows + near, "least long, fp long")
    whole = {(r.u, r.v) for r in simhash.hamming_links(Workspace(spark, "test"), distinct, 4).collect()}
    monkeypatch.setattr(simhash, "PROBES_HELD", 500)
    assert {(r.u, r.v) for r in simhash.hamming_links(Workspace(spark, "test"), distinct, 4).collect()} == whole and len(whole) >= 80


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_path_a_star_and_repeats(spark):
    ws = Workspace(spark, "test")
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 150)] + [(7, 7), (1, 2)]
    got = {r.node: r.root for r in connected_components(ws, spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[i] == 100 for i in range(100, 150)) and len(got) == 81


def test_thresholds_always_add_up():
    hist = np.random.default_rng(0).integers(0, 1000, (8, 256))
    hist = (hist / hist.sum(axis=1, keepdims=True) * 10_000).astype(np.int64)
    for m in (2, 3, 4, 5):
        t, cost = simhash.Thresholds(hist, 4, m).choose(np.random.default_rng(1).integers(0, 256, (50, 8)).astype(np.uint8))
        assert (t.sum(axis=1) == 4 - m + 1).all() and (t >= -1).all() and np.isfinite(cost).all()
    assert F is not None


@pytest.mark.parametrize("rows", [
    [(1, 0), (None, 7), (2, 63)],  # a chain through a row without an id
    [(5, 0), (5, (1 << 40) - 1), (3, 1)],  # one id, two texts: the second one is linked to nothing
    [(None, 0), (None, 1), (4, 1 << 50 | (1 << 30) - 1)],
    [(i % 7 or None, (1 << (i % 23)) | (i % 3) << 40) for i in range(80)],
])
def test_components_are_of_fingerprints(spark, monkeypatch, rows):
    df = spark.createDataFrame(rows, "doc_id long, fp long").repartition(2)
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs)
    fps = sorted({fp for _, fp in rows})
    label = plain_components(fps, fps, 4)
    least = {}
    for i, fp in rows:
        if i is not None:
            least[label[fp]] = min(i, least.get(label[fp], i))
    want = sorted(((i, fp, least.get(label[fp])) for i, fp in rows), key=str)
    assert sorted((tuple(r) for r in simhash.near_duplicates(df, distance=4).collect()), key=str) == want
