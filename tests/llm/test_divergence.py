"""The source divergence audit against plain counting."""

import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import pytest

from tessera.llm.divergence import Audit, audit, terms_of

SCHEMA = "lang string, source string, text string"


def brute(rows, least=3, top=200):
    docs = defaultdict(set)
    counts, groups = defaultdict(Counter), defaultdict(set)
    for i, (lang, source, text) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""):
            t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
            counts[lang, source][t] += 1
            docs[lang, t].add(i)
    out = []
    for lang, sources in groups.items():
        kept = [t for (x, t), d in docs.items() if x == lang and len(d) >= least]
        v = len(kept)
        count = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        count[None] = {t: sum(count[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + floor(Fraction(10**9 * (n + 1), sum(c.values()) + v)) for t, n in c.items()} for s, c in count.items()}

        def f(a, b, t):
            return (p[a][t] - p[b][t]) ** 2 // p[b][t]

        for s in sources:
            parts = {"pair": [(sum(f(s, o, t) for t in kept), o) for o in sources if o != s], "term": [(f(s, None, t), t) for t in kept if count[s][t] and p[s][t] > p[None][t]]}
            for part, found in parts.items():
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ordered) if part == "pair" or i < top]
    return sorted(out)


ROWS = [
    ("en", "a", "The cat, the CAT\x0bthe-cat"), ("en", "a", "the dog Straße É é"), ("en", "b", "cat dog the 12 x_y x_y"), ("en", "b", "dog DOG é Ü"), ("en", None, "the É é Ü zz"), ("en", "c", None),
    ("en", "c", ""), ("de", "a", "nur zwei"), ("de", "b", "nur zwei"), ("", "a", "x"), (None, "a", "x x"), (None, None, "X"), ("fr", "z", "un un un"), ("fr", "z", "un un un"), ("fr", "z", "un un un"),
    ("en", "b", "long " * 30_000 + "the"), ("en", "a", "long the"), ("en", "d", "long cat cat cat"),
]


def test_terms():
    assert terms_of("Ab'cÉd9\x00eF　g".encode()) == ["ab".encode(), "cÉd".encode(), "ef　g".encode()]


@pytest.mark.parametrize("top", [200, 2])
def test_equals_plain_counting(spark, top):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    assert sorted(map(tuple, audit(df, top=top).collect())) == brute(ROWS, top=top)


def test_flushed_counts_add_up(spark, monkeypatch):
    monkeypatch.setattr("tessera.llm.divergence.HELD", 2)
    assert sorted(map(tuple, audit(spark.createDataFrame(ROWS, SCHEMA).coalesce(1)).collect())) == brute(ROWS)


def test_clashing_columns_empty_table_and_no_kept_terms(spark):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in ROWS], SCHEMA + ", term string, n long, packed long".replace("term string", "term int"))
    assert sorted(map(tuple, audit(df).collect())) == brute(ROWS)
    assert audit(spark.createDataFrame([], SCHEMA)).collect() == []
    few = [("en", "a", "one"), ("en", "b", "two"), ("en", "c", None)]
    assert sorted(map(tuple, audit(spark.createDataFrame(few, SCHEMA)).collect())) == brute(few)


def test_shares_are_exact_for_large_counts(spark):
    from tessera.llm.divergence import _share

    for a, of in ((1, 1), (7, 9), (8_999_999_999_999_999, 9_000_000_000_000_000), (123_456_789_012_345, 987_654_321_098_765), (1, 9_000_000_000_000_000)):
        got = spark.range(1).selectExpr(f"{_share(f'{a}L', f'{of}L')} AS p").first().p
        assert got == 1 + 10**9 * a // of


def test_audit_keeps_the_counts(spark):
    found = Audit(spark.createDataFrame(ROWS, SCHEMA))
    assert {r.lang: r.v for r in found.langs.collect()}["fr"] == 1


def test_pairs_are_added_up_by_blocks(spark, monkeypatch):
    """No row for each term and pair of sources; blocks and batches add up exactly, up to the long integers' end."""
    import numpy as np

    from tessera.llm import divergence

    rng = np.random.default_rng(3)
    p = np.concatenate([rng.integers(1, 10**9 + 2, (60, 5)), [[10**9 + 1, 1, 1, 7, 10**9]] * 9]).astype(np.int64)
    exact = [[sum((int(x) - int(y)) ** 2 // int(y) for x, y in zip(p[:, i], p[:, j])) for j in range(5)] for i in range(5)]
    assert max(map(max, exact)) > 2**62 and divergence._block_sums(p).tolist() == exact
    with pytest.raises(OverflowError):
        divergence._block_sums(np.concatenate([p, p]))
    monkeypatch.setattr(divergence, "BLOCK", 12)
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert sorted(map(tuple, audit(df).collect())) == brute(ROWS)
    plan = Audit(df).pairs()._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "posexplode(p" not in plan
