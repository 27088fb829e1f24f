"""WARC, BPE, packing, sharding, nearest neighbours, I-Match, toxicity: brute force, round trips and edges."""

import base64
import gzip
import hashlib
import io
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import ann, bpe, imatch, packing, sharding, toxicity, warc


# WARC


def test_archives_round_trip(spark):
    rows = [(1, "http://a/é", "same"), (5, "http://b", "same"), (3, None, "same"), (2, "x", None), (4, "y", ""), (None, "z", "alone"), (7, "q", "ü" * 5000), (7, "q", "ü" * 5000), (8, "c\r\nd", "<p>\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, keeper int").repartition(3)
    records, index, _ = warc.archive_pages(pages)
    got = records.collect()
    assert len(got) == len(rows) == index.count()
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in got}
    assert kinds == {1: ("revisit", 5), 5: ("response", None), 3: ("revisit", 5), 2: ("revisit", 4), 4: ("response", None), None: ("response", None), 7: ("response", None), 8: ("response", None)}
    for r in got:
        html = next(h or "" for i, _, h in rows if i == r.page_id)
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
    long_only, _, _ = warc.archive_pages(pages, least_bytes=5)
    assert {r.page_id for r in long_only.where("record_type = 'revisit'").collect()} == set()
    assert warc.archive_pages(pages.limit(0))[0].count() == 0


def test_normaliser_makes_one_member_a_record():
    records = [b"".join(warc.record(i, f"http://h/{i}", "x" * n, None)) for i, n in enumerate([0, 10, 3_000_000])]
    whole = gzip.compress(b"".join(records[:2])) + gzip.compress(records[2])  # two streams, three records
    out, idx = io.BytesIO(), io.BytesIO()
    assert warc.normalise(io.BytesIO(whole), out, idx) == 3
    import json

    for line, record in zip(map(json.loads, idx.getvalue().splitlines()), records):
        member = out.getvalue()[line["offset"] : line["offset"] + line["length"]]
        d = zlib.decompressobj(wbits=31)
        assert d.decompress(member) == record and d.eof and not d.unused_data
    with pytest.raises(ValueError):
        warc.normalise(io.BytesIO(whole[:-20]), io.BytesIO(), io.BytesIO())


# BPE

ALPHABET = st.sampled_from(["a", "b", "the", " ", "  ", "\n", "\t", "é", "中", "😀", "'s", "'ll", "12", "...", "<|endoftext|>", "\x1c", "　", "ing", "AA", "x" * 30, "́", "\x85"])


@pytest.fixture(scope="module")
def pair():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return bpe.Bpe(f.read()), Tokenizer.from_file(path)


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=30).map("".join) | st.text(max_size=60))
def test_ids_equal_the_library(pair, text):
    mine, theirs = pair
    ids = theirs.encode(text, add_special_tokens=False).ids
    got = mine.encode(text)
    assert mine.count(text) == len(ids)
    assert np.frombuffer(got, "<u4").tolist() == ids and mine.decode(got) == theirs.decode(ids, skip_special_tokens=False) == text


def test_encode_documents(spark, pair):
    import public_tokenizers as P

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    docs = spark.createDataFrame([(1, "Hello world"), (2, None), (2, ""), (3, "ab" * 20000)], "doc_id long, text string")
    got = sorted((r.doc_id, len(r.ids), r.decoded) for r in bpe.encode_documents(docs, spec).collect())
    assert got == [(1, 8, "Hello world"), (2, 0, ""), (2, 0, ""), (3, 4 * len(pair[1].encode("ab" * 20000).ids), "ab" * 20000)]
    assert bpe.encode_documents(docs.limit(0), spec).count() == 0


# packing


def plain_packing(lengths, permitted):
    """Best fit over a plain list of bins, and the size of a new bin by trying each one on a copy of the items left."""
    bins, left, places = [], sorted(lengths, reverse=True), []
    while left:
        n = left.pop(0)
        open_bins = [(size - used, k) for k, (size, used) in enumerate(bins) if size - used >= n]
        if open_bins:
            _, k = min(open_bins)
        else:
            tried = []
            for c in permitted:
                if c >= n:
                    used = n
                    for m in left:
                        if m <= c - used:
                            used += m
                    shrunk = min(p for p in permitted if p >= used)
                    tried.append(((shrunk + shrunk * shrunk / packing.QUADRATIC) / used, c))
            k = len(bins)
            bins.append([min(tried)[1], 0])
        places.append((n, k, bins[k][1]))
        bins[k][1] += n
    return places, [min(p for p in permitted if p >= used) for _, used in bins]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit(lengths):
    permitted = (8, 16, 32, 64)
    bins, offsets, sizes = packing.best_fit(lengths, permitted)
    places, want = plain_packing(lengths, permitted)
    assert sizes == want and sorted(zip(lengths, bins, offsets)) == sorted(places)


def test_sizes_are_chosen_for_what_they_hold():
    """Items of 300: a sequence of 512 would hold one, the long ones fill; the last sequence shrinks to its contents."""
    _, _, sizes = packing.best_fit([300] * 40, packing.LENGTHS)
    assert 512 not in sizes[:-1] and 40 * 300 / sum(sizes) > 0.85
    assert packing.best_fit([300], packing.LENGTHS)[2] == [512]


@pytest.mark.parametrize("group", [20_000, 40])
def test_packing_places_every_token_once(spark, pair, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP_ITEMS", group)
    rng = np.random.default_rng(0)
    texts = [None, "", "x" * 70_000, *[" ".join(rng.choice(["the", "of", "word", "naïve", "12"], int(n))) for n in rng.integers(0, 1500, 200)]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7])] * 3 + [(None, texts[9])] * 40 + [(9, texts[9])]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, bin_id int, row int").repartition(3)
    got = packing.pack_documents(docs).collect()
    bins, pieces = {}, {}
    for r in got:
        bins.setdefault(r.bin_id, []).append((r.bin_offset, r.n_tokens, r.bin_length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.n_tokens))
    count = {t: len(pair[1].encode(t or "", add_special_tokens=False).ids) + 1 for t in texts}
    want = {}
    for i, t in rows:
        want.setdefault(i, []).extend((at, min(4096, count[t] - at)) for at in range(0, count[t], 4096))
    assert {i: sorted(p) for i, p in pieces.items()} == {i: sorted(p) for i, p in want.items()}
    for items in bins.values():
        at = 0
        for offset, n, _ in sorted(items):
            assert offset == at
            at += n
        assert {size for _, _, size in items} == {next(c for c in packing.LENGTHS if c >= at)}
    tokens = sum(n for p in want.values() for _, n in p)
    assert tokens / sum(v[0][2] for v in bins.values()) > (0.93 if group > 1000 else 0.8)
    if group > 1000:  # one group: the plain version's bins
        places, sizes = plain_packing([n for p in want.values() for _, n in p], packing.LENGTHS)
        assert sorted(v[0][2] for v in bins.values()) == sorted(sizes)
    else:
        assert len({b >> 32 for b in bins}) == -(-len(got) // group)
    assert packing.pack_documents(docs.limit(0)).count() == 0


# sharding


def test_shards_keep_copies_together_and_are_even(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "x" * int(n)) for i, n in enumerate(rng.integers(0, 400, 900))] + [(1000 + i, "copy of " + "y" * 50) for i in range(40)] + [(2000, None), (2001, ""), (5, "x")]
    got = sharding.shard_documents(spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, shard int"), 8).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    by, slots, of = {}, {}, {}
    for r in got:
        by[r.shard] = by.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        of.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert set(by) == set(range(8)) and max(by.values()) - min(by.values()) <= 500 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of.values()) and sum(by.values()) == sum(len((t or "").encode()) + 1 for _, t in rows)
    assert next(r.text_crc32 for r in got if r.doc_id == 1000) == zlib.crc32(("copy of " + "y" * 50).encode())
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shards_equal_plain_best_fit_decreasing(spark, monkeypatch):
    """All groups packed one by one in a plain loop, at the least capacity that a search from below finds."""
    monkeypatch.setattr(sharding, "CROWDED", 12)
    rng = np.random.default_rng(5)
    texts = [chr(97 + int(c)) * int(n) for c, n in zip(rng.integers(0, 26, 400), rng.integers(0, 90, 400))] + ["hot"] * 300 + ["é" * 40] * 90 + [None, ""]
    rows = [(None if i % 50 == 0 else i % 350, t) for i, t in enumerate(texts)]
    got = sharding.shard_documents(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, same string, row int").repartition(5), 8).collect()
    groups = {}
    for t in texts:
        groups.setdefault(t or "", []).append(len((t or "").encode()) + 1)
    order = sorted(groups, key=lambda t: (-sum(groups[t]), hashlib.md5(t.encode()).hexdigest()))

    def fits(capacity, items, bins):
        room, of = [], {}
        for t in items:
            size = sum(groups[t])
            able = [(r, b) for b, r in enumerate(room) if r >= size]
            if not able and len(room) == bins:
                return None
            if not able:
                room.append(max(capacity, size))
                able = [(room[-1], len(room) - 1)]
            b = min(able)[1]
            room[b] -= size
            of[t] = b
        return of

    alone, rest, total = {}, list(order), sum(map(sum, groups.values()))
    while 8 - len(alone) > 1 and sum(groups[rest[0]]) * (8 - len(alone)) > total:
        total -= sum(groups[rest[0]])
        alone[rest.pop(0)] = len(alone)
    low, high = 1, total  # halving, as more capacity may need more bins only by accident
    low = max(-(-total // (8 - len(alone))), sum(groups[rest[0]]))
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid, rest, 8 - len(alone)) is not None else (mid + 1, high)
    want = alone | {t: b + len(alone) for t, b in fits(high, rest, 8 - len(alone)).items()}
    by_print = {(len(t.encode()) + 1, zlib.crc32(t.encode())): b for t, b in want.items()}
    assert len(got) == len(rows) and all(by_print[r.size, r.text_crc32] == r.shard for r in got)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 8
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((i or -1, len((t or "").encode()) + 1) for i, t in rows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=80), st.integers(30, 70))
def test_runs_are_placed_as_their_groups_would_be(sizes, capacity):
    runs = sorted(((s, sizes.count(s)) for s in set(sizes)), reverse=True)
    spread = [(s, b) for i, b, k in sharding.best_fit_runs(runs, capacity) for s in [runs[i][0]] * k]
    decreasing = sorted(sizes, reverse=True)
    assert spread == list(zip(decreasing, sharding.best_fit_decreasing(decreasing, capacity)))


def test_one_huge_group_has_a_shard_of_its_own(spark):
    rows = [(i, "hot") for i in range(300)] + [(1000 + i, f"cold {i}") for i in range(200)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert len({r.shard for r in got if r.doc_id < 300}) == 1 and len({r.shard for r in got}) == 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(50, 80))
def test_best_fit_decreasing(sizes, capacity):
    bins = sharding.best_fit_decreasing(sizes, capacity)
    used = {}
    for n, b in zip(sizes, bins):
        used[b] = used.get(b, 0) + n
    assert all(u <= capacity for u in used.values()) and len(used) <= max(1, 2 * math.ceil(sum(sizes) / capacity))


# nearest neighbours


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[100:200] = x[0]  # ties
    x[7] = 0
    rows = [(i, x[i].tolist()) for i in range(400)] + [(500, None), (550, [float("nan")] * 16), (600, [None] * 16), (650, [1.0, 2.0]), (None, x[1].tolist()), (700, [float("inf")] * 16), (50, x[50].tolist()), (750, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int").repartition(3)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.nearest(df, df.vec_id % 50 == 0, 5).collect()}
    ids = np.array([i for i in range(400) if i != 7] + [50])
    v = x[ids].astype(float)
    norm = np.sqrt((v * v).sum(1))
    want = {}
    for q in range(0, 400, 50):
        s = (v @ x[q].astype(float)) / (norm * np.sqrt((x[q].astype(float) ** 2).sum()))
        best = sorted((-round(a, 12), i) for a, i in zip(s.tolist(), ids.tolist()) if i != q)[:5]
        want |= {(q, k + 1): b for k, b in enumerate(best)}
    assert set(got) == set(want)
    assert all(got[k][0] == want[k][1] and abs(got[k][1] + want[k][0]) < 1e-9 for k in want)
    few = df.where("vec_id in (0, 1, 2)")
    assert [r.rank for r in ann.nearest(few, few.vec_id == 0, 5).orderBy("rank").collect()] == [1, 2]
    assert ann.nearest(df.limit(0), df.vec_id % 50 == 0).count() == 0


def test_vectors_of_any_finite_size(spark):
    """Squares that over- or underflow do not change a cosine; plain arithmetic of fractions decides."""
    from fractions import Fraction

    rows = [(0, [1e200, 1e200]), (1, [1e200, 1.1e200]), (2, [1.0, 2.0]), (3, [1e-200, 1.05e-200]), (4, [5e-324, 0.0]), (5, [1e308, -1e-300]), (6, [-3.0, 4.0]), (50, [3e-310, 4e-310]), (100, [2.5, 1e-3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = {i: [Fraction(c) for c in x] for i, x in rows}

    def cosine(a, b):
        dot = sum(x * y for x, y in zip(exact[a], exact[b]))
        square = dot * dot / (sum(x * x for x in exact[a]) * sum(x * x for x in exact[b]))
        return math.sqrt(square) * (1 if dot >= 0 else -1)

    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.nearest(df, df.vec_id % 50 == 0, 5).collect()}
    assert len(got) == 15
    for q in (0, 50, 100):
        want = sorted((-round(cosine(q, i), 12), i) for i in exact if i != q)[:5]
        assert [got[q, k + 1][0] for k in range(5)] == [i for _, i in want]
        assert all(abs(got[q, k + 1][1] - cosine(q, i)) < 1e-12 for k, (_, i) in enumerate(want))


def test_queries_in_several_scans(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(300)], "vec_id long, embedding array<double>").repartition(3)
    once = sorted(ann.nearest(df, df.vec_id % 10 == 0).collect())
    monkeypatch.setattr(ann, "SCAN_BYTES", 600)
    assert sorted(ann.nearest(df, df.vec_id % 10 == 0).collect()) == once and len(once) == 150


def test_quantised_bounds_hold():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(60, 32)), rng.normal(size=(80, 32)) * 100
    p, q = ann.Quantised(a), ann.Quantised(b)
    about = (p.code @ q.code.T) * (p.scale[:, None] * q.scale[None])
    bound = p.error[:, None] + p.length[:, None] * q.error[None] + ann.slack(32)
    exact = (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None])
    assert (np.abs(exact - about) <= bound).all()


# I-Match


def test_edited_fingerprints(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"{a}{b}{c}{d}" for a in "abcdefgh" for b in "ijklmno" for c in "pqrstuv" for d in range(20)]
    t = [" ".join(rng.choice(vocabulary, int(n))) for n in rng.integers(20, 200, 80)]
    rows = [(3 * i, x) for i, x in enumerate(t)] + [(1000, None), (1001, ""), (1002, "..."), (1003, t[0]), (1004, "😀é" * 30), (1004, "dup")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int").repartition(6)
    got = imatch.compare_edited(docs).collect()
    assert len(got) == len(rows)
    order = sorted((i, x or "") for i, x in rows)
    want = {}
    for k, (i, x) in enumerate(order):
        y = order[(k + 1) % len(order)][1]
        n = len(x) // 4
        want[i, len(x), hashlib.sha256((x[: len(x) - n] + y[:n]).encode()).hexdigest()] = x
    assert {(r.doc_id, r.n_chars, r.edited_sha256) for r in got} == set(want)
    prints = {}
    for r in got:
        prints.setdefault(want[r.doc_id, r.n_chars, r.edited_sha256], set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (r.near_edited == 1) >= (r.fingerprint == r.edited_fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and len(prints[t[0]]) == 1
    long_ones = [r for r in got if r.n_chars > 150]
    assert np.mean([r.near_edited for r in long_ones]) > 0.3 > 0.05 > np.mean([r.near_next for r in long_ones])
    assert imatch.compare_edited(docs.limit(0)).count() == 0
    assert imatch.document_fingerprints(docs).where("doc_id = 1000").first().fingerprint == imatch.document_fingerprints(docs).where("doc_id = 1001").first().fingerprint


def test_fingerprints_equal_brute_force(spark):
    """Document frequencies, band, lexicon subsets and likeness in plain Python integers."""
    import re

    import xxhash

    rng = np.random.default_rng(9)
    vocabulary = [f"term{i}é" for i in range(3000)]
    texts = [" ".join(rng.choice(vocabulary, int(n))) + " Every text" for n in rng.integers(0, 90, 70)] + ["", None, "?!", "Every TEXT", "lonely"]
    texts[5] = texts[4]
    texts[7] = texts[6] + " more words"

    def terms(t):
        return {w.encode() for w in re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))}

    df = {}
    for t in texts:
        for w in terms(t):
            df[w] = df.get(w, 0) + 1
    low, high = imatch.BAND[0] * len(texts), max(imatch.BAND[1] * len(texts), 2)
    lexicon = {w for w, n in df.items() if low <= n <= high}
    assert b"every" not in lexicon and len(lexicon) > 1000
    mask = 2**64 - 1

    def rank(h, order):
        x = (h ^ h >> 29) * (xxhash.xxh64_intdigest(b"order", order) | 1) & mask
        x = (x ^ x >> 32) * 0x9E3779B97F4A7C15 & mask
        return min(imatch.SCALES - 1, 64 - (x ^ x >> 29).bit_length())

    def subsets(t):
        kept = terms(t) & lexicon or terms(t)
        h = sorted(xxhash.xxh64_intdigest(w, 7) for w in kept)
        return [[[x for x in h if rank(x, c) >= s] for s in range(imatch.SCALES)] for c in range(imatch.COPIES)]

    def digest(h):
        return xxhash.xxh64_hexdigest(np.array(h, np.uint64).tobytes())

    def plain(t):
        if not terms(t):
            return "text-" + hashlib.sha1((t or "").encode()).hexdigest()[:16]
        made = subsets(t)
        return " ".join([digest(made[0][0]), *("".join(digest(x)[: imatch.DIGITS] for x in levels[1:] if x) or "-" for levels in made)])

    def like(a, b):
        if plain(a) == plain(b):
            return 1.0
        if not terms(a) or not terms(b):
            return 0.0
        return sum(any(x and x == y for x, y in zip(p[1:], q[1:])) for p, q in zip(subsets(a), subsets(b))) / imatch.COPIES

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    rows = {r.doc_id: r for r in imatch.compare_edited(docs).collect()}
    assert {r.doc_id: r.fingerprint for r in imatch.document_fingerprints(docs).collect()} == {i: plain(t) for i, t in enumerate(texts)}
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        new = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        r = rows[i]
        assert (r.fingerprint, r.edited_fingerprint) == (plain(t), plain(new))
        assert (r.near_edited, r.near_next) == (like(t, new), like(t, after))
    assert rows[4].near_next == 1 and 0.5 < rows[6].near_next < 1


def test_lexicon_ranks_are_geometric():
    ranks = imatch._ranks(np.random.default_rng(0).integers(0, 2**63, 20000).astype(np.uint64))
    assert ranks.shape == (imatch.COPIES, 20000) and ranks.min() == 0
    for s in (1, 3, 5):
        assert abs((ranks >= s).mean() * 2**s - 1) < 0.1


# toxicity


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(5)
    e, first = rng.normal(size=9) * 2, np.array([1, 0, 0, 0, 1, 1, 0, 0, 0], bool)
    trans, start = rng.normal(size=(2, 2)), rng.normal(size=2)
    total, hot = 0.0, np.zeros(9)
    for code in range(2**9):
        y = [(code >> i) & 1 for i in range(9)]
        s = sum(e[i] * y[i] + (start[y[i]] if first[i] else trans[y[i - 1], y[i]]) for i in range(9))
        total += math.exp(s)
        hot += math.exp(s) * np.array(y)
    assert np.allclose(toxicity.marginals(e, first, trans, start), hot / total)


def test_toxic_documents_are_found(spark):
    rng = np.random.default_rng(6)
    clean, bad = [f"wort{i}" for i in range(400)], ["schimpf", "schimpfer", "blodmann"]
    docs, labels = [], []
    for i in range(900):
        words = rng.choice(clean, 40).tolist()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                words.insert(int(rng.integers(0, 40)), str(rng.choice(bad)))
        docs.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(toxic)))
    docs += [(1000, None, "s"), (1001, "", "s"), (1002, "schimpf " * 3000, "s"), (0, docs[0][1], "s")]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, lab)
    rows = toxicity.score_documents(d, model).join(spark.createDataFrame([(i, zlib.crc32(str(i).encode()) % 5 == 0) for i in range(1003)], "doc_id long, want boolean"), "doc_id").withColumn("held_out", toxicity.held_out("doc_id")).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == r.want for r in rows) and len(held) > 100
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    by = {r.doc_id: r for r in rows}
    assert by[1000].score == by[1001].score < 0.5 and by[1002].predicted == 1 and by[1000].spans == []
    text = docs[4][1]
    assert {text[s["first"] : s["last"]] for s in by[4].spans} <= set(bad) and by[4].spans
    kept = toxicity.reject_toxic(d, model)
    assert kept.columns == d.columns and kept.count() == sum(r.predicted == 0 for r in rows)
    nothing = toxicity.fit(d, lab.limit(0))
    assert toxicity.score_documents(d.limit(3), nothing).where("predicted = 1").count() == 0


def test_new_pieces_are_counted_together():
    import random

    from tessera.llm import bpe

    one, all_ = bpe.Bpe(bpe.vocabulary()), bpe.Bpe(bpe.vocabulary())
    random.seed(11)
    letters = [*map(chr, range(32, 127)), *"éß漢😀\n\t 　", *"etaoin" * 9, *" " * 20]
    texts = ["".join(random.choices(letters, k=random.randint(0, 90))) for _ in range(1500)] + ["", " ", "a" * 500 + " " + "ab" * 15 + " hello" * 4, "<|endoftext|> x<|endoftext|>"]
    expected = [len(one.encode(t)) // 4 for t in texts]
    assert all_.count_all(texts) == expected
    assert all_.count_all(texts) == expected  # from what is remembered
    assert all_.count_all([]) == []


def test_fingerprints_hash_each_nested_subset_whole():
    import xxhash

    from tessera.llm import imatch

    rng = np.random.default_rng(5)
    vocabulary = [f"term{i}" for i in range(400)]
    lexicon = np.sort(np.array([xxhash.xxh64_intdigest(t.encode(), 7) for t in vocabulary[::2]], np.uint64))
    hasher = imatch.Hasher(limit=50)  # forgets all the time
    for n in (1, 2, 7, 150):
        text = " ".join(rng.choice(vocabulary, n))
        h = np.sort(np.array([xxhash.xxh64_intdigest(t, 7) for t in imatch.terms_of(text)], np.uint64))
        h = kept if len(kept := h[np.isin(h, lexicon)]) else h
        orders = ["".join(xxhash.xxh64_hexdigest(h[r >= s].tobytes())[: imatch.DIGITS] for s in range(1, int(r.max()) + 1)) or "-" for r in imatch._ranks(h)]
        assert imatch.fingerprint(text, lexicon, hasher) == " ".join([xxhash.xxh64_hexdigest(h.tobytes()), *orders])
