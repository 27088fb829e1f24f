"""Conversation repair against a search over all edits."""

import functools
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tessera.llm.conversations import Repair, damaged, repairs

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(turns):
    """turns: (initial, truncated, forced). Least (cost, audit) by trying, from each turn and role string's end, every next edit."""

    @functools.lru_cache(None)
    def best(i, last, inserts):
        ways = []
        if i == len(turns) and last in ("", "a"):
            ways.append((0, ""))
        new = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
        if inserts < 3:
            cost, rest = best(i, new, inserts + 1)
            ways.append((cost + 3, "I" + rest))
        if i < len(turns):
            initial, truncated, forced = turns[i]
            cost, rest = best(i + 1, last, 0)
            ways.append((cost + 4, "D" + rest))
            if not forced:
                more = 3 if truncated else 0
                cost, rest = best(i + 1, new, 0)
                ways.append((cost + 3 + more, "R" + rest))
                if last + initial in ("s", "u", "su", "ua", "au"):
                    cost, rest = best(i + 1, initial, 0)
                    ways.append((cost + more, "K" + rest))
        return min(ways, default=(10**9, ""))

    for i in range(len(turns), 0, -1):  # from the end, so that no call goes deep
        for last in ("", "s", "u", "a"):
            best(i, last, 0)
    return best(0, "", 0)


def brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        mine = convs[conv]
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(key.encode()) % 20
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        role = "user" if harm == 4 else role
        mine += [(turn, role, text)] * (2 if harm == 3 else 1)
    out = []
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
        n = {"blank": 0, "duplicate": 0, "truncated": 0}
        turns = []
        for i, (_, role, text) in enumerate(mine):
            body = text.rstrip(" \t\n\r\x0b\x0c")
            fault = "blank" if not body else "duplicate" if (role, text) in [r[1:] for r in mine[:i]] else "truncated" if body[-1] not in ".!?" else ""
            if fault:
                n[fault] += 1
            turns.append((role[:1] or " ", fault == "truncated", fault in ("blank", "duplicate")))
        numbers = {t for t, _, _ in mine if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit = cheapest(tuple(turns))
        lines, last, at = [], "", iter(mine)
        for e in audit:
            new = {"": "user", "s": "user", "u": "assistant", "a": "user"}[last]
            role, text = (new, "") if e == "I" else next(at)[1:]
            role = new if e == "R" else role
            if e != "D":
                lines.append(f"{role}:{text}")
                last = role[:1]
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def answers(spark, rows, extra="", more=()):
    found = Repair(damaged(spark.createDataFrame([(*r, *more) for r in rows], SCHEMA + extra)))
    digests = {r.conv_id: r.repaired_sha256 for r in found.digests().collect()}
    order = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    got = [(*(r[c] for c in order), digests[r.conv_id]) for r in found.report.collect()]
    assert len(digests) == len(got)
    return sorted(got, key=lambda r: (r[0] is not None, r[0] or 0)), found


def test_trie_answers_equal_search():
    rng = random.Random(3)
    signatures = {"".join(rng.choice("suaoSUAO##uaua") for _ in range(rng.randrange(0, 9))) for _ in range(1500)} | {"ua" * 60 + "s", "#" * 40, "s" * 12}
    for s, cost, audit in repairs(iter(sorted(signatures))):
        turns = tuple((c.lower() if c != "#" else "o", c.isupper(), c == "#") for c in s)
        assert (cost, audit) == cheapest(turns), s


def _some(n, seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why?", "cut off", "", " \n\t", "a.b", "end. ", "Übrig…", None, "more"]
    return [(rng.randrange(n // 5), rng.choice([None, *range(6), 9, -4]), rng.choice(["user", "assistant", "system", "tool", "", None, "ünder"]), rng.choice(texts)) for _ in range(n)]


def test_conversations_equal_search(spark):
    rows = _some(600, 1)
    assert answers(spark, rows)[0] == brute(rows)


def test_nulls_dropped_conversations_long_texts_and_clashing_columns(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (None, None, None, None), (dropped, 0, "user", "gone."), (5001, 7, "user", "x" * 300_000 + "."), (5001, 8, "assistant", "y. " * 90_000)]
    rows += [(6000 + i, 1 + j, "user" if j % 2 else "assistant", f"{j}.") for i in range(3) for j in range(700)]
    got, found = answers(spark, rows, ", copy int, digest string, part int, audit string, harm int", (9, "d", 1, "DDD", 3))
    assert got == brute([r for r in rows if r[0] is None or r[0] < 6000] + [r for r in rows if (r[0] or 0) >= 6000])
    repaired = found.rows().where("conv_id = 6001").orderBy("place").collect()
    assert [r.place for r in repaired] == list(range(len(repaired))) and {r.role for r in repaired[::2]} == {"user"}


def test_empty_table(spark):
    got, found = answers(spark, [])
    assert got == [] and found.rows().collect() == []


@pytest.mark.parametrize("parts", [1, 5])
def test_conversations_that_share_one_signature(spark, parts):
    rows = [(i, j, "user" if j % 2 == 0 else "assistant", f"{i} {j}.") for i in range(200) for j in range(4)]
    found = Repair(damaged(spark.createDataFrame(rows, SCHEMA).repartition(parts)))
    assert {(r.cost, r.audit) for r in found.report.collect()} == {(c, a) for *_, c, a, _ in brute(rows)}
