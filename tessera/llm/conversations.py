"""Conversation structure repair: the cheapest edits that make the roles of a conversation read ``(s?(ua)+)?``.

A turn counts only by its role's initial and its fault, so that many conversations are one signature. Distinct signatures are sorted over all tasks;
a task reads them as the paths of a prefix trie and computes one layer of the dynamic program for each node, however many signatures share it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Workspace, fits

#: What an edit costs, and what a truncated turn that stays costs besides.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

#: Symbols of a signature: s, u, a or o for the role's initial; capitals for truncated turns, and # for those that must go.
FORCED = "#"

#: States: nothing yet, after s, after u, after a. The role that an inserted or changed turn gets in each, and the state after it.
NEXT = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
STAY = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
ACCEPTED = (0, 3)


def _inserted(state: int, n: int) -> int:
    for _ in range(n):
        state = NEXT[state][1]
    return state


def _steps(symbol: str) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, edits): the least way from state to state over one turn, inserts before it included."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    truncated = TRUNCATED if symbol.isupper() else 0
    for p in range(4):
        for n in range(4):
            at = _inserted(p, n)
            ways = [(at, DELETE, "D")]
            if symbol != FORCED:
                ways.append((NEXT[at][1], REROLE + truncated, "R"))
                if (at, symbol.lower()) in STAY:
                    ways.append((STAY[at, symbol.lower()], KEEP + truncated, "K"))
            for q, cost, edit in ways:
                way = (cost + n * INSERT, "I" * n + edit)
                best[p, q] = min(best.get((p, q), way), way)
    return [(p, q, *way) for (p, q), way in best.items()]


STEPS = {s: _steps(s) for s in "suaoSUAO#"}

#: A layer has for each state (cost, rank, state before, edits), or None. Ranks order the edit strings of one layer: each ends with the edit
#: of the same turn, so that none begins another of equal number of turns, and what follows cannot change their order.
ROOT = ((0, 0, 0, ""), None, None, None)


def layer(before: tuple, symbol: str) -> tuple:
    best: list[tuple | None] = [None] * 4
    for p, q, cost, edits in STEPS[symbol]:
        if (at := before[p]) is not None:
            way = (at[0] + cost, at[1], edits, p)
            if best[q] is None or way < best[q]:
                best[q] = way
    order = sorted((w[1], w[2], q) for q, w in enumerate(best) if w)
    rank = {q: i for i, (_, _, q) in enumerate(order)}
    return tuple(w and (w[0], rank[q], w[3], w[2]) for q, w in enumerate(best))


def answer(path: list[tuple]) -> tuple[int, str]:
    """Cost and edits of the signature whose layers these are, the root's first."""
    ends = []
    for p, at in enumerate(path[-1]):
        if at is not None:
            n = next(n for n in range(3) if _inserted(p, n) in ACCEPTED)
            ends.append((at[0] + n * INSERT, at[1], n, p))
    cost, _, n, state = min(ends)
    edits = ["I" * n]
    for at in reversed(path[1:]):
        edits.append(at[state][3])
        state = at[state][2]
    return cost, "".join(reversed(edits))


def repairs(signatures: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, audit) of sorted signatures; the layers of a prefix stay while the next signature has it."""
    path, last = [ROOT], ""
    for signature in signatures:
        shared = 0
        for a, b in zip(last, signature):
            if a != b:
                break
            shared += 1
        del path[shared + 1 :]
        for symbol in signature[shared:]:
            path.append(layer(path[-1], symbol))
        last = signature
        yield signature, *answer(path)


def applied(turns: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired turns."""
    state, turns = 0, iter(turns)
    for edit in audit:
        if edit == "I":
            role, state = NEXT[state]
            yield edit, role, ""
            continue
        role, text = next(turns)
        if edit == "K":
            state = STAY[state, role[:1]]
            yield edit, role, text
        elif edit == "R":
            role, state = NEXT[state]
            yield edit, role, text


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy) after damage by crc32(`conv_id:turn`) % 20: 0 drops the row (its role is then null, so that its conversation is still known), 1 empties the text,
    2 takes its ``.!?``, 3 repeats the row, 4 makes its role user. Null roles and texts, and null numbers in the key, are one space."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), filled[2].alias("role"), filled[3].alias("text"), (F.crc32(F.concat(filled[0], F.lit(":"), filled[1]).cast("binary")) % 20).alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 0, F.lit(None)).when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), F.when(F.col("harm") > 0, text).alias("text"), copies)


def _digest() -> Column:
    """Of role and text: it tells duplicates and orders turns of one number."""
    return F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))


def _symbol() -> Column:
    """The role's initial, capital if the text is truncated; # for blank turns; null for rows that only name their conversation."""
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return F.when(F.col("role").isNotNull(), F.when(blank, F.concat(F.lit(FORCED), initial)).when(whole, initial).otherwise(F.upper(initial)))


MARKS = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"


class Repair:
    """The audit of all conversations of (conv_id, turn, role, text).

    Turns are taken by number, nulls first; those of one number by a digest of role and text, repeated rows beside each other. A conversation's rows pass
    through one task one after the other, sorted by Spark; of each a symbol and a digest are held, and no text. Null conv_ids are one conversation. A role that is neither s, u nor a in its first
    letter (an empty one too) cannot be kept. Rows whose role is null only name their conversation. Other columns are not read; no rows give no rows.

    ``report``: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), a row for each conversation. ``rows``: the repaired turns. ``digests``: their hashes."""

    def __init__(self, turns: DataFrame) -> None:
        self.ws = Workspace(turns.sparkSession, "repair")
        self.turns = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "copy").withColumn("digest", _digest())
        self.kind, self.arrow = turns.schema["conv_id"].dataType.simpleString(), to_arrow_type(turns.schema["conv_id"].dataType)
        marked = self.ws.table(self._marked(), "marked")
        found = marked.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(_answers, "signature string, cost long, audit string")
        found = self.ws.table(found, "answers")
        held = F.octet_length("signature") + F.octet_length("audit")
        self.report = self.ws.table(marked.join(fits(found, 200_000, held), "signature").drop("signature"), "report")

    def _marked(self) -> DataFrame:
        light = self.turns.select("conv_id", "turn", "copy", "digest", _symbol().alias("symbol"))
        rows = light.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "digest", "copy").select("conv_id", "turn", "digest", "symbol")
        return rows.mapInArrow(_marks, MARKS.format(id=self.kind))

    def _walked(self, run, schema: str) -> DataFrame:
        head = self.report.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("copy"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
        body = self.turns.where(F.col("role").isNotNull()).select("conv_id", F.lit(1).alias("part"), "turn", "digest", "copy", "role", "text")
        rows = head.unionAll(body).repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "digest", "copy")
        return rows.select("conv_id", "part", "role", "text").mapInArrow(run, schema)

    def rows(self) -> DataFrame:
        """(conv_id, place, edit, role, text): the repaired turns in order, from place 0."""

        kind = self.arrow

        def run(batches):
            for conv, turns in _conversations(batches):
                part: list[tuple] = []
                for place, (edit, role, text) in enumerate(applied(turns, next(turns)[1])):
                    part.append((place, edit, role, text))
                    if len(part) == 4096:
                        yield made(conv, part)
                        part = []
                if part:
                    yield made(conv, part)

        def made(conv, part):
            place, edit, role, text = zip(*part)
            return pa.RecordBatch.from_arrays([pa.array([conv] * len(part), kind), pa.array(place, pa.int64()), pa.array(edit), pa.array(role), pa.array(text)], names=["conv_id", "place", "edit", "role", "text"])

        return self._walked(run, f"conv_id {self.kind}, place long, edit string, role string, text string")

    def digests(self) -> DataFrame:
        """(conv_id, repaired_sha256) of the repaired ``role:text``, joined by line ends."""

        kind = self.arrow

        def run(batches):
            ids, out = [], []
            for conv, turns in _conversations(batches):
                h = hashlib.sha256()
                for place, (_, role, text) in enumerate(applied(turns, next(turns)[1])):
                    h.update(f"{chr(10) if place else ''}{role}:{text}".encode())
                ids.append(conv)
                out.append(h.hexdigest())
                if len(ids) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(out)], names=["conv_id", "repaired_sha256"])
                    ids, out = [], []
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(out)], names=["conv_id", "repaired_sha256"])

        return self._walked(run, f"conv_id {self.kind}, repaired_sha256 string")


def _conversations(batches) -> Iterator[tuple]:
    """(conv_id, its (role, text) pairs) of rows sorted by conversation, whose first row (part 0) has the audit as its text. Each must be read to its end."""
    rows = ((c, p, r, t) for b in batches for c, p, r, t in zip(*[b.column(i).to_pylist() for i in range(4)]))
    ahead = next(rows, None)

    def mine():
        nonlocal ahead
        yield ahead[2:]
        while (ahead := next(rows, None)) is not None and ahead[1]:
            yield ahead[2:]

    while ahead is not None:
        conv, turns = ahead[0], mine()
        yield conv, turns
        for _ in turns:  # deleted turns at the end
            pass


def _marks(batches):
    """One row for each conversation of sorted (conv_id, turn, digest, symbol)."""
    out: list[tuple] = []
    conv, begun = None, False
    symbols: list[str] = []
    seen: set[bytes] = set()
    counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    first = turn_before = initial_before = kind = None
    numbers = 0

    def close():
        gaps = turn_before - first + 1 - numbers if numbers else 0
        out.append((conv, gaps, *counts.values(), "".join(symbols)))

    for b in batches:
        kind = b.column(0).type
        for c, turn, digest, symbol in zip(*[b.column(i).to_pylist() for i in range(4)]):
            if not begun or c != conv:
                if begun:
                    close()
                conv, begun, symbols, seen, numbers = c, True, [], set(), 0
                counts = dict.fromkeys(counts, 0)
                first = turn_before = initial_before = None
            if symbol is None:
                continue
            if turn is not None and turn != turn_before:
                first = turn if first is None else first
                turn_before = turn
                numbers += 1
            initial = symbol[-1].lower()
            if initial_before is not None and initial_before + initial not in ("su", "ua", "au"):
                counts["illegal"] += 1
            initial_before = initial
            if symbol[0] == FORCED:
                counts["blank"] += 1
            elif digest in seen:
                counts["duplicate"] += 1
                symbol = FORCED
            elif symbol.isupper():
                counts["truncated"] += 1
            seen.add(digest)
            symbols.append(symbol[0])
        if len(out) > 4096:
            yield _marked_batch(out, kind)
            out.clear()
    if begun:
        close()
    if out:
        yield _marked_batch(out, kind)


def _marked_batch(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "signature"]
    return pa.RecordBatch.from_arrays([pa.array(c, None if i else kind) for i, c in enumerate(zip(*out))], names=names)


def _answers(batches):
    signatures = (s for b in batches for s in b.column(0).to_pylist())
    part: list[tuple] = []
    for row in repairs(signatures):
        part.append(row)
        if len(part) == 1024:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], names=["signature", "cost", "audit"])
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], names=["signature", "cost", "audit"])
