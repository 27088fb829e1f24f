"""Exact byte-level BPE by dynamic programming over prefixes, and decoding.

BPE gives every prefix of a piece one last token. A token t that ends at byte i is the last one of that prefix just if
the last token p of the prefix before t is compatible with t: merging the two tokens' text gives p, t again. So one
pass over the bytes finds each prefix's last token among the vocabulary's tokens that are suffixes of it, and the
back-pointers give the ids. The automaton's suffix links list those tokens, and pair tests are memoised.
"""

from __future__ import annotations

import hashlib
import json
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_by_worker

#: The byte-level pre-tokenizer's pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks that start with one blank after a non-blank are split off alike in any text.
CHUNKS = re.compile(r"(?<=\S)(?= \S)")
CACHED, CACHE_CHARS = 600_000, 48
#: Chunks whose number of ids is remembered.
COUNTED = 1_200_000
#: Pieces of at most so many bytes are counted in blocks, by their merges; a block's pieces, and letters of texts that are counted at once.
MERGED, BLOCK, AT_ONCE = 32, 4096, 4_000_000


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable Latin-1, else from U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library without normalizer."""

    def __init__(self, spec: str) -> None:
        j = json.loads(spec)
        pre, model = j["pre_tokenizer"], j["model"]
        odd = [j["normalizer"], pre.get("add_prefix_space"), model.get("ignore_merges"), model.get("dropout"), model.get("byte_fallback")]
        if pre["type"] != "ByteLevel" or model["type"] != "BPE" or any(odd):
            raise ValueError("only plain byte-level BPE is supported")
        letters = byte_alphabet()
        self.letters = {b: c for b, c in enumerate(letters)}
        to_byte = {c: b for b, c in enumerate(letters)}
        vocab: dict[str, int] = model["vocab"]
        self.bytes_of = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items()}
        self.added = {a["content"]: a["id"] for a in j.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        #: rank of the merge that forms a token, its two parts, and the rank of merging a pair
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank[x, y] = r
            if z not in self.parts:
                self.parts[z], self.made[z] = (x, y), r
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            if len(t) == 1 or i in self.parts:
                self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.pieces = regex.compile(PATTERN)
        self.specials = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.pairs: dict[tuple[int, int], bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.cache: dict[str, bytes] = {}  # of chunks and of pieces: both bounded
        self.known: dict[str, bytes] = {}
        self.counts: dict[str, int] = {}
        #: The merges as arrays: pairs (left << 32 | right) in order with their ranks, the token that each rank makes, tokens of the 256 bytes' letters, the ranks of their pairs.
        pairs = sorted((x << 32 | y, r) for (x, y), r in self.rank.items())
        self.merges, self.ranks = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
        self.makes = np.zeros(len(model["merges"]), np.int64)
        for z, r in ((vocab[a + b], r) for r, m in enumerate(model["merges"]) for a, b in [m if isinstance(m, list) else m.split(" ")]):
            self.makes[r] = z
        self.single = np.full(0x200, -1, np.int64)
        for c in letters:
            self.single[ord(c)] = vocab.get(c, -1)
        self.whole = len(pairs) > 0 and all(c in vocab for c in letters)

    @classmethod
    def shared(cls, spec: str) -> Bpe:
        """One for all tasks that a Python worker runs."""
        return kept_by_worker(("bpe", spec), lambda: cls(spec))

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that the token's text has on this side while it is merged (0: left, 1: right), each with the
        rank of the merge that ends it."""
        if (got := self.edges.get((token, side))) is None:
            got, t = [(token, float("inf"))], token
            while t in self.parts:
                ends, t = self.made[t], self.parts[t][side]
                got.append((t, ends))
            self.edges[token, side] = got
        return got

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves the text of a, b as these two tokens. A merge across the border happens if its rank comes before
        the border token on the left goes into a merge of its own (of equal ranks the left one comes first), and no later than on the right."""
        if (got := self.pairs.get((a, b))) is None:
            rank, left, right = self.rank.get, self.edge(a, 1), self.edge(b, 0)
            got = True
            for x, ex in left:
                for y, ey in right:
                    r = rank((x, y))
                    if r is not None and r < ex and r <= ey:
                        got = False
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[a, b] = got
        return got

    def _text(self, piece: str) -> str:
        """A piece's bytes as the vocabulary writes them; printable ASCII but the blank stands for itself."""
        if piece.isascii() and piece.isprintable():
            return piece.replace(" ", self.letters[32])
        letters = self.letters
        return "".join([letters[b] for b in piece.encode("utf-8", "surrogatepass")])

    def encode_piece(self, piece: str) -> list[int]:
        return self._ids(self._text(piece))

    def _ids(self, text: str) -> list[int]:
        n = len(text)
        last, length = [-1] * (n + 1), [0] * (n + 1)
        pairs, compatible = self.pairs.get, self.compatible
        for end, (token, size) in self.automaton.iter(text):  # every token that ends here, by the suffix links
            end += 1
            if last[end] < 0:
                p = last[end - size]
                if size == end or p >= 0 and ((ok := pairs((p, token))) or ok is None and compatible(p, token)):
                    last[end], length[end] = token, size
        ids, at = [], n
        while at > 0:
            ids.append(last[at])
            at -= length[at]
        return ids[::-1]

    def _pieces(self, chunk: str) -> list[bytes]:
        """The ids of each piece of a chunk."""
        known, out = self.known, []
        for p in self.pieces.findall(chunk):
            if (got := known.get(p)) is None:
                got = b"".join([i.to_bytes(4, "little") for i in self.encode_piece(p)])
                if len(p) <= CACHE_CHARS:
                    if len(known) >= CACHED:
                        known.clear()
                    known[p] = got
            out.append(got)
        return out

    def _counted(self, chunk: str) -> int:
        """The number of a chunk's ids; those of its pieces are remembered apart, as words come with many marks."""
        known, n = self.counts, 0
        word = chunk[1:] if chunk[:1] == " " else chunk
        whole = word.isascii() and word.isalpha()  # ASCII letters, after a blank or none, are one piece
        for p in [chunk] if whole else self.pieces.findall(chunk):
            if (got := known.get(p)) is None:
                got = len(self.encode_piece(p))
                if len(p) <= CACHE_CHARS:
                    known[p] = got
            n += got
        return n

    def _chunk(self, chunk: str) -> bytes:
        out = self._pieces(chunk)
        out = b"".join(out)
        if len(chunk) <= CACHE_CHARS:
            if len(self.cache) >= CACHED:
                self.cache.clear()
            self.cache[chunk] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.specials is None:
            return self._plain(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self._plain(text[at : m.start()]), self.added[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])]) if at else self._plain(text)

    def _plain(self, text: str) -> bytes:
        cache, chunk = self.cache, self._chunk
        return b"".join([cache.get(c) or chunk(c) for c in CHUNKS.split(text)])

    def count(self, text: str) -> int:
        """The number of ids, without making the whole list of them."""
        if self.specials is not None and self.specials.search(text):
            return len(self.encode(text)) // 4
        chunks = CHUNKS.split(text)
        counts = list(map(self.counts.get, chunks))
        if None in counts:
            if len(self.counts) > COUNTED:
                self.counts.clear()
            for i in [i for i, n in enumerate(counts) if n is None]:
                counts[i] = n = self._counted(chunks[i])
                if len(chunks[i]) <= CACHE_CHARS:
                    self.counts[chunks[i]] = n
        return sum(counts)

    def count_all(self, texts: list[str]) -> list[int]:
        """``count`` of each text. Pieces that are new are counted together, by their merges."""
        out, first, size = [], 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size > AT_ONCE or i == len(texts) - 1:
                out += self._count_some(texts[first : i + 1])
                first, size = i + 1, 0
        return out

    def _count_some(self, texts: list[str]) -> list[int]:
        if len(self.counts) > COUNTED:
            self.counts.clear()
        known, out, left, new = self.counts, [], [], {}
        for i, t in enumerate(texts):
            if self.specials is not None and self.specials.search(t):
                out.append(len(self.encode(t)) // 4)
                continue
            chunks = CHUNKS.split(t)
            counts = list(map(known.get, chunks))
            if None in counts:
                at = [j for j, n in enumerate(counts) if n is None]
                mine = [chunks[j] for j in at]
                new.update(dict.fromkeys(mine))
                left.append((i, mine))
                out.append(sum([n for n in counts if n is not None]))
            else:
                out.append(sum(counts))
        pieces: dict[str, int | None] = {}
        for chunk in new:
            word = chunk[1:] if chunk[:1] == " " else chunk
            new[chunk] = [chunk] if word.isascii() and word.isalpha() else self.pieces.findall(chunk)
            pieces.update([(p, known.get(p)) for p in new[chunk]])
        fresh = [p for p, n in pieces.items() if n is None]
        for p, n in zip(fresh, self._merged([self._text(p) for p in fresh])):
            pieces[p] = n
            if len(p) <= CACHE_CHARS:
                known[p] = n
        for chunk, parts in new.items():
            new[chunk] = n = sum([pieces[p] for p in parts])
            if len(chunk) <= CACHE_CHARS:
                known[chunk] = n
        for i, mine in left:
            out[i] += sum([new[c] for c in mine])
        return out

    def _merged(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text in the vocabulary's letters. In all texts of a block the merge of least rank, the leftmost of equals, is done at once, until no pair merges."""
        sizes = np.array([len(t) for t in texts], np.int64)
        out, short = sizes.copy(), sizes <= (MERGED if self.whole else 0)
        for i in np.flatnonzero(~short).tolist():
            out[i] = len(self._ids(texts[i]))
        order = np.flatnonzero(short & (sizes > 1))
        order = order[np.argsort(sizes[order], kind="stable")]
        for at in range(0, len(order), BLOCK):
            rows = order[at : at + BLOCK]
            n = sizes[rows]
            width = int(n[-1])
            there = np.arange(width) < n[:, None]
            symbols = np.full((len(rows), width), -1, np.int64)
            symbols[there] = self.single[np.frombuffer("".join([texts[i] for i in rows.tolist()]).encode("utf-32-le"), np.uint32)]
            ranks = self._ranked(symbols[:, :-1], symbols[:, 1:])
            while len(rows):
                best = ranks.argmin(1)
                rank = ranks[np.arange(len(rows)), best]
                live = rank < len(self.makes)
                if not live.all():
                    rows, symbols, ranks, best, rank = rows[live], symbols[live], ranks[live], best[live], rank[live]
                if not len(rows):
                    break
                out[rows] -= 1
                each, places = np.arange(len(rows)), np.arange(symbols.shape[1])
                later = np.minimum(places + (places > best[:, None]), places[-1])
                symbols = np.take_along_axis(symbols, later, 1)
                symbols[:, -1] = -1
                symbols[each, best] = self.makes[rank]
                ranks = np.take_along_axis(ranks, later[:, :-1].clip(0, ranks.shape[1] - 1), 1)
                ranks[:, -1] = len(self.makes)
                before = np.maximum(best - 1, 0)
                ranks[each, before] = self._ranked(symbols[each, before], symbols[each, before + 1])
                after = np.minimum(best, ranks.shape[1] - 1)
                ranks[each, after] = self._ranked(symbols[each, after], symbols[each, after + 1])
        return out.tolist()

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of merging each pair; one over all ranks where it does not merge (-1: nothing there)."""
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.merges, pair), len(self.merges) - 1)
        return np.where((self.merges[at] == pair) & (left >= 0) & (right >= 0), self.ranks[at], len(self.makes))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I").tolist())).decode("utf-8", "replace")


def vocabulary(path: str | None = None) -> str:
    """The text of a vocabulary file; without a path, of the public 50k byte-level one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary, decoded string), a row for each row: ids as little-endian unsigned 32-bit integers. Null texts are empty; texts of any
    length are encoded whole; other columns, whatever their names, are not read; an empty table gives no rows.

    The vocabulary file's text goes out once per executor as a broadcast variable: a few MB at any size of the corpus.
    Each document is encoded where it is read; nothing is shuffled."""
    shipped = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        bpe = Bpe.shared(shipped.value)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([bpe.decode(i) for i in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, decoded string")


def digest(ids: bytes) -> str:
    return hashlib.sha256(ids).hexdigest()
