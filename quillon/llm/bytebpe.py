"""Byte-level BPE encoding and decoding by longest matches and compatible neighbours.

The bytes of a piece are read as Latin-1, so that an Aho-Corasick automaton of the vocabulary's tokens finds the longest
token at every place in one pass. The encoder takes the longest token where it stands, as long as it is compatible with the
token before: two tokens are, where the merges of their joined bytes give just these two, which the merges that make either
end show. Else it tries the next shorter
token that begins alike, and where none is left it takes the last token back. A sequence whose neighbours are all compatible
is the sequence that the merges give, and there is only one for each prefix of a piece; so a place from which no token leads
on is closed for good, and the work is linear in the piece. Compatibility is memoised by pair. Tokens that their own bytes
don't merge into are no part of the automaton; they stand only for a piece that equals them, as in the library.

Texts are split by the vocabulary's pattern. Where the two regular-expression engines hold a character for different things
(their Unicode tables differ), the library's class decides: the text is split with a stand-in of that class in its place.
A worker keeps the ids of pieces, compatible pairs and the automaton between tasks, each in a memory of bounded size.

The vocabulary file is a parameter. Workers read it where it lies (an installed package); it is not copied.

Defined results: null counts as empty; an empty text has no ids and decodes to the empty text; a text that is one piece is
encoded whole however long; repeated rows are encoded alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.bpe import _gather, vocabulary
from quillon.llm.grams import slices, tidy

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHED, PAIRS = 250_000, 500_000  # pieces in either half of a worker's cache; pairs whose compatibility is kept
LONG = 1 << 20  # characters of a text from which its pieces are taken in portions


class Known(dict):
    """Ids of pieces. A full half becomes the older one; what is asked for again moves back."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHED:
            self.older = dict(self)
            self.clear()
        self[piece] = found = self.older.get(piece) or self.make(piece)
        return found


class Codec:
    """One worker's vocabulary."""

    def __init__(self, path: str, pattern: str | None = None):
        import ahocorasick
        import public_tokenizers
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if missing := [k for k in range(256) if bytes([k]) not in self.ranks]:
            raise ValueError(f"the vocabulary lacks the bytes {missing}")
        self.token = {i: t for t, i in self.ranks.items()}
        self.pattern = regex.compile(pattern or public_tokenizers.PATTERN)
        self.beyond_ascii = regex.compile(r"[^\x00-\x7f]")
        self.split: dict[int, tuple[int, int]] = {}  # the two tokens whose merge makes a token
        sound = {t for t, i in self.ranks.items() if len(t) == 1 or self.merged(t) == [i]}
        self.automaton = ahocorasick.Automaton()
        for t in sound:
            self.automaton.add_word(t.decode("latin-1"), (self.ranks[t], len(t) - 1))
        self.automaton.make_automaton()
        self.size = [len(self.token.get(i, b"")) for i in range(max(self.token) + 1)]
        self.shorter = {self.ranks[t]: next((self.ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in sound), None) for t in sound}
        self.pairs: dict[int, bool] = {}
        self.known = Known(lambda piece: array("I", self.piece_ids(piece.encode())).tobytes())

    def merged(self, piece: bytes) -> list[int]:
        """Ids by the merges themselves, the lowest rank first; of a piece that ends as one token, its split is noted."""
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 62), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 62:
                break
            if len(parts) == 2:
                self.split[rank] = self.ranks[parts[0]], self.ranks[parts[1]]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def spine(self, token: int, side: int) -> list[tuple[bytes, int, int]]:
        """What stands at one end of a token while it is made, the last first: bytes, and the merges that begin and end it."""
        out, until = [], 1 << 62
        while True:
            parts = self.split.get(token)
            born = -1 if parts is None else token
            out.append((self.token[token], born, until))
            if parts is None:
                return out
            token, until = parts[side], token

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges of both tokens' bytes leave the border between them: no merge over it comes before one that
        ends its left or its right neighbour. Of equal merges the left one comes first."""
        for x, x_born, x_until in self.spine(a, 1):
            for y, y_born, y_until in self.spine(b, 0):
                if y_born < x_until and x_born <= y_until:  # both stand there at some time
                    rank = self.ranks.get(x + y)
                    if rank is not None and rank < x_until and rank <= y_until:
                        return False
        return True

    def piece_ids(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return self.walk(piece) if whole is None else [whole]

    def walk(self, piece: bytes) -> list[int]:
        longest = [0] * len(piece)
        for last, (token, more) in self.automaton.iter(piece.decode("latin-1")):
            longest[last - more] = token  # of one place, the longer matches end later
        pairs, size, shorter = self.pairs, self.size, self.shorter
        if len(pairs) > PAIRS:
            pairs.clear()
        leads_on = bytearray(b"\1") * (len(piece) + 1)
        out: list[int] = []
        at, token, end = 0, longest[0] if piece else None, len(piece)
        while at < end:
            while token is not None:
                if leads_on[at + size[token]]:
                    if not out:
                        break
                    key = out[-1] << 32 | token
                    fits = pairs.get(key)
                    if fits is None:
                        fits = pairs[key] = self.compatible(out[-1], token)
                    if fits:
                        break
                token = shorter[token]
            if token is None:
                leads_on[at] = 0
                token = out.pop()
                at -= size[token]
            else:
                out.append(token)
                at += size[token]
                token = longest[at] if at < end else None
        return out

    @cached_property
    def stand_ins(self) -> dict[int, str]:
        """Characters whose class differs between the engines, each with a character of the class that the library gives it."""
        import regex
        import tiktoken

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        single = {bytes([k]): k for k in range(256)}
        theirs = lambda c: set(bytes(tiktoken.Encoding("class", pat_str=c, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode())
        sets = {stand: (theirs(c), set(regex.findall(c, every))) for stand, c in (("x", r"\p{L}"), ("1", r"\p{N}"), (" ", r"\s"))}
        differ = set().union(*(a ^ b for a, b in sets.values()))
        return {ord(c): next((stand for stand, (a, _) in sets.items() if c in a), "!") for c in differ}

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The matches of the pattern in order, all at once or, of a long text, in portions."""
        seen = text
        if self.beyond_ascii.search(text) and not self.stand_ins.keys().isdisjoint(map(ord, set(text))):
            seen = text.translate(self.stand_ins)
        if seen is text and len(text) < LONG:
            yield self.pattern.findall(text)
            return
        found = self.pattern.finditer(seen)
        while portion := [text[m.start() : m.end()] for m in islice(found, 1 << 16)]:
            yield portion

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(b"".join(map(self.known.__getitem__, portion)) for portion in self.pieces(text))

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all tokens, and where each starts and how long it is."""
        raw = [self.token.get(i, b"") for i in range(max(self.token) + 1)]
        size = np.array([len(r) for r in raw], np.int64)
        return np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size

    def decode(self, ids: np.ndarray) -> bytes:
        held, start, size = self.table
        return _gather(held, start[ids], size[ids]).tobytes()


_codecs: dict[tuple[str, str | None], Codec] = {}


def codec(path: str, pattern: str | None = None) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """id, ids (array of int) and the text decoded from them; with `digests` their count and SHA-256 values instead."""
    path = path or vocabulary(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            for lo, hi, _, _ in slices(b.column(1)):
                done: list[list] = [[], [], []]
                for text in b.column(1).slice(lo, hi - lo).to_pylist():
                    ids = np.frombuffer(c.encode(text or ""), "<u4")
                    back = c.decode(ids)
                    if digests:
                        row = len(ids), hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest(), hashlib.sha256(back).hexdigest()
                    else:
                        row = ids.astype(np.int32), back.decode(errors="replace")
                    for held, value in zip(done, row, strict=False):
                        held.append(value)
                keys = b.column(0).slice(lo, hi - lo)
                if digests:
                    yield pa.RecordBatch.from_arrays([keys, pa.array(done[0], pa.int64()), pa.array(done[1], pa.string()), pa.array(done[2], pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([keys, pa.array(done[0], pa.list_(pa.int32())), pa.array(done[1], pa.string())], [id_col, "ids", "decoded"])

    shape = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {dict(docs.dtypes)[id_col]}, {shape}")


def decode(rows: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and the text of arrays of ids (null: the empty text); bytes that are no UTF-8 become U+FFFD, as in the library."""
    path = path or vocabulary(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = [c.decode(np.array([i for i in ids or [] if i is not None], np.int64)).decode(errors="replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, "decoded"])

    return rows.select(id_col, ids_col).mapInArrow(tidy(run), f"`{id_col}` {dict(rows.dtypes)[id_col]}, decoded string")


def query(docs: DataFrame) -> DataFrame:
    return encode(docs, digests=True)
