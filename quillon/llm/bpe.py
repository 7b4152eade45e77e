"""BPE encoding and decoding with reuse of content-defined chunks.

A text is cut into chunks where a word begins for which a rolling hash over the WINDOW words before it lies below a bound (one
word in 1 / SHARE), so that passages which documents share give equal chunks wherever they stand. A worker encodes a chunk once and keeps its
ids in a cache of bounded size that outlives its tasks; texts are put together from chunks. Every join of two chunks is
checked: the characters about it, with the whole run of blanks between, must be split there by the vocabulary's own
pre-tokeniser, and be encoded alike together and apart. Where that does not hold, wider and wider windows are tried; where
none agrees up to the ends of the two chunks, these become one chunk that is encoded anew and whose joins are checked in
turn. Chunks are told apart by their bytes. A chunk that is new is put together from its words in the same way: a word, with the
blanks behind it, is encoded once a worker, and where two words do not agree at their join the chunk is encoded whole. Ids are decoded as the library does it for a vocabulary without decoder, by
tokens with blanks between them; for a vocabulary that has a decoder the library decodes each text.

The vocabulary file is a parameter. Workers read it where it lies (an installed package); it is not copied.

Defined results: null counts as empty; an empty text has no ids and decodes to the empty text; a text without blanks is
one chunk however long; repeated rows are encoded alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.grams import _STEPS, Texts, mix, slices, tidy

SHARE, WINDOW = 1 / 16, 4  # of words that begin a chunk; words that decide it
CACHED, WORDS = 50_000, 250_000  # chunks and words in a worker's caches
VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start:start + size] of every entry, one after another."""
    ends = np.cumsum(size)
    at = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    some = np.flatnonzero(size)
    if len(some):
        at[0] = start[some[0]]
        at[ends[some[:-1]]] = start[some[1:]] - (start[some[:-1]] + size[some[:-1]] - 1)
    return flat[np.cumsum(at)]


class Codec:
    """One worker's tokenizer, chunk cache and join checks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, bytes] = {}  # ids of chunks, as little-endian unsigned 32-bit integers
        self.words: dict[bytes, bytes] = {}  # of words with the blanks behind them
        self.agreed: dict[tuple[bytes, bytes], bool] = {}
        self._pieces = None

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all tokens with a blank behind each, and where each starts and how long it is."""
        if self._pieces is None:
            raw = [((self.tokenizer.id_to_token(i) or "") + " ").encode() for i in range(self.tokenizer.get_vocab_size())]
            size = np.array([len(r) for r in raw], np.int64)
            self._pieces = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size
        return self._pieces

    def raw_ids(self, text: bytes) -> list[int]:
        return self.tokenizer.encode(text.decode(), add_special_tokens=False).ids

    def look_up(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of the chunks; those that the cache lacks are encoded, each once."""
        new = [c for c in dict.fromkeys(chunks) if c not in self.known]
        if len(self.known) + len(new) > CACHED:
            self.known = {c: self.known[c] for c in dict.fromkeys(chunks) if c in self.known}
        self.known.update(zip(new, self.from_words(new), strict=True))
        return [self.known[c] for c in chunks]

    def fresh(self, pieces: list[bytes]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in got)]

    def from_words(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of the chunks, from those of their words; a chunk whose words do not agree at their joins is encoded whole."""
        size = np.cumsum([0, *map(len, chunks)])
        t = Texts(np.frombuffer(b"".join(chunks), np.uint8), size)
        raw = t.buf.tobytes()
        starts, ends, first = _cut(t, np.ones(len(t.starts), bool))
        which, one = _distinct(t, starts, ends)
        pieces = [raw[lo:hi] for lo, hi in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
        new = [p for p in pieces if p not in self.words]
        if len(self.words) + len(new) > WORDS:
            self.words = {p: self.words[p] for p in pieces if p in self.words}
        self.words.update(zip(new, self.fresh(new), strict=True))
        ids = [self.words[p] for p in pieces]
        size = np.array([len(i) // 4 for i in ids], np.int64)
        flat = _gather(np.frombuffer(b"".join(ids), "<u4"), (np.cumsum(size) - size)[which], size[which]).tobytes()
        cut = (4 * np.concatenate([[0], np.cumsum(size[which])])[first]).tolist()
        out = [flat[lo:hi] for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
        whole = self.unsplit(t, raw)
        for k, i in zip(whole, self.fresh([chunks[k] for k in whole]), strict=True):
            out[k] = i
        return out

    def unsplit(self, t: Texts, raw: bytes) -> list[int]:
        """The texts of a slice in which something crosses the join of two words; equal joins are checked once."""
        later = np.ones(len(t.starts), bool)
        later[t.first[:-1][np.diff(t.first) > 0]] = False
        at = np.flatnonzero(later)
        lo, hi = t.ends[at - 1] - 1, t.starts[at] + 1
        for _ in range(3):  # the characters on both sides are whole
            lo = lo - ((t.buf[lo] & 0xC0) == 0x80)
            hi = hi + ((t.buf[hi] & 0xC0) == 0x80)
        which, one = _distinct(t, lo, hi)
        good = [self.splits(raw[a:m], raw[m:b]) for a, m, b in zip(lo[one].tolist(), t.starts[at[one]].tolist(), hi[one].tolist(), strict=True)]
        return np.unique(t.text_of_word()[at[~np.array(good, bool)[which]]]).tolist()

    def splits(self, a: bytes, b: bytes) -> bool:
        """Whether nothing crosses the join of a and b: neither normaliser nor pre-tokeniser, and the ids are the same."""
        if (a, b) not in self.agreed:
            if len(self.agreed) > CACHED:
                self.agreed.clear()
            norm, pre = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
            x, y, both = (norm.normalize_str(t.decode()) if norm else t.decode() for t in (a, b, a + b))
            apart = pre is not None and x + y == both and not any(lo < len(x) < hi for _, (lo, hi) in pre.pre_tokenize_str(both))
            self.agreed[a, b] = apart and self.raw_ids(a + b) == self.raw_ids(a) + self.raw_ids(b)
        return self.agreed[a, b]

    def agrees(self, left: bytes, right: bytes) -> bool:
        """The same for two chunks, over wider and wider windows up to both chunks' ends."""
        span = 1
        while True:
            a, b = _tail(left, span), _head(right, span)
            if self.splits(a, b):
                return True
            if len(a) == len(left) and len(b) == len(right):
                return False
            span *= 4

    def repaired(self, chunks: list[bytes]) -> list[bytes]:
        """Neighbouring chunks that do not agree at their join become one."""
        out: list[bytes] = []
        for c in chunks:
            while out and not self.agrees(out[-1], c):
                c = out.pop() + c
            out.append(c)
        return out

    def decoded(self, parts: list[bytes]) -> list[bytes]:
        """The decoded text of each text's ids."""
        flat = np.frombuffer(b"".join(parts), "<u4")
        cut = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int64)
        if self.tokenizer.decoder is not None:
            return [self.tokenizer.decode(flat[lo:hi].tolist(), skip_special_tokens=False).encode() for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
        pieces, begin, size = self.pieces()
        text = _gather(pieces, begin[flat], size[flat]).tobytes()
        back = np.concatenate([[0], np.cumsum(size[flat])])[cut].tolist()
        return [text[lo : max(lo, hi - 1)] for lo, hi in zip(back[:-1], back[1:], strict=True)]


def _tail(chunk: bytes, span: int) -> bytes:
    """The last `span` characters before the chunk's closing blanks, and those."""
    at = len(chunk.rstrip(b" \t\n\x0b\x0c\r"))
    for _ in range(span):
        at -= 1
        while at > 0 and chunk[at] & 0xC0 == 0x80:
            at -= 1
    return chunk[max(at, 0) :]


def _head(chunk: bytes, span: int) -> bytes:
    at = 0
    for _ in range(span):
        at += 1
        while at < len(chunk) and chunk[at] & 0xC0 == 0x80:
            at += 1
    return chunk[:at]


def rolled(t: Texts) -> np.ndarray:
    """For each word a hash of the WINDOW words before it, or of as many as its text has there."""
    words, n = t.words(), len(t.starts)
    total = np.zeros(n, np.uint64)
    for back in range(1, min(WINDOW, n - 1) + 1):
        total[back:] += words[:-back] * _STEPS[back]
    # the first words of a text have no words of the text before
    heads = np.flatnonzero(np.diff(t.first) > 0)
    for place in range(WINDOW):
        at = t.first[heads] + place
        at = at[at < t.first[heads + 1]]
        total[at] = 0
        for back in range(1, place + 1):
            total[at] += words[at - back] * _STEPS[back]
    return mix(total)


def _cut(t: Texts, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the pieces of a slice that begin at the words marked by `low`, and with each text, start and end; each text's first."""
    heads = t.first[:-1][np.diff(t.first) > 0]
    low[heads] = False  # a text's first word does not start a second chunk
    filled = np.flatnonzero(np.diff(t.seps) > 1)
    starts = np.sort(np.concatenate([t.starts[low], t.seps[filled] + 1]))
    first = np.searchsorted(starts, t.seps)
    ends = np.append(starts[1:], 0)[: len(starts)]
    last = first[1:][np.diff(first) > 0] - 1
    ends[last] = t.seps[1:][np.diff(first) > 0]
    return starts, ends, first


def cuts(t: Texts, share: float = SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where chunks of a slice start and end, and each text's first chunk."""
    return _cut(t, rolled(t) < np.uint64(int(share * (1 << 62)) << 2))


def _distinct(t: Texts, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of ranges, equal where their bytes are, and a range of each number."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    which = t.ids(starts, ends)
    one = np.zeros(int(which.max()) + 1, np.int64)
    one[which] = np.arange(len(which))
    return which, one


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encoded(column: pa.Array, path: str) -> Iterator[tuple[bytes, bytes]]:
    """(ids as little-endian unsigned 32-bit integers, decoded text in UTF-8) of each text."""
    c = codec(path)
    for _, _, data, offsets in slices(column):
        t = Texts(data, offsets)
        raw = t.buf.tobytes()
        starts, ends, first = cuts(t)
        chunks = [raw[lo:hi] for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True)]
        texts = [chunks[lo:hi] for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        texts = [x if all(map(c.agrees, x, x[1:])) else c.repaired(x) for x in texts]
        ids = iter(c.look_up([chunk for x in texts for chunk in x]))
        parts = [b"".join([next(ids) for _ in x]) for x in texts]
        yield from zip(parts, c.decoded(parts), strict=True)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """id, ids (array of int) and decoded text; with `digests` their count and SHA-256 values instead, row by row."""
    path = path or vocabulary()
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done: list[list] = [[], [], []]
            for ids, back in encoded(b.column(1), path):
                if digests:
                    done[0].append(len(ids) // 4)
                    done[1].append(hashlib.sha256(ids).hexdigest())
                    done[2].append(hashlib.sha256(back).hexdigest())
                else:
                    done[0].append(np.frombuffer(ids, "<u4").astype(np.int32))
                    done[1].append(back.decode())
            if digests:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done[0], pa.int64()), pa.array(done[1], pa.string()), pa.array(done[2], pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done[0], pa.list_(pa.int32())), pa.array(done[1], pa.string())], [id_col, "ids", "decoded"])

    shape = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, {shape}")


def decode(rows: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and the decoded text of arrays of ids (null: the empty text)."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [[i for i in ids or [] if i is not None] for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codec(path).tokenizer.decode_batch(lists, skip_special_tokens=False), pa.string())], [id_col, "decoded"])

    return rows.select(id_col, ids_col).mapInArrow(tidy(run), f"`{id_col}` {dict(rows.dtypes)[id_col]}, decoded string")


def query(docs: DataFrame) -> DataFrame:
    return encode(docs, digests=True)
