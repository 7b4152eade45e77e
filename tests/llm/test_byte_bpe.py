"""Byte-level BPE against the tiktoken library, and its round trip."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import bytebpe
from quillon.session import table

CODEC = bytebpe.codec(P.path(bytebpe.VOCABULARY))
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})
TOKENS = [t.decode(errors="ignore") for t in CODEC.ranks]


def ids(text):
    return np.frombuffer(CODEC.encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(TOKENS), st.characters(exclude_categories=["Cs"]), st.sampled_from(["  ", "\r\n", "'s", "'ll", "\x1c", " ", "\x00"])), max_size=25).map("".join))
def test_ids_are_the_library_s(text):
    assert ids(text) == LIBRARY.encode_ordinary(text) and CODEC.decode(np.array(ids(text), np.int64)) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcetionsréñ"), min_size=1, max_size=60).map("".join))
def test_pieces_of_letters(text):
    assert CODEC.walk(text.encode()) == CODEC.merged(text.encode())


def test_compatible_means_that_merges_leave_the_pair():
    rng = np.random.default_rng(4)
    near = [(a, b) for a, b in rng.integers(0, len(CODEC.token), (20_000, 2)).tolist()]
    for piece in ("internationalization", "öffentlichkeitsarbeit", "aaaaaaaaaa", "transporte"):
        raw = piece.encode()
        near += [(CODEC.ranks[raw[a:b]], CODEC.ranks[raw[b:c]]) for a in range(len(raw)) for b in range(a + 1, len(raw)) for c in range(b + 1, len(raw) + 1) if raw[a:b] in CODEC.ranks and raw[b:c] in CODEC.ranks]
    assert all(CODEC.compatible(a, b) == (CODEC.merged(CODEC.token[a] + CODEC.token[b]) == [a, b]) for a, b in near)


@pytest.mark.parametrize("text", ["a" * 60_000, "ab" * 30_000, " " * 50_001, "é" * 20_000, "x" * (bytebpe.LONG + 5) + " y", "՘a1͸\U0001e4d0"])
def test_long_pieces_and_characters_of_unlike_classes(text):
    if len(text) < 100_000:
        assert ids(text) == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(np.array(ids(text), np.int64)) == text.encode()


def test_cache_of_pieces_stays_right_when_it_turns_over(monkeypatch):
    monkeypatch.setattr(bytebpe, "CACHED", 3)
    known = bytebpe.Known(lambda x: x.encode())
    assert all(known[x] == x.encode() for x in "abcabdefgabcdefgaab" for _ in range(2)) and len(known) <= 3 and len(known.older) <= 3


def test_query_equals_the_library(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", F.lit("x").alias("ids"), F.lit("y").alias("n_tokens"))
    docs = docs.union(spark.createDataFrame([(-1, None, "", ""), (-2, "", "", ""), (None, "z", "", ""), (None, "z", "", "")], docs.schema))
    want = sorted((str(r.doc_id), len(w := LIBRARY.encode_ordinary(r.text or "")), hashlib.sha256(",".join(map(str, w)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    got = bytebpe.query(docs)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == want
    assert bytebpe.query(docs.limit(0)).count() == 0


def test_encode_and_decode_round_trip(spark, sf):
    rows = bytebpe.encode(table(spark, sf, "documents"))
    back = {r.doc_id: r.decoded for r in bytebpe.decode(rows).collect()}
    text = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    assert back == text == {r.doc_id: r.decoded for r in rows.collect()}
