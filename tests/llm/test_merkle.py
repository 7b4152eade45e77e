"""Merkle manifest against a plain recursive version, and its closed-form places against the logs."""

import zlib
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import merkle
from quillon.session import table


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def told(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(r, more=0):
    n = r["n_chars"]
    return digest(*(told(x) for x in (r["doc_id"], r["source"], r["lang"], None if n is None else n + more, r["text"])))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def climb(rows, at, proof, folded):
    for level in rows[:-1]:
        run = level[at & ~1 : (at & ~1) + 2]
        if len(run) == 2:
            proof.append(run[(at & 1) ^ 1])
            run[at & 1] = folded
            folded = digest(*run)
        else:
            folded = digest(folded)
        at >>= 1
    return folded


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    made = {}
    for lang in order:
        trees[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        made[lang] = levels([leaf(r) for r in trees[lang]])
    top = levels([made[lang][-1][0] for lang in order])
    out = []
    for no, lang in enumerate(order):
        for at, r in enumerate(trees[lang]):
            forged = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            proof = []
            folded = climb(made[lang], at, proof, leaf(r, int(forged)))
            folded = climb(top, no, proof, folded)
            root = top[-1][0]
            out.append((str(r["doc_id"]), leaf(r), made[lang][-1][0], root, digest(*proof), folded, folded == root))
    return sorted(out)


def answer(docs, bits=merkle.BITS):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in merkle.query(docs, bits).collect())


@pytest.mark.parametrize("bits", [1, 3, merkle.BITS])
def test_trees_equal_the_plain_version(spark, sf, bits):
    docs = table(spark, sf, "documents")
    want = brute([r.asDict() for r in docs.collect()])
    assert answer(docs, bits) == want and any(not r[-1] for r in want) and any(r[-1] for r in want)


def test_edges(spark):
    shape = "doc_id long, text string, lang string, source string, n_chars long, key string, `index` string, n string, digest string, root string"
    extra = ("k", "i", "n", "d", "r")
    rows = [(1, "a", "en", "s", 1, *extra), (1, "a", "en", "s", 1, *extra), (1, "b", "en", None, None, *extra), (None, None, None, None, None, *extra), (None, "x", None, "s", 2**63 - 1, *extra)]
    rows += [(k, "é" * k, "", "", k, *extra) for k in range(-9, 40)] + [(77, "long " * 50_000, "日", "s", 0, *extra)]
    docs = spark.createDataFrame(rows, shape)
    assert answer(docs, 2) == brute([r.asDict() for r in docs.collect()])
    one = docs.filter("doc_id = 77")
    assert answer(one, 2) == brute([r.asDict() for r in one.collect()])
    assert merkle.query(docs.limit(0)).count() == 0


@given(st.integers(1, 200))
def test_places_in_closed_form(n):
    leaves = [bytes([k % 256, k // 256]) * 16 for k in range(n)]
    log = merkle.append(leaves, (n - 1).bit_length())
    level, k = leaves, 0
    while True:
        assert [log[merkle.position(k, i, n)] for i in range(len(level))] == level
        if len(level) == 1:
            break
        level, k = [merkle.node(*level[i : i + 2]) for i in range(0, len(level), 2)], k + 1
    assert len(log) == merkle.position(k, 0, n) + 1


def test_logs_of_a_tier_join_without_gaps(spark, sf):
    m = merkle.manifest(table(spark, sf, "documents"), 3)
    for tier in m.trees:
        for key in {r.key for r in tier.select("key").distinct().collect()}:
            rows = sorted(tier.filter(F.col("key") == key).collect(), key=lambda r: r.block)
            ends = np.cumsum([0] + [len(r.log) // 32 for r in rows])
            assert [r.start for r in rows] == ends[:-1].tolist()


def test_proofs_fold_to_the_root(spark, sf):
    m = merkle.manifest(table(spark, sf, "documents"))
    rows = merkle.proofs(m).collect()
    assert len(rows) == table(spark, sf, "documents").count() and all(merkle.fold(bytes(r.leaf), bytes(r.path)) == m.root for r in rows)
