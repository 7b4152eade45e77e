"""Prefix trie against a plain version; list ranking against a walk of the list."""

import hashlib
import zlib

import numpy as np
import pytest

from quillon.llm import shared, trie
from quillon.session import table


def key(r):
    role, text = r["role"] or "", r["text"] or ""
    digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
    return (r["turn"] is not None, r["turn"] or 0, digest), (role, text)


def brute(rows, rebuild=True):
    own = {}
    for r in rows:
        if r["conv_id"] is not None:
            own.setdefault(r["conv_id"], []).append(key(r))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    made = dict(own)
    if rebuild:
        for c, t in own.items():
            h = zlib.crc32(str(c).encode()) % 9
            made[c] = own.get(c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5)), [])[:h] + t[h:]
    members = {}
    for c, t in made.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    below = {}
    for p in members:
        if p:
            below.setdefault(p[:-1], []).append(p)
    figures = {}
    for p in sorted(members, key=len, reverse=True):
        kids = below.get(p, [])
        saved = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        figures[p] = (sum(figures[k][0] for k in kids) or 1, saved + sum(figures[k][1] for k in kids))
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(made[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below.get(p, [])), *figures[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def answer(got):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got.collect()), key=str)


SHAPE = "conv_id long, turn long, role string, text string, depth long, state string, part string, index string, n string, conv string"


def convs(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", "p", "i", "n", "c") for r in rows], SHAPE)


def test_tables(spark, sf):
    rows = table(spark, sf, "conversations")
    assert answer(trie.query(rows)) == brute([r.asDict() for r in rows.collect()])


def many():
    rng = np.random.default_rng(8)
    rows = [(int(c), int(t), ["user", "assistant", None][t % 3], f"{'abc'[rng.integers(3)]}{t}") for c in range(-20, 150) for t in range(rng.integers(0, 14))]
    rows += [(1000, t, "user", "same") for t in range(700)] + [(1001, t, "user", "same") for t in range(650)]  # long chains
    rows += [(c, 0, "user", "one first turn") for c in range(2000, 2300)]  # many members, and many children of one node
    rows += [(c, 1, "user", f"own {c}") for c in range(2000, 2200)]
    return rows + [(3000, None, None, None), (3000, None, None, None), (3000, 1, "user", "é"), (3001, None, "", ""), (None, 1, "user", "x"), (3005, 4, "user", "long " * 30_000)]


@pytest.mark.parametrize("rows", [1 << 18, 200])
def test_hot_nodes_long_chains_and_edges(spark, monkeypatch, rows):
    monkeypatch.setattr(shared, "ROWS", rows)  # at 200, parts split conversations, and the tour takes several rounds
    monkeypatch.setattr(trie, "RUN", 50)
    made = many()
    want = brute([dict(zip(("conv_id", "turn", "role", "text"), r, strict=True)) for r in made])
    got = trie.trie(trie.rebuilt(convs(spark, made))).cache()
    assert answer(got) == want
    tour = sorted((r.enter, r.exit) for r in got.collect())
    assert sorted(x for pair in tour for x in pair) == list(range(2 * len(tour))) and all(a < b for a, b in tour)
    got.unpersist()


def test_empty_and_one(spark):
    assert trie.query(convs(spark, many()[:1]).limit(0)).count() == 0
    assert answer(trie.query(convs(spark, [(7, 0, "user", "a")]))) == brute([{"conv_id": 7, "turn": 0, "role": "user", "text": "a"}])


def test_trie_of_conversations_as_they_are(spark, sf):
    rows = table(spark, sf, "conversations")
    assert answer(trie.trie(trie.sequences(rows))) == brute([r.asDict() for r in rows.collect()], rebuild=False)


def test_ranks_of_a_list_that_lies_anyhow(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROWS", 100)
    order = np.random.default_rng(3).permutation(2000)
    rows = [(int(a) // 4, int(a) % 4, None if b is None else int(b) // 4, None if b is None else int(b) % 4, 1, int(a) % 3, int(a)) for a, b in zip(order, [*order[1:], None], strict=True)]
    got = {r.conv * 4 + r["at"]: (r.one, r.leaves, r.saved) for r in trie.ranked(spark.createDataFrame(rows, "conv long, at long, next_conv long, next_at long, one long, leaves long, saved long")).collect()}
    before = np.cumsum([[0, 0, 0], *([1, a % 3, a] for a in order)], axis=0)
    assert got == {int(a): tuple(int(x) for x in before[k]) for k, a in enumerate(order)}


def test_runs_inside_a_part():
    place, after = np.array([2, 5, 7, 9]), np.array([7, -1, 5, 4])
    head, before, ends = trie.runs_of(place, after, np.array([[1], [10], [100], [1000]]))
    assert head.tolist() == [0, 0, 0, 3] and before[:, 0].tolist() == [0, 101, 1, 0] and ends.tolist() == [False, True, False, True]
