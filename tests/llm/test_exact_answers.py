"""Operators against SQL, brute force, round trips and the tokenizer library."""

import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import oracle
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import bpe, chat, exact, grams, graph, minhash, mixing, registry, rules, suffixes, toxicity, warc
from quillon.session import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, con, sf, name):
    assert oracle.difference(registry.queries()[name], registry.oracle_sql()[name], spark, sf, con) is None


def shingle_set(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_groups(texts: dict) -> dict:
    sets = {k: shingle_set(t) for k, t in texts.items()}
    home = {k: k for k in texts}

    def top(x):
        while home[x] != x:
            x = home[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            home[max(x, y)] = min(x, y)
    return {k: top(k) for k in texts}


def test_minhash_groups(spark, sf):
    docs = table(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.group_id for r in minhash.query(docs).collect()}
    assert got == brute_groups(texts)


def test_minhash_large_group(spark):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(120):
        w = list(base)
        for at in rng.choice(300, 3, replace=False):
            w[at] = f"x{k}_{at}"
        rows.append((k, " ".join(w)))
    rows += [(1000 + k, " ".join(f"o{k}_{j}" for j in range(50))) for k in range(30)]
    got = {r.doc_id: r.group_id for r in minhash.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_groups(dict(rows))
    assert sum(got[k] == want[k] for k in got) >= 0.98 * len(got) and all(got[k] == k for k in got if k >= 1000)


def test_minhash_candidates_of_changed_copies(spark, monkeypatch):
    # copies with three changed words are similar to the text behind them (0.81), but to few of the other copies
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 500):
        w = list(base)
        for at in rng.choice(140, k % 3 + 1, replace=False):
            w[at + 5] = f"x{k}_{at}"
        rows.append((k, " ".join(w)))
    asked, links = [], minhash._links
    monkeypatch.setattr(minhash, "_links", lambda pairs, sets: (asked.append(pairs.count()), links(pairs, sets))[1])
    got = {r.doc_id: r.group_id for r in minhash.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(dict(rows)) and sum(asked) < 5 * len(rows), asked


def test_minhash_pairs_among_texts_of_common_words(spark):
    # two texts of a family are at 0.81, of two families at 0.77: most buckets of a pair hold a hundred other texts
    common = [f"c{j}" for j in range(525)]
    rows = [(k, " ".join([*common, *(f"f{k // 2}_{j}" for j in range(15)), *(f"o{k}_{j}" for j in range(60))])) for k in range(400)]
    got = {r.doc_id: r.group_id for r in minhash.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(dict(rows)) == {k: k // 2 * 2 for k in range(400)}


def test_minhash_lines_repeated_unequally(spark):
    line = " ".join(f"l{k}" for k in range(20))
    rows = []
    for k in range(30):
        words = [f"u{k}_{j}" for j in range(200)]
        rows.append((2 * k, " ".join([*words, *[line] * 100])))
        rows.append((2 * k + 1, " ".join([*words[:199], "other", *[line] * 3])))
    got = {r.doc_id: r.group_id for r in minhash.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k // 2 * 2 for k, _ in rows}


def test_rest_holds_every_similar_pair(spark):
    rng = np.random.default_rng(4)
    made = {}
    for family in range(4):
        base = np.unique(rng.integers(0, 1 << 39, 90))
        for _ in range(40):
            keep = base[rng.random(len(base)) > rng.choice([0.02, 0.08, 0.12])]
            made[len(made)] = np.unique(np.concatenate([keep, rng.integers(0, 1 << 39, rng.integers(0, 12))]))
    raw = {k: x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes() for k, x in made.items()}
    names = {k: k.to_bytes(16, "big") for k in made}
    sets = spark.createDataFrame([(bytearray(names[k]), bytearray(raw[k])) for k in made], "name binary, set binary")
    label = {k: names[k // 3] for k in made}
    rows = spark.createDataFrame([(bytearray(names[k]), bytearray(label[k])) for k in made], "name binary, label binary")
    got = {frozenset((bytes(r.a), bytes(r.b))) for r in minhash._rest(rows, sets).collect()}
    near = {frozenset((names[a], names[b])) for a, b in combinations(made, 2) if label[a] != label[b] and minhash.jaccard(made[a], made[b]) >= 0.8}
    assert near and near <= got and len(got) < 4 * len(near)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    a, b = rng.integers(1, 1 << 62, 400).astype(np.uint64), rng.integers(1, 1 << 62, 100).astype(np.uint64)
    keys = np.concatenate([a, a[:300], b])
    owner = np.concatenate([np.zeros(400, int), np.ones(400, int)])
    sig = minhash.signatures(owner, keys, np.ones(len(keys), int), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.04


def brute_cover(texts: dict) -> dict:
    where = defaultdict(list)
    for k, t in texts.items():
        w = WORD.findall(t or "")
        for i in range(len(w) - 49):
            where[tuple(w[i : i + 50])].append((k, i))
    cover = defaultdict(set)
    for places in where.values():
        if len({k for k, _ in places}) > 1:
            for k, i in places:
                cover[k].update(range(i, i + 50))
    return cover


def test_repeated_passages(spark, sf):
    docs = table(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    shared = " ".join(f"p{k}" for k in range(50))
    more = {900_001: f"a b c {shared} d", 900_002: f"{shared} e f", 900_003: "z " * 500, 900_004: "y z " + "z " * 400}
    texts |= more
    got = defaultdict(set)
    for r in suffixes.query(docs.select("doc_id", "text").union(spark.createDataFrame(list(more.items()), "doc_id long, text string"))).collect():
        got[r.doc_id].update(range(r.first_word, r.end_word))
    assert got == brute_cover(texts) and {900_001, 900_002, 900_003, 900_004} <= set(got)


def passages(rows):
    got = defaultdict(set)
    for r in rows.collect():
        got[r.doc_id].update(range(r.first_word, r.end_word))
    return got


def mosaic(seed=9):
    """Texts put together from a few blocks: runs of many texts with unlike words on the left, pairs, and words over and over."""
    rng = np.random.default_rng(seed)
    blocks = [[f"b{k}_{j}" for j in range(int(n))] for k, n in enumerate(rng.integers(12, 70, 24))] + [["z"] * 60]
    texts = {}
    for k in range(400):
        text = []
        for _ in range(rng.integers(1, 6)):
            part = blocks[rng.integers(len(blocks))]
            lo = rng.integers(0, len(part) // 2)
            text += [f"o{k}_{j}" for j in range(rng.integers(0, 4))] + part[lo : lo + rng.integers(10, 70)]
        texts[k] = " ".join(text)
    return texts


@pytest.mark.parametrize("parts", [1, 7])
def test_passages_of_mosaics(spark, parts):
    texts = mosaic()
    spark.conf.set("spark.sql.shuffle.partitions", parts)  # at 7, ranges part runs
    got = passages(suffixes.query(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == brute_cover(texts) and len(got) > 50


def test_passages_come_from_neighbours(spark, sf, monkeypatch):
    docs = table(spark, sf, "documents")
    whole = passages(suffixes.query(docs))
    assert whole == brute_cover({r.doc_id: r.text for r in docs.collect()})
    monkeypatch.setattr(suffixes, "_matches", lambda batches: (b.slice(0, 0).select(["class"]) for b in []))
    less = passages(suffixes.query(docs))
    assert sum(map(len, less.values())) < sum(map(len, whole.values()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", " ", "\n", "\t", "é", "\u0301", "日", "'s", "1", "Σ", "ß", "\u2000", ".", "<|endoftext|>", "<|", "x\x0bz"]), max_size=30).map("".join), max_size=6))
def test_bpe_is_the_library(texts):
    lib = bpe.codec(bpe.vocabulary()).tokenizer
    for (ids, back), text in zip(bpe.encoded(pa.array(texts, pa.string()), bpe.vocabulary()), texts, strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and back.decode() == lib.decode(want, skip_special_tokens=False)


def test_bpe_chunks_are_cut_by_what_stands_before():
    rng = np.random.default_rng(2)
    common = [f"w{k}" for k in rng.integers(0, 30, 400)]
    texts = [" ".join([*(f"{k}_{j}" for j in range(k)), *common]) for k in range(6)]
    t = grams.Texts(*[x for x in grams.slices(pa.array(texts))][0][2:])
    starts, ends, first = bpe.cuts(t)
    raw = t.buf.tobytes()
    chunks = [[raw[a:b] for a, b in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)] for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    assert [b"".join(c).decode() for c in chunks] == texts and all(len(c) > 10 for c in chunks)
    assert len({tuple(c[-5:]) for c in chunks}) == 1  # the common end is cut alike
    heads = {c.split()[0] for x in chunks for c in x[1:]}
    inner = {w for x in chunks for c in x for w in c.split()[1:]}
    assert heads & inner  # the same word begins a chunk at some of its places and not at others


def test_bpe_joins_that_disagree_are_repaired():
    class Odd(bpe.Codec):  # a vocabulary that reads "b \\nc" as one token, across a join
        def raw_ids(self, text):
            return [7 if x == b"b c" else len(x) for x in re.findall(rb"b c|[^ ]+", text)]

    odd = Odd(bpe.vocabulary())
    chunks = [b"a ", b"b ", b"c ", b"d"]
    whole = odd.repaired(chunks)
    assert b"".join(whole) == b"".join(chunks) and [i for x in whole for i in odd.raw_ids(x)] == odd.raw_ids(b"a b c d")


def test_bpe_words_of_new_chunks_are_encoded_once():
    c = bpe.Codec(bpe.vocabulary())
    lib, sizes = c.tokenizer, []

    class Counting:
        def __getattr__(self, name):
            return getattr(lib, name)

        def encode_batch_fast(self, texts, **how):
            sizes.extend(map(len, texts))
            return lib.encode_batch_fast(texts, **how)

    c.tokenizer = Counting()
    words = [f"word{k}" for k in np.random.default_rng(6).integers(0, 50, 8000)]
    chunks = [" ".join([*words[k : k + 16], ""]) for k in range(0, 8000, 16)]
    want = [np.array(lib.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in chunks]
    assert c.look_up([x.encode() for x in chunks]) == want and sum(sizes) < 0.1 * sum(map(len, chunks))


def test_bpe_words_that_disagree_leave_the_chunk_whole():
    class Odd(bpe.Codec):
        def raw_ids(self, text):
            return [7 if x == b"b c" else len(x) for x in re.findall(rb"b c|[^ ]+", text)]

        def fresh(self, pieces):
            return [np.array(self.raw_ids(p), "<u4").tobytes() for p in pieces]

    odd = Odd(bpe.vocabulary())
    chunks = [b"a b c d ", b"  ", b"", b" a d\n", b"b ", b"\xc3\xa9 b c"]
    assert odd.look_up(chunks) == odd.fresh(chunks) and odd.unsplit(grams.Texts(np.frombuffer(b"".join(chunks), np.uint8), np.cumsum([0, *map(len, chunks)])), b"".join(b" " + c for c in chunks) + b" ") == [0, 5]


def test_bpe_round_trip_of_operator(spark, sf):
    docs = table(spark, sf, "documents").limit(40)
    rows = bpe.encode(docs)
    back = {r.doc_id: r.decoded for r in bpe.decode(rows).collect()}
    assert all(r.decoded == back[r.doc_id] for r in rows.collect())


def brute_cost(roles):
    names, best = ("system", "user", "assistant"), {0: 0}
    for role in roles:
        new = {}
        for s, c in best.items():
            for a in (1, 2, 3):
                k = 0 if role == names[a - 1] else 2
                if s == a:
                    k += 1
                elif (s, a) not in {(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)}:
                    if a != 3:
                        continue
                    k += 3
                new[a] = min(new.get(a, 10**9), c + k)
        best = new
    return min(c + {0: 0, 1: 6, 2: 3, 3: 0}[s] for s, c in best.items())


def test_chat_costs_and_legal_turns(spark):
    rng = np.random.default_rng(5)
    kinds = ["user", "assistant", "system", "tool", None]
    rows = [(1, k, kinds[rng.integers(5)], f"t{k}") for k in range(1500)] + [(c, k, kinds[rng.integers(5)], "x") for c in range(2, 40) for k in range(rng.integers(1, 9))]
    rows += [(99, 0, "user", "same")] * 1100
    got = chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in chat.conversations(got).collect():
        own = [x[2] for x in sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: x[1])]
        assert r.cost == brute_cost(own)
        heads = re.findall(r"<\|(system|user|assistant)\|>", r.formatted)
        assert heads[heads[0] == "system" :] == ["user", "assistant"] * (len(heads) // 2)
        assert r.formatted.endswith("<|end|>\n") and r.formatted.count("<|end|>") == len(heads)


def test_chat_states_do_not_hang_on_parts(spark):
    rng = np.random.default_rng(6)
    roles = [[None, "user", "assistant", "system"][k] for k in rng.integers(0, 4, 9000)]
    rows = [(7, k, r, "t") for k, r in enumerate(roles)] + [(8, 0, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    outs = []
    for parts in (1, 5):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts == 1)
        outs.append(sorted((r.conv_id, r.turn, r.new_role, r.merged, r.cost, tuple(r.inserted)) for r in chat.repair(turns).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    assert outs[0] == outs[1] and sum(x[4] for x in outs[0] if x[0] == 7) == brute_cost(roles)


def test_mix_meets_targets(spark, sf):
    docs = table(spark, sf, "documents")
    got = mixing.query(docs).toPandas()
    again = mixing.query(docs.repartition(7)).toPandas()
    assert got.sort_values("doc_id", ignore_index=True).equals(again.sort_values("doc_id", ignore_index=True))
    assert (got["taken"] <= 3 * got["size"]).all() and (got["size"] == [len(WORD.findall(t)) for t in docs.toPandas().set_index("doc_id").loc[got["doc_id"], "text"]]).all()
    by = got.groupby("source").agg(size=("size", "sum"), target=("target", "max"), taken=("taken", "sum"))
    assert by.target.sum() == pytest.approx(by["size"].sum()) and (by.target <= 3 * by["size"] + 1e-6).all() and (abs(by.taken - by.target) < 200).all()


def test_targets_reshare():
    assert mixing.targets([10, 1000, 1000], [1, 1, 1]) == [30.0, 990.0, 990.0]
    assert mixing.targets([0, 5], [1, 2]) == [0.0, 5.0] and mixing.targets([], []) == []
    quotas = np.array([100, 7, 0, 93])
    parts = [mixing.shard_counts(quotas, 7, s) for s in range(7)]
    assert sum(n for _, n in parts).tolist() == quotas.tolist() and all((n >= 0).all() and n.sum() in (28, 29) for _, n in parts)
    assert all((a + n == b).all() for (a, n), (b, _) in zip(parts, parts[1:], strict=False))


def test_shards_hold_the_mix(spark, sf, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 200)
    docs = table(spark, sf, "documents").limit(120)
    seen = {}
    for seed in (11, 12):
        rows = mixing.shards(docs, seed=seed).collect()
        taken, held, slots = defaultdict(int), defaultdict(set), defaultdict(set)
        for r in rows:
            taken[r.doc_id] += r.n_words
            held[r.doc_id].add(r.shard)
            slots[r.shard].add((r.slot, r.source_no, r.block))
        got = {r.doc_id: r for r in mixing.mixed(docs, seed=seed).collect()}
        assert all((r.taken, r.shards) == (taken[k], len(held[k])) for k, r in got.items())
        # a shard's slots are numbered without gaps; a source's blocks serve alike but for one pass that is cut short
        assert len(slots) > 3 and all(sorted(x[0] for x in s) == list(range(len(s))) for s in slots.values())
        uses = defaultdict(lambda: defaultdict(int))
        for s in slots.values():
            for _, source, block in s:
                uses[source][block] += 1
        blocks = defaultdict(int)
        for r in got.values():
            blocks[r.source] += r.size
        assert all(max(u.values()) <= 3 and max(u.values()) - min(u.values()) <= 1 for u in uses.values())
        seen[seed] = ({k: sum(u.values()) for k, u in uses.items()}, {s: frozenset((b, c) for _, b, c in x) for s, x in slots.items()})
    assert seen[11][0] == seen[12][0] and seen[11][1] != seen[12][1]


@given(st.integers(1, 3000), st.integers(0, 1 << 60))
@settings(max_examples=40, deadline=None)
def test_permutation(size, key):
    got = mixing.permute(np.arange(size), np.full(size, size), np.full(size, key, np.uint64))
    assert sorted(got.tolist()) == list(range(size))


def test_mixed_documents_hold_the_words(spark, sf):
    docs = table(spark, sf, "documents")
    texts = {r.doc_id: WORD.findall(r.text) for r in docs.collect()}
    total = 0
    for r in mixing.mix_documents(docs).collect():
        words = WORD.findall(r.text)
        total += len(words)
        assert set(words) <= set(texts[r.doc_id]) and r.n_chars == len(r.text)
    assert abs(total - sum(map(len, texts.values()))) < 0.02 * total


def test_warc_frames_and_offsets(spark, sf, tmp_path):
    pages = table(spark, sf, "pages")
    index = warc.write(pages, f"file://{tmp_path}")
    body = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    for r in index.limit(5).collect():
        head, block = warc.read_record(index, r.record_id)[0]
        assert head["WARC-Type"] == "revisit" or block == body[r.record_id]
    back = {r.page_id: r for r in warc.read(index).collect()}
    assert all(bytes(back[k].payload) == b or back[k].refers_to is not None and body[back[k].refers_to] == b for k, b in body.items())


def test_warc_revisits(spark):
    same, small = "s" * 1000, "t" * 999
    rows = [(1, "u", same), (5, "u", same), (3, "u", same), (2, "u", small), (4, "u", small)]
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("revisit", 5, 1000), 3: ("revisit", 5, 1000), 5: ("response", None, 1000), 2: ("response", None, 999), 4: ("response", None, 999)}


def test_exact_long_copies(spark):
    long = "ab" * 200_000
    rows = [(1, long), (2, long + " "), (3, long + "c"), (4, long[:-1] + "d"), (5, "ab"), (6, "a b")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True), 4: (4, 1, True), 5: (6, 2, False), 6: (6, 2, True)}


def test_ledger_policies_and_ablation(spark, sf):
    rows = rules.ledger(table(spark, sf, "documents")).persist()
    kept = rules.apply_policy(rows).filter("kept").count()
    assert kept == rows.filter("bits = 0").count()
    bits = [r.bits for r in rows.select("bits").collect()]
    for r in rules.ablate(rows).collect():
        bit = rules.BIT[r.rule]
        assert (r.failed, r.failed_alone, r.kept_without) == (sum(b & bit != 0 for b in bits), sum(b == bit for b in bits), sum(b & ~bit == 0 for b in bits))


def test_copies_of_a_toxic_word_score_alike():
    model = toxicity.Model(np.full(1 << toxicity.BITS, 5, np.float32), 1.0, 0.1, (1.0, 0.0))
    got = model.scores(pa.array(["idiot"] * 5 + ["", "idiot idiot"]))
    assert got[0] > 0.5 and (got[:5] == got[0]).all() and got[5] == 0.5
    own = [float(model.scores(pa.array([x]))[0]) for x in ("idiot", "", "idiot idiot")]
    assert got[4:].tolist() == own


@given(st.lists(st.sampled_from([-2.0, -1.0, -0.5, 0.5, 1.0, 3.0]), max_size=40))
@settings(max_examples=80, deadline=None)
def test_best_segment(scores):
    x = np.array(scores)
    best = max([x[i:j].sum() for i in range(len(x)) for j in range(i + 1, len(x) + 1)], default=0)
    got = toxicity.segments(x)
    assert max([s for _, _, s in got], default=0) == pytest.approx(max(best, 0))
    assert all(x[a:b].sum() == pytest.approx(s) for a, b, s in got) and all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + k, 1001 + k) for k in range(40)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    home = {n: n for p in pairs for n in p}
    for _ in range(400):
        for a, b in pairs:
            home[a] = home[b] = min(home[a], home[b])
    assert got == home


def test_slices_hold_whole_texts():
    texts = ["abc " * 400_000, "", None, "x", "é ü"]
    seen = []
    for lo, hi, data, offsets in grams.slices(pa.array(texts)):
        t = grams.Texts(data, offsets)
        seen += [int(n) for n in np.diff(t.first)]
        assert hi - lo == t.n
    assert seen == [400_000, 0, 0, 1, 2]
