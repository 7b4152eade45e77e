"""Conversation prefix trie by the Euler-tour technique.

Each distinct sequence of a conversation's first turns is a node. A prefix goes by its length and a polynomial hash modulo
2^127 - 1 over SHA-256 digests of its turns, which parts of a long conversation compute alone and shift afterwards by what
stands before them. A node is then named by its smallest member and its depth.

Each node has an enter and an exit arc. Children stand in the order of their names (their successors come from a range sort,
so that a node of any number of children spreads over parts), and an arc's successor is the next one of the tour. The list is
ranked by contraction: a part of a range sort by names holds runs of the tour, which shrink to their heads in the part
alone; between such rounds arcs that toss tails join a predecessor that tosses heads, so that the list shrinks to 3/4 at least
by expectation however the tour lies; a list of ROWS arcs at most is one part. Then the arcs that left come back round by
round with the sums before them. Ranks and prefix sums of leaves and savings come out together; a subtree's figures are those
of its exit arc less those of its enter arc.

Defined results: turns of one number are in the order of a digest of role and text; null numbers come first; rows without
conv_id belong to no conversation and are ignored; null role or text is empty; repeated rows are turns of their own; other
columns are ignored; an empty table has no nodes, not even a root. A SHA-256 value takes its input in order, so the digest of
a node's ends is fed by one task, from written strings of up to RUN ids; nothing is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import shared
from quillon.llm.grams import tidy
from quillon.llm.shared import CRC_TABLE, crc32_sql, discard, numbered, parts_for, stage

PRIME, BASE = (1 << 127) - 1, 0x4A6F3D1C9E27B5806D93A1F4E85C72B1
RUN = 4096


# -- turns and prefixes --------------------------------------------------------------------------------------------------


def turns(rows: DataFrame) -> DataFrame:
    """(conv, turn, digest, bytes) of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    return rows.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def sequences(rows: DataFrame) -> DataFrame:
    """(conv, depth, digest, bytes, total) of conversations as they are; depth 0 stands for the empty prefix."""
    own = numbered(stage(turns(rows), "turns"), "conv", ["turn", "digest"], "numbered-turns")
    return own.select("conv", (F.col("index") + 1).alias("depth"), "digest", "bytes", F.col("n").alias("total")).union(
        own.filter("index = 0").select("conv", F.lit(0).cast("long"), F.lit(None).cast("binary"), F.lit(0).cast("long"), "n")
    )


def rebuilt(rows: DataFrame) -> DataFrame:
    """The same of rebuilt conversations: the first h turns of conversation c - c % 5, then what c has behind its first h.

    h is at most 8, so a conversation lends at most 8 turns to each of five.
    """
    own = stage(numbered(stage(turns(rows), "turns"), "conv", ["turn", "digest"], "ordered-turns").select("conv", "index", "n", "digest", "bytes"), "numbered-turns")
    lens = own.filter("index = 0").select("conv", "n")
    h, base = F.crc32(F.col("conv").cast("string")) % 9, F.col("conv") - F.col("conv") % 5
    convs = lens.select("conv", "n", h.alias("h"), base.alias("base")).join(lens.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
    lent = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = stage(convs.select("conv", "base", "h", lent.alias("lent"), (lent + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "rebuilt")
    heads = own.filter("index < 8").select(F.col("conv").alias("base"), "index", "digest", "bytes")
    first = convs.join(heads, "base").filter("index < h").select("conv", (F.col("index") + 1).alias("depth"), "digest", "bytes", "total")
    later = own.join(convs, "conv").filter("index >= h").select("conv", (F.col("lent") + F.col("index") - F.col("h") + 1).alias("depth"), "digest", "bytes", "total")
    empty = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"), "total")
    return empty.union(first).union(later)


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv, depth, state, before, bytes, last): the hash of each prefix and of the one that is a turn shorter."""
    rows = stage(rows, "sequences")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, 0  # the row before
        for b in batches:
            states, before = [], []
            for conv, depth, digest in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                old = state if at == (conv, depth - 1) else 0
                state = 0 if digest is None else (old * BASE + int.from_bytes(digest[:15], "big") + 1) % PRIME
                at = conv, depth
                states.append(state.to_bytes(16, "big"))
                before.append(old.to_bytes(16, "big"))
            last = pa.array(np.asarray(b.column(1)) == np.asarray(b.column(4)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(states, pa.binary()), pa.array(before, pa.binary()), b.column(3), last, b.column(5)], ["conv", "depth", "state", "before", "bytes", "last", "part"])

    sort = rows.repartitionByRange(parts_for(rows.count(), rows.sparkSession), "conv", "depth").sortWithinPartitions("conv", "depth")
    shape = "conv long, depth long, state binary, before binary, bytes long, last boolean, part int"
    placed = stage(sort.select("conv", "depth", "digest", "bytes", "total", F.spark_partition_id().alias("part")).mapInArrow(tidy(local), shape), "states")
    discard(rows)

    # a row for each part: where it begins and ends; what a conversation has in earlier parts is carried into the next
    edges = placed.groupBy("part").agg(F.min(F.struct("conv", "depth")).alias("first"), F.max(F.struct("conv", "depth", "state")).alias("end")).orderBy("part").collect()
    carried: dict[int, tuple[int, int, int]] = {}
    end, state = None, 0
    for e in edges:
        head = (e["first"]["conv"], e["first"]["depth"])
        goes_on = end is not None and head == (end[0], end[1] + 1)
        if goes_on:
            carried[e["part"]] = *head, state
        now = int.from_bytes(e["end"]["state"], "big")
        if goes_on and e["end"]["conv"] == head[0]:
            now = (now + state * pow(BASE, e["end"]["depth"] - head[1] + 1, PRIME)) % PRIME
        end, state = (e["end"]["conv"], e["end"]["depth"]), now

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, conv = np.asarray(b.column(6)), np.asarray(b.column(0))
            touched = np.zeros(len(part), bool)
            for p in np.unique(part).tolist():
                if p in carried:
                    touched |= (part == p) & (conv == carried[p][0])
            columns = [b.column(k) for k in range(6)]
            if touched.any():
                depth, (states, before) = np.asarray(b.column(1)), (b.column(k).to_pylist() for k in (2, 3))
                for i in np.flatnonzero(touched).tolist():
                    _, d0, c = carried[int(part[i])]
                    power = c * pow(BASE, int(depth[i]) - d0, PRIME) % PRIME
                    before[i] = ((int.from_bytes(before[i], "big") + power) % PRIME).to_bytes(16, "big")
                    states[i] = ((int.from_bytes(states[i], "big") + power * BASE) % PRIME).to_bytes(16, "big")
                columns[2:4] = pa.array(states, pa.binary()), pa.array(before, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, ["conv", "depth", "state", "before", "bytes", "last"])

    return placed.mapInArrow(tidy(shifted), "conv long, depth long, state binary, before binary, bytes long, last boolean")


# -- nodes ---------------------------------------------------------------------------------------------------------------


def ends_digest(rows: DataFrame) -> DataFrame:
    """(depth, state, ends_sha256) over conversations (depth, state, conv) that end in a node: ascending ids, joined by commas."""
    rows = stage(rows, "ends")
    sort = rows.repartitionByRange(parts_for(rows.count(), rows.sparkSession), "depth", "state", "conv").sortWithinPartitions("depth", "state", "conv")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            depth, state, conv = np.asarray(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist()
            out: list[tuple] = []
            lo = 0
            for k in range(1, len(conv) + 1):
                if k == len(conv) or k - lo == RUN or state[k] != state[lo] or depth[k] != depth[lo]:
                    out.append((int(depth[lo]), state[lo], conv[lo], ",".join(map(str, conv[lo:k]))))
                    lo = k
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.string()), strict=True)], ["depth", "state", "conv", "ids"])

    runs = stage(sort.mapInArrow(tidy(strings), "depth long, state binary, conv long, ids string"), "runs")

    def fed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, value = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.binary()), pa.array([value.hexdigest()])], ["depth", "state", "ends_sha256"])
        for b in batches:
            held = []
            for depth, state, _, ids in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if key == (depth, state):
                    value.update(b",")
                else:
                    if key:
                        held.append(done())
                    key, value = (depth, state), hashlib.sha256()
                value.update(ids.encode())
            yield from pa.Table.from_batches(held).combine_chunks().to_batches() if held else ()
        if key:
            yield done()

    sort = runs.repartition("depth", "state").sortWithinPartitions("depth", "state", "conv")
    return sort.mapInArrow(tidy(fed), "depth long, state binary, ends_sha256 string")


def following(nodes: DataFrame) -> DataFrame:
    """(conv, depth, sibling): the next child of the same parent, for those that have one. nodes: conv, depth, parent_conv."""
    rows = nodes.filter("depth > 0").select("parent_conv", "depth", "conv")
    sort = rows.repartitionByRange(parts_for(rows.count(), rows.sparkSession), "parent_conv", "depth", "conv").sortWithinPartitions("parent_conv", "depth", "conv")
    placed = stage(sort.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "children")
    whole = F.struct("parent_conv", "depth", "conv")
    # a part has a bounded number of rows, and there is a row for each part
    firsts = placed.groupBy("part").agg(F.min(whole).alias("first"))
    firsts = firsts.select("part", F.lead("first").over(Window.orderBy("part")).alias("first"))
    near = placed.withColumn("next", F.lead(whole).over(Window.partitionBy("part").orderBy("at")))
    got = near.join(firsts, "part").withColumn("next", F.coalesce("next", "first"))
    same = (F.col("next.parent_conv") == F.col("parent_conv")) & (F.col("next.depth") == F.col("depth"))
    return got.filter(same).select("conv", "depth", F.col("next.conv").alias("sibling"))


def nodes(states: DataFrame) -> DataFrame:
    """(conv, depth, state, n_convs, bytes, parent_conv, n_children, first_child) of every node."""
    made = states.groupBy("depth", "state").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), F.min("before").alias("before"))
    made = stage(made, "nodes")
    above = made.select((F.col("depth") + 1).alias("depth"), F.col("state").alias("before"), F.col("conv").alias("parent_conv"))
    made = stage(made.join(above, ["depth", "before"], "left").drop("before"), "linked")
    below = made.filter("depth > 0").groupBy(F.col("parent_conv").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"), F.min("conv").alias("first_child"))
    return made.join(below, ["conv", "depth"], "left").fillna(0, ["n_children"])


# -- Euler tour ----------------------------------------------------------------------------------------------------------


def arcs(tree: DataFrame) -> DataFrame:
    """(conv, at, next_conv, next_at, one, leaves, saved): `at` is twice the depth, plus 1 for exit arcs; the last has no next."""
    enter, leave = F.col("depth") * 2, F.col("depth") * 2 + 1
    child = F.when(F.col("n_children") > 0, F.struct(F.col("first_child").alias("c"), (enter + 2).alias("a"))).otherwise(F.struct(F.col("conv").alias("c"), leave.alias("a")))
    up = F.when(F.col("sibling").isNotNull(), F.struct(F.col("sibling").alias("c"), enter.alias("a"))).when(F.col("depth") > 0, F.struct(F.col("parent_conv").alias("c"), (leave - 2).alias("a")))
    weigh = lambda leaves, saved: (leaves.cast("long").alias("leaves"), saved.cast("long").alias("saved"))
    two = F.array(
        F.struct(enter.alias("at"), child.alias("next"), *weigh(F.col("n_children") == 0, (F.col("n_convs") - 1) * F.col("bytes"))),
        F.struct(leave.alias("at"), up.alias("next"), *weigh(F.lit(0), F.lit(0))),
    )
    return tree.select("conv", F.explode(two).alias("x")).select("conv", "x.at", F.col("x.next.c").alias("next_conv"), F.col("x.next.a").alias("next_at"), F.lit(1).cast("long").alias("one"), "x.leaves", "x.saved")


WEIGHTS = ["one", "leaves", "saved"]


def runs_of(place: np.ndarray, after: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of list items, each at its place (ascending) and with the place after it: the head of the run that it belongs to, the
    weights before it in that run, and whether the item after it is elsewhere."""
    n = len(place)
    found = np.minimum(np.searchsorted(place, after), n - 1)
    inside = place[found] == after
    head = np.arange(n)
    head[found[inside]] = np.flatnonzero(inside)
    before = np.zeros_like(weights)
    before[found[inside]] = weights[inside]
    while True:  # each item's pointer doubles its reach
        further = head[head]
        if np.array_equal(further, head):
            return head, before, ~inside
        before += before[head]
        head = further


def contracted(items: DataFrame, count: int) -> DataFrame:
    """A row for each item: heads of runs with what follows the run and its weights, and items that left, with their head and
    the weights between. Parts are ranges of names; a list of ROWS items at most is one part."""
    spark = items.sparkSession
    dealt = items.coalesce(1) if count <= shared.ROWS else items.repartitionByRange(parts_for(count, spark), "conv", "at")
    names = ["conv", "at", "head_conv", "head_at", "next_conv", "next_at", *WEIGHTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if held is None or not held.num_rows:
            return
        get = lambda name: held[name].fill_null(-1).to_numpy() if name == "next_at" else held[name].fill_null(0).to_numpy()
        conv, at, next_conv, next_at = map(get, names[:2] + names[4:6])
        known, code = np.unique(conv, return_inverse=True)
        wide = int(max(at.max(), next_at.max())) + 2
        place = code * wide + at
        order = np.argsort(place, kind="stable")
        conv, at, next_conv, next_at, place = (x[order] for x in (conv, at, next_conv, next_at, place))
        weights = np.stack([get(w)[order] for w in WEIGHTS], axis=1)
        k = np.minimum(np.searchsorted(known, next_conv), len(known) - 1)
        after = np.where((known[k] == next_conv) & (next_at >= 0), k * wide + next_at, -1)
        head, before, ends = runs_of(place, after, weights)
        gone = np.flatnonzero(head != np.arange(len(head)))
        tails = np.flatnonzero(ends)
        total = before[tails] + weights[tails]
        none = lambda n: pa.nulls(n, pa.int64())
        there = next_at[tails] >= 0
        yield pa.RecordBatch.from_arrays([pa.array(conv[gone]), pa.array(at[gone]), pa.array(conv[head[gone]]), pa.array(at[head[gone]]), none(len(gone)), none(len(gone)), *(pa.array(before[gone, j]) for j in range(3))], names)
        yield pa.RecordBatch.from_arrays([pa.array(conv[head[tails]]), pa.array(at[head[tails]]), none(len(tails)), none(len(tails)), pa.array(next_conv[tails], mask=~there), pa.array(next_at[tails], mask=~there), *(pa.array(total[:, j]) for j in range(3))], names)

    return stage(dealt.mapInArrow(tidy(run), ", ".join(f"{n} long" for n in names)), "runs")


def mated(items: DataFrame, turn: int) -> DataFrame:
    """One round of joining: an item of tails leaves to its predecessor of heads. Rows as of `contracted`, both kinds in one row:
    an item, and the one that left to it."""
    heads = F.xxhash64("conv", "at", F.lit(turn)).bitwiseAND(1) == 1
    a = items.filter(heads).select(F.struct(*items.columns).alias("a"), F.struct(F.col("next_conv").alias("c"), F.col("next_at").alias("t")).alias("key"))
    b = items.filter(~heads).select(F.struct(*items.columns).alias("b"), F.struct(F.col("conv").alias("c"), F.col("at").alias("t")).alias("key"))
    both = a.join(b, "key", "full_outer")
    joined = F.col("a").isNotNull() & F.col("b").isNotNull()
    lone = F.coalesce("a", "b")
    kept = [F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("conv", "at")]
    to = [F.when(joined, F.col(f"b.{c}")).otherwise(lone[c]).alias(c) for c in ("next_conv", "next_at")]
    sums = [F.when(joined, F.col(f"a.{w}") + F.col(f"b.{w}")).otherwise(lone[w]).alias(w) for w in WEIGHTS]
    left = F.when(joined, F.struct(F.col("b.conv").alias("conv"), F.col("b.at").alias("at"), F.col("a.conv").alias("head_conv"), F.col("a.at").alias("head_at"), *(F.col(f"a.{w}").alias(w) for w in WEIGHTS)))
    return stage(both.select(*kept, *to, *sums, left.alias("left")), "mated")


def ranked(items: DataFrame) -> DataFrame:
    """(conv, at, one, leaves, saved): the sums of all items before each one of the list; `one` is its rank."""
    count, turn, logs = items.count(), 0, []
    while True:
        done = contracted(items, count)
        logs.append(done.filter("head_at IS NOT NULL").select("conv", "at", "head_conv", "head_at", *WEIGHTS))
        items = done.filter("head_at IS NULL").drop("head_conv", "head_at")
        if count <= shared.ROWS:
            break
        count = items.count()
        if count > shared.ROWS:
            turn += 1
            step = mated(items, turn)
            logs.append(step.filter("left IS NOT NULL").select("left.*"))
            items = step.drop("left")
            count = items.count()
    known = items.select("conv", "at", *(F.lit(0).cast("long").alias(w) for w in WEIGHTS))
    for log in reversed(logs):
        heads = known.select(F.col("conv").alias("head_conv"), F.col("at").alias("head_at"), *(F.col(w).alias(f"h_{w}") for w in WEIGHTS))
        back = log.join(heads, ["head_conv", "head_at"]).select("conv", "at", *((F.col(w) + F.col(f"h_{w}")).alias(w) for w in WEIGHTS))
        known = stage(known.unionByName(back), "ranked")
    return known


def trie(rows: DataFrame) -> DataFrame:
    """Nodes of the trie of sequences (conv, depth, digest, bytes, total), with their figures and places in the tour."""
    states = stage(prefixes(rows), "prefixes")
    tree = stage(nodes(states), "tree")
    sibling = following(tree)
    tour = ranked(stage(arcs(tree.join(sibling, ["conv", "depth"], "left")), "arcs"))
    side = F.col("at") % 2 == 1
    span = lambda w: F.sum(F.when(side, F.col(w)).otherwise(-F.col(w)))
    sums = tour.groupBy("conv", F.shiftright("at", 1).alias("depth")).agg(span("leaves").alias("n_leaves"), span("saved").alias("saved_tokens"), F.min("one").alias("enter"), F.max("one").alias("exit"))
    ends = ends_digest(states.filter("last").select("depth", "state", "conv"))
    got = tree.join(sums, ["conv", "depth"]).join(ends, ["depth", "state"], "left")
    return got.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "enter", "exit",
    ).withColumnRenamed("parent_conv", "parent_conv_id")


def query(conversations: DataFrame) -> DataFrame:
    return trie(rebuilt(conversations)).drop("enter", "exit")


SQL = f"""WITH {CRC_TABLE},
tn AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, w) AS o FROM (SELECT conv_id AS c, turn, strlen(coalesce(text, '')) AS b, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS w FROM conversations WHERE conv_id IS NOT NULL)),
cv AS (SELECT c, n, {crc32_sql('c')} % 9 AS h, c - c % 5 AS base FROM (SELECT c, count(*) AS n FROM tn GROUP BY c), tab),
le AS (SELECT cv.*, least(cv.h, coalesce(o.n, 0)) AS lent FROM cv LEFT JOIN cv AS o ON o.c = cv.base),
sq AS (SELECT le.c, o AS d, w, b FROM le JOIN tn ON tn.c = le.base AND o <= h UNION ALL SELECT le.c, lent + o - h, w, b FROM le JOIN tn ON tn.c = le.c AND o > h),
px AS (SELECT c, 0 AS d, '' AS p, 0 AS b FROM cv UNION ALL SELECT c, d, string_agg(w, '') OVER (PARTITION BY c ORDER BY d), b FROM sq),
nd AS (SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, any_value(b) AS b FROM px GROUP BY d, p),
ow AS (SELECT c, d, conv_id AS own FROM px JOIN nd USING (d, p)),
tr AS (SELECT nd.*, ow.own AS parent FROM nd LEFT JOIN ow ON ow.c = nd.conv_id AND ow.d = nd.d - 1),
ch AS (SELECT parent, d - 1 AS d, count(*) AS kids FROM tr WHERE d > 0 GROUP BY ALL),
fg AS (SELECT tr.*, coalesce(kids, 0) AS kids FROM tr LEFT JOIN ch ON ch.parent = tr.conv_id AND ch.d = tr.d),
su AS (SELECT own, ow.d, sum((n_convs - 1) * b) AS saved, count(*) FILTER (kids = 0) AS leaves FROM fg JOIN ow ON ow.c = fg.conv_id AND ow.d <= fg.d GROUP BY ALL),
en AS (SELECT own, d, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS e FROM ow JOIN (SELECT c, max(d) AS d FROM px GROUP BY c) USING (c, d) GROUP BY ALL)
SELECT fg.conv_id, fg.d::BIGINT AS depth, parent AS parent_conv_id, n_convs, kids AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(e, sha256('')) AS ends_sha256
FROM fg JOIN su ON su.own = fg.conv_id AND su.d = fg.d LEFT JOIN en ON en.own = fg.conv_id AND en.d = fg.d"""
