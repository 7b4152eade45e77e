"""Merkle manifest of a dataset as a postorder append log.

A tree's leaves are cut into aligned blocks of 2 ** bits. A builder takes one block and appends each node to the block's log as
soon as it is complete, children before their parent, so that every subtree is a run of the log that ends in its root. The
roots of a tree's blocks are the leaves of the next tier, built alike, until one node remains. No positions are stored: a node
of level k stands behind the subtrees that were complete before it, whose sizes give its place in closed form (`position`),
and a block's log begins behind the blocks before it (`start`). Proofs read siblings from these places: of each leaf within
its block, and once for each block on the way from there to the root.

There is a tree for each value of `lang` and one over their roots. Leaves are numbered by a range sort (a hot language spreads
over many parts) whose rows are written first; a builder holds one block, a proof task one block's log and one path.

Defined results: null fields hash as `-`; leaves of one doc_id (null: first) are in the order of their digests, equal rows are
leaves of their own; a null lang is a tree of its own, the first; null doc_ids and null n_chars are never tampered with; other
columns are ignored; an empty table gives no rows. H is the lower-case hex SHA-256 of inputs put together, digests as hex text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.grams import tidy
from quillon.llm.shared import CRC_TABLE, crc32_sql, discard, numbered, stage

BITS = 10  # a block has 2 ** BITS leaves, unless another number is given
LEFT, RIGHT, LONE = b"L", b"R", b"N"  # where a path's sibling stands; LONE: there is none, the node is hashed alone


# -- logs of blocks ------------------------------------------------------------------------------------------------------


def node(*digests: bytes) -> bytes:
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def append(leaves: list[bytes], height: int) -> list[bytes]:
    """All nodes of a block in the order in which they are complete; the last is the root, `height` levels above the leaves."""
    log: list[bytes] = []
    waiting: list[bytes | None] = [None] * height  # the complete node of each level whose right sibling is to come
    for made in leaves:
        log.append(made)
        level = 0
        while level < height and (left := waiting[level]) is not None:
            waiting[level], made = None, node(left, made)
            log.append(made)
            level += 1
        if level < height:
            waiting[level] = made
    last = None  # the incomplete node of the level
    for left in waiting:
        if left is not None or last is not None:
            last = node(*(d for d in (left, last) if d is not None))
            log.append(last)
    return log


def position(level: int, index: int, n: int) -> int:
    """Place in the log of n leaves of the index-th node of a level: the number of nodes that are complete before it."""
    end = (index + 1) << level
    if end <= n:  # before its last leaf all subtrees of the leaves before that one, then its own levels
        return 2 * (end - 1) - (end - 1).bit_count() + level
    whole = (n & -n).bit_length() - 1  # levels that end complete with the last leaf
    return 2 * n - n.bit_count() + level - whole - 1


def start(block: int, bits: int) -> int:
    """Place of a block's first node in the log of its tier: the blocks before it are whole subtrees."""
    return block * ((2 << bits) - 1)


def height_of(n: int, count: int, bits: int) -> int:
    """Levels of a block of `count` leaves in a tier of n: up to the root where it is the only block."""
    return bits if n > 1 << bits else (count - 1).bit_length()


def path(log: bytes, index: int, count: int, height: int) -> bytes:
    """Siblings of a leaf level by level, 33 bytes each: where it stands, and its digest."""
    out = []
    for level in range(height):
        other, last = index ^ 1, (count - 1) >> level
        if other > last:
            out.append(LONE + bytes(32))
        else:
            at = 32 * position(level, other, count)
            out.append((LEFT if other < index else RIGHT) + log[at : at + 32])
        index >>= 1
    return b"".join(out)


def fold(leaf: bytes, siblings: bytes) -> bytes:
    """The root that a leaf and its path give."""
    for at in range(0, len(siblings), 33):
        side, other = siblings[at : at + 1], siblings[at + 1 : at + 33]
        leaf = node(other, leaf) if side == LEFT else node(leaf, other) if side == RIGHT else node(leaf)
    return leaf


def proof_digest(siblings: bytes) -> bytes:
    return node(*(siblings[at + 1 : at + 33] for at in range(0, len(siblings), 33) if siblings[at : at + 1] != LONE))


def one_by_one(b: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch, one block's log at a time."""
    for k in range(b.num_rows):
        yield b.slice(k, 1).to_pylist()[0]


# -- leaves --------------------------------------------------------------------------------------------------------------


def leaf_digest(*columns: Column) -> Column:
    """SHA-256 over columns, each `-` if null, else its UTF-8 byte count, a colon and itself."""
    told = (F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in (c.cast("string") for c in columns))
    return F.unhex(F.sha2(F.concat(*told), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(key, id, digest, forged): key orders trees (null first); forged is the leaf of a document whose n_chars was raised by 1."""
    rest = F.col("n_chars").cast("decimal(20,0)")
    made = lambda n: leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    key = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang")))
    return docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("id"), made(rest).alias("digest"), F.when(tampered & rest.isNotNull(), made(rest + 1)).alias("forged"))


# -- tiers ---------------------------------------------------------------------------------------------------------------

CHUNK = "key string, block long, n long, count int, start long, log binary, root binary, ids array<long>, forged array<binary>"


def _tier(rows: DataFrame, name: str, bits: int) -> DataFrame:
    """Logs of the blocks of one tier; of documents their ids and forged leaves go with them."""
    deep = "id" in rows.columns
    rows = rows.select("key", (F.shiftright("index", bits)).alias("block"), "index", "n", "digest", *(["id", "forged"] if deep else []))

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("index")
        first = t.slice(0, 1).to_pylist()[0]
        log = append(t["digest"].to_pylist(), height_of(first["n"], t.num_rows, bits))
        row = {"key": first["key"], "block": first["block"], "n": first["n"], "count": t.num_rows, "start": start(first["block"], bits), "log": b"".join(log), "root": log[-1]}
        row |= {"ids": t["id"].to_pylist(), "forged": t["forged"].to_pylist()} if deep else {"ids": None, "forged": None}
        return pa.Table.from_pylist([row], SCHEMA)

    return stage(rows.groupBy("key", "block").applyInArrow(build, CHUNK), name)


SCHEMA = pa.schema([
    ("key", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("count", pa.int32()), ("start", pa.int64()), ("log", pa.binary()), ("root", pa.binary()),
    ("ids", pa.list_(pa.int64())), ("forged", pa.list_(pa.binary())),
])


def tiers(rows: DataFrame, name: str, bits: int) -> list[DataFrame]:
    """The tiers' logs over leaves (key, index, n, digest, ...): blocks of leaves, blocks of their roots, and so on."""
    out = [_tier(rows, name, bits)]
    most = out[0].agg(F.max("n")).first()[0] or 0
    while (most := -(-most >> bits)) > 1:
        up = out[-1].filter(F.col("n") > 1 << bits)
        out.append(_tier(up.select("key", F.col("block").alias("index"), F.ceil(F.col("n") / (1 << bits)).alias("n"), F.col("root").alias("digest")), name, bits))
    return out


def roots(logs: list[DataFrame], bits: int) -> DataFrame:
    """(key, digest) of the trees' roots: what the only block of a tier ends in."""
    ends = [t.filter(F.col("n") <= 1 << bits).select("key", F.col("root").alias("digest")) for t in logs]
    out = ends[0]
    for more in ends[1:]:
        out = out.union(more)
    return out


def _paths(logs: DataFrame, above: DataFrame | None, bits: int) -> DataFrame:
    """(key, index, path, subroot) of the leaves of a tier, up to the root of all; above: the same of its blocks."""
    rows = logs.select("key", "block", "n", "count", "log")
    up = rows.withColumns({"above": F.lit(b""), "subroot": F.lit(None).cast("binary")}) if above is None else rows.join(above.select("key", F.col("index").alias("block"), F.col("path").alias("above"), "subroot"), ["key", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in one_by_one(b):
                own = height_of(r["n"], r["count"], bits)
                ways = [path(r["log"], k, r["count"], own) + r["above"] for k in range(r["count"])]
                first = r["block"] << bits
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["key"]] * len(ways)), pa.array(range(first, first + len(ways)), pa.int64()), pa.array(ways, pa.binary()), pa.array([r["subroot"]] * len(ways), pa.binary())],
                    ["key", "index", "path", "subroot"],
                )

    return up.mapInArrow(tidy(run), "key string, index long, path binary, subroot binary")


@dataclass
class Manifest:
    """Logs of the trees' tiers and of the tree over their roots, and the root of all (None: no documents)."""

    trees: list[DataFrame]
    top: list[DataFrame]
    subroots: DataFrame
    root: bytes | None
    bits: int

    def above(self) -> DataFrame:
        """(key, index, path, subroot) of the blocks of the lowest tier: what their leaves' proofs share."""
        up = None
        for t in reversed(self.top):
            up = stage(_paths(t, up, self.bits), "top-paths")
        top = self.subroots.join(up.select(F.col("index").alias("no"), "path"), "no").select("key", F.lit(0).cast("long").alias("index"), "path", F.col("digest").alias("subroot"))
        out = None
        for t in reversed(self.trees):  # a tree ends in the tier of its only block; below, its blocks have paths of the tier above
            ending = t.filter(F.col("n") <= 1 << self.bits).select("key").join(top, "key").select("key", "index", "path", "subroot")
            here = ending if out is None else ending.unionByName(out)
            if t is self.trees[0]:
                return stage(here, "paths")
            out = stage(_paths(t, here, self.bits), "paths")
        raise AssertionError


def manifest(docs: DataFrame, bits: int = BITS) -> Manifest:
    staged = stage(leaves(docs), "leaves")
    lists = numbered(staged, "key", ["id", "digest"], "ordered")
    trees = tiers(lists, "logs", bits)
    ends = stage(roots(trees, bits), "subroots")
    order = numbered(ends.select(F.lit("").alias("key"), F.col("key").alias("of"), "digest"), "key", ["of"], "ordered-roots")
    subroots = stage(order.select(F.col("index").alias("no"), F.col("of").alias("key"), "digest", "n"), "numbered-roots")
    top = tiers(subroots.select(F.lit("").alias("key"), F.col("no").alias("index"), "n", "digest"), "top-logs", bits)
    whole = roots(top, bits).first()
    discard(staged)
    return Manifest(trees, top, subroots, None if whole is None else bytes(whole.digest), bits)


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proofs(m: Manifest) -> DataFrame:
    """(key, id, leaf, path, subroot): the siblings of every leaf, 33 bytes each, in the order of `fold`."""
    rows = m.trees[0].select("key", "block", "n", "count", "log", "ids").join(m.above().select("key", F.col("index").alias("block"), "path", "subroot"), ["key", "block"])

    bits = m.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in one_by_one(b):
                log, count = r["log"], r["count"]
                own = height_of(r["n"], count, bits)
                at = [32 * position(0, k, count) for k in range(count)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["key"]] * count), pa.array(r["ids"], pa.int64()), pa.array([log[a : a + 32] for a in at], pa.binary()),
                    pa.array([path(log, k, count, own) + r["path"] for k in range(count)], pa.binary()), pa.array([r["subroot"]] * count, pa.binary()),
                ], ["key", "id", "leaf", "path", "subroot"])

    return rows.mapInArrow(tidy(run), "key string, id long, leaf binary, path binary, subroot binary")


def audit(m: Manifest) -> DataFrame:
    """Each document's proof checked: the root that its leaf, forged where a forged one is given, and its siblings fold to."""
    rows = m.trees[0].select("key", "block", "n", "count", "log", "ids", "forged").join(m.above().select("key", F.col("index").alias("block"), "path", "subroot"), ["key", "block"])
    root, bits = m.root or b"", m.bits
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in one_by_one(b):
                log, count, subroot = r["log"], r["count"], r["subroot"].hex()
                own = height_of(r["n"], count, bits)
                done: list[tuple] = []
                for k, (doc, forged) in enumerate(zip(r["ids"], r["forged"], strict=True)):
                    at = 32 * position(0, k, count)
                    leaf, way = log[at : at + 32], path(log, k, count, own) + r["path"]
                    folded = fold(forged or leaf, way)
                    done.append((doc, leaf.hex(), subroot, root.hex(), proof_digest(way).hex(), folded.hex(), folded == root))
                kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)

    return rows.mapInArrow(tidy(run), RESULT)


def query(docs: DataFrame, bits: int = BITS) -> DataFrame:
    return audit(manifest(docs, bits))


def _told(x: str) -> str:
    return f"CASE WHEN ({x}) IS NULL THEN '-' ELSE strlen(({x})::VARCHAR) || ':' || ({x})::VARCHAR END"


def _leaf(n: str) -> str:
    return "sha256(" + " || ".join(_told(x) for x in ("doc_id", "source", "lang", n, "text")) + ")"


_UP = "SELECT key, k + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM {t} WHERE n > 1 GROUP BY key, k, i // 2"
_CLIMB = "SELECT f.r, f.key, f.k + 1, f.i // 2, (f.n + 1) // 2, sha256(CASE WHEN s.h IS NULL THEN cur WHEN f.i % 2 = 1 THEN s.h || cur ELSE cur || s.h END), proof || coalesce(s.h, '') FROM {f} AS f LEFT JOIN {t} AS s ON s.key IS NOT DISTINCT FROM f.key AND s.k = f.k AND s.i = xor(f.i, 1) WHERE f.n > 1"
SQL = f"""WITH RECURSIVE {CRC_TABLE},
d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS r
 FROM (SELECT doc_id, lang, {_leaf('n_chars')} AS leaf, CASE WHEN {crc32_sql('doc_id')} % 7 = 0 THEN {_leaf('n_chars + 1')} END AS forged FROM documents, tab)),
lv AS (SELECT lang AS key, 0 AS k, i, leaf AS h, n FROM d UNION ALL {_UP.format(t='lv')}),
sub AS (SELECT key, h, row_number() OVER (ORDER BY key NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM lv WHERE n = 1),
tv AS (SELECT 0 AS key, 0 AS k, i, h, n FROM sub UNION ALL {_UP.format(t='tv')}),
low AS (SELECT r, lang AS key, 0 AS k, i, n, coalesce(forged, leaf) AS cur, '' AS proof FROM d UNION ALL {_CLIMB.format(f='low', t='lv')}),
high AS (SELECT r, 0 AS key, 0 AS k, sub.i, sub.n, cur, proof FROM low JOIN sub ON sub.key IS NOT DISTINCT FROM low.key WHERE low.n = 1 UNION ALL {_CLIMB.format(f='high', t='tv')})
SELECT doc_id, leaf, sub.h AS subroot, tv.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = tv.h AS verified
FROM d JOIN high USING (r) JOIN sub ON sub.key IS NOT DISTINCT FROM d.lang JOIN tv ON tv.n = 1 WHERE high.n = 1"""
