"""Mixing sources to target weights.

Words of a source, documents in an order that depends on their ids alone, are packed into blocks of BLOCK words. The mix is
put together shard by shard, about SLOTS blocks each: the quotas of the sources, in blocks, are halved again and again by
multinomial draws over what is left of them until each shard has its counts, so any task can draw the counts of any shard
by itself and all shards add up to the quotas. Slot k of a source, counted through the shards, stands for block
`permute(k mod blocks)` of pass `k div blocks`, a keyed pseudorandom permutation of the indexes that changes with the pass
and the seed. A shard is the blocks of its slots; slots and blocks are joined by index. A block serves 3 times at most, so
a document gives 3 times its words at most.

Only the totals of sources pass through the driver, at most SOURCES rows of them (more raise an error: weights are given to
sources one by one, so they are few).

Defined results: a null or empty text has size 0 and gives 0 words; null is a source of its own, last in order; ids may
repeat and be null: rows are packed one by one and a repeated id's rows are told apart by size; a source without words
has target 0; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.grams import mix, tidy
from quillon.llm.shared import WORD, stage

BLOCK, SLOTS, CROWD, SOURCES, LIMIT, TASKS, SEED = 64, 1 << 15, 1 << 12, 100_000, 3, 20_000, 11

_WORD = re.compile(WORD)


def targets(sizes: list[int], weights: list[float], limit: float = LIMIT) -> list[float]:
    """Shares of all words by weight, none above `limit` times its size; what a full source leaves goes to the others."""
    out, open_, left = [0.0] * len(sizes), [k for k, n in enumerate(sizes) if n], float(sum(sizes))
    while open_:
        weight = sum(weights[k] for k in open_)
        full = [k for k in open_ if left * weights[k] / weight > limit * sizes[k]]
        if not full:
            for k in open_:
                out[k] = left * weights[k] / weight
            break
        for k in full:
            out[k] = float(limit * sizes[k])
        left -= sum(out[k] for k in full)
        open_ = [k for k in open_ if k not in full]
    return out


def draw(quotas: np.ndarray, slots: int, rng: np.random.Generator) -> np.ndarray:
    """Multinomial counts of `slots` slots by what is left of the quotas, never beyond it."""
    left, out = quotas.copy(), np.zeros(len(quotas), np.int64)
    while slots > 0:
        got = np.minimum(rng.multinomial(slots, left / left.sum()), left)
        out += got
        left -= got
        slots -= int(got.sum())
    return out


def shard_counts(quotas: np.ndarray, shards: int, shard: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(first slot of each source, count of each source) of one shard, by the draws on its way down from all shards."""
    start, left, lo, hi = np.zeros(len(quotas), np.int64), quotas.copy(), 0, shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        half = draw(left, int(left.sum()) * (mid - lo) // (hi - lo), np.random.default_rng([seed, lo, hi]))
        if shard < mid:
            left, hi = half, mid
        else:
            start, left, lo = start + half, left - half, mid
    return start, left


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Keyed permutations of 0..size-1: a four-round Feistel network over the next even power of two, walked until inside."""
    bits = np.ceil(np.log2(np.maximum(size, 2))).astype(np.uint64)
    half = (bits + np.uint64(1)) // np.uint64(2)
    low = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], low[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for turn in range(4):
            left, right = right, left ^ (mix(right + k + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _slots(quotas: list[int], blocks: list[int], shards: int, seed: int):
    """The function that makes (shard, slot, source_no, block) of all slots of shards (id)."""
    quota = np.array(quotas, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column(0).to_pylist():
                start, count = shard_counts(quota, shards, shard, seed)
                slot = 0
                for source in np.flatnonzero(count).tolist():
                    k = np.arange(start[source], start[source] + count[source])
                    size = np.full(len(k), blocks[source])
                    key = mix((k // size).astype(np.uint64) * np.uint64(1 << 32) + np.uint64(source + 1) + np.uint64(seed << 20))
                    same = lambda x: pa.array(np.full(len(k), x, np.int64))  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([same(shard), pa.array(np.arange(slot, slot + len(k))), same(source), pa.array(permute(k % size, size, key))], ["shard", "slot", "source_no", "block"])
                    slot += len(k)

    return run


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int):
    """Documents with their place (source_no, offset) and target, as a table, and slots (shard, slot, source_no, block)."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"))
    rows = stage(rows.withColumn("order", F.xxhash64("id", "size")), "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).limit(SOURCES + 1).collect()
    if len(totals) > SOURCES:
        raise ValueError(f"a mix has at most {SOURCES} sources")
    totals.sort(key=lambda r: (r.source is None, r.source or ""))  # by code point: Python compares them
    sizes = [r.words for r in totals]
    goal = targets(sizes, [1 + k % 3 for k in range(len(sizes))])
    blocks = [-(-n // BLOCK) for n in sizes]
    quotas = [min(LIMIT * b, round(g * b / n)) if n else 0 for n, g, b in zip(sizes, goal, blocks, strict=True)]
    shards = max(1, -(-sum(quotas) // SLOTS))
    slots = spark.range(0, shards, 1, min(shards, TASKS)).mapInArrow(_slots(quotas, blocks, shards, seed), "shard long, slot long, source_no long, block long")
    names = spark.createDataFrame([(k, r.source, r.words, goal[k]) for k, r in enumerate(totals)], "source_no long, source string, source_size long, target double")
    # the order of a source's documents: buckets of about CROWD rows, their sums first, then the order within each
    buckets = max(1, -(-max((r.n for r in totals), default=0) // CROWD))
    rows = rows.withColumn("bucket", F.pmod("order", F.lit(buckets)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0)))
    within = Window.partitionBy("source", "bucket").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).withColumnRenamed("source", "s").withColumnRenamed("bucket", "b")
    bases = bases.join(F.broadcast(names), bases["source"].eqNullSafe(names["source"])).drop(names["source"])
    placed = placed.join(bases, placed["s"].eqNullSafe(bases["source"]) & (placed["b"] == bases["bucket"]))
    placed = placed.select("id", "source", "size", "source_no", "source_size", "target", (F.col("base") + F.col("inner")).alias("offset"))
    return stage(placed, "placed"), slots


def _cut(placed: DataFrame) -> DataFrame:
    """(source_no, block, offset, size, lo, words): the part of a document in each block that holds some of it."""
    block = F.explode(F.expr(f"sequence(offset div {BLOCK}, (offset + size - 1) div {BLOCK})"))
    parts = placed.filter("size > 0").select("id", "source_no", "offset", "size", block.alias("block"))
    return parts.withColumn("lo", F.greatest(F.col("block") * BLOCK, "offset") - F.col("offset")).withColumn(
        "words", F.least((F.col("block") + 1) * BLOCK, F.col("offset") + F.col("size")) - F.col("offset") - F.col("lo")
    )


def _pieces(placed: DataFrame, slots: DataFrame) -> DataFrame:
    """The parts of documents that the mix takes, with their block's uses and the shards that use it (LIMIT at most)."""
    uses = slots.groupBy("source_no", "block").agg(F.count("*").alias("uses"), F.collect_set("shard").alias("shards"))
    # slots come from a range of few rows, which says nothing of how many they are: never broadcast what is made of them
    return _cut(placed).join(uses.hint("merge"), ["source_no", "block"])


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """shard, slot, source_no, block, id, first_word and n_words: what every slot of every shard holds, in any order."""
    placed, slots = _plan(docs, id_col, text_col, source_col, seed)
    got = slots.hint("merge").join(_cut(placed), ["source_no", "block"])
    return got.select("shard", "slot", "source_no", "block", F.col("id").alias(id_col), F.col("lo").alias("first_word"), F.col("words").alias("n_words"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """id, size, source_size, target, taken, and shards (in how many of them words of it stand), of every document."""
    placed, slots = _plan(docs, id_col, text_col, source_col, seed)
    pieces = _pieces(placed, slots).groupBy("source_no", "offset")
    taken = pieces.agg(F.sum(F.col("words") * F.col("uses")).alias("taken"), F.size(F.array_distinct(F.flatten(F.collect_set("shards")))).cast("long").alias("shards"))
    some = placed.filter("size > 0").join(taken.hint("merge"), ["source_no", "offset"], "left")
    none = placed.filter("size = 0").withColumns({"taken": F.lit(None).cast("long"), "shards": F.lit(None).cast("long")})
    out = some.select(*none.columns).unionByName(none)
    zero = F.lit(0).cast("long")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", zero).alias("taken"), F.coalesce("shards", zero).alias("shards"), "source")


def query(docs: DataFrame) -> DataFrame:
    return mixed(docs)


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus with the columns of docs: pass e of a document has its words in blocks that serve more than e times.

    A pass that takes every word keeps the text as it is; the words of others are joined by blanks. `n_chars`, where there
    is such a column, is that of the new text. Rows equal in all columns take their places one by one.
    """
    names, row = docs.columns, [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn("__row", F.xxhash64(*row))
    placed, slots = _plan(keyed.withColumn("__key", F.struct(F.col(f"`{id_col}`").alias("id"), F.col("__row").alias("row"))), "__key", text_col, source_col, SEED)
    parts = _pieces(placed, slots).groupBy("source_no", "offset").agg(F.sort_array(F.collect_list(F.struct("lo", "words", "uses"))).alias("parts"))
    taken = placed.filter("size > 0").join(parts.hint("merge"), ["source_no", "offset"]).select(F.col("id.id").alias("__id"), F.col("id.row").alias("__hash"), F.col("parts").alias("__parts"))
    # rows equal in all columns are one row here, and its places are several
    once = keyed.dropDuplicates([id_col, "__row"])
    got = once.join(taken.hint("merge"), once[id_col].eqNullSafe(taken["__id"]) & (once["__row"] == taken["__hash"])).select(*row, "__parts")
    at, counted = names.index(text_col), names.index("n_chars") if "n_chars" in names else None

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows_, texts = [], []
                for k, (text, pieces) in enumerate(zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist(), strict=True)):
                    words = _WORD.findall(text)
                    for e in range(max(p["uses"] for p in pieces)):
                        some = [p for p in pieces if p["uses"] > e]
                        whole = sum(p["words"] for p in some) == len(words)
                        rows_.append(k)
                        texts.append(text if whole else " ".join(w for p in some for w in words[p["lo"] : p["lo"] + p["words"]]))
                out = part.select(range(len(names))).take(pa.array(rows_, pa.int64()))
                columns = out.columns
                columns[at] = pa.array(texts, out.column(at).type)
                if counted is not None:
                    columns[counted] = pa.array([len(t) for t in texts]).cast(out.column(counted).type)
                yield pa.RecordBatch.from_arrays(columns, schema=out.schema)

    return got.mapInArrow(tidy(passes), docs.schema)
