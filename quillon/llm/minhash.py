"""Near-duplicates by ProbMinHash, banding and verification.

A shingle is SHINGLE words (a shorter text is one shingle), its weight 1 however often the text has it, so that candidates
and verification go by one similarity. Each shingle is a Poisson process whose rate is its weight; an arrival falls on a
random register, which keeps its earliest; a shingle stops once its next arrival is later than every register. Two texts
agree on a register with the probability Jaccard of the weights, which for these is the Jaccard of the sets. BANDS bands of
ROWS registers make buckets; texts of one bucket are candidates, and the Jaccard of their sets decides (SIMILAR).

Texts of equal shingle sets are one class from the start (copies are never paired), and no step makes all pairs of a bucket:

1. A class is compared with the least head of its buckets (a bucket's head is its least class).
2. TURNS times: in buckets that still hold two components, classes of other components than its head's are compared with
   the head, which now is the class with the most links.
3. Among the classes whose buckets still hold two, a class is compared with the centre of each token of its prefix (_beside).
4. A prefix join (_across) finds every similar pair across the components that are left, without meeting within them.

Steps 1 to 3 only save work for step 4, which leaves no similar pair of a bucket unlinked, whatever the bucket's size. What
remains is the banding itself: a pair at 0.8 shares no bucket once in 37,000 times. Components of the links are the groups.
Counts and heads come from partial aggregation, hot keys of the joins are split by adaptive execution (no window or
aggregate stands on them), and the prefix join salts its own.

Defined results: null and empty texts have no shingle and stand alone; equal rows are in one group; a null id is an id that
sorts first; the group's smallest id stays, one row of it where ids repeat; ids must be whole numbers or text that is one;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.grams import _STEPS, Texts, mix, shingles, slices, tidy
from quillon.llm.graph import components
from quillon.llm.shared import discard, one_of_each, stage

SHINGLE, BANDS, ROWS, SIMILAR, TURNS, SALT, SEED = 5, 20, 4, 0.8, 1, 512, 0x5851F42D4C957F2D
REGISTERS = BANDS * ROWS
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def bags(t: Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, how often), sorted, of a slice."""
    words = t.words()
    keys, at = shingles(words, t.first, size)
    owner = t.text_of_word()[at]
    n = np.diff(t.first)
    for k in np.flatnonzero((n > 0) & (n < size)).tolist():
        w = words[t.first[k] : t.first[k + 1]]
        keys = np.append(keys, mix((w * _STEPS[: len(w)]).sum(keepdims=True) + np.uint64(len(w))))
        owner = np.append(owner, k)
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    if not len(keys):
        return owner, keys, np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])]))
    return owner[new], keys[new], np.diff(np.append(new, len(keys)))


def signatures(owner: np.ndarray, keys: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """The shingle that holds each of m registers of each of n texts (0: a text without shingles)."""
    reg, sig = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    limit = np.full(n, np.inf)
    key, text, rate = keys, owner, weight.astype(np.float64)
    state, x = mix(keys + np.uint64(SEED)), np.zeros(len(keys))
    while len(key):
        state = mix(state + _GOLD)
        x = x - np.log(((state >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / rate
        some = x < limit[text]
        key, text, rate, state, x = key[some], text[some], rate[some], state[some], x[some]
        at = text * m + ((mix(state ^ np.uint64(SEED)) >> np.uint64(33)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(reg, at, x)
        won = reg[at] == x
        sig[at[won]] = key[won]
        limit = reg.reshape(n, m).max(1)
    return sig.reshape(n, m)


def _names(owner: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each text's set of shingles, and the sets' sizes."""
    size = np.bincount(owner, minlength=n)
    cut = np.concatenate([[0], np.cumsum(size)])
    parts = []
    for step in (_GOLD, _GOLD ^ np.uint64(SEED)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(keys + step) if len(keys) else keys, dtype=np.uint64)])
        parts.append(mix(total[cut[1:]] - total[cut[:-1]] + size.astype(np.uint64)))
    return np.stack(parts, 1), size


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, offsets in slices(b.column(1)):
            t = Texts(data, offsets)
            owner, keys, often = bags(t)
            name, size = _names(owner, keys, t.n)
            sig = signatures(owner, keys, np.ones_like(often), t.n).reshape(t.n, BANDS, ROWS)
            band = mix((sig * _STEPS[:ROWS]).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _GOLD).astype(np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(t.n + 1, dtype=np.int32) * BANDS), pa.array(band.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([x.tobytes() for x in name], pa.binary()), pa.array(size.astype(np.int64)), flat, b.column(2).slice(lo, hi - lo), b.column(3).slice(lo, hi - lo)], ["id", "name", "n", "bands", "text_hash", "row"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """name and the sorted set of shingles, five bytes each."""
    for b in batches:
        for _, _, data, offsets in slices(b.column(0)):
            t = Texts(data, offsets)
            owner, keys, _ = bags(t)
            name, size = _names(owner, keys, t.n)
            cut = np.concatenate([[0], np.cumsum(size)]).tolist()
            raw = (keys >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in name], pa.binary()), pa.array([raw[5 * lo : 5 * hi] for lo, hi in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["name", "set"])


def _numbers(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 0.0
    both = np.sort(np.concatenate([a, b]))
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(both) - same)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        last: tuple[bytes, np.ndarray] = (b"", _numbers(b""))
        for k in range(b.num_rows):
            raw = b.column(3)[k].as_py()
            if raw != last[0]:
                last = raw, _numbers(raw)
            keep.append(jaccard(_numbers(b.column(2)[k].as_py()), last[1]) >= SIMILAR)
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose sets are similar enough; a table."""
    left = sets.withColumnsRenamed({"name": "a", "set": "set_a"})
    right = sets.withColumnsRenamed({"name": "b", "set": "set_b"})
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
    return stage(both.mapInArrow(tidy(_verified), "a binary, b binary"), "links")


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """name, label, set: a row for each shingle, with the set's size."""
    for b in batches:
        for k in range(b.num_rows):
            token = np.unique(_numbers(b.column(2)[k].as_py())).astype(np.int64)
            same = lambda x, n=len(token): pa.array([x]).take(pa.array(np.zeros(n, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(token), same(b.column(0)[k].as_py()), same(b.column(1)[k].as_py()), same(len(token))], ["token", "name", "label", "n"])


def _prefixes(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """name, n, at, token, salts, usual of the rows (name, label) that may be similar to one of another label; a table.

    Prefix filter: shingles have one order everywhere, those that a single label holds first and then by how many sets hold
    them. Of a similar pair the first common shingle stands in the first ninth of the smaller set and the first fifth of the
    larger; what follows it in either must still hold 4/9 of both sizes, the overlap that Jaccard 0.8 needs. All of this stays
    true when labels become one later. `usual` is how many sets hold a shingle of the set on average.
    """
    asked = rows.select("name", F.xxhash64("label").alias("label")).join(sets, "name")
    tokens = asked.select("name", "label", "set").mapInArrow(tidy(_spread), "token long, name binary, label long, n long")
    shared = tokens.groupBy("token").agg(F.count("*").alias("holders"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("token", "holders")
    held = tokens.join(shared, "token").groupBy("name").agg(F.first("n").alias("n"), F.sum("holders").alias("usual"), F.sort_array(F.collect_list(F.struct("holders", "token"))).alias("held"))
    own = held.withColumn("alone", F.col("n") - F.size("held")).filter("5 * alone <= n")
    prefix = own.select("name", "n", "alone", (F.col("usual") / F.col("n")).alias("usual"), F.posexplode(F.slice("held", F.lit(1), (F.floor(F.col("n") / 5) - F.col("alone") + 1).cast("int"))).alias("k", "h"))
    return stage(prefix.select("name", "n", (F.col("alone") + F.col("k")).alias("at"), "h.token", (1 + F.floor(F.col("h.holders") / SALT)).alias("salts"), "usual"), "prefixes")


def _beside(prefix: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefixes with the labels of rows (name, label); those of them of another label than their token's centre, with it; tables.

    The centre of a token is the holder whose shingles are the most usual: among copies changed at random it is the one nearest
    to what they were copied from, so that most are similar to it.
    """
    marked = stage(prefix.join(rows.select("name", F.xxhash64("label").alias("label")), "name"), "marked")
    centre = F.max(F.struct("usual", "name", "label", "n", "at")).alias("centre")
    # written, so that the join can split a hot token
    centres = stage(marked.groupBy("token").agg(centre, F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("token", "centre"), "centres")
    return marked, stage(marked.join(centres, "token").filter("label <> centre.label"), "beside")


def _may_be_similar(x: str, y: str) -> Column:
    """Whether sizes and places of the common token allow Jaccard 0.8."""
    need = 4 * (F.col(f"{x}.n") + F.col(f"{y}.n"))
    fit = (5 * F.col(f"{x}.n") >= 4 * F.col(f"{y}.n")) & (5 * F.col(f"{y}.n") >= 4 * F.col(f"{x}.n"))
    return fit & (9 * (F.col(f"{x}.n") - F.col(f"{x}.at")) >= need) & (9 * (F.col(f"{y}.n") - F.col(f"{y}.at")) >= need)


def _with_centres(beside: DataFrame) -> DataFrame:
    """(a, b): classes with the centres of their tokens, where these are of another label."""
    return beside.alias("x").filter(_may_be_similar("x", "centre")).select(F.col("x.name").alias("a"), F.col("centre.name").alias("b")).distinct()


def _across(marked: DataFrame, beside: DataFrame) -> DataFrame:
    """(a, b): a superset of the similar pairs of unlike labels. One of such a pair is of another label than its token's centre."""
    x = beside.drop("centre").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).alias("x")
    y = marked.withColumn("salt", F.pmod(F.xxhash64("name"), "salts")).alias("y")
    meet = (F.col("x.token") == F.col("y.token")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.label") != F.col("y.label")) & _may_be_similar("x", "y")
    return x.join(y, meet).select(F.least("x.name", "y.name").alias("a"), F.greatest("x.name", "y.name").alias("b")).distinct()


def _rest(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): a superset of the pairs of unlike labels among rows (name, label) whose sets are similar enough."""
    return _across(*_beside(_prefixes(rows, sets), rows))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after links between components: components of the graph of labels, which is small, joined back."""
    known = labels.withColumnRenamed("node", "n")
    ends = links.join(known.select(F.col("n").alias("a"), F.col("label").alias("la")), "a", "left").join(known.select(F.col("n").alias("b"), F.col("label").alias("lb")), "b", "left")
    ends = stage(ends.select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")), "ends")
    above = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    fresh = ends.select(F.col("a").alias("node")).union(ends.select("b")).distinct().join(labels.select("node"), "node", "left_anti")
    every = labels.union(fresh.select("node", F.col("node").alias("label")))
    moved = every.join(above.select(F.col("label").alias("up"), F.col("node").alias("label")), "label", "left")
    return stage(moved.select("node", F.coalesce("up", "label").alias("label")), "labels")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    return labels if links.isEmpty() else _joined(labels, links)


def _labelled(named: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of named with the label of their name; a class without links is its own."""
    return named.join(labels.withColumnRenamed("node", "name"), "name", "left").select(*named.columns, F.coalesce("label", "name").alias("label"))


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold two components and more, with their labels; a table."""
    named = _labelled(members.select("bucket", "name"), labels)
    mark = F.xxhash64("label")
    parts = named.groupBy("bucket").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).filter("low <> high")
    parts = stage(parts.select("bucket"), "parts")
    return stage(named.join(parts, "bucket"), "open")


def _with_heads(open_: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b): classes with the best-linked class of their bucket, where that is of another component."""
    ends = links.select(F.col("a").alias("name")).union(links.select("b")).groupBy("name").agg(F.count("*").alias("degree"))
    ranked = open_.join(ends, "name", "left").select("bucket", "name", "label", F.coalesce("degree", F.lit(0)).alias("degree"))
    heads = ranked.groupBy("bucket").agg(F.max(F.struct("degree", "name", "label")).alias("head"))
    asked = open_.select("bucket", "name", "label").join(heads, "bucket").filter("label <> head.label")
    return asked.select(F.col("name").alias("a"), F.col("head.name").alias("b")).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, group_id (the group's smallest id), group_size, kept, n_shingles and text_hash, one row for each row of docs."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the number of a row is written with it, so that it never changes; it tells equal rows apart
    numbered = texts.withColumns({"text_hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    rows = stage(numbered.mapInArrow(tidy(_sketch), "id long, name binary, n long, bands array<long>, text_hash long, row long"), "sketches")
    classes = rows.filter("n > 0").groupBy("name").agg(F.min("id").alias("id"), F.first("bands").alias("bands"))
    members = classes.select("name", F.explode("bands").alias("bucket"))
    # written, so that the join meets it as an exchange of its own and can split a hot bucket
    heads = stage(members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("name").alias("head")).filter("size > 1").drop("size"), "heads")
    members = stage(members.join(heads, "bucket"), "buckets")
    wanted = members.select("name").distinct().join(classes.select("name", "id"), "name")
    some = texts.join(wanted.select(F.col("id").alias("wid")).distinct(), F.col("id").eqNullSafe(F.col("wid")), "left_semi")
    sets = some.select("text").mapInArrow(tidy(_sets), "name binary, set binary").join(wanted.select("name"), "name", "left_semi")
    sets = stage(sets.groupBy("name").agg(F.first("set").alias("set")), "sets")
    pairs = members.groupBy(F.col("name").alias("a")).agg(F.min("head").alias("b")).filter("a <> b")
    links = _links(pairs, sets)
    labels, every = components(links), links
    made = [members, heads, sets, links]
    for _ in range(TURNS):
        made.append(_open(members, labels))
        links = _links(_with_heads(made[-1], every), sets)
        labels, every = _merged(labels, links), every.union(links)
        made.append(links)
    open_ = _open(members, labels)
    made.append(open_)
    if not open_.isEmpty():
        left = open_.select("name", "label").distinct()
        prefix = _prefixes(left, sets)
        marked, beside = _beside(prefix, left)
        links = _links(_with_centres(beside), sets)
        made += [prefix, marked, beside, links]
        if not links.isEmpty():
            labels = _merged(labels, links)
            marked, beside = _beside(prefix, _labelled(left.select("name"), labels))
            made += [marked, beside]
        links = _links(_across(marked, beside), sets)
        labels = _merged(labels, links)
        made.append(links)
    for old in made:
        discard(old)
    grouped = rows.join(labels.withColumnRenamed("node", "name"), "name", "left").select("id", "n", "text_hash", "row", F.coalesce("label", "name").alias("label"))
    alone = F.col("n") == 0
    first = stage(grouped.filter(~alone).groupBy("label").agg(F.min(F.struct("id", "n", "text_hash", "row")).alias("first"), F.count("*").alias("group_size")), "first")
    found = grouped.filter(~alone).join(first, "label").select("id", F.col("first.id").alias("group_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "n", "text_hash")
    empty = rows.filter(alone).select("id", F.col("id").alias("group_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "n", "text_hash")
    return found.unionByName(empty).withColumnsRenamed({"id": id_col, "n": "n_shingles"})


def query(docs: DataFrame) -> DataFrame:
    return near_groups(docs).drop("text_hash")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one of each group, with their columns as they are."""
    kept = near_groups(docs).groupBy(F.col("doc_id").alias("id"), "text_hash").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    return one_of_each(docs, {"id": F.col("doc_id").cast("long"), "text_hash": F.xxhash64(F.coalesce("text", F.lit("")))}, kept)
