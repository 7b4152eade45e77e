"""Repeated passages by sparse suffix arrays.

Words are hashed. A suffix is retained where the hash of GRAM words is the least of PICK neighbouring ones, so that equal
passages retain equal suffixes: any PASSAGE words that two texts share hold a retained suffix whose first PREFIX words lie in
the passage. Suffixes whose first PREFIX words stand in one text alone leave at once (an aggregate of the first and last
text of each, before any suffix is dealt). The others, each with the PASSAGE words that follow and the words before it, are
put in suffix order (dealt by range, sorted within) and compared with their neighbours of other texts: the words that
agree to the right and to the left make a match, and a match of PASSAGE words or more is a repeated passage.

A neighbour agrees longest to the right. That decides a run of suffixes with equal first PREFIX words where the run is a pair,
or all of it agrees to the left as far as a passage reaches. In other runs a text farther off may agree longer to the left,
and at the border of two ranges the neighbour is out of sight: such suffixes are open, and the windows of PASSAGE words
about them which no match holds are counted, so that the result is exact. Passages that touch or overlap are one. Hot suffixes
are rows like others: ranges also part by text, and counts come from partial aggregation.

Equal texts are one class (128 bits of MD5) from the start, and their class stands for them in all steps. Suffixes and
windows are told apart by 64 bits, words of matches by 32.

Defined results: null and empty texts have no passage; a text shorter than PASSAGE words has none, even if it has copies;
a passage that is repeated in one text only is none; rows with null or repeated ids are told apart by their text; a table
without repeats, or without rows, gives no rows; ids must be whole numbers or text that is one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.grams import _STEPS, Texts, shingles, slices, tidy
from quillon.llm.shared import discard, stage

PASSAGE, GRAM, PICK = 50, 8, 32
PREFIX = PASSAGE - PICK + 1
SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, place, until, key, before) of the retained suffixes with PREFIX words behind them; before: hash of the words that a
    passage may have on the left, of fewer near a text's beginning."""
    for b in batches:
        for lo, hi, data, offsets in slices(b.column(1)):
            t = Texts(data, offsets)
            words = t.words()
            keys, at = shingles(words, t.first, PREFIX)
            grams, where = shingles(words, t.first, GRAM)
            lefts, left_at = shingles(words, t.first, PICK - 1)
            before = np.repeat(t.first[:-1], np.diff(t.first)) - np.arange(len(words))  # near the beginning: how near, below 1
            inner = left_at + PICK - 1 < np.repeat(t.first[1:], np.diff(t.first))[left_at]
            before[left_at[inner] + PICK - 1] = lefts[inner].astype(np.int64)
            by_place = np.full(len(words) + 1, np.iinfo(np.uint64).max, np.uint64)
            by_place[where] = grams
            # all texts of the slice at once: places without a gram never are the least of a window inside one text
            picked = np.zeros(len(words), bool)
            picked[_picked(by_place[:-1], t.first)] = True
            keep = picked[at]
            at, keys = at[keep], keys[keep]
            owner = t.text_of_word()[at]
            # suffixes of one text that begin alike (a word over and over) make one row, from the first place to the last
            order = np.lexsort((at, keys, owner))
            at, keys, owner = at[order], keys[order], owner[order]
            new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])) if len(at) else at
            last = np.append(new[1:], len(at))[: len(new)] - 1
            place = lambda k: pa.array((at[k] - t.first[owner[k]]).astype(np.int32))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).take(pa.array(owner[new])), place(new), place(last), pa.array(keys[new].astype(np.int64)), pa.array(before[at[new]])], ["class", "place", "until", "key", "before"])


def _picked(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minimisers of each text of a slice."""
    n = len(grams)
    if not n:
        return np.zeros(0, np.int64)
    low, span = grams.copy(), 1
    top = np.full(PICK, np.iinfo(np.uint64).max, np.uint64)
    low = np.concatenate([low, top])
    while span * 2 <= PICK:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    # low[i]: least of grams[i : i + PICK]; windows must lie in one text and hold PICK grams, or be a short text's only one
    ends = np.repeat(first[1:], np.diff(first)) - GRAM + 1  # behind the last gram of the place's text
    starts = np.arange(n)
    heads = np.repeat(first[:-1], np.diff(first))
    whole = (starts + PICK <= ends) | ((starts == heads) & (ends > starts) & (ends - starts < PICK))
    out = np.zeros(n, bool)
    left = np.flatnonzero(whole)
    for shift in range(PICK):  # every place that holds its window's least value
        at = left + shift
        ok = at < np.minimum(n, ends[left])
        at, own = at[ok], left[ok]
        out[at[grams[at] == low[own]]] = True
    return np.flatnonzero(out)


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, start, words, anchors, open) from (class, text, places): hashes of the words about retained suffixes, these, and
    from where to where windows about open ones begin."""
    for b in batches:
        for k in range(b.num_rows):
            for _, _, data, offsets in slices(b.column(1).slice(k, 1)):
                t = Texts(data, offsets)
                words = t.words()
                places = np.array([(p["place"], p["until"], p["open"]) for p in b.column(2)[k].as_py()], np.int64)
                places = places[np.argsort(places[:, 0])]
                lo, hi = np.maximum(places[:, 0] - (PASSAGE - PREFIX), 0), np.minimum(places[:, 1] + PASSAGE, len(words))
                cut = np.flatnonzero(lo[1:] > np.maximum.accumulate(hi)[:-1]) + 1
                for rows in np.split(np.arange(len(lo)), cut):
                    first, end = int(lo[rows[0]]), int(hi[rows].max())
                    anchors = np.unique(places[rows, :2].ravel()) - first
                    spans = [{"first": int(a) - (PASSAGE - PREFIX), "end": int(z) + 1} for a, z, free in places[rows].tolist() if free]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(k, 1), pa.array([first], pa.int32()), pa.array([words[first:end].tobytes()], pa.binary()), pa.array([anchors.tolist()], pa.list_(pa.int32())), pa.array([spans], SPANS)],
                        ["class", "start", "words", "anchors", "open"],
                    )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, place, right, left) of the retained suffixes of regions: 32 bits of each word, behind and before (0: none)."""
    for b in batches:
        for k in range(b.num_rows):
            words = np.frombuffer(b.column(2)[k].as_py(), np.uint64)
            at, n = np.array(b.column(3)[k].as_py(), np.int64), PASSAGE - PREFIX
            small = np.concatenate([np.zeros(n, np.uint64), (words >> np.uint64(32)) | np.uint64(1), np.zeros(PASSAGE, np.uint64)]).astype(">u4")
            right = small[n + at[:, None] + np.arange(PASSAGE)]
            left = small[n + at[:, None] - 1 - np.arange(n)]
            place = at + b.column(1)[k].as_py()
            own = b.column(0).slice(k, 1).take(pa.array(np.zeros(len(at), np.int64)))
            yield pa.RecordBatch.from_arrays([own, pa.array(place.astype(np.int32)), pa.array([x.tobytes() for x in right], pa.binary()), pa.array([x.tobytes() for x in left], pa.binary())], ["class", "place", "right", "left"])


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from the first agree, row by row."""
    return np.logical_and.accumulate((a == b) & (a != 0), axis=1).sum(1)


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, first, end, border) of matches of PASSAGE words and more between neighbours of unlike classes, in suffix order; and,
    as borders, the places of suffixes whose neighbour may lie in the range before or behind."""
    held: pa.RecordBatch | None = None
    runs = 0  # runs of one class before this batch's first

    def borders(rows: pa.RecordBatch) -> pa.RecordBatch:
        place = rows.column(1).cast(pa.int64())
        return pa.RecordBatch.from_arrays([rows.column(0), place, place, pa.array(np.ones(rows.num_rows, bool))], ["class", "first", "end", "border"])

    for b in batches:
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        n = b.num_rows
        if not n:
            continue
        own = np.array(b.column(0).to_pylist(), "S16")
        place = b.column(1).to_numpy().astype(np.int64)
        right = np.frombuffer(b"".join(b.column(2).to_pylist()), ">u4").reshape(n, -1)
        left = np.frombuffer(b"".join(b.column(3).to_pylist()), ">u4").reshape(n, -1)
        heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))  # runs of one class
        run = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, n)))
        before = np.where(run > 0, heads[run] - 1, -1)
        after = np.append(heads, n)[run + 1]
        if runs < 2:
            yield borders(b.filter(pa.array(runs + run < 2)))
        rows = np.concatenate([np.flatnonzero(before >= 0), np.flatnonzero(after < n)])
        with_ = np.concatenate([before[before >= 0], after[after < n]])
        l, r = _agree(left[rows], left[with_]), _agree(right[rows], right[with_])
        long = l + r >= PASSAGE
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[long])), pa.array(place[rows[long]] - l[long]), pa.array(place[rows[long]] + r[long]), pa.array(np.zeros(int(long.sum()), bool))], ["class", "first", "end", "border"])
        held = b.slice(max(0, int(heads[-1]) - 1))  # the last run meets its next neighbour in the next batch
        runs += max(0, len(heads) - 2)
    if held is not None:
        yield borders(held)


def _marked(spans: list[tuple[int, int]], first: int, n: int) -> np.ndarray:
    """Which of the n numbers from `first` lie in a span."""
    marks = np.zeros(n + 1, np.int64)
    if spans:
        at = np.clip(np.array(spans, np.int64) - first, 0, n)
        at = at[at[:, 0] < at[:, 1]]
        np.add.at(marks, at[:, 0], 1)
        np.add.at(marks, at[:, 1], -1)
    return np.cumsum(marks)[:n] > 0


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, start, key, sure) of the windows of PASSAGE words about open suffixes of a region; sure: a match holds it."""
    for b in batches:
        for k in range(b.num_rows):
            words = np.frombuffer(b.column(2)[k].as_py(), np.uint64)
            n, first = len(words) - PASSAGE + 1, b.column(1)[k].as_py()
            if n <= 0:
                continue
            spans = b.column(4)[k].as_py() or []
            free = _marked([(p["first"], p["end"]) for p in b.column(3)[k].as_py()] + [(p["first"] - (PASSAGE - PREFIX), p["first"] + 1) for p in spans if p["border"]], first, n)
            sure = _marked([(p["first"], p["end"] - PASSAGE + 1) for p in spans if not p["border"]], first, n)
            at = np.flatnonzero(free)
            total = np.zeros(n, np.uint64)
            for j in range(PASSAGE):
                total += words[j : j + n] * _STEPS[j]
            keys = total ^ (total >> np.uint64(32))
            own = b.column(0).slice(k, 1).take(pa.array(np.zeros(len(at), np.int64)))
            yield pa.RecordBatch.from_arrays([own, pa.array((first + at).astype(np.int32)), pa.array(keys[at].astype(np.int64)), pa.array(sure[at])], ["class", "start", "key", "sure"])


def _merged(rows: DataFrame) -> DataFrame:
    """(class, spans) with spans that touch or overlap made one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k in range(b.num_rows):
                at = np.array(sorted((p["first"], p["end"]) for p in b.column(1)[k].as_py()), np.int64)
                cut = np.flatnonzero(at[1:, 0] > np.maximum.accumulate(at[:, 1])[:-1]) + 1
                out.append([{"first": int(p[0, 0]), "end": int(p[:, 1].max())} for p in np.split(at, cut)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))], ["class", "spans"])

    return rows.mapInArrow(run, "class binary, spans array<struct<first: long, end: long>>")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, first_word, end_word, n_words and copies (rows with this very text) of every repeated passage."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("class", F.unhex(F.md5("text")))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    names = stage(rows.select("id", "class", words.alias("words")), "classes")
    classes = names.groupBy("class").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.max("words").alias("words"))
    two = [F.min(F.xxhash64("class")).alias("low"), F.max(F.xxhash64("class")).alias("high")]
    suffixes = stage(rows.select("class", "text").mapInArrow(tidy(_suffixes), "class binary, place int, until int, key long, before long"), "suffixes")
    # written, so that the join meets it as an exchange of its own and can split a hot key
    run = suffixes.groupBy("key").agg(*two, F.count("*").alias("n"), F.max(F.col("until") - F.col("place")).alias("wide"), F.min("before").alias("l0"), F.max("before").alias("l1"))
    shared = stage(run.filter("low <> high").select("key", F.expr("wide > 0 OR n > 2 AND l0 <> l1").alias("open")), "shared")
    places = suffixes.join(shared, "key").groupBy("class").agg(F.collect_set(F.struct("place", "until", "open")).alias("places"))
    picked = places.join(classes.select("class", "id"), "class").withColumnsRenamed({"class": "own", "id": "rep"})
    # copies with one id are told from each other by nothing: any of them gives the class its words
    texts = rows.join(picked, F.col("id").eqNullSafe(F.col("rep")) & (F.col("class") == F.col("own")))
    regions = stage(texts.select("own", "text", "places").mapInArrow(tidy(_regions), "class binary, start int, words binary, anchors array<int>, open array<struct<first: long, end: long>>"), "regions")
    discard(suffixes)
    order = ["right", "class", "place"]
    contexts = regions.mapInArrow(tidy(_contexts), "class binary, place int, right binary, left binary")
    sorted_ = contexts.repartitionByRange(*order).sortWithinPartitions(*order)
    found = stage(sorted_.mapInArrow(tidy(_matches), "class binary, first long, end long, border boolean").distinct(), "matches")
    held = found.groupBy("class").agg(F.collect_list(F.struct("first", "end", "border")).alias("held"))
    matches = found.filter("NOT border").select("class", "first", "end")
    windows = regions.join(held, "class", "left").select("class", "start", "words", "open", "held").mapInArrow(tidy(_windows), "class binary, start int, key long, sure boolean")
    twice = stage(windows.groupBy("key").agg(*two, F.bool_and("sure").alias("sure")).filter("low <> high AND NOT sure").select("key"), "twice")
    rest = windows.filter("NOT sure").join(twice, "key").select("class", F.col("start").cast("long").alias("first"), (F.col("start") + PASSAGE).cast("long").alias("end"))
    spans = _merged(matches.union(rest).groupBy("class").agg(F.collect_set(F.struct("first", "end")).alias("spans")))
    copied = classes.filter((F.col("copies") > 1) & (F.col("words") >= PASSAGE))
    whole = copied.select("class", F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("words").alias("end"))).alias("spans"))
    every = whole.unionByName(spans.join(copied.select("class"), "class", "left_anti"))
    every = every.join(classes.select("class", "copies"), "class")
    got = names.select("id", "class").join(every, "class").select("id", "copies", F.explode("spans").alias("span"))
    return got.select(F.col("id").alias(id_col), F.col("span.first").alias("first_word"), F.col("span.end").alias("end_word"), (F.col("span.end") - F.col("span.first")).alias("n_words"), "copies")


def query(docs: DataFrame) -> DataFrame:
    return repeats(docs)
