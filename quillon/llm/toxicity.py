"""Toxic passages by maximum-scoring segment search.

Tokens and their beginnings (PREFIXES bytes) are hashed into 2**BITS buckets. A bucket's score is the log-odds of toxic
against clean labelled texts that hold it, with an informative Dirichlet prior (the pooled frequencies, weighted
PRIOR), kept where its z-value exceeds Z. A token scores as its own bucket if that is kept, else as its longest
beginning that is kept, else nothing, less a DRIFT that makes an ordinary token cost something. One linear scan finds all maximal-scoring segments of a text. A segment of
score S in n tokens has the extreme-value excess lambda * S - ln(K * n), where lambda solves E[exp(lambda * s)] = 1 over
clean tokens and K is fitted on clean training texts; excesses above zero are significant and add up. A logistic curve
over that sum, fitted on the training rows, gives the score.

Training reads at most `SAMPLE` labelled rows of each class, those with the smallest hash of doc_id, one for an id that
repeats; they are written once and counts are summed by Spark into 2**BITS rows at most. Scoring covers every row and whole texts.

Defined results: null and empty texts have no segment and get the curve's lowest score; repeated rows score alike; other
columns are ignored; an empty table gives no rows; without labels of both classes no text is toxic (score 0).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.grams import Texts, mix, slices, tidy
from quillon.llm.shared import discard, held_out, labelled_sample, stage

BITS, SAMPLE, PRIOR, Z, DRIFT, FLOOR, PREFIXES = 20, 8000, 0.05, 4.0, 0.25, -2.0, (6, 5, 4)
FOLDS, FOLD = 5, 0
_FOLD_CASE = np.arange(256, dtype=np.uint8)
_FOLD_CASE[65:91] += 32
#: a token is a run of letters, digits, apostrophes and bytes above 127
_BREAK = np.ones(256, bool)
_BREAK[[39, *range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[Texts, list[tuple[np.ndarray, np.ndarray]]]:
    """The slice, and (tokens, buckets) of whole tokens and of each length of beginnings, where a token is longer."""
    t = Texts(data, offsets, _FOLD_CASE, _BREAK)
    shift, out = np.uint64(64 - BITS), [(np.arange(len(t.starts)), (t.words() >> np.uint64(64 - BITS)).astype(np.int64))]
    for n in PREFIXES:
        at = np.flatnonzero(t.ends - t.starts > n)
        out.append((at, (mix(t.hashes(t.starts[at], t.starts[at] + n) + np.uint64(n)) >> shift).astype(np.int64)))
    return t, out


def _looked_up(table: np.ndarray, keys: list[tuple[np.ndarray, np.ndarray]], first: np.ndarray) -> np.ndarray:
    """Token scores: the first kept entry of the token and its beginnings, long before short."""
    scores = table[keys[0][1]]
    for at, buckets in keys[1:]:
        scores[at] = np.where(scores[at] == 0, table[buckets], scores[at])
    again = np.flatnonzero(keys[0][1][1:] == keys[0][1][:-1]) + 1
    again = again[~np.isin(again, first)]  # the token before a text's first belongs to another text
    scores[again] = np.minimum(scores[again], 0)  # a token twice running is no more evidence than once
    return np.maximum(scores - np.float32(DRIFT), np.float32(FLOOR))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of one sequence, in linear time.

    A candidate keeps the total before it and the total after it. A new one looks for the last candidate with a smaller
    total before; if that one's total after is smaller too, both merge and the search goes on from the merged one.
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    totals = np.cumsum(scores)
    found: list[list] = []  # [start, end, before, after, link]
    for k in at.tolist():
        new = [k, k + 1, float(totals[k] - scores[k]), float(totals[k]), -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], -1]
            del found[j:]
    return [(s, e, after - before) for s, e, before, after, _ in found]


@dataclass
class Model:
    token: np.ndarray  # score a bucket
    rate: float  # lambda
    size: float  # K
    curve: tuple[float, float]

    def passages(self, scores: np.ndarray) -> list[tuple[int, int, float]]:
        """Significant segments with their excess."""
        if self.rate <= 0:
            return []
        base = np.log(max(self.size * len(scores), 1e-12))
        return [(s, e, x) for s, e, score in segments(scores) if (x := self.rate * score - base) > 0]

    def texts(self, column: pa.Array) -> Iterator[tuple[Texts, int, np.ndarray]]:
        """(slice, text, token scores) of each text that has a positive token; None scores for the rest."""
        for _, _, data, offsets in slices(column):
            t, buckets = _tokens(data, offsets)
            scores = _looked_up(self.token, buckets, t.first)
            total = np.zeros(len(scores) + 1, np.int64)
            np.cumsum(scores > 0, out=total[1:])
            some = total[t.first[1:]] > total[t.first[:-1]]
            for k in range(t.n):
                yield t, k, scores[t.first[k] : t.first[k + 1]] if some[k] else None

    def excess(self, column: pa.Array) -> np.ndarray:
        return np.array([0.0 if s is None else sum(x for _, _, x in self.passages(s)) for _, _, s in self.texts(column)], np.float64)

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.rate <= 0:
            return np.zeros(len(column))
        slope, shift = self.curve
        return 1 / (1 + np.exp(-np.clip(slope * np.log1p(self.excess(column)) + shift, -60, 60)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        label = b.column(1).to_numpy().astype(np.int64)
        for lo, _, data, offsets in slices(b.column(0)):
            t, keys_of = _tokens(data, offsets)
            text = t.text_of_word()
            once = np.unique(np.concatenate([text[at] << BITS | buckets for at, buckets in keys_of]))
            keys, n = np.unique((once & ((1 << BITS) - 1)) * 2 + label[lo + (once >> BITS)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys >> 1), pa.array((n * (keys & 1)).astype(np.int64)), pa.array((n * (1 - (keys & 1))).astype(np.int64))], ["bucket", "toxic", "clean"])


def log_odds(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Kept log-odds a bucket, from how many toxic and clean texts hold it; 0: not kept."""
    n1, n0 = toxic.sum(), clean.sum()
    prior = PRIOR * (toxic + clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = toxic + prior, clean + prior
        delta = np.log(a / np.maximum(n1 + prior.sum() - a, 1e-9)) - np.log(b / np.maximum(n0 + prior.sum() - b, 1e-9))
        z = delta / np.sqrt(1 / a + 1 / b)
    return np.where((toxic + clean > 0) & (np.abs(z) > Z), delta, 0.0)


def _rate(scores: np.ndarray, weight: np.ndarray) -> float:
    """lambda: the positive root of E[exp(lambda * s)] = 1; 0 where the scores have none."""
    keep = weight > 0
    s, p = scores[keep], weight[keep] / max(1, weight[keep].sum())
    if not len(s) or s.max() <= 0 or (p * s).sum() >= 0:
        return 0.0 if not len(s) or (p * s).sum() >= 0 else 1.0
    lo, hi = 0.0, 1.0
    value = lambda x: (p * np.exp(np.minimum(x * s, 500))).sum()
    while value(hi) < 1 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 1 else (lo, mid)
    return hi


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (0 at least) and shift by Newton's method with a little shrinkage."""
    w = np.array([1.0, 0.0])
    rows = np.stack([x, np.ones_like(x)], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        grad = rows.T @ (p - y) + 0.05 * w
        hess = (rows * (p * (1 - p))[:, None]).T @ rows + np.eye(2) * 0.05
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(w[0])), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    spark = docs.sparkSession
    sample = stage(labelled_sample(docs, labels, label, SAMPLE, FOLDS, FOLD), "sample")  # read three times below
    counts = sample.select("text", "label").mapInArrow(tidy(_counts), "bucket long, toxic long, clean long")
    got = counts.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()
    toxic, clean = np.zeros(1 << BITS), np.zeros(1 << BITS)
    at = got["bucket"].to_numpy()
    toxic[at], clean[at] = got["toxic"].to_numpy(), got["clean"].to_numpy()
    if not toxic.sum() or not clean.sum():
        discard(sample)
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 1.0, (0.0, -60.0))
    token = log_odds(toxic, clean)
    rate = _rate(np.maximum(token - DRIFT, FLOOR), clean)
    first = Model(token.astype(np.float32), rate, 1.0, (1.0, 0.0))
    shared = spark.sparkContext.broadcast(first)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = shared.value
            rows = [(0.0, 0) if s is None else (max((x for _, _, x in segments(s)), default=0.0), len(s)) for _, _, s in m.texts(b.column(0))]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([float(r[0]) for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.int64())], ["label", "top", "n"])

    tops = sample.select("text", "label").mapInArrow(tidy(best), "label int, top double, n long").toArrow()
    y, top, n = (tops[c].to_numpy().astype(float) for c in ("label", "top", "n"))
    with_one = (y == 0) & (top > 0)
    # K by the mean of a Gumbel variable: E[lambda * S - ln n] = ln K + Euler's constant, over clean texts with a segment
    size = float(np.exp(np.mean(rate * top[with_one] - np.log(n[with_one])) - 0.5772)) if with_one.any() else 1e-4
    scale = Model(token.astype(np.float32), rate, max(size, 1e-6), (1.0, 0.0))
    shared = spark.sparkContext.broadcast(scale)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(shared.value.excess(b.column(0)))], ["label", "excess"])

    rows = sample.select("text", "label").mapInArrow(tidy(sums), "label int, excess double").toArrow()
    discard(sample)
    y, x = rows["label"].to_numpy().astype(float), np.log1p(rows["excess"].to_numpy())
    order = np.lexsort((x, y))  # sums must not hang on the order of tasks
    return Model(scale.token, rate, scale.size, _logistic(x[order], y[order]))


def score(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and predicted for every row. The broadcast model has 2**BITS numbers, whatever the input."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(b.column(1)))], [id_col, "score"])

    got = docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double")
    return got.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, with their columns as they are."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.scores(b.column(at)) < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)


def find_passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, first and end token, excess and passage text of every significant passage."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows, m = b.column(0).to_pylist(), [], shared.value
            for k, (t, own, s) in enumerate(m.texts(b.column(1))):
                if s is not None:
                    raw = b.column(1)[k].as_py().encode()
                    for first, end, x in m.passages(s):
                        lo, hi = t.starts[t.first[own] + first], t.ends[t.first[own] + end - 1]
                        lo, hi = lo - t.seps[own] - 1, hi - t.seps[own] - 1
                        rows.append((ids[k], first, end, float(x), raw[lo:hi].decode(errors="replace")))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], pa.schema(list(zip(names, [b.column(0).type, pa.int64(), pa.int64(), pa.float64(), pa.string()], strict=True))))

    names = [id_col, "first_token", "end_token", "excess", "passage"]
    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {dict(docs.dtypes)[id_col]}, first_token long, end_token long, excess double, passage string")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    got = score(docs, fit(docs, labels))
    return got.select("doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), "score", "predicted")
