"""Quality classifier: supervised subword embeddings.

Words, word pairs (a word twice running is one pair, whatever the word) and character n-grams of words (blanks mark a
word's ends) are hashed into buckets; a text is the mean of its buckets' vectors and of PADDING zero vectors, so that a few
features of a short text decide little, and a softmax over two classes is trained on it by numpy stochastic gradient descent. Because the mean
and the last layer are linear, scoring needs one number a bucket: a text's margin is the mean of those numbers.

Training reads at most `SAMPLE` labelled rows of each class, those with the smallest hash of doc_id, each with all its
buckets: at most 2 * SAMPLE * 2**BITS * 6 bytes reach the driver, a few tens of MB for ordinary texts. Scoring covers every
row and whole texts.

Defined results: null and empty texts get the score of the bias alone, 0 to 1 like any other; repeated rows score alike;
other columns are ignored; an empty table gives no rows; without labels of both classes every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.grams import Texts, mix, slices, tidy
from quillon.llm.shared import held_out, labelled_sample

BITS, DIM, SAMPLE, EPOCHS, RATE, SEED, PADDING = 16, 8, 1500, 10, 0.5, 7, 40
ORDERS = (2, 3, 4)
FOLDS, FOLD = 4, 2
_KIND = mix(np.arange(1, 9, dtype=np.uint64))


def _buckets(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, position) of all features of a slice, in runs by kind."""
    shift = np.uint64(64 - BITS)
    kinds, places = [], []
    words = t.words()
    kinds.append((words * _KIND[0]) >> shift)
    places.append(t.starts)
    if len(words) > 1:
        inside = np.ones(len(words) - 1, bool)
        cut = t.first[1:-1]
        inside[cut[(cut > 0) & (cut < len(words))] - 1] = False
        pairs = (words[:-1] * _KIND[1] + words[1:] * _KIND[2]) >> shift
        pairs[words[:-1] == words[1:]] = _KIND[6] >> shift  # any word twice running is one feature
        kinds.append(pairs[inside])
        places.append(t.starts[:-1][inside])
    # characters of the whole slice, and where each begins; a blank before a text belongs to the text that follows it
    point = np.frombuffer(t.buf.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    head = np.flatnonzero((t.buf & 0xC0) != 0x80)
    inner = t.word[head]
    for n in ORDERS:
        at = np.arange(len(head) - n + 1)
        whole = inner[1 : len(at) + 1].copy()  # blanks only at the ends
        for j in range(2, n - 1):
            whole &= inner[j : len(at) + j]
        if n == 2:
            whole = inner[: len(at)] | inner[1 : len(at) + 1]
        at = at[whole]
        h = point[at]
        for j in range(1, n):
            h = (h << np.uint64(21)) ^ (h >> np.uint64(43)) ^ point[at + j]  # three characters fit; a fourth is mixed in
        kinds.append((mix(h) * _KIND[1 + n]) >> shift)
        places.append(head[at + 1])
    return np.concatenate(kinds).astype(np.int64), np.concatenate(places)


@dataclass
class Model:
    weights: np.ndarray  # margin for label 1, a number a bucket
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        out = []
        for _, _, data, offsets in slices(column, 1 << 19):
            t = Texts(data, offsets)
            buckets, places = _buckets(t)
            text = np.searchsorted(t.seps, places, "right") - 1
            text = np.minimum(text, t.n - 1)
            total = np.bincount(text, self.weights[buckets], t.n)
            out.append(total / (np.bincount(text, minlength=t.n) + PADDING) + self.bias)
        margin = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(margin, -60, 60)))


def train(labels: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """Stochastic gradient descent, one document a step; the rate falls to zero. Classes weigh the same in total."""
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(1 << BITS), 0.0)
    rng = np.random.default_rng(SEED)
    vectors = (rng.random((1 << BITS, DIM), np.float32) - 0.5) / DIM
    last = np.zeros((DIM, 2), np.float32)
    bias = np.zeros(2, np.float32)
    share = [len(labels) / (2 * max(1, (labels == k).sum())) for k in (0, 1)]
    steps, step = EPOCHS * len(labels), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(labels)):
            ids, weight = bags[k]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = weight @ vectors[ids] if len(ids) else np.zeros(DIM, np.float32)
            z = mean @ last + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            p *= share[labels[k]] * rate
            if len(ids):
                vectors[ids] -= (weight * np.float32(len(ids) ** 0.5))[:, None] * (last @ p)[None, :]
            last -= np.outer(mean, p)
            bias -= p
    return Model((vectors @ (last[:, 1] - last[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, weights = [], []
        for _, _, data, offsets in slices(b.column(1), 1 << 19):
            t = Texts(data, offsets)
            buckets, places = _buckets(t)
            text = np.minimum(np.searchsorted(t.seps, places, "right") - 1, t.n - 1)
            pairs, n = np.unique(text * (1 << BITS) + buckets, return_counts=True)
            cuts = np.searchsorted(pairs, np.arange(t.n + 1) << BITS)
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                ids.append((pairs[lo:hi] & ((1 << BITS) - 1)).astype(np.uint16).tobytes())
                weights.append((n[lo:hi] / (n[lo:hi].sum() + PADDING)).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(ids, pa.binary()), pa.array(weights, pa.binary())], ["doc_id", "label", "ids", "weights"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    sample = labelled_sample(docs, labels, label, SAMPLE, FOLDS, FOLD).select("doc_id", "text", "label")
    rows = sample.mapInArrow(tidy(_bags), f"doc_id {dict(docs.dtypes)['doc_id']}, label int, ids binary, weights binary").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("ids", "ascending")])  # the order of steps must not hang on that of tasks
    bags = [(np.frombuffer(i, np.uint16).astype(np.int64), np.frombuffer(w, np.float32)) for i, w in zip(rows["ids"].to_pylist(), rows["weights"].to_pylist(), strict=True)]
    return train(rows["label"].to_numpy().astype(int), bags)


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and predicted for every row. The broadcast model has 2**BITS numbers, whatever the input."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(b.column(1)))], [id_col, "score"])

    got = docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double")
    return got.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    got = score(docs, fit(docs, labels))
    return got.select("doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), "score", "predicted")
