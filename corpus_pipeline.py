"""The training-data pipeline: toxicity, exact dedup, near dedup, mixing, BPE.

Each stage works on all rows that the one before kept and, but for the last, returns the columns of documents.

Defined results: null and empty texts are clean, equal to each other in exact dedup (one stays), alone in near dedup, and leave
at mixing, which takes no word of them; rows equal in all columns leave one; a text longer than any memory slice is scored,
compared and encoded whole; of equal texts the longest original stays, then the smallest id, and a null id comes last there and
first among near copies; extra columns are carried to the last stage, which returns doc_id and its own columns; empty
documents give no rows, and empty labels make no text toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, exact, minhash, mixing, toxicity
from quillon.llm.shared import stage
from quillon.session import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score stays below 0.5; the model learns from the labelled rows outside its held-out fold."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of equal texts (blanks apart)."""
    return exact.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates."""
    return minhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, up to three rows a document."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    return bpe.encode(docs, digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("bpe", encode),
]

#: SQL can't express the scores of toxicity; tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
