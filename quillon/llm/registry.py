"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline
from quillon.llm import bpe, bytebpe, chat, exact, merkle, minhash, mixing, quality, rules, suffixes, toxicity, trie, warc
from quillon.session import table


def queries() -> dict:
    docs = lambda s, d: table(s, d, "documents")
    labels = lambda s, d: table(s, d, "labels")
    return {
        "pipeline": corpus_pipeline.run,
        "op1_mix_sources": lambda s, d: mixing.query(docs(s, d)),
        "op2_quality_classifier": lambda s, d: quality.query(docs(s, d), labels(s, d)),
        "op3_quality_rules": lambda s, d: rules.query(docs(s, d)),
        "op4_suffix_dedup": lambda s, d: suffixes.query(docs(s, d)),
        "op5_warc": lambda s, d: warc.query(table(s, d, "pages")),
        "op6_toxicity": lambda s, d: toxicity.query(docs(s, d), labels(s, d)),
        "op7_exact_dedup": lambda s, d: exact.query(docs(s, d)),
        "op8_bpe": lambda s, d: bpe.query(docs(s, d)),
        "op9_minhash": lambda s, d: minhash.query(docs(s, d)),
        "op10_chat_repair": lambda s, d: chat.query(table(s, d, "conversations")),
        "op11_byte_bpe": lambda s, d: bytebpe.query(docs(s, d)),
        "op12_merkle": lambda s, d: merkle.query(docs(s, d)),
        "op13_prefix_trie": lambda s, d: trie.query(table(s, d, "conversations")),
    }


def oracle_sql() -> dict[str, str]:
    pipeline = {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
    return {**pipeline, "op3_quality_rules": rules.SQL, "op5_warc": warc.SQL, "op7_exact_dedup": exact.SQL, "op12_merkle": merkle.SQL, "op13_prefix_trie": trie.SQL}
