"""Quality rules as a bitmask ledger.

`ledger` evaluates every rule once and keeps its measurements and the failure bits. `apply_policy` reads a verdict from
the bits under a versioned policy and `ablate` counts, by bitwise aggregation, what each rule removes alone, so neither
opens a text again.

Lines and windows are equal where their bytes are; hashes only bring candidates together.

Defined results: a null or empty text has no words and fails `few_words`; repeated rows are measured one by one; columns
besides id and text are ignored, whatever their names; an empty table gives an empty ledger. A text is never cut: slices
hold whole texts, and one text's arrays are the memory bound of a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.grams import Texts, slices, table_of, tidy, windows

MEASURES = "n_words n_chars word_chars n_symbols n_upper n_marks n_lines n_dup_lines n_repeat_words".split()
WINDOW = 5
SYMBOLS, UPPER, MARKS = table_of(b"#*$%&|<>"), table_of(bytes(range(65, 91))), table_of(b"!?")
_c = F.col
#: name -> fails when true; the place in this list is the rule's bit, so new rules go to the end
RULES: list[tuple[str, Column | str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("many_symbols", "100 * n_symbols > 30 * n_words"),
    ("upper_case", "100 * n_upper > 50 * word_chars"),
    ("many_marks", "100 * n_marks > 50 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 40 * n_words"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "many_symbols", "upper_case", "many_marks", "repeated_lines", "short_words", "long_words"),
}


def mask_of(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def _measure(column: pa.Array) -> dict[str, np.ndarray]:
    out: dict[str, list] = {m: [] for m in MEASURES}
    for _, _, data, offsets in slices(column):
        t = Texts(data, offsets)
        n_words = np.diff(t.first)
        heads = (t.buf & 0xC0) != 0x80
        heads[t.seps] = False
        out["n_words"].append(n_words)
        out["n_chars"].append(t.counts(heads))
        out["word_chars"].append(t.counts(heads & t.word))
        for name, kind in (("n_symbols", SYMBOLS), ("n_upper", UPPER), ("n_marks", MARKS)):
            out[name].append(t.counts(kind[t.buf]))
        # lines with a word: those that hold a word's first byte; a word's line is told by the line breaks before it
        breaks = t.buf == 10
        breaks[t.seps] = True
        ends = np.flatnonzero(breaks)
        line = np.unique(np.searchsorted(ends, t.starts)) - 1  # between ends[line] and ends[line + 1]
        text = np.searchsorted(t.seps, ends[line], "right") - 1
        key = t.ids(ends[line] + 1, ends[line + 1]) * t.n + text
        _, at = np.unique(key, return_index=True)
        lines = np.bincount(text, minlength=t.n)
        out["n_lines"].append(lines)
        out["n_dup_lines"].append(lines - np.bincount(text[at], minlength=t.n))
        owner = t.text_of_word()
        keys, at = windows(t.ids(t.starts, t.ends), t.first, WINDOW)
        keys = keys * t.n + owner[at]
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(n_words.sum() + 1, np.int64)
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + WINDOW, -1)
        out["n_repeat_words"].append(np.bincount(owner[np.cumsum(cover)[:-1] > 0], minlength=t.n))
    return {m: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for m, v in out.items()}


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the measurements and `bits`: bit k is set when rule k of RULES fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = _measure(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[m]) for m in MEASURES)], [id_col, *MEASURES])

    kind = dict(docs.dtypes)[id_col]
    measured = docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = sum((F.when(F.expr(rule), F.lit(BIT[name])).otherwise(0) for name, rule in RULES), F.lit(0)).cast("long")
    return measured.withColumn("bits", bits)


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with base_failed and kept."""
    fails = lambda name: F.col("bits").bitwiseAND(F.lit(mask_of(name))) != 0
    return rows.withColumn("base_failed", fails("base")).withColumn("kept", ~fails("base") & ~fails(policy))


def ablate(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of the policy: rows that fail it, rows that fail nothing else, and rows kept without it."""
    mask, out = mask_of(policy), []
    under = F.col("bits").bitwiseAND(F.lit(mask))
    for name in POLICIES[policy]:
        out += [
            F.count_if(under.bitwiseAND(F.lit(BIT[name])) != 0).alias(f"{name}_failed"),
            F.count_if(under == BIT[name]).alias(f"{name}_alone"),
            F.count_if(under.bitwiseAND(F.lit(mask & ~BIT[name])) == 0).alias(f"{name}_kept_without"),
        ]
    totals = rows.agg(*out)
    parts = ", ".join(f"'{n}', {n}_failed, {n}_alone, {n}_kept_without" for n in POLICIES[policy])
    return totals.select(F.expr(f"stack({len(POLICIES[policy])}, {parts}) AS (rule, failed, failed_alone, kept_without)"))


def query(docs: DataFrame) -> DataFrame:
    got = apply_policy(ledger(docs))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "bits")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, list_aggregate(w[i:i+4], 'string_agg', ' ') AS k
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, range(0, 5) AS r(o) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM
          (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d)
          WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
             length(regexp_replace(text, '[^!?]', '', 'g'))::BIGINT AS n_marks,
             coalesce(lines.n_lines, 0)::BIGINT AS n_lines, coalesce(lines.n_dup, 0)::BIGINT AS n_dup_lines,
             coalesce(covered.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, ((n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT
      + 4 * (100 * n_symbols > 30 * n_words)::BIGINT + 8 * (100 * n_upper > 50 * word_chars)::BIGINT
      + 16 * (100 * n_marks > 50 * n_words)::BIGINT + 32 * (100 * n_dup_lines > 50 * n_lines)::BIGINT
      + 64 * (word_chars < 2 * n_words)::BIGINT + 128 * (word_chars > 40 * n_words)::BIGINT)::BIGINT AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 AS base_failed,
       bits = 0 AS kept, bits FROM b
"""
