"""Exact duplicates by distributed MSD radix partitioning.

A text's first digit is its length in bytes with its first FIRST bytes; each later digit is a run of bytes WIDER times as
long as the one before. A round counts the rows of each (group, digit), so hot groups shrink to a row a task before the
shuffle, and joins the counts back, a join whose hot keys adaptive execution splits. Rows alone in their group leave at
once, those whose bytes have ended leave with their group, and only the others' remaining bytes are written to the shared
folder for the next round. Digits are the bytes themselves: no digest decides equality. (text_sha256 is output; a group
goes by the number of one of its rows.)

The row that stays is found by one aggregate and joined back by group, so that a hot group is split like any hot key.

Defined results: null counts as the empty text; a null id is an id that comes last; rows repeated with the same id and
text are members like others, and `kept` is true for one of them; extra columns are ignored by `exact_groups`; an empty
table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import one_of_each, stage

FIRST, WIDER = 64, 32
BLANKS = " \t\n\x0b\x0c\r"


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = F.translate(text, BLANKS, "")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.char_length(text).alias("points"), norm.alias("norm"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumns({"bytes": F.col("norm").cast("binary"), "sha": F.unhex(F.sha2("norm", 256))}).drop("norm")
    return rows.withColumn("digit", F.concat(F.lpad(F.hex(F.octet_length("bytes")), 8, "0").cast("binary"), F.substring("bytes", 1, FIRST)))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256 and points (the original text's length), one row for each row of docs."""
    rows = _rows(docs, id_col, text_col)
    name = F.min("row")
    own = ["id", "points", "sha", "row"]
    # counts of shared digits alone, joined in one way at every size, and written so that the join meets them as an exchange of its own and can split a hot digit
    count = lambda of, keys, to: stage(of.groupBy(*keys).agg(F.count("*").alias("n"), name.alias(to)).filter("n > 1").drop("n"), "digits")
    shared = F.col("group").isNotNull()
    active = stage(
        rows.join(count(rows, ["digit"], "group").hint("merge"), "digit", "left").select(*own, "group", F.when(shared, F.expr(f"substring(bytes, {FIRST + 1})")).alias("rest")),
        "radix",
    )
    singles, groups, width = [], [], FIRST
    while True:
        singles.append(active.filter(~shared))
        some = active.filter(shared)
        groups.append(some.filter(F.octet_length("rest") == 0).select(*own, "group"))
        left = some.filter(F.octet_length("rest") > 0)
        if left.isEmpty():
            break
        width *= WIDER
        left = left.withColumn("digit", F.substring("rest", 1, width))
        split = count(left, ["group", "digit"], "next")
        active = stage(
            left.join(split.hint("merge"), ["group", "digit"], "left").select(*own, F.col("next").alias("group"), F.when(F.col("next").isNotNull(), F.expr(f"substring(rest, {width + 1})")).alias("rest")),
            "radix",
        )
    grouped = reduce(DataFrame.unionByName, groups)
    # the longest, then the smallest id (null last), then any one of equal rows
    best = F.min(F.struct((-F.col("points")).alias("shorter"), F.col("id").isNull().alias("unnamed"), "id", "sha", "row"))
    kept = stage(grouped.groupBy("group").agg(F.count("*").alias("group_size"), best.alias("best")), "best")
    grouped = grouped.join(kept, "group").select("id", "points", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "sha")
    alone = reduce(DataFrame.unionByName, singles).select("id", "points", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    every = alone.unionByName(grouped)
    return every.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), "points")


def query(docs: DataFrame) -> DataFrame:
    return exact_groups(docs).drop("points")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one of each group, with their columns as they are."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = exact_groups(docs).groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), "points").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    key = {"id": F.col("doc_id").cast("long"), "sha": F.sha2(F.translate(text, BLANKS, ""), 256), "points": F.char_length(text)}
    return one_of_each(docs, key, kept)


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
"""
