"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables, for every operator."""

import pytest
from pyspark.sql import functions as F

from quillon.llm import bpe, chat, exact, minhash, mixing, quality, rules, suffixes, toxicity, warc

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, label string, bits string, size string, `group` string, name string, rest string, `class` string"
LONG = "wörd " * 40_000 + "x" * 50_000


def rows():
    filler = (None, "k", "l", "b", "s", "g", "n", "r", "c")
    plain = "one two three four five six seven eight nine ten eleven"
    return [(k, t, "en", s, None if t is None else len(t), *filler) for k, t, s in [
        (1, plain, "a"), (1, plain, "a"), (2, plain, None), (3, None, "b"), (4, "", None), (5, " \t\n", "a"),
        (6, LONG, "b"), (None, "null id", "c"), (None, None, None), (7, "one two", "a"), (8, "日本 語\x00\x01", "é"),
    ]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SHAPE).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("run", [exact.query, minhash.query, rules.query, bpe.query, mixing.query])
def test_a_row_for_each_row(docs, none, run):
    got = run(docs).collect()
    assert len(got) == len(rows()) and sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows())
    assert run(none).count() == 0


@pytest.mark.parametrize("op", [quality, toxicity])
def test_scores_lie_in_range(spark, docs, none, labels, op):
    for lab in (labels, labels.limit(0)):
        got = op.query(docs, lab).collect()
        assert len(got) == len(rows()) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert op.query(none, labels).count() == 0


def test_suffixes_and_chat_and_warc(spark, docs, none, labels):
    got = {(r.doc_id, r.n_words) for r in suffixes.query(docs.union(docs.filter("doc_id = 6").withColumn("doc_id", F.lit(60).cast("long")))).collect()}
    assert {d for d, _ in got} == {6, 60}
    assert suffixes.query(none).count() == 0
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), "id", "key")
    back = warc.query(pages).collect()
    assert len(back) == len(rows()) and warc.query(pages.limit(0)).count() == 0
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), "text", "id")
    assert chat.query(turns).count() == len(rows()) and chat.query(turns.limit(0)).count() == 0


def test_filters_keep_columns(docs, none, labels):
    for keep in (exact.keep_one, minhash.keep_one, mixing.mix_documents, lambda d: toxicity.keep_clean(d, toxicity.fit(d, labels))):
        assert keep(docs).columns == docs.columns and keep(none).columns == docs.columns and keep(none).count() == 0
    # equal rows leave one row; texts that are blank alone are equal
    assert exact.keep_one(docs).filter("text LIKE 'one two three%'").count() == 1
    assert exact.keep_one(docs).filter("trim(coalesce(text, '')) IN ('', '\t\n')").count() == 1
    assert minhash.keep_one(docs).filter("text LIKE 'one two three%'").count() == 1


def test_pipeline_on_edges_and_on_nothing(spark, docs, none, labels, tmp_path):
    import corpus_pipeline

    for name, rows_ in (("edges", docs), ("empty", none)):
        rows_.select("doc_id", "text", "lang", "source", "n_chars", "key").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.limit(0).write.parquet(f"{tmp_path}/{name}/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/edges").collect()
    assert {r.doc_id for r in got} <= {1, 6, None, 7, 8} and {1, 6} <= {r.doc_id for r in got} and all(r.n_tokens > 0 for r in got)
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
