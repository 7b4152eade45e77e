"""Held-out accuracy of the models; the pipeline against a brute-force version of its stages."""

import corpus_pipeline
import pytest
from test_exact_answers import brute_groups

from quillon.llm import bpe, quality, toxicity
from quillon.llm.exact import BLANKS
from quillon.llm.shared import stage
from quillon.session import table

DATA = "/root/testdata/sf0.1"


def auc(pairs):
    ones, zeros = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


@pytest.mark.parametrize(("op", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy(spark, op, label):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    got = op.query(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    assert auc([(r[label], r.score) for r in got]) > 0.95
    assert sum(r.predicted == r[label] for r in got) > 0.9 * len(got)


def test_passages_are_located(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    model = toxicity.fit(docs, labels)
    toxic = docs.join(labels.filter("toxic = 1"), "doc_id", "left_semi")
    found = toxicity.find_passages(toxic, model)
    assert found.select("doc_id").distinct().count() > 0.7 * toxic.count()
    for r in found.join(docs, "doc_id").limit(20).collect():
        assert r.passage in r.text


def test_pipeline_is_its_stages(spark, sf):
    docs = table(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    one = stage(corpus_pipeline.drop_toxic(spark, docs, sf), "t")
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    clean = {r.doc_id for r in toxicity.score(docs, model).filter("predicted = 0").collect()}
    assert {r.doc_id for r in one.collect()} == clean and one.columns == docs.columns
    two = stage(corpus_pipeline.drop_copies(spark, one, sf), "e")
    norm = {}
    for k in sorted(clean, key=lambda k: (-len(texts[k]), k)):
        norm.setdefault(texts[k].translate({ord(c): None for c in BLANKS}), k)
    assert sorted(r.doc_id for r in two.collect()) == sorted(norm.values())
    three = stage(corpus_pipeline.drop_near_copies(spark, two, sf), "n")
    groups = brute_groups({k: texts[k] for k in norm.values()})
    assert sorted(r.doc_id for r in three.collect()) == sorted(set(groups.values()))
    four = stage(corpus_pipeline.mix(spark, three, sf), "m")
    assert four.columns == docs.columns and {r.doc_id for r in four.collect()} <= set(groups.values())
    lib = bpe.codec(bpe.vocabulary()).tokenizer
    want = sorted((r.doc_id, len(lib.encode(r.text, add_special_tokens=False).ids)) for r in four.collect())
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == want
