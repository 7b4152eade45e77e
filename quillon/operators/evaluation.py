"""Retrieval quality: hit rates, reciprocal rank, gain, golden cases, samples and synthetic queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.retrieval import _BM, _ITEMS, _KW, _W, _keyword
from quillon.session import table


def hit_mrr_ndcg(results: DataFrame, relevant: Column, k: int = 10) -> DataFrame:
    """Over cases (query_id): share with a relevant result at 1, in 5 and in k, mean reciprocal rank, binary gain."""
    at = F.min(F.when(relevant, F.col("place")))
    each = results.groupBy("query_id").agg(at.alias("at"))
    within = lambda n: F.round(F.avg(F.when(F.col("at") < n, 1.0).otherwise(0.0)), 6)
    return each.agg(
        F.count("*").alias("cases"), within(1).alias("hit_1"), within(5).alias("hit_5"), within(k).alias("hit_k"),
        F.round(F.avg(F.coalesce(1 / (F.col("at") + 1), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.coalesce(1 / F.log2(F.col("at") + 2), F.lit(0.0))), 6).alias("ndcg"),
    )


def graded(results: DataFrame, rating: str, k: int = 5) -> DataFrame:
    """Per case: whether the first and any of k rate 2 or more, rating of the first, and gain against the best order of the list."""
    gain = (F.pow(F.lit(2.0), F.col(rating)) - 1) / F.log2(F.col("place") + 2)
    best = (F.pow(F.lit(2.0), F.col(rating)) - 1) / F.log2(F.col("ideal") + 2)
    rows = results.filter(F.col("place") < k).withColumn("ideal", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(rating), "place")) - 1)
    first = F.max(F.when(F.col("place") == 0, F.col(rating)))
    got = rows.groupBy("query_id").agg(first.alias("first"), F.max(rating).alias("most"), F.sum(gain).alias("dcg"), F.sum(best).alias("idcg"))
    return got.select("query_id", (F.col("first") >= 2).alias("p1"), (F.col("most") >= 2).alias("p5"), F.col("first").alias("rel1"), F.when(F.col("idcg") > 0, F.round(F.col("dcg") / F.col("idcg"), 6)).otherwise(0.0).alias("ndcg"))


def flow_hits(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Per case: expected flows found, missed and precision. results: query_id, flow; expected: query_id, flows."""
    found = results.groupBy("query_id").agg(F.collect_set("flow").alias("got"), F.count("*").alias("n"), F.collect_list("flow").alias("list"))  # k results
    rows = expected.join(found, "query_id", "left")
    empty = F.array().cast("array<string>")
    got, listed = F.coalesce("got", empty), F.coalesce("list", empty)
    hits = F.size(F.array_intersect("flows", got))
    right = F.size(F.filter(listed, lambda f: F.array_contains("flows", f)))
    return rows.select("query_id", hits.alias("hits"), F.array_join(F.array_sort(F.array_except("flows", got)), ",").alias("missing"), F.round(F.coalesce(right / F.col("n"), F.lit(0.0)), 6).alias("precision"))


def stratified(rows: DataFrame, group: str, order: list, size: int) -> DataFrame:
    """About `size` rows in proportion to the groups, one of each at least, the first by `order` (a hash for a random sample)."""
    total = rows.select(F.count("*")).scalar()
    counts = rows.groupBy(group).agg(F.count("*").alias("n")).withColumn("total", total)
    quota = counts.select(group, F.greatest(F.lit(1), F.floor(F.col("n") * size / F.col("total") + 0.5)).alias("quota"))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("place") <= size)
    return placed.join(quota, group).filter(F.col("place") <= F.col("quota")).drop("place", "quota")


def synthetic(cards: DataFrame) -> DataFrame:
    """Easy and medium queries of each card: its title, and how its flow works in a repository."""
    made = F.array(F.struct(F.lit("synthetic_easy").alias("kind"), F.col("title").alias("query")), F.struct(F.lit("synthetic_medium").alias("kind"), F.concat(F.lit("how does "), F.col("flow"), F.lit(" work in "), F.col("lang")).alias("query")))
    return cards.select("id", F.explode(made).alias("q")).select("id", "q.kind", "q.query")


def _judged(s, d, k):
    labels = table(s, d, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    return _keyword(s, d, k).join(labels, "id", "left")


def _titles(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 40).alias("title"), F.col("source").alias("flow"), "lang")


def _golden(s, d):
    items = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")), F.lit("src0")).alias("flows"))
    got = _keyword(s, d, 5).join(table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("flow")), "id").select("query_id", "flow")
    return flow_hits(got, items.withColumn("flows", F.array_distinct("flows")))


def _fixed_order():
    return [F.col("doc_id") * 7919 % 10007, F.col("doc_id")]


QUERIES = {
    "hit_mrr_ndcg": lambda s, d: hit_mrr_ndcg(_judged(s, d, 10), F.coalesce(F.col("quality") == 1, F.lit(False))),
    "graded_ndcg": lambda s, d: graded(_judged(s, d, 5).withColumn("rating", F.coalesce(2 * F.col("quality") + F.col("toxic"), F.lit(0))), "rating"),
    "precision_flow_hit": _golden,
    "stratified_sample": lambda s, d: stratified(table(s, d, "documents").select("doc_id", "source"), "source", _fixed_order(), 200),
    "synthetic_queries": lambda s, d: synthetic(_titles(s, d)),
    "uncovered_cards": lambda s, d: table(s, d, "documents").select("doc_id", "lang").join(table(s, d, "labels").select("doc_id"), "doc_id", "left_anti"),
}
_ONE = _BM.format(lists=_W.format(c="text", w=1))
_J = "j AS (SELECT kw.*, quality, toxic FROM kw LEFT JOIN labels ON kw.id = labels.doc_id)"
SQL = {
    "hit_mrr_ndcg": f"WITH {_ITEMS}, {_ONE}, {_KW.format(k=10)}, {_J}, e AS (SELECT query_id, min(place) FILTER (quality = 1) AS pos FROM j GROUP BY 1) SELECT count(*) AS cases, round(avg(CASE WHEN pos < 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_1, round(avg(CASE WHEN pos < 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_5, round(avg(CASE WHEN pos < 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_k, round(avg(coalesce(1 / (pos + 1), 0)), 6) AS mrr, round(avg(coalesce(1 / log2(pos + 2), 0)), 6) AS ndcg FROM e",
    "graded_ndcg": f"WITH {_ITEMS}, {_ONE}, {_KW.format(k=5)}, {_J}, r AS (SELECT query_id, place, coalesce(2 * quality + toxic, 0) AS g FROM j), i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY g DESC, place) - 1 AS ideal FROM r), a AS (SELECT query_id, max(g) FILTER (place = 0) AS f, max(g) AS m, sum((2::DOUBLE ** g - 1) / log2(place + 2)) AS dcg, sum((2::DOUBLE ** g - 1) / log2(ideal + 2)) AS idcg FROM i GROUP BY 1) SELECT query_id, f >= 2 AS p1, m >= 2 AS p5, f AS rel1, CASE WHEN idcg > 0 THEN round(dcg / idcg, 6) ELSE 0 END AS ndcg FROM a",
    "precision_flow_hit": f"WITH {_ITEMS}, {_ONE}, {_KW.format(k=5)}, g AS (SELECT query_id, source AS flow FROM kw JOIN documents ON id = doc_id), x AS (SELECT item_id AS query_id, unnest(list_distinct(['src' || (item_id % 20), 'src0'])) AS flow FROM benchmark), h AS (SELECT query_id, count(*) FILTER (EXISTS (SELECT 1 FROM g WHERE g.query_id = x.query_id AND g.flow = x.flow)) AS hits, coalesce(string_agg(flow, ',' ORDER BY flow) FILTER (NOT EXISTS (SELECT 1 FROM g WHERE g.query_id = x.query_id AND g.flow = x.flow)), '') AS missing FROM x GROUP BY 1), p AS (SELECT query_id, round(avg((EXISTS (SELECT 1 FROM x WHERE x.query_id = g.query_id AND x.flow = g.flow))::INT), 6) AS precision FROM g GROUP BY 1) SELECT query_id, hits::INT AS hits, missing, coalesce(precision, 0) AS precision FROM h LEFT JOIN p USING (query_id)",
    "stratified_sample": "WITH c AS (SELECT source, greatest(1, floor(count(*) * 200 / (SELECT count(*) FROM documents) + 0.5)) AS quota FROM documents GROUP BY 1), p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id * 7919 % 10007, doc_id) AS place FROM documents) SELECT doc_id, source FROM p JOIN c USING (source) WHERE place <= quota AND place <= 200",
    "synthetic_queries": "SELECT doc_id AS id, 'synthetic_easy' AS kind, substr(text, 1, 40) AS query FROM documents UNION ALL SELECT doc_id, 'synthetic_medium', 'how does ' || source || ' work in ' || lang FROM documents",
    "uncovered_cards": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
}
