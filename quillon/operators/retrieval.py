"""Retrieval: BM25, vector search, fusion of both into one score, re-ranking and caps.

A retrieval result is (query_id, id, distance) or (query_id, id, rank) so that many queries run in one plan. BM25 touches
postings of query terms only: a text's term counts and length come from its own row, so the text is never shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.stem import stem_sql, stems
from quillon.functions.text import STOP_WORDS, ascii_edges, fts_query
from quillon.operators.relational import cards_of
from quillon.plans.lineage import cut
from quillon.session import table

K1, B = 1.2, 0.75
# Boosts of card types
TYPE_BOOST = {"model": 1.0, "flow": 1.0, "cross_service": 0.95, "hub": 0.4, "dev_insight": 1.1, "raptor_cluster": 0.85}
BLOCK = 4096


# -- keyword search ------------------------------------------------------------------------------------------------------


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query_id, term), each term once: the sanitised query's words in lower case."""
    clean = F.split(F.lower(fts_query(F.col(text_col))), " or ")
    return queries.select(F.col(id_col).alias("query_id"), F.explode(F.array_distinct(clean)).alias("term")).filter("term <> ''")


def counted(docs: DataFrame, id_col: str, fields: dict[str, float], word: str = "[a-z0-9_]+", fold: bool = False) -> DataFrame:
    """(id, term, tf, len): the words of each text, each once with its weighted count, and the empty term that stands for the
    text itself; len is the number of words in all fields. With `fold` letters lose their marks first.

    Texts are split in Arrow batches: a word costs a tenth of what it costs as a row of its own, and no row carries a list.
    """
    kind, weights = dict(docs.dtypes)[id_col], list(fields.values())

    def plain(text: str) -> str:
        text = text.lower()
        if fold and not text.isascii():
            text = unicodedata.normalize("NFC", re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFD", text)))
        return text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(word).findall
        for b in batches:
            owner, terms, tf, lens = [], [], [], []
            for k in range(b.num_rows):
                texts = [b.column(j + 1)[k].as_py() for j in range(len(weights))]
                lists = [find(plain(t)) if t else [] for t in texts]
                sums = {"": 0.0}
                for found, w in zip(lists, weights, strict=True):
                    for term, n in Counter(found).items():
                        sums[term] = sums.get(term, 0.0) + w * n
                owner += [k] * len(sums)
                terms += sums.keys()
                tf += sums.values()
                lens += [sum(map(len, lists))] * len(sums)
                if len(terms) > 1 << 16 or k == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int32())), pa.array(terms, pa.string()), pa.array(tf, pa.float64()), pa.array(lens, pa.int64())], ["id", "term", "tf", "len"])
                    owner, terms, tf, lens = [], [], [], []

    return docs.select(F.col(id_col).alias("id"), *fields).mapInArrow(run, f"id {kind}, term string, tf double, len long")


def bm25(docs: DataFrame, terms: DataFrame, id_col: str, fields: dict[str, float]) -> DataFrame:
    """(query_id, id, rank): Okapi BM25 over weighted fields, negative, lower is better.

    idf = ln((N - n + 0.5) / (n + 0.5)), 1e-6 at least; a text's length is the number of its words in all fields.
    """
    asked = cut(_with_texts(terms.select("term")).distinct())  # its size is known when the join is planned: a small vocabulary is broadcast
    return weighed(counted(docs, id_col, fields).join(asked, "term", "left_semi"), terms)


def _with_texts(terms: DataFrame) -> DataFrame:
    """The terms and the empty one, under which every text stands once."""
    return terms.union(terms.sparkSession.range(1).select(F.lit("").alias("term")))


def weighed(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """The ranks of what texts hold of the asked terms, in one scan: N and the mean length come from the empty term's rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small postings would be written, and scored, by one task
    kept = cut(rows.repartition(parts, "id").groupBy("term", "id").agg(F.sum("tf").alias("tf"), F.first("len").alias("len"), F.count("*").alias("c"), F.sum("len").alias("lens")))
    total = kept.filter("term = ''").agg(F.sum("c").alias("n"), (F.sum("lens") / F.sum("c")).alias("mean"))
    n_docs, mean = total.select("n").scalar(), total.select("mean").scalar()
    postings = kept.filter("term <> ''").select("term", "id", "tf", "len")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weights = terms.join(df, "term").select("query_id", "term", idf.alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
    return postings.join(weights, "term").groupBy("query_id", "id").agg((-F.sum(part)).alias("rank"))


# The fields of a card and their weights
CARD_FIELDS = {"title": 3.0, "content": 1.0, "flow": 2.0, "source_repos": 2.0, "tags": 1.5, "identifiers": 2.0}


def bm25_stemmed(cards: DataFrame, terms: DataFrame, id_col: str = "id", fields: dict[str, float] | None = None) -> DataFrame:
    """(query_id, id, rank) as bm25 over the stems of words and terms: letters without marks, runs of letters and digits.

    The postings of all words are written once. Their distinct words get their stems (a word is stemmed once however often it
    stands), and only words with an asked stem are joined back.
    """
    postings = cut(counted(cards, id_col, fields or CARD_FIELDS, r"[^\W_]+", fold=True))
    split = terms.select("query_id", F.explode(F.split("term", "_")).alias("word")).filter("word <> ''")
    asked = stems(split.select("word").distinct())
    wanted = split.join(asked, "word").select("query_id", F.col("stem").alias("term")).distinct()
    known = stems(postings.select(F.col("term").alias("word")).distinct())
    held = known.join(wanted.select(F.col("term").alias("stem")).distinct(), "stem", "left_semi")
    held = cut(held.select("word", "stem").union(terms.sparkSession.range(1).select(F.lit("").alias("word"), F.lit("").alias("stem"))))
    rows = postings.join(held.withColumnRenamed("word", "term"), "term").select(F.col("stem").alias("term"), "id", "tf", "len")
    return weighed(rows, wanted)


def top(rows: DataFrame, k: int, order: list, group: str = "query_id") -> DataFrame:
    """The first k rows of each group, with `place` from 0. Tasks keep k rows of a group at most before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w).cast("long") - 1).filter(F.col("place") < k)


def like_fallback(docs: DataFrame, terms: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(query_id, id) where each of the query's terms is part of one of the fields at least; terms of a query are one row."""
    lists = terms.groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    every = lists.agg(F.collect_list(F.struct("query_id", "terms"))).scalar()  # one value: the queries, thirty terms each
    text = F.lower(F.concat_ws("\n", *fields))
    hits = F.filter("every", lambda q: F.forall(q["terms"], lambda t: text.contains(t)))
    return docs.withColumn("every", every).select(F.col(id_col).alias("id"), F.explode(F.transform(hits, lambda q: q["query_id"])).alias("query_id")).select("query_id", "id")


def domain_terms(docs: DataFrame, group: str, text: str, most: int = 12) -> DataFrame:
    """The terms of each group by tf-idf: words of four letters count once, compounds twice; tf from 2; idf ln((N + 1) / df)."""
    body, low = F.col(text), F.lower(F.col(text))
    found = lambda t, pattern, w: F.transform(F.regexp_extract_all(t, F.lit(ascii_edges(pattern)), F.lit(0)), lambda x: F.struct(F.lower(x).alias("term"), F.lit(w).alias("w")))
    lists = F.concat(
        found(low, r"\b[a-z]{4,}\b", 1), found(low, r"\b[a-z][a-z0-9]*(?:-[a-z][a-z0-9]+)+\b", 2),
        found(low, r"\b[a-z][a-z0-9]*(?:_[a-z][a-z0-9]+)+\b", 2), found(body, r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b", 2),
    )
    tf = docs.select(F.col(group).alias("grp"), F.explode(lists).alias("t")).groupBy("grp", "t.term").agg(F.sum("t.w").alias("tf"))
    tf = tf.filter(~F.col("term").isin(STOP_WORDS))
    groups = docs.select(F.countDistinct(group)).scalar()
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    scored = tf.filter("tf >= 2").join(df, "term").withColumn("score", F.round(F.col("tf") * F.log((groups + 1) / F.col("df")), 6))
    return top(scored, most, [F.desc("score"), "term"], "grp").select(F.col("grp").alias(group), "term", "tf", "df", "score")


# -- vectors -------------------------------------------------------------------------------------------------------------


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for a zero vector or unlike lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def knn(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(query_id, id, distance): the k nearest of `vectors` (id, embedding) to each of `queries`, exactly.

    Queries and vectors are cut into blocks of BLOCK rows by a hash; each pair of blocks is one matrix product that leaves k
    rows a query, and a window takes the k best of all blocks. Memory is two blocks a task.
    """
    blocks = lambda df: max(1, -(-df.count() // BLOCK))
    nq, nv = blocks(queries), blocks(vectors)
    q = queries.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(nq))).withColumn("vb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nv - 1).cast("long"))))
    v = vectors.withColumn("vb", F.pmod(F.xxhash64("id"), F.lit(nv))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))))
    kind = dict(vectors.dtypes)["id"]

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": left["id"][:0], "id": right["id"][:0], "distance": np.zeros(0)})
        a, b = (np.stack(x["embedding"].to_numpy()).astype(np.float64) for x in (left, right))
        if metric == "cosine":
            norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
            d = 1 - np.divide(a @ b.T, norms, out=np.zeros_like(norms), where=norms > 0)
        else:
            d = np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0))
        d = np.round(d, 6) + 0.0  # no negative zero
        m = min(k, d.shape[1])
        order = np.lexsort((np.broadcast_to(right["id"].to_numpy(), d.shape), d), axis=1)[:, :m]
        rows = np.arange(len(d))[:, None]
        return pd.DataFrame({"query_id": np.repeat(left["id"].to_numpy(), m), "id": right["id"].to_numpy()[order].ravel(), "distance": d[rows, order].ravel()})

    both = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(near, f"query_id {kind}, id {kind}, distance double")
    return top(both, k, ["distance", "id"]).drop("place")


def least_of(lists: list[DataFrame]) -> DataFrame:
    """Vector lists of content and title: the least distance of each card."""
    both = lists[0]
    for more in lists[1:]:
        both = both.unionByName(more)
    return both.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))


def centroids(vectors: DataFrame, group: str | None = "label", unit: bool = True) -> DataFrame:
    """Mean vector of each group (of all rows without a group), scaled to length 1; (group, centroid)."""
    keys = [group] if group else []
    flat = vectors.select(*keys, F.posexplode("embedding").alias("pos", "x"))
    means = flat.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    got = means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("centroid"))
    norm = F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda s, v: s + v * v))
    return got.withColumn("centroid", F.when(norm > 0, F.transform("centroid", lambda v: v / norm)).otherwise(F.col("centroid"))) if unit else got


def classify(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, top_repo, similarity, confidence): the nearest centroid and its lead over the next (1 if there is one only)."""
    every = centroids(vectors).agg(F.collect_list(F.struct("label", "centroid"))).scalar()  # a vector for each repository
    sims = F.array_sort(F.transform("every", lambda c: F.struct((-F.round(cosine(F.col("embedding"), c["centroid"]), 6)).alias("s"), c["label"].alias("label"))))
    got = queries.withColumn("every", every).select("id", sims.alias("sims"))
    lead = F.when(F.size("sims") < 2, 1.0).otherwise(F.round(F.try_element_at("sims", F.lit(2))["s"] - F.col("sims")[0]["s"], 6))
    return got.select("id", F.col("sims")[0]["label"].alias("top_repo"), (-F.col("sims")[0]["s"]).alias("similarity"), lead.alias("confidence"))


def repo_similarities(queries: DataFrame, vectors: DataFrame, least: float = 0.03) -> DataFrame:
    """(query_id, repo, sim) of queries (id, embedding) to the centroid of every repository of vectors (embedding, repo), for
    queries whose nearest centroid leads the next by more than `least` (or is the only one)."""
    means = cut(centroids(vectors.filter("repo IS NOT NULL"), "repo").select(F.col("repo").alias("id"), F.col("centroid").alias("embedding")))
    near = knn(queries.select(F.col("id").cast("string").alias("id"), "embedding"), means, max(1, means.count()))
    w = Window.partitionBy("query_id")
    sims = near.select("query_id", F.col("id").alias("repo"), F.round(1 - F.col("distance"), 6).alias("sim"))
    lead = F.sort_array(F.collect_list("sim").over(w), asc=False)  # a value a repository
    sure = (F.size(lead) < 2) | (F.round(lead[0] - F.try_element_at(lead, F.lit(2)), 6) > least)
    back = dict(queries.dtypes)["id"]
    return sims.withColumn("sure", sure).filter("sure").select(F.col("query_id").cast(back).alias("query_id"), "repo", "sim")


def cached_answers(queries: DataFrame, log: DataFrame, cards: DataFrame, recent: int = 50, least: float = 0.92) -> DataFrame:
    """(query_id, hit_id, card, place, score): the cards that the newest alike one of the recent logged queries was answered with.

    log: id, embedding, cards (array of ids). Cards that are gone fall away; the rest keep the stored order, each at score 1.
    """
    hits = semantic_cache(queries, log.select("id", "embedding"), recent, least).filter("hit_id IS NOT NULL")
    stored = log.select(F.col("id").alias("hit_id"), F.posexplode("cards").alias("place", "card"))
    return hits.select(F.col("id").alias("query_id"), "hit_id").join(stored, "hit_id").join(cards.select(F.col("id").alias("card")), "card", "left_semi").select("query_id", "hit_id", "card", "place", F.lit(1.0).alias("score"))


def specificity(vectors: DataFrame) -> DataFrame:
    """(id, specificity): 0.4 of the distance to the global centroid and 0.6 of that to the own repository's, each min-max scaled."""
    whole = centroids(vectors, None, unit=False).select("centroid").scalar()
    own = centroids(vectors)
    rows = vectors.join(own, "label", "left").withColumn("whole", whole).select(
        "id", (1 - cosine(F.col("embedding"), F.col("whole"))).alias("g"), F.coalesce(1 - cosine(F.col("embedding"), F.col("centroid")), F.lit(0.5)).alias("r")
    )
    ends = rows.agg(F.struct(F.min("g").alias("g0"), F.max("g").alias("g1"), F.min("r").alias("r0"), F.max("r").alias("r1"))).scalar()
    scale = lambda c: F.when(ends[c + "1"] == ends[c + "0"], 0.5).otherwise((F.col(c) - ends[c + "0"]) / (ends[c + "1"] - ends[c + "0"]))
    return rows.select("id", F.round(0.4 * scale("g") + 0.6 * scale("r"), 5).alias("specificity"))


def semantic_cache(queries: DataFrame, log: DataFrame, recent: int = 50, least: float = 0.92) -> DataFrame:
    """(id, hit_id, similarity): of the most recent logged vectors those more similar than `least`, the newest of them."""
    newest = log.orderBy(F.desc("id")).limit(recent).agg(F.collect_list(F.struct("id", "embedding"))).scalar()  # `recent` vectors
    sims = F.transform("newest", lambda c: F.struct(c["id"].alias("id"), F.round(cosine(F.col("embedding"), c["embedding"]), 6).alias("s")))
    hit = F.array_max(F.filter(sims, lambda c: c["s"] > least))
    return queries.withColumn("newest", newest).select("id", hit["id"].alias("hit_id"), hit["s"].alias("similarity"))


def mmr(candidates: DataFrame, k: int = 5, weight: float = 0.7) -> DataFrame:
    """(query_id, id, place): k of each query's candidates (id, score, embedding), greedily by relevance less redundancy.

    A query's candidates are a bounded list (a top-k result); each group is that list.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True], ignore_index=True)
        x = np.stack([np.asarray(e, np.float64) for e in rows["embedding"]])
        norms = np.linalg.norm(x, axis=1)
        sims = np.divide(x @ x.T, np.outer(norms, norms), out=np.zeros((len(x), len(x))), where=np.outer(norms, norms) > 0)
        gain = rows["score"].to_numpy() / max(rows["score"].max(), 1e-9)
        if len(rows) <= k:
            taken = list(range(len(rows)))
        else:
            taken, near = [], np.zeros(len(rows))
            while len(taken) < k:
                worth = np.round(weight * gain - (1 - weight) * near, 9)
                worth[taken] = -np.inf
                taken.append(int(worth.argmax()))
                near = np.maximum(near, sims[:, taken[-1]])
        return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "id": rows["id"].iloc[taken].to_numpy(), "place": range(len(taken))})

    kinds = dict(candidates.dtypes)
    return candidates.groupBy("query_id").applyInPandas(pick, f"query_id {kinds['query_id']}, id {kinds['id']}, place long")


def kmeans(vectors: DataFrame, k: int = 8, rounds: int = 20, seed: int = 7) -> DataFrame:
    """(id, cluster): MLlib k-means under cosine distance."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = vectors.select("id", array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("features"))
    model = KMeans(k=k, maxIter=rounds, seed=seed, distanceMeasure="cosine").fit(data)
    return model.transform(data).select("id", F.col("prediction").alias("cluster"))


# -- fusion --------------------------------------------------------------------------------------------------------------


def fuse(semantic: DataFrame, keyword: DataFrame) -> DataFrame:
    """Full outer merge of both lists with 0-based ranks, normalised scores, source and the weighted reciprocal-rank score."""
    w = Window.partitionBy("query_id")
    sem = semantic.withColumn("sem_rank", F.row_number().over(w.orderBy("distance", "id")).cast("long") - 1).withColumn("sem_score", F.greatest(1 - F.col("distance"), F.lit(0.0)))
    span = F.max("rank").over(w) - F.min("rank").over(w)
    kw = keyword.withColumn("kw_score", F.when(span == 0, 0.5).otherwise((F.max("rank").over(w) - F.col("rank")) / span)).withColumn("kw_rank", F.row_number().over(w.orderBy("rank", "id")).cast("long") - 1)
    both = sem.select("query_id", "id", "sem_rank", "sem_score").join(kw.select("query_id", "id", "kw_rank", "kw_score"), ["query_id", "id"], "full_outer")
    source = F.when(F.col("sem_rank").isNull(), "keyword").when(F.col("kw_rank").isNull(), "semantic").otherwise("both")
    best = F.greatest(F.coalesce("sem_score", F.lit(0.0)), F.coalesce("kw_score", F.lit(0.0)))
    return both.withColumns({"source": source, "rrf": rrf("sem_rank", "kw_rank")}).withColumn("weighted", 0.75 * F.col("rrf") + 0.25 * best)


def rrf(*ranks: str, k: int = 60) -> Column:
    """Sum of 1 / (k + rank) over the lists that hold the row."""
    return sum((F.coalesce(1 / (F.lit(float(k)) + F.col(r)), F.lit(0.0)) for r in ranks), F.lit(0.0))


def fused_score(fused: DataFrame, cards: DataFrame, text_hits: DataFrame | None = None, repo_sims: DataFrame | None = None) -> DataFrame:
    """Weighted rank score times boosts of type, usage, specificity and repository.

    cards: id, card_type, usage_count, specificity, repo. text_hits: query_id, repo, hits (of queries with two hits or more).
    repo_sims: query_id, repo, sim (of queries that were classified with confidence).
    """
    rows = fused.join(cards, "id")
    boost = F.lit(1.0)
    for name, value in TYPE_BOOST.items():
        boost = F.when(F.col("card_type") == name, value).otherwise(boost)
    score = F.col("weighted") * boost * (1 + 0.05 * F.log2(1.0 + F.col("usage_count"))) * F.coalesce(0.6 + 0.4 * F.col("specificity"), F.lit(1.0))
    emb, text = F.lit(1.0), None
    w = Window.partitionBy("query_id")
    if repo_sims is not None:
        sims = repo_sims.withColumns({"low": F.min("sim").over(w), "high": F.max("sim").over(w)})
        part = F.when(F.col("high") > F.col("low"), (F.col("sim") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.5)
        rows = rows.join(sims.select("query_id", "repo", (0.85 + 0.30 * part).alias("emb")), ["query_id", "repo"], "left")
        emb = F.coalesce("emb", F.lit(1.0))
    if text_hits is not None:
        most = text_hits.groupBy("query_id").agg(F.max("hits").alias("most"))
        rows = rows.join(text_hits, ["query_id", "repo"], "left").join(most, "query_id", "left")
        text = 0.6 + 0.4 * F.coalesce("hits", F.lit(0)) / F.col("most")
        emb = F.when(F.col("most").isNull(), emb).otherwise(0.6 * text + 0.4 * emb)
    return rows.withColumn("score", F.round(score * emb, 6))


def type_caps(scored: DataFrame, limit: int = 5, hubs: int = 2, clusters: int = 1) -> DataFrame:
    """The best of each query: first the candidates (three times the limit, 15 at least), then caps by type, then the limit."""
    kept = top(scored, max(3 * limit, 15), [F.desc("score"), "id"]).drop("place")
    kind = F.when(F.col("card_type") == "hub", "hub").when(F.col("card_type") == "raptor_cluster", "cluster").otherwise("rest")
    w = Window.partitionBy("query_id", kind).orderBy(F.desc("score"), "id")
    turn = F.row_number().over(w)
    kept = kept.withColumn("turn", turn).filter(~((kind == "hub") & (F.col("turn") > hubs)) & ~((kind == "cluster") & (F.col("turn") > clusters))).drop("turn")
    return top(kept, limit, [F.desc("score"), "id"])


def text_affinity(queries: DataFrame, signals: DataFrame, id_col: str, text_col: str, least: int = 2) -> DataFrame:
    """(query_id, repo, hits): signals of a repository that are part of the query, for two hits or more.

    The lists of all repositories are one value of bounded size (a few dozen signals each).
    """
    every = signals.groupBy("repo").agg(F.collect_set("signal").alias("signals")).agg(F.collect_list(F.struct("repo", "signals"))).scalar()
    low = F.lower(F.col(text_col))
    counted = F.transform("every", lambda r: F.struct(r["repo"].alias("repo"), F.size(F.filter(r["signals"], lambda s: low.contains(s))).alias("hits")))
    return queries.withColumn("every", every).select(F.col(id_col).alias("query_id"), F.explode(F.filter(counted, lambda c: c["hits"] >= least)).alias("c")).select("query_id", "c.repo", F.col("c.hits").cast("long").alias("hits"))


def multi_query(main: DataFrame, parts: DataFrame, most: int = 8, weight: float = 0.8) -> DataFrame:
    """Main results and those of entity queries at a lower weight, each card once at its best score."""
    both = main.select("query_id", "id", "score").unionByName(parts.select("query_id", "id", (F.col("score") * weight).alias("score")))
    return top(both.groupBy("query_id", "id").agg(F.round(F.max("score"), 6).alias("score")), most, [F.desc("score"), "id"])


# -- registered queries --------------------------------------------------------------------------------------------------


def card_facts(docs: DataFrame) -> DataFrame:
    kind = F.when(F.col("lang") == "en", "flow").when(F.col("lang") == "fr", "hub").when(F.col("lang") == "de", "cross_service").otherwise("raptor_cluster")
    return docs.select(F.col("doc_id").alias("id"), kind.alias("card_type"), (F.col("n_chars") % 50).alias("usage_count"), ((F.col("n_chars") % 100) / 100).alias("specificity"), F.col("source").alias("repo"))


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _asked(s, d):
    """The stated query set: every vector whose id is divisible by 20."""
    return _vectors(s, d).filter("id % 20 = 0")


def _terms(s, d):
    return query_terms(table(s, d, "benchmark"), "item_id", "text")


def _keyword(s, d, k):
    ranked = bm25(table(s, d, "documents"), _terms(s, d), "doc_id", {"text": 1.0})
    return top(ranked.withColumn("rank", F.round("rank", 6)), k, ["rank", "id"])


def _semantic(s, d, k):
    """Vector lists of the benchmark's items: an item asks with the vector of its own number."""
    asked = table(s, d, "benchmark").select(F.col("item_id").alias("id")).join(_vectors(s, d).drop("label"), "id")
    return knn(asked, _vectors(s, d).drop("label"), k)


def hybrid(s: SparkSession, d: str, limit: int = 5) -> DataFrame:
    """Each benchmark item's text and vector against documents and embeddings, fused, boosted and capped."""
    fused = fuse(_semantic(s, d, 4 * limit), _keyword(s, d, 4 * limit).drop("place"))
    return type_caps(fused_score(fused, card_facts(table(s, d, "documents"))), limit).select("query_id", "id", "source", "card_type", "score", "place")


def search_fields(docs: DataFrame) -> DataFrame:
    """Documents as cards of six fields: the first line as title, the text, source and language, and the names that it holds."""
    names = F.regexp_extract_all("text", F.lit("[A-Za-z][a-z0-9]*(?:_[a-z0-9]+)+"), F.lit(0))
    return docs.select(
        F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"), F.col("source").alias("flow"),
        F.concat_ws(" ", "source", "lang").alias("source_repos"), F.col("lang").alias("tags"), F.array_join(names, " ").alias("identifiers"),
    )


def _fused(s, d):
    return fuse(_semantic(s, d, 20), _keyword(s, d, 20).drop("place"))


def _signals(s, d):
    return domain_terms(table(s, d, "documents"), "source", "text", 40).select(F.col("source").alias("repo"), F.col("term").alias("signal"))


def _repo_sims(s, d):
    """Repositories are the sources of the documents that have a vector's number; a query asks with its own number's vector."""
    vectors = _vectors(s, d).select("id", "embedding").join(table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("repo")), "id")
    asked = table(s, d, "benchmark").select(F.col("item_id").alias("id")).join(_vectors(s, d).select("id", "embedding"), "id")
    return repo_similarities(asked, vectors)


def _affine(s, d, limit: int = 5):
    """hybrid with the repositories that a query's words and its vector point to."""
    scored = fused_score(_fused(s, d), card_facts(table(s, d, "documents")), text_affinity(table(s, d, "benchmark"), _signals(s, d), "item_id", "text"), _repo_sims(s, d))
    return type_caps(scored, limit).select("query_id", "id", "source", "card_type", "score", "place")


def _answers(s, d):
    """Every vector asks the log of all; the log's rows were answered with documents about their own number, some of them gone."""
    k = F.col("id")
    log = _vectors(s, d).select("id", "embedding", F.array(k * 7 % 300, k + 3, k % 40, k + 1_000_000).alias("cards"))
    return cached_answers(_vectors(s, d).select("id", "embedding"), log, table(s, d, "documents").select(F.col("doc_id").alias("id")).distinct())


QUERIES = {
    "hybrid_search": hybrid,
    "hybrid_affinity": _affine,
    "repo_similarities": _repo_sims,
    "cache_answer": lambda s, d: _answers(s, d).withColumn("place", F.col("place").cast("long")),
    "sanitize_query": lambda s, d: table(s, d, "documents").select("doc_id", fts_query(F.col("text")).alias("fts")),
    "bm25_topk": lambda s, d: _keyword(s, d, 5),
    "bm25_fields": lambda s, d: top(bm25(table(s, d, "documents"), _terms(s, d), "doc_id", {"text": 1.0, "lang": 2.0, "source": 3.0}).withColumn("rank", F.round("rank", 6)), 3, ["rank", "id"]),
    "bm25_stemmed": lambda s, d: top(bm25_stemmed(search_fields(table(s, d, "documents")), _terms(s, d)).withColumn("rank", F.round("rank", 6)), 5, ["rank", "id"]),
    "like_fallback": lambda s, d: like_fallback(cards_of(table(s, d, "documents")), query_terms(table(s, d, "nation").withColumn("q", F.concat(F.lit("th re "), F.lower(F.left("n_name", F.lit(2))))), "n_nationkey", "q"), "id", ["title", "flow"]),
    "domain_terms": lambda s, d: domain_terms(table(s, d, "documents"), "source", "text"),
    "text_affinity": lambda s, d: text_affinity(table(s, d, "benchmark"), _signals(s, d), "item_id", "text"),
    "knn_cosine": lambda s, d: knn(_asked(s, d).drop("label"), _vectors(s, d).drop("label"), 10),
    "knn_l2": lambda s, d: knn(_asked(s, d).drop("label"), _vectors(s, d).drop("label"), 10, "l2"),
    "dual_vector_min": lambda s, d: top(least_of([knn(_asked(s, d).drop("label"), _vectors(s, d).filter(f"label % 2 = {k}").drop("label"), 8) for k in (0, 1)]), 8, ["distance", "id"]),
    "repo_centroids": lambda s, d: centroids(_vectors(s, d)).select("label", F.posexplode("centroid").alias("pos", "x")).select("label", "pos", F.round("x", 5).alias("x")),
    "classify_query": lambda s, d: classify(_asked(s, d), _vectors(s, d)),
    "specificity": lambda s, d: specificity(_vectors(s, d)),
    "semantic_cache": lambda s, d: semantic_cache(_vectors(s, d), _vectors(s, d)),
    "mmr": lambda s, d: mmr(knn(_asked(s, d).drop("label"), _vectors(s, d).drop("label"), 20).withColumn("score", 2 - F.col("distance")).join(_vectors(s, d).select("id", "embedding"), "id")),
    "kmeans_clusters": lambda s, d: kmeans(_vectors(s, d)),
    "rrf": lambda s, d: _fused(s, d).select("query_id", "id", "source", F.round("rrf", 6).alias("rrf")),
    "weighted_rrf": lambda s, d: _fused(s, d).select("query_id", "id", F.round("weighted", 5).alias("weighted")),
    "fused_score": lambda s, d: fused_score(_fused(s, d), card_facts(table(s, d, "documents")), text_affinity(table(s, d, "benchmark"), _signals(s, d), "item_id", "text")).select("query_id", "id", "score"),
    "type_caps": lambda s, d: type_caps(card_facts(table(s, d, "documents")).withColumn("score", F.round(F.col("usage_count") + F.col("specificity"), 6)).withColumn("query_id", F.col("repo"))).select("query_id", "id", "card_type", "score", "place"),
    "context_multi_query": lambda s, d: multi_query(_keyword(s, d, 10).withColumn("score", -F.col("rank")), _semantic(s, d, 4).withColumn("score", 1 - F.col("distance"))).select("query_id", "id", "score", "place"),
}

_TERMS = r"""terms AS (SELECT DISTINCT query_id, unnest(list_slice(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace({text}, '([a-z])([A-Z])', '\1 \2', 'g'), 'https?://[^ \t\n\r\f\v]+', '', 'g'), '[^a-zA-Z0-9_ \t\n\r\f\v]', ' ', 'g'), '[ \t\n\r\f\v]+'), lambda w: length(w) > 1 AND upper(w) NOT IN ('AND', 'OR', 'NOT', 'NEAR')), 1, 30)) AS t FROM (SELECT {id} AS query_id, {text} FROM {tab})), qt AS (SELECT DISTINCT query_id, lower(t) AS term FROM terms)"""
_BM = r"""toks AS (SELECT id, unnest(ts) AS p, len(ts) AS len FROM (SELECT doc_id AS id, {lists} AS ts FROM documents)),
tot AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM (SELECT {lists} AS ts FROM documents)),
post AS (SELECT p.t AS term, id, sum(p.w) AS tf, any_value(len) AS len FROM toks WHERE p.t IN (SELECT term FROM qt) GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
ranked AS (SELECT query_id, id, round(-sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS rank FROM post JOIN dfs USING (term) JOIN qt USING (term), tot GROUP BY 1, 2)"""
_W = r"list_transform(list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda x: x <> ''), lambda x: {{'t': x, 'w': {w}::DOUBLE}})"
_ONE = _BM.format(lists=_W.format(c="text", w=1))
_ITEMS = _TERMS.format(id="item_id", text="text", tab="benchmark")
_KW = "kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, id) - 1 AS place FROM ranked QUALIFY place < {k})"
_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings)"
_NEAR = "near AS (SELECT q.id AS query_id, v.id AS id, round({d}, 6) AS distance FROM v AS q JOIN v ON true WHERE {where} QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY round({d}, 6), v.id) <= {k})"
_COS, _L2 = "1 - list_cosine_similarity(q.e, v.e)", "list_distance(q.e, v.e)"
_SEM = "near AS (SELECT q.id AS query_id, v.id AS id, round(1 - list_cosine_similarity(q.e, v.e), 6) AS distance FROM v AS q JOIN v ON true WHERE q.id IN (SELECT item_id FROM benchmark) QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY round(1 - list_cosine_similarity(q.e, v.e), 6), v.id) <= {k})"
_FUSE = """s1 AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) - 1 AS sr, greatest(1 - distance, 0) AS ss FROM near),
k1 AS (SELECT query_id, id, row_number() OVER w - 1 AS kr, CASE WHEN max(rank) OVER p = min(rank) OVER p THEN 0.5 ELSE (max(rank) OVER p - rank) / (max(rank) OVER p - min(rank) OVER p) END AS ks FROM kw WINDOW p AS (PARTITION BY query_id), w AS (PARTITION BY query_id ORDER BY rank, id)),
fu AS (SELECT query_id, id, CASE WHEN sr IS NULL THEN 'keyword' WHEN kr IS NULL THEN 'semantic' ELSE 'both' END AS source,
 coalesce(1 / (60.0::DOUBLE + sr), 0) + coalesce(1 / (60.0::DOUBLE + kr), 0) AS rrf, greatest(coalesce(ss, 0), coalesce(ks, 0)) AS best FROM s1 FULL JOIN k1 USING (query_id, id)),
fw AS (SELECT *, 0.75::DOUBLE * rrf + 0.25::DOUBLE * best AS weighted FROM fu)"""
_FACTS = "facts AS (SELECT doc_id AS id, CASE lang WHEN 'en' THEN 'flow' WHEN 'fr' THEN 'hub' WHEN 'de' THEN 'cross_service' ELSE 'raptor_cluster' END AS card_type, n_chars % 50 AS usage_count, (n_chars % 100) / 100 AS specificity, source AS repo FROM documents)"
_SCORE = "weighted * CASE card_type WHEN 'cross_service' THEN 0.95::DOUBLE WHEN 'hub' THEN 0.4::DOUBLE WHEN 'raptor_cluster' THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END * (1 + 0.05::DOUBLE * log2(1 + usage_count)) * (0.6::DOUBLE + 0.4::DOUBLE * specificity)"
_CAPS = """top1 AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 15),
cap AS (SELECT * FROM top1 QUALIFY row_number() OVER (PARTITION BY query_id, CASE WHEN card_type IN ('hub', 'raptor_cluster') THEN card_type ELSE 'rest' END ORDER BY score DESC, id) <= CASE card_type WHEN 'hub' THEN 2 WHEN 'raptor_cluster' THEN 1 ELSE 99 END),
out AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS place FROM cap QUALIFY place < 5)"""
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_DOM = rf"""tt AS (SELECT source AS grp, unnest(list_concat(list_concat(list_transform(regexp_extract_all(lower(text), '\b[a-z]{{4,}}\b'), lambda x: {{'t': x, 'w': 1}}), list_transform(regexp_extract_all(lower(text), '\b[a-z][a-z0-9]*(?:-[a-z][a-z0-9]+)+\b'), lambda x: {{'t': x, 'w': 2}})), list_concat(list_transform(regexp_extract_all(lower(text), '\b[a-z][a-z0-9]*(?:_[a-z][a-z0-9]+)+\b'), lambda x: {{'t': x, 'w': 2}}), list_transform(regexp_extract_all(text, '\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b'), lambda x: {{'t': lower(x), 'w': 2}})))) AS p FROM documents),
tf AS (SELECT grp, p.t AS term, sum(p.w)::BIGINT AS tf FROM tt WHERE p.t NOT IN ({_STOP}) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT grp, term, tf, df, round(tf * ln(((SELECT count(DISTINCT source) FROM documents) + 1) / df), 6) AS score FROM tf JOIN df USING (term) WHERE tf >= 2),
dom AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY grp ORDER BY score DESC, term) <= @K)"""
_AFF = "hits AS (SELECT item_id AS query_id, grp AS repo, count(*) AS hits FROM benchmark JOIN dom ON contains(lower(text), term) GROUP BY 1, 2 HAVING count(*) >= 2)"
_CEN = "cen AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS pos FROM v) GROUP BY 1, 2), cn AS (SELECT label, list(x / n ORDER BY pos) AS c FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY label)) AS n FROM cen) GROUP BY 1)"
_WORDS = r"list_transform(list_filter(regexp_split_to_array(lower(strip_accents(coalesce({c}, ''))), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''), lambda x: {{'t': x, 'w': {w}::DOUBLE}})"
_SIX = [("split_part(text, chr(10), 1)", 3), ("text", 1), ("source", 2), ("concat_ws(' ', source, lang)", 2), ("lang", 1.5), ("array_to_string(regexp_extract_all(text, '[A-Za-z][a-z0-9]*(?:_[a-z0-9]+)+'), ' ')", 2)]
_STEMMED = f"""{_ITEMS}, tk AS MATERIALIZED (SELECT id, len(ts) AS len, unnest(ts) AS p FROM (SELECT doc_id AS id, flatten([{", ".join(_WORDS.format(c=c, w=w) for c, w in _SIX)}]) AS ts FROM documents)),
qw AS MATERIALIZED (SELECT query_id, word FROM (SELECT query_id, unnest(string_split(term, '_')) AS word FROM qt) WHERE word <> ''), aw AS (SELECT DISTINCT p.t AS word FROM tk UNION SELECT word FROM qw),
{stem_sql('aw', 'st')}, qs AS (SELECT DISTINCT query_id, stem AS term FROM qw JOIN st USING (word)),
tot AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM tk) / (SELECT count(*) FROM documents) AS mean),
post AS (SELECT stem AS term, id, sum(p.w) AS tf, any_value(len) AS len FROM tk JOIN st ON p.t = word WHERE stem IN (SELECT term FROM qs) GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
ranked AS (SELECT query_id, id, round(-sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS rank FROM post JOIN dfs USING (term) JOIN qs USING (term), tot GROUP BY 1, 2)"""
_MEANS = """rv AS (SELECT v.id, e, source AS repo FROM v JOIN documents ON doc_id = v.id WHERE source IS NOT NULL), rm AS (SELECT repo, pos, avg(x) AS x FROM (SELECT repo, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM rv) GROUP BY 1, 2), rc AS (SELECT repo, list(x ORDER BY pos) AS c FROM rm GROUP BY 1),
rs AS (SELECT v.id AS query_id, repo, round(1 - round(1 - list_cosine_similarity(e, c), 6), 6) AS sim FROM v JOIN rc ON true WHERE v.id IN (SELECT item_id FROM benchmark)),
sure AS (SELECT query_id, repo, sim FROM (SELECT *, list_sort(list(sim) OVER (PARTITION BY query_id), 'DESC') AS l FROM rs) WHERE len(l) < 2 OR round(l[1] - l[2], 6) > 0.03)"""
_BOTH = f"{_DOM.replace('@K', '40')}, {_AFF}, mo AS (SELECT query_id, max(hits) AS most FROM hits GROUP BY 1), {_MEANS}, em AS (SELECT query_id, repo, 0.85::DOUBLE + 0.3::DOUBLE * CASE WHEN max(sim) OVER w > min(sim) OVER w THEN (sim - min(sim) OVER w) / (max(sim) OVER w - min(sim) OVER w) ELSE 0.5::DOUBLE END AS emb FROM sure WINDOW w AS (PARTITION BY query_id))"
_AFFINE = f"scored AS (SELECT fw.*, card_type, round({_SCORE} * CASE WHEN most IS NULL THEN coalesce(emb, 1) ELSE 0.6::DOUBLE * (0.6::DOUBLE + 0.4::DOUBLE * coalesce(hits, 0) / most) + 0.4::DOUBLE * coalesce(emb, 1) END, 6) AS score FROM fw JOIN facts USING (id) LEFT JOIN hits USING (query_id, repo) LEFT JOIN mo USING (query_id) LEFT JOIN em USING (query_id, repo))"
SQL = {
    "hybrid_affinity": f"WITH {_ITEMS}, {_ONE}, {_KW.format(k=20)}, {_V}, {_SEM.format(k=20)}, {_FUSE}, {_FACTS}, {_BOTH}, {_AFFINE}, {_CAPS} SELECT query_id, id, source, card_type, score, place FROM out",
    "repo_similarities": f"WITH {_V}, {_MEANS} SELECT * FROM sure",
    "cache_answer": f"WITH {_V}, n AS (SELECT * FROM v ORDER BY id DESC LIMIT 50), h AS (SELECT v.id AS query_id, n.id AS hit_id FROM v JOIN n ON round(list_cosine_similarity(v.e, n.e), 6) > 0.92 QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY n.id DESC) = 1), a AS (SELECT query_id, hit_id, unnest([hit_id * 7 % 300, hit_id + 3, hit_id % 40, hit_id + 1000000]) AS card, unnest([0, 1, 2, 3]) AS place FROM h) SELECT query_id, hit_id, card, place, 1.0::DOUBLE AS score FROM a WHERE card IN (SELECT doc_id FROM documents)",
    "bm25_stemmed": f"WITH {_STEMMED}, {_KW.format(k=5)} SELECT * FROM kw",
    "hybrid_search": f"WITH {_ITEMS}, {_ONE}, {_KW.format(k=20)}, {_V}, {_SEM.format(k=20)}, {_FUSE}, {_FACTS}, scored AS (SELECT fw.*, card_type, round({_SCORE}, 6) AS score FROM fw JOIN facts USING (id)), {_CAPS} SELECT query_id, id, source, card_type, score, place FROM out",
    "sanitize_query": r"SELECT doc_id, array_to_string(list_slice(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g'), 'https?://[^ \t\n\r\f\v]+', '', 'g'), '[^a-zA-Z0-9_ \t\n\r\f\v]', ' ', 'g'), '[ \t\n\r\f\v]+'), lambda w: length(w) > 1 AND upper(w) NOT IN ('AND', 'OR', 'NOT', 'NEAR')), 1, 30), ' OR ') AS fts FROM documents",
    "bm25_topk": f"WITH {_ITEMS}, {_ONE}, {_KW.format(k=5)} SELECT * FROM kw",
    "bm25_fields": f"WITH {_ITEMS}, {_BM.format(lists='list_concat(list_concat(' + _W.format(c='text', w=1) + ', ' + _W.format(c='lang', w=2) + '), ' + _W.format(c='source', w=3) + ')')}, {_KW.format(k=3)} SELECT * FROM kw",
    "like_fallback": "SELECT n_nationkey AS query_id, doc_id AS id FROM documents, nation, (VALUES (0)) WHERE contains(lower(substr(text, 1, 80) || chr(10) || source), 'th') AND contains(lower(substr(text, 1, 80) || chr(10) || source), 're') AND (lower(left(n_name, 2)) IN ('or') OR contains(lower(substr(text, 1, 80) || chr(10) || source), lower(left(n_name, 2))))",
    "domain_terms": f"WITH {_DOM.replace("@K", "12")} SELECT grp AS source, term, tf, df, score FROM dom",
    "text_affinity": f"WITH {_DOM.replace("@K", "40")}, {_AFF} SELECT * FROM hits",
    "knn_cosine": f"WITH {_V}, {_NEAR.format(d=_COS, where='q.id % 20 = 0', k=10)} SELECT * FROM near",
    "knn_l2": f"WITH {_V}, {_NEAR.format(d=_L2, where='q.id % 20 = 0', k=10)} SELECT * FROM near",
    "dual_vector_min": f"WITH {_V}, {_NEAR.format(d=_COS, where='q.id % 20 = 0', k=8)} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) - 1 AS place FROM near",
    "repo_centroids": f"WITH {_V}, {_CEN} SELECT label, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 5) AS x FROM cen",
    "classify_query": f"WITH {_V}, {_CEN}, s AS (SELECT id, cn.label AS l, round(list_cosine_similarity(e, c), 6) AS sim FROM v JOIN cn ON true WHERE id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, l) AS k, lead(sim) OVER (PARTITION BY id ORDER BY sim DESC, l) AS nxt FROM s) SELECT id, l AS top_repo, sim AS similarity, round(sim - nxt, 6) AS confidence FROM r WHERE k = 1",
    "specificity": f"WITH {_V}, {_CEN}, g AS (SELECT list(x ORDER BY pos) AS c FROM (SELECT pos, avg(x) AS x FROM (SELECT unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM v) GROUP BY 1)), r AS (SELECT id, 1 - list_cosine_similarity(e, g.c) AS g, 1 - list_cosine_similarity(e, cn.c) AS r FROM v JOIN cn USING (label), g) SELECT id, round(0.4::DOUBLE * (g - min(g) OVER ()) / (max(g) OVER () - min(g) OVER ()) + 0.6::DOUBLE * (r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ()), 5) AS specificity FROM r",
    "semantic_cache": f"WITH {_V}, n AS (SELECT * FROM v ORDER BY id DESC LIMIT 50), h AS (SELECT v.id, n.id AS hit_id, round(list_cosine_similarity(v.e, n.e), 6) AS similarity FROM v JOIN n ON round(list_cosine_similarity(v.e, n.e), 6) > 0.92 QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY n.id DESC) = 1) SELECT v.id, hit_id, similarity FROM v LEFT JOIN h USING (id)",
    "rrf": f"WITH {_ITEMS}, {_ONE}, {_KW.format(k=20)}, {_V}, {_SEM.format(k=20)}, {_FUSE} SELECT query_id, id, source, round(rrf, 6) AS rrf FROM fw",
    "weighted_rrf": f"WITH {_ITEMS}, {_ONE}, {_KW.format(k=20)}, {_V}, {_SEM.format(k=20)}, {_FUSE} SELECT query_id, id, round(weighted, 5) AS weighted FROM fw",
    "fused_score": f"WITH {_ITEMS}, {_ONE}, {_KW.format(k=20)}, {_V}, {_SEM.format(k=20)}, {_FUSE}, {_FACTS}, {_DOM.replace("@K", "40")}, {_AFF}, mo AS (SELECT query_id, max(hits) AS most FROM hits GROUP BY 1) SELECT fw.query_id, fw.id, round({_SCORE} * CASE WHEN most IS NULL THEN 1 ELSE 0.6::DOUBLE * (0.6::DOUBLE + 0.4::DOUBLE * coalesce(hits, 0) / most) + 0.4::DOUBLE END, 6) AS score FROM fw JOIN facts USING (id) LEFT JOIN hits USING (query_id, repo) LEFT JOIN mo USING (query_id)",
    "type_caps": f"WITH {_FACTS}, scored AS (SELECT *, round(usage_count + specificity, 6) AS score, repo AS query_id FROM facts), {_CAPS} SELECT query_id, id, card_type, score, place FROM out",
    "context_multi_query": f"WITH {_ITEMS}, {_ONE}, {_KW.format(k=10)}, {_V}, {_SEM.format(k=4)}, b AS (SELECT query_id, id, round(max(score), 6) AS score FROM (SELECT query_id, id, -rank AS score FROM kw UNION ALL SELECT query_id, id, (1 - distance) * 0.8::DOUBLE FROM near) GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS place FROM b QUALIFY place < 8",
}
