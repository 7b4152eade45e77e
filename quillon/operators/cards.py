"""Render knowledge cards: flow, model, cross-service and hub cards with identifiers, tags and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import pascal, singular, slug, snake, split_camel, short_path, tokens
from quillon.operators.graph import _paths, trade
from quillon.session import table


def identifiers(names: Column, paths: Column, routes: Column | None = None) -> Column:
    """Class names with their words, ten routes and four path names at most, in one searchable line."""
    words = F.transform(names, lambda n: F.concat_ws(" ", n, split_camel(n)))
    tail = F.transform(F.slice(paths, 1, 4), lambda p: F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"\.[^.]*$", ""))
    parts = F.concat(words, F.slice(routes, 1, 10), tail) if routes is not None else F.concat(words, tail)
    return F.array_join(F.array_distinct(parts), " ")


def category(path: Column) -> Column:
    """controller, job, model, api, store, component or none, by directory."""
    p = F.concat(F.lit("/"), F.lower(path))
    out = F.when(p.contains("/controllers/"), "controller").when(p.contains("/jobs/"), "job").when(p.contains("/models/"), "model")
    return out.when(p.rlike("/(api|services)/"), "api").when(p.rlike("/stores?/"), "store").when(p.contains("/components/"), "component")


def flow_cards(members: DataFrame, most: int = 20) -> DataFrame:
    """One card a flow from (flow, path, repo): files in order, `most` of them shown, repositories, tags and content."""
    w = Window.partitionBy("flow").orderBy("path")
    rows = members.distinct()
    totals = rows.groupBy("flow").agg(F.count("*").alias("files"), F.array_sort(F.collect_set("repo")).alias("repos"), F.array_sort(F.collect_set(category(F.col("path")))).alias("tags"))
    shown = rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).groupBy("flow").agg(F.transform(F.array_sort(F.collect_list("path")), short_path).alias("shown"))
    both = totals.join(shown, "flow")
    more = F.when(F.col("files") > most, F.concat(F.lit("\n- +"), (F.col("files") - most).cast("string"), F.lit(" more"))).otherwise("")
    content = F.concat(F.lit("# "), F.col("flow"), F.lit("\n\n**Repos:** "), F.array_join("repos", ", "), F.lit("\n\n## Files\n- "), F.array_join("shown", "\n- "), more)
    return both.select("flow", F.lit("flow").alias("card_type"), "files", F.array_join("tags", ",").alias("tags"), content.alias("content"), F.sha2(content, 256).alias("content_hash"), tokens(content).alias("tokens"))


def pair_cards(edges: DataFrame, limit: int = 15) -> DataFrame:
    """Cross-service cards: pairs of services by number of edges, the `limit` busiest; pairs of one name fall away."""
    got = edges.filter("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("calls"))
    return got.orderBy(F.desc("calls"), "src", "dst").limit(limit).select("src", "dst", "calls", F.concat(F.col("src"), F.lit(" -> "), F.col("dst")).alias("title"))


def model_cards(links: DataFrame, least: int = 2, limit: int = 20) -> DataFrame:
    """Models by number of associations, `least` at least, the `limit` richest: targets by type."""
    each = links.groupBy("model", "type").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("target")).alias("targets"))
    lines = F.array_join(F.array_sort(F.collect_list(F.concat(F.col("type"), F.lit(": "), F.array_join("targets", ", ")))), "\n")
    return each.groupBy("model").agg(F.sum("n").alias("associations"), lines.alias("content")).filter(F.col("associations") >= least).orderBy(F.desc("associations"), "model").limit(limit)


def _named_trade(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey"), F.col("n_name"))
    a, b = n.withColumnsRenamed({"n_nationkey": "src", "n_name": "a"}), n.withColumnsRenamed({"n_nationkey": "dst", "n_name": "b"})
    return trade(s, d).join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")


def _members(s, d):
    return _paths(s, d).join(table(s, d, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey").select(F.col("p_brand").alias("flow"), "path", F.concat(F.lit("repo"), (F.col("p_size") % 3).cast("string")).alias("repo"))


QUERIES = {
    "render_cards": lambda s, d: flow_cards(_members(s, d)),
    "pair_cards": lambda s, d: pair_cards(_named_trade(s, d)),
    "model_cards": lambda s, d: model_cards(table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("model"), F.col("c_mktsegment").alias("type"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("target"))),
    "identifiers": lambda s, d: table(s, d, "part").select("p_partkey", identifiers(F.array(pascal(F.replace("p_name", F.lit(" "), F.lit("_")))), F.array(F.concat(F.lit("lib/"), "p_brand", F.lit(".rb")))).alias("identifiers")),
    "name_forms": lambda s, d: table(s, d, "part").select("p_partkey", snake(pascal(F.replace("p_name", F.lit(" "), F.lit("_")))).alias("snake"), slug(F.concat_ws(" ", "p_brand", "p_type")).alias("slug"), singular(F.concat(F.col("p_name"), F.lit("s"))).alias("one")),
}
_P = "p AS (SELECT p_partkey, p_brand, p_size, ['app/models', 'app/controllers', 'spec/models', 'lib', 'config/locales', 'src/routes', 'test/helpers', 'app/helpers', 'db/migrations', 'packages/ui'][p_size % 10 + 1] || '/' || CASE WHEN p_partkey % 9 = 0 THEN 'index' WHEN p_partkey % 7 = 0 THEN replace(p_name, ' ', '_') || '_test' ELSE replace(p_name, ' ', '_') END || ['.rb', '.ts', '.py', '.yml'][length(p_type) % 4 + 1] AS path FROM part)"
SQL = {
    "render_cards": f"WITH {_P}, m AS (SELECT DISTINCT p_brand AS flow, path, 'repo' || (p_size % 3) AS repo FROM p), g AS (SELECT flow, repo, path, CASE WHEN contains('/' || lower(path), '/controllers/') THEN 'controller' WHEN contains('/' || lower(path), '/models/') THEN 'model' END AS tag, row_number() OVER (PARTITION BY flow ORDER BY path) AS r FROM m), c AS (SELECT flow, count(*) AS files, coalesce(string_agg(DISTINCT tag, ',' ORDER BY tag), '') AS tags, '# ' || flow || chr(10) || chr(10) || '**Repos:** ' || string_agg(DISTINCT repo, ', ' ORDER BY repo) || chr(10) || chr(10) || '## Files' || chr(10) || '- ' || string_agg(path, chr(10) || '- ' ORDER BY path) FILTER (r <= 20) || CASE WHEN count(*) > 20 THEN chr(10) || '- +' || (count(*) - 20) || ' more' ELSE '' END AS content FROM g GROUP BY 1) SELECT flow, 'flow' AS card_type, files, tags, content, sha256(content) AS content_hash, ceil(length(content) / 4)::BIGINT AS tokens FROM c",
    "pair_cards": "WITH e AS (SELECT a.n_name AS src, b.n_name AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey WHERE c_nationkey <> s_nationkey AND a.n_name <> b.n_name) SELECT src, dst, count(*)::DOUBLE AS calls, src || ' -> ' || dst AS title FROM e GROUP BY 1, 2 ORDER BY calls DESC, src, dst LIMIT 15",
    "model_cards": "WITH l AS (SELECT n_name AS model, c_mktsegment AS type, 'r' || n_regionkey AS target FROM customer JOIN nation ON c_nationkey = n_nationkey), e AS (SELECT model, type, count(*) AS n, string_agg(DISTINCT target, ', ' ORDER BY target) AS t FROM l GROUP BY 1, 2) SELECT model, sum(n)::BIGINT AS associations, string_agg(type || ': ' || t, chr(10) ORDER BY type || ': ' || t) AS content FROM e GROUP BY 1 HAVING sum(n) >= 2 ORDER BY associations DESC, model LIMIT 20",
    "identifiers": "WITH n AS (SELECT p_partkey, p_brand, list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)) AS w FROM part) SELECT p_partkey, array_to_string(w, '') || ' ' || array_to_string(w, ' ') || ' ' || p_brand AS identifiers FROM n",
    "name_forms": "SELECT p_partkey, replace(p_name, ' ', '_') AS snake, trim(regexp_replace(lower(p_brand || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug, p_name AS one FROM part",
}
