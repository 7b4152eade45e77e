"""Relational services over cards, files and repositories: rollups, joins on arrays, upserts and ordered selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import table

MASK = "•" * 8


# -- sinks as table transformations --------------------------------------------------------------------------------------


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], newest: str, locked: str | None = None) -> DataFrame:
    """One row a key: the newest of both. Keys that `locked` marks in old keep their old row.

    A max over a struct takes the newest row, so that a hot key is combined before the shuffle.
    """
    rest = [c for c in old.columns if c not in keys]
    if locked:
        held = old.filter(F.col(locked)).select(*keys).distinct()
        new = new.join(held, keys, "left_anti")
    both = old.withColumn("__turn", F.lit(0)).unionByName(new.withColumn("__turn", F.lit(1)))
    top = both.groupBy(*keys).agg(F.max(F.struct(F.col(newest).alias("__at"), "__turn", *rest)).alias("top"))
    return top.select(*keys, *(F.col(f"top.{c}").alias(c) for c in rest))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those rows of new whose key it lacks, the first by all columns of each key."""
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("low")).select(*keys, *(F.col(f"low.{c}").alias(c) for c in rest))
    return old.unionByName(one.join(old.select(*keys).distinct(), keys, "left_anti"))


def ttl_purge(rows: DataFrame, made: str, days: int, now: str) -> DataFrame:
    """Rows whose time to live has not run out at `now`."""
    return rows.filter(F.col(made) + F.expr(f"INTERVAL {days} DAYS") >= F.to_timestamp_ntz(F.lit(now)))


def high_water(rows: DataFrame, done: DataFrame, key: str, at: str) -> DataFrame:
    """Rows newer than the newest done one that are not done yet."""
    mark = done.agg(F.max(at)).scalar()
    return rows.filter(mark.isNull() | (F.col(at) > mark)).join(done.select(key), key, "left_anti")


# -- selections ----------------------------------------------------------------------------------------------------------


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by `order`, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    got = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return got.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def line_budget(cards: DataFrame, lines: Column, group: str, order: list, budget: int = 300, most: int = 40) -> DataFrame:
    """Cards by rank while their lines, each card cut at `most`, fit the budget; the first always stays."""
    w = Window.partitionBy(group).orderBy(*order)
    rows = cards.withColumn("lines", F.least(lines, F.lit(most)).cast("long")).withColumn("place", F.row_number().over(w).cast("long"))
    rows = rows.filter(F.col("place") <= budget)  # a card has a line at least; each task keeps so many of a group at most
    rows = rows.withColumn("used", F.sum("lines").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter((F.col("used") <= budget) | (F.col("place") == 1))


def mask_key(key: Column) -> Column:
    """At most 11 characters: all masked; else the first 7, eight bullets and the last 4."""
    n = F.char_length(key)
    return F.when(n <= 11, F.lit(MASK)).otherwise(F.concat(F.substring(key, 1, 7), F.lit(MASK), F.right(key, F.lit(4))))


def freshness(stale: Column, verified: Column, times: Column) -> Column:
    return F.when(stale, F.lit("needs verification")).when(verified, F.concat(F.lit("verified ("), times.cast("string"), F.lit("x)"))).otherwise(F.lit("likely valid"))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).otherwise(2)


# -- rollups -------------------------------------------------------------------------------------------------------------


def cards_of(docs: DataFrame) -> DataFrame:
    """Documents in the shape of cards: two source files and two repositories each, stale where the length is odd."""
    return docs.select(
        F.col("doc_id").alias("id"), F.col("source").alias("flow"), F.col("lang").alias("card_type"), F.substring(F.col("text"), 1, 80).alias("title"), F.col("text").alias("content"),
        F.array(F.concat_ws("/", "source", "lang", F.concat(F.lit("f"), (F.col("n_chars") % 7).cast("string"))), F.concat_ws("/", "source", F.concat(F.lit("g"), (F.col("n_chars") % 11).cast("string")))).alias("source_files"),
        F.array("source", F.concat(F.lit("repo"), (F.col("n_chars") % 5).cast("string"))).alias("source_repos"),
        (F.col("n_chars") % 2 == 1).alias("stale"), F.col("n_chars"),
    )


def files_of(docs: DataFrame) -> DataFrame:
    """An index of the cards' files: path, branch and heat."""
    cards = cards_of(docs)
    paths = cards.select(F.explode("source_files").alias("path"), "n_chars")
    return paths.groupBy("path").agg(F.round(F.avg(F.col("n_chars") % 100) / 100, 6).alias("heat"), F.countDistinct(F.col("n_chars") % 3).alias("branches"))


def flow_summary(cards: DataFrame, files: DataFrame, faithful: bool = False) -> DataFrame:
    """Per flow: cards, files, repositories, stale cards and mean heat of files.

    `faithful` counts over the product of files and repositories as the reference's statement does, which repeats a stale
    card for each pair and weights heat by it; the corrected form aggregates each kind by itself.
    """
    if faithful:
        rows = cards.select("flow", "id", "stale", F.explode_outer("source_files").alias("path"), "source_repos").select("*", F.explode_outer("source_repos").alias("repo")).join(files, "path", "left")
        return rows.groupBy("flow").agg(
            F.countDistinct("id").alias("cards"), F.countDistinct("path").alias("files"), F.countDistinct("repo").alias("repos"),
            F.sum(F.col("stale").cast("long")).alias("stale"), F.round(F.avg("heat"), 4).alias("avg_heat"),
        )
    base = cards.groupBy("flow").agg(F.countDistinct("id").alias("cards"), F.count_if("stale").alias("stale"))
    paths = cards.select("flow", F.explode("source_files").alias("path")).distinct().join(files.select("path", "heat"), "path", "left")
    # whole millionths, halves up: no order of addition and no binary fraction decides the last digit
    n, total = F.count("heat"), F.sum(F.round(F.col("heat") * 1_000_000).cast("long"))
    mean = F.when(n > 0, F.expr("1.0D") * F.floor((2 * total + 100 * n) / (200 * n)) / 10_000)
    heat = paths.groupBy("flow").agg(F.count("path").alias("files"), mean.alias("avg_heat"))
    repos = cards.select("flow", F.explode("source_repos").alias("repo")).groupBy("flow").agg(F.countDistinct("repo").alias("repos"))
    return base.join(heat, "flow", "left").join(repos, "flow", "left").select("flow", "cards", "files", "repos", "stale", "avg_heat")


def repo_rollup(cards: DataFrame) -> DataFrame:
    """Cards and stale ones of each repository, and whether enough are stale to index it again."""
    got = cards.select("id", "stale", F.explode("source_repos").alias("repo")).groupBy("repo").agg(F.countDistinct("id").alias("cards"), F.count_if("stale").alias("stale"))
    return got.withColumn("reindex", F.col("stale") >= 5)


def workspace_status(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Per repository (market segment): files, stale ones, last commit and its three busiest customers."""
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    base = rows.groupBy("c_mktsegment").agg(F.count("*").alias("files"), F.count_if(F.col("o_orderstatus") == "O").alias("stale"), F.max("o_orderdate").alias("last_commit"))
    top = rows.groupBy("c_mktsegment", "c_custkey").agg(F.count("*").alias("n"))
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("n"), "c_custkey")
    top = top.withColumn("place", F.row_number().over(w)).filter("place <= 3")
    top = top.groupBy("c_mktsegment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "c_custkey"))), lambda x: x["c_custkey"].cast("string")), ",").alias("top"))
    return base.join(top, "c_mktsegment", "left").select(F.col("c_mktsegment").alias("repo"), "files", "stale", "last_commit", "top")


def file_relevance(results: DataFrame, limit: int = 20) -> DataFrame:
    """Sum of the scores of results a file is in, the best first."""
    return results.select("score", F.explode("source_files").alias("path")).groupBy("path").agg(F.sum("score").alias("score"), F.count("*").alias("cards")).orderBy(F.desc("score"), "path").limit(limit)


def catalog_nested(nations: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Projects with their prompts (nations with suppliers), in order; those without keep an empty list."""
    prompts = suppliers.groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey"))), lambda x: x["s_suppkey"].cast("string")), ",").alias("prompts"), F.count("*").alias("n"))
    return nations.join(prompts, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_name", F.coalesce("prompts", F.lit("")).alias("prompts"), F.coalesce("n", F.lit(0)).alias("n"))


def content_dedup(cards: DataFrame) -> DataFrame:
    """One card of equal contents, with the repositories of all, the smallest id first."""
    rows = cards.select("id", F.sha2("content", 256).alias("hash"), F.explode("source_repos").alias("repo"))
    return rows.groupBy("hash").agg(F.min("id").alias("id"), F.array_join(F.array_sort(F.collect_set("repo")), ",").alias("repos"), F.countDistinct("id").alias("copies"))


def branch_gc(cards: DataFrame, live: Column) -> DataFrame:
    """Cards against live branches: gone (none left), shrunk (rewritten and stale) or kept."""
    left = F.array_intersect("branches", live)
    state = F.when(F.size("branches") == 0, "kept").when(F.size(left) == 0, "gone").when(F.size(left) < F.size("branches"), "shrunk").otherwise("kept")
    return cards.select("id", F.array_join(left, ",").alias("branches"), state.alias("state"))


def memory_doc(events: DataFrame, parts: DataFrame) -> DataFrame:
    """Log joined with the cards it answered with: per card title, uses and last use, the most used first."""
    seen = events.select("ts", F.get_json_object("props", "$.k").cast("long").alias("card"))
    return seen.join(parts, F.col("card") == F.col("p_partkey")).groupBy("p_partkey", "p_name").agg(F.count("*").alias("uses"), F.max("ts").alias("last_used")).orderBy(F.desc("uses"), "p_partkey").limit(20)


def members(customers: DataFrame, nations: DataFrame) -> DataFrame:
    """Members with their team; without a role of their own they are members."""
    role = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("owner"))
    return customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name", F.coalesce(role, F.lit("member")).alias("role")).agg(F.count("*").alias("members"))


def workspaces(customers: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Nations that customers belong to or suppliers own, each once; belonging comes first."""
    both = customers.select(F.col("c_nationkey").alias("nation"), F.lit(0).alias("turn"), F.lit("member").alias("how")).unionByName(suppliers.select(F.col("s_nationkey").alias("nation"), F.lit(1).alias("turn"), F.lit("owner").alias("how")))
    return first_wins(both, ["nation"], ["turn"]).select("nation", "how")


def _cards(s, d):
    return cards_of(table(s, d, "documents"))


_BR = lambda: F.array(*(F.concat(F.lit("b"), (F.col("n_chars") % k).cast("string")) for k in (2, 3, 5)))


def _event_rows(s, d):
    return table(s, d, "events").select("event_id", "user_id", "event_type", "ts", "value")


QUERIES = {
    "upsert_latest": lambda s, d: upsert_latest(_event_rows(s, d).filter("event_type <> 'view'").select("user_id", "event_type", "ts", "event_id"), _event_rows(s, d).filter("event_type = 'view'").select("user_id", "event_type", "ts", "event_id"), ["user_id"], "ts"),
    "insert_ignore": lambda s, d: insert_ignore(table(s, d, "customer").filter("c_acctbal > 0").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("v")).groupBy("k").agg(F.min("v").alias("v")).filter("k % 3 <> 0"), table(s, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("v")), ["k"]),
    "ttl_purge": lambda s, d: ttl_purge(_event_rows(s, d), "ts", 14, "2024-01-31 00:00:00").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")),
    "high_water_import": lambda s, d: high_water(_event_rows(s, d).select("event_id", "ts"), _event_rows(s, d).filter("ts < '2024-01-20'").select("event_id", "ts"), "event_id", "ts"),
    "first_wins": lambda s, d: first_wins(_event_rows(s, d).select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"]),
    "line_budget": lambda s, d: line_budget(_cards(s, d), F.size(F.split("content", "\n")), "flow", [F.desc("n_chars"), "id"]).select("flow", "id", "lines", "used", "place"),
    "mask_keys": lambda s, d: table(s, d, "customer").select("c_custkey", mask_key(F.col("c_name")).alias("masked"), mask_key(F.col("c_mktsegment")).alias("masked_segment")),
    "card_freshness": lambda s, d: _cards(s, d).select("id", freshness(F.col("stale"), F.col("n_chars") % 3 == 0, F.col("n_chars") % 9).alias("label")),
    "severity_order": lambda s, d: _event_rows(s, d).select("event_id", severity_rank(F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "warning").otherwise("info")).alias("rank")),
    "flow_summary": lambda s, d: flow_summary(_cards(s, d), files_of(table(s, d, "documents"))),
    "flow_summary_faithful": lambda s, d: flow_summary(_cards(s, d), files_of(table(s, d, "documents")), True),
    "repo_rollup": lambda s, d: repo_rollup(_cards(s, d)),
    "workspace_status": lambda s, d: workspace_status(table(s, d, "orders"), table(s, d, "customer")),
    "file_relevance": lambda s, d: file_relevance(_cards(s, d).withColumn("score", F.col("n_chars"))),
    "catalog_nested": lambda s, d: catalog_nested(table(s, d, "nation"), table(s, d, "supplier").filter("s_acctbal > 0")),
    "content_dedup": lambda s, d: content_dedup(_cards(s, d)).drop("hash"),
    "branch_gc": lambda s, d: branch_gc(_cards(s, d).withColumn("branches", F.array_distinct(_BR())), F.array(F.lit("b0"), F.lit("b1"))),
    "memory_doc": lambda s, d: memory_doc(table(s, d, "events"), table(s, d, "part")),
    "members": lambda s, d: members(table(s, d, "customer"), table(s, d, "nation")),
    "workspaces": lambda s, d: workspaces(table(s, d, "customer"), table(s, d, "supplier")),
    "substring_membership": lambda s, d: _cards(s, d).agg(F.count_if(F.exists("source_repos", lambda r: r.contains("src1"))).alias("containing"), F.count_if(F.array_contains("source_repos", "src1")).alias("exact")),
    "path_exclusion": lambda s, d: table(s, d, "pages").filter(~F.col("url").ilike("%test%") & ~F.col("url").ilike("%example.com/en%") & ~F.col("url").ilike("%bench%")).select("page_id", "url"),
}
_C = "c AS (SELECT doc_id AS id, source AS flow, lang AS card_type, text AS content, [source || '/' || lang || '/f' || (n_chars % 7), source || '/g' || (n_chars % 11)] AS source_files, [source, 'repo' || (n_chars % 5)] AS source_repos, n_chars % 2 = 1 AS stale, n_chars FROM documents)"
_F = "f AS (SELECT path, round(avg(n_chars % 100) / 100, 6) AS heat FROM (SELECT unnest(source_files) AS path, n_chars FROM c) GROUP BY 1)"
SQL = {
    "upsert_latest": "SELECT user_id, event_type, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, (event_type = 'view') DESC, event_type DESC, event_id DESC) = 1",
    "insert_ignore": "WITH o AS (SELECT c_nationkey AS k, min(c_custkey) AS v FROM customer WHERE c_acctbal > 0 GROUP BY 1 HAVING k % 3 <> 0) SELECT k, v FROM o UNION ALL SELECT s_nationkey, min(s_suppkey) FROM supplier WHERE s_nationkey NOT IN (SELECT k FROM o) GROUP BY 1",
    "ttl_purge": "SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events WHERE ts + INTERVAL 14 DAYS >= TIMESTAMP '2024-01-31' GROUP BY 1",
    "high_water_import": "SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '2024-01-20') AND ts >= TIMESTAMP '2024-01-20'",
    "first_wins": "SELECT user_id, event_type, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "line_budget": f"WITH {_C}, l AS (SELECT flow, id, least(len(string_split(content, chr(10))), 40)::BIGINT AS lines, n_chars FROM c), p AS (SELECT flow, id, lines, (sum(lines) OVER w)::BIGINT AS used, row_number() OVER w AS place FROM l WINDOW w AS (PARTITION BY flow ORDER BY n_chars DESC, id ROWS UNBOUNDED PRECEDING)) SELECT * FROM p WHERE used <= 300 OR place = 1",
    "mask_keys": f"SELECT c_custkey, CASE WHEN length(c_name) <= 11 THEN '{MASK}' ELSE substr(c_name, 1, 7) || '{MASK}' || right(c_name, 4) END AS masked, CASE WHEN length(c_mktsegment) <= 11 THEN '{MASK}' ELSE substr(c_mktsegment, 1, 7) || '{MASK}' || right(c_mktsegment, 4) END AS masked_segment FROM customer",
    "card_freshness": f"WITH {_C} SELECT id, CASE WHEN stale THEN 'needs verification' WHEN n_chars % 3 = 0 THEN 'verified (' || (n_chars % 9) || 'x)' ELSE 'likely valid' END AS label FROM c",
    "severity_order": "SELECT event_id, CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS rank FROM events",
    "flow_summary": f"WITH {_C}, {_F}, p AS (SELECT DISTINCT flow, unnest(source_files) AS path FROM c), h AS (SELECT flow, count(*) AS files, CASE WHEN count(heat) > 0 THEN ((2 * sum(round(heat * 1000000)::BIGINT) + 100 * count(heat)) // (200 * count(heat)))::DOUBLE / 10000 END AS avg_heat FROM p LEFT JOIN f USING (path) GROUP BY 1), r AS (SELECT flow, count(DISTINCT repo) AS repos FROM (SELECT flow, unnest(source_repos) AS repo FROM c) GROUP BY 1), b AS (SELECT flow, count(DISTINCT id) AS cards, count(*) FILTER (stale) AS stale FROM c GROUP BY 1) SELECT flow, cards, files, repos, stale, avg_heat FROM b LEFT JOIN h USING (flow) LEFT JOIN r USING (flow)",
    "flow_summary_faithful": f"WITH {_C}, {_F}, x AS (SELECT flow, id, stale, path, unnest(source_repos) AS repo FROM (SELECT *, unnest(source_files) AS path FROM c)) SELECT flow, count(DISTINCT id) AS cards, count(DISTINCT path) AS files, count(DISTINCT repo) AS repos, sum(stale::BIGINT)::BIGINT AS stale, round(avg(heat), 4) AS avg_heat FROM x LEFT JOIN f USING (path) GROUP BY 1",
    "repo_rollup": f"WITH {_C} SELECT repo, count(DISTINCT id) AS cards, count(*) FILTER (stale) AS stale, count(*) FILTER (stale) >= 5 AS reindex FROM (SELECT id, stale, unnest(source_repos) AS repo FROM c) GROUP BY 1",
    "workspace_status": "WITH r AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey), t AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY count(*) DESC, c_custkey) AS place FROM r GROUP BY 1, 2), l AS (SELECT c_mktsegment, string_agg(c_custkey, ',' ORDER BY place) AS top FROM t WHERE place <= 3 GROUP BY 1), b AS (SELECT c_mktsegment, count(*) AS files, count(*) FILTER (o_orderstatus = 'O') AS stale, max(o_orderdate) AS last_commit FROM r GROUP BY 1) SELECT c_mktsegment AS repo, files, stale, last_commit, top FROM b LEFT JOIN l USING (c_mktsegment)",
    "file_relevance": f"WITH {_C} SELECT path, sum(n_chars)::BIGINT AS score, count(*) AS cards FROM (SELECT n_chars, unnest(source_files) AS path FROM c) GROUP BY 1 ORDER BY score DESC, path LIMIT 20",
    "catalog_nested": "SELECT n_name, coalesce(string_agg(s_suppkey, ',' ORDER BY s_suppkey), '') AS prompts, count(s_suppkey) AS n FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON n_nationkey = s_nationkey GROUP BY n_nationkey, n_name",
    "content_dedup": f"WITH {_C} SELECT min(id) AS id, string_agg(DISTINCT repo, ',' ORDER BY repo) AS repos, count(DISTINCT id) AS copies FROM (SELECT id, content, unnest(source_repos) AS repo FROM c) GROUP BY content",
    "branch_gc": f"WITH {_C}, b AS (SELECT id, CASE WHEN n_chars % 2 = n_chars % 3 THEN [n_chars % 2] ELSE [n_chars % 2, n_chars % 3] END AS two, n_chars FROM c), t AS (SELECT id, CASE WHEN list_contains(two, n_chars % 5) THEN two ELSE list_append(two, n_chars % 5) END AS br FROM b) SELECT id, coalesce((SELECT string_agg('b' || x, ',' ORDER BY i) FROM (SELECT unnest(br) AS x, generate_subscripts(br, 1) AS i) WHERE x < 2), '') AS branches, CASE WHEN NOT list_has_any(br, [0, 1]) THEN 'gone' WHEN list_max(br) > 1 THEN 'shrunk' ELSE 'kept' END AS state FROM t",
    "memory_doc": "SELECT p_partkey, p_name, count(*) AS uses, max(ts) AS last_used FROM events JOIN part ON json_extract_string(props, '$.k')::BIGINT = p_partkey GROUP BY 1, 2 ORDER BY uses DESC, p_partkey LIMIT 20",
    "members": "SELECT n_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'owner' ELSE 'member' END AS role, count(*) AS members FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
    "workspaces": "SELECT nation, CASE WHEN bool_or(m) THEN 'member' ELSE 'owner' END AS how FROM (SELECT c_nationkey AS nation, true AS m FROM customer UNION ALL SELECT s_nationkey, false FROM supplier) GROUP BY 1",
    "substring_membership": f"WITH {_C} SELECT count(*) FILTER (flow LIKE '%src1%') AS containing, count(*) FILTER (flow = 'src1') AS exact FROM c",
    "path_exclusion": "SELECT page_id, url FROM pages WHERE url NOT ILIKE '%test%' AND url NOT ILIKE '%example.com/en%' AND url NOT ILIKE '%bench%'",
}
