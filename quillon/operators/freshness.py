"""Keep cards current: heat of files, invalidation of cards and documents, branch roles, epics, debounced change batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import branch_class, branch_hint, branch_role, branch_target, epic_of, sync_level, tier, tier_budget
from quillon.operators.graph import _paths
from quillon.operators.relational import cards_of
from quillon.session import table

# What a change of a file makes stale; a file counts for the first pattern that it fits
DOC_RULES = [
    (r"(?i)schema\.rb$", ["architecture", "rules"]),
    (r"(?i)config/routes\.rb$", ["architecture"]),
    (r"(?i)/routes/", ["architecture"]),
    (r"(?i)/models/", ["about", "architecture", "rules"]),
    (r"(?i)/policies/", ["rules"]),
    (r"(?i)/concerns/", ["rules"]),
    (r"(?i)package\.json$", ["readme"]),
    (r"(?i)Gemfile(\.lock)?$", ["readme"]),
    (r"(?i)\.(scss|css|less|sass)$", ["styles"]),
    (r"(?i)\.(js|ts|jsx|tsx|rb|py|go|java)$", ["code_style"]),
]
SOURCES = r"(?i)\.(rb|ts|tsx|js|jsx|py|go|java|php|rs)$"


def thermal_map(commits: DataFrame, days: int = 180) -> DataFrame:
    """(path, commits, heat): commits of the last days over the most of any file. commits: path, ts."""
    newest = commits.agg(F.max("ts")).scalar()
    counts = commits.filter(F.col("ts") >= newest - F.expr(f"INTERVAL {days} DAYS")).groupBy("path").agg(F.count("*").alias("commits"))
    most = counts.agg(F.max("commits")).scalar()
    return counts.withColumn("most", most).select("path", "commits", F.round(F.col("commits") / F.col("most"), 6).alias("heat"))


def flow_heat(members: DataFrame, heat: DataFrame) -> DataFrame:
    """Mean heat of each flow's files, files without commits count 0; tier and token budget."""
    got = members.join(heat.select("path", "heat"), "path", "left").groupBy("flow").agg(F.round(F.avg(F.coalesce("heat", F.lit(0.0))), 6).alias("heat"))
    return got.select("flow", "heat", tier(F.col("heat")).alias("tier"), tier_budget(F.col("heat")).alias("budget"))


def invalidate_cards(cards: DataFrame, changed: DataFrame) -> DataFrame:
    """Cards with stale set where one of their files has changed; card_state tells what happened."""
    hit = cards.select("id", F.explode("source_files").alias("path")).join(changed.select("path").distinct(), "path", "left_semi").select("id").distinct()
    rows = cards.join(hit.withColumn("hit", F.lit(True)), "id", "left")
    now = F.col("stale") | F.coalesce("hit", F.lit(False))
    return rows.select("id", now.alias("stale"), F.when(now & ~F.col("stale"), "invalidated").otherwise("unchanged").alias("card_state"))


def doc_types(path: Column) -> Column:
    out = F.array().cast("array<string>")
    for pattern, kinds in reversed(DOC_RULES):
        out = F.when(path.rlike(pattern), F.array(*(F.lit(k) for k in kinds))).otherwise(out)
    return out


def invalidate_docs(changed: DataFrame, merge: bool = False) -> DataFrame:
    """(repo, doc_type) that changes make stale; about, architecture and rules take specialist with them, merges changelog."""
    direct = changed.select("repo", F.explode(doc_types(F.col("path"))).alias("doc_type")).distinct()
    special = direct.filter(F.col("doc_type").isin("about", "architecture", "rules")).select("repo", F.lit("specialist").alias("doc_type"))
    out = direct.union(special)
    if merge:
        out = out.union(changed.filter(F.col("path").rlike(SOURCES)).select("repo", F.lit("changelog").alias("doc_type")))
    return out.distinct()


def branch_roles(events: DataFrame, days: int = 30) -> DataFrame:
    """Role of each branch of a repository by name; of the others the most merged is main if a week old. events: repo, branch, event_type, ts."""
    newest = events.agg(F.max("ts")).scalar()
    recent = events.withColumn("newest", newest).filter(F.col("ts") >= F.col("newest") - F.expr(f"INTERVAL {days} DAYS"))
    got = recent.groupBy("repo", "branch").agg(F.count_if(F.col("event_type") == "merge").alias("merges"), F.min("ts").alias("first"), F.max("newest").alias("newest"))
    named = branch_role(F.col("branch"))
    unknown = F.when(named == "unknown", F.col("merges"))
    w = Window.partitionBy("repo").orderBy(F.desc_nulls_last(unknown), "branch")
    old = F.col("first") < F.col("newest") - F.expr("INTERVAL 7 DAYS")
    got = got.withColumns({"named": named, "place": F.row_number().over(w)}).filter((F.col("named") != "unknown") | ((F.col("place") == 1) & (F.col("merges") > 0)))
    role = F.when(F.col("named") != "unknown", F.col("named")).when(old, "main").otherwise("unknown")
    trust = F.when(F.col("named") == "main", 0.95).when(F.col("named") == "feature", 0.7).when(F.col("named") != "unknown", 0.85).when(old, 0.6).otherwise(0.3)
    return got.select("repo", "branch", role.alias("role"), trust.alias("confidence"), F.round(F.col("merges") / (30 / 7), 2).alias("merges_per_week"))


def epics(events: DataFrame) -> DataFrame:
    """The branch, bases apart, that most repositories are on, least name of equal ones, with repositories on it and elsewhere."""
    now = events.groupBy("repo").agg(F.max(F.struct("ts", "branch"))["branch"].alias("branch"))
    count = now.filter(branch_class(F.col("branch")) != "base").groupBy("branch").agg(F.count("*").alias("n"))
    epic = count.agg(F.min_by("branch", F.struct((-F.col("n")).alias("n"), "branch"))).scalar()
    return now.withColumn("epic", epic).groupBy("epic").agg(F.count_if(F.col("branch") == F.col("epic")).alias("on_it"), F.count_if(F.col("branch") != F.col("epic")).alias("elsewhere"))


def debounce(changes: DataFrame, quiet: str = "30 minutes") -> DataFrame:
    """Batches of changes of a repository with no longer pause inside: first and last time, size. changes: repo, ts."""
    got = changes.groupBy("repo", F.session_window(F.col("ts").cast("timestamp"), quiet).alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return got.select("repo", "first", "last", "n")


def _branches(s, d):
    return named_branches(table(s, d, "events"))


def named_branches(events: DataFrame) -> DataFrame:
    """Events as branch events: repositories by user, branches by kind of event."""
    name = F.when(F.col("event_type") == "click", "main").when(F.col("event_type") == "view", F.concat(F.lit("feature/AB-"), (F.col("user_id") % 7).cast("string"), F.lit("-new_card"))).when(F.col("event_type") == "error", "demo/box")
    name = name.when(F.col("event_type") == "signup", F.concat(F.lit("work-"), (F.col("event_id") % 3).cast("string"))).otherwise(F.concat(F.lit("epic/Big-"), (F.col("event_id") % 2).cast("string")))
    return events.select((F.col("user_id") % 20).alias("repo"), name.alias("branch"), F.when(F.col("value") > 20, "merge").otherwise("push").alias("event_type"), "ts", "event_id")


def _commits(s, d):
    return table(s, d, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderdate").alias("ts"))


def _changed(s, d):
    return _paths(s, d).select((F.col("p_partkey") % 9).alias("repo"), "path")


QUERIES = {
    "thermal_map": lambda s, d: thermal_map(_commits(s, d)),
    "flow_heat_tier": lambda s, d: flow_heat(table(s, d, "customer").select(F.col("c_nationkey").alias("flow"), F.col("c_custkey").alias("path")), thermal_map(_commits(s, d))),
    "invalidate_cards": lambda s, d: invalidate_cards(cards_of(table(s, d, "documents")), table(s, d, "documents").filter("lang = 'de'").select(F.concat_ws("/", "source", F.concat(F.lit("g"), (F.col("n_chars") % 11).cast("string"))).alias("path"))),
    "invalidate_docs": lambda s, d: invalidate_docs(_changed(s, d), True),
    "branch_roles": lambda s, d: branch_roles(_branches(s, d)),
    "branch_names": lambda s, d: _branches(s, d).groupBy("branch").agg(F.count("*").alias("n")).select("branch", "n", branch_class(F.col("branch")).alias("kind"), branch_target(F.col("branch")).alias("target"), sync_level(F.col("branch")).alias("level"), branch_hint(F.col("branch")).alias("hint"), epic_of(F.col("branch")).alias("epic")),
    "branch_rollup": lambda s, d: _branches(s, d).groupBy("branch", "event_type").agg(F.max("ts").alias("last_seen"), F.count("*").alias("n")),
    "epic_detect": lambda s, d: epics(_branches(s, d)),
    "debounce_sessions": lambda s, d: debounce(table(s, d, "events").select(F.col("user_id").alias("repo"), "ts")),
}
_B = "b AS (SELECT user_id % 20 AS repo, CASE event_type WHEN 'click' THEN 'main' WHEN 'view' THEN 'feature/AB-' || (user_id % 7) || '-new_card' WHEN 'error' THEN 'demo/box' WHEN 'signup' THEN 'work-' || (event_id % 3) ELSE 'epic/Big-' || (event_id % 2) END AS branch, CASE WHEN value > 20 THEN 'merge' ELSE 'push' END AS event_type, ts FROM events)"
_HEAT = "h AS (SELECT path, commits, round(commits / max(commits) OVER (), 6) AS heat FROM (SELECT o_custkey AS path, count(*) AS commits FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 180 DAYS GROUP BY 1))"
_P = "p AS (SELECT p_partkey % 9 AS repo, ['app/models', 'app/controllers', 'spec/models', 'lib', 'config/locales', 'src/routes', 'test/helpers', 'app/helpers', 'db/migrations', 'packages/ui'][p_size % 10 + 1] || '/' || CASE WHEN p_partkey % 9 = 0 THEN 'index' WHEN p_partkey % 7 = 0 THEN replace(p_name, ' ', '_') || '_test' ELSE replace(p_name, ' ', '_') END || ['.rb', '.ts', '.py', '.yml'][length(p_type) % 4 + 1] AS path FROM part)"
_KIND = "CASE WHEN branch IN ('main', 'master', 'develop', 'trunk') THEN 'base' WHEN regexp_matches(branch, '(?i)^(demo|staging|prod|production|release)(/.*)?$') THEN 'environment' ELSE 'feature' END"
SQL = {
    "thermal_map": f"WITH {_HEAT} SELECT * FROM h",
    "flow_heat_tier": f"WITH {_HEAT}, f AS (SELECT c_nationkey AS flow, round(avg(coalesce(heat, 0)), 6) AS heat FROM customer LEFT JOIN h ON c_custkey = path GROUP BY 1) SELECT flow, heat, CASE WHEN heat > 0.6 THEN 'premium' WHEN heat > 0.3 THEN 'standard' ELSE 'structural' END AS tier, CASE WHEN heat > 0.6 THEN 1500 WHEN heat > 0.3 THEN 800 ELSE 350 END AS budget FROM f",
    "invalidate_cards": "WITH g AS (SELECT DISTINCT source || '/g' || (n_chars % 11) AS path FROM documents WHERE lang = 'de') SELECT doc_id AS id, n_chars % 2 = 1 OR source || '/g' || (n_chars % 11) IN (SELECT path FROM g) AS stale, CASE WHEN n_chars % 2 = 0 AND source || '/g' || (n_chars % 11) IN (SELECT path FROM g) THEN 'invalidated' ELSE 'unchanged' END AS card_state FROM documents",
    "invalidate_docs": f"WITH {_P}, k AS (SELECT DISTINCT repo, unnest(CASE WHEN path LIKE '%/routes/%' THEN ['architecture'] WHEN path LIKE '%/models/%' THEN ['about', 'architecture', 'rules'] WHEN regexp_matches(path, '\\.(ts|rb|py)$') THEN ['code_style'] ELSE [] END) AS doc_type FROM p) SELECT * FROM k UNION SELECT repo, 'specialist' FROM k WHERE doc_type IN ('about', 'architecture', 'rules') UNION SELECT repo, 'changelog' FROM p WHERE regexp_matches(path, '\\.(ts|rb|py)$')",
    "branch_roles": f"WITH {_B}, m AS (SELECT max(ts) AS newest FROM b), g AS (SELECT repo, branch, count(*) FILTER (event_type = 'merge') AS merges, min(ts) AS first, CASE WHEN branch = 'main' THEN 'main' WHEN branch LIKE 'feature/%' THEN 'feature' WHEN branch LIKE 'demo/%' THEN 'demo' ELSE 'unknown' END AS named FROM b, m WHERE ts >= newest - INTERVAL 30 DAYS GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY repo, named = 'unknown' ORDER BY merges DESC, branch) AS place, first < (SELECT newest FROM m) - INTERVAL 7 DAYS AS old FROM g) SELECT repo, branch, CASE WHEN named <> 'unknown' THEN named WHEN old THEN 'main' ELSE 'unknown' END AS role, CASE WHEN named = 'main' THEN 0.95 WHEN named = 'feature' THEN 0.7 WHEN named <> 'unknown' THEN 0.85 WHEN old THEN 0.6 ELSE 0.3 END::DOUBLE AS confidence, round(merges / (30.0::DOUBLE / 7), 2) AS merges_per_week FROM r WHERE named <> 'unknown' OR (place = 1 AND merges > 0)",
    "branch_names": f"WITH {_B} SELECT branch, count(*) AS n, {_KIND} AS kind, CASE WHEN branch LIKE 'demo/%' THEN 'demo' END AS target, CASE WHEN branch LIKE 'demo/%' THEN 'skip' WHEN branch = 'main' OR branch LIKE 'epic/%' THEN 'full' ELSE 'lightweight' END AS level, CASE WHEN branch LIKE 'feature/%' THEN 'new card' ELSE replace(replace(branch, '-', ' '), '/', ' ') END AS hint, CASE WHEN branch LIKE 'epic/%' THEN replace(substr(branch, 6), '-', ' ') END AS epic FROM b GROUP BY branch",
    "branch_rollup": f"WITH {_B} SELECT branch, event_type, max(ts) AS last_seen, count(*) AS n FROM b GROUP BY 1, 2",
    "epic_detect": f"WITH {_B}, n AS (SELECT repo, branch FROM b QUALIFY row_number() OVER (PARTITION BY repo ORDER BY ts DESC, branch DESC) = 1), e AS (SELECT branch AS epic FROM n WHERE {_KIND} <> 'base' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT epic, count(*) FILTER (branch = epic) AS on_it, count(*) FILTER (branch <> epic) AS elsewhere FROM n, e GROUP BY 1",
    "debounce_sessions": "WITH s AS (SELECT user_id AS repo, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS head FROM events), g AS (SELECT repo, ts, sum(head) OVER (PARTITION BY repo ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM s) SELECT repo, min(ts) AS first, max(ts) AS last, count(*) AS n FROM g GROUP BY repo, k",
}
