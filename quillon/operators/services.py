"""Small services: rule scopes and verdicts, visibility, votes, changelogs, priorities and lookups, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import pascal, singular
from quillon.operators import retrieval
from quillon.operators.graph import _PATHS, _paths
from quillon.operators.relational import cards_of, first_wins
from quillon.session import table

# File endings of a rule's scope
SCOPES = {
    "rails": [".rb", ".erb", ".rake"], "react": [".tsx", ".jsx", ".ts", ".js"], "vue": [".vue", ".ts", ".js"], "go": [".go"], "python": [".py"],
    "django": [".py"], "nextjs": [".tsx", ".ts", ".jsx", ".js"], "angular": [".ts", ".html"], "laravel": [".php"], "spring": [".java", ".kt"],
}
# Order of card types, sections of a changelog, and the commit pattern
CARD_ORDER = {"model": 0, "flow": 1, "cross_service": 2, "hub": 3, "dev_insight": 1}
SECTIONS = {"feat": "feat", "fix": "fix", "refactor": "refactor", "docs": "docs", "chore": "chore", "ci": "chore", "build": "chore", "test": "chore", "style": "other", "perf": "other"}
COMMIT = r"^[0-9a-f]{7,} (feat|fix|chore|docs|refactor|test|style|perf|ci|build)(\((.+?)\))?!?: (.+)"


def _pick(choices: list, at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(c) for c in choices)), (at + 1).cast("int"))


def filtered(cards: DataFrame, flow: str | None = None, stale: bool | None = None, without: list[str] | None = None) -> DataFrame:
    """Cards of a flow, stale or not, without some types; what is None doesn't filter."""
    tests = [F.col("flow") == flow if flow is not None else None, F.col("stale") == stale if stale is not None else None, ~F.col("card_type").isin(without) if without else None]
    for t in tests:
        cards = cards if t is None else cards.filter(t)
    return cards


def visible(near: DataFrame, cards: DataFrame, branch: str | None, limit: int) -> DataFrame:
    """The first `limit` of each query's list (fetched three times as long) whose card is valid on the branch: on all where it names none."""
    if branch is not None:
        seen = cards.filter(F.col("valid_branches").isNull() | F.array_contains("valid_branches", branch)).select("id")
        near = near.join(seen, "id", "left_semi")
    return retrieval.top(near, limit, ["distance", "id"])


def rules_for(rules: DataFrame, diffs: DataFrame) -> DataFrame:
    """(rule, diff) where the rule (id, scope) applies to the diff (diff, path): scope null or unknown, or a path with one of its endings."""
    known = F.create_map(*(F.lit(x) for k, v in SCOPES.items() for x in (k, ",".join(v))))
    rules = rules.select(F.col("id").alias("rule"), F.split(known[F.lower("scope")], ",").alias("ends"))
    ending = diffs.select("diff", F.regexp_extract("path", r"(\.[^./]+)$", 1).alias("ending")).distinct()
    some = rules.select("rule", F.explode("ends").alias("ending")).join(ending, "ending").select("rule", "diff").distinct()
    always = rules.filter("ends IS NULL").select("rule", F.lit(0).alias("one")).join(diffs.select("diff", F.lit(0).alias("one")).distinct(), "one").select("rule", "diff")
    return some.union(always)


def verdicts(violations: DataFrame) -> DataFrame:
    """Per diff: passed has no error, strict_passed no violation at all; a null severity is none."""
    errors, every = F.count_if(F.col("severity") == "error"), F.count("severity")
    return violations.groupBy("diff").agg((errors == 0).alias("passed"), ((errors == 0) & (every == 0)).alias("strict_passed"))


def repo_summary(profiles: DataFrame, files: DataFrame) -> DataFrame:
    """Every repository with its number of files and the last time one was indexed."""
    got = files.groupBy("repo").agg(F.countDistinct("path").alias("files"), F.max("indexed_at").alias("last_indexed"))
    return profiles.join(got, "repo", "left").select("repo", F.coalesce("files", F.lit(0)).alias("files"), "last_indexed")


def class_type_counts(files: DataFrame) -> DataFrame:
    """(repo, type, n) of the classes in each file's JSON; what doesn't parse and classes without a type don't count."""
    parsed = F.from_json("parsed", "classes array<struct<type: string>>")
    rows = files.select("repo", F.explode(parsed["classes"]["type"]).alias("type")).filter("type IS NOT NULL AND type <> ''")
    return rows.groupBy("repo", "type").agg(F.count("*").alias("n"))


def merge_seeds(seeds: DataFrame) -> DataFrame:
    """Seeds of one name as one: the union of their files and of their repositories, sorted."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    return seeds.groupBy("name").agg(union("files"), union("repos"))


def module_queries(paths: DataFrame, most: int = 6, files: int = 10) -> DataFrame:
    """(module, query, n, files): the largest modules of two files at least, named by up to two directories below the first."""
    parts = F.split("path", "/")
    rows = paths.withColumn("parts", parts).filter(F.size("parts") >= 3).withColumn("module", F.array_join(F.slice("parts", F.lit(2), F.least(F.size("parts") - 2, F.lit(2))), "/"))
    large = rows.groupBy("repo", "module").agg(F.countDistinct("path").alias("n")).filter("n >= 2")
    large = retrieval.top(large, most, [F.desc("n"), "module"], "repo")
    first = retrieval.top(rows.join(large.select("repo", "module"), ["repo", "module"]).select("repo", "module", "path", F.concat_ws("/", "repo", "module").alias("g")).distinct(), files, ["path"], "g")
    listed = first.groupBy("repo", "module").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("files"))
    name = F.regexp_replace(F.replace(F.col("module"), F.lit("/"), F.lit(" ")), "[-_]", " ")
    return large.join(listed, ["repo", "module"]).select("repo", "module", F.concat(name, F.lit(" module in "), "repo").alias("query"), "n", "files")


def changed_flows(now: DataFrame, stored: DataFrame) -> DataFrame:
    """Flows (flow, n) whose number of cards is not the stored one, or that are not stored."""
    old = stored.withColumnRenamed("n", "old")
    return now.join(old, "flow", "left").filter("old IS NULL OR old <> n").select("flow", "n", "old")


def session_users(sessions: DataFrame, users: DataFrame, members: DataFrame, now: Column) -> DataFrame:
    """Unexpired sessions with their user and role, `member` without a membership."""
    live = sessions.filter(F.col("expires") > now).join(users, "user_id")
    return live.join(members, "user_id", "left").select("session_id", "user_id", "name", F.coalesce("role", F.lit("member")).alias("role"))


def branch_title(branch: Column) -> Column:
    """A branch's first telling part as words: a ticket or more than eight characters; the whole branch where none is."""
    part = F.coalesce(F.try_element_at(F.filter(F.split(branch, "/"), lambda p: p.rlike(r"^ENG-\d+") | (F.char_length(p) > 8)), F.lit(1)), branch)
    spaced = F.regexp_replace(part, r"^(ENG-\d+)[-/]?", "$1 ")
    # the hyphen inside a ticket goes too, as all others do
    words = F.split(F.regexp_replace(spaced, "[-_]", " "), r"\b(?=\w)")
    return F.trim(F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), ""))


def voted_flow(changes: DataFrame, cards: DataFrame, most: int = 20) -> DataFrame:
    """(pr, flow): the flow that most of a request's first files (pr, place, path, branch) vote for; else its branch as a title."""
    asked = retrieval.top(changes.drop("branch").withColumnRenamed("place", "at"), most, ["at", "path"], "pr").select("pr", "path")
    votes = asked.join(cards.select("path", "flow"), "path").groupBy("pr", "flow").agg(F.count("*").alias("n"))
    best = votes.groupBy("pr").agg(F.min_by("flow", F.struct((-F.col("n")).alias("n"), "flow")).alias("flow"))
    every = changes.groupBy("pr").agg(F.min("branch").alias("branch"))
    return every.join(best, "pr", "left").select("pr", F.coalesce("flow", branch_title(F.col("branch"))).alias("flow"))


def hot_files(files: DataFrame, stale_dirs: list[str], most: int = 8) -> DataFrame:
    """The hottest files of each repository outside stale directories."""
    stale = F.lit(False)
    for d in stale_dirs:
        stale = stale | F.startswith("path", F.lit(d.rstrip("/") + "/"))
    return retrieval.top(files.filter(~stale), most, [F.desc("heat"), "path"], "repo")


def source_priority(kind: Column) -> Column:
    return F.when(kind == "model", 4).when(kind == "controller", 3).when(kind.isin("api", "association"), 2).otherwise(1)


def card_priority(card_type: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for p in CARD_ORDER.items() for x in p))[card_type], F.lit(4))


def changelog(commits: DataFrame) -> DataFrame:
    """(repo, section, n, first_item) of commits (repo, place, message), with whether the repository writes conventional ones."""
    part = lambda k: F.regexp_extract("message", COMMIT, k)
    plain = F.regexp_replace("message", r"^[0-9a-f]{7,} ", "")
    item = F.when(part(1) == "", plain).when(part(3) == "", part(4)).otherwise(F.concat(F.lit("**"), part(3), F.lit("**: "), part(4)))
    section = F.coalesce(F.create_map(*(F.lit(x) for p in SECTIONS.items() for x in p))[part(1)], F.lit("other"))
    rows = commits.select("repo", "place", section.alias("section"), item.alias("item"), (part(1) != "").alias("conventional"))
    whole = rows.groupBy("repo").agg((F.count_if("conventional") >= F.least(F.lit(3), F.ceil(F.count("*") * 0.3))).alias("conventional"))
    return rows.groupBy("repo", "section").agg(F.count("*").alias("n"), F.min_by("item", F.struct("place", "item")).alias("first_item")).join(whole, "repo")


def diff_files(diff: Column) -> Column:
    return F.regexp_extract_all(diff, F.lit(r"(?m)^diff --git a/(.+?) b/"), F.lit(1))


def page_names(content: Column) -> Column:
    """Bold names at the start of bullets, each once, of 2 to 59 characters."""
    found = F.transform(F.regexp_extract_all(content, F.lit(r"(?m)^[-*]\s+\*{1,2}([^*]+)\*{1,2}"), F.lit(1)), F.trim)
    return F.array_distinct(F.filter(found, lambda n: (F.char_length(n) > 1) & (F.char_length(n) < 60)))


def skill_text(asked: DataFrame, registry: DataFrame, between: str = " | ") -> DataFrame:
    """The texts of the skills that each owner names (owner, place, skill), in order; unknown ones drop out."""
    rows = asked.join(registry, "skill").groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("all"))
    return rows.select("owner", F.array_join(F.transform("all", lambda x: x["text"]), between).alias("text"))


def prefixed(queries: DataFrame, profiles: DataFrame, least: float = 0.05) -> DataFrame:
    """Classified queries (id, top_repo, confidence, query) with the stack of their repository before them, where it is sure."""
    prefix = F.concat(F.concat_ws(" ", "language", "frameworks", "repo"), F.lit(": "))
    got = queries.join(profiles.select(F.col("repo_no").alias("top_repo"), prefix.alias("prefix")), "top_repo", "left")
    return got.select("id", F.concat(F.when(F.col("confidence") > least, F.coalesce("prefix", F.lit(""))).otherwise(""), "query").alias("query"))


def route_controllers(routes: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, route): a route's controller file, the first of its repository whose path ends in <controller>_controller.rb.

    A file stands under every controller that its path can end in, its whole name at least, and each controller keeps its first
    file before routes ask, so that neither many routes nor many files of one name meet one by one.
    """
    whole = first_wins(files.filter(F.endswith("path", F.lit("_controller.rb"))).select("repo", "path", "place"), ["repo", "path"], ["place"])
    text = F.left("path", F.length("path") - F.lit(len("_controller.rb")))
    name = F.element_at(F.split("text", "/"), -1)
    ends = F.transform(F.sequence(F.lit(1), F.length("text") - F.length(name) + 1), lambda k: F.substr("text", k))
    held = whole.withColumn("text", text).filter(name != "").select("repo", F.explode(ends).alias("controller"), "path", "place")
    first = first_wins(held, ["repo", "controller"], ["place", "path"])
    hit = routes.withColumnRenamed("path", "src").join(first, ["repo", "controller"])
    return first_wins(hit.select("src", "route", "path", "place"), ["src", "route"], ["place", "path"]).select("src", F.col("path").alias("dst"), "route")


def controller_models(files: DataFrame, classes: DataFrame) -> DataFrame:
    """(src, dst): a controller and the file of the class that its name in the singular stands for; of equal names the last wins."""
    name = F.regexp_extract("path", r"(\w+)_controller\.rb$", 1)
    asked = files.withColumn("stem", name).filter("stem <> ''").select(F.col("path").alias("src"), pascal(singular(F.col("stem"))).alias("name"))
    last = classes.groupBy("name").agg(F.max_by("path", F.struct("place", "path")).alias("dst"))
    return asked.join(last, "name").filter("src <> dst").select("src", "dst")


# -- registered queries --------------------------------------------------------------------------------------------------


def _typed(s, d):
    kinds = F.create_map(*(F.lit(x) for x in ("en", "flow", "fr", "hub", "de", "cross_service", "es", "model")))
    return cards_of(table(s, d, "documents")).select("id", "flow", kinds[F.col("card_type")].alias("card_type"), "stale")


def _lines(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(_paths(s, d), F.col("l_partkey") == F.col("p_partkey"))


def _rules(s, d):
    return table(s, d, "nation").select(F.col("n_nationkey").alias("id"), _pick([*SCOPES, None, "cobol"], F.col("n_nationkey") % 12).alias("scope"))


def _commits(s, d):
    kind = _pick(["feat", "fix(core)", "docs", "ci", "perf(io)", "merge"], F.col("o_orderkey") % 6)
    message = F.concat(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 8), F.lit(" "), kind, F.lit(": order "), F.col("o_orderkey").cast("string"))
    return table(s, d, "orders").select((F.col("o_custkey") % 97).alias("repo"), F.col("o_orderkey").alias("place"), message.alias("message"))


def _controllers(s, d):
    stem = F.concat(F.replace(F.substring_index("p_name", " ", 1), F.lit("-"), F.lit("_")), F.lit("s"))
    return table(s, d, "part").select(F.col("p_partkey").alias("place"), "p_brand", stem.alias("stem"), (F.col("p_partkey") % 7).alias("repo"))


_ORDER_FILES = lambda s, d: _lines(s, d).select(F.col("l_orderkey").alias("pr"), F.col("l_linenumber").alias("place"), "path", F.concat(F.lit("me/ENG-"), F.col("l_orderkey").cast("string"), F.lit("-tidy_up")).alias("branch"))

QUERIES = {
    "card_filters": lambda s, d: filtered(cards_of(table(s, d, "documents")), stale=False, without=["es"]).select("id", "flow", "card_type"),
    "prefix_match": lambda s, d: table(s, d, "part").filter(F.startswith("p_type", F.lit("S"))).select("p_partkey", "p_type"),
    "branch_visible": lambda s, d: visible(retrieval.knn(retrieval._asked(s, d).drop("label"), retrieval._vectors(s, d).drop("label"), 15), retrieval._vectors(s, d).select("id", F.when(F.col("id") % 3 > 0, F.array(F.concat(F.lit("b"), (F.col("id") % 3).cast("string")))).alias("valid_branches")), "b1", 5),
    "rules_scope": lambda s, d: rules_for(_rules(s, d), _lines(s, d).select(F.col("l_orderkey").alias("diff"), "path")).groupBy("rule").agg(F.count("*").alias("diffs")),
    "rule_verdicts": lambda s, d: verdicts(table(s, d, "orders").select(F.col("o_custkey").alias("diff"), F.when(F.col("o_orderpriority") == "1-URGENT", "error").when(F.col("o_orderpriority") == "2-HIGH", "warning").alias("severity"))),
    "repo_summary": lambda s, d: repo_summary(table(s, d, "customer").select(F.col("c_custkey").alias("repo")), table(s, d, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("indexed_at"))),
    "orphan_branches": lambda s, d: table(s, d, "customer").select("c_nationkey", "c_mktsegment").distinct().join(table(s, d, "customer").filter("c_acctbal > 9500").select("c_nationkey", "c_mktsegment"), ["c_nationkey", "c_mktsegment"], "left_anti"),
    "class_type_counts": lambda s, d: class_type_counts(table(s, d, "events").select((F.col("user_id") % 10).alias("repo"), F.when(F.col("event_id") % 11 == 0, "{broken").otherwise(F.concat(F.lit('{"classes":[{"type":"'), "event_type", F.lit('"},{"name":"x"},{"type":"model"}]}'))).alias("parsed"))),
    "merge_seeds": lambda s, d: merge_seeds(cards_of(table(s, d, "documents")).select(F.col("flow").alias("name"), F.col("source_files").alias("files"), F.col("source_repos").alias("repos"))).select("name", F.array_join("files", ",").alias("files"), F.array_join("repos", ",").alias("repos")),
    "module_queries": lambda s, d: module_queries(_paths(s, d).select(F.lit("shop").alias("repo"), F.concat(F.lit("shop/"), "path").alias("path"))),
    "changed_flows": lambda s, d: changed_flows(table(s, d, "documents").groupBy(F.col("source").alias("flow")).agg(F.count("*").alias("n")), table(s, d, "documents").join(table(s, d, "labels").select("doc_id"), "doc_id").groupBy(F.col("source").alias("flow")).agg(F.count("*").alias("n"))),
    "session_users": lambda s, d: session_users(table(s, d, "events").select(F.col("event_id").alias("session_id"), "user_id", F.col("ts").alias("expires")), table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name")), table(s, d, "supplier").select(F.col("s_suppkey").alias("user_id"), F.when(F.col("s_nationkey") < 5, "admin").otherwise("editor").alias("role")), F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00"))),
    "branch_titles": lambda s, d: table(s, d, "orders").select("o_orderkey", branch_title(F.concat(F.lit("me/"), F.when(F.col("o_orderkey") % 3 == 0, "ENG-").when(F.col("o_orderkey") % 3 == 1, "long_enough-").otherwise(""), (F.col("o_orderkey") % 1000).cast("string"), F.lit("-fix_it"))).alias("title")),
    "pr_vote": lambda s, d: voted_flow(_ORDER_FILES(s, d), _paths(s, d).join(table(s, d, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey").filter("p_size % 4 = 0").select("path", F.col("p_brand").alias("flow")).distinct()),
    "hot_files": lambda s, d: _hot(s, d),
    "source_priority": lambda s, d: retrieval.top(table(s, d, "part").select(F.col("p_brand").alias("repo"), F.col("p_partkey").alias("id"), source_priority(_pick(["model", "controller", "api", "association", "view"], F.col("p_size") % 5)).alias("score")), 6, [F.desc("score"), "id"], "repo"),
    "card_priority": lambda s, d: retrieval.top(_typed(s, d).select("id", "flow", "card_type", card_priority(F.col("card_type")).alias("priority")), 10, ["priority", "id"], "flow"),
    "changelog": lambda s, d: changelog(_commits(s, d)),
    "diff_files": lambda s, d: _lines(s, d).groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("diff --git a/"), "path", F.lit(" b/x\n+ a b/")))), "\n").alias("diff")).select("l_orderkey", F.array_join(diff_files(F.col("diff")), ",").alias("files")),
    "page_names": lambda s, d: table(s, d, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.when(F.col("p_partkey") % 2 == 0, "- **").otherwise("x **"), "p_name", F.lit("** - page")))), "\n").alias("content")).select("p_brand", F.array_join(F.array_sort(page_names(F.col("content"))), ",").alias("names")),
    "skill_text": lambda s, d: skill_text(table(s, d, "customer").select(F.col("c_custkey").alias("owner"), F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: ((F.col("c_custkey") + 7 * k) % 30).cast("int"))).alias("place", "skill")), table(s, d, "nation").select(F.col("n_nationkey").cast("int").alias("skill"), F.col("n_name").alias("text"))),
    "query_prefix": lambda s, d: prefixed(retrieval.classify(retrieval._asked(s, d), retrieval._vectors(s, d)).withColumn("query", F.col("id").cast("string")), table(s, d, "nation").select(F.col("n_nationkey").alias("repo_no"), F.lit("ruby").alias("language"), F.lit("rails").alias("frameworks"), F.col("n_name").alias("repo"))),
    "interactions": lambda s, d: cards_of(table(s, d, "documents")).select("id", F.posexplode("source_files").alias("place", "card")),
    "memory_patches": lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("saved"), F.floor(F.count("*") / 10).alias("patches")),
    "route_controllers": lambda s, d: route_controllers(_controllers(s, d).select("repo", F.concat(F.lit("config/routes"), F.col("place").cast("string")).alias("path"), F.concat(F.lit("admin/"), "stem").alias("controller"), F.col("place").alias("route")), _controllers(s, d).select("repo", "place", F.concat(F.when(F.col("place") % 2 == 0, "app/admin/").otherwise("app/"), "stem", F.lit("_controller.rb")).alias("path"))),
    "controller_models": lambda s, d: controller_models(_controllers(s, d).select(F.concat(F.lit("app/"), F.col("place").cast("string"), F.lit("/"), "stem", F.lit("_controller.rb")).alias("path")), _controllers(s, d).select(F.initcap(F.regexp_replace("stem", "s$", "")).alias("name"), "place", F.concat(F.lit("app/models/"), F.col("place").cast("string")).alias("path"))),
}


def _hot(s, d):
    part = table(s, d, "part").select("p_partkey", F.col("p_brand").alias("repo"), F.col("p_retailprice").alias("heat"))
    return hot_files(_paths(s, d).join(part, "p_partkey"), ["config/locales", "db"])


_END = "lower(regexp_extract(path, '(\\.[^./]+)$', 1))"
_SCOPE = "[" + ", ".join([*(f"'{k}'" for k in SCOPES), "NULL", "'cobol'"]) + "]"
_EXT = "(VALUES " + ", ".join(f"('{k}', '{e}')" for k, v in SCOPES.items() for e in v) + ") AS x(scope, ending)"
_STEM = "c AS (SELECT p_partkey AS place, replace(split_part(p_name, ' ', 1), '-', '_') || 's' AS stem, p_partkey % 7 AS repo FROM part)"
SQL = {
    "card_filters": "SELECT doc_id AS id, source AS flow, lang AS card_type FROM documents WHERE n_chars % 2 = 0 AND lang NOT IN ('es')",
    "prefix_match": "SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'S')",
    "branch_visible": f"WITH {retrieval._V}, {retrieval._NEAR.format(d=retrieval._COS, where='q.id % 20 = 0', k=15)} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) - 1 AS place FROM near WHERE id % 3 IN (0, 1) QUALIFY place < 5",
    "rules_scope": f"WITH {_PATHS}, r AS (SELECT n_nationkey AS rule, {_SCOPE}[n_nationkey % 12 + 1] AS scope FROM nation), l AS (SELECT DISTINCT l_orderkey AS diff, {_END} AS ending FROM lineitem JOIN p ON l_partkey = p_partkey) SELECT rule, count(*) AS diffs FROM (SELECT DISTINCT rule, diff FROM r JOIN {_EXT} USING (scope) JOIN l USING (ending) UNION SELECT DISTINCT rule, diff FROM r, l WHERE scope IS NULL OR scope = 'cobol') GROUP BY 1",
    "rule_verdicts": "SELECT o_custkey AS diff, count(*) FILTER (o_orderpriority = '1-URGENT') = 0 AS passed, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) = 0 AS strict_passed FROM orders GROUP BY 1",
    "repo_summary": "SELECT c_custkey AS repo, count(o_orderkey) AS files, max(o_orderdate) AS last_indexed FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    "orphan_branches": "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE (c_nationkey, c_mktsegment) NOT IN (SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 9500)",
    "class_type_counts": "SELECT repo, type, count(*) AS n FROM (SELECT user_id % 10 AS repo, unnest([event_type, 'model']) AS type FROM events WHERE event_id % 11 <> 0) GROUP BY 1, 2",
    "merge_seeds": "WITH c AS (SELECT source AS name, unnest([source || '/' || lang || '/f' || (n_chars % 7), source || '/g' || (n_chars % 11)]) AS f, unnest([source, 'repo' || (n_chars % 5)]) AS r FROM documents) SELECT name, array_to_string(list_sort(list(DISTINCT f)), ',') AS files, array_to_string(list_sort(list(DISTINCT r)), ',') AS repos FROM c GROUP BY 1",
    "module_queries": f"WITH {_PATHS}, q AS (SELECT DISTINCT 'shop/' || path AS path FROM p), m AS (SELECT path, array_to_string(string_split(path, '/')[2:2 + least(len(string_split(path, '/')) - 2, 2) - 1], '/') AS module FROM q WHERE len(string_split(path, '/')) >= 3), g AS (SELECT module, count(*) AS n FROM m GROUP BY 1 HAVING n >= 2 ORDER BY n DESC, module LIMIT 6), f AS (SELECT module, path FROM m QUALIFY row_number() OVER (PARTITION BY module ORDER BY path) <= 10) SELECT 'shop' AS repo, module, replace(replace(replace(module, '/', ' '), '-', ' '), '_', ' ') || ' module in shop' AS query, n, (SELECT string_agg(path, ',' ORDER BY path) FROM f WHERE f.module = g.module) AS files FROM g",
    "changed_flows": "WITH a AS (SELECT source AS flow, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT source AS flow, count(*) AS old FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT flow, n, old FROM a LEFT JOIN b USING (flow) WHERE old IS NULL OR old <> n",
    "session_users": "SELECT event_id AS session_id, c_custkey AS user_id, c_name AS name, CASE WHEN s_suppkey IS NULL THEN 'member' WHEN s_nationkey < 5 THEN 'admin' ELSE 'editor' END AS role FROM events JOIN customer ON user_id = c_custkey LEFT JOIN supplier ON s_suppkey = c_custkey WHERE ts > TIMESTAMP '2024-01-20'",
    "branch_titles": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'ENG ' || (o_orderkey % 1000) || ' Fix It' WHEN 1 THEN 'Long Enough ' || (o_orderkey % 1000) || ' Fix It' ELSE CASE WHEN length((o_orderkey % 1000)::VARCHAR) > 1 THEN (o_orderkey % 1000) || ' Fix It' ELSE 'Me/' || (o_orderkey % 1000) || ' Fix It' END END AS title FROM orders",
    "pr_vote": f"WITH {_PATHS}, k AS (SELECT DISTINCT path, p_brand AS flow FROM p JOIN part USING (p_partkey) WHERE p_size % 4 = 0), v AS (SELECT l_orderkey AS pr, flow, count(*) AS n FROM lineitem JOIN p ON l_partkey = p_partkey JOIN k USING (path) GROUP BY 1, 2), b AS (SELECT pr, flow FROM v QUALIFY row_number() OVER (PARTITION BY pr ORDER BY n DESC, flow) = 1) SELECT pr, coalesce(flow, 'ENG ' || pr || ' Tidy Up') AS flow FROM (SELECT DISTINCT l_orderkey AS pr FROM lineitem) LEFT JOIN b USING (pr)",
    "hot_files": f"WITH {_PATHS} SELECT p_brand AS repo, p_partkey, path, p_retailprice AS heat, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, path) - 1 AS place FROM p JOIN part USING (p_partkey) WHERE path NOT LIKE 'config/locales/%' AND path NOT LIKE 'db/%' QUALIFY place < 8",
    "source_priority": "SELECT p_brand AS repo, p_partkey AS id, [4, 3, 2, 2, 1][p_size % 5 + 1] AS score, row_number() OVER (PARTITION BY p_brand ORDER BY [4, 3, 2, 2, 1][p_size % 5 + 1] DESC, p_partkey) - 1 AS place FROM part QUALIFY place < 6",
    "card_priority": "WITH t AS (SELECT doc_id AS id, source AS flow, CASE lang WHEN 'en' THEN 'flow' WHEN 'fr' THEN 'hub' WHEN 'de' THEN 'cross_service' WHEN 'es' THEN 'model' END AS card_type, CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 3 WHEN 'de' THEN 2 WHEN 'es' THEN 0 ELSE 4 END AS priority FROM documents) SELECT *, row_number() OVER (PARTITION BY flow ORDER BY priority, id) - 1 AS place FROM t QUALIFY place < 10",
    "changelog": "WITH c AS (SELECT o_custkey % 97 AS repo, o_orderkey AS k, 'order ' || o_orderkey AS t FROM orders), r AS (SELECT repo, k, ['feat', 'fix', 'docs', 'chore', 'other', 'other'][k % 6 + 1] AS section, CASE k % 6 WHEN 1 THEN '**core**: ' || t WHEN 4 THEN '**io**: ' || t WHEN 5 THEN 'merge: ' || t ELSE t END AS item, k % 6 <> 5 AS conv FROM c), w AS (SELECT repo, count(*) FILTER (conv) >= least(3, ceil(count(*) * 0.3::DOUBLE)) AS conventional FROM r GROUP BY 1) SELECT repo, section, count(*) AS n, arg_min(item, k) AS first_item, any_value(conventional) AS conventional FROM r JOIN w USING (repo) GROUP BY 1, 2",
    "diff_files": f"WITH {_PATHS} SELECT l_orderkey, string_agg(path, ',' ORDER BY 'diff --git a/' || path || ' b/x') AS files FROM lineitem JOIN p ON l_partkey = p_partkey GROUP BY 1",
    "page_names": "SELECT p_brand, coalesce(string_agg(DISTINCT p_name, ',' ORDER BY p_name) FILTER (p_partkey % 2 = 0 AND length(p_name) BETWEEN 2 AND 59), '') AS names FROM part GROUP BY 1",
    "skill_text": "WITH a AS (SELECT c_custkey AS owner, unnest([1, 2, 3]) AS k FROM customer) SELECT owner, string_agg(n_name, ' | ' ORDER BY k) AS text FROM a JOIN nation ON n_nationkey = (owner + 7 * k) % 30 GROUP BY 1",
    "query_prefix": f"WITH {retrieval._V}, {retrieval._CEN}, s AS (SELECT id, cn.label AS l, round(list_cosine_similarity(e, c), 6) AS sim FROM v JOIN cn ON true WHERE id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, l) AS k, lead(sim) OVER (PARTITION BY id ORDER BY sim DESC, l) AS nxt FROM s) SELECT id, CASE WHEN round(sim - nxt, 6) > 0.05 THEN 'ruby rails ' || n_name || ': ' ELSE '' END || id AS query FROM r JOIN nation ON n_nationkey = l WHERE k = 1",
    "interactions": "SELECT doc_id AS id, unnest([0, 1]) AS place, unnest([source || '/' || lang || '/f' || (n_chars % 7), source || '/g' || (n_chars % 11)]) AS card FROM documents",
    "memory_patches": "SELECT user_id, count(*) AS saved, count(*) // 10 AS patches FROM events GROUP BY 1",
    "route_controllers": f"WITH {_STEM} SELECT 'config/routes' || a.place AS src, 'app/admin/' || a.stem || '_controller.rb' AS dst, a.place AS route FROM c a WHERE EXISTS (FROM c b WHERE b.repo = a.repo AND b.stem = a.stem AND b.place % 2 = 0)",
    "controller_models": f"WITH {_STEM}, m AS (SELECT stem, max(place) AS place FROM c GROUP BY 1) SELECT 'app/' || c.place || '/' || stem || '_controller.rb' AS src, 'app/models/' || m.place AS dst FROM c JOIN m USING (stem)",
}
