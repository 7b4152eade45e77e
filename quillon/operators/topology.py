"""Edges and flows from names: associations, interface calls, stores, component seeds, hubs and community names.

Names meet by equality of derived keys (endings, beginnings or pieces of a name, as long as the name at most), never by
comparing all pairs, so every join is an equi-join that Spark shuffles or broadcasts by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import basename, pascal, singular, snake, stem
from quillon.operators.graph import RELATION_WEIGHT, resolve_imports, trade
from quillon.operators.relational import first_wins
from quillon.plans.ranks import numbered
from quillon.session import table

# Directories under which components lie, directories that name no component, names that say nothing, usual actions
MARKERS = ("/components/", "/pages/", "/views/", "/features/", "/screens/")
UTILITY = (
    "common forms shared utils utilities helpers layout router routing hooks context config assets icons images styles types constants "
    "lib hoc wrappers providers loading errors modals usecase"
).split()
GENERIC = "common api shared utils util helpers helper base main index v1 v2 v3 v4".split()
USUAL = "index show create update destroy new edit initialize".split()
# Directories whose next segment names a flow, in order
SEGMENTS = ("api", "controllers", "models", "components", "stores", "slices")
# Back-end paths of a resource in the plural {p} or singular {s}; the last two are beginnings
PLACES = (
    "models/{s}.rb", "models/{p}.rb", "controllers/{p}_controller.rb", "controllers/{s}_controller.rb", "controllers/{p}/",
    "serializers/{s}_serializer.rb", "policies/{s}_policy.rb", "services/{p}", "presenters/{s}",
)


def _heads(text: Column) -> Column:
    """Every beginning of a text, shortest first."""
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda k: F.left(text, k))).otherwise(F.array().cast("array<string>"))


def _tails(text: Column) -> Column:
    """Every ending of a text, longest first."""
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda k: F.substr(text, k))).otherwise(F.array().cast("array<string>"))


def _pieces(text: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(_tails(text), _heads)))


def _found(path: Column, pattern: str) -> Column:
    return F.regexp_extract_all(path, F.lit(pattern), F.lit(0))


def association_edges(associations: DataFrame, classes: DataFrame) -> DataFrame:
    """(src, dst, target, weight) of associations (path, kind, name, target_model) to the file of the class they name.

    Without a target_model the class is the name in Pascal case, in the singular for kinds that hold many. Of classes (name,
    path, role, place) with one name the last counts. Shared utilities weigh a fifth; tests and the file itself are no targets.
    """
    many = F.col("kind").isin("has_many", "has_and_belongs_to_many")
    target = F.coalesce("target_model", pascal(F.when(many, singular(F.col("name"))).otherwise(F.col("name"))))
    last = classes.groupBy(F.col("name").alias("target")).agg(F.max_by(F.struct("path", "role"), F.struct("place", "path")).alias("to"))
    rows = associations.select(F.col("path").alias("src"), target.alias("target")).join(last, "target").filter("src <> to.path AND NOT (to.role <=> 'test')")
    weight = RELATION_WEIGHT["model_association"] * F.when(F.col("to.role") == "shared_utility", 0.2).otherwise(1.0)
    return rows.select("src", F.col("to.path").alias("dst"), "target", weight.alias("weight")).distinct()


def api_edges(clients: DataFrame, backend: DataFrame, routes: DataFrame) -> DataFrame:
    """(src, dst): client files (path, repo) and the back-end files (path, repo) of other repositories that serve them.

    A client's name in snake case ends a controller's name, is a directory under controllers, or is a route's controller or
    begins a segment of the route's path (routes: path of the file, repo, controller, route).
    """
    low = F.lower("path")
    named = backend.select("path", "repo", F.explode(_tails(F.regexp_extract(low, r"([^/]*)_controller\.rb$", 1))).alias("key"))
    nested = backend.select("path", "repo", F.explode(_found(low, "(?<=/controllers/)[^/]+(?=/)")).alias("key"))
    begun = F.flatten(F.transform(_found(F.col("route"), "(?<=/)[^/]+"), _heads))
    routed = routes.select("path", "repo", F.explode(F.array_append(begun, F.col("controller"))).alias("key"))
    keys = named.union(nested).union(routed).distinct().withColumnRenamed("path", "dst").withColumnRenamed("repo", "there")
    asked = clients.select(F.col("path").alias("src"), "repo", F.replace(stem(F.col("path")), F.lit("-"), F.lit("_")).alias("key"))
    return asked.join(keys, "key").filter("repo <> there").select("src", "dst").distinct()


def resource_edges(files: DataFrame, imports: DataFrame, backend: DataFrame) -> DataFrame:
    """(src, dst, slug): front-end files (path, repo) and models or controllers of other repositories for the resources they name.

    Slugs are the component directory of a file and the last segment of imports (path, source) of an api, service or client.
    """
    folder = files.select("path", "repo", F.regexp_extract("path", "/components/([^/]+)/", 1).alias("word"))
    last = F.regexp_replace(F.regexp_replace("source", ".*/", ""), r"\.[^.]+$", "")
    called = imports.filter(F.lower("source").rlike("api|service|client")).select("path", last.alias("word")).join(files.select("path", "repo"), "path").select("path", "repo", "word")
    slugs = folder.union(called).select(F.col("path").alias("src"), "repo", snake(F.col("word")).alias("slug")).filter("length(slug) > 2").distinct()
    s = F.col("slug")
    keys = F.array(F.concat(F.lit("/"), singular(s), F.lit(".rb")), F.concat(F.lit("/"), s, F.lit("_controller.rb")), F.concat(F.lit("/controllers/"), s, F.lit("/")))
    low = F.lower("path")
    held = F.concat(_found(low, r"/[^/]+\.rb$"), _found(low, "(?<=/controllers)/[^/]+/"))
    held = F.transform(held, lambda x: F.when(F.endswith(x, F.lit("/")), F.concat(F.lit("/controllers"), x)).otherwise(x))
    there = backend.filter("contains(path, '/models/') OR contains(path, '/controllers/')").select(F.col("path").alias("dst"), F.col("repo").alias("there"), F.explode(held).alias("key"))
    return slugs.select("src", "repo", "slug", F.explode(keys).alias("key")).join(there, "key").filter("repo <> there").select("src", "dst", "slug").distinct()


def store_edges(imports: DataFrame, known: DataFrame) -> DataFrame:
    """(src, dst): a store's imports (path, target) of an api, resolved among known paths."""
    asked = imports.filter(F.lower("path").contains("store") & F.lower("target").contains("api"))
    return resolve_imports(asked, known).filter("file <> path").select(F.col("path").alias("src"), F.col("file").alias("dst")).distinct()


def component_dir(path: Column) -> Column:
    """The directories below the first marker that has any, up to a utility, a dotted or an empty one; else null."""
    found = []
    for marker in MARKERS:
        parts = F.split(F.substr(path, F.locate(marker, path) + F.lit(len(marker))), "/")
        parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
        bad = F.array_position(F.transform(parts, lambda p: (p == "") | F.contains(p, F.lit(".")) | F.lower(p).isin(UTILITY)), True)
        kept = F.when(bad > 0, F.slice(parts, F.lit(1), (bad - 1).cast("int"))).otherwise(parts)
        found.append(F.when((F.locate(marker, path) > 0) & (F.size(kept) > 0), F.array_join(kept, "/")))
    return F.coalesce(*found)


def component_seeds(front: DataFrame, back: DataFrame) -> DataFrame:
    """(flow, path, repo): front-end files by their component directory, with the back-end files of that resource.

    The flow's name is the last directory with blanks before capitals; directories of one name are one flow. Keys are joined by
    sorting: a plan takes a table of keys for as small as the paths that they are made of, and would broadcast it through the driver.
    """
    seeds = front.withColumn("dir", component_dir(F.col("path"))).filter("dir IS NOT NULL").withColumn("leaf", basename(F.col("dir")))
    seeds = seeds.withColumn("flow", F.trim(F.regexp_replace("leaf", "([A-Z])", " $1")))
    plural = F.lower(F.regexp_replace(F.regexp_replace("leaf", "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))
    names = seeds.select("flow", plural.alias("p")).distinct().withColumn("s", singular(F.col("p"), "routes"))
    fill = lambda t, p, s: F.concat(*(p if x == "{p}" else s if x == "{s}" else F.lit(x) for x in t.replace("{", "\0{").replace("}", "}\0").split("\0") if x))
    asked = F.array(*(fill(t, F.col("p"), F.col("s")) for t in PLACES))
    p2, s2 = F.concat(F.lit("in_"), F.col("p")), singular(F.concat(F.lit("in_"), F.col("p")), "routes")
    office = F.array(*(fill(t, p2, s2) for t in (PLACES[0], PLACES[2], PLACES[3])))
    asked = F.when(F.startswith("p", F.lit("office_")), F.concat(asked, office)).otherwise(asked)
    path = F.col("path")
    whole = [_found(path, t) for t in (r"models/[^/]+\.rb", r"controllers/[^/]+_controller\.rb", "controllers/[^/]+/", r"serializers/[^/]+_serializer\.rb", r"policies/[^/]+_policy\.rb")]
    below = lambda d: F.transform(F.flatten(F.transform(_found(path, f"(?<={d}/)[^/]+"), _heads)), lambda h: F.concat(F.lit(d + "/"), h))
    begun = [below("services"), below("presenters")]
    held = back.select("path", "repo", F.explode(F.array_distinct(F.concat(*whole, *begun))).alias("key"))
    hit = names.select("flow", F.explode(asked).alias("key")).distinct().join(held.hint("merge"), "key").select("flow", "path", "repo")
    return seeds.select("flow", "path", "repo").union(hit).distinct()


def absorbed_hubs(hubs: DataFrame, seeds: DataFrame, members: DataFrame) -> DataFrame:
    """(path, flow): the first seed (flow, place) whose name holds a hub's (path, name) or lies in it and which has not its file yet.

    Names meet once, however many hubs bear them: the seeds of a name are numbered, and a file takes the first number that none of
    its flows has. That is 0 or follows one of theirs, so a file asks for one seed more than it has flows.
    """
    seed = first_wins(seeds.select("flow", "place", F.regexp_replace(F.lower("flow"), r"\s+", "_").alias("seed")), ["flow"], ["place"])
    hub = hubs.select("path", snake(F.col("name")).alias("hub")).distinct()
    names, words = hub.select("hub").distinct(), seed.select("seed").distinct()
    inside = words.withColumn("hub", F.explode(_pieces(F.col("seed")))).join(names, "hub").select("hub", "seed")
    around = names.withColumn("seed", F.explode(_pieces(F.col("hub")))).join(words, "seed").select("hub", "seed")
    hits = numbered(inside.union(around).distinct().join(seed, "seed").select("hub", "flow", "place"), "hub", ["place", "flow"], "turn")
    held = hub.join(members.select("path", "flow").distinct(), "path").join(hits.select("hub", "flow", "turn"), ["hub", "flow"]).select("path", "hub", "turn")
    open_ = hub.withColumn("turn", F.lit(0).cast("long")).union(held.withColumn("turn", F.col("turn") + 1)).join(held, ["path", "hub", "turn"], "left_anti")
    return first_wins(open_.join(hits, ["hub", "turn"]).select("path", "flow", "place"), ["path"], ["place", "flow"]).select("path", "flow")


def hub_flows(hubs: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """(hub, flow): the flows with a file at an edge of a hub (hub, path); members: flow, path of flows that are no hubs."""
    ends = edges.select("src", "dst").union(edges.select("dst", "src")).toDF("path", "far")
    near = ends.join(hubs, "path")
    files = near.select("hub", F.col("far").alias("path")).union(near.select("hub", "path")).distinct()
    return files.join(members, "path").select("hub", "flow").distinct()


def path_segments(members: DataFrame) -> DataFrame:
    """(flow, segment, n): the most frequent segment behind one of SEGMENTS in a flow's (flow, place, path); of equal ones the first met."""
    tries = F.array(*(F.regexp_extract("path", f"/{s}/([^/]+)", 1) for s in SEGMENTS))
    rows = members.select("flow", "place", F.posexplode(tries).alias("k", "raw")).filter("raw <> ''")
    name = F.regexp_replace(F.replace(F.regexp_replace("raw", r"\.[^.]+$", ""), F.lit("-"), F.lit("_")), "_controller$", "")
    counts = rows.groupBy("flow", name.alias("segment")).agg(F.count("*").alias("n"), F.min(F.struct("place", "k")).alias("met"))
    return first_wins(counts.withColumn("less", -F.col("n")), ["flow"], ["less", "met"]).filter("segment <> ''").select("flow", "segment", "n")


def community_names(members: DataFrame, files: DataFrame, functions: DataFrame) -> DataFrame:
    """(flow, name) of communities (flow, place, path): their dominant model, else a telling segment, an unusual public action,
    a class, any segment, or the first file's name.

    files: path, language, class_name, associations. functions: path, turn, name, visibility.
    """
    rows = members.join(files, "path", "left")
    ruby = (F.col("language") == "ruby") & F.col("class_name").isNotNull()
    of = rows.groupBy("flow").agg(
        F.max_by(F.when(ruby & (F.col("associations") > 0), F.col("class_name")), F.when(ruby & (F.col("associations") > 0), F.struct("associations", -F.col("place")))).alias("model"),
        F.min_by(F.when(ruby, F.col("class_name")), F.when(ruby, F.col("place"))).alias("class"),
        F.min_by("path", "place").alias("first"),
    )
    odd = functions.filter((F.col("visibility") == "public") & ~F.col("name").isin(USUAL))
    acts = members.join(odd, "path").groupBy("flow").agg(F.min_by("name", F.struct("place", "turn")).alias("action"))
    got = of.join(path_segments(members).select("flow", "segment"), "flow", "left").join(acts, "flow", "left")
    generic = F.regexp_replace(F.lower("segment"), r"^(.+?)_\d+$", "$1").isin(GENERIC) | F.lower("segment").isin(GENERIC)
    last = F.replace(F.regexp_replace(basename(F.col("first")), r"\.[^.]+$", ""), F.lit("-"), F.lit("_"))
    return got.select("flow", F.coalesce(snake(F.col("model")), F.when(~generic, F.col("segment")), "action", snake(F.col("class")), "segment", last).alias("name"))


def identifier_lines(identifiers: Column) -> Column:
    """Up to twenty class and hook names and five routes among identifiers, as the lines that end a card; empty without any."""
    tokens = F.split(identifiers, r"\s+")
    names = F.slice(F.filter(tokens, lambda t: t.rlike("^[A-Z][a-zA-Z0-9]|^use[A-Z]")), 1, 20)
    after = F.transform(tokens, lambda t, k: F.when(t.rlike("^(GET|POST|PUT|PATCH|DELETE|HEAD)$"), F.concat(t, F.lit(" "), F.nullif(F.get(tokens, k + 1), F.lit("")))))
    routes = F.slice(F.array_compact(after), 1, 5)
    line = lambda title, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"\n**{title}:** "), F.array_join(xs, ", "))).otherwise("")
    some = (F.size(names) > 0) | (F.size(routes) > 0)
    return F.when(some, F.concat(F.lit("\n## Code identifiers"), line("Classes & hooks", names), line("Routes", routes))).otherwise("")


def _titled(words: Column) -> Column:
    parts = F.filter(F.split(words, " "), lambda w: w != "")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))), " ")


def front_label(filename: Column) -> Column:
    """A front-end file's name as words in title case, without its ending, hook prefix and leading underscores."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(filename, r"\.[^.]+$", ""), "^use(?=[A-Z])", ""), "^_+", "")
    name = F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.coalesce(F.nullif(_titled(F.translate(name, "_-", "  ")), F.lit("")), filename)


def back_label(filename: Column, class_name: Column) -> Column:
    """A class's name as words without its role, or without a class the file's name in title case."""
    plain = class_name
    for role in ("Controller", "Policy", "Serializer", "Service"):
        plain = F.regexp_replace(plain, role + "$", "")
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2"))
    name = F.regexp_replace(F.regexp_replace(filename, r"\.rb$", ""), r"\.[^.]+$", "")
    for role in ("controller", "policy", "serializer"):
        name = F.regexp_replace(name, f"_{role}$", "")
    words = F.coalesce(F.nullif(_titled(F.translate(name, "_-", "  ")), F.lit("")), filename)
    return F.when(F.length(class_name) > 0, plain).otherwise(words)


# -- registered queries --------------------------------------------------------------------------------------------------


def _parts(s, d):
    """Parts as resources: forty neighbours share a name."""
    k = F.col("p_partkey")
    return table(s, d, "part").select(k.alias("k"), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.floor(k / 40).cast("string")).alias("one"), "p_size")


def _text(*xs) -> Column:
    return F.concat(*(x if isinstance(x, Column) else F.col(x).cast("string") if x in ("k", "one") else F.lit(x) for x in xs))


def _front(s, d):
    folder = F.when(F.col("k") % 5 == 0, "/views/").otherwise("/components/")
    return _parts(s, d).select(_text("web/src", folder, pascal(F.col("one")), "s/", "k", ".tsx").alias("path"), F.when(F.col("k") % 7 == 0, "core").otherwise("web").alias("repo"))


def _back(s, d):
    forms = [("app/models/", "one", ".rb"), ("app/controllers/", "one", "s_controller.rb"), ("app/controllers/", "one", "s/", "k", "_controller.rb"), ("app/controllers/old_", "one", "s_controller.rb"), ("app/services/", "one", "s_sync.rb")]
    path = F.element_at(F.array(*(_text(*f) for f in forms)), (F.col("k") % 5 + 1).cast("int"))
    return _parts(s, d).select(path.alias("path"), F.lit("core").alias("repo")).distinct()


def _clients(s, d):
    return _parts(s, d).select(_text("web/src/api/", F.replace("one", F.lit("_"), F.lit("-")), "s.ts").alias("path"), F.lit("web").alias("repo")).distinct()


def _routes(s, d):
    rows = _parts(s, d).filter("k % 6 = 0")
    return rows.select(_text("config/routes/", "k", ".rb").alias("path"), F.lit("core").alias("repo"), F.lit("none").alias("controller"), _text("/v1/", "one", "s/:id").alias("route"))


def _associations(s, d):
    kind = F.when(F.col("k") % 2 == 0, "has_many").otherwise("belongs_to")
    name = F.when(F.col("k") % 2 == 0, _text("one", "s")).otherwise(F.col("one"))
    return _parts(s, d).select(_text("app/models/m", "k", ".rb").alias("path"), kind.alias("kind"), name.alias("name"), F.when(F.col("k") % 11 == 0, F.lit("Absent")).alias("target_model"))


def _classes(s, d):
    role = F.when(F.col("k") % 4 == 0, "shared_utility").when(F.col("k") % 9 == 0, "test").otherwise("domain")
    return _parts(s, d).select(pascal(F.col("one")).alias("name"), _text("app/models/m", "k", ".rb").alias("path"), role.alias("role"), F.col("k").alias("place"))


def _stores(s, d):
    where = F.when(F.col("k") % 2 == 0, "web/src/stores/").otherwise("web/src/pages/")
    return _parts(s, d).select(_text(where, "k", ".ts").alias("path"), _text("../api/", F.replace("one", F.lit("_"), F.lit("-")), "s").alias("target"))


def _seeds(s, d):
    words = table(s, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("place"))
    return words.select(F.initcap("p_name").alias("flow"), "place")


def _hubs(s, d):
    rows = table(s, d, "part")
    name = F.when(F.col("p_partkey") % 2 == 0, F.substring_index("p_name", " ", 1)).otherwise(F.concat(F.lit("old_"), F.replace("p_name", F.lit(" "), F.lit("_"))))
    return rows.select(F.concat(F.lit("app/"), F.col("p_partkey").cast("string")).alias("path"), name.alias("name"))


def _flow_files(s, d):
    return table(s, d, "part").filter("p_partkey % 3 = 0").select(F.initcap("p_name").alias("flow"), F.concat(F.lit("app/"), F.col("p_partkey").cast("string")).alias("path"))


def _members(s, d):
    k = F.col("p_partkey")
    dirs = F.element_at(F.array(*(F.lit(x) for x in ("app/api/", "app/controllers/", "app/models/", "lib/", "web/stores/"))), (k % 5 + 1).cast("int"))
    name = F.when(F.col("p_size") % 3 == 0, "v1").otherwise(F.replace("p_name", F.lit(" "), F.lit("-")))
    return table(s, d, "part").select(F.floor(k / 3).alias("flow"), k.alias("place"), F.concat(dirs, name, F.lit("/"), k.cast("string"), F.lit(".rb")).alias("path"), "p_size")


def _community_names(s, d):
    rows, size, k = _members(s, d), F.col("p_size"), F.col("place")
    files = rows.select("path", F.when(size % 2 == 0, "ruby").otherwise("go").alias("language"), F.when(size % 4 > 0, F.concat(F.lit("Big"), F.lit("Thing"), k.cast("string"))).alias("class_name"), F.when(size > 40, size).otherwise(0).alias("associations"))
    functions = rows.select("path", F.lit(0).alias("turn"), F.when(size % 5 < 3, "index").otherwise(F.concat(F.lit("act"), k.cast("string"))).alias("name"), F.when(size % 5 == 4, "private").otherwise("public").alias("visibility"))
    return community_names(rows.drop("p_size"), files, functions)


def _hub_flows(s, d):
    nation = table(s, d, "nation")
    hubs = nation.filter("n_nationkey % 5 = 0").select(F.col("n_name").alias("hub"), F.col("n_nationkey").alias("path"))
    return hub_flows(hubs, trade(s, d).filter("weight >= 3"), nation.select(F.col("n_regionkey").alias("flow"), F.col("n_nationkey").alias("path")))


def _identifiers(s, d):
    o = table(s, d, "orders")
    words = F.concat_ws(" ", F.initcap(F.lower("o_orderpriority")), F.when(F.col("o_orderkey") % 2 == 0, "useOrder"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("GET /orders/"), F.col("o_orderkey").cast("string"))), F.lit("x HEAD"))
    return o.select("o_orderkey", identifier_lines(words).alias("lines"))


def _labels(s, d):
    c = F.col("c_custkey").cast("string")
    front = front_label(F.concat(F.when(F.col("c_custkey") % 2 == 0, "useHTMLBox").otherwise("__my_page-item"), c, F.lit(".tsx")))
    return table(s, d, "customer").select("c_custkey", front.alias("front"), back_label(F.concat(F.lit("remote_check"), c, F.lit("_policy.rb")), F.when(F.col("c_custkey") % 3 == 0, F.lit("PreAuthController"))).alias("back"))


QUERIES = {
    "association_edges": lambda s, d: association_edges(_associations(s, d), _classes(s, d)),
    "api_edges": lambda s, d: api_edges(_clients(s, d), _back(s, d), _routes(s, d)),
    "resource_edges": lambda s, d: resource_edges(_front(s, d), _stores(s, d).select("path", F.col("target").alias("source")), _back(s, d)),
    "store_edges": lambda s, d: store_edges(_stores(s, d), _clients(s, d)),
    "component_seeds": lambda s, d: component_seeds(_front(s, d), _back(s, d)),
    "absorbed_hubs": lambda s, d: absorbed_hubs(_hubs(s, d), _seeds(s, d), _flow_files(s, d)),
    "hub_flows": _hub_flows,
    "path_segments": lambda s, d: path_segments(_members(s, d)),
    "community_names": _community_names,
    "identifier_lines": _identifiers,
    "file_labels": _labels,
}

_ONE = "r AS (SELECT p_partkey AS k, replace(p_name, ' ', '_') || (p_partkey // 40) AS one, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] || (p_partkey // 40) AS big, p_size FROM part)"
_FRONT = "f AS (SELECT 'web/src' || CASE WHEN k % 5 = 0 THEN '/views/' ELSE '/components/' END || big || 's/' || k || '.tsx' AS path, CASE WHEN k % 7 = 0 THEN 'core' ELSE 'web' END AS repo, k, one, big FROM r)"
_BACK = "b AS (SELECT DISTINCT one, CASE k % 5 WHEN 0 THEN 'app/models/' || one || '.rb' WHEN 1 THEN 'app/controllers/' || one || 's_controller.rb' WHEN 2 THEN 'app/controllers/' || one || 's/' || k || '_controller.rb' WHEN 3 THEN 'app/controllers/old_' || one || 's_controller.rb' ELSE 'app/services/' || one || 's_sync.rb' END AS path FROM r)"
_MEM = "m AS (SELECT p_partkey // 3 AS flow, p_partkey AS place, ['app/api/', 'app/controllers/', 'app/models/', 'lib/', 'web/stores/'][p_partkey % 5 + 1] AS dir, CASE WHEN p_size % 3 = 0 THEN 'v1' ELSE replace(p_name, ' ', '_') END AS seg, p_size FROM part), g AS (SELECT flow, seg AS segment, count(*) AS n, min(place) AS met FROM m WHERE dir <> 'lib/' GROUP BY 1, 2), s AS (SELECT flow, segment, n FROM g QUALIFY row_number() OVER (PARTITION BY flow ORDER BY n DESC, met) = 1)"
SQL = {
    "association_edges": f"WITH {_ONE}, l AS (SELECT one, big, max(k) AS k FROM r GROUP BY 1, 2) SELECT DISTINCT 'app/models/m' || r.k || '.rb' AS src, 'app/models/m' || l.k || '.rb' AS dst, l.big AS target, CASE WHEN l.k % 4 = 0 THEN 1.0::DOUBLE ELSE 5.0::DOUBLE END AS weight FROM r JOIN l USING (one) WHERE r.k % 11 <> 0 AND r.k <> l.k AND (l.k % 4 = 0 OR l.k % 9 <> 0)",
    "api_edges": f"WITH {_ONE}, {_BACK}, c AS (SELECT DISTINCT one || 's' AS key, 'web/src/api/' || replace(one, '_', '-') || 's.ts' AS src FROM r) SELECT src, path AS dst FROM c JOIN b ON ends_with(path, key || '_controller.rb') OR contains(path, '/controllers/' || key || '/') UNION SELECT src, 'config/routes/' || k || '.rb' FROM c JOIN r ON k % 6 = 0 AND contains('/v1/' || one || 's/:id', '/' || key)",
    "resource_edges": f"WITH {_ONE}, {_FRONT}, {_BACK} SELECT DISTINCT f.path AS src, b.path AS dst, f.one || 's' AS slug FROM f JOIN b ON contains(b.path, '/' || f.one || '.rb') OR contains(b.path, '/' || f.one || 's_controller.rb') OR contains(b.path, '/controllers/' || f.one || 's/') WHERE k % 5 <> 0 AND repo <> 'core' AND (contains(b.path, '/models/') OR contains(b.path, '/controllers/'))",
    "store_edges": f"WITH {_ONE} SELECT 'web/src/stores/' || k || '.ts' AS src, 'web/src/api/' || replace(one, '_', '-') || 's.ts' AS dst FROM r WHERE k % 2 = 0",
    "component_seeds": f"WITH {_ONE}, {_FRONT}, {_BACK}, t AS (SELECT DISTINCT trim(regexp_replace(big || 's', '([A-Z])', ' \\1', 'g')) AS flow, one FROM r) SELECT trim(regexp_replace(big || 's', '([A-Z])', ' \\1', 'g')) AS flow, path, repo FROM f UNION SELECT flow, path, 'core' FROM t JOIN b ON contains(path, 'models/' || t.one || '.rb') OR contains(path, 'controllers/' || t.one || 's_controller.rb') OR contains(path, 'controllers/' || t.one || 's/') OR contains(path, 'services/' || t.one || 's')",
    "absorbed_hubs": "WITH w AS (SELECT p_name, min(p_partkey) AS place, replace(p_name, ' ', '_') AS seed FROM part GROUP BY 1), h AS (SELECT p_partkey AS k, p_name AS own, CASE WHEN p_partkey % 2 = 0 THEN split_part(p_name, ' ', 1) ELSE 'old_' || replace(p_name, ' ', '_') END AS hub FROM part) SELECT 'app/' || k AS path, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS flow FROM h JOIN w ON contains(seed, hub) OR contains(hub, seed) WHERE NOT (k % 3 = 0 AND own = p_name) QUALIFY row_number() OVER (PARTITION BY k ORDER BY place) = 1",
    "hub_flows": "WITH e AS (SELECT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2 HAVING count(*) >= 3), h AS (SELECT n_name AS hub, n_nationkey AS p FROM nation WHERE n_nationkey % 5 = 0), x AS (SELECT hub, unnest([src, dst]) AS f FROM e JOIN h ON p IN (src, dst)) SELECT DISTINCT hub, n_regionkey AS flow FROM x JOIN nation ON f = n_nationkey",
    "path_segments": f"WITH {_MEM} SELECT flow, segment, n FROM s",
    "community_names": f"WITH {_MEM}, a AS (SELECT flow, arg_max('big_thing' || place, p_size * 10000000 - place) FILTER (p_size % 2 = 0 AND p_size % 4 > 0 AND p_size > 40) AS model, arg_min('big_thing' || place, place) FILTER (p_size % 2 = 0 AND p_size % 4 > 0) AS class, arg_min('act' || place, place) FILTER (p_size % 5 = 3) AS action, min(place) AS first FROM m GROUP BY 1) SELECT flow, coalesce(model, CASE WHEN segment <> 'v1' THEN segment END, action, class, segment, first::VARCHAR) AS name FROM a LEFT JOIN s USING (flow)",
    "identifier_lines": "SELECT o_orderkey, CASE WHEN w = '' AND rt = '' THEN '' ELSE chr(10) || '## Code identifiers' || CASE WHEN w <> '' THEN chr(10) || '**Classes & hooks:** ' || w ELSE '' END || CASE WHEN rt <> '' THEN chr(10) || '**Routes:** ' || rt ELSE '' END END AS lines FROM (SELECT o_orderkey, array_to_string(list_filter(string_split(concat_ws(' ', t, CASE WHEN o_orderkey % 2 = 0 THEN 'useOrder' END, CASE WHEN o_orderkey % 3 = 0 THEN 'GET' END, 'HEAD'), ' '), lambda x: regexp_matches(x, '^([A-Z][a-zA-Z0-9]|use[A-Z])')), ', ') AS w, CASE WHEN o_orderkey % 3 = 0 THEN 'GET /orders/' || o_orderkey ELSE '' END AS rt FROM (SELECT o_orderkey, array_to_string(list_transform(string_split(lower(o_orderpriority), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS t FROM orders))",
    "file_labels": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Html Box' || c_custkey ELSE 'My Page Item' || c_custkey END AS front, CASE WHEN c_custkey % 3 = 0 THEN 'Pre Auth' ELSE 'Remote Check' || c_custkey END AS back FROM customer",
}
