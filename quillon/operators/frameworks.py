"""Frameworks of repositories, and the types that they give to the classes of a file.

FRAMEWORKS is a registry: a framework is a test of a repository's files (an aggregate over rows of repo, path, content), the
languages that it is for, and a change of a file's classes (an expression over the columns of a parsed file). Others are added
by name. A parsed file has repo, path, language, content, functions and exports (names), stores (number of store uses) and
classes (name, parent, type).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import pascal, stem
from quillon.operators.graph import _PATHS, _paths
from quillon.session import table

# Directories and parents that give a class its type, in order
RAILS_PATHS = {"/app/models/": "model", "/app/controllers/": "controller", "/app/jobs/": "job", "/app/services/": "service", "/app/helpers/": "helper", "/app/serializers/": "serializer", "/app/mailers/": "middleware"}
RAILS_PARENTS = {"ApplicationRecord": "model", "ApplicationController": "controller", "ActiveJob::Base": "job", "ActionMailer": "middleware", "ApplicationMailer": "middleware"}
DJANGO_PARENTS = [(r"\bmodels\.Model\b", "model"), (r"\b(?:APIView|ViewSet|ModelViewSet|GenericAPIView)\b", "controller"), (r"\b(?:Serializer|ModelSerializer)\b", "serializer")]
# What shows a framework
RAILS_FILES = ("Gemfile", "config/routes.rb", "app/models/")
DJANGO_FILES = ("manage.py", "settings.py", "urls.py", "wsgi.py")
REACT_DIRS = ("/src/redux/", "/src/store/", "/src/components/")
# Directories of stores and of components
STORE_DIRS = ("/store/", "/slices/", "/redux/")
VIEW_DIRS = ("/components/", "/pages/", "/views/")
# Patterns of routers, controllers, routes and relations in source text
ROUTER = r"(?:express\.Router|Router)\s*\(\s*\)"
ROUTE = r"(?i)\.\s*(get|post|put|patch|delete|all|use)\s*\(\s*['\"]([^'\"]+)['\"]"
NEST_CONTROLLER = r"@Controller\(\s*['\"]?([^'\")\s]*)['\"]?\s*\)"
NEST_ROUTE = r"(?i)@(Get|Post|Put|Patch|Delete|All)\(\s*['\"]?([^'\")\s]*)['\"]?\s*\)"
RELATION = r"(?m)^\s*(\w+)\s*=\s*models\.(ForeignKey|ManyToManyField|OneToOneField)\(\s*(?:['\"]?)(\w+)"
URL_PATH = r"path\(\s*['\"]([^'\"]*)['\"]\s*,\s*([^,)]+)"


class Framework(NamedTuple):
    languages: tuple[str, ...]
    shown: Callable[[], Column]  # of a file, true where it shows the framework
    classes: Callable[[Column], Column]  # a file's classes, retyped


def _any(path: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(path, F.lit(p)) for p in parts))


def _first(cases: list[tuple[Column, str]]) -> Column:
    """The value of the first case that holds, else null."""
    return F.coalesce(*(F.when(test, F.lit(value)) for test, value in cases))


def _typed(classes: Column, kind: Callable[[Column], Column]) -> Column:
    return F.transform(classes, lambda c: c.withField("type", F.coalesce(kind(c), c["type"])))


def _others(classes: Column, when: Column, kind: str) -> Column:
    """Classes of no type get one where `when` holds."""
    return _typed(classes, lambda c: F.when(when & (c["type"] == "other"), kind))


def _rails(classes: Column) -> Column:
    by_path = _first([(F.contains("path", F.lit(p)), t) for p, t in RAILS_PATHS.items()])

    def kind(c: Column) -> Column:
        by_parent = _first([(c["parent"] == p, t) for p, t in RAILS_PARENTS.items()] + [(c["parent"].endswith("Controller"), "controller")])
        return F.coalesce(by_parent, F.when(c["type"] == "other", by_path))

    return _typed(classes, kind)


def _django(classes: Column) -> Column:
    return _typed(classes, lambda c: _first([(c["parent"].rlike(p), t) for p, t in DJANGO_PARENTS]))


def _express(classes: Column) -> Column:
    nest = F.col("content").rlike(NEST_CONTROLLER)
    return _typed(classes, lambda c: F.when(F.coalesce(nest, F.lit(False)), "controller").when(F.contains("path", F.lit("/middleware/")), "middleware"))


def _made(name: Column, kind: str) -> Column:
    return F.array(F.struct(name.alias("name"), F.lit(None).cast("string").alias("parent"), F.lit(kind).alias("type")))


def _react(classes: Column) -> Column:
    path = F.col("path")
    store = (F.coalesce("stores", F.lit(0)) > 0) | F.exists(classes, lambda c: c["type"] == "store") | _any(path, STORE_DIRS)
    out = _others(classes, store, "store")
    view, hook = _any(path, VIEW_DIRS), F.contains(path, F.lit("/hooks/"))
    bare = view & (F.size("exports") > 0) & (F.size("functions") > 0) & ~F.exists(out, lambda c: c["type"] == "component")
    out = F.when(bare, F.concat(out, _made(F.coalesce(F.get("exports", F.lit(0)), stem(path)), "component"))).otherwise(out)
    out = _others(_others(out, view, "component"), hook, "helper")
    out = F.when(hook & (F.size(out) == 0) & (F.size("functions") > 0), _made(F.coalesce(F.get("exports", F.lit(0)), F.get("functions", F.lit(0))), "helper")).otherwise(out)
    return _others(out, _any(path, ("/middleware/", "/middlewares/")), "middleware")


def _depends(name: str) -> Column:
    """A package.json that lists the package; one that doesn't parse lists none."""
    kinds = ("dependencies", "devDependencies", "peerDependencies")
    found = (F.coalesce(F.get_json_object("content", f"$.{k}['{name}']").isNotNull(), F.lit(False)) for k in kinds)
    return F.col("path").rlike("(^|/)package\\.json$") & reduce(lambda a, b: a | b, found)


FRAMEWORKS = {
    "rails": Framework(("ruby",), lambda: _any(F.col("path"), RAILS_FILES), _rails),
    "django": Framework(("python",), lambda: F.element_at(F.split("path", "/"), -1).isin(*DJANGO_FILES) | F.col("path").rlike(r"requirements[^\n]*\.txt$|Pipfile$"), _django),
    "express": Framework(("javascript", "typescript"), lambda: F.col("path").rlike(r"package\.json$|\.controller\.ts$|\.module\.ts$"), _express),
    "react": Framework(("javascript",), lambda: _depends("react") | _any(F.col("path"), REACT_DIRS), _react),
}


def detected(files: DataFrame, frameworks: dict[str, Framework] = FRAMEWORKS) -> DataFrame:
    """(repo, framework) that a file (repo, path, content) of the repository shows; one aggregate over all files."""
    got = files.groupBy("repo").agg(*(F.bool_or(f.shown()).alias(name) for name, f in frameworks.items()))
    shown = F.array_compact(F.array(*(F.when(F.col(name), F.lit(name)) for name in frameworks)))
    return got.select("repo", F.explode(shown).alias("framework"))


def retyped(files: DataFrame, active: DataFrame, frameworks: dict[str, Framework] = FRAMEWORKS) -> DataFrame:
    """Parsed files with their classes as the active frameworks (repo, framework) of their repository type them, one after another."""
    own = active.groupBy("repo").agg(F.collect_set("framework").alias("__active"))
    rows = files.join(own, "repo", "left")
    for name, f in frameworks.items():
        here = F.col("language").isin(*f.languages) & F.coalesce(F.array_contains("__active", name), F.lit(False))
        rows = rows.withColumn("classes", F.when(here, f.classes(F.col("classes"))).otherwise(F.col("classes")))
    return rows.drop("__active")


def _each(text: Column, pattern: str, made: Callable[[Column], Column]) -> Column:
    """`made` of each match of the pattern, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), made)


def script_routes(text: Column) -> Column:
    """(method, path) of a router's calls, where the text makes one, then of a controller's decorators below its prefix."""
    route = lambda p: lambda m: F.struct(F.upper(F.regexp_extract(m, p, 1)).alias("method"), F.regexp_extract(m, p, 2).alias("path"))
    none = F.array().cast("array<struct<method:string,path:string>>")
    prefix = F.regexp_extract(text, NEST_CONTROLLER, 1)

    def below(r: Column) -> Column:
        whole = F.regexp_replace(F.concat(F.lit("/"), prefix, F.lit("/"), r["path"]), "/+", "/")
        return r.withField("path", F.when(prefix != "", whole).otherwise(F.concat(F.lit("/"), r["path"])))

    calls = F.when(text.rlike(ROUTER), _each(text, ROUTE, route(ROUTE))).otherwise(none)
    return F.concat(calls, F.when(text.rlike(NEST_CONTROLLER), F.transform(_each(text, NEST_ROUTE, route(NEST_ROUTE)), below)).otherwise(none))


def model_relations(text: Column) -> Column:
    """(type, name, target) of the relation fields of a Python file's models."""
    part = lambda m, k: F.regexp_extract(m, RELATION, k)
    return _each(text, RELATION, lambda m: F.struct(part(m, 2).alias("type"), part(m, 1).alias("name"), part(m, 3).alias("target")))


def url_routes(text: Column) -> Column:
    """(path, controller, action) of a urls file: a class of views is the controller, any other view the action."""
    view = lambda m: F.trim(F.regexp_extract(m, URL_PATH, 2))

    def made(m: Column) -> Column:
        owner = F.regexp_extract(view(m), r"^(\w+)\.as_view\(", 1)
        return F.struct(F.concat(F.lit("/"), F.regexp_extract(m, URL_PATH, 1)).alias("path"), F.nullif(owner, F.lit("")).alias("controller"), F.when(owner == "", F.regexp_replace(view(m), "['\"]", "")).alias("action"))

    return _each(text, URL_PATH, made)


def _files(s, d) -> DataFrame:
    """Parts as parsed files of a repository a brand: two classes in most, none in every fifth."""
    part = table(s, d, "part").select("p_partkey", "p_brand", "p_size", "p_name")
    rows = _paths(s, d).join(part, "p_partkey")
    pick = lambda xs, k: F.element_at(F.array(*(F.lit(x) for x in xs)), (F.pmod(F.col("p_partkey"), F.lit(k)) + 1).cast("int"))
    parent = pick(("ApplicationRecord", "AdminController", "models.Model", "rest.ModelViewSet", "Plain", "ModelSerializer"), 6)
    name = pascal(F.replace("p_name", F.lit(" "), F.lit("_")))
    both = F.array(F.struct(name.alias("name"), parent.alias("parent"), F.lit("other").alias("type")), F.struct(F.lit("Base").alias("name"), F.lit(None).cast("string").alias("parent"), F.lit("other").alias("type")))
    return rows.select(
        "p_partkey", F.col("p_brand").alias("repo"), F.concat(F.lit("/"), pick(("src/components", "src/hooks", "src/redux", "lib"), 4), F.lit("/"), "path").alias("path"),
        pick(("ruby", "python", "javascript"), 3).alias("language"), F.when(F.col("p_partkey") % 10 == 0, "@Controller('x')").otherwise("").alias("content"),
        F.array(F.lit("run")).alias("functions"), F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("Panel"))).otherwise(F.array().cast("array<string>")).alias("exports"),
        F.lit(0).alias("stores"), F.when(F.col("p_partkey") % 5 == 0, F.array().cast(both_type)).otherwise(both).alias("classes"),
    )


both_type = "array<struct<name:string,parent:string,type:string>>"


def _types(s, d) -> DataFrame:
    rows = _files(s, d)
    got = retyped(rows, detected(rows))
    return got.select("p_partkey", F.array_join(F.transform("classes", lambda c: F.concat_ws(":", c["name"], c["type"])), ",").alias("classes"))


QUERIES = {
    "frameworks": lambda s, d: detected(_files(s, d)),
    "framework_types": _types,
}
_F = f"""{_PATHS}, f AS (SELECT p_partkey, p_brand AS repo, '/' || ['src/components', 'src/hooks', 'src/redux', 'lib'][p_partkey % 4 + 1] || '/' || path AS path, ['ruby', 'python', 'javascript'][p_partkey % 3 + 1] AS language, p_partkey % 10 = 0 AS nest, p_partkey % 2 = 0 AS exported, p_partkey % 5 <> 0 AS filled, ['ApplicationRecord', 'AdminController', 'models.Model', 'rest.ModelViewSet', 'Plain', 'ModelSerializer'][p_partkey % 6 + 1] AS parent, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), '') AS name FROM p JOIN part USING (p_partkey)), a AS (SELECT repo, bool_or(contains(path, 'app/models/') OR contains(path, 'Gemfile') OR contains(path, 'config/routes.rb')) AS rails, bool_or(contains(path, '/src/redux/') OR contains(path, '/src/store/') OR contains(path, '/src/components/')) AS react FROM f GROUP BY 1)"""
SQL = {
    "frameworks": f"WITH {_F} SELECT repo, unnest(list_filter([CASE WHEN rails THEN 'rails' END, CASE WHEN react THEN 'react' END], lambda x: x IS NOT NULL)) AS framework FROM a",
    "framework_types": f"""WITH {_F}, t AS (SELECT *, CASE WHEN contains(path, '/app/models/') THEN 'model' WHEN contains(path, '/app/controllers/') THEN 'controller' WHEN contains(path, '/app/helpers/') THEN 'helper' ELSE 'other' END AS place, CASE WHEN contains(path, '/redux/') THEN 'store' WHEN contains(path, '/components/') THEN 'component' WHEN contains(path, '/hooks/') THEN 'helper' ELSE 'other' END AS kind FROM f JOIN a USING (repo)) SELECT p_partkey, array_to_string(CASE language WHEN 'ruby' THEN CASE WHEN NOT filled THEN [] WHEN NOT rails THEN [name || ':other', 'Base:other'] ELSE [name || ':' || CASE parent WHEN 'ApplicationRecord' THEN 'model' WHEN 'AdminController' THEN 'controller' ELSE place END, 'Base:' || place] END WHEN 'python' THEN CASE WHEN filled THEN [name || ':other', 'Base:other'] ELSE [] END ELSE list_concat(CASE WHEN filled THEN [name || ':' || CASE WHEN react THEN kind ELSE 'other' END, 'Base:' || CASE WHEN react THEN kind ELSE 'other' END] ELSE [] END, CASE WHEN react AND contains(path, '/components/') AND exported THEN ['Panel:component'] WHEN react AND contains(path, '/hooks/') AND NOT filled THEN [CASE WHEN exported THEN 'Panel' ELSE 'run' END || ':helper'] ELSE [] END) END, ',') AS classes FROM t""",
}
