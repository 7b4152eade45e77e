"""Signals of repositories: the words by which a query shows which repository it means, from stack, role, domain and name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import STOP_WORDS
from quillon.operators.retrieval import _DOM, domain_terms
from quillon.session import table

# Words of languages, frameworks and roles
LANGUAGE = {
    "ruby": "ruby gem gemfile bundler rake", "python": "python pip requirements virtualenv", "go": "go golang goroutine", "typescript": "typescript tsconfig",
    "javascript": "javascript node", "php": "php composer artisan", "rust": "rust cargo crate trait", "java": "java maven gradle jvm spring",
}
FRAMEWORK = {
    "rails": "rails,controller,model,migration,concern,serializer,job,mailer,activerecord,active record,has_many,belongs_to,scope,validation,callback,association",
    "cuba": "cuba,rum", "sinatra": "sinatra", "django": "django,orm,queryset,urlconf,admin,template,migrations", "fastapi": "fastapi,pydantic,dependency,router",
    "flask": "flask,blueprint,jinja,werkzeug", "starlette": "starlette,asgi", "react": "react,component,hook,jsx,tsx,props,redux,context,usestate,useeffect",
    "nextjs": "nextjs,getserversideprops,getstaticprops,api route,app router,layout,server component", "vue": "vue,composable,pinia,vuex,directive,emit,ref,reactive",
    "express": "express,middleware,app.get,app.post", "fastify": "fastify,plugin", "gin": "gin,ginrouter", "echo": "echo,echorouter", "fiber": "fiber", "chi": "chi,chirouter",
    "actix": "actix,actixweb,httpserver", "axum": "axum,axumrouter,extract", "rocket": "rocket,rocketroute,fairing", "laravel": "laravel,eloquent,blade,facade,service provider",
}
ROLE = {
    "backend": "backend,api,server,endpoint,database,db", "frontend": "frontend,ui,client,component,render,stylesheet",
    "lambda": "lambda,serverless,function,handler,event,trigger,aws,faas,cloud function",
}
BACK = "rails cuba sinatra django fastapi flask starlette express fastify gin echo fiber chi actix axum rocket laravel nextjs".split()
FRONT, BACK_LANGUAGES = "react nextjs vue".split(), "ruby python go php rust java".split()
BACK_TYPES, FRONT_TYPES = "model controller job service serializer concern middleware mailer".split(), "component store".split()
NAMELESS = "api app web service core main server client backend frontend ui spa lib pkg base common shared platform portal gateway repo project".split()
SHARE, SEEN = 0.4, 5  # a role by types needs more than this share of more than so many typed classes


def _lists(values: dict[str, list[str]]) -> Column:
    return F.create_map(*(x for k, words in values.items() for x in (F.lit(k), F.array(*map(F.lit, words)))))


def roles(profiles: DataFrame, types: DataFrame) -> DataFrame:
    """profiles (repo, language, frameworks, is_lambda) with `back` and `front`: by frameworks, by language where none is a
    front end's, or by types (repo, class_type, n)."""
    count = lambda names: F.coalesce(F.sum(F.when(F.col("class_type").isin(names), F.col("n"))), F.lit(0))
    held = types.groupBy("repo").agg(count(BACK_TYPES).alias("b"), count(FRONT_TYPES).alias("f"))
    rows = profiles.join(held, "repo", "left").fillna(0, ["b", "f"])
    has = lambda names: F.exists("frameworks", lambda x: x.isin(names))
    total = F.col("b") + F.col("f")
    typed = lambda c: (total > SEEN) & (F.col(c) / F.nullif(total, F.lit(0)) > SHARE)
    back = has(BACK) | (~has(FRONT) & F.coalesce(F.col("language").isin(BACK_LANGUAGES), F.lit(False))) | F.coalesce(typed("b"), F.lit(False))
    return rows.withColumns({"back": back, "front": has(FRONT) | F.coalesce(typed("f"), F.lit(False))}).drop("b", "f")


def repo_signals(profiles: DataFrame, types: DataFrame, domain: DataFrame) -> DataFrame:
    """(repo, signal, buckets): each signal once, with where it comes from. domain: repo, term."""
    split = lambda d, mark: {k: v.split(mark) for k, v in d.items()}
    none = F.array().cast("array<string>")
    of = lambda lists, key: F.coalesce(F.try_element_at(_lists(lists), key), none)
    role = split(ROLE, ",")
    words = lambda name, flag: F.when(flag, F.array(*map(F.lit, role[name]))).otherwise(none)
    tokens = F.filter(F.split(F.lower("repo"), r"[-_\s]+"), lambda w: (F.length(w) > 1) & ~w.isin(NAMELESS) & ~w.isin(STOP_WORDS))
    parts = {
        "language": of(split(LANGUAGE, " "), F.col("language")), "framework": F.flatten(F.transform("frameworks", lambda x: of(split(FRAMEWORK, ","), x))),
        "role": F.concat(words("lambda", F.coalesce("is_lambda", F.lit(False))), words("backend", F.col("back")), words("frontend", F.col("front"))), "name": tokens,
    }
    tell = lambda bucket: lambda w: F.struct(F.lit(bucket).alias("bucket"), w.alias("signal"))
    told = F.flatten(F.array(*(F.transform(c, tell(bucket)) for bucket, c in parts.items())))
    own = roles(profiles, types).select("repo", F.explode(told).alias("t")).select("repo", "t.bucket", "t.signal")
    every = own.unionByName(domain.select("repo", F.lit("domain").alias("bucket"), F.col("term").alias("signal")))
    return every.groupBy("repo", "signal").agg(F.array_join(F.array_sort(F.collect_set("bucket")), ",").alias("buckets"))


# -- registered queries --------------------------------------------------------------------------------------------------

_KINDS = [*LANGUAGE, "unknown"]
_NAMES = [*FRAMEWORK]
_TYPES = [*BACK_TYPES, *FRONT_TYPES, "other"]


def _repo() -> Column:
    return F.concat_ws("-", "source", "lang")


def _profiles(s, d) -> DataFrame:
    """Each source and language as a repository; its stack from the lengths of its documents."""
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    rows = table(s, d, "documents").groupBy(_repo().alias("repo")).agg(F.sum("n_chars").alias("n"), F.count("*").alias("c"))
    works = F.when(F.col("c") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(pick(_NAMES, F.col("n")), pick(_NAMES, F.floor(F.col("n") / 7)))))
    return rows.select("repo", pick(_KINDS, F.col("n")).alias("language"), works.alias("frameworks"), (F.col("n") % 4 == 0).alias("is_lambda"))


def _types(s, d) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("n_chars") % len(_TYPES) + 1).cast("int"))
    return table(s, d, "documents").filter("n_chars IS NOT NULL").groupBy(_repo().alias("repo"), kind.alias("class_type")).agg(F.count("*").alias("n"))


def _signals(s, d) -> DataFrame:
    docs = table(s, d, "documents").withColumn("repo", _repo())
    return repo_signals(_profiles(s, d), _types(s, d), domain_terms(docs, "repo", "text").select("repo", "term"))


QUERIES = {"repo_signals": _signals}

_values = lambda rows: ", ".join(f"('{k}', '{w}')" for k, words in rows.items() for w in words)
SQL = {
    "repo_signals": f"""WITH d AS MATERIALIZED (SELECT *, concat_ws('-', source, lang) AS repo FROM documents), {_DOM.replace("source AS grp", "repo AS grp").replace("DISTINCT source", "DISTINCT concat_ws('-', source, lang)").replace("FROM documents)", "FROM d)", 1).replace("@K", "12")},
p AS (SELECT repo, {_KINDS}[n % {len(_KINDS)} + 1] AS language, CASE WHEN c % 3 = 0 THEN [] ELSE [{_NAMES}[n % {len(_NAMES)} + 1], {_NAMES}[n // 7 % {len(_NAMES)} + 1]] END AS works, n % 4 = 0 AS faas FROM (SELECT repo, sum(n_chars)::BIGINT AS n, count(*) AS c FROM d GROUP BY 1)),
t AS (SELECT repo, count(*) FILTER (k IN {tuple(BACK_TYPES)}) AS b, count(*) FILTER (k IN {tuple(FRONT_TYPES)}) AS f FROM (SELECT repo, {_TYPES}[n_chars % {len(_TYPES)} + 1] AS k FROM d) GROUP BY 1),
r AS (SELECT p.*, list_has_any(works, {BACK}) AS bw, list_has_any(works, {FRONT}) AS fw, b + f > 5 AND b * 10 > (b + f) * 4 AS bt, b + f > 5 AND f * 10 > (b + f) * 4 AS ft FROM p JOIN t USING (repo)),
w AS (SELECT repo, 'language' AS bucket, v.w AS signal FROM r JOIN (VALUES {_values({k: v.split() for k, v in LANGUAGE.items()})}) v(k, w) ON k = language
 UNION ALL SELECT repo, 'framework', v.w FROM (SELECT repo, unnest(works) AS x FROM r) JOIN (VALUES {_values({k: v.split(",") for k, v in FRAMEWORK.items()})}) v(k, w) ON k = x
 UNION ALL SELECT repo, 'role', v.w FROM r JOIN (VALUES {_values({k: v.split(",") for k, v in ROLE.items()})}) v(k, w) ON CASE k WHEN 'lambda' THEN faas WHEN 'backend' THEN bw OR NOT fw AND language IN {tuple(BACK_LANGUAGES)} OR bt ELSE fw OR ft END
 UNION ALL SELECT grp, 'domain', term FROM dom
 UNION ALL SELECT repo, 'name', x FROM (SELECT repo, unnest(regexp_split_to_array(lower(repo), '[-_ \\t\\n\\r\\f\\v]+')) AS x FROM r) WHERE length(x) > 1 AND x NOT IN {tuple(NAMELESS)} AND x NOT IN {tuple(STOP_WORDS)})
SELECT repo, signal, array_to_string(list_sort(list(DISTINCT bucket)), ',') AS buckets FROM w GROUP BY repo, signal""",
}
