"""Script and component files: statements by bracket depth, and what they export, define, call, route and store.

A file is its lines (file, no, line). Brackets outside strings and comments open and close; running sums give the depth at which a
line begins, and the lines from one at depth 0 to the next are one statement, so that arguments and bodies which span lines are
read whole. Patterns then read statements, not lines. Strings and comments that span lines are not followed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import table

# Methods that route, methods that call, and their names
ROUTED = "get|post|put|patch|delete|head|options|all|use"
CALLED = "get|post|put|patch|delete|destroy"


def _unquoted(text: Column) -> Column:
    """Text whose strings are empty."""
    return F.regexp_replace(text, r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`(?:[^`\\]|\\.)*`", "''")


def _bare(line: Column) -> Column:
    """A line without what stands in strings, and without its comment."""
    return F.regexp_replace(_unquoted(line), r"//.*$|/\*.*?\*/", "")


def statements(lines: DataFrame) -> DataFrame:
    """(file, no, text) of the statements of each file, no being the first line. A file's lines meet in one task; files are bounded, their number is not."""
    count = lambda c: F.length(F.regexp_replace("bare", f"[^{c}]", ""))
    rows = lines.withColumn("bare", _bare(F.col("line"))).filter(F.trim("bare") != "")
    w = Window.partitionBy("file").orderBy("no")
    rows = rows.withColumn("net", count(r"\{\(\[") - count(r"\}\)\]")).withColumn("sum", F.sum("net").over(w)).withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(w)))
    before = F.coalesce(F.lag("depth").over(w), F.lit(0))
    rows = rows.withColumn("head", F.last(F.when(before == 0, F.col("no")), True).over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: F.regexp_replace(x["line"], r"(^|\s)//.*$", "")), "\n")
    return rows.groupBy("file", F.col("head").alias("no")).agg(F.regexp_replace(text, r"^\s+|\s+$", "").alias("text"))


def _inner(text: Column) -> Column:
    """A statement with its brackets emptied, six levels deep."""
    for _ in range(6):
        text = F.regexp_replace(text, r"\([^(){}\[\]]*\)|\{[^(){}\[\]]*\}|\[[^(){}\[\]]*\]", "")
    return text


def exports(text: Column) -> Column:
    """array<struct<name, main>> of a statement's exports; main: the default one."""
    one = lambda name, main: F.array(F.struct(name.alias("name"), F.lit(main).alias("main")))
    main = text.rlike(r"^export\s+default\b")
    named = F.regexp_extract(text, r"^export\s+(?:default\s+)?(?:async\s+)?(?:function\s*\*?|class)\s+(\w+)", 1)
    clause = F.split(F.regexp_extract(text, r"^export\s*\{([^}]*)\}", 1), ",")
    listed = F.transform(F.filter(clause, lambda c: F.trim(c) != ""), lambda c: F.struct(F.regexp_extract(c, r"^\s*(\w+)", 1).alias("name"), F.lit(False).alias("main")))
    bound = F.regexp_extract_all(_inner(_unquoted(F.regexp_replace(text, r"=>[\s\S]*", "=>"))), F.lit(r"(?:^export\s+(?:const|let|var)|,)\s+(\w+)\s*(?::[^=,]+)?(?==|,|;|$)"), F.lit(1))
    value = F.regexp_extract(text, r"^export\s+default\s+([A-Za-z_$][\w$.]*)\s*(?:\(|;|$)", 1)
    return (
        F.when(~text.rlike(r"^export\b"), F.array().cast("array<struct<name:string,main:boolean>>"))
        .when((named != "") & main, one(named, True)).when(named != "", one(named, False)).when(F.size(listed) > 0, listed)
        .when(text.rlike(r"^export\s+(?:const|let|var)\b"), F.transform(bound, lambda n: F.struct(n.alias("name"), F.lit(False).alias("main"))))
        .when(main, one(F.when(value.isin("", "function", "class", "async"), "default").otherwise(value), True))
        .otherwise(F.array().cast("array<struct<name:string,main:boolean>>"))
    )


def functions(text: Column) -> Column:
    """array<struct<name, later>> of the functions that a statement defines outside all brackets; later: async."""
    head = r"^(?:export\s+(?:default\s+)?)?"
    plain = F.regexp_extract(text, head + r"(?:async\s+)?function\s*\*?\s*(\w+)", 1)
    arrow = r"(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s+)?(?:function\b|\w+\s*=>|\((?:[^()]|\([^()]*\))*\)\s*(?::[^=]+)?=>)"
    bound = F.regexp_extract(text, head + arrow, 1)
    later = text.rlike(head + r"async\s+function\b") | text.rlike(head + r"(?:const|let|var)\s+\w+\s*(?::[^=]+)?=\s*async\b")
    name = F.when(plain != "", plain).when(bound != "", bound)
    return F.when(name.isNotNull(), F.array(F.struct(name.alias("name"), later.alias("later")))).otherwise(F.array().cast("array<struct<name:string,later:boolean>>"))


def _calls(text: Column, names: str) -> Column:
    """array<struct<owner, method, path>> of calls owner.method(first argument); path null where that is no string."""
    found = F.regexp_extract_all(text, F.lit(rf"([\w$.]+|\))\s*\.\s*({names})\s*\(\s*(?:'[^'\n]*'|\"[^\"\n]*\"|`[^`]*`)?"), F.lit(0))
    def parts(c: Column) -> Column:
        path = F.regexp_extract(c, r"\(\s*['\"`]([^'\"`]*)['\"`]$", 1)
        quoted = c.rlike(r"['\"`]$")
        return F.struct(F.regexp_extract(c, r"^([\w$.]+|\))", 1).alias("owner"), F.regexp_extract(c, rf"\.\s*({names})\s*\(", 1).alias("method"), F.when(quoted, path).alias("path"))

    return F.transform(found, parts)


def routes(text: Column) -> Column:
    """array<struct<method, path>>: USE without a path stands for all paths, other methods need one."""
    made = F.transform(_calls(text, ROUTED), lambda c: F.struct(F.upper(c["method"]).alias("method"), F.coalesce(F.nullif(c["path"], F.lit("")), F.when(c["method"] == "use", "/*")).alias("path")))
    return F.array_distinct(F.filter(made, lambda r: r["path"].isNotNull()))


def api_calls(text: Column) -> Column:
    """array<struct<method, path>> of fetch and of calls of HTTP methods; a path may be unknown."""
    fetched = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![\w$.])fetch\s*\(\s*(?:'[^'\n]*'|\"[^\"\n]*\"|`[^`]*`)?"), F.lit(0)), lambda c: F.struct(F.lit("FETCH").alias("method"), F.when(c.rlike(r"['\"`]$"), F.regexp_extract(c, r"\(\s*['\"`]([^'\"`]*)['\"`]$", 1)).alias("path")))
    return F.concat(fetched, F.transform(_calls(text, CALLED), lambda c: F.struct(F.when(c["method"] == "destroy", "DELETE").otherwise(F.upper(c["method"])).alias("method"), c["path"].alias("path"))))


def stores(text: Column) -> Column:
    """struct<used, own>: the stores that a statement uses, and the name of the one that it defines."""
    used = F.regexp_extract_all(text, F.lit(r"(?<![\w$.])(use\w+Store)\s*\("), F.lit(1))
    defined = F.regexp_extract(text, r"(?<![\w$.])defineStore\s*\(\s*['\"`]([^'\"`]*)['\"`]", 1)
    slice_ = F.regexp_extract(text, r"(?<![\w$.])createSlice\s*\(\s*\{[^{}]*?\bname\s*:\s*['\"`]([^'\"`]*)['\"`]", 1)
    return F.struct(used.alias("used"), F.when(defined != "", defined).when(slice_ != "", slice_).alias("own"))


def parse_scripts(lines: DataFrame) -> DataFrame:
    """(file, no, kind, name, detail): export, function, route, call, store and uses, a row each; a route of a file once."""
    rows = statements(lines)
    text = F.col("text")
    tell = lambda kind, items, name, detail: F.transform(items, lambda x: F.struct(F.lit(kind).alias("kind"), name(x).alias("name"), detail(x).cast("string").alias("detail")))
    held = stores(text)
    own = F.when(held["own"].isNotNull(), F.array(held["own"])).otherwise(F.array().cast("array<string>"))
    every = F.concat(
        tell("export", exports(text), lambda x: x["name"], lambda x: F.when(x["main"], "default")), tell("function", functions(text), lambda x: x["name"], lambda x: F.when(x["later"], "async")),
        tell("route", routes(text), lambda x: x["path"], lambda x: x["method"]), tell("call", api_calls(text), lambda x: x["path"], lambda x: x["method"]),
        tell("store", own, lambda x: x, lambda x: F.lit(None)), tell("uses", held["used"], lambda x: x, lambda x: F.lit(None)),
    )
    found = rows.select("file", "no", F.explode(every).alias("x")).select("file", "no", "x.*")
    # the first of equal routes stays, of the others all
    return found.groupBy("file", "kind", "name", "detail", F.when(F.col("kind") == "route", F.lit(-1)).otherwise(F.col("no")).alias("of")).agg(F.min("no").alias("no"), F.count("*").alias("n")).select("file", "no", "kind", "name", "detail", F.when(F.col("kind") == "route", 1).otherwise(F.col("n")).cast("long").alias("n"))


def template_parts(source: Column) -> Column:
    """struct<components, models, handlers> of a component file's template: tags in Pascal case and handlers once each."""
    template = F.regexp_extract(source, r"(?is)<template[^>]*>(.*)</template>", 1)
    every = lambda pattern, group: F.regexp_extract_all(template, F.lit(pattern), F.lit(group))
    handlers = F.transform(every(r'(?:@|v-on:)([a-zA-Z.-]+)\s*=\s*"([^"]+)"', 2), lambda h: F.regexp_replace(h, r"\(.*\)$", ""))
    return F.struct(F.array_distinct(every(r"<([A-Z][a-zA-Z0-9]+)", 1)).alias("components"), every(r'v-model(?::([a-zA-Z]+))?\s*=\s*"([^"]+)"', 2).alias("models"), F.array_distinct(handlers).alias("handlers"))


# -- registered queries --------------------------------------------------------------------------------------------------

# Lines of code for the query, by the length of a document's line; {} is that length
TEMPLATES = [
    "export function f{}(a,", "  b = '(') {", "}", "}", ")", "});", "router.get('/p{}', (req, res) => {", "app.use(cors())", "app", "  .post(", "    \"/q{}\",", "export default class C{} {", "const g{} = async (x) => {",
    "export { a, b as c{} }", "  const inner{} = 1", "fetch(`/r{}`)", "api.destroy(path)", "const s = useCart{}Store()", "export const useS{}Store = defineStore('s{}', {", "// export const no{} = {", "export const k{} = { z: [", "] }", "foo([", "])",
]


def _lines(s, d) -> DataFrame:
    n = F.length("line").cast("string")
    code = F.element_at(F.array(*(F.replace(F.lit(t), F.lit("{}"), n) for t in TEMPLATES)), (F.length("line") % len(TEMPLATES) + 1).cast("int"))
    return table(s, d, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("no", "line")).select("file", "no", code.alias("line"))


def _templates(s, d) -> DataFrame:
    """Pages as component files: links become handlers and models, tags of headings components."""
    html = F.regexp_replace(F.regexp_replace("html", 'href="([^"]*)"', '@click.prevent="go($1)" v-model:target = "x.$1"'), "<(h[1-6]|li)", "<Own$1")
    return table(s, d, "pages").select("page_id", F.concat(F.lit("<template lang='x'>"), html, F.lit("</template>")).alias("source"))


QUERIES = {
    "script_statements": lambda s, d: statements(_lines(s, d)),
    "script_parts": lambda s, d: parse_scripts(_lines(s, d)),
    "template_parts": lambda s, d: _templates(s, d).select("page_id", template_parts(F.col("source")).alias("t")).select("page_id", *(F.array_join(f"t.{c}", " | ").alias(c) for c in ("components", "models", "handlers"))),
}
SQL = {
    "template_parts": r"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(html, 'href="([^"]*)"', '@click.prevent="go(\1)" v-model:target = "x.\1"', 'g'), '<(h[1-6]|li)', '<Own\1', 'g') AS x FROM pages),
u AS (SELECT page_id, generate_subscripts(a, 1) AS i, unnest(a) AS tag FROM (SELECT page_id, regexp_extract_all(x, '<([A-Z][a-zA-Z0-9]+)', 1) AS a FROM t)), c AS (SELECT page_id, string_agg(tag, ' | ' ORDER BY i) AS components FROM (SELECT page_id, tag, min(i) AS i FROM u GROUP BY 1, 2) GROUP BY 1),
v AS (SELECT page_id, generate_subscripts(a, 1) AS i, unnest(a) AS h FROM (SELECT page_id, regexp_extract_all(x, '(?:@|v-on:)([a-zA-Z.-]+)\s*=\s*"([^"]+)"', 2) AS a FROM t)), h AS (SELECT page_id, string_agg(h, ' | ' ORDER BY i) AS handlers FROM (SELECT page_id, regexp_replace(h, '\(.*\)$', '') AS h, min(i) AS i FROM v GROUP BY 1, 2) GROUP BY 1)
SELECT page_id, coalesce(components, '') AS components, array_to_string(regexp_extract_all(x, 'v-model(?::([a-zA-Z]+))?\s*=\s*"([^"]+)"', 2), ' | ') AS models, coalesce(handlers, '') AS handlers FROM t LEFT JOIN c USING (page_id) LEFT JOIN h USING (page_id) WHERE x IS NOT NULL""",
}
