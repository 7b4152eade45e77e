"""Source trees and parsers: directory scans, ignore rules, and regex parsers of Python and Go as column expressions.

The Ruby and JavaScript parsers find classes, functions, imports and routes by line patterns; they stand for a syntax tree
and miss what lines don't show.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rules that always hold
DEFAULTS = ("node_modules", "vendor", ".git", "dist", "build", ".next", "tmp", "venv", ".venv")
LANGUAGES = {"rb": "ruby", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "vue": "vue", "py": "python", "go": "go"}
# Manifests in the order in which they decide a repository's language
MANIFESTS = [("Gemfile", "ruby"), ("go.mod", "go"), ("requirements.txt", "python"), ("pyproject.toml", "python"), ("package.json", "javascript"), ("Cargo.toml", "rust"), ("composer.json", "php"), ("pom.xml", "java"), ("build.gradle", "java")]


def scan(spark: SparkSession, root: str, ignore: tuple[str, ...] = (), ignore_file: str | None = None) -> DataFrame:
    """(path, language, content) of the source files below root that no rule leaves out; the scan itself drops the others."""
    rules = (*(ignore_rules(spark, root, ignore_file) if ignore_file else DEFAULTS), *ignore)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.col("path"), "^.*?" + root.replace("file://", "").rstrip("/") + "/", "")
    rows = files.select(path.alias("path"), F.col("content").cast("string").alias("content"))
    rows = rows.filter(~ignored(F.col("path"), rules))
    return rows.withColumn("language", language(F.col("path"))).filter("language IS NOT NULL")


def language(path: Column) -> Column:
    ext = F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)
    out = F.lit(None).cast("string")
    for name, kind in LANGUAGES.items():
        out = F.when(ext == name, kind).otherwise(out)
    return out


def ignored(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether rules in gitignore's syntax leave a relative path out: of the rules that match a path the last decides, `!` takes
    back in, a path below a directory that is left out stays out, upper and lower case are alike.

    A rule with a slash before its end is meant from the root, one that ends in a slash for directories only; `*` and `?` stay
    within a segment, `**` crosses them, brackets are sets, a backslash takes the next character as it is.
    """
    rules = [r for r in map(_rule, patterns) if r]
    parts = F.split(path, "/")
    heads = F.transform(parts, lambda p, k: F.struct(F.array_join(F.slice(parts, F.lit(1), k + 1), "/").alias("path"), (k + 1 < F.size(parts)).alias("folder")))

    def out(h: Column) -> Column:
        verdict = F.lit(False)
        for pattern, folder, taken_back in rules:
            hit = h["path"].rlike(pattern)
            verdict = F.when(hit & h["folder"] if folder else hit, F.lit(not taken_back)).otherwise(verdict)
        return verdict

    return F.exists(heads, out)


def _rule(line: str) -> tuple[str, bool, bool] | None:
    """(pattern, for directories only, takes back in) of a line; None of blank lines and comments."""
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    taken_back = line.startswith("!")
    line = line[taken_back:]
    folder, body = line.endswith("/"), line.strip("/")
    rooted = "/" in line[:-1]
    out, k = [], 0
    while k < len(body):
        rest = body[k:]
        if rest.startswith("**/") and (k == 0 or body[k - 1] == "/"):
            out.append("(?:.*/)?")
            k += 3
        elif rest == "**" and (k == 0 or body[k - 1] == "/"):
            out.append(".+")
            k += 2
        elif rest[0] == "*":
            out.append("[^/]*")
            k += len(rest) - len(rest.lstrip("*"))
        elif rest[0] == "[" and (end := body.find("]", k + 2)) > 0:
            held = body[k + 1 : end]
            out.append("[" + ("^/" + held[1:] if held[0] in "!^" else held).replace("[", "\\[").replace("&&", "&\\&") + "]")
            k = end + 1
        else:
            k += rest[0] == "\\" and len(rest) > 1
            out.append("[^/]" if rest[0] == "?" else re.escape(body[k]))
            k += 1
    return f"(?i)^{'' if rooted else '(?:.*/)?'}{''.join(out)}$", folder, taken_back


def ignore_rules(spark: SparkSession, root: str, name: str) -> tuple[str, ...]:
    """The rules that always hold, and behind them the lines of the file `name` at the root, if there is one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")  # Spark's readers pass over names that begin with a dot
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    own = []
    if store.exists(where):
        stream = store.open(where)
        own = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
        stream.close()
    return (*DEFAULTS, *own)


def stack(manifests: DataFrame) -> DataFrame:
    """(repo, language) by the first manifest of MANIFESTS that a repository has."""
    place = F.lit(None).cast("int")
    for k, (name, _) in reversed(list(enumerate(MANIFESTS))):
        place = F.when(F.col("file") == name, k).otherwise(place)
    got = manifests.withColumn("k", place).groupBy("repo").agg(F.min("k").alias("k"))
    kind = F.lit("unknown")
    for k, (_, name) in enumerate(MANIFESTS):
        kind = F.when(F.col("k") == k, name).otherwise(kind)
    return got.select("repo", kind.alias("language"))


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def parse_python(text: Column) -> Column:
    """struct of classes (name, parent), functions (name, visibility), imports and decorators."""
    classes = F.transform(_all(text, r"(?m)^class\s+\w+(?:\([^)]*\))?", 0), lambda c: F.struct(F.regexp_extract(c, r"class\s+(\w+)", 1).alias("name"), F.nullif(F.trim(F.regexp_extract(c, r"\(\s*([\w.]*)", 1)), F.lit("")).alias("parent")))
    functions = F.transform(_all(text, r"(?m)^[ \t]*(?:async\s+)?def\s+(\w+)"), lambda n: F.struct(n.alias("name"), F.when(n.startswith("_"), "private").otherwise("public").alias("visibility")))
    imports = F.array_distinct(F.concat(_all(text, r"(?m)^from\s+([\w.]+)\s+import"), _all(text, r"(?m)^import\s+([\w.]+)")))
    return F.struct(classes.alias("classes"), functions.alias("functions"), imports.alias("imports"), F.array_distinct(_all(text, r"(?m)^[ \t]*@([\w.]+)")).alias("decorators"))


def parse_go(text: Column) -> Column:
    """struct of types (name, kind), functions (receiver-qualified name, visibility) and imports; a capital is public."""
    kinds = F.transform(_all(text, r"(?m)^type\s+\w+\s+(?:struct|interface)", 0), lambda t: F.struct(F.regexp_extract(t, r"type\s+(\w+)", 1).alias("name"), F.regexp_extract(t, r"(struct|interface)$", 1).alias("kind")))
    heads = _all(text, r"(?m)^func\s+(?:\([^)]*\)\s*)?\w+", 0)

    def named(h: Column) -> Column:
        owner, name = F.regexp_extract(h, r"\(\s*\w*\s*\*?(\w+)[^)]*\)", 1), F.regexp_extract(h, r"(\w+)$", 1)
        return F.struct(F.when(owner != "", F.concat(owner, F.lit("."), name)).otherwise(name).alias("name"), F.when(name.rlike("^[A-Z]"), "public").otherwise("private").alias("visibility"))

    block = F.array_join(_all(text, r"(?s)import\s*\((.*?)\)"), "\n")
    imports = F.array_distinct(F.concat(_all(text, r'(?m)^import\s+(?:\w+\s+)?"([^"]+)"'), _all(block, r'"([^"]+)"')))
    return F.struct(kinds.alias("classes"), F.transform(heads, named).alias("functions"), imports.alias("imports"))


def parse_ruby(text: Column) -> Column:
    """struct of classes (name, parent), methods, associations (type, target) and routes (method, path)."""
    classes = F.transform(_all(text, r"(?m)^[ \t]*class\s+[\w:]+(?:[ \t]*<[ \t]*[\w:]+)?", 0), lambda c: F.struct(F.regexp_extract(c, r"class\s+([\w:]+)", 1).alias("name"), F.nullif(F.regexp_extract(c, r"<\s*([\w:]+)", 1), F.lit("")).alias("parent")))
    links = F.transform(_all(text, r"(?m)^[ \t]*(?:has_many|has_one|belongs_to|has_and_belongs_to_many)\s+:\w+", 0), lambda a: F.struct(F.regexp_extract(a, r"^\s*(\w+)", 1).alias("type"), F.regexp_extract(a, r":(\w+)", 1).alias("target")))
    routes = F.transform(_all(text, r"(?m)^[ \t]*(?:get|post|put|patch|delete)\s+['\"][^'\"]+['\"]", 0), lambda r: F.struct(F.upper(F.regexp_extract(r, r"^\s*(\w+)", 1)).alias("method"), F.regexp_extract(r, r"['\"]([^'\"]+)", 1).alias("path")))
    return F.struct(classes.alias("classes"), _all(text, r"(?m)^[ \t]*def\s+(?:self\.)?(\w+[?!=]?)").alias("functions"), links.alias("associations"), F.array_distinct(routes).alias("routes"))


def parse_script(text: Column) -> Column:
    """struct of classes (name, parent), functions, imports and calls of HTTP clients (method, path); for JS, TS and Vue blocks."""
    code = F.when(text.rlike("(?i)<script[^>]*>"), F.array_join(_all(text, r"(?is)<script[^>]*>(.*?)</script>"), "\n")).otherwise(text)
    classes = F.transform(_all(code, r"(?m)\bclass\s+\w+(?:\s+extends\s+[\w.]+)?", 0), lambda c: F.struct(F.regexp_extract(c, r"class\s+(\w+)", 1).alias("name"), F.nullif(F.regexp_extract(c, r"extends\s+([\w.]+)", 1), F.lit("")).alias("parent")))
    functions = F.array_distinct(F.concat(_all(code, r"\bfunction\s+(\w+)"), _all(code, r"(?m)^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>")))
    imports = F.array_distinct(F.concat(_all(code, r"(?m)^import\s+(?:[^'\"]*\sfrom\s+)?['\"]([^'\"]+)['\"]"), _all(code, r"\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)")))
    calls = F.transform(_all(code, r"\b(?:axios|api|http|client|\$http)\.(?:get|post|put|patch|delete)\(\s*[`'\"][^`'\"]+", 0), lambda c: F.struct(F.upper(F.regexp_extract(c, r"\.(\w+)\(", 1)).alias("method"), F.regexp_extract(c, r"[`'\"]([^`'\"]+)$", 1).alias("path")))
    return F.struct(classes.alias("classes"), functions.alias("functions"), imports.alias("imports"), F.array_distinct(calls).alias("api_calls"))


#: the parser of each language, by name; others are added here or given to parsed()
PARSERS = {"python": parse_python, "go": parse_go, "ruby": parse_ruby, "javascript": parse_script, "typescript": parse_script, "vue": parse_script}


def parsed(files: DataFrame, parsers: dict = PARSERS) -> DataFrame:
    """Files (language, content and other columns) with classes and functions (names) and imports, by the parser of their language.

    A language without a parser has none of these; what a parser doesn't know is empty.
    """
    none = F.array().cast("array<string>")
    parts = {}
    for name in ("classes", "functions", "imports"):
        out = None
        for language, parse in parsers.items():
            got = parse(F.col("content"))
            fields = _fields(files, got)
            if name in fields:
                names = got.getField(name)
                names = names if fields[name] == "array<string>" else F.transform(names, lambda x: x["name"])
                out = (F if out is None else out).when(F.col("language") == language, names)
        parts[name] = F.coalesce(out, none) if out is not None else none
    return files.withColumns(parts)


def _fields(files: DataFrame, column: Column) -> dict[str, str]:
    """Names and types of a struct's fields; nothing is read for that."""
    return {x.name: x.dataType.simpleString() for x in files.select(column.alias("x")).schema["x"].dataType.fields}


def outline(html: Column) -> Column:
    """struct of a page's tags (distinct, sorted), headings and links, as a component's template shows them."""
    tags = F.array_sort(F.array_distinct(F.transform(_all(html, "<([A-Za-z][A-Za-z0-9-]*)"), F.lower)))
    return F.struct(tags.alias("tags"), _all(html, "(?s)<h1>(.*?)</h1>").alias("headings"), F.array_distinct(_all(html, 'href="([^"]*)"')).alias("links"))


from quillon.session import table  # noqa: E402

QUERIES = {
    "page_outline": lambda s, d: table(s, d, "pages").select("page_id", outline(F.col("html")).alias("o")).select("page_id", F.array_join("o.tags", ",").alias("tags"), F.size("o.headings").alias("headings"), F.size("o.links").alias("links")),
    "page_scripts": lambda s, d: table(s, d, "pages").select("page_id", F.size(parse_script(F.col("html")).getField("functions")).alias("functions"), F.size(F.array_distinct(_all(F.col("html"), r"(?s)<script[^>]*>(.*?)</script>"))).alias("scripts")),
}
SQL = {
    "page_scripts": r"""WITH b AS (SELECT page_id, html, regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1) AS blocks FROM pages), c AS (SELECT *, CASE WHEN regexp_matches(html, '(?i)<script[^>]*>') THEN array_to_string(blocks, chr(10)) ELSE html END AS code FROM b) SELECT page_id, len(list_distinct(list_concat(regexp_extract_all(code, '\bfunction\s+(\w+)', 1), regexp_extract_all(code, '(?m)^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>', 1))))::INT AS functions, len(list_distinct(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1)))::INT AS scripts FROM c""",
    "page_outline": r"""SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9-]*)', 1), lambda x: lower(x)))), ',') AS tags, len(regexp_extract_all(html, '(?s)<h1>(.*?)</h1>', 1))::INT AS headings, len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1)))::INT AS links FROM pages""",
}
