"""Scalar text functions as Column expressions; they stay inside code generation and need no Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no subject
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can need "
    "ought to of in for on with at by from as into through during before after between out off over under again then "
    "once here there when where why how all each every both few more most other some such no not only own same so than "
    "too very just because but and or if while that this these those it its we they them their i you he she what which "
    "who whom also get like about above below up down"
).split()


def ascii_edges(pattern: str) -> str:
    r"""The pattern with \b between ASCII word characters only, as in engines that don't take accented letters for them."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def words(text: Column) -> Column:
    """Lower-case runs of a-z, 0-9 and _."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9_]+", " "), " "), lambda w: w != "")


def split_camel(text: Column) -> Column:
    return F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")


def snake(text: Column) -> Column:
    """camelCase and kebab-case to snake_case."""
    cut = F.regexp_replace(F.regexp_replace(text, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2")
    return F.replace(F.lower(cut), F.lit("-"), F.lit("_"))


def pascal(text: Column) -> Column:
    """snake_case to PascalCase."""
    parts = F.transform(F.split(text, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10_000)))
    return F.array_join(parts, "")


def singular(word: Column, rules: str = "plain") -> Column:
    """Rule sets: plain (-ies, -sses/-xes/-ches/-shes/-zes, -s), short (-s only), tables (-ies, -ses, -s), routes (-ies, -ses/-xes/-ches, -s)."""
    cut = lambda n, tail="": F.concat(F.left(word, F.length(word) - n), F.lit(tail))
    if rules == "short":
        return F.when(word.endswith("s"), cut(1)).otherwise(word)
    ies = F.when(word.endswith("ies"), cut(3, "y"))
    if rules == "tables":
        return ies.when(word.endswith("ses"), cut(2)).when(word.endswith("s") & ~word.endswith("ss"), cut(1)).otherwise(word)
    return ies.when(word.rlike("(s|x|ch)es$" if rules == "routes" else "(ss|x|ch|sh|z)es$"), cut(2)).when(word.endswith("s") & ~word.endswith("ss"), cut(1)).otherwise(word)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def normal_path(path: Column) -> Column:
    """Path without . and .. segments; .. at the root falls away."""
    step = lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def short_path(path: Column) -> Column:
    """From the directory above app, src, lib or packages, where one is; else the last three segments."""
    parts = F.split(path, "/")
    inner = F.regexp_extract(path, "^.*?/([^/]+/(?:app|src|lib|packages)(?:/.*)?)$", 1)
    return F.when(inner != "", inner).when(F.size(parts) > 3, F.array_join(F.slice(parts, F.size(parts) - 2, 3), "/")).otherwise(path)


def fts_query(text: Column, most: int = 30) -> Column:
    """Words to search for: camelCase split, then URLs, marks, single letters and operators dropped; joined by OR."""
    clean = F.regexp_replace(F.regexp_replace(split_camel(text), r"https?://[^ \t\n\r\f\x0B]+", ""), r"[^a-zA-Z0-9_ \t\n\r\f\x0B]", " ")
    kept = F.filter(F.split(clean, r"[ \t\n\r\f\x0B]+"), lambda w: (F.length(w) > 1) & ~F.upper(w).isin("AND", "OR", "NOT", "NEAR"))
    return F.array_join(F.slice(kept, 1, most), " OR ")


def cut_lines(text: Column, most: int) -> Column:
    lines = F.split(text, "\n")
    return F.when(F.size(lines) <= most, text).otherwise(F.concat(F.array_join(F.slice(lines, 1, most), "\n"), F.lit("\n…")))


def tokens(text: Column) -> Column:
    """Estimated model tokens: a quarter of the characters, rounded up."""
    return F.ceil(F.char_length(text) / 4)


def trim_sections(text: Column, query: Column) -> Column:
    """The head and those sections (## to ####) that hold a word of the query, with a note on how many are left out.

    The whole text where it has one section at most, where none or all match, or the query has no word of three letters.
    """
    terms = F.filter(F.split(F.regexp_replace(F.lower(query), "[^a-z0-9 ]", ""), " +"), lambda w: F.length(w) > 2)
    parts = F.split(text, r"(?m)^(?=#{2,4}[ \t])")
    headed = text.rlike(r"^#{2,4}[ \t]")
    head = F.when(headed, F.lit("")).otherwise(F.regexp_replace(F.element_at(parts, 1), r"^\s+|\s+$", ""))
    sections = F.filter(F.when(headed, parts).otherwise(F.slice(parts, 2, 1_000_000)), lambda s: s != "")
    sections = F.transform(sections, lambda s, i: F.when(i < F.size(sections) - 1, F.regexp_replace(s, r"\n\z", "")).otherwise(s))
    hits = F.filter(sections, lambda s: F.exists(terms, lambda t: F.lower(s).contains(t)))
    omitted = F.size(sections) - F.size(hits)
    note = F.concat(F.lit("_("), omitted.cast("string"), F.when(omitted > 1, " sections").otherwise(" section"), F.lit(" omitted — not matching query)_"))
    whole = (F.size(terms) == 0) | (F.size(sections) <= 1) | (F.size(hits) == 0) | (omitted == 0)
    return F.when(whole, text).otherwise(F.concat_ws("\n\n", head, F.array_join(hits, "\n\n"), note))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def entities(text: Column, most: int = 5) -> Column:
    """Names in a text: snake_case, then PascalCase, then frequent words; none twice, no stop word."""
    plain = F.regexp_replace(text, r"https?://[^ \t\n\r\f\x0B]+", "")
    # The patterns of URLs, names and words
    snakes = F.regexp_extract_all(plain, F.lit("[a-z][a-z0-9]*(?:_[a-z0-9]+)+"), F.lit(0))
    pascals = F.regexp_extract_all(plain, F.lit("[A-Z][a-z]+(?:[A-Z][a-z]+)+"), F.lit(0))
    every = F.filter(F.split(F.lower(F.regexp_replace(plain, "[^a-zA-Z0-9_ \t\n\r\f\x0B-]", " ")), r"[ \t\n\r\f\x0B]+"), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))
    # sorted, equal words stand together: an aggregate over the sorted list counts them without a product of the list with itself
    runs = F.aggregate(
        F.array_sort(every),
        F.struct(F.array().cast("array<struct<n:int,w:string>>").alias("done"), F.lit(0).alias("n"), F.lit("").alias("w")),
        lambda a, w: F.when(a["w"] == w, F.struct(a["done"].alias("done"), (a["n"] + 1).alias("n"), a["w"].alias("w"))).otherwise(
            F.struct(F.array_append(a["done"], F.struct((-a["n"]).alias("n"), a["w"].alias("w"))).alias("done"), F.lit(1).alias("n"), w.alias("w"))
        ),
        lambda a: F.array_append(a["done"], F.struct((-a["n"]).alias("n"), a["w"].alias("w"))),
    )
    top = F.transform(F.slice(F.array_sort(F.filter(runs, lambda r: r["n"] < 0)), 1, 5), lambda r: r["w"])
    named = F.filter(F.concat(snakes, pascals, top), lambda e: (F.length(e) > 2) & ~F.lower(e).isin(STOP_WORDS))
    low = F.transform(named, F.lower)
    return F.slice(F.filter(named, lambda e, i: F.array_position(low, F.lower(e)) == i + 1), 1, most)


# -- personal data ---------------------------------------------------------------------------------------------------------

# Patterns and their replacements, applied in this order
SCRUB = [
    (r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", "[EMAIL]"),
    (r"\b(Bearer\s+)[A-Za-z0-9\-._~+/]+=*\b", "$1[TOKEN]"),
    (r"\b(sk-|xai-|key-)[A-Za-z0-9]{16,}\b", "[API_KEY]"),
    (r"\b(\+1[-.\s]?)?(\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4})\b", "[PHONE]"),
    (r"(?i)(?<!\w)@(?!(param|returns?|throws?|type|example|deprecated|since|see|link|module|class|interface|typedef|property|member|method|static|readonly|override|public|private|protected|async|yields?|description|summary|license|author|file|constructor|extends|implements)\b)[a-z][a-z0-9_]{2,}\b(?!/)", "[MENTION]"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[IP]"),
    (r"\b(Hi|Hello|Hey),?\s+[A-Z][a-z]+\b", "$1"),
    (r"\bghp_[A-Za-z0-9]{36,}\b", "[GH_TOKEN]"),
    (r"\bglpat-[A-Za-z0-9_-]{20,}\b", "[GL_TOKEN]"),
]


def scrub(text: Column, rules=SCRUB) -> Column:
    for pattern, put in rules:
        text = F.regexp_replace(text, ascii_edges(pattern), put)
    return text


def file_paths(text: Column) -> Column:
    """Paths with a directory and an extension, leading dots and slashes cut, none twice."""
    # The patterns of a path and of what it begins with
    found = F.regexp_extract_all(text, F.lit(r"(?:^|[\s`'\"(])([a-zA-Z0-9_\-./]+/[a-zA-Z0-9_\-./]+\.[a-zA-Z]{1,5})(?=[\s`'\":#),]|$)"), F.lit(1))
    paths = F.transform(found, lambda p: F.regexp_replace(p, "^[./]+", ""))
    return F.array_distinct(F.filter(paths, lambda p: (p != "") & ~p.startswith("http") & p.contains("/")))


def tickets(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(ascii_edges(r"\b([A-Z]{2,}-\d+)\b")), F.lit(1)))


# Fixed values below: names, patterns and roles of branches
# -- branches --------------------------------------------------------------------------------------------------------------


def branch_class(name: Column) -> Column:
    return F.when(name.isin("main", "master", "develop", "trunk"), "base").when(name.rlike("(?i)^(demo|staging|prod|production|release)(/.*)?$"), "environment").otherwise("feature")


def branch_target(name: Column) -> Column:
    env = F.lower(F.regexp_extract(name, "(?i)^(demo|staging|prod|production|release)(/.*)?$", 1))
    return F.when(env == "prod", "production").when(env != "", env)


def sync_level(name: Column) -> Column:
    """skip for sandboxes, full for branches that are shared, lightweight for the rest."""
    n = F.lower(F.trim(name))
    skip = n.rlike("^demo/|[-_]demo$|/demo/|^demo$")
    full = n.rlike("^(main|master|develop|development|staging|stage|production|prod|release)$|^(release|hotfix|epic)/")
    return F.when(skip, "skip").when(full, "full").otherwise("lightweight")


def branch_role(name: Column) -> Column:
    n = F.lower(name)
    role = F.when(n.isin("main", "master"), "main").when(n.isin("staging", "stage"), "staging").when(n.isin("develop", "development"), "development")
    return role.when(n.startswith("demo/"), "demo").when(n.rlike("^(feature|fix)/"), "feature").otherwise("unknown")


def branch_hint(name: Column) -> Column:
    """A branch's name in words, without kind and tickets."""
    cut = F.regexp_replace(F.regexp_replace(name, "(?i)^(feature|fix|bugfix|chore|refactor|hotfix|epic)/", ""), ascii_edges(r"(?i)\b[A-Z]{2,10}-\d+\b"), " ")
    hint = F.trim(F.regexp_replace(F.regexp_replace(cut, "[-_/]+", " "), " +", " "))
    return F.when(hint != "", hint).otherwise(F.trim(F.regexp_replace(name, "[-_/]+", " ")))


def epic_of(name: Column) -> Column:
    return F.when(F.lower(name).startswith("epic/"), F.trim(F.regexp_replace(F.regexp_replace(name, "(?i)^epic/", ""), "[-_/]+", " ")))


# -- cards -----------------------------------------------------------------------------------------------------------------


def tier(heat: Column) -> Column:
    return F.when(heat > 0.6, "premium").when(heat > 0.3, "standard").otherwise("structural")


def tier_budget(heat: Column) -> Column:
    return F.when(heat > 0.6, 1500).when(heat > 0.3, 800).otherwise(350)


def embed_prefix(model: Column, task: str) -> Column:
    """Prefix that models of the nomic and e5 kinds want before a text."""
    q = task == "query"
    return F.when(F.lower(model).contains("nomic"), F.lit("search_query: " if q else "search_document: ")).when(F.lower(model).contains("e5"), F.lit("query: " if q else "passage: ")).otherwise(F.lit(""))


def skip_hyde(query: Column) -> Column:
    """Short queries and those that name an identifier are searched as they are."""
    parts = F.split(F.trim(query), r"[ \t\n\r\f\x0B]+")
    return (F.size(parts) < 4) | F.exists(parts, lambda w: w.rlike("[A-Z][a-z]+[A-Z]|[a-z]+_[a-z]+"))
