"""Imports of a source tree resolved to its files: relative paths, Go package directories, Python dotted names, Ruby suffixes.

Every rule is a join by equality. Files are indexed under what an import can name them by (their path without extension, their
directory's name, each suffix of their path), only names that are asked for are kept, and of the files under one name the two
that come first: one may be the importing file itself. So a name that thousands of files share gives two rows, not pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.lineage import cut
from quillon.session import table

# Extensions that a path may lack in an import
BARE = r"\.(js|ts|jsx|tsx|vue|rb|py|go)$"


def bare(path: Column) -> Column:
    return F.regexp_replace(path, BARE, "")


def relative(path: Column, source: Column) -> Column:
    """source against the directory of path: `.` falls away, `..` takes the segment before it."""
    steps = F.split(F.concat(F.regexp_replace(path, "/[^/]+$", ""), F.lit("/"), source), "/")
    step = lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.array_append(acc, s))
    return bare(F.array_join(F.aggregate(steps, F.array().cast("array<string>"), step), "/"))


def asked_names(imports: DataFrame) -> DataFrame:
    """imports with a row for each name (kind, scope, name) under which the wanted file may stand; others fall away."""
    name = lambda kind, scope, value: F.struct(F.lit(kind).alias("kind"), scope.alias("scope"), value.alias("name"))
    source, repo = F.col("source"), F.col("repo")
    dotted = F.replace(source, F.lit("."), F.lit("/"))
    names = (
        F.when(source.startswith("."), F.array(name("path", F.lit(""), relative(F.col("path"), source))))
        .when((F.col("language") == "go") & source.contains("/"), F.array(name("folder", repo, F.element_at(F.split(source, "/"), -1))))
        .when((F.col("language") == "python") & source.contains("."), F.array(name("suffix", repo, dotted), name("suffix", repo, F.concat(dotted, F.lit("/__init__")))))
        .when((F.col("language") == "ruby") & source.contains("/"), F.array(name("suffix", repo, source)))
    )
    return imports.select("repo", "path", "source", F.explode(names).alias("n")).select("repo", "path", "source", "n.*")


def indexed(files: DataFrame) -> DataFrame:
    """(kind, scope, name, file, ordinal): every name of every file (repo, path, ordinal)."""
    short = bare(F.col("path"))
    name = lambda kind, scope: lambda value: F.struct(F.lit(kind).alias("kind"), scope.alias("scope"), value.alias("name"))
    parts = F.split("path", "/")
    folder = F.when(F.size(parts) > 1, F.array(name("folder", F.col("repo"))(F.element_at(parts, F.when(F.size(parts) > 1, -2).otherwise(-1))))).otherwise(F.array())
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.length(short), F.lit(1))), lambda k: name("suffix", F.col("repo"))(short.substr(k, F.length(short))))
    names = F.concat(F.array(name("path", F.lit(""))(short)), folder, ends)
    return files.select(F.col("path").alias("file"), "ordinal", F.explode(names).alias("n")).select("n.*", "file", "ordinal")


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, path, source, file): for each import (repo, path, language, source) the first file by ordinal that its rule names.

    A relative path may lead to the importing file itself and into another repository; the other rules do neither.
    """
    wanted = cut(asked_names(imports).distinct())
    names = ["kind", "scope", "name"]
    held = indexed(files).join(wanted.select(names).distinct(), names, "left_semi").groupBy(*names, "file").agg(F.min("ordinal").alias("ordinal"))
    first = held.withColumn("place", F.row_number().over(Window.partitionBy(*names).orderBy("ordinal", "file"))).filter("place <= 2")
    hits = wanted.join(first, names).filter((F.col("kind") == "path") | (F.col("file") != F.col("path")))
    return hits.groupBy("repo", "path", "source").agg(F.min(F.struct("ordinal", "file"))["file"].alias("file"))


# -- registered queries --------------------------------------------------------------------------------------------------


def _files(s, d) -> DataFrame:
    """Documents as files: their first words are directories and name, so that near copies share names; a repository a language."""
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")
    k = (F.col("doc_id") % 4).cast("int")
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), k + 1)
    name = F.array_join(F.slice(words, 1, 2), "/")
    stem = F.when(F.col("doc_id") % 13 == 0, F.concat(name, F.lit("/__init__"))).otherwise(F.concat(name, F.lit("/"), F.coalesce(F.try_element_at(words, F.lit(3)), F.lit("main"))))
    return table(s, d, "documents").filter(F.size(words) >= 2).select(
        F.col("lang").alias("repo"), F.col("doc_id").alias("ordinal"), pick("python", "go", "ruby", "typescript").alias("language"), stem.alias("short"), F.concat(stem, pick(".py", ".go", ".rb", ".ts")).alias("path")
    )


def _imports(s, d) -> DataFrame:
    """Each file imports the one four numbers on, by its language's rule: whole segments or, of every third, less a first letter."""
    files = cut(_files(s, d))
    other = files.select((F.col("ordinal") - 4).alias("ordinal"), F.col("short").alias("target"))
    two = F.substring_index(F.col("target"), "/", -2)
    two = F.when(F.col("ordinal") % 3 == 0, F.substring(two, 2, 10_000)).otherwise(two)
    leaf = F.substring_index(F.col("target"), "/", -1)
    source = (
        F.when(F.col("language") == "python", F.replace(F.regexp_replace(two, "/__init__$", ""), F.lit("/"), F.lit(".")))
        .when(F.col("language") == "go", F.concat(F.lit("example.org/"), F.element_at(F.split("target", "/"), -2)))
        .when(F.col("language") == "ruby", two)
        .otherwise(F.when(F.col("ordinal") % 3 == 0, F.concat(F.lit("./"), leaf)).otherwise(F.concat(F.lit("../../"), F.col("target"))))
    )
    return files.join(other, "ordinal").select("repo", "path", "language", source.alias("source")).distinct()


QUERIES = {"import_rules": lambda s, d: resolve(_imports(s, d), _files(s, d))}

_FILES = r"""f AS MATERIALIZED (SELECT lang AS repo, doc_id AS ordinal, ['python', 'go', 'ruby', 'typescript'][doc_id % 4 + 1] AS language, short, short || ['.py', '.go', '.rb', '.ts'][doc_id % 4 + 1] AS path
 FROM (SELECT *, w[1] || '/' || w[2] || '/' || CASE WHEN doc_id % 13 = 0 THEN '__init__' ELSE coalesce(w[3], 'main') END AS short FROM (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) >= 2)),
t AS (SELECT f.*, string_split(o.short, '/') AS s, CASE WHEN f.ordinal % 3 = 0 THEN 1 ELSE 0 END AS less FROM f JOIN f AS o ON o.ordinal = f.ordinal + 4),
u AS (SELECT *, substr(s[-2] || '/' || s[-1], less + 1) AS two FROM t),
i AS MATERIALIZED (SELECT DISTINCT repo, path, language, CASE language WHEN 'python' THEN replace(regexp_replace(two, '/__init__$', ''), '/', '.') WHEN 'go' THEN 'example.org/' || s[-2] WHEN 'ruby' THEN two ELSE CASE WHEN less = 1 THEN './' || s[-1] ELSE '../../' || array_to_string(s, '/') END END AS source FROM u),
n AS MATERIALIZED (SELECT *, array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(regexp_replace(path, '/[^/]+$', '') || '/' || source, '/'), lambda x: [x])), lambda a, x: CASE x[1] WHEN '..' THEN a[:len(a) - 1] WHEN '.' THEN a ELSE a || x END), '/') AS whole FROM i),
h AS (SELECT n.repo, n.path, source, f.path AS file, ordinal FROM n JOIN f ON CASE
 WHEN starts_with(source, '.') THEN f.short = regexp_replace(whole, '\.(js|ts|jsx|tsx|vue|rb|py|go)$', '')
 WHEN f.repo <> n.repo OR f.path = n.path THEN false
 WHEN n.language = 'go' AND contains(source, '/') THEN string_split(f.path, '/')[-2] = string_split(source, '/')[-1]
 WHEN n.language = 'python' AND contains(source, '.') THEN ends_with(f.short, replace(source, '.', '/')) OR ends_with(f.short, replace(source, '.', '/') || '/__init__')
 WHEN n.language = 'ruby' AND contains(source, '/') THEN ends_with(f.short, source) ELSE false END)"""
SQL = {"import_rules": f"WITH {_FILES} SELECT repo, path, source, arg_min(file, ordinal) AS file FROM h GROUP BY ALL"}
