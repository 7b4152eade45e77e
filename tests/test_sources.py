"""Ignore rules against git itself, and the sink that replaces scopes."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from quillon.sources import files, sinks

RULES = [
    ["*.log", "!keep.log", "/build/", "docs/**/x", "a/*/c", "**/deep", "tail/**", "# note", "", "q?.rb", "[ab]c.py", "[!z]z.go", "\\#odd", "\\!odd", "name with blank ", "!"],
    ["logs/", "!logs/important.txt", "*.TXT", "!docs/*.txt"],
    ["*", "!*/", "!*.rb"],
    ["keep.log", "!keep.log", "keep.log"],
    ["!x.rb", "x.rb", "a/", "!a/b/c"],
]
PATHS = (
    "a.log keep.log src/keep.log build/x src/build/x docs/x docs/a/x docs/a/b/x docs/ax a/b/c a/b/d/c x/a/b/c deep y/deep y/deep/z tail/a tail/b/c tail q1.rb q12.rb ac.py bc.py cc.py zz.go yz.go "
    "#odd !odd logs/important.txt x/logs/a docs/a.txt a.txt B.Txt src/x.rb x.rb a/b/c/d.rb lib/y.rb"
).split() + ["name with blank", "name with blank/x"]


@pytest.mark.parametrize("rules", RULES)
def test_rules_are_git_s(spark, tmp_path, rules):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    (tmp_path / ".gitignore").write_text("\n".join(rules))
    asked = subprocess.run(["git", "-c", "core.ignorecase=true", "-c", "core.quotePath=false", "check-ignore", "--no-index", "--stdin"], cwd=tmp_path, input="\n".join(PATHS), capture_output=True, text=True, check=False)
    want = set(asked.stdout.split("\n")) - {""}
    rows = spark.createDataFrame([(p,) for p in PATHS], "p string")
    assert {r.p for r in rows.filter(files.ignored(F.col("p"), tuple(rules))).collect()} == want


def test_scan_reads_the_file_of_rules(spark, tmp_path):
    for name in ("a.rb", "dist/b.rb", "x/c.rb", "x/d.py", "Gen/e.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("z")
    (tmp_path / ".rules").write_text("x/*\n!x/d.py\n# no\n!dist\n")
    root = f"file://{tmp_path}"
    assert {r.path for r in files.scan(spark, root).collect()} == {"a.rb", "x/c.rb", "x/d.py", "Gen/e.py"}
    assert {r.path for r in files.scan(spark, root, ("gen/",), ".rules").collect()} == {"a.rb", "dist/b.rb", "x/d.py"}


def held(spark, folder):
    return sorted(((r.repo, r.x) for r in spark.read.parquet(folder).collect()), key=str)


def test_replacing_scopes(spark, tmp_path):
    folder = f"file://{tmp_path}/edges"
    rows = lambda *x: spark.createDataFrame(list(x), "repo string, x int")
    sinks.replace_scopes(rows(("a", 1), ("a", 2), ("b/ c", 3), (None, 4)), folder, "repo", ["a", "b/ c", None])
    first = held(spark, folder)
    assert first == sorted([("a", 1), ("a", 2), ("b/ c", 3), (None, 4)], key=str)
    sinks.replace_scopes(rows(("a", 9)), folder, "repo", ["a"])
    sinks.replace_scopes(rows(("a", 9)), folder, "repo", ["a"])  # a rerun changes nothing
    assert held(spark, folder) == sorted([("a", 9), ("b/ c", 3), (None, 4)], key=str)
    with pytest.raises(Exception, match="not among the scopes"):
        sinks.replace_scopes(rows(("a", 10), ("d", 1)), folder, "repo", ["a"])
    broken = rows(("a", 11)).withColumn("x", F.raise_error(F.lit("task failed")).cast("int"))
    with pytest.raises(Exception, match="task failed"):
        sinks.replace_scopes(broken, folder, "repo", ["a"])
    assert held(spark, folder) == sorted([("a", 9), ("b/ c", 3), (None, 4)], key=str)
    sinks.replace_scopes(rows().limit(0), folder, "repo", ["b/ c", "unknown"])
    assert held(spark, folder) == sorted([("a", 9), (None, 4)], key=str) and not os.path.exists(f"{tmp_path}/edges/repo=b%2F c")
