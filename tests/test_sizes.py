"""Queries on small tables that are built like large ones: many keys, hot keys, long chains."""

import brute
import duckdb
import oracle
from pyspark.sql import functions as F

from quillon import catalog
from quillon.operators import conversations, naming, services, topology
from quillon.plans import lineage


def agrees(spark, folder, name, **tables):
    """The query against its SQL over the given Arrow tables."""
    import pyarrow.parquet as pq

    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(rows, f"{folder}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    assert oracle.difference(catalog.queries()[name], catalog.oracle_sql()[name], spark, str(folder), con) is None


def lines(pairs):
    import pyarrow as pa

    part, supplier = zip(*pairs, strict=True)
    n = range(len(pairs))
    return pa.table({"l_orderkey": pa.array(n, pa.int64()), "l_partkey": pa.array(part, pa.int64()), "l_suppkey": pa.array(supplier, pa.int64()), "l_linenumber": pa.array([3 * k % 7 for k in n], pa.int32())})


def test_a_part_with_the_number_of_a_suppliers_file(spark, tmp_path):
    agrees(spark, tmp_path, "edges_weighted", lineitem=lines([(1_000_005, 5), (1_000_005, 6), (5, 5), (1_000_000, 0), (7, 5)]))


def most_rows(frame):
    """The most rows that an operator of the executed plan gave out, and the frame's rows."""
    rows, most, todo = frame.collect(), 0, [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        todo += [node.children().apply(k) for k in range(node.children().size())]
        if node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
    return most, rows


def test_hubs_of_one_name(spark):
    hubs = spark.range(400).select(F.concat(F.lit("a/"), "id").alias("path"), F.lit("old_large_ring").alias("name"))
    seeds = spark.createDataFrame([("Large Ring", 5), ("Ring", 3), ("Old", 4), ("Bolt", 1), ("Ring", 9)], "flow string, place long")
    members = spark.createDataFrame([("a/1", "Ring"), ("a/2", "Ring"), ("a/2", "Old"), ("a/3", "Old"), ("a/4", "Ring"), ("a/4", "Old"), ("a/4", "Large Ring"), ("a/5", "Bolt")], "path string, flow string")
    most, rows = most_rows(topology.absorbed_hubs(hubs, seeds, members))
    got = {r.path: r.flow for r in rows}
    assert len(rows) == len(got) == 399 and [got.get(f"a/{k}") for k in range(6)] == ["Ring", "Old", "Large Ring", "Ring", None, "Ring"]
    assert most < 2000


def test_routes_and_files_of_one_name(spark):
    k = F.col("id")
    routes = spark.range(300).select(F.lit(1).alias("repo"), F.concat(F.lit("r"), k).alias("path"), F.when(k == 0, "b/users").when(k == 1, "users").when(k == 2, "sers").otherwise("admin/users").alias("controller"), k.alias("route"))
    files = spark.range(300).select(F.lit(1).alias("repo"), k.alias("place"), F.concat(F.when(k == 7, "b/users").otherwise(F.concat(k, F.lit("/admin/users"))), F.lit("_controller.rb")).alias("path"))
    most, rows = most_rows(services.route_controllers(routes, files))
    got = {r.src: r.dst for r in rows}
    first = "0/admin/users_controller.rb"
    assert len(rows) == len(got) == 299 and got == {"r0": "b/users_controller.rb"} | {f"r{j}": first for j in range(1, 300) if j != 2}
    assert most < 6000


def test_keys_of_paths_do_not_pass_through_the_driver(spark, sf):
    plan = catalog.queries()["component_seeds"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_insights_meet_kept_ones_only(spark, monkeypatch):
    import numpy as np

    written, cut = [], conversations.cut
    monkeypatch.setattr(conversations, "cut", lambda df: (out := cut(df), written.append(out.count()))[0])
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 8))[rng.integers(0, 12, 700)] + rng.normal(size=(700, 8)) * 0.2
    rows = spark.createDataFrame([(k, x[k].tolist(), k % 2) for k in range(700)], "id long, embedding array<double>, grp int")
    sims = np.round(x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)), 9)
    kept, want = [], {}
    for k in range(700):
        s, j = max(((sims[k, j], -j) for j in kept if j % 2 == k % 2), default=(0, 0))
        want[k] = -j if s > 0.6 else k
        kept += [k] if s <= 0.6 else []
    assert {r.id: r.same_as for r in conversations.first_insights(rows, "grp", 0.6).collect()} == want
    assert max(written) < 700
    few = conversations.kept_insights(rows, 0.6, first=5, block=100).collect()  # many rounds of many blocks
    assert sorted(r.id for r in few) == kept


def test_numbers_behind_a_barred_one_move_together(spark, monkeypatch):
    """One name with a number before all, some among and some behind the rows that come to numbers."""
    written, cut = [], naming.cut
    monkeypatch.setattr(naming, "cut", lambda df: (written.append(1), cut(df))[1])
    base = {0: "a_2", 30: "a_9", 31: "a_31", 32: "a_32", 45: "a_50", 59: "a_58", 60: "a_60", 33: "a_02", 34: "a_1"}
    rows = [(k, k, base.get(k, "a"), ["a/b/" + ("12.rb" if k == 20 else "9.rb" if k == 50 else "x")]) for k in range(64)]
    used, want = set(), {}
    for k, _, b, paths in rows:
        more = [x.removesuffix(".rb") for x in paths[0].split("/") if len(x) > 2]
        tries = [b, *(f"{b}_{m}" for m in more), *(f"{b}_{n}" for n in range(2, 99))]
        want[k] = next(t for t in tries if t not in used)
        used.add(want[k])
    got = naming.unlike_names(spark.createDataFrame(rows, "id long, no long, base string, paths array<string>")).collect()
    assert {r.id: r.name for r in got} == want and len(got) == 64
    assert len(written) < 40


def test_labels_that_want_the_same_folders(spark, monkeypatch):
    written, cut = [], naming.cut
    monkeypatch.setattr(naming, "cut", lambda df: (written.append(1), cut(df))[1])
    rows = [(f"L{a}", a, f"F{b}", b, 3 + (a * b % 7 == 6)) for a in range(30) for b in range(40)]
    used, want = set(), set()
    for label, a, folder, b, score in sorted(rows, key=lambda r: (-r[4], r[1], r[3])):
        if not {label, folder} & used:
            used |= {label, folder}
            want.add((label, folder, score))
    pairs = spark.createDataFrame(rows, "label string, label_no long, folder string, folder_no long, score int")
    assert {tuple(r) for r in naming.greedy(pairs).collect()} == want and len(written) < 8
    assert {tuple(r) for r in naming.greedy(pairs, first=100).collect()} == want


def test_pairs_of_words_in_the_path(spark):
    labels = spark.createDataFrame([("one two six", 1), ("one two abc", 2), ("longestword x", 3), ("longestwork x", 4), ("a b", 5), ("six six six", 6), ("one two", 7)], "label string, label_no long")
    folders = spark.createDataFrame([("src/one/two-six/x", 1), ("one/twosix/AB", 2), ("c/MyLongestWords", 3), ("six/one/y", 4)], "folder string, folder_no long")
    got = [(r.label_no, r.folder_no, r.score) for r in naming.label_pairs(labels, folders).collect()]
    every = [(a, b, brute._label_score(y, x)) for x, a in labels.collect() for y, b in folders.collect()]
    assert sorted(got) == sorted(p for p in every if p[2] >= 3) and {(1, 2, 3), (5, 2, 10), (6, 4, 3)} <= set(got)


def test_rounds_of_communities_leave_few_tables(spark, sf):
    from pathlib import Path

    folder = Path(lineage.shared_folder(spark).removeprefix("file://"))
    before = set(folder.glob("cut-*"))
    assert catalog.queries()["louvain"](spark, sf).count() > 1
    assert len(set(folder.glob("cut-*")) - before) <= 8
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
