"""Closed-form expectations of single operators on literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as fn
from quillon.operators import conversations as conv
from quillon.operators import freshness, graph, metrics, relational, retrieval, topology
from quillon.sources import files
from quillon.streaming import changes


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [
    ("https://a.b/c", ""), ("AND or Not near", ""), ("a b see", "see"), ("ActivityPub::ActorSerializer", "Activity OR Pub OR Actor OR Serializer"),
    (" ".join(f"w{k}" for k in range(40)), " OR ".join(f"w{k}" for k in range(30))),
])
def test_fts_query(spark, text, want):
    assert one(spark, fn.fts_query(F.col("t")), t=text) == want


@pytest.mark.parametrize(("path", "want"), [("a/./b/../c", "a/c"), ("../x", "x"), ("a//b/", "a/b")])
def test_normal_path(spark, path, want):
    assert one(spark, fn.normal_path(F.col("p")), p=path) == want


@pytest.mark.parametrize(("path", "want"), [
    ("spec/models/user.rb", "test"), ("app/helpers/x.rb", "domain"), ("test/helpers/x.rb", "test"), ("a/b.test.ts", "test"), ("config/routes.rb", "config"),
    ("app/index.ts", "entry_point"), ("src/index.ts", "domain"), ("x/package.json", "config"), ("db/migrations/1.rb", "config"), ("app/models/user.rb", "domain"),
])
def test_file_role(spark, path, want):
    assert one(spark, graph.file_role(F.col("p")), p=path) == want


@pytest.mark.parametrize(("name", "want"), [("demo/x", "skip"), ("main", "full"), ("feature/x", "lightweight"), ("epic/demo-x", "full"), ("x-demo", "skip"), ("odd", "lightweight")])
def test_sync_level(spark, name, want):
    assert one(spark, fn.sync_level(F.col("n")), n=name) == want


@pytest.mark.parametrize(("heat", "want"), [(0.61, "premium"), (0.31, "standard"), (0.3, "structural")])
def test_tier(spark, heat, want):
    assert one(spark, fn.tier(F.col("h")), h=heat) == want


@pytest.mark.parametrize(("text", "want"), [
    ("mail me@x.org now", "mail [EMAIL] now"), ("Bearer abc.def", "Bearer [TOKEN]"), ("sk-" + "a" * 20, "[API_KEY]"), ("call 415-555-1234", "call [PHONE]"),
    ("ping @someone ok", "ping [MENTION] ok"), ("@param x", "@param x"), ("@angular/core", "@angular/core"), ("10.0.0.1", "[IP]"), ("Hi Anna, ok", "Hi, ok"), ("ghp_" + "a" * 36, "[GH_TOKEN]"),
])
def test_scrub(spark, text, want):
    assert one(spark, fn.scrub(F.col("t")), t=text) == want


def test_names(spark):
    assert one(spark, fn.snake(F.col("t")), t="HTTPServerName-x") == "http_server_name_x"
    assert one(spark, fn.pascal(F.col("t")), t="user_account") == "UserAccount"
    assert [one(spark, fn.singular(F.col("t")), t=w) for w in ("stories", "boxes", "users", "class", "sheep")] == ["story", "box", "user", "class", "sheep"]
    assert one(spark, fn.entities(F.col("t")), t="use UserCard and user_card with cards cards") == ["user_card", "UserCard", "cards", "use", "usercard"][:1] + ["UserCard", "cards", "use"]
    assert one(spark, fn.file_paths(F.col("t")), t="see ./app/models/a.rb, `b/c.ts` and http://x/y.z") == ["app/models/a.rb", "b/c.ts"]
    assert one(spark, fn.short_path(F.col("t")), t="/home/me/repo/src/a/b.ts") == "repo/src/a/b.ts"
    assert one(spark, relational.mask_key(F.col("t")), t="sk-1234567890abcd") == "sk-1234" + "•" * 8 + "abcd"
    assert one(spark, fn.branch_hint(F.col("t")), t="feature/AB-12-new_card") == "new card"


def test_sections(spark):
    text = "Head\n\n## One\nalpha\n## Two\nbeta\n### Three\nalpha beta"
    got = one(spark, fn.trim_sections(F.col("t"), F.col("q")), t=text, q="gamma beta")
    assert got == "Head\n\n## Two\nbeta\n\n### Three\nalpha beta\n\n_(1 section omitted — not matching query)_"
    assert one(spark, fn.trim_sections(F.col("t"), F.col("q")), t=text, q="zz") == text


def test_rrf_and_fusion(spark):
    sem = spark.createDataFrame([("q", 1, 0.1), ("q", 2, 0.3)], "query_id string, id long, distance double")
    kw = spark.createDataFrame([("q", 1, -5.0), ("q", 3, -1.0)], "query_id string, id long, rank double")
    got = {r.id: r for r in retrieval.fuse(sem, kw).collect()}
    assert got[1].source == "both" and got[1].rrf == pytest.approx(2 / 60) and got[1].weighted == pytest.approx(0.75 * 2 / 60 + 0.25)
    assert got[2].rrf == pytest.approx(1 / 61) and got[3].source == "keyword" and got[3].weighted == pytest.approx(0.75 / 61)
    cards = spark.createDataFrame([(1, "hub", 0, None, "r"), (2, "flow", 7, 1.0, "r"), (3, "flow", 0, 0.0, "s")], "id long, card_type string, usage_count long, specificity double, repo string")
    scored = {r.id: r.score for r in retrieval.fused_score(retrieval.fuse(sem, kw), cards).collect()}
    assert scored[1] == pytest.approx(0.4 * got[1].weighted, abs=1e-6) and scored[2] == pytest.approx(got[2].weighted * (1 + 0.05 * math.log2(8)), abs=1e-6)


def test_mmr(spark):
    rows = [("q", 1, 1.0, [1.0, 0.0]), ("q", 2, 0.99, [1.0, 0.0]), ("q", 3, 0.9, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "query_id string, id long, score double, embedding array<double>")
    assert [r.id for r in retrieval.mmr(df, 2).orderBy("place").collect()] == [1, 3]
    assert [r.id for r in retrieval.mmr(df, 3).orderBy("place").collect()] == [1, 2, 3]


def test_empty_log_has_no_division(spark):
    rows = spark.createDataFrame([], "ts timestamp_ntz, dev long, query string, hit boolean, latency double, event_type string")
    got = metrics.totals(rows).first()
    assert (got.queries, got.hits, got.hit_rate) == (0, 0, 0.0)


def test_edge_weights(spark):
    rows = [("a", "b", "import", "domain", "shared_utility", 0), ("a", "b", "import", "domain", "domain", 1), ("t", "b", "import", "test", "domain", 2), ("a", "c", "model_association", "domain", "entry_point", 3), ("e", "b", "route_controller", "entry_point", "domain", 4)]
    got = {(r.src, r.dst, r.relation): r.weight for r in graph.weighted_edges(spark.createDataFrame(rows, "src string, dst string, relation string, src_role string, dst_role string, ordinal int")).collect()}
    assert got == {("a", "b", "import"): 0.1, ("e", "b", "route_controller"): 4.0}


def test_communities_beat_label_propagation(spark):
    edges = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "abc" for i in range(6) for j in range(i)] + [("a0", "b0", 1.0), ("b1", "c0", 1.0)]
    e = spark.createDataFrame(edges, "src string, dst string, weight double")
    q = graph.modularity(e, graph.communities(e)).first().modularity
    assert q > 0.5 and q >= graph.modularity(e, graph.label_propagation(e), "label").first().modularity - 1e-9


def test_pagerank_sums_to_one(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 1.0), ("c", "d", 1.0)], "src string, dst string, weight double")
    assert graph.pagerank(e, 12).agg(F.sum("rank")).first()[0] == pytest.approx(1)


def test_doc_rules(spark):
    rows = [("r", "app/models/user.rb"), ("r", "style.css"), ("s", "package.json"), ("s", "notes.txt")]
    got = {(r.repo, r.doc_type) for r in freshness.invalidate_docs(spark.createDataFrame(rows, "repo string, path string"), True).collect()}
    assert got == {("r", k) for k in ("about", "architecture", "rules", "specialist", "styles", "changelog")} | {("s", "readme")}


def test_linked_within_window(spark):
    t = spark.sql("SELECT 1 AS id, 'u' AS k, timestamp'2024-01-10' AS ts UNION ALL SELECT 2, 'v', timestamp'2024-01-10'")
    c = spark.sql("SELECT 7 AS id, 'u' AS k, timestamp'2024-01-16' AS ts UNION ALL SELECT 8, 'u', timestamp'2024-01-04' UNION ALL SELECT 9, 'v', timestamp'2024-01-18'")
    assert [(r.id, r.commit_id) for r in conv.linked(t, c, "k", 7 * 86400).collect()] == [(1, 8)]


def test_first_insights(spark):
    rows = [(1, [1.0, 0.0], "g"), (2, [0.99, 0.1], "g"), (3, [0.0, 1.0], "g"), (4, [1.0, 0.0], "h")]
    got = {r.id: r.same_as for r in conv.first_insights(spark.createDataFrame(rows, "id long, embedding array<double>, grp string"), "grp").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_insights_are_checked(spark):
    rows = [("t", '{"category":"c","statement":"s","evidence_quote":"abc","scope":"x","confidence":0.5}'), ("t", '{"category":"c","statement":"s","evidence_quote":"zzz","scope":"x","confidence":0.5}'), ("t", '{"category":"c","statement":"","evidence_quote":"abc","scope":"x","confidence":0.5}'), ("t", "no json")]
    good = conv.valid_insights(spark.createDataFrame(rows, "k string, j string"), "j")
    assert good.count() == 2 and conv.quoted(good, spark.createDataFrame([("t", "xx abc yy")], "k string, raw string"), "k").count() == 1


def test_parsers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a" / "m.py").write_text("import os\nfrom x.y import z\n@app.route\nclass A(Base):\n    def f(self): pass\n    async def _g(self): pass\n")
    (tmp_path / "a" / "n.go").write_text('package n\nimport (\n "fmt"\n)\ntype T struct {}\nfunc (t *T) Run() {}\nfunc help() {}\n')
    (tmp_path / "a" / "u.rb").write_text("class User < Base\n  has_many :posts\n  def name?\n  end\nend\nget '/x', to: 'u#x'\n")
    (tmp_path / "a" / "v.vue").write_text("<template></template><script>import a from './a'\nexport const go = () => 1\nclass B extends C {}\naxios.get('/api/x')\n</script>")
    (tmp_path / "node_modules" / "z.py").write_text("def no(): pass")
    rows = {r.path: r for r in files.scan(spark, f"file://{tmp_path}", ("*.tmp",)).withColumns({"py": files.parse_python(F.col("content")), "go": files.parse_go(F.col("content")), "rb": files.parse_ruby(F.col("content")), "js": files.parse_script(F.col("content"))}).collect()}
    assert set(rows) == {"a/m.py", "a/n.go", "a/u.rb", "a/v.vue"}
    py, go, rb, js = rows["a/m.py"].py, rows["a/n.go"].go, rows["a/u.rb"].rb, rows["a/v.vue"].js
    assert [(c.name, c.parent) for c in py.classes] == [("A", "Base")] and [(f.name, f.visibility) for f in py.functions] == [("f", "public"), ("_g", "private")] and py.imports == ["x.y", "os"] and py.decorators == ["app.route"]
    assert [(f.name, f.visibility) for f in go.functions] == [("T.Run", "public"), ("help", "private")] and go.imports == ["fmt"] and [c.kind for c in go.classes] == ["struct"]
    assert [(a.type, a.target) for a in rb.associations] == [("has_many", "posts")] and rb.functions == ["name?"] and [(r.method, r.path) for r in rb.routes] == [("GET", "/x")]
    assert js.functions == ["go"] and js.imports == ["./a"] and [(c.name, c.parent) for c in js.classes] == [("B", "C")] and [(c.method, c.path) for c in js.api_calls] == [("GET", "/api/x")]


def test_ignore_and_stack(spark):
    assert [one(spark, files.ignored(F.col("p"), ("/build/", "*.min.js", "docs/**/x")), p=p) for p in ("build/a", "src/build/a", "a/b.min.js", "docs/a/b/x", "docs/a/y")] == [True, False, True, True, False]
    rows = [("a", "package.json"), ("a", "Gemfile"), ("b", "pom.xml"), ("c", "x")]
    assert {r.repo: r.language for r in files.stack(spark.createDataFrame(rows, "repo string, file string")).collect()} == {"a": "ruby", "b": "java", "c": "unknown"}


def test_watched_changes(spark):
    rows = [("r", "a/x.rb", None, "modified", "c"), ("r", "b/y.rb", "b/old.rb", "renamed", "d"), ("r", "x.log", None, "added", "e"), ("r", ".git/h.rb", None, "added", "f")]
    df = spark.createDataFrame(rows, "repo string, path string, old_path string, status string, content string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert {(r.path, r.status) for r in changes.watched(df, ("rb",)).collect()} == {("a/x.rb", "modified"), ("b/old.rb", "deleted"), ("b/y.rb", "added")}


def test_forced_flush(spark, sf):
    rows = changes.stream(spark, sf, "events").select(F.lit("r").alias("repo"))
    got = changes.finished(changes.forced(rows, 300, None)).collect()
    assert sum(r.n for r in got if r.why == "full") == spark.read.parquet(f"{sf}/events.parquet").count() // 300 * 300


def test_streams_take_many_files_out_of_time_order(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").repartition(20, "event_id").write.parquet(f"file://{tmp_path}/events.parquet")
    for name in ("stream_debounce", "stream_latest_status", "stream_rate_windows"):
        one, many = (sorted(map(tuple, changes.QUERIES[name](spark, d).collect())) for d in (sf, str(tmp_path)))
        assert one and many == one


def test_upsert_keeps_locked(spark):
    old = spark.createDataFrame([("a", 1, True), ("b", 1, False)], "k string, at int, locked boolean")
    new = spark.createDataFrame([("a", 2, False), ("b", 2, False), ("c", 2, False)], "k string, at int, locked boolean")
    got = {(r.k, r.at) for r in relational.upsert_latest(old, new, ["k"], "at", "locked").collect()}
    assert got == {("a", 1), ("b", 2), ("c", 2)}


def test_insights_one_after_another(spark, sf):
    import numpy as np

    from quillon.operators.conversations import first_insights
    from quillon.session import table

    rows = table(spark, sf, "embeddings").selectExpr("vec_id AS id", "embedding", "label % 2 AS grp").orderBy("vec_id").limit(40)
    own = sorted(rows.collect(), key=lambda r: r.id)
    want, kept = {}, []
    for r in own:
        x = np.array(r.embedding, float)
        sims = [(round(float(x @ np.array(k.embedding, float) / np.linalg.norm(x) / np.linalg.norm(k.embedding)), 9), -k.id) for k in kept if k.grp == r.grp]
        best = max(sims, default=(0, 0))
        want[r.id] = -best[1] if best[0] > 0.15 else r.id
        if want[r.id] == r.id:
            kept.append(r)
    got = {r.id: r.same_as for r in first_insights(rows, "grp", 0.15).collect()}
    assert got == want and len(kept) < len(own)


def test_percentiles_of_one_large_group(spark):
    import random

    from quillon.operators.metrics import latency_percentiles

    random.seed(1)
    rows = [("a", random.choice([random.random(), 0.5])) for _ in range(5000)] + [("b", 1.0)]
    got = {r.key: r for r in latency_percentiles(spark.createDataFrame(rows, "key string, value double"), "key", "value").collect()}
    own = sorted(v for k, v in rows if k == "a")
    assert (got["a"].p50, got["a"].p95, got["a"].p99, got["a"].n) == (own[2500], own[4750], own[4950], 5000) and got["b"].p50 == 1.0


@pytest.mark.parametrize(("path", "want"), [
    ("web/src/components/Billing/Office/x.tsx", "Billing/Office"), ("src/pages/x.tsx", None), ("src/components/shared/x.tsx", None), ("src/components/a.b/views/C/x.ts", "C"),
    ("src/components/x.ts", None), ("src/components/x/views/Y/z.ts", "x/views/Y"), ("a/components/hooks/features/Cart/z.ts", "Cart"),
])
def test_component_dir(spark, path, want):
    assert one(spark, topology.component_dir(F.col("p")), p=path) == want


@pytest.mark.parametrize(("word", "want"), [("policies", "policy"), ("boxes", "box"), ("classes", "class"), ("access", "access"), ("wishes", "wishe"), ("cards", "card")])
def test_singular_of_routes(spark, word, want):
    assert one(spark, fn.singular(F.col("w"), "routes"), w=word) == want


def test_component_seeds(spark):
    front = spark.createDataFrame([("web/src/components/OfficeAuths/a.tsx", "web"), ("web/src/views/shop/OfficeAuths/b.tsx", "web")], ["path", "repo"])
    back = ["app/models/in_office_auth.rb", "app/services/office_auths_sync/x.rb", "app/presenters/office_auth_view.rb", "app/models/office.rb", "app/controllers/office_auths/list.rb"]
    got = topology.component_seeds(front, spark.createDataFrame([(b, "core") for b in back], ["path", "repo"]))
    assert {(r.flow, r.path) for r in got.collect()} == {("Office Auths", p) for p in ["web/src/components/OfficeAuths/a.tsx", "web/src/views/shop/OfficeAuths/b.tsx", *(b for b in back if b != "app/models/office.rb")]}


def test_community_name_order(spark):
    members = spark.createDataFrame([(f, k, f"app/{'api/' + seg + '/' if seg else ''}f-{f}{k}.rb") for f, k, seg in [(1, 0, "cards"), (1, 1, "bills"), (2, 0, "v1_2"), (3, 0, None), (4, 0, "v1")]], "flow long, place long, path string")
    files = spark.createDataFrame([("app/api/v1/f-40.rb", "ruby", "HTTPCall", 0)], "path string, language string, class_name string, associations int")
    functions = spark.createDataFrame([("app/api/v1_2/f-20.rb", 0, "show", "public"), ("app/api/v1_2/f-20.rb", 1, "export", "public")], "path string, turn int, name string, visibility string")
    got = {r.flow: r.name for r in topology.community_names(members, files, functions).collect()}
    assert got == {1: "cards", 2: "export", 3: "f_30", 4: "http_call"}


def test_frameworks_are_detected_and_type_classes(spark):
    from quillon.operators.frameworks import detected, retyped

    files = [("a", "Gemfile", ""), ("b", "web/package.json", '{"devDependencies": {"react": "1"}}'), ("c", "package.json", "{"), ("d", "svc/requirements-dev.txt", ""), ("e", "x.go", None)]
    got = {(r.repo, r.framework) for r in detected(spark.createDataFrame(files, "repo string, path string, content string")).collect()}
    assert got == {("a", "rails"), ("b", "express"), ("b", "react"), ("c", "express"), ("d", "django")}

    kind = "repo string, path string, language string, content string, functions array<string>, exports array<string>, stores int, classes array<struct<name:string,parent:string,type:string>>"
    rows = [
        ("a", "/app/jobs/x.rb", "ruby", "", [], [], 0, [("X", None, "other"), ("Y", "FooController", "other"), ("Z", None, "store")]),
        ("b", "/src/pages/Home.jsx", "javascript", "", ["f"], [], 0, []),
        ("b", "/src/pages/Card.jsx", "javascript", "", ["f"], ["Card"], 0, []),
        ("b", "/src/hooks/useX.js", "javascript", None, ["useX"], [], None, []),
        ("b", "/src/any.js", "javascript", "@Controller('u') class U {}", [], [], 2, [("U", None, "other")]),
        ("e", "/app/models/m.rb", "ruby", "", [], [], 0, [("M", "ApplicationRecord", "other")]),
        ("e", "/n.rb", "ruby", "", [], [], 0, None),
    ]
    active = spark.createDataFrame([("a", "rails"), ("b", "express"), ("b", "react")], "repo string, framework string")
    got = {r.path: None if r.classes is None else [(c.name, c.type) for c in r.classes] for r in retyped(spark.createDataFrame(rows, kind), active).collect()}
    assert got["/app/jobs/x.rb"] == [("X", "job"), ("Y", "controller"), ("Z", "store")]
    assert got["/src/pages/Home.jsx"] == [] and got["/src/pages/Card.jsx"] == [("Card", "component")] and got["/src/hooks/useX.js"] == [("useX", "helper")]
    assert got["/src/any.js"] == [("U", "controller")] and got["/app/models/m.rb"] == [("M", "other")] and got["/n.rb"] is None


def test_routes_and_relations_of_frameworks(spark):
    from quillon.operators.frameworks import model_relations, script_routes, url_routes

    def one(make, text):
        return [tuple(x) for x in spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("x")).first().x]

    assert one(script_routes, "const r = express.Router();\nr.get('/a', f); r.POST(\"/b\", g)") == [("GET", "/a"), ("POST", "/b")]
    assert one(script_routes, "app.get('/a', f)") == []
    assert one(script_routes, "@Controller('users') class U { @Get(':id') a() {} @Post() b() {} }") == [("GET", "/users/:id"), ("POST", "/users/")]
    assert one(model_relations, "class A(models.Model):\n    owner = models.ForeignKey('User', x)\n    n = models.IntegerField()") == [("ForeignKey", "owner", "User")]
    assert one(url_routes, "path('a/', views.home, name='x'), path('b/', Item.as_view())") == [("/a/", None, "views.home"), ("/b/", "Item", None)]


def test_parsers_by_language(spark):
    from quillon.sources.files import parsed

    rows = [("python", "import os\nclass A(B):\n    def f(self): pass"), ("go", 'import "fmt"\nfunc Run() {}'), ("ruby", "class R\n  def m\n  end\nend"), ("vue", "<script>import x from './y'\nfunction g() {}</script>"), ("cobol", "DIVISION."), ("python", None)]
    got = parsed(spark.createDataFrame(rows, "language string, content string")).collect()
    assert [(r.classes, r.functions, r.imports) for r in got] == [(["A"], ["f"], ["os"]), ([], ["Run"], ["fmt"]), (["R"], ["m"], []), ([], ["g"], ["./y"]), ([], [], []), ([], [], [])]


def test_upsert_goes_on_after_a_restart(spark, tmp_path):
    from quillon.streaming.changes import upserted

    kind = "k string, at int"
    base = f"file://{tmp_path}/state"
    spark.createDataFrame([("a", 1), ("b", 5)], kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    assert {tuple(r) for r in upserted(read(), ["k"], "at", base).collect()} == {("a", 1), ("b", 5)}
    spark.createDataFrame([("a", 2), ("b", 3), ("c", 1)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert {tuple(r) for r in upserted(read(), ["k"], "at", base).collect()} == {("a", 2), ("b", 5), ("c", 1)}
    assert {tuple(r) for r in upserted(read(), ["k"], "at", base).collect()} == {("a", 2), ("b", 5), ("c", 1)}


def test_latest_status_of_equal_times(spark, tmp_path):
    from quillon.streaming.changes import finished, last_status

    rows = [("r", "p", s, t) for t, s in (("2024-01-01 00:00:00", "b"), ("2024-01-01 00:00:00", "a"), ("2024-01-09 00:00:00", "z"))]
    spark.createDataFrame(rows, "repo string, path string, status string, t string").selectExpr("repo", "path", "status", "timestamp(t) AS ts").write.parquet(str(tmp_path / "in"))
    got = finished(last_status(spark.readStream.schema("repo string, path string, status string, ts timestamp").parquet(str(tmp_path / "in")), "1 hour")).collect()
    assert [r.status for r in got] == ["b"]


def test_batches_make_cards_and_documents_stale(spark, tmp_path):
    from quillon.streaming.changes import synced

    kind = "repo string, path string, status string, ts timestamp, merge boolean"
    cards = spark.createDataFrame([(1, ["app/models/a.rb"], ["x"], False), (2, ["web/b.ts"], ["y"], False), (3, ["web/b.ts"], ["x", "y"], False), (4, ["z"], ["z"], False), (5, ["app/models/a.rb"], ["x"], True)], "id long, source_files array<string>, source_repos array<string>, stale boolean")
    edges = spark.createDataFrame([("app/models/a.rb", "web/b.ts", "api_endpoint"), ("app/models/a.rb", "z", "import")], "src string, dst string, relation string")
    base = f"file://{tmp_path}/state"

    def add(*rows):
        made = spark.createDataFrame(rows, "repo string, path string, status string, t string, merge boolean")
        made.selectExpr("repo", "path", "status", "timestamp(t) AS ts", "merge").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return synced(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), cards, edges, base)

    index, stale = add(("x", "app/models/a.rb", "added", "2024-01-02 00:00:00", False), ("x", "c.rb", "deleted", "2024-01-02 00:00:00", False))
    assert {(r.path, r.status) for r in index.collect()} == {("app/models/a.rb", "added"), ("c.rb", "deleted")}
    assert {r.key for r in stale.filter("kind = 'card'").collect()} == {"1"} and not stale.filter("key = 'x:changelog'").count()
    # a merge reaches the cards of other repositories; an older addition does not bring a deleted file back
    index, stale = add(("x", "app/models/a.rb", "modified", "2024-01-03 00:00:00", True), ("x", "c.rb", "added", "2024-01-01 00:00:00", False))
    assert {(r.path, r.status) for r in index.collect()} == {("app/models/a.rb", "modified"), ("c.rb", "deleted")}
    assert {r.key for r in stale.filter("kind = 'card'").collect()} == {"1", "2"} and stale.filter("key = 'x:changelog'").count() == 1


def test_heads_go_on_after_a_restart(spark, tmp_path):
    from quillon.streaming.changes import finished, head_changes

    shape = "repo string, branch string, ts timestamp, event_id long"
    when = lambda k: __import__("datetime").datetime(2024, 1, 1, 0, k)

    def put(name, rows):
        spark.createDataFrame([(r, b, when(t), k) for r, b, t, k in rows], shape).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        rows = spark.readStream.schema(shape).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        return sorted((x.repo, x.branch, x.previous, x.ts.minute) for x in finished(head_changes(rows), base=f"file://{tmp_path}/work").collect())

    put("1", [("a", "main", 1, 1), ("a", "main", 2, 2), ("b", "x", 1, 3), ("a", "f", 3, 4), ("a", "g", 3, 5), ("b", None, 2, 6), ("b", "", 3, 7)])
    first = [("a", "f", "main", 3), ("a", "g", "f", 3), ("a", "main", None, 1), ("b", "x", None, 1)]
    assert run() == first
    put("2", [("a", "g", 9, 8), ("a", "late", 2, 9), ("b", "y", 4, 10)])
    assert run() == sorted([*first, ("b", "y", "x", 4)])


RUBY = """module Shop
  class Order < ApplicationRecord
    has_many :line_items, -> { order(:id) }, dependent: :destroy
    has_and_belongs_to_many :boxes
    validates :name, :size, presence: true, inclusion: [:a, :b]
    validates_presence_of :owner
    after_commit :sync # later
    scope :open, -> { where(open: true) }
    def total
      items.each do |i|
        next unless i
      end
      if many then 1 else 2 end
    end
    private
    class Line
      def shown; end
      protected
      def self.made(x) = new(x)
      def kept?
        begin
          1
        end
      end
    end
    def hidden=(x)
    end
    private def aside
    end
    public
    class << self
      def inner
      end
    end
    def [](k)
    end
  end
  def of_module
  end
end
def loose(x)
end
"""


def test_ruby_visibility_in_nested_classes(spark):
    from quillon.sources import ruby

    lines = spark.createDataFrame([("f", k, x) for k, x in enumerate(RUBY.split("\n"))], "file string, no int, line string")
    got = [(r.owner, r.kind, r["name"], r.visibility, r.detail) for r in ruby.members(lines).orderBy("no").collect()]
    assert got == [
        ("Order", "association", "line_items", None, "has_many LineItem -> { order(:id) }, dependent: :destroy"), ("Order", "association", "boxes", None, "has_and_belongs_to_many Box"),
        ("Order", "validation", "validates", None, "name, size"), ("Order", "validation", "validates_presence_of", None, "owner"), ("Order", "callback", "after_commit", None, None),
        ("Order", "method", "scope:open", "public", None), ("Order", "method", "total", "public", None), ("Line", "method", "shown", "public", None), ("Line", "method", "self.made", "protected", None),
        ("Line", "method", "kept?", "protected", None), ("Order", "method", "hidden=", "private", None), ("Order", "method", "[]", "public", None), (None, "method", "loose", "public", None),
    ]
