"""From files to graphs, updates against rebuilding, resolution, detection, search, history and budgets."""

import math
import random
import re
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from graphloom.functions import exprs
from graphloom.operators import budget, classify, graph, incremental, index, resolve, traverse
from graphloom.operators import search as searching
from graphloom.operators.graph import Graph
from graphloom.sources import history

from .test_impact import make


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    """Small inputs in one partition."""
    settings = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def files_of(spark, tree):
    return spark.createDataFrame(list(tree.items()), "path string, text string").withColumn("hash", F.sha2("text", 256)).coalesce(1)


TREE = {
    "src/a.ts": "import { save } from './db';\nexport function run() {\n  save(1);\n  once();\n}\n",
    "src/db.ts": "export function save(x) {\n  return x;\n}\n",
    "src/one.ts": "export function once() {\n}\n",
    "cmd/main.go": 'import "ex.org/app/pkg"\nfunc main() {\n  Serve()\n}\n',
    "pkg/serve.go": "package pkg\nfunc Serve() {\n}\n",
    "README.md": "words",
}


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def ends(g):
    short = lambda u: u.removeprefix("urn:loom:")
    return {(short(s), short(t), r, line) for s, t, r, line in rows(g.edges, "source_urn", "target_urn", "relationship", "line")}


def test_graph_of_files(spark):
    g = index.build(index.kept(index.facts(files_of(spark, TREE))))
    assert ends(g) == {
        ("file:src/a.ts", "file:src/db.ts", "imports", 1),
        ("file:src/a.ts", "symbol:src/db.ts#save", "imports", 1),
        ("symbol:src/a.ts#run", "symbol:src/db.ts#save", "calls", 3),
        ("symbol:src/a.ts#run", "symbol:src/one.ts#once", "calls", 4),
        ("file:cmd/main.go", "file:pkg/serve.go", "imports", 1),
        ("symbol:cmd/main.go#main", "symbol:pkg/serve.go#Serve", "calls", 3),
    }
    assert rows(g.nodes.where("kind = 'file'"), "path") == {(p,) for p in TREE}


def test_update_equals_rebuild(spark):
    """After changes of all kinds the live part is what is built anew; what vanished stays retired, old names lead on."""
    state = index.update(files_of(spark, TREE))
    state = keep(spark, state, [("urn:loom:symbol:src/db.ts#save", "urn:loom:feature:store")])
    step = {"src/db.ts": "export function load(x) {\n}\n\nexport function save(x) {\n  return load(x);\n}\n", "src/one.ts": None, "src/uno.ts": TREE["src/one.ts"], "src/a.ts": None, "src/b.ts": "import { save } from './db';\nexport function other() {\n  once();\n}\n"}
    tree = {p: t for p, t in (TREE | step).items() if t is not None}
    files = files_of(spark, tree)
    state = keep(spark, index.update(files, state.facts, state.graph))
    new = index.build(index.kept(index.facts(files)))
    live = state.graph.nodes.where("status = 'active' and kind != 'feature'")
    assert rows(live, "urn", "kind", "path", "start_line", "end_line", "content_hash") == rows(new.nodes, "urn", "kind", "path", "start_line", "end_line", "content_hash")
    assert {e for e in ends(state.graph) if e[2] != "implements"} == ends(new)
    assert ("symbol:src/db.ts#save", "feature:store", "implements", None) in ends(state.graph)
    assert rows(state.graph.nodes.where("kind = 'feature'"), "status") == {("active",)}
    assert rows(state.changed, "path", "change", "from_path") == {("src/db.ts", "modified", None), ("src/uno.ts", "renamed", "src/one.ts"), ("src/a.ts", "deleted", None), ("src/b.ts", "added", None)}
    retired = rows(state.graph.nodes.where("status = 'retired'"), "path")
    assert ("src/a.ts",) in retired
    assert ("urn:loom:symbol:src/one.ts#once", "urn:loom:symbol:src/uno.ts#once") in rows(state.graph.aliases, "old_urn", "urn")


def keep(spark, update, members=()):
    """As written and read again, with further members of features."""
    nodes, edges = update.graph.nodes, update.graph.edges
    if members:
        feature = {m[1] for m in members}
        nodes = nodes.unionByName(spark.createDataFrame([(f, "feature", f, "", "active") for f in feature], "urn string, kind string, name string, path string, status string"), allowMissingColumns=True)
        edges = edges.unionByName(spark.createDataFrame([(a, b, "implements") for a, b in members], "source_urn string, target_urn string, relationship string"), allowMissingColumns=True)
    aliases = update.graph.aliases
    return index.Update(update.facts, Graph(nodes.checkpoint(), edges.checkpoint(), aliases if aliases is None else aliases.checkpoint()), update.changed.checkpoint())


FULL = {
    "src/auth/login.ts": "import { save } from '../db/store';\nimport { once } from './lost';\nimport { readFile } from 'fs';\nexport function login() {\n  save(1);\n  once();\n}\napp.post('/api/payment', login);\n",
    "src/db/store.ts": "export function save(x) {\n  return x;\n}\n",
    "src/util/lost.ts": "export function once() {\n}\nexport function readFile() {\n}\n",
    "src/auth/login.test.ts": "import { login } from './login';\ndescribe('login', () => {\n  it('works', () => {\n    login();\n  });\n});\n",
    "src/features/cart/add.ts": "export function add() {\n}\n",
    "schema.prisma": "model Invoice {\n  id Int @id\n}\n",
}


def test_index_end_to_end(spark):
    """Test edges, names found without their file, runtime modules, features of routes, models, folders, names and tests, declared ones."""
    declared = spark.createDataFrame([("Storage", ["save"], [])], "feature string, components array<string>, services array<string>")
    g = index.build(index.kept(index.facts(files_of(spark, FULL))), declared)
    got = ends(g)
    assert {("test:src/auth/login.test.ts#login:2", "symbol:src/auth/login.ts#login", "tests", 2), ("test:src/auth/login.test.ts#works:3", "symbol:src/auth/login.ts#login", "tests", 3)} == {e for e in got if e[2] == "tests"}
    assert ("file:src/auth/login.ts", "symbol:src/util/lost.ts#once", "imports", 2) in got and not any("readFile" in e[1] for e in got)
    members = {(s, t.removeprefix("feature:")) for s, t, r, _ in got if r == "implements"}
    assert ("symbol:src/auth/login.ts#login", "authentication") in members and ("route:src/auth/login.ts#POST:/api/payment", "payments") in members
    assert {("model:schema.prisma#Invoice", "payments"), ("symbol:src/features/cart/add.ts#add", "cart"), ("symbol:src/db/store.ts#save", "storage"), ("test:src/auth/login.test.ts#login:2", "authentication")} <= members
    sure = {(r.confidence, r.confidence_score) for r in g.edges.where("target_urn = 'urn:loom:feature:storage'").collect()}
    assert sure == {("EXPLICIT", 1.0)} and {"authentication", "payments", "cart", "storage"} == {u.rsplit(":", 1)[1] for (u,) in rows(g.nodes.where("kind = 'feature'"), "urn")}


def test_deltas_equal_rebuilding(spark):
    """Random changes of files: edges and nodes are those built anew, though only some files' edges are made again."""
    rng = random.Random(7)
    names = ["alpha", "beta", "gamma", "delta", "loginUser"]

    def text(k):
        got = rng.sample(names, 3)
        imports = "".join(f"import {{ {rng.choice(names)} }} from './{rng.choice('abcdefgh')}';\n" for _ in range(rng.randint(0, 2)))
        tests = f"it('{k}', () => {{\n  {got[0]}();\n}});\n" if rng.random() < 0.3 else ""
        return imports + f"export function {got[0]}() {{\n  {got[1]}();\n  {got[2]}();\n}}\n" + tests

    tree = {f"src/{c}.ts": text(c) for c in "abcdefgh"} | {"far/x.ts": "export function apart() {\n}\n", "far/y.ts": "import { apart } from './x';\nexport function user() {\n  apart();\n}\n"}
    state = keep(spark, index.update(files_of(spark, tree)))
    for step in range(2):
        for c in rng.sample("abcdefgh", 2):
            tree[f"src/{c}.ts"] = text(c)
        here = sorted(p for p in tree if p.startswith("src/"))
        moved = tree.pop(here[0])
        tree[f"src/new{step}.ts"] = moved  # renamed
        tree.pop(here[1])
        tree[here[1].replace(".ts", "z.ts")] = text("z")
        files = files_of(spark, tree)
        state = index.update(files, state.facts, state.graph)
        again = {p for (p,) in rows(state.touched, "path")}
        state = keep(spark, state)
        new = index.build(index.kept(index.facts(files)))
        assert ends(state.graph) == ends(new)
        live = ("urn", "kind", "name", "path", "start_line", "end_line", "content_hash")
        assert rows(state.graph.nodes.where("status = 'active'"), *live) == rows(new.nodes, *live)
        assert not again & {"far/x.ts", "far/y.ts"}


def test_renames_of_short_paths(spark):
    nodes = spark.createDataFrame([("urn:loom:symbol:m#main", "m"), ("urn:loom:file:m", "m"), ("urn:loom:symbol:s#s", "s"), ("symbol:s", "s"), ("other", "s")], "urn string, path string")
    moved, _ = incremental.renamed_nodes(nodes, spark.createDataFrame([("m", "lib/m"), ("s", "t/s")], "from_key string, to_key string"))
    assert rows(moved, "urn") == {("urn:loom:symbol:lib/m#main",), ("urn:loom:file:lib/m",), ("urn:loom:symbol:t/s#s",), ("symbol:t/s",), ("other",)}


def test_renames_and_aliases(spark):
    nodes = spark.createDataFrame([("urn:x:a.ts#f", "a.ts"), ("urn:x:b.ts#g", "b.ts")], "urn string, path string")
    moved, names = incremental.renamed_nodes(nodes, spark.createDataFrame([("a.ts", "c.ts")], "from_key string, to_key string"))
    assert rows(moved, "urn", "path") == {("urn:x:c.ts#f", "c.ts"), ("urn:x:b.ts#g", "b.ts")} and rows(names, "old_urn", "urn") == {("urn:x:a.ts#f", "urn:x:c.ts#f")}
    led = incremental.followed(spark.createDataFrame([("p", "q"), ("r", "s")], "old_urn string, urn string"), spark.createDataFrame([("q", "t"), ("r", "u")], "old_urn string, urn string"))
    assert rows(led, "old_urn", "urn") == {("p", "t"), ("q", "t"), ("r", "u")}


def test_import_targets(spark):
    files = spark.createDataFrame([(p,) for p in ("a/b/x.ts", "a/y/index.tsx", "src/lib/z.js", "p/q.py", "p/r/__init__.py", "c/J.java", "up.ts", "g/pkg/one.go", "h/pkg/two.go", "h/pkg/deep/three.go")], "path string")
    asked = [("a/b/m.ts", "./x"), ("a/b/m.ts", "../y"), ("a/b/m.ts", "../.././up"), ("a/b/m.ts", "@/lib/z"), ("p/m.py", "p.q"), ("p/m.py", "p.r"), ("K.java", "c.J"), ("a/b/m.ts", "./no"), ("a/" * 12 + "m.ts", "../" * 12 + "up"), ("m.go", "ex/h/pkg"), ("m.go", "ex/pkg"), ("m.go", "ex/none")]
    imports = spark.createDataFrame(asked, "source_file string, module_specifier string")
    got = {(r.source_file, r.module_specifier): r.target_path for r in resolve.import_targets(imports, files).collect()}
    want = ["a/b/x.ts", "a/y/index.tsx", "up.ts", "src/lib/z.js", "p/q.py", "p/r/__init__.py", "c/J.java", None, "up.ts"]
    assert [got.get(a) for a in asked[:9]] == want
    assert rows(resolve.package_files(imports, files), "module_specifier", "target_path") == {("ex/h/pkg", "h/pkg/two.go"), ("ex/pkg", "g/pkg/one.go"), ("ex/pkg", "h/pkg/two.go")}
    symbols = spark.createDataFrame([("u1", "f", "t"), ("u2", "f", "t"), ("u3", "g", "t")], "urn string, name string, path string")
    named = spark.createDataFrame([("m", "t", ["f", "no"])], "source_file string, target_path string, imported_symbols array<string>")
    assert rows(resolve.imported_symbols(named, symbols), "source_file", "name", "urn") == {("m", "f", "u2")}


def test_call_tiers_fallback_and_attribution(spark):
    symbols = spark.createDataFrame([("h", "f", "x.ts"), ("i", "f", "y.ts"), ("j", "f", "z.ts"), ("o", "only", "z.ts"), ("k", "g", "y.ts"), ("l", "g", "z.ts")], "urn string, name string, path string")
    calls = spark.createDataFrame([(1, "x.ts", "f"), (2, "m.ts", "f"), (3, "n.ts", "f"), (4, "n.ts", "only"), (5, "n.ts", "len"), (6, "m.ts", "g")], "call_id int, file string, name string")
    imported = spark.createDataFrame([("m.ts", "z.ts"), ("m.ts", "y.ts")], "file string, path string")
    got = resolve.resolve_calls(calls, symbols.union(spark.createDataFrame([("b", "len", "z.ts")], symbols.schema)), imported, spark.createDataFrame([("len",)], "name string"))
    assert rows(got, "call_id", "urn", "tier") == {(1, "h", 1), (2, "i", 2), (4, "o", 3), (6, "k", 2)}
    by_name = spark.createDataFrame([(1, "m.ts", "./lib/y", "f"), (2, "m.ts", "./other", "g"), (3, "m.ts", "other", "g"), (4, "m.ts", "./y", "len")], "import_id int, source_file string, module_specifier string, name string")
    assert rows(resolve.import_fallback(by_name, symbols, ["len"]), "import_id", "urn", "tier") == {(1, "i", 1), (2, "k", 2)}
    nodes = spark.createDataFrame([("h",), ("i",)], "urn string")
    said = spark.createDataFrame([("h", "x.ts", "i"), ("h", "x.ts", "h"), ("none", "y.ts", "h"), (None, "z.ts", "i")], "caller_urn string, file string, urn string")
    assert rows(resolve.attribute(said, nodes), "source_urn", "urn") == {("h", "i"), ("file:x.ts", "h"), ("file:y.ts", "h"), ("file:z.ts", "i")}


def test_builtin_names(spark):
    got = spark.createDataFrame([("a.b.len",), ("len",), ("lens",)], "n string").select("n", exprs.is_builtin(F.col("n"), F.array(F.lit("len"))).alias("b"))
    assert rows(got, "n", "b") == {("a.b.len", True), ("len", True), ("lens", False)}


def test_detection_and_merge(spark):
    words = classify.vocabulary(spark, [("pay", "Payments", ["money"]), ("user", "Accounts", ["id"]), ("order", "Orders", [])])
    routes = spark.createDataFrame([("r1", "/api/v1/pay/now"), ("r2", "/things/1"), ("r3", "/api")], "urn string, route_path string")
    models = spark.createDataFrame([("m1", "PayLog"), ("m2", "Other")], "urn string, name string")
    symbols = spark.createDataFrame([("s1", "go", "src/features/check-out/a.ts"), ("s2", "loadUsers", "lib/a.ts"), ("s3", "run", "user/x.ts"), ("s4", "none", "lib/b.ts")], "urn string, name string, path string")
    tests = spark.createDataFrame([("t1", "orders ship", "t/a.ts")], "urn string, name string, path string")
    found = classify.candidates(routes, models, symbols, tests, words)
    assert rows(found, "urn", "slug", "confidence", "score", "evidence") == {
        ("r1", "payments", "DETECTED", 0.85, "route_match"),
        ("r2", "things", "DETECTED", 0.85, "route_match"),
        ("m1", "payments", "DETECTED", 0.85, "model_ref"),
        ("s1", "check-out", "DETECTED", 0.9, "directory_cluster"),
        ("s2", "accounts", "INFERRED", 0.6, "semantic_similarity"),
        ("s3", "accounts", "DETECTED", 0.85, "directory_cluster"),
        ("t1", "orders", "DETECTED", 0.8, "ast_call"),
    }
    assert {r.slug: (r.name, tuple(r.tags)) for r in classify.features(found).collect()}["payments"] == ("Payments", ("money",))
    declared = spark.createDataFrame([("urn:loom:feature:payments", "Pay!", ["a"])], "urn string, name string, tags array<string>")
    linked = spark.createDataFrame([("m1", "urn:loom:feature:payments"), ("x", "urn:loom:feature:payments")], "urn string, feature string")
    features, edges = classify.merged(declared, linked, found)
    assert rows(features, "urn", "name", "confidence") == {("urn:loom:feature:payments", "Pay!", "EXPLICIT")} | {(f"urn:loom:feature:{s}", n, "DETECTED") for s, n in (("things", "Things"), ("check-out", "Check out"), ("accounts", "Accounts"), ("orders", "Orders"))}
    of = {(r.urn, r.feature.rsplit(":", 1)[1]): (r.confidence, r.confidence_score) for r in edges.collect()}
    assert of["m1", "payments"] == ("EXPLICIT", 1.0) and of["x", "payments"] == ("EXPLICIT", 1.0) and of["r1", "payments"] == ("DETECTED", 0.85) and len(of) == 8


def test_best_keyword_against_all_pairs(spark):
    """The join by shared words and beginnings finds what comparing every item with every keyword does."""
    rng = random.Random(2)
    parts = ["pay", "pays", "payment", "user", "users", "us", "order", "orders", "ord", "s", "ss"]
    vocabulary = [(w, w.title(), []) for w in ("pay", "user", "orders", "paym", "ss", "s")]
    items = [(str(i), [rng.choice(parts) for _ in range(rng.randint(0, 3))], [rng.choice(parts) for _ in range(rng.randint(0, 3))]) for i in range(200)]
    df = spark.createDataFrame(items, "urn string, symbol_words array<string>, path_words array<string>")
    words = classify.vocabulary(spark, vocabulary)
    every = df.crossJoin(words).withColumn("score", exprs.keyword_score(F.col("keyword"), F.col("symbol_words"), F.col("path_words"))).where("score > 0")
    want = every.groupBy("urn").agg(F.max_by(F.struct("keyword", "score"), F.struct("score", -F.col("ord"))).alias("b")).select("urn", "b.*")
    assert rows(classify.best_keyword(df, words), "urn", "keyword", "score") == rows(want, "urn", "keyword", "score")


def test_search_weights_target_and_where(spark):
    nodes = [("f1", "feature", "pay", "", "Pay Orders", ["money"], None), ("r1", "route", "GET", "x", None, None, "/pay/orders"), ("s1", "symbol", "payAll", "pay/a.ts", None, None, None), ("s2", "symbol", "money", "b.ts", None, None, None)]
    df = spark.createDataFrame([(*n, "active") for n in nodes], "urn string, kind string, name string, path string, display_name string, tags array<string>, route_path string, status string")
    assert rows(searching.search(df, "pay money"), "urn", "score") == {("f1", 10 + 6 + 4), ("r1", 7), ("s1", 5 + 3), ("s2", 10)}
    g = make(spark, [("a", "symbol", {"name": "payAll", "path": "x"}), ("f", "feature", {"name": "Pay"}), ("b", "symbol", {"name": "other"})], [("a", "f", "implements", {})])
    g = Graph(g.nodes.withColumn("display_name", F.col("name")), g.edges)
    assert rows(searching.target(g, "b"), "urn") == {("b",)} and rows(searching.target(g, "payall thing"), "urn") == {("a",)} and searching.target(g, "nothing").count() == 0
    assert rows(searching.where(g, "pay"), "role", "urn") == {("services", "a")}
    assert rows(searching.where(g, "other"), "role", "urn") == {("hit", "b")}


def test_chain_by_names(spark):
    g = make(spark, [(u, "symbol", {"name": n}) for u, n in (("1", "start"), ("2", "mid"), ("3", "End"))], [("1", "2", "calls", {}), ("2", "3", "calls", {}), ("1", "3", "implements", {})])
    assert [(r.place, r.path) for r in traverse.chain(g, "start", "end").collect()] == [(1, ["1", "2", "3"])]
    assert traverse.chain(g, "start", "nothing").count() == 0


def test_edges_added_once(spark):
    g = make(spark, [("a", "symbol", {}), ("b", "symbol", {}), ("r", "symbol", {"status": "retired"})], [("a", "b", "calls", {"score": 0.5}), ("a", "b", "imports", {"score": 0.9})])
    new = spark.createDataFrame([("a", "r", "calls"), ("a", "new", "calls")], "source_urn string, target_urn string, relationship string")
    assert rows(graph.add_edges(g, new).edges, "source_urn", "target_urn") == {("a", "b"), ("a", "new")}
    assert rows(graph.distinct_edges(g.edges, F.desc("confidence_score")), "relationship") == {("imports",)}
    for text, want in (("A", "a"), ("b", "b"), ("r", None)):
        assert [r.urn for r in graph.symbol_named(g, text).collect()] == ([want] if want else [])


def test_truncate_against_all_prefixes(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab .,(){}é\n") for _ in range(rng.randint(0, 300))) for _ in range(150)] + ["", None, "x" * 900, "." * 900]

    def cost(t):
        return math.ceil(len(t) / 3.3 + 0.25 * len(re.findall(exprs.PUNCTUATION, t)))

    def want(t, b):
        if t is None or cost(t) <= b:
            return t
        if cost(budget.MARK) > b:
            return ""
        return max((t[:n] for n in range(len(t) + 1) if cost(t[:n] + budget.MARK) <= b), key=len) + budget.MARK

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for b in (3, 6, 7, 20, 60):
        got = {r.i: r.x for r in df.select("i", budget.truncate(F.col("t"), b).alias("x")).collect()}
        assert got == {i: want(t, b) for i, t in enumerate(texts)}, b


def test_git(spark, tmp_path):
    assert history.parsed_status("R  new name\0old name\0?? x\0 M y\0D  z\0A  w\0") == [("renamed", "new name", "old name"), ("added", "x", None), ("modified", "y", None), ("deleted", "z", None), ("added", "w", None)]
    root = str(tmp_path)
    assert history.commit(root) == "non-git" and history.status(spark, root).count() == 0 and history.log(spark, root).count() == 0
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=N", "-c", "user.email=n@e.x", *a], check=True, capture_output=True)
    git("init", "-q")
    assert history.commit(root) == "uncommitted"
    (tmp_path / "a.ts").write_text("1")
    git("add", ".")
    git("commit", "-qm", "one | two")
    (tmp_path / "a.ts").write_text("2")
    (tmp_path / "b.ts").write_text("3")
    assert rows(history.status(spark, root), "change", "path") == {("modified", "a.ts"), ("added", "b.ts")}
    assert rows(history.changed(spark, root, "HEAD"), "path") == {("a.ts",)} and rows(history.changed(spark, root), "path") == {("a.ts",), ("b.ts",)}
    assert rows(history.log(spark, root), "message", "author", "path") == {("one | two", "N", "a.ts")}
    g = make(spark, [("s", "symbol", {"path": "a.ts"}), ("f", "feature", {})], [("s", "f", "implements", {})])
    many = spark.createDataFrame([(f"c{i:02d}", f"2024-01-{i:02d}", "N", "m", p) for i in range(1, 13) for p in ("a.ts", "z.ts")], "commit string, date string, author string, message string, path string")
    got = history.feature_history(g, many).collect()
    assert [(r.place, r.commit) for r in sorted(got, key=lambda r: r.place)] == [(k, f"c{13 - k:02d}") for k in range(1, 11)]


def test_ring_without_end(spark):
    """A component wider than any fixed number of rounds."""
    n = 70
    e = [(f"n{i:03d}", f"n{(i + 1) % n:03d}") for i in range(n)] + [("x", "n000")]
    df = spark.createDataFrame(e, "source_urn string, target_urn string").coalesce(1)
    assert rows(traverse.on_cycles(df), "urn", "component") == {(f"n{i:03d}", "n000") for i in range(n)}


def test_truncate_of_punctuation_takes_no_squares(spark):
    """Before, the places of all marks were found anew for each of them."""
    df = spark.createDataFrame([(i, ",;" * (4000 + i)) for i in range(8)], "i int, t string").repartition(1)
    began = time.time()
    got = {r.i: r.x for r in df.select("i", budget.truncate(F.col("t"), 4000).alias("x")).collect()}
    # 0.25 + 1 / 3.3 for each character
    assert all(len(x) == len(got[0]) and x.endswith(budget.MARK) for x in got.values()) and 7180 < len(got[0]) < 7300
    assert time.time() - began < 20
