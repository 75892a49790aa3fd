"""What grows with the tables stays out of the driver and of single tasks: plans and results on small inputs."""

import random
import re
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from graphloom.operators import classify, extract, graph, resolve, review, rules, traverse, views
from graphloom.operators.graph import Graph
from graphloom.plans import driver_graph

ROWS = [("gear", "Metal", ["m"]), ("orders", "Orders", [])]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, tmp_path):
    """Rows read from a file, of which Spark knows how small it is."""
    def keep(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))
    return keep


def test_keywords_are_broadcast_and_never_the_items(spark, stored):
    items = stored("items", [("a", ["gears"], ["x"]), ("b", ["none"], ["order"])], "urn string, symbol_words array<string>, path_words array<string>")
    best = classify.best_keyword(items, classify.vocabulary(spark, ROWS))
    assert "BuildLeft" not in plan(best) and "BuildRight" in plan(best)
    assert sorted((r.urn, r.keyword) for r in best.collect()) == [("a", "gear"), ("b", "orders")]


def test_candidates_broadcast_keywords_alone(spark, stored):
    routes = stored("routes", [("r", "/api/gear/1")], "urn string, route_path string")
    models = stored("models", [("m", "Gearbox")], "urn string, name string")
    symbols = stored("symbols", [("s", "gear", "src/x.ts")], "urn string, name string, path string")
    found = classify.candidates(routes, models, symbols, symbols.where("urn = 't'"), classify.vocabulary(spark, ROWS))
    assert "BuildLeft" not in plan(found) and "SortMergeJoin" not in plan(found)
    assert sorted((r.urn, r.slug) for r in found.collect()) == [("m", "metal"), ("r", "metal"), ("s", "metal")]


def test_declared_members_are_not_broadcast(spark, stored):
    linked = stored("linked", [("s", "urn:loom:feature:metal")], "urn string, feature string")
    found = stored("found", [("metal", "Metal", [], "s", "DETECTED", 0.85, "x"), ("metal", "Metal", [], "t", "DETECTED", 0.85, "x")], "slug string, name string, tags array<string>, urn string, confidence string, score double, evidence string")
    declared = spark.createDataFrame([("urn:loom:feature:metal", "Metal", [])], "urn string, name string, tags array<string>")
    edges = classify.merged(declared, linked, found)[1]
    assert "Broadcast" not in plan(edges)
    assert sorted((r.urn, r.confidence) for r in edges.collect()) == [("s", "EXPLICIT"), ("t", "DETECTED")]


def test_an_import_is_no_row_for_each_suffix(spark):
    imports = spark.createDataFrame([("a/b.ts", "./c"), ("a/b.ts", "@/d"), ("a/b.py", "x.y"), ("a/b.ts", "./none")], "source_file string, module_specifier string")
    assert resolve.bases(imports).count() == 6
    files = spark.createDataFrame([(p,) for p in ("a/c/index.ts", "a/c.tsx", "src/d.ts", "d.jsx", "x/y.java", "x/y/__init__.py", "x/y.js")], "path string")
    got = {(r.source_file, r.module_specifier): r.target_path for r in resolve.import_targets(imports, files).collect()}
    assert got == {("a/b.ts", "./c"): "a/c.tsx", ("a/b.ts", "@/d"): "src/d.ts", ("a/b.py", "x.y"): "x/y.java"}


def test_rules_meet_nodes_before_edges_and_are_broadcast(spark):
    nodes = spark.createDataFrame([("a", "ui/a"), ("b", "db/b"), ("c", "db/c"), ("d", None)], "urn string, path string")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "a"), ("a", "d"), ("c", "b")], "source_urn string, target_urn string")
    kept = rules.rule_rows(spark, [{"name": "x", "from": "ui/*", "cannot_import": "db/*"}] * 2 + [{"name": "y", "from": "db/c", "cannot_import": "**"}, {"name": "z", "from": "**"}])
    found = rules.forbidden(nodes, edges, kept)
    assert "CartesianProduct" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [("x", "a", "b")] * 4 + [("y", "c", "b")]


def test_texts_are_not_joined_with_nodes_without_hashes(spark):
    nodes = spark.createDataFrame([("a", "symbol", "x", "active", 1, 2), ("b", "symbol", "x", "active", 2, 4), ("c", "symbol", "y", "active", 1, 1), ("d", "symbol", "z", "active", 1, 1)], "urn string, kind string, path string, status string, start_line int, end_line int")
    edges = spark.createDataFrame([], "source_urn string, target_urn string, relationship string")
    files = spark.createDataFrame([("x", "1\n2"), ("y", None)], "path string, text string")
    found = review.problems(Graph(nodes, edges), files)
    joins = [line for line in plan(found).splitlines() if "Join" in line]
    assert joins and not any("split" in line for line in plan(found).split("Join", 1)[0].splitlines())
    assert sorted((r.problem, r.urn) for r in found.collect()) == [("lines beyond the file", "b"), ("missing file", "d")]


def test_calls_read_each_line_once_after_files_are_dealt(spark):
    files = spark.createDataFrame([("a.py", "def f():\n    g()\nh()"), ("b.ts", "class A {\n  m() {\n    k();\n  }\n}"), ("c.py", "x()")], "path string, text string")
    found = extract.calls(files)
    assert plan(found).count("Exchange") == 1  # before: lines were dealt and sorted again for blocks
    assert sorted((r.file, r.caller or "", r.callee_name, r.line) for r in found.collect()) == [("a.py", "", "h", 3), ("a.py", "f", "g", 2), ("b.ts", "m", "k", 3), ("c.py", "", "x", 1)]


def test_routes_are_looked_for_in_few_lines(spark):
    java = '@RequestMapping("/a")\nclass A {\n  @GetMapping("/x")\n  int x() {\n  }\n}\nclass B {\n  @PostMapping("y")\n  int y() {\n  }\n}'
    files = spark.createDataFrame([("A.java", java), ("C.java", 'class C {\n  @GetMapping("/z")\n}'), ("b.py", 'x = 1\n@app.get("/b")\ndef f(): pass'), ("app/u/route.ts", "export async function GET() {\n}"), ("n.go", "")], "path string, text string")
    found = extract.routes(files)
    assert "Window" not in plan(found) and "Sort" not in plan(found)  # before: all lines were sorted, and headers of all languages read
    assert sorted((r.path, r.http_method, r.route_path, r.line) for r in found.collect()) == [("A.java", "GET", "/a/x", 3), ("A.java", "POST", "/y", 8), ("C.java", "GET", "/z", 2), ("app/u/route.ts", "GET", "/u", 1), ("b.py", "GET", "/b", 2)]


def test_symbols_without_hashes_meet_no_texts(spark):
    files = spark.createDataFrame([("a.py", "def f():\n    pass"), ("b.ts", "class A {\n  m() {\n  }\n}")], "path string, text string")
    found = extract.symbols(files, hashes=False)
    assert plan(found).count("Exchange") == 1 and "Join" not in plan(found)
    whole = extract.symbols(files)
    assert found.columns == whole.columns[:-1] and sorted(found.collect()) == sorted(whole.drop("content_hash").collect())


def test_calls_carry_no_lists_of_blocks(spark):
    files = spark.createDataFrame([("a.py", "def f():\n    g(h())")], "path string, text string")
    found = extract.calls(files)
    assert not re.search(r"Generate explode\(.*\[[^\]]*blocks#", plan(found))  # before: every call's row held those of its file
    assert sorted((r.caller, r.callee_name) for r in found.collect()) == [("f", "g"), ("f", "h")]


def test_rounds_hold_only_what_is_reached_itself_and_are_stored_compressed(spark, monkeypatch):
    kept, cut = [], traverse.cut
    monkeypatch.setattr(traverse, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    edges = [(f"leaf{i}", "b") for i in range(50)] + [("b", "a"), ("c", "b"), ("a", "c"), ("c", "c"), ("leaf0", "a"), ("leaf0", "a")]
    found = traverse.consumers(spark.createDataFrame(edges, "source_urn string, target_urn string"), spark.createDataFrame([("a",), ("leaf1",), ("none",)], "urn string"))
    assert {(r.root, r.urn): r.depth for r in found.collect()} == {("a", "b"): 1, ("a", "c"): 2, ("a", "leaf0"): 1} | {("a", f"leaf{i}"): 2 for i in range(1, 50)}
    assert all(df.inputFiles() for df in kept) and all(df.count() <= 2 for df in kept if "root" in df.columns)
    near = traverse.consumers(spark.createDataFrame(edges, "source_urn string, target_urn string"), spark.createDataFrame([("a",)], "urn string"), 1)
    assert sorted(map(tuple, near.collect())) == [("a", "b", 1), ("a", "leaf0", 1)]


def test_edges_are_dealt_by_their_number(spark, small, monkeypatch):
    monkeypatch.setattr(driver_graph, "TASK_ROWS", 300)
    n = driver_graph.tasks(spark, small)
    assert n == spark.read.parquet(f"{small}/lineitem.parquet").count() // 300 > 8
    once = graph.distinct_edges(driver_graph.code_edges(spark, small, n), F.col("relationship"), n)
    assert once.rdd.getNumPartitions() == n
    aliases = spark.createDataFrame([("part:2", "part:1")], "old_urn string, urn string")
    g = Graph(driver_graph.nodes(spark, small), driver_graph.edges(spark, small, tasks=n), aliases)
    assert "hashpartitioning(target_urn" in plan(g.resolved_edges(n)) and f", {n}), REPARTITION_BY_NUM" in plan(g.resolved_edges(n))
    assert g.resolved_edges(n).exceptAll(Graph(g.nodes, driver_graph.edges(spark, small), aliases).resolved_edges()).isEmpty()


def test_rounds_deal_edges_by_their_number(spark, monkeypatch):
    seen, cut = [], traverse.cut
    monkeypatch.setattr(traverse, "TASK_ROWS", 3)
    monkeypatch.setattr(traverse, "cut", lambda df: seen.append(plan(df)) or cut(df))
    edges = spark.createDataFrame([(f"{i}", f"{i + 1}") for i in range(60)], "source_urn string, target_urn string")
    assert traverse.consumers(edges, spark.createDataFrame([("3",)], "urn string")).count() == 3
    assert sum(", 20), REPARTITION_BY_NUM" in p for p in seen) == 2


def test_nodes_are_read_once_for_paths_and_slices_change_no_result(spark, stored, monkeypatch):
    rng = random.Random(18)
    nodes = [(f"n{i}", None if i == 7 else f"p{rng.randrange(25)}" if i % 9 else "", "retired" if i % 11 == 5 else "active") for i in range(70)]
    edges = [(f"n{rng.randrange(72)}", f"n{rng.randrange(30)}") for _ in range(40)]
    g = Graph(stored("nodes", nodes, "urn string, path string, status string"), stored("edges", edges, "source_urn string, target_urn string"))
    of = {u: p for u, p, s in nodes if p and s == "active"}
    plain = set(of.values()) - {of[t] for s, t in edges if s in of and t in of and of[s] != of[t]}
    assert 0 < len(plain) < len(set(of.values()))
    for slices in (1, 2, 1 << 40):
        monkeypatch.setattr(graph, "SLICES", slices)
        found = graph.unconsumed_paths(g)
        assert sorted(r.path for r in found.collect()) == sorted(plain)
        assert not set(found.inputFiles()) & set(g.nodes.inputFiles())  # before: read three times


def test_line_items_are_made_distinct_once(spark, small):
    edges = plan(driver_graph.code_edges(spark, small))
    assert len(re.findall(r"HashAggregate\(keys=\[l_suppkey#\d+L?, l_partkey#\d+L?\]", edges)) == 2  # partial and final; before: twice as many


def test_features_are_explained_from_their_own_edges(spark, stored, monkeypatch):
    kept, cut = [], views.cut
    monkeypatch.setattr(views, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    rng = random.Random(19)
    nodes = [(f"f{i}", "feature", "") for i in range(5)] + [(f"s{i}", "symbol", f"p{i % 6}") for i in range(24)] + [(f"file{i}", "file", f"p{i % 4}") for i in range(6)]
    names = [n[0] for n in nodes] + ["old0", "old1", "old2", "none"]
    aliases = {"old0": "f0", "old1": "s3", "f4": "s1", "old2": "f4"}  # f4 is an old name of s1 too
    few = [(rng.choice(names), rng.choice(names), rng.choice(["a", "b"]), rng.choice(["EXPLICIT", "DETECTED", "INFERRED"]), rng.choice([0.5, 0.9])) for _ in range(60)] + [("f1", "f1", "a", "DETECTED", 0.9)]
    edges = few + [(f"s{rng.randrange(24)}", f"s{rng.randrange(24)}", "a", "DETECTED", 0.9) for _ in range(300)]
    g = Graph(stored("nodes", nodes, "urn string, kind string, path string"), stored("edges", edges, "source_urn string, target_urn string, relationship string, confidence string, confidence_score double"), stored("aliases", list(aliases.items()), "old_urn string, urn string"))
    asked = [n for n in names if n not in ("f4",)]
    found = views.explain(g, stored("asked", [(n,) for n in asked], "urn string"))

    now, rank = lambda u: aliases.get(u, u), ["INFERRED", "DETECTED", "EXPLICIT"]
    direct, features = defaultdict(list), {u for u, k, _ in nodes if k == "feature"}
    for s, t, r, c, x in edges:
        s, t = now(s), now(t)
        for node, feature in {(s, t), (t, s)}:
            if feature in features:
                direct[node, feature].append((x, rank.index(c), r))
    want = {}
    for a in asked:
        for f in features:
            if rows := direct.get((now(a), f)):
                want[a, f] = (rank[max(rows)[1]], max(rows)[0], sorted(r for *_, r in rows))
            for u, k, p in nodes:
                if not rows and u == now(a) and k == "symbol" and any(q == p and (w, f) in direct for w, kind, q in nodes if kind == "file"):
                    want[a, f] = ("INFERRED", 0.5, [f"file {p}"])
    assert {(r.target, r.feature): (r.confidence, r.score, r.edges) for r in found.collect()} == want and found.count() == len(want)
    assert {c for c, *_ in want.values()} == set(rank) and any(e[0].startswith("file") for *_, e in want.values())
    assert not set(found.inputFiles()) & set(g.edges.inputFiles())  # before: all edges were read again for each use
    linked = next(df for df in kept if "node" in df.columns)
    assert linked.count() == sum(map(len, direct.values())) < 100


def test_calls_are_looked_up_in_members_once(spark, stored):
    rng = random.Random(20)
    nodes = [(f"f{i}", "feature", f"f{i}", "", 0, "active") for i in range(3)] + [(f"s{i}", "symbol", f"s{i}", f"p{i % 5}", i, "retired" if i == 9 else "active") for i in range(20)]
    member = {(f"s{i}", f"f{rng.randrange(3)}") for i in range(14) for _ in range(2)}
    calls = [(f"s{rng.randrange(20)}", f"s{rng.randrange(20)}") for _ in range(25)]
    rows = [(s, f, "implements") for s, f in member] + [(s, t, "calls") for s, t in calls]
    g = Graph(stored("nodes", nodes, "urn string, kind string, name string, path string, start_line int, status string"), stored("edges", rows, "source_urn string, target_urn string, relationship string"))
    found = views.function_map(g)
    assert plan(found).count("ShuffledHashJoin") == 2  # nodes and members; before: sorted, and members twice
    path = {u: p for u, k, _, p, _, status in nodes if k == "symbol" and status == "active"}
    of = {(s, f) for s, f in member if s in path}
    want = set()
    for u, f in of:
        by = [s for s, t in calls if t == u and s in path]
        inner = {t for s, t in calls if s == u and (t, f) in of}
        want.add((f, u, len(by), len({path[s] for s in by}) > 1, not any(t == u and (s, f) in of for s, t in calls), len(inner)))
    assert {(r.feature, r.urn, r.callers, r.shared, r.entry, r.inner_calls) for r in found.collect()} == want
    assert {w[4] for w in want} == {True, False} and max(w[5] for w in want) > 1
