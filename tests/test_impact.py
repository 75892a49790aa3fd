"""Impact, coupling, views, explanations, reviews and checks on small graphs, and against plain versions."""

import random
import re
from collections import defaultdict

import pytest

from graphloom.operators import graph, impact, reach, review, rules, traverse, views
from graphloom.operators.graph import Graph

NODE = "urn string, kind string, name string, path string, status string, symbol_kind string, start_line int, end_line int, content_hash string"
EDGE = "source_urn string, target_urn string, relationship string, file string, line int, confidence string, confidence_score double"


def make(spark, nodes, edges, aliases=None):
    full = [(u, k, r.get("name", u), r.get("path", ""), r.get("status", "active"), r.get("symbol_kind"), *r.get("lines", (None, None)), r.get("hash")) for u, k, r in nodes]
    rows = [(s, t, kind, r.get("file"), r.get("line"), r.get("confidence", "DETECTED"), r.get("score", 0.9)) for s, t, kind, r in edges]
    old = spark.createDataFrame(aliases, "old_urn string, urn string") if aliases else None
    return Graph(spark.createDataFrame(full, NODE), spark.createDataFrame(rows, EDGE), old)


def asked(spark, *urns):
    return spark.createDataFrame([(u,) for u in urns], "urn string")


def found(df):
    out = defaultdict(set)
    for r in df.collect():
        out[r.root, r.category].add(r.urn)
    return dict(out)


@pytest.fixture(scope="module")
def small_graph(spark):
    nodes = [
        ("core", "symbol", {"path": "src/core.ts", "lines": (1, 9), "symbol_kind": "function"}),
        ("mid", "symbol", {"path": "src/mid.ts", "lines": (5, 20), "symbol_kind": "function"}),
        ("file:mid", "file", {"path": "src/mid.ts"}),
        ("file:script", "file", {"path": "bin/script.ts"}),
        ("spec", "symbol", {"path": "t/a.test.ts", "lines": (12, 14), "symbol_kind": "function"}),
        ("file:b", "file", {"path": "t/b.test.ts"}),
        ("gone", "symbol", {"path": "src/gone.ts", "status": "retired", "lines": (1, 2)}),
        ("far", "symbol", {"path": "src/far.ts", "lines": (1, 2)}),
        ("get", "route", {"path": "src/mid.ts"}),
        ("put", "route", {"path": "src/other.ts"}),
        ("t1", "test", {"path": "t/a.test.ts", "lines": (10, 15)}),
        ("t2", "test", {"path": "t/a.test.ts", "lines": (20, 30)}),
        ("b1", "test", {"path": "t/b.test.ts", "lines": (1, 10)}),
        ("b2", "test", {"path": "t/b.test.ts", "lines": (11, 20)}),
        ("f:pay", "feature", {"name": "pay"}),
        ("f:old", "feature", {"name": "old", "status": "retired"}),
        ("f:ship", "feature", {"name": "ship"}),
        ("m:bill", "model", {"path": "schema/bill"}),
    ]
    edges = [
        ("mid", "core", "calls", {"line": 7}),
        ("file:mid", "core", "imports", {}),
        ("file:script", "mid", "calls", {}),
        ("spec", "core", "calls", {}),
        ("file:b", "core", "calls", {"line": 15}),
        ("gone", "core", "calls", {"line": 1}),
        ("far", "gone", "calls", {"line": 1}),
        ("mid", "f:pay", "implements", {"score": 0.6, "confidence": "INFERRED"}),
        ("mid", "f:pay", "belongs_to", {"score": 1.0, "confidence": "EXPLICIT"}),
        ("core", "f:old", "implements", {}),
        ("far", "f:ship", "implements", {}),
        ("get", "f:pay", "implements", {}),
        ("m:bill", "f:ship", "belongs_to", {}),
        ("file:mid", "f:ship", "belongs_to", {}),
        ("far", "mid", "calls", {"line": 2}),
    ]
    return make(spark, nodes, edges, [("was:core", "core")])


def test_impact_tiers_files_and_aliases(spark, small_graph):
    """A test's path is matched by call sites if any has a place, else by where consumers begin, else as a whole."""
    got = found(impact.impact(small_graph, asked(spark, "was:core", "core")))
    for root in ("was:core", "core"):
        assert got[root, "direct"] == {"mid", "spec", "file:b"}  # mid's file lies behind mid; retired callers lead nowhere
        assert got[root, "indirect"] == {"file:script", "far"}
        assert got[root, "feature"] == {"f:pay", "f:ship"}
        assert got[root, "route"] == {"get"}
        assert got[root, "test"] == {"t1", "b2"}
    counted = {r.root: r for r in impact.counts(small_graph, asked(spark, "core", "m:bill")).collect()}
    assert (counted["core"].direct, counted["core"].features, counted["core"].tests, counted["core"].risk) == (3, 2, 2, "MEDIUM")
    assert (counted["m:bill"].direct, counted["m:bill"].features) == (0, 1)


def test_tests_of_a_whole_file(spark):
    g = make(spark, [("core", "symbol", {"path": "a.ts", "lines": (1, 2)}), ("file:t", "file", {"path": "t.ts"}), ("t1", "test", {"path": "t.ts", "lines": (1, 2)}), ("t2", "test", {"path": "t.ts", "lines": (3, None)})], [("file:t", "core", "calls", {})])
    assert found(impact.impact(g, asked(spark, "core")))["core", "test"] == {"t1", "t2"}


def test_hotspots_count_apis_and_features_both_ways(spark, small_graph):
    got = {r.urn: r for r in impact.hotspots(small_graph).collect()}
    assert set(got) == {"core", "mid", "spec", "far", "file:mid", "file:script", "file:b", "m:bill"}
    core = got["core"]
    assert (core.n_in, core.n_out, core.features, core.consumers, core.apis, core.tests) == (5, 1, 1, 3, 1, 2)
    assert (core.score, core.rating) == (2 * 5 + 1 + 3 + 2 * 3 + 2, "HIGH")
    assert [r.urn for r in rules.too_coupled(impact.hotspots(small_graph), "r", 21).collect()] == ["core"]
    assert {r.urn for r in rules.untested(small_graph, "r", "src/**").collect()} == {"far", "mid"}


def test_view_explanation_and_coverage(spark, small_graph):
    view = defaultdict(set)
    for r in views.feature_view(small_graph).collect():
        view[r.feature, r.role].add(r.urn)
    assert dict(view) == {("f:pay", "services"): {"mid"}, ("f:pay", "api"): {"get"}, ("f:ship", "services"): {"far"}, ("f:ship", "database"): {"m:bill"}, ("f:pay", "consumers"): {"f:ship"}}
    got = {(r.target, r.feature): (r.confidence, r.score, len(r.edges)) for r in views.explain(small_graph, asked(spark, "mid", "was:core", "get")).collect()}
    assert got == {("mid", "f:pay"): ("EXPLICIT", 1.0, 2), ("mid", "f:ship"): ("INFERRED", 0.5, 1), ("was:core", "f:old"): ("DETECTED", 0.9, 1), ("get", "f:pay"): ("DETECTED", 0.9, 1)}
    docs = spark.createDataFrame([("docs/How-to-PAY.md",), (None,), ("",)], "path string")
    covered = {(r.feature, r.dimension): (r.n, r.status) for r in views.coverage(small_graph, docs).collect()}
    assert covered["f:pay", "documentation"] == (1, "COMPLETE") and covered["f:ship", "documentation"] == (0, "MISSING")
    assert {r.feature: r.percent for r in views.completeness(views.coverage(small_graph, docs)).collect()} == {"f:pay": 67, "f:ship": 33}
    assert views.named_in(small_graph.nodes.limit(0), docs).count() == 0


def test_function_map_order(spark):
    nodes = [(u, "symbol", {"path": p, "lines": (n, n), "symbol_kind": k}) for u, p, n, k in (("a", "z.ts", 1, "function"), ("b", "y.ts", 2, "method"), ("c", "y.ts", 1, "class"), ("v", "y.ts", 3, "constant"))] + [("x", "symbol", {"path": "x.ts", "symbol_kind": "function"}), ("f", "feature", {})]
    edges = [(u, "f", "implements", {}) for u in "abcv"] + [("a", "b", "calls", {}), ("a", "b", "calls", {}), ("x", "b", "imports", {}), ("x", "c", "calls", {}), ("a", "v", "calls", {})]
    got = [(r.urn, r.callers, r.shared, r.entry, r.inner_calls) for r in views.function_map(make(spark, nodes, edges)).orderBy("place").collect()]
    assert got == [("c", 1, False, True, 0), ("a", 0, False, True, 1), ("b", 3, True, False, 0)]


def test_review(spark, small_graph):
    files = spark.createDataFrame([("src/core.ts",), ("schema/bill",), ("src/mid.ts",)], "path string")
    r = review.review(small_graph, files).first()
    assert (r.files, r.symbols, r.apis, r.models, r.features, r.tests, r.direct_consumers, r.risk) == (3, 2, 1, 1, 3, 2, 5, "HIGH")
    assert len(r.concerns) == 3
    quiet = review.review(small_graph, spark.createDataFrame([("t/a.test.ts",), ("src/core.ts",)], "path string")).first()
    assert quiet.concerns == [] and quiet.risk == "HIGH"
    none = review.review(small_graph, files.limit(0)).first()
    assert (none.files, none.risk, none.concerns) == (0, "LOW", [])


def test_problems(spark):
    import hashlib

    text = "a\nb\nc\nd"
    same = hashlib.sha256(b"b\nc").hexdigest()[:16]
    nodes = [
        ("ok", "symbol", {"path": "f.ts", "lines": (2, 3), "hash": same}),
        ("moved", "symbol", {"path": "f.ts", "lines": (1, 2), "hash": same}),
        ("beyond", "symbol", {"path": "f.ts", "lines": (3, 9), "hash": "x"}),
        ("lost", "route", {"path": "g.ts"}),
        ("retired", "symbol", {"path": "g.ts", "status": "retired"}),
        ("f", "feature", {}),
        ("empty", "feature", {}),
    ]
    g = make(spark, nodes, [("ok", "f", "implements", {}), ("ok", "nowhere", "calls", {}), ("ok", "retired", "calls", {})])
    found = review.problems(g, spark.createDataFrame([("f.ts", text)], "path string, text string"))
    assert {(r.severity, r.problem, r.urn) for r in found.collect()} == {
        ("warning", "changed since it was read", "moved"),
        ("warning", "lines beyond the file", "beyond"),
        ("error", "missing file", "lost"),
        ("error", "missing target", "ok > nowhere"),
        ("warning", "nothing linked", "empty"),
    }
    assert tuple(review.report(found).first()) == (2, 3, False)


def test_dead_code_leaves_tests_and_entries(spark):
    nodes = [("a", "symbol", {"path": "src/a.ts"}), ("t", "symbol", {"path": "tests/a.ts"}), ("i", "symbol", {"path": "src/index.ts"}), ("used", "symbol", {"path": "src/u.ts"}), ("py", "symbol", {"path": "x.py"})]
    g = make(spark, nodes, [("a", "used", "calls", {})])
    assert {r.urn for r in graph.dead_symbols(g).collect()} == {"a", "i", "py"}
    assert {r.path for r in graph.dead_files(g).collect()} == {"src/a.ts"}


def test_alias_given_again(spark, small_graph):
    g = graph.with_alias(small_graph, spark.createDataFrame([("was:core", "mid"), ("x", "core")], "old_urn string, urn string"))
    assert {tuple(r) for r in g.aliases.collect()} == {("was:core", "mid"), ("x", "core")}


def plain_reach(edges, root):
    seen, at = {root: 0}, [root]
    for u in at:
        for s, t in edges:
            if t == u and s not in seen:
                seen[s] = seen[u] + 1
                at.append(s)
    return {k: v for k, v in seen.items() if v}


def test_consumers_against_plain_search(spark):
    rng = random.Random(8)
    names = [f"n{i}" for i in range(60)]
    edges = {(rng.choice(names), rng.choice(names)) for _ in range(90)}
    df = spark.createDataFrame(list(edges), "source_urn string, target_urn string")
    got = defaultdict(dict)
    for r in traverse.consumers(df, asked(spark, *names[:20])).collect():
        got[r.root][r.urn] = r.depth
    assert all(got[n] == plain_reach(edges, n) for n in names[:20])


def test_hotspots_with_a_limit(spark):
    """The first by score, though routes are looked for from a part of the nodes alone; cycles, ties and routes in many ways."""
    rng = random.Random(4)
    for size in (30,):
        nodes = [(f"s{i:02d}", rng.choice(["symbol", "file", "model"]), {"path": f"p{rng.randrange(size // 3)}"}) for i in range(size)]
        nodes += [(f"r{i}", "route", {"path": f"p{rng.randrange(size // 3)}"}) for i in range(8)] + [("f", "feature", {})]
        names = [n[0] for n in nodes]
        edges = [(rng.choice(names), f"s{min(rng.randrange(size), rng.randrange(size)):02d}", "calls", {}) for _ in range(size * 3 // 2)] + [("s00", "f", "implements", {}), ("r0", "s01", "exposes", {})]
        g = make(spark, nodes, edges)
        whole = sorted((-r.score, r.urn, tuple(r)) for r in impact.hotspots(g).collect())
        for k in (2,):
            assert [tuple(r) for r in impact.hotspots(g, k).collect()] == [r for _, _, r in whole[:k]]
        allowed = {r.urn: r.bound for r in impact.route_bounds(g.active(), impact.live_edges(g)).collect()}
        assert all(allowed[u] >= r[8] for _, u, r in whole)


def test_counts_are_those_of_impact(spark, monkeypatch):
    """Over more tests of a path than share a number, old names, evidence in other files, loops, and nodes that are retired, pathless or unknown."""
    monkeypatch.setattr(reach, "BITS", 2)
    for seed in (1,):
        rng = random.Random(seed)
        paths = ["p0", "p1", "p2", "p3", "", None]
        kinds = ["symbol"] * 12 + ["file"] * 5 + ["model"] * 2 + ["route"] * 5 + ["test"] * 9 + ["feature"] * 4
        nodes = []
        for i, kind in enumerate(kinds):
            begin = rng.choice([None, 0, rng.randrange(1, 20)])
            nodes.append((f"n{i}", kind, {"path": rng.choice(paths), "status": "retired" if rng.random() < 0.1 else "active", "lines": (begin, rng.choice([None, (begin or 0) + rng.randrange(6)]))}))
        names = [n[0] for n in nodes] + ["old", "none"]
        edges = [(rng.choice(names), rng.choice(names), rng.choice(["calls", "implements", "belongs_to"]), {"line": rng.choice([None, 0, rng.randrange(1, 22)]), "file": rng.choice([None, "", None, "p0", "p1", "elsewhere"])}) for _ in range(45)]
        g = make(spark, nodes, edges, [("old", "n3")])
        want = defaultdict(dict)
        for (root, category), urns in found(impact.impact(g, asked(spark, *names))).items():
            want[root][category] = len(urns)
        got = defaultdict(dict)
        for r in impact.category_counts(g, asked(spark, *names)).collect():
            got[r.root][r.category] = r.n
        assert got == want and len({c for by in want.values() for c in by}) == 5
        assert sorted(r.root for r in impact.counts(g, asked(spark, *names)).collect()) == sorted(names)


def test_what_is_reached_is_dealt_once(spark, small_graph):
    counted = impact.counts(small_graph, asked(spark, "core", "mid"))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(root#\d+L?, \d+\), REPARTITION", counted)) == 1
    assert not re.search(r"Exchange hashpartitioning\(root#\d+L?, (path|urn|category|depth)#", counted)  # before: for each list and each path
