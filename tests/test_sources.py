"""Small source trees, the store, the ledger and the streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from graphloom.operators import context, extract, graph
from graphloom.operators.graph import Graph
from graphloom.sources import declared, store, tree
from graphloom.streaming import watch

RUST = """use std::collections::{HashMap, HashSet as Set};
use crate::db::*;
pub struct Repo {
    n: i32,
}
impl Repo {
    pub fn load(&self) -> i32 {
        if self.n > 0 { fetch(self.n) } else { 0 }
    }
}
const LIMIT: i32 = 3;
#[get("/items")]
async fn items() {
}
#[test]
fn it_loads() {
    Repo::load(1);
}
"""
PRISMA = """model User {
  // people
  id    Int    @id
  posts Post[] @relation("x")
  @@map("users")
}
"""
TS = """import React, { useState as s, type Foo } from 'react';
import * as path from 'path';
import './side';
export interface Item {
  id: number;
}
export const useItems = (n) => {
  return load(n);
};
export function Panel() {
  if (ready()) {
    go();
  }
}
describe('panel', () => {
  it('shows', () => {
    expect(1);
  });
});
"""
GO = """package x
import (
\t"fmt"
\tlog "github.com/a/zap"
)
const Max = 3
func (r *Repo) Save(x int) {
\tfmt.Println(x)
}
func TestSave(t *T) {
}
"""
PYTHON = """import os, sys as system
from .db import (A, B as C)
LIMIT = 3
class TestThing:
    def test_it(self):
        check(len(os.path))

        def inner():
            deep()
    # still inside
def _hidden():
    pass
"""
NEXT = "export async function GET() {\n  return 1;\n}\n"
JAVA = """@RestController
@RequestMapping("/api")
public class Users {
    public static final int MAX = 3;
    @PostMapping("/users")
    public void add(int n) {
        repo.save(n);
    }
    @Test
    void adds() {
    }
}
"""
TREE = {"src/repo.rs": RUST, "schema.prisma": PRISMA, "src/panel.test.tsx": TS, "x_test.go": GO, "tests/test_a.py": PYTHON, "app/users/route.ts": NEXT, "src/Users.java": JAVA, "README.md": "def no(): pass", "empty.py": "", "null.py": None}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(TREE.items()), "path string, text string").cache()


def got(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_symbols(files):
    rows = got(extract.symbols(files), "path", "kind", "name", "scope", "start_line", "end_line", "is_exported")
    of = lambda path: {r[1:] for r in rows if r[0] == path}
    assert of("src/repo.rs") == {("class", "Repo", None, 3, 5, True), ("method", "load", "Repo", 7, 9, True), ("variable", "LIMIT", None, 11, 11, False), ("function", "items", None, 13, 14, False), ("function", "it_loads", None, 16, 18, False)}
    assert of("src/panel.test.tsx") == {("interface", "Item", None, 4, 6, True), ("hook", "useItems", None, 7, 9, True), ("component", "Panel", None, 10, 14, True)}
    assert of("x_test.go") == {("variable", "Max", None, 6, 6, True), ("method", "Save", "Repo", 7, 9, True), ("function", "TestSave", None, 10, 11, True)}
    assert of("tests/test_a.py") == {("variable", "LIMIT", None, 3, 3, True), ("class", "TestThing", None, 4, 10, True), ("method", "test_it", "TestThing", 5, 10, True), ("method", "inner", "TestThing", 8, 10, True), ("function", "_hidden", None, 11, 13, False)}
    assert of("src/Users.java") == {("class", "Users", None, 3, 12, True), ("variable", "MAX", None, 4, 4, True), ("method", "add", "Users", 6, 8, True), ("method", "adds", "Users", 10, 11, False)}
    assert not of("README.md") and not of("empty.py") and not of("null.py")


def test_imports(files):
    rows = {(r[0], r[1], tuple(r[2]), r[3], r[4]) for r in extract.imports(files).select("source_file", "module_specifier", "imported_symbols", "is_default", "is_namespace").collect()}
    assert rows == {
        ("src/repo.rs", "std/collections", ("HashMap", "HashSet"), False, False), ("src/repo.rs", "crate/db", ("*",), False, True),
        ("src/panel.test.tsx", "react", ("React", "useState", "Foo"), True, False), ("src/panel.test.tsx", "path", ("path",), False, True), ("src/panel.test.tsx", "./side", (), False, False),
        ("x_test.go", "fmt", ("fmt",), False, True), ("x_test.go", "github.com/a/zap", ("zap",), False, True),
        ("tests/test_a.py", "os", ("os",), False, True), ("tests/test_a.py", "sys", ("sys",), False, True), ("tests/test_a.py", ".db", ("A", "B"), False, False),
    }


def test_routes_tests_models_calls(files):
    assert got(extract.routes(files), "path", "http_method", "route_path") == {("src/repo.rs", "GET", "/items"), ("app/users/route.ts", "GET", "/users"), ("src/Users.java", "POST", "/api/users")}
    assert got(extract.tests(files), "path", "test_type", "suite_name", "test_name", "start_line", "end_line") == {
        ("src/repo.rs", "case", None, "it_loads", 16, 18), ("x_test.go", "case", None, "TestSave", 10, 11), ("tests/test_a.py", "suite", None, "TestThing", 4, 10), ("tests/test_a.py", "case", "TestThing", "test_it", 5, 10),
        ("src/panel.test.tsx", "suite", None, "panel", 15, 19), ("src/panel.test.tsx", "case", None, "shows", 16, 18), ("src/Users.java", "case", "Users", "adds", 10, 11),
    }
    (model,) = extract.models(files).collect()
    assert model["name"] == "User" and [tuple(f) for f in model["fields"]] == [("id", "Int", True, False), ("posts", "Post[]", False, True)]
    calls = got(extract.calls(files), "file", "caller", "callee_name")
    assert {c for c in calls if c[0] == "tests/test_a.py"} == {("tests/test_a.py", "test_it", "check"), ("tests/test_a.py", "inner", "deep")}
    assert {("src/repo.rs", "load", "fetch"), ("src/repo.rs", "it_loads", "Repo::load"), ("x_test.go", "Save", "fmt.Println"), ("src/Users.java", "add", "repo.save"), ("src/panel.test.tsx", "Panel", "ready"), ("src/panel.test.tsx", "useItems", "load")} <= calls


def test_scan_and_declared(spark, tmp_path):
    for path, text in {**TREE, "node_modules/a.js": "x", "keys/a.pem": "x"}.items():
        os.makedirs(tmp_path / "t" / os.path.dirname(path), exist_ok=True)
        (tmp_path / "t" / path).write_text(text or "")
    rows = tree.scan(spark, str(tmp_path / "t")).collect()
    assert {r["path"] for r in rows} == {path for path, text in TREE.items() if text}
    assert {r["text"] for r in rows if r["path"] == "src/repo.rs"} == {RUST}
    os.makedirs(tmp_path / "f")
    (tmp_path / "f" / "a.json").write_text(json.dumps({"feature": "Sign In", "tags": ["auth"]}))
    (tmp_path / "f" / "b.json").write_text(json.dumps({"name": "none"}))
    (row,) = declared.features(spark, str(tmp_path / "f")).collect()
    assert (row["urn"], row["confidence_score"], row["tags"]) == ("urn:loom:feature:sign-in", 1.0, ["auth"])


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for day, n in ((1, 5), (1, 7), (2, 1)):
        tree.append_usage(spark.sql(f"select 'impact' command, timestamp'2024-01-0{day} 10:00:00' timestamp, {n} tokens_generated"), path)
    assert got(tree.usage_totals(tree.usage(spark, path)), "day", "command", "n", "tokens") == {(None, None, 3, 13), ("2024-01-01", None, 2, 12), ("2024-01-02", None, 1, 1), (None, "impact", 3, 13)}
    q = watch.usage_by_day(spark, path).writeStream.format("memory").queryName("usage_days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["tokens"] for r in spark.table("usage_days").collect()) == [1, 12]


def test_store(spark, tmp_path):
    folder = str(tmp_path / "g")
    with pytest.raises(store.StoreError):
        store.load(spark, folder)
    nodes = spark.createDataFrame([("a", "symbol", "a", "p", "active"), ("b", "symbol", "b", "q", "retired")], "urn string, kind string, name string, path string, status string")
    edges = spark.createDataFrame([("a", "a", "calls"), ("a", "b", "calls")], "source_urn string, target_urn string, relationship string")
    store.save(Graph(nodes.limit(1), edges), folder)
    store.save(Graph(nodes, edges), folder)
    g = store.load(spark, folder)
    assert g.nodes.count() == 2 and g.edges.count() == 2 and store.metadata(spark, folder).count() == 2
    assert [r["table"] for r in store.export_json(g).orderBy("table").collect()] == ["edge", "node"]


def files_below(folder):
    return {os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def test_store_buckets(spark, tmp_path):
    """Aliases come back; a change of one node writes its bucket alone; earlier versions stay; clean deletes the store's files only."""
    folder = str(tmp_path / "g")
    assert not store.initialised(spark, folder)
    nodes = spark.createDataFrame([(f"n{i}", "symbol", f"n{i}", f"p{i % 9}", "active") for i in range(400)], "urn string, kind string, name string, path string, status string")
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "calls") for i in range(399)] + [("n0", "n1", "calls")], "source_urn string, target_urn string, relationship string")
    aliases = spark.createDataFrame([("old", "n1")], "old_urn string, urn string")
    first = store.save(Graph(nodes, edges, aliases), folder)
    assert store.initialised(spark, folder)
    before = files_below(folder)
    g = store.load(spark, folder)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(g.nodes, nodes) and same(g.edges, edges) and same(g.aliases, aliases)
    changed = nodes.withColumn("name", F.when(F.col("urn") == "n7", "other").otherwise(F.col("name")))
    store.save(Graph(changed, g.edges, g.aliases), folder)
    new = files_below(folder) - before
    assert len({os.path.dirname(f) for f in new if "/tables/" in f}) == 1
    written, whole = (sum(os.path.getsize(f) for f in fs if "/tables/nodes/" in f) for fs in (new, before))
    assert written * 8 < whole
    assert same(store.load(spark, folder).nodes, changed) and same(store.load(spark, folder, first).nodes, nodes)
    left = graph.remove(store.load(spark, folder), spark.createDataFrame([("n1",)], "urn string"))
    assert left.nodes.count() == 399 and left.edges.count() == 397 and left.aliases.count() == 0
    left = graph.remove_edges(left, spark.createDataFrame([("n5", "n6")], "source_urn string, target_urn string"))
    store.save(Graph(left.nodes, left.edges), folder)
    g = store.load(spark, folder)
    assert g.edges.count() == 396 and g.aliases is None
    store.save(Graph(g.nodes.limit(0), g.edges.limit(0), aliases.limit(0)), folder)
    assert store.load(spark, folder).nodes.count() == 0 and store.load(spark, folder).aliases.count() == 0
    (tmp_path / "g" / "mine.txt").write_text("x")
    store.clean(spark, folder)
    assert not store.initialised(spark, folder) and os.listdir(folder) == ["mine.txt"]
    store.clean(spark, folder)
    with pytest.raises(store.StoreError):
        store.load(spark, folder)


def test_usage_filters(spark, tmp_path):
    rows = [("a", "2024-01-01 10:00:00", "x", 5), ("a", "2024-01-02 10:00:00", "y", 7), ("b", "2024-01-02 11:00:00", "x", 1)]
    ledger = spark.createDataFrame(rows, "session_id string, timestamp string, command string, tokens_generated int").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    whole = lambda df: [tuple(r)[2:] for r in df.where("day is null and command is null").collect()]
    assert whole(tree.usage_totals(ledger)) == [(3, 13, 2)]
    assert whole(tree.usage_totals(ledger, session="a")) == [(2, 12, 1)] and whole(tree.usage_totals(ledger, day="2024-01-02")) == [(2, 8, 2)]
    path = str(tmp_path / "ledger")
    tree.append_usage(ledger, path)
    tree.reset_usage(spark, path)
    assert tree.usage(spark, path).count() == 0
    tree.append_usage(ledger.limit(1), path)
    assert tree.usage(spark, path).count() == 1


def test_watch(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "nodes")
    spark.sql("select '' urn, '' kind, '' path, '' status, current_timestamp() created_at").limit(0).write.parquet(f"{out}/start")
    seen = ["start"]

    def read():
        return spark.read.parquet(f"{out}/{seen[-1]}")

    def write(nodes, number):
        nodes.write.mode("overwrite").parquet(f"{out}/{number}")
        seen.append(str(number))

    def send(*events):
        spark.createDataFrame(list(events), watch.CHANGE).coalesce(1).write.mode("append").json(inbox)
        watch.watch(watch.changes(spark, inbox), read, write, str(tmp_path / "cp"), every=None).awaitTermination(90)
        return got(read(), "urn", "status")

    assert send(("a.py", "def old():\n  pass", "added", 1), ("a.py", "def f():\n  pass", "modified", 2), ("b.py", "def g():\n  pass", "added", 1)) == {("urn:loom:symbol:a.py#f", "active"), ("urn:loom:symbol:b.py#g", "active")}
    assert send(("a.py", None, "deleted", 3)) == {("urn:loom:symbol:a.py#f", "retired"), ("urn:loom:symbol:b.py#g", "active")}


def test_context(spark):
    features = spark.createDataFrame([("f", "Login"), ("g", "Empty")], "feature string, title string")
    lines = [("f", "tests", "t1", 1), ("f", "api", "GET /b", 2), ("f", "api", "GET /a", 1), ("f", "services", "x" * 900, 1), ("f", "other", "no", 1), ("h", "api", "no", 1)]
    rows = {r["feature"]: r for r in context.contexts(features, spark.createDataFrame(lines, "feature string, category string, line string, sort int"), 100).collect()}
    assert rows["f"]["context"] == "# Feature Context: Login\n\n## API Endpoints\n- GET /a\n- GET /b\n\n## Related Tests\n- t1\n"
    assert (rows["f"]["sections"], rows["f"]["dropped"], rows["g"]["sections"]) == (3, 1, 1)


def test_settled_changes(spark, tmp_path):
    """Bursts end after a quiet time; repeated and ignored events, and those that come too late, change nothing."""
    inbox = str(tmp_path / "in")
    at = lambda ms: f"2024-01-01 00:00:{ms // 1000:02d}.{ms % 1000:03d}"

    def send(*rows):
        spark.createDataFrame([(*r[:4], at(r[4])) for r in rows], f"{watch.CHANGE}, at string").coalesce(1).write.mode("append").json(inbox)

    out = []

    def take(batch, _):
        out.extend((r.path, r.text, r.change, r.events) for r in batch.collect())

    def run():
        q = watch.settled(watch.events(spark, inbox)).writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    send(("a.ts", "1", "added", 1, 0), ("a.ts", "2", "modified", 2, 300), ("a.ts", "2", "modified", 2, 300), ("node_modules/x.js", "z", "added", 3, 310))
    run()
    assert out == []
    send(("a.ts", "3", "modified", 4, 700), ("b.ts", "b", "added", 5, 800))
    run()
    send(("c.ts", "c", "added", 6, 9000))
    run()
    assert sorted(out) == [("a.ts", "3", "modified", 4), ("b.ts", "b", "added", 1)]
    send(("a.ts", "late", "modified", 7, 900), ("d.ts", "d", "added", 8, 20000))
    run()
    assert sorted(out)[2:] == [("c.ts", "c", "added", 1)]


def test_affected_features(spark):
    nodes = spark.createDataFrame([("s", "symbol", "s", "a.ts", "active"), ("t", "symbol", "t", "b.ts", "active"), ("f", "feature", "f", "", "active")], "urn string, kind string, name string, path string, status string")
    edges = spark.createDataFrame([("s", "f", "implements")], "source_urn string, target_urn string, relationship string")
    batch = spark.createDataFrame([("a.ts",), ("a.ts",), ("b.ts",), ("no",)], "path string")
    assert [tuple(r) for r in watch.affected(Graph(nodes, edges), batch).collect()] == [("a.ts", "f")]
