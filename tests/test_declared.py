"""Declared features and rules, checks of rules, and scans with everything in them."""

import json
import logging
import os

import pytest
from pyspark.sql import functions as F

from graphloom.operators import rules
from graphloom.operators.graph import Graph
from graphloom.sources import declared, files


def write(root, tree):
    for path, text in tree.items():
        os.makedirs((root / path).parent, exist_ok=True)
        (root / path).write_bytes(text if isinstance(text, bytes) else text.encode())


def test_scan_takes_everything(spark, tmp_path):
    tree = {".eslintrc": "x", "_a/b.ts": "é", "empty.ts": "", "a/.b/c.md": "deep", "bad.ts": b"\xff", ".git/config": "x", "a/node_modules/x.js": "x", ".env": "x", "a/k.pem": "x"}
    write(tmp_path, tree)
    os.symlink(tmp_path / "nowhere", tmp_path / "a" / "broken.ts")
    os.symlink(tmp_path / "a", tmp_path / "loop")
    os.mkfifo(tmp_path / "pipe")
    for parts in (1, 64):
        found = files.scan(spark, str(tmp_path) + "/", parts).cache()
        texts = {r.path: (r.text, r.bytes) for r in found.where("problem is null").collect()}
        assert texts == {".eslintrc": ("x", 1), "_a/b.ts": ("é", 2), "empty.ts": ("", 0), "a/.b/c.md": ("deep", 4), "bad.ts": ("�", 1)}
        assert [tuple(r) for r in files.problems(found).collect()] == [("a/broken.ts", "FileNotFoundError")]
        assert not found.where("problem is null and hash != sha2(text, 256) and path != 'bad.ts'").count()
    (gone,) = files.scan(spark, str(tmp_path / "none")).collect()
    assert (gone.path, gone.text, gone.problem) == ("", None, "FileNotFoundError")
    os.makedirs(tmp_path / "new")
    assert files.scan(spark, str(tmp_path / "new")).count() == 0


def test_many_files_in_one_folder(spark, tmp_path):
    write(tmp_path, {f"d/{i}.ts": str(i) * 3 for i in range(300)})
    found = files.scan(spark, str(tmp_path), 8)
    assert {r.path: r.text for r in found.collect()} == {f"d/{i}.ts": str(i) * 3 for i in range(300)}
    assert found.groupBy(F.spark_partition_id()).count().count() > 1  # contents are read by more than the task that lists the folder


def test_features(spark, tmp_path):
    pytest.importorskip("yaml")
    write(
        tmp_path,
        {
            "a.yaml": "feature: Sign In\ndisplayName: Signing in\ntags: [auth, web]\nunknown: {x: 2024-01-01}\n",
            "b.YML": "feature: mail\nname: ''\n",
            "c.json": json.dumps({"feature": "cart", "name": "Cart"}),
            "d.json": json.dumps({"name": "no key"}),
            "e.yaml": "a: [1\n",
            "f.json": "[1]",
            "g.yaml": "",
            "i.yaml": "# nothing yet\n",
            "h.txt": "feature: no",
        },
    )
    found = {(r.urn, r.name, r.display_name, tuple(r.tags), r.confidence_score) for r in declared.features(spark, str(tmp_path)).collect()}
    assert found == {("urn:loom:feature:sign-in", "Sign In", "Signing in", ("auth", "web"), 1.0), ("urn:loom:feature:mail", "mail", "mail", (), 1.0), ("urn:loom:feature:cart", "cart", "Cart", (), 1.0)}
    assert {r.file for r in declared.problems(spark, str(tmp_path)).collect()} == {"e.yaml", "f.json"}
    assert declared.features(spark, str(tmp_path / "none")).count() == 0


def test_rules_from_the_first_file_that_can_be_read(spark, tmp_path, caplog):
    pytest.importorskip("yaml")
    root = str(tmp_path)
    assert declared.rules(spark, root) == list(declared.DEFAULT_RULES)
    write(tmp_path, {"loom/rules.json": json.dumps([{"name": "a", "from": "x/**", "cannotImport": "y/**"}, 7, {"from": "z"}])})
    with caplog.at_level(logging.WARNING):
        assert declared.rules(spark, root) == [{"name": "a", "from": "x/**", "cannot_import": "y/**"}]
    assert "2 entries" in caplog.text
    write(tmp_path, {"loom/rules.yaml": "rules:\n- {name: b, target: 'src/**', requiresTests: true}\n- {name: c, max_coupling: 5}\n"})
    both = [{"name": "b", "target": "src/**", "requires_tests": True}, {"name": "c", "max_coupling": 5}]
    assert declared.rules(spark, root) == both
    write(tmp_path, {"own.yaml": "a: [1\n"})
    with caplog.at_level(logging.WARNING):
        assert declared.rules(spark, root, str(tmp_path / "own.yaml")) == both
    assert "own.yaml" in caplog.text
    write(tmp_path, {"own.yaml": "other: 1\n"})
    assert declared.rules(spark, root, str(tmp_path / "own.yaml")) == []
    write(tmp_path, {"own.yaml": ""})
    assert declared.rules(spark, root, str(tmp_path / "own.yaml")) == both


def test_without_yaml(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(declared, "yaml", None)
    write(tmp_path, {"loom/rules.yaml": "rules: []", "loom/rules.json": '{"rules": [{"name": "a"}]}'})
    assert declared.rules(spark, str(tmp_path)) == [{"name": "a"}]


def test_check(spark):
    nodes = [("ui", "symbol", "Ui", "src/ui/a.ts", 3), ("db", "symbol", "Db", "src/db/b.ts", 5), ("t", "test", "t", "src/ui/a.test.ts", 1), ("ext", "symbol", "Ext", "", 0)]
    n = spark.createDataFrame([(u, k, m, p, "active", s, s + 1) for u, k, m, p, s in nodes], "urn string, kind string, name string, path string, status string, start_line int, end_line int")
    e = spark.createDataFrame([("ui", "db", "calls"), ("ui", "db", "imports"), ("ui", "db", "documents"), ("ui", "ext", "calls"), ("t", "ui", "tests")], "source_urn string, target_urn string, relationship string")
    g = Graph(n, e)
    asked = [
        {"name": "apart", "from": "src/ui/*", "cannot_import": "src\\db\\**", "max_coupling": 0},
        {"name": "apart", "from": "src/**", "cannot_import": "src/db/*"},
        {"name": "tested", "target": "src/*/*.ts", "requires_tests": True, "max_coupling": 3},
        {"name": "half", "target": "src/**", "requires_tests": False, "from": "src/**"},
    ]
    got = [(r.rule, r.severity, r.urn, r.target_urn, r.line, r.score) for r in rules.check(g, asked).collect()]
    scores = {r.urn: r.score for r in rules.hotspots(g).collect()}
    loose = sorted(("tested", "WARNING", u, None, None, s) for u, s in scores.items() if s > 3)
    assert loose and sorted(x for x in got if x[5] is not None) == loose
    assert sorted(x for x in got if x[1] == "ERROR") == [("apart", "ERROR", "ui", "db", None, None)] * 4  # two edges by two rules of one name
    bare = {x[2] for x in got if x[1] == "WARNING" and x[5] is None}
    assert bare == {r.urn for r in rules.untested(g, "tested", "src/*/*.ts").collect()}
    assert [tuple(r) for r in rules.outcome(rules.check(g, asked), asked).collect()] == [(4, 0, 4, len(got), False)]
    assert rules.check(g, []).count() == 0
    (none,) = rules.outcome(rules.check(g, [asked[3]]), [asked[3]]).collect()
    assert (none.rules, none.passed, none.compliant) == (1, 1, True)
    assert rules.check(Graph(n.limit(0), e.limit(0)), asked).count() == 0
