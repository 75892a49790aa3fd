"""Briefs, plans and settings on small inputs whose results are plain to see."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.operators import brief
from graphloom.operators.graph import Graph
from graphloom.sources import settings


@pytest.fixture(scope="module")
def shop(spark):
    nodes = [
        ("f:cart", "feature", "cart", "", 0, 0, "active"),
        ("f:mail", "feature", "mail", "", 0, 0, "active"),
        ("s:add", "symbol", "addToCart", "src/cart.ts", 1, 9, "active"),
        ("s:sum", "symbol", "sumCart", "src/cart.ts", 11, 15, "active"),
        ("s:view", "symbol", "CartView", "src/CartView.tsx", 1, 5, "active"),
        ("s:send", "symbol", "sendMail", "src/mail.ts", 1, 5, "active"),
        ("s:old", "symbol", "cartOld", "src/old.ts", 1, 5, "retired"),
        ("r:add", "route", "POST /cart", "src/routes.ts", 3, 3, "active"),
        ("m:cart", "model", "CartRow", "db/schema", 1, 4, "active"),
        ("t:add", "test", "adds", "tests/cart.test.ts", 2, 4, "active"),
    ]
    edges = [(s, "f:cart", "implements") for s in ("s:add", "s:sum", "s:view", "r:add", "m:cart", "t:add")] + [
        ("s:send", "f:mail", "implements"),
        ("s:add", "s:sum", "calls"),
        ("s:send", "s:sum", "calls"),
        ("s:old", "s:sum", "calls"),
    ]
    n = spark.createDataFrame(nodes, "urn string, kind string, name string, path string, start_line int, end_line int, status string")
    n = n.selectExpr("*", "cast(null as string) display_name", "'DETECTED' confidence", "0.85D confidence_score", "array('shop') tags")
    return Graph(n, spark.createDataFrame(edges, "source_urn string, target_urn string, relationship string"))


def test_brief_lines(shop):
    features = shop.active().where("urn = 'f:cart'").selectExpr("urn feature", "name title")
    got = {(r.section, r.line) for r in brief.brief_lines(shop, features).collect()}
    assert got == {
        ("FEATURE", "FEATURE cart"),
        ("ENTRY", "src/cart.ts:1-9 addToCart -> 1 inside"),
        ("ENTRY", "src/CartView.tsx:1-5 CartView"),
        ("CORE", "src/cart.ts:11-15 sumCart !shared(2)"),
        ("API", "POST /cart @ src/routes.ts:3"),
        ("TESTS", "adds @ tests/cart.test.ts:2"),
        ("BLAST RADIUS", "sumCart src/cart.ts:11: 2 callers"),
    }


def test_primary_feature(shop):
    find = lambda task: [r.feature for r in brief.primary_feature(shop, task).collect()]
    assert find("cart") == ["f:cart"]
    assert find("sum the cart again") == ["f:cart"]
    assert find("send mail") == ["f:mail"]
    assert find("quarterly forecast") == []


def test_task_plan(shop):
    files = {r.path: (r.role, r.reason) for r in brief.likely_files(shop, "cart").collect()}
    assert files == {"src/cart.ts": ("Service", "member"), "src/CartView.tsx": ("UI", "member"), "src/routes.ts": ("API", "member"), "db/schema": ("Model", "member"), "tests/cart.test.ts": ("Test", "member")}
    plan = [(r.phase, r.title, r.urn) for r in brief.task_plan(shop, "cart").orderBy("phase", "urn").collect()]
    assert plan == [(1, "Data models", "m:cart"), (2, "Services", "s:add"), (2, "Services", "s:sum"), (3, "Endpoints", "r:add"), (4, "User interface", "s:view"), (5, "Verification", "t:add")]
    assert [(r.phase, r.title, r.urn) for r in brief.task_plan(shop, "send mail").orderBy("phase").collect()] == [(1, "Services", "s:send"), (2, "Verification", None)]
    assert brief.task_plan(shop, "quarterly forecast").collect() == []


def test_feature_list_and_payload(shop):
    assert {(r.urn, r.title, r.percent, *r.tags) for r in brief.feature_list(shop).collect()} == {("f:cart", "cart", 85, "shop"), ("f:mail", "mail", 85, "shop")}
    rows = [(r.part, json.loads(r.json)) for r in brief.payload(shop).collect()]
    assert sum(p == "node" for p, _ in rows) == 9
    assert not any(x.get("source_urn") == "s:old" for _, x in rows)
    assert sum(p == "edge" for p, _ in rows) == 9


def test_settings(spark, tmp_path):
    root = str(tmp_path)
    assert settings.load(spark, root) == settings.DEFAULTS
    (tmp_path / "loom").mkdir()
    (tmp_path / "loom" / "config.json").write_text('{"token_budget": 10, "confidence": {"inferred": 0.4}}')
    got = settings.load(spark, root)
    assert got["token_budget"] == 10 and got["confidence"] == {"explicit": 1.0, "detected": 0.85, "inferred": 0.4, "unknown": 0.1} and got["max_bytes"] == 2 << 20
    (tmp_path / "loom.config.json").write_text("[not json")
    assert settings.load(spark, root) == got


def test_symbol_lines(spark):
    rows = [(f"s:{i}", "symbol", n, "src/a.ts", 10 * i, 10 * i + 5, "active", k) for i, (n, k) in enumerate([("parseDate", "function"), ("parseTime", "function"), ("parse", "method"), ("parseCache", "variable"), ("caller", "function"), ("other", "function"), ("gone", "function")])]
    nodes = spark.createDataFrame(rows, "urn string, kind string, name string, path string, start_line int, end_line int, status string, symbol_kind string").selectExpr("*", "cast(null as string) display_name", "'DETECTED' confidence", "0.85D confidence_score", "array('x') tags")
    nodes = nodes.withColumn("status", F.when(F.col("urn") == "s:6", "retired").otherwise("active"))
    edges = spark.createDataFrame([("s:4", "s:0", "calls"), ("s:4", "s:0", "calls"), ("s:5", "s:0", "imports"), ("s:6", "s:0", "calls"), ("s:0", "s:1", "calls"), ("s:5", "s:1", "tests")], "source_urn string, target_urn string, relationship string")
    g = Graph(nodes, edges)
    lines = lambda df: [r.line for r in df.orderBy("section", "sort").collect()]
    assert lines(brief.symbol_lines(g, "parse")) == [  # three others are there, so the variable goes
        "src/a.ts:20-25 parse (method)",
        "src/a.ts:0-5 parseDate (function) !shared(3)",
        "called by: caller, other",
        "calls: parseTime",
        "src/a.ts:10-15 parseTime (function)",
        "called by: parseDate",
    ]
    assert lines(brief.symbol_lines(g, "cache")) == ["src/a.ts:30-35 parseCache (variable)"]
    assert lines(brief.symbol_lines(g, "parse", most=1, near=1)) == ["src/a.ts:20-25 parse (method)"]
    assert lines(brief.symbol_lines(g, "nowhere")) == []
    assert lines(brief.symbol_lines(Graph(nodes.limit(0), edges), "parse")) == []
    assert lines(brief.symbol_lines(g, "rseDa")) == ["src/a.ts:0-5 parseDate (function) !shared(3)", "called by: caller, other", "calls: parseTime"]  # a part of a name, found by no search


def test_task_brief(shop):
    first = lambda task: [(r.section, r.line) for r in brief.task_brief(shop, task).orderBy("section", "sort").collect()]
    assert ("FEATURE", "FEATURE cart [DETECTED 85%]") in first("cart")
    assert first("old thing") == [("NOTE", "nothing matches 'old thing'")]  # the one hit is retired
    assert first("quarterly") == [("NOTE", "nothing matches 'quarterly'")]
