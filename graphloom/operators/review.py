"""Reviews of changed files, and checks of a graph against the files that it describes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from . import views
from .graph import Graph, dangling, orphan_features
from .impact import impact


def changed_nodes(graph: Graph, files: DataFrame) -> DataFrame:
    """Active symbols, routes, models and tests in changed files (path)."""
    return graph.active().where("kind in ('symbol', 'route', 'model', 'test')").join(files.select("path").distinct(), "path", "left_semi")


def affected(graph: Graph, files: DataFrame) -> DataFrame:
    """(category, urn): changed nodes by kind ("changed symbol", ...), and the features and tests that these reach.

    Features are those of ``impact``, and for symbols those that ``views.explain`` names.
    """
    changed = changed_nodes(graph, files).select("urn", "kind")
    roots = changed.where("kind != 'test'").select("urn")
    reached = impact(graph, roots)
    explained = views.explain(graph, changed.where("kind = 'symbol'").select("urn")).select(F.lit("feature").alias("category"), F.col("feature").alias("urn"))
    out = reached.where("category in ('feature', 'test')").select("category", "urn").union(explained).distinct()
    direct = reached.where("category = 'direct'").join(changed.where("kind = 'symbol'").select(F.col("urn").alias("root")), "root", "left_semi")
    return changed.select(F.concat(F.lit("changed "), "kind").alias("category"), "urn").union(out).union(direct.select(F.lit("direct consumer of a symbol"), F.concat_ws(" > ", "urn", "root")))


def review(graph: Graph, files: DataFrame) -> DataFrame:
    """One row: how much changed and is affected, the risk, and concerns.

    Concerns: symbols changed that tests touch, or routes changed, though no test file did; models changed.
    """
    n = lambda category, name: F.count_if(F.col("category") == category).alias(name)
    rows = affected(graph, files).agg(n("changed symbol", "symbols"), n("changed route", "apis"), n("changed model", "models"), n("feature", "features"), n("test", "tests"), n("direct consumer of a symbol", "direct_consumers"))
    changed = files.select("path").distinct().agg(F.count("*").alias("files"), F.count_if(F.col("path").rlike(r"\.(test|spec)\.|^tests/")).alias("test_files"))
    row = rows.crossJoin(changed)  # one row by one row
    untested = F.col("test_files") == 0
    concerns = F.array_compact(
        F.array(
            F.when((F.col("symbols") > 0) & untested & (F.col("tests") > 0), "symbols changed, no test did"),
            F.when(F.col("models") > 0, "models changed: check stored data"),
            F.when((F.col("apis") > 0) & untested, "routes changed, no test did"),
        )
    )
    risk = exprs.risk(F.col("features"), F.col("models"), F.col("apis"), F.col("tests"), F.col("symbols"))
    return row.select("files", "symbols", "apis", "models", "features", "tests", "direct_consumers", risk.alias("risk"), concerns.alias("concerns"))


def problems(graph: Graph, files: DataFrame) -> DataFrame:
    """(severity, problem, urn, path) of a graph against files (path, text).

    Errors: nodes whose file is missing, edges with a missing end. Warnings: symbols whose lines lie beyond their file's end or
    whose lines have changed since their content_hash was taken, and features that no edge reaches.
    """
    nodes = graph.active().where("path != ''")
    hashed = "content_hash" in nodes.columns
    # Lines are counted once a file; the text goes along only where there are hashes to compare
    text = F.coalesce("text", F.lit(""))
    lines = files.select("path", F.size(F.split(text, "\n")).alias("_n"), *([text.alias("_text")] if hashed else []))
    at = nodes.select("urn", "kind", "path", "start_line", "end_line", *(["content_hash"] if hashed else [])).join(lines, "path", "left")
    symbol = (F.col("kind") == "symbol") & (F.col("start_line") > 0)
    beyond = (F.col("start_line") > F.col("_n")) | (F.col("end_line") > F.col("_n"))
    problem = F.when(F.col("_n").isNull(), "missing file").when(symbol & beyond, "lines beyond the file")
    if hashed:
        now = exprs.slice_hash(F.col("_text"), F.greatest("start_line", F.lit(1)), F.col("end_line"))
        problem = problem.when(symbol & (F.col("content_hash") != "") & (F.col("content_hash") != now), "changed since it was read")
    found = at.withColumn("problem", problem)
    out = found.where("problem is not null").select(F.when(F.col("problem") == "missing file", "error").otherwise("warning").alias("severity"), "problem", "urn", "path")
    ends = dangling(graph).where("problem = 'missing'")
    out = out.union(ends.select(F.lit("error"), F.concat(F.lit("missing "), "side"), F.concat_ws(" > ", "source_urn", "target_urn"), F.lit("")))
    return out.union(orphan_features(graph).select(F.lit("warning"), F.lit("nothing linked"), "urn", F.lit("")))


def report(found: DataFrame) -> DataFrame:
    """One row: errors, warnings, and whether the graph is valid, which it is without errors."""
    errors = F.count_if(F.col("severity") == "error")
    return found.agg(errors.alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), (errors == 0).alias("valid"))
