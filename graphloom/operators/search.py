"""Ranked search over nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import query_tokens, word_hit, words
from .graph import Graph, feature_named
from .views import feature_view

# What a hit counts.
EXACT, NAME, PATH, DISPLAY, TAG, ROUTE, EXTRA = 10, 5, 3, 6, 4, 7, 4


def search(nodes: DataFrame, query: str, limit: int | None = 20, extra: tuple[str, ...] = ()) -> DataFrame:
    """Nodes by score; ties go by urn.

    The exact name counts EXACT, else each token counts in the name and in the path; besides, for features in the display name
    and in any tag, for routes in the route's path, and in any of the ``extra`` columns, as far as the nodes have such.
    """
    tokens = query_tokens(query)
    hit = lambda c, t: word_hit(words(F.coalesce(c, F.lit("")), False), F.lit(t))
    counted = lambda cond, points: F.when(cond, points).otherwise(0)
    total = F.lit(0)
    for t in tokens:
        total = total + counted(hit(F.col("name"), t), NAME) + counted(hit(F.col("path"), t), PATH)
    score = F.when(F.lower("name").isin([query.lower(), *tokens]), EXACT).otherwise(total)
    of = {c: F.col("kind") == kind for c, kind in (("display_name", "feature"), ("tags", "feature"), ("route_path", "route")) if {c, "kind"} <= set(nodes.columns)}
    for t in tokens:
        tagged = lambda x: hit(x, t)  # noqa: B023, E731
        if "display_name" in of:
            score = score + counted(of["display_name"] & hit(F.col("display_name"), t), DISPLAY)
        if "tags" in of:
            score = score + counted(of["tags"] & F.coalesce(F.exists("tags", tagged), F.lit(False)), TAG)
        if "route_path" in of:
            score = score + counted(of["route_path"] & hit(F.col("route_path"), t), ROUTE)
    for c in extra:
        for t in tokens:
            score = score + F.when(word_hit(words(F.col(c), False), F.lit(t)), EXTRA).otherwise(0)
    out = nodes.withColumn("score", score.cast("bigint")).where("score > 0").orderBy(F.desc("score"), "urn")
    return out.limit(limit) if limit else out


def target(graph: Graph, text: str) -> DataFrame:
    """The node that a text means, or no row: the first of that name or urn, else the best hit of a search."""
    nodes = graph.active()
    same = nodes.where((F.col("name") == text) | (F.col("urn") == text)).select("urn", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("score"))
    found = same.union(search(nodes, text, 1).select("urn", F.lit(1), "score"))
    return found.orderBy("rank", F.desc("score"), "urn").limit(1).select("urn")


def where(graph: Graph, concept: str) -> DataFrame:
    """(role, urn): the view of the feature of that name; without one, the first five hits of a search, as role "hit"."""
    feature = feature_named(graph, concept).select(F.col("urn").alias("feature"))
    view = feature_view(graph).join(feature, "feature", "left_semi").select("role", "urn")
    hits = search(graph.active(), concept, 5).select(F.lit("hit").alias("role"), "urn")
    none = feature.agg((F.count("*") == 0).alias("_none"))
    return view.union(hits.crossJoin(none).where("_none").drop("_none"))  # one row
