"""The graph as two tables, and lookups, degrees and set operations over them."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import is_entry_path, is_test_path

#: Slices of nodes; the edges to one of them are tried first.
SLICES = 64


def cut(df: DataFrame) -> DataFrame:
    """Lineage ends in the shared checkpoint folder, so that a round is not computed again in the next one.

    As Parquet: a checkpoint's rows are not compressed, and its readers take every column.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoints-"))
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Graph:
    """nodes: urn, kind, name, path, status and more; edges: source_urn, target_urn, relationship and more; aliases: old_urn, urn."""

    nodes: DataFrame
    edges: DataFrame
    aliases: DataFrame | None = None

    def active(self) -> DataFrame:
        return self.nodes.where("status != 'retired'")

    def resolved_edges(self, tasks: int | None = None) -> DataFrame:
        """Edges whose ends are followed through one alias each. ``tasks``: into how many they are dealt where aliases meet them."""
        if self.aliases is None:
            return self.edges
        e = self.edges
        for end in ("source_urn", "target_urn"):
            a = self.aliases.select(F.col("old_urn").alias(end), F.col("urn").alias("_now"))
            e = (e.repartition(tasks, end) if tasks else e).join(a, end, "left").withColumn(end, F.coalesce("_now", end)).drop("_now")
        return e

    def neighbours(self, urn: str, incoming: bool) -> DataFrame:
        return self.resolved_edges().where(F.col("target_urn" if incoming else "source_urn") == urn)

    def node(self, urn: str) -> DataFrame:
        return self.nodes.where(F.col("urn") == urn)


def resolve_aliases(rows: DataFrame, aliases: DataFrame | None, name: str, now: str) -> DataFrame:
    """The rows with ``now``: what ``name`` is called after one alias, else itself."""
    if aliases is None:
        return rows.withColumn(now, F.col(name))
    a = aliases.select(F.col("old_urn").alias(name), F.col("urn").alias("_now"))
    return rows.join(a, name, "left").withColumn(now, F.coalesce("_now", name)).drop("_now")


def with_alias(graph: Graph, old: DataFrame) -> Graph:
    """The graph with further aliases (old_urn, urn); of one that is given again, the new one counts."""
    old = old.select("old_urn", "urn").dropDuplicates(["old_urn"])
    kept = graph.aliases.join(old.select("old_urn"), "old_urn", "left_anti").select("old_urn", "urn") if graph.aliases is not None else None
    return Graph(graph.nodes, graph.edges, old if kept is None else kept.union(old))


def latest(nodes: DataFrame, order: str = "seq") -> DataFrame:
    """One row for each urn: the last one written."""
    w = Window.partitionBy("urn").orderBy(F.col(order).desc())
    return nodes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_match(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by the order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def feature_named(graph: Graph, name: str) -> DataFrame:
    n = name.lower()
    hit = (F.lower("name") == n) | F.coalesce(F.lower("display_name") == n, F.lit(False)) | F.col("urn").endswith(f":{n}")
    return graph.active().where((F.col("kind") == "feature") & hit).orderBy("urn").limit(1)


def symbol_named(graph: Graph, text: str) -> DataFrame:
    """By five tiers: exact symbol, symbol in any case, exact node, node in any case, part of a symbol's name."""
    n, low, symbol = F.col("name"), F.lower("name"), F.col("kind") == "symbol"
    tier = F.when(symbol & (n == text), 1).when(symbol & (low == text.lower()), 2).when(n == text, 3).when(low == text.lower(), 4).when(symbol & low.contains(text.lower()), 5)
    return graph.active().withColumn("tier", tier).where("tier is not null").orderBy("tier", "urn").limit(1)


def stats(graph: Graph) -> DataFrame:
    kinds = ("feature", "symbol", "route", "test")
    counts = [F.count_if(F.col("kind") == k).alias(f"{k}s") for k in kinds]
    return graph.active().agg(F.count("*").alias("nodes"), *counts, F.count_distinct(F.nullif("path", F.lit(""))).alias("paths")).crossJoin(graph.edges.agg(F.count("*").alias("edges")))


def degrees(edges: DataFrame) -> DataFrame:
    """urn, n_in and n_out, parallel edges included, in one aggregation."""
    ends = edges.select(F.col("target_urn").alias("urn"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(edges.select("source_urn", F.lit(0), F.lit(1)))
    return ends.groupBy("urn").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def dangling(graph: Graph) -> DataFrame:
    """A row for each end of an edge that is missing or retired: edge ends, side and problem."""
    out = None
    for side in ("source_urn", "target_urn"):
        known = graph.nodes.select(F.col("urn").alias(side), "status")
        joined = graph.edges.join(known, side, "left")
        bad = joined.where("status is null or status = 'retired'").select("source_urn", "target_urn", F.lit(side[:6]).alias("side"), F.when(F.col("status").isNull(), "missing").otherwise("retired").alias("problem"))
        out = bad if out is None else out.unionByName(bad)
    return out


def unreferenced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("target_urn").alias("urn")), "urn", "left_anti")


def dead_symbols(graph: Graph) -> DataFrame:
    """Active symbols that no edge reaches, but for those of tests and settings."""
    return unreferenced(graph.active().where((F.col("kind") == "symbol") & ~is_test_path(F.col("path"))), graph.resolved_edges())


def dead_files(graph: Graph) -> DataFrame:
    """Paths of JavaScript and TypeScript that no edge from another path reaches, but for those where programs begin."""
    return unconsumed_paths(graph).where(F.col("path").rlike(r"\.[cm]?[jt]sx?$") & ~is_entry_path(F.col("path")))


def unconsumed_paths(graph: Graph) -> DataFrame:
    """Paths that no edge from another path reaches.

    One such edge is enough, so edges to one of ``SLICES`` slices of the nodes come first. Edges to the others are joined with the
    paths of their sources only where the target's path was not found used by then.
    """
    path = cut(graph.active().select("urn", "path").where("path != ''"))
    edges = graph.edges.select("source_urn", "target_urn")
    first = lambda urn: F.pmod(F.xxhash64(urn), F.lit(SLICES)) == 0

    def used(edges: DataFrame, targets: DataFrame) -> DataFrame:
        e = edges.join(targets.select(F.col("urn").alias("target_urn"), "path"), "target_urn")
        e = e.join(path.select(F.col("urn").alias("source_urn"), F.col("path").alias("from_path")), "source_urn")
        return e.where("from_path != path").select("path").distinct()  # before paths meet: many edges lead to one

    found = cut(used(edges.where(first("target_urn")), path.where(first("urn"))))
    left = path.join(found, "path", "left_anti")
    return left.select("path").distinct().join(used(edges, left), "path", "left_anti")


def orphan_features(graph: Graph) -> DataFrame:
    return unreferenced(graph.active().where("kind = 'feature'"), graph.edges)


def retire(graph: Graph, urns: DataFrame) -> Graph:
    """These nodes become retired and all edges that touch them go."""
    gone = urns.select("urn").distinct()
    mark = gone.withColumn("_gone", F.lit(True))
    nodes = graph.nodes.join(mark, "urn", "left").withColumn("status", F.when(F.col("_gone"), "retired").otherwise(F.col("status"))).drop("_gone")
    return Graph(nodes, without(graph.edges, gone), graph.aliases)


def remove(graph: Graph, urns: DataFrame) -> Graph:
    """The graph without these nodes (urn), the edges that touch them and the old names that lead to them."""
    gone = urns.select("urn").distinct()
    aliases = None if graph.aliases is None else graph.aliases.join(gone, "urn", "left_anti").select(graph.aliases.columns)
    return Graph(graph.nodes.join(gone, "urn", "left_anti").select(graph.nodes.columns), without(graph.edges, gone).select(graph.edges.columns), aliases)


def remove_edges(graph: Graph, which: DataFrame) -> Graph:
    """The graph without the edges that agree with a row of ``which`` in all of its columns."""
    return Graph(graph.nodes, graph.edges.join(which.distinct(), which.columns, "left_anti").select(graph.edges.columns), graph.aliases)


def without(edges: DataFrame, urns: DataFrame) -> DataFrame:
    """Edges that touch none of these nodes."""
    for end in ("source_urn", "target_urn"):
        edges = edges.join(urns.select(F.col("urn").alias(end)), end, "left_anti")
    return edges


def add_edges(graph: Graph, new: DataFrame) -> Graph:
    """New edges, but for those with a retired end; ends that don't exist are allowed."""
    ok = without(new, graph.nodes.where("status = 'retired'"))
    return Graph(graph.nodes, graph.edges.unionByName(ok, allowMissingColumns=True), graph.aliases)


def distinct_edges(edges: DataFrame, rank: Column, tasks: int | None = None) -> DataFrame:
    """One edge between two nodes: the first by rank. ``tasks``: into how many edges are dealt; else Spark decides."""
    edges = edges.repartition(tasks, "source_urn", "target_urn") if tasks else edges
    return first_match(edges, ["source_urn", "target_urn"], [rank])
