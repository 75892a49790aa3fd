"""Briefs of features and plans of tasks. Both are rows of lines or targets, so that none of them has to fit into one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs
from .graph import Graph, feature_named, first_match, symbol_named
from .search import search
from .traverse import cut
from .views import USE, function_map, members

#: Sections of a brief, in order.
FEATURE, ENTRY, CORE, API, TESTS, BLAST = "FEATURE", "ENTRY", "CORE", "API", "TESTS", "BLAST RADIUS"
#: Sections of a brief that is about no feature.
SYMBOLS, NOTE = "SYMBOLS", "NOTE"
#: Phases of a plan, in order; the last one is always there.
PHASES = ("Data models", "Services", "Endpoints", "User interface", "Verification")
#: Least share of a task's hits that a feature must hold to be the one that the task is about.
SHARE = 0.2


def brief_lines(graph: Graph, features: DataFrame, hubs: int = 8) -> DataFrame:
    """(feature, section, sort, line) for features (feature, title).

    Functions that no other function of the feature calls are its entries, the others its core. Routes and tests belong to it
    themselves or expose or test a member. The last section names the ``hubs`` shared functions with most callers.
    """
    ours = features.select("feature")
    places = graph.active().select("urn", "kind", "name", "path", "start_line", "end_line")
    functions = function_map(graph).join(ours, "feature", "left_semi").join(places.select("urn", "end_line"), "urn")
    at = F.format_string("%s:%d", "path", "start_line")
    inside = F.when(F.col("inner_calls") > 0, F.format_string(" -> %d inside", "inner_calls")).otherwise("")
    shared = F.when(F.col("shared"), F.format_string(" !shared(%d)", "callers")).otherwise("")
    line = F.concat(at, F.lit("-"), F.col("end_line").cast("string"), F.lit(" "), "name", inside, shared)
    out = functions.select("feature", F.when(F.col("entry"), ENTRY).otherwise(CORE).alias("section"), F.col("urn").alias("sort"), line.alias("line"))
    own = members(graph).join(ours, "feature", "left_semi")
    near = graph.edges.where("relationship in ('exposes', 'tests')").select(F.col("target_urn").alias("urn"), F.col("source_urn").alias("by"))
    touched = own.union(own.join(near, "urn").select("feature", F.col("by").alias("urn"))).distinct().join(places.where("kind in ('route', 'test')"), "urn")
    out = out.union(touched.select("feature", F.when(F.col("kind") == "route", API).otherwise(TESTS), "urn", F.concat("name", F.lit(" @ "), at)))
    w = Window.partitionBy("feature").orderBy(F.desc("callers"), "urn")
    most = functions.where("shared").withColumn("k", F.row_number().over(w)).where(F.col("k") <= hubs)
    out = out.union(most.select("feature", F.lit(BLAST), F.format_string("%04d", "k"), F.concat("name", F.lit(" "), at, F.format_string(": %d callers", "callers"))))
    return features.select("feature", F.lit(FEATURE).alias("section"), F.lit("").alias("sort"), F.concat(F.lit("FEATURE "), "title").alias("line")).union(out)


def phases(members: DataFrame, most: int = 5) -> DataFrame:
    """(subject, phase, title, urn, name, path): what to work on for each subject, in order, from members (subject, urn, kind, name, path).

    Phases are numbered from 1 without those that have no target, but for the last, whose targets are null if there are no tests.
    All models and routes are targets; of functions and tests the first ``most`` by path, name and identifier.
    """
    ui = exprs.is_ui(F.lit(None).cast("string"), F.col("path"))
    part = F.when(F.col("kind") == "model", 1).when((F.col("kind") == "symbol") & ~ui, 2).when(F.col("kind") == "route", 3).when(F.col("kind") == "symbol", 4).when(F.col("kind") == "test", 5)
    rows = members.select("subject", "urn", "name", "path", part.alias("part")).where("part is not null").distinct()
    w = Window.partitionBy("subject", "part").orderBy("path", "name", "urn")
    few = rows.where("part in (2, 4, 5)").withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k")
    targets = rows.where("part in (1, 3)").unionByName(few)
    present = members.select("subject", F.lit(5).alias("part")).union(targets.select("subject", "part")).groupBy("subject").agg(F.sort_array(F.collect_set("part")).alias("parts"))
    numbered = present.select("subject", F.posexplode("parts").alias("place", "part"))
    title = F.get(F.array(*map(F.lit, PHASES)), F.col("part") - 1)
    return numbered.join(targets, ["subject", "part"], "left").select("subject", (F.col("place") + 1).alias("phase"), title.alias("title"), "urn", "name", "path")


def best_feature(graph: Graph, task: str) -> DataFrame:
    """(feature, sure): the feature with most credit among the task's first 40 hits, or no row; sure if it holds a share of them."""
    hits = search(graph.active(), task, 40).select("urn", "kind", "score")
    symbols = hits.where("kind != 'feature'")
    owned = symbols.join(members(graph), "urn").select("feature", "score", "urn")
    credit = owned.union(hits.where("kind = 'feature'").select("urn", F.col("score") * 2, F.lit(None).cast("string")))
    best = credit.groupBy("feature").agg(F.sum("score").alias("credit"), F.count_distinct("urn").alias("n")).orderBy(F.desc("credit"), "feature").limit(1)
    total = symbols.agg(F.count("*").alias("total"))
    return best.crossJoin(total).select("feature", ((F.col("total") > 0) & (F.col("n") >= SHARE * F.col("total"))).alias("sure"))  # one row by one row


def primary_feature(graph: Graph, task: str) -> DataFrame:
    """(feature) that a task is about, or no row: the one of that name, else ``best_feature`` if it is sure."""
    named = feature_named(graph, task).select(F.col("urn").alias("feature"), F.lit(0).alias("rank"))
    return named.union(best_feature(graph, task).where("sure").select("feature", F.lit(1))).orderBy("rank").limit(1).select("feature")


def symbol_lines(graph: Graph, task: str, most: int = 8, near: int = 8) -> DataFrame:
    """(section, sort, line) for a task that is about no feature: the symbols that it names, with who calls them and whom they call.

    The first ``most`` symbols among a search's first 25 hits, without variables if three others are there; before them the symbol
    of that very name, if it isn't among them. Callers count by edges; of names next to a symbol, each once, the first ``near`` are
    given. Sorts number symbols from 1, or 0 for the one of that name, then their lines. No row if no symbol is found.
    """
    nodes = graph.active()
    sort_of = F.col("symbol_kind") if "symbol_kind" in nodes.columns else F.lit(None).cast("string")
    shown = ("urn", "name", "path", "start_line", "end_line")
    hits = search(nodes, task, 25).where("kind = 'symbol'").select(*shown, sort_of.alias("symbol_kind"), "score")
    hits = hits.withColumn("_other", ~F.coalesce(F.col("symbol_kind") == "variable", F.lit(False)))
    others = hits.agg((F.count_if("_other") < 3).alias("_few"))
    kept = hits.crossJoin(others).where("_other or _few")  # at most 25 rows by one row
    picked = kept.withColumn("k", F.row_number().over(Window.orderBy(F.desc("score"), "urn"))).where(F.col("k") <= most).select(*shown, "symbol_kind", "k")
    named = symbol_named(graph, task).where("kind = 'symbol'").select(*shown, sort_of.alias("symbol_kind"), F.lit(0).alias("k"))
    picked = F.broadcast(cut(picked.union(named.join(picked.select("urn"), "urn", "left_anti"))))  # at most one row more than ``most``
    edges = graph.resolved_edges().where(F.col("relationship").isin(*USE)).select("source_urn", "target_urn")
    names = nodes.select("urn", F.col("name").alias("other"))

    def around(own: str, far: str) -> DataFrame:
        return edges.join(picked.select(F.col("urn").alias(own), "k"), own).select("k", F.col(far).alias("urn")).join(names, "urn").select("k", "other")

    def listed(pairs: DataFrame, place: int, title: str) -> DataFrame:
        first = pairs.distinct().withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("other"))).where(F.col("i") <= near)
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "other"))), lambda x: x["other"]), ", ")
        return first.groupBy("k").agg(F.concat(F.lit(title), joined).alias("line")).select("k", F.lit(place).alias("place"), "line")

    callers = around("target_urn", "source_urn")
    n = callers.groupBy("k").agg(F.count("*").alias("callers"))
    at = F.format_string("%s:%d-%d", "path", "start_line", "end_line")
    shared = F.when(F.col("callers") > 1, F.format_string(" !shared(%d)", "callers")).otherwise("")
    heads = picked.join(n, "k", "left").select("k", F.lit(0).alias("place"), F.concat(at, F.lit(" "), "name", F.coalesce(F.concat(F.lit(" ("), "symbol_kind", F.lit(")")), F.lit("")), shared).alias("line"))
    rows = heads.union(listed(callers, 1, "called by: ")).union(listed(around("source_urn", "target_urn"), 2, "calls: "))
    return rows.select(F.lit(SYMBOLS).alias("section"), F.format_string("%04d.%d", "k", "place").alias("sort"), "line")


def task_brief(graph: Graph, task: str) -> DataFrame:
    """(section, sort, line): the brief of the feature that a task is about, else of the symbols that it names.

    A NOTE says when the task has no sure feature, and which would be the closest. With no symbol either, the closest feature's
    brief is given; with nothing at all, the note alone. Which of these it is takes a row or two on the driver.
    """
    spark = graph.nodes.sparkSession
    note = lambda text: spark.createDataFrame([(NOTE, "", text)], "section string, sort string, line string")
    titles = graph.active().where("kind = 'feature'").select(F.col("urn").alias("feature"), F.concat(F.coalesce("display_name", "name"), F.format_string(" [%s %d%%]", "confidence", exprs.percent(F.col("confidence_score"), F.lit(1)).cast("int"))).alias("title"), "name")
    of = lambda urn: brief_lines(graph, titles.where(F.col("feature") == urn).select("feature", "title")).select("section", "sort", "line")
    sure = primary_feature(graph, task).first()
    if sure:
        return of(sure.feature)
    closest = best_feature(graph, task).join(titles, "feature").first()
    symbols = cut(symbol_lines(graph, task))
    if not symbols.isEmpty():
        return symbols.union(note(f"no feature is sure (closest: {closest.name})")) if closest else symbols
    return of(closest.feature) if closest else note(f"nothing matches {task!r}")


def likely_files(graph: Graph, task: str) -> DataFrame:
    """(path, role, reason): files of the task's feature, each once by UI, API, Service and Model, and those of the first five hits."""
    nodes = graph.active().select("urn", "kind", "path").where("path != ''")
    ours = members(graph).join(primary_feature(graph, task), "feature", "left_semi").join(nodes, "urn").select("path", "kind", F.lit("member").alias("reason"), F.lit(0).alias("tier"))
    hits = search(graph.active(), task, 5).where("path != '' and kind != 'feature'").select("path", "kind", F.lit("hit"), F.lit(1))
    ui = exprs.is_ui(F.lit(None).cast("string"), F.col("path"))
    rank = F.when(F.col("kind") == "route", 1).when(F.col("kind") == "model", 3).when(F.col("kind") == "test", 4).when(ui, 0).otherwise(2)
    first = first_match(ours.union(hits).withColumn("rank", rank), ["path"], [F.col("tier"), F.col("rank")])
    return first.select("path", F.get(F.array(*map(F.lit, ("UI", "API", "Service", "Model", "Test"))), F.col("rank")).alias("role"), "reason")


def task_plan(graph: Graph, task: str) -> DataFrame:
    """Phases over all that stands in the task's likely files."""
    nodes = graph.active().join(likely_files(graph, task).select("path"), "path", "left_semi")
    return phases(nodes.select(F.lit(task).alias("subject"), "urn", "kind", "name", "path"))


def feature_list(graph: Graph) -> DataFrame:
    """(urn, title, confidence, percent, tags) of every feature."""
    return graph.active().where("kind = 'feature'").select("urn", F.coalesce("display_name", "name").alias("title"), "confidence", exprs.percent(F.col("confidence_score"), F.lit(1)).alias("percent"), "tags")


def payload(graph: Graph, columns: tuple[str, ...] = ("urn", "kind", "name", "path")) -> DataFrame:
    """(part, json): active nodes, and the edges between such, as a line of JSON each."""
    nodes = graph.active()
    alive = nodes.select("urn")
    edges = graph.edges
    for end in ("source_urn", "target_urn"):
        edges = edges.join(alive.withColumnRenamed("urn", end), end, "left_semi")
    out = nodes.select(F.lit("node").alias("part"), F.to_json(F.struct(*columns)).alias("json"))
    return out.union(edges.select(F.lit("edge"), F.to_json(F.struct("source_urn", "target_urn", "relationship"))))
