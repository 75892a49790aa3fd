"""From source files to a graph, and from one state of the files to the next.

What a file holds is kept as rows of facts. A change of files replaces the facts of these files alone. Which edges a file's facts
make depends on its own rows, on symbols of the names that it calls or imports, and on files at the places that its imports may
mean; so after a change the edges of those files alone are made anew (``touched``) whose rows, names or places changed. The others
stay, and the graph brought up to date is the one that would be built anew.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from . import classify, extract, incremental, resolve
from .graph import Graph
from .traverse import cut

NODE = ("urn", "kind", "name", "path", "status", "symbol_kind", "start_line", "end_line", "content_hash")


@dataclass(frozen=True)
class Facts:
    """Of all files: files (path, hash); the rows of ``extract`` with the path that they come from as ``path``."""

    files: DataFrame
    symbols: DataFrame
    routes: DataFrame
    tests: DataFrame
    models: DataFrame
    imports: DataFrame
    calls: DataFrame
    #: Candidates of features, as ``classify.candidates`` gives them.
    found: DataFrame

    def map(self, f) -> Facts:
        return Facts(*[f(getattr(self, x.name), x.name) for x in fields(self)])


def facts(files: DataFrame, words: DataFrame | None = None) -> Facts:
    """From files (path, text, hash); ``words`` is the vocabulary of features, ``classify.VOCABULARY`` unless given."""
    source = files.where("text is not null")
    symbols, routes, tests, models = extract.symbols(source).drop("language"), extract.routes(source), extract.tests(source), extract.models(source)
    path = F.col("path")
    words = classify.vocabulary(files.sparkSession) if words is None else words
    named = [routes.select("urn", "route_path"), models.select(model_urn(path).alias("urn"), "name"), symbols.select("urn", "name", "path"), tests.select(test_urn(path).alias("urn"), F.col("test_name").alias("name"), "path")]
    return Facts(
        files.select(exprs.normal_path(path).alias("path"), "hash"),
        symbols,
        routes,
        tests,
        models,
        extract.imports(source).withColumnRenamed("source_file", "path"),
        extract.calls(source).withColumnRenamed("file", "path"),
        classify.candidates(*named, words).withColumn("path", exprs.urn_part(F.col("urn"), "path")),
    )


def kept(f: Facts) -> Facts:
    """The same facts, in the shared checkpoint folder: files are read once, whatever is made of them."""
    return f.map(lambda df, _: cut(df))


def replace(old: Facts, gone: DataFrame, new: Facts) -> Facts:
    """The old facts but for those of the paths (path) in ``gone``, and the new ones."""
    kept = lambda df: df.join(F.broadcast(gone) if gone.count() <= 100_000 else gone, "path", "left_anti")
    gone = gone.select("path").distinct()
    return old.map(lambda df, name: kept(df).unionByName(getattr(new, name)))


def nodes(f: Facts) -> DataFrame:
    """A node for each file, symbol, route, test and model; one of several rows of an urn: the first by line."""
    path, none = F.col("path"), F.lit(None).cast("string")
    zero = F.lit(0)

    def rows(df: DataFrame, urn, kind: str, name, symbol_kind=none, start=zero, end=zero, content=none) -> DataFrame:
        return df.select(urn.alias("urn"), F.lit(kind).alias("kind"), name.alias("name"), "path", F.lit("active").alias("status"), symbol_kind.alias("symbol_kind"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), content.alias("content_hash"))

    out = rows(f.files, file_urn(path), "file", path, content=F.col("hash"))
    out = out.union(rows(f.symbols, F.col("urn"), "symbol", F.col("name"), F.col("kind"), F.col("start_line"), F.col("end_line"), F.col("content_hash")))
    out = out.union(rows(f.routes, F.col("urn"), "route", F.concat_ws(" ", "http_method", "route_path"), start=F.col("line"), end=F.col("line")))
    out = out.union(rows(f.tests, test_urn(path), "test", _case(), start=F.col("start_line"), end=F.col("end_line")))
    out = out.union(rows(f.models, model_urn(path), "model", F.col("name"), start=F.col("start_line"), end=F.col("end_line")))
    first = F.min_by(F.struct(*NODE), F.struct("start_line", "end_line", "name"))
    return out.groupBy("urn").agg(first.alias("n")).select("n.*")


def file_urn(path: Column) -> Column:
    return exprs.urn("file", path)


def model_urn(path: Column) -> Column:
    return exprs.urn("model", path, F.col("name"))


def _case() -> Column:
    return F.concat_ws(".", "suite_name", "test_name")


def test_urn(path: Column) -> Column:
    return exprs.urn("test", path, F.concat(_case(), F.lit(":"), F.col("start_line").cast("string")))


EDGE = ("source_urn", "target_urn", "relationship", "file", "line", "confidence", "confidence_score")
#: Relationships that facts make; others are given.
MADE = ("imports", "calls", "tests")


def _called() -> Column:
    return F.element_at(F.split("callee_name", r"\.|::"), -1)


def edges(f: Facts, only: DataFrame | None = None) -> DataFrame:
    """Imports from file to file and to the symbols that they name, calls from functions or files to symbols, and from tests to what their file imports.

    Each has its place. A name that the imported file doesn't declare is looked for by name. ``only`` (path) names the files
    whose edges are made; without it all are.
    """
    mine = lambda df: df if only is None else df.join(only, "path", "left_semi")
    symbols = f.symbols.select("urn", "name", "path").dropDuplicates(["urn"])
    files = f.files.select("path")
    imports = mine(f.imports).select(F.col("path").alias("source_file"), "module_specifier", "imported_symbols", "line")
    single = resolve.import_targets(imports, files).select("source_file", "module_specifier", "imported_symbols", "line", "target_path")
    package = resolve.package_files(imports, files).join(imports, ["source_file", "module_specifier"]).select(*single.columns)
    to_file = single.union(package).where("source_file != target_path")
    made = lambda df, source, target, kind, file, sure: df.select(source.alias("source_urn"), target.alias("target_urn"), F.lit(kind).alias("relationship"), F.col(file).alias("file"), F.col("line").cast("int").alias("line"), F.lit("DETECTED").alias("confidence"), F.lit(sure).alias("confidence_score"))
    out = made(to_file, file_urn(F.col("source_file")), file_urn(F.col("target_path")), "imports", "source_file", 0.95)
    key = ["source_file", "module_specifier", "name", "line"]
    declared = resolve.imported_symbols(single, symbols).select(*key, "urn")
    asked = imports.where(~F.col("module_specifier").startswith("node:") & ~F.col("module_specifier").isin(resolve.RUNTIME)).select("source_file", "module_specifier", F.explode("imported_symbols").alias("name"), "line").distinct()
    left = asked.join(declared, key, "left_anti").withColumn("import_id", F.struct(*key))
    by_name = resolve.import_fallback(left, symbols, []).select("import_id.*", "urn")
    named = declared.union(by_name.select(*declared.columns)).where(exprs.urn_part(F.col("urn"), "path") != F.col("source_file"))
    out = out.union(made(named, file_urn(F.col("source_file")), F.col("urn"), "imports", "source_file", 0.95))
    # Each test of a file and each symbol that the file imports
    tests = mine(f.tests).select(F.col("path").alias("file"), test_urn(F.col("path")).alias("_test"), F.col("start_line").alias("line")).distinct()
    tested = resolve.within_group(tests, named.select(F.col("source_file").alias("file"), "urn").distinct(), "file")
    out = out.union(made(tested, F.col("_test"), F.col("urn"), "tests", "file", 0.9))
    calls = mine(f.calls).select(F.xxhash64("path", "callee_name", "line", "caller_urn").alias("call_id"), F.col("path").alias("file"), _called().alias("name"), "caller_urn", "line").distinct()
    known = resolve.resolve_calls(calls, symbols, to_file.select(F.col("source_file").alias("file"), F.col("target_path").alias("path")))
    of = resolve.attribute(calls.join(known.select("call_id", "urn"), "call_id"), symbols.select("urn"), file_urn(F.col("file")))
    return out.union(made(of, F.col("source_urn"), F.col("urn"), "calls", "file", 0.9)).distinct()


def detected(f: Facts, declared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of features, and edges from their members, of what the facts hold and what is ``declared`` (feature, components, services, and maybe name)."""
    spark = f.files.sparkSession
    own = exprs.feature_urn(F.col("feature"))
    if declared is None:
        declared = spark.createDataFrame([], "feature string, components array<string>, services array<string>")
    name = F.coalesce(*[F.col(c) for c in ("name", "feature") if c in declared.columns])
    given = declared.select(own.alias("urn"), name.alias("name"), F.array().cast("array<string>").alias("tags")).dropDuplicates(["urn"])
    linked = classify.explicit(f.symbols, declared).select("urn", own.alias("feature"))
    features, members = classify.merged(given, linked, f.found.drop("path"))
    none = F.lit(None).cast("string")
    nodes = features.select("urn", F.lit("feature").alias("kind"), "name", F.lit("").alias("path"), F.lit("active").alias("status"), none.alias("symbol_kind"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), none.alias("content_hash"))
    return nodes, members.select(F.col("urn").alias("source_urn"), F.col("feature").alias("target_urn"), F.lit("implements").alias("relationship"), none.alias("file"), F.lit(None).cast("int").alias("line"), "confidence", "confidence_score")


def build(f: Facts, declared: DataFrame | None = None) -> Graph:
    features, members = detected(f, declared)
    return Graph(nodes(f).unionByName(features), edges(f).unionByName(members))


def touched(old: Facts, new: Facts, change: DataFrame, there: DataFrame) -> DataFrame:
    """(path): the files of ``new`` whose edges may differ after changes (path) of which those in ``there`` came or went.

    They changed themselves, or name a symbol that a changed file has or had, or import from where a file came or went.
    """
    small = lambda df: F.broadcast(df) if df.count() <= 100_000 else df
    change, there = small(cut(change.distinct())), small(cut(there.distinct()))
    symbols = old.symbols.select("path", "name").union(new.symbols.select("path", "name"))
    names = small(cut(symbols.join(change, "path", "left_semi").select("name").distinct()))
    calls = new.calls.select("path", _called().alias("name")).join(names, "name", "left_semi").select("path")
    named = new.imports.select("path", F.explode("imported_symbols").alias("name")).join(names, "name", "left_semi").select("path")
    imports = new.imports.select(F.col("path").alias("source_file"), "module_specifier")
    placed = resolve.candidates(imports.distinct()).join(there, "path", "left_semi").select(F.col("source_file").alias("path"))
    packaged = resolve.package_files(imports, there).select(F.col("source_file").alias("path"))
    return change.union(calls).union(named).union(placed).union(packaged).distinct()


@dataclass(frozen=True)
class Update:
    facts: Facts
    graph: Graph
    #: (path, change, from_path): added, modified, deleted or renamed files.
    changed: DataFrame
    #: (path): files whose edges were made anew.
    touched: DataFrame | None = None


def update(files: DataFrame, old: Facts | None = None, before: Graph | None = None, words: DataFrame | None = None, declared: DataFrame | None = None) -> Update:
    """The facts and the graph of files (path, text, hash), given those of an earlier state; without these, all files are read.

    Files of the same hash under a new path are renamed: their facts move, and old names lead to the new ones by aliases. Only
    added and modified files are read, and edges are made anew for ``touched`` files alone. Nodes that were there before and are
    no more stay, retired. Features are detected from the facts as they are; what else the earlier graph says of features, as
    EXPLICIT or without a confidence, stays, its ends renamed where files were.
    """
    if old is None or before is None:
        new = kept(facts(files, words))
        return Update(new, build(new, declared), files.select(exprs.normal_path(F.col("path")).alias("path"), F.lit("added").alias("change"), F.lit(None).cast("string").alias("from_path")), new.files.select("path"))
    now = files.withColumn("path", exprs.normal_path(F.col("path")))
    change = cut(incremental.changes(old.files, now).where("change != 'same'"))
    side = lambda kind, df: change.where(F.col("change") == kind).join(df.select("path", "hash"), "path").select("path", "hash")
    moved = cut(incremental.renames(side("deleted", old.files), side("added", now)))
    out_of, into = moved.select(F.col("from_key").alias("path")), moved.select(F.col("to_key").alias("path"))
    rest = change.join(out_of.union(into), "path", "left_anti")
    told = rest.select("path", "change", F.lit(None).cast("string").alias("from_path")).union(moved.select(F.col("to_key"), F.lit("renamed"), F.col("from_key")))
    # A renamed file is read again under its new path: identifiers hold paths
    read = now.join(rest.where("change in ('added', 'modified')").select("path").union(into), "path", "left_semi")
    new = kept(replace(old, rest.select("path").union(out_of), facts(read, words)))
    dirty = cut(touched(old, new, change.select("path"), change.where("change != 'modified'").select("path")))
    stay = before.edges.where(F.col("relationship").isin(*MADE)).select(*EDGE).join(dirty.select(F.col("path").alias("file")), "file", "left_anti").select(*EDGE)
    features, members = detected(new, declared)
    graph = Graph(nodes(new).unionByName(features), stay.union(edges(new, dirty)).unionByName(members))
    renamed, aliases = incremental.renamed_nodes(before.nodes.select(*NODE), moved)
    gone = renamed.join(graph.nodes.select("urn"), "urn", "left_anti")
    gone = gone.where("kind != 'feature'").withColumn("status", F.lit("retired")).union(gone.where("kind = 'feature'"))
    given = before.edges.where("relationship in ('implements', 'belongs_to') and coalesce(confidence, 'EXPLICIT') = 'EXPLICIT'").select(*EDGE)
    given = incremental.renamed_edges(given, aliases).join(members.select("source_urn", "target_urn"), ["source_urn", "target_urn"], "left_anti").select(*EDGE)
    alive = graph.nodes.select("urn").union(gone.where("kind = 'feature'").select("urn"))
    for end in ("source_urn", "target_urn"):
        given = given.join(alive.withColumnRenamed("urn", end), end, "left_semi").select(*EDGE)
    # A feature that was detected stays only while something is in it; one that was given stays
    found = before.edges.where("relationship = 'implements' and confidence in ('DETECTED', 'INFERRED')").select(F.col("target_urn").alias("urn")).distinct()
    empty = found.join(given.select(F.col("target_urn").alias("urn")), "urn", "left_anti")
    gone = gone.join(empty.withColumn("_empty", F.lit(True)), "urn", "left").withColumn("status", F.when(F.col("_empty"), "retired").otherwise(F.col("status"))).select(*NODE)
    names = aliases if before.aliases is None else incremental.followed(before.aliases, aliases)
    return Update(new, Graph(graph.nodes.unionByName(gone), graph.edges.union(given), names), told, dirty)
