"""From import and call facts to typed edges: ordered candidates, of which the first that exists wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import first_match

# What may be added to a specifier to name a file, in this order.
#: Specifiers of modules that come with the language's runtime and name no file.
RUNTIME = "assert buffer child_process cluster crypto dns events fs http http2 https net os path process querystring readline stream string_decoder timers tls tty url util v8 vm worker_threads zlib".split()
SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]


def joined_path(folder: Column, specifier: Column) -> Column:
    """Folder and relative specifier as one path without . and .., as far as these lead; what leads above the root stays."""
    parts = F.split(F.concat_ws("/", F.nullif(folder, F.lit("")), specifier), "/")
    up = lambda a: (F.size(a) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), a), -1) != "..")
    step = lambda a, p: F.when((p == ".") | (p == ""), a).when((p == "..") & up(a), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def candidates(imports: DataFrame) -> DataFrame:
    """Import rows, one for each path that the specifier may mean, with its order."""
    spec, folder = F.col("module_specifier"), F.regexp_replace("source_file", "/?[^/]*$", "")
    suffixed = lambda base: F.transform(F.array(*map(F.lit, SUFFIXES)), lambda s: F.concat(base, s))
    rest = F.substring(spec, 3, 1 << 30)
    dotted = F.translate(spec, ".", "/")
    options = (
        F.when(spec.startswith("."), suffixed(joined_path(folder, spec)))
        .when(spec.startswith("@/"), F.flatten(F.transform(suffixed(rest), lambda p: F.array(p, F.concat(F.lit("src/"), p)))))
        .otherwise(F.array(spec, F.concat(dotted, F.lit(".py")), F.concat(dotted, F.lit(".java")), F.concat(dotted, F.lit("/__init__.py"))))
    )
    return imports.select("*", F.posexplode(options).alias("order", "path"))


#: What is added to a specifier with dots for slashes; its orders follow on that of the specifier as it stands.
DOTTED = [".py", ".java", "/__init__.py"]


def bases(imports: DataFrame) -> DataFrame:
    """Import rows, one for each text that a path may begin with: how it may go on (suffix "any", "none" or "dotted"), and (times, plus) for its order."""
    spec, folder = F.col("module_specifier"), F.regexp_replace("source_file", "/?[^/]*$", "")
    one = lambda base, how, times=1, plus=0: F.struct(base.alias("base"), F.lit(how).alias("how"), F.lit(times).alias("times"), F.lit(plus).alias("plus"))
    rest = F.substring(spec, 3, 1 << 30)
    options = (
        F.when(spec.startswith("."), F.array(one(joined_path(folder, spec), "any")))
        .when(spec.startswith("@/"), F.array(one(rest, "any", 2), one(F.concat(F.lit("src/"), rest), "any", 2, 1)))
        .otherwise(F.array(one(spec, "none"), one(F.translate(spec, ".", "/"), "dotted", 1, 1)))
    )
    return imports.select("*", F.explode(options).alias("_o")).select(*imports.columns, "_o.*")


def answers(files: DataFrame) -> DataFrame:
    """(base, how, nth, path): the first file for each text that paths begin with, by the place of what follows."""
    each = [(how, k, end) for how, ends in (("any", SUFFIXES), ("none", [""]), ("dotted", DOTTED)) for k, end in enumerate(ends)]
    path = F.col("path")
    fits = [F.when(path.endswith(end), F.struct(F.expr(f"left(path, length(path) - {len(end)})").alias("base"), F.lit(how).alias("how"), F.lit(k).alias("nth"))) for how, k, end in each]
    rows = files.select("path", F.explode(F.array_compact(F.array(*fits))).alias("_a")).select("_a.*", "path")
    return rows.groupBy("base", "how").agg(F.min("nth").alias("nth"), F.min_by("path", "nth").alias("path"))


def import_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """The imports whose specifier names a file, with that file's path as ``target_path``.

    Suffixes are taken off the files, which are few beside the imports: an import is one row or two, not one for each suffix.
    """
    keys = ["source_file", "module_specifier"]
    hits = bases(imports.select(*keys).distinct()).join(answers(files), ["base", "how"])
    order = F.col("nth") * F.col("times") + F.col("plus")
    return imports.join(hits.groupBy(*keys).agg(F.min_by("path", order).alias("target_path")), keys)


def first_others(rows: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """(ident, other, tier) of the rows with another one of the same first key, else second key, and so on: the least.

    Of each key's rows only the two least ids are looked at, so that no row meets all others of a common key.
    """
    out = rows.select(ident, *keys)
    for k, key in enumerate(keys, 1):
        nth = F.row_number().over(Window.partitionBy(key).orderBy(ident))
        least = rows.where(F.col(key).isNotNull()).select(key, ident).withColumn("_n", nth).where("_n <= 2")
        two = least.groupBy(key).agg(F.min(ident).alias(f"_first{k}"), F.max(ident).alias(f"_second{k}"))
        out = out.join(two, key, "left")
    other = [F.when(F.col(f"_first{k}") != F.col(ident), F.col(f"_first{k}")).otherwise(F.nullif(f"_second{k}", ident)) for k in range(1, len(keys) + 1)]
    tier = F.coalesce(*[F.when(o.isNotNull(), k) for k, o in enumerate(other, 1)])
    return out.select(ident, F.coalesce(*other).alias("other"), tier.alias("tier")).where("tier is not null")


def resolve_calls(calls: DataFrame, symbols: DataFrame, imported: DataFrame, builtins: DataFrame | None = None) -> DataFrame:
    """(call_id, urn, tier) of calls (call_id, file, name): a symbol of the same file, else of an imported one, else the only one of its name.

    ``symbols``: urn, name, path; ``imported``: file, path. Builtin names resolve to nothing. Each tier is a table with one row
    a key, so that no call meets all symbols of a common name; of several symbols the first by urn counts.
    """
    if builtins is not None:
        calls = calls.join(builtins.select("name"), "name", "left_anti")
    here = symbols.groupBy("path", "name").agg(F.min("urn").alias("urn"))
    near = imported.select("file", "path").distinct().join(here, "path").groupBy("file", "name").agg(F.min("urn").alias("_near"))
    only = symbols.groupBy("name").agg(F.count("*").alias("_n"), F.min("urn").alias("_only")).where("_n = 1").drop("_n")
    out = calls.select("call_id", "file", "name").join(here.select(F.col("path").alias("file"), "name", F.col("urn").alias("_here")), ["file", "name"], "left").join(near, ["file", "name"], "left").join(only, "name", "left")
    tier = F.when(F.col("_here").isNotNull(), 1).when(F.col("_near").isNotNull(), 2).when(F.col("_only").isNotNull(), 3)
    return out.select("call_id", F.coalesce("_here", "_near", "_only").alias("urn"), tier.alias("tier")).where("tier is not null")


def imported_symbols(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """Imports (target_path, imported_symbols and more), a row for each name that the target file declares, with that symbol's urn; of several the last."""
    last = symbols.groupBy(F.col("path").alias("target_path"), "name").agg(F.max("urn").alias("urn"))
    return imports.withColumn("name", F.explode("imported_symbols")).join(last, ["target_path", "name"])


def package_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(source_file, module_specifier, target_path): the Go files of the folder that a specifier with a slash ends in.

    Of the specifier's ends, from the longest on, the first that any folder is or ends in counts. Both meet by equality of ends.
    """
    def ends(text: Column) -> Column:
        parts = F.split(text, "/")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))

    dirs = files.where(F.col("path").endswith(".go") & F.col("path").contains("/")).select("path", F.regexp_replace("path", "/[^/]*$", "").alias("dir"))
    known = dirs.select(F.explode(F.array_distinct(ends(F.col("dir")))).alias("end"), F.col("path").alias("target_path"))
    keys = imports.where(F.col("module_specifier").contains("/") & ~F.col("module_specifier").startswith(".")).select("source_file", "module_specifier").distinct()
    tried = keys.select("*", F.posexplode(ends(F.col("module_specifier"))).alias("order", "end")).where("end != ''")
    matched = tried.join(known.select("end").distinct(), "end", "left_semi")
    first = matched.groupBy("source_file", "module_specifier").agg(F.min_by("end", "order").alias("end"))
    return first.join(known, "end").select("source_file", "module_specifier", "target_path")


def attribute(calls: DataFrame, nodes: DataFrame, file: Column | None = None) -> DataFrame:
    """Calls (caller_urn, file, urn) with their source: the caller, if it exists and isn't the target, else the file's node."""
    file = F.concat(F.lit("file:"), "file") if file is None else file
    known = nodes.select(F.col("urn").alias("caller_urn"), F.lit(True).alias("_known")).distinct()
    own = F.col("_known") & (F.col("caller_urn") != F.col("urn"))
    return calls.join(known, "caller_urn", "left").withColumn("source_urn", F.when(own, F.col("caller_urn")).otherwise(file)).drop("_known")


def import_fallback(imports: DataFrame, symbols: DataFrame, builtins: list[str]) -> DataFrame:
    """(import_id, urn) by name alone: first a symbol whose file's name is in the specifier or whose path holds it, else (for relative specifiers) the first one of another file."""
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    spec = F.col("module_specifier")
    pairs = imports.where(~F.col("name").isin(builtins)).join(symbols.select("urn", "name", "path"), "name")
    tier = F.when((stem != "") & spec.contains(stem) | F.col("path").contains(spec), 1).when(spec.rlike(r"^(\.|@/)") & (F.col("path") != F.col("source_file")), 2)
    return first_match(pairs.withColumn("tier", tier).where("tier is not null"), ["import_id"], [F.col("tier"), F.col("urn")]).select("import_id", "urn", "tier")


def within_group(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Every pair of a left and a right row of the same file."""
    return left.join(right, on)


def contained(sites: DataFrame, ranges: DataFrame, on: str, at: str = "at", start: str = "start", end: str = "end") -> DataFrame:
    """Sites within ranges of the same key: an equi-join with a range condition, whose skewed keys Spark can split."""
    return sites.join(ranges, on).where(F.col(at).between(F.col(start), F.col(end)))


def contained_in(ranges: DataFrame, sites: DataFrame, on: list[str]) -> DataFrame:
    """The ranges (start, end) with any site (at) in them of the same keys."""
    places = sites.select(*on, "at").distinct()
    within = (F.col("_at") >= F.col("start")) & (F.col("_at") <= F.col("end"))
    there = places.select(*[F.col(c).alias(f"_{c}") for c in on], F.col("at").alias("_at"))
    return ranges.join(there, [F.col(c) == F.col(f"_{c}") for c in on] + [within], "left_semi")
