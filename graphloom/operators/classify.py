"""Feature detection: candidates from routes, models, folders, names and tests, with a confidence and its evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs
from .graph import first_match

#: keyword, name, tags. A small default; callers give their own.
VOCABULARY = [
    ("auth", "Authentication", ["security", "identity"]),
    ("login", "Authentication", ["security"]),
    ("order", "Orders", ["commerce"]),
    ("cart", "Orders", ["commerce"]),
    ("payment", "Payments", ["commerce", "money"]),
    ("invoice", "Payments", ["money"]),
    ("user", "Accounts", ["identity"]),
    ("profile", "Accounts", ["identity"]),
    ("search", "Search", ["discovery"]),
    ("report", "Reporting", ["analytics"]),
]


def vocabulary(spark, rows: list[tuple[str, str, list[str]]] = VOCABULARY) -> DataFrame:
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "ord int, keyword string, feature_name string, tags array<string>")


def best_keyword(items: DataFrame, words: DataFrame, key: str = "urn") -> DataFrame:
    """Items (key, symbol_words, path_words) with their best-scoring keyword, the earliest on ties; those that score nothing are left out.

    Items and keywords meet by what they can share: a whole word with or without its final s, or the first letters of one.
    Keywords are a list that the driver made, so they are what is broadcast, never the items.
    """
    stem = lambda w: F.regexp_replace(w, "s$", "")
    each = F.concat("symbol_words", "path_words")
    starts = F.flatten(F.transform(each, lambda w: F.transform(F.sequence(F.lit(4), F.greatest(F.length(w), F.lit(4))), lambda n: F.substring(w, F.lit(1), n))))
    probes = items.withColumn("_probe", F.explode(F.array_distinct(F.concat(each, F.transform(each, stem), starts))))
    known = words.withColumn("_probe", F.explode(F.array_distinct(F.array("keyword", stem(F.col("keyword"))))))
    score = exprs.keyword_score(F.col("keyword"), F.col("symbol_words"), F.col("path_words"))
    scored = probes.join(F.broadcast(known), "_probe").withColumn("score", score).where("score > 0")
    best = F.max_by(F.struct("keyword", "feature_name", "tags", "score"), F.struct("score", -F.col("ord")))
    return scored.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def candidates(routes: DataFrame, models: DataFrame, symbols: DataFrame, tests: DataFrame, words: DataFrame) -> DataFrame:
    """(slug, name, tags, urn, confidence, score, evidence) from all four kinds of nodes."""
    columns = ("slug", "name", "tags", "urn", "confidence", "score", "evidence")

    def rows(df: DataFrame, name, tags, confidence: str, score: float, evidence: str) -> DataFrame:
        return df.select(exprs.candidate_slug(name).alias("slug"), name.alias("name"), F.coalesce(tags, F.array().cast("array<string>")).alias("tags"), "urn", F.lit(confidence).alias("confidence"), F.lit(score).alias("score"), F.lit(evidence).alias("evidence")).select(*columns)

    by_route = routes.withColumn("domain", exprs.route_domain(F.col("route_path"))).where("domain is not null")
    known = words.select(F.col("keyword").alias("domain"), "feature_name", "tags")
    by_route = by_route.join(F.broadcast(known), "domain", "left")
    out = rows(by_route, F.coalesce("feature_name", exprs.title(F.col("domain"))), F.col("tags"), "DETECTED", 0.85, "route_match")
    hits = models.join(F.broadcast(words), F.lower("name").contains(F.col("keyword")))
    hits = first_match(hits, ["urn"], [F.col("ord")])
    out = out.union(rows(hits, F.col("feature_name"), F.col("tags"), "DETECTED", 0.85, "model_ref"))
    foldered = symbols.withColumn("folder", exprs.structural_folder(F.col("path")))
    inside = foldered.where("folder is not null")
    out = out.union(rows(inside, exprs.title(F.col("folder")), F.array().cast("array<string>"), "DETECTED", 0.9, "directory_cluster"))
    loose = foldered.where("folder is null").select("urn", exprs.words(F.col("name")).alias("symbol_words"), exprs.words(F.col("path")).alias("path_words"))
    loose = best_keyword(loose, words)
    from_path = ((F.col("score") >= 80) & (F.col("score") < 100)) | (F.col("score") < 40)
    out = out.union(rows(loose.where(from_path).drop("score"), F.col("feature_name"), F.col("tags"), "DETECTED", 0.85, "directory_cluster"))
    out = out.union(rows(loose.where(~from_path).drop("score"), F.col("feature_name"), F.col("tags"), "INFERRED", 0.6, "semantic_similarity"))
    tested = best_keyword(tests.select("urn", exprs.words(F.col("name")).alias("symbol_words"), exprs.words(F.col("path")).alias("path_words")), words).drop("score")
    return out.union(rows(tested, F.col("feature_name"), F.col("tags"), "DETECTED", 0.8, "ast_call"))


def features(found: DataFrame) -> DataFrame:
    """A feature for each slug: its name, and the union of its candidates' tags in the order of their nodes."""
    tags = F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_set(F.struct("urn", "tags"))), lambda x: x["tags"])))
    return found.groupBy("slug").agg(F.min("name").alias("name"), tags.alias("tags"))


def membership(found: DataFrame) -> DataFrame:
    """One edge from a node to a feature: that of the best score."""
    w = Window.partitionBy("urn", "slug").orderBy(F.desc("score"), "evidence")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def explicit(symbols: DataFrame, declared: DataFrame) -> DataFrame:
    """(feature, urn): symbols that a declared feature (feature, components, services) names."""
    names = declared.select("feature", F.explode(F.array_union("components", "services")).alias("name"))
    return symbols.select("urn", "name").join(names, "name").select("feature", "urn").distinct()


def merged(declared: DataFrame, linked: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features and edges of what is declared and what is found.

    ``declared``: urn, name, tags of declared features; ``linked``: urn, feature, of their members, as sure as can be; ``found``:
    candidates. A candidate whose feature is declared joins it; others make a feature each. Of two edges from a node to a
    feature the declared one counts. Features: urn, name, tags, confidence, confidence_score; edges: urn, feature, confidence,
    confidence_score, evidence.
    """
    own = exprs.feature_urn(F.col("slug"))
    new = features(found).select(own.alias("urn"), "name", "tags", F.lit("DETECTED").alias("confidence"), F.lit(0.85).alias("confidence_score")).join(declared.select("urn"), "urn", "left_anti")
    all_features = declared.select("urn", "name", "tags", F.lit("EXPLICIT").alias("confidence"), F.lit(1.0).alias("confidence_score")).unionByName(new)
    sure = linked.select("urn", "feature", F.lit("EXPLICIT").alias("confidence"), F.lit(1.0).alias("confidence_score"), F.lit("explicit_declaration").alias("evidence")).distinct()
    detected = membership(found).select("urn", own.alias("feature"), "confidence", F.col("score").alias("confidence_score"), "evidence").join(sure.select("urn", "feature").hint("merge"), ["urn", "feature"], "left_anti")
    return all_features, sure.union(detected)
