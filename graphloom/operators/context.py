"""Contexts of features: what a reader needs to know of each, as sections that fit into a budget of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs

#: (category, priority, title), in reading order.
SECTIONS = [("api", 9, "API Endpoints"), ("database", 8, "Database Models"), ("services", 7, "Core Services & Functions"), ("ui", 6, "UI Components"), ("tests", 5, "Related Tests"), ("consumers", 4, "Dependent Consumers")]


def contexts(features: DataFrame, members: DataFrame, budget: int) -> DataFrame:
    """(feature, context, sections, dropped) of each feature (feature, title).

    ``members`` are lines (feature, category, line, sort). A section is its title and its lines; sections are taken in order of
    priority while their estimated tokens still fit, and one that doesn't is passed over. A context is one text, so a feature's
    lines come together in one row; lines beyond the budget on their own are dropped before that, by a running sum of the
    section's length, since their section can't fit.
    """
    from pyspark.sql import Window

    titles = F.coalesce(*[F.when(F.col("category") == c, F.struct(F.lit(p).alias("p"), F.lit(t).alias("t"))) for c, p, t in SECTIONS])
    rows = members.join(features.select("feature"), "feature", "left_semi").withColumn("section", titles).where("section is not null")
    w = Window.partitionBy("feature", "category").orderBy("sort", "line")
    size = F.sum(F.length("line") + 3).over(w)  # at 3.3 characters a token or fewer, what is longer than 3.3 x budget can't fit
    rows = rows.withColumn("fits", size <= int(3.3 * budget) + 3)
    item = F.when(F.col("fits"), F.struct("sort", "line"))
    sections = rows.groupBy("feature", "section").agg(F.sort_array(F.collect_list(item)).alias("lines"), F.every("fits").alias("whole"))
    body = F.concat(F.lit("## "), F.col("section.t"), F.lit("\n"), F.array_join(F.transform("lines", lambda x: F.concat(F.lit("- "), x["line"])), "\n"), F.lit("\n"))
    sections = sections.select("feature", F.col("section.p").alias("p"), F.when(F.col("whole"), body).alias("text"))
    head = features.select("feature", F.lit(10).alias("p"), F.concat(F.lit("# Feature Context: "), "title", F.lit("\n")).alias("text"))
    blocks = head.union(sections).withColumn("cost", exprs.token_estimate(F.col("text")))
    lists = blocks.groupBy("feature").agg(F.sort_array(F.collect_list(F.struct((-F.col("p")).alias("p"), "text", "cost"))).alias("items"))  # at most seven
    zero = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<string>").alias("texts"))
    taken = F.aggregate("items", zero, lambda a, x: F.when(x["text"].isNotNull() & (a["sum"] + x["cost"] <= budget), F.struct((a["sum"] + x["cost"]).cast("bigint").alias("sum"), F.array_append(a["texts"], x["text"]).alias("texts"))).otherwise(a))
    done = lists.select("feature", taken.alias("r"), F.size("items").alias("all"))
    return done.select("feature", F.array_join("r.texts", "\n").alias("context"), F.size("r.texts").alias("sections"), (F.col("all") - F.size("r.texts")).alias("dropped"))
