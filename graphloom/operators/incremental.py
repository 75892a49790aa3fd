"""Snapshots: what changed, what was renamed, and how a graph is brought up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """(key, change) of every key on either side: added, modified, deleted or same. Empty or null hashes never count as modified."""
    o, n = old.select(key, F.col(value).alias("_o"), F.lit(True).alias("_in_o")), new.select(key, F.col(value).alias("_n"), F.lit(True).alias("_in_n"))
    differs = (F.col("_o") != F.col("_n")) & (F.col("_o") != "") & (F.col("_n") != "")
    change = F.when(F.col("_in_o").isNull(), "added").when(F.col("_in_n").isNull(), "deleted").when(differs, "modified").otherwise("same")
    return o.join(n, key, "full").select(key, change.alias("change"))


def drift(changed: DataFrame) -> DataFrame:
    """One row: counts by change, the share of changed files among present ones (at most 1), stale and rebuild."""
    n = lambda *kinds: F.count_if(F.col("change").isin(*kinds))
    score = F.least(F.lit(1.0), n("added", "modified", "deleted") / F.greatest(F.lit(1), n("added", "modified", "same")))
    return changed.agg(n("added").alias("added"), n("modified").alias("modified"), n("deleted").alias("deleted"), F.round(score, 4).alias("score"), (n("added", "modified", "deleted") > 0).alias("stale"), (score > 0.4).alias("rebuild"))


def renames(deleted: DataFrame, added: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """(from_key, to_key): deleted and added files of the same hash, first with first, each once."""
    nth = F.row_number().over(Window.partitionBy(value).orderBy(key))
    side = lambda df, name: df.where(F.col(value) != "").select(value, F.col(key).alias(name), nth.alias("nth"))
    return side(deleted, "from_key").join(side(added, "to_key"), [value, "nth"]).select("from_key", "to_key")


def reconcile(old: DataFrame, new: DataFrame, kept_kinds: tuple[str, ...] = ("file", "feature")) -> DataFrame:
    """Nodes (urn, kind, status, created_at and more) after files were read again: (urn, kind, action, status, created_at).

    New nodes are added, known ones updated with their old creation time, vanished ones retired (but for the kinds kept).
    """
    o, n = old.select("urn", F.col("kind").alias("_ok"), F.col("status").alias("_os"), F.col("created_at").alias("_oc")), new.select("urn", F.col("kind").alias("_nk"), F.col("created_at").alias("_nc"))
    action = F.when(F.col("_ok").isNull(), "added").when(F.col("_nk").isNotNull(), "updated").when(F.col("_ok").isin(*kept_kinds), "kept").otherwise("retired")
    status = F.when(F.col("_nk").isNotNull(), "active").when(F.col("_ok").isin(*kept_kinds), F.col("_os")).otherwise("retired")
    return o.join(n, "urn", "full").select("urn", F.coalesce("_nk", "_ok").alias("kind"), action.alias("action"), status.alias("status"), F.coalesce("_oc", "_nc").alias("created_at"))


def renamed_nodes(nodes: DataFrame, moved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with moved paths (from_key, to_key) under their new urns, and aliases (old_urn, urn).

    Of an urn, prefix:kind:path#ident or kind:path#ident, the path alone is exchanged, wherever else its letters occur.
    """
    m = moved.withColumnsRenamed({"from_key": "path", "to_key": "_to"})
    j = nodes.join(m, "path", "left")
    new = F.col("urn")
    for parts in (1, 2, 3):
        head = F.concat(F.substring_index("urn", ":", parts), F.lit(":"))
        rest = F.expr(f"substring(urn, length(substring_index(urn, ':', {parts})) + 2)")
        fits = (rest == F.col("path")) | rest.startswith(F.concat("path", F.lit("#")))
        new = F.when(F.col("_to").isNotNull() & fits, F.concat(head, "_to", F.expr(f"substring(urn, length(substring_index(urn, ':', {parts})) + 2 + length(path))"))).otherwise(new)
    j = j.withColumn("_new", new)
    aliases = j.where("_to is not null").select(F.col("urn").alias("old_urn"), F.col("_new").alias("urn"))
    return j.withColumn("urn", F.col("_new")).withColumn("path", F.coalesce("_to", "path")).select(*nodes.columns), aliases


def renamed_edges(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges under the new names (old_urn, urn) of their ends."""
    columns = edges.columns
    for end in ("source_urn", "target_urn"):
        edges = edges.join(aliases.select(F.col("old_urn").alias(end), F.col("urn").alias("_now")), end, "left").withColumn(end, F.coalesce("_now", end)).drop("_now")
    return edges.select(*columns)


def followed(before: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases (old_urn, urn) of before, led on by later ones, and these; of an old name given twice the later counts."""
    on = aliases.select(F.col("old_urn").alias("urn"), F.col("urn").alias("_now"))
    led = before.join(on, "urn", "left").select("old_urn", F.coalesce("_now", "urn").alias("urn"))
    return led.join(aliases.select("old_urn"), "old_urn", "left_anti").where("old_urn != urn").union(aliases.select("old_urn", "urn"))
