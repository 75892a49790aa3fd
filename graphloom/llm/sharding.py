"""Shards that each hold every source in its share of the whole.

Rows are shuffled by a seeded hash and ranked within their source; the fractional rank (rank + 1/2) / rows of the source places
each source evenly over [0, 1), so a cut of the order by it into equal counts gives every shard the mixture. Both ranks are
global without any task that holds a source: rows fall into buckets by a prefix of their sort key, bucket counts are summed up,
and rows are numbered within a bucket alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS, SEED = 8, "mix"
#: Buckets of a source by its hash, 16 to the power of hex digits, and of the whole by fractional rank.
HEX_DIGITS, SLICES = 3, 4096
#: A source's first place lies at one of so many steps between 0 and 1 / its rows.
OFFSETS = 4096


def _numbered(rows: DataFrame, group: list[str], bucket: str, order: list[Column], name: str) -> DataFrame:
    """A gapless number from 0 within the group by bucket, then order; and the group's rows as ``<name>_of``."""
    counts = rows.groupBy(*group, bucket).agg(F.count("*").alias("in_bucket"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, bucket, F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("before"), F.sum("in_bucket").over(Window.partitionBy(*group)).alias(f"{name}_of"))
    within = F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order))
    return rows.withColumn("within", within).join(counts, [*group, bucket]).withColumn(name, F.col("before") + F.col("within") - 1).drop("before", "within")


def assign(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and source of every document.

    The law is ``rows``: shards' counts are at most one apart (shard k holds the positions from ceil(k * n / shards) on), and
    slots number a shard's rows in the order of fractional ranks. Defined results: a null text has size 1 and the hash of an
    empty one; null sources are a source; a null doc_id shuffles as "null", with its text's hash; rows with the same id, size and hash are ordered
    by nothing else, which no result column shows; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("stratum"),
    )
    # The text's hash spreads rows of one id, nulls among them; a source's offset, in [0, 1), spreads sources of few rows
    rows = rows.withColumn("shuffled", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_crc32").cast("binary"))).withColumn("bucket", F.substring("shuffled", 1, HEX_DIGITS))
    offset = F.pmod(F.crc32(F.concat(F.lit(seed), "stratum").cast("binary")), F.lit(OFFSETS)) / OFFSETS
    ties = [F.col(c) for c in ("shuffled", "doc_id", "text_crc32", "size")]
    ranked = _numbered(rows, ["stratum"], "bucket", ties, "rank").withColumn("fraction", (F.col("rank") + offset) / F.col("rank_of"))
    ranked = ranked.withColumn("slice", F.floor(F.col("fraction") * SLICES)).withColumn("whole", F.lit(0))
    placed = _numbered(ranked, ["whole"], "slice", [F.col("fraction"), F.col("stratum"), *ties], "place")
    n, k = F.col("place_of"), F.col("place")
    shard = F.floor(k * shards / n).cast("int")
    exact = F.when((shard + 1) * n <= k * shards, shard + 1).when(shard * n > k * shards, shard - 1).otherwise(shard).cast("int")  # in whole numbers
    first = F.floor((F.col("shard") * n + shards - 1) / shards).cast("bigint")
    return placed.withColumn("shard", exact).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (k - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source")
