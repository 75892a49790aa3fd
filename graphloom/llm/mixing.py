"""Mixing sources to target weights by entropy balancing; DataFrame expressions alone.

Each source gets a target of tokens. Of all rates of its documents that meet the target and lie within [0, cap], entropy balancing
takes those closest to one (least sum of w log w - w): w = min(cap, exp(lambda * size)), sizes in units of the source's mean. The
convex dual has one variable a source, and Newton's method solves all of them at once, each step one grouped sum. As a rate
depends on source and size alone, all steps run over counts by source and size, not over documents; sums are decimal, so that
no order of addition shows in a result.

Rates become copies: along sizes downwards, the running sum of expected copies is cut at whole numbers, which leaves a source off
its target by less than its longest document. Then the largest size that fits into what is left takes or gives copies, again and
again, and where none fits, the one that leaves less. Copies of a size go to its documents as evenly as whole numbers allow, the odd ones by a seeded hash.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, held, stored

CAP, WEIGHTS = 3, (5, 2, 1)
#: Newton ends when every source's expected tokens are this close to its target, relatively, or after so many steps.
CLOSE, STEPS = 1e-8, 100
#: Steps that one job takes; then what is solved is looked at.
TOGETHER = 4
#: Copies are corrected until each source is this close to its target, or nothing fits any more.
NEAR = 1e-4
#: Documents of one source and size that are ranked by one task, about.
RANKED = 250
#: Sources up to which their solutions are broadcast.
SOURCES = 100_000
#: Pairs of source and size, or slices of these, up to which what is found for them is broadcast.
SIZES = 500_000
#: Rows alike that are written out from one array.
AGAIN = 10_000
SEED = "copies"


def words(text: Column) -> Column:
    """Runs of characters other than space and the controls 9 to 13."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def by_rank(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, weight): weights in turn over the sources by code point, null last. One task orders the sources, not the documents."""
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    return sources.select("source", F.get(F.array(*[F.lit(float(w)) for w in weights]), (rank - 1) % len(weights)).alias("weight"))


def targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """``sizes`` (source, source_size, weight) with target: all sizes shared by weight, at most ``cap`` times a source's size, the rest shared again.

    In the order of cap * size / weight the sources that stop come first. With those before it stopped, a source's share is
    (all - their caps) / (weights left) * weight; it stops if that exceeds its own cap. A weight that is null or not positive takes
    part only when all others have stopped: it gets nothing.
    """
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)
    order = Window.partitionBy(F.lit(0)).orderBy(F.when(weight > 0, cap * F.col("source_size") / weight).otherwise(float("inf")), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    s = sizes.withColumns({"w": weight, "top": (F.col("source_size") * cap).cast("decimal(38,0)"), "rank": F.row_number().over(order)})
    others = F.sum(F.col("w").cast("decimal(30,9)")).over(order.rowsBetween(0, Window.unboundedFollowing)).cast("double")
    s = s.withColumn("level", (F.sum("source_size").over(whole) - zero(F.sum("top").over(before))).cast("double") / F.when(others > 0, others))
    s = s.withColumn("stops", F.coalesce(F.col("level") * F.col("w") >= F.col("top").cast("double"), F.lit(False)))
    # The level at which the first source doesn't stop holds for all from there on
    s = s.withColumn("shared", F.min(F.when(~F.col("stops") & (F.col("w") > 0), F.struct("rank", "level"))).over(whole)["level"])
    return s.withColumn("target", F.when(F.col("w") <= 0, 0.0).when(F.col("stops"), F.col("top").cast("double")).otherwise(F.col("shared") * F.col("w"))).select("key", "source", "source_size", "n", "target")


def _solve(counts: DataFrame, sources: DataFrame, cap: int) -> DataFrame:
    """(key, tilt): each source's lambda, by Newton's method between bounds that shrink."""
    exact = lambda c: F.sum(c.cast("decimal(38,12)")).cast("double")
    x = F.col("size") / F.col("mean")
    whole = F.col("target") >= cap * F.col("source_size")
    s = sources.where((F.col("source_size") > 0) & (F.col("target") > 0) & ~whole)
    # With sizes in units of the mean, lambda = log(target / size) solves sources of equal sizes
    s = s.select("key", (F.col("source_size") / F.col("n")).alias("mean"), (F.col("target") / F.col("source_size") * F.col("n")).alias("goal"), F.log(F.col("target") / F.col("source_size")).alias("tilt"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(1.0).alias("off"))
    few = F.broadcast if sources.count() <= SOURCES else lambda df: df
    for step in range(STEPS):
        if step % TOGETHER == 0:
            s = cut(s)
            if not s.where(F.col("off") > CLOSE).head(1):
                break
        w = F.least(F.lit(float(cap)), F.exp(F.least(F.col("tilt") * x, F.lit(700.0))))
        free = F.exp(F.least(F.col("tilt") * x, F.lit(700.0))) < cap
        kept = [F.max(c).alias(c) for c in ("mean", "goal", "tilt", "low", "high")]  # one value a source
        s = counts.join(few(s.drop("off")), "key").groupBy("key").agg(*kept, exact(F.col("docs") * x * w).alias("met"), exact(F.when(free, F.col("docs") * x * x * w).otherwise(0.0)).alias("slope"))
        gap = F.col("goal") - F.col("met")
        low = F.when(gap >= 0, F.greatest("low", "tilt")).otherwise(F.col("low"))
        high = F.when(gap <= 0, F.least("high", "tilt")).otherwise(F.col("high"))
        s = s.select("key", "mean", "goal", "tilt", low.alias("low"), high.alias("high"), (F.col("tilt") + gap / F.when(F.col("slope") > 0, F.col("slope"))).alias("newton"), (F.abs(gap) / F.col("goal")).alias("off"))
        # Half way between the bounds, or doubling away from the one that is known
        middle = F.coalesce((F.col("low") + F.col("high")) / 2, F.col("low") + F.abs("low") + 1, F.col("high") - F.abs("high") - 1)
        inside = F.col("newton").isNotNull() & (F.coalesce(F.col("newton") > F.col("low"), F.lit(True))) & (F.coalesce(F.col("newton") < F.col("high"), F.lit(True))) & (F.abs(F.col("newton") - F.col("tilt")) <= 2 * (1 + F.abs("tilt")))
        stay = F.col("off") <= CLOSE
        s = s.select("key", "mean", "goal", F.when(stay, F.col("tilt")).when(inside, F.col("newton")).otherwise(middle).alias("tilt"), "low", "high", "off")
    return s.select("key", "tilt")


def rates(counts: DataFrame, sources: DataFrame, cap: int = CAP) -> DataFrame:
    """``counts`` (key, size, docs) with rate, the tilted number of times that a document of the size is taken, to nine places."""
    tilts = _solve(counts, sources, cap)
    s = held(sources.join(tilts, "key", "left"), SOURCES)
    tilted = F.least(F.lit(float(cap)), F.exp(F.least(F.col("tilt") * F.col("size") * F.col("n") / F.col("source_size"), F.lit(700.0))))
    rate = F.when(F.col("source_size") == 0, 1.0).when(F.col("target") <= 0, 0.0).when(F.col("tilt").isNull(), float(cap)).otherwise(tilted)
    return counts.join(s, "key").withColumn("rate", F.round(rate, 9))


def copies(rated: DataFrame, cap: int = CAP) -> DataFrame:
    """``rated`` with copies: whole numbers for each source and size whose tokens come near the target."""
    along = Window.partitionBy("key").orderBy(F.desc("size"))
    expected = (F.col("docs") * F.col("rate").cast("decimal(20,9)")).cast("decimal(38,9)")
    most = F.col("docs") * cap
    ran = rated.withColumn("ran", F.sum(expected).over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("copies", (F.floor(F.col("ran") + F.lit(0.5).cast("decimal(2,1)")) - F.floor(F.col("ran") - expected + F.lit(0.5).cast("decimal(2,1)"))).cast("bigint"))
    c = cut(ran.select("key", "size", "docs", "target", F.greatest(F.lit(0), F.least(F.col("copies"), most)).alias("copies")))
    few = F.broadcast if c.select("key").distinct().count() <= SOURCES else lambda df: df
    for step in itertools.count(1):
        # What each source lacks, and the largest size that fits into it and still can take or give copies
        left = c.groupBy("key").agg((F.round(F.max("target")) - F.sum(F.col("size") * F.col("copies"))).cast("bigint").alias("left"), F.max("target").alias("goal"))
        left = left.where(F.abs("left") > NEAR * F.col("goal"))
        room = F.when(F.col("left") > 0, most - F.col("copies")).otherwise(F.col("copies"))
        # Sizes that would overshoot by less than is left serve where none fits
        near = (F.col("size") > 0) & (F.col("size") < 2 * F.abs("left")) & (room > 0)
        move = c.join(few(left), "key").withColumn("room", room).where(near).withColumn("fits", F.col("size") <= F.abs("left"))
        # Downwards along the sizes that fit: all of their room, then as much as fits of the next
        upto = F.sum(F.when(F.col("fits"), F.col("size") * F.col("room")).otherwise(0)).over(along.rowsBetween(Window.unboundedPreceding, 0))
        rest = F.abs("left") - F.col("upto") + F.col("size") * F.col("room")
        by = F.when(F.col("fits"), F.least(F.col("room"), F.floor(rest / F.col("size")))).when(F.col("size") == F.col("least"), 1)
        move = move.withColumns({"upto": upto, "least": F.min("size").over(Window.partitionBy("key"))}).withColumn("by", by).where(F.col("by") > 0)
        move = held(move.select("key", "size", (F.col("by") * F.signum("left")).cast("bigint").alias("change")), SIZES)
        if not move.head(1):
            return c
        c = c.join(move, ["key", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))).drop("change")
        c = cut(c) if step % TOGETHER == 0 else c


def mix(docs: DataFrame, weights: DataFrame | None = None, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken of every document.

    ``weights`` (source, weight) are the shares of the sources, which need not sum to one; without, WEIGHTS in turn by rank.
    A document is taken ``copies`` times, at most ``cap``; taken is copies * size.

    Defined results: a null text has size 0; a null source is a source; a source of no tokens has target 0 and rate 1 for each of
    its documents; a source whose weight is missing, null or not positive has target 0 and its documents aren't taken; rows that
    repeat id, source and size are told apart by nothing, so which of them takes an odd copy can't be seen; a null doc_id is an
    id; an empty table gives no rows; other columns, whatever their names, are ignored. Reruns agree.
    """
    c = lambda name: F.col(f"`{name}`")
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = docs.select(c("doc_id").cast("bigint").alias("doc_id"), c("source").cast("string").alias("source"), words(c("text")).alias("size")).withColumn("key", key)
    rows = stored(rows.groupBy("key", "source", "doc_id", "size").agg(F.count("*").alias("alike")))
    counts = stored(rows.groupBy("key", "source", "size").agg(F.sum("alike").alias("docs")))
    sizes = counts.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"), F.sum("docs").alias("n"))
    if weights is None:
        weighed = by_rank(sizes.select("source"))
    else:
        weighed = weights.groupBy(F.col("source").cast("string").alias("source")).agg(F.max(F.col("weight").cast("double")).alias("weight"))
    weighed = weighed.select(key.alias("key"), "weight")
    sources = cut(targets(sizes.join(weighed, "key", "left"), cap))
    rated = cut(rates(counts.drop("source"), sources, cap).select("key", "size", "docs", "rate", "target"))
    by_size = held(copies(rated, cap).select("key", "size", "copies").join(rated.drop("target"), ["key", "size"]), SIZES)
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "size", "key").cast("binary")), 1, 15), 16, 10).cast("bigint")
    placed = rows.join(by_size, ["key", "size"]).withColumn("hash", hashed).withColumn("slice", F.pmod("hash", F.ceil(F.col("docs") / RANKED)))
    # Many documents of one source and size are cut into slices by their hash; a slice takes its part of the odd copies
    at = ["key", "size", "slice"]
    parts = placed.where(F.col("docs") > RANKED).groupBy(*at).agg(F.sum("alike").alias("mine"), F.max("docs").alias("docs"), F.max("copies").alias("copies"))
    upto = F.sum("mine").over(Window.partitionBy("key", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0))
    share = lambda n: F.floor(n.cast("decimal(19,0)") * (F.col("copies") % F.col("docs")) / F.col("docs")).cast("bigint")
    parts = held(parts.withColumn("upto", upto).select(*at, (share(F.col("upto")) - share(F.col("upto") - F.col("mine"))).alias("share")), SIZES)
    # Rows alike hold a run of places in their slice; places below the slice's odd copies take one more
    order = Window.partitionBy(*at).orderBy("hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("before", F.coalesce(F.sum("alike").over(order), F.lit(0))).join(parts, at, "left")
    odd = F.coalesce("share", F.col("copies") % F.col("docs"))
    more = F.greatest(F.lit(0), F.least(F.col("alike"), odd - F.col("before")))
    each = F.expr("copies div docs")
    both = F.array(F.struct(more.alias("times"), (each + 1).alias("copies")), F.struct((F.col("alike") - more).alias("times"), each.alias("copies")))
    out = ranked.select("key", "doc_id", "source", "size", "rate", F.explode(F.filter(both, lambda b: b["times"] > 0)).alias("b"))
    out = out.withColumn("from", F.explode(F.sequence(F.lit(0), F.col("b.times") - 1, F.lit(AGAIN))))
    out = out.withColumn("again", F.explode(F.sequence(F.lit(1), F.least(F.lit(AGAIN), F.col("b.times") - F.col("from")))))
    out = out.select("key", "doc_id", "source", "size", "rate", "b.copies").join(held(sources.select("key", "source_size", "target"), SOURCES), "key")
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
