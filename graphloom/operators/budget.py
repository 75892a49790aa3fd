"""Fitting texts into token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import PUNCTUATION, token_estimate

MARK = "\n... [truncated]"


def pack(items: DataFrame, group: str, priority: Column, order: Column, cost: Column, ident: Column, budget: int) -> DataFrame:
    """(group, packed, total, dropped): each group's items by falling priority, taken if they still fit, else passed over.

    A group is folded in one row, as its result is one.
    """
    item = F.struct((-priority).alias("p"), order.alias("o"), cost.cast("bigint").alias("c"), ident.alias("i"))
    rows = items.groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("items"))
    zero = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).cast("bigint").alias("n"), F.lit("").alias("ids"))
    take = lambda a, x: F.when(
        a["sum"] + x["c"] <= budget, F.struct((a["sum"] + x["c"]).alias("sum"), (a["n"] + 1).alias("n"), F.concat(a["ids"], F.lit(","), x["i"].cast("string")).alias("ids"))
    ).otherwise(a)
    return rows.select(group, F.aggregate("items", zero, take).alias("r"), F.size("items").alias("all")).select(group, F.substring("r.ids", 2, 1 << 30).alias("packed"), F.col("r.sum").alias("total"), (F.col("all") - F.col("r.n")).cast("bigint").alias("dropped"))


def truncate(text: Column, budget: int) -> Column:
    """The text, or its longest prefix that fits with a mark behind it; a budget below the mark gives nothing.

    A prefix costs by its length and its punctuation, so never less than a shorter one: the longest that fits is found by halving.
    """
    marks = F.regexp_count(F.lit(MARK), F.lit(PUNCTUATION))
    cost = lambda length, punctuation: F.ceil((length + len(MARK)) / F.lit(3.3) + F.lit(0.25) * (punctuation + marks))
    most = max(int(3.3 * budget) + 1, 0)  # no longer prefix can fit, with or without the mark
    head = F.substring(text, 1, most)
    fits = lambda n: (n <= F.length(head)) & (cost(n, F.regexp_count(F.substring(head, F.lit(1), n), F.lit(PUNCTUATION))) <= budget)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))]) if most else F.array().cast("array<int>")
    best = F.aggregate(steps, F.lit(0), lambda n, step: F.when(fits(n + step), n + step).otherwise(n))
    cut = F.when(F.lit(budget) < cost(F.lit(0), F.lit(0)), F.lit("")).otherwise(F.concat(F.substring(head, F.lit(1), best), F.lit(MARK)))
    return F.when((F.length(text) <= most) & (token_estimate(text) <= budget), text).otherwise(F.when(text.isNotNull(), cut))
