"""Filtering of addresses by rules and by the empirical-Bayes reputation of their hosts; DataFrame expressions alone.

Labelled pages are counted as bad or not by host, registered domain and suffix. At each level the share of bad pages has a beta
prior whose mean is the level above's shrunk share and whose weight comes from the spread of the shares at that level (method
of moments), so a host with few labels leans on its domain, and that on its suffix. An address that no rule decides is blocked
if the lower bound of its posterior share of bad pages is above a threshold. The bound is that of a normal distribution with the
posterior's mean and variance: with few labels it is lower than the beta's own quantile, so less is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import host_name, host_parts, lower_ascii

# The rules, as (verdict, host, path).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Share of bad pages above which the bound blocks; normal quantile of the bound.
THRESHOLD, QUANTILE = 0.2, 1.64
#: Least and most weight of a prior, in labelled pages.
WEIGHTS = (2.0, 200.0)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path; both empty for a null address or one without "://"."""
    empty = F.lit("")
    host = lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, empty), F.coalesce(path, empty)


def by_rules(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits; null, if none does. The list is part of the query, so it is short."""
    rule = verdict = F.lit(None).cast("string")
    for name, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, name).otherwise(verdict)
    return rule, verdict


def _weight(groups: DataFrame, share: Column, mean: Column) -> DataFrame:
    """One row: the prior's weight at a level, from how far its groups' shares lie from their prior means."""
    spread = F.sum(F.col("n") * (share - mean) * (share - mean)) / F.sum("n")
    noise = F.sum(mean * (1 - mean)) / F.sum("n")  # what the spread would be if all groups had their prior means
    size = F.sum(mean * (1 - mean) * F.col("n")) / F.sum("n")
    w = F.when(spread > noise, (size - spread) / (spread - noise)).otherwise(WEIGHTS[1])
    return groups.agg(F.greatest(F.lit(WEIGHTS[0]), F.least(F.lit(WEIGHTS[1]), F.coalesce(w, F.lit(WEIGHTS[1])))).alias("weight"))


def reputations(labelled: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of rows (host, bad), hosts without user and port: tables host, domain, suffix and all, each with the posterior a and b of its beta distribution.

    What is broadcast is one row a level: the corpus's counts and the prior's weight.
    """
    hosts = labelled.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    domain, suffix = host_parts(F.col("host"))
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains, suffixes = hosts.groupBy("domain", "suffix").agg(*sums), hosts.groupBy("suffix").agg(*sums)
    whole = hosts.agg(*[F.coalesce(s, F.lit(0)).alias(c) for s, c in zip((F.sum("n"), F.sum("bad")), ("n", "bad"), strict=True)]).select((F.col("bad") + 0.5).alias("a"), (F.col("n") - F.col("bad") + 0.5).alias("b"))

    def level(groups: DataFrame, key: str, above: DataFrame, above_key: str | None) -> DataFrame:
        mean = above.select(*([above_key] if above_key else []), (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"))
        g = groups.join(mean, above_key) if above_key else groups.crossJoin(F.broadcast(mean))
        g = g.crossJoin(F.broadcast(_weight(g, F.col("bad") / F.col("n"), F.col("mean"))))
        return g.select(*dict.fromkeys([key, *[c for c in ("domain", "suffix") if c in groups.columns]]), (F.col("weight") * F.col("mean") + F.col("bad")).alias("a"), (F.col("weight") * (1 - F.col("mean")) + F.col("n") - F.col("bad")).alias("b"))

    by_suffix = level(suffixes, "suffix", whole, None)
    by_domain = level(domains, "domain", by_suffix, "suffix")
    by_host = level(hosts, "host", by_domain.drop("suffix"), "domain")
    return by_host.select("host", "a", "b"), by_domain.select("domain", "a", "b"), by_suffix.select("suffix", "a", "b"), whole


def bound(a: Column, b: Column) -> Column:
    """Lower bound of a beta distribution's value: its mean less QUANTILE standard deviations."""
    n = a + b
    return a / n - QUANTILE * F.sqrt(a * b / (n * n * (n + 1)))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict and bad_bound of every page. ``outcomes``: page_id and bad (0 or 1), of some pages.

    Defined results: a null address or one without "://" has an empty host and path and is judged like a host without labels;
    pages without labels lean on the level above, with no labels at all on an even prior; outcomes with nulls, or of unknown
    pages, don't count; a page labelled twice counts twice; repeated pages give a row each; empty tables give no rows; other
    columns are ignored.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    bad = outcomes.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("bad").cast("int").alias("bad")).where("page_id is not null and bad is not null")
    by_host, by_domain, by_suffix, whole = reputations(rows.select("page_id", "host").join(bad, "page_id").select(host_name(F.col("host")).alias("host"), "bad"))
    # One row for each host, so that what is joined to pages is small next to them
    hosts = rows.select("host").distinct().withColumn("name", host_name(F.col("host")))
    domain, suffix = host_parts(F.col("name"))
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    for t, key in ((by_host.withColumnRenamed("host", "name"), "name"), (by_domain, "domain"), (by_suffix, "suffix")):
        hosts = hosts.join(t.select(key, bound(F.col("a"), F.col("b")).alias(f"{key}_bound")), key, "left")
    hosts = hosts.crossJoin(F.broadcast(whole.select(bound(F.col("a"), F.col("b")).alias("all_bound"))))
    hosts = hosts.select("host", F.coalesce("name_bound", "domain_bound", "suffix_bound", "all_bound").alias("bad_bound"))
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_bound") > threshold, "block").otherwise("allow")
    return rows.join(hosts, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.round("bad_bound", 9).alias("bad_bound"))
