"""URL filters: explicit rules, and empirical-Bayes reputation of hosts for the urls that no rule decides.

Labelled outcomes are counted by host, registered domain and suffix. Each level's block rate is shrunk towards the
rate of the level above through a beta prior, whose strength comes from how much the groups of that level differ (the
analysis-of-variance estimate of the beta-binomial's correlation). A host's posterior is a beta distribution; a host
whose lower bound is at ``limit`` or more is blocked. Pages are reduced to one row for each host before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stockweave.functions.runtime import materialize

#: verdict, host, path: a rule fits its host and all subdomains when the url's path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"  # of a url: host, path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does; of rules of one length the first listed."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    return F.coalesce(*[
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in ordered], F.lit(None).cast("struct<rule:string,verdict:string>"))


def domain_of(host: Column) -> Column:
    """The last two names of a host; a host of one name, or an address of numbers, is its own domain."""
    return F.when(host.rlike(r"^[0-9.:\[\]]*$"), host).otherwise(F.substring_index(host, ".", -2))


def strength(groups: DataFrame, n: str, bad: str, least: float = 1.0, most: float = 1000.0) -> Column | float:
    """Prior observations that a parent is worth to its groups. One row of sums comes to the driver."""
    seen = groups.filter(F.col(n) > 0)
    k, total, hits, squares, share = seen.agg(
        F.count("*"), F.sum(n), F.sum(bad), F.sum(F.col(n).cast("double") * F.col(n)), F.sum(F.col(bad).cast("double") * F.col(bad) / F.col(n))).first()
    if not total or k < 2:
        return most
    p = hits / total
    spread = p * (1 - p)
    room = (total - squares / total - (k - 1)) * spread
    if room <= 0:
        return most
    rho = ((share - hits * p) - (k - 1) * spread) / room
    return most if rho <= 0 else min(most, max(least, (1 - rho) / rho))


def reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """Posterior block rate of each host of ``outcomes`` (host, n labelled, bad): host, rate, low (the one-sided
    bound ``z`` standard deviations below)."""
    hosts = materialize(outcomes.withColumns({"_domain": domain_of(F.col("host"))}).withColumn("_suffix", F.substring_index("_domain", ".", -1)), "hosts")
    domains = materialize(hosts.groupBy("_domain", "_suffix").agg(F.sum("n").alias("_nd"), F.sum("bad").alias("_bd")), "domains")
    suffixes = materialize(domains.groupBy("_suffix").agg(F.sum("_nd").alias("_ns"), F.sum("_bd").alias("_bs")), "suffixes")
    n, bad = suffixes.agg(F.coalesce(F.sum("_ns"), F.lit(0)), F.coalesce(F.sum("_bs"), F.lit(0))).first()
    whole = (bad + 1.0) / (n + 2.0)
    by_suffix, by_domain, by_host = strength(suffixes, "_ns", "_bs"), strength(domains, "_nd", "_bd"), strength(hosts, "n", "bad")
    suffixes = suffixes.select("_suffix", ((F.col("_bs") + by_suffix * whole) / (F.col("_ns") + by_suffix)).alias("_ps"))
    domains = domains.join(suffixes, "_suffix").select("_domain", ((F.col("_bd") + by_domain * F.col("_ps")) / (F.col("_nd") + by_domain)).alias("_pd"))
    size = F.col("n") + F.lit(by_host)
    judged = hosts.join(domains, "_domain").select("host", size.alias("_size"), ((F.col("bad") + by_host * F.col("_pd")) / size).alias("rate"))
    return judged.select("host", "rate", (F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("_size") + 1))).alias("low"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, limit: float = 0.5, z: float = 1.645) -> DataFrame:
    """Verdict of each row of ``pages`` (page_id, url; other columns are ignored): page_id, host, path, rule, verdict, rate, low.

    The labelled outcomes are the pages that a rule decides. A null url, or one without ``://``, has an empty host and path
    and is judged as the host of empty name. Repeated rows and ids each count and are each returned. Without any outcome the rate is one half
    with a wide posterior, and pages are allowed. An empty table gives no rows.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parts.withColumn("_fit", rule_of(F.col("host"), F.col("path"), rules))
    outcomes = ruled.groupBy("host").agg(F.count("_fit").alias("n"), F.count(F.when(F.col("_fit.verdict") == "block", 1)).alias("bad"))
    method = F.when(F.col("low") >= limit, F.lit("block")).otherwise(F.lit("allow"))
    return ruled.join(reputation(outcomes, z), "host", "left").select(
        "page_id", "host", "path", F.col("_fit.rule").alias("rule"), F.coalesce(F.col("_fit.verdict"), method).alias("verdict"), "rate", "low")
