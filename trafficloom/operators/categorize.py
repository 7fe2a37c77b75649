"""Domain categories: override > known host > blocklist > TLD > keyword > uncategorized."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficloom.fixed_values import (
    KEYWORD_CATEGORIES,
    STARTER_HOSTNAMES,
    TLD_CATEGORIES,
    UNCATEGORIZED,
)
from trafficloom.functions.network import last_labels
from trafficloom.functions.skew import dimension_join, has_at_most, lookup_join

# Pieces a matched blocklist entry is copied into, so that one parent domain
# with very many sub-domains is met by many tasks.
SUFFIX_SALTS = 32
# Host lists up to this many rows are matched by broadcast joins.
MAX_BROADCAST_HOSTS = 10_000


@dataclass(frozen=True)
class CategoryRules:
    """The rule tables of a deployment.

    ``hostnames``: (hostname, category) pairs, or a DataFrame of them of any size; case does not matter.
    ``overrides``: DataFrame (domain, category).
    ``blocklist``: DataFrame (domain, label, priority), any size.

    A host or override listed more than once counts once, with the category
    that is first by name. Lists of up to ``memory_hosts`` hosts are matched by
    broadcast joins, longer ones by the same joins as the blocklist; the
    result is the same.
    """

    hostnames: tuple[tuple[str, str], ...] | DataFrame = STARTER_HOSTNAMES
    overrides: DataFrame | None = None
    blocklist: DataFrame | None = None
    tlds: tuple[tuple[str, str], ...] = field(default=TLD_CATEGORIES)
    keywords: tuple[tuple[str, str], ...] = field(default=KEYWORD_CATEGORIES)
    memory_hosts: int = MAX_BROADCAST_HOSTS


def _by_label_count(hostnames: tuple[tuple[str, str], ...]) -> dict[int, list[tuple[str, str]]]:
    groups: dict[int, list[tuple[str, str]]] = {}
    for hostname, category in hostnames:
        groups.setdefault(hostname.count(".") + 1, []).append((hostname, category))
    return groups


def known_host(df: DataFrame, hostnames: tuple[tuple[str, str], ...], out: str) -> DataFrame:
    """Category of the longest known host that equals or is a parent of ``domain``.

    A host of n labels can only match the domain's last n labels, so this is one
    broadcast equi-join per label count: no shuffle and no row multiplication.
    """
    spark = df.sparkSession
    original = df.columns
    picks = []
    for depth, rows in sorted(_by_label_count(hostnames).items(), reverse=True):
        # An Arrow table becomes a local relation, whose exact size the planner knows.
        hosts, categories = zip(*rows)
        table = spark.createDataFrame(pa.table({f"__host_{depth}": hosts, f"__category_{depth}": categories}))
        df = df.join(F.broadcast(table), last_labels(F.lower("domain"), depth) == F.col(f"__host_{depth}"), "left")
        picks.append(F.col(f"__category_{depth}"))
    value = F.coalesce(*picks) if picks else F.lit(None).cast("string")
    return df.select(*original, value.alias(out))


def ancestors(domain: Column, shortest: int = 2) -> Column:
    """The domain and its parents, down to ``shortest`` labels."""
    labels = F.split(F.lower(domain), "\\.")
    starts = F.sequence(F.lit(1), F.size(labels) - shortest + 1)
    found = F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    return F.when(F.size(labels) >= shortest, found).otherwise(F.array().cast("array<string>"))


def blocklist_hits(
    domains: DataFrame, blocklist: DataFrame, salts: int = SUFFIX_SALTS, shortest: int = 2
) -> DataFrame:
    """(domain, label) for those ``domain`` rows (distinct) with a listed ancestor.

    The entry with the lowest priority number gives the label.

    Listed ancestors are found on distinct suffixes first, where keys are unique
    on both sides. Only those entries are then copied ``salts`` times for the
    join back to the domains, so a parent shared by many domains is split.
    """
    pairs = domains.select("domain", F.explode(ancestors(F.col("domain"), shortest)).alias("suffix"))
    best = blocklist.groupBy(F.col("domain").alias("suffix")).agg(F.min(F.struct("priority", "label")).alias("entry"))
    listed = pairs.select("suffix").distinct().join(best, "suffix")
    copies = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("domain"), F.lit(salts)).cast("int"))
    return (
        salted.join(copies, ["suffix", "salt"])
        .groupBy("domain")
        .agg(F.min("entry").alias("entry"))
        .select("domain", F.col("entry.label").alias("label"))
    )


def tld_category(domain: Column, tlds: tuple[tuple[str, str], ...]) -> Column:
    return _first_match(tlds, lambda text: F.lower(domain).endswith(text))


def keyword_category(domain: Column, keywords: tuple[tuple[str, str], ...]) -> Column:
    return _first_match(keywords, lambda text: F.lower(domain).contains(text))


def _first_match(rules: tuple[tuple[str, str], ...], test) -> Column:
    chain = F.lit(None).cast("string")
    for text, category in reversed(rules):
        chain = F.when(test(text), F.lit(category)).otherwise(chain)
    return chain


def _host_rows(hostnames: tuple[tuple[str, str], ...] | DataFrame, in_memory: int) -> tuple[tuple[str, str], ...] | DataFrame:
    """A host list as plain rows when its size allows, else as a frame; one row per host either way."""
    if not isinstance(hostnames, tuple):
        hosts = hostnames.where("hostname is not null and category is not null")
        hosts = hosts.groupBy(F.lower("hostname").alias("hostname")).agg(F.min("category").alias("category"))
        if not has_at_most(hosts, in_memory):
            return hosts
        hostnames = tuple((r.hostname, r.category) for r in hosts.collect())
    single: dict[str, str] = {}
    for hostname, category in hostnames:
        host = hostname.lower()
        single[host] = min(category, single.get(host, category))
    return tuple(single.items())


def tiers(df: DataFrame, rules: CategoryRules, spread_by: list[str] | None = None) -> DataFrame:
    """Adds one column per rule tier: override, host, listed, tld and keyword categories.

    Works on any frame with a ``domain`` column, at any grain. ``spread_by``
    names columns that vary within a domain; rows of a domain too frequent
    for one task are spread by them (default: the domain only).
    """
    spread = [F.col(c) for c in (spread_by or ["domain"])]
    original, source = df.columns, df
    if rules.overrides is not None:
        overrides = rules.overrides.groupBy("domain").agg(F.min("category").alias("override_category"))
        df = dimension_join(df, overrides, "domain", spread)
    else:
        df = df.withColumn("override_category", F.lit(None).cast("string"))
    named = source.where(F.col("domain").isNotNull())
    counts = named.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    hosts = _host_rows(rules.hostnames, rules.memory_hosts)
    if isinstance(hosts, tuple):
        df = known_host(df, hosts, "host_category")
    else:
        longest = hosts.select(
            F.col("hostname").alias("domain"), F.col("category").alias("label"), (-F.length("hostname")).alias("priority")
        )
        found = blocklist_hits(counts.select("domain"), longest, shortest=1).withColumnRenamed("label", "host_category")
        df = lookup_join(df, found, "domain", spread, key_counts=counts)
    if rules.blocklist is not None:
        hits = blocklist_hits(counts.select("domain"), rules.blocklist)
        df = lookup_join(df, hits, "domain", spread, key_counts=counts)
    else:
        df = df.withColumn("label", F.lit(None).cast("string"))
    return df.select(
        *original,
        "override_category",
        "host_category",
        F.col("label").alias("listed_category"),
        tld_category(F.col("domain"), rules.tlds).alias("tld_category"),
        keyword_category(F.col("domain"), rules.keywords).alias("keyword_category"),
    )


def categorize(df: DataFrame, rules: CategoryRules, spread_by: list[str] | None = None) -> DataFrame:
    """Adds ``category``: the first tier that matches, else uncategorized."""
    resolved = F.coalesce(
        "override_category",
        "host_category",
        "listed_category",
        "tld_category",
        "keyword_category",
        F.lit(UNCATEGORIZED),
    )
    return tiers(df, rules, spread_by).select(*df.columns, resolved.alias("category"))


def domains_in_category(rows: DataFrame, rules: CategoryRules, category: str) -> DataFrame:
    """Distinct domains of ``rows`` whose category is ``category``."""
    distinct = rows.where(F.col("domain").isNotNull() & (F.col("domain") != "")).select("domain").distinct()
    return categorize(distinct, rules).where(F.col("category") == category).select("domain")
