"""Connected components by alternating star operations on the table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficloom.llm.tables import written


def _print(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node reached.

    Each round joins all larger neighbours of a node to its smallest one, then
    all smaller ones. Rounds end when the links no longer change; every node
    is then linked to the smallest of its component alone. Links of a node
    with itself and repeated links do no harm; nulls are dropped. Every round
    is a written table, so no plan grows and no executor is waited for twice.
    """
    links = written(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a is not null and b is not null and a != b")
        .distinct(),
        "links",
    )
    before = _print(links)
    while before[0]:
        # Large star: every neighbour above the node goes to the node's smallest neighbour.
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        links = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: the node and its smaller neighbours go to the smallest of them.
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        lower = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = lower.unionAll(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        links = written(links, "links")
        after = _print(links)
        if after == before:
            break
        before = after
    pairs = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.unionAll(pairs.select(F.col("component").alias("node"), "component").distinct())
