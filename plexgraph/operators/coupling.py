"""Co-change coupling: items that change in the same commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs(changes: DataFrame, cap: int = 50) -> DataFrame:
    """(a, b, co_changes) for a < b from distinct (commit, item); commits with more than ``cap`` items are left out.

    The cap is applied before the self-join, which bounds the pairs a commit can give.
    """
    rows = changes.groupBy("commit").agg(F.collect_set("item").alias("items"), F.max(F.col("item").isNull().cast("int")).alias("bare"))
    n = F.size("items") + F.col("bare")  # a null item counts, but is in no pair
    sets = rows.where((n <= cap) & (n > 1)).select(F.sort_array("items").alias("items"))
    firsts = sets.select("items", F.posexplode("items").alias("i", "a"))
    both = firsts.select("a", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("b"))
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("co_changes"))


def coupling(changes: DataFrame, threshold: float = 0.3, min_co: int = 1, cap: int = 50) -> DataFrame:
    """(a, b, co_changes, strength): co-changes over the larger of both items' change counts, from ``threshold`` on.

    The totals count every commit, also those beyond the cap.
    """
    totals = changes.select("commit", "item").distinct().groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    a, b = totals.select(F.col("item").alias("a"), F.col("n").alias("na")), totals.select(F.col("item").alias("b"), F.col("n").alias("nb"))
    both = pairs(changes, cap).where(F.col("co_changes") >= min_co).join(a, "a").join(b, "b")
    return both.withColumn("strength", F.col("co_changes") / F.greatest("na", "nb")).where(F.col("strength") >= threshold).select("a", "b", "co_changes", "strength")


def partners(coupled: DataFrame, imports: DataFrame) -> DataFrame:
    """(node, partner, strength, co_changes, linked) in both directions; ``linked`` tells whether an edge (src, dst) joins them."""
    there = coupled.select(F.col("a").alias("node"), F.col("b").alias("partner"), "strength", "co_changes")
    back = coupled.select(F.col("b").alias("node"), F.col("a").alias("partner"), "strength", "co_changes")
    edges = imports.select(F.col("src").alias("node"), F.col("dst").alias("partner"))
    known = edges.union(imports.select(F.col("dst").alias("node"), F.col("src").alias("partner"))).distinct().withColumn("linked", F.lit(True))
    return there.union(back).join(known, ["node", "partner"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
