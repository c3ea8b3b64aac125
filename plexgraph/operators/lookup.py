"""Lookups over nodes (id, label, name, file_path, ...) and edges (src, dst, rel_type, confidence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEPTH_NAMES = {1: "direct", 2: "indirect"}


def label_of(node_id: Column) -> Column:
    return F.split_part(node_id, F.lit(":"), F.lit(1))


def get_node(nodes: DataFrame, node_id: str) -> DataFrame:
    """The node of an id; the label in the id prunes partitions."""
    return nodes.where((F.col("label") == node_id.split(":", 1)[0]) & (F.col("id") == node_id))


def exact_name(nodes: DataFrame, name: str, limit: int = 5) -> DataFrame:
    """(id, score): nodes of a name, ``limit`` of each label by id, those under a ``/tests/`` folder with half the score."""
    hit = nodes.where(F.col("name") == name)
    per_label = hit.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("id"))).where(F.col("r") <= limit)
    score = F.when(F.contains("file_path", F.lit("/tests/")), 1.0).otherwise(2.0)
    return per_label.select("id", "name", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def resolve(nodes: DataFrame, name: str, ranked: DataFrame) -> DataFrame:
    """The best exact match, else the first of ``ranked`` (id, score)."""
    tiers = exact_name(nodes, name, 1).select("id", F.lit(0).alias("tier"), "score").union(ranked.select("id", F.lit(1), "score"))
    return tiers.orderBy("tier", F.desc("score"), "id").limit(1).select("id")


def confidence_tag(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "certain").when(confidence >= 0.5, "likely").otherwise("weak")


def depth_tag(depth: Column) -> Column:
    out = F.lit("transitive")
    for k, name in DEPTH_NAMES.items():
        out = F.when(depth == k, name).otherwise(out)
    return out


def neighbours(nodes: DataFrame, edges: DataFrame, direction: str = "out") -> DataFrame:
    """(node, neighbour, name, confidence, tag): one hop along edges; a missing confidence is 1."""
    here, there = ("src", "dst") if direction == "out" else ("dst", "src")
    hop = edges.select(F.col(here).alias("node"), F.col(there).alias("id"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"))
    named = hop.join(nodes.select("id", "name"), "id")
    return named.select("node", F.col("id").alias("neighbour"), "name", "confidence", confidence_tag(F.col("confidence")).alias("tag"))


def counts(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def memberships(edges: DataFrame, rel_type: str = "step_in_process") -> DataFrame:
    """(node, owner): each node's first owner along edges of a kind."""
    return edges.where(F.col("rel_type") == rel_type).groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("owner"))


def spanning(members: DataFrame, communities: DataFrame) -> DataFrame:
    """(owner, n_communities): owners (node, owner) whose nodes lie in more than one community (node, community)."""
    return members.join(communities, "node").groupBy("owner").agg(F.count_distinct("community").alias("n_communities")).where("n_communities > 1")


def risk(entry_points: Column, missing: Column, dependants: Column, n_communities: Column) -> tuple[Column, Column]:
    """Score of at most 10, and its level."""
    raw = entry_points + missing + F.floor(dependants / 10) + F.when(n_communities > 1, 2).otherwise(0)
    score = F.least(raw, F.lit(10)).cast("long")
    return score, F.when(score <= 3, "LOW").when(score <= 6, "MEDIUM").otherwise("HIGH")
