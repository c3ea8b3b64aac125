"""Breadth-first traversal in bounded DataFrame loops.

A level joins the frontier with the edges and drops visited nodes by anti-join. Frontiers are written to the shared
folder, so their size is known and small ones are broadcast by the optimizer; large ones are joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexgraph.operators.lookup import depth_tag
from plexgraph.session import settle


def _oriented(edges: DataFrame, direction: str) -> DataFrame:
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    return edges.select(F.col(a).alias("node"), F.col(b).alias("next")).where("node <> next").distinct()


def reach(edges: DataFrame, roots: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """(root, node, depth): nodes within ``depth`` hops of each root (column ``root``), without the roots themselves."""
    hops = settle(_oriented(edges, direction))
    frontier = settle(roots.select("root", F.col("root").alias("node")).distinct())
    seen, out = frontier, None
    for level in range(1, depth + 1):
        found = frontier.join(hops, "node").select("root", F.col("next").alias("node")).distinct()
        frontier = settle(found.join(seen, ["root", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
        rows = frontier.withColumn("depth", F.lit(level))
        out = rows if out is None else out.union(rows)
    return frontier.withColumn("depth", F.lit(0)).limit(0) if out is None else out


def impact(edges: DataFrame, root: str, depth: int = 3) -> DataFrame:
    """(node, depth, tag, confidence): callers of a node; the confidence is that of the direct edge, if there is one."""
    depth = max(1, min(10, depth))
    roots = edges.sparkSession.createDataFrame([(root,)], "root string")
    found = reach(edges, roots, depth, "in").select("node", "depth")
    direct = edges.where(F.col("dst") == root).groupBy(F.col("src").alias("node")).agg(F.max("confidence").alias("confidence"))
    return found.join(direct, "node", "left").select("node", "depth", depth_tag(F.col("depth")).alias("tag"), "confidence")


def path(edges: DataFrame, source: str, target: str, max_depth: int = 10) -> DataFrame:
    """(path, hops): a shortest path; of several, the first by node ids. No row if there is none."""
    hops = settle(_oriented(edges, "out"))
    frontier = settle(edges.sparkSession.createDataFrame([(source, [source])], "node string, path array<string>"))
    seen = frontier.select("node")
    for _ in range(max_depth):
        grown = frontier.join(hops, "node").select(F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))
        best = grown.join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path"))
        frontier = settle(best)
        hit = frontier.where(F.col("node") == target)
        if not hit.isEmpty():
            return hit.select("path", (F.size("path") - 1).cast("long").alias("hops"))
        if frontier.isEmpty():
            break
        seen = settle(seen.union(frontier.select("node")))
    return frontier.limit(0).select("path", F.size("path").cast("long").alias("hops"))
