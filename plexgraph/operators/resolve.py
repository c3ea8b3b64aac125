"""Resolving references to definitions by ordered tiers, nearest paths and longest suffixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: More namesakes than this and a name alone says nothing.
MOST = 5


def folder(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def shared_depth(a: Column, b: Column) -> Column:
    """Number of leading elements that two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("long")


def nearest(refs: DataFrame, defs: DataFrame, most: int = MOST) -> DataFrame:
    """(ref, target): of the definitions (target, name, path, ord) with the reference's (ref, name, path) name, that with
    the longest common folder, then the shortest path, then the first. Names with more than ``most`` definitions resolve
    to nothing; they are dropped before the join."""
    n = defs.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most)
    few = defs.join(n, "name").select("name", "target", F.col("path").alias("dpath"), "ord")
    both = refs.join(few, "name")
    order = F.struct((-shared_depth(folder(F.col("path")), folder(F.col("dpath")))).alias("a"), F.length("dpath").alias("b"), "ord")
    return both.groupBy("ref").agg(F.min_by("target", order).alias("target"))


def tiered(refs: DataFrame, defs: DataFrame, imports: DataFrame, most: int = MOST) -> DataFrame:
    """(ref, target, confidence, tier) of references (ref, name, path) to definitions (target, name, path, ord).

    Tier 1: the first definition in the same file, confidence 1. Tier 2: the first in a file that the reference's file
    imports (``imports``: path, imported, symbols; an empty list or ``*`` imports all names), confidence 1. Tier 3: the
    nearest of at most ``most``, confidence 0.5. A reference without any has no row.
    """
    d = defs.select("name", "target", F.col("path").alias("dpath"), "ord")
    same = refs.join(d, "name").where("path = dpath").groupBy("ref").agg(F.min_by("target", "ord").alias("target")).withColumn("tier", F.lit(1))
    through = refs.join(imports, "path").where((F.size("symbols") == 0) | F.array_contains("symbols", F.col("name")) | F.array_contains("symbols", F.lit("*")))
    linked = through.select("ref", "name", F.col("imported").alias("dpath")).distinct().join(d, ["name", "dpath"]).groupBy("ref").agg(F.min_by("target", "ord").alias("target")).withColumn("tier", F.lit(2))
    far = nearest(refs, defs, most).withColumn("tier", F.lit(3))
    best = same.unionByName(linked).unionByName(far).groupBy("ref").agg(F.min(F.struct("tier", "target")).alias("b"))
    return best.select("ref", F.col("b.target").alias("target"), F.when(F.col("b.tier") <= 2, 1.0).otherwise(0.5).alias("confidence"), F.col("b.tier").alias("tier"))


def longest_suffix(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """(ref, folder): of the folders (folder), the longest that is a suffix of a reference's path (ref, path), by whole segments."""
    parts = F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct((F.size(parts) - k + 1).alias("n"), F.array_join(F.slice(parts, k, F.size(parts)), "/").alias("folder")))
    each = paths.select("ref", F.explode(tails).alias("t")).select("ref", "t.n", "t.folder")
    return each.join(folders.select("folder").distinct(), "folder").groupBy("ref").agg(F.max_by("folder", "n").alias("folder"))


def first_candidate(refs: DataFrame, known: DataFrame) -> DataFrame:
    """(ref, target): the first of a reference's candidate paths (ref, candidates ARRAY) that exists (``known``: path)."""
    each = refs.select("ref", F.posexplode("candidates").alias("rank", "path"))
    return each.join(known.select("path").distinct(), "path").groupBy("ref").agg(F.min_by("path", "rank").alias("target"))


def first_wins(edges: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the first in order."""
    w = Window.partitionBy(*keys).orderBy(order)
    return edges.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
