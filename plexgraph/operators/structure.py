"""Folders, files and what they contain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def folders(files: DataFrame) -> DataFrame:
    """(folder, parent): all folders above files (path); a folder at the top has a null parent."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    each = files.select("path").distinct().where(F.size(parts) > 1).select(F.explode(ups).alias("folder")).distinct()
    depth = F.size(F.split("folder", "/"))
    return each.select("folder", F.when(depth > 1, F.array_join(F.slice(F.split("folder", "/"), F.lit(1), depth - 1), "/")).alias("parent"))


def contains(files: DataFrame) -> DataFrame:
    """(src, dst): folder to folder and folder to file, by id."""
    tree = folders(files)
    up = tree.where("parent IS NOT NULL").select(F.concat(F.lit("folder:"), "parent", F.lit(":")).alias("src"), F.concat(F.lit("folder:"), "folder", F.lit(":")).alias("dst"))
    parts = F.split("path", "/")
    above = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    own = files.select("path").distinct().where(F.size(parts) > 1).select(F.concat(F.lit("folder:"), above, F.lit(":")).alias("src"), F.concat(F.lit("file:"), "path", F.lit(":")).alias("dst"))
    return up.union(own)
