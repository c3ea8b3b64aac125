"""Matching client URLs with server routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PLACEHOLDERS = (r"\{[^}]+\}", r":([a-zA-Z_][a-zA-Z0-9_]*)", r"<[^>]+>")


def _bare(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def normalised(url: Column) -> Column:
    """A route with its parameters, in any of three notations, as ``{param}``."""
    out = _bare(url)
    for p in _PLACEHOLDERS:
        out = F.regexp_replace(out, p, "{param}")
    return out


def called(url: Column) -> Column:
    """A client's URL without scheme and host, interpolations as ``{param}``."""
    bare = _bare(url)
    rest = F.substring_index(bare, "://", -1)
    at = F.locate("/", rest)
    path = F.when(F.locate("://", bare) == 0, bare).when(at > 0, F.substr(rest, at)).otherwise(F.lit("/"))
    return F.regexp_replace(path, r"\{[^}]*\}", "{param}")


def links(routes: DataFrame, calls: DataFrame) -> DataFrame:
    """(route, call, confidence) of routes (route, url, method) and calls (call, url, method) that match.

    1 for equal URLs, 0.9 for equal normalised ones, 0.5 if one is a prefix of the other; 0.1 more, up to 1, for equal
    methods. Methods must agree, but a ``get`` call may meet any route. Both sides explode their prefixes, so that all
    matches are equi-joins.
    """
    r = routes.select("route", _bare(F.col("url")).alias("ru"), normalised(F.col("url")).alias("rn"), F.lower("method").alias("rm"))
    c = calls.select("call", called(F.col("url")).alias("cu"), F.lower("method").alias("cm")).withColumn("cn", normalised(F.col("cu")))
    prefixes = lambda s: F.transform(F.sequence(F.lit(0), F.length(s)), lambda k: F.substring(s, F.lit(1), k))
    down = c.withColumn("key", F.explode(prefixes(F.col("cn")))).join(r.withColumn("key", F.col("rn")), "key")
    up = r.withColumn("key", F.explode(prefixes(F.col("rn")))).join(c.withColumn("key", F.col("cn")), "key")
    cols = ["route", "call", "ru", "rn", "rm", "cu", "cn", "cm"]
    both = down.select(*cols).union(up.select(*cols)).distinct()
    base = F.when(F.col("ru") == F.col("cu"), 1.0).when(F.col("rn") == F.col("cn"), 0.9).otherwise(0.5)
    fits = both.where((F.col("rm") == F.col("cm")) | (F.col("cm") == "get"))
    return fits.select("route", "call", F.least(F.lit(1.0), base + F.when(F.col("rm") == F.col("cm"), 0.1).otherwise(0.0)).alias("confidence"))
