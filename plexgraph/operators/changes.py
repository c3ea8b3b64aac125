"""Comparing snapshots, manifests, and applying deltas to node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILE_RATIO, SYMBOL_RATIO = 0.30, 0.40


def diff(base: DataFrame, now: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change): ``added``, ``removed`` or ``modified`` between two snapshots; equal rows are left out."""
    a = base.select(F.col(key).alias("k1"), F.xxhash64(*[F.col(f) for f in fields]).alias("h1"), F.struct(*fields).alias("v1"))
    b = now.select(F.col(key).alias("k2"), F.xxhash64(*[F.col(f) for f in fields]).alias("h2"), F.struct(*fields).alias("v2"))
    both = a.join(b, F.col("k1") == F.col("k2"), "full_outer")
    same = F.col("v1").eqNullSafe(F.col("v2"))
    change = F.when(F.col("k1").isNull(), "added").when(F.col("k2").isNull(), "removed").when(~same, "modified")
    return both.select(F.coalesce("k1", "k2").alias(key), change.alias("change")).where("change IS NOT NULL")


def manifest(rows: DataFrame, path: str, content: Column) -> DataFrame:
    """(path, sha): the SHA-256 of each path's content."""
    return rows.select(F.col(path).alias("path"), F.sha2(content, 256).alias("sha"))


def manifest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, state) of manifests (path, sha): added, deleted, changed or unchanged."""
    a, b = before.select("path", F.col("sha").alias("s1")), after.select("path", F.col("sha").alias("s2"))
    state = F.when(F.col("s1").isNull(), "added").when(F.col("s2").isNull(), "deleted").when(F.col("s1") != F.col("s2"), "changed").otherwise("unchanged")
    return a.join(b, "path", "full_outer").select("path", state.alias("state"))


def symbol_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, symbol, state) of symbols (path, symbol, identity, body): added, removed, identity_changed or body_only."""
    a = before.select("path", "symbol", F.col("identity").alias("i1"), F.col("body").alias("b1"))
    b = after.select("path", "symbol", F.col("identity").alias("i2"), F.col("body").alias("b2"))
    state = F.when(F.col("i1").isNull(), "added").when(F.col("i2").isNull(), "removed").when(F.col("i1") != F.col("i2"), "identity_changed").when(F.col("b1") != F.col("b2"), "body_only")
    return a.join(b, ["path", "symbol"], "full_outer").select("path", "symbol", state.alias("state")).where("state IS NOT NULL")


def identity(*fields: Column) -> Column:
    """Fingerprint of a symbol's identity; null and empty fields are alike."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


def fingerprint(files: DataFrame) -> DataFrame:
    """(fingerprint): SHA-256 over the files (path, sha) in order of path.

    Files are hashed first by the first two digits of their path's hash, so no task holds all of them; the 256 sums are
    then hashed in order.
    """
    group = F.substring(F.sha2("path", 256), 1, 2)
    line = F.concat("path", F.lit("\0"), "sha", F.lit("\0"))
    each = files.groupBy(group.alias("g")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), ""), 256).alias("h"))
    return each.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "h"))), lambda x: F.concat(x["g"], x["h"])), ""), 256).alias("fingerprint"))


def dependants(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """(path): files with an edge (src_path, dst_path) into a changed file, which are not changed themselves."""
    into = edges.join(changed.select(F.col("path").alias("dst_path")), "dst_path", "left_semi").select(F.col("src_path").alias("path")).distinct()
    return into.join(changed.select("path"), "path", "left_anti")


def verdict(has_manifest: Column, version_ok: Column, intact: Column, file_ratio: Column, symbol_ratio: Column) -> Column:
    """Whether an incremental update may run; the first reason against it otherwise."""
    return (
        F.when(~has_manifest, "no_manifest")
        .when(~version_ok, "version_mismatch")
        .when(~intact, "corrupt")
        .when(file_ratio > FILE_RATIO, "file_ratio")
        .when(symbol_ratio > SYMBOL_RATIO, "symbol_ratio")
        .otherwise("incremental")
    )


def consolidate(head_moved: Column, ratio: Column, applies: Column, seconds: Column) -> Column:
    """Whether pending deltas should be folded into a full rebuild, and why."""
    return F.when(head_moved, "head_moved").when(ratio > 0.12, "ratio").when(applies >= 50, "applies").when(seconds >= 600, "age").otherwise("keep")


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with the rows of ``new`` in place of those with the same keys. Keys of ``new`` must be unique."""
    return base.join(new.select(*keys), keys, "left_anti").select(*base.columns).unionByName(new.select(*base.columns))


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the last in order."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("v"))
    return best.select(*keys, *[F.col("v").getField(c).alias(c) for c in others]).select(*rows.columns)


EDGE_KEY = ["src", "dst", "rel_type", "role", "step_number"]


def apply_delta(nodes: DataFrame, edges: DataFrame, edges_remove: DataFrame, nodes_remove: DataFrame, nodes_upsert: DataFrame, edges_add: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after a delta, in this order: edges out, nodes out with their edges, nodes in, edges in.

    ``edges_remove`` has (src, dst, rel_type), ``nodes_remove`` (id). Added edges need both ends.
    """
    edges = edges.join(edges_remove.select("src", "dst", "rel_type"), ["src", "dst", "rel_type"], "left_anti").select(*edges.columns)
    gone = nodes_remove.select("id")
    nodes = nodes.join(gone, "id", "left_anti").select(*nodes.columns)
    for end in ("src", "dst"):
        edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti").select(*edges.columns)
    nodes = upsert(nodes, nodes_upsert, ["id"])
    added = edges_add
    for end in ("src", "dst"):
        added = added.join(nodes.select(F.col("id").alias(end)), end, "left_semi").select(*edges.columns)
    keys = [k for k in EDGE_KEY if k in edges.columns]
    blank = lambda d: d.withColumns({f"__{k}": F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys})
    marks = [f"__{k}" for k in keys]
    kept = blank(edges).join(blank(added).select(*marks), marks, "left_anti").select(*edges.columns)
    return nodes, kept.unionByName(added.select(*edges.columns))


def remove_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes of files (path) and their edges."""
    gone = nodes.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("id")
    left = nodes.join(gone, "id", "left_anti").select(*nodes.columns)
    for end in ("src", "dst"):
        edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti").select(*edges.columns)
    return left, edges
