"""Keeping a graph current: manifests, plans, and deltas that equal a full rebuild."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexgraph.operators import changes


def symbol_manifest(nodes: DataFrame) -> DataFrame:
    """(path, symbol, identity, body) of symbol nodes."""
    s = nodes.where(~F.col("label").isin("file", "folder", "community", "process"))
    identity = changes.identity(F.col("name"), F.col("label"), F.col("class_name"), F.col("signature"), F.col("is_exported"))
    return s.select(F.col("file_path").alias("path"), F.col("id").alias("symbol"), identity.alias("identity"), F.sha2("content", 256).alias("body"))


def build_manifest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, sha, language, symbols, out_edges): one row for each file, with its symbols' fingerprints and outgoing edges."""
    files = nodes.where("label = 'file'").select(F.col("file_path").alias("path"), F.sha2("content", 256).alias("sha"), "language")
    symbols = symbol_manifest(nodes).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("symbol", "identity", "body"))).alias("symbols"))
    owner = nodes.select(F.col("id").alias("src"), F.col("file_path").alias("path"))
    kept = edges.where(~F.col("rel_type").isin("member_of", "step_in_process", "contains"))
    out = kept.join(owner, "src").groupBy("path").agg(F.sort_array(F.collect_set(F.struct("rel_type", "src", "dst"))).alias("out_edges"))
    return files.join(symbols, "path", "left").join(out, "path", "left")


def importable_names(path: Column) -> Column:
    """All names by which a file may be imported: each suffix of its path, with slashes and with dots, without its extension or index file."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.[^./]+$", ""), r"/(__init__|index)$", "")
    parts = F.split(bare, "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.slice(parts, k, F.size(parts)))
    return F.array_distinct(F.flatten(F.transform(tails, lambda t: F.array(F.array_join(t, "/"), F.array_join(t, ".")))))


@dataclass
class Plan:
    changed: DataFrame  # (path, state)
    rebuild: DataFrame  # (path): files to resolve again
    file_ratio: float
    symbol_ratio: float
    verdict: str


def plan(old_nodes: DataFrame, old_edges: DataFrame, new_files: DataFrame, new_symbols: DataFrame, unresolved: DataFrame, intact: bool = True) -> Plan:
    """What an update has to do.

    ``new_files`` has (path, sha), ``new_symbols`` (path, symbol, identity, body), ``unresolved`` (path, module) imports that
    met no file. To be resolved again: changed and added files, files with edges into symbols whose identity changed or that
    went, and files with an unresolved import of an added file. A change of bodies alone draws in no other file.
    """
    spark = old_nodes.sparkSession
    old_files = old_nodes.where("label = 'file'").select(F.col("file_path").alias("path"), F.sha2("content", 256).alias("sha"))
    states = changes.manifest_diff(old_files, new_files)
    symbols = changes.symbol_diff(symbol_manifest(old_nodes), new_symbols)
    moved = symbols.where("state IN ('identity_changed', 'removed')").select(F.col("symbol").alias("dst"))
    owner = old_nodes.select(F.col("id").alias("src"), F.col("file_path").alias("path"))
    into = old_edges.join(moved, "dst", "left_semi").join(owner, "src").select("path")
    deleted = states.where("state = 'deleted'").select("path")
    to_files = old_edges.where("rel_type = 'imports'").join(deleted.select(F.concat(F.lit("file:"), "path", F.lit(":")).alias("dst")), "dst", "left_semi").join(owner, "src").select("path")
    added = states.where("state = 'added'").select(F.explode(importable_names(F.col("path"))).alias("module"))
    waiting = unresolved.withColumn("module", F.regexp_replace("module", r"^[./]+", "")).join(added, "module", "left_semi").select("path")
    own = states.where("state IN ('added', 'changed')").select("path")
    rebuild = own.union(into).union(to_files).union(waiting).distinct().join(deleted, "path", "left_anti")
    n_files, n_changed = states.agg(F.count(F.lit(1)), F.count_if(F.col("state") != "unchanged")).first()
    n_symbols = max(new_symbols.count(), 1)
    file_ratio, symbol_ratio = n_changed / max(n_files, 1), symbols.count() / n_symbols
    yes = F.lit(True)
    verdict = spark.range(1).select(changes.verdict(yes, yes, F.lit(intact), F.lit(file_ratio), F.lit(symbol_ratio))).first()[0]
    return Plan(states, rebuild, file_ratio, symbol_ratio, verdict)


def delta(old_nodes: DataFrame, old_edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(edges_remove, nodes_remove, nodes_upsert, edges_add) that turn the old tables into the new ones."""
    gone = old_nodes.join(new_nodes.select("id"), "id", "left_anti").select("id")
    fields = [c for c in new_nodes.columns if c != "id"]
    changed = changes.diff(old_nodes, new_nodes, "id", fields).where("change <> 'removed'").select("id")
    keys = ["src", "dst", "rel_type"]
    return old_edges.join(new_edges.select(*keys), keys, "left_anti").select(*keys).distinct(), gone, new_nodes.join(changed, "id", "left_semi"), new_edges.exceptAll(old_edges)
