"""The whole analysis of a source tree as one chain of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from time import perf_counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexgraph.operators import codegraph, components, coupling, deadcode, flows, structure
from plexgraph.session import settle
from plexgraph.sources.parsers import parsed


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    unresolved: DataFrame  # (path, module)
    parsed: DataFrame  # one row for each file
    timings: dict[str, float] = field(default_factory=dict)


def _extra_nodes(rows: DataFrame, label: str, like: DataFrame) -> DataFrame:
    """Rows (id, name) as nodes of a label with the columns of ``like``."""
    ord_ = F.struct(F.lit(99).cast("long").alias("rank"), F.col("id").alias("path"), F.lit(0).alias("pos"))
    known = {"id": F.col("id"), "name": F.col("name"), "label": F.lit(label), "ord": ord_}
    blank = {"string": F.lit(""), "bigint": F.lit(0), "boolean": F.lit(False)}
    return rows.select(*[known.get(c, blank.get(t, F.array())).cast(like.schema[c].dataType).alias(c) for c, t in like.dtypes])


def reparsed(files: DataFrame, before: DataFrame) -> DataFrame:
    """The parse results of ``files``; those of an earlier run serve for files whose content is the same."""
    same = before.join(files.select("path", "content", "language"), ["path", "content", "language"], "left_semi").select(*before.columns)
    new = files.join(before.select("path", "content", "language"), ["path", "content", "language"], "left_anti")
    return same.unionByName(parsed(new))


def analyze(files: DataFrame, history: DataFrame | None = None, rounds: int = 5, before: DataFrame | None = None) -> Graph:
    """Graph of files (path, content, language); ``history`` (commit, item) adds coupling of files.

    With the parse results of an earlier run in ``before``, only new and changed files are parsed; references are resolved
    for all, so the result is that of a full run.

    The order of steps matters: imports before calls, flows before dead code, communities before flows.
    """
    timings: dict[str, float] = {}
    began = perf_counter()

    def lap(name: str) -> None:
        nonlocal began
        timings[name] = perf_counter() - began
        began = perf_counter()

    source = settle(parsed(files) if before is None else reparsed(files, before))
    lap("parse")
    symbols = settle(codegraph.nodes(source))
    contains = codegraph.edges(structure.contains(source), "contains")
    defines = codegraph.defines(symbols)
    lap("structure")
    imports, unresolved = codegraph.import_edges(source)
    file = lambda c: codegraph.node_id(F.lit("file"), F.col(c), F.lit(""))
    imported = codegraph.edges(imports.select(file("path").alias("src"), file("imported").alias("dst"), F.array_join("symbols", ",").alias("symbols")), "imports")
    lap("imports")
    calls = settle(codegraph.call_edges(source, symbols, imports))
    lap("calls")
    rest = codegraph.rest_edges(source, symbols)
    heritage, protocols = codegraph.heritage_edges(source, symbols, imports)
    types = codegraph.type_edges(source, symbols, imports)
    # A route's edge stands in for a plain call between the same two.
    calls = settle(calls.join(rest.select("src", "dst"), ["src", "dst"], "left_anti").select(*calls.columns).union(rest))
    lap("types")
    marked = symbols.drop("is_protocol").join(protocols.withColumn("is_protocol", F.lit(True)), "id", "left").withColumn("is_protocol", F.coalesce("is_protocol", F.lit(False)))
    community = settle(components.communities(calls, rounds))
    sizes = community.groupBy("community").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    community = settle(community.join(sizes, "community", "left_semi").select("node", "community"))
    parents = symbols.select(F.col("id").alias("node"), F.coalesce(F.try_element_at(F.split("file_path", "/"), F.lit(-2)), F.lit("")).alias("group"), F.col("ord").alias("ord"))
    names = components.community_names(community, parents).select(F.concat(F.lit("community:"), "community", F.lit(":")).alias("id"), "name")
    member_of = codegraph.edges(community.select(F.col("node").alias("src"), F.concat(F.lit("community:"), "community", F.lit(":")).alias("dst")), "member_of")
    lap("communities")
    entries = settle(deadcode.entry_points(marked, calls))
    traced = flows.trace(calls.select("src", "dst", "confidence"), entries.select(F.col("id").alias("entry"))).join(symbols.select(F.col("id").alias("entry"), "ord"), "entry")
    kept = settle(flows.distinct_flows(settle(traced)))
    process, steps = flows.processes(kept, symbols, community)
    in_process = codegraph.edges(steps, "step_in_process")
    lap("flows")
    marked = settle(marked.drop("is_entry_point").join(entries.withColumn("is_entry_point", F.lit(True)), "id", "left").withColumn("is_entry_point", F.coalesce("is_entry_point", F.lit(False))).select(*symbols.columns))
    edges = calls.unionByName(heritage).unionByName(types)
    dead = deadcode.dead(marked, edges)
    marked = marked.drop("is_dead").join(dead.withColumn("is_dead", F.lit(True)), "id", "left").withColumn("is_dead", F.coalesce("is_dead", F.lit(False))).select(*symbols.columns)
    lap("dead_code")
    parts = [contains, defines, imported, edges, member_of, in_process]
    if history is not None:
        known = history.join(source.select(F.col("path").alias("item")), "item", "left_semi")
        pairs = coupling.coupling(known).select(file("a").alias("src"), file("b").alias("dst"), "strength", "co_changes")
        parts.append(codegraph.edges(pairs, "coupled_with"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    nodes = codegraph.file_nodes(source).unionByName(marked).unionByName(_extra_nodes(names, "community", marked)).unionByName(_extra_nodes(process.select("id", "name"), "process", marked))
    out = Graph(settle(nodes), settle(every), settle(unresolved), source, timings)
    lap("write")
    return out
