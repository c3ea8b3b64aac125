"""Questions about a graph, each answered by one DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexgraph.functions.predicates import is_test_file
from plexgraph.operators import components, coupling, intervals, lookup, search, traverse


class Tools:
    """Over nodes and edges with the columns that ``analyze`` gives."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, embeddings: DataFrame | None = None):
        self.nodes, self.edges, self.embeddings = nodes, edges, embeddings
        self.calls = edges.where("rel_type = 'calls'").select("src", "dst", F.coalesce("confidence", F.lit(1.0)).alias("confidence"))

    def resolve(self, name: str) -> str | None:
        row = lookup.resolve(self.nodes, name, self.text_search(name, 1)).first()
        return row["id"] if row else None

    def _text(self) -> DataFrame:
        some = self.nodes.where(~F.col("label").isin("folder", "community", "process"))
        return some.select("id", "label", "file_path", F.concat_ws(" ", "name", "content", "signature").alias("text"))

    def text_search(self, query: str, limit: int = 20) -> DataFrame:
        """(id, score) by BM25 per label; tests count half, functions and classes elsewhere 1.2 times."""
        found = search.bm25(self._text(), query, "id", "text", "label").join(self.nodes.select("id", "file_path"), "id")
        test = F.contains("file_path", F.lit("/tests/"))
        boost = F.when(test, 0.5).when(F.col("group").isin("function", "class"), 1.2).otherwise(1.0)
        return search.top_per_group(found, limit, boost).select("id", "score")

    def query(self, text: str, limit: int = 20, focus_files: list[str] | None = None, vector: list[float] | None = None) -> DataFrame:
        """(id, name, label, file_path, score, owner): fused search, biased towards focus files, with the flow each hit is in."""
        limit = max(1, min(100, limit))
        fts = search.with_fallback(self.text_search(text, 3 * limit), search.fuzzy(self.nodes, text, 3 * limit).select("id", "score"))
        lists = [(fts, 1.0)]
        if vector is not None and self.embeddings is not None:
            lists.append((search.vectors(self.embeddings, vector, 3 * limit).join(self.nodes.select("id"), "id", "left_semi"), 1.0))
        fused = search.fuse(lists)
        if focus_files:
            focus = self.nodes.where(F.col("file_path").isin(focus_files)).select(F.col("id").alias("node"))
            links = self.edges.where("rel_type IN ('calls', 'imports', 'uses_type')").select("src", "dst")
            fused = search.biased(fused, components.pagerank(links, focus))
        owners = lookup.memberships(self.edges).withColumnRenamed("node", "id")
        shown = fused.join(self.nodes.select("id", "name", "label", "file_path"), "id").join(owners, "id", "left")
        return shown.orderBy(F.desc("score"), "id").limit(limit)

    def context(self, name: str) -> DataFrame:
        """(kind, id, name, confidence): callers, callees, types, parents, community and flows of a symbol."""
        node = self.resolve(name)
        e = self.edges
        names = self.nodes.select("id", "name")
        hops = [("caller", "calls", "dst", "src"), ("callee", "calls", "src", "dst"), ("type", "uses_type", "src", "dst"), ("parent", "extends", "src", "dst"), ("child", "extends", "dst", "src"), ("community", "member_of", "src", "dst"), ("process", "step_in_process", "src", "dst")]
        out = None
        for kind, rel, here, there in hops:
            rows = e.where((F.col("rel_type") == rel) & (F.col(here) == node)).select(F.lit(kind).alias("kind"), F.col(there).alias("id"), "confidence")
            out = rows if out is None else out.union(rows)
        return out.join(names, "id", "left").select("kind", "id", "name", "confidence").distinct()

    def file_context(self, path: str) -> DataFrame:
        """(kind, id, name): a file's symbols, imports, importers, coupled files and dead symbols."""
        own = self.nodes.where(F.col("file_path") == path)
        symbols = own.where(~F.col("label").isin("file", "folder")).select(F.lit("symbol").alias("kind"), "id", "name")
        dead = own.where("is_dead").select(F.lit("dead").alias("kind"), "id", "name")
        file, names = f"file:{path}:", self.nodes.select("id", "name")
        out = symbols.union(dead)
        for kind, rel, here, there in [("imports", "imports", "src", "dst"), ("importer", "imports", "dst", "src"), ("coupled", "coupled_with", "src", "dst"), ("coupled", "coupled_with", "dst", "src")]:
            rows = self.edges.where((F.col("rel_type") == rel) & (F.col(here) == file)).select(F.lit(kind).alias("kind"), F.col(there).alias("id"))
            out = out.union(rows.join(names, "id").select("kind", "id", "name"))
        return out

    def file_communities(self, path: str) -> DataFrame:
        """(community, name, n): communities of a file's symbols, those with most of them first."""
        own = self.nodes.where(F.col("file_path") == path).select(F.col("id").alias("src"))
        n = self.edges.where("rel_type = 'member_of'").join(own, "src", "left_semi").groupBy(F.col("dst").alias("community")).agg(F.count(F.lit(1)).alias("n"))
        return n.join(self.nodes.select(F.col("id").alias("community"), "name"), "community", "left").select("community", "name", "n").orderBy(F.desc("n"), "community")

    def near(self, name: str, focus_files: list[str], direction: str = "out") -> DataFrame:
        """(id, name, confidence, rank): callees or callers of a symbol, those nearest to the focus files by PageRank first, then the surest."""
        here, there = ("src", "dst") if direction == "out" else ("dst", "src")
        rows = self.calls.where(F.col(here) == self.resolve(name)).groupBy(F.col(there).alias("id")).agg(F.max("confidence").alias("confidence"))
        focus = self.nodes.where(F.col("file_path").isin(focus_files)).select(F.col("id").alias("node"))
        links = self.edges.where("rel_type IN ('calls', 'imports', 'uses_type')").select("src", "dst")
        ranks = components.pagerank(links, focus).withColumnRenamed("node", "id")
        shown = rows.join(ranks, "id", "left").join(self.nodes.select("id", "name"), "id")
        return shown.select("id", "name", "confidence", F.coalesce("rank", F.lit(0.0)).alias("rank")).orderBy(F.desc("rank"), F.desc("confidence"), "id")

    def explain(self, name: str) -> DataFrame:
        """One row about a symbol: its place, marks, and numbers of callers and callees."""
        node = self.resolve(name)
        n = self.edges.agg(F.count_if((F.col("rel_type") == "calls") & (F.col("dst") == node)).alias("callers"), F.count_if((F.col("rel_type") == "calls") & (F.col("src") == node)).alias("callees"))
        return self.nodes.where(F.col("id") == node).select("id", "label", "name", "file_path", "start_line", "signature", "is_dead", "is_entry_point", "is_exported").crossJoin(F.broadcast(n))  # one row each

    def impact(self, name: str, depth: int = 3) -> DataFrame:
        return traverse.impact(self.calls, self.resolve(name) or "", depth)

    def call_path(self, source: str, target: str, max_depth: int = 10) -> DataFrame:
        return traverse.path(self.calls, self.resolve(source) or "", self.resolve(target) or "", max_depth)

    def cycles(self, min_size: int = 2) -> DataFrame:
        """(component, size, severity, nodes) of cycles among functions, methods and classes."""
        found = components.strong_components(self.calls, min_size).groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sort_array(F.collect_list("node")).alias("nodes"))
        return found.select("component", "size", F.when(F.col("size") >= 5, "CRITICAL").otherwise("WARNING").alias("severity"), "nodes").orderBy(F.desc("size"), "component")

    def communities(self) -> DataFrame:
        """(community, name, size, cohesion)."""
        members = self.edges.where("rel_type = 'member_of'").select(F.col("src").alias("node"), F.col("dst").alias("community"))
        sums = components.cohesion(self.calls, members)
        return sums.join(self.nodes.select(F.col("id").alias("community"), "name"), "community", "left")

    def cross_community(self) -> DataFrame:
        """(owner, n_communities) of flows over more than one community."""
        members = self.edges.where("rel_type = 'step_in_process'").select(F.col("src").alias("node"), F.col("dst").alias("owner"))
        return lookup.spanning(members, self.edges.where("rel_type = 'member_of'").select(F.col("src").alias("node"), F.col("dst").alias("community")))

    def coupled(self, path: str) -> DataFrame:
        pairs = self.edges.where("rel_type = 'coupled_with'").select(F.col("src").alias("a"), F.col("dst").alias("b"), "strength", "co_changes")
        found = coupling.partners(pairs, self.edges.where("rel_type = 'imports'").select("src", "dst"))
        return found.where(F.col("node") == f"file:{path}:").orderBy(F.desc("strength"), "partner")

    def dead_code(self) -> DataFrame:
        return self.nodes.where("is_dead").select("id", "label", "name", "file_path", "start_line").orderBy("file_path", "start_line", "id")

    def overview(self) -> DataFrame:
        """(what, key, n): nodes by label and edges by kind."""
        a = lookup.counts(self.nodes, "label").select(F.lit("node").alias("what"), F.col("label").alias("key"), "n")
        return a.union(lookup.counts(self.edges, "rel_type").select(F.lit("edge"), "rel_type", "n")).orderBy("what", F.desc("n"), "key")

    def changed_symbols(self, hunks: DataFrame) -> DataFrame:
        """Symbols that overlap hunks (file, start, stop)."""
        spans = self.nodes.where(~F.col("label").isin("file", "folder", "community", "process")).select("id", "name", "label", F.col("file_path").alias("key"), F.col("start_line").alias("start"), F.col("end_line").alias("stop"))
        return intervals.overlapping(spans, hunks.withColumnRenamed("file", "key"))

    def test_impact(self, ids: DataFrame, depth: int = 4) -> DataFrame:
        """(root, test, depth, near): tests that reach the changed symbols (id)."""
        found = traverse.reach(self.calls, ids.select(F.col("id").alias("root")), depth, "in")
        tests = self.nodes.where(is_test_file(F.col("file_path")) | F.startswith("name", F.lit("test_"))).select(F.col("id").alias("node"))
        return found.join(tests, "node", "left_semi").select("root", F.col("node").alias("test"), "depth", (F.col("depth") <= 2).alias("near"))

    def review_risk(self, hunks: DataFrame) -> DataFrame:
        """(score, level, ...): risk of a change from its entry points, callers outside it, missing coupled files and communities."""
        touched = self.changed_symbols(hunks).select("id", F.col("key").alias("path"))
        entries = self.nodes.where("is_entry_point").join(touched, "id", "left_semi").agg(F.count(F.lit(1)).alias("entry_points"))
        callers = self.calls.join(touched.select(F.col("id").alias("dst")), "dst", "left_semi").join(touched.select(F.col("id").alias("src")), "src", "left_anti").agg(F.count_distinct("src").alias("dependants"))
        files = hunks.select(F.concat(F.lit("file:"), "file", F.lit(":")).alias("node")).distinct()
        pairs = self.edges.where("rel_type = 'coupled_with'")
        other = pairs.select(F.col("src").alias("node"), F.col("dst").alias("partner")).union(pairs.select("dst", "src"))
        missing = other.join(files, "node", "left_semi").join(files.withColumnRenamed("node", "partner"), "partner", "left_anti").agg(F.count_distinct("partner").alias("missing"))
        groups = self.edges.where("rel_type = 'member_of'").join(touched.select(F.col("id").alias("src")), "src", "left_semi").agg(F.count_distinct("dst").alias("communities"))
        row = entries.crossJoin(callers).crossJoin(missing).crossJoin(groups)  # one row each
        score, level = lookup.risk(F.col("entry_points"), F.col("missing"), F.col("dependants"), F.col("communities"))
        return row.select(score.alias("score"), level.alias("level"), "entry_points", "dependants", "missing", "communities")

    def export(self, name: str, depth: int = 2, include_source: bool = False) -> DataFrame:
        """(id, depth, name, file_path, signature, content): a symbol with what it calls, for use elsewhere."""
        node = self.resolve(name) or ""
        spark = self.nodes.sparkSession
        roots = spark.createDataFrame([(node,)], "root string")
        found = traverse.reach(self.calls, roots, max(1, min(4, depth))).select(F.col("node").alias("id"), "depth")
        rows = found.union(roots.select(F.col("root").alias("id"), F.lit(0).alias("depth")))
        content = F.col("content") if include_source else F.lit("")
        return rows.join(self.nodes, "id").select("id", "depth", "name", "file_path", "signature", content.alias("content")).orderBy("depth", "id")

    def sql(self, text: str) -> DataFrame:
        """A read-only SQL query over the views ``nodes`` and ``edges``."""
        from plexgraph.functions.questions import is_read_only_sql

        spark = self.nodes.sparkSession
        if not is_read_only_sql(spark, text):
            raise ValueError("only queries are allowed")
        return spark.sql(text, nodes=self.nodes, edges=self.edges) if "{nodes}" in text or "{edges}" in text else self._views().sql(text)

    def _views(self):
        self.nodes.createOrReplaceTempView("nodes")
        self.edges.createOrReplaceTempView("edges")
        return self.nodes.sparkSession
