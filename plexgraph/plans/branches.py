"""What differs between two refs of a repository: symbols and edges that were added, removed or modified."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexgraph.functions import fixed
from plexgraph.operators import changes, codegraph
from plexgraph.plans.analyze import analyze
from plexgraph.session import settle
from plexgraph.sources import files
from plexgraph.sources.parsers import parsed

#: Columns by whose values a symbol counts as modified.
FIELDS = ["content", "signature", "start_line", "end_line"]
EDGE = ["rel_type", "src", "dst", "symbols"]


@dataclass
class Difference:
    nodes: DataFrame  # (id, label, name, file_path, change)
    edges: DataFrame  # (rel_type, src, dst, symbols, change)

    def listing(self, most: int | None = None) -> str:
        """Lines of text, sorted by kind of change and id; with ``most``, so many of each kind and how many more there are."""
        out = []
        for title, rows, line in (("symbols", self.nodes, lambda r: f"{r['label']} {r['name']} ({r['file_path']})"), ("edges", self.edges, lambda r: f"{r['src']} -[{r['rel_type']}]-> {r['dst']}")):
            found: dict[str, list[str]] = {}
            for r in rows.orderBy("change", *(["id"] if title == "symbols" else EDGE)).toLocalIterator():
                found.setdefault(r["change"], []).append(line(r))
            for change, lines in found.items():
                out.append(f"{change} {title}: {len(lines)}")
                out += [f"  {x}" for x in lines[:most]]
                if most is not None and len(lines) > most:
                    out.append(f"  and {len(lines) - most} more")
        return "\n".join(out) or "no structural changes"


def contents(spark: SparkSession, repo: str, ref: str | None, paths: list[str]) -> DataFrame:
    """(path, content, language) of files as they are at a ref, or in the work tree; missing ones and those of no known language are left out."""
    rows = []
    for p in paths:
        text = files.content_at(repo, ref, p) if ref else files.work_tree(repo, p)
        if text:
            rows.append((p, text))
    df = spark.createDataFrame(rows, "path string, content string")
    return df.withColumn("language", files.language(F.col("path"))).where("language IS NOT NULL")


def side(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols of files, and the edges that these files alone tell.

    A call goes to a symbol of that name in its file, else to the only one of that name in all files; a name that several
    other files have is skipped. An import is an edge to the module's name, told by the names that it brings.
    """
    source = settle(parsed(source))
    symbols = settle(codegraph.nodes(source))
    file = codegraph.node_id(F.lit("file"), F.col("path"), F.lit(""))
    imports = source.select("path", F.explode("imports").alias("i")).select(F.lit("imports").alias("rel_type"), file.alias("src"), F.col("i.module").alias("dst"), F.array_join(F.array_sort("i.names"), ",").alias("symbols"))
    calls = source.select("path", F.explode("calls").alias("c")).select("path", F.col("c.line").cast("long").alias("line"), F.explode(F.concat(F.array("c.name"), F.col("c.arguments"))).alias("name"))
    calls = codegraph.within(calls.where(~F.col("name").isin(*fixed.BUILTINS)), symbols, codegraph.LABELS).select("path", "src", "name").distinct()
    of = symbols.select("name", F.col("id").alias("dst"), F.col("file_path").alias("path"), "ord")
    near = of.groupBy("name", "path").agg(F.min_by("dst", "ord").alias("near"))
    only = of.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("only")).where("n = 1").select("name", "only")
    met = calls.join(near, ["name", "path"], "left").join(only, "name", "left").select("src", F.coalesce("near", "only").alias("dst")).where("dst IS NOT NULL AND src <> dst")
    return symbols, imports.union(met.select(F.lit("calls"), "src", "dst", F.lit(""))).distinct()


def _difference(base: tuple[DataFrame, DataFrame], now: tuple[DataFrame, DataFrame]) -> Difference:
    shown = ["label", "name", "file_path"]
    both = now[0].select("id", *shown).union(base[0].select("id", *shown)).dropDuplicates(["id"])
    nodes = changes.diff(base[0], now[0], "id", FIELDS).join(both, "id").select("id", *shown, "change")
    edges = [e.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in EDGE]).distinct() for e in (base[1], now[1])]
    added, removed = edges[1].join(edges[0], EDGE, "left_anti"), edges[0].join(edges[1], EDGE, "left_anti")
    return Difference(settle(nodes), settle(added.withColumn("change", F.lit("added")).union(removed.withColumn("change", F.lit("removed")))))


def scoped(spark: SparkSession, repo: str, base: str, head: str | None = None) -> Difference:
    """The difference told by the changed files alone; without ``head``, that of the work tree."""
    paths = sorted(files.changed_files(repo, base, head))
    return _difference(side(contents(spark, repo, base, paths)), side(contents(spark, repo, head, paths)))


def full(spark: SparkSession, repo: str, base: str, head: str | None = None) -> Difference:
    """The difference between two whole graphs, each built from all files of its ref."""
    graphs = []
    for ref in (base, head):
        paths = files.paths_at(repo, ref) if ref else files.git_paths(repo) or []
        g = analyze(contents(spark, repo, ref, paths))
        kept = g.nodes.where(F.col("label").isin(*codegraph.LABELS))
        graphs.append((kept, g.edges.where("rel_type NOT IN ('member_of', 'step_in_process')")))
    return _difference(*graphs)
