"""Execution flows: bounded breadth-first traces from entry points, without near copies of longer flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexgraph.session import settle

DEPTH, BRANCH, SIZE = 6, 3, 25


def surest(edges: DataFrame, most: int) -> DataFrame:
    """(src, dst, confidence, r): the ``most`` surest edges of each node to other nodes, ranked from 1; ties by ``dst``."""
    w = Window.partitionBy("src").orderBy(F.desc("confidence"), "dst")
    once = edges.where("src <> dst").groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))
    return once.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)


def trace(edges: DataFrame, entries: DataFrame, depth: int = DEPTH, branch: int = BRANCH, size: int = SIZE) -> DataFrame:
    """(entry, steps): nodes in order of visit. Of a node's callees the ``branch`` surest new ones are followed.

    Only the ``size + branch`` surest edges of a node can matter, so a level has at most ``size`` times as many rows for
    each entry; the picks of a level, which depend on each other, are made over that bounded array.
    """
    best = settle(surest(edges, size + branch).select("src", "dst", "r"))
    state = settle(entries.select("entry").distinct().select("entry", F.array("entry").alias("steps"), F.array("entry").alias("frontier")))
    for _ in range(depth):
        each = state.select("entry", F.posexplode("frontier").alias("k", "src")).join(best, "src")
        offers = each.groupBy("entry").agg(F.sort_array(F.collect_list(F.struct("k", "r", "dst"))).alias("offers"))
        start = F.struct(F.col("steps").alias("steps"), F.array().cast("array<string>").alias("added"), F.lit(-1).alias("k"), F.lit(0).alias("n"))

        def pick(a, o):
            n = F.when(a["k"] == o["k"], a["n"]).otherwise(0)
            fits = (n < branch) & (F.size(a["steps"]) < size) & ~F.array_contains(a["steps"], o["dst"])
            one = F.array(o["dst"])
            return F.struct(
                F.when(fits, F.concat(a["steps"], one)).otherwise(a["steps"]).alias("steps"),
                F.when(fits, F.concat(a["added"], one)).otherwise(a["added"]).alias("added"),
                o["k"].alias("k"),
                F.when(fits, n + 1).otherwise(n).alias("n"),
            )

        none = F.array().cast("array<struct<k:int,r:int,dst:string>>")
        grown = state.join(offers, "entry", "left").select("entry", F.aggregate(F.coalesce("offers", none), start, pick).alias("a"))
        state = settle(grown.select("entry", F.col("a.steps").alias("steps"), F.col("a.added").alias("frontier")))
        if state.where(F.size("frontier") > 0).isEmpty():
            break
    return state.select("entry", "steps")


def distinct_flows(flows: DataFrame, share: float = 0.5) -> DataFrame:
    """The flows that a greedy pass, longest first and then by ``ord``, keeps: none shares more than ``share`` of the smaller of
    both with a kept one before it.

    That is the first maximal independent set of the overlap graph. Each round keeps the flows without an undecided
    earlier neighbour and drops theirs.
    """
    items = flows.select("entry", F.size("steps").alias("n"), "ord", F.explode("steps").alias("node"))
    a = items.select(F.col("entry").alias("a"), F.col("n").alias("na"), F.col("ord").alias("oa"), "node")
    b = items.select(F.col("entry").alias("b"), F.col("n").alias("nb"), F.col("ord").alias("ob"), "node")
    before = (F.col("na") > F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("oa") < F.col("ob"))
    overlap = a.join(b, "node").where(before).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") / F.least("na", "nb") > share).select("a", "b")
    left, open_ = settle(overlap), settle(flows.select("entry"))
    kept = None
    while not open_.isEmpty():
        free = settle(open_.join(left.select(F.col("b").alias("entry")).distinct(), "entry", "left_anti"))
        kept = free if kept is None else kept.union(free)
        gone = left.join(free.select(F.col("entry").alias("a")), "a", "left_semi").select(F.col("b").alias("entry")).distinct()
        open_ = settle(open_.join(free, "entry", "left_anti").join(gone, "entry", "left_anti"))
        still = lambda c: open_.select(F.col("entry").alias(c))
        left = settle(left.join(still("a"), "a", "left_semi").join(still("b"), "b", "left_semi").select("a", "b"))
    return flows.limit(0) if kept is None else flows.join(kept, "entry", "left_semi")


def processes(flows: DataFrame, nodes: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Process nodes (id, name, step_count, kind) and steps (src, dst, step_number) of flows with more than one step.

    ``members`` has (node, community).
    """
    some = flows.where(F.size("steps") > 1).withColumn("id", F.concat(F.lit("process:"), "entry", F.lit(":")))
    steps = some.select("id", F.posexplode("steps").alias("k", "node")).join(nodes.select(F.col("id").alias("node"), "name"), "node")
    named = steps.join(members, "node", "left").groupBy("id").agg(F.sort_array(F.collect_set(F.struct("k", "name"))).alias("names"), F.count_distinct("community").alias("n"), F.count_distinct("node").alias("step_count"))
    title = F.array_join(F.transform(F.slice("names", 1, 4), lambda x: x["name"]), " → ")
    kind = F.when(F.col("n") == 0, "unknown").when(F.col("n") == 1, "intra_community").otherwise("cross_community")
    return named.select("id", title.alias("name"), "step_count", kind.alias("kind")), steps.select(F.col("node").alias("src"), F.col("id").alias("dst"), F.col("k").cast("long").alias("step_number"))
