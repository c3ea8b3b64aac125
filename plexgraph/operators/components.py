"""Iterative graph analytics: strongly connected components, personalised PageRank, communities."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexgraph.session import settle


def _spread(edges: DataFrame, marks: DataFrame, steps: int = 4) -> DataFrame:
    """(node, mark) after smaller marks have moved along edges (src, dst) until none moves; ``steps`` hops for each job."""
    now = settle(marks)
    while True:
        new = now
        for _ in range(steps):
            moved = new.join(edges, new["node"] == edges["src"]).select(F.col("dst").alias("node"), "mark")
            new = new.union(moved).groupBy("node").agg(F.min("mark").alias("mark"))
        new = settle(new)
        if new.exceptAll(now).isEmpty():
            return new
        now = new


#: Up to so many edges that may lie on cycles, one task finds the components; beyond, rounds of joins do.
SMALL = 500_000


def _in_one_task(batches: Iterable[pd.DataFrame], min_size: int) -> Iterator[pd.DataFrame]:
    """Tarjan's algorithm without recursion over all edges of the partition."""
    after: dict[str, list[str]] = {}
    for b in batches:
        for s, d in zip(b["src"], b["dst"]):
            after.setdefault(s, []).append(d)
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    place: dict[str, int] = {}
    on: set[str] = set()
    rows: list[tuple[str, str]] = []
    for start in after:
        if start in order:
            continue
        work = [(start, iter(after.get(start, ())))]
        order[start] = low[start] = len(order)
        place[start] = len(stack)
        stack.append(start)
        on.add(start)
        while work:
            node, rest = work[-1]
            for n in rest:
                if n not in order:
                    order[n] = low[n] = len(order)
                    place[n] = len(stack)
                    stack.append(n)
                    on.add(n)
                    work.append((n, iter(after.get(n, ()))))
                    break
                if n in on:
                    low[node] = min(low[node], order[n])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == order[node]:
                    k = place[node]
                    group = stack[k:]
                    del stack[k:]
                    on.difference_update(group)
                    if len(group) >= min_size:
                        rows += [(g, min(group)) for g in group]
    yield pd.DataFrame(rows, columns=["node", "component"])


def strong_components(edges: DataFrame, min_size: int = 2, rounds: int | None = None, small: int = SMALL) -> DataFrame:
    """(node, component): strongly connected components of at least ``min_size`` nodes, named by their smallest node.

    A graph of at most ``small`` edges after trimming is solved in one task. Beyond, each round drops nodes without an edge in or out, colours nodes with the smallest node that reaches them, and takes
    those that reach their colour's root back within the colour. Each round takes one component at least, so rounds end
    when no edge is left; with ``rounds`` given, edges left after so many raise.
    """
    live = settle(edges.select("src", "dst").where("src <> dst").distinct())
    out = None
    for _ in count() if rounds is None else range(rounds):
        for _ in range(3):
            live = live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        live = settle(live)
        n = live.count()
        if n <= small:
            kind = f"node {dict(live.dtypes)['src']}, component {dict(live.dtypes)['src']}"
            found = live.coalesce(1).mapInPandas(partial(_in_one_task, min_size=min_size), kind)
            return found if out is None else out.union(found)
        nodes = live.select(F.col("src").alias("node")).union(live.select("dst")).distinct()
        colour = settle(_spread(live, nodes.withColumn("mark", F.col("node"))))
        a, b = colour.select(F.col("node").alias("src"), F.col("mark").alias("c")), colour.select(F.col("node").alias("dst"), F.col("mark").alias("d"))
        inside = settle(live.join(a, "src").join(b, "dst").where("c = d").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        roots = colour.where("node = mark")
        back = settle(_spread(inside, roots))
        sizes = back.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size)
        found = back.join(sizes, "mark").select("node", F.col("mark").alias("component"))
        out = found if out is None else out.union(found)
        gone = back.select("node")
        live = settle(live.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    raise RuntimeError(f"strong components did not end in {rounds} rounds")


def pagerank(edges: DataFrame, focus: DataFrame, iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, rank): personalised PageRank over a multigraph (src, dst), reset uniformly to ``focus`` (node).

    The rank of nodes without outgoing edges goes to the reset vector. Without focus nodes the result is empty.
    """
    links = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    out = links.groupBy("src").agg(F.sum("w").alias("out"))
    share = settle(links.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("share")))
    nodes = share.select(F.col("src").alias("node")).union(share.select("dst")).distinct()
    starts = focus.select("node").distinct().join(nodes, "node", "left_semi")
    n = starts.count()
    reset = settle(nodes.join(starts.withColumn("reset", F.lit(1.0 / max(n, 1))), "node", "left").select("node", F.coalesce("reset", F.lit(0.0)).alias("reset")))
    rank = reset.select("node", F.col("reset").alias("rank"))
    if not n:
        return rank.limit(0)
    for k in range(iterations):
        given = rank.join(share, rank["node"] == share["src"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        kept = given.agg(F.coalesce(F.sum("got"), F.lit(0.0)).alias("kept"))
        moved = reset.join(given, "node", "left").crossJoin(F.broadcast(kept))  # one row
        rank = moved.select("node", (damping * (F.coalesce("got", F.lit(0.0)) + (1 - F.col("kept")) * F.col("reset")) + (1 - damping) * F.col("reset")).alias("rank"))
        if k % 3 == 2:
            rank = settle(rank)
    return rank.where("rank > 0")


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community) by synchronous label propagation over undirected edges: the commonest label around and at the node
    itself, ties to the smallest.

    The node's own vote keeps the two ends of an edge from swapping labels for ever. A fixed number of rounds makes the partition deterministic; modularity is not optimised.
    """
    plain = settle(edges.select("src", "dst").where("src <> dst"))
    ends = plain.select("src").union(plain.select("dst")).distinct()
    both = settle(plain.union(plain.select("dst", "src")).union(ends.select("src", F.col("src").alias("dst"))))
    label = both.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    for k in range(rounds):
        votes = both.join(label, both["dst"] == label["node"]).groupBy(F.col("src").alias("node"), "community").agg(F.count(F.lit(1)).alias("n"))
        label = votes.groupBy("node").agg(F.min_by("community", F.struct(-F.col("n"), "community")).alias("community"))
        if k % 3 == 2:
            label = settle(label)
    return label


def cohesion(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(community, size, cohesion): internal over incident edges; an edge between communities counts once for each."""
    a, b = members.select(F.col("node").alias("src"), F.col("community").alias("ca")), members.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    ends = edges.select("src", "dst").join(a, "src").join(b, "dst")
    touch = ends.select(F.explode(F.array_distinct(F.array("ca", "cb"))).alias("community"), (F.col("ca") == F.col("cb")).cast("int").alias("inner"))
    sums = touch.groupBy("community").agg(F.sum("inner").alias("inner"), F.count(F.lit(1)).alias("all"))
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(sums, "community", "left").select("community", "size", F.coalesce(F.col("inner") / F.col("all"), F.lit(0.0)).alias("cohesion"))


def community_names(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(community, name): its two commonest groups (``nodes``: node, group, ord) joined by ``+``, first letters capital; ties by first place."""
    held = members.join(nodes, "node").where("group <> ''")
    n = held.groupBy("community", "group").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    ranked = n.withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "first", "group"))).where("r <= 2")
    capital = F.concat(F.upper(F.substring("group", 1, 1)), F.lower(F.substring("group", 2, 1 << 20)))
    joined = ranked.groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", capital.alias("g")))), lambda x: x["g"]), "+").alias("name"))
    return members.select("community").distinct().join(joined, "community", "left").select("community", F.coalesce("name", F.lit("Cluster")).alias("name"))
