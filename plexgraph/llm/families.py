"""Components of things that are linked when they are near, found bucket by bucket without making all pairs of a family.

A bucket has homes and visitors; what is near shares a bucket in which one of the two is a home. First each bucket's members
meet its centre: the home that has most mates in all its buckets. The original of a family of copies is that in nearly all
buckets of the family, while two copies may be too far from each other; so the family falls into one component at once. Then
pairs are made only between members of different components, and never within the largest component of a bucket. So a large
family costs what its members cost, and no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, IntegerType, LongType, StructField, StructType

from plexgraph.llm.common import counted, forget, settled, shuffled

#: Up to so many edges, one task finds the components; beyond, rounds of joins do, each of which makes eight jobs.
SMALL = 500_000


def _plain(kind: DataType) -> bool:
    fields = [f.dataType for f in kind.fields] if isinstance(kind, StructType) else [kind]
    return all(isinstance(f, BooleanType | IntegerType | LongType) for f in fields)


def _ranks(nodes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each node's rank in Spark's order (field by field, nulls first), and for each rank the place of a node that has it."""
    fields = [f.cast(pa.int64()) for f in (nodes.flatten() if pa.types.is_struct(nodes.type) else [nodes])]
    keys = [x.to_numpy(zero_copy_only=False) for f in fields for x in (f.is_valid(), f.fill_null(0))]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new) - 1
    return ranks, order[new]


def _in_one_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the ends of all edges: roots hang on to smaller ones that an edge leads to, until none does."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    nodes = pa.concat_arrays([b.column(k) for k in (0, 1) for b in held])
    ranks, place = _ranks(nodes)
    a, b = ranks[: len(ranks) // 2], ranks[len(ranks) // 2 :]
    root = np.arange(len(place))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    for k in range(0, len(place), 1 << 16):
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(place[at])) for at in (slice(k, k + (1 << 16)), root[k : k + (1 << 16)])], names=["node", "root"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root), once for each end of an edge (a, b): root is the smallest node of its component.

    At most ``SMALL`` edges between nodes of numbers meet in one task. Of more, large-star and small-star steps alternate until
    no edge changes; each step needs an aggregate and an equi-join, and its edges are written to the shared folder. Raises if
    that takes more than ``rounds`` rounds.
    """
    (now, (n,)), seen = counted(edges.select("a", "b").where("a != b")), None
    kind = now.schema["a"].dataType
    if n <= SMALL and _plain(kind):
        return now.coalesce(1).mapInArrow(_in_one_task, StructType([StructField("node", kind), StructField("root", kind)]))
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(shuffled(least), "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # From here each edge points from the larger node b to the smaller node a.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(shuffled(least), "b")
        small = small.select(F.col("m").alias("a"), F.col("a").alias("b")).union(small.select(F.col("m").alias("a"), "b"))
        new, mark = counted(small.where("a < b").distinct(), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        forget(now)
        now = new
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return roots.union(now.select(F.col("b").alias("node"), F.col("a").alias("root")))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def families(grid: DataFrame, near: Callable[[DataFrame], DataFrame], sketches: Callable[[DataFrame], DataFrame] | None = None, alike: Callable[[Column, Column], Column] | None = None, known: DataFrame | None = None) -> DataFrame:
    """(node, root) of the nodes that are linked with others: root is the smallest node of the component.

    ``grid`` has columns (bucket, node, home); ``near`` keeps of pairs (a, b) those that are linked. ``sketches`` makes (node,
    sketch) of the nodes that are left after the first step; they form pairs only if their sketches are ``alike``. ``known``
    has (node, root) of components found before, settled; only members of different ones meet.
    """
    shared = grid.groupBy("bucket").agg(F.count(F.lit(1)).alias("mates"), F.count_if("home").alias("homes")).where("mates > 1 AND homes > 0").select("bucket", "mates")
    members = settled(grid.join(shuffled(shared), "bucket"))
    central = members.groupBy("node").agg(F.sum("mates").alias("central"))
    ranked = members.join(shuffled(central), "node")
    centre = ranked.groupBy("bucket").agg(F.max_by("node", F.when(F.col("home"), F.struct("central", F.xxhash64("node")))).alias("centre"))
    stars = members.join(shuffled(centre), "bucket").where("node != centre")
    met = _ordered(stars.select(F.col("centre").alias("a"), F.col("node").alias("b")))
    if known is not None:
        ends = [shuffled(known.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))) for x in "ab"]
        met = met.join(ends[0], "a", "left").join(ends[1], "b", "left").where(~F.coalesce(F.col("ra") == F.col("rb"), F.lit(False))).select("a", "b")
    linked = near(met)
    if known is not None:
        linked = linked.select("a", "b").union(known.where("node != root").select(F.col("root").alias("a"), F.col("node").alias("b")))
    edges, (n,) = counted(linked)
    roots = settled(components(edges)) if n else None
    now = members.join(shuffled(roots), "node", "left").withColumn("root", F.coalesce("root", "node")) if n else members.withColumn("root", F.col("node"))
    sizes = now.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    several = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("roots"), F.max_by("root", "n").alias("most")).where("roots > 1").select("bucket", "most")
    told = settled(now.join(shuffled(several), "bucket").withColumn("main", F.col("root") == F.col("most")))
    drawn = told.withColumn("sketch", F.lit(0)) if sketches is None else told.join(shuffled(sketches(told.select("node").distinct())), "node")
    one = drawn.where("home").select(F.col("bucket").alias("of"), F.col("node").alias("a"), F.col("root").alias("ra"), F.col("main").alias("ma"), F.col("sketch").alias("sa"))
    other = drawn.select("bucket", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("main").alias("mb"), F.col("sketch").alias("sb"))
    meet = (F.col("of") == F.col("bucket")) & (F.col("ra") != F.col("rb"))
    meet = meet & alike(F.col("sa"), F.col("sb")) if alike else meet
    apart = one.where("NOT ma").join(shuffled(other), meet).union(one.where("ma").join(shuffled(other.where("NOT mb")), meet))
    more, (m,) = counted(near(_ordered(apart)))
    forget(members, told)
    if not m:
        return roots if n else members.sparkSession.createDataFrame([], edges.select(F.col("a").alias("node"), F.col("b").alias("root")).schema)
    return settled(components(edges.union(more)))


def node_key(doc_id, *rest):
    """A node's order: by its smallest doc_id, nodes without one last."""
    return F.struct(doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0)).alias("id"), *rest)


def id_of(node):
    """The doc_id of a node; null if it has none."""
    return F.when(~node["none"], node["id"])
