"""Mixing sources to target weights by hash-threshold histograms.

Each source has a target of words. Its documents are ordered by a hash of their ids, never sorted: sizes are summed by
source and hash bucket, the bucket in which the target is reached is found from running sums over at most 4,096 buckets,
and only that bucket is split again, until it holds a handful of hashes. Documents below the threshold are taken once
more than the others. Thresholds are nested: a larger target takes a superset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexgraph.llm.common import settled, word_count

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Bits of the hash, and of a histogram's buckets.
BITS, STEP = 60, 12
#: A boundary bucket with at most so many rows is ordered; others are split.
FEW = 256
#: Sources up to which thresholds are sent to every task; beyond, they are joined by source and salt.
SMALL, SALTS = 10_000, 16


def _hash(doc_id: Column) -> Column:
    """60 bits of the id's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, size) -> with target: ``share`` of all sizes, by weights in code-point order (null last), none above ``most`` times its size.

    Places in the order come from range partitions and their counts. The level at which sources are filled rises from
    pass to pass over the table of sources, as capped ones hand their excess on: Newton's method on a concave function, in
    which all sources below the level are capped at once, so passes are few however many sources are.
    """
    pid = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("p", F.spark_partition_id())
    pid = settled(pid)
    counts = pid.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    before = counts.alias("a").join(counts.alias("b"), F.col("b.p") < F.col("a.p"), "left").groupBy("a.p").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("p").orderBy(F.col("source").asc_nulls_last())) - 1
    placed = pid.withColumn("i", at).join(F.broadcast(before), "p").withColumn("i", F.col("i") + F.col("before"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    placed = settled(placed.select("source", "size", weight.alias("weight"), (F.col("size") * float(most)).alias("cap")))
    total, w = placed.agg(F.sum("size"), F.sum("weight")).first()
    level, budget = (share * (total or 0) / w, share * (total or 0)) if w else (0.0, 0.0)
    while w:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        spent, open_weight = placed.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        risen = (budget - spent) / open_weight if open_weight else level
        if not risen > level * (1 + 1e-12):
            break
        level = risen
    return placed.select("source", "size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def _boundary(rows: DataFrame, shift: int) -> DataFrame:
    """From rows (key, rest, bucket source ``h``, size): per key the bucket in which ``rest`` is reached, the words before it, its rows."""
    buckets = rows.groupBy("key", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"), F.first("rest").alias("rest"))
    w = Window.partitionBy("key").orderBy("b")
    run = buckets.withColumn("upto", F.sum("s").over(w)).where("upto > rest")
    return run.groupBy("key").agg(F.min_by(F.struct("b", (F.col("upto") - F.col("s")).alias("under"), "n", "rest"), "b").alias("x")).select("key", "x.*")


def thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, cut): of rows (key, h, size), those with h < cut sum to about ``wanted.rest``, to the nearest hash."""
    shift = BITS - STEP
    first = rows.groupBy("key", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
    sums = first.join(wanted, "key").where("rest > 0")
    run = sums.withColumn("upto", F.sum("s").over(Window.partitionBy("key").orderBy("b"))).where("upto > rest")
    edge = run.groupBy("key").agg(F.min_by(F.struct("b", (F.col("rest") - F.col("upto") + F.col("s")).alias("rest"), "n"), "b").alias("x")).select("key", "x.*")
    edge = settled(edge)
    inside = settled(rows.withColumn("b", F.shiftright("h", shift)).join(edge.select("key", "b", "rest"), ["key", "b"]).select("key", "h", "size", "rest"))
    while shift > 0 and (edge.agg(F.max("n")).first()[0] or 0) > FEW:
        shift -= STEP
        found = _boundary(inside, shift)
        edge = settled(found.select("key", "b", (F.col("rest") - F.col("under")).alias("rest"), "n"))
        inside = settled(inside.drop("rest").withColumn("b", F.shiftright("h", shift)).join(edge.select("key", "b", "rest"), ["key", "b"]).select("key", "h", "size", "rest"))
    last = inside.groupBy("key", "h").agg(F.sum("size").alias("s"), F.first("rest").alias("rest"))
    run = last.withColumn("upto", F.sum("s").over(Window.partitionBy("key").orderBy("h"))).where("upto > rest")
    nearer = F.when(2 * (F.col("rest") - F.col("upto") + F.col("s")) > F.col("s"), F.col("h") + 1).otherwise(F.col("h"))
    return run.groupBy("key").agg(F.min_by(nearer, "h").alias("cut"))


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(key, source_size, target, whole, cut) of rows (key, source, h, size): all are taken ``whole`` times, those with h < cut once more."""
    sources = rows.groupBy("key", "source").agg(F.sum("size").alias("size"))
    goal = targets(sources.select("source", "size"), weights, share, most).withColumn("key", _key(F.col("source")))
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(0)).cast("long")
    goal = settled(goal.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("size")))
    cuts = thresholds(rows, goal.select("key", "rest"))
    out = goal.join(cuts, "key", "left")
    return settled(out.select("key", F.col("size").alias("source_size"), "target", "whole", F.coalesce("cut", F.lit(0)).cast("long").alias("cut")))


def _planned(rows: DataFrame, plans: DataFrame, key: str, h: str) -> DataFrame:
    """``rows`` with (whole, cut) of their source's plan; hot sources are spread by salt where the plans are too many to send to every task."""
    if plans.count() <= SMALL:
        return rows.join(F.broadcast(plans), rows[key] == plans["key"])
    salted = plans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(salted, (rows[key] == salted["key"]) & (F.pmod(rows[h], F.lit(SALTS)) == salted["salt"]))


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    source = F.col(source_col).cast("string")
    return settled(docs.select(F.col(id_col).cast("long").alias("doc_id"), _key(source).alias("key"), source.alias("source"), _hash(F.col(id_col)).alias("h"), word_count(F.col(text_col)).alias("size")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row (doc_id, size, source_size, target, taken) for each row of ``docs``.

    Null texts have size 0; a null source is a source of its own, the last; rows that share a doc_id (and null ids) are
    taken or left together. Sources without words have target 0. An empty table gives an empty result; other columns are
    not read. The hash alone decides, so reruns agree.
    """
    rows = _slim(docs, id_col, text_col, source_col)
    plans = plan(rows, weights, share, most)
    out = _planned(rows.select("doc_id", "size", F.col("key").alias("of"), "h"), plans, "of", "h")
    copies = F.col("whole") + (F.col("h") < F.col("cut")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken. ``docs`` may have any column names."""
    plans = plan(_slim(docs, id_col, text_col, source_col), weights, share, most)
    # The columns of ``docs`` stand in one struct, so that no name is met twice.
    keyed = docs.select(F.struct(*[docs[_quoted(c)] for c in docs.columns]).alias("doc"), _key(docs[source_col]).alias("of"), _hash(docs[id_col]).alias("h"))
    copies = (F.col("whole") + (F.col("h") < F.col("cut")).cast("long")).cast("int")
    out = _planned(keyed, plans, "of", "h").select("doc", copies.alias("copies")).where("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"
