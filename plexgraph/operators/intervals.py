"""Joins on intervals: innermost containment, overlap, and bounded forward as-of.

Containment and as-of go over spans and points in order of position, so that no row is made for each pair that meets; overlap
joins on an equi key. A key with very many intervals can be split further by ``bucket``: intervals are then repeated for each
bucket of positions they touch, and points look into one bucket only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _bucketed(points: DataFrame, spans: DataFrame, bucket: int | None) -> tuple[DataFrame, DataFrame, list[str]]:
    if not bucket:
        return points, spans, ["key"]
    at = lambda c: F.floor(F.col(c) / bucket)
    return points.withColumn("bucket", at("pos")), spans.withColumn("bucket", F.explode(F.sequence(at("start"), at("stop")))), ["key", "bucket"]


def _swept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(point, span, at, ord): each point's innermost span. Rows come by group and position, spans before points.

    The stack holds the spans that may still be innermost: a later one that lasts as long hides an earlier one for good.
    """
    stack: list[tuple] = []
    group = None
    for b in batches:
        found: list[tuple] = []
        for point, span, at, ord_, stop, *now in zip(*(c.to_pylist() for c in b.columns)):
            if now != group:
                group = now
                stack.clear()
            if stop is not None:
                while stack and stack[-1][0] <= stop:
                    stack.pop()
                stack.append((stop, span, at, ord_))
                continue
            while stack and stack[-1][0] < at:
                stack.pop()
            found.append((point, *stack[-1][1:]) if stack and point is not None else (point, None, None, None))
        columns = zip(*found) if found else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, b.schema)], names=b.schema.names[:4])


def innermost(points: DataFrame, spans: DataFrame, bucket: int | None = None) -> DataFrame:
    """(point, span): for points (point, key, pos) the span (span, key, start, stop, ord) around it that starts last.

    Ties fall to the later ``ord``; a point outside all spans keeps a null span. Spans and points of a key (and bucket) are
    swept once in order of position, so that work grows with their number and not with the pairs that meet.
    """
    p, s, on = _bucketed(points, spans.where("key IS NOT NULL AND start <= stop"), bucket)
    none = lambda c, of: F.lit(None).cast(of.schema[c].dataType).alias(c)
    rows = p.select("point", none("span", s), F.col("pos").alias("at"), none("ord", s), none("stop", s), *on).union(s.select(none("point", p), "span", "start", "ord", "stop", *on))
    swept = rows.repartition(*on).sortWithinPartitions(*on, "at", F.col("stop").isNull(), "ord")
    found = swept.mapInArrow(_swept, swept.select("point", "span", "at", "ord").schema)
    return found.groupBy("point").agg(F.max_by("span", F.when(F.col("at").isNotNull(), F.struct("at", "ord"))).alias("span"))


def overlapping(spans: DataFrame, others: DataFrame) -> DataFrame:
    """Rows of ``spans`` (key, start, stop, ...) that overlap a row of ``others`` (key, start, stop), each once."""
    o = others.select("key", F.col("start").alias("s2"), F.col("stop").alias("e2"))
    return spans.join(o, (spans["key"] == o["key"]) & (spans["start"] <= F.col("e2")) & (spans["stop"] >= F.col("s2")), "left_semi")


def next_within(points: DataFrame, marks: DataFrame, most: int) -> DataFrame:
    """(point, mark, gap): the first mark (mark, key, pos) at or up to ``most`` behind each point; null if there is none.

    Positions are dealt into buckets of ``most`` + 1, each of which also gets the first mark of the next one. A window then
    carries the nearest mark back to each point, so that no point meets all the marks near it.
    """
    wide = most + 1
    bucket = F.floor(F.col("pos") / wide).alias("bucket")
    hit = F.struct(F.col("pos").alias("at"), F.col("mark").isNull().alias("bare"), "mark").alias("hit")
    m = marks.where("key IS NOT NULL AND pos IS NOT NULL").select("key", bucket, "pos", hit)
    firsts = m.groupBy("key", "bucket").agg(F.min("hit").alias("hit")).select("key", (F.col("bucket") - 1).alias("bucket"), F.col("hit.at").alias("pos"), "hit")
    seen = m.union(firsts)
    p = points.select("key", bucket, "pos", F.lit(None).cast(seen.schema["hit"].dataType).alias("hit"), "point", F.lit(True).alias("asks"))
    rows = seen.select("*", F.lit(None).cast(points.schema["point"].dataType).alias("point"), F.lit(False).alias("asks")).union(p)
    back = Window.partitionBy("key", "bucket").orderBy(F.desc("pos"), "asks", F.desc("hit")).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("hit", F.last("hit", ignorenulls=True).over(back)).where("asks")
    gap = (F.col("hit.at") - F.col("pos")).cast("long")
    best = F.when(F.col("point").isNotNull() & (gap <= most), F.struct("hit", gap.alias("gap")))
    return near.groupBy("point").agg(F.min(best).alias("b")).select("point", F.col("b.hit.mark").alias("mark"), F.col("b.gap").alias("gap"))


def filled_forward(rows: DataFrame, value: str, key: str = "key", pos: str = "pos") -> DataFrame:
    """``rows`` with ``value`` carried down from the last row of the key that has one."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))
