"""Ranked search: BM25, fuzzy names, vectors, and their fusion."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B, RRF_K = 1.2, 0.75, 60


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; an underscore parts words."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def _equal(word: str) -> Callable[[Column], Column]:
    return lambda t: t == word


def bm25(docs: DataFrame, query: str, id_col: str = "id", text_col: str = "text", group_col: str | None = None) -> DataFrame:
    """(id, group, score) of documents with a query word; document counts and mean lengths hold per group.

    No inverted index is built: term counts come from each text in place, statistics from one aggregate that moves a row
    per group and task, and the texts are not shuffled.
    """
    words = list(dict.fromkeys(re.findall("[a-z0-9]+", query.lower())))
    group = F.col(group_col) if group_col else F.lit("")
    listed = docs.select(F.col(id_col).alias("id"), group.alias("group"), tokens(F.col(text_col)).alias("ts"))
    tf = [F.size(F.filter("ts", _equal(w))).alias(f"tf{k}") for k, w in enumerate(words)]
    rows = listed.select("id", "group", F.size("ts").alias("dl"), *tf)
    df = [F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(words))]
    stats = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *df)
    score = F.lit(0.0)
    for k in range(len(words)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
        t = F.col(f"tf{k}")
        score = score + idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.join(stats, "group").select("id", "group", score.alias("score")).where("score > 0")


def top_per_group(scored: DataFrame, limit: int, boost: Column | None = None) -> DataFrame:
    """(id, group, score): the best ``limit`` of each group before the boost, then the best of all after it."""
    w = Window.partitionBy("group").orderBy(F.desc("score"), "id")
    kept = scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit)
    out = kept.withColumn("score", F.col("score") * (F.lit(1.0) if boost is None else boost))
    return out.select("id", "group", "score").orderBy(F.desc("score"), "id").limit(limit)


def fuzzy(names: DataFrame, query: str, limit: int = 20, distance: int = 2) -> DataFrame:
    """(id, name, score) of names within a Levenshtein distance; scores fall by 0.3 a step down to 0.3."""
    d = F.levenshtein(F.lower("name"), F.lit(query.lower()), distance)
    hit = names.withColumn("d", d).where(F.col("d") >= 0)
    return hit.select("id", "name", F.greatest(F.lit(0.3), 1 - 0.3 * F.col("d")).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, v: t + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def vectors(embeddings: DataFrame, query: list[float], limit: int = 10, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(id, score): nearest by cosine, by an exact scan; vectors of another width are an error."""
    v = F.array(*[F.lit(float(x)) for x in query])
    fits = F.when(F.size(vec_col) == len(query), cosine(F.col(vec_col), v)).otherwise(F.raise_error(F.lit("vector width differs from the query's")))
    return embeddings.select(F.col(id_col).alias("id"), fits.alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def fuse(lists: list[tuple[DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """(id, score): reciprocal-rank fusion of ranked lists (id, score) with weights.

    A rank counts all rows above it, repeated ids too; of an id's rows in a list the first counts.
    """
    parts = []
    for n, (ranked, weight) in enumerate(lists):
        placed = ranked.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("r"))  # lists are limited
        parts.append(placed.groupBy("id").agg(F.min("r").alias("r")).select("id", (weight / (k + F.col("r"))).alias("part"), F.lit(n).alias("list")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    return rows.groupBy("id").agg(F.sum("part").alias("score"))


def biased(fused: DataFrame, ranks: DataFrame) -> DataFrame:
    """Fused scores times 1 plus the node's personalised rank (node, rank)."""
    return fused.join(ranks.withColumnRenamed("node", "id"), "id", "left").select("id", (F.col("score") * (1 + F.coalesce("rank", F.lit(0.0)))).alias("score"))


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first list, or the second if the first is empty."""
    some = first.agg((F.count(F.lit(1)) > 0).alias("some"))
    return first.union(second.crossJoin(F.broadcast(some)).where(~F.col("some")).drop("some"))  # ``some`` is one row


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text has."""
    q, t = F.array_distinct(tokens(query)), F.array_distinct(tokens(text))
    return F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1))
