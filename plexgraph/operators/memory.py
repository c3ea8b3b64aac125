"""A small table of facts: (key, value, category, created_at, updated_at)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexgraph.operators.search import overlap

SCHEMA = "key string, value string, category string, created_at timestamp, updated_at timestamp"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def remember(facts: DataFrame, key: str, value: str, category: str = "general") -> DataFrame:
    """``facts`` with a fact set; a known key keeps its first date."""
    now = F.current_timestamp()
    old = facts.where(F.col("key") == key).agg(F.min("created_at").alias("first"))
    new = old.select(F.lit(key).alias("key"), F.lit(value).alias("value"), F.lit(category).alias("category"), F.coalesce("first", now).alias("created_at"), now.alias("updated_at"))
    return facts.where(F.col("key") != key).unionByName(new)


def forget(facts: DataFrame, key: str) -> DataFrame:
    return facts.where(F.col("key") != key)


def recall(facts: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The fact of that key, else those that share words with the query, best first."""
    exact = facts.where(F.col("key") == query).withColumn("score", F.lit(1.0))
    loose = facts.withColumn("score", overlap(F.lit(query), F.concat_ws(" ", "key", "value", "category"))).where("score > 0")
    found = exact.withColumn("tier", F.lit(0)).unionByName(loose.withColumn("tier", F.lit(1)))
    least = found.agg(F.min("tier").alias("least"))
    return found.crossJoin(F.broadcast(least)).where("tier = least").orderBy(F.desc("score"), "key").limit(limit).drop("tier", "least")  # one row


def listed(facts: DataFrame, category: str | None = None) -> DataFrame:
    return (facts if category is None else facts.where(F.col("category") == category)).orderBy("category", "key")
