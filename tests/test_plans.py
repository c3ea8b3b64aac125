"""What queries shuffle and how often they make their edges."""

import pytest
from pyspark.sql import functions as F

from plexgraph.plans import catalog, projections

SF = "/root/testdata/sf0.001"
EDGES = [(f"part:{a}", f"part:{b}", 1 + a % 3, 0.9) for a, b in [(1, 2), (2, 3), (3, 4), (4, 2), (1, 5), (5, 6), (6, 7), (8, 9)]]


def test_screen_keeps_all_and_passes_few_others(spark):
    rows = spark.range(-5000, 100000).select(F.col("id").alias("a"), (F.col("id") % 3).alias("x")).union(spark.sql("SELECT CAST(NULL AS BIGINT), 1L"))
    keys = spark.range(0, 100000, 50).select(F.col("id").alias("b"))
    got = projections._screened(rows, "a", keys, "b")
    assert {tuple(r) for r in got.collect()} == {(k, k % 3) for k in range(0, 100000, 50)}
    # 2,000 rows are kept, 103,001 others are there; rows that pass the screen are those that the exact join shuffles.
    assert 2000 <= projections._near(rows, "a", keys, "b").count() < 2100


def test_lines_are_screened_before_the_shuffle(spark):
    plan = projections.next_edges(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 2 and "bit_or(" in plan


@pytest.mark.parametrize("name", ["ppr_fixed_iterations", "bfs_depth", "impact_by_depth", "multi_root_reach", "call_path", "community_cohesion", "lpa_fixed_rounds", "community_label"])
def test_edges_are_made_once(spark, monkeypatch, name):
    made = spark.sparkContext.accumulator(0)

    def counted(x):
        made.add(1)
        return x

    once = F.udf(counted, "string").asNondeterministic()
    edges = spark.createDataFrame(EDGES, "src string, dst string, n long, confidence double").withColumn("src", once("src"))
    monkeypatch.setattr(catalog, "next_edges", lambda spark, sf: edges)
    monkeypatch.setattr(catalog, "bought_together", lambda spark, sf: edges.select("src", "dst", F.col("n").alias("co_changes")))
    assert catalog.QUERIES[name](spark, SF).collect()
    assert made.value == len(EDGES)
