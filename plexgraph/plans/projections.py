"""The driver's tables seen as graphs, change histories and file trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexgraph.session import table

#: Orders before this date give a sparse graph with a few cycles.
BEFORE = "1995-02-15"


def _id(label: str, key: str):
    return F.concat(F.lit(f"{label}:"), F.col(key).cast("string"))


def trade_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """(id, label, name): customers, orders, parts, suppliers, nations and regions."""
    kinds = [
        ("customer", "c_custkey", F.col("c_name")),
        ("orders", "o_orderkey", F.col("o_orderpriority")),
        ("part", "p_partkey", F.col("p_name")),
        ("supplier", "s_suppkey", F.col("s_name")),
        ("nation", "n_nationkey", F.col("n_name")),
        ("region", "r_regionkey", F.col("r_name")),
    ]
    out = None
    for name, key, title in kinds:
        label = "order" if name == "orders" else name
        rows = table(spark, sf, name).select(_id(label, key).alias("id"), F.lit(label).alias("label"), title.alias("name"))
        out = rows if out is None else out.union(rows)
    return out


def trade_edges(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst, rel_type, confidence) between them."""
    one = F.lit(1.0)
    line, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    parts = [
        orders.select(_id("customer", "o_custkey").alias("src"), _id("order", "o_orderkey").alias("dst"), F.lit("placed").alias("rel_type"), one.alias("confidence")),
        line.select(_id("order", "l_orderkey"), _id("part", "l_partkey"), F.lit("contains"), F.round(1 - F.col("l_discount"), 6)),
        line.select(_id("part", "l_partkey"), _id("supplier", "l_suppkey"), F.lit("supplied_by"), one).distinct(),
        table(spark, sf, "customer").select(_id("customer", "c_custkey"), _id("nation", "c_nationkey"), F.lit("located_in"), one),
        table(spark, sf, "supplier").select(_id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), F.lit("located_in"), one),
        table(spark, sf, "nation").select(_id("nation", "n_nationkey"), _id("region", "n_regionkey"), F.lit("part_of"), one),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


#: Words of 64 bits in the filter of ``_near``; it never grows beyond them, whatever the input.
WORDS = 1 << 18


def _near(rows: DataFrame, key: str, keys: DataFrame, of: str) -> DataFrame:
    """``rows`` whose ``key`` is among ``keys`` (column ``of``), and a few others: a Bloom filter of bounded size."""
    h = lambda c: F.xxhash64(F.col(c).cast("long"))
    word = lambda c: h(c).bitwiseAND(F.lit(WORDS - 1))

    def bits(c: str):
        out = F.lit(0).cast("long")
        for k in range(18, 42, 6):
            out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h(c), k).bitwiseAND(F.lit(63)).cast("int")))
        return out

    held = F.broadcast(keys.groupBy(word(of).alias("word")).agg(F.bit_or(bits(of)).alias("bits")))
    return rows.join(held, (word(key) == F.col("word")) & (bits(key).bitwiseAND(F.col("bits")) == bits(key)), "left_semi")


def _screened(rows: DataFrame, key: str, keys: DataFrame, of: str) -> DataFrame:
    """``rows`` whose ``key`` is among ``keys`` (column ``of``).

    The exact join shuffles what passes the filter, and so few rows besides those it keeps. With very many keys more rows pass.
    """
    return _near(rows, key, keys, of).join(keys, F.col(key) == F.col(of), "left_semi")


def next_edges(spark: SparkSession, sf: str, before: str = BEFORE) -> DataFrame:
    """(src, dst, n, confidence): parts that follow each other in an order placed before a date."""
    orders = table(spark, sf, "orders").where(F.col("o_orderdate") < F.lit(before).cast("timestamp_ntz")).select("o_orderkey")
    line = _screened(table(spark, sf, "lineitem"), "l_orderkey", orders, "o_orderkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    steps = line.select("l_partkey", F.lead("l_partkey").over(w).alias("nxt"), F.round(1 - F.col("l_discount"), 6).alias("conf"))
    real = steps.where("nxt IS NOT NULL AND nxt <> l_partkey")
    return real.groupBy(_id("part", "l_partkey").alias("src"), _id("part", "nxt").alias("dst")).agg(F.count(F.lit(1)).alias("n"), F.max("conf").alias("confidence"))


NEXT_SQL = """nx AS (
  SELECT 'part:' || l_partkey AS src, 'part:' || nxt AS dst, count(*) AS n, max(conf) AS confidence FROM (
    SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS nxt, round(1 - l_discount, 6) AS conf
    FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-02-15'))
  WHERE nxt IS NOT NULL AND nxt <> l_partkey GROUP BY 1, 2)"""


def part_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(_id("part", "p_partkey").alias("id"), F.lit("part").alias("label"), F.col("p_name").alias("name"), F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_type").alias("file_path"))


def order_changes(spark: SparkSession, sf: str) -> DataFrame:
    """(commit, item): the parts of each order."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("item"))


def day_changes(spark: SparkSession, sf: str) -> DataFrame:
    """(commit, item): event types of each user's days."""
    e = table(spark, sf, "events")
    return e.select(F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("commit"), F.col("event_type").alias("item"))


def bought_together(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst, co_changes): pairs of parts in two or more orders."""
    from plexgraph.operators.coupling import pairs

    both = pairs(order_changes(spark, sf)).where("co_changes >= 2")
    return both.select(_id("part", "a").alias("src"), _id("part", "b").alias("dst"), "co_changes")


TOGETHER_SQL = """ch AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
sm AS (SELECT o FROM ch GROUP BY o HAVING count(*) <= 50),
tg AS (SELECT 'part:' || x.p AS src, 'part:' || y.p AS dst, count(*) AS co_changes FROM ch x JOIN ch y ON x.o = y.o AND x.p < y.p WHERE x.o IN (SELECT o FROM sm) GROUP BY 1, 2 HAVING count(*) >= 2)"""


def page_paths(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, path): host and path of each page's url, as a file path."""
    rest = F.regexp_replace(F.regexp_extract("url", "://([^?#]*)", 1), "/+$", "")
    return table(spark, sf, "pages").select("page_id", rest.alias("path"))


PATHS_SQL = "pp AS (SELECT page_id, regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/+$', '') AS path FROM pages)"
