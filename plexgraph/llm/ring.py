"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has 65,536 cells; a document falls into a cell by the hash of its text, so equal texts start from one place. Each
shard has virtual nodes on the ring. A cell goes clockwise to the first virtual node whose shard still has room for it, so no
shard exceeds its bound while another one has room, and a change of the number of shards moves few cells. A cell of more than
1 in ``HEAVY`` bytes, such as one with a large group of equal texts, is dealt in ``1 << PARTS`` parts by the hash of the row:
they fill the first shard clockwise, and what overflows it goes on to the next one. Only sums come to the driver: at most
65,536 cells and ``HEAVY << PARTS`` parts, whatever the input.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexgraph.llm.common import row_hash, settled

CELLS = 1 << 16
SHARDS, NODES, SLACK = 8, 128, 0.001


#: At most ``HEAVY`` cells hold more than 1 in ``HEAVY`` bytes each; bits of the number of parts of such a cell.
HEAVY, PARTS = 256, 10


def _cell(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))), 48).cast("int")


def nodes(shards: int, per_shard: int = NODES) -> list[tuple[int, int]]:
    """(place on the ring, shard) of all virtual nodes, in order."""
    place = lambda s, v: int.from_bytes(hashlib.md5(f"{s}/{v}".encode()).digest()[:2], "big")
    return sorted((place(s, v), s) for s in range(shards) for v in range(per_shard))


def assign(loads: dict[int, int], shards: int, per_shard: int = NODES, slack: float = SLACK, bits: int = 0) -> dict[int, int]:
    """unit -> shard for units with loads; a unit's cell is the unit without its last ``bits`` bits.

    Heavy cells come first, with their units in order; each unit goes to the first shard clockwise that has room. A shard's
    bound is (1 + slack) times the mean load. A unit that fits nowhere goes to the least loaded shard.
    """
    ring = nodes(shards, per_shard)
    places = [p for p, _ in ring]
    bound = math.ceil(sum(loads.values()) * (1 + slack) / shards)
    whole: Counter = Counter()
    for unit, load in loads.items():
        whole[unit >> bits] += load
    held, out = [0] * shards, {}
    for unit, load in sorted(loads.items(), key=lambda x: (-whole[x[0] >> bits], x[0])):
        at = bisect.bisect_left(places, unit >> bits)
        tried: set[int] = set()
        shard = None
        for k in range(len(ring)):
            s = ring[(at + k) % len(ring)][1]
            if s not in tried and held[s] + load <= bound:
                shard = s
                break
            tried.add(s)
            if len(tried) == shards:
                break
        if shard is None:
            shard = min(range(shards), key=lambda s: (held[s], s))
        held[shard] += load
        out[unit] = shard
    return out


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, size, text_crc32, row, cell) of every row."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), row_hash(docs).alias("row"), _cell(docs[text_col]).alias("cell"))


def _unit(cell: Column, row: Column, heavy: list[int]) -> Column:
    """A row's unit: its cell, and the part of it if the cell is heavy."""
    part = row.bitwiseAND(F.lit((1 << PARTS) - 1))
    return F.shiftleft(cell.cast("long"), PARTS).bitwiseOR(F.when(cell.isin(heavy), part).otherwise(F.lit(0).cast("long")))


def _placed(rows: DataFrame, shards: int, per_shard: int, slack: float) -> tuple[DataFrame, list[int]]:
    """(unit, shard, start) and the heavy cells: start is the number of rows in the shard's earlier units."""
    spark = rows.sparkSession
    cells = {c: (s, n) for c, s, n in rows.groupBy("cell").agg(F.sum("size"), F.count(F.lit(1))).collect()}
    total = sum(s for s, _ in cells.values())
    heavy = sorted(c for c, (s, _) in cells.items() if s * HEAVY > total)
    sums = {c << PARTS: x for c, x in cells.items() if c not in set(heavy)}
    if heavy:
        unit = _unit(F.col("cell"), F.col("row"), heavy)
        sums |= {u: (s, n) for u, s, n in rows.where(F.col("cell").isin(heavy)).groupBy(unit.alias("unit")).agg(F.sum("size"), F.count(F.lit(1))).collect()}
    shard_of = assign({u: s for u, (s, _) in sums.items()}, shards, per_shard, slack, PARTS)
    begun, table = [0] * shards, []
    for unit in sorted(sums):
        s = shard_of[unit]
        table.append((unit, s, begun[s]))
        begun[s] += sums[unit][1]
    return F.broadcast(spark.createDataFrame(table, "unit long, shard int, start long")), heavy


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHARDS, per_shard: int = NODES, slack: float = SLACK) -> DataFrame:
    """One row (doc_id, size, text_crc32, shard, slot) for each row of ``docs``; shards have near equal bytes.

    A null text counts as empty. Equal texts stay in one shard, unless they are more than 1 in ``HEAVY`` of all bytes: then
    they fill shards one after the other, clockwise. Rows equal in all columns stay in one shard. Rows get different slots. An
    empty table gives an empty result; other columns are only hashed.
    """
    rows = settled(_slim(docs, id_col, text_col))
    placed, heavy = _placed(rows, n, per_shard, slack)
    units = rows.withColumn("unit", _unit(F.col("cell"), F.col("row"), heavy))
    within = F.row_number().over(Window.partitionBy("unit").orderBy("doc_id", "text_crc32", "size", "row"))
    out = units.withColumn("r", within).join(placed, "unit")
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("r") - 1).alias("slot"))


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHARDS, per_shard: int = NODES, slack: float = SLACK, shard_col: str = "shard") -> DataFrame:
    """``docs`` with their shard in ``shard_col`` (replaced if it is there already). ``docs`` may have any column names."""
    placed, heavy = _placed(settled(_slim(docs, id_col, text_col)), n, per_shard, slack)
    keep = F.struct(*[docs[f"`{c.replace('`', '``')}`"] for c in docs.columns if c != shard_col]).alias("doc")
    out = docs.select(keep, _unit(_cell(docs[text_col]), row_hash(docs), heavy).alias("unit")).join(placed, "unit")
    return out.select("doc.*", F.col("shard").alias(shard_col))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write each shard to its own folder ``shard=k``."""
    sharded(docs, **options).write.partitionBy("shard").parquet(path)
