"""Near copies by the Jaccard similarity of word shingles: fingerprints and MinHash buckets propose pairs, exact sets decide.

A text is the set of its hashed shingles; equal sets are one node. ``BANDS`` buckets of ``ROWS`` minima each hold a node, so
a pair of similarity 0.8 shares no bucket with probability (1 - 0.8 ** ROWS) ** BANDS, less than one in a million. Of the nodes
that share buckets, those with fingerprints (of the same shingles) within ``DISTANCE`` bits meet first, by ``simhash``'s join on
grids of segment popcounts. A similarity of 0.8 lets some 10 of 64 bits differ, far more than a grid can bound, so the families
found thus meet each other by their buckets. Whatever is proposed is compared by its whole sets, and components are found as in
``families``.

Copies of one text that differ too much from it and from each other share buckets, but no link. They are told apart before
sets meet, by the parities of their shingles in ``64 * ODD`` bins: a shingle that one of two sets has flips one bit, so that
the bits that differ are never more than those shingles, which bounds the similarity from above, exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexgraph.llm.common import bounded_batches, forget, row_hash, settled, shuffled, spread_join
from plexgraph.llm.families import families, id_of, node_key
from plexgraph.llm.simhash import close_families, keep_first, majority, shingle_hashes

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 48, 6
#: Bits in which fingerprints may differ to meet first.
DISTANCE = 3
#: A sketch has one bit of each of 64 * ``SKETCH`` minima. At a similarity of 0.8 a tenth of them differ, 25.6 on average, and
#: more than ``APART`` in less than one case in a million.
SKETCH, APART = 4, 54
#: Longs of the parities: enough for sets of some 2,000 shingles; for larger ones the sketch tells.
ODD = 16
_MIX = np.random.default_rng(11).integers(0, 1 << 64, (3, BANDS * ROWS), dtype=np.uint64)
_TIMES, _PLUS, _FOLD = _MIX[0] | np.uint64(1), _MIX[1], (_MIX[2] | np.uint64(1)).reshape(BANDS, ROWS)
_BAND = np.random.default_rng(12).integers(0, 1 << 64, BANDS, dtype=np.uint64)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(text, width))


def node_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes())


def signature(shingles: np.ndarray) -> np.ndarray:
    """One bucket for each band, a sketch of ``SKETCH`` longs and ``ODD`` longs of parities; nothing for a text without words."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[a : a + 1024, None] * _TIMES + _PLUS).min(0), out=least)
    mixed = least.reshape(BANDS, ROWS) * _FOLD
    bits = (mixed.ravel()[: 64 * SKETCH] >> np.uint64(63)).astype(np.uint8)
    odd = (np.bincount((shingles & np.uint64(64 * ODD - 1)).astype(np.int64), minlength=64 * ODD) & 1).astype(np.uint8)
    return np.concatenate([(mixed.sum(1, dtype=np.uint64) ^ _BAND).view(np.int64), np.packbits(bits).view(np.int64), np.packbits(odd).view(np.int64)])


def _apart(a: Column, b: Column, longs: int) -> Column:
    return sum((F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(longs)), F.lit(0))


def possible(a: Column, b: Column, similarity: float) -> Column:
    """Whether sets with such parities can be that similar: no more bits can differ than shingles that only one of them has."""
    return _apart(a["odd"], b["odd"], ODD) * (1 + similarity) <= (a["size"] + b["size"]) * (1 - similarity) + 1e-6


def alike(a: Column, b: Column) -> Column:
    """Whether two sketches differ in few enough bits for a similarity of 0.8."""
    return _apart(a, b, SKETCH) <= APART


def _nodes(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_set(t, width) for t in b.column(2).to_pylist()]
        nodes = np.array([node_of(s) for s in sets], np.uint64).view(np.int64)
        held = pa.array([signature(s) for s in sets], pa.list_(pa.int64()))
        fps = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes), pa.array([len(s) for s in sets], pa.int32()), held, pa.array(fps)], names=["doc_id", "row", "hash", "size", "signature", "fp"])


def _sets(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_set(t, width) for t in b.column(0).to_pylist()]
        nodes = np.array([node_of(s) for s in sets], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["hash", "shingles"])


def _rooted(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """(doc_id, row, root) for each row of ``docs``: its hash, and the smallest node of its component."""
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_hash(docs).alias("row"), F.col(text_col).cast("string").alias("text"))
    rows = settled(slim.mapInArrow(partial(_nodes, width=width), "doc_id long, row long, hash long, size int, signature array<long>, fp long"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    distinct = settled(rows.groupBy("hash").agg(first, F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("signature").alias("signature"), F.first("fp").alias("fp")))
    node = node_key(F.col("first.doc_id"), F.col("hash"), F.col("size"))
    grid = distinct.select("signature", node.alias("node")).select(F.explode(F.slice("signature", 1, BANDS)).alias("bucket"), "node", F.lit(True).alias("home"))
    # Sets are made, once each, of the nodes that share a bucket with others, from one row each.
    shared = grid.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    grid = settled(grid.join(shuffled(shared), "bucket"))
    proposed = settled(distinct.join(shuffled(grid.select(F.col("node.hash").alias("hash")).distinct()), "hash", "left_semi").select("first", "hash", "size", "fp"))
    texts = slim.join(proposed.select(F.col("first.row").alias("row")).distinct().hint("merge"), "row", "left_semi").select("text")
    sets = settled(texts.mapInArrow(partial(_sets, width=width), "hash long, shingles array<long>").dropDuplicates(["hash"]))
    one, other = (sets.select(F.col("hash").alias(f"h{x}"), F.col("shingles").alias(f"s{x}")) for x in "ab")

    def near(pairs: DataFrame) -> DataFrame:
        sizes = F.least("a.size", "b.size") / F.greatest("a.size", "b.size") >= similarity
        held = pairs.where(sizes).join(shuffled(one), F.col("a.hash") == F.col("ha")).join(shuffled(other), F.col("b.hash") == F.col("hb"))
        both = F.size(F.array_intersect("sa", "sb"))
        return held.where(both / (F.size("sa") + F.size("sb") - both) >= similarity).select("a", "b")

    def sketches(nodes: DataFrame) -> DataFrame:
        known = nodes.select("node", F.col("node.hash").alias("hash")).join(shuffled(distinct.select("hash", "signature")), "hash")
        parts = F.struct(F.slice("signature", BANDS + 1, SKETCH).alias("bits"), F.slice("signature", BANDS + SKETCH + 1, ODD).alias("odd"), F.col("node.size").alias("size"))
        return known.select("node", parts.alias("sketch"))

    bare = lambda x: F.struct(*(F.col(f"{x}.{name}").alias(name) for name in ("none", "id", "hash", "size"))).alias(x)
    close = close_families(proposed.select(node_key(F.col("first.doc_id"), F.col("hash"), F.col("size"), F.col("fp")).alias("node")), DISTANCE, near)
    close = settled(close.select(bare("node"), bare("root")))
    found = families(grid, near, sketches, lambda a, b: alike(a["bits"], b["bits"]) & possible(a, b, similarity), close)
    forget(grid)
    named = settled(distinct.select("hash", "n", node.alias("node")).join(shuffled(found.select(F.col("node.hash").alias("hash"), "root")), "hash", "left").select("hash", "n", F.coalesce("root", "node").alias("root")))
    total = named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return spread_join(rows.select("doc_id", "row", "hash"), named, "hash", "n", total, by_shuffle=True)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One row (doc_id, component_id) for each row of ``docs``.

    component_id is the smallest doc_id that links of at least ``similarity`` reach. A text of fewer than ``width`` words
    is one shingle; null, empty and blank texts are equal. A null doc_id stays null and is no smallest one. Repeated rows
    give repeated rows, an empty table an empty result; other columns are only hashed.
    """
    return _rooted(docs, id_col, text_col, width, similarity).select("doc_id", id_of(F.col("root")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near copies, as ``simhash.keep_first`` chooses it."""
    return keep_first(docs, _rooted(docs, id_col, text_col, width, similarity), id_col)
