"""SimHash near-duplicates by segment popcounts and a grid range-join under Manhattan distance.

A fingerprint's 64 bits are seen as 32 segments of two bits, and each segment by its number of set bits (0, 1 or 2). The
Manhattan distance of two such vectors never exceeds the Hamming distance of the fingerprints, so it filters. Two grids have
the vector's first and last 16 counts as their cells. Of two vectors within distance 3, one half is within distance 1: on
that grid they lie in one cell or in neighbouring ones. So each vector visits, besides its own cell, those with one count
higher by 1, and meets who lives there; pairs are compared by Manhattan distance and then exactly.

Work is on distinct fingerprints: a group of equal texts costs one row, whatever its size. Families of near fingerprints
are found without all their pairs (``families``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexgraph.llm.common import bounded_batches, free_name, row_hash, settled, shuffled, spread_join
from plexgraph.llm.families import families, id_of, node_key

SEED = 42
_EVEN = 0x5555555555555555
#: The grids: a mask over the packed counts, and a segment outside of it.
_GRIDS = ((0xFFFFFFFF, 16), (0xFFFFFFFF << 32, 0))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each word shingle of a text, repeats included; fewer than ``width`` words are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < width:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)))))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=len(shingles))


def majority(hashes: np.ndarray) -> int:
    """The unsigned 64-bit number whose bits are set in over half the hashes; 0 if there are none."""
    ones, n = np.zeros(64, dtype=np.int64), len(hashes)
    if not n:
        return 0
    for a in range(0, n, 4096):
        bits = np.unpackbits(hashes[a : a + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a text: majority bits of XXH64 over its word shingles, repeats included."""
    return majority(shingle_hashes(text, width))


def _fingerprints(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = [_signed(fingerprint(t, width)) for t in b.column(0).to_pylist()]
        names = b.schema.names[1:]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(fps, pa.int64())], names=[*names, "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, row_col: str | None = None) -> DataFrame:
    """(doc_id, fp) for every row, with ``row_col`` (doc_id, row, fp). A null or empty text has fingerprint 0."""
    bounded_batches(docs.sparkSession)
    row = [F.col(row_col).alias("row")] if row_col else []
    slim = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id"), *row)
    return slim.mapInArrow(partial(_fingerprints, width=width), "doc_id long, row long, fp long" if row else "doc_id long, fp long")


def _counts(fp: Column) -> Column:
    """32 popcounts of two-bit segments, each in two bits of a long."""
    low, high = fp.bitwiseAND(F.lit(_EVEN)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_EVEN))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))


def _manhattan(x: Column) -> Column:
    """Sum of |a - b| over the segments, from the XOR of the packed counts: fields 01 and 11 differ by 1, 10 by 2."""
    high, low = F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(_EVEN)), x.bitwiseAND(F.lit(_EVEN))
    return 2 * F.bit_count(high) + F.bit_count(low) - 2 * F.bit_count(high.bitwiseAND(low))


def _visits(v: Column, mask: int, mark: int, radius: int) -> Column:
    """(bucket, home) structs of a vector on one grid: its own cell, and for radius 1 those with one count higher by 1.

    No count is 3, so ``mark``, a 3 outside the grid's segments, tells the grids apart.
    """
    own = v.bitwiseAND(F.lit(_signed(mask))).bitwiseOR(F.lit(_signed(mark)))
    out = [F.struct(own.alias("bucket"), F.lit(True).alias("home"))]
    for k in range(32 if radius else 0):
        if mask >> 2 * k & 3:
            room = v.bitwiseAND(F.lit(_signed(2 << 2 * k))) == 0
            low = F.lit(_signed(1 << 2 * k))
            higher = own.bitwiseXOR(low).bitwiseXOR(F.shiftleft(v.bitwiseAND(low), 1))  # 0 becomes 1, and 1 becomes 2
            out.append(F.when(room, F.struct(higher.alias("bucket"), F.lit(False).alias("home"))))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def _grid(distinct: DataFrame, distance: int) -> DataFrame:
    """``distinct`` with (grid, bucket, home): one row for each cell of both grids that a fingerprint lies in or visits."""
    if not 1 <= distance <= 3:
        raise ValueError("distance must be 1, 2 or 3")
    radius, v = distance // len(_GRIDS), _counts(F.col("fp"))
    on = lambda g: lambda x: F.struct(F.lit(g).alias("grid"), x["bucket"].alias("bucket"), x["home"].alias("home"))
    cells = [F.transform(_visits(v, mask, 3 << 2 * mark, radius), on(g)) for g, (mask, mark) in enumerate(_GRIDS)]
    return distinct.withColumn("cell", F.explode(F.concat(*cells))).select(*distinct.columns, "cell.*")


def _close(a: Column, b: Column, distance: int) -> Column:
    """The Manhattan bound first, then the exact test."""
    return (_manhattan(_counts(a).bitwiseXOR(_counts(b))) <= distance) & (F.bit_count(a.bitwiseXOR(b)) <= distance)


def links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints ``fp`` that differ in at most ``distance`` (1 to 3) bits.

    The result has every pair of a dense family; ``near_duplicates`` doesn't need them.
    """
    grid = _grid(distinct.select("fp"), distance)
    a = grid.where("home").select("grid", "bucket", F.col("fp").alias("a"))
    b = grid.select("grid", "bucket", F.col("fp").alias("b"), "home")
    once = ~F.col("home") | (F.col("a") < F.col("b"))
    before = _manhattan(_counts(F.col("a")).bitwiseXOR(_counts(F.col("b"))).bitwiseAND(F.lit(_signed(_GRIDS[0][0])))) > distance // len(_GRIDS)
    pairs = a.join(b, ["grid", "bucket"]).where(once & (F.col("a") != F.col("b")) & ((F.col("grid") == 0) | before) & _close(F.col("a"), F.col("b"), distance))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def close_families(nodes: DataFrame, distance: int, more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, root) of the nodes (node, with a field fp) that links of at most ``distance`` bits join; ``more`` keeps of close pairs some."""

    def near(pairs: DataFrame) -> DataFrame:
        close = pairs.where(_close(F.col("a.fp"), F.col("b.fp"), distance))
        return more(close) if more else close

    return families(_grid(nodes.select("node", F.col("node.fp").alias("fp")), distance).select("node", "bucket", "home"), near)


def _rooted(rows: DataFrame, distance: int) -> DataFrame:
    """(doc_id, fp, .., root) of ``rows`` (doc_id, fp, ..), settled: root is the smallest node of the component."""
    node = node_key(F.col("least"), F.col("fp").alias("fp"))
    distinct = settled(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).select("fp", "n", node.alias("node")))
    found = close_families(distinct, distance)
    named = settled(distinct.join(shuffled(found.select(F.col("node.fp").alias("fp"), "root")), "fp", "left").select("fp", "n", F.coalesce("root", "node").alias("root")))
    total = named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return spread_join(rows, named, "fp", "n", total, by_shuffle=True)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3) -> DataFrame:
    """One row (doc_id, fp, component_id) for each row of ``docs``.

    component_id is the smallest doc_id of all documents that links of at most ``distance`` bits reach. Null, empty and
    blank texts share fingerprint 0. Repeated rows give repeated rows. A null doc_id stays null and is no smallest one; a
    component without any doc_id has a null component_id. An empty table gives an empty result; other columns are not read.
    """
    rows = settled(fingerprints(docs, id_col, text_col))
    return _rooted(rows, distance).select("doc_id", "fp", id_of(F.col("root")).alias("component_id"))


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, as ``keep_first`` chooses it."""
    row = free_name(docs, "row")
    keyed = docs.withColumn(row, row_hash(docs))
    rows = settled(fingerprints(keyed, id_col, text_col, row_col=row))
    return keep_first(docs, _rooted(rows, distance), id_col)


def keep_first(docs: DataFrame, grouped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group in ``grouped`` (doc_id, row, root): that of the smallest doc_id.

    ``row`` is ``row_hash``. Rows without a doc_id come after those with one; rows with one doc_id, in the order of their
    hashes. A row is told by its id and hash, so rows that share an id and nothing else are judged apart, and of rows that are
    equal in all columns one stays. ``docs`` may have any column names.
    """
    times = grouped.groupBy("root", "doc_id", "row").agg(F.count(F.lit(1)).alias("n"))
    first = times.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "n")).alias("x"))
    keep_id, keep_row, row = free_name(docs, "keep_id"), free_name(docs, "keep_row"), free_name(docs, "row")
    found = settled(first.select(F.col("x.doc_id").alias(keep_id), F.col("x.row").alias(keep_row), F.col("x.n").alias("n")))
    keyed = docs.withColumn(row, row_hash(docs))
    here = keyed[id_col].cast("long").eqNullSafe(F.col(keep_id)) & (keyed[row] == F.col(keep_row))
    # Ids with hashes are near unique, so rows spread evenly whatever groups there are; one plan for all sizes, as those kept are most.
    pick = lambda which: keyed.join(found.where(which).select(keep_id, keep_row).hint("merge"), here, "left_semi")
    once = pick("n = 1")
    if found.where("n > 1").limit(1).count():
        once = once.union(pick("n > 1").dropDuplicates([id_col, row]))
    return once.drop(row)
