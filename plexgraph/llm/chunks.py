"""Substring deduplication by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text: each byte adds a random number, and older bytes shift out after 16
steps. A chunk ends where the hash is small, so an insertion changes the chunks around it and no others. Chunks that
stand in several documents are found by digest; neighbouring ones join to runs, and runs of ``MIN_WORDS`` words or more
are repeats. Such a run misses, at each end of the passage, the piece up to the next chunk border.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexgraph.llm.common import bounded_batches, free_name, row_hash, settled

#: Bytes of a chunk: at least, at most, and one end in so many further bytes.
LEAST, MOST, ONE_IN = 16, 512, 20
#: Words from which on a run of repeated chunks is a repeat.
MIN_WORDS = 16
_GEAR = np.frombuffer(b"".join(hashlib.md5(bytes([i])).digest()[:2] for i in range(256)), dtype="<u2")
#: A text is hashed in pieces of so many bytes.
_PIECE = 1 << 22
_SCHEMA = "d0 long, d1 long, doc_id long, row long, place long"
#: A chunk's place holds its start, its length in bytes and its words in one number; lengths and words are below 2**_BITS.
_BITS = 10


def _ends(data: np.ndarray) -> np.ndarray:
    """Offsets after which the rolling hash allows a cut; never inside a character."""
    h = _GEAR[data]
    for w in (1, 2, 4, 8):
        older = np.zeros_like(h)
        older[w:] = h[:-w] << np.uint16(w) if len(h) > w else h[:0]
        h = h + older
    ok = h < (1 << 16) // ONE_IN
    ok[:-1] &= (data[1:] & 0xC0) != 0x80
    return np.flatnonzero(ok) + 1


def cuts(text: bytes) -> list[int]:
    """Ends of the chunks of a text; the last is its length."""
    data, out, last = np.frombuffer(text, dtype=np.uint8), [], 0
    n = len(data)
    for a in range(0, n, _PIECE):
        lead = min(a, 16)
        piece = data[a - lead : a + _PIECE + 1]
        for e in (_ends(piece) + (a - lead)).tolist():
            if not a < e <= a + _PIECE:
                continue
            while e - last > MOST:
                cut = last + MOST
                while cut < n and text[cut] & 0xC0 == 0x80:
                    cut += 1
                out.append(cut)
                last = cut
            if e - last >= LEAST:
                out.append(e)
                last = e
    while n - last > MOST:
        cut = last + MOST
        while cut < n and text[cut] & 0xC0 == 0x80:
            cut += 1
        out.append(cut)
        last = cut
    if last < n:
        out.append(n)
    return out


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digests, counts, places = [], [], []
        for text in b.column(2).to_pylist():
            if not text:
                counts.append(0)
                continue
            raw = text.encode("utf-8", "surrogatepass")
            data, ends = np.frombuffer(raw, dtype=np.uint8), cuts(raw)
            black = data > 32
            black[1:] &= data[:-1] <= 32
            count = np.concatenate([[0], np.cumsum(black)])
            begins = [0, *ends[:-1]]
            digests += [xxhash.xxh3_128_digest(raw[s:e]) for s, e in zip(begins, ends)]
            starts, stops = np.array(begins), np.array(ends)
            counts.append(len(ends))
            places.append(((starts << _BITS) + stops - starts << _BITS) + count[stops] - count[starts])
        d = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
        of = pa.array(np.repeat(np.arange(b.num_rows), counts))
        place = np.concatenate(places).astype(np.int64) if places else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1])), b.column(0).take(of), b.column(1).take(of), pa.array(place)],
            names=["d0", "d1", "doc_id", "row", "place"],
        )


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d0, d1, doc_id, row, place) of every chunk: its 128-bit digest, its row's id and ``row_hash``, and its place.

    ``place`` has, from the high bits down, the start in bytes, the length in bytes and the words begun in the chunk.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row_hash(docs).alias("row"), F.col(text_col).cast("string").alias("text")).mapInArrow(_rows, _SCHEMA)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row (doc_id, row, n_words, spans) for each document that shares a run of ``min_words`` words with another one.

    ``spans`` are structs (start, stop, words, later): places in bytes of the UTF-8 text; ``later`` says that smaller
    doc_ids have all chunks of the span, so that it can go. Rows without an id come after all with one; of rows that share an
    id, or have none, no one is later than another. The length of a whole run is tested; its spans end where ``later``
    changes. What repeats within one document only is no repeat. Null and empty texts have no chunks. A document is a row,
    told by its id and ``row_hash``: rows that differ in any column are different documents, also if they share an id or have
    none; rows equal in all columns are one. Empty tables give empty results; other columns are only hashed.

    Chunks are made twice, once to find digests of several documents and once to find where those stand; that costs less
    than keeping all of them. Both sides of the join are dealt by digest, so a frequent passage can be split.
    """
    last = F.lit((1 << 63) - 1)
    all_chunks = chunks(docs, id_col, text_col)
    digests = all_chunks.groupBy("d0", "d1").agg(F.min(F.coalesce("doc_id", last)).alias("lo"), F.min("row").alias("r0"), F.max("row").alias("r1"))
    several = digests.where("r0 < r1").select("d0", "d1", "lo")
    found = all_chunks.join(several, ["d0", "d1"]).select("doc_id", "row", "place", (F.coalesce("doc_id", last) > F.col("lo")).alias("later")).distinct()
    start = F.shiftright("place", 2 * _BITS)
    size, words = F.shiftright("place", _BITS).bitwiseAND(F.lit((1 << _BITS) - 1)), F.col("place").bitwiseAND(F.lit((1 << _BITS) - 1))
    found = found.select("doc_id", "row", "later", start.alias("start"), (start + size).alias("stop"), words.alias("words"))
    w = Window.partitionBy("doc_id", "row").orderBy("start", "stop")
    new = F.coalesce(F.lag("stop").over(w) != F.col("start"), F.lit(True))
    other = new | (F.lag("later").over(w) != F.col("later"))
    numbered = found.withColumn("new", new.cast("int")).withColumn("other", other.cast("int"))
    numbered = numbered.withColumn("run", F.sum("new").over(w)).withColumn("part", F.sum("other").over(w))
    parts = numbered.groupBy("doc_id", "row", "run", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("words").alias("words"), F.first("later").alias("later"))
    runs = parts.groupBy("doc_id", "row", "run").agg(F.sum("words").alias("words"), F.collect_list(F.struct("start", "stop", "words", "later")).alias("parts"))
    spans = F.sort_array(F.flatten(F.collect_list("parts"))).alias("spans")
    return runs.where(F.col("words") >= min_words).groupBy("doc_id", "row").agg(F.sum("words").alias("n_words"), spans)


def _without(batches: Iterable[pa.RecordBatch], text_col: str, spans_col: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = b.schema.get_field_index(text_col)
        texts = []
        for text, spans in zip(b.column(at).to_pylist(), b.column(spans_col).to_pylist()):
            if text and spans:
                raw, last, kept = text.encode("utf-8", "surrogatepass"), 0, []
                for s in spans:
                    kept.append(raw[last : s["start"]])
                    last = s["stop"]
                text = b"".join([*kept, raw[last:]]).decode("utf-8", "surrogatepass")
            texts.append(text)
        b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
        yield b.select([n for n in b.schema.names if n != spans_col])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the spans that are ``later`` in ``repeats``: each row loses its own spans only."""
    key_id, key_row, cut, row = (free_name(docs, n) for n in ("key_id", "key_row", "cut", "row"))
    later = F.filter("spans", lambda s: s["later"])
    spans = settled(repeats(docs, id_col, text_col, min_words).select(F.col("doc_id").alias(key_id), F.col("row").alias(key_row), later.alias(cut)).where(F.size(cut) > 0))
    keyed = docs.withColumn(row, row_hash(docs))
    both = keyed.join(spans, keyed[id_col].cast("long").eqNullSafe(F.col(key_id)) & (keyed[row] == F.col(key_row)), "left").drop(key_id, key_row, row)
    return both.mapInArrow(partial(_without, text_col=text_col, spans_col=cut), docs.schema)
