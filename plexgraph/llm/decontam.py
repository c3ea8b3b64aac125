"""Benchmark decontamination as a prefix-filtered set join with exact verification.

A window of an item is a set of ordered tokens; a document contains it only if all tokens occur, so with containment 1
the prefix to join is one token: the window's rarest by document frequency in the corpus. Each place where that token
stands in a document gives one possible start of the window (positional bound), which must leave room for the whole
window (length bound); the words there are then compared. Per place at most one start for each offset of the token in
windows is tried, so work doesn't grow with the number of windows that share a token.

Items are the stated query set. They come to the driver in blocks of at most ``BLOCK`` windows, and each block meets
all documents in a pass that moves no document.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexgraph.llm.common import bounded_batches

#: Windows that one pass over the documents looks for.
BLOCK = 100_000
WINDOW = 10
#: Letters a-z and digits stay, A-Z is lowered, other ASCII parts words, bytes of non-ASCII characters stay.
_TABLE = bytes(c if c >= 0x80 or chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def blocks(items: DataFrame, id_col: str, text_col: str, size: int, block: int) -> Iterator[dict[tuple[bytes, ...], set[str]]]:
    """Windows and the ids of their items, at most ``block`` windows at a time."""
    found: dict[tuple[bytes, ...], set[str]] = {}
    rows = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string"), text_col)
    for item, text in rows.toLocalIterator():
        for w in windows_of(words_of(text), size):
            ids = found.setdefault(w, set())
            if item is not None:
                ids.add(item)
            if len(found) >= block:
                yield found
                found = {}
    if found:
        yield found


def _frequencies(batches: Iterable[pa.RecordBatch], vocabulary: Broadcast) -> Iterator[pa.RecordBatch]:
    known, counts = vocabulary.value, Counter()
    for b in batches:
        for text in b.column(0).to_pylist():
            counts.update(known.intersection(words_of(text)))
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def prefix_index(windows: dict[tuple[bytes, ...], set[str]], frequency: dict[bytes, int]) -> dict[bytes, dict[tuple[int, int], dict[tuple[bytes, ...], set[str]]]]:
    """token -> (offset, length) -> windows whose rarest token it is, and their items."""
    index: dict = defaultdict(lambda: defaultdict(dict))
    for w, ids in windows.items():
        at = min(range(len(w)), key=lambda i: (frequency.get(w[i], 0), w[i], i))
        index[w[at]][at, len(w)][w] = ids
    return {t: dict(x) for t, x in index.items()}


def hits(words: list[bytes], index: dict) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged spans of words inside occurrences of indexed windows, and the ids of these windows' items."""
    if index.keys().isdisjoint(words):
        return [], set()
    spans, items = [], set()
    for p, word in enumerate(words):
        if (places := index.get(word)) is not None:
            for (offset, n), windows in places.items():
                start = p - offset
                if start >= 0 and start + n <= len(words) and (ids := windows.get(tuple(words[start : start + n]))) is not None:
                    spans.append((start, start + n))
                    items |= ids
    return merged(spans), items


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_MATCHED = "doc_id long, text string, n_words long, spans array<struct<s:int,e:int>>, items array<string>"


def _match(batches: Iterable[pa.RecordBatch], index: Broadcast, last: bool) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
    found = index.value
    for b in batches:
        before = zip(b.column(2).to_pylist(), b.column(3).to_pylist())
        counts, spans, items = [], [], []
        for text, (old_spans, old_items) in zip(b.column(1).to_pylist(), before):
            words = words_of(text)
            s, i = hits(words, found)
            if old_spans:
                s, i = merged([*s, *((x["s"], x["e"]) for x in old_spans)]), i | set(old_items)
            counts.append(len(words))
            spans.append([{"s": x, "e": y} for x, y in s])
            items.append(sorted(i))
        text = pa.nulls(b.num_rows, pa.string()) if last else b.column(1)
        yield pa.RecordBatch.from_arrays([b.column(0), text, pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "text", "n_words", "spans", "items"])


def _indexes(docs: DataFrame, items: DataFrame, text_col: str, item_id: str, item_text: str, size: int, block: int) -> Iterator[Broadcast]:
    """A broadcast prefix index for each block; document frequencies come from all documents."""
    spark = docs.sparkSession
    bounded_batches(spark)
    for windows in blocks(items, item_id, item_text, size, block):
        vocabulary = spark.sparkContext.broadcast(frozenset(w for x in windows for w in x))
        counted = docs.select(text_col).mapInArrow(partial(_frequencies, vocabulary=vocabulary), "word binary, n long")
        frequency = {bytes(w): n for w, n in counted.groupBy("word").agg(F.sum("n")).collect()}
        yield spark.sparkContext.broadcast(prefix_index(windows, frequency))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row (doc_id, n_words, n_hit, spans, items) for each row of ``docs``.

    ``spans`` are the runs of words inside occurrences of windows, ``items`` the ids whose windows occur. Null and empty
    texts have no words and no hits. Windows of items without an id count as hits and add nothing to ``items``; items without
    words are left out, and repeated items count once. Ties in rarity
    fall to the smaller token. Empty tables and other columns do no harm; a repeated document is judged each time.
    """
    now = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast("array<struct<s:int,e:int>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    indexes = list(_indexes(docs, items, text_col, item_id, item_text, size, block)) or [docs.sparkSession.sparkContext.broadcast({})]
    for k, index in enumerate(indexes):
        now = now.select("doc_id", "text", "spans", "items").mapInArrow(partial(_match, index=index, last=k == len(indexes) - 1), _MATCHED)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return now.select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items")


def _clean(batches: Iterable[pa.RecordBatch], index: Broadcast, text_col: str) -> Iterator[pa.RecordBatch]:
    found = index.value
    for b in batches:
        yield b.filter(pa.array([not hits(words_of(t), found)[0] for t in b.column(text_col).to_pylist()], pa.bool_()))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``docs`` without the rows in which a window of an item occurs; no row is moved between tasks."""
    now = docs
    for index in _indexes(docs, items, text_col, item_id, item_text, size, block):
        now = now.mapInArrow(partial(_clean, index=index, text_col=text_col), docs.schema)
    return now
