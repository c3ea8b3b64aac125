"""Language identification by rank-order profiles of character n-grams.

A profile is the ``TOP`` most frequent n-grams (one to three letters, word borders included) in order of frequency. A
document gets the language whose profile is nearest by out-of-place distance: the sum, over the document's own most
frequent n-grams, of the difference of ranks, or ``TOP`` where the profile lacks the n-gram.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexgraph.llm.common import bounded_batches, settled

TOP = 300
#: Languages whose profiles meet the documents in one pass; more take further passes.
BLOCK = 256
#: Letters of a text that are counted at a time.
_PIECE = 1 << 20
_SPACE = 32


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _points(text: str | None) -> np.ndarray:
    """Code points of the lowered letters, each word between single spaces."""
    cp = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[cp]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    out = np.where(letter, cp, _SPACE)[keep]
    if not len(out) or not letter.any():
        return np.zeros(0, np.int64)
    return np.concatenate([[_SPACE], out, [_SPACE] if out[-1] != _SPACE else []]).astype(np.int64)


def _counted(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    two = p[:-1] << 21 | p[1:]
    three = (two[:-1] << 21 | p[2:])[p[1:-1] != _SPACE]
    return np.unique(np.concatenate([p[p != _SPACE], two, three]), return_counts=True)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of a text (21 bits a letter) and their counts; empty without letters."""
    p = _points(text)
    if not len(p):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(p) <= _PIECE:
        return _counted(p)
    parts = []
    for a in range(0, len(p) - 2, _PIECE):
        piece = p[a : a + _PIECE + 2]
        codes, counts = _counted(piece)
        if a:  # its first two letters, and the pair, were counted with the piece before
            again = [int(x) for x in piece[:2] if x != _SPACE] + [int(piece[0] << 21 | piece[1])]
            for code in again:
                counts[np.searchsorted(codes, code)] -= 1
        parts.append((codes, counts))
    codes, counts = _summed(parts)
    return codes[counts > 0], counts[counts > 0]


def ranked(codes: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent codes in order; ties by code."""
    return codes[np.lexsort((codes, -counts))[:top]]


def _train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for b in batches:
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held.setdefault(lang, []).append(grams(text))
        for lang, parts in held.items():
            held[lang] = [_summed(parts)]
        if sum(len(c) for [(c, _)] in held.values()) > 2_000_000:
            yield from _emitted(held)
            held = {}
    yield from _emitted(held)


def _emitted(held: dict) -> Iterator[pa.RecordBatch]:
    for lang, [(codes, counts)] in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], names=["lang", "code", "n"])


def profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> DataFrame:
    """(lang, code, rank) of the profiles of all rows with a text and a language; every row is counted whole."""
    bounded_batches(labelled.sparkSession)
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    summed = rows.mapInArrow(_train, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # A bare row_number with a bound lets Spark keep the first ``top`` of each task before rows of a language meet in one.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    return summed.withColumn("place", place).where(F.col("place") <= top).select("lang", "code", (F.col("place") - 1).alias("rank"))


def distances(own: np.ndarray, codes: np.ndarray, ranks: np.ndarray, top: int) -> np.ndarray:
    """Out-of-place distance of a document's ranked codes to each language: ``ranks`` is by code (sorted) and language."""
    at = np.searchsorted(codes, own)
    at[at == len(codes)] = 0
    known = codes[at] == own
    d = np.abs(ranks[at] - np.arange(len(own))[:, None])
    d[~known] = top
    d[ranks[at] < 0] = top
    return d.sum(axis=0)


def _predict(batches: Iterable[pa.RecordBatch], langs: list[str], codes: np.ndarray, ranks: np.ndarray, top: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names, scores = [], []
        for text, best, old in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
            own = ranked(*grams(text), top)
            if len(own):
                d = distances(own, codes, ranks, top)
                k = int(np.argmin(d))
                score = 1.0 - float(d[k]) / (top * len(own))
                if old is None or score > old:
                    best, old = langs[k], score
            names.append(best)
            scores.append(old)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "text", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> DataFrame:
    """One row (doc_id, held_out, lang_pred, score) for each row of ``docs``; learns from the rows where ``learn`` holds.

    Predictions see the text alone. score is 1 minus the distance as a share of the largest possible one. A text without
    letters, a null text, or a model that has learned no language gives ``und`` and 0. Ties fall to the language first in
    code-point order. Repeated rows are predicted alike; empty tables give empty results.
    """
    found = settled(profiles(docs.where(learn), text_col, lang_col, top))
    langs = [r[0] for r in found.select("lang").distinct().orderBy("lang").toLocalIterator()]
    now = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(~learn, F.lit(False)).alias("held_out"), F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("score"))
    for a in range(0, len(langs), BLOCK):
        block = langs[a : a + BLOCK]
        rows = found.where(F.col("lang").isin(block)).collect()  # at most BLOCK * top rows
        codes = np.array(sorted({r["code"] for r in rows}), dtype=np.int64)
        ranks = np.full((len(codes), len(block)), -1, dtype=np.int32)
        place = {lang: k for k, lang in enumerate(block)}
        for lang, code, rank in rows:
            ranks[np.searchsorted(codes, code), place[lang]] = rank
        now = now.mapInArrow(partial(_predict, langs=block, codes=codes, ranks=ranks, top=top), now.schema)
    return now.select("doc_id", "held_out", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.coalesce("score", F.lit(0.0)).alias("score"))
