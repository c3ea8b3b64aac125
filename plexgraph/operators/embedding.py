"""Texts of nodes, and vectors for them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import partial
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: tier -> width of its vectors.
TIERS = {"quality": 384, "fast": 256}
LABELS = ("function", "method", "class", "interface", "type_alias", "enum", "module")


class Encoder(Protocol):
    width: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """Signed feature hashing of words and their trigrams, scaled to unit length: deterministic and without a model file."""

    def __init__(self, width: int = TIERS["fast"]):
        self.width = width

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width), np.float32)
        for k, text in enumerate(texts):
            for word in re.findall("[a-z0-9]+", re.sub("([a-z0-9])([A-Z])", r"\1 \2", text).lower()):
                for part in {word, *(word[i : i + 3] for i in range(len(word) - 2))}:
                    h = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little")
                    out[k, (h >> 1) % self.width] += 1.0 if h & 1 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def texts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, text): label, name, signature, and the names of callers, callees and methods, in order."""
    some = nodes.where(F.col("label").isin(*LABELS))
    names = nodes.select("id", F.col("name").alias("other"))

    def listed(kind: str, here: str, there: str, title: str) -> DataFrame:
        e = edges.where(F.col("rel_type") == kind).select(F.col(here).alias("at"), F.col(there).alias("id")).join(names, "id")
        return e.groupBy(F.col("at").alias("id")).agg(F.concat(F.lit(title), F.array_join(F.slice(F.sort_array(F.collect_set("other")), 1, 20), ", ")).alias(title.strip(": ")))

    methods = nodes.where("label = 'method'").groupBy("file_path", F.col("class_name").alias("name")).agg(F.concat(F.lit("methods: "), F.array_join(F.sort_array(F.collect_set("name")), ", ")).alias("methods"))
    out = some.join(listed("calls", "src", "dst", "calls: "), "id", "left").join(listed("calls", "dst", "src", "called by: "), "id", "left").join(listed("uses_type", "src", "dst", "types: "), "id", "left")
    out = out.join(methods, ["file_path", "name"], "left")
    own = F.when(F.col("label") == "class", F.col("methods"))
    return out.select("id", F.concat_ws("\n", F.concat_ws(" ", "label", "name"), F.concat(F.lit("in "), "file_path"), F.when(F.col("signature") != "", F.col("signature")), "calls", F.col("`called by`"), "types", own).alias("text"))


def stale(wanted: DataFrame, held: DataFrame, tier: str) -> tuple[DataFrame, DataFrame]:
    """Of texts (id, text): rows of ``held`` (id, vec, sha) that still fit, and (id, text, sha) to encode. Hashes are salted by tier."""
    hashed = wanted.withColumn("sha", F.sha2(F.concat(F.lit(f"{tier}:"), "text"), 256))
    return held.join(hashed.select("id", "sha"), ["id", "sha"], "left_semi"), hashed.join(held.select("id", "sha"), ["id", "sha"], "left_anti").select("id", "text", "sha")


def _encoded(batches: Iterable[pd.DataFrame], encoder: Encoder) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"id": b["id"], "vec": list(encoder.encode(b["text"].tolist())), "sha": b["sha"]})


def embed(wanted: DataFrame, held: DataFrame | None = None, tier: str = "fast", encoder: Encoder | None = None) -> DataFrame:
    """(id, vec, sha) for texts (id, text); vectors of ``held`` are kept where the text is the same."""
    if held is None:
        held = wanted.sparkSession.createDataFrame([], "id string, vec array<float>, sha string")
    kept, todo = stale(wanted, held, tier)
    new = todo.mapInPandas(partial(_encoded, encoder=encoder or HashingEncoder(TIERS[tier])), "id string, vec array<float>, sha string")
    return kept.select("id", "vec", "sha").union(new)
