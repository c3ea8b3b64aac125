"""Change feeds as streams: a key is ready when it has been quiet, or when it has waited long enough.

Session windows say when a key was quiet. The ceiling on the wait needs state, so ``ready`` keeps for each key the first
and last change and the content hash that was emitted last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUIET, CEILING = 30, 600


def quiet_sessions(changes: DataFrame, quiet: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """(key, first, last, n) of runs of changes (key, ts) with gaps below ``quiet``; works on streams and tables."""
    rows = changes.withWatermark("ts", late) if changes.isStreaming else changes
    s = rows.groupBy("key", F.session_window("ts", quiet)).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    return s.select("key", "first", "last", "n")


def _step(key: tuple, batches: Iterable[pd.DataFrame], state, quiet: int, ceiling: int) -> Iterator[pd.DataFrame]:
    first, last, sha, sent = state.get if state.exists else (0, 0, "", "")
    now = state.getCurrentWatermarkMs() // 1000
    for b in batches:
        b = b.sort_values("ts")
        for ts, h in zip(b["ts"], b["sha"]):
            t = int(ts.timestamp())
            if first and t - last >= quiet:
                if sha != sent:
                    yield pd.DataFrame({"key": [key[0]], "first": [first], "last": [last], "sha": [sha], "why": ["quiet"]})
                    sent = sha
                first = 0
            first, last, sha = first or t, t, h or ""
            if last - first >= ceiling and sha != sent:
                yield pd.DataFrame({"key": [key[0]], "first": [first], "last": [last], "sha": [sha], "why": ["ceiling"]})
                sent, first = sha, 0
    if state.hasTimedOut or first and now and now - last >= quiet:
        if first and sha != sent:
            yield pd.DataFrame({"key": [key[0]], "first": [first], "last": [last], "sha": [sha], "why": ["quiet"]})
            sent = sha
        first = 0
    state.update((first, last, sha, sent))
    if first:
        state.setTimeoutTimestamp(max((last + quiet) * 1000, state.getCurrentWatermarkMs() + 1))


def ready(changes: DataFrame, quiet: int = QUIET, ceiling: int = CEILING, late: str = "10 seconds") -> DataFrame:
    """(key, first, last, sha, why) from a stream (key, ts, sha): each key after ``quiet`` seconds without a change, or when
    changes have gone on for ``ceiling`` seconds; nothing if the content is what was emitted before."""
    out, held = "key string, first long, last long, sha string, why string", "first long, last long, sha string, sent string"
    return changes.withWatermark("ts", late).groupBy("key").applyInPandasWithState(partial(_step, quiet=quiet, ceiling=ceiling), out, held, "append", "EventTimeTimeout")


def watch(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Run ``apply`` on each micro-batch of distinct keys. Batches run one after the other, so builds never overlap, and
    what changes during a build is in the next batch."""

    def each(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("key").agg(F.max_by("sha", "ts").alias("sha"), F.max("ts").alias("ts"))
        apply(latest, number)

    w = changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="500 milliseconds")).start()
