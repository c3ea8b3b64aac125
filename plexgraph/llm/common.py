"""Helpers shared by the training-text operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: White space in the sense of all word rules here: space, tab, line feed, vertical tab, form feed, return.
SPACE = " \t\n\x0b\x0c\r"
#: An Arrow batch handed to Python ends at this many bytes or rows, whichever comes first.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at a time, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode, where all run in one process, a
    temporary one if that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='plexgraph-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _folder(spark: SparkSession, path: str) -> tuple[object, object]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there, and a lost executor costs no recomputation.

    What is written goes when the driver ends, or by ``forget``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    fs, at = _folder(spark, path)
    fs.deleteOnExit(at)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, *sums: Column) -> tuple[DataFrame, tuple]:
    """``settled`` with the number of rows and other aggregates of them, observed as they are written."""
    seen = Observation()
    out = settled(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(f"s{k}") for k, c in enumerate(sums)]))
    found = seen.get
    return out, (found["rows"], *(found[f"s{k}"] for k in range(len(sums))))


def forget(*frames: DataFrame) -> None:
    """Delete what ``settled`` wrote for the frames; they can't be used afterwards."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/settled-" in f}:
            fs, at = _folder(df.sparkSession, path)
            fs.delete(at, True)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of all of a row's columns, maps apart."""
    return F.xxhash64(*[df[f"`{f.name.replace('`', '``')}`"] for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the input: it is never broadcast.

    Spark broadcasts what is small as a file, and ids and hashes take ten times as much in the driver's memory.
    """
    return df.hint("merge")


#: Keys that hold more than one in so many rows each; there are no more of them than that, whatever the data.
OFTEN = 10_000


def spread_join(rows: DataFrame, lookup: DataFrame, key: str, count: str, total: int, by_shuffle: bool = False) -> DataFrame:
    """``rows`` inner-joined with ``lookup``, which has each key once and in ``count`` the number of its rows of ``total``.

    Keys of more than 1 in ``OFTEN`` rows, at most ``OFTEN`` of them, meet their rows by broadcast, the others by shuffle; so
    no task gets a hot key's rows. With ``by_shuffle`` Spark doesn't broadcast the others where it takes them for small.
    """
    often = F.broadcast(lookup.where(F.col(count) * OFTEN > total).drop(count))
    seldom = lookup.where(F.col(count) * OFTEN <= total).drop(count)
    seldom = shuffled(seldom) if by_shuffle else seldom
    return rows.join(often, key).unionByName(rows.join(often.select(key), key, "left_anti").join(seldom, key))


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    bare = F.trim(F.translate(text, SPACE[1:], " " * (len(SPACE) - 1)))
    return F.when(text.isNull() | (bare == ""), F.lit(0)).otherwise(F.size(F.split(bare, " +"))).cast("long")
