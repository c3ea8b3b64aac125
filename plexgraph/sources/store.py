"""Versioned snapshots of a graph as partitioned Parquet, with a pointer that flips when a version is complete."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file at once: to a sibling first, then by a rename that replaces the old one, so a reader always sees one."""
    fs, target = _fs(spark, path)
    temporary = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(temporary, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    target = fs.makeQualified(target)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(fs.makeQualified(temporary), target, how)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0][0] if rows else ""


def save(root: str, tables: dict[str, DataFrame]) -> str:
    """Write tables as a new version and make it the current one; readers of the old one aren't disturbed.

    Tables with a column ``label`` or ``rel_type`` are partitioned by it, so that filters on it prune files.
    """
    version = uuid.uuid4().hex
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        by = [c for c in ("label", "rel_type") if c in df.columns][:1]
        df.write.partitionBy(*by).parquet(f"{root}/{version}/{name}")
    write_text(spark, f"{root}/CURRENT", version)
    return version


def load(spark: SparkSession, root: str, name: str, version: str | None = None) -> DataFrame | None:
    """A table of the current or a given version; null if there is none."""
    version = version or read_text(spark, f"{root}/CURRENT")
    return spark.read.parquet(f"{root}/{version}/{name}") if version else None


def indexed_files(nodes: DataFrame) -> DataFrame:
    """(path, sha) of the file nodes."""
    return nodes.where("label = 'file'").select(F.col("file_path").alias("path"), F.sha2("content", 256).alias("sha"))


def write_manifest(root: str, manifest: DataFrame, stamp: dict) -> None:
    spark = manifest.sparkSession
    version = uuid.uuid4().hex
    manifest.write.parquet(f"{root}/manifests/{version}")
    write_text(spark, f"{root}/MANIFEST", json.dumps(stamp | {"manifest_version": VERSION, "table": version}))


def read_manifest(spark: SparkSession, root: str) -> tuple[DataFrame, dict] | None:
    """The manifest and its stamp; null if it is missing, of another version, or broken."""
    text = read_text(spark, f"{root}/MANIFEST")
    try:
        stamp = json.loads(text or "")
        if stamp["manifest_version"] != VERSION:
            return None
        return spark.read.parquet(f"{root}/manifests/{stamp['table']}"), stamp
    except (ValueError, KeyError, TypeError):
        return None


def write_meta(spark: SparkSession, folder: str, name: str, path: str, nodes: DataFrame, edges: DataFrame) -> None:
    """``meta.json`` for the registry: counts by label and by kind of edge."""
    counts = {r[0]: r[1] for r in nodes.groupBy("label").count().collect()} | {r[0]: r[1] for r in edges.groupBy("rel_type").count().collect()}
    now = spark.sql("SELECT date_format(now(), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")").first()[0]
    write_text(spark, f"{folder}/{name}/meta.json", json.dumps({"name": name, "path": path, "last_indexed_at": now, "stats": counts}))
