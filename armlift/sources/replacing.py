"""Replacing a written table so that a failed write leaves the old one readable."""

from __future__ import annotations

import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

# names beside a table: one that is being written, and one that gives way
NEW, OLD = ".new-", ".old-"


def file_system(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """File system of a path, and the path as it knows it."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()), place


def replace_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write ``df`` beside the table and put it in its place when it is whole.

    Until then readers see the old table, and a write that fails leaves it as it was. The
    place changes by two renames; where a run ends between them, ``restored`` brings the old
    table back. ``df`` may be read from the table itself.
    """
    spark, mark = df.sparkSession, uuid.uuid4().hex
    restored(spark, path)
    fs, target = file_system(spark, path)
    beside = lambda name: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + name)
    new, old = (beside(f"{name}{mark}") for name in (NEW, OLD))
    try:
        df.write.format(kind).save(new.toString())
    except BaseException:
        fs.delete(new, True)
        raise
    there = fs.exists(target)
    if there:
        renamed(fs, target, old)
    renamed(fs, new, target)
    if there:
        fs.delete(old, True)


def restored(spark: SparkSession, path: str) -> None:
    """Bring back the old table where a run ended between the two renames."""
    fs, target = file_system(spark, path)
    if fs.exists(target):
        return
    waiting = fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}{OLD}*"))
    if waiting:
        renamed(fs, max(waiting, key=lambda s: s.getModificationTime()).getPath(), target)


def renamed(fs: JavaObject, source: JavaObject, target: JavaObject) -> None:
    if not fs.rename(source, target):
        raise OSError(f"could not rename {source.toString()} to {target.toString()}")

