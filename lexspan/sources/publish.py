"""Publication in stages: results are written beside their place, read back, checked, and only then put there.

What stands at a path is either the old version, whole, or the new one, whole and checked. A run that is
lost leaves the old version, under its own name or, for a moment between two renames, under that of
`_old`; `restore`, which every call begins with, puts it back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Refused(ValueError):
    """What was written did not pass its check."""


def files(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it wants it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = files(spark, path)
    return store.exists(where)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Rename, in one step of the file system; FileExistsError if the target is there, OSError if it fails."""
    store, where = files(spark, target)
    if store.exists(where):
        raise FileExistsError(target)
    store.mkdirs(where.getParent())
    if not store.rename(files(spark, source)[1], where):
        raise OSError(f"could not rename {source} to {target}")


def remove(spark: SparkSession, path: str) -> None:
    store, where = files(spark, path)
    store.delete(where, True)


def _old(path: str) -> str:
    return f"{path.rstrip('/')}.old"


def restore(spark: SparkSession, path: str) -> None:
    """Mend what a lost run left: the old version goes back if there is no new one, else it goes."""
    if exists(spark, _old(path)):
        if exists(spark, path):
            remove(spark, _old(path))
        else:
            rename(spark, _old(path), path)


def publish(df: DataFrame, path: str, check: Callable[[DataFrame], DataFrame], kind: str = "parquet") -> DataFrame:
    """Write df, check what can be read back (one row with `valid`), and put it at a path; Refused keeps the old version."""
    spark = df.sparkSession
    restore(spark, path)
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    try:
        df.write.format(kind).save(staging)
        found = check(spark.read.schema(df.schema).format(kind).load(staging)).first()
        if not found or not found["valid"]:
            raise Refused(f"{path}: {found.asDict() if found else 'the check gave no row'}")
        if exists(spark, path):
            rename(spark, path, _old(path))
        try:
            rename(spark, staging, path)
        except Exception:
            restore(spark, path)
            raise
        remove(spark, _old(path))
    finally:
        remove(spark, staging)
    return read(spark, path, df.schema, kind)


def read(spark: SparkSession, path: str, schema, kind: str = "parquet") -> DataFrame:
    """What is published at a path."""
    restore(spark, path)
    return spark.read.schema(schema).format(kind).load(path)
