"""Tables and files written between steps, in the folder that all executors share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from lexspan.stored import ARROW_ROWS, shared_dir, small_batches  # noqa: F401 - the operators take them from here

#: Estimates from here on are of plans whose size Spark doesn't know.
UNKNOWN = 1 << 50

_made: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path that no other run uses; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/lexspan-{uuid.uuid4().hex}/{name}"
    _made.append((spark, path.rpartition("/")[0]))
    return path


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"{name}_{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Remove a written table early, once no result reads it any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of `df`: write it as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(df: DataFrame) -> None:
    """Drop what `written` wrote for `df`."""
    drop(df.sparkSession, df._scratch_path)


def give_back() -> None:
    """Return to the system what Python has freed: the allocator keeps it else, for as long as the driver lives."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def parts(df: DataFrame, size: int) -> int:
    """How many parts of `size` bytes the rows make, as Spark estimates them, but no fewer than shuffle partitions."""
    n_bytes = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-n_bytes // size)) if n_bytes < UNKNOWN else least


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended before us
            pass
