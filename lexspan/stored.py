"""Tables written between steps, in the folder that all executors share, and numbers of sorted rows."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tables of up to so many rows are broadcast.
BROADCAST_ROWS = 100_000
#: Rows of a batch that goes to a Python worker.
ARROW_ROWS = 1_000

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; where unset, a temporary one, on a single machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.gettempdir()}/lexspan-steps"
    return named.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def folder(spark: SparkSession) -> str:
    """A new path in the shared folder, which goes when the driver ends."""
    path = f"{shared_dir(spark)}/lexspan-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df`: write it as Parquet and read it back; it goes when the driver ends."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """df, written, and to be broadcast where it has few rows."""
    rows = written(df)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of ARROW_ROWS at most, from now on in this session: texts can be long,
    and both sides keep the memory of the largest batches that they have seen."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores where its files make fewer tasks than there are cores (small inputs only)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def numbered(df: DataFrame, order: list[Column], name: str = "number", dealt: int | None = None) -> DataFrame:
    """df, written, with numbers 1, 2, ... in a total order, without one task that holds all rows.

    Rows are dealt by ranges and sorted there; the number of a row is its place in its range and the
    sizes of the ranges before it, of which there are as many as shuffle partitions. Ranges are of the
    first `dealt` columns alone where that is given: the driver gets a sample of these, so texts should stay out.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order[:dealt]).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = written(rows)
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")  # one row for each range
    sizes = F.broadcast(sizes.select("_part", before.alias("_before")))
    out = rows.join(sizes, part == F.col("_part"))
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_part", "_n", "_before")


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended before us
            pass
