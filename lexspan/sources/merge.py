"""Merge of whole folders of audits: files are matched by their path below the folder, changed samples replaced.

An audit is a file `audit.*.jsonl`, or a folder of that name whose files follow each other by name. Its
rows keep the order in which the base names their samples; each audit of the delta gives one audit of the
output, a folder of that name. Lines stay as they are written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan import stored
from lexspan.sources import publish, readers

#: Fixed value: how audits are called.
AUDIT = r"^((?:[^/]+/)*audit\.[^/]*\.jsonl)(?:/|$)"


def audit_lines(spark: SparkSession, folder: str, key: str = "sample_id") -> DataFrame:
    """audit, sample, path, row, line of all audits below a folder; blank lines are left out."""
    store, where = publish.files(spark, folder)
    root = store.makeQualified(where).toUri().toString().rstrip("/")
    rows = readers.lines(spark, folder, recursiveFileLookup=True)
    same = lambda c: F.regexp_replace(c, "^file:/+", "/")
    below = F.substr(same(F.col("path")), F.length(same(F.lit(root))) + 2)
    rows = rows.withColumn("audit", F.regexp_extract(below, AUDIT, 1)).where("audit <> '' and trim(line) <> ''")
    return rows.select("audit", F.get_json_object("line", f"$.{key}").alias("sample"), "path", "row", "line")


def write_audits(rows: DataFrame, order: list[str], folder: str) -> list[str]:
    """Rows (audit, line, order ...) as one folder of lines for each audit, dealt by ranges; their names."""
    spark = rows.sparkSession
    rows = stored.written(rows)
    names = sorted(r.audit for r in rows.select("audit").distinct().collect())  # audits are one for each model and temperature
    numbers = F.broadcast(spark.createDataFrame(list(enumerate(names)), "number int, audit string"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.join(numbers, "audit").repartitionByRange(n, "number", *order).sortWithinPartitions("number", *order)
    staging = f"{folder.rstrip('/')}.staging-{uuid.uuid4().hex}"
    try:
        dealt.select("number", "line").write.partitionBy("number").option("compression", "none").text(staging)
        for k, name in enumerate(names):
            target = f"{folder.rstrip('/')}/{name}"
            publish.remove(spark, target)
            publish.rename(spark, f"{staging}/number={k}", target)
    finally:
        publish.remove(spark, staging)
    return names


def merge_directories(spark: SparkSession, base_dir: str, delta_dir: str, output_dir: str, changed: DataFrame, key: str = "sample_id") -> list[str]:
    """The audits of delta_dir, each merged with its base and written to output_dir.

    Fails where nothing changed, the delta has no audits, an audit has no base, or an audit lacks a changed
    sample in its base or delta or has one in its delta that did not change.
    """
    ids = stored.written(changed.select(F.col(key).cast("string").alias("sample")).distinct())
    if ids.isEmpty():
        raise ValueError("no changed samples")
    try:
        delta = audit_lines(spark, delta_dir, key)
        base = audit_lines(spark, base_dir, key)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(str(e)) from e
        raise
    wanted = {r.audit for r in delta.select("audit").distinct().collect()}
    if not wanted:
        raise FileNotFoundError(f"no audits below {delta_dir}")
    missing = wanted - {r.audit for r in base.select("audit").distinct().collect()}
    if missing:
        raise FileNotFoundError(f"no base for {sorted(missing)}")
    base = base.where(F.col("audit").isin(*wanted))
    # The place of a sample is that of its first row in the base; one check over all audits and samples.
    first = stored.written(base.groupBy("audit", "sample").agg(F.min(F.struct("path", "row")).alias("first")))
    ids = stored.small(ids)
    n_ids = ids.count()
    new = delta.select("audit", "sample").distinct()
    strange = new.join(ids, "sample", "left_anti").select("audit", "sample", F.lit("unexpected").alias("why"))
    held = lambda side: side.join(ids, "sample", "left_semi").groupBy("audit").agg(F.count("*").alias("n"))
    audits = spark.createDataFrame([(a,) for a in sorted(wanted)], "audit string")
    short = [audits.join(held(side), "audit", "left").where(F.coalesce("n", F.lit(0)) < n_ids).select("audit", F.lit(None).cast("string").alias("sample"), F.lit(why).alias("why")) for side, why in ((new, "missing in the delta"), (first, "missing in the base"))]
    bad = strange.union(short[0]).union(short[1]).limit(5).collect()
    if bad:
        raise ValueError("cannot merge " + "; ".join(f"{r.audit}: {r['sample'] or 'samples'} {r.why}" for r in bad))
    rows = base.join(ids, "sample", "left_anti").unionByName(delta.join(ids, "sample", "left_semi"))
    return write_audits(rows.join(first, ["audit", "sample"]).select("audit", "line", "first", "path", "row"), ["first", "path", "row"], output_dir)
