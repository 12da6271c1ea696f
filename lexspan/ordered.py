"""Scans over sorted rows: running sums and maxima, ranks and order statistics of groups of any size.

Rows are dealt by ranges of (group, order), sorted there and written. A running value is what the ranges
before hold of the group, and what the range itself holds before the row. Ranges know of each other only
one number for each group, so no task holds a group, and no sort meets all rows in one place. Nulls in
group columns are groups of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan import stored

PART, AT = "_part", "_at"


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """left ⋈ right on keys whose nulls are equal."""
    other = right.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    equal = F.lit(True)
    for k in keys:
        equal = equal & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return left.join(other, equal, how).drop(*[f"_of_{k}" for k in keys])


def sorted_rows(df: DataFrame, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """df, written, with its range and the place in it; rows of one (by, order) may lie in any order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, *order]
    dealt = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    rows = stored.written(dealt.withColumn(PART, F.shiftright("_id", 33).cast("int")).withColumn(AT, F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id"))
    return rows


def running(rows: DataFrame, by: Sequence[str], value: Column, name: str, kind: str = "sum", inclusive: bool = True) -> DataFrame:
    """`sorted_rows` with a running sum or maximum of a value within each group, with the row itself or before it."""
    total: Callable[[Column | str], Column] = {"sum": F.sum, "max": F.max}[kind]
    end = Window.currentRow if inclusive else -1
    here = total(value).over(Window.partitionBy(PART, *by).orderBy(AT).rowsBetween(Window.unboundedPreceding, end))
    each = rows.groupBy(PART, *by).agg(total(value).alias("_sum"))  # a row for each range, and one for each group
    earlier = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    each = each.withColumn("_before", total("_sum").over(earlier.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))).drop("_sum")
    out = joined(rows.withColumn("_here", here), each, [PART, *by])
    if kind == "sum":
        scanned = F.coalesce("_before", F.lit(0)) + F.coalesce("_here", F.lit(0))
    else:
        scanned = F.greatest("_before", "_here")
    return out.withColumn(name, scanned).drop("_before", "_here")


def plain(rows: DataFrame) -> DataFrame:
    """Rows without their ranges."""
    return rows.drop(PART, AT)


def distinct_ranks(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, value, times, rank: each distinct value of a group, how often it occurs, and the mean rank of its rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("times"))
    scanned = running(sorted_rows(counts, by, [value]), by, F.col("times"), "_upto")
    return plain(scanned.withColumn("rank", F.col("_upto") - (F.col("times") - 1) / 2.0).drop("_upto"))


def with_average_rank(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """df with the rank of a value within its group, equal values sharing the mean of their ranks; null for null.

    df is read twice. Rows meet the ranks of distinct values, so a frequent value is a skewed side of a
    plain join, which Spark splits.
    """
    ranks = distinct_ranks(df, by, value).drop("times").withColumnRenamed("rank", name)
    return joined(df, ranks, [*by, value], "left")


#: Errors that the summary of `quantiles` may have are 1/ACCURACY of a group's rows; smaller groups are ranked whole.
ACCURACY = 10_000


def quantiles(df: DataFrame, by: Sequence[str], values: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """by, of (which column), share, n, quantile: exact quantiles of columns, interpolated between neighbours; nulls don't count.

    Exact selection: a summary of bounded size brackets each wanted order statistic, which its error
    bound puts between two of its values; a second pass counts what lies below the bracket and ranks the
    distinct values inside, a few of 10,000 rows. df is read twice, so it should be written or cheap.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).cast("double").alias("value")) for c in values])).alias("m")
    long = df.select(*by, each).select(*by, "m.of", "m.value").where("value is not null")
    keys = [*by, "of"]
    slack = 4.0 / ACCURACY
    ends = [e for q in shares for e in (max(q - slack, 0.0), min(q + slack, 1.0))]
    summary = long.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.percentile_approx("value", ends, ACCURACY).alias("ends"))
    end = lambda k, edge: F.col(edge) if ends[k] in (0.0, 1.0) else F.when(F.col("n") <= ACCURACY, F.col(edge)).otherwise(F.col("ends")[k])
    brackets = F.array(*[
        F.struct(
            F.lit(float(q)).alias("share"), (F.lit(float(q)) * (F.col("n") - 1)).alias("position"),
            end(2 * i, "least").alias("lo"), end(2 * i + 1, "most").alias("hi"))
        for i, q in enumerate(shares)])
    brackets = stored.small(summary.select(*keys, "n", F.explode(brackets).alias("b")).select(*keys, "n", "b.*"))
    near = joined(long, brackets, keys)
    inside = near.where((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")))
    below = near.where(F.col("value") < F.col("lo")).groupBy(*keys, "share").agg(F.count("*").alias("below"))
    # Of distinct values in the bracket: at which places, from 0, they stand.
    group = [*keys, "share"]
    ranked = running(sorted_rows(inside.groupBy(*group, "value").agg(F.count("*").alias("times")), group, ["value"]), group, F.col("times"), "upto")
    ranked = joined(joined(plain(ranked), brackets.select(*group, "n", "position"), group), below, group, "left")
    first = F.coalesce("below", F.lit(0)) + F.col("upto") - F.col("times")
    holds = lambda place: F.max(F.when((first <= place) & (place < first + F.col("times")), F.col("value")))
    low, high = F.floor("position"), F.ceil("position")
    found = ranked.groupBy(*group).agg(F.first("n").alias("n"), F.first("position").alias("position"), holds(low).alias("low"), holds(high).alias("high"))
    sure = F.when(F.col("low").isNull() | F.col("high").isNull(), F.raise_error(F.lit("a bracket misses its order statistic")).cast("double"))
    between = F.col("low") + (F.col("high") - F.col("low")) * (F.col("position") - F.floor("position"))
    return found.select(*group, "n", F.coalesce(sure, F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between)).alias("quantile"))


def medians(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """by, median_<column>: exact medians, a column for each."""
    found = quantiles(df, by, values, [0.5])
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("of") == c, F.col("quantile"))).alias(f"median_{c}") for c in values])
