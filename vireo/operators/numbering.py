"""Places of rows in a global order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranges(df: DataFrame, key: str) -> Column:
    """A range's number for a numeric key (null keys are in the first).

    Approximate quantiles, at most one a shuffle partition, cut the keys.  The bounds are literals, so a task that runs again deals
    alike; only their number reaches the driver.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = []
    if parts > 1:
        bounds = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or []
    return F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b < F.col(key))) if bounds else F.lit(0)


def _before(placed: DataFrame, size: Column) -> DataFrame:
    """_range, _before: sizes of all ranges before each; one row a range."""
    sizes = placed.groupBy("_range").agg(size.alias("_n"))
    return F.broadcast(sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")))


def numbered(df: DataFrame, key: str, name: str = "k") -> DataFrame:
    """df with ``name``, the place from 1 of each row in the order of a numeric, nearly unique key (nulls first).

    Ranges of keys are counted, and rows are numbered within their range on top of the counts before it.  Rows that share a key are
    numbered in any order among themselves.
    """
    placed = df.withColumn("_range", ranges(df, key))
    row = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return placed.join(_before(placed, F.count(F.lit(1))), "_range").withColumn(name, row + F.col("_before")).drop("_range", "_before")


def ranked(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with ``name``, the rank from 1 of a number among all rows; rows that share a number share the mean of their places.

    Values are counted first, so sorting is over distinct ones, by range.  Rows without the number are left out.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_size"))
    placed = counts.withColumn("_range", ranges(counts, value))
    until = F.sum("_size").over(Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranks = placed.join(_before(placed, F.sum("_size")), "_range").select(value, (F.col("_before") + until - F.col("_size") + (F.col("_size") + 1) / 2).alias(name))
    return df.join(ranks, value)
