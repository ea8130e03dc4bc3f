"""Running totals that hold up when one key owns much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def running_total(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str,
                  block: int = 65536) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the earlier rows of the same keys.

    ``order`` starts with a non-negative number. Rows are cut into blocks of it; block totals are a
    partial aggregate, their running sum sees one row per block, and the last window sorts one block
    at a time. So no key is ever sorted as a whole.
    """
    blocked = rows.withColumn("_block", F.floor(F.col(order[0]) / block)).withColumn("_value", value)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
        .select(*keys, "_block", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocked.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(offsets, [*keys, "_block"])
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_block", "_value", "_inside", "_offset")
    )
