"""Ordered series: every function takes a panel of series and partitions by the series key.

Rows are (series, ...) with a time column; a window never spans series, so work spreads over them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldline.functions.classes import direction


def indexed(df: DataFrame, series: str = "series", time: str = "bucket", name: str = "i") -> DataFrame:
    """The chronological position of each row in its series, from 0."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(series).orderBy(time)) - 1).cast("long"))


def history_features(df: DataFrame, series: str = "series", time: str = "bucket", rate: str = "rate", change: str = "change_bp") -> DataFrame:
    """Six numbers known at each origin.

    rate_now, change_now (in points, 100 bp each), change_before (0 at the first), change_mean3 (of the last three
    changes or fewer, this one included), steps_since (time since the origin before, 0 at the first), has_before.
    """
    order = Window.partitionBy(series).orderBy(time)
    before = F.lag(time).over(order)
    points = F.col(change) / F.lit(100.0)
    return df.select(
        "*",
        F.col(rate).alias("rate_now"),
        points.alias("change_now"),
        F.coalesce(F.lag(points).over(order), F.lit(0.0)).alias("change_before"),
        # An integer sum before the division: the same double in whatever order rows are added.
        (F.sum(change).over(order.rowsBetween(-2, 0)) / (100.0 * F.count(change).over(order.rowsBetween(-2, 0)))).alias("change_mean3"),
        F.coalesce(F.col(time) - before, F.lit(0)).cast("long").alias("steps_since"),
        before.isNotNull().cast("int").alias("has_before"),
    )


def targets(df: DataFrame, width: float, lag: Column, series: str = "series", time: str = "bucket", change: str = "change_bp") -> DataFrame:
    """What each origin forecasts: the next change, its direction, and when that is published (`lag` after the next time).

    The last origin of a series has no target: its label_status is unobserved.
    """
    order = Window.partitionBy(series).orderBy(time)
    after = F.lead(time).over(order)
    return df.select(
        "*",
        F.lead(change).over(order).alias("action_bp"),
        direction(F.lead(change).over(order), width).alias("direction"),
        (after + lag).cast("long").alias("target_pub"),
        F.when(after.isNull(), "unobserved").otherwise("observed").alias("label_status"),
    )


def split_name(index: Column, bounds: Sequence[tuple[int, str]], last: str) -> Column:
    """The name of the first bound above the index, or `last`."""
    out = None
    for bound, name in bounds:
        out = F.when(index < bound, name) if out is None else out.when(index < bound, name)
    return out.otherwise(last)


def asof_before(left: DataFrame, right: DataFrame, key: str, time: str, value: str, strict: bool = True) -> DataFrame:
    """`left` with the value of `right` at its last time before (or, unless strict, at) each left time, per key; null if none.

    One sort per key instead of a range join: both sides are put in one order, and the last value seen is carried
    forward. At equal times a strict join puts left rows first. Both sides have the columns `key` and `time`.
    """
    first, second = (0, 1) if strict else (1, 0)
    rows = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(first).alias("_side"))
    fill = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in (key, time) else F.col(f.name) for f in left.schema]
    seen = right.select(*fill, F.col(value).alias("_v"), F.lit(second).alias("_side"))
    order = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = rows.unionByName(seen).withColumn(value, F.last("_v", ignorenulls=True).over(order))
    return carried.where(F.col("_side") == first).drop("_v", "_side")
