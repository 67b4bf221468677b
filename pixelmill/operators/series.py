"""Rolling and running values along an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.operators import ranks

CHUNK = 1 << 16


def rolling(df: DataFrame, y: str, order: Column, tie: Sequence[Column], n: int, by: Sequence[str] = (), chunk: int = CHUNK) -> DataFrame:
    """Trailing mean and sample deviation of n rows, NULL until n values exist, and the band mean +- std/2.

    Rows are numbered first and then cut into chunks that start with the n-1 rows before them, so one long
    series does not end up in one task.
    """
    size = max(chunk, n)
    r = ranks.row_index(df, order, tie, by, "_r")
    home = F.floor((F.col("_r") - 1) / size)
    also = (F.col("_r") - 1) % size >= size - (n - 1)
    r = r.withColumn("_home", home).withColumn("_c", F.explode(F.when(also, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))))
    w = Window.partitionBy(*by, "_c").orderBy("_r").rowsBetween(-(n - 1), 0)
    full = F.count(y).over(w) == n
    r = r.withColumns({"rolling_mean": F.when(full, F.avg(y).over(w)), "rolling_std": F.when(full, F.stddev_samp(y).over(w))})
    return r.filter(F.col("_c") == F.col("_home")).withColumns({
        "band_lo": F.col("rolling_mean") - F.col("rolling_std") / 2,
        "band_hi": F.col("rolling_mean") + F.col("rolling_std") / 2}).drop("_r", "_c", "_home")


def running_max(bins: DataFrame, value: str, by: Sequence[str], order: str, out: str) -> DataFrame:
    """Cumulative maximum along ``order``, stretched so that each group ends at 1. For bin tables."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    df = bins.withColumn("_m", F.max(value).over(w))
    lo, hi = F.min("_m").over(whole), F.max("_m").over(whole)
    share = F.try_divide(F.col("_m") - lo, hi - lo)
    return df.withColumn(out, share * (1 - lo) + lo).drop("_m")


def non_decreasing(df: DataFrame, value: str, by: Sequence[str], order: str) -> DataFrame:
    """Per group: no step goes down. For bin tables."""
    step = F.col(value) >= F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("_s", step).groupBy(*by).agg(F.coalesce(F.bool_and("_s"), F.lit(True)).alias("non_decreasing"))
