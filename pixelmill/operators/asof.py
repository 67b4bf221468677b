"""Most recent layer before a day, and file listings in time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_distinct(samples: DataFrame, keys: Sequence[str], lookup: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a lookup once per distinct key and join its columns back.

    Many samples share a grid cell and day, so everything expensive works on unique keys; the last join
    has a unique side, which AQE can pair with a split hot partition of the samples. A NULL key finds nothing.
    """
    found = lookup(samples.select(*keys).distinct())
    new = [c for c in found.columns if c not in keys]
    return samples.join(found, list(keys), "left").select(*samples.columns, *new)


def asof_dates(wanted: DataFrame, layers: DataFrame, max_days: int, include_same_day: bool = False,
               keys: Sequence[str] = ("v", "h"), day: str = "d") -> DataFrame:
    """For each wanted (tile, day) the last layer date in [day - max_days, day), or up to day itself.

    Layer dates and wanted days go through one window per tile, which holds calendar days only.
    """
    late, early = (1, 0) if include_same_day else (0, 1)
    marks = layers.select(*keys, F.col("date").alias(day), F.col("date").alias("layer_date"), F.lit(early).alias("_ord"),
                          F.lit(False).alias("_want")).distinct() \
        .unionByName(wanted.select(*keys, day, F.lit(None).cast("date").alias("layer_date"), F.lit(late).alias("_ord"),
                                   F.lit(True).alias("_want")))
    w = Window.partitionBy(*keys).orderBy(day, "_ord").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("layer_date", ignorenulls=True).over(w)
    return marks.withColumn("layer_date", last).filter("_want").select(
        *keys, day, F.when(F.datediff(day, "layer_date") <= max_days, F.col("layer_date")).alias("layer_date"))


def asof_layer(samples: DataFrame, layers: DataFrame, max_days: int, include_same_day: bool = False,
               keys: Sequence[str] = ("v", "h"), day: str = "d") -> DataFrame:
    """Add ``layer_date``, the date of the most recent layer of the sample's tile; NULL if none."""
    return per_distinct(samples, [*keys, day],
                        lambda k: asof_dates(k, layers.select(*keys, "date"), max_days, include_same_day, keys, day))


def asof_values(samples: DataFrame, cells: DataFrame, max_days: int, include_same_day: bool = False,
                day: str = "d", out: str = "value", dates: DataFrame | None = None) -> DataFrame:
    """Value of the most recent layer at the sample's own cell. ``dates`` lists (v, h, date) of the layers; without it they are taken from the
    cells. Of the cells only layers that some sample looks at are joined."""
    found = cells.select("v", "h", "date").distinct() if dates is None else dates
    dated = asof_layer(samples, found, max_days, include_same_day, day=day)
    wanted = dated.select("v", "h", F.col("layer_date").alias("date")).distinct()
    values = cells.join(wanted, ["v", "h", "date"], "left_semi").select("v", "h", "i", "j", F.col("date").alias("layer_date"), F.col("value").alias(out))
    return dated.join(values, ["v", "h", "i", "j", "layer_date"], "left")


def latest_per_group(idx: DataFrame, by: Sequence[str], date: str = "date", path: str = "path") -> DataFrame:
    """Last file by date per group; equal dates are settled by path."""
    return idx.groupBy(*by).agg(F.max_by(path, F.struct(date, path)).alias(path), F.max(date).alias(date))


def previous_month_layer(idx: DataFrame, require: bool = False) -> DataFrame:
    """Add the path of the same tile's layer one month earlier."""
    month = F.trunc("date", "MM")
    before = idx.select("product", "v", "h", F.add_months(month, 1).alias("_m"), F.col("path").alias("previous_path")) \
        .groupBy("product", "v", "h", "_m").agg(F.min("previous_path").alias("previous_path"))
    out = idx.withColumn("_m", month).join(before, ["product", "v", "h", "_m"], "left").drop("_m")
    if require:
        out = out.withColumn("previous_path", F.coalesce("previous_path", F.raise_error(
            F.concat(F.lit("no layer one month before "), F.col("path"))).cast("string")))
    return out
