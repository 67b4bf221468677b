"""Look-backs over daily grids and monthly precipitation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.operators.asof import per_distinct

CELL_DAY = ("row", "col", "d")


def pack_years(grid: DataFrame, out: str = "series", wanted: DataFrame | None = None) -> DataFrame:
    """Daily grid to one array per cell and year, day of year 1 first; missing days are NULL. A day that a cell has twice is an error
    while running. ``wanted`` has the (row, col, _y) to pack; other days of the grid are dropped before anything is packed."""
    days = F.array_sort(F.collect_list(F.struct(F.dayofyear("date").alias("k"), F.col("value").alias("x"))))
    grid = grid.select("row", "col", F.year("date").alias("_y"), "date", "value")
    if wanted is not None:
        grid = grid.join(wanted, ["row", "col", "_y"], "left_semi")
    packed = grid.groupBy("row", "col", "_y").agg(days.alias("_d"))  # at most 366 entries
    gapless = F.transform("_d", lambda e: e["x"])
    none = F.lit(None).cast("double")
    spread = F.aggregate("_d", F.array().cast("array<double>"), lambda a, e: F.concat(
        a, F.array_repeat(none, e["k"] - F.size(a) - 1), F.array(e["x"])))
    twice = F.size(F.array_distinct(F.transform("_d", lambda e: e["k"]))) < F.size("_d")
    series = F.when(twice, F.raise_error(F.lit("a cell has a day twice")).cast("array<double>")) \
        .when(F.element_at("_d", -1)["k"] == F.size("_d"), gapless).otherwise(spread)
    return packed.select("row", "col", "_y", series.alias(out))


def daily_window_lookup(samples: DataFrame, grid: DataFrame, ndays: int, out: str = "lags") -> DataFrame:
    """Array of the grid values on the sample's day and the ndays-1 days before.

    Days before 1 January of the sample's year and cells off the grid give NULL. A cell's year is one array,
    so a look-back is a few array reads after one join and no row is multiplied by its days.
    """

    def lookup(keys: DataFrame) -> DataFrame:
        day = F.dayofyear("d")
        dated = keys.withColumn("_y", F.year("d"))
        found = dated.join(pack_years(grid, "_s", dated.select("row", "col", "_y").distinct()), ["row", "col", "_y"])
        return found.select(*CELL_DAY, F.transform(F.sequence(F.lit(0), F.lit(ndays - 1)),
                                                   lambda k: F.when(k < day, F.get("_s", day - 1 - k))).alias(out))

    found = per_distinct(samples, CELL_DAY, lookup)
    empty = F.array_repeat(F.lit(None).cast("double"), F.lit(ndays))
    return found.withColumn(out, F.coalesce(out, empty))


def agg_tail(lags: Column, start: int, prefix: str) -> list[Column]:
    """First ``start`` entries as columns, then minimum, mean and maximum of the rest without NULLs."""
    rest = F.filter(F.slice(lags, start + 1, F.size(lags)), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(rest, F.lit(0.0), lambda a, x: a + x), F.size(rest))
    head = [F.get(lags, F.lit(k)).alias(f"{prefix}_{k}") for k in range(start)]
    return [*head, F.array_min(rest).alias(f"{prefix}_hist_min"), mean.alias(f"{prefix}_hist_mean"),
            F.array_max(rest).alias(f"{prefix}_hist_max")]


def add_weather(samples: DataFrame, grid: DataFrame, var: str, ndays: int, agg_start: int) -> DataFrame:
    found = daily_window_lookup(samples, grid, ndays, "_lags")
    return found.select(*samples.columns, *agg_tail(F.col("_lags"), agg_start, f"x_{var}"))


def add_fire_weather_index(samples: DataFrame, grid: DataFrame, rename: str = "fwi") -> DataFrame:
    """Grid value on the sample's own day."""
    day = grid.select("row", "col", F.col("date").alias("d"), F.col("value").alias(f"x_{rename}"))
    return samples.join(day, list(CELL_DAY), "left").select(*samples.columns, f"x_{rename}")


def monthly_means(daily: DataFrame, cell: Sequence[str] = ("row", "col")) -> DataFrame:
    """Daily values to one value per month, the input of the deficit."""
    return daily.groupBy(*cell, F.year("date").alias("year"), F.month("date").alias("month")).agg(F.avg("value").alias("value"))


def precip_deficit(precip: DataFrame, targets: DataFrame, n_climate: int, n_deficit: int, out: str = "rpd") -> DataFrame:
    """Relative precipitation deficit at each (row, col, year, month) of ``targets``, all targets at once.

    The last n_deficit years before the target month are compared with the mean of the n_climate years
    before them, per calendar month. Both steps are rolling windows: along the years of one calendar
    month, then along the twelve months before the target. One cell's series stays in one partition.
    """
    t = targets.select("row", "col", (F.col("year") * 12 + F.col("month") - 1).alias("_t")).distinct()
    need = t.select("row", "col", F.explode(F.sequence(F.col("_t") - 12, F.col("_t"))).alias("_m"), F.lit(None).cast("double").alias("value"))
    series = precip.select("row", "col", (F.col("year") * 12 + F.col("month") - 1).alias("_m"), "value").unionByName(need) \
        .repartition("row", "col").groupBy("row", "col", "_m").agg(F.max("value").alias("value"))
    year, cal = F.floor(F.col("_m") / 12), F.col("_m") % 12
    by_year = Window.partitionBy("row", "col", "_c").orderBy("_y")
    climate_years = by_year.rangeBetween(-(n_deficit + n_climate - 1), -n_deficit)
    actual_years = by_year.rangeBetween(-(n_deficit - 1), 0)
    per_month = series.withColumn("_y", year).withColumn("_c", cal) \
        .withColumn("_clim", F.avg("value").over(climate_years)) \
        .withColumn("_def", F.count("value").over(actual_years) * F.col("_clim") - F.coalesce(F.sum("value").over(actual_years), F.lit(0.0)))
    year_before = Window.partitionBy("row", "col").orderBy("_m").rangeBetween(-12, -1)
    rpd = F.try_divide(F.sum("_def").over(year_before), F.sum("_clim").over(year_before) * n_deficit)
    found = per_month.withColumn(out, rpd).select("row", "col", F.col("_m").alias("_t"), out)
    return t.join(found, ["row", "col", "_t"]).select(
        "row", "col", F.floor(F.col("_t") / 12).cast("int").alias("year"), (F.col("_t") % 12 + 1).cast("int").alias("month"), out)


def add_precip_deficit(samples: DataFrame, precip: DataFrame, n_climate: int, n_deficit: int, rename: str = "rpd") -> DataFrame:
    dated = samples.withColumns({"year": F.year("d"), "month": F.month("d")})
    found = per_distinct(dated, ["row", "col", "year", "month"],
                         lambda k: precip_deficit(precip, k, n_climate, n_deficit, f"x_{rename}"))
    return found.select(*samples.columns, f"x_{rename}")
