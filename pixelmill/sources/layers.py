"""Layers, grids, indicator tables and sample partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelmill.functions import scalars as s

# Names of the header lines of ASCII grids.
HEADER = ("nrows", "ncols", "xllcorner", "yllcorner", "xllcenter", "yllcenter", "cellsize", "nodata_value")

# Fixed value: form of a well-formed layer file name.
LAYER_NAME = r"^[A-Z_0-9]+\.A[12][0-9]{6}\.h[0-9]{2}v[0-9]{2}\.[0-9]{3}\.[0-9]{8,}\.hdf$"


def read_layer(cells: DataFrame, product: str, var: str, date=None) -> DataFrame:
    """One variable of a product, on one date or all. product, var and date are partition columns of a
    stored cell table, so this prunes whole directories."""
    out = cells.filter((F.col("product") == product) & (F.col("var") == var))
    return out if date is None else out.filter(F.col("date") == date)


def explode_rows(rows: DataFrame) -> DataFrame:
    """Row-array storage (one array per raster row) to one row per cell, NaN dropped to NULL."""
    keep = [c for c in rows.columns if c != "vals"]
    return rows.select(*keep, F.posexplode("vals").alias("j", "value")) \
        .withColumn("value", F.nullif("value", F.lit(float("nan"))))


def pack_rows(cells: DataFrame, ncols: int) -> DataFrame:
    """Cells to row-array storage; missing cells become NULL entries."""
    keep = [c for c in cells.columns if c not in ("j", "value")]
    packed = cells.groupBy(*keep).agg(F.map_from_entries(F.collect_list(F.struct("j", "value"))).alias("_m"))
    return packed.select(*keep, F.transform(F.sequence(F.lit(0), F.lit(ncols - 1)),
                                            lambda k: F.try_element_at("_m", k)).alias("vals"))


def read_population_grid(grid: DataFrame, year: int, nodata: Sequence[float]) -> DataFrame:
    """One year of a single-band grid with its no-data values as NULL."""
    return grid.filter(F.col("year") == year).withColumn("value", s.nodata_to_null(F.col("value"), nodata))


def _is_header(line: Column) -> Column:
    return F.lower(F.regexp_extract(line, r"^(\S+)", 1)).isin(*HEADER)


def ascii_cells(header: DataFrame, rows: DataFrame) -> DataFrame:
    """Cells (path, row, col, x, y, value) from the header lines (path, value) and the lines of numbers (path, row, value) of ASCII grids."""
    header = header.select("path", F.lower(F.regexp_extract("value", r"^(\S+)", 1)).alias("k"), F.regexp_extract("value", r"\s(\S+)$", 1).cast("double").alias("x")) \
        .groupBy("path").agg(*[F.max(F.when(F.col("k") == k, F.col("x"))).alias(k) for k in HEADER])
    cells = rows.select("path", "row", F.posexplode(F.split("value", r"\s+")).alias("col", "_t")).join(header, "path")
    value = F.nanvl(F.col("_t").cast("double"), F.lit(None).cast("double"))
    west = F.coalesce(F.col("xllcorner"), F.col("xllcenter") - F.col("cellsize") / 2)
    south = F.coalesce(F.col("yllcorner"), F.col("yllcenter") - F.col("cellsize") / 2)
    return cells.select(
        "path", "row", "col", (west + (F.col("col") + 0.5) * F.col("cellsize")).alias("x"),
        (south + (F.col("nrows") - F.col("row") - 0.5) * F.col("cellsize")).alias("y"),
        F.when(F.col("nodata_value").isNull() | ~s.isclose(value, F.col("nodata_value")), value).alias("value"))


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """ASCII grids: key-value header lines, then rows of numbers. Gives path, row, col, x, y, value.

    Lines are numbered inside each file block and shifted by the lines of the blocks before it.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_blk"),
        F.monotonically_increasing_id().alias("_id"), F.trim("value").alias("value")).filter("value <> ''")
    data = lines.filter(~_is_header(F.col("value")))
    before = Window.partitionBy("path").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = data.groupBy("path", "_blk").agg(F.count(F.lit(1)).alias("_n")) \
        .select("path", "_blk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    in_block = F.row_number().over(Window.partitionBy("path", "_blk").orderBy("_id")) - 1
    rows = data.withColumn("row", in_block).join(offsets, ["path", "_blk"]) \
        .withColumn("row", (F.col("row") + F.col("_off")).cast("int"))
    return ascii_cells(lines.filter(_is_header(F.col("value"))), rows)


def read_indicator(wide: DataFrame, code: str, years: Sequence[int], names: Sequence[str] = ("Country Name", "Country Code"),
                   code_col: str = "Indicator Code") -> DataFrame:
    """One indicator of a table that is wide by year, as (country_long, country_iso3, year, indicator_value)."""
    cols = [str(y) for y in years]
    return wide.filter(F.col(code_col) == code).select(*names, *[F.col(f"`{c}`").cast("double") for c in cols]) \
        .unpivot(list(names), cols, "year", "indicator_value") \
        .select(F.col(names[0]).alias("country_long"), F.col(names[1]).alias("country_iso3"),
                F.col("year").cast("int").alias("year"), "indicator_value")


def read_daily_grid(grid: DataFrame, year: int, check: bool = True, cell: Sequence[str] = ("row", "col")) -> DataFrame:
    """One year of a daily grid; with ``check`` it fails while running unless every cell has every day of the year."""
    out = grid.filter(F.year("date") == year)
    if not check:
        return out
    days = F.dayofyear(F.make_date(F.lit(year), F.lit(12), F.lit(31)))
    per_cell = out.groupBy(*cell).agg(F.count_distinct("date").alias("n"))
    complete = per_cell.agg((F.min("n") == days).alias("ok")).scalar()
    value = F.when(complete, F.col("value")).otherwise(F.raise_error(F.lit(f"incomplete year {year}")).cast("double"))
    return out.withColumn("value", value)


def read_boundaries(df: DataFrame, ring: str = "ring") -> DataFrame:
    """Polygons as ``rings``, an array of rings of (lon, lat), with the bounding box of all of them.

    ``ring`` is such an array, a single ring, or JSON text: [[lon, lat], ...], a polygon [[[lon, lat], ...], ...] with its holes, or several
    polygons [[[[lon, lat], ...], ...], ...]. Parts and holes need not be told apart: what an odd number of rings covers is inside."""
    kind = dict(df.dtypes)[ring]
    given = F.col(ring)
    if kind == "string":
        depth = [F.from_json(given, f"{'array<' * k}double{'>' * k}") for k in (2, 3, 4)]
        opening = F.length(F.regexp_replace(F.regexp_extract(given, r"^[\s\[]*", 0), r"\s", ""))
        rings = F.when(opening == 2, F.array(depth[0])).when(opening == 3, depth[1]).when(opening == 4, F.flatten(depth[2]))
        rings = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))))
    else:
        rings = given if kind.startswith("array<array<") else F.array(given)
    df = df.withColumn("rings", rings)

    def bound(pick, part: str) -> Column:
        return pick(F.transform(F.flatten("rings"), lambda p: p[part]))

    return df.withColumns({"xmin": bound(F.array_min, "lon"), "xmax": bound(F.array_max, "lon"),
                           "ymin": bound(F.array_min, "lat"), "ymax": bound(F.array_max, "lat")})


def file_index(paths: DataFrame, path_col: str = "path", drop_duplicates: bool = True) -> DataFrame:
    """Product, date and tile from layer file names."""
    if drop_duplicates:
        paths = paths.dropDuplicates([path_col])
    parts = s.parse_layer_name(F.col(path_col))
    return paths.select("*", s.base_name(F.col(path_col)).alias("fname"), parts["product"].alias("product"),
                        parts["date"].alias("fname_date"), parts["v"].alias("tile_v"), parts["h"].alias("tile_h"))


def only_valid_file_names(paths: DataFrame, path_col: str = "path") -> DataFrame:
    return paths.filter(s.base_name(F.col(path_col)).rlike(LAYER_NAME))


def layer_catalog(cells: DataFrame) -> DataFrame:
    """Variables and dates of each product."""
    return cells.select("product", "var", "date").distinct()


def save_samples(samples: DataFrame, root: str) -> None:
    """Write samples by (year, v, h); only the partitions in the frame are replaced."""
    samples.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("year", "v", "h").parquet(root)


def load_samples(spark: SparkSession, root: str, year: int, v: int | None = None, h: int | None = None) -> DataFrame:
    out = spark.read.parquet(root).filter(F.col("year") == year)
    for name, k in (("v", v), ("h", h)):
        out = out if k is None else out.filter(F.col(name) == k)
    return out
