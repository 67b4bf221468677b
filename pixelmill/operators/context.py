"""Static and yearly context of a sample: population, indicators, countries, lightning, roads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.functions import grid as g
from pixelmill.functions import scalars as s
from pixelmill.operators.asof import per_distinct


def locate(samples: DataFrame, meta: g.GridMeta, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Add row and col of an affine grid."""
    return samples.withColumns(g.grid_rowcol(F.col(lon), F.col(lat), meta))


# Years that the population grids are published for.
PUBLISHED_YEARS = (2000, 2005, 2010, 2015, 2020)


def add_population_density(samples: DataFrame, grid: DataFrame, rename: str = "gpw4", published: Sequence[int] | None = PUBLISHED_YEARS) -> DataFrame:
    """Grid value of the sample's year, else linear between the nearest year before and after.

    A grid without one of the ``published`` years is an error while running, as values between its years would come from others further
    apart. A cell's few yearly values travel as one map, so a single join serves both years.
    """
    years = grid.agg(F.array_sort(F.collect_set(F.col("year").cast("int")))).scalar()  # one entry per published year
    if published is not None:
        lacking = F.size(F.array_except(F.array(*[F.lit(y) for y in published]), years)) > 0
        years = F.when(lacking, F.raise_error(F.lit("a published year is missing")).cast("array<int>")).otherwise(years)
    maps = grid.groupBy("row", "col").agg(F.map_from_entries(F.collect_list(F.struct("year", "value"))).alias("_y"))

    def lookup(keys: DataFrame) -> DataFrame:
        t = keys.join(maps, ["row", "col"]).withColumn("_all", years)
        t = t.withColumns({"_a": F.array_max(F.filter("_all", lambda y: y <= F.col("year"))),
                           "_b": F.array_min(F.filter("_all", lambda y: y >= F.col("year")))})
        va, vb = F.try_element_at("_y", F.col("_a")), F.try_element_at("_y", F.col("_b"))
        share = F.try_divide(F.col("year") - F.col("_a"), F.col("_b") - F.col("_a"))
        return t.select("row", "col", "year", F.when(F.col("_a") == F.col("_b"), va).otherwise(va + (vb - va) * share).alias(f"x_{rename}"))

    return per_distinct(samples, ["row", "col", "year"], lookup)


def add_indicator(samples: DataFrame, indicator: DataFrame, name: str) -> DataFrame:
    """Indicator value of the sample's country and year."""
    table = indicator.select(F.col("country_iso3").alias("_c"), F.col("year").alias("_y"), F.col("indicator_value").alias(f"x_{name}"))
    return samples.join(table, (F.col("iso3") == F.col("_c")) & (F.col("year") == F.col("_y")), "left").drop("_c", "_y")


BAND = 0.5  # degrees of latitude in one band of a polygon index
SQUARE = 30.0  # degrees of longitude that a band is divided by


def _floor(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("int")


def polygon_edges(boundaries: DataFrame, rings: str, keep: Sequence[str], band: float = BAND, square: float = SQUARE) -> DataFrame:
    """Edges of all rings as (*keep, x1, y1, x2, y2, band, square), listed where a point may have them east of it or on it.

    An edge is in every band of latitude that it touches; along a band it is in the squares from the western end of its polygon there to its own
    eastern end. Only edges are moved, so a ring is nowhere copied whole. Rings may be closed or open."""
    listed = boundaries.select(*keep, F.explode(rings).alias("_r"))
    n = F.size("_r")
    point = lambda k: F.get("_r", k)
    edges = listed.select(*keep, F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(point(k).alias("a"), point((k + 1) % n).alias("b")))).alias("e"))
    edges = edges.select(*keep, *[F.col(f"e.{p}.{c}").alias(f"{x}{k}") for k, p in ((1, "a"), (2, "b")) for c, x in (("lon", "x"), ("lat", "y"))])
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    banded = edges.withColumn("band", F.explode(F.sequence(_floor(low, band), _floor(high, band))))
    west = banded.groupBy(*keep, "band").agg(F.min(F.least("x1", "x2")).alias("_w"))
    joined = banded.join(west.select(F.struct(*keep, "band").alias("_k"), "_w"), F.struct(*keep, "band") == F.col("_k")).drop("_k")
    return joined.withColumn("square", F.explode(F.sequence(_floor(F.col("_w"), square), _floor(F.greatest("x1", "x2"), square)))).drop("_w")


def polygons_at(points: DataFrame, boundaries: DataFrame, rings: str, keep: Sequence[str], band: float = BAND, square: float = SQUARE) -> DataFrame:
    """(lon, lat, *keep) of each polygon that holds a point of ``points`` (lon, lat), inside or on its border.

    A point is inside when an odd number of edges, of whatever ring, lies east of it: islands and further parts add, holes take away."""
    edges = polygon_edges(boundaries, rings, keep, band, square)
    placed = points.select("lon", "lat", _floor(F.col("lat"), band).alias("band"), _floor(F.col("lon"), square).alias("square"))
    # of the edges that touch the latitude those matter that end east of the point; a level one only where the point is on it
    may = (F.least("y1", "y2") <= F.col("lat")) & (F.greatest("y1", "y2") >= F.col("lat")) & (F.greatest("x1", "x2") >= F.col("lon"))
    met = placed.join(edges, (placed["band"] == edges["band"]) & (placed["square"] == edges["square"]) & may)
    cross = (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) - (F.col("y2") - F.col("y1")) * (F.col("lon") - F.col("x1"))
    on = (cross == 0) & (F.least("x1", "x2") <= F.col("lon"))
    up = (F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))
    east = F.col("lon") < (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1")
    inside = F.max(on) | (F.sum((up & F.coalesce(east, F.lit(False))).cast("int")) % 2 == 1)
    return met.groupBy("lon", "lat", *keep).agg(inside.alias("_in")).filter("_in").drop("_in")


def add_country_and_continent(points: DataFrame, boundaries: DataFrame, cell: float = 5.0, rings: str | None = None) -> DataFrame:
    """Country of each point; points without one stay with NULLs, a point on a shared border may match twice.

    Without ``rings``, a column of arrays of rings, the bounding box is the country. Boxes are listed under every ``cell``-degree square they
    touch, which turns the containment test into an equi-join with a short residual check; rings are looked into by ``polygons_at``.
    """
    new = [F.col("name").alias("country"), s.fill_country_code(F.col("iso3"), F.col("name")).alias("iso3"), "continent"]
    if rings is not None:
        found = polygons_at(points.select("lon", "lat").distinct(), boundaries, rings, ["name", "iso3", "continent"])
        return points.join(found, ["lon", "lat"], "left").select(*points.columns, *new)
    listed = boundaries.withColumn("_sx", F.explode(F.sequence(_floor(F.col("xmin"), cell), _floor(F.col("xmax"), cell)))) \
        .withColumn("_sy", F.explode(F.sequence(_floor(F.col("ymin"), cell), _floor(F.col("ymax"), cell))))
    placed = points.withColumns({"_px": _floor(F.col("lon"), cell), "_py": _floor(F.col("lat"), cell)})
    match = (F.col("_px") == F.col("_sx")) & (F.col("_py") == F.col("_sy")) \
        & F.col("lon").between(F.col("xmin"), F.col("xmax")) & F.col("lat").between(F.col("ymin"), F.col("ymax"))
    return placed.join(listed, match, "left").select(*points.columns, *new)


def fill_gaps(grid: DataFrame, dim: str, max_gap: int, others: Sequence[str], circular: int | None = None,
              value: str = "value") -> DataFrame:
    """Linear interpolation of NULLs along ``dim`` where at most ``max_gap`` cells are missing in a row.

    ``circular`` gives the length of a periodic axis that starts at 1; it is laid out three times.
    """
    keys = [dim, *others]
    work = grid
    if circular:
        work = work.withColumn("_turn", F.explode(F.array(*[F.lit(k) for k in (-circular, 0, circular)]))) \
            .withColumn(dim, F.col(dim) + F.col("_turn")).drop("_turn")
    here = F.when(F.col(value).isNotNull(), F.struct(F.col(dim).alias("p"), F.col(value).alias("x")))
    w = Window.partitionBy(*others).orderBy(dim)
    work = work.withColumns({"_a": F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
                             "_b": F.first(here, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    missing = F.col("_b.p") - F.col("_a.p") - 1
    between = F.col("_a.x") + (F.col("_b.x") - F.col("_a.x")) * (F.col(dim) - F.col("_a.p")) / F.nullif(F.col("_b.p") - F.col("_a.p"), F.lit(0))
    work = work.withColumn(value, F.coalesce(F.col(value), F.when(missing <= max_gap, between)))
    if circular:
        work = work.filter(F.col(dim).between(1, circular))
    return work.select(*[c for c in grid.columns if c in (*keys, value)])


# Longest gap filled along each axis, in cells.
MAX_GAPS = {"month": 2, "col": 60, "row": 20}


def filled_climatology(clim: DataFrame, monthly: bool, max_gaps=None) -> DataFrame:
    """Mean of the variants filled along each axis, one row per cell (and month)."""
    gaps = {**MAX_GAPS, **(max_gaps or {})}
    dims = ["row", "col", "month"] if monthly else ["row", "col"]
    variants = [fill_gaps(clim.select(*dims, "value"), d, gaps[d], [k for k in dims if k != d], 12 if d == "month" else None) for d in dims]
    merged = variants[0]
    for v in variants[1:]:
        merged = merged.unionByName(v)
    return merged.groupBy(*dims).agg(F.avg("value").alias("value"))


def add_lightning(samples: DataFrame, clim: DataFrame, monthly: bool, fill: bool = True, rename: str = "lightn", max_gaps=None) -> DataFrame:
    """Climatology value at the sample's (row, col) and, if monthly, month."""
    table = filled_climatology(clim, monthly, max_gaps) if fill else clim
    keys = ["row", "col", "month"] if monthly else ["row", "col"]
    return samples.join(table.select(*keys, F.col("value").alias(f"x_{rename}")), keys, "left")


def add_road_density(samples: DataFrame, roads: DataFrame, rename: str = "road") -> DataFrame:
    return samples.join(roads.select("row", "col", F.col("value").alias(f"x_{rename}")), ["row", "col"], "left")


def append_features(samples: DataFrame, features: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Join feature tables on the sample key; a column that exists already is an error."""
    for f in features:
        clash = (set(f.columns) & set(samples.columns)) - set(key)
        if clash:
            raise ValueError(f"columns exist already: {sorted(clash)}")
        samples = samples.join(f, list(key), "left")
    return samples
