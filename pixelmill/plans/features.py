"""Feature table for a sample index: coordinates once per cell and day, then one lookup per source."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.checkpoints import cut
from pixelmill.functions import grid as g
from pixelmill.functions import scalars as s
from pixelmill.operators import context, neighborhood, weather
from pixelmill.operators.layers import CELL


def with_coordinates(samples: DataFrame) -> DataFrame:
    """Centre of the 500-m cell and the date of each sample."""
    c = g.sin_inverse(F.col("v"), F.col("h"), F.col("i2"), F.col("j2"), res=2)
    return samples.withColumns({**c, "d": s.yday_to_date(F.col("year"), F.col("yday")), "i": F.col("i2"), "j": F.col("j2")})


def build(samples: DataFrame, sources: Mapping[str, tuple], n: int = neighborhood.SIDE, digits: Mapping[str, int] | None = None) -> DataFrame:
    """Append every source given. Keys and values:

    weather -> [(name, daily grid, meta, ndays, agg_start)], fire_weather -> (daily grid, meta), population -> (grid, meta, published years),
    roads -> (grid, meta), precipitation -> (monthly grid, meta, n_climate, n_deficit), lightning -> (climatology, meta, monthly),
    burn -> (burn layers, distance, hindsight), vegetation -> (name, cells), land_cover -> (name, layers, classes, distance),
    countries -> (table, rings), indicators -> [(name, table)], which needs countries, and one_hot -> classes of the samples' ``lct``.

    ``n`` is the number of cells along the side of a tile, ``digits`` has the decimals of columns that are to be rounded.

    All but indicators and classes is looked up for the distinct cells and days of the samples, and joined to these once. Cells and days with their
    coordinates are computed first and cut off (``checkpoints.cut``): the sources look at them many times, and conditions on a coordinate
    would else be pushed into each reading of the samples, to be computed for every sample there. Indicators come last, as a code that several
    countries share gives a row for each of them; values are rounded before that.
    """
    digits = digits or {}
    key = ["yday", "year", "i2", "j2", "h", "v"]
    found = _looked_up(cut(with_coordinates(samples.select(*key).distinct())), sources, n)
    found = found.withColumns({c: F.round(c, k) for c, k in digits.items() if c in found.columns})
    new = [c for c in found.columns if c not in key]
    found = found.select(*[F.col(k).alias(f"_{k}") for k in key], *[F.col(c).alias(f"_{c}") if c in samples.columns else F.col(c) for c in new])
    # a sample without a day still has the country of its cell
    out = samples.join(found, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]), "left")
    out = out.select(*[F.col(f"_{c}").alias(c) if c in new else c for c in samples.columns], *[c for c in new if c not in samples.columns])
    for name, table in sources.get("indicators", ()):
        if "iso3" not in out.columns:
            raise ValueError("indicators need the country of a sample")
        if f"x_{name}" in digits:
            table = table.withColumn("indicator_value", F.round("indicator_value", digits[f"x_{name}"]))
        out = context.add_indicator(out, table, name)
    return out.select("*", *s.one_hot(F.col("lct"), sources["one_hot"])) if "one_hot" in sources else out


def _looked_up(base: DataFrame, sources: Mapping[str, tuple], n: int) -> DataFrame:
    """Every source next to ``base``, which is joined once per grid and once for everything at its own cell, however many sources there are: these
    are first put next to each other on the distinct keys."""
    out = base
    by_grid: dict[g.GridMeta, list[Callable[[DataFrame], DataFrame]]] = defaultdict(list)
    for name, grid, meta, ndays, start in sources.get("weather", ()):
        by_grid[meta].append(partial(weather.add_weather, grid=grid, var=name, ndays=ndays, agg_start=start))
    if "population" in sources:
        grid, meta, published = sources["population"]
        by_grid[meta].append(partial(_population, grid=grid, published=published))
    if "fire_weather" in sources:
        grid, meta = sources["fire_weather"]
        by_grid[meta].append(partial(weather.add_fire_weather_index, grid=grid))
    if "lightning" in sources:
        clim, meta, monthly = sources["lightning"]
        by_grid[meta].append(partial(_lightning, clim=clim, monthly=monthly))
    if "precipitation" in sources:
        grid, meta, n_climate, n_deficit = sources["precipitation"]
        by_grid[meta].append(partial(weather.add_precip_deficit, precip=grid, n_climate=n_climate, n_deficit=n_deficit))
    if "roads" in sources:
        grid, meta = sources["roads"]
        by_grid[meta].append(partial(context.add_road_density, roads=grid))
    for meta, adders in by_grid.items():
        key = ["row", "col", "d"]
        out = _joined(context.locate(out, meta), context.locate(base, meta), key, adders).drop("row", "col")

    at_cell: list[Callable[[DataFrame], DataFrame]] = []
    if "burn" in sources:
        burn, distance, hindsight = sources["burn"]
        at_cell.append(partial(neighborhood.add_neighboring_fires, burn=burn, distance=distance, hindsight=hindsight, n=n))
    if "vegetation" in sources:
        name, cells = sources["vegetation"]
        at_cell.append(partial(neighborhood.add_vegetation_index, vi=cells, name=name))
    if "land_cover" in sources:
        name, cells, classes, distance = sources["land_cover"]
        at_cell.append(partial(neighborhood.add_land_cover_nearby, lct=cells, query_lcts=classes, distance=distance, name=name, n=n))
    if at_cell:
        out = _joined(out, base, [*CELL, "d"], at_cell)
    if "countries" in sources:
        table, rings = sources["countries"]
        out = context.add_country_and_continent(out, table, rings=rings)
    return out.drop("i", "j")


def _joined(out: DataFrame, base: DataFrame, key: Sequence[str], adders: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Columns of every adder next to ``out``. Each looks up the distinct keys of ``base`` on its own, so the plan grows with the number of sources
    only, and the results, one row per key, meet before the wide rows do."""
    keys = base.select(*key).filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])).distinct()
    found = reduce(lambda a, b: a.join(b, list(key)), [add(keys) for add in adders])
    return out.join(found, list(key), "left").select(*out.columns, *[c for c in found.columns if c not in key])


def _population(keys: DataFrame, grid: DataFrame, published: Sequence[int] | None) -> DataFrame:
    return context.add_population_density(keys.withColumn("year", F.year("d")), grid, published=published).drop("year")


def _lightning(keys: DataFrame, clim: DataFrame, monthly: bool) -> DataFrame:
    return context.add_lightning(keys.withColumn("month", F.month("d")), clim, monthly).drop("month")
