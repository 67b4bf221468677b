"""Predicate scans, mask algebra and cell joins between layers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.functions import grid as g
from pixelmill.operators import ranks

CELL = ("v", "h", "i", "j")
HUMAN = (12, 13, 14)  # fixed values: cropland, urban, cropland mosaic
NOT_SAMPLED = (13, 15, 16, 255)  # fixed values: urban, ice, barren, unclassified
WILD_VEGETATION = (1, 11)  # fixed values: first and last class of wild vegetation
FIRE_FROM = 7  # fixed value: lowest fire class of the 1-km mask


# --- predicates ------------------------------------------------------------------------------------------

def is_fire(value: Column) -> Column:
    return value >= FIRE_FROM


def is_human(lct: Column) -> Column:
    return lct.isin(*HUMAN)


def is_wilderness(lct: Column) -> Column:
    return ~lct.isin(*HUMAN)


def is_wild_vegetation(lct: Column) -> Column:
    return lct.between(*WILD_VEGETATION)


def tile_window(df: DataFrame, vmin: int, vmax: int, hmin: int, hmax: int) -> DataFrame:
    return df.filter(F.col("v").between(vmin, vmax) & F.col("h").between(hmin, hmax))


def known_tiles(df: DataFrame) -> DataFrame:
    return df.filter(g.known_tile(F.col("v"), F.col("h")))


def inside_margin(df: DataFrame, margin: int, n: int) -> DataFrame:
    return df.filter(F.col("i").between(margin, n - margin - 1) & F.col("j").between(margin, n - margin - 1))


def burn_quality(df: DataFrame, max_uncertainty: int = 1) -> DataFrame:
    return df.filter((F.col("burn_date") >= 0) & (F.col("uncertainty") <= max_uncertainty))


# --- scans -----------------------------------------------------------------------------------------------

def with_layers(cells: DataFrame, layers: Mapping[str, DataFrame], on: Sequence[str] = CELL) -> DataFrame:
    """Join other layers as columns, so that a condition may look at them."""
    for name, layer in layers.items():
        other = layer.select(*on, F.col("value").alias(name))
        cells = cells.join(other, list(on), "left")
    return cells


SLOTS = 64  # parts of a group that are ranked on their own first


def cap_per_group(df: DataFrame, group: Sequence[str], key: Sequence[str], n: int, seed: int) -> DataFrame:
    """At most n rows per group, those of least key hash; rows that repeat a key count each.

    Rows are ranked inside hash slots of their group first, and only the first n of every slot are ranked again, so a hot
    group does not meet in one task.
    """
    slotted = df.withColumn("_h", ranks.key_hash([F.col(k) for k in key], seed)).withColumn("_s", F.pmod("_h", F.lit(SLOTS)))
    for parts in ([*group, "_s"], group):
        w = Window.partitionBy(*parts).orderBy("_h", *key)
        slotted = slotted.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
    return slotted.drop("_h", "_s")


def where_cells(cells: DataFrame, condition: Callable[..., Column], *, res: int = 1, meta: g.GridMeta | None = None,
                offsets: Sequence[str] = ("center",), max_per_date: int | None = None, seed: int = 0,
                extra: Sequence[str] = ()) -> DataFrame:
    """Cells that meet ``condition(value, *extra columns)``, with coordinates.

    Tile cells use the sinusoidal grid (centres only); an affine ``meta`` gives any of the offsets.
    """
    hits = cells.filter(condition(F.col("value"), *[F.col(c) for c in extra]))
    if max_per_date is not None:
        hits = cap_per_group(hits, ["v", "h", "date"], ["i", "j"], max_per_date, seed)
    base = ["v", "h", "date", F.col("i").alias("row"), F.col("j").alias("col"), F.col("value").alias("val")]
    if meta is None:
        c = g.sin_inverse(F.col("v"), F.col("h"), F.col("i"), F.col("j"), res)
        return hits.select(*base, F.lit("center").alias("offset"), c["lat"].alias("lat"), c["lon"].alias("lon"))
    points = F.explode(g.grid_coords_all(F.col("i"), F.col("j"), meta, offsets)).alias("_c")
    return hits.select(*base, points).select("v", "h", "date", "row", "col", "val", "_c.offset",
                                             F.col("_c.y").alias("lat"), F.col("_c.x").alias("lon"))


def fires(cells: DataFrame, **kwargs) -> DataFrame:
    return where_cells(cells, is_fire, **kwargs)


def human_activity(cells: DataFrame, **kwargs) -> DataFrame:
    return where_cells(cells, is_human, **kwargs)


# --- pooling and masks -----------------------------------------------------------------------------------

POOLING: dict[str, Callable[[Column], Column]] = {
    "max": F.max, "mean": F.avg, "min": F.min, "sum": F.sum, "any": F.bool_or, "all": F.bool_and,
    "median": lambda c: F.percentile(c, F.lit(0.5)),  # over one block of p*q cells
}


def pool(cells: DataFrame, block: tuple[int, int], func: str, n: int | None = None, col: str = "value",
         keys: Sequence[str] = ("v", "h")) -> DataFrame:
    """Reduce blocks of p x q cells. With the tile size ``n`` given, blocks cut by the tile edge are dropped."""
    p, q = block
    if n is not None:
        cells = cells.filter((F.col("i") < n // p * p) & (F.col("j") < n // q * q))
    return cells.groupBy(*keys, F.floor(F.col("i") / p).cast("int").alias("i"), F.floor(F.col("j") / q).cast("int").alias("j")) \
        .agg(POOLING[func](F.col(col)).alias(col))


def all_years(df: DataFrame, mask: Column, years: int, keys: Sequence[str] = CELL) -> DataFrame:
    """Cells whose mask holds in each of ``years`` layers."""
    return df.groupBy(*keys).agg(F.bool_and(mask).alias("_ok"), F.count_distinct("year").alias("_n")) \
        .filter(F.col("_ok") & (F.col("_n") >= years)).select(*keys)


def _coarse_mask(lct: DataFrame, predicate: Callable[[Column], Column], min_layers: int) -> DataFrame:
    """1-km cells whose 500-m cells are all accepted, in the layer's year and, if present, the year after."""
    fine = lct.select("v", "h", F.floor(F.col("i") / 2).cast("int").alias("i"), F.floor(F.col("j") / 2).cast("int").alias("j"),
                      F.explode(F.array("year", F.col("year") - 1)).alias("year"), F.col("year").alias("_y"),
                      predicate(F.col("lct")).alias("_m"))
    return fine.groupBy("v", "h", "i", "j", "year").agg(F.bool_and("_m").alias("_ok"), F.min("_y").alias("_a"), F.max("_y").alias("_b")) \
        .filter(F.col("_ok") & (F.when(F.col("_a") < F.col("_b"), 2).otherwise(1) >= min_layers)) \
        .select("v", "h", "i", "j", "year")


def _masked(cells: DataFrame, lct: DataFrame, value_ok: Callable[[Column], Column],
            predicate: Callable[[Column], Column], min_layers: int) -> DataFrame:
    """Cells of a 1-km layer with the wanted value inside the mask of the same year."""
    wanted = cells.filter(value_ok(F.col("value"))).withColumn("year", F.year("date"))
    return wanted.join(_coarse_mask(lct, predicate, min_layers), ["v", "h", "i", "j", "year"], "left_semi")


def wildfires(cells: DataFrame, lct: DataFrame, min_layers: int = 1) -> DataFrame:
    return _masked(cells, lct, is_fire, is_wilderness, min_layers)


def nonfire_wilderness(cells: DataFrame, lct: DataFrame, min_layers: int = 1) -> DataFrame:
    return _masked(cells, lct, lambda v: v < FIRE_FROM, is_wilderness, min_layers)


def nonfire_wild_vegetation(cells: DataFrame, lct: DataFrame, min_layers: int = 1) -> DataFrame:
    return _masked(cells, lct, lambda v: v < FIRE_FROM, is_wild_vegetation, min_layers)


def pair_with_yearly_layers(idx: DataFrame, yearly: DataFrame, min_corresponding: int = 0) -> DataFrame:
    """For each layer file, the yearly file of its own and of the next year (first by path)."""
    first = yearly.groupBy("v", "h", "year").agg(F.min("path").alias("_p"))
    this = first.withColumnRenamed("_p", "path_this_year")
    following = first.select("v", "h", (F.col("year") - 1).alias("year"), F.col("_p").alias("path_next_year"))
    keys = ["v", "h", "year"]
    both = this.join(following, keys, "full")  # yearly listing only: one row per tile and year
    out = idx.join(both, keys, "left")
    present = F.col("path_this_year").isNotNull().cast("int") + F.col("path_next_year").isNotNull().cast("int")
    return out.filter(present >= min_corresponding)


# --- land cover and burn layers --------------------------------------------------------------------------

def _with_next_year(lct: DataFrame) -> DataFrame:
    """Put the next year's class and flag next to a cell: one shuffle instead of a self join. A window
    holds one cell, so it has one row per year."""
    w = Window.partitionBy(*CELL).orderBy("year")
    following = F.lead(F.struct("year", "lct", "qc")).over(w)
    return lct.withColumn("_n", following).filter(F.col("_n.year") == F.col("year") + 1)


def land_cover_masks(lct: DataFrame, drop_lcts: Sequence[int] = NOT_SAMPLED, margin: int = 0, n: int = 2400,
                     subset_ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """The single masks of ``stable_land_cover``, for cells present in two successive years."""
    inside = F.col("i").between(margin, n - margin - 1) & F.col("j").between(margin, n - margin - 1)
    chosen = F.lit(True) if subset_ratio >= 1 else \
        ranks.unit_hash([F.col(k) for k in (*CELL, "year")], seed) < subset_ratio
    out = _with_next_year(lct).select(
        *CELL, "year", "lct",
        ((F.col("lct") == F.col("_n.lct")) & (F.col("qc") == F.col("_n.qc"))).alias("no_change"),
        ((~F.col("lct").isin(*drop_lcts)) & (F.col("qc") == 0)).alias("keep_lct"),
        chosen.alias("random"), inside.alias("margin"))
    return out.withColumn("overall", F.col("no_change") & F.col("keep_lct") & F.col("random") & F.col("margin"))


def mask_ratios(masks: DataFrame, names: Sequence[str]) -> DataFrame:
    """Share of True per mask, one pass."""
    return masks.agg(*[F.avg(F.col(m).cast("double")).alias(m) for m in names])


def stable_land_cover(lct: DataFrame, **kwargs) -> DataFrame:
    """Cells with the same accepted class and flag in a year and the next."""
    return land_cover_masks(lct, **kwargs).filter("overall").select(*CELL, "year", "lct")


def layers_to_columns(cells: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Long layers to one row per cell, one column per variable."""
    return cells.filter(F.col("var").isin(list(names))).groupBy(*keys).agg(
        *[F.max(F.when(F.col("var") == n, F.col("value"))).alias(n) for n in names])


def attach_burn_layers(index: DataFrame, layers: DataFrame) -> DataFrame:
    """Burn layers (wide, one row per cell and month) of each indexed cell and year."""
    return index.join(layers, [*CELL, "year"])


def gather(points: DataFrame, layer: DataFrame, on: Sequence[str], value: str = "value") -> DataFrame:
    """Value of a layer at given cells; a layer with var and date gives one row per requested pair."""
    extra = [c for c in layer.columns if c in ("var", "date") and c not in on]
    return points.join(layer.select(*on, *extra, value), list(on), "left")


def burn_stats(samples: DataFrame, by: Sequence[str], fire: str = "fire", suffix: str = "") -> DataFrame:
    """Positives, rows and positive rate per layer file."""
    pos = F.sum(F.col(fire).cast("bigint"))
    return samples.groupBy(*by).agg(pos.alias(f"n_pos{suffix}"), F.count(F.lit(1)).alias(f"N{suffix}"),
                                    (pos / F.count(F.lit(1))).alias(f"r_pos{suffix}"))


def positive_rate(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ratio of sums before and after undersampling."""
    return stats.groupBy(*by).agg(*[F.try_divide(F.sum(f"n_pos{s}"), F.sum(f"N{s}")).alias(f"r_pos{s}")
                                    for s in ("", "_us") if f"N{s}" in stats.columns])


def weighted_rates(stats: DataFrame, weights: DataFrame) -> DataFrame:
    """Positive rates with per-row weights joined on whichever of v, h, year the weights carry."""
    keys = [c for c in weights.columns if c != "weight"]
    illegal = set(keys) - {"v", "h", "year"}
    if illegal or not keys:
        raise ValueError(f"weights may be keyed by v, h, year only, got {keys}")
    w = stats.join(weights, keys)
    return w.agg(*[F.try_divide(F.sum(F.col(f"n_pos{s}") * F.col("weight")), F.sum(F.col(f"N{s}") * F.col("weight"))).alias(f"r_pos{s}")
                   for s in ("", "_us") if f"N{s}" in stats.columns])


