"""Values and counts in the square around a cell, over the edges of tiles.

Tiles of one grid meet without gaps, so cell (i, j) of tile (v, h) is cell (v * n + i, h * n + j) of the whole grid, n cells being the side of a
tile. Events and cells are looked for in blocks of that grid: an event goes to its own block and to those it can reach, instead
of to every cell around it. Layers are cut to the tiles and dates that samples can see before anything is sent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.functions import scalars as s
from pixelmill.operators.asof import asof_layer, per_distinct
from pixelmill.operators.layers import CELL


def offsets(dist: int, include_center: bool = False) -> Column:
    """Array of (k, di, dj) around a cell."""
    ring = [(a, b) for a in range(-dist, dist + 1) for b in range(-dist, dist + 1) if include_center or (a, b) != (0, 0)]
    return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("di"), F.lit(b).alias("dj")) for k, (a, b) in enumerate(ring)])


SIDE = 2400  # fixed value: 500-m cells along the side of a tile


def _global(df: DataFrame, n: int) -> DataFrame:
    return df.withColumns({"_gi": F.col("v") * n + F.col("i"), "_gj": F.col("h") * n + F.col("j")})


def _block_side(dist: int) -> int:
    return 2 * dist


def _with_block(df: DataFrame, dist: int) -> DataFrame:
    """Block of the whole grid that a sample's cell lies in."""
    side = _block_side(dist)
    return df.withColumns({"_bi": F.floor(F.col("_gi") / side), "_bj": F.floor(F.col("_gj") / side)})


def _to_blocks(df: DataFrame, dist: int) -> DataFrame:
    """An event under every block with a cell that it is near to."""
    side = _block_side(dist)
    for g, b in (("_gi", "_bi"), ("_gj", "_bj")):
        df = df.withColumn(b, F.explode(F.sequence(F.floor((F.col(g) - dist) / side), F.floor((F.col(g) + dist) / side))))
    return df


def _near(dist: int, a: str = "_gi", b: str = "_gj", x: str = "_ei", y: str = "_ej") -> Column:
    """Within the square around (a, b), but not its centre."""
    di, dj = F.col(x) - F.col(a), F.col(y) - F.col(b)
    return di.between(-dist, dist) & dj.between(-dist, dist) & ((di != 0) | (dj != 0))


def tiles_around(df: DataFrame, *more: str) -> DataFrame:
    """Tiles of some rows and those next to them; with ``more`` columns, per value of these."""
    step = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    return df.select("v", "h", *more).distinct().withColumn("_a", F.explode(step)).withColumn("_b", F.explode(step)) \
        .select((F.col("v") + F.col("_a")).alias("v"), (F.col("h") + F.col("_b")).alias("h"), *more).distinct()


def neighbors(cells: DataFrame, points: DataFrame, dist: int, n: int, include_center: bool = False,
              outside: float | None = None, on: Sequence[str] = (), across: bool = False) -> DataFrame:
    """One row per point and offset (di, dj) with the value there. Past the tile edge the value is ``outside``; without it such a point is
    an error while running. With ``across`` the neighbouring tile is looked into instead, and what no tile has is NULL."""
    spread = points.withColumn("_o", F.explode(offsets(dist, include_center))).withColumns(
        {"_i": F.col("i") + F.col("_o.di"), "_j": F.col("j") + F.col("_o.dj"), "_v": F.col("v"), "_h": F.col("h")})
    if across:
        # the tile that the neighbour lies in, and its place there
        spread = spread.withColumns({"_v": F.col("v") + F.floor(F.col("_i") / n), "_h": F.col("h") + F.floor(F.col("_j") / n),
                                     "_i": F.pmod("_i", F.lit(n)), "_j": F.pmod("_j", F.lit(n))})
    layer = cells.select(*[F.col(c).alias(f"_{c}") for c in CELL], *on, "value")
    found = spread.join(layer, [*[f"_{c}" for c in CELL], *on], "left")
    value = F.col("value")
    if not across:
        inside = F.col("_i").between(0, n - 1) & F.col("_j").between(0, n - 1)
        edge = F.raise_error(F.lit("neighbour outside of the tile")).cast("double") if outside is None else F.lit(float(outside))
        value = F.when(inside, value).otherwise(edge)
    return found.select(*points.columns, F.col("_o.di").alias("di"), F.col("_o.dj").alias("dj"), value.alias("value"))


def burn_events(burn: DataFrame, max_bduc: int = 2) -> DataFrame:
    """Burned cells with a real date."""
    return burn.filter((F.col("burn_date") > 0) & (F.col("uncertainty") <= max_bduc)).select(
        *CELL, s.yday_to_date(F.col("year"), F.col("burn_date")).alias("burned"))


def add_neighboring_fires(samples: DataFrame, burn: DataFrame, distance: int = 1, hindsight: int = 10,
                          max_bduc: int = 2, rename: str = "nf", n: int = SIDE) -> DataFrame:
    """Number of neighbour cells that burned 1..hindsight days before the sample day, each counted once, in whatever tile they are.

    With up to 62 neighbours a bit per neighbour makes the distinct count a plain aggregate.
    """
    name = f"x_{rename}"

    def slot(day) -> Column:
        return F.floor(F.unix_date(day) / (4 * hindsight))

    def lookup(keys: DataFrame) -> DataFrame:
        first = F.date_sub(keys.agg(F.min("d")).scalar(), hindsight)
        last = F.date_sub(keys.agg(F.max("d")).scalar(), 1)
        # whole years first, which prunes a layer stored by year; a grid has a few hundred tiles
        seen = burn.filter(F.col("year").between(F.year(first), F.year(last))).join(F.broadcast(tiles_around(keys)), ["v", "h"], "left_semi")
        events = _global(burn_events(seen, max_bduc), n).filter(F.col("burned").between(first, last))
        # an event acts on `hindsight` days, so it is listed under one or two time slots, mostly one
        slots = F.array_distinct(F.array(slot(F.date_add("burned", 1)), slot(F.date_add("burned", hindsight))))
        listed = _to_blocks(events.select("_gi", "_gj", "burned", F.explode(slots).alias("_t")), distance) \
            .select("_bi", "_bj", "_t", F.col("_gi").alias("_ei"), F.col("_gj").alias("_ej"), "burned")
        placed = _with_block(_global(keys, n), distance).withColumn("_t", slot(F.col("d")))
        hits = placed.join(listed, ["_bi", "_bj", "_t"]).filter(_near(distance) & F.datediff("d", "burned").between(1, hindsight))
        width = 2 * distance + 1
        place = (F.col("_ei") - F.col("_gi") + distance) * width + F.col("_ej") - F.col("_gj") + distance
        if width**2 <= 62:
            count = F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), place.cast("int"))))
        else:
            count = F.count_distinct(place)
        return hits.groupBy(*CELL, "d").agg(count.cast("int").alias(name))

    return per_distinct(samples, [*CELL, "d"], lookup).withColumn(name, F.coalesce(name, F.lit(0)))


def add_land_cover_nearby(samples: DataFrame, lct: DataFrame, query_lcts: Sequence[int], distance: int, name: str,
                          max_days: int = 400, n: int = SIDE, dates: DataFrame | None = None) -> DataFrame:
    """Number of neighbour cells with one of the classes, in the layer in force on 1 January of the year before, in whatever tile they are.

    ``dates`` lists (v, h, date) of the layers; without it they are taken from the cells."""

    def lookup(keys: DataFrame) -> DataFrame:
        found = lct.select("v", "h", "date").distinct() if dates is None else dates
        dated = asof_layer(keys.withColumn("_q", F.make_date(F.col("_y") - 1, F.lit(1), F.lit(1))), found, max_days, True, day="_q")
        wanted = tiles_around(dated.filter(F.col("layer_date").isNotNull()), "layer_date").withColumnRenamed("layer_date", "date")
        hits = lct.filter(F.col("value").isin(list(query_lcts))).select(*CELL, "date").join(wanted, ["v", "h", "date"], "left_semi")
        listed = _to_blocks(_global(hits, n), distance).select("_bi", "_bj", F.col("date").alias("layer_date"), F.col("_gi").alias("_ei"), F.col("_gj").alias("_ej"))
        placed = _with_block(_global(dated, n), distance)
        near = placed.join(listed, ["_bi", "_bj", "layer_date"]).filter(_near(distance))
        counts = near.groupBy(*CELL, "_y").agg(F.count(F.lit(1)).cast("int").alias("_c"))
        return dated.join(counts, [*CELL, "_y"], "left") \
            .select(*CELL, "_y", F.when(F.col("layer_date").isNotNull(), F.coalesce("_c", F.lit(0))).alias(f"x_{name}"))

    return per_distinct(samples.withColumn("_y", F.year("d")), [*CELL, "_y"], lookup).drop("_y")


def add_vegetation_index(samples: DataFrame, vi: DataFrame, name: str = "evi", max_days: int = 21, dates: DataFrame | None = None) -> DataFrame:
    """Mean and population deviation of the four finer cells in the last layer strictly before the day, and
    its age in days. A missing one of the four leaves mean and deviation NULL.

    Only the layers that some sample looks at are pooled. ``dates`` lists (v, h, date) of the layers; without it they are taken from the cells."""

    def lookup(keys: DataFrame) -> DataFrame:
        found = vi.select("v", "h", "date").distinct() if dates is None else dates
        dated = asof_layer(keys, found, max_days).filter("layer_date IS NOT NULL")
        wanted = dated.select("v", "h", F.col("layer_date").alias("date")).distinct()
        # coarse cell of each fine cell, so that nothing has to be spread
        fine = vi.join(wanted, ["v", "h", "date"], "left_semi").groupBy("v", "h", F.floor(F.col("i") / 2).cast("int").alias("i"), F.floor(F.col("j") / 2).cast("int").alias("j"),
                          F.col("date").alias("layer_date")) \
            .agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"), F.count("value").alias("_n"))
        found = dated.join(fine, [*CELL, "layer_date"], "left")
        full = F.col("_n") == 4
        return found.select(*CELL, "d", F.when(full, F.col("_m")).alias(f"x_{name}_mean"), F.when(full, F.col("_s")).alias(f"x_{name}_std"),
                            F.datediff("d", "layer_date").alias(f"x_{name}_tdiff"))

    return per_distinct(samples, [*CELL, "d"], lookup)
