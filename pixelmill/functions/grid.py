"""Sinusoidal tile grid and affine latitude/longitude grids as Column arithmetic."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the sinusoidal projection: sphere radius, tile side, west and north limit in metres,
# and the side of a tile in 1-km cells.
RADIUS = 6371007.181
TILE_SIDE = 1111950.5196666666
WEST = -20015109.354
NORTH = 10007554.677
CELLS = 1200

# The (v, h) of the tiles with land.
LAND_TILES = [
    (0, 14), (0, 15), (0, 16), (0, 17), (0, 18), (0, 19), (0, 20), (0, 21),
    (1, 12), (1, 13), (1, 14), (1, 15), (1, 16), (1, 17), (1, 18), (1, 19), (1, 20), (1, 21), (1, 22), (1, 23),
    (2, 9), (2, 10), (2, 11), (2, 12), (2, 13), (2, 14), (2, 15), (2, 16), (2, 17), (2, 18), (2, 19), (2, 20), (2, 21), (2, 22), (2, 23),
    (2, 24), (2, 25), (2, 26),
    (3, 6), (3, 7), (3, 8), (3, 9), (3, 10), (3, 11), (3, 12), (3, 13), (3, 14), (3, 15), (3, 17), (3, 18), (3, 19), (3, 20), (3, 21),
    (3, 22), (3, 23), (3, 24), (3, 25), (3, 26), (3, 27), (3, 28), (3, 29),
    (4, 8), (4, 9), (4, 10), (4, 11), (4, 12), (4, 13), (4, 14), (4, 17), (4, 18), (4, 19), (4, 20), (4, 21), (4, 22), (4, 23), (4, 24),
    (4, 25), (4, 26), (4, 27), (4, 28),
    (5, 7), (5, 8), (5, 9), (5, 10), (5, 11), (5, 12), (5, 15), (5, 16), (5, 17), (5, 18), (5, 19), (5, 20), (5, 21), (5, 22), (5, 23),
    (5, 24), (5, 25), (5, 26), (5, 27), (5, 28), (5, 29), (5, 30),
    (6, 2), (6, 3), (6, 7), (6, 8), (6, 9), (6, 10), (6, 11), (6, 16), (6, 17), (6, 18), (6, 19), (6, 20), (6, 21), (6, 22), (6, 23),
    (6, 24), (6, 25), (6, 26), (6, 27), (6, 28), (6, 29), (6, 30), (6, 31),
    (7, 1), (7, 3), (7, 7), (7, 8), (7, 9), (7, 10), (7, 11), (7, 12), (7, 15), (7, 16), (7, 17), (7, 18), (7, 19), (7, 20), (7, 21),
    (7, 22), (7, 23), (7, 24), (7, 25), (7, 26), (7, 27), (7, 28), (7, 29), (7, 30), (7, 31), (7, 32), (7, 33), (7, 34),
    (8, 0), (8, 1), (8, 2), (8, 8), (8, 9), (8, 10), (8, 11), (8, 12), (8, 13), (8, 16), (8, 17), (8, 18), (8, 19), (8, 20), (8, 21),
    (8, 22), (8, 23), (8, 25), (8, 26), (8, 27), (8, 28), (8, 29), (8, 30), (8, 31), (8, 32), (8, 33), (8, 34), (8, 35),
    (9, 0), (9, 1), (9, 2), (9, 3), (9, 4), (9, 8), (9, 9), (9, 10), (9, 11), (9, 12), (9, 13), (9, 14), (9, 16), (9, 18), (9, 19),
    (9, 20), (9, 21), (9, 22), (9, 23), (9, 25), (9, 27), (9, 28), (9, 29), (9, 30), (9, 31), (9, 32), (9, 33), (9, 34), (9, 35),
    (10, 0), (10, 1), (10, 2), (10, 3), (10, 4), (10, 5), (10, 10), (10, 11), (10, 12), (10, 13), (10, 14), (10, 17), (10, 19), (10, 20), (10, 21),
    (10, 22), (10, 23), (10, 27), (10, 28), (10, 29), (10, 30), (10, 31), (10, 32), (10, 33), (10, 34), (10, 35),
    (11, 1), (11, 2), (11, 3), (11, 4), (11, 5), (11, 6), (11, 8), (11, 10), (11, 11), (11, 12), (11, 13), (11, 14), (11, 15), (11, 19), (11, 20),
    (11, 21), (11, 22), (11, 23), (11, 27), (11, 28), (11, 29), (11, 30), (11, 31), (11, 32), (11, 33),
    (12, 11), (12, 12), (12, 13), (12, 16), (12, 17), (12, 19), (12, 20), (12, 24), (12, 27), (12, 28), (12, 29), (12, 30), (12, 31), (12, 32),
    (13, 5), (13, 12), (13, 13), (13, 17), (13, 20), (13, 21), (13, 22), (13, 28), (13, 29), (13, 30), (13, 31),
    (14, 13), (14, 14), (14, 15), (14, 16), (14, 18), (14, 22), (14, 27), (14, 28),
    (15, 15), (15, 17), (15, 18), (15, 19), (15, 20), (15, 21), (15, 22), (15, 23), (15, 24),
    (16, 14), (16, 15), (16, 16), (16, 17), (16, 18), (16, 19), (16, 20), (16, 21), (16, 22), (16, 23),
    (17, 14), (17, 15), (17, 16), (17, 17), (17, 18), (17, 19), (17, 20), (17, 21),
]


def _num(c) -> Column:
    return c if isinstance(c, Column) else F.lit(c)


def _floor(c: Column) -> Column:
    return F.floor(c).cast("int")


def sin_forward(lat: Column, lon: Column, res: int = 1, mode: str = "containing") -> dict[str, Column]:
    """Degrees to v, h, i, j. ``containing`` gives the cell around the point; ``guide`` shifts by half a
    cell before flooring, which is exact at cell centres only and is therefore eased by 1e-6 of a cell."""
    if mode not in ("containing", "guide"):
        raise ValueError("mode must be 'containing' or 'guide'")
    shift = 0.0 if mode == "containing" else -0.5 + 1e-6
    width = TILE_SIDE / CELLS / res
    east = RADIUS * F.radians(lon) * F.cos(F.radians(lat)) - WEST
    south = NORTH - RADIUS * F.radians(lat)
    v, h = _floor(south / TILE_SIDE), _floor(east / TILE_SIDE)
    return {"v": v, "h": h,
            "i": _floor((south - v * TILE_SIDE) / width + shift),
            "j": _floor((east - h * TILE_SIDE) / width + shift)}


def sin_tile(lat: Column, lon: Column) -> dict[str, Column]:
    cell = sin_forward(lat, lon)
    return {"v": cell["v"], "h": cell["h"]}


def sin_inverse(v: Column, h: Column, i: Column, j: Column, res: int = 1, wrap: bool = True,
                radians: bool = False) -> dict[str, Column]:
    """Centre of a cell as lat, lon. Cells past the rim of the globe come out wrapped; see off_globe."""
    width = TILE_SIDE / CELLS / res
    lat = (NORTH - (i + 0.5) * width - v * TILE_SIDE) / RADIUS
    lon = ((j + 0.5) * width + h * TILE_SIDE + WEST) / (RADIUS * F.cos(lat))
    if wrap:
        lon = F.when(lon < -math.pi, lon + 2 * math.pi).when(lon > math.pi, lon - 2 * math.pi).otherwise(lon)
    return {"lat": lat, "lon": lon} if radians else {"lat": F.degrees(lat), "lon": F.degrees(lon)}


def off_globe(v: Column, h: Column, i: Column, j: Column, res: int = 1) -> Column:
    return F.abs(sin_inverse(v, h, i, j, res, wrap=False)["lon"]) > 180.0


def known_tile(v: Column, h: Column) -> Column:
    """True for tiles with land, without a join: one bit per h in a number per v."""
    masks = F.array(*[F.lit(sum(1 << k for row, k in LAND_TILES if row == v0)).cast("bigint") for v0 in range(18)])
    mask = F.when(h.between(0, 35), F.get(masks, v))
    return F.coalesce(F.getbit(mask, h) == 1, F.lit(False))


def upscale(i: Column, j: Column) -> Column:
    """The four cells of the next finer resolution, as an array of (i, j)."""
    return F.array(*[F.struct((2 * i + a).alias("i"), (2 * j + b).alias("j")) for a in (0, 1) for b in (0, 1)])


def lon360(lon: Column) -> Column:
    return F.when(lon < 0, lon + 360.0).otherwise(lon)


class GridMeta(NamedTuple):
    """Affine grid: x = a*col + b*row + c, y = d*col + e*row + f. Members are numbers or Columns."""

    a: object
    b: object
    c: object
    d: object
    e: object
    f: object
    nrows: object
    ncols: object
    lon360: bool = False


def grid_rowcol(x: Column, y: Column, meta: GridMeta) -> dict[str, Column]:
    """Row and column of the cell around (x, y); both NULL outside the grid."""
    a, b, c, d, e, f = (_num(k) for k in meta[:6])
    if meta.lon360:
        x = lon360(x)
    det = a * e - b * d
    col = F.floor((e * (x - c) - b * (y - f)) / det).cast("int")
    row = F.floor((a * (y - f) - d * (x - c)) / det).cast("int")
    inside = (row >= 0) & (row < _num(meta.nrows)) & (col >= 0) & (col < _num(meta.ncols))
    return {"row": F.when(inside, row), "col": F.when(inside, col)}


OFFSETS = {"center": (0.5, 0.5), "ul": (0.0, 0.0), "ur": (0.0, 1.0), "ll": (1.0, 0.0), "lr": (1.0, 1.0)}


def grid_coords(row: Column, col: Column, meta: GridMeta, offset: str = "center") -> dict[str, Column]:
    """Coordinates of a point of a cell: its centre or a corner."""
    a, b, c, d, e, f = (_num(k) for k in meta[:6])
    down, right = OFFSETS[offset]
    row, col = row + down, col + right
    return {"x": a * col + b * row + c, "y": d * col + e * row + f}


def grid_coords_all(row: Column, col: Column, meta: GridMeta, offsets) -> Column:
    """Array of (offset, x, y), to be exploded when several points per cell are wanted."""
    return F.array(*[F.struct(F.lit(o).alias("offset"), *[c.alias(n) for n, c in grid_coords(row, col, meta, o).items()])
                     for o in offsets])


def outline(corners_only: bool = False, n: int = CELLS) -> Column:
    """Border cells of a tile, clockwise from the upper left and closed, as an array of (k, i, j)."""
    if corners_only:
        ring = [(0, 0), (0, n - 1), (n - 1, n - 1), (n - 1, 0), (0, 0)]
        return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(j).alias("j"))
                         for k, (i, j) in enumerate(ring)])
    last = n - 1

    def cell(k: Column) -> Column:
        i = F.when(k <= last, 0).when(k <= 2 * last, k - last).when(k <= 3 * last, last).otherwise(4 * last - k)
        j = F.when(k <= last, k).when(k <= 2 * last, last).when(k <= 3 * last, 3 * last - k).otherwise(0)
        return F.struct(k.alias("k"), i.alias("i"), j.alias("j"))

    return F.transform(F.sequence(F.lit(0), F.lit(4 * last)), cell)
