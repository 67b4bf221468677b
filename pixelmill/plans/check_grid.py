"""Grid mapping over the geographic points and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelmill.functions import grid as g
from pixelmill.plans.lenses import GEO_SQL, POINTS_SQL
from pixelmill.plans.registry import query

HALF_DEGREE = g.GridMeta(0.5, 0.0, -180.0, 0.0, -0.5, 80.0, 300, 720)  # leaves points north of 80 and south of -70 out
MATH_SQL = """m AS (SELECT *, 6371007.181*radians(lon)*cos(radians(lat)) + 20015109.354 AS e,
  10007554.677 - 6371007.181*radians(lat) AS s FROM geo_points), t AS (
  SELECT *, CAST(floor(s/1111950.5196666666) AS INT) AS v, CAST(floor(e/1111950.5196666666) AS INT) AS h FROM m)"""


def _forward(tables, res, mode):
    p = tables.geo_points
    return p.select("id", *[c.alias(n) for n, c in g.sin_forward(F.col("lat"), F.col("lon"), res, mode).items()])


def _forward_sql(res, shift):
    return f"""WITH {GEO_SQL}, {MATH_SQL} SELECT id, v, h,
      CAST(floor((s - v*1111950.5196666666)/(1111950.5196666666/1200/{res}) + {shift}) AS INT) AS i,
      CAST(floor((e - h*1111950.5196666666)/(1111950.5196666666/1200/{res}) + {shift}) AS INT) AS j FROM t"""


@query("sin_forward", _forward_sql(2, 0.0))
def _sin_forward(t):
    return _forward(t, 2, "containing")


@query("sin_forward_guide", _forward_sql(1, "(-0.5 + 1e-6)"))
def _sin_forward_guide(t):
    return _forward(t, 1, "guide")


@query("sin_tile", f"WITH {GEO_SQL}, {MATH_SQL} SELECT id, v, h FROM t")
def _sin_tile(t):
    return t.geo_points.select("id", *[c.alias(n) for n, c in g.sin_tile(F.col("lat"), F.col("lon")).items()])


@query("sin_inverse", f"""WITH {POINTS_SQL}, c AS (
  SELECT id, (10007554.677 - (i + 0.5)*(1111950.5196666666/1200/2) - (v + 7)*1111950.5196666666)/6371007.181 AS la,
         (j + 0.5)*(1111950.5196666666/1200/2) + (h + 11)*1111950.5196666666 - 20015109.354 AS x FROM points),
  d AS (SELECT id, la, x/(6371007.181*cos(la)) AS lo FROM c)
  SELECT id, round(degrees(la), 6) AS lat,
         round(degrees(CASE WHEN lo < -pi() THEN lo + 2*pi() WHEN lo > pi() THEN lo - 2*pi() ELSE lo END), 6) AS lon FROM d""")
def _sin_inverse(t):
    c = g.sin_inverse(F.col("v") + 7, F.col("h") + 11, F.col("i"), F.col("j"), res=2)
    return t.points.select("id", *[F.round(x, 6).alias(n) for n, x in c.items()])


@query("sin_round_trip", f"WITH {POINTS_SQL} SELECT id, v + 7 AS v, h + 11 AS h, i, j FROM points")
def _sin_round_trip(t):
    ll = g.sin_inverse(F.col("v") + 7, F.col("h") + 11, F.col("i"), F.col("j"), res=4)
    return t.points.select("id", *[c.alias(n) for n, c in g.sin_forward(ll["lat"], ll["lon"], 4).items()])


@query("upscale", f"""WITH {POINTS_SQL} SELECT id, 2*i + a AS i, 2*j + b AS j FROM points,
  (VALUES (0,0),(0,1),(1,0),(1,1)) AS o(a,b)""")
def _upscale(t):
    return t.points.select("id", F.explode(g.upscale(F.col("i"), F.col("j"))).alias("c")).select("id", "c.i", "c.j")


@query("lon360", f"WITH {GEO_SQL} SELECT id, CASE WHEN lon < 0 THEN lon + 360 ELSE lon END AS lon FROM geo_points")
def _lon360(t):
    return t.geo_points.select("id", g.lon360(F.col("lon")).alias("lon"))


@query("grid_rowcol", f"""WITH {GEO_SQL}, c AS (
  SELECT id, CAST(floor((lat - 80.0)/-0.5) AS INT) AS r, CAST(floor((lon + 180.0)/0.5) AS INT) AS c FROM geo_points)
  SELECT id, CASE WHEN r BETWEEN 0 AND 299 AND c BETWEEN 0 AND 719 THEN r END AS "row",
         CASE WHEN r BETWEEN 0 AND 299 AND c BETWEEN 0 AND 719 THEN c END AS col FROM c""")
def _grid_rowcol(t):
    return t.geo_points.select("id", *[c.alias(n) for n, c in g.grid_rowcol(F.col("lon"), F.col("lat"), HALF_DEGREE).items()])


@query("grid_coords", f"""WITH {POINTS_SQL} SELECT id, off AS "offset", round(-180.0 + 0.5*(j + right_), 6)::DOUBLE AS x,
  round(80.0 - 0.5*(i + down_), 6)::DOUBLE AS y
  FROM points, (VALUES ('center',0.5,0.5),('ul',0,0),('lr',1,1)) AS o(off, down_, right_)""")
def _grid_coords(t):
    return t.points.select("id", F.explode(g.grid_coords_all(F.col("i"), F.col("j"), HALF_DEGREE, ["center", "ul", "lr"]))
                           .alias("c")).select("id", "c.offset", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"))


_LAND_VALUES = ",".join(f"({v},{h},{h})" for v, h in g.LAND_TILES)


@query("known_tiles", f"""WITH {GEO_SQL}, {MATH_SQL} SELECT id, v, h FROM t WHERE EXISTS (
  SELECT 1 FROM (VALUES {_LAND_VALUES}) AS w(wv, a, b) WHERE wv = v AND h BETWEEN a AND b)""")
def _known_tiles(t):
    tile = g.sin_tile(F.col("lat"), F.col("lon"))
    return t.geo_points.select("id", tile["v"].alias("v"), tile["h"].alias("h")).filter(g.known_tile(F.col("v"), F.col("h")))


@query("tile_window", f"WITH {GEO_SQL}, {MATH_SQL} SELECT id, v, h FROM t WHERE v BETWEEN 5 AND 11 AND h BETWEEN 8 AND 20")
def _tile_window(t):
    from pixelmill.operators.layers import tile_window

    tile = g.sin_tile(F.col("lat"), F.col("lon"))
    return tile_window(t.geo_points.select("id", tile["v"].alias("v"), tile["h"].alias("h")), 5, 11, 8, 20)


@query("tile_outline", f"""WITH {POINTS_SQL}, tl AS (SELECT DISTINCT v + 7 AS v, h + 11 AS h FROM points), k AS (
  SELECT v, h, k, CASE WHEN k <= 1199 THEN 0 WHEN k <= 2398 THEN k - 1199 WHEN k <= 3597 THEN 1199 ELSE 4796 - k END AS i,
    CASE WHEN k <= 1199 THEN k WHEN k <= 2398 THEN 1199 WHEN k <= 3597 THEN 3597 - k ELSE 0 END AS j
  FROM tl, (SELECT CAST(unnest(range(0, 4797)) AS INT) AS k)),
  c AS (SELECT v, h, k, (10007554.677 - (i + 0.5)*(1111950.5196666666/1200) - v*1111950.5196666666)/6371007.181 AS la,
         (j + 0.5)*(1111950.5196666666/1200) + h*1111950.5196666666 - 20015109.354 AS x FROM k)
  SELECT v, h, k, round(degrees(la), 6) AS lat, round(degrees(x/(6371007.181*cos(la))), 6) AS lon FROM c""")
def _tile_outline(t):
    tiles = t.points.select((F.col("v") + 7).alias("v"), (F.col("h") + 11).alias("h")).distinct()
    cells = tiles.select("v", "h", F.explode(g.outline()).alias("c")).select("v", "h", "c.k", "c.i", "c.j")
    ll = g.sin_inverse(F.col("v"), F.col("h"), F.col("i"), F.col("j"))
    return cells.select("v", "h", "k", *[F.round(x, 6).alias(n) for n, x in ll.items()])
