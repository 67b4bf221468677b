"""Neighbourhoods and countries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelmill.functions.grid import GridMeta
from pixelmill.operators import context, neighborhood
from pixelmill.operators.layers import CELL
from pixelmill.plans.lenses import BURN_SQL, CELLS_SQL, COUNTRIES_SQL, GEO_SQL, POINTS_SQL, TILE
from pixelmill.plans.registry import query
from pixelmill.sources import layers as src

_OFF_SQL = "(SELECT CAST(a AS INT) AS di, CAST(b AS INT) AS dj FROM range(-{d}, {d}+1) x(a), range(-{d}, {d}+1) y(b) WHERE NOT (a = 0 AND b = 0))"


@query("neighbors", f"""WITH {POINTS_SQL}, {CELLS_SQL} SELECT id, p.v, p.h, p.i, p.j, di, dj,
  CASE WHEN p.i + di BETWEEN 0 AND 23 AND p.j + dj BETWEEN 0 AND 23 THEN value ELSE -1.0 END::DOUBLE AS value
  FROM points p CROSS JOIN {_OFF_SQL.format(d=1)} LEFT JOIN cells c ON var = 'lct' AND date = DATE '1998-01-01' AND c.v=p.v AND c.h=p.h AND c.i=p.i+di AND c.j=p.j+dj""")
def _neighbors(t):
    import datetime

    layer = src.read_layer(t.cells, "LAND", "lct", datetime.date(1998, 1, 1)).drop("date")
    return neighborhood.neighbors(layer, t.points.select("id", *CELL), 1, TILE, outside=-1)


@query("neighbors_across", f"""WITH {POINTS_SQL}, {CELLS_SQL}, g AS (SELECT v*24 + i AS gi, h*24 + j AS gj, value FROM cells WHERE var = 'lct' AND date = DATE '1998-01-01')
  SELECT id, p.v, p.h, p.i, p.j, di, dj, value FROM points p CROSS JOIN {_OFF_SQL.format(d=1)} LEFT JOIN g ON gi = p.v*24 + p.i + di AND gj = p.h*24 + p.j + dj""")
def _neighbors_across(t):
    import datetime

    layer = src.read_layer(t.cells, "LAND", "lct", datetime.date(1998, 1, 1)).drop("date")
    return neighborhood.neighbors(layer, t.points.select("id", *CELL), 1, TILE, across=True)


# cells by their place in the whole grid
BURN_GLOBAL_SQL = f"""{BURN_SQL}, b AS (SELECT v*24 + i AS bi, h*24 + j AS bj, make_date(year,1,1) + CAST(burn_date - 1 AS INT) AS bd FROM burn
    WHERE burn_date > 0 AND uncertainty <= 2)"""


@query("add_neighboring_fires", f"""WITH {POINTS_SQL}, {BURN_GLOBAL_SQL}, p AS (SELECT *, v*24 + i AS gi, h*24 + j AS gj FROM points)
  SELECT id, p.v, p.h, p.i, p.j, d, CAST(count(DISTINCT CASE WHEN bd IS NOT NULL THEN (bi - gi)*100 + bj - gj END) AS INT) AS x_nf
  FROM p LEFT JOIN b ON abs(bi - gi) <= 2 AND abs(bj - gj) <= 2 AND NOT (bi = gi AND bj = gj)
    AND CAST(d AS DATE) - CAST(bd AS DATE) BETWEEN 1 AND 60 GROUP BY ALL""")
def _nf(t):
    return neighborhood.add_neighboring_fires(t.points.select("id", *CELL, "d"), t.burn, 2, 60, n=TILE)


@query("add_land_cover_nearby", f"""WITH {POINTS_SQL}, {CELLS_SQL}, a AS (SELECT p.*, v*24 + i AS gi, h*24 + j AS gj, (SELECT max(date) FROM cells c WHERE var = 'lct'
    AND c.v=p.v AND c.h=p.h AND date <= make_date(p.year - 1, 1, 1) AND date >= make_date(p.year - 1, 1, 1) - 400) AS ld FROM points p),
  k AS (SELECT v*24 + i AS ci, h*24 + j AS cj, date, value FROM cells WHERE var = 'lct' AND value IN (1,2,3,4,5))
  SELECT id, a.v, a.h, a.i, a.j, d, CASE WHEN ld IS NOT NULL THEN CAST(count(value) AS INT) END AS x_near FROM a
  LEFT JOIN k ON abs(ci - gi) <= 1 AND abs(cj - gj) <= 1 AND NOT (ci = gi AND cj = gj) AND date = ld GROUP BY a.id, a.v, a.h, a.i, a.j, d, ld""")
def _lct_nearby(t):
    layer = src.read_layer(t.cells, "LAND", "lct")
    dates = t.lct.select("v", "h", F.make_date("year", F.lit(1), F.lit(1)).alias("date")).distinct()
    return neighborhood.add_land_cover_nearby(t.points.select("id", *CELL, "d"), layer, [1, 2, 3, 4, 5], 1, "near", n=TILE, dates=dates)


_FILL_ISO = """CASE WHEN iso3 <> '-99' THEN iso3 ELSE name END"""


@query("add_country_and_continent", f"""WITH {GEO_SQL}, {COUNTRIES_SQL} SELECT id, lon, lat, name AS country, {_FILL_ISO} AS iso3, continent
  FROM geo_points LEFT JOIN countries ON lon BETWEEN xmin AND xmax AND lat BETWEEN ymin AND ymax""")
def _countries(t):
    return context.add_country_and_continent(t.geo_points, t.countries)


# every country is a triangle with a rectangular hole and a rectangle apart from it; another country lies in the hole
POLYGONS_SQL = f"""{COUNTRIES_SQL}, hit AS (SELECT id, lon, lat, name, iso3, continent FROM geo_points JOIN countries
    ON (lon BETWEEN xmin AND xmax AND lat BETWEEN ymin AND ymax AND (lon - xmin)/72.0 + (lat - ymin)/36.0 <= 1
        AND NOT (lon > xmin + 10 AND lon < xmin + 25 AND lat > ymin + 4 AND lat < ymin + 12))
      OR (lon BETWEEN xmax - 20 AND xmax - 3 AND lat BETWEEN ymax - 9 AND ymax - 2)
  UNION ALL SELECT id, lon, lat, name || ' ENCLAVE', iso3, continent FROM geo_points JOIN countries
    ON lon BETWEEN xmin + 10 AND xmin + 25 AND lat BETWEEN ymin + 4 AND ymin + 12)"""


TRIANGLE = [("xmin", 0, "ymin", 0), ("xmax", 0, "ymin", 0), ("xmin", 0, "ymax", 0)]
HOLE = [("xmin", 10, "ymin", 4), ("xmin", 25, "ymin", 4), ("xmin", 25, "ymin", 12), ("xmin", 10, "ymin", 12)]
APART = [("xmax", -20, "ymax", -9), ("xmax", -3, "ymax", -9), ("xmax", -3, "ymax", -2), ("xmax", -20, "ymax", -2)]


def _rings(*rings):
    """Array of rings of (column, distance from it) for longitude and latitude."""
    return F.array(*[F.array(*[F.struct((F.col(x) + dx).alias("lon"), (F.col(y) + dy).alias("lat")) for x, dx, y, dy in r]) for r in rings])


@query("add_country_polygons", f"""WITH {GEO_SQL}, {POLYGONS_SQL} SELECT p.id, p.lon, p.lat, name AS country, {_FILL_ISO} AS iso3, continent
  FROM geo_points p LEFT JOIN hit ON hit.id = p.id""")
def _polygons(t):
    main = t.countries.select("name", "iso3", "continent", _rings(TRIANGLE, HOLE, APART).alias("ring"))
    enclaves = t.countries.select(F.concat("name", F.lit(" ENCLAVE")).alias("name"), "iso3", "continent", _rings(HOLE).alias("ring"))
    return context.add_country_and_continent(t.geo_points, src.read_boundaries(main.union(enclaves)), rings="rings")


@query("read_boundaries", f"""WITH {COUNTRIES_SQL} SELECT name, xmin, xmax, CASE WHEN n = 1 THEN ymin ELSE ymin - 1 END AS ymin, ymax, n AS n_rings
  FROM countries, (VALUES (1),(2)) AS k(n)""")
def _boundaries(t):
    """As text: one ring, and several polygons, the second reaching further south."""
    def ring(*corners):
        points = [F.concat(F.lit("["), F.col(x), F.lit(", "), F.col(y) + dy, F.lit("]")) for x, y, dy in corners]
        return F.concat(F.lit("["), F.concat_ws(", ", *points), F.lit("]"))

    box = ring(("xmin", "ymin", 0), ("xmax", "ymin", 0), ("xmax", "ymax", 0), ("xmin", "ymax", 0))
    south = ring(("xmin", "ymin", -1), ("xmax", "ymin", -1), ("xmin", "ymin", 0))
    many = F.concat(F.lit("[ [["), F.substring(box, 2, 1000), F.lit("], ["), south, F.lit("]]"))
    texts = t.countries.select("name", F.explode(F.array(box, many)).alias("ring"))
    return src.read_boundaries(texts).select("name", "xmin", "xmax", "ymin", "ymax", F.size("rings").alias("n_rings"))


@query("add_road_density", f"""WITH {GEO_SQL}, g AS (SELECT id, CAST(floor((90 - lat)/30) AS INT) AS r, CAST(floor((lon + 180)/60) AS INT) AS c FROM geo_points),
  rd AS (SELECT CAST(s_suppkey % 6 AS INT) AS r, CAST(s_nationkey % 6 AS INT) AS c, sum(s_acctbal) AS v FROM supplier GROUP BY 1,2)
  SELECT id, g.r AS "row", g.c AS col, round(v, 4) AS x_road FROM g LEFT JOIN rd USING (r, c)""")
def _roads(t):
    meta = GridMeta(60.0, 0.0, -180.0, 0.0, -30.0, 90.0, 6, 6)
    roads = t.supplier.groupBy((F.col("s_suppkey") % 6).cast("int").alias("row"), (F.col("s_nationkey") % 6).cast("int").alias("col")) \
        .agg(F.sum("s_acctbal").alias("value"))
    out = context.add_road_density(context.locate(t.geo_points, meta), roads)
    return out.select("id", "row", "col", F.round("x_road", 4).alias("x_road"))
