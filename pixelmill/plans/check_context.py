"""Population, indicators, climatology."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelmill.functions.grid import GridMeta
from pixelmill.operators import context
from pixelmill.operators.layers import HUMAN
from pixelmill.plans import features
from pixelmill.plans.check_time import GP_SQL, grid_points
from pixelmill.plans.lenses import BURN_SQL, CELLS_SQL, COUNTRIES_SQL, DAILY_SQL, INDICATOR_SQL, POINTS_SQL, TILE
from pixelmill.plans.registry import query
from pixelmill.sources import layers as src

YEARGRID_SQL = """yg AS (SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(o_orderkey % 6 AS INT) AS gr, CAST(o_custkey % 6 AS INT) AS gc,
  sum(o_totalprice) AS v FROM orders WHERE year(o_orderdate) IN (1996, 1998, 2000) GROUP BY 1,2,3)"""


YEARLY_SQL = YEARGRID_SQL.replace("WHERE year(o_orderdate) IN (1996, 1998, 2000) ", "")


def _yeargrid(orders):
    return orders.groupBy(F.year("o_orderdate").alias("year"), (F.col("o_orderkey") % 6).cast("int").alias("row"),
                          (F.col("o_custkey") % 6).cast("int").alias("col")).agg(F.sum("o_totalprice").alias("value"))


@query("add_population_density", f"""WITH {GP_SQL}, {YEARGRID_SQL}, b AS (SELECT gp.*, CASE WHEN year < 1996 THEN NULL WHEN year < 1998 THEN 1996 WHEN year < 2000 THEN 1998
    ELSE 2000 END AS ya, CASE WHEN year <= 1996 THEN 1996 WHEN year <= 1998 THEN 1998 WHEN year <= 2000 THEN 2000 END AS yb FROM gp)
  SELECT id, r AS "row", c AS col, year, round(CASE WHEN ya = yb THEN a.v ELSE a.v + (z.v - a.v)*(year - ya)/(yb - ya) END, 4) AS x_gpw4
  FROM b LEFT JOIN yg a ON a.y = ya AND a.gr = r AND a.gc = c LEFT JOIN yg z ON z.y = yb AND z.gr = r AND z.gc = c""")
def _population(t):
    grid = _yeargrid(t.orders.filter(F.year("o_orderdate").isin(1996, 1998, 2000)))
    out = context.add_population_density(grid_points(t).withColumn("year", F.year("d")).drop("d"), grid, published=(1996, 1998))
    return out.withColumn("x_gpw4", F.round("x_gpw4", 4))


def _indicator(t):
    wide, years = t.indicator_wide
    return src.read_indicator(wide, "X.1", years)


@query("add_indicator", f"""WITH {INDICATOR_SQL}, s AS (SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INT) AS year, upper(substr(n_name,1,3)) AS iso3
    FROM orders JOIN customer ON c_custkey=o_custkey JOIN nation ON n_nationkey=c_nationkey),
  i AS (SELECT upper(substr(country,1,3)) AS iso3, y AS year, v FROM indicator_long)
  SELECT id, s.year, s.iso3, round(v, 2) AS "x_X.1" FROM s LEFT JOIN i ON i.iso3=s.iso3 AND i.year=s.year""")
def _add_indicator(t):
    s = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")) \
        .select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), F.upper(F.substring("n_name", 1, 3)).alias("iso3"))
    return context.add_indicator(s, _indicator(t), "X.1").withColumn("x_X.1", F.round("`x_X.1`", 2))


# monthly climatology on a 6 x 6 grid with gaps
CLIM_SQL = """clim AS (SELECT CAST(month(l_shipdate) AS INT) AS month, CAST(l_partkey % 6 AS INT) AS r, CAST(l_suppkey % 6 AS INT) AS c,
    CASE WHEN (month(l_shipdate)*7 + (l_partkey % 6)*3 + (l_suppkey % 6)*5) % 4 < 2 AND l_suppkey % 6 <> 2 THEN NULL ELSE avg(l_quantity) END AS value FROM lineitem GROUP BY 1,2,3,
    (month(l_shipdate)*7 + (l_partkey % 6)*3 + (l_suppkey % 6)*5) % 4 < 2, l_suppkey % 6 <> 2)"""


def climatology(t):
    g = full_climatology(t)
    gap = ((F.col("month") * 7 + F.col("row") * 3 + F.col("col") * 5) % 4 < 2) & (F.col("col") != 2)
    return g.withColumn("value", F.when(~gap, F.col("value")))


# the same without gaps
FULL_CLIM_SQL = """clim AS (SELECT CAST(month(l_shipdate) AS INT) AS month, CAST(l_partkey % 6 AS INT) AS r, CAST(l_suppkey % 6 AS INT) AS c,
    avg(l_quantity) AS value FROM lineitem GROUP BY 1,2,3)"""


def full_climatology(t):
    m, r, c = F.month("l_shipdate"), F.col("l_partkey") % 6, F.col("l_suppkey") % 6
    return t.lineitem.groupBy(m.alias("month"), r.cast("int").alias("row"), c.cast("int").alias("col")).agg(F.avg("l_quantity").alias("value"))


def _fill_sql(name, src_name, dim, others, gap, extra=""):
    w = f"PARTITION BY {others} ORDER BY {dim}"
    return f"""{name} AS (SELECT month, r, c, CASE WHEN value IS NOT NULL THEN value WHEN bp - ap - 1 <= {gap} THEN av + (bv - av)*({dim} - ap)/(bp - ap) END AS value FROM (
      SELECT *, last_value(CASE WHEN value IS NOT NULL THEN {dim} END IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ap,
        last_value(value IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS av,
        first_value(CASE WHEN value IS NOT NULL THEN {dim} END IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bp,
        first_value(value IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bv FROM {src_name}) {extra})"""


TRIPLE_SQL = "c3 AS (SELECT month + k AS month, r, c, value FROM clim, (VALUES (-12),(0),(12)) AS n(k))"
FILLED_SQL = ", ".join([CLIM_SQL, TRIPLE_SQL, _fill_sql("fm", "c3", "month", "r, c", 1, "WHERE month BETWEEN 1 AND 12"),
                        _fill_sql("fr", "clim", "r", "month, c", 1), _fill_sql("fc", "clim", "c", "month, r", 2)])


@query("fill_gaps", f"WITH {FILLED_SQL} SELECT month, r AS \"row\", c AS col, round(value, 6) AS value FROM fc")
def _fill(t):
    return context.fill_gaps(climatology(t), "col", 2, ["month", "row"]).withColumn("value", F.round("value", 6))


@query("fill_gaps_circular", f"WITH {FILLED_SQL} SELECT month, r AS \"row\", c AS col, round(value, 6) AS value FROM fm")
def _fill_circular(t):
    return context.fill_gaps(climatology(t), "month", 1, ["row", "col"], circular=12).withColumn("value", F.round("value", 6))


@query("add_lightning", f"""WITH {FILLED_SQL}, {GP_SQL}, m AS (SELECT month, r, c, avg(value) AS value FROM (SELECT * FROM fm UNION ALL SELECT * FROM fr UNION ALL SELECT * FROM fc)
    GROUP BY ALL) SELECT id, gp.r AS "row", gp.c AS col, gp.month, round(value, 6) AS x_lightn FROM gp LEFT JOIN m ON m.r=gp.r AND m.c=gp.c AND m.month=gp.month""")
def _lightning(t):
    p = grid_points(t).select("id", "row", "col", F.month("d").alias("month"))
    return context.add_lightning(p, climatology(t), True, max_gaps={"month": 1, "row": 1, "col": 2}).select(
        "id", "row", "col", "month", F.round("x_lightn", 6).alias("x_lightn"))


@query("append_features", f"WITH {POINTS_SQL} SELECT id, fire, o_totalprice AS x_a, o_custkey AS x_b FROM points JOIN orders ON o_orderkey = id")
def _append(t):
    a = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x_a"))
    b = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("x_b"))
    return context.append_features(t.points.select("id", "fire"), [a, b], ["id"])


FEATURE_SQL = f"""{POINTS_SQL}, {COUNTRIES_SQL}, {BURN_SQL}, {DAILY_SQL}, {YEARLY_SQL}, {CELLS_SQL}, {FULL_CLIM_SQL}, {INDICATOR_SQL}, c AS (
    SELECT id, 1 + id % 17 AS lct, v + 7 AS v, h + 11 AS h, i, j, year, yday, d, (10007554.677 - (i + 0.5)*(1111950.5196666666/1200/2) - (v + 7)*1111950.5196666666)/6371007.181 AS la,
      (j + 0.5)*(1111950.5196666666/1200/2) + (h + 11)*1111950.5196666666 - 20015109.354 AS x FROM points),
  g AS (SELECT *, v*24 + i AS gi, h*24 + j AS gj, degrees(la) AS lat, degrees(x/(6371007.181*cos(la))) AS lon FROM c),
  r AS (SELECT *, CAST(floor((90 - lat)/30) AS INT) AS r, CAST(floor((lon + 180)/60) AS INT) AS c FROM g),
  rd AS (SELECT CAST(s_suppkey % 6 AS INT) AS r, CAST(s_nationkey % 6 AS INT) AS c, sum(s_acctbal) AS road FROM supplier GROUP BY 1,2),
  b AS (SELECT (v + 7)*24 + i AS bi, (h + 11)*24 + j AS bj, make_date(year,1,1) + CAST(burn_date - 1 AS INT) AS bd FROM burn WHERE burn_date > 0 AND uncertainty <= 2),
  nf AS (SELECT id, count(DISTINCT (bi - gi)*100 + bj - gj) AS n FROM r p JOIN b ON abs(bi - gi) <= 1 AND abs(bj - gj) <= 1
    AND NOT (bi = gi AND bj = gj) AND CAST(d AS DATE) - CAST(bd AS DATE) BETWEEN 1 AND 10 GROUP BY 1),
  near0 AS (SELECT p.*, (SELECT max(date) FROM cells c WHERE var = 'lct' AND c.v + 7 = p.v AND c.h + 11 = p.h AND date <= make_date(p.year - 1, 1, 1)
    AND date >= make_date(p.year - 1, 1, 1) - 400) AS ld FROM r p),
  wild AS (SELECT (v + 7)*24 + i AS wi, (h + 11)*24 + j AS wj, date, value FROM cells WHERE var = 'lct' AND value IN (12, 13, 14)),
  near AS (SELECT id, CASE WHEN ld IS NOT NULL THEN CAST(count(value) AS INT) END AS n FROM near0 LEFT JOIN wild ON abs(wi - gi) <= 1 AND abs(wj - gj) <= 1
    AND NOT (wi = gi AND wj = gj) AND date = ld GROUP BY id, ld),
  ind AS (SELECT upper(substr(country,1,3)) AS iso3, y AS year, v FROM indicator_long)"""
FEATURE_COLUMNS = ", ".join(f"lct = {k} AS x_lct_{k}" for k in range(1, 18))


@query("feature_table", f"""WITH {FEATURE_SQL}
  SELECT r.id, round(lat, 6) AS lat, round(lon, 6) AS lon, name AS country, CASE WHEN countries.iso3 <> '-99' THEN countries.iso3 ELSE name END AS iso3, continent,
    round(road, 4) AS x_road, coalesce(nf.n, 0)::INT AS x_nf, round(yv, 4) AS x_gpw4, round(d0.value, 6) AS x_tp_0, round(d1.value, 6) AS x_tp_hist_mean,
    round(d0.value, 6) AS x_fwi, round(cl.value, 6) AS x_lightn, near.n AS x_human, round(ind.v, 2) AS x_gdp, {FEATURE_COLUMNS}
  FROM r LEFT JOIN countries ON lon BETWEEN xmin AND xmax AND lat BETWEEN ymin AND ymax LEFT JOIN rd ON rd.r=r.r AND rd.c=r.c LEFT JOIN nf ON nf.id=r.id
  LEFT JOIN (SELECT y, gr, gc, v AS yv FROM yg) ON y = r.year AND gr = r.r AND gc = r.c LEFT JOIN near ON near.id = r.id
  LEFT JOIN daily d0 ON d0.row_=r.r AND d0.col_=r.c AND d0.date=d LEFT JOIN daily d1 ON d1.row_=r.r AND d1.col_=r.c AND d1.date=d - 1 AND year(d1.date)=r.year
  LEFT JOIN clim cl ON cl.month = month(d) AND cl.r = r.r AND cl.c = r.c
  LEFT JOIN ind ON ind.year = r.year AND ind.iso3 = CASE WHEN countries.iso3 <> '-99' THEN countries.iso3 ELSE name END""")
def _features(t):
    meta = GridMeta(60.0, 0.0, -180.0, 0.0, -30.0, 90.0, 6, 6)
    shift = {"v": F.col("v") + 7, "h": F.col("h") + 11}
    lct = (F.col("id") % 17 + 1).alias("lct")
    samples = t.points.select("id", lct, "v", "h", F.col("i").alias("i2"), F.col("j").alias("j2"), "year", "yday").withColumns(shift)
    roads = t.supplier.groupBy((F.col("s_suppkey") % 6).cast("int").alias("row"), (F.col("s_nationkey") % 6).cast("int").alias("col")) \
        .agg(F.sum("s_acctbal").alias("value"))
    land = src.read_layer(t.cells, "LAND", "lct").withColumns(shift)
    out = features.build(samples, {
        "weather": [("tp", t.daily, meta, 2, 1)], "fire_weather": (t.daily, meta), "roads": (roads, meta), "countries": (t.countries, None),
        "burn": (t.burn.withColumns(shift), 1, 10), "population": (_yeargrid(t.orders), meta, (1995, 1998, 2001)), "lightning": (full_climatology(t), meta, True),
        "land_cover": ("human", land, HUMAN, 1), "indicators": [("gdp", _indicator(t))], "one_hot": range(1, 18)}, n=TILE,
        digits={"lat": 6, "lon": 6, "x_road": 4, "x_gpw4": 4, "x_tp_0": 6, "x_tp_hist_mean": 6, "x_fwi": 6, "x_lightn": 6, "x_gdp": 2})
    return out.select("id", "lat", "lon", "country", "iso3", "continent", "x_road", "x_nf", "x_gpw4", "x_tp_0", "x_tp_hist_mean", "x_fwi", "x_lightn",
                      "x_human", "x_gdp", *[f"x_lct_{k}" for k in range(1, 18)])
