"""Look-backs, as-of joins and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelmill.operators import asof, neighborhood, series, weather
from pixelmill.operators import tables as tb
from pixelmill.plans.lenses import BURN_SQL, CELLS_SQL, DAILY_SQL, MONTHLY_SQL, NAMES_SQL, POINTS_SQL
from pixelmill.plans.registry import query
from pixelmill.sources import layers as src

r6 = lambda c, n: F.round(c, 6).alias(n)

LAYERS_SQL = f"""{BURN_SQL}, layers AS (SELECT DISTINCT v, h, make_date(year, month, 1) AS date FROM burn)"""
GP_SQL = f"{POINTS_SQL}, gp AS (SELECT id, i % 6 AS r, j % 6 AS c, year, month(d)::INT AS month, d FROM points)"


def grid_points(t):
    return t.points.select("id", (F.col("i") % 6).alias("row"), (F.col("j") % 6).alias("col"), "d")


def monthly_layers(t):
    return t.burn.select("v", "h", F.make_date("year", "month", F.lit(1)).alias("date")).distinct()


@query("asof_layer", f"""WITH {POINTS_SQL}, {LAYERS_SQL} SELECT id, p.v, p.h, d, max(date) AS layer_date FROM points p
  LEFT JOIN layers l ON l.v=p.v AND l.h=p.h AND date < d AND date >= d - 21 GROUP BY ALL""")
def _asof(t):
    return asof.asof_layer(t.points.select("id", "v", "h", "d"), monthly_layers(t), 21)


@query("asof_layer_inclusive", f"""WITH {POINTS_SQL}, {LAYERS_SQL} SELECT id, p.v, p.h, d, max(date) AS layer_date FROM points p
  LEFT JOIN layers l ON l.v=p.v AND l.h=p.h AND date <= d AND date >= d - 10 GROUP BY ALL""")
def _asof_incl(t):
    return asof.asof_layer(t.points.select("id", "v", "h", "d"), monthly_layers(t), 10, include_same_day=True)


@query("asof_values", f"""WITH {POINTS_SQL}, {CELLS_SQL}, a AS (SELECT p.*, (SELECT max(date) FROM cells c WHERE var = 'lct' AND c.v=p.v AND c.h=p.h
    AND date < d AND date >= d - 400) AS layer_date FROM points p)
  SELECT id, a.v, a.h, a.i, a.j, d, layer_date, value FROM a LEFT JOIN cells c ON var = 'lct' AND c.v=a.v AND c.h=a.h AND c.i=a.i AND c.j=a.j AND c.date=layer_date""")
def _asof_values(t):
    return asof.asof_values(t.points.select("id", "v", "h", "i", "j", "d"), src.read_layer(t.cells, "LAND", "lct"), 400)


@query("latest_per_group", f"""WITH {NAMES_SQL}, f AS (SELECT v, h, path, CAST(make_date(year,1,1) + CAST(yday - 1 AS INT) AS DATE) AS date FROM names)
  SELECT v, h, max(path) AS path, max(date) AS date FROM f WHERE (v, h, date) IN (SELECT (v, h, max(date)) FROM f GROUP BY v, h) GROUP BY ALL""")
def _latest(t):
    idx = src.file_index(t.names.select("path")).select("path", F.col("fname_date").alias("date"), F.col("tile_v").alias("v"), F.col("tile_h").alias("h"))
    return asof.latest_per_group(idx, ["v", "h"])


@query("previous_month_layer", f"""WITH {NAMES_SQL}, f AS (SELECT DISTINCT v, h, path, CAST(make_date(year,1,1) + CAST(yday - 1 AS INT) AS DATE) AS date
    FROM names), m AS (SELECT v, h, date_trunc('month', date)::DATE AS m, min(path) AS pp FROM f GROUP BY ALL)
  SELECT 'MCD64A1' AS product, f.v, f.h, path, date, pp AS previous_path FROM f LEFT JOIN m ON m.v=f.v AND m.h=f.h
  AND m.m = (date_trunc('month', date) - INTERVAL 1 MONTH)::DATE""")
def _previous(t):
    idx = src.file_index(t.names.select("path")).select(
        "product", "path", F.col("fname_date").alias("date"), F.col("tile_v").alias("v"), F.col("tile_h").alias("h"))
    return asof.previous_month_layer(idx)


def _lag_joins(n):
    return "\n".join(f"LEFT JOIN daily d{k} ON d{k}.row_ = r AND d{k}.col_ = c AND d{k}.date = d - {k} AND year(d - {k}) = year(d)" for k in range(n))


@query("daily_window_lookup", f"""WITH {GP_SQL}, {DAILY_SQL} SELECT id, r AS "row", c AS col, d,
  {', '.join(f'round(d{k}.value, 6) AS lag{k}' for k in range(5))} FROM gp {_lag_joins(5)}""")
def _window(t):
    out = weather.daily_window_lookup(grid_points(t), t.daily, 5)
    return out.select("id", "row", "col", "d", *[r6(F.col("lags")[k], f"lag{k}") for k in range(5)])


@query("add_weather", f"""WITH {GP_SQL}, {DAILY_SQL} SELECT id, r AS "row", c AS col, d, round(d0.value, 6) AS x_t2m_0, round(d1.value, 6) AS x_t2m_1,
  round(list_min(tail), 6) AS x_t2m_hist_min, round(list_avg(tail), 6) AS x_t2m_hist_mean, round(list_max(tail), 6) AS x_t2m_hist_max
  FROM (SELECT *, list_filter([{', '.join(f'd{k}.value' for k in range(2, 7))}], lambda x: x IS NOT NULL) AS tail FROM gp {_lag_joins(7)})"""
       .replace("SELECT id, r AS \"row\", c AS col, d, round(d0.value, 6) AS x_t2m_0, round(d1.value, 6) AS x_t2m_1",
                "SELECT id, r AS \"row\", c AS col, d, round(v0, 6) AS x_t2m_0, round(v1, 6) AS x_t2m_1")
       .replace("(SELECT *, list_filter", "(SELECT gp.*, d0.value AS v0, d1.value AS v1, list_filter"))
def _weather(t):
    out = weather.add_weather(grid_points(t), t.daily, "t2m", 7, 2)
    return out.select("id", "row", "col", "d", *[r6(F.col(c), c) for c in out.columns if c.startswith("x_")])


@query("add_fire_weather_index", f"""WITH {GP_SQL}, {DAILY_SQL} SELECT id, r AS "row", c AS col, d, round(value, 6) AS x_fwi
  FROM gp LEFT JOIN daily ON row_ = r AND col_ = c AND date = d""")
def _fwi(t):
    return weather.add_fire_weather_index(grid_points(t), t.daily).withColumn("x_fwi", F.round("x_fwi", 6))


@query("agg_tail", f"""WITH s AS (SELECT l_orderkey AS id, avg(l_quantity) AS q, min(l_tax) AS a, max(l_tax) AS b, min(l_discount) AS c FROM lineitem GROUP BY 1)
  SELECT id, q AS x_w_0, least(a, b, c) AS x_w_hist_min, round((a + b + c)/3, 6) AS x_w_hist_mean, greatest(a, b, c) AS x_w_hist_max FROM s""".replace("q AS x_w_0", "round(q, 6) AS x_w_0"))
def _tail(t):
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.array(
        F.avg("l_quantity"), F.min("l_tax"), F.lit(None), F.max("l_tax"), F.min("l_discount")).alias("lags"))
    out = s.select("id", *weather.agg_tail(F.col("lags"), 1, "x_w"))
    return out.withColumns({"x_w_0": F.round("x_w_0", 6), "x_w_hist_mean": F.round("x_w_hist_mean", 6)})


_RPD_SQL = """tg AS (SELECT DISTINCT r, c, year, month, year*12 + month - 1 AS m FROM gp),
  cl AS (SELECT tg.*, p.month AS pm, avg(value) AS clim FROM tg JOIN monthly p ON row_=r AND col_=c
    AND p.year*12 + p.month - 1 >= m - 12*3 AND p.year*12 + p.month - 1 < m - 12 GROUP BY ALL),
  ac AS (SELECT tg.*, p.month AS pm, count(value) AS n, sum(value) AS s FROM tg JOIN monthly p ON row_=r AND col_=c
    AND p.year*12 + p.month - 1 >= m - 12 AND p.year*12 + p.month - 1 < m GROUP BY ALL),
  rpd AS (SELECT cl.r, cl.c, cl.year, cl.month, sum(coalesce(n*clim - s, 0))/(sum(clim)*1) AS rpd FROM cl
    LEFT JOIN ac ON ac.r=cl.r AND ac.c=cl.c AND ac.year=cl.year AND ac.month=cl.month AND ac.pm=cl.pm GROUP BY ALL)"""


@query("precip_deficit", f"""WITH {GP_SQL}, {MONTHLY_SQL}, {_RPD_SQL} SELECT tg.r AS "row", tg.c AS col, tg.year, tg.month, round(rpd + 1e-10, 6) AS rpd
  FROM tg LEFT JOIN rpd USING (r, c, year, month)""")
def _deficit(t):
    targets = grid_points(t).select("row", "col", F.year("d").alias("year"), F.month("d").alias("month"))
    return weather.precip_deficit(t.monthly, targets, 2, 1).withColumn("rpd", F.round(F.col("rpd") + 1e-10, 6))


@query("add_precip_deficit", f"""WITH {GP_SQL}, {MONTHLY_SQL}, {_RPD_SQL} SELECT id, r AS "row", c AS col, d, round(rpd + 1e-10, 6) AS x_rpd
  FROM gp LEFT JOIN rpd USING (r, c, year, month)""")
def _add_deficit(t):
    return weather.add_precip_deficit(grid_points(t), t.monthly, 2, 1).withColumn("x_rpd", F.round(F.col("x_rpd") + 1e-10, 6))


# finer cells: 8 x 8 per tile, monthly
VI_SQL = """vi AS (SELECT l_linenumber % 2 AS v, CAST(l_suppkey % 3 AS INT) AS h, CAST(l_partkey % 8 AS INT) AS i, CAST(l_orderkey % 8 AS INT) AS j,
  CAST(date_trunc('month', l_shipdate) AS DATE) AS date, avg(l_quantity) AS value FROM lineitem GROUP BY 1,2,3,4,5)"""


@query("add_vegetation_index", f"""WITH {POINTS_SQL}, {VI_SQL}, p AS (SELECT id, v, h, i % 4 AS i, j % 4 AS j, d FROM points),
  a AS (SELECT p.*, (SELECT max(date) FROM vi WHERE vi.v=p.v AND vi.h=p.h AND date < d AND date >= d - 21) AS ld FROM p)
  SELECT id, a.v, a.h, a.i, a.j, d, CASE WHEN count(value) = 4 THEN round(avg(value), 6) END AS x_evi_mean,
  CASE WHEN count(value) = 4 THEN round(stddev_pop(value), 6) END AS x_evi_std, CAST(d - ld AS INT) AS x_evi_tdiff
  FROM a LEFT JOIN vi ON vi.v=a.v AND vi.h=a.h AND floor(vi.i/2)=a.i AND floor(vi.j/2)=a.j AND vi.date=ld GROUP BY ALL""")
def _vegetation(t):
    vi = t.lineitem.groupBy((F.col("l_linenumber") % 2).alias("v"), (F.col("l_suppkey") % 3).cast("int").alias("h"),
                            (F.col("l_partkey") % 8).cast("int").alias("i"), (F.col("l_orderkey") % 8).cast("int").alias("j"),
                            F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("date")).agg(F.avg("l_quantity").alias("value"))
    p = t.points.select("id", "v", "h", (F.col("i") % 4).alias("i"), (F.col("j") % 4).alias("j"), "d")
    return neighborhood.add_vegetation_index(p, vi).withColumns({c: F.round(c, 6) for c in ("x_evi_mean", "x_evi_std")})


@query("carry_dates", f"WITH {POINTS_SQL} SELECT id, CAST(d - k AS DATE) AS d FROM points, (VALUES (0),(1),(2)) AS n(k)".replace("d - k", "d - CAST(k AS INT)"))
def _carry(t):
    return tb.carry_dates(t.points.select("id", "d"), "d", 3, forward=False)


@query("is_complete_year", """WITH x AS (SELECT DISTINCT o_orderstatus AS s, CAST(year(o_orderdate) AS INT) AS y, CAST(o_orderdate AS DATE) AS d FROM orders)
  SELECT s, y, count(*) = dayofyear(make_date(y, 12, 31)) AS complete FROM x GROUP BY s, y""")
def _complete(t):
    x = t.orders.select(F.col("o_orderstatus").alias("s"), F.year("o_orderdate").alias("y"), F.col("o_orderdate").cast("date").alias("d")).distinct()
    return tb.is_complete_year(x, "d", ["s", "y"])


@query("rolling_mean", """WITH w AS (SELECT event_id, user_id, event_type, value, ts, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s, count(value) OVER w AS n FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
  SELECT event_id, CASE WHEN n = 10 THEN round(m, 6) END AS rolling_mean, CASE WHEN n = 10 THEN round(s, 6) END AS rolling_std,
  CASE WHEN n = 10 THEN round(m - s/2, 6) END AS band_lo FROM w""")
def _rolling(t):
    e = t.events.select("event_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    out = series.rolling(e, "value", F.col("t"), [F.col("event_id")], 10, ["event_type"], chunk=500)
    return out.select("event_id", *[r6(F.col(c), c) for c in ("rolling_mean", "rolling_std", "band_lo")])


@query("non_decreasing", """WITH m AS (SELECT c_nationkey AS k, c_mktsegment AS s, count(*) AS n FROM customer GROUP BY ALL),
  l AS (SELECT k, n >= lag(n) OVER (PARTITION BY k ORDER BY s) AS ok FROM m) SELECT k, coalesce(bool_and(ok), true) AS non_decreasing FROM l GROUP BY k""")
def _nondec(t):
    m = t.customer.groupBy(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return series.non_decreasing(m, "n", ["k"], "s")


@query("running_max", """WITH m AS (SELECT c_nationkey AS k, c_mktsegment AS s, avg(c_acctbal)/10000 AS x FROM customer GROUP BY ALL),
  c AS (SELECT *, max(x) OVER (PARTITION BY k ORDER BY s) AS m FROM m), r AS (SELECT *, min(m) OVER (PARTITION BY k) AS lo, max(m) OVER (PARTITION BY k) AS hi FROM c)
  SELECT k, s, round((m - lo)/nullif(hi - lo, 0)*(1 - lo) + lo, 6) AS y FROM r""")
def _running_max(t):
    m = t.customer.groupBy(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("s")).agg((F.avg("c_acctbal") / 10000).alias("x"))
    return series.running_max(m, "x", ["k"], "s", "y").select("k", "s", r6(F.col("y"), "y"))
