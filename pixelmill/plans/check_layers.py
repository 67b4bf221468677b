"""Scans, masks and cell joins over the land cover and burn lenses."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelmill.operators import layers as L
from pixelmill.operators import tables as tb
from pixelmill.plans import sample_index
from pixelmill.plans.lenses import BURN_SQL, CELLS_SQL, DAILY_SQL, INDICATOR_SQL, LCT_SQL, NAMES_SQL, POINTS_SQL, TILE
from pixelmill.plans.registry import query
from pixelmill.sources import layers as src

r6 = lambda c, n: F.round(c, 6).alias(n)

STABLE_SQL = f"""{LCT_SQL}, stable AS (
  SELECT a.v, a.h, a.i, a.j, a.year, a.lct FROM lct a JOIN lct b ON a.v=b.v AND a.h=b.h AND a.i=b.i AND a.j=b.j AND b.year=a.year+1
  WHERE a.lct=b.lct AND a.qc=b.qc AND a.qc=0 AND a.lct NOT IN (13,15,16,255)
    AND a.i BETWEEN 1 AND 22 AND a.j BETWEEN 1 AND 22)"""
LABELLED_SQL = f"""{STABLE_SQL}, {BURN_SQL}, y AS (
  SELECT s.*, u.month, u.burn_date, u.uncertainty, u.burn_date > 0 AS fire
  FROM stable s JOIN burn u ON s.v=u.v AND s.h=u.h AND s.i=u.i AND s.j=u.j AND s.year=u.year
  WHERE burn_date >= 0 AND uncertainty <= 1)"""
# a 1-km fire mask with classes 0..9, per month
FIRE_SQL = f"""{BURN_SQL}, fire1 AS (
  SELECT v, h, CAST(floor(i/2) AS INT) AS i, CAST(floor(j/2) AS INT) AS j, year,
         make_date(year, month, 1) AS date, CAST(max(burn_date + 1) % 10 AS DOUBLE) AS value FROM burn GROUP BY 1,2,3,4,5,6)"""


def fire_layer(t):
    return t.burn.groupBy("v", "h", F.floor(F.col("i") / 2).cast("int").alias("i"), F.floor(F.col("j") / 2).cast("int").alias("j"),
                          F.make_date("year", "month", F.lit(1)).alias("date")) \
        .agg((F.max(F.col("burn_date") + 1) % 10).cast("double").alias("value"))


def stable(t):
    return L.stable_land_cover(t.lct, margin=1, n=TILE)


def labelled(t):
    return L.burn_quality(L.attach_burn_layers(stable(t), t.burn)).withColumn("fire", F.col("burn_date") > 0)


@query("y_index_burn_stats", f"""WITH {LABELLED_SQL} SELECT v, h, year, sum(CAST(fire AS INT))::BIGINT AS n_pos, count(*) AS N,
  round(sum(CAST(fire AS INT))*1.0/count(*), 6)::DOUBLE AS r_pos FROM y GROUP BY v, h, year""")
def _flagship(t):
    return L.burn_stats(labelled(t), ["v", "h", "year"]).withColumn("r_pos", F.round("r_pos", 6))


@query("read_layer", f"WITH {CELLS_SQL} SELECT v, h, i, j, date, value FROM cells WHERE var = 'lct' AND date = DATE '1997-01-01'")
def _read_layer(t):
    import datetime

    return src.read_layer(t.cells, "LAND", "lct", datetime.date(1997, 1, 1)).select("v", "h", "i", "j", "date", "value")


@query("explode_rows", f"WITH {CELLS_SQL} SELECT product, var, v, h, i, j, date, value FROM cells")
def _explode_rows(t):
    packed = src.pack_rows(t.cells, TILE)
    return src.explode_rows(packed).filter("value IS NOT NULL").select("product", "var", "v", "h", "i", "j", "date", "value")


@query("read_population_grid", """SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(o_orderkey % 6 AS INT) AS "row",
  CAST(o_custkey % 6 AS INT) AS col, CASE WHEN count(*) <> 1 THEN CAST(count(*) AS DOUBLE) END AS value
  FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1,2,3""")
def _population(t):
    grid = t.orders.groupBy(F.year("o_orderdate").alias("year"), (F.col("o_orderkey") % 6).cast("int").alias("row"),
                            (F.col("o_custkey") % 6).cast("int").alias("col")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return src.read_population_grid(grid, 1997, [1.0])


@query("read_indicator", f"""WITH {INDICATOR_SQL} SELECT country AS country_long, upper(substr(country,1,3)) AS country_iso3, y AS year, v AS indicator_value
  FROM indicator_long""")
def _indicator(t):
    wide, years = t.indicator_wide
    return src.read_indicator(wide, "X.1", years)


@query("read_ascii_grid", """WITH g AS (SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(o_orderkey % 6 AS INT) AS r, CAST(o_custkey % 6 AS INT) AS c, count(*) AS n FROM orders GROUP BY ALL),
  e AS (SELECT y, r, c FROM (SELECT DISTINCT y FROM g), range(0, 6) a(r), range(0, 6) b(c))
  SELECT 'orders_' || y AS path, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, -180 + (c + 0.5)*60::DOUBLE AS x, -90 + (6 - r - 0.5)*60::DOUBLE AS y, CAST(n AS DOUBLE) AS value
  FROM e LEFT JOIN g USING (y, r, c)""")
def _ascii(t):
    """The lines of one grid per year; cells without orders have no data."""
    n = t.orders.groupBy(F.year("o_orderdate").alias("y"), (F.col("o_orderkey") % 6).cast("int").alias("row"), (F.col("o_custkey") % 6).cast("int").alias("c")) \
        .agg(F.count(F.lit(1)).alias("n"))
    path = F.concat(F.lit("orders_"), F.col("y")).alias("path")
    names = ["ncols 6", "nrows 6", "xllcorner -180", "yllcorner -90", "CELLSIZE 60", "NODATA_value -9999"]
    header = n.select(path).distinct().withColumn("value", F.explode(F.array(*[F.lit(x) for x in names])))
    by_col = F.map_from_entries(F.collect_list(F.struct("c", "n")))
    every = n.select("y").distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(5))))
    rows = every.join(n.groupBy("y", "row").agg(by_col.alias("m")), ["y", "row"], "left")
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(-9999)).cast("string")), " ")
    return src.ascii_cells(header, rows.select(path, "row", text.alias("value")))


# every day of 1997 at every cell that has a line in some year: the quantity shipped there, 0 on the other days
DENSE_SQL = """cells0 AS (SELECT DISTINCT CAST(l_partkey % 6 AS INT) AS r, CAST(l_suppkey % 6 AS INT) AS c FROM lineitem),
  shipped AS (SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_partkey % 6 AS INT) AS r, CAST(l_suppkey % 6 AS INT) AS c, sum(l_quantity) AS q
    FROM lineitem GROUP BY 1, 2, 3),
  dense AS (SELECT date, r, c, coalesce(q, 0) AS value FROM (SELECT r, c, CAST(unnest(range(DATE '1997-01-01', DATE '1998-01-01', INTERVAL 1 DAY)) AS DATE) AS date
    FROM cells0) LEFT JOIN shipped USING (date, r, c))"""


def dense_days(t, year: int):
    place = [(F.col("l_partkey") % 6).cast("int").alias("row"), (F.col("l_suppkey") % 6).cast("int").alias("col")]
    shipped = t.lineitem.groupBy(F.col("l_shipdate").cast("date").alias("date"), *place).agg(F.sum("l_quantity").alias("q"))
    days = F.explode(F.sequence(F.make_date(F.lit(year), F.lit(1), F.lit(1)), F.make_date(F.lit(year), F.lit(12), F.lit(31)))).alias("date")
    every = t.lineitem.select(*place).distinct().select("row", "col", days)
    return every.join(shipped, ["date", "row", "col"], "left").select("date", "row", "col", F.coalesce("q", F.lit(0.0)).alias("value"))


@query("read_daily_grid", f"WITH {DENSE_SQL} SELECT date, r AS \"row\", c AS col, round(value, 6) AS value FROM dense")
def _daily(t):
    return src.read_daily_grid(dense_days(t, 1997).union(dense_days(t, 1998)), 1997).withColumn("value", F.round("value", 6))


@query("file_index", f"""WITH {NAMES_SQL} SELECT DISTINCT path, replace(path, 'data/MCD64A1/', '') AS fname, 'MCD64A1' AS product,
  CAST(make_date(year,1,1) + CAST(yday - 1 AS INT) AS DATE) AS fname_date, v AS tile_v, h AS tile_h FROM names""")
def _file_index(t):
    return src.file_index(t.names.select("path"))


@query("only_valid_file_names", f"WITH {NAMES_SQL} SELECT id, path FROM names WHERE id % 3 <> 0")
def _valid_names(t):
    broken = t.names.select("id", F.when(F.col("id") % 3 == 0, F.regexp_replace("path", r"\.A", ".B")).otherwise(F.col("path")).alias("path"))
    return src.only_valid_file_names(broken)


@query("layer_catalog", f"WITH {CELLS_SQL} SELECT DISTINCT product, var, date FROM cells")
def _catalog(t):
    return src.layer_catalog(t.cells)


WHERE_SQL = """SELECT v, h, date, i AS "row", j AS col, value AS val, off AS "offset",
  round(80.0 - 0.5*(i + down_), 6)::DOUBLE AS lat, round(-180.0 + 0.5*(j + right_), 6)::DOUBLE AS lon"""


@query("where_cells", f"""WITH {CELLS_SQL}, l AS (SELECT c.*, q.value AS qc FROM cells c LEFT JOIN cells q ON q.var = 'qc' AND q.v=c.v AND q.h=c.h
    AND q.i=c.i AND q.j=c.j AND q.date=c.date WHERE c.var = 'lct')
  {WHERE_SQL} FROM l, (VALUES ('ul',0,0),('center',0.5,0.5)) AS o(off, down_, right_) WHERE value > 8 AND qc = 0""")
def _where(t):
    from pixelmill.plans.check_grid import HALF_DEGREE

    qc = src.read_layer(t.cells, "LAND", "qc")
    land = L.with_layers(src.read_layer(t.cells, "LAND", "lct"), {"qc": qc}, (*L.CELL, "date"))
    out = L.where_cells(land, lambda v, q: (v > 8) & (q == 0), meta=HALF_DEGREE, offsets=["ul", "center"], extra=["qc"])
    return out.withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


_CENTRE_SQL = """SELECT v, h, date, i AS "row", j AS col, value AS val, 'center' AS "offset", round(degrees(la), 6) AS lat,
  round(degrees(x/(6371007.181*cos(la))), 6) AS lon FROM (
  SELECT *, (10007554.677 - (i + 0.5)*(1111950.5196666666/1200) - v*1111950.5196666666)/6371007.181 AS la,
         (j + 0.5)*(1111950.5196666666/1200) + h*1111950.5196666666 - 20015109.354 AS x FROM hits)"""


def _rounded(df):
    return df.withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@query("fires", f"WITH {FIRE_SQL}, hits AS (SELECT v + 8 AS v, h + 17 AS h, i, j, date, value FROM fire1 WHERE value >= 7) {_CENTRE_SQL}")
def _fires(t):
    return _rounded(L.fires(fire_layer(t).withColumns({"v": F.col("v") + 8, "h": F.col("h") + 17})))


@query("human_activity", f"""WITH {CELLS_SQL}, hits AS (SELECT v + 8 AS v, h + 17 AS h, i, j, date, value FROM cells
  WHERE var = 'lct' AND value IN (12,13,14)) {_CENTRE_SQL}""")
def _human(t):
    land = src.read_layer(t.cells, "LAND", "lct").withColumns({"v": F.col("v") + 8, "h": F.col("h") + 17})
    return _rounded(L.human_activity(land))


@query("cap_per_group", f"""WITH {CELLS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY v, h, date ORDER BY
    ('0x' || substr(md5(concat_ws('|', i, j, '5')), 1, 15))::BIGINT, i, j) AS rn FROM cells WHERE var = 'lct')
  SELECT v, h, date, i, j, value FROM r WHERE rn <= 20""")
def _cap(t):
    return L.cap_per_group(src.read_layer(t.cells, "LAND", "lct"), ["v", "h", "date"], ["i", "j"], 20, 5) \
        .select("v", "h", "date", "i", "j", "value")


@query("cap_per_group_large", f"""WITH {POINTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY fire ORDER BY
    ('0x' || substr(md5(concat_ws('|', id, '6')), 1, 15))::BIGINT, id) AS rn FROM points) SELECT id, fire FROM r WHERE rn <= 2000""")
def _cap_large(t):
    return L.cap_per_group(t.points.select("id", "fire"), ["fire"], ["id"], 2000, 6)


@query("burn_quality", f"WITH {BURN_SQL} SELECT * FROM burn WHERE burn_date >= 0 AND uncertainty <= 1")
def _quality(t):
    return L.burn_quality(t.burn)


@query("inside_margin", f"WITH {LCT_SQL} SELECT * FROM lct WHERE i BETWEEN 3 AND 20 AND j BETWEEN 3 AND 20")
def _margin(t):
    return L.inside_margin(t.lct, 3, TILE)


@query("drop_incomplete", f"""WITH {INDICATOR_SQL} SELECT country, max(CASE WHEN y = lo THEN v END) AS first_year, max(CASE WHEN y = hi THEN v END) AS last_year
  FROM indicator_long, (SELECT min(y) AS lo, max(y) AS hi FROM indicator_long) GROUP BY country HAVING count(v) = count(*)""")
def _drop(t):
    wide, years = t.indicator_wide
    whole = tb.drop_incomplete(wide, [str(y) for y in years])
    return whole.select(F.col("Country Name").alias("country"), F.col(f"`{years[0]}`").alias("first_year"), F.col(f"`{years[-1]}`").alias("last_year"))


@query("open_range", "SELECT c_custkey AS id, c_acctbal AS x FROM customer WHERE c_acctbal > 100 AND c_acctbal < 5000")
def _open(t):
    return tb.open_range(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x")), "x", 100, 5000)


@query("wild_masks", f"""WITH {LCT_SQL} SELECT v, h, i, j, bool_and(lct NOT IN (12,13,14)) AS wilderness,
  bool_and(lct BETWEEN 1 AND 11) AS wild_vegetation FROM lct GROUP BY ALL""")
def _wild(t):
    return t.lct.groupBy(*L.CELL).agg(F.bool_and(L.is_wilderness(F.col("lct"))).alias("wilderness"),
                                      F.bool_and(L.is_wild_vegetation(F.col("lct"))).alias("wild_vegetation"))


@query("all_years", f"""WITH {LCT_SQL} SELECT v, h, i, j FROM lct GROUP BY ALL HAVING bool_and(lct < 14) AND count(DISTINCT year) >= 2""")
def _all_years(t):
    return L.all_years(t.lct, F.col("lct") < 14, 2)


for _f, _sql in {"max": "max(lct)", "mean": "round(avg(lct), 6)", "min": "min(lct)", "sum": "sum(lct)::BIGINT",
                 "median": "median(lct)"}.items():
    @query(f"pool_{_f}", f"""WITH {LCT_SQL} SELECT v, h, year, CAST(floor(i/5) AS INT) AS i, CAST(floor(j/5) AS INT) AS j, {_sql} AS lct
      FROM lct WHERE i < 20 AND j < 20 GROUP BY 1,2,3,4,5""")
    def _pool(t, f=_f):
        out = L.pool(t.lct, (5, 5), f, n=TILE, col="lct", keys=("v", "h", "year"))
        return out.withColumn("lct", F.round("lct", 6)) if f == "mean" else out


@query("pool_any", f"""WITH {LCT_SQL} SELECT v, h, year, CAST(floor(i/2) AS INT) AS i, CAST(floor(j/3) AS INT) AS j, bool_or(lct > 15) AS hit
  FROM lct GROUP BY 1,2,3,4,5""")
def _pool_any(t):
    return L.pool(t.lct.withColumn("hit", F.col("lct") > 15), (2, 3), "any", col="hit", keys=("v", "h", "year"))


def _mask_sql(value, pred, layers):
    return f"""WITH {LCT_SQL}, {FIRE_SQL}, m AS (
      SELECT f.v, f.h, f.i, f.j, f.date, f.value, f.year, bool_and({pred}) AS ok, count(DISTINCT l.year) AS n
      FROM fire1 f JOIN lct l ON l.v=f.v AND l.h=f.h AND floor(l.i/2)=f.i AND floor(l.j/2)=f.j AND l.year IN (f.year, f.year + 1)
      WHERE {value} GROUP BY ALL) SELECT v, h, i, j, date, value, year FROM m WHERE ok AND n >= {layers}"""


@query("wildfires", _mask_sql("value >= 7", "lct NOT IN (12,13,14)", 1))
def _wildfires(t):
    return L.wildfires(fire_layer(t), t.lct)


@query("nonfire_wilderness", _mask_sql("value < 7", "lct NOT IN (12,13,14)", 2))
def _nonfire_w(t):
    return L.nonfire_wilderness(fire_layer(t), t.lct, 2)


@query("nonfire_wild_vegetation", _mask_sql("value < 7", "lct BETWEEN 1 AND 11", 1))
def _nonfire_v(t):
    return L.nonfire_wild_vegetation(fire_layer(t), t.lct)


@query("pair_with_yearly_layers", f"""WITH {NAMES_SQL}, y AS (SELECT v, h, year, min(path) AS p FROM names GROUP BY ALL)
  SELECT n.id, n.v, n.h, n.year, a.p AS path_this_year, b.p AS path_next_year FROM names n
  LEFT JOIN y a ON a.v=n.v AND a.h=n.h AND a.year=n.year LEFT JOIN y b ON b.v=n.v AND b.h=n.h AND b.year=n.year+1
  WHERE a.p IS NOT NULL AND b.p IS NOT NULL""")
def _pair(t):
    yearly = t.names.select("v", "h", "year", "path")
    return L.pair_with_yearly_layers(t.names.select("id", "v", "h", "year"), yearly, 2)


@query("stable_land_cover", f"WITH {STABLE_SQL} SELECT * FROM stable")
def _stable(t):
    return stable(t)


@query("mask_ratios", f"""WITH {LCT_SQL}, m AS (SELECT a.lct=b.lct AND a.qc=b.qc AS no_change, a.lct NOT IN (13,15,16,255) AND a.qc=0 AS keep_lct,
    a.i BETWEEN 1 AND 22 AND a.j BETWEEN 1 AND 22 AS margin
    FROM lct a JOIN lct b ON a.v=b.v AND a.h=b.h AND a.i=b.i AND a.j=b.j AND b.year=a.year+1)
  SELECT round(avg(no_change::INT), 6) AS no_change, round(avg(keep_lct::INT), 6) AS keep_lct, round(avg(margin::INT), 6) AS margin,
  round(avg((no_change AND keep_lct AND margin)::INT), 6) AS overall FROM m""")
def _mask_ratios(t):
    names = ["no_change", "keep_lct", "margin", "overall"]
    return L.mask_ratios(L.land_cover_masks(t.lct, margin=1, n=TILE), names).select(*[r6(F.col(c), c) for c in names])


@query("attach_burn_layers", f"""WITH {LCT_SQL}, {BURN_SQL} SELECT l.*, month, burn_date::DOUBLE AS burn_date, uncertainty::DOUBLE AS uncertainty
  FROM lct l JOIN burn USING (v, h, i, j, year)""")
def _attach(t):
    long = t.burn.select(*L.CELL, "year", "month", F.col("burn_date").cast("double").alias("burn_date"),
                         F.col("uncertainty").cast("double").alias("uncertainty")) \
        .unpivot([*L.CELL, "year", "month"], ["burn_date", "uncertainty"], "var", "value")
    return L.attach_burn_layers(t.lct, L.layers_to_columns(long, ["burn_date", "uncertainty"], [*L.CELL, "year", "month"]))


@query("gather", f"""WITH {POINTS_SQL}, {CELLS_SQL} SELECT id, p.v, p.h, p.i, p.j, var, date, value FROM points p
  LEFT JOIN (SELECT * FROM cells WHERE date IN (DATE '1997-01-01', DATE '1998-01-01')) c ON c.v=p.v AND c.h=p.h AND c.i=p.i AND c.j=p.j""")
def _gather(t):
    layer = t.cells.filter("date IN (DATE'1997-01-01', DATE'1998-01-01')")
    return L.gather(t.points.select("id", *L.CELL), layer, L.CELL)


@query("positive_rate", f"""WITH {LABELLED_SQL} SELECT v, round(sum(fire::INT)/count(*), 6) AS r_pos FROM y GROUP BY v""")
def _positive_rate(t):
    stats = L.burn_stats(labelled(t), ["v", "h", "year"])
    return L.positive_rate(stats, ["v"]).withColumn("r_pos", F.round("r_pos", 6))


@query("weighted_rates", f"""WITH {LABELLED_SQL}, w AS (SELECT v, h, year, CAST((v + 2*h + year) % 5 + 1 AS DOUBLE) AS weight FROM y GROUP BY ALL)
  SELECT round(sum(fire::INT*weight)/sum(weight), 6) AS r_pos FROM y JOIN w USING (v, h, year)""")
def _weighted(t):
    stats = L.burn_stats(labelled(t), ["v", "h", "year"])
    weights = stats.select("v", "h", "year", ((F.col("v") + 2 * F.col("h") + F.col("year")) % 5 + 1).cast("double").alias("weight"))
    return L.weighted_rates(stats, weights).withColumn("r_pos", F.round("r_pos", 6))


def burn_full(t):
    """Burn lens with first and last day and quality bits, some periods crossing the turn of the year."""
    first = F.dayofyear(F.make_date("year", "month", F.lit(1)))
    last = F.dayofyear(F.last_day(F.make_date("year", "month", F.lit(1))))
    turn = F.col("j") % 5 == 0
    return t.burn.select("*", F.when((F.col("month") == 1) & turn, 360).otherwise(first - 3 + F.col("i") % 7).alias("first_day"),
                         F.when((F.col("month") == 12) & turn, 2).otherwise(last + 2 - F.col("j") % 9).alias("last_day"),
                         (F.col("i") * 7 + F.col("j") * 13).alias("qa"))


BURN_FULL_SQL = """burn_full AS (SELECT *, CASE WHEN month = 1 AND j % 5 = 0 THEN 360 ELSE dayofyear(make_date(year, month, 1)) - 3 + i % 7 END AS first_day,
  CASE WHEN month = 12 AND j % 5 = 0 THEN 2 ELSE dayofyear(last_day(make_date(year, month, 1))) + 2 - j % 9 END AS last_day,
  i*7 + j*13 AS qa FROM burn)"""
BOUNDS_SQL = """bounds AS (SELECT *, greatest(dayofyear(make_date(year, month, 1)), CASE WHEN first_day > last_day AND month <= 6
    THEN first_day - dayofyear(make_date(year - 1, 12, 31)) ELSE first_day END) AS lo,
  least(dayofyear(last_day(make_date(year, month, 1))), CASE WHEN first_day > last_day AND month > 6
    THEN last_day + dayofyear(make_date(year, 12, 31)) ELSE last_day END) AS hi FROM burn_full)"""


def _index_sql(tail):
    return f"""WITH {STABLE_SQL}, {BURN_SQL}, {BURN_FULL_SQL}, {BOUNDS_SQL}, y AS (
      SELECT s.v, s.h, s.i, s.j, s.year, s.lct, month, burn_date, lo, hi, burn_date > 0 AS fire,
        qa & 3 = 3 AND qa & 4 = 0 AND NOT (qa >> 5 BETWEEN 1 AND 5) AS qa_good,
        ('0x' || substr(md5(concat_ws('|', s.v, s.h, s.year, month, s.i, s.j, '11')), 1, 15))::BIGINT/1152921504606846976.0::DOUBLE AS u,
        ('0x' || substr(md5(concat_ws('|', s.v, s.h, s.year, month, s.i, s.j, '12')), 1, 15))::BIGINT AS dh
      FROM stable s JOIN bounds b ON s.v=b.v AND s.h=b.h AND s.i=b.i AND s.j=b.j AND s.year=b.year
      WHERE burn_date >= 0 AND uncertainty <= 1), k AS (
      SELECT *, CAST(CASE WHEN fire THEN burn_date ELSE lo + dh % (hi - lo + 1) END AS INT) AS yday
      FROM y WHERE (fire OR u >= 0.3) AND qa_good AND lo <= hi) {tail}"""


@query("y_index", _index_sql("SELECT v, h, i AS i2, j AS j2, year, yday, lct, fire FROM k"))
def _y_index(t):
    return sample_index.build(t.lct, burn_full(t), drop_ratio=0.3, seed=11, margin=1, n=TILE).samples


@query("burn_stats", _index_sql("""SELECT v, h, year, month, n_pos, N, round(n_pos/N, 6) AS r_pos, coalesce(n_pos_us, 0) AS n_pos_us,
  coalesce(N_us, 0) AS N_us, round(n_pos_us/N_us, 6) AS r_pos_us FROM (
    SELECT v, h, year, month, sum(fire::INT)::BIGINT AS n_pos, count(*) AS N FROM y GROUP BY ALL) LEFT JOIN (
    SELECT v, h, year, month, sum(fire::INT)::BIGINT AS n_pos_us, count(*) AS N_us FROM k GROUP BY ALL) USING (v, h, year, month)"""))
def _burn_stats(t):
    stats = sample_index.build(t.lct, burn_full(t), drop_ratio=0.3, seed=11, margin=1, n=TILE).stats
    return stats.withColumns({"r_pos": F.round("r_pos", 6), "r_pos_us": F.round("r_pos_us", 6)})
