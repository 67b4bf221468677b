"""Hand-computed values."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from pixelmill.functions import grid as g
from pixelmill.functions import scalars as s
from pixelmill.operators import asof, calibration, context, layers, neighborhood, reliability, scores, series, tables, weather
from pixelmill.sources import layers as src
from pixelmill.sources import links

D = datetime.date


def value(spark, c):
    return spark.range(1).select(c.alias("x")).head()["x"]


def test_upscale(spark):
    assert [tuple(r) for r in value(spark, g.upscale(F.lit(3), F.lit(5)))] == [(6, 10), (6, 11), (7, 10), (7, 11)]


def test_lon360(spark):
    assert value(spark, g.lon360(F.lit(-10.0))) == 350 and value(spark, g.lon360(F.lit(10.0))) == 10


@pytest.mark.parametrize("year,yday,want", [(2020, 60, D(2020, 2, 29)), (2021, 60, D(2021, 3, 1)), (2020, 0, None)])
def test_yday(spark, year, yday, want):
    assert value(spark, s.yday_to_date(F.lit(year), F.lit(yday))) == want


def test_parse_layer_name(spark):
    p = s.parse_layer_name(F.lit("x/MOD14A1.A2019257.h11v12.006.2019269172641.hdf"))
    assert [value(spark, p[k]) for k in ("product", "date", "h", "v")] == ["MOD14A1", D(2019, 9, 14), 11, 12]
    assert value(spark, s.tile_name(F.lit(11), F.lit(8))) == "h11v08"


@pytest.mark.parametrize("qa,ok,legacy", [(3, True, True), (2, False, True), (1, False, True), (7, False, True), (35, False, False), (195, True, True)])
def test_qa(spark, qa, ok, legacy):
    assert value(spark, s.qa_ok(F.lit(qa))) is ok and value(spark, s.qa_ok(F.lit(qa), True)) is legacy


def test_crc(spark):
    assert value(spark, s.crc_id(F.lit("abc"))) == "352441C2"
    import binascii

    both = [s.crc_of_fields(F.create_map(*[F.lit(x) for x in kv])) for kv in (("b", "2", "a", "1"), ("a", "1", "b", "2"))]
    want = hex(binascii.crc32(b"a: 1,\nb: 2,\n"))[2:].upper()
    assert [value(spark, c) for c in both] == [want, want]


def test_level_and_noisy_or(spark):
    assert value(spark, s.level_fire_proba(F.lit(1.0), F.lit(5.0))) == 0.75
    p = s.noisy_or_score(F.lit(1.0), F.lit(1.0), F.lit(0.2), F.lit(1.0), F.lit(1.0), F.lit(0.5), F.lit(0.0), link=s.clamp)
    assert [round(value(spark, p[k]), 9) for k in ("p_f", "p_i", "p")] == [0.5, 0.6, 0.3]


def test_logit(spark):
    assert value(spark, s.logit(F.lit(1.0))) is None
    assert value(spark, s.logit(F.lit(1.0), closed=True)) == math.inf
    with pytest.raises(Exception, match="out of range"):
        value(spark, s.logit(F.lit(2.0), on_error="raise"))


def test_keep_rate(spark):
    assert round(value(spark, s.keep_neg_rate(0.25, 0.01)), 6) == 0.030303
    assert round(value(spark, s.adjust_mean(F.lit(0.5), s.keep_neg_rate(0.25, 0.01))), 6) == 0.029412
    assert value(spark, s.adjust_mean(F.lit(0.3), 1.0)) == pytest.approx(0.3)


def test_pool(spark):
    cells = spark.createDataFrame([(0, 0, 0, 0, 1.0), (0, 0, 0, 1, 2.0), (0, 0, 1, 0, 3.0), (0, 0, 1, 1, 6.0), (0, 0, 2, 2, 9.0)], "v int, h int, i int, j int, value double")
    got = {f: layers.pool(cells, (2, 2), f, n=3).collect() for f in ("min", "max", "sum", "mean", "median")}
    assert {f: [r["value"] for r in rows] for f, rows in got.items()} == {"min": [1], "max": [6], "sum": [12], "mean": [3], "median": [2.5]}


def test_deficit(spark):
    months = [(0, 0, y, m, 2.0 if (y, m) < (2005, 7) else 1.0) for y in range(2000, 2007) for m in range(1, 13)]
    precip = spark.createDataFrame(months, "row int, col int, year int, month int, value double")
    target = spark.createDataFrame([(0, 0, 2006, 7)], "row int, col int, year int, month int")
    assert weather.precip_deficit(precip, target, 3, 1).head()["rpd"] == pytest.approx(0.5)


def test_agg_tail(spark):
    df = spark.range(1).select(F.array(*[F.lit(x).cast("double") for x in (5, 4, 3, None, 1)]).alias("l"))
    assert list(df.select(*weather.agg_tail(F.col("l"), 2, "x")).head()) == [5, 4, 1, 2, 3]


def test_class_weights(spark):
    df = spark.range(100).select((F.col("id") < 10).cast("int").alias("y"))
    assert {r["y"]: round(r["weight"], 9) for r in tables.inverse_prior_weights(df, "y").collect()} == {1: 1.8, 0: 0.2}
    df = spark.range(100).select((F.col("id") < 25).cast("int").alias("y"))
    assert round(tables.biased_sample_weight(df, "y", 0.01).filter("y = 1").head()["weight"], 6) == 0.030303


PREDS = list(zip([0, 0, 0, 1, 1, 0, 1, 1], [0.05, 0.10, 0.15, 0.20, 0.55, 0.60, 0.95, 1.0]))


def test_reliability_and_scores(spark):
    df = spark.createDataFrame(PREDS, "y_true int, y_proba double")
    bins = reliability.reliability(df, n_bins=2)
    rows = bins.orderBy("bin").collect()
    assert [(round(r["y_proba_mean"], 6), r["y_true_mean"], r["n_samples"]) for r in rows] == [(0.125, 0.25, 4), (0.775, 0.75, 4)]
    e = reliability.calibration_errors(bins).head()
    assert [round(e[k], 6) for k in ("eace", "mace", "erce")] == [0.075, 0.125, 0.266667]
    assert scores.auroc(df).head()[0] == pytest.approx(0.875)
    assert scores.average_precision(df).head()[0] == pytest.approx(0.8875)
    assert scores.log_loss(df).head()["bssl"] == pytest.approx(0.155)


def test_empty_bins_stay(spark):
    df = spark.createDataFrame(PREDS, "y_true int, y_proba double")
    bins = reliability.reliability(df, n_bins=10)
    assert bins.count() == 10 and bins.filter("n_samples = 0").count() > 0
    assert bins.agg(F.sum("support")).head()[0] == pytest.approx(1)
    assert reliability.calibration_errors(bins, empty_bins="null").head()["eace"] is None


def test_population(spark):
    grid = spark.createDataFrame([(0, 0, 2000, 10.0), (0, 0, 2005, 20.0)], "row int, col int, year int, value double")
    ask = spark.createDataFrame([(0, 0, 2003), (0, 0, 2005), (0, 0, 2007)], "row int, col int, year int")
    got = {r["year"]: r["x_gpw4"] for r in context.add_population_density(ask, grid, published=(2000, 2005)).collect()}
    assert got == {2003: pytest.approx(16), 2005: 20, 2007: None}


def test_asof(spark):
    lay = spark.createDataFrame([(0, 0, D(2020, 1, 1)), (0, 0, D(2020, 1, 17)), (0, 0, D(2020, 2, 2))], "v int, h int, date date")
    ask = spark.createDataFrame([(0, 0, D(2020, 1, 17)), (0, 0, D(2020, 2, 25))], "v int, h int, d date")
    before = {r["d"]: r["layer_date"] for r in asof.asof_layer(ask, lay, 21).collect()}
    assert before == {D(2020, 1, 17): D(2020, 1, 1), D(2020, 2, 25): None}
    same = {r["d"]: r["layer_date"] for r in asof.asof_layer(ask, lay, 21, True).collect()}
    assert same[D(2020, 1, 17)] == D(2020, 1, 17)


@pytest.mark.parametrize("distance", [1, 4])
def test_neighbouring_fires(spark, distance):
    day = D(2020, 5, 10)

    def burn(i, j, back):
        d = day - datetime.timedelta(days=back)
        return (0, 0, i, j, d.year, d.month, d.timetuple().tm_yday, 0)

    b = spark.createDataFrame([burn(1, 1, 1), burn(0, 0, 2), burn(1, 2, 0), burn(2, 2, 3)], "v int, h int, i int, j int, year int, month int, burn_date int, uncertainty int")
    ask = spark.createDataFrame([(0, 0, 1, 1, day)], "v int, h int, i int, j int, d date")
    assert neighborhood.add_neighboring_fires(ask, b, distance, 2).head()["x_nf"] == 1


def test_neighbour_across_new_year(spark):
    b = spark.createDataFrame([(0, 0, 0, 0, 2019, 12, 365, 0)], "v int, h int, i int, j int, year int, month int, burn_date int, uncertainty int")
    ask = spark.createDataFrame([(0, 0, 0, 1, D(2020, 1, 3))], "v int, h int, i int, j int, d date")
    assert neighborhood.add_neighboring_fires(ask, b, 1, 5).head()["x_nf"] == 1


def test_neighbour_outside(spark):
    cells = spark.createDataFrame([(0, 0, 0, 0, 1.0)], "v int, h int, i int, j int, value double")
    ask = spark.createDataFrame([(0, 0, 0, 0)], "v int, h int, i int, j int")
    with pytest.raises(Exception, match="outside"):
        neighborhood.neighbors(cells, ask, 1, 3).collect()
    assert neighborhood.neighbors(cells, ask, 1, 3, outside=-1).filter("value = -1").count() == 5


def test_rolling(spark):
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate([1, 2, 4, 8])], "t int, y double")
    got = [r["rolling_mean"] for r in series.rolling(df, "y", F.col("t"), [], 3).orderBy("t").collect()]
    assert got[:2] == [None, None] and got[2:] == [pytest.approx(7 / 3), pytest.approx(14 / 3)]


def test_fill_gaps(spark):
    vals = [1.0, None, None, 4.0, None, None, None, 8.0]
    df = spark.createDataFrame([(k, 0, v) for k, v in enumerate(vals)], "col int, row int, value double")
    assert [r["value"] for r in context.fill_gaps(df, "col", 2, ["row"]).orderBy("col").collect()] == [1, 2, 3, 4, None, None, None, 8]


def test_apply_curve(spark):
    df = spark.createDataFrame([(0.1, 0.4), (0.1, 1.0), (0.0, 0.3)], "qf double, qi double")
    got = calibration.apply_factor_calibration(df, [(0.0, 0.0), (0.2, 0.5), (1.0, 1.0)]).collect()
    assert [round(got[0][k], 9) for k in ("p_f", "p_i", "py")] == [0.25, 0.16, 0.04] and got[0]["clamped"] is False
    assert got[2]["p_i"] == 0.3


def test_carry_and_implode(spark):
    df = spark.createDataFrame([("a", D(2020, 1, 1)), ("b", D(2020, 2, 1))], "foo string, date date")
    assert tables.carry_dates(df, "date", 3).count() == 6
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, x int")
    assert {r["k"]: r["x"] for r in tables.implode(df, ["k"]).collect()} == {"a": [1, 3], "b": [2]}
    got = {r["k"]: (r["x"], r["x_single"]) for r in tables.implode(df, ["k"], keep_singletons=False).collect()}
    assert got == {"a": ([1, 3], None), "b": (None, 2)}


def test_point_in_polygon(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    b = spark.createDataFrame([("A", "AAA", 1, str([list(p) for p in ring]))], "name string, iso3 string, continent int, ring string")
    pts = {0: (1.0, 1.0), 1: (2.0, 2.0), 2: (3.5, 3.0), 3: (2.0, 1.0), 4: (5.0, 1.0), 5: (0.0, 2.0)}
    df = spark.createDataFrame([(k, *v) for k, v in pts.items()], "id int, lon double, lat double")
    got = {r["id"]: r["country"] for r in context.add_country_and_continent(df, src.read_boundaries(b), rings="rings").collect()}
    assert got == {0: "A", 1: None, 2: "A", 3: "A", 4: None, 5: "A"}


def test_missing_code(spark):
    assert value(spark, s.fill_country_code(F.lit("-99"), F.lit("Kosovo"))) == "XKX"
    assert value(spark, s.fill_country_code(F.lit("-99"), F.lit("Atlantis"))) == "Atlantis"


def test_ascii_grid(spark, tmp_path):
    (tmp_path / "a.asc").write_text("ncols 3\nnrows 2\nxllcorner -180\nyllcorner 80\ncellsize 5\nNODATA_value -9\n1 2 -9\n4 5 6\n")
    rows = {(r["row"], r["col"]): (r["x"], r["y"], r["value"]) for r in src.read_ascii_grid(spark, str(tmp_path / "a.asc")).collect()}
    assert rows[(0, 0)] == (-177.5, 87.5, 1.0) and rows[(0, 2)][2] is None and rows[(1, 1)] == (-172.5, 82.5, 5.0) and len(rows) == 6


def test_ascii_grid_over_several_blocks(spark, tmp_path):
    n = 400
    body = "\n".join(" ".join(str(r * 10 + c) for c in range(10)) for r in range(n))
    (tmp_path / "b.asc").write_text(f"ncols 10\nnrows {n}\nxllcorner 0\nyllcorner 0\ncellsize 1\n{body}\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        got = src.read_ascii_grid(spark, str(tmp_path / "b.asc"))
        assert got.count() == 10 * n and got.filter("value <> row * 10 + col").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_samples_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, 5, 6, 2001, 30, 4, True), (1, 1, 5, 6, 2001, 31, 4, False), (1, 1, 5, 6, 2002, 31, 4, False)], "v int, h int, i2 int, j2 int, year int, yday int, lct int, fire boolean")
    root = str(tmp_path / "s")
    src.save_samples(df, root)
    assert src.load_samples(spark, root, 2001).count() == 2 and src.load_samples(spark, root, 2001, v=1).count() == 1
    src.save_samples(df.filter("year = 2002").withColumn("fire", ~F.col("fire")), root)
    assert src.load_samples(spark, root, 2001).count() == 2 and src.load_samples(spark, root, 2002).head()["fire"] is True


def test_incomplete_year_fails(spark):
    grid = spark.createDataFrame([(D(2001, 1, 1), 0, 0, 1.0)], "date date, row int, col int, value double")
    with pytest.raises(Exception, match="incomplete year"):
        src.read_daily_grid(grid, 2001).collect()
    full = spark.range(366).select(F.date_add(F.lit("2004-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(1.0).alias("value"))
    assert src.read_daily_grid(full, 2004).count() == 366


def test_two_years_fail(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, y, 1, 1, True) for y in (2001, 2002)], "v int, h int, i2 int, j2 int, year int, yday int, lct int, fire boolean")
    with pytest.raises(Exception, match="more than one year"):
        s.enforce_sample_schema(df).collect()


def test_double_target_fails(spark):
    req = spark.createDataFrame([("a",), ("a",)], "target string")
    with pytest.raises(Exception, match="two requests"):
        links.pending_files(req, req.limit(0)).collect()


@pytest.mark.parametrize("base,href", [
    ("http://a.org/b/c.html?x=1", "d.html"), ("http://a.org/b/c.html", "/d"), ("http://a.org/b/c.html", "../d"), ("http://a.org/b/c/e", "../../d"),
    ("http://a.org", "d"), ("http://a.org/b", "//x.org/y"), ("http://a.org/b/c", "#top"), ("http://a.org/b/c?q=1", "?p=2"), ("http://a.org/b/", "https://z.org/")])
def test_resolve_link(spark, base, href):
    from urllib.parse import urljoin

    assert value(spark, links.resolve(F.lit(base), F.lit(href))) == urljoin(base, href)


def test_feature_clash(spark):
    a = spark.createDataFrame([(1, 2)], "id int, x int")
    with pytest.raises(ValueError, match="exist already"):
        context.append_features(a, [a], ["id"])


def test_illegal_weight_keys(spark):
    a = spark.createDataFrame([(1, 2, 3, 1, 2, 0.5)], "v int, h int, year int, n_pos int, N int, r_pos double")
    with pytest.raises(ValueError):
        layers.weighted_rates(a, spark.createDataFrame([(1, 1.0)], "month int, weight double"))


def test_outline(spark):
    ring = [tuple(r)[1:] for r in value(spark, g.outline())]
    assert len(ring) == 4797 and ring[0] == ring[-1] == (0, 0) and len(set(ring)) == 4796
    assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(ring, ring[1:]))


def test_land_tiles(spark):
    tiles = spark.range(18 * 36).select((F.col("id") / 36).cast("int").alias("v"), (F.col("id") % 36).cast("int").alias("h"))
    assert layers.known_tiles(tiles).count() == 321


def test_pack_years_refuses_a_doubled_day(spark):
    grid = spark.createDataFrame([(0, 0, datetime.date(2001, 1, d), float(d)) for d in (1, 2, 2, 3)], "row int, col int, date date, value double")
    with pytest.raises(Exception, match="a day twice"):
        weather.pack_years(grid).collect()
    assert weather.pack_years(grid.dropDuplicates(["date"])).head()["series"] == [1.0, 2.0, 3.0]
