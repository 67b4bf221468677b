"""Tile edges, polygons of several rings, links of odd pages, guards, and curves, against plain computations."""

import datetime
import random
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.functions.grid import GridMeta
from pixelmill.operators import asof, calibration, context, models, neighborhood, scores, weather
from pixelmill.plans import features
from pixelmill.sources import layers as src
from pixelmill.sources import links

D = datetime.date
N = 5  # cells along the side of a tile


# ---- tile edges

def test_fire_across_the_edge_counts(spark):
    samples = spark.createDataFrame([(0, 0, 2, N - 1, D(2001, 3, 10)), (1, 1, 0, 0, D(2001, 3, 10)), (0, 0, 2, 2, D(2001, 3, 10))], "v int, h int, i int, j int, d date")
    burn = spark.createDataFrame([(0, 1, 2, 0, 2001, 60, 0), (0, 0, N - 1, N - 1, 2001, 60, 0)], "v int, h int, i int, j int, year int, burn_date int, uncertainty int")
    got = {(r.v, r.h, r.i, r.j): r.x_nf for r in neighborhood.add_neighboring_fires(samples, burn, 1, 20, n=N).collect()}
    assert got == {(0, 0, 2, N - 1): 1, (1, 1, 0, 0): 1, (0, 0, 2, 2): 0}


@pytest.mark.parametrize("dist", [1, 2, 4])
def test_neighbours_against_one_large_grid(spark, dist):
    """3 x 3 tiles as one array: fires, land cover and values around every sample."""
    rng = random.Random(dist)
    side = 3 * N
    burn = [(gi, gj, rng.randint(1, 90)) for gi in range(side) for gj in range(side) if rng.random() < 0.3]
    cover = {(gi, gj): rng.randint(1, 4) for gi in range(side) for gj in range(side)}
    points = [(rng.randrange(side), rng.randrange(side), rng.randint(1, 110)) for _ in range(60)]
    tile = lambda gi, gj: (gi // N, gj // N, gi % N, gj % N)
    day = lambda k: D(2001, 1, 1) + datetime.timedelta(k - 1)
    samples = spark.createDataFrame([(k, *tile(a, b), day(y)) for k, (a, b, y) in enumerate(points)], "id int, v int, h int, i int, j int, d date")
    burned = spark.createDataFrame([(*tile(a, b), 2001, y, 0) for a, b, y in burn], "v int, h int, i int, j int, year int, burn_date int, uncertainty int")
    got = {r.id: r.x_nf for r in neighborhood.add_neighboring_fires(samples, burned, dist, 15, n=N).collect()}
    near = lambda a, b, x, y: abs(a - x) <= dist and abs(b - y) <= dist and (a, b) != (x, y)
    assert got == {k: len({(x, y) for x, y, f in burn if near(a, b, x, y) and 1 <= d - f <= 15}) for k, (a, b, d) in enumerate(points)}

    layer = spark.createDataFrame([(*tile(*c), D(2000, 1, 1), float(x)) for c, x in cover.items()], "v int, h int, i int, j int, date date, value double")
    got = {r.id: r.x_near for r in neighborhood.add_land_cover_nearby(samples, layer, [1, 3], dist, "near", n=N).collect()}
    assert got == {k: sum(x in (1, 3) for c, x in cover.items() if near(a, b, *c)) for k, (a, b, _) in enumerate(points)}

    rows = neighborhood.neighbors(layer.drop("date"), samples.drop("d"), dist, N, across=True).collect()
    assert len(rows) == 60 * ((2 * dist + 1) ** 2 - 1)
    for r in rows:
        a, b, _ = points[r.id]
        assert r.value == cover.get((a + r.di, b + r.dj))


def test_neighbours_refuse_the_edge_on_request(spark):
    cells = spark.createDataFrame([(0, 0, 0, 0, 1.0)], "v int, h int, i int, j int, value double")
    with pytest.raises(Exception, match="outside of the tile"):
        neighborhood.neighbors(cells, cells.drop("value"), 1, N).collect()


def test_layers_are_cut_before_they_are_spread(spark):
    """The semi-joins with what samples look at stand below the pooling, the packing and the listing under blocks."""
    samples = spark.createDataFrame([(0, 0, 1, 1, D(2001, 3, 10))], "v int, h int, i int, j int, d date")
    cells = spark.createDataFrame([(0, 0, 1, 1, D(2001, 3, 1), 1.0)], "v int, h int, i int, j int, date date, value double")
    dates = cells.select("v", "h", "date")
    grid = spark.createDataFrame([(0, 0, D(2001, 3, 1), 1.0)], "row int, col int, date date, value double")
    days = samples.select(F.lit(0).alias("row"), F.lit(0).alias("col"), "d")
    for df in (neighborhood.add_vegetation_index(samples, cells, dates=dates), neighborhood.add_land_cover_nearby(samples, cells, [1], 1, "x", n=N, dates=dates),
               asof.asof_values(samples, cells, 30, dates=dates), weather.daily_window_lookup(days, grid, 3)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftSemi" in plan


# ---- polygons

def around(lon, lat, rings):
    """Odd number of edges east of a point, or a point on an edge."""
    odd = False
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, [*r[1:], r[0]]):
            cross = (x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1)
            if cross == 0 and min(x1, x2) <= lon <= max(x1, x2) and min(y1, y2) <= lat <= max(y1, y2):
                return True
            if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def star(rng, x, y, r, n):
    angles = sorted(rng.uniform(0, 2 * np.pi) for _ in range(n))
    return [(float(x + r * rng.uniform(0.4, 1) * np.cos(a)), float(y + r * rng.uniform(0.4, 1) * np.sin(a))) for a in angles]


def test_polygons_against_plain_crossings(spark):
    rng = random.Random(6)
    shapes = {f"s{k}": [star(rng, rng.uniform(-170, 150), rng.uniform(-70, 70), rng.uniform(1, 20), rng.randint(3, 30)) for _ in range(rng.randint(1, 3))] for k in range(12)}
    shapes["box"] = [[(0.0, 0.0), (40.0, 0.0), (40.0, 30.0), (0.0, 30.0)], [(10.0, 10.0), (20.0, 10.0), (20.0, 20.0), (10.0, 20.0), (10.0, 10.0)], [(100.0, -5.0), (130.0, -5.0), (115.0, 15.0)]]
    shapes["in the hole"] = [[(10.0, 10.0), (20.0, 10.0), (20.0, 20.0), (10.0, 20.0)]]
    table = spark.createDataFrame([(n, n, 1, str([[list(p) for p in r] for r in rings])) for n, rings in shapes.items()], "name string, iso3 string, continent int, ring string")
    points = [(rng.uniform(-180, 180), rng.uniform(-80, 80)) for _ in range(600)] + [(float(x), float(y)) for x in range(-5, 45, 5) for y in range(-5, 35, 5)]
    points += [p for rings in shapes.values() for r in rings for p in r[:2]] + [(115.0, 0.0), (0.0, 15.0), (10.0, 15.0)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "id int, lon double, lat double")
    got = {(r.id, r.country) for r in context.add_country_and_continent(df, src.read_boundaries(table), rings="rings").collect()}
    want = set()
    for k, p in enumerate(points):
        names = [n for n, rings in shapes.items() if around(*p, rings)] or [None]
        want |= {(k, n) for n in names}
    assert got == want and sum(n is not None for _, n in want) > 100


def test_boundaries_of_every_depth(spark):
    one = "[[0, 0], [2, 0], [0, 3]]"
    texts = [one, f"[{one}, [[5, 5], [6, 5], [5, 7]]]", f" [ [{one}], [[[5, 5], [6, 5], [5, 7]], {one}]]"]
    rows = src.read_boundaries(spark.createDataFrame([(t,) for t in texts], "ring string")).collect()
    assert [len(r.rings) for r in rows] == [1, 2, 3] and [(r.xmin, r.xmax, r.ymin, r.ymax) for r in rows] == [(0, 2, 0, 3), (0, 6, 0, 7), (0, 6, 0, 7)]
    given = spark.createDataFrame([([(0.0, 1.0), (2.0, 1.0)],)], "ring array<struct<lon:double,lat:double>>")
    assert src.read_boundaries(given).head().rings == [[(0.0, 1.0), (2.0, 1.0)]]


# ---- links

class Anchors(HTMLParser):
    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.found = []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "a" and "href" in dict(attrs):
            self.found.append(next(v for k, v in attrs if k == "href") or "")


PAGES = [
    '<a href="x.html">x</a> <A CLASS=k HREF=y.html>y</a><a\nhref = \'z.html\' >z</a>', '<!-- <a href="no"> --><a href=yes>', '<!-- open <a href="no">',
    "<script>var s = '<a href=\"no\">';</script><a href=\"yes\">a</a><style>a{} <a href=no></style>", '<a title="href=\'no\'" href="?a=1&amp;b=2&#38;c&#x3D;3">q</a>',
    '<a name="top">no link</a><abbr href="no">x</abbr><area href="no">', '<a href="a > b.html" class=x>gt</a>', "<a href=bare/>b</a><a class='x'href='tight'>t</a>",
    '<a href="same">1</a><a href="other">2</a><a href="same">3</a>', '<a href="">empty</a>', "no links at all", "<a data-href='no' href='yes'>d</a>", '<a href="&lt;&amp;lt;&apos;&quot;&unknown;">e</a>']


@pytest.mark.parametrize("page", PAGES)
def test_links_as_a_parser_finds_them(spark, page):
    base = "http://a.org/b/c.html?k=1"
    got = links.link_table(spark.createDataFrame([(1, base, page)], "page_id int, url string, html string")).collect()
    want = {}
    for k, href in enumerate(Anchors(page).found):
        want.setdefault(urljoin(base, href), k)  # the parser has decoded it
    assert {r.link: r.pos for r in got} == want


# ---- guards

def test_population_needs_the_published_years(spark):
    grid = spark.createDataFrame([(0, 0, y, float(y)) for y in (2000, 2005, 2015, 2020)], "row int, col int, year int, value double")
    samples = spark.createDataFrame([(0, 0, 2010)], "row int, col int, year int")
    with pytest.raises(Exception, match="published year"):
        context.add_population_density(samples, grid).collect()
    assert context.add_population_density(samples, grid, published=(2005, 2015)).head()["x_gpw4"] == 2010.0
    assert context.add_population_density(samples, grid, published=None).head()["x_gpw4"] == 2010.0


def test_every_cell_needs_every_day(spark):
    days = [D(2001, 1, 1) + datetime.timedelta(k) for k in range(365)]
    rows = [(r, 0, d, 1.0) for r in (0, 1) for d in days if not (r == 1 and d == D(2001, 7, 1))]
    with pytest.raises(Exception, match="incomplete year"):
        src.read_daily_grid(spark.createDataFrame(rows, "row int, col int, date date, value double"), 2001).collect()


# ---- curves

def at(spark, column, xs):
    return [r.y for r in spark.createDataFrame([(x,) for x in xs], "x double").select(column.alias("y")).collect()]


@pytest.mark.parametrize("clip", [True, False])
def test_search_gives_what_conditions_give(spark, clip):
    rng = random.Random(3)
    knots = [(rng.choice([0.1, 0.5, rng.random()]), rng.random()) for _ in range(40)]
    xs = [None, float("nan"), -1.0, 2.0, *[k for k, _ in knots], *[rng.random() for _ in range(200)]]
    by = [at(spark, calibration.piecewise(F.col("x"), knots, clip, search_from=n), xs) for n in (2, 1000)]
    assert all(a == b or (a != a and b != b) for a, b in zip(*by))


def test_ten_thousand_knots(spark):
    x = np.sort(np.random.default_rng(1).random(10_000))
    y = np.cumsum(np.random.default_rng(2).random(10_000))
    xs = np.random.default_rng(3).uniform(x[0], x[-1], 500)
    assert np.allclose(at(spark, calibration.piecewise_linear(F.col("x"), list(zip(x, y))), xs.tolist()), np.interp(xs, x, y))


def test_cubic_curve(spark):
    """A cubic is met exactly, and a curve through any points meets them with equal slopes on both sides."""
    f = lambda t: 2 * t**3 - t**2 + 0.5 * t - 1
    knots = [(t, f(t)) for t in (0.0, 0.2, 0.5, 0.6, 1.0)]
    xs = [0.05, 0.2, 0.33, 0.58, 0.77, 1.0]
    assert np.allclose(at(spark, calibration.piecewise(F.col("x"), knots, method="cubic"), xs), [f(t) for t in xs])
    assert np.allclose(at(spark, calibration.piecewise(F.col("x"), knots, method="cubic", search_from=2), xs), [f(t) for t in xs])
    rough = [(0.0, 0.0), (0.3, 1.0), (0.4, 0.2), (0.8, 0.9), (1.0, 0.1)]
    pts, segments = calibration._segments(rough, "cubic")
    for k in range(1, 4):
        h = pts[k][0] - pts[k - 1][0]
        a, b, c, d = segments[k - 1]
        assert np.allclose([a + b * h + c * h * h + d * h**3, b + 2 * c * h + 3 * d * h * h, c + 3 * d * h], segments[k][:3])
    with pytest.raises(ValueError):
        calibration.piecewise(F.col("x"), rough[:3], method="cubic")


def pooled(x, y, w):
    """Least squares rising fit by the min-max formula."""
    order = np.argsort(x, kind="stable")
    x, y, w = x[order], y[order], w[order]
    cw, cs = np.concatenate([[0], np.cumsum(w)]), np.concatenate([[0], np.cumsum(w * y)])
    mean = lambda a, b: (cs[b + 1] - cs[a]) / (cw[b + 1] - cw[a])
    return x, np.array([max(min(mean(a, b) for b in range(i, len(x))) for a in range(i + 1)) for i in range(len(x))])


@pytest.mark.parametrize("n", [1, 2, 60, 150])
def test_pooling_by_ranges(spark, n):
    rng = np.random.default_rng(n)
    x = np.unique(np.round(rng.random(n), 3))
    y, w = x + rng.normal(size=len(x)), rng.integers(1, 5, len(x)).astype(float)
    frame = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, y, w)] + [(None, 1.0, 1.0), (0.5, None, 1.0)], "x double, y double, w double")
    blocks = sorted((r.lo, r.hi, r.value) for r in calibration.monotone_blocks(frame, "x", "y", "w").collect())
    px, fit = pooled(x, y, w)
    assert np.allclose([next(v for lo, hi, v in blocks if lo <= t <= hi) for t in px], fit)
    assert all(a[1] < b[0] and a[2] < b[2] for a, b in zip(blocks, blocks[1:]))


def test_calibrated_curve_rises_and_keeps_the_mean(spark):
    """The mean of a monotone fit over its points is theirs, and the fit rises."""
    rows = [(k / 999, float((k * 7919) % 1000 < 1000 * (k / 999) ** 2)) for k in range(1000)]
    fitted = calibration.isotonic_curve(spark.createDataFrame(rows, "s double, y double"), "s", "y").orderBy("s").collect()
    assert abs(sum(r.fit for r in fitted) - sum(r.y for r in fitted)) < 1e-6 and all(a.fit <= b.fit for a, b in zip(fitted, fitted[1:]))


# ---- models

def test_kernel_blocks(monkeypatch):
    rng = np.random.default_rng(4)
    q, points, member, width = rng.normal(size=(7, 3)), rng.normal(size=(40, 3)), rng.integers(0, 2, 40), np.array([0.3, 2.0])
    plain = np.array([[np.log(sum(np.exp(-((a - b) ** 2).sum() / (2 * width[c] ** 2)) / width[c] ** 3 for b, m in zip(points, member) if m == c)) for c in (0, 1)] for a in q])
    for block in (1, 7, 1000):
        monkeypatch.setattr(models, "KERNEL_BLOCK", block)
        assert np.allclose(models.log_kernel_sums(q, points, member, width), plain)


def test_ridge_of_many_columns(spark):
    rng = np.random.default_rng(5)
    x, n = rng.normal(size=(80, 6)), 80
    y = (x @ rng.normal(size=6) + rng.normal(size=n) > 0).astype(float)
    cols = [f"c{k}" for k in range(6)]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], ", ".join(f"{c} double" for c in [*cols, "y"]))
    z = x - x.mean(axis=0)
    w = np.linalg.solve(z.T @ z + 3.0 * np.eye(6), z.T @ (y - y.mean()))
    got = [r.proba for r in models.ridge_scores(df, df, cols, "y", 3.0).collect()]
    assert np.allclose(got, np.clip(z @ w + y.mean(), 0, 1), atol=1e-6)


# ---- correlation of ranks

def tau(x, y):
    """tau-b over all pairs."""
    dx, dy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    return (dx * dy).sum() / np.sqrt(np.abs(dx).sum() * np.abs(dy).sum())


@pytest.mark.parametrize("kind", ["ties", "hot value", "distinct"])
def test_kendall_against_all_pairs(spark, kind):
    rng = np.random.default_rng(7)
    rows = []
    for key in (None, 1):
        x = {"ties": rng.integers(0, 9, 400), "hot value": np.where(rng.random(400) < 0.5, 3, rng.integers(0, 1000, 400)), "distinct": rng.random(400)}[kind].astype(float)
        y = np.round(x / 3 + rng.normal(size=400), 1 if kind != "distinct" else 9)
        rows += [(key, float(a), float(b)) for a, b in zip(x, y)]
    got = {r.k: r["corr"] for r in scores.kendall(spark.createDataFrame([*rows, (1, None, 2.0)], "k int, x double, y double"), "x", "y", ["k"]).collect()}
    for key in (None, 1):
        x, y = (np.array([r[k] for r in rows if r[0] == key]) for k in (1, 2))
        assert abs(got[key] - tau(x, y)) < 1e-9


# ---- features

def test_features_read_samples_once_and_indicators_come_last(spark, tmp_path):
    rows = [(1, 3, 8, 11, 0, 0, 2001, 9), (2, 4, 8, 11, 0, 0, 2001, 9), (3, 3, 8, 11, 0, 0, 2001, None), (4, 3, None, 11, 0, 0, 2001, 9)]
    spark.createDataFrame(rows, "id int, lct int, v int, h int, i2 int, j2 int, year int, yday int").write.parquet(str(tmp_path / "samples"))
    countries = spark.createDataFrame([("A", "X", 1, -80.0, -60.0, 0.0, 40.0)], "name string, iso3 string, continent int, xmin double, xmax double, ymin double, ymax double")
    indicator = spark.createDataFrame([("X", 2001, 1.26), ("X", 2001, 2.0)], "country_iso3 string, year int, indicator_value double")
    meta = GridMeta(60.0, 0.0, -180.0, 0.0, -30.0, 90.0, 6, 6)
    roads = spark.createDataFrame([(2, 1, 0.123)], "row int, col int, value double")
    out = features.build(spark.read.parquet(str(tmp_path / "samples")), {
        "roads": (roads, meta), "fire_weather": (spark.createDataFrame([(2, 1, D(2001, 1, 9), 5.0)], "row int, col int, date date, value double"), meta),
        "countries": (countries, None), "indicators": [("gdp", indicator)], "one_hot": [3]}, n=N, digits={"x_gdp": 1, "x_road": 2})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "COS(" not in plan and plan.count("Relation [") == 1  # coordinates are computed once per cell and day, and not in each source's reading
    got = sorted(map(tuple, out.select("id", "country", "d", "x_road", "x_fwi", "x_gdp", "x_lct_3").collect()), key=lambda r: (r[0], r[5] or 0))
    day = D(2001, 1, 9)
    assert got == [(1, "A", day, 0.12, 5.0, 1.3, True), (1, "A", day, 0.12, 5.0, 2.0, True), (2, "A", day, 0.12, 5.0, 1.3, False), (2, "A", day, 0.12, 5.0, 2.0, False),
                   (3, "A", None, None, None, 1.3, True), (3, "A", None, None, None, 2.0, True), (4, None, day, None, None, None, True)]
