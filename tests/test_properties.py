"""Invariants, and distributed order statistics against brute force on skewed data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.functions import grid as g
from pixelmill.operators import calibration, layers, models, ranks, reliability, sampling, scores, series


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, and a third of the rows with one value."""
    k = F.col("id")
    return spark.range(6000).select(
        k, F.when(k % 3 == 0, 0).otherwise(k % 7).alias("g"), F.when(k % 3 == 1, 5.0).otherwise((k * 7919) % 1000 / 10.0).alias("x"),
        ((k * 31) % 10 < 3).cast("int").alias("y")).cache()


def test_grid_round_trip(spark):
    tiles = [(1, 8), (19, 16), (22, 9), (6, 3), (22, 11), (31, 13), (35, 10)]
    rows = [(v, h, i, i) for h, v in tiles for i in (0, 600, 1199)]
    df = spark.createDataFrame(rows, "v int, h int, i int, j int")
    for res in (1, 2, 4):
        for mode in ("containing", "guide"):
            ll = g.sin_inverse(F.col("v"), F.col("h"), F.col("i"), F.col("j"), res)
            f = g.sin_forward(ll["lat"], ll["lon"], res, mode)
            same = (f["v"] == F.col("v")) & (f["h"] == F.col("h")) & (f["i"] == F.col("i")) & (f["j"] == F.col("j"))
            on_globe = df.filter(~g.off_globe(F.col("v"), F.col("h"), F.col("i"), F.col("j"), res))
            assert on_globe.count() > 10 and on_globe.filter(~same).count() == 0


def test_row_index(skewed):
    for asc in (True, False):
        p = ranks.row_index(skewed, F.col("x"), [F.col("id")], ["g"], ascending=asc).toPandas().sort_values(["g", "x", "id"], ascending=[True, asc, True])
        assert (p.groupby("g").cumcount() + 1 == p["rn"]).all()


def test_hot_value_is_split(skewed):
    b = ranks.range_bucket(skewed, F.col("x"), F.col("id")).groupBy(ranks.BUCKET).count()
    assert b.agg(F.max("count")).head()[0] < 6000 / 5


@pytest.fixture(scope="module")
def odd_orders(spark):
    """Orders of other types: nine rows of ten have none; texts with a common beginning; dates and times."""
    k = F.col("id")
    r = (k * 7919) % 6007
    return spark.range(6000).select(
        k, (k % 3).alias("g"), F.when(r % 10 == 0, r.cast("double")).alias("sparse"), F.concat(F.lit("éa"), (r % 700).cast("string")).alias("text"),
        F.when(r % 4 > 0, F.date_add(F.lit("2001-01-01").cast("date"), (r % 900).cast("int"))).alias("day"),
        F.timestamp_micros(r * 86_400_000_123).alias("ts")).cache()


@pytest.mark.parametrize("order", ["sparse", "text", "day", "ts"])
@pytest.mark.parametrize("ascending", [True, False])
def test_row_index_of_any_order(odd_orders, order, ascending):
    rows = ranks.row_index(odd_orders, F.col(order), [F.col("id")], ["g"], ascending=ascending).collect()
    for g in range(3):
        own = [r for r in rows if r["g"] == g]
        has, none = ([r for r in own if (r[order] is None) == missing] for missing in (False, True))
        has.sort(key=lambda r: r["id"])
        has.sort(key=lambda r: r[order].encode() if order == "text" else r[order], reverse=not ascending)
        assert [r["rn"] for r in [*has, *sorted(none, key=lambda r: r["id"])]] == list(range(1, len(own) + 1))


@pytest.mark.parametrize("order", ["sparse", "text", "day", "ts"])
def test_no_order_fills_one_bucket(odd_orders, order):
    b = ranks.range_bucket(odd_orders, F.col(order), F.col("id")).groupBy(ranks.BUCKET).count()
    assert b.agg(F.max("count")).head()[0] < 6000 / 5


def test_quantiles(skewed):
    probs = [0, 0.1, 0.33, 0.5, 0.9, 1]
    pdf = skewed.toPandas()
    for r in ranks.quantiles(skewed, "x", probs, ["g"]).collect():
        assert np.allclose(r["q"], np.quantile(pdf[pdf.g == r["g"]].x, probs))
    assert np.allclose(ranks.quantiles(skewed, "x", probs).head()["q"], np.quantile(pdf.x, probs))


def test_rolling_in_chunks(skewed):
    got = series.rolling(skewed.withColumn("v", F.col("x") * 1.0), "v", F.col("x"), [F.col("id")], 7, ["g"], chunk=50).toPandas().sort_values(["g", "x", "id"])
    want = got.groupby("g")["v"].rolling(7).mean().reset_index(drop=True)
    assert len(got) == 6000 and np.allclose(got["rolling_mean"].to_numpy(), want.to_numpy(), equal_nan=True)


@pytest.mark.parametrize("n", [0, 1, 777, 6000, 9999])
def test_exact_subset(skewed, n):
    got = sampling.exact_random_subset(skewed.select("id"), ["id"], n, 5)
    assert got.count() == min(n, 6000) == got.distinct().count()


def test_subset_does_not_depend_on_partitioning(skewed):
    a = sampling.exact_random_subset(skewed.select("id"), ["id"], 500, 5).toPandas()["id"]
    b = sampling.exact_random_subset(skewed.select("id").repartition(17), ["id"], 500, 5).toPandas()["id"]
    assert set(a) == set(b)


def test_split_sizes(skewed):
    s = sampling.split(skewed.select("id", "g"), ["id"], 0.5, 0.2, 1, "g").groupBy("g").pivot("split", ["train", "val", "test"]).count().toPandas()
    total = s[["train", "val", "test"]].sum(axis=1)
    assert (s["train"] == (total * 0.5 + 1e-9).astype(int)).all() and total.sum() == 6000


def test_balance(skewed):
    up = sampling.balance_classes(skewed.select("id", "g"), "g", ["id"], 1, oversample=True).groupBy("g").count().toPandas()
    assert up["count"].nunique() == 1 and up["count"].iloc[0] == skewed.groupBy("g").count().agg(F.max("count")).head()[0]
    down = sampling.balance_classes(skewed.select("id", "g"), "g", ["id"], 1).groupBy("g").count().toPandas()
    assert down["count"].nunique() == 1


def test_nested_fractions(skewed):
    a, b = (set(sampling.first_fraction(skewed.select("id"), ["id"], r, 3).toPandas()["id"]) for r in (0.1, 0.4))
    assert len(a) == 600 and len(b) == 2400 and a < b


def test_auroc_against_pairs(skewed):
    p = skewed.toPandas()
    pos, neg = p[p.y == 1].x.to_numpy(), p[p.y == 0].x.to_numpy()
    want = ((pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean())
    assert scores.auroc(skewed, "y", "x").head()[0] == pytest.approx(want)


def test_spearman(skewed):
    p = skewed.withColumn("z", F.col("id") % 11).toPandas()
    want = p["x"].rank().corr(p["z"].rank())
    assert scores.spearman(skewed.withColumn("z", F.col("id") % 11), "x", "z").head()[0] == pytest.approx(want)


def test_bins_partition_the_rows(skewed):
    df = skewed.withColumn("p", F.col("x") / 100)
    for mode in ("uniform", "quantile"):
        b = reliability.reliability(df, "y", "p", 9, mode=mode)
        assert b.agg(F.sum("n_samples")).head()[0] == 6000


def test_adjustment_with_rate_one_is_identity(skewed):
    b = reliability.reliability(skewed.withColumn("p", F.col("x") / 100), "y", "p", 5, knr=1.0).filter("n_samples > 0")
    assert b.filter(F.abs(F.col("y_true_mean") - F.col("y_true_mean_adj")) > 1e-12).count() == 0
    assert b.filter(F.abs(F.col("support") - F.col("support_adj")) > 1e-12).count() == 0


def test_calibration_keeps_the_product(skewed):
    df = skewed.select(((F.col("id") % 97 + 1) / 98).alias("qf"), ((F.col("id") % 13 + 1) / 40).alias("qi"), "y")
    cal = calibration.fit_factor_calibration(df, calibration.FactorSettings(n_qf=5, n_qi=3, limit="micro"))
    out = calibration.apply_factor_calibration(df, cal.knots).filter("not clamped")
    assert out.count() > 0 and out.filter(F.abs(F.col("py") - F.col("qf") * F.col("qi")) > 1e-12).count() == 0


def test_isotonic_is_monotone(spark):
    pts = spark.createDataFrame([(k / 10, ((k * 7) % 10) / 10) for k in range(11)], "x double, y double")
    fit = [r["fit"] for r in calibration.isotonic_curve(pts, "x", "y", lo=0.001).orderBy("x").collect()]
    assert fit == sorted(fit) and min(fit) >= 0.001


def test_pooling_commutes_with_union(skewed):
    cells = skewed.select((F.col("id") % 2).cast("int").alias("v"), F.lit(0).alias("h"), (F.col("id") % 40).cast("int").alias("i"), (F.col("id") / 150).cast("int").alias("j"), F.col("x").alias("value"))
    whole = layers.pool(cells, (4, 5), "max")
    parts = layers.pool(cells.filter("v = 0"), (4, 5), "max").unionByName(layers.pool(cells.filter("v = 1"), (4, 5), "max"))
    assert whole.exceptAll(parts).count() == 0 and parts.exceptAll(whole).count() == 0


def test_kde_posterior_sums_to_one(skewed):
    df = skewed.select("id", (F.col("x") / 100).alias("a"), "y")
    p = models.kde_class_scores(df, df, ["a"], "y", "id", 0.1, 50)
    assert p.filter(F.abs(F.col("posterior")["0"] + F.col("posterior")["1"] - 1) > 1e-9).count() == 0


def test_calibrated_variants(spark):
    from pyspark.ml.classification import LogisticRegression

    df = spark.range(400).select("id", ((F.col("id") * 7919 % 400) / 400).alias("a")).withColumn("y", (F.col("a") + (F.col("id") % 10) / 20 > 0.7).cast("double"))
    made = models.calibrated_variants({"lr": LogisticRegression(featuresCol="_features", labelCol="y")}, df, ["a"], "y", ["id"])
    assert set(made) == {"lr", "lr_iso", "lr_sig"}
    out = made["lr_iso"].transform(models._vectors(df, ["a"]))
    assert out.filter("proba < 0 OR proba > 1").count() == 0
