"""Calibration of probabilities that are a product of two factors, and of single probabilities.

Fitting reads the rows twice: once for the bin edges (a few dozen numbers, brought to the driver) and once
for the sums per bin, with the edges as literals in generated code. The curve has about twenty knots.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.functions import scalars as s
from pixelmill.operators import ranks
from pixelmill.operators.reliability import literal_bin_index, reliability


def percentile_edges(df: DataFrame, probs: dict[str, Sequence[float]]) -> dict[str, list[float]]:
    """Distinct exact percentiles per column, all columns in one job; [0, 1] for a constant column."""
    every = sorted({p for ps in probs.values() for p in ps})
    long = df.unpivot([], list(probs), "_column", "_x")
    found = {r["_column"]: dict(zip(every, r["q"])) for r in ranks.quantiles(long, "_x", every, ["_column"]).collect()}
    edges = {c: sorted({found[c][p] for p in ps}) for c, ps in probs.items()}
    return {c: e if len(e) > 1 else [0.0, 1.0] for c, e in edges.items()}


SEARCH_FROM = 65  # knots from which a curve is searched instead of being written out in generated code


def _spline(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients per segment of the cubic spline through at least four points whose third derivative is continuous at the second and the
    last but one."""
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    n = len(x)
    m = np.zeros((n, n))
    right = np.zeros(n)
    for k in range(1, n - 1):
        m[k, k - 1:k + 2] = h[k - 1], 2 * (h[k - 1] + h[k]), h[k]
        right[k] = 6 * (slope[k] - slope[k - 1])
    m[0, :3] = h[1], -(h[0] + h[1]), h[0]
    m[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    bend = np.linalg.solve(m, right)
    return np.stack([y[:-1], slope - h * (2 * bend[:-1] + bend[1:]) / 6, bend[:-1] / 2, (bend[1:] - bend[:-1]) / (6 * h)], axis=1)


def _segments(knots: Sequence[tuple[float, float]], method: str) -> tuple[list[tuple[float, float]], list[list[float]]]:
    """Knots in order, and per segment between two of them the coefficients of powers of the distance from its left end."""
    pts = sorted((float(x), float(y)) for x, y in knots)
    if method == "linear":
        return pts, [[y0, (y1 - y0) / (x1 - x0) if x1 > x0 else 0.0] for (x0, y0), (x1, y1) in zip(pts, pts[1:])]
    if method != "cubic":
        raise ValueError("method must be linear or cubic")
    x, y = np.array(pts).T
    if len(x) < 4 or (np.diff(x) <= 0).any():
        raise ValueError("a cubic curve needs four knots or more, all different")
    return pts, _spline(x, y).tolist()


def _numbers(values: Sequence[float]) -> Column:
    """Array literal of any length from one string, which is parsed once."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def _polynomial(distance: Column, coefficients: Sequence[Column | float]) -> Column:
    """Written out from the constant term on."""
    terms = coefficients[0] + distance * coefficients[1]
    for power, c in enumerate(coefficients[2:], 2):
        terms = terms + reduce(lambda u, v: u * v, [distance] * power) * c
    return terms


def piecewise(x: Column, knots: Sequence[tuple[float, float]], clip: bool = False, method: str = "linear", search_from: int = SEARCH_FROM) -> Column:
    """Interpolation through knots, linear or by a cubic spline; NULL outside them unless ``clip``.

    A few knots become conditions in generated code; more are searched by halving in a sorted array, so a curve of any length is one short
    expression. Of knots at one place the first in order ends what is left of it and the last begins what is right of it."""
    pts, segments = _segments(knots, method)
    first, last = pts[0], pts[-1]
    if len(pts) < search_from:
        value = F.when(x == first[0], F.lit(first[1]))
        for (x0, _), (x1, _), c in zip(pts, pts[1:], segments):
            if x1 > x0:
                value = value.when((x > x0) & (x <= x1), _polynomial(x - x0, [F.lit(k) for k in c]))
    else:
        n = len(pts)
        places, table = _numbers([p for p, _ in pts]), [_numbers(c) for c in zip(*segments)]
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
        # number of knots left of x, bit by bit
        below = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(places, at + step - 1) < x), at + step).otherwise(at))
        inside = F.transform(F.array(below), lambda k: F.when(k.between(1, n - 1), _polynomial(x - F.get(places, k - 1), [F.get(c, k - 1) for c in table])))
        value = F.when(x == first[0], F.lit(first[1])).otherwise(F.get(inside, F.lit(0)))
    if clip:
        value = F.when(x < first[0], F.lit(first[1])).when(x > last[0], F.lit(last[1])).otherwise(value)
    return value


def piecewise_linear(x: Column, knots: Sequence[tuple[float, float]], clip: bool = False) -> Column:
    """Linear interpolation through knots; NULL outside them unless ``clip``."""
    return piecewise(x, knots, clip)


_FAN = 64  # neighbouring ranges pooled together in one round


def _pool(rows: pd.DataFrame) -> pd.DataFrame:
    """Pool blocks (lo, hi, w, s) whose means s / w do not rise."""
    out: list[list[float]] = []
    for lo, hi, w, s in rows.sort_values("lo")[["lo", "hi", "w", "s"]].itertuples(index=False, name=None):
        while out and out[-1][3] * w >= s * out[-1][2]:
            last = out.pop()
            lo, w, s = last[0], last[2] + w, last[3] + s
        out.append([lo, hi, w, s])
    return pd.DataFrame(out, columns=["lo", "hi", "w", "s"]).assign(range=rows["range"].iloc[0] // _FAN)


def monotone_blocks(points: DataFrame, x: str, y: str, weight: str | None = None) -> DataFrame:
    """(lo, hi, value, weight) per level of the rising step function that fits weighted points best, by pooling adjacent violators.

    Equal x are summed first. Each range of x is pooled on its own; what it leaves is a stack of blocks, and pooling the stacks of neighbouring
    ranges gives what pooling all of their points would give, so rounds of ``_FAN`` ranges lead to one stack."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    sums = points.select(F.col(x).cast("double").alias("lo"), w.alias("w"), (F.col(y) * w).alias("s")) \
        .filter(F.col("lo").isNotNull() & F.col("s").isNotNull() & (F.col("w") > 0)).groupBy("lo").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
    ranged = ranks.range_bucket(sums, F.col("lo")).select("lo", F.col("lo").alias("hi"), "w", "s", F.col(ranks.BUCKET).cast("bigint").alias("range"))
    left = 2 * ranks.slots(points) ** 2 + 1
    while left:
        ranged = ranged.groupBy("range").applyInPandas(_pool, "lo double, hi double, w double, s double, range bigint")
        left //= _FAN
    last = ranged.groupBy("range").applyInPandas(_pool, "lo double, hi double, w double, s double, range bigint")
    return last.select("lo", "hi", (F.col("s") / F.col("w")).alias("value"), F.col("w").alias("weight"))


def isotonic_knots(points: DataFrame, x: str, y: str, weight: str | None = None, lo: float = 0.0, hi: float = 1.0) -> list[tuple[float, float]]:
    """Ends of the levels of a monotone fit through weighted points, held in [lo, hi]; only the fitted levels come to the driver."""
    levels = sorted((r["lo"], r["hi"], min(hi, max(lo, r["value"]))) for r in monotone_blocks(points, x, y, weight).collect())
    return [(x, v) for a, b, v in levels for x in ((a, b) if b > a else (a,))]


def isotonic_curve(points: DataFrame, x: str, y: str, weight: str | None = None, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """The given points with their monotone fit."""
    return points.withColumn("fit", piecewise_linear(F.col(x), isotonic_knots(points, x, y, weight, lo, hi), clip=True))


# --- two factors -----------------------------------------------------------------------------------------

@dataclass(frozen=True)
class FactorSettings:
    n_qf: int = 10
    n_qi: int = 10
    pad: float = 1.0  # percent cut off at both ends as bins of their own
    qi_mode: str = "quantile"
    min_last: int = 100  # rows the reference bin of a qi bin has to have
    on_small_last: str = "drop"
    min_pf: float = 0.001
    limit: str | None = None  # None, "micro" (per bin) or "macro" (after averaging)
    ref_bin: str = "last"
    means_as_pos: bool = True
    use_py: bool = False
    legacy: bool = False  # leave the lowest qi out, one qi bin less in uniform mode
    method: str = "linear"  # or "cubic" or "isotonic"
    weighted: bool = False
    manual_qf: tuple[float, ...] | None = None  # percentiles of the bin edges, in place of n_qf and pad
    manual_qi: tuple[float, ...] | None = None  # in quantile mode, in place of n_qi


def factor_edges(df: DataFrame, cfg: FactorSettings, qf: str = "qf", qi: str = "qi") -> tuple[list[float], list[float]]:
    lo, hi = cfg.pad / 100, 1 - cfg.pad / 100
    probs = [lo + k * (hi - lo) / cfg.n_qf for k in range(cfg.n_qf + 1)]
    probs = [0.0, *probs, 1.0] if cfg.pad > 0 else probs
    wanted = {qf: probs if cfg.manual_qf is None else [p / 100 for p in cfg.manual_qf]}
    if cfg.qi_mode == "quantile":
        wanted[qi] = [k / cfg.n_qi for k in range(cfg.n_qi + 1)] if cfg.manual_qi is None else [p / 100 for p in cfg.manual_qi]
    edges = percentile_edges(df, wanted)
    n = cfg.n_qi - 1 if cfg.legacy else cfg.n_qi
    return edges[qf], edges.get(qi) or [k / n for k in range(n + 1)]


def two_factor_bins(df: DataFrame, e_f: Sequence[float], e_i: Sequence[float], cfg: FactorSettings, y: str = "y",
                    r_original: float | None = None, qf: str = "qf", qi: str = "qi") -> DataFrame:
    """Means and supports per (qi bin, qf bin), with the rate relative to the reference bin of the qi bin."""
    target = F.col(qf) * F.col(qi) if cfg.use_py else F.col(y).cast("double")
    rows = df.select(F.col(qf).alias("_f"), F.col(qi).alias("_i"), target.alias("_y"), F.col(y).cast("double").alias("_t")) \
        .withColumns({"qf_bin": literal_bin_index(F.col("_f"), e_f), "qi_bin": literal_bin_index(F.col("_i"), e_i)})
    if cfg.legacy:
        rows = rows.filter(F.col("_i") > e_i[0])
    b = rows.filter("qf_bin IS NOT NULL AND qi_bin IS NOT NULL").groupBy("qi_bin", "qf_bin").agg(
        F.count(F.lit(1)).alias("support"), F.avg("_y").alias("y_mean_raw"), F.avg("_f").alias("qf_mean"), F.avg("_i").alias("qi_mean"))
    if r_original is None:
        b = b.withColumn("y_mean", F.col("y_mean_raw"))
    else:
        sampled = df.agg(F.avg(F.col(y).cast("double"))).scalar()
        b = b.withColumn("_r", sampled).withColumn("y_mean", s.adjust_mean(F.col("y_mean_raw"), s.keep_neg_rate(F.col("_r"), r_original))).drop("_r")
    last = len(e_f) - 2
    w = Window.partitionBy("qi_bin")
    n_last = F.coalesce(F.max(F.when(F.col("qf_bin") == last, F.col("support"))).over(w), F.lit(0))
    b = b.withColumn("_n", n_last)
    if cfg.on_small_last == "raise":
        small = F.raise_error(F.lit("reference bin has too few rows")).cast("bigint")
        b = b.withColumn("support", F.when(F.col("_n") >= cfg.min_last, F.col("support")).otherwise(small))
    else:
        b = b.filter(F.col("_n") >= cfg.min_last)
    ref = F.max(F.when(F.col("qf_bin") == last, F.col("y_mean"))).over(w) if cfg.ref_bin == "last" else F.max("y_mean").over(w)
    scaled = F.try_divide(F.col("y_mean"), ref)
    b = b.withColumn("scaled_raw", scaled)
    return b.withColumn("scaled", F.least(F.col("scaled_raw"), F.lit(1.0)) if cfg.limit == "micro" else F.col("scaled_raw")).drop("_n")


def factor_curve(bins: DataFrame, e_f: Sequence[float], cfg: FactorSettings) -> DataFrame:
    """Support-weighted mean per qf bin over the qi bins, with a first knot at 0."""
    first = bins.select("qi_bin").distinct().select(
        "qi_bin", F.lit(-1).alias("qf_bin"), F.lit(1).cast("bigint").alias("support"), F.lit(cfg.min_pf).alias("scaled"), F.lit(0.0).alias("qf_mean"))
    every = bins.select("qi_bin", "qf_bin", "support", "scaled", "qf_mean").unionByName(first)

    def mean(c: str) -> Column:
        return F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum(F.when(F.col(c).isNotNull(), F.col("support"))))

    edges = F.array(F.lit(0.0), *[F.lit(float(e)) for e in e_f])
    c = every.groupBy("qf_bin").agg(mean("scaled").alias("scaled"), F.sum("support").alias("support"), mean("qf_mean").alias("_m")) \
        .withColumns({"lo": F.get(edges, F.col("qf_bin") + 1), "hi": F.get(edges, F.col("qf_bin") + 2)})
    pos = F.col("_m") if cfg.means_as_pos else F.when(F.col("qf_bin") == -1, F.col("lo")).otherwise((F.col("lo") + F.col("hi")) / 2)
    c = c.withColumn("pos", pos).drop("_m")
    return c.withColumn("scaled", F.least(F.col("scaled"), F.lit(1.0))) if cfg.limit == "macro" else c


@dataclass(frozen=True)
class FactorCalibration:
    knots: list[tuple[float, float]]
    curve: DataFrame
    bins: DataFrame
    clip: bool
    method: str = "linear"


def fit_factor_calibration(df: DataFrame, cfg: FactorSettings = FactorSettings(), y: str = "y", r_original: float | None = None,
                           qf: str = "qf", qi: str = "qi") -> FactorCalibration:
    e_f, e_i = factor_edges(df, cfg, qf, qi)
    bins = two_factor_bins(df, e_f, e_i, cfg, y, r_original, qf, qi)
    curve = factor_curve(bins, e_f, cfg)
    if cfg.method == "isotonic":
        pts = curve.filter("scaled IS NOT NULL")
        return FactorCalibration(isotonic_knots(pts, "pos", "scaled", "support" if cfg.weighted else None, cfg.min_pf, 1.0), curve, bins, True)
    knots = [(r["pos"], r["scaled"]) for r in curve.collect() if r["scaled"] is not None]  # one row per qf bin
    return FactorCalibration([*knots, (1.0, 1.0)], curve, bins, False, cfg.method)


def apply_factor_calibration(df: DataFrame, knots: Sequence[tuple[float, float]], clip: bool = False, qf: str = "qf", qi: str = "qi",
                             method: str = "linear") -> DataFrame:
    """Move probability from qi to qf along the curve: p_f, p_i, py and whether p_i had to be clamped."""
    p_f = piecewise(F.col(qf), knots, clip, method)
    raw = F.when(F.col(qf) == 0, F.col(qi)).otherwise(F.try_divide(F.col(qi) * F.col(qf), F.col("p_f")))
    out = df.withColumn("p_f", p_f).withColumn("_i", raw)
    return out.withColumns({"p_i": s.clamp(F.col("_i")), "clamped": F.col("_i") > 1}).withColumn("py", F.col("p_f") * F.col("p_i")).drop("_i")


# --- reference points over both factors ------------------------------------------------------------------

def reference_points_2d(df: DataFrame, qf_percentiles: Sequence[float], qi_percentiles: Sequence[float], y: str | None = None,
                        r_original: float | None = None, centering: str = "mean", qf: str = "qf", qi: str = "qi") -> DataFrame:
    """Centre, adjusted rate and rows of each (qi, qf) bin, points on the border of the unit square, and the
    rate as a running maximum along qf that ends at 1. Bins without rows are left out."""
    if centering not in ("mean", "mid", "median"):
        raise ValueError("centering must be mean, mid or median")
    edges = percentile_edges(df, {c: [0.0, *[p / 100 for p in ps], 1.0] for c, ps in ((qf, qf_percentiles), (qi, qi_percentiles))})
    e_f, e_i = edges[qf], edges[qi]
    target = F.col(qf) * F.col(qi) if y is None else F.col(y).cast("double")
    rows = df.select(F.col(qf).alias("qf"), F.col(qi).alias("qi"), target.alias("_y")).withColumns(
        {"qf_bin": literal_bin_index(F.col("qf"), e_f), "qi_bin": literal_bin_index(F.col("qi"), e_i)})
    keys = ["qi_bin", "qf_bin"]
    pts = rows.groupBy(*keys).agg(F.avg("_y").alias("py"), F.count(F.lit(1)).alias("n_samples"), F.avg("qf").alias("qf"), F.avg("qi").alias("qi"))
    if centering == "mid":
        for c, e in (("qf", e_f), ("qi", e_i)):
            a = F.array(*[F.lit(float(k)) for k in e])
            pts = pts.withColumn(c, (F.get(a, F.col(f"{c}_bin")) + F.get(a, F.col(f"{c}_bin") + 1)) / 2)
    elif centering == "median":
        for c in ("qf", "qi"):
            m = ranks.quantiles(rows, c, [0.5], keys, out="_m")
            pts = pts.drop(c).join(m, keys).withColumn(c, F.col("_m")[0]).drop("_m")
    if r_original is not None:
        sampled = rows.agg(F.avg("_y")).scalar()
        pts = pts.withColumn("_r", sampled).withColumn("py", s.adjust_mean(F.col("py"), s.keep_neg_rate(F.col("_r"), r_original))).drop("_r")
    from pixelmill.operators.series import running_max

    out = running_max(pts.unionByName(_limit_points(pts, len(e_f) - 1, len(e_i) - 1)), "py", ["qi_bin"], "qf_bin", "pf_hat")
    return out.withColumn("is_limit", F.col("n_samples") == 0)


def _limit_points(pts: DataFrame, n_f: int, n_i: int) -> DataFrame:
    """Border points of the bin table: every qi bin at qf 0 and 1, every qf bin at qi 0 and 1, and the corners."""

    def ends(by: str, along: str):
        return [pts.groupBy(by).agg(pick(F.struct("qi_bin", "qf_bin", "qi", "qf", "py"), along).alias("p")) for pick in (F.min_by, F.max_by)]

    def point(df: DataFrame, qi_bin, qf_bin, qi, qf) -> DataFrame:
        return df.select(F.lit(qi_bin).cast("int").alias("qi_bin") if isinstance(qi_bin, int) else qi_bin.cast("int").alias("qi_bin"),
                         F.lit(qf_bin).cast("int").alias("qf_bin") if isinstance(qf_bin, int) else qf_bin.cast("int").alias("qf_bin"),
                         (F.lit(qi) if isinstance(qi, float) else qi).alias("qi"), (F.lit(qf) if isinstance(qf, float) else qf).alias("qf"),
                         F.col("p.py").alias("py"), F.lit(0).cast("bigint").alias("n_samples"))

    out = []
    for (df, side) in zip(ends("qi_bin", "qf_bin"), (0, 1)):
        f_bin, f_val = (-1, 0.0) if side == 0 else (n_f, 1.0)
        out.append(point(df, F.col("p.qi_bin"), f_bin, F.col("p.qi"), f_val))
        out.append(point(df.filter("p.qi_bin = 0"), -1, f_bin, 0.0, f_val))
        out.append(point(df.filter(F.col("p.qi_bin") == n_i - 1), n_i, f_bin, 1.0, f_val))
    for (df, side) in zip(ends("qf_bin", "qi_bin"), (0, 1)):
        i_bin = F.col("p.qi_bin") - 1 if side == 0 else F.col("p.qi_bin") + 1
        out.append(point(df, i_bin, F.col("p.qf_bin"), float(side), F.col("p.qf")))
    merged = out[0]
    for o in out[1:]:
        merged = merged.unionByName(o)
    return merged


def factor_loss_terms(df: DataFrame, y: str = "y", qf_mean: float = 0.1, qf_min: float = 0.001, sigmoid_shift: float = 0.1,
                      weights: dict[str, float] | None = None, eps: float = 1e-12) -> DataFrame:
    """Log loss of py = qf * qi, penalties on the distribution of qf, and their weighted total, as one row."""
    d = df.select("qf", "qi", (F.col("qf") * F.col("qi")).alias("py"), F.col(y).cast("double").alias("_y"))
    m = d.agg(F.struct(F.avg("qf").alias("mean"), F.min("qf").alias("fmin"), F.max("qf").alias("fmax"), F.max("qi").alias("imax"),
                       F.min("py").alias("pmin"), F.max("py").alias("pmax")).alias("m")).scalar()
    d = d.withColumn("_m", m)
    mean, f = F.col("_m.mean"), F.col("qf")
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col("py")))
    pf = (F.col("py") - F.col("_m.pmin") + 1e-14) / (F.col("_m.pmax") - F.col("_m.pmin") + 1e-14)
    over = F.greatest(mean - qf_mean, F.lit(0.0))
    shifted = s.sigmoid(s.logit(f) - sigmoid_shift * over)

    def once(c: Column) -> Column:
        return F.max(c)

    # fixed values: the names of the terms
    terms = {
        "logl": F.avg(-(F.col("_y") * F.log(p) + (1 - F.col("_y")) * F.log(1 - p))),
        "pullmean": once(F.pow(mean - qf_mean, F.lit(2.0))), "pulldown": once(F.when(mean > qf_mean, mean).otherwise(0.0)),
        "pullcenter": F.avg(F.pow((1 - (f - mean)) * (f - qf_mean), F.lit(2.0))), "pullmin": once(F.pow("_m.fmin", F.lit(2.0))),
        "pullmax": once(F.pow(F.col("_m.fmax") - 1, F.lit(2.0))), "pullpf": F.avg(F.pow(f - pf, F.lit(2.0))),
        "pullbymin": once(F.greatest(F.col("_m.fmin") - qf_min, F.lit(0.0))), "stretchqi": once(F.pow(F.col("_m.imax") - 1, F.lit(2.0))),
        "pullsigmoid": F.avg(F.when(over > 0, f - shifted).otherwise(0.0)), "pull": once(mean)}
    out = d.agg(*[c.alias(n) for n, c in terms.items()])
    total = F.col("logl")
    for n, w in (weights or {}).items():
        total = total + w * F.col(n)
    return out.withColumn("total", total)


# --- one probability -------------------------------------------------------------------------------------

def histogram_knots(preds: DataFrame, y: str = "y_true", p: str = "y_proba", n_bins: int = 10, mode: str = "quantile",
                    r_original: float | None = None) -> list[tuple[float, float]]:
    """Points (mean score, true rate) of the bins between (0, 0) and (1, 1)."""
    knr = None
    if r_original is not None:
        sampled = preds.agg(F.avg(F.col(y).cast("double"))).head()[0]
        knr = (r_original / (1 - r_original)) / (sampled / (1 - sampled))
    rows = reliability(preds, y, p, n_bins, mode=mode, knr=knr).filter("n_samples > 0").collect()  # one row per bin
    rate = "y_true_mean" if knr is None else "y_true_mean_adj"
    return [(0.0, 0.0), *sorted((r["y_proba_mean"], r[rate]) for r in rows), (1.0, 1.0)]


def apply_histogram_calibration(preds: DataFrame, knots: Sequence[tuple[float, float]], p: str = "y_proba", out: str = "y_calibrated",
                                method: str = "linear") -> DataFrame:
    return preds.withColumn(out, piecewise(F.col(p), knots, method=method))
