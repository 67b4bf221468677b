"""Two-factor and histogram calibration over the prediction lens."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelmill.operators import calibration as cal
from pixelmill.plans.check_scores import bins_sql, quantile_sql, rounded
from pixelmill.plans.lenses import PREDS_SQL
from pixelmill.plans.registry import query

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEY_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
CFG = cal.FactorSettings(n_qf=6, n_qi=4, min_last=3, limit="micro")


def pairs(t):
    return t.preds.select(*KEY, F.col("p_f").alias("qf"), F.col("p_i").alias("qi"), F.col("y_true").alias("y"))


def _idx(edges, x):
    return f"CAST(len(list_filter({edges}[2:len({edges}) - 1], lambda z: z < {x})) AS INT)"


_PROBS = [0.0] + [0.01 + k * (0.99 - 0.01) / 6 for k in range(7)] + [1.0]
BINS_SQL = f"""{PREDS_SQL}, ef AS (SELECT list_sort(list_distinct(q)) AS ef FROM {quantile_sql('preds', 'p_f', _PROBS)}),
  ei AS (SELECT list_sort(list_distinct(q)) AS ei FROM {quantile_sql('preds', 'p_i', [k / 4 for k in range(5)])}),
  bb AS (SELECT {_idx('ef', 'p_f')} AS qf_bin, {_idx('ei', 'p_i')} AS qi_bin, p_f, p_i, y_true AS y, len(ef) - 2 AS last FROM preds, ef, ei),
  gg AS (SELECT qi_bin, qf_bin, last, count(*) AS support, avg(y) AS y_mean_raw, avg(p_f) AS qf_mean, avg(p_i) AS qi_mean FROM bb GROUP BY ALL),
  aa AS (SELECT *, y_mean_raw/(1 - y_mean_raw)*((0.05/0.95)/((SELECT avg(y_true) FROM preds)/(1 - (SELECT avg(y_true) FROM preds)))) AS o,
    max(CASE WHEN qf_bin = last THEN support END) OVER (PARTITION BY qi_bin) AS nl FROM gg),
  mm AS (SELECT *, o/(o + 1) AS y_mean FROM aa WHERE coalesce(nl, 0) >= 3),
  tf AS (SELECT *, y_mean/nullif(max(CASE WHEN qf_bin = last THEN y_mean END) OVER (PARTITION BY qi_bin), 0) AS scaled_raw FROM mm)"""


@query("two_factor_bins", f"""WITH {BINS_SQL} SELECT qi_bin, qf_bin, support, round(y_mean_raw, 6) AS y_mean_raw, round(qf_mean, 6) AS qf_mean, round(qi_mean, 6) AS qi_mean,
  round(y_mean, 6) AS y_mean, round(scaled_raw, 6) AS scaled_raw, round(CASE WHEN scaled_raw IS NOT NULL THEN least(scaled_raw, 1.0) END, 6) AS scaled FROM tf""")
def _bins(t):
    df = pairs(t)
    e_f, e_i = cal.factor_edges(df, CFG)
    return rounded(cal.two_factor_bins(df, e_f, e_i, CFG, r_original=0.05))


CURVE_SQL = f"""{BINS_SQL}, ev AS (SELECT qi_bin, qf_bin, support, CASE WHEN scaled_raw IS NOT NULL THEN least(scaled_raw, 1.0) END AS scaled, qf_mean FROM tf
    UNION ALL SELECT DISTINCT qi_bin, -1, 1, 0.001, 0.0 FROM tf),
  cv AS (SELECT qf_bin, sum(scaled*support)/sum(CASE WHEN scaled IS NOT NULL THEN support END) AS scaled, sum(support)::BIGINT AS support, sum(qf_mean*support)/sum(support) AS pos FROM ev GROUP BY 1)"""


@query("fit_factor_calibration", f"""WITH {CURVE_SQL} SELECT qf_bin, round(scaled, 6) AS scaled, support, round(pos, 6) AS pos,
  round(CASE WHEN qf_bin = -1 THEN 0 ELSE ef[qf_bin + 1] END, 6) AS lo, round(CASE WHEN qf_bin = -1 THEN ef[1] ELSE ef[qf_bin + 2] END, 6) AS hi FROM cv, ef""")
def _curve(t):
    return rounded(cal.fit_factor_calibration(pairs(t), CFG, r_original=0.05).curve)


@query("apply_factor_calibration", f"""WITH {CURVE_SQL}, kn AS (SELECT pos AS x, scaled AS y FROM cv UNION ALL SELECT 1.0, 1.0),
  sg AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM kn),
  ap AS (SELECT {KEY_SQL}, p_f AS qf, p_i AS qi, y0 + (p_f - x0)*((y1 - y0)/(x1 - x0)) AS pf FROM preds JOIN sg ON p_f > x0 AND p_f <= x1),
  cl AS (SELECT *, qi*qf/pf AS raw FROM ap) SELECT {KEY_SQL}, round(qf, 6) AS qf, round(qi, 6) AS qi, round(pf, 6) AS p_f, round(least(raw, 1.0), 6) AS p_i, round(pf*least(raw, 1.0), 6) AS py FROM cl""")
def _apply(t):
    df = pairs(t)
    knots = cal.fit_factor_calibration(df, CFG, r_original=0.05).knots
    return rounded(cal.apply_factor_calibration(df, knots).drop("clamped", "y"))


# the best rising fit at a point: of all runs of points that end at or behind it, beginning at or before it, the largest of the least means
ISOTONIC_SQL = f"""{PREDS_SQL}, pt AS (SELECT round(p_f, 2) AS x, avg(y_true) AS rate, CAST(count(*) AS DOUBLE) AS w, count(*)*avg(y_true) AS s FROM preds GROUP BY 1),
  cu AS (SELECT *, row_number() OVER o AS i, sum(w) OVER o AS cw, sum(s) OVER o AS cs FROM pt WINDOW o AS (ORDER BY x)),
  mn AS (SELECT p.i, a.i AS ai, min((b.cs - a.cs + a.s)/(b.cw - a.cw + a.w)) AS m FROM cu p JOIN cu a ON a.i <= p.i JOIN cu b ON b.i >= p.i GROUP BY ALL),
  fi AS (SELECT i, greatest(0.001, least(1.0, max(m))) AS fit FROM mn GROUP BY i)"""


@query("isotonic_curve", f"WITH {ISOTONIC_SQL} SELECT round(x, 6) AS x, round(rate, 6) AS rate, w, round(fit, 6) AS fit FROM cu JOIN fi USING (i)")
def _isotonic(t):
    points = t.preds.groupBy(F.round("p_f", 2).alias("x")).agg(F.avg("y_true").alias("rate"), F.count(F.lit(1)).cast("double").alias("w"))
    return rounded(cal.isotonic_curve(points, "x", "rate", "w", 0.001, 1.0))


@query("histogram_calibrator", f"""WITH {PREDS_SQL}, {bins_sql('preds', [], 'SELECT 1 AS st, list_sort(list_distinct(q)) AS e FROM ' + quantile_sql('preds', 'y_proba', [k / 8 for k in range(9)]))},
  kn AS (SELECT y_proba_mean AS x, y_true_mean AS y FROM rel UNION ALL SELECT 0, 0 UNION ALL SELECT 1, 1),
  sg AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM kn)
  SELECT {KEY_SQL}, round(y_proba, 6) AS y_proba, round(y0 + (y_proba - x0)*((y1 - y0)/(x1 - x0)), 6) AS y_calibrated FROM preds JOIN sg ON y_proba > x0 AND y_proba <= x1""")
def _histogram(t):
    knots = cal.histogram_knots(t.preds, n_bins=8)
    return rounded(cal.apply_histogram_calibration(t.preds.select(*KEY, "y_proba"), knots))


def _points_sql(probs_f, probs_i, cf, ci):
    return f"""{PREDS_SQL}, ef AS (SELECT list_sort(list_distinct(q)) AS ef FROM {quantile_sql('preds', 'p_f', probs_f)}),
  ei AS (SELECT list_sort(list_distinct(q)) AS ei FROM {quantile_sql('preds', 'p_i', probs_i)}),
  bb AS (SELECT {_idx('ef', 'p_f')} AS qf_bin, {_idx('ei', 'p_i')} AS qi_bin, p_f, p_i, y_true AS y FROM preds, ef, ei),
  pt AS (SELECT qi_bin, qf_bin, avg(y) AS py, count(*) AS n_samples, {cf} AS qf, {ci} AS qi FROM bb GROUP BY ALL),
  nf AS (SELECT (SELECT len(ef) - 1 FROM ef)::INT AS nf, (SELECT len(ei) - 1 FROM ei)::INT AS ni),
  e1 AS (SELECT qi_bin, arg_min(qi, qf_bin) AS qi0, arg_min(py, qf_bin) AS py0, arg_max(qi, qf_bin) AS qi1, arg_max(py, qf_bin) AS py1 FROM pt GROUP BY 1),
  e2 AS (SELECT qf_bin, min(qi_bin) AS b0, arg_min(qf, qi_bin) AS qf0, arg_min(py, qi_bin) AS py0, max(qi_bin) AS b1, arg_max(qf, qi_bin) AS qf1, arg_max(py, qi_bin) AS py1 FROM pt GROUP BY 1),
  al AS (SELECT qi_bin, qf_bin, py, n_samples, qf, qi FROM pt
    UNION ALL SELECT qi_bin, -1, py0, 0, 0.0, qi0 FROM e1 UNION ALL SELECT qi_bin, nf, py1, 0, 1.0, qi1 FROM e1, nf
    UNION ALL SELECT -1, -1, py0, 0, 0.0, 0.0 FROM e1 WHERE qi_bin = 0 UNION ALL SELECT -1, nf, py1, 0, 1.0, 0.0 FROM e1, nf WHERE qi_bin = 0
    UNION ALL SELECT ni, -1, py0, 0, 0.0, 1.0 FROM e1, nf WHERE qi_bin = ni - 1 UNION ALL SELECT ni, nf, py1, 0, 1.0, 1.0 FROM e1, nf WHERE qi_bin = ni - 1
    UNION ALL SELECT b0 - 1, qf_bin, py0, 0, qf0, 0.0 FROM e2 UNION ALL SELECT b1 + 1, qf_bin, py1, 0, qf1, 1.0 FROM e2),
  cm AS (SELECT *, max(py) OVER (PARTITION BY qi_bin ORDER BY qf_bin) AS c FROM al), mv AS (SELECT *, min(c) OVER (PARTITION BY qi_bin) AS lo, max(c) OVER (PARTITION BY qi_bin) AS hi FROM cm)
  SELECT qi_bin, qf_bin, round(py, 6) AS py, n_samples, round(qf, 6) AS qf, round(qi, 6) AS qi, round((c - lo)/nullif(hi - lo, 0)*(1 - lo) + lo, 6) AS pf_hat, n_samples = 0 AS is_limit FROM mv"""


@query("reference_points_2d", "WITH " + _points_sql([0.0, 0.25, 0.5, 0.75, 1.0], [0.0, 0.5, 1.0], "avg(p_f)", "avg(p_i)"))
def _points(t):
    return rounded(cal.reference_points_2d(pairs(t), [25, 50, 75], [50], "y"))


@query("reference_points_2d_median", "WITH " + _points_sql([0.0, 0.3, 0.7, 1.0], [0.0, 0.5, 1.0], "median(p_f)", "median(p_i)"))
def _points_median(t):
    return rounded(cal.reference_points_2d(pairs(t), [30, 70], [50], "y", centering="median"))


@query("factor_loss_terms", f"""WITH {PREDS_SQL}, m AS (SELECT avg(p_f) AS mean, min(p_f) AS fmin, max(p_f) AS fmax, max(p_i) AS imax, min(y_proba) AS pmin, max(y_proba) AS pmax FROM preds),
  x AS (SELECT avg(-(y_true*ln(y_proba) + (1 - y_true)*ln(1 - y_proba))) AS logl, max(pow(mean - 0.1, 2)) AS pullmean, max(mean) AS pulldown, avg(pow((1 - (p_f - mean))*(p_f - 0.1), 2)) AS pullcenter,
    max(fmin*fmin) AS pullmin, max(pow(fmax - 1, 2)) AS pullmax, avg(pow(p_f - (y_proba - pmin + 1e-14)/(pmax - pmin + 1e-14), 2)) AS pullpf, max(fmin - 0.001) AS pullbymin, max(pow(imax - 1, 2)) AS stretchqi,
    avg(p_f - 1/(1 + exp(-(ln(p_f) - ln(1 - p_f) - 0.1*(mean - 0.1))))) AS pullsigmoid, max(mean) AS pull FROM preds, m)
  SELECT {', '.join(f'round({c}, 6) AS {c}' for c in ('logl', 'pullmean', 'pulldown', 'pullcenter', 'pullmin', 'pullmax', 'pullpf', 'pullbymin', 'stretchqi', 'pullsigmoid', 'pull'))},
  round(logl + 2*pullmean + 0.5*pull, 6) AS total FROM x""")
def _loss_terms(t):
    return rounded(cal.factor_loss_terms(pairs(t), weights={"pullmean": 2.0, "pull": 0.5}))
