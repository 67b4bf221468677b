"""Reliability, calibration errors and scores over the prediction lenses."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelmill.operators import reliability as rel
from pixelmill.operators import scores as sc
from pixelmill.operators import tables as tb
from pixelmill.plans.lenses import POINTS_SQL, PREDS_SQL, RUNS_SQL
from pixelmill.plans.registry import query


def rounded(df, keep=()):
    return df.select(*[F.col(c) if c in keep or t in ("int", "bigint", "string", "boolean", "date") else F.round(c, 6).alias(c)
                       for c, t in df.dtypes])


def uniform_sql(lo, hi, n):
    return "[" + ", ".join(f"{k}*(({hi} - {lo})/{n}.0) + {lo}" for k in range(n)) + f", {hi}]::DOUBLE[]"


def bins_sql(source, keys, sets, y="y_true", p="y_proba"):
    """CTEs: b = rows per bin, rel = reliability table. ``sets`` gives keys, st, e."""
    k = "".join(f"{c}, " for c in keys)
    on = " AND ".join([f"s.{c}=x.{c}" for c in keys]) or "true"
    return f"""sets AS ({sets}), b AS (SELECT {''.join(f'x.{c}, ' for c in keys)}st, len(list_filter(e[2:len(e)-1], lambda z: z < {p})) AS bin, {p} AS p, {y} AS y
      FROM {source} x JOIN sets s ON {on} WHERE {p} >= e[1] AND {p} <= e[len(e)]),
    g AS (SELECT {k}st, bin, avg(p) AS y_proba_mean, avg(y) AS y_true_mean, count(*) AS n_samples, sum(y)::BIGINT AS n_pos FROM b GROUP BY ALL),
    f AS (SELECT {k}st, unnest(range(0, len(e) - 1)) AS bin, e FROM sets),
    rel AS (SELECT {''.join(f'f.{c}, ' for c in keys)}f.st, CAST(f.bin AS INT) AS bin, e[f.bin + 1] AS lo, e[f.bin + 2] AS hi, y_proba_mean, y_true_mean,
      coalesce(n_samples, 0) AS n_samples, coalesce(n_pos, 0) AS n_pos,
      coalesce(n_samples, 0)/sum(n_samples) OVER (PARTITION BY {k}f.st) AS support FROM f LEFT JOIN g ON g.bin=f.bin AND g.st=f.st
      {''.join(f' AND g.{c}=f.{c}' for c in keys)})""".replace(f"PARTITION BY {k}f.st", "PARTITION BY " + "".join(f"f.{c}, " for c in keys) + "f.st")


REL_COLS = "bin, round(lo, 6) AS lo, round(hi, 6) AS hi, round(y_proba_mean, 6) AS y_proba_mean, round(y_true_mean, 6) AS y_true_mean, n_samples, n_pos, round(support, 6) AS support"


@query("reliability_uniform", f"WITH {PREDS_SQL}, {bins_sql('preds', [], 'SELECT 1 AS st, ' + uniform_sql('0.0', '1.0', 12) + ' AS e')} SELECT {REL_COLS} FROM rel")
def _rel_uniform(t):
    return rounded(rel.reliability(t.preds, n_bins=12))


def quantile_sql(source, col, probs, keys=()):
    """Sub-select with keys and q, the linearly interpolated quantiles at exact ranks."""
    k = "".join(f"{c}, " for c in keys)
    grp = f"GROUP BY {', '.join(keys)}" if keys else ""

    def at(p):
        r = f"round((len(s) - 1)*{p}::DOUBLE, 9)"
        lo, hi = f"s[CAST(floor({r}) AS BIGINT) + 1]", f"s[CAST(ceil({r}) AS BIGINT) + 1]"
        return f"{lo} + ({hi} - {lo})*({r} - floor({r}))"

    return f"(SELECT {k}[{', '.join(at(p) for p in probs)}] AS q FROM (SELECT {k}list_sort(list({col})) AS s FROM {source} {grp}))"


@query("reliability_quantile", f"""WITH {PREDS_SQL}, {bins_sql('preds', [], 'SELECT 1 AS st, list_sort(list_distinct(q)) AS e FROM ' + quantile_sql("preds", "y_proba", [j / 10 for j in range(11)]))}
  SELECT {REL_COLS} FROM rel""")
def _rel_quantile(t):
    return rounded(rel.reliability(t.preds, mode="quantile"))


@query("reliability_adjusted", f"""WITH {PREDS_SQL}, {bins_sql('preds', [], 'SELECT 1 AS st, [0.0, 0.1, 0.25, 0.5, 1.0]::DOUBLE[] AS e')},
  a AS (SELECT *, y_true_mean/(1 - y_true_mean)*0.05 AS o, n_pos + (n_samples - n_pos)/0.05 AS na FROM rel)
  SELECT {REL_COLS}, round(o/(o + 1), 6) AS y_true_mean_adj, round(na/sum(na) OVER (), 6) AS support_adj FROM a""")
def _rel_adjusted(t):
    return rounded(rel.reliability(t.preds, edges=[0, 0.1, 0.25, 0.5, 1], knr=0.05))


ERR_SQL = """round(sum(support*abs(y_true_mean - y_proba_mean)), 6) AS eace, round(sum(support*abs(y_true_mean - y_proba_mean)/y_true_mean), 6) AS erce,
  round(avg(abs(y_true_mean - y_proba_mean)), 6) AS aace, round(avg(abs(y_true_mean - y_proba_mean)/y_true_mean), 6) AS arce,
  round(max(abs(y_true_mean - y_proba_mean)), 6) AS mace, round(max(abs(y_true_mean - y_proba_mean)/y_true_mean), 6) AS mrce"""


@query("calibration_error", f"WITH {PREDS_SQL}, {bins_sql('preds', [], 'SELECT 1 AS st, ' + uniform_sql('0.0', '1.0', 10) + ' AS e')} SELECT {ERR_SQL} FROM rel")
def _cal_error(t):
    return rounded(rel.calibration_errors(rel.reliability(t.preds)))


def suite_sets(source, keys):
    k = "".join(f"{c}, " for c in keys)
    q = quantile_sql(source, "y_proba", [j / 10 for j in range(11)] + [0.9, 0.95], keys)
    return " UNION ALL ".join([
        f"SELECT {k}'q' AS st, list_sort(list_distinct(q[1:11])) AS e FROM {q}", f"SELECT {k}'u90', {uniform_sql('0.0', 'q[12]', 10)} FROM {q}",
        f"SELECT {k}'u95', {uniform_sql('0.0', 'q[13]', 10)} FROM {q}", f"SELECT {k}'umm', {uniform_sql('q[1]', 'q[11]', 10)} FROM {q}"])


def suite_sql(keys):
    k = "".join(f"{c}, " for c in keys)
    cols = ", ".join(f"max(CASE WHEN st = '{st}' THEN {e} END) AS {e}_{st}" for st in rel.SETS for e in rel.ERRORS)
    return f"err AS (SELECT {k}st, {ERR_SQL} FROM rel GROUP BY ALL), suite AS (SELECT {k}{cols} FROM err {'GROUP BY ' + ', '.join(keys) if keys else ''})"


@query("calibration_suite", f"WITH {PREDS_SQL}, {bins_sql('preds', [], suite_sets('preds', []))}, {suite_sql([])} SELECT * FROM suite")
def _suite(t):
    return rounded(rel.calibration_suite(t.preds))


def confusion_sql(source, keys):
    k = "".join(f"{c}, " for c in keys)
    return f"""cf AS (SELECT {k}sum((y_true = 1 AND y_proba > 0.5)::INT)::BIGINT AS tp, sum((y_true = 0 AND y_proba <= 0.5)::INT)::BIGINT AS tn,
      sum((y_true = 0 AND y_proba > 0.5)::INT)::BIGINT AS fp, sum((y_true = 1 AND y_proba <= 0.5)::INT)::BIGINT AS fn FROM {source} {'GROUP BY ' + ', '.join(keys) if keys else ''}),
    conf AS (SELECT {k}round((tp + tn)/n, 6) AS acc, round(coalesce(tp/nullif(tp + fn, 0), 0) + coalesce(tn/nullif(tn + fp, 0), 0) - 1, 6) AS accba,
      round(1 - (tp + tn)/n, 6) AS zol, round(coalesce((tp*tn - fp*fn)/nullif(sqrt(tp + fp)*sqrt(tp + fn)*sqrt(tn + fp)*sqrt(tn + fn), 0), 0), 6) AS mcc,
      round(coalesce(((tp + tn)/n - pe)/nullif(1 - pe, 0), 0), 6) AS kpa, round(coalesce(2*tp/nullif(2*tp + fp + fn, 0), 0), 6) AS f1,
      round(coalesce(tp/nullif(tp + fn, 0), 0), 6) AS rcl, round(coalesce(tp/nullif(tp + fp, 0), 0), 6) AS prc, tp, tn, fp, fn
      FROM (SELECT *, (tp + tn + fp + fn)::DOUBLE AS n, ((tp + fp)::DOUBLE*(tp + fn) + (tn + fn)::DOUBLE*(tn + fp))/((tp + tn + fp + fn)::DOUBLE*(tp + tn + fp + fn)) AS pe FROM cf))"""


@query("confusion_scores", f"WITH {PREDS_SQL}, {confusion_sql('preds', [])} SELECT * FROM conf")
def _confusion(t):
    return rounded(sc.confusion_scores(t.preds))


def ranking_sql(source, keys):
    k = "".join(f"{c}, " for c in keys)
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    grp = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""h AS (SELECT {k}y_proba AS p, count(*) AS n, sum(y_true) AS pos FROM {source} GROUP BY ALL),
      c AS (SELECT *, sum(n) OVER w AS above, sum(pos) OVER w AS tp FROM h WINDOW w AS ({part} ORDER BY p DESC)),
      rk AS (SELECT {k}round(1 - sum(pos*((above - tp) - (n - pos)/2))/(sum(pos)*sum(n - pos)), 6) AS auroc,
        round(sum(pos*tp/above)/sum(pos), 6) AS avp FROM c {grp})"""


@query("auroc", f"WITH {PREDS_SQL}, {ranking_sql('preds', [])} SELECT auroc FROM rk")
def _auroc(t):
    return rounded(sc.auroc(t.preds))


@query("average_precision", f"WITH {PREDS_SQL}, {ranking_sql('preds', [])} SELECT avp FROM rk")
def _avp(t):
    return rounded(sc.average_precision(t.preds))


@query("pr_curve", f"""WITH {PREDS_SQL}, {ranking_sql('preds', [])} SELECT round(p, 9) AS threshold, round(tp/above, 6) AS precision,
  round(tp/(SELECT sum(y_true) FROM preds), 6) AS recall, above::BIGINT AS n_above FROM c""")
def _pr(t):
    out = sc.pr_curve(t.preds)
    return out.withColumns({"threshold": F.round("threshold", 9), "precision": F.round("precision", 6), "recall": F.round("recall", 6)})


@query("precision_threshold_corr", f"""WITH {PREDS_SQL}, {ranking_sql('preds', [])} SELECT round(corr(p, tp/above), 6) AS corr FROM c
  WHERE p < (SELECT max(p) FROM c WHERE above >= 200)""")
def _ptc(t):
    return rounded(sc.precision_threshold_corr(t.preds, min_samples=200))


@query("precision_series", f"""WITH s AS (SELECT o_totalprice AS score, (o_orderstatus = 'F')::INT AS y, o_orderkey AS id FROM orders),
  r AS (SELECT *, row_number() OVER w AS rank, sum(y) OVER w AS hits, count(*) OVER () AS n FROM s WINDOW w AS (ORDER BY score DESC, id))
  SELECT rank, score AS threshold, round(hits/rank, 6) AS precision FROM r WHERE (rank > 1 AND (rank - 1) % 100 = 0) OR rank = n""")
def _series(t):
    o = t.orders.select(F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.col("o_orderkey").alias("id"))
    return sc.precision_series(o, "y", "score", ["id"], 100).withColumn("precision", F.round("precision", 6))


def losses_sql(source, keys):
    k = "".join(f"{c}, " for c in keys)
    return f"""lo AS (SELECT {k}round(-avg(CASE WHEN y_true = 1 THEN ln(y_proba) ELSE ln(1 - y_proba) END), 6) AS logl, round(avg(pow(y_proba - y_true, 2)), 6) AS bssl
      FROM {source} {'GROUP BY ' + ', '.join(keys) if keys else ''})"""


@query("log_loss", f"""WITH {PREDS_SQL}, {losses_sql('preds', [])} SELECT *, (SELECT round(-avg(CASE WHEN y_true = 1 THEN 3*ln(y_proba) ELSE 0.5*ln(1 - y_proba) END), 6) FROM preds) AS wlogl FROM lo""")
def _loss(t):
    return rounded(sc.log_loss(t.preds, class_weight=(0.5, 3.0)))


def stats_sql(source, keys):
    k = "".join(f"{c}, " for c in keys)
    return f"""st AS (SELECT {k}count(*) AS n_total, sum(y_true)::BIGINT AS n_true, round(avg(y_true), 6) AS r_true, round(avg((y_proba > 0.5)::INT), 6) AS y_pred_mean,
      round(min(y_proba), 6) AS y_proba_min, round(max(y_proba), 6) AS y_proba_max, round(avg(y_proba), 6) AS y_proba_mean, round(stddev_pop(y_proba), 6) AS y_proba_std
      FROM {source} {'GROUP BY ' + ', '.join(keys) if keys else ''})"""


@query("prediction_stats", f"WITH {PREDS_SQL}, {stats_sql('preds', [])} SELECT * FROM st")
def _stats(t):
    return rounded(sc.prediction_stats(t.preds))


_RK = ["model", "trial", "split"]


@query("score_runs", f"""WITH {RUNS_SQL}, {bins_sql('runs', _RK, suite_sets('runs', _RK))}, {suite_sql(_RK)}, {confusion_sql('runs', _RK)}, {ranking_sql('runs', _RK)},
  {losses_sql('runs', _RK)}, {stats_sql('runs', _RK)} SELECT * FROM conf JOIN rk USING (model, trial, split) JOIN lo USING (model, trial, split)
  JOIN st USING (model, trial, split) JOIN suite USING (model, trial, split)""")
def _score_runs(t):
    return rounded(sc.score_runs(t.runs, _RK))


_RANK = """r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1)/2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1)/2.0 AS rb FROM s)"""


@query("regression_scores", f"""WITH s AS (SELECT l_quantity/51.0 AS a, (l_discount + 0.01)/0.12 AS b FROM lineitem), {_RANK}
  SELECT round(avg(abs(b - a)), 6) AS mae, round(avg(pow(b - a, 2)), 6) AS mse, round(sqrt(avg(pow(b - a, 2))), 6) AS rmse,
  round(avg(pow((b - a)/greatest(a, 0.05), 2)), 6) AS msre, round(sqrt(avg(pow((b - a)/greatest(a, 0.05), 2))), 6) AS rmsre, round(corr(a, b), 6) AS pcor,
  round(max(abs(b - a)), 6) AS maxae, round(avg(b - a), 6) AS bias, (SELECT round(corr(ra, rb), 6) FROM r) AS scor FROM s""")
def _regression(t):
    return rounded(sc.regression_scores(t.preds, "p_f", "p_i", 0.05))


_COND = """round(avg(y), 6) AS p_y, round(avg(CASE WHEN nf > 0 THEN y END), 6) AS p_y_nf, round(avg(CASE WHEN NOT nf > 0 THEN y END), 6) AS p_y_not_nf, round(avg((nf > 0)::INT), 6) AS p_nf"""


@query("conditional_rates", f"""WITH {POINTS_SQL} SELECT 'a' AS id, {_COND} FROM (SELECT fire::INT AS y, CASE WHEN j < 5 THEN 1 ELSE 0 END AS nf FROM points)
  UNION ALL SELECT 'b', {_COND} FROM (SELECT (l_returnflag = 'R')::INT AS y, (l_tax > 0.03)::INT AS nf FROM lineitem)""")
def _conditional(t):
    a = t.points.select(F.col("fire").cast("int").alias("y"), (F.col("j") < 5).cast("int").alias("nf"))
    b = t.lineitem.select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_tax") > 0.03).cast("int").alias("nf"))
    return rounded(sc.compare_conditional_rates({"a": a, "b": b}, "y", "nf"))


@query("cluster_profile", """WITH s AS (SELECT l_linenumber AS cluster, (l_returnflag = 'R')::INT AS y, (l_tax > 0.03)::INT AS nf, l_quantity/50 AS x0, l_discount AS x1, l_extendedprice/100000 AS x2 FROM lineitem),
  a AS (SELECT cluster, count(*) AS n, avg(y) AS py, avg(CASE WHEN nf > 0 THEN y END) AS py_nf, avg(CASE WHEN nf = 0 THEN y END) AS py_not_nf, avg(x0) AS mu0, avg(x1) AS mu1,
    var_pop(x0) AS var0, var_pop(x1) AS var1, var_pop(x2) AS var2, covar_pop(x0, x1) AS var01, covar_pop(x1, x2)*2 AS var12, count(*)/(SELECT count(*) FROM s) AS n_samples_factor FROM s GROUP BY 1),
  b AS (SELECT *, 1/(1 + exp(-(mu0 - mu1))) AS pf FROM a), c AS (SELECT *, py_not_nf/pf*0.9 + 1e-8 AS pi FROM b WHERE n >= 500)
  SELECT cluster, n, round(py, 6) AS py, round(py_nf, 6) AS py_nf, round(py_not_nf, 6) AS py_not_nf, round(mu0, 6) AS mu0, round(mu1, 6) AS mu1, round(var0, 6) AS var0, round(var1, 6) AS var1,
  round(var2, 6) AS var2, round(var01, 6) AS var01, round(var12, 6) AS var12, round(n_samples_factor, 6) AS n_samples_factor, round(ln(pi) - ln(1 - pi), 6) AS mu2,
  round(least((py_not_nf - py_nf)/(py_not_nf - pf)*0.5, 1.0), 6) AS p_spread FROM c""")
def _profile(t):
    s = t.lineitem.select(F.col("l_linenumber").alias("cluster"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_tax") > 0.03).cast("int").alias("nf"),
                          (F.col("l_quantity") / 50).alias("x0"), F.col("l_discount").alias("x1"), (F.col("l_extendedprice") / 100000).alias("x2"))
    return rounded(sc.cluster_profile(s, "cluster", "y", "nf", ps_scaling=0.5, pi_scaling=0.9, var12_scaling=2.0))


@query("ensemble_mean_std", """SELECT l_orderkey AS id, round(avg(l_quantity), 6) AS q_mean, round(stddev_pop(l_quantity), 6) AS q_std FROM lineitem GROUP BY 1""")
def _ensemble(t):
    return rounded(sc.ensemble_mean_std(t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("q")), ["id"], ["q"]))


_MEASURES = """m AS (SELECT l_suppkey AS run, avg(l_quantity) AS a, avg(l_discount) AS b, avg(l_extendedprice) AS c FROM lineitem GROUP BY 1)"""
_CORR_ROWS = " UNION ALL ".join(f"SELECT '{a}' AS m1, '{b}' AS m2, round(corr({a}, {b}), 6) AS corr FROM {{src}}" for a in "abc" for b in "abc")


def _long_scores(t):
    wide = t.lineitem.groupBy(F.col("l_suppkey").alias("run")).agg(F.avg("l_quantity").alias("a"), F.avg("l_discount").alias("b"), F.avg("l_extendedprice").alias("c"))
    return tb.scores_long(wide, ["run"], "measure", "value")


@query("score_correlations", f"WITH {_MEASURES} {_CORR_ROWS.format(src='m')}")
def _corrs(t):
    return rounded(sc.score_correlations(_long_scores(t), ["run"], ["a", "b", "c"], sort_by="a"))


@query("score_correlations_spearman", f"""WITH {_MEASURES}, r AS (SELECT {', '.join(f'rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1)/2.0 AS {c}' for c in 'abc')} FROM m)
  {_CORR_ROWS.format(src='r')}""")
def _corrs_s(t):
    # rounding first makes the ranks independent of summation order
    return rounded(sc.score_correlations(_long_scores(t), ["run"], ["a", "b", "c"], "spearman"))


_TAU_ROWS = " UNION ALL ".join(f"""SELECT '{a}' AS m1, '{b}' AS m2, round(sum(sign(i.{a} - j.{a})*sign(i.{b} - j.{b}))/(sqrt(sum(abs(sign(i.{a} - j.{a})))::DOUBLE)*sqrt(sum(abs(sign(i.{b} - j.{b})))::DOUBLE)), 6) AS corr
  FROM m i, m j""" for a in "abc" for b in "abc")


@query("score_correlations_kendall", f"WITH {_MEASURES} {_TAU_ROWS}")
def _corrs_k(t):
    return rounded(sc.score_correlations(_long_scores(t), ["run"], ["a", "b", "c"], "kendall"))


@query("kendall", f"""WITH {PREDS_SQL}, c AS (SELECT y_true AS a, round(y_proba, 2) AS b, count(*) AS w, l_linenumber AS k FROM preds GROUP BY ALL)
  SELECT i.k, round(sum(i.w*j.w*sign(i.a - j.a)*sign(i.b - j.b))/(sqrt(sum(i.w*j.w*abs(sign(i.a - j.a)))::DOUBLE)*sqrt(sum(i.w*j.w*abs(sign(i.b - j.b)))::DOUBLE)), 6) AS corr
  FROM c i JOIN c j ON i.k = j.k GROUP BY 1""")
def _kendall(t):
    """Of all predictions of a line number, which have many ties."""
    rows = t.preds.select(F.col("l_linenumber").alias("k"), "y_true", F.round("y_proba", 2).alias("p"))
    return rounded(sc.kendall(rows, "y_true", "p", ["k"]))


@query("rank_measures", f"WITH {_MEASURES}, x AS ({_CORR_ROWS.format(src='m')}) SELECT m1, corr FROM x WHERE m2 = 'c'")
def _rank_measures(t):
    return sc.rank_measures(rounded(sc.score_correlations(_long_scores(t), ["run"], ["a", "b", "c"])), "c")


@query("class_histogram", f"""WITH {PREDS_SQL}, e AS (SELECT {uniform_sql('0.0', '1.0', 15)} AS e), b AS (SELECT CAST(len(list_filter(e[2:15], lambda z: z < p_f)) AS INT) AS bin, y_true, count(*) AS n FROM preds, e GROUP BY ALL)
  SELECT bin, y_true, n, round(n/max(n) OVER (), 6) AS height, round(bin/15.0 + 1/30.0, 6) AS mid FROM b""")
def _histogram(t):
    return rounded(rel.class_histogram(t.preds, "p_f", "y_true", 15, (0.0, 1.0)))


@query("class_means", f"WITH {PREDS_SQL} SELECT y_true, round(avg(p_f), 6) AS mean FROM preds GROUP BY 1")
def _class_means(t):
    return rounded(rel.class_means(t.preds, "p_f", "y_true"))


@query("proba_histogram", f"""WITH {PREDS_SQL}, l AS (SELECT 'p_f' AS "column", p_f AS p FROM preds UNION ALL SELECT 'p_i', p_i FROM preds UNION ALL SELECT 'y_proba', y_proba FROM preds),
  b AS (SELECT "column", CAST(greatest(ceil(p*20 - 1e-9), 1) - 1 AS INT) AS bin, count(*) AS n FROM l WHERE p BETWEEN 0 AND 1 GROUP BY ALL)
  SELECT "column", bin, n, round(n/sum(n) OVER (PARTITION BY "column"), 6) AS share, round(bin/20.0 + 0.025, 6) AS mid FROM b"""
       .replace("CAST(greatest(ceil(p*20 - 1e-9), 1) - 1 AS INT)", "CAST(len(list_filter([" + ", ".join(f"{k}*(1.0::DOUBLE/20)" for k in range(1, 20)) + "], lambda z: z < p)) AS INT)"))
def _proba_histogram(t):
    return rounded(rel.proba_histogram(t.preds, ["p_f", "p_i", "y_proba"]))


@query("column_stats", f"""WITH {PREDS_SQL}, l AS (SELECT 'p_f' AS "column", p_f AS p FROM preds UNION ALL SELECT 'p_i', p_i FROM preds)
  SELECT "column", round(min(p), 6) AS min, round(avg(p), 6) AS mean, round(max(p), 6) AS max, round(median(p), 6) AS median FROM l GROUP BY 1""")
def _column_stats(t):
    return rounded(tb.column_stats(t.preds, ["p_f", "p_i"]))


@query("quartile_summary", """WITH q AS (SELECT event_type, quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM events GROUP BY 1)
  SELECT event_type, round(q[1], 6) AS q1, round(q[2], 6) AS median, round(q[3], 6) AS q3, round(q[3] - q[1], 6) AS iqr, round(q[1] - 1.5*(q[3] - q[1]), 6) AS whisker_lo,
  round(q[3] + 1.5*(q[3] - q[1]), 6) AS whisker_hi FROM q""")
def _quartiles(t):
    return rounded(tb.quartile_summary(t.events, "value", ["event_type"]))


_GRID_PROBS = (0.0, 0.1, 0.5, 0.99, 1.0)


@query("quantiles_grid", f"""WITH u AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
  SELECT label, {', '.join(f'round(quantile_cont(x, {q}), 6) AS q{k}' for k, q in enumerate(_GRID_PROBS))} FROM u GROUP BY 1""")
def _quantiles(t):
    """Of all values of the vectors of a label."""
    from pixelmill.operators import ranks

    values = t.embeddings.select("label", F.explode("embedding").alias("x")).withColumn("x", F.col("x").cast("double"))
    out = ranks.quantiles(values, "x", list(_GRID_PROBS), ["label"])
    return out.select("label", *[F.round(F.col("q")[k], 6).alias(f"q{k}") for k in range(5)])
