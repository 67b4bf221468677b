"""Models over the embedding vectors and the samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelmill.operators import models as md
from pixelmill.plans.check_sampling import h
from pixelmill.plans.check_scores import rounded
from pixelmill.plans.lenses import VALUES, VECTORS_SQL
from pixelmill.plans.registry import query

SUM_SQL = " + ".join(f"{k % 5 - 2}*{x}" for k, x in enumerate(VALUES))


def binary(t):
    return t.vectors.withColumn("y", (F.col("label") % 2).cast("double"))


@query("ridge_scores", f"""WITH {VECTORS_SQL}, s AS (SELECT vec_id, {SUM_SQL} AS x, (label % 2)::DOUBLE AS y FROM vectors),
  f AS (SELECT covar_pop(x, y)*count(*)/(var_pop(x)*count(*) + 2.0) AS w, avg(y) AS my, avg(x) AS mx FROM s), p AS (SELECT vec_id, my - w*mx + w*x AS p FROM s, f)
  SELECT vec_id, round(greatest(0.0, least(1.0, p/(SELECT max(p) FROM p)*0.8)), 6) AS proba, (p/(SELECT max(p) FROM p)*0.8 >= 0.5)::INT AS label_hat FROM p""")
def _ridge(t):
    """One column, a weighted sum of all values, so that the weight has a closed form; tests fit many."""
    d = binary(t).withColumn("x", sum(((k % 5 - 2) * F.col(x) for k, x in enumerate(VALUES)), F.lit(0.0)))
    return rounded(md.ridge_scores(d, d.select("vec_id", "x"), ["x"], "y", 2.0, 0.8).drop("x"))


@query("kde_class_scores", f"""WITH {VECTORS_SQL}, tr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {h(3, 'vec_id')}, vec_id) AS rn FROM vectors) WHERE rn <= 15),
  k AS (SELECT q.vec_id, t.label, -({' + '.join(f'pow(q.{x} - t.{x}, 2)' for x in VALUES)})/(2*CASE WHEN t.label % 2 = 0 THEN 0.25 ELSE 1 END)
    - 64*ln(CASE WHEN t.label % 2 = 0 THEN 0.5 ELSE 1 END) AS e FROM vectors q, tr t),
  s AS (SELECT vec_id, label, sum(exp(e - m)) AS k FROM (SELECT *, max(e) OVER (PARTITION BY vec_id) AS m FROM k) GROUP BY ALL)
  SELECT vec_id, label AS class, round(k/sum(k) OVER (PARTITION BY vec_id), 6) AS p FROM s""")
def _kde(t):
    """Over all values, with a bandwidth per class."""
    v = t.vectors
    widths = {int(r["label"]): 1.0 if r["label"] % 2 else 0.5 for r in v.select("label").distinct().collect()}
    out = md.kde_class_scores(v, v.select("vec_id", *VALUES), VALUES, "label", "vec_id", widths, 15, 3)
    return out.select("vec_id", F.explode("posterior").alias("class", "p")).select("vec_id", F.col("class").cast("int").alias("class"), F.round("p", 6).alias("p"))


@query("cluster")
def _cluster(t):
    return md.cluster(t.vectors, VALUES, 3).select("vec_id", "cluster")


@query("cluster_components")
def _components(t):
    return md.cluster_components(t.vectors, VALUES, 3)


@query("cluster_sweep")
def _sweep(t):
    return md.cluster_sweep(t.vectors, VALUES, range(2, 5), 1)


@query("calibrated_sigmoid")
def _sigmoid(t):
    from pyspark.ml.classification import LogisticRegression

    d = binary(t)
    model = md.calibrated(LogisticRegression(featuresCol="_features", labelCol="y"), d, VALUES, "y", ["vec_id"], "sigmoid", 3)
    return model.transform(md._vectors(d, VALUES)).select("vec_id", "proba")


@query("calibrated_isotonic")
def _isotonic(t):
    from pyspark.ml.classification import LogisticRegression

    d = binary(t)
    model = md.calibrated(LogisticRegression(featuresCol="_features", labelCol="y"), d, VALUES, "y", ["vec_id"], "isotonic", 3)
    return model.transform(md._vectors(d, VALUES)).select("vec_id", "proba")


STD, MINMAX, RAW = VALUES[:30], VALUES[30:50], VALUES[50:]
STD_SQL = ", ".join(f"avg({x}) AS a_{x}, stddev_pop({x}) AS d_{x}" for x in STD)


@query("transform_subsets", f"""WITH {VECTORS_SQL}, m AS (SELECT {STD_SQL}, {', '.join(f'min({x}) AS l_{x}, max({x}) AS u_{x}' for x in MINMAX)} FROM vectors)
  SELECT vec_id, {', '.join(f'round(({x} - a_{x})/d_{x}, 6) AS std_{k}' for k, x in enumerate(STD))}, {', '.join(f'round(({x} - l_{x})/(u_{x} - l_{x}), 6) AS {x}' for x in MINMAX)},
  {', '.join(f'round({x}, 6) AS raw_{k}' for k, x in enumerate(RAW))} FROM vectors, m""")
def _transform(t):
    from pyspark.ml.feature import MinMaxScaler

    parts = [("std", "standard", STD, False), ("mm", MinMaxScaler(inputCol="a", outputCol="b"), MINMAX, True), ("raw", "pass", RAW, False)]
    return rounded(md.transform_subsets(t.vectors, parts, ["vec_id"]))


W_F, W_I = [(3 * k % 7 - 3) / 4 for k in range(30)], [(5 * k % 7 - 3) / 4 for k in range(34)]


@query("predict_all", f"""WITH {VECTORS_SQL}, m AS (SELECT {STD_SQL} FROM vectors),
  q AS (SELECT vec_id, 1/(1 + exp(-({' + '.join(f'({w})*({x} - a_{x})/d_{x}' for w, x in zip(W_F, STD))} + 0.2))) AS qf,
    1/(1 + exp(-({' + '.join(f'({w})*{x}' for w, x in zip(W_I, MINMAX + RAW))} + 1))) AS qi FROM vectors, m),
  c AS (SELECT *, CASE WHEN qf <= 0.2 THEN 2.5*qf ELSE 0.5 + (qf - 0.2)*0.625 END AS pf FROM q), d AS (SELECT *, least(1.0, qi*qf/pf) AS pi FROM c)
  SELECT vec_id, round(qf*qi, 6) AS proba_1, round(1 - qf*qi, 6) AS proba_0, (qf*qi > 0.5)::INT AS label, round(pf, 6) AS p_f, round(pi, 6) AS p_i, round(pf*pi, 6) AS py FROM d""")
def _predict(t):
    parts = [("f", "standard", STD, False), ("i", "pass", MINMAX + RAW, False)]
    f, i = ([f"{n}_{k}" for k in range(len(w))] for n, w in (("f", W_F), ("i", W_I)))
    return rounded(md.predict_all(t.vectors, f, W_F, 0.2, i, W_I, 1.0, parts, ["vec_id"], [(0.0, 0.0), (0.2, 0.5), (1.0, 1.0)]))
