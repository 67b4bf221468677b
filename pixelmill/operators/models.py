"""Models fitted by Spark's own estimators, and scores with given parameters."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.functions import scalars as s
from pixelmill.operators import ranks, sampling
from pixelmill.operators.calibration import apply_factor_calibration, isotonic_knots, piecewise_linear


def _vectors(df: DataFrame, cols: Sequence[str], out: str = "_features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


def ridge_scores(train: DataFrame, query: DataFrame, cols: Sequence[str], y: str, alpha: float = 1.0,
                 max_proba: float | None = None, threshold: float = 0.5) -> DataFrame:
    """Ridge regression on 0/1 labels, held in [0, 1]; optionally rescaled so that the largest training score
    is ``max_proba``."""
    from pyspark.ml.regression import LinearRegression

    n, spread = train.agg(F.count(F.lit(1)), F.stddev_pop(y)).head()
    # the estimator divides its penalty by the deviation of the label
    model = LinearRegression(featuresCol="_features", labelCol=y, elasticNetParam=0.0, regParam=alpha / n * spread, standardization=False,
                             solver="normal", predictionCol="_p").fit(_vectors(train, cols))
    score = s.linear([F.col(c) for c in cols], [float(w) for w in model.coefficients], float(model.intercept))
    out = query.withColumn("proba", score)
    if max_proba is not None:
        top = train.agg(F.max(score)).scalar()
        out = out.withColumn("proba", F.col("proba") / top * max_proba)
    return out.withColumn("proba", s.clamp(F.col("proba"))).withColumn("label_hat", (F.col("proba") >= threshold).cast("int"))


KERNEL_BLOCK, QUERY_BLOCK = 1024, 512


def log_kernel_sums(q: np.ndarray, points: np.ndarray, member: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Log of the sums of Gaussian kernels per query row and class; ``member`` is the class of each kernel, ``width`` the bandwidth of each class.

    Blocks of kernels are taken one after the other against a running largest exponent, so the temporaries are of block size whatever the
    number of kernels, and squared distances come from one product per block."""
    n_classes = len(width)
    top = np.full((len(q), n_classes), -np.inf)
    total = np.zeros((len(q), n_classes))
    squares = (q * q).sum(axis=1)
    for start in range(0, len(points), KERNEL_BLOCK):
        part, own = points[start:start + KERNEL_BLOCK], member[start:start + KERNEL_BLOCK]
        distance = np.maximum(squares[:, None] + (part * part).sum(axis=1) - 2 * q @ part.T, 0)
        log_k = -distance / (2 * width[own] ** 2) - q.shape[1] * np.log(width[own])
        for c in np.unique(own):
            here = log_k[:, own == c]
            new = np.maximum(top[:, c], here.max(axis=1))
            total[:, c] = total[:, c] * np.exp(top[:, c] - new) + np.exp(here - new[:, None]).sum(axis=1)
            top[:, c] = new
    return top + np.log(total)


def kde_class_scores(train: DataFrame, query: DataFrame, cols: Sequence[str], y: str, key: str, bandwidth: float | Mapping[object, float],
                     max_per_class: int, seed: int = 0, out: str = "posterior") -> DataFrame:
    """Posterior of each class from Gaussian kernels around at most ``max_per_class`` training rows a class, with one bandwidth or one per class.

    The capped training set, whose size the parameters bound, goes to the tasks as numpy arrays; no pair of rows is ever written out. Adds a map
    class -> posterior.
    """
    capped = sampling.exact_random_subset(train, [key], max_per_class, seed, [y]).select(y, *cols)
    rows = sorted(tuple(r) for r in capped.collect())  # max_per_class rows per class
    classes = sorted({r[0] for r in rows})
    shared = query.sparkSession.sparkContext.broadcast((
        np.array([r[1:] for r in rows], dtype=float), np.array([classes.index(r[0]) for r in rows]),
        np.array([float(bandwidth[c]) if isinstance(bandwidth, Mapping) else float(bandwidth) for c in classes])))
    names = [str(c) for c in classes]

    @F.pandas_udf("array<double>")
    def posterior(*xs: pd.Series) -> pd.Series:
        q = np.column_stack([x.to_numpy(dtype=float) for x in xs])
        result = []
        for start in range(0, len(q), QUERY_BLOCK):
            logs = log_kernel_sums(q[start:start + QUERY_BLOCK], *shared.value)
            k = np.exp(logs - logs.max(axis=1, keepdims=True))
            result.extend((k / k.sum(axis=1, keepdims=True)).tolist())
        return pd.Series(result)

    found = query.withColumn("_k", posterior(*[F.col(c) for c in cols]))
    return found.withColumn(out, F.map_from_arrays(F.array(*[F.lit(n) for n in names]), "_k")).drop("_k")


def cluster(df: DataFrame, cols: Sequence[str], k: int, seed: int = 1, out: str = "cluster") -> DataFrame:
    """Gaussian mixture assignment."""
    from pyspark.ml.clustering import GaussianMixture

    data = _vectors(df, cols)
    model = GaussianMixture(featuresCol="_features", k=k, seed=seed, predictionCol=out, probabilityCol="_prob").fit(data)
    return model.transform(data).drop("_features", "_prob")


def cluster_components(df: DataFrame, cols: Sequence[str], k: int, seed: int = 1) -> DataFrame:
    """Weight, means and covariances of each mixture component."""
    from pyspark.ml.clustering import GaussianMixture

    model = GaussianMixture(featuresCol="_features", k=k, seed=seed).fit(_vectors(df, cols))
    g = model.gaussiansDF.select(F.monotonically_increasing_id().cast("int").alias("component"), vector_to_array("mean").alias("mean"), "cov")
    rows = [(r["component"], float(model.weights[r["component"]]), list(r["mean"]), [float(x) for x in r["cov"].toArray().ravel()]) for r in g.collect()]
    return df.sparkSession.createDataFrame(rows, "component int, weight double, mean array<double>, cov array<double>")


def cluster_sweep(df: DataFrame, cols: Sequence[str], ks: Sequence[int] = range(2, 25), repeats: int = 5) -> DataFrame:
    """Log-likelihood per number of components and repeat; each fit is one distributed job."""
    from pyspark.ml.clustering import GaussianMixture

    data = _vectors(df, cols).select("_features").persist()
    try:
        rows = [(k, r, float(GaussianMixture(featuresCol="_features", k=k, seed=r).fit(data).summary.logLikelihood)) for k in ks for r in range(repeats)]
    finally:
        data.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, repeat int, log_likelihood double")


class Calibrated:
    """Mean over folds of a model fitted outside the fold and calibrated on the fold."""

    def __init__(self, parts: list[tuple[object, Callable[[Column], Column]]], features: str):
        self.parts, self.features = parts, features

    def transform(self, df: DataFrame, out: str = "proba") -> DataFrame:
        cols = df.columns
        for k, (model, _) in enumerate(self.parts):
            df = model.transform(df.select(*cols, *[f"_s{j}" for j in range(k)])).withColumn(f"_s{k}", vector_to_array("probability")[1])
        mean = sum([f(F.col(f"_s{k}")) for k, (_, f) in enumerate(self.parts)], F.lit(0.0)) / len(self.parts)
        return df.select(*[c for c in cols if c != self.features], mean.alias(out))


def calibrated(estimator, df: DataFrame, cols: Sequence[str], y: str, key: Sequence[str], method: str = "sigmoid", folds: int = 3, seed: int = 0) -> Calibrated:
    """Cross-fitted calibration by a logistic or a monotone curve. Folds come from the key hash."""
    from pyspark.ml.classification import LogisticRegression

    data = _vectors(df, cols).withColumn("_fold", ranks.key_hash([F.col(c) for c in key], seed) % folds).persist()
    parts = []
    try:
        for k in range(folds):
            model = estimator.fit(data.filter(F.col("_fold") != k))
            held = model.transform(data.filter(F.col("_fold") == k)).select(F.col(y).cast("double").alias("_y"), vector_to_array("probability")[1].alias("_s"))
            if method == "isotonic":
                knots = isotonic_knots(held, "_s", "_y")
                parts.append((model, lambda x, knots=knots: piecewise_linear(x, knots, clip=True)))
            else:
                curve = LogisticRegression(featuresCol="_c", labelCol="_y").fit(_vectors(held, ["_s"], "_c"))
                a, b = float(curve.coefficients[0]), float(curve.intercept)
                parts.append((model, lambda x, a=a, b=b: s.sigmoid(a * x + b)))
    finally:
        data.unpersist()
    return Calibrated(parts, "_features")


def calibrated_variants(estimators: Mapping[str, object], df: DataFrame, cols: Sequence[str], y: str, key: Sequence[str], folds: int = 3) -> dict[str, object]:
    """Each model as it is, and with the suffixes _iso and _sig calibrated."""
    out: dict[str, object] = {}
    for name, est in estimators.items():
        out[name] = est.fit(_vectors(df, cols))
        out[name + "_iso"] = calibrated(est, df, cols, y, key, "isotonic", folds)
        out[name + "_sig"] = calibrated(est, df, cols, y, key, "sigmoid", folds)
    return out


def transform_subsets(df: DataFrame, parts: Sequence[tuple[str, object, Sequence[str], bool]], passthrough: Sequence[str] = ()) -> DataFrame:
    """Apply a transformer per column subset: (name, transformer, columns, keep names).

    A transformer is "standard" (population deviation), "pass", or an estimator or transformer of pyspark.ml
    with inputCol and outputCol. New names are ``{name}_{i}``.
    """
    outputs: list[Column] = [F.col(c) for c in passthrough]
    work = df
    for name, tf, cols, keep in parts:
        names = list(cols) if keep else [f"{name}_{k}" for k in range(len(cols))]
        if tf == "pass":
            outputs += [F.col(c).alias(n) for c, n in zip(cols, names)]
        elif tf == "standard":
            m = df.agg(F.struct(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(cols)], *[F.stddev_pop(c).alias(f"d{k}") for k, c in enumerate(cols)])).scalar()
            work = work.withColumn(f"_{name}", m)
            outputs += [((F.col(c) - F.col(f"_{name}.m{k}")) / F.col(f"_{name}.d{k}")).alias(n) for k, (c, n) in enumerate(zip(cols, names))]
        else:
            vec, res = f"_v_{name}", f"_o_{name}"
            t = tf.copy({tf.inputCol: vec, tf.outputCol: res})
            work = _vectors(work, cols, vec)
            work = (t.fit(work) if hasattr(t, "fit") else t).transform(work)
            width = len(work.select(res).head()[0]) if not keep else len(cols)
            names = list(cols) if keep else [f"{name}_{k}" for k in range(width)]
            outputs += [vector_to_array(res)[k].alias(n) for k, n in enumerate(names)]
    return work.select(*outputs)


def predict_all(df: DataFrame, x_f: Sequence[str], w_f: Sequence[float], b_f: float, x_i: Sequence[str], w_i: Sequence[float], b_i: float,
                parts: Sequence[tuple[str, object, Sequence[str], bool]] = (), keep: Sequence[str] = (),
                knots: Sequence[tuple[float, float]] | None = None) -> DataFrame:
    """Transform, score both factors, calibrate. Label and class probabilities are those before calibration."""
    t = transform_subsets(df, parts, keep) if parts else df
    p = s.score_product([F.col(c) for c in x_f], w_f, b_f, [F.col(c) for c in x_i], w_i, b_i)
    out = t.select(*keep, p["p_f"].alias("qf"), p["p_i"].alias("qi")).withColumn("proba_1", F.col("qf") * F.col("qi")) \
        .withColumns({"proba_0": 1 - F.col("proba_1"), "label": (F.col("proba_1") > 0.5).cast("int")})
    if knots is None:
        return out.withColumns({"p_f": F.col("qf"), "p_i": F.col("qi"), "py": F.col("proba_1")}).drop("qf", "qi")
    return apply_factor_calibration(out, knots).drop("qf", "qi", "clamped")
