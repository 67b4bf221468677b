"""Binned reliability of predicted probabilities and the calibration errors built on it.

Everything starts from the counts per distinct (run, score), so rows are shuffled once and equal scores
are merged before that. Bins are right-closed, the lowest edge is included.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.functions import scalars as s
from pixelmill.operators import ranks


def score_counts(preds: DataFrame, y: str = "y_true", p: str = "y_proba", keys: Sequence[str] = ()) -> DataFrame:
    """Rows and positives per distinct score: columns keys, p, n, pos."""
    return preds.filter(F.col(p).isNotNull()).groupBy(*keys, F.col(p).alias("p")) \
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("bigint")).alias("pos"))


def uniform_edges(lo, hi, n: int) -> Column:
    """n+1 evenly spaced edges; the last is hi itself."""
    lo, hi = (c if isinstance(c, Column) else F.lit(float(c)) for c in (lo, hi))
    step = (hi - lo) / n
    return F.array(*[step * k + lo for k in range(n)], hi)


def quantile_edges(q: Column) -> Column:
    return F.array_distinct(q)


def bin_index(x: Column, edges: Column) -> Column:
    """0-based right-closed bin: the number of inner edges below x. NULL outside the edges."""
    n = F.size(edges)
    inner = F.filter(edges, lambda e, k: (k > 0) & (k < n - 1) & (e < x))
    inside = (x >= edges[0]) & (x <= F.element_at(edges, -1))
    return F.when(inside, F.size(inner))


def literal_bin_index(x: Column, edges: Sequence[float]) -> Column:
    """The same for edges known on the driver, as a sum of comparisons."""
    inner = sum([(x > e).cast("int") for e in edges[1:-1]], F.lit(0))
    return F.when((x >= edges[0]) & (x <= edges[-1]), inner)


def _binned(counts: DataFrame, sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bin tables for every run and edge set. ``sets`` has keys and sets ARRAY<STRUCT<set, edges>>."""
    keys = list(keys)
    sets = ranks.checked_broadcast(sets)  # one row per run
    if keys:
        rows = counts.join(sets, ranks.same(counts, sets, keys)).select(counts["*"], sets["sets"])
    else:
        rows = counts.withColumn("sets", sets.select("sets").scalar())
    rows = rows.withColumn("_s", F.explode("sets")).withColumn("bin", bin_index(F.col("p"), F.col("_s.edges"))).filter("bin IS NOT NULL")
    agg = rows.groupBy(*keys, F.col("_s.set").alias("set"), "bin").agg(
        (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("y_proba_mean"), F.sum("n").alias("_n"), F.sum("pos").alias("_pos"))
    full = sets.withColumn("_s", F.explode("sets")).select(*keys, F.col("_s.set").alias("set"), F.col("_s.edges").alias("_e")) \
        .withColumn("bin", F.explode(F.sequence(F.lit(0), F.greatest(F.size("_e") - 2, F.lit(0))))) \
        .withColumns({"lo": F.get("_e", F.col("bin")), "hi": F.get("_e", F.col("bin") + 1)}).drop("_e")
    on = [*keys, "set", "bin"]
    out = full.join(agg, ranks.same(full, agg, on), "left").select(full["*"], agg["y_proba_mean"], agg["_n"], agg["_pos"])
    n, pos = F.coalesce("_n", F.lit(0)), F.coalesce("_pos", F.lit(0))
    whole = Window.partitionBy(*keys, "set")  # one row per bin
    return out.withColumns({"n_samples": n, "n_pos": pos}).withColumns({
        "y_true_mean": F.try_divide("n_pos", "n_samples"),
        "support": F.try_divide(F.col("n_samples"), F.sum("n_samples").over(whole))}).drop("_n", "_pos")


def with_adjustment(bins: DataFrame, knr: float | Column, keys: Sequence[str] = ()) -> DataFrame:
    """Add the positive rate and support before negatives were undersampled at rate ``knr``."""
    k = knr if isinstance(knr, Column) else F.lit(float(knr))
    n_adj = F.col("n_pos") + (F.col("n_samples") - F.col("n_pos")) / k
    whole = Window.partitionBy(*keys, "set")
    return bins.withColumn("y_true_mean_adj", s.adjust_mean(F.col("y_true_mean"), k)) \
        .withColumn("_a", n_adj).withColumn("support_adj", F.try_divide(F.col("_a"), F.sum("_a").over(whole))).drop("_a")


def reliability(preds: DataFrame, y: str = "y_true", p: str = "y_proba", n_bins: int = 10, bin_range=(0.0, 1.0),
                mode: str = "uniform", edges: Sequence[float] | None = None, knr: float | None = None,
                keys: Sequence[str] = ()) -> DataFrame:
    """Reliability table per run: bin, lo, hi, means, counts, support. Empty bins stay, with NULL means."""
    keys = list(keys)
    counts = score_counts(preds, y, p, keys)
    if edges is None and mode == "quantile":
        lo, hi = bin_range
        probs = [lo + k * ((hi - lo) / n_bins) for k in range(n_bins)] + [hi]
        sets = ranks.quantiles(counts, "p", probs, keys, weight="n")
        array = quantile_edges(F.col("q"))
    else:
        if edges is None and mode != "uniform":
            raise ValueError("mode must be 'uniform' or 'quantile'")
        array = uniform_edges(*bin_range, n_bins) if edges is None else F.array(*[F.lit(float(e)) for e in sorted(set(edges))])
        sets = counts.select(*keys).distinct() if keys else preds.sparkSession.range(1)
    sets = sets.select(*keys, F.array(F.struct(F.lit(mode).alias("set"), array.alias("edges"))).alias("sets"))
    bins = _binned(counts, sets, keys)
    if knr is not None:
        bins = with_adjustment(bins, knr, keys)
    return bins.drop("set")


def calibration_errors(bins: DataFrame, keys: Sequence[str] = (), adjusted: bool = False, empty_bins: str = "drop") -> DataFrame:
    """All six errors of a bin table: weighted, mean and maximum, absolute and relative to the true rate.

    ``empty_bins='null'`` makes them NULL as soon as one bin is empty.
    """
    rate, support = ("y_true_mean_adj", "support_adj") if adjusted else ("y_true_mean", "support")
    err = F.abs(F.col(rate) - F.col("y_proba_mean"))
    rel = F.when(F.col(rate) != 0, err / F.nullif(F.col(rate), F.lit(0.0))).when(err > 0, F.lit(float("inf")))
    b = bins.withColumns({"_e": err, "_r": rel, "_w": F.col(support)})
    weight = F.sum(F.when(F.col("_e").isNotNull(), F.col("_w")))
    out = b.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("_w") * F.col("_e")), weight).alias("eace"), F.try_divide(F.sum(F.col("_w") * F.col("_r")), weight).alias("erce"),
        F.avg("_e").alias("aace"), F.avg("_r").alias("arce"), F.max("_e").alias("mace"), F.max("_r").alias("mrce"),
        F.bool_or(F.col("_e").isNull()).alias("_empty"))
    if empty_bins == "null":
        out = out.select(*keys, *[F.when(~F.col("_empty"), F.col(c)).alias(c) for c in ERRORS])
    return out.drop("_empty")


ERRORS = ("eace", "erce", "aace", "arce", "mace", "mrce")
SETS = ("q", "u90", "u95", "umm")


def suite_probs(n_bins: int) -> list[float]:
    return [k / n_bins for k in range(n_bins + 1)] + [0.9, 0.95]


def suite_sets(q: Column, n_bins: int) -> Column:
    """Quantile edges and uniform edges up to the 90th, 95th percentile and from minimum to maximum, from the quantiles of ``suite_probs``."""
    edges = {"q": quantile_edges(F.slice(q, 1, n_bins + 1)), "u90": uniform_edges(0.0, q[n_bins + 1], n_bins),
             "u95": uniform_edges(0.0, q[n_bins + 2], n_bins), "umm": uniform_edges(q[0], q[n_bins], n_bins)}
    return F.array(*[F.struct(F.lit(n).alias("set"), e.alias("edges")) for n, e in edges.items()])


def calibration_suite_of(counts: DataFrame, sets: DataFrame, keys: Sequence[str], knr: float | None = None) -> DataFrame:
    """The 24 calibration errors per run, from the counts and the edge sets of each run."""
    bins = _binned(counts, sets, keys)
    if knr is not None:
        bins = with_adjustment(bins, knr, keys)
    errors = calibration_errors(bins, [*keys, "set"], adjusted=knr is not None)
    return errors.groupBy(*keys).agg(*[F.max(F.when(F.col("set") == n, F.col(e))).alias(f"{e}_{n}") for n in SETS for e in ERRORS])


def calibration_suite_from_counts(counts: DataFrame, keys: Sequence[str] = (), n_bins: int = 10, knr: float | None = None, cuts=None) -> DataFrame:
    q = ranks.quantiles(counts, "p", suite_probs(n_bins), keys, cuts=cuts, weight="n")
    return calibration_suite_of(counts, q.select(*keys, suite_sets(F.col("q"), n_bins).alias("sets")), keys, knr)


def calibration_suite(preds: DataFrame, y: str = "y_true", p: str = "y_proba", keys: Sequence[str] = (), n_bins: int = 10,
                      knr: float | None = None) -> DataFrame:
    """The 24 calibration errors per run."""
    return calibration_suite_from_counts(score_counts(preds, y, p, keys), keys, n_bins, knr)


# --- histograms ------------------------------------------------------------------------------------------

def class_histogram(df: DataFrame, x: str, y: str, n_bins: int, bin_range: tuple[float, float], div_by: str = "max") -> DataFrame:
    """Counts per uniform bin and class, divided by the largest or the summed count."""
    lo, hi = bin_range
    step = (hi - lo) / n_bins
    edges = [k * step + lo for k in range(n_bins)] + [hi]
    b = df.withColumn("bin", literal_bin_index(F.col(x), edges)).filter("bin IS NOT NULL") \
        .groupBy("bin", y).agg(F.count(F.lit(1)).alias("n"))
    top = b.agg(F.max("n") if div_by == "max" else F.sum("n")).scalar()
    return b.withColumn("height", F.col("n") / top).withColumn("mid", lo + step * F.col("bin") + step / 2)


def class_means(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.groupBy(y).agg(F.avg(x).alias("mean"))


def proba_histogram(df: DataFrame, cols: Sequence[str], n_bins: int = 20) -> DataFrame:
    """Share of rows per uniform bin of [0, 1] for each probability column; empty bins are left out."""
    step = 1.0 / n_bins
    edges = [k * step for k in range(n_bins)] + [1.0]
    long = df.unpivot([], list(cols), "column", "p").withColumn("bin", literal_bin_index(F.col("p"), edges)).filter("bin IS NOT NULL")
    b = long.groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))
    return b.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("column"))).withColumn("mid", step * F.col("bin") + step / 2)
