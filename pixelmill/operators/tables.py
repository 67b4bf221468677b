"""Small table operators: scaling, listing, grids, batches, wide and long forms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.operators import ranks


def _with_stats(df: DataFrame, stats: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Attach aggregates of the frame as struct ``_s``; per group when ``by`` is given."""
    s = F.struct(*[c.alias(n) for n, c in stats.items()]).alias("_s")
    if not by:
        return df.withColumn("_s", df.agg(s).scalar())
    agg = ranks.checked_broadcast(df.groupBy(*by).agg(s))
    return df.join(agg, ranks.same(df, agg, by)).select(df["*"], agg["_s"])


# --- scaling ---------------------------------------------------------------------------------------------

def stretch(df: DataFrame, col: str, new_min: float | None = None, new_max: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Min-max rescale, all rows or per group; a limit left out stays where it is. A constant column goes to
    the lower limit."""
    if new_min is None and new_max is None:
        raise ValueError("give new_min, new_max or both")
    s = _with_stats(df, {"lo": F.min(col), "hi": F.max(col)}, by)
    old_lo, old_hi = F.col("_s.lo"), F.col("_s.hi")
    lo = old_lo if new_min is None else F.lit(float(new_min))
    hi = old_hi if new_max is None else F.lit(float(new_max))
    share = F.coalesce(F.try_divide(F.col(col) - old_lo, old_hi - old_lo), F.lit(0.0))
    return s.withColumn(col, F.when(F.col(col).isNotNull(), share * (hi - lo) + lo)).drop("_s")


def move_max(df: DataFrame, col: str, new_max: float, by: Sequence[str] = ()) -> DataFrame:
    """Keep the minimum, move the maximum."""
    return stretch(df, col, None, new_max, by)


def zscore(df: DataFrame, cols: Sequence[str], scale: float = 1.0, shift_first: float = 0.0) -> DataFrame:
    """Standardise with the population deviation, then scale; the first column is also shifted."""
    stats = {f"m_{c}": F.avg(c) for c in cols} | {f"d_{c}": F.stddev_pop(c) for c in cols}
    s = _with_stats(df, stats)
    for k, c in enumerate(cols):
        z = (F.col(c) - F.col(f"_s.m_{c}")) / F.nullif(F.col(f"_s.d_{c}"), F.lit(0.0)) * scale
        s = s.withColumn(c, z + shift_first if k == 0 else z)
    return s.drop("_s")


# --- lists, shares, checks -------------------------------------------------------------------------------

def implode(df: DataFrame, keys: Sequence[str], order: Sequence[str] = (), keep_singletons: bool = True) -> DataFrame:
    """One row per key; other columns become lists in the given order.

    With ``keep_singletons=False`` a list of one element is NULL and its value is in ``{column}_single``. The
    result holds a whole group in one row, so groups have to be of a size a row can hold.
    """
    rest = [c for c in df.columns if c not in keys]
    rows = F.array_sort(F.collect_list(F.struct(*order, *[c for c in rest if c not in order])))

    def column(c: str) -> Column:
        return F.transform("_r", lambda r: r[c])

    out = df.groupBy(*keys).agg(rows.alias("_r"))
    if keep_singletons:
        return out.select(*keys, *[column(c).alias(c) for c in rest])
    single = F.size("_r") == 1
    return out.select(*keys, *[x for c in rest for x in (
        F.when(~single, column(c)).alias(c), F.when(single, F.col("_r")[0][c]).alias(f"{c}_single"))])


def null_ratio(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Share of NULLs per column, long form, one pass."""
    cols = list(cols or df.columns)
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    return one.unpivot([], cols, "column", "null_ratio").withColumn("not_null_ratio", 1 - F.col("null_ratio"))


def class_counts(df: DataFrame, y: str) -> DataFrame:
    """Rows per class and their share."""
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("share", F.col("n") / total)


def inverse_prior_weights(df: DataFrame, y: str, eps: float = 0.0) -> DataFrame:
    """Class weights proportional to 1/share that sum to the number of classes."""
    counts = class_counts(df, y).withColumn("_inv", 1.0 / (F.col("share") + eps))
    s = counts.agg(F.struct(F.sum("_inv").alias("t"), F.count(F.lit(1)).alias("k")).alias("s")).scalar()
    return counts.withColumn("_s", s).select(y, "n", "share", (F.col("_inv") * F.col("_s.k") / F.col("_s.t")).alias("weight"))


def with_class_weights(df: DataFrame, y: str, eps: float = 0.0) -> DataFrame:
    """Join the class weights back as a sample weight; the weight table has one row per class."""
    return df.join(ranks.checked_broadcast(inverse_prior_weights(df, y, eps).select(y, "weight")), y)


def biased_sample_weight(df: DataFrame, y: str, r_original: float) -> DataFrame:
    """Weight that gives the positives of an undersampled set their original share; negatives keep 1."""
    n_pos = F.count_if(F.col(y) == 1)
    s = df.agg((r_original * F.count_if(F.col(y) == 0) / (F.nullif(n_pos, F.lit(0)) * (1 - r_original)))).scalar()
    return df.withColumn("weight", F.when(F.col(y) == 1, s).otherwise(1.0))


def frequency_table(df: DataFrame, cols: Sequence[str], y: str, max_proba: float | None = None) -> DataFrame:
    """Positive rate per distinct combination, optionally rescaled so that the largest is ``max_proba``."""
    table = df.groupBy(*cols).agg(F.avg(F.col(y).cast("double")).alias("proba"), F.count(F.lit(1)).alias("n"))
    if max_proba is not None:
        top = table.agg(F.max("proba")).scalar()
        table = table.withColumn("proba", F.col("proba") / F.nullif(top, F.lit(0.0)) * max_proba)
    return table


def predict_from_frequency(df: DataFrame, freq: DataFrame, cols: Sequence[str], unknown: float = 0.0,
                           threshold: float = 0.5) -> DataFrame:
    """Look the combination up; unseen combinations get ``unknown``."""
    out = df.join(freq, ranks.same(df, freq, cols), "left").select(df["*"], freq["proba"])
    p = F.coalesce(F.col("proba"), F.lit(unknown))
    return out.withColumn("proba", p).withColumn("label", (p >= threshold).cast("int"))


def weighted_average(df: DataFrame, x: str, w: str, by: Sequence[str] = ()) -> DataFrame:
    """Weighted mean over the rows that have both numbers."""
    both = F.col(x).isNotNull() & F.col(w).isNotNull()
    mean = F.try_divide(F.sum(F.when(both, F.col(x) * F.col(w))), F.sum(F.when(both, F.col(w))))
    return df.groupBy(*by).agg(mean.alias("mean"))


def harmonize(df: DataFrame, x: str, w: str) -> DataFrame:
    """Replace x by its weighted mean over all rows."""
    return df.withColumn(x, weighted_average(df, x, w).scalar())


def is_constant(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: minimum and maximum are about equal; values are all distinct."""
    aggs = [F.struct((F.max(c) - F.min(c) <= 1e-8 + 1e-5 * F.abs(F.min(c))).alias("is_constant"),
                     (F.count_distinct(F.col(c)) == F.count(F.lit(1))).alias("all_unique")).alias(c) for c in cols]
    long = df.agg(*aggs).unpivot([], list(cols), "column", "r")
    return long.select("column", "r.is_constant", "r.all_unique")


def column_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Minimum, mean, maximum and exact median per column."""
    long = df.unpivot([], list(cols), "column", "x")
    stats = long.groupBy("column").agg(F.min("x").alias("min"), F.avg("x").alias("mean"), F.max("x").alias("max"))
    return stats.join(ranks.quantiles(long, "x", [0.5], ["column"]), "column") \
        .select("column", "min", "mean", "max", F.col("q")[0].alias("median"))


def quartile_summary(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, interquartile range and whisker limits."""
    q = ranks.quantiles(df, col, [0.25, 0.5, 0.75], by)
    a, b, c = (F.col("q")[k] for k in range(3))
    iqr = c - a
    return q.select(*by, a.alias("q1"), b.alias("median"), c.alias("q3"), iqr.alias("iqr"),
                    (a - 1.5 * iqr).alias("whisker_lo"), (c + 1.5 * iqr).alias("whisker_hi"))


# --- products, grids, batches ----------------------------------------------------------------------------

def cross(a: DataFrame, b: DataFrame | None = None, preserve: Sequence[str] = (), suffixes=("_x", "_y")) -> DataFrame:
    """All pairs of rows, or all pairs that agree in ``preserve`` (outer, so that no row is lost).

    The product itself is the wanted result here. Without ``preserve`` Spark picks the physical form:
    a side is broadcast only when its measured size allows it.
    """
    b = a if b is None else b
    shared = [c for c in a.columns if c in b.columns and c not in preserve]
    left = a.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = b.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return left.join(right, list(preserve), "full") if preserve else left.crossJoin(right)


def grid_product(df: DataFrame, arrays: Mapping[str, str]) -> DataFrame:
    """Cartesian product of the array columns of each row, by mixed-radix counting instead of joins."""
    sizes = {out: F.size(src).cast("bigint") for out, src in arrays.items()}
    total = reduce(lambda x, y: x * y, sizes.values())
    keep = [c for c in df.columns if c not in arrays.values()]
    rows = df.withColumn("_k", F.explode(F.when(total > 0, F.sequence(F.lit(0).cast("bigint"), total - 1))))
    picks, step = [], F.lit(1).cast("bigint")
    for out, src in reversed(list(arrays.items())):
        picks.append(F.get(F.col(src), (F.floor(F.col("_k") / step) % sizes[out]).cast("int")).alias(out))
        step = step * sizes[out]
    return rows.select(*keep, *reversed(picks))


def grid_over(df: DataFrame, cols: Sequence[str], n_points: int, pad: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """Regular grid over the padded range of each column; a constant column keeps its one value.

    The ticks per column are the largest whole number whose power over the varying columns stays within
    ``n_points``.
    """
    stats = df.groupBy(*by).agg(*[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c)
                                  for c in cols])
    varying = reduce(lambda a, b: a + b, [(F.col(c)["hi"] > F.col(c)["lo"]).cast("int") for c in cols])
    ticks = F.greatest(F.lit(2), F.floor(F.pow(F.lit(float(n_points)), 1.0 / F.greatest(varying, F.lit(1))) + 1e-9)).cast("int")
    stats = stats.withColumn("_n", ticks)

    def axis(c: str) -> Column:
        lo, span = F.col(c)["lo"], F.col(c)["hi"] - F.col(c)["lo"]
        steps = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda k: lo - pad * span + k * (1 + 2 * pad) * span / (F.col("_n") - 1))
        return F.when(span > 0, steps).otherwise(F.array(lo)).alias(f"_t_{c}")

    out = stats.select(*by, *[axis(c) for c in cols])
    return grid_product(out, {c: f"_t_{c}" for c in cols})


def batches(df: DataFrame, order: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    """Chunk number of each row, n rows per chunk in the given order."""
    return ranks.row_index(df, F.col(order), [], by, "_r") \
        .withColumn("batch", F.floor((F.col("_r") - 1) / n)).drop("_r")


def split_head_tail(df: DataFrame, order: str, n: int) -> DataFrame:
    """Flag the first n rows along a unique column by comparing with its n-th value; rows are not moved."""
    last = ranks.nth_smallest(df, order, n) if n > 0 else None
    flag = F.lit(n > 0) if last is None else F.col(order) <= F.lit(last)
    return df.withColumn("is_head", flag)


def carry_dates(df: DataFrame, col: str, days: int, forward: bool = True) -> DataFrame:
    """Repeat each row for day+0 .. day+days-1 (or backwards)."""
    step = F.explode(F.sequence(F.lit(0), F.lit(days - 1)))
    out = df.withColumn("_k", step)
    return out.withColumn(col, F.date_add(col, F.col("_k") if forward else -F.col("_k"))).drop("_k")


def is_complete_year(df: DataFrame, date: str, by: Sequence[str] = ()) -> DataFrame:
    """Every day of exactly one year is present exactly once."""
    n, d = F.count(date), F.count_distinct(F.col(date))
    one_year = F.year(F.min(date)) == F.year(F.max(date))
    full = F.dayofyear(F.make_date(F.year(F.max(date)), F.lit(12), F.lit(31)))
    return df.groupBy(*by).agg((one_year & (n == d) & (n == full) & (F.count(F.lit(1)) == n)).alias("complete"))


def scores_wide(scores: DataFrame, keys: Sequence[str], names: Sequence[str], value: str, columns: Sequence[str]) -> DataFrame:
    """Long scores to one column per joined name; ``columns`` fixes the result schema."""
    long = scores.withColumn("_n", F.concat_ws("_", *names))
    return long.groupBy(*keys).pivot("_n", list(columns)).agg(F.max(value))


def scores_long(wide: DataFrame, keys: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    return wide.unpivot(list(keys), [c for c in wide.columns if c not in keys], name, value).filter(F.col(value).isNotNull())


def drop_incomplete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def open_range(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    return df.filter((F.col(col) > lo) & (F.col(col) < hi))


def permute_column(df: DataFrame, key: str, col: str, seed: int) -> DataFrame:
    """Give every row the value of another row: both sides are numbered, by key and by key hash, and joined."""
    by_key = ranks.row_index(df, F.col(key), [], out="_r")
    h = ranks.key_hash([F.col(key)], seed)
    shuffled = ranks.row_index(df.select(key, col, h.alias("_h")), F.col("_h"), [F.col(key)], out="_r")
    return by_key.drop(col).join(shuffled.select("_r", col), "_r").drop("_r")



def concat(parts: Sequence[DataFrame]) -> DataFrame:
    """Append frames by column name; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
