"""Sampling and balancing with exact counts, repeatable per key whatever the partitioning.

A key hash stands in for the random draw, so a lost executor or another cluster size gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.functions import scalars as s
from pixelmill.operators import ranks


def _unit(key: Sequence[str], seed: int) -> Column:
    return ranks.unit_hash([F.col(k) for k in key], seed)


def task_seed(key: Sequence[Column], seed: int) -> Column:
    """32-bit seed per task key."""
    return ranks.key_hash(key, seed) % (2 ** 32)


def bernoulli(df: DataFrame, key: Sequence[str], p: float, seed: int) -> DataFrame:
    return df.filter(_unit(key, seed) < p)


def exact_random_subset(df: DataFrame, key: Sequence[str], n: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Exactly n rows (per group), or all when there are fewer."""
    return ranks.first_by_hash(df, key, seed, F.lit(n), by, "_sel").filter("_sel").drop("_sel")


def undersample_negatives(df: DataFrame, label: str, key: Sequence[str], drop_ratio: float, seed: int) -> DataFrame:
    """All positives, and each negative with probability 1 - drop_ratio."""
    return df.filter(F.col(label) | (_unit(key, seed) >= drop_ratio))


def restore_prior(df: DataFrame, label: str, key: Sequence[str], knr: float, seed: int) -> DataFrame:
    """All negatives, and each positive with probability knr."""
    return df.filter(~F.col(label) | (_unit(key, seed) < knr))


def undersample_to_rate(df: DataFrame, label: str, key: Sequence[str], n: int, r_pos: float, seed: int) -> DataFrame:
    """n rows at positive rate r_pos: negatives are cut to the wanted odds, then n rows are drawn. The
    rate of the input is kept in ``r_pos_original``."""
    totals = df.agg(F.struct(F.count_if(label).alias("n"), F.avg(F.col(label).cast("double")).alias("rate"))).scalar()
    take = F.when(F.col(label), F.col("_count")).otherwise(F.bround(totals["n"] * ((1 - r_pos) / r_pos)))
    cut = ranks.first_by_hash(df, key, seed, take, [label], "_sel").filter("_sel").drop("_sel")
    return exact_random_subset(cut, key, n, seed + 1).withColumn("r_pos_original", totals["rate"])


def balance_classes(df: DataFrame, label: str, key: Sequence[str], seed: int, oversample: bool = False) -> DataFrame:
    """Equal class sizes: down to the smallest class, or up to the largest by whole copies and an exact
    hash-ranked remainder."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    if not oversample:
        least = sizes.agg(F.min("_c")).scalar()
        return ranks.first_by_hash(df, key, seed, least, [label], "_sel").filter("_sel").drop("_sel")
    most = sizes.agg(F.max("_c")).scalar()
    flagged = ranks.first_by_hash(df, key, seed, most % F.col("_count"), [label], "_sel", keep_count=True)
    copies = F.floor(most / F.col("_count")).cast("int") + F.col("_sel").cast("int")
    return flagged.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("_sel", "_count")


def sample_fraction(df: DataFrame, key: Sequence[str], frac: float, seed: int) -> DataFrame:
    """frac > 1 gives whole copies plus an exact remainder without replacement."""
    whole = int(frac)
    flagged = ranks.first_by_hash(df, key, seed, F.bround(F.col("_count") * (frac - whole)), (), "_sel")
    copies = F.lit(whole) + F.col("_sel").cast("int")
    numbers = F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))
    return flagged.withColumn("copy", F.explode(numbers)).drop("_sel")


def split(df: DataFrame, key: Sequence[str], train: float, val: float, seed: int, stratify: str | None = None) -> DataFrame:
    """Column ``split`` with exact shares of train, val and test (per class when stratified)."""
    strata = [stratify] if stratify else []
    n_train = F.floor(F.col("_count") * train + 1e-9)
    n_test = F.floor((F.col("_count") - n_train) * ((1 - train - val) / (1 - train)) + 1e-9) if train < 1 else F.lit(0)
    n_both = F.col("_count") - n_test
    out = ranks.flag_first_by_hash(df, key, seed, {"_train": n_train, "_both": n_both}, strata)
    return out.withColumn("split", F.when(F.col("_train"), "train").when(F.col("_both"), "val").otherwise("test")) \
        .drop("_train", "_both")


def first_fraction(df: DataFrame, key: Sequence[str], r: float, seed: int) -> DataFrame:
    """First floor(r*n) rows in a fixed random order, so that a smaller r gives a subset."""
    return ranks.first_by_hash(df, key, seed, F.floor(F.col("_count") * r + 1e-9), (), "_sel").filter("_sel").drop("_sel")


def complement(df: DataFrame, selected: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.join(selected.select(*key), list(key), "left_anti")


def sample_day_bounds(df: DataFrame) -> DataFrame:
    """Days of year a sample of this month may fall on, as lo and hi; rows without such a day go.

    A first day after the last day means the period crosses the turn of the year.
    """
    year, month, first, last = (F.col(c) for c in ("year", "month", "first_day", "last_day"))
    crosses = first > last
    last = F.when(crosses & (month > 6), last + s.days_in_year(year)).otherwise(last)
    first = F.when(crosses & (month <= 6), first - s.days_in_year(year - 1)).otherwise(first)
    bounds = s.month_bounds(year, month)
    return df.withColumns({"lo": F.greatest(F.dayofyear(bounds["first_date"]), first),
                           "hi": F.least(F.dayofyear(bounds["last_date"]), last)}).filter(F.col("lo") <= F.col("hi"))


def assign_sample_day(df: DataFrame, key: Sequence[str], seed: int) -> DataFrame:
    """Burn day for positives, a uniform day inside the bounds for negatives."""
    drawn = F.col("lo") + F.pmod(ranks.key_hash([F.col(k) for k in key], seed), F.col("hi") - F.col("lo") + 1)
    return sample_day_bounds(df).withColumn(
        "yday", F.when(F.col("fire"), F.col("burn_date")).otherwise(drawn).cast("int")).drop("lo", "hi")
