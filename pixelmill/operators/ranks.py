"""Global order without a global sort: running sums, row numbers, exact quantiles, exact subsets.

A window without partitions would put all rows into one task, and a window per group puts a hot group
into one task. Both are avoided by cutting the value range into buckets first: bucket totals are small
and give every bucket its offset, and the window then runs inside one bucket only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "_bucket"
MAX_SLOTS = 1 << 14


def slots(df: DataFrame) -> int:
    """Number of range buckets: a few per shuffle partition, never more than MAX_SLOTS."""
    return max(8, min(MAX_SLOTS, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of key columns."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def number_of(df: DataFrame, c: Column) -> Column:
    """A column of any ordered type as a double that never falls where the column rises: days, microseconds, or the first six bytes of a text."""
    kind = df.select(c).schema[0].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        head = F.hex(F.substring(c.cast("binary"), 1, 6))
        return F.conv(F.rpad(head, 12, "0"), 16, 10).cast("double")
    return c.cast("double")


def _cuts(df: DataFrame, cols: list[str], n: int) -> tuple[list[list[float]], bool]:
    """Approximate cuts of equal counts per column, and whether NULLs of the first fill a range of their own."""
    probs = F.expr("array(" + ", ".join(f"{k / n!r}D" for k in range(1, n)) + ")")
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, F.lit(2 * n)).alias(c) for c in cols],
                 (F.count_if(F.col(cols[0]).isNull()) * n > F.count(F.lit(1))).alias("_none")).head()
    return [list(row[c] or []) for c in cols], bool(row["_none"])


def _bucketize(df: DataFrame, col: str, cuts: Sequence[float], out: str) -> DataFrame:
    """Number of cuts at or below a value; NaN and NULL come behind all."""
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    kept = Bucketizer(splits=splits, inputCol=col, outputCol=out, handleInvalid="keep").transform(df)
    return kept.withColumn(out, F.coalesce(out, F.lit(float(len(splits) - 1))))


BROADCAST_ROWS = 10_000


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A table of few rows computed once and broadcast; a larger one is returned as it is, for a shuffled join.

    Worth its job where the other side is wide: a join planned on estimates would already have moved it.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def value_cuts(df: DataFrame, col: str) -> list[float]:
    """Approximate equal-count cuts of a column, to be shared by operators that order by it."""
    return _cuts(df, [col], slots(df))[0][0]


def range_bucket(df: DataFrame, order: Column, tie: Column | None = None, cuts: Sequence[float] | None = None, ascending: bool = True) -> DataFrame:
    """Add an integer bucket that grows (or, descending, falls) with ``order``, then with ``tie``, and holds about 1/slots of the rows; NULLs come last.

    Any ordered type will do; texts that share their first six bytes count as one value here. A single value, or NULL, that fills several buckets
    alone is cut further along ``tie``.
    """
    n = slots(df)
    place = number_of(df, order)
    df = df.withColumn("_o", place if ascending else -place)
    if tie is not None:
        df = df.withColumn("_t", number_of(df, tie))
    none = False
    found = [cuts]
    if cuts is None or tie is not None:
        found, none = _cuts(df, ["_o"] + (["_t"] if tie is not None else []), n)
    main = found[0]
    hot = sorted({a for a, b in zip(main, main[1:]) if a == b})
    df = _bucketize(df, "_o", main, "_b1").withColumn(BUCKET, F.col("_b1").cast("bigint") * 2 * n)
    if (hot or none) and tie is not None:
        is_hot = F.col("_o").isin(hot) if hot else F.lit(False)
        # an empty value is no number of its own to the cuts, so it is told apart first
        is_hot = F.coalesce(is_hot, F.lit(False)) | (F.col("_o").isNull() if none else F.lit(False))
        df = _bucketize(df, "_t", found[1], "_b2")
        df = df.withColumn(BUCKET, F.col(BUCKET) + F.when(is_hot, F.col("_b2").cast("bigint")).otherwise(n + 1)) \
            .drop("_b2")
    return df.drop("_o", "_t", "_b1")


def running_sums(df: DataFrame, order: Column, sums: Mapping[str, Column], tie: Sequence[Column] = (),
                 keys: Sequence[str] = (), ascending: bool = True, cuts: Sequence[float] | None = None, totals: bool = False) -> DataFrame:
    """Inclusive running sum of each column along (order, tie), per key group, over any number of rows; NULLs of ``order`` come last.

    ``cuts`` are known cuts of ``order`` in ascending sense. With ``totals`` every row also gets the sums of its group, as ``total_{name}``.
    """
    for name, c in sums.items():
        df = df.withColumn(f"_v_{name}", c)
    tie = list(tie)
    if cuts is not None and not ascending:
        cuts = [-c for c in cuts]
    df = range_bucket(df, order, tie[0] if tie else None, cuts, ascending)
    keys = list(keys)
    # keys and bucket as one struct: NULL keys compare equal, and join and window share a partitioning
    place = F.struct(*keys, BUCKET)
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    offsets = df.groupBy(*keys, BUCKET).agg(*[F.sum(f"_v_{s}").alias(f"_s_{s}") for s in sums]) \
        .select(place.alias("_at"), *[F.coalesce(F.sum(f"_s_{s}").over(before), F.lit(0)).alias(f"_off_{s}") for s in sums],
                *[F.sum(f"_s_{s}").over(every).alias(f"total_{s}") for s in sums if totals])
    joined = df.withColumn("_at", place).join(offsets, "_at")
    along = order.asc_nulls_last() if ascending else order.desc_nulls_last()
    within = Window.partitionBy("_at").orderBy(along, *tie).rowsBetween(Window.unboundedPreceding, 0)
    for s in sums:
        joined = joined.withColumn(s, F.col(f"_off_{s}") + F.sum(f"_v_{s}").over(within))
    return joined.drop("_at", BUCKET, *[f"_v_{s}" for s in sums], *[f"_off_{s}" for s in sums])


def row_index(df: DataFrame, order: Column, tie: Sequence[Column] = (), keys: Sequence[str] = (),
              out: str = "rn", ascending: bool = True) -> DataFrame:
    """1-based position along (order, tie), per key group."""
    return running_sums(df, order, {out: F.lit(1).cast("bigint")}, tie, keys, ascending)


def nth_smallest(df: DataFrame, col: str, n: int):
    """Value of rank n of a column, or None when there are fewer rows. Only the range bucket that holds the
    rank is ordered."""
    x = df.filter(F.col(col).isNotNull()).select(F.col(col).alias("_x"))
    x = range_bucket(x, F.col("_x"))
    counts = x.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("_bn"))
    upto = F.sum("_bn").over(Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, 0))
    hit = counts.withColumn("_end", upto).filter((F.col("_end") >= n) & (F.col("_end") - F.col("_bn") < n)).head()
    if hit is None:
        return None
    rank = F.row_number().over(Window.partitionBy(BUCKET).orderBy("_x"))
    row = x.filter(F.col(BUCKET) == hit[BUCKET]).withColumn("_r", rank).filter(F.col("_r") == n - (hit["_end"] - hit["_bn"])).head()
    return row["_x"]


def quantiles(df: DataFrame, col: str, probs: Sequence[float], keys: Sequence[str] = (),
              out: str = "q", cuts: Sequence[float] | None = None, weight: str | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles as an array column, one row per key group.

    Equal values are counted before anything is ordered, and only the few buckets that hold a wanted
    rank are looked into. ``weight`` names a column of row counts.
    """
    keys = list(keys)
    df = df.filter(F.col(col).isNotNull())
    cuts = value_cuts(df, col) if cuts is None else cuts
    n_rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    hist = df.groupBy(*keys, F.col(col).cast("double").alias("_x")).agg(n_rows.alias("_n"))
    hist = _bucketize(hist, "_x", cuts, BUCKET)
    upto = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, 0)
    # positions are rounded, so that a rank like 62.99999999999999 is the 63 it stands for
    positions = F.transform(F.array(*[F.lit(float(p)) for p in probs]), lambda p: F.round((F.col("_total") - 1) * p, 9))
    ends = F.array_distinct(F.flatten(F.transform("_pos", lambda p: F.array(F.floor(p), F.ceil(p)))))
    needed = hist.groupBy(*keys, BUCKET).agg(F.sum("_n").alias("_bn")) \
        .withColumn("_end", F.sum("_bn").over(upto)) \
        .withColumn("_total", F.sum("_bn").over(Window.partitionBy(*keys))) \
        .withColumn("_start", F.col("_end") - F.col("_bn")) \
        .withColumn("_pos", positions).withColumn("_ranks", ends) \
        .filter(F.exists("_ranks", lambda r: (r >= F.col("_start")) & (r < F.col("_end")))) \
        .select(*keys, BUCKET, "_start", "_pos", "_ranks")
    if keys:
        rows = hist.join(needed, same(hist, needed, [*keys, BUCKET])).select(
            hist["*"], needed["_start"], needed["_pos"], needed["_ranks"])
    else:
        rows = hist.join(F.broadcast(needed), BUCKET)  # at most 2 rows per probability
    within = Window.partitionBy(*keys, BUCKET).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_hi", F.col("_start") + F.sum("_n").over(within)) \
        .withColumn("_lo", F.col("_hi") - F.col("_n")) \
        .filter(F.exists("_ranks", lambda r: (r >= F.col("_lo")) & (r < F.col("_hi"))))
    found = rows.groupBy(*keys).agg(F.first("_pos").alias("_pos"),
                                    F.collect_list(F.struct("_lo", "_hi", "_x")).alias("_v"))  # at most 2 per probability

    def at(rank: Column) -> Column:
        return F.get(F.filter("_v", lambda e: (rank >= e["_lo"]) & (rank < e["_hi"])), F.lit(0))["_x"]

    value = F.transform("_pos", lambda p: at(F.floor(p)) + (at(F.ceil(p)) - at(F.floor(p))) * (p - F.floor(p)))
    return found.select(*keys, value.alias(out))


def key_hash(cols: Sequence[Column], seed: int) -> Column:
    """Uniform non-negative 60-bit integer per key; md5 so that any engine can repeat it."""
    text = F.concat_ws("|", *[c.cast("string") for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


HASH_BITS = 60
SUBSET_BITS = 18  # hash buckets that decide which rows an exact subset needs to rank; one of them is ordered


def unit_hash(cols: Sequence[Column], seed: int) -> Column:
    """Uniform number in [0, 1) per key."""
    return key_hash(cols, seed) / F.lit(float(2 ** HASH_BITS))


def flag_first_by_hash(df: DataFrame, key: Sequence[str], seed: int, takes: Mapping[str, Column], strata: Sequence[str] = (),
                       keep_count: bool = False) -> DataFrame:
    """Flag exactly ``takes[name]`` rows per stratum for each name, those with the smallest key hash.

    A take may use ``_count``, the number of rows of the stratum, which ``keep_count`` leaves in. Keys are
    unique. Counts per (stratum, leading hash bits) show in which bucket the last taken row lies; only that
    bucket is ordered to find its key, and the rows themselves are then compared with it in one narrow pass.
    """
    strata, key = list(strata), list(key)
    hashed = df.withColumn("_h", key_hash([F.col(k) for k in key], seed))
    bucket = F.shiftright("_h", HASH_BITS - SUBSET_BITS).alias(BUCKET)
    upto = Window.partitionBy(*strata).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, 0)
    totals = hashed.groupBy(*strata, bucket).agg(F.count(F.lit(1)).alias("_bn")) \
        .withColumn("_end", F.sum("_bn").over(upto)) \
        .withColumn("_count", F.sum("_bn").over(Window.partitionBy(*strata)))
    for n, c in takes.items():
        totals = totals.withColumn(f"_take_{n}", c.cast("bigint"))
    plan = totals.groupBy(*strata).agg(F.max("_count").alias("_count"), *[a for n in takes for a in (
        F.max(f"_take_{n}").alias(f"_take_{n}"),
        F.coalesce(F.min(F.when(F.col("_end") > F.col(f"_take_{n}"), F.col(BUCKET))), F.lit(1 << SUBSET_BITS)).alias(f"_edge_{n}"),
        F.coalesce(F.max(F.when(F.col("_end") <= F.col(f"_take_{n}"), F.col("_end"))), F.lit(0)).alias(f"_before_{n}"))])

    in_bucket = Window.partitionBy(*strata, BUCKET).orderBy("_h", *key)
    narrow = hashed.select(*strata, *key, "_h", bucket)

    def with_row(df: DataFrame, table: DataFrame, as_: str) -> DataFrame:
        """``df`` with the row of ``table`` for its stratum as a struct; the only row, without strata, is a sub-query of the plan."""
        fields = F.struct(*[table[c] for c in table.columns if c not in strata])
        if not strata:
            return df.withColumn(as_, table.select(fields).scalar())
        return df.join(table, same(df, table, strata)).select(df["*"], fields.alias(as_))

    if strata:
        plan = checked_broadcast(plan)
    edges = with_row(narrow, plan, "_p")
    edges = edges.filter(reduce(lambda a, b: a | b, [F.col(BUCKET) == F.col(f"_p._edge_{n}") for n in takes])) \
        .withColumn("_rank", F.row_number().over(in_bucket))
    last = edges.groupBy(*strata).agg(*[F.max(F.when(
        (F.col(BUCKET) == F.col(f"_p._edge_{n}")) & (F.col("_rank") + F.col(f"_p._before_{n}") <= F.col(f"_p._take_{n}")),
        F.struct("_h", *key))).alias(f"_last_{n}") for n in takes])
    if strata:
        last = plan.join(last, same(plan, last, strata), "left").select(plan["*"], *[last[f"_last_{n}"] for n in takes])
        out = with_row(hashed, checked_broadcast(last), "_p")
        final = {n: F.col(f"_p._last_{n}") for n in takes}
    else:
        out = with_row(with_row(hashed, plan, "_p"), last, "_l")
        final = {n: F.col(f"_l._last_{n}") for n in takes}
    here, me = F.shiftright("_h", HASH_BITS - SUBSET_BITS), F.struct("_h", *key)
    for n in takes:
        edge = F.col(f"_p._edge_{n}")
        # an empty table has no edge, and no row that would ask for it
        out = out.withColumn(n, (here < edge) | F.coalesce((here == edge) & (me <= final[n]), F.lit(False)))
    if keep_count:
        out = out.withColumn("_count", F.col("_p._count"))
    return out.drop("_h", "_p", "_l")


def first_by_hash(df: DataFrame, key: Sequence[str], seed: int, take: Column, strata: Sequence[str] = (),
                  out: str = "selected", keep_count: bool = False) -> DataFrame:
    """One flag of ``flag_first_by_hash``."""
    return flag_first_by_hash(df, key, seed, {out: take}, strata, keep_count)
