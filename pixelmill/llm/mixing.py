"""Mixing sources to target weights by hash-threshold histograms.

A document's key hash decides how often it is taken. Words are summed per (source, leading hash bits); the bucket in which a
source's running sum reaches its budget is the only one looked into further, by the next bits, and rows are then compared with a
threshold. Nothing is sorted by row, and a hot source is only ever summed.

The key is doc_id, text and the number of a row among those equal in doc_id, source and text, so rows of one doc_id, or with none, are drawn apart.

Edge cases: NULL text has size 0; NULL source is a source of its own, ordered last; an empty table gives no rows; a source without
words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.llm.common import cut, n_words, unused

HASH_BITS, LEVEL_BITS, LEVELS = 60, 12, 3
WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
_RUN = 1 << 14  # equal rows numbered from one row


def key_hash(*keys: Column) -> Column:
    """Uniform 60-bit integer per key; md5, so that any engine can repeat it."""
    name = F.concat_ws("|", *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("bigint")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, _t, size, n, _h) per row: hash and words of the text, number of rows equal in doc_id, source and text, and the key hash.

    Equal rows are counted and then numbered anew, ``_RUN`` at a time, so each of them draws on its own and a row given many times is spread."""
    rows = docs.select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("_t"), n_words(F.col("text")).alias("size"))
    rows = rows.groupBy("doc_id", "source", "_t").agg(F.min("size").alias("size"), F.count(F.lit(1)).alias("n"))
    runs = rows.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / _RUN))))
    from_, to = F.col("_run") * _RUN, F.least(F.col("n"), (F.col("_run") + 1) * _RUN) - 1
    each = runs.withColumn("_i", F.explode(F.sequence(from_, to)))
    return each.select("doc_id", "source", "_t", "size", "n", key_hash(F.col("doc_id"), F.col("_t"), F.col("_i")).alias("_h"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Target words per source from (source, source_size): shares by weight, those over ``repeats`` times the size cut and the rest
    shared anew. Sources are few (one row each), so the windows over them run in one task.

    In ascending order of cap per weight the sources that stay below the common level are exactly a prefix, so the level follows
    from running sums and needs no iteration."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("_place") - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("_place", place).withColumn("_w", w).withColumn("_cap", F.col("source_size") * float(repeats))
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), "_place")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumn("_budget", F.sum("source_size").over(every) * share) \
        .withColumn("_level", (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
                    / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    level = F.max(F.when(F.col("_cap") / F.col("_w") >= F.col("_level"), F.col("_level"))).over(every)  # that of the first such source
    return s.withColumn("target", F.least(F.col("_cap"), F.coalesce(level * F.col("_w"), F.col("_cap")))) \
        .select("source", "source_size", "target")


def _prefix(bits: int) -> Column:
    return F.shiftright(F.col("_h"), HASH_BITS - bits)


def thresholds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source: whole copies of every document, and the hash prefix below which one more copy is taken.

    ``sized`` has (source, size, _h); each level sums one histogram and keeps the bucket in which the budget is reached."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(F.lit(0))
    state = plan.withColumn("copies", whole).withColumn("_rest", F.col("target") - F.col("copies") * F.col("source_size")) \
        .withColumn("_at", F.lit(0).cast("bigint"))
    upto = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    for level in range(1, LEVELS + 1):
        here = state.select(F.col("source").alias("_s"), "_rest", "_at")
        known = sized["source"].eqNullSafe(here["_s"])
        inside = sized
        if level > 1:
            inside = sized.join(here, known & (_prefix(LEVEL_BITS * (level - 1)) == F.col("_at"))).select(sized["*"])
        sums = inside.groupBy("source", _prefix(LEVEL_BITS * level).alias("_b")).agg(F.sum("size").alias("_n"))
        sums = sums.withColumn("_end", F.sum("_n").over(upto))
        sums = sums.join(here, sums["source"].eqNullSafe(here["_s"])).select(sums["*"], "_rest")
        reached = F.min(F.when(F.col("_end") >= F.col("_rest"), F.struct("_b", "_n", "_end")))
        edge = sums.groupBy("source").agg(reached.alias("_e"), F.max("_b").alias("_last"), F.max("_end").alias("_all"))
        edge = edge.select(F.col("source").alias("_s"), F.coalesce(F.col("_e._b"), F.col("_last")).alias("_nb"),
                           F.coalesce(F.col("_e._n"), F.lit(0)).alias("_nn"), F.coalesce(F.col("_e._end"), F.col("_all")).alias("_ne"))
        state = state.join(edge, state["source"].eqNullSafe(edge["_s"]), "left") \
            .withColumn("_at", F.coalesce("_nb", F.shiftleft(F.col("_at"), LEVEL_BITS)))
        if level == LEVELS:  # the last bucket is taken when that comes nearer
            over, under = F.col("_ne") - F.col("_rest"), F.col("_rest") - (F.col("_ne") - F.col("_nn"))
            state = state.withColumn("_at", F.col("_at") + F.coalesce((over <= under).cast("bigint"), F.lit(0)))
        else:
            state = state.withColumn("_rest", F.col("_rest") - F.coalesce(F.col("_ne") - F.col("_nn"), F.lit(0)))
        state = state.select("source", "source_size", "target", "copies", "_rest", "_at")
    return state.withColumn("_at", F.when(F.col("copies") >= REPEATS, F.lit(0)).otherwise(F.col("_at")))


def draws(docs: DataFrame) -> DataFrame:
    """(doc_id, source, _t, n, size, source_size, target, copies, taken) per row; the text is read once."""
    rows = cut(sized(docs))
    plan = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))  # one row per source
    limits = thresholds(rows.select("source", "size", "_h"), plan) \
        .select(F.col("source").alias("_s"), "source_size", "target", F.col("copies").alias("_c"), "_at")
    joined = rows.join(limits, rows["source"].eqNullSafe(limits["_s"]))
    copies = (F.col("_c") + (_prefix(LEVEL_BITS * LEVELS) < F.col("_at")).cast("int")).cast("bigint")
    return joined.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) per row."""
    return draws(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def mixed(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them: none, one or two of each. Of rows equal in doc_id, source and text the mix takes some number
    together, so one of them stands for all."""
    taken = cut(draws(docs).groupBy("doc_id", "source", "_t").agg(F.sum("copies").alias("_c"), F.first("n").alias("_n")).filter("_c > 0")
                .select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("_t").alias("_x"), "_c", "_n"))
    key, copy = unused(docs, "_text"), unused(docs, "_copy")
    keyed = docs.withColumn(key, F.md5(F.col("text").cast("binary")))

    def joined(part: DataFrame) -> DataFrame:
        same = keyed["doc_id"].eqNullSafe(part["_d"]) & keyed["source"].eqNullSafe(part["_s"]) & keyed[key].eqNullSafe(part["_x"])
        return keyed.join(part.hint("shuffle_hash"), same).select(keyed["*"], part["_c"].alias(copy))

    found = joined(taken.filter("_n = 1"))
    several = taken.filter("_n > 1")
    if not several.isEmpty():
        found = found.union(joined(several).dropDuplicates(["doc_id", "source", key]))
    return found.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copy)))).select(*docs.columns)
