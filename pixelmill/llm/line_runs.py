"""Removing repeated runs of lines: a suffix array over line-ID sequences by distributed prefix doubling.

Every line with a word becomes a 64-bit ID. A line that occurs once ends every repeated run, so only stretches of successive
repeated lines (of at least ``min_words`` words) are sorted. Prefix doubling turns the ranks of the suffixes by their first 2^m lines
into ranks by 2^(m+1) lines: the pair of ranks (here, 2^m lines on) is counted per distinct pair before anything is ordered, and
new ranks are the old rank plus the number of smaller partners. Suffixes whose first n lines agree are an interval of the suffix array
(LCP at least n), named by two overlapping ranks; the interval's first text position is the copy that is kept.

A line is deleted when it lies in a run of at least ``min_words`` words that also occurs earlier, by (doc_id, line). Such a run is
the union of its shortest sub-runs of ``min_words`` words, taken forward from each line and backward from each line, and a sub-run has
at most ``min_words`` lines; so these windows decide exactly, and doubling stops at their length.

Edge cases: NULL text stays NULL; lines without a word are no part of a run but go with a deleted run around them; spaces around
a line are ignored; rows equal in doc_id and text are handled as one and get one result; NULL doc_id comes first; a text that is
wholly a later copy becomes empty; other columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.llm.common import cut, unused

MIN_WORDS = 50
_BLANK = " \t\r\f\x0b"
_BUCKET_BITS = 12


def sequences(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, k, i, h, w): k-th line with a word, its index in the text, its ID and its number of words."""
    trim = lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(_BLANK)).alias("x"))
    trimmed = F.filter(F.transform(F.split("text", "\n"), trim), lambda s: s["x"] != "")
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("tk"), F.posexplode(trimmed).alias("k", "s"))
    n = F.size(F.split("s.x", "[ \\t\\r\\f\\x0B]+"))
    return rows.select("doc_id", "tk", "k", F.col("s.i").alias("i"), F.xxhash64("s.x").alias("h"), n.alias("w"))


def stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """Lines that occur more than once, in stretches of successive ones with enough words, ranked by line ID. Rows equal in doc_id and text
    give every line again with the same k; one of these is kept."""
    found = lines.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    bucket = F.shiftright("h", 64 - _BUCKET_BITS)
    total = found.groupBy(bucket.alias("b")).agg(F.sum("c").alias("n"))  # at most 2^_BUCKET_BITS rows, so one task may order them
    total = total.select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    inside = Window.partitionBy("b").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    ranked = found.withColumn("b", bucket).join(total, "b") \
        .select("h", (F.col("off") + F.coalesce(F.sum("c").over(inside), F.lit(0))).alias("r0"))
    of_doc = Window.partitionBy("doc_id", "tk").orderBy("k")
    seg = Window.partitionBy("doc_id", "tk", "g")
    found = lines.join(ranked, "h").withColumn("again", F.lag("k").over(of_doc)).withColumn("g", F.col("k") - F.dense_rank().over(of_doc))
    return found.filter(F.col("again").isNull() | (F.col("again") < F.col("k"))) \
        .withColumn("total", F.sum("w").over(seg)).filter(F.col("total") >= min_words) \
        .select("doc_id", "tk", "g", "k", "i", "w", "r0")


def double(ranks: DataFrame, m: int) -> DataFrame:
    """Add ``r{m+1}``, ranks by the first 2^(m+1) lines, from ``r{m}``. A suffix that ends earlier sorts first."""
    here, new = f"r{m}", f"r{m + 1}"
    ahead = F.lead(here, 2**m).over(Window.partitionBy("doc_id", "tk", "g").orderBy("k"))
    pairs = ranks.withColumn("_p", F.coalesce(ahead, F.lit(-1)))
    before = Window.partitionBy(here).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    distinct = pairs.groupBy(here, "_p").agg(F.count(F.lit(1)).alias("_c")) \
        .select(here, "_p", (F.col(here) + F.coalesce(F.sum("_c").over(before), F.lit(0))).alias(new))
    return pairs.join(distinct, [here, "_p"]).select(*ranks.columns, new)


def suffix_array(stretched: DataFrame, depth: int) -> DataFrame:
    """Ranks r0 .. r{M} by 1 .. 2^M <= depth lines; each step is checkpointed, as it is read twice."""
    ranks, m = cut(stretched), 0
    while 2 ** (m + 1) <= depth:
        ranks = cut(double(ranks, m))
        m += 1
    return ranks


def repeated_ranges(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, tk, ranges): line index ranges that later copies take up, merged and in order."""
    ranks = suffix_array(stretches(cut(sequences(docs)), min_words), min_words)
    levels = [c for c in ranks.columns if c.startswith("r")]
    upto = Window.partitionBy("doc_id", "tk", "g").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    item = F.struct("k", "i", "w", "cw", F.array(*levels).alias("r"))
    rows = ranks.withColumn("cw", F.sum("w").over(upto)).groupBy("doc_id", "tk", "g").agg(F.sort_array(F.collect_list(item)).alias("a"))
    at, n = lambda p: F.element_at("a", p.cast("int")), F.size("a")

    def forward(p):  # shortest window from line p on
        need = at(p)["cw"] - at(p)["w"] + min_words
        size = F.size(F.filter(F.slice("a", p, min_words), lambda x: x["cw"] < need)) + 1
        return F.struct(p.alias("p"), size.alias("n"))

    def backward(p):  # shortest window up to line p
        first = F.greatest(p - min_words + 1, F.lit(1))
        size = F.size(F.filter(F.slice("a", first, p - first + 1), lambda x: at(p)["cw"] - x["cw"] < min_words))  # the words after x do not suffice
        return F.struct((p - size + 1).alias("p"), size.alias("n"))

    places = F.sequence(F.lit(1), n)
    windows = F.array_union(
        F.filter(F.transform(places, forward), lambda x: x["p"] + x["n"] - 1 <= n),
        F.filter(F.transform(places, backward), lambda x: (x["p"] >= 1) & (at(x["p"] + x["n"] - 1)["cw"] - at(x["p"])["cw"] + at(x["p"])["w"] >= min_words)))
    level = F.floor(F.log2("n") + 1e-9).cast("int")
    w = rows.select("doc_id", "tk", "a", F.inline(windows)).withColumn("m", level)
    first, last = F.element_at("a", F.col("p")), F.element_at("a", F.col("p") + F.col("n") - 1)
    second = F.element_at("a", (F.col("p") + F.col("n") - F.pow(F.lit(2), "m")).cast("int"))
    w = cut(w.select("doc_id", "tk", "n", F.element_at(first["r"], F.col("m") + 1).alias("x"), F.element_at(second["r"], F.col("m") + 1).alias("y"),
                     first["k"].alias("k"), first["i"].alias("s"), last["i"].alias("e")))
    intervals = w.groupBy("n", "x", "y").agg(F.min(F.struct("doc_id", "tk", "k")).alias("kept"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    later = w.join(intervals, ["n", "x", "y"]).filter(~F.struct("doc_id", "tk", "k").eqNullSafe(F.col("kept")))
    ranges = later.groupBy("doc_id", "tk").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("found"))

    def join_on(acc, x):
        tail = F.element_at(acc, -1)
        return F.when((F.size(acc) > 0) & (x["s"] <= F.get(acc, F.size(acc) - 1)["e"] + 1), F.concat(
            F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(tail["s"].alias("s"), F.greatest(tail["e"], x["e"]).alias("e"))))) \
            .otherwise(F.concat(acc, F.array(x)))

    merged = F.aggregate("found", F.expr("cast(array() as array<struct<s:int,e:int>>)"), join_on)
    return ranges.select("doc_id", "tk", merged.alias("ranges"))


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of line runs taken out of ``text``, and ``n_lines``, ``n_deleted`` (lines; NULL text has 0)."""
    found, key = unused(docs, "_ranges"), unused(docs, "_tk")
    ranges = repeated_ranges(docs, min_words).select(F.col("doc_id").alias("_d"), F.col("tk").alias("_t"), F.col("ranges").alias(found)).hint("shuffle_hash")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    joined = keyed.join(ranges, keyed["doc_id"].eqNullSafe(ranges["_d"]) & (keyed[key] == ranges["_t"]), "left")
    lines = F.split(keyed["text"], "\n")
    left = F.filter(lines, lambda x, i: ~F.exists(found, lambda r: (i >= r["s"]) & (i <= r["e"])))
    gone = F.coalesce(F.aggregate(found, F.lit(0), lambda n, r: n + r["e"] - r["s"] + 1), F.lit(0))
    return joined.select(*[F.when(F.col(found).isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias(c) if c == "text" else keyed[c]
                           for c in docs.columns],
                         F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("bigint").alias("n_lines"), gone.cast("bigint").alias("n_deleted"))
