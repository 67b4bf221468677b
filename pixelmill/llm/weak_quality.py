"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Every rule looks at one figure of the whole text and votes good (1), bad (-1) or abstains (0). The model is naive Bayes with a hidden
quality: given the quality, a rule votes with probabilities of its own, its accuracies on good and on bad texts. Texts are counted per
vote pattern first (at most 3^rules rows), so a step of expectation-maximisation is one aggregate over that table and does not see the
texts again. The first step takes the majority of the votes for the quality, which fixes which of the two hidden classes is the good one.
A text is kept when its posterior probability of quality is at least 1/2 and no base rule fails it.

Edge cases: NULL and empty texts have no words and fail the base; ties in the posterior keep; rows that repeat count each; a NULL doc_id
is a row like any other; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import cut, words

MIN_WORDS, MAX_REPEATED = 50, 50
STEPS, SETTLED, SMOOTHING = 30, 1e-4, 1.0
SYMBOLS = "[#*$%&|<>]"
#: A word of letters, also joined by one hyphen or apostrophe, with quotes or one punctuation mark around it.
PLAIN = "^[\"'(«¿¡]?\\p{L}+(?:[-'’]\\p{L}+)*[.,;:!?)\"'»]{0,2}$"
ENDED = "[.!?:;\"'»)][ \\r]*$"


def figures(docs: DataFrame) -> DataFrame:
    """doc_id and the figures of the whole text that rules look at; the text is read once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    base = docs.select("doc_id", text.alias("text"), words(F.col("text")).alias("w"), lines.alias("l"))
    n = F.size("w")
    window = lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i"))
    places = F.when(n >= 3, F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)))).otherwise(F.expr("cast(array() as array<int>)"))
    counted = base.select(
        "doc_id", n.cast("bigint").alias("n_words"), F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        _lost("text", F.regexp_replace("text", SYMBOLS, "")).alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("n_dup_lines"), F.size("l").cast("bigint").alias("n_lines"),
        _lost("text", F.regexp_replace("text", "\\p{Lu}+", "")).alias("n_upper"), _lost("text", F.replace(F.col("text"), F.lit("!"), F.lit(""))).alias("n_exclaimed"),
        F.size(F.filter("l", lambda x: F.rlike(x, F.lit(ENDED)))).cast("bigint").alias("n_ended"),
        F.size(F.filter("w", lambda x: F.rlike(x, F.lit(PLAIN)))).cast("bigint").alias("n_plain"),
        F.sort_array(F.transform(places, window)).alias("s"))
    # windows of one hash are neighbours in s; a repeated one equals the one before or after it
    same = lambda x, k: (F.get("s", k - 1)["h"] == x["h"]) | (F.get("s", k + 1)["h"] == x["h"])
    repeated = counted.withColumn("p", F.sort_array(F.transform(F.filter("s", same), lambda x: x["i"]))).drop("s")
    covered = F.transform("p", lambda x, k: F.least(F.coalesce(F.get("p", k + 1) - x, F.lit(3)), F.lit(3)))
    return repeated.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, x: a + x)).drop("p")


def _lost(text: str, shorter: Column) -> Column:
    return (F.length(text) - F.length(shorter)).cast("bigint")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes from figures. Shares are taken as products, so a text without words or lines needs no case of its own."""
    c = F.col
    return {
        "v_symbols": _vote(c("n_symbols") * 50 <= c("n_words"), c("n_symbols") * 5 > c("n_words")),
        "v_plain": _vote(c("n_plain") * 10 >= c("n_words") * 8, c("n_plain") * 10 < c("n_words") * 6),
        "v_upper": _vote(c("n_upper") * 10 <= c("word_chars"), c("n_upper") * 10 > c("word_chars") * 4),
        "v_exclaimed": _vote(c("n_exclaimed") * 50 <= c("n_words"), c("n_exclaimed") * 4 > c("n_words")),
        "v_dup_lines": _vote(c("n_dup_lines") * 20 <= c("n_lines"), c("n_dup_lines") * 10 > c("n_lines") * 3),
        "v_repeated": _vote(c("n_repeat_words") * 10 <= c("n_words") * 2, c("n_repeat_words") * 10 > c("n_words") * 4),
        "v_ended": _vote(c("n_ended") * 2 >= c("n_lines"), c("n_ended") * 5 < c("n_lines")),
        "v_length": _vote(c("word_chars").between(3 * c("n_words"), 9 * c("n_words")), (c("word_chars") > 15 * c("n_words")) | (c("word_chars") < 2 * c("n_words"))),
    }


def posterior(model: dict, names: list[str]) -> Column:
    """Probability of quality given the votes."""
    odds = F.lit(model["prior"])
    for r in names:
        for v in (-1, 1):
            odds = odds + F.when(F.col(r) == v, F.lit(model[r, v])).otherwise(0.0)
        odds = odds + F.when(F.col(r) == 0, F.lit(model[r, 0])).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def fit(voted: DataFrame, names: list[str]) -> dict:
    """Log odds that each vote speaks for quality, and the prior's. Only one row of sums comes to the driver per step."""
    patterns = cut(voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")))
    majority = sum((F.col(r) for r in names), F.lit(0))
    q, last = 1 / (1 + F.exp(-majority.cast("double"))), None
    model = {"prior": 0.0} | {(r, v): float(v) for r in names for v in (-1, 0, 1)}
    for _ in range(STEPS):
        sums = [F.sum(F.when(F.col(r) == v, w * F.col("n")).otherwise(0.0)).alias(f"{r}{v}{k}") for r in names for v in (-1, 0, 1) for k, w in (("g", q), ("b", 1 - q))]
        row = patterns.agg(F.sum(q * F.col("n")).alias("g"), F.sum((1 - q) * F.col("n")).alias("b"), *sums).head()
        if row["g"] is None:
            return model
        share = lambda r, v, k: (row[f"{r}{v}{k}"] + SMOOTHING) / (row[k] + 3 * SMOOTHING)
        model = {(r, v): math.log(share(r, v, "g") / share(r, v, "b")) for r in names for v in (-1, 0, 1)}
        model["prior"] = math.log((row["g"] + SMOOTHING) / (row["b"] + SMOOTHING))
        if last and all(abs(model[k] - last[k]) < SETTLED for k in model):
            break
        q, last = posterior(model, names), model
    return model


def judge(docs: DataFrame) -> DataFrame:
    """Figures, votes, ``base_failed``, ``quality`` (posterior probability) and ``kept`` per row."""
    votes = rules()
    voted = cut(figures(docs).withColumns(votes))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    names = list(votes)
    model = fit(voted.filter(~failed), names)
    return voted.withColumn("base_failed", failed).withColumn("quality", posterior(model, names)) \
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
