"""Chat formatting after cumulative-snapshot collapse.

Logs often hold a conversation once per turn, each snapshot a prefix of the next. Every conversation gets a rolling hash per turn:
the hash of a prefix is that of the hash before it, the role and the text. A conversation whose last hash is a proper prefix hash of
another (at the same turn number) is removed by an anti-join; of equal conversations the one of least conv_id stays. What is left is
rendered.

Turns are ordered by (turn, role, text), so ties have one result; NULL role or text renders as empty, but differs from it when
compared; a NULL conv_id is a conversation of its own; markers inside a text are broken up, so a rendered conversation can be parsed
back; a conversation is one row of the result and is held as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import cut

START, END = "<|im_start|>", "<|im_end|>"


def _turn_key(t: Column) -> Column:
    """Text that tells turns apart: lengths keep role and text from running into each other, NULL has none."""
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.concat(part(t["role"]), F.lit("|"), part(t["text"]))


def rolling(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns, hashes): ordered turns of a conversation and the hash of each of its prefixes."""
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def step(acc, t):
        last = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(""))
        return F.concat(acc, F.array(F.md5(F.concat(last, _turn_key(t)).cast("binary"))))

    return turns.withColumn("hashes", F.aggregate("turns", F.expr("cast(array() as array<string>)"), step))


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns, copies): conversations that no other one continues, one of each, and how many rows were equal to it."""
    rows = cut(rolling(conversations))
    keyed = rows.withColumn("n", F.size("turns")).withColumn("h", F.element_at("hashes", -1))
    # equal conversations meet in a count first, so a common one does not meet its copies in the anti-join
    whole = keyed.groupBy("n", "h").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    prefixes = keyed.select(F.posexplode(F.slice("hashes", F.lit(1), F.col("n") - 1)).alias("n", "h")).select((F.col("n") + 1).alias("n"), "h").distinct()
    kept = whole.join(prefixes, ["n", "h"], "left_anti")
    return kept.join(rows.select(F.col("conv_id").alias("_c"), "turns"), F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", "turns", "copies")


def render(conversations: DataFrame, start: str = START, end: str = END) -> DataFrame:
    """Add ``rendered``: every turn as start, role, line end, text, end, line end."""
    def clean(c):
        plain = F.coalesce(c, F.lit(""))
        for mark in (start, end):
            plain = F.replace(plain, F.lit(mark), F.lit(mark[:1] + " " + mark[1:]))
        return plain

    one = lambda t: F.concat(F.lit(start), clean(t["role"]), F.lit("\n"), clean(t["text"]), F.lit(end + "\n"))
    return conversations.withColumn("rendered", F.array_join(F.transform("turns", one), ""))
