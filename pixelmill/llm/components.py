"""Connected components of a table of links, as DataFrame rounds of alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pixelmill.llm.common import cut

FEW = 200_000  # links that one task may hold


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the least of u and its neighbours."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the least of them; every link has u > v."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _joined(schema: pa.Schema):
    """Least node of the component of every node of one table of links, by joining sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def least(x):
            top = x
            while up[top] != top:
                top = up[top]
            while up[x] != top:
                up[x], x = top, up[x]
            return top

        for batch in batches:
            for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist()):
                up.setdefault(u, u)
                up.setdefault(v, v)
                a, b = least(u), least(v)
                if a != b:
                    up[max(a, b)] = min(a, b)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, schema.field("node").type), pa.array([least(x) for x in nodes], schema.field("root").type)], schema=schema)

    return run


def _state(e: DataFrame):
    return e.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).head()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; ``links`` has columns u, v of one ordered type. The root is the least node.

    Each round contracts stars, so the number of rounds grows with the logarithm of the longest chain. Stops when nothing moves. At most ``FEW`` links
    are joined by one task instead, with the same result: a round costs more than they do."""
    e = cut(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(e)
    if state[0] <= FEW:
        kind = e.schema["u"].dataType
        schema = T.StructType([T.StructField("node", kind), T.StructField("root", kind)])
        return cut(e.coalesce(1).mapInArrow(_joined(to_arrow_schema(schema)), schema))
    while True:
        e = cut(_small_star(_large_star(e)))
        new = _state(e)
        if new == state:
            roots = e.select("v").distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("v", "v"))
        state = new
