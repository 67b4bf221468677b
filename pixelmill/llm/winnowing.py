"""Document fingerprints by winnowing.

Every ``GRAM`` successive code points have a rolling hash; of every ``WINDOW`` successive hashes the least is chosen, of equal ones
the rightmost. Positions are kept. Texts that share a stretch of at least GRAM + WINDOW - 1 code points share a chosen hash there, and
no match shorter than GRAM counts. The likeness of two fingerprints is the share of distinct hashes in common (Dice).

The order of all documents is by falling doc_id. Rows are dealt by ranges of doc_id and read in order, each range ending with a copy
of the first row of the next one, so each text moves once and nobody needs a global order.

Edge cases: NULL text is empty; an empty text has an empty fingerprint, which is like another empty one (1) and unlike all others (0); a
text shorter than GRAM is one gram, and one with fewer hashes than WINDOW is one window; a NULL doc_id comes last; rows of one doc_id
are ordered by text; a single row follows itself; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import _BASE, _INVERSE, bounded, mix, powers

GRAM, WINDOW = 16, 40
_PLACE_BITS = 20  # a hash of 44 bits and its place share one integer, so that a minimum also decides ties
_SPAN = (1 << _PLACE_BITS) - GRAM - WINDOW
_RANGES_PER_PARTITION = 4


def _chosen(codes: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    run = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(codes)), out=run[1:])
    n = len(codes) - gram + 1
    h = mix((run[gram:] - run[:n]) * powers(_INVERSE, n)) >> np.uint64(_PLACE_BITS)
    last = np.uint64((1 << _PLACE_BITS) - 1)
    key = (h << np.uint64(_PLACE_BITS)) | (last - np.arange(n, dtype=np.uint64))
    w = min(window, n)
    blocks = np.full(-(-n // w) * w, ~np.uint64(0))
    blocks[:n] = key
    blocks = blocks.reshape(-1, w)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(down[: n - w + 1], up[w - 1 : n])
    least = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return least >> np.uint64(_PLACE_BITS), (last - (least & last)).astype(np.int64)


def fingerprint(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their places, in text order."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    gram = min(gram, len(codes))
    found = []
    for at in range(0, max(1, len(codes) - gram - window + 2), _SPAN):  # every window lies in one part
        h, p = _chosen(codes[at : at + _SPAN + gram + window - 2], gram, window)
        found.append((h, p + at))
    h, p = (np.concatenate(x) for x in zip(*found))
    new = np.concatenate([[True], p[1:] != p[:-1]])
    return h[new], p[new]


def written(mark: tuple[np.ndarray, np.ndarray]) -> str:
    return ",".join(f"{h:011x}:{p}" for h, p in zip(mark[0].tolist(), mark[1].tolist()))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    x, y = set(a[0].tolist()), set(b[0].tolist())
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0


def in_falling_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _range, _guest) in partitions that hold whole ranges in falling order of doc_id; after its own rows a range holds
    the rows of the first doc_id of the next range (after the last range: of the first) as guests."""
    spark = docs.sparkSession
    n = _RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_id", F.col("doc_id").cast("double"))
    probs = F.expr("array(" + ",".join(f"{k / n!r}D" for k in range(1, n)) + ")")
    cuts = ids.agg(F.percentile_approx("_id", probs, F.lit(4 * n)).alias("c")).head()["c"] or [0.0]  # as many as there are ranges
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="_id", outputCol="_b", handleInvalid="keep").transform(ids)
    last = len(splits) - 1
    ranged = ranged.withColumn("_range", F.when(F.col("doc_id").isNull(), last).otherwise(last - 1 - F.col("_b")).cast("int")).drop("_b", "_id")
    firsts = sorted((r["_range"], r["m"]) for r in ranged.groupBy("_range").agg(F.max("doc_id").alias("m")).collect())  # one row per range
    before = [(firsts[k][0], firsts[k][1], firsts[k - 1][0]) for k in range(len(firsts))]
    firsts = F.broadcast(spark.createDataFrame(before, "_r int, _first bigint, _before int"))
    own = F.struct(F.col("_range"), F.lit(False).alias("_guest"))
    guest = F.struct(F.col("_before").alias("_range"), F.lit(True).alias("_guest"))
    placed = ranged.join(firsts, F.col("_range") == F.col("_r")) \
        .withColumn("_places", F.when(F.col("doc_id").eqNullSafe(F.col("_first")), F.array(own, guest)).otherwise(F.array(own)))
    return placed.select("doc_id", "text", F.inline("_places")).repartition("_range") \
        .sortWithinPartitions("_range", "_guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")


SCHEMA = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: fingerprints of the text and of the edited text, whose last third is the start of the next document instead."""

    def one(doc_id, text, mark, next_text, next_mark):
        m = len(text) // 3
        edited = text[: len(text) - m] + next_text[:m]
        edited_mark = fingerprint(edited)
        return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), written(mark), written(edited_mark),
                likeness(mark, edited_mark), likeness(mark, next_mark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                            ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
        waiting = None
        for batch in bounded(batches, "text"):
            out = []
            for doc_id, text, where, guest in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "_range", "_guest"))):
                if guest and waiting is None:
                    continue  # a further row of the guest's doc_id
                mark = fingerprint(text)
                if waiting is not None:
                    out.append(one(*waiting, text, mark))
                waiting = None if guest else (doc_id, text, mark)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return in_falling_order(docs).mapInArrow(run, SCHEMA)
