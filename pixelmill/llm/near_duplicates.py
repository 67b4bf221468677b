"""Near-duplicate documents by order min-hash, verified by banded alignment.

A text is its sequence of five-word shingles, each labelled with its number of occurrence. For every table the ``SAMPLED`` labelled
shingles of least hash are kept in text order and hashed together, so two texts share a sketch when they share these shingles in the
same order: sensitive to edits, not only to the set of shingles. Similarity is that of alignment: with c shingles matched in
order, c / (n1 + n2 - c), at least 0.8. An alignment that reaches it leaves at most (n1 + n2) / 9 shingles unmatched, which bounds its
band; the longest common subsequence inside the band is found with bit vectors.

Equal texts are one node. Inside a bucket no pairs are formed: members are compared with the bucket's leader, the node that shares
most buckets over all tables (the hub of a group of copies), ties broken by a hash per table. A bucket whose members that never led
are still of several components elects its next leader, and so on while more than one in ``PAYS`` of those compared with its last one joined it,
whatever other buckets find; what then is open is compared by an exact prefix filter over its rarest shingles, so a crowd hides no pair. A second
family of buckets, keyed by two successive tables, has leaders of its own. A round forms at most one pair per node and bucket.

Edge cases: equal texts always share a class; a NULL text is a class of its own per doc_id; a text of fewer than five words is one
shingle; a text without a word is only like texts equal to it; rows that repeat get the same class; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.llm.common import bounded, cut, mix, shingles, unused, word_hashes
from pixelmill.llm.components import components

WORDS, SIMILARITY = 5, 0.8
TABLES, SAMPLED = 12, 2
PAYS = 10  # members compared per one that joins the leader, up to which a bucket elects another; so small a share of rows is no round
_WIDE = 1 << 19  # hash values computed at once
_PER_TASK = 200_000  # tested pairs read by one task
_SEEDS = mix(np.arange(1, TABLES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def labelled(ids: np.ndarray) -> np.ndarray:
    """Shingle hashes made distinct by their number of occurrence."""
    order = np.argsort(ids, kind="stable")
    s = ids[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    count = np.empty(len(s), np.uint64)
    count[order] = (np.arange(len(s)) - first).astype(np.uint64)
    return ids + count * np.uint64(0xA24BAED4963EE407)


def sketch(text: str | None) -> np.ndarray:
    """One order min-hash per table, then one per pair of successive tables; empty for a text without a word."""
    return _sketch(shingles(word_hashes(text or ""), WORDS))


def _sketch(ids: np.ndarray) -> np.ndarray:
    if not len(ids):
        return ids.view(np.int64)
    ids = labelled(ids)
    take = min(SAMPLED, len(ids))
    step = max(1, _WIDE // len(ids))
    chosen = []
    for at in range(0, TABLES, step):
        h = mix(ids[None, :] ^ _SEEDS[at : at + step, None])
        chosen.append(np.argpartition(h, take - 1, axis=1)[:, :take])
    at = np.sort(np.concatenate(chosen), axis=1)  # back in text order
    h = _SEEDS.copy()
    for j in range(take):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + ids[at[:, j]])
    return np.concatenate([h, mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + np.roll(h, -1))]).view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches, "text"):
        ids = [shingles(word_hashes(t or ""), WORDS) for t in batch["text"].to_pylist()]
        found = [_sketch(x) for x in ids]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        values = np.concatenate(found) if found else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["node"], pa.array([len(x) for x in ids], pa.int32()), lists], ["doc_id", "node", "size", "sketch"])


def matched(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence of a and b over cells at most ``band`` off the diagonal, one bit-vector step per row."""
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b.tolist()):
        where.setdefault(x, []).append(j)
    width = 2 * band + 1
    full = (1 << width) - 1
    v, low, count = full, -band, 0  # bit j of v: column low + j; a zero bit is a step of the row's running match count
    for i, x in enumerate(a.tolist()):
        if i:
            count += not v & 1 and low >= 0
            v = (v >> 1) | (1 << (width - 1))
            low += 1
        hits = where.get(x)
        if hits:
            m = 0
            for j in hits:
                if low <= j < low + width:
                    m |= 1 << (j - low)
            if m:
                u = v & m
                v = ((v + u) | (v - u)) & full
    n_left = max(0, min(width, len(b) - low))
    tail = v & ((1 << n_left) - 1)
    return count + n_left - tail.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Ordered share of common shingles; exact when it is at least ``least``, otherwise some value below it."""
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    if min(n, m) < least * max(n, m):
        return 0.0
    k = min(n, m)
    differ = np.flatnonzero(a[:k] != b[:k])
    head = int(differ[0]) if len(differ) else k
    x, y = a[head:], b[head:]
    k = min(len(x), len(y))
    differ = np.flatnonzero(x[len(x) - k :][::-1] != y[len(y) - k :][::-1])
    tail = int(differ[0]) if len(differ) else k
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    common = head + tail
    if len(x) and len(y):
        # as many of the rest must match as are missing; equal shingles bound that from above
        need = least / (1 + least) * (n + m) - common - 1e-9
        if min(len(x), len(y)) < need or np.isin(x, y).sum() < need or np.isin(y, x).sum() < need:
            return 0.0
        common += matched(x, y, int((1 - least) / (1 + least) * (n + m)) + 1)
    return common / (n + m - common)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, ids_a = None, None
    for batch in bounded(batches, "text_b"):
        keep = []
        for i in range(batch.num_rows):
            a = batch["a"][i].as_py()
            if a != last:  # pairs of one leader follow each other as the join emits them
                last, ids_a = a, shingles(word_hashes(batch["text_a"][i].as_py()), WORDS)
            keep.append(similarity(ids_a, shingles(word_hashes(batch["text_b"][i].as_py()), WORDS)) >= SIMILARITY - 1e-9)
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in "abuv"), pa.array(keep, pa.bool_())], [*"abuv", "alike"])


def _text_key():
    own = F.concat(F.lit("null:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.unhex(F.md5(F.when(F.col("text").isNull(), own).otherwise(F.concat(F.lit("text:"), F.col("text"))).cast("binary")))


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """(t, h, node, size, w, tie) of the buckets with several members. w: members of all buckets of a node, high for the hub of a
    group."""
    entries = nodes.select("node", "size", F.posexplode("sketch").alias("t", "h"))
    shared = entries.groupBy("t", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = cut(entries.join(shared, ["t", "h"]))
    weight = members.groupBy("node").agg(F.sum("n").alias("w"))
    return cut(members.join(weight, "node").select("t", "h", "node", "size", "w", F.xxhash64("t", "node").alias("tie")))


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b") \
        .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "u", "v", "text_a", "text_b")


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches, "text", 1 << 20):
        ids = [mix(labelled(shingles(word_hashes(t or ""), WORDS))) for t in batch["text"].to_pylist()]
        size = np.array([len(x) for x in ids], np.int64)
        row = pa.array(np.repeat(np.arange(len(ids)), size))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids).view(np.int64)), pa.array(np.repeat(size, size)), batch["node"].take(row), batch["root"].take(row)],
                                         ["s", "size", "node", "root"])


def rare_pairs(left: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, u, v) of every pair of ``left`` (node, root) of different roots that can be alike: an exact prefix filter.

    All shingles have one order: first those that a single root has, which link nothing, then the others by number of nodes. Two texts of the
    similarity share a shingle among the first (1 - SIMILARITY) n + 1 of both, and the first one they share leaves enough behind it in both.
    So a text with a fifth of its own shingles has nothing to look for. The pairs of a shingle are formed within neighbouring classes of length
    only, a step of the similarity wide, and only where what is left of both texts can still reach it."""
    held = left.join(texts, "node").select("node", "root", "text")
    every = held.mapInArrow(_shingles, "s bigint, size bigint, node binary, root binary")
    own = F.xxhash64("root")
    several = every.groupBy("s").agg(F.count(F.lit(1)).alias("n"), (F.min(own) < F.max(own)).alias("open")).filter("open").select("s", "n")
    met = every.join(several, "s")
    by_node = Window.partitionBy("node")
    at = F.col("size") - F.count(F.lit(1)).over(by_node) + F.row_number().over(by_node.orderBy("n", "s")) - 1
    entries = met.withColumn("at", at).filter(F.col("at") <= F.col("size") - F.ceil(F.col("size") * SIMILARITY - 1e-9))
    entries = cut(entries.select("s", "at", "size", "node", "root", F.floor(F.log("size") / -math.log(SIMILARITY)).alias("class")))
    x = entries.select("s", F.explode(F.array(*[F.col("class") + k for k in (-1, 0, 1)])).alias("class"), *(F.col(c).alias(f"{c}_u") for c in ("node", "root", "size", "at")))
    y = entries.select("s", "class", *(F.col(c).alias(f"{c}_v") for c in ("node", "root", "size", "at")))
    need = (F.col("size_u") + F.col("size_v")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-9
    rest = F.least(F.col("size_u") - F.col("at_u"), F.col("size_v") - F.col("at_v"))
    near = F.least("size_u", "size_v") >= F.greatest("size_u", "size_v") * SIMILARITY - 1e-9
    can = (x["s"] == y["s"]) & (x["class"] == y["class"]) & (F.col("root_u") > F.col("root_v")) & near & (rest >= need)
    return x.join(y, can).select(F.least("node_u", "node_v").alias("a"), F.greatest("node_u", "node_v").alias("b"),
                                 F.col("root_u").alias("u"), F.col("root_v").alias("v")).distinct()


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root) of the nodes that share a bucket with some other one; ``docs`` has (node, text).

    In every round each busy bucket elects its next leader, which leaves it once members of other components are compared with it. So what is left in a
    bucket was never compared with each other, and a bucket where that is one component is settled. A bucket stays busy by the share of its own
    members that join; once few rows are in busy buckets, what is left in unsettled ones is compared by ``rare_pairs``, so no pair that shares a
    bucket stays open, and how much is left grows with the groups themselves. The new links of a round join the roots of its components only. A
    pair whose numbers of shingles differ by more than the similarity allows moves no text."""
    nothing = F.lit(None).cast("binary")
    rows = shared_buckets(nodes)
    ids = cut(rows.select("node").distinct())
    rows = rows.select("*", *(nothing.alias(c) for c in ("was", "a_node", "a_was", "a_root")))
    texts = cut(docs.join(ids, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")))
    roots = ids.select("node", F.col("node").alias("root"))
    tested = None
    while True:
        rows = rows.join(roots, "node").withColumn("led", F.coalesce(F.col("node") == F.col("a_node"), F.lit(False)))
        rest = F.when(~F.col("led"), F.col("root"))
        other = F.col("was") != F.col("a_was")
        pays = F.count_if(other & (F.col("root") == F.col("a_root"))) * PAYS > F.count_if(other) if tested is not None else F.lit(True)
        buckets = rows.groupBy("t", "h").agg((F.min(rest) < F.max(rest)).alias("open"), pays.alias("busy")).filter("open").select("t", "h", "busy")
        rows = cut(rows.filter(~F.col("led")).join(buckets, ["t", "h"]).select("t", "h", "node", "size", "w", "tie", "root", "busy"))
        share = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("busy").alias("busy")).head()
        if share["busy"] * PAYS <= share["rows"]:
            break
        busy = rows.filter("busy")
        led = busy.groupBy("t", "h").agg(F.max(F.struct("w", "tie", "node", "root", "size")).alias("last"))
        leaders = cut(led.select("t", "h", *(F.col(f"last.{c}").alias(f"a_{c}") for c in ("node", "root", "size"))))
        near = F.least("size", "a_size") >= F.greatest("size", "a_size") * SIMILARITY - 1e-9
        pairs = busy.join(leaders, ["t", "h"]).filter((F.col("root") != F.col("a_root")) & near) \
            .select(F.least("a_node", "node").alias("a"), F.greatest("a_node", "node").alias("b"),
                    F.greatest("a_root", "root").alias("u"), F.least("a_root", "root").alias("v")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        done = cut(with_texts(pairs, texts).mapInArrow(_alike, "a binary, b binary, u binary, v binary, alike boolean"))
        new = done.filter("alike").select("u", "v")
        count = done.agg(F.count(F.lit(1)).alias("pairs"), F.count_if("alike").alias("links")).head()
        own = done.select("a", "b").coalesce(1 + count["pairs"] // _PER_TASK)  # few pairs in few files
        tested = own if tested is None else tested.union(own)
        if count["links"]:
            moved = components(new).select(F.col("node").alias("root"), F.col("root").alias("to"))
            roots = cut(roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        after = leaders.join(roots.select(F.col("node").alias("a_node"), F.col("root").alias("a_now")), "a_node")
        after = after.select("t", "h", "a_node", F.col("a_root").alias("a_was"), F.col("a_now").alias("a_root"))
        rows = rows.withColumnRenamed("root", "was").drop("busy").join(after, ["t", "h"], "left")
    left = cut(rows.select("node", "root").distinct())
    if left.isEmpty():
        return roots
    both = with_texts(rare_pairs(left, texts).join(tested, ["a", "b"], "left_anti"), texts)
    new = cut(both.mapInArrow(_alike, "a binary, b binary, u binary, v binary, alike boolean").filter("alike").select("u", "v"))
    moved = components(new).select(F.col("node").alias("root"), F.col("root").alias("to"))
    return cut(roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")))


def _rooted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) per row, and (node, root, first, n) per node: the root of its class, its least doc_id and its number of rows."""
    keyed = docs.select("doc_id", "text", _text_key().alias("node"))
    rows = cut(keyed.mapInArrow(_sketches, "doc_id bigint, node binary, size int, sketch array<bigint>"))
    nodes = rows.groupBy("node").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    nodes = cut(nodes)
    roots = links(keyed.select("node", "text"), nodes.select("node", "size", "sketch"))
    rooted = cut(nodes.select("node", "first", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    return rows.select("doc_id", "node"), rooted


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, node, class_id, class_size) per row: class_id is the least doc_id of the class, class_size its number of rows."""
    rows, rooted = _rooted(docs)
    sizes = rooted.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("n").alias("class_size"))
    by_node = rooted.join(sizes, "root").select("node", "class_id", "class_size")
    return rows.join(by_node, "node").select("doc_id", "node", "class_id", "class_size")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of every class with the columns of ``docs``: that of least doc_id, NULL last; among texts of one doc_id, that of least key. Of
    rows equal in doc_id and text one is kept."""
    _, rooted = _rooted(docs)
    least = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "node")).alias("least")
    kept = rooted.groupBy("root").agg(least).select(F.col("least.first").alias("_d"), F.col("least.node").alias("_n"))
    key = unused(docs, "_node")
    keyed = docs.withColumn(key, _text_key())
    found = keyed.join(kept.hint("shuffle_hash"), keyed["doc_id"].eqNullSafe(kept["_d"]) & (keyed[key] == kept["_n"]), "left_semi")
    return found.dropDuplicates(["doc_id", key]).select(*docs.columns)
