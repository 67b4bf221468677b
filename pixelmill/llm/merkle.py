"""Merkle manifest of a dataset, written as a postorder append log by aligned builders.

Every row is a leaf. The leaves of a language, in order of doc_id, form one tree of ``FAN`` children per node, the roots of these trees
form the tree above, whose root covers the dataset. A builder takes ``BLOCK`` consecutive nodes whose first index is a multiple of
``BLOCK`` and appends every node to its segment of the log as soon as its children are complete, which is postorder. What a builder
leaves is one node of the next stage, so a tree of any size has about log(n) / log(BLOCK) stages, and no task holds more than a block.

Nothing in the log points anywhere: where a node lies follows from the sizes of the subtrees before it (``position``), so the siblings that
prove a leaf are read from its segment by computed places, and those further up come down stage by stage, one short path per block.

Edge cases: rows of equal language and doc_id follow each other by leaf hash; NULL languages are a tree of their own, the first; a NULL doc_id
comes first in its tree and is never tampered with; a tree of one leaf has that leaf as its root, and so has a dataset of one tree; equal
rows are leaves each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.llm.common import cut

FAN = 8
HEIGHT = 4  # levels that one builder completes
BLOCK = FAN**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


# ---- hashes

def encoded(value: Column) -> Column:
    """A value as its number of UTF-8 bytes, a colon and itself; a dash for NULL."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(text: Column) -> Column:
    """Hash of a row that has the given text."""
    return F.sha2(F.concat(*[encoded(text if c == "text" else F.col(c)) for c in FIELDS]), 256)


def tampered(key: Column) -> Column:
    """The third of the rows whose text is altered to try the proofs."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def digest(*parts: str) -> str:
    h = hashlib.sha256()
    for p in parts:
        h.update(p.encode())
    return h.hexdigest()


# ---- shape of a tree

def width(n: int, level: int) -> int:
    """Nodes of a level of a tree of n leaves."""
    return -(-n // FAN**level)


def height(n: int) -> int:
    """Levels above the leaves until one node remains."""
    h = 0
    while width(n, h) > 1:
        h += 1
    return h


def position(level, index, n: int, top: int):
    """Place in postorder of a node of a tree of n leaves and ``top`` levels above them; vectorized over ``index``.

    Before a node come all nodes of its own and lower levels that end no later than it, and all nodes of higher levels that end where it begins."""
    index = np.asarray(index, np.int64)
    begin, end = index * FAN**level, np.minimum((index + 1) * FAN**level, n)
    before = np.zeros_like(index)
    for k in range(top + 1):
        if k <= level:
            before += np.where(end == n, width(n, k), end // FAN**k)
        else:
            before += begin // FAN**k
    return before - 1


def segment(leaves: list[str], top: int) -> list[str]:
    """All nodes over some leaves up to level ``top``, in order of completion."""
    log: list[str] = []
    open_nodes: list[list[str]] = [[] for _ in range(top + 1)]

    def complete(level: int, node: str) -> None:
        log.append(node)
        open_nodes[level].append(node)
        if level < top and len(open_nodes[level]) == FAN:
            close(level)

    def close(level: int) -> None:
        children, open_nodes[level] = open_nodes[level], []
        complete(level + 1, digest(*children))

    for leaf in leaves:
        complete(0, leaf)
    for level in range(top):
        if open_nodes[level]:
            close(level)
    return log


def _top(n: int, above: int) -> int:
    """Levels that the builder of a block of n nodes completes; ``above`` tells that the tree has further blocks."""
    return HEIGHT if above else height(n)


def paths(log: list[str], n: int, top: int, lefts: list[str], rights: list[str]):
    """Per leaf of a segment: the siblings left and right of its way up, level by level, ending with those given for the block."""
    ways = [(lefts, rights)]
    for level in range(top - 1, -1, -1):
        here = [log[p] for p in position(level, np.arange(width(n, level)), n, top)]
        down = []
        for j in range(len(here)):
            first = j // FAN * FAN
            up = ways[j // FAN]
            down.append((["".join(here[first:j]), *up[0]], ["".join(here[j + 1 : first + FAN]), *up[1]]))
        ways = down
    return ways


def fold(node: str, lefts: list[str], rights: list[str]) -> str:
    """Root that follows from a leaf and its siblings."""
    for left, right in zip(lefts, rights):
        node = digest(left, node, right)
    return node


# ---- Spark

def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Add ``idx``, the place of a row in its tree, and ``n``, the rows of the tree.

    Rows are dealt by ranges of (tree, order), so a tree that holds most rows is spread; a row's place is that in its partition plus the rows of
    the tree in earlier partitions, of which there is one count per partition and tree."""
    sorted_rows = cut(rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order))
    placed = sorted_rows.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_at"))
    parts = placed.groupBy(tree, "_p").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(tree).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut(parts.select(tree, "_p", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                             F.sum("_n").over(Window.partitionBy(tree)).alias("n")))
    return placed.join(parts, [tree, "_p"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_p", "_at", "_shift")


def _build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    table = table.sort_by("idx")
    n = table["n"][0].as_py()
    log = segment(table["digest"].to_pylist(), _top(table.num_rows, n > BLOCK))
    return pa.table({"tree": [key[0].as_py()], "block": [key[1].as_py()], "n": pa.array([n], pa.int64()),
                     "size": pa.array([table.num_rows], pa.int64()), "log": pa.array([log], pa.list_(pa.string()))})


def stages(nodes: DataFrame) -> list[DataFrame]:
    """Segments of the log, one DataFrame (tree, block, n, size, log) per stage, from (tree, idx, n, digest) of the leaves."""
    out: list[DataFrame] = []
    while True:
        grouped = nodes.withColumn("block", F.floor(F.col("idx") / BLOCK)).groupBy("tree", "block")
        built = cut(grouped.applyInArrow(_build, "tree string, block bigint, n bigint, size bigint, log array<string>"))
        out.append(built)
        nodes = built.filter(F.col("n") > BLOCK).select("tree", F.col("block").alias("idx"), F.ceil(F.col("n") / BLOCK).alias("n"),
                                                        F.element_at("log", -1).alias("digest"))
        if nodes.isEmpty():
            return out


def roots(built: list[DataFrame]) -> DataFrame:
    """(tree, digest) of the last node of every tree."""
    last = [s.filter(F.col("n") <= BLOCK).select("tree", F.element_at("log", -1).alias("digest")) for s in built]
    out = last[0]
    for s in last[1:]:
        out = out.union(s)
    return out


_WAY = "tree string, idx bigint, lefts array<string>, rights array<string>"


def _descend(key: tuple[pa.Scalar, ...], own: pa.Table, above: pa.Table) -> pa.Table:
    """Ways of the nodes of a segment, which are the blocks of the stage below."""
    size, first = own["size"][0].as_py(), key[1].as_py() * BLOCK
    ways = paths(own["log"][0].as_py(), size, _top(size, own["n"][0].as_py() > BLOCK), above["lefts"][0].as_py(), above["rights"][0].as_py())
    strings = pa.list_(pa.string())
    return pa.table({"tree": [key[0].as_py()] * size, "idx": pa.array(range(first, first + size), pa.int64()),
                     "lefts": pa.array([w[0] for w in ways], strings), "rights": pa.array([w[1] for w in ways], strings)})


def _meet(left: DataFrame, ways: DataFrame):
    """Rows of a block together with the way of that block."""
    own = ways.select(F.col("tree").alias("tree"), F.col("idx").alias("block"), "lefts", "rights")  # under a name of its own, as both sides may stem from one table
    return left.groupBy("tree", "block").cogroup(own.groupBy("tree", "block"))


def ways_down(built: list[DataFrame], above: DataFrame, keep: int = 0) -> DataFrame:
    """(tree, idx, lefts, rights) of the blocks of stage ``keep``, from the ways of the trees' roots (tree, lefts, rights)."""
    ways = None
    for k in range(len(built) - 1, keep - 1, -1):
        here = built[k].filter(F.col("n") <= BLOCK).select("tree", "block").join(above, "tree").select("tree", F.col("block").alias("idx"), "lefts", "rights")
        ways = here if ways is None else ways.union(here)
        if k > keep:
            ways = cut(_meet(built[k], ways).applyInArrow(_descend, _WAY))
    return ways


def _prove(key: tuple[pa.Scalar, ...], rows: pa.Table, own: pa.Table) -> pa.Table:
    rows = rows.sort_by("idx")
    size = rows.num_rows
    ways = paths(own["log"][0].as_py(), size, _top(size, own["n"][0].as_py() > BLOCK), own["lefts"][0].as_py(), own["rights"][0].as_py())
    proofs, folded = [], []
    for (lefts, rights), leaf in zip(ways, rows["other"].to_pylist()):
        proofs.append(digest(*(x for pair in zip(lefts, rights) for x in pair)))
        folded.append(fold(leaf, lefts, rights))
    return pa.table({"doc_id": rows["doc_id"], "leaf": rows["digest"], "subroot": pa.array(own["subroot"].to_pylist() * size, pa.string()),
                     "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string())})


class Manifest:
    """Trees of a table: ``leaves`` (tree, doc_id, digest, other, idx, n), the segments of the language trees and of the tree above."""

    def __init__(self, docs: DataFrame):
        text = F.col("text")
        other = F.when(tampered(F.col("doc_id")), leaf_hash(F.translate(text, _UPPER, _UPPER.lower()))).otherwise(leaf_hash(text))
        # the empty name stands for NULL, so that it comes first
        rows = cut(docs.select(F.coalesce(F.concat(F.lit("/"), F.col("lang")), F.lit("")).alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"),
                               leaf_hash(text).alias("digest"), other.alias("other")))
        self.leaves = cut(ranked(rows, "tree", ["doc_id", "digest"]))
        self.built = stages(self.leaves.select("tree", "idx", "n", "digest"))
        self.subroots = cut(ranked(roots(self.built).select(F.lit("").alias("top"), F.col("tree").alias("name"), "digest"), "top", ["name"]))
        self.top = stages(self.subroots.select(F.col("top").alias("tree"), "idx", "n", "digest"))

    def root(self) -> str | None:
        """Hash of the dataset; None without rows."""
        found = roots(self.top).head()  # the only row
        return found["digest"] if found else None

    def log(self) -> DataFrame:
        """The append log of the language trees, (lang, position, level, idx, digest) per node; positions are those of the whole tree's postorder."""

        def nodes(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    n, leaves, stage = row["size"], row["leaves"], row["stage"]
                    top = _top(n, row["n"] > BLOCK)
                    for level in range(min(stage, 1), top + 1):  # leaves of a later stage are in the log already
                        j = np.arange(width(n, level))
                        idx = j + row["block"] * FAN ** (HEIGHT - level)
                        yield pa.RecordBatch.from_pydict({
                            "lang": pa.array([row["tree"][1:] if row["tree"] else None] * len(j), pa.string()),
                            "position": position(HEIGHT * stage + level, idx, leaves, height(leaves)),
                            "level": pa.array([HEIGHT * stage + level] * len(j), pa.int64()), "idx": idx,
                            "digest": [row["log"][p] for p in position(level, j, n, top)]})

        n_leaves = self.leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("leaves"))
        out = None
        for k, s in enumerate(self.built):
            part = s.join(n_leaves, "tree").withColumn("stage", F.lit(k))
            out = part if out is None else out.union(part)
        return out.mapInArrow(nodes, "lang string, position bigint, level bigint, idx bigint, digest string")

    def proofs(self) -> DataFrame:
        """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row: what the siblings of a leaf hash to, and the root that follows from
        the possibly altered row and these siblings."""
        none = F.array().cast("array<string>")
        top = roots(self.top).select("tree", none.alias("lefts"), none.alias("rights"))
        blocks = ways_down(self.top, top)
        names = _meet(self.top[0], blocks).applyInArrow(_descend, _WAY)
        trees = cut(self.subroots.select("idx", F.col("name").alias("tree"), F.col("digest").alias("subroot"))
                    .join(names.select("idx", "lefts", "rights"), "idx"))
        ways = ways_down(self.built, trees.select("tree", "lefts", "rights"))
        own = self.built[0].join(ways.withColumnRenamed("idx", "block"), ["tree", "block"]).join(trees.select("tree", "subroot"), "tree")
        rows = self.leaves.withColumn("block", F.floor(F.col("idx") / BLOCK))
        found = rows.groupBy("tree", "block").cogroup(own.groupBy("tree", "block")).applyInArrow(
            _prove, "doc_id bigint, leaf string, subroot string, proof_sha256 string, folded_root string")
        root = self.root()
        return found.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root",
                            F.coalesce(F.col("folded_root") == F.lit(root), F.lit(False)).alias("verified"))


def manifest(docs: DataFrame) -> DataFrame:
    """Leaf, proof and verdict per row."""
    return Manifest(docs).proofs()
