"""The manifest against plain recursion, its log against postorder, and odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.llm import merkle

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, idx int, block int, digest string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text):
    return sha(*(enc(v) for v in (row[0], row[3], row[2], row[4], text)))


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def way(tree, i):
    """Nodes left and right of the way up from leaf i, level by level."""
    out = []
    for nodes in tree[:-1]:
        a = i // 8 * 8
        out.append((nodes[a:i], nodes[i + 1 : a + 8]))
        i //= 8
    return out


def plain(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    leaves = {x: sorted(((r[0] is not None, r[0] or 0, leaf(r, r[1])), r) for r in rows if r[2] == x) for x in langs}
    trees = {x: levels([k[2] for k, _ in leaves[x]]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    out = []
    for j, x in enumerate(langs):
        for i, (key, r) in enumerate(leaves[x]):
            sides = way(trees[x], i) + way(top, j)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = leaf(r, lower(r[1])) if bad else key[2]
            for a, b in sides:
                node = sha(*a, node, *b)
            out.append((r[0], key[2], trees[x][-1][0], top[-1][0], sha(*(n for a, b in sides for n in a + b)), node, node == top[-1][0]))
    return out


def made(n, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(n)]), rng.choice([None, "", "Ab c", "ÄB é x" * 20, "low"]), rng.choice([None, "", "en", "de", "é"] + ["en"] * 5),
             rng.choice([None, "a"]), rng.choice([None, 3]), "t", 1, 2, "d") for _ in range(n)]
    return rows + rows[: n // 10]


def result(spark, rows):
    got = merkle.manifest(spark.createDataFrame(rows, DOCS))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(repr, map(tuple, got.collect())))


@pytest.mark.parametrize("n", [1, 2, 9, 700])
def test_against_recursion(spark, n):
    rows = made(n, n)
    assert result(spark, rows) == sorted(map(repr, plain(rows)))


def test_several_stages(spark, monkeypatch):
    """Small blocks, so that a tree needs several stages; many languages, so that the upper tree does as well."""
    monkeypatch.setattr(merkle, "HEIGHT", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = [(i, f"Text {i}", "en" if i % 3 else f"l{i % 40}", None, i, "t", 1, 2, "d") for i in range(900)]
    assert result(spark, rows) == sorted(map(repr, plain(rows)))


def test_long_texts_and_no_rows(spark):
    rows = [(i, "Word " * 400_000, "en", "s", None, "t", 1, 2, "d") for i in range(3)] + [(None, None, None, None, None, None, None, None, None)]
    assert result(spark, rows) == sorted(map(repr, plain(rows)))
    assert result(spark, []) == []


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65, 73, 512, 600])
def test_positions_are_postorder(n):
    top = merkle.height(n)
    order = []

    def visit(level, j):
        if level:
            for child in range(8 * j, min(8 * j + 8, merkle.width(n, level - 1))):
                visit(level - 1, child)
        order.append((level, j))

    visit(top, 0)
    for level in range(top + 1):
        assert [order[p] for p in merkle.position(level, np.arange(merkle.width(n, level)), n, top)] == [(level, j) for j in range(merkle.width(n, level))]


def test_log_over_stages(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = [(i, f"Text {i}", "en" if i < 301 else None, None, i, "t", 1, 2, "d") for i in range(310)]
    log = merkle.Manifest(spark.createDataFrame(rows, DOCS)).log().collect()
    for lang, n in (("en", 301), (None, 9)):
        own = sorted((r.position, r.level, r.idx, r.digest) for r in log if r.lang == lang)
        tree = levels([leaf(r, r[1]) for r in rows if r[2] == lang])
        assert [p for p, *_ in own] == list(range(sum(map(len, tree))))
        assert all(tree[level][j] == digest for _, level, j, digest in own)
        assert [p for p, level, j, _ in own] == sorted(int(merkle.position(level, j, n, merkle.height(n))) for _, level, j, _ in own)


def test_equals_sql(spark):
    import duckdb

    from pixelmill.llm.oracles import MERKLE

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = merkle.manifest(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, con.execute(MERKLE).fetchall()))
    assert got.filter(F.col("folded_root").isNull()).isEmpty()
