"""Bradley-Terry ranking: plain recounts of features, differences for the gradient, held-out labels, odd rows."""

import itertools
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pixelmill.llm import ranking

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, score string, predicted string, quality int, _id int, x int"
SPACE = " \t\n\x0b\x0c\r"


def cls(c):
    return next((k for k, chars in enumerate(ranking._CLASSES) if c in chars), 0) if ord(c) < 256 else 0


def plain(text):
    """Features by counting one by one."""
    out = np.zeros(ranking.N_FEATURES)
    if not text:
        return out
    n2 = ranking.N_CLASSES**2
    for a, b in itertools.pairwise(text):
        out[cls(a) * ranking.N_CLASSES + cls(b)] += 1
    out[:n2] = np.sqrt(out[:n2] / max(1, len(text) - 1))
    words = "".join(" " if c in SPACE else c for c in text).split(" ")
    words = [w for w in words if w]
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    n = len(words)
    trigrams = list(zip(words, words[1:], words[2:]))
    out[n2:] = [math.log1p(n) / 10, math.log1p(n) ** 2 / 100, min(len(text) / n / 10, 10) if n else 0,
                sum(a == b for a, b in itertools.pairwise(words)) / (n - 1) if n > 1 else 0, 1 - len(set(words)) / n if n else 0,
                1 - len(set(trigrams)) / len(trigrams) if trigrams else 0, 1 - len(set(lines)) / len(lines) if lines else 0,
                math.log1p(n / max(1, len(lines))) / 10, math.log1p(len(lines)) / 10]
    return out


@pytest.mark.parametrize("text", ["", " ", "\n\n", "a", "One two two.\nOne two two.\n\n|x| #$%! ÄÖ é中\x0b(z)", "la la la " * 50, "W" * 500])
def test_features(text):
    assert np.allclose(ranking.features(text), plain(text))


def test_features_in_parts(monkeypatch):
    text = "Some words here, some there.\nAnd 12 more! " * 30
    whole = ranking.features(text)
    monkeypatch.setattr(ranking, "CHUNK", 37)
    assert np.allclose(ranking.features(text), whole)


def test_gradient_and_least_loss():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 5))
    good, bad = ranking.pairs(25, 15)
    assert set(good) == set(range(25)) and set(bad) == set(range(15))
    bad = bad + 25
    w = rng.normal(size=5)
    _, g = ranking.loss(w, x, good, bad)
    for k in range(5):
        e = np.zeros(5)
        e[k] = 1e-6
        assert abs((ranking.loss(w + e, x, good, bad)[0] - ranking.loss(w - e, x, good, bad)[0]) / 2e-6 - g[k]) < 1e-6
    direct = np.mean([math.log1p(math.exp(-(x[i] - x[j]) @ w)) for i, j in zip(good, bad)]) + ranking.RIDGE * w @ w
    assert abs(direct - ranking.loss(w, x, good, bad)[0]) < 1e-9
    best = ranking.descend(x, good, bad)
    assert all(ranking.loss(best, x, good, bad)[0] <= ranking.loss(best + 0.05 * d, x, good, bad)[0] for d in np.eye(5))


def test_quantile_limit():
    label = np.array([0, 1, 0, 1, 1, 1])
    s = np.array([-3.0, 1, -1, 2, 3, 4])
    assert ranking.quantile_limit(s, label, 2, 4) == 0
    assert ranking.quantile_limit(s, label, 1, 100) == 0  # the sample counts by label sizes
    assert ranking.quantile_limit(np.array([-3.0, -2, 0, 4]), np.array([0, 1, 0, 1]), 2, 2) == -1
    assert ranking.quantile_limit(np.array([5.0]), np.array([1]), 0, 9) == 5


def known(sf):
    import duckdb

    return duckdb.connect().execute(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall()


def test_held_out_labels(spark):
    quality = dict(known(SF))
    rows = entry.queries()["op13_bradley_terry"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    test = [r for r in rows if r.held_out and r.doc_id in quality]
    assert len(test) > 50 and sum(r.predicted == quality[r.doc_id] for r in test) >= 0.95 * len(test)


def test_query_equals_plain_scores(spark):
    """The rows of the query from plain features and the model fitted once more from them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    quality = dict(known(SF))
    train = sorted((r.doc_id, quality[r.doc_id], r.text) for r in docs if r.doc_id in quality and zlib.crc32(str(r.doc_id).encode()) % 5)
    y = np.array([q for _, q, _ in train])
    assert max((y == 0).sum(), (y == 1).sum()) < ranking.PER_LABEL
    model = ranking.train(np.array([plain(t) for _, _, t in train]), y, (y == 0).sum(), (y == 1).sum())
    want = {r.doc_id: float(model.from_ranks(np.array([plain(r.text) @ model.weights]))[0]) for r in docs[:150]}
    got = {r.doc_id: r.score for r in entry.queries()["op13_bradley_terry"](spark, SF).collect()}
    assert all(abs(got[k] - v) < 1e-6 for k, v in want.items())


ODD = [(1, None), (2, ""), (3, " \n "), (4, "one"), (4, "one"), (None, "no id"), (7, "x" * 3000), (8, "la la " * 300_000), (9, "é▁ \r\n ü|#!")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", "p", 0, 1, 2) for i, t in rows], DOCS)


def labels(spark, rows):
    return spark.createDataFrame([(i, q, 0, "t") for i, q in rows], "doc_id bigint, quality int, toxic int, text string")


def test_odd_rows(spark):
    given = frame(spark, ODD)
    model = ranking.fit(given, labels(spark, [(i, k % 2) for k, (i, _) in enumerate(ODD)] + [(4, 1), (4, 0), (None, 0), (5, None), (9, 7)]))
    rows = ranking.scored(given, model, out=("s2", "p2")).collect()
    assert len(rows) == len(ODD) and all(0 <= r.s2 <= 1 and r.p2 == (r.s2 >= 0.3) and r.score == "s" for r in rows)
    by = {}
    for r in rows:
        assert by.setdefault(r.text or "", r.s2) == r.s2
    assert ranking.scored(frame(spark, []), model, out=("s2", "p2")).count() == 0


@pytest.mark.parametrize("rows", [[], [(4, 1), (7, 1)], [(4, 0)], [(None, 0), (None, 1)]])
def test_nothing_to_learn(spark, rows):
    got = ranking.scored(frame(spark, ODD), ranking.fit(frame(spark, ODD), labels(spark, rows)), out=("s2", "p2")).collect()
    assert {(r.s2, r.p2) for r in got} == {(0.3, 1)}


def test_null_key_is_not_held_out(spark):
    assert [r.h for r in frame(spark, [(None, "a")]).select(ranking.held_out(F.col("doc_id")).alias("h")).collect()] == [False]


def test_every_label_teaches(spark):
    """Blocks hold every labelled document once at home, a rare label is in each block, and the weights are those of least loss over all blocks."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join("Aa1.,!"[k] * (1 + k) for k in rng.integers(0, 6, 12)) + ("!" if i % 20 else ".")) for i in range(400)]
    marks = [(i, int(i % 20 == 0)) for i in range(400)]
    docs, given = frame(spark, rows), labels(spark, marks)
    table = [ranking._opened(r) for r in ranking.blocks(docs, given, per_label=50).collect()]
    assert len(table) > 4 and sum(int(home.sum()) for _, home, _ in table) == 400 and all(n == 20 for n, _, _ in table)
    home = np.concatenate([x[h] for _, h, x in table])
    assert np.allclose(np.sort(home.sum(axis=1)), np.sort([plain(t).sum() for _, t in rows]))
    model = ranking.fit(docs, given, per_label=50)
    mean, scale = home.mean(axis=0), ranking.scale_of(home.std(axis=0))
    parts = [((x - mean) * scale, *ranking.pairs(n, len(x) - n), n) for n, _, x in table]
    w = np.where(scale > 0, model.weights / np.where(scale > 0, scale, 1), 0)
    n_pairs = sum(len(g) for _, g, _, _ in parts)
    total = lambda w: sum(np.logaddexp(0, -((x @ w)[g] - (x @ w)[b + n])).sum() for x, g, b, n in parts) / n_pairs + ranking.RIDGE * w @ w
    assert all(total(w) <= total(w + e * d) for d in np.eye(len(w))[scale > 0] for e in (-0.01, 0.01))
    s = np.sort(home @ model.weights)
    assert abs(model.shift - (s[379] + s[380]) / 2) < 1e-9
