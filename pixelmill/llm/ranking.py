"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

A document of label 1 is preferred to one of label 0. The chance that document a is preferred to b is the logistic function of s(a) - s(b), where
s is linear in the features of a text; the weights minimise the logistic loss on feature differences over preference pairs, with a small
ridge. Only differences count, so s has no zero point: the limit between the labels is the quantile of s that the share of label 0 demands,
and the score is the logistic function of s less that limit, shifted so that the limit lies at ``LIMIT``.

Features come from the text alone, the whole of it: shares of pairs of successive character classes, and what words and lines repeat. Every labelled
document teaches: documents are dealt by key hash into blocks of about ``PER_LABEL`` documents of the commoner label, ``PARTNERS`` pairs are formed per
document inside its block, and each Newton step sums the loss, its gradient and its curvature over all blocks. Documents of a rare label are dealt into
several blocks, so that each block has ``LEAST`` of them. The limit is an exact quantile over all of them. Scoring is one pass over the documents with a
fixed table of weights.

Edge cases: a NULL text is an empty one, and an empty text has a score like any other; rows that repeat are scored each, equal texts equally; a NULL
doc_id is not held out and teaches nothing; a label other than 0 and 1 is none; a document given several times under one key teaches once per
label; without documents of both labels every score is ``LIMIT``, which predicts 1; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelmill.llm.common import bounded, cut, widened, word_hashes
from pixelmill.operators import ranks

#: Expected documents of the commoner label that meet in one block.
PER_LABEL = 4000
LEAST = 64  # documents of the rarer label in a block
PARTNERS = 16  # preference pairs per document of a block
LIMIT = 0.3
CHUNK = 1 << 20  # code points looked at once
STEPS, RIDGE = 60, 1e-4
_PAIRS = 8192  # pairs whose differences are held at once

# classes of code points: other letters, small, capital, digit, white space, line end, then marks
_CLASSES = ["", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".", ",", "!", "?", ":;", "'\"`", "()[]{}", "|", "#*$%&<>", "-_/\\@=+~^"]
N_CLASSES = len(_CLASSES)
_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate(_CLASSES):
    for _c in _chars:
        _CLASS[ord(_c)] = _k
EXTRA = 9
N_FEATURES = N_CLASSES**2 + EXTRA


def held_out(key: Column) -> Column:
    """True for the fifth of documents whose labels are never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CLASS[np.where(codes < 256, codes, 255)]


def _parts(text: str) -> Iterator[str]:
    """The text in parts of bounded size, cut at white space where there is some."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            space = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = space + 1 if space > at else end
        yield text[at:end]
        at = end


def _repeated(x: np.ndarray) -> float:
    """Share of entries equal to an earlier one."""
    return 1 - len(np.unique(x)) / len(x) if len(x) else 0.0


def features(text: str | None) -> np.ndarray:
    """Features of a whole text."""
    out = np.zeros(N_FEATURES)
    text = text or ""
    if not text:
        return out
    pairs, last, ids = np.zeros(N_CLASSES**2, np.int64), None, []
    for part in _parts(text):
        c = _classes(part).astype(np.int64)
        if last is not None:
            pairs[last * N_CLASSES + c[0]] += 1
        last = int(c[-1])
        pairs += np.bincount(c[:-1] * N_CLASSES + c[1:], minlength=len(pairs))
        ids.append(word_hashes(part))
    out[: len(pairs)] = np.sqrt(pairs / max(1, pairs.sum()))
    words = np.concatenate(ids)
    n = len(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    out[len(pairs) :] = (
        np.log1p(n) / 10, np.log1p(n) ** 2 / 100, min(len(text) / n / 10, 10.0) if n else 0.0, float((words[1:] == words[:-1]).mean()) if n > 1 else 0.0, _repeated(words),
        _repeated(words[2:] * np.uint64(3) + words[1:-1] * np.uint64(5) + words[:-2]) if n > 2 else 0.0, 1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0,
        np.log1p(n / max(1, len(lines))) / 10, np.log1p(len(lines)) / 10)
    return out


class Model:
    """Weights of s, and the score at which the labels part."""

    def __init__(self, weights: np.ndarray, shift: float):
        self.weights, self.shift = weights, shift

    def score(self, texts: list[str | None]) -> np.ndarray:
        s = np.array([features(t) @ self.weights for t in texts])
        return self.from_ranks(s)

    def from_ranks(self, s: np.ndarray) -> np.ndarray:
        """Scores of values of s; exactly LIMIT where s is the limit."""
        return 1 / (1 + np.exp(-np.clip(s - self.shift, -700, 700)) * ((1 - LIMIT) / LIMIT))


def pairs(n_good: int, n_bad: int, partners: int = PARTNERS) -> tuple[np.ndarray, np.ndarray]:
    """Preference pairs (good, bad): every document meets about ``partners`` of the other label, spread evenly."""
    n = max(n_good, n_bad)
    i = np.tile(np.arange(n), partners)
    turn = np.repeat(np.arange(partners), n)
    rng = np.random.default_rng(13)
    good = rng.permutation(n_good)[i % n_good]
    bad = rng.permutation(n_bad)[(i + turn * max(1, n_bad // partners)) % n_bad]
    return good, bad


def loss(weights: np.ndarray, x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean logistic loss on feature differences of the pairs, with ridge, and its gradient."""
    s = x @ weights
    d = s[good] - s[bad]
    pull = -1 / (1 + np.exp(np.clip(d, -700, 700))) / len(d)
    each = np.bincount(good, pull, len(x)) - np.bincount(bad, pull, len(x))
    return float(np.logaddexp(0, -d).mean() + RIDGE * weights @ weights), x.T @ each + 2 * RIDGE * weights


def curvature(weights: np.ndarray, x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Number of pairs, and the sums over them of the logistic loss, its gradient and its second derivatives, as one array."""
    n = x.shape[1]
    s = x @ weights
    d = s[good] - s[bad]
    lost = 1 / (1 + np.exp(np.clip(d, -700, 700)))
    each = np.bincount(bad, lost, len(x)) - np.bincount(good, lost, len(x))
    h = np.zeros((n, n))
    root = np.sqrt(lost * (1 - lost)).astype(np.float32)
    short = x.astype(np.float32)  # only the length of a step depends on the second derivatives
    for at in range(0, len(d), _PAIRS):
        some = slice(at, at + _PAIRS)
        part = (short[good[some]] - short[bad[some]]) * root[some, None]
        h += part.T @ part
    return np.concatenate([[len(d), np.logaddexp(0, -d).sum()], each @ x, h.ravel()])


def newton(summed: Callable[[np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """Weights of least loss. ``summed`` gives ``curvature`` over all pairs; a step that raises the loss is halved."""
    w = step = np.zeros(n)
    last = math.inf
    for _ in range(STEPS):
        count, lost, *_ = parts = summed(w)
        value = lost / count + RIDGE * w @ w
        if value > last + 1e-12:
            step = step / 2
            w = w + step
            continue
        last = value
        step = np.linalg.solve(parts[2 + n :].reshape(n, n) / count + 2 * RIDGE * np.eye(n), parts[2 : 2 + n] / count + 2 * RIDGE * w)
        if np.abs(step).max() < 1e-9:
            break
        w = w - step
    return w


def descend(x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Weights of least loss of the pairs of one table."""
    return newton(lambda w: curvature(w, x, good, bad), x.shape[1])


def quantile_limit(s: np.ndarray, label: np.ndarray, n_bad: float, n_good: float) -> float:
    """Value of s below which the share of label 0 lies, midway between neighbours; the rows count by the size of their labels."""
    weight = np.where(label == 1, n_good / max(1, (label == 1).sum()), n_bad / max(1, (label == 0).sum()))
    order = np.argsort(s, kind="stable")
    upto = np.cumsum(weight[order])
    k = int(np.argmin(np.abs(upto - n_bad)))  # what lies up to k comes nearest to the share
    if k + 1 == len(s):
        return float(s[order[k]])
    return float((s[order[k]] + s[order[k + 1]]) / 2)


def scale_of(std: np.ndarray) -> np.ndarray:
    """Factor that gives a feature the deviation 1; 0 for a constant one."""
    return np.where(std > 1e-9, 1 / np.maximum(std, 1e-9), 0)


def train(x: np.ndarray, label: np.ndarray, n_bad: float, n_good: float) -> Model:
    """Model from the features and labels of one block and the sizes of the labels at large."""
    if not (label == 0).any() or not (label == 1).any():
        return Model(np.zeros(N_FEATURES), 0.0)
    mean, scale = x.mean(axis=0), scale_of(x.std(axis=0))
    z = (x - mean) * scale
    good, bad = pairs(int((label == 1).sum()), int((label == 0).sum()))
    w = descend(z, np.flatnonzero(label == 1)[good], np.flatnonzero(label == 0)[bad]) * scale
    return Model(w, quantile_limit(x @ w, label, n_bad, n_good))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches, "text"):
        found = [features(t) for t in batch["text"].to_pylist()]
        lists = pa.array([f.tolist() for f in found], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["quality"], lists], ["doc_id", "quality", "x"])


def _block(rows: pa.Table) -> pa.Table:
    """The rows of a block as one: features of label 1, then of label 0, and which of them are at home here."""
    rows = rows.sort_by([("quality", "descending"), ("doc_id", "ascending")])
    x = rows["x"].combine_chunks().flatten().to_numpy()
    n_good = int(rows["quality"].to_numpy().sum())
    home = (rows["copy"].to_numpy() == 0).astype(np.uint8)
    return pa.table({"n_good": pa.array([n_good], pa.int32()), "home": pa.array([home.tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary())})


def _opened(row) -> tuple[int, np.ndarray, np.ndarray]:
    return row["n_good"], np.frombuffer(row["home"], bool), np.frombuffer(row["x"]).reshape(-1, N_FEATURES)


def _sums(row) -> np.ndarray:
    """Documents of label 1 and 0 that are at home in the block, and the sums of their features."""
    n_good, home, x = _opened(row)
    return np.concatenate([[home[:n_good].sum(), home[n_good:].sum()], x[home].sum(axis=0)])


def _block_curvature(row, w: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    n_good, _, x = _opened(row)
    if n_good in (0, len(x)):
        return np.zeros(2 + len(w) + len(w) ** 2)
    good, bad = pairs(n_good, len(x) - n_good)
    return curvature(w, (x - mean) * scale, good, bad + n_good)


def blocks(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """(n_good, home, x) per block of the labelled documents of ``docs``, all of them."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)) \
        .select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality")).distinct()
    sizes = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    n = max(1, math.ceil(max(sizes.values(), default=0) / per_label))
    copies = {q: min(n, math.ceil(LEAST * n / max(1, sizes.get(q, 0)))) for q in (0, 1)}  # 1 for a label that is not rare
    rows = docs.select("doc_id", "text").join(known.hint("shuffle_hash"), F.col("doc_id") == F.col("_id")).select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality", "text")
    found = rows.mapInArrow(_features, "doc_id bigint, quality int, x array<double>").groupBy("doc_id", "quality").agg(F.min("x").alias("x"))
    last = F.when(F.col("quality") == 1, copies[1] - 1).otherwise(copies[0] - 1)
    dealt = found.withColumn("copy", F.explode(F.sequence(F.lit(0), last)))
    dealt = dealt.withColumn("block", F.pmod(F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(n)) + F.col("copy"), F.lit(n)))
    return cut(dealt.repartition(n, "block").groupBy("block").applyInArrow(_block, "n_good int, home binary, x binary"))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Learn from the texts of ``docs`` (doc_id, text) and ``labels`` (doc_id, quality). What reaches the driver are sums of the size of the weights and
    their second derivatives."""
    table = blocks(docs, labels, per_label)
    if table.isEmpty():
        return Model(np.zeros(N_FEATURES), 0.0)

    def summed(part: Callable) -> np.ndarray:
        return table.rdd.map(part).treeReduce(np.add)

    n_good, n_bad, *total = summed(_sums)
    n = n_good + n_bad
    if not n_good or not n_bad:
        return Model(np.zeros(N_FEATURES), 0.0)
    mean = np.array(total) / n

    def squares(row) -> np.ndarray:
        _, home, x = _opened(row)
        return ((x[home] - mean) ** 2).sum(axis=0)

    scale = scale_of(np.sqrt(summed(squares) / n))
    w = newton(lambda w: summed(lambda row: _block_curvature(row, w, mean, scale)), N_FEATURES) * scale

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, home, x = _opened(row)
                yield pa.RecordBatch.from_arrays([pa.array(x[home] @ w)], ["s"])

    # as many lie below the limit as have label 0; midway between neighbours
    limit = ranks.quantiles(cut(table.mapInArrow(ranked, "s double")), "s", [(n_bad - 0.5) / (n - 1)]).head()["q"][0]
    return Model(w, limit)


def scored(docs: DataFrame, model: Model, out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Add score and predicted label of each whole text; no other column is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.shift))
    schema = widened(docs, **{out[0]: T.DoubleType(), out[1]: T.IntegerType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in bounded(batches, "text"):
            score = own.score(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= LIMIT).astype(np.int32))], [*batch.schema.names, *out])

    return docs.mapInArrow(run, schema)
