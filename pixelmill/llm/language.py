"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams are summed per language on the executors. The log-probability matrix (``BUCKETS`` rows, one column
per language) is broadcast; its size depends on the number of languages only. A batch of texts is scored as a sparse matrix: the
n-grams that occur pick their rows of the matrix and are summed per text.

Edge cases: NULL or letterless text is ``und`` with score 0; so is every text when nothing could be learned. Ties go to the first
language by code point. Rows that repeat are scored each; other columns pass through. A NULL doc_id is not held out and teaches nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelmill.llm.common import bounded, widened

BUCKETS = 1 << 16
ORDERS = 3
CHUNK = 1 << 19  # code points scored at once
#: Bound of the training sample: expected labelled texts per language, chosen by key hash.
TEXTS_PER_LANGUAGE = 4000
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def held_out(key: Column) -> Column:
    """True for the quarter of documents that is never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def buckets(codes: np.ndarray) -> list[np.ndarray]:
    """Hash bucket of the 1-, 2- and 3-gram that starts at each code point; codes end with two pads."""
    n = len(codes) - ORDERS + 1
    h = np.zeros(n, np.uint32)
    out = []
    for k, factor in enumerate((2654435761, 2246822519, 3266489917)):
        h = (h ^ codes[k : k + n]) * np.uint32(factor)
        h ^= h >> np.uint32(15)
        out.append(((h * np.uint32(668265263 + 2 * k)) >> np.uint32(16)).astype(np.int32))
    return out


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, starts, index of the text) in chunks of bounded size; long texts are cut with the overlap that n-grams need."""
    parts, starts, owner, size = [], [], [], 0

    def done():
        flat = np.frombuffer("".join([*parts, "  "]).encode("utf-32-le", "surrogatepass"), np.uint32)
        return flat, np.array(starts), np.array(owner)

    for i, text in enumerate(texts):
        text = f" {text.lower()}  "
        for at in range(0, len(text) - 2, CHUNK):
            part = text[at : at + CHUNK + 2]
            parts.append(part)
            starts.append(size)
            owner.append(i)
            size += len(part)
            if size >= CHUNK:
                yield done()
                parts, starts, owner, size = [], [], [], 0
    if parts:
        yield done()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    n_texts: dict[str, int] = {}
    for batch in bounded(batches, "text"):
        by_language: dict[str, list[str]] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            by_language.setdefault(lang, []).append(text)
        for lang, texts in by_language.items():
            n_texts[lang] = n_texts.get(lang, 0) + len(texts)
            count = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for codes, _, _ in _pieces(texts):
                for b in buckets(codes):
                    count += np.bincount(b, minlength=BUCKETS)
    for lang, count in total.items():
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(count[at], n_texts[lang]))],
            ["lang", "bucket", "n"])


class Model:
    """Languages in code point order, their log priors, and the matrix of log probabilities."""

    def __init__(self, langs: list[str], priors: np.ndarray, matrix: np.ndarray):
        self.langs, self.priors, self.matrix = langs, priors, matrix

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = [i for i, t in enumerate(texts) if t is not None and self.langs and _LETTER.search(t)]
        logs = np.tile(self.priors.astype(np.float64), (len(known), 1))
        for codes, starts, owner in _pieces([texts[i] for i in known]):
            for b in buckets(codes):
                np.add.at(logs, owner, np.add.reduceat(self.matrix[b], starts, axis=0, dtype=np.float64))
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if known:
            best = logs.argmax(axis=1)
            score[known] = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            for i, k in zip(known, best):
                lang[i] = self.langs[k]
        return lang, score


def fit(labelled: DataFrame, key: str = "doc_id", per_language: int = TEXTS_PER_LANGUAGE) -> Model:
    """Learn from (key, text, lang) rows. About ``per_language`` texts of each language are read, those of smallest key hash."""
    rows = labelled.filter(F.col(key).isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    if not sizes:
        return Model([], np.zeros(0), np.zeros((BUCKETS, 0), np.float32))
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))]), F.col("lang"))
    draw = (F.xxhash64(F.lit("language"), F.col(key)) / F.lit(2.0**64)) + 0.5
    counted = rows.filter(draw <= share).select("lang", "text").mapInArrow(_counts, "lang string, bucket int, n bigint")
    found = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS + 1 rows per language
    langs = sorted(found["lang"].unique(), key=lambda s: s.encode())
    matrix, priors = np.full((BUCKETS, len(langs)), 0.5), np.zeros(len(langs))
    for k, lang in enumerate(langs):
        own = found[(found["lang"] == lang) & (found["bucket"] >= 0)]
        matrix[own["bucket"].to_numpy(), k] += own["n"].to_numpy()
        priors[k] = np.log(float(sizes[lang]))
    matrix = np.log(matrix / matrix.sum(axis=0))
    return Model(langs, priors - np.log(np.exp(priors).sum()), matrix.astype(np.float32))


def identify(docs: DataFrame, model: Model, text: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add the predicted language of each whole text and its posterior probability; no other column is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.priors, model.matrix))
    schema = widened(docs, **{out[0]: T.StringType(), out[1]: T.DoubleType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in bounded(batches, text):
            lang, score = own.score(batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], [*batch.schema.names, *out])

    return docs.mapInArrow(run, schema)
