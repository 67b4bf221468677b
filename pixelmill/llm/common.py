"""Helpers shared by the text operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelmill.checkpoints import checkpoint_folder, cut  # noqa: F401

#: White space between words: space and the five controls from tab to carriage return.
SPACE = "[\\x20\\x09-\\x0D]+"


def unused(df: DataFrame, name: str) -> str:
    """A column name that a DataFrame doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def widened(df: DataFrame, **added: T.DataType) -> T.StructType:
    """Schema of a DataFrame with further columns."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, t) for k, t in added.items())])


def words(text: Column) -> Column:
    """Array of the words of a text; NULL has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    """Number of words as bigint."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    ends = (F.element_at(parts, 1) == "").cast("int") + (F.element_at(parts, -1) == "").cast("int")
    # an empty text splits into one empty part, text of white space only into one or two
    return F.greatest(F.size(parts) - ends, F.lit(0)).cast("bigint")


# ---- numpy side: 64-bit hashes of words without a Python object per word

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64 bits (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}
_KEPT_POWERS = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; tables of up to a million entries are kept."""
    have = _powers[base]
    if len(have) < n:
        size = max(n, 1 << 14)
        step = np.full(size, base, np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if size <= _KEPT_POWERS:
            _powers[base] = have
    return have[:n]


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash per word, from differences of a running polynomial over the bytes."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_IS_SPACE[raw]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * powers(_BASE, len(raw)), out=run[1:])
    return mix((run[end] - run[start]) * powers(_INVERSE, len(raw))[start] + (end - start).astype(np.uint64))


def shingles(ids: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of every k successive words; a shorter text is one shingle of all its words."""
    if not len(ids):
        return ids
    k = min(k, len(ids))
    n = len(ids) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x100000001B3) + ids[j : j + n]
    return mix(out)


def bounded(batches, column: str, size: int = 4 << 20):
    """Cut Arrow batches so that each holds about ``size`` bytes of a text column, or one longer text."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths, dtype=np.int64) // size
        edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)
