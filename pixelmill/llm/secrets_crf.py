"""Secret scans: base patterns, and a linear-chain conditional random field that adds spans.

A line is a chain of tokens (runs of letters, digits and ``+/_-``; every other mark is one token), tagged begin, inside or
outside. Scores of a token are sums of weights of its shape (length, kinds of characters, changes between them), of the marks next to it,
of the word before it, and of the file (share of digits). Everything about tokens is computed on arrays over many texts at once. Outside
scores zero, so a line in which no token could pay for two changes of tag is outside throughout: only the other lines are
decoded by Viterbi, which gives the same tags as decoding all of them.

The field is fitted on a bounded sample of texts (``SAMPLE`` expected, chosen by key hash): lines with base spans, and a share of the
others, by gradient ascent on the likelihood. Without any base span in the sample nothing is added.

Edge cases: NULL text is empty and has no spans; rows that repeat get equal spans; a NULL doc_id passes through; spans are in code points,
end exclusive; spans of one start are ordered by kind; an added span never overlaps a base span; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import _BASE, _INVERSE, bounded, mix, powers

# The base patterns and the least length of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
KINDS = ("assign", "access", "hex", "crf")
#: Words that every match of ASSIGN holds one of; a text without them needs no search.
_HINTS = ("passw", "secret", "token", "key")
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of HEX that are long enough

SAMPLE = 6000
OTHER_LINES = 0.02  # share of the sample's lines without a span that are learned from
SEQUENCES, LENGTH, STEPS = 2000, 64, 50

Span = tuple[int, int, int]  # start, number of the kind, end


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by start, then kind."""
    found: list[Span] = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(found)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# ---- tokens and features over arrays of code points

_SPACE, _RUN, _MARK = 0, 1, 2
_class = np.full(128, _MARK, np.uint8)
_class[:33] = _SPACE
_class[127] = _SPACE
_kind = np.zeros(129, np.uint8)  # bits: digit, upper, lower, other letter, joining mark, hex letter or digit
for _c in range(128):
    _s = chr(_c)
    if _s.isalnum() or _s in "+/_-":
        _class[_c] = _RUN
    _kind[_c] = _s.isdigit() | _s.isupper() << 1 | _s.islower() << 2 | (_s in "+/_-") << 4 | (_s not in "0123456789abcdef") << 5
_kind[128] = 8 | 32
_mark = np.full(129, 1, np.uint8)  # 0 none, 1 other mark or word, then the marks that stand around values
for _n, _s in enumerate(("\"'`", "=", ":", ".,;!?", "<>()[]{}", "|#*$%&")):
    for _c in _s:
        _mark[ord(_c)] = 2 + _n
_LENGTHS = np.array([2, 3, 5, 8, 12, 16, 20, 32, 64])
_WORDS = 1 << 12
_MARKS = 8
#: Sizes of the feature groups, in order: shape, marks on both sides, word before, file.
GROUPS = {"shape": 10 * 64 * 4, "before": _MARKS * _MARKS, "after": _MARKS, "word": _WORDS, "file": 8}
_AT = dict(zip(GROUPS, np.cumsum([0, *GROUPS.values()])[:-1].tolist()))
N_FEATURES = sum(GROUPS.values())


class Tokens:
    """Tokens of several texts put end to end, each followed by a line end."""

    def __init__(self, texts: list[str]):
        codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        small = np.minimum(codes, 128).astype(np.uint8)
        cls = np.append(_class, _RUN)[small]
        new = (cls != _SPACE) & ((cls == _MARK) | (np.concatenate([[_SPACE], cls[:-1]]) != cls))
        self.start = np.flatnonzero(new)
        n = len(self.start)
        ends = np.flatnonzero((cls != _SPACE) & ((cls == _MARK) | (np.concatenate([cls[1:], [_SPACE]]) != cls)))
        self.end = ends + 1
        line = np.cumsum(codes == 10)
        self.line = line[self.start] if n else np.empty(0, np.int64)
        self.base = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.doc = np.searchsorted(self.base, self.start, "right") - 1
        if not n:
            self.features = np.empty((0, len(GROUPS)), np.int64)
            return
        kind = _kind[small]
        over = np.ascontiguousarray(np.stack([self.start, self.end], 1).ravel())
        bits = np.bitwise_or.reduceat(np.append(kind, 0), over)[::2]
        letter = kind & 7
        changes = np.concatenate([[0], np.cumsum(letter[1:] != letter[:-1])])
        turns = changes[self.end - 1] - changes[self.start]
        shape = (np.searchsorted(_LENGTHS, self.end - self.start, "right") * 64 + bits) * 4 + np.searchsorted([1, 3, 6], turns, "right")
        mark = np.where(cls[self.start] == _MARK, _mark[small[self.start]], 1).astype(np.int64)

        def beside(values, k):  # of the k-th token before (or after, when negative) on the same line, 0 where there is none
            out = np.zeros(n, np.int64)
            a, b = (slice(k, None), slice(None, -k)) if k > 0 else (slice(None, k), slice(-k, None))
            out[a] = np.where(self.line[a] == self.line[b], values[b], 0)
            return out

        lower = np.where((codes >= 65) & (codes <= 90), codes + 32, codes).astype(np.uint64)
        run = np.concatenate([[np.uint64(0)], np.cumsum(mix(lower + np.uint64(1)) * powers(_BASE, len(codes)))])
        word = mix((run[self.end] - run[self.start]) * powers(_INVERSE, len(codes) + 1)[self.start])
        word = (word % np.uint64(_WORDS - 1)).astype(np.int64) + 1
        at = np.where(mark == 1, np.arange(n), -1)  # the word before: the nearest token of letters or digits on the line
        last = np.concatenate([[-1], np.maximum.accumulate(at)[:-1]])
        near = (last >= 0) & (np.arange(n) - last <= 5) & (self.line[last] == self.line)
        digits = np.concatenate([[0], np.cumsum((letter & 1) > 0)])
        share = np.diff(digits[np.minimum(self.base, len(codes))]) / np.maximum(np.diff(self.base), 1)
        file = np.searchsorted([0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 0.6], share, "right")
        self.features = np.stack([
            shape + _AT["shape"], beside(mark, 1) * _MARKS + beside(mark, 2) + _AT["before"], beside(mark, -1) + _AT["after"],
            np.where(near, word[last], 0) + _AT["word"], file[self.doc] + _AT["file"]], 1)


# ---- the field: tags outside 0, begin 1, inside 2

FORBIDDEN = -30.0


class Field:
    """Weights (feature, [begin, inside]) and scores of changes between tags; outside weighs nothing."""

    def __init__(self, weights: np.ndarray, change: np.ndarray):
        self.weights, self.change = weights, change

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = self.weights[features[:, 0]].copy()
        for k in range(1, features.shape[1]):
            out += self.weights[features[:, k]]
        return out

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """Best tags of one chain."""
        c = self.change.tolist()
        best, back = [0.0, float(scores[0][0]), FORBIDDEN], []
        for b, i in scores[1:].tolist():
            froms = [max(range(3), key=lambda f: best[f] + c[f][t]) for t in range(3)]  # noqa: B023
            best = [best[f] + c[f][t] + e for t, (f, e) in enumerate(zip(froms, (0.0, b, i)))]
            back.append(froms)
        tag = max(range(3), key=lambda t: best[t])
        tags = [tag]
        for froms in reversed(back):
            tag = froms[tag]
            tags.append(tag)
        return tags[::-1]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Tagged (start, end) per text."""
        found: list[list[tuple[int, int]]] = [[] for _ in texts]
        t = Tokens(texts)
        if not len(t.start) or not self.weights.any():
            return found
        scores = self.scores(t.features)
        gain = max(0.0, float(self.change.max() - self.change[0, 0]))
        bar = np.flatnonzero(scores.max(axis=1) + 2 * gain > 0)
        lines = np.unique(t.line[bar])
        for a, b in zip(np.searchsorted(t.line, lines, "left").tolist(), np.searchsorted(t.line, lines, "right").tolist()):
            tags, k = self.viterbi(scores[a:b]), 0
            while k < len(tags):
                if tags[k]:
                    j = k + 1
                    while j < len(tags) and tags[j] == 2:
                        j += 1
                    doc = int(t.doc[a + k])
                    found[doc].append((int(t.start[a + k] - t.base[doc]), int(t.end[a + j - 1] - t.base[doc])))
                    k = j
                else:
                    k += 1
        return found


def _secret_parts(text: str) -> list[tuple[int, int]]:
    """What base matches hold: the value of an assignment, a whole key or run of hex digits; those inside another one go."""
    spans = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    spans = sorted(spans + [(a, b) for a, k, b in base_spans(text) if k], key=lambda s: (s[0], -s[1]))
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def _training_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of the sample as (features, tags): lines with a span whole up to LENGTH tokens around it, and a share of the others."""
    for batch in bounded(batches, "text"):
        features, tags = [], []
        texts = batch["text"].to_pylist()
        t = Tokens(texts)
        tag = np.zeros(len(t.start), np.int8)
        for d, text in enumerate(texts):
            for a, b in _secret_parts(text):
                i, j = np.searchsorted(t.start, [a + t.base[d], b + t.base[d]])
                if j > i:
                    tag[i], tag[i + 1 : j] = 1, 2
        begins = np.flatnonzero(tag == 1)
        line_begin = np.flatnonzero(np.concatenate([[True], t.line[1:] != t.line[:-1]])) if len(t.start) else np.empty(0, np.int64)
        line_end = np.append(line_begin[1:], len(t.start))
        draw = mix(t.start[line_begin].astype(np.uint64) + np.uint64(batch.num_rows)) / 2.0**64 if len(line_begin) else np.empty(0)
        for a, b, u in zip(line_begin.tolist(), line_end.tolist(), draw.tolist()):
            here = begins[(begins >= a) & (begins < b)] if len(begins) else begins
            if len(here):
                a = max(a, int(here[0]) - LENGTH // 2)
            elif u >= OTHER_LINES:
                continue
            b = min(b, a + LENGTH)
            features.append(t.features[a:b].ravel().astype(np.int32))
            tags.append(tag[a:b].astype(np.int32))
        if features:
            yield pa.RecordBatch.from_arrays([pa.array([x.tolist() for x in features], pa.list_(pa.int32())), pa.array([x.tolist() for x in tags], pa.list_(pa.int32()))],
                                             ["features", "tags"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit on about ``sample`` texts; at most SEQUENCES chains of LENGTH tokens come to the driver, those with spans first."""
    n = docs.count()
    share = min(1.0, sample / max(n, 1))
    drawn = docs.filter(F.col("text").isNotNull() & (F.xxhash64(F.lit("secrets"), F.col("doc_id")) / F.lit(2.0**64) + 0.5 <= share))
    chains = drawn.select("text").mapInArrow(_training_lines, "features array<int>, tags array<int>")
    rows = chains.orderBy(F.array_contains("tags", 1).desc(), F.xxhash64("features")).limit(SEQUENCES).toArrow()
    tags = [np.array(x) for x in rows["tags"].to_pylist()]
    features = [np.array(x).reshape(-1, len(GROUPS)) for x in rows["features"].to_pylist()]
    if not any((x == 1).any() for x in tags):
        return Field(np.zeros((N_FEATURES, 2)), np.zeros((3, 3)))
    # a copy of every span between plain words, so that its shape alone must tell it
    plain = np.array([_AT["before"] + _MARKS + 1, _AT["after"] + 1, _AT["word"]])
    for k in [k for k, x in enumerate(tags) if (x == 1).any()]:
        alone = features[k].copy()
        alone[:, 1:4] = plain
        features.append(alone)
        tags.append(tags[k])
    return train(features, tags)


def train(features: list[np.ndarray], tags: list[np.ndarray], steps: int = STEPS, decay: float = 1e-3) -> Field:
    """Gradient ascent (Adam) on the log likelihood; all chains step together, padded to one length."""
    n, length = len(tags), max(map(len, tags))
    size = np.array([len(x) for x in tags])
    inside = np.arange(length) < size[:, None]
    f = np.zeros((n, length, len(GROUPS)), np.int64)
    y = np.zeros((n, length), np.int64)
    for k in range(n):
        f[k, : size[k]], y[k, : size[k]] = features[k], tags[k]
    change = np.zeros((3, 3))
    change[0, 2] = FORBIDDEN  # inside only follows begin or inside
    free = change == 0
    weights = np.zeros((N_FEATURES, 2))
    gold = np.stack([(y == 1) & inside, (y == 2) & inside], 2).astype(float)
    pairs = np.zeros((3, 3))
    np.add.at(pairs, (y[:, :-1][inside[:, 1:]], y[:, 1:][inside[:, 1:]]), 1)
    state = [(w, np.zeros_like(w), np.zeros_like(w)) for w in (weights, change)]
    for step in range(1, steps + 1):
        e = np.zeros((n, length, 3))
        e[:, :, 1:] = weights[f].sum(axis=2)
        e[:, 0, 2] = FORBIDDEN
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, length):
            alpha[:, t] = np.logaddexp.reduce(alpha[:, t - 1, :, None] + change, axis=1) + e[:, t]
        for t in range(length - 2, -1, -1):
            on = np.logaddexp.reduce(change + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(inside[:, t + 1, None], on, 0.0)
        z = np.logaddexp.reduce(alpha[np.arange(n), size - 1], axis=1)
        mark = np.exp(np.minimum(alpha + beta - z[:, None, None], 0)) * inside[:, :, None]
        expected = np.zeros((3, 3))
        for t in range(1, length):
            p = np.exp(np.minimum(alpha[:, t - 1, :, None] + change + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None], 0))
            expected += (p * inside[:, t, None, None]).sum(axis=0)
        over = (gold - mark[:, :, 1:])[inside]
        grad = np.stack([np.bincount(f[inside].ravel(), np.repeat(over[:, k], len(GROUPS)), N_FEATURES) for k in (0, 1)], 1)
        for (w, m, v), g in zip(state, ((grad / n - decay * weights), (pairs - expected) / n * free)):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            w += 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
    return Field(weights, change)


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added) per row."""
    shared = docs.sparkSession.sparkContext.broadcast((field.weights, field.change))  # N_FEATURES weights, whatever the documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*shared.value)
        for batch in bounded(batches, "text"):
            texts = [t or "" for t in batch["text"].to_pylist()]
            counts, digests, spans, added = [], [], [], []
            for text, more in zip(texts, own.spans(texts)):
                base = base_spans(text)
                counts.append([sum(k == kind for _, k, _ in base) for kind in range(3)])
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                more = [(a, 3, b) for a, b in more if not any(x < b and a < y for x, _, y in base)]
                added.append(len(more))
                spans.append(written(sorted(base + more)))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns, pa.array(digests), pa.array(spans), pa.array(added, pa.int64())],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_added bigint")
