"""SentencePiece encoding with seeded merge-dropout, and decoding.

Byte-pair merging by an agenda: adjacent pieces whose joined piece is in the vocabulary are candidates, taken by best score, then
leftmost. A candidate that is taken from the agenda is skipped for good when its keyed hash falls below the dropout rate, so
equal words get different segmentations while every run gives the same. The key is made of the seed, the document, the place of the part
in its text, the place of the pair and the piece it would give.

Pieces never join a space to what stands before it, so a text is cut before its runs of spaces. Of short parts the undropped merges are
remembered: an occurrence that drops none of these has their result, any other is merged on its own. Parts have numbers, and what is known of
them lies in flat arrays, so a task's memory is that of its remembered parts and of about one megabyte of text at a time.
Characters without a piece become byte pieces, and so does the space mark itself when it is part of a text: decoding is lossless.

Edge cases: NULL text has NULL ids; the empty text has none; rows that repeat get equal ids unless a copy number tells them apart; other columns pass through; an empty table
gives no rows.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelmill.llm.common import bounded, mix, unused, widened

MARK = "▁"
SEED, DROPOUT = 17, 0.1
_KEPT = 100_000  # remembered parts, at most twice as many before the oldest go
_SHORT = 24  # longer parts are rare and merged one by one
_ROWS = 4096  # short parts merged at once, of about one length
_SLICE = 1 << 15  # occurrences whose merges are looked at together
_SPACE = 0  # number of a mark that is part of a text
_TABLE_BITS = 21


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces and scores of a model file with byte fallback; read on the driver and broadcast."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path or model_path())
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(pieces) if i not in special}
        self.scores = [sp.get_score(i) for i in range(n)]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):  # the cuts below would then change results
            raise ValueError("pieces that join a space or a line end to what stands before it are not supported")
        rank = {x: k for k, x in enumerate(sorted(set(self.scores)))}
        self.priority = np.array([rank[x] for x in self.scores], np.int32)
        self.pairs = self._pairs()
        raw = [b"" if i in special else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        for b, i in enumerate(self.byte_ids):
            raw[i] = bytes([b])
        self.lengths = np.array([len(x) for x in raw], np.int64)
        self.blob = np.frombuffer(b"".join(raw), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])


    @classmethod
    def of(cls, fields: dict) -> Vocabulary:
        """Put together from its broadcast fields."""
        made = cls.__new__(cls)
        vars(made).update(fields)
        return made

    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Open-addressed table from a pair of ids to the id of the joined piece, for lookups by whole arrays."""
        keys, values = np.full(1 << _TABLE_BITS, -1, np.int64), np.full(1 << _TABLE_BITS, -1, np.int32)
        for piece, k in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    at = _slot(a, b)
                    while keys[at] >= 0:
                        at = (at + 1) & ((1 << _TABLE_BITS) - 1)
                    keys[at], values[at] = a << 32 | b, k
        return keys, values

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id of the joined piece per pair, -1 where there is none."""
        keys, values = self.pairs
        a, b = a.astype(np.int64), b.astype(np.int64)
        wanted, at = a << 32 | b, _slot(a, b)
        out = np.full(len(a), -1, np.int32)
        left = np.arange(len(a))
        while len(left):
            found = keys[at]
            hit = found == wanted[left]
            out[left[hit]] = values[at[hit]]
            on = ~hit & (found >= 0)
            left, at = left[on], (at[on] + 1) & ((1 << _TABLE_BITS) - 1)
        return out


def _slot(a, b):
    return ((a * 0x9E3779B1 + b * 0x85EBCA77) & 0xFFFFFFFF) >> (32 - _TABLE_BITS)


class Encoder:
    def __init__(self, vocabulary: Vocabulary, seed: int = SEED, dropout: float = DROPOUT):
        self.v, self.seed, self.limit = vocabulary, seed, int(dropout * 2**32)
        self.keys = mix(np.arange(1, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)).tolist()  # the seed's own key
        # parts by number: ids without dropout, the merges on the way (piece and place), the batch that met the part last
        self.parts: list[str] = [MARK + "\n", "\n"]  # a mark of the text itself, under a name that no part has, and the line end
        self.number = _Numbers(self.parts)
        self.ids, self.steps, self.met, self.round = _Lists(), _Lists(2), np.zeros(2, np.int64), 0
        self.ids.append([array("i", [vocabulary.byte_ids[b] for b in x]).tobytes() for x in (MARK.encode(), b"\n")], 4)
        self.steps.append([b"", b""], 16)
        self.letters = np.full(0x110000, -1, np.int32)  # piece of a single character
        for piece, k in vocabulary.ids.items():
            if len(piece) == 1:
                self.letters[ord(piece)] = k
        self.part = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")

    def merge(self, part: str, key: int, drop: bool = True) -> bytes:
        """Ids of one part by the agenda."""
        key &= 0xFFFFFFFF
        ids, scores, limit = self.v.ids, self.v.scores, self.limit if drop else 0
        n = len(part)
        piece = list(part)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            joined = piece[i] + piece[j]
            k = ids.get(joined)
            if k is not None:
                heapq.heappush(agenda, (-scores[k], i, joined))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, joined = heapq.heappop(agenda)
            j = nxt[i]
            if not piece[i] or j >= n or len(piece[i]) + len(piece[j]) != len(joined):
                continue  # one side has been merged since
            if limit:
                h = (ids[joined] * 0x9E3779B1 + i * 0x85EBCA77 + key) & 0xFFFFFFFF
                h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
                h = ((h ^ (h >> 12)) * 0x297A2D39) & 0xFFFFFFFF
                if h ^ (h >> 15) < limit:
                    continue
            piece[i], piece[j] = joined, ""
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                offer(i, k)
            if prv[i] >= 0:
                offer(prv[i], i)
        out = array("i")
        for p in piece:
            if p:
                k = ids.get(p)
                if k is None:
                    out.extend(self.v.byte_ids[b] for b in p.encode("utf-8", "surrogatepass"))
                else:
                    out.append(k)
        return out.tobytes()

    def merge_all(self, parts: list[str], key, way: list | None = None) -> list[bytes]:
        """``merge`` of many short parts at once: one agenda step of every part per round, on arrays. ``key`` is one for all or one per part.
        Given a list as ``way``, nothing is dropped and the list gets the merges of every part: pairs of a piece and its place."""
        keys = np.broadcast_to(np.asarray(key, np.uint64) & np.uint64(0xFFFFFFFF), len(parts)).astype(np.int64)
        v = self.v
        w = max(map(len, parts)) + 1
        size = np.fromiter(map(len, parts), np.int32, len(parts))
        n = len(parts)
        inside = np.arange(w) < size[:, None]
        # all tables are flat, so that a step reads and writes by one index
        rows = np.zeros(n * w, np.int32)
        rows[inside.ravel()] = self.letters[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        nxt = np.tile(np.arange(1, w + 1, dtype=np.int32), n)
        prv = np.tile(np.arange(-1, w - 1, dtype=np.int32), n)
        made = np.full(n * w, -1, np.int32)  # what the pair from here on would give
        whole_rows = rows.reshape(n, w)
        first = np.flatnonzero((inside[:, 1:] & (whole_rows[:, :-1] >= 0) & (whole_rows[:, 1:] >= 0)).ravel())
        first += first // (w - 1) if w > 1 else 0
        made[first] = v.joined(rows[first], rows[first + 1])
        priority = np.append(v.priority, np.int32(-1))  # the last stands for no piece
        rank = priority[made].reshape(n, w)
        ranks = rank.ravel()
        live, steps = np.arange(n), []
        while len(live):
            i = (rank if len(live) == n else rank.take(live, axis=0)).argmax(axis=1)  # the leftmost of the best
            here = live * w + i
            on = ranks.take(here) >= 0
            live, i, here = live[on], i[on], here[on]
            m = made.take(here)
            ranks[here] = -1
            take, at, place = live, i, here
            if way is not None:
                steps.append((live, m, i))
            elif self.limit:
                kept = ~self._dropped(m.astype(np.int64), i, keys.take(live))
                take, at, place, m = live[kept], i[kept], here[kept], m[kept]
            base = place - at
            j = base + nxt.take(place)
            k = nxt.take(j)
            rows[place], rows[j] = m, -2
            ranks[j] = -1
            nxt[place] = k
            more = np.flatnonzero(k < size.take(take))
            right = base[more] + k[more]
            prv[right] = at[more]
            p = prv.take(place)
            back = np.flatnonzero(p >= 0)
            left = np.concatenate([place[more], base[back] + p[back]])
            right = np.concatenate([right, place[back]])
            a, b = rows.take(left), rows.take(right)
            good = np.flatnonzero((a >= 0) & (b >= 0))
            left = left[good]
            made[left] = new = v.joined(a[good], b[good])
            ranks[left] = priority.take(new, mode="wrap")
        rows = whole_rows
        out = rows[inside & (rows != -2)].astype(np.int32).tobytes()
        ends = np.cumsum((inside & (rows != -2)).sum(axis=1)) * 4
        whole = (inside & (rows == -1)).any(axis=1)
        found = [out[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]
        for i in np.flatnonzero(whole):  # a character without a piece
            found[i] = self.merge(parts[i], int(keys[i]), way is None)
        if way is not None:
            row, *step = (np.concatenate([x[k] for x in steps] or [np.empty(0, np.int64)]) for k in range(3))
            order = np.argsort(row, kind="stable")
            step = np.stack(step, axis=1)[order].astype(np.int64)
            ends = np.cumsum(np.bincount(row, minlength=n)).tolist()
            way += [step[a:b].tobytes() for a, b in zip([0, *ends], ends)]
        return found

    def _dropped(self, m: np.ndarray, i: np.ndarray, key: np.ndarray) -> np.ndarray:
        h = (m * 0x9E3779B1 + i * 0x85EBCA77 + key) & 0xFFFFFFFF
        h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
        h = ((h ^ (h >> 12)) * 0x297A2D39) & 0xFFFFFFFF
        return (h ^ (h >> 15)) < self.limit

    def _learn(self, fresh: list[str], first: int) -> None:
        """Append the undropped ids and merges of parts that have just got the numbers from ``first`` on; long ones have none."""
        ids, steps = [b""] * len(fresh), [b""] * len(fresh)
        short = sorted((k for k, p in enumerate(fresh) if len(p) <= _SHORT), key=lambda k: len(fresh[k]))
        for a in range(0, len(short), _ROWS):
            way: list[bytes] = []
            some = short[a : a + _ROWS]
            found = self.merge_all([fresh[k] for k in some], 0, way)
            for k, x, y in zip(some, found, way):
                ids[k], steps[k] = x, y
        self.parts += fresh
        self.ids.append(ids, 4)
        self.steps.append(steps, 16)

    def _forget(self) -> None:
        """Keep the short parts that were met last, once there are too many."""
        if len(self.parts) < 2 * _KEPT:
            return
        short = np.fromiter(map(len, self.parts), np.int64, len(self.parts)) <= _SHORT
        by_age = np.flatnonzero(short)
        by_age = by_age[np.argsort(-self.met[by_age], kind="stable")]
        kept = np.sort(np.concatenate([[0, 1], by_age[by_age > 1][:_KEPT]]))
        self.parts = list(map(self.parts.__getitem__, kept.tolist()))
        self.number = _Numbers(self.parts)
        self.ids, self.steps, self.met = self.ids.take(kept), self.steps.take(kept), self.met[kept]

    def encode_all(self, texts: list[str | None], keys: list[int]) -> list[np.ndarray | None]:
        """Ids of whole texts; a text's key and the place of a part in it make the key of that occurrence. NULL gives NULL.

        An occurrence is the number of its part from here on, so a batch holds each of its parts once."""
        self._forget()
        known = len(self.parts)
        numbers = array("i")
        counts = []  # parts of each text, marks and line ends included
        for text in texts:
            before = len(numbers)
            for at, segment in enumerate((" " + text).split(MARK) if text else []):
                if at:
                    numbers.append(_SPACE)
                numbers.extend(map(self.number.__getitem__, self.part.findall(segment.replace(" ", MARK))))
            counts.append(len(numbers) - before)
        fresh = self.number.fresh
        self._learn(fresh, known)
        self.met = np.concatenate([self.met, np.zeros(len(fresh), np.int64)])
        self.round += 1
        which, count = np.frombuffer(numbers, np.int32), np.array(counts, np.int64)
        self.met[which] = self.round
        start, size = self.ids.start[which], self.ids.size[which]
        # the others are merged on their own: long parts, and those that drop a merge
        long = np.array([len(p) > _SHORT for p in fresh], bool)
        alone = np.flatnonzero(np.concatenate([np.zeros(known, bool), long])[which]) if long.any() else np.empty(0, np.int64)
        key = self._keys(count, keys) if self.limit or len(alone) else np.empty(0, np.uint64)
        merged = [self.merge(self.parts[which[i]], int(key[i])) for i in alone.tolist()]
        other = self._dropping(which, key) if self.limit else np.empty(0, np.int64)
        other = other[np.argsort(self.lengths(which[other]), kind="stable")]
        for a in range(0, len(other), _ROWS):
            some = other[a : a + _ROWS]
            merged += self.merge_all([self.parts[i] for i in which[some].tolist()], key[some])
        own = np.concatenate([alone, other])
        size[own] = np.fromiter(map(len, merged), np.int64, len(merged)) // 4
        start[own] = len(self.ids.flat) + np.cumsum(size[own]) - size[own]
        flat = np.concatenate([self.ids.flat, np.frombuffer(b"".join(merged), np.int32)])
        for p, apart in zip(fresh, long):
            if apart:  # met anew it has another key
                del self.number[p]
        fresh.clear()
        out, at = [], 0
        for text, n in zip(texts, counts):
            own_start, own_size = start[at : at + n], size[at : at + n]
            ends = np.cumsum(own_size)
            out.append(None if text is None else flat[np.arange(ends[-1] if n else 0) + np.repeat(own_start - ends + own_size, own_size)])
            at += n
        return out

    def _keys(self, count: np.ndarray, keys: list[int]) -> np.ndarray:
        """Key of every occurrence, from that of its text and its place there."""
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        own = np.array([k & (2**64 - 1) for k in keys], np.uint64)
        return mix(np.repeat(own, count) + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(self.keys[0])) & np.uint64(0xFFFFFFFF)

    def _dropping(self, which: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Occurrences that drop a merge of their part; looked at slice by slice, as each has several merges."""
        found = [np.empty(0, np.int64)]
        for a in range(0, len(which), _SLICE):
            some = which[a : a + _SLICE]
            n = self.steps.size[some]
            short = np.flatnonzero(n)
            if not len(short):
                continue
            n = n[short]
            first = np.cumsum(n) - n
            at = np.arange(n.sum()) + np.repeat(self.steps.start[some[short]] - first, n)
            pair = self.steps.flat.reshape(-1, 2)[at].astype(np.int64)
            hit = self._dropped(pair[:, 0], pair[:, 1], np.repeat(key[a : a + _SLICE][short].astype(np.int64), n))
            found.append(a + short[np.logical_or.reduceat(hit, first)])
        return np.concatenate(found)

    def lengths(self, which: np.ndarray) -> np.ndarray:
        """Characters of parts by their numbers."""
        return np.fromiter(map(len, map(self.parts.__getitem__, which.tolist())), np.int64, len(which))


class _Numbers(dict):
    """Number of each part; a part that is new gets the next one and is listed in ``fresh``."""

    def __init__(self, parts: list[str]):
        super().__init__(zip(parts, range(len(parts))))
        self.next, self.fresh = len(parts), []

    def __missing__(self, part: str) -> int:
        self[part] = n = self.next
        self.next += 1
        self.fresh.append(part)
        return n


class _Lists:
    """Lists of 32-bit numbers, one behind the other in a flat array; ``start`` and ``size`` count its rows of ``width`` numbers."""

    def __init__(self, width: int = 1):
        self.width, self.flat = width, np.empty(0, np.int32)
        self.start, self.size = np.empty(0, np.int64), np.empty(0, np.int64)

    def append(self, lists: list[bytes], row: int) -> None:
        """Add lists given as bytes, ``row`` bytes for a row; 64-bit numbers are narrowed."""
        size = np.fromiter(map(len, lists), np.int64, len(lists)) // row
        more = np.frombuffer(b"".join(lists), f"i{row // self.width}").astype(np.int32)
        self.start = np.concatenate([self.start, len(self.flat) // self.width + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, more])

    def take(self, which: np.ndarray) -> _Lists:
        made = _Lists(self.width)
        made.size = self.size[which]
        ends = np.cumsum(made.size)
        made.start = ends - made.size
        at = np.arange(ends[-1]) + np.repeat(self.start[which] - made.start, made.size)
        made.flat = self.flat.reshape(-1, self.width)[at].ravel()
        return made


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray) -> str:
    """Text of ids; the leading space that encoding adds is taken off."""
    if not len(ids):
        return ""
    lengths = vocabulary.lengths[ids]
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1]) + np.repeat(vocabulary.offsets[ids] - ends + lengths, lengths)
    return vocabulary.blob[at].tobytes().decode("utf-8", "surrogatepass").removeprefix(" ")


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None, seed: int = SEED, dropout: float = DROPOUT, copy: str | None = None) -> DataFrame:
    """Add ``ids`` (array<int>) and ``lossless``, whether the ids decode to the text. ``copy`` names a column with the number of a row among
    those of one doc_id."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(vocabulary or Vocabulary()))  # of the vocabulary's size, whatever the documents
    key = unused(docs, "_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", *([copy] if copy else [])))
    schema = widened(docs, ids=T.ArrayType(T.IntegerType()), lossless=T.BooleanType())
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.of(shared.value)
        encoder = Encoder(v, seed, dropout)
        for batch in bounded(batches, "text", 1 << 20):  # what a batch takes in memory is many times its text
            texts, keys = batch["text"].to_pylist(), batch[key].to_pylist()
            found = encoder.encode_all(texts, keys)
            same = [None if t is None else decode_ids(v, x) == t for t, x in zip(texts, found)]
            offsets = np.cumsum([0, *(0 if x is None else len(x) for x in found)]).astype(np.int32)
            filled = [x for x in found if x is not None]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(filled) if filled else np.empty(0, np.int32)),
                                             mask=pa.array([x is None for x in found]))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), lists, pa.array(same, pa.bool_())], [*names, "ids", "lossless"])

    return keyed.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text that an array of ids stands for; NULL for NULL."""
    shared = encoded.sparkSession.sparkContext.broadcast(vars(vocabulary or Vocabulary()))
    schema = widened(encoded, **{out: T.StringType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.of(shared.value)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            texts = [None if x is None else decode_ids(v, np.array(x, np.int64)) for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    return encoded.mapInArrow(run, schema)
