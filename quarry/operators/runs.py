"""Runs of tokens that belong to a set of phrases, found where the texts lie.

Tasks get a bit set of fixed size that is made of the phrases' hashes. It lets few other runs through, so what is
shuffled grows with the hits and not with the texts; an exact join with the phrases has the last word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as X

#: Bits of the set that tasks get, whatever the number of phrases.
BITS = 26
_STEP, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def _longer(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Hashes of runs that are longer by a token."""
    h = (h ^ (code + np.uint64(1))) * _STEP
    return h ^ (h >> _SHIFT)


def _slots(h: np.ndarray) -> np.ndarray:
    return (h * _STEP >> np.uint64(64 - BITS)).astype(np.int64)


@lru_cache(1 << 18)
def _known(name: str, folded: bool) -> tuple[str, int]:
    """A token as it is compared, and its number; most tokens come again in the next batch."""
    shown = X.plain_letters(name) if folded else name
    return shown, zlib.crc32(shown.encode())


def _slices(batch: pa.RecordBatch, column: int, most: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """A batch, in pieces if it has many tokens."""
    step = max(1, len(batch) * most // max(1, len(batch.column(column).flatten())))
    return (batch.slice(low, step) for low in range(0, len(batch), step))


class _Tokens:
    """A column of token lists as numbers: ``ids`` into ``names``, and the row and the place of each token."""

    def __init__(self, column: pa.Array, folded: bool = False):
        coded = column.flatten().dictionary_encode()
        self.names = coded.dictionary.to_pylist()
        known = [_known(w, folded) for w in self.names]
        self.shown = [k[0] for k in known]
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.rows = np.repeat(np.arange(len(column)), self.sizes)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.codes = np.array([k[1] for k in known], np.uint64)


def bit_set(phrases: DataFrame, phrase: str) -> bytes:
    """The set of the phrases, whose tokens are joined by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = _Tokens(batch.column(0))
            h = np.zeros(len(batch), np.uint64)
            for i in range(int(t.sizes.max(initial=0))):
                on = np.flatnonzero(t.sizes > i)
                h[on] = _longer(h[on], t.codes[t.ids[t.first[on] + i]])
            at = np.unique(_slots(h))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6, pa.int32()), pa.array(np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])

    made = phrases.select(F.split(phrase, " ").alias("t")).filter("t IS NOT NULL").mapInArrow(run, "word int, bits long")
    found = made.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most 2**(BITS - 6) rows
    packed = np.zeros(1 << (BITS - 6), np.int64)
    packed[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return packed.tobytes()


def _within(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _slots(h)
    return (known[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def runs_in(rows: DataFrame, keys: Sequence[str], tokens: str, known: bytes, least: int, most: int, folded: bool = False) -> DataFrame:
    """(keys, at, n, gram, raw): runs of ``least`` to ``most`` tokens that the set ``known`` lets through; ``at`` counts from 1.

    With ``folded`` runs are compared with accents folded: ``gram`` is the folded form, ``raw`` what stands there.
    """
    spread = rows.sparkSession.sparkContext.broadcast(known)  # of fixed size
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(spread.value, np.uint8)
        for batch in batches:
            for part in _slices(batch, width):
                t = _Tokens(part.column(width), folded)
                code, h, found = t.codes[t.ids], np.zeros(len(t.ids), np.uint64), []
                start = np.arange(len(t.ids))
                for n in range(1, most + 1):
                    on = start + n - 1 < len(t.ids)
                    start, h = start[on], h[on]
                    on = t.rows[start + n - 1] == t.rows[start]
                    start, h = start[on], h[on]
                    h = _longer(h, code[start + n - 1])
                    if n >= least:
                        hits = start[_within(held, h)]
                        found.append((hits, np.full(len(hits), n)))
                at, size = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                row = t.rows[at]
                places = list(zip(at.tolist(), size.tolist()))
                ids = t.ids
                show = lambda names: pa.array([" ".join([names[i] for i in ids[a : a + n]]) for a, n in places], pa.string())
                gram = show(t.shown)
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(row)) for i in range(width)), pa.array(at - t.first[row] + 1, pa.int32()), pa.array(size, pa.int32()), gram, show(t.names) if folded else gram], names=[*keys, "at", "n", "gram", "raw"])

    kinds = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys]
    return rows.select(*keys, tokens).mapInArrow(run, ", ".join([*kinds, "at int, n int, gram string, raw string"]))


def phrases_in(rows: DataFrame, keys: Sequence[str], tokens: str, starts: bytes, whole: bytes, most: int) -> DataFrame:
    """(keys, phrase): runs of 2 to ``most`` tokens that the set ``whole`` lets through, and whose first three tokens are in ``starts``."""
    spread = rows.sparkSession.sparkContext.broadcast((starts, whole))  # of fixed size
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, held = (np.frombuffer(b, np.uint8) for b in spread.value)
        for batch in batches:
            for part in _slices(batch, width):
                t = _Tokens(part.column(width))
                code, start, h, found = t.codes[t.ids], np.arange(len(t.ids)), np.zeros(len(t.ids), np.uint64), []
                for n in range(1, most + 1):
                    on = start + n - 1 < len(t.ids)
                    start, h = start[on], h[on]
                    on = t.rows[start + n - 1] == t.rows[start]
                    start, h = start[on], h[on]
                    h = _longer(h, code[start + n - 1])
                    if n > 1:
                        found += [(a, n) for a in start[_within(held, h)].tolist()]
                    if n == 3:
                        # Few runs begin as a phrase does; only those grow further.
                        on = _within(begins, h)
                        start, h = start[on], h[on]
                row = t.rows[np.array([a for a, _ in found], np.int64)]
                text = [" ".join([t.names[i] for i in t.ids[a : a + n]]) for a, n in found]
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(row)) for i in range(width)), pa.array(text, pa.string())], names=[*keys, "phrase"])

    kinds = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys]
    return rows.select(*keys, tokens).mapInArrow(run, ", ".join([*kinds, "phrase string"]))


def counted(rows: DataFrame, key: str, tokens: str, title: str | None, known: bytes) -> DataFrame:
    """(key, len, term, tf, title_tf) of the tokens that the set lets through, counted where a row lies, and a row without term for each row.

    A title counts into frequency and length like the body.
    """
    spread = rows.sparkSession.sparkContext.broadcast(known)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(spread.value, np.uint8)
        for batch in batches:
            for part in _slices(batch, 1):
                t = _Tokens(part.column(1))
                good = _within(held, _longer(np.zeros(len(t.codes), np.uint64), t.codes))
                on = np.flatnonzero(good[t.ids])
                width = max(1, len(t.names))
                each, where, tf = np.unique(t.rows[on] * width + t.ids[on], return_inverse=True, return_counts=True)
                heads = part.column(2).fill_null(0).to_numpy(zero_copy_only=False)
                in_title = np.bincount(where, on - t.first[t.rows[on]] < heads[t.rows[on]], len(each)).astype(np.int64) if len(on) else np.zeros(0, np.int64)
                own = np.flatnonzero(part.column(1).is_valid().to_numpy(zero_copy_only=False))  # null has no tokens, not none
                n, row = len(own), np.concatenate([own, each // width])
                term = pa.concat_arrays([pa.nulls(n, pa.string()), pa.array([t.names[i] for i in (each % width).tolist()], pa.string())])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(t.sizes[row], pa.int32()), term, pa.array(np.concatenate([np.ones(n, np.int64), tf]), pa.int64()), pa.array(np.concatenate([np.zeros(n, np.int64), in_title]), pa.int64())], names=["doc", "len", "term", "tf", "title_tf"])

    whole = F.concat(title, tokens) if title else F.col(tokens)
    asked = rows.select(F.col(key).alias("doc"), whole.alias("t"), (F.size(title) if title else F.lit(0)).alias("head"))
    return asked.mapInArrow(run, f"doc {rows.schema[key].dataType.simpleString()}, len int, term string, tf long, title_tf long")


def kept(rows: DataFrame, key: str, columns: Sequence[str], known: bytes) -> DataFrame:
    """(key, columns, size of each column): of lists of tokens those that the set lets through, in their order, and how many there were."""
    spread = rows.sparkSession.sparkContext.broadcast(known)  # of fixed size
    sizes = [f"{c}_size" for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(spread.value, np.uint8)
        for batch in batches:
            made = []
            for i in range(len(columns)):
                t = _Tokens(batch.column(i + 1))
                on = _within(held, _longer(np.zeros(len(t.codes), np.uint64), t.codes))[t.ids]
                ends = np.cumsum(np.bincount(t.rows[on], minlength=len(batch))).astype(np.int32)
                made.append((pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), ends)), batch.column(i + 1).flatten().filter(pa.array(on))), pa.array(t.sizes, pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(m[0] for m in made), *(m[1] for m in made)], names=[key, *columns, *sizes])

    kinds = [f"{key} {rows.schema[key].dataType.simpleString()}", *(f"{c} array<string>" for c in columns), *(f"{c} int" for c in sizes)]
    return rows.select(key, *columns).mapInArrow(run, ", ".join(kinds))
