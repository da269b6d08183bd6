"""Benchmark decontamination by spaced seeds.

A spaced seed is a mask over a few consecutive words, some of whose positions are ignored. Every
masked position of every benchmark item and document is hashed. A bitmap of fixed size, made of the
items' hashes, drops most of the documents' hashes in place; the others are joined with the items'
by the hash itself. Each hit fixes an item and a diagonal, along which the words around it are
compared: the document is contaminated if some stretch of as many words as ``STRETCH``, or as the item has
if it is shorter, holds at least ``SHARE`` of equal words in place. So substitutions are tolerated.

Items of fewer than ``LEAST`` words are hashed whole and must occur word by word, since nothing may differ in so short
a run; a document counts once for each, at its first occurrence. ``least`` sets the fewest words of items that are
searched: ``leaks`` lists all, while ``drop_leaks`` leaves out items below ``LEAST``, as prose holds a few words by chance.

Words are runs of ASCII letters, ASCII digits and non-ASCII bytes; A-Z are lower-cased. Items without words, null or
empty ones match nothing, and so do null texts. Repeated items and documents
are each searched; a row without identifier is searched like any other. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import mix64, seeded, slices, staged, text_bytes, without_lost, word_hashes
from quarry.llm.tokens import forget

#: Fixed masks: the word positions that count. Between them they hit every stretch of 8 to 20 words with as
#: many substitutions as ``SHARE`` allows, wherever those are; a test lists all cases.
SEEDS = ((0, 1, 2, 3, 5), (0, 1, 3, 5, 6), (0, 2, 3, 6, 7), (0, 1, 4, 6, 7))
SPANS = tuple(max(mask) + 1 for mask in SEEDS)
STRETCH = 20
SHARE = 0.8
#: Items of fewer words than this are searched as they are, without substitutions.
LEAST = 8
#: Bits of the bitmap that tasks get, whatever the benchmark's size.
BITMAP_BITS = 24

_U = np.uint64
_TURN = seeded(max(SPANS), 81)
#: Bytes that belong to words, and how capitals fold.
_SOLID = np.zeros(256, bool)
_SOLID[48:58] = _SOLID[65:91] = _SOLID[97:123] = _SOLID[128:] = True


def plain_words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, with any other byte read as a space, and where rows begin."""
    part = raw[offs[0] : offs[-1]]
    return word_hashes(np.where(_SOLID[part], part, 32).astype(np.uint8), offs - offs[0])


def seed_hashes(h: np.ndarray) -> list[np.ndarray]:
    """For each seed, the hash at every position where it fits; mixed with the seed's number."""
    found = []
    for k, (mask, span) in enumerate(zip(SEEDS, SPANS)):
        n = max(0, len(h) - span + 1)
        found.append(mix64(sum(h[i : i + n] * _TURN[i] for i in mask) + _U(k)) if n else np.zeros(0, np.uint64))
    return found


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of ``n`` words, for items of ``n`` words; mixed with a number that no seed has."""
    m = max(0, len(h) - n + 1)
    return mix64(sum(h[i : i + m] * _TURN[i] for i in range(n)) + _U(len(SEEDS) + n)) if m else np.zeros(0, np.uint64)


def _items(benchmark: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(item, words): word hashes of the items that are long enough, each under a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offs, raw = text_bytes(batch.column(1))
            for i, j in slices(offs):
                h, at = plain_words(raw, offs[i : j + 1])
                words = [h[a:b].tobytes() if b - a >= max(1, least) else None for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(words, pa.binary())], names=["item_id", "words"])

    kind = benchmark.schema[id_col].dataType.simpleString()
    found = benchmark.select(id_col, text_col).mapInArrow(run, f"item_id {kind}, words binary").filter("words IS NOT NULL")
    return staged(found.withColumn("item", F.monotonically_increasing_id()), "leak-items")


def _seeds(items: DataFrame) -> DataFrame:
    """(hash, item, pos) of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, words in zip(batch.column(0), batch.column(1)):
                h = np.frombuffer(words.as_buffer(), np.uint64)
                found = seed_hashes(h) if len(h) >= LEAST else [run_hashes(h, len(h))]
                pos = np.concatenate([np.arange(len(x), dtype=np.int32) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.full(len(pos), item.as_py(), np.int64)), pa.array(pos)], names=["hash", "item", "pos"])

    return staged(items.select("item", "words").mapInArrow(run, "hash long, item long, pos int"), "leak-seeds")


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """Which values of the hashes' top bits occur; at most 2**BITMAP_BITS bits reach the driver."""
    slot = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)
    words = seeds.select(F.shiftright(slot, 6).alias("word"), (slot % 64).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toPandas()
    packed = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    packed[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return packed


def _short(items: DataFrame) -> list[int]:
    """The numbers of words below ``LEAST`` that items have."""
    n = F.expr("octet_length(words) DIV 8").cast("int")
    return sorted(row.n for row in items.select(n.alias("n")).filter(F.col("n") < LEAST).distinct().collect())


def _runs(docs: DataFrame, id_col: str, text_col: str, packed: np.ndarray, short: list[int]) -> DataFrame:
    """(doc, run, first, words, hits): stretches of words around hashes that the bitmap lets through.

    ``short`` lists the numbers of words of short items; of equal short runs of a document the first one counts.
    """
    spread = docs.sparkSession.sparkContext.broadcast(packed.tobytes())  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known = np.unpackbits(np.frombuffer(spread.value, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            offs, raw = text_bytes(batch.column(1))
            for i, j in slices(offs):
                h, at = plain_words(raw, offs[i : j + 1])
                found = seed_hashes(h)
                ids, nos, firsts, words, hits, places = [], [], [], [], [], []
                spans = [*SPANS, *short]
                found += [run_hashes(h, n) for n in short]
                through = [np.flatnonzero(known[x >> _U(64 - BITMAP_BITS)]) for x in found]
                pos = np.concatenate(through)
                value = np.concatenate([x[p] for x, p in zip(found, through)])
                span = np.repeat(spans, [len(p) for p in through])
                row = np.searchsorted(at, pos, "right") - 1
                inside = pos + span <= at[row + 1]
                if short:
                    once = np.zeros(len(pos), bool)
                    within = np.flatnonzero(inside)
                    by = within[np.lexsort((pos[within], value[within], row[within]))]
                    once[by] = np.append(True, (np.diff(value[by].view(np.int64)) != 0) | (np.diff(row[by]) != 0))[: len(by)]
                    inside &= once | (np.repeat(np.arange(len(spans)), [len(p) for p in through]) < len(SPANS))
                pos, value, row = pos[inside], value[inside], row[inside]
                order = np.argsort(pos, kind="stable")
                pos, value, row = pos[order], value[order], row[order]
                reach = STRETCH - 1
                cut = np.flatnonzero((np.diff(pos) > 2 * reach) | (np.diff(row) > 0)) + 1
                for k, (a, b) in enumerate(zip([0, *cut], [*cut, len(pos)])):
                    if a == b:
                        continue
                    r = int(row[a])
                    lo, hi = max(at[r], pos[a] - reach), min(at[r + 1], pos[b - 1] + max(SPANS) + reach)
                    ids.append(i + r)
                    nos.append(k)
                    firsts.append(int(lo - at[r]))
                    words.append(h[lo:hi].tobytes())
                    hits.append(value[a:b].view(np.int64))
                    places.append((pos[a:b] - lo).astype(np.int32))
                if ids:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), pa.array(firsts, pa.int64()), pa.array(words, pa.binary()), pa.array(hits, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))], names=["doc_id", "first", "words", "hashes", "places"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, first long, words binary, hashes array<long>, places array<int>")
    return staged(found.withColumn("run", F.monotonically_increasing_id()), "leak-runs")


def best_stretch(a: np.ndarray, b: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """Most equal words in a stretch of ``a`` laid over item ``b``; its length, and where it begins in ``a``."""
    need = min(STRETCH, len(b))
    lo, hi = max(0, diagonal), min(len(a), len(b) + diagonal)
    if hi - lo < need:
        return 0, need, lo
    same = np.concatenate([[0], np.cumsum(a[lo:hi] == b[lo - diagonal : hi - diagonal])])
    sums = same[need:] - same[:-need]
    at = int(np.argmax(sums))
    return int(sums[at]), need, lo + at


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = 1) -> DataFrame:
    """(doc_id, item_id, equal_words, stretch_words, similarity, first_word) of contaminated documents.

    One row for each document and item of at least ``least`` words, with its best stretch (the first of equal ones).
    """
    items = _items(benchmark, item_id, item_text, least)
    seeds = _seeds(items)
    runs = _runs(docs, id_col, text_col, _bitmap(seeds), _short(items))
    hits = runs.select("run", F.explode(F.arrays_zip("hashes", "places")).alias("hit")).select("run", F.col("hit.hashes").alias("hash"), F.col("hit.places").alias("place"))
    lines = hits.join(seeds, "hash").select("run", "item", (F.col("place") - F.col("pos")).alias("diagonal")).distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, item, first, diagonal = (batch.column(i) for i in (0, 1, 2, 3))
            out = [best_stretch(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), d.as_py()) for a, b, d in zip(batch.column(4), batch.column(5), diagonal)]
            keep = pa.array([need > 0 and n >= (SHARE if need >= LEAST else 1) * need for n, need, _ in out], pa.bool_())
            equal, need, at = ([x[k] for x in out] for k in range(3))
            begins = [f.as_py() + x for f, x in zip(first, at)]
            yield pa.RecordBatch.from_arrays([doc, item, *(pa.array(c, pa.int64()) for c in (equal, need, begins))], names=["doc_id", "item_id", "equal_words", "stretch_words", "first_word"]).filter(keep)

    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    laid = lines.join(runs.select("run", "doc_id", "first", F.col("words").alias("a")), "run").join(items.select("item", "item_id", F.col("words").alias("b")), "item")
    found = laid.select("doc_id", "item_id", "first", "diagonal", "a", "b").mapInArrow(verify, f"doc_id {kinds[0]}, item_id {kinds[1]}, equal_words long, stretch_words long, first_word long")
    share = F.col("equal_words") / F.col("stretch_words")
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct((-share).alias("o"), "first_word", "equal_words", "stretch_words")).alias("b"))
    return best.select(F.col("doc_id").alias(id_col), F.col("item_id"), "b.equal_words", "b.stretch_words", (-F.col("b.o")).alias("similarity"), "b.first_word")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` without a contaminated stretch of an item of at least ``least`` words, with all their columns."""
    # Rows of one identifier, a null one too, may hold different texts, so the text's hash is part of the key.
    text = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), text.alias("text")).alias("key"), F.col(text_col).alias("text"))
    found = leaks(keyed, benchmark, "key", "text", item_id, item_text, least)
    return without_lost(docs, found.select(F.col("key.id").alias("lost_id"), F.col("key.text").alias("lost_text")), id_col, text, nulls=True)
