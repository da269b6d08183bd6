"""Removal of repeated byte strings with suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document with
a smaller identifier, or earlier in the same one. All is judged on the input.

Routing. Each string of ``length`` bytes is named by the smallest hash of the ``GRAM``-byte grams
in it, the leftmost of equal ones, so equal strings have equal names. Consecutive strings of a
document named by the same gram in place are a run, which holds no string twice. Only names with
several runs can hold a repeat. Their runs' bytes go to the shard of the name.

Shards. Of equal runs the first stays for comparison, in the task that reads the texts and again in the shard. The shard's suffix array is sorted by
Larsson-Sadakane refinement: suffixes start in groups by their first seven bytes, and each round
sorts the groups that are left by the ranks of the suffixes a doubled distance on, until none is
left. Kasai's rule, run over all runs side by side, gives common prefixes of
neighbours, hence the classes of equal strings; all but a class's first occurrence are repeats. A
shard beyond ``SHARD_BYTES`` is cut into parts by document; every two parts are merged by a
binary search of one's sorted distinct strings in the other's.

Null text is empty. A null identifier comes before all others. Rows with equal identifiers and
texts are one document: each is returned, with the same result. Rows with one identifier and
different texts don't repeat each other. Texts shorter than ``length`` lose nothing.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import mix64, seeded, slices, staged, text_bytes

LENGTH = 100
GRAM = 24
SHARD_BYTES = 6 << 20
_U = np.uint64
_PIECE = 1 << 19
#: Bits of a gram's place in the bytes that are looked at together; the rest are its hash.
PLACE_BITS = 21
_PLACE = _U((1 << PLACE_BITS) - 1)
_BYTE = seeded(256, 101)
_STEP = seeded(8, 102)
_NULL_ID = -(1 << 63)


def _anchors(d: np.ndarray, length: int) -> np.ndarray:
    """For the string at each position of ``d`` (len(d) - length + 1 of them): the top bits of its
    smallest gram's hash, and below them the leftmost place of that gram in ``d``."""
    h = _BYTE[d]
    for step, size in enumerate((1, 2, 4)):
        h = h[:-size] * _STEP[step] + h[size:]
    h8 = mix64(h)
    h16 = h8[:-8] * _STEP[4] + h8[8:]
    low = mix64(h16[:-8] * _STEP[5] + h8[16:])
    low = (low & ~_PLACE) | np.arange(len(low), dtype=np.uint64)
    want, size = length - GRAM + 1, 1
    while size * 2 <= want:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = want - size
    return np.minimum(low[:-rest], low[rest:]) if rest else low


def runs_of(raw: np.ndarray, offs: np.ndarray, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, name, start, count): the runs of all rows, some rows or a piece of a long one at a time."""
    for i, j in slices(offs, _PIECE):
        begin, end = int(offs[i]), int(offs[j])
        for lo in range(begin, max(begin + 1, end - length + 1), _PIECE * 2):
            hi = min(end, lo + _PIECE * 2 + length - 1)
            if hi - lo < length:
                continue
            names = _anchors(raw[lo:hi], length)
            first = np.clip(offs[i : j + 1] - lo, 0, len(names))
            cut = np.unique(np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1, first, [len(names)]]))
            names >>= _U(PLACE_BITS)
            a, b = cut[:-1], cut[1:]
            row = np.searchsorted(offs, a + lo, "right") - 1
            b = np.minimum(b, offs[row + 1] - lo - length + 1)
            keep = a < b
            a, b, row = a[keep], b[keep], row[keep]
            yield row, names[a].view(np.int64), a + lo - offs[row], b - a


def _runs(docs: DataFrame, length: int) -> DataFrame:
    """(key, turn, doc, tag, start, n2): runs of ``n2 DIV 2`` strings whose name is ``key`` xor ``turn``.

    Of a name's runs that come together in a task, one stands for all under the name itself, and the others
    have keys of their own, since it's known of them that they aren't alone: ``n2`` of all these is odd. So a
    frequent name is no hot key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offs, raw = text_bytes(batch.column(2))
            docs, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, name, start, count in runs_of(raw, offs, length):
                _, first, own, size = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
                more = (size > 1)[own]
                rest = np.ones(len(name), bool)
                rest[first] = False
                key = name.copy()
                key[rest] = mix64(name[rest].view(np.uint64) ^ mix64(docs[row[rest]].view(np.uint64) * _STEP[6] + start[rest].astype(np.uint64))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(key ^ name), pa.array(docs[row]), pa.array(tags[row]), pa.array(start.astype(np.int32)), pa.array((2 * count + more).astype(np.int32))], names=["key", "turn", "doc", "tag", "start", "n2"])

    return docs.mapInArrow(run, "key long, turn long, doc long, tag int, start int, n2 int")


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of ``text`` in the order of their suffixes; a suffix comes after its own prefixes."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64) + _U(1), np.zeros(7, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key = (key << _U(9)) | padded[i : i + n]
    order = np.argsort(key)
    key = key[order]
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    slot = np.arange(n)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(head, slot, 0))
    h = 7
    while True:
        alone = head & np.append(head[1:], True)
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        at = order[slots]
        mixed = (rank[at] << 32) | (rank[np.minimum(at + h, n)] + 1)
        by = np.argsort(mixed)
        mixed, at = mixed[by], at[by]
        order[slots] = at
        fresh = np.concatenate([[True], mixed[1:] != mixed[:-1]])
        head[slots] |= fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, slots, 0))
        h *= 2
    return order


def common_prefixes(text: np.ndarray, before: np.ndarray, wanted: np.ndarray, starts: np.ndarray, counts: np.ndarray, cap: int) -> np.ndarray:
    """Kasai's rule over all runs side by side: for each position of the runs, the length (up to
    ``cap``) that it shares with the ``wanted`` position ``before`` it in suffix order; -1 for none.

    A position shares at least one byte less than the one before it in the text did, if that one's
    neighbour has a wanted successor, which then lies between the two in suffix order.
    """
    shared = np.zeros(len(text), np.int64)
    padded = np.concatenate([text, np.zeros(cap + 8, np.uint8)])
    h = np.zeros(len(starts), np.int64)
    wanted = np.append(wanted, False)
    for step in range(int(counts.max(initial=0))):
        live = np.flatnonzero(counts > step)
        at = starts[live] + step
        other = before[at]
        length = np.where(other < 0, 0, np.maximum(h[live] - 1, 0))
        if step:
            last = before[at - 1]
            length[(last < 0) | ~wanted[last + 1]] = 0
        grow = np.flatnonzero((other >= 0) & (length < cap))
        while len(grow):
            same = padded[at[grow] + length[grow]] == padded[other[grow] + length[grow]]
            grow = grow[same]
            length[grow] += 1
            grow = grow[length[grow] < cap]
        h[live] = length
        shared[at] = length
    return shared


def _classes(segments: pa.Array, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, where its runs begin, positions of all strings in suffix order, class number of each)."""
    offs, raw = text_bytes(segments)
    text, starts = raw[offs[0] : offs[-1]], offs[:-1] - offs[0]
    wanted = np.repeat(np.tile([True, False], len(starts)), np.stack([counts, np.diff(offs) - counts], axis=1).ravel())
    order = suffix_array(text)
    order = order[wanted[order]]
    before = np.full(len(text), -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = common_prefixes(text, before, wanted, starts, counts, length)
    return text, starts, order, np.cumsum(shared[order] < length) - 1


def _spans(doc: np.ndarray, tag: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(doc, tag, lo, hi): maximal spans covered by the strings at ``at``."""
    order = np.lexsort((at, tag, doc))
    doc, tag, at = doc[order], tag[order], at[order]
    cut = np.ones(len(at), bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (at[1:] > at[:-1] + length)
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    return doc[first], tag[first], at[first], at[last] + length


def shard_repeats(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, count: np.ndarray, part: np.ndarray, segments: pa.Array, two: bool, length: int = LENGTH) -> pa.Table:
    """Spans of repeats among the runs of one shard, or between its two parts."""
    order = np.lexsort((tag, start, doc))
    doc, tag, start, count, part = doc[order], tag[order], start[order].astype(np.int64), count[order].astype(np.int64), part[order]
    coded = segments.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)[order].astype(np.int64)
    key = code * 2 + (part > part.min()) if two else code
    n = len(key)
    first = np.zeros(int(key.max(initial=0)) + 1, np.int64)
    first[key[::-1]] = np.arange(n)[::-1]
    first = first[key]
    # A copy at the very same place of a document of the same identifier is no earlier one.
    elsewhere = (doc[first] != doc) | (start[first] != start)
    own = np.flatnonzero(~elsewhere)
    found = []
    if not two:
        copy = np.flatnonzero(elsewhere)
        found.append((doc[copy], tag[copy], start[copy], start[copy] + count[copy] + length - 1))
    tables = []
    for side in [own[part[own] == p] for p in np.unique(part[own])] if two else [own]:
        text, begins, at, number = _classes(coded.dictionary.take(pa.array(code[side])), count[side], length)
        seg = np.searchsorted(begins, at, "right") - 1
        where = start[side][seg] + at - begins[seg]
        by = np.lexsort((where, doc[side][seg], number))
        tables.append((text, at[by], number[by], doc[side][seg][by], tag[side][seg][by], where[by]))
    if not two:
        _, _, number, d, t, where = tables[0]
        fresh = np.diff(number, prepend=-1) != 0
        least = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        later = (d != d[least]) | (where != where[least])
        found.append(_spans(d[later], t[later], where[later], length))
    elif len(tables) == 2:
        strings = []
        for text, at, number, *_ in tables:
            heads = np.flatnonzero(np.diff(number, prepend=-1))
            window = np.lib.stride_tricks.sliding_window_view(text, length)[at[heads]]
            strings.append((np.ascontiguousarray(window).view(f"S{length}").ravel(), heads))
        (left, lf), (right, rf) = strings
        place = np.minimum(np.searchsorted(left, right), len(left) - 1)
        for i in np.flatnonzero(left[place] == right):
            a, b = lf[place[i]], rf[i]
            spots = [(tables[0][3][a], tables[0][5][a]), (tables[1][3][b], tables[1][5][b])]
            if spots[0] == spots[1]:
                continue
            late, j = (0, a) if spots[1] < spots[0] else (1, b)
            number, d, t, where = tables[late][2:]
            span = slice(j, np.searchsorted(number, number[j], "right"))
            found.append((d[span], t[span], where[span], where[span] + length))
    d, t, lo, hi = (np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in range(4))
    return pa.table({"doc": pa.array(d), "tag": pa.array(t.astype(np.int32)), "lo": pa.array(lo), "hi": pa.array(hi)})


def _segments(held: DataFrame, length: int) -> DataFrame:
    """(name, doc, tag, start, n, bytes) of the candidate runs; of equal ones that come together in a task all
    but the first are without bytes: they are repeats as a whole, which needs no search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(text_bytes(batch.column(2))[0], _PIECE):
                piece = batch.slice(i, j - i)
                offs, raw = text_bytes(piece.column(2))
                lists = [piece.column(c) for c in (3, 4, 5)]
                names, starts, counts = (c.flatten().to_numpy() for c in lists)
                rows = np.repeat(np.arange(len(piece)), lists[0].value_lengths().to_numpy())
                docs, tags = piece.column(0).to_numpy()[rows], piece.column(1).to_numpy()[rows]
                order = np.lexsort((tags, starts, docs))
                seen: dict[tuple, tuple] = {}
                for lo in range(0, len(order), 50_000):
                    at = order[lo : lo + 50_000]
                    a = offs[rows[at]] + starts[at]
                    places = zip(docs[at].tolist(), starts[at].tolist())
                    parts = [raw[x:y].tobytes() for x, y in zip(a.tolist(), (a + counts[at] + length - 1).tolist())]
                    if len(seen) > 100_000:
                        seen = {}
                    parts = [part if seen.setdefault(part, place) == place else None for part, place in zip(parts, places)]
                    yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(docs[at]), pa.array(tags[at]), pa.array(starts[at]), pa.array(counts[at]), pa.array(parts, pa.binary())], names=["name", "doc", "tag", "start", "n", "bytes"])

    return held.select("doc", "tag", "text", "names", "starts", "counts").mapInArrow(run, "name long, doc long, tag int, start int, n int, bytes binary")


def repeats(held: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """(doc, tag, lo, hi): spans of repeated bytes among the candidate runs of ``held``."""
    candidates = held.select(F.explode(F.arrays_zip(F.col("names").alias("name"), F.col("counts").alias("n"))).alias("r")).select("r.name", "r.n")
    total = candidates.agg(F.sum(F.col("n") + length - 1)).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    shard = F.pmod(F.col("name"), F.lit(shards))
    # One row for each shard: as many as there are shard_bytes in the candidates.
    sizes = candidates.groupBy(shard.alias("shard")).agg(F.ceil(F.sum(F.col("n") + length - 1) / (4 * shard_bytes)).cast("int").alias("parts"))
    whole = F.col("bytes").isNull()
    dealt = _segments(held, length).withColumn("shard", F.when(whole, F.pmod(F.xxhash64("doc"), F.lit(shards))).otherwise(shard)).join(staged(sizes, "suffix-shards"), "shard", "left")
    dealt = dealt.withColumn("part", F.when(whole, -1).otherwise(F.pmod(F.xxhash64("doc", "start"), F.col("parts")).cast("int")))
    dealt = dealt.withColumn("other", F.explode(F.when(whole, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))).withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        if key[1].as_py() < 0:
            start, n = (table.column(c).to_numpy().astype(np.int64) for c in ("start", "n"))
            return pa.table({"doc": table.column("doc"), "tag": table.column("tag"), "lo": pa.array(start), "hi": pa.array(start + n + length - 1)})
        cols = [table.column(c).to_numpy() for c in ("doc", "tag", "start", "n", "part")]
        return shard_repeats(*cols, table.column("bytes").combine_chunks(), key[1] != key[2], length)

    wanted = dealt.select("shard", "i", "j", "doc", "tag", "start", "n", "part", "bytes")
    return staged(wanted.groupBy("shard", "i", "j").applyInArrow(run, "doc long, tag int, lo long, hi long"), "suffix-repeats")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, kept_sha256) of every row; ``kept`` holds the bytes that stay."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("doc"), F.pmod(F.xxhash64(text), F.lit(2147483629)).cast("int").alias("tag"), text.alias("text"))
    named = _runs(base, length).withColumn("seen", F.sum(1 + F.col("n2") % 2).over(Window.partitionBy("key")))
    run = F.struct(F.col("key").bitwiseXOR(F.col("turn")).alias("name"), "start", F.shiftright("n2", 1).alias("n"))
    lists = named.filter("seen > 1").groupBy("doc", "tag").agg(F.collect_set(run).alias("c"))
    both = base.hint("merge").join(lists.hint("merge"), ["doc", "tag"], "left")
    plain = F.col("c").isNull()
    both = both.select("doc", "tag", F.octet_length("text").cast("long").alias("n_bytes"), F.when(plain, F.sha2("text", 256)).alias("sha"), "text", F.col("c.name").alias("names"), F.col("c.start").alias("starts"), F.col("c.n").alias("counts"))
    both = staged(both, "suffix-documents")
    held = both.filter("names IS NOT NULL")
    spans = repeats(held, length, shard_bytes)
    spans = spans.groupBy("doc", "tag").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, n_spans, kept, sha = [], [], [], []
            for value, spans in zip(batch.column(2), batch.column(3).to_pylist()):
                raw = value.as_py().encode()
                parts, at, gone, maximal, end = [], 0, 0, 0, -1
                for span in spans or ():
                    lo, hi = span["lo"], span["hi"]
                    maximal += lo > end
                    if hi > at:
                        lo = max(lo, at)
                        parts.append(raw[at:lo])
                        gone += hi - lo
                        at = hi
                    end = max(end, hi)
                parts.append(raw[at:])
                left = b"".join(parts)
                removed.append(gone)
                n_spans.append(maximal)
                kept.append(left)
                sha.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(sha, pa.string())], names=["doc", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    cut = held.select("doc", "tag", "n_bytes", "text").hint("merge").join(spans.hint("merge"), ["doc", "tag"], "left")
    cut = cut.select("doc", "n_bytes", "text", "s").mapInArrow(run, "doc long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    clean = both.filter("names IS NULL").select("doc", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept"), F.col("sha").alias("kept_sha256"))
    out = clean.unionByName(cut)
    return out.select(F.when(F.col("doc") != _NULL_ID, F.col("doc")).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")
