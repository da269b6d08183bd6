"""Vector codes: parts of vectors coded by codebooks that filtering Lloyd iterations fit.

Components become integers, and vectors are cut into equal parts, each with a codebook of its own.
Every task keeps its vectors in blocks of bounded size; for each part a block holds a kd-tree with the
bounding box, sum and count of every node, built once and written, so that all rounds read it. A
round sends the codebooks (a fixed size) to the blocks and goes down each tree level by level: of a
node's candidates the one nearest to its box's middle is taken, and those that are nowhere in the
box nearer than it are dropped. A node with one candidate left is assigned whole, by its cached sum and count;
only leaves with several are looked at point by point. All is integer arithmetic, so ties go to
the lower index exactly, and results don't depend on blocks or their order.

Vectors that are null, empty, or hold null or non-finite components are dropped, and so are those whose
length is not that of the vector with the smallest identifier. A length that isn't a multiple of the number of
parts raises ``ValueError``. Components beyond ``LIMIT`` (after scaling) are clipped to it, which keeps sums of
squares exact. Rows with one identifier are ordered by their vectors; null identifiers come last. Fewer vectors
than entries make smaller codebooks. Null labels are one label. An empty table gives no rows. Other
columns are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import staged

#: Vectors of a block, and the most points of a leaf.
BLOCK_ROWS, LEAF = 1 << 13, 8
#: Greatest scaled component.
LIMIT = 1 << 26


def _bounds(n: int) -> list[np.ndarray]:
    """Where the nodes of each level of a balanced tree over ``n`` points begin, and ``n``; leaves last."""
    levels = [np.array([0, n])]
    while (np.diff(levels[-1]) > LEAF).any():
        b = levels[-1]
        levels.append(np.sort(np.concatenate([b, (b[:-1] + b[1:]) // 2])))
    return levels


def _tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of ``points`` (n, d) in the tree, and box corners and sums of all nodes, level by level."""
    order, lows, highs, sums = np.arange(len(points)), [], [], []
    levels = _bounds(len(points))
    for i, b in enumerate(levels):
        now = points[order]
        lows.append(np.minimum.reduceat(now, b[:-1]))
        highs.append(np.maximum.reduceat(now, b[:-1]))
        sums.append(np.add.reduceat(now, b[:-1]))
        if i < len(levels) - 1:
            node = np.repeat(np.arange(len(b) - 1), np.diff(b))
            widest = np.argmax(highs[-1] - lows[-1], 1)
            order = order[np.lexsort((now[np.arange(len(now)), widest[node]], node))]
    return order, np.concatenate(lows), np.concatenate(highs), np.concatenate(sums)


def _squares(a: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, a)


def _nearest(group: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ascending ``group`` numbers: each row's group counted from 0, and the first row with the least distance of each group."""
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    place = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(group))))
    least = np.flatnonzero(distance == np.minimum.reduceat(distance, begins)[place])
    return place, least[np.unique(place[least], return_index=True)[1]]


def _descend(points: np.ndarray, low: np.ndarray, high: np.ndarray, total: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of ``points`` (in tree order), and the sums and counts of each entry's points."""
    n, levels, first = len(points), _bounds(len(points)), 0
    found = np.zeros(n, np.int64)
    sums, counts = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
    node, entry = np.zeros(len(book), np.int64), np.arange(len(book))
    for depth, b in enumerate(levels):
        lo, hi, cached = low[first : first + len(b) - 1], high[first : first + len(b) - 1], total[first : first + len(b) - 1]
        first += len(b) - 1
        mine = book[entry]
        place, best = _nearest(node, _squares(lo[node] + hi[node] - 2 * mine))
        rival_entry = entry[best][place]
        rival = book[rival_entry]
        corner = np.where(mine > rival, hi[node], lo[node])
        far, near = _squares(corner - mine), _squares(corner - rival)
        stays = (far < near) | (far == near) & (entry <= rival_entry)
        node, entry = node[stays], entry[stays]
        candidates = np.bincount(node, minlength=len(b) - 1)
        alone = candidates[node] == 1
        at, to = node[alone], entry[alone]
        size = np.diff(b)[at]
        np.add.at(sums, to, cached[at])
        np.add.at(counts, to, size)
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        found[np.repeat(b[at], size) + within] = np.repeat(to, size)
        node, entry = node[~alone], entry[~alone]
        if not len(node):
            return found, sums, counts
        if depth < len(levels) - 1:
            node, entry = np.concatenate([2 * node, 2 * node + 1]), np.concatenate([entry, entry])
            by_node = np.argsort(node, kind="stable")
            node, entry = node[by_node], entry[by_node]
    for k in range(LEAF):
        has = np.diff(levels[-1])[node] > k
        if has.any():
            at, to = levels[-1][node[has]] + k, entry[has]
            _, best = _nearest(at, _squares(points[at] - book[to]))
            found[at[best]] = to[best]
            np.add.at(sums, to[best], points[at[best]])
            np.add.at(counts, to[best], 1)
    return found, sums, counts


_TREES = {"points": T.BinaryType(), "places": T.BinaryType(), "lows": T.BinaryType(), "highs": T.BinaryType(), "sums": T.BinaryType()}


def _blocks(kept: DataFrame, parts: int, width: int, block_rows: int) -> DataFrame:
    """Blocks of vectors: identifiers, labels, and the trees of all parts."""
    schema = T.StructType([T.StructField(c, T.ArrayType(kept.schema[c].dataType)) for c in ("id", "label")] + [T.StructField(c, t) for c, t in _TREES.items()])

    def block(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        flat = rows.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, parts, width)
        made: dict[str, list[np.ndarray]] = {c: [] for c in _TREES}
        for p in range(parts):
            points = np.ascontiguousarray(flat[:, p])
            order, low, high, total = _tree(points)
            for c, x in zip(_TREES, (points[order].astype(np.int32), order.astype(np.int32), low.astype(np.int32), high.astype(np.int32), total), strict=True):
                made[c].append(x)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows.column(c).combine_chunks()) for c in ("id", "label")]
        return pa.RecordBatch.from_arrays(lists + [pa.array([np.stack(made[c]).tobytes()], pa.binary()) for c in _TREES], names=schema.names)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in found:
            while batch.num_rows:
                take = min(batch.num_rows, block_rows - n)
                held.append(batch.slice(0, take))
                batch, n = batch.slice(take), n + take
                if n == block_rows:
                    yield block(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield block(pa.Table.from_batches(held))

    return staged(kept.mapInArrow(batches, schema), "vector-blocks")


def _trees(batch: pa.RecordBatch, row: int, parts: int, width: int) -> Iterator[tuple]:
    """Places, points, box corners and sums of each part of one block."""
    raw = {c: np.frombuffer(batch.column(c)[row].as_buffer(), np.int64 if c == "sums" else np.int32) for c in _TREES}
    places = raw["places"].reshape(parts, -1)
    whole = {c: raw[c].reshape(parts, -1, width).astype(np.int64) for c in ("points", "lows", "highs", "sums")}
    for p in range(parts):
        yield places[p], whole["points"][p], whole["lows"][p], whole["highs"][p], whole["sums"][p]


def _round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one assignment of all parts; entries without parts stay."""
    parts, entries, width = books.shape

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((parts, entries, width + 1), np.int64)
        for batch in found:
            for row in range(batch.num_rows):
                for p, (_, *tree) in enumerate(_trees(batch, row, parts, width)):
                    _, sums, counts = _descend(*tree, books[p])
                    held[p, :, :width] += sums
                    held[p, :, width] += counts
        flat = held.reshape(-1)
        full = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(flat[full])], ["place", "value"])

    # One number for each component and entry, however many blocks there are.
    rows = blocks.select(*_TREES).mapInArrow(batches, "place long, value long").groupBy("place").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(parts * entries * (width + 1), np.int64)
    flat[[r.place for r in rows]] = [r.value for r in rows]
    made = flat.reshape(parts, entries, width + 1)
    used = made[..., width:] > 0
    return np.where(used, made[..., :width] // np.maximum(made[..., width:], 1), books)


def _codes(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error) of every vector."""
    parts, _, width = books.shape
    kinds = {c: blocks.schema[c].dataType.elementType for c in ("id", "label")}
    schema = T.StructType([T.StructField(c, t) for c, t in kinds.items()] + [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for row in range(batch.num_rows):
                n = len(batch.column("id")[row])
                code, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
                for p, (places, points, *rest) in enumerate(_trees(batch, row, parts, width)):
                    entry, _, _ = _descend(points, *rest, books[p])
                    code[places, p] = entry
                    error[places] += _squares(points - books[p][entry])
                digits = code.tobytes().hex()
                hexed = pa.array([digits[2 * parts * i : 2 * parts * (i + 1)] for i in range(n)])
                yield pa.RecordBatch.from_arrays([batch.column("id")[row].values, batch.column("label")[row].values, hexed, pa.array(error)], names=schema.names)

    return blocks.mapInArrow(batches, schema)


def scaled(vector: Column, scale: int = 256) -> Column:
    """Whole components of a vector: floor(scale * x), clipped to ``LIMIT``."""
    return F.transform(vector, lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-LIMIT)), F.lit(LIMIT)).cast("long"))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error, label_error) of each vector, and the codebooks (parts, entries, components).

    A code has two hex digits for each part; ``label_error`` is the error summed over the vectors of one label.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code digit pair tells 1 to 256 entries apart")
    plain = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.filter(F.col(vector_col).isNotNull() & plain & (F.size(vector_col) > 0))
    kept = kept.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), scaled(F.col(vector_col), scale).alias("vector"))
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    first = kept.orderBy(*order).select("vector").first()
    size = len(first.vector) if first else parts
    if size % parts:
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts")
    kept = kept.filter(F.size("vector") == size)
    # The first vectors, as many as a codebook has entries.
    initial = [r.vector for r in kept.orderBy(*order).select("vector").limit(entries).collect()]
    books = np.array(initial, np.int64).reshape(len(initial), parts, size // parts).transpose(1, 0, 2)
    blocks = _blocks(kept, parts, size // parts, block_rows)
    for _ in range(rounds if initial else 0):
        books = _round(blocks, books)
    codes = staged(_codes(blocks, books), "vector-codes")
    # Written, so that its size is known: labels may be few or as many as vectors, and one may have most of them.
    sums = staged(codes.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of_label"))).drop("of_label"), books


def reconstructed(code: Column, books: np.ndarray, scale: int = 256) -> Column:
    """The vector that a code stands for, with components as numbers of the original scale."""
    table = F.array(*(F.array(*(F.array(*(F.lit(int(x) / scale) for x in entry)) for entry in book)) for book in books))
    at = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
    return F.flatten(F.array(*(F.get(F.get(table, F.lit(p)), at(p)) for p in range(len(books)))))


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in order, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(str(x) for x in books.reshape(-1).tolist()).encode()).hexdigest()
