"""Files of canonical length-limited Huffman codes of token ids, in blocks that decode alone.

Code lengths come from counts over the whole corpus by package-merge, with no code longer than
``MAX_BITS``; canonical codes follow from the lengths alone. A file is a header frame, which holds
the lengths, and block frames; every frame ends with a line feed, which its length field does not
count. A block holds whole documents: their ids, their token counts, the packed bits and, for every
``STRIDE`` tokens, the bits of that stretch. Running sums of these are bit-offset checkpoints from
which all stretches of a block decode side by side by one table lookup a token.

Layout, little-endian. Frame: 4-byte magic, uint32 body length, body, line feed. Header body:
uint32 part number, uint32 vocabulary size, uint8 code lengths. Block body: uint64 tokens of this
file before the block, uint32 documents, uint32 stretches, int64 ids, uint32 token counts, uint16
bits of each stretch, bytes of the bits (first bit highest).

Null text is empty: the document has its end id alone. Documents stand in ascending order of their
identifiers; nulls come first, and repeated identifiers stand next to each other in no set order.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import scratch, slices, staged, text_bytes
from quarry.llm.tokens import DEFAULT_TOKENIZER, encoder, tokenizer_path

MAX_BITS = 18
STRIDE = 128
BLOCK_TOKENS = 1 << 19
#: Bytes of ids that one file gets, before coding.
FILE_BYTES = 32 << 20
#: Bytes of text that are encoded at a time.
PART_BYTES = 8 << 20
#: Files whose token counts are summed up in one go.
RUN_FILES = 4096
NULL_ID = -(1 << 63)


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids that never occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        merged = np.concatenate([leaves, packages])
        at = np.argsort(merged, kind="stable")
        levels.append(at < len(leaves))
        merged = merged[at]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id, in ``lengths`` bits: ascending by length, then by id."""
    codes = np.zeros(len(lengths), np.uint64)
    code = 0
    for bits in range(1, int(lengths.max(initial=0)) + 1):
        code <<= 1
        ids = np.flatnonzero(lengths == bits)
        codes[ids] = np.arange(code, code + len(ids), dtype=np.uint64)
        code += len(ids)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each string of the longest code's bits: the id that it begins with, and its code's bits."""
    bits = max(1, int(lengths.max(initial=0)))
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    span = np.left_shift(1, bits - lengths[used].astype(np.int64))
    ids, sizes = np.repeat(used, span), np.repeat(lengths[used], span)
    rest = (1 << bits) - len(ids)
    return np.pad(ids, (0, rest)).astype(np.uint32), np.pad(sizes, (0, rest), constant_values=1).astype(np.int64), bits


def encode_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The packed bits of ``ids`` and the number of bits of each stretch."""
    if not len(ids):
        return b"", np.zeros(0, np.uint16)
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    word, shift = at >> 6, 64 - (at & 63) - size
    code = codes[ids]
    spill = shift < 0
    main = np.where(spill, code >> np.maximum(-shift, 0).astype(np.uint64), code << np.maximum(shift, 0).astype(np.uint64))
    out = np.zeros((int(ends[-1]) + 63 >> 6) + 1, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] = np.bitwise_or.reduceat(main, first)
    out[word[spill] + 1] |= code[spill] << (64 + shift[spill]).astype(np.uint64)
    stretch = np.add.reduceat(size, np.arange(0, len(ids), STRIDE)).astype(np.uint16)
    return out.astype(">u8").tobytes()[: int(ends[-1]) + 7 >> 3], stretch


def decode_bits(raw: bytes, stretch: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """``n`` ids from packed bits; all stretches advance together."""
    ids, sizes, bits = table
    data = np.frombuffer(raw + bytes(8), np.uint8).astype(np.uint32)
    window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    at = np.concatenate([[0], np.cumsum(stretch.astype(np.int64))[:-1]]) if len(stretch) else np.zeros(0, np.int64)
    out = np.zeros((STRIDE, len(stretch)), np.uint32)
    tail = n - (len(stretch) - 1) * STRIDE
    mask, drop = np.uint32((1 << bits) - 1), 32 - bits
    for step in range(min(STRIDE, n)):
        if step == tail and len(at):
            at = at[:-1]
        if not len(at):
            break
        peek = (window[at >> 3] >> (drop - (at & 7)).astype(np.uint32)) & mask
        out[step, : len(at)] = ids[peek]
        at = at + sizes[peek]
    return out.T.reshape(-1)[:n]


def frame(magic: bytes, body: bytes) -> bytes:
    return magic + struct.pack("<I", len(body)) + body + b"\n"


def frames(raw) -> Iterator[tuple[bytes, memoryview]]:
    view, at = memoryview(raw), 0
    while at + 8 <= len(view):
        size = struct.unpack_from("<I", view, at + 4)[0]
        if at + 9 + size > len(view) or view[at + 8 + size] != 10:
            raise ValueError("a frame is cut short or doesn't end where it says")
        yield bytes(view[at : at + 4]), view[at + 8 : at + 8 + size]
        at += 9 + size + (at + 9 + size < len(view) and view[at + 9 + size] == 10)


def tokenized(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int | None) -> DataFrame:
    """(id, ids, counts): ids packed in 2 or 4 bytes each, the end id included.

    Each task's last row has no ids, but its counts of all ids of the vocabulary.
    """
    path = tokenizer_path(tokenizer)
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(docs.schema[id_col].dataType)

    def rows(ids: pa.Array, packed: pa.Array, counts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids.cast(kind), packed, pa.array(counts, pa.binary())], names=["id", "ids", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        total = np.zeros(enc.size, "<i8")
        for batch in batches:
            for i, j in slices(text_bytes(batch.column(1))[0], PART_BYTES):
                at, found = enc.encode_column(batch.column(1).slice(i, j - i))
                if end_id is not None:
                    found = np.insert(found, at[1:], end_id)
                    at = at + np.arange(len(at))
                total += np.bincount(found, minlength=enc.size)
                packed = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((at * enc.dtype.itemsize).astype("<i4")), pa.py_buffer(found)])
                yield rows(batch.column(0).slice(i, j - i), packed, [None] * (j - i))
        yield rows(pa.array([None], kind), pa.array([None], pa.binary()), [total.tobytes()])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, ids binary, counts binary")


def id_counts(tokens: DataFrame, tokenizer: str) -> np.ndarray:
    """How often each id occurs; what reaches the driver is bounded by the vocabulary."""
    size = encoder(tokenizer_path(tokenizer)).size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.frombuffer(value.as_buffer(), "<i8")
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["token", "n"])

    found = tokens.filter("counts IS NOT NULL").select("counts").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[found["token"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER, end_id: int | None = 2, file_bytes: int = FILE_BYTES) -> None:
    """Encodes ``docs`` into files under ``folder``, in ascending order of the integer ``id_col``."""
    path = tokenizer_path(tokenizer)
    tokens = staged(tokenized(docs, id_col, text_col, tokenizer, end_id), "token-ids")
    counts = id_counts(tokens, tokenizer)
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)
    parts = max(1, -(-int(counts.sum()) * encoder(path).dtype.itemsize // file_bytes))
    tokens = tokens.filter("ids IS NOT NULL").select("id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(path).dtype
        made = [frame(b"QTH1", struct.pack("<II", TaskContext.get().partitionId(), len(lengths)) + lengths.tobytes())]
        before, held, size = 0, [], 0

        def block() -> bytes:
            sizes = np.array([len(i) for _, i in held], "<u4")
            raw, stretch = encode_bits(np.concatenate([i for _, i in held]), codes, lengths)
            ids = np.array([NULL_ID if d is None else d for d, _ in held], "<i8")
            return frame(b"QTB1", struct.pack("<QII", before, len(held), len(stretch)) + ids.tobytes() + sizes.tobytes() + stretch.astype("<u2").tobytes() + raw)

        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(value.as_buffer(), dtype)
                held.append((doc, ids))
                size += len(ids)
                if size >= BLOCK_TOKENS or len(held) >= 1 << 16:
                    made.append(block())
                    before, held, size = before + size, [], 0
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(made)[:-1]], pa.binary())], names=["frame"])
                    made = []
        if held:
            made.append(block())
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(made)[:-1]], pa.binary())], names=["frame"])

    ordered = tokens.repartitionByRange(int(parts), "id").sortWithinPartitions("id")
    # The text sink writes each row's bytes as they are and then a line feed, which ends the frame.
    ordered.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value")).write.text(folder)


def _parsed(spark: SparkSession, folder: str, parse, schema: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from parse(content.as_buffer())

    return files.mapInArrow(run, schema)


def read_token_files(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids as little-endian uint32) of every document in the files."""

    def sizes(raw) -> Iterator[pa.RecordBatch]:
        part, n = None, 0
        for magic, body in frames(raw):
            if magic == b"QTH1":
                part = struct.unpack_from("<I", body)[0]
            else:
                _, docs, _ = struct.unpack_from("<QII", body)
                n += int(np.frombuffer(body, "<u4", docs, 16 + 8 * docs).sum(dtype=np.int64))
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n], pa.int64())], names=["part", "n"])

    files = staged(_parsed(spark, folder, sizes, "part long, n long").withColumn("run", F.expr(f"part DIV {RUN_FILES}")), "token-sizes")
    # Prefix sums in two steps: within runs of files, and over the runs' totals, one row for RUN_FILES files.
    runs = files.groupBy("run").agg(F.sum("n").alias("total"))
    runs = runs.select("run", (F.sum("total").over(Window.orderBy("run")) - F.col("total")).alias("before"))
    inner = F.sum("n").over(Window.partitionBy("run").orderBy("part")) - F.col("n")
    starts = staged(files.withColumn("inner", inner).join(runs, "run").select("part", (F.col("before") + F.col("inner")).alias("before")), "token-starts")

    def blocks(raw) -> Iterator[pa.RecordBatch]:
        for magic, body in frames(raw):
            if magic == b"QTH1":
                part, size = struct.unpack_from("<II", body)
                table = decode_table(np.frombuffer(body, np.uint8, size, 8))
                continue
            first, docs, stretches = struct.unpack_from("<QII", body)
            at = 16
            ids = np.frombuffer(body, "<i8", docs, at)
            sizes = np.frombuffer(body, "<u4", docs, at + 8 * docs).astype(np.int64)
            at += 12 * docs
            stretch = np.frombuffer(body, "<u2", stretches, at)
            n = int(sizes.sum())
            tokens = decode_bits(bytes(body[at + 2 * stretches :]), stretch, n, table).astype("<u4")
            ends = np.cumsum(sizes)
            begins = ends - sizes
            raw_tokens = tokens.tobytes()
            pieces = pa.Array.from_buffers(pa.binary(), docs, [None, pa.py_buffer(np.append(begins, n).astype("<i4") * 4), pa.py_buffer(raw_tokens)])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=ids == NULL_ID), pa.array(np.full(docs, part, np.int64)), pa.array(begins + first), pa.array(sizes), pieces], names=["id", "part", "inner", "n_tokens", "ids"])

    # The files' starts are as many rows as files; Spark broadcasts them while their size allows it.
    found = _parsed(spark, folder, blocks, "id long, part long, inner long, n_tokens long, ids binary").join(starts, "part")
    return found.select(F.col("id").alias(id_col), (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids")


def token_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER, end_id: int | None = 2) -> DataFrame:
    """Writes the files into the shared folder and reads them back."""
    folder = scratch(docs.sparkSession, "token-files")
    write_token_files(docs, folder, id_col, text_col, tokenizer, end_id)
    return read_token_files(docs.sparkSession, folder, id_col)
