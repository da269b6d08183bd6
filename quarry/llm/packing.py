"""Sum-of-squares online packing of token sequences into windows of a fixed length.

Each task packs the documents of its input partition in one pass without a shuffle. Whole windows
of a long document are emitted at once. Its rest goes to the fill level, of those with room, for
which the sum of the squared counts of partially filled windows becomes least; an array over all
levels holds those counts. When more than ``max_open`` windows are open, and at the end of the
task, the open windows are placed again by the same rule, whole and then piece by piece, from the largest to the
smallest, as long as that fills some. Only what is open after that is strung together and cut into full
windows. So a task holds a bounded number of tokens and leaves one window that is not full.

Null text is empty: such a document consists of its end id. Repeated rows are packed each.
Null identifiers are kept. Other columns pass by unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quarry.llm.common import slices, text_bytes
from quarry.llm.tokens import DEFAULT_TOKENIZER, encoder, tokenizer_path

WINDOW = 1024
#: Windows that a task keeps open; with rests of all sizes about 1,600 stay open however long the task is.
MAX_OPEN = 4096
_PART_BYTES = _OUT_BYTES = 8 << 20


class Packer:
    """Places pieces ``(doc, start, ids, doc_tokens)``; yields them with window number, offset and the window's padding."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.levels = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.n_open = self.closed = 0
        #: Windows that hold a piece of a long document alone, that a placement has filled, and that were cut.
        self.whole = self.filled = self.cut = 0

    def _close(self, pieces: list) -> Iterator[tuple]:
        at, number = 0, self.closed
        self.closed += 1
        size = sum(len(piece[2]) for piece in pieces)
        padding = self.window - size if size & (size - 1) else 0
        for piece in pieces:
            yield *piece, number, at, padding
            at += len(piece[2])

    def level_for(self, size: int) -> int:
        """The fill level for which the sum of squares grows least; ties go to the fullest."""
        room = self.window - size
        here = self.levels[: room + 1]
        there = 2 * self.levels[size:] + 1
        there[-1] = 0
        grows = there + np.where(here > 0, 1 - 2 * here, np.iinfo(np.int64).max // 4)
        grows[0] = there[0]
        return room - int(np.argmin(grows[::-1]))

    def _place(self, pieces: list) -> Iterator[tuple]:
        """Puts pieces that stay together into the level of the least sum of squares."""
        size = sum(len(piece[2]) for piece in pieces)
        level = self.level_for(size)
        if level:
            pieces = self.open[level].pop() + pieces
            self.levels[level] -= 1
            self.n_open -= 1
        if level + size == self.window:
            self.filled += 1
            yield from self._close(pieces)
        else:
            self.open[level + size].append(pieces)
            self.levels[level + size] += 1
            self.n_open += 1

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        n, whole = len(ids), len(ids) - len(ids) % self.window
        for start in range(0, whole, self.window):
            self.whole += 1
            yield from self._close([(doc, start, ids[start : start + self.window], n)])
        if n > whole:
            yield from self._place([(doc, whole, ids[whole:], n)])
            if self.n_open > self.max_open:
                yield from self.drain(False)

    def _taken(self) -> list[list]:
        """The open windows, from the fullest; none is open afterwards."""
        taken = [pieces for level in reversed(self.open) for pieces in level]
        self.open = [[] for _ in range(self.window)]
        self.levels[:] = 0
        self.n_open = 0
        return taken

    def _again(self) -> Iterator[tuple]:
        """Places the open windows anew, as wholes and as single pieces in turn, until neither fills a window."""
        idle, single = 0, False
        while idle < 2 and self.n_open > 1:
            before, held = self.filled, self._taken()
            if single:
                held = sorted(([piece] for pieces in held for piece in pieces), key=lambda p: -len(p[0][2]))
            for pieces in held:
                yield from self._place(pieces)
            idle, single = (idle + 1 if self.filled == before else 0), not single

    def drain(self, last: bool) -> Iterator[tuple]:
        """Places open windows again; strings together what is left and cuts it full. One window stays open, or closes at last."""
        yield from self._again()
        held, fill = [], 0
        for pieces in self._taken():
            for doc, start, ids, n in pieces:
                while fill + len(ids) >= self.window:
                    cut = self.window - fill
                    self.cut += 1
                    yield from self._close([*held, (doc, start, ids[:cut], n)])
                    held, fill, start, ids = [], 0, start + cut, ids[cut:]
                if len(ids):
                    held.append((doc, start, ids, n))
                    fill += len(ids)
        if held and last:
            yield from self._close(held)
        elif held:
            self.open[fill].append(held)
            self.levels[fill] = self.n_open = 1


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER, window: int = WINDOW, end_id: int = 0, max_open: int = MAX_OPEN) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset, padding.

    A sequence is shorter than ``window`` only if it is the last of its task; then ``padding`` says with how
    many ids it is to be filled up, which is none if its length is a power of two.
    """
    path = tokenizer_path(tokenizer)
    schema = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("padding", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(path), Packer(window, max_open)
        first = TaskContext.get().partitionId() << 36
        end = np.array([end_id], "<u4")

        def pieces() -> Iterator[tuple]:
            for batch in batches:
                docs, texts = batch.column(0).to_pylist(), batch.column(1)
                for i, j in slices(text_bytes(texts)[0], _PART_BYTES):
                    at, ids = enc.encode_column(texts.slice(i, j - i))
                    for k in range(j - i):
                        yield from packer.add(docs[i + k], np.concatenate([ids[at[k] : at[k + 1]].astype("<u4"), end]))
            yield from packer.drain(True)

        held: list[tuple] = []
        total = 0

        def batch() -> pa.RecordBatch:
            doc, start, ids, n, number, at, padding = zip(*held)
            cols = [start, [len(x) for x in ids], [x.tobytes() for x in ids], n, [first + x for x in number], at, padding]
            return pa.RecordBatch.from_arrays([pa.array(doc, id_type), *(pa.array(c, f.type) for c, f in zip(cols, schema))], names=[id_col, *schema.names])

        for piece in pieces():
            held.append(piece)
            total += piece[2].nbytes
            if total >= _OUT_BYTES or len(held) >= 8192:
                yield batch()
                held, total = [], 0
        if held:
            yield batch()

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema[id_col].dataType)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padding long")
