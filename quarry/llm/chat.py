"""Conversations as token ids, assembled from separately encoded segments.

A turn's content is encoded on its own; reserved ids beyond the vocabulary stand for the control
strings of the template. Positions of segments are prefix sums of segment lengths, within a turn
and over the turns of a conversation, and the loss mask is the token range of each assistant text.

Template: a user turn is ``<s>[INST]`` text ``[/INST]``, a system turn ``<s><<SYS>>`` text
``<</SYS>>``, an assistant turn is its text and ``</s>``, any other turn ``[ROLE]`` role ``[/ROLE]``
text ``</s>``. A control string within a text gets a backslash after its first character, or one
more if it has some there already, so escaping can be undone.

Null texts are empty. A null role is a role of its own, read back as null. Turns are ordered by
turn, then role and text (a null one as empty), nulls first; repeated rows are turns each. Null conversation identifiers
form one conversation. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from quarry.llm.common import slices, text_bytes
from quarry.llm.tokens import DEFAULT_TOKENIZER, encoder, tokenizer_path

#: Fixed control strings; the n-th stands for the id of the vocabulary's size plus n.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[NULL]")
BOS, EOS, USER, USER_END, SYSTEM, SYSTEM_END, ROLE, ROLE_END, NULL = range(len(CONTROL))
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
_PLAIN = re.compile(rf"([<\[]\\*)(?={_TAILS})")
_ESCAPED = re.compile(rf"([<\[]\\*)\\(?={_TAILS})")


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_segments(role: str | None, text: str) -> tuple[list[int | str], int | None]:
    """Control numbers and texts of a turn in order, and which of them carries loss."""
    if role == "user":
        return [BOS, USER, text, USER_END], None
    if role == "system":
        return [BOS, SYSTEM, text, SYSTEM_END], None
    if role == "assistant":
        return [text, EOS], 0
    return [ROLE, NULL if role is None else role, ROLE_END, text, EOS], None


def format_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(conv, place, offset, ids, loss_start, loss_end): one row per turn, in token positions of the conversation.

    A conversation's ids are those of its turns in order of place; ids are little-endian uint32.
    """
    path = tokenizer_path(tokenizer)
    conv = to_arrow_type(rows.schema[conv_col].dataType)
    kinds = [rows.schema[c].dataType.simpleString() for c in (conv_col, turn_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for i, j in slices(text_bytes(batch.column(3))[0]):
                part = batch.slice(i, j - i)
                turns = [turn_segments(role, text or "") for role, text in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                begins, words = enc.encode_column(pa.array([escape(p) for parts, _ in turns for p in parts if isinstance(p, str)], pa.string()))
                spans = zip(begins[:-1], begins[1:])
                out, sizes, starts, ends = [], [], [], []
                for parts, loss in turns:
                    ids = [np.array([enc.size + p], "<u4") if isinstance(p, int) else words[slice(*next(spans))].astype("<u4") for p in parts]
                    at = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
                    out.append(np.concatenate(ids).tobytes())
                    sizes.append(int(at[-1]))
                    starts.append(None if loss is None else int(at[loss]))
                    ends.append(None if loss is None else int(at[loss + 1]))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(conv), part.column(1), part.column(2), part.column(4), pa.array(out, pa.binary()), *(pa.array(c, pa.int64()) for c in (sizes, starts, ends))], names=["conv", "turn", "role", "text", "ids", "size", "loss_start", "loss_end"])

    # The text itself orders turns of one place; it leaves again with the shuffle that orders them.
    texts = rows.select(conv_col, turn_col, role_col, text_col, F.coalesce(F.col(text_col), F.lit("")))
    made = texts.mapInArrow(run, f"conv {kinds[0]}, turn {kinds[1]}, role string, text string, ids binary, size long, loss_start long, loss_end long")
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = made.withColumn("place", F.row_number().over(order)).withColumn("offset", before)
    return placed.select(F.col("conv").alias(conv_col), "place", "offset", "ids", (F.col("loss_start") + F.col("offset")).alias("loss_start"), (F.col("loss_end") + F.col("offset")).alias("loss_end"))


class TurnReader:
    """Reads a turn's ids back into role, text, formatted text and the text under the loss mask."""

    def __init__(self, path: str):
        enc = encoder(path)
        self.size = enc.size
        back = {c: b for b, c in enc.names.items()}
        self.bytes: list[bytes] = [b""] * enc.size
        for token, number in enc.tok.get_vocab(with_added_tokens=True).items():
            self.bytes[number] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()

    def text(self, ids: list[int]) -> str:
        """The formatted text of ids, control strings included."""
        raw, known, n = [], self.bytes, self.size
        for i in ids:
            raw.append(known[i] if i < n else CONTROL[i - n].encode())
        return b"".join(raw).decode()

    def turn(self, ids: list[int]) -> tuple[str | None, str]:
        n = self.size
        at = [k for k, i in enumerate(ids) if i >= n]
        kinds = [ids[k] - n for k in at]
        if kinds[:2] == [BOS, USER]:
            return "user", unescape(self.text(ids[2:-1]))
        if kinds[:2] == [BOS, SYSTEM]:
            return "system", unescape(self.text(ids[2:-1]))
        if kinds[0] == ROLE:
            end = at[kinds.index(ROLE_END)]
            return None if kinds[1] == NULL else unescape(self.text(ids[1:end])), unescape(self.text(ids[end + 1 : -1]))
        return "assistant", unescape(self.text(ids[:-1]))


def read_conversations(formatted: DataFrame, conv_col: str = "conv_id", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Digests of every conversation in the output of ``format_turns``, read turn by turn in order.

    A task holds one turn at a time, so a conversation of any length is read in bounded memory.
    """
    path = tokenizer_path(tokenizer)
    conv = to_arrow_type(formatted.schema[conv_col].dataType)
    kind = formatted.schema[conv_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, now, state, done = TurnReader(path), object(), None, []

        def close() -> None:
            if state:
                n, turns, loss, chars, formatted_chars = state
                done.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), formatted_chars))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done))
            types = [conv, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for key, offset, raw, start, end in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in (2, 3, 4, 5))):
                if state is None or key != now:
                    close()
                    now, state = key, [0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                ids = np.frombuffer(raw.as_buffer(), "<u4").tolist()
                role, text = reader.turn(ids)
                state[0] += 1
                state[1].update(f"{role or ''}\n{text}\n".encode())
                if start.is_valid:
                    under = unescape(reader.text(ids[start.as_py() - offset.as_py() : end.as_py() - offset.as_py()]))
                    state[2].update(under.encode())
                    state[3] += len(under)
                state[4] += len(reader.text(ids))
            if len(done) > 4096:
                yield flush()
                done.clear()
        close()
        if done:
            yield flush()

    ordered = formatted.select(conv_col, "place", "offset", "ids", "loss_start", "loss_end").repartition(conv_col).sortWithinPartitions(conv_col, "place")
    return ordered.mapInArrow(run, f"`{conv_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
