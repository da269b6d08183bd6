"""Fill-in-middle: documents are cut in three at token boundaries and put in prefix-suffix-middle order.

A text is decoded to an array of code points. A token begins wherever a code point and the one
before it are not both ASCII letters, so one comparison of neighbouring classes gives all boundaries;
the document's draws pick two of them by rank, and the three pieces are slices of the array, encoded
again. Draws are digests of the seed and the identifier, so a document is cut alike on every run.

Null text is empty text and stays plain, as do texts that hold a marker (they could not be read back)
and the share that ``fim_percent`` leaves. A null identifier draws as an empty one; repeated rows are
cut alike. Other columns pass through; new columns whose names are taken replace nothing, as they get
underscores in front (``cut_names`` tells how they are called).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import distinct_name, slices, text_bytes

#: The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_ADDED = {"fim_n": T.LongType(), "fim_form": T.StringType(), "fim_prefix_chars": T.LongType(), "fim_middle_chars": T.LongType(), "fim_output": T.StringType()}
_LETTER = np.zeros(128, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def cut_names(docs: DataFrame) -> dict[str, str]:
    """The names that ``cut`` gives its columns beside those of ``docs``."""
    return {c: distinct_name(docs, c) for c in _ADDED}


def boundaries(points: np.ndarray) -> np.ndarray:
    """Where tokens (runs of ASCII letters, single other code points) begin, and the end of the text."""
    letter = (points < 128) & _LETTER[np.minimum(points, 127)]
    inner = np.flatnonzero(~(letter[1:] & letter[:-1])) + 1
    return np.concatenate([np.zeros(int(len(points) > 0), np.int64), inner, [len(points)]])


def _encode(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le")


def _cut_one(text: str, draws: tuple[int, int, int, int], fim_percent: int, spm_percent: int) -> tuple:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = boundaries(points)
    n = len(at) - 1
    if not n or draws[2] % 100 >= fim_percent or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = sorted(at[d % (n + 1)] for d in draws[:2])
    prefix, middle, suffix = (_encode(p) for p in np.split(points, [first, second]))
    if draws[3] % 100 < spm_percent:
        return n, "spm", int(first), int(second - first), SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", int(first), int(second - first), PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """``docs`` with the number of tokens, the form (plain, psm or spm), the pieces' code points and the output."""
    names = cut_names(docs)
    drawn = distinct_name(docs, "fim_draws")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = F.array(*(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)))
    schema = T.StructType(docs.schema.fields + [T.StructField(names[c], t) for c, t in _ADDED.items()])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            # A batch is handled in slices of some bytes, so that pieces and output of many long texts aren't held at once.
            texts, drawn_at = batch.column(text_col), batch.column(drawn)
            for i, j in slices(text_bytes(texts)[0], 8 << 20):
                rows = [_cut_one(t.as_py() or "", tuple(d.as_py()), fim_percent, spm_percent) for t, d in zip(texts[i:j], drawn_at[i:j], strict=True)]
                made = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[i:j] for k in range(batch.num_columns - 1)), *made], names=schema.names)

    return docs.withColumn(drawn, draws).mapInArrow(batches, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of ``cut`` was made from, read from its markers; null stays null."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, middle = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first))
