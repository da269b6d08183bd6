"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) the vectors
of its letters, each permuted (rolled) by its place; a document's vector bundles (adds) those of
its trigrams by their counts; a language's prototype bundles the unit vectors of its documents.
A document gets the language whose prototype has the largest cosine with its own vector.

Letters are lower-cased; runs of anything else are one blank. Letters other than a-z share some
five hundred codes by a hash, so letters of one script seldom meet; of scripts with thousands of
letters, several share a code, which still tells such scripts and their common letters apart. Null text, or text without a letter, is ``und`` with score 0, as is
any text where nothing was learned. Ties go to the language first in order. Every row is answered, repeated ones too;
columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.llm.common import mix64

LETTERS = 512
DIMENSIONS = 512
UNKNOWN = "und"
_SCALE = 1 << 24


class Profiles:
    """The fixed random vectors; one per worker process."""

    _made: Profiles | None = None

    @classmethod
    def get(cls) -> Profiles:
        cls._made = cls._made or cls()
        return cls._made

    def __init__(self):
        own = np.zeros(1 << 16, np.uint16)
        for point in range(1 << 16):
            own[point] = self._code(point)
        self.codes = own
        signs = np.where(np.random.default_rng(20).integers(0, 2, (LETTERS, DIMENSIONS)) == 1, 1, -1).astype(np.int8)
        self.permuted = np.roll(signs, 2, axis=1), np.roll(signs, 1, axis=1), signs

    @staticmethod
    def _code(point: int) -> int:
        letter = chr(point)
        if not letter.isalpha():
            return 0
        low = ord(letter.lower()[0])
        return low - 96 if 97 <= low <= 122 else 27 + int(mix64(np.array([low], np.uint64))[0] % np.uint64(LETTERS - 27))

    def vector(self, text: str | None) -> np.ndarray | None:
        """The document's unit vector, or None without letters."""
        if not text:
            return None
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = self.codes[np.minimum(points, 0xFFFF)]
        for at in np.flatnonzero(points > 0xFFFF):
            code[at] = self._code(int(points[at]))
        keep = code > 0
        if not keep.any():
            return None
        keep[1:] |= code[:-1] > 0
        code = code[keep].astype(np.int32)
        code = np.concatenate([[0], code, [0]])
        grams = np.sort((code[:-2] * LETTERS + code[1:-1]) * LETTERS + code[2:])
        at = np.flatnonzero(np.diff(grams, prepend=-1))
        counts = np.diff(np.append(at, len(grams))).astype(np.float32)
        total = np.zeros(DIMENSIONS, np.float32)
        a, b, c = self.permuted
        for i in range(0, len(at), 4096):
            gram = grams[at[i : i + 4096]]
            bound = a[gram // LETTERS**2] * b[gram // LETTERS % LETTERS] * c[gram % LETTERS]
            total += counts[i : i + 4096] @ bound.astype(np.float32)
        norm = float(np.linalg.norm(total))
        return total / norm if norm else None


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes from all rows with a language; the driver gets one vector per language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = Profiles.get(), {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                vector = profiles.vector(text.as_py())
                if vector is not None:
                    sums[lang] = sums.get(lang, 0) + np.rint(vector * _SCALE).astype(np.int64)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS, pa.string()), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(total)], names=["lang", "at", "total"])

    sums = docs.select(text_col, lang_col).filter(F.col(lang_col).isNotNull()).mapInArrow(run, "lang string, at int, total long").groupBy("lang", "at").agg(F.sum("total").alias("total"))
    prototypes: dict[str, np.ndarray] = {}
    for lang, at, total in sums.collect():
        prototypes.setdefault(lang, np.zeros(DIMENSIONS))[at] = total
    return {k: (v / (np.linalg.norm(v) or 1)).astype(np.float32) for k, v in sorted(prototypes.items())}


def classify(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; the score is the cosine, at least 0."""
    names = list(prototypes)
    matrix = np.stack([prototypes[n] for n in names]) if names else None
    kind = to_arrow_type(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles.get()
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(1):
                vector = profiles.vector(text.as_py()) if names else None
                near = matrix @ vector if vector is not None else None
                best = int(np.argmax(near)) if near is not None else None
                langs.append(UNKNOWN if best is None else names[best])
                scores.append(0.0 if best is None else min(1.0, max(0.0, float(near[best]))))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")
