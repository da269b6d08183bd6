"""Spans of texts by offsets: paragraph-wise splitting, sentence sources, paired segments; linear Arrow functions."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry.functions import text as X

_SPANS = "array<struct<start:int,end:int>>"
#: What a sentence ends with before white space, and where sentences end.
_ENDS = ".!?。！？"
_SENTENCE = re.compile(r"[。！？]+|[.!?]+(?:\s+|$)|\n+")
_WORD, _WHITE = re.compile(r"\S+"), re.compile(r"\s+")


class _Breaks:
    """Where a text may be cut: runs of white space after a sentence or with an empty line, and its blanks, in order."""

    def __init__(self, text: str):
        self.runs: list[tuple[int, int, bool]] = []
        self.lines = [m.start() for m in re.finditer("\n", text)]
        for m in _WHITE.finditer(text):
            ended = m.start() > 0 and text[m.start() - 1] in _ENDS
            if ended or m[0].count("\n") > 1:
                self.runs.append((m.start(), m.end(), ended))
        self.starts = [r[0] for r in self.runs]
        self.blanks = [m.start() for m in re.finditer(" ", text)]

    def after_run(self, low: int, high: int) -> int | None:
        """The last place in (low, high] that a boundary which lies within ends at."""
        k = bisect_left(self.starts, high)
        while k and self.runs[k - 1][1] > low:
            k -= 1
            begin, end, ended = self.runs[k]
            if ended and begin > low:
                return min(end, high)
            lines = bisect_left(self.lines, max(begin, low)), bisect_left(self.lines, min(end, high))
            if lines[1] - lines[0] > 1:
                return self.lines[lines[1] - 1] + 1
        return None

    def after_blank(self, low: int, high: int) -> int | None:
        """Behind the last blank in [low, high)."""
        k = bisect_left(self.blanks, high)
        return self.blanks[k - 1] + 1 if k and self.blanks[k - 1] >= low else None


def _split(text: str, most: int) -> Iterator[tuple[int, int]]:
    """Cuts found in sorted places of the whole text, so the work is linear in its length."""
    breaks, begin = _Breaks(text), 0
    while len(text) - begin > most:
        full = begin + most
        end = breaks.after_run(begin, full) or breaks.after_blank(begin + max(1, most // 2), full) or full
        yield begin, end
        begin = end
    if begin < len(text):
        yield begin, len(text)


def split_spans(text: Column, most: int = 1800) -> Column:
    """(start, end) of stretches of at most ``most`` characters that cover the text.

    A stretch ends after the last sentence or paragraph that fits, else after the last blank in its
    second half, else where it is full. Null and empty texts have none.
    """

    @F.pandas_udf(_SPANS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b} for a, b in _split(t or "", most)])

    return run(text)


def sentence_spans(text: Column, most: int = 1600, words: int = 128) -> Column:
    """(start, end) of trimmed sentences; long ones in pieces of ``most`` characters, those in windows of ``words`` words."""

    def one(t: str) -> Iterator[dict]:
        at = 0
        for end in [*(m.end() for m in _SENTENCE.finditer(t)), len(t)]:
            part = t[at:end]
            left, right = at + len(part) - len(part.lstrip()), at + len(part.rstrip())
            for lo in range(left, right, most):
                found = [m.span() for m in _WORD.finditer(t, lo, min(right, lo + most))]
                for k in range(0, len(found), words):
                    yield {"start": found[k][0], "end": found[min(k + words, len(found)) - 1][1]}
            at = end

    @F.pandas_udf(_SPANS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(one(t or "")))

    return run(text)


def cut_out(text: Column, span: Column) -> Column:
    return F.substring(text, span.getField("start") + 1, span.getField("end") - span.getField("start"))


def paired_segments(units: DataFrame, version: str, page: str, text: str) -> DataFrame:
    """(version, page, segment_id, start, end, original): segments to be translated, with ids that their place and text give."""
    spans = units.select(version, page, F.col(text).alias("_t"), F.explode(split_spans(F.col(text))).alias("s"))
    rows = spans.select(version, page, "s.start", "s.end", cut_out(F.col("_t"), F.col("s")).alias("original")).filter("trim(original) <> ''")
    return rows.withColumn("segment_id", F.substring(F.sha2(F.concat_ws(":", *(F.col(c).cast("string") for c in (version, page, "start", "end", "original"))), 256), 1, 26))


@F.pandas_udf(StringType())
def normalized_query(texts: pd.Series) -> pd.Series:
    """composed and with single blanks; null where a control character or a budget forbids the query."""

    def one(t):
        if t is None or len(t) > 8000:
            return None
        t = unicodedata.normalize("NFC", t)
        if any(unicodedata.category(c) in ("Cc", "Cs") and c not in "\t\r\n" for c in t):
            return None
        t = " ".join(t.split())
        return t if 1 <= len(t) <= 4000 else None

    return texts.map(one)


def reduced_period(tokens: Column) -> Column:
    """A query that repeats one sequence, cut to that sequence."""

    def cut(t: Column) -> Column:
        n = F.size(t)
        lengths = F.when(n > 1, F.sequence(F.lit(1), F.floor(n / 2).cast("int"))).otherwise(F.expr("CAST(array() AS array<int>)"))
        fits = F.filter(lengths, lambda p: (n % p == 0) & (F.flatten(F.array_repeat(F.slice(t, F.lit(1), p), (n / p).cast("int"))) == t))
        return F.when(F.size(fits) > 0, F.slice(t, F.lit(1), F.array_min(fits))).otherwise(t)

    return X.let(tokens, cut)
