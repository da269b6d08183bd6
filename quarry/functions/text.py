"""Text functions as column expressions; Arrow functions only where Spark has no equivalent."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that carry no subject in a query.
QUERY_STOPWORDS = (
    "và là của có các những một được trong cho với về từ đến này đó khi thì mà hoặc đã đang sẽ "
    "the a an of and to in is are for on what how why where when which who whom whose "
    "does do can could would should please explain about this that these those it its "
    "as be been being"
).split()
#: Words left out of keywords.
KEYWORD_STOPWORDS = "và là của có các những một được trong cho với về từ đến này đó khi thì mà hoặc không đã đang sẽ the a an of and to in is are for on".split()
#: Number words, which alone establish no subject.
AUXILIARY_TERMS = "một hai ba bốn năm sáu bảy tám chín mười one two three four five six seven eight nine ten".split()
#: Fixed value: what counts as a token, in the regex dialect that Spark and DuckDB share.
TOKEN = r"c\+\+|c#|\.net\b|\p{Nd}+(?:\.\p{Nd}+)+|[\p{L}\p{N}]+"


def casefold(text: Column) -> Column:
    """F04, sufficient where sharp s is the only letter whose case folding isn't its lower case."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def surface_tokens(text: Column) -> Column:
    """folded tokens with c++, c#, .net and dotted numbers whole; null text has none."""
    return F.regexp_extract_all(casefold(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def bag_tokens(text: Column) -> Column:
    """folded runs of letters and digits."""
    return F.regexp_extract_all(casefold(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def letter_tokens(text: Column) -> Column:
    """folded runs of letters."""
    return F.regexp_extract_all(casefold(F.coalesce(text, F.lit(""))), F.lit(r"(\p{L}+)"), F.lit(1))


def squeeze(text: Column) -> Column:
    """F01 without Unicode composition: line ends, blanks within lines, and runs of empty lines."""
    text = F.regexp_replace(text, "\r\n?", "\n")
    text = F.regexp_replace(text, r"[^\S\n]+", " ")
    text = F.regexp_replace(F.regexp_replace(text, r" *\n *", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition, for which Spark has no function."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def plain_letters(text: str) -> str:
    """F03 of one text: case folding, d with stroke as d, and no combining marks."""
    plain = unicodedata.normalize("NFD", text.casefold().replace("đ", "d"))
    return "".join(c for c in plain if unicodedata.category(c) != "Mn")


@F.pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    """F03, Arrow function: for canonical decomposition Spark has no function."""
    return text.map(lambda t: None if t is None else plain_letters(t))


def contains_phrase(tokens: Column, phrase: Column) -> Column:
    """whether ``phrase`` is a contiguous stretch of ``tokens``."""
    pad = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return F.contains(pad(tokens), pad(phrase))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it, lambdas included."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_windows(text: Column, size: int = 200, overlap: int = 40) -> Column:
    """arrays of words, each window ``size - overlap`` words after the last; the first that reaches the end is the last."""
    step = size - overlap

    def cut(words: Column) -> Column:
        n = F.size(words)
        last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
        starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda k: k * step)).otherwise(F.expr("CAST(array() AS array<int>)"))
        return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(words, s + 1, F.lit(size)).alias("words")))

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\S+)"), F.lit(1)), cut)


def ngrams(tokens: Column, least: int, most: int) -> Column:
    """All runs of ``least`` to ``most`` tokens, joined by blanks, as one array; linear in the number of tokens."""

    def of(t: Column, n: int) -> Column:
        at = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1))).otherwise(F.expr("CAST(array() AS array<int>)"))
        return F.transform(at, lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))

    return let(tokens, lambda t: F.flatten(F.array(*(of(t, n) for n in range(least, most + 1)))))


def query_form(text: Column) -> Column:
    """identifier, technical, acronym, question, short or descriptive, in that order."""
    t = F.trim(text)
    low = casefold(t)
    question = F.contains(t, F.lit("?"))
    #: How questions begin.
    for start in ("how ", "why ", "what ", "comment ", "pourquoi ", "làm sao", "tại sao", "cách ", "giải thích"):
        question = question | low.startswith(start)
    return (
        # The patterns of identifiers and acronyms.
        F.when(t.rlike(r"^[A-Z0-9]{2,}(?:[_-][A-Z0-9]+)+$"), "identifier")
        .when(low.isin("c++", "c#", ".net"), "technical")
        .when(t.rlike(r"^[A-Z][A-Z0-9]{1,7}$"), "acronym")
        .when(question, "question")
        .when(F.size(surface_tokens(t)) <= 4, "short")
        .otherwise("descriptive")
    )


def snippet(text: Column, tokens: Column, size: int = 400, phrase: Column | None = None) -> Column:
    """``size`` characters around the exact ``phrase``, else around the first of the rarest of ``tokens`` in the text, else its start."""

    def cut(low: Column) -> Column:
        count = lambda t: (F.char_length(low) - F.char_length(F.replace(low, t, F.lit("")))) / F.char_length(t)
        where = F.transform(tokens, lambda t: F.struct(count(t).alias("n"), F.position(t, low).alias("at")))
        rarest = F.array_min(F.filter(where, lambda w: w.getField("at") > 0)).getField("at")
        exact = F.lit(None).cast("int") if phrase is None else F.nullif(F.position(phrase, low), F.lit(0))
        return F.greatest(F.coalesce(exact, rarest, F.lit(1)) - size // 4, F.lit(1))

    return F.substring(text, let(casefold(text), cut), F.lit(size))


def hit_snippet(text: Column, terms: Column, phrase: Column, size: int = 400) -> Column:
    """F21 by tokens: ``size`` characters around the first place of the whole ``phrase`` (two tokens or more), else around
    the first hit of the term that is hit least, the earlier of equal ones, else the text's start; a quarter lies before.

    A token is hit by a term that it equals or that is one of its runs of letters. Places are those in the text as it is written.
    """
    token = f"(?i)({TOKEN})"
    whole = F.coalesce(text, F.lit(""))
    parts = F.struct(F.regexp_extract_all(whole, F.lit(token), F.lit(1)).alias("raw"), F.split(whole, token, -1).alias("gaps"))
    none = F.expr("CAST(array() AS array<int>)")

    def place(x: Column) -> Column:
        words, n = x.getField("words"), F.size(x.getField("raw"))
        numbers = lambda last: F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(none)
        before = lambda i: F.char_length(F.array_join(F.slice(x.getField("gaps"), F.lit(1), i), "")) + F.char_length(F.array_join(F.slice(x.getField("raw"), F.lit(1), i - 1), ""))
        whole_at = F.filter(numbers(n - F.size(phrase) + 1), lambda i: F.slice(words, i, F.size(phrase)) == phrase)
        exact = F.when(F.size(phrase) > 1, F.get(whole_at, F.lit(0)))
        hit = lambda word, term: (word == term) | F.array_contains(F.regexp_extract_all(word, F.lit(r"(\p{L}+)"), F.lit(1)), term)
        hits = F.transform(terms, lambda term: let(F.filter(numbers(n), lambda i: hit(F.get(words, i - 1), term)), lambda at: F.struct(F.size(at).alias("n"), F.get(at, F.lit(0)).alias("at"), F.position(term, F.get(words, F.get(at, F.lit(0)) - 1)).alias("within"))))
        best = F.array_min(F.filter(hits, lambda h: h.getField("n") > 0))
        return F.coalesce(let(exact, before), let(best, lambda h: before(h.getField("at")) + h.getField("within") - 1), F.lit(0))

    folded = let(parts, lambda x: F.struct(x.getField("raw").alias("raw"), x.getField("gaps").alias("gaps"), F.transform(x.getField("raw"), casefold).alias("words")))
    return F.substring(text, F.greatest(let(folded, place) - size // 4, F.lit(0)) + 1, F.lit(size))


def valid_vector(vector: Column, dimension: int) -> Column:
    """of the dimension, finite throughout and not all zero."""
    finite = F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dimension) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """cosine clamped to [-1, 1]; null where either is all zero."""
    value = F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))
    return F.least(F.greatest(value, F.lit(-1.0)), F.lit(1.0))


def unit(vector: Column) -> Column:
    """the vector at length one."""
    return F.transform(vector, lambda x: x.cast("double") / F.sqrt(dot(vector, vector)))


#: Fixed value: what no phrase may hold.
FORBIDDEN = r"(?i)https?://|www\.|\S+@\S+|[<>]|\b(?:select|insert|drop)\b.*\b(?:from|table|into)\b|approve\s+me|ignore\s+(?:all|previous)|bỏ\s+kiểm\s+duyệt|(?:password|secret|token)\s*[=:]"


def safe_phrase(text: Column, most: int = 120) -> Column:
    """the phrase folded and with single blanks, or null if it isn't one: 2 to ``most`` characters, 1 to 6 words, half of them distinct and one informative, a letter, few digits, nothing forbidden."""

    def judged(t: Column) -> Column:
        words, n = surface_tokens(t), F.char_length(t)
        digits = F.char_length(F.regexp_replace(t, r"\P{Nd}", ""))
        informative = F.size(F.array_except(words, F.array(*(F.lit(w) for w in QUERY_STOPWORDS)))) > 0
        fits = n.between(2, most) & F.size(words).between(1, 6) & t.rlike(r"\p{L}") & ~t.rlike(FORBIDDEN) & (digits <= F.greatest(F.lit(2), F.floor(n / 4)))
        return F.when(fits & informative & (F.size(F.array_distinct(words)) >= F.greatest(F.lit(1), F.floor(F.size(words) / 2))), F.regexp_replace(casefold(t), r"\s+", " "))

    return let(F.trim(text), judged)
