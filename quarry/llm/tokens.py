"""Token ids of whole texts by the tokenizers library, with a bounded memo of pieces.

A byte-level BPE never merges across the cuts of its pre-tokenisation pattern. Most cuts show in
the bytes on both sides: where white space begins after visible text, and between letters, digits
and marks. Texts are cut there by numpy, each distinct piece of a window is looked up once, and
what a worker has not seen yet goes to the library. Pieces' ids lie in one pool, from which a
window is put together. Where bytes don't tell, no cut is made, and the pattern itself divides the
piece. Tokenizers of any other make get whole texts.
"""

from __future__ import annotations

import json
import os
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import regex

from quarry.llm.common import text_bytes

DEFAULT_TOKENIZER = "byte_bpe_50k.json"

#: Distinct pieces that a worker remembers; beyond that it starts afresh.
MEMO_PIECES = 1_000_000
#: Bytes of text that are cut and encoded at a time, whatever the lengths of texts.
SPLIT_BYTES = 8 << 20

#: Fixed value: the pre-tokenisation pattern that byte-level BPE vocabularies are defined with.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: What a byte tells about its character; ``DARK`` may be white space, ``OTHER`` is certainly none.
SPACE, LETTER, DIGIT, MARK, QUOTE, OTHER, DARK = range(7)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte by itself, and whether a cut lies between two kinds (first * 8 + second)."""
    kind = np.full(256, OTHER, np.uint8)
    kind[[9, 10, 11, 12, 13, 32]] = SPACE
    kind[28:32] = DARK
    kind[33:127] = MARK
    kind[39] = QUOTE
    kind[48:58] = DIGIT
    kind[65:91] = kind[97:123] = LETTER
    cut = np.zeros((8, 8), bool)
    cut[LETTER : OTHER + 1, SPACE] = True
    for a in (LETTER, DIGIT, MARK):
        cut[a, [b for b in (LETTER, DIGIT, MARK) if a != b]] = True
    cut[[LETTER, DIGIT], QUOTE] = True
    return kind, cut.ravel()


_KIND, _CUT = _tables()


def _cuts(d: np.ndarray) -> np.ndarray:
    """Whether a cut lies before each byte of UTF-8 text, but for the first one."""
    kind = _KIND[d]
    wide = np.flatnonzero(d[:-2] >= 0xC2) if len(d) > 2 else np.zeros(0, np.int64)
    a, b, c = d[wide], d[wide + 1], d[wide + 2]
    # U+00C0 to U+024F and U+0400 to U+047F are letters, but for the signs of multiplication and division.
    letter = wide[((a >= 0xC3) & (a <= 0xC9) & ~((a == 0xC3) & ((b == 0x97) | (b == 0xB7)))) | (a == 0xD0) | (a == 0xD1)]
    kind[letter] = kind[letter + 1] = LETTER
    dark = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) | (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81)) | (a == 0xE3) & (b == 0x80)
    dark = wide[dark]
    kind[dark] = kind[dark + 1] = DARK
    kind[dark[d[dark] >= 0xE1] + 2] = DARK
    # The window's last two bytes may begin a character that goes on beyond it.
    kind[-2:][d[-2:] >= 128] = DARK
    found = np.zeros(len(d), bool)
    found[1:] = _CUT[kind[:-1] * 8 + kind[1:]]
    # White space of one character that is no blank is a piece of its own.
    alone = np.flatnonzero((kind == SPACE) & (d != 32))
    alone = alone[(alone > 0) & (alone < len(d) - 1)]
    seen = (kind > SPACE) & (kind < DARK)
    found[alone[seen[alone - 1] & seen[alone + 1]] + 1] = True
    return found


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    """Place of a public vocabulary file; a path is returned as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_names() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class TokenEncoder:
    """``encode`` gives ids of a text, ``encode_column`` of a column; control strings are ordinary text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        made = json.loads(self.tok.to_str())
        pre, model = made.get("pre_tokenizer") or {}, made["model"]
        self.bytewise = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not made.get("normalizer")
            and model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        )
        self.model, self.names = self.tok.model, _byte_names()
        self.blank = self.names[32]
        self.clear()

    def clear(self) -> None:
        """Forgets all pieces. ``memo`` numbers them; a number's ids lie in ``pool`` from ``first`` to the next number's."""
        self.memo: dict[str, int] = {}
        self.pool, self.first = np.zeros(1 << 16, self.dtype), np.zeros(1 << 14, np.int64)

    def _store(self, chunks: list[str], counts: np.ndarray, ids: np.ndarray) -> None:
        n, m = len(self.memo), len(chunks)
        if n + m + 1 > len(self.first):
            self.first = np.resize(self.first, 2 * (n + m + 1))
        begin = int(self.first[n])
        self.first[n + 1 : n + m + 1] = begin + np.cumsum(counts)
        if begin + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * (begin + len(ids)))
        self.pool[begin : begin + len(ids)] = ids
        self.memo.update(zip(chunks, range(n, n + m)))

    def _named(self, piece: str) -> str:
        if piece.isascii() and piece[1:].isalnum():
            return self.blank + piece[1:] if piece[0] == " " else piece
        return piece.encode().decode("latin1").translate(self.names)

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece of the pattern has, and all of them."""
        tokenize = self.model.tokenize
        found = [[t.id for t in tokenize(name)] for name in map(self._named, pieces)]
        return np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(chain.from_iterable(found), self.dtype)

    def _learn(self, pieces: list[str]) -> None:
        """Stores the ids of distinct pieces that aren't known; some may be several pieces of the pattern."""
        plain = [p.isalpha() or p[:1] == " " and p[1:].isalpha() for p in pieces]
        words = list(compress(pieces, plain))
        self._store(words, *self._ids(words))
        if len(words) == len(pieces):
            return
        rest = [p for p, word in zip(pieces, plain) if not word]
        parts = list(map(_PIECE.findall, rest))
        memo = self.memo
        new = [p for p in dict.fromkeys(chain.from_iterable(parts)) if p not in memo]
        self._store(new, *self._ids(new))
        rows = np.cumsum([0, *map(len, parts)])
        ends, ids = self._gather(np.fromiter(map(memo.__getitem__, chain.from_iterable(parts)), np.int64, rows[-1]), rows)
        # A piece that the pattern leaves whole is stored by now.
        made = np.array([p not in memo for p in rest], bool)
        counts = np.diff(ends)
        self._store(list(compress(rest, made)), counts[made], ids[np.repeat(made, counts)])

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        get = self.memo.get
        found = list(map(get, pieces))
        if None in found:
            self._learn([p for p, number in zip(pieces, found) if number is None])
            found = [get(p) if number is None else number for p, number in zip(pieces, found)]
        return np.array(found, np.int64)

    def _gather(self, numbers: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each row's ids begin (n + 1) and all ids, from piece numbers and where rows' pieces begin."""
        first = self.first[numbers]
        size = self.first[numbers + 1] - first
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(first - ends[:-1], size)
        at += np.arange(len(at))
        return ends[rows], self.pool[at]

    def _window(self, d: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each piece begin (n + 1) and all ids, of the text ``d`` cut at ``starts``."""
        if len(self.memo) > MEMO_PIECES:
            self.clear()
        at = np.append(starts, len(d)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(d)]).dictionary_encode()
        numbers = self._numbers(_strings(coded.dictionary))[coded.indices.to_numpy()]
        return self._gather(numbers, np.arange(len(numbers) + 1))

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each text begin (n + 1), and all ids as ``dtype``; null is empty."""
        if not self.bytewise:
            found = [self.tok.encode(t, add_special_tokens=False).ids if t else [] for t in column.to_pylist()]
            return np.cumsum([0, *map(len, found)]), np.array([i for ids in found for i in ids], self.dtype)
        offs, raw = text_bytes(column)
        rows, d = offs - offs[0], raw[offs[0] : offs[-1]]
        begins, parts, lo, before, size = np.zeros(len(rows), np.int64), [np.zeros(0, self.dtype)], 0, 0, SPLIT_BYTES
        while lo < len(d):
            hi = min(len(d), lo + size)
            # Two bytes of context on the left and three on the right tell all that a cut rests on.
            left = min(lo, 2)
            found = _cuts(d[lo - left : hi + 3])[left : left + hi - lo]
            found[0] = True
            a, b = np.searchsorted(rows, [lo, hi])
            found[rows[a:b] - lo] = True
            starts = np.flatnonzero(found)
            if hi < len(d):
                if len(starts) == 1:
                    size *= 2
                    continue
                hi = lo + int(starts[-1])
                starts, b = starts[:-1], np.searchsorted(rows, hi)
            ends, ids = self._window(d[lo:hi], starts)
            begins[a:b] = before + ends[np.searchsorted(starts, rows[a:b] - lo)]
            parts.append(ids)
            before, lo, size = before + len(ids), hi, SPLIT_BYTES
        begins[np.searchsorted(rows, len(d)) :] = before
        return begins, np.concatenate(parts)

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_column(pa.array([text or ""], pa.string()))[1]

    def decode(self, ids) -> str:
        return self.tok.decode([int(i) for i in ids], skip_special_tokens=False)


_encoders: dict[str, TokenEncoder] = {}


def encoder(path: str) -> TokenEncoder:
    """The worker's encoder for a vocabulary file, loaded once per process."""
    if path not in _encoders:
        _encoders[path] = TokenEncoder(path)
    return _encoders[path]


def forget() -> None:
    """Lets go of the pieces that this worker remembers, and of Arrow's spare memory, for tasks that don't encode."""
    for made in _encoders.values():
        made.clear()
    pa.default_memory_pool().release_unused()
