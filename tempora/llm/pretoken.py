"""Byte-level BPE over many texts at once.

The public pattern splits a text into pieces that are encoded one by one, so
equal pieces have equal ids.  Pieces are found on an array of code points, whose
letters and numbers the ``tokenizers`` library itself names.  Pieces are hashed,
and only those that the worker has not met yet go through the library; the ids
of a text are gathered from the pieces' ids.  Every piece is compared with the
one whose ids it takes, so the hash only finds candidates.  The cache is bounded
in pieces, characters and ids, and starts anew when full.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .chars import TOP, Chars
from .words import mix, span_hash

SPACE, LETTER, NUMBER, OTHER = range(4)
# The white space of the pattern's \s.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
PIECE_BASE = 0xD1342543DE82EF95 | 1
CACHE_PIECES = 1 << 20


#: Most characters and ids that a cache holds beyond those of one call.
CACHE_CHARS = CACHE_IDS = 1 << 24
_BLOCK_BITS = 10


class _Classes:
    """Space, letter, number or other per code point, found block by block as
    texts need them."""

    def __init__(self):
        self.table = np.full(TOP, OTHER, np.uint8)
        self.known = np.zeros(TOP >> _BLOCK_BITS, bool)
        self.finders = None

    def of(self, code: np.ndarray) -> np.ndarray:
        block = np.zeros(len(self.known), bool)
        block[code >> _BLOCK_BITS] = True
        for b in np.flatnonzero(block & ~self.known).tolist():
            self._learn(b)
        return self.table[code]

    def _learn(self, block: int) -> None:
        from tokenizers import Regex, pre_tokenizers

        if self.finders is None:
            self.finders = [(kind, pre_tokenizers.Split(Regex(f"\\p{{{name}}}+"), "removed", invert=True))
                            for name, kind in (("L", LETTER), ("N", NUMBER))]
        first = block << _BLOCK_BITS
        codes = [c for c in range(first, first + (1 << _BLOCK_BITS)) if not 0xD800 <= c < 0xE000]
        line = "".join(map(chr, codes))
        for kind, finder in self.finders if line else ():
            for _, (a, b) in finder.pre_tokenize_str(line):
                self.table[codes[a:b]] = kind
        self.table[[c for c in WHITE if c >> _BLOCK_BITS == block]] = SPACE
        self.known[block] = True


_classes = _Classes()


def piece_starts(chars: Chars) -> np.ndarray:
    """Offsets of the pieces that the pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
    finds in every text."""
    code, at = chars.code, chars.at
    n = len(code)
    if not n:
        return np.empty(0, np.int64)
    kind = _classes.of(code)
    head = np.zeros(n + 1, bool)
    head[at] = True
    tail = head[1:]                                    # last character of its text
    head = head[:-1]
    before = np.empty(n, np.uint8)
    before[0], before[1:] = OTHER, kind[:-1]
    after_space = np.zeros(n, bool)                    # the plain space joins what follows
    after_space[1:] = code[:-1] == 0x20
    white = kind == SPACE
    follows = np.zeros(n, bool)                        # a character that is no space comes next, in this text
    follows[:-1] = ~white[1:]
    follows &= ~tail
    start = np.where(white, (before != SPACE) | follows,
                     np.where(before == SPACE, ~after_space, before != kind)) | head
    quotes = np.flatnonzero((code == 0x27) & start & ~tail)
    for q in quotes.tolist():                          # contractions; rare
        nxt = chr(code[q + 1])
        if nxt in "stmd":
            end = q + 2
        elif not tail[q + 1] and nxt + chr(code[q + 2]) in ("re", "ve", "ll"):
            end = q + 3
        else:
            continue
        start[q + 1:end] = False
        if end < n:
            start[end] = True
    return np.flatnonzero(start)


class PieceCache:
    """Ids per piece, filled by ``encode`` (a list of pieces to lists of ids)."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], limit: int = CACHE_PIECES):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.key = np.empty(0, np.uint64)       # ascending
        self.entry = np.empty(0, np.int64)      # of each key: its place in the four below
        self.first = np.empty(0, np.int64)      # into ids
        self.size = np.empty(0, np.int32)
        self.begin = np.empty(0, np.int64)      # into chars
        self.length = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)
        self.chars = np.empty(0, np.uint32)

    def _ids(self, code: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces one after another, ids per piece) by the library."""
        line = code.tobytes().decode("utf-32-le")
        got = self.encode([line[a:b] for a, b in zip(start.tolist(), end.tolist())])
        size = np.fromiter(map(len, got), np.int32, len(got))
        return np.fromiter((i for g in got for i in g), np.uint32, int(size.sum())), size

    def ids_of(self, chars: Chars) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, n + 1 offsets of the texts)."""
        code, start = chars.code, piece_starts(chars)
        n = len(chars.at) - 1
        if not len(start):
            return np.empty(0, np.uint32), np.zeros(n + 1, np.int64)
        end = np.append(start[1:], len(code))
        # the next piece begins at or before the next text, so a piece ends in its text
        key = mix(span_hash(code, start, end, PIECE_BASE, lambda v: v.astype(np.uint64) + np.uint64(1))
                  + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        distinct, where, back = np.unique(key, return_index=True, return_inverse=True)
        if len(self.key) + len(distinct) > self.limit or max(len(self.chars) // CACHE_CHARS, len(self.ids) // CACHE_IDS):
            self.clear()
        at = np.searchsorted(self.key, distinct)
        known = at < len(self.key)
        known[known] = self.key[at[known]] == distinct[known]
        new = np.flatnonzero(~known)
        if len(new):
            w = where[new]
            flat, size = self._ids(code, start[w], end[w])
            first = len(self.ids) + np.concatenate(([0], np.cumsum(size[:-1], dtype=np.int64)))
            length = end[w] - start[w]
            begin = len(self.chars) + np.concatenate(([0], np.cumsum(length[:-1])))
            self.ids = np.concatenate((self.ids, flat))
            self.chars = np.concatenate((self.chars, code[_spread(start[w], length)]))
            into = at[new]                                      # both ascend: a merge
            self.key = np.insert(self.key, into, distinct[new])
            self.entry = np.insert(self.entry, into, len(self.first) + np.arange(len(new)))
            for name, more in (("first", first), ("size", size), ("begin", begin), ("length", length)):
                setattr(self, name, np.concatenate((getattr(self, name), more)))
            at = np.searchsorted(self.key, distinct)
        slot = self.entry[at][back]
        first, size = self.first[slot], self.size[slot].astype(np.int64)
        ids = self.ids
        other = self._strangers(code, start, end, slot)
        if len(other):                                          # equal hash, another piece: past the cache
            flat, own = self._ids(code, start[other], end[other])
            size[other] = own
            first[other] = len(ids) + np.concatenate(([0], np.cumsum(own[:-1], dtype=np.int64)))
            ids = np.concatenate((ids, flat))
        ends = np.cumsum(size)
        piece_at = np.searchsorted(start, chars.at)
        return ids[_spread(first, size)], np.concatenate(([0], ends))[piece_at]

    def _strangers(self, code: np.ndarray, start: np.ndarray, end: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Pieces that are not the piece of their slot."""
        length, out, i = end - start, [], 0
        while i < len(start):                                   # bounded arrays
            j = max(i + 1, int(np.searchsorted(start, start[i] + (1 << 18))))
            same = length[i:j] == self.length[slot[i:j]]
            size = np.where(same, length[i:j], 0)
            # pieces follow each other without gaps
            own = code[start[i]:end[j - 1]] if same.all() else code[_spread(start[i:j], size)]
            differs = own != self.chars[_spread(self.begin[slot[i:j]], size)]
            if not differs.any() and same.all():
                i = j
                continue
            same[np.repeat(np.arange(j - i), size)[differs]] = False
            out.append(i + np.flatnonzero(~same))
            i = j
        return np.concatenate(out) if out else np.empty(0, np.int64)


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for ``size`` places each, one after another."""
    size = size.astype(np.int64)
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


_caches: dict[str, PieceCache] = {}


def cache_for(name: str, make: Callable[[], Callable[[list[str]], list[list[int]]]]) -> PieceCache:
    """The worker's cache under ``name``; ``make`` builds its encoder."""
    if name not in _caches:
        _caches[name] = PieceCache(make())
    return _caches[name]


def json_encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Encoder of a ``tokenizers`` file; special strings in a text are ordinary
    text, and none are added."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda pieces: [e.ids for e in t.encode_batch_fast(pieces, add_special_tokens=False)]
