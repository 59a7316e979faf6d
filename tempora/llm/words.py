"""Words of many texts at once, as numpy arrays over one byte buffer.

A word is a run of bytes other than space and the five control characters
``\\t \\n \\v \\f \\r``; in UTF-8 that equals runs of such characters.  Hashes
are polynomials over a fixed random value per byte (Rabin-Karp, from prefix
sums), finished by a mixing step.  A polynomial modulo 2^64 alone has texts that
collide whatever its base, so a second one modulo the prime 2^31 - 1, of a base
that a caller may draw at random, goes into every word.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)

SPACES = b" \t\n\x0b\x0c\r"
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACES)] = False

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply), a bijection."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))

#: Odd bases, congruent 3 modulo 8, and their inverses modulo 2^64.
BYTE_BASE = 0xD6E8FEB86659FD93
WINDOW_BASES = (0xA0761D6478BD642B, 0xE7037ED1A0B428DB)
#: Values hashed together; bounds the arrays a task holds, and fits its cache.
BLOCK = 1 << 18


@lru_cache(maxsize=None)
def _powers(base: int) -> np.ndarray:
    p = np.full(2 * BLOCK, base, dtype=_U)
    p[0] = 1
    return np.multiply.accumulate(p)


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    if n <= 2 * BLOCK:
        return _powers(base)[:n]
    p = np.full(n, base, dtype=_U)
    p[0] = 1
    return np.multiply.accumulate(p)


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int,
              lift: Callable[[np.ndarray], np.ndarray] = lambda v: v) -> np.ndarray:
    """Polynomial hash of ``lift(values[start:end])`` for spans of ascending
    starts and ends, unmixed."""
    out = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, low + BLOCK)))
        v = lift(values[low:int(ends[j - 1])])
        prefix = np.zeros(len(v) + 1, _U)
        np.cumsum(v * powers(base, len(v)), out=prefix[1:])
        at = starts[i:j] - low
        out[i:j] = (prefix[ends[i:j] - low] - prefix[at]) * powers(pow(base, -1, 1 << 64), len(v) + 1)[at]
        i = j
    return out


PRIME = (1 << 31) - 1
#: Base of the prime polynomial where no caller draws one.
PRIME_BASE = 1_540_483_477
_BYTE31 = (_BYTE >> _U(34)) + _U(1)


def draw_base() -> int:
    """A base for the prime polynomial that no text can know."""
    return 2 + secrets.randbelow(PRIME - 3)


def _fold(x: np.ndarray) -> np.ndarray:
    """Congruent modulo the prime, below 2^33 for x below 2^64."""
    return (x & _U(PRIME)) + (x >> _U(31))


@lru_cache(maxsize=8)
def _prime_powers(base: int, size: int) -> np.ndarray:
    p = np.ones(size, _U)
    done = 1
    while done < size:
        step = min(done, size - done)
        p[done:done + step] = p[:step] * _U(pow(base, done, PRIME)) % _U(PRIME)
        done += step
    return p


def prime_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash modulo the prime of byte spans of ascending starts and ends."""
    out = np.empty(len(starts), _U)
    inverse = pow(base, -1, PRIME)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, low + BLOCK)))
        v = _BYTE31[data[low:int(ends[j - 1])]]
        size = max(2 * BLOCK, 1 << len(v).bit_length())
        prefix = np.zeros(len(v) + 1, _U)
        np.cumsum(_fold(v * _prime_powers(base, size)[:len(v)]), out=prefix[1:])
        at = starts[i:j] - low
        part = (prefix[ends[i:j] - low] - prefix[at]) % _U(PRIME)
        out[i:j] = part * _prime_powers(inverse, size)[at] % _U(PRIME)
        i = j
    return out


@dataclass
class Words:
    data: np.ndarray        # bytes of all texts
    text_at: np.ndarray     # n + 1 byte offsets of the texts
    start: np.ndarray       # byte offsets of the words
    end: np.ndarray
    word_at: np.ndarray     # n + 1 word offsets of the texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.word_at)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.word_at) - 1), self.counts)

    def two_hashes(self, base: int = PRIME_BASE) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit hash per word, and one of the prime polynomial alone."""
        size = (self.end - self.start).astype(_U) * _U(0x9E3779B97F4A7C15)
        second = mix(prime_hash(self.data, self.start, self.end, base) + size)
        return mix(span_hash(self.data, self.start, self.end, BYTE_BASE, lambda v: _BYTE[v]) + size) ^ mix(~second), second

    def hashes(self, base: int = PRIME_BASE) -> np.ndarray:
        """A 64-bit hash per word."""
        return self.two_hashes(base)[0]

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of ``size`` words inside one text, and
        how many each text has."""
        per_text = np.maximum(self.counts - size + 1, 0)
        total = int(per_text.sum())
        ends = np.cumsum(per_text)
        first = np.arange(total) + np.repeat(self.word_at[:-1] - (ends - per_text), per_text)
        return first, per_text


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    texts = pa.compute.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + n + 1]
    if data is None or at[-1] == at[0]:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def name_hashes(names: pa.Array) -> np.ndarray:
    """A 64-bit hash per string, equal in every task."""
    data, at = text_bytes(names)
    return mix(span_hash(data, at[:-1], at[1:], BYTE_BASE, lambda v: _BYTE[v]) + np.diff(at).astype(_U) * _U(0x9E3779B97F4A7C15))


def split_words(texts: pa.Array, is_word: np.ndarray = _IS_WORD, fold: np.ndarray | None = None) -> Words:
    """Words of the bytes that ``is_word`` marks, after ``fold`` of every byte."""
    data, at = text_bytes(texts)
    if fold is not None:
        data = fold[data]
    inside = is_word[data]
    # a word starts where the byte before is a space or belongs to another text
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    begins[heads] = inside[heads]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    tails = at[1:][at[:-1] < at[1:]] - 1
    stops[tails] = inside[tails]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(data, at, start, end, np.searchsorted(start, at))


def window_keys(words: Words, size: int,
                base: int = PRIME_BASE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, key, spread, windows per text): a 64-bit Rabin-Karp hash of
    every window of ``size`` words, and a second one over the words' second hash."""
    first, per_text = words.windows(size)
    key, spread = (mix(span_hash(v, first, first + size, b)) for v, b in zip(words.two_hashes(base), WINDOW_BASES))
    return first, key, spread, per_text
