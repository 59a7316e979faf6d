"""Characters of many texts at once, as numpy arrays of code points."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .words import text_bytes

TOP = 0x110000


@dataclass
class Chars:
    code: np.ndarray        # code points of all texts
    at: np.ndarray          # n + 1 offsets of the texts


def decode(texts: pa.Array) -> Chars:
    """Code points of a string column; null counts as empty."""
    data, at = text_bytes(texts)
    if not len(data):
        return Chars(np.empty(0, np.uint32), np.zeros(len(at), np.int64))
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(code) == len(data):
        return Chars(code, at)
    first = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=first[1:])
    return Chars(code, first[at])


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    """Lower case of every code point whose lower case is one code point."""
    table = np.arange(TOP, dtype=np.uint32)
    for c in range(TOP):
        if not 0xD800 <= c < 0xE000:
            low = chr(c).lower()
            if len(low) == 1:
                table[c] = ord(low)
    return table


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter (general category L*)."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(TOP)), bool, TOP)
