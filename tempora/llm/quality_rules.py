"""Operator 3: quality rules and boosted trees over document statistics.

Statistics of a text are counted on numpy arrays over many texts at once.
Two fixed rules fail a text outright; the others are judged by gradient-
boosted trees, held as flat node arrays, whose score may only fall as the
share of symbols, repeated lines or repeated words rises.  The trees learn
from a bounded sample of labelled documents, ``PER_LABEL`` of each label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from .frames import chunks, marked_ids, written
from .words import SPACES, Words, split_words, window_keys

SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
#: Bound of the training sample: documents per label.
PER_LABEL = 2000

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "mean_word", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "distinct",
            "stutter"]
MONOTONE = [0, 0, -1, -1, -1, 0, 0, 0, 0, -1]


def _flags(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


_SYMBOL = _flags(SYMBOLS)
_UPPER = _flags(bytes(range(65, 91)))
_DIGIT = _flags(b"0123456789")
_MARK = _flags(bytes(c for c in range(33, 127) if not chr(c).isalnum()))
_HEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)])
_BLANK = SPACES.replace(b"\n", b"")


def _per_text(flag: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def _dup_lines(text: bytes) -> tuple[int, int]:
    """(lines with a word, those equal to an earlier one)."""
    lines = [x for x in text.split(b"\n") if x.strip(_BLANK)]
    return len(lines), len(lines) - len(set(lines))


def _covered(first: np.ndarray, size: int, n: int) -> int:
    """Words of ``n`` that the windows beginning at ``first`` cover."""
    gone = np.bincount(first, minlength=n + 1)[:n + 1] - np.bincount(first + size, minlength=n + 1)[:n + 1]
    return int((np.cumsum(gone[:-1]) > 0).sum())


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(base counts n x 5, features n x 10) of a string column; null as empty."""
    w: Words = split_words(texts)
    n = len(w.word_at) - 1
    inside = np.zeros(len(w.data) + 1, np.int8)
    inside[w.start] += 1
    np.subtract.at(inside, w.end, 1)
    # words that touch across texts cancel out at one place, which keeps the sum right
    inside = np.cumsum(inside[:-1]) > 0
    size = np.diff(w.text_at)
    chars = _per_text(inside & _HEAD[w.data], w.text_at)
    symbols = _per_text(_SYMBOL[w.data], w.text_at)
    words = w.counts
    raw = w.data.tobytes()
    hashes = w.hashes()
    first, key, _, per_text = window_keys(w, REPEAT_WINDOW)
    at = np.concatenate(([0], np.cumsum(per_text)))
    lines, dup, repeat, distinct, stutter = (np.zeros(n, np.int64) for _ in range(5))
    for i in range(n):
        if not words[i]:
            continue
        lines[i], dup[i] = _dup_lines(raw[w.text_at[i]:w.text_at[i + 1]])
        own = hashes[w.word_at[i]:w.word_at[i + 1]]
        distinct[i] = len(np.unique(own))
        stutter[i] = int((own[1:] == own[:-1]).sum())
        if per_text[i] > 1:
            mine = key[at[i]:at[i + 1]]
            order = np.sort(mine)
            twice = order[1:][order[1:] == order[:-1]]
            if len(twice):
                hit = first[at[i]:at[i + 1]][np.isin(mine, twice)] - w.word_at[i]
                repeat[i] = _covered(hit, REPEAT_WINDOW, int(words[i]))
    base = np.stack([words, chars, symbols, dup, repeat], axis=1).astype(np.int64)
    one = np.maximum(words, 1)
    byte = np.maximum(size, 1)
    features = np.stack([
        np.log1p(words), chars / one, symbols / np.maximum(chars, 1), dup / np.maximum(lines, 1), repeat / one,
        _per_text(_UPPER[w.data], w.text_at) / byte, _per_text(_DIGIT[w.data], w.text_at) / byte,
        _per_text(_MARK[w.data], w.text_at) / byte, distinct / one, stutter / one], axis=1)
    return base, features


def base_failed(base: np.ndarray) -> np.ndarray:
    n, repeat = base[:, 0], base[:, 4]
    return (n < LEAST_WORDS) | (100 * repeat > MOST_REPEATED_PERCENT * n)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> gbt.Trees:
    """Trees from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality 0/1).
    Rows with a null id or label are left out; a null text counts as empty.  An
    id with both labels takes 0, and one with several texts the least of them.
    Without rows of both labels there are no trees and no text is refused."""
    picked = marked_ids(labels, "quality", {0: per_label, 1: per_label}, "quality")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = rows.join(F.broadcast(written(picked, "quality-sample")), "doc_id") \
        .groupBy("doc_id", "quality").agg(F.min("text").alias("text"))              # at most 2 * per_label rows

    def measure(batches):
        for c in chunks(batches):
            _, x = statistics(c.column("text"))
            yield pa.RecordBatch.from_arrays([c.column("doc_id"), c.column("quality"),
                                              pa.array(list(x), pa.list_(pa.float64()))],
                                             names=["doc_id", "quality", "x"])

    got = sorted((r["doc_id"], r["quality"], r["x"])
                 for r in sample.mapInArrow(measure, "doc_id long, quality int, x array<double>").collect())
    x = np.array([r[2] for r in got], float).reshape(-1, len(FEATURES))
    trees = gbt.fit(x, np.array([r[1] for r in got], float), MONOTONE)
    if not len(trees.root):
        trees.base = 0.0
    return trees


def judge(df: DataFrame, trees: gbt.Trees) -> DataFrame:
    """Per row of ``df``: doc_id, the base counts, base_failed, kept and the
    trees' probability of good quality.  Null and empty texts have no words and
    fail; rows that repeat get equal verdicts; other columns are ignored."""
    schema = ("doc_id long, " + ", ".join(f"{c} long" for c in BASE)
              + ", base_failed boolean, kept boolean, quality double")
    shared = df.sparkSession.sparkContext.broadcast(trees)       # bounded by rounds and depth

    def run(batches):
        for c in chunks(batches):
            base, x = statistics(c.column("text"))
            failed, odds = base_failed(base), shared.value.score(x)
            yield pa.RecordBatch.from_arrays(
                [c.column("doc_id"), *(pa.array(base[:, j]) for j in range(len(BASE))), pa.array(failed),
                 pa.array(~failed & (odds >= 0)), pa.array(1 / (1 + np.exp(-odds)))],
                names=["doc_id", *BASE, "base_failed", "kept", "quality"])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)
