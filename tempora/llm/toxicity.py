"""Operator 5: toxicity by a weighted lexicon.

Texts are folded: lower case, look-alike letters of other scripts and digits
or signs that stand for letters become plain letters, everything else a
space.  An Aho-Corasick automaton finds all lexicon entries in one pass:
whole words (``" word "``) and word stems (``" stem"``).  Exception phrases
are found the same way and take back the hits they cover.  The weight sum
and the weight per word feed a logistic curve.

The lexicon, its weights (smoothed log-odds), the exceptions and the curve
are learned from a bounded sample of labelled documents, ``TOXIC_DOCS`` and
``CLEAN_DOCS`` at most; counting runs in Spark.  Near copies in the sample
count once, and an entry has to be significant after a correction for all
terms tried, so that the chance vocabulary of a few long or copied documents
does not enter.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chars import Chars, decode, letters, lower_table
from .frames import chunks, marked_ids, written
from .words import mix, split_words, window_keys

#: Bounds of the fit: sampled documents of either label, and lexicon entries.
TOXIC_DOCS, CLEAN_DOCS = 3000, 9000
MAX_TERMS = 2000
#: Entries that may be in the lexicon by chance, on average at most.
ALPHA = 0.5
#: Near copies share the least hash of their word windows; tried with as many
#: hashes, of windows of so many words.
COPY_KEYS, COPY_WINDOW = 3, 5
STEM_LENGTHS = range(4, 9)
MIN_LOG_ODDS = 3.0
THRESHOLD = 0.7

# Characters that look like or stand for a plain letter.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Folded code point of every code point: lower case, full-width forms and
    look-alikes to plain letters, other letters kept, the rest a space."""
    low = lower_table().copy()
    wide = np.arange(0xFF41, 0xFF5B)
    low[wide] = wide - 0xFF41 + ord("a")
    low[np.arange(0xFF21, 0xFF3B)] = np.arange(26) + ord("a")
    is_letter = letters().copy()
    table = np.where(is_letter, low, 32).astype(np.uint32)
    for c, plain in LOOKALIKES.items():
        table[ord(c)] = ord(plain)
        table[ord(c.upper())] = ord(plain) if len(c.upper()) == 1 else table[ord(c.upper())]
    table[ord("I")] = ord("i")
    return table


def fold(chars: Chars) -> tuple[list[str], np.ndarray]:
    """(folded texts, words per text).  Digits and signs become letters only
    where a letter stands on one side at least."""
    code, table = chars.code, fold_table()
    out = table[code]
    letter = letters()[code]
    stands = np.zeros(len(code), bool)
    for sign in DIGITS:
        stands |= code == ord(sign)
    # runs of substitutes inside one text, and the letters at their two ends
    head = stands.copy()
    head[1:] &= ~stands[:-1]
    begins_text = chars.at[:-1][chars.at[:-1] < chars.at[1:]]
    head[begins_text] = stands[begins_text]
    start = np.flatnonzero(head)
    if len(start):
        at = np.flatnonzero(stands)
        run = np.cumsum(head)[at] - 1
        stop = start + np.bincount(run)
        text_of = np.searchsorted(chars.at, start, side="right") - 1
        before = (start > chars.at[text_of]) & letter[start - 1]
        after = (stop < chars.at[text_of + 1]) & letter[np.minimum(stop, len(code) - 1)]
        # a closing "!" is punctuation, as are all signs "!" that end a run with no letter after it
        shout = np.maximum.accumulate(np.where(code[at] != ord("!"), at, -1))
        last = np.full(len(start), -1)
        np.maximum.at(last, run, shout)
        hit = (before | after)[run] & (after[run] | (at <= last[run]))
        for sign, plain in DIGITS.items():
            out[at[hit & (code[at] == ord(sign))]] = ord(plain)
    word = out != 32
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    heads = chars.at[:-1][chars.at[:-1] < chars.at[1:]]
    begins[heads] = word[heads]
    total = np.concatenate(([0], np.cumsum(begins)))
    n_words = total[chars.at[1:]] - total[chars.at[:-1]]
    line = out.tobytes().decode("utf-32-le")
    return [line[a:b] for a, b in zip(chars.at[:-1].tolist(), chars.at[1:].tolist())], n_words


@dataclass
class Lexicon:
    weights: dict[str, float]           # " word " or " stem" -> weight
    exceptions: list[str]               # " two words "
    curve: tuple[float, float, float]   # intercept, weight sum, weight per word


def automaton(lexicon: Lexicon) -> ahocorasick.Automaton | None:
    a = ahocorasick.Automaton()
    for term, w in lexicon.weights.items():
        a.add_word(term, (len(term), w))
    for phrase in lexicon.exceptions:
        if phrase not in lexicon.weights:
            a.add_word(phrase, (len(phrase), None))
    if not len(a):
        return None
    a.make_automaton()
    return a


def hits(find: ahocorasick.Automaton | None, folded: str) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the hits that no exception phrase covers; hits
    that begin at one place count once, with the largest weight."""
    if find is None:
        return []
    found, spared = {}, []
    for last, (size, w) in find.iter(" " + folded + " "):
        start = last + 1 - size
        if w is None:
            spared.append((start, last + 1))
        elif start not in found or found[start][1] < w:
            found[start] = (last + 1, w)
    out, spared, i, reach = [], sorted(spared), 0, -1
    for s, (e, w) in sorted(found.items()):
        while i < len(spared) and spared[i][0] <= s:        # furthest end of the phrases begun by here
            reach = max(reach, spared[i][1])
            i += 1
        if e > reach:
            out.append((s, e, w))
    return out


def neighbours(line: str, places: list[int]) -> Iterator[tuple[str | None, str, str | None]]:
    """Words before, at and after each place of ``line``; a word that holds the
    place is parted there.  One pass over the line."""
    words = [m.span() for m in re.finditer(r"\S+", line)]
    ends = [b for _, b in words]
    for at in places:
        i = bisect_right(ends, at)
        start, end = words[i]
        before = (start, at) if start < at else words[i - 1] if i else None
        after = words[i + 1] if i + 1 < len(words) else None
        yield (before and line[slice(*before)]), line[max(start, at):end], (after and line[slice(*after)])


def _terms(words: set[str]) -> set[str]:
    out = set()
    for w in words:
        if len(w) >= 3:
            out.add(f" {w} ")
        out.update(" " + w[:k] for k in STEM_LENGTHS if k < len(w))
    return out


def _least_hashes(texts: pa.Array) -> np.ndarray:
    """COPY_KEYS least window hashes per text; short texts: of their words."""
    words = split_words(texts)
    _, key, _, per_text = window_keys(words, COPY_WINDOW)
    out = np.zeros((COPY_KEYS, len(per_text)), np.uint64)
    for values, counts, at in ((words.hashes(), words.counts, words.word_at[:-1]),
                               (key, per_text, np.cumsum(per_text) - per_text)):
        held = np.flatnonzero(counts)
        for i in range(COPY_KEYS if len(held) else 0):
            out[i, held] = np.minimum.reduceat(mix(values ^ np.uint64(i * 0x9E3779B97F4A7C15 % 2 ** 64)), at[held])
    return out.view(np.int64)


def _without_copies(sample: DataFrame) -> DataFrame:
    """One document (the smallest id) of every group of near copies."""
    names = [f"copy_{i}" for i in range(COPY_KEYS)]

    def keyed(batches):
        for c in chunks(batches):
            yield pa.RecordBatch.from_arrays([*c.columns, *map(pa.array, _least_hashes(c.column("text")))],
                                             names=["doc_id", "text", "toxic", *names])

    rows = sample.select("doc_id", "text", "toxic").mapInArrow(
        keyed, "doc_id long, text string, toxic int, " + ", ".join(f"{n} long" for n in names))
    for n in names:
        rows = rows.groupBy("toxic", F.col(n).alias("k")).agg(
            F.min_by(F.struct("doc_id", "text", *names), F.struct("doc_id", "text")).alias("r")).select("r.*", "toxic")
    return rows.select("doc_id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS) -> Lexicon:
    """Lexicon from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0/1);
    rows with a null id, text or label are left out.  An id with both labels
    counts as clean, and one with several texts has the least of them.  Without
    rows of both labels the lexicon is empty and every score is 0."""
    docs = docs.filter("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    picked = marked_ids(labels, "toxic", {1: toxic_docs, 0: clean_docs}, "tox")
    rows = docs.join(F.broadcast(written(picked, "toxic-sample")), "doc_id") \
        .groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))        # at most toxic_docs + clean_docs rows
    sample = written(_without_copies(rows), "toxic-texts")
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return Lexicon({}, [], (-8.0, 0.0, 0.0))

    def count(batches):
        seen: dict[str, list[int]] = {}
        for c in chunks(batches):
            for folded, y in zip(fold(decode(c.column("text")))[0], c.column("toxic").to_pylist()):
                for t in _terms(set(folded.split())):
                    seen.setdefault(t, [0, 0])[y] += 1
            if len(seen) > 500_000:
                yield _counted(seen)
                seen = {}
        if seen:
            yield _counted(seen)

    least = 3
    odds = F.log((F.col("bad") + 0.5) / (size[1] + 1.0)) - F.log((F.col("good") + 0.5) / (size[0] + 1.0))
    terms = written(sample.mapInArrow(count, "term string, good long, bad long")
                    .groupBy("term").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
                    .filter(F.col("good") + F.col("bad") >= least), "toxic-terms")
    # Chernoff bound on the chance of so large a toxic share, for all terms tried
    base, n = size[1] / (size[0] + size[1]), F.col("good") + F.col("bad")
    q = F.col("bad") / n
    surprise = n * (q * F.log(q / base) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - base))).otherwise(F.lit(0.0)))
    ranked = (terms.filter(F.col("bad") >= least).filter(q > base)
              .filter(surprise >= float(np.log(max(1, terms.count()) / ALPHA)))
              .withColumn("odds", odds).filter(F.col("odds") >= MIN_LOG_ODDS)
              .orderBy(F.desc("bad"), "term").limit(4 * MAX_TERMS).collect())
    weights = choose({r["term"]: (r["bad"], r["odds"]) for r in ranked})
    return _finish(sample, Lexicon(weights, [], (0.0, 0.0, 0.0)))


def _counted(seen: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()),
         pa.array([v[1] for v in seen.values()], pa.int64())], names=["term", "good", "bad"])


def choose(terms: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Entries without redundancy: a stem gives way to a longer entry with
    nearly its support (97 %), and what a kept stem covers is dropped."""
    names = sorted(terms, key=lambda t: (len(t), t))
    best_longer: dict[str, int] = {}
    for t in names:
        for k in STEM_LENGTHS:
            if k + 1 < len(t):
                best_longer[t[:k + 1]] = max(best_longer.get(t[:k + 1], 0), terms[t][0])
    kept: dict[str, float] = {}
    for t in names:
        if any(t[:k + 1] in kept for k in STEM_LENGTHS if k + 1 < len(t)):
            continue
        if not t.endswith(" ") and best_longer.get(t, 0) >= 0.97 * terms[t][0]:
            continue
        kept[t] = terms[t][1]
    top = sorted(kept, key=lambda t: (-terms[t][0], t))[:MAX_TERMS]
    return {t: kept[t] for t in sorted(top)}


def _finish(sample: DataFrame, lexicon: Lexicon) -> Lexicon:
    """Exceptions and curve, from a second pass over the sample."""
    def phrases(batches):
        find = automaton(lexicon)
        for c in chunks(batches):
            out, label = [], []
            for folded, y in zip(fold(decode(c.column("text")))[0], c.column("toxic").to_pylist()):
                line = " " + folded + " "
                for left, word, right in neighbours(line, [start for start, _, _ in hits(find, folded)]):
                    if left:
                        out.append(f" {left} {word} ")
                    if right:
                        out.append(f" {word} {right} ")
                    label += [y] * (len(out) - len(label))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(label, pa.int32())],
                                             names=["phrase", "toxic"])

    spared = (sample.mapInArrow(phrases, "phrase string, toxic int").groupBy("phrase")
              .agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
              .filter("bad = 0 and n >= 3").orderBy(F.desc("n"), "phrase").limit(MAX_TERMS).collect())
    lexicon = Lexicon(lexicon.weights, sorted(r["phrase"] for r in spared), lexicon.curve)

    def measured(batches):
        find = automaton(lexicon)
        for c in chunks(batches):
            yield pa.RecordBatch.from_arrays(
                [c.column("toxic"), *map(pa.array, measures(find, c.column("text")).T.copy())],
                names=["toxic", "total", "share"])

    rows = sample.mapInArrow(measured, "toxic int, total double, share double").collect()
    x = np.array([[r["total"], r["share"]] for r in rows])
    y = np.array([r["toxic"] for r in rows], float)
    return Lexicon(lexicon.weights, lexicon.exceptions, logistic(x, y))


def measures(find: ahocorasick.Automaton | None, texts: pa.Array) -> np.ndarray:
    """log1p of the weight sum, and of the weight sum per thousand words."""
    folded, n_words = fold(decode(texts))
    total = np.array([sum(w for _, _, w in hits(find, t)) for t in folded], float).reshape(-1)
    return np.stack([np.log1p(total), np.log1p(1000.0 * total / np.maximum(n_words, 1))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> tuple[float, float, float]:
    """Ridge logistic regression by damped Newton steps; slopes not negative."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * np.r_[0.0, w[1:]]
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-6, ridge, ridge])
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return float(w[0]), max(0.0, float(w[1])), max(0.0, float(w[2]))


def score(df: DataFrame, lexicon: Lexicon, name: str = "score") -> DataFrame:
    """``df`` with a toxicity score between 0 and 1.  Null and empty texts have
    no hits and get the curve's lowest value; an empty lexicon: about 0."""
    df = df.withColumn("text", F.col("text").cast("string"))
    schema = df.withColumn(name, F.lit(0.0)).schema
    shared = df.sparkSession.sparkContext.broadcast(lexicon)     # at most MAX_TERMS entries

    def run(batches):
        find = automaton(shared.value)
        b, w1, w2 = shared.value.curve
        for c in chunks(batches):
            m = measures(find, c.column("text"))
            p = 1.0 / (1.0 + np.exp(-np.clip(b + w1 * m[:, 0] + w2 * m[:, 1], -50, 50)))
            yield pa.RecordBatch.from_arrays([*c.columns, pa.array(p)], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)
