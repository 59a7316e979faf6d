"""Operator 7: language identification.

A sparse multinomial logistic regression on TF-IDF values of hashed
character bigrams and trigrams (lower case, letters only, word borders
kept).  Document frequencies come from all training documents, counted in
Spark; the weights are learned by follow-the-regularised-leader (FTRL-
proximal, L1 and L2 penalties) on a bounded sample of ``PER_LANG`` training
documents a language, and a temperature is set on a fifth of that sample.
TF is a share of the text's n-grams, so a text's score is a mean over its
n-grams and needs one table lookup per n-gram, for texts of any length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chars import Chars, decode, letters, lower_table
from .frames import chunks, written

UNKNOWN = "und"
BINS = 1 << 15
#: Bound of the training sample: documents a language.
PER_LANG = 300
EPOCHS = 6
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
#: Brings TF-IDF means to the order of one.
SCALE = 100.0


@dataclass
class LanguageModel:
    classes: list[str]
    table: np.ndarray           # BINS x classes: idf times weight, scaled
    bias: np.ndarray
    temperature: float


def grams(chars: Chars) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bins, offsets of the texts, n-grams per text, letters per text) of the
    bigrams and trigrams; a bin row holds both, trigram bins after bigrams."""
    n = len(chars.at) - 1
    is_letter = letters()[chars.code]
    code = np.where(is_letter, lower_table()[chars.code], 32).astype(np.uint32)
    per_text_letters = _sums(is_letter.astype(np.int64), chars.at)
    # runs of non-letters become one border; every text starts and ends at one
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
    heads = chars.at[:-1][chars.at[:-1] < chars.at[1:]]
    keep[heads] = True
    kept_at = np.concatenate(([0], np.cumsum(keep)))[chars.at]
    kept = code[keep]
    size = np.diff(kept_at)
    at = np.concatenate(([0], np.cumsum(size + 2)))
    line = np.full(int(at[-1]), 32, np.uint32)
    line[np.arange(len(kept)) + 2 * np.repeat(np.arange(n), size) + 1] = kept
    a, b, c = line[:-2], line[1:-1], line[2:]
    two = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77))
    three = two * np.uint32(0xC2B2AE3D) + c * np.uint32(0x27D4EB2F)
    half = np.uint32(BINS // 2)
    two = ((two ^ (two >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(12)) % half
    three = ((three ^ (three >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(12)) % half + half
    # position i of a text of m characters (borders included): i < m - 2
    return np.stack([two, three], axis=1), at, np.maximum(size, 0) * 2, per_text_letters


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros((len(values) + 1, *values.shape[1:]), values.dtype)
    np.cumsum(values, axis=0, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _document_frequency(df: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each bin, and how many documents there are."""
    def count(batches):
        held, docs = np.zeros(BINS + 1, np.int64), 0
        for c in chunks(batches):
            bins, at, size, _ = grams(decode(c.column("text")))
            for i in range(c.num_rows):
                if size[i]:
                    seen = np.zeros(BINS, bool)
                    seen[bins[at[i]:at[i + 1] - 2].ravel()] = True
                    held[:BINS] += seen
            docs += c.num_rows
        if docs:
            held[BINS] = docs
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], names=["bin", "n"])

    rows = df.select("text").mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    freq = np.zeros(BINS + 1, np.int64)
    for r in rows:
        freq[r["bin"]] = r["n"]
    return freq[:BINS], int(freq[BINS])


def _features(df: DataFrame) -> list:
    """(lang, bins, shares) rows of a bounded sample."""
    def run(batches):
        for c in chunks(batches):
            bins, at, size, _ = grams(decode(c.column("text")))
            ids, shares = [], []
            for i in range(c.num_rows):
                u, k = np.unique(bins[at[i]:max(at[i], at[i + 1] - 2)].ravel(), return_counts=True)
                ids.append(u.astype(np.int32))
                shares.append((k / max(1, size[i])).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [c.column("doc_id"), c.column("lang"), pa.array(ids, pa.list_(pa.int32())),
                 pa.array(shares, pa.list_(pa.float32()))], names=["doc_id", "lang", "bins", "shares"])

    return df.mapInArrow(run, "doc_id long, lang string, bins array<int>, shares array<float>").collect()


def _ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (BINS + 1 x classes; the last row is the bias) by FTRL-proximal
    with elastic net, over ``EPOCHS`` passes."""
    z = np.zeros((BINS + 1, n_classes))
    n = np.zeros((BINS + 1, n_classes))
    weights = lambda z, n: np.where(
        np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for j in rng.permutation(len(rows)):
            y, at, x = rows[j]
            zj, nj = z[at], n[at]
            w = weights(zj, nj)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(nj + g * g) - np.sqrt(nj)) / ALPHA
            z[at] = zj + g - sigma * w
            n[at] = nj + g * g
    return weights(z, n)


def fit(train: DataFrame, per_lang: int = PER_LANG) -> LanguageModel:
    """Model from the rows of ``train`` (doc_id, text, lang) that have a text
    and a language.  No such rows: a model without classes.  The sample takes ids
    (not null) that repeat once a language, with their least text."""
    rows = train.filter("lang is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"))
    freq, docs = _document_frequency(rows)
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    picked = (rows.select("doc_id", "lang").distinct().withColumn("h", F.xxhash64("doc_id"))
              .withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_lang).select("doc_id", "lang"))
    # at most per_lang rows a language: an id that repeats in it has its least text
    sample = rows.filter("doc_id is not null").join(F.broadcast(written(picked, "lang-sample")), ["doc_id", "lang"]) \
        .groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    return train_on(_features(sample), freq, docs)


def train_on(sample: list, freq: np.ndarray, docs: int) -> LanguageModel:
    classes = sorted({r["lang"] for r in sample})
    if not classes:
        return LanguageModel([], np.zeros((BINS, 0), np.float32), np.zeros(0), 1.0)
    idf = np.log((1.0 + docs) / (1.0 + freq)) + 1.0
    rows = []
    for r in sorted(sample, key=lambda r: (r["doc_id"], r["lang"], r["bins"])):
        at = np.asarray(r["bins"], np.int64)
        x = np.asarray(r["shares"], np.float64) * idf[at] * SCALE
        rows.append((classes.index(r["lang"]), np.append(at, BINS), np.append(x, 1.0)))
    held = [r for i, r in enumerate(rows) if i % 5 == 0] if len(rows) >= 10 else rows
    learn = [r for i, r in enumerate(rows) if i % 5] if len(rows) >= 10 else rows
    w = _ftrl(learn, len(classes))
    scores = np.stack([x @ w[at] for _, at, x in held])
    truth = np.array([y for y, _, _ in held])
    return LanguageModel(classes, (w[:BINS] * idf[:, None] * SCALE).astype(np.float32), w[BINS],
                         calibrate(scores, truth))


def calibrate(scores: np.ndarray, truth: np.ndarray) -> float:
    """The temperature with the least log loss on a grid."""
    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(truth)), truth]).mean())
    return min((float(t) for t in np.geomspace(0.25, 8.0, 41)), key=loss)


def score_batch(model: LanguageModel, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and probability per text."""
    bins, at, size, n_letters = grams(decode(texts))
    n = len(at) - 1
    if not model.classes:
        return [UNKNOWN] * n, np.zeros(n)
    s = np.empty((n, len(model.classes)))
    for i in range(n):
        own = bins[at[i]:max(at[i], at[i + 1] - 2)]
        s[i] = model.table[own.ravel()].sum(axis=0, dtype=np.float64) / max(1, size[i]) if len(own) else 0.0
    s = (s + model.bias) / model.temperature
    p = np.exp(s - s.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    known = n_letters > 0
    return ([model.classes[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())],
            np.where(known, p.max(axis=1), 0.0))


def predict(df: DataFrame, model: LanguageModel, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with the predicted language and its calibrated probability.
    Null texts and texts without a letter: ``und``, score 0."""
    df = df.withColumn("text", F.col("text").cast("string"))
    schema = df.withColumn(lang, F.lit("")).withColumn(score, F.lit(0.0)).schema
    shared = df.sparkSession.sparkContext.broadcast(model)      # BINS x classes floats

    def run(batches):
        for c in chunks(batches):
            best, p = score_batch(shared.value, c.column("text"))
            yield pa.RecordBatch.from_arrays([*c.columns, pa.array(best, pa.string()), pa.array(p)],
                                             names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def training_rows(df: DataFrame, held_out: Column) -> DataFrame:
    return df.filter(~F.coalesce(held_out, F.lit(False))).select("doc_id", "text", "lang")
