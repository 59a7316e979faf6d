"""Operator 12: resampling of documents towards a target distribution.

Features (words and pairs of neighbouring words) are hashed into buckets; the
log ratio of a bucket's share in the target and in the documents is its gain,
and a document weighs the mean gain of its features plus Gumbel noise.  Both
passes over the texts work on arrays: the crc32 of a pair follows from those of
its two words by the linearity of the checksum.

The highest scores are drawn by parallel sorting by regular sampling: every
task sorts its run and gives regular samples, these give splitters, segments
are exchanged and merged inside their task, and prefix counts of the segments
turn places into exact ranks.  The key ends in a number of the row, so equal
scores and repeated rows spread over segments as well.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import chunks, written
from .words import Words, split_words

BUCKETS, LEAST_WORDS, PERCENT, SALT = 10_000, 20, 25, 7
#: Rows of one segment of the sort, and samples of one run for each 2^20 rows.
SEGMENT_ROWS, SAMPLES_EACH = 1 << 20, 64
#: Words up to this many bytes are hashed together, column by column.
SHORT = 48

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_FULL = np.uint32(0xFFFFFFFF)


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    """crc32 of the public polynomial, one byte at a time."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & np.uint32(1), (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


@lru_cache(maxsize=1)
def _shift_tables() -> np.ndarray:
    """[length][byte place][byte]: a checksum moved on by ``length`` zero bytes."""
    t = _crc_table()
    out = np.zeros((SHORT + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(SHORT):
        out[n + 1] = t[out[n] & np.uint32(0xFF)] ^ (out[n] >> np.uint32(8))
    return out


def word_crcs(words: Words) -> np.ndarray:
    """crc32 of every word."""
    t, size = _crc_table(), words.end - words.start
    crc = np.full(len(size), _FULL, np.uint32)
    order = np.argsort(-np.minimum(size, SHORT + 1), kind="stable")
    long = int(np.count_nonzero(size > SHORT))
    for w in order[:long].tolist():
        crc[w] = _FULL ^ np.uint32(zlib.crc32(words.data[words.start[w]:words.end[w]].tobytes()))
    rest = order[long:]
    begin, own, state = words.start[rest], size[rest], crc[rest]
    for i in range(int(own[0]) if len(own) else 0):
        k = int(np.searchsorted(-own, -i))          # words longer than i come first
        state[:k] = t[(state[:k] ^ words.data[begin[:k] + i]) & np.uint32(0xFF)] ^ (state[:k] >> np.uint32(8))
    crc[rest] = state
    return crc ^ _FULL


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every feature, the text it belongs to, words per text)."""
    words = split_words(texts, _IS_WORD, _LOWER)
    crc, size = word_crcs(words), words.end - words.start
    text = words.text_of_word()
    pair = np.flatnonzero(text[1:] == text[:-1])
    state = crc[pair] ^ _FULL                        # the first word, then a space
    state = _crc_table()[(state ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (state >> np.uint32(8)) ^ _FULL
    second = size[pair + 1]
    tables, fit = _shift_tables(), np.minimum(second, SHORT)
    moved = tables[fit, 0, state & np.uint32(0xFF)]
    for k in range(1, 4):
        moved = moved ^ tables[fit, k, (state >> np.uint32(8 * k)) & np.uint32(0xFF)]
    both = moved ^ crc[pair + 1]
    for i in np.flatnonzero(second > SHORT).tolist():
        p = pair[i]
        both[i] = zlib.crc32(words.data[words.start[p + 1]:words.end[p + 1]].tobytes(),
                             int(state[i]))
    every = np.concatenate((crc, both)) % np.uint32(buckets)
    return every.astype(np.int64), np.concatenate((text, text[pair])), words.counts


def bucket_counts(df: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in the column ``text``; counted in the tasks,
    ``buckets`` numbers reach the driver."""
    def count(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(buckets, np.int64)
        for c in chunks(batches):
            total += np.bincount(features(c.column("text"), buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = df.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long") \
        .groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed target share over the source share."""
    n, t, s = float(len(source)), target.astype(float), source.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def scores(df: DataFrame, target: DataFrame, buckets: int = BUCKETS, salt: int = SALT) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, row) per row of ``df``; ``row``
    tells rows of a written table apart."""
    table = gains(bucket_counts(df, buckets), bucket_counts(target, buckets))
    shared = df.sparkSession.sparkContext.broadcast(table)          # ``buckets`` numbers

    def weigh(batches):
        gain = shared.value
        for c in chunks(batches):
            bucket, text, n_words = features(c.column("text"), len(gain))
            n = np.bincount(text, minlength=c.num_rows)
            total = np.zeros(c.num_rows, np.int64)
            np.add.at(total, text, gain[bucket])
            yield pa.RecordBatch.from_arrays(
                [c.column("doc_id"), pa.array(n_words.astype(np.int64)), pa.array(n.astype(np.int64)),
                 pa.array(total // np.maximum(n, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    print8 = F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(print8, 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(u)))
    return (rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
            .withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id()))


_KEY = ("down", "id", "row")            # -score, id (null last), row number; ascending


def _keys(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    last = np.iinfo(np.int64).max
    out = np.empty(batch.num_rows, [(k, np.int64) for k in _KEY])
    out["down"] = -batch.column("score").to_numpy()
    out["id"] = pa.compute.fill_null(batch.column("doc_id"), last).to_numpy()
    out["row"] = batch.column("row").to_numpy()
    return out


def _sorted_run(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray] | None:
    """A task's rows in the order of their keys."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return None
    run = pa.Table.from_batches(held).combine_chunks()
    key = _keys(run)
    order = np.argsort(key, order=_KEY)
    return run.take(pa.array(order)), key[order]


def ranked(rows: DataFrame, most: int, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The ``most`` first rows (doc_id, score, row) by descending score, ties to
    the smaller id, with their exact ``rank``.  ``rows`` is a written table, so a
    repeated task sees the same run."""
    schema = "doc_id long, score long, row long, segment int"
    n = rows.count()
    segments = max(1, min(n, max(n // segment_rows + 1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))))

    def sample(batches):
        got = _sorted_run(batches)
        if got is not None:
            key = got[1]
            k = min(len(key), SAMPLES_EACH * (len(key) // SEGMENT_ROWS + 1))
            at = (np.arange(k) * len(key) + len(key) // 2) // k          # regular places
            yield pa.RecordBatch.from_arrays([*(pa.array(key[c][at]) for c in _KEY), pa.array(np.full(k, len(key) / k))],
                                             names=[*_KEY, "weight"])

    drawn = rows.mapInArrow(sample, "down long, id long, row long, weight double").orderBy(*_KEY).toArrow()
    key = np.empty(drawn.num_rows, [(c, np.int64) for c in _KEY])
    for c in _KEY:
        key[c] = drawn.column(c).to_numpy()
    below = np.cumsum(drawn.column("weight").to_numpy())
    splitters = key[np.unique(np.searchsorted(below, n * np.arange(1, segments) / segments).clip(max=max(len(key) - 1, 0)))] \
        if len(key) else key
    shared = rows.sparkSession.sparkContext.broadcast(splitters)

    def deal(batches):
        got = _sorted_run(batches)
        if got is not None:
            run, key = got
            edge = np.searchsorted(key, shared.value) if len(shared.value) else np.empty(0, np.int64)
            part = np.zeros(len(key), np.int32)
            np.add.at(part, edge[edge < len(key)], 1)
            run = run.append_column("segment", pa.array(np.cumsum(part, dtype=np.int32)))
            yield from run.to_batches(max_chunksize=1 << 16)

    dealt = written(rows.select("doc_id", "score", "row").mapInArrow(deal, schema), "segments")
    sizes = dict(dealt.groupBy("segment").count().collect())            # one number per segment
    before, total = {}, 0
    for s in range(len(splitters) + 1):
        before[s], total = total, total + sizes.get(s, 0)
    # segments that begin behind the last place to draw stay where they are
    needed = [s for s in before if before[s] < most and s in sizes]

    def place(batches):
        at: dict[int, int] = {}
        for b in batches:
            segment = b.column("segment").to_numpy()
            rank = np.empty(len(segment), np.int64)
            for s in np.unique(segment).tolist():
                mine = np.flatnonzero(segment == s)
                first = at.get(s, before[s])
                rank[mine] = first + 1 + np.arange(len(mine))
                at[s] = first + len(mine)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(rank)], names=["row", "rank"])

    last = needed[-1] if needed else -1
    merged = dealt.filter(F.col("segment") <= last).repartitionById(max(1, last + 1), F.col("segment")).sortWithinPartitions(
        "segment", F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row")
    return merged.mapInArrow(place, "row long, rank long").filter(F.col("rank") <= most)


def resample(df: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             buckets: int = BUCKETS, salt: int = SALT, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) per row of ``df``: ``percent`` of
    the rows with ``least_words`` words have a rank, by descending score and
    ascending id; the others' rank is null.

    Null text: no words, weight 0.  A null id hashes as empty text and comes last
    among equal scores.  Repeated rows count and are drawn each; among equal keys
    any order of the rows.  An empty table gives no rows, an empty target the
    gains of the smoothing alone; other columns are ignored.
    """
    every = written(scores(df, target, buckets, salt), "scores")
    fit = every.filter(F.col("n_words") >= least_words).select("doc_id", "score", "row")
    most = fit.count() * percent // 100
    drawn = written(ranked(fit, most, segment_rows), "ranks")
    return every.join(drawn, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")
