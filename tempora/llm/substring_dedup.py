"""Operator 1: removal of repeated passages.

Every window of ``size`` consecutive words gets a Rabin-Karp hash.  Per slice
of a task, a window seen in several documents is settled at once for all but
the smallest id (map-side combine); only that one goes on, so a window that
a third of all documents share reaches its bucket once per slice, not once
per document.  Buckets find the smallest id per window; what else they hold
goes back to its documents, where neighbouring windows merge into maximal
removal intervals.

Windows travel packed (arrays in binary columns): one row per slice and
bucket instead of one per window.  Two windows count as equal if a 64-bit
hash and the bucket agree, which comes from a second hash over other hashes of
the words; both depend on a base that every run draws anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .frames import buckets_for, chunks, fresh, regroup, shard_of, shard_of_ids
from .words import draw_base, mix, split_words, window_keys

WINDOW = 13
#: Input bytes whose windows one bucket holds (about 4 million windows).
BUCKET_BYTES = 16 << 20
#: Text bytes whose windows are combined and packed together.
SLICE_BYTES = 2 << 20

_ENTRIES = "bucket int, doc_id long, spans binary, docs binary, counts binary, keys binary"
_FLAGS = "shard int, docs binary, counts binary, keys binary, spans binary"
_NO_ID = np.iinfo(np.int64).max
#: A removal interval counts only for rows of its id with this text.
_SPAN = np.dtype([("print", np.uint64), ("pair", np.uint64)])


def merge_intervals(first: np.ndarray, size: int) -> np.ndarray:
    """Maximal [start, end) word intervals covered by windows that begin at the
    ascending positions ``first``; k x 2."""
    if not len(first):
        return np.empty((0, 2), np.int32)
    gap = np.flatnonzero(np.diff(first) > size) + 1
    begin = first[np.concatenate(([0], gap))]
    end = first[np.concatenate((gap - 1, [len(first) - 1]))] + size
    return np.stack([begin, end], axis=1).astype(np.int32)


def bucket_of(spread: np.ndarray, buckets: int) -> np.ndarray:
    return ((spread >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def text_prints(first: np.ndarray, key: np.ndarray, per_text: np.ndarray, text_word_at: np.ndarray) -> np.ndarray:
    """64-bit hash of each text's windows and their places; 0 without windows."""
    out = np.zeros(len(per_text), np.uint64)
    held = np.flatnonzero(per_text)
    if len(held):
        place = (first - np.repeat(text_word_at, per_text)).astype(np.uint64)
        out[held] = np.add.reduceat(mix(key ^ mix(place)), (np.cumsum(per_text) - per_text)[held])
    return out


def _slice_entries(doc_id: np.ndarray, texts: pa.Array, size: int, buckets: int, base: int) -> pa.RecordBatch | None:
    order = np.argsort(doc_id, kind="stable")
    doc_id, texts = doc_id[order], texts.take(pa.array(order))
    words = split_words(texts)
    first, key, spread, per_text = window_keys(words, size, base)
    if not len(key):
        return None
    prints = text_prints(first, key, per_text, words.word_at[:len(per_text)])
    bucket = bucket_of(spread, buckets)
    row = np.repeat(np.arange(len(doc_id)), per_text)
    ids = doc_id[row]
    by_key = np.lexsort((np.arange(len(key)), key, bucket))     # ids ascend inside a key
    k, b, d = key[by_key], bucket[by_key], ids[by_key]
    head = np.ones(len(k), bool)
    head[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
    run = np.cumsum(head) - 1
    settled = d > d[head][run]
    out: dict[str, list] = {n: [] for n in ("bucket", "doc_id", "spans", "docs", "counts", "keys")}

    gone = np.sort(by_key[settled])
    for r, at in zip(*_runs(row[gone])):
        if doc_id[r] != _NO_ID:
            pairs = merge_intervals(first[gone[at]] - words.word_at[r], size)
            spans = np.empty(len(pairs), _SPAN)
            spans["print"], spans["pair"] = prints[r], np.ascontiguousarray(pairs).view(np.uint64).ravel()
            _add(out, bucket=int(r) % buckets, doc_id=int(doc_id[r]), spans=spans.tobytes())
    go = by_key[head]
    go = go[ids[go] != _NO_ID]
    go = go[np.lexsort((go, bucket[go]))]                        # by bucket, then by document
    for bkt, at in zip(*_runs(bucket[go])):
        mine = go[at]
        docs, counts = np.unique(ids[mine], return_counts=True)
        _add(out, bucket=int(bkt), docs=docs.tobytes(), counts=counts.astype(np.int32).tobytes(),
             keys=key[mine].tobytes())
    return pa.RecordBatch.from_pydict(out, schema=pa.schema([
        ("bucket", pa.int32()), ("doc_id", pa.int64()), ("spans", pa.binary()), ("docs", pa.binary()),
        ("counts", pa.binary()), ("keys", pa.binary())]))


def _add(out: dict[str, list], **values) -> None:
    for name, column in out.items():
        column.append(values.get(name))


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, list[slice]]:
    """Distinct values of an ascending array and the slice of each."""
    if not len(sorted_values):
        return sorted_values, []
    cut = np.concatenate(([0], np.flatnonzero(np.diff(sorted_values)) + 1, [len(sorted_values)]))
    return sorted_values[cut[:-1]], [slice(a, b) for a, b in zip(cut[:-1], cut[1:])]


def _bucket_flags(table: pa.Table, shards: int) -> Iterator[pa.RecordBatch]:
    """What a bucket sends back, one row per shard of documents."""
    out: dict[str, list] = {n: [] for n in ("shard", "docs", "counts", "keys", "spans")}
    settled = table.filter(pa.compute.is_valid(table["spans"]))
    if settled.num_rows:
        ids = settled["doc_id"].to_numpy()
        spans = settled["spans"].to_pylist()
        shard = shard_of_ids(ids, shards)
        order = np.argsort(shard, kind="stable")
        for s, at in zip(*_runs(shard[order])):
            mine = order[at]
            parts = [spans[i] for i in mine.tolist()]
            _add(out, shard=int(s), docs=ids[mine].tobytes(), spans=b"".join(parts),
                 counts=np.array([len(p) // _SPAN.itemsize for p in parts], np.int32).tobytes())
    packed = table.filter(pa.compute.is_valid(table["keys"]))
    if packed.num_rows:
        join = lambda name, kind: np.frombuffer(b"".join(packed[name].to_pylist()), kind)
        docs, counts, keys = join("docs", np.int64), join("counts", np.int32), join("keys", np.uint64)
        ids = np.repeat(docs, counts)
        order = np.lexsort((ids, keys))
        k, d = keys[order], ids[order]
        head = np.ones(len(k), bool)
        head[1:] = k[1:] != k[:-1]
        later = d > d[head][np.cumsum(head) - 1]
        k, d = k[later], d[later]
        shard = shard_of_ids(d, shards)
        order = np.lexsort((d, shard))
        for s, at in zip(*_runs(shard[order])):
            mine = order[at]
            who, n = np.unique(d[mine], return_counts=True)
            _add(out, shard=int(s), docs=who.tobytes(), counts=n.astype(np.int32).tobytes(), keys=k[mine].tobytes())
    if out["shard"]:
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
            ("shard", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary()),
            ("spans", pa.binary())]))


def _flags(df: DataFrame, size: int, buckets: int, base: int) -> DataFrame:
    """Words to remove, packed by shard of documents: ids, how many entries
    each has, and the entries: window hashes, or intervals (``_SPAN``)."""
    def entries(batches):
        for c in chunks(batches, limit=SLICE_BYTES):
            ids = pa.compute.fill_null(c.column("doc_id"), _NO_ID).to_numpy(zero_copy_only=False)
            out = _slice_entries(ids, c.column("text"), size, buckets, base)
            if out is not None:
                yield out

    def flags(batches):
        for table in regroup(batches, "bucket"):
            yield from _bucket_flags(table, buckets)

    return (df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(entries, _ENTRIES)
            .repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(flags, _FLAGS))


class _ShardFlags:
    """The flags of one shard, found by document id."""

    def __init__(self, table: pa.Table):
        self.parts = {}
        for name, kind in (("keys", np.uint64), ("spans", _SPAN)):
            rows = table.filter(pa.compute.is_valid(table[name]))
            join = lambda c, k: np.frombuffer(b"".join(rows[c].to_pylist()), k)  # noqa: E731,B023
            ids = np.repeat(join("docs", np.int64), join("counts", np.int32))
            order = np.argsort(ids, kind="stable")
            self.parts[name] = ids[order], join(name, kind)[order]

    def of(self, name: str, doc_id: int | None) -> np.ndarray:
        ids, values = self.parts[name]
        if doc_id is None:
            return values[:0]
        return values[np.searchsorted(ids, doc_id):np.searchsorted(ids, doc_id, "right")]


def _kept(table: pa.Table, flags: _ShardFlags, size: int, base: int) -> tuple[list[bytes], np.ndarray, np.ndarray, list]:
    """Per row: kept words joined by one space, word count, removed count, and
    the removed intervals."""
    words = split_words(table.column("text"))
    first, key, _, per_text = window_keys(words, size, base)
    prints = text_prints(first, key, per_text, words.word_at[:len(per_text)])
    window_at = np.concatenate(([0], np.cumsum(per_text)))
    raw = words.data.tobytes()
    texts, removed, intervals = [], np.zeros(table.num_rows, np.int64), []
    for i, doc_id in enumerate(table.column("doc_id").to_pylist()):
        parts = raw[words.text_at[i]:words.text_at[i + 1]].split()
        gone = np.zeros(len(parts) + 1, np.int32)
        spans = flags.of("spans", doc_id)
        pairs = spans["pair"][spans["print"] == prints[i]].view(np.int32).reshape(-1, 2)
        np.add.at(gone, pairs[:, 0], 1)
        np.add.at(gone, pairs[:, 1], -1)
        bad = flags.of("keys", doc_id)
        if len(bad):
            own = slice(window_at[i], window_at[i + 1])
            hit = first[own][np.isin(key[own], bad)] - words.word_at[i]
            gone += np.bincount(hit, minlength=len(gone)).astype(np.int32)
            gone -= np.bincount(hit + size, minlength=len(gone)).astype(np.int32)
        out = np.cumsum(gone[:-1]) > 0
        removed[i] = out.sum()
        edge = np.diff(np.concatenate(([0], out.view(np.int8), [0])))
        intervals.append(list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())))
        if removed[i]:
            parts = [p for p, g in zip(parts, out.tolist()) if not g]
        texts.append(b" ".join(parts))
    return texts, words.counts, removed, intervals


def _by_shard(df: DataFrame, size: int, bucket_bytes: int, finish, schema) -> DataFrame:
    """``finish(slice, flags of its shard, base)`` over all rows of ``df``; the
    texts meet their flags shard by shard."""
    base = draw_base()
    buckets = buckets_for(df, bucket_bytes)
    [shard] = fresh(df, "shard")
    rows = df.withColumn(shard, shard_of(F.col("doc_id"), F.col("text"), buckets))
    flags = _flags(df, size, buckets, base)

    def run(texts: pa.Table, packed: pa.Table) -> pa.Table:
        found = _ShardFlags(packed)
        out = [finish(pa.Table.from_batches([c]), found, base) for c in chunks(texts.combine_chunks().to_batches())]
        return pa.concat_tables(out) if out else arrow_schema.empty_table()

    arrow_schema = to_arrow_schema(schema)
    return (rows.groupBy(shard).cogroup(flags.groupBy("shard")).applyInArrow(run, schema))


def digest(df: DataFrame, size: int = WINDOW, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, removed) per row of ``df``;
    ``removed`` lists the maximal removed word intervals [start, end).

    Null text: no words.  Null id: the row keeps all its words and is no
    witness against others.  Rows of one id do not count against each other.
    Texts with fewer than ``size`` words lose nothing.  An empty table gives
    an empty result; other columns are ignored.
    """
    schema = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string, "
                                  "removed array<struct<start:int,end:int>>")
    interval = to_arrow_schema(schema).field("removed").type

    def finish(c: pa.Table, flags: _ShardFlags, base: int) -> pa.Table:
        texts, n, removed, gone = _kept(c, flags, size, base)
        pairs = [[{"start": a, "end": b} for a, b in g] for g in gone]
        return pa.table([c["doc_id"], pa.array(n.astype(np.int64)), pa.array(removed),
                         pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                         pa.array(pairs, interval)], names=schema.names)

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _by_shard(rows, size, bucket_bytes, finish, schema)


def remove_repeats(df: DataFrame, size: int = WINDOW, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df`` with the repeated passages cut out of ``text`` (kept words joined
    by one space; untouched texts stay as they are).  Edge cases as in
    :func:`digest`; all other columns stay, a null text stays null."""
    rows = df.withColumn("text", F.col("text").cast("string"))
    schema = rows.schema

    def finish(c: pa.Table, flags: _ShardFlags, base: int) -> pa.Table:
        texts, _, removed, _ = _kept(c, flags, size, base)
        old = c["text"].combine_chunks()
        new = pa.array([t.decode() if r else None for t, r in zip(texts, removed.tolist())], old.type)
        text = pa.compute.if_else(pa.array(removed > 0), new, old)
        return pa.table([text if n == "text" else c[n] for n in schema.names], names=schema.names)

    return _by_shard(rows, size, bucket_bytes, finish, schema)
