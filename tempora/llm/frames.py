"""Spark-side helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.session import materialize

#: Text bytes worked on at a time inside a task.
CHUNK_BYTES = 1 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under ``spark.checkpoint.dir`` and read back: cuts
    lineage, feeds several branches, survives lost executors."""
    return materialize(df, f"llm-{name}")


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text",
           limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices whose ``text`` column holds about ``limit`` bytes, so memory
    follows the slice and the longest single text, not the batch."""
    for batch in batches:
        n, start = batch.num_rows, 0
        if not n:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        held = 0
        for i in range(n):
            held += int(sizes[i])
            if held >= limit:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < n:
            yield batch.slice(start, n - start)


def regroup(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal ``key`` of a partition sorted by it, one table per run,
    also where a run spans batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *((keys[1:] != keys[:-1]).nonzero()[0] + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for base in bases:
        name = f"__{base}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` reads (file sizes), 0 where one of them
    has no known size.  Sizes of joins are not used: they are guesses."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return 0 if any(s >= 1 << 60 for s in sizes) else sum(sizes)


def buckets_for(df: DataFrame, bytes_each: int) -> int:
    """How many buckets keep each near ``bytes_each`` of input; grows with the
    input, never below the session's shuffle partitions."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return int(min(2 ** 30, max(least, input_bytes(df) // bytes_each + 1)))


def fold_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo ``modulus``; null id: null."""
    return F.crc32(doc_id.cast("string")) % modulus


def marked_ids(labels: DataFrame, column: str, most: dict[int, int], salt: str) -> DataFrame:
    """(doc_id, ``column``) for at most ``most[label]`` ids of each label, those
    with the least hashes.  Null ids and labels, and labels not in ``most``, are
    left out; an id with several labels takes the smallest.  Bounds on the hash,
    from the count of each label, leave few rows before any are sorted."""
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias(column))
             .filter(F.col("doc_id").isNotNull() & F.col(column).isin(list(most)))
             .groupBy("doc_id").agg(F.min(column).alias(column))
             .withColumn("h", F.xxhash64("doc_id", F.lit(salt))))
    held = {r[column]: r["n"] for r in marks.groupBy(column).agg(F.count(F.lit(1)).alias("n")).collect()}
    out = None
    for label, limit in most.items():
        rows = marks.filter(F.col(column) == label)
        share = (limit + 10 * limit ** 0.5 + 10) / max(1, held.get(label, 0))
        if share < 1:
            rows = rows.filter(F.col("h") <= F.lit(int(-2 ** 63 + share * 2 ** 64)))
        rows = rows.orderBy("h", "doc_id").limit(limit).select("doc_id", column)
        out = rows if out is None else out.unionByName(rows)
    return out


def id_hash(ids: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of a long column (seed 42), unsigned, in numpy."""
    u = np.uint64
    p1, p2, p3, p4, p5 = (u(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                         0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: (x << u(r)) | (x >> u(64 - r))
    h = turn(ids.astype(np.int64).view(u) * p2, 31) * p1 ^ (u(42 + 8) + p5)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> u(33))) * p2
    h = (h ^ (h >> u(29))) * p3
    return h ^ (h >> u(32))


def shard_of(doc_id: Column, text: Column, shards: int) -> Column:
    """Shard of a row by its id; rows of a null id are dealt by their text."""
    h = F.when(doc_id.isNotNull(), F.xxhash64(doc_id.cast("long"))).otherwise(F.xxhash64(text))
    return F.pmod(F.shiftrightunsigned(h, 16), F.lit(shards)).cast("int")


def shard_of_ids(ids: np.ndarray, shards: int) -> np.ndarray:
    """The same for an int64 array without nulls."""
    return ((id_hash(ids) >> np.uint64(16)) % np.uint64(shards)).astype(np.int32)
