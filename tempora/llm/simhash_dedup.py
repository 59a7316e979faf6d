"""Operator 2: near-duplicates by SimHash and BK-trees.

Fingerprints are made where the text is.  Equal fingerprints collapse to one
node (their smallest id) before any search, so thousands of exact copies are
one entry.  Two fingerprints within ``radius`` bits agree on at least one of
``radius + 1`` bit blocks (pigeonhole); each block value is a shard, and a
BK-tree per shard is walked for all its members at once, following only
edges whose distance lies within the radius.  The shard's members meet by a
shuffle and its tree lives in that task, because a broadcast of all trees
would pass every fingerprint through the driver.  Shards over
``SHARD_LIMIT`` members are split again by sub-blocks of the remaining bits,
which loses no pair.  A shard emits a spanning forest of its links, never
all pairs, and :func:`components` joins the forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import chunks, fresh, regroup, written

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Members from which a shard is split by further bits.
SHARD_LIMIT = 4096
#: Distinct fingerprints from which finer blocks (six, any three agree) pay.
FINE_FROM = 1 << 26


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of one text: majority bits of the XXH64 of its word shingles."""
    words = text.lower().split()                 # bytes.lower: A-Z only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        spans = [line]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        start = end - size
        spans = [line[a:b] for a, b in zip(start[:len(words) - shingle + 1].tolist(), end[shingle - 1:].tolist())]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in spans), np.uint64, len(spans))
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[a:a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, name: str, shingle: int = SHINGLE) -> DataFrame:
    """``df`` with a long column ``name``: the fingerprint's 64 bits (null text:
    zero)."""
    df = df.withColumn("text", F.col("text").cast("string"))
    schema = df.withColumn(name, F.lit(0).cast("long")).schema

    def run(batches):
        for c in chunks(batches):
            texts = pa.compute.fill_null(c.column("text"), "").cast(pa.binary()).to_pylist()
            prints = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*c.columns, pa.array(prints)], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def bk_links(prints: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Label (smallest member index) of every member under links of at most
    ``radius`` bits, by walking a BK-tree for all members together.

    A node is a member; its children are keyed by their distance to it.  A
    query that lies d bits from the node goes on to the children within
    ``radius`` of d and to no other.
    """
    n = len(prints)
    label = np.arange(n)
    everyone = np.arange(n)
    stack = [(everyone, everyone)]
    while stack:
        members, queries = stack.pop()
        root = members[0]
        far = np.bitwise_count(prints[queries] ^ prints[root]).astype(np.int16)
        near = queries[far <= radius]
        met = np.unique(label[near])
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
        rest = members[1:]
        if not len(rest):
            continue
        edge = np.bitwise_count(prints[rest] ^ prints[root])
        for d in np.unique(edge).tolist():
            child, ask = rest[edge == d], queries[np.abs(far - d) <= radius]
            if len(ask) and not (len(child) == 1 and len(ask) == 1 and ask[0] == child[0]):
                stack.append((child, ask))
    return label


def _blocks(radius: int, fine: bool) -> list[list[tuple[int, int]]]:
    """Bit ranges (low bit, width) that form one shard key each."""
    if not fine:
        n = radius + 1
        cut = [64 * i // n for i in range(n + 1)]
        return [[(cut[i], cut[i + 1] - cut[i])] for i in range(n)]
    n = 2 * radius
    cut = [64 * i // n for i in range(n + 1)]
    parts = [(cut[i], cut[i + 1] - cut[i]) for i in range(n)]
    return [list(c) for c in combinations(parts, n - radius)]


def _bits(fp: Column, ranges: list[tuple[int, int]]) -> list[Column]:
    return [F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1).cast("long")) for low, width in ranges]


def _rest(ranges: list[tuple[int, int]], radius: int) -> list[list[tuple[int, int]]]:
    """The bits outside ``ranges``, dealt to ``radius + 1`` sub-blocks."""
    taken = {b for low, width in ranges for b in range(low, low + width)}
    free = [b for b in range(64) if b not in taken]
    out = []
    for i in range(radius + 1):
        bits = free[len(free) * i // (radius + 1):len(free) * (i + 1) // (radius + 1)]
        runs: list[list[int]] = []
        for b in bits:
            if runs and runs[-1][0] + runs[-1][1] == b:
                runs[-1][1] += 1
            else:
                runs.append([b, 1])
        out.append([(low, width) for low, width in runs])
    return out


def links(nodes: DataFrame, radius: int = RADIUS, limit: int = SHARD_LIMIT, fine: bool = False) -> DataFrame:
    """(a, b), b < a: a forest whose components are those of all links between
    ``nodes`` (node long, fp long; fingerprints distinct)."""
    tables = _blocks(radius, fine)
    shards = F.posexplode(F.array(*[F.xxhash64(F.lit(t), *_bits(F.col("fp"), r)) for t, r in enumerate(tables)]))
    entries = nodes.select("node", "fp", shards.alias("t", "shard"))
    counts = entries.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1")
    heavy = written(counts.filter(F.col("n") > limit).select("shard"), "heavy-shards")
    parts = [entries]
    if heavy.head(1):
        light = entries.join(heavy, "shard", "left_anti")
        subs = F.array(*[
            F.when(F.col("t") == t, F.array(*[
                F.xxhash64(F.col("shard"), F.lit(s), *_bits(F.col("fp"), sub))
                for s, sub in enumerate(_rest(r, radius))]))
            for t, r in enumerate(tables)])
        split = (entries.join(heavy, "shard")
                 .select("node", "fp", "t", F.explode(F.element_at(subs, F.col("t") + 1)).alias("shard")))
        parts = [light, split]
    frame = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def forest(batches) -> Iterator[pa.RecordBatch]:
        for group in regroup(batches, "shard"):
            if group.num_rows < 2:
                continue
            node = group["node"].to_numpy()
            order = np.argsort(node)
            node = node[order]
            label = bk_links(group["fp"].to_numpy()[order].view(np.uint64), radius)
            hit = np.flatnonzero(label != np.arange(len(label)))
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(node[label[hit]])], names=["a", "b"])

    return (frame.select("shard", "node", "fp").repartition("shard").sortWithinPartitions("shard")
            .mapInArrow(forest, "a long, b long").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, label): smallest node reachable over ``edges`` (a, b long).

    Every round takes the smallest label among a node and its neighbours
    (partial aggregates, so a hub is no hot group) and then the label's own
    label; rounds are written to shared storage.  Chains halve each round.
    """
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m"))
                     .select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        seen = (both.join(labels, both.b == labels.node).select("a", "label")
                .unionByName(labels.select(F.col("node").alias("a"), "label"))
                .groupBy("a").agg(F.min("label").alias("near")))
        up = labels.select(F.col("node").alias("via"), F.col("label").alias("up"))
        nxt = written(
            seen.join(up, F.col("near") == F.col("via"))
            .join(labels, F.col("a") == F.col("node"))
            .select("node", F.least("near", "up").alias("label"), F.col("label").alias("old")), "labels")
        if not nxt.filter("label <> old").head(1):
            return nxt.select("node", "label")
        labels = nxt.select("node", "label")


def _labelled(df: DataFrame, shingle: int, radius: int, columns: list[str]) -> tuple[DataFrame, str, str]:
    """``columns`` of ``df`` with fingerprint and component."""
    fp, comp, key, label = fresh(df, "fingerprint", "component", "fp_key", "label")
    printed = written(with_fingerprint(df.withColumn(comp, F.col("doc_id").cast("long")), fp, shingle)
                      .select(*columns, comp, fp), "prints")
    nodes = written(printed.groupBy(fp).agg(F.min(comp).alias("node")).filter("node is not null")
                    .select("node", F.col(fp).alias("fp")), "nodes")
    fine = nodes.count() > FINE_FROM
    labels = components(links(nodes, radius, fine=fine))
    of = (nodes.join(labels, "node", "left")
          .select(F.col("fp").alias(key), F.coalesce("label", "node").alias(label)))
    out = (printed.join(of, F.col(fp) == F.col(key), "left")
           .withColumn(comp, F.when(F.col(comp).isNotNull(), F.col(label))).drop(key, label))
    return out, fp, comp


def digest(df: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``df``.

    Null or empty text: fingerprint zero, linked like any other.  Null id: the
    row links nothing and has a null component.  Repeated rows keep their own
    rows.  An empty table gives an empty result; other columns are ignored.
    """
    rows, fp, comp = _labelled(df.select("doc_id", "text"), shingle, radius, ["doc_id"])
    return rows.select(
        "doc_id", F.lpad(F.lower(F.hex(fp)), 16, "0").alias("fingerprint"), F.col(comp).alias("component_id"))


def keep_first(df: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``df`` with one row per component: that of its smallest id.  Rows of a
    null id stay; of several rows with the component's id one stays (the
    smallest text).  Columns as before."""
    rows, fp, comp = _labelled(df, shingle, radius, df.columns)
    kept = rows.filter(F.col(comp).isNull() | (F.col(comp) == F.col("doc_id").cast("long")))
    [again] = fresh(rows, "again")
    repeated = written(df.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias(again))
                       .agg(F.count("*").alias("n")).filter("n > 1").select(again), "repeated-ids")
    if not repeated.head(1):
        return kept.select(*df.columns)
    # only rows whose id repeats have to be compared
    is_again = F.col(comp) == F.col(again)
    [nth] = fresh(rows, "nth")
    first = (kept.join(repeated, is_again, "left_semi")
             .withColumn(nth, F.row_number().over(Window.partitionBy(comp).orderBy("text"))).filter(F.col(nth) == 1))
    return kept.join(repeated, is_again, "left_anti").select(*df.columns).unionByName(first.select(*df.columns))
