"""Operator 8: exact top-k inner products by columnar branch-and-bound.

Candidates lie vertically (one row per dimension).  For a query, scores grow
dimension block by dimension block, the query's heaviest dimensions first;
after each block the rest of a score is bounded by the product of the
remaining masses (norms) of query and candidate, and candidates that cannot
reach the k-th best lower bound are compacted away.  What survives all
blocks has its exact score.

Queries and candidates are dealt into blocks of bounded size; every pair of
blocks meets in one group, sends on k rows a query, and the best k of those
are the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
DIMS_EACH = 8
CANDIDATES_EACH = 2048
QUERIES_EACH = 4096


def usable(vector: Column) -> Column:
    """Not null, and every component finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def search_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray,
                 k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score): for each query the best ``k`` of the vectors, ties
    to the smaller id; a vector of the query's own id is left out."""
    order = np.argsort(ids, kind="stable")
    ids, columns = ids[order], np.ascontiguousarray(vectors[order].T)       # dimension by dimension
    dims = len(columns)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    squares = columns.astype(np.float64) ** 2
    for query, own in zip(queries, query_ids.tolist()):
        heavy = np.argsort(-np.abs(query), kind="stable")
        alive = np.flatnonzero(ids != own)
        score = np.zeros(len(alive), np.int64)
        mass = squares[:, alive].sum(axis=0) if dims else np.zeros(len(alive))
        left = float((query.astype(np.float64) ** 2).sum())
        for a in range(0, dims, DIMS_EACH):
            block = heavy[a:a + DIMS_EACH]
            part = columns[np.ix_(block, alive)]
            score = score + query[block] @ part
            mass = mass - (part.astype(np.float64) ** 2).sum(axis=0)
            left -= float((query[block].astype(np.float64) ** 2).sum())
            if len(alive) <= k:
                continue
            # one part in a million covers the rounding of the float sums
            slack = np.sqrt(np.maximum(mass, 0) * max(left, 0.0)) * (1 + 1e-6) + 1.0
            low = score - slack
            bar = np.partition(low, len(low) - k)[len(low) - k]
            keep = np.flatnonzero(score + slack >= bar)
            if len(keep) < len(alive):
                alive, score, mass = alive[keep], score[keep], mass[keep]
        best = np.lexsort((ids[alive], -score))[:k]
        out.append((np.full(len(best), own), ids[alive][best], score[best]))
    return tuple(np.concatenate(c) if c else np.empty(0, np.int64) for c in zip(*out)) if out \
        else (np.empty(0, np.int64),) * 3


def _few_copies(scaled: DataFrame, k: int) -> DataFrame:
    """(vec_id, v) with at most ``k`` rows of equal id and vector; further ones
    are never among the best ``k``.  So rows can be dealt by id and vector."""
    copies = F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int"))
    return scaled.groupBy("vec_id", "v").agg(F.count("*").alias("n")).select("vec_id", "v", F.explode(copies)).drop("col")


def top_k(df: DataFrame, is_query: Column, k: int = 5, candidates_each: int = CANDIDATES_EACH,
          queries_each: int = QUERIES_EACH) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best rows per query row of
    ``df`` (vec_id, embedding).

    Components become floor(256 x).  Rows of a null id, a null vector, or a
    null or non-finite component take no part; vectors of different lengths
    are not compared; rows of the query's id are its own.  Repeated rows count
    once each.  Exact while scores fit a long.  Other columns are ignored; an
    empty table gives no rows.
    """
    scaled = (df.select(F.col("vec_id").cast("long").alias("vec_id"),
                        F.col("embedding").cast("array<double>").alias("v"), is_query.alias("q"))
              .filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
              .select("vec_id", "q", F.transform("v", lambda x: F.floor(x * SCALE).cast("long")).alias("v")))
    n = scaled.agg(F.count("*").alias("n"), F.count_if("q").alias("q")).head()
    groups, rounds = -(-n["n"] // candidates_each) or 1, -(-n["q"] // queries_each) or 1
    deal = lambda parts: F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    candidates = _few_copies(scaled, k).select(deal(groups).alias("g"), "vec_id", "v", F.size("v").alias("d")).select(
        "g", every(rounds).alias("r"), "d", "vec_id", "v")
    queries = (scaled.filter("q").dropDuplicates(["vec_id", "v"])
               .select(deal(rounds).alias("r"), "vec_id", "v", F.size("v").alias("d"))
               .select(every(groups).alias("g"), "r", "d", "vec_id", "v"))

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        values = t["v"].combine_chunks()
        flat = values.flatten().to_numpy(zero_copy_only=False) if t.num_rows else np.empty(0, np.int64)
        return flat.reshape(t.num_rows, -1) if len(flat) else np.zeros((t.num_rows, 0), np.int64), \
            t["vec_id"].to_numpy()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        v, ids = matrix(left)
        q, own = matrix(right)
        a, b, s = search_block(q, own, v, ids, k) if len(ids) else (np.empty(0, np.int64),) * 3
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()),
                         "score": pa.array(s, pa.int64())})

    met = (candidates.groupBy("g", "r", "d").cogroup(queries.groupBy("g", "r", "d"))
           .applyInArrow(run, "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
