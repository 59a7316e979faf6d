"""Operator 9: packing token sequences by bin completion.

Documents become pieces of at most ``CAPACITY`` tokens.  How full sequences
are depends only on how many pieces there are of each length, so the search
runs on the histogram of lengths (at most ``CAPACITY`` numbers, whatever the
corpus): bin completion with multiplicities.  Around the largest remaining
length it enumerates the undominated fillings, fullest first: one is dominated
if a length that is left over can take the place of some of its pieces (or of
none) without being smaller than they are together.  A filling is applied as
often as the histogram allows, later also once; a branch whose waste passes that
of the best packing so far is cut.  The first incumbent is best-fit decreasing.
Without a limit on steps this is exact.  The result is a short list of patterns;
pieces are ranked within their length in Spark and look their place up.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chars import decode
from .frames import chunks, written
from .pretoken import cache_for, json_encoder

CAPACITY = 1024
END_ID = 2
#: Fillings that a search may look at beside its first descent; what it has found
#: by then is a whole packing, only perhaps not the best.
STEPS = 5000


def pieces(df: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID,
           keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row of ``df``.
    Null text counts as empty; only what exceeds the capacity is cut, and the
    first piece is the short one."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def run(batches):
        cache = cache_for(vocabulary, lambda: json_encoder(vocabulary))
        for c in chunks(batches):
            ids, at = cache.ids_of(decode(c.column("text")))
            rows: list[list] = [[] for _ in range(6)]
            for i, doc_id in enumerate(c.column("doc_id").to_pylist()):
                own = np.append(ids[at[i]:at[i + 1]], np.uint32(end_id)).astype("<u4")
                cuts = [0, *range((len(own) - 1) % capacity + 1, len(own) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    piece = own[a:b]
                    for column, v in zip(rows, (doc_id, k, a, b - a, zlib.crc32(piece.tobytes()), piece)):
                        column.append(v)
            out = [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()),
                   *(pa.array(r, pa.int64()) for r in rows[2:5])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                out.append(pa.array([p.astype(np.int32) for p in rows[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


@dataclass
class Pattern:
    lengths: tuple[int, ...]    # descending
    times: int


def lower_bound(count: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: total length, and for every k the
    pieces over capacity - k plus what the middle ones cannot share."""
    size = np.arange(len(count))
    best = -(-int((count * size).sum()) // capacity)
    for k in range(0, capacity // 2 + 1):
        large = int(count[capacity - k + 1:].sum())
        middle = count[capacity // 2 + 1:capacity - k + 1]
        room = int(middle.sum()) * capacity - int((middle * size[capacity // 2 + 1:capacity - k + 1]).sum())
        small = int((count[k:capacity // 2 + 1] * size[k:capacity // 2 + 1]).sum())
        best = max(best, large + int(middle.sum()) + max(0, -(-(small - room) // capacity)))
    return best


def _smear(bits: int, by: int) -> int:
    """``bits`` shifted up by 0 to ``by`` places, all together."""
    width = 1
    while width <= by:
        step = min(width, by + 1 - width)
        bits |= bits << step
        width += step
    return bits


def dominated(filling: tuple[int, ...], spare: int, waste: int) -> bool:
    """Can a left-over length (bits of ``spare``) replace pieces of ``filling``,
    or none, that together are not larger, within the ``waste`` left?  For one
    piece it has to be larger."""
    one, more = 0, 0            # sums of one piece, and of two or more
    for a in filling:
        more |= more << a | one << a
        one |= 1 << a
    larger = _smear(one << 1, waste - 1) if waste else 0
    return bool((_smear(more | 1, waste) | larger) & spare & ~1)


def _fillings(count: list[int], room: int, few_first: bool = True) -> Iterator[tuple[tuple[int, ...], bool]]:
    """Fillings of ``room`` (descending lengths), each with its dominance: fullest
    first, of one sum larger pieces first, with ``few_first`` a single piece and pairs
    before more pieces.
    ``count`` has to be as it was whenever the next one is asked for."""
    sizes = [a for a in range(1, room + 1) if count[a]]
    if not sizes:
        yield (), False
        return
    # reach[i]: sums that pieces of the i smallest lengths can make, as bits
    mask, reach = (1 << (room + 1)) - 1, [1]
    for a in sizes:
        bits, left, step = reach[-1], min(count[a], room // a), 1
        while left:
            take = min(step, left)
            bits |= (bits << (a * take)) & mask
            left -= take
            step *= 2
        reach.append(bits)
    present = sum(1 << a for a in sizes)
    # a waste that a length takes which no filling can use up is never undominated
    least = next((a for a in sizes if count[a] > room // a), room + 1)

    def walk(top: int, rest: int) -> Iterator[tuple[int, ...]]:
        """Multisets of the ``top`` smallest lengths with this sum."""
        if not rest:
            yield ()
            return
        for i in range(min(top, bisect_right(sizes, rest)) - 1, -1, -1):
            if not reach[i + 1] >> rest & 1:
                return
            a = sizes[i]
            for n in range(min(count[a], rest // a), 0, -1):
                if reach[i] >> (rest - n * a) & 1:
                    for tail in walk(i, rest - n * a):
                        yield (a,) * n + tail

    def of_sum(goal: int) -> Iterator[tuple[int, ...]]:
        if not few_first:
            yield from walk(len(sizes), goal)
            return
        if goal and count[goal]:
            yield (goal,)
        for a in range(goal - 1, (goal - 1) // 2, -1):
            if count[a] and count[goal - a] and (2 * a != goal or count[a] > 1):
                yield a, goal - a
        yield from (f for f in walk(len(sizes), goal) if len(f) not in (1, 2))

    for goal in range(reach[-1].bit_length() - 1, max(-1, room - least), -1):
        if reach[-1] >> goal & 1:
            for filling in of_sum(goal):
                gone = sum(1 << a for a in set(filling) if filling.count(a) == count[a])
                yield filling, dominated(filling, present & ~gone, room - goal)


def _times(count: list[int], lengths: tuple[int, ...]) -> int:
    return min(count[a] // lengths.count(a) for a in set(lengths))


def _best_fit(count: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing on the histogram: open sequences are kept by their
    remaining room, equal ones together."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    for a in range(capacity, 0, -1):
        left = int(count[a])
        while left:
            room = min((r for r in open_ if r >= a and open_[r]), default=None)
            if room is None:
                fit = capacity // a
                for n, k in ((left // fit, fit), (1 if left % fit else 0, left % fit)):
                    if n and k:
                        slot = open_.setdefault(capacity - a * k, {})
                        slot[(a,) * k] = slot.get((a,) * k, 0) + n
                left = 0
            else:
                pattern, times = open_[room].popitem()
                n = min(left, times)
                if times > n:
                    open_[room][pattern] = times - n
                slot = open_.setdefault(room - a, {})
                slot[(*pattern, a)] = slot.get((*pattern, a), 0) + n
                left -= n
    return [Pattern(p, n) for slot in open_.values() for p, n in slot.items()]


def _complete(left: list[int], capacity: int, bound: int, used: int, steps: int,
              few_first: bool) -> list[Pattern] | None:
    """Depth-first bin completion of the counts ``left``: the best packing of
    less than ``used`` sequences that it meets, if any."""
    best = None
    total = sum(a * c for a, c in enumerate(left))
    chosen: list[Pattern] = []
    n = tried = 0

    def options(size: int) -> Iterator[Pattern]:
        """Ways to fill the sequence of a piece of this length, best first."""
        nonlocal tried
        for once in (False, True):
            first = not once
            left[size] -= 1
            fillings = _fillings(left, capacity - size, few_first)
            for filling, worse in fillings:
                tried += not first
                first = False
                left[size] += 1
                if not worse:
                    pattern = (size, *filling)
                    times = _times(left, pattern)
                    if not once:
                        yield Pattern(pattern, times)
                    elif times > 1:
                        yield Pattern(pattern, 1)
                if tried >= steps:
                    return
                left[size] -= 1
            left[size] += 1

    def apply(p: Pattern, sign: int) -> None:
        nonlocal n, total
        for a in p.lengths:
            left[a] -= sign * p.times
        n += sign * p.times
        total -= sign * p.times * sum(p.lengths)

    # depth first; a level is its open options, and the pattern that led to it
    def open_level(size: int) -> tuple[int, Iterator[Pattern]]:
        while size and not left[size]:
            size -= 1
        return size, options(size) if size else iter(())

    levels = [open_level(len(left) - 1)]
    while levels and used > bound:
        size, ways = levels[-1]
        if not size and n < used:
            best, used = list(chosen), n
        p = next(ways, None) if n + -(-total // capacity) < used else None
        if p is None:
            levels.pop()
            if chosen:
                apply(chosen.pop(), -1)
        else:
            apply(p, 1)
            chosen.append(p)
            levels.append(open_level(size))
    return best


def plan(count: np.ndarray, capacity: int = CAPACITY, steps: int = STEPS) -> list[Pattern]:
    """Patterns that use every piece of the histogram ``count`` (by length): of
    best-fit decreasing and two searches, by either order of fillings, the best."""
    bound = lower_bound(count, capacity)
    best = _best_fit(count, capacity)
    used = sum(p.times for p in best)
    for few_first in (True, False):
        if used > bound:
            found = _complete([int(c) for c in count], capacity, bound, used, steps, few_first)
            if found is not None:
                best, used = found, sum(p.times for p in found)
    return best


def places(patterns: list[Pattern], capacity: int) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, pieces a sequence, first sequence, offset
    of the first): where the pieces of that length go, by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for p in patterns:
        offset = 0
        lengths = sorted(p.lengths, reverse=True)
        for a in sorted(set(lengths), reverse=True):
            k = lengths.count(a)
            out.setdefault(a, []).append((rank.get(a, 0), k, sequence, offset))
            rank[a] = rank.get(a, 0) + k * p.times
            offset += a * k
        sequence += p.times
    return {a: np.array(rows, np.int64) for a, rows in out.items()}


def pack(df: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID,
         keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of
    every piece of every row of ``df``.

    Null and empty texts are one piece of the end id.  Repeated rows are packed
    each on its own; a null id stays null.  An empty table gives no rows; other
    columns are ignored.
    """
    all_pieces = written(pieces(df, vocabulary, capacity, end_id, keep_ids), "pieces")
    spark = df.sparkSession
    deal = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = ["doc_id", "piece", "start", "length", "ids_crc32"]
    dealt = all_pieces.withColumn("deal", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(deal)))
    # pieces per length and deal, and how many deals before hold
    sums = dealt.groupBy("length", "deal").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("length", "deal", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    count = np.zeros(capacity + 1, np.int64)
    for r in all_pieces.groupBy("length").agg(F.count("*").alias("n")).collect():     # at most capacity rows
        count[r["length"]] = r["n"]
    where = places(plan(count, capacity), capacity)
    nth = F.row_number().over(Window.partitionBy("length", "deal").orderBy(*ids)) - 1
    ranked = (dealt.withColumn("nth", nth).join(offsets, ["length", "deal"])
              .withColumn("rank", F.col("nth") + F.col("before"))
              .select(*all_pieces.columns, "rank"))
    kept = all_pieces.columns
    names = [*ids, "sequence_id", "offset", *["ids"] * keep_ids]
    schema = ("doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
              + ", ids array<int>" * keep_ids)

    def run(batches):
        for c in batches:
            length, rank = c.column("length").to_numpy(), c.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for a in np.unique(length).tolist():
                at = np.flatnonzero(length == a)
                rows = where[a]
                r = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                q = rank[at] - r[:, 0]
                sequence[at] = r[:, 2] + q // r[:, 1]
                offset[at] = r[:, 3] + q % r[:, 1] * a
            cols = {**{n: c.column(n) for n in kept},
                    "sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)

    return ranked.mapInArrow(run, schema)
