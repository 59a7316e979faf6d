"""Operator 6: byte-level BPE encoding and decoding.

The ranks become a model of the ``tokenizers`` library over the public byte-
to-character table: every way to split a token into two known tokens is a
merge, ordered by the token's rank, which gives the merges that a rank file
implies.  Encoding runs over Arrow batches; offsets come from the byte
lengths of the tokens.  Decoding reverses the byte table and joins bytes
before it reads characters, so a character split between tokens survives.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chars import decode
from .frames import chunks
from .pretoken import cache_for


def byte_characters() -> list[str]:
    """The public byte-level table: printable Latin-1 bytes stand for
    themselves, the other bytes for U+0100 onwards, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


def rank_encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Encoder of pieces by a rank file; each piece is one unit of merging."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer, models, pre_tokenizers

    ranks = read_ranks(path)
    char = byte_characters()
    name = {t: "".join(char[b] for b in t) for t in ranks}
    merges = [(name[t[:k]], name[t[k:]]) for t in sorted(ranks, key=ranks.__getitem__)
              for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    model = models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
    t = Tokenizer(model)
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return lambda pieces: [e.ids for e in t.encode_batch_fast(pieces, add_special_tokens=False)]


def token_bytes(path: str) -> list[bytes]:
    """Bytes of every id, by the reversed byte table; unused ids are empty."""
    ranks = read_ranks(path)
    back = {c: b for b, c in enumerate(byte_characters())}
    char = byte_characters()
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = bytes(back[c] for c in (char[b] for b in token))
    return out


_tables: dict[str, list[bytes]] = {}


def _table(path: str) -> list[bytes]:
    if path not in _tables:
        _tables[path] = token_bytes(path)
    return _tables[path]


def decode_ids(ids: list[int], table: list[bytes]) -> bytes:
    return b"".join([table[i] for i in ids])


def offsets(ids: np.ndarray, text: str, table: list[bytes]) -> list[tuple[int, int]]:
    """Character span of every token; tokens that share a character overlap."""
    size = np.array([len(table[i]) for i in ids.tolist()], np.int64)
    end = np.cumsum(size)
    data = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1                   # character of every byte
    return list(zip(char[end - size].tolist(), (char[end - 1] + 1).tolist())) if len(ids) else []


def encode(df: DataFrame, ranks: str, with_offsets: bool = False) -> DataFrame:
    """(doc_id, ids array<int>[, starts, ends array<int>]) per row; null text
    counts as empty."""
    schema = "doc_id long, ids array<int>" + ", starts array<int>, ends array<int>" * with_offsets
    ints = pa.list_(pa.int32())

    def run(batches):
        cache = cache_for(ranks, lambda: rank_encoder(ranks))
        for c in chunks(batches):
            ids, at = cache.ids_of(decode(c.column("text")))
            own = [ids[a:b] for a, b in zip(at[:-1], at[1:])]
            out = [c.column("doc_id"), pa.array([i.astype(np.int32) for i in own], ints)]
            if with_offsets:
                spans = [offsets(i, t or "", _table(ranks)) for i, t in zip(own, c.column("text").to_pylist())]
                out += [pa.array([[s[k] for s in row] for row in spans], ints) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "ids", "starts", "ends"][:len(out)])

    return _plain(df).mapInArrow(run, schema)


def decoded(df: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, data binary) from rows (doc_id, ids): the joined bytes."""
    def run(batches):
        table = _table(ranks)
        for c in batches:
            rows = c.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [c.column("doc_id"), pa.array([decode_ids(i or [], table) for i in rows], pa.binary())],
                names=["doc_id", "data"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digest(df: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row of ``df``: the
    ids, and what they decode to.

    Null and empty texts have no ids and empty bytes.  Repeated rows give equal
    rows; an empty table gives none; other columns are ignored.
    """
    def run(batches):
        cache, table = cache_for(ranks, lambda: rank_encoder(ranks)), _table(ranks)
        for c in chunks(batches):
            ids, at = cache.ids_of(decode(c.column("text")))
            cols: list[list] = [[], [], []]
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                own = ids[a:b].tolist()
                for column, v in zip(cols, (len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(),
                                            hashlib.sha256(decode_ids(own, table)).hexdigest())):
                    column.append(v)
            yield pa.RecordBatch.from_arrays(
                [c.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()),
                 pa.array(cols[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _plain(df).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _plain(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
