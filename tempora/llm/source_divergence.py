"""Operator 11: how far the sources of a language diverge in their words.

``CountVectorizer`` builds exact sparse document vectors per language: every
term is prefixed by its language, so one fit holds the vocabularies of all
languages and a document frequency counts documents of that language only.
Terms are dealt into bins by hash, inside each task, and a shard is as many bins
as keep the distinct terms of one model (driver and tasks hold its vocabulary) near
``SHARD_TERMS``; a bin with more of them is dealt once again.  Shards are fitted and
summed one after another, so that one vocabulary is held at a time.

A task hands on each distinct term a few times instead of once per occurrence:
for the fit in as many rows as it has documents there, up to the least document
frequency, and for the sums in rows that stand for 1, 2, 4, ... occurrences in a
(language, source).  Both give the vocabulary and the sums of the documents, exactly.
The vectors are summed per (language, source) as sparse entries, first inside
each task.  A term's sources, with their shares, are gathered in one row, as many
as its language has at most (the result has a row per pair of them).  Smoothed
shares and divergences are whole numbers.  A pair of sources is evaluated
sparsely: terms that only one of them has depend on its histogram of counts,
terms that neither has are equal, so only shared terms are met one by one.
"""

from __future__ import annotations

import uuid
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.session import checkpoint_dir

from .frames import buckets_for, chunks, input_bytes, written
from .words import name_hashes, split_words

# bytes of terms: letters of ASCII, and all of other characters
_IS_TERM = np.zeros(256, bool)
_IS_TERM[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Between language and term; no term holds it.
MARK = "\x01"
MIN_DOCS, SCALE, TERM_RANKS = 3, 1_000_000_000, 200
#: Distinct terms (rare ones included) of one vocabulary shard.
SHARD_TERMS = 1 << 20
#: Input bytes behind one bin of terms, and bins at most: each splits a task's rows.
BIN_BYTES, MOST_BINS = 128 << 20, 32
#: Text bytes of a slice, and terms of a row at most.
SLICE_BYTES, ROW_TERMS = 1 << 21, 1 << 16
#: Counts of terms, and entries of their vectors, that a task adds up before it hands
#: them on.
HELD_COUNTS, SUM_ENTRIES = 1 << 21, 1 << 20
#: Bytes of written terms behind one bucket of sums, which a task adds up at a time.
BUCKET_BYTES = 8 << 20
_MOST = 2 ** 31 - 1
_ROWS = "lang string, source string, layer int, times long, terms array<string>"


def plain_terms(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The number of terms of every text, and all terms one after another."""
    words = split_words(texts, _IS_TERM, _LOWER)
    # terms of one text lie apart, so their bytes are those that the table keeps
    at = np.concatenate(([0], np.cumsum(words.end - words.start)))
    data = words.data[_IS_TERM[words.data]]
    terms = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data))
    return np.diff(words.word_at), terms.dictionary_encode()


def _total(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key, back = np.unique(key, return_inverse=True)
    return key, np.bincount(back, n, len(key)).astype(np.int64)         # whole numbers below 2^53


def _counted(size: np.ndarray, code: np.ndarray, lang: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """The terms of documents of ``size`` terms each: language, code and documents of
    every distinct term, and the cells group, term (its place there) and occurrences."""
    n = int(code.max()) + 1 if len(code) else 1
    pair, count = np.unique(np.repeat(np.arange(len(size)), size) * n + code, return_counts=True)
    doc = pair // n
    terms, term, docs = np.unique(lang[doc] * n + pair % n, return_inverse=True, return_counts=True)
    each = max(1, len(terms))
    cell, total = _total(group[doc] * each + term, count)
    return terms // n, terms % n, docs, cell // each, cell % each, total


def _bags(docs: np.ndarray, owner: np.ndarray, term: np.ndarray, total: np.ndarray,
          min_docs: int) -> list[tuple[int, int, int, np.ndarray]]:
    """Rows (group, layer, times, terms) of documents that were counted together, from
    the documents of each term and the cells, sorted by group.

    Layer 1, 2, ... to ``min_docs`` (group -1) holds the terms of at least that many
    of the documents.  A term reaches ``min_docs`` rows over all such parts if and
    only if it reaches that many documents.  Layer 0 holds the occurrences of a group:
    a term found n times stands in the rows of the powers of two (``times``) that add
    up to n.  No row has more than ``ROW_TERMS`` terms."""
    out, least, bit = [], 1, 0
    split = lambda x: np.split(x, range(ROW_TERMS, len(x), ROW_TERMS))
    while least <= min_docs and len(held := np.flatnonzero(docs >= least)):
        out += [(-1, least, 1, x) for x in split(held)]
        least += 1
    while len(held := np.flatnonzero(total >> bit)):
        held = held[(total[held] >> bit & 1).astype(bool)]
        for at in np.split(held, np.flatnonzero(np.diff(owner[held])) + 1):
            out += [(int(owner[at[0]]), 0, 1 << bit, x) for x in split(term[at])] if len(at) else []
        bit += 1
    return out


def _cut(rows: list[tuple], firsts: np.ndarray) -> list[tuple]:
    """Rows of :func:`_bags` cut by bin, which comes last: ``firsts`` are the first codes
    of all bins but the first.  Codes ascend inside a row."""
    return [(*r[:3], x, i) for r in rows for i, x in enumerate(np.split(r[3], np.searchsorted(r[3], firsts)))
            if len(x) or not i and not len(r[3])]


def _terms(df: DataFrame, min_docs: int, bins: int = 1) -> DataFrame:
    """(lang, source, layer, times, terms) by kind and bin: the documents' terms,
    counted inside each task and handed on as :func:`_bags`, each row with terms of
    one bin, written once.  A group without terms has an empty row."""
    lang, source, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text"))

    def run(batches):
        groups: dict[tuple[str, str], int] = {}
        held: list[tuple] = []

        def handed():
            names, docs, owner, total = (np.concatenate(x) if i else pa.concat_arrays(x)
                                         for i, x in enumerate(list(zip(*held))[j] for j in (0, 1, 2, 4)))
            at = np.cumsum([0, *(len(x[0]) for x in held)])
            names = names.dictionary_encode()
            code, every_name = names.indices.to_numpy().astype(np.int64), names.dictionary
            each, firsts = max(1, len(every_name)), code[:0]
            if bins > 1:                                                    # codes ascend by bin
                of = (name_hashes(every_name) % np.uint64(bins)).astype(np.int64)
                order = np.argsort(of, kind="stable")
                code, every_name = np.argsort(order)[code], every_name.take(pa.array(order))
                firsts = np.searchsorted(of[order], np.arange(1, bins))
            term = code[np.concatenate([first + x[3] for first, x in zip(at, held)])]
            seen = np.unique(np.concatenate([x[5] for x in held]))
            held.clear()
            cell, total = _total(owner.astype(np.int64) * each + term, total)
            rows = _bags(np.bincount(code, docs, each).astype(np.int64), cell // each, cell % each, total, min_docs)
            rows += [(int(g), 0, 1, code[:0]) for g in np.setdiff1d(seen, cell // each)]
            rows = _cut(rows, firsts)
            every = [*groups, (None, None)]                                 # the last: no group
            for kept in ([r for r in rows if r[1]], [r for r in rows if not r[1]]):
                ends = np.cumsum([0, *(len(r[3]) for r in kept)]).astype(np.int32)
                place = np.concatenate([code[:0], *(r[3] for r in kept)])
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([every[r[0]][i] for r in kept], pa.string()) for i in (0, 1)),
                     pa.array([r[1] for r in kept], pa.int32()), pa.array([r[2] for r in kept], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends), every_name.take(pa.array(place))),
                     pa.array([r[4] for r in kept], pa.int32())],
                    names=["lang", "source", "layer", "times", "terms", "bin"])

        for c in chunks(batches, limit=SLICE_BYTES):
            size, words = plain_terms(c.column("text"))
            lang = c.column("lang").dictionary_encode()
            group = np.array([groups.setdefault(x, len(groups)) for x in
                              zip(c.column("lang").to_pylist(), c.column("source").to_pylist())], np.int64)
            of, code, docs, owner, term, total = _counted(size, words.indices.to_numpy().astype(np.int64),
                                                          lang.indices.to_numpy().astype(np.int64), group)
            names = pa.compute.binary_join_element_wise(lang.dictionary.take(pa.array(of)),
                                                        words.dictionary.take(pa.array(code)).cast(pa.string()), MARK)
            held.append((names, *(x.astype(np.int32) for x in (docs, owner, term)), total, np.unique(group)))
            if sum(len(x[2]) + len(x[0]) for x in held) >= HELD_COUNTS:
                yield from handed()
        if held:
            yield from handed()
        pa.default_memory_pool().release_unused()       # the worker lives on

    rows = df.select(lang, source, text).mapInArrow(run, f"{_ROWS}, bin int")
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tempora-llm-terms-{uuid.uuid4().hex}"
    # the two kinds of rows are read by different steps, bins by different shards
    return _stored(rows.withColumn("kind", (F.col("layer") > 0).cast("int")), path)


def _stored(rows: DataFrame, path: str) -> DataFrame:
    rows.write.partitionBy("kind", "bin").options(
        **{"compression": "zstd", "parquet.enable.dictionary": "false"}).parquet(path)
    return rows.sparkSession.read.schema(f"{_ROWS}, kind int, bin int").parquet(path)


def _dealt(rows: DataFrame, bins: int, parts: int) -> DataFrame:
    """Rows of ``bins`` bins with each bin dealt into ``parts`` bins, in one pass."""
    def run(batches):
        for b in batches:
            terms = b.column("terms")
            size = pa.compute.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
            names, row = terms.flatten(), np.repeat(np.arange(len(size)), size)
            part = (name_hashes(names) // np.uint64(bins) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(row * parts + part, kind="stable")
            # a row without terms stays
            key, n = np.unique(np.concatenate([row * parts + part, np.flatnonzero(size == 0) * parts]), return_counts=True)
            n[size[key // parts] == 0] = 0
            own, ends = pa.array(key // parts), np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(order)))
            bin_ = b.column("bin").to_numpy()[key // parts].astype(np.int64) * parts + key % parts
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(own) for c in ("lang", "source", "layer", "times")), lists,
                 b.column("kind").take(own), pa.array(bin_.astype(np.int32))],
                names=["lang", "source", "layer", "times", "terms", "kind", "bin"])
        pa.default_memory_pool().release_unused()

    path = f"{checkpoint_dir(rows.sparkSession).rstrip('/')}/tempora-llm-shards-{uuid.uuid4().hex}"
    return _stored(rows.mapInArrow(run, f"{_ROWS}, kind int, bin int"), path)


def _shards(rows: DataFrame, shard_terms: int, bins: int = 1) -> list[DataFrame]:
    """The rows once per shard of terms, with the terms of that shard: as many bins as
    hold ``shard_terms`` distinct terms."""
    # the first layers hold every distinct term of their slice; bins are alike by their hash
    each = rows.filter("kind = 1 and layer = 1 and bin = 0").select(F.explode("terms").alias("t")) \
        .agg(F.approx_count_distinct("t")).first()[0]
    if each > shard_terms:
        parts = each // shard_terms + 1
        rows, bins, each = _dealt(rows, bins, parts), bins * parts, shard_terms
    step = max(1, shard_terms // max(1, each))
    if step >= bins:
        return [rows]
    return [rows.filter((F.col("bin") >= i) & (F.col("bin") < i + step)) for i in range(0, bins, step)]


def _summed(batches, buckets: int):
    """Sums of the sparse vectors of a task, packed by bucket: the groups there and
    cells of group, place and n.  A place of a group has the same bucket everywhere."""
    names: dict[tuple[str, str], int] = {}
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def handed():
        key, n = _total(*(np.concatenate(x) for x in zip(*held)))
        held.clear()
        every = list(names)
        code, place = key >> 32, key & 0xFFFFFFFF
        bucket = (place + np.array([zlib.crc32(MARK.join(x).encode()) for x in every], np.int64)[code]) % buckets
        order = np.argsort(bucket, kind="stable")
        rows = []
        for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            known, own = np.unique(code[at], return_inverse=True)
            rows.append((int(bucket[at[0]]), *([every[i][j] for i in known] for j in (0, 1)),
                         own.astype("<i4").tobytes() + place[at].astype("<i4").tobytes() + n[at].astype("<i8").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(
            zip(*rows), (pa.int32(), *[pa.list_(pa.string())] * 2, pa.binary()))], names=["bucket", "langs", "sources", "cells"])

    for b in batches:
        lang, source = (b.column(x).dictionary_encode() for x in ("lang", "source"))
        langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
        each = max(1, len(sources))
        known, own = np.unique(lang.indices.to_numpy().astype(np.int64) * each + source.indices.to_numpy(), return_inverse=True)
        code = np.array([names.setdefault((langs[i // each], sources[i % each]), len(names)) for i in known.tolist()], np.int64)
        entries = b.column("places")
        size = pa.compute.list_value_length(entries).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.repeat(code[own], size)
        if len(group):
            held.append((group << 32 | entries.flatten().to_numpy().astype(np.int64),
                         b.column("counts").flatten().to_numpy() * np.repeat(b.column("times").to_numpy(), size)))
            if sum(len(k) for k, _ in held) >= SUM_ENTRIES:
                yield handed()
    if held:
        yield handed()
    pa.default_memory_pool().release_unused()


def _added(table: pa.Table) -> pa.Table:
    """(place, lang, source, n) of a bucket, from the sums of all tasks."""
    names: dict[tuple[str, str], int] = {}
    keys, counts = [], []
    for row in table.to_pylist():
        code = np.array([names.setdefault(x, len(names)) for x in zip(row["langs"], row["sources"])], np.int64)
        size = len(row["cells"]) // 16
        keys.append(code[np.frombuffer(row["cells"], "<i4", size)] << 32 | np.frombuffer(row["cells"], "<i4", size, 4 * size))
        counts.append(np.frombuffer(row["cells"], "<i8", size, 8 * size))
    key, n = _total(np.concatenate(keys), np.concatenate(counts))
    group = pa.array((key >> 32).astype(np.int32))
    lang, source = (pa.DictionaryArray.from_arrays(group, pa.array(x, pa.string())).cast(pa.string()) for x in zip(*names))
    return pa.table([pa.array((key & 0xFFFFFFFF).astype(np.int32)), lang, source, pa.array(n)],
                    names=["place", "lang", "source", "n"])


def _group_sums(rows: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """A shard's vocabulary (place, lang, term), and (place, lang, source, n > 0),
    written, so that the next shard finds neither this model nor its broadcast."""
    spark = rows.sparkSession
    # a vocabulary must not be empty: a term of no language, in enough documents
    nothing = spark.range(min_docs).select(F.array(F.lit("")).alias("terms"))
    model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_docs), vocabSize=_MOST) \
        .fit(rows.filter("kind = 1").select("terms").unionByName(nothing))
    path = f"{checkpoint_dir(spark).rstrip('/')}/tempora-llm-vocabulary-{uuid.uuid4().hex}"
    model.write().save(path)
    stored = spark.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("place", "name")).filter("name != ''")
    term = F.substring_index("name", MARK, -1)
    words = stored.select("place", term.alias("term"),
                          F.expr(f"left(name, length(name) - length(substring_index(name, '{MARK}', -1)) - 1)").alias("lang"))
    vector = F.unwrap_udt("vector")
    buckets = buckets_for(rows, BUCKET_BYTES)
    sums = model.transform(rows.filter("kind = 0")).select("lang", "source", "times", vector.alias("v")).select(
        "lang", "source", "times", F.col("v.indices").alias("places"), F.col("v.values").alias("counts")) \
        .mapInArrow(lambda batches: _summed(batches, buckets), "bucket int, langs array<string>, sources array<string>, cells binary")
    return words, written(sums.groupBy("bucket").applyInArrow(_added, "place int, lang string, source string, n long"),
                          "group-terms")


def _share(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + size)), exactly."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    return F.call_function("div", top, (total + size).cast("decimal(20,0)")) + 1


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(df: DataFrame, min_docs: int = MIN_DOCS, term_ranks: int = TERM_RANKS,
          shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other
    sources of the language by divergence from this one, part ``term`` the terms
    that this source has too often for its language, to ``term_ranks``.

    Null text, language and source count as empty text; a row is a document, so
    repeated rows count each.  A group without terms still has its pairs; a
    language without kept terms gives pairs of value 0.  Equal values rank by
    item.  An empty table gives no rows; other columns are ignored.
    """
    bins = min(MOST_BINS, input_bytes(df) // BIN_BYTES + 1)
    rows = _terms(df, min_docs, bins)
    parts = [[x.withColumn("shard", F.lit(i)) for x in _group_sums(s, min_docs)]
             for i, s in enumerate(_shards(rows, shard_terms, bins))]
    words, counts = (reduce(DataFrame.unionByName, x) for x in zip(*parts))
    words = written(words, "vocabulary")
    size = words.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    held = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    groups = rows.filter("kind = 0").select("lang", "source").distinct().join(held, ["lang", "source"], "left") \
        .join(size, "lang", "left").select("lang", "source", zero("total"), zero("held"), zero("size"))
    groups = written(groups.withColumn("none", F.when(F.col("size") > 0, _share(F.lit(0), F.col("total"), F.col("size")))), "groups")
    share = _share(F.col("n"), F.col("total"), F.col("size"))
    cells = counts.join(groups, ["lang", "source"]).select("shard", "place", "source", "n", "none", share.alias("share")) \
        .groupBy("shard", "place").agg(F.collect_list(F.struct("source", "share", "none")).alias("cells"),
                                       F.sum("n").alias("lang_n"))
    terms = written(cells.join(words, ["shard", "place"]).select("lang", "term", "cells", "lang_n"), "source-terms")
    histogram = counts.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms"))
    return _pairs(groups, histogram, terms).unionByName(_terms_above(groups, terms, term_ranks))


def _ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    out = rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return out if most is None else out.filter(F.col("rank") <= most)


def _terms_above(groups: DataFrame, terms: DataFrame, most: int) -> DataFrame:
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.first("size").alias("size"))
    q = _share(F.col("lang_n"), F.col("lang_total"), F.col("size"))
    own = terms.join(langs, "lang").select("lang", F.col("term").alias("item"), q.alias("q"), F.inline("cells"))
    above = own.filter("share > q").withColumn("value", _gap(F.col("share"), F.col("q")))
    return _ranked(above, "term", most)


def _pairs(groups: DataFrame, histogram: DataFrame, terms: DataFrame) -> DataFrame:
    """Every ordered pair of sources of a language.  The result has a row per
    pair, so its size is that of the pairs, whatever the terms."""
    side = lambda s: groups.select("lang", *[F.col(c).alias(f"{c}_{s}") for c in ("source", "total", "held", "none")],
                                   *(["size"] if s == "p" else []))
    both = side("p").join(side("q"), "lang").filter("source_p != source_q")
    many = lambda n, gap: n.cast("decimal(18,0)") * gap.cast("decimal(20,0)")
    known = both.filter("size > 0")
    key = ["lang", "source_p", "source_q"]
    p0, q0 = F.col("none_p"), F.col("none_q")
    # terms that neither has, and terms of either as if the other had none of them
    neither = known.select(*key, many(F.col("size") - F.col("held_p") - F.col("held_q"), _gap(p0, q0)).alias("value"))
    of = lambda s: histogram.withColumnRenamed("source", f"source_{s}")
    own = lambda s: _share(F.col("n"), F.col(f"total_{s}"), F.col("size"))
    first = known.join(of("p"), ["lang", "source_p"]).select(*key, many(F.col("terms"), _gap(own("p"), q0)).alias("value"))
    second = known.join(of("q"), ["lang", "source_q"]).select(*key, many(F.col("terms"), _gap(p0, own("q"))).alias("value"))
    # what terms of both add to the three parts above.  A sum of gaps is at most
    # (SCALE + size)^2, so four of them fit a long up to 500 million terms; beyond, ANSI mode raises
    p, q = F.col("share_p"), F.col("share_q")
    shared = terms.select("lang", "cells", F.inline("cells").alias("source_p", "share_p", "none_p")) \
        .select("lang", "source_p", "share_p", "none_p", F.inline("cells").alias("source_q", "share_q", "none_q")) \
        .filter("source_p != source_q").groupBy(*key).agg(
            F.sum(_gap(p, q) - _gap(p, q0) - _gap(p0, q) + _gap(p0, q0)).alias("value"))
    empty = both.filter("size = 0").select(*key, F.lit(0).alias("value"))
    parts = [x.select(*key, F.col("value").cast("decimal(38,0)").alias("value")) for x in (neither, first, second, shared, empty)]
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    sums = every.groupBy(*key).agg(F.sum("value").cast("long").alias("value"))
    return _ranked(sums.select("lang", F.col("source_p").alias("source"), F.col("source_q").alias("item"), "value"), "pair")
