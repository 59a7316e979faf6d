"""Operators 11 and 12 against plain recomputation."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tempora.llm import catalog, importance_resampling as resampling, source_divergence

from llm_cases import ODD, docs_frame


# --- 11 ---------------------------------------------------------------------
def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_audit(docs, least=3, ranks=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for text, lang, source in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = [t for t in df if df[t] >= least]
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if df[t] >= least) for s in {d[1] for d in own}}
        share = lambda c: {t: 1 + 10 ** 9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p = {s: share(c) for s, c in counts.items()}
        q = share(sum(counts.values(), Counter()))
        gap = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, gap(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, rows, most in (("pair", pairs, None), ("term", terms, ranks)):
                rows.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(rows[:most])]
    return sorted(out)


AUDIT = [("The cat sat", "en", "a"), ("the CAT ran", "en", "b"), ("the cat, the dog", "en", "c"), ("cat dog dog", "en", None),
         ("Ünder the É cat", "en", "a"), ("le chat", "fr", "a"), ("le chien", "fr", "b"), ("no lang at all", None, "a"),
         (None, "en", "d"), ("", "", "a"), ("12 34 __", "x\x01y", "p"), ("w w", "x\x01y", "q"), ("w", "x\x01y", "q"),
         ("w v", "x\x01y", "p"), ("the " * 20_000, "en", "e"), ("a" * 200_000, "en", "e"), ("cat", "en", "a"), ("cat", "en", "a")]


def test_tasks_hand_on_counts_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(source_divergence, "SLICE_BYTES", 8)
    df = spark.createDataFrame([r for r in AUDIT if r[0] is None or len(r[0]) < 100] * 3, "text string, lang string, source string")
    want = brute_audit([tuple(r) for r in df.collect()])
    for entries in (1, 9, 1 << 20):
        monkeypatch.setattr(source_divergence, "HELD_COUNTS", entries)
        assert sorted(tuple(r) for r in source_divergence.audit(df.coalesce(2)).collect()) == want


@pytest.mark.parametrize("shard_terms", [1 << 20, 4])
def test_audit_matches_brute_force(spark, shard_terms):
    df = spark.createDataFrame([(*r, "x") for r in AUDIT], "text string, lang string, source string, terms string")
    got = source_divergence.audit(df, shard_terms=shard_terms)
    assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == brute_audit(AUDIT)


@pytest.mark.parametrize("bins, shard_terms", [(8, 1 << 20), (4, 24), (2, 12)])
def test_shards_hold_their_bins_one_after_another(spark, tmp_path, monkeypatch, bins, shard_terms):
    rng = np.random.default_rng(3)
    rows = [(" ".join(f"{'aé'[i % 2]}{'bcdefgh'[i % 7]}" + "z" * (i // 14) for i in rng.integers(0, 24, 12)), *g)
            for g in [("en", "a"), ("en", "b"), ("fr", "a"), ("", "c")] for _ in range(6)] + [(None, "en", "none"), ("12", "de", "x")]
    spark.createDataFrame(rows, "text string, lang string, source string").coalesce(3).write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    monkeypatch.setattr(source_divergence, "BIN_BYTES", 1)
    monkeypatch.setattr(source_divergence, "MOST_BINS", bins)
    shards, sums = [], source_divergence._group_sums

    def seen(part, least):
        words, counts = sums(part, least)
        # the sums are files: no plan of a shard reaches back to its model
        assert "MapInArrow" not in counts._jdf.queryExecution().optimizedPlan().toString()
        shards.append({(r["lang"], r["term"]) for r in words.collect()})
        return words, counts

    monkeypatch.setattr(source_divergence, "_group_sums", seen)
    got = source_divergence.audit(df, shard_terms=shard_terms)
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(rows)
    kept = {k for s in shards for k in s}
    assert sum(map(len, shards)) == len(kept) > 40
    assert len(shards) == 1 if shard_terms > 1000 else max(map(len, shards)) < len(kept) / 2


def test_audit_of_one_hot_source_and_of_nothing(spark):
    rows = [("alpha beta gamma " * 3, "en", "hot")] * 60 + [(f"alpha beta w{i % 7}", "en", f"s{i % 5}") for i in range(40)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    got = source_divergence.audit(df, term_ranks=2)
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(rows, ranks=2)
    assert source_divergence.audit(df.limit(0)).count() == 0
    none = source_divergence.audit(spark.createDataFrame([("a", "l", "x"), ("b", "l", "y")], df.schema)).collect()
    assert sorted((r["source"], r["item"], r["value"], r["rank"]) for r in none) == [("x", "y", 0, 1), ("y", "x", 0, 1)]


def test_audit_hands_on_terms_not_occurrences(spark):
    rows = [("alpha beta gamma " * 1000, "en", "hot")] * 60 + [("alpha beta", "en", "b"), (None, "fr", None)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    got = [r.asDict() for r in source_divergence._terms(df, 3).collect()]
    # 180,002 occurrences: three layers of three terms, and the powers of two of 60,000
    assert sum(len(r["terms"]) for r in got) <= 3 * 3 + 3 * 16 + 2
    name = lambda t: t.split(source_divergence.MARK)[1]
    assert sorted((r["layer"], *sorted(map(name, r["terms"]))) for r in got if r["kind"] == 1) == [
        (n, "alpha", "beta", "gamma") for n in (1, 2, 3)]
    sums = Counter()
    for r in got:
        if r["kind"] == 0:
            sums.update({(r["lang"], r["source"], name(t)): r["times"] for t in r["terms"]})
    assert sums == {("en", "hot", t): 60_000 for t in ("alpha", "beta", "gamma")} | {("en", "b", t): 1 for t in ("alpha", "beta")}
    assert [(r["source"], r["terms"]) for r in got if r["lang"] == "fr"] == [("", [])]


def test_bags_count_documents_and_occurrences(monkeypatch):
    monkeypatch.setattr(source_divergence, "ROW_TERMS", 5)
    rng = np.random.default_rng(5)
    for least in (1, 3, 4):
        docs = [[f"w{i}" for i in rng.integers(0, 12, rng.integers(0, 30))] for _ in range(9)]
        group = rng.integers(0, 3, 9)
        words = pa.array([w for d in docs for w in d], pa.string()).dictionary_encode()
        lang = group % 2
        of, code, docs_of, owner, term, total = source_divergence._counted(
            np.array([len(d) for d in docs]), words.indices.to_numpy().astype(np.int64), lang, group)
        rows = source_divergence._bags(docs_of, owner, term, total, least)
        names, layers, sums = [(lg, words.dictionary[c].as_py()) for lg, c in zip(of.tolist(), code.tolist())], Counter(), Counter()
        for g, layer, times, terms in rows:
            assert len(set(terms.tolist())) == len(terms)
            for c in terms:
                if layer:
                    layers[names[c]] += 1
                else:
                    sums[g, names[c]] += times
        df = Counter((g % 2, w) for g, d in zip(group.tolist(), docs) for w in set(d))
        assert layers == {w: min(n, least) for w, n in df.items()}
        assert sums == Counter((g, (g % 2, w)) for g, d in zip(group.tolist(), docs) for w in d)
        assert max(len(r[3]) for r in rows) <= 5


# --- 12 ---------------------------------------------------------------------
def brute_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute_resample(docs, target, percent=25, least=20, buckets=10_000):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in brute_features(t)[1])
    s, t = count(x for _, x in docs), count(target)
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
            for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        n, f = brute_features(text)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(fit[:len(fit) * percent // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def test_word_checksums(spark):
    texts = ["a bc def", "x" * 47 + " " + "y" * 48 + " " + "z" * 49 + " q", "", "É日本 x9", "A-B_c", "w" * 5000 + " end " + "v" * 500]
    bucket, text, n = resampling.features(pa.array(texts + [None]), 1 << 31)
    want = [(i, zlib.crc32(f.encode()) % (1 << 31)) for i, t in enumerate(texts) for f in brute_features(t)[1]]
    assert sorted(zip(text.tolist(), bucket.tolist())) == sorted(want)
    assert n.tolist() == [brute_features(t)[0] for t in texts] + [0]


def test_resampling_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = catalog.QUERIES["op12_importance_resampling"](spark, sf)
    want = brute_resample([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in bench.collect()])
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert dict(got.dtypes) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")


def test_resampling_of_odd_rows(spark):
    rows = [(r[0], r[1]) for r in ODD] + [(50 + i, f"w{i} " * 25) for i in range(9)] + [(99, "copy of a row " * 8)] * 30
    target = spark.createDataFrame([("w1 w1 w2",), (None,)], "text string")
    df = docs_frame(spark, rows).repartition(6)
    got = resampling.resample(df, target, percent=50, segment_rows=4)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_resample(rows, ["w1 w1 w2"], percent=50)
    assert resampling.resample(df.limit(0), target).count() == 0
    assert resampling.resample(df, target.limit(0)).count() == len(rows)


def test_ranks_of_ties_spread_over_segments(spark):
    """A third of the rows share one key; every rank occurs once, in order."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"),
                                    F.when(F.col("id") % 3 == 0, F.lit(500)).otherwise(F.col("id") % 1000).alias("score"),
                                    F.monotonically_increasing_id().alias("row")).repartition(9)
    rows = rows.checkpoint()
    got = resampling.ranked(rows, 2500, segment_rows=100)
    assert got.rdd.getNumPartitions() > 20
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 400
    found = got.join(rows, "row").orderBy("rank").collect()
    assert [r["rank"] for r in found] == list(range(1, 2501))
    keys = [(-r["score"], r["doc_id"]) for r in found]
    assert keys == sorted(keys) and keys == sorted((-r["score"], r["doc_id"]) for r in rows.collect())[:2500]
