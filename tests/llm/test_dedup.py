"""Operators 1 and 2 against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from tempora.llm import simhash_dedup, substring_dedup, words
from tempora.llm.frames import buckets_for, id_hash, input_bytes, shard_of, shard_of_ids

from llm_cases import ODD, docs_frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def random_text(rng, vocabulary, n):
    return "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(n))


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(500)]
    passage = random_text(rng, vocabulary, 60)
    rows = []
    for i in range(n):
        t = random_text(rng, vocabulary, rng.randint(0, 80))
        if i % 4 == 0:
            t += passage[rng.randint(0, 40):] + random_text(rng, vocabulary, 10)
        if i % 7 == 3 and rows:
            t = rows[rng.randrange(len(rows))][1]
        rows.append((1000 - i if i % 2 else i, t))
    return rows


def brute_substring(rows, size=13):
    firsts = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - size + 1):
            key = tuple(w[k:k + size])
            if i is not None:
                firsts[key] = min(i, firsts.get(key, i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and firsts[tuple(w[k:k + size])] < i:
                gone.update(range(k, k + size))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


def test_words_match_the_pattern():
    texts = ["a b", "", None, " x", "y ", "é\x0bü\x0c日本\r\n z", "", "tail"]
    w = words.split_words(pa.array(texts))
    raw = w.data.tobytes()
    got = [[raw[a:b].decode() for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.word_at[:-1], w.word_at[1:])]
    assert got == [WORD.findall(t or "") for t in texts]
    twice = words.split_words(pa.array(["same word other", "x same word"])).hashes()
    assert twice[0] == twice[4] and twice[1] == twice[5] and len(set(twice.tolist())) == 4


def mirrored(n=1024):
    """Two texts whose polynomials modulo 2^64 agree for every base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_crafted_words_differ(spark):
    one, two = mirrored()
    w = words.split_words(pa.array([one, two]))
    a, b = words.span_hash(w.data, w.start, w.end, words.BYTE_BASE, lambda v: words._BYTE[v])
    assert a == b                                       # what the prime polynomial is for
    for base in (words.PRIME_BASE, words.draw_base()):
        first, second = w.two_hashes(base)
        assert first[0] != first[1] and second[0] != second[1]
    rest = " ".join(f"w{i}" for i in range(12))
    rows = substring_dedup.digest(docs_frame(spark, [(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{one} {rest}")]))
    assert {r["doc_id"]: r["n_removed"] for r in rows.collect()} == {1: 0, 2: 0, 3: 13}


def test_prime_hash_matches_plain_arithmetic():
    texts = ["", "a", "ab", "é日本", "x" * 5000]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in texts])
    starts = ends - [len(t.encode()) for t in texts]
    got = words.prime_hash(data, starts, ends, 12345)
    want = [sum(int(words._BYTE31[c]) * pow(12345, i, words.PRIME) for i, c in enumerate(t.encode())) % words.PRIME for t in texts]
    assert got.tolist() == want


def test_shards_agree_with_spark(spark):
    ids = [0, 1, -1, 2 ** 62, 17, 10 ** 12]
    rows = spark.createDataFrame([(i,) for i in ids], "i long").select(
        "i", F.xxhash64("i").alias("h"), shard_of(F.col("i"), F.lit("x"), 97).alias("s")).collect()
    got = {r["i"]: (r["h"], r["s"]) for r in rows}
    a = np.array(ids)
    for i, h, s in zip(ids, id_hash(a).view(np.int64).tolist(), shard_of_ids(a, 97).tolist()):
        assert got[i] == (h, s)


def test_substring_matches_brute_force(spark):
    rows = corpus() + ODD + [(9, "word " * 20)]
    df = docs_frame(spark, rows).repartition(5)
    got = [tuple(r) for r in substring_dedup.digest(df).drop("removed").collect()]
    assert key(got) == key(brute_substring(rows))
    small = substring_dedup.digest(df, bucket_bytes=64).drop("removed").collect()
    assert key(map(tuple, small)) == key(got)


def test_substring_intervals_and_texts(spark):
    base = " ".join(f"a{i}" for i in range(40))
    rows = [(1, base), (2, "start " + base + " end"), (3, "untouched   spacing"), (4, None)]
    df = docs_frame(spark, rows)
    spans = {r["doc_id"]: [tuple(s) for s in r["removed"]] for r in substring_dedup.digest(df).collect()}
    assert spans == {1: [], 2: [(1, 41)], 3: [], 4: []}
    out = substring_dedup.remove_repeats(df)
    assert out.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {
        1: base, 2: "start end", 3: "untouched   spacing", 4: None}


def test_substring_empty(spark):
    df = docs_frame(spark, [])
    assert substring_dedup.digest(df).count() == 0 and substring_dedup.remove_repeats(df).count() == 0


def brute_print(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(prints, radius=3):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in ids:
        for b in ids:
            if b < a and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [(i + 100, t) for i, t in corpus(9, 50)]
    base = " ".join(f"Word{i}" for i in range(400))
    rows += [(2000 + i, base + " x" * rng.randint(0, 3)) for i in range(12)]
    rows = list({i: (i, t) for i, t in rows}.values()) + ODD
    prints = {i: brute_print(t) for i, t in rows if i is not None}
    label = brute_components(prints)
    df = docs_frame(spark, rows).repartition(4)
    got = simhash_dedup.digest(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["fingerprint"], r["component_id"]) == (f"{prints[r['doc_id']]:016x}", label[r["doc_id"]])
    kept = simhash_dedup.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(label.values()))
    assert kept.filter("doc_id is null").count() == 1


def near_prints(rng, n):
    centre = [rng.getrandbits(64) for _ in range(6)]
    out = set()
    while len(out) < n:
        x = rng.choice(centre)
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def test_tree_links_and_split_shards(spark):
    rng = random.Random(11)
    prints = near_prints(rng, 400)
    expect = brute_components(dict(enumerate(prints)))
    label = simhash_dedup.bk_links(np.array(prints, np.uint64))
    assert label.tolist() == [expect[i] for i in range(len(prints))]
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    nodes = spark.createDataFrame(signed, "node long, fp long")
    for limit, fine in ((4096, False), (20, False), (4096, True), (20, True)):
        edges = simhash_dedup.links(nodes, limit=limit, fine=fine)
        got = {r["node"]: r["label"] for r in simhash_dedup.components(edges).collect()}
        assert {i: got.get(i, i) for i in range(len(prints))} == expect


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 200).selectExpr("(id * 37) % 211 as x", "((id + 1) * 37) % 211 as y").selectExpr(
        "greatest(x, y) as a", "least(x, y) as b")
    got = simhash_dedup.components(edges).collect()
    assert len(got) == 200 and {r["label"] for r in got} == {min(r["node"] for r in got)}


def test_simhash_empty(spark):
    df = docs_frame(spark, [])
    assert simhash_dedup.digest(df).count() == 0 and simhash_dedup.keep_first(df).count() == 0


def test_buckets_follow_the_tables_read(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    size = input_bytes(docs.select("doc_id", "text"))
    assert 1_000_000 < size < 3_000_000
    assert input_bytes(docs.join(docs.withColumnRenamed("text", "t"), "doc_id")) == 2 * size
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert buckets_for(docs, 10_000) == size // 10_000 + 1 and buckets_for(docs, 1 << 30) == least
    assert buckets_for(docs_frame(spark, [(1, "a b")]), 1) <= 10_000


def test_substring_two_texts_of_one_id_in_one_slice(spark):
    rng = random.Random(8)
    passage, lead, other = (" ".join(f"{c}{rng.randint(0, 10**9)}" for _ in range(n)) for c, n in zip("pqr", (30, 50, 70)))
    for rows in ([(1, passage), (2, f"{lead} {passage}"), (2, "a b c")],
                 [(1, passage), (2, f"{lead} {passage}"), (2, other)],
                 [(1, passage), (2, "a b c"), (2, f"{passage} {lead}"), (2, f"{lead} {passage}"), (2, f"{lead} {passage}")]):
        df = docs_frame(spark, rows).coalesce(1)
        got = [tuple(r) for r in substring_dedup.digest(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
        assert key(got) == key(brute_substring(rows))
