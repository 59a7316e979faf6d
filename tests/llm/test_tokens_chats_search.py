"""Operators 4, 6, 8, 9 and 10 against brute force, round trips and invariants."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tempora.llm import best_fit_packing, byte_bpe, catalog, chat_format, pretoken, topk_search, url_templates
from tempora.llm.chars import decode

from llm_cases import ODD, docs_frame

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = list("ab cS's'tre'llvd  \n\t\r'\"!?12é 日本語  ́​½²ⅷ٣😀\x85\x1c\x00")


def own_tiktoken():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(MULTI),
                             special_tokens={})


def library():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


def random_texts(n=400, seed=2):
    rng = random.Random(seed)
    runs = [c * k for c in "a -=_0é日" for k in (2, 3, 5, 7, 11, 64, 200)]
    return runs + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)] + [
        "abababa" * 9, "<|endoftext|> x", "don't we'll they're 'sam ''s"]


def test_pieces_and_ids_match_both_libraries():
    texts = random_texts()
    chars = decode(pa.array(texts))
    for encode, want in ((byte_bpe.rank_encoder(MULTI), own_tiktoken().encode_ordinary),
                         (pretoken.json_encoder(JSON), lambda t, lib=library(): lib.encode(
                             t, add_special_tokens=False).ids)):
        for limit in (1 << 20, 50):
            cache = pretoken.PieceCache(encode, limit)
            for _ in range(2):
                ids, at = cache.ids_of(chars)
                assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [want(t) for t in texts]


def test_every_code_point_and_crafted_pieces():
    codes = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c) != "\r"]
    texts = ["".join(f"a{c}b {c}1{c} {c}{c}," for c in codes[i:i + 512]) for i in range(0, 0x34000, 512)]
    texts += ["".join(f"a{c}b {c}1" for c in codes[i:i + 512]) for i in range(0xE0000, 0xE0400, 512)]
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    texts += ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits), "x" * 100_000, "".join("ab"[b] for b in bits)]
    for encode, want in ((byte_bpe.rank_encoder(MULTI), own_tiktoken().encode_ordinary),
                         (pretoken.json_encoder(JSON), lambda t, lib=library(): lib.encode(
                             t, add_special_tokens=False).ids)):
        cache = pretoken.PieceCache(encode)
        for i in range(0, len(texts), 64):
            part = texts[i:i + 64]
            ids, at = cache.ids_of(decode(pa.array(part)))
            for a, b, t in zip(at[:-1], at[1:], part):
                assert ids[a:b].tolist() == list(want(t)), t[:20]


def test_cache_holds_its_bounds(monkeypatch):
    monkeypatch.setattr(pretoken, "CACHE_CHARS", 50)
    cache = pretoken.PieceCache(lambda pieces: [[ord(c) for c in p] for p in pieces])
    for i in range(9):
        text = f"{'y' * i} word{i} {'long' * 30} word"
        ids, _ = cache.ids_of(decode(pa.array([text, text])))
        assert ids.tolist() == [ord(c) for c in text] * 2 and len(cache.chars) <= 50 + 2 * len(text)


def test_bpe_query_matches_tiktoken(spark):
    rows = [(i, t) for i, t in enumerate(random_texts(100))] + [(1000 + (r[0] or 0), r[1]) for r in ODD]
    enc = own_tiktoken()
    df = docs_frame(spark, rows).repartition(3)
    got = sorted(tuple(r) for r in byte_bpe.digest(df, MULTI).collect())
    want = sorted((i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(),
                   hashlib.sha256((t or "").encode()).hexdigest())
                  for i, t, x in ((i, t, enc.encode_ordinary(t or "")) for i, t in rows))
    assert got == want
    back = byte_bpe.decoded(byte_bpe.encode(df, MULTI), MULTI).collect()
    assert sorted((r["doc_id"], bytes(r["data"]).decode()) for r in back) == sorted((i, t or "") for i, t in rows)
    assert byte_bpe.digest(docs_frame(spark, []), MULTI).count() == 0


def test_offsets_cover_split_characters(spark):
    text = "a 日本 ẞ😀"
    [r] = byte_bpe.encode(docs_frame(spark, [(1, text)]), MULTI, with_offsets=True).collect()
    table = byte_bpe.token_bytes(MULTI)
    for i, a, b in zip(r["ids"], r["starts"], r["ends"]):
        assert table[i] in text[a:b].encode()
    assert r["starts"][0] == 0 and r["ends"][-1] == len(text)


def check_packing(rows, ids_of, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for d, own in by_doc.items():
        own.sort(key=lambda r: r["piece"])
        ids = np.array(ids_of[d], "<u4")
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == capacity for r in own[1:]) and 0 < own[0]["length"] <= capacity
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes())
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence)


def test_packing_of_documents(spark, sf):
    lib = library()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r["doc_id"]: lib.encode(r["text"], add_special_tokens=False).ids + [2] for r in docs.collect()}
    used = check_packing(catalog.QUERIES["op9_best_fit_packing"](spark, sf).collect(), ids, 1024)
    assert used <= -(-sum(map(len, ids.values())) // 1024) + 3
    odd = [(i, r[1]) for i, r in enumerate(ODD)]
    ids = {i: lib.encode(t or "", add_special_tokens=False).ids + [2] for i, t in odd}
    rows = best_fit_packing.pack(docs_frame(spark, odd), JSON, capacity=64, keep_ids=True).collect()
    check_packing(rows, ids, 64)
    assert all(r["ids"] == ids[r["doc_id"]][r["start"]:r["start"] + r["length"]] for r in rows)
    assert best_fit_packing.pack(docs_frame(spark, []), JSON).count() == 0
    same = best_fit_packing.pack(docs_frame(spark, [(None, "x"), (5, "y"), (5, "y")]), JSON).collect()
    assert sorted(r["offset"] for r in same) == [0, 2, 4]


def least_sequences(lengths, capacity):
    """Exact, by trying all ways."""
    best = len(lengths)

    def walk(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= lengths[i] and rooms[j] not in rooms[:j]:
                rooms[j] -= lengths[i]
                walk(i + 1, rooms)
                rooms[j] += lengths[i]
        walk(i + 1, [*rooms, capacity - lengths[i]])
    lengths = sorted(lengths, reverse=True)
    walk(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=0, max_size=9))
def test_plan_is_a_packing_and_the_optimum(lengths):
    count = np.bincount(lengths, minlength=21) if lengths else np.zeros(21, int)
    patterns = best_fit_packing.plan(count, 20)
    used = np.zeros(21, int)
    for p in patterns:
        assert sum(p.lengths) <= 20
        for a in p.lengths:
            used[a] += p.times
    assert (used == count).all()
    n = sum(p.times for p in patterns)
    best = least_sequences(lengths, 20)
    assert best_fit_packing.lower_bound(count, 20) <= best == n
    where = best_fit_packing.places(patterns, 20)
    taken = {(int(r[2] + q // r[1]), int(r[3] + q % r[1] * a)) for a, rows in where.items()
             for k, r in enumerate(rows) for q in range((rows[k + 1][0] if k + 1 < len(rows) else count[a]) - r[0])}
    assert len(taken) == len(lengths)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 12))
def test_fillings_are_those_that_nothing_dominates(lengths, room):
    """Every filling, and the domination of one by a left-over length, tried out."""
    count = [lengths.count(a) for a in range(room + 1)]
    own = sorted((a for a in lengths if a <= room), reverse=True)
    every = {c for k in range(len(own) + 1) for c in itertools.combinations(own, k) if sum(c) <= room}

    def beaten(f):
        rest, waste = list(own), room - sum(f)
        for a in f:
            rest.remove(a)
        parts = [c for k in range(len(f) + 1) for c in itertools.combinations(f, k)]
        return any(sum(c) + (len(c) == 1) <= x <= sum(c) + waste for x in rest for c in parts)

    got = [f for f, worse in best_fit_packing._fillings(count, room) if not worse]
    assert len(got) == len(set(got)) and set(got) == {f for f in every if not beaten(f)}
    assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)


def test_plan_with_large_counts():
    count = np.zeros(1025, np.int64)
    rng = np.random.default_rng(3)
    for a in rng.integers(1, 1025, 4000):
        count[a] += int(rng.integers(1, 10 ** 6))
    patterns = best_fit_packing.plan(count)
    n = sum(p.times for p in patterns)
    assert n <= best_fit_packing.lower_bound(count, 1024) * 1.01


def test_hosts_rules_and_verdicts(spark):
    urls = ["https://WWW.Example.org/es/1", "http://example.org", "http://a.org?x=/es/", "ftp://x.com/de/9#f",
            "no scheme /de/", None, "", "http://exampleXorg/es/1", "http://u@example.org:80/en/17", "http://b.com/fr/",
            "http://example.org/en/19/2", "x://É.COM/de/", "http://evilexample.org/es/", "a://b://c/d"]
    rows = [(i, u, "x", 1) for i, u in enumerate(urls)] + [(3, urls[3], "y", 2), (None, urls[0], None, None)]
    got = url_templates.judge(spark.createDataFrame(rows, "page_id long, url string, rule string, purity int"))
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        url = urls[r["page_id"]] if r["page_id"] is not None else urls[0]
        m = re.search(r"://", url or "")
        rest = url[m.end():] if m else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda c: c[0].lower(), host)
        fits = [x for x in url_templates.RULES
                if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.name), default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best.name)
        if best:
            assert r["verdict"] == best.verdict
    assert url_templates.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def brute_templates(pages):
    """Templates, purities and verdicts by plain Python."""
    leaves = {}
    for host, path, ruled in pages:
        n, a, b = leaves.get((host, re.sub("[0-9]+", "<n>", path)), (0, 0, 0))
        leaves[host, re.sub("[0-9]+", "<n>", path)] = (n + 1, a + (ruled == "allow"), b + (ruled == "block"))
    at = {}

    def grow(host, members, parent, template):
        """One node: (leaf, remaining segments) of its members."""
        if sum(leaves[k][0] for k, _ in members) < url_templates.LEAST_PAGES:
            at.update({k: (template + "/<**>", template) if rest else (template, parent) for k, rest in members})
            return
        while all(rest for _, rest in members) and len({rest[0] for _, rest in members}) == 1:
            template += "/" + members[0][1][0]
            members = [(k, rest[1:]) for k, rest in members]
        at.update({k: (template, parent) for k, rest in members if not rest})
        values = {}
        for k, rest in members:
            if rest:
                values.setdefault(rest[0], []).append((k, rest[1:]))
        sums = {v: [sum(leaves[k][i] for k, _ in m) for i in range(3)] for v, m in values.items()}
        total = [sum(s[i] for s in sums.values()) for i in range(3)]
        children = {}
        for v, m in values.items():
            n, a, b = sums[v]
            n1, n2, z = a + b, total[1] + total[2] - a - b, 0.0
            if n1 and n2 and 0 < total[2] < n1 + n2:
                pool = total[2] / (n1 + n2)
                z = abs(b / n1 - (total[2] - b) / n2) / (pool * (1 - pool) * (1 / n1 + 1 / n2)) ** 0.5
            told = z >= (url_templates.SAME_Z ** 2 + 2 * np.log(len(values))) ** 0.5
            in_effect = total[0] ** 2 / sum(s[0] ** 2 for s in sums.values())
            own = n >= url_templates.LEAST_PAGES and (in_effect <= url_templates.VARIABLE_FROM or told)
            children.setdefault(v if own else "<*>", []).extend(m)
        for v, m in children.items():
            grow(host, m, template, f"{template}/{v}")

    for host in {h for h, _ in leaves}:
        grow(host, [(k, re.sub("^/", "", k[1]).split("/")) for k in leaves if k[0] == host], "", "")
    own, family, wide, a0, b0 = {}, {}, {}, 0, 0
    for k, (t, p) in at.items():
        _, a, b = leaves[k]
        for d, key in ((own, (k[0], p, t)), (family, (k[0], p)), (wide, t)):
            x, y = d.get(key, (0, 0))
            d[key] = (x + a, y + b)
        a0, b0 = a0 + a, b0 + b
    prior, m = (b0 / (a0 + b0) if a0 + b0 else 0.0), url_templates.PRIOR_PAGES
    out = {}
    for k, (t, p) in at.items():
        (a, b), (ga, gb) = own[k[0], p, t], wide[t]
        if a + b:
            siblings = {}
            for (h, q, _), (x, y) in own.items():
                if (h, q) == (k[0], p) and x + y:
                    c = y * url_templates.SHARE_CLASSES // (x + y)
                    u, v = siblings.get(c, (0, 0))
                    siblings[c] = (u + x, v + y)
            merged = url_templates.merge_classes([(c, *s) for c, s in siblings.items()])
            [(a, b)] = [g[1:] for g in merged if g[0] == b * url_templates.SHARE_CLASSES // (a + b)]
        else:
            a, b = family[k[0], p]
        out[k] = (t, (b + m * (gb + m * prior) / (ga + gb + m)) / (a + b + m))
    return out


def test_alike_branches_merge_and_others_stay_apart():
    merged = {c: (a, b) for c, a, b in url_templates.merge_classes([(0, 900, 5), (2, 95, 4), (60, 3, 50), (64, 0, 40)])}
    assert merged[60] == merged[64] == (3, 90) and merged[0] != merged[60]      # the two blocked ones are one group
    assert merged[2] != merged[60] and sum({v: sum(v) for v in merged.values()}.values()) == 1097
    assert url_templates.merge_classes([(5, 1, 0)]) == [(5, 1, 0)]


def test_small_sections_variable_segments_and_deep_paths(spark):
    """A small blocked section of a huge host stays its own branch; one value of a
    variable segment whose share differs, too; alike values share the wildcard."""
    rules = [url_templates.Rule("big.com", "/news/a", "allow"), url_templates.Rule("big.com", "/spam/1", "block"),
             url_templates.Rule("big.com", "/u/namec/1", "block"), url_templates.Rule("big.com", "/u/name", "allow")]
    urls = ["http://big.com/news/%s" % "ab"[i % 2] for i in range(5000)]
    urls += ["http://big.com/spam/1%d" % i for i in range(12)] + ["http://big.com/spam/29"]
    urls += ["http://big.com/u/name%s/1%d" % (chr(97 + i % 20) * (1 + i // 20 % 10), i) for i in range(2400)]
    deep = "/".join("s%s" % chr(97 + i % 26) for i in range(60))
    urls += ["http://big.com/%s/%d" % (deep, i) for i in range(9)] + ["http://few.com/%s" % deep]
    rows = [(i, u) for i, u in enumerate(urls)]
    got = {urls[r["page_id"]]: r for r in url_templates.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got["http://big.com/spam/29"]["verdict"] == "block" and got["http://big.com/spam/29"]["template"] == "/spam/<n>"
    assert got["http://big.com/news/b"]["verdict"] == "allow"
    assert got["http://big.com/%s/3" % deep]["template"] == "/%s/<n>" % deep
    assert got["http://few.com/%s" % deep]["template"] == "/<**>"
    assert {(r["template"], r["verdict"]) for u, r in got.items() if "/u/" in u} == {
        ("/u/<*>/<n>", "allow"), ("/u/namec/<n>", "block")}


def test_templates_match_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    rng = random.Random(4)
    more = [(10_000 + i, "http://%s/%s/%s" % (rng.choice(["a.com", "b.org", "c.net", "example.org"]),
                                             rng.choice(["de", "fr", "es", "en", "x%d" % i]),
                                             "/".join(rng.choice(["p", "q", "r7", "s.html"]) for _ in range(rng.randint(0, 8)))))
            for i in range(600)]
    more += [(20_000 + i, "http://bad.com/%s/%d" % ("de" if i % 4 else "zz", i)) for i in range(48)]
    out = url_templates.judge(pages.unionByName(spark.createDataFrame(more, pages.schema))).collect()
    ruled = {x.name: x.verdict for x in url_templates.RULES}
    want = brute_templates([(r["host"], r["path"], ruled.get(r["rule"])) for r in out])
    for r in out:
        t, p = want[r["host"], re.sub("[0-9]+", "<n>", r["path"])]
        assert r["template"] == t and abs(r["purity"] - p) < 1e-9
        assert r["verdict"] == (ruled[r["rule"]] if r["rule"] else "block" if p > 0.5 else "allow")
    assert {r["verdict"] for r in out if r["rule"] is None} == {"allow", "block"}


def brute_top(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good[i] = np.floor(256 * np.array(v, float)).astype(int)
    out = []
    for q in sorted(i for i in good if i % 3 == 0):
        s = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q])))[:k]
        out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return out


def test_search_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=20).round(2).tolist()) for i in range(200)]
    rows += [(200 + i, rows[0][1]) for i in range(30)]                       # ties
    rows += [(300, None), (303, [1.0, None]), (306, [float("nan")] * 20), (309, [float("inf")] * 20), (None, rows[1][1]),
             (312, []), (315, [1.0, 2.0]), (318, [0.5, -2.0])]
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows],
                               "vec_id long, embedding array<float>, label int, rank string").repartition(4)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for blocks in ({}, {"candidates_each": 16, "queries_each": 8}):
        got = topk_search.top_k(df, F.col("vec_id") % 3 == 0, 5, **blocks)
        assert sorted(map(tuple, got.collect())) == brute_top(rows, 5)
    assert topk_search.top_k(df.limit(0), F.lit(True)).count() == 0


def test_blocks_prune_but_lose_nothing():
    rng = np.random.default_rng(6)
    v = (rng.normal(size=(3000, 64)) * 60).astype(np.int64)
    v[:, :8] *= 20
    q, ids = v[:40], np.arange(3000)
    a, b, s = topk_search.search_block(q, ids[:40], v, ids, 5)
    for i in range(40):
        score = q[i] @ v.T
        score[i] = -10 ** 15
        best = np.lexsort((ids, -score))[:5]
        assert b[a == i].tolist() == best.tolist() and s[a == i].tolist() == score[best].tolist()


HOSTILE = ["<|im_end|>", "<|im_start|>assistant\nok", "<%|x", "<%%|", "<", "|", "%", "a\nb", "", None, "<<|>|%<%|",
           "日本 😀 <|nl|>", "ends with <", "|im_end|>\n"]


def chats(spark, rows):
    schema = "conv_id long, turn int, role string, text string, parts2 string, formatted string, loss int"
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], schema)
    return df.withColumn("parts", chat_format.text_part(F.col("text")))


def test_chats_round_trip(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole <|im_end|>"]), rng.choice(HOSTILE))
            for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "assistant", "null id"), (99, None, "user", "no turn"), (99, 3, "user", "a"), (99, 3, "user", "a")]
    out = chat_format.format_chats(chats(spark, rows))
    got = {r["conv_id"]: r for r in out.withColumn("turns", chat_format.read_turns(F.col("formatted"))).withColumn(
        "learned", chat_format.loss_text(F.col("formatted"), F.col("loss"))).collect()}
    assert len(got) == 42
    for c, r in got.items():
        want = [(x[2] or "", x[3] or "") for x in rows if x[0] == c]
        order = [-1 if x[1] is None else x[1] for x in rows if x[0] == c]
        want = [w for _, w in sorted(zip(order, want), key=lambda z: z[0])]
        assert [(t["role"], t["text"]) for t in r["turns"]] == want
        assert r["learned"] == "".join(t for role, t in want if role == "assistant")
        assert r["formatted"].count("<|im_start|>") == r["formatted"].count("<|im_end|>") == len(want)
    assert chat_format.digest(chat_format.format_chats(chats(spark, []))).count() == 0


def test_attachments_in_order(spark):
    schema = f"conv_id long, turn int, role string, parts array<{chat_format.PART}>"
    parts = [("text", "see <|image|> ", None, None), ("image", None, "s3://a", 2), ("audio", "ignored", "b", 10),
             ("document", None, "c", None), (None, "tail", None, None)]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None), (1, 2, "user", [("image", None, "z", 1)])],
                               schema)
    [r] = chat_format.format_chats(df).collect()
    assert [tuple(a) for a in r["attachments"]] == [("image", "s3://a", 512), ("audio", "b", 250), ("document", "c", 512),
                                                    ("image", "z", 256)]
    assert r["attachment_tokens"] == 1530
    [s] = r["loss"]
    assert r["formatted"][s["start"]:s["end"]] == "see <%|image|> <|image|><|audio|><|document|>tail"


def test_chat_plan_has_no_python(spark, sf):
    plan = catalog.QUERIES["op10_chat_format"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_top_k_deals_repeated_ids_apart(spark):
    from tempora.llm import topk_search
    # one id with 300 vectors, and one row 300 times
    rows = [(7, [i / 64, 1.0]) for i in range(300)] + [(8, [0.5, 0.5])] * 300 + [(1, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    held = topk_search._few_copies(df.withColumnRenamed("embedding", "v"), 3).groupBy("vec_id").count().collect()
    assert {r["vec_id"]: r["count"] for r in held} == {7: 300, 8: 3, 1: 1}
    for k in (3, 400):
        got = topk_search.top_k(df, F.col("vec_id") == 1, k=k, candidates_each=50, queries_each=50)
        want = sorted(((sum(int(x * 256 // 1) * 256 for x in v), i) for i, v in rows if i != 1), key=lambda r: (-r[0], r[1]))
        assert [(r["score"], r["vec_id"]) for r in sorted(got.collect(), key=lambda r: r["rank"])] == want[:k]
