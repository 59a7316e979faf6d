"""Operator 13: rules against the plain patterns, message passing against
enumeration, and what the field adds."""

import hashlib
import itertools
import re
import time

import numpy as np
import pytest

from tempora.llm import catalog, private_data as P

from llm_cases import ODD, docs_frame


def brute_spans(text):
    digits = lambda s: [int(c) for c in s if c in "0123456789"]

    def luhn(d):
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0
    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15)}
    return [(k, *m.span()) for k, (p, ok) in tests.items() for m in re.finditer(p, text) if ok(m[0])]


ODD_TEXTS = ["a@b.c@d.e f@g", "a@b.c_x@d.e", "x@y..z a@b.c. @p.q", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.1 0001.2.3.4",
             "4111 1111 1111 1111-2 4111-1111-1111-1111 4111111111111111", "+1 (663) 555-6869 +1+2 345 6789 +123",
             "٣٤٥ é@ü.x a.b%c+d@e-f.g-h", "+1 4111111111111111", "@@ a@@b.c", "\n1.1.1.1\x0b2.2.2.2", "5 " * 30]


def test_rules_match_the_patterns(spark, sf):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ODD_TEXTS
    rng = np.random.default_rng(5)
    texts += ["".join(rng.choice(list("01 9.-+()@ab\n,"), 60)) for _ in range(3000)]
    for t in texts:
        assert P.base_spans(t) == brute_spans(t), t


def test_rules_are_linear():
    for t in ("x" * 300_000, "x" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1 " * 100_000,
              "+1" + " " * 300_000, "@" * 300_000, "é1" * 150_000):
        began = time.time()
        g = P.Graph()
        g.add(0, t, P.base_spans(t))
        assert time.time() - began < 5, t[:9]


def test_messages_match_enumeration_on_a_tree():
    rng = np.random.default_rng(2)
    unary, pots = rng.normal(size=(5, 3)), rng.normal(size=(2, 3, 3))
    edges, kind = np.array([(0, 1), (1, 2), (1, 3), (0, 4)]), np.array([0, 1, 0, 1])
    total = np.zeros((5, 3))
    for y in itertools.product(range(3), repeat=5):
        w = np.exp(sum(unary[i, y[i]] for i in range(5)) + sum(pots[k][y[a], y[b]] for (a, b), k in zip(edges, kind)))
        for i in range(5):
            total[i, y[i]] += w
    got = np.exp(P.marginals(unary, edges, kind, pots, rounds=60))
    assert np.allclose(got, total / total.sum(axis=1, keepdims=True), atol=1e-6)


@pytest.fixture(scope="module")
def model(spark, sf):
    return P.fit(spark.read.parquet(f"{sf}/documents.parquet"))


def spans(spark, model, *texts):
    rows = P.find(docs_frame(spark, list(enumerate(texts))), model).orderBy("doc_id").collect()
    return [[(k, texts[i][int(a):int(b)]) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
            for i, r in enumerate(rows)]


def test_distant_repeats_take_the_label(spark, model):
    filler = "plain words without any number here " * 40
    text = f"call +1 (663) 555-6869 now {filler} or again (663) 555-6869 please"
    alone = f"the year 1999 had 365 days and room 12 {filler}"
    got = spans(spark, model, text, alone, "write to jo@ex.org " + filler + " jo@ex.org")
    assert got[0] == [("phone", "+1 (663) 555-6869"), ("phone", "(663) 555-6869")]
    assert got[1] == [] and got[2] == [("email", "jo@ex.org")] * 2
    # without the rule span there is nothing to repeat, and no skip potential keeps the second one out
    assert spans(spark, model, text.replace("+1 ", ""))[0] in ([], [("phone", "(663) 555-6869")] * 2)
    off = P.Field(model.unary, model.chain, np.zeros_like(model.skip))
    with_, without = (np.exp(P.label(g, f)) for f in (model, off) for g in [_graph(text)])
    assert (with_[-2:, 3] > without[-2:, 3]).all()


def _graph(text):
    g = P.Graph()
    g.add(0, text, P.base_spans(text))
    return g


def test_whole_table(spark, sf, model):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    more = clean = 0
    for r in catalog.QUERIES["op13_private_data"](spark, sf).collect():
        text = docs[r["doc_id"]]
        base = brute_spans(text)
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(s[0] == k for s in base) for k in P.KINDS]
        own = set(r["spans"].split(",")) - {""}
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= own
        more += len(own) - len(base)
        clean += not re.search("[0-9@]", text) and bool(own)
    assert clean == 0 and more <= 20


def test_odd_rows(spark, model):
    rows = ODD + [(70 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(90, "7" * 20_000 + " 7 a@ " * 9_000)]
    got = P.find(docs_frame(spark, rows), model).collect()
    assert len(got) == len(rows)
    empty = [r for r in got if r["doc_id"] in (1, 2, 3)]
    assert all(r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in empty) and len(empty) == 3
    none = docs_frame(spark, rows).limit(0)
    assert P.find(none, model).count() == 0
    assert spans(spark, P.fit(none), "call +1 (663) 555-6869 or 12")[0] == [("phone", "+1 (663) 555-6869")]


def test_fit_does_not_follow_partitions_or_hot_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    hot = docs.limit(1).crossJoin(spark.range(500)).select("doc_id", "text")
    a, b = P.fit(docs, 200), P.fit(docs.repartition(7).unionByName(docs.limit(0)), 200)
    assert np.array_equal(a.unary, b.unary) and np.array_equal(a.skip, b.skip)
    assert P.fit(docs.unionByName(hot), 200).unary.shape == a.unary.shape
