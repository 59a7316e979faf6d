"""Operators 3, 5 and 7: statistics against brute force, models by accuracy."""

import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tempora.llm import catalog, gbt, language_id, quality_rules, toxicity
from tempora.llm.chars import decode
from tempora.llm.frames import fold_of, marked_ids

from llm_cases import ODD, docs_frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i:i + 8]), []).append(i)
    hit = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit),
            n < 20 or 100 * len(hit) > 30 * n)


TEXTS = ["a b # c\na b # c\n\n \na b", "x " * 50, "one|two$ <é> \x0b y", ("q w e r t y u i o p " * 3 + "z ") * 2, "\n\n",
         "long line " + "ü" * 100 + "\nlong line " + "ü" * 100]


def test_base_counts_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = ODD + [(100 + i, t) for i, t in enumerate(TEXTS)]
    trees = gbt.fit(np.zeros((0, 10)), np.zeros(0), quality_rules.MONOTONE)
    trees.base = 0.0
    for df in (docs, docs_frame(spark, odd)):
        got = quality_rules.judge(df, trees).collect()
        want = sorted((brute_base(r["text"]) + (-1 if r["doc_id"] is None else r["doc_id"],)
                       for r in df.collect()), key=lambda r: (r[-1], r))
        mine = sorted(((*[r[c] for c in quality_rules.BASE], r["base_failed"],
                        -1 if r["doc_id"] is None else r["doc_id"]) for r in got), key=lambda r: (r[-1], r))
        assert mine == want
        assert all(r["kept"] == (not r["base_failed"]) for r in got)


def test_quality_verdicts(spark, sf):
    out = catalog.QUERIES["op3_quality_rules"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", (F.col("quality") == 1).alias("good"))
    got = out.join(labels, "doc_id").select("kept", "good").collect()
    assert np.mean([r["kept"] == r["good"] for r in got]) > 0.95


def test_trees_respect_constraints_and_scores():
    rng = np.random.default_rng(1)
    x = rng.random((1500, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) + x[:, 1] ** 2 + 0.2 * rng.normal(size=1500) > 0.9).astype(float)
    trees = gbt.fit(x, y, [1, 0, -1])
    s = trees.score(x)
    assert ((s > 0) == y).mean() > 0.9

    def walk(row):
        total = trees.base
        for at in trees.root:
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.feature[at]] <= trees.cut[at] else trees.right[at]
            total += trees.value[at]
        return total
    assert np.allclose([walk(r) for r in x[:50]], s[:50])
    grid = np.repeat(rng.random((20, 3)), 60, axis=0)
    for j, sign in ((0, 1), (2, -1)):
        g = grid.copy()
        g[:, j] = np.tile(np.linspace(0, 1, 60), 20)
        steps = np.diff(trees.score(g).reshape(20, 60), axis=1)
        assert (sign * steps >= -1e-9).all()


def test_quality_without_labels(spark):
    df = docs_frame(spark, ODD)
    marks = spark.createDataFrame([], "doc_id long, quality int")
    trees = quality_rules.fit(df, marks)
    assert all(r["kept"] == (not r["base_failed"]) for r in quality_rules.judge(df, trees).collect())
    assert quality_rules.judge(docs_frame(spark, []), trees).count() == 0


def test_folding_and_exceptions():
    lex = toxicity.Lexicon({" loser ": 2.0, " scum": 3.0}, [" sore loser "], (0.0, 1.0, 1.0))
    find = toxicity.automaton(lex)
    fold = lambda t: toxicity.fold(decode(pa.array([t])))[0][0]
    total = lambda t: sum(w for _, _, w in toxicity.hits(find, fold(t)))
    assert total("a L0ser!") == 2 and total("lоser") == 2 and total("ＬＯＳＥＲ") == 2 and total("ЅCUMmy $cum") == 6
    assert total("closer losers obscum") == 0 and total("a sore loser") == 0 and total("loser loser") == 4
    assert total("") == 0 and total("5 0 1") == 0
    m = toxicity.measures(find, pa.array([None, "", "scum", "scum " + "word " * 500]))
    assert m[0].tolist() == [0, 0] and m[1].tolist() == [0, 0] and m[2, 1] > m[3, 1] > 0


def test_toxicity_held_out(spark, sf):
    got = (catalog.QUERIES["op5_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
           .filter("held_out").collect())
    assert len(got) > 50
    assert not [r for r in got if r["predicted"] and not r["toxic"]]
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)


def test_toxicity_edges(spark):
    df = docs_frame(spark, ODD)
    none = toxicity.fit(df, spark.createDataFrame([(1, 1), (None, 0), (4, None)], "doc_id long, toxic int"))
    out = toxicity.score(df, none, "toxic_score")
    assert out.columns == [*df.columns, "toxic_score"] and max(r["toxic_score"] for r in out.collect()) < 0.01
    assert toxicity.score(docs_frame(spark, []), none).count() == 0


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = catalog.QUERIES["op7_language_id"](spark, sf).join(docs, "doc_id").filter("held_out").collect()
    assert len(got) > 100 and np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(language_id.training_rows(docs, fold_of(F.col("doc_id"), 4) == 2), per_lang=60)
    odd = docs_frame(spark, ODD + [(20, "123 ... !!"), (21, None)])
    got = {r["doc_id"]: r for r in language_id.predict(odd, model, "l", "p").collect()}
    assert got[1]["l"] == got[2]["l"] == got[3]["l"] == got[20]["l"] == got[21]["l"] == "und"
    assert got[20]["p"] == 0.0 and got[4]["l"] in model.classes
    empty = language_id.fit(docs_frame(spark, []).select("doc_id", "text", "lang"))
    assert {r["l"] for r in language_id.predict(odd, empty, "l", "p").collect()} == {"und"}
    assert language_id.predict(docs_frame(spark, []), model, "l", "p").count() == 0


def test_features_do_not_depend_on_neighbours():
    texts = pa.array(["abc def", "", None, "Ünï code", "x"])
    bins, at, size, _ = language_id.grams(decode(texts))
    for i in range(5):
        b, a, s, _ = language_id.grams(decode(texts.slice(i, 1)))
        assert bins[at[i]:max(at[i], at[i + 1] - 2)].tolist() == b[:max(0, a[1] - 2)].tolist() and size[i] == s[0]


def test_calibration_lowers_loss():
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 3, 400)
    scores = rng.normal(size=(400, 3)) * 6
    scores[np.arange(400), truth] += 4
    assert language_id.calibrate(scores, truth) > 1.5


@pytest.mark.parametrize("y", [np.zeros(5), np.ones(5)])
def test_one_label_gives_no_trees(y):
    assert len(gbt.fit(np.random.default_rng(0).random((5, 2)), y, [0, 0]).root) == 0


def test_fold_takes_whole_runs_of_substitutes():
    fold = lambda *t: toxicity.fold(decode(pa.array(t)))[0]
    assert fold("x3110 bo55 cla$$ 455word") == ["xeiio boss class assword"]
    assert fold("l00ser $$cum a5$et 7op la7 @t") == ["looser sscum asset top lat at"]
    assert fold("word! word!! 123 $5 a1!")[0].split() == ["word", "word", "ai"]
    assert fold("a", "11", "b") == ["a", "  ", "b"] and fold("", "5a", None, "a5") == ["", "sa", "", "as"]


def test_marked_ids_of_hot_and_conflicting_rows(spark):
    rows = [(7, 1)] * 5_000 + [(i, i % 2) for i in range(20, 9_000)] + [(1, 0), (1, 1), (None, 1), (2, None), (3, 5)]
    labels = spark.createDataFrame(rows, "doc_id long, mark int").repartition(6)
    got = [tuple(r) for r in marked_ids(labels, "mark", {0: 400, 1: 100}, "x").collect()]
    assert sum(m == 0 for _, m in got) == 400 and sum(m == 1 for _, m in got) == 100 and len(set(got)) == 500
    assert got and sorted(got) == sorted(tuple(r) for r in marked_ids(labels.repartition(3), "mark", {0: 400, 1: 100}, "x").collect())
    every = dict(tuple(r) for r in marked_ids(labels, "mark", {0: 10_000, 1: 10_000}, "x").collect())
    assert every[1] == 0 and every[7] == 1 and not {2, 3, None} & set(every)
    plan = marked_ids(labels, "mark", {0: 400, 1: 100}, "x")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_one_id_on_a_third_of_the_rows_trains_once(spark):
    good, bad = "a fine long text of many words that says something new each time " * 3, "## || buy $$ now & win %% " * 9
    docs = [(i, f"{good} {i}" if i % 2 else f"{bad} {i}") for i in range(60)]
    hot = [(1, f"{good} copy {k}") for k in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 1)] * 40, "doc_id long, quality int")
    a = quality_rules.fit(docs_frame(spark, docs + hot), labels)
    b = quality_rules.fit(docs_frame(spark, docs[:1] + [min(hot + docs[1:2], key=lambda r: r[1])] + docs[2:]), labels)
    assert a.base == b.base and np.array_equal(a.root, b.root)
    lang = [(i, f"{good} {i}", "en") for i in range(20)] + [(100 + i, f"das ist ein ganz anderer text {i} " * 4, "de") for i in range(20)]
    model = language_id.fit(docs_frame(spark, lang + [(0, f"{good} again {k}", "en") for k in range(400)]))
    assert model.classes == ["de", "en"]


def brute_hits(lexicon, folded):
    line = " " + folded + " "
    at = lambda t: [i for i in range(len(line)) if line.startswith(t, i)]
    spared = [(i, i + len(p)) for p in lexicon.exceptions if p not in lexicon.weights for i in at(p)]
    found = {}
    for t, w in lexicon.weights.items():
        for i in at(t):
            if i not in found or found[i][1] < w:
                found[i] = (i + len(t), w)
    return [(s, e, w) for s, (e, w) in sorted(found.items()) if not any(a <= s and e <= b for a, b in spared)]


def test_lexicon_matching_and_score_by_brute_force(spark):
    rng = np.random.default_rng(3)
    lexicon = toxicity.Lexicon({" ab ": 1.0, " abc": 2.5, " c": 0.5, " ab": 0.25}, [" c ab ", " ab ab ", " d c ", " ab "], (-2.0, 1.5, 0.25))
    find = toxicity.automaton(lexicon)
    texts = [" ".join(rng.choice(["ab", "abc", "abcd", "c", "d", "e"], 30)) for _ in range(200)] + ["", "ab", "c ab"]
    for t in texts:
        assert sorted(toxicity.hits(find, t)) == brute_hits(lexicon, t), t
    got = toxicity.score(docs_frame(spark, list(enumerate(texts))).drop("score"), lexicon).collect()
    for r in got:
        total = sum(w for _, _, w in brute_hits(lexicon, texts[r["doc_id"]]))
        words = max(1, len(texts[r["doc_id"]].split()))
        odds = -2.0 + 1.5 * np.log1p(total) + 0.25 * np.log1p(1000 * total / words)
        assert abs(r["score"] - 1 / (1 + np.exp(-odds))) < 1e-9


def test_many_hits_and_exceptions_take_one_pass():
    lexicon = toxicity.Lexicon({" bad ": 1.0, " wor": 1.0}, [" bad word ", " very bad "], (0.0, 1.0, 1.0))
    find, line = toxicity.automaton(lexicon), "bad word very bad bad " * 100_000
    began = time.time()
    got = toxicity.hits(find, line)
    list(toxicity.neighbours(" " + line + " ", [s for s, _, _ in got]))
    assert len(got) >= 100_000 and time.time() - began < 4


def test_neighbours_match_splitting():
    line = "  one two  three four "
    for at in (1, 2, 3, 5, 6, 9, 10, 16, 17):
        left, right = line[:at].split(), line[at:].split()
        assert list(toxicity.neighbours(line, [at])) == [(left[-1] if left else None, right[0], right[1] if len(right) > 1 else None)]


def test_language_score_is_the_plain_formula(spark, sf):
    model = language_id.LanguageModel(["x", "y"], np.random.default_rng(1).normal(size=(language_id.BINS, 2)).astype(np.float32),
                                      np.array([0.1, -0.2]), 1.7)
    texts = ["Ein kurzer Satz.", "a", "déjà vu " * 50]
    for text in texts:
        bins, at, size, _ = language_id.grams(decode(pa.array([text])))
        s = np.zeros(2)
        for b in bins[at[0]:max(at[0], at[1] - 2)].ravel().tolist():
            s += model.table[b].astype(float) / max(1, size[0])
        p = np.exp((s + model.bias) / 1.7)
        [best], [score] = language_id.score_batch(model, pa.array([text]))
        assert best == "xy"[int(p.argmax())] and abs(score - p.max() / p.sum()) < 1e-9
