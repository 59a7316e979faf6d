"""The document pipeline, stage by stage, each on its own input."""

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from test_dedup import brute_components, brute_print, brute_substring
from test_tokens_chats_search import check_packing


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], sf).write.parquet(f"{tmp_path}/{i}")
        seen.append(spark.read.parquet(f"{tmp_path}/{i}"))
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language ID", "toxicity", "near duplicates", "substring dedup", "packing"]
    assert all(s.columns == docs.columns for s in seen[:-1])
    rows = [{r["doc_id"]: r for r in s.collect()} for s in seen[:-1]]

    # documents with letters in a known language stay
    assert len(rows[1]) >= 0.99 * len(rows[0]) and set(rows[1]) <= set(rows[0])
    # of the labelled documents no clean one goes, and most toxic ones do (34
    # labelled toxic documents are too few to learn the rarer languages' stems)
    gone = set(rows[1]) - set(rows[2])
    assert not [i for i in gone if labels.get(i) == 0]
    toxic = [i for i in rows[1] if labels.get(i) == 1]
    assert sum(i in gone for i in toxic) >= 0.6 * len(toxic)
    # one document of each group, the smallest id
    label = brute_components({i: brute_print(r["text"]) for i, r in rows[2].items()})
    assert set(rows[3]) == set(label.values())
    assert all(rows[3][i] == rows[2][i] for i in rows[3])
    # passages are cut, documents stay
    want = {r[0]: r for r in brute_substring([(i, r["text"]) for i, r in rows[3].items()])}
    assert set(rows[4]) == set(rows[3])
    for i, r in rows[4].items():
        n, removed = want[i][1], want[i][2]
        assert len(r["text"].encode().split()) == n - removed and r["n_chars"] == len(r["text"])
        if not removed:
            assert r["text"] == rows[3][i]["text"]
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    ids = {i: lib.encode(r["text"], add_special_tokens=False).ids + [2] for i, r in rows[4].items()}
    used = check_packing(seen[-1].collect(), ids, 1024)
    assert used <= -(-sum(map(len, ids.values())) // 1024) + 3


def test_pipeline_drops_what_has_no_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.limit(1).select(
        F.explode(F.array(F.lit(None).cast("string"), F.lit(""), F.lit("12 345 !!"))).alias("text"), *[
            c for c in docs.columns if c not in ("text", "doc_id")]).withColumn("doc_id", F.lit(-5).cast("long"))
    out = corpus_pipeline.language_stage(spark, docs.unionByName(odd.select(docs.columns)), sf)
    assert out.filter("doc_id = -5").count() == 0 and out.columns == docs.columns
