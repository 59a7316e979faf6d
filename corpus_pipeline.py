"""Document pipeline over the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller
writes it as Parquet and hands the reread table to the next.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import best_fit_packing, language_id, simhash_dedup, substring_dedup, toxicity
from tempora.llm.catalog import language_model, table, toxic_lexicon, vocabulary
from tempora.llm.frames import fresh, written

#: Least calibrated probability of the predicted language.
LEAST_LANGUAGE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or without a clear language."""
    lang, score = fresh(docs, "lang_pred", "lang_score")
    told = language_id.predict(docs, language_model(docs), lang, score)
    return told.filter((F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE)).drop(lang, score)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic."""
    [score] = fresh(docs, "toxic_score")
    lexicon = toxic_lexicon(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, lexicon, score).filter(F.col(score) < toxicity.THRESHOLD).drop(score)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of every SimHash component."""
    return simhash_dedup.keep_first(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a document with a smaller id has; ``n_chars`` follows."""
    cut = substring_dedup.remove_repeats(docs)
    if "n_chars" in cut.columns:
        kind = cut.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(kind))
    return cut


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences."""
    return best_fit_packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language_stage),
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("packing", packing_stage),
]

#: Fingerprints, models and packing are not SQL; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
