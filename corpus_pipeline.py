"""A corpus pipeline of five stages over documents; each one's result is written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import common, decontam, langid, minhash, packing, pii, queries

#: A language predicted with less than this is not one; clean texts of a few words stay well above it.
MIN_LANGUAGE_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; learns from those with a lang."""
    model = langid.fit(docs, learn=F.coalesce(langid.id_remainder("doc_id", 4) != 2, F.lit(False)))
    name, score = common.fresh(docs.columns, "lang_pred"), common.fresh(docs.columns, "score")
    found = langid.predict(docs, model, lang_name=name, score_name=score)
    return found.where((F.col(name) != langid.UNKNOWN) & (F.col(score) >= MIN_LANGUAGE_SCORE)).drop(name, score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of a 5-word Jaccard of 0.8 or more join."""
    return minhash.keep_one(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.drop_matching(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars follows the new text."""
    out = pii.pseudonymise(docs, queries.pii_key(spark), found_col=None)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [("language", language), ("simhash", near_duplicates), ("decontamination", benchmark_free), ("pii", private), ("packing", packed)]

#: No SQL expresses the classifier, the alignment or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
