"""From raw documents to segmented training texts, in five stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtide.llm import decontaminate, langid, nbest, near_dup, quality
from voxtide.llm.common import free_name
from voxtide.llm.queries import KEEP_TAIL, quality_model
from voxtide.session import apply_settings, materialize

WORDS = 5  # in a shingle of the near-duplicate stage; op4's own contract says four


def language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language can be told; a missing `lang` is filled in.

    Null texts and texts without a letter go.
    """
    name = free_name(docs.columns, "language")
    predicted = F.col(name)["lang_pred"]
    told = langid.predict_language(docs, langid.learn(docs), column=name).where(predicted != langid.UNKNOWN)
    return told.withColumn("lang", F.coalesce("lang", predicted)).select(*docs.columns)


def classifier(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that are probably of the best grade; toxic ones and those of low quality go."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    name = free_name(docs.columns, "grading")
    graded = quality.grade_texts(docs, quality_model(docs, labels), column=name)
    return graded.where(F.col(name)["tail"] >= KEEP_TAIL).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-duplicates (80 % of their five-word shingles), and one row of those
    that repeat an id and a text."""
    return near_dup.keep_one(docs, shingle=WORDS)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents of which less than a twentieth stands in the benchmark, as they are."""
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def segmentation(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of each text, and the scores of its best segmentations."""
    return nbest.encode_n_best(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id", "lang", "source"))


STAGES = [
    ("language", language), ("classifier", classifier), ("near_dedup", near_dedup), ("decontamination", decontamination),
    ("segmentation", segmentation),
]

#: A fitted classifier and an automaton decide which rows stay, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    apply_settings(spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, folder), name)
    return docs
