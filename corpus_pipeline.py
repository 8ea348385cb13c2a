"""From raw documents to packed training sequences. Each stage works on all that the one before it kept.

Null texts go at the first stage, which finds no letters in them; null values of other columns pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.llm import jaccard_join, language, mixing, packing, pii
from framesift.llm.common import cut, parts, table, whole

LEAST_LANGUAGE_SCORE = 0.5
#: Pieces whose ids a worker keeps: fewer than for packing alone, as workers live on through all stages.
KEPT_PIECES = 400_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which some language has a share of half or more."""
    model = language.learn(spark, docs)
    scored = language.predict(spark, docs.select(whole(docs), "text"), *model, "doc")
    kept = scored.where((F.col("lang_pred") != language.UND) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(*parts(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return jaccard_join.one_of_each(spark, docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    return pii.redact(docs, pii.accepted(docs)).withColumn("n_chars", F.length("text").cast("long"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their slot and place in the mixture; files and their rows follow them, but readers may not."""
    mixed = mixing.mix(docs)
    return mixed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select(*docs.columns, "slot", "place")


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 1024 ids. Each task packs a range of the mixture's slots, and sequences are numbered in their order."""
    import public_tokenizers

    docs = docs.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place")
    return packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), kept=KEPT_PIECES)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]
#: The stages hold trained models, which SQL can't express; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
