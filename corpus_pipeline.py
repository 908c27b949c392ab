"""From raw documents to sharded training data: five stages, each one numbered operator.

A stage takes (spark, docs, sf_dir) and returns what it keeps of ``docs`` with the
columns of ``documents``; the last one adds where each document goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cratewise.llm import decontam, jaccard, mixture, quality, queries, shards
from cratewise.plans.guards import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _as_notes(docs: DataFrame) -> DataFrame:
    return docs.withColumnsRenamed({"doc_id": "hash", "text": "note"})


def _as_documents(notes: DataFrame) -> DataFrame:
    return notes.withColumnsRenamed({"hash": "doc_id", "note": "text"}).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go (operator 1); it learns from their labels."""
    texts = _as_notes(docs)
    forest = quality.train_quality(texts, queries.grades(spark, sf_dir))
    return _as_documents(quality.graded_notes(texts, forest).where("predicted = 1"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-equal group stays, that of smallest doc_id (operator 7)."""
    return _as_documents(jaccard.distinct_notes(_as_notes(docs)))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go (operator 4)."""
    items = queries.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), "text")
    return _as_documents(decontam.clean_notes(_as_notes(docs), items, action="document"))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn to the target weights, each at most once (operator 6)."""
    tracks = _as_notes(docs).withColumn("domain", queries.domain_of("source"))
    drawn = mixture.mixed(tracks, queries.LEVELS, queries.WEIGHTS, share=0.9, epochs=1)
    return _as_documents(mixture.taken(drawn))


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its shard and place (operator 3)."""
    tracks = docs.select(F.col("doc_id").alias("hash"), F.col("text").alias("payload"))
    return shards.shard_tracks(tracks, shards=24).select(
        F.col("hash").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixture", mixture_stage),
    ("sharding", sharding_stage),
]

#: SQL cannot train the classifier; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again by the next."""
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
