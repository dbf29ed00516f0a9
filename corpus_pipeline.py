"""The corpus pipeline: language ID, quality classifier, near-duplicate removal, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and works on all that its predecessor kept.
All but the last return the columns of documents, each with the values it came with: what a stage adds for itself has a
name that no column of the table has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import cotraining, language_id, minhash, packing
from barloom.llm.common import materialize, scratch_path, scratch_scope, unused

#: SQL can't express trained models and sketches; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters and is in a language that the calibrated model knows. Repeated rows stay."""
    to = unused(docs, "language")
    found = language_id.identify(docs, language_id.train(docs, F.lit(True)), to)
    return found.where(F.col(f"{to}.lang_accepted")).drop(to)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that both views together don't reject. Repeated rows stay."""
    to = unused(docs, "quality")
    found = cotraining.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), to)
    return found.where(F.col(f"{to}.accepted")).drop(to)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicate texts: that of the smallest doc_id (nulls last).

    Each row is a document of its own, so texts that share a doc_id stay apart, and copies with null ids go like others;
    of rows that share id and component the one of the smallest hash of its text stays, then the first one of the table.
    Rows without words are no copies of each other and stay.
    """
    row = unused(docs, "row")
    keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    found_at = scratch_path(spark, "components")
    with scratch_scope(spark):
        found = minhash.near_duplicates(keyed.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
        found = materialize(found, "components", found_at)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), row)
    ranked = keyed.select(row, order.alias("order")).join(found, row)
    kept = ranked.groupBy("component_id").agg(F.min("order").alias("first")).select(F.col(f"first.{row}").alias(row))
    gone = materialize(found.join(kept, row, "left_anti").select(row), "copies")  # broadcast if the table is small
    return keyed.join(gone, row, "left_anti").drop(row)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 token ids: their ids (16-bit, little-endian), the doc_ids in them, and each piece's place."""
    import public_tokenizers

    pieces, placed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.sequences(pieces, placed)


STAGES = [("language_id", identify_language), ("quality_classifier", classify_quality), ("minhash_near_dedup", drop_near_duplicates), ("best_fit_packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
