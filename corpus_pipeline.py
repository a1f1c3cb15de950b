"""From raw documents to packed sequences: five stages, each written and read again before the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierglass.llm import packing, quality_classifier, quality_rules, simhash, substring_dedup
from tierglass.llm.common import cut, is_remainder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; columns as they come."""
    docs = docs.select(*COLUMNS)
    labels = quality_classifier.training_labels(table(spark, sf_dir, "labels"))
    kept = quality_classifier.score(docs, quality_classifier.fit(docs, labels)).where("predicted = 1")
    return kept.select(*COLUMNS)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cutoffs that labels justify.

    These are the labels that the classifier before did not learn from.
    """
    held_out = table(spark, sf_dir, "labels").where(is_remainder(F.col("doc_id"), 4, 2))
    return quality_rules.filter_documents(docs.select(*COLUMNS), held_out)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest doc_id.

    Rows of one doc_id count as one document, of which the row with the least text stays. Where no row
    of a group has a doc_id, one row of each text stays.
    """
    docs = docs.select(*COLUMNS)
    found = simhash.near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = cut(found.groupBy("doc_id").agg(F.count("*").alias("rows")))
    kept = docs.join(keep.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    if keep.where("rows > 1").isEmpty():
        return kept
    own = F.when(F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))
    return (
        kept.withColumn("_own", own)
        .groupBy("doc_id", "_own")
        .agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("_row"))
        .select("doc_id", "_row.*")
    )


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones have; untouched texts keep their white space."""
    kept = substring_dedup.remove_repeats(docs.select(*COLUMNS), carry=("text", "lang", "source", "n_chars"))
    changed = F.col("n_removed") > 0
    return kept.select(
        "doc_id",
        F.when(changed, F.col("kept_text")).otherwise(F.col("text")).alias("text"),
        "lang",
        "source",
        F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document that is left."""
    packed = packing.pack(packing.pieces(docs))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", classify_quality),
    ("quality_rules", apply_rules),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_passages),
    ("best_fit_packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    What a stage read is deleted once its own result is written; the last result stays, as rows are read from it.
    """
    from tierglass.session import shared_folder
    from tierglass.sources.files import delete

    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
