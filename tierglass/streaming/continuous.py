"""Continuous classification, running feedback statistics and recalibration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from tierglass.operators.feedback import recalibrate, statistics_columns
from tierglass.operators.fusion import classify
from tierglass.schema import DOCUMENTS
from tierglass.sources import files


def arriving(
    spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000
) -> DataFrame:
    """Parquet files as they are added to a folder."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


def _start(writer: DataStreamWriter, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def classify_stream(
    spark: SparkSession,
    path: str,
    sink: str,
    checkpoint: str,
    schema: StructType = DOCUMENTS,
    files_per_batch: int = 1000,
    once: bool = False,
    **options,
) -> StreamingQuery:
    """Classify arriving documents; the plan is the batch plan and keeps no state."""
    results = classify(arriving(spark, path, schema, files_per_batch), **options)
    writer = results.writeStream.format("parquet").option("path", sink).outputMode("append")
    return _start(writer, checkpoint, once)


#: Micro-batches of a query whose statistics are kept, so that a reader finds what it has planned to read.
SLOTS = 4
STATISTICS = (
    "label string, total long, overrides long, avg_quality double, query string, batch long, written timestamp"
)


def running_statistics(feedback: DataFrame, records: DataFrame) -> DataFrame:
    """Statistics per label of all feedback that has arrived, as a streaming aggregate.

    Sums, counts and means lie in Spark's state store, a row for each label. The records are the static
    side of the join and are read anew for every micro-batch. Partial sums are made before rows meet
    at their label.
    """
    known = records.select(F.col("id").alias("classification_id"), F.col("classification").alias("label"))
    return feedback.join(known, "classification_id").groupBy("label").agg(*statistics_columns())


def keep_statistics(
    feedback: DataFrame, records: DataFrame, folder: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Keep :func:`running_statistics` of arriving feedback in a folder, a row for each label.

    Every micro-batch writes all labels under the query and the batch it belongs to; one that is run
    again replaces its own rows. Only the last few are kept. A query keeps its name over restarts from
    its checkpoint.
    """

    def write(statistics: DataFrame, batch_id: int) -> None:
        spark = statistics.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        own = {"query": F.lit(query), "batch": F.lit(batch_id).cast("long"), "written": F.current_timestamp()}
        (
            statistics.withColumns(own)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("query", "batch")
            .parquet(folder)
        )
        batches = [int(n.partition("=")[2]) for n in files.names(spark, f"{folder}/query={query}")]
        for old in sorted(batches)[:-SLOTS]:
            files.delete(spark, f"{folder}/query={query}/batch={old}")

    stream = running_statistics(feedback, records).writeStream.outputMode("complete").foreachBatch(write)
    return _start(stream, checkpoint, once)


def latest_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics that :func:`keep_statistics` has written last.

    Of several queries over one folder the one that wrote last counts, alone: a query with a new
    checkpoint reads all its input again, so rows of the one before would be stale.
    """
    try:
        kept = spark.read.schema(STATISTICS).parquet(folder)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        kept = spark.createDataFrame([], STATISTICS)
    newest = kept.agg(F.max_by(F.struct("query", "batch"), "written").alias("n")).select("n.*").first()
    own = (F.col("query") == newest["query"]) & (F.col("batch") == newest["batch"])
    return kept.where(own).select("label", "total", "overrides", "avg_quality")


def recalibrating_stream(
    results: DataFrame,
    read_stats: Callable[[SparkSession], DataFrame],
    sink: str,
    checkpoint: str,
    once: bool = False,
) -> StreamingQuery:
    """Recalibrate arriving results with the statistics current at each batch.

    ``read_stats`` is called once per micro-batch. A batch that is run again
    after a failure replaces its own output.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        scored = recalibrate(batch.drop("score"), read_stats(batch.sparkSession))
        (
            scored.withColumn("batch", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .parquet(sink)
        )

    return _start(results.writeStream.foreachBatch(write), checkpoint, once)
