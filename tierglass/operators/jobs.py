"""Job requests and the outcome of their documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierglass.operators.fusion import classify
from tierglass.session import cut_lineage
from tierglass.sources.sinks import write_reports

# Texts of rejected requests and empty tasks.
BOTH_GIVEN = "Provide either document IDs or raw text, not both."
NOTHING_GIVEN = "No document IDs or text supplied"
NO_DOCUMENTS = "No documents submitted"
UNKNOWN_PREFIX = "Unknown documents: "


def validate_jobs(
    jobs: DataFrame, docs: DataFrame, task: str = "task_id", key: str = "doc_id"
) -> DataFrame:
    """Add ``status`` (queued or rejected) and ``error`` to requests.

    Requested ids are reduced to distinct ones before they meet the documents,
    and only unknown ids come back, in the order of the request.
    """
    has_text = F.coalesce("text", F.lit("")) != ""
    ids = F.coalesce("doc_ids", F.array().cast("array<string>"))
    requested = jobs.select(task, F.posexplode(ids).alias("pos", "doc"))
    unknown = (
        requested.select("doc")
        .distinct()
        .join(docs.select(F.col(key).cast("string").alias("doc")), "doc", "left_anti")
    )
    # No longer than the array in the request itself.
    missing = (
        requested.join(unknown, "doc", "left_semi")
        .groupBy(task)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "doc"))).alias("_missing"))
    )
    listed = F.array_join(F.transform("_missing", lambda m: m["doc"]), ", ")
    error = (
        F.when(has_text & (F.size(ids) > 0), F.lit(BOTH_GIVEN))
        .when(~has_text & (F.size(ids) == 0), F.lit(NOTHING_GIVEN))
        .when(F.size("_missing") > 0, F.concat(F.lit(UNKNOWN_PREFIX), listed))
    )
    return (
        jobs.join(missing, task, "left")
        .withColumn("error", error)
        .withColumn("status", F.when(F.col("error").isNull(), "queued").otherwise("rejected"))
        .drop("_missing")
    )


def task_status(outcomes: DataFrame, tasks: DataFrame | None = None, task: str = "task_id") -> DataFrame:
    """Status, progress and error per task from the outcome of its documents.

    ``outcomes`` has the task, an order column ``ord``, ``outcome`` (done, failed
    or pending) and ``error``. ``tasks`` adds tasks without documents, which fail.
    """
    failed = F.col("outcome") == "failed"
    counts = outcomes.groupBy(task).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("outcome") == "done").alias("done"),
        F.count_if(failed).alias("failures"),
        F.min_by(F.when(failed, F.col("error")), F.when(failed, F.col("ord"))).alias("first_error"),
    )
    if tasks is not None:
        counts = tasks.select(task).join(counts, task, "left")
    total, done = F.coalesce("total", F.lit(0)), F.coalesce("done", F.lit(0))
    status = (
        F.when((total == 0) | (F.col("failures") > 0), "failed")
        .when(done == total, "completed")
        .when(done == 0, "queued")
        .otherwise("processing")
    )
    progress = F.when(F.col("status") == "failed", F.lit(0.0)).otherwise(done / total)
    error = F.when(total == 0, F.lit(NO_DOCUMENTS)).otherwise(F.col("first_error"))
    return counts.withColumn("status", status).select(
        task, "status", progress.alias("progress"), error.alias("error")
    )


def task_results(outcomes: DataFrame, task: str = "task_id") -> DataFrame:
    """Finished documents before the first failure of their task.

    The first failure is one row per failed task, aggregated before the join, so
    no task's documents are gathered.
    """
    first_failure = (
        outcomes.filter(F.col("outcome") == "failed")
        .groupBy(task)
        .agg(F.min("ord").alias("_stop"))
    )
    return (
        outcomes.filter(F.col("outcome") == "done")
        .join(first_failure, task, "left")
        .filter(F.col("_stop").isNull() | (F.col("ord") < F.col("_stop")))
        .drop("_stop")
    )


def run_jobs(
    jobs: DataFrame, docs: DataFrame, folder: str, task: str = "task_id", key: str = "doc_id", **options
) -> tuple[DataFrame, DataFrame]:
    """Check, classify and report: (status of every task, results of the finished documents).

    ``jobs`` are requests as in :func:`validate_jobs`; pasted text is a document of its own task. Each
    requested document is classified once, however many tasks name it, and its report is written per
    task. ``options`` go to ``classify``. A rejected request fails with its error.
    """
    checked = cut_lineage(validate_jobs(jobs, docs, task, key).select(task, "doc_ids", "text", "status", "error"))
    queued = checked.filter(F.col("status") == "queued")
    named = queued.select(task, F.posexplode(F.coalesce("doc_ids", F.array().cast("array<string>"))).alias("ord", "_doc"))
    named = named.groupBy(task, "_doc").agg(F.min("ord").alias("ord"))
    pasted = queued.filter(F.coalesce("text", F.lit("")) != "").select(
        task, F.lit(0).alias("ord"), F.concat(F.lit("pasted-"), F.col(task).cast("string")).alias("_doc"), "text"
    )
    wanted = docs.withColumn("_doc", F.col(key).cast("string")).join(named.select("_doc").distinct(), "_doc", "left_semi")
    given = wanted.select("_doc", "source", "text").unionByName(
        pasted.select("_doc", F.lit(None).cast("string").alias("source"), "text")
    )
    results = cut_lineage(classify(given, key="_doc", **options))
    places = named.unionByName(pasted.drop("text"))
    found = places.join(results, "_doc").withColumn("classification_id", F.col("_doc"))
    write_reports(found.withColumnRenamed(task, "task_id"), folder, key="_doc")
    outcomes = places.join(results.select("_doc", F.lit("done").alias("outcome")), "_doc", "left").select(
        task,
        "ord",
        F.coalesce("outcome", F.lit("failed")).alias("outcome"),
        F.when(F.col("outcome").isNull(), F.lit("no result")).alias("error"),
        "_doc",
    )
    ran = task_status(outcomes, queued, task)
    rejected = checked.filter(F.col("status") == "rejected").select(
        task, F.lit("failed").alias("status"), F.lit(0.0).alias("progress"), "error"
    )
    return ran.unionByName(rejected), task_results(outcomes, task).join(results, "_doc").drop("outcome", "error")
