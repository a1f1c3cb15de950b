"""Reviewer feedback: checks, statistics, recalibration, thresholds and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierglass.functions.text import strip
from tierglass.lexicon import HITL_HEADING, HITL_MARKER, LABELS, OVERRIDE_DECISIONS
from tierglass.schema import FEEDBACK_RECORDS
from tierglass.session import cut_lineage


def add_feedback(feedback: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feedback on known classifications, and rejects naming the unknown id.

    A missing decision becomes ``accept`` and a missing reviewer ``Analyst``.
    The record ids are unique; adaptive skew joins split an id with much feedback.
    """
    complete = feedback.withColumns(
        {
            "decision": F.coalesce(F.nullif("decision", F.lit("")), F.lit("accept")),
            "reviewer": F.coalesce(F.nullif("reviewer", F.lit("")), F.lit("Analyst")),
        }
    )
    ids = records.select(F.col("id").alias("classification_id"))
    valid = complete.join(ids, "classification_id", "left_semi")
    rejects = complete.join(ids, "classification_id", "left_anti").withColumn(
        "error",
        F.format_string("Classification %s not found", F.col("classification_id").cast("string")),
    )
    return valid, rejects


def list_feedback(feedback: DataFrame, classification_id: int | None = None) -> DataFrame:
    """All feedback or that of one classification; the filter reaches the scan."""
    if classification_id is None:
        return feedback
    return feedback.filter(F.col("classification_id") == classification_id)


def is_misclassification(decision: Column, suggested_label: Column) -> Column:
    overridden = F.lower(strip(decision)).isin(*OVERRIDE_DECISIONS)
    return overridden | (F.coalesce(suggested_label, F.lit("")) != "")


def _with_record(feedback: DataFrame, records: DataFrame, *columns: Column) -> DataFrame:
    side = records.select(F.col("id").alias("classification_id"), *columns)
    return feedback.join(side, "classification_id")


def misclassifications(feedback: DataFrame, records: DataFrame) -> DataFrame:
    """Feedback that contradicts the prediction, with the label expected instead."""
    wrong = feedback.filter(is_misclassification(F.col("decision"), F.col("suggested_label")))
    joined = _with_record(wrong, records, F.col("classification"))
    return joined.select(
        "id",
        "classification_id",
        F.coalesce(F.nullif("suggested_label", F.lit("")), "classification").alias(
            "expected_label"
        ),
        F.col("comments").alias("reviewer_notes"),
        "created_at",
    )


def label_sums(feedback: DataFrame, records: DataFrame) -> DataFrame:
    """Sums of the feedback per predicted label, to be added to others.

    Feedback is first reduced to one row per classification, so a classification
    with very much feedback is joined as a single row. Whitespace around a
    decision is significant here, unlike in :func:`misclassifications`.
    """
    overridden = F.lower("decision").isin(*OVERRIDE_DECISIONS)
    sums = ("total", "overrides", "quality", "n_quality")
    per_record = feedback.groupBy("classification_id").agg(
        F.count("*").alias("total"),
        F.count_if(overridden).alias("overrides"),
        F.sum("quality_score").alias("quality"),
        F.count("quality_score").alias("n_quality"),
    )
    joined = _with_record(per_record, records, F.col("classification"))
    return joined.groupBy(F.col("classification").alias("label")).agg(*[F.sum(c).alias(c) for c in sums])


def statistics_columns() -> list[Column]:
    """Count, overrides and mean quality as aggregates of feedback rows; sums a stream can go on with."""
    return [
        F.count("*").alias("total"),
        F.count_if(F.lower("decision").isin(*OVERRIDE_DECISIONS)).alias("overrides"),
        F.avg("quality_score").alias("avg_quality"),
    ]


def statistics_of(sums: DataFrame) -> DataFrame:
    """Count, overrides and mean quality; the mean is null where no quality was given."""
    mean = F.try_divide("quality", "n_quality").alias("avg_quality")
    return sums.select("label", "total", "overrides", mean)


def label_statistics(feedback: DataFrame, records: DataFrame) -> DataFrame:
    """Count, overrides and mean of the given qualities per predicted label."""
    return statistics_of(label_sums(feedback, records))


def recalibrated(score: Column, total: Column, overrides: Column, quality: Column) -> Column:
    """Score lowered by the override ratio and moved by the mean quality, if there is one."""
    penalty = F.least(F.lit(0.3), overrides / total * F.lit(0.3))
    bonus = F.greatest(F.lit(-0.1), F.least(F.lit(0.1), (quality - F.lit(0.5)) * F.lit(0.2)))
    moved = score * (F.lit(1) - penalty) + F.when(quality.isNotNull(), bonus).otherwise(0.0)
    limited = F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved))
    return F.when(F.coalesce(total, F.lit(0)) == 0, score).otherwise(limited)


def recalibrate(results: DataFrame, stats: DataFrame | None) -> DataFrame:
    """Add ``score``, ``raw_score`` recalibrated by the statistics of its label.

    Results only carry the four labels, and the statistics are reduced to one row
    for each, so at most four rows are broadcast.
    """
    if stats is None:
        return results.withColumn("score", F.col("raw_score"))
    entry = F.struct("total", "overrides", "avg_quality")
    four_rows = (
        stats.filter(F.col("label").isin(*LABELS))
        .groupBy("label")
        .agg(F.max(entry).alias("_s"))
        .select(
            "label",
            F.col("_s.total").alias("_total"),
            F.col("_s.overrides").alias("_overrides"),
            F.col("_s.avg_quality").alias("_quality"),
        )
    )
    score = recalibrated(
        F.col("raw_score"), F.col("_total"), F.col("_overrides"), F.col("_quality")
    )
    return (
        results.join(F.broadcast(four_rows), "label", "left")
        .withColumn("score", score)
        .select(*results.columns, "score")
    )


def feedback_history(feedback: DataFrame, records: DataFrame) -> DataFrame:
    """Feedback with its classification, newest first, time as ISO text."""
    joined = _with_record(
        feedback,
        records,
        F.col("document_path"),
        F.col("classification").alias("predicted_label"),
        F.col("score"),
    )
    return joined.orderBy(F.desc("created_at"), "id").select(
        "classification_id",
        "document_path",
        "predicted_label",
        "score",
        "decision",
        "suggested_label",
        "comments",
        "quality_score",
        iso_time(F.col("created_at")).alias("created_at"),
    )


def iso_time(ts: Column) -> Column:
    """ISO 8601 text; microseconds only where there are any."""
    seconds = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", seconds).otherwise(F.concat(seconds, F.lit("."), micros))


def update_thresholds(thresholds: DataFrame, stats: DataFrame) -> DataFrame:
    """Move each threshold (key, value) towards an override ratio of 0.2."""
    label = F.initcap(F.replace("key", F.lit("_"), F.lit(" ")))
    ratio = F.col("overrides") / F.col("total")
    moved = F.col("value") + (F.lit(0.2) - ratio) * F.lit(0.02)
    limited = F.greatest(F.lit(0.05), F.least(F.lit(0.99), moved))
    updated = F.when(F.coalesce("total", F.lit(0)) == 0, F.col("value")).otherwise(
        F.bround(limited, 4)
    )
    keyed = thresholds.select("key", F.col("value").cast("double"), label.alias("label"))
    return keyed.join(stats, "label", "left").select("key", updated.alias("value"))


def annotation_line(label: Column, overrides: Column, total: Column, quality: Column) -> Column:
    return F.format_string(
        "- %s: overrides %.0f%%, avg quality %.2f",
        label,
        F.bround(overrides / total * 100, 0),
        F.bround(F.coalesce(quality, F.lit(0.0)), 2),
    )


def annotate_prompt(prompts: DataFrame, stats: DataFrame) -> DataFrame:
    """Replace the reviewer notes at the end of each prompt.

    The notes have one line per label with feedback, at most four, so they are
    one scalar value.
    """
    line = annotation_line(
        F.col("label"), F.col("overrides"), F.col("total"), F.col("avg_quality")
    )
    lines = F.array_sort(F.collect_list(F.struct("label", line.alias("line"))))
    notes = stats.filter(F.col("label").isin(*LABELS)).agg(
        F.array_join(
            F.concat(F.array(F.lit(HITL_HEADING)), F.transform(lines, lambda r: r["line"])), "\n"
        ).alias("notes")
    )
    base = F.split_part("prompt", F.lit(HITL_MARKER), F.lit(1))
    return prompts.withColumn("prompt", F.concat(base, F.lit(HITL_MARKER), notes.scalar()))


def refine(
    thresholds: DataFrame, prompts: DataFrame, feedback: DataFrame, records: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """New thresholds and annotated prompts from one set of statistics, at most a row per label."""
    stats = cut_lineage(label_statistics(feedback, records))
    return update_thresholds(thresholds, stats), annotate_prompt(prompts, stats)


def align_columns(feedback: DataFrame) -> DataFrame:
    """Add feedback columns an older table lacks, as nulls, and order them."""
    missing = {
        f.name: F.lit(None).cast(f.dataType)
        for f in FEEDBACK_RECORDS.fields
        if f.name not in feedback.columns
    }
    return feedback.withColumns(missing).select(*FEEDBACK_RECORDS.fieldNames())
