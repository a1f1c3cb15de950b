"""Benchmark metrics over labelled cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def case_report(cases: DataFrame, results: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every case with its result, if it has one. ``results`` may carry a ``latency_ms`` column.

    A case without a result keeps its row: no label, no flags, and ``answered`` is false.
    """
    latency = F.col("latency_ms") if "latency_ms" in results.columns else F.lit(0.0)
    found = results.select(
        key,
        F.col("label").alias("predicted_label"),
        "score",
        latency.cast("double").alias("latency_ms"),
        "verifier_agreement",
        F.coalesce("safety_flags", F.array().cast("array<string>")).alias("_flags"),
    )
    none = F.array().cast("array<string>")
    return cases.join(found, key, "left").select(
        F.col("case_id").alias("id"),
        "expected_label",
        "predicted_label",
        "score",
        "latency_ms",
        "verifier_agreement",
        F.coalesce("_flags", none).alias("safety_flags"),
        "critical",
        "expected_flags",
        F.col("_flags").isNotNull().alias("answered"),
    )


def evaluate(report: DataFrame) -> DataFrame:
    """All metrics of a case report in one aggregation.

    Rates with an empty base are 1.0 and latencies 0; the number of cases counts
    as one when there are none. A case without a result is wrong, not flagged
    and not detected, and ``missing_results`` counts such cases.
    """
    flagged = F.size("safety_flags") > 0
    expects = F.size("expected_flags") > 0
    missing = F.array_except("expected_flags", "safety_flags")
    total = F.greatest(F.count("*"), F.lit(1))

    def rate(part, whole):
        return F.coalesce(F.try_divide(F.count_if(part & whole), F.count_if(whole)), F.lit(1.0))

    def latency(function):
        return F.coalesce(function("latency_ms"), F.lit(0.0))

    return report.agg(
        total.alias("total_cases"),
        (F.count_if(F.col("predicted_label") == F.col("expected_label")) / total).alias("accuracy"),
        latency(F.avg).alias("latency_average"),
        latency(F.max).alias("latency_max"),
        latency(F.min).alias("latency_min"),
        F.count_if(flagged).alias("flagged_cases"),
        (F.count_if(flagged) / total).alias("flagged_rate"),
        F.count_if("critical").alias("critical_cases"),
        rate(flagged, F.col("critical")).alias("critical_detection_rate"),
        rate(F.size(missing) == 0, expects).alias("expected_flag_match_rate"),
        F.count_if(~F.col("answered")).alias("missing_results"),
    )


def nested_metrics(metrics: DataFrame) -> DataFrame:
    """Metrics in the nesting of the published report file."""
    latency = F.struct(
        *[F.col(f"latency_{n}").alias(n) for n in ("average", "max", "min")]
    )
    safety = F.struct(
        "flagged_cases", "flagged_rate", "critical_cases", "critical_detection_rate",
        "expected_flag_match_rate",
    )
    return metrics.select(
        "total_cases",
        "missing_results",
        F.struct("accuracy", latency.alias("latency_ms"), safety.alias("safety")).alias("metrics"),
    )
