"""Label columns: rank, keyword class, escalation, flags and display buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tierglass.functions.text import string_array, strip
from tierglass.lexicon import (
    DEFAULT_LABEL,
    DEFAULT_SCORE,
    KEYWORD_RULES,
    LABELS,
    NO_KEYWORDS_REASON,
    NOT_SAFE_TEXT,
    SAFE_TEXT,
    KeywordRule,
)


def rank(label: Column) -> Column:
    """Severity of a label, 0 (also for unknown labels) to 3."""
    severity = F.when(label == LABELS[1], 1).when(label == LABELS[2], 2).when(label == LABELS[3], 3)
    return severity.otherwise(0)


def label_of(severity: Column) -> Column:
    """Inverse of :func:`rank`."""
    return F.element_at(string_array(LABELS), severity + F.lit(1))


def keyword_class(hits: Column, rules: Sequence[KeywordRule] = KEYWORD_RULES) -> Column:
    """Label, score and reasoning of the first keyword rule that matches.

    ``hits`` is the array of lexicon keywords contained in the text.
    """
    label, score = F.lit(DEFAULT_LABEL), F.lit(DEFAULT_SCORE)
    reasoning = F.lit(NO_KEYWORDS_REASON)
    for rule in reversed(rules):
        words = string_array(rule.keywords)
        found = F.arrays_overlap(hits, words)
        matched = F.array_join(F.array_sort(F.array_intersect(hits, words)), ", ")
        reason = F.concat(
            F.lit("Heuristic detection of keywords "), matched, F.lit(f" indicating {rule.label}.")
        )
        label = F.when(found, rule.label).otherwise(label)
        score = F.when(found, rule.score).otherwise(score)
        reasoning = F.when(found, reason).otherwise(reasoning)
    return F.struct(
        label.alias("label"), score.alias("score"), reasoning.alias("reasoning")
    )


def escalate(label: Column, signals: Column) -> Column:
    """The most severe of the label and all signal labels."""
    strongest = F.coalesce(
        F.array_max(F.transform(signals, lambda s: rank(s["label"]))), F.lit(0)
    )
    return F.when(strongest > rank(label), label_of(strongest)).otherwise(label)


def resolve(primary: Column, secondary: Column) -> Column:
    """The more severe label; a tie goes to the secondary."""
    return F.when(rank(primary) > rank(secondary), primary).otherwise(secondary)


def safety_flags(hits: Column, signals: Column, keywords: Sequence[str]) -> Column:
    """Sorted distinct configured keywords found plus descriptions of unsafe signals."""
    from_signals = F.transform(
        F.filter(signals, lambda s: s["label"] == LABELS[-1]), lambda s: s["description"]
    )
    found = F.array_intersect(hits, string_array(keywords))
    return F.array_sort(F.array_union(found, from_signals))


def api_category(label: Column) -> Column:
    """Public, Confidential, or Sensitive for anything else."""
    norm = F.lower(strip(F.coalesce(label, F.lit(""))))
    return (
        F.when(norm == "public", "Public")
        .when(F.contains(norm, F.lit("confidential")), "Confidential")
        .otherwise("Sensitive")
    )


def bucket(label: Column) -> Column:
    """Dashboard bucket. Note that 'Sensitive' and 'Unsafe' fall into Public."""
    lowered = F.lower(F.coalesce(label, F.lit("")))
    return (
        F.when(F.contains(lowered, F.lit("high")), "Highly Sensitive")
        .when(F.contains(lowered, F.lit("confidential")), "Confidential")
        .otherwise("Public")
    )


def history_bucket(category: Column, label: Column) -> Column:
    """Bucket of the category, or of the label where the category is missing or empty."""
    return bucket(F.coalesce(F.nullif(category, F.lit("")), label))


def content_safety(label: Column, flags: Column) -> Column:
    unsafe = (label == LABELS[-1]) | (F.size(F.coalesce(flags, string_array(()))) > 0)
    return F.when(unsafe, NOT_SAFE_TEXT).otherwise(SAFE_TEXT)
