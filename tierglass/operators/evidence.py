"""Risk-signal extraction: pattern matches and keywords with snippet and page.

All signals of a document are built inside its row, so nothing is shuffled and
the cap on signals is a slice of an ordered array.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierglass.functions.once import with_once
from tierglass.functions.pages import form_feed_spans, page_of
from tierglass.functions.text import (
    contained,
    lengths,
    running_sums,
    snippet,
    sql_text,
    strip,
    struct_array,
)
from tierglass.lexicon import (
    CONFIDENTIAL_DESCRIPTION,
    CONFIDENTIAL_EVIDENCE,
    CONFIDENTIAL_EVIDENCE_CONFIDENCE,
    CONFIGURED_SAFETY_KEYWORDS,
    DEFAULT_SAFETY_KEYWORDS,
    DIGIT_GATE,
    KEYWORD_RULES,
    LABELS,
    PATTERN_RULES,
    SIGNAL_LIMIT,
    UNSAFE_DESCRIPTION,
    UNSAFE_EVIDENCE,
    UNSAFE_EVIDENCE_CONFIDENCE,
    PatternRule,
)

SIGNAL_TYPE = (
    "array<struct<label:string,snippet:string,description:string,page:int,"
    "confidence:double,source_type:string>>"
)


SPOT_TYPE = "array<struct<rule:int,start:int,end:int>>"


class Evidence(NamedTuple):
    """One pattern or keyword with what it stands for."""

    label: str
    description: str
    confidence: float
    pattern: PatternRule | None
    keyword: str | None


def _pattern_evidence(rule: PatternRule) -> Evidence:
    return Evidence(rule.label, rule.description, rule.confidence, rule, None)


def _keyword_evidence(label: str, template: str, confidence: float, word: str) -> Evidence:
    return Evidence(label, template.format(word), confidence, None, word)


PATTERN_EVIDENCE = tuple(_pattern_evidence(rule) for rule in PATTERN_RULES)
CONFIDENTIAL_KEYWORD_EVIDENCE = tuple(
    _keyword_evidence(
        LABELS[1], CONFIDENTIAL_DESCRIPTION, CONFIDENTIAL_EVIDENCE_CONFIDENCE, word
    )
    for word in CONFIDENTIAL_EVIDENCE
)
UNSAFE_KEYWORD_EVIDENCE = tuple(
    _keyword_evidence(LABELS[3], UNSAFE_DESCRIPTION, UNSAFE_EVIDENCE_CONFIDENCE, word)
    for word in UNSAFE_EVIDENCE
)
RULES = PATTERN_EVIDENCE + CONFIDENTIAL_KEYWORD_EVIDENCE + UNSAFE_KEYWORD_EVIDENCE


def lexicon_keywords(rules: Sequence[Evidence], extra: Sequence[str] = ()) -> list[str]:
    """Every distinct keyword any step looks for, so each is searched once."""
    words = [r.keyword for r in rules if r.keyword]
    for rule in KEYWORD_RULES:
        words.extend(rule.keywords)
    words.extend(DEFAULT_SAFETY_KEYWORDS + CONFIGURED_SAFETY_KEYWORDS)
    words.extend(extra)
    return list(dict.fromkeys(words))


def scan_text(
    docs: DataFrame,
    rules: Sequence[Evidence] = RULES,
    text: str = "text",
    extra_keywords: Sequence[str] = (),
) -> DataFrame:
    """Add ``stripped``, ``lowered``, ``hits`` (lexicon keywords in the text) and gates."""
    words = lexicon_keywords(rules, extra_keywords)
    lowered = (
        docs.withColumn("stripped", strip(F.coalesce(F.col(text), F.lit(""))))
        .withColumn("lowered", F.lower("stripped"))
    )
    return with_once(
        lowered,
        {
            "hits": contained("lowered", words),
            "has_digits": F.rlike("stripped", F.lit(DIGIT_GATE)),
            "has_at": F.contains("stripped", F.lit("@")),
        },
    )


def pattern_spots(
    text: str, rules: Sequence[tuple[int, Evidence]], gates: dict[str, str], limit: int | None
) -> Column:
    """Rule number and span of every match; the text between matches gives offsets.

    A rule whose gate is closed is not searched for.
    """
    bound = -1 if limit is None else limit + 1

    def scan(ordinal: int, rule: PatternRule) -> str:
        pattern = sql_text(rule.pattern)
        found = f"regexp_extract_all({text}, {pattern}, 0)"
        if limit is not None:
            found = f"slice({found}, 1, {limit})"
        gaps = lengths(f"split({text}, {pattern}, {bound})")
        none = "cast(array() AS array<int>)"
        # Text that splits into one piece has no match, so nothing is extracted.
        searched = f"CASE WHEN size(g) > 1 THEN {lengths(found)} ELSE {none} END"
        return (
            f"transform(array(CASE WHEN {gates[rule.gate]} THEN {gaps} ELSE {none} END), "
            f"g -> named_struct('rule', {ordinal}, 'gaps', g, 'found', {searched}))[0]"
        )

    steps = "zip_with(slice(s.gaps, 1, size(s.found)), s.found, (gap, n) -> gap + n)"
    start = "h.before[i] + s.gaps[i]"
    spot = f"named_struct('rule', s.rule, 'start', {start}, 'end', {start} + n)"
    placed = f"transform(s.found, (n, i) -> {spot})"
    held = f"array(named_struct('before', {running_sums(steps)}))"
    spots = f"flatten(transform({held}, h -> {placed}))"
    scans = ", ".join(scan(ordinal, rule.pattern) for ordinal, rule in rules)
    none = f"cast(array() AS {SPOT_TYPE})"
    return F.expr(
        f"flatten(transform(array({scans}), "
        f"s -> CASE WHEN size(s.found) > 0 THEN {spots} ELSE {none} END))"
    )


def keyword_spots(lowered: Column, hits: Column, rules: Sequence[tuple[int, Evidence]]) -> Column:
    """Rule number and span of the first occurrence of each keyword in ``hits``."""
    table = struct_array([{"rule": i, "word": r.keyword} for i, r in rules])
    present = F.filter(table, lambda r: F.array_contains(hits, r["word"]))

    def spot(r: Column) -> Column:
        start = F.instr(lowered, r["word"]) - F.lit(1)
        return F.struct(
            r["rule"].alias("rule"),
            start.alias("start"),
            (start + F.length(r["word"])).alias("end"),
        )

    return F.transform(present, spot)


def extract_signals(
    docs: DataFrame,
    rules: Sequence[Evidence] = RULES,
    limit: int | None = SIGNAL_LIMIT,
    text: str = "text",
    spans: str | None = None,
    extra_keywords: Sequence[str] = (),
) -> DataFrame:
    """Add ``signals``, the first ``limit`` signals in rule order, and ``hits``.

    Offsets refer to the stripped text while page spans refer to the text as
    given, so leading whitespace shifts the page looked up. ``limit=None`` keeps
    every signal.
    """
    scanned = scan_text(docs, rules, text, extra_keywords).withColumn(
        "_spans", F.col(spans) if spans else form_feed_spans(text)
    )
    stripped, lowered, hits = F.col("stripped"), F.col("lowered"), F.col("hits")
    gates = {"digits": "has_digits", "at": "has_at"}
    no_spots = F.array().cast(SPOT_TYPE)

    groups = []
    for is_pattern, run in groupby(enumerate(rules), key=lambda item: item[1].keyword is None):
        if is_pattern:
            searched = pattern_spots("stripped", list(run), gates, limit)
            possible = F.col("has_digits") | F.col("has_at")
        else:
            searched = keyword_spots(lowered, hits, list(run))
            possible = F.size(hits) > 0
        groups.append(F.when(possible, searched).otherwise(no_spots))
    spots = F.concat(*groups)
    if limit is not None:
        spots = F.slice(spots, 1, limit)

    facts = struct_array(
        [
            {"label": r.label, "description": r.description, "confidence": r.confidence}
            for r in rules
        ]
    )
    page_spans = F.col("_spans")

    def signal(spot: Column) -> Column:
        fact = F.get(facts, spot["rule"])
        return F.struct(
            fact["label"].alias("label"),
            snippet(stripped, spot["start"], spot["end"]).alias("snippet"),
            fact["description"].alias("description"),
            page_of(page_spans, spot["start"]).alias("page"),
            fact["confidence"].alias("confidence"),
            F.lit("text").alias("source_type"),
        )

    found = scanned.withColumn("_spots", spots)
    signals = F.when(F.size("_spots") > 0, F.transform("_spots", signal)).otherwise(F.array())
    return with_once(found, {"signals": signals.cast(SIGNAL_TYPE)}).drop(
        "_spots", "_spans", "has_digits", "has_at", "stripped", "lowered"
    )


def explode_signals(df: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per signal; a document without signals keeps one row of nulls."""
    return df.select(*keys, F.posexplode_outer("signals").alias("signal_ord", "s")).select(
        *keys, "signal_ord", "s.*"
    )
