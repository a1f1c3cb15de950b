"""Two-model fusion, severity escalation, citations and the end-to-end classifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierglass.functions.labels import escalate, keyword_class, resolve, safety_flags
from tierglass.functions.text import bind
from tierglass.lexicon import (
    DEFAULT_LABEL,
    DEFAULT_SAFETY_KEYWORDS,
    FALLBACK_CONFIDENCE,
    FALLBACK_PUBLIC_CONFIDENCE,
    FALLBACK_SIGNAL,
    FALLBACK_SNIPPET_CHARS,
    SIGNAL_LIMIT,
)
from tierglass.operators.answers import debug_struct, fall_back, pair_answers
from tierglass.operators.evidence import RULES, Evidence, extract_signals
from tierglass.operators.feedback import recalibrate

CITATION_TYPE = (
    "array<struct<source:string,page:int,snippet:string,confidence:double,"
    "metadata:struct<label:string,signal:string,source_type:string>>>"
)
MODES = ("classifier", "engine")


def fuse(primary: Column, secondary: Column, mode: str = "classifier") -> Column:
    """Struct of label, score and agreement for two completed answers.

    A missing secondary counts as a copy of the primary. The classifier always
    averages both scores; the engine takes the lower one on disagreement.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    other = F.coalesce(secondary, primary)
    agree = primary["label"] == other["label"]
    mean = (primary["score"] + other["score"]) / F.lit(2.0)
    score = mean
    if mode == "engine":
        score = F.when(agree, mean).otherwise(F.least(primary["score"], other["score"]))
    return F.struct(
        F.when(agree, primary["label"])
        .otherwise(resolve(primary["label"], other["label"]))
        .alias("label"),
        score.alias("score"),
        agree.alias("agreement"),
    )


def model_outputs(primary: Column, secondary: Column) -> Column:
    """Map from model name to its answer; on equal names the secondary stays."""

    def entry(answer: Column) -> Column:
        output = F.struct(
            answer["label"].alias("category"),
            answer["score"].alias("confidence"),
            answer["reasoning"].alias("reasoning"),
        )
        return F.struct(F.coalesce(answer["model"], F.lit("heuristic")).alias("key"), output.alias("value"))

    def build(h: Column) -> Column:
        first, second = h["first"], h["second"]
        return F.when(
            second.isNull() | (first["key"] == second["key"]),
            F.map_from_entries(F.array(F.coalesce(second, first))),
        ).otherwise(F.map_from_entries(F.array(first, second)))

    second = F.when(secondary.isNotNull(), entry(secondary))
    return bind(build, first=entry(primary), second=second)


def citations(
    signals: Column, label: Column, source: Column, opening: Column, mode: str = "classifier"
) -> Column:
    """One citation per signal, or one made from the opening characters."""

    def cite(page: Column, snippet: Column, confidence: Column, *metadata: Column) -> Column:
        names = ("label", "signal", "source_type")
        return F.struct(
            source.alias("source"),
            page.alias("page"),
            snippet.alias("snippet"),
            confidence.alias("confidence"),
            F.struct(*[m.alias(n) for m, n in zip(metadata, names)]).alias("metadata"),
        )

    from_signals = F.transform(
        signals,
        lambda s: cite(
            s["page"], s["snippet"], s["confidence"],
            s["label"], s["description"], s["source_type"],
        ),
    )
    confidence = F.when(label == DEFAULT_LABEL, FALLBACK_PUBLIC_CONFIDENCE).otherwise(
        FALLBACK_CONFIDENCE[mode]
    )
    fallback = F.array(
        cite(
            F.lit(1), opening, confidence,
            label, F.lit(FALLBACK_SIGNAL), F.lit(None).cast("string"),
        )
    )
    return (
        F.when(F.size(signals) > 0, from_signals.cast(CITATION_TYPE))
        .otherwise(fallback.cast(CITATION_TYPE))
        .cast(CITATION_TYPE)
    )


def with_citations(
    df: DataFrame, mode: str = "classifier", source: str | None = "source"
) -> DataFrame:
    """Add ``citations``; needs ``signals``, ``label`` and ``opening``."""
    place = F.col(source) if source else F.lit("memory")
    made = citations(
        F.col("signals"), F.col("label"), F.coalesce(place, F.lit("memory")), F.col("opening"), mode
    )
    return df.withColumn("citations", made)


def read_evidence(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    keep: Sequence[str] = (),
    rules: Sequence[Evidence] = RULES,
    limit: int | None = SIGNAL_LIMIT,
    spans: str | None = None,
    safety_keywords: Sequence[str] = DEFAULT_SAFETY_KEYWORDS,
    opening_chars: int = FALLBACK_SNIPPET_CHARS,
) -> DataFrame:
    """All that classification needs to know of a text, without the text.

    One pass over the documents and no shuffle. The narrow result is what later
    joins move.
    """
    scanned = extract_signals(docs, rules, limit, spans=spans, extra_keywords=safety_keywords)
    return scanned.select(
        key,
        source,
        *keep,
        F.substring(F.coalesce("text", F.lit("")), 1, opening_chars).alias("opening"),
        "signals",
        "hits",
        keyword_class(F.col("hits")).alias("keyword"),
    )


def classify(
    docs: DataFrame,
    answers: DataFrame | None = None,
    stats: DataFrame | None = None,
    mode: str = "classifier",
    key: str = "doc_id",
    source: str = "source",
    keep: Sequence[str] = (),
    limit: int | None = SIGNAL_LIMIT,
    spans: str | None = None,
    safety_keywords: Sequence[str] = DEFAULT_SAFETY_KEYWORDS,
    parsed: bool = False,
    last_node: int | None = None,
    opening_chars: int = FALLBACK_SNIPPET_CHARS,
) -> DataFrame:
    """Label every document.

    ``answers`` holds raw responses (key, role, model, node_ord, raw_response,
    error), or with ``parsed`` answers that have their label already, as the cache
    replays them; without it both models are the keyword class. ``last_node`` is
    the number of the last prompt node where the caller knows it; then no raw
    response is shuffled. ``stats`` are label
    statistics of reviewer feedback used to recalibrate ``score``; ``raw_score``
    stays as recorded. ``keep`` names document columns to carry along.
    """
    evidence = read_evidence(
        docs, key, source, keep, limit=limit, spans=spans, safety_keywords=safety_keywords,
        opening_chars=opening_chars,
    )
    heuristic = F.col("keyword")
    if answers is None:
        completed = evidence.withColumns(
            {
                "_primary": fall_back(_no_answer(), heuristic, "engine_unavailable"),
                "_secondary": fall_back(_no_answer(), heuristic, "engine_unavailable"),
            }
        )
    else:
        pairs = pair_answers(answers, key, last_node, parsed)
        joined = evidence.join(pairs, key, "left")
        completed = joined.withColumns(
            {
                "_primary": fall_back(F.col("primary"), heuristic, "engine_unavailable"),
                "_secondary": F.when(
                    F.col("secondary").isNotNull(),
                    fall_back(F.col("secondary"), heuristic, None),
                ),
            }
        ).drop("primary", "secondary")

    primary, secondary = F.col("_primary"), F.col("_secondary")
    fused = completed.withColumn("_fused", fuse(primary, secondary, mode))
    labelled = fused.withColumn("label", escalate(F.col("_fused.label"), F.col("signals")))
    results = with_citations(labelled, mode, source).select(
        key,
        source,
        *keep,
        "label",
        F.col("_fused.score").alias("raw_score"),
        F.col("_fused.agreement").alias("verifier_agreement"),
        "signals",
        "citations",
        safety_flags(F.col("hits"), F.col("signals"), safety_keywords).alias("safety_flags"),
        model_outputs(primary, secondary).alias("model_outputs"),
        F.struct(
            debug_struct(primary).alias("primary"),
            F.when(secondary.isNotNull(), debug_struct(secondary)).alias("secondary"),
        ).alias("debug_info"),
    )
    return recalibrate(results, stats)


def _no_answer() -> Column:
    return F.lit(None).cast(
        "struct<model:string,label:string,score:double,reasoning:string,"
        "blank:boolean,reason:string,backend:string>"
    )


def engine_results(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """The engine's five-column view of ``classify(mode='engine')``."""
    return results.select(
        key,
        F.col("label").alias("category"),
        F.col("raw_score").alias("confidence"),
        "citations",
        "model_outputs",
        F.col("verifier_agreement").alias("agreement"),
    )
