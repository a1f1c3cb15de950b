"""Labels, rules, keywords and message formats.

Everything in this module is a fixed value: results are only right when these
equal the published classifier's values, so they are written out in their
natural order and never derived.
"""

from __future__ import annotations

from typing import NamedTuple

# Labels from least to most severe.
LABELS = ("Public", "Confidential", "Highly Sensitive", "Unsafe")


class PatternRule(NamedTuple):
    name: str
    label: str
    pattern: str  # java.util.regex syntax
    confidence: float
    description: str
    gate: str  # cheap necessary condition: 'digits' or 'at'


class KeywordRule(NamedTuple):
    label: str
    score: float
    keywords: tuple[str, ...]


# Word boundaries are spelled as look-arounds because ``\b`` in Java regex does
# not use the same Unicode word class as the expected results do. The first
# character is tested before the look-behind, which is several times faster.
_DIGIT_STARTS_WORD = r"(?=\p{Nd})(?<![\p{L}\p{N}_])"
_CAPITAL_STARTS_WORD = r"(?=[A-Z])(?<![\p{L}\p{N}_])"
_NOT_BEFORE_WORD = r"(?![\p{L}\p{N}_])"
# A match may only start where the previous one ended or outside a run of
# mailbox characters; this keeps the scan linear on long unbroken runs.
_MAILBOX_START = r"(?:\G|(?<![a-z0-9_.+-]))"

# Pattern rules in evaluation order.
PATTERN_RULES = (
    PatternRule(
        "ssn",
        "Highly Sensitive",
        _DIGIT_STARTS_WORD + r"\p{Nd}{3}-\p{Nd}{2}-\p{Nd}{4}" + _NOT_BEFORE_WORD,
        0.95,
        "Possible social security number detected",
        "digits",
    ),
    PatternRule(
        "passport",
        "Highly Sensitive",
        _CAPITAL_STARTS_WORD + r"[A-Z]{1,2}\p{Nd}{6,9}" + _NOT_BEFORE_WORD,
        0.80,
        "Passport or government ID pattern",
        "digits",
    ),
    PatternRule(
        "credit_card",
        "Highly Sensitive",
        _DIGIT_STARTS_WORD + r"(?:\p{Nd}{4}[- ]?){3}\p{Nd}{4}" + _NOT_BEFORE_WORD,
        0.90,
        "Credit or debit card number pattern",
        "digits",
    ),
    PatternRule(
        "bank_account",
        "Confidential",
        _DIGIT_STARTS_WORD + r"\p{Nd}{9,12}" + _NOT_BEFORE_WORD,
        0.75,
        "Potential bank or routing number",
        "digits",
    ),
    PatternRule(
        "email",
        "Confidential",
        r"(?iu)" + _MAILBOX_START + r"[a-z0-9_.+-]++@[a-z0-9-]++\.[a-z0-9-.]+",
        0.60,
        "Email address detected",
        "at",
    ),
)
# Every digit rule needs four decimal digits in a row.
DIGIT_GATE = r"\p{Nd}{4}"

# Keywords cited as confidential evidence, in evaluation order.
CONFIDENTIAL_EVIDENCE = (
    "confidential",
    "internal use only",
    "proprietary",
    "nda",
    "do not distribute",
    "restricted",
    "customer list",
    "employee roster",
    "pricing sheet",
)
# Keywords cited as unsafe evidence, in evaluation order.
UNSAFE_EVIDENCE = (
    "malware",
    "exploit",
    "payload",
    "weapon",
    "kill chain",
    "attack vector",
    "child sexual",
    "csam",
    "extremist",
    "hate speech",
)
CONFIDENTIAL_EVIDENCE_CONFIDENCE = 0.55
UNSAFE_EVIDENCE_CONFIDENCE = 0.90
CONFIDENTIAL_DESCRIPTION = "Keyword '{}'"
UNSAFE_DESCRIPTION = "Unsafe keyword '{}'"

# Keyword classifier, first rule that matches wins.
KEYWORD_RULES = (
    KeywordRule("Unsafe", 0.99, ("breach", "malware", "ransomware", "exploit")),
    KeywordRule(
        "Highly Sensitive",
        0.90,
        ("salary", "ssn", "social security", "passport", "medical"),
    ),
    KeywordRule(
        "Confidential",
        0.78,
        (
            "confidential",
            "nda",
            "internal memo",
            "internal use only",
            "for internal use",
            "proprietary",
        ),
    ),
)
DEFAULT_LABEL = "Public"
DEFAULT_SCORE = 0.6

# Safety keywords when none are configured, and the shipped configuration.
DEFAULT_SAFETY_KEYWORDS = ("breach", "malware", "leak")
CONFIGURED_SAFETY_KEYWORDS = (
    "breach",
    "malware",
    "leak",
    "exploit",
    "ransomware",
    "confidential",
)

# Metadata keys that make an image relevant evidence.
RELEVANT_IMAGE_KEYS = (
    "label",
    "risk",
    "sensitive",
    "pii",
    "threat",
    "score",
    "confidence",
    "bbox",
    "x0",
    "y0",
    "entity",
)
DEFAULT_BBOX = (0.02, 0.02, 0.96, 0.96)

# Limits.
SIGNAL_LIMIT = 8
SNIPPET_RADIUS = 140
FALLBACK_SNIPPET_CHARS = 280
PROMPT_TEXT_CHARS = 8000
EVIDENCE_CHARS = 260
DEBUG_CHARS = 240
IMAGE_VALUE_CHARS = 200
EVIDENCE_ENTRIES = 10
HISTORY_ENTRIES = 25
HISTORY_TABLE_ROWS = 10

# Confidence of the citation made when there is no signal.
FALLBACK_PUBLIC_CONFIDENCE = 0.6
FALLBACK_CONFIDENCE = {"classifier": 0.8, "engine": 0.85}
FALLBACK_SIGNAL = "fallback-snippet"

# Output words.
SAFE_TEXT = "Safe for Kids"
NOT_SAFE_TEXT = "Not Safe for Kids"
NO_IMAGES_TEXT = "No extracted images, diagrams, or screenshots were available."
NO_TEXT_PLACEHOLDER = "No textual content provided."
NO_KEYWORDS_REASON = "No sensitive keywords detected; default classification."

# Reviewer feedback.
OVERRIDE_DECISIONS = ("override", "reclassify")
HITL_MARKER = "\n\n# HITL Adjustments\n"
HITL_HEADING = "Recent reviewer insights:"
