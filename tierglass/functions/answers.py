"""Columns that read a label, a confidence and a reasoning out of a model answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tierglass.functions.text import WHITESPACE_CLASS, strip
from tierglass.lexicon import DEFAULT_LABEL, DEFAULT_SCORE, LABELS

# Fixed value: where a confidence stands in a free-text answer.
CONFIDENCE_PATTERN = (
    r"(?iu)confidence" + WHITESPACE_CLASS + r"*[:=]" + WHITESPACE_CLASS + r"*(0?\.\p{Nd}+|1\.0)"
)
# JSON keys, first truthy one wins.
LABEL_KEYS = ("label", "category", "risk_level")
CONFIDENCE_KEYS = ("confidence", "score")
REASONING_KEYS = ("reasoning", "rationale")

FIELD_TYPE = "struct<kind:string,value:string>"


def json_block(response: Column) -> Column:
    """From the first opening to the last closing brace, else null."""
    return F.nullif(F.regexp_extract(response, r"(?s)\{.*\}", 0), F.lit(""))


def json_data(response: Column) -> Column:
    """What :func:`json_field` reads: the answer's JSON object, or nulls where it has none.

    A repeated key counts with its last value and NaN and infinities are read as text, so an object that
    the strict parser refuses for these is read once more. The brackets make anything behind the
    object an error there.
    """
    block = json_block(response)
    keys = (*LABEL_KEYS, *CONFIDENCE_KEYS, *REASONING_KEYS)
    fields = ",".join(f"{key}:variant" for key in keys)
    strict = F.try_parse_json(block)
    listed = F.concat(F.lit("["), F.when(strict.isNull(), block), F.lit("]"))
    lenient = F.from_json(listed, f"array<struct<{fields}>>", {"mode": "PERMISSIVE"})
    return F.struct(
        strict.alias("strict"), F.when(F.size(lenient) == 1, F.get(lenient, 0)).alias("lenient")
    )


def json_field(data: Column, key: str) -> Column:
    """Kind (string, number, boolean, list, object) and text of one key; null if absent."""
    value = F.coalesce(F.try_variant_get(data["strict"], f"$.{key}", "variant"), data["lenient"][key])
    kind_name = F.schema_of_variant(value)
    kind = (
        F.when(kind_name.isNull() | (kind_name == "VOID"), F.lit(None).cast("string"))
        .when(kind_name == "STRING", "string")
        .when(kind_name == "BOOLEAN", "boolean")
        .when(kind_name.startswith("ARRAY"), "list")
        .when(kind_name.startswith("OBJECT"), "object")
        .otherwise("number")
    )
    text = F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value))
    return F.when(
        kind.isNotNull(), F.struct(kind.alias("kind"), text.alias("value"))
    ).cast(FIELD_TYPE)


def truthy(field: Column) -> Column:
    kind, value = field["kind"], field["value"]
    return F.coalesce(
        F.when(kind == "string", value != "")
        .when(kind == "boolean", value == "true")
        .when(kind == "number", value.try_cast("double") != 0)
        .when(kind == "list", value != "[]")
        .when(kind == "object", value != "{}"),
        F.lit(False),
    )


def first_truthy(fields: list[Column]) -> Column:
    """The first truthy field; the last one stands as it is when none is."""
    chosen = fields[-1]
    for field in reversed(fields[:-1]):
        chosen = F.when(truthy(field), field).otherwise(chosen)
    return chosen


def label_in_text(response: Column) -> Column:
    """First label, from least to most severe, named anywhere in the answer."""
    lowered = F.lower(response)
    found = F.lit(None).cast("string")
    for name in reversed(LABELS):
        found = F.when(F.contains(lowered, F.lit(name.lower())), F.lit(name)).otherwise(found)
    return found


def normalise_label(label: Column) -> Column:
    return F.initcap(F.replace(strip(label), F.lit("_"), F.lit(" ")))


def closest_label(label: Column) -> Column:
    lowered = F.lower(label)

    def has(word: str) -> Column:
        return F.contains(lowered, F.lit(word))

    return (
        F.when(has("unsafe"), LABELS[3])
        .when(has("high") & has("sensitive"), LABELS[2])
        .when(has("confidential") | has("nda"), LABELS[1])
        .otherwise(LABELS[0])
    )


def answer_label(field: Column, response: Column) -> Column:
    """One of the four labels, from the JSON field or else from the free text."""
    named = F.when(truthy(field), field["value"]).otherwise(label_in_text(response))
    return closest_label(normalise_label(F.coalesce(named, F.lit(DEFAULT_LABEL))))


def number_of(field: Column) -> Column:
    """The field as a double where a conversion exists, else null."""
    kind, value = field["kind"], field["value"]
    return F.when(kind == "boolean", (value == "true").cast("double")).when(
        kind.isin("number", "string"), strip(value).try_cast("double")
    )


def answer_score(field: Column, response: Column) -> Column:
    """Confidence limited to [0, 1]: JSON field, else free text, else the default."""
    in_text = F.regexp_extract(response, CONFIDENCE_PATTERN, 1).try_cast("double")
    value = F.when(field.isNotNull(), number_of(field)).otherwise(
        F.coalesce(in_text, F.lit(DEFAULT_SCORE))
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def answer_reasoning(field: Column, response: Column) -> Column:
    return strip(F.when(field.isNotNull(), field["value"]).otherwise(response))


def field_error(label: Column, confidence: Column, reasoning: Column) -> Column:
    """Why an answer cannot be read: a field of a type that has no conversion."""
    return (
        F.when(
            truthy(label) & (label["kind"] != "string"),
            F.concat(F.lit("label is a "), label["kind"]),
        )
        .when(
            confidence.isNotNull() & number_of(confidence).isNull(),
            F.lit("confidence is not a number"),
        )
        .when(
            reasoning.isNotNull() & (reasoning["kind"] != "string"),
            F.concat(F.lit("reasoning is a "), reasoning["kind"]),
        )
    )
