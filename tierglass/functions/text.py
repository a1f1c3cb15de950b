"""Text columns: stripping, whitespace, containment, offsets and snippets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tierglass.lexicon import SNIPPET_RADIUS

# All characters that count as whitespace (Unicode White_Space
# plus the four ASCII separators U+001C to U+001F).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
WHITESPACE_CLASS = (
    r"[\t-\r\x1c-\x1f \x85\xa0  -     　]"
)


def strip(text: Column) -> Column:
    """Remove whitespace of any kind from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """True for null, empty and all-whitespace text."""
    return F.coalesce(strip(text), F.lit("")) == ""


def collapse_whitespace(text: Column) -> Column:
    """Replace each whitespace run by one space."""
    return F.regexp_replace(text, WHITESPACE_CLASS + "+", " ")


def word_count(stripped: Column) -> Column:
    """Number of whitespace-separated words in already stripped text."""
    return F.when(stripped == "", F.lit(0)).otherwise(
        F.size(F.split(stripped, WHITESPACE_CLASS + "+"))
    )


def sql_text(value: str) -> str:
    """A string as a Spark SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def string_array(values: Sequence[str]) -> Column:
    """A constant array, as one SQL expression because that is planned faster."""
    if not values:
        return F.array().cast("array<string>")
    return F.expr(f"array({', '.join(sql_text(v) for v in values)})")


def struct_array(rows: Sequence[dict[str, object]]) -> Column:
    """A constant array of structs with string, integer and double fields."""

    def literal(value: object) -> str:
        if isinstance(value, str):
            return sql_text(value)
        return f"double({value})" if isinstance(value, float) else str(value)

    structs = [
        "named_struct(" + ", ".join(f"'{k}', {literal(v)}" for k, v in row.items()) + ")"
        for row in rows
    ]
    return F.expr(f"array({', '.join(structs)})")


def contained(lowered: str, keywords: Sequence[str]) -> Column:
    """The keywords that occur in the text column, in the order given.

    ``lowered`` must be a materialised column: it is read once per keyword.
    """
    found = [f"CASE WHEN contains({lowered}, {k}) THEN {k} END" for k in map(sql_text, keywords)]
    return F.expr(f"array_compact(array({', '.join(found)}))")


def snippet(text: Column, start: Column, end: Column, radius: int = SNIPPET_RADIUS) -> Column:
    """Text around ``[start, end)`` with whitespace collapsed (zero-based offsets)."""
    left = F.greatest(start - F.lit(radius), F.lit(0))
    width = F.greatest(end + F.lit(radius) - left, F.lit(0))
    return collapse_whitespace(strip(F.substring(text, left + F.lit(1), width)))


def bind(body: Callable[[Column], Column], **values: Column) -> Column:
    """Evaluate ``values`` once per row and hand them to ``body`` as a struct.

    Inside a lambda the optimizer may otherwise repeat an expression for every
    array element.
    """
    held = F.array(F.struct(*[v.alias(name) for name, v in values.items()]))
    return F.get(F.transform(held, body), 0)


def lengths(pieces: str) -> str:
    """SQL: lengths of an array of strings."""
    return f"transform({pieces}, piece -> length(piece))"


def running_sums(numbers: str) -> str:
    """SQL: for each element of an integer array the sum of all elements before it.

    Works on blocks of about sqrt(n) elements, so an array of n elements costs
    n * sqrt(n) additions and not n * n. Arrays of one element serve as local
    variables, so that each step is evaluated once.
    """
    block = "cast(i div width as int)"
    total = "aggregate(slice(nums, {0} * width + 1, {1}), 0, (t, v) -> t + v)"
    block_starts = (
        "aggregate(sequence(0, cast(size(nums) div width as int)), array(0), "
        f"(acc, b) -> concat(acc, array(element_at(acc, -1) + {total.format('b', 'width')})))"
    )
    within = f"transform(nums, (n, i) -> starts[{block}] + {total.format(block, 'i % width')})"
    with_starts = f"flatten(transform(array({block_starts}), starts -> {within}))"
    width = "greatest(cast(ceil(sqrt(size(nums))) as int), 1)"
    with_width = f"flatten(transform(array({width}), width -> {with_starts}))"
    return f"flatten(transform(array({numbers}), nums -> {with_width}))"
