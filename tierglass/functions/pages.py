"""Page, image-count and bounding-box columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tierglass.functions.text import is_blank, lengths, running_sums, string_array
from tierglass.lexicon import DEFAULT_BBOX, RELEVANT_IMAGE_KEYS

SPAN_TYPE = "array<struct<page:int,start:int,end:int>>"


def spans_of_lengths(lens: str, gap: int) -> str:
    """SQL: page spans from page lengths with ``gap`` characters between pages."""
    start = f"h.before[i] + i * {gap}"
    span = (
        f"named_struct('page', cast(i + 1 as int), "
        f"'start', cast({start} as int), 'end', cast({start} + len as int))"
    )
    held = f"array(named_struct('lens', lens, 'before', {running_sums('lens')}))"
    placed = f"flatten(transform({held}, h -> transform(h.lens, (len, i) -> {span})))"
    return f"flatten(transform(array({lens}), lens -> {placed}))"


def form_feed_spans(text: str) -> Column:
    """Half-open character spans of form-feed separated pages; empty text has none."""
    pages = lengths(f"split({text}, char(12), -1)")
    return F.expr(
        f"""CASE WHEN coalesce({text}, '') = '' THEN cast(array() AS {SPAN_TYPE})
        WHEN NOT contains({text}, char(12))
        THEN array(named_struct('page', 1, 'start', 0, 'end', length({text})))
        ELSE {spans_of_lengths(pages, 1)} END"""
    ).cast(SPAN_TYPE)


def one_span(text: str) -> Column:
    """The whole text as page one; empty text has no page."""
    return F.expr(
        f"""CASE WHEN coalesce({text}, '') = '' THEN cast(array() AS {SPAN_TYPE})
        ELSE array(named_struct('page', 1, 'start', 0, 'end', length({text}))) END"""
    ).cast(SPAN_TYPE)


def page_of(spans: Column, offset: Column) -> Column:
    """Page of the span that covers the offset, else null. Spans are in order and do not overlap.

    Halves the spans until the last one that starts at or before the offset is found, so that many
    signals on many pages stay cheap.
    """

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        return F.when(
            F.get(spans, middle)["start"] <= offset,
            F.struct((middle + F.lit(1)).alias("low"), s["high"].alias("high")),
        ).otherwise(F.struct(s["low"].alias("low"), middle.alias("high")))

    steps = F.ceil(F.log2(F.size(spans) + F.lit(1))).cast("int")
    everything = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))
    last = F.get(
        spans, F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), everything, halve)["low"] - F.lit(1)
    )
    return F.when(offset < last["end"], last["page"])


def content_type(has_text: Column, image_count: Column) -> Column:
    has_images = image_count > 0
    return (
        F.when(has_text & has_images, "mixed")
        .when(has_images, "image")
        .when(has_text, "text")
        .otherwise("unknown")
    )


def detect_content_type(
    declared: Column, text_evidence: list[Column], image_evidence: list[Column]
) -> Column:
    """Declared type if usable, else derived from which evidence columns are truthy.

    Evidence columns are booleans or counts; null counts as absent.
    """

    def any_true(columns: list[Column]) -> Column:
        found = F.lit(False)
        for column in columns:
            found = found | F.coalesce(column.cast("int") != 0, F.lit(False))
        return found

    has_text, has_images = any_true(text_evidence), any_true(image_evidence)
    return (
        F.when(declared.isin("text", "image", "mixed"), declared)
        .when(has_text & has_images, "mixed")
        .when(has_images, "image")
        .otherwise("text")
    )


def as_count(value: Column) -> Column:
    """A number or numeric string as an integer, else null."""
    return value.try_cast("int")


def page_count(declared: Column, image_pages: Column, text: Column) -> Column:
    """Declared count if positive, else last image page, else 1 if there is text."""
    number = as_count(declared)
    last_image_page = F.nullif(F.array_max(image_pages), F.lit(0))
    return F.coalesce(
        F.when(number > 0, number),
        last_image_page,
        F.when(is_blank(text), F.lit(0)).otherwise(F.lit(1)),
    )


def image_count(declared: Column, n_images: Column) -> Column:
    """Declared count if not negative, else the number of image rows."""
    number = as_count(declared)
    return F.coalesce(F.when(number >= 0, number), n_images, F.lit(0))


def is_relevant_image(metadata: Column) -> Column:
    """True when any metadata key, ignoring case, is a known evidence key."""
    keys = F.transform(F.map_keys(metadata), lambda k: F.lower(k))
    known = string_array(RELEVANT_IMAGE_KEYS)
    return F.coalesce(F.arrays_overlap(keys, known), F.lit(False))


def clamp_bbox(box: Column) -> Column:
    """``[x, y, width, height]`` limited to the unit square, or the default box."""

    def limit(position: int, low: float) -> Column:
        value = F.get(box, position).cast("double")
        return F.greatest(F.lit(low), F.least(F.lit(1.0), value))

    return F.when(
        F.size(box) == 4,
        F.array(limit(0, 0.0), limit(1, 0.0), limit(2, 0.05), limit(3, 0.05)),
    ).otherwise(F.array(*[F.lit(v) for v in DEFAULT_BBOX]))


def data_url(content: Column) -> Column:
    """PNG bytes as a data URL; null stays null."""
    return F.concat(F.lit("data:image/png;base64,"), F.base64(content))
