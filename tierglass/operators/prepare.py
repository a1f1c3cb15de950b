"""Document preparation: pages, spans, metadata and image summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tierglass.functions import pages as P
from tierglass.functions.once import with_once
from tierglass.functions.text import lengths, strip, word_count
from tierglass.lexicon import IMAGE_VALUE_CHARS, NO_IMAGES_TEXT


def split_pages(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``page_spans`` and ``page_count`` from the form feeds in the text.

    Where ``docs`` has a ``mime_class``, only text is split: an image's text is one page.
    """
    spans = P.form_feed_spans(text)
    if "mime_class" in docs.columns:
        spans = F.when(F.col("mime_class") == "image", P.one_span(text)).otherwise(spans)
    return with_once(docs, {"page_spans": spans}).withColumn(
        "page_count", F.size("page_spans")
    )


def assemble_pages(
    pages: DataFrame, key: str, order: str, text: str = "text", sep: str = "\n\n"
) -> DataFrame:
    """Join page rows into one row per document, its text and the span of every page.

    A document's text is one value, so its pages meet in one row however many they are; documents are
    spread over tasks, and page text is moved once.
    """
    content = F.coalesce(text, F.lit(""))
    gathered = pages.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), content.alias("t")))).alias(
            "rows"
        )
    )
    spans = P.spans_of_lengths(lengths("transform(rows, r -> r.t)"), len(sep))
    placed = with_once(gathered, {"page_spans": F.expr(spans).cast(P.SPAN_TYPE)})
    return placed.select(
        key,
        F.array_join(F.transform("rows", lambda r: r["t"]), sep).alias("text"),
        "page_spans",
        F.size("rows").alias("page_count"),
    )


#: Characters of the bins in which offsets meet spans.
BIN_CHARS = 1 << 16


def pages_of_offsets(
    offsets: DataFrame, spans: DataFrame, key: str = "doc_id", offset: str = "offset", bin_chars: int = BIN_CHARS
) -> DataFrame:
    """Add ``page`` to a table of offsets, from a table of spans (``key``, page, start, end).

    The form of :func:`~tierglass.functions.pages.page_of` for tables. Spans lie in the bins that they
    touch and offsets in theirs; in the order of a bin, the last span that starts at or before an offset
    is the only one that can cover it, as spans of a document do not overlap. A bin has at most
    ``bin_chars`` spans and as many different offsets, so a document of any number of pages is many
    tasks, and offsets that are asked for often are looked up once.

    An offset that no span covers, or a null one, has no page.
    """
    at = F.col(offset)
    asked = offsets.where(at >= 0).select(key, at.cast("long").alias("_at")).distinct()
    bins = F.sequence(F.expr(f"start div {bin_chars}"), F.expr(f"(end - 1) div {bin_chars}"))
    covering = spans.where("end > start").select(
        key,
        F.explode(bins).alias("_bin"),
        F.col("start").cast("long").alias("_at"),
        F.struct("page", F.col("end").cast("long").alias("end")).alias("_span"),
    )
    events = covering.unionByName(
        asked.withColumn("_bin", F.expr(f"_at div {bin_chars}")), allowMissingColumns=True
    )
    in_bin = W.partitionBy(key, "_bin").orderBy("_at", F.col("_span").isNull())
    last = F.last("_span", ignorenulls=True).over(in_bin.rowsBetween(W.unboundedPreceding, W.currentRow))
    found = (
        events.withColumn("_last", last)
        .where(F.col("_span").isNull())
        .select(key, "_at", F.when(F.col("_at") < F.col("_last.end"), F.col("_last.page")).alias("page"))
    )
    joined = offsets.withColumn("_at", at.cast("long")).join(found, [key, "_at"], "left")
    return joined.select(*offsets.columns, "page")


def image_rollup(images: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document the number of images and the sorted distinct pages they are on."""
    return images.groupBy(key).agg(
        F.count("*").cast("int").alias("image_count"),
        F.array_sort(F.collect_set("page")).alias("pages_with_images"),
    )


def document_metadata(
    docs: DataFrame,
    images: DataFrame | None = None,
    key: str = "doc_id",
    keep: tuple[str, ...] = ("source",),
    spans: str | None = None,
) -> DataFrame:
    """Metadata of every document, without its text.

    Everything read from the text is computed before images are joined, so the
    text is never shuffled.
    """
    spanned = docs if spans else split_pages(docs)
    stripped = spanned.withColumn("_stripped", strip(F.coalesce("text", F.lit(""))))
    length = F.length(F.coalesce("text", F.lit("")))
    page_spans = F.col(spans or "page_spans")
    facts = stripped.select(
        key,
        *keep,
        (F.col("_stripped") != "").alias("has_text"),
        length.alias("text_length"),
        length.alias("character_count"),
        word_count(F.col("_stripped")).alias("word_count"),
        F.greatest(F.size(page_spans), F.lit(0)).alias("page_count"),
        F.when(F.size(page_spans) > 0, page_spans).alias("page_spans"),
    )
    if images is None:
        joined = facts.withColumns(
            {
                "image_count": F.lit(0),
                "pages_with_images": F.lit(None).cast("array<int>"),
            }
        )
    else:
        joined = facts.join(image_rollup(images, key), key, "left").withColumns(
            {
                "image_count": F.coalesce("image_count", F.lit(0)),
                "pages_with_images": F.when(F.size("pages_with_images") > 0, F.col("pages_with_images")),
            }
        )
    return joined.withColumns(
        {
            "has_images": F.col("image_count") > 0,
            "content_type": P.content_type(F.col("has_text"), F.col("image_count")),
        }
    )


METADATA_FIELDS = (
    "source", "has_text", "text_length", "character_count", "word_count", "has_images",
    "image_count", "content_type", "page_count", "pages_with_images", "page_spans",
)


def metadata_json() -> Column:
    """Metadata columns as JSON; optional fields are left out where absent."""
    return F.to_json(F.struct(*METADATA_FIELDS))


def bundle_json() -> Column:
    """Text, image metadata and metadata of a row as JSON.

    The row holds its images in ``images``, an array of structs with page and
    metadata.
    """
    images = F.transform(
        "images", lambda i: F.struct(i["page"].alias("page"), i["metadata"].alias("metadata"))
    )
    return F.to_json(
        F.struct("text", images.alias("images"), F.struct(*METADATA_FIELDS).alias("metadata"))
    )


IMAGE_ROWS = (
    "array<struct<image_idx:int,page:int,entries:array<struct<key:string,value:string>>>>"
)


def attach_images(docs: DataFrame, images: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add ``images``, the ordered image descriptions of a document, without pixels."""
    # Maps cannot be ordered, so they travel as entries while images are sorted.
    described = images.groupBy(key).agg(
        F.array_sort(
            F.collect_list(
                F.struct("image_idx", "page", F.map_entries("metadata").alias("entries"))
            )
        ).alias("_i")
    )
    restored = F.transform(
        F.coalesce("_i", F.array().cast(IMAGE_ROWS)),
        lambda i: F.struct(
            i["page"].alias("page"), F.map_from_entries(i["entries"]).alias("metadata")
        ),
    )
    return docs.join(described, key, "left").withColumn("images", restored).drop("_i")


def summarize_images(images: Column, chars: int = IMAGE_VALUE_CHARS) -> Column:
    """Numbered image descriptions as JSON, without streams; values are cut to ``chars``."""

    def kept(metadata: Column) -> Column:
        no_stream = F.map_filter(metadata, lambda k, _: F.lower(k) != "stream")
        return F.transform_values(no_stream, lambda _, v: F.substring(v, 1, chars))

    described = F.transform(
        images,
        lambda image, i: F.struct(
            (i + F.lit(1)).alias("index"),
            image["page"].alias("page"),
            F.when(F.size(kept(image["metadata"])) > 0, kept(image["metadata"])).alias("metadata"),
        ),
    )
    return F.when(F.size(images) > 0, F.to_json(described)).otherwise(NO_IMAGES_TEXT)
