"""Evidence entries, API result rows, history and dashboard tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tierglass.functions import labels as L
from tierglass.functions import pages as P
from tierglass.functions.membership import filter_of, with_probable
from tierglass.functions.once import with_once
from tierglass.functions.text import bind, collapse_whitespace, is_blank, strip
from tierglass.lexicon import EVIDENCE_CHARS, EVIDENCE_ENTRIES, HISTORY_ENTRIES, HISTORY_TABLE_ROWS

ENTRY_TYPE = (
    "array<struct<type:string,page:int,content:string,description:string,label:string,"
    "bbox:array<double>>>"
)
CHUNK_TYPE = "array<struct<page:int,content:string>>"
# Smallest fallback chunk and number of entries to reach with chunks.
MIN_CHUNK = 180
WANTED_ENTRIES = 3


def shorten(snippet: Column, chars: int | None = EVIDENCE_CHARS) -> Column:
    """Snippet on one line; longer than ``chars`` it ends in three dots. None keeps all of it."""
    clean = collapse_whitespace(strip(snippet))
    if chars is None:
        return clean
    return F.when(
        F.length(clean) > chars, F.concat(F.substring(clean, 1, chars - 3), F.lit("..."))
    ).otherwise(clean)


def _metadata_text(metadata: Column) -> Column:
    """Citation metadata as JSON text with a blank after separators."""

    def pair(name: str) -> Column:
        escaped = F.regexp_replace(metadata[name], r'(["\\])', r"\\$1")
        return F.when(
            metadata[name].isNotNull(), F.concat(F.lit(f'"{name}": "'), escaped, F.lit('"'))
        )

    names = ("label", "signal", "source_type")
    return F.concat(F.lit("{"), F.concat_ws(", ", *[pair(n) for n in names]), F.lit("}"))


def cited_entries(citations: Column, chars: int | None = EVIDENCE_CHARS) -> Column:
    """Text entries of the citations; a blank snippet shows its metadata instead."""

    def entry(c: Column) -> Column:
        blank = is_blank(c["snippet"])
        named = F.coalesce(
            F.nullif(c["metadata"]["signal"], F.lit("")), F.nullif(c["metadata"]["label"], F.lit(""))
        )
        return F.struct(
            F.lit("text").alias("type"),
            c["page"].alias("page"),
            F.when(blank, _metadata_text(c["metadata"]))
            .otherwise(shorten(c["snippet"], chars))
            .alias("content"),
            F.when(blank, F.coalesce(named, F.lit("Metadata"))).otherwise(named).alias("description"),
            c["metadata"]["label"].alias("label"),
            F.lit(None).cast("array<double>").alias("bbox"),
        )

    return F.transform(citations, entry).cast(ENTRY_TYPE)


def fallback_chunks(stripped: Column, spans: Column, needed: Column) -> Column:
    """Up to ``needed`` leading chunks of the text that are not blank, with their page."""

    def build(h: Column) -> Column:
        text, spans, needed = h["text"], h["spans"], h["needed"]
        size = F.greatest(F.lit(MIN_CHUNK), F.floor(F.length(text) / (needed + F.lit(1))).cast("int"))
        return bind(cut, text=text, spans=spans, needed=needed, size=size)

    def cut(h: Column) -> Column:
        def chunk(i: Column) -> Column:
            start = F.least(F.length(h["text"]), i * h["size"])
            return F.struct(
                P.page_of(h["spans"], start).alias("page"),
                strip(F.substring(h["text"], start + F.lit(1), h["size"])).alias("content"),
            )

        starts = F.sequence(F.lit(0), h["needed"] * F.lit(2) - F.lit(1))
        made = F.filter(F.transform(starts, chunk), lambda c: c["content"] != "")
        return F.slice(made, F.lit(1), h["needed"]).cast(CHUNK_TYPE)

    made = bind(build, text=stripped, spans=spans, needed=needed)
    none = F.array().cast(CHUNK_TYPE)
    return F.when((needed > 0) & (F.coalesce(stripped, F.lit("")) != ""), made).otherwise(none)


def usable_images(images: DataFrame) -> DataFrame:
    return images.filter(P.is_relevant_image(F.col("metadata")) & F.col("content").isNotNull())


def image_evidence(images: DataFrame, key: str = "doc_id", n: int = 2) -> DataFrame:
    """The first ``n`` relevant images of each document as entries.

    The row limit is applied before the shuffle as well, so a document with very
    many images sends only ``n`` of them per input partition.
    """
    usable = usable_images(images)
    order = W.partitionBy(key).orderBy("image_idx")
    first = usable.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n)
    meta = F.col("metadata")
    named = [F.nullif(F.try_element_at(meta, F.lit(k)), F.lit("")) for k in ("label", "name", "id")]
    box = F.from_json(F.try_element_at(meta, F.lit("bbox")), "array<double>")
    return first.select(
        key,
        "image_idx",
        F.lit("image").alias("type"),
        "page",
        P.data_url(F.col("content")).alias("content"),
        F.coalesce(*named, F.lit("Image snippet")).alias("description"),
        F.lit(None).cast("string").alias("label"),
        P.clamp_bbox(box).alias("bbox"),
    )


def evidence_entries(
    results: DataFrame,
    images: DataFrame | None = None,
    key: str = "doc_id",
    text: str = "text",
    spans: str = "page_spans",
    cap: int = EVIDENCE_ENTRIES,
    n_images: int = 2,
    chars: int | None = EVIDENCE_CHARS,
) -> DataFrame:
    """Replace the text of result rows by ``evidence``.

    Cited text comes first, then images, then text chunks until there are three
    entries. Rows that still need chunks, which are those with fewer than three
    citations, carry their text into the join with images; without images nothing
    is joined. :func:`evidence_by_images` keeps texts of documents without images out of it.
    """
    cited = results.withColumn("_cited", cited_entries(F.col("citations"), chars)).withColumn(
        "_text", F.when(F.size("_cited") < WANTED_ENTRIES, strip(F.coalesce(text, F.lit(""))))
    )
    narrow = cited.drop(text)
    if images is None:
        shown = narrow.withColumn("_images", F.array().cast(ENTRY_TYPE))
    else:
        entry = F.struct("image_idx", "type", "page", "content", "description", "label", "bbox")
        # At most ``n_images`` rows per document.
        per_doc = image_evidence(images, key, n_images).groupBy(key).agg(
            F.array_sort(F.collect_list(entry)).alias("_found")
        )
        entries = F.transform(
            "_found",
            lambda e: F.struct(*[e[c] for c in ("type", "page", "content", "description", "label", "bbox")]),
        ).cast(ENTRY_TYPE)
        shown = (
            narrow.join(per_doc, key, "left")
            .withColumn("_images", F.coalesce(entries, F.array().cast(ENTRY_TYPE)))
            .drop("_found")
        )
    shown = shown.withColumn("_given", F.concat("_cited", "_images"))
    needed = F.lit(WANTED_ENTRIES) - F.size("_given")
    chunks = F.transform(
        fallback_chunks(F.col("_text"), F.col(spans), needed),
        lambda c: F.struct(
            F.lit("text").alias("type"),
            c["page"].alias("page"),
            c["content"].alias("content"),
            F.lit(None).cast("string").alias("description"),
            F.lit(None).cast("string").alias("label"),
            F.lit(None).cast("array<double>").alias("bbox"),
        ),
    ).cast(ENTRY_TYPE)
    entries = F.slice(F.concat("_given", chunks), 1, cap)
    return with_once(shown, {"evidence": entries}).drop("_cited", "_text", "_images", "_given")


def evidence_by_images(
    docs: DataFrame,
    images: DataFrame,
    results_of: Callable[[DataFrame], DataFrame],
    key: str = "doc_id",
    **options,
) -> DataFrame:
    """:func:`evidence_entries` of ``results_of(docs)``, moving only texts of documents with images.

    A Bloom filter of the documents with a usable image, of at most 2^20 cells, parts the documents where
    they are scanned, so each is classified once; the scan runs for both parts. Those that the filter
    doesn't hold have no image and are joined with nothing.
    """
    with_images = filter_of(usable_images(images).select(key), [key])
    marked = with_probable(docs, with_images, [key], "_may")
    parts = [
        evidence_entries(results_of(marked.where(part).drop("_may")), shown, key, **options)
        for part, shown in (("NOT _may", None), ("_may", images))
    ]
    return parts[0].unionByName(parts[1])


def document_results(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """The API's 15-column result row.

    Needs a classified row with ``evidence``, page and image counts, and the
    report location.
    """
    return df.select(
        F.col(key).cast("string").alias("document_id"),
        "label",
        "score",
        "safety_flags",
        "verifier_agreement",
        "classification_id",
        "citations",
        "reports",
        L.api_category(F.col("label")).alias("category"),
        "page_count",
        "image_count",
        "evidence",
        L.content_safety(F.col("label"), F.col("safety_flags")).alias("content_safety"),
        "single_prompt",
        F.col("debug_info").alias("llm_debug"),
    )


def report_name(task: Column, document: Column) -> Column:
    """Where the report of a document lies below the folder of all reports."""

    def safe(name: Column) -> Column:
        encoded = F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))
        return F.when(encoded.isin(".", ".."), F.regexp_replace(encoded, r"\.", "%2E")).otherwise(encoded)

    return F.concat_ws("/", safe(task), safe(document), F.lit("report.json"))


def report_paths(folder: str, task: Column, document: Column) -> Column:
    """Where the report of a document is, as a map; ``write_report_files`` writes these files."""
    return F.create_map(F.lit("json"), F.concat(F.lit(f"{folder}/"), report_name(task, document)))


def with_bucket(results: DataFrame) -> DataFrame:
    return results.withColumn(
        "category_bucket", L.history_bucket(F.col("category"), F.col("label"))
    )


def history(
    results: DataFrame,
    n: int = HISTORY_ENTRIES,
    by: str | None = None,
    time: str = "timestamp",
    tie: str = "id",
) -> DataFrame:
    """The newest ``n`` results, overall or per value of ``by``, newest first.

    Per group the limit is also applied before the shuffle, so a large group is
    never gathered.
    """
    bucketed = with_bucket(results)
    newest = [F.desc(time), F.asc(tie)]
    if by is None:
        return bucketed.orderBy(*newest).limit(n)
    ranked = bucketed.withColumn("_rn", F.row_number().over(W.partitionBy(by).orderBy(*newest)))
    return ranked.filter(F.col("_rn") <= n).drop("_rn")


def history_table(entries: DataFrame, n: int = HISTORY_TABLE_ROWS) -> DataFrame:
    """First rows of the history as the dashboard shows them."""
    first = entries.orderBy(F.desc("timestamp"), "id").limit(n)
    return first.select(
        F.coalesce("document_name", F.lit("Document")).alias("document"),
        F.coalesce("category_bucket", L.bucket(F.col("label"))).alias("category"),
        F.format_string("%.2f", F.coalesce("score", F.lit(0.0))).alias("score"),
        F.coalesce("content_safety", F.lit("Unknown")).alias("safety"),
        F.when(F.col("single_prompt"), "Single Prompt").otherwise("Prompt Tree").alias("mode"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm").alias("run_at"),
    )


# Order of the buckets in the chart.
BUCKET_ORDER = ("Highly Sensitive", "Confidential", "Public")


def label_distribution(entries: DataFrame) -> DataFrame:
    """Entries per bucket that occurs, in chart order."""
    place = F.array_position(F.array(*[F.lit(b) for b in BUCKET_ORDER]), F.col("bucket"))
    return (
        entries.groupBy(L.history_bucket(F.col("category"), F.col("label")).alias("bucket"))
        .agg(F.count("*").alias("n"))
        .orderBy(place)
    )


def head_metrics(entries: DataFrame) -> DataFrame:
    """Number of entries, bucket of the newest one, and number of high-risk entries."""
    newest = F.max_by("category_bucket", F.struct("timestamp", -F.col("id")))
    return entries.agg(
        F.count("*").alias("total_docs"),
        F.coalesce(newest, F.lit("—")).alias("last_bucket"),
        F.count_if(F.startswith(F.lower("category_bucket"), F.lit("high"))).alias("high_risk"),
    )


def coerce_timestamp(value: Column) -> Column:
    """ISO text as a timestamp; anything else becomes the current time."""
    return F.coalesce(value.try_cast("timestamp_ntz"), F.localtimestamp())


def highlight_spans(
    results: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", colours: int = 5
) -> DataFrame:
    """Where each cited snippet first stands in the text, with a colour number.

    Positions are found in the row; only keys and numbers are exploded.
    """

    def located(c: Column, i: Column) -> Column:
        found = F.when(is_blank(c["snippet"]), F.lit(0)).otherwise(
            F.instr(F.col(text), c["snippet"])
        )
        return F.struct(
            (i + F.lit(1)).alias("citation"),
            (found - F.lit(1)).alias("start"),
            (found - F.lit(1) + F.length(c["snippet"])).alias("end"),
            F.pmod(i, F.lit(colours)).alias("colour"),
        )

    spans = F.filter(F.transform("citations", located), lambda s: s["start"] >= 0)
    return with_once(results, {"_spans": spans}).select(*keep, F.inline("_spans"))
