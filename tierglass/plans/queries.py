"""Registered queries: one function per operator, over the whole given tables.

Results are flat (arrays joined or exploded, numbers rounded) so that another
engine can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierglass.functions import answers as A
from tierglass.functions import labels as L
from tierglass.functions import pages as P
from tierglass.functions.text import snippet, strip
from tierglass.lexicon import CONFIGURED_SAFETY_KEYWORDS, DEFAULT_SAFETY_KEYWORDS
from tierglass.operators import answers as ans
from tierglass.operators import ask as asking
from tierglass.operators import evaluate as ev
from tierglass.operators import evidence as evi
from tierglass.operators import feedback as fb
from tierglass.operators import fusion as fu
from tierglass.operators import jobs as jb
from tierglass.operators import prepare as pr
from tierglass.operators import prompts as pm
from tierglass.operators import views as vw
from tierglass.plans import seeds
from tierglass.session import work_folder
from tierglass.sources import answer_cache as store
from tierglass.sources import documents as src
from tierglass.sources import report_files as rf
from tierglass.sources import sinks, trees
from tierglass.streaming import continuous as st

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TREE = {
    "name": "reach",
    "prompt": "Who may read this text? Name one of the four labels.",
    "children": [
        {"name": "rules", "prompt": "Which house rules does the text mention?"},
        {
            "name": "harm",
            "prompt": "What would leak if the text became public?",
            "children": [{"name": "danger", "prompt": "Does the text help anyone to do damage?"}],
        },
    ],
}
NODES = pm.flatten_tree(TREE)


def record_time() -> Column:
    return F.expr(seeds.RECORD_TIME)


def record_time_of(column: str) -> Column:
    return F.expr(seeds.RECORD_TIME.replace("doc_id", column))


def query(function: Query) -> Query:
    """Register a query under its own name, with rounded and widened numbers."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = function(spark, sf)
        columns = []
        for field in df.schema.fields:
            column = F.col(f"`{field.name}`")
            if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
                column = F.round(column.cast("double"), 6)
            elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
                column = column.cast("long")
            columns.append(column.alias(field.name))
        return df.select(*columns)

    run.__name__ = function.__name__
    run.__doc__ = function.__doc__
    QUERIES[function.__name__] = run
    return function


def joined(column: str | Column) -> Column:
    return F.array_join(column, "|")


# --- sources and sinks ---------------------------------------------------------


def routed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Web pages stored under file names of several types."""
    suffix = F.element_at(
        F.array(*[F.lit(s) for s in (".txt", ".PDF", ".png", ".bin", "", ".html.gz")]),
        (F.length("url") % 6 + 1).cast("int"),
    )
    path = F.concat(F.lit("/in/page"), F.col("page_id").cast("string"), suffix)
    return seeds.table(spark, sf, "pages").select("page_id", path.alias("source"), F.col("html").alias("text"))


@query
def s1_text_source(spark, sf):
    return seeds.documents(spark, sf).select(
        "doc_id", "source", F.length("text").alias("text_length"), F.md5("text").alias("digest")
    )


@query
def s1_read_files(spark, sf):
    """Texts written as one file each, next to a file of another type, and read as documents."""
    folder = work_folder(spark)
    rows = seeds.documents(spark, sf).select("doc_id", "text")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    name = F.concat(F.lit("doc_id="), key, F.format_string("/part-%05d.txt", F.spark_partition_id()))
    lines = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"))
    trees.write_texts(
        rows.sortWithinPartitions("doc_id").select(name.alias("name"), lines.alias("content")), f"{folder}/files"
    )
    rows.filter("doc_id % 100 = 0").select(F.lit("x").alias("value")).write.json(f"{folder}/files/other")
    read = src.read_documents(spark, f"{folder}/files").filter(~F.col("source").contains("/_SUCCESS"))
    number = F.regexp_extract("source", r"doc_id=(\d+)", 1).try_cast("long")
    found = read.withColumn("doc_id", number)
    return found.groupBy("doc_id").agg(
        F.max(F.length("text")).alias("text_length"), F.max(F.md5("text")).alias("digest")
    )


@query
def s2_type_routing(spark, sf):
    return routed_pages(spark, sf).select(
        "page_id", F.coalesce(src.mime_class(F.col("source")), F.lit("other")).alias("mime_class")
    )


@query
def s3_unsupported_type(spark, sf):
    routed = pr.split_pages(src.route(routed_pages(spark, sf)))
    return routed.select(
        "page_id",
        F.col("mime_class").isNotNull().alias("supported"),
        F.length("text").alias("text_length"),
        "page_count",
    )


def named_documents(spark: SparkSession, sf: str) -> DataFrame:
    name = (
        F.when(F.col("lang") == "en", F.concat(F.lit("memo."), F.col("doc_id"), F.lit(".md")))
        .when(F.col("lang") == "fr", F.lit(""))
        .when(F.col("lang") == "es", F.lit("notes"))
    )
    return seeds.documents(spark, sf).select("doc_id", name.alias("name"), "lang")


@query
def s4_inline_documents(spark, sf):
    return src.inline_documents(named_documents(spark, sf)).select("doc_id", "filename", "source")


@query
def s4_uploaded_documents(spark, sf):
    return src.uploaded_documents(named_documents(spark, sf)).select("doc_id", "filename", "source")


@query
def p10_metadata_defaults(spark, sf):
    given = named_documents(spark, sf).withColumn("source", F.when(F.col("lang") == "de", "/kept/source"))
    return src.inline_documents(given).select("doc_id", "filename", "source")


def classified(spark: SparkSession, sf: str, **options) -> DataFrame:
    return fu.classify(seeds.seeded(spark, sf), **options)


def engine(spark: SparkSession, sf: str) -> DataFrame:
    return fu.classify(
        seeds.seeded(spark, sf), seeds.responses(spark, sf), mode="engine", last_node=seeds.LAST_NODE
    )


def get(report: str, *paths: str) -> list[Column]:
    return [
        F.get_json_object(report, f"$.{p}").alias(p.replace(".", "_").replace("[0]", "")) for p in paths
    ]


@query
def s5_report_json(spark, sf):
    results = classified(spark, sf).withColumn("classification_id", F.col("doc_id"))
    report = results.select("doc_id", sinks.report_json(sinks.classifier_report()).alias("r"))
    return report.select(
        "doc_id",
        *get(
            "r", "label", "verifier_agreement", "citations[0].snippet", "citations[0].metadata.signal",
            "classification_id", "debug_info.primary.reason",
        ),
        F.get_json_object("r", "$.score").cast("double").alias("score"),
    )


@query
def s5_engine_report_json(spark, sf):
    report = fu.engine_results(engine(spark, sf)).select(
        "doc_id", sinks.report_json(sinks.engine_report()).alias("r")
    )
    return report.select(
        "doc_id",
        *get("r", "category", "agreement", "citations[0].source"),
        F.get_json_object("r", "$.confidence").cast("double").alias("confidence"),
    )


@query
def s5_download_json(spark, sf):
    results = api_results(spark, sf).withColumns(
        {
            "generated_at": fb.iso_time(F.expr("TIMESTAMP '2024-01-01 00:00:00'")),
            "document_name": F.concat(F.col("document_id"), F.lit(".txt")),
        }
    )
    report = results.select("document_id", sinks.report_json(sinks.download_report()).alias("r"))
    return report.select(
        "document_id",
        *get(
            "r", "label", "generated_at", "document_name", "category", "page_count",
            "content_safety", "evidence[0].content", "single_prompt_mode",
        ),
    )


@query
def s5_written_reports(spark, sf):
    """Reports written per task and read back."""
    results = classified(spark, sf, keep=("origin",)).withColumn("classification_id", F.col("doc_id"))
    folder = work_folder(spark)
    sinks.write_reports(results.withColumnRenamed("origin", "task_id"), folder)
    read = spark.read.schema("doc_id long, label string, score double, task_id string").json(folder)
    return read.select("doc_id", "task_id", "label", "score")


def bundled(spark: SparkSession, sf: str) -> DataFrame:
    meta = pr.document_metadata(
        seeds.seeded(spark, sf), seeds.images(spark, sf), keep=("source", "text")
    )
    return pr.attach_images(meta, seeds.images(spark, sf))


@query
def s6_bundle_json(spark, sf):
    bundle = bundled(spark, sf).select("doc_id", pr.bundle_json().alias("b"))
    return bundle.select(
        "doc_id",
        F.md5(F.get_json_object("b", "$.text")).alias("text_digest"),
        *get("b", "metadata.source", "metadata.word_count", "metadata.content_type", "images[0].page"),
    )


@query
def s8_history_export(spark, sf):
    """History exported as JSON lines and read back."""
    folder = work_folder(spark)
    sinks.export_history(fb.feedback_history(seeds.feedback(spark, sf), records(spark, sf)), folder)
    read = spark.read.schema(
        "classification_id long, document_path string, predicted_label string, score double, "
        "decision string, suggested_label string, comments string, quality_score double, "
        "created_at string"
    ).json(folder)
    return read


@query
def s9_evaluation_report(spark, sf):
    """Metrics and cases written as a report; every case is read back next to the metrics."""
    folder = work_folder(spark)
    report = case_rows(spark, sf)
    sinks.write_evaluation(ev.nested_metrics(ev.evaluate(report)), report, folder)
    metrics = spark.read.schema(
        "total_cases long, missing_results long, metrics struct<accuracy:double,latency_ms:struct<average:double,"
        "max:double>,safety:struct<flagged_cases:long,critical_detection_rate:double>>"
    ).json(f"{folder}/metrics")
    cases = spark.read.schema(
        "id string, expected_label string, predicted_label string, score double, safety_flags array<string>"
    ).json(f"{folder}/cases")
    return cases.join(F.broadcast(metrics)).select(
        "id",
        "expected_label",
        "predicted_label",
        "score",
        joined("safety_flags").alias("safety_flags"),
        "total_cases",
        "missing_results",
        F.col("metrics.accuracy").alias("accuracy"),
        F.col("metrics.latency_ms.average").alias("latency_average"),
        F.col("metrics.latency_ms.max").alias("latency_max"),
        F.col("metrics.safety.flagged_cases").alias("flagged_cases"),
        F.col("metrics.safety.critical_detection_rate").alias("critical_detection_rate"),
    )


@query
def s10_record_ids(spark, sf):
    return sinks.to_records(classified(spark, sf), record_time()).select(
        "id", "doc_id", "classification", "score"
    )


@query
def s10_appended_records(spark, sf):
    """Two runs appended to one table, then the first one again; it keeps its ids."""
    folder = work_folder(spark)
    # Kept narrow, so that the documents are classified once and not for every run.
    results = sinks.cut_lineage(classified(spark, sf).select("doc_id", "source", "label", "raw_score"))
    for run in ("first", "second", "first"):
        sinks.append_records(results, folder, run)
    return spark.read.parquet(folder).select("run", "document_path", "id", "classification")


@query
def s11_prompt_trace(spark, sf):
    expanded = pm.expand_prompts(seeds.documents(spark, sf).select("doc_id"), NODES)
    return expanded.select(
        "doc_id", "node_ord", sinks.trace_entry(F.col("name"), F.col("prompt")).alias("entry")
    )


@query
def s11_written_trace(spark, sf):
    """The trace as it stands on disk, line by line, after the run was written twice."""
    folder = work_folder(spark)
    for _ in range(2):
        sinks.write_trace(pm.expand_prompts(seeds.documents(spark, sf).select("doc_id"), NODES), folder, "traced")
    return spark.read.text(folder).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query
def s13_text_or_fallback(spark, sf):
    content = (
        F.when(F.col("lang") == "fr", F.encode("text", "UTF-8"))
        .when(F.col("lang") == "en", F.concat(F.unhex(F.lit("FF")), F.encode("text", "UTF-8")))
    )
    pasted = F.concat(F.lit(" \n"), "source", F.lit("\t "))
    return seeds.documents(spark, sf).select(
        "doc_id", F.md5(src.text_or_fallback(content, pasted)).alias("digest")
    )


# --- preparation -----------------------------------------------------------------


@query
def p1_form_feed_pages(spark, sf):
    return pr.split_pages(seeds.seeded(spark, sf)).select("doc_id", F.inline("page_spans"))


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    return seeds.table(spark, sf, "conversations")


@query
def p2_assemble_pages(spark, sf):
    whole = pr.assemble_pages(conversations(spark, sf), "conv_id", "turn")
    return whole.select("conv_id", F.md5("text").alias("digest"), "page_count")


@query
def p2_page_spans(spark, sf):
    whole = pr.assemble_pages(conversations(spark, sf), "conv_id", "turn")
    return whole.select("conv_id", F.inline("page_spans"))


@query
def p2_page_spans_in_parts(spark, sf):
    """Pages given in two parts: spans count through the whole document."""
    pages = conversations(spark, sf)
    parts = pages.filter("turn % 4 >= 2").unionByName(pages.filter("turn % 4 < 2"))
    return pr.assemble_pages(parts, "conv_id", "turn").select("conv_id", F.inline("page_spans"))


@query
def s13_joined_pages(spark, sf):
    whole = pr.assemble_pages(conversations(spark, sf), "conv_id", "turn", sep="\n")
    return whole.select("conv_id", F.md5("text").alias("digest"))


def metadata(spark: SparkSession, sf: str) -> DataFrame:
    return pr.document_metadata(seeds.seeded(spark, sf), seeds.images(spark, sf))


@query
def p3_metadata(spark, sf):
    return metadata(spark, sf).select(
        "doc_id", "source", "has_text", "text_length", "character_count", "word_count",
        "has_images", "image_count", "page_count",
    )


@query
def p4_content_type(spark, sf):
    return metadata(spark, sf).select("doc_id", "content_type")


@query
def p5_image_rollup(spark, sf):
    return metadata(spark, sf).select(
        "doc_id", "image_count", F.coalesce(F.array_join("pages_with_images", ","), F.lit("")).alias("pages")
    )


@query
def p6_detect_content_type(spark, sf):
    return pm.with_content_type(metadata(spark, sf)).select("doc_id", "content_type")


@query
def p7_page_count(spark, sf):
    declared = (
        F.when(F.col("word_count") % 3 == 0, F.col("page_count").cast("string"))
        .when(F.col("word_count") % 3 == 1, F.lit("many"))
        .otherwise(F.lit("-2"))
    )
    text = F.when(F.col("has_text"), "x").otherwise("")
    return metadata(spark, sf).select(
        "doc_id", P.page_count(declared, F.col("pages_with_images"), text).alias("page_count")
    )


@query
def p8_image_count(spark, sf):
    declared = (
        F.when(F.col("word_count") % 3 == 0, F.lit("5")).when(F.col("word_count") % 3 == 1, F.lit("-1"))
    )
    return metadata(spark, sf).select(
        "doc_id", P.image_count(declared, F.col("image_count")).alias("image_count")
    )


@query
def p9_offset_page(spark, sf):
    spanned = pr.split_pages(seeds.seeded(spark, sf)).withColumn(
        "offset", F.explode(F.array(F.lit(0), F.lit(99), F.lit(100), F.lit(101), F.length("text")))
    )
    return spanned.select("doc_id", "offset", P.page_of(F.col("page_spans"), F.col("offset")).alias("page"))


@query
def p9_offset_table(spark, sf):
    """The same offsets as a table of their own, met with a table of page spans."""
    pages = pr.split_pages(seeds.seeded(spark, sf))
    offsets = pages.select(
        "doc_id", F.explode(F.array(F.lit(0), F.lit(99), F.lit(100), F.lit(101), F.length("text"))).alias("offset")
    )
    spans = pages.select("doc_id", F.inline("page_spans"))
    return pr.pages_of_offsets(offsets, spans).select("doc_id", "offset", "page")


@query
def p11_image_relevance(spark, sf):
    return seeds.images(spark, sf).select(
        "doc_id", "image_idx", P.is_relevant_image(F.col("metadata")).alias("relevant")
    )


@query
def p12_image_boxes(spark, sf):
    """Boxes from the metadata of images, some out of bounds, too short or missing."""
    box = F.when(F.col("image_idx") == 0, F.concat(F.lit("[-0.5, 0.25, 1.5, "), F.col("doc_id") % 3 / F.lit(4.0), F.lit("]"))).when(
        F.col("image_idx") == 1, F.lit("[0.1, 0.2]")
    )
    images = seeds.images(spark, sf).withColumn(
        "metadata", F.when(box.isNull(), F.create_map(F.lit("score"), F.lit("1"))).otherwise(
            F.create_map(F.lit("score"), F.lit("1"), F.lit("bbox"), box)
        )
    )
    found = vw.image_evidence(images, n=3)
    return found.select(
        "doc_id", "image_idx", *[F.get("bbox", i).alias(n) for i, n in enumerate(("x", "y", "width", "height"))]
    )


@query
def p12_bounding_box(spark, sf):
    """Vectors as boxes: four values from most rows, three from the others."""
    box = F.transform(
        F.slice("embedding", 1, F.when(F.col("label") % 2 == 0, 4).otherwise(3)),
        lambda v: v.cast("double") * 5,
    )
    boxes = seeds.table(spark, sf, "embeddings").select("vec_id", P.clamp_bbox(box).alias("b"))
    return boxes.select(
        "vec_id", *[F.get("b", i).alias(n) for i, n in enumerate(("x", "y", "width", "height"))]
    )


@query
def p13_data_url(spark, sf):
    return seeds.images(spark, sf).select(
        "doc_id", "image_idx", P.data_url(F.col("content")).alias("url")
    )


@query
def p14_image_summary(spark, sf):
    return bundled(spark, sf).select("doc_id", pr.summarize_images(F.col("images")).alias("summary"))


# --- evidence ----------------------------------------------------------------------


def signals_of(rules) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = evi.extract_signals(seeds.seeded(spark, sf), rules, limit=None)
        rows = found.select("doc_id", F.posexplode("signals").alias("signal_ord", "s"))
        return rows.select("doc_id", "signal_ord", "s.*").drop("source_type")

    return run


for _name, _rules in {
    "e1_ssn_signals": evi.PATTERN_EVIDENCE[0:1],
    "e2_passport_signals": evi.PATTERN_EVIDENCE[1:2],
    "e3_card_signals": evi.PATTERN_EVIDENCE[2:3],
    "e4_bank_signals": evi.PATTERN_EVIDENCE[3:4],
    "e5_email_signals": evi.PATTERN_EVIDENCE[4:5],
    "e6_confidential_keywords": evi.CONFIDENTIAL_KEYWORD_EVIDENCE,
    "e7_unsafe_keywords": evi.UNSAFE_KEYWORD_EVIDENCE,
    "e9_uncapped_signals": evi.RULES,
}.items():
    _run = signals_of(_rules)
    _run.__name__ = _name
    query(_run)


@query
def e8_snippet(spark, sf):
    middle = F.floor(F.length("text") / 2).cast("int")
    return seeds.seeded(spark, sf).select(
        "doc_id", snippet(F.col("text"), middle, middle + F.lit(5)).alias("snippet")
    )


def evidence(spark: SparkSession, sf: str, **options) -> DataFrame:
    return fu.read_evidence(seeds.seeded(spark, sf), **options)


@query
def e9_capped_signals(spark, sf):
    return evidence(spark, sf).select(
        "doc_id",
        F.size("signals").alias("n_signals"),
        joined(F.transform("signals", lambda s: s["description"])).alias("descriptions"),
    )


@query
def e10_signals_table(spark, sf):
    return evi.explode_signals(evidence(spark, sf))


# --- classification scalars ----------------------------------------------------------


@query
def c1_keyword_class(spark, sf):
    return evidence(spark, sf).select("doc_id", "keyword.label", "keyword.score")


@query
def c2_keyword_reasoning(spark, sf):
    return evidence(spark, sf).select("doc_id", "keyword.reasoning")


@query
def c3_label_rank(spark, sf):
    r = L.rank(F.col("keyword.label"))
    return evidence(spark, sf).select("doc_id", r.alias("severity"), L.label_of(r).alias("label"))


@query
def c4_escalation(spark, sf):
    return evidence(spark, sf).select(
        "doc_id",
        F.col("keyword.label").alias("initial"),
        L.escalate(F.col("keyword.label"), F.col("signals")).alias("label"),
    )


@query
def c5_safety_flags(spark, sf):
    return evidence(spark, sf).select(
        "doc_id",
        *[
            joined(L.safety_flags(F.col("hits"), F.col("signals"), words)).alias(name)
            for name, words in (
                ("flags", DEFAULT_SAFETY_KEYWORDS), ("configured", CONFIGURED_SAFETY_KEYWORDS)
            )
        ],
    )


def odd_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as users and models may write them."""
    names = (" PUBLIC ", "Very Confidential", "Highly Sensitive", "high", "Unsafe", "", "Sensitive")
    label = F.get(F.array(*[F.lit(n) for n in names]), (F.col("n_chars") % 8).cast("int"))
    return seeds.documents(spark, sf).select("doc_id", label.alias("label"))


@query
def c6_api_category(spark, sf):
    return odd_labels(spark, sf).select("doc_id", L.api_category(F.col("label")).alias("category"))


@query
def c7_bucket(spark, sf):
    return odd_labels(spark, sf).select("doc_id", L.bucket(F.col("label")).alias("bucket"))


@query
def c8_content_safety(spark, sf):
    return classified(spark, sf).select(
        "doc_id", L.content_safety(F.col("label"), F.col("safety_flags")).alias("content_safety")
    )


# --- prompts and answers ------------------------------------------------------------------


@query
def m1_prompt_nodes(spark, sf):
    """The flattened tree as it is asked for every document."""
    expanded = pm.expand_prompts(seeds.documents(spark, sf).select("doc_id"), NODES)
    return expanded.select(
        "doc_id", "node_ord", "name", "depth", F.coalesce("parent", F.lit("")).alias("parent")
    )


@query
def m2_prompt_expansion(spark, sf):
    expanded = pm.expand_prompts(seeds.documents(spark, sf).select("doc_id"), NODES)
    return expanded.select("doc_id", "node_ord", "prompt")


def titled(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata with a title for some languages and the content type for prompts."""
    meta = pr.document_metadata(
        seeds.seeded(spark, sf), seeds.images(spark, sf), keep=("source", "lang")
    )
    return pm.with_content_type(meta).withColumns(
        {
            "title": F.when(F.col("lang") == "fr", F.concat(F.lit("Titre "), F.col("doc_id"))),
            "filename": F.when(F.col("lang") != "de", F.concat(F.col("doc_id"), F.lit(".txt"))),
        }
    )


@query
def m3_conditional_nodes(spark, sf):
    return pm.conditional_nodes(titled(spark, sf)).select("doc_id", "content_type", "name")


@query
def m4_rendered_prompts(spark, sf):
    rendered = pm.conditional_nodes(titled(spark, sf), slots=pm.metadata_slots())
    return rendered.select("doc_id", "name", "prompt")


@query
def m5_prompt_text(spark, sf):
    text = pm.prompt_text(titled(spark, sf), NODES, slots=pm.metadata_slots())
    return text.select("doc_id", F.md5("prompt_text").alias("digest"), F.length("prompt_text").alias("n"))


@query
def m6_single_prompt(spark, sf):
    expanded = pm.expand_prompts(seeds.documents(spark, sf).select("doc_id"), pm.SINGLE_PROMPT)
    return expanded.select("doc_id", "name", "prompt", F.lit(True).alias("single_prompt"))


@query
def m7_composed_prompt(spark, sf):
    meta = F.when(F.col("lang") != "none", F.to_json(F.struct("lang")))
    prompt = pm.compose_prompt(
        F.lit("  Task. "), F.col("text"), meta, F.lit("no images"), instruction="Instruction."
    )
    return seeds.seeded(spark, sf).select("doc_id", F.md5(prompt).alias("digest"), F.length(prompt).alias("n"))


@query
def m7_composed_prompt_whole(spark, sf):
    """Prompts that carry every text to its end."""
    prompt = pm.compose_prompt(
        F.lit("Task."), F.col("text"), F.lit(None).cast("string"), F.lit("no images"), instruction="Instruction.",
        max_chars=None,
    )
    return seeds.seeded(spark, sf).select("doc_id", F.md5(prompt).alias("digest"), F.length(prompt).alias("n"))


@query
def m8_cache_key(spark, sf):
    digest = ans.content_digest(F.col("text"), F.to_json(F.struct("lang")))
    docs = seeds.seeded(spark, sf).select("doc_id", digest.alias("digest"))
    return pm.expand_prompts(docs, NODES).select(
        "doc_id", "node_ord", ans.cache_key(F.col("digest"), F.col("prompt")).alias("prompt_hash")
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every document asked every node, keyed by content."""
    digest = ans.content_digest(F.col("text"), F.to_json(F.struct("lang")))
    docs = seeds.seeded(spark, sf).select("doc_id", digest.alias("digest"))
    keyed = pm.expand_prompts(docs, NODES)
    return keyed.select(
        "doc_id", "node_ord", F.lit("alpha").alias("model"),
        ans.cache_key(F.col("digest"), F.col("prompt")).alias("prompt_hash"),
    )


def cache_writes(spark: SparkSession, sf: str, minutes: int) -> DataFrame:
    """Answers stored for the documents that reviewers labelled."""
    known = seeds.table(spark, sf, "labels").select("doc_id", "toxic")
    return requests(spark, sf).join(known, "doc_id").select(
        "model",
        "prompt_hash",
        F.when(F.col("toxic") == 1, "Unsafe").otherwise("Public").alias("label"),
        F.lit(0.5 + minutes / 100).alias("score"),
        F.concat(F.lit("stored "), F.lit(minutes)).alias("reasoning"),
        F.lit("{}").alias("raw_response"),
        (F.expr("TIMESTAMP '2024-01-01 00:00:00'") + F.expr(f"INTERVAL {minutes} MINUTE")).alias("updated_at"),
        (F.col("toxic") == 1).alias("fallback"),
    )


def cache(spark: SparkSession, sf: str) -> DataFrame:
    empty = cache_writes(spark, sf, 1).filter(F.lit(False))
    return ans.cache_upsert(empty, cache_writes(spark, sf, 1))


@query
def m9_cache_hits(spark, sf):
    hits, _ = ans.cache_split(requests(spark, sf), cache(spark, sf))
    replayed = ans.cached_answers(hits)
    return replayed.select("doc_id", "node_ord", "score", "backend")


@query
def m9_cache_misses(spark, sf):
    _, misses = ans.cache_split(requests(spark, sf), cache(spark, sf))
    return misses.select("doc_id", "node_ord", "model")


@query
def m9_replayed_answers(spark, sf):
    """Documents classified with the stored answers, the others by keyword class."""
    hits, _ = ans.cache_split(requests(spark, sf), cache(spark, sf))
    answers = ans.cached_answers(hits).withColumn("role", F.lit("primary"))
    results = classified(spark, sf, answers=answers, parsed=True)
    primary = F.col("debug_info.primary")
    return results.select(
        "doc_id", "label", "raw_score", primary["backend"].alias("backend"),
        primary["fallback"].alias("fallback"),
    )


@query
def m10_cache_upsert(spark, sf):
    merged = ans.cache_upsert(cache_writes(spark, sf, 1), cache_writes(spark, sf, 2))
    return merged.groupBy("model", "reasoning", "score").agg(F.count("*").alias("n"))


@query
def m10_cache_entries(spark, sf):
    """Every entry by its key: the last write of each."""
    merged = ans.cache_upsert(cache_writes(spark, sf, 1), cache_writes(spark, sf, 2))
    return merged.select("model", "prompt_hash", "reasoning", "score")


@query
def m10_stored_cache(spark, sf):
    """A stored cache after an upsert of the answers that were toxic; every entry."""
    folder = work_folder(spark)
    store.store_answers(cache_writes(spark, sf, 1), folder)
    store.store_answers(cache_writes(spark, sf, 2).where("label = 'Unsafe'"), folder)
    return store.stored_answers(spark, folder).select("model", "prompt_hash", "label", "reasoning", "score")


@query
def m9_stored_lookup(spark, sf):
    """Requests met with the entries that the stored cache gives for them."""
    folder = work_folder(spark)
    store.store_answers(cache_writes(spark, sf, 1), folder)
    asked = sinks.cut_lineage(requests(spark, sf))
    hits, misses = ans.cache_split(asked, store.stored_answers(spark, folder, asked))
    found = hits.select("doc_id", "node_ord", "score", F.lit("cache").alias("backend"))
    return found.unionByName(
        misses.select("doc_id", "node_ord", F.lit(None).cast("double").alias("score"), F.lit("model").alias("backend"))
    )


@query
def m10_cache_without_fallbacks(spark, sf):
    merged = ans.cache_upsert(
        cache_writes(spark, sf, 1), cache_writes(spark, sf, 2), cache_fallbacks=False
    )
    return merged.groupBy("model", "reasoning").agg(F.count("*").alias("n"))


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    return ans.parse_responses(seeds.responses(spark, sf))


KEY = ("doc_id", "role", "node_ord")


@query
def m11_json_block(spark, sf):
    return seeds.responses(spark, sf).select(*KEY, A.json_block(F.col("raw_response")).alias("block"))


@query
def m12_json_fields(spark, sf):
    data = seeds.responses(spark, sf).select(
        *KEY, A.json_data(F.col("raw_response")).alias("data")
    )
    fields = data.select(
        *KEY,
        *[
            A.first_truthy([A.json_field(F.col("data"), k) for k in keys]).alias(name)
            for name, keys in (
                ("l", A.LABEL_KEYS), ("c", A.CONFIDENCE_KEYS), ("r", A.REASONING_KEYS)
            )
        ],
    )
    return fields.select(
        *KEY, F.col("l.value").alias("label"), F.col("c.value").try_cast("double").alias("confidence"),
        F.col("r.value").alias("reasoning"),
    )


@query
def m13_label_in_text(spark, sf):
    return seeds.responses(spark, sf).select(*KEY, A.label_in_text(F.col("raw_response")).alias("label"))


@query
def m14_m15_closest_label(spark, sf):
    label = A.closest_label(A.normalise_label(F.coalesce("label", F.lit("nda_draft"))))
    return odd_labels(spark, sf).select("doc_id", label.alias("label"))


@query
def m16_confidence(spark, sf):
    return parsed(spark, sf).select(*KEY, "score")


@query
def m17_reasoning(spark, sf):
    return parsed(spark, sf).select(*KEY, "label", "reasoning", "blank", "parse_error")


def keyword_docs(spark: SparkSession, sf: str) -> DataFrame:
    return evidence(spark, sf).select("doc_id", "keyword")


@query
def m18_fallback(spark, sf):
    filled = ans.with_fallback(ans.last_answer(seeds.responses(spark, sf)), keyword_docs(spark, sf))
    return filled.select("doc_id", "role", "label", "score", "fallback", "reason")


@query
def m19_last_node(spark, sf):
    return ans.last_answer(seeds.responses(spark, sf)).select("doc_id", "role", "node_ord", "label", "score")


@query
def m20_debug(spark, sf):
    results = classified(spark, sf, answers=seeds.responses(spark, sf))
    primary = F.col("debug_info.primary")
    return results.select(
        "doc_id", primary["model"].alias("model"), primary["fallback"].alias("fallback"),
        primary["reason"].alias("reason"), primary["last_confidence"].alias("last_confidence"),
    )


@query
def u1_inference(spark, sf):
    """The inference hook with a function that reads the prompt, and sometimes fails."""

    def stub(model: str, prompt: str) -> str:
        body = prompt.split("Document Text:\n", 1)[1].lower()
        if "malware" in body:
            raise RuntimeError("refused")
        return '{"label": "Confidential", "score": 0.7}' if "nda" in body else "Public"

    docs = seeds.seeded(spark, sf)
    full = pm.compose_prompt(F.lit("Classify."), F.col("text"), F.lit(None).cast("string"), F.lit("none"), max_chars=None)
    prompts = docs.select("doc_id", F.lit("primary").alias("role"), F.lit("stub").alias("model"),
                          F.lit(0).alias("node_ord"), full.alias("full_prompt"))
    answers = ans.parse_responses(ans.infer(prompts, stub))
    return answers.select("doc_id", "label", "score", "error")


def stub_model(model: str, prompt: str) -> str:
    """Stands for a model: reads the document part of its prompt, and refuses some."""
    body = prompt.split("Document Text:\n", 1)[1].lower()
    if "malware" in body:
        raise RuntimeError("refused")
    return '{"label": "Confidential", "score": 0.7}' if "nda" in body else "Public"


def empty_cache(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [], "model string, prompt_hash string, label string, score double, reasoning string, raw_response string, "
        "updated_at timestamp",
    )


@query
def m9_m10_ask(spark, sf):
    """Every node asked twice: the first time by inference, then from the cache alone."""
    docs, models = seeds.seeded(spark, sf), {"primary": "stub"}
    first, stored = asking.ask(docs, NODES, empty_cache(spark), stub_model, models, max_chars=None)
    second, _ = asking.ask(docs, NODES, sinks.cut_lineage(stored), no_model, models, max_chars=None)
    again = second.select("doc_id", "node_ord", F.col("label").alias("stored_label"), F.col("backend").alias("then"), F.col("error").alias("later_error"))
    return first.join(again, ["doc_id", "node_ord"]).select(
        "doc_id", "node_ord", "label", "score", "error", "backend", "stored_label", "then", "later_error"
    )


@query
def m9_m10_ask_stored(spark, sf):
    """Every node asked twice over one stored cache: by inference, then without any."""
    docs, models, folder = seeds.seeded(spark, sf), {"primary": "stub"}, work_folder(spark)
    first = asking.ask_stored(docs, NODES, folder, stub_model, models, max_chars=None)
    second = asking.ask_stored(docs, NODES, folder, no_model, models, max_chars=None)
    again = second.select("doc_id", "node_ord", F.col("label").alias("stored_label"), F.col("backend").alias("then"), F.col("error").alias("later_error"))
    return first.join(again, ["doc_id", "node_ord"]).select(
        "doc_id", "node_ord", "label", "score", "error", "backend", "stored_label", "then", "later_error"
    )


def no_model(model: str, prompt: str) -> str:
    raise RuntimeError("nothing should be asked")


@query
def f8_classify_single_prompt(spark, sf):
    """Both models asked the single prompt, and their answers fused."""
    docs = seeds.seeded(spark, sf)
    models = {"primary": "stub", "secondary": "other"}
    answers, _ = asking.ask(docs, pm.SINGLE_PROMPT, empty_cache(spark), stub_model, models, max_chars=None)
    results = classified(spark, sf, answers=answers, parsed=True)
    return results.select("doc_id", "label", "raw_score", F.col("debug_info.primary.fallback").alias("fallback"))


# --- fusion ---------------------------------------------------------------------------------


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    both = keyword_docs(spark, sf).join(ans.pair_answers(seeds.responses(spark, sf)), "doc_id", "left")
    p = ans.fall_back(F.col("primary"), F.col("keyword"), "engine_unavailable")
    s = F.when(F.col("secondary").isNotNull(), ans.fall_back(F.col("secondary"), F.col("keyword"), None))
    return both.select("doc_id", p.alias("p"), s.alias("s"))


@query
def f1_pairing(spark, sf):
    other = F.coalesce("s", "p")
    return pairs(spark, sf).select(
        "doc_id", F.col("p.label").alias("primary_label"), other["label"].alias("secondary_label"),
        (F.col("p.label") == other["label"]).alias("agreement"),
    )


@query
def f2_more_severe(spark, sf):
    other = F.coalesce("s", "p")
    return pairs(spark, sf).select("doc_id", L.resolve(F.col("p.label"), other["label"]).alias("label"))


@query
def f3_classifier_score(spark, sf):
    return pairs(spark, sf).select("doc_id", fu.fuse(F.col("p"), F.col("s"))["score"].alias("score"))


@query
def f4_engine_score(spark, sf):
    fused = fu.fuse(F.col("p"), F.col("s"), "engine")
    return pairs(spark, sf).select("doc_id", fused["score"].alias("score"))


@query
def f5_model_outputs(spark, sf):
    outputs = engine(spark, sf).select("doc_id", F.explode("model_outputs").alias("model", "o"))
    return outputs.select("doc_id", "model", "o.category", "o.confidence")


@query
def f6_f7_citations(spark, sf):
    cited = classified(spark, sf).select("doc_id", F.posexplode("citations").alias("ord", "c"))
    return cited.select(
        "doc_id", (F.col("ord") + 1).alias("ord"), "c.source", "c.page", "c.snippet", "c.confidence",
        "c.metadata.label", "c.metadata.signal",
    )


@query
def f8_classify(spark, sf):
    """Flagship: every document labelled by keyword class and evidence."""
    return classified(spark, sf).select(
        "doc_id",
        "label",
        "raw_score",
        F.size("signals").alias("n_signals"),
        F.get("signals", 0)["description"].alias("first_signal"),
        joined("safety_flags").alias("safety_flags"),
        F.size("citations").alias("n_citations"),
    )


@query
def f8_classify_uncapped(spark, sf):
    """Every signal counts, so none hides a more severe one."""
    return classified(spark, sf, limit=None).select(
        "doc_id", "label", F.size("signals").alias("n_signals"), joined("safety_flags").alias("safety_flags")
    )


@query
def f8_classify_assembled(spark, sf):
    """One label per document made of page rows, with the pages that signals stand on."""
    pages = conversations(spark, sf).withColumn("text", F.expr(seeds.SEEDED_TURN))
    docs = pr.assemble_pages(pages, "conv_id", "turn").withColumn("source", F.lit("conversation"))
    results = fu.classify(docs, key="conv_id", spans="page_spans")
    return results.select(
        "conv_id", "label", F.size("signals").alias("n_signals"), joined("safety_flags").alias("safety_flags"),
        F.array_join(F.transform("signals", lambda s: F.coalesce(s["page"].cast("string"), F.lit("-"))), "|").alias("pages"),
    )


@query
def f8_classify_with_answers(spark, sf):
    results = classified(spark, sf, answers=seeds.responses(spark, sf), last_node=seeds.LAST_NODE)
    return results.select(
        "doc_id", "label", "raw_score", "verifier_agreement", joined("safety_flags").alias("safety_flags")
    )


@query
def f9_engine(spark, sf):
    results = fu.engine_results(engine(spark, sf))
    return results.select(
        "doc_id", "category", "confidence", "agreement", F.size("citations").alias("n_citations"),
        F.get("citations", 0)["confidence"].alias("first_confidence"),
    )


def evidence_rows(spark: SparkSession, sf: str, images: bool = False) -> DataFrame:
    def results_of(docs: DataFrame) -> DataFrame:
        return fu.classify(pr.split_pages(docs), keep=("text", "page_spans", "page_count"), spans="page_spans")

    docs = seeds.seeded(spark, sf)
    if images:
        return vw.evidence_by_images(docs, seeds.images(spark, sf), results_of)
    return vw.evidence_entries(results_of(docs))


def api_results(spark: SparkSession, sf: str, images: bool = False) -> DataFrame:
    entries = evidence_rows(spark, sf, images)
    counted = F.lit(0)
    if images:
        entries = entries.join(pr.image_rollup(seeds.images(spark, sf)), "doc_id", "left")
        declared = F.when(F.col("doc_id") % 5 == 0, F.lit("7"))
        counted = P.image_count(declared, F.coalesce("image_count", F.lit(0)))
    rows = entries.withColumns(
        {
            "classification_id": F.col("doc_id"),
            "image_count": counted,
            "single_prompt": F.lit(False),
            "reports": vw.report_paths("/reports", F.lit("task"), F.col("doc_id").cast("string")),
        }
    )
    return vw.document_results(rows)


@query
def f10_api_results(spark, sf):
    return api_results(spark, sf).select(
        "document_id", "label", "score", joined("safety_flags").alias("safety_flags"),
        "verifier_agreement", "classification_id", F.size("citations").alias("n_citations"),
        F.col("reports")["json"].alias("report"), "category", "page_count", "image_count",
        F.size("evidence").alias("n_evidence"), "content_safety", "single_prompt",
    )


@query
def f10_followed_reports(spark, sf):
    """Every report file that the API results name, read back."""
    folder = work_folder(spark)
    results = classified(spark, sf).withColumns({"classification_id": F.col("doc_id"), "task_id": F.lit("task")})
    written = rf.write_report_files(results, folder)
    read = rf.read_report_files(spark, folder).withColumn("path", F.concat(F.lit(f"{folder}/"), "name"))
    followed = written.select("doc_id", F.col("reports")["json"].alias("path")).join(read, "path", "full")
    return followed.select(
        "doc_id",
        F.expr(f"substring(path, {len(folder) + 1})").alias("name"),
        *get("content", "label", "citations[0].snippet"),
        F.get_json_object("content", "$.score").cast("double").alias("score"),
    )


# --- views ---------------------------------------------------------------------------------------


@query
def f10_api_results_with_images(spark, sf):
    """Results of documents with images: counts, declared or found, and image entries."""
    return api_results(spark, sf, images=True).select(
        "document_id", "label", "image_count",
        F.size(F.filter("evidence", lambda e: e["type"] == "image")).alias("n_images"),
    )


@query
def v1_evidence_entries(spark, sf):
    entries = evidence_rows(spark, sf).select("doc_id", F.posexplode("evidence").alias("pos", "e"))
    return entries.select("doc_id", "pos", "e.type", "e.page", "e.content", "e.description", "e.label")


@query
def v1_evidence_with_images(spark, sf):
    entries = evidence_rows(spark, sf, images=True).select("doc_id", F.posexplode("evidence").alias("pos", "e"))
    return entries.select("doc_id", "pos", "e.type", "e.page", F.md5("e.content").alias("digest"))


@query
def v2_fallback_chunks(spark, sf):
    docs = pr.split_pages(seeds.seeded(spark, sf)).withColumn("stripped", strip(F.col("text")))
    chunks = vw.fallback_chunks(F.col("stripped"), F.col("page_spans"), F.lit(3))
    made = docs.select("doc_id", F.posexplode(chunks).alias("pos", "c"))
    return made.select("doc_id", "pos", "c.page", "c.content")


@query
def v3_image_evidence(spark, sf):
    found = vw.image_evidence(seeds.images(spark, sf))
    return found.select("doc_id", "image_idx", "page", "content", "description", F.get("bbox", 3).alias("height"))


def results_table(spark: SparkSession, sf: str) -> DataFrame:
    """Classified documents as dashboard rows."""
    results = classified(spark, sf, keep=("origin",))
    return results.select(
        F.col("doc_id").alias("id"),
        "origin",
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("document_name"),
        record_time().alias("timestamp"),
        "label",
        L.api_category(F.col("label")).alias("category"),
        "score",
        L.content_safety(F.col("label"), F.col("safety_flags")).alias("content_safety"),
        (F.col("origin") == "src3").alias("single_prompt"),
    )


@query
def v4_history(spark, sf):
    return vw.history(results_table(spark, sf)).select("id", "label", "category_bucket")


@query
def v4_history_by_source(spark, sf):
    entries = vw.history(results_table(spark, sf), by="origin")
    return entries.select("origin", "id", "category_bucket")


@query
def v5_history_table(spark, sf):
    return vw.history_table(vw.with_bucket(results_table(spark, sf)))


@query
def v6_label_distribution(spark, sf):
    return vw.label_distribution(results_table(spark, sf))


@query
def v7_head_metrics(spark, sf):
    return vw.head_metrics(vw.with_bucket(results_table(spark, sf)))


@query
def v8_timestamp(spark, sf):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    given = F.when(F.col("event_type") == "error", F.lit("no time")).otherwise(text)
    coerced = vw.coerce_timestamp(given)
    return seeds.table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") != "error", F.date_format(coerced, "yyyy-MM-dd HH:mm:ss")).alias("at"),
        coerced.isNotNull().alias("known"),
    )


@query
def v10_highlight_spans(spark, sf):
    results = classified(spark, sf, keep=("text",))
    return vw.highlight_spans(results)


# --- feedback -------------------------------------------------------------------------------------


def records(spark: SparkSession, sf: str) -> DataFrame:
    return classified(spark, sf).select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("document_path"),
        F.col("label").alias("classification"),
        F.col("raw_score").alias("score"),
        record_time().alias("created_at"),
    )


def statistics(spark: SparkSession, sf: str) -> DataFrame:
    return fb.label_statistics(seeds.feedback(spark, sf), records(spark, sf))


@query
def h1_feedback_accepted(spark, sf):
    valid, _ = fb.add_feedback(seeds.feedback(spark, sf), records(spark, sf))
    return valid.select("id", "classification_id", "reviewer", "decision")


@query
def h1_feedback_rejected(spark, sf):
    _, rejects = fb.add_feedback(seeds.feedback(spark, sf), records(spark, sf))
    return rejects.select("id", "reviewer", "decision", "error")


@query
def h1_appended_feedback(spark, sf):
    """Feedback of two runs stored with ids, the first run twice, and its misclassifications."""
    folder = work_folder(spark)
    given = seeds.feedback(spark, sf).withColumn("key", F.col("id"))
    known = sinks.cut_lineage(records(spark, sf))
    for run in ("first", "second", "first"):
        part = given.filter("key % 2 = 0" if run == "first" else "key % 2 <> 0")
        sinks.append_feedback(part, known, folder, run, "key", record_time_of("classification_id"))
    stored = sinks.stored_feedback(spark, folder)
    wrong = sinks.stored_misclassifications(spark, folder).select("run", "id", "expected_label")
    return stored.join(wrong, ["run", "id"], "left").select(
        "run", "id", "classification_id", "reviewer", "decision", "expected_label",
        fb.iso_time(F.col("created_at")).alias("created_at"),
    )


@query
def h2_list_feedback(spark, sf):
    return fb.list_feedback(seeds.feedback(spark, sf)).select("id", "classification_id", "comments")


@query
def h2_list_feedback_of_one(spark, sf):
    return fb.list_feedback(seeds.feedback(spark, sf), 4).select("id", "classification_id", "comments")


@query
def h3_misclassifications(spark, sf):
    return fb.misclassifications(seeds.feedback(spark, sf), records(spark, sf)).select(
        "id", "classification_id", "expected_label", "reviewer_notes"
    )


@query
def h4_label_statistics(spark, sf):
    return statistics(spark, sf)


@query
def h5_recalibration(spark, sf):
    """Results stored once, the statistics of their feedback, and the scores these give."""
    stored = sinks.cut_lineage(classified(spark, sf).select("doc_id", "label", "raw_score"))
    known = stored.select(F.col("doc_id").alias("id"), F.col("label").alias("classification"))
    return fb.recalibrate(stored, fb.label_statistics(seeds.feedback(spark, sf), known))


@query
def h6_feedback_history(spark, sf):
    return fb.feedback_history(seeds.feedback(spark, sf), records(spark, sf))


def thresholds(known: DataFrame) -> DataFrame:
    """One starting threshold per label, the mean score of its documents."""
    return known.groupBy(
        F.replace(F.lower("classification"), F.lit(" "), F.lit("_")).alias("key")
    ).agg(F.avg("score").alias("value"))


@query
def h7_thresholds(spark, sf):
    known = sinks.cut_lineage(records(spark, sf))
    return fb.update_thresholds(thresholds(known), fb.label_statistics(seeds.feedback(spark, sf), known))


def document_prompts(spark: SparkSession, sf: str) -> DataFrame:
    old = F.concat("source", F.when(F.col("lang") == "en", F.lit("\n\n# HITL Adjustments\nold notes")).otherwise(""))
    return seeds.documents(spark, sf).select("doc_id", old.alias("prompt"))


@query
def h8_prompt_annotation(spark, sf):
    return fb.annotate_prompt(document_prompts(spark, sf), statistics(spark, sf))


@query
def h9_refine(spark, sf):
    """New thresholds, and every annotated prompt by content, from one set of records."""
    known = sinks.cut_lineage(records(spark, sf))
    updated, prompts = fb.refine(thresholds(known), document_prompts(spark, sf), seeds.feedback(spark, sf), known)
    moved = F.array_join(F.array_sort(F.collect_list(F.format_string("%s=%.6f", "key", "value"))), ",")
    return prompts.select("doc_id", F.md5("prompt").alias("digest")).withColumn(
        "thresholds", updated.agg(moved.alias("m")).scalar()
    )


@query
def h10_old_feedback(spark, sf):
    """Feedback from a table that lacks the newer columns, next to current rows."""
    current = seeds.feedback(spark, sf)
    old = fb.align_columns(current.drop("suggested_label", "quality_score", "created_at"))
    both = old.unionByName(fb.align_columns(current))
    return both.groupBy("decision").agg(
        F.count("*").alias("n"), F.count("suggested_label").alias("n_suggested"),
        F.sum("quality_score").alias("quality"),
    )


# --- evaluation and jobs -----------------------------------------------------------------------------


def case_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every case with the result and the latency of its document."""
    timed = classified(spark, sf).join(
        seeds.outcomes(spark, sf).select("doc_id", "latency_ms"), "doc_id", "left"
    )
    return ev.case_report(seeds.cases(spark, sf), timed)


@query
def q1_case_report(spark, sf):
    return case_rows(spark, sf).select(
        "id", "expected_label", "predicted_label", "score", "latency_ms", "verifier_agreement",
        joined("safety_flags").alias("safety_flags"), "answered",
    )


@query
def q1_missing_results(spark, sf):
    """Cases that name a document, next to cases that name none: the latter have no result."""
    unknown = seeds.cases(spark, sf).withColumns(
        {"case_id": F.concat(F.lit("unknown-"), "case_id"), "doc_id": F.col("doc_id") + F.lit(9_000_000_000)}
    )
    results = classified(spark, sf)
    report = ev.case_report(seeds.cases(spark, sf).unionByName(unknown), results)
    metrics = ev.evaluate(report).select("total_cases", "missing_results", "accuracy", "critical_detection_rate")
    return report.join(F.broadcast(metrics)).select(
        "id", "predicted_label", "answered", joined("safety_flags").alias("safety_flags"),
        "total_cases", "missing_results", "accuracy", "critical_detection_rate",
    )


def metric(*names: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return ev.evaluate(case_rows(spark, sf)).select(*names)

    return run


for _name, _metrics in {
    "q2_accuracy": ("accuracy",),
    "q3_latency": ("latency_average", "latency_max", "latency_min"),
    "q4_flagged": ("flagged_cases", "flagged_rate"),
    "q5_critical_detection": ("critical_cases", "critical_detection_rate"),
    "q6_expected_flags": ("expected_flag_match_rate",),
}.items():
    _run = metric(*_metrics)
    _run.__name__ = _name
    query(_run)


@query
def q7_benchmark(spark, sf):
    return ev.evaluate(case_rows(spark, sf))


@query
def j1_job_validation(spark, sf):
    """One request per conversation for its turns' documents, some of them unknown."""
    checked = jb.validate_jobs(requested_jobs(spark, sf), seeds.documents(spark, sf))
    return checked.select("task_id", "status", F.coalesce("error", F.lit("")).alias("error"))


@query
def j7_job_run(spark, sf):
    """The same requests run: status of every task, and the labels of its reports."""
    folder = work_folder(spark)
    status, _ = jb.run_jobs(requested_jobs(spark, sf), seeds.seeded(spark, sf), folder)
    reports = spark.read.schema("_doc string, label string, task_id long").json(folder)
    labels = reports.groupBy("task_id").agg(F.count("*").alias("n"), F.max("label").alias("last_label"))
    return status.join(labels, "task_id", "left").select(
        "task_id", "status", "progress", F.coalesce("error", F.lit("")).alias("error"), "n", "last_label"
    )


def requested_jobs(spark: SparkSession, sf: str) -> DataFrame:
    turns = seeds.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("task_id"),
        F.when(F.col("role") == "assistant", F.col("turn") - 100).otherwise(F.col("conv_id")).alias("doc"),
        "turn",
    )
    # A conversation has at most a few turns; this builds the requests, not the check.
    return turns.groupBy("task_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("turn", F.col("doc").cast("string").alias("doc")))),
            lambda t: t["doc"],
        ).alias("doc_ids"),
        F.max(F.when(F.col("task_id") % 10 == 3, "pasted")).alias("text"),
    )


def ordered_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return seeds.outcomes(spark, sf).withColumn("ord", F.struct("ts", "event_id"))


@query
def j2_task_status(spark, sf):
    tasks = seeds.table(spark, sf, "customer").select(F.col("c_custkey").alias("task_id"))
    every = tasks.unionByName(seeds.outcomes(spark, sf).select("task_id")).distinct()
    return jb.task_status(ordered_outcomes(spark, sf), every)


@query
def j3_task_results(spark, sf):
    return jb.task_results(ordered_outcomes(spark, sf)).select("task_id", "doc_id")


#: Bytes of values in a file that arrives at a stream, and in a part of it that one task can read.
ARRIVING_BYTES, PART_BYTES = 1 << 28, 1 << 24


def write_arriving(rows: DataFrame, path: str, key: str, size: int) -> None:
    """Rows of about ``size`` bytes as files of a bounded size, four at least."""
    files = max(4, -(-size // ARRIVING_BYTES))
    rows.repartition(files, key).write.option("parquet.block.size", PART_BYTES).parquet(path)


def size_of(rows: DataFrame, *columns: str) -> int:
    """Rows and bytes of string columns."""
    strings = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in columns]
    return rows.agg(sum(strings, 64 * F.count("*"))).first()[0]


@query
def j4_streamed_classification(spark, sf):
    """Documents arriving as several files, classified by a stream."""
    folder = work_folder(spark)
    docs = seeds.seeded(spark, sf).select("doc_id", "source", "text")
    write_arriving(docs, f"{folder}/in", "doc_id", size_of(docs, "source", "text"))
    stream = st.classify_stream(
        spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", files_per_batch=2, once=True
    )
    stream.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(
        "doc_id", "label", "raw_score", joined("safety_flags").alias("safety_flags")
    )


def stream_statistics(spark: SparkSession, sf: str, folder: str) -> DataFrame:
    feedback = seeds.feedback(spark, sf)
    write_arriving(feedback, f"{folder}/feedback", "id", size_of(feedback, "reviewer", "decision", "comments"))
    records(spark, sf).write.parquet(f"{folder}/records")
    arriving = st.arriving(spark, f"{folder}/feedback", feedback.schema, 2)
    st.keep_statistics(
        arriving, spark.read.parquet(f"{folder}/records"), f"{folder}/stats", f"{folder}/checkpoint-stats", once=True
    ).awaitTermination()
    return st.latest_statistics(spark, f"{folder}/stats")


@query
def j5_streamed_statistics(spark, sf):
    return stream_statistics(spark, sf, work_folder(spark))


@query
def j6_streamed_recalibration(spark, sf):
    folder = work_folder(spark)
    stream_statistics(spark, sf, folder)
    results = classified(spark, sf).select("doc_id", "label", "raw_score")
    write_arriving(results, f"{folder}/results", "doc_id", size_of(seeds.seeded(spark, sf)))
    arriving = st.arriving(spark, f"{folder}/results", results.schema, 2)
    st.recalibrating_stream(
        arriving, lambda s: st.latest_statistics(s, f"{folder}/stats"), f"{folder}/scored", f"{folder}/checkpoint-scored", once=True
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/scored").select("doc_id", "label", "raw_score", "score")
