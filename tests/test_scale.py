"""Plans that must hold at scale, and hot keys checked against brute force."""

from __future__ import annotations

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F

from tierglass import lexicon as X
from tierglass.operators import answers as ans
from tierglass.operators import evaluate as ev
from tierglass.operators import feedback as fb
from tierglass.operators import jobs as jb
from tierglass.operators import prepare as pr
from tierglass.operators import views as vw
from tierglass.operators.evidence import extract_signals
from tierglass.operators.fusion import classify
from tierglass.plans import seeds
from tierglass.plans.queries import QUERIES
from tierglass.sources.sinks import number_rows

SF = "/root/testdata/sf0.001"
NO_BROADCAST = "spark.sql.autoBroadcastJoinThreshold"


@pytest.fixture
def shuffled_joins(spark):
    """Joins as they are planned for sides too large to broadcast."""
    spark.conf.set(NO_BROADCAST, "-1")
    yield
    spark.conf.unset(NO_BROADCAST)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanged_columns(df) -> list[str]:
    """Columns that pass through each shuffle."""
    detail = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    return [
        re.search(r"Input \[\d+\]: \[(.*?)\]", part).group(1)
        for part in re.split(r"\n\n", detail)
        if re.match(r"\(\d+\) Exchange", part.strip())
    ]


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")


def test_classification_needs_no_shuffle_and_reads_three_columns(spark):
    text = plan(classify(documents(spark)))
    assert "Exchange" not in text and "Python" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in text or (
        "struct<doc_id:bigint,source:string,text:string>" in text
    )


def test_answers_join_without_text_in_any_shuffle(spark, shuffled_joins):
    df = classify(documents(spark), seeds.responses(spark, SF))
    moved = exchanged_columns(df)
    assert moved and not any(re.search(r"\b(text|stripped|lowered)#", m) for m in moved)
    # One shuffle each for the evidence and the answers.
    assert len(moved) == 2


def test_metadata_with_images_moves_no_text(spark, shuffled_joins):
    df = pr.document_metadata(documents(spark), seeds.images(spark, SF))
    assert not any(re.search(r"\b(text|_stripped)#", m) for m in exchanged_columns(df))


def test_non_empty_filters_do_not_copy_the_text_scan(spark):
    df = classify(documents(spark)).select("doc_id", F.explode("signals")).filter("doc_id > 5")
    text = plan(df)
    assert text.count("regexp_extract_all(") == len(X.PATTERN_RULES)
    assert "GreaterThan(doc_id,5)" in text  # a filter on a stored column reaches the scan


def test_no_query_plans_a_cross_join(spark, shuffled_joins):
    for name in (
        "p2_page_spans", "p5_image_rollup", "m4_rendered_prompts", "m9_cache_hits", "m9_cache_misses",
        "m18_fallback", "f9_engine", "v1_evidence_with_images", "h1_feedback_accepted",
        "h3_misclassifications", "h5_recalibration", "h8_prompt_annotation", "h9_refine",
        "q7_benchmark", "j1_job_validation", "j2_task_status", "j3_task_results",
    ):
        text = plan(QUERIES[name](spark, SF))
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text, name


def test_row_limits_per_group_are_applied_before_the_shuffle(spark):
    for name in ("v3_image_evidence", "v4_history_by_source"):
        assert plan(QUERIES[name](spark, SF)).count("WindowGroupLimit") == 2
    assert "TakeOrderedAndProject" in plan(QUERIES["v4_history"](spark, SF))


def test_filter_on_feedback_reaches_the_scan(spark, tmp_path):
    fb.list_feedback(seeds.feedback(spark, SF)).write.parquet(str(tmp_path / "fb"))
    one = fb.list_feedback(spark.read.parquet(str(tmp_path / "fb")), 4)
    assert "EqualTo(classification_id,4)" in plan(one)


# --- hot keys -------------------------------------------------------------------


def test_hot_document_of_many_pages_is_assembled_whole(spark):
    lengths = [(1, p, "x" * (p % 7)) for p in range(5000)] + [(2, 0, "ab"), (2, 1, "c")]
    random.Random(1).shuffle(lengths)
    pages = spark.createDataFrame(lengths, "doc long, page long, text string")
    hot, small = pr.assemble_pages(pages, "doc", "page").orderBy("doc").collect()
    assert hot.page_count == 5000
    start = 0
    for number, span in enumerate(hot.page_spans, start=1):
        end = start + (number - 1) % 7
        assert (span.page, span.start, span.end) == (number, start, end)
        start = end + 2
    assert small.text == "ab\n\nc"


def test_document_of_many_pages_gets_one_result(spark):
    pages = spark.range(5000).selectExpr(
        "1L AS doc_id", "id AS page", "CASE id WHEN 4998 THEN 'SSN 123-45-6789' WHEN 4999 THEN 'malware' ELSE 'page' END AS text"
    )
    docs = pr.assemble_pages(pages, "doc_id", "page").withColumn("source", F.lit("s"))
    (row,) = classify(docs, spans="page_spans").collect()
    assert (row.label, [s.page for s in row.signals]) == ("Unsafe", [4999, 5000])


def test_hot_task_and_hot_classification(spark, shuffled_joins):
    rows = [("hot", i, "failed" if i == 700 else "done", f"e{i}" if i == 700 else None) for i in range(1000)]
    rows += [("cold", i, "done", None) for i in range(3)]
    outcomes = spark.createDataFrame(rows, "task_id string, ord long, outcome string, error string")
    kept = jb.task_results(outcomes).groupBy("task_id").count().collect()
    assert {r.task_id: r["count"] for r in kept} == {"hot": 700, "cold": 3}
    status = {r.task_id: r for r in jb.task_status(outcomes).collect()}
    assert (status["hot"].status, status["hot"].error) == ("failed", "e700")
    assert (status["cold"].status, status["cold"].progress) == ("completed", 1.0)

    feedback = spark.createDataFrame(
        [(i, 1 if i < 900 else i, "r", "override" if i % 3 == 0 else "accept", "c", None, i / 1000, None)
         for i in range(1000)],
        "id long, classification_id long, reviewer string, decision string, comments string, "
        "suggested_label string, quality_score double, created_at timestamp_ntz",
    )
    records = spark.range(1000).selectExpr(
        "id", "'d' AS document_path", "CASE WHEN id = 1 THEN 'Unsafe' ELSE 'Public' END AS classification",
        "0.5D AS score", "CAST(NULL AS TIMESTAMP_NTZ) AS created_at",
    )
    stats = {r.label: r for r in fb.label_statistics(feedback, records).collect()}
    assert (stats["Unsafe"].total, stats["Unsafe"].overrides) == (900, 300)
    assert stats["Unsafe"].avg_quality == pytest.approx(sum(range(900)) / 900 / 1000)
    assert stats["Public"].total == 100


def test_hot_cache_key_splits_and_keeps_all_rows(spark, shuffled_joins):
    requests = spark.range(5000).selectExpr(
        "id AS doc_id", "'m' AS model", "CASE WHEN id < 4000 THEN 'copy' ELSE CAST(id AS STRING) END AS prompt_hash"
    )
    stored = spark.createDataFrame(
        [("m", "copy", "Public", 0.6, "r", "", 1), ("m", "copy", "Unsafe", 0.9, "r", "", 2)],
        "model string, prompt_hash string, label string, score double, reasoning string, "
        "raw_response string, updated_at int",
    )
    cache = ans.cache_upsert(stored.limit(0), stored)
    hits, misses = ans.cache_split(requests, cache)
    assert hits.filter("label = 'Unsafe'").count() == 4000 and misses.count() == 1000


def test_image_entries_of_a_hot_document(spark):
    images = spark.range(3000).selectExpr(
        "IF(id < 2500, 1L, id) AS doc_id", "CAST(id AS INT) AS image_idx", "1 AS page",
        "map('score', '1') AS metadata", "CAST('p' AS BINARY) AS content",
    )
    found = vw.image_evidence(images)
    assert found.filter("doc_id = 1").count() == 2 and found.count() == 502


def test_numbers_are_consecutive_in_key_order(spark):
    rows = spark.range(10_000).selectExpr("id * id AS key").repartition(7)
    numbered = number_rows(rows, "key", first=5, parts=6).orderBy("key").collect()
    assert [r.id for r in numbered] == list(range(5, 10_005))
    assert number_rows(rows.limit(0), "key").count() == 0


def test_last_answer_is_known_before_anything_is_parsed(spark, shuffled_joins):
    responses = seeds.responses(spark, SF)
    text = plan(ans.pair_answers(responses))
    assert text.index("regexp_extract(") < text.rindex("max_by")  # the tree is printed from the top
    known = exchanged_columns(ans.pair_answers(responses, last_node=seeds.LAST_NODE))
    assert known and not any("raw_response" in m for m in known)


def test_hot_joins_are_split(spark, shuffled_joins):
    """Adaptive execution marks the skewed join of requests, feedback and outcomes."""
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for name, value in small.items():
        spark.conf.set(name, value)
    try:
        hot = spark.range(0, 200_000, 1, 16).selectExpr(
            "id", "IF(id % 10 < 9, 1L, id) AS classification_id", "CAST(id AS STRING) AS reviewer", "'accept' AS decision",
            "IF(id % 10 < 9, 't', CAST(id AS STRING)) AS task_id", "id AS ord", "IF(id = 199999, 'failed', 'done') AS outcome",
            "CAST(NULL AS STRING) AS suggested_label", "'c' AS comments", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS created_at",
            "'m' AS model", "IF(id % 10 < 9, 'copy', CAST(id AS STRING)) AS prompt_hash",
        )
        records = spark.range(0, 200_000).selectExpr("id", "'Public' AS classification", "'d' AS document_path", "0.5D AS score")
        cache = spark.range(0, 200_000).selectExpr(
            "'m' AS model", "IF(id = 0, 'copy', CAST(id AS STRING)) AS prompt_hash", "'Public' AS label", "0.5D AS score",
            "'r' AS reasoning", "'' AS raw_response",
        )
        for df in (
            fb.add_feedback(hot, records)[0],
            fb.misclassifications(hot.withColumn("suggested_label", F.lit("Unsafe")), records),
            ans.cache_split(hot.select("id", "model", "prompt_hash"), cache)[0],
        ):
            df.write.format("noop").mode("overwrite").save()
            df.collect()
            assert "skew=true" in plan(df).split("Initial Plan")[0]
    finally:
        for name in small:
            spark.conf.unset(name)


def test_cases_without_a_result_count_against_every_rate(spark):
    cases = spark.createDataFrame(
        [("c1", 1, "Public", False, []), ("c2", 2, "Unsafe", True, ["malware"])],
        "case_id string, doc_id long, expected_label string, critical boolean, expected_flags array<string>",
    )
    results = spark.createDataFrame(
        [(1, "Public", 0.6, True, [])],
        "doc_id long, label string, score double, verifier_agreement boolean, safety_flags array<string>",
    )
    row = ev.evaluate(ev.case_report(cases, results)).first()
    assert (row.total_cases, row.accuracy, row.missing_results) == (2, 0.5, 1)
    assert (row.critical_detection_rate, row.expected_flag_match_rate) == (0.0, 0.0)


def test_repeated_keys_and_numbers_that_are_none(spark):
    answers = {
        '{"label":"Public","label":"Unsafe","confidence":0.9}': ("Unsafe", 0.9),
        '{"label":"Unsafe","confidence":NaN}': ("Unsafe", 1.0),
        '{"label":"Unsafe","label":"Public"} and {"a":1}': ("Public", 0.6),
    }
    df = spark.createDataFrame([(a, None) for a in answers], "raw_response string, error string")
    got = {r.raw_response: (r.label, r.score) for r in ans.parse_responses(df).collect()}
    assert got == answers


def test_quality_that_nobody_gave_moves_no_score(spark):
    feedback = spark.createDataFrame(
        [(1, "accept", None), (2, "accept", None), (2, "accept", 1.0)], "classification_id long, decision string, quality_score double"
    )
    records = spark.createDataFrame([(1, "Public"), (2, "Unsafe")], "id long, classification string")
    stats = fb.label_statistics(feedback, records)
    assert {r.label: r.avg_quality for r in stats.collect()} == {"Public": None, "Unsafe": 1.0}
    results = spark.createDataFrame([("Public", 0.6), ("Unsafe", 0.6)], "label string, raw_score double")
    assert {r.label: r.score for r in fb.recalibrate(results, stats).collect()} == {"Public": 0.6, "Unsafe": pytest.approx(0.7)}
    twice = fb.recalibrate(results, stats.unionAll(stats))
    assert twice.count() == 2


def test_streamed_sums_of_a_hot_classification_stay_in_few_slots(spark, shuffled_joins, tmp_path):
    from tierglass.streaming import continuous as st

    rows = spark.range(3000).selectExpr(
        "IF(id < 2900, 1L, id) AS classification_id", "IF(id % 3 = 0, 'override', 'accept') AS decision", "id / 3000D AS quality_score"
    )
    rows.repartition(12).write.parquet(str(tmp_path / "in"))
    records = spark.range(3000).selectExpr("id", "IF(id = 1, 'Unsafe', 'Public') AS classification")
    arriving = st.arriving(spark, str(tmp_path / "in"), rows.schema, 1)
    for _ in range(2):  # starting again without new files changes nothing
        st.keep_statistics(arriving, records, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    got = {r.label: (r.total, r.overrides) for r in st.latest_statistics(spark, str(tmp_path / "out")).collect()}
    assert got == {"Unsafe": (2900, 967), "Public": (100, 33)}
    assert len([p for p in (tmp_path / "out").iterdir() if p.is_dir()]) <= st.SLOTS


def test_asking_runs_each_content_once_and_keeps_fallbacks(spark):
    from tierglass.operators.ask import ask
    from tierglass.plans.queries import NODES, empty_cache

    docs = spark.createDataFrame([(1, "same"), (2, "same"), (3, "secret nda"), (4, None)], "doc_id long, text string")
    counter = spark.sparkContext.accumulator(0)

    def run(model, prompt):
        counter.add(1)
        if "nda" in prompt:
            raise ValueError("no")
        return "Unsafe"

    answers, cache = ask(docs, NODES, empty_cache(spark), run, {"primary": "m"})
    assert answers.count() == 4 * len(NODES) and counter.value == 3 * len(NODES)
    stored = {(r.label, r.reasoning) for r in cache.collect()}
    assert ("Confidential", "Heuristic detection of keywords nda indicating Confidential.") in stored or len(stored) == 2
    without = ask(docs, NODES, empty_cache(spark), run, {"primary": "m"}, cache_fallbacks=False)[1]
    assert cache.count() == 3 * len(NODES) and without.count() == 2 * len(NODES)


def test_checkpoints_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from tierglass.session import shared_folder

    conf = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(cluster)
    assert shared_folder(spark)


# --- brute force -----------------------------------------------------------------

# The published patterns.
PYTHON_RULES = (
    r"\b\d{3}-\d{2}-\d{4}\b",
    r"\b[A-Z]{1,2}\d{6,9}\b",
    r"\b(?:\d{4}[- ]?){3}\d{4}\b",
    r"\b\d{9,12}\b",
    r"(?i)[a-z0-9_.+-]+@[a-z0-9-]+\.[a-z0-9-.]+",
)


def expected_signals(text: str) -> list[tuple[str, int]]:
    """Descriptions and offsets by direct search."""
    body = text.strip()
    found = [
        (rule.description, m.start())
        for rule, pattern in zip(X.PATTERN_RULES, PYTHON_RULES)
        for m in re.finditer(pattern, body)
    ]
    lowered = body.lower()
    for words, form in ((X.CONFIDENTIAL_EVIDENCE, X.CONFIDENTIAL_DESCRIPTION), (X.UNSAFE_EVIDENCE, X.UNSAFE_DESCRIPTION)):
        found += [(form.format(w), lowered.index(w)) for w in words if w in lowered]
    return found


def expected_snippet(text: str, start: int, length: int) -> str:
    body = text.strip()
    return re.sub(r"\s+", " ", body[max(0, start - 140) : start + length + 140].strip())


PIECES = some.sampled_from(
    ["123-45-6789", "4111 1111 1111 1111", "AB1234567", "123456789012", "jo.doe@mail.example.org", "a@b.c_d@e.f",
     "nda", "NDA", "Weapon", "kill  chain", "kill chain", "é", "ß", "中", "😀", "_", "-", " ", "\n", "\f", "\x1c", " ",
     "٣", "1234", "x", ".", "@", "²", "malware"]
)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(some.lists(some.lists(PIECES, max_size=40).map("".join), min_size=60, max_size=120))
def test_signals_equal_direct_search(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for limit in (8, None):
        for row in extract_signals(docs, limit=limit).select("doc_id", "signals").collect():
            want = expected_signals(texts[row.doc_id])[:limit]
            assert [s.description for s in row.signals] == [d for d, _ in want], repr(texts[row.doc_id])


def test_snippets_equal_direct_search(spark):
    rng = random.Random(7)
    words = ["alpha", "nda", "\n\n", " \t", "123-45-6789", "ünïcode", "😀", "weapon"]
    texts = ["".join(rng.choice(words) + " " for _ in range(rng.randint(1, 300))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes = {"Possible social security number detected": 11, "Keyword 'nda'": 3, "Unsafe keyword 'weapon'": 6}
    for row in extract_signals(docs, limit=None).select("doc_id", "signals").collect():
        text = texts[row.doc_id]
        want = [expected_snippet(text, start, sizes[d]) for d, start in expected_signals(text)]
        assert [s.snippet for s in row.signals] == want


def test_many_matches_and_long_runs_stay_fast(spark):
    texts = [(1, "123-45-6789 " * 20_000), (2, "a" * 200_000 + "@"), (3, "\f".join(["page"] * 20_000))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = {r.doc_id: r.n for r in extract_signals(docs, limit=None).selectExpr("doc_id", "size(signals) AS n").collect()}
    assert rows == {1: 20_000, 2: 0, 3: 0}
    spans = pr.split_pages(docs).filter("doc_id = 3").select(F.element_at("page_spans", -1).alias("s")).first().s
    assert (spans.page, spans.end) == (20_000, 5 * 20_000 - 1)
