"""Golden documents and the published behaviour of the main entry points."""

from __future__ import annotations

import json

import pytest
from conftest import GOLDEN
from pyspark.sql import functions as F

from tierglass.operators import evaluate as ev
from tierglass.operators import feedback as fb
from tierglass.operators import prompts as pm
from tierglass.operators.fusion import classify, engine_results
from tierglass.sources.documents import read_documents
from tierglass.sources.sinks import (
    append_records,
    export_history,
    write_evaluation,
    write_reports,
    write_trace,
)


def test_golden_labels_scores_and_citations(golden_docs):
    rows = {r.doc_id: r for r in classify(golden_docs).collect()}
    for case, text, label, score, *_ in GOLDEN:
        assert rows[case].label == label
        assert rows[case].raw_score == rows[case].score == pytest.approx(score)
        assert rows[case].verifier_agreement
    described = {c: [s.description for s in r.signals] for c, r in rows.items()}
    assert described["TC2"] == ["Keyword 'confidential'", "Keyword 'nda'"]
    assert described["TC4"] == ["Unsafe keyword 'malware'"]
    assert described["TC3"] == []
    assert rows["TC3"].citations[0].confidence == 0.8
    assert rows["TC1"].citations[0].confidence == 0.6
    assert rows["TC1"].citations[0].metadata.signal == "fallback-snippet"
    assert rows["TC4"].safety_flags == ["Unsafe keyword 'malware'", "breach", "malware"]
    assert rows["TC4"].debug_info.primary.reason == "engine_unavailable"


def test_engine_on_internal_memo_and_salary(spark):
    docs = spark.createDataFrame(
        [
            (1, "tc3.txt", "TC3 internal memo: for internal use only."),
            (2, "salary.txt", "Employee salary records shared under NDA."),
        ],
        "doc_id long, source string, text string",
    )
    answers = spark.createDataFrame(
        [(d, role, model, 0, None, "down") for d in (1, 2)
         for role, model in (("primary", "one"), ("secondary", "two"))],
        "doc_id long, role string, model string, node_ord int, raw_response string, error string",
    )
    memo, salary = engine_results(classify(docs, answers, mode="engine")).orderBy("doc_id").collect()
    assert memo.category == "Confidential" and memo.confidence >= 0.7 and memo.citations
    assert salary.category == "Highly Sensitive"
    assert set(salary.model_outputs) == {"one", "two"} and salary.agreement
    assert "salary" in salary.citations[0].snippet.lower()


def test_benchmark_on_golden_cases(spark, golden_docs, tmp_path):
    cases = spark.createDataFrame(
        [(c, c, label, critical, flags) for c, _, label, _, flags, critical in GOLDEN],
        "case_id string, doc_id string, expected_label string, critical boolean, "
        "expected_flags array<string>",
    )
    report = ev.case_report(cases, classify(golden_docs))
    metrics = ev.evaluate(report).first()
    assert (metrics.total_cases, metrics.accuracy) == (5, 1.0)
    assert metrics.critical_detection_rate == metrics.expected_flag_match_rate == 1.0
    assert (metrics.flagged_cases, metrics.flagged_rate) == (1, 0.2)
    write_evaluation(ev.nested_metrics(ev.evaluate(report)), report, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/metrics")).first().metrics.accuracy == 1.0
    assert spark.read.json(str(tmp_path / "report/cases")).count() == 5


def test_empty_benchmark_uses_defaults(spark, golden_docs):
    cases = spark.createDataFrame(
        [], "case_id string, doc_id string, expected_label string, critical boolean, "
        "expected_flags array<string>",
    )
    metrics = ev.evaluate(ev.case_report(cases, classify(golden_docs))).first()
    assert metrics.total_cases == 1 and metrics.accuracy == 0.0
    assert metrics.latency_average == metrics.latency_max == 0.0
    assert metrics.critical_detection_rate == metrics.expected_flag_match_rate == 1.0


def feedback_of(spark, *rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "id long, classification_id long, reviewer string, decision string, comments string, "
        "suggested_label string, quality_score double, created_at timestamp_ntz",
    )


def records_of(spark, *rows):
    return spark.createDataFrame(
        rows, "id long, document_path string, classification string, score double, created_at timestamp_ntz"
    )


def test_feedback_lowers_the_score_and_is_exported(spark, tmp_path):
    records = records_of(spark, (7, "doc.txt", "Public", 0.9, None))
    feedback = feedback_of(
        spark, (7, "alice", "override", "Contains payroll data", "Confidential", 0.8, None)
    )
    assert fb.misclassifications(feedback, records).first().expected_label == "Confidential"
    history = fb.feedback_history(feedback, records)
    assert history.first().decision == "override"
    export_history(history, str(tmp_path / "history"))
    assert spark.read.json(str(tmp_path / "history")).count() == 1
    stats = fb.label_statistics(feedback, records)
    results = spark.createDataFrame([(1, "Public", 0.9), (2, "Unsafe", 0.9)], "doc_id long, label string, raw_score double")
    scores = {r.doc_id: r.score for r in fb.recalibrate(results, stats).collect()}
    assert scores[1] == pytest.approx(0.69)
    assert scores[2] == 0.9


def test_thresholds_and_prompt_notes(spark):
    records = records_of(spark, (1, "doc.txt", "Public", 0.9, None))
    feedback = feedback_of(spark, (1, "bob", "override", "c", "Confidential", 0.9, None))
    thresholds = spark.createDataFrame(
        [("public", 0.5), ("confidential", 0.7), ("highly_sensitive", 0.85), ("unsafe", 0.95)],
        "key string, value double",
    )
    prompts = spark.createDataFrame([("Classify",), ("Classify\n\n# HITL Adjustments\nold",)], "prompt string")
    updated, noted = fb.refine(thresholds, prompts, feedback, records)
    assert {r.key: r.value for r in updated.collect()} == {
        "public": 0.484, "confidential": 0.7, "highly_sensitive": 0.85, "unsafe": 0.95,
    }
    expected = (
        "Classify\n\n# HITL Adjustments\nRecent reviewer insights:\n"
        "- Public: overrides 100%, avg quality 0.90"
    )
    assert [r.prompt for r in noted.collect()] == [expected, expected]


def test_files_are_read_and_unknown_types_stay_empty(spark, tmp_path):
    for case, text, *_ in GOLDEN:
        (tmp_path / f"{case}.txt").write_text(text, encoding="utf-8")
    (tmp_path / "payload.bin").write_bytes(b"\x00\x01\x02")
    rows = {r.source.rsplit("/", 1)[1]: r.text for r in read_documents(spark, str(tmp_path)).collect()}
    assert rows["payload.bin"] == ""
    assert rows["TC2.txt"] == GOLDEN[1][1] and len(rows) == 6


def test_prompt_tree_and_trace(spark, tmp_path):
    nodes = pm.flatten_tree(
        {"name": "root", "prompt": "root prompt", "children": [{"name": "child", "prompt": "child prompt"}]}
    )
    assert [(n.name, n.depth, n.parent) for n in nodes] == [("root", 0, None), ("child", 1, "root")]
    table = pm.prompt_nodes(spark, pm.add_nodes(nodes, pm.CONDITIONAL_NODES))
    assert table.filter(F.col("name") == "child").first().prompt == "child prompt"
    docs = spark.createDataFrame(
        [(1, "Payroll Memo", "text", 0), (2, None, "image", 3)],
        "doc_id long, title string, content_type string, image_count int",
    )
    slots = {"title": F.col("title"), "image_count": F.col("image_count")}
    text, image = pm.prompt_text(docs, nodes, slots=slots).orderBy("doc_id").collect()
    assert "TC2" in text.prompt_text and "Payroll Memo" in text.prompt_text
    assert "TC4" in image.prompt_text and "3 images on pages unknown" in image.prompt_text
    assert text.prompt_text.startswith("- (root) root prompt\n  - (child) child prompt\n")
    write_trace(pm.conditional_nodes(docs, slots=slots), str(tmp_path / "trace"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "trace")).collect()]
    assert "[tc2_pii_review]" in lines and "[tc4_image_classification]" in lines


def test_undefined_slot_without_default_fails(spark):
    docs = spark.createDataFrame([(1,)], "doc_id long")
    rendered = docs.select(pm.render("Hello {{ doc.owner }}", {}).alias("p"))
    with pytest.raises(Exception, match="undefined"):
        rendered.collect()


def test_reports_and_records_are_idempotent(spark, golden_docs, tmp_path):
    results = classify(golden_docs).withColumns({"task_id": F.lit("t"), "classification_id": F.lit(1)})
    for _ in range(2):
        write_reports(results, str(tmp_path / "reports"))
        append_records(results, str(tmp_path / "records"), "run1")
    append_records(results, str(tmp_path / "records"), "run2")
    reports = spark.read.text(str(tmp_path / "reports")).collect()
    assert len(reports) == 5
    report = next(json.loads(r.value) for r in reports if '"doc_id":"TC1"' in r.value)
    assert report["citations"][0]["metadata"] == {"label": "Public", "signal": "fallback-snippet"}
    ids = sorted(r.id for r in spark.read.parquet(str(tmp_path / "records")).collect())
    assert ids == list(range(1, 11))
