"""One test per semantic trap of the classifier."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tierglass.functions import labels as L
from tierglass.operators import answers as ans
from tierglass.operators import feedback as fb
from tierglass.operators import views as vw
from tierglass.operators.fusion import classify
from tierglass.operators.prepare import split_pages

RESPONSES = (
    "doc_id long, role string, model string, node_ord int, raw_response string, error string"
)
SSN = "123-45-6789 "


def descriptions(row):
    return [s.description for s in row.signals]


def test_t1_cap_hides_unsafe_keywords(one_doc):
    capped = one_doc(SSN * 9 + "weapon")
    assert len(capped.signals) == 8 and capped.label == "Highly Sensitive"
    full = one_doc(SSN * 9 + "weapon", limit=None)
    assert len(full.signals) == 10 and full.label == "Unsafe"


def test_t2_keywords_are_substrings(one_doc):
    row = one_doc("Attendance was good.")
    assert descriptions(row) == ["Keyword 'nda'"] and row.label == "Confidential"


def test_t3_offsets_of_stripped_text_meet_spans_of_given_text(one_doc, spark):
    text = "     ab\f" + SSN
    docs = spark.createDataFrame([(1, "s", text)], "doc_id long, source string, text string")
    row = classify(split_pages(docs), spans="page_spans").first()
    assert row.signals[0].page == 1  # offset 3 of the stripped text lies on page 1


def test_t4_all_pattern_matches_but_first_keyword_only(one_doc):
    row = one_doc(SSN * 2 + "nda nda")
    assert len(row.signals) == 3


def both(spark, first, second):
    docs = spark.createDataFrame([(1, "s", "plain")], "doc_id long, source string, text string")
    answers = spark.createDataFrame(
        [(1, "primary", "m1", 0, first, None), (1, "secondary", "m2", 0, second, None)], RESPONSES
    )
    return docs, answers


def test_t5_scores_on_disagreement(spark):
    docs, answers = both(
        spark, '{"label":"Public","confidence":0.9}', '{"label":"Unsafe","confidence":0.5}'
    )
    averaged = classify(docs, answers).first()
    lowest = classify(docs, answers, mode="engine").first()
    assert (averaged.label, averaged.raw_score) == ("Unsafe", 0.7)
    assert (lowest.label, lowest.raw_score, lowest.verifier_agreement) == ("Unsafe", 0.5, False)
    assert averaged.citations[0].confidence == 0.8 and lowest.citations[0].confidence == 0.85


def test_t6_last_node_counts(spark):
    docs, _ = both(spark, "", "")
    answers = spark.createDataFrame(
        [(1, "primary", "m", n, f'{{"label":"{v}"}}', None) for n, v in enumerate(["Unsafe", "Public"])],
        RESPONSES,
    )
    row = classify(docs, answers).first()
    assert row.label == "Public" and row.debug_info.secondary is None


@pytest.mark.parametrize(
    ("response", "label", "score", "reasoning"),
    [
        ('{"label":"","category":"Confidential","confidence":0}', "Confidential", 0.6, None),
        ('{"score":0}', "Public", 0.0, None),  # a falsy last key stands as it is
        ('{"label":"x","score":"0.25"}', "Public", 0.25, None),
        ('{"label":"unsafe_thing","confidence":7}', "Unsafe", 1.0, None),
        ('{"confidence":true,"rationale":""}', "Public", 1.0, ""),
        ("not Public, it is Unsafe", "Public", 0.6, None),  # T10
        ('{"risk_level":"HIGHLY_SENSITIVE","reasoning_summary":"s"}', "Highly Sensitive", 0.6, None),
        ("Unsafe. Confidence = .4", "Unsafe", 0.4, None),
        ("{bad json} highly sensitive", "Highly Sensitive", 0.6, None),
    ],
)
def test_t7_t9_t10_reading_answers(spark, response, label, score, reasoning):
    row = ans.parse_responses(
        spark.createDataFrame([(1, "primary", "m", 0, response, None)], RESPONSES)
    ).first()
    assert (row.label, row.score) == (label, pytest.approx(score))
    assert row.reasoning == (response if reasoning is None else reasoning)
    assert row.parse_error is None


@pytest.mark.parametrize(
    "response",
    ['{"label":["a"]}', '{"label":3}', '{"confidence":"high"}', '{"score":""}', '{"confidence":[1]}',
     '{"reasoning":["a"]}', '{"rationale":0}'],
)
def test_t8_unreadable_fields_fall_back(spark, response):
    docs, answers = both(spark, response, response)
    row = classify(docs.withColumn("text", F.lit("salary list")), answers).first()
    assert (row.label, row.raw_score) == ("Highly Sensitive", 0.9)
    assert row.debug_info.primary.fallback and row.debug_info.primary.reason


def test_t11_raw_score_is_kept(one_doc, spark):
    stats = spark.createDataFrame(
        [("Confidential", 4, 4, 0.5)], "label string, total long, overrides long, avg_quality double"
    )
    row = one_doc("nda", stats=stats)
    assert row.raw_score == 0.78 and row.score == pytest.approx(0.78 * 0.7)


def test_t12_spaces_around_decisions(spark):
    records = spark.createDataFrame(
        [(1, "d", "Public", 0.6, None)],
        "id long, document_path string, classification string, score double, created_at timestamp_ntz",
    )
    feedback = spark.createDataFrame(
        [(1, 1, "r", " Reclassify ", "c", None, 0.5, None)],
        "id long, classification_id long, reviewer string, decision string, comments string, "
        "suggested_label string, quality_score double, created_at timestamp_ntz",
    )
    assert fb.misclassifications(feedback, records).count() == 1
    assert fb.label_statistics(feedback, records).first().overrides == 0


def test_t13_buckets_of_sensitive_and_unsafe(spark):
    frame = spark.createDataFrame([("Highly Sensitive",), ("Unsafe",), ("Confidential",)], "label string")
    rows = frame.select(
        L.history_bucket(L.api_category(F.col("label")), F.col("label")).alias("composed"),
        L.bucket(F.col("label")).alias("plain"),
    ).collect()
    assert [(r.composed, r.plain) for r in rows] == [
        ("Public", "Highly Sensitive"), ("Public", "Public"), ("Confidential", "Confidential"),
    ]


def test_t16_tie_and_t17_blank_texts(one_doc):
    for text in ("", "   ", None):
        row = one_doc(text)
        assert (row.label, row.raw_score, row.signals) == ("Public", 0.6, [])
        assert len(row.citations) == 1 and row.citations[0].snippet == (text or "")


def test_t19_blank_answer_is_no_fallback_and_cache_replays(spark):
    docs, answers = both(spark, "  ", "  ")
    row = classify(docs, answers).first()
    assert row.label == "Public" and not row.debug_info.primary.fallback
    stored = spark.createDataFrame(
        [("m", "k", "Unsafe", 0.9, "r", "", "2024-01-01", True), ("m", "k", "Public", 0.1, "q", "", "2023-01-01", False)],
        "model string, prompt_hash string, label string, score double, reasoning string, "
        "raw_response string, updated_at string, fallback boolean",
    )
    empty = stored.drop("fallback").limit(0)
    assert ans.cache_upsert(empty, stored).first().label == "Unsafe"
    assert ans.cache_upsert(empty, stored, cache_fallbacks=False).first().label == "Public"
    requests = spark.createDataFrame([(1, "m", "k"), (2, "m", "z")], "doc_id long, model string, prompt_hash string")
    hits, misses = ans.cache_split(requests, ans.cache_upsert(empty, stored))
    assert [r.doc_id for r in misses.collect()] == [2]
    replay = ans.cached_answers(hits).first()
    assert replay.backend == "cache" and replay.parse_error is None


def test_unicode_digits_words_and_whitespace(one_doc):
    arabic = "١٢٣-٤٥-٦٧٨٩"
    assert descriptions(one_doc(f"id {arabic} ok")) == ["Possible social security number detected"]
    assert one_doc("id é123456789 ok").signals == []
    assert one_doc(" \x1c nda  x ").signals[0].snippet == "nda x"


def test_adjacent_mail_addresses(one_doc):
    row = one_doc("a@b.c_d@e.f and x@y")
    assert descriptions(row) == ["Email address detected"] * 2


def test_evidence_entry_shapes(spark):
    text = "nda " + "word " * 200
    docs = spark.createDataFrame(
        [(1, "s", text), (2, "s", ""), (3, "s", "short")], "doc_id long, source string, text string"
    )
    results = classify(split_pages(docs), keep=("text", "page_spans"), spans="page_spans")
    rows = {r.doc_id: r.evidence for r in vw.evidence_entries(results).collect()}
    assert [len(rows[i]) for i in (1, 2, 3)] == [3, 1, 2]
    assert rows[2][0].content == '{"label": "Public", "signal": "fallback-snippet"}'
    assert rows[1][1].page == 1 and rows[1][1].label is None


def test_batched_inference_asks_each_model_once_per_batch(spark):
    from tierglass.operators.answers import infer

    rows = [(i, "bad" if i % 3 == 0 else "good", f"p{i}") for i in range(9)]
    prompts = spark.createDataFrame(rows, "doc_id long, model string, full_prompt string").coalesce(1)

    def run(model, texts):
        if model == "bad":
            raise RuntimeError("down")
        return [t.upper() for t in texts]

    got = {r.doc_id: (r.raw_response, r.error) for r in infer(prompts, run, batched=True).collect()}
    assert got == {i: (None, "down") if m == "bad" else (p.upper(), None) for i, m, p in rows}
