"""Inputs derived from the given tables, as SQL that Spark and DuckDB both read.

The given documents rarely trigger a rule. The seeded projection keeps every
document with its whole text and adds passages that do. Every expression below
is used unchanged by both engines, so both check the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SEEDED_TEXT = """CASE doc_id % 10
  WHEN 0 THEN text
  WHEN 1 THEN concat(text, ' Reach me at jo.doe@example.org about SSN 123-45-6789 now.')
  WHEN 2 THEN concat('Passport AB1234567 and account 123456789012 on file. ', text)
  WHEN 3 THEN concat(text, ' Card 4111 1111 1111 1111 salary data.')
  WHEN 4 THEN concat('  This memo is CONFIDENTIAL and for internal use only. ', text)
  WHEN 5 THEN concat(text, ' malware breach payload exploit')
  WHEN 6 THEN concat(repeat('id 123-45-6789 ', 9), ' weapon ', text)
  WHEN 7 THEN concat('   ', text, '   ')
  WHEN 8 THEN concat(substr(text, 1, 100), chr(12), substr(text, 101))
  ELSE concat(text, ' Restricted customer list, do not distribute. Medical leak.') END"""
SEEDED_DOCUMENT = {
    "doc_id": "doc_id",
    "source": "concat('/data/', source, '/', CAST(doc_id AS VARCHAR(20)), '.txt')",
    "origin": "source",
    "lang": "lang",
    "text": SEEDED_TEXT,
}
# One blank document per label row, so blank and empty texts occur as well.
SEEDED_BLANK = {
    "doc_id": "-1 - doc_id",
    "source": "concat('/data/blank/', CAST(doc_id AS VARCHAR(20)), '.txt')",
    "origin": "'blank'",
    "lang": "'none'",
    "text": "CASE WHEN toxic = 1 THEN '' ELSE '   ' END",
}

SEEDED_TURN = """CASE turn % 4 WHEN 1 THEN concat(text, ' SSN 123-45-6789 ') WHEN 2 THEN concat(text, ' malware ')
  ELSE text END"""

RESPONSE_TEXT = """CASE (doc_id + node_ord + CASE WHEN role = 'secondary' THEN 3 ELSE 0 END) % 8
  WHEN 0 THEN '{"label":"Unsafe","confidence":0.93,"reasoning":"r0"}'
  WHEN 1 THEN 'Sure: {"risk_level":"highly_sensitive","score":0.8,"rationale":"r1"} done'
  WHEN 2 THEN '{"label":"","category":"Confidential","confidence":0}'
  WHEN 3 THEN 'I think this is Public, not Unsafe. confidence: 0.7'
  WHEN 4 THEN ''
  WHEN 5 THEN '{"label":"Unsafe","reasoning":["a"]}'
  WHEN 6 THEN CASE WHEN doc_id % 3 = 0 THEN '{"label":"Public","label":"Unsafe","confidence":0.9}'
    WHEN doc_id % 3 = 1 THEN '{"label":"Unsafe","confidence":NaN}' ELSE '{broken json} highly sensitive' END
  ELSE NULL END"""
RESPONSE_ERROR = """CASE WHEN (doc_id + node_ord
  + CASE WHEN role = 'secondary' THEN 3 ELSE 0 END) % 8 = 7 THEN 'timeout' END"""

LAST_NODE = 2

RECORD_TIME = "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * doc_id"
FEEDBACK = {
    "id": "doc_id",
    "classification_id": "doc_id",
    "reviewer": "concat('reviewer', CAST(doc_id % 7 AS VARCHAR(20)))",
    "decision": "CASE WHEN quality = 0 THEN 'Override' WHEN toxic = 1 THEN ' reclassify ' "
    "ELSE 'accept' END",
    "comments": "concat('note ', CAST(doc_id AS VARCHAR(20)))",
    "suggested_label": "CASE WHEN toxic = 1 THEN 'Unsafe' END",
    # Some reviewers give no quality.
    "quality_score": "CASE WHEN doc_id % 11 <> 5 THEN (doc_id % 10) / CAST(10 AS DOUBLE) END",
    "created_at": "TIMESTAMP '2024-01-02 00:00:00' + INTERVAL 1 MINUTE * doc_id",
}
ORPHAN_FEEDBACK = {
    **FEEDBACK,
    "id": "-1 - doc_id",
    "classification_id": "9000000000 + doc_id",
    "reviewer": "''",
    "decision": "''",
    "suggested_label": "CAST(NULL AS VARCHAR(20))",
}
CASES = {
    "case_id": "concat('case', CAST(doc_id AS VARCHAR(20)))",
    "doc_id": "doc_id",
    "expected_label": "CASE WHEN toxic = 1 THEN 'Unsafe' WHEN quality = 0 THEN 'Confidential' "
    "ELSE 'Public' END",
    "critical": "toxic = 1",
    "wants_flags": "doc_id % 10 = 5",
}
# One task per user; events in time order are the documents of the task.
OUTCOMES = {
    "task_id": "user_id",
    "event_id": "event_id",
    "ts": "ts",
    "doc_id": "event_id",
    "outcome": "CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' "
    "ELSE 'done' END",
    "error": "CASE WHEN event_type = 'error' THEN concat('error ', CAST(event_id AS VARCHAR(20))) END",
    "latency_ms": "value",
}


def select(columns: dict[str, str]) -> list[str]:
    return [f"{sql} AS {name}" for name, sql in columns.items()]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def seeded(spark: SparkSession, sf: str) -> DataFrame:
    given = table(spark, sf, "documents").selectExpr(*select(SEEDED_DOCUMENT))
    blank = table(spark, sf, "labels").selectExpr(*select(SEEDED_BLANK))
    return given.unionByName(blank)


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Three nodes for two models; German documents have no second model."""
    asked = table(spark, sf, "documents").selectExpr(
        "doc_id", "lang", "explode(sequence(0, 5)) AS k"
    )
    return (
        asked.selectExpr(
            "doc_id",
            "lang",
            "CASE WHEN k < 3 THEN 'primary' ELSE 'secondary' END AS role",
            "k % 3 AS node_ord",
        )
        .filter("role = 'primary' OR lang <> 'de'")
        .selectExpr(
            "doc_id",
            "role",
            "CASE WHEN role = 'primary' OR lang = 'es' THEN 'alpha' ELSE 'beta' END AS model",
            "node_ord",
            f"{RESPONSE_TEXT} AS raw_response",
            f"{RESPONSE_ERROR} AS error",
        )
    )


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    """One feedback row per label row, and one on an unknown id per toxic one."""
    labels = table(spark, sf, "labels")
    orphans = labels.filter("toxic = 1").selectExpr(*select(ORPHAN_FEEDBACK))
    return labels.selectExpr(*select(FEEDBACK)).unionByName(orphans)


def cases(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").selectExpr(*select(CASES))
    return rows.selectExpr(
        "case_id", "doc_id", "expected_label", "critical",
        "CASE WHEN wants_flags THEN array('malware', 'breach') "
        "ELSE CAST(array() AS ARRAY<STRING>) END AS expected_flags",
    )


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(*select(OUTCOMES))


def images(spark: SparkSession, sf: str) -> DataFrame:
    """None to three images per document with the kinds of metadata that matter."""
    rows = table(spark, sf, "documents").selectExpr(
        "doc_id", "explode(slice(array(0, 1, 2), 1, CAST(doc_id % 4 AS INT))) AS image_idx"
    )
    return rows.selectExpr(
        "doc_id",
        "image_idx",
        "CASE WHEN image_idx < 2 THEN image_idx + 1 END AS page",
        "CASE WHEN image_idx <> 1 THEN map('stream', 'raw', 'score', '0.5') "
        "WHEN doc_id % 8 < 4 THEN map('Label', concat('figure ', doc_id), 'note', repeat('n', 250)) "
        "ELSE map('label', concat('figure ', doc_id), 'note', 'short') END AS metadata",
        "CAST(concat('png', doc_id, '-', image_idx) AS BINARY) AS content",
    )
