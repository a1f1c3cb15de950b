"""Schemas of the input and record tables."""

from __future__ import annotations

from pyspark.sql.types import (
    DataType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _schema(**columns: type[DataType]) -> StructType:
    return StructType([StructField(name, kind()) for name, kind in columns.items()])


DOCUMENTS = _schema(doc_id=LongType, source=StringType, text=StringType)
CLASSIFICATION_RECORDS = _schema(
    id=LongType,
    document_path=StringType,
    classification=StringType,
    score=DoubleType,
    created_at=TimestampNTZType,
)
FEEDBACK_RECORDS = _schema(
    id=LongType,
    classification_id=LongType,
    reviewer=StringType,
    decision=StringType,
    comments=StringType,
    suggested_label=StringType,
    quality_score=DoubleType,
    created_at=TimestampNTZType,
)
MISCLASSIFICATION_RECORDS = _schema(
    id=LongType,
    classification_id=LongType,
    expected_label=StringType,
    reviewer_notes=StringType,
    created_at=TimestampNTZType,
)
