"""Shared session and the five golden documents."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import pytest

from tierglass.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, partitions=8, memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# Golden texts with expected label, score, flags and criticality.
GOLDEN = [
    ("TC1", "This policy is public and contains general guidelines.", "Public", 0.6, [], False),
    ("TC2", "The document is confidential and references an NDA.", "Confidential", 0.78, [], False),
    (
        "TC3",
        "This report includes salary data and employee SSN numbers.",
        "Highly Sensitive",
        0.9,
        [],
        False,
    ),
    (
        "TC4",
        "Incident response log detailing a suspected malware breach.",
        "Unsafe",
        0.99,
        ["malware", "breach"],
        True,
    ),
    ("TC5", "Marketing flyer with no sensitive information.", "Public", 0.6, [], False),
]


@pytest.fixture
def golden_docs(spark):
    rows = [(case, f"/in/{case}.txt", text) for case, text, *_ in GOLDEN]
    return spark.createDataFrame(rows, "doc_id string, source string, text string")


@pytest.fixture
def one_doc(spark):
    """Function that classifies one text and returns its row."""
    from tierglass.operators.fusion import classify

    def run(text, **options):
        docs = spark.createDataFrame([(1, "/in/a.txt", text)], "doc_id long, source string, text string")
        return classify(docs, **options).first()

    return run
