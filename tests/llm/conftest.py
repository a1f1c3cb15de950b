"""Odd inputs that every operator has to take."""

from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, columns with clashing names."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [
        (1, f"Alpha {shared} omega", "en", "a", 1),
        (2, f"Beta\t{shared}\nend", "en", "a", 1),
        (2, f"Beta\t{shared}\nend", "en", "a", 1),
        (3, None, None, None, None),
        (4, "", "de", "b", 0),
        (5, " \n\t ", "de", "b", 3),
        (6, long, "fr", "c", len(long)),
        (7, long + " tail", "fr", "c", len(long)),
        (None, f"Gamma {shared}", "en", "a", 9),
        (None, None, None, None, None),
        (8, "123 456 !!! ###", "en", None, 15),
        (9, "Ünïcode space   and 中文 <|endoftext|> ▁x", None, "d", 40),
    ]
    extra = "score string, predicted string, component_id string, h long, n_words string, sequence_id string, block int"
    made = [(*r, "x", "y", "z", 1, "n", "s", 3) for r in rows]
    return spark.createDataFrame(made, f"{DOCS}, {extra}")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)
