"""Language of texts by a string kernel.

The kernel of two texts is the cosine of their blended n-gram presence: the number of distinct byte
grams (1 to 4 bytes, in hashed slots) that both have, over the root of the product of their counts. Nyström
landmarks, taken alike from every language, turn it into finite features, and one ridge regression
per language (one against the rest) is solved on them. Texts are scored by two matrix products per
block. Landmarks and training texts are bounded samples (``landmarks`` and ``per_language``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierglass.llm import grams
from tierglass.llm import words as W
from tierglass.llm.common import is_remainder, table

SIZES = (1, 2, 3, 4)
WIDTH = 16384
LANDMARKS = 32
PER_LANGUAGE = 512
RIDGE = 1e-2
UNKNOWN = "und"
_LETTER = r"\p{L}"


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> dict:
    """Model from rows (doc_id, text, lang) with text, lang and a doc_id.

    Every language is sampled by the hash of doc_id at the share that yields about ``per_language``
    texts, never more than twice that, and gives up to ``landmarks`` landmarks. Every value of ``lang``
    is learned; the sample grows with their number alone.
    """
    rows = docs.where("text is not null and lang is not null and doc_id is not null")
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not sizes:
        return {"languages": []}
    share = F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], per_language / r["count"])])
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.element_at(share, F.col("lang")) * (1 << 40)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (part for b in batches for part in grams.blocks(b)):
            bits = np.packbits(grams.presence(block.column("text"), SIZES, WIDTH), axis=1)
            yield pa.RecordBatch.from_arrays(
                [block.column("lang"), block.column("doc_id"), pa.array([b.tobytes() for b in bits], pa.binary())],
                ["lang", "doc_id", "bits"],
            )

    found = (
        rows.select("doc_id", "text", "lang")
        .where(drawn)
        .mapInArrow(W.task(features), "lang string, doc_id long, bits binary")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "bits")
        .limit(2 * per_language * len(sizes))
        .collect()
    )
    by_lang: dict[str, list[np.ndarray]] = {}
    for r in found:
        by_lang.setdefault(r["lang"], []).append(np.frombuffer(r["bits"], np.uint8))
    languages = sorted(by_lang)
    if not languages:
        return {"languages": []}
    marks = _rows([b for lang in languages for b in by_lang[lang][:landmarks]])
    root = np.sqrt(np.maximum(marks.sum(1), 1))
    marks = marks / root[:, None]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-5 * values[-1]
    back = (vectors[:, good] / np.sqrt(values[good])).astype(np.float32)
    x = np.concatenate([_kernel(_rows(by_lang[lang]), marks) @ back for lang in languages])
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    y = np.repeat(np.eye(len(languages)), [len(by_lang[lang]) for lang in languages], axis=0)
    # Every language weighs the same, however many texts it has.
    weight = (1 / y.sum(0))[y.argmax(1)][:, None]
    ridge = RIDGE * np.eye(x.shape[1]) / x.shape[1]
    ridge[-1, -1] = 1e-9
    solved = np.linalg.solve(x.T @ (weight * x) + ridge, x.T @ (weight * y)).astype(np.float32)
    return {"languages": languages, "marks": marks, "weights": back @ solved[:-1], "bias": solved[-1]}


def _rows(bits: list[np.ndarray]) -> np.ndarray:
    return np.unpackbits(np.array(bits, np.uint8), axis=1)[:, :WIDTH].astype(np.float32)


def _kernel(present: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Cosine of presence with every landmark; ``marks`` are already unit rows."""
    present = present.astype(np.float32)
    return (present @ marks.T) / np.sqrt(np.maximum(present.sum(1), 1))[:, None]


def classify(model: dict, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score in 0 to 1 of each text; ties go to the language that sorts first.

    Null texts, texts without a letter and all texts of a model without languages are undetermined.
    """
    if not model["languages"]:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    lettered = pc.fill_null(pc.match_substring_regex(texts, _LETTER), False).to_numpy(False)
    value = _kernel(grams.presence(texts, SIZES, WIDTH), model["marks"]) @ model["weights"] + model["bias"]
    best = value.argmax(1)
    score = np.where(lettered, np.clip(value.max(1), 0, 1), 0.0).astype(np.float64)
    return [model["languages"][b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist())], score


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score) of every row; nothing but ``text`` is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (part for b in batches for part in grams.blocks(b)):
            names, score = classify(shared.value, block.column("text"))
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
            )

    return docs.select("doc_id", "text").mapInArrow(W.task(run), "doc_id long, lang_pred string, score double")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document; every third one is held out of learning."""
    docs = table(spark, sf_dir, "documents")
    held_out = is_remainder(F.col("doc_id"), 3, 1)
    model = fit(docs.where(~held_out))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
