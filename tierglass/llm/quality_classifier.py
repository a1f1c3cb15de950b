"""Quality of texts by nearest-neighbour voting in a latent-semantic space.

A text is a vector of terms: roots of the shares of its hashed byte 1- and 2-grams, weighted by inverse
document frequency, and three repetition terms (words equal to the one before, repeated words,
repeated lines). It is projected on the leading singular vectors of a bounded labelled sample. The sample's vectors are
broadcast (``per_class`` x 2 x ``rank`` numbers at most); every text is compared with all of them by
blocked matrix products, and its nearest ones vote with their cosine as weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierglass.llm import grams
from tierglass.llm import words as W
from tierglass.llm.common import extended, is_remainder, table

SIZES = (1, 2)
WIDTH = 2048
REPETITION = np.array([2, 0.5, 1], np.float32)
PER_CLASS = 1024
RANK = 64
NEIGHBOURS = 15
THRESHOLD = 0.7


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, rank: int = RANK) -> dict:
    """Model from the rows of ``labels`` (doc_id, quality 0 or 1), at most ``per_class`` of each class.

    Only labels whose document is not held out are given. A document with labels of both kinds, a null
    label or a null id teaches nothing. The sample is the ids of least hash, so it is the same on
    every run. The share of label 1 covers all labels and is the score of a text without grams.
    """
    agreed = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .where("quality = other")
        .select("doc_id", "quality")
    )
    share, *totals = agreed.agg(
        F.avg("quality"), F.count_if(F.col("quality") == 0), F.count_if(F.col("quality") == 1)
    ).first()
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = agreed.where("quality = 0").orderBy(*by_hash).limit(per_class)
    sample = sample.unionAll(agreed.where("quality = 1").orderBy(*by_hash).limit(per_class))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (part for b in batches for part in grams.blocks(b)):
            found = terms(block.column("text"))
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("quality"), pa.array([x.tobytes() for x in found], pa.binary())],
                ["doc_id", "quality", "terms"],
            )

    # The sample has a fixed bound, so it is broadcast to the texts.
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")
        .mapInArrow(W.task(features), "doc_id long, quality int, terms binary")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"), F.max("terms").alias("terms"))
        .orderBy("doc_id")
        .collect()
    )
    x = np.array([np.frombuffer(r["terms"], np.float32) for r in rows]).reshape(len(rows), WIDTH + len(REPETITION))
    y = np.array([r["quality"] for r in rows], np.float32)
    idf = np.log((1 + len(x)) / (1 + (x[:, :WIDTH] > 0).sum(0))).astype(np.float32) + 1
    x = _weighted(x, idf)
    values, left = np.linalg.eigh(x @ x.T) if len(x) else (np.zeros(0), np.zeros((0, 0)))
    keep = [i for i in np.argsort(-values)[:rank].tolist() if values[i] > 1e-6]
    basis = (x.T @ left[:, keep] / np.sqrt(values[keep])).astype(np.float32)
    return {
        "idf": idf,
        "basis": basis,
        "vectors": _unit(x @ basis),
        "labels": y,
        # Labels that a vector stands for, so that votes weigh the classes as the labels do.
        "stands": np.array([totals[int(q)] / max(1, (y == q).sum()) for q in y], np.float32),
        "share": 0.5 if share is None else float(share),
    }


def terms(texts: pa.Array) -> np.ndarray:
    """Roots of gram shares, then the repetition terms."""
    found = grams.counts(texts, SIZES, WIDTH)
    found = np.sqrt(found / np.maximum(found.sum(1, keepdims=True), 1))
    return np.hstack([found, grams.repetition(texts)]).astype(np.float32)


def _weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.hstack([_unit(x[:, :WIDTH] * idf), x[:, WIDTH:] * REPETITION]))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def votes(model: dict, texts: pa.Array, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Score of each text: weighted share of label 1 among its nearest labelled vectors.

    A vote weighs its cosine times the labels its vector stands for: the classes are sampled at
    different rates, and a score means the same however many labels there are. Equal cosines count the earlier vector first. Without any neighbour of positive cosine (no text,
    no model) the score is the share of label 1 among all labels.
    """
    refs, k = model["vectors"], min(neighbours, len(model["vectors"]))
    out = np.full(len(texts), model["share"])
    if not k or not refs.shape[1]:
        return out
    cosine = _unit(_weighted(terms(texts), model["idf"]) @ model["basis"]) @ refs.T
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64)
    if "stands" in model:
        weight *= model["stands"][near]
    total = weight.sum(1)
    some = total > 0
    out[some] = (weight * model["labels"][near]).sum(1)[some] / total[some]
    return np.clip(out, 0, 1)


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` plus score double and predicted int; same-named columns are replaced.

    Every row gets a score: null, empty and very long texts (scored whole), repeated rows one each.
    """
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (part for b in batches for part in grams.blocks(b)):
            found = votes(shared.value, block.column("text"))
            yield pa.RecordBatch.from_arrays(
                [*block.columns, pa.array(found), pa.array((found >= threshold).astype(np.int32))],
                [*block.schema.names, "score", "predicted"],
            )

    return docs.mapInArrow(W.task(run), extended(docs.schema, "score double, predicted int"))


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels of documents that are not held out."""
    return labels.where(~is_remainder(F.col("doc_id"), 4, 2)).select("doc_id", F.col("quality").cast("int").alias("quality"))


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Score and verdict of every document; every fourth one is held out of learning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, training_labels(table(spark, sf_dir, "labels")))
    held_out = is_remainder(F.col("doc_id"), 4, 2).alias("held_out")
    return score(docs, model).select("doc_id", held_out, "score", "predicted")
