"""Removal of passages that an earlier document already has.

Method: Rabin-Karp hashes of every window of n consecutive words, counted in Spark; the repeated
windows of a document merge into maximal removal intervals.

A 13-word window repeated in two documents has the same words, so its smallest-hashed 5-word gram
(its anchor) is the same in both. Anchors are one in five grams. They are counted first, and only
windows whose anchor occurs in two documents are hashed, shuffled and counted in full. This loses no
window and moves a fraction of the rows; no group is ever gathered.

Hot hashes: a task that has met a hash in two documents knows the answer for all further ones. It sends
one or two rows of a hash to the count and marks the rest as decided; those go by hash *and* document, so a
passage that a third of all documents share is spread over all tasks. The mark is the lowest bit of
the hash, which therefore has 63 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierglass.llm import words as W
from tierglass.llm.common import extended, table

WINDOW = 13
GRAM = 5
#: Hashes that a task remembers as met in two documents. Beyond them rows are counted in the shuffle.
REMEMBERED = 1 << 18
_EVEN = np.uint64((1 << 64) - 2)


def window_hashes(h: np.ndarray, word_offsets: np.ndarray, window: int, gram: int):
    """Windows that lie within one text: first word, hash, and hash of the anchor."""
    full = W.windows(h, window)
    if not len(full):
        return np.zeros(0, np.int64), full, full
    text = np.repeat(np.arange(len(word_offsets) - 1), np.diff(word_offsets))
    first = np.flatnonzero(text[: len(full)] == text[window - 1 :])
    grams = W.windows(h, gram)
    anchor = grams[: len(full)].copy()
    for step in range(1, window - gram + 1):
        np.minimum(anchor, grams[step : step + len(full)], out=anchor)
    return first, full[first] & _EVEN, anchor[first] & _EVEN


def _scan(batch: pa.RecordBatch, window: int, gram: int):
    data, offsets = W.buffers(batch.column("text"))
    starts, ends, word_offsets = W.bounds(data, offsets)
    first, full, anchor = window_hashes(W.hashes(data, starts, ends), word_offsets, window, gram)
    text = np.searchsorted(word_offsets, first, "right") - 1
    return data, offsets, starts, ends, word_offsets, first, full.view(np.int64), anchor.view(np.int64), text


class _Decided:
    """Marks the rows of a task whose answer its earlier rows give, so that they need no count.

    With ``smaller`` the question is whether a hash is in a document with a smaller id, else whether it is
    in two documents. What is not marked goes to the count, which then gives the same answer.
    """

    def __init__(self, smaller: bool, limit: int = REMEMBERED):
        self.smaller, self.limit = smaller, limit
        self.hashes, self.least = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows(self, ids: pa.Array, text: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        """Distinct (h, doc_id) rows of a batch; ``h`` of a decided row is odd."""
        docs = ids.take(pa.array(text)).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((docs, values))
        docs, values = docs[order], values[order]
        fresh = np.append(True, values[1:] != values[:-1]) if len(values) else np.zeros(0, bool)
        keep = fresh.copy()
        keep[1:] |= docs[1:] != docs[:-1]
        docs, values, fresh = docs[keep], values[keep], fresh[keep]
        group = np.flatnonzero(fresh)
        size = np.diff(np.append(group, len(values)))
        place = np.minimum(np.searchsorted(self.hashes, values[group]), max(len(self.hashes) - 1, 0))
        old = self.hashes[place] == values[group] if len(self.hashes) else np.zeros(len(group), bool)
        least = docs[group].copy()
        if self.smaller:
            least[old] = np.minimum(least[old], self.least[place[old]])
            decided = docs > np.repeat(least, size)
        else:
            last = np.append(fresh[1:], True)[: len(values)]
            decided = np.repeat(old, size) | ~(fresh | last)
        if len(self.hashes):
            self.least[place[old]] = least[old]
        self._remember(values[group][new := ~old & (size > 1)], least[new])
        sent = np.where(decided, (values ^ _salts(docs)) | 1, values)
        return pa.RecordBatch.from_arrays([pa.array(sent, pa.int64()), pa.array(docs, pa.int64())], ["h", "doc_id"])

    def _remember(self, hashes: np.ndarray, least: np.ndarray) -> None:
        room = self.limit - len(self.hashes)
        if room > 0 and len(hashes):
            joined = np.concatenate([self.hashes, hashes[:room]])
            order = np.argsort(joined, kind="stable")
            self.hashes, self.least = joined[order], np.concatenate([self.least, least[:room]])[order]


def _salts(docs: np.ndarray) -> np.ndarray:
    return W.mix(docs.astype(np.int64).view(np.uint64).copy()).view(np.int64)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): what earlier documents have is taken out.

    Returns doc_id, n_words, n_removed, kept_text (kept words joined by one blank) and removed, the
    maximal intervals of removed words as structs (first, end). A word goes if a window covering it
    has a word sequence that also starts in a document with a smaller doc_id; repeats within a
    document and among rows of one doc_id stay. A null text has no words. A null doc_id has no order:
    such rows stay whole and remove nothing. Columns named in ``carry`` are handed on, no other column
    is read.
    """
    columns = ["doc_id", "text", *(c for c in carry if c != "text")]
    out = extended(
        docs.select("doc_id", *carry).schema,
        "n_words long, n_removed long, kept_text string, removed array<struct<first:long,end:long>>",
    )

    known = docs.select(*columns).where("doc_id is not null")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decided = _Decided(smaller=False)
        for batch in (part for b in batches for part in W.slices(b)):
            *_, anchor, text = _scan(batch, window, gram)
            yield decided.rows(batch.column("doc_id"), text, anchor)

    # One exchange by anchor serves the count and the way back to the documents. Spark shares it only
    # if both sides read the very same plan, so the filters that joins would add are stated here.
    seen = (
        known.select("doc_id", "text")
        .mapInArrow(W.task(anchors), "h long, doc_id long")
        .where("h is not null and doc_id is not null")
        .repartition("h")
    )
    marked = F.col("h").bitwiseAND(F.lit(1)) == 1
    shared = _in_two_documents(seen).select("h", F.lit(True).alias("shared"))
    candidates = (
        seen.join(shared.hint("merge"), "h", "left")
        .where(marked | F.col("shared"))
        .groupBy("doc_id")
        .agg(F.collect_set("h").alias("candidates"))
    )
    # The same exchange of texts is used here and in the last join, hence two left joins. A task that is
    # run again must mark the same rows, so rows of one id have an order, too.
    texts = known.repartition("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decided = _Decided(smaller=True)
        for batch in (part for b in batches for part in W.slices(b)):
            if batch.column("candidates").null_count == len(batch):
                continue
            *_, full, anchor, text = _scan(batch, window, gram)
            keep = _among(batch, "candidates", text, anchor)
            yield decided.rows(batch.column("doc_id"), text[keep], full[keep])

    windows = (
        texts.join(candidates.hint("merge"), "doc_id", "left")
        .mapInArrow(W.task(repeats), "h long, doc_id long")
        .where("h is not null and doc_id is not null")
        .repartition("h")
    )
    first = _in_two_documents(windows).select("h", F.col("first").alias("first_doc"))
    removed = (
        windows.join(first.hint("merge"), "h", "left")
        .where(marked | (F.col("doc_id") > F.col("first_doc")))
        .groupBy("doc_id")
        .agg(F.collect_set("h").alias("gone"))
    )

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in W.slices(b)):
            yield _kept(batch, window, gram, carry)

    # Rows without an id have no order and meet nothing, so they are not shuffled.
    unknown = docs.select(*columns).where("doc_id is null").withColumn("gone", F.lit(None).cast("array<long>"))
    kept = texts.join(removed.hint("merge"), "doc_id", "left").mapInArrow(W.task(keep), out)
    return kept.unionByName(unknown.mapInArrow(W.task(keep), out))


def _in_two_documents(rows: DataFrame) -> DataFrame:
    """Hashes of (h, doc_id) that two documents have, and the smaller id."""
    return (
        rows.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    )


def _among(batch: pa.RecordBatch, name: str, text: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is in the set of its text, whose odd members are read by the text's id."""
    sets, keep = batch.column(name), np.zeros(len(values), bool)
    borders = np.searchsorted(text, np.arange(len(sets) + 1))
    for i in range(len(sets)):
        if sets[i].is_valid and borders[i] < borders[i + 1]:
            own = np.asarray(sets[i].values, np.int64)
            if len(own):
                salt = _salts(np.array([batch.column("doc_id")[i].as_py()], np.int64))
                own = np.sort(np.where(own & 1, (own ^ salt) & -2, own))
                asked = values[borders[i] : borders[i + 1]]
                found = np.minimum(np.searchsorted(own, asked), len(own) - 1)
                keep[borders[i] : borders[i + 1]] = own[found] == asked
    return keep


def _kept(batch: pa.RecordBatch, window: int, gram: int, carry: tuple[str, ...]) -> pa.RecordBatch:
    data, offsets, starts, ends, word_offsets, first, full, _, text = _scan(batch, window, gram)
    hit = first[_among(batch, "gone", text, full)]
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, hit, 1)
    np.add.at(change, hit + window, -1)
    gone = np.cumsum(change[:-1]) > 0
    n_removed = np.add.reduceat(np.append(gone, False).astype(np.int64), word_offsets[:-1]) if len(batch) else []
    raw, texts, spans = data.tobytes(), [], []
    for i in range(len(batch)):
        a, b = word_offsets[i], word_offsets[i + 1]
        own = gone[a:b]
        texts.append(b" ".join([raw[s:e] for s, e in zip(starts[a:b][~own].tolist(), ends[a:b][~own].tolist())]))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
        spans.append([{"first": int(s), "end": int(e)} for s, e in zip(edges[::2], edges[1::2])])
    n_words = np.diff(word_offsets)
    return pa.RecordBatch.from_arrays(
        [
            *(batch.column(c) for c in ("doc_id", *carry)),
            pa.array(n_words, pa.int64()),
            pa.array(np.where(n_words > 0, n_removed, 0), pa.int64()),
            pa.array([t.decode("utf-8") for t in texts], pa.string()),
            pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
        ],
        ["doc_id", *carry, "n_words", "n_removed", "kept_text", "removed"],
    )


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Digest of every document after removal of repeated 13-word windows."""
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT rid, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM texts),
windows AS (
  SELECT rid, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
  FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM texts)),
earliest AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s),
gone AS (
  SELECT DISTINCT rid, i + k AS i FROM windows JOIN earliest USING (s), range(13) r(k) WHERE first < doc_id),
kept AS (
  SELECT rid, count(*) FILTER (WHERE g.i IS NOT NULL) AS n_removed,
    string_agg(word, ' ' ORDER BY i) FILTER (WHERE g.i IS NULL) AS t
  FROM words LEFT JOIN gone g USING (rid, i) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (rid)
"""


def brute_force(rows: list[tuple], window: int = WINDOW) -> list[tuple]:
    """Plain-Python answer for small inputs, for tests."""
    import re

    texts = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    starts: dict[tuple, list] = {}
    for d, w in texts:
        for i in range(len(w) - window + 1):
            if d is not None:
                starts.setdefault(tuple(w[i : i + window]), []).append(d)
    out = []
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and min(starts[tuple(w[i : i + window])]) < d:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
