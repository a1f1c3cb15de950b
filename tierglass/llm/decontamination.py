"""Documents that hold passages of a benchmark, by winnowing.

The fingerprints of a text are the least k-gram hashes of all windows of consecutive words (k + w - 1
= ``window`` words hold w grams). A passage of that many words has the same least gram wherever it
stands, so any shared passage has a shared fingerprint. Items shorter than a window are one window of
their own size, whose whole gram is its fingerprint.

Fingerprints of documents meet those of the benchmark in a Bloom filter of bounded size, built by
Spark; what passes is extended to the windows around it and joined by fingerprint and window. Windows
with the same set of items form a class, so a passage that many items share is listed once, not once
for every document and item.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierglass.llm import words as W
from tierglass.llm.common import cut, extended, table

WINDOW = 10
GRAM = 5
#: Bits of the filter for each window, and at most. Beyond, more candidates pass; the result is the same.
BITS_EACH = 16
MAX_BITS = 1 << 26
PROBES = 4

#: Lower-cases A-Z and turns every other ASCII byte but 0-9 and a-z into a blank.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)

CLASS = ("class_a", "class_b", "class_n")


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = W.buffers(texts)
    data = _FOLD[data]
    starts, ends, word_offsets = W.bounds(data, offsets)
    return W.hashes(data, starts, ends), word_offsets


def _inside(word_offsets: np.ndarray, size: int) -> np.ndarray:
    """First words of all windows of this size that lie within one text."""
    text = np.repeat(np.arange(len(word_offsets) - 1), np.diff(word_offsets))
    n = len(text) - size + 1
    return np.flatnonzero(text[:n] == text[size - 1 :]) if n > 0 else np.zeros(0, np.int64)


def _least_grams(h: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The fingerprint of the window that starts at each word."""
    grams = W.windows(h, gram)
    least = grams[: max(0, len(h) - window + 1)].copy()
    for step in range(1, window - gram + 1):
        np.minimum(least, grams[step : step + len(least)], out=least)
    return least


def item_windows(items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Distinct rows (item_id, anchor, h, size): every window of every item with its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in W.slices(b)):
            h, word_offsets = _word_hashes(batch.column("text"))
            counts = np.diff(word_offsets)
            for size in range(1, window + 1):
                if size == window:
                    first = _inside(word_offsets, size)
                    anchors = _least_grams(h, window, gram)
                else:
                    first = word_offsets[:-1][counts == size]
                    anchors = W.windows(h, size)
                if not len(first):
                    continue
                owner = np.searchsorted(word_offsets, first, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("item_id").take(pa.array(owner)),
                        pa.array(anchors[first].view(np.int64)),
                        pa.array(W.windows(h, size)[first].view(np.int64)),
                        pa.array(np.full(len(first), size, np.int32)),
                    ],
                    ["item_id", "anchor", "h", "size"],
                )

    out = extended(items.select("item_id").schema, "anchor long, h long, size int")
    return items.select("item_id", "text").mapInArrow(W.task(run), out).distinct()


def _filter(windows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A Bloom filter of all fingerprints, and the window sizes there are."""
    sizes = {r["size"]: r["n"] for r in windows.groupBy("size").agg(F.count("*").alias("n")).collect()}
    want = max(1 << 12, BITS_EACH * sum(sizes.values()))
    bits = min(MAX_BITS, 1 << (want - 1).bit_length())
    step = F.shiftrightunsigned("anchor", 32).bitwiseOR(F.lit(1))
    probes = F.array(*[(F.col("anchor").bitwiseAND(bits - 1) + i * step).bitwiseAND(bits - 1) for i in range(PROBES)])
    # At most one row for every 32 bits of the filter reaches the driver.
    cells = (
        windows.select(F.explode(probes).alias("at"))
        .groupBy(F.shiftright("at", 5).alias("cell"))
        .agg(F.expr("bit_or(shiftleft(1L, CAST(at % 32 AS INT)))").alias("value"))
        .toArrow()
    )
    out = np.zeros(bits // 32, np.uint32)
    out[cells.column("cell").to_numpy()] = cells.column("value").to_numpy().astype(np.uint32)
    return out, sorted(sizes)


def _passes(h: np.ndarray, cells: np.ndarray) -> np.ndarray:
    mask = np.uint64(32 * len(cells) - 1)
    step = (h >> np.uint64(32)) | np.uint64(1)
    keep = np.arange(len(h))
    for i in range(PROBES):
        at = ((h[keep] & mask) + np.uint64(i) * step[keep]) & mask
        hit = (cells[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1)
        keep = keep[hit.astype(bool)]
    out = np.zeros(len(h), bool)
    out[keep] = True
    return out


def _candidates(h: np.ndarray, word_offsets: np.ndarray, cells, sizes: list[int], window: int, gram: int):
    """Windows whose fingerprint passes the filter: first word, size, fingerprint, hash."""
    found = []
    for size in sizes:
        if size < window:
            first = _inside(word_offsets, size)
            anchors = W.windows(h, size)
            first = first[_passes(anchors[first], cells)]
        else:
            anchors = _least_grams(h, window, gram)
            if not len(anchors):
                continue
            # A fingerprint serves all windows that share it, so each is looked up once.
            new = np.concatenate([[True], anchors[1:] != anchors[:-1]])
            hit = np.repeat(_passes(anchors[new], cells), np.diff(np.append(np.flatnonzero(new), len(anchors))))
            first = _inside(word_offsets, size)
            first = first[hit[first]]
        if len(first):
            found.append((first, np.full(len(first), size, np.int32), anchors[first], W.windows(h, size)[first]))
    if not found:
        return (np.zeros(0, np.int64), np.zeros(0, np.int32), *(np.zeros(0, np.uint64) for _ in range(2)))
    return tuple(np.concatenate(x) for x in zip(*found))


def _scan(docs: DataFrame, cells, sizes: list[int], window: int, gram: int) -> DataFrame:
    """Every document with its number of words and the windows that pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(cells)
    fields = [("first", pa.int64()), ("size", pa.int32()), ("anchor", pa.int64()), ("h", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in W.slices(b)):
            h, word_offsets = _word_hashes(batch.column("text"))
            first, size, anchor, whole = _candidates(h, word_offsets, shared.value, sizes, window, gram)
            owner = np.searchsorted(word_offsets, first, "right") - 1
            order = np.argsort(owner, kind="stable")
            first, owner = first[order], owner[order]
            values = [
                pa.array(first - word_offsets[owner]),
                pa.array(size[order]),
                pa.array(anchor[order].view(np.int64)),
                pa.array(whole[order].view(np.int64)),
            ]
            each = np.searchsorted(owner, np.arange(len(batch) + 1)).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(each), pa.StructArray.from_arrays(values, [n for n, _ in fields]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(word_offsets), pa.int64()), found], ["doc_id", "n_words", "found"]
            )

    out = extended(
        docs.select("doc_id").schema,
        "n_words long, found array<struct<first:long,size:int,anchor:long,h:long>>",
    )
    return docs.select("doc_id", "text").mapInArrow(W.task(run), out)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each document merged to maximal spans."""
    for batch in batches:
        hits = batch.column("hits")
        spans, totals = [], []
        for i in range(len(batch)):
            part = hits[i].values
            first = part.field("first").to_numpy() if part is not None else np.zeros(0, np.int64)
            if not len(first):
                spans.append([])
                totals.append(0)
                continue
            order = np.argsort(first, kind="stable")
            first = first[order]
            reach = np.maximum.accumulate(first + part.field("size").to_numpy()[order])
            new = np.concatenate([[True], first[1:] > reach[:-1]])
            starts, ends = first[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(first) - 1)]
            spans.append([{"first": int(a), "end": int(b)} for a, b in zip(starts, ends)])
            totals.append(int((ends - starts).sum()))
        kept = [batch.column(c) for c in ("_row", "doc_id", "n_words", "classes")]
        yield pa.RecordBatch.from_arrays(
            [
                *kept,
                pa.array(totals, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
            ],
            ["_row", "doc_id", "n_words", "classes", "n_hit", "spans"],
        )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with what it shares with ``items`` (item_id, text).

    Returns doc_id, n_words, n_hit (words inside an occurrence of a window of an item), spans (maximal
    stretches of such words, as structs (first, end)), n_items, items (ids as strings, sorted) and
    items_sha256 (of the ids joined by commas). Null, empty and wordless texts have no words and no
    windows; rows of one doc_id, or of none, are judged each for itself. Rows of one item_id are one
    item; an item without an id marks words and is not listed. Other columns are not read. Empty tables
    give no rows, or rows without hits.
    """
    if not 0 < gram <= window:
        raise ValueError("a window holds at least one gram")
    grams = cut(item_windows(items, window, gram))
    cells, sizes = _filter(grams)
    windows = cut(
        grams.groupBy("anchor", "h", "size").agg(
            F.expr("bit_xor(xxhash64(item_id))").alias("class_a"),
            F.expr("bit_xor(xxhash64(item_id, 1))").alias("class_b"),
            F.count("item_id").alias("class_n"),
        )
    )
    of_class = windows.groupBy(*CLASS).agg(F.min(F.struct("anchor", "h", "size")).alias("w")).select(*CLASS, "w.*")
    members = grams.where("item_id is not null").join(of_class, ["anchor", "h", "size"]).select(*CLASS, "item_id")

    scanned = cut(_scan(docs, cells, sizes, window, gram).withColumn("_row", F.monotonically_increasing_id()))
    candidates = scanned.where("size(found) > 0").select("_row", "doc_id", "n_words", F.inline("found"))
    matched = F.col("class_n").isNotNull()
    schema = extended(
        scanned.select("_row", "doc_id", "n_words").schema,
        "classes array<struct<class_a:long,class_b:long,class_n:long>>, n_hit long, spans array<struct<first:long,end:long>>",
    )
    hits = cut(
        candidates.join(windows, ["anchor", "h", "size"], "left")
        .groupBy("_row", "doc_id", "n_words")
        .agg(
            F.collect_list(F.when(matched, F.struct("first", "size"))).alias("hits"),
            F.sort_array(F.collect_set(F.when(matched, F.struct(*CLASS)))).alias("classes"),
        )
        .mapInArrow(W.task(_spans), schema)
        .withColumn("set_a", F.xxhash64("classes"))
        .withColumn("set_b", F.xxhash64(F.lit(1), "classes"))
    )
    # Documents with the same classes have the same items: listed once for each set of classes.
    sets = hits.where("n_hit > 0").groupBy("set_a", "set_b").agg(F.first("classes").alias("classes"))
    listed = (
        sets.select("set_a", "set_b", F.inline("classes"))
        .join(members, list(CLASS))
        .select("set_a", "set_b", F.col("item_id").cast("string").alias("item"))
        .groupBy("set_a", "set_b")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
        .withColumn("items_sha256", F.sha2(F.concat_ws(",", "items"), 256))
    )
    columns = ["doc_id", "n_words", "n_hit", "spans", "items", "items_sha256"]
    dirty = hits.join(listed, ["set_a", "set_b"], "left").select(*columns)
    clean = scanned.where("size(found) = 0").select(
        "doc_id",
        "n_words",
        F.lit(0).cast("long").alias("n_hit"),
        F.expr("CAST(array() AS array<struct<first:long,end:long>>)").alias("spans"),
        F.lit(None).cast("array<string>").alias("items"),
        F.lit(None).cast("string").alias("items_sha256"),
    )
    none = hashlib.sha256(b"").hexdigest()
    return (
        dirty.unionAll(clean)
        .withColumn("items", F.coalesce("items", F.expr("CAST(array() AS array<string>)")))
        .withColumn("items_sha256", F.coalesce("items_sha256", F.lit(none)))
        .withColumn("n_items", F.size("items").cast("long"))
        .select("doc_id", "n_words", "n_hit", "spans", "n_items", "items", "items_sha256")
    )


def op11_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """What every document shares with the benchmark, as a digest."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated")
    )


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM grams),
places AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT rid, i, n, item_id FROM places JOIN grams USING (n, s)),
covered AS (
  SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS k FROM hits) GROUP BY rid),
named AS (
  SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """Plain-Python answer for small inputs, for tests."""

    def split(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    grams: dict[tuple, set] = {}
    for item, text in items:
        w = split(text)
        size = min(len(w), window)
        for i in range(len(w) - size + 1) if w else ():
            grams.setdefault(tuple(w[i : i + size]), set()).add(item)
    sizes = {len(g) for g in grams}
    out = []
    for doc, text in docs:
        w, hit, ids = split(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (owners := grams.get(tuple(w[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    ids |= owners
        ids = sorted(str(x) for x in ids if x is not None)
        sha = hashlib.sha256(",".join(ids).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(ids), sha, bool(hit)))
    return out
