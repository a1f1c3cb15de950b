"""SimHash near-duplicates by a generalised pigeonhole.

A fingerprint bit is set where more than half of the shingle hashes have it. Two fingerprints link
if at most ``bits`` bits differ.

The 64 bits are grouped into m partitions of correlated bits, and partition i gets a threshold e_i of
-1 (not probed) or more, all summing to bits - m + 1. Two linked fingerprints then differ by at most
e_i bits in some partition i, whatever the thresholds. Grouping and thresholds come from a bounded
sample of fingerprints and decide the cost, never the result: dynamic programming picks the
thresholds with the fewest expected candidates, over several m.

Only distinct fingerprints are compared. Buckets of up to ``bucket`` fingerprints are verified
inside one row and give a spanning forest. Fingerprints of larger buckets are linked exactly without
pairs: each is put under itself and its one-bit (for more bits: further) neighbours, and two
fingerprints that share such a key are within 2 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierglass.llm import words as W
from tierglass.llm.common import cut, table
from tierglass.llm.components import components

SHINGLE = 3
BITS = 2
BUCKET = 128
SAMPLE = 2048
SEED = 42


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint long) of every row; no words give zero, few words one shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in W.slices(b)):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(_fingerprints(batch.column("text"), shingle))], ["doc_id", "fp"]
            )

    return docs.select("doc_id", "text").mapInArrow(W.task(run), "doc_id long, fp long")


def _fingerprints(texts: pa.Array, shingle: int) -> np.ndarray:
    data, offsets = W.buffers(texts)
    data = W.lower(data)
    starts, ends, word_offsets = W.bounds(data, offsets)
    # All words with one blank after each, so that a shingle is one byte range.
    size = ends - starts + 1
    at = np.concatenate([[0], np.cumsum(size)])
    joined = np.full(at[-1], 32, np.uint8)
    inside = np.repeat(starts - at[:-1], size) + np.arange(at[-1])
    own = np.ones(at[-1], bool)
    own[at[1:] - 1] = False
    joined[own] = data[inside[own]]
    raw = joined.tobytes()
    counts = np.diff(word_offsets)
    n = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    shingle_offsets = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(word_offsets[:-1] - shingle_offsets[:-1], n) + np.arange(shingle_offsets[-1])
    last = first + np.minimum(shingle, np.repeat(counts, n))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter(
        (digest(raw[a:b], SEED) for a, b in zip(at[first].tolist(), (at[last] - 1).tolist())), np.uint64, len(first)
    )
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, shingle_offsets[:-1][some], axis=0, dtype=np.int64)
        packed = np.packbits(2 * ones > n[some, None], axis=1, bitorder="little")
        out[some] = packed.view(np.uint64).ravel()
    return out.view(np.int64)


def plan(sample: np.ndarray, n: int, bits: int = BITS) -> list[tuple[list[int], int]]:
    """Partitions (bit numbers, threshold) for n fingerprints like those of the sample."""
    if len(sample) < 2:
        sample = np.array([0, -1], np.int64)
    b = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
    centred = b - b.mean(0)
    spread = np.sqrt((centred**2).mean(0)) + 1e-6
    alike = np.abs((centred.T @ centred) / len(b) / np.outer(spread, spread))
    best, best_cost = None, None
    for m in range(1, bits + 3):
        groups = _groups(alike, m)
        pairs = [_pair_shares(b[:, g], bits) for g in groups]
        # cost: expected candidate pairs, plus the rows that probing writes
        cost = [
            [0.0, *(n * n * pairs[i][e] / 2 + 4 * n * _ball(len(groups[i]), e) for e in range(bits + 1))]
            for i in range(m)
        ]
        total, thresholds = _allocate(cost, bits - m + 1)
        if best_cost is None or total < best_cost:
            best, best_cost = list(zip(groups, thresholds)), total
    return [(g, e) for g, e in best if e >= 0]


def _groups(alike: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal size, each grown by the bit most alike to those it has."""
    left, groups = list(range(64)), []
    for k in range(m):
        size = 64 // m + (k < 64 % m)
        group = [left.pop(int(np.argmax(alike[np.ix_(left, left)].sum(1))))]
        while len(group) < size:
            group.append(left.pop(int(np.argmax(alike[np.ix_(left, group)].sum(1)))))
        groups.append(sorted(group))
    return groups


def _pair_shares(b: np.ndarray, bits: int) -> list[float]:
    """Share of sampled pairs that differ by at most 0, 1, ... bits here; a pair more than seen."""
    ones = b.sum(1)
    distance = ones[:, None] + ones[None, :] - 2 * (b @ b.T)
    pairs = len(b) * (len(b) - 1) / 2
    near = [((distance <= e + 0.5).sum() - len(b)) / 2 for e in range(bits + 1)]
    return [(x + _ball(b.shape[1], e) / 2 ** min(b.shape[1], 60)) / pairs for e, x in enumerate(near)]


def _ball(size: int, e: int) -> int:
    return sum(comb(size, k) for k in range(e + 1))


def _allocate(cost: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 on with this sum and the least cost, by dynamic programming."""
    states: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        following: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in states.items():
            for k, extra in enumerate(row):
                key, value = used + k - 1, c + extra
                if key not in following or value < following[key][0]:
                    following[key] = (value, [*chosen, k - 1])
        states = following
    return states[total]


def _neighbours(fps: np.ndarray, group: list[int], e: int) -> np.ndarray:
    """Every fingerprint with up to e of the group's bits flipped, one row per fingerprint."""
    flips = [sum(1 << b for b in c) for k in range(e + 1) for c in combinations(group, k)]
    return fps[:, None] ^ np.array(flips, np.uint64)[None, :]


def links(distinct: DataFrame, parts: list[tuple[list[int], int]], bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints (fp) linked directly or by others."""

    def signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64).view(np.uint64)
            for k, (group, e) in enumerate(parts):
                mask = np.uint64(sum(1 << b for b in group))
                for piece in np.array_split(fps, max(1, len(fps) * _ball(len(group), e) // 200_000)):
                    near = _neighbours(piece & mask, group, e)
                    yield pd.DataFrame(
                        {
                            "part": np.full(near.size, k, np.int32),
                            "key": near.ravel().view(np.int64),
                            "fp": np.repeat(piece, near.shape[1]).view(np.int64),
                        }
                    )

    rows = distinct.mapInPandas(signatures, "part int, key long, fp long")
    sizes = rows.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, ["part", "key"])

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def verified(members: pd.Series) -> pd.Series:
        return members.map(lambda x: _forest(np.unique(np.asarray(x, np.int64)), bits))

    small = (
        rows.where(F.col("n") <= bucket)
        .groupBy("part", "key")
        .agg(F.collect_list("fp").alias("members"))
        .select(F.inline(verified("members")))
    )
    large = rows.where(F.col("n") > bucket).select("fp").distinct()

    def stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64).view(np.uint64)
            for piece in np.array_split(fps, max(1, len(fps) // 2000)):
                near = _neighbours(piece, list(range(64)), bits // 2)
                yield pd.DataFrame(
                    {"key": near.ravel().view(np.int64), "fp": np.repeat(piece, near.shape[1]).view(np.int64)}
                )

    if bits % 2:  # keys meet at an even distance only; odd distances are verified in blocks
        raise ValueError("an odd bit distance needs keys of two kinds, which no caller asks for")
    keyed = large.mapInPandas(stars, "key long, fp long")
    heads = keyed.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("last")).where("a < last")
    starred = keyed.join(heads, "key").where("fp <> a").select("a", F.col("fp").alias("b"))
    return small.unionAll(starred).distinct()


def _forest(fps: np.ndarray, bits: int) -> list[dict]:
    """Edges of a spanning forest of the fingerprints within this distance of each other."""
    apart = np.bitwise_count(fps[:, None].view(np.uint64) ^ fps[None, :].view(np.uint64))
    root = list(range(len(fps)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in np.argwhere(np.triu(apart <= bits, 1)).tolist():
        if (a := find(i)) != (b := find(j)):
            root[max(a, b)] = min(a, b)
            out.append({"a": int(fps[i]), "b": int(fps[j])})
    return out


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) of every row of ``docs``.

    component_id is the smallest doc_id reachable over links, itself included. Texts without words,
    null ones too, have fingerprint zero and link like any other. Repeated rows and rows with a null
    doc_id get a row each; null ids never name a component unless it has no other.
    """
    marked = cut(fingerprints(docs, shingle))
    groups = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    distinct = groups.select("fp")
    n = distinct.count()
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64)
    linked = components(links(distinct, plan(sample, n, bits), bits, bucket))
    rooted = cut(groups.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def brute_force(rows: list[tuple], shingle: int = SHINGLE, bits: int = BITS) -> list[tuple]:
    """Plain-Python answer for small inputs, for tests."""
    import re

    fps = []
    for _, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        s = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), SEED) for x in s]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    left, names = set(range(len(rows))), [None] * len(rows)
    while left:
        group, todo = [], [left.pop()]
        while todo:
            i = todo.pop()
            group.append(i)
            near = [j for j in left if (fps[i] ^ fps[j]).bit_count() <= bits]
            left.difference_update(near)
            todo += near
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        for i in group:
            names[i] = min(ids, default=None)
    return [(d, f"{fp:016x}", c) for (d, _), fp, c in zip(rows, fps, names)]
