"""Maximal periodic runs of words, by internal pattern matching.

A run of period q and three or more periods holds a block of 2^k words, 2^k <= q < 2^(k+1), that starts
at a multiple of 2^k and comes again q words later (periods under 8 use blocks of 8). So for every such
block that repeats in its text, the occurrences that start in the neighbouring window of 2^k words are
asked for. Occurrences of a block in so short a window form one arithmetic progression: the first, the
second and their number describe it. These are range-successor queries to a wavelet tree over the
suffix array; the progression gives the candidate periods, which are extended to both sides.

Only suffixes whose first 8 words come twice in their text enter the suffix array, others can't hold a
block. The texts of a slice share the arrays; a word is another symbol in another text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierglass.llm import words as W
from tierglass.llm.common import extended, table

LEAST = 24
PERIODS = 3
BLOCK = 8
#: Candidates that are extended at a time; bounds memory only.
CHUNK = 1 << 20

Order = Callable[[pa.Array, np.ndarray], tuple[np.ndarray, np.ndarray]]


class Wavelet:
    """Counts and order statistics of stretches of an array of numbers below 2^bits."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for bit in range(bits - 1, -1, -1):
            ones = (values >> bit) & 1
            zeros = np.concatenate([[0], np.cumsum(1 - ones)])
            self.levels.append((bit, zeros))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def below(self, start: np.ndarray, end: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many of values[start:end] are less than the limit."""
        start, end, count = start.copy(), end.copy(), np.zeros(len(start), np.int64)
        for bit, zeros in self.levels:
            a, b, up = zeros[start], zeros[end], ((limit >> bit) & 1).astype(bool)
            count += np.where(up, b - a, 0)
            start, end = np.where(up, zeros[-1] + start - a, a), np.where(up, zeros[-1] + end - b, b)
        return count

    def nth(self, start: np.ndarray, end: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The value with n smaller ones in values[start:end]."""
        start, end, n, value = start.copy(), end.copy(), n.copy(), np.zeros(len(start), np.int64)
        for bit, zeros in self.levels:
            a, b = zeros[start], zeros[end]
            up = n >= b - a
            n = np.where(up, n - (b - a), n)
            value |= np.where(up, 1 << bit, 0)
            start, end = np.where(up, zeros[-1] + start - a, a), np.where(up, zeros[-1] + end - b, b)
        return value


class Repeats:
    """The repeated blocks of the texts of a slice: their names by length, and the suffix array."""

    def __init__(self, h: np.ndarray, word_offsets: np.ndarray):
        self.h = h
        self.text = np.repeat(np.arange(len(word_offsets) - 1), np.diff(word_offsets))
        self.first, self.end = word_offsets[:-1][self.text], word_offsets[1:][self.text]
        #: For each level: the name of the block of BLOCK * 2^level words at a place, -1 if it is single.
        self.names: list[np.ndarray] = []
        n = len(h)
        if n <= BLOCK:
            return
        at = np.flatnonzero(self.text[: n - BLOCK + 1] == self.text[BLOCK - 1 :])
        key = W.mix(W.windows(h, BLOCK)[at] + self.text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self._name(at, key)
        size = BLOCK
        while self.names:
            before = self.names[-1]
            at = np.flatnonzero(before[: n - size] >= 0)
            at = at[before[at + size] >= 0]
            if not self._name(at, before[at].astype(np.int64) * (n + 1) + before[at + size]):
                break
            size *= 2
        if self.names:
            at = np.flatnonzero(self.names[0] >= 0)
            self.suffixes = at[np.lexsort([names[at] for names in reversed(self.names)])]
            self.wavelet = Wavelet(self.suffixes, max(1, n.bit_length()))
            self.rank = np.full(n + 1, -1, np.int64)
            self.rank[self.suffixes] = np.arange(len(self.suffixes))

    def _name(self, at: np.ndarray, key: np.ndarray) -> bool:
        """Name the blocks at these places by their keys; false if none comes twice."""
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        same = ordered[1:] == ordered[:-1]
        twice = np.zeros(len(at), bool)
        twice[1:] |= same
        twice[:-1] |= same
        if not twice.any():
            return False
        new = np.concatenate([[True], ~same])
        names = np.full(len(self.h) + 1, -1, np.int32)
        names[at[order[twice]]] = np.cumsum(new)[twice]
        self.names.append(names)
        return True

    def stretches(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place the part of the suffix array that starts with its block."""
        names = self.names[level][self.suffixes]
        new = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        group = np.searchsorted(new, self.rank[at], "right") - 1
        return new[group], np.append(new, len(names))[group + 1]

    def same(self, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
        """How many words from places x < y on (step 1), or before them (step -1), are equal."""
        from_, x, y, none = x, x.copy(), y.copy(), len(self.h)
        for level in range(len(self.names) - 1, -1, -1):
            names, size = self.names[level], BLOCK << level
            a, b = (x, y) if step > 0 else (np.where(x >= size, x - size, none), np.where(y >= size, y - size, none))
            more = (names[a] >= 0) & (names[a] == names[b])
            x, y = np.where(more, x + step * size, x), np.where(more, y + step * size, y)
        first, end = self.first[from_], self.end[from_]
        going = np.arange(len(x))
        for _ in range(BLOCK - 1):
            a, b = (x[going], y[going]) if step > 0 else (x[going] - 1, y[going] - 1)
            inside = b < end[going] if step > 0 else a >= first[going]
            going = going[inside]
            going = going[self.h[a[inside]] == self.h[b[inside]]]
            x[going] += step
            y[going] += step
        return np.abs(x - from_)


def find_runs(h: np.ndarray, word_offsets: np.ndarray, least: int = LEAST):
    """Runs of all texts: first word (in all texts), end, smallest period; by first word, then period.

    ``least`` is the length a run has at least, beside three periods: 24 or more.
    """
    repeats, found = Repeats(h, word_offsets), []
    for level in range(len(repeats.names)):
        size = BLOCK << level
        at = np.flatnonzero(repeats.names[level] >= 0)
        at = at[(at - repeats.first[at]) % size == 0]
        if not len(at):
            continue
        start, end = repeats.stretches(level, at)
        for nearest in (1, size) if level == 0 else (size,):
            until = 2 * size if nearest > 1 else size
            skipped = repeats.wavelet.below(start, end, np.minimum(at + nearest, len(h)))
            many = repeats.wavelet.below(start, end, np.minimum(at + until, len(h))) - skipped
            some = np.flatnonzero(many)
            if not len(some):
                continue
            a, b, skip, many, place = start[some], end[some], skipped[some], many[some], at[some]
            first = repeats.wavelet.nth(a, b, skip)
            step = repeats.wavelet.nth(a, b, np.minimum(skip + 1, b - a - 1)) - first
            # Where the block's own period goes on to an occurrence, that one is a multiple of it.
            covered = np.full(len(place), -1)
            three = np.flatnonzero(many > 2)
            covered[three] = place[three] + step[three] + repeats.same(place[three], place[three] + step[three], 1) - size
            for lo, hi in _chunks(many):
                j = np.arange(many[lo:hi].sum()) - np.repeat(np.cumsum(many[lo:hi]) - many[lo:hi], many[lo:hi])
                x = np.repeat(place[lo:hi], many[lo:hi])
                y = np.repeat(first[lo:hi], many[lo:hi]) + j * np.repeat(step[lo:hi], many[lo:hi])
                own = np.repeat(step[lo:hi], many[lo:hi])
                multiple = (y <= np.repeat(covered[lo:hi], many[lo:hi])) & (y - x > own) & ((y - x) % np.maximum(own, 1) == 0)
                found.append(_extended(repeats, x[~multiple], y[~multiple], least))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, end, period = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    # One stretch has several periods only as multiples of the smallest.
    keep = np.ones(len(start), bool)
    keep[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _chunks(many: np.ndarray) -> Iterator[tuple[int, int]]:
    part = (np.cumsum(many) - many) // CHUNK
    borders = np.flatnonzero(np.diff(part)) + 1
    yield from zip([0, *borders.tolist()], [*borders.tolist(), len(many)])


def _extended(repeats: Repeats, x: np.ndarray, y: np.ndarray, least: int):
    period = y - x
    can = PERIODS * period <= repeats.end[x] - repeats.first[x]
    x, y, period = x[can], y[can], period[can]
    start = x - repeats.same(x, y, -1)
    end = y + repeats.same(x, y, 1)
    long_ = end - start >= np.maximum(least, PERIODS * period)
    runs = np.unique(np.stack([start[long_], end[long_], period[long_]]), axis=1)
    return runs[0], runs[1], runs[2]


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All words with a blank after each, and where each one starts."""
    size = ends - starts + 1
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.append(data, np.uint8(32))[np.minimum(np.repeat(starts - at[:-1], size) + np.arange(at[-1]), len(data))]
    out[at[1:] - 1] = 32
    return out.tobytes(), at


def periodic_runs(docs: DataFrame, least: int = LEAST, order: Order | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with its runs of words that repeat at a period.

    A run is a stretch with smallest period q, at least ``least`` words and three periods long, that no
    neighbouring word extends. Returns doc_id, n_words, runs (structs start, length, period, by start
    and period), strongest (the run with the greatest length / period, then the smallest start, then
    period; null without runs) and collapsed_text (the words that no run holds after its first q words,
    joined by one blank).

    ``order`` may put other words of the text in a word's place: from ids and word counts it gives row
    numbers and, for each, the word numbers to take instead.

    Null, empty and wordless texts have no runs. Rows are judged each for itself, so repeated rows, null
    ids and empty tables need no care; other columns are not read. Ties of exponents are exact.
    """
    if least < LEAST:
        raise ValueError(f"runs of fewer than {LEAST} words may hold no whole block")
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = extended(
        docs.select("doc_id").schema,
        "n_words long, runs array<struct<start:long,length:long,period:long>>, "
        "strongest struct<start:long,length:long,period:long>, collapsed_text string",
    )

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = W.buffers(batch.column("text"))
        starts, ends, word_offsets = W.bounds(data, offsets)
        if order is not None:
            rows, takes = order(batch.column("doc_id"), np.diff(word_offsets))
            for row, take in zip(rows, takes):
                a, b = word_offsets[row], word_offsets[row + 1]
                starts[a:b], ends[a:b] = starts[a + take], ends[a + take]
        first, end, period = find_runs(W.hashes(data, starts, ends), word_offsets, least)
        change = np.zeros(len(starts) + 1, np.int64)
        np.add.at(change, first + period, 1)
        np.add.at(change, end, -1)
        kept = np.cumsum(change[:-1]) <= 0
        raw, at = _joined(data, starts[kept], ends[kept])
        before = np.concatenate([[0], np.cumsum(kept)])[word_offsets]
        texts = [raw[at[a] : max(at[a], at[b] - 1)].decode() for a, b in zip(before[:-1], before[1:])]
        owner = np.searchsorted(word_offsets, first, "right") - 1
        local, length = first - word_offsets[owner], end - first
        each_row = np.searchsorted(owner, np.arange(len(batch) + 1)).astype(np.int32)
        names = [f.name for f in run_type]
        runs = pa.StructArray.from_arrays([pa.array(local), pa.array(length), pa.array(period)], names)
        strongest: list[dict | None] = [None] * len(batch)
        for row in np.unique(owner).tolist():
            a, b = each_row[row], each_row[row + 1]
            own = zip(local[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist())
            best = max(own, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
            strongest[row] = dict(zip(names, best))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.diff(word_offsets), pa.int64()),
                pa.ListArray.from_arrays(pa.array(each_row), runs),
                pa.array(strongest, run_type),
                pa.array(texts, pa.string()),
            ],
            ["doc_id", "n_words", "runs", "strongest", "collapsed_text"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in W.slices(b)):
            yield each(batch)

    return docs.select("doc_id", "text").mapInArrow(W.task(run), schema)


def planted(ids: pa.Array, counts: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The periodic ends that the query's contract plants in a tenth of the documents."""
    rows, takes = [], []
    for row, (key, n) in enumerate(zip(ids.to_pylist(), counts.tolist())):
        if key is None or not n:
            continue
        h = zlib.crc32(str(key).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            i = np.arange(n)
            rows.append(row)
            takes.append(np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8))))
    return rows, takes


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document, with the contract's periodic ends, as a digest."""
    found = periodic_runs(table(spark, sf_dir, "documents"), order=planted)
    lines = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\\n'), '')")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "strongest.*",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


def brute_force_runs(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of a list of words by trying every period, for tests."""
    n, found = len(words), set()
    for q in range(1, n // PERIODS + 1):
        start = 0
        while start + q < n:
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end + q - start
            if length >= max(least, PERIODS * q):
                stretch = words[start : end + q]
                if not any(all(stretch[i] == stretch[i + p] for i in range(length - p)) for p in range(1, q)):
                    found.add((start, length, q))
            start = max(end, start + 1) if end == start else end + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_force(rows: list[tuple]) -> list[tuple]:
    """Plain-Python answer of the query for small inputs (doc_id, text), for tests."""
    out = []
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(w), zlib.crc32(str(doc).encode())
        if doc is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_force_runs(w)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
        out.append(
            (
                doc,
                len(runs),
                *best,
                1000 * best[1] // best[2] if runs else None,
                hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
                hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest(),
            )
        )
    return out
