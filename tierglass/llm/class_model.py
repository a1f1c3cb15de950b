"""Scores of texts by a class-based bigram model.

    P(word | word before) = P(class | class before) * P(word | class)

Classes come from exchange clustering in two steps. First the ``UNITS`` most frequent words, one unit for
each ending (hashed last two bytes) of all other words, and the text end move one by one to the class
that raises the likelihood of the class bigrams most, until none moves. From there every word that
occurs twice or more is moved by its own contexts: each round counts in Spark the classes before and after
each word, and moves each word against the class table of the round, neighbours held; rounds end when
the likelihood no longer rises, after ``WORD_ROUNDS`` at most. Words seen once or never have the class of
their ending. Emissions use the exact count of every word of the corpus:

    P(word | class) = (c + 0.5) / (N_class + 0.5 (V_class + 1))

with one share of 0.5 for all unseen words of a class. Transitions are mixed with the class
frequencies. Word counts and classes are Spark tables. The most frequent words (at most ``HEAD``) are
broadcast; all others are looked up by a join, so the scores do not depend on ``HEAD`` where it holds the
units.

A round sums the contexts of a word in each task before it moves them: one row for a word and a task, a
byte for every neighbour class met once and a number for the others. So no word, however frequent, has
more rows than there are tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierglass.llm import words as W
from tierglass.llm.common import cut, is_remainder, table
from tierglass.session import work_folder
from tierglass.sources import files

UNITS = 500
ENDINGS = 128
CLASSES = 32
HEAD = 1 << 21
FLUSH_WORDS = 1 << 22
SIDES = 2 * (CLASSES + 1)
PARTS = 8
CODED_WORDS = 1 << 18
ROUNDS = 12
WORD_ROUNDS = 3
END = CLASSES
BLOCK = 4096
_CLASSES = "h long, c int"
_CONTEXTS = "h long, own int, ones binary, more array<long>"
PRIOR = 2.0


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and ending of every word (A-Z lower-cased), and the n + 1 word offsets of the texts."""
    data, offsets = W.buffers(texts)
    data = W.lower(data)
    starts, ends, word_offsets = W.bounds(data, offsets)
    last = data[ends - 1].astype(np.int64)
    second = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.int64)
    return W.hashes(data, starts, ends).view(np.int64), (last * 37 + second * 101) % ENDINGS, word_offsets


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, ending, n) of every word of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, endings, size = [], [], 0
        for part in (part for b in batches for part in W.slices(b)):
            h, ending, _ = tokens(part.column("text"))
            held.append(h)
            endings.append(ending.astype(np.int16))
            size += len(h)
            if size >= FLUSH_WORDS:
                yield _counted(held, endings)
                held, endings, size = [], [], 0
        if size:
            yield _counted(held, endings)

    return docs.select("text").mapInArrow(W.task(run), "h long, ending int, n long").groupBy("h", "ending").agg(F.sum("n").alias("n"))


def _counted(held: list[np.ndarray], endings: list[np.ndarray]) -> pa.RecordBatch:
    h, first, n = np.unique(np.concatenate(held), return_index=True, return_counts=True)
    ending = np.concatenate(endings)[first].astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(ending), pa.array(n)], ["h", "ending", "n"])


def fit(docs: DataFrame) -> tuple[dict, DataFrame]:
    """Model for the driver and the workers, and the table of word counts, from rows with a text."""
    counts = cut(word_counts(docs))
    texts = docs.count()
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = _head(counts)
    units = np.lexsort((head.words, -head.n))[:UNITS]
    unit_words = np.sort(head.words[units])
    folder = work_folder(docs.sparkSession)
    coded = _coded(docs, head, folder)
    bigrams = _bigrams(coded, head, unit_words)
    start = exchange(bigrams, CLASSES)
    k = len(unit_words)
    endings = start[k : k + ENDINGS]
    classes, own, pairs = _word_classes(docs, coded, counts, head, unit_words, start, bigrams)
    known = cut(counts.join(classes, "h", "left"))
    files.delete(docs.sparkSession, folder)
    # tokens and distinct words of every class
    size, members = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    by_ending = F.when(F.col("c").isNull(), F.col("ending")).alias("ending")
    for r in known.groupBy("c", by_ending).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        c = endings[r["ending"]] if r["c"] is None else r["c"]
        size[c] += r["n"]
        members[c] += r["v"]
    size[END], members[END] = texts, int(texts > 0)
    seen = pairs.sum(0)
    share = (seen + 0.5) / (seen.sum() + 0.5 * len(seen))
    moves = (pairs + PRIOR * share) / (pairs.sum(1, keepdims=True) + PRIOR)
    return {
        "unit_words": Units(head.words, k),
        "classes": np.concatenate([start, own]).astype(np.int8),
        "endings": endings,
        # log10 of a transition to a class and of the emission's denominator there
        "step": np.log10(moves) - np.log10(size + 0.5 * (members + 1)),
        "head": head.words,
        "head_n": head.n,
        "texts": texts,
        "tokens": int(total) + texts,
        "distinct": int(distinct) + int(texts > 0),
    }, known


class Units:
    """Words whose class is broadcast, in the order of their hash, and how many units clustering began with."""

    def __init__(self, words: np.ndarray, seeds: int):
        self.words, self.seeds = words, seeds

    def __len__(self) -> int:
        return self.seeds


class Head:
    """The broadcast words by hash, with how often they come and their ending."""

    def __init__(self, words: np.ndarray, n: np.ndarray, endings: np.ndarray):
        order = np.argsort(words)
        self.words, self.n, self.endings = words[order], n[order], endings[order]
        #: Words are taken by whole levels of frequency, so a level with words seen twice holds all such.
        self.level = None if not len(n) else int(np.floor(np.log2(n.min()) * 4))
        self.whole = self.level is not None and self.level <= 4

    def of_tail(self, rows: DataFrame) -> DataFrame:
        """Rows with an ``n`` whose words are not broadcast."""
        return rows if self.level is None else rows.where(_level() < self.level)


def _collected(rows: DataFrame) -> Iterator[pa.RecordBatch]:
    """Rows of broadcast words, a part of the hashes at a time, so that the driver holds little beside them."""
    for part in range(PARTS):
        yield from rows.where(F.pmod(F.col("h"), F.lit(PARTS)) == part).toArrow().to_batches()


class Lookup:
    """Place of a hash in a sorted array, about two reads each."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.bits = max(1, len(words).bit_length())
        self.starts = np.searchsorted(self._leading(words), np.arange((1 << self.bits) + 1)).astype(np.int32)

    def _leading(self, h: np.ndarray) -> np.ndarray:
        return ((h.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places, -1 for what is not there."""
        leading = self._leading(h)
        at, end = self.starts[leading], self.starts[leading + 1]
        out = np.full(len(h), -1)
        going = np.flatnonzero(at < end)
        at, end, h = at[going], end[going], h[going]
        while len(going):
            found = self.words[at]
            hit = found == h
            out[going[hit]] = at[hit]
            more = (found < h) & (at + 1 < end)
            going, at, end, h = going[more], at[more] + 1, end[more], h[more]
        return out


_lookups: dict[tuple, Lookup] = {}


def _lookup(words: np.ndarray) -> Lookup:
    """One per worker process and set of words."""
    key = (len(words), *words[:: max(1, len(words) // 8)].tolist())
    if key not in _lookups:
        _lookups.clear()
        _lookups[key] = Lookup(words)
    return _lookups[key]


def _coded(docs: DataFrame, head: Head, folder: str) -> DataFrame:
    """Texts as numbers, written once for all rounds: the place of a broadcast word, or -1 - ending of another."""
    shared = docs.sparkSession.sparkContext.broadcast(head.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for b in batches for part in W.slices(b)):
            h, ending, word_offsets = tokens(part.column("text"))
            at = _find(shared.value, h)
            ids = np.where(at >= 0, at, -1 - ending).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(word_offsets.astype(np.int32)), pa.array(ids))], ["ids"]
            )

    docs.select("text").mapInArrow(W.task(run), "ids array<int>").write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema("ids array<int>").parquet(folder)


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of all words of some texts, and the n + 1 offsets of the texts; memory is bounded by a text."""
    for b in batches:
        ids = b.column("ids")
        offsets = ids.offsets.to_numpy().astype(np.int64)
        flat, start = ids.values.to_numpy(), 0
        while start < len(b):
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + CODED_WORDS, "right")) - 1)
            yield flat[offsets[start] : offsets[end]].astype(np.int64), offsets[start : end + 1] - offsets[start]
            start = end


def _find(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of hashes among broadcast words, -1 for others."""
    return _lookup(words).find(h) if len(words) else np.full(len(h), -1)


def _word_classes(
    docs: DataFrame, coded: DataFrame, counts: DataFrame, head: Head, unit_words: np.ndarray, start: np.ndarray, bigrams: np.ndarray
) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(h, c) of the words that repeat, the class of each word of ``head``, and the class bigrams."""
    k = len(unit_words)
    endings = start[k : k + ENDINGS]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, ending = (b.column(c).to_numpy().astype(np.int64) for c in ("h", "ending"))
            yield pa.RecordBatch.from_arrays(
                [b.column("h"), pa.array(start[_units(unit_words, h, ending)], pa.int32())], ["h", "c"]
            )

    def of_head(classes: DataFrame) -> np.ndarray:
        """Classes of the broadcast words."""
        own = np.zeros(len(head.words), np.int8)
        find = Lookup(head.words).find
        for b in _collected(classes if head.whole else _of_head(classes, counts, head)):
            own[find(b.column("h").to_numpy())] = b.column("c").to_numpy()
        return own

    classes = counts.where("n > 1").select("h", "ending").mapInArrow(W.task(first), _CLASSES)
    pairs = np.zeros((CLASSES + 1, CLASSES + 1))
    np.add.at(pairs, (start[:, None], start[None, :]), bigrams)
    own = start[_units(unit_words, head.words, head.endings.astype(np.int64))].astype(np.int8)
    round_ = _Round(docs, coded, head, own, endings, classes, counts)
    for _ in range(WORD_ROUNDS if len(head.words) else 0):
        moved = cut(round_.contexts().repartition("h").sortWithinPartitions("h").mapInArrow(W.task(_moves(pairs)), _CLASSES))
        own_moved = of_head(moved)
        after_round = _Round(docs, coded, head, own_moved, endings, moved, counts)
        after = after_round.pairs()
        after[END, END] = pairs[END, END]
        if _likelihood(after) <= _likelihood(pairs):
            break
        classes, own, pairs, round_ = moved, own_moved, after, after_round
    return classes, own, pairs


def _of_head(classes: DataFrame, counts: DataFrame, head: Head) -> DataFrame:
    """The classes of broadcast words, as few as these."""
    words = counts.where(_level() >= head.level).select("h")
    return classes.join(words, "h", "left_semi")


def _level():
    return F.floor(F.log2("n") * 4)


class _Round:
    """What the texts hold under one assignment of classes."""

    def __init__(
        self, docs: DataFrame, coded: DataFrame, head: Head, own: np.ndarray, endings: np.ndarray, classes: DataFrame, counts: DataFrame
    ):
        self.coded, self.head, self.endings, self.far = coded, head, endings, None
        context = docs.sparkSession.sparkContext
        self.words, self.own = context.broadcast(head.words), context.broadcast(own)
        if not head.whole:
            # Words that are not broadcast, and so the pairs with one, are few; they are joined with their classes.
            tail = head.of_tail(counts.where("n > 1")).select("h").join(classes, "h")
            self.far = cut(_unknown_pairs(docs.select("text"), self.words, self.own, tail, endings))

    def _classes(self):
        """Function from numbers of texts to number and class of each word, the text end behind, and its pairs."""
        shared, endings, whole = self.own, self.endings, self.head.whole

        def read(ids: np.ndarray, word_offsets: np.ndarray):
            own = shared.value
            c = np.full(len(ids) + 1, END)
            known = own[np.maximum(ids, 0)] if len(own) else -1
            c[:-1] = np.where(ids >= 0, known, endings[np.maximum(-1 - ids, 0)] if whole else -1)
            before, after = _sequence(np.arange(len(ids)), word_offsets, len(ids))
            return np.append(ids, -1), c, before, after

        return read

    def contexts(self) -> DataFrame:
        """Rows (h, own, ones, more) of repeated words, one for each word and task, or few.

        ``ones`` has a byte for each class that stands once before the word, or (plus ``END`` + 1) once
        after it; ``more`` has these for all other classes in the low seven bits, and how often above.
        """
        read, words_of, own_of = self._classes(), self.words, self.own

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, own = words_of.value, own_of.value
            held, size = [], 0
            for ids, word_offsets in _numbers(batches):
                at, c, before, after = read(ids, word_offsets)
                for word, other, shift in ((after, before, 0), (before, after, END + 1)):
                    place, k = at[word], c[other]
                    use = (place >= 0) & (k >= 0)
                    held.append((place[use] * SIDES + k[use] + shift).astype(np.int32))
                    size += len(held[-1])
                if size >= FLUSH_WORDS:
                    yield _packed(words, own, held)
                    held, size = [], 0
            if size:
                yield _packed(words, own, held)

        rows = self.coded.mapInArrow(W.task(near), _CONTEXTS)
        if self.far is None:
            return rows
        sides = F.array(
            F.struct(F.col("a").alias("h"), F.col("a_c").alias("own"), F.col("a_moves").alias("moves"), F.col("b_c").alias("k")),
            F.struct(F.col("b").alias("h"), F.col("b_c").alias("own"), F.col("b_moves").alias("moves"), (F.col("a_c") + END + 1).alias("k")),
        )
        code = F.shiftleft(F.col("n"), 7).bitwiseOR(F.col("k").cast("long"))
        more = (
            self.far.select(F.explode(sides).alias("s"), "n")
            .select("s.*", "n")
            .where("moves")
            .groupBy("h", "own", "k")
            .agg(F.sum("n").alias("n"))
            .groupBy("h", "own")
            .agg(F.collect_list(code).alias("more"))
        )
        return rows.unionByName(more.select("h", F.col("own").cast("int").alias("own"), F.lit(b"").alias("ones"), "more"))

    def pairs(self) -> np.ndarray:
        """How often each class follows each; the pair of two ends is left out."""
        read, size = self._classes(), END + 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size * size, np.int64)
            for ids, word_offsets in _numbers(batches):
                _, c, before, after = read(ids, word_offsets)
                b, a = c[before], c[after]
                known = (b >= 0) & (a >= 0)
                total += np.bincount(b[known] * size + a[known], minlength=size * size)
            pair = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int32()), pa.array(total[pair])], ["pair", "n"])

        rows = self.coded.mapInArrow(W.task(run), "pair int, n long")
        if self.far is not None:
            rows = rows.unionByName(self.far.select((F.col("b_c") * size + F.col("a_c")).cast("int").alias("pair"), "n"))
        out = np.zeros(size * size)
        for r in rows.groupBy("pair").agg(F.sum("n").alias("n")).collect():
            out[r["pair"]] = r["n"]
        return out.reshape(size, size)


def _packed(words: np.ndarray, own: np.ndarray, held: list[np.ndarray]) -> pa.RecordBatch:
    """Counted contexts, a row for each word."""
    keys = np.concatenate(held)
    keys.sort()
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    n, keys = np.diff(np.append(new, len(keys))), keys[new]
    place, k = keys // SIDES, keys % SIDES
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    one = n == 1
    starts = np.append(first, len(keys))
    ones_at = np.concatenate([[0], np.cumsum(one)])[starts].astype(np.int32)
    more_at = np.concatenate([[0], np.cumsum(~one)])[starts].astype(np.int32)
    ones = k[one].astype(np.uint8).tobytes()
    code = n[~one].astype(np.int64) << 7 | k[~one]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(words[place[first]]),
            pa.array(own[place[first]].astype(np.int32)),
            pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ones_at), pa.py_buffer(ones)]),
            pa.ListArray.from_arrays(pa.array(more_at), pa.array(code)),
        ],
        ["h", "own", "ones", "more"],
    )


def _unknown_pairs(texts: DataFrame, words_of, own_of, tail: DataFrame, endings: np.ndarray) -> DataFrame:
    """Pairs of neighbours with a word that is not broadcast: hash, class, and whether the word moves; how often."""

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own = words_of.value, own_of.value
        for part in (part for b in batches for part in W.slices(b)):
            h, ending, word_offsets = tokens(part.column("text"))
            n = len(h)
            at = np.append(_find(words, h), -1)
            c = np.where(at >= 0, own[np.maximum(at, 0)] if len(words) else -1, -1)
            c[n] = END
            before, after = _sequence(np.arange(n), word_offsets, n)
            use = (c[before] < 0) | (c[after] < 0)
            before, after = before[use], after[use]
            h, ending = np.append(h, 0), np.append(ending, 0)
            first, times = _distinct((h[before], before == n, h[after], after == n))
            before, after = before[first], after[first]
            # A known side is spread over all keys, so that no frequent word is one in the join.
            spread = W.mix(h[before].view(np.uint64) + W.mix(h[after].view(np.uint64))).view(np.int64)
            columns = []
            for side in (before, after):
                known = c[side] >= 0
                columns += [
                    pa.array(h[side]),
                    pa.array(np.where(known, spread, h[side])),
                    pa.array(c[side], pa.int32(), mask=~known),
                    pa.array(endings[ending[side]], pa.int32()),
                    pa.array(at[side] >= 0),
                ]
            names = [f"{s}{x}" for s in "ba" for x in ("", "_key", "_known", "_ending", "_head")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(times, pa.int64())], [*names, "n"])

    schema = ", ".join(
        f"{s} long, {s}_key long, {s}_known int, {s}_ending int, {s}_head boolean" for s in ("b", "a")
    )
    rows = texts.mapInArrow(W.task(far), f"{schema}, n long")
    for s in ("b", "a"):
        rows = rows.join(tail.select(F.col("h").alias(f"{s}_key"), F.col("c").alias(f"{s}_found")), f"{s}_key", "left")
    unknown = {s: F.col(f"{s}_known").isNull() for s in ("b", "a")}
    return rows.select(
        *[F.col(s) for s in ("b", "a")],
        *[F.coalesce(f"{s}_known", f"{s}_found", f"{s}_ending").alias(f"{s}_c") for s in ("b", "a")],
        *[(F.col(f"{s}_head") | (unknown[s] & F.col(f"{s}_found").isNotNull())).alias(f"{s}_moves") for s in ("b", "a")],
        "n",
    )


def _distinct(columns: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first of each distinct row, and how many there are of it."""
    mixed = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        mixed = W.mix(mixed * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.int64).view(np.uint64))
    _, first, n = np.unique(mixed, return_index=True, return_counts=True)
    return first, n


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Contexts of whole words from rows ordered by word: hash, own class, and (row, k, n) of what is there."""
    held: list[pa.RecordBatch] = []
    size = 0

    def block(table: pa.Table):
        table = table.combine_chunks()
        h = table.column("h").to_numpy()
        word = np.cumsum(np.append(False, h[1:] != h[:-1]))
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        ones, more = (table.column(c).chunk(0) for c in ("ones", "more"))
        ends = np.frombuffer(ones.buffers()[1], np.int32)[ones.offset : ones.offset + len(ones) + 1]
        data = np.frombuffer(ones.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        code = more.flatten().to_numpy()
        total = np.zeros((int(word[-1]) + 1) * SIDES, np.int64)
        total += np.bincount(np.repeat(word, np.diff(ends)) * SIDES + data, minlength=len(total))
        np.add.at(total, np.repeat(word, np.diff(more.offsets.to_numpy())) * SIDES + (code & 127), code >> 7)
        row, k = np.nonzero(total.reshape(-1, SIDES))
        return h[first], table.column("own").to_numpy()[first].astype(np.int64), row, k, total[row * SIDES + k]

    for b in batches:
        if not len(b):
            continue
        held.append(b)
        size += len(b)
        if size < BLOCK:
            continue
        table = pa.Table.from_batches(held)
        h = table.column("h").to_numpy()
        last = int(np.searchsorted(h, h[-1]))
        if last:
            yield block(table.slice(0, last))
        held, size = table.slice(last).combine_chunks().to_batches(), len(h) - last
    if held:
        yield block(pa.Table.from_batches(held))


def _moves(pairs: np.ndarray):
    """Task that gives each repeated word the class of largest gain, all others held; ties keep the word's."""
    size = END + 1

    def info(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-300))

    table = np.concatenate([pairs[:, :END], pairs.T[:, :END]])  # by k, then the word's class
    margins = np.stack([pairs.sum(0)[:END], pairs.sum(1)[:END]])
    table_info, margins_info = info(table), info(margins)

    def best(own: np.ndarray, row: np.ndarray, k: np.ndarray, n: np.ndarray) -> np.ndarray:
        step = info(table[k] + n[:, None]) - table_info[k]
        c, at = own[row], np.arange(len(row))
        step[at, c] = table_info[k, c] - info(np.maximum(table[k, c] - n, 0))
        gain = np.zeros((len(own), END))
        begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        gain[row[begin]] = np.add.reduceat(step, begin, axis=0)
        at = np.arange(len(own))
        for side in (0, 1):
            total = np.bincount(row, n * (k // size == side), len(own))[:, None]
            moved = info(margins[side] + total) - margins_info[side]
            moved[at, own] = margins_info[side, own] - info(np.maximum(margins[side, own] - total[:, 0], 0))
            gain -= moved
        found = gain.argmax(1)
        return np.where(gain[at, found] > gain[at, own] + 1e-6, found, own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, own, row, k, n in _summed(batches):
            for a in range(0, len(h), BLOCK):
                b = min(len(h), a + BLOCK)
                lo, hi = np.searchsorted(row, [a, b])
                c = best(own[a:b], row[lo:hi] - a, k[lo:hi], n[lo:hi].astype(np.float64))
                yield pa.RecordBatch.from_arrays([pa.array(h[a:b]), pa.array(c, pa.int32())], ["h", "c"])

    return run


def _likelihood(pairs: np.ndarray) -> float:
    """Of the class bigrams, less what does not depend on classes."""

    def info(x: np.ndarray) -> float:
        return float((x * np.log(np.maximum(x, 1e-300))).sum())

    return info(pairs) - info(pairs.sum(0)) - info(pairs.sum(1))


def _head(counts: DataFrame) -> Head:
    """The most frequent words that repeat, as many whole levels of frequency as HEAD holds."""
    repeated = counts.where("n > 1")
    chosen, room = None, HEAD
    for r in repeated.groupBy(_level().cast("int").alias("level")).count().orderBy(F.desc("level")).collect():
        room -= r["count"]
        if room < 0:
            break
        chosen = r["level"]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8))]
    if chosen is not None:
        for b in _collected(repeated.where(_level() >= chosen).select("h", "n", "ending")):
            h, n, ending = (b.column(c).to_numpy() for c in ("h", "n", "ending"))
            found.append((h, n, ending.astype(np.uint8)))
    return Head(*(np.concatenate(x) for x in zip(*found)))


def _units(unit_words: np.ndarray | Units, h: np.ndarray, ending: np.ndarray) -> np.ndarray:
    """Unit number of each word."""
    if isinstance(unit_words, Units):
        at = np.minimum(np.searchsorted(unit_words.words, h), max(len(unit_words.words) - 1, 0))
        found = unit_words.words[at] == h if len(unit_words.words) else np.zeros(len(h), bool)
        return np.where(found, unit_words.seeds + ENDINGS + 1 + at, unit_words.seeds + ending)
    if not len(unit_words):
        return ending
    at = np.minimum(np.searchsorted(unit_words, h), len(unit_words) - 1)
    return np.where(unit_words[at] == h, at, len(unit_words) + ending)


def _sequence(units: np.ndarray, word_offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Units before and after each token of all texts; the text end stands on both sides."""
    n = len(word_offsets) - 1
    after = np.full(len(units) + n, end, np.int64)
    word = np.ones(len(after), bool)
    word[word_offsets[1:] + np.arange(n)] = False
    after[word] = units
    before = np.empty_like(after)
    before[1:] = after[:-1]
    before[:1] = end
    return before, after


def _bigrams(coded: DataFrame, head: Head, unit_words: np.ndarray) -> np.ndarray:
    """How often each unit follows each; a dense matrix of fixed size."""
    k = len(unit_words)
    n = k + ENDINGS + 1
    units = _units(unit_words, head.words, head.endings.astype(np.int64)).astype(np.int16)
    shared = coded.sparkSession.sparkContext.broadcast(units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, np.int64)
        for ids, word_offsets in _numbers(batches):
            own = shared.value[np.maximum(ids, 0)] if k else 0
            before, after = _sequence(np.where(ids >= 0, own, k - 1 - ids), word_offsets, n - 1)
            total += np.bincount(before * n + after, minlength=n * n)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int32()), pa.array(total[pair])], ["pair", "n"])

    found = coded.mapInArrow(W.task(run), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n * n)
    out[found["pair"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    return out.reshape(n, n)


def exchange(bigrams: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Class of every unit; the last unit has class ``classes`` for itself.

    Starts from units dealt out by frequency. A unit is taken out of its class and put where the sum
    of N ln N over class bigrams, less that of both margins, is largest; ties keep the lower class.
    """

    def info(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-300))

    n = len(bigrams)
    order = np.argsort(-(bigrams.sum(0) + bigrams.sum(1))[:-1], kind="stable")
    of = np.full(n, classes)
    of[order] = np.arange(n - 1) % classes
    one_hot = np.eye(classes + 1)[of]
    m = one_hot.T @ bigrams @ one_hot
    for _ in range(rounds):
        moved = 0
        for w in order.tolist():
            right = np.bincount(of, bigrams[w], classes + 1)
            left = np.bincount(of, bigrams[:, w], classes + 1)
            if not right.any() and not left.any():
                continue
            loop, c = bigrams[w, w], of[w]
            right[c] -= loop
            left[c] -= loop
            m[c] -= right
            m[:, c] -= left
            m[c, c] -= loop
            rows, columns = info(m + right) - info(m), info(m + left[:, None]) - info(m)
            gain = rows.sum(1) - np.diag(rows) + columns.sum(0) - np.diag(columns)
            gain += info(np.diag(m) + right + left + loop) - info(np.diag(m))
            for margin, own in ((m.sum(1), right.sum() + loop), (m.sum(0), left.sum() + loop)):
                gain -= info(margin + own) - info(margin)
            best = int(np.argmax(gain[:classes]))
            if gain[best] <= gain[c] + 1e-9:
                best = c
            moved += best != c
            of[w] = best
            m[best] += right
            m[:, best] += left
            m[best, best] += loop
        if not moved:
            break
    return of


def score(docs: DataFrame, model: dict, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row of ``docs``.

    A null or empty text is one end token. Repeated rows get a row each with equal values. A model of
    no texts gives every token the base score 0 and spreads its score over the classes. Logarithms
    have base 10.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for b in batches for part in W.slices(b)):
            yield _scored(shared.value, part)

    # Texts are read once: what broadcast words give is summed there, and the pairs with another word,
    # each distinct pair of a text once, are set aside to meet the counts and classes.
    scanned = cut(
        docs.select("doc_id", "text")
        .mapInArrow(
            W.task(run),
            "doc_id long, n_tokens long, head_known long, head_sum double, steps double, "
            "pairs array<struct<b:long,b_ending:int,b_known:int,a:long,a_ending:int,a_known:int,times:int>>",
        )
        .withColumn("_row", F.monotonically_increasing_id())
    )
    by_ending = F.lit([int(c) for c in model["endings"]])
    steps = F.lit([float(x) for x in model["step"].ravel()])
    first, second = (counts.select(F.col("h").alias(k), F.col("n").alias(f"{k}_n"), F.col("c").alias(f"{k}_c")) for k in ("b", "a"))
    before, after = (
        F.coalesce(f"{k}_known", f"{k}_c", F.element_at(by_ending, F.col(f"{k}_ending") + 1)) for k in ("b", "a")
    )
    found = F.col("a_known").isNull() & (F.col("a_n") > 0)
    tail = (
        scanned.select("_row", F.inline("pairs"))
        .join(first, "b", "left")
        .join(second, "a", "left")
        .groupBy("_row")
        .agg(
            F.sum(F.when(found, F.col("times") * F.log10(F.col("a_n") + 0.5)).otherwise(0.0)).alias("tail_sum"),
            F.sum(F.when(found, F.col("times")).otherwise(0)).alias("tail_known"),
            F.sum(F.col("times") * F.element_at(steps, before * (END + 1) + after + 1)).alias("tail_steps"),
        )
    )
    both = scanned.drop("pairs").join(tail, "_row", "left")
    known = F.col("head_known") + F.coalesce("tail_known", F.lit(0))
    # Unseen words all have one emission, so they are a product and not a sum that rounds.
    unseen = F.col("n_tokens") - known - int(not model["texts"])
    emitted, least = F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0)), float(np.log10(0.5))
    base = float(np.log10(model["tokens"] + 0.5 * (model["distinct"] + 1)))
    return both.select(
        "doc_id",
        "n_tokens",
        known.alias("n_known"),
        F.lit(model["tokens"]).cast("long").alias("train_tokens"),
        (emitted - (F.col("n_tokens") - unseen) * base + unseen * (least - base)).alias("base_score"),
        (emitted + unseen * least + F.col("steps") + F.coalesce("tail_steps", F.lit(0.0))).alias("score"),
    )


def _in_head(model: dict, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether words at these places of the broadcast ones are there, and their counts."""
    if not len(model["head"]):
        return np.zeros(len(at), bool), np.zeros(len(at), np.int64)
    return at >= 0, model["head_n"][np.maximum(at, 0)]


def _scored(model: dict, part: pa.RecordBatch) -> pa.RecordBatch:
    """What broadcast words give of each text, and its pairs with another word."""
    h, ending, word_offsets = tokens(part.column("text"))
    n_texts, n = len(part), len(h)
    at, c = _model_classes(model, h)
    c = np.append(c, END)
    before, after = _sequence(np.arange(n), word_offsets, n)
    text = np.repeat(np.arange(n_texts), np.diff(word_offsets) + 1)
    unknown = (c[before] < 0) | (c[after] < 0)
    step = np.where(unknown, 0, model["step"][c[before], c[after]])
    found, count = _in_head(model, at)
    words = np.repeat(np.arange(n_texts), np.diff(word_offsets))
    emitted = np.bincount(words, np.where(found, np.log10(count + 0.5), 0), n_texts)
    known = np.bincount(words, found, n_texts).astype(np.int64) + int(model["texts"] > 0)
    steps = np.bincount(text, step, n_texts)

    before, after, text = before[unknown], after[unknown], text[unknown]
    h, ending = np.append(h, 0), np.append(ending, 0)
    first, times = _distinct((h[before], before == n, h[after], after == n, text))
    order = np.argsort(text[first], kind="stable")
    first, times = first[order], times[order]
    before, after, text = before[first], after[first], text[first]
    # the key of a word that is broadcast is spread over all values, so that it is not a hot one
    other = W.mix(h[before].view(np.uint64) + W.mix(h[after].view(np.uint64)) + text.view(np.uint64)).view(np.int64)
    columns = []
    for word in (before, after):
        own = c[word] >= 0
        columns += [
            pa.array(np.where(own, other, h[word])),
            pa.array(ending[word], pa.int32()),
            pa.array(c[word], pa.int32(), mask=~own),
        ]
    names = ["b", "b_ending", "b_known", "a", "a_ending", "a_known", "times"]
    pairs = pa.StructArray.from_arrays([*columns, pa.array(times, pa.int32())], names)
    each = np.searchsorted(text, np.arange(n_texts + 1)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            part.column("doc_id"),
            pa.array(np.diff(word_offsets) + 1, pa.int64()),
            pa.array(known),
            pa.array(emitted + np.log10(model["texts"] + 0.5)),
            pa.array(steps),
            pa.ListArray.from_arrays(pa.array(each), pairs),
        ],
        ["doc_id", "n_tokens", "head_known", "head_sum", "steps", "pairs"],
    )


def _model_classes(model: dict, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each word among the broadcast ones and its class; -1 for those that are not."""
    if not len(model["head"]):
        return np.full(len(h), -1), np.full(len(h), -1)
    at = _find(model["head"], h)
    own = model["classes"][len(model["unit_words"]) + ENDINGS + 1 :]
    return at, np.where(at >= 0, own[np.maximum(at, 0)], -1)


def op6_class_model(spark, sf_dir: str) -> DataFrame:
    """Token counts, unigram and class-model score of every document; every fifth one is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = is_remainder(F.col("doc_id"), 5, 1)
    model, counts = fit(docs.where(~held_out))
    return score(docs, model, counts).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
