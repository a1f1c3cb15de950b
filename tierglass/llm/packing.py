"""Packing of tokenised documents into fixed-length sequences.

Method: best fit decreasing, then a swap-based local search. It takes the emptiest underfull bin and
moves its pieces elsewhere: a plain move, one piece for a smaller one, or two pieces for one. Every
step fills a fuller bin further, so the sum of squared fills grows, until bins empty.

Pieces are dealt over shards of about ``shard_pieces`` pieces, packed in parallel; what stays in
clearly underfull bins is dealt anew and packed together in further rounds, so that a shard costs no
sequence. Only piece lengths are shuffled, never tokens.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierglass.llm import words as W
from tierglass.llm.common import cut, table

CAPACITY = 2048
END = 0
SHARD_PIECES = 20_000
CACHE = 500_000
KEPT = 200_000
JOINED = 512
UNDERFULL = 0.98


class Effort(NamedTuple):
    """How far the local search of a shard looks. No piece is left out: what it bounds is the trying.

    Of an emptying bin the ``pieces`` largest are tried for moves and exchanges, and pairs of the
    ``paired`` largest; after ``stuck`` bins that could not be emptied the search of the shard ends.
    """

    pieces: int = 64
    paired: int = 16
    stuck: int = 64


#: White space beyond ASCII; texts with any are encoded whole.
_WIDE_SPACE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class Encoder:
    """Token ids of many texts, every distinct chunk of white space or word encoded once.

    The tokenizer splits texts before it merges, and always does so before a word together with one
    blank in front of it; chunks cut there have the ids that they have in the text.
    """

    def __init__(self, path: str):
        # One task is one core; threads of the library would only hold memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.after_blank = np.zeros(max(vocabulary.values()) + 1, bool)
        self.after_blank[[i for token, i in vocabulary.items() if token[0] == "\u0120"]] = True
        self.line_break = vocabulary["\u010a"]
        self.cache = W.ChunkCache(CACHE)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in made]

    def _learn(self, chunks: list[str]) -> W.Learned:
        """Ids of chunks, many in one text: ids tell where each begins, by its blank or a line break."""
        starts, sizes = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        found, used = [], 0
        kinds: dict[str, list[int]] = {" ": [], "\n": [], "": []}
        for i, chunk in enumerate(chunks):
            kinds["" if chunk.isspace() else " " if chunk[0] == " " else "\n"].append(i)
        alone = kinds[""]
        for mark in (" ", "\n"):
            glue = int(mark == "\n")
            groups = [kinds[mark][i : i + JOINED] for i in range(0, len(kinds[mark]), JOINED)]
            for group, ids in zip(groups, self._ids([glue * mark + (glue * mark).join([chunks[i] for i in g]) for g in groups])):
                begins = np.flatnonzero(ids == self.line_break if glue else self.after_blank[ids])
                if len(begins) != len(group):  # unusual white space hides a border
                    alone = alone + group
                    continue
                starts[group] = used + begins + glue
                sizes[group] = np.diff(np.append(begins, len(ids))) - glue
                found.append(ids)
                used += len(ids)
        for i, ids in zip(alone, self._ids([chunks[i] for i in alone])):
            starts[i], sizes[i] = used, len(ids)
            found.append(ids)
            used += len(ids)
        return np.concatenate(found), starts, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the n + 1 offsets of the texts; a null is empty."""
        data, offsets = W.buffers(texts)
        starts, ends, _ = W.bounds(data, offsets)
        cuts = np.zeros(len(data) + 1, bool)
        cuts[offsets] = True
        cuts[ends] = True
        cuts[starts] = True
        after = np.zeros(len(data) + 1, bool)  # words that follow a white space of their own text
        after[starts] = True
        after[offsets] = False
        after = np.flatnonzero(after)
        cuts[after - 1] = True
        cuts[after[data[after - 1] == 32]] = False
        cuts[offsets] = True
        first = np.flatnonzero(cuts[:-1])
        last = np.append(first[1:], len(data))
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        raw = data.tobytes()

        def learn(new: np.ndarray) -> W.Learned:
            return self._learn([raw[a:b].decode("utf-8") for a, b in zip(first[new].tolist(), last[new].tolist())])

        ids, out = self.cache.ids(W.hashes(data, first, last), learn)
        return self._whole(texts, ids, out[np.searchsorted(first, offsets)])

    def _whole(self, texts: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode texts with unusual white space in one piece."""
        import pyarrow.compute as pc

        odd = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, _WIDE_SPACE), False).to_numpy(False))
        if not len(odd):
            return ids, offsets
        parts = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        for i in odd.tolist():
            parts[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of every row of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, n_pieces.

    A document is its ids and one end id, so a null or empty text is one piece of length 1. Documents
    longer than ``capacity`` are cut into full pieces after a first one with the rest.
    ``with_ids`` adds the ids themselves.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, n_pieces int, text_hash long"
    schema += ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or vocabulary_path()).encode
        for batch in (part for b in batches for part in W.slices(b)):
            ids, offsets = encode(batch.column("text"))
            text, piece, start, length, crcs, cut_ids = [], [], [], [], [], []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                own = np.append(ids[a:b], np.uint32(END)).astype("<u4")
                at, k = 0, 0
                while at < len(own):
                    size = (len(own) - at - 1) % capacity + 1
                    part = own[at : at + size]
                    text.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crcs.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        cut_ids.append(part.astype(np.int32))
                    at, k = at + size, k + 1
            text = np.array(text, np.int64)
            data, bounds = W.buffers(batch.column("text"))
            whole = W.hashes(data, bounds[:-1], bounds[1:]).view(np.int64)
            columns = [
                batch.column("doc_id").take(pa.array(text)),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crcs, pa.int64()),
                pa.array(np.bincount(text, minlength=len(batch))[text], pa.int32()),
                pa.array(whole[text]),
            ]
            columns += [pa.array(cut_ids, pa.list_(pa.int32()))] * with_ids
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "n_pieces", "text_hash", "ids"]
            yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    return docs.select("doc_id", "text").mapInArrow(W.task(run, lambda: encoder(path or vocabulary_path()).cache.prune(KEPT)), schema)


def pack_sizes(sizes: np.ndarray, capacity: int = CAPACITY, effort: Effort = Effort()) -> np.ndarray:
    """The bin of each size, bins numbered from 0 without gaps."""
    fit = _best_fit(sizes, capacity)
    _search(sizes, fit, capacity, effort)
    return np.unique(fit, return_inverse=True)[1]


def _best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Best fit, large sizes first. Bit r of ``open_`` is set while a bin has exactly r places left."""
    bins = np.zeros(len(sizes), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, count = 0, 0
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = open_ >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                open_ ^= 1 << room
        else:
            room, b, count = capacity, count, count + 1
        bins[i] = b
        if room > size:
            stacks[room - size].append(b)
            open_ |= 1 << (room - size)
    return bins


def _search(sizes: np.ndarray, bins: np.ndarray, capacity: int, effort: Effort) -> None:
    """Empty bins in place, the emptiest first, while no fewer bins are possible."""
    fill = np.bincount(bins, weights=sizes).astype(np.int64) if len(bins) else np.zeros(0, np.int64)
    least = -(-int(sizes.sum()) // capacity)
    stuck: set[int] = set()
    while (fill > 0).sum() > least:
        under = [b for b in np.argsort(fill, kind="stable").tolist() if 0 < fill[b] < capacity and b not in stuck]
        if len(under) < 2:
            break
        source = under[0]
        while fill[source] and _step(sizes, bins, fill, source, capacity, effort):
            pass
        if fill[source]:
            stuck.add(source)
        if len(stuck) > effort.stuck:
            break


def _step(
    sizes: np.ndarray, bins: np.ndarray, fill: np.ndarray, source: int, capacity: int, effort: Effort
) -> bool:
    """One exchange that takes most from ``source``; False if none takes anything.

    Targets are underfull bins at least as full as the source, so squared fill grows.
    """
    own = np.flatnonzero(bins == source)
    room = capacity - fill
    others = np.flatnonzero((room[bins] > 0) & (fill[bins] >= fill[source]) & (bins != source))
    if not len(others):
        return False
    own = own[np.argsort(-sizes[own], kind="stable")][: effort.pieces]
    # A move: the largest piece that fits anywhere, into the tightest bin.
    targets = np.flatnonzero((room > 0) & (fill >= fill[source]))
    targets = targets[targets != source]
    for i in own.tolist():
        fitting = targets[room[targets] >= sizes[i]]
        if len(fitting):
            _move(sizes, bins, fill, i, int(fitting[np.argmin(room[fitting])]))
            return True
    best, chosen = 0, None
    spare = room[bins[others]]
    paired = own[: effort.paired].tolist()
    sets = [(i,) for i in own.tolist()] + [(i, j) for a, i in enumerate(paired) for j in paired[a + 1 :]]
    for leaving in sets:
        gain = int(sizes[list(leaving)].sum()) - sizes[others]
        gain = np.where((gain > 0) & (gain <= spare), gain, 0)
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, chosen = int(gain[k]), (leaving, int(others[k]))
    if chosen is None:
        return False
    leaving, back = chosen
    target = int(bins[back])
    for i in leaving:
        _move(sizes, bins, fill, i, target)
    _move(sizes, bins, fill, back, source)
    return True


def _move(sizes: np.ndarray, bins: np.ndarray, fill: np.ndarray, piece: int, target: int) -> None:
    fill[bins[piece]] -= sizes[piece]
    fill[target] += sizes[piece]
    bins[piece] = target


def _shard_packer(keys: list[str], capacity: int, level: int, last: bool, effort: Effort):
    def run(shard: pa.Table) -> pa.Table:
        sizes = shard.column("length").to_numpy()
        bins = pack_sizes(sizes, capacity, effort)
        order = np.argsort(bins, kind="stable")
        bins, sizes = bins[order], sizes[order]
        ends = np.cumsum(sizes)
        fill = np.bincount(bins, weights=sizes).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(fill)])[bins]
        number = (level << 56) + (shard.column("shard")[0].as_py() << 28)
        out = shard.select(keys).take(pa.array(order))
        out = out.append_column("sequence_id", pa.array(number + bins, pa.int64()))
        out = out.append_column("offset", pa.array(ends - sizes - before, pa.int64()))
        return out.append_column("full", pa.array((fill[bins] >= UNDERFULL * capacity) | last, pa.bool_()))

    return run


def pack(
    rows: DataFrame,
    capacity: int = CAPACITY,
    shard_pieces: int = SHARD_PIECES,
    rounds: int = 3,
    effort: Effort = Effort(),
) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of at most ``capacity``.

    Sequences are gapless from 0. Repeated rows are packed one by one. An empty table gives none.
    """
    keys = rows.columns
    schema = rows.select(*keys).schema.add("sequence_id", "long").add("offset", "long").add("full", "boolean")
    done, todo = None, rows
    for level in range(rounds):
        todo = cut(todo)
        count = todo.count()
        shards = max(1, -(-count // shard_pieces))
        last = level == rounds - 1 or shards == 1

        shard = F.pmod(F.xxhash64(*keys, F.lit(level)), F.lit(shards))
        packed = todo.withColumn("shard", shard).groupBy("shard").applyInArrow(
            _shard_packer(keys, capacity, level, last, effort), schema
        )
        if not last:
            packed = cut(packed)
            todo = packed.where("not full").select(*keys)
        kept = packed.where("full").drop("full")
        done = kept if done is None else done.unionAll(kept)
        if last:
            break
    return done


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Place of every piece of every document."""
    packed = pack(pieces(table(spark, sf_dir, "documents")))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "n_pieces")
