"""SentencePiece BPE encoding with seeded merge-dropout, and its decoding.

Encoding works on the pieces of a public model, never a trained one. Text is cut into chunks that no
piece spans (a run of blanks with the word after it; a byte that only occurs alone). In a chunk an agenda
of candidate merges is worked off by score, then by place. With dropout, a candidate that comes up is
skipped for good if a keyed hash of (seed, document, place of the chunk, place in the chunk, merged piece)
falls below the rate. So every candidate of every occurrence draws for itself, and all is repeatable on
any partitioning. A rate of 0 gives the model's own segmentation.

The plain agenda of a chunk is kept: an occurrence none of whose candidates there is drawn has its ids.
The agendas of all other occurrences of a slice run in step, one candidate of each at a time; only
chunks of more than ``STEP_CHARS`` characters, or with a literal mark of a blank, have one of their own.

Decoding joins pieces and bytes and takes off the blank that encoding puts in front, so every text
comes back. A literal U+2581 in a text is encoded as bytes, as the pieces use it for a blank.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tierglass.llm import words as W
from tierglass.llm.common import table

RATE = 0.1
SEED = 7
CACHE = 300_000
KEPT = 50_000
BLANK = "▁"
#: Longest chunk whose agenda runs in step with others; six bits of a candidate hold the place.
STEP_CHARS = 64
#: Chunks whose agendas run in step at a time; bounds memory only.
STEP_ROWS = 1 << 15
_NEVER = np.int32(2**31 - 1)


class Pairs:
    """Merged piece of a pair of symbols, for many pairs at once.

    Symbols are numbers of pieces by rank, then of characters that only occur inside pieces. The table
    is an array of slots; a pair stands in its own slot or in the next free one.
    """

    def __init__(self, ranks: dict[str, int]):
        self.symbols = dict(ranks)
        for piece in ranks:
            for c in piece:
                self.symbols.setdefault(c, len(self.symbols))
        self.size = len(self.symbols)
        known = self.symbols.get
        pairs = {}
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                left, right = known(piece[:i]), known(piece[i:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.bits = max(4, (8 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, -1, np.int32)
        left = np.fromiter(pairs, np.int64, len(pairs))
        rank = np.fromiter(pairs.values(), np.int32, len(pairs))
        slot = self._slots(left)
        while len(left):
            free = self.keys[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.ranks[slot[put]] = left[put], rank[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, rank, slot = left[rest], rank[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slots(self, key: np.ndarray) -> np.ndarray:
        h = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each merged piece, -1 where there is none."""
        key = left.astype(np.int64) * self.size + right
        key[(left >= self.size) | (right >= self.size)] = -2
        slot = self._slots(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], np.int32(-1))
        going = np.flatnonzero((found != key) & (found >= 0) & (key >= 0))
        while len(going):
            slot[going] = (slot[going] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[going]]
            hit = found == key[going]
            out[going[hit]] = self.ranks[slot[going[hit]]]
            going = going[~hit & (found >= 0)]
        return out


class Pieces:
    """Merges, ids and bytes of a model file, with the chunks encoded so far."""

    def __init__(self, path: str, rate: float, seed: int):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.threshold, self.seed = int(rate * (1 << 32)), seed
        self.bytes = np.zeros(256, np.int64)
        self.ids: dict[str, int] = {}
        scores: dict[str, float] = {}
        self.raw: list[bytes] = [b""] * n
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece] = i
                scores[piece] = model.get_score(i)
                self.raw[i] = piece.replace(BLANK, " ").encode()
        # Best score first; equal ones by id.
        self.ranks = {p: r for r, p in enumerate(sorted(scores, key=lambda p: (-scores[p], self.ids[p])))}
        self.pairs = Pairs(self.ranks)
        # Symbol of every character; those of no piece are numbered behind all symbols.
        self.symbols = np.arange(0x110000, dtype=np.int32) + np.int32(self.pairs.size)
        for c, symbol in self.pairs.symbols.items():
            if len(c) == 1:
                self.symbols[ord(c)] = symbol
        self.symbols[32] = self.symbols[ord(BLANK)]
        self.symbol_ids = np.full(self.pairs.size, -1, np.int64)
        for piece, rank in self.ranks.items():
            self.symbol_ids[rank] = self.ids[piece]
        self.symbol_chars = np.zeros(self.pairs.size, np.int32)
        for c, symbol in self.pairs.symbols.items():
            self.symbol_chars[symbol] = ord(c) if len(c) == 1 else 0
        self.piece_sizes = np.array([len(r) for r in self.raw], np.int64)
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes
        self.piece_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.ids):
            raise ValueError("a piece of this model spans words, which chunks rely on never to happen")
        self.lone_newline = not any("\n" in p for p in self.ids if len(p) > 1)
        self.cache = W.ChunkCache(CACHE)

    def _drawn(self, draw: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Whether a candidate (rank << 32 | place) of an occurrence is skipped."""
        return W.mix(draw + W.mix(code + np.uint64(1))) >> np.uint64(32) < np.uint64(self.threshold)

    def chunk_ids(self, raw: bytes, draw: int | None = None) -> tuple[list[int], list[int]]:
        """Ids of one chunk and the candidates that came up; without ``draw`` none is skipped."""
        text = raw.decode("utf-8")
        # A literal mark never merges: encode what lies between, and the mark as bytes.
        out, met, base = [], [], 0
        for k, part in enumerate(text.split(BLANK)):
            out += self.bytes[list(BLANK.encode())].tolist() if k else []
            if part:
                ids, more = self._merge(part.replace(" ", BLANK), draw, base)
                out += ids
                met += more
            base += len(part) + 1
        return out, met

    def _merge(self, chunk: str, draw: int | None, base: int) -> tuple[list[int], list[int]]:
        """The agenda of one chunk, blanks already marked. Places count from ``base``."""
        symbols: list[str | None] = list(chunk)
        n = len(symbols)
        rank_of, ids, met = self.ranks.get, self.ids, {}
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [rank << 32 | i for i in range(n - 1) if (rank := rank_of(chunk[i : i + 2])) is not None]
        heapq.heapify(agenda)
        own = None if draw is None else np.full(1, draw, np.uint64)
        while agenda:
            entry = heapq.heappop(agenda)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            left, j = symbols[i], after[i]
            if left is None or j >= n or rank_of(piece := left + symbols[j]) != rank:
                continue
            met[entry + base] = None
            if own is not None and self._drawn(own, np.full(1, entry + base, np.uint64))[0]:
                continue
            symbols[i], symbols[j] = piece, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := rank_of(piece + symbols[k])) is not None:
                    heapq.heappush(agenda, rank << 32 | i)
            k = before[i]
            if k >= 0 and (rank := rank_of(symbols[k] + piece)) is not None:
                heapq.heappush(agenda, rank << 32 | k)
        out: list[int] = []
        for s in symbols:
            if s is not None:
                out += [ids[s]] if s in ids else self.bytes[list(s.encode())].tolist()
        return out, list(met)

    def _in_step(self, text: np.ndarray, first: np.ndarray, size: np.ndarray, draw: np.ndarray | None):
        """Agendas of many chunks, given by first symbol in ``text`` and size: see :meth:`_agendas`."""
        order = np.argsort(size, kind="stable")
        at = np.searchsorted(size[order], [1, 5, 9, 13, 17, 25, 33, STEP_CHARS + 1])
        parts = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            for lo in range(a, b, STEP_ROWS):
                rows = order[lo : min(b, lo + STEP_ROWS)]
                made = self._agendas(text, first[rows], size[rows], None if draw is None else draw[rows])
                parts.append((rows[made[0]], made[1], rows[made[2]], made[3]))
        if not parts:
            return (np.zeros(0, np.int64),) * 4
        row, symbol, met_row, code = (np.concatenate(c) for c in zip(*parts))
        by_row, by_met = np.argsort(row, kind="stable"), np.argsort(met_row, kind="stable")
        return row[by_row], symbol[by_row], met_row[by_met], code[by_met]

    def _agendas(self, text: np.ndarray, first: np.ndarray, size: np.ndarray, draw: np.ndarray | None):
        """The agendas of chunks of like size, a candidate of each at a time.

        Returns the chunk and the symbol of everything left, by chunk and place, and the chunk and the
        code of every candidate that came up, in that order; the latter only without draws.
        """
        n, length = len(first), int(size.max())
        place = np.arange(length)[:, None]
        inside = place < size
        symbols = np.where(inside, text[np.minimum(first + place, len(text) - 1)], np.int32(-1))
        after = np.repeat((place + 1).astype(np.int8), n, axis=1)
        before = np.repeat((place - 1).astype(np.int8), n, axis=1)
        candidates = np.full((length, n), _NEVER, np.int32)
        if length > 1:
            i, r = np.nonzero(place[:-1] + 1 < size)
            rank = self.pairs.rank(symbols[i, r], symbols[i + 1, r])
            some = rank >= 0
            candidates[i[some], r[some]] = rank[some] * STEP_CHARS + i[some]
        rows, met = np.arange(n), []
        done_rows, done_symbols = [], []

        def finish(out: np.ndarray) -> None:
            r, i = np.nonzero(symbols[:, out].T >= 0)
            done_rows.append(rows[out][r])
            done_symbols.append(symbols[i, out[r]])

        while len(rows):
            best = candidates.min(0)
            open_ = best != _NEVER
            live = np.flatnonzero(open_)
            if 2 * len(live) <= len(rows):
                finish(np.flatnonzero(~open_))
                symbols, after, before, candidates = (x[:, live] for x in (symbols, after, before, candidates))
                rows, size, best, live = rows[live], size[live], best[live], np.arange(len(live))
                if not len(rows):
                    break
            best = best[live].astype(np.int64)
            i, rank = best % STEP_CHARS, best // STEP_CHARS
            code = rank.astype(np.uint64) << np.uint64(32) | i.astype(np.uint64)
            if draw is None:
                met.append((rows[live], code))
            else:
                skip = self._drawn(draw[rows[live]], code)
                candidates[i[skip], live[skip]] = _NEVER
                live, i, rank = live[~skip], i[~skip], rank[~skip]
            j = after[i, live]
            k = after[j, live]
            symbols[i, live], symbols[j, live] = rank, -1
            candidates[j, live] = _NEVER
            after[i, live] = k
            right = k < size[live]
            before[k[right], live[right]] = i[right]
            candidates[i, live] = _NEVER
            left = before[i, live]
            for a, b, use in ((i, k, right), (left, i, left >= 0)):
                a, b, r = a[use], b[use], live[use]
                rank = self.pairs.rank(symbols[a, r], symbols[b, r])
                candidates[a, r] = np.where(rank >= 0, rank * STEP_CHARS + a, _NEVER)
        done = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_rows, done_symbols)]
        by_row = np.argsort(done[0], kind="stable")
        met_rows, codes = (np.concatenate(x) for x in zip(*met)) if met else (np.zeros(0, np.int64),) * 2
        return done[0][by_row], done[1][by_row], met_rows, codes

    def _symbol_ids(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all symbols in a row, and how many each has: one, or a byte each of a character."""
        known = symbol < self.pairs.size
        ids = np.where(known, self.symbol_ids[np.minimum(symbol, self.pairs.size - 1)], -1)
        sizes = np.ones(len(symbol), np.int64)
        if (other := np.flatnonzero(ids < 0)).size:
            chars = np.where(
                known[other], self.symbol_chars[np.minimum(symbol[other], self.pairs.size - 1)], symbol[other] - self.pairs.size
            )
            raw = [self.bytes[list(chr(c).encode())] for c in chars.tolist()]
            sizes[other] = [len(b) for b in raw]
            out = np.repeat(ids, sizes)
            starts = np.cumsum(sizes) - sizes
            for a, b in zip(starts[other].tolist(), raw):
                out[a : a + len(b)] = b
            return out, sizes
        return ids, sizes

    def _ids_of(self, n: int, row: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of n chunks in a row and how many each has."""
        ids, sizes = self._symbol_ids(symbol)
        return ids, np.bincount(row, sizes, n).astype(np.int64)

    def _learn(self, text: np.ndarray, first: np.ndarray, size: np.ndarray) -> W.Learned:
        """What is kept of a chunk: how many candidates came up, their ranks, their places, and the ids."""
        n = len(first)
        row, symbol, met_row, code = self._in_step(text, first, size, None)
        ids, n_ids = self._ids_of(n, row, symbol)
        if not self.threshold:
            met_row, code = met_row[:0], code[:0]
        n_met = np.bincount(met_row, minlength=n)
        sizes = 1 + 2 * n_met + n_ids
        starts = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.uint32)
        out[starts] = n_met
        step = np.arange(len(met_row)) - np.repeat(np.cumsum(n_met) - n_met, n_met)
        at = starts[met_row] + 1 + step
        code = code.astype(np.uint64)
        out[at], out[at + n_met[met_row]] = code >> np.uint64(32), code & np.uint64(0xFFFFFFFF)
        step = np.arange(len(ids)) - np.repeat(np.cumsum(n_ids) - n_ids, n_ids)
        out[np.repeat(starts + 1 + 2 * n_met, n_ids) + step] = ids
        return out, starts, sizes

    def encode(self, texts: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the n + 1 offsets of the texts; ``keys`` are one number per text."""
        data, offsets = _prefixed(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        blank = data == 32
        cuts = np.zeros(len(data) + 1, bool)
        cuts[1:-1] = blank[1:] & ~blank[:-1]
        if self.lone_newline:
            newline = np.flatnonzero(data == 10)
            cuts[newline] = True
            cuts[newline + 1] = True
        cuts[offsets] = True
        first = np.flatnonzero(cuts[:-1])
        last = np.append(first[1:], len(data))
        n = len(first)
        text = np.searchsorted(offsets, first, "right") - 1
        place = (first - offsets[text]).astype(np.uint64)
        draw = W.mix(keys[text] + place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.seed))
        raw = data.tobytes()
        chars = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        symbols = self.symbols[chars]
        char_at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        begin, size = char_at[first], char_at[last] - char_at[first]
        marks = np.concatenate([[0], np.cumsum(chars == ord(BLANK))])
        alone = (size > STEP_CHARS) | (marks[begin + size] > marks[begin])
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # chunks, ids in a row, how many each
        for c in np.flatnonzero(alone).tolist():
            ids, _ = self.chunk_ids(raw[first[c] : last[c]], int(draw[c]) if self.threshold else None)
            parts.append((np.array([c]), np.array(ids, np.int64), np.array([len(ids)])))
        plain = np.flatnonzero(~alone)
        flat, out = self.cache.ids(
            W.hashes(data, first, last)[plain], lambda new: self._learn(symbols, begin[plain[new]], size[plain[new]])
        )
        n_met = flat[out[:-1]].astype(np.int64)
        row = np.repeat(np.arange(len(plain)), n_met)
        at = out[row] + 1 + np.arange(len(row)) - np.repeat(np.cumsum(n_met) - n_met, n_met)
        code = flat[at].astype(np.uint64) << np.uint64(32) | flat[at + n_met[row]].astype(np.uint64)
        varied = np.zeros(len(plain), bool)
        varied[row[self._drawn(draw[plain][row], code)]] = True
        kept = np.flatnonzero(~varied)
        starts, sizes = (out[:-1] + 1 + 2 * n_met)[kept], (np.diff(out) - 1 - 2 * n_met)[kept]
        step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        parts.append((plain[kept], flat[np.repeat(starts, sizes) + step], sizes))
        own = plain[varied]
        row, symbol, *_ = self._in_step(symbols, begin[own], size[own], draw[own])
        parts.append((own, *self._ids_of(len(own), row, symbol)))
        counts = np.zeros(n, np.int64)
        for chunks, _, each in parts:
            counts[chunks] = each
        out = np.concatenate([[0], np.cumsum(counts)])
        made = np.zeros(out[-1], np.uint32)
        for chunks, ids, each in parts:
            step = np.arange(len(ids)) - np.repeat(np.cumsum(each) - each, each)
            made[np.repeat(out[chunks], each) + step] = ids
        return made, out[np.searchsorted(first, offsets)]

    def decode(self, ids: list[int]) -> str:
        """Text of the ids of one text."""
        raw = self.raw
        return b"".join([raw[i] for i in ids])[1:].decode("utf-8")


    def unchanged(self, ids: np.ndarray, offsets: np.ndarray, texts: pa.Array) -> np.ndarray:
        """Whether each text's ids decode to the text; all texts at once."""
        data, bounds = _prefixed(texts)
        sizes = self.piece_sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        made = self.piece_bytes[np.repeat(self.piece_starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])]
        own = ends[offsets]
        out = np.diff(own) == np.diff(bounds)
        if out.all():
            wrong = np.concatenate([[0], np.cumsum(made != data)])
            return np.diff(wrong[bounds]) == 0
        for i in np.flatnonzero(out).tolist():
            out[i] = np.array_equal(made[own[i] : own[i + 1]], data[bounds[i] : bounds[i + 1]])
        return out


def _prefixed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with one blank before every text that is not empty, and the offsets."""
    data, offsets = W.buffers(texts)
    some = np.diff(offsets) > 0
    moved = offsets + np.concatenate([[0], np.cumsum(some)])
    out = np.full(moved[-1], 32, np.uint8)
    own = np.ones(len(out), bool)
    own[moved[:-1][some]] = False
    out[own] = data
    return out, moved


_loaded: dict[tuple, Pieces] = {}


def pieces(path: str, rate: float = RATE, seed: int = SEED) -> Pieces:
    """One per worker process and setting."""
    if (path, rate, seed) not in _loaded:
        _loaded[path, rate, seed] = Pieces(path, rate, seed)
    return _loaded[path, rate, seed]


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _keys(doc_ids: pa.Array, seed: int) -> np.ndarray:
    """A number for each document; null ids share one."""
    ids = doc_ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return W.mix(ids + np.uint64(int.from_bytes(hashlib.sha256(str(seed).encode()).digest()[:8], "little")))


def encode(
    docs: DataFrame, rate: float = RATE, seed: int = SEED, path: str | None = None, digest: bool = False
) -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text); null and empty texts have no ids.

    ``digest`` replaces ids by n_ids, ids_crc32 (of little-endian unsigned 32-bit ids) and lossless
    (whether decoding gives the text back; a null text counts as empty).
    """
    schema = "doc_id long, " + (
        "n_ids long, ids_crc32 long, lossless boolean" if digest else "ids array<int>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path or model_path(), rate, seed)
        for part in (part for b in batches for part in W.slices(b)):
            texts, keys = part.column("text"), _keys(part.column("doc_id"), seed)
            ids, offsets = model.encode(texts, keys)
            borders = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
            if digest:
                data = ids.astype("<u4")
                columns = [
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array([zlib.crc32(data[a:b].tobytes()) for a, b in borders], pa.int64()),
                    pa.array(model.unchanged(ids, offsets, texts)),
                ]
            else:
                columns = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))]
            names = ["n_ids", "ids_crc32", "lossless"] if digest else ["ids"]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *names])

    forget = lambda: pieces(path or model_path(), rate, seed).cache.prune(KEPT)
    return docs.select("doc_id", "text").mapInArrow(W.task(run, forget), schema)


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path or model_path(), 0.0, 0)
        for batch in batches:
            texts = [model.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(W.task(run), "doc_id long, text string")


def op10_piece_tokens(spark, sf_dir: str) -> DataFrame:
    """Digest of the ids of every document under merge-dropout, with a check of the round trip."""
    return encode(table(spark, sf_dir, "documents"), digest=True)
