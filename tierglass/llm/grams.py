"""Hashed byte n-grams of Arrow texts as dense numpy blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tierglass.llm import words as W

BLOCK_ROWS = 512


def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of at most BLOCK_ROWS rows and about W.SLICE_BYTES of text; one longer text is one block."""
    for part in W.slices(batch):
        for start in range(0, len(part), BLOCK_ROWS):
            yield part.slice(start, BLOCK_ROWS)


def slots(texts: pa.Array, sizes: tuple[int, ...], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each gram size the text number and the slot of every gram; A-Z are lower-cased."""
    data, offsets = W.buffers(texts)
    data = W.lower(data).astype(np.uint32)
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    for n in sizes:
        if len(data) < n:
            continue
        gram = np.full(len(data) - n + 1, n, np.uint32)
        for k in range(n):
            gram = gram * np.uint32(0x01000193) ^ data[k : len(data) - n + 1 + k]
            gram *= np.uint32(0x9E3779B1)
        inside = text[: len(gram)] == text[n - 1 :]
        slot = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - (width - 1).bit_length())
        yield text[: len(gram)][inside], slot[inside].astype(np.int64)


def presence(texts: pa.Array, sizes: tuple[int, ...], width: int) -> np.ndarray:
    """0/1 block (texts x width) of the slots that occur."""
    out = np.zeros(len(texts) * width, bool)
    for text, slot in slots(texts, sizes, width):
        out[text * width + slot] = True
    return out.reshape(len(texts), width)


def counts(texts: pa.Array, sizes: tuple[int, ...], width: int) -> np.ndarray:
    """Block (texts x width) of how often each slot occurs."""
    out = np.zeros(len(texts) * width, np.float32)
    for text, slot in slots(texts, sizes, width):
        out += np.bincount(text * width + slot, minlength=len(out)).astype(np.float32)
    return out.reshape(len(texts), width)


def repetition(texts: pa.Array) -> np.ndarray:
    """Shares per text: words equal to the word before, repeated words, bytes in repeated lines."""
    data, offsets = W.buffers(texts)
    n, out = len(texts), np.zeros((len(texts), 3), np.float32)
    starts, ends, word_offsets = W.bounds(data, offsets)
    if not len(starts):
        return out
    h = W.hashes(data, starts, ends)
    text = np.repeat(np.arange(n), np.diff(word_offsets))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    words = np.maximum(np.diff(word_offsets), 1)
    out[:, 0] = np.bincount(text, again, n) / words
    out[:, 1] = np.bincount(text, _repeated(text, h), n) / words
    breaks = np.zeros(len(data) + 1, bool)
    breaks[np.flatnonzero(data == 10) + 1] = True
    breaks[offsets] = True
    first = np.flatnonzero(breaks[:-1])
    last = np.append(first[1:], len(data))
    text = np.searchsorted(offsets, first, "right") - 1
    bare = last - ((last > first) & (data[last - 1] == 10))
    size = bare - first
    out[:, 2] = np.bincount(text, _repeated(text, W.hashes(data, first, bare)) * size, n) / np.maximum(
        np.bincount(text, size, n), 1
    )
    return out


def _repeated(text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which values occurred before in the same text."""
    order = np.lexsort((h, text))
    same = np.zeros(len(h), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    out = np.zeros(len(h), bool)
    out[order] = same
    return out
