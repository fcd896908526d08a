"""Whole texts as flat byte arrays inside Arrow batches: slices of bounded size, ragged gathers, distinct words.

A Spark text column reaches a task as one byte buffer and offsets. The helpers here cut that buffer into words without making
a Python object for each, so that the cost of a word that occurs often is one index.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
CACHE_WORDS = 300_000
CACHE_BYTES = 12 << 20
CACHE_VALUES = 4_000_000


def token_file(name: str) -> str:
    """Path of a vocabulary: a path as it is, else a file of the installed public tokenizers."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def free_name(taken: list[str], name: str) -> str:
    """`name`, with underscores before it until no column is called so."""
    while name.lower() in {c.lower() for c in taken}:
        name = "_" + name
    return name


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; a null counts as an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset:column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches again, in batches of at most `max_bytes` of text, or one row where that is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        first = 0
        while first < batch.num_rows:
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(first, last - first)
            first = last
    rest()


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    """glibc's malloc_trim, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return None


def rest() -> None:
    """Give memory that a task has freed back to the system: a worker lives on, idle, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim is not None:
        trim(0)


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs values[start : start + length], one after the other."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    return values[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of `values` in each run between neighbouring offsets; 0 for an empty run."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def words_of(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array of body[start:end]; the runs must not overlap and must be in order."""
    lengths = ends - starts
    packed = body if len(starts) and starts[0] == 0 and np.array_equal(starts[1:], ends[:-1]) and ends[-1] == len(body) \
        else gather(body, starts, lengths)
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(packed))])


def objects(words: pa.Array) -> list[bytes]:
    """The words of a binary array without nulls, many times faster than by to_pylist."""
    return words.to_numpy(zero_copy_only=False).tolist()


def matrix(column: pa.Array | pa.ChunkedArray, dtype) -> np.ndarray:
    """Binary values of one length, without nulls, as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return text_bytes(column)[0].view(dtype).reshape(len(column), -1)


class WordTable:
    """Values of distinct words, kept by a Python worker from one slice to the next and emptied when the bound is reached.

    `compute(words)` gives (flat values, lengths) for a list of distinct words (bytes)."""

    def __init__(self, compute: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], dtype=np.int32,
                 max_words: int = CACHE_WORDS, max_values: int = CACHE_VALUES, max_bytes: int = CACHE_BYTES):
        self.compute, self.dtype, self.max_words, self.max_values, self.max_bytes = compute, dtype, max_words, max_values, max_bytes
        self.clear()

    def clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.bytes = 0
        self.flat, self.start, self.length = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) in `self.flat` for each word."""
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        coded = words.dictionary_encode()
        distinct = objects(coded.dictionary)
        if len(self.slot) + len(distinct) > self.max_words + len(distinct) // 2 or len(self.flat) > self.max_values or self.bytes > self.max_bytes:
            self.clear()
        slot = self.slot
        at = np.fromiter(map(slot.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [distinct[i] for i in missing]
            self.bytes += sum(map(len, new))
            values, lengths = self.compute(new)
            ends = np.cumsum(lengths)
            base, first = len(self.flat), len(self.start)
            self.flat = np.concatenate((self.flat, values.astype(self.dtype)))
            self.start = np.concatenate((self.start, base + ends - lengths))
            self.length = np.concatenate((self.length, lengths))
            at[missing] = np.arange(first, first + len(new))
            slot.update(zip(new, range(first, first + len(new)), strict=True))
        index = at[coded.indices.to_numpy()]
        return self.start[index], self.length[index]


_holder = None


def hold(owner) -> None:
    """One vocabulary's word tables at a time in a worker: those of the one before are emptied, since a worker lives over many jobs."""
    global _holder
    if _holder is not owner:
        for table in _holder.tables() if _holder is not None else ():
            table.clear()
        _holder = owner


def spans_outside(body: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes not marked in `gap`, never across texts: (starts, ends, offsets of the runs by text)."""
    edge = np.zeros(len(body) + 1, bool)
    edge[offsets] = True
    inside = ~gap
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def plain_words(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space (0x20, 0x09-0x0D): (starts, ends, offsets by text)."""
    return spans_outside(body, offsets, _SPACE[body])
