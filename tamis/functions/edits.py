"""Edit distance for the pairs of an Arrow batch: bit vectors of 64 rows, all pairs of a group side by side, in a band that doubles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import IntegerType

GROUP_PAIRS = 4096
GROUP_SYMBOLS = 1 << 21  # symbols of a group, a longer pair is a group of its own
FIRST_BAND = 16
_ONE, _ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
_TOP = np.uint64(63)


def distances(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Least number of inserted, left-out and exchanged symbols between the integer arrays left[i] and right[i]."""
    out = np.zeros(len(left), dtype=np.int64)
    todo = []
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        a, b = _trimmed(a, b)
        if len(a) == 0 or len(b) == 0:
            out[i] = len(a) + len(b)
        else:
            todo.append((i, *((a, b) if len(a) <= len(b) else (b, a))))  # rows are the shorter side
    band = FIRST_BAND
    while todo:
        now = [t for t in todo if len(t[2]) - len(t[1]) <= band]
        later = [t for t in todo if len(t[2]) - len(t[1]) > band]
        now.sort(key=lambda t: (-(-len(t[1]) // 64), len(t[2])))
        for group in _groups(now):
            got = _banded([t[1] for t in group], [t[2] for t in group], band)
            for t, d in zip(group, got, strict=True):
                if d <= band or band >= len(t[2]):
                    out[t[0]] = d
                else:
                    later.append(t)
        todo, band = later, band * 2
    return out


def _trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the common start and the common end."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    first = int(differ[0]) if len(differ) else n
    a, b = a[first:], b[first:]
    n = min(len(a), len(b))
    if n:
        differ = np.flatnonzero(a[len(a) - n:] != b[len(b) - n:])
        same = n - 1 - int(differ[-1]) if len(differ) else n
        a, b = a[:len(a) - same], b[:len(b) - same]
    return a, b


def _groups(pairs: list) -> list[list]:
    """Runs of pairs with as many blocks of rows, bounded in pairs and symbols."""
    out, held = [], 0
    for t in pairs:
        size = len(t[1]) + len(t[2])
        if not out or len(out[-1]) == GROUP_PAIRS or held + size > GROUP_SYMBOLS or -(-len(out[-1][0][1]) // 64) != -(-len(t[1]) // 64):
            out.append([])
            held = 0
        out[-1].append(t)
        held += size
    return out


def _banded(rows: list[np.ndarray], columns: list[np.ndarray], band: int) -> np.ndarray:
    """Distances of pairs whose rows fill as many blocks; right where they are at most `band`, too large or right elsewhere.

    Only blocks that touch the band are walked. Above the band each step right is taken as one more, below it each step down: both can
    only make a value too large, and a path of at most `band` edits never leaves the band."""
    pairs, blocks = len(rows), -(-len(rows[0]) // 64)
    width = max(len(c) for c in columns)
    ends = np.array([len(c) for c in columns])
    last = np.array([(len(r) - 1) % 64 for r in rows], dtype=np.uint64)
    symbols, sets = _row_sets(rows, columns, width)
    up, down = np.full((blocks, pairs), _ALL), np.zeros((blocks, pairs), dtype=np.uint64)
    bottom = min(band // 64, blocks - 1)
    score = np.full(pairs, bottom * 64, dtype=np.int64) + (last.astype(np.int64) + 1 if bottom == blocks - 1 else 64)
    result = np.zeros(pairs, dtype=np.int64)
    for j in range(width):
        lowest = min((j + band) // 64, blocks - 1)
        if lowest > bottom:  # at most one block more a column
            bottom = lowest
            score = score + (last.astype(np.int64) + 1 if bottom == blocks - 1 else 64)
        more, less = _ONE, np.uint64(0)
        for b in range(min(max(j - band, 0) // 64, bottom), bottom + 1):
            same, p, m = sets(symbols[j], b), up[b], down[b]
            x = same | m
            same = same | less
            h = (((same & p) + p) ^ p) | same
            plus, minus = m | ~(h | p), p & h
            if b == bottom:
                at = last if b == blocks - 1 else _TOP
                score = score + ((plus >> at) & _ONE).astype(np.int64) - ((minus >> at) & _ONE).astype(np.int64)
            carry, drop = plus >> _TOP, minus >> _TOP
            plus, minus = (plus << _ONE) | more, (minus << _ONE) | less
            up[b], down[b] = minus | ~(x | plus), plus & x
            more, less = carry, drop
        done = ends == j + 1
        if done.any():
            result[done] = score[done]
    return result


def _row_sets(rows: list[np.ndarray], columns: list[np.ndarray], width: int):
    """(symbols, sets): symbols[j] numbers the column symbol j of each pair, and sets(symbols[j], b) gives the rows of block b that
    hold it as bits. Number 0 stands for a symbol that no row of its pair holds."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    place = np.concatenate([np.arange(len(r)) for r in rows])
    flat = np.concatenate(rows)
    known, code = np.unique(np.concatenate([flat, *columns]), return_inverse=True)
    mine = owner * len(known) + code[:len(flat)]
    kinds, kind = np.unique(mine, return_inverse=True)
    blocks = -(-len(rows[0]) // 64)
    bits = np.left_shift(np.uint64(1), (place % 64).astype(np.uint64))
    cells, cell = np.unique((kind + 1) * blocks + place // 64, return_inverse=True)
    masks = np.zeros(len(cells), dtype=np.uint64)
    np.bitwise_or.at(masks, cell, bits)
    lengths = [len(c) for c in columns]
    asked = np.repeat(np.arange(len(columns)), lengths) * len(known) + code[len(flat):]
    at = np.minimum(np.searchsorted(kinds, asked), len(kinds) - 1)
    number = np.where(kinds[at] == asked, at + 1, 0)
    symbols = np.zeros((width, len(columns)), dtype=np.int64)
    symbols[np.concatenate([np.arange(n) for n in lengths]), np.repeat(np.arange(len(columns)), lengths)] = number
    if (len(kinds) + 1) * blocks <= 1 << 22:
        table = np.zeros((len(kinds) + 1) * blocks, dtype=np.uint64)
        table[cells] = masks
        by_block = np.ascontiguousarray(table.reshape(-1, blocks).T)
        return symbols, lambda s, b: by_block[b][s]

    def found(s: np.ndarray, b: int) -> np.ndarray:  # long texts of many symbols: only the cells that hold a bit
        want = s * blocks + b
        i = np.minimum(np.searchsorted(cells, want), len(cells) - 1)
        return np.where(cells[i] == want, masks[i], np.uint64(0))

    return symbols, found


def _masked(d: np.ndarray, a: pa.Array, b: pa.Array) -> pa.Array:
    missing = np.asarray(a.is_null()) | np.asarray(b.is_null())
    return pa.array(d, pa.int32(), mask=missing)


def _points(texts: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer((t or "").encode("utf-32-le"), dtype=np.uint32) for t in texts.to_pylist()]


@arrow_udf(IntegerType())
def edit_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Edit distance of two texts in code points; null where one is null."""
    return _masked(distances(_points(a), _points(b)), a, b)


@arrow_udf(IntegerType())
def list_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Edit distance of two lists of strings; null where one is null. Null items are equal to each other."""
    left, right = a.to_pylist(), b.to_pylist()
    numbers: dict = {}
    coded = [[np.array([numbers.setdefault(w, len(numbers)) for w in (row or [])], dtype=np.int64) for row in side] for side in (left, right)]
    return _masked(distances(*coded), a, b)
