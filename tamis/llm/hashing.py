"""Hashes of words, shingles and lines over flat byte arrays; minwise signatures; exact overlap of hash sets."""

from __future__ import annotations

import numpy as np
import xxhash

from tamis.llm.flat import objects, plain_words, words_of

_WEIGHTS = np.random.default_rng(20240307).integers(1 << 62, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash (xxh3) of the bytes of each span, spans in order and apart from each other. A word that occurs often is hashed once."""
    coded = words_of(body, starts, ends).dictionary_encode()
    distinct = objects(coded.dictionary)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))[coded.indices.to_numpy()]


def windows(values: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each window of `width` neighbouring values within a run, offsets by run). A shorter run that isn't empty is one
    window of all its values."""
    lengths = np.diff(offsets)
    counts = np.where(lengths >= width, lengths - width + 1, (lengths > 0).astype(np.int64))
    out_offsets = np.concatenate(([0], np.cumsum(counts)))
    # weighted sums of neighbours; windows that would reach beyond a short run are summed apart
    total = np.zeros(max(0, len(values) - width + 1), np.uint64)
    for k in range(width):
        total += values[k:k + len(total)] * _WEIGHTS[k]
    first = np.repeat(offsets[:-1], counts) + np.arange(out_offsets[-1]) - np.repeat(out_offsets[:-1], counts)
    short = np.repeat(lengths < width, counts)
    out = np.zeros(len(first), np.uint64)
    out[~short] = total[first[~short]]
    last = np.repeat(offsets[1:], counts)[short]
    for k in range(width):
        here = first[short] + k
        inside = here < last
        out[short] += np.where(inside, values[np.where(inside, here, 0)] * _WEIGHTS[k], np.uint64(0))
    return mix(out), out_offsets


def lower_ascii(body: np.ndarray) -> np.ndarray:
    return np.where((body >= 65) & (body <= 90), body + np.uint8(32), body)


def word_shingles(body: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the `width`-word shingles of each text (A-Z lower-cased), with repeats: (hashes, offsets by text)."""
    low = lower_ascii(body)
    starts, ends, by_text = plain_words(low, offsets)
    return windows(span_hashes(low, starts, ends), by_text, width)


def unique_runs(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run sorted and without repeats: (values, offsets)."""
    parts = [np.unique(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate(([0], np.cumsum(sizes)))


def minwise(values: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """(runs x count) minima of the runs under `count` fixed random orders; all ones for an empty run."""
    draws = np.random.default_rng(20240229)
    factors = draws.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = draws.integers(0, 1 << 32, count, dtype=np.uint32)
    short = (values >> np.uint64(32)).astype(np.uint32)
    out = np.full((len(offsets) - 1, count), 0xFFFFFFFF, np.uint32)
    filled = np.flatnonzero(np.diff(offsets) > 0)
    if len(filled):
        starts = offsets[:-1][filled]
        for k in range(count):
            out[filled, k] = np.minimum.reduceat(short * factors[k] ^ shifts[k], starts)
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def overlaps(a: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """`overlap` of one array with each of several."""
    if not len(a) or not others:
        return np.zeros(len(others), np.int64)
    flat, ends = np.concatenate(others), np.cumsum([0, *map(len, others)])
    at = np.minimum(np.searchsorted(a, flat), len(a) - 1)
    return np.diff(np.concatenate(([0], np.cumsum(a[at] == flat)))[ends])
