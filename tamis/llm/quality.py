"""Quality rules: counts over whole texts, and how well public vocabularies fit them (tokeniser fertility).

Base counts are exact and fail short or repetitive texts. Fertility measures, by a public vocabulary with byte fallback, the
characters per token, the share of tokens that are raw bytes of characters outside ASCII, and the entropy of the tokens in bits. Text that a
vocabulary was not made for (noise, broken encodings, keyboard mash, other scripts under a wrong label) takes many short tokens or
bytes; templates, lists and symbols between the words take few different ones. Entropy grows with the length of a text, so its bound does
too. The bands hold per language, and per script where the language is unknown.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.llm.flat import SLICE_BYTES, plain_words, slices, spans_outside, sums, text_bytes
from tamis.llm.hashing import mix, span_hashes, windows
from tamis.llm.pieces import MODEL, piece_tokens

LEAST_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
WINDOW = 3


#: log2 of the tokens of a text at which entropy bounds are given; in between they are interpolated, outside the end values hold.
KNOTS = (6, 7, 8, 9, 10, 11, 12)


@dataclass(frozen=True)
class Band:
    """A text is kept when it lies within all three."""

    characters: tuple[float, float]  # per token
    most_bytes: float  # share of byte-fallback tokens
    least_entropy: tuple[float, ...]  # bits, at KNOTS


#: Fitted on the 3,534 labelled documents of sf0.1 that pass the base rules (3,243 of quality 1, 291 of quality 0). Characters a token: the
#: smallest value of quality 1, rounded down to 0.05. Entropy: logistic regression of the label on the entropy, the language and hat functions
#: at KNOTS from 7 on; the value at 6 carries on the slope.
LANGUAGES = {"en": Band((2.15, 8.0), 0.02, (5.05, 5.43, 5.80, 6.10, 6.30, 6.38, 6.52)),
             "de": Band((2.35, 8.0), 0.02, (4.98, 5.36, 5.73, 6.03, 6.23, 6.31, 6.45)),
             "fr": Band((1.95, 8.0), 0.02, (4.92, 5.29, 5.67, 5.97, 6.17, 6.25, 6.38)),
             "es": Band((2.10, 8.0), 0.02, (5.02, 5.40, 5.77, 6.07, 6.27, 6.35, 6.49))}
_FLAT = (3.5,) * len(KNOTS)
SCRIPTS = {"latin": Band((1.3, 9.0), 0.05, _FLAT), "cyrillic": Band((1.2, 8.0), 0.05, _FLAT), "other": Band((0.3, 8.0), 0.75, _FLAT)}
_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _script(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Most frequent script of each text among its letters: 0 latin, 1 cyrillic, 2 other. ASCII letters and U+00C0-U+024F are latin."""
    low = body | 32
    latin = ((low >= 97) & (low <= 122)) | ((body >= 0xC3) & (body <= 0xC9))
    cyrillic = (body >= 0xD0) & (body <= 0xD3)
    other = body >= 0xCA
    return np.stack([sums(x, offsets) for x in (latin, cyrillic, other & ~cyrillic)]).argmax(axis=0)


def _repeats(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether the value occurs twice or more in its run, whether it occurred before in its run)."""
    run = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    key = mix(hashes ^ mix(run.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = np.append(False, ordered[1:] == ordered[:-1])[:len(order)]
    often = same | np.append(same[1:], False)[:len(order)]
    twice, before = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[order], before[order] = often, same
    return twice, before


def base_counts(body: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of `_FIELDS` for each text."""
    starts, ends, by_text = plain_words(body, offsets)
    marks = np.zeros(len(body) + 1, np.int64)
    marks[starts] += 1
    marks[ends] -= 1
    inside = np.cumsum(marks)[:-1] > 0
    words = span_hashes(body, starts, ends)
    # lines with a word; equal to an earlier line of the text
    l_starts, l_ends, l_by_text = spans_outside(body, offsets, body == 10)
    some = np.searchsorted(starts, l_ends) > np.searchsorted(starts, l_starts)
    lines = span_hashes(body, l_starts[some], l_ends[some])
    kept = np.concatenate(([0], np.cumsum(some)))[l_by_text]
    _, again = _repeats(lines, kept)
    # words inside windows that occur twice or more
    triples, t_by_text = windows(words, by_text, WINDOW)
    short = np.repeat(np.diff(by_text) < WINDOW, np.diff(t_by_text))
    often, _ = _repeats(triples, t_by_text)
    at = np.flatnonzero(often & ~short)
    text = np.searchsorted(t_by_text, at, "right") - 1
    first = by_text[text] + at - t_by_text[text]
    covered = np.zeros(len(words), bool)
    for k in range(WINDOW):
        covered[first + k] = True
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    return {"n_words": np.diff(by_text), "word_chars": sums(inside & ((body & 0xC0) != 0x80), offsets), "n_symbols": sums(symbol[body], offsets),
            "n_dup_lines": sums(again, kept), "n_repeat_words": sums(covered, by_text)}


def fertility(ids: np.ndarray, offsets: np.ndarray, characters: np.ndarray, is_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters per token, share of byte tokens, entropy of the tokens in bits) of each text; 0 without tokens."""
    n = np.diff(offsets)
    run = np.repeat(np.arange(len(n)), n)
    key = np.sort(run << 32 | ids)
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
    count = np.diff(np.append(head, len(key))).astype(float)
    by_text = np.bincount(key[head] >> 32, count * np.log2(count), len(n)) if len(key) else np.zeros(len(n))
    safe = np.maximum(n, 1)
    entropy = np.where(n > 0, np.log2(safe) - by_text / safe, 0.0)
    return characters / safe, sums(is_byte[ids], offsets) / safe, np.maximum(entropy, 0.0)


def entropy_bounds(n: np.ndarray, at_knots: np.ndarray) -> np.ndarray:
    """The bound of each text for its number of tokens; a row of `at_knots` has its values at KNOTS."""
    place = np.interp(np.log2(np.maximum(n, 1)), KNOTS, np.arange(len(KNOTS)))
    below = np.minimum(place.astype(int), len(KNOTS) - 2)
    row, part = np.arange(len(n)), place - below
    return at_knots[row, below] * (1 - part) + at_knots[row, below + 1] * part


@dataclass(frozen=True)
class Rules:
    """Limits and bands of the verdict."""

    model: str = MODEL
    least_words: int = LEAST_WORDS
    repeat_percent: int = REPEAT_PERCENT
    languages: tuple[tuple[str, Band], ...] = tuple(LANGUAGES.items())
    scripts: tuple[tuple[str, Band], ...] = tuple(SCRIPTS.items())

    def judge(self, text: pa.Array, lang: pa.Array) -> pa.StructArray:
        """The fields of VERDICT for each text."""
        coder, languages, scripts = piece_tokens(self.model), dict(self.languages), dict(self.scripts)
        body, offsets = text_bytes(text)
        out = base_counts(body, offsets)
        n = out["n_words"]
        failed = (n < self.least_words) | (100 * out["n_repeat_words"] > self.repeat_percent * n)
        ids, at = coder.encode(body, offsets)
        characters, share, entropy = fertility(ids, at, sums((body & 0xC0) != 0x80, offsets), coder.is_foreign)
        names = list(scripts)
        labels = [x if x in languages else names[s] for x, s in zip(lang.to_pylist(), _script(body, offsets).tolist(), strict=True)]
        bands = [languages.get(x) or scripts[x] for x in labels]
        low, high, most = np.array([(*b.characters, b.most_bytes) for b in bands]).T.reshape(3, -1)
        least = entropy_bounds(np.diff(at), np.array([b.least_entropy for b in bands]).reshape(-1, len(KNOTS)))
        fits = (characters >= low) & (characters <= high) & (share <= most) & (entropy >= least)
        columns = [*[pa.array(out[k].astype(np.int64)) for k in _FIELDS], pa.array(failed), pa.array(fits & ~failed), pa.array(characters),
                   pa.array(share), pa.array(entropy), pa.array(labels, pa.string())]
        return pa.StructArray.from_arrays(columns, [*_FIELDS, "base_failed", "kept", "chars_per_token", "byte_share", "entropy", "band"])


VERDICT = ", ".join(f"{k}: bigint" for k in _FIELDS) + (
    ", base_failed: boolean, kept: boolean, chars_per_token: double, byte_share: double, entropy: double, band: string")


def judged(docs: DataFrame, verdict: str = "verdict", text: str = "text", lang: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """`docs` with a struct column `verdict` (fields of VERDICT); no row or column is lost and nothing is shuffled. An earlier column of
    that name is replaced.

    A null or empty text has no words and fails. A language without a band (null too) takes the band of the text's script."""
    kept = [c for c in docs.columns if c != verdict]

    def run(batches):
        for part in slices(batches, text, SLICE_BYTES // 2):  # a dozen arrays of eight bytes for each byte of text
            yield pa.RecordBatch.from_arrays([*part.columns, rules.judge(part.column(text), part.column(lang))], [*part.schema.names, verdict])

    rows = docs.select(*kept)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *T.StructType.fromDDL(f"{verdict} struct<{VERDICT}>").fields]))


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """(doc_id and the fields of VERDICT) for every whole text; all are measured, those that fail the base rules as well. Repeated rows
    come once each. Other columns are left out."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return judged(rows, rules=rules).select("doc_id", "verdict.*")
