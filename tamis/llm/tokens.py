"""Token ids of whole texts by the public byte-pair vocabularies, at the cost of the distinct words of a slice.

A text is cut only where no token can cross, so the ids of the parts, joined, are the ids of the text. The distinct parts of a
slice are split into the vocabulary's own words, and the distinct words go through the merge rounds of `merges`. Parts that hold
a special string, a NUL, or a character that the tokenizers library's Unicode tables treat otherwise are left to that library. Both ways give
the ids of the library.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from tamis.llm.flat import WordTable, gather, hold, plain_words, sums, token_file, words_of
from tamis.llm.merges import Merges


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Symbols and merges of a tokenizers file with byte letters."""

    def __init__(self, path: str):
        spec = json.loads(open(token_file(path), encoding="utf-8").read())
        model = spec["model"]
        ids = model["vocab"]
        self.ending = model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.fromiter((ids[a] for a, _ in pairs), np.int64, len(pairs))
        right = np.fromiter((ids[b] for _, b in pairs), np.int64, len(pairs))
        made = np.fromiter((ids[a + b] for a, b in pairs), np.int32, len(pairs))
        self.left, self.right, self.made = left, right, made
        self.merges = Merges(left << 32 | right, np.arange(len(pairs), dtype=np.int32), made, max(ids.values()) + 1)
        letters = byte_letters()
        self.inner = np.array([ids[x] for x in letters], np.int32)
        self.final = np.array([ids[x + self.ending] for x in letters], np.int32)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.names = {i: name for name, i in ids.items()}

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """First symbols of the words, flat, and their lengths."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        body = np.frombuffer(b"".join(words), np.uint8)
        out = self.inner[body]
        if self.ending:
            last = np.cumsum(lengths) - 1
            out[last] = self.final[body[last]]
        return out, lengths

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.merges.run(*self.symbols(words)) if words else (np.zeros(0, np.int32), np.zeros(0, np.int64))


_SAME, _OTHER = 1, 2
_WHITE = regex.compile(r"\p{White_Space}")


class Letters:
    """Characters that the tokenizers library splits, lower-cases or composes in another way than `pattern` and `normal` do here, since its
    Unicode tables are of another version. A character beyond ASCII is compared once in a worker, between letters and marks."""

    def __init__(self, library, pattern: regex.Pattern, normal: Callable[[str], str]):
        self.library, self.pattern, self.normal = library, pattern, normal
        self.known = np.zeros(0x110000, np.uint8)
        self.known[:128] = _SAME

    def _learn(self, points: np.ndarray) -> None:
        text = "".join(f"a{chr(c)}:" for c in points)
        spans: list[list] = [[set() for _ in points] for _ in range(2)]
        for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text):
            spans[0][a // 3].add((a % 3, b - a))
        for m in self.pattern.finditer(text):
            if not m.group().isspace() or self.library.normalizer is None:
                spans[1][m.start() // 3].add((m.start() % 3, m.end() - m.start()))
        same = np.array([a == b for a, b in zip(*spans, strict=True)], bool)
        if self.library.normalizer is not None:
            around = "\0".join(f"{chr(c)}:a{chr(c)}\u0316" for c in points)
            theirs, ours = self.library.normalizer.normalize_str(around).split("\0"), _WHITE.sub(" ", self.normal(around)).split("\0")
            same &= np.array([a == b for a, b in zip(theirs, ours, strict=True)], bool)
        self.known[points] = np.where(same, _SAME, _OTHER)

    def other(self, texts: list[str]) -> regex.Pattern | None:
        """A pattern of those in the texts, or None."""
        points = np.frombuffer("".join(t for t in texts if not t.isascii()).encode("utf-32-le", "replace"), np.uint32)
        points = np.unique(points[points >= 128])
        new = points[self.known[points] == 0]
        for first in range(0, len(new), 10_000):
            self._learn(new[first:first + 10_000])
        found = points[self.known[points] == _OTHER]
        return regex.compile("[" + "".join(regex.escape(chr(c)) for c in found) + "]") if len(found) else None


class PartTokens:
    """Values of whole texts from those of their words; here the values are token ids."""

    pattern: regex.Pattern
    dtype = np.int32

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path = path
        self.library = Tokenizer.from_file(token_file(path))
        self.vocabulary = Vocabulary(path)
        self.letters = Letters(self.library, self.pattern, self.normal)
        self.words = WordTable(self.values_of_words, self.dtype)
        self.table = WordTable(self._compute, self.dtype)

    def normal(self, text: str) -> str:
        return text

    def values_of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.vocabulary.encode(words)

    def values_of_odd(self, part: str) -> list[int]:
        """Values of a part with a special string, a NUL or a character of `Letters.other`."""
        return self.library.encode(part, add_special_tokens=False).ids

    def _compute(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        whole = b"\0".join(parts).decode("utf-8", "replace")  # most slices have nothing odd, and are looked through once
        strange = self.letters.other([whole])
        odd = {}
        if strange or whole.count("\0") >= len(parts) or "<|" in whole:
            texts = [p.decode("utf-8", "replace") for p in parts]
            odd = {i: self.values_of_odd(t) for i, t in enumerate(texts)
                   if "\0" in t or "<|" in t and any(s in t for s in self.vocabulary.special) or strange and strange.search(t)}
            for i in odd:
                texts[i] = ""
            whole = "\0".join(texts)
        found = self.pattern.findall(self.normal(whole))
        words = _binary(found)
        ends = pc.equal(words, b"\0").to_numpy(zero_copy_only=False)
        at, lengths = self.words.look_up(words.filter(pa.array(~ends)))
        flat = gather(self.words.flat, at, lengths)
        part_of = np.cumsum(ends)[~ends]
        counts = np.bincount(part_of, lengths, len(parts)).astype(np.int64)
        if odd:
            runs = np.split(flat, np.cumsum(counts)[:-1])
            for i, ids in odd.items():
                runs[i] = np.array(ids, flat.dtype)
                counts[i] = len(ids)
            flat = np.concatenate(runs)
        return flat, counts

    def tables(self) -> tuple[WordTable, ...]:
        return self.table, self.words

    def parts(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raise NotImplementedError

    def encode(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of the ids by text)."""
        hold(self)
        starts, ends, by_text = self.parts(body, offsets)
        at, lengths = self.table.look_up(words_of(body, starts, ends))
        return gather(self.table.flat, at, lengths), np.concatenate(([0], np.cumsum(sums(lengths, by_text))))


def _binary(words: list[str]) -> pa.Array:
    return pa.array(words, pa.string()).cast(pa.binary())


_LOW = np.arange(256) <= 32  # white space and control bytes
_LEAD2, _LEAD3 = np.zeros(256, bool), np.zeros(256, bool)
_LEAD2[0xC2] = True  # first byte of U+0085 and U+00A0
_LEAD3[[0xE1, 0xE2, 0xE3]] = True  # first bytes of the other Unicode spaces


class ByteTokens(PartTokens):
    """Byte-level BPE whose words take one leading space. A cut is made before a single space between two characters that can't
    be white space; longer runs of white space and Unicode spaces stay inside a part."""

    # fixed by the vocabulary, except that NUL ends a part
    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}\0]+"
                            r"|\p{White_Space}+(?![^\p{White_Space}\0])|\p{White_Space}+|\0")

    def parts(self, body, offsets):
        n = len(body)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        cut = np.zeros(n + 1, bool)
        at = np.flatnonzero(body == 32)
        at = at[(at > 0) & (at < n - 1)]
        before, after = body[at - 1], body[at + 1]
        ok = ~_LOW[before] & ~_LOW[after] & ~_LEAD2[after] & ~_LEAD3[after]
        ok &= ~_LEAD2[body[np.maximum(at - 2, 0)]] & ~_LEAD3[body[np.maximum(at - 3, 0)]]
        cut[at[ok]] = True
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        return edges[:-1], edges[1:], np.searchsorted(edges[:-1], offsets)


class WordTokens(PartTokens):
    """BPE that drops white space: words between ASCII white space are independent of each other."""

    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}\0]+|\0")

    def normal(self, text):
        # letter by letter: no final sigma
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def parts(self, body, offsets):
        return plain_words(body, offsets)


@lru_cache(maxsize=4)
def byte_tokens(path: str = "byte_bpe_50k.json") -> ByteTokens:
    return ByteTokens(path)


@lru_cache(maxsize=4)
def word_tokens(path: str = "word_bpe_49k.json") -> WordTokens:
    return WordTokens(path)
