"""Token counts at every prefix of a text, by dynamic programming over the prefixes of its words.

Of a byte-pair encoding every prefix of the token list is the encoding of its own string. So the last token of a prefix of
length j is the one vocabulary token t that ends there and is compatible with the last token of the prefix of length
j - len(t); the count is that prefix's count plus one. Two tokens are compatible when no merge between them would have come
first while both sides were built up: this is read off the two split trees, nothing is encoded again.

The vocabulary marks the end of a word, so a word cut at j ends with a marked token: the open prefixes carry the state, the
marked ones give the count. Counts of a text add up over its words, and answer how many tokens any prefix has and where to cut
for a budget.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.flat import gather, slices, sums, text_bytes, words_of
from tamis.llm.merges import NO_RANK, Lookup
from tamis.llm.tokens import WordTokens

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
LONG_WORD = 64
_SPACES = regex.compile(r"\p{White_Space}")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class PrefixCounts(WordTokens):
    """Counts at the character prefixes of words. The value of a part is one count per character; -1 where the part can't be cut
    (inside a part whose characters change in number or order under normalisation, or that holds a special string or a NUL)."""

    def __init__(self, path: str = VOCABULARY):
        super().__init__(path)
        v = self.vocabulary
        n = len(v.names)
        size = max(v.names) + 1
        self.rank = np.full(size, -1, np.int64)
        self.rank[v.made] = np.arange(len(v.made))
        if len(np.unique(v.made)) != len(v.made):
            raise ValueError("a token is made by two merges")
        self.left, self.right = np.arange(size), np.arange(size)
        self.left[v.made], self.right[v.made] = v.left, v.right
        # tokens as bytes, and those that the encoder can really give
        body: dict[int, bytes] = {int(i): bytes([b]) for b, i in enumerate(v.inner)}
        marked = {int(i): bytes([b]) for b, i in enumerate(v.final)}
        for a, b, m in zip(v.left.tolist(), v.right.tolist(), v.made.tolist(), strict=True):
            if b in marked:
                marked[m] = body[a] + marked[b]
            else:
                body[m] = body[a] + body[b]
        self.open = self._real(body, False)
        self.closed = self._real(marked, True)
        self.longest = max(map(len, body.values()))

    def _real(self, tokens: dict[int, bytes], ended: bool) -> Lookup:
        """Token by the hash of its bytes, for the tokens that are their own encoding."""
        ids, words = np.array(list(tokens)), list(tokens.values())
        v = self.vocabulary
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        first = v.inner[flat]
        if ended:
            first[np.cumsum(lengths) - 1] = v.final[flat[np.cumsum(lengths) - 1]]
        _, out = v.merges.run(first, lengths.copy())
        real = out == 1
        powers = _powers(_BASE, int(lengths.max()))
        starts = np.cumsum(lengths) - lengths
        terms = (flat.astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(flat)) - np.repeat(starts, lengths)]
        keys = np.add.reduceat(terms, starts)
        return Lookup(keys[real], ids[real], -1)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the tokens a, b stay apart when their strings stand side by side. Goes back in time from the two tokens to their
        first symbols; at each step the newer side is taken apart, and the pair that then touches must not merge sooner than
        the merges that really built the sides."""
        ok = np.ones(len(a), bool)
        a, b = a.astype(np.int64), b.astype(np.int64)
        before_a = np.full(len(a), NO_RANK, np.int64)
        before_b = before_a.copy()
        at = np.arange(len(a))
        while len(at):
            m = self.vocabulary.merges.rank(a, b)
            bad = (m < before_a) & (m <= before_b)
            ok[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            before_a, before_b = before_a[go], before_b[go]
            of_a = ra > rb
            before_a = np.where(of_a, ra, before_a)
            before_b = np.where(of_a, before_b, rb)
            a, b = np.where(of_a, self.right[a], a), np.where(of_a, b, self.left[b])
        return ok

    def _candidates(self, found: Lookup, sums_: np.ndarray, back: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """(end, length, token), longest first for each end, of all tokens inside the words; ends are places after a byte."""
        place = np.arange(starts[0], ends[-1]) + 1
        room = place - np.repeat(starts, ends - starts)
        at, size, token = [], [], []
        for k in range(1, min(self.longest, int(room.max())) + 1):
            some = place[room >= k]
            t = found((sums_[some] - sums_[some - k]) * back[some - k])
            hit = t >= 0
            at.append(some[hit])
            size.append(np.full(int(hit.sum()), k))
            token.append(t[hit])
        at, size, token = np.concatenate(at), np.concatenate(size), np.concatenate(token)
        order = np.lexsort((-size, at))
        return at[order], size[order], token[order]

    def _solve(self, words: list[bytes]) -> np.ndarray:
        """Count at every byte prefix of the words, one after the other."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        n = len(flat)
        sums_ = np.concatenate((np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n)[:n])))
        back = _powers(_BACK, n)
        depth = np.arange(1, n + 1) - np.repeat(starts, lengths)  # place in its word of the prefix that ends after byte i
        last, count = np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int64)
        self._fill(self._candidates(self.open, sums_, back, starts, ends), depth, last, count, last, count, True)
        shut, out = np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int64)
        self._fill(self._candidates(self.closed, sums_, back, starts, ends), depth, last, count, shut, out, False)
        return out[1:]

    def _fill(self, candidates, depth, last, count, into, total, in_order: bool) -> None:
        """Settle each end by its longest compatible candidate. With `in_order` by growing depth, as the state before is needed."""
        at, size, token = candidates
        level = depth[at - 1] if in_order else np.zeros(len(at), np.int64)
        order = np.argsort(level, kind="stable")
        bounds = np.searchsorted(level[order], np.arange(level.max() + 2)) if len(level) else np.zeros(1, np.int64)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            rows = order[a:b]
            while len(rows):
                first = np.append(True, at[rows[1:]] != at[rows[:-1]])
                head = rows[first]
                begin = at[head] - size[head]
                whole = depth[at[head] - 1] == size[head]
                ok = whole.copy()
                rest = np.flatnonzero(~whole)
                ok[rest] = self.compatible(last[begin[rest]], token[head[rest]])
                done = head[ok]
                into[at[done]] = token[done]
                total[at[done]] = np.where(whole[ok], 0, count[begin[ok]]) + 1
                rows = rows[~first]
                rows = rows[into[at[rows]] < 0]

    def _long(self, word: bytes) -> np.ndarray:
        """`_solve` for one long word, place by place."""
        n = len(word)
        flat = np.frombuffer(word, np.uint8)
        sums_ = np.concatenate((np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n)[:n])))
        back = _powers(_BACK, n)
        pair: dict[tuple[int, int], bool] = {}

        def fits(a: int, b: int) -> bool:
            if (a, b) not in pair:
                pair[a, b] = bool(self.compatible(np.array([a]), np.array([b]))[0])
            return pair[a, b]

        edges, none = np.array([0]), np.array([n])
        last, count = [-1] * (n + 1), [0] * (n + 1)
        out = np.zeros(n + 1, np.int64)
        for found, state in ((self.open, True), (self.closed, False)):
            settled = -1
            for e, k, t in zip(*(x.tolist() for x in self._candidates(found, sums_, back, edges, none)), strict=True):
                if e != settled and (k == e or fits(last[e - k], t)):
                    settled = e
                    out[e] = count[e - k] + 1
                    if state:
                        last[e], count[e] = t, count[e - k] + 1
        return out[1:]

    def values_of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        counts: dict[int, np.ndarray] = {i: self._long(w) for i, w in enumerate(words) if len(w) > LONG_WORD}
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.zeros(int(lengths.sum()), np.int64)
        starts = np.cumsum(lengths) - lengths
        for first in range(0, len(short), 100_000):
            some = short[first:first + 100_000]
            at = np.array(some)
            solved = self._solve([words[i] for i in some])
            size = lengths[at]
            flat[np.repeat(starts[at], size) + np.arange(len(solved)) - np.repeat(np.cumsum(size) - size, size)] = solved
        for i, c in counts.items():
            flat[starts[i]:starts[i] + lengths[i]] = c
        # only prefixes that end with a character
        body = np.frombuffer(b"".join(words), np.uint8)
        final = np.append((body[1:] & 0xC0) != 0x80, True)
        final[starts + lengths - 1] = True
        edges = np.append(starts, len(body))
        kept = sums(final, edges)
        ends = np.cumsum(kept)
        flat = flat[final]
        for i, w in enumerate(words):  # the apostrophe of a clipped word stands alone until the word is whole
            if len(w) == 3 and w in (b"'re", b"'ve", b"'ll"):
                alone = self.vocabulary.encode([b"'", w[1:2]])[1]
                flat[ends[i] - 3:ends[i] - 1] = alone[0], alone.sum()
            elif len(w) == 2 and w in (b"'s", b"'t", b"'m", b"'d"):
                flat[ends[i] - 2] = self.vocabulary.encode([b"'"])[1][0]
        return flat, kept

    def values_of_odd(self, part: str) -> list[int]:
        return [-1] * (len(part) - 1) + [len(self.library.encode(part, add_special_tokens=False).ids)]

    def _compute(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [p.decode("utf-8", "replace") for p in parts]
        normal = [self.normal(t) if not t.isascii() else t for t in texts]
        strange = self.letters.other(texts)
        odd = {i: self.values_of_odd(t) for i, (t, m) in enumerate(zip(texts, normal, strict=True))
               if "\0" in t or strange and strange.search(t) or "<|" in t and any(s in t for s in self.vocabulary.special)
               or not t.isascii() and (len(t) != len(m) or not unicodedata.is_normalized("NFC", t) or _SPACES.search(t))}
        for i in odd:
            normal[i] = ""
        found = self.pattern.findall("\0".join(normal).lower())
        ends = np.fromiter((w == "\0" for w in found), bool, len(found))
        words = [w.encode() for w in found if w != "\0"]
        at, lengths = self.words.look_up(pa.array(words, pa.binary()))
        flat = gather(self.words.flat, at, lengths)
        part_of = np.cumsum(ends)[~ends]
        # counts within a word, plus all of the words before it in its part
        whole = flat[np.cumsum(lengths) - 1] if len(lengths) else flat
        before = np.cumsum(whole) - whole
        edge = np.searchsorted(part_of, np.arange(len(texts)))
        base = np.append(before, whole.sum())[np.minimum(edge, len(before))] if len(texts) else before
        flat = flat + np.repeat(before - base[part_of], lengths)
        counts = np.bincount(part_of, lengths, len(texts)).astype(np.int64)
        if odd:
            runs = np.split(flat, np.cumsum(counts)[:-1])
            for i, x in odd.items():
                runs[i], counts[i] = np.array(x, flat.dtype), len(x)
            flat = np.concatenate(runs)
        return flat, counts


@lru_cache(maxsize=2)
def prefix_counts(path: str = VOCABULARY) -> PrefixCounts:
    return PrefixCounts(path)


def _characters(body: np.ndarray) -> np.ndarray:
    """Characters before each byte place."""
    return np.concatenate(([0], np.cumsum((body & 0xC0) != 0x80)))


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, counts array<int>): element p is the number of tokens of the first p characters (0 first), exact, or null where the
    text can't be cut (see PrefixCounts). Null and empty texts give [0]. Use `count_at` and `cut_at` on the column."""

    def run(batches):
        coder = prefix_counts(vocabulary)
        for part in slices(batches, max_bytes=1 << 20):
            body, offsets = text_bytes(part.column("text"))
            starts, ends, by_text = coder.parts(body, offsets)
            at, size = coder.table.look_up(words_of(body, starts, ends))
            flat = gather(coder.table.flat, at, size).astype(np.int64)
            whole = flat[np.cumsum(size) - 1] if len(size) else flat
            before = np.cumsum(whole) - whole
            chars = _characters(body)
            sizes = chars[offsets[1:]] - chars[offsets[:-1]] + 1
            first = np.cumsum(sizes) - sizes
            out, known = np.zeros(int(sizes.sum()), np.int64), np.ones(int(sizes.sum()), bool)
            doc = np.searchsorted(by_text, np.arange(len(starts)), "right") - 1
            base = np.append(before, whole.sum())[by_text[:-1]]
            # the count stays as it is over white space: carry the last one on
            put = first[doc] + chars[starts] - chars[offsets[doc]]
            place = np.repeat(put, size) + np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + 1
            step = np.zeros(len(out), np.int64)
            step[put + size] = 1
            text_of = np.repeat(np.arange(len(sizes)), sizes)
            passed = np.cumsum(step) + 0
            out = np.append(before, whole.sum())[passed] - base[text_of]
            out[place] = flat + np.repeat(before - base[doc], size)
            known[place[flat < 0]] = False
            lists = pa.ListArray.from_arrays(np.append(first, len(out)).astype(np.int32), pa.array(out.astype(np.int32), mask=~known))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "counts"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, counts array<int>")


def count_at(counts: str, characters: int):
    """Tokens of the first `characters` characters; of the whole text where it is shorter."""
    return F.element_at(counts, F.least(F.lit(characters + 1), F.size(counts)))


def cut_at(counts: str, budget: int):
    """Characters of the longest prefix that has at most `budget` tokens and ends where the text can be cut."""
    fits = F.transform(F.col(counts), lambda c, i: F.when(c <= budget, i))
    return F.array_max(fits)


def token_budget(docs: DataFrame, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text",
                 vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, limit_chars) of every whole text from its prefix counts: `limit_chars` is the length in
    characters of the longest prefix with at most `limit` tokens. Null and empty texts have 0 bytes and tokens."""

    def run(batches):
        coder = prefix_counts(vocabulary)
        for part in slices(batches):
            body, offsets = text_bytes(part.column("text"))
            starts, ends, by_text = coder.parts(body, offsets)
            at, size = coder.table.look_up(words_of(body, starts, ends))
            whole = coder.table.flat[at + size - 1].astype(np.int64)
            total = np.concatenate(([0], np.cumsum(whole)))
            n_tokens = total[by_text[1:]] - total[by_text[:-1]]
            chars = _characters(body)
            cut = chars[offsets[1:]] - chars[offsets[:-1]]
            for d in np.flatnonzero(n_tokens > limit):
                a, b = by_text[d], by_text[d + 1]
                w = a + int(np.searchsorted(total[a + 1:b + 1] - total[a], limit, "right"))  # the first word that goes beyond
                inner = coder.table.flat[at[w]:at[w] + size[w]]
                fits = np.flatnonzero((inner >= 0) & (inner + total[w] - total[a] <= limit))
                cut[d] = chars[starts[w]] - chars[offsets[d]] + (fits[-1] + 1 if len(fits) else 0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n_tokens),
                                              pc.greater(pa.array(n_tokens), limit), pa.array(cut)],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, limit_chars bigint")
