"""Ranked search against plain counts."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tamis.llm import lexical
from tamis.llm.hashing import lower_ascii

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """(item position, rank, doc_id, score) of docs (doc_id, text) and item texts."""
    bags = [(i, Counter(split(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for number, text in enumerate(items):
        scored = []
        for i, bag in bags:
            m = 25 + 75 * sum(bag.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in split(text) if bag[t])
            if score > 0 and i is not None:
                scored.append((-score, i))
        out += [(number, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("sizes", [{}, {"tile_docs": 3, "item_bytes": 400}])
def test_ranked(spark, docs, corpus, sizes, monkeypatch):
    if sizes:
        monkeypatch.setattr(lexical, "TILE_TERMS", 4)
        monkeypatch.setattr(lexical, "DIGIT", 3)  # many digits and tiles
        monkeypatch.setattr(lexical, "CHUNK_ITEMS", 2)
    texts = [t for _, t, *_ in corpus[:40:7]] + ["", None, "  ", "the changed CHANGED Long", "İstanbul é ΑΣ 中文 don't", "nowhere9", "aaaa " * 500]
    items = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "item_id int, text string, score int")
    got = sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.ranked(docs, items, **sizes).collect())
    assert got == sorted(brute([(i, t) for i, t, *_ in corpus], texts))


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, "same words here") for i in range(50, 0, -1)] + [(99, "other text entirely"), (98, "and more of other things"), (None, "same words here words"),
                                                                 (97, None), (96, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    items = spark.createDataFrame([(1, "words"), (1, "other"), (None, "words"), (3, "words")], "item_id int, text string")
    got = lexical.ranked(docs, items).collect()
    want = brute(rows, ["words", "other"])
    words = [(r, i, s) for n, r, i, s in want if n == 0]
    assert [i for _, i, _ in words] == list(range(1, 11))
    assert sorted((r["rank"], r.doc_id, r.score) for r in got if r.item_id == 3) == words
    assert sorted((r["rank"], r.doc_id, r.score) for r in got if r.item_id is None) == words
    assert sorted((r["rank"], r.doc_id, r.score) for r in got if r.item_id == 1) == sorted(words + [(r, i, s) for n, r, i, s in want if n == 1])


def test_repeated_rows_and_nothing(spark, no_docs):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c d")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "A")], "item_id bigint, text string")
    assert sorted((r["rank"], r.doc_id) for r in lexical.ranked(docs, items).collect()) == [(1, 1), (2, 1)]
    assert lexical.ranked(no_docs, items).count() == 0
    assert lexical.ranked(docs, items.limit(0)).count() == 0
    assert lexical.ranked(docs.limit(0), items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_sums_are_exact():
    """Largest weights and impacts: the product of tiles equals that of Python's whole numbers."""
    count = lexical.TILE_TERMS + 5
    items = lexical.Items(["a"], None, [(np.arange(count), np.full(count, 10**4))], np.full(count, 45_000))
    impact = np.full(count, 999_999)
    impact[::3] = 999_998
    got = lexical.multiply(items, [0], np.zeros(count, np.int64), np.arange(count), impact, 1)
    assert got[0, 0] == sum(10**4 * 45_000 * int(x) for x in impact)


def test_terms():
    text = "A-b_c9 Éé\x7fZ\x00q ÀB"
    body = np.frombuffer(text.encode(), np.uint8)
    words, at = lexical.terms(body, np.array([0, len(body)]))
    assert [w.decode() for w in words.to_pylist()] == split(text) and at.tolist() == [0, len(words)]
    assert bytes(lower_ascii(np.frombuffer(b"AZaz@[", np.uint8))) == b"azaz@["
