"""Edit distances against the plain table, and mentions against a plain search."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.functions import edits as E
from tamis.operators.mentions import mentions


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def changed(rng, a, times, letters):
    a = list(a)
    for _ in range(times):
        at = rng.randrange(len(a) + 1)
        a[at:at + rng.randrange(2)] = rng.choice([[], [rng.choice(letters)]])
    return a


@pytest.mark.parametrize("longest,letters", [(12, 2), (130, 4), (400, 3), (300, 5000)])
def test_distances(longest, letters):
    rng = random.Random(longest)
    pairs = []
    for _ in range(60):
        a = [rng.randrange(letters) for _ in range(rng.randrange(longest + 1))]
        b = changed(rng, a, rng.randrange(longest // 3 + 1), range(letters)) if rng.random() < 0.7 else [
            rng.randrange(letters) for _ in range(rng.randrange(longest + 1))]
        pairs.append((a, b))
    got = E.distances([np.array(a, dtype=np.int64) for a, _ in pairs], [np.array(b, dtype=np.int64) for _, b in pairs])
    assert got.tolist() == [plain(a, b) for a, b in pairs]


def test_block_edges_and_sparse_sets(monkeypatch):
    rng = random.Random(5)
    pairs = [([rng.randrange(3) for _ in range(n)], [rng.randrange(3) for _ in range(m)]) for n in (1, 63, 64, 65, 128, 129) for m in (1, 64, 129, 200)]
    arrays = [[np.array(s, dtype=np.int64) for s in side] for side in zip(*pairs, strict=True)]
    expected = [plain(a, b) for a, b in pairs]
    assert E.distances(*arrays).tolist() == expected
    monkeypatch.setattr(E, "GROUP_SYMBOLS", 100)
    assert E.distances(*arrays).tolist() == expected


def test_columns(spark):
    rows = [("kitten", "sitting"), ("", "abc"), (None, "a"), ("añ😀b", "an😀"), ("", ""), ("x" * 3000 + "a", "x" * 3000 + "b" * 70)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", E.edit_distance("a", "b").alias("d"), F.levenshtein("a", "b").alias("l"),
                    E.list_distance(F.split("a", ""), F.split("b", "")).alias("w")).collect()
    assert [r.d for r in got] == [r.l for r in got] and got[2].w is None and got[0].w == 3


def test_mentions(spark):
    texts = [(1, "The old tree, the OLD-tree and the old"), (1, "old tree"), (2, ""), (3, None), (None, "tree tree tree"), (4, "treehouse of old")]
    keys = ["old tree", "Old", "tree tree", "the old tree", "  ", None, "house", "OLD  tree!"]
    words = {k: " ".join(re.findall(r"\w+", k.lower())) for k in keys if k}
    expected = {}
    for i, text in texts:
        line = re.findall(r"\w+", (text or "").lower())
        for key in {w for w in words.values() if w}:
            k = key.split()
            n = sum(line[p:p + len(k)] == k for p in range(len(line)))
            if n:
                expected[i, key] = expected.get((i, key), 0) + n
    t = spark.createDataFrame(texts, "doc_id bigint, text string")
    k = spark.createDataFrame([(x,) for x in keys], "key string")
    for limit in (1 << 20, 0):
        assert {(r.doc_id, r.key): r.n for r in mentions(t, k, key_bytes=limit).collect()} == expected
    assert mentions(t, k.limit(0)).collect() == [] and mentions(t.limit(0), k).collect() == []
