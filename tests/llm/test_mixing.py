"""The splitting tree, targets and shares of a mix against plain versions."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tamis.llm import mixing


def targets(sizes: dict, weights=(3, 1, 2), total=None) -> dict:
    """Water is poured until it is used up: sources that are full drop out, the rest share again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, total = set(order), 1.5 * sum(sizes.values()) if total is None else total
    out = {}
    while left:
        share = (total - sum(out.values())) / sum(weight[s] for s in left)
        full = {s for s in left if share * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: share * weight[s] for s in left}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= full
    return out


def shares(rows) -> list:
    """(doc_id, source, size, taken) of (doc_id, text, source)."""
    sized = [(i, s, len(re.findall("[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    total = Counter()
    for _, s, n in sized:
        total[s] += n
    want, out = targets(dict(total)), []
    for source in total:
        quota, at = math.floor(want[source] + 0.5), 0
        key = lambda r: (hashlib.md5(f"11:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[2])
        for i, s, n in sorted((r for r in sized if r[1] == source), key=key):
            out.append((i, s, n, sum(max(0, min(n, quota - at - e * total[source])) for e in range(2))))
            at += n
    return out


def taken(mixed):
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.words_taken(mixed).collect()), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"block_words": 50, "shard_words": 300, "range_rows": 10}])
def test_shares(docs, corpus, sizes):
    mixed = mixing.mix(docs, **sizes).cache()
    rows = [(i, t, s) for i, t, _, s, _ in corpus]
    want = shares(rows)
    size = Counter()
    for _, s, n, _ in want:
        size[s] += n
    goal = targets(dict(size))
    assert taken(mixed) == sorted(((i, n, size[s], round(goal[s], 6), k) for i, s, n, k in want), key=repr)
    for s in size:
        assert abs(sum(k for _, q, _, k in want if q == s) - goal[s]) <= 0.5
    again = mixing.mix(docs.repartition(5, F.rand()), **sizes)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, mixed.collect()))


def test_blocks_are_drawn_once_and_shards_have_their_size(docs, corpus):
    mixed = mixing.mix(docs, block_words=50, shard_words=300).where("shard is not null").collect()
    assert len({(r.doc_id, r.copy, r.epoch) for r in mixed}) == len(mixed)
    total = sum(r.words for r in mixed)
    by_shard = Counter()
    for r in mixed:
        by_shard[r.shard] += r.words
    assert len(by_shard) >= total // 300 // 2 and max(by_shard.values()) < 300 + 50 + 2 * max(r.size for r in mixed)
    own = [r.turn for r in mixed if r.shard == 0]
    assert len(set(own)) == len(own)


def test_quotas(spark):
    quotas = {0: 1000, 1: 37, 2: 512, 3: 0, 5: 1}
    table = spark.createDataFrame(list(quotas.items()), "place int, blocks bigint")
    for shards in (1, 2, 13):
        got = mixing.split_quotas(table, shards).collect()
        by_place, by_shard = Counter(), Counter()
        for r in got:
            by_place[r.place] += r.blocks
            by_shard[r.shard] += r.blocks
        assert dict(by_place) == {p: q for p, q in quotas.items() if q}
        assert [by_shard[i] for i in range(shards)] == [1550 * (i + 1) // shards - 1550 * i // shards for i in range(shards)]


@pytest.mark.parametrize("marked,total,drawn", [(30, 100, 20), (1, 7, 3), (90, 100, 95), (500, 2000, 1000), (3, 1_000_000, 500_000)])
def test_hypergeometric_law(spark, marked, total, drawn):
    n = 40_000
    one = mixing.hypergeometric(*(F.lit(v).cast("long") for v in (marked, total, drawn)), mixing._uniform(F.lit(7), F.col("id")))
    got = {r.x: r["count"] / n for r in spark.range(n).select(one.alias("x")).groupBy("x").count().collect()}
    law = {x: math.comb(marked, x) * math.comb(total - marked, drawn - x) / math.comb(total, drawn) for x in range(marked + 1)
           if drawn - x <= total - marked and x <= drawn} if total < 10_000 else {x: math.comb(3, x) / 8 for x in range(4)}
    assert set(got) <= set(law)
    assert max(abs(got.get(x, 0) - p) for x, p in law.items()) < 0.012
    mean = sum(x * p for x, p in got.items())
    assert abs(mean - drawn * marked / total) < 5 * math.sqrt(drawn * marked / total + 1) / math.sqrt(n) + 1e-9


def test_two_halves_of_a_draw_are_independent_of_the_order(spark):
    """Counts of a shard over many seeds have the mean of their share."""
    table = spark.createDataFrame([(0, 60), (1, 30), (2, 10)], "place int, blocks bigint")
    sums = defaultdict(int)
    for seed in range(6):
        for r in mixing.split_quotas(table, 4, seed).collect():
            sums[(r.shard, r.place)] += r.blocks
    for shard in range(4):
        assert abs(sums[(shard, 0)] / 6 - 15) < 4 and abs(sums[(shard, 1)] / 6 - 7.5) < 4


def test_odd_rows(spark, no_docs):
    assert mixing.mix(no_docs).count() == 0
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "a b c", "s"), (None, "x y", None), (None, "x y", None), (2, None, "s"), (3, "", "t"), (4, " \n ", None)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, words int")
    got = mixing.words_taken(mixing.mix(table)).collect()
    assert sorted(((r.doc_id, r.size, r.taken) for r in got), key=repr) == sorted(((i, n, k) for i, _, n, k in shares(rows)), key=repr)
    empty = mixing.words_taken(mixing.mix(table.where("doc_id in (2, 3)"))).collect()
    assert sorted((r.doc_id, r.taken, r.target) for r in empty) == [(2, 0, 0.0), (3, 0, 0.0)]


def test_texts_of_the_mix(spark, docs, corpus):
    some = docs.where("doc_id is not null")
    mixed = mixing.mix(some, block_words=50, shard_words=300)
    texts = mixing.mixed_texts(some, mixed)
    rows = texts.collect()
    assert texts.columns == ["shard", "turn", "epoch", *docs.columns]
    words = Counter()
    for r in rows:
        words[r.doc_id] += len(re.findall("[^\x20\x09-\x0D]+", r.text or ""))
        assert dict((i, t) for i, t, *_ in corpus)[r.doc_id].startswith(r.text)
    assert words == Counter({i: k for i, _, _, k in shares([(i, t, s) for i, t, _, s, _ in corpus]) if k})
    shard_of = defaultdict(list)
    for r in rows:
        shard_of[r.shard].append(r.turn)
    assert all(v == sorted(v) for v in shard_of.values())


def test_no_python_in_the_mix(docs):
    mixed = mixing.words_taken(mixing.mix(docs))
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
