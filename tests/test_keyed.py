"""The keyed table against a plain dictionary: any split of the arrivals, replays, few keys, null keys, empty batches."""

from __future__ import annotations

import random

import pytest

from tamis.streaming.keyed import KeyedTable

SCHEMA = "k bigint, stamp bigint, v string"


def table_at(spark, folder, **more):
    schema = spark.createDataFrame([], SCHEMA).schema
    return KeyedTable(str(folder / "t"), schema, ["k"], **({"order": ["stamp", "v"], "buckets": 8, "pages": 2} | more))


def newest(rows):
    best = {}
    for row in rows:
        if row[0] not in best or row[1:] > best[row[0]][1:]:
            best[row[0]] = row
    return sorted(best.values(), key=str)


def stored(spark, table):
    return sorted((tuple(r) for r in table.rows(spark).collect()), key=str)


@pytest.mark.parametrize("cuts", [1, 3, 5])
def test_any_split_gives_the_newest_row(spark, tmp_path, cuts):
    rng = random.Random(cuts)
    rows = [(rng.choice([None, *range(40)]), rng.randrange(9), rng.choice("abc")) for _ in range(300)]
    table = table_at(spark, tmp_path, most_parts=2)
    for i in range(cuts):
        table.merge(spark.createDataFrame(rows[i::cuts], SCHEMA), i)
    assert stored(spark, table) == newest(rows)


def test_first_row_stays_without_order(spark, tmp_path):
    table = table_at(spark, tmp_path, order=[])
    table.merge(spark.createDataFrame([(1, 5, "a"), (None, 1, "n")], SCHEMA), 0)
    table.merge(spark.createDataFrame([(1, 9, "b"), (None, 2, "m"), (2, 1, "c")], SCHEMA), 1)
    assert stored(spark, table) == sorted([(1, 5, "a"), (None, 1, "n"), (2, 1, "c")], key=str)


def test_replay_and_second_stream(spark, tmp_path):
    table = table_at(spark, tmp_path)
    first = spark.createDataFrame([(1, 1, "a")], SCHEMA)
    assert table.merge(first, 0, "one").applied
    again = table.merge(spark.createDataFrame([(1, 1, "a"), (7, 7, "x")], SCHEMA), 0, "one")
    assert not again.applied and stored(spark, table) == [(1, 1, "a")]
    assert table.merge(spark.createDataFrame([(2, 1, "b")], SCHEMA), 0, "two").applied
    assert stored(spark, table) == [(1, 1, "a"), (2, 1, "b")]


def test_few_keys_read_few_parts(spark, tmp_path):
    table = table_at(spark, tmp_path, buckets=16)
    table.merge(spark.range(2000).selectExpr("id AS k", "0 AS stamp", "'a' AS v"), 0)
    known = table.merge(spark.createDataFrame([(5, 1, "b")], SCHEMA), 1)
    assert (known.touched, known.parts_read) == (1, 1)
    sparse = table_at(spark, tmp_path / "sparse", buckets=2, pages=8)
    sparse.merge(spark.range(20).selectExpr("id AS k", "0 AS stamp", "'a' AS v"), 0)
    unknown = sparse.merge(spark.createDataFrame([(1_000_003, 1, "b")], SCHEMA), 1)
    assert (unknown.touched, unknown.parts_there, unknown.parts_read) == (1, 1, 0)
    assert table.rows(spark).count() == 2000 and sparse.rows(spark).count() == 21
    asked = spark.createDataFrame([(5, 0, ""), (9_999_999, 0, "")], SCHEMA)
    assert [tuple(r) for r in table.lookup(asked).collect()] == [(5, 1, "b")]


def test_a_failed_batch_leaves_nothing(spark, tmp_path, monkeypatch):
    table = table_at(spark, tmp_path)
    table.merge(spark.createDataFrame([(1, 1, "a")], SCHEMA), 0)
    with monkeypatch.context() as broken:
        broken.setattr(KeyedTable, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.merge(spark.createDataFrame([(1, 2, "b"), (2, 2, "c")], SCHEMA), 1)
    assert stored(spark, table) == [(1, 1, "a")]
    table.merge(spark.createDataFrame([(1, 2, "b"), (2, 2, "c")], SCHEMA), 1)
    assert stored(spark, table) == [(1, 2, "b"), (2, 2, "c")]


def test_empty(spark, tmp_path):
    table = table_at(spark, tmp_path)
    assert stored(spark, table) == []
    table.merge(spark.createDataFrame([], SCHEMA), 0)
    assert stored(spark, table) == []
