"""Counts from changes against a plain pass, for several splits of the arrivals; state of closed entries goes."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tamis.streaming import jobs as J
from tamis.streaming import state as S

SCHEMA = "k bigint, at timestamp, label string"


def run(spark, folder, rows, cuts, hold):
    spark.createDataFrame([], SCHEMA).write.mode("append").parquet(str(folder / "in"))
    stream = J.read_stream(spark, str(folder / "in"), spark.createDataFrame([], SCHEMA).schema)
    out = []
    flags = {"open": F.expr("label IS NULL"), "done": F.expr("label = 'x'")}
    changes = S.count_changes(stream, "k", "at", F.col("label"), F.expr("label IS NOT NULL"), flags, hold)
    for i in range(cuts):  # a restart from the checkpoint after every slice
        spark.createDataFrame(rows[i * len(rows) // cuts:(i + 1) * len(rows) // cuts], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        with S.state_store(spark):
            J.run_batches(changes, lambda df, _: out.extend(df.collect()), str(folder / "cp"), "append")
    return sum(r.open for r in out), sum(r.done for r in out)


@pytest.mark.parametrize("cuts", [1, 3])
def test_any_split(spark, tmp_path, cuts):
    rng = random.Random(cuts)
    start = datetime(2024, 1, 1)
    rows = [(rng.choice([None, *range(12)]), start + timedelta(hours=rng.randrange(500)), rng.choice([None, "x", "y"])) for _ in range(80)]
    newest = {}
    for k, at, label in rows:
        newest[k] = max(newest.get(k, (datetime.min, "")), (at, label or ""))
    got = run(spark, tmp_path, rows, cuts, "1000 days")
    assert got == (sum(v[1] == "" for v in newest.values()), sum(v[1] == "x" for v in newest.values()))


def test_closed_entries_go(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(days=k), None) for k in range(6)] + [(k, start + timedelta(days=10 + k), "x") for k in range(5)]
    rows += [(100 + i, start + timedelta(days=60 + i), None) for i in range(6)]
    assert run(spark, tmp_path, rows, 3, "2 days") == (7, 5)  # the closed ones stay counted
    kept = spark.read.format("statestore").option("stateVarName", "entry").load(str(tmp_path / "cp"))
    assert sorted(r[0] for r in kept.select("key.k").collect()) == [5, *range(100, 106)]


def test_a_value_of_the_store_holds_many_keys(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(10**6 + i, start + timedelta(seconds=i), None) for i in range(20_000)]
    rows += [(10**6 + i, start + timedelta(days=1, seconds=i), "x") for i in range(0, 20_000, 4)]
    rows += [(None, start, None), (42, start, None), (-7, start, "x")]
    assert run(spark, tmp_path, rows, 1, "1000 days") == (15_002, 5_001)
    kept = spark.read.format("statestore").option("stateVarName", "entry").load(str(tmp_path / "cp"))
    entries = F.from_json("value.entries", "array<array<string>>")
    n, keys, most = kept.agg(F.count(F.lit(1)), F.sum(F.size(entries)), F.max(F.size(entries))).first()
    assert n <= S.BUCKETS and keys == 20_003 and most < 40


def test_a_bucket_keeps_what_is_not_due(spark, tmp_path):
    """Keys of one bucket go one by one; what closes and opens again in time stays, and a text key is told from a null one."""
    folder, start = tmp_path / "in", datetime(2024, 1, 1)
    schema = "k string, at timestamp, label string"
    steps = [[("a", 0, "x"), ("b", 1, "x"), ("c", 0, "x"), ("null", 0, None), (None, 0, None)], [("c", 1, None), ("far", 2, None)], [("far", 4, None)]]
    spark.createDataFrame([], schema).write.parquet(str(folder))
    stream = J.read_stream(spark, str(folder), spark.createDataFrame([], schema).schema)
    flags, out, left = {"open": F.expr("label IS NULL"), "done": F.expr("label = 'x'")}, [], []
    changes = S.count_changes(stream, "k", "at", F.col("label"), F.expr("label IS NOT NULL"), flags, "36 hours", buckets=1)
    for step in steps:
        rows = [(k, start + timedelta(days=d), label) for k, d, label in step]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        with S.state_store(spark):
            J.run_batches(changes, lambda df, _: out.extend(df.collect()), str(tmp_path / "cp"), "append")
        kept = spark.read.format("statestore").option("stateVarName", "entry").load(str(tmp_path / "cp"))
        left.append({k for r in kept.select(F.from_json("value.entries", "array<array<string>>").alias("e")).collect() for k in (e[0] for e in r.e)})
    assert left == [{"a", "b", "c", "null", None}, {"b", "c", "null", None, "far"}, {"c", "null", None, "far"}]
    assert (sum(r.open for r in out), sum(r.done for r in out)) == (4, 2)  # a and b stay counted


def test_null_stamps_are_the_oldest_and_stay(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(1, None, None), (1, None, "x"), (2, None, "x"), (2, start, None), (3, None, None), (4, start, "x"), (4, None, None), (5, None, "x")]
    assert run(spark, tmp_path, rows + [(9, start + timedelta(days=90), None)], 1, "2 days") == (3, 3)
    kept = spark.read.format("statestore").option("stateVarName", "entry").load(str(tmp_path / "cp"))
    assert sorted(r[0] for r in kept.select("key.k").collect()) == [1, 2, 3, 5, 9]
